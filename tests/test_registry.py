"""Names of views: the SQL of a query sees the views that its module means."""

import duckdb
import pytest

from chartloom.plans import registry
from chartloom.plans.views import with_views
from tests.test_oracle import SF, TABLES, rows


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_coverage_summary(spark, duck):
    """Each entry counts once, and the library has a part of the works."""
    want = duck.sql(registry.oracle_sql()["coverage_summary"])
    sizes = dict(duck.sql(with_views("SELECT run_id, count(*) FROM fv_entry GROUP BY 1")).fetchall())
    assert {r[want.columns.index("run_id")]: r[want.columns.index("total")] for r in want.fetchall()} == sizes
    got = registry.queries()["coverage_summary"](spark, SF)
    assert 0 < got.filter("library_pct > 0").count() < got.filter("linked_pct > 0").count()
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


def test_missing_in_library(spark, duck):
    """Works of some parts are owned and those of others aren't, so that some scored works are missing and not all."""
    want = duck.sql(registry.oracle_sql()["missing_in_library"])
    got = registry.queries()["missing_in_library"](spark, SF)
    scored = duck.sql(registry.oracle_sql()["work_chart_score"]).fetchall()
    assert 0 < len(want) < len(scored)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)
