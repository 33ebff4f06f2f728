"""Queries see all rows of the tables, also where runs are longer than one block."""

import duckdb
import pytest

from chartloom.plans import registry
from tests.test_oracle import SF, TABLES, rows

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_candidate_pairs(spark, duck):
    from chartloom.plans.views import Views

    got = Views(spark, SF).candidate.select("entity_id", "rg_mbid").collect()
    want = duck.sql("SELECT DISTINCT 'e' || l_partkey, 'g' || o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


SF_LONG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck_long():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_LONG}/{t}.parquet'")
    return con


LONG = "rank_range src_entries_json src_positions_json src_pivoted_years_json pages_strategy_fallback pages_year_column wiki_link_enrich coverage_report entry_scores work_chart_positions overlap_pct position_xref integrity_check ingest_run charts_blob charts_blob_parse pages_table_rows pages_text_lines pages_list_items".split()


@pytest.mark.parametrize("name", LONG)
def test_all_entries(spark, duck_long, name, monkeypatch):
    """Runs have more than 40 entries here, and blocks of ranks are small enough that runs have several."""
    from chartloom.plans import views

    monkeypatch.setattr(views, "BLOCK", 50)
    got, want = registry.queries()[name](spark, SF_LONG), duck_long.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


def test_entry_count(spark, duck_long):
    from chartloom.plans.views import Views

    want = duck_long.sql("SELECT count(*) FROM (SELECT DISTINCT c_mktsegment, strftime(o_orderdate, '%Y-%m'), l_partkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey)").fetchall()[0][0]
    assert Views(spark, SF_LONG).entry.count() == want
