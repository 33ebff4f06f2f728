"""Jobs whose shuffles must not grow with products of tables, counted on small tables where that shows, and rows beyond sizes that were once fixed."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from chartloom.operators import search
from chartloom.plans import registry
from tests.test_oracle import SF, TABLES, rows


def stages(spark):
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def shuffled(spark, job):
    """(rows, bytes) that the stages of a job shuffle, and what it returns."""
    seen = {(s.stageId(), s.attemptId()) for s in stages(spark)}
    result = job()
    new = [s for s in stages(spark) if (s.stageId(), s.attemptId()) not in seen]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.shuffleWriteBytes() for s in new), result


def test_artist_browse_does_not_pair_queries_with_tracks(spark):
    """Every query asks for the one artist, who has all the tracks; few titles are alike."""
    frame = spark.createDataFrame
    queries = frame([(f"q{i}", "abba", f"song {i % 10}", None) for i in range(100)], "query_id string, artist string, title string, length_ms int")
    tracks = [("g", f"r{i:05}", f"song {i % 10}" if i % 100 == 0 else f"zzzzzzzz{i % 50}") for i in range(2000)]
    shelves = frame([("a", "Abba")], "artist_mbid string, name string"), frame([("a", "g")], "artist_mbid string, rg_mbid string"), frame(tracks, "rg_mbid string, recording_mbid string, title_normalized string")
    rows, _, got = shuffled(spark, lambda: search.artist_browse(queries, *shelves, title_at_least=99.0, limit=7).collect())
    of_title = {}
    for _, rec, title in tracks:
        of_title.setdefault(title, []).append(rec)
    want = {(f"q{i}", rec) for i in range(100) for rec in sorted(of_title.get(f"song {i % 10}", []))[:7]}
    assert want and {(r.query_id, r.recording_mbid) for r in got} == want and len(got) == len(want)
    assert rows < 30_000


def test_like_batch_searches_equal_queries_once(spark):
    """All queries ask for the same two things, all rows have one of four names."""
    queries = spark.createDataFrame([(i, "A", "x" if i % 2 else None) for i in range(500)], "query_id int, text string, artist string")
    data = [(f"k{i:04}", f"a{i % 4}", "X" if i % 8 < 4 else "y") for i in range(1000)]
    # So that hits are counted before the first ones are chosen.
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "-1")
    try:
        rows, _, got = shuffled(spark, lambda: search.like_batch(queries, spark.createDataFrame(data, "key string, name string, artist_name string"), 3).collect())
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    first = lambda artist: sorted((n, k) for k, n, a in data if artist is None or a == "X")[:3]
    assert sorted((r.query_id, r.name, r.key) for r in got) == sorted((i, *x) for i in range(500) for x in first("x" if i % 2 else None))
    assert rows < 5_000


#: Rows and bytes that queries may shuffle over sf0.001, which has 6,000 rows of lineitem.
SHUFFLED = {
    "evidence_bundle": (25_000, 500_000), "evidence_convert": (60_000, 900_000), "decision_trace": (50_000, 1_000_000), "catalogue_from_api_docs": (40_000, 1_000_000),
    "songs_get_or_create": (31_000, 400_000),
}


@pytest.mark.parametrize("name", SHUFFLED)
def test_shuffled(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n, size, _ = shuffled(spark, lambda: registry.queries()[name](spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert n < SHUFFLED[name][0] and size < SHUFFLED[name][1]


def test_search_stages_computes_queries_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(key):
        seen.add(1)
        return key

    asked = spark.createDataFrame([(f"q{i}", "abba", f"song {i}", None) for i in range(4)], "query_id string, artist string, title string, length_ms int")
    recordings = spark.createDataFrame([("r1", "abba", "song 1", 1000), ("r2", "other", "song 1", 1000), ("r3", "abba", "my song 2", 1000)], "recording_mbid string, artist_normalized string, title_normalized string, length_ms int")
    queries = asked.withColumn("query_id", F.udf(count, "string")("query_id"))
    got = search.search_stages(queries, recordings).select("query_id", "recording_mbid").collect()
    assert {("q1", "r1"), ("q2", "r3")} <= set(map(tuple, got)) and "r2" not in {r.recording_mbid for r in got}
    assert seen.value == 4


@pytest.fixture(scope="module")
def long_run(tmp_path_factory):
    """Tables of one run of 2,100 parts, some of which have keys of over a million."""
    folder = tmp_path_factory.mktemp("long")
    con = duckdb.connect()
    made = {
        "part": "SELECT i + CASE WHEN i >= 1050 THEN 998950 ELSE 0 END AS p_partkey, p.* EXCLUDE (p_partkey) FROM range(2100) t(i) JOIN '{0}/part.parquet' p ON p_partkey = i % 100",
        "customer": "SELECT * FROM '{0}/customer.parquet' WHERE c_custkey = 1",
        "orders": "SELECT * REPLACE (1 AS o_custkey) FROM '{0}/orders.parquet' WHERE o_orderkey = 1",
        "lineitem": "SELECT l.* REPLACE (1 AS l_orderkey, i + CASE WHEN i >= 1050 THEN 998950 ELSE 0 END AS l_partkey) FROM range(2100) t(i) CROSS JOIN (SELECT * FROM '{0}/lineitem.parquet' LIMIT 1) l",
    }
    for t in TABLES:
        if t in made:
            con.execute(f"copy ({made[t].format(SF)}) to '{folder}/{t}.parquet'")
        else:
            os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["upsert", "wiki_link_enrich"])
def test_beyond_fixed_sizes(spark, long_run, name):
    """Keys over the million that upsert adds to some, ranks over 2,000."""
    folder, con = long_run
    got, want = registry.queries()[name](spark, folder), con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)
