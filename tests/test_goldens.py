"""Small cases with known answers, and properties that any input has."""

import itertools
import json
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartloom.functions import normalize as nz
from chartloom.functions.canonical import KINDS, canonical_text
from chartloom.functions import similarity as sim
from chartloom.operators import analytics as an
from chartloom.operators import decisions as dc
from chartloom.operators import ingest as ig
from chartloom.operators import resolution as rs
from chartloom.operators import search, sides
from chartloom.sources import snapshots as sn
from chartloom.streaming.ingest import ENTRY, CommittedTables, Table, chart_tables, ingest_stream, keyed_entries


def titles(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", nz.normalize_title(F.col("v")).alias("t"))
    return [(r.t.core, [(t.kind, t.sub, t.value) for t in r.t.tags], r.t.guests) for r in df.orderBy("i").collect()]


def test_titles(spark):
    got = titles(spark, ["X (Radio Edit)", "X - Remastered 2011", "X (Karaoke Version)", "X (Live at Y) [Mono]", 'From "Film" X', "X (feat. B É)", "The (Live)", "Straße"])
    assert got == [
        ("x", [("edit", "radio", None)], []),
        ("x", [("remaster", None, "2011")], []),
        ("x", [("extended", "karaoke", None)], []),
        ("x", [("mix", "mono", None), ("live", None, "y")], []),
        ("x", [("ost", None, "Film")], []),
        ("x", [], ["b e"]),
        ("the", [("live", None, None)], []),
        ("strasse", [], []),
    ]


def test_artists(spark):
    names = ["The Beatles", "The The", "De Dijk", "BLØF", "P!nk", "A & B", "The X feat. Y"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(names)], "i int, v string").select("i", nz.artist_core(F.col("v")).alias("c"))
    assert [r.c for r in df.orderBy("i").collect()] == ["beatles", "the the", "de dijk", "blof", "p!nk", "a • b", "•"]


def slow_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return 100.0 if a == b else 200.0 * table[-1][-1] / (len(a) + len(b))


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=12), st.text("abcé ", max_size=12))
def test_ratio_is_indel(a, b):
    assert sim.indel_ratio(a, b) == pytest.approx(slow_ratio(a, b))


def test_ratio_goldens():
    assert [round(sim.indel_ratio("hello", x), 2) for x in ("hello", "hallo", "world")] == [100, 80, 20]
    assert sim.indel_ratio(None, "a") is None


RUNS = [("c", "2023", 1, "Queen", "Bohemian Rhapsody"), ("c", "2023", 2, "Led Zeppelin", "Stairway To Heaven"), ("c", "2023", 3, "Eagles", "Hotel California"), ("c", "2023", 4, "Pink Floyd", "Wish You Were Here"),
        ("c", "2024", 1, "Queen", "Bohemian Rhapsody"), ("c", "2024", 2, "Eagles", "Hotel California"), ("c", "2024", 3, "Led Zeppelin", "Stairway To Heaven"), ("c", "2024", 4, "The Beatles", "Hey Jude")]


def test_compare(spark):
    entries = keyed_entries(spark.createDataFrame(RUNS, ENTRY))
    runs = entries.select("run_id", "chart_id", "period").distinct()
    compared = an.compare_consecutive(entries, runs).cache()
    assert an.common(compared).count() == 3
    assert [r.title_key for r in an.only_in_first(compared).collect()] == ["wish you were here"]
    assert [r.title_key for r in an.only_in_second(compared).collect()] == ["hey jude"]
    assert an.overlap(compared).first().overlap_pct == 60
    assert {r.artist_key: r.delta for r in an.movers(compared).collect()} == {"led zeppelin": -1, "eagles": 1}


def test_previous_positions(spark):
    df = spark.createDataFrame([("(1)",), ("(3)",), ("(-)",), ("(re)",), ("nieuw",), ("15",)], "p string")
    assert [r[0] for r in df.select(nz.previous_position(F.col("p"))).collect()] == [1, 3, None, None, None, 15]


def test_sides(spark):
    rows = [("Queen", "We Will Rock You / We Are The Champions"), ("A / B", "X / Y"), ("A", "Penny Lane; Strawberry"), ("A / B", "X / Y / Z")]
    got = sides.split_sides(spark.createDataFrame(rows, "artist_raw string, title_raw string")).collect()
    assert [(r.artist_raw, r.title_raw, r.side) for r in got] == [
        ("Queen", "We Will Rock You", "A"), ("Queen", "We Are The Champions", "B"), ("A", "X", "A"), ("B", "Y", "B"), ("A", "Penny Lane", "A"), ("A", "Strawberry", "B"), ("A / B", "X / Y / Z", None)]


CAND = "entity_id string, rg_mbid string, primary_type string, is_compilation boolean, first_release_date string, artist_mbid string, title string"


@pytest.mark.parametrize(("rows", "crg", "rationale"), [
    ([("s", "Soundtrack", "1990"), ("a", "Album", "1991")], "s", "CRG:SOUNDTRACK_PREMIERE"),
    ([("s", "Single", "1990-01-01"), ("a", "Album", "1990-03-01")], "a", "CRG:ALBUM_LEAD_WINDOW"),
    ([("s", "Single", "1990-01-01"), ("a", "Album", "1991-03-01")], "s", "CRG:SINGLE_TRUE_PREMIERE"),
    ([("l", "Live", "1990"), ("a", "Album", "1991")], "l", "CRG:LIVE_ONLY_PREMIERE"),
    ([("a", "Album", "1990"), ("b", "Album", "1991")], "a", "CRG:EARLIEST_OFFICIAL"),
    ([("a", "Album", "1990"), ("s", "Single", "1990")], "a", "CRG:ALBUM_SAME_DATE_TIEBREAKER"),
    ([("a", "Album", "1990"), ("b", "Album", "1990")], None, "CRG:INDETERMINATE"),
    ([("a", "Album", None)], None, "CRG:INDETERMINATE"),
])
def test_rules(spark, rows, crg, rationale):
    made = [("e", g, k, False, d, "x", g) for g, k, d in rows]
    for extra in ([], [("e", "zz", "Album", True, "1980", "x", "zz")]):
        got = rs.select_crg(spark.createDataFrame(made + extra, CAND)).first()
        if not extra:
            assert (got.crg, got.crg_rationale) == (crg, rationale)
        elif rationale in ("CRG:EARLIEST_OFFICIAL", "CRG:ALBUM_LEAD_WINDOW", "CRG:SINGLE_TRUE_PREMIERE"):
            assert got.crg == crg  # a compilation changes nothing


def test_rules_ignore_order(spark):
    rng = random.Random(1)
    rows = [(f"e{i % 50}", f"g{rng.randrange(20)}", rng.choice(["Album", "Single", "EP", "Soundtrack", "Live"]), rng.random() < 0.2, rng.choice(["1990", "1990-05", "1991-01-02", None, "bad"]), "x", "t") for i in range(400)]
    one = sorted(map(tuple, rs.select_crg(spark.createDataFrame(rows, CAND)).collect()), key=str)
    rng.shuffle(rows)
    assert one == sorted(map(tuple, rs.select_crg(spark.createDataFrame(rows, CAND).repartition(7)).collect()), key=str)


def test_drift(spark):
    schema = "entity_id string, crg string, rr string, evidence_hash string, ruleset_version string"
    old = [(k, "a", "b", "h", "1") for k in ("same", "hash", "ev", "rules", "both", "odd")]
    new = [("none", "a", "b", "h", "1"), ("same", "a", "b", "h", "1"), ("hash", "a", "b", "i", "2"), ("ev", "c", "b", "i", "1"), ("rules", "c", "b", "h", "2"), ("both", "c", "b", "i", "2"), ("odd", "c", "b", "h", "1")]
    got = {r.entity_id: r.state for r in dc.drift(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    assert got == {"none": "DECIDED", "same": None, "hash": None, "ev": "STALE-EVIDENCE", "rules": "STALE-RULES", "both": "STALE-BOTH", "odd": "STALE-NONDETERMINISTIC"}


def test_blob_round_trip_and_bound(spark):
    rows = [("w", f"c{i}", 1000 - i, i + 1, "y") for i in range(200)]
    scores = spark.createDataFrame(rows, "work_key string, chart_id string, score long, highest int, frequency string")
    long = scores.select("work_key", "chart_id", F.lit('{"2020":1}').alias("positions"))
    blob = ig.charts_blob(scores, long)
    assert '"2020"' not in blob.first().blob
    assert sorted((r.chart_id, r.score) for r in ig.parse_blob(blob).collect()) == sorted((c, s) for _, c, s, *_ in rows)
    few = ig.charts_blob(scores.filter("score > 998"), long)
    assert [r.positions for r in ig.parse_blob(few).collect()] == ['{"2020":1}'] * 2


def test_fuzzy_search_against_all_pairs(spark):
    rng = random.Random(2)
    words = ["love", "night", "river", "stone", "blue", "dance"]
    recs = [(f"r{i}", rng.choice(["the band", "solo star"]), " ".join(rng.sample(words, 2)), 1000) for i in range(60)]
    asked = [(f"q{i}", a, (t[:3] + t[4:]) if i % 2 else t, None) for i, (_, a, t, _) in enumerate(recs[:20])]
    got = search.similar(spark.createDataFrame(asked, "query_id string, artist string, title string, length_ms int"), spark.createDataFrame(recs, "recording_mbid string, artist_normalized string, title_normalized string, length_ms int"), limit=1000).collect()
    want = {(q, r) for q, a, t, _ in asked for r, b, u, _ in recs if min(sim.indel_ratio(a, b), sim.indel_ratio(t, u)) >= 80}
    assert {(r.query_id, r.recording_mbid) for r in got} == want


def test_pages(spark):
    html = "<table><tr><th>#</th></tr><tr><td>1</td><td>A</td><td>X &amp; Y</td></tr><tr><td>1.234</td><td>B</td><td> </td></tr><tr><td>2.</td><td>B</td><td>Z [n]</td></tr></table>"
    wide = "<table><tr><td>1</td><td>(3)</td><td>A</td><td>X</td></tr><tr><td>1.234</td><td>(-)</td><td>B</td><td>Z</td></tr><tr><td>3</td><td>C</td><td>W</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, "<ol><li>1. C - D</li><li>no</li></ol>"), (3, "3. E - F\nother"), (4, None), (5, "")], "page_id int, html string")
    got = sorted((r.page_id, r.rank, r.artist_raw, r.title_raw, r.way) for r in sn.first_that_works(pages, "page_id").collect())
    assert got == [(1, 1, "A", "X & Y", 0), (1, 2, "B", "Z", 0), (2, 1, "C", "D", 1), (3, 3, "E", "F", 2)]


def test_snapshot_sink_replaces_one_period(spark, tmp_path):
    entries = spark.createDataFrame(RUNS, ENTRY)
    sn.write_snapshots(entries, f"{tmp_path}/s")
    sn.write_snapshots(entries.filter("period = '2024' and rank = 1"), f"{tmp_path}/s")
    assert {(r.period, r["count"]) for r in spark.read.parquet(f"{tmp_path}/s").groupBy("period").count().collect()} == {(2023, 4), (2024, 1)}


def test_stream(spark, tmp_path):
    """Entries, songs and links of all batches, and what a job from all rows at once makes of them."""
    source, tables = f"{tmp_path}/in", CommittedTables(spark, f"{tmp_path}/tables")
    spark.createDataFrame(RUNS, ENTRY).coalesce(1).write.json(source)
    ingest_stream(spark, source, tables, f"{tmp_path}/cp").awaitTermination()
    later = [("c", "2024", 4, "The Beatles", "Let It Be"), ("c", "2024", 5, "New", "Song (Live)"), ("c", "2024", 6, "X", "Song (Karaoke Version)")]
    spark.createDataFrame(later, ENTRY).coalesce(1).write.mode("append").json(source)
    ingest_stream(spark, source, tables, f"{tmp_path}/cp").awaitTermination()
    got = {(r.period, r.rank): r.title_raw for r in tables.current("entries").collect()}
    assert len(got) == 10 and got["2024", 4] == "Let It Be" and got["2024", 5] == "Song (Live)"
    entries = tables.current("entries")
    linked = {tuple(r) for r in ig.link_entries(entries).select("entry_id", "song_id").collect()}
    assert {tuple(r) for r in tables.current("links").select("entry_id", "song_id").collect()} >= linked and len(linked) == 9
    songs = tables.current("songs")
    assert songs.count() == songs.select("song_id").distinct().count() and {s for _, s in linked} <= {r.song_id for r in songs.collect()}


TWO = {"t": Table("k string, v int, chart_id string, period string", ("k", "chart_id", "period"), ("chart_id", "period")), "u": Table("k string, n int, b int", ("k",), ("b",))}


def test_commits_change_touched_parts_only(spark, tmp_path):
    tables = CommittedTables(spark, f"{tmp_path}/t", TWO)
    rows = lambda *r: spark.createDataFrame(list(r), TWO["t"].schema)
    other = lambda *r: spark.createDataFrame(list(r), TWO["u"].schema)
    assert tables.commit({"t": rows(("a", 1, "c", "01"), ("b", 2, "c", "02"), ("d", 3, "e", "01")), "u": other(("x", 1, 0))}, 0)
    files = lambda: {str(f) for f in tmp_path.rglob("*.parquet")}
    before = files()
    assert tables.commit({"t": rows(("a", 5, "c", "01"), ("z", 6, "c", "01")), "u": other(("x", 2, 0), ("y", 3, 1))}, 1)
    want = [("a", 5, "c", "01"), ("b", 2, "c", "02"), ("d", 3, "e", "01"), ("z", 6, "c", "01")]
    assert sorted(map(tuple, tables.current("t").collect())) == want and before <= files()
    # The same batch again, and an earlier one: nothing changes.
    assert not tables.commit({"t": rows(("a", 9, "c", "01"))}, 1) and not tables.commit({"t": rows(("a", 9, "c", "01"))}, 0)
    assert sorted(map(tuple, tables.current("t").collect())) == want
    # What no kept version names goes, so that folders don't grow with the number of batches.
    for n in range(2, 9):
        tables.commit({"t": rows(("a", n, "c", "01"))}, n)
    assert len(files()) <= 9 and len(tables.manifests()) == 2 and sorted(map(tuple, tables.current("u").collect())) == [("x", 2, 0), ("y", 3, 1)]
    assert tables.commit({"t": rows()}, 9) and tables.current("t").count() == 4


def test_null_and_empty_partition_values(spark, tmp_path):
    tables = CommittedTables(spark, f"{tmp_path}/t")
    for n, rank in enumerate((1, 2)):
        batch = spark.createDataFrame([(c, p, rank, "A", f"T{rank}") for c in ("", None, "x") for p in ("", None, "2024")], ENTRY)
        tables.commit(chart_tables(batch), n, "s")
    got = [(r.chart_id, r.period, r["rank"]) for r in tables.current("entries").collect()]
    assert sorted(got, key=str) == sorted([(c, p, k) for c in ("", None, "x") for p in ("", None, "2024") for k in (1, 2)], key=str)
    assert tables.current("links").count() == 18 and tables.current("songs").count() == 2


def test_failed_batches_leave_the_tables(spark, tmp_path):
    """A batch that fails between two tables, and a manifest that was cut off, change nothing; the next attempt does, and clears what they left."""
    tables = CommittedTables(spark, f"{tmp_path}/t", TWO)
    rows, other = (lambda v: spark.createDataFrame([("a", v, "c", "01")], TWO["t"].schema)), (lambda n: spark.createDataFrame([("x", n, 0)], TWO["u"].schema))
    tables.commit({"t": rows(1), "u": other(1)}, 0)
    bad = other(2).withColumn("n", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        tables.commit({"t": rows(2), "u": bad}, 1)
    (tmp_path / "t/log/000000000002-cut.json").write_text('{"version": 2, "bat')
    assert [r.v for r in tables.current("t").collect()] == [1] and [r.n for r in tables.current("u").collect()] == [1]
    assert tables.commit({"t": rows(2), "u": other(2)}, 1)
    assert [r.v for r in tables.current("t").collect()] == [2] and [r.n for r in tables.current("u").collect()] == [2]
    assert len(list(tmp_path.rglob("*.parquet"))) == 4


def test_table_layout_is_the_pages(spark):
    """Four columns if the first row with data has four or the year is late enough, for the page as a whole."""
    four = "<table><tr><th>#</th><th>was</th></tr><tr><td>1</td><td>(3)</td><td>A</td><td>X</td></tr><tr><td>1.234</td><td>(-)</td><td>B</td><td>Z</td></tr><tr><td>3</td><td>C</td><td>W</td></tr></table>"
    three = "<table><tr><td>1</td><td>A</td><td>X</td></tr><tr><td>2</td><td>(1)</td><td>B</td><td>Z</td></tr></table>"
    pages = spark.createDataFrame([(1, four, 2009), (2, three, 2009), (3, three, 2012), (4, None, None)], "page_id int, html string, year int")
    got = sorted((r.page_id, r.rank, r.previous_position, r.artist_raw, r.title_raw) for r in sn.table_rows(pages, year="year").collect())
    assert got == [(1, 1, 3, "A", "X"), (1, 3, None, "C", "W"), (1, 1234, None, "B", "Z"), (2, 1, None, "A", "X"), (2, 2, None, "(1)", "B"), (3, 1, None, "A", "X"), (3, 2, 1, "B", "Z")]


def test_list_pages(spark):
    item = lambda *fields: "<li class='a list-item'>" + "".join(f'<span class="x {c}">{t}</span>' for c, t in fields) + "</li>"
    html = "<li>menu</li>" + item(("position", "1."), ("title", "<a href=x>T &amp; U</a>"), ("artist", " A "), ("lastweek", "vorige week: 5"), ("weken", "3 weken"))
    html += item(("position", "1.234"), ("title", "V"), ("artist", "B"), ("previous", "Nieuw"), ("weeks", "0")) + item(("position", "-"), ("title", "W"), ("artist", "C")) + item(("position", "4"), ("title", ""), ("artist", "D")) + item(("position", "5"), ("title", "Y"), ("artist", "E"))
    got = sorted(tuple(r) for r in sn.chart_items(spark.createDataFrame([(html,), (None,)], "html string")).select("rank", "artist_raw", "title_raw", "previous_position", "weeks_on_chart").collect())
    assert got == [(1, "A", "T & U", 5, 3), (5, "E", "Y", None, None), (1234, "B", "V", None, None)]


def test_redaction(spark):
    values = {"Authorization": "abcdefgh", "my_credential": "1234", "monkey": "banana", "author": "somebody", "TOKEN": "", "api_key": "12345"}
    got = spark.createDataFrame([(values,)], "m map<string,string>").select(nz.redact_secrets(F.col("m")).alias("m")).first().m
    assert got == {"Authorization": "abcd***", "my_credential": "***", "monkey": "banana", "author": "some***", "TOKEN": "***", "api_key": "1234***"}
    doc = {"a": {"client_secret": 'x"y"z12', "n": [{"Password": "1234", "kind": "password"}, "token"], "key": "k"}, "refresh_token": 12, "auth": None, "ab": "\\", "t": {"Token": "é\nabcd"}}
    text = spark.createDataFrame([(json.dumps(doc),)], "j string").select(nz.redact_json(F.col("j")).alias("j")).first().j
    assert json.loads(text) == {"a": {"client_secret": 'x"y"***', "n": [{"Password": "***", "kind": "password"}, "token"], "key": "k"}, "refresh_token": 12, "auth": None, "ab": "\\", "t": {"Token": "é\nab***"}}


def test_batch_keeps_errors_apart(spark):
    from chartloom.operators import resolution as rs

    rows = [("e1", "g1", "Album", False, "1999"), ("e2", "g2", "Album", False, "19x"), ("e3", None, "Album", False, None), ("e4", "g4", None, False, "2001-02-30"), ("e5", "g5", "Single", False, "2001-02-30")]
    candidates = spark.createDataFrame([(*r, "a", "t") for r in rows], "entity_id string, rg_mbid string, primary_type string, is_compilation boolean, first_release_date string, artist_mbid string, title string")
    releases = spark.createDataFrame([("l1", "g1", "1999", "NL", True, False)], "release_mbid string, rg_mbid string, date string, country string, is_official boolean, is_promo boolean")
    groups, artists = spark.createDataFrame([("g1", "a")], "rg_mbid string, artist_mbid string"), spark.createDataFrame([("a", "NL")], "artist_mbid string, country string")
    got = {r.entity_id: (r.crg, r.error) for r in rs.decide_batch(candidates, releases, groups, artists).collect()}
    assert got == {"e1": ("g1", None), "e2": (None, "date_not_readable"), "e3": (None, "candidate_without_release_group"), "e4": (None, "candidate_without_type"), "e5": (None, "date_not_readable")}
    with pytest.raises(Exception, match="e2"):
        rs.decide_batch(candidates.filter("entity_id < 'e3'"), releases, groups, artists, continue_on_error=False).collect()


def test_base_confidences(spark):
    from chartloom.operators import sources_score as sc

    a = spark.createDataFrame([("musicbase", "isrc", "X1"), ("musicbase", "text", None)], "origin string, match string, isrc string")
    b = spark.createDataFrame([("discbase", "barcode", 0.1), ("soundbase", "fingerprint", 0.42), ("discbase", "linked", None), ("other", "text", 0.9)], "origin string, match string, score double")
    got = sorted((r.source, r.confidence, r.isrc) for r in sc.source_union([a, b]).collect())
    assert got == [("discbase_barcode", 0.85, None), ("discbase_linked", 0.9, None), ("musicbase_isrc", 0.95, "X1"), ("musicbase_text", 0.7, None), ("other_text", None, None), ("soundbase_fingerprint", 0.42, None)]


def test_normalized_songs(spark):
    """Ways to write a name are one song: articles, guests, editions; karaoke is none."""
    from chartloom.operators import aggregates as agg

    names = [("The Beatles", "Help!"), ("Beatles", "Help! - Remastered 2009"), ("beatles feat. X", "Help! (Radio Edit)"), ("Beatles", "Help! (Karaoke Version)"), ("Queen", "Bohemian Rhapsody")]
    entries = spark.createDataFrame([(f"e{i}", "r", "c", i + 1, a, t) for i, (a, t) in enumerate(names)], "entry_id string, run_id string, chart_id string, rank int, artist_raw string, title_raw string")
    scores = {(r.artist_core, r.title_core): r.score for r in agg.entry_scores(entries).collect()}
    assert scores == {("beatles", "help!"): 5 + 4 + 3 + 2, ("queen", "bohemian rhapsody"): 1}
    links = {r.entry_id: r.song_id for r in ig.link_entries(entries).collect()}
    assert set(links) == {"e0", "e1", "e2", "e4"} and links["e0"] == links["e1"] == links["e2"] != links["e4"]
    none = spark.createDataFrame([], "song_id string, artist_canonical string, title_canonical string")
    songs = ig.new_songs(entries, none).collect()
    assert {r.song_id for r in songs} == set(links.values()) and ig.new_songs(entries, spark.createDataFrame(songs)).count() == 0
    aliased = ig.link_entries(entries, spark.createDataFrame([("Queen", "beatles")], "raw string, normalized string")).collect()
    assert {r.entry_id: r.link_method for r in aliased}["e4"] == "alias"


def test_one_action_completes_a_review(spark):
    from chartloom.operators import decisions as dc

    queue = spark.createDataFrame([("v1", "e1", "g1", "t1", None), ("v2", "e2", "g2", None, 5)], "review_id string, entity_id string, rg_mbid string, track_key string, reviewed_at int")
    actions = spark.createDataFrame([("v1", "skip", 20), ("v1", "accept", 10), ("v2", "accept", 10)], "review_id string, action string, at int")
    done, history, overrides = dc.complete_reviews(queue, actions)
    assert sorted((r.review_id, r.reviewed_at) for r in done.collect()) == [("v1", 10), ("v2", 5)]
    assert [tuple(r) for r in history.collect()] == [("v1", "accept", 10)] and [tuple(r) for r in overrides.collect()] == [("track", "t1", "g1")]


def test_marks_are_split_off_over_all_letters(spark):
    """Every letter that decomposes, Hangul and vowels of several letters among them, against the standard's decomposition."""
    letters = [chr(c) for c in range(0xC0, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFD", chr(c)) != chr(c) and chr(c) not in nz.LETTERS]
    words = ["".join(letters[i : i + 40]) for i in range(0, len(letters), 40)] + ["が ガ バ", "한국어 노래", "각 가 힣", "Việt Nam", "plain"]
    got = spark.createDataFrame([(w,) for w in words], "t string").select("t", nz.strip_diacritics(F.col("t")).alias("p")).collect()
    assert len(got) == len(words)
    for r in got:
        assert r.p == "".join(c for c in unicodedata.normalize("NFD", r.t) if unicodedata.category(c) != "Mn"), r.t


JSON = st.recursive(st.none() | st.booleans() | st.integers(-1000, 1000) | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["mbid", "a", "fetched_at", "provenance", "cache_age", "updated_at", "é"]), x, max_size=4), max_leaves=20)


@given(st.dictionaries(st.sampled_from(["recordings", "provenance", "artist", "created_at", "x"]), JSON, max_size=4), st.randoms())
@settings(max_examples=150, deadline=None)
def test_canonical_documents(document, rng):
    """Keys in any order and volatile fields added at any depth leave the text as it is; another value changes it."""

    def shuffled(value, add):
        if isinstance(value, dict):
            items = [(k, shuffled(v, add)) for k, v in value.items()]
            rng.shuffle(items)
            return dict(items) | ({"fetched_at": rng.random(), "fetched_at_utc": "x"} if add else {})
        return [shuffled(v, add) for v in value] if isinstance(value, list) else value

    for kind in KINDS:
        assert canonical_text(json.dumps(document), kind) == canonical_text(json.dumps(shuffled(document, False), indent=1), kind)
        assert canonical_text(json.dumps(document | {"x": [1]}), kind) != canonical_text(json.dumps(document | {"x": [2]}), kind)
    assert canonical_text(json.dumps(document), "drift") == canonical_text(json.dumps(shuffled(document, True)), "drift")
    sure = {"recordings": [{"mbid": "b"}, {"mbid": "a"}], "provenance": {"cache_age": 1, "cache_age_s": 2, "fetched_at_utc": 3}, "n": "é"}
    assert canonical_text(json.dumps(sure), "bundle") == '{"n":"\\u00e9","provenance":{"cache_age_s":2,"fetched_at_utc":3},"recordings":[{"mbid":"a"},{"mbid":"b"}]}'
    assert canonical_text(json.dumps(sure), "resolver") == '{"n":"\\u00e9","provenance":{"cache_age":1},"recordings":[{"mbid":"b"},{"mbid":"a"}]}'
    assert canonical_text("no json", "drift") is None and canonical_text(None, "drift") is None
