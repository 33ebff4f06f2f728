"""Fuzzy search against all pairs, on names with typing errors in artists and in short titles."""

import random

from chartloom.functions import similarity as sim
from chartloom.operators import search
from chartloom.operators.close_names import CloseNames
from chartloom.plans import registry

TITLES = ["love", "lave", "lov", "a", "b", "", "hello", "hallo", "yellow moon", "yelow mon", "mellow moon", "cold bolt", "old bolt", "new widget", "red widget", "song song", "gnos gnos"]
ARTISTS = ["brand#1", "brand#10", "brand#21", "abba", "aba", "abbas", "the doors", "doors", "teh doors", "x", "ünder", "under"]
QUERY, REC = "query_id string, artist string, title string, length_ms int", "recording_mbid string, artist_normalized string, title_normalized string, length_ms int"


def test_close_pairs(spark):
    draw = random.Random(3)
    names = sorted({*TITLES, *ARTISTS, *("".join(draw.choices("abcde f", k=draw.randint(0, 9))) for _ in range(150))})
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    for least in (50.0, 60.0, 70.0, 80.0):
        got = {(r["a"], r["b"]) for r in search.close_pairs(frame, frame, least).collect()}
        assert got == {(a, b) for a in names for b in names if sim.indel_ratio(a, b) >= least}


WORDS = "love night heart you the me my day time way baby man girl dance world home fire rain blue dream light moon sun river road song rock roll star sweet".split()


def test_close_pairs_prune(spark):
    """Names of two to four common words: all pairs that reach the threshold, from few rows, also where crowded keys grow longer."""
    draw, names = random.Random(7), set()
    while len(names) < 450:
        names.add(" ".join(draw.choice(WORDS) for _ in range(draw.randint(2, 4))))
    names = sorted(names | {"ab" * 60, "ba" * 60, "ab" * 59, "abba" * 31, "日本語の歌", "日本語の", "", "x"})
    frame = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string").repartition(4)
    want = {(a, b) for a in names for b in names if sim.indel_ratio(a, b) >= 80}
    for crowd in (1, 32):
        join = CloseNames(80.0, crowd)
        joined = [tuple(r) for r in join.candidates(frame, frame).collect()]
        assert len(joined) == len(set(joined)) < 0.05 * len(names) ** 2 and want <= set(joined)
        assert {(r.a, r.b) for r in join.pairs(frame, frame).collect()} == want
    few, none = frame.filter("n like 'a%'"), frame.limit(0)
    assert {(r.a, r.b) for r in CloseNames(60.0).pairs(few, frame).collect()} == {(a, b) for a in names if a[:1] == "a" for b in names if sim.indel_ratio(a, b) >= 60}
    assert CloseNames(80.0).pairs(none, frame).count() == 0 and CloseNames(80.0).pairs(frame, none).count() == 0


def test_similar(spark):
    names = [(a, t) for a in ARTISTS for t in TITLES]
    asked = [(f"q{i}", a, t, None) for i, (a, t) in enumerate(names)]
    recs = [(f"r{i}", a, t, 1) for i, (a, t) in enumerate(names)]
    for title, artist in ((80.0, 80.0), (70.0, 60.0), (70.0, 50.0)):
        got = search.similar(spark.createDataFrame(asked, QUERY), spark.createDataFrame(recs, REC), title, artist, limit=10**6).collect()
        want = [(q, r) for q, a, t, _ in asked for r, b, u, _ in recs if sim.indel_ratio(t, u) >= title and sim.indel_ratio(a, b) >= artist]
        assert sorted((r["query_id"], r["recording_mbid"]) for r in got) == sorted(want)


def brute_token_set(a, b):
    """From the published formula, with the plain ratio of texts."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not left or not right):
        return 100.0
    with_left, with_right = (common + " " + left).strip(), (common + " " + right).strip()
    if not common:
        return sim.indel_ratio(left, right)
    joint = len(common) + 1
    sizes = 2 * joint + len(left) + len(right)
    best = 100 * (1 - (len(left) + len(right) - 2 * sim.lcs_length(left, right)) / sizes)
    return max(best, sim.indel_ratio(common, with_left), sim.indel_ratio(common, with_right))


def test_token_set_ratio(spark):
    from pyspark.sql import functions as F

    words = ["a b", "b a", "a b c", "", "  ", "c", "yellow moon", "moon yellow", "yelow moon", "yesterday", "yesterday (remastered)", "a a b", "new widget x", "red widget"]
    pairs = [(a, b) for a in words for b in words] + [(None, "a"), ("a", None)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sim.token_set_ratio(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        assert (r.s is None) if r.a is None or r.b is None else abs(r.s - brute_token_set(r.a, r.b)) < 1e-9, r


def test_short_queries(spark):
    """Queries of no, one and two characters, and of characters that mean something in patterns."""
    titles = ["go now", "now go", "g", "", "a_b", "100%", "o"]
    asked = [(f"q{i}", "ab", t, None) for i, t in enumerate(["", "g", "go", " ", "_", "%", "now", "go now!"])]
    recs = [(f"r{i}", "abba", t, 1) for i, t in enumerate(titles)]
    got = search.containing(spark.createDataFrame(asked, QUERY), spark.createDataFrame(recs, REC)).collect()
    assert sorted(map(tuple, got)) == sorted((q, r) for q, _, t, _ in asked for r, _, u, _ in recs if t in u)


def test_misspelt_artist(spark):
    """The second tier finds an artist with a typing error, in the length that is asked."""
    asked = [("q", "beetles", "yesterday", 100_000)]
    recs = [("near", "beatles", "yesterday", 109_000), ("far", "beatles", "yesterday", 111_000), ("other", "u2", "yesterday", 100_000)]
    got = search.search_fuzzy(spark.createDataFrame(asked, QUERY), spark.createDataFrame(recs, REC)).collect()
    assert [(r.recording_mbid, r.tier) for r in got] == [("near", 2)] and abs(got[0].score - 200 * 6 / 14) < 1e-9


def test_search_stages(spark):
    asked = [("q", "abba", "cold bolt", 100_000), ("w", "abba", "bolt cold", None), ("z", "nobody", "nothing", None)]
    recs = [("r", "abba", "cold bolt", 105_000), ("s", "abba", "cold bolt", 115_000), ("t", "abba", "cold bolts", 300_000), ("u", "other", "cold bolt", 100_000), ("v", "guest", "old bolt cold", 1)]
    artists, groups = [("a1", "ABBA"), ("a2", "Abbadon")], [("a1", "g1"), ("a2", "g2")]
    tracks = [("g1", r, t) for r, _, t, _ in recs if r in "rstv"] + [("g2", "u", "cold bolt")]
    frame = spark.createDataFrame
    browse = (frame(artists, "artist_mbid string, name string"), frame(groups, "artist_mbid string, rg_mbid string"), frame(tracks, "rg_mbid string, recording_mbid string, title_normalized string"))
    heard = frame([("q", "x"), ("z", "y"), ("w", "r")], "query_id string, recording_mbid string")
    got = search.search_stages(frame(asked, QUERY), frame(recs, REC), browse, heard).collect()
    assert {(r.query_id, r.recording_mbid): r.stage for r in got} == {
        ("q", "r"): 1, ("q", "s"): 2, ("q", "t"): 3, ("q", "v"): 3, ("q", "u"): 3,
        ("w", "r"): 3, ("w", "s"): 3, ("w", "t"): 3, ("w", "v"): 3, ("w", "u"): 3, ("z", "y"): 4,
    }


def test_song_lookup(spark):
    songs = [(f"s{i:03}", a, t) for i, (a, t) in enumerate((a, t) for a in ARTISTS for t in TITLES if t not in ("love", "hello"))]
    asked = [(f"q{i}", a, t, None) for i, (a, t) in enumerate((a, t) for a in ARTISTS for t in ("love", "hello", "wellow moon", "c", "bolt"))]
    got = search.song_lookup(spark.createDataFrame(asked, QUERY), spark.createDataFrame(songs, "song_id string, artist_canonical string, title_canonical string")).collect()
    want = {}
    for q, a, t, _ in asked:
        scores = [(-round(0.4 * sim.indel_ratio(a, b) / 100 + 0.6 * sim.indel_ratio(t, u) / 100, 6), s) for s, b, u in songs]
        if -min(scores)[0] >= 0.7:
            want[q] = min(scores)[1]
    assert {r["query_id"]: r["song_id"] for r in got} == want


def test_fuzzy_match(spark):
    sf = "/root/testdata/sf0.001"
    names = {r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").collect()}
    got = registry.queries()["fuzzy_match"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a in names for b in names if sim.indel_ratio(a, b) >= 80)
    assert any(a[0] != b[0] for a, b in got)


def test_stage_summary(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["stage"]: r["n"] for r in registry.queries()["stage_summary"](spark, sf).collect()}
    found = {r["stage"]: r["count"] for r in registry.queries()["search_stages"](spark, sf).groupBy("stage").count().collect()}
    assert got == {s: found.get(s, 0) for s in (1, 2, 3, 4)} and got[2] > 0


def test_artist_browse(spark):
    """Against every artist whose name contains the query's, its groups and their recordings."""
    artists = [(f"a{i}", n.title()) for i, n in enumerate(ARTISTS)]
    groups = [(f"a{i}", f"g{(i * k) % 7}") for i in range(len(ARTISTS)) for k in (1, 2)]
    tracks = [(f"g{i % 7}", f"r{i}", t) for i, t in enumerate(TITLES * 2)]
    asked = [(f"q{i}", a, t, None) for i, (a, t) in enumerate((a, t) for a in (*ARTISTS, "brand", "zz") for t in TITLES)]
    frame = spark.createDataFrame
    got = search.artist_browse(frame(asked, QUERY), frame(artists, "artist_mbid string, name string"), frame(groups, "artist_mbid string, rg_mbid string"), frame(tracks, "rg_mbid string, recording_mbid string, title_normalized string"))
    want = set()
    for q, a, t, _ in asked:
        named = sorted((n, i) for i, n in artists if a in n.lower())[:5]
        of = {g for n, i in named if brute_token_set(a, n.lower()) >= 60 for j, g in groups if j == i}
        want |= {(q, r) for g, r, u in tracks if g in of and brute_token_set(t, u) >= 70}
    assert {(r.query_id, r.recording_mbid) for r in got.collect()} == want and want
    raw = frame([("q", "nothing", "love", None, "The Doors")], QUERY + ", artist_raw string")
    assert search.artist_browse(raw, frame(artists, "artist_mbid string, name string"), frame(groups, "artist_mbid string, rg_mbid string"), frame(tracks, "rg_mbid string, recording_mbid string, title_normalized string")).count() == 0
