"""Catalogue rows of secondary sources, answers of a fingerprint service, searches by batch, bundles and tags: small cases and brute force."""

import json
import random

from chartloom.operators import catalogue as ct
from chartloom.operators import ingest as ig
from chartloom.operators import resolution as rs
from chartloom.operators import search
from chartloom.sources import snapshots as sn


def test_release_and_track_catalogue(spark):
    releases = spark.createDataFrame(
        [("1", "9", "Song (Live)", "Tom & Co", 1999, "NL"), ("2", None, "B", None, 0, None), ("2", None, "B", None, 0, None), ("3", "9", "Tail", "", None, None), (None, "8", "x", "y", 1, "z")],
        "release_id string, master_id string, title string, artist_name string, year int, country string",
    )
    t = ct.release_catalogue(releases, "disc")
    assert {r.artist_mbid: r.name for r in t["artist"].collect()} == {"disc-artist-tom-and-co": "Tom & Co", "disc-artist-unknown": "Unknown"}
    assert {r.release_mbid: (r.rg_mbid, r.date) for r in t["release"].collect()} == {"disc-release-1": ("disc-master-9", "1999"), "disc-release-2": (None, None), "disc-release-3": ("disc-master-9", None)}
    assert [(r.rg_mbid, r.title) for r in t["release_group"].collect()] == [("disc-master-9", "Tail")]
    assert {r.recording_mbid: r.title_normalized for r in t["recording"].collect()} == {"disc-recording-1": "song", "disc-recording-2": "b", "disc-recording-3": "tail"}
    assert t["recording_release"].count() == 3
    tracks = spark.createDataFrame(
        [("a", "p", "Album", "T", "X", 1000, "I1"), ("b", "q", "", "U", "X", None, ""), ("c", None, "No", "V", "X", 1, None)],
        "track_id string, album_id string, album_name string, title string, artist_name string, length_ms int, isrc string",
    )
    u = ct.track_catalogue(tracks, "stream")
    assert [(r.release_mbid, r.title, r.rg_mbid) for r in u["release"].collect()] == [("stream-album-p", "Album", "stream-album-p")]
    assert {(r.recording_mbid, r.release_mbid) for r in u["recording_release"].collect()} == {("stream-track-a", "stream-album-p"), ("stream-track-b", "stream-album-q")}
    assert {r.recording_mbid: r.isrcs for r in u["recording"].collect()} == {"stream-track-a": ["I1"], "stream-track-b": None, "stream-track-c": None}
    both = ct.with_secondary(t, u)
    assert {k: both[k].count() for k in both} == {"artist": 3, "recording": 6, "release_group": 2, "release": 4, "recording_release": 5}
    empty = ct.with_secondary(ct.release_catalogue(releases.limit(0), "disc"), ct.track_catalogue(tracks.limit(0), "stream"))
    assert all(df.count() == 0 for df in empty.values())


def test_fingerprint_documents(spark):
    answer = {"status": "ok", "results": [
        {"score": 0.6, "recordings": [{"id": "a", "duration": 100.0}, {"id": "b", "duration": 103.5}, {"duration": 100}, {"id": "c"}, {"id": "z", "duration": 0}]},
        {"score": 0.9, "recordings": [{"id": "d", "duration": 98.0}]}, {"score": 0.4, "recordings": [{"id": "e"}]}, {"recordings": [{"id": "f"}]}, {"score": 0.7},
    ]}
    docs = [("1", 100, json.dumps(answer)), ("2", 100, json.dumps({"status": "error", "error": {"message": "bad key"}})), ("3", 100, "{"), ("4", 100, None), ("5", None, json.dumps(answer)), ("6", 1, '{"status": "ok"}')]
    df = spark.createDataFrame(docs, "file_id string, file_duration int, json string")
    got = [(r.file_id, r.place, r.recording_mbid, r.score, r.duration_ms) for r in ct.fingerprint_hits(df).orderBy("file_id", "place").collect()]
    one = [(1, "d", 0.9, 98000), (2, "a", 0.6, 100000), (3, "c", 0.6, None), (4, "z", 0.6, 0)]
    assert [g[1:] for g in got if g[0] == "1"] == one
    assert [g[2] for g in got if g[0] == "5"] == ["d", "a", "b", "c", "z"]
    assert {g[0] for g in got} == {"1", "5"}
    assert {tuple(r) for r in ct.fingerprint_errors(df).collect()} == {("2", "bad key"), ("3", "Unknown error"), ("4", "Unknown error")}


def test_like_batch_against_all_pairs(spark):
    rng = random.Random(3)
    name = lambda n: "".join(rng.choice("abAB% _") for _ in range(n))
    rows = [(f"k{i}", name(rng.randrange(0, 9)), rng.choice(["Ab", "bb", None])) for i in range(200)] + [("k-none", None, "Ab")]
    queries = [(i, name(rng.randrange(0, 5)), rng.choice([None, "B", "a"])) for i in range(60)] + [(99, None, None)]
    got = search.like_batch(spark.createDataFrame(queries, "query_id int, text string, artist string"), spark.createDataFrame(rows, "key string, name string, artist_name string"), 5).collect()
    want = set()
    for q, text, artist in queries:
        hits = [] if text is None else [(n, k) for k, n, a in rows if n is not None and text.lower() in n.lower() and (artist is None or (a is not None and artist.lower() in a.lower()))]
        want |= {(q, k, n) for n, k in sorted(hits)[:5]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_hits(spark):
    entries = spark.createDataFrame([(1, "a", "t"), (2, "a", "u"), (3, None, "t"), (4, "a", "t")], "id int, artist string, title string")
    hits = spark.createDataFrame([("a", "t", "h2", "s", 0.9), ("a", "t", "h1", "r", 0.9), ("a", "t", "h0", "r", 0.5), ("a", "u", "h5", None, None), (None, "t", "h6", "r", 1.0)], "artist string, title string, hit_id string, source string, confidence double")
    got = {r.id: (r.hit_id, r.source, r.confidence, r.link_method) for r in ig.link_top_hits(entries, hits).collect()}
    assert got == {1: ("h1", "r", 0.9, "multi_source"), 2: ("h5", "unknown", 0.7, "multi_source"), 3: (None, None, 0.5, "title_artist_year"), 4: ("h1", "r", 0.9, "multi_source")}


def test_bundle_subjects(spark):
    schema = "entity_id string, rg_mbid string, primary_type string, is_compilation boolean, first_release_date string, artist_mbid string, title string, recording_mbid string"
    candidates = spark.createDataFrame([("e", "g2", "Album", False, None, "a1", "T2", "r1"), ("e", "g1", "Album", False, "1999", None, "T1", "r1"), ("e", "g3", "Album", False, "1999", "a2", "T3", "x"), ("f", "g1", "Album", False, "1999", "a9", "T1", None)], schema)
    releases = spark.createDataFrame([("l1", "g1", "1999", "NL", None)], "release_mbid string, rg_mbid string, date string, country string, is_official boolean")
    artists = spark.createDataFrame([("a1", "One", "NL"), ("a2", "Two", "BE")], "artist_mbid string, name string, country string")
    recordings = spark.createDataFrame([("r1", "Real", "a7", 1000, None)], "recording_mbid string, title string, artist_mbid string, length_ms int, isrcs array<string>")
    got = {r.entity_id: r for r in rs.evidence_bundle(candidates, releases, artists, recordings).collect()}
    assert tuple(got["e"].artist) == ("a1", "One", "NL") and got["f"].artist is None and got["f"].recordings is None
    assert [tuple(r) for r in got["e"].recordings] == [("r1", "Real", "a7", 1000, []), ("x", "T3", "a2", None, [])]
    assert [(g.rg_mbid, [(r.release_mbid, r.is_official) for r in g.releases]) for g in got["e"].rg_candidates] == [("g1", [("l1", True)]), ("g2", []), ("g3", [])]


def test_tags_hold_what_is_given(spark):
    decisions = spark.createDataFrame([("e", "g", "l", "decided"), ("f", "g", None, "indeterminate")], "entity_id string, crg string, rr string, state string")
    hashes = spark.createDataFrame([("e", "0123456789"), ("f", "x")], "entity_id string, evidence_hash string")
    bare = ig.decision_tags(decisions, hashes).collect()
    assert [(r.entity_id, r.tag, r.charts_blob, r.wikidata_qid) for r in bare] == [("e", "evh=01234567", None, None)]
    blobs, external = spark.createDataFrame([("e", "")], "entity_id string, charts_blob string"), spark.createDataFrame([("e", "Q1", "other")], "entity_id string, wikidata_qid string, tag string")
    full = ig.decision_tags(decisions, hashes, blobs, external).first()
    assert (full.tag, full.charts_blob, full.wikidata_qid, full.spotify_album_id) == ("evh=01234567", None, "Q1", None)


def test_playlist(spark):
    entries = spark.createDataFrame([("1", "run", 1, "r1", "A", "T"), ("2", "run", 2, None, "b", "u"), ("3", "run", 3, None, "C", "V")], "entry_id string, run_id string, rank int, recording_mbid string, artist string, title string")
    files = spark.createDataFrame([("f1", "r1", "x", "y", 200, "/p1"), ("f2", None, "B", "U", 0, "/p2"), ("f3", None, "B", "U", None, "/p3")], "file_id string, recording_mbid string, artist string, title string, seconds int, path string")
    got = [r.line for r in ig.playlist(entries, files).orderBy("rank", "part").collect()]
    assert got == ["#EXTINF:200,A - T", "/p1", "#EXTINF:-1,b - u", "/p2"]


def test_ranks_beyond_an_int_are_no_entries(spark):
    pages = spark.createDataFrame([(1, "99999999999. A - B\n2. C - D")], "page_id int, html string")
    assert [(r.rank, r.artist_raw, r.way) for r in sn.first_that_works(pages, "page_id").collect()] == [(2, "C", 2)]
