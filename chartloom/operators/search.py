"""Fuzzy search of many queries at once: blocking first, similarity only within blocks.

Queries are rows (query_id, artist, title, length_ms), normalized; recordings are rows (recording_mbid, artist_normalized, title_normalized,
length_ms). No plan compares all with all: a text that contains a query holds the query's rarest trigram, and names whose ratio
reaches a threshold meet at keys of their rarest characters (close_names.py), so that both joins find all matches.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import similarity as sim
from chartloom.operators.close_names import CloseNames
from chartloom.sources.shared import materialize


def like(rows: DataFrame, column: str, text: str, key: str, limit: int = 10) -> DataFrame:
    """Rows whose column contains a text in any case, the first ones by name and key."""
    return rows.filter(F.contains(F.lower(column), F.lit(text.lower()))).orderBy(column, key).limit(limit)


def like_batch(queries: DataFrame, rows: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, key, name): for each query the rows whose name contains its text in any case, the first `limit` by name and key.

    queries: (query_id, text); rows: (key, name). If queries have an `artist` and rows an `artist_name`, that must be contained too; a null artist asks for nothing. Names are
    searched once for each distinct text, at its rarest trigram, so many queries are one job, and equal queries one search. Of rows alike in name and artist only the
    first `limit` by key can be among a query's.
    """
    by_artist = "artist" in queries.columns and "artist_name" in rows.columns
    asked = queries.select("query_id", F.lower("text").alias("_a"), (F.lower("artist") if by_artist else F.lit(None).cast("string")).alias("_by")).filter("_a is not null")
    wanted = asked.select("_a", "_by").distinct()
    named = rows.filter("name is not null").select("key", "name", F.lower("name").alias("_b"), (F.lower("artist_name") if by_artist else F.lit(None).cast("string")).alias("_artist"))
    pairs = containing_texts(wanted.select("_a"), named.select("_b")).toDF("_a", "_b")
    hits = wanted.join(pairs, "_a").join(dedupe_to(named, ["name", "_artist"], ["key"], limit), "_b").filter(F.col("_by").isNull() | F.contains("_artist", "_by"))
    first = dedupe_to(hits, ["_a", "_by"], ["name", "key"], limit).select(F.col("_a").alias("_text"), F.col("_by").alias("_of"), "key", "name")
    return asked.join(first, (F.col("_a") == F.col("_text")) & F.col("_by").eqNullSafe(F.col("_of"))).select("query_id", "key", "name")


def length_fits(asked: Column, length: Column, tolerance: float) -> Column:
    """Within a share of the asked length, bounds cut to whole numbers; no length asked fits all, an unknown one never does."""
    return asked.isNull() | length.between((asked * (1 - tolerance)).cast("int"), (asked * (1 + tolerance)).cast("int"))


def exact_names(queries: DataFrame, recordings: DataFrame) -> DataFrame:
    """(query_id, recording_mbid): recordings of the query's title whose artist contains the query's."""
    hits = queries.select("query_id", "artist", "title").join(recordings.withColumnRenamed("title_normalized", "title"), "title")
    return hits.filter(F.contains("artist_normalized", "artist")).select("query_id", "recording_mbid")


def loose_names(queries: DataFrame, recordings: DataFrame, limit: int = 25) -> DataFrame:
    """(query_id, recording_mbid): recordings whose title and artist contain the query's, the first `limit` of each query by id; names are compared once for
    each distinct pair of titles."""
    titles = containing_texts(queries.select("title"), recordings.select("title_normalized")).toDF("title", "title_normalized")
    hits = queries.select("query_id", "artist", "title").join(titles, "title").join(recordings, "title_normalized").filter(F.contains("artist_normalized", "artist"))
    return dedupe_to(hits, "query_id", ["recording_mbid"], limit).select("query_id", "recording_mbid")


def by_title_and_length(queries: DataFrame, recordings: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(query_id, recording_mbid): recordings of the query's title and of a fitting length."""
    hits = queries.join(recordings.select("recording_mbid", F.col("title_normalized").alias("title"), F.col("length_ms").alias("rec_ms")), "title")
    return hits.filter(length_fits(F.col("length_ms"), F.col("rec_ms"), tolerance)).select("query_id", "recording_mbid")


def containing_texts(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): all pairs of a text a of asked and a text b of texts that contains it; both have one column.

    They meet at one piece of a: its trigram that the fewest texts hold, or itself if it is shorter.
    """
    pieces = F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("b"))), lambda i: F.array(*[F.substr("b", i, F.lit(n)) for n in (1, 2, 3)])))))
    right = texts.toDF("b").distinct().withColumn("_t", F.explode(pieces))
    held = right.groupBy("_t").agg(F.count("*").alias("_n"))
    grams = F.when(F.length("a") < 3, F.array("a")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("a") - 2)), lambda i: F.substr("a", i, F.lit(3))))
    rarest = asked.toDF("a").distinct().withColumn("_t", F.explode(grams)).join(held, "_t").groupBy("a").agg(F.min_by("_t", F.struct("_n", "_t")).alias("_t"))
    return rarest.join(right, "_t").filter(F.contains("b", "a")).select("a", "b")


class NameMatches:
    """Pairs of distinct names of queries and recordings, each kind made when it is first asked for, so that several searches compare them once."""

    def __init__(self, queries: DataFrame, recordings: DataFrame, title_at_least: float = 80.0, artist_at_least: float = 80.0):
        self.queries, self.recordings, self.at_least = queries, recordings, (title_at_least, artist_at_least)

    @cached_property
    def contained(self) -> DataFrame:
        return materialize(containing_texts(self.queries.select("title"), self.recordings.select("title_normalized")).toDF("title", "title_normalized"))

    @cached_property
    def titles(self) -> DataFrame:
        return materialize(close_pairs(self.queries.select("title"), self.recordings.select("title_normalized"), self.at_least[0]).toDF("title", "title_normalized", "_r"))

    @cached_property
    def artists(self) -> DataFrame:
        return materialize(close_pairs(self.queries.select("artist"), self.recordings.select("artist_normalized"), self.at_least[1]).toDF("artist", "artist_normalized", "_a"))


def containing(queries: DataFrame, recordings: DataFrame, tolerance: float = 0.1, limit: int = 50, matches: NameMatches | None = None) -> DataFrame:
    """(query_id, recording_mbid): recordings whose title and artist contain the query's, of a fitting length; the first by id."""
    titles, names = (matches or NameMatches(queries, recordings)).contained, recordings.select("artist_normalized", "title_normalized").distinct()
    # Names meet first, so that no recording of another artist is paired with a query.
    named = queries.select("artist", "title").distinct().join(titles, "title").join(names, "title_normalized").filter(F.contains("artist_normalized", "artist"))
    hits = queries.join(named, ["artist", "title"]).join(recordings.withColumnRenamed("length_ms", "rec_ms"), ["artist_normalized", "title_normalized"]).filter(length_fits(F.col("length_ms"), F.col("rec_ms"), tolerance))
    return dedupe_to(hits, "query_id", ["recording_mbid"], limit).select("query_id", "recording_mbid")


def dedupe_to(hits: DataFrame, by: str | list[str], order: list, limit: int) -> DataFrame:
    """The first `limit` rows of each group."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")


def close_pairs(left: DataFrame, right: DataFrame, at_least: float) -> DataFrame:
    """(a, b, ratio): all pairs of a name a of left and a name b of right whose ratio is at_least or more; both have one column."""
    return CloseNames(at_least).pairs(left, right)


def similar(queries: DataFrame, recordings: DataFrame, title_at_least: float = 80.0, artist_at_least: float = 80.0, limit: int = 50, tolerance: float | None = None, matches: NameMatches | None = None) -> DataFrame:
    """(query_id, recording_mbid, score): the smaller of both ratios, best first; with a tolerance, only of a fitting length.

    Names are compared once for each distinct pair.
    """
    matches = matches or NameMatches(queries, recordings, title_at_least, artist_at_least)
    titles, artists = matches.titles.filter(F.col("_r") >= title_at_least), matches.artists.filter(F.col("_a") >= artist_at_least)
    names = recordings.select("artist_normalized", "title_normalized").distinct()
    scored = queries.select("artist", "title").distinct().join(titles, "title").join(names, "title_normalized").join(artists, ["artist", "artist_normalized"])
    scored = scored.select("artist", "title", "artist_normalized", "title_normalized", F.least("_a", "_r").alias("score"))
    hits = queries.join(scored, ["artist", "title"]).join(recordings.withColumnRenamed("length_ms", "rec_ms"), ["artist_normalized", "title_normalized"])
    if tolerance is not None:
        hits = hits.filter(length_fits(F.col("length_ms"), F.col("rec_ms"), tolerance))
    return dedupe_to(hits, "query_id", [F.desc("score"), "recording_mbid"], limit).select("query_id", "recording_mbid", "score")


def search_fuzzy(queries: DataFrame, recordings: DataFrame, tolerance: float = 0.1, limit: int = 50, matches: NameMatches | None = None) -> DataFrame:
    """(query_id, recording_mbid, score, tier): recordings that contain the query; for queries without any, similar ones with a score of 80 or
    more. Both tiers keep to the length that is asked, if one is.
    """
    matches = matches or NameMatches(queries, recordings)
    first = containing(queries, recordings, tolerance, limit, matches)
    rest = queries.join(first.select("query_id").distinct(), "query_id", "left_anti")
    second = similar(rest, recordings, limit=limit, tolerance=tolerance, matches=matches)
    return first.withColumns({"score": F.lit(100.0), "tier": F.lit(1)}).unionByName(second.withColumn("tier", F.lit(2)))


def dedupe_first(hits: DataFrame, by: list[str], order: list) -> DataFrame:
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def search_stages(queries: DataFrame, recordings: DataFrame, browse: tuple[DataFrame, DataFrame, DataFrame] | None = None, fingerprints: DataFrame | None = None, enough: int = 5) -> DataFrame:
    """(query_id, recording_mbid, stage): stages add up until a query has enough distinct recordings; the first stage of a recording wins.

    Stage 1 is search_fuzzy at +-10% length, stage 2 at +-20% for word sets that are alike (title 70, artist 60), stage 3 browses
    the catalogue of the artist (artists, groups and their recordings, see artist_browse), stage 4 takes the recordings that fingerprints
    (query_id, recording_mbid) name. Each later stage runs only for the queries that still lack results.
    """
    queries = materialize(queries)
    matches = NameMatches(queries, recordings)
    found = materialize(search_fuzzy(queries, recordings, 0.1, 100, matches).select("query_id", "recording_mbid", F.lit(1).alias("stage")))

    def lacking() -> DataFrame:
        counts = found.groupBy("query_id").agg(F.count_distinct("recording_mbid").alias("n"))
        return queries.join(counts.filter(F.col("n") >= enough), "query_id", "left_anti")

    names = recordings.select("recording_mbid", "artist_normalized", "title_normalized")
    wider = search_fuzzy(lacking(), recordings, 0.2, 100, matches).join(queries.select("query_id", "artist", "title"), "query_id").join(names, "recording_mbid")
    close = (alike(F.col("title"), F.col("title_normalized"), 70.0)) & (alike(F.col("artist"), F.col("artist_normalized"), 60.0))
    found = materialize(found.unionByName(wider.filter(close).select("query_id", "recording_mbid", F.lit(2).alias("stage"))))
    if browse is not None:
        found = materialize(found.unionByName(artist_browse(lacking(), *browse).select("query_id", "recording_mbid", F.lit(3).alias("stage"))))
    if fingerprints is not None:
        found = found.unionByName(fingerprints.join(lacking().select("query_id"), "query_id", "left_semi").select("query_id", "recording_mbid", F.lit(4).alias("stage")))
    return dedupe_first(found, ["query_id", "recording_mbid"], ["stage"])


def alike(a: Column, b: Column, at_least: float) -> Column:
    return sim.token_set_ratio(a, b) >= at_least


def stage_summary(hits: DataFrame, stages: DataFrame) -> DataFrame:
    """Results of each stage, with zero where there are none."""
    return stages.join(hits.groupBy("stage").agg(F.count("*").alias("n")), "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


def song_lookup(queries: DataFrame, songs: DataFrame, least: float = 0.7) -> DataFrame:
    """(query_id, song_id, score): the song of exactly these names, else the best of 0.4 artist + 0.6 title, if that is enough.

    Where the sum reaches `least`, the title or the artist does so alone. So songs come from titles that reach it and, for lower titles, from
    artists that do; there, a pair is compared only if the title that the lengths allow, below `least`, and the known artist can reach the sum. No names are joined at a
    lower threshold.
    """
    exact = queries.join(songs.select(F.col("artist_canonical").alias("artist"), F.col("title_canonical").alias("title"), "song_id"), ["artist", "title"])
    rest = materialize(queries.join(exact.select("query_id"), "query_id", "left_anti").select("query_id", "artist", "title"))
    at, named = 100 * least - 1e-3, ["query_id", "artist", "title", "song_id", "artist_canonical", "title_canonical"]
    titles = close_pairs(rest.select("title"), songs.select("title_canonical"), at).toDF("title", "title_canonical", "_r")
    by_title = rest.join(titles, "title").join(songs, "title_canonical").select(*named, "_r")
    ratios = by_title.select("artist", "artist_canonical").distinct().withColumn("_a", sim.ratio("artist", "artist_canonical"))
    by_title = by_title.join(ratios, ["artist", "artist_canonical"]).select(*named, "_a", "_r")
    artists = close_pairs(rest.select("artist"), songs.select("artist_canonical"), at).toDF("artist", "artist_canonical", "_a")
    both = F.length("title") + F.length("title_canonical")
    possible = F.when(both == 0, 100.0).otherwise(200.0 * F.least(F.length("title"), F.length("title_canonical")) / both)
    pairs = rest.join(artists, "artist").join(songs, "artist_canonical").filter(0.4 * F.col("_a") + 0.6 * F.least(possible, F.lit(at)) >= at)
    lower = pairs.select("title", "title_canonical").distinct().withColumn("_r", sim.ratio("title", "title_canonical")).filter(F.col("_r") < at)
    by_artist = pairs.join(lower, ["title", "title_canonical"]).select(*named, "_a", "_r")
    scored = by_title.unionByName(by_artist).withColumn("score", F.round(0.4 * F.col("_a") / 100 + 0.6 * F.col("_r") / 100, 6)).filter(F.col("score") >= least)
    best = dedupe_first(scored, ["query_id"], [F.desc("score"), "song_id"])
    return exact.select("query_id", "song_id", F.lit(1.0).alias("score")).unionByName(best.select("query_id", "song_id", "score"))


def artist_browse(queries: DataFrame, artists: DataFrame, groups: DataFrame, tracks: DataFrame, title_at_least: float = 70.0, artist_at_least: float = 60.0, n_artists: int = 5, limit: int = 100) -> DataFrame:
    """(query_id, recording_mbid, title_normalized, title_score): recordings in the release groups of artists whose name contains the query's and is alike, if
    their title is alike too; the first by id.

    artists (artist_mbid, name), groups (artist_mbid, rg_mbid), tracks (rg_mbid, recording_mbid, title_normalized). Of each query the first n_artists artists by name
    count; a query with a column artist_raw is looked up by that where its artist finds none.
    """
    names = artists.select("artist_mbid", "name", F.lower("name").alias("name_lower"))

    def named(asked: DataFrame, column: str) -> DataFrame:
        texts = containing_texts(asked.select(F.lower(column)), names.select("name_lower")).toDF("_asked", "name_lower")
        hits = asked.join(texts, F.lower(column) == F.col("_asked")).join(names, "name_lower")
        return dedupe_to(hits, "query_id", ["name", "artist_mbid"], n_artists).select("query_id", "artist", "title", "artist_mbid", "name_lower")

    known = named(queries, "artist")
    if "artist_raw" in queries.columns:
        known = materialize(known)
        known = known.unionByName(named(queries.join(known.select("query_id"), "query_id", "left_anti"), "artist_raw"))
    chosen = known.filter(alike(F.col("artist"), F.col("name_lower"), artist_at_least))
    # A title that is asked of an artist is looked up once, by that artist's distinct titles; of the tracks of an artist and title only the first `limit` by id can be among a query's.
    shelf = groups.select("artist_mbid", "rg_mbid").join(tracks.select("rg_mbid", "recording_mbid", "title_normalized"), "rg_mbid").select("artist_mbid", "title_normalized", "recording_mbid").distinct()
    shelf = materialize(dedupe_to(shelf, ["artist_mbid", "title_normalized"], ["recording_mbid"], limit))
    chosen = materialize(chosen.select("query_id", "title", "artist_mbid").distinct())
    asked = chosen.select("artist_mbid", "title").distinct().join(shelf.select("artist_mbid", "title_normalized").distinct(), "artist_mbid")
    pairs = asked.select("title", "title_normalized").distinct().withColumn("title_score", F.round(sim.token_set_ratio(F.col("title"), F.col("title_normalized")), 6))
    found = asked.join(pairs.filter(F.col("title_score") >= title_at_least), ["title", "title_normalized"]).join(shelf, ["artist_mbid", "title_normalized"])
    order = ["recording_mbid", "title_normalized"]
    found = dedupe_to(found, ["artist_mbid", "title"], order, limit)
    kept = chosen.join(found, ["artist_mbid", "title"]).select("query_id", "recording_mbid", "title_normalized", "title_score").distinct()
    return dedupe_to(kept, "query_id", order, limit).select("query_id", "recording_mbid", "title_normalized", "title_score")
