"""Confidence of search hits that several sources give for one song.

The steps run in a fixed order, as each caps what the ones before left. All of them part hits by the same key (artist, title).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.sources.shared import materialize

TOP = 0.99
#: Popularity from which a tier begins, and what it adds.
TIERS = [(70, "very_popular", 0.05), (50, "popular", 0.03), (30, "moderate", 0.01)]
#: Base confidence by source and by what was matched. A fingerprint's is its score.
BASE = {
    ("musicbase", "isrc"): 0.95,
    ("streambase", "isrc"): 0.90,
    ("discbase", "linked"): 0.90,
    ("discbase", "barcode"): 0.85,
    ("musicbase", "text"): 0.70,
    ("streambase", "text"): 0.68,
    ("discbase", "text"): 0.65,
}
#: Endings that don't tell labels apart.
LABEL_ENDINGS = [" records", " music", " entertainment", " inc.", " ltd."]


def source_union(hits: list[DataFrame]) -> DataFrame:
    """Hits of all sources in one table, missing columns null, with a column source (source_match) and the base confidence.

    Each table has origin, match (isrc, linked, barcode, text or fingerprint) and, for fingerprints, score. A pair that isn't known has no confidence.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), hits)
    base = F.coalesce(*[F.when((F.col("origin") == o) & (F.col("match") == m), F.lit(c)) for (o, m), c in BASE.items()])
    score = F.col("score") if "score" in rows.columns else F.lit(None)
    confidence = F.when(F.col("match") == "fingerprint", score.cast("double")).otherwise(base)
    return rows.withColumns({"source": F.concat_ws("_", "origin", "match"), "confidence": confidence})


def song_key() -> Column:
    return F.concat_ws("|", F.lower(F.trim(F.coalesce("artist_name", F.lit("")))), F.lower(F.trim(F.coalesce("title", F.lit("")))))


def _raise(by: float) -> Column:
    return F.least(F.lit(TOP), F.col("confidence") + by)


def popularity_boost(hits: DataFrame) -> DataFrame:
    tier, confidence = F, F
    for least, name, by in TIERS:
        reached = F.col("popularity") >= least
        tier, confidence = tier.when(reached, F.lit(name)), confidence.when(reached, _raise(by))
    return hits.withColumns({"tier": tier, "confidence": confidence.otherwise(F.col("confidence"))})


def _label() -> Column:
    label = F.lower("label")
    for ending in LABEL_ENDINGS:
        label = F.replace(label, F.lit(ending), F.lit(""))
    return F.trim(label)


def song_facts(hits: DataFrame) -> DataFrame:
    """One row per song: number of hits, first and last year, sources, and whether two sources or more have labels and agree on them.

    Everything is added up where the hits are read before it is shuffled. Hits without artist and title are no song. Of a source the last hit's label counts.
    """
    year = F.regexp_extract(F.col("year"), r"^([0-9]+)(-|$)", 1).try_cast("int")
    named = hits.withColumn("song_key", song_key()).filter("song_key <> '|'").withColumns({"_source": F.split("source", "_")[0], "_label": _label()})
    of_source = named.groupBy("song_key", "_source").agg(
        F.count("*").alias("n"), F.min(year).alias("y1"), F.max(year).alias("y2"), F.max_by(F.col("_label"), F.when(F.col("_label").isNotNull(), F.col("hit_id"))).alias("last_label")
    )
    return of_source.groupBy("song_key").agg(
        F.sum("n").alias("_n"), F.min("y1").alias("_y1"), F.max("y2").alias("_y2"), F.count("_source").alias("_sources"),
        ((F.count("last_label") >= 2) & (F.min("last_label") == F.max("last_label"))).alias("_agree"),
    )


def with_facts(hits: DataFrame, least_share: float = 0.001) -> DataFrame:
    """hits with song_key and the facts of their song; null for hits of no song.

    Songs with least_share of the hits or more, at most 1 / least_share of them, are broadcast, so that their hits stay where they are; the
    others meet their facts in a shuffle.
    """
    facts = materialize(song_facts(hits))
    bound = (facts.agg(F.sum("_n")).first()[0] or 0) * least_share
    rows = hits.withColumn("song_key", song_key())
    heavy = facts.filter(F.col("_n") >= bound)
    frequent = rows.join(F.broadcast(heavy), "song_key")
    rest = rows.join(F.broadcast(heavy.select("song_key")), "song_key", "left_anti")
    unnamed = rest.filter("song_key = '|'").select(*rest.columns, *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in facts.columns[1:]])
    return frequent.unionByName(rest.filter("song_key <> '|'").join(facts.filter(F.col("_n") < bound), "song_key", "left")).unionByName(unnamed)


FACTS = ["_n", "_y1", "_y2", "_sources", "_agree"]


def _dated(rows: DataFrame) -> DataFrame:
    judged = F.coalesce((F.col("_n") >= 2) & F.col("_y1").isNotNull(), F.lit(False))
    close = F.col("_y2") - F.col("_y1") <= 1
    return rows.withColumns({
        "confidence": F.when(judged & close, _raise(0.05)).when(judged, F.greatest(F.lit(0.0), F.col("confidence") - 0.10)).otherwise(F.col("confidence")),
        "date_range": F.when(judged & ~close, F.concat_ws("-", F.col("_y1").cast("string"), F.col("_y2").cast("string"))),
    })


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("confidence", F.when(F.col("_agree") & F.col("label").isNotNull(), _raise(0.03)).otherwise(F.col("confidence")))


def _by_sources(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("n_sources", F.col("_sources"))
    return rows.withColumn("confidence", F.when(F.col("n_sources") >= 3, _raise(0.15)).when(F.col("n_sources") >= 2, _raise(0.10)).otherwise(F.col("confidence")))


def date_validation(hits: DataFrame) -> DataFrame:
    """Years of a song's hits that lie within one year of each other confirm them; wider ones count against all. Hits of no song stay."""
    return _dated(with_facts(hits)).drop(*FACTS)


def label_validation(hits: DataFrame) -> DataFrame:
    """Labels that two sources or more agree on confirm the hits that have one; of a source the last hit's label counts. Hits of no song stay."""
    return _labelled(with_facts(hits)).drop(*FACTS)


def multi_source_boost(hits: DataFrame) -> DataFrame:
    """More sources for one song raise all its hits. Hits without artist and title are of no song: n_sources is null and they stay."""
    return _by_sources(with_facts(hits)).drop(*FACTS)


def score_hits(hits: DataFrame) -> DataFrame:
    """All steps in their order; as none changes what a song's facts are made of, these are made once."""
    return _by_sources(_labelled(_dated(with_facts(popularity_boost(hits))))).drop(*FACTS)


def isrc_cross_link(hits: DataFrame, recordings: DataFrame, source: str = "streambase_isrc", primary: str = "musicbase_isrc") -> DataFrame:
    """Hits of one source whose code the primary source hasn't confirmed, with the recording that has the code."""
    known = hits.filter((F.col("source") == primary) & F.col("isrc").isNotNull()).select("isrc").distinct()
    codes = recordings.select("recording_mbid", F.explode("isrcs").alias("isrc")).groupBy("isrc").agg(F.min("recording_mbid").alias("recording_mbid"))
    open_hits = hits.filter((F.col("source") == source) & F.col("isrc").isNotNull()).join(known, "isrc", "left_anti")
    return open_hits.join(codes, "isrc").select("hit_id", "isrc", "recording_mbid", F.lit(0.95).alias("confidence"))
