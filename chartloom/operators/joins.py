"""Lookups and join chains over chart tables, for all keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chart_history(songs: DataFrame, entry_songs: DataFrame, entries: DataFrame, runs: DataFrame, charts: DataFrame) -> DataFrame:
    """Every appearance of every song, with its chart's name."""
    placed = runs.select("run_id", F.col("chart_id").alias("c")).join(charts.select(F.col("chart_id").alias("c"), F.col("name").alias("chart_name")), "c")
    return (
        songs.select("song_id").join(entry_songs.select("song_id", "entry_id"), "song_id")
        .join(entries.select("entry_id", "run_id", "chart_id", "period", "rank"), "entry_id")
        .join(placed.drop("c"), "run_id")
        .select("song_id", "chart_id", "chart_name", "period", "rank", "entry_id")
    )


def missing_entries(entries: DataFrame, links: DataFrame, least: float = 0.60) -> DataFrame:
    """Entries without a work or with too little confidence in it."""
    joined = entries.select("entry_id", "run_id", "rank").join(links.select("run_id", "rank", "work_key", "confidence"), ["run_id", "rank"], "left")
    return joined.filter(F.col("work_key").isNull() | (F.col("confidence") < least)).select("entry_id", "work_key", "confidence")


def entries_with_songs(entries: DataFrame, entry_songs: DataFrame, songs: DataFrame) -> DataFrame:
    """Every entry with its first song, if it has one."""
    first = entry_songs.filter("song_idx = 0").select("entry_id", "song_id")
    return entries.select("entry_id").join(first, "entry_id", "left").join(songs.select("song_id", "title_canonical"), "song_id", "left").select("entry_id", "song_id", "title_canonical")


def rank_range(entries: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Entries with start <= rank <= end; an open end stays open."""
    out = entries.filter(F.col("rank") >= (1 if start is None else start))
    return out if end is None else out.filter(F.col("rank") <= end)


def resolve_run_refs(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """(ref) -> runs: a ref is `chart_id:period`, split at the first colon, or a run id."""
    parts = F.split("ref", ":", 2)
    asked = refs.select("ref", F.when(F.size(parts) == 2, parts[0]).alias("chart_id"), F.when(F.size(parts) == 2, F.get(parts, 1)).alias("period"))
    by_name = asked.filter("chart_id is not null").join(runs, ["chart_id", "period"])
    by_id = asked.filter("chart_id is null").select("ref").join(runs, refs["ref"] == runs["run_id"])
    return by_name.select("ref", "run_id", "chart_id", "period").unionByName(by_id.select("ref", "run_id", "chart_id", "period"))


def by_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is listed."""
    return rows.join(keys.select(*on), on, "left_semi")


def numbered(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """Rows with their place in a sorted list of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
