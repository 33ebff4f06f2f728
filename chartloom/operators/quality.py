"""Checks of chart snapshots and of tables against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Titles of digits that are songs.
NUMERIC_TITLES = ["1999", "1979", "505"]


def count_sanity(entries: DataFrame, expected: DataFrame, least: float = 0.9) -> DataFrame:
    """Per run whether it has nearly as many ranks as its chart should have, and how many are short; of a chart that expected (chart_id, expected) lacks, any."""
    n = entries.groupBy("run_id", "chart_id").agg(F.count_distinct("rank").alias("n_ranks")).join(expected, "chart_id", "left")
    enough = F.col("expected").isNull() | (F.col("n_ranks") >= F.floor(F.col("expected") * least))
    return n.select("run_id", "n_ranks", "expected", F.when(F.col("expected").isNotNull(), F.greatest(F.lit(0), F.col("expected") - F.col("n_ranks"))).alias("shortage"), (enough & (F.col("n_ranks") > 0)).alias("ok"))


def entry_issues(entries: DataFrame) -> DataFrame:
    """Entries with the list of what is odd about them; of equal entries all but one are duplicates."""
    title, artist = F.col("title_raw"), F.col("artist_raw")
    again = F.row_number().over(Window.partitionBy("run_id", "rank", "artist_raw", "title_raw").orderBy("n")) > 1
    checks = {
        "html": F.concat(title, artist).rlike("<[^>]+>"),
        "long_title": F.length(title) > 200,
        "long_artist": F.length(artist) > 150,
        "slashes": F.length(title) - F.length(F.replace(title, F.lit("/"), F.lit(""))) > 5,
        "numeric_title": F.trim(title).rlike("^[0-9]+$") & ~F.trim(title).isin(NUMERIC_TITLES),
        "empty": (F.trim(title) == "") | (F.trim(artist) == ""),
        "duplicate": again,
    }
    return entries.withColumn("issues", F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()])))


def issue_counts(entries: DataFrame) -> DataFrame:
    return entry_issues(entries).select("run_id", F.explode("issues").alias("issue")).groupBy("run_id", "issue").agg(F.count("*").alias("n"))


def rank_gaps(entries: DataFrame) -> DataFrame:
    """Ranks from 1 to a run's last one that no entry has."""
    wanted = entries.groupBy("run_id").agg(F.max("rank").alias("last")).select("run_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("rank"))
    return wanted.join(entries.select("run_id", "rank"), ["run_id", "rank"], "left_anti")


def repeated_ranks(entries: DataFrame) -> DataFrame:
    """(run_id, rank, n): ranks that several entries of a run have."""
    return entries.groupBy("run_id", "rank").agg(F.count("*").alias("n")).filter("n > 1")


def available_editions(runs: DataFrame, today: str) -> DataFrame:
    """Yearly editions that are out: from 25 December of their year."""
    return runs.filter(F.make_date(F.substring("period", 1, 4).cast("int"), F.lit(12), F.lit(25)) <= F.to_date(F.lit(today)))


def integrity(references: list[tuple[str, DataFrame, DataFrame, list[str]]], unique: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Rows that break a reference (name, rows, target, key) or a unique key (name, rows, key), counted by name."""
    broken = [rows.join(target.select(*key), key, "left_anti").agg(F.lit(name).alias("problem"), F.count("*").alias("n")) for name, rows, target, key in references]
    broken += [rows.groupBy(*key).count().filter("count > 1").agg(F.lit(name).alias("problem"), F.count("*").alias("n")) for name, rows, key in unique]
    return reduce(DataFrame.unionByName, broken)
