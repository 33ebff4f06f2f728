"""Chart history and comparison of runs, for all songs and runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A run's song, compared without regard to case and outer spaces.
KEY = ["artist_key", "title_key"]


def keyed(entries: DataFrame) -> DataFrame:
    return entries.withColumns({"artist_key": F.lower(F.trim("artist_raw")), "title_key": F.lower(F.trim("title_raw"))})


def run_sequence(runs: DataFrame) -> DataFrame:
    """Runs with the stored periods before and after theirs in the chart; the neighbours need not be adjacent in time."""
    w = Window.partitionBy("chart_id").orderBy("period")
    return runs.select(
        "run_id",
        "chart_id",
        "period",
        F.lag("period").over(w).alias("previous_period"),
        F.lead("period").over(w).alias("next_period"),
        F.lag("run_id").over(w).alias("previous_run_id"),
        F.lead("run_id").over(w).alias("next_run_id"),
    )


def period_as_of(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """(chart_id, asked period) -> the last stored period before it, null if none; asked need not be stored.

    Asked and stored periods of a chart are merged in order, and the last stored one is carried along.
    """
    questions = asked.select("chart_id", "period").distinct().withColumns({"_stored": F.lit(None).cast("string"), "_place": F.lit(0)})
    rows = questions.unionByName(runs.select("chart_id", "period", F.col("period").alias("_stored"), F.lit(1).alias("_place")))
    before = Window.partitionBy("chart_id").orderBy("period", "_place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("previous_period", F.last("_stored", ignorenulls=True).over(before)).filter("_place = 0").select("chart_id", "period", "previous_period")


def song_ranks(entries: DataFrame) -> DataFrame:
    """One rank for each song of a run: of repeated songs the last entry, that is the largest rank, counts."""
    return keyed(entries).groupBy("run_id", "chart_id", "period", *KEY).agg(F.max("rank").alias("rank"))


def compare_consecutive(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """All songs of all pairs of consecutive runs of a chart: rank1 and rank2, null where the song is missing.

    Each song is walked once through the runs of its chart: it stands in the pair with the next run, together with its rank there if it has one, and in the
    pair with the run before if it wasn't there. This carries every form of comparison below.
    """
    order = run_sequence(runs).withColumn("seq", F.row_number().over(Window.partitionBy("chart_id").orderBy("period")))
    ranks = song_ranks(entries).join(order.select("run_id", "previous_period", "next_period", "seq"), "run_id")
    w = Window.partitionBy("chart_id", *KEY).orderBy("seq")
    there = F.when(F.lead("seq").over(w) == F.col("seq") + 1, F.lead("rank").over(w))
    rows = ranks.withColumns({"_after": there, "_new": F.coalesce(F.lag("seq").over(w) != F.col("seq") - 1, F.lit(True))})
    pair = lambda p1, p2, r1, r2: F.struct(p1.alias("period1"), p2.alias("period2"), r1.cast("int").alias("rank1"), r2.cast("int").alias("rank2"))
    first = F.when(F.col("next_period").isNotNull(), pair(F.col("period"), F.col("next_period"), F.col("rank"), F.col("_after")))
    second = F.when(F.col("previous_period").isNotNull() & F.col("_new"), pair(F.col("previous_period"), F.col("period"), F.lit(None), F.col("rank")))
    return rows.select("chart_id", *KEY, F.explode(F.array_compact(F.array(first, second))).alias("p")).select("chart_id", "p.period1", "p.period2", *KEY, "p.rank1", "p.rank2")


def common(compared: DataFrame) -> DataFrame:
    return compared.filter("rank1 is not null and rank2 is not null")


def only_in_first(compared: DataFrame) -> DataFrame:
    return compared.filter("rank2 is null").drop("rank2")


def only_in_second(compared: DataFrame) -> DataFrame:
    return compared.filter("rank1 is null").drop("rank1")


def overlap(compared: DataFrame) -> DataFrame:
    """Common songs as a percentage of all songs of both runs."""
    both = F.count_if(F.col("rank1").isNotNull() & F.col("rank2").isNotNull())
    return compared.groupBy("chart_id", "period1", "period2").agg(
        both.alias("n_common"), F.count("*").alias("n_union"), F.round(both * 100.0 / F.count("*"), 6).alias("overlap_pct")
    )


def movers(compared: DataFrame, top: int = 10) -> DataFrame:
    """The largest changes of rank of each pair of runs; a positive delta is a rise."""
    w = Window.partitionBy("chart_id", "period1", "period2").orderBy(F.abs("delta").desc(), *KEY)
    changed = common(compared).withColumn("delta", F.col("rank1") - F.col("rank2")).filter("delta <> 0")
    return changed.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def derived_delta(entries: DataFrame) -> DataFrame:
    """Change of rank since the same song's last appearance in the chart, and its direction."""
    w = Window.partitionBy("chart_id", *KEY).orderBy("period")
    delta = F.lag("rank").over(w) - F.col("rank")
    return song_ranks(entries).withColumn("delta", delta).withColumn(
        "direction", F.when(F.col("delta").isNull(), "new").when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("same")
    )


def claimed_delta(entries: DataFrame) -> DataFrame:
    """The change that the entry itself claims: previous_position - rank."""
    delta = F.col("previous_position") - F.col("rank")
    return entries.withColumn("delta", delta).withColumn("direction", F.when(delta.isNull(), "new").when(delta > 0, "up").when(delta < 0, "down").otherwise("same"))


def position_mismatches(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Entries whose claimed previous position isn't the song's rank in the run before; unclaimed and unfound ones are skipped."""
    order = run_sequence(runs).filter("previous_run_id is not null").select("run_id", "previous_run_id")
    before = song_ranks(entries).select(F.col("run_id").alias("previous_run_id"), *KEY, F.col("rank").alias("actual"))
    claims = keyed(entries).filter("previous_position is not null").join(order, "run_id")
    return claims.join(before, ["previous_run_id", *KEY]).filter("actual <> previous_position")


def continuity(entries: DataFrame, runs: DataFrame, least: float = 0.5) -> DataFrame:
    """For each run the share of the previous run's songs that it still has; 1 where there is none before."""
    order = run_sequence(runs)
    songs = keyed(entries).select("run_id", *KEY).distinct()
    kept = (
        order.select("run_id", "previous_run_id").join(songs.withColumnRenamed("run_id", "previous_run_id"), "previous_run_id")
        .join(songs.withColumn("still", F.lit(1)), ["run_id", *KEY], "left")
        .groupBy("run_id").agg(F.count("*").alias("n_reference"), F.count("still").alias("n_common"))
    )
    share = F.coalesce(F.round(F.col("n_common") / F.col("n_reference"), 6), F.lit(1.0))
    return order.select("run_id", "chart_id", "period").join(kept, "run_id", "left").withColumn("overlap", share).withColumn("ok", F.col("overlap") >= least).drop("n_reference", "n_common")
