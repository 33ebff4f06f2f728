"""Coverage, scores and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.normalize import artist_core, normalize_title


def pct(part: Column, whole: Column) -> Column:
    """A percentage with six digits; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, 6))


def coverage(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Per run: entries, those with a work, those without, and the percentage. Runs without links are there."""
    joined = entries.select("run_id", "chart_id", "period", "rank").join(links.select("run_id", "rank", "work_key"), ["run_id", "rank"], "left")
    return joined.groupBy("run_id", "chart_id", "period").agg(F.count("*").alias("total"), F.count("work_key").alias("linked")).withColumns(
        {"unlinked": F.col("total") - F.col("linked"), "coverage_pct": pct(F.col("linked"), F.col("total"))}
    )


def coverage_totals(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Coverage by period, by chart and over all, from sums rather than from percentages."""
    return coverage(entries, links).rollup("chart_id", "period").agg(F.sum("total").alias("total"), F.sum("linked").alias("linked")).withColumn("coverage_pct", pct(F.col("linked"), F.col("total")))


def coverage_by_method(links: DataFrame) -> DataFrame:
    return links.filter("work_key is not null").groupBy("run_id", "link_method").agg(F.count("*").alias("n"))


def confidence_band(confidence: Column, auto: float = 0.85, review: float = 0.60) -> Column:
    return F.when(confidence >= auto, "auto").when(confidence >= review, "review").otherwise("reject")


def coverage_by_confidence(links: DataFrame) -> DataFrame:
    """Links by band of confidence; those without a work count too."""
    return links.groupBy("run_id", confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


def _points(entries: DataFrame) -> DataFrame:
    """Entries with n - rank + 1, where n is the number of the run's entries."""
    size = entries.groupBy("run_id").agg(F.count("*").alias("n_run"))
    return entries.join(size, "run_id").withColumn("score", F.col("n_run") - F.col("rank") + 1)


def entry_scores(entries: DataFrame) -> DataFrame:
    """Sum of n - rank + 1 of each song, told apart by its normalized names, over all runs of a chart; blank names are left out.

    Raw names are summed first, and each distinct artist and title is normalized once.
    """
    raw = _points(entries).groupBy("chart_id", "artist_raw", "title_raw").agg(F.sum("score").alias("score"))
    artists = entries.select("artist_raw").distinct().withColumn("artist_core", artist_core(F.col("artist_raw"))).filter("artist_core <> ''")
    titles = entries.select("title_raw").distinct().withColumn("title_core", normalize_title(F.col("title_raw"))["core"]).filter("title_core <> ''")
    cores = raw.join(artists, "artist_raw").join(titles, "title_raw")
    return cores.groupBy("chart_id", "artist_core", "title_core").agg(F.sum("score").alias("score"))


def work_chart_score(entries: DataFrame, links: DataFrame, least: float = 0.60) -> DataFrame:
    """Per work and chart: sum of n - rank + 1, best rank and number of appearances, over links of enough confidence."""
    good = links.filter((F.col("confidence") >= least) & F.col("work_key").isNotNull()).select("run_id", "rank", "work_key")
    return _points(entries).join(good, ["run_id", "rank"]).groupBy("work_key", "chart_id").agg(F.sum("score").alias("score"), F.min("rank").alias("highest"), F.count("*").alias("n_entries"))


def work_chart_positions(links: DataFrame, least: float = 0.60, charts: DataFrame | None = None) -> DataFrame:
    """Per work and chart its positions as sorted JSON text; of several ranks in a period the last, largest one counts.

    charts (chart_id, frequency) tells how: yearly (y, and charts that it lacks) {year: rank}, weekly (w) {year: {week: rank}} with the week as the period
    YYYY-Www writes it, others {period: rank}. Periods of a weekly chart that are no weeks are left out. Without charts all are {period: rank}.
    """
    good = links.filter((F.col("confidence") >= least) & F.col("work_key").isNotNull()).select("work_key", "chart_id", "period", "rank")
    if charts is None:
        good = good.withColumn("frequency", F.lit("m"))
    else:
        good = good.join(charts.select("chart_id", "frequency"), "chart_id", "left").withColumn("frequency", F.coalesce("frequency", F.lit("y")))
    weekly, week = F.col("frequency") == "w", F.split("period", "-W")
    good = good.filter(~weekly | F.contains("period", F.lit("-W")))
    outer = F.when(weekly, week[0]).when(F.col("frequency") == "y", F.split("period", "-")[0]).otherwise(F.col("period"))
    # Of a year's periods the last one counts, of a period's ranks the largest.
    ranks = good.withColumns({"outer": outer, "inner": F.when(weekly, week[1])}).groupBy("work_key", "chart_id", "outer", "inner").agg(F.max(F.struct("period", "rank"))["rank"].alias("rank"))
    pair = lambda k, value: F.concat(F.lit('"'), k, F.lit('":'), value)
    listed = lambda pairs: F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    inner = listed(F.transform(F.array_sort(F.collect_list(F.struct("inner", "rank"))), lambda x: pair(x["inner"], x["rank"].cast("string"))))
    years = ranks.groupBy("work_key", "chart_id", "outer").agg(F.when(F.first("inner").isNull(), F.max("rank").cast("string")).otherwise(inner).alias("value"))
    return years.groupBy("work_key", "chart_id").agg(listed(F.transform(F.array_sort(F.collect_list(F.struct("outer", "value"))), lambda x: pair(x["outer"], x["value"]))).alias("positions"))


def linked_stats(entries: DataFrame, entry_songs: DataFrame, songs: DataFrame) -> DataFrame:
    """Per run: entries, linked ones, linked ones whose song has a recording, and percentages to one digit."""
    known = entry_songs.join(songs.select("song_id", "recording_mbid"), "song_id", "left").groupBy("entry_id").agg(F.max(F.col("recording_mbid").isNotNull().cast("int")).alias("has_recording"))
    return entries.select("entry_id", "run_id").join(known, "entry_id", "left").groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count("has_recording").alias("linked"),
        F.count_if(F.col("has_recording") == 1).alias("with_recording"),
        F.round(F.count("has_recording") * 100.0 / F.count("*"), 1).alias("linked_pct"),
        F.round(F.count_if(F.col("has_recording") == 1) * 100.0 / F.count("*"), 1).alias("recording_pct"),
    )


def top_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)


def missing_reasons(entries: DataFrame, links: DataFrame, examples: int = 10) -> DataFrame:
    """Entries without a sure work, by reason, with the number of each reason and the first examples."""
    reason = F.when(F.col("confidence").isNull(), "no_link").when(F.col("work_key").isNull(), "bundle_unresolved").when(F.col("confidence") < 0.60, "low_confidence")
    missing = entries.select("run_id", "rank", "entry_id", "chart_id").join(links.select("run_id", "rank", "work_key", "confidence"), ["run_id", "rank"], "left").withColumn("reason", reason).filter("reason is not null")
    counts = missing.groupBy("chart_id", "reason").agg(F.count("*").alias("n"))
    return top_per_group(missing, ["chart_id", "reason"], ["run_id", "rank"], examples).join(counts, ["chart_id", "reason"]).select("chart_id", "reason", "n", "place", "entry_id")


def coverage_summary(entries: DataFrame, links: DataFrame, songs_owned: DataFrame) -> DataFrame:
    """Per run: percentage linked and percentage in the library (work keys owned)."""
    joined = entries.select("run_id", "rank").join(links.select("run_id", "rank", "work_key"), ["run_id", "rank"], "left").join(songs_owned.select("work_key").distinct().withColumn("owned", F.lit(1)), "work_key", "left")
    return joined.groupBy("run_id").agg(F.count("*").alias("total"), pct(F.count("work_key"), F.count("*")).alias("linked_pct"), pct(F.count("owned"), F.count("*")).alias("library_pct"))
