"""Exact duplicates with a heavy-hitter split.

A Misra-Gries summary of the digests finds those that may hold a large share of all rows. Their exact
counts and winners are computed, and this table of bounded size is broadcast, so that rows of a frequent
text are settled where they are read. All other digests go through an ordinary shuffle, in which no
group can be large.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.common import ascii_lower, free_names, keep_by_key, materialize


def _winner() -> Column:
    """The row of a group that stays: largest id, then largest row number."""
    return F.max(F.struct(F.col("_id").isNotNull().alias("has"), "_id", "_row"))


def merge_summaries(into: Counter, more: Counter, k: int) -> int:
    """Add the counters of `more` and shrink to k of them; returns what was taken from each.

    This is the mergeable form of Misra-Gries: after any number of merges a counter is below the true
    count by at most n / (k + 1).
    """
    into.update(more)
    if len(into) <= k:
        return 0
    cut = sorted(into.values(), reverse=True)[k]
    for key in [key for key, n in into.items() if n <= cut]:
        del into[key]
    for key in into:
        into[key] -= cut
    return cut


def frequent_candidates(digests: DataFrame, column: str, k: int) -> DataFrame:
    """At most k values of a string column, among them every one that holds 2/k of the rows or more."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: Counter = Counter()
        for batch in batches:
            merge_summaries(summary, Counter(batch.column(0).to_pylist()), k)
        yield pa.RecordBatch.from_pydict({"digest": list(summary.keys()), "n": list(summary.values())}, schema=pa.schema([("digest", pa.string()), ("n", pa.int64())]))

    parts = digests.select(F.col(column).alias("digest")).mapInArrow(summarise, "digest string, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k).select("digest")


def text_digest(text_col: str) -> Column:
    """SHA-256 of a text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)


def heavy_groups(rows: DataFrame, counters: int, least_share: float) -> DataFrame:
    """(digest, win, group_size) of the digests (_id, digest, _row) that hold least_share of the rows or more, and more than one row.

    Candidates come from the summary, counts and winners are exact, and the table has at most 1 / least_share rows.
    """
    if least_share * counters < 2:
        raise ValueError("so few counters may miss a digest of that share")
    exact = (
        rows.join(F.broadcast(frequent_candidates(rows, "digest", counters)), "digest", "left_semi")
        .groupBy("digest")
        .agg(_winner().alias("win"), F.count("*").alias("group_size"))
    )
    return materialize(exact.filter((F.col("group_size") > 1) & (F.col("group_size") >= rows.count() * least_share)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 2048, least_share: float = 0.001) -> DataFrame:
    """Groups of equal texts: one row per input row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of a group the row with
    the largest id stays (a null id is below all others; of rows with the same id one stays).
    Returns id, keep_id, group_size, kept, text_sha256; other columns are ignored. An empty table gives none.
    """
    rows = materialize(docs.select(F.col(id_col).alias("_id"), text_digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("_row")))
    heavy = heavy_groups(rows, counters, least_share)
    frequent = rows.join(F.broadcast(heavy), "digest")
    w = Window.partitionBy("digest")
    rare = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").withColumns({"win": _winner().over(w), "group_size": F.count("*").over(w)})
    return frequent.select(*rare.columns).unionByName(rare).select(
        F.col("_id").alias(id_col),
        F.col("win._id").alias("keep_id"),
        "group_size",
        (F.col("win._row") == F.col("_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 2048, least_share: float = 0.001) -> DataFrame:
    """The rows that stay, with all their columns; of rows equal in id and text one stays, of null and empty texts one in all.

    Losers of frequent digests go where they are read, by the broadcast winners. Among the others the losers are found by their
    digests and taken out by key. An empty table gives no rows.
    """
    digest = text_digest(text_col)
    rows = materialize(docs.select(F.col(id_col).alias("_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("_row")))
    heavy = heavy_groups(rows, counters, least_share)
    names = docs.columns
    key, known, keep = free_names(names, "_digest", "_known", "_keep")
    winners = heavy.select(F.col("digest").alias(known), F.col("win._id").alias(keep))
    left = docs.withColumn(key, digest).join(F.broadcast(winners), F.col(key) == F.col(known), "left")
    left = left.filter(F.col(known).isNull() | F.col(id_col).eqNullSafe(F.col(keep))).drop(known, keep)
    per_key = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").groupBy("digest", F.col("_id").alias("id")).agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("id").isNotNull().alias("has"), "id")).over(Window.partitionBy("digest"))
    judged = materialize(per_key.withColumn("best", best["id"]).filter("n > 1 or not (id <=> best)"))
    heavy_again = rows.join(F.broadcast(heavy.select("digest", F.col("win._id").alias("id"))), "digest").filter("_id <=> id").groupBy("digest", "id").agg(F.count("*").alias("n"))
    repeated = judged.filter("id <=> best").select("id", "digest").unionByName(heavy_again.filter("n > 1").select("id", "digest"))
    # The losers grow with the table, so they are joined by sorting at every size.
    losers = judged.filter("not (id <=> best)").select("id", "digest").hint("merge")
    return keep_by_key(left, {"id": F.col(id_col), "digest": F.col(key)}, losers, materialize(repeated)).select(*[F.col(f"`{n}`") for n in names])
