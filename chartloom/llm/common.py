"""What the corpus operators share: table reading, scratch tables, held-out rows, bounded samples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from chartloom.sources.shared import materialize, shared_folder  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves remainder 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed only."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sample_rows(df: DataFrame, key: str, by: str, per_class: int, seed: int, max_classes: int = 256) -> DataFrame:
    """About per_class rows of each value of `by`, chosen by a hash of the key; of more than max_classes values the most frequent, ties by value.

    The counts of the classes are few; the rows are kept or not where they are read.
    Null keys and null classes are left out.
    """
    df = df.filter(F.col(key).isNotNull() & F.col(by).isNotNull())
    sizes = df.groupBy(by).count().orderBy(F.desc("count"), by).limit(max_classes).collect()
    keep = F.lit(False)
    for r in sizes:
        keep = keep | ((F.col(by) == F.lit(r[by])) & (unit_hash(F.col(key), seed) < F.lit(per_class / r["count"])))
    return df.filter(keep)


def slices(batches: Iterable[pa.RecordBatch], text: str | int, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece has about max_bytes of text, a longer single text alone."""
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def spans(texts: list[str], max_chars: int = 500_000) -> Iterator[slice]:
    """Slices of a list of texts that hold about max_chars characters each, a longer single text alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > max_chars:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that aren't taken."""
    out, known = [], {t.lower() for t in taken}
    for name in wanted:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def one_label(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label): one row per id that isn't held out; of several labels of an id the largest. Null ids and labels are left out."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).filter("id is not null and label is not null")
    return rows.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))


def keep_by_key(docs: DataFrame, keys: dict[str, Column], losers: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs without the rows whose keys are among the losers, and with one row of each repeated key; all columns of docs stay.

    keys are expressions over docs; losers and repeated have them as columns of the same names. Null equals null. Rows are sent only
    to where Spark's join needs them: it broadcasts losers whose size is below its bound, and then nothing else moves. Of the rows of a repeated
    key the one with the least hash of all columns is kept (rows of one hash are equal but for a chance of 2**-64), so reruns agree.
    """
    names = docs.columns
    own = free_names(names, *[f"_key_{k}" for k in keys])
    keyed = docs.withColumns(dict(zip(own, keys.values(), strict=True)))

    def equal(other: DataFrame) -> Column:
        on = F.lit(True)
        for mine, k in zip(own, keys, strict=True):
            on = on & F.col(mine).eqNullSafe(other[k])
        return on

    kept = keyed.join(losers, equal(losers), "left_anti")
    if not repeated.isEmpty():
        row, order = free_names([*names, *own], "_row", "_order")
        hashed = [F.map_entries(f.name) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in docs.schema]
        several = kept.join(repeated, equal(repeated), "left_semi").withColumn(order, F.xxhash64(*hashed))
        least = several.groupBy(*own).agg(F.min_by(F.struct(*[F.col(f"`{n}`") for n in names]), F.col(order)).alias(row))
        again = least.select(*own, *[F.col(row)[n].alias(n) for n in names]).select(*kept.columns)
        kept = kept.join(repeated, equal(repeated), "left_anti").unionByName(again)
    return kept.select(*[F.col(f"`{n}`") for n in names])
