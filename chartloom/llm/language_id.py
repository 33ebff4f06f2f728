"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import held_out, sample_rows, slices, spans

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def gram_rows(texts: list[str], bits: int, orders: tuple[int, ...] = (1, 2, 3)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A sparse matrix of n-gram counts for each order: column numbers, and where each text's columns begin.

    Texts are lower-cased; each run of other characters than letters is one space. Grams don't cross texts.
    """
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(texts)))
    letter = letters()[codes]
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
    codes, row = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint64), row[keep]
    h = codes.copy()
    for n in range(1, max(orders) + 1):
        if n > 1:
            h = h[:-1] * np.uint64(1_000_003) + codes[n - 1 :]
        at = row[: len(h)]
        inside = at == row[n - 1 :]
        if n in orders:
            column = (((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)[inside]
            yield column, np.searchsorted(at[inside], np.arange(len(texts)))


def row_sums(table: np.ndarray, column: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sparse rows of ones times a dense matrix; rows without columns give 0."""
    out = np.zeros((len(begin), table.shape[1]))
    full = np.diff(np.append(begin, len(column))) > 0
    if full.any():
        out[full] = np.add.reduceat(table[column], begin[full], axis=0)
    return out


def fit(texts: list[str], langs: list[str], bits: int = 16, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages in order, log-probabilities of buckets by language); every language is equally likely beforehand."""
    names = sorted(set(langs))
    counts = np.full((1 << bits, max(1, len(names))), smoothing)
    for k, name in enumerate(names):
        own = [t for t, x in zip(texts, langs, strict=True) if x == name]
        for part in spans(own):
            for column, _ in gram_rows(own[part], bits):
                counts[:, k] += np.bincount(column, minlength=1 << bits)
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def predict(texts: list[str | None], names: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability; `und` and 0 without a letter."""
    bits = int(np.log2(len(table)))
    total = np.zeros((len(texts), table.shape[1]))
    for column, begin in gram_rows([t or "" for t in texts], bits):
        total += row_sums(table, column, begin)
    known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool) & bool(names)
    best = total.argmax(axis=1)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    score = np.where(known, odds.max(axis=1) / odds.sum(axis=1), 0.0)
    return [names[b] if k else "und" for b, k in zip(best, known, strict=True)], score


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 1000, bits: int = 16, seed: int = 11, max_languages: int = 256) -> DataFrame:
    """(id, held_out, lang_pred, score), one row per input row.

    The model learns from about sample_per_language rows of each language, chosen by a hash of the id among rows that
    aren't held out and have a language, and of more than max_languages languages from the most frequent ones only, so that the model is bounded
    (65,536 buckets times 256 languages are 67 MB) whatever stands in the column; the rest of the work covers every row and whole text. A null text and one without
    letters are `und` with score 0, and so is every text if no row teaches. Languages and the number of
    buckets bound what is broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    teach = sample_rows(rows.filter(~held_out(F.col("id")) & F.col("text").isNotNull()), "id", "lang", sample_per_language, seed, max_languages).select("text", "lang").toArrow()
    names, table = fit(teach.column("text").to_pylist(), teach.column("lang").to_pylist(), bits)
    model = spark.sparkContext.broadcast((names, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for b in slices(batches, "text", 1_000_000):
            lang, score = predict(b.column("text").to_pylist(), names, table)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    out = rows.select(F.col("id").cast("long").alias("id"), held_out(F.col("id")).alias("held_out"), "text").mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
