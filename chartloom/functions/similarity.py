"""Similarity of short texts, in Arrow batches.

The ratio is the normalized Indel similarity 200 * LCS / (len a + len b). The longest common subsequence is
computed bit-parallel over Python's integers: one addition and a few logical operations for each character.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def lcs_length(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & where.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float | None:
    """0 to 100; two empty texts are equal. Null gives null."""
    if a is None or b is None:
        return None
    return 100.0 if a == b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def ratio(a: Column | str, b: Column | str) -> Column:
    return pandas_udf(_ratios, "double")(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Ratio of the sets of words: 100 if one holds the other and they meet; 0 if either has no word; null for null.

    Sets and scores are expressions; only the common subsequence of the words that differ goes by Arrow batches.
    """
    words = lambda t: F.array_distinct(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    line = lambda ws: F.coalesce(F.array_join(F.array_sort(ws), " "), F.lit(""))
    x, y = words(a), words(b)
    common, only_x, only_y = line(F.array_intersect(x, y)), line(F.array_except(x, y)), line(F.array_except(y, x))
    shared = F.length(common)
    joint = shared + F.when(shared > 0, 1).otherwise(0)
    size_x, size_y = joint + F.length(only_x), joint + F.length(only_y)
    distance = F.length(only_x) + F.length(only_y) - 2 * pandas_udf(_common, "int")(only_x, only_y)
    both = 100.0 * (1 - distance / (size_x + size_y))
    one = lambda size: 100.0 * (1 - (size - shared) / (shared + size))
    best = F.when(shared > 0, F.greatest(both, one(size_x), one(size_y))).otherwise(both)
    inside = (shared > 0) & ((only_x == "") | (only_y == ""))
    return F.when(a.isNull() | b.isNull(), None).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(inside, 100.0).otherwise(best)


def can_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether the lengths alone allow a ratio of threshold; a cheap test before the ratio itself."""
    shorter, both = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    return (both == 0) | (200.0 * shorter >= threshold * both)


PUNCTUATION = "^[!@#$%^&*()_+\\-=\\[\\]{}|;':\",./<>?`~\\\\]+$"


def is_sane(original: Column, normalized: Column, threshold: float = 70.0) -> Column:
    """Whether a normalized text still means something: not empty, one character, digits or punctuation only, and
    either close to the original or, from three characters on, a part of it."""
    text = F.trim(F.coalesce(normalized, F.lit("")))
    empty = (F.length(text) <= 1) | text.rlike("^[0-9]+$") | text.rlike(PUNCTUATION)
    close = ratio(F.lower(original), F.lower(text)) >= threshold
    return ~empty & (close | ((F.length(text) >= 3) & F.contains(F.lower(original), F.lower(text))))
