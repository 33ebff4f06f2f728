"""Deterministic identifiers: the same content has the same id in every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(text: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, length)


def run_id(chart_id: Column, period: Column) -> Column:
    """chart:period; a missing one is told from an empty one."""
    part = lambda c: F.coalesce(c, F.lit("\0"))
    return short_hash(F.concat(part(chart_id), F.lit(":"), part(period)))


def entry_id(run: Column, rank: Column, side: Column | None = None) -> Column:
    """run:rank, and :side where there is one (concat_ws leaves nulls out)."""
    return short_hash(F.concat_ws(":", run, rank.cast("string"), *([] if side is None else [side])))


def work_key(artist_core: Column, title_core: Column) -> Column:
    """One key for a work; null if a core is null or blank."""
    return F.when((F.trim(artist_core) != "") & (F.trim(title_core) != ""), short_hash(F.concat(artist_core, F.lit(" // "), title_core)))


def file_id(fingerprint: Column, duration: Column, path: Column, size: Column, mtime: Column) -> Column:
    """By audio fingerprint and duration; without them by path, size and whole seconds of the modification time."""
    by_sound = F.sha2(F.concat_ws(":", fingerprint, duration.cast("string")), 256)
    by_path = F.sha2(F.concat_ws(":", F.lit("fallback"), path, size.cast("string"), mtime.cast("long").cast("string")), 256)
    return F.when(fingerprint.isNotNull() & duration.isNotNull(), by_sound).otherwise(by_path)


def hash_path(path: Column) -> Column:
    return short_hash(path, 12)
