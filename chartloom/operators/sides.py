"""Double-sided entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_sides(entries: DataFrame) -> DataFrame:
    """One row per side of an entry whose title, or title and artist, are parted by slashes or semicolons.

    One artist goes with every title, as many artists as titles go in pairs; otherwise the entry stays whole. Sides are
    A, B and so on; a single one has none.
    """
    parted = lambda c: F.filter(F.transform(F.split(c, r"\s+/\s+|\s*;\s*"), lambda x: F.trim(x)), lambda x: x != "")
    sides = entries.withColumns({"_titles": parted("title_raw"), "_artists": parted("artist_raw")})
    fits = (F.size("_titles") > 1) & F.size("_artists").isin(1) | (F.size("_titles") > 1) & (F.size("_artists") == F.size("_titles"))
    pairs = F.when(fits, F.transform("_titles", lambda t, i: F.struct(F.when(F.size("_artists") == 1, F.get("_artists", F.lit(0))).otherwise(F.get("_artists", i)).alias("artist"), t.alias("title"), F.char(i + 65).alias("side")))).otherwise(
        F.array(F.struct(F.col("artist_raw").alias("artist"), F.col("title_raw").alias("title"), F.lit(None).cast("string").alias("side")))
    )
    return sides.withColumn("_side", F.explode(pairs)).withColumns({"artist_raw": F.col("_side.artist"), "title_raw": F.col("_side.title"), "side": F.col("_side.side")}).drop("_titles", "_artists", "_side")
