"""Catalogue tables from nested recording documents, or from a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.sources.shared import materialize

ARTIST = "struct<id:string,name:string,`sort-name`:string>"
GROUP = "struct<id:string,title:string,`primary-type`:string,`first-release-date`:string>"
RELEASE = f"struct<id:string,title:string,date:string,country:string,status:string,`release-group`:{GROUP}>"
RECORDING = f"struct<id:string,title:string,length:int,`isrc-list`:array<string>,isrcs:array<string>,`artist-credit`:array<struct<artist:{ARTIST}>>,releases:array<{RELEASE}>>"


def flatten(docs: DataFrame, column: str = "json") -> dict[str, DataFrame]:
    """artist, recording, release_group, release and recording_release of recording documents, one row per key.

    Only the first credit counts. Codes stand under either of two names. Documents are made and read once, and written as read.
    """
    d = materialize(docs.select(F.from_json(column, RECORDING).alias("d")).filter("d.id is not null"))
    credit = F.get("d.artist-credit", F.lit(0))["artist"]
    releases = d.select(F.col("d.id").alias("recording_mbid"), credit["id"].alias("artist_mbid"), F.explode("d.releases").alias("r"))
    once = lambda df, key: df.filter(f"{key} is not null").groupBy(key).agg(*[F.min(c).alias(c) for c in df.columns if c != key])
    return {
        "artist": once(d.select(credit["id"].alias("artist_mbid"), credit["name"].alias("name")), "artist_mbid"),
        "recording": once(d.select(F.col("d.id").alias("recording_mbid"), F.col("d.title").alias("title"), F.col("d.length").alias("length_ms"), credit["id"].alias("artist_mbid"), F.coalesce("d.isrc-list", "d.isrcs").alias("isrcs")), "recording_mbid"),
        "release_group": once(releases.select(F.col("r.release-group.id").alias("rg_mbid"), F.col("r.release-group.title").alias("title"), F.col("r.release-group.primary-type").alias("type"), F.col("r.release-group.first-release-date").alias("first_release_date")), "rg_mbid"),
        "release": once(releases.select(F.col("r.id").alias("release_mbid"), F.col("r.release-group.id").alias("rg_mbid"), F.col("r.date").alias("date"), F.col("r.country").alias("country"), (F.col("r.status") == "Official").alias("is_official")), "release_mbid"),
        "recording_release": releases.select("recording_mbid", F.col("r.id").alias("release_mbid")).repartition("recording_mbid").distinct(),
    }


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int = 64, **properties: str) -> DataFrame:
    """A catalogue table from a database, read in parallel by ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties)
