"""Incremental ingest: snapshots arrive as files, and every batch is put by key into entries, songs and links in one commit.

A table's rows lie in parts, one for each value of its partition columns, null and empty ones included, as the columns stay in the files. A batch reads
the parts that it has rows for, writes them anew into folders of its own, and then writes one small manifest that names the parts of all tables;
this is the commit. Readers follow the last whole manifest, so a batch that fails leaves everything as it was, and a batch that comes again
after its commit changes nothing. Parts that neither the last nor the one before it names are deleted at the next commit. There is one writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chartloom.functions import ids
from chartloom.operators.ingest import canonical_names, link_entries, merge_upsert, song_id

ENTRY = "chart_id string, period string, rank int, artist_raw string, title_raw string"


def keyed_entries(rows: DataFrame) -> DataFrame:
    """Raw rows with the ids of their run and entry."""
    run = ids.run_id(F.col("chart_id"), F.col("period"))
    return rows.withColumns({"run_id": run, "entry_id": ids.entry_id(run, F.col("rank"))})


@dataclass(frozen=True)
class Table:
    """Schema, key and partition columns of a table; the partition columns follow from the key."""

    schema: str
    keys: tuple[str, ...]
    by: tuple[str, ...]


#: Songs and their links are kept in so many parts by a hash of the song's or entry's id.
BUCKETS = 64
CHARTS = {
    "entries": Table(f"{ENTRY}, run_id string, entry_id string", ("entry_id",), ("chart_id", "period")),
    "songs": Table("song_id string, artist_canonical string, title_canonical string, bucket int", ("song_id",), ("bucket",)),
    "links": Table("entry_id string, song_idx int, song_id string, link_method string, link_confidence double, chart_id string, period string", ("entry_id", "song_idx"), ("chart_id", "period")),
}


class CommittedTables:
    """Parquet tables below one folder that change together, batch by batch."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table] = CHARTS):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder))) if self._fs.exists(self._at(folder)) else []

    def manifests(self) -> list[dict]:
        """The manifests that are there and whole, oldest first; one that was cut off is none."""
        out = []
        for name in self._names("log"):
            stream = self._fs.open(self._at(f"log/{name}"))
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                out.append(json.loads(text))
            except ValueError:
                continue
        return sorted(out, key=lambda m: m["version"])

    def _last(self) -> dict:
        return (self.manifests() or [{"version": 0, "batches": {}, "parts": {t: {} for t in self.tables}}])[-1]

    def _read(self, table: str, folders: list[str]) -> DataFrame:
        schema = self.tables[table].schema
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def current(self, table: str) -> DataFrame:
        return self._read(table, sorted(self._last()["parts"][table].values()))

    def commit(self, news: dict[str, DataFrame], batch: int | None = None, stream: str = "") -> bool:
        """Put the rows of some tables in by key; False if this batch of the stream is in already."""
        last = self._last()
        if batch is not None and last["batches"].get(stream, -1) >= batch:
            return False
        version, parts = last["version"] + 1, {t: dict(p) for t, p in last["parts"].items()}
        for name, rows in news.items():
            parts[name] |= self._write(name, rows, parts[name], f"data/{version:012d}-{uuid.uuid4().hex[:8]}-{name}")
        done = last["batches"] | ({stream: batch} if batch is not None else {})
        text = json.dumps({"version": version, "batches": done, "parts": parts})
        out = self._fs.create(self._at(f"log/{version:012d}-{uuid.uuid4().hex[:8]}.json"), False)
        out.write(bytearray(text.encode()))
        out.close()
        self._retire()
        return True

    def _write(self, name: str, rows: DataFrame, parts: dict[str, str], folder: str) -> dict[str, str]:
        """The parts that rows belong to, written anew: {values of the partition columns: folder}. A batch has few of them."""
        table = self.tables[name]
        by = list(table.by)
        rows = rows.select(*[f.name for f in self.spark.createDataFrame([], table.schema).schema])
        touched = [tuple(r) for r in rows.select(*by).distinct().collect()]
        if not touched:
            return {}
        merged = merge_upsert(self._read(name, [parts[json.dumps(k)] for k in touched if json.dumps(k) in parts]), rows, list(dict.fromkeys((*table.by, *table.keys))))
        types = ", ".join(f"p_{c} {merged.schema[c].dataType.simpleString()}" for c in by)
        numbered = self.spark.createDataFrame([(*k, i) for i, k in enumerate(touched)], f"{types}, part int")
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
        merged.join(F.broadcast(numbered), same).select(*merged.columns, "part").write.partitionBy("part").parquet(f"{self.path}/{folder}")
        return {json.dumps(k): f"{folder}/part={i}" for i, k in enumerate(touched)}

    def _retire(self, keep: int = 2) -> None:
        """Delete what the last manifests don't name: parts of old versions, and what failed batches have left."""
        kept = self.manifests()[-keep:]
        named = {f for m in kept for p in m["parts"].values() for f in p.values()}
        for folder in self._names("data"):
            for part in self._names(f"data/{folder}"):
                if part.startswith("part=") and f"data/{folder}/{part}" not in named:
                    self._fs.delete(self._at(f"data/{folder}/{part}"), True)
            if not any(f.startswith(f"data/{folder}/") for f in named):
                self._fs.delete(self._at(f"data/{folder}"), True)
        versions = {m["version"] for m in kept}
        for name in self._names("log"):
            if int(name[:12]) not in versions:
                self._fs.delete(self._at(f"log/{name}"), True)


def chart_tables(batch: DataFrame, aliases: DataFrame | None = None) -> dict[str, DataFrame]:
    """What raw rows of snapshots put into entries, songs and links; ids are hashes of names and places, so songs that exist keep theirs."""
    entries = keyed_entries(batch)
    names = canonical_names(entries, aliases).filter(~F.col("karaoke"))
    bucket = F.pmod(F.xxhash64("song_id"), F.lit(BUCKETS)).cast("int")
    songs = names.select("artist_canonical", "title_canonical").distinct().withColumn("song_id", song_id()).withColumn("bucket", bucket)
    links = link_entries(entries, aliases).join(entries.select("entry_id", "chart_id", "period").distinct(), "entry_id")
    return {"entries": entries, "songs": songs, "links": links}


def commit_batches(tables: CommittedTables, prepare: Callable[[DataFrame], dict[str, DataFrame]] = chart_tables, stream: str = "charts") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function; a repeated batch changes nothing more."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            tables.commit(prepare(batch), number, stream)
        finally:
            batch.unpersist()

    return apply


def ingest_stream(spark: SparkSession, source: str, tables: CommittedTables, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Read all JSON-lines files of a folder that are new, put their entries, songs and links into the tables, then stop."""
    rows = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_batch).json(source)
    return rows.writeStream.foreachBatch(commit_batches(tables)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
