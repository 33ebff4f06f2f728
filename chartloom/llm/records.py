"""Length-delimited binary records of token ids, with an offset index for reads in any order.

A shard is a file of frames: length (8 bytes, little-endian), masked checksum of the length (4), payload,
masked checksum of the payload (4). A payload is the document id (8, signed), a flag byte and the ids as little-endian
unsigned 16-bit (flag 0) or 32-bit (flag 1) integers; flag + 2: the ids are compressed by zstd; flag + 4: the document has no id
(0 stands there). Beside shard-00000.rec lies shard-00000.idx: for each frame its document id (the least one for none), offset and
frame length (8 bytes each).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.common import materialize, shared_folder, slices

HEAD = struct.Struct("<QI")
MASK = 0xA282EAD8
LEAST = -(1 << 63)
#: A word of Latin or Cyrillic letters only, with ASCII signs around it; before it no apostrophe, which may belong to what follows.
PARTS = r"^(?P<head>[!-&(-/:-@\[-`{-~]*)(?P<core>[A-Za-zÀ-ÖØ-öø-ɏА-яЁё]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
#: An upper-case letter that may be composed with a mark after it, so that it can't be lowered before.
COMPOSED = r"[A-Z]\pM"
HELD_PARTS = 600_000
_encoders: dict = {}


def masked_crc(data: bytes) -> int:
    """CRC-32 turned right by 15 bits plus a constant, so that checksums of data that hold checksums stay good."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def frames(data: bytes) -> Iterator[bytes]:
    """The payloads of a shard; a wrong checksum or a cut frame raises ValueError."""
    at = 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError(f"cut frame at {at}")
        size, check = HEAD.unpack_from(data, at)
        end = at + HEAD.size + size
        if masked_crc(data[at : at + 8]) != check or end + 4 > len(data):
            raise ValueError(f"damaged length at {at}")
        payload = data[at + HEAD.size : end]
        if masked_crc(payload) != struct.unpack_from("<I", data, end)[0]:
            raise ValueError(f"damaged payload at {at}")
        yield payload
        at = end + 4


def pack(doc_id: int | None, ids: np.ndarray, squeeze: zstandard.ZstdCompressor | None) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    body = ids.astype("<u4" if wide else "<u2").tobytes()
    if squeeze is not None:
        body = squeeze.compress(body)
    return struct.pack("<qB", doc_id or 0, wide + 2 * (squeeze is not None) + 4 * (doc_id is None)) + body


def unpack(payload: bytes, expand: zstandard.ZstdDecompressor | None = None) -> tuple[int | None, np.ndarray]:
    doc_id, flag = struct.unpack_from("<qB", payload)
    body = payload[9:]
    if flag & 2:
        body = (expand or zstandard.ZstdDecompressor()).decompress(body)
    return None if flag & 4 else doc_id, np.frombuffer(body, "<u4" if flag & 1 else "<u2").astype(np.uint32)


class PartEncoder:
    """Token ids of whole texts from those of their words' parts, each of which the library encodes once.

    The tokenizer lowers letters, splits at white space, and takes runs of letters and runs of signs apart; no token crosses such a
    place. So the ids of a text are those of its words one after the other, and those of a word of letters between signs are those of
    the three parts. Any other word (digits, apostrophes, marks, special tokens) is a part by itself. Ids of frequent parts are held.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # Lower-case ASCII letters pass the rules before the model unchanged and in one piece.
        self.bare = Tokenizer(self.whole.model)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.number: dict[str, int] = {"": 0}
        self.begin, self.count, self.uses = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, parts: list[str]) -> None:
        new = [p for p in parts if p not in self.number]
        plain = [p for p in new if p.isascii() and p.isalpha() and p.islower()]
        other = [p for p in new if not (p.isascii() and p.isalpha() and p.islower())]
        for tokenizer, some in ((self.bare, plain), (self.whole, other)):
            if some:
                encoded = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
                cuts = np.searchsorted(np.array(encoded.word_ids, np.int64), np.arange(len(some) + 1))
                self.begin = np.concatenate((self.begin, cuts[:-1] + len(self.ids)))
                self.count = np.concatenate((self.count, np.diff(cuts)))
                self.ids = np.concatenate((self.ids, np.array(encoded.ids, np.uint32)))
                self.number.update(zip(some, range(len(self.number), len(self.number) + len(some)), strict=True))
        self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int64)))

    def forget(self) -> None:
        """If too many parts are held, keep those that are used most, about half."""
        if len(self.number) <= HELD_PARTS:
            return
        keep = self.uses >= max(2, int(np.median(self.uses)))
        keep[0] = True
        self.ids = self.ids[_gather(self.begin[keep], self.count[keep])]
        self.count, self.uses = self.count[keep], self.uses[keep] // 2
        self.begin = np.cumsum(self.count) - self.count
        self.number = dict(zip(compress(self.number, keep.tolist()), range(len(self.count)), strict=True))

    def parts_of(self, words: pa.Array) -> np.ndarray:
        """The numbers of each word's three parts, [word, part], of distinct words."""
        found = pc.extract_regex(words, PARTS)
        odd = found.is_null()
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(words, token))
        columns = [found.field("head"), found.field("core"), found.field("tail")]
        for k, other in ((0, pa.nulls(len(words), pa.string())), (1, words), (2, pa.nulls(len(words), pa.string()))):
            columns[k] = pc.replace_with_mask(columns[k], odd, other.filter(odd))
        out = np.zeros((len(words), 3), np.int64)
        for k, column in enumerate(columns):
            coded = column.fill_null("").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            self.learn(distinct)
            numbers = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))
            out[:, k] = numbers[coded.indices.to_numpy()]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of each text's); null counts as empty."""
        self.forget()
        fixed = pc.match_substring_regex(texts, COMPOSED)
        for token in self.special:
            fixed = pc.or_(fixed, pc.match_substring(texts, token, ignore_case=True))
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        words = lists.flatten()
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.dictionary_encode()
        distinct, which = coded.dictionary, coded.indices.to_numpy()
        if not pc.any(fixed).as_py():
            lowered = pc.ascii_lower(distinct).dictionary_encode()
            distinct, which = lowered.dictionary, lowered.indices.to_numpy()[which]
        if not len(which):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        parts = self.parts_of(distinct)
        size = self.count[parts].sum(axis=1)
        flat = self.ids[_gather(self.begin[parts.ravel()], self.count[parts.ravel()])]
        self.uses += np.bincount(parts.ravel(), minlength=len(self.uses))
        ids = flat[_gather((np.cumsum(size) - size)[which], size[which])]
        sums = np.concatenate(([0], np.cumsum(size[which])))
        ends = np.cumsum(per_text)
        return ids, sums[ends] - sums[ends - per_text]


def _gather(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, … of each run of count."""
    at = np.repeat(begin - (np.cumsum(count) - count), count)
    at += np.arange(len(at))
    return at


def encode_texts(path: str, texts: pa.Array | list[str], end_id: int | None = None) -> list[np.ndarray]:
    """Token ids of each whole text, with end_id after them if there is one."""
    if path not in _encoders:
        _encoders[path] = PartEncoder(path)
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    ids, counts = _encoders[path].encode(texts)
    if end_id is not None:
        ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
    return np.split(ids, np.cumsum(counts)[:-1])


def n_shards(docs: DataFrame, text_col: str, shard_bytes: int) -> int:
    """As many shards as the texts' bytes ask for, and as there are shuffle partitions at least."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))


def write_records(
    docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
    shards: int | None = None, shard_bytes: int = 128_000_000, level: int = 3,
) -> DataFrame:
    """Encode every text and write shards in ascending order of id below folder; returns their manifest.

    Null texts count as empty; each document ends with end_id. Rows without an id come first. Rows with one id stand together, in the
    order of a hash of their texts, and may fill several shards. A task writes its shard and index as it goes, under another name, and
    moves them at the end, so a repeated task does no harm. The manifest has (shard, path, documents, tokens) and is one row per shard; an empty table gives none.
    """
    shards = shards or n_shards(docs, text_col, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        temp = f"{root}/_tmp-{uuid.uuid4().hex}"
        squeeze = zstandard.ZstdCompressor(level=level, write_content_size=True)
        shard, at, tokens, documents = None, 0, 0, 0
        out = side = None
        for b in slices(batches, "text", 2_000_000):
            if out is None:
                shard = b.column("shard")[0].as_py()
                store.create_dir(root, recursive=True)
                out, side = store.open_output_stream(f"{temp}.rec"), store.open_output_stream(f"{temp}.idx")
            pieces, index = [], []
            for doc_id, seq in zip(b.column("id").to_pylist(), encode_texts(tokenizer_path, b.column("text"), end_id), strict=True):
                f = frame(pack(doc_id, seq, squeeze))
                index.append((LEAST if doc_id is None else doc_id, at, len(f)))
                at += len(f)
                tokens += len(seq)
                pieces.append(f)
            documents += len(index)
            out.write(b"".join(pieces))
            side.write(np.array(index, "<i8").tobytes())
        if out is None:
            return
        out.close()
        side.close()
        name = f"{root}/shard-{shard:05d}"
        store.move(f"{temp}.idx", f"{name}.idx")
        store.move(f"{temp}.rec", f"{name}.rec")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/shard-{shard:05d}"], "documents": [documents], "tokens": [tokens]}, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = rows.repartitionByRange(shards, "id", "h").sortWithinPartitions("id", "h").select("id", "text", F.spark_partition_id().alias("shard"))
    return ranged.mapInArrow(run, "shard int, path string, documents long, tokens long")


def read_records(manifest: DataFrame) -> DataFrame:
    """The documents of all shards, in order within each: (shard, doc_id, start, ids).

    start is the number of ids of all documents before: the shards before it, a running sum over the one-row-per-shard
    manifest, and those before it in the shard.
    """
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, path, at in zip(b.column("shard").to_pylist(), b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                yield from _documents(shard, path, at)

    return placed.select("shard", "path", "base").repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(run, "shard int, doc_id long, start long, ids array<long>")


def shard_frames(path: str, span: int = 8_000_000, entries: int = 200_000) -> Iterator[bytes]:
    """Frames of one shard, read through its index in spans of a bounded size."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}.idx") as side, store.open_input_file(f"{root}.rec") as data:
        while part := side.read(24 * entries):
            index, i = np.frombuffer(part, "<i8").reshape(-1, 3), 0
            while i < len(index):
                j = max(i + 1, int(np.searchsorted(index[:, 1], index[i, 1] + span)))
                yield from frames(data.read_at(int(index[j - 1, 1] + index[j - 1, 2] - index[i, 1]), int(index[i, 1])))
                i = j


def _documents(shard: int, path: str, at: int) -> Iterator[pa.RecordBatch]:
    rows, size = {"shard": [], "doc_id": [], "start": [], "ids": []}, 0
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
    for payload in shard_frames(path):
        doc_id, ids = unpack(payload)
        for k, v in zip(rows, (shard, doc_id, at, ids.astype(np.int64)), strict=True):
            rows[k].append(v)
        at += len(ids)
        size += len(ids)
        if size > 1_000_000:
            yield pa.RecordBatch.from_pydict(rows, schema=schema)
            rows, size = {k: [] for k in rows}, 0
    if rows["doc_id"]:
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True)) or [()] * 4], ["doc_id", "start", "n_tokens", "ids_crc32"])


def record_digests(manifest: DataFrame) -> DataFrame:
    """What the files hold, without the ids themselves: (doc_id, start, n_tokens, ids_crc32)."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                rows, expand = [], zstandard.ZstdDecompressor()
                for payload in shard_frames(path):
                    doc_id, ids = unpack(payload, expand)
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield _columns(rows)
                        rows = []
                yield _columns(rows)

    return placed.select("shard", "path", "base").repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write all documents as records, read the files back and return their digests."""
    folder = folder or shared_folder(docs.sparkSession)
    manifest = materialize(write_records(docs, tokenizer_path, folder))
    return record_digests(manifest)
