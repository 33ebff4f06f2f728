"""Fill-in-middle over texts that are kept as seekable compressed frames.

A text is stored as independent zstandard frames of at most FRAME_BYTES of UTF-8, each beside the bytes, code points and line ends
counted up to its end. A cut after u lines is found by bisecting the counted line ends and opening one frame; a transformed text is a
walk over ordered frames between markers, of which only the frames at cuts are opened in part. What a task holds beyond one text's frames is one
opened frame, so long texts are no burden.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chartloom.llm.common import free_names, materialize, slices

FRAME_BYTES = 65_536
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FRAME = T.StructType([T.StructField("bytes", T.LongType()), T.StructField("chars", T.LongType()), T.StructField("lines", T.LongType()), T.StructField("data", T.BinaryType())])
ARROW_FRAME = pa.struct([("bytes", pa.int64()), ("chars", pa.int64()), ("lines", pa.int64()), ("data", pa.binary())])
_opener = zstandard.ZstdDecompressor()
_closer = zstandard.ZstdCompressor(level=3, write_content_size=True)


def count_chars(data: bytes) -> int:
    """Code points of UTF-8 bytes: those that don't go on with another's."""
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


class Frames:
    """Bytes as independent frames, with the bytes, code points and line ends up to the end of each."""

    def __init__(self, frames: Iterable[tuple[int, int, int, bytes]] = ()):
        self.bytes: list[int] = []
        self.chars: list[int] = []
        self.lines: list[int] = []
        self.data: list[bytes] = []
        for f in frames:
            self._add(*f)

    def _add(self, upto: int, chars: int, lines: int, data: bytes) -> None:
        self.bytes.append(upto)
        self.chars.append(chars)
        self.lines.append(lines)
        self.data.append(data)

    @classmethod
    def of(cls, parts: Iterable[bytes], size: int = FRAME_BYTES) -> Frames:
        """Frames of the parts one after the other, cut where a code point begins."""
        out, held = cls(), b""
        for part in parts:
            held = held + part if held else part
            at = 0
            while len(held) - at > size:
                stop = at + size
                while stop > at + 1 and held[stop] & 0xC0 == 0x80:
                    stop -= 1
                out._close(held[at:stop])
                at = stop
            held = held[at:] if at else held
        if held:
            out._close(held)
        return out

    def _close(self, plain: bytes) -> None:
        self._add(self.size + len(plain), self.n_chars + count_chars(plain), self.n_ends + plain.count(b"\n"), _closer.compress(plain))

    @property
    def size(self) -> int:
        return self.bytes[-1] if self.bytes else 0

    @property
    def n_chars(self) -> int:
        return self.chars[-1] if self.chars else 0

    @property
    def n_ends(self) -> int:
        return self.lines[-1] if self.lines else 0

    def open(self, k: int) -> bytes:
        return _opener.decompress(self.data[k])

    def n_lines(self) -> int:
        """Lines, a last one without an end included."""
        return self.n_ends + (bool(self.data) and not self.open(len(self.data) - 1).endswith(b"\n"))

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) before the end of so many lines; opens one frame at most."""
        if not units:
            return 0, 0
        if units > self.n_ends:
            return self.size, self.n_chars
        k = bisect_left(self.lines, units)
        before = (self.bytes[k - 1], self.chars[k - 1], self.lines[k - 1]) if k else (0, 0, 0)
        plain = self.open(k)
        stop = int(np.flatnonzero(np.frombuffer(plain, np.uint8) == 10)[units - before[2] - 1]) + 1
        return before[0] + stop, before[1] + count_chars(plain[:stop])

    def span(self, begin: int, end: int) -> Iterator[bytes]:
        """The bytes from begin to end, frame after frame."""
        k = bisect_right(self.bytes, begin)
        while k < len(self.data) and begin < end:
            base = self.bytes[k - 1] if k else 0
            yield self.open(k)[begin - base : end - base]
            begin, k = self.bytes[k], k + 1

    def find(self, what: bytes, begin: int = 0) -> int:
        """The first place of `what` from begin on, across frames; -1 if there is none."""
        carry, at = b"", begin
        for part in self.span(begin, self.size):
            window = carry + part
            if (hit := window.find(what)) >= 0:
                return at - len(carry) + hit
            at += len(part)
            carry = window[-(len(what) - 1) :]
        return -1


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from seed and id; no id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(text: Frames, doc_id: int | None, seed: int = 7, rate: int = 100, spm: int = 50) -> tuple[int, str, int | None, int | None, Iterator[bytes]]:
    """(lines, form, code points of prefix and middle, the output's parts) of one text."""
    n = text.n_lines()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= rate or any(text.find(m) >= 0 for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text.span(0, text.size)
    (a, a_chars), (b, b_chars) = (text.cut(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (0, a), (a, b), (b, text.size)
    form, order = ("spm", ((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle))) if h4 % 100 < spm else ("psm", ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)))
    parts = (part for mark, (begin, end) in order for part in (mark, *text.span(begin, end)))
    return n, form, a_chars, b_chars - a_chars, parts


def restore(output: Frames, form: str) -> Iterator[bytes]:
    """The parts of the text that an output of this form was made of."""
    if form == "plain":
        yield from output.span(0, output.size)
        return
    second = output.find(SUFFIX if form == "psm" else PREFIX, len(PREFIX))
    third = output.find(MIDDLE, second + len(SUFFIX))
    one, two, middle = (len(PREFIX), second), (second + len(SUFFIX), third), (third + len(MIDDLE), output.size)
    for begin, end in (one, middle, two) if form == "psm" else (two, middle, one):
        yield from output.span(begin, end)


def _framed(frames: list[Frames]) -> pa.Array:
    """One list of frames for each text."""
    ends = np.cumsum([0, *(len(f.data) for f in frames)])
    flat = [pa.array([x for f in frames for x in getattr(f, name)], kind) for name, kind in (("bytes", pa.int64()), ("chars", pa.int64()), ("lines", pa.int64()), ("data", pa.binary()))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(ARROW_FRAME)))


def stored(column: pa.Array) -> Iterator[Frames]:
    """The frames of each row of a column that _framed has made."""
    flat = column.flatten()
    parts = [flat.field(k).to_pylist() for k in range(4)]
    at = 0
    for n in np.diff(column.offsets.to_numpy()).tolist():
        yield Frames(zip(*(p[at : at + n] for p in parts), strict=True))
        at += n


def frame_documents(docs: DataFrame, text_col: str = "text", frames_col: str = "frames", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """docs with the frames of each whole text in place of the text, an array of (bytes, chars, lines, data); null and empty texts have none."""
    names = docs.columns
    other = [n for n in names if n != text_col]
    schema = T.StructType([*(f for f in docs.schema if f.name != text_col), T.StructField(frames_col, T.ArrayType(FRAME))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, names.index(text_col)):
            texts = b.column(names.index(text_col)).to_pylist()
            framed = _framed([Frames.of([t.encode()] if t else [], frame_bytes) for t in texts])
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(n)) for n in other), framed], [*other, frames_col])

    return docs.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, column: int, max_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about max_bytes of framed text, a longer single text alone."""
    frames = batch.column(column)
    ends = np.concatenate(([0], frames.flatten().field(0).to_numpy()))
    offsets = frames.offsets.to_numpy() - frames.offsets[0].as_py()
    sizes = np.cumsum(np.where(np.diff(offsets) > 0, ends[offsets[1:]], 0))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _transformed(framed: DataFrame, id_col: str, frames_col: str, keep: list[str], added: list[tuple[str, T.DataType, pa.DataType]], row) -> DataFrame:
    """Rows of the kept columns, and of what row(frames, id) gives."""
    names = framed.columns
    schema = T.StructType([*(framed.schema[n] for n in keep), *(T.StructField(n, t) for n, t, _ in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, names.index(frames_col)):
                made = [row(f, i) for f, i in zip(stored(b.column(names.index(frames_col))), b.column(names.index(id_col)).to_pylist(), strict=True)]
                columns = [pa.array(c, t) for c, (_, _, t) in zip(zip(*made, strict=True), added, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(names.index(n)) for n in keep), *columns], [*keep, *(n for n, _, _ in added)])

    return framed.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """docs with two more columns, fim_text and fim_form (a name that is taken gets a `_`); all columns of docs stay.

    Each whole text is cut after two drawn numbers of lines; of `rate` texts in a hundred the parts change places, of `spm` of these in a
    hundred with the suffix first. Texts that are null or empty, or hold a marker, stay plain, null as an empty text. Cuts and forms
    depend on seed and id only, so repeated rows are alike; rows without an id are drawn alike. An empty table gives none.
    """
    frames, text, form = free_names(docs.columns, "frames", "fim_text", "fim_form")
    held, source = free_names([*docs.columns, frames, text, form], "_held", "_source")
    framed = materialize(frame_documents(docs.withColumn(source, docs[f"`{text_col}`"]), source, frames))

    def row(f: Frames, doc_id: int | None) -> tuple:
        _, how, _, _, parts = transform(f, doc_id, seed, rate, spm)
        return b"".join(parts).decode(), how

    return _transformed(framed, id_col, frames, docs.columns, [(text, T.StringType(), pa.string()), (form, T.StringType(), pa.string())], row)


def fim_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per document: id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    As fill_in_middle; the frames are written to the shared folder, digests are taken of ordered frames, and the text is rebuilt from the
    output's own frames and form alone.
    """
    framed = materialize(frame_documents(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), "text", "frames", frame_bytes))

    def row(f: Frames, doc_id: int | None) -> tuple:
        n, form, before, within, parts = transform(f, doc_id, seed, rate, spm)
        out, back = hashlib.sha256(), hashlib.sha256()

        def passed() -> Iterator[bytes]:
            for p in parts:
                out.update(p)
                yield p

        for p in restore(Frames.of(passed(), frame_bytes), form):
            back.update(p)
        return n, form, before, within, out.hexdigest(), back.hexdigest()

    long, text = (T.LongType(), pa.int64()), (T.StringType(), pa.string())
    added = [("n", *long), ("form", *text), ("prefix_chars", *long), ("middle_chars", *long), ("output_sha256", *text), ("restored_sha256", *text)]
    return _transformed(framed, "id", "frames", ["id"], added, row).withColumnRenamed("id", id_col)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), u AS (
  SELECT *, len(lines) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(lines) + 1) AS u1, CAST('0x' || h[9:16] AS BIGINT) % (len(lines) + 1) AS u2,
         CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS suffix_first,
         len(lines) = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain
  FROM d
), p AS (
  SELECT *, array_to_string(lines[1:least(u1, u2)], '') AS prefix,
         array_to_string(lines[least(u1, u2) + 1:greatest(u1, u2)], '') AS middle,
         array_to_string(lines[greatest(u1, u2) + 1:], '') AS suffix
  FROM u
), o AS (
  SELECT *, CASE WHEN plain THEN text WHEN suffix_first THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                 ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END AS output,
         CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form
  FROM p
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN NOT plain THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN NOT plain THEN CAST(length(middle) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
                        WHEN 'spm' THEN split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || split_part(output[4:], '<P>', 1)
                        ELSE split_part(output[4:], '<S>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1) END) AS restored_sha256
FROM o
"""
