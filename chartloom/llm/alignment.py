"""Alignment of two tokenizers over whole texts, by the byte ends of their tokens.

A (byte-level BPE) reads a space and the text, B (pieces with byte fallback) the text, before which it puts a space itself. Where a token of A
and one of B end at one byte, a group of the alignment ends. The end arrays are compared by skipping along diagonals: at the present shift
between the indexes, ever longer stretches (1, 2, 4, ...) are compared until one differs, which jumps whole stretches of one-to-one
tokens; where they differ, the side that is behind goes ahead token by token until both ends meet, and the shift is updated. Texts are cut into lanes at places where
both tokenizers surely end, and all lanes of a slice walk together in numpy.

Neither tokenizer has a token across a place where a space follows something else, so the library encodes each stretch between such
places once, and a worker holds the ids of frequent ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.common import free_names, materialize, slices

#: Where a stretch begins: at a space after anything that isn't white space.
CUT = re.compile(r"(?<=\S)(?= )")
#: Bounds of what a worker holds: stretches, and ids of either tokenizer.
HELD_CHUNKS, HELD_IDS = 400_000, 6_000_000
#: A pair of ids as one number: A's above B_BITS, B's below.
B_BITS = 20
LANE_CHUNKS = 32
_encoders: dict = {}


def byte_letters() -> dict[str, int]:
    """The letters of a byte-level vocabulary: printable bytes stand for themselves, the others for 256, 257, … in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def gather(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, … of each run of count."""
    at = np.repeat(begin - (np.cumsum(count) - count), count)
    at += np.arange(len(at))
    return at


class Side:
    """Ids of the stretches met so far, one after the other."""

    def __init__(self, token_bytes: list[bytes]):
        self.bytes = token_bytes
        self.n_bytes = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))
        self.clear()

    def clear(self) -> None:
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, ids: list[list[int]]) -> None:
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.begin = np.concatenate((self.begin, np.cumsum(count) - count + len(self.ids)))
        self.count = np.concatenate((self.count, count))
        self.ids = np.concatenate((self.ids, np.fromiter((i for x in ids for i in x), np.int32, int(count.sum()))))

    def keep(self, which: np.ndarray) -> None:
        self.ids = self.ids[gather(self.begin[which], self.count[which])]
        self.count = self.count[which]
        self.begin = np.cumsum(self.count) - self.count

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class PairEncoder:
    """Ids of both tokenizers for whole texts, from those of their stretches."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path_a)
        self.tokenizer.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.tokenizer.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        b_bytes = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            if not self.pieces.is_byte(i) and "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {piece!r} crosses a place where a space begins")
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode())
        if len(b_bytes) > 1 << B_BITS:
            raise ValueError("B has too many pieces")
        self.space = self.pieces.piece_to_id("▁")
        self.a, self.b = Side(a_bytes), Side(b_bytes)
        self.number: dict[str, int] = {}
        self.good, self.open, self.uses = np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64)

    def learn(self, keys: list[str]) -> None:
        """Encode the stretches that aren't held; a key is a stretch without the space before it."""
        new = [k for k in keys if k not in self.number]
        if not new:
            return
        encoded = self.tokenizer.encode([f" {k}" for k in new], is_pretokenized=True, add_special_tokens=False)
        cuts = np.searchsorted(np.array(encoded.word_ids, np.int64), np.arange(len(new) + 1)).tolist()
        ids = encoded.ids
        a = [ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        b = self.pieces.encode(new, num_threads=1)
        b = [x if k else [self.space] for k, x in zip(new, b, strict=True)]
        good = [self.a.joined(x) == self.b.joined(y) == f" {k}".encode() for k, x, y in zip(new, a, b, strict=True)]
        self.a.add(a)
        self.b.add(b)
        self.good = np.concatenate((self.good, np.array(good, bool)))
        self.open = np.concatenate((self.open, np.array([not k or k[-1].isspace() for k in new], bool)))
        self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int64)))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))

    def forget(self) -> None:
        """If too much is held, keep the stretches that are used most, about half; none if they are still too long."""
        if len(self.number) <= HELD_CHUNKS and max(len(self.a.ids), len(self.b.ids)) <= HELD_IDS:
            return
        keep = self.uses >= max(2, int(np.median(self.uses)))
        if max(self.a.count[keep].sum(), self.b.count[keep].sum()) > HELD_IDS // 2:
            keep[:] = False
        self.a.keep(keep)
        self.b.keep(keep)
        self.good, self.open, self.uses = self.good[keep], self.open[keep], self.uses[keep] // 2
        self.number = dict(zip(compress(self.number, keep.tolist()), range(int(keep.sum())), strict=True))

    def chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts' stretches, how many each text has)."""
        lists = pc.split_pattern(texts, " ")
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        which, ends = coded.indices.to_numpy(), np.cumsum(per_text)
        # A part that is empty or ends with white space goes on in the next one.
        goes_on = np.fromiter((not k or k[-1].isspace() for k in distinct), bool, len(distinct))[which]
        goes_on[ends - 1] = False
        slow = np.flatnonzero(np.logical_or.reduceat(goes_on, ends - per_text)) if len(ends) else ends
        if not len(slow):
            self.learn(distinct)
            return np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[which], per_text
        plain = np.ones(len(texts), bool)
        plain[slow] = False
        used = np.zeros(len(distinct), bool)
        used[which[np.repeat(plain, per_text)]] = True
        own = {k: [c[1:] for c in CUT.split(" " + texts[k].as_py())] for k in slow.tolist()}
        self.learn(list(dict.fromkeys([*compress(distinct, used.tolist()), *(c for cs in own.values() for c in cs)])))
        numbers = np.fromiter((self.number[k] if u else 0 for k, u in zip(distinct, used.tolist(), strict=True)), np.int64, len(distinct))
        parts = [np.fromiter(map(self.number.__getitem__, own[k]), np.int64, len(own[k])) if k in own else numbers[which[e - n : e]] for k, (e, n) in enumerate(zip(ends.tolist(), per_text.tolist(), strict=True))]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def skip_diagonals(ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(link_a, link_b, meet_a, meet_b) of lanes: the overlapping tokens as pairs of indexes, and the tokens that end a group.

    A lane is the tokens a to a_end and b to b_end; its last ends are equal, and ends rise. Lanes without tokens give nothing. The order
    of what is returned isn't that of the texts.
    """
    a, b = a.copy(), b.copy()
    probe, inside = np.ones(len(a), np.int64), np.zeros(len(a), bool)
    runs, links, meets = [], [], []
    live = np.flatnonzero(a < a_end)
    while len(live):
        walking = inside[live]
        lane = live[~walking]
        if len(lane):
            # Compare the next stretch at the present shift, twice as long as the last one that was equal throughout.
            i, j = a[lane], b[lane]
            n = np.minimum(probe[lane], np.minimum(a_end[lane] - i, b_end[lane] - j))
            first = np.cumsum(n) - n
            at = gather(i, n)
            differs = ends_a[at] != ends_b[at + np.repeat(j - i, n)]
            steps = np.where(differs, at - np.repeat(i, n), np.repeat(n, n))
            same = np.minimum.reduceat(steps, first)
            runs.append((i, j, same))
            a[lane], b[lane] = i + same, j + same
            whole = same == n
            probe[lane] = np.where(whole, 2 * probe[lane], 1)
            inside[lane] = ~whole
        lane = live[walking]
        if len(lane):
            # Both tokens overlap; the one that ends first is followed by the next of its side, and where both end the shift is new.
            i, j = a[lane], b[lane]
            links.append((i, j))
            ahead = ends_a[i] - ends_b[j]
            a[lane], b[lane] = i + (ahead <= 0), j + (ahead >= 0)
            met = ahead == 0
            meets.append((i[met], j[met]))
            inside[lane[met]] = False
        live = live[a[live] < a_end[live]]
    column = lambda parts, k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
    run_a, run_b, length = (column(runs, k) for k in range(3))
    whole_a, whole_b = gather(run_a, length), gather(run_b, length)
    return np.concatenate((whole_a, column(links, 0))), np.concatenate((whole_b, column(links, 1))), np.concatenate((whole_a, column(meets, 0))), np.concatenate((whole_b, column(meets, 1)))


class Aligned:
    """The alignment of some texts: ids of both sides one after the other, where each text's and each group's begin, and the links."""

    def __init__(self, encoder: PairEncoder, texts: pa.Array):
        encoder.forget()
        texts = texts.fill_null("")
        n = len(texts)
        codes, per_text = encoder.chunks(texts)
        filled = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        owner = np.repeat(np.arange(n), per_text)
        bad = np.zeros(n, bool)
        bad[owner[~encoder.good[codes]]] = True
        # A text counts if its tokens give its bytes, wherever in it those of its stretches may not.
        for k in np.flatnonzero(bad & filled).tolist():
            own = codes[owner == k]
            whole = [b"".join(side.joined(side.ids[side.begin[c] : side.begin[c] + side.count[c]].tolist()) for c in own.tolist()) for side in (encoder.a, encoder.b)]
            filled[k] = whole[0] == whole[1] == (" " + texts[k].as_py()).encode()
        takes = filled[owner]
        codes, owner = codes[takes], owner[takes]
        encoder.uses += np.bincount(codes, minlength=len(encoder.uses))
        a, b = encoder.a, encoder.b
        self.ids_a, self.ids_b = a.ids[gather(a.begin[codes], a.count[codes])], b.ids[gather(b.begin[codes], b.count[codes])]
        upto_a, upto_b = np.cumsum(a.count[codes]), np.cumsum(b.count[codes])
        # A lane begins with each text, and after so many stretches of it unless one of them doesn't give its bytes.
        place = np.arange(len(codes)) - np.searchsorted(owner, owner)
        starts = np.flatnonzero((place == 0) | ((place % LANE_CHUNKS == 0) & ~bad[owner]))
        before = lambda upto: np.concatenate(([0], upto))[starts]
        lane_a, lane_b = before(upto_a), before(upto_b)
        close = lambda lanes, ids: np.concatenate((lanes[1:], [len(ids)])) if len(lanes) else lanes
        ends_a, ends_b = np.cumsum(a.n_bytes[self.ids_a]), np.cumsum(b.n_bytes[self.ids_b])
        self.link_a, self.link_b, meet_a, meet_b = skip_diagonals(ends_a, ends_b, lane_a, close(lane_a, self.ids_a), lane_b, close(lane_b, self.ids_b))
        self.meet_a, self.meet_b = np.zeros(len(self.ids_a), bool), np.zeros(len(self.ids_b), bool)
        self.meet_a[meet_a], self.meet_b[meet_b] = True, True
        sums = lambda side: np.concatenate(([0], np.cumsum(np.bincount(owner, a.count[codes] if side else b.count[codes], n).astype(np.int64))))
        self.at_a, self.at_b = sums(True), sums(False)
        self.text_of = np.repeat(np.arange(n), np.diff(self.at_a))

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each text's groups begin, tokens of A and of B up to the end of each group, over all texts)."""
        meets = np.concatenate(([0], np.cumsum(self.meet_a)))
        return meets[self.at_a], np.flatnonzero(self.meet_a) + 1, np.flatnonzero(self.meet_b) + 1

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many distinct pairs of ids each text links, the pairs, how often)."""
        number = (self.ids_a[self.link_a].astype(np.int64) << B_BITS) + self.ids_b[self.link_b]
        order = np.lexsort((number, self.text_of[self.link_a]))
        text, number = self.text_of[self.link_a][order], number[order]
        new = np.ones(len(order), bool)
        new[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
        first = np.flatnonzero(new)
        return np.bincount(text[first], minlength=len(self.at_a) - 1), number[first], np.diff(np.append(first, len(order)))

    def lines(self, decimals: pa.Array) -> list[str]:
        """A digest of each text's groups, written as a1,a2|b1;a3|b2,b3; empty without tokens."""
        first, upto_a, upto_b = self.groups()
        group_a, group_b = np.cumsum(self.meet_a) - self.meet_a, np.cumsum(self.meet_b) - self.meet_b
        mark_b = np.where(self.meet_b, 2, 0)
        mark_b[self.at_b[1:][np.diff(self.at_b) > 0] - 1] = 3
        codes = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        codes[np.arange(len(self.ids_a)) + np.concatenate(([0], upto_b))[group_a]] = self.ids_a * 4 + self.meet_a
        codes[np.arange(len(self.ids_b)) + upto_a[group_b]] = self.ids_b * 4 + mark_b
        written = decimals.take(pa.array(codes))
        offsets, data = np.frombuffer(written.buffers()[1], np.int64)[: len(codes) + 1] if len(codes) else np.zeros(1, np.int64), written.buffers()[2]
        cuts = offsets[self.at_a + self.at_b].tolist()
        view = memoryview(data) if data is not None else b""
        return [hashlib.sha256(view[i:j]).hexdigest() if j > i else "" for i, j in zip(cuts, cuts[1:], strict=False)]


def decimals_of(size: int) -> pa.Array:
    """Each number below size before a comma, a bar, a semicolon and nothing."""
    return pa.array([f"{i}{mark}" for i in range(size) for mark in (",", "|", ";", "")], pa.large_string())


def _encoder(paths: tuple[str, str]) -> tuple[PairEncoder, pa.Array]:
    if paths not in _encoders:
        made = PairEncoder(*paths)
        _encoders[paths] = made, decimals_of(max(len(made.a.bytes), len(made.b.bytes)))
    return _encoders[paths]


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def align_documents(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """docs with four more columns (a name that is taken gets a `_`): a_ids, b_ids, and a_ends, b_ends, the tokens of either side up to the end of each group.

    Whole texts are encoded; null and empty ones, and those that either tokenizer doesn't give back byte for byte, have empty arrays. All
    columns and rows of docs stay. An empty table gives none.
    """
    names = docs.columns
    added = free_names(names, "a_ids", "b_ids", "a_ends", "b_ends")
    schema = T.StructType([*docs.schema, *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in added)])
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _encoder((path_a, path_b))
        for b in slices(batches, text_at, 1_000_000):
            x = Aligned(encoder, b.column(text_at))
            first, upto_a, upto_b = x.groups()
            per_text = np.diff(first)
            own = [
                _lists(np.diff(x.at_a), x.ids_a, pa.int32()),
                _lists(np.diff(x.at_b), x.ids_b, pa.int32()),
                _lists(per_text, upto_a - np.repeat(x.at_a[:-1], per_text), pa.int32()),
                _lists(per_text, upto_b - np.repeat(x.at_b[:-1], per_text), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], [*names, *added])

    return docs.mapInArrow(run, schema)


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def alignment_rows(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: a number of the row, id, counts, digest of the groups, and the distinct pairs of ids that it links, with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decimals = _encoder((path_a, path_b))
        for b in slices(batches, "text", 1_000_000):
            x = Aligned(encoder, b.column("text"))
            first, _, _ = x.groups()
            n_pairs, pairs, times = x.pairs()
            links = np.bincount(x.text_of[x.link_a], minlength=b.num_rows)
            numbers = [pa.array(v, pa.int64()) for v in (np.diff(x.at_a), np.diff(x.at_b), np.diff(first), links)]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), *numbers, pa.array(x.lines(decimals), pa.string()), _lists(n_pairs, pairs, pa.int64()), _lists(n_pairs, times, pa.int32())],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair of ids is linked, and whether no other pair of its A id is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = materialize(counts)
    most = counts.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, F.shiftright("pair", B_BITS) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent_from(counts: DataFrame, held_pairs: int) -> int:
    """The least power of two so that at most held_pairs pairs are in as many documents or more."""
    steps = sorted(((r.e, r.n) for r in counts.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("e")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = (steps[0][0] + 1 if steps else 0), 0
    for e, n in steps:
        total += n
        if total > held_pairs:
            break
        least = e
    return 1 << least


def alignment_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", held_pairs: int = 1 << 20) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of documents, repeated rows each for itself, in which a token of A with one id overlaps a token of B with the other. The at most held_pairs most frequent
    pairs, 16 bytes each, are broadcast; a rarer one meets its documents in a shuffle, in which no key has more rows than the least frequent of
    the others, so that no pair is lost and none is hot. Null and empty texts, and those that a tokenizer doesn't give back, have no tokens: zeros and an
    empty digest. Other columns are ignored; an empty table gives none.
    """
    aligned = materialize(alignment_rows(docs, path_a, path_b, id_col, text_col))
    counts = materialize(pair_counts(aligned))
    least = frequent_from(counts, held_pairs)
    table = counts.filter(F.col("n") >= least).select("pair", "n", F.col("best").cast("long").alias("best")).toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    keys, values = table.column("pair").to_numpy()[order], (table.column("n").to_numpy() * 2 + table.column("best").to_numpy())[order]
    held = docs.sparkSession.sparkContext.broadcast((keys, values))
    plain = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = held.value
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times").flatten().to_numpy()
            per_row = np.diff(pairs.offsets.to_numpy())
            flat = pairs.flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            value = np.where(hit, values[at], 0) if len(keys) else np.zeros(len(flat), np.int64)
            ends = np.cumsum(per_row)
            sums = [np.concatenate(([0], np.cumsum(v * times))) for v in (value & 1, value >> 1)]
            parts = [pa.array(s[ends] - s[ends - per_row], pa.int64()) for s in sums]
            rest = np.diff(np.concatenate(([0], np.cumsum(~hit)))[np.concatenate(([0], ends))])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in plain), *parts, _lists(rest, flat[~hit], pa.int64()), _lists(rest, times[~hit], pa.int32())], [*plain, "n_best", "count_sum", "rest", "rest_times"])

    scored = aligned.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<long>, rest_times array<int>")
    scored = materialize(scored)
    rare = counts.filter(F.col("n") < least)
    met = scored.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("t"))
    more = met.join(rare, "pair").groupBy("row").agg(F.sum(F.col("t") * F.col("best").cast("int")).alias("more_best"), F.sum(F.col("t") * F.col("n")).alias("more_sum"))
    with_rest = lambda mine, other: (F.col(mine) + F.coalesce(F.col(other), F.lit(0))).cast("long").alias(mine)
    return scored.join(more, "row", "left").select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", with_rest("n_best", "more_best"), with_rest("count_sum", "more_sum"), "groups_sha256")
