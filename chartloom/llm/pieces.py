"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice.

The vocabulary is that of a public model file. Its scores are merge ranks, so the probability of a piece is taken from Zipf's law
over the rank; bytes of characters outside the vocabulary have a small probability of their own. The lattice of a text falls apart
exactly where white space begins, as no piece crosses such a place, so it is built once for each distinct word, and a worker holds
those of frequent words. Each occurrence of a word is sampled on its own, by numbers that depend on the row's key and the place only.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.common import slices

SPACE = "▁"
SEGMENT = regex.compile(r" +[^ ]*")
#: Odds are whole parts of this, so that they add up in the same way everywhere.
ODDS_BITS = 31
#: An edge as one number: where it ends above EDGE_BITS, its length above PIECE_BITS, its piece; BARE is a character outside the vocabulary.
EDGE_BITS, PIECE_BITS, BARE = 20, 15, (1 << 15) - 1
ODDS = 1 << ODDS_BITS
STEP = np.uint64(0xD1B54A32D192ED03)
#: Words with more characters are filtered one by one and not held; so few walks are taken one by one.
LONG, FEW = 200, 4
#: Bounds of what a worker holds: words, and edges of 16 bytes.
HELD_WORDS, HELD_EDGES = 160_000, 4_000_000


class PieceModel:
    """Pieces of a model file with probabilities for sampling."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = [b""] * n
        self.byte_id = [0] * 256
        self.size = n
        self.log_p = np.full(n, -np.inf)
        found: dict[str, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes[i] = bytes([value])
                # A byte is as likely as the rarest piece, and less by the number of bytes.
                self.log_p[i] = -alpha * np.log(n + 10.0) - np.log(256.0)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} crosses a word boundary")
                text = piece.replace(SPACE, " ")
                self.bytes[i] = text.encode()
                self.log_p[i] = -alpha * np.log(-model.get_score(i) + 10.0)
                found[text] = i
        # Pieces by length: sorted hashes, their ids, and a bit map that tells most other strings apart at once.
        self.known = {}
        for length in sorted({len(t) for t in found}):
            own = [t for t in found if len(t) == length]
            codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
            h = np.zeros(len(own), np.uint64)
            for k in range(length):
                h = _roll(h, codes[k::length])
            order = np.argsort(h)
            seen = np.zeros(1 << 20, bool)
            seen[(h >> np.uint64(44)).astype(np.int64)] = True
            self.known[length] = (h[order], np.array([found[t] for t in own])[order], seen)
        if n > BARE or max(self.known) >= 1 << EDGE_BITS - PIECE_BITS or 1 not in self.known:
            raise ValueError("the vocabulary is too large, has too long pieces, or no single characters")
        self.n_bytes = np.fromiter(map(len, self.bytes), np.int64, n)
        self.byte_at = np.cumsum(self.n_bytes) - self.n_bytes
        self.byte_line = np.frombuffer(b"".join(self.bytes), np.uint8)
        # Lattices of words that were met before, one after the other.
        self.number: dict[str, int] = {}
        self.n_edges = self.n_places = 0
        self.cumulated, self.length, self.piece = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.last, self.upto, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def lattice(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Edges of the words' lattices, by place where they end: (cumulated odds, length, piece, last place of each word, where
        its edges end).

        A place is a position in a word, counted over all words. The cumulated odds of a place's edges rise from place * ODDS to
        (place + 1) * ODDS. A character outside the vocabulary is one edge with piece -1 - code point; it is spelled in bytes later.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        offset = np.concatenate(([0], np.cumsum(lengths + 1)))
        # All substrings of one length at a time, by their hashes; a character that no piece has stands between words.
        line = "\0".join(words) + "\0"
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = []
        h = np.zeros(len(codes), np.uint64)
        for length in range(1, min(max(self.known), int(lengths.max(initial=0))) + 1):
            h = _roll(h[: len(codes) - length + 1], codes[length - 1 :])
            if length in self.known:
                hashes, ids, seen = self.known[length]
                maybe = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == h[maybe])
                # An edge as one number: where it ends, its length, its piece.
                edges.append((maybe[hit] + length << EDGE_BITS) + (length << PIECE_BITS) + ids[at[hit]])
        places = int(offset[-1])
        inner = np.ones(places, bool)
        inner[offset[:-1]] = False
        inner[edges[0] >> EDGE_BITS] = False
        bare = np.flatnonzero(inner)
        edges.append((bare << EDGE_BITS) + (1 << PIECE_BITS) + BARE)
        packed = np.sort(np.concatenate(edges))
        end, size, piece = packed >> EDGE_BITS, packed >> PIECE_BITS & ((1 << EDGE_BITS - PIECE_BITS) - 1), packed & BARE
        log_p = self.log_p[np.minimum(piece, self.size - 1)]
        bare = np.flatnonzero(piece == BARE)
        code = codes[end[bare] - 1].astype(np.int64)
        piece[bare] = -1 - code
        n_bytes = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        log_p[bare] = n_bytes * self.log_p[self.byte_id[0]]
        start = end - size
        first = np.searchsorted(end, np.arange(places + 1))
        alpha = np.zeros(places)
        weight = np.zeros(len(end))
        long = np.flatnonzero(lengths > LONG)
        for k in long:
            self._filter_long(int(offset[k]), int(offset[k + 1]), first, start, log_p, alpha, weight)
        # Forward filtering, all other words together, one position after the other.
        position = np.arange(places) - np.repeat(offset[:-1], lengths + 1)
        if len(long):
            position[np.repeat(lengths > LONG, lengths + 1)] = 0
        by_position = np.argsort(position, kind="stable")
        cuts = np.searchsorted(position[by_position], np.arange(1, min(LONG, int(lengths.max(initial=0))) + 2))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                break
            at = by_position[a:b]
            count = first[at + 1] - first[at]
            begin = np.concatenate(([0], np.cumsum(count)[:-1]))
            edge = np.repeat(first[at] - begin, count) + np.arange(int(count.sum()))
            score = alpha[start[edge]] + log_p[edge]
            top = np.maximum.reduceat(score, begin)
            odds = np.exp(score - np.repeat(top, count))
            alpha[at] = top + np.log(np.add.reduceat(odds, begin))
            weight[edge] = np.exp(score - np.repeat(alpha[at], count))
        # Cumulated over the edges of a place only, so that a word's odds are the same among any other words.
        rank = np.arange(len(end)) - first[end]
        for r in range(1, int(rank.max(initial=0)) + 1):
            at = np.flatnonzero(rank == r)
            weight[at] += weight[at - 1]
        cumulated = end * ODDS + np.minimum(np.rint(weight * ODDS).astype(np.int64), ODDS)
        last = first[1:][np.diff(first) > 0] - 1
        cumulated[last] = (end[last] + 1) * ODDS
        return cumulated, size.astype(np.int32), piece.astype(np.int32), offset[1:] - 1, first[offset[1:]]

    def _filter_long(self, home: int, stop: int, first, start, log_p, alpha, weight) -> None:
        """Forward filtering of one word with many characters, in plain numbers."""
        lo, hi = int(first[home]), int(first[stop])
        begin, come, score = (first[home : stop + 1] - lo).tolist(), (start[lo:hi] - home).tolist(), log_p[lo:hi].tolist()
        best, odds = [0.0] * (stop - home), [0.0] * (hi - lo)
        for p in range(1, stop - home):
            a, b = begin[p], begin[p + 1]
            here = [best[come[e]] + score[e] for e in range(a, b)]
            top = max(here)
            best[p] = top + math.log(sum(math.exp(x - top) for x in here))
            odds[a:b] = [math.exp(x - best[p]) for x in here]
        alpha[home:stop], weight[lo:hi] = best, odds

    def learn(self, words: list[str]) -> None:
        """Add the lattices of words that aren't held yet."""
        new = [w for w in words if w not in self.number]
        if not new:
            return
        cumulated, size, piece, last, upto = self.lattice([" " + w for w in new])
        n = self.n_edges + len(size)
        if n > len(self.cumulated):
            for name in ("cumulated", "length", "piece"):
                old = getattr(self, name)
                grown = np.empty(max(n, 2 * len(old)), old.dtype)
                grown[: self.n_edges] = old[: self.n_edges]
                setattr(self, name, grown)
        self.cumulated[self.n_edges : n] = cumulated + self.n_places * ODDS
        self.length[self.n_edges : n] = size
        self.piece[self.n_edges : n] = piece
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.last = np.concatenate((self.last, last + self.n_places))
        self.upto = np.concatenate((self.upto, upto + self.n_edges))
        self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int64)))
        self.n_edges, self.n_places = n, int(self.n_places + last[-1] + 1)

    def forget(self) -> None:
        """If too much is held, keep the half of the words that is used most."""
        if len(self.number) <= HELD_WORDS and self.n_edges <= HELD_EDGES:
            return
        size, count = np.diff(self.last, prepend=-1), np.diff(self.upto, prepend=0)
        keep = (self.uses >= max(2, int(np.median(self.uses)))) & (size <= LONG)
        kept = np.repeat(keep, count)
        shift = (np.cumsum(np.where(keep, 0, size)))[keep]
        n = int(kept.sum())
        self.cumulated[:n] = self.cumulated[: self.n_edges][kept] - np.repeat(shift, count[keep]) * ODDS
        self.length[:n], self.piece[:n] = self.length[: self.n_edges][kept], self.piece[: self.n_edges][kept]
        self.last, self.upto, self.uses = self.last[keep] - shift, np.cumsum(count[keep]), self.uses[keep] // 2
        self.number = dict(zip(compress(self.number, keep.tolist()), range(len(self.last)), strict=True))
        self.n_edges, self.n_places = n, int(self.last[-1] + 1) if len(self.last) else 0

    def encode_flat(self, texts: pa.Array, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts one after the other, where each text's end), sampled.

        A text is sampled in the same way wherever it stands with the same key. A null or empty text has no pieces.
        """
        self.forget()
        words, counts = words_of(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if not distinct:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        self.learn(distinct)
        which = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        self.uses += np.bincount(which, minlength=len(self.uses))
        seeds = np.array([int.from_bytes(hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for k in keys], np.uint64)
        place_in_text = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        # Equal words stand together, so that the look-ups go through the edges in order.
        order = np.argsort(which)
        word = which[order]
        seed = (np.repeat(seeds, counts) + place_in_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[order]
        at, home = self.last[word], np.concatenate(([0], self.last[:-1] + 1))[word]
        cumulated, length, piece = self.cumulated[: self.n_edges], self.length, self.piece
        alive = np.arange(len(word))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(alive) > FEW:
            seed += STEP
            edge = np.searchsorted(cumulated, at * ODDS + _uniform(seed), side="right")
            steps.append((alive, piece[edge]))
            at = at - length[edge]
            go = np.flatnonzero(at > home)
            at, home, seed, alive = at[go], home[go], seed[go], alive[go]
        rounds = len(steps)
        taken = [np.repeat(np.arange(rounds), [len(a) for a, _ in steps])]
        for occurrence, x, begin, state in zip(alive.tolist(), at.tolist(), home.tolist(), seed.tolist(), strict=True):
            # The last few words, mostly long ones, one by one.
            found = []
            while x > begin:
                state = (state + int(STEP)) & 0xFFFFFFFFFFFFFFFF
                edge = bisect_right(cumulated, x * ODDS + _uniform_one(state))
                found.append(int(piece[edge]))
                x -= int(length[edge])
            steps.append((np.full(len(found), occurrence), np.array(found, np.int32)))
            taken.append(np.arange(rounds, rounds + len(found)))
        return self._forward(order[np.concatenate([a for a, _ in steps])], np.concatenate([p for _, p in steps]), np.concatenate(taken), counts)

    def _forward(self, word: np.ndarray, piece: np.ndarray, step: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps were taken from the end of each word: put their pieces into reading order and spell out bytes."""
        base = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=int(counts.sum())))))
        line = np.empty(len(piece), np.int32)
        line[base[word + 1] - 1 - step] = piece
        ends = base[np.cumsum(counts)]
        bare = np.flatnonzero(line < 0)
        if not len(bare):
            return line, ends
        codes, which = np.unique(-1 - line[bare], return_inverse=True)
        spelled = [[self.byte_id[x] for x in chr(c).encode("utf-8", "surrogatepass")] for c in codes.tolist()]
        long = np.array([len(x) for x in spelled])[which]
        sizes = np.ones(len(line), np.int64)
        sizes[bare] = long
        out = np.repeat(line, sizes)
        at = np.concatenate(([0], np.cumsum(sizes)))
        bytes_of = np.array([x + [0] * (4 - len(x)) for x in spelled], np.int32)
        for k in range(4):
            some = long > k
            out[at[bare[some]] + k] = bytes_of[which[some], k]
        return out, at[ends]

    def encode(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """Sampled piece ids of each whole text."""
        ids, ends = self.encode_flat(pa.array(texts, pa.string()), keys)
        return np.split(ids, ends[:-1])

    def decode(self, ids) -> str:
        """The text of a segmentation: pieces end to end, without the space that stands before every text."""
        return self.raw(ids).decode("utf-8", "surrogatepass")[1:]

    def raw(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        n = self.n_bytes[ids]
        total = int(n.sum())
        at = np.repeat(self.byte_at[ids] - (np.cumsum(n) - n), n)
        at += np.arange(total)
        return self.byte_line[at].tobytes()

    def come_back(self, ids: np.ndarray, ends: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Whether each text is what its ids decode to; all are decoded at once, and compared with all texts end to end."""
        want = [" " + t if t else "" for t in texts.to_pylist()]
        n_bytes = np.concatenate(([0], np.cumsum(self.n_bytes[ids])))[ends]
        lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if np.array_equal(n_bytes, np.cumsum(lengths + (lengths > 0))) and self.raw(ids) == "".join(want).encode():
            return np.ones(len(texts), bool)
        return np.array([self.raw(x) == w.encode() for x, w in zip(np.split(ids, ends[:-1]), want, strict=True)], bool)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, number of each text's): what the lattices fall apart into, each without the one space before it."""
    there = pc.not_equal(texts, "").fill_null(False)
    texts = texts.filter(there)
    counts = np.zeros(len(there), np.int64)
    spaced = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
    if pc.any(spaced).as_py():
        split = [[w[1:] for w in SEGMENT.findall(" " + t)] for t in texts.to_pylist()]
        flat, n = pa.array([w for words in split for w in words], pa.string()), list(map(len, split))
    else:
        lists = pc.split_pattern(texts, " ")
        flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy()
    counts[there.to_numpy(zero_copy_only=False)] = n
    return flat, counts


def _roll(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hash of a string one character longer."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (h + (mixed ^ (mixed >> np.uint64(31)))) * np.uint64(0xC2B2AE3D27D4EB4F)


def _uniform(seed: np.ndarray) -> np.ndarray:
    """Whole numbers in [0, ODDS) from 64-bit states."""
    z = (seed ^ (seed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(64 - ODDS_BITS)).astype(np.int64)


def _uniform_one(state: int) -> int:
    return int(_uniform(np.array([state], np.uint64))[0])


_models: dict = {}


def load(path: str, alpha: float) -> PieceModel:
    if (path, alpha) not in _models:
        _models[path, alpha] = PieceModel(path, alpha)
    return _models[path, alpha]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """docs with a column piece_ids (array of int): a sampled segmentation of each whole text.

    The sample depends on the seed, the id and the text only; rows that repeat get the same one. Null and empty texts have no
    pieces; rows with a null id share one key. All columns stay (one named piece_ids before is replaced). An empty table gives none.
    """
    docs = docs.drop("piece_ids")
    names, place, ident = docs.columns, docs.columns.index(text_col), docs.columns.index(id_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, alpha)
        for b in slices(batches, place, 1_000_000):
            ids, ends = model.encode_flat(b.column(place), [f"{seed}:{i}" for i in b.column(ident).to_pylist()])
            column = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*b.columns, column], [*names, "piece_ids"])

    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """(id, text): the texts of segmentations; a null list has a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, 1.0)
        for b in batches:
            texts = [None if x is None else model.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def segmentation_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, n_pieces, ids_crc32, lossless) of sampled segmentations, with no list leaving its task.

    ids_crc32 is over the ids as little-endian 32-bit integers; lossless: decoding gives the text back. Null counts as empty; a null id is a key like others. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, alpha)
        for b in slices(batches, "text", 1_000_000):
            ids = b.column("id").to_pylist()
            texts = b.column("text")
            coded, ends = model.encode_flat(texts, [f"{seed}:{i}" for i in ids])
            begins = np.concatenate(([0], ends[:-1]))
            data = coded.astype("<i4").tobytes()
            yield pa.RecordBatch.from_pydict(
                {
                    "id": b.column("id"),
                    "n_pieces": pa.array(ends - begins),
                    "ids_crc32": pa.array([zlib.crc32(data[4 * a : 4 * e]) for a, e in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    "lossless": pa.array(model.come_back(coded, ends, texts)),
                }
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_pieces long, ids_crc32 long, lossless boolean").withColumnRenamed("id", id_col)
