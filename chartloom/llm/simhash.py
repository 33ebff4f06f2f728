"""SimHash near-duplicates by a self-join of binary tries over the fingerprints.

Distinct fingerprints are the leaves of a binary trie. The join walks pairs of nodes together from
the top, adds up the bits in which their paths differ and drops a pair as soon as the sum is above the budget.

To spread the walk, the trie is built once for each pair of blocks of bits, of which there are the budget plus two: two of so many
blocks at least are equal in two fingerprints within the budget, so in the trie that puts these two on top the walk
may start at the nodes below them, each paired with itself only. Such a node, some 21 bits deep, is an item of work: with 10^9
distinct fingerprints it has some 500 leaves, and a fingerprint stands in 15 items. A node with very many leaves is cut into chunks, and each
pair of chunks is an item; so no item is large and none is left out. An item returns a forest of its links, not all pairs, with few edges at each vertex.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.common import keep_by_key, materialize, slices
from chartloom.llm.components import connected_components

BITS = 64


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42, piece: int = 65_536) -> int:
    """SimHash of UTF-8 bytes: A-Z lower-cased, words between ASCII white space, shingles with repeats.

    A bit is set if it is set in over half of the shingles' XXH64. Fewer words than a shingle make one
    shingle; no word gives 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[len(words) - n :]
    hash_of = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, piece):
        hashes = np.array([hash_of(line[a:b], seed) for a, b in zip(starts[i : min(n, i + piece)].tolist(), last[i : i + piece].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, keep: list[str] = ()) -> DataFrame:
    """(id, columns to keep, fp long): one row per input row; a null text has no words."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *keep, F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", *keep)), pa.array(fps.view(np.int64))], ["id", *keep, "fp"])

    return rows.mapInArrow(run, T.StructType([*rows.drop("text").schema.fields, T.StructField("fp", T.LongType())]))


def trie_join(item: np.ndarray, side: np.ndarray, fp: np.ndarray, skip: int, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within items: (order, i, j), where i and j index the rows in `order`.

    Rows of side 0 and 1 of an item are two tries joined with each other; an item with side 0 only is joined with
    itself. `skip` top bits are equal within an item. Links of a run of neighbours in sorted order count as
    found from the start, and pairs of nodes within one such run aren't walked: their leaves are connected.
    """
    order = np.lexsort((fp, item))
    item, side, fp = item[order], side[order], fp[order]
    n = len(fp)
    near = (item[1:] == item[:-1]) & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= budget)
    links_i, links_j = [np.flatnonzero(near)], [np.flatnonzero(near) + 1]
    run = np.concatenate(([0], np.cumsum(~near)))
    # Leaves in order of item, side, fingerprint; a node is a range of them.
    leaf = np.lexsort((fp, side, item))
    bits, runs = fp[leaf], run[leaf]
    tree = item[leaf] * 2 + side[leaf]
    first = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
    lo, hi = first, np.concatenate((first[1:], [n]))
    of = item[leaf][first]
    twin = np.flatnonzero(of[1:] == of[:-1])
    alone = np.setdiff1d(np.arange(len(first)), np.concatenate((twin, twin + 1)))
    a, b = np.concatenate((twin, alone)), np.concatenate((twin + 1, alone))
    diff = np.zeros(len(a), np.int8)
    for level in range(skip, BITS):
        if not len(a):
            break
        ones = np.concatenate(([0], np.cumsum((bits >> np.uint64(BITS - 1 - level)) & np.uint64(1)))).astype(np.int64)
        mid = hi - (ones[hi] - ones[lo])
        left, right = mid > lo, hi > mid
        at = np.empty((2, len(lo)), np.int64)
        at[0] = np.where(left, np.cumsum(left) - 1, -1)
        at[1] = np.where(right, np.cumsum(right) - 1 + left.sum(), -1)
        same = a == b
        new_a = np.concatenate((at[0, a], at[1, a], at[0, a], at[1, a]))
        new_b = np.concatenate((at[0, b], at[1, b], at[1, b], np.where(same, -1, at[0, b])))
        diff = np.concatenate((diff, diff, diff + 1, diff + 1))
        lo, hi = np.concatenate((lo[left], mid[right])), np.concatenate((mid[left], hi[right]))
        keep = (new_a >= 0) & (new_b >= 0) & (diff <= budget)
        a, b, diff = new_a[keep], new_b[keep], diff[keep]
        known = (runs[lo[a]] == runs[hi[a] - 1]) & (runs[lo[a]] == runs[lo[b]]) & (runs[lo[a]] == runs[hi[b] - 1])
        single = (hi[a] - lo[a] == 1) & (hi[b] - lo[b] == 1)
        ends = np.flatnonzero(single & ~known)
        x, y = lo[a[ends]], lo[b[ends]]
        hit = np.bitwise_count(bits[x] ^ bits[y]) <= budget
        links_i.append(leaf[x[hit]])
        links_j.append(leaf[y[hit]])
        go = ~(single | known)
        a, b, diff = a[go], b[go], diff[go]
    return order, np.concatenate(links_i), np.concatenate(links_j)


def local_forest(n: int, i: np.ndarray, j: np.ndarray, fan: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Edges child -> parent of a shallow tree over each connected part of a graph, few at each vertex."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        if (low == np.maximum(label[i], label[j])).all():
            break
        for end in (i, j):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while (label[label] != label).any():
            label = label[label]
    order = np.argsort(label, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], label[order][1:] != label[order][:-1])))
    head = np.repeat(heads, np.diff(np.concatenate((heads, [n]))))
    place = np.arange(n) - head
    child = np.flatnonzero(place > 0)
    return order[child], order[head[child] + (place[child] - 1) // fan]


def block_pairs(budget: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each pair of budget + 2 blocks: the blocks (first bit, width) in the trie's order, that pair first, and its width."""
    n = budget + 2
    widths = [BITS // n + (i < BITS % n) for i in range(n)]
    blocks = [(sum(widths[:i]), w) for i, w in enumerate(widths)]
    return [([blocks[i], blocks[j], *(b for k, b in enumerate(blocks) if k not in (i, j))], widths[i] + widths[j]) for i in range(n) for j in range(i + 1, n)]


def turned(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with their blocks of bits in another order."""
    out = np.zeros(len(fp), np.uint64)
    for at, width in order:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(BITS - at - width)) & np.uint64((1 << width) - 1))
    return out


def work_items(fps: DataFrame, budget: int = 4, chunk: int = 4096) -> DataFrame:
    """(item, side, trie, fp): each distinct fingerprint once per trie, and more often only in nodes of over `chunk` leaves."""
    pairs = block_pairs(budget)
    bits = lambda at, width: F.shiftrightunsigned(F.shiftleft("fp", at) if at else F.col("fp"), BITS - width)
    top = [F.shiftleft(bits(*order[0]), order[1][1]).bitwiseOR(bits(*order[1])) for order, _ in pairs]
    # A node as one number: its trie above its top bits.
    nodes = F.array(*[F.lit(k << 24) + t for k, t in enumerate(top)])
    leaves = fps.select("fp", F.posexplode(nodes).alias("trie", "node"))
    chunks = leaves.groupBy("node").count().filter(F.col("count") > chunk).select("node", F.ceil(F.col("count") / chunk).alias("k"))
    cut = leaves.join(chunks, "node", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")))
    return cut.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select(
        ((F.col("node") * (1 << 17) + F.least("c", "o")) * (1 << 17) + F.greatest("c", "o")).alias("item"),
        (F.col("c") > F.col("o")).cast("int").alias("side"),
        "trie",
        "fp",
    )


def near_links(fps: DataFrame, budget: int = 4, chunk: int = 4096, block_rows: int = 8192) -> DataFrame:
    """Distinct fingerprints (fp) -> (src, dst): pairs of them whose connected parts are those of all links."""
    pairs = block_pairs(budget)
    least = min(w for _, w in pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(item, side, trie, fp):
            bits = np.empty(len(fp), np.uint64)
            for t in np.unique(trie):
                at = trie == t
                bits[at] = turned(fp[at].view(np.uint64), pairs[t][0])
            _, where = np.unique(item, return_inverse=True)
            order, i, j = trie_join(where, side, bits, least, budget)
            child, parent = local_forest(len(fp), i, j)
            fp = fp[order]
            return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[parent])], ["src", "dst"])

        held = None
        for b in batches:
            new = [b.column(c).to_numpy() for c in ("item", "side", "trie", "fp")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            while len(held[0]) >= 2 * block_rows:
                # Cut where an item ends.
                stop = np.searchsorted(held[0], held[0][block_rows], side="left") or np.searchsorted(held[0], held[0][block_rows], side="right")
                if stop == len(held[0]):
                    break
                yield solve(*(x[:stop] for x in held))
                held = [x[stop:] for x in held]
        if held is not None and len(held[0]):
            yield solve(*held)

    return work_items(fps, budget, chunk).repartition("item").sortWithinPartitions("item").mapInArrow(run, "src long, dst long")


def fingerprint_classes(fps: DataFrame, budget: int) -> DataFrame:
    """(fp, class): for each distinct fingerprint of a table the least one that it is linked with, itself included."""
    distinct = materialize(fps.select("fp").distinct())
    linked = connected_components(near_links(distinct, budget))
    return materialize(distinct.join(linked, distinct["fp"] == linked["v"], "left").select("fp", F.coalesce("component", "fp").alias("class")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, shingle: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at `budget` or fewer differing bits; component_id is the smallest id reachable. A null or empty
    text has fingerprint zero and links like any other. Rows with one id are rows like others, each with its own fingerprint. A row
    without an id links too, but its own id is never the smallest; if no row that it reaches has an id, component_id is null. An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    classes = fingerprint_classes(fps, budget)
    least = fps.groupBy("fp").agg(F.min("id").alias("id")).join(classes, "fp").groupBy("class").agg(F.min("id").alias("component_id"))
    found = materialize(classes.join(least, "class").select("fp", "component_id"))
    return fps.join(found, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, shingle: int = 4) -> DataFrame:
    """One row of each group of linked fingerprints stays, with all its columns: the one with the smallest id.

    A row without an id stays only where none of its group has one. Among rows with that id the one with the smallest hash of the
    text stays; of rows equal in id and text one. Null and empty texts are one group. An empty table gives no rows.
    """
    digest = F.xxhash64(F.col(text_col))
    named = docs.select(F.col(id_col).cast("long").alias("id"), digest.alias("digest"), F.col(text_col).cast("binary").alias("text"))
    fps = materialize(fingerprints(named, "id", "text", shingle, ["digest"]))
    classes = fingerprint_classes(fps, budget)
    keys = fps.groupBy("id", "digest", "fp").agg(F.count("*").alias("n")).join(classes, "fp")
    ranked = F.struct(F.col("id").isNull().alias("none"), "id", "digest", "fp")
    winners = materialize(keys.groupBy("class").agg(F.min_by(F.struct("id", "digest", "fp", "n"), ranked).alias("w")))
    best = winners.select("class", "w.*")
    losers = materialize(keys.join(best.select("class", F.col("id").alias("wid"), F.col("digest").alias("wdigest")), "class").filter(~(F.col("id").eqNullSafe(F.col("wid")) & F.col("digest").eqNullSafe(F.col("wdigest")))).select("id", "digest").distinct())
    return keep_by_key(docs, {"id": F.col(id_col).cast("long"), "digest": digest}, losers, best.filter("n > 1").select("id", "digest"))
