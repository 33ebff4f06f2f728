"""Nearest neighbours by inner product: stable projections to few dimensions, kept in a kd-tree of cells and leaves.

Vectors become points of a unit sphere in one dimension more (x / M and what is left, M being the largest norm), queries are
scaled to length one, and then the largest inner product is the least distance. Normal random numbers project points to a few
dimensions: a projected squared distance is the squared distance times a chi-square variable. So a query takes leaves by rising projected
distance, verifies their vectors, and stops where the next leaf is so far that anything at the k-th best distance would be nearer with the given
confidence: projected distance squared >= chi-square quantile * k-th best distance squared. Nothing else is dropped, so the expected recall is at least the confidence.

The upper tree is fitted to a bounded sample of projections and cuts all rows into cells; a cell's own tree is built where the cell is searched. Each query
first searches the cell nearest to it for a bound, then visits the cells within its radius, in any of which it stops by the same test.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.common import materialize, unit_hash

#: Rows of the sample that the upper tree is fitted to: so many for each cell, and so many at least.
SAMPLE_PER_CELL, LEAST_SAMPLE = 16, 20_000


def chi_square(x: float, m: int) -> float:
    """The distribution function with an even number m of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, m) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, m) < p else (low, middle)
    return high


class Projection:
    """Points of the sphere and their projections; the same for all tasks by the seed."""

    def __init__(self, size: int, longest: float, dims: int, seed: int):
        self.longest = longest
        self.rows = np.random.default_rng(seed).standard_normal((size + 1, dims))

    def points(self, x: np.ndarray) -> np.ndarray:
        scaled = x / self.longest
        left = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
        return scaled @ self.rows[:-1] + left[:, None] * self.rows[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q / np.linalg.norm(q, axis=1)[:, None]) @ self.rows[:-1]


class UpperTree:
    """A complete binary tree of cuts at medians of a sample, along the widest dimension."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.dim, self.cut = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
        held = {0: sample}
        for node in range(len(self.dim)):
            own = held.pop(node)
            if len(own):
                self.dim[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                self.cut[node] = float(np.median(own[:, self.dim[node]]))
            right = own[:, self.dim[node]] > self.cut[node]
            if 2 * node + 2 < len(self.dim):
                held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dim[node]] > self.cut[node])
        return node - len(self.dim)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d : d + 1]
        gap = np.maximum(np.maximum(low[:, d] - p, p - high[:, d]), 0.0)
        out += gap * gap
    return out


class Leaves:
    """The points of a cell in leaves of a kd-tree, cut at ranks along the widest dimension, so that ties are no burden."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        todo, self.rows = [np.arange(len(points))], []
        while todo:
            own = todo.pop()
            if len(own) <= leaf_rows:
                self.rows.append(own)
                continue
            at = points[own]
            line = at[:, int(np.argmax(at.max(axis=0) - at.min(axis=0)))]
            order = np.argpartition(line, len(own) // 2)
            todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
        self.low = np.array([points[r].min(axis=0) for r in self.rows])
        self.high = np.array([points[r].max(axis=0) for r in self.rows])


class Cell:
    """Vectors of a cell, each with the ids of the rows that have it."""

    def __init__(self, vectors: np.ndarray, points: np.ndarray, ids: np.ndarray, first: np.ndarray, leaf_rows: int):
        self.vectors, self.ids, self.first = vectors, ids, first
        self.leaves = Leaves(points, leaf_rows)

    def search(self, vectors: np.ndarray, points: np.ndarray, bound: np.ndarray, longest: float, k: int, quantile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best rows found for each query, those that score below its bound left out.

        Leaves are taken by rising projected distance, one, then ever more at a time, until the next is beyond the stopping radius.
        """
        norm = np.linalg.norm(vectors, axis=1)
        slack = 1e-12 * norm * longest
        away = box_distances(points, self.leaves.low, self.leaves.high)
        order = np.argsort(away, axis=1, kind="stable")
        sorted_away = np.take_along_axis(away, order, axis=1)
        worst = bound.copy()
        q_all, id_all, s_all = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 1
        while at < order.shape[1]:
            radius = quantile * np.maximum(0.0, 2.0 - 2.0 * (worst - slack) / (norm * longest))
            takes = sorted_away[:, at : at + step] <= radius[:, None]
            if not takes.any():
                break
            q, leaf = np.nonzero(takes)
            leaf = order[q, at + leaf]
            by_leaf = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
            found_q, found_p = [], []
            for own in np.split(by_leaf, cuts):
                asked, rows = q[own], self.leaves.rows[leaf[own[0]]]
                hit_q, hit_p = np.nonzero(vectors[asked] @ self.vectors[rows].T >= (worst - slack)[asked, None])
                found_q.append(asked[hit_q])
                found_p.append(rows[hit_p])
            q, p = np.concatenate(found_q), np.concatenate(found_p)
            # One order of additions for all, so that equal vectors score alike.
            score = np.add.reduce(vectors[q] * self.vectors[p], axis=1)
            times = self.first[p + 1] - self.first[p]
            take = np.repeat(self.first[p] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            q_all, id_all, s_all = (np.concatenate(x) for x in ((q_all, np.repeat(q, times)), (id_all, self.ids[take]), (s_all, np.repeat(score, times))))
            best = np.lexsort((id_all, -s_all, q_all))
            q_all, id_all, s_all = q_all[best], id_all[best], s_all[best]
            place = np.arange(len(q_all)) - np.searchsorted(q_all, q_all)
            kth = place == k - 1
            worst[q_all[kth]] = np.maximum(worst[q_all[kth]], s_all[kth])
            top = (place < k) & (s_all >= bound[q_all])
            q_all, id_all, s_all = q_all[top], id_all[top], s_all[top]
            at, step = at + step, 2 * step
        return q_all, id_all, s_all


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part: with an id, and a vector that isn't empty or zero and whose components are all finite numbers."""
    kind = rows.schema[vector_col].dataType.elementType
    vector = F.col(vector_col) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(vector_col).cast("array<double>")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    good = F.forall("vector", number) & F.exists("vector", lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).filter(F.col("id").isNotNull() & good)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel(), kind))


ITEM = "cell int, sub int, salt int, kind int, key long, bound double, at array<double>, ids array<long>"


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 8, confidence: float = 0.97,
    cell_rows: int = 4096, leaf_rows: int = 64, visits_per_item: int = 2048, seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows with the largest inner products that are found, ties by smaller id; all rows if they are
    fewer. A row with the query's id is none of its candidates.

    Rows without an id, and vectors that are null, empty or zero or hold null or non-finite components, take no part, nor do vectors of
    another length than most (ties: the shorter). Rows equal in id and vector count once; a query id with several vectors has a list for each. No
    rows or no queries give nothing. Other columns are ignored.
    Equal vectors are one point with its k + 1 smallest ids, which no answer goes beyond, so large groups of copies are searched once. Of the
    rows, about one in 256 is sampled for the upper tree (20,000 at least). Cells hold cell_rows points or so; those with over four times as many are cut by a hash,
    and those that many queries visit are searched by several tasks, each for some of them.
    """
    spark = rows.sparkSession
    known, asked = usable(rows, id_col, vector_col), usable(queries, id_col, vector_col)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    common = known.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("longest")).orderBy(F.desc("n"), "size").first()
    result = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], result)
    size, n, longest = common
    known, asked = known.filter(F.size("vector") == size), asked.filter(F.size("vector") == size).distinct()
    projection, quantile = Projection(size, longest, dims, seed), chi_square_quantile(confidence, dims)
    levels = max(0, math.ceil(math.log2(n / cell_rows)))
    share = max(LEAST_SAMPLE, SAMPLE_PER_CELL << levels) / n
    sample = _matrix(known.filter(unit_hash(F.col("id"), seed) < share).select("vector").toArrow().column("vector").combine_chunks())
    tree = UpperTree(projection.points(np.unique(sample.reshape(-1, size), axis=0)), levels)

    least_ids = Window.partitionBy("vector").orderBy("id")
    distinct = known.withColumn("n", F.dense_rank().over(least_ids)).filter(F.col("n") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    kind = distinct.schema["vector"].dataType.elementType
    arrow_kind = pa.float32() if isinstance(kind, T.FloatType) else pa.float64()
    vector_field = f"vector array<{kind.simpleString()}>"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = projection.points(_matrix(b.column("vector"))) if b.num_rows else np.zeros((0, dims))
            yield pa.RecordBatch.from_arrays([b.column("vector"), b.column("ids"), _lists(at, pa.float64()), pa.array(tree.cells(at), pa.int32())], ["vector", "ids", "at", "cell"])

    points = materialize(distinct.mapInArrow(placed, f"{vector_field}, ids array<long>, at array<double>, cell int"))
    edges = [f(F.element_at("at", d + 1)).alias(f"{name}{d}") for name, f in (("low", F.min), ("high", F.max)) for d in range(dims)]
    boxes = points.groupBy("cell").agg(F.count("*").alias("n"), *edges).orderBy("cell").collect()
    cells, subs = np.array([r.cell for r in boxes], np.int64), np.array([-(-r.n // (4 * cell_rows)) for r in boxes], np.int64)
    low, high = (np.array([[r[f"{name}{d}"] for d in range(dims)] for r in boxes]) for name in ("low", "high"))
    parts = spark.createDataFrame([(int(c), int(s)) for c, s in zip(cells, subs, strict=True)], "cell int, subs int")
    points = points.join(parts, "cell").withColumn("sub", F.pmod(F.xxhash64("vector"), F.col("subs")).cast("int"))
    distinct_asked = materialize(asked.select("vector").distinct().withColumn("key", F.monotonically_increasing_id()))

    def item_of(kind: int, b: pa.RecordBatch, cell, part, salt, bound, at, ids=None) -> pa.RecordBatch:
        m = len(cell)
        number = lambda x: pa.array(np.broadcast_to(np.asarray(x), m), pa.int32())
        nothing = pa.nulls(m, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [number(cell), number(part), number(salt), number(kind), b.column("key"), pa.array(bound, pa.float64()), _lists(at, pa.float64()), nothing if ids is None else ids, b.column("vector")],
            ["cell", "sub", "salt", "kind", "key", "bound", "at", "ids", "vector"],
        )

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query in the cell whose box is nearest."""
        for b in batches:
            if b.num_rows:
                at = projection.queries(_matrix(b.column("vector")))
                home = np.concatenate([np.argmin(box_distances(at[i : i + 256], low, high), axis=1) for i in range(0, len(at), 256)])
                yield item_of(1, b, cells[home], 0, 0, np.full(len(at), -np.inf), at)

    def visits(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, query, box) of the boxes within the radius of each query of a batch."""
        bound, q = b.column("bound").to_numpy(), _matrix(b.column("vector"))
        at = projection.queries(q)
        radius = quantile * np.maximum(0.0, 2.0 - 2.0 * bound / (np.linalg.norm(q, axis=1) * longest) + 1e-12)
        for i in range(0, len(at), 256):
            yield i, *np.nonzero(box_distances(at[i : i + 256], low, high) <= radius[i : i + 256, None])

    def count_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cells), np.int64)
        for b in batches:
            if b.num_rows:
                for _, _, box in visits(b):
                    total += np.bincount(box, minlength=len(cells))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["box", "n"])

    def searched(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, cell = None, [], None
            for b in batches:
                if not b.num_rows:
                    continue
                keys = np.stack([b.column(c).to_numpy() for c in ("cell", "sub", "salt", "kind")], axis=1)
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    part, own = b.slice(i, j - i), tuple(keys[i, :3].tolist())
                    if own != key:
                        key, held, cell = own, [], None
                    if keys[i, 3] == 0:
                        held.append((_matrix(part.column("vector")), _matrix(part.column("at")), part.column("ids").flatten().to_numpy(), np.diff(part.column("ids").offsets.to_numpy())))
                        continue
                    if cell is None and held:
                        vectors, at, ids, counts = (np.concatenate(x) for x in zip(*held, strict=True))
                        cell, held = Cell(vectors, at, ids, np.concatenate(([0], np.cumsum(counts))), leaf_rows), []
                    for s in range(0, part.num_rows if cell is not None else 0, 512):
                        some = part.slice(s, 512)
                        bound = some.column("bound").to_numpy()
                        q, found, score = cell.search(_matrix(some.column("vector")), _matrix(some.column("at")), bound, longest, k, quantile)
                        yield pa.RecordBatch.from_arrays([pa.array(some.column("key").to_numpy()[q]), pa.array(found), pa.array(score)], ["key", "id", "score"])

        return run

    def items(points: DataFrame, queries: DataFrame) -> DataFrame:
        own = points.select("cell", "sub", "salt", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("bound"), "at", "ids", "vector")
        return own.unionByName(queries).repartition("cell", "sub", "salt").sortWithinPartitions("cell", "sub", "salt", "kind")

    item = f"{ITEM}, {vector_field}"
    home = distinct_asked.mapInArrow(at_home, item)
    first = items(points.filter("sub = 0").withColumn("salt", F.lit(0)), home).mapInArrow(searched(k + 1), "key long, id long, score double")
    # The k + 1st best of the first cell bounds what can be among the k + 1 best of all.
    bounds = first.groupBy("key").agg(F.when(F.count("*") > k, F.min("score")).alias("bound"))
    bounded = materialize(distinct_asked.join(bounds, "key", "left").select("key", "vector", F.coalesce("bound", F.lit(float("-inf"))).alias("bound")))
    total = np.zeros(len(cells), np.int64)
    for r in bounded.mapInArrow(count_visits, "box int, n long").groupBy("box").agg(F.sum("n").alias("n")).collect():
        total[r.box] = r.n
    salts = np.maximum(1, -(-total // visits_per_item))

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, q, box in visits(b) if b.num_rows else ():
                for s in range(0, len(q), 4096):
                    own, at_box = q[s : s + 4096] + i, box[s : s + 4096]
                    copies = np.repeat(np.arange(len(own)), subs[at_box])
                    part = np.arange(len(copies)) - np.repeat(np.cumsum(subs[at_box]) - subs[at_box], subs[at_box])
                    own, at_box = own[copies], at_box[copies]
                    taken = b.take(pa.array(own))
                    salt = taken.column("key").to_numpy() * 0x9E3779B1 % (1 << 31) % salts[at_box]
                    yield item_of(1, taken, cells[at_box], part, salt, taken.column("bound").to_numpy(), projection.queries(_matrix(taken.column("vector"))))

    copied = spark.createDataFrame([(int(c), int(s)) for c, s in zip(cells, salts, strict=True)], "cell int, salts int")
    spread = points.join(copied, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    found = items(spread, bounded.mapInArrow(visiting, item)).mapInArrow(searched(k + 1), "key long, id long, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    lists = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("best"))
    answers = lists.join(distinct_asked, "key").select(F.col("vector").alias("v"), "best")
    own = asked.join(answers, F.col("vector") == F.col("v")).select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def nearest_of_every(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """nearest() for the rows whose id is divisible by `every`, against all rows."""
    return nearest(rows, rows.filter(F.col(id_col) % every == 0), k, id_col, vector_col, **options)
