"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = sigmoid(threshold_k - f(text)): one set of hashed-text weights, shared by all grades, and ordered
thresholds. It gives the expected grade and the probability of a grade at or above any level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import held_out, materialize, one_label, slices, spans, unit_hash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def hashed_text(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (column, weight, begin): character trigrams of the raw text, and for each word how far back the
    same word stands (1 to 4 words, or further). The weights of each of the two kinds add up to 1 in a row.
    """
    padded = [f" {t} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, padded), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), sizes)
    h = (codes[:-2] * np.uint64(1_000_003) + codes[1:-1]) * np.uint64(1_000_003) + codes[2:]
    inside = row[:-2] == row[2:]
    grams = ((h * GOLDEN) >> np.uint64(64 - bits)).astype(np.int64)[inside]
    gram_row = row[:-2][inside]
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(start):
        return grams, (1.0 / np.maximum(1, sizes - 2))[gram_row].astype(np.float32), np.searchsorted(gram_row, np.arange(len(texts)))
    place = np.arange(len(codes)) - np.repeat(start, np.diff(np.append(start, len(codes)))) if start[0] == 0 else np.arange(len(codes)) - np.concatenate((np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(codes))))))
    power = np.cumprod(np.full(256, 0x100000001B3, np.uint64))
    word = np.add.reduceat(np.where(space, np.uint64(0), (codes + np.uint64(7)) * power[place & 255]), start)
    word_row = row[start]
    back = np.zeros(len(word), np.int64)
    for k in (4, 3, 2, 1):
        back[k:][(word[k:] == word[:-k]) & (word_row[k:] == word_row[:-k])] = k
    marks = (((back.astype(np.uint64) + np.uint64(0xF00000)) * GOLDEN) >> np.uint64(64 - bits)).astype(np.int64)
    n_words = np.bincount(word_row, minlength=len(texts))
    column = np.concatenate((grams, marks))
    weight = np.concatenate(((1.0 / np.maximum(1, sizes - 2))[gram_row], (1.0 / np.maximum(1, n_words))[word_row])).astype(np.float32)
    of = np.concatenate((gram_row, word_row))
    order = np.argsort(of, kind="stable")
    return column[order], weight[order], np.searchsorted(of[order], np.arange(len(texts)))


@dataclass
class CumulativeLink:
    grades: list
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def value(self, texts: list[str]) -> np.ndarray:
        bits = int(np.log2(len(self.weights)))
        column, weight, begin = hashed_text(texts, bits)
        row = np.repeat(np.arange(len(texts)), np.diff(np.append(begin, len(column))))
        return np.bincount(row, weight * self.weights[column], minlength=len(texts))

    def tails(self, value: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - value[:, None], -50, 50)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        steps = np.diff(np.array(self.grades, float))
        return self.grades[0] + (tails * steps).sum(axis=1)


def entries(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hashed_text with equal columns of a row as one entry, by column; begin has one number more than there are rows."""
    column, weight, begin = hashed_text(texts, bits)
    row = np.repeat(np.arange(len(texts)), np.diff(np.append(begin, len(column))))
    key, where = np.unique((row << bits) | column, return_inverse=True)
    weights = np.bincount(where, weight, minlength=len(key)).astype(np.float32)
    return (key & ((1 << bits) - 1)).astype(np.uint32), weights, np.searchsorted(key >> bits, np.arange(len(texts) + 1))


def sums(column: np.ndarray, weight: np.ndarray, begin: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The value of each row of entries; 0 for a row without any."""
    f, some = np.zeros(len(begin) - 1), np.flatnonzero(np.diff(begin))
    if len(some):
        f[some] = np.add.reduceat(weight * weights[column], begin[some], dtype=np.float64)
    return f


#: Slopes are whole multiples of 1 / UNIT, so that their sums are exact: a fit is the same however its rows are cut and dealt.
UNIT = 2.0**50


def sides(f: np.ndarray, y: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(grade <= y) and P(grade < y) of rows of value f and grade number y."""
    k = len(thresholds)
    below = lambda at: 1 / (1 + np.exp(-np.clip(thresholds[np.clip(at, 0, k - 1)] - f, -40, 40)))
    return np.where(y < k, below(y), 1.0), np.where(y > 0, below(y - 1), 0.0)


def slopes(column: np.ndarray, weight: np.ndarray, begin: np.ndarray, y: np.ndarray, share: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Slopes of the loss of some rows by all weights and thresholds, and the loss, in units; share is what a row of each grade counts, 1 in all."""
    k = len(thresholds)
    upper, lower = sides(sums(column, weight, begin, weights), y, thresholds)
    p, up, low = np.maximum(upper - lower, 1e-12), upper * (1 - upper), lower * (1 - lower)
    to_f = share[y] * ((up - low) / p) * UNIT
    out = np.zeros(len(weights) + k + 1, np.int64)
    # At most 2 in all, so doubles add up the units of a weight exactly.
    out[: len(weights)] = np.bincount(column, np.rint(weight * np.repeat(to_f, np.diff(begin))), minlength=len(weights))
    for side, sign, at in ((up, -1, y), (low, 1, y - 1)):
        on = (at >= 0) & (at < k)
        np.add.at(out, len(weights) + at[on], np.rint(sign * share[y[on]] * np.minimum(side[on] / p[on], 4096) * UNIT).astype(np.int64))
    out[-1] = np.rint(share[y] * -np.log(p) * UNIT).astype(np.int64).sum()
    return out


def bends(column: np.ndarray, weight: np.ndarray, begin: np.ndarray, y: np.ndarray, share: np.ndarray, size: int, thresholds: np.ndarray) -> np.ndarray:
    """How the loss of some rows bends by each of `size` weights where all are 0, and by the value of all rows at once, in units."""
    upper, lower = sides(np.zeros(len(y)), y, thresholds)
    bend = share[y] * (upper * (1 - upper) + lower * (1 - lower)) * UNIT
    by_weight = np.bincount(column, np.rint(weight.astype(float) ** 2 * np.repeat(bend, np.diff(begin))), minlength=size)
    return np.append(by_weight.astype(np.int64), np.rint(bend).astype(np.int64).sum())


#: The fit remembers so many steps, and ends when so many together lower the loss by less than this part of it.
REMEMBERED, LOOK_BACK, LEAST_GAIN = 20, 10, 1e-4


def climb(over_all: Callable[..., np.ndarray], grades: list, bits: int, steps: int, rate: float, ridge: float) -> CumulativeLink:
    """Maximum likelihood by L-BFGS, scaled by how the loss bends; over_all(slopes or bends, ...) adds these up over all rows, in units.

    `steps` is the most passes for slopes, and the first one tries `rate` of a Newton step by each weight alone. Passes end where the loss does.
    """
    n, z = 1 << bits, np.zeros((1 << bits) + len(grades) - 1)

    def thresholds(z: np.ndarray) -> np.ndarray:
        return z[n] + np.concatenate(([0.0], np.cumsum(np.exp(z[n + 1 :]))))

    def at(z: np.ndarray) -> tuple[float, np.ndarray]:
        out = over_all(slopes, z[:n].astype(np.float32), thresholds(z)) / UNIT
        theta = out[n:-1]
        by_gap = [np.exp(gap) * theta[k + 1 :].sum() for k, gap in enumerate(z[n + 1 :])]
        return out[-1] + ridge / 2 * (z[:n] ** 2).sum(), np.concatenate([out[:n] + ridge * z[:n], [theta.sum()], by_gap])

    bend = over_all(bends, n, thresholds(z)) / UNIT
    scale = np.concatenate([bend[:n] + ridge, np.full(len(grades) - 1, bend[n])])
    (loss, slope), past, losses, passes, first = at(z), [], [], 1, rate
    while passes < steps:
        way, parts = -slope, []
        for moved, turned, r in reversed(past):
            parts.append(r * (moved * way).sum())
            way -= parts[-1] * turned
        if past:
            moved, turned, r = past[-1]
            way /= r * (turned**2 / scale).sum()
        way /= scale
        for (moved, turned, r), part in zip(past, reversed(parts), strict=True):
            way += (part - r * (turned * way).sum()) * moved
        down, far = (slope * way).sum(), first
        while passes < steps and far > 1e-9:
            there = z + far * way
            there[:n] = there[:n].astype(np.float32)
            loss_there, slope_there = at(there)
            passes += 1
            if loss_there <= loss + 1e-4 * far * down:
                break
            far = min(far / 2, max(far / 10, -down * far**2 / (2 * (loss_there - loss - far * down))))
        else:
            break
        moved, turned = there - z, slope_there - slope
        if (moved * turned).sum() > 0:
            past = [*past, (moved, turned, 1 / (moved * turned).sum())][-REMEMBERED:]
        losses.append(loss)
        z, loss, slope, first = there, loss_there, slope_there, 1.0
        if len(losses) >= LOOK_BACK and losses[-LOOK_BACK] - loss <= LEAST_GAIN * loss:
            break
    return CumulativeLink(grades, z[:n].astype(np.float32), thresholds(z))


def shares(counts: np.ndarray) -> np.ndarray:
    """What a row of each grade counts: each grade counts alike."""
    return 1.0 / (counts * len(counts))


def fit(texts: list[str], grades: list, bits: int = 15, steps: int = 150, rate: float = 0.5, ridge: float = 1e-5) -> CumulativeLink | None:
    """Maximum likelihood over all given rows; each grade counts alike. None with fewer than two grades."""
    names = sorted(set(grades))
    if len(names) < 2:
        return None
    y = np.array([names.index(g) for g in grades])
    share, parts = shares(np.bincount(y)), [(*entries(texts[part], bits), y[part]) for part in spans(texts)]
    return climb(lambda measure, *point: sum(measure(*part, share, *point) for part in parts), names, bits, steps, rate, ridge)


#: The fit's passes run in a task for so many entries, and in so many tasks at most; each sends the driver one row of slopes, whatever the number of texts.
ENTRIES_OF_TASK, MOST_TASKS = 1 << 20, 64


def table_of_entries(rows: DataFrame, bits: int = 15) -> DataFrame:
    """(grade, aside, columns, weights) of rows (grade, aside, text), written once: each text's entries as 16-bit columns and 32-bit weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1_000_000):
            texts = b.column("text").to_pylist()
            for part in spans(texts):
                column, weight, begin = entries(texts[part], bits)
                n = len(begin) - 1
                packed = [pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((begin * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (column.astype(np.uint16), weight)]
                yield pa.RecordBatch.from_arrays([b.column("grade").slice(part.start, n), b.column("aside").slice(part.start, n), *packed], ["grade", "aside", "columns", "weights"])

    return materialize(rows.select(F.col("grade").cast("double").alias("grade"), "aside", "text").mapInArrow(run, "grade double, aside boolean, columns binary, weights binary"))


def unpack(b: pa.RecordBatch, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(column, weight, begin, grade) of a batch's rows, by slices of about `most` entries."""
    if not b.num_rows:
        return
    ends, flat = [], []
    for name, kind in (("columns", np.uint16), ("weights", np.float32)):
        x = b.column(name)
        at = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1] // np.dtype(kind).itemsize
        ends.append(at)
        flat.append(np.frombuffer(x.buffers()[2] or b"", kind, count=at[-1]))
    grade, start = np.asarray(b.column("grade")), 0
    while start < b.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends[0], ends[0][start] + most, side="right")) - 1)
        yield *(x[at[start] : at[stop]] for x, at in zip(flat, ends, strict=True)), ends[0][start : stop + 1] - ends[0][start], grade[start:stop]
        start = stop


def fit_all(taught: DataFrame, bits: int = 15, steps: int = 150, rate: float = 0.5, ridge: float = 1e-5) -> CumulativeLink | None:
    """fit over a table of entries: each step adds up the slopes of all rows in one pass."""
    found = {r["grade"]: r for r in taught.groupBy("grade").agg(F.count("*").alias("rows"), F.sum(F.octet_length("columns")).alias("bytes")).collect()}
    names = sorted(found)
    if len(names) < 2:
        return None
    share, known, context = shares(np.array([found[g]["rows"] for g in names])), np.array(names), taught.sparkSession.sparkContext
    tasks = sum(r["bytes"] for r in found.values()) // 2 // ENTRIES_OF_TASK
    rows = taught.select("grade", "columns", "weights").coalesce(max(1, min(MOST_TASKS, tasks)))

    def over_all(measure: Callable[..., np.ndarray], *point) -> np.ndarray:
        at = context.broadcast(point)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for column, weight, begin, grade in unpack(b):
                    part = measure(column, weight, begin, np.searchsorted(known, grade), share, *at.value)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["slopes"])

        out = sum(np.frombuffer(r["slopes"], np.int64) for r in rows.mapInArrow(run, "slopes binary").collect())
        at.destroy()
        return out

    return climb(over_all, names, bits, steps, rate, ridge)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, grade_col: str, level: int, keep_good: float, seed: int, label_id_col: str) -> CumulativeLink | None:
    """Fit on four fifths of the labelled rows that aren't held out and set the cut on all others, parted by a hash of the id. Texts meet their labels
    once, and what the fit needs of them is written; each step of the fit is a pass over that, and the driver gets only sums and counts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(~held_out(F.col("id")))
    marks = one_label(labels, grade_col, label_id_col).withColumnRenamed("label", "grade")
    # Every fifth row never teaches, so that there are rows for the cut however few labels there are.
    # Merged at every size: labels are not sent through the driver while they are few, and each text is shuffled once however many they are.
    known = table_of_entries(rows.join(marks.hint("merge"), "id").select("grade", (unit_hash(F.col("id"), seed + 1) < 0.2).alias("aside"), "text"))
    link = fit_all(known.filter(~F.col("aside")))
    if link is None:
        return None
    model = docs.sparkSession.sparkContext.broadcast(link)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for column, weight, begin, grade in unpack(b):
                tail = _at(model.value, model.value.tails(sums(column, weight, begin, model.value.weights)), level)
                yield pa.RecordBatch.from_arrays([pa.array(np.floor(tail * BINS).astype(np.int32)), pa.array(grade >= level)], ["bin", "good"])

    counts = known.filter("aside").select("grade", "columns", "weights").mapInArrow(score, "bin int, good boolean").groupBy("bin", "good").count().collect()
    link.cut = best_cut({r["bin"]: r["count"] for r in counts if r["good"]}, {r["bin"]: r["count"] for r in counts if not r["good"]}, keep_good)
    return link


#: Tail probabilities are counted in so many equal steps when the cut is chosen.
BINS = 10_000


def best_cut(good: dict[int, int], bad: dict[int, int], keep_good: float) -> float:
    """The cut up to a half that parts good and bad rows best while keep_good of the good are kept; a half without good rows.

    Of cuts that part equally well the middle of the range is taken. One good row more than keep_good allows may go, so that a few
    wrong labels can't pull the cut to nothing.
    """
    if not good:
        return 0.5
    edges = np.arange(BINS // 2 + 1)
    below = lambda counts: np.array([0, *np.cumsum([counts.get(i, 0) for i in range(BINS // 2)])])
    lost, caught = below(good), below(bad)
    n_good, n_bad = sum(good.values()), max(1, sum(bad.values()))
    gain = np.where(lost <= (1 - keep_good) * n_good + 1, caught / n_bad - lost / n_good, -1.0)
    best = edges[gain >= gain.max() - 1e-12]
    return float(best[len(best) // 2] / BINS)


def rate_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", level: int = 1,
    keep_good: float = 0.998, seed: int = 17, label_id_col: str = "doc_id",
) -> DataFrame:
    """(id, held_out, expected_grade, tail_prob, kept), one row per input row.

    tail_prob is the probability of a grade of `level` or more; kept: it is at least the cut, which parts good and bad rows best, up to a
    half, while keep_good of the good ones stay, among labelled rows that the fit doesn't see. Fit and cut use all labelled
    rows that aren't held out (see train); all rows are scored. A null text is rated like an empty one; of several labels of an id the largest counts; a null
    id has no label. If fewer than two grades are known, expected_grade and tail_prob are null and all rows are kept. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, grade_col, level, keep_good, seed, label_id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link = model.value
        for b in slices(batches, "text", 1_000_000):
            if link is None:
                none = pa.nulls(b.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), none, none, pa.array([True] * b.num_rows)], ["id", "held_out", "expected_grade", "tail_prob", "kept"])
                continue
            tails = link.tails(link.value([t or "" for t in b.column("text").to_pylist()]))
            tail = _at(link, tails, level)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(link.expected(tails)), pa.array(tail), pa.array(tail >= link.cut)], ["id", "held_out", "expected_grade", "tail_prob", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, expected_grade double, tail_prob double, kept boolean").withColumnRenamed("id", id_col)


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", level: int = 1,
    keep_good: float = 0.998, seed: int = 17, label_id_col: str = "doc_id",
) -> DataFrame:
    """The documents that rate_quality keeps, with all their columns, rows without an id and repeats among them; only texts that may teach are shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, grade_col, level, keep_good, seed, label_id_col))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link = model.value
        for b in slices(batches, place, 1_000_000):
            if link is None:
                yield b
            else:
                yield b.filter(pa.array(_tail(link, [t or "" for t in b.column(place).to_pylist()], level) >= link.cut))

    return docs.mapInArrow(run, docs.schema)


def _at(link: CumulativeLink, tails: np.ndarray, level: int) -> np.ndarray:
    k = int(np.searchsorted(np.array(link.grades), level)) - 1
    return np.ones(len(tails)) if k < 0 else np.zeros(len(tails)) if k >= tails.shape[1] else tails[:, k]


def _tail(link: CumulativeLink, texts: list[str], level: int) -> np.ndarray:
    return np.concatenate([_at(link, link.tails(link.value(texts[part])), level) for part in spans(texts)] or [np.zeros(0)])
