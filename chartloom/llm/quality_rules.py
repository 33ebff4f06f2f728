"""Quality rules: statistics of each text, and an isolation forest over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import materialize, one_label, slices, unit_hash

SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
#: ASCII characters that are neither letters nor digits.
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_other", "n_bare", "n_again"]
_MIX = np.random.default_rng(1).integers(1, 2**63, 5, dtype=np.uint64) | np.uint64(1)


def repeat_words(ids: np.ndarray, window: int = 5) -> int:
    """Words in windows found twice or more, the first included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = (key ^ spread[k : k + n]) * _MIX[k]
        key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """STATS of a text; all 0 for null."""
    if not text:
        return (0,) * len(STATS)
    words = text.encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    bare = np.fromiter((not w.strip(SIGNS) for w in seen), bool, len(seen))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    ascii_chars = text.encode("ascii", "ignore")
    codes = np.frombuffer(ascii_chars, np.uint8)
    counts = np.bincount(codes, minlength=128)
    upper = int(counts[65:91].sum())
    alnum = upper + int(counts[97:123].sum()) + int(counts[48:58].sum())
    spaces = int(sum(counts[ord(c)] for c in SPACES))
    return (
        len(words),
        len(text) - spaces,
        int(sum(counts[ord(c)] for c in SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(ids) if len(seen) < len(words) else 0,
        len(lines),
        len(seen),
        upper,
        len(codes) - alnum - spaces,
        int(bare[ids].sum()),
        int((ids[1:] == ids[:-1]).sum()),
    )


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the statistics as long): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            cols = np.array([statistics(t) for t in b.column("text").to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c) for c in cols.T.copy())], ["id", *STATS])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, " + ", ".join(f"{s} long" for s in STATS))


def ratios(stats: np.ndarray) -> np.ndarray:
    """What the forest splits on: statistics by length, so that a text's size alone isn't odd. Shares stand on a scale of logarithms,
    so that splits part small ones from none.
    """
    words, chars, symbols, dup, repeat, lines, distinct, upper, other, bare, again = stats.astype(float).T
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    shares = np.column_stack([symbols / w, dup / np.maximum(lines, 1), repeat / w, upper / c, other / c, bare / w, again / w])
    return np.column_stack([chars / w, np.log1p(w) * (1 - distinct / w), np.log1p(200 * shares)])


class IsolationForest:
    """Trees of random splits; a row that few splits isolate is odd. Each tree sees `size` rows of the sample."""

    def __init__(self, rows: np.ndarray, trees: int = 100, size: int = 256, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.depth = max(1, int(np.ceil(np.log2(max(2, min(size, len(rows)))))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, nodes), -1, np.int32)
        self.cut = np.zeros((trees, nodes))
        self.length = np.zeros((trees, nodes))
        self.norm = self.expected(min(size, max(2, len(rows))))
        for t in range(trees):
            stack = [(0, 0, rows[rng.permutation(len(rows))[:size]])]
            while stack:
                node, level, part = stack.pop()
                spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
                if level == self.depth or not len(spread):
                    self.length[t, node] = level + self.expected(len(part))
                    continue
                f = rng.choice(spread)
                cut = rng.uniform(part[:, f].min(), part[:, f].max())
                self.feature[t, node], self.cut[t, node] = f, cut
                stack += [(2 * node + 1, level + 1, part[part[:, f] <= cut]), (2 * node + 2, level + 1, part[part[:, f] > cut])]

    @staticmethod
    def expected(n: int) -> float:
        """Mean path length of an unsuccessful search among n."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, higher for odd rows."""
        total, at = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (rows[at, np.maximum(f, 0)] > cut[node]))
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def calibrate(score: np.ndarray, good: np.ndarray, keep_good: float) -> float:
    """The cut that parts labelled good and bad rows best while keep_good of the good stay; 1 without both."""
    if not good.any() or good.all():
        return 1.0
    cuts = np.unique(score)
    kept_good = np.searchsorted(np.sort(score[good]), cuts, side="right") / good.sum()
    kept_bad = np.searchsorted(np.sort(score[~good]), cuts, side="right") / (~good).sum()
    gain = np.where(kept_good >= keep_good, kept_good - kept_bad, -1)
    best = int(gain.argmax())
    above = cuts[best + 1] if best + 1 < len(cuts) else 1.0
    return float((cuts[best] + above) / 2) if gain[best] > 0 else 1.0


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, bad_share: float = 0.02, keep_good: float = 0.995, seed: int = 5, label_id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, odd_score, kept), one row per input row.

    base_failed: fewer than 10 words, or over 20% of them in repeated 5-word windows. kept is false if base_failed, else
    whether the forest's score is at most the cut. Forest and cut see about `sample` labelled rows that aren't
    held out, chosen by a hash of the id; the forest sees all the good ones of them and bad ones up to bad_share of these. Statistics and
    scores cover all. A null text has no words; of several labels of an id the largest counts; a null id has no label. Without labels
    of both kinds the cut is 1 and the forest rejects nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stats = materialize(rule_statistics(docs, id_col, text_col))
    passed = stats.filter("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words")
    marks = one_label(labels, "quality", label_id_col).withColumnRenamed("label", "quality")
    known = marks.count()
    rated = passed.join(marks.filter(unit_hash(F.col("id"), seed) < sample / max(1, known)), "id").orderBy("id", *STATS).select(*STATS, "quality").toPandas()
    rows, good = ratios(rated[STATS].to_numpy()), rated["quality"].to_numpy() >= 1
    # Few bad rows among good ones: what they have in common stays rare, however many there are in the corpus.
    usual = np.concatenate((rows[good], rows[~good][: max(1, int(bad_share * good.sum()))]))
    forest = IsolationForest(usual if len(usual) > 1 else np.zeros((2, rows.shape[1])), seed=seed)
    cut = calibrate(forest.score(rows), good, keep_good) if len(rated) else 1.0
    model = spark.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.value.score(ratios(np.column_stack([b.column(s).to_numpy() for s in STATS])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ["id", *STATS[:5]]), pa.array(score)], ["id", *STATS[:5], "odd_score"])

    scored = stats.mapInArrow(run, "id long, " + ", ".join(f"{s} long" for s in STATS[:5]) + ", odd_score double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.select(F.col("id").alias(id_col), *STATS[:5], failed.alias("base_failed"), "odd_score", (~failed & (F.col("odd_score") <= cut)).alias("kept"))
