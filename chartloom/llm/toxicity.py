"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a learned vector of the hashed word beside the mean of learned vectors of its hashed character
trigrams and beginnings; the first number of each vector starts from how surely the word or piece stands in toxic texts of the sample more often than in others. A text is cut into overlapping windows of words; each window is read in both directions, attention weighs
its words, and the text's score is that of its most toxic window. The network learns from whole texts' labels: the
loss of a text is that of its highest window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import held_out, one_label, sample_rows, slices

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STRIP = b".,;:!?()[]{}\"'<>*#$%&|-_=+/\\`~"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without punctuation around them."""
    return [w for w in (x.strip(STRIP) for x in (text or "").lower().encode("utf-8", "surrogatepass").split()) if w]


def hashed_words(words: list[bytes], word_bits: int, gram_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, buckets of all character pieces, where each word's pieces begin): trigrams, and the first 4 and 6 letters."""
    line = np.frombuffer(b"".join([b"^^" + w + b"$" for w in words]), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 3
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    place = np.arange(len(line)) - np.repeat(begin, size)
    power = np.cumprod(np.full(64, 0x100000001B3, np.uint64))
    word = np.add.reduceat((line + np.uint64(1)) * power[place & 63], begin) if len(words) else np.zeros(0, np.uint64)
    bucket = ((word * GOLDEN) >> np.uint64(64 - word_bits)).astype(np.int64)
    h = (line[:-2] * np.uint64(65_599) + line[1:-1]) * np.uint64(65_599) + line[2:] if len(line) > 2 else np.zeros(0, np.uint64)
    if not len(words):
        return bucket, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A word's pieces: at its first two places its beginnings, then the trigrams at each place.
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((line + np.uint64(1)) * power[place & 63])))
    out = np.empty(int(size.sum()), np.uint64)
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    for k, letters in enumerate((4, 6)):
        out[first + k] = (sums[begin + np.minimum(letters + 2, size)] - sums[begin]) * np.uint64(2 * k + 3)
    inside = np.flatnonzero((place < np.repeat(size - 2, size))[: len(h)])
    out[np.repeat(first + 2 - np.concatenate(([0], np.cumsum(size - 2)))[:-1], size - 2) + np.arange(len(inside))] = h[inside]
    return bucket, ((out * GOLDEN) >> np.uint64(64 - gram_bits)).astype(np.int64), first


def window_starts(n: int, width: int, stride: int) -> np.ndarray:
    """Starts of windows that cover n words; the last one ends with the text."""
    if n <= width:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - width, stride), n - width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Parameters and passes; inputs are time-major arrays [time, window, ...]."""

    def __init__(self, word_bits: int = 15, gram_bits: int = 15, width: int = 32, stride: int = 24, dim: int = 8, hidden: int = 8, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.word_bits, self.gram_bits, self.width, self.stride, self.dim, self.hidden = word_bits, gram_bits, width, stride, dim, hidden
        normal = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": normal(1 << word_bits, dim, scale=0.05), "gram": normal(1 << gram_bits, dim, scale=0.05)}
        for d in "fb":
            self.p |= {f"{d}x": normal(2 * dim, 3 * hidden), f"{d}h": normal(hidden, 3 * hidden), f"{d}c": np.zeros(3 * hidden, np.float32)}
        self.p |= {"att": normal(2 * hidden, hidden), "att_v": normal(hidden), "out": normal(2 * hidden), "bias": np.array([-2.0], np.float32)}

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each word, buckets of all pieces, number of each word's pieces)."""
        bucket, grams, begin = hashed_words(words, self.word_bits, self.gram_bits)
        return bucket, grams, np.diff(np.append(begin, len(grams)))

    def vectors(self, inputs: tuple) -> np.ndarray:
        bucket, grams, count = inputs
        mean = np.add.reduceat(self.p["gram"][grams], np.cumsum(count) - count, axis=0) / count[:, None].astype(np.float32)
        return np.concatenate((self.p["word"][bucket], mean), axis=1)

    def run(self, direction: str, table: np.ndarray, at: np.ndarray, mask: np.ndarray | None, keep: bool):
        """Hidden states [time, window, hidden] over table rows `at` [time, window]."""
        hid, wh = self.hidden, self.p[f"{direction}h"]
        steps = range(len(at)) if direction == "f" else range(len(at) - 1, -1, -1)
        h = np.zeros((at.shape[1], hid), np.float32)
        out = np.empty((*at.shape, hid), np.float32)
        saved = [None] * len(at)
        for t in steps:
            x = table[at[t]]
            hw = h @ wh
            gates = sigmoid(x[:, : 2 * hid] + hw[:, : 2 * hid])
            z, r = gates[:, :hid], gates[:, hid:]
            c = np.tanh(x[:, 2 * hid :] + r * hw[:, 2 * hid :])
            new = c + z * (h - c)
            if mask is not None:
                new *= mask[t][:, None]
            if keep:
                saved[t] = (h, z, r, c, hw[:, 2 * hid :])
            h = out[t] = new
        return out, saved

    def pool(self, states: np.ndarray, mask: np.ndarray | None):
        u = np.tanh(states @ self.p["att"])
        score = u @ self.p["att_v"]
        if mask is not None:
            score = np.where(mask > 0, score, np.float32(-1e9))
        a = np.exp(score - score.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", a, states)
        return pooled @ self.p["out"] + self.p["bias"][0], (u, a, pooled)

    def logits(self, vectors: np.ndarray, at: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        states = np.concatenate([self.run(d, vectors @ self.p[f"{d}x"] + self.p[f"{d}c"], at, mask, False)[0] for d in "fb"], axis=2)
        return self.pool(states, mask)[0]

    def gradients(self, inputs: tuple, at: np.ndarray, mask: np.ndarray, choose) -> tuple[float, dict]:
        """Loss and gradients; choose(logits) gives the loss and its slope for each window."""
        x, (bucket, grams, count) = self.vectors(inputs), inputs
        runs = {d: self.run(d, x @ self.p[f"{d}x"] + self.p[f"{d}c"], at, mask, True) for d in "fb"}
        states = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        logit, (u, a, pooled) = self.pool(states, mask)
        loss, slope = choose(logit)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["bias"][0], g["out"] = slope.sum(), pooled.T @ slope
        d_pool = slope[:, None] * self.p["out"]
        d_states = a[:, :, None] * d_pool
        d_a = np.einsum("tnd,nd->tn", states, d_pool)
        d_score = a * (d_a - (a * d_a).sum(axis=0))
        g["att_v"] = np.einsum("tn,tnk->k", d_score, u)
        d_u = d_score[:, :, None] * self.p["att_v"] * (1 - u * u)
        g["att"] = np.einsum("tnd,tnk->dk", states, d_u)
        d_states = d_states + d_u @ self.p["att"].T
        d_x = np.zeros_like(x)
        for i, d in enumerate("fb"):
            d_table, g[f"{d}h"] = self._back(d, runs[d][1], d_states[:, :, i * self.hidden : (i + 1) * self.hidden], at, mask, len(x))
            g[f"{d}x"], g[f"{d}c"] = x.T @ d_table, d_table.sum(axis=0)
            d_x += d_table @ self.p[f"{d}x"].T
        np.add.at(g["word"], bucket, d_x[:, : self.dim])
        np.add.at(g["gram"], grams, np.repeat(d_x[:, self.dim :] / count[:, None].astype(np.float32), count, axis=0))
        return loss, g

    def _back(self, d: str, saved: list, d_out: np.ndarray, at: np.ndarray, mask: np.ndarray, rows: int):
        hid, wh = self.hidden, self.p[f"{d}h"]
        d_wh = np.zeros_like(wh)
        d_gates = np.empty((*at.shape, 3 * hid), np.float32)
        d_h = np.zeros_like(d_out[0])
        for t in range(len(at) - 1, -1, -1) if d == "f" else range(len(at)):
            h, z, r, c, hc = saved[t]
            total = (d_out[t] + d_h) * mask[t][:, None]
            d_c = total * (1 - z) * (1 - c * c)
            d_z = total * (h - c) * z * (1 - z)
            d_r = d_c * hc * r * (1 - r)
            d_hw = np.concatenate((d_z, d_r, d_c * r), axis=1)
            d_gates[t] = np.concatenate((d_z, d_r, d_c), axis=1)
            d_wh += h.T @ d_hw
            d_h = total * z + d_hw @ wh.T
        flat, where = d_gates.reshape(-1, 3 * hid), at.ravel()
        order = np.argsort(where, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], where[order][1:] != where[order][:-1])))
        d_table = np.zeros((rows, 3 * hid), np.float32)
        d_table[where[order][first]] = np.add.reduceat(flat[order], first, axis=0)
        return d_table, d_wh

    def windows(self, texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(distinct words, their numbers [time, window], mask [time, window], text of each window)."""
        number: dict[bytes, int] = {b"": 0}
        ids = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in texts]
        rows, full, owner = [], [], []
        for k, x in enumerate(ids):
            starts = window_starts(len(x), self.width, self.stride)
            padded = np.append(x, np.zeros(max(0, self.width - len(x)), np.int64))
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, self.width)[starts])
            full += [min(len(x), self.width)] * len(starts)
            owner += [k] * len(starts)
        at = np.concatenate(rows).T.copy()
        mask = (np.arange(self.width)[:, None] < np.maximum(1, np.array(full))[None, :]).astype(np.float32)
        return list(number), at, mask, np.array(owner)

    def scores(self, texts: list[str | None], piece: int = 4096) -> np.ndarray:
        """Probability of toxicity of each whole text."""
        best = np.full(len(texts), -np.inf, np.float32)
        words, at, mask, owner = self.windows([words_of(t) for t in texts])
        vectors = self.vectors(self.inputs(words))
        short = mask.min(axis=0) == 0
        for part in (np.flatnonzero(~short), np.flatnonzero(short)):
            for i in range(0, len(part), piece):
                at_once = part[i : i + piece]
                m = mask[:, at_once] if short[at_once[0]] else None
                np.maximum.at(best, owner[at_once], self.logits(vectors, at[:, at_once], m))
        return 1 / (1 + np.exp(-best.astype(np.float64)))


def highest(score: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The window with the highest score of each text, the last of equal ones."""
    order = np.lexsort((score, owner))
    return order[np.append(owner[order][1:] != owner[order][:-1], True)]


class Sample:
    """The windows of labelled texts, made once; words are hashed once for all of them."""

    def __init__(self, net: Network, texts: list[str]):
        words, self.at, self.mask, self.owner = net.windows([words_of(t) for t in texts])
        self.inputs = net.inputs(words)
        self.begin = np.cumsum(self.inputs[2]) - self.inputs[2]
        self.ends = np.searchsorted(self.owner, np.arange(len(texts) + 1))

    def of(self, windows: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray]:
        """(inputs of the words in some windows, their numbers [time, window], mask)."""
        words, at = np.unique(self.at[:, windows], return_inverse=True)
        bucket, grams, count = self.inputs
        n = count[words]
        picked = np.repeat(self.begin[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return (bucket[words], grams[picked], n), at.reshape(self.at.shape[0], len(windows)), self.mask[:, windows]


def start_from_words(net: Network, sample: Sample, y: np.ndarray) -> np.ndarray:
    """Set the first number of the vectors of word and piece buckets: by how many standard deviations a bucket stands in more toxic
    texts than chance has it. A bucket in few texts is close to 0 by this measure, so a rare word of one toxic text says little.

    Returns for each window the highest such number of its words.
    """
    bucket, grams, count = sample.inputs
    share = y.mean()
    sure = {}
    for name, bits in (("word", net.word_bits), ("gram", net.gram_bits)):
        in_texts = np.zeros((2, 1 << bits))
        for k, label in enumerate(y.astype(int)):
            words = np.unique(sample.at[:, sample.ends[k] : sample.ends[k + 1]])
            n = count[words]
            picked = bucket[words] if name == "word" else grams[np.repeat(sample.begin[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            in_texts[label, np.unique(picked)] += 1
        n = in_texts.sum(axis=0)
        sure[name] = np.clip((in_texts[1] - n * share) / np.sqrt(n * share * (1 - share) + 1.0), -3, 10)
        net.p[name][:, 0] = (0.5 if name == "word" else 2.0) * sure[name]
    of_word = sure["word"][bucket] + np.maximum.reduceat(sure["gram"][grams], sample.begin)
    return np.where(sample.mask > 0, of_word[sample.at], -np.inf).max(axis=0)


def fit(texts: list[str], labels: list[int], network: Network | None = None, steps: int = 600, batch: int = 48, rate: float = 0.04, seed: int = 9, piece: int = 1024) -> Network:
    """Adam over labelled texts; in the vectors' tables all entries share one scale, so that rare words move less.

    A step takes `batch` texts, and of each text the window that says most: in the first third of the steps by its words alone (see
    start_from_words) and one by chance, later the one with the highest logit among all its windows.
    """
    net, rng = network or Network(), np.random.default_rng(seed)
    sample = Sample(net, texts)
    y = np.array(labels, np.float32)
    telling = start_from_words(net, sample, y)
    weight = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())).astype(np.float32) ** 0.5
    m, v = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < min(batch, len(texts)):
            order = np.concatenate((order, rng.permutation(len(texts))))
        chosen, order = order[:batch], order[batch:]
        windows = np.concatenate([np.arange(sample.ends[k], sample.ends[k + 1]) for k in chosen])
        owner = np.repeat(np.arange(len(chosen)), sample.ends[chosen + 1] - sample.ends[chosen])
        if step <= steps / 3:
            top = np.concatenate((highest(telling[windows], owner), highest(rng.random(len(windows)), owner)))
        else:
            inputs, at, mask = sample.of(windows)
            vectors = net.vectors(inputs)
            top = highest(np.concatenate([net.logits(vectors, at[:, i : i + piece], mask[:, i : i + piece]) for i in range(0, len(windows), piece)]), owner)
        goal, part = y[chosen][owner[top]], (weight[chosen][owner[top]] / len(top)).astype(np.float32)

        def choose(logit, goal=goal, part=part):
            p = sigmoid(logit)
            cost = -np.where(goal > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))
            return float((part * cost).sum()), part * (p - goal)

        _, g = net.gradients(*sample.of(windows[top]), choose)
        pace = rate * min(1.0, step / 20) * (0.3 if step > steps * 0.7 else 1.0)
        for k in net.p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * (np.square(g[k]).max() if k in ("word", "gram") else g[k] * g[k])
            net.p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 1000, threshold: float = 0.3, seed: int = 23, label_id_col: str = "doc_id", max_taught_bytes: int = 200_000) -> DataFrame:
    """(id, held_out, score, predicted), one row per input row.

    The network learns from about per_label rows of each label, chosen by a hash of the id among labelled rows that aren't
    held out, but from no text of over max_taught_bytes, so that the sample is bounded in bytes too; every window of every whole text is scored. Null and empty texts are one window without words and get the score
    that the network gives it. Of several labels of an id the largest counts; a null id teaches nothing. Without both labels all scores are 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    marks = one_label(labels.filter(F.col(label_col).isin(0, 1)), label_col, label_id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    # The sample has a fixed size, so it can be broadcast whatever the corpus is.
    taught = rows.filter(F.col("text").isNotNull() & (F.octet_length("text") <= max_taught_bytes)).join(F.broadcast(sample_rows(marks, "id", "label", per_label, seed)), "id").select("id", "text", "label").orderBy("id").toArrow()
    answers = taught.column("label").to_pylist()
    model = spark.sparkContext.broadcast(fit(taught.column("text").to_pylist(), answers) if len(set(answers)) == 2 else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for b in slices(batches, "text", 1_000_000):
            score = np.zeros(b.num_rows) if net is None else net.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
