"""Quality score by a factorisation machine over hashed words, structure statistics and size."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.labels import labelled_sample, remainder
from riskloom.llm.text import bounded_batches, word_blocks

#: Labelled documents learnt from, at most: label 1 and label 0.
GOOD_ROWS, POOR_ROWS = 4000, 2000
FOLDS, HELD_OUT = 4, 2
#: Word buckets; with the row bounds above this bounds the driver's sample at about 300 MB, far less in practice.
BUCKETS = 1 << 13
FACTORS = 6
EPOCHS, BATCH, RATE = 12, 256, 0.02
SHRINK = 1e-3
THRESHOLD = 0.7
SEED = 11

STATISTICS = ["symbols", "upper", "marked_words", "bars", "same_as_previous", "distinct", "word_length", "log_words", "log_bytes", "digits", "non_ascii", "lines"]

_KIND = np.zeros((6, 256), bool)
_KIND[0, list(b"#*$%&|<>")] = True
_KIND[1, 65:91] = True
_KIND[2, 97:123] = True
_KIND[3, 48:58] = True
_KIND[4, 128:] = True
_KIND[5, 10] = True
_MARKS = frozenset(b"#*$%&!<>")


def extract(raw: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, unit-length word values, statistics) of one text; the statistics of an empty text are zero."""
    raw = raw or b""
    counts = np.zeros(BUCKETS, np.int64)
    n = same = marked = bars = 0
    last = None
    for words in word_blocks(raw):
        h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        counts += np.bincount(h & (BUCKETS - 1), minlength=BUCKETS)
        n += len(words)
        same += int(np.count_nonzero(h[1:] == h[:-1])) + (last == h[0])
        last = h[-1]
        marked += sum(w[-1] in _MARKS for w in words)
        bars += words.count(b"|")
    index = np.flatnonzero(counts)
    if not n:
        return index, np.zeros(0), np.zeros(len(STATISTICS))
    value = np.log1p(counts[index])
    kinds = _KIND @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbols, upper, lower, digits, high, lines = (int(k) for k in kinds)
    size = len(raw)
    stats = [
        symbols / size, upper / max(1, upper + lower), marked / n, bars / n, same / n, len(index) / min(n, BUCKETS),
        min(50.0, size / n) / 10, np.log1p(n), np.log1p(size), digits / size, high / size, min(1.0, lines / n),
    ]
    return index, value / np.sqrt(value @ value), np.array(stats)


@dataclass
class Machine:
    """Weights of a factorisation machine whose first BUCKETS inputs are words and whose last are statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray, stats: np.ndarray) -> float:
        """Probability of label 1, in time linear in the number of inputs.

        The pairwise part is half of (sum of v x) squared less the sum of
        (v x) squared, per factor.
        """
        dense = np.clip((stats - self.mean) / self.scale, -4, 4)
        at = np.concatenate([index, BUCKETS + np.arange(len(dense))])
        x = np.concatenate([value, dense])
        vx = self.factors[at] * x[:, None]
        total = vx.sum(axis=0)
        z = self.bias + self.linear[at] @ x + 0.5 * float(total @ total - (vx * vx).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray) -> Machine:
    """Adam on the weighted logistic loss; deterministic for given rows in a given order."""
    stats = np.array([s for _, _, s in rows])
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    dense = np.clip((stats - mean) / scale, -4, 4)
    width = BUCKETS + stats.shape[1]
    index = [np.concatenate([i, BUCKETS + np.arange(stats.shape[1])]) for i, _, _ in rows]
    value = [np.concatenate([v, d]) for (_, v, _), d in zip(rows, dense)]
    random = np.random.default_rng(SEED)
    share = float(np.average(y, weights=weight))
    share = min(max(share, 1e-3), 1 - 1e-3)
    # One table of parameters: a linear weight and the factors of each input, and the bias in the last row.
    table = np.zeros((width + 1, 1 + FACTORS))
    table[:width, 1:] = random.normal(0, 0.02, (width, FACTORS))
    table[width, 0] = np.log(share / (1 - share))
    m, v, step = np.zeros_like(table), np.zeros_like(table), 0
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            i = np.concatenate([index[p] for p in pick])
            x = np.concatenate([value[p] for p in pick])
            size = np.array([len(index[p]) for p in pick])
            start = np.cumsum(size) - size
            vx = table[i, 1:] * x[:, None]
            total = np.add.reduceat(vx, start)
            z = table[width, 0] + np.add.reduceat(table[i, 0] * x, start) + 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), start))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / weight[pick].sum()
            each = np.repeat(error, size) * x
            gradient = np.empty_like(table)
            gradient[:, 0] = np.bincount(i, each, width + 1)
            inner = np.repeat(total, size, axis=0) - vx
            for f in range(FACTORS):
                gradient[:, 1 + f] = np.bincount(i, each * inner[:, f], width + 1)
            gradient[:width] += SHRINK * table[:width]
            gradient[width, 0] = error.sum()
            step += 1
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient * gradient - v)
            table -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Machine(float(table[width, 0]), table[:width, 0].copy(), table[:width, 1:].copy(), mean, scale)


def learn(docs: DataFrame, labels: DataFrame, good_rows: int = GOOD_ROWS, poor_rows: int = POOR_ROWS) -> Machine:
    """A machine learnt from a bounded sample of the labelled rows of the learning folds.

    Features are extracted on the executors.  Rows are weighted so that the
    sample has the labels' own proportions.  Without labels of both kinds every
    text gets the same score.
    """
    bounded_batches(docs.sparkSession)
    use = remainder(FOLDS) != HELD_OUT
    sample = labelled_sample(docs, labels, "quality", use, {1: good_rows, 0: poor_rows})

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [extract(t) for t in batch.column(1).to_pylist()]
            cols = [[i.astype("<u2").tobytes() for i, _, _ in found], [v.astype("<f4").tobytes() for _, v, _ in found], [s.astype("<f8").tobytes() for _, _, s in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in cols), batch.column(2)], ["doc_id", "i", "v", "s", "label"])

    rows = sample.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), "__label")
    got = rows.mapInArrow(run, "doc_id bigint, i binary, v binary, s binary, label int").toArrow().sort_by([("doc_id", "ascending")])
    y = np.array(got.column("label").to_pylist(), float)
    flat = Machine(0.0, np.zeros(BUCKETS + len(STATISTICS)), np.zeros((BUCKETS + len(STATISTICS), FACTORS)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    if not len(y) or y.min() == y.max():
        if len(y):
            flat.bias = 3.0 if y[0] else -3.0
        return flat
    counts = {r["quality"]: r["count"] for r in labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & use).groupBy("quality").count().collect()}
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))
    parts = zip(*(got.column(c).to_pylist() for c in "ivs"))
    features = [(np.frombuffer(i, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(float), np.frombuffer(s, "<f8")) for i, v, s in parts]
    return train(features, y, weight)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each whole text.

    NULL and empty texts are scored from their zero statistics; repeated rows
    are scored one by one; other columns play no part.
    """
    m = learn(docs, labels)
    # Plain values: a broadcast class would have to be importable on the executors.
    shared = docs.sparkSession.sparkContext.broadcast((m.bias, m.linear, m.factors, m.mean, m.scale))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*shared.value)
        for batch in it:
            score = [machine.score(*extract(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(run, "doc_id bigint, score double")
    return found.select("doc_id", (remainder(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
