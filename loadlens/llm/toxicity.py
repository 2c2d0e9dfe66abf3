"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text has the set of its hashed words, pairs of neighbours and pairs with one word between.
Training takes mini-batches: the tasks add up gradients per coordinate with the current
weights, and the driver updates the FTRL state of the coordinates (per-coordinate rates from
the summed squared gradients, L1 sparsity). Coordinates seen in fewer than ``min_rows``
training rows are left out, so the state is bounded by the fitting sample, and the weights
that are broadcast are only those that L1 leaves.

Cases: null and empty texts have no features and get the score of the bias. Without a
labelled row of both classes every score is the share of label 1 (0 if there is none).
Null ids and repeated rows are scored like any other; rows with null labels, or labels for
unknown ids, teach nothing; of several labels of one id the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from loadlens.llm.workers import map_rows, mix, opened, share, ship, words_of
from loadlens.session import work_dir

ship(__name__)

SLOTS = 1 << 24
KEPT = 300_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Slots of words, neighbours and words with one between; repeats included."""
    words = words_of(text)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    turned = h * np.uint64(0x9E3779B97F4A7C15)
    pairs = turned[:-1] ^ (h[1:] + np.uint64(1))
    skips = turned[:-2] ^ (h[2:] + np.uint64(2))
    return (mix(np.concatenate([h, pairs, skips])) & np.uint64(SLOTS - 1)).astype(np.int32)


@dataclass
class Model:
    """Slots with a weight, sorted; their weights; the bias."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float


def _ftrl(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: np.ndarray, l2: float):
    w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
    return np.where(np.abs(z) <= l1, 0.0, w)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id",
        text_col: str = "text", fit_rows: int = 8_000, min_rows: int = 4, batches: int = 10,
        epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0,
        l2: float = 0.1) -> Model:
    """Learn from at most about ``fit_rows`` labelled documents, chosen by a hash of the id.

    ``l1`` counts standard deviations: the threshold of a coordinate is that many times the
    spread that its summed gradient has if its rows are toxic no more often than others.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")
                          ).filter("i is not null and y is not null").groupBy("i").agg(
        F.max("y").alias("y"))
    n = known.count()
    share = F.pmod(F.xxhash64(F.col("i"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    known = known.filter(share * n < fit_rows)
    text = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(
        F.broadcast(known), "i")

    def slots(rows: Iterator[dict]):
        hashes = WordHashes()
        for b in rows:
            for i, t, y in zip(b["i"], b["t"], b["y"]):
                part = xxhash.xxh32_intdigest(repr(i)) % batches
                yield part, int(y > 0), np.unique(features(t, hashes)).tolist()

    path = work_dir(spark, "toxicity")
    map_rows(text, "part int, y int, f array<int>", slots, flush=512).write.partitionBy(
        "part").parquet(path)
    rows = spark.read.schema("part int, y int, f array<int>").parquet(path)
    total, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if positive in (0, total):
        edge = 35.0 if positive else -35.0
        return Model(np.array([], np.int64), np.array([]), edge)
    kept = rows.select(F.explode("f").alias("f")).groupBy("f").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows).toArrow()
    order = np.argsort(kept.column("f").to_numpy())
    index = kept.column("f").to_numpy()[order].astype(np.int64)
    share = positive / total
    floor = l1 * np.sqrt(kept.column("n").to_numpy()[order] * share * (1.0 - share))
    floor = np.append(floor, 0.0)  # the bias is the last coordinate
    z, g2 = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    # The bias starts at the log-odds of label 1.
    start = float(np.log(positive / (total - positive)))
    g2[-1] = 1.0
    z[-1] = -start * ((beta + 1.0) / alpha + l2)
    known = spark.sparkContext.broadcast(index)
    for step in range(batches * epochs):
        w = _ftrl(z, g2, alpha, beta, floor, l2)
        g, sq = np.zeros(len(w)), np.zeros(len(w))
        live = np.flatnonzero(w)
        current = spark.sparkContext.broadcast((live, w[live]))
        for r in _gradients(rows.filter(F.col("part") == step % batches), known,
                            current).collect():
            at = np.frombuffer(r["f"], np.int32)
            g[at] += np.frombuffer(r["g"])
            sq[at] += np.frombuffer(r["s"])
        current.destroy()  # else a copy of each step stays on every executor
        z += g - (np.sqrt(g2 + sq) - np.sqrt(g2)) / alpha * w
        g2 += sq
    w = _ftrl(z, g2, alpha, beta, floor, l2)
    live = np.flatnonzero(w[:-1])
    return Model(index[live], w[:-1][live], float(w[-1]))


def _gradients(rows: DataFrame, known, current) -> DataFrame:
    """One row per task: the coordinates with a gradient, its sum g and its sum of squares s over
    the task's rows, packed. The fitting sample bounds their number."""

    def add(batches: Iterator[dict]):
        own = known.value
        weights = np.zeros(len(own) + 1)
        live, values = current.value
        weights[live] = values
        g, s = np.zeros(len(weights)), np.zeros(len(weights))
        for b in batches:
            for y, f in zip(b["y"], b["f"]):
                f = np.array(f, np.int64)
                at = np.minimum(np.searchsorted(own, f), len(own) - 1) if len(own) else f[:0]
                at = np.append(at[own[at] == f] if len(own) else at, len(weights) - 1)
                p = 1.0 / (1.0 + np.exp(-np.clip(weights[at].sum(), -35, 35)))
                g[at] += p - y
                s[at] += (p - y) ** 2
        at = np.flatnonzero(s)
        yield at.astype(np.int32).tobytes(), g[at].tobytes(), s[at].tobytes()

    return map_rows(rows.select("y", "f"), "f binary, g binary, s binary", add)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, score) per row; score is the probability of label 1."""
    shared = share(docs.sparkSession, model)

    def rows(batches: Iterator[dict]):
        m = opened(shared)
        weighted = np.zeros(SLOTS, np.bool_)
        weighted[m.slots] = True
        hashes = WordHashes()
        for b in batches:
            for i, t in zip(b["k"], b["t"]):
                f = features(t, hashes)
                f = np.unique(f[weighted[f]])
                x = m.bias + m.weights[np.searchsorted(m.slots, f)].sum()
                yield i, float(1.0 / (1.0 + np.exp(-np.clip(x, -35, 35))))

    kind = docs.select(id_col).dtypes[0][1]
    return map_rows(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")),
                    f"`{id_col}` {kind}, score double", rows)

