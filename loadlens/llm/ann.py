"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample (``fit_rows`` vectors); every vector is indexed into
the leaf it reaches by the nearest centre at each node. A query keeps the tree's nodes in a
priority queue by the distance of their centres and visits leaves in the order in which they
come out of it. How many leaves it visits is calibrated: for a bounded sample of vectors that
are no queries the true neighbours are found by brute force, and visits are widened until
``recall`` of them lie in the visited leaves. A query whose leaves hold too few vectors for its
list goes on to further ones.

Equal vectors are stored once, with the ``k + 1`` smallest ids of each, which is all that a
list of ``k`` neighbours can need; so a vector that a third of the rows share is one entry.
Leaves are searched in blocks of vectors and blocks of queries, each a task group of its own.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, and
neither do vectors whose length is not the most frequent one (the larger, if tied), nor rows
with a null id. Repeated rows count once. A query with fewer candidates gets all of them; with
no valid vectors or no queries the result is empty. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loadlens.llm.workers import map_rows, opened, share, ship
from loadlens.session import write_and_read

ship(__name__)

VECTORS_IN_BLOCK = 4096
QUERIES_IN_BLOCK = 1024


@dataclass
class Tree:
    """Nodes by number; node 0 is the root. ``children`` is empty for a leaf."""

    centres: np.ndarray
    children: list[np.ndarray]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf that each row of ``x`` reaches."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            own = self.children[node]
            if not len(own) or not len(rows):
                out[rows] = node
                continue
            near = own[np.argmin(_squares(x[rows], self.centres[own]), axis=1)]
            todo += [(int(c), rows[near == c]) for c in own]
        return out

    def visits(self, q: np.ndarray, most: int, held: np.ndarray | None = None,
               least: int = 0) -> list[int]:
        """The first ``most`` leaves in best-bin-first order, and more until they hold ``least``
        ids; ``held`` has the number of ids by node."""
        queue, out, have = [(0.0, 0)], [], 0
        while queue and (len(out) < most or have < least):
            _, node = heapq.heappop(queue)
            own = self.children[node]
            if not len(own):
                out.append(node)
                have += least if held is None else int(held[node])
                continue
            for d, c in zip(_squares(q[None, :], self.centres[own])[0].tolist(), own.tolist()):
                heapq.heappush(queue, (d, c))
        return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin(_squares(x, centres), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def build_tree(sample: np.ndarray, branching: int = 12, leaf_rows: int = 40,
               seed: int = 7) -> Tree:
    """Split the sample by k-means until a node holds at most ``leaf_rows`` of its vectors."""
    rng = np.random.default_rng(seed)
    centres: list[np.ndarray] = [sample.mean(axis=0) if len(sample) else np.zeros(1)]
    children: list[np.ndarray] = [np.zeros(0, np.int64)]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf_rows:
            continue
        found = _lloyd(sample[rows], min(branching, len(rows)), rng)
        near = np.argmin(_squares(sample[rows], found), axis=1)
        used = np.unique(near)
        if len(used) < 2:
            continue
        first = len(centres)
        for i, c in enumerate(used):
            centres.append(found[c])
            children.append(np.zeros(0, np.int64))
            todo.append((first + i, rows[near == c]))
        children[node] = np.arange(first, first + len(used))
    return Tree(np.array(centres), children)


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct rows (id bigint, v array<double>) that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = table.select(F.col(id_col).cast("bigint").alias("id"),
                       F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    lengths = own.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(
        F.desc("c"), F.desc("n")).first()
    return own.filter(F.size("v") == (lengths["n"] if lengths else 0))


def _distinct(own: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector with its k + 1 smallest ids."""
    w = Window.partitionBy("v").orderBy("id")
    least = own.distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    return least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 1))


def _index(distinct: DataFrame, tree: Tree) -> DataFrame:
    shared = share(distinct.sparkSession, tree)

    def rows(batches: Iterator[dict]):
        own = opened(shared)
        for b in batches:
            leaves = own.leaf_of(_matrix(b["v"]))
            yield from zip(leaves.tolist(), b["ids"], b["v"])

    return map_rows(distinct, "leaf bigint, ids array<bigint>, v array<double>", rows)


def nearest(q: np.ndarray, own: int | None, ids: list, x: np.ndarray, k: int) -> list[tuple]:
    """The k nearest (distance, id) to ``q`` among vectors ``x`` with id lists, without ``own``."""
    rough = _squares(q[None, :], x)[0]
    slack = 1e-9 * (1.0 + float((q * q).sum()) + float((x * x).sum(1).max(initial=0.0)))
    near = np.flatnonzero(rough <= np.partition(rough, min(k, len(x) - 1))[min(k, len(x) - 1)]
                          + slack) if len(x) else np.zeros(0, np.int64)
    exact = np.sqrt(((x[near] - q) ** 2).sum(axis=1))
    found = [(d, i) for d, at in zip(exact.tolist(), near.tolist()) for i in ids[at] if i != own]
    return heapq.nsmallest(k, found)


def brute_force(queries: list[tuple], table: DataFrame, k: int) -> DataFrame:
    """(query, leaf, score, id): a stated list of (id, vector) against every row of ``table``
    (leaf, ids, v); each task keeps its k best per query, and so does the whole."""
    shared = table.sparkSession.sparkContext.broadcast(queries)

    def rows(batches: Iterator[dict]):
        best: list[list[tuple]] = [[] for _ in shared.value]
        for b in batches:
            x = _matrix(b["v"])
            leaf = {i: at for at, ids in zip(b["leaf"], b["ids"]) for i in ids}
            for n, (own, q) in enumerate(shared.value):
                got = [(d, i, leaf[i]) for d, i in nearest(np.array(q), own, b["ids"], x, k)]
                best[n] = heapq.nsmallest(k, best[n] + got)
        for (own, _), got in zip(shared.value, best):
            for d, i, at in got:
                yield own, at, d, i

    found = map_rows(table, "query bigint, leaf bigint, score double, id bigint", rows)
    w = Window.partitionBy("query").orderBy("score", "id")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def calibrate(index: DataFrame, tree: Tree, sample: list[tuple], k: int, recall: float) -> int:
    """Leaf visits after which ``recall`` of the true neighbours of the sample are reached."""
    leaves = sum(1 for c in tree.children if not len(c))
    if not sample or leaves == 1:
        return leaves
    order = {own: {leaf: n for n, leaf in enumerate(tree.visits(np.array(q), leaves))}
             for own, q in sample}
    ranks = sorted(order[r["query"]][r["leaf"]]
                   for r in brute_force(sample, index, k).collect())
    return ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] + 1 if ranks else leaves


def search(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
           vector_col: str = "embedding", recall: float = 0.98, fit_rows: int = 20_000,
           calibration_rows: int = 100) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest rows found for each row of ``table`` that
    ``is_query`` (an expression over the id column) selects."""
    spark = table.sparkSession
    own = valid_vectors(table, id_col, vector_col)
    distinct = write_and_read(_distinct(own, k), "ann-vectors")
    total = distinct.count()
    u = F.pmod(F.xxhash64("v", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    fit = distinct.filter(u * max(total, 1) < fit_rows).select("v").toArrow()
    sample = _matrix(fit.column("v").to_pylist())
    tree = build_tree(sample[np.lexsort(sample.T)] if len(sample) else sample)
    index = write_and_read(_index(distinct, tree), "ann-index")
    queries = own.distinct().withColumnRenamed("id", id_col).filter(is_query).withColumnRenamed(
        id_col, "id")
    u = F.pmod(F.xxhash64("v", F.lit("calibrate")), F.lit(1 << 30)) / float(1 << 30)
    trial = index.filter(u * max(total, 1) < calibration_rows).select(
        F.get("ids", F.lit(0)).alias("id"), "v").orderBy("id").limit(4 * calibration_rows)
    visits = calibrate(index, tree, [tuple(r) for r in trial.collect()], k, recall)
    held = np.zeros(len(tree.children), np.int64)
    for r in index.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n")).collect():
        held[r["leaf"]] = r["n"]
    shared = share(spark, (tree, held))

    def plan(batches: Iterator[dict]):
        own, n = opened(shared)
        for b in batches:
            for i, v in zip(b["id"], b["v"]):
                for leaf in own.visits(np.array(v), visits, n, k + 1):
                    yield leaf, i, v

    asked = map_rows(queries.select("id", "v"), "leaf bigint, id bigint, v array<double>", plan)
    return _search_leaves(index, asked, k).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")


def _search_leaves(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Compare queries with the vectors of their leaves, block by block, and keep the best."""

    def blocks(df: DataFrame, size: int, key: Column) -> DataFrame:
        n = df.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
        return df.join(n, "leaf").withColumn("block", F.pmod(F.xxhash64(key), F.col("n")))

    asked = write_and_read(asked, "ann-visits")
    x = blocks(index, VECTORS_IN_BLOCK, F.col("v"))
    q = blocks(asked, QUERIES_IN_BLOCK, F.col("id"))
    n_x, n_q = (d.groupBy("leaf").agg(F.first("n").alias("m")) for d in (x, q))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("m") - 1).cast("bigint")))
    x = x.join(n_q, "leaf").select("leaf", F.col("block").alias("bx"), every.alias("bq"), "ids", "v")
    q = q.join(n_x, "leaf").select("leaf", every.alias("bx"), F.col("block").alias("bq"), "id", "v")

    def compare(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            m, ids = _matrix(left["v"]), [list(i) for i in left["ids"]]
            for i, v in zip(right["id"], right["v"]):
                found += [(i, d, at) for d, at in nearest(np.asarray(v, float), i, ids, m, k)]
        return pd.DataFrame(found, columns=["query", "score", "id"]).astype(
            {"query": "int64", "score": "float64", "id": "int64"})

    keys = ["leaf", "bx", "bq"]
    found = x.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(
        compare, "query bigint, score double, id bigint")
    w = Window.partitionBy("query").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
