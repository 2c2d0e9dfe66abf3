"""Connected components of a link table, by alternating large-star and small-star steps.

Each step sends the neighbours of a node to the smallest of them; the links turn into stars
around the smallest node of each component in a number of rounds that grows with the
logarithm of the component size. Every round is one aggregation and one join on the node,
written to the shared work folder; no component is ever gathered anywhere. Nodes with very
many links are pre-aggregated by the minimum and split by adaptive execution in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loadlens.session import write_and_read


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("a", "b"),
                                          F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
                                          )).alias("x")).select("x.a", "x.b")


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Rows (a, b) with b < a: neighbours above a node (or those below it, and the node
    itself) point to the smallest neighbour."""
    least = pairs.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    near = pairs.join(least, pairs["a"] == least["n"])
    if larger:
        m = F.least("m", "a")
        out = near.filter("b > a").select(F.col("b").alias("a"), m.alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the least node reachable.

    Cases: links of a node with itself are ignored, repeated links count once, an empty table
    gives an empty table, rows with a null end are no links.
    """
    links = write_and_read(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(
            "a is not null and b is not null and a <> b").distinct(), "components")
    before = _state(links)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        stars = _star(_both(links), larger=True)
        links = write_and_read(_star(stars, larger=False), "components")
        now = _state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
