"""Ordered look-back and look-ahead over long series without one task per key.

A plain window over ``customer_id`` puts a whole customer into one task. These
helpers window over (key, chunk) - a month of readings, some 3,000 of 15 minutes - and
carry the edge values from chunk to chunk through a small summary, one row per key and
chunk. Readings are shuffled once; only the summary is ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK = "_chunk"


def with_chunk(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(CHUNK, F.trunc(F.to_date(F.col(ts)), "MM"))


def _keys_equal(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: dict[str, str],
    ts: str = "ts",
) -> DataFrame:
    """Add the value of the row before, per key in ``order``.

    ``columns`` maps each input column to its output name. The first row of a
    chunk takes the last row of the nearest earlier chunk. ``_has_prev`` tells a
    missing previous row from a previous row with a null value.
    """
    d = with_chunk(df, ts)
    part = [*keys, CHUNK]
    w = W.partitionBy(*part).orderBy(*order)
    edge = F.max_by(F.struct(*[F.col(c).alias(o) for c, o in columns.items()]),
                    F.struct(*order)).alias("_edge")
    summary = d.groupBy(*part).agg(edge)
    ws = W.partitionBy(*keys).orderBy(CHUNK) if keys else W.orderBy(CHUNK)
    summary = summary.withColumn("_carry", F.lag("_edge").over(ws)).select(*part, "_carry")

    d = d.withColumn("_rn", F.row_number().over(w))
    for c, o in columns.items():
        d = d.withColumn(o, F.lag(c).over(w))
    d = d.join(summary, part, "left")
    first = F.col("_rn") == 1
    for o in columns.values():
        d = d.withColumn(o, F.when(first, F.col(f"_carry.{o}")).otherwise(F.col(o)))
    d = d.withColumn("_has_prev", ~first | F.col("_carry").isNotNull())
    return d.drop("_rn", "_carry", CHUNK)


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *values: str,
    ts: str = "ts",
) -> DataFrame:
    """Add row position and, per value column, its nearest non-null values on both sides.

    Output columns: ``_i`` (position in the key, from 1), ``_pv``/``_pi`` (value
    and position of the last non-null row at or before), ``_nv``/``_ni`` (first
    non-null row at or after). With several values their names end with the number of
    the value, from 0. All values share one window and one summary.
    """
    ends = {v: "" if len(values) == 1 else str(j) for j, v in enumerate(values)}
    d = with_chunk(df, ts)
    part = [*keys, CHUNK]
    w = W.partitionBy(*part).orderBy(*order)
    d = d.withColumn("_k", F.row_number().over(w))
    d = d.withColumns({f"_seen{e}": F.when(F.col(v).isNotNull(), F.struct(
        F.col(v).alias("v"), F.col("_k").alias("k"))) for v, e in ends.items()})
    # Frames that end at the row, in both directions: one that starts there is read to its end
    # again for every row, which is quadratic in the rows of a chunk or the chunks of a key.
    so_far = (W.unboundedPreceding, W.currentRow)
    back = w.rowsBetween(*so_far)
    ahead = W.partitionBy(*part).orderBy(F.desc("_k")).rowsBetween(*so_far)
    d = d.withColumns({f"_before{e}": F.last(f"_seen{e}", True).over(back) for e in ends.values()})
    d = d.withColumns({f"_after{e}": F.last(f"_seen{e}", True).over(ahead) for e in ends.values()})

    at = {e: F.when(F.col(f"_seen{e}").isNotNull(), F.col("_k")) for e in ends.values()}
    summary = d.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min_by(f"_seen{e}", at[e]).alias(f"_first{e}") for e in ends.values()],
        *[F.max_by(f"_seen{e}", at[e]).alias(f"_last{e}") for e in ends.values()])
    ws = W.partitionBy(*keys).orderBy(CHUNK) if keys else W.orderBy(CHUNK)
    wr = (W.partitionBy(*keys) if keys else W).orderBy(F.desc(CHUNK))
    past, to_come = (x.rowsBetween(W.unboundedPreceding, -1) for x in (ws, wr))
    summary = summary.withColumn("_off", F.coalesce(F.sum("_n").over(past), F.lit(0)))

    def globally(edge: str) -> Column:
        return F.when(F.col(edge).isNotNull(), F.struct(
            F.col(f"{edge}.v").alias("v"), (F.col(f"{edge}.k") + F.col("_off")).alias("k")))

    summary = summary.withColumns({f"{s}{e}": globally(f"{s}{e}") for e in ends.values()
                                   for s in ("_first", "_last")})
    summary = summary.select(
        *part, "_off", *[F.last(f"_last{e}", True).over(past).alias(f"_pc{e}") for e in ends.values()],
        *[F.last(f"_first{e}", True).over(to_come).alias(f"_nc{e}") for e in ends.values()])
    d = d.join(summary, part, "left").withColumn("_i", F.col("_k") + F.col("_off"))
    for e in ends.values():
        for inside, edge, v, i in (("_before", "_pc", "_pv", "_pi"), ("_after", "_nc", "_nv", "_ni")):
            own = F.col(inside + e).isNotNull()
            d = d.withColumns({
                v + e: F.when(own, F.col(f"{inside}{e}.v")).otherwise(F.col(f"{edge}{e}.v")),
                i + e: F.when(own, F.col(f"{inside}{e}.k") + F.col("_off")).otherwise(
                    F.col(f"{edge}{e}.k"))})
    return d.drop("_k", "_off", CHUNK, *[c + e for e in ends.values() for c in (
        "_seen", "_before", "_after", "_pc", "_nc")])
