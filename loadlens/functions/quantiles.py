"""Exact linear-interpolated quantiles for groups of any size.

``percentile`` keeps every distinct value of a group in one task. For groups
that can hold a large share of all rows this module first takes a mergeable
sketch per group, which brackets each wanted rank, and then counts only the
values inside the brackets. Rows below a bracket collapse to one counter in the
map-side aggregation, rows above it are not emitted at all. A bracket is cut into
order-preserving buckets; their counts say which bucket holds the rank, and only the
values of that bucket are put in order, so no task orders the values of a whole bracket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from loadlens.functions.joins import estimated_bytes

ACCURACY = 10_000
SMALL_BYTES = 256 * 1024 * 1024
BUCKETS = 4096


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
                    ) -> DataFrame:
    """As ``exact_quantiles``, for many groups none of which holds more distinct values than a
    task can order: rows collapse to one count per value before they are shuffled, and one
    window over the counts gives every rank."""
    d = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = d.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*keys)
    ranked = counts.withColumns({
        "_n": F.sum("_c").over(w),
        "_hi": F.sum("_c").over(w.orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))})

    def at(rank):
        return F.max(F.when((F.col("_hi") - F.col("_c") <= rank) & (rank < F.col("_hi")), F.col("_v")))

    out, share = [], {}
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        out += [at(F.floor(pos)).alias(f"{name}_a"), at(F.ceil(pos)).alias(f"{name}_b")]
        share[name] = F.lit(float(p)) * (F.col("_n") - 1) - F.floor(F.lit(float(p)) * (F.col("_n") - 1))
    found = ranked.groupBy(*keys).agg(F.first("_n").alias("_n"), *out)
    return found.select(*keys, *[
        (F.col(f"{n}_a") + (F.col(f"{n}_b") - F.col(f"{n}_a")) * share[n]).alias(n) for n in probs])


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = ACCURACY,
    small: int = SMALL_BYTES,
) -> DataFrame:
    """One row per key with a column per entry of ``probs`` (name -> probability).

    Null values are skipped and keys must not be null. Groups without a value
    are absent. A table that the optimizer estimates below ``small`` bytes is ranked by value
    counts at once, which one task can order; the result is the same.
    """
    names = list(probs)
    keys = list(keys)
    if estimated_bytes(df) <= small:
        return group_quantiles(df, keys, value, probs)
    d = df.select(*keys, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull())
    margin = 5.0 / accuracy
    edges = []
    for name in names:
        edges += [max(probs[name] - margin, 0.0), min(probs[name] + margin, 1.0)]
    sketch = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", edges, accuracy).alias("_e"),
    )
    if keys:
        marked = d.join(sketch, keys)
    else:
        marked = d.join(F.broadcast(sketch))  # one row

    slots = []
    for i, name in enumerate(names):
        lo, hi = F.col("_e")[2 * i], F.col("_e")[2 * i + 1]
        # Below ``accuracy`` rows a bracket would be narrower than two ranks: count all.
        wide = F.col("_n") > accuracy
        below = wide & F.lit(probs[name] - margin > 0.0) & (F.col("_v") < lo)
        above = wide & F.lit(probs[name] + margin < 1.0) & (F.col("_v") > hi)
        # Order-preserving bucket of a value in its bracket; what lies below has bucket -1.
        part = F.floor((F.col("_v") - lo) / F.nullif(hi - lo, F.lit(0.0)) * BUCKETS)
        part = F.greatest(F.lit(0), F.least(F.coalesce(part, F.lit(0)), F.lit(BUCKETS)))
        slots.append(F.when(~above, F.struct(
            F.lit(i).alias("i"), F.when(below, F.lit(-1)).otherwise(part).cast("int").alias("b"),
            F.when(~below, F.col("_v")).alias("x"))))
    counted = (
        marked.withColumn("_s", F.explode(F.array_compact(F.array(*slots))))
        .groupBy(*keys, F.col("_s.i").alias("_p"), F.col("_s.b").alias("_b"),
                 F.col("_s.x").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    )
    prob = F.element_at(F.array(*[F.lit(float(probs[n])) for n in names]), F.col("_p") + 1)
    pos = prob * (F.col("_n") - 1)

    # At most BUCKETS + 2 rows per key and probability are ranked here ...
    totals = counted.groupBy(*keys, "_p", "_b").agg(
        F.sum("_c").alias("_t"), F.first("_n").alias("_n"))
    upto = F.sum("_t").over(W.partitionBy(*keys, "_p").orderBy("_b").rowsBetween(
        W.unboundedPreceding, W.currentRow))
    wanted = totals.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("_t"))
    wanted = wanted.where((F.col("_start") <= F.ceil(pos)) & (F.col("_end") > F.floor(pos)))
    # ... and here only the values of the one or two buckets that hold the wanted ranks.
    on = [*keys, "_p", "_b"]
    own = counted.join(wanted.select(*on, "_start"), on)
    w = W.partitionBy(*on).orderBy(F.col("_x").asc_nulls_first())
    ranked = own.withColumn("_hi", F.col("_start") + F.sum("_c").over(
        w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ranked = ranked.withColumn("_lo", F.col("_hi") - F.col("_c")).withColumn("_pos", pos)

    def at(rank):
        return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_x")))

    spread = ranked.groupBy(*keys, "_p").agg(
        at(F.floor("_pos")).alias("_a"),
        at(F.ceil("_pos")).alias("_b"),
        F.first(F.col("_pos") - F.floor("_pos")).alias("_f"),
    )
    missed = F.col("_a").isNull() | F.col("_b").isNull()
    spread = spread.withColumn("_q", F.when(missed, F.raise_error(F.lit(
        "a rank lies outside its sketch bracket")).cast("double")).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")))
    out = [F.max(F.when(F.col("_p") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)]
    return spread.groupBy(*keys).agg(*out)
