"""Regression and alarm metrics by any set of dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions.quantiles import exact_quantiles
from loadlens.functions.scalars import EPS
from loadlens.operators import alarm as al
from loadlens.operators.rollup import not_null

TRUE, PRED = "full_month_kwh", "pred_monthly_kwh"


def regression_aggs(true: str = TRUE, pred: str = PRED) -> list[Column]:
    """Error measures over rows with both sides present and a positive truth."""
    y, p = F.col(true), F.col(pred)
    ok = y.isNotNull() & p.isNotNull() & (y > 0)
    err = F.when(ok, p - y)
    yt = F.when(ok, y)
    rmse = F.sqrt(F.avg(err * err))
    return [
        F.count(err).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        rmse.alias("rmse"),
        (rmse / F.avg(yt) * 100).alias("nrmse_pct"),
        (rmse / F.avg(yt) * 100).alias("cvrmse_pct"),
        (F.avg(F.abs(err) / yt) * 100).alias("mape_pct"),
        (F.avg(2 * F.abs(err) / (yt + F.abs(p))) * 100).alias("smape_pct"),
        F.avg(err).alias("bias"),
        F.stddev_pop(err).alias("std_error"),
    ]


def customer_cvrmse(df: DataFrame, keys: list[str], true: str = TRUE,
                    pred: str = PRED) -> DataFrame:
    """CVRMSE of each customer with at least two valid rows."""
    y, p = F.col(true), F.col(pred)
    v = df.where(y.isNotNull() & p.isNotNull() & (y > 0))
    g = v.groupBy(*keys, "customer_id").agg(
        F.count(F.lit(1)).alias("_n"),
        (F.sqrt(F.avg((p - y) * (p - y))) / F.avg(y) * 100).alias("cvrmse"))
    return g.where(F.col("_n") >= 2)


def customer_spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of the per-customer CVRMSE in each group, exact for any group size."""
    return exact_quantiles(customer_cvrmse(df, keys), keys, "cvrmse", {
        "cvrmse_q25_pct": 0.25, "cvrmse_median_pct": 0.5, "cvrmse_q75_pct": 0.75})


def labelled(df: DataFrame) -> DataFrame:
    return al.with_alarms(al.with_alarms(df, PRED, "pred"), TRUE, "true")


def evaluate_rows(rows: DataFrame, group_cols=("horizon_days", "contract_type")) -> DataFrame:
    """Regression and alarm metrics per group, in one aggregation."""
    group_cols = list(group_cols)
    return not_null(labelled(rows), *group_cols).groupBy(*group_cols).agg(
        *regression_aggs(),
        *al.classification(F.col("pred_any"), F.col("true_any")))


def evaluate(predictions: DataFrame, context: DataFrame,
             group_cols=("horizon_days", "contract_type")) -> DataFrame:
    """Score predictions that come from elsewhere against the context table."""
    keys = ["customer_id", "year_month", "horizon_days"]
    return evaluate_rows(context.join(predictions, keys), group_cols)


def error_columns(results: DataFrame) -> DataFrame:
    """Signed, absolute and percent error per prediction."""
    err = F.col(PRED) - F.col(TRUE)
    return results.withColumns({
        "error": err, "abs_error": F.abs(err),
        "pct_error": F.abs(err) / F.greatest(F.col(TRUE), F.lit(EPS)) * 100,
        "month": F.month("year_month"),
    })


def error_by_dimension(
    results: DataFrame,
    dimensions: dict[str, list[str]],
    with_conditions: bool = True,
    with_spread: bool = False,
) -> DataFrame:
    """All dimension tables in one pass over the results, as grouping sets.

    Output: ``dimension`` (name of the set), one nullable column per grouping
    column, then the metrics. A row whose key is null belongs to no group.
    """
    cols = sorted({c for d in dimensions.values() for c in d})
    sets = [[F.col(c) for c in d] for d in dimensions.values()]
    r = labelled(results)
    aggs = [*regression_aggs(), *al.classification(F.col("pred_any"), F.col("true_any"))]
    if with_conditions:
        for c in al.CONDITIONS:
            aggs += al.classification(F.col(f"pred_{c}"), F.col(f"true_{c}"), f"cond_{c}")
    gid = F.grouping_id()
    out = r.groupingSets(sets, *[F.col(c) for c in cols]).agg(
        F.countDistinct("customer_id").alias("n_customers"), gid.alias("_gid"), *aggs)
    named, keep = None, None
    for name, d in dimensions.items():
        bits = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in d)
        hit = F.col("_gid") == bits
        named = F.when(hit, name) if named is None else named.when(hit, name)
        present = hit
        for c in d:
            present = present & F.col(c).isNotNull()
        keep = present if keep is None else keep | present
    out = out.where(keep).withColumn("dimension", named).drop("_gid")
    if not with_spread:
        return out
    # Medians do not nest: rows are sent to every set, then spread is taken per set.
    sent = r.withColumn("dimension", F.explode(F.array(*[F.lit(n) for n in dimensions])))
    for c in cols:
        holds = F.col("dimension").isin(*[n for n, d in dimensions.items() if c in d])
        sent = sent.withColumn(c, F.when(holds, F.coalesce(F.col(c).cast("string"),
                                                           F.lit("\x00")))
                               .otherwise(F.lit("")))
    spread = customer_spread(sent, ["dimension", *cols])
    keyed = out
    for c in cols:
        keyed = keyed.withColumn(f"_{c}", F.coalesce(F.col(c).cast("string"), F.lit("")))
    for c in cols:
        spread = spread.withColumnRenamed(c, f"_{c}")
    return keyed.join(spread, ["dimension", *[f"_{c}" for c in cols]], "left").drop(
        *[f"_{c}" for c in cols])


def extreme_dates(by_date: DataFrame, n: int = 10, worst: bool = True) -> DataFrame:
    """Billing months and meter days with the largest or smallest MAPE."""
    order = F.col("mape_pct").desc() if worst else F.col("mape_pct").asc()
    return by_date.orderBy(order, "year_month", "meter_day").limit(n)
