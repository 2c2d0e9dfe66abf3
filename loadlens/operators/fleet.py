"""Fleet figures, customer reports and chart tables over scored customer-months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from loadlens.functions.scalars import count_if, ratio
from loadlens.operators import billing, metrics


def _fleet(rows: DataFrame, horizon: int = 20) -> DataFrame:
    return metrics.labelled(rows.where(F.col("horizon_days") == horizon))


def kpis(rows: DataFrame, horizon: int = 20) -> DataFrame:
    """Customers, latest month, alarms of that month and their rate (three conditions)."""
    d = _fleet(rows, horizon)
    per_month = d.groupBy("year_month").agg(
        count_if(F.col("pred_any")).alias("a"), F.count(F.lit(1)).alias("n"))
    latest = per_month.agg(F.max_by(F.struct("year_month", "a", "n"), "year_month").alias("s"))
    n = rows.agg(F.countDistinct("customer_id").alias("n_customers"))
    return n.join(F.broadcast(latest)).select(  # one row each
        "n_customers", F.col("s.year_month").alias("latest_month"), F.col("s.a").alias("n_alarms"),
        ratio(F.col("s.a").cast("double"), F.col("s.n")).alias("alarm_rate"))


def alarm_rate_by_month(rows: DataFrame, horizon: int = 20) -> DataFrame:
    return _fleet(rows, horizon).groupBy("year_month").agg(
        F.count(F.lit(1)).alias("n"),
        (count_if(F.col("pred_any")) / F.count(F.lit(1))).alias("alarm_rate"))


def contract_mix(monthly: DataFrame) -> DataFrame:
    """Customers per contract type; the total is a one-row aggregate of the small result."""
    g = monthly.groupBy("contract_type").agg(F.countDistinct("customer_id").alias("n_customers"))
    total = monthly.agg(F.countDistinct("customer_id").alias("_t"))
    return g.join(F.broadcast(total)).withColumn("share", F.col("n_customers") / F.col("_t")
                                                 ).drop("_t")


def latest_per_customer(rows: DataFrame) -> DataFrame:
    """Latest scored month of each customer."""
    w = W.partitionBy("customer_id").orderBy(F.col("year_month").desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_months(monthly: DataFrame, n: int = 12) -> DataFrame:
    w = W.partitionBy("customer_id").orderBy(F.col("year_month").desc())
    return monthly.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def customer_report(rows: DataFrame, horizon: int = 20) -> DataFrame:
    """One row per customer: prediction, deltas, alarm reasons and bill impact."""
    d = latest_per_customer(_fleet(rows, horizon)).withColumn("month", F.month("year_month"))
    p = F.col("pred_monthly_kwh")
    for name, c in (("prev", "prev_month_kwh"), ("yoy", "yoy_month_kwh"), ("ma3", "ma3_kwh")):
        d = d.withColumn(f"{name}_delta_pct", (ratio(p, F.col(c)) - 1) * 100)
    return billing.bill_increase(d, "pred_monthly_kwh", "prev_month_kwh")


def model_means(rows: DataFrame) -> DataFrame:
    """Mean percent error and R2 per model and horizon."""
    y, p = F.col("full_month_kwh"), F.col("pred_monthly_kwh")
    d = rows.where((y > 0) & p.isNotNull())
    n = F.count(F.lit(1))
    return d.groupBy("model", "horizon_days").agg(
        n.alias("n"), (F.avg(F.abs(p - y) / y) * 100).alias("mean_mape"),
        (1 - F.sum((p - y) * (p - y)) / F.nullif(F.var_pop(y) * n, F.lit(0.0))).alias("r2"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Equal-width bins: one per 50 rows, at least 30 and at most 100."""
    d = rows.where(F.col(column).isNotNull())
    span = d.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"),
                 F.least(F.lit(100), F.greatest(F.lit(30), F.floor(F.count(F.lit(1)) / 50)))
                 .alias("_b"))
    width = (F.col("_hi") - F.col("_lo")) / F.col("_b")
    at = F.floor((F.col(column) - F.col("_lo")) / F.nullif(width, F.lit(0.0))) + 1
    return d.join(F.broadcast(span)).groupBy(  # one row
        F.when(F.col("_hi") == F.col("_lo"), 1).otherwise(F.least(at, F.col("_b"))).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
