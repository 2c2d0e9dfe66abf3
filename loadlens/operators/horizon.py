"""Billing months, partial-month horizons and calendar lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loadlens.functions import calendar as cal
from loadlens.functions.joins import many_tasks
from loadlens.functions.scalars import sum0

HORIZONS = (10, 20)


def build_horizon_table(
    daily: DataFrame,
    horizons=HORIZONS,
    meter_day: int | None = None,
    meter_day_col: str | None = None,
    meter_days: tuple[int, ...] | None = None,
    observed_basis: str = "elapsed",
) -> DataFrame:
    """One row per customer, billing month and horizon that has an observed day.

    The partial sums of all horizons come from one grouped pass. ``meter_days``
    evaluates many meter days in the same job by exploding them on the daily
    table. ``days_observed`` is min(h, days of the month with data); with
    ``observed_basis="present"`` it counts the days with data before the horizon.
    """
    keys = ["customer_id", "year_month"]
    # With many meter days a task holds several times the rows that it reads, so its share must
    # not be set by the size of those: a fixed number of tasks is not merged afterwards.
    d = (daily.repartition(many_tasks(daily.sparkSession), "customer_id") if meter_days
         else daily.repartition("customer_id"))
    if meter_days:
        d = d.withColumn("meter_day", F.explode(F.array(*[F.lit(m) for m in meter_days])))
        md: Column = F.col("meter_day")
        keys = ["meter_day", *keys]
    elif meter_day_col and meter_day_col in daily.columns:
        md = F.col(meter_day_col)
    else:
        md = F.lit(meter_day or 1)
    start = cal.billing_start(F.col("date"), md)
    month = _billing_months(d, start, keys, horizons)
    return _explode_horizons(month, keys, horizons, observed_basis)


def _billing_months(d: DataFrame, start: Column, keys: list[str], horizons) -> DataFrame:
    """One row per billing month with the partial sums of every horizon.

    The daily table is shuffled once, on the customer; the two aggregations and
    the window below reuse that partitioning. Days with data are a bit set of
    the day offsets, so a day under two contract types counts once.
    """
    owner = [k for k in keys if k != "year_month"]
    d = d.withColumn("_start", start)
    d = d.withColumn("_elapsed", F.datediff("date", "_start")).withColumn(
        "year_month", F.trunc("_start", "MM"))
    x, e = F.col("day_kwh"), F.col("_elapsed")
    per_type = d.groupBy(*keys, "contract_type").agg(
        sum0(x).alias("full_month_kwh"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), e)).alias("_days"),
        *[F.sum(F.when(e < h, x)).alias(f"_p{h}") for h in horizons],
    )
    w = W.partitionBy(*owner).orderBy("year_month", "contract_type")
    per_type = per_type.withColumn("contract_type", F.first("contract_type").over(w))
    return per_type.groupBy(*keys, "contract_type").agg(
        F.sum("full_month_kwh").alias("full_month_kwh"),
        F.bit_or("_days").alias("_days"),
        *[F.sum(f"_p{h}").alias(f"_p{h}") for h in horizons],
    )


def _explode_horizons(month: DataFrame, keys: list[str], horizons, observed_basis: str,
                      carry: tuple[str, ...] = ()) -> DataFrame:
    month = month.withColumns({
        "days_in_month": F.bit_count("_days").cast("bigint"),
        "calendar_days": cal.days_in_month(F.col("year_month")),
    })
    rows = month.withColumn("_h", F.explode(F.array(*[
        F.struct(F.lit(h).alias("h"), F.col(f"_p{h}").alias("p"),
                 F.bit_count(F.col("_days").bitwiseAND(F.lit((1 << h) - 1))).alias("n"))
        for h in horizons])))
    rows = rows.where(F.col("_h.n") > 0)
    observed = (F.least(F.col("_h.h").cast("bigint"), F.col("days_in_month"))
                if observed_basis == "elapsed" else F.col("_h.n"))
    return rows.select(
        *keys, "contract_type",
        F.col("_h.h").alias("horizon_days"),
        F.col("_h.p").alias("partial_kwh"),
        "full_month_kwh", "days_in_month", "calendar_days",
        observed.cast("bigint").alias("days_observed"),
        (F.col("full_month_kwh") - F.col("_h.p")).alias("remainder_kwh"),
        *carry,
    )


def calendar_context(daily: DataFrame, horizons=HORIZONS,
                     observed_basis: str = "elapsed") -> DataFrame:
    """Horizon table with alarm context for calendar months, in one lineage.

    Billing month and calendar month coincide here, so the lags are range
    windows over the same monthly rows: no join and no second roll-up.
    """
    keys = ["customer_id", "year_month"]
    d = daily.repartition("customer_id")
    month = _billing_months(d, F.trunc("date", "MM"), keys, horizons)
    w = W.partitionBy("customer_id").orderBy(cal.month_index(F.col("year_month")))
    x = F.col("full_month_kwh")
    month = month.withColumns({
        "prev_month_kwh": F.max(x).over(w.rangeBetween(-1, -1)),
        "yoy_month_kwh": F.max(x).over(w.rangeBetween(-12, -12)),
        "ma3_kwh": F.avg(x).over(w.rangeBetween(-3, -1)),
        "customer_mean_history": F.avg(x).over(w.rangeBetween(W.unboundedPreceding, -1)),
    })
    return _explode_horizons(month, keys, horizons, observed_basis,
                             ("prev_month_kwh", "yoy_month_kwh", "ma3_kwh",
                              "customer_mean_history"))


def one_per_month(monthly: DataFrame) -> DataFrame:
    """One total per customer and month over its contract types."""
    return monthly.groupBy("customer_id", "year_month").agg(
        F.sum("monthly_kwh").alias("monthly_kwh"))


def lag_lookup(monthly: DataFrame) -> DataFrame:
    """Previous month, same month last year and mean of the last three months.

    Each month is sent to the months that look back on it, so any target month
    is served by one grouped pass, also where the month itself has no data.
    """
    sent = one_per_month(monthly).withColumn(
        "_k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(12))))
    x, k = F.col("monthly_kwh"), F.col("_k")
    return sent.groupBy(
        "customer_id", F.add_months("year_month", k).alias("year_month")
    ).agg(
        F.max(F.when(k == 1, x)).alias("prev_month_kwh"),
        F.max(F.when(k == 12, x)).alias("yoy_month_kwh"),
        F.avg(F.when(k <= 3, x)).alias("ma3_kwh"),
    )


def attach_alarm_context(horizon: DataFrame, monthly: DataFrame) -> DataFrame:
    return horizon.join(lag_lookup(monthly), ["customer_id", "year_month"], "left")


def calendar_lags(monthly: DataFrame) -> DataFrame:
    """Calendar lags as range windows over the month number (months that have data)."""
    m = one_per_month(monthly).withColumn("_mi", cal.month_index(F.col("year_month")))
    w = W.partitionBy("customer_id").orderBy("_mi")
    return m.select(
        "customer_id", "year_month", "monthly_kwh",
        F.max("monthly_kwh").over(w.rangeBetween(-1, -1)).alias("prev_month_kwh"),
        F.max("monthly_kwh").over(w.rangeBetween(-12, -12)).alias("yoy_month_kwh"),
        F.avg("monthly_kwh").over(w.rangeBetween(-3, -1)).alias("ma3_kwh"),
        F.avg("monthly_kwh").over(w.rowsBetween(W.unboundedPreceding, -1))
        .alias("customer_mean_history"),
    )


def row_lags(monthly: DataFrame) -> DataFrame:
    """Lags by row, not by calendar: a gap in the months is stepped over."""
    w = W.partitionBy("customer_id").orderBy("year_month", "contract_type")
    last3 = w.rowsBetween(-3, -1)
    x = F.col("monthly_kwh")
    return monthly.select(
        "customer_id", "contract_type", "year_month", "monthly_kwh",
        F.lag(x, 1).over(w).alias("prev_m"),
        F.lag(x, 12).over(w).alias("prev_year_same_m"),
        F.when(F.count(x).over(last3) == 3, F.avg(x).over(last3)).alias("ma3"),
    )
