"""Roll-ups of readings to days, months, and per-customer measures.

Every roll-up is a grouped aggregation with map-side partial results, so only
one row per group and input split is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions import calendar as cal
from loadlens.functions.scalars import count_if, floor_eps, power_factor, ratio, sum0, sum_if

INFO_COLUMNS = ("contract_type", "contract_power_kw", "region_code", "region_sub",
                "supply_method", "usage_purpose", "industry_code")


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    """Grouping keys must be present; a missing key drops the row."""
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


def daily_by_customer(df: DataFrame) -> DataFrame:
    d = not_null(df, "customer_id", "contract_type", "ts")
    return d.groupBy("customer_id", "contract_type", cal.as_date(F.col("ts")).alias("date")).agg(
        sum0(F.col("p_active_kwh")).alias("day_kwh"))


def monthly_by_customer(daily: DataFrame) -> DataFrame:
    return daily.groupBy(
        "customer_id", "contract_type", cal.month_start(F.col("date")).alias("year_month")
    ).agg(sum0(F.col("day_kwh")).alias("monthly_kwh"))


def daily_ingest(df: DataFrame) -> DataFrame:
    """Daily table of the ingest job: energy, both reactive parts, counts, temperature."""
    d = not_null(df, "customer_id", "contract_type", "ts")
    aggs = [
        sum0(F.col("p_active_kwh")).alias("day_kwh"),
        sum0(F.col("p_reactive_lag")).alias("day_reactive_lag"),
        sum0(F.col("p_reactive_lead")).alias("day_reactive_lead"),
        sum0(F.col("p_apparent_kwh")).alias("day_apparent_kwh"),
        F.count("p_active_kwh").alias("n_intervals"),
    ]
    if "temp_c" in df.columns:
        aggs.append(F.avg("temp_c").alias("temp_c"))
    out = d.groupBy("customer_id", cal.as_date(F.col("ts")).alias("date"),
                    "contract_type").agg(*aggs)
    return out.withColumn("p_reactive_kwh", F.col("day_reactive_lag") + F.col("day_reactive_lead"))


def _is_peak(hour: Column, last: int) -> Column:
    return hour.between(10, last)


def _is_night(hour: Column) -> Column:
    return (hour >= 23) | (hour < 9)


def ami_monthly(df: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Load-shape measures per customer and month over all readings.

    Two levels: readings to (customer, day), then days to months, so the daily
    spread comes from the same pass as the sums.
    """
    d = not_null(df, "customer_id", "ts", "p_active_kwh")
    d = d.withColumn("date", cal.as_date(F.col("ts")))
    if holidays is not None:
        off = F.broadcast(holidays.select("date").distinct().withColumn("_hol", F.lit(True)))
        d = d.join(off, "date", "left")
        tou = cal.tou_with_day_rules(F.col("ts"), F.col("_hol"))
    else:
        tou = cal.tou_with_day_rules(F.col("ts"))
    x, hour = F.col("p_active_kwh"), F.hour("ts")
    lag, lead = F.coalesce("p_reactive_lag", F.lit(0.0)), F.coalesce("p_reactive_lead", F.lit(0.0))
    q = F.greatest(lag, lead)
    in_pf = (x > 0) & (q >= 0)
    day = d.withColumn("_tou", tou).groupBy("customer_id", "date").agg(
        F.sum(x).alias("kwh"),
        F.count(x).alias("n"),
        F.max(x).alias("mx"),
        sum_if(_is_peak(hour, 16), x).alias("peak"),
        sum_if(_is_night(hour), x).alias("night"),
        sum_if(in_pf, x / F.sqrt(x * x + q * q)).alias("pf_sum"),
        count_if(in_pf).alias("pf_n"),
        F.sum(lag + lead).alias("q"),
        *[sum_if(F.col("_tou") == p, x).alias(p) for p in cal.TOU_PERIODS],
    )
    weekend = cal.is_weekend(F.col("date"))
    kwh = F.sum("kwh")
    m = day.groupBy("customer_id", cal.month_start(F.col("date")).alias("year_month")).agg(
        kwh.alias("kwh"), F.sum("n").alias("n"),
        F.greatest(F.max("mx"), F.lit(0.0)).alias("mx"),
        *[F.sum(c).alias(c) for c in ("peak", "night", "pf_sum", "pf_n", "q", *cal.TOU_PERIODS)],
        ratio(sum_if(weekend, F.col("kwh")), F.sum(F.when(weekend, F.col("n")))).alias("we"),
        ratio(sum_if(~weekend, F.col("kwh")), F.sum(F.when(~weekend, F.col("n")))).alias("wd"),
        F.stddev_samp("kwh").alias("day_sd"), F.avg("kwh").alias("day_mean"),
        F.count(F.lit(1)).alias("days"),
    )
    total = F.when(F.col("kwh") > 0, F.col("kwh"))
    tou_total = F.col("off_peak") + F.col("mid_peak") + F.col("on_peak")
    tou_den = F.when(tou_total > 0, tou_total)
    return m.select(
        "customer_id", "year_month",
        (F.col("peak") / total).alias("observed_peak_ratio"),
        (F.col("night") / total).alias("observed_night_ratio"),
        (F.col("kwh") / F.col("n") / F.when(F.col("mx") > 0, F.col("mx")))
        .alias("observed_load_factor"),
        (F.col("we") / F.when(F.col("wd") > 0, F.col("wd")))
        .alias("observed_weekend_weekday_ratio"),
        F.when(F.col("days") >= 2, F.col("day_sd") / F.when(F.col("day_mean") > 0,
                                                            F.col("day_mean")))
        .alias("observed_daily_cv"),
        ratio(F.col("pf_sum"), F.col("pf_n")).alias("observed_power_factor"),
        (F.col("q") / total).alias("observed_reactive_ratio"),
        F.col("off_peak").alias("tou_off_kwh"),
        F.col("mid_peak").alias("tou_mid_kwh"),
        F.col("on_peak").alias("tou_on_kwh"),
        (F.col("off_peak") / tou_den).alias("tou_off_ratio"),
        (F.col("mid_peak") / tou_den).alias("tou_mid_ratio"),
        (F.col("on_peak") / tou_den).alias("tou_on_ratio"),
    )


PART_SUMS = ("kwh", "n", "peak", "night", "on_peak", "pf_sum", "pf_n", "q", "p")


def day_parts(df: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """One row per customer, contract type and day with everything that the daily table and the
    load-shape measures add up, so that both come from one pass over the readings."""
    d = not_null(df, "customer_id", "ts").withColumn("date", cal.as_date(F.col("ts")))
    if holidays is not None:
        off = F.broadcast(holidays.select("date").distinct().withColumn("_hol", F.lit(True)))
        d = d.join(off, "date", "left")
        tou = cal.tou_with_day_rules(F.col("ts"), F.col("_hol"))
    else:
        tou = cal.tou_with_day_rules(F.col("ts"))
    x, hour, q = F.col("p_active_kwh"), F.hour("ts"), F.abs(F.col("p_reactive_kwh"))
    in_pf = (x > 0) & q.isNotNull()
    return d.withColumn("_tou", tou).groupBy("customer_id", "contract_type", "date").agg(
        F.sum(x).alias("kwh"), F.count(x).alias("n"), F.max(x).alias("mx"),
        sum_if(_is_peak(hour, 17), x).alias("peak"),
        sum_if(_is_night(hour), x).alias("night"),
        sum_if(F.col("_tou") == "on_peak", x).alias("on_peak"),
        sum_if(in_pf, power_factor(x, q)).alias("pf_sum"),
        count_if(in_pf).alias("pf_n"),
        sum_if(in_pf, q).alias("q"), sum_if(in_pf, x).alias("p"),
    )


def daily_from_parts(parts: DataFrame) -> DataFrame:
    """The daily table (as ``daily_by_customer``) from ``day_parts``."""
    return not_null(parts, "contract_type").select(
        "customer_id", "contract_type", "date", F.coalesce("kwh", F.lit(0.0)).alias("day_kwh"))


def ami_observed(
    df: DataFrame, horizons=(10, 20), holidays: DataFrame | None = None
) -> DataFrame:
    return ami_from_parts(day_parts(df, holidays), horizons)


def ami_from_parts(parts: DataFrame, horizons=(10, 20)) -> DataFrame:
    """Load-shape measures over the first ``h`` days of each month, one row per horizon.

    The horizons are exploded on the days, not on the readings, and days after the last of them
    are not shuffled.
    """
    parts = parts.where(F.dayofmonth("date") <= max(horizons))
    day = parts.groupBy("customer_id", "date").agg(
        *[F.sum(c).alias(c) for c in PART_SUMS], F.max("mx").alias("mx")).where("n > 0")
    day = day.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    day = day.where(F.dayofmonth("date") <= F.col("horizon_days"))
    weekend = cal.is_weekend(F.col("date"))
    m = day.groupBy("customer_id", cal.month_start(F.col("date")).alias("year_month"),
                    "horizon_days").agg(
        *[F.sum(c).alias(c) for c in PART_SUMS],
        F.max("mx").alias("mx"),
        F.coalesce(ratio(sum_if(weekend, F.col("kwh")), F.sum(F.when(weekend, F.col("n")))),
                   F.lit(0.0)).alias("we"),
        F.coalesce(ratio(sum_if(~weekend, F.col("kwh")), F.sum(F.when(~weekend, F.col("n")))),
                   F.lit(1e-9)).alias("wd"),
        F.stddev_samp("kwh").alias("day_sd"), F.avg("kwh").alias("day_mean"),
    )
    m = m.where((F.col("n") >= 4) & (F.col("kwh") > 0))
    return m.select(
        "customer_id", "year_month", "horizon_days",
        (F.col("peak") / F.col("kwh")).alias("observed_peak_ratio"),
        (F.col("on_peak") / F.col("kwh")).alias("observed_tou_on_peak"),
        (F.col("night") / F.col("kwh")).alias("observed_night_ratio"),
        F.when(F.col("mx") > 0, F.col("kwh") / F.col("n") / F.col("mx")).otherwise(0.0)
        .alias("observed_load_factor"),
        ratio(F.col("we"), F.col("wd")).alias("observed_weekend_weekday_ratio"),
        F.when(F.col("day_mean") > 0, F.col("day_sd") / F.col("day_mean")).otherwise(0.0)
        .alias("observed_daily_cv"),
        ratio(F.col("pf_sum"), F.col("pf_n")).alias("observed_power_factor"),
        ratio(F.col("q"), F.col("p")).alias("observed_reactive_ratio"),
    )


def has_intraday(df: DataFrame) -> DataFrame:
    """One row: does any customer-day hold more than one reading? Daily input has no shape."""
    per_day = df.groupBy("customer_id", cal.as_date(F.col("ts")).alias("date")).count()
    return per_day.agg((F.max("count") > 1).alias("has_intraday"))


def customer_attributes(df: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Last non-null value of each attribute per customer, in ingest order."""
    cols = [c for c in INFO_COLUMNS if c in df.columns]
    return not_null(df, "customer_id").groupBy("customer_id").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols])


def monthly_power_factor(df: DataFrame) -> DataFrame:
    g = not_null(df, "customer_id", "ts").groupBy(
        "customer_id", cal.month_start(F.col("ts")).alias("year_month")
    ).agg(sum0(F.col("p_active_kwh")).alias("p"),
          sum0(F.abs(F.col("p_reactive_kwh"))).alias("q"))
    p, q = F.col("p"), F.col("q")
    return g.select("customer_id", "year_month",
                    power_factor(p, q).alias("monthly_pf"),
                    (q / floor_eps(p)).alias("monthly_reactive_ratio"))


def monthly_tou_ratios(
    df: DataFrame, apply_day_rules: bool = True, holidays: DataFrame | None = None
) -> DataFrame:
    """Share of the month's energy per time-of-use period; an unused period is 0."""
    d = not_null(df, "customer_id", "ts")
    if not apply_day_rules:
        tou = cal.tou_period(F.col("ts"))
    elif holidays is None:
        tou = cal.tou_with_day_rules(F.col("ts"))
    else:
        off = F.broadcast(holidays.select("date").distinct().withColumn("_hol", F.lit(True)))
        d = d.withColumn("date", cal.as_date(F.col("ts"))).join(off, "date", "left")
        tou = cal.tou_with_day_rules(F.col("ts"), F.col("_hol"))
    x = F.col("p_active_kwh")
    g = d.withColumn("_tou", tou).groupBy(
        "customer_id", cal.month_start(F.col("ts")).alias("year_month")
    ).agg(sum0(x).alias("total"),
          *[sum_if(F.col("_tou") == p, x).alias(p) for p in cal.TOU_PERIODS])
    return g.select("customer_id", "year_month", *[
        (F.col(p) / floor_eps(F.col("total"))).alias(f"tou_ratio_{p}") for p in cal.TOU_PERIODS])


def cumulative_in_month(daily: DataFrame) -> DataFrame:
    """Running energy inside the month; a customer-month has at most 31 rows."""
    from pyspark.sql import Window as W

    ym = cal.month_start(F.col("date"))
    w = W.partitionBy("customer_id", "year_month").orderBy("date").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    return daily.withColumn("year_month", ym).withColumn("cum_kwh", F.sum("day_kwh").over(w))
