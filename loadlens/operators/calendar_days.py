"""Day types, bridge days, long weekends and their monthly composition.

A calendar has at most 366 rows per year, whatever the size of the readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from loadlens.functions.scalars import count_if


def calendar(months: DataFrame, holidays: DataFrame) -> DataFrame:
    """One row per day of the given months with its day type."""
    days = months.select("year_month").distinct().select(
        "year_month", F.explode(F.sequence("year_month", F.last_day("year_month"))).alias("date"))
    marks = holidays.select("date").distinct()

    def is_holiday(offset: int, name: str) -> DataFrame:
        return F.broadcast(marks.select(F.date_add("date", -offset).alias("date"),
                                        F.lit(True).alias(name)))

    d = days
    for offset, name in ((0, "_h0"), (-1, "_hp"), (1, "_hn")):
        d = d.join(is_holiday(offset, name), "date", "left").fillna(False, [name])
    dow = F.weekday("date")
    off = F.col("_h0") | (dow >= 5)
    prev_off = F.col("_hp") | (F.weekday(F.date_add("date", -1)) >= 5)
    next_off = F.col("_hn") | (F.weekday(F.date_add("date", 1)) >= 5)
    bridge = ~off & prev_off & next_off
    return d.select(
        "year_month", "date",
        F.col("_h0").alias("is_holiday"), off.alias("is_off"), bridge.alias("is_bridge"),
        (~off & ~bridge & (F.col("_hp") | F.col("_hn"))).alias("is_adjacent"),
        F.when(F.col("_h0"), "holiday").when(dow == 6, "sunday").when(dow == 5, "saturday")
        .when(dow == 0, "monday").otherwise("workday").alias("day_type"),
    )


def long_weekend_days(cal: DataFrame) -> DataFrame:
    """Days of runs of three or more days off, runs cut at the month's edges."""
    w = W.partitionBy("year_month").orderBy("date")
    runs = cal.where("is_off").withColumn(
        "_run", F.date_sub(F.col("date"), F.row_number().over(w)))
    sizes = runs.groupBy("year_month", "_run").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("year_month").agg(
        F.sum(F.when(F.col("n") >= 3, F.col("n")).otherwise(0)).alias("n_long_weekend_days"))


def special_day_features(months: DataFrame, holidays: DataFrame) -> DataFrame:
    """Day-type counts and ratios per month."""
    cal = calendar(months, holidays)
    kind = F.when(F.col("is_bridge"), "bridge").otherwise(F.col("day_type"))
    m = cal.withColumn("_k", kind).groupBy("year_month").agg(
        F.count(F.lit(1)).alias("n_days"),
        *[count_if(F.col("_k") == k).alias(f"n_{k}")
          for k in ("workday", "monday", "saturday", "sunday", "holiday", "bridge")],
        count_if(F.col("is_adjacent")).alias("n_holiday_adjacent"),
    )
    cats = holidays.groupBy(F.trunc("date", "MM").alias("year_month")).agg(
        *[count_if(F.col("category") == c).alias(n) for c, n in (
            ("election", "n_election"), ("substitute", "n_substitute"),
            ("new_2023", "n_new_holiday"))])
    m = m.join(F.broadcast(cats), "year_month", "left").join(
        F.broadcast(long_weekend_days(cal)), "year_month", "left")
    m = m.fillna(0, ["n_election", "n_substitute", "n_new_holiday", "n_long_weekend_days"])
    n = F.col("n_days")
    return m.withColumns({
        "workday_ratio": (F.col("n_workday") + F.col("n_monday")) / n,
        "holiday_ratio": (F.col("n_holiday") + F.col("n_bridge")) / n,
        "weekend_ratio": (F.col("n_saturday") + F.col("n_sunday")) / n,
        "disruption_ratio": (F.col("n_holiday") + F.col("n_bridge")
                             + F.col("n_holiday_adjacent")) / n,
    })
