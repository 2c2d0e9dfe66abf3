"""Detection of customers with hidden (behind-the-meter) solar generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loadlens.functions import calendar as cal
from loadlens.functions.joins import small_side
from loadlens.functions.scalars import count_if, floor_eps, ratio, sum0, true_if
from loadlens.operators.clean import safe_groups
from loadlens.session import write_and_read

X = "p_active_kwh"


def _fleet_low(df: DataFrame, column: str, flag: str) -> DataFrame:
    """Flag values below mean - 2 sigma of the fleet; without spread the bound is 0."""
    fleet = df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_sd"))
    bound = F.when(true_if(F.col("_sd") > 0), F.col("_m") - 2 * F.col("_sd")).otherwise(0.0)
    return df.join(F.broadcast(fleet)).withColumn(  # one row
        flag, true_if(F.col(column) < bound).cast("int")).drop("_m", "_sd")


def rolled(df: DataFrame) -> DataFrame:
    """Readings as one row per customer, month and hour of the day: all that the signals
    without radiation need. A table that is rolled already is returned as it is."""
    if "_kwh" in df.columns:
        return df
    x = F.col(X)
    return df.groupBy("customer_id", cal.month_start(F.col("ts")).alias("year_month"),
                      F.hour("ts").alias("hour")).agg(
        F.sum(x).alias("_kwh"), F.count(x).alias("_n"), count_if(x < 0).alias("_neg"),
        F.min("contract_type").alias("contract_type"))


def _mean(cond) -> Column:
    """Mean of the readings of the rolled rows that meet a condition; null without any."""
    return ratio(F.sum(F.when(cond, F.col("_kwh"))), F.sum(F.when(cond, F.col("_n"))))


def signal_negative(df: DataFrame) -> DataFrame:
    """Count and rate of negative readings."""
    return rolled(df).groupBy("customer_id").agg(
        F.sum("_neg").alias("neg_count"),
        F.coalesce(ratio(F.sum("_neg").cast("double"), F.sum("_n")), F.lit(0.0))
        .alias("neg_rate"))


def solar_ranks(df: DataFrame, solar: DataFrame) -> DataFrame:
    """Average percent rank of each hour's radiation among the midday readings of its clock hour.

    Radiation is a property of the hour, so readings are counted per hour first
    and the ranking runs on at most 24 rows per day of data.
    """
    hours = df.withColumn("hour_ts", cal.floor_hour(F.col("ts"))).where(
        F.hour("ts").between(10, 15)).groupBy("hour_ts").agg(F.count(F.lit(1)).alias("n"))
    h = hours.join(solar, "hour_ts").withColumn("hour", F.hour("hour_ts"))
    w = W.partitionBy("hour").orderBy("solar_mj")
    same = F.sum("n").over(W.partitionBy("hour", "solar_mj"))
    below = F.sum("n").over(w.rangeBetween(W.unboundedPreceding, W.currentRow)) - same
    total = F.sum("n").over(W.partitionBy("hour"))
    return h.select("hour_ts", "solar_mj", "n", ((below + (same + 1) / 2) / total).alias("solar_rank"))


def signal_sunny(df: DataFrame, solar: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Load on sunny against cloudy midday hours, its correlation and an estimated capacity."""
    ranks = (solar_ranks(df, solar) if ranks is None else ranks).drop("n")
    d = df.where(F.hour("ts").between(10, 15)).withColumn("hour_ts", cal.floor_hour(F.col("ts")))
    d = d.join(small_side(ranks, measure=solar), "hour_ts")
    x, s = F.col(X), F.col("solar_mj")
    both = x.isNotNull()
    sunny, cloudy = F.col("solar_rank") >= 0.7, F.col("solar_rank") <= 0.3
    lit_hours = (s > 0.1) & both
    g = d.groupBy("customer_id").agg(
        count_if(sunny).alias("n_sun"), count_if(cloudy).alias("n_cloud"),
        F.avg(F.when(sunny, x)).alias("sun"), F.avg(F.when(cloudy, x)).alias("cloud"),
        (F.covar_samp(F.when(both, s), x) / F.nullif(
            F.stddev_samp(F.when(both, s)) * F.stddev_samp(x), F.lit(0.0))).alias("r"),
        F.avg(F.when(s <= 0.01, x)).alias("dark"),
        count_if(s > 0.1).alias("n_lit"),
        F.sum(F.when(lit_hours, s)).alias("s1"), F.sum(F.when(lit_hours, s * s)).alias("s2"),
        F.sum(F.when(lit_hours, s * x)).alias("sx"),
    )
    enough = (F.col("n_sun") >= 10) & (F.col("n_cloud") >= 10)
    r = F.when(enough & (F.col("cloud") > 0), F.col("sun") / F.nullif("cloud", F.lit(0.0)))
    slope = (F.col("dark") * F.col("s1") - F.col("sx")) / F.nullif("s2", F.lit(0.0))
    g = g.withColumn("midday_ratio", F.coalesce(r, F.lit(1.0))).withColumn(
        "solar_load_corr", F.when(enough, F.coalesce("r", F.lit(0.0))).otherwise(0.0))
    usable = (enough & (F.col("midday_ratio") < 1) & (F.col("dark") > 0) & (F.col("n_lit") >= 10))
    g = g.withColumn("est_capacity_kw", F.when(true_if(usable), F.greatest(
        F.coalesce(slope, F.lit(0.0)) * 4, F.lit(0.0))).otherwise(0.0))
    g = _fleet_low(_fleet_low(g, "midday_ratio", "_low_ratio"), "solar_load_corr", "_low_corr")
    return g.select("customer_id", "midday_ratio", "solar_load_corr", "est_capacity_kw",
                    (F.col("_low_ratio") * F.col("_low_corr")).alias("daytime_valley"))


def signal_midday(df: DataFrame) -> DataFrame:
    """Without radiation: midday mean over all-day mean, low against the fleet."""
    g = rolled(df).groupBy("customer_id").agg(
        _mean(F.col("hour").between(10, 15)).alias("_mid"), _mean(F.lit(True)).alias("_day"))
    g = g.where(F.col("_mid").isNotNull() & F.col("_day").isNotNull()).withColumn(
        "midday_ratio", F.col("_mid") / floor_eps(F.col("_day")))
    return _fleet_low(g, "midday_ratio", "daytime_valley").select(
        "customer_id", "midday_ratio", F.lit(0.0).alias("solar_load_corr"),
        F.lit(0.0).alias("est_capacity_kw"), "daytime_valley")


def signal_daytime(df: DataFrame, solar: DataFrame | None, roll: DataFrame | None = None,
                   min_rows: int = 100, min_hours: int = 100) -> DataFrame:
    """The sunny signal where radiation covers enough of the data, else the midday signal for
    the whole fleet: at least ``min_rows`` midday readings with radiation, and more than
    ``min_hours`` hours of radiation in the span. ``daytime_signal`` says which one was used.
    """
    roll = rolled(df) if roll is None else roll
    midday = signal_midday(roll).withColumn("daytime_signal", F.lit("midday"))
    if solar is None:
        return midday
    span = df.agg(F.min(F.to_date("ts")).alias("_a"), F.max(F.to_date("ts")).alias("_b"))
    day = F.to_date("hour_ts")
    in_span = solar.join(F.broadcast(span)).where(  # one row
        (day >= F.col("_a")) & (day <= F.col("_b"))).drop("_a", "_b")
    in_span = write_and_read(in_span, "radiation")  # a row per hour
    ranks = write_and_read(solar_ranks(df, in_span), "radiation")
    hours = in_span.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    rows = ranks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if rows >= min_rows and hours > min_hours:
        return signal_sunny(df, in_span, ranks).withColumn("daytime_signal", F.lit("sunny"))
    return midday


def signal_level_shift(df: DataFrame) -> DataFrame:
    """Largest drop of the 3-month mean; a customer has one row per month here."""
    m = rolled(df).groupBy("customer_id", "year_month").agg(sum0(F.col("_kwh")).alias("kwh"))
    w = W.partitionBy("customer_id").orderBy("year_month")
    m = m.withColumns({
        "_i": F.row_number().over(w) - 1,
        "_n": F.count(F.lit(1)).over(W.partitionBy("customer_id")),
        "_before": F.avg("kwh").over(w.rowsBetween(-3, -1)),
        "_after": F.avg("kwh").over(w.rowsBetween(0, 2)),
    })
    at = (F.col("_n") >= 6) & (F.col("_i") >= 3) & (F.col("_i") <= F.col("_n") - 4) & (
        F.col("_before") > 0)
    drop = F.when(at, (F.col("_before") - F.col("_after")) / F.nullif("_before", F.lit(0.0)))
    g = m.groupBy("customer_id").agg(
        F.greatest(F.coalesce(F.max(drop), F.lit(0.0)), F.lit(0.0)).alias("max_drop_pct"))
    return g.withColumn("level_shift", (F.col("max_drop_pct") > 0.30).cast("int"))


def signal_summer(df: DataFrame) -> DataFrame:
    """July-August mean over spring and autumn mean, low against the fleet."""
    month = F.month("year_month")
    g = rolled(df).groupBy("customer_id").agg(
        _mean(month.isin(7, 8)).alias("_su"), _mean(month.isin(4, 5, 9, 10)).alias("_sh"))
    g = g.where(F.col("_su").isNotNull() & F.col("_sh").isNotNull()).withColumn(
        "summer_ratio", F.col("_su") / floor_eps(F.col("_sh")))
    return _fleet_low(g, "summer_ratio", "summer_inverted").select(
        "customer_id", "summer_ratio", "summer_inverted")


SIGNALS = ("signal_neg", "signal_valley", "signal_shift", "signal_summer")


def detect(df: DataFrame, solar: DataFrame | None = None,
           neg_threshold: float = 0.001) -> DataFrame:
    """Flags per customer: four signals, their mean as score, and the verdict.

    The readings are rolled up once for all signals; only the radiation joins read them again.
    """
    roll = write_and_read(rolled(df), "rolled")
    d = roll.groupBy("customer_id").agg(F.min("contract_type").alias("contract_type"))
    for part in (signal_negative(roll), signal_daytime(df, solar, roll), signal_level_shift(roll),
                 signal_summer(roll)):
        d = d.join(part, "customer_id", "left")
    d = d.fillna(0).withColumns({
        "signal_neg": (F.col("neg_rate") >= neg_threshold).cast("int"),
        "signal_valley": F.col("daytime_valley"),
        "signal_shift": F.col("level_shift"),
        "signal_summer": F.col("summer_inverted"),
    })
    total = sum((F.col(s) for s in SIGNALS[1:]), F.col(SIGNALS[0]))
    return d.withColumns({
        "btm_score": total / len(SIGNALS),
        "is_btm": ((total >= 2) | (F.col("signal_neg") == 1)).cast("int"),
    }).drop("daytime_valley", "level_shift", "summer_inverted")


def summary(flags: DataFrame) -> DataFrame:
    """Export-safe fleet summary. The score has five possible values, so ``percentile``
    keeps five entries however many customers there are."""
    n = F.count(F.lit(1))
    q = F.percentile("btm_score", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    return flags.agg(
        n.alias("n_total_customers"), F.sum("is_btm").alias("n_btm_detected"),
        ratio(F.sum("is_btm").cast("double"), n).alias("btm_rate"),
        *[F.sum(s).alias(s) for s in SIGNALS],
        F.avg("btm_score").alias("score_mean"), q.alias("_q"),
        F.max("btm_score").alias("score_max"),
    ).withColumns({"score_q25": F.col("_q")[0], "score_median": F.col("_q")[1],
                   "score_q75": F.col("_q")[2]}).drop("_q")


def summary_by_contract(flags: DataFrame, min_n: int = 10) -> DataFrame:
    g = flags.groupBy("contract_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_btm").alias("n_btm"),
        F.avg("is_btm").alias("btm_rate"))
    return safe_groups(g, "n", min_n)


def ingest_signals(df: DataFrame) -> DataFrame:
    """Signals the ingest job keeps: negative share and midday against the other hours."""
    x = F.col(X)
    d = df.where(x.isNotNull() & F.col("customer_id").isNotNull())
    mid = F.hour("ts").between(10, 14)
    g = d.groupBy("customer_id").agg(
        count_if(x < 0).alias("btm_neg_count"),
        (count_if(x < 0) / F.count(x)).alias("btm_neg_rate"),
        F.coalesce(F.avg(F.when(mid, x)), F.lit(0.0)).alias("btm_midday_avg"),
        F.coalesce(F.avg(F.when(~mid, x)), F.lit(0.0)).alias("btm_other_avg"))
    other = F.col("btm_other_avg")
    return g.withColumn("btm_midday_ratio", F.when(
        other > 0, F.col("btm_midday_avg") / F.nullif(other, F.lit(0.0))).otherwise(1.0))


def ingest_rule(signals: DataFrame) -> DataFrame:
    """Two-signal rule: any negative reading, or a midday ratio far below the fleet."""
    d = _fleet_low(signals, "btm_midday_ratio", "_low")
    neg = (F.col("btm_neg_count") > 0).cast("int")
    return d.withColumns({
        "is_btm": F.greatest(neg, F.col("_low")),
        "btm_score": 0.5 * neg + 0.5 * F.col("_low"),
    }).drop("_low")


def attach_flags(df: DataFrame, flags: DataFrame) -> DataFrame:
    return df.join(flags.select("customer_id", "is_btm", "btm_score"), "customer_id", "left"
                   ).fillna({"is_btm": 0, "btm_score": 0.0})


def hidden_generation_monthly(solar: DataFrame) -> DataFrame:
    """Monthly generation that bypasses the market, from hourly national output."""
    d = solar.withColumns({
        "year_month": cal.month_start(F.col("ts")),
        "_btm": F.col("total_solar_mw") - F.col("market_solar_mw")})
    g = d.groupBy("year_month").agg(
        F.sum("_btm").alias("btm_mwh"), F.max("_btm").alias("btm_peak_mw"),
        F.avg("_btm").alias("btm_mean_mw"), F.sum("total_solar_mw").alias("total_solar_mwh"),
        F.sum("market_solar_mw").alias("market_mwh"), F.count("_btm").alias("n_hours"))
    return g.withColumn("btm_ratio", F.col("btm_mwh") / F.greatest("total_solar_mwh", F.lit(1.0)))


