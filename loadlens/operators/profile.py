"""Privacy-safe profile of a load data set: one DataFrame per statistic.

Groups are few and large here, so quantiles go through the bracketed method and
pivots are conditional aggregates; no statistic samples rows or customers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions import calendar as cal
from loadlens.functions.chunks import with_previous
from loadlens.functions.joins import many_tasks
from loadlens.functions.linear import pair_moments, solve, vif_of
from loadlens.functions.quantiles import exact_quantiles
from loadlens.functions.scalars import (cdd, count_if, floor_eps, hdd, power_factor, ratio,
                                        safe_corr, sample_skew, sum0, sum_if, true_if)
from loadlens.operators import horizon as hz, rollup
from loadlens.operators.clean import mask_cell, safe_groups

MIN_N = 10
X = "p_active_kwh"


def _plain_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("struct", "array",
                                                                            "map")]


def schema_stats(df: DataFrame) -> DataFrame:
    """Missing rate and distinct count per column in one pass.

    A sketch holds the distinct count: it is exact far beyond the 50 values that
    are reported; columns with more show -1.
    """
    cols = _plain_columns(df)
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        aggs += [count_if(F.col(c).isNull()).alias(f"_m_{c}"),
                 F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string")))
                 .alias(f"_d_{c}")]
    row = df.agg(*aggs)
    items = F.array(*[F.struct(
        F.lit(c).alias("name"), F.lit(types[c]).alias("dtype"),
        ratio(F.col(f"_m_{c}").cast("double"), F.col("_n")).alias("missing_rate"),
        F.coalesce(F.col(f"_d_{c}"), F.lit(0)).cast("bigint").alias("d")) for c in cols])
    d = row.select("_n", F.explode(items).alias("s")).select("_n", "s.*")
    return d.select("name", "dtype", F.col("_n").alias("n_rows"), "missing_rate",
                    F.when(F.col("d") < 50, F.col("d")).otherwise(-1).alias("unique_sample"))


def gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Minutes between consecutive distinct time stamps, per key."""
    d = df.where(F.col("ts").isNotNull()).select(*keys, "ts").distinct()
    d = with_previous(d, keys, ["ts"], {"ts": "_prev"})
    minutes = (F.unix_seconds(F.col("ts").cast("timestamp"))
               - F.unix_seconds(F.col("_prev").cast("timestamp"))) / 60.0
    return d.where(F.col("_prev").isNotNull()).select(*keys, "ts", minutes.alias("gap_min"))


def coverage(df: DataFrame) -> DataFrame:
    """Span, density and gap statistics over the distinct time stamps."""
    seconds = (F.unix_seconds(F.max("ts").cast("timestamp"))
               - F.unix_seconds(F.min("ts").cast("timestamp")))
    n, c = F.count(F.lit(1)), F.countDistinct("customer_id")
    top = df.agg(
        F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), n.alias("total_rows"),
        c.alias("n_customers"), ratio(n.cast("double"), c).alias("avg_rows_per_customer"),
        (F.floor(seconds / 900) + 1).alias("expected_intervals"))
    g = gaps(df, [])
    q = exact_quantiles(g, [], "gap_min", {"median_gap_min": 0.5, "p99_gap_min": 0.99})
    return top.join(F.broadcast(q), how="left").join(F.broadcast(
        g.agg(F.max("gap_min").alias("max_gap_min"))))  # one row each


def customer_counts(df: DataFrame, min_n: int = MIN_N) -> DataFrame:
    g = rollup.not_null(df, "contract_type").groupBy("contract_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("customer_id").alias("n_customers"))
    return g.select("contract_type", mask_cell(F.col("n_rows"), F.col("n_rows"), min_n)
                    .alias("n_rows"),
                    mask_cell(F.col("n_customers"), F.col("n_customers"), min_n)
                    .alias("n_customers"))


LOAD_QUANTILES = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75,
                  "q95": 0.95, "q99": 0.99}


def load_distribution(df: DataFrame, min_n: int = MIN_N) -> DataFrame:
    d = df.where(F.col("contract_type").isNotNull() & F.col(X).isNotNull())
    x = F.col(X)
    logs = F.when(x > 0, F.log(x))
    g = d.groupBy("contract_type").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        sample_skew(x).alias("skew"), F.min(x).alias("min"), F.max(x).alias("max"),
        (count_if(x == 0) / F.count(x)).alias("zero_rate"),
        (count_if(x < 0) / F.count(x)).alias("neg_rate"),
        F.avg(logs).alias("lognormal_mu"), F.stddev_samp(logs).alias("lognormal_sigma"))
    q = exact_quantiles(d, ["contract_type"], X, LOAD_QUANTILES)
    return safe_groups(g, "n", min_n).join(q, "contract_type")


def _mean_by(df: DataFrame, keys: dict[str, Column], min_n: int) -> DataFrame:
    """Long profile: mean load per key and contract type, small cells masked."""
    g = df.groupBy(*[c.alias(n) for n, c in keys.items()], "contract_type").agg(
        F.avg(X).alias("m"), F.count(X).alias("n"))
    return g.select(*keys, "contract_type", "n",
                    mask_cell(F.col("m"), F.col("n"), min_n).alias("mean_kwh"))


def hourly_profile(df: DataFrame, min_n: int = MIN_N) -> DataFrame:
    return _mean_by(df, {"hour": F.hour("ts")}, min_n)


def weekly_profile(df: DataFrame, min_n: int = MIN_N) -> DataFrame:
    return _mean_by(df, {"dayofweek": F.weekday("ts")}, min_n)


def monthly_profile(df: DataFrame, min_n: int = MIN_N) -> DataFrame:
    return _mean_by(df, {"year_month": cal.month_start(F.col("ts"))}, min_n)


def seasonality(df: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """Month by hour of day: one row per contract type and month, one column per hour."""
    x, hour = F.col(X), F.hour("ts")
    aggs = []
    for h in range(24):
        v = F.when(hour == h, x)
        aggs.append(mask_cell(F.avg(v), F.count(v), min_n).alias(f"h{h}"))
    return df.groupBy("contract_type", F.month("ts").alias("month")).agg(*aggs)


def tou_profile(df: DataFrame, min_n: int = MIN_N) -> DataFrame:
    season = cal.season(F.month("ts"))
    return _mean_by(df, {"season": season, "tou_period": cal.classify_tou(F.hour("ts"), season)},
                    min_n)


def tou_ratio_distribution(df: DataFrame, min_n: int = MIN_N,
                           holidays: DataFrame | None = None) -> DataFrame:
    ratios = rollup.monthly_tou_ratios(df, holidays=holidays)
    types = df.select("customer_id", "contract_type").distinct()
    d = types.join(ratios, "customer_id").where(F.col("contract_type").isNotNull())
    d = d.withColumn("_p", F.explode(F.array(*[F.struct(
        F.lit(p).alias("p"), F.col(f"tou_ratio_{p}").alias("v")) for p in cal.TOU_PERIODS])))
    d = d.select("contract_type", F.col("_p.p").alias("tou_period"), F.col("_p.v").alias("v"))
    d = d.where(F.col("v").isNotNull())
    keys = ["contract_type", "tou_period"]
    g = d.groupBy(*keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"),
                             F.stddev_samp("v").alias("std"))
    q = exact_quantiles(d, keys, "v", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return safe_groups(g, "n", min_n).join(q, keys)


def alarm_base_rates(df: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """Historic trigger rate of each condition over its eligible customer-months."""
    m = hz.row_lags(rollup.monthly_by_customer(rollup.daily_by_customer(df)))
    return base_rates_of(m, min_n)


def _conditions() -> dict[str, tuple[Column, Column]]:
    x = F.col("monthly_kwh")
    prev = true_if(x > F.col("prev_m") * 1.30)
    yoy = true_if(x > F.col("prev_year_same_m") * 1.30)
    ma = true_if(x > F.col("ma3") * 1.50)
    has_prev, has_yoy, has_ma = (F.col(c).isNotNull() for c in (
        "prev_m", "prev_year_same_m", "ma3"))
    return {"cond_prev": (prev, has_prev), "cond_yoy": (yoy, has_yoy), "cond_ma3": (ma, has_ma),
            "any_of_3": (prev | yoy | ma, has_prev),
            "all_of_3": (prev & yoy & ma, has_yoy & has_ma)}


def base_rates_of(m: DataFrame, min_n: int = MIN_N) -> DataFrame:
    items = F.array(*[F.struct(F.lit(n).alias("condition"), c.alias("hit"), e.alias("ok"))
                      for n, (c, e) in _conditions().items()])
    g = m.select(F.explode(items).alias("s")).groupBy(F.col("s.condition").alias("condition")).agg(
        count_if(F.col("s.ok")).alias("n_eligible"),
        count_if(F.col("s.ok") & F.col("s.hit")).alias("n_trigger"))
    return g.withColumn("trigger_rate", mask_cell(
        ratio(F.col("n_trigger").cast("double"), F.col("n_eligible")), F.col("n_eligible"), min_n))


def base_rates_by_contract(m: DataFrame, min_n: int = MIN_N) -> DataFrame:
    hit, ok = _conditions()["any_of_3"]
    g = m.groupBy("contract_type").agg(
        count_if(ok).alias("n_eligible"),
        ratio(count_if(ok & hit).cast("double"), count_if(ok)).alias("any_of_3_rate"))
    return safe_groups(g, "n_eligible", min_n)


PARTIAL_DAYS = (10, 15, 20)


def partial_month_correlation(df: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """First N days against the month: correlation and mean share per contract type."""
    daily = rollup.daily_by_customer(df)
    day, x = F.dayofmonth("date"), F.col("day_kwh")
    m = daily.groupBy("customer_id", "contract_type", F.trunc("date", "MM").alias("ym")).agg(
        F.sum(x).alias("full"),
        *[F.sum(F.when(day <= n, x)).alias(f"p{n}") for n in PARTIAL_DAYS])
    d = m.withColumn("_s", F.explode(F.array(*[F.struct(
        F.lit(n).alias("n_days"), F.col(f"p{n}").alias("first_kwh")) for n in PARTIAL_DAYS])))
    d = d.select("contract_type", "full", "_s.*").where(F.col("first_kwh").isNotNull())
    g = d.groupBy("n_days", "contract_type").agg(
        F.count(F.lit(1)).alias("n"), safe_corr(F.col("first_kwh"), F.col("full")).alias("corr"),
        F.avg(ratio(F.col("first_kwh"), F.col("full"))).alias("mean_ratio_of_full_month"))
    return safe_groups(g, "n", min_n)


def partial_month_stability(df: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """Do the first N days stand for the month: power factor, peak share, daily spread."""
    x, hour = F.col(X), F.hour("ts")
    peak = hour.between(10, 17)
    # The rows of a customer's month meet in one task: days, months and their parts are summed there.
    rows = df.where(F.col("customer_id").isNotNull() & F.col("ts").isNotNull()).select(
        "customer_id", F.to_date("ts").alias("date"),
        F.trunc(F.to_date("ts"), "MM").alias("ym"),
        x.alias("x"), F.abs("p_reactive_kwh").alias("q"), peak.alias("peak"))
    rows = rows.repartition(many_tasks(df.sparkSession), "customer_id", "ym")
    day = rows.groupBy("customer_id", "ym", "date").agg(
        sum0(F.col("x")).alias("p"), sum0(F.col("q")).alias("q"),
        sum_if(F.col("peak"), F.col("x")).alias("peak"), count_if(F.col("peak")).alias("n_peak"))
    names = ("power_factor", "peak_ratio", "daily_cv")

    def first(n: int) -> Column:
        """The metrics of a month's first n days; null if it has none of them."""
        p, q, in_peak, n_peak = (F.when(F.dayofmonth("date") <= n, F.col(c))
                                 for c in ("p", "q", "peak", "n_peak"))
        return F.when(F.count(p) > 0, F.struct(
            power_factor(F.sum(p), F.sum(q)).alias("power_factor"),
            F.when(F.sum(n_peak) > 0, F.sum(in_peak) / floor_eps(F.sum(p))).alias("peak_ratio"),
            F.when(F.avg(p) > 0, F.stddev_samp(p) / F.avg(p)).alias("daily_cv")))

    m = day.groupBy("customer_id", "ym").agg(*[first(n).alias(f"m{n}") for n in (*PARTIAL_DAYS, 31)])
    items = F.array(*[F.when(F.col(f"m{n}").isNotNull(), F.struct(
        F.lit(n).alias("n_days"), F.lit(c).alias("metric"), F.col(f"m{n}.{c}").alias("a"),
        F.col(f"m31.{c}").alias("b"))) for n in PARTIAL_DAYS for c in names])
    r = m.select(F.explode(items).alias("s")).where("s is not null").select("s.*")
    r = r.where((F.col("metric") != "daily_cv") | (F.col("a").isNotNull() & F.col("b").isNotNull()))
    g = r.groupBy("n_days", "metric").agg(
        F.count(F.lit(1)).alias("n"), safe_corr(F.col("a"), F.col("b")).alias("corr"),
        F.avg(F.when(F.col("metric") != "daily_cv", F.abs(F.col("a") - F.col("b")))).alias("mae"))
    return safe_groups(g, "n", min_n)


def _summary(df: DataFrame, value: Column, probs: dict[str, float], min_n: int) -> DataFrame:
    d = df.select(value.alias("v")).where(F.col("v").isNotNull())
    g = d.agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    return safe_groups(g.join(F.broadcast(exact_quantiles(d, [], "v", probs))), "n", min_n)


def power_factor_distribution(df: DataFrame, min_n: int = MIN_N) -> DataFrame:
    a = floor_eps(F.col(X))
    r = F.coalesce(F.col("p_reactive_kwh"), F.lit(0.0))
    return _summary(df, a / F.sqrt(a * a + r * r), {"median": 0.5, "q05": 0.05, "q25": 0.25,
                                                    "q75": 0.75, "q95": 0.95}, min_n)


def max_demand_ratio(df: DataFrame, min_n: int = MIN_N) -> DataFrame:
    return _summary(df, F.col("max_demand_kw") / (floor_eps(F.col(X)) * 4.0),
                    {"median": 0.5, "q25": 0.25, "q75": 0.75, "q95": 0.95}, min_n)


def two_variable_ols(y: Column, a: Column, b: Column) -> dict[str, Column]:
    """Closed-form regression y ~ 1 + a + b; a regressor without spread gets 0."""
    saa, sbb, sab = F.var_samp(a), F.var_samp(b), F.covar_samp(a, b)
    say, sby = F.covar_samp(a, y), F.covar_samp(b, y)
    det = saa * sbb - sab * sab
    singular = F.abs(det) <= 1e-12 * saa * sbb
    ca = F.when(~singular, (say * sbb - sby * sab) / F.nullif(det, F.lit(0.0))).otherwise(
        F.when(saa > 0, say / F.nullif(saa, F.lit(0.0))).otherwise(0.0))
    cb = F.when(~singular, (sby * saa - say * sab) / F.nullif(det, F.lit(0.0))).otherwise(
        F.when((saa <= 0) & (sbb > 0), sby / F.nullif(sbb, F.lit(0.0))).otherwise(0.0))
    return {"a": ca, "b": cb, "const": F.avg(y) - ca * F.avg(a) - cb * F.avg(b)}


def weather_regression(df: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """Mean daily load against heating and cooling degrees, by contract type."""
    day = df.where(F.col("contract_type").isNotNull()).groupBy(
        "contract_type", F.to_date("ts").alias("date")).agg(
        F.avg(X).alias("y"), F.avg("temp_c").alias("t"))
    day = day.where(F.col("y").isNotNull() & F.col("t").isNotNull())
    day = day.withColumns({"h": hdd(F.col("t")), "c": cdd(F.col("t"))})
    fit = two_variable_ols(F.col("y"), F.col("h"), F.col("c"))
    g = day.groupBy("contract_type").agg(
        F.count(F.lit(1)).alias("n_days"), fit["const"].alias("intercept"),
        fit["a"].alias("hdd_coef"), fit["b"].alias("cdd_coef"), F.avg("y").alias("mean_load"))
    return safe_groups(g, "n_days", min_n)


def data_quality(df: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Repeated keys, missing and negative rates, and tenfold jumps over every customer."""
    keys = df.groupBy("customer_id", "ts").agg(F.count(F.lit(1)).alias("c"))
    dup = keys.agg(F.sum(F.col("c") - 1).alias("duplicate_rows"))
    n = F.count(F.lit(1)).cast("double")
    x = F.col(X)
    base = df.agg(
        F.count(F.lit(1)).alias("n_rows"), (count_if(x.isNull()) / n).alias("missing_rate"),
        (count_if(x < 0) / n).alias("negative_rate"))
    steps = with_previous(df.select("customer_id", "ts", X, seq), ["customer_id"], ["ts", seq],
                          {X: "_prev"}).where("_has_prev")
    r = F.when(true_if(F.col("_prev") > 0), x / F.nullif("_prev", F.lit(0.0))).otherwise(0.0)
    jumps = steps.agg(
        count_if(true_if((r > 10) | (r < 0.1))).alias("n_jumps"),
        F.count(F.lit(1)).alias("n_steps"))
    out = base.join(F.broadcast(dup)).join(F.broadcast(jumps))  # one row each
    return out.withColumn("jump_rate", F.coalesce(
        ratio(F.col("n_jumps").cast("double"), F.col("n_steps")), F.lit(0.0)))


def correlation_frame(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The numeric columns whose relations are profiled."""
    d = df.withColumns({"hour": F.hour("ts"), "dayofweek": F.weekday("ts"),
                        "month": F.month("ts"),
                        "is_weekend": cal.is_weekend(F.col("ts")).cast("int")})
    if "temp_c" in df.columns:
        t = F.coalesce("temp_c", F.lit(15.0))
        d = d.withColumns({"hdd": hdd(t), "cdd": cdd(t)})
    cols = [c for c in (X, "p_reactive_kwh", "max_demand_kw", "hour", "dayofweek", "month",
                        "is_weekend", "temp_c", "hdd", "cdd", "humidity") if c in d.columns]
    return d.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete correlations in long form, from one pass over the rows."""
    def rows(_, m):
        c, p = m.corr(), len(columns)
        return pd.DataFrame({
            "feature_a": [a for a in columns for _ in range(p)],
            "feature_b": columns * p, "corr": c.ravel()})

    out = solve(pair_moments(df, columns), columns, rows,
                "feature_a string, feature_b string, corr double")
    return out.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """VIF per column over complete rows: one pass, then a solve on the p by p moments."""
    def rows(_, m):
        v = vif_of(m.cov()) if m.n[0, 0] >= len(columns) + 1 else np.full(len(columns), np.nan)
        return pd.DataFrame({"feature": columns, "vif": v, "r_squared": 1 - 1 / v,
                             "multicollinear": v > 10})

    return solve(pair_moments(df.na.drop(subset=columns), columns), columns, rows,
                 "feature string, vif double, r_squared double, multicollinear boolean")


# Name -> statistic of the standard reading table; add an entry to add a statistic.
STATISTICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "schema": schema_stats,
    "coverage": coverage,
    "customer_counts": customer_counts,
    "load_distribution": load_distribution,
    "hourly_profile": hourly_profile,
    "weekly_profile": weekly_profile,
    "monthly_profile": monthly_profile,
    "seasonality": seasonality,
    "power_factor": power_factor_distribution,
    "max_demand_ratio": max_demand_ratio,
    "alarm_base_rates": alarm_base_rates,
    "data_quality": data_quality,
    "weather_regression": weather_regression,
    "partial_month_correlation": partial_month_correlation,
    "tou_profile": tou_profile,
    "tou_usage_ratios": tou_ratio_distribution,
    "correlation_matrix": lambda d: correlation_matrix(*correlation_frame(d)),
    "vif": lambda d: vif(*correlation_frame(d)),
    "partial_month_stability": partial_month_stability,
}


# Columns a statistic cannot do without; it is skipped where the source lacks them.
NEEDS = {"power_factor": ("p_reactive_kwh",), "max_demand_ratio": ("max_demand_kw",),
         "weather_regression": ("temp_c",), "partial_month_stability": ("p_reactive_kwh",)}


def run_profile(df: DataFrame, write: Callable[[str, DataFrame], None],
                skip: frozenset[str] = frozenset(),
                statistics: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Write every statistic (or those given); a failing one is recorded and does not stop the
    others."""
    rows = []
    for name, stat in (STATISTICS if statistics is None else statistics).items():
        if name in skip:
            rows.append((name, "skipped", "on request"))
            continue
        missing = [c for c in NEEDS.get(name, ()) if c not in df.columns]
        if missing:
            rows.append((name, "skipped", f"no column {', '.join(missing)}"))
            continue
        try:
            write(name, stat(df))
            rows.append((name, "ok", ""))
        except Exception as e:  # noqa: BLE001 - one statistic must not stop the profile
            rows.append((name, "failed", str(e)))
    return df.sparkSession.createDataFrame(rows, "name string, status string, detail string")


def hourly_series_profile(series: DataFrame, value: str) -> DataFrame:
    """Rows, nulls, mean, sum and maximum per month of an hourly series."""
    return series.groupBy(cal.month_start(F.col("ts")).alias("year_month")).agg(
        F.count(F.lit(1)).alias("n_rows"), count_if(F.col(value).isNull()).alias("n_null"),
        F.avg(value).alias("mean"), F.sum(value).alias("total"), F.max(value).alias("max"))


def hourly_series_years(series: DataFrame, value: str) -> DataFrame:
    """Per year: first and last time, rows against the hours of the year, and nulls."""
    last_day = F.make_date(F.col("year"), F.lit(12), F.lit(31))
    return series.groupBy(F.year("ts").alias("year")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("n_rows"), count_if(F.col(value).isNull()).alias("n_null")
    ).withColumn("expected_rows", F.dayofyear(last_day).cast("bigint") * 24)


def hourly_gap_profile(series: DataFrame) -> DataFrame:
    """Gap statistics of a series: shortest, median, longest and most common gap."""
    g = gaps(series, [])
    q = exact_quantiles(g, [], "gap_min", {"median": 0.5})
    common = g.groupBy("gap_min").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max_by("gap_min", F.struct("n", (-F.col("gap_min")).alias("g"))).alias("mode"))
    return g.agg(F.min("gap_min").alias("min"), F.max("gap_min").alias("max")).join(
        F.broadcast(q)).join(F.broadcast(common))


# Standard names that a source's columns are matched with.
STANDARD = ("customer_id", "ts", "contract_type", "p_active_kwh", "p_reactive_kwh", "p_apparent_kwh",
            "max_demand_kw", "contract_power_kw", "n_households", "region_code", "region_sub",
            "supply_method", "usage_purpose", "industry_code")


def suggested_name(name: Column, standard=STANDARD, furthest: float = 0.4) -> Column:
    """The standard name that is nearest by edits, letters and digits alone compared; null if
    more than ``furthest`` of the longer name would have to change."""
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    ways = []
    for s in standard:
        own = s.replace("_", "")
        far = F.levenshtein(plain, F.lit(own)) / F.greatest(F.length(plain), F.lit(len(own)))
        ways.append(F.struct(far.alias("far"), F.lit(s).alias("name")))
    best = F.array_min(F.array(*ways))
    return F.when(best["far"] <= furthest, best["name"])


def source_profile(df: DataFrame, samples: int = 3) -> DataFrame:
    """Per column: type, rows, null rate, distinct values, sample values, the range, mean and
    deviation of what reads as a number, and the standard name that the column's is nearest to.

    Rows collapse to one count per column and value before anything is shuffled, so distinct
    counts are exact and repeated values cost nothing. Sample i is the value with the smallest
    hash under seed i: the same whatever the order or the number of tasks.
    """
    cols = _plain_columns(df)
    types = dict(df.dtypes)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(types[c]).alias("dtype"),
                                         F.col(c).cast("string").alias("value")) for c in cols]))
    counts = df.select(cells.alias("s")).select("s.*").groupBy("name", "dtype", "value").agg(
        F.count(F.lit(1)).alias("c"))
    v, c, x = F.col("value"), F.col("c"), F.col("value").try_cast("double")
    picks = [F.min_by(v, F.when(v.isNotNull(), F.md5(F.concat(F.lit(str(i)), v).cast("binary"))))
             for i in range(samples)]
    n = F.sum(F.when(x.isNotNull(), c))
    mean = ratio(F.sum(x * c), n)
    out = counts.groupBy("name", "dtype").agg(
        F.sum("c").alias("n_rows"),
        ratio(F.sum(F.when(v.isNull(), c).otherwise(0)).cast("double"), F.sum("c")).alias("null_rate"),
        F.count(v).alias("n_distinct"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*picks)))).alias("samples"),
        F.min(x).alias("min"), F.max(x).alias("max"), mean.alias("mean"),
        F.when(n > 0, F.sqrt(F.greatest(ratio(F.sum(x * x * c), n) - mean * mean, F.lit(0.0)))
               ).alias("std"))
    return out.withColumn("suggested", suggested_name(F.col("name")))
