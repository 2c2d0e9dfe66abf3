"""Profile, data-quality, fleet and chart-table queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from loadlens.functions.quantiles import exact_quantiles
from loadlens.functions.scalars import safe_corr
from loadlens.operators import fleet, horizon as hz, profile as pf, rollup, weather as wx
from loadlens.plans.catalog import ctes
from loadlens.plans.catalog.base import query
from loadlens.plans.catalog.climate import generation, month_of, station_readings
from loadlens.plans.catalog.core import context_of, daily_of, results_of
from loadlens.session import work_dir
from loadlens.sources import tables as t

PLAIN = ("customer_id", "contract_type", "p_active_kwh", "region_code", "contract_power_kw")


@query("profile_schema", "name dtype n_rows:i missing_rate:8 unique_sample:i", "D36",
       "\nUNION ALL\n".join(f"""
    SELECT '{c}' AS name, '{ty}' AS dtype, count(*) AS n_rows,
           avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS missing_rate,
           CASE WHEN count(DISTINCT {c}) < 50 THEN count(DISTINCT {c}) ELSE -1 END AS unique_sample
    FROM readings""" for c, ty in zip(PLAIN, ("string", "string", "double", "string", "double"))))
def profile_schema(spark, sf):
    return pf.schema_stats(t.readings(spark, sf).select(*PLAIN))


ctes.add("gap_min", """
    SELECT date_diff('second', lag(ts) OVER (ORDER BY ts), ts) / 60.0 AS gap
    FROM (SELECT DISTINCT ts FROM readings)""")


@query("profile_coverage", "ts_min:s ts_max:s total_rows:i n_customers:i avg_rows_per_customer:6 "
       "expected_intervals:i median_gap_min:6 p99_gap_min:6 max_gap_min:6", "D37 E11", """
    SELECT a.*, g.* FROM (SELECT min(ts) AS ts_min, max(ts) AS ts_max, count(*) AS total_rows,
        count(DISTINCT customer_id) AS n_customers,
        count(*) / count(DISTINCT customer_id) AS avg_rows_per_customer,
        date_diff('second', min(ts), max(ts)) // 900 + 1 AS expected_intervals FROM readings) a,
      (SELECT quantile_cont(gap, 0.5) AS median_gap_min, quantile_cont(gap, 0.99) AS p99_gap_min,
              max(gap) AS max_gap_min FROM gap_min) g""")
def profile_coverage(spark, sf):
    return pf.coverage(t.readings(spark, sf))


@query("customer_reading_gaps", "customer_id n:i max_gap:6 mean_gap:6", "E11", """
    SELECT customer_id, count(g) AS n, max(g) AS max_gap, avg(g) AS mean_gap FROM (
      SELECT customer_id, date_diff('second', lag(ts) OVER (PARTITION BY customer_id ORDER BY ts), ts)
             / 60.0 AS g FROM (SELECT DISTINCT customer_id, ts FROM readings_hf))
    GROUP BY customer_id HAVING count(g) > 0""")
def customer_reading_gaps(spark, sf):
    return pf.gaps(t.readings_hf(spark, sf), ["customer_id"]).groupBy("customer_id").agg(
        F.count("gap_min").alias("n"), F.max("gap_min").alias("max_gap"),
        F.avg("gap_min").alias("mean_gap"))


@query("profile_customer_counts", "contract_type n_rows:i n_customers:i", "D38", """
    SELECT contract_type, count(*) AS n_rows,
           CASE WHEN count(DISTINCT customer_id) >= 10 THEN count(DISTINCT customer_id) END AS n_customers
    FROM readings GROUP BY contract_type""")
def profile_customer_counts(spark, sf):
    return pf.customer_counts(t.readings(spark, sf))


@query("profile_load_distribution", "contract_type n:i mean:6 std:6 skew:6 min:4 q01:4 q05:4 q25:4 "
       "median:4 q75:4 q95:4 q99:4 max:4 zero_rate:8 neg_rate:8 lognormal_mu:6 lognormal_sigma:6",
       "D39", """
    SELECT contract_type, count(p_active_kwh) AS n, avg(p_active_kwh) AS mean,
      stddev_samp(p_active_kwh) AS std, skewness(p_active_kwh) AS skew, min(p_active_kwh) AS min,
      """ + ", ".join(f"quantile_cont(p_active_kwh, {p}) AS {n}"
                      for n, p in pf.LOAD_QUANTILES.items()) + """,
      max(p_active_kwh) AS max, count_if(p_active_kwh = 0) / count(p_active_kwh) AS zero_rate,
      count_if(p_active_kwh < 0) / count(p_active_kwh) AS neg_rate,
      avg(ln(CASE WHEN p_active_kwh > 0 THEN p_active_kwh END)) AS lognormal_mu,
      stddev_samp(ln(CASE WHEN p_active_kwh > 0 THEN p_active_kwh END)) AS lognormal_sigma
    FROM readings GROUP BY contract_type HAVING count(p_active_kwh) >= 10""")
def profile_load_distribution(spark, sf):
    return pf.load_distribution(t.readings(spark, sf))


def mean_profile(name: str, key: str, sql_key: str, ids: str, fn):
    @query(name, f"{key} contract_type n:i mean_kwh:6", ids, f"""
    SELECT {sql_key} AS {key.split(':')[0]}, contract_type, count(p_active_kwh) AS n,
           CASE WHEN count(p_active_kwh) >= 10 THEN avg(p_active_kwh) END AS mean_kwh
    FROM readings_hf GROUP BY ALL""")
    def build(spark, sf):
        return fn(t.readings_hf(spark, sf))

    return build


mean_profile("profile_hourly", "hour:i", "hour(ts)", "D40", pf.hourly_profile)
mean_profile("profile_weekly", "dayofweek:i", "isodow(ts) - 1", "D40 P15", pf.weekly_profile)
mean_profile("profile_monthly", "year_month:s", "date_trunc('month', ts)::DATE", "D40",
             pf.monthly_profile)


@query("profile_seasonality", "contract_type month:i " + " ".join(f"h{h}:6" for h in range(24)),
       "D41", "SELECT contract_type, month(ts) AS month, " + ", ".join(
           f"CASE WHEN count(p_active_kwh) FILTER (WHERE hour(ts) = {h}) >= 10 "
           f"THEN avg(p_active_kwh) FILTER (WHERE hour(ts) = {h}) END AS h{h}" for h in range(24))
       + " FROM readings GROUP BY ALL")
def profile_seasonality(spark, sf):
    return pf.seasonality(t.readings(spark, sf))


ctes.add("rate_rows", """
    SELECT *, coalesce(monthly_kwh > 1.3 * prev_m, false) AS c1,
           coalesce(monthly_kwh > 1.3 * yoy, false) AS c2,
           coalesce(monthly_kwh > 1.5 * ma3, false) AS c3
    FROM (SELECT *, lag(monthly_kwh) OVER w AS prev_m, lag(monthly_kwh, 12) OVER w AS yoy,
            CASE WHEN count(*) OVER p = 3 THEN avg(monthly_kwh) OVER p END AS ma3
          FROM monthly WINDOW w AS (PARTITION BY customer_id ORDER BY year_month),
            p AS (PARTITION BY customer_id ORDER BY year_month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))""")


@query("profile_alarm_base_rates", "condition n_eligible:i n_trigger:i trigger_rate:8", "D42",
       "\nUNION ALL\n".join(f"""
    SELECT '{n}' AS condition, count_if({ok}) AS n_eligible, count_if({ok} AND {hit}) AS n_trigger,
           count_if({ok} AND {hit}) / nullif(count_if({ok}), 0) AS trigger_rate FROM rate_rows"""
                            for n, hit, ok in (
    ("cond_prev", "c1", "prev_m IS NOT NULL"), ("cond_yoy", "c2", "yoy IS NOT NULL"),
    ("cond_ma3", "c3", "ma3 IS NOT NULL"), ("any_of_3", "(c1 OR c2 OR c3)", "prev_m IS NOT NULL"),
    ("all_of_3", "(c1 AND c2 AND c3)", "(yoy IS NOT NULL AND ma3 IS NOT NULL)"))))
def profile_alarm_base_rates(spark, sf):
    return pf.alarm_base_rates(t.readings(spark, sf))


@query("profile_alarm_rates_by_contract", "contract_type n_eligible:i any_of_3_rate:8", "D42", """
    SELECT contract_type, count(prev_m) AS n_eligible,
           count_if(prev_m IS NOT NULL AND (c1 OR c2 OR c3)) / count(prev_m) AS any_of_3_rate
    FROM rate_rows GROUP BY contract_type HAVING count(prev_m) >= 10""")
def profile_alarm_rates_by_contract(spark, sf):
    return pf.base_rates_by_contract(hz.row_lags(rollup.monthly_by_customer(daily_of(spark, sf))))


@query("profile_partial_month_correlation", "n_days:i contract_type n:i corr:8 "
       "mean_ratio_of_full_month:8", "D43", """
    SELECT h AS n_days, contract_type, count(*) AS n, corr(p, f) AS corr,
           avg(p / nullif(f, 0)) AS mean_ratio_of_full_month
    FROM (SELECT customer_id, contract_type, date_trunc('month', date) AS ym, h,
                 sum(day_kwh) FILTER (WHERE day(date) <= h) AS p, sum(day_kwh) AS f
          FROM daily, (VALUES (10), (15), (20)) v(h) GROUP BY ALL)
    WHERE p IS NOT NULL GROUP BY ALL HAVING count(*) >= 10""")
def profile_partial_month_correlation(spark, sf):
    return pf.partial_month_correlation(t.readings(spark, sf))


ctes.add("stab_day", """
    SELECT customer_id, ts::DATE AS date, coalesce(sum(p_active_kwh), 0) AS p,
           sum(abs(p_reactive_kwh)) AS q,
           coalesce(sum(p_active_kwh) FILTER (WHERE hour(ts) BETWEEN 10 AND 17), 0) AS peak,
           count_if(hour(ts) BETWEEN 10 AND 17) AS n_peak
    FROM readings GROUP BY ALL""")
ctes.add("stab_month", """
    SELECT customer_id, date_trunc('month', date) AS ym, h,
      sum(p) / greatest(sqrt(sum(p)^2 + sum(q)^2), 1e-9) AS power_factor,
      CASE WHEN sum(n_peak) > 0 THEN sum(peak) / greatest(sum(p), 1e-9) END AS peak_ratio,
      CASE WHEN avg(p) > 0 THEN stddev_samp(p) / avg(p) END AS daily_cv
    FROM stab_day, (VALUES (10), (15), (20), (31)) v(h) WHERE day(date) <= h GROUP BY ALL""")


@query("profile_partial_month_stability", "n_days:i metric n:i corr:6 mae:g", "D44",
       "\nUNION ALL\n".join(f"""
    SELECT a.h AS n_days, '{m}' AS metric, count(*) AS n,
           covar_samp(a.{m}, b.{m}) / nullif(stddev_samp(a.{m}) FILTER (WHERE b.{m} IS NOT NULL)
             * stddev_samp(b.{m}) FILTER (WHERE a.{m} IS NOT NULL), 0) AS corr,
           {'avg(abs(a.' + m + ' - b.' + m + '))' if m != 'daily_cv' else 'NULL'} AS mae
    FROM stab_month a JOIN stab_month b ON a.customer_id = b.customer_id AND a.ym = b.ym AND b.h = 31
    WHERE a.h < 31 {'AND a.daily_cv IS NOT NULL AND b.daily_cv IS NOT NULL' if m == 'daily_cv' else ''}
    GROUP BY a.h""" for m in ("power_factor", "peak_ratio", "daily_cv")))
def profile_partial_month_stability(spark, sf):
    return pf.partial_month_stability(t.readings(spark, sf))


FIVE = "n:i mean:6 median:6 q25:6 q75:6 q95:6"


@query("profile_power_factor", f"{FIVE} q05:6", "D45 H8", """
    SELECT count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median,
           quantile_cont(v, 0.05) AS q05, quantile_cont(v, 0.25) AS q25,
           quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.95) AS q95
    FROM (SELECT a / sqrt(a*a + r*r) AS v FROM (SELECT
            CASE WHEN p_active_kwh < 1e-9 THEN 1e-9 ELSE p_active_kwh END AS a,
            coalesce(p_reactive_kwh, 0) AS r FROM readings))""")
def profile_power_factor(spark, sf):
    return pf.power_factor_distribution(t.readings(spark, sf))


@query("profile_max_demand_ratio", FIVE, "D46", """
    SELECT count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median,
           quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.95) AS q95
    FROM (SELECT max_demand_kw / (greatest(p_active_kwh, 1e-9) * 4) AS v FROM readings_hf
          WHERE p_active_kwh IS NOT NULL)""")
def profile_max_demand_ratio(spark, sf):
    return pf.max_demand_ratio(t.readings_hf(spark, sf))


ctes.add("regress_day", """
    SELECT *, greatest(15 - tmp, 0) AS h, greatest(tmp - 24, 0) AS c FROM (
      SELECT contract_type, r.ts::DATE AS date, avg(p_active_kwh) AS y, avg(temp_c) AS tmp
      FROM station_reading r LEFT JOIN weather w ON w.station_id = r.station_id
           AND w.ts = date_trunc('hour', r.ts) GROUP BY ALL)
    WHERE y IS NOT NULL AND tmp IS NOT NULL""")


def weather_readings(spark, sf):
    return wx.attach_station_weather(station_readings(spark, sf), t.weather_hourly(spark, sf),
                                     columns=("temp_c", "humidity"))


@query("profile_weather_regression", "contract_type n_days:i intercept:5 hdd_coef:5 cdd_coef:5 "
       "mean_load:6", "D47", """
    SELECT contract_type, n_days, mean_load, b1 AS hdd_coef, b2 AS cdd_coef,
           mean_load - b1 * mh - b2 * mc AS intercept
    FROM (SELECT contract_type, count(*) AS n_days, avg(y) AS mean_load, avg(h) AS mh, avg(c) AS mc,
      (covar_samp(h, y) * var_samp(c) - covar_samp(c, y) * covar_samp(h, c))
        / (var_samp(h) * var_samp(c) - covar_samp(h, c)^2) AS b1,
      (covar_samp(c, y) * var_samp(h) - covar_samp(h, y) * covar_samp(h, c))
        / (var_samp(h) * var_samp(c) - covar_samp(h, c)^2) AS b2
      FROM regress_day GROUP BY contract_type HAVING count(*) >= 10)""")
def profile_weather_regression(spark, sf):
    return pf.weather_regression(weather_readings(spark, sf))


@query("profile_data_quality", "n_rows:i duplicate_rows:i missing_rate:8 negative_rate:8 "
       "n_jumps:i n_steps:i jump_rate:8", "D48", """
    SELECT (SELECT count(*) FROM readings) AS n_rows,
      (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM readings GROUP BY customer_id, ts)) AS duplicate_rows,
      (SELECT avg(CASE WHEN p_active_kwh IS NULL THEN 1.0 ELSE 0 END) FROM readings) AS missing_rate,
      (SELECT avg(CASE WHEN p_active_kwh < 0 THEN 1.0 ELSE 0 END) FROM readings) AS negative_rate,
      n_jumps, n_steps, n_jumps / n_steps AS jump_rate
    FROM (SELECT count_if(r > 10 OR r < 0.1) AS n_jumps, count(*) AS n_steps FROM (
      SELECT CASE WHEN p > 0 THEN p_active_kwh / p ELSE 0 END AS r FROM (
        SELECT *, lag(p_active_kwh) OVER w AS p, row_number() OVER w AS i FROM readings
        WINDOW w AS (PARTITION BY customer_id ORDER BY ts, seq)) WHERE i > 1))""")
def profile_data_quality(spark, sf):
    return pf.data_quality(t.readings(spark, sf))


@query("profile_tou", "season tou_period contract_type n:i mean_kwh:6", "D49", f"""
    SELECT {ctes.season('month(ts)')} AS season, {ctes.tou('ts')} AS tou_period, contract_type,
           count(p_active_kwh) AS n,
           CASE WHEN count(p_active_kwh) >= 10 THEN avg(p_active_kwh) END AS mean_kwh
    FROM readings GROUP BY ALL""")
def profile_tou(spark, sf):
    return pf.tou_profile(t.readings(spark, sf))


@query("profile_tou_ratio_distribution", "contract_type tou_period n:i mean:g std:g q25:6 median:6 "
       "q75:6", "D49", "\nUNION ALL\n".join(f"""
    SELECT contract_type, '{p}' AS tou_period, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std,
           quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75
    FROM (SELECT contract_type, tou_ratio_{p} AS v FROM tou_share JOIN customer_info USING (customer_id))
    GROUP BY contract_type""" for p in ("off_peak", "mid_peak", "on_peak")))
def profile_tou_ratio_distribution(spark, sf):
    return pf.tou_ratio_distribution(t.readings(spark, sf), holidays=t.holidays(spark))


CORR = ("p_active_kwh", "p_reactive_kwh", "max_demand_kw", "hour", "dayofweek", "month", "is_weekend",
        "temp_c", "hdd", "cdd", "humidity")
ctes.add("corr_rows", """
    SELECT p_active_kwh, p_reactive_kwh, max_demand_kw, hour(r.ts) AS hour, isodow(r.ts) - 1 AS dayofweek,
           month(r.ts) AS month, CASE WHEN isodow(r.ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, temp_c,
           greatest(15 - coalesce(temp_c, 15), 0) AS hdd, greatest(coalesce(temp_c, 15) - 24, 0) AS cdd,
           humidity
    FROM station_reading r LEFT JOIN weather w ON w.station_id = r.station_id
         AND w.ts = date_trunc('hour', r.ts)""")


@query("profile_correlation_matrix", "feature_a feature_b corr:7", "D50 P13", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM corr_rows"
    for a in CORR for b in CORR))
def profile_correlation_matrix(spark, sf):
    return pf.correlation_matrix(*pf.correlation_frame(weather_readings(spark, sf)))


@query("profile_vif", "feature vif:4 r_squared:6 multicollinear:i", "D50")
def profile_vif(spark, sf):
    return pf.vif(*pf.correlation_frame(weather_readings(spark, sf)))


# A source whose columns are named otherwise than the standard ones.
SOURCE_NAMES = {"CustomerID": ("customer_id", "string"), "contract": ("contract_type", "string"),
                "active_kwh": ("p_active_kwh", "double"), "region": ("region_code", "string"),
                "ContractPower_kW": ("contract_power_kw", "double"),
                "p_reactiv_lag": ("p_reactive_lag", "double"), "time": ("ts", "timestamp_ntz")}
PLAIN_NAME = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query("source_profile", "name dtype n_rows:i null_rate:8 n_distinct:i samples:s min:4 max:4 mean:4 "
       "std:4 suggested", "A16", """
    WITH one AS (""" + "\nUNION ALL\n".join(f"""
      SELECT '{n}' AS name, '{ty}' AS dtype, count(*) AS n_rows,
             avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS null_rate,
             count(DISTINCT {c}) AS n_distinct,
             '[' || array_to_string(list_sort(list_distinct([{', '.join(
                 f"min_by({c}::VARCHAR, md5('{i}' || {c}::VARCHAR))" for i in range(3))}])), ', ')
               || ']' AS samples,
             min(TRY_CAST({c}::VARCHAR AS DOUBLE)) AS min, max(TRY_CAST({c}::VARCHAR AS DOUBLE)) AS max,
             avg(TRY_CAST({c}::VARCHAR AS DOUBLE)) AS mean,
             stddev_pop(TRY_CAST({c}::VARCHAR AS DOUBLE)) AS std FROM readings"""
    for n, (c, ty) in SOURCE_NAMES.items()) + f"""),
    near AS (
      SELECT name, s AS suggested, levenshtein({PLAIN_NAME.format("name")}, {PLAIN_NAME.format("s")})
        / greatest(length({PLAIN_NAME.format("name")}), length({PLAIN_NAME.format("s")})) AS far
      FROM one, (SELECT unnest([{', '.join(f"'{x}'" for x in pf.STANDARD)}]) AS s))
    SELECT one.*, CASE WHEN far <= 0.4 THEN suggested END AS suggested FROM one JOIN near USING (name)
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY far, suggested) = 1""")
def source_profile(spark, sf):
    r = t.readings(spark, sf)
    return pf.source_profile(r.select(*[F.col(c).alias(n) for n, (c, _) in SOURCE_NAMES.items()]))


@query("profile_runner", "name status n_rows:i", "D51", """
    SELECT 'schema' AS name, 'ok' AS status, 5 AS n_rows
    UNION ALL SELECT 'broken', 'failed', NULL
    UNION ALL SELECT 'max_demand_ratio', 'skipped', NULL
    UNION ALL SELECT 'customer_counts', 'ok', count(DISTINCT contract_type) FROM readings
    UNION ALL SELECT 'hourly_profile', 'skipped', NULL
    UNION ALL SELECT 'data_quality', 'ok', 1""")
def profile_runner(spark, sf):
    """Statistics in their order: one fails, one lacks its column, one is left out on request,
    and the others are written all the same."""
    def broken(d):
        return d.select(F.raise_error(F.lit("no such statistic")).cast("string").alias("x"))

    names = ("schema", "broken", "max_demand_ratio", "customer_counts", "hourly_profile", "data_quality")
    chosen = {n: pf.STATISTICS.get(n, broken) for n in names}
    out = work_dir(spark, "profile")
    r = t.readings(spark, sf).select(*PLAIN, "ts", "ingest_seq")
    chosen["schema"] = lambda d: pf.schema_stats(d.select(*PLAIN))
    done = pf.run_profile(r, lambda n, d: d.write.parquet(f"{out}/{n}"),
                          frozenset(["hourly_profile"]), chosen)
    written = None
    for n in names:
        if n in ("schema", "customer_counts", "data_quality"):
            d = spark.read.parquet(f"{out}/{n}").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
                "name", F.lit(n))
            written = d if written is None else written.unionByName(d)
    return done.join(F.broadcast(written), "name", "left")  # a row per statistic


@query("hourly_series_years", "year:i first_ts:s last_ts:s n_rows:i n_null:i expected_rows:i", "A17", """
    SELECT year(ts) AS year, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, 0 AS n_null,
           24 * dayofyear(make_date(year(ts), 12, 31)) AS expected_rows
    FROM gen_hour GROUP BY year(ts)""")
def hourly_series_years(spark, sf):
    return pf.hourly_series_years(generation(spark, sf), "total_solar_mw")


@query("hourly_series_profile", "year_month:s n_rows:i n_null:i mean:6 total:4 max:4", "A17", """
    SELECT date_trunc('month', ts)::DATE AS year_month, count(*) AS n_rows, 0 AS n_null,
           avg(total_solar_mw) AS mean, sum(total_solar_mw) AS total, max(total_solar_mw) AS max
    FROM gen_hour GROUP BY 1""")
def hourly_series_profile(spark, sf):
    return pf.hourly_series_profile(generation(spark, sf), "total_solar_mw")


ctes.add("gen_gap", """
    SELECT date_diff('second', lag(ts) OVER (ORDER BY ts), ts) / 60.0 AS g FROM gen_hour""")


@query("hourly_gap_profile", "min:4 median:4 max:4 mode:4", "A17", """
    SELECT min(g) AS min, quantile_cont(g, 0.5) AS median, max(g) AS max,
           (SELECT g FROM gen_gap WHERE g IS NOT NULL GROUP BY g ORDER BY count(*) DESC, g LIMIT 1) AS mode
    FROM gen_gap""")
def hourly_gap_profile(spark, sf):
    return pf.hourly_gap_profile(generation(spark, sf))


# --- fleet, reports, chart tables ---------------------------------------------------------------

ctes.add("fleet_rows", """
    SELECT * FROM labelled WHERE model = 'partial_linear' AND horizon_days = 20""")


@query("fleet_kpis", "n_customers:i latest_month:s n_alarms:i alarm_rate:6", "D54 E15 Q19", """
    SELECT (SELECT count(DISTINCT customer_id) FROM monthly) AS n_customers, year_month AS latest_month,
           count_if(pred_any) AS n_alarms, count_if(pred_any) / count(*) AS alarm_rate
    FROM fleet_rows WHERE year_month = (SELECT max(year_month) FROM fleet_rows) GROUP BY year_month""")
def fleet_kpis(spark, sf):
    return fleet.kpis(results_of(spark, sf))


@query("fleet_alarm_rate_by_month", "year_month:s n:i alarm_rate:6", "D54", """
    SELECT year_month, count(*) AS n, count_if(pred_any) / count(*) AS alarm_rate
    FROM fleet_rows GROUP BY year_month""")
def fleet_alarm_rate_by_month(spark, sf):
    return fleet.alarm_rate_by_month(results_of(spark, sf))


@query("fleet_contract_mix", "contract_type n_customers:i share:6", "D54", """
    SELECT contract_type, count(DISTINCT customer_id) AS n_customers,
           count(DISTINCT customer_id) / (SELECT count(DISTINCT customer_id) FROM monthly) AS share
    FROM monthly GROUP BY contract_type""")
def fleet_contract_mix(spark, sf):
    return fleet.contract_mix(rollup.monthly_by_customer(daily_of(spark, sf)))


ctes.add("latest_rows", """
    SELECT *, month(year_month) AS month FROM fleet_rows QUALIFY row_number() OVER (
        PARTITION BY customer_id ORDER BY year_month DESC) = 1""")


@query("customer_report", "customer_id year_month:s pred_monthly_kwh:4 prev_delta_pct:6 "
       "yoy_delta_pct:6 ma3_delta_pct:6 pred_prev:i pred_yoy:i pred_ma:i pred_any:i pred_bill:i "
       "prev_bill:i", "I15 E15", """
    SELECT customer_id, year_month, pred_monthly_kwh,
           (pred_monthly_kwh / nullif(prev_month_kwh, 0) - 1) * 100 AS prev_delta_pct,
           (pred_monthly_kwh / nullif(yoy_month_kwh, 0) - 1) * 100 AS yoy_delta_pct,
           (pred_monthly_kwh / nullif(ma3_kwh, 0) - 1) * 100 AS ma3_delta_pct,
           pred_prev, pred_yoy, pred_ma, pred_any, p_final_won AS pred_bill, v_final_won AS prev_bill
    FROM report_bills""")
def customer_report(spark, sf):
    return fleet.customer_report(results_of(spark, sf))


from loadlens.plans.catalog.bills import bill_sql  # noqa: E402

ctes.add("report_bills", bill_sql("(" + bill_sql("latest_rows", kwh="pred_monthly_kwh", out="p_")
                                  + ")", kwh="prev_month_kwh", out="v_"))


@query("last_twelve_months", "customer_id year_month:s monthly_kwh:4 age:i", "E15", """
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY year_month DESC) AS age
    FROM monthly QUALIFY age <= 12""")
def last_twelve_months(spark, sf):
    return fleet.last_months(rollup.monthly_by_customer(daily_of(spark, sf)), 12)


@query("chart_model_horizon_means", "model horizon_days:i n:i mean_mape:4 r2:6", "D56", """
    SELECT model, horizon_days, count(*) AS n,
           avg(abs(pred_monthly_kwh - full_month_kwh) / full_month_kwh) * 100 AS mean_mape,
           1 - sum((pred_monthly_kwh - full_month_kwh)^2)
             / (sum(full_month_kwh^2) - sum(full_month_kwh)^2 / count(*)) AS r2
    FROM preds WHERE full_month_kwh > 0 AND pred_monthly_kwh IS NOT NULL GROUP BY ALL""")
def chart_model_horizon_means(spark, sf):
    from loadlens.operators import baselines

    return fleet.model_means(baselines.predict_all(context_of(spark, sf)))


ctes.add("residuals", """
    SELECT pred_monthly_kwh - full_month_kwh AS e, month(year_month) AS month FROM preds
    WHERE model = 'partial_linear' AND pred_monthly_kwh IS NOT NULL""")


@query("chart_residual_histogram", "bin:i n:i", "D56", """
    SELECT CASE WHEN hi = lo THEN 1 ELSE least(floor((e - lo) / ((hi - lo) / b)) + 1, b) END AS bin,
           count(*) AS n
    FROM residuals, (SELECT min(e) AS lo, max(e) AS hi, least(100, greatest(30, count(*) // 50)) AS b
                     FROM residuals) GROUP BY 1""")
def chart_residual_histogram(spark, sf):
    return fleet.histogram(results_of(spark, sf), "error")


@query("chart_monthly_error_quartiles", "month:i n:i q25:4 median:4 q75:4", "D56", """
    SELECT month, count(*) AS n, quantile_cont(abs(e), 0.25) AS q25, quantile_cont(abs(e), 0.5) AS median,
           quantile_cont(abs(e), 0.75) AS q75 FROM residuals GROUP BY month""")
def chart_monthly_error_quartiles(spark, sf):
    r = results_of(spark, sf).where("abs_error is not null")
    q = exact_quantiles(r, ["month"], "abs_error", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return r.groupBy("month").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(q), "month")


@query("chart_load_profile", "contract_type hour:i n:i mean:6 std:6", "D56", """
    SELECT contract_type, hour(ts) AS hour, count(p_active_kwh) AS n, avg(p_active_kwh) AS mean,
           stddev_samp(p_active_kwh) AS std FROM readings_hf GROUP BY ALL""")
def chart_load_profile(spark, sf):
    return t.readings_hf(spark, sf).groupBy("contract_type", F.hour("ts").alias("hour")).agg(
        F.count("p_active_kwh").alias("n"), F.avg("p_active_kwh").alias("mean"),
        F.stddev_samp("p_active_kwh").alias("std"))


@query("weather_response", "kind n:i r:7", "D57", """
    SELECT 'hdd' AS kind, count(*) AS n, corr(kwh, hdh_total) AS r FROM response_rows
    UNION ALL SELECT 'cdd', count(*), corr(kwh, cdh_total) FROM response_rows""")
def weather_response(spark, sf):
    m = rollup.monthly_by_customer(daily_of(spark, sf)).groupBy("year_month").agg(
        F.avg("monthly_kwh").alias("kwh"))
    d = m.join(F.broadcast(wx.national_series(month_of(spark, sf))), "year_month")  # one per month
    return d.select(F.explode(F.array(
        F.struct(F.lit("hdd").alias("kind"), F.col("hdh_total").alias("x"), "kwh"),
        F.struct(F.lit("cdd").alias("kind"), F.col("cdh_total").alias("x"), "kwh"))).alias("s")
    ).groupBy(F.col("s.kind").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), safe_corr(F.col("s.kwh"), F.col("s.x")).alias("r"))


ctes.add("nation_month", "SELECT year_month, "
         "sum(hdh_total * w) / sum(w) AS hdh_total, sum(cdh_total * w) / sum(w) AS cdh_total "
         "FROM weather_month JOIN station_weights USING (station_id) "
         "WHERE version = 'national_v1_paper' GROUP BY year_month")
ctes.add("response_rows", """
    SELECT kwh, hdh_total, cdh_total FROM (SELECT year_month, avg(monthly_kwh) AS kwh FROM monthly
           GROUP BY year_month) JOIN nation_month USING (year_month)""")


@query("smoke_stats", "contract_type n:i mean_kwh:6 share_over_30pct:8", "D59 E1", """
    SELECT contract_type, count(*) AS n, avg(monthly_kwh) AS mean_kwh,
           count_if(monthly_kwh > 1.3 * prev_m) / nullif(count(prev_m), 0) AS share_over_30pct
    FROM rate_rows GROUP BY contract_type""")
def smoke_stats(spark, sf):
    m = rollup.monthly_by_customer(daily_of(spark, sf))
    w = W.partitionBy("customer_id").orderBy("year_month")
    d = m.withColumn("_p", F.lag("monthly_kwh").over(w))
    over = F.sum(F.when(F.col("monthly_kwh") > 1.3 * F.col("_p"), 1).otherwise(0))
    return d.groupBy("contract_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("monthly_kwh").alias("mean_kwh"),
        (over / F.nullif(F.count("_p"), F.lit(0))).alias("share_over_30pct"))


AMI = ("observed_peak_ratio", "observed_night_ratio", "observed_load_factor",
       "observed_weekend_weekday_ratio", "observed_daily_cv", "observed_power_factor",
       "observed_reactive_ratio")
HOL = "ts::DATE IN (SELECT date FROM holiday)"
ctes.add("ami_read", f"""
    SELECT *, {ctes.tou_rules('ts', HOL)} AS tou, isodow(ts) >= 6 AS we,
           greatest(p_reactive_lag, p_reactive_lead) AS qi, ts::DATE AS date,
           date_trunc('month', ts)::DATE AS year_month
    FROM readings WHERE p_active_kwh IS NOT NULL""")
ctes.add("ami_cv", """
    SELECT customer_id, year_month, CASE WHEN count(*) >= 2 AND avg(k) > 0 THEN stddev_samp(k) / avg(k) END
      AS daily_cv FROM (SELECT customer_id, year_month, date, sum(p_active_kwh) AS k FROM ami_read
                        GROUP BY ALL) GROUP BY ALL""")
ctes.add("ami_month", """
    SELECT customer_id, year_month,
      CASE WHEN s > 0 THEN peak / s END AS observed_peak_ratio,
      CASE WHEN s > 0 THEN night / s END AS observed_night_ratio,
      CASE WHEN mx > 0 THEN s / n / mx END AS observed_load_factor,
      CASE WHEN wd > 0 THEN wk / wd END AS observed_weekend_weekday_ratio,
      daily_cv AS observed_daily_cv, pf AS observed_power_factor,
      CASE WHEN s > 0 THEN q / s END AS observed_reactive_ratio,
      off_k AS tou_off_kwh, mid_k AS tou_mid_kwh, on_k AS tou_on_kwh,
      CASE WHEN off_k + mid_k + on_k > 0 THEN off_k / (off_k + mid_k + on_k) END AS tou_off_ratio,
      CASE WHEN off_k + mid_k + on_k > 0 THEN mid_k / (off_k + mid_k + on_k) END AS tou_mid_ratio,
      CASE WHEN off_k + mid_k + on_k > 0 THEN on_k / (off_k + mid_k + on_k) END AS tou_on_ratio
    FROM (SELECT customer_id, year_month, sum(p_active_kwh) AS s, count(*) AS n,
        greatest(max(p_active_kwh), 0) AS mx,
        coalesce(sum(p_active_kwh) FILTER (WHERE hour(ts) BETWEEN 10 AND 16), 0) AS peak,
        coalesce(sum(p_active_kwh) FILTER (WHERE hour(ts) >= 23 OR hour(ts) < 9), 0) AS night,
        avg(p_active_kwh) FILTER (WHERE we) AS wk, avg(p_active_kwh) FILTER (WHERE NOT we) AS wd,
        avg(p_active_kwh / sqrt(p_active_kwh^2 + qi^2)) FILTER (WHERE p_active_kwh > 0) AS pf,
        sum(p_reactive_lag + p_reactive_lead) AS q,
        coalesce(sum(p_active_kwh) FILTER (WHERE tou = 'off_peak'), 0) AS off_k,
        coalesce(sum(p_active_kwh) FILTER (WHERE tou = 'mid_peak'), 0) AS mid_k,
        coalesce(sum(p_active_kwh) FILTER (WHERE tou = 'on_peak'), 0) AS on_k
      FROM ami_read GROUP BY ALL) JOIN ami_cv USING (customer_id, year_month)""")


@query("ami_monthly", "customer_id year_month:s " + " ".join(f"{c}:g" for c in AMI)
       + " tou_off_kwh:4 tou_mid_kwh:4 tou_on_kwh:4 tou_off_ratio:g tou_mid_ratio:g tou_on_ratio:g",
       "D5 Q10", "SELECT * FROM ami_month")
def ami_monthly(spark, sf):
    return rollup.ami_monthly(t.readings(spark, sf), t.holidays(spark))


ctes.add("ami_obs", """
    SELECT customer_id, year_month, horizon_days, peak / s AS observed_peak_ratio,
      on_k / s AS observed_tou_on_peak, night / s AS observed_night_ratio,
      CASE WHEN mx > 0 THEN s / n / mx ELSE 0 END AS observed_load_factor,
      coalesce(wk, 0) / nullif(coalesce(wd, 1e-9), 0) AS observed_weekend_weekday_ratio,
      CASE WHEN dm > 0 THEN ds / dm ELSE 0 END AS observed_daily_cv, pf AS observed_power_factor,
      q / nullif(p, 0) AS observed_reactive_ratio
    FROM (SELECT customer_id, year_month, h AS horizon_days, sum(p_active_kwh) AS s, count(*) AS n,
        max(p_active_kwh) AS mx,
        coalesce(sum(p_active_kwh) FILTER (WHERE hour(ts) BETWEEN 10 AND 17), 0) AS peak,
        coalesce(sum(p_active_kwh) FILTER (WHERE tou = 'on_peak'), 0) AS on_k,
        coalesce(sum(p_active_kwh) FILTER (WHERE hour(ts) >= 23 OR hour(ts) < 9), 0) AS night,
        avg(p_active_kwh) FILTER (WHERE we) AS wk, avg(p_active_kwh) FILTER (WHERE NOT we) AS wd,
        avg(p_active_kwh / sqrt(p_active_kwh^2 + p_reactive_kwh^2)) FILTER (WHERE p_active_kwh > 0) AS pf,
        sum(p_reactive_kwh) FILTER (WHERE p_active_kwh > 0) AS q,
        sum(p_active_kwh) FILTER (WHERE p_active_kwh > 0) AS p
      FROM ami_read, (VALUES (10), (20)) v(h) WHERE day(ts) <= h GROUP BY ALL
      HAVING count(*) >= 4 AND sum(p_active_kwh) > 0)
    JOIN (SELECT customer_id, year_month, h AS horizon_days, stddev_samp(k) AS ds, avg(k) AS dm
          FROM (SELECT customer_id, year_month, date, sum(p_active_kwh) AS k FROM ami_read GROUP BY ALL),
               (VALUES (10), (20)) v(h) WHERE day(date) <= h GROUP BY ALL)
    USING (customer_id, year_month, horizon_days)""")


@query("ami_observed", "customer_id year_month:s horizon_days:i observed_tou_on_peak:g "
       + " ".join(f"{c}:g" for c in AMI), "D10", "SELECT * FROM ami_obs")
def ami_observed(spark, sf):
    return rollup.ami_observed(t.readings(spark, sf), holidays=t.holidays(spark))


@query("customer_attributes", "customer_id contract_type contract_power_kw:2 region_code region_sub",
       "D7", """
    SELECT customer_id, contract_type, contract_power_kw, region_code, region_sub FROM customer_info
    WHERE customer_id IN (SELECT customer_id FROM readings)""")
def customer_attributes(spark, sf):
    return rollup.customer_attributes(t.readings(spark, sf))


@query("has_intraday", "has_intraday:i", "D10", """
    SELECT max(c) > 1 AS has_intraday FROM (
        SELECT count(*) AS c FROM readings_hf GROUP BY customer_id, ts::DATE)""")
def has_intraday(spark, sf):
    return rollup.has_intraday(t.readings_hf(spark, sf))
