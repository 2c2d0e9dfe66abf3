"""Feature, model and study queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.functions import calendar as cal
from loadlens.functions.joins import small_side
from loadlens.operators import (btm, features as ft, metrics, models, rollup, studies,
                                weather as wx)
from loadlens.plans.catalog import ctes
from loadlens.plans.catalog.base import query
from loadlens.plans.catalog.climate import month_of
from loadlens.plans.catalog.core import daily_of
from loadlens.sources import tables as t
from loadlens.session import work_dir, write_and_read

ROUNDS = 400  # most boosting rounds; the validation months choose how many are kept
SOLAR_ROUNDS = 200
STUDY_ROUNDS = 100  # most rounds of each of the models that a study compares, in steps of 0.1
TRIAL_ROUNDS = 60   # most rounds of a setting that is tried


def info_of(spark, sf):
    return wx.customer_stations(t.customer_info(spark, sf)).select(
        "customer_id", "contract_power_kw", "region_code", "station_id")


def features_of(spark, sf):
    return ft.build_features(t.readings(spark, sf), info_of(spark, sf),
                             t.weather_hourly(spark, sf), t.holidays(spark))


def stored_features(spark, sf):
    """Feature matrix written once: every model job reads it several times."""
    f, spec = features_of(spark, sf)
    return write_and_read(f, "features", release=True), spec


def flags_of(spark, sf, features):
    """Flags of generating customers. Variants of many rows read them from a written table, a row
    per customer, which is broadcast where it is small: else each variant reads all readings for
    them twice, and shuffles all features to join them. Of few rows each variant computes them,
    as the order of rows that a written table gives decides other subsamples."""
    flags = btm.ingest_rule(btm.ingest_signals(t.readings(spark, sf)))
    if features.count() <= studies.FEW_ROWS:
        return flags
    return small_side(write_and_read(flags.select("customer_id", "is_btm", "btm_score"), "flags"))


ctes.add("pf_obs_lag", """
    SELECT a.*, a.observed_power_factor - b.observed_power_factor AS pf_vs_prev_month
    FROM ami_obs a LEFT JOIN ami_obs b ON a.customer_id = b.customer_id
      AND a.horizon_days = b.horizon_days AND b.year_month = a.year_month - INTERVAL 1 MONTH""")
ctes.add("hist_mean", """
    SELECT customer_id, year_month, avg(monthly_kwh) OVER (PARTITION BY customer_id ORDER BY year_month
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS customer_mean_history FROM monthly""")


@query("feature_matrix", "customer_id year_month:s horizon_days:i month:i days_in_month:i "
       "days_observed:i partial_rate:8 prev_month_kwh:4 ma3_kwh:6 customer_mean_history:6 "
       "observed_peak_ratio:g observed_power_factor:g pf_vs_prev_month:8 n_workday:i "
       "disruption_ratio:6 contract_power_kw:2 region_code hdd_full:8 cdd_observed:8 "
       "hdd_remainder:8", "K1 C19 E13 H10 C13", """
    SELECT c.*, month(c.year_month) AS month, partial_kwh / days_observed AS partial_rate,
           customer_mean_history, observed_peak_ratio, observed_power_factor, pf_vs_prev_month,
           n_workday, disruption_ratio, i.contract_power_kw, i.region_code, hdd_full, cdd_observed,
           hdd_remainder
    FROM ctx c LEFT JOIN hist_mean USING (customer_id, year_month)
    LEFT JOIN pf_obs_lag USING (customer_id, year_month, horizon_days)
    LEFT JOIN special_days USING (year_month)
    LEFT JOIN customer_info i USING (customer_id) LEFT JOIN cust_station s USING (customer_id)
    LEFT JOIN degree_features d ON d.station_id = s.station_id AND d.year_month = c.year_month
         AND d.horizon_days = c.horizon_days""")
def feature_matrix(spark, sf):
    return features_of(spark, sf)[0]


@query("ami_month_join", "customer_id year_month:s horizon_days:i tou_on_kwh:4 tou_off_ratio:g",
       "C19", """
    SELECT h.customer_id, h.year_month, horizon_days, tou_on_kwh, tou_off_ratio
    FROM horizon h LEFT JOIN ami_month USING (customer_id, year_month)""")
def ami_month_join(spark, sf):
    from loadlens.operators import horizon as hz

    return ft.with_month_table(hz.build_horizon_table(daily_of(spark, sf)),
                               rollup.ami_monthly(t.readings(spark, sf), t.holidays(spark)))


@query("feature_target_correlation", "feature corr:7 rank:i", "K17 E16 P13",
       "SELECT *, row_number() OVER (ORDER BY abs(corr) DESC, feature) AS rank FROM ("
       + "\nUNION ALL\n".join(f"""
    SELECT '{c}' AS feature, corr({c}, full_month_kwh) AS corr
    FROM ctx LEFT JOIN hist_mean USING (customer_id, year_month)""" for c in (
    "partial_kwh", "prev_month_kwh", "yoy_month_kwh", "ma3_kwh", "customer_mean_history")) + ")")
def feature_target_correlation(spark, sf):
    from loadlens.operators import horizon as hz

    return models.feature_target_correlation(hz.calendar_context(daily_of(spark, sf)), (
        "partial_kwh", "prev_month_kwh", "yoy_month_kwh", "ma3_kwh", "customer_mean_history"))


@query("feature_selection", "feature corr_with_target:6 rank:i n_valid:i vif:4 status", "K7 F4 B22")
def feature_selection(spark, sf):
    f, spec = features_of(spark, sf)
    return models.select_features(f, list(spec.numeric))


@query("residual_model_evaluation", f"horizon_days:i contract_type rounds:i {ctes.REG_COLS}",
       "K2 K4 C15")
def residual_model_evaluation(spark, sf):
    f, spec = stored_features(spark, sf)
    model = models.train(f, spec, rounds=ROUNDS)
    preds = models.predictions(model, models.test_rows(f), spec)
    return metrics.evaluate(preds, f).withColumn("rounds", F.lit(models.rounds_of(model)))


ctes.add("model_split", """
    SELECT c.*, CASE WHEN year_month <= train_end THEN 'train' WHEN year_month <= val_end THEN 'val'
                ELSE 'test' END AS split
    FROM ctx c, (SELECT lo + to_months(CAST(CASE WHEN n >= 30 THEN 17 WHEN n >= 18 THEN n // 2 - 1
                        ELSE n * 2 // 3 - 1 END AS INTEGER)) AS train_end,
                   CASE WHEN n >= 30 THEN lo + INTERVAL 23 MONTH END AS val_end
                 FROM (SELECT min(year_month) AS lo, date_diff('month', min(year_month),
                         max(year_month)) + 1 AS n FROM ctx))""")


@query("model_split_counts", "split n:i customers:i first_month:s last_month:s", "K3 B20", """
    SELECT split, count(*) AS n, count(DISTINCT customer_id) AS customers,
           min(year_month)::DATE AS first_month, max(year_month)::DATE AS last_month
    FROM model_split GROUP BY split""")
def model_split_counts(spark, sf):
    """The months that fit a model, stop its boosting and score it, which never overlap."""
    from loadlens.operators import clean

    f, _ = features_of(spark, sf)
    return clean.with_suggested_split(f).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("customers"),
        F.min("year_month").alias("first_month"), F.max("year_month").alias("last_month"))


@query("model_round_trip", "horizon_days:i n:i n_changed:i n_below_partial:i n_missing:i "
       "columns_kept:i", "K3 K4 C15", """
    SELECT horizon_days, count(*) AS n, 0 AS n_changed, 0 AS n_below_partial, 0 AS n_missing,
           1 AS columns_kept FROM model_split WHERE split = 'test' GROUP BY horizon_days""")
def model_round_trip(spark, sf):
    """A model written with its feature list and read back: the predictions of all test rows
    before and after, none of them below what was already used."""
    f, spec = stored_features(spark, sf)
    model = models.train(f, spec, rounds=10)
    path = work_dir(spark, "model")
    models.save(model, spec, path)
    again, spec2 = models.load(spark, path)
    rows = models.test_rows(f)
    a = models.predict(model, rows, spec).select(*ft.KEYS, "partial_kwh", models.PRED)
    b = models.predict(again, rows, spec2).select(*ft.KEYS, F.col(models.PRED).alias("later"))
    p, q = F.col(models.PRED), F.col("later")
    return a.join(b, list(ft.KEYS), "left").groupBy("horizon_days").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~p.eqNullSafe(q)).alias("n_changed"),
        F.count_if(p < F.col("partial_kwh")).alias("n_below_partial"),
        F.count_if(p.isNull()).alias("n_missing")).withColumn(
        "columns_kept", F.lit(int(set(spec.all) == set(spec2.all))))


@query("residual_correction", f"stage rounds:i {ctes.REG_COLS}", "K5 H14")
def residual_correction(spark, sf):
    f, spec = stored_features(spark, sf)
    model = models.train(f, spec, rounds=ROUNDS)
    scored = write_and_read(models.predict(model, f, spec), "scored")
    rows, cols = models.residual_features(scored)
    last = rows.agg(F.max("year_month").alias("_last"))
    from loadlens.operators.clean import default_train_end

    rows = rows.join(F.broadcast(last))  # one row
    early = F.col("year_month") <= default_train_end(F.col("_last"))
    fitted = models.fit_correction(rows.where(early), cols)
    return models.correction_report(models.apply_correction(
        rows.where(~early), fitted, cols)).withColumn("rounds", F.lit(models.rounds_of(model)))


@query("linear_residual_patterns", "dimension value:i n:i mean_residual:6 std_residual:6", "D53", """
    SELECT 'month' AS dimension, month AS value, count(*) AS n, avg(-e) AS mean_residual,
           stddev_pop(-e) AS std_residual FROM residuals GROUP BY month HAVING count(*) >= 10
    UNION ALL SELECT 'horizon_days', horizon_days, count(*),
           avg(full_month_kwh - pred_monthly_kwh), stddev_pop(full_month_kwh - pred_monthly_kwh)
    FROM preds WHERE model = 'partial_linear' AND pred_monthly_kwh IS NOT NULL
    GROUP BY horizon_days HAVING count(*) >= 10""")
def linear_residual_patterns(spark, sf):
    from loadlens.plans.catalog.core import results_of

    rows = results_of(spark, sf)
    return models.residual_patterns(rows.withColumn("r_target", -F.col("error")))


METER_DAYS = (1, 5, 10, 15, 20, 25)
ctes.add("sliding_horizon", ctes.horizon_sql(
    "(SELECT d.*, md AS meter_day FROM daily d, (VALUES (1), (5), (10), (15), (20), (25)) m(md))",
    """CASE WHEN day(date) >= meter_day
         THEN (date_trunc('month', date) + to_days(CAST(meter_day - 1 AS INTEGER)))::DATE
         ELSE (date_trunc('month', date) - INTERVAL 1 MONTH
               + to_days(CAST(meter_day - 1 AS INTEGER)))::DATE END""", extra_key="meter_day"))
ctes.add("sliding", """
    SELECT *, partial_kwh * days_in_month / days_observed AS pred_monthly_kwh FROM sliding_horizon""")


@query("sliding_evaluation", f"meter_day:i horizon_days:i {ctes.REG_COLS}", "K8 D15",
       f"SELECT meter_day, horizon_days, {ctes.regression()} FROM sliding "
       "GROUP BY meter_day, horizon_days")
def sliding_evaluation(spark, sf):
    daily = daily_of(spark, sf)
    rows = models.sliding_evaluation(daily, rollup.monthly_by_customer(daily), METER_DAYS)
    return rows.groupBy("meter_day", "horizon_days").agg(*metrics.regression_aggs())


SLIDING_SPEC = ft.FeatureSpec().without(("customer_mean_history",))  # known for any meter day


def sliding_scorers(spark, sf, daily, rounds, tuning_trials=2):
    """Models of calendar months that score the rows of every meter day: boosted with the usual
    settings, with the best of some random settings, and corrected linearly."""
    from loadlens.operators import horizon as hz

    f = write_and_read(ft.with_base(hz.calendar_context(daily)), "features")
    base = studies.study_model(f, SLIDING_SPEC, rounds)
    best = models.tune(f, SLIDING_SPEC, trials=tuning_trials, rounds=rounds, fit_rows=TRIAL_ROWS,
                       patience=studies.STUDY_PATIENCE).first()
    tuned = models.train(f, SLIDING_SPEC, rounds=rounds, rate=best["rate"], depth=best["depth"],
                         subsample=best["subsample"], min_leaf=best["min_leaf"],
                         patience=studies.STUDY_PATIENCE)
    rows, cols = models.residual_features(models.predict(base, f, SLIDING_SPEC))
    seen = rows.join(models.test_rows(f).select(*ft.KEYS), list(ft.KEYS), "left_anti")
    fitted = write_and_read(models.fit_correction(seen, cols), "correction")
    return models.scorers(base, tuned, fitted, SLIDING_SPEC)


@query("sliding_model_evaluation", f"model meter_day:i horizon_days:i {ctes.REG_COLS}", "K8 D15")
def sliding_model_evaluation(spark, sf):
    daily = write_and_read(daily_of(spark, sf), "daily")
    rows = models.sliding_evaluation(
        daily, rollup.monthly_by_customer(daily), METER_DAYS,
        sliding_scorers(spark, sf, daily, TRIAL_ROUNDS))
    return rows.groupBy("model", "meter_day", "horizon_days").agg(*metrics.regression_aggs())


ctes.add("by_date", f"""
    SELECT year_month, meter_day, {ctes.regression()} FROM sliding
    GROUP BY year_month, meter_day HAVING count(*) >= 10""")


def by_date_of(spark, sf):
    daily = daily_of(spark, sf)
    rows = models.sliding_evaluation(daily, rollup.monthly_by_customer(daily), METER_DAYS)
    g = rows.groupBy("year_month", "meter_day").agg(
        F.count(F.lit(1)).alias("_rows"), *metrics.regression_aggs())
    return g.where(F.col("_rows") >= 10)


for _name, _worst, _dir in (("worst_billing_dates", True, "DESC"), ("best_billing_dates", False, "ASC")):
    def _build(spark, sf, worst=_worst):
        return metrics.extreme_dates(by_date_of(spark, sf), 10, worst)

    query(_name, "year_month:s meter_day:i n:i mape_pct:4", "F1 D15",
          f"SELECT * FROM by_date ORDER BY mape_pct {_dir}, year_month, meter_day LIMIT 10")(_build)


@query("sliding_month_heatmap", "year_month:s " + " ".join(f"md_{m}:4" for m in METER_DAYS), "D56",
       "SELECT year_month, " + ", ".join(
           f"max(mape_pct) FILTER (WHERE meter_day = {m}) AS md_{m}" for m in METER_DAYS)
       + " FROM by_date GROUP BY year_month")
def sliding_month_heatmap(spark, sf):
    return by_date_of(spark, sf).groupBy("year_month").agg(*[
        F.max(F.when(F.col("meter_day") == m, F.col("mape_pct"))).alias(f"md_{m}")
        for m in METER_DAYS])


@query("weather_sensitivity", "scenario shift:2 month:i rounds:i n:i mape_pct:4 rmse:4", "K9 C21")
def weather_sensitivity(spark, sf):
    """Every scenario over all test rows (month null) and by month."""
    f, spec = stored_features(spark, sf)
    model = studies.study_model(f, spec, STUDY_ROUNDS)
    overall, by_month = studies.weather_sensitivity(models.test_rows(f), spec,
                                                    lambda d: models.predict(model, d, spec))
    both = by_month.unionByName(overall, allowMissingColumns=True)
    return both.withColumn("rounds", F.lit(models.rounds_of(model)))


@query("station_weights", "mode station_id:i n_months:i weight:6 r_squared:6", "K10")
def station_weights(spark, sf):
    load = studies.mean_load(rollup.monthly_by_customer(daily_of(spark, sf)))
    return studies.station_weights(load, month_of(spark, sf))


ctes.add("mean_load", """
    SELECT '전체' AS contract_type, year_month, avg(monthly_kwh) AS y FROM monthly GROUP BY year_month
    UNION ALL SELECT contract_type, year_month, avg(monthly_kwh) FROM monthly
    GROUP BY contract_type, year_month""")
ctes.add("grid_rows", """
    SELECT l.contract_type, l.year_month, l.y, g.hb, g.cb, g.h, g.c FROM mean_load l JOIN (
      SELECT date_trunc('month', ts)::DATE AS year_month, hb, cb,
             sum(greatest(hb - temp_c, 0)) AS h, sum(greatest(temp_c - cb, 0)) AS c
      FROM weather, (SELECT unnest(range(10, 21))::DOUBLE AS hb) a,
           (SELECT unnest(range(20, 31))::DOUBLE AS cb) b
      WHERE temp_c IS NOT NULL AND hb < cb GROUP BY ALL) g USING (year_month)""")
ctes.add("grid_fit", """
    SELECT *, my - hdd_coef * mh - cdd_coef * mc AS intercept FROM (
      SELECT contract_type, hb, cb, count(*) AS n, avg(y) AS my, avg(h) AS mh, avg(c) AS mc,
        (covar_samp(h, y) * var_samp(c) - covar_samp(c, y) * covar_samp(h, c))
          / (var_samp(h) * var_samp(c) - covar_samp(h, c)^2) AS hdd_coef,
        (covar_samp(c, y) * var_samp(h) - covar_samp(h, y) * covar_samp(h, c))
          / (var_samp(h) * var_samp(c) - covar_samp(h, c)^2) AS cdd_coef
      FROM grid_rows GROUP BY ALL HAVING count(*) >= 6)""")
ctes.add("grid_score", """
    SELECT contract_type, hb AS hdd_base, cb AS cdd_base, count(*) AS n_months,
      1 - sum((y - intercept - hdd_coef * h - cdd_coef * c)^2) / (var_pop(y) * count(*)) AS r_squared,
      avg(abs(y - intercept - hdd_coef * h - cdd_coef * c) / y) * 100 AS mape_pct
    FROM grid_rows JOIN grid_fit USING (contract_type, hb, cb) GROUP BY ALL""")


@query("base_temperature_grid", "hdd_base:1 cdd_base:1 n_months:i r_squared:6 mape_pct:4", "K11",
       "SELECT * FROM grid_score WHERE contract_type = '전체'")
def base_temperature_grid(spark, sf):
    load = studies.mean_load(rollup.monthly_by_customer(daily_of(spark, sf)))
    return studies.base_temperature_grid(t.weather_hourly(spark, sf), load)


@query("weather_optimization", "contract_type hdd_base:1 cdd_base:1 r_squared:6 mape_pct:4",
       "K12 K11 F3", """
    SELECT * FROM grid_score QUALIFY row_number() OVER (
        PARTITION BY contract_type ORDER BY round(r_squared, 12) DESC, hdd_base, cdd_base) = 1""")
def weather_optimization(spark, sf):
    return studies.weather_optimization(t.weather_hourly(spark, sf),
                                        rollup.monthly_by_customer(daily_of(spark, sf)))


@query("optimized_national_weather", "mode year_month:s cdh_total:4 hdh_total:4 temp_mean:9",
       "K12 A24")
def optimized_national_weather(spark, sf):
    month = month_of(spark, sf)
    load = studies.mean_load(rollup.monthly_by_customer(daily_of(spark, sf)))
    return studies.weighted_series(studies.station_weights(load, month), month)


TRIALS = 50  # settings tried, each fitted on all training rows
TRIAL_ROWS = 20_000  # labelled rows that the settings of the sliding models are fitted on
STUDY_COLS = "variant dimension horizon_days:i rounds:i n:i mape_pct:4 rmse:4 cvrmse_median_pct:4"


@query("weather_version_comparison", STUDY_COLS, "K13 F2")
def weather_version_comparison(spark, sf):
    f, spec = stored_features(spark, sf)
    month = write_and_read(month_of(spark, sf), "month")
    return studies.compare_variants(studies.weather_version_variants(
        f, spec, write_and_read(wx.national_versions(month), "national"),
        write_and_read(wx.wide_stations(month), "stations")), STUDY_ROUNDS)


@query("btm_strategy_comparison", "variant rounds:i mape_mean:4 f1_mean:4", "K14 D55")
def btm_strategy_comparison(spark, sf):
    f, spec = stored_features(spark, sf)
    flags = flags_of(spark, sf, f)
    return studies.strategy_summary(studies.compare_variants(
        studies.btm_strategy_variants(f, spec, flags), STUDY_ROUNDS))


@query("ablation", "variant rounds:i n:i mape_pct:4 cvrmse_median_pct:4 contribution:4", "K15 F2")
def ablation(spark, sf):
    f, spec = stored_features(spark, sf)
    return studies.ablation(f, spec, STUDY_ROUNDS)


def typical_versions(spark, sf):
    """Monthly typical-year tables: as they are, shifted, and rescaled to observed days. They are
    written once, as every variant reads them several times."""
    typical = wx.typical_hourly(t.typical_year_hourly(spark, sf))
    month = write_and_read(month_of(spark, sf), "month")
    raw = write_and_read(wx.typical_monthly(typical), "typical")
    scaled = wx.typical_monthly(wx.forecast_corrected(typical, t.weather_hourly(spark, sf)))
    return month, {"tmy_raw": raw,
                   "tmy_bias": write_and_read(wx.bias_corrected(raw, month), "typical"),
                   "tmy_forecast": write_and_read(scaled, "typical")}


@query("weather_policy_comparison", STUDY_COLS, "K15 D24")
def weather_policy_comparison(spark, sf):
    f, spec = stored_features(spark, sf)
    options = studies.weather_policy_options(*typical_versions(spark, sf))
    return studies.compare_variants({n: o(f, spec) for n, o in options.items()}, STUDY_ROUNDS)


@query("one_factor_ablation", "variant rounds:i n:i mape_pct:4 cvrmse_median_pct:4 contribution:4 kept",
       "K15 F2")
def one_factor_ablation(spark, sf):
    f, spec = stored_features(spark, sf)
    flags = flags_of(spark, sf, f)
    from loadlens.operators import clean

    chosen = models.select_features(clean.with_suggested_split(f).where("split <> 'test'"),
                                    list(spec.numeric)).where("status = 'selected'")
    names = tuple(r["feature"] for r in chosen.select("feature").collect())
    return studies.one_factor_ablation(f, spec, {
        "btm": studies.btm_options(flags),
        "weather": studies.weather_policy_options(*typical_versions(spark, sf)),
        "selection": studies.selection_option(spec, names)}, STUDY_ROUNDS)


@query("hyper_parameter_search", "trial:i rate:6 depth:i subsample:6 min_leaf:i rounds:i "
       "cvrmse_median:4",
       "K16")
def hyper_parameter_search(spark, sf):
    f, spec = stored_features(spark, sf)
    return models.tune(f, spec, trials=TRIALS, rounds=TRIAL_ROUNDS,
                       patience=studies.STUDY_PATIENCE)


@query("feature_importance", "feature impurity_importance:6 share_pct:4 rank:i rounds:i", "K17")
def feature_importance(spark, sf):
    f, spec = stored_features(spark, sf)
    model = studies.study_model(f, spec, STUDY_ROUNDS)
    return models.importance(model, spec, spark).withColumn("rounds", F.lit(models.rounds_of(model)))


@query("permutation_importance", "feature mae_increase:6 rounds:i", "K17")
def permutation_importance(spark, sf):
    f, spec = stored_features(spark, sf)
    model = studies.study_model(f, spec, STUDY_ROUNDS)
    return models.permutation_importance(model, models.test_rows(f), spec, spec.numeric).withColumn(
        "rounds", F.lit(models.rounds_of(model)))


def solar_rows(spark, sf):
    """Monthly hidden generation from the order book read as hourly output, with weather."""
    o = t.table(spark, sf, "orders")
    ts = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    price = F.col("o_totalprice") / 1e4
    hours = o.groupBy(ts.alias("ts")).agg(
        F.sum(price).alias("total_solar_mw"),
        F.sum(F.when(F.col("o_orderstatus") == "F", price).otherwise(0.0)).alias("market_solar_mw"))
    return models.solar_features(btm.hidden_generation_monthly(hours),
                                 wx.national_series(month_of(spark, sf)))


@query("solar_generation_model", "year_month:s btm_mwh:2 pred_btm_mwh:2 daylight_hours:2 "
       "temp_loss:6", "K6 H11 H13 E17")
def solar_generation_model(spark, sf):
    rows = write_and_read(solar_rows(spark, sf), "solar")
    model = models.train_solar(rows, rounds=SOLAR_ROUNDS)
    return models.predict_solar(model, rows)


ctes.add("order_hours", """
    SELECT o_orderdate + to_hours(o_orderkey % 24) AS ts, sum(o_totalprice / 1e4) AS total_mw,
           sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1e4 ELSE 0 END) AS market_mw
    FROM orders GROUP BY 1""")


@query("solar_features", "year_month:s months_since_start:i daylight_hours:2 btm_mwh:2 "
       "restored_kwh:2", "H11 H13 E17 A10", """
    SELECT year_month, date_diff('month', min(year_month) OVER (), year_month) AS months_since_start,
      CASE month(year_month) WHEN 1 THEN 9.8 WHEN 2 THEN 10.8 WHEN 3 THEN 12.0 WHEN 4 THEN 13.2
        WHEN 5 THEN 14.2 WHEN 6 THEN 14.8 WHEN 7 THEN 14.5 WHEN 8 THEN 13.6 WHEN 9 THEN 12.4
        WHEN 10 THEN 11.2 WHEN 11 THEN 10.1 ELSE 9.5 END AS daylight_hours,
      btm_mwh, kwh + greatest(btm_mwh, 0) AS restored_kwh
    FROM (SELECT date_trunc('month', ts)::DATE AS year_month, sum(total_mw - market_mw) AS btm_mwh
          FROM order_hours GROUP BY 1)
    JOIN (SELECT year_month, sum(monthly_kwh) AS kwh FROM monthly GROUP BY 1) USING (year_month)
    JOIN (SELECT DISTINCT year_month FROM weather_month) USING (year_month)""")
def solar_features(spark, sf):
    from loadlens.functions.scalars import restore_consumption

    load = daily_of(spark, sf).groupBy(cal.month_start(F.col("date")).alias("year_month")).agg(
        F.sum("day_kwh").alias("kwh"))
    d = solar_rows(spark, sf).join(load, "year_month")
    return d.withColumn("restored_kwh", restore_consumption(F.col("kwh"), F.col("btm_mwh")))
