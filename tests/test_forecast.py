"""Horizons, alarms, metrics, features and models."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.operators import (alarm, baselines, btm, clean, features as ft, horizon as hz, metrics, models,
                                rollup, studies)
from loadlens.plans import scoring
from loadlens.plans.catalog import core, modelling
from loadlens.session import work_dir
from loadlens.sources import tables as t

SF = "/root/testdata/sf0.001"


def daily(spark, rows):
    return spark.createDataFrame([(c, k, dt.date.fromisoformat(d), float(v)) for c, k, d, v in rows],
                                 "customer_id string, contract_type string, date date, day_kwh double")


def test_horizon_counts_a_day_once(spark):
    d = daily(spark, [("a", "A", "2024-01-01", 1), ("a", "B", "2024-01-01", 2),
                      ("a", "A", "2024-01-11", 4), ("a", "A", "2024-01-25", 8),
                      ("a", "A", "2024-02-15", 16)])
    got = {(str(r.year_month), r.horizon_days): r for r in hz.build_horizon_table(d).collect()}
    r = got[("2024-01-01", 10)]
    assert (r.partial_kwh, r.full_month_kwh, r.days_in_month, r.remainder_kwh) == (3, 15, 3, 12)
    assert r.contract_type == "A" and r.calendar_days == 31 and r.days_observed == 3
    assert got[("2024-01-01", 20)].partial_kwh == 7
    assert ("2024-02-01", 10) not in got  # no day before the horizon
    present = hz.build_horizon_table(d, observed_basis="present").collect()
    assert {(str(r.year_month), r.horizon_days): r.days_observed for r in present}[
        ("2024-01-01", 10)] == 1


def test_many_meter_days_are_dealt_to_many_tasks(spark):
    """Rows multiply after the shuffle: its shares must not be merged by what they read."""
    d = daily(spark, [(f"c{i}", "A", "2024-01-01", 1) for i in range(200)])
    rows = hz.build_horizon_table(d, meter_days=(1, 5, 10, 15, 20, 25))
    assert rows.rdd.getNumPartitions() >= 16 * spark.sparkContext.defaultParallelism
    # New Year's Day is day 0, 27, 22, 17, 12 and 7 of its billing months.
    assert rows.count() == 200 * (2 + 0 + 0 + 1 + 1 + 2)


def test_meter_days_in_one_job(spark):
    d = daily(spark, [("a", "A", f"2024-01-{i:02d}", i) for i in range(1, 32)])
    many = hz.build_horizon_table(d, meter_days=(1, 15))
    for md in (1, 15):
        one = hz.build_horizon_table(d, meter_day=md)
        part = many.where(F.col("meter_day") == md).drop("meter_day").select(*one.columns)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, part.collect()))


def test_both_context_paths_agree(spark):
    d = core.daily_of(spark, SF)
    a = hz.calendar_context(d).drop("customer_mean_history")
    b = hz.attach_alarm_context(hz.build_horizon_table(d), rollup.monthly_by_customer(d))
    cols = sorted(a.columns)
    num = [c for c, ty in a.dtypes if ty == "double"]
    fix = lambda x: x.select(*[F.round(c, 6).alias(c) if c in num else F.col(c) for c in cols])
    assert fix(a).exceptAll(fix(b)).isEmpty() and fix(b).exceptAll(fix(a)).isEmpty()


def test_invariants(spark):
    ctx = core.context_of(spark, SF)
    assert ctx.where(F.abs(F.col("partial_kwh") + F.col("remainder_kwh")
                           - F.col("full_month_kwh")) > 1e-6).isEmpty()
    rows = metrics.labelled(baselines.predict_all(ctx))
    m = rows.groupBy("model").agg(F.count(F.lit(1)).alias("all"), *alarm.classification(
        F.col("pred_any"), F.col("true_any"))).collect()
    assert all(r["all"] == r.alarm_tp + r.alarm_fp + r.alarm_fn + r.alarm_tn for r in m)
    d = core.daily_of(spark, SF)
    total = d.agg(F.sum("day_kwh")).first()[0]
    assert rollup.monthly_by_customer(d).agg(F.sum("monthly_kwh")).first()[0] == pytest.approx(total)
    tou = rollup.monthly_tou_ratios(t.readings(spark, SF))
    s = F.col("tou_ratio_off_peak") + F.col("tou_ratio_mid_peak") + F.col("tou_ratio_on_peak")
    assert tou.where((F.abs(s) < 1e6) & (F.abs(s - 1) > 1e-9) & (s != 0)).isEmpty()


def test_alarm_is_strict_and_null_safe(spark):
    d = spark.createDataFrame([(130.0, 100.0, None, None), (130.1, 100.0, None, None),
                               (None, 1.0, 1.0, 1.0), (151.0, None, None, 100.0)],
                              "p double, prev_month_kwh double, yoy_month_kwh double, ma3_kwh double")
    got = alarm.with_alarms(d, "p", "x").collect()
    assert [r.x_any for r in got] == [False, True, False, True]
    assert [r.x_ma for r in got] == [False, False, False, True]


def test_metrics_mask(spark):
    d = spark.createDataFrame([(100.0, 110.0), (0.0, 5.0), (None, 5.0), (50.0, None), (200.0, 180.0)],
                              "full_month_kwh double, pred_monthly_kwh double")
    r = d.agg(*metrics.regression_aggs()).first()
    assert (r.n, r.mae, r.bias) == (2, 15.0, -5.0)
    assert r.std_error == pytest.approx(15.0) and r.mape_pct == pytest.approx(10.0)


def test_level_shift_and_negative_signal(spark):
    rows = [("drop", dt.datetime(2020, 1 + m, 5, 12), 10.0 if m < 4 else 4.0) for m in range(9)]
    rows += [("flat", dt.datetime(2020, 1 + m, 5, 12), 10.0) for m in range(9)]
    rows += [("neg", dt.datetime(2020, 1, 5, 12), -1.0)]
    d = spark.createDataFrame([(c, "A", x, v) for c, x, v in rows],
                              "customer_id string, contract_type string, ts timestamp_ntz, "
                              "p_active_kwh double")
    got = {r.customer_id: r for r in btm.detect(d).collect()}
    assert (got["drop"].signal_shift, got["flat"].signal_shift) == (1, 0)
    assert (got["neg"].is_btm, got["flat"].is_btm) == (1, 0)
    assert got["drop"].max_drop_pct == pytest.approx(0.6)


@pytest.fixture(scope="module")
def matrix(spark):
    return modelling.stored_features(spark, SF)


def test_model_round_trip_and_floor(spark, matrix):
    f, spec = matrix
    model = models.train(f, spec, rounds=3)
    path = work_dir(spark, "model")
    models.save(model, spec, path)
    again, spec2 = models.load(spark, path)
    assert set(spec2.all) == set(spec.all)
    a = models.predict(model, f, spec)
    assert a.where("pred_monthly_kwh < partial_kwh").isEmpty()
    keys = list(ft.KEYS)
    b = models.predict(again, f, spec).select(*keys, F.col("pred_monthly_kwh").alias("p2"))
    assert a.join(b, keys).where(F.abs(F.col("pred_monthly_kwh") - F.col("p2")) > 1e-9).isEmpty()
    imp = models.importance(model, spec, spark).collect()
    assert sum(r.share_pct for r in imp) == pytest.approx(100) and len(imp) == len(spec.all)
    scored = scoring.score(f, model, spec)
    assert scored.where("est_bill_won is null").isEmpty()
    overall, by_month = studies.weather_sensitivity(f, spec, lambda d: models.predict(model, d, spec))
    assert {r.scenario for r in overall.collect()} == {
        "base", "temp", "rain", "solar", "climatology"}
    assert by_month.select("month").distinct().count() == 12
    # Without a shift the scenario is the model itself; rain and radiation reach the model.
    plain = metrics.evaluate_rows(models.predict(model, f, spec), []).first()
    base = overall.where("scenario = 'base'").first()
    assert base.n == plain.n and base.mape_pct == pytest.approx(plain.mape_pct)
    assert f.where("precip_remainder is not null and solar_remainder is not null").count() > 0


def test_patience_waits_for_a_better_round():
    curve = [9.0, 8.0, 8.0, 8.1, 7.0, 7.5, 7.5, 7.5, 7.5]
    assert models.best_prefix(curve, 1) == (2, True)      # one flat round ends it
    assert models.best_prefix(curve, 3) == (5, True)      # three wait for the fifth
    assert models.best_prefix(curve, 30) == (5, False)    # and more rounds might still matter
    assert models.best_prefix([3.0, 2.0, 1.0], 30) == (3, False)


def test_boosting_keeps_the_best_rounds(spark, matrix):
    f, _ = matrix
    spec = ft.FeatureSpec()
    d = models.prepared(f, spec)
    d = clean.with_suggested_split(d).where("split <> 'test'")
    val, fit = d.where("split = 'val'"), d.where("split = 'train'")
    build = lambda n: models._pipeline(spec, n, 0.5, 3, 0.9)
    model = models.boosted(fit, val, build, 12, patience=2)
    curve = models.error_curve(build(12).fit(fit), val)
    best, turned = models.best_prefix(curve, 2)
    assert models.rounds_of(model) == best and (turned or best == 12 or len(curve) == 12)
    assert models.error_curve(model, val) == pytest.approx(curve[:best])
    path = work_dir(spark, "prefix")
    model.write().save(path)
    from pyspark.ml import PipelineModel

    assert models.rounds_of(PipelineModel.load(path)) == best


def test_few_rounds_are_fitted_once_and_few_rows_in_few_tasks(spark, matrix, monkeypatch):
    fits = []

    class Build:
        def __init__(self, n):
            self.n = n

        def fit(self, rows):
            fits.append(self.n)
            return self.n

    monkeypatch.setattr(models, "error_curve", lambda m, rows: [float(-i) for i in range(m)])
    monkeypatch.setattr(models, "first_rounds", lambda m, n: n)
    f, _ = matrix
    assert models.boosted(f, f, Build, 60, patience=10) == 60 and fits == [60]
    fits.clear()
    assert models.boosted(f, f, Build, 400, patience=30) == 400 and fits == [180, 400]
    parts = models.few_tasks(spark.range(1000).repartition(7))
    assert parts.rdd.getNumPartitions() == 1 and parts.count() == 1000
    monkeypatch.setattr(models, "TASK_ROWS", 1)
    assert models.few_tasks(spark.range(1000).repartition(7)).rdd.getNumPartitions() == 7


def test_every_setting_is_fitted_on_all_training_rows(spark, matrix, monkeypatch):
    f, spec = matrix
    seen, boost = [], models.boosted

    def boosted(rows, *rest):
        seen.append(rows.count())
        return boost(rows, *rest)

    monkeypatch.setattr(models, "boosted", boosted)
    monkeypatch.setattr(modelling, "stored_features", lambda *_: matrix)
    monkeypatch.setattr(modelling, "TRIALS", 2)
    monkeypatch.setattr(modelling, "TRIAL_ROUNDS", 1)
    monkeypatch.setattr(modelling, "TRIAL_ROWS", 5)
    assert modelling.hyper_parameter_search(spark, SF).count() == 2
    split = clean.with_suggested_split(models.prepared(f, spec))
    assert seen == [split.where("split = 'train'").count()] * 2 and seen[0] > 100


def test_flags_of_many_rows_are_computed_once_and_sent_to_the_features(spark, matrix, monkeypatch):
    f, spec = matrix
    plan = lambda d: str(d._jdf.queryExecution().optimizedPlan())
    few = modelling.flags_of(spark, SF, f)
    monkeypatch.setattr(studies, "FEW_ROWS", 0)
    many = modelling.flags_of(spark, SF, f)
    assert "lineitem" not in many.inputFiles()[0] and "Aggregate" in plan(few)
    for name, (d, s) in studies.btm_strategy_variants(f, spec, many).items():
        assert "Aggregate" not in plan(d) and "rightHint=(strategy=broadcast)" in plan(d), name
    variants = [studies.btm_strategy_variants(f, spec, x) for x in (few, many)]
    for name in variants[0]:
        a, b = (v[name][0].select(F.sum(F.xxhash64(*sorted(v[name][0].columns)).cast("decimal(38,0)")))
                .first()[0] for v in variants)
        assert a == b, name


def test_days_after_the_last_horizon_are_not_shuffled(spark):
    parts = rollup.day_parts(t.readings(spark, SF), t.holidays(spark))
    plan = str(rollup.ami_from_parts(parts, (10, 20))._jdf.queryExecution().optimizedPlan())
    assert "<= 20)" in plan
    assert rollup.ami_from_parts(parts, (10, 20)).where("horizon_days = 10").count() == \
        rollup.ami_from_parts(parts, (10,)).count()


def test_inflation_on_complete_rows(spark, matrix):
    f, _ = matrix
    cols = ["partial_kwh", "prev_month_kwh", "ma3_kwh", "days_observed", "month", "customer_mean_history"]
    got = {r.feature: r for r in models.select_features(f, cols, corr_threshold=2.0, min_corr=0.0,
                                                        vif_threshold=1e9).collect()}
    x = f.select(*cols).dropna().toPandas().astype(float)
    for c in cols:
        others = np.column_stack([np.ones(len(x)), x.drop(columns=c)])
        fit = others @ np.linalg.lstsq(others, x[c], rcond=None)[0]
        r2 = 1 - ((x[c] - fit) ** 2).sum() / ((x[c] - x[c].mean()) ** 2).sum()
        assert got[c].vif * (1 - r2) == pytest.approx(1, rel=1e-6)


def test_sliding_models_share_their_rows(spark, matrix):
    daily = rollup.daily_by_customer(t.readings(spark, SF))
    double = {"linear": lambda d, out: d.withColumn(out, baselines.partial_linear()),
              "twice": lambda d, out: d.withColumn(out, 2 * baselines.partial_linear())}
    rows = models.sliding_evaluation(daily, rollup.monthly_by_customer(daily), (1, 15), double)
    got = rows.groupBy("model", "meter_day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pred_monthly_kwh").alias("s")).collect()
    by = {(r.model, r.meter_day): r for r in got}
    assert len(by) == 4
    for m in (1, 15):
        assert by["linear", m].n == by["twice", m].n
        assert by["twice", m].s == pytest.approx(2 * by["linear", m].s)


def test_many_categories_and_honest_split(spark, matrix):
    """Hundreds of labels train, and the months that score a model never fit or stop it."""
    f, spec = matrix
    wide = f.withColumn("region_code", F.concat(F.lit("code"), (F.abs(F.xxhash64(
        "customer_id", "year_month")) % 500).cast("string")))
    model = models.train(wide, spec, rounds=1)
    assert model.stages[-1].getNumTrees == 1
    assert models.category_bins(models.prepared(wide, spec), spec) > 64
    split = clean.with_suggested_split(f)
    last = split.where("split <> 'test'").agg(F.max("year_month")).first()[0]
    assert models.test_rows(f).agg(F.min("year_month")).first()[0] > last


def test_selection_drops_copies(spark, matrix):
    f, _ = matrix
    d = f.withColumns({"copy": F.col("partial_kwh") * 2 + 1, "noise": F.lit(0.5)})
    got = {r.feature: r for r in models.select_features(
        d, ["partial_kwh", "copy", "noise", "month"]).collect()}
    assert sorted(got[c].status for c in ("partial_kwh", "copy")) == ["correlated", "selected"]
    assert got["noise"].status == "cutoff"


def test_correction_recovers_a_linear_residual(spark, matrix):
    f, _ = matrix
    d = f.withColumn("pred_monthly_kwh", baselines.partial_linear())
    rows, cols = models.residual_features(d)
    rows = rows.withColumn("r_target", 3.0 * F.col("r_horizon_days") - F.col("r_month"))
    fitted = models.fit_correction(rows, cols)
    out = models.apply_correction(rows, fitted, cols)
    err = out.agg(F.max(F.abs(F.col("pred_corrected") - F.col("pred_monthly_kwh")
                              - F.col("r_target")))).first()[0]
    assert fitted.first().alpha == 0.01 and err < 0.05


def test_station_weights_are_convex(spark):
    w = modelling.station_weights(spark, SF).where("weight is not null").groupBy("mode").agg(
        F.sum("weight").alias("s"), F.min("weight").alias("m")).collect()
    assert all(r.m >= 0 and (r.s == pytest.approx(1) or r.s == 0) for r in w)
