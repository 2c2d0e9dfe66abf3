"""Quantiles, calendar rules and small solves."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from loadlens.functions import calendar as cal
from loadlens.functions.linear import (Moments, non_negative_solve, pair_moments, ridge_solve, solve,
                                       vif_of)
from loadlens.functions.quantiles import exact_quantiles
from loadlens.functions.scalars import safe_corr, sample_skew
from loadlens.operators import calendar_days

PROBS = {"q0": 0.0, "q001": 0.001, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q1": 1.0}


def check_quantiles(spark, data: dict[str, list[float]], accuracy=10_000):
    d = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs],
                              "k string, v double")
    for small in (0, 1 << 40):  # by brackets, and by value counts at once
        found = exact_quantiles(d, ["k"], "v", PROBS, accuracy, small).collect()
        got = {r.k: r for r in found}
        assert len(found) == len(data)
        for k, vs in data.items():
            for name, p in PROBS.items():
                assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_quantiles_of_small_groups(spark, vs):
    check_quantiles(spark, {"a": vs, "b": [v / 3 for v in vs]})


@pytest.mark.parametrize("kind", ["uniform", "lognormal", "ties"])
def test_quantiles_with_brackets(spark, kind):
    """Groups above the accuracy go through brackets; one group holds most rows."""
    rng = np.random.default_rng(1)
    make = {"uniform": lambda n: rng.random(n), "lognormal": lambda n: rng.lognormal(0, 3, n),
            "ties": lambda n: rng.integers(0, 7, n).astype(float)}[kind]
    check_quantiles(spark, {"hot": make(30_000).tolist(), "mid": make(2_500).tolist(),
                            "cold": make(3).tolist()}, accuracy=1000)


def test_quantiles_without_keys_skip_nulls(spark):
    d = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert exact_quantiles(d, [], "v", {"m": 0.5}).first().m == 2.0
    assert exact_quantiles(d, [], "v", {"m": 0.5}, small=0).first().m == 2.0


def test_skew_and_correlation(spark):
    d = spark.createDataFrame([(1.0, 1.0), (2.0, None), (4.0, 3.0), (9.0, 4.0)], "a double, b double")
    r = d.agg(sample_skew(F.col("a")).alias("s"), safe_corr(F.col("a"), F.col("b")).alias("c"),
              safe_corr(F.lit(1.0), F.col("b")).alias("z")).first()
    assert r.s == pytest.approx(pd.Series([1, 2, 4, 9]).skew())
    assert r.c == pytest.approx(pd.Series([1, 4, 9]).corr(pd.Series([1, 3, 4])))
    assert r.z is None


@pytest.mark.parametrize("day,want", [
    ("2024-07-06", {"off_peak": 10, "mid_peak": 14}), ("2024-07-07", {"off_peak": 24}),
    ("2024-07-08", {"off_peak": 10, "mid_peak": 8, "on_peak": 6}),
    ("2024-01-08", {"off_peak": 10, "mid_peak": 8, "on_peak": 6})])
def test_tou_hours_of_a_day(spark, day, want):
    d = spark.range(24).select((F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(
        hours=F.col("id").cast("int"))).alias("ts"))
    got = {r.p: r["count"] for r in d.groupBy(cal.tou_with_day_rules(F.col("ts")).alias("p")
                                              ).count().collect()}
    assert got == want
    same = d.where(cal.tou_period(F.col("ts")) != cal.classify_tou(
        F.hour("ts"), cal.season(F.month("ts")))).count()
    assert same == 0


@pytest.mark.parametrize("date,md,want", [
    ("2024-03-14", 15, "2024-02-15"), ("2024-03-15", 15, "2024-03-15"),
    ("2024-03-30", 31, "2024-02-29"), ("2024-03-31", 31, "2024-03-31"),
    ("2024-01-10", 20, "2023-12-20"), ("2023-02-28", 30, "2023-02-28"), ("2024-05-01", 1, "2024-05-01")])
def test_billing_start(spark, date, md, want):
    d = spark.createDataFrame([(dt.date.fromisoformat(date), md)], "d date, md int")
    assert str(d.select(cal.billing_start(F.col("d"), F.col("md")).alias("s")).first().s) == want


def test_special_days_against_a_plain_loop(spark):
    hol = {dt.date(2024, 2, 9), dt.date(2024, 2, 12), dt.date(2024, 3, 1), dt.date(2024, 5, 1),
           dt.date(2024, 5, 3), dt.date(2024, 4, 30)}
    h = spark.createDataFrame([(d, "x", "substitute") for d in sorted(hol)],
                              "date date, name string, category string")
    months = spark.createDataFrame([(dt.date(2024, m, 1),) for m in range(1, 7)], "year_month date")
    got = {r.year_month: r for r in calendar_days.special_day_features(months, h).collect()}

    def off(d):
        return d in hol or d.weekday() >= 5

    one = dt.timedelta(days=1)
    for m in range(1, 7):
        days = [dt.date(2024, m, 1) + i * one for i in range(31)]
        days = [d for d in days if d.month == m]
        bridge = [d for d in days if not off(d) and off(d - one) and off(d + one)]
        near = [d for d in days if not off(d) and d not in bridge and (d - one in hol or d + one in hol)]
        long, run = 0, 0
        for d in [*days, None]:
            if d is not None and off(d):
                run += 1
            else:
                long, run = long + (run if run >= 3 else 0), 0
        r = got[dt.date(2024, m, 1)]
        assert (r.n_days, r.n_bridge, r.n_holiday_adjacent, r.n_long_weekend_days) == (
            len(days), len(bridge), len(near), long)
        assert r.n_workday + r.n_monday + r.n_saturday + r.n_sunday + r.n_holiday + r.n_bridge == r.n_days


def sample(n=400, p=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1, 5, 0.1, 2] + [0, 100, -3, 7]
    y = x @ [1.0, -2.0, 30.0, 0.0] + rng.normal(size=n)
    return x, y


def moments_of(spark, x, y, fn, schema):
    cols = [f"x{i}" for i in range(x.shape[1])] + ["y"]
    d = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=cols))
    return solve(pair_moments(d.repartition(5), cols), cols, fn, schema).toPandas(), cols


def test_moments_give_correlation_and_vif(spark):
    x, y = sample()
    x[:, 3] = x[:, 0] + 0.1 * x[:, 3]

    def fn(_, m: Moments):
        return pd.DataFrame({"c": m.corr().ravel()})

    got, _ = moments_of(spark, x, y, fn, "c double")
    np.testing.assert_allclose(got.c.to_numpy().reshape(5, 5),
                               np.corrcoef(np.column_stack([x, y]).T), atol=1e-9)
    want = []
    xc = x - x.mean(0)
    for i in range(4):
        o = [j for j in range(4) if j != i]
        res = xc[:, i] - xc[:, o] @ np.linalg.lstsq(xc[:, o], xc[:, i], rcond=None)[0]
        want.append((xc[:, i] ** 2).sum() / (res**2).sum())
    np.testing.assert_allclose(vif_of(np.cov(x.T)), want, rtol=1e-6)


def test_ridge_from_moments(spark):
    x, y = sample()
    mean, scale = x.mean(0), x.std(0)

    def fn(_, m: Moments):
        w, b = ridge_solve(m, [f"x{i}" for i in range(4)], "y", 5.0, mean, scale)
        return pd.DataFrame({"w": [*w, b]})

    got, _ = moments_of(spark, x, y, fn, "w double")
    z = (x - mean) / scale
    want = np.linalg.solve(z.T @ z + 5.0 * np.eye(4), z.T @ (y - y.mean()))
    np.testing.assert_allclose(got.w, [*want, y.mean()], rtol=1e-8)


def test_non_negative_solve():
    rng = np.random.default_rng(2)
    for _ in range(10):
        x = rng.random((40, 5))
        y = x @ rng.normal(size=5)
        b = non_negative_solve(x.T @ x, x.T @ y)
        grad = x.T @ (x @ b - y)
        assert (b >= 0).all() and (grad[b == 0] >= -1e-7).all()
        np.testing.assert_allclose(grad[b > 0], 0, atol=1e-7)


def test_quantiles_of_many_distinct_values_without_keys(spark):
    """A million distinct values in one group: right ranks, and no task orders a whole bracket."""
    from loadlens.functions.quantiles import exact_quantiles

    n = 1_000_000
    d = spark.range(n).select((F.col("id") * 7919 % n / 8.0).alias("v"))
    probs = {"p01": 0.01, "p50": 0.5, "p99": 0.99, "lo": 0.0, "hi": 1.0}
    row = exact_quantiles(d, [], "v", probs, small=0).first()
    for name, p in probs.items():
        assert abs(row[name] - p * (n - 1) / 8.0) < 1e-6
