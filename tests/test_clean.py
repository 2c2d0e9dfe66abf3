"""Cleaning operators on small frames with every edge."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadlens import schema
from loadlens.functions.chunks import with_chunk, with_previous
from loadlens.operators import clean, profile

T0 = dt.datetime(2024, 1, 30, 22, 0)


def frame(spark, series: dict[str, list]):
    data = [(c, T0 + dt.timedelta(minutes=15 * i), "주택용", None if v is None else float(v), i)
            for c, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(
        data, "customer_id string, ts timestamp_ntz, contract_type string, p_active_kwh double, "
        "ingest_seq int")


def values(df, cid):
    return [r.p_active_kwh for r in df.where(F.col("customer_id") == cid).orderBy("ts").collect()]


@pytest.mark.parametrize("text,want", [
    (("2024-02-29", "0:00"), "2024-02-29 00:00:00"), (("20240229", "9:15"), "2024-02-29 09:15:00"),
    (("2024/02/29", "24:00"), "2024-03-01 00:00:00"), (("2023-12-31", "2400"), "2024-01-01 00:00:00"),
    (("2024-01-01", "15"), "2024-01-01 00:15:00"), (("2024-01-01 00:00:00", "930"), "2024-01-01 09:30:00"),
    (("2024-01-01", "abc"), None), (("2024-01-01", None), None), (("2024-13-01", "1:00"), None),
    (("2024-01-01", "25:00"), None), (("2024-01-01", "12:34:56"), "2024-01-01 12:34:56"),
    (("2024-01-01", "24:30"), None)])
def test_compose_ts(spark, text, want):
    d = spark.createDataFrame([text], "d string, t string")
    got = d.select(clean.compose_ts(F.col("d"), F.col("t")).cast("string").alias("ts")).first().ts
    assert got == want


def test_dedup_keeps_last(spark):
    d = frame(spark, {"a": [1, 2]}).withColumn("ts", F.lit(T0).cast("timestamp_ntz"))
    out = clean.remove_duplicates(d).collect()
    assert [(r.p_active_kwh, r.ingest_seq) for r in out] == [(2.0, 1)]


@pytest.mark.parametrize("limit", [1, 2, 3, 24])
def test_interpolation_matches_pandas_across_days(spark, limit):
    n = None
    series = {"a": [n, n, 1, n, n, n, 5, n, 7, 8, n, n, n, n, 3, n, n],
              "b": [n] * 5, "c": [2], "d": [4, 4, n, 4]}
    out = clean.interpolate(frame(spark, series), limit=limit)
    for cid, vs in series.items():
        want = pd.Series([np.nan if v is None else float(v) for v in vs]).interpolate(
            method="linear", limit=limit)
        got = [np.nan if v is None else v for v in values(out, cid)]
        np.testing.assert_allclose(got, want.to_numpy(), equal_nan=True)


def test_neighbours_of_long_series_are_read_once(spark):
    """No frame starts at its row: such a frame is read to its end again for every row."""
    d = clean.interpolate(frame(spark, {"a": [1, None, 3]}))
    plan = d._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "window" in plan and "unboundedfollowing" not in plan


def test_forward_fill_and_simple_methods(spark):
    d = frame(spark, {"a": [None, 1, None, None, 2, None] + [None] * 6})
    assert values(clean.handle_missing(d, "ffill"), "a") == [None, 1, 1, 1, 2, 2] + [2] * 6
    assert values(clean.handle_missing(d, "drop"), "a") == [1, 2]
    assert values(clean.handle_missing(d, "zero"), "a")[0] == 0.0
    with pytest.raises(ValueError):
        clean.handle_missing(d, "guess")


def test_previous_row_across_chunks(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 300).astype(str),
                        "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(
                            rng.permutation(300) * 47, unit="min"),
                        "v": np.where(rng.random(300) < 0.2, np.nan, rng.random(300))})
    d = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn(
        "v", F.when(~F.isnan("v"), F.col("v")))
    got = with_previous(d, ["k"], ["ts"], {"v": "p"}).toPandas().sort_values(["k", "ts"])
    pdf = pdf.sort_values(["k", "ts"])
    want = pdf.groupby("k")["v"].shift(1).to_numpy()
    np.testing.assert_allclose(got["p"].astype(float).to_numpy(), want, equal_nan=True)
    assert (~got["_has_prev"]).sum() == 3


def test_outliers(spark):
    flat = [5.0] * 20
    d = frame(spark, {"flat": flat, "spike": [1.0, 2.0] * 20 + [500.0], "one": [3.0],
                      "gap": [1.0, None, 1.0, 100.0, 1.0]})
    assert values(clean.remove_outliers(d, "iqr"), "spike") == [1.0, 2.0] * 20
    assert values(clean.remove_outliers(d, "zscore"), "flat") == flat
    assert values(clean.remove_outliers(d, "zscore"), "one") == []
    assert values(clean.remove_outliers(d, "zscore"), "spike") == [1.0, 2.0] * 20
    assert values(clean.remove_outliers(d, "jump"), "gap") == [1.0, 1.0]
    assert len(values(clean.remove_outliers(d, "quantile"), "flat")) == 20


def test_gap_filling_and_step_log_add_up(spark):
    d = frame(spark, {"a": [1, 2, None, 4] * 6, "b": [None] * 4})
    d = d.where("ingest_seq <> 5").unionByName(d.where("ingest_seq = 3"))
    filled = clean.fill_time_gaps(clean.remove_duplicates(d))
    assert filled.where("customer_id = 'a'").count() == 24
    marked = clean.preprocess_marked(d)
    log = {r.step: r.removed for r in clean.step_log(marked).collect()}
    n = clean.cleaned(marked).count()
    assert log["original_rows"] == d.count() and log["final_rows"] == n
    assert log["original_rows"] - log["remove_duplicates"] - log["remove_outliers"] - \
        log["final_drop_na"] == n
    assert log["remove_duplicates"] == 2
    assert clean.preprocess_marked(d, missing_method="drop").where("_dropped").count() > 0


def test_cleaning_shuffles_the_readings_once(spark, monkeypatch):
    plans, write = {}, clean.write_and_read

    def written(df, purpose, **kw):
        plans[purpose] = str(df._jdf.queryExecution().optimizedPlan())
        return write(df, purpose, **kw)

    monkeypatch.setattr(clean, "write_and_read", written)
    d = frame(spark, {"a": [1, 2, None, 4] * 6, "b": [None, 3, 900] + [3] * 30})
    d = d.unionByName(d.where("ingest_seq = 3").withColumn("ingest_seq", F.lit(99)))
    marked = clean.preprocess_marked(d, keep_seq=False)
    # Copies go once, though filling reads the rows twice, and the ingest order goes with them.
    assert sum(p.count("RepartitionByExpression") for p in plans.values()) == 1
    assert "ingest_seq" not in plans["filled"] and "ingest_seq" not in marked.columns
    whole = clean.preprocess_marked(d)
    assert sorted(map(str, whole.drop("ingest_seq").collect())) == sorted(
        map(str, marked.select(*[c for c in whole.columns if c != "ingest_seq"]).collect()))
    assert not marked.where("p_active_kwh = 900 and _keep").count()
    # The bounds, a row per customer, go to the readings and not the readings to them.
    assert "rightHint=(strategy=broadcast)" in str(marked._jdf.queryExecution().optimizedPlan())
    assert with_chunk(d).select("_chunk").distinct().count() == 1  # one month, two days


@pytest.mark.parametrize("days", [0, 1])
def test_look_back_crosses_months(spark, days):
    """The rows begin two hours before midnight, with ``days`` the last of the month."""
    vs = [None, 4, None, None, 7, None, None, None, None, None, None, 14, None, 3] + [None] * 12 + [1]
    d = frame(spark, {"a": vs}).withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(days)))
    assert with_chunk(d).select("_chunk").distinct().count() == 1 + days
    want = pd.Series([np.nan if v is None else float(v) for v in vs])
    np.testing.assert_allclose(
        [np.nan if v is None else v for v in values(clean.interpolate(d, limit=9), "a")],
        want.interpolate(method="linear", limit=9).to_numpy(), equal_nan=True)
    prev = with_previous(d, ["customer_id"], ["ts"], {"p_active_kwh": "p"}).orderBy("ts").collect()
    assert [r.p for r in prev] == [None, *map(lambda v: v if v is None else float(v), vs[:-1])]
    assert [r._has_prev for r in prev] == [False] + [True] * (len(vs) - 1)


def test_last_copy_is_one_row_also_where_the_order_is_unknown(spark):
    d = spark.sql("""SELECT * FROM VALUES ('a', 1D, 2), ('a', 9D, 1), ('b', 5D, NULL), ('b', NULL, 3),
                     ('c', 7D, NULL) AS t(customer_id, p_active_kwh, ingest_seq)""").withColumn(
        "ts", F.lit(T0).cast("timestamp_ntz"))
    assert {r.customer_id: (r.p_active_kwh, r.ingest_seq) for r in clean.remove_duplicates(d).collect()} == {
        "a": (1.0, 2), "b": (None, 3), "c": (None, None)}


@pytest.mark.parametrize("hours,want", [([1, 24], [0, 23]), ([0, 5], [0, 5])])
def test_hour_ending_clock(spark, hours, want):
    base = dt.datetime(2024, 1, 1)
    # An hour-ending 24:00 is parsed as 00:00 of the next day, so the table shows 1..23.
    hs = [h for h in hours if h < 24]
    d = spark.createDataFrame([(base + dt.timedelta(hours=h),) for h in hs], "ts timestamp_ntz")
    got = sorted(r.h for r in clean.hour_ending_to_beginning(d).select(
        F.hour("ts").alias("h")).collect())
    assert got == want[: len(hs)]


@pytest.mark.parametrize("raw,want", [
    ("주택", "주택용"), (" 주택용[고압] ", "주택용(고압)"), ("일반용_갑1", "일반용(갑)I"),
    ("일반용(갑)Ⅱ", "일반용(갑)II"), ("일반용【을】", "일반용(을)"), ("일반용-(을) 고압A", "일반용(을)고압A"),
    ("일반용 을 저압", "일반용(을)저압"), ("산업용 {병}", "산업용 (병)"), (None, None)])
def test_contract_normalization(spark, raw, want):
    d = spark.createDataFrame([(raw,)], "c string")
    assert d.select(schema.normalize_contract_type(F.col("c")).alias("n")).first().n == want


def test_validation(spark):
    d = frame(spark, {"a": [1, -2]})
    assert schema.validate(d, strict=False).first().n_negative == 1
    with pytest.raises(Exception, match="negative"):
        schema.validate(d).collect()
    with pytest.raises(schema.SchemaError):
        schema.validate(d.drop("ts"))
    with pytest.raises(schema.SchemaError):
        schema.validate(d.withColumn("ts", F.lit("x")))
    wide = schema.ensure_columns(d)
    assert dict(wide.dtypes)["max_demand_kw"] == "double"


def test_export_number(spark):
    d = spark.createDataFrame([(1.23456789,), (float("inf"),), (float("nan"),)], "x double")
    assert [r.y for r in d.select(clean.export_number(F.col("x")).alias("y")).collect()] == [
        1.234568, None, None]


def test_split_suggestions(spark):
    def months(n):
        d = spark.createDataFrame([(i,) for i in range(n)], "i int")
        return d.select(F.add_months(F.lit("2020-01-01").cast("date"), F.col("i")).alias("year_month"),
                        F.lit("c").alias("customer_id"))

    for n, train, val in ((36, "2021-06-01", "2021-12-01"), (24, "2020-12-01", None),
                          (12, "2020-08-01", None)):
        r = clean.suggest_split(months(n)).first()
        assert (str(r.train_end), r.val_end and str(r.val_end)) == (train, val)
    checks = {r.check_name: r.value for r in clean.leakage_report(
        clean.with_suggested_split(months(36))).collect()}
    assert checks == {"overlapping_months": 0, "time_inversion": 0, "cold_start_customers": 0}


def test_rows_of_a_task_do_not_grow_with_its_split(spark):
    d = spark.range(0, 400, 1, 1).selectExpr(
        "concat('c', id % 3) AS customer_id", "timestamp_ntz'1998-01-01' + make_dt_interval(id % 40) AS ts",
        "double(id) AS p_active_kwh", "double(id % 5) AS p_reactive_kwh", "id AS ingest_seq")
    once, stable = clean.remove_duplicates(d), profile.partial_month_stability(d, min_n=1)
    for df in (once, stable):
        assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()
    # The last of each key, whatever share its copies were dealt to.
    want = {(r.customer_id, r.ts): r.ingest_seq for r in d.orderBy("ingest_seq").collect()}
    assert {(r.customer_id, r.ts): r.ingest_seq for r in once.collect()} == want
    # The readings are aggregated to days once.
    assert str(stable._jdf.queryExecution().optimizedPlan()).count("Range (0, 400") == 1
    assert {(r.n_days, r.metric): r.n for r in stable.collect()} == {
        (n, m): 6 for n in (10, 15, 20) for m in ("power_factor", "peak_ratio", "daily_cv")}
