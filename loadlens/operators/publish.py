"""Verified publishing, result files, serving tables and stage reuse."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from loadlens.functions.scalars import count_if
from loadlens.operators import baselines, horizon as hz, rollup
from loadlens.sources import files

REQUIRED = ("customer_id", "date", "day_kwh", "ts")


class PublishError(RuntimeError):
    """A table failed its checks and was not published."""


def _fingerprint(df: DataFrame, kwh: str) -> list[Column]:
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    total = F.sum(F.col(kwh)) if kwh in df.columns else F.sum(F.lit(0.0))
    return [F.count(F.lit(1)).alias("n_rows"), F.coalesce(total, F.lit(0.0)).alias("total_kwh"),
            F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")
                       ).cast("string").alias("checksum")]


def fingerprint(df: DataFrame, kwh: str = "day_kwh") -> DataFrame:
    """Rows, energy and an order-free checksum, in one pass."""
    return df.agg(*_fingerprint(df, kwh))


def pre_checks(daily: DataFrame) -> list[str]:
    """Reasons not to publish the daily table; one aggregate."""
    missing = [c for c in REQUIRED if c not in daily.columns]
    if missing:
        return [f"missing columns: {missing}"]
    row = daily.agg(
        F.count(F.lit(1)).alias("_n"), F.count("customer_id").alias("_c"),
        (count_if(F.col("day_kwh") < -1000)).alias("_low"),
        *[F.count(c).alias(f"_k_{c}") for c in daily.columns]).first()
    out = []
    if row["_n"] == 0:
        out.append("no rows")
    elif row["_c"] == 0:
        out.append("no customers")
    else:
        if row["_low"] / row["_n"] > 0.5:
            out.append("more than half of the days are below -1000 kWh")
        empty = [c for c in daily.columns if row[f"_k_{c}"] == 0]
        if len(empty) > 3:
            out.append(f"columns without any value: {empty}")
    return out


def publish(spark: SparkSession, tables: dict[str, DataFrame], out: str,
            tolerance_kwh: float = 1.0) -> dict:
    """Write to staging, read back and compare, move into place, then write meta.json.

    Rows, energy and checksum are observed on the source rows while they are written; the
    staged files, and then the published ones, must show the same figures. The status in
    meta.json is OK only when all tables agree.
    """
    meta: dict = {"status": "OK", "tables": {}, "errors": []}
    staging = f"{out}/_staging-{uuid.uuid4().hex}"  # same file system as the target
    for name, df in tables.items():
        seen = Observation(f"publish-{uuid.uuid4().hex}")
        df.observe(seen, *_fingerprint(df, "day_kwh")).write.mode("overwrite").parquet(
            f"{staging}/{name}")
        source = seen.get
        staged = spark.read.parquet(f"{staging}/{name}")
        if name == "daily":
            meta["errors"] += pre_checks(staged)
        missing = set(df.columns) ^ set(staged.columns)
        if missing:
            meta["errors"].append(f"{name}: columns differ: {sorted(missing)}")
        meta["errors"] += _differences(name, "staged", source, staged, tolerance_kwh)
        meta["tables"][name] = {"rows": source["n_rows"], "total_kwh": source["total_kwh"],
                                "checksum": source["checksum"], "columns": staged.columns}
    if not meta["errors"]:
        for name in tables:
            files.rename(spark, f"{staging}/{name}", f"{out}/{name}")
            own = meta["tables"][name]
            meta["errors"] += _differences(name, "published", own | {"n_rows": own["rows"]},
                                           spark.read.parquet(f"{out}/{name}"), tolerance_kwh)
    if meta["errors"]:
        meta["status"] = "FAILED"
    files.write_text(spark, f"{out}/meta.json", json.dumps(meta, ensure_ascii=False, indent=2))
    if meta["errors"]:
        raise PublishError("; ".join(meta["errors"]))
    return meta


def _differences(name: str, where: str, source: dict, df: DataFrame,
                 tolerance_kwh: float) -> list[str]:
    got = fingerprint(df).first()
    same = (got["n_rows"] == source["n_rows"] and got["checksum"] == source["checksum"]
            and abs(got["total_kwh"] - source["total_kwh"]) <= tolerance_kwh)
    return [] if same else [f"{name}: the {where} rows differ from the source rows"]


def self_test(daily: DataFrame) -> DataFrame:
    """Size, range, negative days, and a grade per column by its null rate."""
    cols = daily.columns
    n = F.count(F.lit(1))
    row = daily.agg(
        n.alias("n_rows"), F.countDistinct("customer_id").alias("n_customers"),
        F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        count_if(F.col("day_kwh") < 0).alias("n_negative_days"),
        *[(count_if(F.col(c).isNull()) / n).alias(f"_r_{c}") for c in cols])
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_r_{c}").alias("null_rate"))
                      for c in cols])
    d = row.select("n_rows", "n_customers", "first_day", "last_day", "n_negative_days",
                   F.explode(items).alias("s")).select(
        "n_rows", "n_customers", "first_day", "last_day", "n_negative_days", "s.*")
    r = F.col("null_rate")
    return d.withColumn("grade", F.when(r < 0.1, "OK").when(r < 0.5, "WARN").otherwise("HIGH"))


def save_result(df: DataFrame, out: str, name: str, description: str = "",
                sort_by: str | None = None, csv: bool = True) -> None:
    """Parquet, CSV and metadata of a result table."""
    d = df.orderBy(sort_by) if sort_by else df
    d.write.mode("overwrite").parquet(f"{out}/{name}")
    stored = df.sparkSession.read.parquet(f"{out}/{name}")
    if csv:
        stored.write.mode("overwrite").option("header", True).csv(f"{out}/{name}_csv")
    meta = {"name": name, "description": description, "rows": stored.count(),
            "columns": stored.columns, "dtypes": dict(stored.dtypes)}
    files.write_text(df.sparkSession, f"{out}/{name}_meta.json",
                     json.dumps(meta, ensure_ascii=False, indent=2))


def write_by_month(df: DataFrame, path: str, ts: str = "ts", files_a_month: int = 64) -> None:
    """Readings partitioned by month, clustered by customer inside each file.

    A month is split over ``files_a_month`` tasks by a hash of customer and day, so a large
    month is not one file and a hot customer is not one partition of the table. Choose it as
    the size of a month over the wanted file size.
    """
    d = df.withColumn("ym", F.date_format(ts, "yyyy-MM"))
    d.repartition("ym", F.pmod(F.xxhash64("customer_id", F.to_date(ts)), F.lit(files_a_month))
                  ).sortWithinPartitions("customer_id", ts).write.mode(
        "overwrite").partitionBy("ym").parquet(path)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame],
          resume: bool = True, parameters: dict | None = None) -> DataFrame:
    """A stage result on disk; with ``resume`` a finished one is read, not rebuilt. What the
    result depends on goes into ``parameters``: other values are kept in another folder."""
    if parameters:
        text = json.dumps(parameters, sort_keys=True, default=str)
        path = f"{path}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"
    if not (resume and files.exists(spark, f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def serving_tables(readings: DataFrame) -> dict[str, DataFrame]:
    """Tables behind a customer view: days, running days, months, predictions, context, scores."""
    daily = rollup.daily_by_customer(readings)
    ctx = hz.calendar_context(daily)
    preds = baselines.predict_all(ctx).select("customer_id", "year_month", "horizon_days",
                                              "model", "pred_monthly_kwh")
    return {
        "daily": daily, "daily_cum": rollup.cumulative_in_month(daily),
        "monthly": rollup.monthly_by_customer(daily), "preds": preds, "ctx": ctx,
        "metrics": baselines.evaluate_all(ctx),
        "tou_breakdown": rollup.monthly_tou_ratios(readings),
    }


def write_tables(tables: dict[str, DataFrame], out: str) -> DataFrame:
    """Write each table; returns (table, columns)."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    return spark.createDataFrame([(n, len(d.columns)) for n, d in tables.items()],
                                 "table string, n_columns int")


def write_weather_versions(national: DataFrame, station_month: DataFrame,
                           typical: dict[str, DataFrame], out: str) -> None:
    """All weather products as one table partitioned by version."""
    d = national.unionByName(station_month.withColumn("version", F.lit("station")),
                             allowMissingColumns=True)
    for name, t in typical.items():
        d = d.unionByName(t.drop("year_month").withColumn("version", F.lit(name)),
                          allowMissingColumns=True)
    d.write.mode("overwrite").partitionBy("version").parquet(out)


KEY_RESULTS = ("category", "name", "horizon_days", "n", "mape_pct", "mae", "rmse", "cvrmse_pct",
               "alarm_f1")


def result_summary(parts: dict[str, DataFrame], name_columns: dict[str, str]) -> DataFrame:
    """One long table of results by category; rows without any error measure are dropped."""
    out = None
    for category, df in parts.items():
        d = df.withColumn("category", F.lit(category)).withColumn(
            "name", F.col(name_columns[category]).cast("string"))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    keep = [c for c in KEY_RESULTS if c in out.columns]
    need = [c for c in ("mape_pct", "mae") if c in out.columns]
    return out.select(*keep).na.drop(how="all", subset=need)


def fill_from(metrics_table: DataFrame, other: DataFrame, keys: list[str],
              columns: list[str]) -> DataFrame:
    """Missing metrics taken from a second table with the same keys."""
    o = other.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return metrics_table.join(o, keys, "left").withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).drop(
        *[f"_{c}" for c in columns])


def write_predictions(scored: DataFrame, out: str) -> None:
    """All scored rows, and those with an alarm."""
    scored.write.mode("overwrite").parquet(f"{out}/predictions")
    stored = scored.sparkSession.read.parquet(f"{out}/predictions")
    stored.where("pred_any").write.mode("overwrite").parquet(f"{out}/alarms")


