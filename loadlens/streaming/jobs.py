"""Structured Streaming forms of the roll-ups.

All state is keyed by customer and bounded by the watermark. Results of a batch
are upserted by replacing whole (customer, day) keys, so a replayed batch changes
nothing, and readers see the table before a batch or after it, never in between.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlens.functions import calendar as cal
from loadlens.operators import alarm as al, baselines, horizon as hz, weather as wx
from loadlens.operators.rollup import not_null
from loadlens.session import work_dir
from loadlens.sources import files

X = "p_active_kwh"


def dedup_stream(readings: DataFrame, delay: str = "2 days") -> DataFrame:
    """Drop repeats of (customer, ts) inside the watermark. The first arrival is kept,
    while the batch operator keeps the last one in ingest order."""
    return readings.withWatermark("ts", delay).dropDuplicatesWithinWatermark(
        ["customer_id", "ts"])


def daily_stream(readings: DataFrame, delay: str = "2 days", watermarked: bool = False
                 ) -> DataFrame:
    """Tumbling one-day energy per customer and contract type."""
    d = not_null(readings, "customer_id", "contract_type")
    if not watermarked:
        d = d.withWatermark("ts", delay)
    g = d.groupBy(F.window("ts", "1 day").alias("w"), "customer_id", "contract_type").agg(
        F.sum(X).alias("day_kwh"), F.count(X).alias("n_intervals"))
    return g.select("customer_id", "contract_type", F.to_date("w.start").alias("date"),
                    F.coalesce("day_kwh", F.lit(0.0)).alias("day_kwh"), "n_intervals")


def hourly_load_stream(readings: DataFrame, delay: str = "2 hours", length: str = "1 hour",
                       step: str = "15 minutes") -> DataFrame:
    """Sliding-hour load per contract type."""
    d = readings.withWatermark("ts", delay)
    g = d.groupBy(F.window("ts", length, step).alias("w"), "contract_type").agg(
        F.sum(X).alias("kwh"), F.count(X).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "contract_type", "kwh", "n")


def enrich_stream(readings: DataFrame, info: DataFrame, hourly: DataFrame | None = None
                  ) -> DataFrame:
    """Static joins of customer attributes and station weather onto a stream."""
    d = readings.join(info, "customer_id", "left")
    return d if hourly is None else wx.attach_station_weather(d, hourly)


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything that is available into parquet and return the result."""
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", checkpoint).option("path", sink)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


# --- upserted tables ------------------------------------------------------------------------------

VERSIONS = "versions"   # one small text file per version: month, tab, folder of its rows
KEEP_VERSIONS = 3       # readers of the last versions still find their files


def versions(spark: SparkSession, target: str) -> list[str]:
    """The version files of a table, oldest first; files being written do not count."""
    at = f"{target}/{VERSIONS}"
    return files.list_files(spark, at, (".tsv",)) if files.exists(spark, at) else []


def month_folders(spark: SparkSession, version: str) -> dict[str, str]:
    lines = files.read_text(spark, version).splitlines()
    return dict(line.split("\t", 1) for line in lines if line)


def read_upserted(spark: SparkSession, target: str, version: str | None = None) -> DataFrame:
    """One version of an upserted table, whole: the last one that was committed, or ``version``.

    Months never change under a reader: a batch writes new folders, and the version that names
    them appears by one rename after all of them are complete.
    """
    known = [version] if version else versions(spark, target)
    if not known:
        raise FileNotFoundError(f"{target} has no version yet")
    folders = month_folders(spark, known[-1])
    return spark.read.parquet(*(f"{target}/{f}" for f in folders.values()))


def upsert_days(target: str, keys: tuple[str, ...] = ("customer_id", "contract_type", "date")
                ) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink that replaces the keys of a batch in a table of month folders.

    The months of the batch are merged with their rows of the last version into new folders.
    Then a version file that names the folder of every month is moved into place: the table
    changes at that moment or, if a step before fails, not at all, and a repeated batch gives
    the same rows again. One writer at a time, as a streaming query is.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        side = work_dir(spark, f"batch-{batch_id}")
        batch.withColumn("ym", F.date_format("date", "yyyy-MM")).write.parquet(side)
        b = spark.read.parquet(side)
        months = sorted(r["ym"] for r in b.select("ym").distinct().collect())  # of one batch
        if not months:
            return
        known = versions(spark, target)
        folders = month_folders(spark, known[-1]) if known else {}
        merged, old = b, [folders[m] for m in months if m in folders]
        if old:
            rows = spark.read.parquet(*(f"{target}/{f}" for f in old)).withColumn(
                "ym", F.date_format("date", "yyyy-MM"))
            merged = rows.join(b, list(keys), "left_anti").unionByName(b)
        fresh = f"data/{uuid.uuid4().hex}"
        merged.write.partitionBy("ym").parquet(f"{target}/{fresh}")
        folders |= {m: f"{fresh}/ym={m}" for m in months}
        text = "".join(f"{m}\t{f}\n" for m, f in sorted(folders.items()))
        draft = f"{target}/{VERSIONS}/_{uuid.uuid4().hex}"
        files.write_text(spark, draft, text)
        last = int(known[-1].rsplit("/", 1)[1].split(".")[0]) if known else 0
        files.rename(spark, draft, f"{target}/{VERSIONS}/{last + 1:012d}.tsv")
        forget(spark, target)

    return write


def forget(spark: SparkSession, target: str, keep: int = KEEP_VERSIONS) -> None:
    """Remove versions but the last ``keep``, and month folders that none of those names."""
    known = versions(spark, target)
    needed = {f for v in known[-keep:] for f in month_folders(spark, v).values()}
    for v in known[:-keep]:
        gone = set(month_folders(spark, v).values()) - needed
        files.remove(spark, v)  # the version goes before its folders do
        for f in gone:
            files.remove(spark, f"{target}/{f}")


def run_upsert(stream: DataFrame, target: str, checkpoint: str) -> None:
    q = (stream.writeStream.foreachBatch(upsert_days(target)).outputMode("update")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def month_to_date_alarms(daily: DataFrame, as_of: Column, monthly: DataFrame) -> DataFrame:
    """Alarm candidates of the running month from the days seen so far.

    The month so far is extrapolated by calendar days; the context comes from
    the finished months.
    """
    d = daily.withColumn("year_month", cal.month_start(F.col("date"))).where(
        (F.col("year_month") == F.trunc(as_of, "MM")) & (F.col("date") <= as_of))
    m = d.groupBy("customer_id", "year_month").agg(
        F.sum("day_kwh").alias("partial_kwh"),
        F.countDistinct("date").alias("days_observed"))
    m = m.withColumn("days_in_month", cal.days_in_month(F.col("year_month")))
    m = m.join(hz.lag_lookup(monthly), ["customer_id", "year_month"], "left")
    m = m.withColumn("pred_monthly_kwh", baselines.partial_linear())
    return al.with_alarms(m, "pred_monthly_kwh", "pred")


def read_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet",
                files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))
