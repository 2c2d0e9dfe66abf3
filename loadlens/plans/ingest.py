"""Large export to verified tables: one lineage from raw text to four aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadlens import schema
from loadlens.operators import btm, publish, rollup, weather as wx
from loadlens.sources import readings as src


def usable(readings: DataFrame) -> DataFrame:
    """Rows with a customer, a time stamp and a number."""
    return readings.where(F.col("customer_id").isNotNull() & F.col("ts").isNotNull()
                          & F.col("p_active_kwh").isNotNull())


def ingest_tables(readings: DataFrame, hourly: DataFrame | None = None,
                  override: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Daily, load-shape, generation-signal and customer tables of standard readings."""
    d = schema.ensure_columns(usable(readings), ("p_apparent_kwh",))
    for c in ("p_reactive_lag", "p_reactive_lead"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(0.0))
    d = d.withColumn("p_apparent_kwh", F.coalesce("p_apparent_kwh", F.lit(0.0)))
    if hourly is not None:
        region = "region_code" if "region_code" in d.columns else None
        station = (F.coalesce(wx.match_station(F.col(region), override),
                              F.lit(wx.DEFAULT_STATION)) if region
                   else F.lit(wx.DEFAULT_STATION))
        d = wx.attach_station_weather(d.withColumn("station_id", station), hourly,
                                      columns=("temp_c",)).drop("station_id")
    daily = rollup.daily_ingest(d)
    daily = daily.withColumns({"ts": F.col("date").cast("timestamp_ntz"),
                               "p_active_kwh": F.col("day_kwh")})
    seq = "ingest_seq" if "ingest_seq" in d.columns else "ts"
    return {
        "daily": daily,
        "ami_features": rollup.ami_monthly(d),
        "btm_signals": btm.ingest_signals(d),
        "customer_info": rollup.customer_attributes(d, seq),
    }


def run(spark: SparkSession, cfg: src.SourceConfig, out: str,
        hourly: DataFrame | None = None) -> dict:
    """Read, aggregate, verify and publish; returns the manifest."""
    readings = src.load(spark, cfg)
    return publish.publish(spark, ingest_tables(readings, hourly, cfg.region_station_override),
                           out)
