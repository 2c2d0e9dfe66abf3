"""Weather, holiday and solar sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlens.functions.joins import small_side
from loadlens.operators import clean
from loadlens.sources import files
from loadlens.sources.readings import read_delimited

# Columns of the observed hourly weather files, in file order.
OBSERVED_COLUMNS = (
    "station_id", "station_name", "ts", "temp_c", "precip_mm", "wind_speed", "wind_dir", "humidity",
    "vapor_pressure", "dewpoint_c", "pressure_local", "pressure_sea", "sunshine_hr", "solar_mj",
    "snow_cm", "cloud_total", "cloud_low", "cloud_type", "cloud_base", "ground_temp_c",
)
TEXT_COLUMNS = ("station_name", "cloud_type")


def read_observed(spark: SparkSession, path: str, start: str | None = None,
                  end: str | None = None) -> DataFrame:
    """Observed hourly weather of a file or folder, optionally of a date range.

    The files have twenty columns whose order, not name, is fixed.
    """
    d = read_delimited(spark, path).toDF(*OBSERVED_COLUMNS)
    d = d.withColumns({
        "ts": F.coalesce(*[F.try_to_timestamp(F.col("ts"), F.lit(f)) for f in (
            "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd H:mm")]).cast("timestamp_ntz"),
        "station_id": F.col("station_id").try_cast("int"),
        **{c: clean.to_number(F.col(c)) for c in OBSERVED_COLUMNS
           if c not in ("station_id", "ts", *TEXT_COLUMNS)},
    })
    return in_range(d, start, end)


def in_range(d: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        d = d.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        d = d.where(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return d


def store_observed(d: DataFrame, path: str) -> None:
    """Parquet by station: station and date filters then prune files and row groups."""
    d.repartition("station_id").sortWithinPartitions("ts").write.mode("overwrite").partitionBy(
        "station_id").parquet(path)


# Position, name and missing-value mark of the fields of the two layouts.
SHORT_LAYOUT = (
    (6, "temp_c", 99.9), (7, "dewpoint_c", 99.9), (8, "rh_pct", 999.0), (9, "pressure_pa", 999999.0),
    (13, "ghi_whm2", 9999.0), (14, "dni_whm2", 9999.0), (15, "dhi_whm2", 9999.0),
    (18, "wind_dir_deg", 999.0), (19, "wind_speed_ms", 999.0), (20, "total_sky_cover", 99.0),
    (21, "opaque_sky_cover", 99.0),
)
LONG_LAYOUT = (
    (6, "temp_c", 99.9), (7, "dewpoint_c", 99.9), (8, "rh_pct", 999.0), (9, "pressure_pa", 999999.0),
    (13, "ghi_whm2", 9999.0), (14, "dni_whm2", 9999.0), (15, "dhi_whm2", 9999.0),
    (20, "wind_dir_deg", 999.0), (21, "wind_speed_ms", 999.0), (22, "total_sky_cover", 99.0),
    (23, "opaque_sky_cover", 99.0), (33, "precip_mm", 999.0),
)


def _field(parts: Column, name: str) -> Column:
    def value(layout) -> Column:
        for i, n, missing in layout:
            if n == name:
                v = F.get(parts, F.lit(i)).try_cast("double")
                return F.when(v < missing, v)
        return F.lit(None).cast("double")

    return F.when(F.size(parts) >= 34, value(LONG_LAYOUT)).otherwise(value(SHORT_LAYOUT))


def read_epw(spark: SparkSession, path: str, stations: set[str] | None = None,
             glob: str = "*.epw") -> tuple[DataFrame, DataFrame]:
    """(stations, hourly series) of typical-year weather text files.

    Each file's LOCATION line names its station; data lines join it on the file. Files are
    those below ``path`` whose name matches ``glob``.
    """
    raw = spark.read.text(path, pathGlobFilter=glob, recursiveFileLookup=True).select(
        "value", F.col("_metadata.file_path").alias("file"))
    parts = F.split("value", ",")
    head = raw.where(F.col("value").startswith("LOCATION")).withColumn("_p", parts)

    def text(i: int) -> Column:
        return F.trim(F.get("_p", F.lit(i)))

    meta = head.select(
        "file", text(4).alias("station_id"), text(1).alias("station_name"),
        text(2).alias("country"), text(3).alias("source"), text(5).try_cast("double").alias("lat"),
        text(6).try_cast("double").alias("lon"), text(7).try_cast("double").alias("tz_hours"),
        text(8).try_cast("double").alias("elevation_m"))
    if stations is not None:
        meta = meta.where(F.col("station_id").isin(*sorted(stations)))
    rows = raw.where(F.col("value").rlike(r"^\d{4},\d{1,2},\d{1,2},\d{1,2},")).withColumn("_p", parts)
    rows = rows.where(F.size("_p") >= 22)
    date = F.concat_ws("-", text(0), F.lpad(text(1), 2, "0"), F.lpad(text(2), 2, "0"))
    ts = (F.try_to_date(date, "yyyy-MM-dd").cast("timestamp_ntz")
          + F.make_dt_interval(hours=text(3).try_cast("int") - 1))
    names = [n for _, n, _ in LONG_LAYOUT]
    d = rows.select("file", ts.alias("ts"), *[_field(F.col("_p"), n).alias(n) for n in names])
    series = d.join(small_side(meta.select("file", "station_id", "station_name", "lat", "lon")),
                    "file").drop("file")
    return meta, series


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """Holiday calendar with date, name and category; other columns are kept."""
    d = read_delimited(spark, path)
    first = d.columns[0]
    d = d.withColumn("date", F.to_date(F.try_to_timestamp(F.col(first))))
    if "category" not in d.columns:
        d = d.withColumn("category", F.lit(None).cast("string"))
    return d.where(F.col("date").isNotNull())


def read_typical(spark: SparkSession, path: str) -> DataFrame:
    """Typical-year hourly table kept as text."""
    d = read_delimited(spark, path)
    return d.select(
        F.col("station_id").try_cast("int").alias("station_id"),
        F.try_to_timestamp("ts").cast("timestamp_ntz").alias("ts"),
        *[clean.to_number(F.col(c)).alias(c) for c in ("temp_c", "rh_pct", "wind_speed_ms",
                                                       "ghi_whm2")])


def read_solar(spark: SparkSession, path: str) -> DataFrame:
    """Hourly national solar output; an hour-ending clock is shifted to hour-beginning.

    The clock is judged by the hours as written: 24:00 is the next day's midnight once it is
    a time stamp, and would look like an hour 0.
    """
    d = read_delimited(spark, path)
    d = d.select(clean.compose_ts(F.substring("datetime", 1, 10), F.substring("datetime", 12, 5))
                 .alias("ts"), F.substring("datetime", 12, 2).try_cast("int").alias("_hour"),
                 *[clean.to_number(F.col(c)).alias(c) for c in d.columns if c.endswith("_mw")])
    ending = d.agg((F.min("_hour") >= 1).alias("_ending"))  # one row
    hour = F.make_dt_interval(hours=F.lit(1))
    return d.join(F.broadcast(ending)).withColumn(
        "ts", F.when(F.col("_ending"), F.col("ts") - hour).otherwise(F.col("ts"))).drop(
        "_hour", "_ending")


def read_station_folder(spark: SparkSession, path: str) -> DataFrame:
    """Monthly station files (station_<id>.csv) as one table with a station column."""
    out = None
    found: dict[str, str] = {}
    for f in files.list_files(spark, path, (".csv",)):
        own = [n for n in f.split("/") if n.startswith("station_") and n.endswith(".csv")]
        if own:  # a file, or a folder of parts
            found[own[-1]] = f[:f.rindex(own[-1]) + len(own[-1])]
    for name, f in sorted(found.items()):
        d = read_delimited(spark, f)
        d = d.select(F.lit(int(name[8:-4])).alias("station_id"),
                     F.to_date(F.concat(F.substring("year_month", 1, 7), F.lit("-01")))
                     .alias("year_month"),
                     *[clean.to_number(F.col(c)).alias(c) for c in d.columns
                       if c not in ("station_id", "year_month", "station_name")])
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no station files in {path}")
    return out
