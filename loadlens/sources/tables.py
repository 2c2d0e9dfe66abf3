"""Readings, weather and dimensions shaped from a warehouse of orders and events.

A utility rarely hands over meter data in the standard shape. These views map a
star schema (lineitem/supplier/nation/region, orders, events) onto the standard
reading, weather and customer tables that every operator expects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlens.functions import calendar as cal
from loadlens.functions.joins import small_side, spread

# Contract type and branch name by nation key modulo, stations by key modulo.
CONTRACT_BY_NATION = ("주택용", "주택용(고압)", "일반용(갑)I", "일반용(갑)II", "일반용(을)")
BRANCH_BY_NATION = ("서울본부", "남서울본부", "인천본부", "경기북부", "강원 본부", "대전충남",
                    "부산울산", "해외지사")
STATIONS = (108, 112, 119, 114, 133, 143, 156, 159)
TYPICAL_STATIONS = (108, 112, 119, 101, 133, 143, 156, 159)
REGION_STATION = {"AFRICA": 108, "AMERICA": 112, "ASIA": 119, "EUROPE": 133}
DEFAULT_STATION = 108


# Declared schemas spare the file-footer job that inference would start per read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, index: Column) -> Column:
    """The index-th entry of a fixed list (0-based)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def customer_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer. Nation and region are fixed lookups of 25 and 5 rows."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("r_name").alias("region_code"))
    key = F.col("s_nationkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            "s_suppkey",
            F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
            .alias("customer_id"),
            pick(CONTRACT_BY_NATION, key % 5).alias("contract_type"),
            (50.0 + 50.0 * (key % 4)).alias("contract_power_kw"),
            "region_code",
            pick(BRANCH_BY_NATION, key % 8).alias("region_sub"),
        )
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with nulls, negatives and repeated (customer, ts) rows, 1995-2001."""
    li = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    info = customer_info(spark, sf_dir)
    slot = F.col("l_orderkey") % 96
    qty = F.col("l_quantity")
    hour = F.floor(slot / 4)
    backfeed = ((F.col("l_suppkey") % 10 == 0) & hour.between(10, 14)
                & (F.col("l_linenumber") == 1))
    info = small_side(info, measure=table(spark, sf_dir, "supplier"))
    return li.join(info, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "customer_id",
        (F.col("l_shipdate") + F.make_dt_interval(mins=(slot * 15).cast("int"))).alias("ts"),
        "contract_type",
        F.when(F.col("l_orderkey") % 53 == 0, None).when(backfeed, -qty).otherwise(qty)
        .alias("p_active_kwh"),
        (qty * F.col("l_tax")).alias("p_reactive_lag"),
        (qty * F.col("l_discount")).alias("p_reactive_lead"),
        (qty * F.col("l_tax") + qty * F.col("l_discount")).alias("p_reactive_kwh"),
        (qty * 1.25).alias("p_apparent_kwh"),
        (qty * 5.0).alias("max_demand_kw"),
        "contract_power_kw",
        "region_code",
        "region_sub",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax").alias("ingest_seq"),
    )


def readings_hf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense readings of one month, on a 15-minute grid, from the event log."""
    return shape_events(table(spark, sf_dir, "events"))


def shape_events(events: DataFrame) -> DataFrame:
    """Events, at rest or streaming, as standard readings."""
    user = F.col("user_id")
    return events.select(
        F.concat(F.lit("U"), user.cast("string")).alias("customer_id"),
        cal.floor_minutes(F.col("ts"), 15).alias("ts"),
        pick(CONTRACT_BY_NATION, user % 5).alias("contract_type"),
        F.col("value").alias("p_active_kwh"),
        (F.col("value") * ((F.col("event_id") % 10) / 10.0)).alias("p_reactive_kwh"),
        (F.col("value") * 4.8).alias("max_demand_kw"),
        F.col("event_id").alias("ingest_seq"),
    )


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station-hour weather over the span of the readings, one row per station and hour."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    key = F.col("o_orderkey")
    hour = (key % 24).cast("int")
    raw = o.select(
        pick(STATIONS, F.col("o_custkey") % 8).alias("station_id"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=hour)).alias("ts"),
        F.when(key % 97 == 0, None).otherwise((key % 450) / 10.0 - 10.0).alias("temp_c"),
        (40.0 + F.col("o_custkey") % 50).alias("humidity"),
        ((key % 12) / 2.0).alias("wind_speed"),
        F.when(hour.between(7, 18), (key % 30) / 10.0).otherwise(0.0).alias("solar_mj"),
        F.when(key % 7 == 0, 1.5).otherwise(0.0).alias("precip_mm"),
    )
    return raw.groupBy("station_id", "ts").agg(
        F.avg("temp_c").alias("temp_c"),
        F.avg("humidity").alias("humidity"),
        F.avg("wind_speed").alias("wind_speed"),
        F.avg("solar_mj").alias("solar_mj"),
        F.max("precip_mm").alias("precip_mm"),
    )


def typical_year_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typical-year series per station: the event log read as hourly weather of one year."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    day = (F.col("event_id") % 365).cast("int")
    ts = (F.lit("2023-01-01").cast("timestamp_ntz")
          + F.make_dt_interval(days=day, hours=F.hour("ts")))
    raw = e.select(
        pick(TYPICAL_STATIONS, F.col("user_id") % 8).alias("station_id"),
        ts.alias("ts"),
        (F.col("value") / 10.0 - 5.0).alias("temp_c"),
        (40.0 + F.col("event_id") % 50).alias("rh_pct"),
        ((F.col("event_id") % 12) / 2.0).alias("wind_speed_ms"),
        ((F.col("event_id") % 30) * 20.0).alias("ghi_whm2"),
    )
    return raw.groupBy("station_id", "ts").agg(
        *[F.avg(c).alias(c) for c in ("temp_c", "rh_pct", "wind_speed_ms", "ghi_whm2")])


# Public holidays on the same date every year.
FIXED_HOLIDAYS = (
    ("01-01", "신정"), ("03-01", "삼일절"), ("05-05", "어린이날"), ("06-06", "현충일"),
    ("08-15", "광복절"), ("10-03", "개천절"), ("12-25", "성탄절"),
)
# Single holidays with a category of their own.
SINGLE_HOLIDAYS = (
    ("1996-04-11", "국회의원 선거", "election"), ("1997-12-18", "대통령 선거", "election"),
    ("2000-04-13", "국회의원 선거", "election"), ("1999-10-09", "한글날", "new_2023"),
    ("2000-10-09", "한글날", "new_2023"), ("1998-05-04", "대체공휴일", "substitute"),
    ("2001-05-07", "대체공휴일", "substitute"), ("1997-02-28", "임시공휴일", "substitute"),
)
HOLIDAY_YEARS = (*range(1995, 2003), 2024)


def holiday_rows() -> list[tuple[str, str, str]]:
    rows = [(f"{y}-{md}", name, "national") for y in HOLIDAY_YEARS for md, name in FIXED_HOLIDAYS]
    return sorted(rows + [tuple(r) for r in SINGLE_HOLIDAYS])


def holidays(spark: SparkSession) -> DataFrame:
    """Holiday calendar: date, name, category (a few rows per year)."""
    return spark.createDataFrame(holiday_rows(), "date string, name string, category string"
                                 ).withColumn("date", F.to_date("date"))


def region_station(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGION_STATION.items()), "region_code string, station_id int")
