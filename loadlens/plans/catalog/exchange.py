"""File sources as round trips: a given table is written in a source's own format, read back
by its reader, and compared with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.operators import publish
from loadlens.plans.catalog.base import query
from loadlens.plans.catalog.climate import month_of
from loadlens.plans.catalog.core import daily_of
from loadlens.session import work_dir
from loadlens.sources import readings as src, tables as t, weather as ws


def text(c):
    return c.cast("string")


def write_csv(df, path: str) -> str:
    df.write.option("header", True).csv(path)
    return path


@query("observed_weather_file", "station_id:i ts:s temp_c:8 humidity:8 wind_speed:8 solar_mj:8 "
       "precip_mm:4", "A6", """
    SELECT station_id, ts, temp_c, humidity, wind_speed, solar_mj, precip_mm FROM weather""")
def observed_weather_file(spark, sf):
    w = t.weather_hourly(spark, sf)
    have = {"ts": F.date_format("ts", "yyyy-MM-dd HH:mm"), "station_name": F.lit("s")}
    cols = [have[c] if c in have else text(F.col(c)) if c in w.columns else F.lit(None).cast("string")
            for c in ws.OBSERVED_COLUMNS]
    path = write_csv(w.select(*[c.alias(f"열{i}") for i, c in enumerate(cols)]), work_dir(spark, "asos"))
    return ws.read_observed(spark, path)


@query("typical_year_file", "station_id:i ts:s temp_c:8 rh_pct:8 wind_speed_ms:8 ghi_whm2:8", "A9",
       "SELECT station_id, ts, temp_c, rh_pct, wind_speed_ms, ghi_whm2 FROM typical")
def typical_year_file(spark, sf):
    d = t.typical_year_hourly(spark, sf)
    return ws.read_typical(spark, write_csv(d.withColumn("ts", text(F.col("ts"))),
                                            work_dir(spark, "typical")))


@query("epw_files", "station_id ts:s temp_c:8 rh_pct:8 wind_speed_ms:8 ghi_whm2:8 lat:4", "A7", """
    SELECT CAST(station_id AS VARCHAR) AS station_id, ts, temp_c, rh_pct, wind_speed_ms, ghi_whm2,
           station_id / 4.0 AS lat FROM typical""")
def epw_files(spark, sf):
    """One EPW text file per station: a LOCATION line, header lines, and a line per hour."""
    d = t.typical_year_hourly(spark, sf)
    fields = {6: "temp_c", 8: "rh_pct", 13: "ghi_whm2", 19: "wind_speed_ms"}
    missing = {i: m for i, _, m in ws.SHORT_LAYOUT}
    rest = [F.coalesce(text(F.col(fields[i])), F.lit(str(missing[i]))) if i in fields
            else F.lit(str(missing.get(i, 0))) for i in range(6, 29)]
    line = F.concat_ws(",", *[F.date_format("ts", p) for p in ("yyyy", "M", "d")],
                       text(F.hour("ts") + 1), F.lit("60"), F.lit("f"), *rest)
    station = text(F.col("station_id"))
    head = d.select("station_id").distinct().select(
        "station_id", F.explode(F.array(
            F.concat(F.lit("LOCATION,City,KOR,SRC,"), station, F.lit(","),
                     text(F.col("station_id") / 4.0), F.lit(",127.0,9.0,86.0")),
            F.lit("DESIGN CONDITIONS,0"), F.lit("COMMENTS 1,none"))).alias("value"))
    path = work_dir(spark, "epw")
    head.unionByName(d.select("station_id", line.alias("value"))).withColumn(
        "folder", F.col("station_id")).drop("station_id").repartition("folder").write.partitionBy(
        "folder").text(path)
    return ws.read_epw(spark, path, glob="part-*")[1]


@query("holiday_file", "date:s name category n_orders:i amount:2", "A8", """
    SELECT h.date, name, category, count(o_orderkey) AS n_orders,
           sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS amount
    FROM holiday h JOIN orders ON (month(o_orderdate), day(o_orderdate)) = (month(h.date), day(h.date))
      AND year(o_orderdate) <= year(h.date) GROUP BY ALL""")
def holiday_file(spark, sf):
    """The holiday calendar written, read back, and joined with the orders of the same day in
    that year and the years before."""
    d = t.holidays(spark).withColumn("date", text(F.col("date")))
    read = ws.read_holidays(spark, write_csv(d, work_dir(spark, "holidays")))
    # Orders become one row per date before they meet the calendar.
    days = t.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    same = ((F.month("day") == F.month("date")) & (F.dayofmonth("day") == F.dayofmonth("date"))
            & (F.year("day") <= F.year("date")))
    return read.join(days, same).groupBy("date", "name", "category").agg(
        F.sum("n").alias("n_orders"), F.sum("v").alias("amount"))


@query("solar_output_file", "ts:s total_solar_mw:6 market_solar_mw:6", "A10", """
    SELECT ts, total_mw AS total_solar_mw, market_mw AS market_solar_mw FROM order_hours""")
def solar_output_file(spark, sf):
    """Hourly output written with an hour-ending clock (1 to 24) and read back."""
    o = t.table(spark, sf, "orders")
    ts = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    price = F.col("o_totalprice") / 1e4
    d = o.groupBy(ts.alias("ts")).agg(
        F.sum(price).alias("total_solar_mw"),
        F.sum(F.when(F.col("o_orderstatus") == "F", price).otherwise(0.0)).alias("market_solar_mw"))
    clock = F.concat(F.date_format("ts", "yyyy-MM-dd "),
                     F.lpad(text(F.hour("ts") + 1), 2, "0"), F.lit(":00"))
    return ws.read_solar(spark, write_csv(d.select(clock.alias("datetime"), "total_solar_mw",
                                                   "market_solar_mw"), work_dir(spark, "solar")))


@query("grid_load_file", "customer_id ts:s p_active_kwh:8 contract_power_kw:4", "A2", """
    SELECT 'grid_' || (o_custkey % 7) || '_' || (o_custkey % 5) AS customer_id,
           CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24) AS ts,
           o_totalprice / (1 + o_orderkey % 9) AS p_active_kwh, 3.0 * (o_custkey % 11) AS contract_power_kw
    FROM orders""")
def grid_load_file(spark, sf):
    """Orders as grid loads: cell, date parts, hour 1 to 24, households, load."""
    o, k, c = t.table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate")
    values = {"grid_x": c % 7, "grid_y": c % 5, "lat": F.lit(37.5), "lon": F.lit(127),
              "year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day),
              "hour": k % 24 + 1, "contract_power_kw": 3.0 * (c % 11), "n_households": 1 + k % 9,
              "load_kwh": F.col("o_totalprice"), "_temp_c": F.lit(1.5), "_humidity": F.lit(40),
              "_wind": F.lit(2)}
    d = o.select(*[text(values[name]).alias(source) for source, name in src.GRID_COLUMNS.items()])
    return src.load(spark, src.SourceConfig("grid", write_csv(d, work_dir(spark, "grid"))))


@query("readings_table_file", "customer_id n:i kwh:4 first_ts:s last_ts:s contract_type", "A1", """
    SELECT customer_id, count(*) AS n, sum(p_active_kwh) AS kwh, min(ts) AS first_ts,
           max(ts) AS last_ts, any_value(contract_type) AS contract_type
    FROM readings GROUP BY customer_id""")
def readings_table_file(spark, sf):
    """Readings kept as parquet with a text time stamp."""
    path = work_dir(spark, "table")
    t.readings(spark, sf).drop("ingest_seq").withColumn("ts", text(F.col("ts"))).write.parquet(path)
    return totals_by_customer(src.load(spark, src.SourceConfig("table", path)))


def totals_by_customer(d):
    """Totals, span and a contract type per customer. The type is a group of its own first: an
    aggregate that holds a text sorts all readings of a task, one of numbers holds its groups."""
    each = d.groupBy("customer_id", "contract_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_active_kwh").alias("kwh"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return each.groupBy("customer_id").agg(
        F.sum("n").alias("n"), F.sum("kwh").alias("kwh"), F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"), F.first("contract_type").alias("contract_type"))


@query("station_month_files", "station_id:i year_month:s temp_mean:8 cdh_total:6", "A15", """
    SELECT station_id, year_month, temp_mean, cdh_total FROM weather_month""")
def station_month_files(spark, sf):
    """A folder with one monthly file per station."""
    path = work_dir(spark, "stations")
    m = month_of(spark, sf).select("station_id", F.date_format("year_month", "yyyy-MM").alias(
        "year_month"), "temp_mean", "cdh_total")
    for s in t.STATIONS:  # eight stations, fixed
        m.where(F.col("station_id") == s).drop("station_id").write.option("header", True).csv(
            f"{path}/station_{s}.csv")
    return ws.read_station_folder(spark, path)


@query("saved_result", "customer_id n:i kwh:4", "A18", """
    SELECT customer_id, count(*) AS n, sum(day_kwh) AS kwh FROM daily GROUP BY customer_id""")
def saved_result(spark, sf):
    """A result saved as parquet and text with metadata; the text is what comes back."""
    out = work_dir(spark, "results")
    d = daily_of(spark, sf).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("day_kwh").alias("kwh"))
    publish.save_result(d, out, "per_customer", "energy per customer", "customer_id")
    back = src.read_delimited(spark, f"{out}/per_customer_csv")
    return src.infer_numeric(back)


@query("repaired_text", "n:i n_marked:i", "A12 A13", """
    SELECT count(*) AS n, count_if(event_id % 50 = 0) AS n_marked FROM events""")
def repaired_text(spark, sf):
    """Event lines with an undecodable byte in every fiftieth, repaired and read again."""
    path, fixed = work_dir(spark, "broken"), work_dir(spark, "repaired")
    line = F.concat_ws(",", text(F.col("event_id")), "event_type")
    broken = F.concat(line.cast("binary"), F.unhex(F.lit("FF"))).cast("string")
    e = t.table(spark, sf, "events").select(
        F.when(F.col("event_id") % 50 == 0, broken).otherwise(line).alias("value"),
        line.alias("line"))
    e.select("value").write.text(path)
    src.repair(spark, path, fixed)
    bad = src.broken_lines(spark, path).agg(F.count(F.lit(1)).alias("n_marked"))
    good = spark.read.text(fixed).join(e.select(F.col("line").alias("value")), "value", "left_semi")
    return good.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(bad))  # one row each


# Contract types in the two-byte Korean charset of old exports.
KOREAN_BYTES = {"residential": "주택용", "general": "일반용", "industrial": "산업용"}


def korean_bytes(name: str):
    return F.unhex(F.lit(KOREAN_BYTES[name].encode("cp949").hex()))


@query("damaged_export", "charset contract_type n:i kwh:2 lines_read:i lines_bad:i lines_damaged:i "
       "bytes_replaced:i", "A3 A13 A12 P1", """
    WITH rows AS (
      SELECT event_id, CAST(value AS DECIMAL(18, 6)) AS kwh, event_id % 2 AS file,
             event_id % 40 < 2 AS damaged, event_id % 110 < 2 AS short,
             CASE event_id % 3 WHEN 0 THEN '주택용' WHEN 1 THEN '일반용' ELSE '산업용' END AS contract_type
      FROM events),
    counts AS (
      SELECT file, count(*) AS lines_read, count_if(short) AS lines_bad,
             count_if(damaged) AS lines_damaged, 2 * count_if(damaged) AS bytes_replaced
      FROM rows GROUP BY file)
    SELECT CASE file WHEN 0 THEN 'cp949' ELSE 'utf-8' END AS charset, contract_type, count(*) AS n,
           sum(kwh) AS kwh, any_value(lines_read) AS lines_read, any_value(lines_bad) AS lines_bad,
           any_value(lines_damaged) AS lines_damaged, any_value(bytes_replaced) AS bytes_replaced
    FROM rows JOIN counts USING (file) WHERE NOT short GROUP BY file, contract_type""")
def damaged_export(spark, sf):
    """Meter exports in CP949 and UTF-8, one line in twenty with two broken bytes and some with
    a field too many: every file is read in its own charset, and what is damaged is counted."""
    path = work_dir(spark, "damaged")
    e = t.table(spark, sf, "events")
    k = F.col("event_id")
    names = list(KOREAN_BYTES)
    kind = lambda make: F.when(k % 3 == 0, make(names[0])).when(
        k % 3 == 1, make(names[1])).otherwise(make(names[2]))
    plain = lambda n: F.lit(KOREAN_BYTES[n]).cast("binary")
    noise = F.when(k % 40 < 2, F.unhex(F.lit("FFFF"))).otherwise(F.unhex(F.lit("")))
    extra = F.when(k % 110 < 2, F.lit(",9")).otherwise(F.lit(""))
    head = F.concat_ws(",", text(k), text(F.col("value").cast("decimal(18,6)")), F.lit("x")).cast("binary")
    for name, own, make in (("old", 0, korean_bytes), ("new", 1, plain)):
        title = "번호,양,메모,계약종별".encode("cp949" if own == 0 else "utf-8").hex()
        line = F.concat(head, noise, F.lit(",").cast("binary"), kind(make), extra.cast("binary"))
        folder = F.floor(k / 100_000).alias("folder")  # a file each, the header first
        rows = e.where(k % 2 == own).select(folder, k.alias("k"), line.alias("b"))
        top = rows.select("folder").distinct().select(
            "folder", F.lit(-1).cast("bigint").alias("k"), F.unhex(F.lit(title)).alias("b"))
        top.unionByName(rows).repartition("folder").sortWithinPartitions("folder", "k").select(
            "folder", F.col("b").cast("string").alias("value")).write.partitionBy(
            "folder").text(f"{path}/{name}")
    good = src.read_delimited(spark, path)
    report = src.bad_line_report(spark, path).groupBy("charset").agg(*[
        F.sum(c).alias(c) for c in ("lines_read", "lines_bad", "lines_damaged", "bytes_replaced")])
    charset = F.when(F.col("번호").cast("bigint") % 2 == 0, "cp949").otherwise("utf-8")
    rolled = good.groupBy(charset.alias("charset"), F.col("계약종별").alias("contract_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("양").cast("decimal(18,6)")).alias("kwh"))
    return rolled.join(F.broadcast(report), "charset")  # a row per charset
