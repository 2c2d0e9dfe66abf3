"""Streaming, publishing, result-table and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.operators import baselines, metrics, publish, rollup, weather as wx
from loadlens.plans import ingest
from loadlens.plans.catalog import ctes
from loadlens.plans.catalog.base import query
from loadlens.plans.catalog.climate import month_of, tmy_of
from loadlens.plans.catalog.core import context_of, daily_of, results_of
from loadlens.session import work_dir
from loadlens.sources import readings as src, tables as t
from loadlens.streaming import jobs


def event_stream(spark, sf):
    """The event log as a stream of readings (the file appears as new data)."""
    raw = jobs.read_stream(spark, sf, t.SCHEMAS["events"], "events.parquet")
    return t.shape_events(raw)


def streamed(spark, stream, mode="append"):
    return jobs.run_available(stream, work_dir(spark, "sink"), work_dir(spark, "state"), mode)


@query("stream_daily_load", "customer_id contract_type date:s day_kwh:4 n_intervals:i", "L1", """
    SELECT * FROM (SELECT customer_id, contract_type, ts::DATE AS date,
        sum(p_active_kwh) AS day_kwh, count(p_active_kwh) AS n_intervals
      FROM readings_hf GROUP BY ALL)
    WHERE date + 1 <= (SELECT max(ts) FROM readings_hf) - INTERVAL 2 DAY""")
def stream_daily_load(spark, sf):
    return streamed(spark, jobs.daily_stream(event_stream(spark, sf)))


@query("stream_dedup", "n:i n_keys:i", "L2", """
    SELECT count(*) AS n, count(*) AS n_keys FROM (SELECT DISTINCT customer_id, ts FROM readings_hf)""")
def stream_dedup(spark, sf):
    d = streamed(spark, jobs.dedup_stream(event_stream(spark, sf).select(
        "customer_id", "ts", "contract_type", "p_active_kwh")))
    keys = d.groupBy("customer_id", "ts").agg(F.count(F.lit(1)).alias("c"))
    return keys.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_keys"))


@query("stream_month_to_date_alarms", "customer_id partial_kwh:4 days_observed:i days_in_month:i "
       "pred_monthly_kwh:7 pred_any:i", "L3 E5 H12", """
    SELECT customer_id, sum(p_active_kwh) AS partial_kwh, count(DISTINCT ts::DATE) AS days_observed,
           31 AS days_in_month,
           sum(p_active_kwh) * 31 / count(DISTINCT ts::DATE) AS pred_monthly_kwh, 0 AS pred_any
    FROM readings_hf GROUP BY customer_id""")
def stream_month_to_date_alarms(spark, sf):
    target = work_dir(spark, "days")
    jobs.run_upsert(jobs.daily_stream(event_stream(spark, sf)), target, work_dir(spark, "state"))
    daily = jobs.read_upserted(spark, target)
    return jobs.month_to_date_alarms(daily, F.lit("2024-01-31").cast("date"),
                                     rollup.monthly_by_customer(daily))


@query("month_to_date_alarms", "customer_id partial_kwh:4 days_observed:i days_in_month:i "
       "pred_monthly_kwh:7 pred_any:i", "L3 E5 H12", f"""
    SELECT *, {ctes.alarm('pred_monthly_kwh', 'pred')} FROM (
      SELECT h.*, partial_kwh * days_in_month / days_observed AS pred_monthly_kwh,
             a.monthly_kwh AS prev_month_kwh, y.monthly_kwh AS yoy_month_kwh,
             (SELECT avg(m.monthly_kwh) FROM monthly m WHERE m.customer_id = h.customer_id
                AND m.year_month BETWEEN DATE '1997-03-01' AND DATE '1997-05-01') AS ma3_kwh
      FROM (SELECT customer_id, sum(day_kwh) AS partial_kwh, count(DISTINCT date) AS days_observed,
                   30 AS days_in_month FROM daily
            WHERE date BETWEEN DATE '1997-06-01' AND DATE '1997-06-20' GROUP BY customer_id) h
      LEFT JOIN monthly a ON a.customer_id = h.customer_id AND a.year_month = DATE '1997-05-01'
      LEFT JOIN monthly y ON y.customer_id = h.customer_id AND y.year_month = DATE '1996-06-01')""")
def month_to_date_alarms(spark, sf):
    """The running month of the readings on its twentieth day, for every customer."""
    daily = daily_of(spark, sf)
    return jobs.month_to_date_alarms(daily, F.lit("1997-06-20").cast("date"),
                                     rollup.monthly_by_customer(daily))


@query("stream_sliding_hour", "window_start:s contract_type kwh:4 n:i", "L4", """
    SELECT window_start, contract_type, sum(p_active_kwh) AS kwh, count(p_active_kwh) AS n
    FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS window_start
          FROM readings_hf, (VALUES (0), (1), (2), (3)) v(k))
    WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM readings_hf) - INTERVAL 2 HOUR
    GROUP BY ALL""")
def stream_sliding_hour(spark, sf):
    return streamed(spark, jobs.hourly_load_stream(event_stream(spark, sf)))


@query("stream_static_join", "region_code n:i kwh:4", "L5", """
    SELECT r_name AS region_code, count(*) AS n, sum(value) AS kwh FROM events
    LEFT JOIN (SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
               JOIN region ON n_regionkey = r_regionkey) ON c_custkey = user_id GROUP BY r_name""")
def stream_static_join(spark, sf):
    nation, region = t.table(spark, sf, "nation"), t.table(spark, sf, "region")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey)  # 25 rows
    info = t.table(spark, sf, "customer").join(
        F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("customer_id"),
        F.col("r_name").alias("region_code"))
    d = streamed(spark, jobs.enrich_stream(event_stream(spark, sf), info).select(
        "customer_id", "ts", "region_code", "p_active_kwh"))
    return d.groupBy("region_code").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum("p_active_kwh").alias("kwh"))


@query("publish_verified", "table_name rows:i total_kwh:4", "A19 A14", """
    SELECT 'daily' AS table_name, count(*) AS rows, sum(day_kwh) AS total_kwh FROM (
        SELECT customer_id, contract_type, ts::DATE, sum(p_active_kwh) AS day_kwh FROM readings
        WHERE p_active_kwh IS NOT NULL GROUP BY ALL)
    UNION ALL SELECT 'ami_features', count(*), 0 FROM ami_month
    UNION ALL SELECT 'btm_signals', count(*), 0 FROM ingest_btm
    UNION ALL SELECT 'customer_info', count(DISTINCT customer_id), 0 FROM readings
        WHERE p_active_kwh IS NOT NULL""")
def publish_verified(spark, sf):
    """Ingest tables staged, compared, moved and read back from the published folder."""
    out = work_dir(spark, "published")
    publish.publish(spark, ingest.ingest_tables(t.readings(spark, sf)), out)
    parts = None
    for name in ("daily", "ami_features", "btm_signals", "customer_info"):
        p = publish.fingerprint(spark.read.parquet(f"{out}/{name}")).select(
            F.lit(name).alias("table_name"), F.col("n_rows").alias("rows"), "total_kwh")
        parts = p if parts is None else parts.unionByName(p)
    return parts


@query("load_published_daily", "customer_id n:i total:4 region_code", "A5 C3", """
    SELECT customer_id, count(DISTINCT ts::DATE) AS n, sum(p_active_kwh) AS total,
           any_value(region_code) AS region_code
    FROM readings WHERE p_active_kwh IS NOT NULL GROUP BY customer_id""")
def load_published_daily(spark, sf):
    out = work_dir(spark, "published")
    publish.publish(spark, ingest.ingest_tables(t.readings(spark, sf)), out)
    d = src.load_smart(spark, src.SourceConfig("table", f"{out}/daily"), out)
    return d.groupBy("customer_id", "region_code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("day_kwh").alias("total"))


@query("meter_export_round_trip", "customer_id n:i kwh:4 reactive:6 first_ts:s last_ts:s",
       "A3 A4 B4 B16", """
    SELECT customer_id, count(*) AS n, sum(p_active_kwh) AS kwh, sum(p_reactive_kwh) AS reactive,
           min(ts) AS first_ts, max(ts) AS last_ts
    FROM readings GROUP BY customer_id""")
def meter_export_round_trip(spark, sf):
    """Readings written as a raw meter export (text, split date and time) and loaded again."""
    path = work_dir(spark, "export")
    m = src.METER_COLUMNS
    r = t.readings(spark, sf)
    r.select(
        F.col("customer_id").alias(m["customer_id"]),
        F.date_format("ts", "yyyyMMdd").alias(m["ts_date"]),
        F.date_format("ts", "H:mm").alias(m["ts_time"]),
        F.col("p_active_kwh").cast("string").alias(m["p_active_kwh"]),
        F.col("contract_type").alias(m["contract_type"]),
        F.col("p_reactive_lag").cast("string").alias(m["p_reactive_lag"]),
        F.col("p_reactive_lead").cast("string").alias(m["p_reactive_lead"]),
    ).write.option("header", True).option("sep", "\t").csv(path)
    d = src.load(spark, src.SourceConfig("meter", path, m))
    return d.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_active_kwh").alias("kwh"),
        F.sum("p_reactive_kwh").alias("reactive"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"))


@query("bad_line_report", "lines_read:i lines_bad:i lines_kept:i charset", "A3 A14", """
    SELECT count(*) + count_if(event_id % 100 = 0) AS lines_read,
           count_if(event_id % 100 = 0) AS lines_bad, count(*) AS lines_kept, 'utf-8' AS charset
    FROM events""")
def bad_line_report(spark, sf):
    """The event log written as text, with a broken line after every hundredth event."""
    path = work_dir(spark, "lines")
    line = F.concat_ws(",", "event_id", "event_type", "value")
    lines = F.when(F.col("event_id") % 100 == 0, F.array(line, F.lit("broken"))).otherwise(
        F.array(line))
    # One column that holds the whole line, with another separator: commas stay as they are.
    t.table(spark, sf, "events").select(F.explode(lines).alias("event_id,event_type,value")
                                        ).write.option("header", True).option("sep", "\t").csv(path)
    d = src.bad_line_report(spark, path)
    return d.agg(F.sum("lines_read").alias("lines_read"), F.sum("lines_bad").alias("lines_bad"),
                 F.sum("lines_kept").alias("lines_kept"), F.max("charset").alias("charset"))


@query("csv_to_parquet", "event_id:i user_id:i ts:s event_type value:6 props", "A11 B21", """
    SELECT event_id, user_id, ts, event_type, value, props FROM events""")
def csv_to_parquet(spark, sf):
    """All columns of the event log as delimited text, converted with inferred numbers."""
    path, dst = work_dir(spark, "csv"), work_dir(spark, "converted")
    e = t.table(spark, sf, "events")
    e.select("event_id", "user_id", F.col("ts").cast("string").alias("ts"), "event_type", "value",
             "props").write.option("header", True).csv(path)
    d = src.csv_to_parquet(spark, path, dst)
    assert dict(d.dtypes)["value"] == "double" and dict(d.dtypes)["event_type"] == "string"
    return d.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("output_self_test", "column_name n_rows:i n_customers:i first_day:s last_day:s "
       "n_negative_days:i null_rate:8 grade", "A20", "\nUNION ALL\n".join(f"""
    SELECT '{c}' AS column_name, count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers,
           min(date) AS first_day, max(date) AS last_day, count_if(day_kwh < 0) AS n_negative_days,
           0 AS null_rate, 'OK' AS grade FROM daily""" for c in (
    "customer_id", "contract_type", "date", "day_kwh")))
def output_self_test(spark, sf):
    return publish.self_test(daily_of(spark, sf))


@query("partitioned_readings", "ym n:i kwh:4", "A21", """
    SELECT strftime(ts, '%Y-%m') AS ym, count(*) AS n, sum(p_active_kwh) AS kwh FROM readings
    GROUP BY 1""")
def partitioned_readings(spark, sf):
    path = work_dir(spark, "by-month")
    publish.write_by_month(t.readings(spark, sf).drop("ingest_seq"), path)
    return spark.read.parquet(path).groupBy(F.col("ym").cast("string").alias("ym")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_active_kwh").alias("kwh"))


@query("stage_resume", "year_month:s n:i kwh:4", "A22", """
    SELECT year_month, count(*) AS n, sum(monthly_kwh) AS kwh FROM monthly GROUP BY year_month""")
def stage_resume(spark, sf):
    path = work_dir(spark, "stage")
    for _ in range(2):  # the second call reads the finished stage
        d = publish.stage(spark, path, lambda: rollup.monthly_by_customer(daily_of(spark, sf)))
    return d.groupBy("year_month").agg(F.count(F.lit(1)).alias("n"),
                                       F.sum("monthly_kwh").alias("kwh"))


@query("serving_tables", "table_name n:i", "A23", """
    SELECT 'daily' AS table_name, count(*) AS n FROM daily
    UNION ALL SELECT 'daily_cum', count(*) FROM daily
    UNION ALL SELECT 'monthly', count(*) FROM monthly
    UNION ALL SELECT 'preds', count(*) FROM preds
    UNION ALL SELECT 'ctx', count(*) FROM ctx
    UNION ALL SELECT 'metrics', count(*) FROM (SELECT DISTINCT model, horizon_days, contract_type
                                               FROM preds)
    UNION ALL SELECT 'tou_breakdown', count(*) FROM tou_share""")
def serving_tables(spark, sf):
    out = work_dir(spark, "serving")
    tables = publish.serving_tables(t.readings(spark, sf))
    publish.write_tables(tables, out)
    parts = None
    for name in tables:
        p = spark.read.parquet(f"{out}/{name}").agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
        parts = p if parts is None else parts.unionByName(p)
    return parts


@query("weather_product", "version n:i temp:9", "A24", """
    SELECT version, count(*) AS n, avg(temp_mean) AS temp FROM nation_all GROUP BY version
    UNION ALL SELECT 'station', count(*), avg(temp_mean) FROM weather_month
    UNION ALL SELECT 'tmy_raw', count(*), avg(temp_mean) FROM tmy_month
    UNION ALL SELECT 'tmy_bias', count(*), avg(temp_mean) FROM tmy_bias
    UNION ALL SELECT 'tmy_forecast', count(*), avg(temp_mean) FROM tmy_forecast_month""")
def weather_product(spark, sf):
    out = work_dir(spark, "weather")
    month = month_of(spark, sf)
    hours = tmy_of(spark, sf)
    typical = wx.typical_monthly(hours)
    forecast = wx.typical_monthly(wx.forecast_corrected(hours, t.weather_hourly(spark, sf)))
    publish.write_weather_versions(wx.national_versions(month), month, {
        "tmy_raw": typical, "tmy_bias": wx.bias_corrected(typical, month),
        "tmy_forecast": forecast}, out)
    return spark.read.parquet(out).groupBy("version").agg(
        F.count(F.lit(1)).alias("n"), F.avg("temp_mean").alias("temp"))


ctes.add("nation_all", "SELECT version, year_month, sum(temp_mean * w) / sum(w) AS temp_mean "
         "FROM weather_month JOIN station_weights USING (station_id) GROUP BY ALL")


@query("result_summary", "category name horizon_days:i n:i mape_pct:4 mae:4", "A25 G1 C24", f"""
    SELECT 'baselines' AS category, model AS name, horizon_days, {ctes.regression()}
    FROM labelled GROUP BY model, horizon_days
    UNION ALL BY NAME
    SELECT 'contracts' AS category, contract_type AS name, NULL::INTEGER AS horizon_days, {ctes.regression()}
    FROM labelled WHERE model = 'partial_linear' GROUP BY contract_type""")
def result_summary(spark, sf):
    ctx = context_of(spark, sf)
    contracts = metrics.evaluate_rows(results_of(spark, sf), ("contract_type",))
    return publish.result_summary(
        {"baselines": baselines.evaluate_all(ctx, ("model", "horizon_days")),
         "contracts": contracts}, {"baselines": "model", "contracts": "contract_type"})


@query("metric_fill_in", "model horizon_days:i mape_pct:4 rmse:4", "C24", f"""
    SELECT model, horizon_days, {ctes.regression()} FROM labelled GROUP BY model, horizon_days""")
def metric_fill_in(spark, sf):
    full = baselines.evaluate_all(context_of(spark, sf), ("model", "horizon_days"))
    holes = full.withColumn("rmse", F.when(F.col("model") != "partial_linear", F.col("rmse")))
    return publish.fill_from(holes, full, ["model", "horizon_days"], ["rmse"])


@query("alarm_output", "table_name n:i", "A26 I14", """
    SELECT 'predictions' AS table_name, count(*) AS n FROM labelled WHERE model = 'partial_linear'
    UNION ALL SELECT 'alarms', count(*) FROM labelled WHERE model = 'partial_linear' AND pred_any""")
def alarm_output(spark, sf):
    from loadlens.plans import scoring

    out = work_dir(spark, "scored")
    publish.write_predictions(scoring.score(context_of(spark, sf)), out)
    parts = [spark.read.parquet(f"{out}/{n}").agg(F.lit(n).alias("table_name"),
                                                  F.count(F.lit(1)).alias("n"))
             for n in ("predictions", "alarms")]
    return parts[0].unionByName(parts[1])
