"""Weather, station and hidden-generation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.functions import calendar as cal
from loadlens.operators import btm, clean, horizon as hz, rollup, weather as wx
from loadlens.plans.catalog import ctes
from loadlens.plans.catalog.base import query
from loadlens.plans.catalog.core import daily_of
from loadlens.sources import tables as t

HDH, CDH = "greatest(15 - temp_c, 0)", "greatest(temp_c - 24, 0)"


def degree_sql(keys: str, source: str, extra: str = "") -> str:
    parts = []
    for name, cond in (("daytime", "hour(ts) BETWEEN 9 AND 17"),
                       ("evening", "hour(ts) BETWEEN 18 AND 22"),
                       ("night", "(hour(ts) < 9 OR hour(ts) = 23)")):
        for n, e in (("cdh", CDH), ("hdh", HDH)):
            parts.append(f"coalesce(sum({e}) FILTER (WHERE {cond} AND temp_c IS NOT NULL), 0) AS {n}_{name}")
    return f"""
    SELECT {keys}, sum({CDH}) FILTER (WHERE temp_c IS NOT NULL) AS cdh_total,
           sum({HDH}) FILTER (WHERE temp_c IS NOT NULL) AS hdh_total, avg(temp_c) AS temp_mean,
           max(temp_c) AS temp_max, min(temp_c) AS temp_min, {', '.join(parts)} {extra}
    FROM {source} GROUP BY ALL HAVING count(temp_c) > 0"""


ctes.add("weather_month", degree_sql(
    "station_id, date_trunc('month', ts)::DATE AS year_month", "weather",
    """, avg(humidity) AS humidity_mean, avg(wind_speed) AS wind_speed_mean,
       avg(solar_mj) AS solar_mj_mean, sum(precip_mm) AS precip_sum,
       count_if(precip_mm > 0) AS rainy_hours"""))
DEG = ("cdh_total:8 hdh_total:8 temp_mean:8 temp_max:8 temp_min:8 cdh_daytime:8 hdh_daytime:8 "
       "cdh_evening:8 hdh_evening:8 cdh_night:8 hdh_night:8")
MEANS = "humidity_mean:8 wind_speed_mean:8 solar_mj_mean:8"
RAIN = "precip_sum:8 rainy_hours:8"
ALL_COLS = [c.split(":")[0] for c in f"{DEG} {MEANS} {RAIN}".split()]


def month_of(spark, sf):
    return wx.monthly_weather_features(t.weather_hourly(spark, sf))


@query("monthly_degree_hours", f"station_id:i year_month:s {DEG}", "D18 H1 H4",
       "SELECT * FROM weather_month")
def monthly_degree_hours(spark, sf):
    return wx.monthly_degree_hours(t.weather_hourly(spark, sf))


@query("monthly_weather_features", f"station_id:i year_month:s {DEG} {MEANS} {RAIN}", "D19",
       "SELECT * FROM weather_month")
def monthly_weather_features(spark, sf):
    return month_of(spark, sf)


ctes.add("station_weights", ctes.values(
    [row for row in wx.STATION_WEIGHTS if row[2] > 0],
    "version, station_id, w"))


def wavg(cols, w="w") -> str:
    return ", ".join(f"sum({c} * {w}) / sum({w}) FILTER (WHERE {c} IS NOT NULL) AS {c}"
                     for c in cols)


@query("national_weather_versions", f"version year_month:s {DEG} {MEANS} {RAIN}",
       "D20 A24 K12", f"SELECT version, year_month, {wavg(ALL_COLS)} FROM weather_month "
       "JOIN station_weights USING (station_id) GROUP BY version, year_month")
def national_weather_versions(spark, sf):
    return wx.national_versions(month_of(spark, sf))


@query("national_weather", f"year_month:s {DEG}", "D20",
       f"SELECT year_month, {wavg(ALL_COLS)} FROM weather_month JOIN station_weights "
       "USING (station_id) WHERE version = 'national_v1_paper' GROUP BY year_month")
def national_weather(spark, sf):
    return wx.national_series(month_of(spark, sf))


ctes.add("station_region", ctes.values(wx.STATION_REGION.items(), "station_id, region"))
ctes.add("region_weights", ctes.values(wx.REGION_WEIGHTS.items(), "region, w"))
HOURLY = ("temp_c", "humidity", "wind_speed")
HCOLS = " ".join(f"{c}:8" for c in HOURLY)
ctes.add("region_hour", "SELECT region, ts, " + ", ".join(f"avg({c}) AS {c}" for c in HOURLY)
         + " FROM weather JOIN station_region USING (station_id) GROUP BY ALL")
ctes.add("nation_hour", f"SELECT ts, {wavg(HOURLY)} FROM region_hour JOIN region_weights "
         "USING (region) WHERE w > 0 GROUP BY ts")


@query("national_hourly_weather", f"ts:s {HCOLS}", "D21", "SELECT * FROM nation_hour")
def national_hourly_weather(spark, sf):
    return wx.national_hourly(t.weather_hourly(spark, sf), list(HOURLY))


ctes.add("cust_place", """
    SELECT customer_id, CASE WHEN s_suppkey % 3 = 0 THEN 100 + s_suppkey % 60 END AS station_id,
           CASE s_suppkey % 5 WHEN 0 THEN '서울' WHEN 1 THEN '대구' WHEN 2 THEN '제주'
                WHEN 3 THEN '없음' END AS region
    FROM customer_info""")


@query("customer_weather", "customer_id src n:i temp_mean:8", "D22", """
    SELECT customer_id, src, count(*) AS n, avg(temp_c) AS temp_mean FROM (
      SELECT customer_id, CASE WHEN station_id IN (SELECT station_id FROM weather) THEN 's' || station_id
             WHEN region IN (SELECT region FROM region_hour) THEN 'r' || region ELSE 'n' END AS src
      FROM cust_place)
    JOIN (SELECT 's' || station_id AS src, ts, temp_c FROM weather
          UNION ALL SELECT 'r' || region, ts, temp_c FROM region_hour
          UNION ALL SELECT 'n', ts, temp_c FROM nation_hour) USING (src)
    GROUP BY ALL""")
def customer_weather(spark, sf):
    k = F.col("s_suppkey")
    place = t.customer_info(spark, sf).select(
        "customer_id", F.when(k % 3 == 0, 100 + k % 60).alias("station_id"),
        F.when(k % 5 == 0, "서울").when(k % 5 == 1, "대구").when(k % 5 == 2, "제주")
        .when(k % 5 == 3, "없음").alias("region"))
    own, series = wx.weather_sources(place, t.weather_hourly(spark, sf), ["temp_c"])
    each = series.groupBy("src").agg(F.count(F.lit(1)).alias("n"),
                                     F.avg("temp_c").alias("temp_mean"))
    return own.select("customer_id", "src").join(F.broadcast(each), "src")  # a row per series


@query("customer_reading_weather", "customer_id n:i n_weather:i temp_mean:8", "D22", """
    SELECT r.customer_id, count(*) AS n, count(w.temp_c) AS n_weather, avg(w.temp_c) AS temp_mean
    FROM readings r LEFT JOIN (
      SELECT customer_id, CASE WHEN station_id IN (SELECT station_id FROM weather) THEN 's' || station_id
             WHEN region IN (SELECT region FROM region_hour) THEN 'r' || region ELSE 'n' END AS src
      FROM cust_place) c ON c.customer_id = r.customer_id
    LEFT JOIN (SELECT 's' || station_id AS src, ts, temp_c FROM weather
          UNION ALL SELECT 'r' || region, ts, temp_c FROM region_hour
          UNION ALL SELECT 'n', ts, temp_c FROM nation_hour) w
      ON w.src = c.src AND w.ts = date_trunc('hour', r.ts)
    GROUP BY r.customer_id""")
def customer_reading_weather(spark, sf):
    k = F.col("s_suppkey")
    place = t.customer_info(spark, sf).select(
        "customer_id", F.when(k % 3 == 0, 100 + k % 60).alias("station_id"),
        F.when(k % 5 == 0, "서울").when(k % 5 == 1, "대구").when(k % 5 == 2, "제주")
        .when(k % 5 == 3, "없음").alias("region"))
    d = wx.attach_customer_weather(t.readings(spark, sf).select("customer_id", "ts"), place,
                                   t.weather_hourly(spark, sf), ["temp_c"])
    return d.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("temp_c").alias("n_weather"),
        F.avg("temp_c").alias("temp_mean"))


def part_sql(name: str, cond: str) -> str:
    f = f"FILTER (WHERE {cond} AND temp_c IS NOT NULL)"
    return (f"avg(temp_c) {f} AS {name}_temp_mean, sum({CDH}) {f} AS {name}_cdh, "
            f"sum({HDH}) {f} AS {name}_hdh")


@query("weather_observed_remainder", "station_id:i year_month:s horizon_days:i " + " ".join(
    f"{p}_{c}:6" for p in ("obs", "rem", "full") for c in ("temp_mean", "cdh", "hdh")), "D23", f"""
    SELECT station_id, date_trunc('month', ts)::DATE AS year_month, h AS horizon_days,
           {part_sql('obs', 'day(ts) <= h')}, {part_sql('rem', 'day(ts) > h')},
           {part_sql('full', 'true')}
    FROM weather, (VALUES (10), (20)) v(h) WHERE temp_c IS NOT NULL GROUP BY ALL""")
def weather_observed_remainder(spark, sf):
    return wx.split_observed_remainder(t.weather_hourly(spark, sf))


ctes.add("day_temp", "SELECT station_id, ts::DATE AS date, avg(temp_c) AS t FROM weather GROUP BY ALL")
ctes.add("degree_parts", """
    SELECT station_id, date_trunc('month', date)::DATE AS year_month, h AS horizon_days,
           avg(t) AS tf, avg(t) FILTER (WHERE day(date) <= h) AS tob,
           avg(t) FILTER (WHERE day(date) > h) AS tr
    FROM day_temp, (VALUES (10), (20)) v(h) GROUP BY ALL""")


def deg(t_col: str, name: str) -> str:
    return (f"CASE WHEN {t_col} IS NOT NULL THEN greatest(15 - {t_col}, 0) END AS hdd_{name}, "
            f"CASE WHEN {t_col} IS NOT NULL THEN greatest({t_col} - 24, 0) END AS cdd_{name}")


DEGREES = " ".join(f"{k}_{p}:8" for p in ("full", "observed", "remainder") for k in ("hdd", "cdd"))
ctes.add("degree_features", f"""
    SELECT station_id, year_month, horizon_days, {deg('tf', 'full')}, {deg('tob', 'observed')},
           {deg('tr', 'remainder')} FROM degree_parts""")


@query("degree_features", f"station_id:i year_month:s horizon_days:i {DEGREES}", "D24 C14",
       "SELECT * FROM degree_features")
def degree_features(spark, sf):
    return wx.degree_features(t.weather_hourly(spark, sf))


ctes.add("tmy", """
    SELECT CASE station_id WHEN 101 THEN 114 ELSE station_id END AS station_id, ts, temp_c,
           month(ts) AS month, dayofyear(ts) AS doy, rh_pct AS humidity,
           wind_speed_ms AS wind_speed, ghi_whm2 * 0.0036::DOUBLE AS solar_mj FROM typical""")
TMEANS = """, avg(humidity) AS humidity_mean, avg(wind_speed) AS wind_speed_mean,
       avg(solar_mj) AS solar_mj_mean, 0.0 AS precip_sum, 0 AS rainy_hours"""
ctes.add("tmy_month", degree_sql("station_id, month", "tmy", TMEANS))


def tmy_of(spark, sf):
    return wx.typical_hourly(t.typical_year_hourly(spark, sf))


@query("typical_year_monthly", f"station_id:i month:i year_month {DEG} {MEANS}", "D25 A9 C23",
       "SELECT *, 'TMY-' || lpad(CAST(month AS VARCHAR), 2, '0') AS year_month FROM tmy_month")
def typical_year_monthly(spark, sf):
    return wx.typical_monthly(tmy_of(spark, sf))


BIAS = list(wx.BIAS_COLUMNS)
ctes.add("recent_mean", "SELECT station_id, month(year_month) AS month, "
         + ", ".join(f"avg({c}) AS o_{c}" for c in [*BIAS, "precip_sum", "rainy_hours"]) + """
    FROM weather_month JOIN (SELECT station_id, max(year_month) AS last FROM weather_month
                             GROUP BY station_id) USING (station_id)
    WHERE year_month >= last - INTERVAL 36 MONTH GROUP BY ALL""")
ctes.add("tmy_bias", "SELECT station_id, month, " + ", ".join(
    f"CASE WHEN o_{c} IS NOT NULL AND {c} <> 0 THEN o_{c} ELSE {c} END AS {c}" for c in BIAS)
    + ", coalesce(o_precip_sum, 0) AS precip_sum, coalesce(o_rainy_hours, 0) AS rainy_hours "
    "FROM tmy_month LEFT JOIN recent_mean USING (station_id, month)")


@query("typical_year_bias_corrected", f"station_id:i month:i {DEG} {MEANS} {RAIN}", "D26",
       "SELECT * FROM tmy_bias")
def typical_year_bias_corrected(spark, sf):
    return wx.bias_corrected(wx.typical_monthly(tmy_of(spark, sf)), month_of(spark, sf))


ctes.add("tmy_scaled", """
    SELECT station_id, ts, month, humidity, wind_speed, solar_mj,
      CASE WHEN olo IS NULL THEN temp_c WHEN thi = tlo THEN (olo + ohi) / 2
           ELSE (temp_c - tlo) / (thi - tlo) * (ohi - olo) + olo END AS temp_c
    FROM tmy LEFT JOIN (SELECT station_id, doy, min(temp_c) AS tlo, max(temp_c) AS thi FROM tmy
                        GROUP BY ALL) USING (station_id, doy)
    LEFT JOIN (SELECT station_id, doy, avg(lo) AS olo, avg(hi) AS ohi FROM (
        SELECT station_id, month(ts) AS mo, dayofyear(ts) AS doy, min(temp_c) AS lo, max(temp_c) AS hi
        FROM weather GROUP BY ALL) GROUP BY ALL) USING (station_id, doy)""")


ctes.add("tmy_forecast_month", degree_sql("station_id, month", "tmy_scaled"))


@query("typical_year_forecast", f"station_id:i month:i {DEG}", "D27",
       degree_sql("station_id, month", "tmy_scaled"))
def typical_year_forecast(spark, sf):
    return wx.typical_monthly(wx.forecast_corrected(tmy_of(spark, sf), t.weather_hourly(spark, sf)))


ctes.add("branch_station", ctes.values(
    [("서울본부", 108), ("남서울본부", 108), ("인천본부", 112), ("경기북부", 119), ("강원 본부", 114),
     ("대전충남", 133), ("부산울산", 159), ("해외지사", None)], "region_sub, matched_station"))
ctes.add("cust_station", """
    SELECT customer_id, region_sub, matched_station, coalesce(matched_station, 108) AS station_id
    FROM customer_info JOIN branch_station USING (region_sub)""")


@query("station_match", "customer_id region_sub matched_station:i station_id:i", "C7 C3",
       "SELECT * FROM cust_station")
def station_match(spark, sf):
    return wx.customer_stations(t.customer_info(spark, sf))


def station_readings(spark, sf):
    st = wx.customer_stations(t.customer_info(spark, sf)).select("customer_id", "station_id")
    from loadlens.functions.joins import small_side

    return t.readings(spark, sf).join(
        small_side(st, measure=t.table(spark, sf, "supplier")), "customer_id")


ctes.add("station_reading", """
    SELECT r.*, s.station_id FROM readings r JOIN cust_station s USING (customer_id)""")


@query("attach_station_weather", "customer_id date:s n:i n_temp:i temp_c:6 solar_mj:6",
       "C5 C12 C22", """
    SELECT customer_id, r.ts::DATE AS date, count(*) AS n, count(temp_c) AS n_temp,
           avg(temp_c) AS temp_c, avg(solar_mj) AS solar_mj
    FROM station_reading r LEFT JOIN weather w ON w.station_id = r.station_id
         AND w.ts = date_trunc('hour', r.ts) GROUP BY ALL""")
def attach_station_weather(spark, sf):
    d = wx.attach_station_weather(station_readings(spark, sf), t.weather_hourly(spark, sf))
    return d.groupBy("customer_id", F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.count("temp_c").alias("n_temp"),
        F.avg("temp_c").alias("temp_c"), F.avg("solar_mj").alias("solar_mj"))


@query("ingest_daily", "customer_id contract_type date:s day_kwh:4 day_reactive_lag:6 "
       "day_reactive_lead:6 day_apparent_kwh:6 p_reactive_kwh:6 n_intervals:i temp_c:6",
       "D4 A14 B16 Q9", """
    SELECT customer_id, contract_type, r.ts::DATE AS date, coalesce(sum(p_active_kwh), 0) AS day_kwh,
           sum(p_reactive_lag) AS day_reactive_lag, sum(p_reactive_lead) AS day_reactive_lead,
           sum(p_apparent_kwh) AS day_apparent_kwh,
           sum(p_reactive_lag) + sum(p_reactive_lead) AS p_reactive_kwh,
           count(p_active_kwh) AS n_intervals, avg(temp_c) AS temp_c
    FROM station_reading r LEFT JOIN weather w ON w.station_id = r.station_id
         AND w.ts = date_trunc('hour', r.ts) GROUP BY ALL""")
def ingest_daily(spark, sf):
    return rollup.daily_ingest(wx.attach_station_weather(
        station_readings(spark, sf), t.weather_hourly(spark, sf), columns=("temp_c",)))


ctes.add("horizon_station", "SELECT h.*, s.station_id FROM horizon h JOIN cust_station s USING (customer_id)")


def horizon_station(spark, sf):
    st = wx.customer_stations(t.customer_info(spark, sf)).select("customer_id", "station_id")
    return hz.build_horizon_table(daily_of(spark, sf)).join(st, "customer_id")


@query("month_weather_join", "customer_id year_month:s horizon_days:i cdh_total:6 hdh_total:6 "
       "temp_mean:9", "C6 C8 A15", """
    SELECT h.customer_id, h.year_month, horizon_days, cdh_total, hdh_total, temp_mean
    FROM horizon_station h LEFT JOIN weather_month USING (station_id, year_month)""")
def month_weather_join(spark, sf):
    return wx.join_month_weather(horizon_station(spark, sf), month_of(spark, sf))


@query("typical_weather_join", "customer_id year_month:s horizon_days:i cdh_total:6 temp_mean:9",
       "C6 C23", """
    SELECT h.customer_id, h.year_month, horizon_days, cdh_total, temp_mean
    FROM horizon_station h LEFT JOIN tmy_month m
      ON m.station_id = h.station_id AND m.month = month(h.year_month)""")
def typical_weather_join(spark, sf):
    return wx.join_typical_weather(horizon_station(spark, sf),
                                   wx.typical_monthly(tmy_of(spark, sf)))


POLICY_SQL = """
    SELECT h.customer_id, h.year_month, h.horizon_days, m.cdh_total,
      CASE WHEN b.temp_mean IS NOT NULL THEN greatest(15 - b.temp_mean, 0) ELSE hdd_remainder END
        AS hdd_remainder,
      CASE WHEN b.temp_mean IS NOT NULL THEN greatest(b.temp_mean - 24, 0) ELSE cdd_remainder END
        AS cdd_remainder, hdd_observed
    FROM horizon_station h
    LEFT JOIN degree_features d ON d.station_id = h.station_id AND d.year_month = h.year_month
         AND d.horizon_days = h.horizon_days
    LEFT JOIN (SELECT station_id, year_month, cdh_total FROM weather_month) m
         ON m.station_id = h.station_id AND m.year_month = h.year_month
    LEFT JOIN tmy_bias b ON b.station_id = h.station_id AND b.month = month(h.year_month)"""


@query("weather_policy_tmy_bias", "customer_id year_month:s horizon_days:i cdh_total:8 "
       "hdd_remainder:8 cdd_remainder:8 hdd_observed:8", "C10 C11", POLICY_SQL)
def weather_policy(spark, sf):
    hourly = t.weather_hourly(spark, sf)
    f = horizon_station(spark, sf).join(
        wx.degree_features(hourly), ["station_id", "year_month", "horizon_days"], "left")
    month = wx.monthly_weather_features(hourly)
    typical = wx.bias_corrected(wx.typical_monthly(tmy_of(spark, sf)), month)
    return wx.attach_weather(f, "tmy_bias", month, {"tmy_bias": typical})


@query("wide_station_weather", "year_month:s " + " ".join(
    f"{c}_s{s}:9" for s in wx.STATIONS for c in ("cdh_total", "hdh_total", "temp_mean")), "C9",
    "SELECT year_month, " + ", ".join(
        f"max({c}) FILTER (WHERE station_id = {s}) AS {c}_s{s}"
        for s in wx.STATIONS for c in ("cdh_total", "hdh_total", "temp_mean"))
    + " FROM weather_month GROUP BY year_month")
def wide_station_weather(spark, sf):
    return wx.wide_stations(month_of(spark, sf))


ctes.add("tmy_grid", """
    SELECT s.station_id, g.ts, w.temp_c,
           row_number() OVER (PARTITION BY s.station_id ORDER BY g.ts) AS i
    FROM (SELECT DISTINCT station_id FROM tmy) s,
         (SELECT unnest(generate_series((SELECT min(ts) FROM tmy), (SELECT max(ts) FROM tmy),
                        INTERVAL 15 MINUTE)) AS ts) g
    LEFT JOIN tmy w ON w.station_id = s.station_id AND w.ts = g.ts""")
ctes.add("tmy_fine", """
    SELECT station_id, ts, pv AS held, CASE WHEN pi IS NULL THEN NULL WHEN ni IS NULL OR ni = pi THEN pv
           ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END AS line
    FROM (SELECT *, last_value(temp_c IGNORE NULLS) OVER b AS pv,
            last_value(CASE WHEN temp_c IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi,
            first_value(temp_c IGNORE NULLS) OVER f AS nv,
            first_value(CASE WHEN temp_c IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni
          FROM tmy_grid
          WINDOW b AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 f AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")


@query("weather_upsampled", "station_id:i month:i n:i held:6 line:6", "E12", """
    SELECT station_id, month(ts) AS month, count(*) AS n, avg(held) AS held, avg(line) AS line
    FROM tmy_fine GROUP BY ALL""")
def weather_upsampled(spark, sf):
    hourly = tmy_of(spark, sf)
    held = wx.upsample(hourly).withColumnRenamed("temp_c", "held")
    line = wx.upsample(hourly, method="linear").withColumnRenamed("temp_c", "line")
    return held.join(line, ["station_id", "ts"]).groupBy(
        "station_id", F.month("ts").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("held").alias("held"), F.avg("line").alias("line"))


@query("climatology_scenario", "station_id:i year_month:s temp_mean:9 hdh_total:6", "E14", """
    SELECT station_id, year_month, avg(temp_mean) OVER w AS temp_mean, avg(hdh_total) OVER w AS hdh_total
    FROM weather_month WINDOW w AS (PARTITION BY month(year_month))""")
def climatology_scenario(spark, sf):
    m = month_of(spark, sf).withColumn("month", F.month("year_month"))
    return wx.climatology(m, ["temp_mean", "hdh_total"])


ctes.add("solar_hour", f"""
    SELECT date_trunc('hour', ts) AS hour_ts, {wavg(['solar_mj'])} FROM weather
    JOIN station_weights USING (station_id) WHERE version = 'national_v1_paper'
    GROUP BY 1 HAVING count(solar_mj) > 0""")


@query("national_solar", "hour_ts:s solar_mj:6", "D28", "SELECT * FROM solar_hour")
def national_solar(spark, sf):
    return wx.national_solar(t.weather_hourly(spark, sf))


@query("weather_completeness", "station_id:i year:i n_rows:i n_hours:i null_temp_pct:6 fill_rate:6",
       "D58", """
    SELECT station_id, year(ts) AS year, count(*) AS n_rows, count(DISTINCT hour(ts)) AS n_hours,
           avg(CASE WHEN temp_c IS NULL THEN 100.0 ELSE 0 END) AS null_temp_pct,
           count(*) / (365 * 24) AS fill_rate FROM weather GROUP BY ALL""")
def weather_completeness(spark, sf):
    return t.weather_hourly(spark, sf).groupBy("station_id", F.year("ts").alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.size(F.collect_set(F.hour("ts"))).alias("n_hours"),
        F.avg(F.when(F.col("temp_c").isNull(), 100.0).otherwise(0.0)).alias("null_temp_pct"),
        (F.count(F.lit(1)) / (365 * 24)).alias("fill_rate"))


# --- hidden generation --------------------------------------------------------------------------

@query("btm_signal_negative", "customer_id neg_count:i neg_rate:8", "D29", """
    SELECT customer_id, count_if(p_active_kwh < 0) AS neg_count,
           count_if(p_active_kwh < 0) / count(p_active_kwh) AS neg_rate
    FROM readings GROUP BY customer_id""")
def btm_signal_negative(spark, sf):
    return btm.signal_negative(t.readings(spark, sf))


ctes.add("midday", """
    SELECT r.customer_id, r.p_active_kwh AS x, s.solar_mj AS s, hour(r.ts) AS hr
    FROM readings r JOIN solar_hour s ON s.hour_ts = date_trunc('hour', r.ts)
    WHERE hour(r.ts) BETWEEN 10 AND 15""")
ctes.add("midday_rank", """
    SELECT *, (rank() OVER (PARTITION BY hr ORDER BY s)
               + (count(*) OVER (PARTITION BY hr, s) - 1) / 2.0) / count(*) OVER (PARTITION BY hr) AS rk
    FROM midday""")
ctes.add("sunny_raw", """
    SELECT customer_id, count_if(rk >= 0.7) AS n_sun, count_if(rk <= 0.3) AS n_cloud,
      avg(x) FILTER (WHERE rk >= 0.7) AS sun, avg(x) FILTER (WHERE rk <= 0.3) AS cloud,
      covar_samp(s, x) / nullif(stddev_samp(s) FILTER (WHERE x IS NOT NULL) * stddev_samp(x), 0) AS r,
      avg(x) FILTER (WHERE s <= 0.01) AS dark, count_if(s > 0.1) AS n_lit,
      sum(s) FILTER (WHERE s > 0.1 AND x IS NOT NULL) AS s1,
      sum(s * s) FILTER (WHERE s > 0.1 AND x IS NOT NULL) AS s2,
      sum(s * x) FILTER (WHERE s > 0.1) AS sx
    FROM midday_rank GROUP BY customer_id""")
ctes.add("sunny_sig", """
    SELECT customer_id, midday_ratio, solar_load_corr,
      CASE WHEN ok AND midday_ratio < 1 AND dark > 0 AND n_lit >= 10
           THEN greatest(coalesce((dark * s1 - sx) / nullif(s2, 0), 0) * 4, 0) ELSE 0 END AS est_capacity_kw
    FROM (SELECT *, n_sun >= 10 AND n_cloud >= 10 AS ok,
            CASE WHEN n_sun >= 10 AND n_cloud >= 10 AND cloud > 0 THEN coalesce(sun / cloud, 1) ELSE 1 END
              AS midday_ratio,
            CASE WHEN n_sun >= 10 AND n_cloud >= 10 THEN coalesce(r, 0) ELSE 0 END AS solar_load_corr
          FROM sunny_raw)""")
ctes.add("valley", """
    SELECT s.*, CASE WHEN midday_ratio < (SELECT CASE WHEN stddev_samp(midday_ratio) > 0
                 THEN avg(midday_ratio) - 2 * stddev_samp(midday_ratio) ELSE 0 END FROM sunny_sig)
             AND solar_load_corr < (SELECT CASE WHEN stddev_samp(solar_load_corr) > 0
                 THEN avg(solar_load_corr) - 2 * stddev_samp(solar_load_corr) ELSE 0 END FROM sunny_sig)
           THEN 1 ELSE 0 END AS daytime_valley FROM sunny_sig s""")
VALLEY = "customer_id midday_ratio:6 solar_load_corr:6 est_capacity_kw:6 daytime_valley:i"


@query("btm_signal_sunny", VALLEY, "D30 E6 P9 C22", "SELECT * FROM valley")
def btm_signal_sunny(spark, sf):
    return btm.signal_sunny(t.readings(spark, sf), wx.national_solar(t.weather_hourly(spark, sf)))


ctes.add("mid_sig", """
    SELECT * FROM (SELECT customer_id, avg(p_active_kwh) FILTER (WHERE hour(ts) BETWEEN 10 AND 15)
             / greatest(avg(p_active_kwh), 1e-9) AS midday_ratio FROM readings GROUP BY customer_id)
    WHERE midday_ratio IS NOT NULL""")


ctes.add("mid_flag", """
    SELECT customer_id, midday_ratio, CASE WHEN midday_ratio < (SELECT
        CASE WHEN stddev_samp(midday_ratio) > 0 THEN avg(midday_ratio) - 2 * stddev_samp(midday_ratio)
             ELSE 0 END FROM mid_sig) THEN 1 ELSE 0 END AS daytime_valley
    FROM mid_sig""")
ctes.add("sun_usable", """
    SELECT (SELECT count(*) FROM midday) >= 100 AND (SELECT count(*) FROM solar_hour
        WHERE hour_ts::DATE BETWEEN (SELECT min(ts)::DATE FROM readings)
                                AND (SELECT max(ts)::DATE FROM readings)) > 100 AS ok""")
ctes.add("valley_used", """
    SELECT customer_id, midday_ratio, est_capacity_kw, daytime_valley FROM valley, sun_usable WHERE ok
    UNION ALL SELECT customer_id, midday_ratio, 0, daytime_valley FROM mid_flag, sun_usable
    WHERE NOT ok""")


@query("btm_signal_midday", "customer_id midday_ratio:6 daytime_valley:i", "D31",
       "SELECT * FROM mid_flag")
def btm_signal_midday(spark, sf):
    return btm.signal_midday(t.readings(spark, sf))


ctes.add("shift_sig", """
    SELECT customer_id, greatest(coalesce(max(d), 0), 0) AS max_drop_pct FROM (
      SELECT customer_id, CASE WHEN n >= 6 AND i >= 4 AND i <= n - 3 AND b > 0 THEN (b - a) / b END AS d
      FROM (SELECT customer_id, count(*) OVER (PARTITION BY customer_id) AS n,
              row_number() OVER w AS i,
              avg(monthly_kwh) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b,
              avg(monthly_kwh) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a
            FROM monthly WINDOW w AS (PARTITION BY customer_id ORDER BY year_month)))
    GROUP BY customer_id""")


@query("btm_signal_level_shift", "customer_id max_drop_pct:6 level_shift:i", "E7", """
    SELECT *, CASE WHEN max_drop_pct > 0.3 THEN 1 ELSE 0 END AS level_shift FROM shift_sig""")
def btm_signal_level_shift(spark, sf):
    return btm.signal_level_shift(t.readings(spark, sf))


ctes.add("summer_sig", """
    SELECT * FROM (SELECT customer_id,
      avg(p_active_kwh) FILTER (WHERE month(ts) IN (7, 8))
        / greatest(avg(p_active_kwh) FILTER (WHERE month(ts) IN (4, 5, 9, 10)), 1e-9) AS summer_ratio
      FROM readings GROUP BY customer_id) WHERE summer_ratio IS NOT NULL""")
ctes.add("summer_flag", """
    SELECT customer_id, summer_ratio, CASE WHEN summer_ratio < (SELECT avg(summer_ratio)
        - 2 * stddev_samp(summer_ratio) FROM summer_sig) THEN 1 ELSE 0 END AS summer_inverted
    FROM summer_sig""")


@query("btm_signal_summer", "customer_id summer_ratio:6 summer_inverted:i", "D32",
       "SELECT * FROM summer_flag")
def btm_signal_summer(spark, sf):
    return btm.signal_summer(t.readings(spark, sf))


ctes.add("btm_flags", """
    SELECT *, (signal_neg + signal_valley + signal_shift + signal_summer) / 4.0 AS btm_score,
           CASE WHEN signal_neg + signal_valley + signal_shift + signal_summer >= 2 OR signal_neg = 1
                THEN 1 ELSE 0 END AS is_btm
    FROM (SELECT c.customer_id, c.contract_type, n.neg_rate, coalesce(v.midday_ratio, 0) AS midday_ratio,
            coalesce(v.est_capacity_kw, 0) AS est_capacity_kw,
            CASE WHEN n.neg_rate >= 0.001 THEN 1 ELSE 0 END AS signal_neg,
            coalesce(v.daytime_valley, 0) AS signal_valley,
            CASE WHEN s.max_drop_pct > 0.3 THEN 1 ELSE 0 END AS signal_shift,
            coalesce(u.summer_inverted, 0) AS signal_summer
          FROM customer_info c
          JOIN (SELECT customer_id, count_if(p_active_kwh < 0) / count(p_active_kwh) AS neg_rate
                FROM readings GROUP BY customer_id) n USING (customer_id)
          LEFT JOIN valley_used v USING (customer_id) LEFT JOIN shift_sig s USING (customer_id)
          LEFT JOIN summer_flag u USING (customer_id))""")


def flags_of(spark, sf):
    return btm.detect(t.readings(spark, sf), wx.national_solar(t.weather_hourly(spark, sf)))


@query("btm_detect", "customer_id contract_type neg_rate:8 midday_ratio:6 est_capacity_kw:6 "
       "signal_neg:i signal_valley:i signal_shift:i signal_summer:i btm_score:6 is_btm:i",
       "D33 C20", "SELECT * FROM btm_flags")
def btm_detect(spark, sf):
    return flags_of(spark, sf)


@query("btm_summary", "n_total_customers:i n_btm_detected:i btm_rate:6 signal_neg:i "
       "signal_valley:i signal_shift:i signal_summer:i score_mean:6 score_q25:6 score_median:6 "
       "score_q75:6 score_max:6", "D33", """
    SELECT count(*) AS n_total_customers, sum(is_btm) AS n_btm_detected, avg(is_btm) AS btm_rate,
      sum(signal_neg) AS signal_neg, sum(signal_valley) AS signal_valley,
      sum(signal_shift) AS signal_shift, sum(signal_summer) AS signal_summer,
      avg(btm_score) AS score_mean, quantile_cont(btm_score, 0.25) AS score_q25,
      quantile_cont(btm_score, 0.5) AS score_median, quantile_cont(btm_score, 0.75) AS score_q75,
      max(btm_score) AS score_max FROM btm_flags""")
def btm_summary(spark, sf):
    return btm.summary(flags_of(spark, sf))


@query("btm_summary_by_contract", "contract_type n:i n_btm:i btm_rate:6", "D33 B20", """
    SELECT contract_type, count(*) AS n, sum(is_btm) AS n_btm, avg(is_btm) AS btm_rate
    FROM btm_flags GROUP BY contract_type HAVING count(*) >= 10""")
def btm_summary_by_contract(spark, sf):
    return btm.summary_by_contract(flags_of(spark, sf))


ctes.add("ingest_btm", """
    SELECT *, CASE WHEN btm_other_avg > 0 THEN btm_midday_avg / btm_other_avg ELSE 1 END AS btm_midday_ratio
    FROM (SELECT customer_id, count_if(p_active_kwh < 0) AS btm_neg_count,
            count_if(p_active_kwh < 0) / count(*) AS btm_neg_rate,
            coalesce(avg(p_active_kwh) FILTER (WHERE hour(ts) BETWEEN 10 AND 14), 0) AS btm_midday_avg,
            coalesce(avg(p_active_kwh) FILTER (WHERE hour(ts) NOT BETWEEN 10 AND 14), 0) AS btm_other_avg
          FROM readings WHERE p_active_kwh IS NOT NULL GROUP BY customer_id)""")
ctes.add("ingest_flags", """
    SELECT *, CASE WHEN btm_neg_count > 0 OR low = 1 THEN 1 ELSE 0 END AS is_btm,
           CASE WHEN btm_neg_count > 0 THEN 0.5 ELSE 0 END + 0.5 * low AS btm_score
    FROM (SELECT *, CASE WHEN btm_midday_ratio < (SELECT avg(btm_midday_ratio)
            - 2 * stddev_samp(btm_midday_ratio) FROM ingest_btm) THEN 1 ELSE 0 END AS low
          FROM ingest_btm)""")


@query("btm_ingest_signals", "customer_id btm_neg_count:i btm_neg_rate:8 btm_midday_avg:6 "
       "btm_other_avg:6 btm_midday_ratio:6 is_btm:i btm_score:2", "D6 D34 Q17",
       "SELECT * FROM ingest_flags")
def btm_ingest_signals(spark, sf):
    return btm.ingest_rule(btm.ingest_signals(t.readings(spark, sf)))


@query("btm_policies", "policy n:i n_customers:i total:4", "B19 C4", """
    SELECT 'exclude' AS policy, count(*) AS n, count(DISTINCT customer_id) AS n_customers,
           sum(monthly_kwh) AS total FROM monthly
    WHERE customer_id NOT IN (SELECT customer_id FROM ingest_flags WHERE is_btm = 1)
    UNION ALL SELECT 'flag', count(*), count(DISTINCT customer_id), sum(is_btm)
      FROM monthly LEFT JOIN ingest_flags USING (customer_id)
    UNION ALL SELECT 'score', count(*), count(DISTINCT customer_id), sum(btm_score)
      FROM monthly LEFT JOIN ingest_flags USING (customer_id)""")
def btm_policies(spark, sf):
    r = t.readings(spark, sf)
    flags = btm.ingest_rule(btm.ingest_signals(r))
    m = rollup.monthly_by_customer(rollup.daily_by_customer(r))
    parts = []
    for policy, col in (("exclude", "monthly_kwh"), ("flag", "is_btm"), ("score", "btm_score")):
        parts.append(clean.btm_policy(m, flags, policy).agg(
            F.lit(policy).alias("policy"), F.count(F.lit(1)).alias("n"),
            F.countDistinct("customer_id").alias("n_customers"),
            F.sum(F.col(col).cast("double")).alias("total")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ctes.add("gen_hour", """
    SELECT date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS total_solar_mw,
           count_if(event_type = 'view')::DOUBLE AS market_solar_mw FROM events GROUP BY 1""")


def generation(spark, sf):
    e = t.table(spark, sf, "events")
    return e.groupBy(cal.floor_hour(F.col("ts")).alias("ts")).agg(
        F.count(F.lit(1)).cast("double").alias("total_solar_mw"),
        F.sum(F.when(F.col("event_type") == "view", 1.0).otherwise(0.0)).alias("market_solar_mw"))


@query("hidden_generation_monthly", "year_month:s btm_mwh:4 btm_peak_mw:4 btm_mean_mw:6 "
       "total_solar_mwh:4 market_mwh:4 n_hours:i btm_ratio:6", "A10", """
    SELECT date_trunc('month', ts)::DATE AS year_month, sum(total_solar_mw - market_solar_mw) AS btm_mwh,
      max(total_solar_mw - market_solar_mw) AS btm_peak_mw,
      avg(total_solar_mw - market_solar_mw) AS btm_mean_mw, sum(total_solar_mw) AS total_solar_mwh,
      sum(market_solar_mw) AS market_mwh, count(*) AS n_hours,
      sum(total_solar_mw - market_solar_mw) / greatest(sum(total_solar_mw), 1) AS btm_ratio
    FROM gen_hour GROUP BY 1""")
def hidden_generation_monthly(spark, sf):
    return btm.hidden_generation_monthly(generation(spark, sf))
