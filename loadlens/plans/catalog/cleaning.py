"""Schema, cleaning, split, calendar and policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens import schema
from loadlens.functions import calendar as cal
from loadlens.operators import calendar_days, clean, horizon as hz, rollup
from loadlens.plans.catalog import ctes
from loadlens.plans.catalog.base import query
from loadlens.plans.catalog.core import daily_of
from loadlens.sources import tables as t
from loadlens.sources.readings import grid_ts

# Spellings of contract types as they appear in source systems, and their names.
RAW_SPELLINGS = (
    ("주택", "주택용"), ("주택용 저압", "주택용"), (" 주택용[고압] ", "주택용(고압)"),
    ("일반용_갑1", "일반용(갑)I"), ("일반용(갑)Ⅱ", "일반용(갑)II"), ("일반용【을】", "일반용(을)"),
    ("일반용-(을) 고압A", "일반용(을)고압A"), ("산업용 {병}", "산업용 (병)"),
)


@query("contract_normalize", "c_custkey raw_type contract_type is_known:i", "B1 G4", f"""
    SELECT c_custkey, {ctes.case_mod('c_custkey % 8', [a for a, _ in RAW_SPELLINGS])} AS raw_type,
           {ctes.case_mod('c_custkey % 8', [b for _, b in RAW_SPELLINGS])} AS contract_type,
           c_custkey % 8 <> 7 AS is_known
    FROM customer""")
def contract_normalize(spark, sf):
    c = t.table(spark, sf, "customer").select("c_custkey")
    raw = c.withColumn("raw_type", t.pick(tuple(a for a, _ in RAW_SPELLINGS),
                                          F.col("c_custkey") % 8))
    # Few distinct spellings: the expression runs on them once and is looked up by the rows.
    names = raw.select("raw_type").distinct().withColumn(
        "contract_type", schema.normalize_contract_type(F.col("raw_type")))
    return raw.join(names, "raw_type").withColumn(
        "is_known", F.col("contract_type").isin(*schema.CONTRACT_TYPES))


ctes.add("with_unknown", """
    SELECT * REPLACE (CASE WHEN CAST(substr(customer_id, 2) AS BIGINT) % 7 = 3 THEN '기타'
                      ELSE contract_type END AS contract_type) FROM readings""")


def with_unknown(spark, sf):
    """Readings in which every seventh customer has a contract type that no tariff knows."""
    key = F.substring("customer_id", 2, 20).cast("bigint")
    return t.readings(spark, sf).withColumn(
        "contract_type", F.when(key % 7 == 3, "기타").otherwise(F.col("contract_type")))


@query("schema_report", "n_rows:i n_customers:i ts_min:s ts_max:s n_negative:i "
       "n_unknown_contract:i", "B2 G3", """
    SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers, min(ts) AS ts_min,
           max(ts) AS ts_max, count_if(p_active_kwh < 0) AS n_negative,
           count_if(contract_type = '기타') AS n_unknown_contract
    FROM with_unknown""")
def schema_report(spark, sf):
    return schema.validate(with_unknown(spark, sf), strict=False)


@query("contract_type_counts", "contract_type n_rows:i is_known:i", "B2 G4", """
    SELECT contract_type, count(*) AS n_rows, contract_type <> '기타' AS is_known
    FROM with_unknown GROUP BY contract_type""")
def contract_type_counts(spark, sf):
    return schema.contract_counts(with_unknown(spark, sf))


@query("optional_columns_added", "n_rows:i n_demand:i n_households:i demand:4", "B3", """
    SELECT count(*) AS n_rows, count(max_demand_kw) AS n_demand, 0 AS n_households,
           sum(max_demand_kw) AS demand FROM readings_hf""")
def optional_columns_added(spark, sf):
    """A column that is there stays as it is, one that is missing is added as nulls."""
    d = schema.ensure_columns(t.readings_hf(spark, sf), ("max_demand_kw", "n_households"))
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count("max_demand_kw").alias("n_demand"),
                 F.count("n_households").alias("n_households"), F.sum("max_demand_kw").alias("demand"))


ctes.add("raw_clock", """
    SELECT event_id, ts::DATE AS d, hour(ts) AS h, minute(ts) // 15 * 15 AS m,
           event_id % 7 AS k, event_id % 3 AS s FROM events""")


@query("ts_compose", "event_id date_text time_text ts:s", "B4", """
    SELECT event_id,
      CASE s WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y%m%d')
             ELSE strftime(d, '%Y/%m/%d') END AS date_text,
      CASE WHEN k = 6 THEN 'abc' WHEN k = 5 THEN NULL
           WHEN k IN (3, 4) AND h = 23 THEN CASE k WHEN 3 THEN '24:00' ELSE '2400' END
           WHEN k IN (0, 3) THEN h || ':' || lpad(CAST(m AS VARCHAR), 2, '0')
           WHEN k = 1 THEN CAST(h * 100 + m AS VARCHAR)
           WHEN k = 2 THEN lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0')
                || ':00'
           ELSE lpad(CAST(h * 100 + m AS VARCHAR), 4, '0') END AS time_text,
      CASE WHEN k >= 5 THEN NULL
           WHEN k IN (3, 4) AND h = 23 THEN CAST(d + 1 AS TIMESTAMP)
           ELSE CAST(d AS TIMESTAMP) + to_hours(h) + to_minutes(m) END AS ts
    FROM raw_clock""")
def ts_compose(spark, sf):
    e = t.table(spark, sf, "events").select("event_id", "ts")
    h, m, k = F.hour("ts"), F.floor(F.minute("ts") / 15) * 15, F.col("event_id") % 7
    s = F.col("event_id") % 3
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hhmm = (h * 100 + m).cast("string")
    raw = e.select(
        "event_id",
        F.when(s == 0, F.date_format("ts", "yyyy-MM-dd")).when(s == 1, F.date_format("ts", "yyyyMMdd"))
        .otherwise(F.date_format("ts", "yyyy/MM/dd")).alias("date_text"),
        F.when(k == 6, "abc").when(k == 5, None)
        .when((k == 3) & (h == 23), "24:00").when((k == 4) & (h == 23), "2400")
        .when(k.isin(0, 3), F.concat(h.cast("string"), F.lit(":"), two(m)))
        .when(k == 1, hhmm)
        .when(k == 2, F.concat(two(h), F.lit(":"), two(m), F.lit(":00")))
        .otherwise(F.lpad(hhmm, 4, "0")).alias("time_text"))
    return raw.withColumn("ts", clean.compose_ts(F.col("date_text"), F.col("time_text")))


@query("hour_ending_clock", "event_id ts:s", "A2 Q8", """
    SELECT event_id, date_trunc('hour', ts) AS ts FROM events""")
def hour_ending_clock(spark, sf):
    """Year, month, day and an hour 1..24 as text come back as the beginning of the hour."""
    e = t.table(spark, sf, "events")
    text = [f("ts").cast("string") for f in (F.year, F.month, F.dayofmonth)]
    return e.select("event_id", grid_ts(*text, (F.hour("ts") + 1).cast("string")).alias("ts"))


@query("align_interval", "event_id ts_slot:s", "B5",
       "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts_slot FROM events")
def align_interval(spark, sf):
    return t.table(spark, sf, "events").select(
        "event_id", cal.floor_minutes(F.col("ts"), 15).alias("ts_slot"))


@query("interval_grid_coverage", "date:s n_slots:i n_hit:i", "B6", """
    SELECT g::DATE AS date, count(*) AS n_slots, count(h.ts) AS n_hit
    FROM (SELECT unnest(generate_series((SELECT min(ts) FROM readings_hf),
              (SELECT max(ts) FROM readings_hf), INTERVAL 15 MINUTE)) AS g)
    LEFT JOIN (SELECT DISTINCT ts FROM readings_hf) h ON h.ts = g GROUP BY 1""")
def interval_grid_coverage(spark, sf):
    d = t.readings_hf(spark, sf).select("ts")
    span = d.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b", F.make_dt_interval(mins=F.lit(15))))
                       .alias("ts"))
    hit = d.distinct().withColumn("_hit", F.lit(1))
    return grid.join(hit, "ts", "left").groupBy(F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n_slots"), F.count("_hit").alias("n_hit"))


ctes.add("dedup", """
    SELECT * FROM readings
    QUALIFY row_number() OVER (PARTITION BY customer_id, ts ORDER BY seq DESC) = 1""")
ctes.add("numbered", """
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ts) AS i FROM dedup""")
ctes.add("neighbours", """
    SELECT *,
      last_value(CASE WHEN p_active_kwh IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi,
      last_value(p_active_kwh IGNORE NULLS) OVER b AS pv,
      first_value(CASE WHEN p_active_kwh IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni,
      first_value(p_active_kwh IGNORE NULLS) OVER f AS nv
    FROM numbered
    WINDOW b AS (PARTITION BY customer_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           f AS (PARTITION BY customer_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
ctes.add("filled", """
    SELECT customer_id, ts, contract_type, p_active_kwh AS raw_kwh, pv,
      CASE WHEN p_active_kwh IS NOT NULL THEN p_active_kwh
           WHEN pi IS NULL OR i - pi > 24 THEN NULL
           WHEN ni IS NULL THEN pv
           ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END AS p_active_kwh
    FROM neighbours""")


def slim(spark, sf):
    """The columns a cleaning step needs: the rest would ride through its shuffles."""
    return t.readings(spark, sf).select("customer_id", "ts", "p_active_kwh", "ingest_seq")


READ = "customer_id ts:s p_active_kwh:6"


@query("dedup_keep_last", "customer_id ts:s p_active_kwh:6 p_reactive_kwh:6", "B7",
       "SELECT * FROM dedup")
def dedup_keep_last(spark, sf):
    return clean.remove_duplicates(t.readings(spark, sf))


@query("interpolate_missing", READ, "B8 P14", "SELECT * FROM filled")
def interpolate_missing(spark, sf):
    return clean.interpolate(clean.remove_duplicates(slim(spark, sf)))


@query("interpolate_short_gap_limit", READ, "B8 P14", """
    SELECT customer_id, ts, CASE WHEN p_active_kwh IS NOT NULL THEN p_active_kwh
           WHEN pi IS NULL OR i - pi > 1 THEN NULL WHEN ni IS NULL THEN pv
           ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END AS p_active_kwh FROM neighbours""")
def interpolate_short_gap_limit(spark, sf):
    return clean.interpolate(clean.remove_duplicates(slim(spark, sf)), limit=1)


@query("forward_fill", READ, "B8 E12", "SELECT customer_id, ts, pv AS p_active_kwh FROM neighbours")
def forward_fill(spark, sf):
    return clean.forward_fill(clean.remove_duplicates(slim(spark, sf)))


@query("missing_drop_and_zero", "method n:i total:4", "B8", """
    SELECT 'drop' AS method, count(p_active_kwh) AS n, sum(p_active_kwh) AS total FROM readings
    UNION ALL SELECT 'zero', count(*), sum(coalesce(p_active_kwh, 0)) FROM readings""")
def missing_drop_and_zero(spark, sf):
    r = t.readings(spark, sf)
    parts = [clean.handle_missing(r, m).agg(
        F.lit(m).alias("method"), F.count("p_active_kwh").alias("n"),
        F.sum("p_active_kwh").alias("total")) for m in ("drop", "zero")]
    return parts[0].unionByName(parts[1])


def outlier(name: str, ids: str, sql: str):
    @query(f"outlier_{name}", READ, ids, sql)
    def build(spark, sf):
        return clean.remove_outliers(clean.remove_duplicates(slim(spark, sf)), name)

    return build


outlier("iqr", "B9", """
    SELECT d.* FROM dedup d JOIN (
      SELECT customer_id, quantile_cont(p_active_kwh, 0.25) AS q1,
             quantile_cont(p_active_kwh, 0.75) AS q3 FROM dedup GROUP BY customer_id) q
    USING (customer_id)
    WHERE p_active_kwh >= least(q1 - 3 * (q3 - q1), 0) AND p_active_kwh <= q3 + 3 * (q3 - q1)""")
outlier("zscore", "B10", """
    SELECT d.* FROM dedup d JOIN (SELECT customer_id, avg(p_active_kwh) AS m,
             stddev_samp(p_active_kwh) AS sd FROM dedup GROUP BY customer_id) q USING (customer_id)
    WHERE sd = 0 OR abs(p_active_kwh - m) / nullif(sd, 0) <= 4""")
outlier("jump", "B11", """
    SELECT * FROM (SELECT *, lag(p_active_kwh) OVER (PARTITION BY customer_id ORDER BY ts) AS p
                   FROM dedup)
    WHERE p IS NULL OR (p_active_kwh / CASE WHEN p < 1e-9 THEN 1e-9 ELSE p END < 10
                        AND p_active_kwh / CASE WHEN p < 1e-9 THEN 1e-9 ELSE p END > 0.1)""")
outlier("quantile", "B12", """
    SELECT d.* FROM dedup d JOIN (SELECT customer_id, quantile_cont(p_active_kwh, 0.001) AS a,
             quantile_cont(p_active_kwh, 0.999) AS b FROM dedup GROUP BY customer_id) q
    USING (customer_id) WHERE p_active_kwh BETWEEN a AND b""")


@query("fill_time_gaps", "customer_id n_slots:i n_filled:i total:4", "B13", """
    SELECT customer_id, count(*) AS n_slots, count(p_active_kwh) AS n_filled,
           sum(p_active_kwh) AS total
    FROM (SELECT customer_id, unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTE)) AS ts
          FROM readings_hf GROUP BY customer_id)
    LEFT JOIN (SELECT * FROM readings_hf QUALIFY row_number() OVER (
        PARTITION BY customer_id, ts ORDER BY seq DESC) = 1) USING (customer_id, ts)
    GROUP BY customer_id""")
def fill_time_gaps(spark, sf):
    d = clean.remove_duplicates(t.readings_hf(spark, sf))
    return clean.fill_time_gaps(d).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_slots"), F.count("p_active_kwh").alias("n_filled"),
        F.sum("p_active_kwh").alias("total"))


ctes.add("bounds", """
    SELECT customer_id, quantile_cont(p_active_kwh, 0.25) AS q1,
           quantile_cont(p_active_kwh, 0.75) AS q3 FROM filled GROUP BY customer_id""")
ctes.add("kept", """
    SELECT f.* FROM filled f JOIN bounds USING (customer_id)
    WHERE p_active_kwh >= least(q1 - 3 * (q3 - q1), 0) AND p_active_kwh <= q3 + 3 * (q3 - q1)""")


@query("clean_readings", READ, "B14", "SELECT * FROM kept")
def clean_readings(spark, sf):
    return clean.cleaned(clean.preprocess_marked(slim(spark, sf), keep_seq=False))


@query("clean_step_log", "step removed:i", "B14", """
    SELECT 'original_rows' AS step, (SELECT count(*) FROM readings) AS removed
    UNION ALL SELECT 'remove_duplicates', (SELECT count(*) FROM readings) - (SELECT count(*) FROM dedup)
    UNION ALL SELECT 'fill_time_gaps', 0
    UNION ALL SELECT 'handle_missing',
        (SELECT count(*) FROM filled WHERE raw_kwh IS NULL AND p_active_kwh IS NOT NULL)
    UNION ALL SELECT 'remove_outliers', (SELECT count(*) FROM filled) - (SELECT count(*) FROM kept)
    UNION ALL SELECT 'final_drop_na', 0
    UNION ALL SELECT 'final_rows', (SELECT count(*) FROM kept)""")
def clean_step_log(spark, sf):
    return clean.step_log(clean.preprocess_marked(slim(spark, sf), keep_seq=False))


SPLIT_SQL = """
    SELECT m.*, CASE WHEN year_month <= a.lo + INTERVAL 17 MONTH THEN 'train'
                     WHEN year_month <= a.lo + INTERVAL 23 MONTH THEN 'val' ELSE 'test' END AS split
    FROM monthly m, (SELECT min(year_month) AS lo FROM monthly) a"""
ctes.add("split_months", SPLIT_SQL)


def split_of(spark, sf):
    return clean.with_suggested_split(rollup.monthly_by_customer(daily_of(spark, sf)))


@query("time_split", "split n:i first_month:s last_month:s n_customers:i", "B15 B17", """
    SELECT split, count(*) AS n, min(year_month) AS first_month, max(year_month) AS last_month,
           count(DISTINCT customer_id) AS n_customers FROM split_months GROUP BY split""")
def time_split(spark, sf):
    return split_of(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("year_month").alias("first_month"),
        F.max("year_month").alias("last_month"),
        F.countDistinct("customer_id").alias("n_customers"))


@query("suggest_split", "total_months:i train_end:s val_end:s default_train_end:s", "B17 B18", """
    SELECT date_diff('month', min(year_month), max(year_month)) + 1 AS total_months,
           (min(year_month) + INTERVAL 17 MONTH)::DATE AS train_end,
           (min(year_month) + INTERVAL 23 MONTH)::DATE AS val_end,
           make_date(year(max(year_month)) - 1, 12, 1) AS default_train_end
    FROM monthly""")
def suggest_split(spark, sf):
    return clean.suggest_split(rollup.monthly_by_customer(daily_of(spark, sf)))


@query("leakage_report", "check_name value:i", "G2 C16", """
    SELECT 'overlapping_months' AS check_name, count(*) AS value FROM (
        SELECT year_month FROM split_months WHERE split = 'train'
        INTERSECT SELECT year_month FROM split_months WHERE split = 'test')
    UNION ALL SELECT 'time_inversion', CASE WHEN
        (SELECT min(year_month) FROM split_months WHERE split = 'test')
        <= (SELECT max(year_month) FROM split_months WHERE split = 'train') THEN 1 ELSE 0 END
    UNION ALL SELECT 'cold_start_customers', count(DISTINCT customer_id) FROM split_months
        WHERE split = 'test' AND customer_id NOT IN
              (SELECT customer_id FROM split_months WHERE split = 'train')""")
def leakage_report(spark, sf):
    return clean.leakage_report(split_of(spark, sf))


@query("distinct_keys", "kind n:i", "G3", """
    SELECT 'customers' AS kind, count(DISTINCT customer_id) AS n FROM readings
    UNION ALL SELECT 'months', count(DISTINCT date_trunc('month', ts)) FROM readings
    UNION ALL SELECT 'regions', count(DISTINCT region_code) FROM readings""")
def distinct_keys(spark, sf):
    r = t.readings(spark, sf)
    parts = [r.select(c.alias("v")).where("v is not null").distinct().agg(
        F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k, c in (
        ("customers", F.col("customer_id")), ("months", cal.month_start(F.col("ts")).cast("string")),
        ("regions", F.col("region_code")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("kanonymous_contract_region", "contract_type region_code n:i mean_kwh:6", "B20", """
    SELECT contract_type, region_code, count(p_active_kwh) AS n,
           round(avg(p_active_kwh), 6) AS mean_kwh
    FROM readings GROUP BY ALL HAVING count(p_active_kwh) >= 600""")
def kanonymous(spark, sf):
    g = t.readings(spark, sf).groupBy("contract_type", "region_code").agg(
        F.count("p_active_kwh").alias("n"), F.avg("p_active_kwh").alias("m"))
    return clean.safe_groups(g, "n", 600).withColumn("mean_kwh", clean.export_number(F.col("m")))


@query("numeric_coercion", "event_id k:6 bad:6", "B21", """
    SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
           TRY_CAST(props AS DOUBLE) AS bad FROM events""")
def numeric_coercion(spark, sf):
    return t.table(spark, sf, "events").select(
        "event_id", clean.to_number(F.get_json_object("props", "$.k")).alias("k"),
        clean.to_number(F.col("props")).alias("bad"))


MONTHS_SQL = "SELECT DISTINCT year_month FROM monthly"
ctes.add("cal_days", f"""
    SELECT year_month, d::DATE AS date, isodow(d) AS dow,
           d::DATE IN (SELECT date FROM holiday) AS hol,
           (d - INTERVAL 1 DAY)::DATE IN (SELECT date FROM holiday) AS hol_p,
           (d + INTERVAL 1 DAY)::DATE IN (SELECT date FROM holiday) AS hol_n
    FROM (SELECT year_month, unnest(generate_series(year_month, last_day(year_month),
                 INTERVAL 1 DAY)) AS d FROM ({MONTHS_SQL}))""")
ctes.add("cal_marks", """
    SELECT *, hol OR dow >= 6 AS off,
      NOT (hol OR dow >= 6) AND (hol_p OR (dow + 5) % 7 + 1 >= 6) AND (hol_n OR dow % 7 + 1 >= 6)
        AS bridge FROM cal_days""")
ctes.add("long_runs", """
    SELECT year_month, sum(n) AS n_long FROM (
      SELECT year_month, count(*) AS n FROM (
        SELECT *, date - CAST(row_number() OVER (PARTITION BY year_month ORDER BY date) AS INTEGER)
               AS run FROM cal_marks WHERE off)
      GROUP BY year_month, run HAVING count(*) >= 3) GROUP BY year_month""")
ctes.add("special_days", """
    SELECT c.*, coalesce(n_long, 0) AS n_long_weekend_days,
      (n_workday + n_monday) / n_days AS workday_ratio,
      (n_holiday + n_bridge) / n_days AS holiday_ratio,
      (n_saturday + n_sunday) / n_days AS weekend_ratio,
      (n_holiday + n_bridge + n_holiday_adjacent) / n_days AS disruption_ratio,
      (SELECT count(*) FROM holiday h WHERE date_trunc('month', h.date) = c.year_month
         AND category = 'election') AS n_election,
      (SELECT count(*) FROM holiday h WHERE date_trunc('month', h.date) = c.year_month
         AND category = 'substitute') AS n_substitute,
      (SELECT count(*) FROM holiday h WHERE date_trunc('month', h.date) = c.year_month
         AND category = 'new_2023') AS n_new_holiday
    FROM (SELECT year_month, count(*) AS n_days,
        count_if(NOT bridge AND NOT hol AND dow BETWEEN 2 AND 5) AS n_workday,
        count_if(NOT bridge AND NOT hol AND dow = 1) AS n_monday,
        count_if(NOT hol AND dow = 6) AS n_saturday, count_if(NOT hol AND dow = 7) AS n_sunday,
        count_if(hol) AS n_holiday, count_if(bridge) AS n_bridge,
        count_if(NOT off AND NOT bridge AND (hol_p OR hol_n)) AS n_holiday_adjacent
      FROM cal_marks GROUP BY year_month) c
    LEFT JOIN long_runs USING (year_month)""")
DAY_COUNTS = " ".join(f"n_{k}:i" for k in (
    "days", "workday", "monday", "saturday", "sunday", "holiday", "bridge", "holiday_adjacent",
    "election", "substitute", "new_holiday", "long_weekend_days"))


@query("special_day_features", f"year_month:s {DAY_COUNTS} workday_ratio:6 holiday_ratio:6 "
       "weekend_ratio:6 disruption_ratio:6", "D35 E8 E9 H7 A8", "SELECT * FROM special_days")
def special_day_features(spark, sf):
    months = daily_of(spark, sf).select(cal.month_start(F.col("date")).alias("year_month"))
    return calendar_days.special_day_features(months, t.holidays(spark))


@query("month_features_on_context", "customer_id year_month:s horizon_days:i n_workday:i "
       "n_holiday:i disruption_ratio:6", "C18", """
    SELECT h.customer_id, h.year_month, h.horizon_days, n_workday, n_holiday, disruption_ratio
    FROM horizon h LEFT JOIN special_days USING (year_month)""")
def month_features_on_context(spark, sf):
    rows = hz.build_horizon_table(daily_of(spark, sf))
    sd = calendar_days.special_day_features(rows, t.holidays(spark))
    return rows.join(F.broadcast(sd), "year_month", "left")  # one row per month


@query("reading_time_parts", "hour:i dayofweek:i month:i n:i", "H5", """
    SELECT hour(ts) AS hour, isodow(ts) - 1 AS dayofweek, month(ts) AS month, count(*) AS n
    FROM readings GROUP BY ALL""")
def reading_time_parts(spark, sf):
    return clean.with_time_parts(t.readings(spark, sf)).groupBy(
        "hour", "dayofweek", F.month("ts").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("tou_periods", "season tou_period tou_plain n:i kwh:4", "H2 H3 H6", f"""
    SELECT {ctes.season('month(ts)')} AS season,
           {ctes.tou_rules('ts', 'ts::DATE IN (SELECT date FROM holiday)')} AS tou_period,
           {ctes.tou('ts')} AS tou_plain, count(*) AS n, sum(p_active_kwh) AS kwh
    FROM readings GROUP BY ALL""")
def tou_periods(spark, sf):
    r = t.readings(spark, sf).withColumn("date", F.to_date("ts"))
    off = F.broadcast(t.holidays(spark).select("date").distinct().withColumn("_hol", F.lit(True)))
    season = cal.season(F.month("ts"))
    return r.join(off, "date", "left").groupBy(
        season.alias("season"), cal.tou_with_day_rules(F.col("ts"), F.col("_hol")).alias("tou_period"),
        cal.classify_tou(F.hour("ts"), season).alias("tou_plain"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("p_active_kwh").alias("kwh"))
