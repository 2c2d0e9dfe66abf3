"""Roll-up, horizon, alarm, baseline and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.functions import calendar as cal
from loadlens.functions.scalars import scale_bin
from loadlens.operators import alarm as al, baselines, horizon as hz, metrics, rollup
from loadlens.plans.catalog import ctes
from loadlens.plans.catalog.base import query
from loadlens.session import write_and_read
from loadlens.sources import tables as t


def daily_of(spark, sf):
    return rollup.daily_by_customer(t.readings(spark, sf))


def context_of(spark, sf):
    return hz.calendar_context(daily_of(spark, sf))


def results_of(spark, sf, model="partial_linear", daily=None):
    """Context with the prediction of one model and its errors."""
    ctx = context_of(spark, sf) if daily is None else hz.calendar_context(daily)
    return metrics.error_columns(ctx.withColumn("pred_monthly_kwh",
                                                baselines.BASELINES[model]()))


@query("daily_rollup", "customer_id contract_type date:s day_kwh:4", "D1",
       "SELECT * FROM daily")
def daily_rollup(spark, sf):
    return daily_of(spark, sf)


@query("monthly_rollup", "customer_id contract_type year_month:s monthly_kwh:4", "D2",
       "SELECT * FROM monthly")
def monthly_rollup(spark, sf):
    return rollup.monthly_by_customer(daily_of(spark, sf))


HORIZON_COLS = ("customer_id year_month:s contract_type horizon_days:i partial_kwh:4 "
                "full_month_kwh:4 days_in_month:i calendar_days:i days_observed:i "
                "remainder_kwh:4")


@query("horizon_table", HORIZON_COLS, "D3 C1 F5", "SELECT * FROM horizon")
def horizon_table(spark, sf):
    return hz.build_horizon_table(daily_of(spark, sf))


ctes.add("horizon15", ctes.horizon_sql("daily", """CASE WHEN day(date) >= 15
           THEN (date_trunc('month', date) + INTERVAL 14 DAY)::DATE
           ELSE (date_trunc('month', date) - INTERVAL 1 MONTH + INTERVAL 14 DAY)::DATE END"""))


@query("horizon_meter_day_15", HORIZON_COLS, "D3 Q4", "SELECT * FROM horizon15")
def horizon_meter_day(spark, sf):
    return hz.build_horizon_table(daily_of(spark, sf), meter_day=15)


@query("horizon_customer_meter_day", HORIZON_COLS, "D3 Q3",
       ctes.horizon_sql("(SELECT *, 1 + CAST(substr(customer_id, 2) AS INTEGER) % 28 AS md FROM daily)",
                        """CASE WHEN day(date) >= md
           THEN (date_trunc('month', date) + to_days(CAST(md - 1 AS INTEGER)))::DATE
           ELSE (date_trunc('month', date) - INTERVAL 1 MONTH + to_days(CAST(md - 1 AS INTEGER)))::DATE
           END"""))
def horizon_customer_meter_day(spark, sf):
    md = 1 + F.substring("customer_id", 2, 20).cast("int") % 28
    return hz.build_horizon_table(daily_of(spark, sf).withColumn("meter_reading_day", md),
                                  meter_day_col="meter_reading_day")


@query("horizon_days_present", HORIZON_COLS, "D3 Q5",
       ctes.horizon_sql("daily", "date_trunc('month', date)::DATE", observed="n_obs"))
def horizon_days_present(spark, sf):
    return hz.build_horizon_table(daily_of(spark, sf), observed_basis="present")


@query("alarm_context", "customer_id year_month:s horizon_days:i prev_month_kwh:4 "
       "yoy_month_kwh:4 ma3_kwh:6", "C2 E3 E4", "SELECT * FROM ctx")
def alarm_context(spark, sf):
    return context_of(spark, sf)


@query("alarm_context_meter_day_15", "customer_id year_month:s horizon_days:i prev_month_kwh:4 "
       "yoy_month_kwh:4 ma3_kwh:6", "C2 D3", """
    SELECT h.*, a.monthly_kwh AS prev_month_kwh, y.monthly_kwh AS yoy_month_kwh,
           (SELECT avg(m.monthly_kwh) FROM monthly m WHERE m.customer_id = h.customer_id
              AND m.year_month < h.year_month
              AND m.year_month >= h.year_month - INTERVAL 3 MONTH) AS ma3_kwh
    FROM horizon15 h
    LEFT JOIN monthly a ON a.customer_id = h.customer_id
         AND a.year_month = h.year_month - INTERVAL 1 MONTH
    LEFT JOIN monthly y ON y.customer_id = h.customer_id
         AND y.year_month = h.year_month - INTERVAL 12 MONTH""")
def alarm_context_meter_day(spark, sf):
    daily = daily_of(spark, sf)
    return hz.attach_alarm_context(hz.build_horizon_table(daily, meter_day=15),
                                   rollup.monthly_by_customer(daily))


@query("calendar_lags", "customer_id year_month:s monthly_kwh:4 prev_month_kwh:4 "
       "yoy_month_kwh:4 ma3_kwh:6 customer_mean_history:6", "C2 E3 E4 E10", """
    SELECT m.customer_id, m.year_month, m.monthly_kwh, a.monthly_kwh AS prev_month_kwh,
           y.monthly_kwh AS yoy_month_kwh,
           (SELECT avg(x.monthly_kwh) FROM monthly x WHERE x.customer_id = m.customer_id
              AND x.year_month < m.year_month
              AND x.year_month >= m.year_month - INTERVAL 3 MONTH) AS ma3_kwh,
           avg(m.monthly_kwh) OVER (PARTITION BY m.customer_id ORDER BY m.year_month
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS customer_mean_history
    FROM monthly m
    LEFT JOIN monthly a ON a.customer_id = m.customer_id
         AND a.year_month = m.year_month - INTERVAL 1 MONTH
    LEFT JOIN monthly y ON y.customer_id = m.customer_id
         AND y.year_month = m.year_month - INTERVAL 12 MONTH""")
def calendar_lags(spark, sf):
    return hz.calendar_lags(rollup.monthly_by_customer(daily_of(spark, sf)))


@query("row_lags", "customer_id year_month:s monthly_kwh:4 prev_m:4 prev_year_same_m:4 ma3:6",
       "E1 E2 E4", """
    SELECT *, lag(monthly_kwh, 1) OVER w AS prev_m, lag(monthly_kwh, 12) OVER w AS prev_year_same_m,
           CASE WHEN count(*) OVER p = 3 THEN avg(monthly_kwh) OVER p END AS ma3
    FROM monthly
    WINDOW w AS (PARTITION BY customer_id ORDER BY year_month),
           p AS (PARTITION BY customer_id ORDER BY year_month
                 ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def row_lags(spark, sf):
    return hz.row_lags(rollup.monthly_by_customer(daily_of(spark, sf)))


@query("cumulative_in_month", "customer_id date:s year_month:s day_kwh:4 cum_kwh:4", "E5", """
    SELECT *, date_trunc('month', date)::DATE AS year_month, sum(day_kwh) OVER (
        PARTITION BY customer_id, date_trunc('month', date) ORDER BY date) AS cum_kwh
    FROM daily""")
def cumulative_in_month(spark, sf):
    return rollup.cumulative_in_month(daily_of(spark, sf))


@query("alarm_labels", "customer_id year_month:s horizon_days:i pred_monthly_kwh:4 "
       "pred_prev:i pred_yoy:i pred_ma:i pred_any:i true_any:i", "H12 J4 C17",
       "SELECT * FROM labelled WHERE model = 'partial_linear'")
def alarm_labels(spark, sf):
    return metrics.labelled(results_of(spark, sf))


@query("baseline_predictions", "customer_id year_month:s horizon_days:i model "
       "pred_monthly_kwh:4", "J1 J2 J3 J4 J5 J6", "SELECT * FROM preds")
def baseline_predictions(spark, sf):
    return baselines.predict_all(context_of(spark, sf))


@query("baseline_evaluation", f"model horizon_days:i contract_type {ctes.REG_COLS} "
       f"{ctes.conf_cols()}", "J6 D11 D13 D14", f"""
    SELECT model, horizon_days, contract_type, {ctes.regression()}, {ctes.confusion()}
    FROM labelled GROUP BY model, horizon_days, contract_type""")
def baseline_evaluation(spark, sf):
    return baselines.evaluate_all(context_of(spark, sf))


@query("overuse_alarm_evaluation", f"horizon_days:i contract_type {ctes.REG_COLS} "
       f"{ctes.conf_cols()}", "D1 D2 D3 C2 C17 J4 H12 D14", f"""
    SELECT horizon_days, contract_type, {ctes.regression()}, {ctes.confusion()}
    FROM labelled WHERE model = 'partial_linear' GROUP BY horizon_days, contract_type""")
def overuse_alarm_evaluation(spark, sf):
    rows = context_of(spark, sf).withColumn("pred_monthly_kwh", baselines.partial_linear())
    return metrics.evaluate_rows(rows)


@query("evaluate_prediction_table", f"horizon_days:i contract_type {ctes.REG_COLS} "
       f"{ctes.conf_cols()}", "C17 D14", f"""
    SELECT horizon_days, contract_type, {ctes.regression()}, {ctes.confusion()}
    FROM labelled WHERE model = 'moving_avg3' GROUP BY horizon_days, contract_type""")
def evaluate_prediction_table(spark, sf):
    ctx = context_of(spark, sf)
    return metrics.evaluate(baselines.predict(ctx, "moving_avg3"), ctx)


SCALE_SQL = """CASE WHEN full_month_kwh < 0 THEN NULL WHEN full_month_kwh < 100 THEN '0-100'
    WHEN full_month_kwh < 1000 THEN '100-1K' WHEN full_month_kwh < 10000 THEN '1K-10K'
    ELSE '10K+' END"""
ctes.add("results", f"""
    SELECT *, month(year_month) AS month, {SCALE_SQL} AS scale
    FROM labelled WHERE model = 'partial_linear'""")

DIMENSIONS = {
    "overall": [], "by_horizon": ["horizon_days"], "by_month": ["month"],
    "by_scale": ["scale"], "by_scale_horizon": ["scale", "horizon_days"],
    "by_contract": ["contract_type"], "by_cold_start": ["cold_start"],
}
ctes.add("cold", """
    SELECT r.*, CASE WHEN r.customer_id IN (SELECT customer_id FROM daily WHERE date <=
        make_date(year((SELECT max(date) FROM daily)) - 1, 12, 31))
      THEN 'existing' ELSE 'cold_start' END AS cold_start
    FROM results r""")


def with_cold_start(results, daily):
    """Mark customers without a reading up to the end of the year before the last."""
    last = daily.agg(F.max("date").alias("_last"))
    early = (daily.join(F.broadcast(last))  # one row
             .where(F.year("date") < F.year("_last"))
             .select("customer_id").distinct().withColumn("_early", F.lit(True)))
    return results.join(early, "customer_id", "left").withColumn(
        "cold_start", F.when(F.col("_early"), "existing").otherwise("cold_start")).drop("_early")


def dim_results(spark, sf):
    # The daily table is written: the context, the first days and the last date read it, and
    # the readings are read once.
    daily = write_and_read(daily_of(spark, sf), "daily")
    r = results_of(spark, sf, daily=daily).withColumn("scale", scale_bin(F.col("full_month_kwh")))
    return with_cold_start(r, daily)


KEYS = "dimension horizon_days:i month:i scale contract_type cold_start"
CONDS = " ".join(ctes.conf_cols(f"cond_{c}") for c in al.CONDITIONS)
COND_SQL = ", ".join(ctes.confusion(c, f"cond_{c}") for c in al.CONDITIONS)
DIM_COLS = ("horizon_days", "month", "scale", "contract_type", "cold_start")


def dim_union(select: str, source: str) -> str:
    """One SELECT per dimension, stacked."""
    parts = []
    for name, cols in DIMENSIONS.items():
        keys = ", ".join(c if c in cols else f"NULL AS {c}" for c in DIM_COLS)
        where = " AND ".join(f"{c} IS NOT NULL" for c in cols) or "true"
        group = f"GROUP BY {', '.join(cols)}" if cols else ""
        parts.append(f"SELECT '{name}' AS dimension, {keys}, {select} FROM {source} "
                     f"WHERE {where} {group}")
    return "\nUNION ALL BY NAME\n".join(parts)


@query("error_by_dimension", f"{KEYS} n_customers:i {ctes.REG_COLS} {ctes.conf_cols()} {CONDS}",
       "D15 D16 H9 C16", dim_union(
           f"count(DISTINCT customer_id) AS n_customers, {ctes.regression()}, "
           f"{ctes.confusion()}, {COND_SQL}", "cold"))
def error_by_dimension(spark, sf):
    return metrics.error_by_dimension(dim_results(spark, sf), DIMENSIONS)


ctes.add("cust_cv", f"""
    SELECT {', '.join(DIM_COLS)}, dimension, customer_id,
           sqrt(avg((pred_monthly_kwh - full_month_kwh)^2)) / avg(full_month_kwh) * 100 AS cv
    FROM (""" + "\nUNION ALL BY NAME\n".join(
        f"SELECT '{n}' AS dimension, customer_id, full_month_kwh, pred_monthly_kwh, "
        + ", ".join(c if c in cols else f"NULL AS {c}" for c in DIM_COLS)
        + f" FROM cold WHERE {ctes.OK} AND "
        + (" AND ".join(f"{c} IS NOT NULL" for c in cols) or "true")
        for n, cols in DIMENSIONS.items()) + """)
    GROUP BY ALL HAVING count(*) >= 2""")


@query("customer_cvrmse_spread", f"{KEYS} cvrmse_q25_pct:4 cvrmse_median_pct:4 cvrmse_q75_pct:4",
       "D12 D15", f"""
    SELECT dimension, {', '.join(DIM_COLS)}, quantile_cont(cv, 0.25) AS cvrmse_q25_pct,
           quantile_cont(cv, 0.5) AS cvrmse_median_pct, quantile_cont(cv, 0.75) AS cvrmse_q75_pct
    FROM cust_cv GROUP BY ALL""")
def customer_cvrmse_spread(spark, sf):
    out = metrics.error_by_dimension(dim_results(spark, sf), DIMENSIONS,
                                     with_conditions=False, with_spread=True)
    return out.where(F.col("cvrmse_median_pct").isNotNull())


@query("error_scale_horizon_month", "scale horizon_days:i month:i n:i mape_pct:4 rmse:4 "
       "cvrmse_pct:4", "D17", f"""
    SELECT scale, horizon_days, month, {ctes.regression()} FROM results
    WHERE scale IS NOT NULL GROUP BY scale, horizon_days, month""")
def error_scale_horizon_month(spark, sf):
    r = results_of(spark, sf).withColumn("scale", scale_bin(F.col("full_month_kwh")))
    return rollup.not_null(r, "scale").groupBy("scale", "horizon_days", "month").agg(
        *metrics.regression_aggs())
