"""Named SQL parts of the comparison statements, written for DuckDB.

They state each table from its definition and share nothing with the Spark
plans but the fixed values.
"""

from __future__ import annotations

import re

from loadlens.operators.baselines import BASELINES  # names only
from loadlens.sources import tables as t


def case_mod(expr: str, values) -> str:
    """CASE over ``expr`` = 0, 1, 2, ..."""
    arms = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


def lit(v) -> str:
    if v is None:
        return "NULL"
    return f"'{v}'" if isinstance(v, str) else str(v)


def values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({names})"


def season(month: str) -> str:
    return (f"CASE WHEN {month} IN (6,7,8) THEN 'summer' "
            f"WHEN {month} IN (3,4,5,9,10) THEN 'spring_fall' ELSE 'winter' END")


def tou(ts: str) -> str:
    """Period by hour and month from the published hour bands."""
    h, m = f"hour({ts})", f"month({ts})"
    winter = f"{m} IN (11,12,1,2)"
    return (f"CASE WHEN {h} >= 23 OR {h} < 9 THEN 'off_peak' "
            f"WHEN {winter} AND ({h} IN (10,11) OR {h} BETWEEN 17 AND 19 OR {h} = 22) THEN 'on_peak' "
            f"WHEN NOT ({winter}) AND ({h} IN (10,11) OR {h} BETWEEN 13 AND 16) THEN 'on_peak' "
            f"ELSE 'mid_peak' END")


def tou_rules(ts: str, holiday: str = "false") -> str:
    return (f"CASE WHEN isodow({ts}) = 7 OR {holiday} THEN 'off_peak' "
            f"WHEN isodow({ts}) = 6 AND ({tou(ts)}) = 'on_peak' THEN 'mid_peak' "
            f"ELSE {tou(ts)} END")


def alarm(x: str, prefix: str) -> str:
    return (f"coalesce({x} > 1.3*prev_month_kwh, false) AS {prefix}_prev, "
            f"coalesce({x} > 1.3*yoy_month_kwh, false) AS {prefix}_yoy, "
            f"coalesce({x} > 1.5*ma3_kwh, false) AS {prefix}_ma, "
            f"coalesce({x} > 1.3*prev_month_kwh, false) OR coalesce({x} > 1.3*yoy_month_kwh, false) "
            f"OR coalesce({x} > 1.5*ma3_kwh, false) AS {prefix}_any")


OK = "(full_month_kwh > 0 AND pred_monthly_kwh IS NOT NULL)"


def regression() -> str:
    e = "(pred_monthly_kwh - full_month_kwh)"
    f = f"FILTER (WHERE {OK})"
    rmse = f"sqrt(avg({e}*{e}) {f})"
    return f"""count(*) {f} AS n, avg(abs({e})) {f} AS mae, {rmse} AS rmse,
    {rmse} / avg(full_month_kwh) {f} * 100 AS nrmse_pct,
    {rmse} / avg(full_month_kwh) {f} * 100 AS cvrmse_pct,
    avg(abs({e}) / nullif(full_month_kwh, 0)) {f} * 100 AS mape_pct,
    avg(2*abs({e}) / (full_month_kwh + abs(pred_monthly_kwh))) {f} * 100 AS smape_pct,
    avg({e}) {f} AS bias, stddev_pop({e}) {f} AS std_error"""


def confusion(kind: str = "any", prefix: str = "alarm") -> str:
    p, q = f"pred_{kind}", f"true_{kind}"
    tp, fp = f"count_if({p} AND {q})", f"count_if({p} AND NOT {q})"
    fn, tn = f"count_if(NOT {p} AND {q})", f"count_if(NOT {p} AND NOT {q})"
    prec = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)"
    rec = f"coalesce({tp} / nullif({tp} + {fn}, 0), 0)"
    return f"""{tp} AS {prefix}_tp, {fp} AS {prefix}_fp, {fn} AS {prefix}_fn, {tn} AS {prefix}_tn,
    {prec} AS {prefix}_precision, {rec} AS {prefix}_recall,
    coalesce(2*{prec}*{rec} / nullif({prec} + {rec}, 0), 0) AS {prefix}_f1,
    ({tp} + {fp}) / count(*) AS {prefix}_alarm_rate_pred,
    ({tp} + {fn}) / count(*) AS {prefix}_alarm_rate_true"""


REG_COLS = ("n:i mae:4 rmse:4 nrmse_pct:4 cvrmse_pct:4 mape_pct:4 smape_pct:4 bias:4 "
            "std_error:4")


def conf_cols(prefix: str = "alarm") -> str:
    ints = " ".join(f"{prefix}_{k}:i" for k in ("tp", "fp", "fn", "tn"))
    rest = " ".join(f"{prefix}_{k}:6" for k in (
        "precision", "recall", "f1", "alarm_rate_pred", "alarm_rate_true"))
    return f"{ints} {rest}"


def horizon_sql(source: str, start: str, extra_key: str = "", observed: str | None = None,
                horizons=(10, 20)) -> str:
    k = f"{extra_key}, " if extra_key else ""
    hs = ", ".join(f"({h})" for h in horizons)
    obs = observed or "least(h, days_in_month)"
    return f"""
    SELECT {k}customer_id, year_month, contract_type, h AS horizon_days, partial_kwh,
           full_month_kwh, days_in_month, calendar_days, {obs} AS days_observed,
           full_month_kwh - partial_kwh AS remainder_kwh
    FROM (
      SELECT {k}customer_id, date_trunc('month', start_date)::DATE AS year_month,
             any_value(contract_type) AS contract_type, h,
             sum(day_kwh) FILTER (WHERE date_diff('day', start_date, date) < h) AS partial_kwh,
             count(DISTINCT date) FILTER (WHERE date_diff('day', start_date, date) < h) AS n_obs,
             sum(day_kwh) AS full_month_kwh, count(DISTINCT date) AS days_in_month,
             any_value(day(last_day(start_date))) AS calendar_days
      FROM (SELECT *, {start} AS start_date FROM {source}), (VALUES {hs}) AS hh(h)
      GROUP BY {k}customer_id, date_trunc('month', start_date), h)
    WHERE n_obs > 0"""


READING_ORDER = ("l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, "
                 "l_discount, l_tax")

CTES: dict[str, str] = {
    "customer_info": f"""
    SELECT s_suppkey, 'S' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS customer_id,
           {case_mod('s_nationkey % 5', t.CONTRACT_BY_NATION)} AS contract_type,
           50.0 + 50.0 * (s_nationkey % 4) AS contract_power_kw, r_name AS region_code,
           {case_mod('s_nationkey % 8', t.BRANCH_BY_NATION)} AS region_sub
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey""",
    "readings": f"""
    SELECT c.customer_id, l_shipdate + to_minutes(15 * (l_orderkey % 96)) AS ts, c.contract_type,
           CASE WHEN l_orderkey % 53 = 0 THEN NULL
                WHEN l_suppkey % 10 = 0 AND l_linenumber = 1
                     AND (l_orderkey % 96) // 4 BETWEEN 10 AND 14 THEN -l_quantity
                ELSE l_quantity END AS p_active_kwh,
           l_quantity * l_tax AS p_reactive_lag, l_quantity * l_discount AS p_reactive_lead,
           l_quantity * l_tax + l_quantity * l_discount AS p_reactive_kwh,
           l_quantity * 1.25::DOUBLE AS p_apparent_kwh, l_quantity * 5.0::DOUBLE AS max_demand_kw,
           c.contract_power_kw, c.region_code, c.region_sub,
           row_number() OVER (ORDER BY {READING_ORDER}) AS seq
    FROM lineitem JOIN customer_info c ON l_suppkey = s_suppkey""",
    "readings_hf": f"""
    SELECT 'U' || CAST(user_id AS VARCHAR) AS customer_id,
           time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
           {case_mod('user_id % 5', t.CONTRACT_BY_NATION)} AS contract_type,
           value AS p_active_kwh, value * ((event_id % 10) / 10.0::DOUBLE) AS p_reactive_kwh,
           value * 4.8::DOUBLE AS max_demand_kw, event_id AS seq
    FROM events""",
    "weather": f"""
    SELECT station_id, ts, avg(temp_c) AS temp_c, avg(humidity) AS humidity,
           avg(wind_speed) AS wind_speed, avg(solar_mj) AS solar_mj, max(precip_mm) AS precip_mm
    FROM (SELECT {case_mod('o_custkey % 8', t.STATIONS)} AS station_id,
                 o_orderdate + to_hours(o_orderkey % 24) AS ts,
                 CASE WHEN o_orderkey % 97 = 0 THEN NULL
                      ELSE (o_orderkey % 450) / 10.0::DOUBLE - 10.0::DOUBLE END AS temp_c,
                 (40 + o_custkey % 50)::DOUBLE AS humidity,
                 (o_orderkey % 12) / 2.0::DOUBLE AS wind_speed,
                 CASE WHEN o_orderkey % 24 BETWEEN 7 AND 18
                      THEN (o_orderkey % 30) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS solar_mj,
                 CASE WHEN o_orderkey % 7 = 0 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS precip_mm
          FROM orders)
    GROUP BY station_id, ts""",
    "typical": f"""
    SELECT station_id, ts, avg(temp_c) AS temp_c, avg(rh_pct) AS rh_pct,
           avg(wind_speed_ms) AS wind_speed_ms, avg(ghi_whm2) AS ghi_whm2
    FROM (SELECT {case_mod('user_id % 8', t.TYPICAL_STATIONS)} AS station_id,
                 TIMESTAMP '2023-01-01' + to_days(CAST(event_id % 365 AS INTEGER))
                   + to_hours(hour(ts)) AS ts,
                 value / 10.0::DOUBLE - 5.0::DOUBLE AS temp_c,
                 (40 + event_id % 50)::DOUBLE AS rh_pct,
                 (event_id % 12) / 2.0::DOUBLE AS wind_speed_ms,
                 (event_id % 30) * 20.0::DOUBLE AS ghi_whm2
          FROM events)
    GROUP BY station_id, ts""",
    "holiday": "SELECT date::DATE AS date, name, category FROM ("
               + values(t.holiday_rows(), "date, name, category") + ")",
    "region_map": values(t.REGION_STATION.items(), "region_code, station_id"),
    "daily": """
    SELECT customer_id, contract_type, ts::DATE AS date, coalesce(sum(p_active_kwh), 0) AS day_kwh
    FROM readings GROUP BY ALL""",
    "monthly": """
    SELECT customer_id, contract_type, date_trunc('month', date)::DATE AS year_month,
           sum(day_kwh) AS monthly_kwh
    FROM daily GROUP BY ALL""",
    "horizon": horizon_sql("daily", "date_trunc('month', date)::DATE"),
    "ctx": """
    SELECT h.*, a.monthly_kwh AS prev_month_kwh, y.monthly_kwh AS yoy_month_kwh,
           (SELECT avg(m.monthly_kwh) FROM monthly m WHERE m.customer_id = h.customer_id
              AND m.year_month < h.year_month
              AND m.year_month >= h.year_month - INTERVAL 3 MONTH) AS ma3_kwh
    FROM horizon h
    LEFT JOIN monthly a ON a.customer_id = h.customer_id
         AND a.year_month = h.year_month - INTERVAL 1 MONTH
    LEFT JOIN monthly y ON y.customer_id = h.customer_id
         AND y.year_month = h.year_month - INTERVAL 12 MONTH""",
    "preds": """
    SELECT c.*, m.model, CASE m.model
        WHEN 'naive_last_month' THEN prev_month_kwh
        WHEN 'seasonal_yoy' THEN yoy_month_kwh
        WHEN 'moving_avg3' THEN ma3_kwh
        WHEN 'partial_linear' THEN partial_kwh * days_in_month / days_observed
        WHEN 'partial_seasonal_yoy'
          THEN partial_kwh + yoy_month_kwh * (1 - days_observed / days_in_month)
      END AS pred_monthly_kwh
    FROM ctx c, (""" + values([(n,) for n in BASELINES], "model") + ") m",
    "labelled": f"""
    SELECT *, {alarm('pred_monthly_kwh', 'pred')}, {alarm('full_month_kwh', 'true')}
    FROM preds""",
}


def add(name: str, body: str) -> None:
    if name in CTES:
        raise ValueError(f"CTE {name} is defined twice")
    CTES[name] = body


def _needs(text: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [n for n in CTES if n in words]


def statement(body: str, columns: str) -> str:
    """The full statement: the CTEs the body names, in dependency order, then the body."""
    order: list[str] = []

    def visit(text: str, stack: tuple[str, ...]) -> None:
        for n in _needs(text):
            if n in stack or n in order:
                continue
            visit(CTES[n], (*stack, n))
            order.append(n)

    visit(body, ())
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    sep = ",\n" if head else ""
    return f"WITH {head}{sep}answer AS ({body})\nSELECT {columns} FROM answer"
