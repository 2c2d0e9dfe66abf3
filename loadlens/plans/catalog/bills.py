"""Billing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.operators import billing, rollup
from loadlens.plans.catalog import ctes
from loadlens.plans.catalog.base import query
from loadlens.plans.catalog.core import context_of, daily_of
from loadlens.operators import baselines, metrics
from loadlens.sources import tables as t
from loadlens.tables import tariff as tf

ctes.add("rate_table", ctes.values(tf.rate_rows(), ", ".join(tf.RATE_COLUMNS)))
ctes.add("welfare_table", ctes.values(tf.WELFARE, "wname, wrate, wcap, wcap_summer, wgroup, wstack"))
ctes.add("contract_key", ctes.values([
    ("주택용", "res_low"), ("주택용(고압)", "res_high"), ("일반용(갑)I", "gap_i/low"),
    ("일반용(갑)II", "gap_ii/high_a_1"), ("일반용(을)", "eul_small/low"),
    ("일반용(을)저압", "eul_small/low"), ("일반용(을)고압A", "eul_large/high_a_1"),
    ("일반용(을)고압B", "eul_large/high_b_1")], "ck_name, ck_key"))


def _season_rate(prefix: str, season: str) -> str:
    return ("CASE " + season + " " + " ".join(
        f"WHEN '{s}' THEN {prefix}_{s}" for s in tf.SEASONS) + " END")


def _tiers(kwh: str, summer: str) -> dict[str, str]:
    u1 = f"(CASE WHEN {summer} THEN 300 ELSE 200 END)"
    u2 = f"(CASE WHEN {summer} THEN 450 ELSE 400 END)"
    hi = "_key = 'res_high'"
    r1, r2, r3 = (f"(CASE WHEN {hi} THEN {tf.TIER_RATE['res_high'][i]}::DOUBLE "
                  f"ELSE {tf.TIER_RATE['res_low'][i]}::DOUBLE END)" for i in range(3))
    b1, b2, b3 = (f"(CASE WHEN {hi} THEN {tf.TIER_BASE['res_high'][i]} "
                  f"ELSE {tf.TIER_BASE['res_low'][i]} END)" for i in range(3))
    su = "(CASE WHEN " + hi + " THEN 601.3::DOUBLE ELSE 736.2::DOUBLE END)"
    extra = (f"(CASE WHEN _m IN (7,8,12,1,2) AND {kwh} > 1000 THEN ({kwh} - 1000) * ({su} - {r3}) "
             f"ELSE 0 END)")
    energy = (f"round_even(CASE WHEN {kwh} <= 0 THEN 0 WHEN {kwh} <= {u1} THEN {kwh} * {r1} "
              f"WHEN {kwh} <= {u2} THEN {u1} * {r1} + ({kwh} - {u1}) * {r2} "
              f"ELSE {u1} * {r1} + ({u2} - {u1}) * {r2} + ({kwh} - {u2}) * {r3} END + {extra}, 0)")
    tier = f"(CASE WHEN {kwh} <= 0 THEN 0 WHEN {kwh} <= {u1} THEN 1 WHEN {kwh} <= {u2} THEN 2 ELSE 3 END)"
    base = (f"(CASE WHEN {kwh} <= 0 THEN 0 WHEN {kwh} <= {u1} THEN {b1} "
            f"WHEN {kwh} <= {u2} THEN {b2} ELSE {b3} END)")
    return {"energy": energy, "tier": tier, "base": base, "extra": f"round_even({extra}, 0)"}


def bill_sql(source: str, kwh: str = "kwh", contract: str = "contract_type",
             month: str = "month", demand: str = "0", md: str = "1", pf: str = "NULL",
             welfare: str = "'없음'", out: str = "", ratios=("0.3", "0.4", "0.3")) -> str:
    """The bill written out as nested selects; result columns carry the prefix ``out``."""
    a = _tiers("(_x * _wr)", "_prev IN (7,8)")
    b = _tiers("(_x * (1 - _wr))", "_m IN (7,8)")
    res = "_key LIKE 'res_%'"
    per = [f"_x * {{w}} * {r}::DOUBLE * ({_season_rate(p, '{s}')})"
           for p, r in zip(tf.PERIODS, ratios)]

    def tou_e(s: str, w: str) -> str:
        return " + ".join(x.format(s=s, w=w) for x in per)

    return f"""
    SELECT * EXCLUDE (_x, _m, _key, _prev, _share, _s, _sp, _wp, _wr, _e, _b, _elec, _base, _energy,
                      _tier, _extra, _pf, _wf, _c, _f, _sub, _on, _type, _md, _d, _pfv, _welfare),
      _key AS {out}tariff_key, _base AS {out}base_won, _energy AS {out}energy_won,
      _elec AS {out}elec_won, _tier AS {out}tier, _extra AS {out}super_user_extra,
      _pf AS {out}pf_adjustment, _c AS {out}climate_won, _f AS {out}fuel_won,
      _wf AS {out}welfare_discount, _sub AS {out}subtotal,
      round_even(_sub * 0.1::DOUBLE, 0) AS {out}vat,
      floor(floor(_sub * 0.027::DOUBLE) / 10) * 10 AS {out}fund,
      _sub + round_even(_sub * 0.1::DOUBLE, 0) + floor(floor(_sub * 0.027::DOUBLE) / 10) * 10
        AS {out}final_won,
      CASE WHEN _type = 'tou' THEN round_even(_on - _e, 0) END AS {out}tou_saving,
      CASE WHEN {res} THEN 'progressive' ELSE _type || CASE WHEN _wp > 0 THEN '_blended' ELSE '' END END
        AS {out}tariff_type
    FROM (
    SELECT *, greatest(_elec - _pf + _c + _f - _wf, 0) AS _sub FROM (
    SELECT z.*, CASE WHEN {res} OR _pfv IS NULL OR _pfv <= 0 THEN 0
             ELSE round_even(_base * 0.002::DOUBLE * round_even((least(_pfv, 1.0) - 0.9::DOUBLE) * 100, 0), 0)
           END AS _pf,
           round_even(9 * _x, 0) AS _c, round_even(5 * _x, 0) AS _f,
           CASE WHEN NOT ({res}) OR wname IS NULL THEN 0
                WHEN (CASE WHEN _m IN (7,8) THEN wcap_summer ELSE wcap END) > 0
                THEN round_even(least(_elec * wrate::DOUBLE, CASE WHEN _m IN (7,8) THEN wcap_summer
                                                          ELSE wcap END), 0)
                ELSE round_even(_elec * wrate::DOUBLE, 0) END AS _wf
    FROM (
    SELECT *,
      CASE WHEN {res} THEN greatest({a['base']}, {b['base']}) ELSE round_even(_b, 0) END AS _base,
      CASE WHEN {res} THEN {a['energy']} + {b['energy']} ELSE round_even(_e, 0) END AS _energy,
      CASE WHEN {res} THEN greatest({a['base']}, {b['base']}) + {a['energy']} + {b['energy']}
           ELSE round_even(_b + _e, 0) END AS _elec,
      CASE WHEN {res} THEN greatest({a['tier']}, {b['tier']}) END AS _tier,
      CASE WHEN {res} THEN {a['extra']} + {b['extra']} ELSE 0 END AS _extra
    FROM (
    SELECT q.*, tariff_type AS _type,
      CASE WHEN tariff_type = 'tou' THEN {tou_e('_sp', '_wp')} + {tou_e('_s', '(1 - _wp)')}
           ELSE _x * (({_season_rate('flat', '_sp')}) * _wp + ({_season_rate('flat', '_s')}) * (1 - _wp))
      END AS _e,
      _x * (({_season_rate('on_peak', '_sp')}) * _wp + ({_season_rate('on_peak', '_s')}) * (1 - _wp))
        AS _on,
      _d * base_per_kw AS _b
    FROM (
    SELECT *, CASE WHEN _s = _sp THEN 0 ELSE _share END AS _wp,
           CASE WHEN (_m IN (7,8)) = (_prev IN (7,8)) THEN 0 ELSE _share END AS _wr
    FROM (
    SELECT *, {ctes.season('_m')} AS _s, {ctes.season('_prev')} AS _sp,
      CASE WHEN _md <= 1 THEN 0 ELSE
        greatest(day(last_day(make_date(2024, _prev, 1))) - _md + 1, 0)
        / (greatest(day(last_day(make_date(2024, _prev, 1))) - _md + 1, 0) + _md - 1) END AS _share
    FROM (
    SELECT src.*, {kwh} AS _x, {month} AS _m, {md} AS _md, {demand} AS _d, {pf} AS _pfv,
           {welfare} AS _welfare, ck_key AS _key,
           CASE WHEN {month} = 1 THEN 12 ELSE {month} - 1 END AS _prev
    FROM {source} src LEFT JOIN contract_key ON ck_name = {contract})))
    q LEFT JOIN rate_table ON tariff_key = _key))
    z LEFT JOIN welfare_table ON wname = _welfare AND wname <> '없음')) """


ctes.add("bill_in", """
    SELECT m.customer_id, m.contract_type, m.year_month, month(m.year_month) AS month,
           m.monthly_kwh * 4.0 AS kwh, 1 + c.s_suppkey % 28 AS meter_day,
           c.contract_power_kw AS demand_kw, (85 + c.s_suppkey % 15) / 100.0::DOUBLE AS pf,
           CASE c.s_suppkey % 4 WHEN 0 THEN '없음' WHEN 1 THEN '기초생활(생계/의료)'
                WHEN 2 THEN '다자녀(3자녀+)' ELSE '생명유지장치' END AS welfare
    FROM monthly m JOIN customer_info c USING (customer_id)""")


def bill_input(spark, sf):
    info = t.customer_info(spark, sf)
    key = F.col("s_suppkey")
    dim = info.select(
        "customer_id", (1 + key % 28).cast("int").alias("meter_day"),
        F.col("contract_power_kw").alias("demand_kw"), ((85 + key % 15) / 100.0).alias("pf"),
        t.pick(("없음", "기초생활(생계/의료)", "다자녀(3자녀+)", "생명유지장치"), key % 4)
        .alias("welfare"))
    m = rollup.monthly_by_customer(daily_of(spark, sf))
    return m.join(dim, "customer_id").select(
        "customer_id", "contract_type", "year_month", F.month("year_month").alias("month"),
        (F.col("monthly_kwh") * 4.0).alias("kwh"), "meter_day", "demand_kw", "pf", "welfare")


LINES = ("tariff_key tariff_type base_won:i energy_won:i elec_won:i tier:i super_user_extra:i "
         "pf_adjustment:i climate_won:i fuel_won:i welfare_discount:i subtotal:i vat:i fund:i "
         "final_won:i tou_saving:i")


@query("final_bill", f"customer_id year_month:s {LINES}", "I1 I2 I3 I4 I5 I6 I7 I8 I10",
       bill_sql("bill_in", demand="demand_kw", md="meter_day", pf="pf", welfare="welfare"))
def final_bill(spark, sf):
    d = bill_input(spark, sf).withColumn("_types", F.array("welfare"))
    d = billing.with_bill(d, max_demand="demand_kw", meter_day="meter_day", pf="pf",
                          welfare="_types")
    return d.select("customer_id", "year_month", "bill.*")


@query("calendar_month_bill", f"customer_id year_month:s {LINES}", "I7", bill_sql("bill_in"))
def calendar_month_bill(spark, sf):
    return billing.with_bill(bill_input(spark, sf)).select("customer_id", "year_month", "bill.*")


@query("stacked_welfare", "customer_id year_month:s welfare_discount:i welfare_desc", "I9", """
    SELECT customer_id, year_month, d2 + d4 AS welfare_discount,
           '차상위계층 + ' || CASE WHEN s % 2 = 0 THEN '출산가구' ELSE '생명유지장치' END || ' (중복)'
             AS welfare_desc
    FROM (SELECT *, CASE WHEN s % 2 = 0
                    THEN round_even(least((elec - d2) * 0.3::DOUBLE, 16000), 0)
                    ELSE round_even((elec - d2) * 0.3::DOUBLE, 0) END AS d4
          FROM (SELECT customer_id, year_month, CAST(substr(customer_id, 2) AS INTEGER) AS s, elec_won AS elec,
                       round_even(least(elec_won, CASE WHEN month IN (7,8) THEN 10000 ELSE 8000 END), 0) AS d2
                FROM (""" + bill_sql("bill_in") + """) WHERE contract_type LIKE '주택용%'))""")
def stacked_welfare(spark, sf):
    """A stackable fixed discount and the better of one group-4 type on the rest."""
    d = bill_input(spark, sf).where(F.col("contract_type").startswith("주택용"))
    even = F.substring("customer_id", 2, 10).cast("int") % 2 == 0
    d = d.withColumn("_types", F.when(even, F.array(F.lit("차상위계층"), F.lit("출산가구")))
                     .otherwise(F.array(F.lit("생명유지장치"), F.lit("차상위계층"))))
    return billing.with_bill(d, welfare="_types").select("customer_id", "year_month", "bill.*")


ctes.add("increase_in", """
    SELECT customer_id, contract_type, year_month, month(year_month) AS month,
           monthly_kwh * 4.0 AS pred_kwh,
           lag(monthly_kwh) OVER (PARTITION BY customer_id ORDER BY year_month) * 4.0 AS prev_kwh
    FROM monthly""")
ctes.add("increase_bills", bill_sql("(" + bill_sql("increase_in", kwh="pred_kwh", out="p_") + ")",
                                    kwh="prev_kwh", out="v_"))


@query("bill_increase", "customer_id year_month:s pred_bill:i prev_bill:i kwh_change_pct:1 "
       "won_change_pct:1 tier_prev:i tier_pred:i", "I11", """
    SELECT customer_id, year_month, p_final_won AS pred_bill, v_final_won AS prev_bill,
           round_even(CASE WHEN prev_kwh > 0 THEN (pred_kwh / prev_kwh - 1) * 100 ELSE 0 END, 1)
             AS kwh_change_pct,
           round_even(CASE WHEN v_final_won > 0 THEN (p_final_won / v_final_won - 1) * 100 ELSE 0 END, 1)
             AS won_change_pct, v_tier AS tier_prev, p_tier AS tier_pred
    FROM increase_bills WHERE prev_kwh IS NOT NULL""")
def bill_increase(spark, sf):
    from loadlens.operators import horizon as hz

    m = hz.row_lags(rollup.monthly_by_customer(daily_of(spark, sf))).where("prev_m is not null")
    d = m.select("customer_id", "contract_type", "year_month", F.month("year_month").alias("month"),
                 (F.col("monthly_kwh") * 4.0).alias("pred_kwh"),
                 (F.col("prev_m") * 4.0).alias("prev_kwh"))
    return billing.bill_increase(d, "pred_kwh", "prev_kwh")


ctes.add("usage_in", "SELECT b.*, s.pct, kwh * (1 + s.pct / 100.0::DOUBLE) AS kwh2 FROM bill_in b, "
         "(VALUES (10), (20), (30), (50), (80)) AS s(pct)")


@query("what_if_usage", "customer_id year_month:s increase_pct:i final_won:i diff_won:i "
       "won_change_pct:4", "I12 C21", """
    SELECT customer_id, year_month, pct AS increase_pct, b_final_won AS final_won,
           b_final_won - a_final_won AS diff_won,
           coalesce((b_final_won / nullif(a_final_won, 0) - 1) * 100, 0) AS won_change_pct
    FROM (""" + bill_sql("(" + bill_sql("usage_in", demand="demand_kw", out="a_") + ")",
                         kwh="kwh2", demand="demand_kw", out="b_") + ")")
def what_if_usage(spark, sf):
    return billing.what_if_usage(bill_input(spark, sf), max_demand="demand_kw")


ctes.add("compare_in", "SELECT b.*, x.cc FROM bill_in b, ("
         + ctes.values([(c,) for c in billing.COMPARE_CONTRACTS], "cc") + ") x")


@query("what_if_contract", "customer_id year_month:s compare_contract elec_won:i final_won:i "
       "diff_won:i tou_saving:i", "I12 C21", """
    SELECT customer_id, year_month, cc AS compare_contract, b_elec_won AS elec_won,
           b_final_won AS final_won, b_final_won - a_final_won AS diff_won,
           b_tou_saving AS tou_saving
    FROM (""" + bill_sql("(" + bill_sql("compare_in", demand="demand_kw", out="a_") + ")",
                         contract="cc", demand="demand_kw", out="b_") + ")")
def what_if_contract(spark, sf):
    return billing.what_if_contract(bill_input(spark, sf), max_demand="demand_kw")


ctes.add("welfare_in", "SELECT b.*, w.wname AS wtype FROM bill_in b, welfare_table w "
         "WHERE contract_type LIKE '주택용%'")


@query("what_if_welfare", "customer_id year_month:s welfare_type welfare_discount:i final_won:i",
       "I12 I9 C21", "SELECT customer_id, year_month, wtype AS welfare_type, welfare_discount, "
       "final_won FROM (" + bill_sql("welfare_in", welfare="wtype") + ")")
def what_if_welfare(spark, sf):
    d = bill_input(spark, sf).where(F.col("contract_type").startswith("주택용"))
    return billing.what_if_welfare(d)


ctes.add("month_pf", """
    SELECT customer_id, year_month, p / greatest(sqrt(p*p + q*q), 1e-9) AS monthly_pf,
           q / greatest(p, 1e-9) AS monthly_reactive_ratio
    FROM (SELECT customer_id, date_trunc('month', ts)::DATE AS year_month,
                 coalesce(sum(p_active_kwh), 0) AS p, sum(abs(p_reactive_kwh)) AS q
          FROM readings GROUP BY ALL)""")


@query("monthly_power_factor", "customer_id year_month:s monthly_pf:g monthly_reactive_ratio:g",
       "D8 H8", "SELECT * FROM month_pf")
def monthly_power_factor(spark, sf):
    return rollup.monthly_power_factor(t.readings(spark, sf))


ctes.add("pf_est", """
    SELECT o.customer_id, o.year_month, o.h AS horizon_days, m.monthly_pf,
           CASE WHEN o.p > 0 THEN o.p / sqrt(o.p*o.p + o.q*o.q) END AS observed,
           m.prev_month, m.historical_mean, m.seasonal_mean
    FROM (SELECT customer_id, date_trunc('month', ts)::DATE AS year_month, h,
                 coalesce(sum(p_active_kwh), 0) AS p, sum(abs(p_reactive_kwh)) AS q
          FROM readings, (VALUES (10), (20)) AS v(h) WHERE day(ts) <= h GROUP BY ALL) o
    JOIN (SELECT a.*, b.monthly_pf AS prev_month,
             avg(a.monthly_pf) OVER (PARTITION BY a.customer_id ORDER BY a.year_month
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS historical_mean,
             avg(a.monthly_pf) OVER (PARTITION BY a.customer_id, month(a.year_month)
               ORDER BY a.year_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seasonal_mean
          FROM month_pf a LEFT JOIN month_pf b ON a.customer_id = b.customer_id
               AND b.year_month = a.year_month - INTERVAL 1 MONTH) m USING (customer_id, year_month)""")
ctes.add("pf_all", """
    SELECT *, CASE WHEN observed IS NULL THEN prev_month WHEN prev_month IS NULL THEN observed
                   ELSE 0.7 * observed + 0.3 * prev_month END AS weighted_blend FROM pf_est""")


@query("pf_estimates", "customer_id year_month:s horizon_days:i monthly_pf:6 observed:6 "
       "prev_month:6 historical_mean:6 seasonal_mean:6 weighted_blend:6", "I13 E13",
       "SELECT * FROM pf_all")
def pf_estimates(spark, sf):
    return billing.estimate_pf(t.readings(spark, sf))


@query("pf_strategy_comparison", "strategy horizon_days:i mae:6 n:i", "D52 I13 F2", """
    SELECT strategy, horizon_days, avg(abs(est - monthly_pf)) AS mae, count(*) AS n
    FROM (UNPIVOT pf_all ON observed, prev_month, historical_mean, seasonal_mean, weighted_blend
          INTO NAME strategy VALUE est) WHERE est IS NOT NULL GROUP BY ALL""")
def pf_strategy_comparison(spark, sf):
    return billing.compare_pf_strategies(t.readings(spark, sf))


def tou_share_sql(tou: str) -> str:
    return f"""
    SELECT customer_id, year_month, off_kwh / d AS tou_ratio_off_peak,
           mid_kwh / d AS tou_ratio_mid_peak, on_kwh / d AS tou_ratio_on_peak
    FROM (SELECT customer_id, date_trunc('month', ts)::DATE AS year_month,
            coalesce(sum(p_active_kwh) FILTER (WHERE tou = 'off_peak'), 0) AS off_kwh,
            coalesce(sum(p_active_kwh) FILTER (WHERE tou = 'mid_peak'), 0) AS mid_kwh,
            coalesce(sum(p_active_kwh) FILTER (WHERE tou = 'on_peak'), 0) AS on_kwh,
            greatest(coalesce(sum(p_active_kwh), 0), 1e-9) AS d
          FROM (SELECT *, {tou} AS tou FROM readings) GROUP BY ALL)"""


ctes.add("tou_share", tou_share_sql(ctes.tou_rules("ts", "ts::DATE IN (SELECT date FROM holiday)")))
ctes.add("tou_share_plain", tou_share_sql(ctes.tou("ts")))
TOU3 = "tou_ratio_off_peak:6 tou_ratio_mid_peak:6 tou_ratio_on_peak:6"


@query("monthly_tou_ratios", f"customer_id year_month:s {TOU3}", "D9 H6",
       "SELECT * FROM tou_share")
def monthly_tou_ratios(spark, sf):
    return rollup.monthly_tou_ratios(t.readings(spark, sf), holidays=t.holidays(spark))


@query("monthly_tou_ratios_plain", f"customer_id year_month:s {TOU3}", "D9 Q11",
       "SELECT * FROM tou_share_plain")
def monthly_tou_ratios_plain(spark, sf):
    return rollup.monthly_tou_ratios(t.readings(spark, sf), apply_day_rules=False)


def _tou_est() -> str:
    cols = []
    for p, d in tf.DEFAULT_TOU_RATIO.items():
        c = f"tou_ratio_{p}"
        cols.append(f"""a.{c} AS {p}_observed, coalesce(b.{c}, {d}) AS {p}_prev_month,
          coalesce(avg(a.{c}) OVER w, {d}) AS {p}_historical_mean,
          coalesce(avg(a.{c}) OVER s, {d}) AS {p}_seasonal_mean,
          0.7 * a.{c} + 0.3 * coalesce(b.{c}, {d}) AS {p}_weighted_blend""")
    return f"""
    SELECT a.customer_id, a.year_month, {', '.join(cols)}
    FROM tou_share_plain a LEFT JOIN tou_share_plain b ON a.customer_id = b.customer_id
         AND b.year_month = a.year_month - INTERVAL 1 MONTH
    WINDOW w AS (PARTITION BY a.customer_id ORDER BY a.year_month
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           s AS (PARTITION BY a.customer_id, month(a.year_month) ORDER BY a.year_month
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("tou_ratio_estimates", "customer_id year_month:s " + " ".join(
    f"{p}_{s}:g" for p in tf.PERIODS for s in billing.PF_STRATEGIES), "I13", _tou_est())
def tou_ratio_estimates(spark, sf):
    return billing.estimate_tou_ratios(t.readings(spark, sf))


ctes.add("scored_in", """
    SELECT customer_id, contract_type, year_month, month(year_month) AS month, horizon_days,
           pred_monthly_kwh, pred_prev, pred_yoy, pred_ma, pred_any
    FROM labelled WHERE model = 'partial_linear'""")


@query("batch_score_bills", "customer_id year_month:s horizon_days:i pred_monthly_kwh:4 pred_any:i "
       "elec_won:i", "I14 A26", bill_sql("scored_in", kwh="pred_monthly_kwh"))
def batch_score_bills(spark, sf):
    rows = context_of(spark, sf).withColumn("pred_monthly_kwh", baselines.partial_linear())
    rows = metrics.labelled(rows).withColumn("month", F.month("year_month"))
    return billing.with_bill(rows, kwh="pred_monthly_kwh").select("*", "bill.elec_won")
