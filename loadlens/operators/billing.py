"""Bills as column expressions: tiers, time of use, season blending, discounts, taxes.

The only join is with the fixed table of tariff rates (a few dozen rows).
Corrected rules are the default; ``compat=True`` reproduces three historical
quirks: high-voltage B priced as A, a three-month residential summer off the
first meter day, and welfare discounts on non-residential contracts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from loadlens.functions import calendar as cal
from loadlens.functions.scalars import half_even, sum0
from loadlens.operators import horizon as hz, rollup
from loadlens.tables import tariff as tf



def rates(spark: SparkSession) -> DataFrame:
    types = ["string", "string", *["double"] * (len(tf.RATE_COLUMNS) - 2)]
    return spark.createDataFrame(
        tf.rate_rows(), ", ".join(f"{c} {t}" for c, t in zip(tf.RATE_COLUMNS, types)))


def tariff_key(contract: Column, compat: bool = False) -> Column:
    """Exact name, else the first known name that holds or is held by the contract."""
    clean = F.replace(contract, F.lit(" "), F.lit(""))
    entries = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("k"))
                        for n, k in tf.CONTRACT_TARIFF])
    exact = F.filter(entries, lambda e: e["n"] == clean)
    part = F.filter(entries, lambda e: clean.contains(e["n"]) | e["n"].contains(clean))
    key = F.coalesce(F.get(exact, F.lit(0))["k"], F.get(part, F.lit(0))["k"],
                     F.lit(tf.DEFAULT_TARIFF))
    if compat:
        key = F.when(key == "eul_large/high_b_1", "eul_large/high_a_1").otherwise(key)
    return key


def _by_season(prefix: str, season: Column) -> Column:
    out = None
    for s in tf.SEASONS:
        c = F.col(f"{prefix}_{s}")
        out = F.when(season == s, c) if out is None else out.when(season == s, c)
    return out


def billing_parts(month: Column, meter_day: Column) -> dict[str, Column]:
    """Previous month and the share of the billing period's days that lie in it.

    The period runs from the meter day of the previous month to the day before it.
    Month lengths are those of a leap year.
    """
    prev = F.when(month == 1, 12).otherwise(month - 1)
    prev_len = F.dayofmonth(F.last_day(F.make_date(F.lit(2024), prev, F.lit(1))))
    days_prev = F.greatest(prev_len - meter_day + 1, F.lit(0))
    share = days_prev / (days_prev + meter_day - 1)
    return {"prev_month": prev, "prev_share": F.when(meter_day > 1, share).otherwise(0.0)}


def _progressive(kwh: Column, key: Column, summer: Column, super_month: Column) -> dict[str, Column]:
    def per_key(values: dict, i: int | None = None) -> Column:
        low, high = values["res_low"], values["res_high"]
        if i is not None:
            low, high = low[i], high[i]
        return F.when(key == "res_high", high).otherwise(low)

    def bound(i: int) -> Column:
        return F.when(summer, tf.TIER_BOUNDS["summer"][i]).otherwise(tf.TIER_BOUNDS["normal"][i])

    u1, u2, zero = bound(0), bound(1), F.lit(0.0)
    r1, r2, r3 = (per_key(tf.TIER_RATE, i) for i in range(3))
    used = F.greatest(kwh, zero)
    energy = (F.least(used, u1) * r1 + F.greatest(F.least(used, u2) - u1, zero) * r2
              + F.greatest(used - u2, zero) * r3)
    over = F.greatest(kwh - tf.SUPER_USER_KWH, zero)
    extra = F.when(super_month, over * (per_key(tf.SUPER_USER_RATE) - r3)).otherwise(0.0)
    tier = F.when(kwh <= 0, 0).when(kwh <= u1, 1).when(kwh <= u2, 2).otherwise(3)
    base = F.when(tier == 0, 0.0)
    for i in range(3):
        base = base.when(tier == i + 1, per_key(tf.TIER_BASE, i))
    return {"base": base, "energy": half_even(energy + extra), "tier": tier,
            "extra": half_even(extra)}


def with_bill(
    df: DataFrame, kwh: str = "kwh", contract: str = "contract_type", month: str = "month",
    max_demand: str | None = None, meter_day: str | None = None,
    tou_ratios: dict[str, str] | None = None, welfare: str | None = None,
    pf: str | None = None, climate_rate: float = tf.CLIMATE_RATE,
    fuel_rate: float = tf.FUEL_RATE, compat: bool = False, out: str = "bill",
) -> DataFrame:
    """Add the struct ``out`` with every line of the bill.

    ``welfare`` names an array column of welfare types, ``tou_ratios`` the columns
    with the share of each period.
    """
    x, m = F.col(kwh), F.col(month)
    demand = F.coalesce(F.col(max_demand), F.lit(0.0)) if max_demand else F.lit(0.0)
    md = F.col(meter_day) if meter_day else F.lit(1)
    part = billing_parts(m, md)
    key = tariff_key(F.col(contract), compat)
    d = df.withColumns({"_key": key, "_prev": part["prev_month"], "_share": part["prev_share"]})
    d = d.join(F.broadcast(rates(df.sparkSession)), F.col("_key") == F.col("tariff_key"), "left")

    season, season_prev = cal.season(m), cal.season(F.col("_prev"))
    w_prev = F.when(season == season_prev, 0.0).otherwise(F.col("_share"))
    w_curr = 1.0 - w_prev
    ratio = {p: (F.coalesce(F.col(tou_ratios[p]), F.lit(0.0)) if tou_ratios
                 else F.lit(tf.DEFAULT_TOU_RATIO[p])) for p in tf.PERIODS}

    flat = x * (_by_season("flat", season_prev) * w_prev + _by_season("flat", season) * w_curr)

    def tou_energy(s: Column, w: Column) -> Column:
        terms = [x * w * ratio[p] * _by_season(p, s) for p in tf.PERIODS]
        return terms[0] + terms[1] + terms[2]

    tou = tou_energy(season_prev, w_prev) + tou_energy(season, w_curr)
    all_on_peak = x * (_by_season("on_peak", season_prev) * w_prev
                       + _by_season("on_peak", season) * w_curr)

    residential = F.col("_key").startswith("res_")
    super_month = m.isin(*tf.SUPER_USER_MONTHS)
    if compat:
        summer = F.when(md <= 1, m.isin(*tf.RESIDENTIAL_SUMMER)).otherwise(season == "summer")
        summer_prev = season_prev == "summer"
        r_prev = F.when(season == season_prev, 0.0).when(summer == summer_prev, 0.0).otherwise(
            F.col("_share"))
    else:
        summer, summer_prev = (c.isin(*tf.RESIDENTIAL_SUMMER) for c in (m, F.col("_prev")))
        r_prev = F.when(summer == summer_prev, 0.0).otherwise(F.col("_share"))
    d = d.withColumns({"_wr": r_prev, "_flat": flat, "_tou": tou, "_on": all_on_peak})
    a = _progressive(x * F.col("_wr"), F.col("_key"), summer_prev, super_month)
    b = _progressive(x * (1.0 - F.col("_wr")), F.col("_key"), summer, super_month)
    is_tou = F.col("tariff_type") == "tou"
    energy = F.when(is_tou, F.col("_tou")).otherwise(F.col("_flat"))
    base = demand * F.col("base_per_kw")
    d = d.withColumns({
        "_base": F.when(residential, F.greatest(a["base"], b["base"])).otherwise(half_even(base)),
        "_energy": F.when(residential, a["energy"] + b["energy"]).otherwise(half_even(energy)),
        "_elec": F.when(residential, F.greatest(a["base"], b["base"]) + a["energy"] + b["energy"])
        .otherwise(half_even(base + energy)),
        "_tier": F.when(residential, F.greatest(a["tier"], b["tier"])),
        "_extra": F.when(residential, a["extra"] + b["extra"]).otherwise(0.0),
        "_saving": F.when(is_tou, half_even(F.col("_on") - F.col("_tou"))),
    })
    pf_adj = F.when(~residential, power_factor_adjustment(F.col("_base"), F.col(pf))
                    ).otherwise(0.0) if pf else F.lit(0.0)
    if welfare:
        wf = welfare_discount(F.col("_elec"), F.col(welfare), m.isin(*tf.RESIDENTIAL_SUMMER))
        none = F.struct(F.lit(0.0).alias("discount"), F.lit(tf.NO_WELFARE).alias("desc"))
        wf = wf if compat else F.when(residential, wf).otherwise(none)
    else:
        wf = F.struct(F.lit(0.0).alias("discount"), F.lit(tf.NO_WELFARE).alias("desc"))
    d = d.withColumns({"_pf": pf_adj, "_wf": wf, "_climate": half_even(climate_rate * x),
                       "_fuel": half_even(fuel_rate * x)})
    sub = F.greatest(F.col("_elec") - F.col("_pf") + F.col("_climate") + F.col("_fuel")
                     - F.col("_wf.discount"), F.lit(0.0))
    d = d.withColumn("_sub", sub)
    vat = half_even(F.col("_sub") * tf.VAT_RATE)
    fund = F.floor(F.floor(F.col("_sub") * tf.FUND_RATE) / 10) * 10
    kind = F.when(residential, "progressive").otherwise(F.concat(
        F.col("tariff_type"), F.when(w_prev > 0, "_blended").otherwise("")))

    def won(c: Column) -> Column:
        return c.cast("bigint")

    bill = F.struct(
        F.col("_key").alias("tariff_key"), kind.alias("tariff_type"),
        won(F.col("_base")).alias("base_won"), won(F.col("_energy")).alias("energy_won"),
        won(F.col("_elec")).alias("elec_won"), F.col("_tier").alias("tier"),
        half_even(F.when(x > 0, F.col("_elec") / x).otherwise(0.0), 1).alias("effective_rate"),
        won(F.col("_extra")).alias("super_user_extra"), won(F.col("_pf")).alias("pf_adjustment"),
        won(F.col("_climate")).alias("climate_won"), won(F.col("_fuel")).alias("fuel_won"),
        won(F.col("_wf.discount")).alias("welfare_discount"),
        F.col("_wf.desc").alias("welfare_desc"),
        won(F.col("_sub")).alias("subtotal"), won(vat).alias("vat"), won(fund).alias("fund"),
        won(F.col("_sub") + vat + fund).alias("final_won"),
        won(F.col("_saving")).alias("tou_saving"),
    )
    return d.withColumn(out, bill).select(*df.columns, out)


def power_factor_adjustment(base_won: Column, pf: Column) -> Column:
    """0.2 % of the base charge per point of power factor above (discount) or below 90 %."""
    points = half_even((F.least(pf, F.lit(1.0)) - tf.BASE_POWER_FACTOR) * 100)
    return F.when(pf.isNotNull() & (pf > 0), half_even(base_won * 0.002 * points)).otherwise(0.0)


def welfare_discount(elec_won: Column, types: Column, summer: Column) -> Column:
    """Struct (discount, desc) for a list of welfare types.

    Normally the single largest discount; a stackable group-2 type goes first and
    the best group-4 type is then taken on the rest.
    """
    table = F.create_map(*[c for n, rate, cap, cap_summer, group, stack in tf.WELFARE for c in (
        F.lit(n), F.struct(F.lit(rate).alias("rate"), F.lit(cap).alias("cap"),
                           F.lit(cap_summer).alias("cap_summer"),
                           F.lit(group).cast("string").alias("grp"), F.lit(stack).alias("stack")))])
    known = F.filter(F.transform(types, lambda n, i: F.struct(
        n.alias("name"), i.alias("i"), F.try_element_at(table, n).alias("w"))),
        lambda e: e["w"].isNotNull() & (e["name"] != tf.NO_WELFARE))

    def best(entries: Column, amount: Column) -> Column:
        def one(e):
            cap = F.when(summer, e["w"]["cap_summer"]).otherwise(e["w"]["cap"])
            raw = amount * e["w"]["rate"]
            d = half_even(F.when(cap > 0, F.least(raw, cap)).otherwise(raw))
            return F.struct(d.alias("d"), (-e["i"]).alias("i"), e["name"].alias("name"))

        return F.array_max(F.transform(entries, one))

    g2 = F.filter(known, lambda e: (e["w"]["grp"] == "2") & e["w"]["stack"])
    g4 = F.filter(known, lambda e: e["w"]["grp"] == "4")
    first = best(g2, elec_won)
    second = best(g4, elec_won - first["d"])
    single = best(known, elec_won)
    stacked = (F.size(g2) > 0) & (F.size(g4) > 0)
    discount = F.when(stacked, first["d"] + second["d"]).otherwise(
        F.coalesce(single["d"], F.lit(0.0)))
    desc = F.when(stacked, F.concat(first["name"], F.lit(" + "), second["name"], F.lit(" (중복)"))
                  ).when(F.size(known) == 0, tf.NO_WELFARE).when(single["d"] > 0, single["name"]
                                                                ).otherwise("")
    return F.struct(discount.alias("discount"), desc.alias("desc"))


def bill_increase(df: DataFrame, pred: str, prev: str, **kw) -> DataFrame:
    """Bills of two amounts and how much faster the bill grows than the energy."""
    d = with_bill(df, kwh=pred, out="_bp", **kw)
    d = with_bill(d, kwh=prev, out="_bv", **kw)
    p, v = F.col(pred), F.col(prev)
    kwh_chg = F.when(v > 0, (p / F.nullif(v, F.lit(0.0)) - 1) * 100).otherwise(0.0)
    fp, fv = F.col("_bp.final_won"), F.col("_bv.final_won")
    won_chg = F.when(fv > 0, (fp / F.nullif(fv, F.lit(0)) - 1) * 100).otherwise(0.0)
    return d.withColumns({"_k": kwh_chg, "_w": won_chg}).select(
        *df.columns, fp.alias("pred_bill"), fv.alias("prev_bill"),
        half_even(F.col("_k"), 1).alias("kwh_change_pct"),
        half_even(F.col("_w"), 1).alias("won_change_pct"),
        half_even(F.when(F.col("_k") != 0, F.col("_w") / F.nullif(F.col("_k"), F.lit(0.0)))
                  .otherwise(0.0), 2).alias("amplification"),
        F.col("_bv.tier").alias("tier_prev"), F.col("_bp.tier").alias("tier_pred"),
        F.col("_bp.tariff_type").alias("tariff_type"))


# What-if steps of usage and contracts to compare.
USAGE_STEPS = (10, 20, 30, 50, 80)
COMPARE_CONTRACTS = ("주택용", "주택용(고압)", "일반용(갑)I", "일반용(갑)II", "일반용(을)",
                     "일반용(을)저압", "일반용(을)고압A", "일반용(을)고압B")


def what_if_usage(df: DataFrame, kwh: str = "kwh", **kw) -> DataFrame:
    """Bill at raised usage; the steps are exploded from a literal, nothing is cross-joined."""
    base = with_bill(df, kwh=kwh, out="_b0", **kw)
    d = base.withColumn("increase_pct", F.explode(F.array(*[F.lit(s) for s in USAGE_STEPS])))
    d = d.withColumn("_kwh", F.col(kwh) * (1 + F.col("increase_pct") / 100))
    d = with_bill(d, kwh="_kwh", out="_b1", **kw)
    f0, f1 = F.col("_b0.final_won"), F.col("_b1.final_won")
    chg = F.when(f0 > 0, (f1 / F.nullif(f0, F.lit(0)) - 1) * 100).otherwise(0.0)
    return d.select(*df.columns, "increase_pct", f1.alias("final_won"),
                    (f1 - f0).alias("diff_won"), chg.alias("won_change_pct"),
                    (chg / F.col("increase_pct")).alias("amplification"))


def what_if_contract(df: DataFrame, kwh: str = "kwh", **kw) -> DataFrame:
    base = with_bill(df, kwh=kwh, out="_b0", **kw)
    d = base.withColumn("compare_contract", F.explode(F.array(*[
        F.lit(c) for c in COMPARE_CONTRACTS])))
    d = with_bill(d, kwh=kwh, contract="compare_contract", out="_b1",
                  **{k: v for k, v in kw.items() if k != "contract"})
    return d.select(*df.columns, "compare_contract", F.col("_b1.elec_won").alias("elec_won"),
                    F.col("_b1.final_won").alias("final_won"),
                    (F.col("_b1.final_won") - F.col("_b0.final_won")).alias("diff_won"),
                    F.col("_b1.tou_saving").alias("tou_saving"))


def what_if_welfare(df: DataFrame, kwh: str = "kwh", **kw) -> DataFrame:
    d = df.withColumn("welfare_type", F.explode(F.array(*[F.lit(w[0]) for w in tf.WELFARE])))
    d = d.withColumn("_types", F.array("welfare_type"))
    d = with_bill(d, kwh=kwh, welfare="_types", out="_b", **kw)
    return d.select(*df.columns, "welfare_type",
                    F.col("_b.welfare_discount").alias("welfare_discount"),
                    F.col("_b.final_won").alias("final_won"))


# --- estimators of power factor and period shares ----------------------------------------------

PF_STRATEGIES = ("observed", "prev_month", "historical_mean", "seasonal_mean", "weighted_blend")


def observed_pf(df: DataFrame, horizons=hz.HORIZONS) -> DataFrame:
    """Power factor of the first h days, one row per customer, month and horizon with data."""
    day = df.where(F.col("ts").isNotNull()).groupBy(
        "customer_id", F.to_date("ts").alias("date")).agg(
        sum0(F.col("p_active_kwh")).alias("p"), sum0(F.abs("p_reactive_kwh")).alias("q"))
    h = F.explode(F.array(*[F.lit(v) for v in horizons]))
    g = day.withColumn("horizon_days", h).where(F.dayofmonth("date") <= F.col("horizon_days"))
    g = g.groupBy("customer_id", F.trunc("date", "MM").alias("year_month"), "horizon_days").agg(
        F.sum("p").alias("p"), F.sum("q").alias("q"))
    return g.select("customer_id", "year_month", "horizon_days",
                    F.when(F.col("p") > 0, F.col("p") / F.sqrt(
                        F.col("p") * F.col("p") + F.col("q") * F.col("q"))).alias("observed"))


def history_columns(monthly: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Previous month, past mean and past mean of the same calendar month per column."""
    by_month = W.partitionBy("customer_id").orderBy(cal.month_index(F.col("year_month")))
    same = W.partitionBy("customer_id", F.month("year_month")).orderBy("year_month")
    out = monthly
    for c in columns:
        past, past_same = (w.rowsBetween(W.unboundedPreceding, -1) for w in (by_month, same))
        out = out.withColumns({
            f"{c}__prev_month": F.max(c).over(by_month.rangeBetween(-1, -1)),
            f"{c}__historical_mean": F.avg(c).over(past),
            f"{c}__seasonal_mean": F.avg(c).over(past_same)})
    return out


def estimate_pf(df: DataFrame, horizons=hz.HORIZONS) -> DataFrame:
    """Every power-factor estimate as a column, next to the actual month value."""
    monthly = history_columns(rollup.monthly_power_factor(df), ("monthly_pf",))
    rows = observed_pf(df, horizons).join(monthly, ["customer_id", "year_month"])
    prev, obs = F.col("monthly_pf__prev_month"), F.col("observed")
    return rows.select(
        "customer_id", "year_month", "horizon_days", "monthly_pf", "observed",
        prev.alias("prev_month"),
        F.col("monthly_pf__historical_mean").alias("historical_mean"),
        F.col("monthly_pf__seasonal_mean").alias("seasonal_mean"),
        F.coalesce(0.7 * obs + 0.3 * prev, obs, prev).alias("weighted_blend"))


def compare_pf_strategies(df: DataFrame, horizons=hz.HORIZONS) -> DataFrame:
    """Mean absolute error of each strategy by horizon."""
    rows = estimate_pf(df, horizons).withColumn("_s", F.explode(F.array(*[
        F.struct(F.lit(s).alias("strategy"), F.col(s).alias("est")) for s in PF_STRATEGIES])))
    return rows.where(F.col("_s.est").isNotNull()).groupBy(
        F.col("_s.strategy").alias("strategy"), "horizon_days").agg(
        F.avg(F.abs(F.col("_s.est") - F.col("monthly_pf"))).alias("mae"),
        F.count(F.lit(1)).alias("n"))


def estimate_tou_ratios(df: DataFrame) -> DataFrame:
    """Period shares by strategy; a customer without history gets the default shares."""
    cols = tuple(f"tou_ratio_{p}" for p in tf.PERIODS)
    m = history_columns(rollup.monthly_tou_ratios(df, apply_day_rules=False), cols)
    out = [F.col("customer_id"), F.col("year_month")]
    for p in tf.PERIODS:
        c, default = f"tou_ratio_{p}", F.lit(tf.DEFAULT_TOU_RATIO[p])
        prev = F.coalesce(F.col(f"{c}__prev_month"), default)
        out += [F.col(c).alias(f"{p}_observed"), prev.alias(f"{p}_prev_month"),
                F.coalesce(F.col(f"{c}__historical_mean"), default).alias(f"{p}_historical_mean"),
                F.coalesce(F.col(f"{c}__seasonal_mean"), default).alias(f"{p}_seasonal_mean"),
                (0.7 * F.col(c) + 0.3 * prev).alias(f"{p}_weighted_blend")]
    return m.select(*out)
