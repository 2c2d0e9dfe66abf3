"""Worked bills, discounts and tariff matching."""

import pytest
from pyspark.sql import functions as F

from loadlens.operators import billing as b

# contract, kW, kWh, month, meter day, power factor, final won
GOLDEN = [
    ("일반용(갑)I", 50.0, 1000.0, 4, 1, None, 407860),
    ("일반용(갑)I", 50.0, 1000.0, 6, 15, None, 426790),
    ("일반용(을)저압", 100.0, 1000.0, 7, 1, None, 859220),
    ("일반용(을)저압", 100.0, 1000.0, 7, 1, 0.95, 852274),
    ("일반용(을)저압", 100.0, 1000.0, 7, 1, 0.85, 866166),
    ("일반용(을)고압A", 500.0, 5000.0, 7, 1, None, 5017740),
]
SCHEMA = "contract_type string, kw double, kwh double, month int, md int, pf double, want bigint"


def test_golden_bills(spark):
    d = b.with_bill(spark.createDataFrame(GOLDEN, SCHEMA), max_demand="kw", meter_day="md", pf="pf")
    got = d.select("want", "bill.final_won").collect()
    assert [r.final_won for r in got] == [r.want for r in got]


def test_residential_tiers(spark):
    cases = [(0.0, 4, 0, 0), (200.0, 4, 910 + 24000, 1), (350.0, 4, 57790, 2),
             (350.0, 7, 1600 + 300 * 120 + 10730, 2), (450.5, 7, None, 3)]
    d = spark.createDataFrame([("주택용", *c) for c in cases],
                              "contract_type string, kwh double, month int, want int, tier int")
    for r in b.with_bill(d).select("want", "tier", "bill.elec_won", F.col("bill.tier").alias("t")
                                   ).collect():
        assert r.t == r.tier
        assert r.want is None or r.elec_won == r.want


def test_super_user_only_in_its_months(spark):
    d = spark.createDataFrame([("주택용", 1200.0, m) for m in (1, 4)],
                              "contract_type string, kwh double, month int")
    got = {r.month: r.super_user_extra for r in b.with_bill(d).select("month", "bill.*").collect()}
    assert got == {1: round(200 * (736.2 - 307.3)), 4: 0}


@pytest.mark.parametrize("name,key", [
    ("주택용", "res_low"), ("주택용(고압)", "res_high"), ("일반용 (갑) I", "gap_i/low"),
    ("일반용(을)고압B", "eul_large/high_b_1"), ("일반용(을)고압B선택2", "eul_small/low"),
    ("산업용", "eul_small/low"), (None, "eul_small/low")])
def test_tariff_key(spark, name, key):
    d = spark.createDataFrame([(name,)], "c string").select(b.tariff_key(F.col("c")).alias("k"))
    assert d.first().k == key


def test_compat_prices_high_voltage_b_as_a(spark):
    d = spark.createDataFrame([("일반용(을)고압B", 1000.0, 7)],
                              "contract_type string, kwh double, month int")
    key = lambda compat: b.with_bill(d, compat=compat).first().bill.tariff_key
    assert (key(False), key(True)) == ("eul_large/high_b_1", "eul_large/high_a_1")


def test_welfare(spark):
    cases = [([], 100000.0, 0, "없음"), (["없음"], 100000.0, 0, "없음"),
             (["차상위계층", "다자녀(3자녀+)"], 100000.0, 8000 + 16000, "차상위계층 + 다자녀(3자녀+) (중복)"),
             (["장애인(심한)", "다자녀(3자녀+)"], 100000.0, 16000, "장애인(심한)"),
             (["사회복지시설", "장애인(심한)"], 100000.0, 30000, "사회복지시설"),
             (["차상위계층", "생명유지장치"], 100000.0, 8000 + 27600, "차상위계층 + 생명유지장치 (중복)"),
             (["unknown"], 100000.0, 0, "없음")]
    d = spark.createDataFrame([(c[0], c[1], c[2], c[3]) for c in cases],
                              "types array<string>, won double, want int, name string")
    got = d.withColumn("w", b.welfare_discount(F.col("won"), F.col("types"), F.lit(False))).collect()
    for r in got:
        assert (int(r.w.discount), r.w.desc) == (r.want, r.name)


def test_blended_parts_add_up(spark):
    d = spark.createDataFrame([(m, md) for m in range(1, 13) for md in range(1, 32)],
                              "month int, md int")
    p = b.billing_parts(F.col("month"), F.col("md"))
    got = d.select(p["prev_share"].alias("s")).collect()
    assert all(0.0 <= r.s <= 1.0 for r in got)


def test_bill_increase(spark):
    d = spark.createDataFrame([("주택용", 450.0, 300.0, 4), ("주택용", 300.0, 0.0, 4)],
                              "contract_type string, p double, v double, month int")
    a, z = b.bill_increase(d, "p", "v").collect()
    assert a.kwh_change_pct == 50.0 and a.tier_prev == 2 and a.tier_pred == 3
    assert a.amplification == pytest.approx(a.won_change_pct / 50.0, abs=0.01)
    assert z.kwh_change_pct == 0.0
