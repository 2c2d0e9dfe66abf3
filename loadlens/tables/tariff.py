"""Fixed values of the national tariff in force from 2026-04-16."""

from __future__ import annotations

# Residential tiers. season, tier, upper bound (kWh); the last tier has none.
TIER_BOUND_ROWS = (
    ("normal", 1, 200.0),
    ("normal", 2, 400.0),
    ("summer", 1, 300.0),
    ("summer", 2, 450.0),
)
# Residential charges. tariff, tier, base charge (won), energy rate (won/kWh).
TIER_CHARGE_ROWS = (
    ("res_low", 1, 910.0, 120.0),
    ("res_low", 2, 1600.0, 214.6),
    ("res_low", 3, 7300.0, 307.3),
    ("res_high", 1, 730.0, 105.0),
    ("res_high", 2, 1260.0, 174.0),
    ("res_high", 3, 6060.0, 242.3),
)
TIER_BOUNDS = {season: tuple(b for s, _, b in TIER_BOUND_ROWS if s == season)
               for season in ("normal", "summer")}
TIER_BASE = {tariff: tuple(base for t, _, base, _ in TIER_CHARGE_ROWS if t == tariff)
             for tariff in ("res_low", "res_high")}
TIER_RATE = {tariff: tuple(rate for t, _, _, rate in TIER_CHARGE_ROWS if t == tariff)
             for tariff in ("res_low", "res_high")}
# Rate of the part above 1000 kWh in a super-user month, and those months.
SUPER_USER_KWH = 1000.0
SUPER_USER_RATE = {"res_low": 736.2, "res_high": 601.3}
SUPER_USER_MONTHS = (7, 8, 12, 1, 2)
RESIDENTIAL_SUMMER = (7, 8)

# General tariffs. tariff, option, season, period, energy rate (won/kWh),
# base charge (won/kW); period is "all" where one rate holds all day.
RATES = (
    ("gap_i", "low", "summer", "all", 123.6, 5230.0),
    ("gap_i", "low", "spring_fall", "all", 86.4, 5230.0),
    ("gap_i", "low", "winter", "all", 110.8, 5230.0),
    ("gap_i", "high_a_1", "summer", "all", 123.3, 5550.0),
    ("gap_i", "high_a_1", "spring_fall", "all", 86.5, 5550.0),
    ("gap_i", "high_a_1", "winter", "all", 109.3, 5550.0),
    ("gap_i", "high_a_2", "summer", "all", 118.8, 6370.0),
    ("gap_i", "high_a_2", "spring_fall", "all", 82.1, 6370.0),
    ("gap_i", "high_a_2", "winter", "all", 104.8, 6370.0),
    ("gap_i", "high_b_1", "summer", "all", 122.6, 5550.0),
    ("gap_i", "high_b_1", "spring_fall", "all", 86.1, 5550.0),
    ("gap_i", "high_b_1", "winter", "all", 108.5, 5550.0),
    ("gap_i", "high_b_2", "summer", "all", 118.1, 6370.0),
    ("gap_i", "high_b_2", "spring_fall", "all", 81.6, 6370.0),
    ("gap_i", "high_b_2", "winter", "all", 104.0, 6370.0),
    ("eul_small", "low", "summer", "all", 132.4, 6160.0),
    ("eul_small", "low", "spring_fall", "all", 91.9, 6160.0),
    ("eul_small", "low", "winter", "all", 119.0, 6160.0),
    ("eul_small", "high_a_1", "summer", "all", 142.6, 7170.0),
    ("eul_small", "high_a_1", "spring_fall", "all", 98.6, 7170.0),
    ("eul_small", "high_a_1", "winter", "all", 130.3, 7170.0),
    ("eul_small", "high_a_2", "summer", "all", 138.6, 8230.0),
    ("eul_small", "high_a_2", "spring_fall", "all", 94.3, 8230.0),
    ("eul_small", "high_a_2", "winter", "all", 125.0, 8230.0),
    ("eul_small", "high_b_1", "summer", "all", 140.5, 7170.0),
    ("eul_small", "high_b_1", "spring_fall", "all", 97.5, 7170.0),
    ("eul_small", "high_b_1", "winter", "all", 127.3, 7170.0),
    ("eul_small", "high_b_2", "summer", "all", 135.2, 8230.0),
    ("eul_small", "high_b_2", "spring_fall", "all", 92.2, 8230.0),
    ("eul_small", "high_b_2", "winter", "all", 122.0, 8230.0),
    ("gap_ii", "high_a_1", "summer", "off_peak", 76.5, 6090.0),
    ("gap_ii", "high_a_1", "summer", "mid_peak", 121.2, 6090.0),
    ("gap_ii", "high_a_1", "summer", "on_peak", 187.1, 6090.0),
    ("gap_ii", "high_a_1", "spring_fall", "off_peak", 76.5, 6090.0),
    ("gap_ii", "high_a_1", "spring_fall", "mid_peak", 90.9, 6090.0),
    ("gap_ii", "high_a_1", "spring_fall", "on_peak", 111.4, 6090.0),
    ("gap_ii", "high_a_1", "winter", "off_peak", 80.5, 6090.0),
    ("gap_ii", "high_a_1", "winter", "mid_peak", 119.7, 6090.0),
    ("gap_ii", "high_a_1", "winter", "on_peak", 158.4, 6090.0),
    ("gap_ii", "high_a_2", "summer", "off_peak", 72.0, 6980.0),
    ("gap_ii", "high_a_2", "summer", "mid_peak", 116.7, 6980.0),
    ("gap_ii", "high_a_2", "summer", "on_peak", 182.6, 6980.0),
    ("gap_ii", "high_a_2", "spring_fall", "off_peak", 72.0, 6980.0),
    ("gap_ii", "high_a_2", "spring_fall", "mid_peak", 86.4, 6980.0),
    ("gap_ii", "high_a_2", "spring_fall", "on_peak", 106.9, 6980.0),
    ("gap_ii", "high_a_2", "winter", "off_peak", 76.0, 6980.0),
    ("gap_ii", "high_a_2", "winter", "mid_peak", 115.2, 6980.0),
    ("gap_ii", "high_a_2", "winter", "on_peak", 153.9, 6980.0),
    ("gap_ii", "high_b_1", "summer", "off_peak", 75.0, 6090.0),
    ("gap_ii", "high_b_1", "summer", "mid_peak", 118.5, 6090.0),
    ("gap_ii", "high_b_1", "summer", "on_peak", 181.4, 6090.0),
    ("gap_ii", "high_b_1", "spring_fall", "off_peak", 75.0, 6090.0),
    ("gap_ii", "high_b_1", "spring_fall", "mid_peak", 89.2, 6090.0),
    ("gap_ii", "high_b_1", "spring_fall", "on_peak", 109.0, 6090.0),
    ("gap_ii", "high_b_1", "winter", "off_peak", 78.8, 6090.0),
    ("gap_ii", "high_b_1", "winter", "mid_peak", 116.8, 6090.0),
    ("gap_ii", "high_b_1", "winter", "on_peak", 154.1, 6090.0),
    ("gap_ii", "high_b_2", "summer", "off_peak", 70.5, 6980.0),
    ("gap_ii", "high_b_2", "summer", "mid_peak", 114.0, 6980.0),
    ("gap_ii", "high_b_2", "summer", "on_peak", 176.9, 6980.0),
    ("gap_ii", "high_b_2", "spring_fall", "off_peak", 70.5, 6980.0),
    ("gap_ii", "high_b_2", "spring_fall", "mid_peak", 84.7, 6980.0),
    ("gap_ii", "high_b_2", "spring_fall", "on_peak", 104.5, 6980.0),
    ("gap_ii", "high_b_2", "winter", "off_peak", 74.3, 6980.0),
    ("gap_ii", "high_b_2", "winter", "mid_peak", 112.3, 6980.0),
    ("gap_ii", "high_b_2", "winter", "on_peak", 149.6, 6980.0),
    ("eul_small_tou", "high_a_1", "summer", "off_peak", 89.4, 7170.0),
    ("eul_small_tou", "high_a_1", "summer", "mid_peak", 140.6, 7170.0),
    ("eul_small_tou", "high_a_1", "summer", "on_peak", 163.1, 7170.0),
    ("eul_small_tou", "high_a_1", "spring_fall", "off_peak", 89.4, 7170.0),
    ("eul_small_tou", "high_a_1", "spring_fall", "mid_peak", 96.8, 7170.0),
    ("eul_small_tou", "high_a_1", "spring_fall", "on_peak", 108.1, 7170.0),
    ("eul_small_tou", "high_a_1", "winter", "off_peak", 98.1, 7170.0),
    ("eul_small_tou", "high_a_1", "winter", "mid_peak", 128.5, 7170.0),
    ("eul_small_tou", "high_a_1", "winter", "on_peak", 143.3, 7170.0),
    ("eul_small_tou", "high_a_2", "summer", "off_peak", 84.1, 8230.0),
    ("eul_small_tou", "high_a_2", "summer", "mid_peak", 135.3, 8230.0),
    ("eul_small_tou", "high_a_2", "summer", "on_peak", 157.8, 8230.0),
    ("eul_small_tou", "high_a_2", "spring_fall", "off_peak", 84.1, 8230.0),
    ("eul_small_tou", "high_a_2", "spring_fall", "mid_peak", 91.5, 8230.0),
    ("eul_small_tou", "high_a_2", "spring_fall", "on_peak", 102.8, 8230.0),
    ("eul_small_tou", "high_a_2", "winter", "off_peak", 92.8, 8230.0),
    ("eul_small_tou", "high_a_2", "winter", "mid_peak", 123.2, 8230.0),
    ("eul_small_tou", "high_a_2", "winter", "on_peak", 138.0, 8230.0),
    ("eul_small_tou", "high_b_1", "summer", "off_peak", 88.8, 7170.0),
    ("eul_small_tou", "high_b_1", "summer", "mid_peak", 137.4, 7170.0),
    ("eul_small_tou", "high_b_1", "summer", "on_peak", 153.8, 7170.0),
    ("eul_small_tou", "high_b_1", "spring_fall", "off_peak", 88.8, 7170.0),
    ("eul_small_tou", "high_b_1", "spring_fall", "mid_peak", 94.7, 7170.0),
    ("eul_small_tou", "high_b_1", "spring_fall", "on_peak", 100.1, 7170.0),
    ("eul_small_tou", "high_b_1", "winter", "off_peak", 97.8, 7170.0),
    ("eul_small_tou", "high_b_1", "winter", "mid_peak", 125.1, 7170.0),
    ("eul_small_tou", "high_b_1", "winter", "on_peak", 139.3, 7170.0),
    ("eul_small_tou", "high_b_2", "summer", "off_peak", 83.5, 8230.0),
    ("eul_small_tou", "high_b_2", "summer", "mid_peak", 132.1, 8230.0),
    ("eul_small_tou", "high_b_2", "summer", "on_peak", 148.5, 8230.0),
    ("eul_small_tou", "high_b_2", "spring_fall", "off_peak", 83.5, 8230.0),
    ("eul_small_tou", "high_b_2", "spring_fall", "mid_peak", 89.4, 8230.0),
    ("eul_small_tou", "high_b_2", "spring_fall", "on_peak", 94.8, 8230.0),
    ("eul_small_tou", "high_b_2", "winter", "off_peak", 92.5, 8230.0),
    ("eul_small_tou", "high_b_2", "winter", "mid_peak", 119.8, 8230.0),
    ("eul_small_tou", "high_b_2", "winter", "on_peak", 134.0, 8230.0),
    ("eul_large", "high_a_1", "summer", "off_peak", 92.8, 7220.0),
    ("eul_large", "high_a_1", "summer", "mid_peak", 145.7, 7220.0),
    ("eul_large", "high_a_1", "summer", "on_peak", 227.8, 7220.0),
    ("eul_large", "high_a_1", "spring_fall", "off_peak", 92.8, 7220.0),
    ("eul_large", "high_a_1", "spring_fall", "mid_peak", 115.3, 7220.0),
    ("eul_large", "high_a_1", "spring_fall", "on_peak", 146.0, 7220.0),
    ("eul_large", "high_a_1", "winter", "off_peak", 99.8, 7220.0),
    ("eul_large", "high_a_1", "winter", "mid_peak", 145.9, 7220.0),
    ("eul_large", "high_a_1", "winter", "on_peak", 203.4, 7220.0),
    ("eul_large", "high_a_2", "summer", "off_peak", 87.3, 8320.0),
    ("eul_large", "high_a_2", "summer", "mid_peak", 140.2, 8320.0),
    ("eul_large", "high_a_2", "summer", "on_peak", 222.3, 8320.0),
    ("eul_large", "high_a_2", "spring_fall", "off_peak", 87.3, 8320.0),
    ("eul_large", "high_a_2", "spring_fall", "mid_peak", 109.8, 8320.0),
    ("eul_large", "high_a_2", "spring_fall", "on_peak", 140.5, 8320.0),
    ("eul_large", "high_a_2", "winter", "off_peak", 94.3, 8320.0),
    ("eul_large", "high_a_2", "winter", "mid_peak", 140.4, 8320.0),
    ("eul_large", "high_a_2", "winter", "on_peak", 197.9, 8320.0),
    ("eul_large", "high_a_3", "summer", "off_peak", 86.4, 9810.0),
    ("eul_large", "high_a_3", "summer", "mid_peak", 139.6, 9810.0),
    ("eul_large", "high_a_3", "summer", "on_peak", 209.9, 9810.0),
    ("eul_large", "high_a_3", "spring_fall", "off_peak", 86.4, 9810.0),
    ("eul_large", "high_a_3", "spring_fall", "mid_peak", 108.5, 9810.0),
    ("eul_large", "high_a_3", "spring_fall", "on_peak", 132.2, 9810.0),
    ("eul_large", "high_a_3", "winter", "off_peak", 93.7, 9810.0),
    ("eul_large", "high_a_3", "winter", "mid_peak", 139.8, 9810.0),
    ("eul_large", "high_a_3", "winter", "on_peak", 186.7, 9810.0),
    ("eul_large", "high_b_1", "summer", "off_peak", 95.9, 6630.0),
    ("eul_large", "high_b_1", "summer", "mid_peak", 148.2, 6630.0),
    ("eul_large", "high_b_1", "summer", "on_peak", 229.4, 6630.0),
    ("eul_large", "high_b_1", "spring_fall", "off_peak", 95.9, 6630.0),
    ("eul_large", "high_b_1", "spring_fall", "mid_peak", 118.2, 6630.0),
    ("eul_large", "high_b_1", "spring_fall", "on_peak", 148.5, 6630.0),
    ("eul_large", "high_b_1", "winter", "off_peak", 102.9, 6630.0),
    ("eul_large", "high_b_1", "winter", "mid_peak", 148.2, 6630.0),
    ("eul_large", "high_b_1", "winter", "on_peak", 204.4, 6630.0),
    ("eul_large", "high_b_2", "summer", "off_peak", 92.1, 7380.0),
    ("eul_large", "high_b_2", "summer", "mid_peak", 144.4, 7380.0),
    ("eul_large", "high_b_2", "summer", "on_peak", 225.6, 7380.0),
    ("eul_large", "high_b_2", "spring_fall", "off_peak", 92.1, 7380.0),
    ("eul_large", "high_b_2", "spring_fall", "mid_peak", 114.4, 7380.0),
    ("eul_large", "high_b_2", "spring_fall", "on_peak", 144.7, 7380.0),
    ("eul_large", "high_b_2", "winter", "off_peak", 99.1, 7380.0),
    ("eul_large", "high_b_2", "winter", "mid_peak", 144.4, 7380.0),
    ("eul_large", "high_b_2", "winter", "on_peak", 200.6, 7380.0),
)

# Contract name -> tariff and option, in matching order.
CONTRACT_TARIFF = (
    ("주택용", "res_low"),
    ("주택용(저압)", "res_low"),
    ("주택용(고압)", "res_high"),
    ("주택용저압", "res_low"),
    ("주택용고압", "res_high"),
    ("일반용", "eul_small/low"),
    ("일반용(갑)", "gap_i/low"),
    ("일반용(갑)I", "gap_i/low"),
    ("일반용(갑)II", "gap_ii/high_a_1"),
    ("일반용(갑)Ⅰ", "gap_i/low"),
    ("일반용(갑)Ⅱ", "gap_ii/high_a_1"),
    ("일반용(을)", "eul_small/low"),
    ("일반용(을)저압", "eul_small/low"),
    ("일반용(을)고압A", "eul_large/high_a_1"),
    ("일반용(을)고압B", "eul_large/high_b_1"),
    ("일반용(을)고압C", "eul_large/high_a_1"),
)
DEFAULT_TARIFF = "eul_small/low"

# Default shares of the periods, surcharges, taxes.
DEFAULT_TOU_RATIO = {"off_peak": 0.3, "mid_peak": 0.4, "on_peak": 0.3}
CLIMATE_RATE = 9.0
FUEL_RATE = 5.0
VAT_RATE = 0.10
FUND_RATE = 0.027
BASE_POWER_FACTOR = 0.90

# Welfare discounts. name, rate, cap, summer cap, group, may be stacked.
WELFARE = (
    ("없음", 0.0, 0.0, 0.0, None, False),
    ("기초생활(생계/의료)", 1.0, 16000.0, 20000.0, "2", True),
    ("기초생활(주거/교육)", 1.0, 10000.0, 12000.0, "2", True),
    ("차상위계층", 1.0, 8000.0, 10000.0, "2", True),
    ("장애인(심한)", 1.0, 16000.0, 20000.0, "2", False),
    ("국가유공자", 1.0, 16000.0, 20000.0, "2", False),
    ("독립유공자", 1.0, 16000.0, 20000.0, "2", False),
    ("사회복지시설", 0.3, 0.0, 0.0, "3", False),
    ("다자녀(3자녀+)", 0.3, 16000.0, 16000.0, "4", False),
    ("대가족(5인+)", 0.3, 16000.0, 16000.0, "4", False),
    ("출산가구", 0.3, 16000.0, 16000.0, "4", False),
    ("생명유지장치", 0.3, 0.0, 0.0, "4", False),
)
NO_WELFARE = "없음"

SEASONS = ("summer", "spring_fall", "winter")
PERIODS = ("off_peak", "mid_peak", "on_peak")
RATE_COLUMNS = ("tariff_key", "tariff_type", "base_per_kw",
                *[f"flat_{s}" for s in SEASONS],
                *[f"{p}_{s}" for s in SEASONS for p in PERIODS])


def rate_rows() -> list[tuple]:
    """One row per general tariff option: key, type, base, 3 flat and 9 period rates."""
    options: dict[str, dict] = {}
    for tariff, option, season, period, rate, base in RATES:
        own = options.setdefault(f"{tariff}/{option}", {"base": base})
        own[season, period] = rate
    rows = []
    for key, own in options.items():
        flat = [own.get((s, "all"), 0.0) for s in SEASONS]
        periods = [own.get((s, p), 0.0) for s in SEASONS for p in PERIODS]
        rows.append((key, "tou" if any(periods) else "seasonal_flat", own["base"], *flat, *periods))
    return rows
