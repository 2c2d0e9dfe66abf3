"""Calendar, season and time-of-use column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Months of the tariff seasons; every other month is winter.
SUMMER_MONTHS = (6, 7, 8)
SPRING_FALL_MONTHS = (3, 4, 5, 9, 10)

# Hours of the mid and on-peak periods; all other hours are off-peak.
MID_PEAK_HOURS = {
    "summer": (9, 12, 17, 18, 19, 20, 21, 22),
    "spring_fall": (9, 12, 17, 18, 19, 20, 21, 22),
    "winter": (9, 12, 13, 14, 15, 16, 20, 21),
}
ON_PEAK_HOURS = {
    "summer": (10, 11, 13, 14, 15, 16),
    "spring_fall": (10, 11, 13, 14, 15, 16),
    "winter": (10, 11, 17, 18, 19, 22),
}
TOU_PERIODS = ("off_peak", "mid_peak", "on_peak")


def as_date(ts: Column) -> Column:
    return ts.cast("date")


def month_start(ts: Column) -> Column:
    """First day of the month: the ``year_month`` key of every monthly table."""
    return F.trunc(ts.cast("date"), "MM")


def month_index(ym: Column) -> Column:
    """Consecutive month number, so that calendar lags are range windows."""
    return F.year(ym) * 12 + F.month(ym)


def floor_minutes(ts: Column, minutes: int) -> Column:
    """Floor a zone-less timestamp to an interval of whole minutes within the day."""
    minute_of_day = F.hour(ts) * 60 + F.minute(ts)
    floored = minute_of_day - minute_of_day % F.lit(minutes)
    return F.date_trunc("day", ts) + F.make_dt_interval(mins=floored)


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def season(month: Column) -> Column:
    return (
        F.when(month.isin(*SUMMER_MONTHS), "summer")
        .when(month.isin(*SPRING_FALL_MONTHS), "spring_fall")
        .otherwise("winter")
    )


SEASONS = ("summer", "spring_fall", "winter")


def _period_table() -> Column:
    """72 periods, by season and hour, as one constant."""
    return F.array(*[F.lit("on_peak" if h in ON_PEAK_HOURS[s] else
                           "mid_peak" if h in MID_PEAK_HOURS[s] else "off_peak")
                     for s in SEASONS for h in range(24)])


def classify_tou(hour: Column, season_col: Column) -> Column:
    """Time-of-use period of an hour in a season, before any day rule."""
    at = F.when(season_col == "summer", 0).when(season_col == "spring_fall", 24).otherwise(48)
    return F.get(_period_table(), (at + hour).cast("int"))


def tou_period(ts: Column) -> Column:
    """Time-of-use period of a time stamp: two constant lookups, no string comparison."""
    offset = F.array(*[F.lit(0 if m in SUMMER_MONTHS else 24 if m in SPRING_FALL_MONTHS else 48)
                       for m in range(1, 13)])
    return F.get(_period_table(), F.get(offset, F.month(ts) - 1) + F.hour(ts))


def tou_with_day_rules(ts: Column, is_holiday: Column | None = None) -> Column:
    """Saturday on-peak counts as mid-peak; Sundays and holidays are off-peak."""
    base = tou_period(ts)
    dow = F.weekday(ts)
    off_day = dow == 6
    if is_holiday is not None:
        off_day = off_day | F.coalesce(is_holiday, F.lit(False))
    return (
        F.when(off_day, "off_peak")
        .when((dow == 5) & (base == "on_peak"), "mid_peak")
        .otherwise(base)
    )


def period_of_day(hour: Column) -> Column:
    return (
        F.when(hour.between(9, 17), "daytime")
        .when(hour.between(18, 22), "evening")
        .otherwise("night")
    )


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def days_in_month(date: Column) -> Column:
    return F.dayofmonth(F.last_day(date))


def billing_start(date: Column, meter_day: Column) -> Column:
    """Start of the billing month that holds ``date``.

    A meter day past the end of a month is read on the month's last day.
    """
    this_month = F.trunc(date, "MM")
    prev_month = F.add_months(this_month, -1)

    def reading_day(month):
        return F.date_add(month, F.least(meter_day, days_in_month(month)).cast("int") - 1)

    return F.when(date >= reading_day(this_month), reading_day(this_month)).otherwise(
        reading_day(prev_month)
    )
