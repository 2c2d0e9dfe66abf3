"""Feature matrix: one row per customer, month and horizon."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window as W, functions as F

from loadlens.functions import calendar as cal
from loadlens.functions.joins import small_side
from loadlens.functions.scalars import ratio
from loadlens.operators import calendar_days, horizon as hz, rollup, weather as wx
from loadlens.session import write_and_read

KEYS = ("customer_id", "year_month", "horizon_days")
CALENDAR = ("month", "days_in_month", "days_observed")
BASE = ("partial_kwh", "partial_rate", "prev_month_kwh", "ma3_kwh", "customer_mean_history")
AMI = ("observed_peak_ratio", "observed_tou_on_peak", "observed_night_ratio",
       "observed_load_factor", "observed_weekend_weekday_ratio", "observed_daily_cv",
       "observed_power_factor", "pf_vs_prev_month", "observed_reactive_ratio")
SPECIAL = ("n_workday", "n_holiday", "disruption_ratio")
WEATHER = ("hdd_full", "cdd_full", "hdd_observed", "cdd_observed", "hdd_remainder",
           "cdd_remainder", "precip_remainder", "rainy_hours_remainder", "solar_remainder")
CATEGORY_CANDIDATES = ("region_code", "usage_purpose", "industry_code")
EXTRA_NUMERIC = ("n_households", "contract_power_kw")


@dataclass(frozen=True)
class FeatureSpec:
    """Which feature groups a matrix holds; the model reads its columns from here."""

    has_weather: bool = False
    has_ami: bool = False
    has_special_days: bool = False
    extra_numeric: tuple[str, ...] = field(default_factory=tuple)
    categorical: tuple[str, ...] = field(default_factory=tuple)

    @property
    def numeric(self) -> tuple[str, ...]:
        groups = [CALENDAR, BASE]
        if self.has_weather:
            groups.append(WEATHER)
        if self.has_ami:
            groups.append(AMI)
        if self.has_special_days:
            groups.append(SPECIAL)
        groups.append(self.extra_numeric)
        return tuple(c for g in groups for c in g)

    @property
    def all(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    def without(self, columns) -> "FeatureSpec":
        """Same groups, but with the given columns left out of the model."""
        keep = tuple(c for c in self.numeric if c not in set(columns))
        return _Explicit(self.has_weather, self.has_ami, self.has_special_days, (),
                         tuple(c for c in self.categorical if c not in set(columns)), keep)

    def plus(self, columns) -> "FeatureSpec":
        """Same model with further numeric columns."""
        return _Explicit(self.has_weather, self.has_ami, self.has_special_days, (),
                         self.categorical, (*self.numeric, *columns))


@dataclass(frozen=True)
class _Explicit(FeatureSpec):
    columns: tuple[str, ...] = ()

    @property
    def numeric(self) -> tuple[str, ...]:
        return self.columns


def detect_categories(info: DataFrame, candidates=CATEGORY_CANDIDATES) -> tuple[str, ...]:
    """Category columns with more than one value: one small aggregate over the dimension."""
    have = [c for c in candidates if c in info.columns]
    if not have:
        return ()
    row = info.agg(*[(F.min(c) < F.max(c)).alias(c) for c in have]).first()
    return tuple(c for c in have if row[c])


def with_base(context: DataFrame) -> DataFrame:
    return context.withColumns({
        "month": F.month("year_month"),
        "partial_rate": ratio(F.col("partial_kwh"), F.col("days_observed")),
    })


def with_ami(rows: DataFrame, ami: DataFrame) -> DataFrame:
    """Observed load shape, and the change of power factor against the previous month."""
    w = W.partitionBy("customer_id", "horizon_days").orderBy(
        cal.month_index(F.col("year_month"))).rangeBetween(-1, -1)
    pf = F.col("observed_power_factor")
    d = ami.withColumn("pf_vs_prev_month", pf - F.max(pf).over(w))
    return rows.join(d, list(KEYS), "left")


def with_month_table(rows: DataFrame, ami_month: DataFrame) -> DataFrame:
    """Monthly load-shape features; only columns that are not there yet."""
    new = [c for c in ami_month.columns if c not in rows.columns]
    return rows.join(ami_month.select("customer_id", "year_month", *new),
                     ["customer_id", "year_month"], "left")


def build_features(
    readings: DataFrame, info: DataFrame | None = None, hourly: DataFrame | None = None,
    holidays: DataFrame | None = None, horizons=hz.HORIZONS, intraday: bool = True,
) -> tuple[DataFrame, FeatureSpec]:
    """Feature matrix and its spec.

    Readings are read once: days of customers with all their sums are written, and the daily
    table and the load shape both come from them. Dimensions join last and are measured before
    a broadcast.
    """
    if intraday:
        parts = write_and_read(rollup.day_parts(readings, holidays), "days", release=True)
        daily = rollup.daily_from_parts(parts)
    else:
        daily = rollup.daily_by_customer(readings)
    rows = with_base(hz.calendar_context(daily, horizons))
    if intraday:
        rows = with_ami(rows, rollup.ami_from_parts(parts, horizons))
    if holidays is not None:
        special = calendar_days.special_day_features(
            daily.select(cal.month_start(F.col("date")).alias("year_month")), holidays)
        rows = rows.join(F.broadcast(special.select("year_month", *SPECIAL)),  # one per month
                         "year_month", "left")
    extra: list[str] = []
    cats: tuple[str, ...] = ()
    if info is not None:
        cats = detect_categories(info)
        extra = [c for c in EXTRA_NUMERIC if c in info.columns]
        cols = [*extra, *cats, *(["station_id"] if "station_id" in info.columns else [])]
        rows = rows.join(small_side(info.select("customer_id", *cols), measure=info),
                         "customer_id", "left")
        if "n_households" in extra:
            rows = rows.withColumn("kwh_per_household", F.col("partial_kwh")
                                   / F.greatest("n_households", F.lit(1.0)))
            extra.append("kwh_per_household")
    weather = hourly is not None
    if weather:
        if "station_id" not in rows.columns:
            rows = rows.withColumn("station_id", F.lit(wx.DEFAULT_STATION))
        deg = wx.degree_features(hourly, horizons).select(
            "station_id", "year_month", "horizon_days", *WEATHER)
        rows = rows.join(small_side(deg, measure=hourly),
                         ["station_id", "year_month", "horizon_days"], "left")
    return rows, FeatureSpec(weather, intraday, holidays is not None, tuple(extra), cats)
