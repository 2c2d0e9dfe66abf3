"""Weather features, national and regional series, station joins and corrections.

Station weather is small next to readings, but its size is measured before a
broadcast. Typical-year and monthly tables have at most a few rows per station
and month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions import calendar as cal
from loadlens.functions.chunks import with_neighbours
from loadlens.functions.joins import small_side
from loadlens.functions.scalars import cdd, hdd, ratio, sum0, sum_if
from loadlens.schema import literal_map

HDD_BASE, CDD_BASE = 15.0, 24.0
STATIONS = (108, 112, 119, 114, 133, 143, 156, 159)
DEFAULT_STATION = 108

# Station weights of the national series. version, station, weight.
STATION_WEIGHTS = (
    ("national_v1_paper", 108, 0.4376),
    ("national_v1_paper", 112, 0.0558),
    ("national_v1_paper", 119, 0.0448),
    ("national_v1_paper", 114, 0.0306),
    ("national_v1_paper", 133, 0.0633),
    ("national_v1_paper", 143, 0.0838),
    ("national_v1_paper", 156, 0.0647),
    ("national_v1_paper", 159, 0.2194),
    ("national_v2_power", 108, 0.1613),
    ("national_v2_power", 112, 0.0696),
    ("national_v2_power", 119, 0.1441),
    ("national_v2_power", 114, 0.0383),
    ("national_v2_power", 133, 0.1547),
    ("national_v2_power", 143, 0.1274),
    ("national_v2_power", 156, 0.1223),
    ("national_v2_power", 159, 0.1823),
    ("national_v3_population", 108, 0.3702),
    ("national_v3_population", 112, 0.0558),
    ("national_v3_population", 119, 0.0721),
    ("national_v3_population", 114, 0.0306),
    ("national_v3_population", 133, 0.1033),
    ("national_v3_population", 143, 0.1038),
    ("national_v3_population", 156, 0.1047),
    ("national_v3_population", 159, 0.1594),
    ("national_v4_equal", 108, 0.125),
    ("national_v4_equal", 112, 0.125),
    ("national_v4_equal", 119, 0.125),
    ("national_v4_equal", 114, 0.125),
    ("national_v4_equal", 133, 0.125),
    ("national_v4_equal", 143, 0.125),
    ("national_v4_equal", 156, 0.125),
    ("national_v4_equal", 159, 0.125),
    ("national_v5_seoul", 108, 1.0),
    ("national_v5_seoul", 112, 0.0),
    ("national_v5_seoul", 119, 0.0),
    ("national_v5_seoul", 114, 0.0),
    ("national_v5_seoul", 133, 0.0),
    ("national_v5_seoul", 143, 0.0),
    ("national_v5_seoul", 156, 0.0),
    ("national_v5_seoul", 159, 0.0),
)
WEIGHT_VERSIONS = tuple(dict.fromkeys(version for version, _, _ in STATION_WEIGHTS))
# Weather region of a station and weight of a region.
STATION_REGION = {108: "서울", 112: "인천", 119: "수원", 101: "강원", 105: "강원", 114: "강원", 131: "대전",
                  133: "대전", 146: "광주", 156: "광주", 165: "광주", 143: "대구", 159: "부산",
                  184: "제주"}
REGION_WEIGHTS = {"서울": 0.4376, "인천": 0.0558, "수원": 0.0448, "강원": 0.0306, "대전": 0.0633,
                  "대구": 0.0838, "광주": 0.0647, "부산": 0.2194, "제주": 0.0}
# Keyword in a branch name -> station.
BRANCH_STATION = {
    "서울": 108, "남서울": 108, "인천": 112, "경기": 119, "수원": 119, "강원": 114, "원주": 114,
    "춘천": 114, "강릉": 114, "대전": 133, "충남": 133, "대전충남": 133, "충북": 133, "청주": 133,
    "세종": 133, "전북": 156, "전주": 156, "광주": 156, "전남": 156, "광주전남": 156, "목포": 156,
    "대구": 143, "경북": 143, "대구경북": 143, "부산": 159, "경남": 159, "울산": 159, "제주": 184,
}
# Observed station -> station of the typical-year series.
TYPICAL_STATION = {108: 108, 112: 112, 114: 101, 119: 119, 133: 133, 143: 143, 156: 156,
                   159: 159, 184: 184}


def weights_map(version: str = "national_v1_paper") -> dict[int, float]:
    return {s: w for v, s, w in STATION_WEIGHTS if v == version and w > 0}


# --- monthly features ---------------------------------------------------------------------------

def _degree_columns(hdd_base: float, cdd_base: float) -> list[Column]:
    t, hour = F.col("temp_c"), F.hour("ts")
    c, h, p = cdd(t, cdd_base), hdd(t, hdd_base), cal.period_of_day(hour)
    cols = [sum0(c).alias("cdh_total"), sum0(h).alias("hdh_total"),
            F.avg(t).alias("temp_mean"), F.max(t).alias("temp_max"), F.min(t).alias("temp_min")]
    for name in ("daytime", "evening", "night"):
        cols += [sum_if(p == name, c).alias(f"cdh_{name}"),
                 sum_if(p == name, h).alias(f"hdh_{name}")]
    return cols


def monthly_weather_features(hourly: DataFrame, hdd_base: float = HDD_BASE,
                             cdd_base: float = CDD_BASE) -> DataFrame:
    """Station-month features in one aggregation; months without a temperature are absent."""
    have = hourly.columns
    extra = [F.avg(c).alias(f"{c}_mean") for c in ("humidity", "wind_speed", "solar_mj")
             if c in have]
    if "precip_mm" in have:
        rain = F.coalesce("precip_mm", F.lit(0.0))
        extra += [F.sum(rain).alias("precip_sum"),
                  F.sum(F.when(rain > 0, 1).otherwise(0)).alias("rainy_hours")]
    out = hourly.groupBy("station_id", cal.month_start(F.col("ts")).alias("year_month")).agg(
        F.count("temp_c").alias("_n"), *_degree_columns(hdd_base, cdd_base), *extra)
    return out.where(F.col("_n") > 0).drop("_n")


def monthly_degree_hours(hourly: DataFrame, hdd_base: float = HDD_BASE,
                         cdd_base: float = CDD_BASE) -> DataFrame:
    return monthly_weather_features(hourly.select("station_id", "ts", "temp_c"),
                                    hdd_base, cdd_base)


def weighted_mean(df: DataFrame, keys: list[str], columns: list[str],
                  weight: Column) -> DataFrame:
    """Mean per column over the rows that hold a value, weights renormalized per column."""
    d = df.withColumn("_w", weight).where(F.col("_w") > 0)
    return d.groupBy(*keys).agg(*[
        ratio(F.sum(F.col(c) * F.col("_w")),
              F.sum(F.when(F.col(c).isNotNull(), F.col("_w")))).alias(c) for c in columns])


def national_series(features: DataFrame, weights: dict[int, float] | None = None,
                    keys: tuple[str, ...] = ("year_month",)) -> DataFrame:
    w = literal_map({int(k): float(v) for k, v in (weights or weights_map()).items()})
    cols = [c for c in features.columns if c not in ("station_id", "station_name", *keys)]
    return weighted_mean(features, list(keys), cols,
                         F.try_element_at(w, F.col("station_id").cast("int")))


def national_versions(features: DataFrame) -> DataFrame:
    """All weight versions in one table: (version, year_month, features)."""
    table = F.array(*[F.struct(F.lit(v).alias("version"), literal_map(weights_map(v)).alias("w"))
                      for v in WEIGHT_VERSIONS])
    d = features.withColumn("_v", F.explode(table)).withColumn("version", F.col("_v.version"))
    cols = [c for c in features.columns if c not in ("station_id", "year_month")]
    weight = F.try_element_at(F.col("_v.w"), F.col("station_id").cast("int"))
    return weighted_mean(d, ["version", "year_month"], cols, weight)


def regional_hourly(hourly: DataFrame, columns: list[str]) -> DataFrame:
    region = F.try_element_at(literal_map(STATION_REGION), F.col("station_id").cast("int"))
    d = hourly.withColumn("region", region).where(F.col("region").isNotNull())
    return d.groupBy("region", "ts").agg(*[F.avg(c).alias(c) for c in columns])


def national_hourly(hourly: DataFrame, columns: list[str],
                    weights: dict[str, float] | None = None) -> DataFrame:
    """Stations to region means, regions to one national series."""
    w = literal_map({k: float(v) for k, v in (weights or REGION_WEIGHTS).items()})
    return weighted_mean(regional_hourly(hourly, columns), ["ts"], columns,
                         F.try_element_at(w, F.col("region")))


def weather_sources(customers: DataFrame, hourly: DataFrame,
                    columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Customers with the key ``src`` of their weather series (own station, else own region,
    else national), and the series themselves (src, ts, columns), once each."""
    station = hourly.select(F.concat(F.lit("s"), F.col("station_id").cast("string")).alias("src"),
                            "ts", *columns)
    region = regional_hourly(hourly, columns).select(
        F.concat(F.lit("r"), F.col("region")).alias("src"), "ts", *columns)
    nation = national_hourly(hourly, columns).select(F.lit("n").alias("src"), "ts", *columns)
    series = station.unionByName(region).unionByName(nation)
    have = series.select("src").distinct()
    d = customers
    for name, value in (("_s", F.concat(F.lit("s"), F.col("station_id").cast("string"))),
                        ("_r", F.concat(F.lit("r"), F.col("region")))):
        d = d.withColumn(name, value).join(
            F.broadcast(have.withColumnRenamed("src", name).withColumn(f"{name}ok", F.lit(True))),
            name, "left")
    src = F.when(F.col("_sok"), F.col("_s")).when(F.col("_rok"), F.col("_r")).otherwise("n")
    return d.withColumn("src", src).drop("_s", "_r", "_sok", "_rok"), series


def attach_customer_weather(df: DataFrame, customers: DataFrame, hourly: DataFrame,
                            columns: list[str]) -> DataFrame:
    """Weather of the customer's series on each reading: one equi-join on (series, hour)."""
    place, series = weather_sources(customers, hourly, columns)
    own = df.join(small_side(place.select("customer_id", "src")), "customer_id", "left")
    own = own.withColumn("_th", cal.floor_hour(F.col("ts")))
    w = series.select(F.col("src").alias("_src"), F.col("ts").alias("_h"), *columns)
    return own.join(small_side(w, measure=hourly), (F.col("src") == F.col("_src"))
                    & (F.col("_th") == F.col("_h")), "left").drop("_th", "_h", "_src")


def split_observed_remainder(hourly: DataFrame, horizons=(10, 20), hdd_base: float = HDD_BASE,
                             cdd_base: float = CDD_BASE) -> DataFrame:
    """Temperature mean and degree hours before and after day h, and for the month."""
    t, day = F.col("temp_c"), F.dayofmonth("ts")
    d = hourly.where(t.isNotNull()).groupBy(
        "station_id", F.to_date("ts").alias("date")).agg(
        F.sum(t).alias("t"), F.count(t).alias("n"), F.sum(cdd(t, cdd_base)).alias("cdh"),
        F.sum(hdd(t, hdd_base)).alias("hdh"))
    d = d.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    day = F.dayofmonth("date")
    parts = {"obs": day <= F.col("horizon_days"), "rem": day > F.col("horizon_days"),
             "full": F.lit(True)}
    aggs = []
    for name, cond in parts.items():
        aggs += [ratio(F.sum(F.when(cond, F.col("t"))), F.sum(F.when(cond, F.col("n"))))
                 .alias(f"{name}_temp_mean"),
                 F.sum(F.when(cond, F.col("cdh"))).alias(f"{name}_cdh"),
                 F.sum(F.when(cond, F.col("hdh"))).alias(f"{name}_hdh")]
    return d.groupBy("station_id", F.trunc("date", "MM").alias("year_month"),
                     "horizon_days").agg(*aggs)


def degree_features(hourly: DataFrame, horizons=(10, 20),
                    remainder: DataFrame | None = None) -> DataFrame:
    """HDD and CDD of the mean daily temperature of the month, its observed and its rest, and
    the rain and radiation of the rest (null where the source has none).

    ``remainder`` (station_id, month, temp_c) replaces the rest, as a forecast
    of typical weather would.
    """
    have = {c: F.col(c) if c in hourly.columns else F.lit(None).cast("double")
            for c in ("precip_mm", "solar_mj")}
    day = hourly.groupBy("station_id", F.to_date("ts").alias("date")).agg(
        F.avg("temp_c").alias("t"), F.sum(have["precip_mm"]).alias("precip"),
        F.count(F.when(have["precip_mm"] > 0, 1)).alias("rainy_hours"),
        F.sum(have["solar_mj"]).alias("solar"))
    if "precip_mm" not in hourly.columns:
        day = day.withColumn("rainy_hours", F.lit(None).cast("bigint"))
    d = day.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    seen = F.dayofmonth("date") <= F.col("horizon_days")
    m = d.groupBy("station_id", F.trunc("date", "MM").alias("year_month"), "horizon_days").agg(
        F.avg("t").alias("temp_full_mean"),
        F.avg(F.when(seen, F.col("t"))).alias("temp_observed_mean"),
        F.avg(F.when(~seen, F.col("t"))).alias("temp_remainder_mean"),
        *[F.sum(F.when(~seen, F.col(c))).alias(f"{c}_remainder")
          for c in ("precip", "rainy_hours", "solar")])
    if remainder is not None:
        r = remainder.select("station_id", F.col("month").alias("_m"), F.col("temp_c").alias("_t"))
        m = m.withColumn("_m", F.month("year_month")).join(
            small_side(r), ["station_id", "_m"], "left").withColumn(
            "temp_remainder_mean", F.coalesce("_t", "temp_remainder_mean")).drop("_m", "_t")
    out = {}
    for part in ("full", "observed", "remainder"):
        t = F.col(f"temp_{part}_mean")
        out[f"hdd_{part}"], out[f"cdd_{part}"] = hdd(t), cdd(t)
    return m.withColumns(out)


# --- typical year -------------------------------------------------------------------------------

def typical_hourly(raw: DataFrame) -> DataFrame:
    """Typical-year series under the observed station and column names.

    A typical series that serves another observed station is re-keyed to it;
    Wh/m2 to MJ/m2 is 0.0036.
    """
    serves = {v: k for k, v in TYPICAL_STATION.items()}
    station = F.try_element_at(literal_map(serves), F.col("station_id").cast("int"))
    d = raw.withColumn("station_id", station).where(F.col("station_id").isNotNull())
    return d.select(
        "station_id", "ts", "temp_c", F.month("ts").alias("month"), F.hour("ts").alias("hour"),
        F.dayofyear("ts").alias("day_of_year"), F.col("rh_pct").alias("humidity"),
        F.col("wind_speed_ms").alias("wind_speed"), (F.col("ghi_whm2") * 0.0036).alias("solar_mj"))


def typical_monthly(hourly: DataFrame, hdd_base: float = HDD_BASE,
                    cdd_base: float = CDD_BASE) -> DataFrame:
    return hourly.groupBy("station_id", "month").agg(
        *_degree_columns(hdd_base, cdd_base),
        *[F.avg(c).alias(f"{c}_mean") for c in ("humidity", "wind_speed", "solar_mj")],
    ).withColumns({"precip_sum": F.lit(0.0), "rainy_hours": F.lit(0).cast("bigint"),
                   "year_month": F.concat(F.lit("TMY-"), F.lpad(F.col("month").cast("string"),
                                                                2, "0"))})


BIAS_COLUMNS = ("cdh_total", "hdh_total", "temp_mean", "temp_max", "temp_min", "cdh_daytime",
                "hdh_daytime", "cdh_evening", "hdh_evening", "cdh_night", "hdh_night",
                "humidity_mean", "wind_speed_mean", "solar_mj_mean")


def bias_corrected(typical: DataFrame, observed: DataFrame, recent_years: int = 3) -> DataFrame:
    """Shift each typical value to the mean of the recent observed years of its month.

    A zero typical value carries no bias; rain, which the typical year lacks, is
    taken from the observations.
    """
    last = observed.groupBy("station_id").agg(F.max("year_month").alias("_last"))
    recent = observed.join(small_side(last, measure=observed), "station_id").where(
        F.col("year_month") >= F.add_months("_last", -12 * recent_years))
    rain = ("precip_sum", "rainy_hours")
    mean = recent.groupBy("station_id", F.month("year_month").alias("month")).agg(*[F.avg(c).alias(f"_{c}") for c in (*BIAS_COLUMNS, *rain)])
    d = typical.join(small_side(mean, measure=observed), ["station_id", "month"], "left")
    return d.withColumns({
        **{c: F.when(F.col(f"_{c}").isNotNull() & (F.col(c) != 0), F.col(f"_{c}"))
           .otherwise(F.col(c)) for c in BIAS_COLUMNS},
        **{c: F.coalesce(F.col(f"_{c}"), F.col(c).cast("double")) for c in rain},
    }).drop(*[f"_{c}" for c in (*BIAS_COLUMNS, *rain)])


def forecast_corrected(typical: DataFrame, observed: DataFrame) -> DataFrame:
    """Rescale each typical day into the mean observed daily range of that day of year."""
    obs = observed.groupBy(
        "station_id", F.month("ts").alias("_mo"), F.dayofyear("ts").alias("day_of_year")).agg(
        F.min("temp_c").alias("_lo"), F.max("temp_c").alias("_hi"))
    obs = obs.groupBy("station_id", "day_of_year").agg(
        F.avg("_lo").alias("_olo"), F.avg("_hi").alias("_ohi"))
    own = typical.groupBy("station_id", "day_of_year").agg(
        F.min("temp_c").alias("_tlo"), F.max("temp_c").alias("_thi"))
    span = own.join(obs, ["station_id", "day_of_year"], "left")
    d = typical.join(small_side(span), ["station_id", "day_of_year"], "left")
    width = F.col("_thi") - F.col("_tlo")
    scaled = ((F.col("temp_c") - F.col("_tlo")) / F.nullif(width, F.lit(0.0))
              * (F.col("_ohi") - F.col("_olo")) + F.col("_olo"))
    fixed = (F.when(F.col("_olo").isNull() | F.col("_ohi").isNull(), F.col("temp_c"))
             .when(width == 0, (F.col("_olo") + F.col("_ohi")) / 2).otherwise(scaled))
    return d.withColumn("temp_c", fixed).drop("_olo", "_ohi", "_tlo", "_thi")


# --- joins --------------------------------------------------------------------------------------

def match_station(name: Column, override: dict[str, int] | None = None) -> Column:
    """Station of a branch name: override, exact keyword, else the longest keyword that
    holds or is held by the name."""
    clean = F.upper(F.replace(F.trim(name), F.lit(" "), F.lit("")))
    longest = sorted(BRANCH_STATION, key=len, reverse=True)
    words = F.array(*[F.struct(F.lit(k.upper()).alias("k"), F.lit(BRANCH_STATION[k]).alias("s"))
                      for k in longest])
    exact = F.try_element_at(literal_map({k.upper(): s for k, s in BRANCH_STATION.items()}), clean)
    part = F.filter(words, lambda e: clean.contains(e["k"]) | e["k"].contains(clean))
    found = F.when(clean != "", F.coalesce(exact, F.get(part, F.lit(0))["s"]))
    if override:
        found = F.coalesce(F.try_element_at(literal_map(override), name), found)
    return found


def customer_stations(customers: DataFrame, region_col: str = "region_sub",
                      override: dict[str, int] | None = None) -> DataFrame:
    """Station per customer; names are matched once per distinct spelling."""
    names = customers.select(region_col).where(F.col(region_col).isNotNull()).distinct(
    ).withColumn("matched_station", match_station(F.col(region_col), override))
    return customers.join(small_side(names), region_col, "left").withColumn(
        "station_id", F.coalesce("matched_station", F.lit(DEFAULT_STATION)))


def attach_station_weather(df: DataFrame, hourly: DataFrame, station: str = "station_id",
                           columns=("temp_c", "humidity", "wind_speed", "solar_mj")) -> DataFrame:
    """Hourly station weather on readings: equi-join on (station, hour), broadcast if small."""
    cols = [c for c in columns if c in hourly.columns]
    w = hourly.select(F.col("station_id").alias("_sid"), cal.floor_hour(F.col("ts")).alias("_h"),
                      *cols)
    d = df.withColumn("_th", cal.floor_hour(F.col("ts")))
    joined = d.join(small_side(w), (F.col(station) == F.col("_sid"))
                    & (F.col("_th") == F.col("_h")), "left")
    return joined.drop("_th", "_h", "_sid")


def join_month_weather(features: DataFrame, monthly: DataFrame,
                       station: str = "station_id") -> DataFrame:
    """Observed station-month features on (station, month)."""
    m = monthly.withColumnRenamed("station_id", "_sid")
    f = features.withColumn("_st", F.coalesce(F.col(station), F.lit(DEFAULT_STATION)))
    return f.join(small_side(m), (F.col("_st") == F.col("_sid"))
                  & (f["year_month"] == m["year_month"]), "left").drop(
        m["year_month"]).drop("_sid", "_st")


def join_typical_weather(features: DataFrame, typical: DataFrame,
                         station: str = "station_id") -> DataFrame:
    """Typical-year features on (station, calendar month); same-named columns are replaced."""
    cols = [c for c in typical.columns if c not in ("station_id", "month", "year_month")]
    t = typical.select(F.col("station_id").alias("_sid"), F.col("month").alias("_mo"), *cols)
    f = features.drop(*[c for c in cols if c in features.columns])
    st = F.coalesce(F.col(station), F.lit(DEFAULT_STATION))
    f = f.withColumns({"_st": st, "_fm": F.month("year_month")})
    return f.join(small_side(t), (F.col("_st") == F.col("_sid")) & (F.col("_fm") == F.col("_mo")),
                  "left").drop("_sid", "_mo", "_st", "_fm")


def replace_remainder(features: DataFrame, typical: DataFrame, station: str = "station_id",
                      strict: bool = False) -> DataFrame:
    """Rest-of-month degree days from typical temperatures where a typical month matches.

    In strict mode the job fails when no row matches at all.
    """
    t = typical.groupBy(F.col("station_id").alias("_sid"), F.col("month").alias("_mo")).agg(
        F.avg("temp_mean").alias("_t"))
    st = F.coalesce(F.col(station), F.lit(DEFAULT_STATION))
    f = features.withColumns({"_st": st, "_fm": F.month("year_month")})
    d = f.join(small_side(t), (F.col("_st") == F.col("_sid")) & (F.col("_fm") == F.col("_mo")),
               "left")
    if strict:
        hits = d.agg(F.count("_t").alias("_hits")).select(F.assert_true(
            F.col("_hits") > 0, "no typical month matches any row").isNull().alias("_ok"))
        d = d.join(F.broadcast(hits)).where("_ok").drop("_ok")
    hit = F.col("_t").isNotNull()
    return d.withColumns({
        "hdd_remainder": F.when(hit, hdd(F.col("_t"))).otherwise(F.col("hdd_remainder")),
        "cdd_remainder": F.when(hit, cdd(F.col("_t"))).otherwise(F.col("cdd_remainder")),
    }).drop("_sid", "_mo", "_st", "_fm", "_t")


WEATHER_POLICIES = ("none", "regional", "tmy_raw", "tmy_bias", "tmy_forecast", "tmy_hybrid")


def attach_weather(features: DataFrame, policy: str, observed: DataFrame,
                   typical: dict[str, DataFrame] | None = None,
                   station: str = "station_id") -> DataFrame:
    """Weather by policy: observed months always, the rest of the month by version."""
    if policy not in WEATHER_POLICIES:
        raise ValueError(f"unknown weather policy {policy}")
    if policy == "none":
        return features
    out = join_month_weather(features, observed, station)
    if policy == "regional":
        return out
    version = "tmy_forecast" if policy == "tmy_hybrid" else policy
    return replace_remainder(out, (typical or {})[version], station)


def wide_stations(monthly: DataFrame, columns=("cdh_total", "hdh_total", "temp_mean"),
                  stations=STATIONS) -> DataFrame:
    """One row per month with a column per station and measure."""
    aggs = [F.max(F.when(F.col("station_id") == s, F.col(c))).alias(f"{c}_s{s}")
            for s in stations for c in columns]
    return monthly.groupBy("year_month").agg(*aggs)


def upsample(hourly: DataFrame, column: str = "temp_c", minutes: int = 15,
             method: str = "ffill") -> DataFrame:
    """Station series on a finer grid: hold the last value or interpolate in time."""
    span = hourly.agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    grid = hourly.select("station_id").distinct().join(F.broadcast(span)).select(
        "station_id", F.explode(F.sequence("_a", "_b", F.make_dt_interval(mins=F.lit(minutes))))
        .alias("ts"))
    d = grid.join(hourly.select("station_id", "ts", column), ["station_id", "ts"], "left")
    d = with_neighbours(d, ["station_id"], ["ts"], column)
    # The grid is even, so row positions measure time.
    line = F.when(F.col("_ni") == F.col("_pi"), F.col("_pv")).otherwise(
        F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("_i") - F.col("_pi"))
        / F.nullif(F.col("_ni") - F.col("_pi"), F.lit(0)))
    value = F.col("_pv") if method == "ffill" else F.when(F.col("_ni").isNull(), F.col("_pv")
                                                          ).otherwise(line)
    return d.select("station_id", "ts", value.alias(column))


def climatology(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace weather columns by their mean of the calendar month."""
    mean = df.groupBy("month").agg(*[F.avg(c).alias(f"_{c}") for c in columns])  # 12 rows
    d = df.join(F.broadcast(mean), "month")
    return d.withColumns({c: F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def national_solar(hourly: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """National radiation per hour over the stations that report it."""
    d = hourly.withColumn("hour_ts", cal.floor_hour(F.col("ts"))).select(
        "station_id", "hour_ts", "solar_mj")
    w = literal_map({int(k): float(v) for k, v in (weights or weights_map()).items()})
    out = weighted_mean(d, ["hour_ts"], ["solar_mj"],
                        F.try_element_at(w, F.col("station_id").cast("int")))
    return out.where(F.col("solar_mj").isNotNull())


