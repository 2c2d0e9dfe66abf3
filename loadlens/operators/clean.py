"""Cleaning of readings: time stamps, duplicates, gaps, missing values, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions.chunks import with_neighbours, with_previous
from loadlens.functions.joins import many_tasks, small_side
from loadlens.functions.quantiles import group_quantiles
from loadlens.functions.scalars import count_if, floor_eps, true_if
from loadlens.session import write_and_read

X = "p_active_kwh"
SHARES = 16  # tasks that the rows of one repeated key are dealt to
BOUNDS_LIMIT = 16 * 1024 * 1024  # bytes of written bounds, a row per customer, that are broadcast
DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd")


def compose_ts(date_text: Column, time_text: Column) -> Column:
    """Timestamp from a date and a time text (H:MM, H:MM:SS or HHMM).

    24:00 and 2400 are midnight of the next day; anything unreadable is null.
    """
    day_text = F.substring(F.trim(date_text), 1, 10)
    day = F.coalesce(*[
        F.when(F.length(day_text) == len(f), F.try_to_date(day_text, f)) for f in DATE_FORMATS])
    t = F.trim(time_text)
    hhmm = F.regexp_replace(F.lpad(t, 4, "0"), r"^(\d{2})(\d{2})$", "$1:$2")
    clock = F.when(t.contains(":") | (F.length(t) > 4), t).otherwise(hhmm)
    shape = r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$"

    def part(i: int) -> Column:
        text = F.regexp_extract(clock, shape, i)
        return F.when(text != "", text.cast("int")).otherwise(0)

    h, m, s = part(1), part(2), part(3)
    midnight = (h == 24) & (m == 0) & (s == 0)
    valid = clock.rlike(shape) & (midnight | ((h < 24) & (m < 60) & (s < 60)))
    return F.when(valid, day.cast("timestamp_ntz")
                  + F.make_dt_interval(hours=h, mins=m, secs=s.cast("decimal(18,6)")))


def with_time_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    t = F.col(ts)
    return df.withColumns({"hour": F.hour(t), "date": F.to_date(t),
                           "year_month": F.trunc(t.cast("date"), "MM"),
                           "dayofweek": F.weekday(t)})


def hour_ending_to_beginning(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Shift hours 1..24 back by one. Only a source without any hour 0 is shifted;
    the decision is a one-row aggregate."""
    t = F.col(ts)
    decision = df.agg((F.min(F.hour(t)) >= 1).alias("_ending"))
    shifted = F.when(F.col("_ending"), t - F.make_dt_interval(hours=F.lit(1))).otherwise(t)
    return df.join(F.broadcast(decision)).withColumn(ts, shifted).drop("_ending")


def total_reactive(lag: Column, lead: Column) -> Column:
    return F.coalesce(lag, F.lit(0.0)) + F.coalesce(lead, F.lit(0.0))


def to_number(text: Column) -> Column:
    """Numeric value of a text column, null where it is not a number."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def time_index(spark, start: str, end: str, minutes: int = 15) -> DataFrame:
    """Every interval from start to end, both included."""
    return spark.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"),
        F.make_dt_interval(mins=F.lit(minutes)))).alias("ts"))


def remove_duplicates(df: DataFrame, seq: str = "ingest_seq", keep_count: bool = False,
                      keep_seq: bool = True) -> DataFrame:
    """Last row per (customer, ts) in ingest order.

    An aggregate, not a window: copies collapse before the shuffle by key, so even a key
    that is repeated without end costs ``SHARES`` rows. The aggregate sorts the rows of a
    task: they are dealt to many tasks first, whatever an input split holds. The ingest order
    heads the row that is compared, so it is shuffled once; ``keep_seq`` keeps it after that.
    """
    rest = [c for c in df.columns if c not in ("customer_id", "ts", seq)]
    aggs = [F.max(F.when(F.col(seq).isNotNull(), F.struct(seq, *rest))).alias("_r")]
    if keep_count:
        aggs.append(F.count(F.lit(1)).alias("_copies"))
    dealt = df.repartition(many_tasks(df.sparkSession), "customer_id", "ts",
                           F.pmod(F.hash(seq), F.lit(SHARES)))
    out = dealt.groupBy("customer_id", "ts").agg(*aggs)
    kept = [*rest, *([seq] if keep_seq else [])]
    return out.select("customer_id", "ts", *[F.col("_r").getField(c).alias(c) for c in kept],
                      *(["_copies"] if keep_count else []))


def interpolate(df: DataFrame, *columns: str, limit: int = 24,
                order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Linear fill of the columns (the energy, unless others are named) by row position; of a
    longer gap only the first ``limit`` rows. All columns are filled from one window.

    The tail after the last value repeats it, rows before the first stay null.
    """
    columns = columns or (X,)
    d = with_neighbours(df, ["customer_id"], list(order), *columns)
    filled = {}
    for j, column in enumerate(columns):
        pv, pi, nv, ni = (F.col(f"{c}{j}" if len(columns) > 1 else c)
                          for c in ("_pv", "_pi", "_nv", "_ni"))
        step = F.col("_i") - pi
        filled[column] = (F.when(F.col(column).isNotNull(), F.col(column))
                          .when(pi.isNull() | (step > limit), None).when(ni.isNull(), pv)
                          .otherwise(pv + (nv - pv) * step / (ni - pi)))
    return d.withColumns(filled).select(*df.columns)


def forward_fill(df: DataFrame, column: str = X, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    d = with_neighbours(df, ["customer_id"], list(order), column)
    return d.withColumn(column, F.col("_pv")).drop("_i", "_pv", "_pi", "_nv", "_ni")


def handle_missing(df: DataFrame, method: str = "interpolate", max_gap_hours: int = 6) -> DataFrame:
    """interpolate (also the reactive column), ffill, drop or zero."""
    if method == "interpolate":
        both = [c for c in (X, "p_reactive_kwh") if c in df.columns]
        return interpolate(df, *both, limit=max_gap_hours * 4)
    if method == "ffill":
        return forward_fill(df)
    if method == "drop":
        return df.where(F.col(X).isNotNull())
    if method == "zero":
        return df.fillna(0.0, [X])
    raise ValueError(f"unknown method {method}")


def mark_outliers(df: DataFrame, method: str = "iqr", iqr_factor: float = 3.0,
                  zscore_threshold: float = 4.0, stored: bool = False) -> DataFrame:
    """Add ``_keep``. Bounds are per customer and joined back; nothing is windowed
    over a whole customer. Quantile bounds that are ``stored`` are written first, and broadcast
    where their files are small: their estimate would be that of the rows, and those would be
    shuffled for the join."""
    x = F.col(X)
    if method in ("iqr", "quantile"):
        probs = ({"_q1": 0.25, "_q3": 0.75} if method == "iqr"
                 else {"_q1": 0.001, "_q3": 0.999})
        b = group_quantiles(df, ["customer_id"], X, probs)
        if method == "iqr":
            iqr = F.col("_q3") - F.col("_q1")
            b = b.select("customer_id",
                         F.least(F.col("_q1") - iqr_factor * iqr, F.lit(0.0)).alias("_lo"),
                         (F.col("_q3") + iqr_factor * iqr).alias("_hi"))
        else:
            b = b.select("customer_id", F.col("_q1").alias("_lo"), F.col("_q3").alias("_hi"))
        if stored:
            b = small_side(write_and_read(b, "bounds"), limit=BOUNDS_LIMIT)
        d = df.join(b, "customer_id", "left")
        return d.withColumn("_keep", true_if(x.between(F.col("_lo"), F.col("_hi")))
                            ).drop("_lo", "_hi")
    if method == "zscore":
        b = df.groupBy("customer_id").agg(F.avg(X).alias("_m"), F.stddev_samp(X).alias("_sd"))
        d = df.join(b, "customer_id", "left")
        z = F.abs(x - F.col("_m")) / F.nullif(F.col("_sd"), F.lit(0.0))
        return d.withColumn("_keep", true_if(F.col("_sd") == 0) | true_if(z <= zscore_threshold)
                            ).drop("_m", "_sd")
    if method == "jump":
        d = with_previous(df, ["customer_id"], ["ts"], {X: "_prev"})
        r = x / floor_eps(F.col("_prev"))
        return d.withColumn("_keep", true_if((r < 10) & (r > 0.1)) | F.col("_prev").isNull()
                            ).drop("_prev", "_has_prev")
    raise ValueError(f"unknown method {method}")


def remove_outliers(df: DataFrame, method: str = "iqr", **kw) -> DataFrame:
    return mark_outliers(df, method, **kw).where("_keep").drop("_keep")


def fill_time_gaps(df: DataFrame, minutes: int = 15) -> DataFrame:
    """The full interval grid of each customer from its first to its last reading."""
    span = df.groupBy("customer_id").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    grid = span.select("customer_id", F.explode(F.sequence(
        "_a", "_b", F.make_dt_interval(mins=F.lit(minutes)))).alias("ts"))
    return grid.join(df, ["customer_id", "ts"], "left")


def preprocess_marked(
    df: DataFrame, seq: str = "ingest_seq", missing_method: str = "interpolate",
    outlier_method: str = "iqr", max_gap_hours: int = 6, iqr_factor: float = 3.0,
    fill_gaps: bool = False, keep_seq: bool = True,
) -> DataFrame:
    """Every cleaning step applied and marked instead of dropped.

    The marks let one aggregation write the whole step log. The readings without copies are
    written once, because filling reads them twice, and the filled ones, because the outlier
    bounds read them again; what was shuffled for a table is given back once it is written.
    """
    d = write_and_read(remove_duplicates(df, seq, keep_count=True, keep_seq=keep_seq), "once",
                       release=True)
    if fill_gaps:
        d = fill_time_gaps(d).fillna(0, ["_copies"])
    d = d.withColumn("_was_null", F.col(X).isNull())
    dropped = F.col("_was_null") if missing_method == "drop" else F.lit(False)
    if missing_method != "drop":
        d = handle_missing(d, missing_method, max_gap_hours)
    d = write_and_read(d.withColumn("_dropped", dropped), "filled", release=True)
    marked = mark_outliers(d.where(~F.col("_dropped")), outlier_method, iqr_factor=iqr_factor,
                           stored=True)
    return marked.unionByName(d.where("_dropped").withColumn("_keep", F.lit(False)))


def cleaned(marked: DataFrame) -> DataFrame:
    keep = F.col("_keep") & F.col(X).isNotNull()
    return marked.where(keep).drop("_keep", "_copies", "_was_null", "_dropped")


def step_log(marked: DataFrame) -> DataFrame:
    """(step, removed) for every cleaning step, from one pass over the marked rows."""
    null_now = F.col(X).isNull()
    row = marked.agg(
        F.sum("_copies").alias("original_rows"),
        F.sum(F.greatest(F.col("_copies") - 1, F.lit(0))).alias("remove_duplicates"),
        (-count_if(F.col("_copies") == 0)).alias("fill_time_gaps"),
        count_if(F.col("_was_null") & (~null_now | F.col("_dropped"))).alias("handle_missing"),
        count_if(~F.col("_keep") & ~F.col("_dropped")).alias("remove_outliers"),
        count_if(F.col("_keep") & null_now).alias("final_drop_na"),
        count_if(F.col("_keep") & ~null_now).alias("final_rows"),
    )
    names = row.columns
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"),
                 F.col(n).cast("bigint").alias("removed"))
        for i, n in enumerate(names)])).alias("s")).select("s.*")


# --- splits, policies, export safety -----------------------------------------------------------

def time_split(df: DataFrame, train_end: Column, val_end: Column | None = None) -> DataFrame:
    ym = F.col("year_month")
    split = F.when(ym <= train_end, "train")
    if val_end is not None:
        split = split.when(val_end.isNotNull() & (ym <= val_end), "val")
    return df.withColumn("split", split.otherwise("test"))


def suggest_split(df: DataFrame) -> DataFrame:
    """One row: train_end and val_end by the length of the data."""
    span = df.agg(F.min("year_month").alias("lo"), F.max("year_month").alias("hi"))
    months = ((F.year("hi") - F.year("lo")) * 12 + F.month("hi") - F.month("lo") + 1)
    span = span.withColumn("total_months", months)
    n = F.col("total_months")
    train_months = (F.when(n >= 30, 18).when(n >= 18, F.floor(n / 2)).otherwise(F.floor(n * 2 / 3)))
    train_end = F.add_months("lo", train_months.cast("int") - 1)
    return span.select(
        "total_months", train_end.alias("train_end"),
        F.when(n >= 30, F.add_months(train_end, 6)).alias("val_end"),
        default_train_end(F.col("hi")).alias("default_train_end"))


def default_train_end(last_month: Column) -> Column:
    """December of the year before the last month."""
    return F.make_date(F.year(last_month) - 1, F.lit(12), F.lit(1))


def with_suggested_split(df: DataFrame) -> DataFrame:
    s = suggest_split(df).select("train_end", "val_end")
    return time_split(df.join(F.broadcast(s)), F.col("train_end"), F.col("val_end")
                      ).drop("train_end", "val_end")


def leakage_report(df: DataFrame) -> DataFrame:
    """Overlapping months, order inversion and cold-start customers, as rows."""
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    months = train.select("year_month").intersect(test.select("year_month"))
    overlap = months.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("overlapping_months").alias("check_name"), "value")
    order = df.agg(F.max(F.when(F.col("split") == "train", F.col("year_month"))).alias("a"),
                   F.min(F.when(F.col("split") == "test", F.col("year_month"))).alias("b"))
    inverted = order.select(F.lit("time_inversion").alias("check_name"),
                            true_if(F.col("b") <= F.col("a")).cast("bigint").alias("value"))
    cold = (test.select("customer_id").distinct()
            .join(train.select("customer_id").distinct(), "customer_id", "left_anti")
            .agg(F.count(F.lit(1)).alias("value"))
            .select(F.lit("cold_start_customers").alias("check_name"), "value"))
    return overlap.unionByName(inverted).unionByName(cold)


def btm_policy(df: DataFrame, flags: DataFrame, policy: str) -> DataFrame:
    """Treatment of generating customers: exclude them, flag them or add their score."""
    if policy == "exclude":
        return df.join(flags.where("is_btm = 1").select("customer_id"), "customer_id", "left_anti")
    col = {"flag": "is_btm", "score": "btm_score"}.get(policy)
    if policy == "none":
        return df
    if col is None:
        raise ValueError(f"unknown policy {policy}")
    return df.join(flags.select("customer_id", col), "customer_id", "left").fillna(0, [col])


def safe_groups(df: DataFrame, n: str = "n", min_n: int = 10) -> DataFrame:
    """Drop groups that are too small to leave the site."""
    return df.where(F.col(n) >= min_n)


def mask_cell(value: Column, count: Column, min_n: int = 10) -> Column:
    return F.when(count >= min_n, value)


def export_number(x: Column) -> Column:
    """Six digits; a non-finite value becomes null."""
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.round(x, 6))


def drop_unusable(df: DataFrame, required=("full_month_kwh", "partial_kwh")) -> DataFrame:
    return df.na.drop(subset=list(required))


def blank_features(df: DataFrame, selected: set[str], candidates: list[str]) -> DataFrame:
    """Null out candidate features that were not selected; the schema stays."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType)
                           for c in candidates if c not in selected and c in df.columns})


