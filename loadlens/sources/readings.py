"""Reading sources: standard tables, grid loads and raw meter exports."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlens import schema
from loadlens.schema import literal_map
from loadlens.functions.joins import small_side
from loadlens.operators import clean
from loadlens.sources import files

# Column names of the grid load table.
GRID_COLUMNS = {
    "X격자": "grid_x", "Y격자": "grid_y", "위도": "lat", "경도": "lon", "연도": "year", "월": "month",
    "일": "day", "시": "hour", "계약전력합계": "contract_power_kw", "공동주택수": "n_households",
    "전력부하합계": "load_kwh", "기온": "_temp_c", "상대습도": "_humidity", "풍속": "_wind",
}
# Standard name -> column of the raw meter export.
METER_COLUMNS = {
    "customer_id": "계약번호", "ts_date": "검침년월일", "ts_time": "검침시분",
    "p_active_kwh": "유효전력량계", "contract_type": "계약종별",
    "p_reactive_lag": "지상무효전력량계", "p_reactive_lead": "진상무효전력량계",
    "p_apparent_kwh": "피상전력량계", "contract_power_kw": "계약전력", "region_code": "본부",
    "region_sub": "지사", "supply_method": "공급방식", "usage_purpose": "전기사용용도",
    "industry_code": "산업분류",
}
NUMERIC = ("p_active_kwh", "p_reactive_lag", "p_reactive_lead", "p_apparent_kwh",
           "contract_power_kw")


@dataclass(frozen=True)
class SourceConfig:
    """Where a source lies and how its columns map to the standard names."""

    kind: str
    path: str
    column_map: dict[str, str] = field(default_factory=dict)
    contract_type_default: str | None = None
    region_station_override: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def from_dict(raw: dict) -> "SourceConfig":
        s = raw.get("source", raw)
        return SourceConfig(s["kind"], s["path"], s.get("column_map") or {},
                            s.get("contract_type_default"),
                            s.get("region_station_override") or {})

    @staticmethod
    def from_yaml(path: str) -> "SourceConfig":
        import yaml

        with open(path, encoding="utf-8") as f:
            return SourceConfig.from_dict(yaml.safe_load(f))


BAD = "_bad_line"


def survey(spark: SparkSession, path: str) -> dict[str, files.Survey]:
    """Charset, line counts and header line of the delimited files of a path, in one pass."""
    paths = files.list_files(spark, path, (".csv", ".tsv", ".txt"))
    if not paths:
        raise FileNotFoundError(f"no delimited files in {path}")
    return files.surveys(spark, paths)


def read_with_bad_lines(spark: SparkSession, path: str,
                        known: dict[str, files.Survey] | None = None) -> DataFrame:
    """All delimited files of a path as text columns, one read per layout, with the raw text of
    lines that do not fit the header in ``_bad_line`` (null for the others) and the ``_file``.

    Every line is parsed whole, whatever columns a query uses, so a line is bad or good for
    all queries alike. Korean charsets are outside the default charset list of the CSV reader,
    and its charset switch is a session setting: it is set when such a file is met. Bytes that
    the charset cannot decode become the replacement character. ``known`` are the files' surveys,
    if they were made before.
    """
    groups: dict[files.Layout, list[str]] = defaultdict(list)
    for f, s in (survey(spark, path) if known is None else known).items():
        groups[files.layout_of(s.first, s.charset)].append(f)
    if not groups:
        raise ValueError(f"the delimited files in {path} are empty")
    out = None
    for layout, own in groups.items():
        if layout.encoding != "utf-8":
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        fields = ", ".join(f"`{c}` string" for c in (*layout.header, BAD))
        d = (spark.read.schema(fields).option("header", True).option("sep", layout.sep)
             .option("encoding", layout.encoding).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", BAD).option("columnPruning", False)
             .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
             .csv(own)).withColumn("_file", F.col("_metadata.file_path"))
        # The reader refuses queries of the bad-line column alone: a count needs another one.
        any_column = F.coalesce(F.col(f"`{layout.header[0]}`"), F.lit("")) >= ""
        d = d.withColumn(BAD, F.when(any_column, F.col(BAD)))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """The lines of ``read_with_bad_lines`` that fit their header."""
    return read_with_bad_lines(spark, path).where(F.col(BAD).isNull()).drop(BAD, "_file")


def bad_line_report(spark: SparkSession, path: str) -> DataFrame:
    """Per file: lines read, kept and bad; the charset it was read with, the lines that this
    charset could not decode whole, and the bytes that were replaced in them."""
    known = survey(spark, path)
    counts = read_with_bad_lines(spark, path, known).groupBy(F.col("_file").alias("file")).agg(
        F.count(F.lit(1)).alias("lines_read"), F.count(BAD).alias("lines_bad"))
    plain = F.regexp_replace(F.url_decode("file"), "^[a-z]+:/*", "/")
    facts = spark.createDataFrame(
        [(files.plain_path(p), s.charset, s.lines_damaged, s.bytes_replaced) for p, s in known.items()],
        "plain string, charset string, lines_damaged bigint, bytes_replaced bigint")
    return counts.withColumn("plain", plain).join(facts, "plain", "left").select(
        "file", "lines_read", "lines_bad",
        (F.col("lines_read") - F.col("lines_bad")).alias("lines_kept"), "charset",
        "lines_damaged", "bytes_replaced")


def load_table(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """Standard readings kept as parquet; a text time stamp is cast."""
    d = spark.read.parquet(cfg.path)
    if dict(d.dtypes).get("ts") == "string":
        d = d.withColumn("ts", F.col("ts").try_cast("timestamp_ntz"))
    elif dict(d.dtypes).get("ts") == "timestamp":
        d = d.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return d


def grid_ts(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """Hour-ending clock 1..24 to the beginning of the hour."""
    date = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    h = hour.try_cast("int") - 1
    return F.when(h.between(0, 23), F.try_to_date(date, "yyyy-MM-dd").cast("timestamp_ntz")
                  + F.make_dt_interval(hours=h))


def load_grid(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """Hourly grid loads with weather: load per household block, one customer per cell."""
    d = read_delimited(spark, cfg.path)
    for source, name in GRID_COLUMNS.items():
        d = d.withColumnRenamed(source, name)
    num = {c: clean.to_number(F.col(c)) for c in (
        "contract_power_kw", "n_households", "load_kwh", "_temp_c", "_humidity", "_wind")}
    d = d.withColumns(num)
    out = d.select(
        F.concat_ws("_", F.lit("grid"), "grid_x", "grid_y").alias("customer_id"),
        grid_ts(*[F.trim(F.col(c)) for c in ("year", "month", "day", "hour")]).alias("ts"),
        F.lit(cfg.contract_type_default or "주택용").alias("contract_type"),
        (F.col("load_kwh") / F.nullif("n_households", F.lit(0.0))).alias("p_active_kwh"),
        "contract_power_kw", "n_households", "_temp_c", "_humidity", "_wind")
    return out.where(F.col("ts").isNotNull() & F.col("p_active_kwh").isNotNull())


def standardize_meter(d: DataFrame, cfg: SourceConfig) -> DataFrame:
    """Raw meter rows to standard readings."""
    for name, source in (cfg.column_map or METER_COLUMNS).items():
        if source in d.columns:
            d = d.withColumnRenamed(source, name)
    if "ts" not in d.columns:
        d = d.withColumn("ts", clean.compose_ts(F.col("ts_date"), F.col("ts_time"))).drop(
            "ts_date", "ts_time")
    d = d.withColumns({c: clean.to_number(F.col(c)) for c in NUMERIC
                       if c in d.columns and dict(d.dtypes)[c] == "string"})
    parts = [c for c in ("p_reactive_lag", "p_reactive_lead") if c in d.columns]
    if parts:
        total = clean.total_reactive(*[
            F.col(c) if c in parts else F.lit(None).cast("double")
            for c in ("p_reactive_lag", "p_reactive_lead")])
        d = d.withColumn("p_reactive_kwh", total)
    if "contract_type" not in d.columns and cfg.contract_type_default:
        d = d.withColumn("contract_type", F.lit(cfg.contract_type_default))
    if "region_sub" in d.columns and "region_code" not in d.columns:
        d = d.withColumnRenamed("region_sub", "region_code")
    return d.withColumn("customer_id", F.col("customer_id").cast("string"))


def load_meter(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """Raw meter exports, delimited or parquet, in any mix of encodings and delimiters."""
    if not cfg.column_map:
        raise ValueError("a meter export needs a column map")
    listed = files.list_files(spark, cfg.path, (".csv", ".tsv", ".txt", ".parquet"))
    parquet = [p for p in listed if p.endswith(".parquet")]
    out = None
    if len(parquet) < len(listed):
        out = standardize_meter(read_delimited(spark, cfg.path), cfg)
    if parquet:
        d = standardize_meter(spark.read.option("mergeSchema", True).parquet(*parquet), cfg)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no readings in {cfg.path}")
    return out


# Source kind -> loader; add an entry to add a kind of source.
LOADERS: dict[str, Callable[[SparkSession, SourceConfig], DataFrame]] = {
    "table": load_table, "grid": load_grid, "meter": load_meter,
}


def load(spark: SparkSession, cfg: SourceConfig, validate: bool = True) -> DataFrame:
    """Load, complete and normalize a source; the schema is checked before any job runs.

    Contract types have few spellings: they are normalized once per spelling.
    """
    if cfg.kind not in LOADERS:
        raise ValueError(f"unknown source kind {cfg.kind}, known: {sorted(LOADERS)}")
    d = schema.ensure_columns(LOADERS[cfg.kind](spark, cfg))
    if "contract_type" in d.columns:
        names = d.select("contract_type").where("contract_type is not null").distinct(
        ).withColumn("_std", schema.normalize_contract_type(F.col("contract_type")))
        cols = d.columns
        d = d.join(small_side(names), "contract_type", "left").withColumn(
            "contract_type", F.col("_std")).select(*cols)
    if validate:
        schema.check_columns(d)
    return d


REQUIRED_DAILY = ("customer_id", "date", "day_kwh", "ts")


def load_smart(spark: SparkSession, cfg: SourceConfig, published: str | None = None) -> DataFrame:
    """The verified daily table with customer attributes, or the source when it is not usable."""
    if published and files.exists(spark, f"{published}/meta.json"):
        meta = json.loads(files.read_text(spark, f"{published}/meta.json"))
        if meta.get("status") == "OK" and files.exists(spark, f"{published}/daily"):
            daily = spark.read.parquet(f"{published}/daily")
            if set(REQUIRED_DAILY) <= set(daily.columns) and not daily.isEmpty():
                return _with_info(spark, daily, f"{published}/customer_info")
    return load(spark, cfg)


def _with_info(spark: SparkSession, daily: DataFrame, path: str) -> DataFrame:
    if not files.exists(spark, path):
        return daily
    info = spark.read.parquet(path)
    new = [c for c in info.columns if c not in daily.columns]
    return daily.join(small_side(info.select("customer_id", *new)), "customer_id", "left")


# --- conversion and repair ----------------------------------------------------------------------

def infer_numeric(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Cast text columns in which more than ``share`` of the rows hold a number.

    The shares of all columns come from one pass.
    """
    text = [c for c, t in df.dtypes if t == "string"]
    if not text:
        return df
    row = df.agg(*[F.avg(F.when(clean.to_number(F.col(c)).isNotNull(), 1.0).otherwise(0.0))
                   .alias(c) for c in text]).first()
    return df.withColumns({c: clean.to_number(F.col(c)) for c in text
                           if (row[c] or 0.0) > share})


def csv_to_parquet(spark: SparkSession, src: str, dst: str) -> DataFrame:
    infer_numeric(read_delimited(spark, src)).write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a UTF-8 file that hold undecodable bytes."""
    d = spark.read.text(path)
    return d.where(~F.is_valid_utf8("value")).withColumn("value", F.make_valid_utf8("value"))


def repair(spark: SparkSession, src: str, dst: str) -> None:
    """Write the text again without the undecodable characters."""
    d = spark.read.text(src)
    valid = F.make_valid_utf8("value")
    d.select(F.replace(valid, F.lit("\ufffd"), F.lit("")).alias("value")).write.mode(
        "overwrite").text(dst)


def suggest_column_map(columns: list[str]) -> dict[str, str]:
    """Known export columns found among ``columns``."""
    return {k: v for k, v in METER_COLUMNS.items() if v in columns}
