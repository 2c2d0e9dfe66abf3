"""Standard reading schema, contract-type normalization and schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

REQUIRED = ("customer_id", "ts", "contract_type", "p_active_kwh")
OPTIONAL = ("p_reactive_kwh", "p_apparent_kwh", "max_demand_kw")
EXTRAS_NUMERIC = ("contract_power_kw", "n_households")
EXTRAS_TEXT = ("region_code", "region_sub", "supply_method", "usage_purpose", "industry_code")

READING_TYPES: dict[str, T.DataType] = {
    "customer_id": T.StringType(),
    "ts": T.TimestampNTZType(),
    "contract_type": T.StringType(),
    "p_active_kwh": T.DoubleType(),
    "p_reactive_kwh": T.DoubleType(),
    "p_apparent_kwh": T.DoubleType(),
    "max_demand_kw": T.DoubleType(),
    "contract_power_kw": T.DoubleType(),
    "n_households": T.DoubleType(),
    "region_code": T.StringType(),
    "region_sub": T.StringType(),
    "supply_method": T.StringType(),
    "usage_purpose": T.StringType(),
    "industry_code": T.StringType(),
}

# The contract types that the tariffs know.
CONTRACT_TYPES = (
    "주택용", "주택용(고압)",
    "일반용", "일반용(갑)I", "일반용(갑)II",
    "일반용(을)", "일반용(을)저압", "일반용(을)고압A", "일반용(을)고압B",
)

# Compact spelling -> standard contract type.
CONTRACT_SPELLINGS = {
    "주택": "주택용",
    "주택용저압": "주택용",
    "주택용고압": "주택용(고압)",
    "일반용갑1": "일반용(갑)I",
    "일반용갑i": "일반용(갑)I",
    "일반용갑2": "일반용(갑)II",
    "일반용갑ii": "일반용(갑)II",
    "일반용갑": "일반용(갑)I",
    "일반용을저압": "일반용(을)저압",
    "일반용을고압a": "일반용(을)고압A",
    "일반용을고압b": "일반용(을)고압B",
    "일반용을고압c": "일반용(을)고압C",
    "일반용을": "일반용(을)",
    "일반용": "일반용",
}


def reading_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, READING_TYPES[n]) for n in names or READING_TYPES])


def literal_map(mapping: dict) -> Column:
    """A fixed lookup as a map literal, folded into the plan."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def normalize_contract_type(raw: Column) -> Column:
    """Standard name of a contract type written in any known spelling.

    Bracket kinds are unified and separators dropped; without a match the
    trimmed, bracket-unified input is kept.
    """
    trimmed = F.regexp_replace(raw, r"^\s+|\s+$", "")
    s = F.regexp_replace(F.regexp_replace(trimmed, r"[\[【{]", "("), r"[\]】}]", ")")
    tight = F.regexp_replace(s, r"[\s_\-·.]+", "")
    key = F.regexp_replace(F.lower(tight), r"[()]", "")
    for roman, latin in (("ⅲ", "iii"), ("ⅱ", "ii"), ("ⅰ", "i")):
        key = F.replace(key, F.lit(roman), F.lit(latin))
    known = F.when(tight.isin(*CONTRACT_TYPES), tight)
    return F.coalesce(F.try_element_at(literal_map(CONTRACT_SPELLINGS), key), known, s)


def ensure_columns(df: DataFrame, columns=OPTIONAL) -> DataFrame:
    """Add missing optional columns as typed nulls."""
    missing = {c: F.lit(None).cast(READING_TYPES.get(c, T.DoubleType()))
               for c in columns if c not in df.columns}
    return df.withColumns(missing) if missing else df


class SchemaError(ValueError):
    """A required column is absent or has the wrong type."""


def check_columns(df: DataFrame) -> None:
    """Fail on what the schema alone shows, before any job runs."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise SchemaError(f"missing required columns: {missing}")
    ts_type = df.schema["ts"].dataType
    if not isinstance(ts_type, (T.TimestampNTZType, T.TimestampType)):
        raise SchemaError(f"ts must be a timestamp, got {ts_type.simpleString()}")


def validate(df: DataFrame, strict: bool = True) -> DataFrame:
    """One-row schema report. Strict mode fails the job on negative energy."""
    check_columns(df)
    x = F.col("p_active_kwh")
    negatives = F.sum(F.when(x < 0, 1).otherwise(0))
    if strict:
        negatives = F.when(F.assert_true(
            F.coalesce(negatives, F.lit(0)) == 0,
            "negative p_active_kwh: run the generation detector first").isNull(),
            F.coalesce(negatives, F.lit(0)))
    unknown = ~F.col("contract_type").isin(*CONTRACT_TYPES)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("customer_id").alias("n_customers"),
        F.min("ts").alias("ts_min"),
        F.max("ts").alias("ts_max"),
        F.coalesce(negatives, F.lit(0)).cast("bigint").alias("n_negative"),
        F.coalesce(F.sum(F.when(unknown, 1).otherwise(0)), F.lit(0)).cast("bigint")
        .alias("n_unknown_contract"),
        F.lit(",".join(c for c in OPTIONAL if c in df.columns)).alias("present_optional"),
    )


def contract_counts(df: DataFrame) -> DataFrame:
    """Rows per contract type and whether the tariffs know it."""
    return (
        df.where(F.col("contract_type").isNotNull())
        .groupBy("contract_type").agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("is_known", F.col("contract_type").isin(*CONTRACT_TYPES))
    )
