"""Model-free predictors of the full month from its first days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions.scalars import ratio
from loadlens.operators import metrics

KEYS = ("customer_id", "year_month", "horizon_days")


def naive_last_month() -> Column:
    return F.col("prev_month_kwh")


def seasonal_yoy() -> Column:
    return F.col("yoy_month_kwh")


def moving_avg3() -> Column:
    return F.col("ma3_kwh")


def partial_linear() -> Column:
    return ratio(F.col("partial_kwh") * F.col("days_in_month"), F.col("days_observed"))


def partial_seasonal_yoy() -> Column:
    rest = 1 - F.col("days_observed") / F.col("days_in_month")
    return F.col("partial_kwh") + F.col("yoy_month_kwh") * rest


# A predictor is an expression over the context table; add an entry to add a model.
BASELINES: dict[str, Callable[[], Column]] = {
    "naive_last_month": naive_last_month,
    "seasonal_yoy": seasonal_yoy,
    "moving_avg3": moving_avg3,
    "partial_linear": partial_linear,
    "partial_seasonal_yoy": partial_seasonal_yoy,
}


def predict(context: DataFrame, name: str) -> DataFrame:
    return context.select(*KEYS, BASELINES[name]().alias("pred_monthly_kwh"))


def predict_all(context: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every baseline as (model, prediction) rows next to the context columns."""
    models = F.array(*[F.struct(F.lit(n).alias("model"), f().alias("pred_monthly_kwh"))
                       for n, f in BASELINES.items()])
    return context.withColumn("_m", F.explode(models)).select(
        *context.columns, F.col("_m.model").alias("model"),
        F.col("_m.pred_monthly_kwh").alias("pred_monthly_kwh"))


def evaluate_all(context: DataFrame, group_cols=("model", "horizon_days",
                                                 "contract_type")) -> DataFrame:
    """All baselines scored in one aggregation; context and predictions share their rows."""
    return metrics.evaluate_rows(predict_all(context), group_cols)
