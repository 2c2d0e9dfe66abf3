"""Over-use alarm: three conditions, their labels and their scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loadlens.functions.scalars import count_if, ratio, true_if


@dataclass(frozen=True)
class Thresholds:
    prev_month: float = 1.30
    yoy: float = 1.30
    ma3: float = 1.50


CONDITIONS = ("prev", "yoy", "ma")


def alarm_conditions(kwh: Column, th: Thresholds = Thresholds()) -> dict[str, Column]:
    """Strictly-greater conditions; a missing side never triggers."""
    prev = true_if(kwh > th.prev_month * F.col("prev_month_kwh"))
    yoy = true_if(kwh > th.yoy * F.col("yoy_month_kwh"))
    ma = true_if(kwh > th.ma3 * F.col("ma3_kwh"))
    return {"prev": prev, "yoy": yoy, "ma": ma, "any": prev | yoy | ma}


def with_alarms(df: DataFrame, kwh: str, prefix: str, th: Thresholds = Thresholds()) -> DataFrame:
    return df.withColumns({f"{prefix}_{k}": c
                           for k, c in alarm_conditions(F.col(kwh), th).items()})


def classification(pred: Column, truth: Column, prefix: str = "alarm") -> list[Column]:
    """Aggregates of a confusion matrix, to be used in one ``agg``."""
    tp, fp = count_if(pred & truth), count_if(pred & ~truth)
    fn, tn = count_if(~pred & truth), count_if(~pred & ~truth)
    zero = F.lit(0.0)
    precision = F.coalesce(ratio(tp.cast("double"), (tp + fp).cast("double")), zero)
    recall = F.coalesce(ratio(tp.cast("double"), (tp + fn).cast("double")), zero)
    f1 = F.coalesce(ratio(2 * precision * recall, precision + recall), zero)
    n = F.count(F.lit(1)).cast("double")
    return [
        tp.alias(f"{prefix}_tp"), fp.alias(f"{prefix}_fp"),
        fn.alias(f"{prefix}_fn"), tn.alias(f"{prefix}_tn"),
        precision.alias(f"{prefix}_precision"), recall.alias(f"{prefix}_recall"),
        f1.alias(f"{prefix}_f1"),
        ((tp + fp) / n).alias(f"{prefix}_alarm_rate_pred"),
        ((tp + fn) / n).alias(f"{prefix}_alarm_rate_true"),
    ]
