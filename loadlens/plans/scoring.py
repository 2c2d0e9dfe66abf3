"""Batch scoring: features, prediction, alarms and bill for every customer-month."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from loadlens.operators import (baselines, billing, clean, features as ft, metrics, models,
                                publish)


def score(features: DataFrame, model: PipelineModel | None = None,
          spec: ft.FeatureSpec | None = None) -> DataFrame:
    """Prediction (model, or linear without one), alarm conditions and estimated bill."""
    if model is None:
        rows = features.withColumn("pred_monthly_kwh", baselines.partial_linear())
    else:
        rows = models.predict(model, features, spec)
    rows = metrics.labelled(rows).withColumn("month", F.month("year_month"))
    d = billing.with_bill(rows, kwh="pred_monthly_kwh")
    return d.select("customer_id", "year_month", "horizon_days", "contract_type", "partial_kwh",
                    "pred_monthly_kwh", "prev_month_kwh", "yoy_month_kwh", "ma3_kwh",
                    "pred_prev", "pred_yoy", "pred_ma", "pred_any",
                    F.col("bill.elec_won").alias("est_bill_won"))


def run(readings: DataFrame, out: str, model: PipelineModel | None = None,
        spec: ft.FeatureSpec | None = None, info: DataFrame | None = None,
        hourly: DataFrame | None = None, holidays: DataFrame | None = None,
        cleaned: bool = False) -> None:
    """Clean, build features, score, and write all rows and the alarmed ones."""
    r = readings if cleaned else clean.cleaned(clean.preprocess_marked(readings))
    features, _ = ft.build_features(r, info, hourly, holidays)
    publish.write_predictions(score(features, model, spec), out)
