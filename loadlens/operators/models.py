"""Residual forecasting models on ``pyspark.ml`` and the linear correction stage."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlens.functions.linear import (Moments, fold_r2, pair_moments, ridge_solve, solve,
                                        vif_of)
from loadlens.functions.scalars import daylight_hours, safe_corr, temperature_loss
from loadlens.operators import baselines, clean, horizon as hz, metrics
from loadlens.operators.features import FeatureSpec, KEYS, with_base
from loadlens.session import checkpointed, write_and_read

MISSING = -1e9  # far below every feature: trees send missing values down one side
PRED = "pred_monthly_kwh"


def linear_base() -> Column:
    """Linear extrapolation of the observed days: the base that the model corrects."""
    return (F.col("partial_kwh") / F.greatest(F.col("days_observed"), F.lit(1))
            * F.col("days_in_month"))


def prepared(features: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Usable rows, the residual target, and numeric features without nulls."""
    d = clean.drop_unusable(features)
    return d.withColumns({
        "_target": F.col("full_month_kwh") - linear_base(),
        **{f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in spec.numeric},
        **{f"_s_{c}": F.coalesce(F.col(c), F.lit("")) for c in spec.categorical},
    })


def _pipeline(spec: FeatureSpec, rounds: int, rate: float, depth: int, subsample: float,
              label: str = "_target", bins: int = 64, seed: int = 7,
              min_leaf: int = 1) -> Pipeline:
    stages = []
    inputs = [f"_x_{c}" for c in spec.numeric]
    if spec.categorical:
        stages.append(StringIndexer(inputCols=[f"_s_{c}" for c in spec.categorical],
                                    outputCols=[f"_i_{c}" for c in spec.categorical],
                                    handleInvalid="keep"))
        inputs += [f"_i_{c}" for c in spec.categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_features"))
    gbt = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="_residual",
                       maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=subsample,
                       maxBins=bins, minInstancesPerNode=min_leaf, seed=seed,
                       checkpointInterval=10, maxMemoryInMB=512)
    return Pipeline(stages=[*stages, gbt])


def best_prefix(errors: list[float], patience: int) -> tuple[int, bool]:
    """How many first rounds have the least error, looking on until ``patience`` rounds in a row
    bring no new least; and whether that many were seen, so that more rounds cannot matter."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_rounds(model: PipelineModel, n: int) -> PipelineModel:
    """The model of the first ``n`` boosting rounds, a whole model that can be saved."""
    whole = model.stages[-1]
    if n >= whole.getNumTrees:
        return model
    sc = SparkSession.active().sparkContext
    jvm, java = sc._jvm, whole._java_obj
    trees, weights = java.trees(), java.treeWeights()
    kept = sc._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    shares = sc._gateway.new_array(jvm.double, n)
    for i in range(n):
        kept[i], shares[i] = trees[i], weights[i]
    part = jvm.org.apache.spark.ml.regression.GBTRegressionModel(
        whole.uid, kept, shares, java.numFeatures())
    java.copyValues(part, jvm.org.apache.spark.ml.param.ParamMap.empty())
    return PipelineModel([*model.stages[:-1], GBTRegressionModel(part)])


def error_curve(model: PipelineModel, rows: DataFrame) -> list[float]:
    """Mean squared error on ``rows`` after each boosting round, in one pass over them."""
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    return model.stages[-1].evaluateEachIteration(rows, "squared")


def boosted(train_rows: DataFrame, val_rows: DataFrame | None, build: Callable[[int], Pipeline],
            rounds: int, patience: int) -> PipelineModel:
    """Boost up to ``rounds`` rounds and keep the prefix that is best on the validation rows.

    Every round's error is looked at, so a round without a gain ends nothing before ``patience``
    of them in a row. Of many rounds, a first fit of six times the patience is enough where the
    curve has turned by then; otherwise all rounds are run, with the same first trees. Up to ten
    times the patience are run at once: a second fit would cost more than the first can spare.
    """
    checkpointed(train_rows.sparkSession)  # long boosting cuts its lineage there
    if val_rows is None:
        return build(rounds).fit(train_rows)
    for n in (rounds,) if rounds <= 10 * patience else (6 * patience, rounds):
        model = build(n).fit(train_rows)
        best, turned = best_prefix(error_curve(model, val_rows), patience)
        if turned:
            break
    return first_rounds(model, best)


TASK_ROWS = 20_000  # a level of a tree over so few rows takes less than starting more tasks


def few_tasks(rows: DataFrame, models: int = 1) -> DataFrame:
    """Training rows in no more parts than are worth a task: boosting runs several short jobs a
    round, and side by side models fill the cores, the more of them the fewer parts each has.
    Large tables keep their parts."""
    n = -(-rows.count() // (TASK_ROWS * models))
    return rows.coalesce(n) if 0 < n < rows.sparkSession.sparkContext.defaultParallelism else rows


def rounds_of(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def category_bins(d: DataFrame, spec: FeatureSpec, least: int = 64) -> int:
    """Split candidates needed: trees want one more bin than the largest category has labels
    (unseen labels share one)."""
    if not spec.categorical:
        return least
    row = d.agg(*[F.count_distinct(f"_s_{c}").alias(c) for c in spec.categorical]).first()
    return max(least, max(row) + 2)


def train(features: DataFrame, spec: FeatureSpec, train_end: Column | None = None,
          rounds: int = 400, rate: float = 0.05, depth: int = 5, subsample: float = 0.9,
          early_stop: bool = True, min_leaf: int = 20, patience: int = 30) -> PipelineModel:
    """Boosted trees on the residual: of at most ``rounds`` rounds those up to the best on the
    validation months, where ``patience`` rounds without a new best end the search.

    Without ``train_end`` the suggested split holds: its validation months choose the rounds
    (short data have none, and all rounds stay) and its test months are not seen at all. With
    it, later rows are the validation rows.
    The prepared matrix is written once: boosting reads it in every round.
    """
    d = prepared(features, spec)
    if train_end is None:
        d = clean.with_suggested_split(d).where("split <> 'test'").withColumn(
            "_is_val", F.col("split") == "val").drop("split")
    else:
        d = d.withColumn("_is_val", F.col("year_month") > train_end)
    if not early_stop:
        d = d.where(~F.col("_is_val"))
    cols = [c for c in d.columns if c[0] == "_"]
    d = write_and_read(d.select(*cols), "train")
    val = d.where("_is_val")
    bins = category_bins(d, spec)
    return boosted(few_tasks(d.where("not _is_val")), val if early_stop and not val.isEmpty() else None,
                   lambda n: _pipeline(spec, n, rate, depth, subsample, min_leaf=min_leaf, bins=bins),
                   rounds, patience)


def predict(model: PipelineModel, features: DataFrame, spec: FeatureSpec,
            out: str = PRED) -> DataFrame:
    """Linear base plus predicted residual, never below what was already used."""
    d = model.transform(prepared(features, spec))
    value = F.greatest(F.col("partial_kwh"), linear_base() + F.col("_residual"))
    keep = [c for c in features.columns if c != out]
    return d.select(*keep, value.alias(out))


def predictions(model: PipelineModel, features: DataFrame, spec: FeatureSpec) -> DataFrame:
    return predict(model, features, spec).select(*KEYS, PRED)


def test_rows(features: DataFrame) -> DataFrame:
    """Rows of the suggested test months, which training never sees."""
    return clean.with_suggested_split(features).where("split = 'test'").drop("split")


def save(model: PipelineModel, spec: FeatureSpec, path: str, notes: str = "") -> None:
    """Pipeline and feature metadata below one folder of any Spark file system."""
    model.write().overwrite().save(f"{path}/pipeline")
    meta = {"numeric_columns": list(spec.numeric), "categorical_columns": list(spec.categorical),
            "has_weather": spec.has_weather, "has_ami": spec.has_ami,
            "has_special_days": spec.has_special_days,
            "num_trees": model.stages[-1].getNumTrees, "notes": notes}
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").coalesce(
        1).write.mode("overwrite").text(f"{path}/feature_meta")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, FeatureSpec]:
    meta = json.loads(spark.read.text(f"{path}/feature_meta").first()["value"])
    spec = FeatureSpec(meta["has_weather"], meta["has_ami"], meta["has_special_days"], (),
                       tuple(meta["categorical_columns"]))
    known = set(spec.numeric)
    spec = spec.without(known - set(meta["numeric_columns"])).plus(
        [c for c in meta["numeric_columns"] if c not in known])
    return PipelineModel.load(f"{path}/pipeline"), spec


# --- importance ---------------------------------------------------------------------------------

def importance(model: PipelineModel, spec: FeatureSpec, spark: SparkSession) -> DataFrame:
    """Impurity importance (not SHAP values) with share and rank; one row per feature."""
    v = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(spec.all, map(float, v)), key=lambda r: (-r[1], r[0]))
    total = sum(x for _, x in rows) or 1.0
    return spark.createDataFrame(
        [(n, x, 100 * x / total, i + 1) for i, (n, x) in enumerate(rows)],
        "feature string, impurity_importance double, share_pct double, rank int")


def permutation_importance(model: PipelineModel, features: DataFrame, spec: FeatureSpec,
                           columns: tuple[str, ...], seed: int = 7,
                           buckets: int = 256) -> DataFrame:
    """Rise of the mean absolute error when a feature is shuffled between rows.

    The shuffle pairs rows by the ranks of two hashes inside hashed buckets of a
    month, so no bucket grows with the number of customers beyond its share, and
    all columns are scored by one model pass.
    """
    from pyspark.sql import Window as W

    keys = [F.col(k) for k in KEYS]
    part = ["year_month", "horizon_days", "_b"]
    d = features.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    w1 = W.partitionBy(*part).orderBy(F.xxhash64(*keys, F.lit(seed)))
    w2 = W.partitionBy(*part).orderBy(F.xxhash64(*keys, F.lit(seed + 1)))
    d = d.withColumns({"_r1": F.row_number().over(w1), "_r2": F.row_number().over(w2)})
    other = d.select(*part, F.col("_r2").alias("_r1"),
                     *[F.col(c).alias(f"_perm_{c}") for c in columns])
    d = d.join(other, [*part, "_r1"]).drop("_r1", "_r2", "_b")
    d = d.withColumn("feature", F.explode(F.array(F.lit("(none)"), *[F.lit(c) for c in columns])))
    for c in columns:
        d = d.withColumn(c, F.when(F.col("feature") == c, F.col(f"_perm_{c}"))
                         .otherwise(F.col(c)))
    scored = predict(model, d, spec)
    mae = scored.groupBy("feature").agg(
        F.avg(F.abs(F.col(PRED) - F.col("full_month_kwh"))).alias("mae"))
    base = mae.where("feature = '(none)'").select(F.col("mae").alias("_base"))
    return mae.where("feature <> '(none)'").join(F.broadcast(base)).select(
        "feature", (F.col("mae") - F.col("_base")).alias("mae_increase"))


def feature_target_correlation(features: DataFrame, columns, target="full_month_kwh") -> DataFrame:
    """One row per feature, with its rank by the strength of the correlation (1 is strongest)."""
    from pyspark.sql import Window as W

    each = features.agg(*[safe_corr(F.col(c).cast("double"), F.col(target)).alias(c)
                          for c in columns]).select(F.explode(F.array(*[
                              F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr"))
                              for c in columns])).alias("s")).select("s.*")
    order = W.orderBy(F.abs("corr").desc_nulls_last(), "feature")  # one row per feature
    return each.withColumn("rank", F.row_number().over(order))


# --- feature selection --------------------------------------------------------------------------

def select_features(features: DataFrame, columns: list[str], target: str = "full_month_kwh",
                    top_n: int | None = None, corr_threshold: float = 0.85,
                    vif_threshold: float = 10.0, min_corr: float = 0.01,
                    max_iterations: int | None = None) -> DataFrame:
    """Correlation rank, removal of correlated pairs, then of high variance inflation.

    One pass yields the moments of all pairs per pattern of missing values; the greedy steps
    work on those p by p tables. Correlations use the rows where a pair is present. Variance
    inflation uses complete rows, those that hold all features still in question: the patterns
    without a gap there are added up, so rows come back as features with gaps leave. Features
    leave one by one until none is above ``vif_threshold``; ``max_iterations`` can end that
    earlier.
    """
    names = [*columns, target]

    def choose(parts: dict[str, Moments]) -> pd.DataFrame:
        def added(keep) -> Moments:
            blocks = [np.stack([m.n, m.s, m.ss, m.xy]) for g, m in parts.items() if keep(g)]
            return Moments(sum(blocks) if blocks else np.zeros((4, len(names), len(names))), names)

        m = added(lambda g: True)
        c = m.corr()
        t = len(columns)
        n = m.n[:t, t]
        tc = {f: (c[i, t] if n[i] >= 10 else np.nan) for i, f in enumerate(columns)}
        power = {f: abs(v) if np.isfinite(v) else 0.0 for f, v in tc.items()}
        ranked = sorted((f for f in columns if np.isfinite(tc[f])), key=lambda f: -power[f])
        rank = {f: i + 1 for i, f in enumerate(ranked)}
        kept = [f for f in ranked if power[f] >= min_corr][:top_n]
        status = {f: "cutoff" for f in columns if f not in kept}
        pos = {f: i for i, f in enumerate(columns)}
        for i, a in enumerate(kept):
            for b in kept[i + 1:]:
                if a in status or b in status:
                    continue
                if abs(np.nan_to_num(c[pos[a], pos[b]])) >= corr_threshold:
                    status[b if power[a] >= power[b] else a] = "correlated"
        current = [f for f in kept if f not in status]

        def inflation(fs):
            whole = added(lambda g: all(g[pos[f]] == "1" for f in fs))
            return dict(zip(fs, vif_of(whole.cov(fs)))) if whole.n.max() > len(fs) else {}

        for _ in range(len(columns) if max_iterations is None else max_iterations):
            v = inflation(current) if len(current) > 1 else {}
            high = [f for f in current if v.get(f, 0) > vif_threshold]
            if not high:
                break
            worst = min(high, key=lambda f: power[f])
            current.remove(worst)
            status[worst] = "vif"
        v = inflation(current) if len(current) > 1 else {}
        return pd.DataFrame({
            "feature": columns, "corr_with_target": [tc[f] for f in columns],
            "rank": [rank.get(f, 0) for f in columns], "n_valid": n.astype(int),
            "vif": [float(v.get(f, np.nan)) for f in columns],
            "status": [status.get(f, "selected") for f in columns]})

    return solve(pair_moments(features, names, gaps=len(columns)), names, choose,
                 "feature string, corr_with_target double, rank int, n_valid bigint, vif double, "
                 "status string", together=True)


# --- residual correction ------------------------------------------------------------------------

ALPHAS = (0.01, 0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0)
RESIDUAL_AMI = ("observed_peak_ratio", "observed_load_factor", "observed_daily_cv",
                "observed_weekend_weekday_ratio", "observed_power_factor", "pf_vs_prev_month",
                "observed_night_ratio", "observed_reactive_ratio")


def residual_features(rows: DataFrame, residential: tuple[str, ...] = ("주택용",)
                      ) -> tuple[DataFrame, list[str]]:
    """Inputs of the correction stage: time, load shape, and the first prediction itself."""
    p = F.col(PRED)
    safe = F.when(F.abs(p) > 1e-9, p).otherwise(1e-9)
    cols = {"r_pred": p, "r_pred_log": F.log1p(F.abs(p)),
            "r_pred_vs_partial": F.col("partial_kwh") / safe,
            "r_residential": F.col("contract_type").isin(*residential).cast("double")}
    for c in ("month", "horizon_days", "disruption_ratio", "partial_rate", *RESIDUAL_AMI):
        if c in rows.columns:
            cols[f"r_{c}"] = F.col(c).cast("double")
    out = rows.withColumns({n: F.coalesce(e, F.lit(0.0)) for n, e in cols.items()})
    return out.withColumn("r_target", F.col("full_month_kwh") - p), list(cols)


def fit_correction(rows: DataFrame, columns: list[str], target: str = "r_target",
                   folds: int = 5, alphas=ALPHAS) -> DataFrame:
    """Ridge with the penalty chosen by cross-validation: one row with the fitted model.

    Folds are hashes of the row keys. One pass builds the moments per fold; all
    penalties and folds are then solved from those small matrices.
    """
    names = [*columns, target]
    fold = F.pmod(F.xxhash64(*[F.col(k) for k in KEYS]), F.lit(folds))

    def fit(parts: dict[str, Moments]) -> pd.DataFrame:
        total = Moments(sum(np.stack([m.n, m.s, m.ss, m.xy]) for m in parts.values()), names)
        i, t = total.index(columns), len(columns)
        n = total.n[t, t]
        mean = total.s[i, t] / n
        var = total.ss[i, t] / n - mean**2
        scale = np.where(var > 1e-18, np.sqrt(np.maximum(var, 0)), 1.0)
        scores = []
        for a in alphas:
            r2 = []
            for m in parts.values():
                rest = Moments(np.stack([total.n - m.n, total.s - m.s, total.ss - m.ss,
                                         total.xy - m.xy]), names)
                if rest.n[t, t] < 2 or m.n[t, t] < 2:
                    continue
                w, b = ridge_solve(rest, columns, target, a, mean, scale)
                r2.append(fold_r2(m, i, t, w / scale, b - float((w / scale) @ mean)))
            scores.append(np.mean(r2) if r2 else -np.inf)
        alpha = float(alphas[int(np.argmax(scores))])
        w, b = ridge_solve(total, columns, target, alpha, mean, scale)
        return pd.DataFrame({"alpha": [alpha], "intercept": [b], "coef": [w], "mean": [mean],
                             "scale": [scale], "cv_r2": [float(np.max(scores))]})

    d = rows.where(F.col(target).isNotNull()).withColumn("_fold", fold)
    return solve(pair_moments(d, names, "_fold"), names, fit,
                 "alpha double, intercept double, coef array<double>, mean array<double>, "
                 "scale array<double>, cv_r2 double", together=True)


def apply_correction(rows: DataFrame, model: DataFrame, columns: list[str],
                     out: str = "pred_corrected") -> DataFrame:
    """Add the correction; the model is one row and is broadcast."""
    x = F.array(*[F.col(c) for c in columns])
    z = F.zip_with(F.zip_with(x, F.col("mean"), lambda a, b: a - b), F.col("scale"),
                   lambda a, s: a / s)
    dot = F.aggregate(F.zip_with(z, F.col("coef"), lambda a, b: a * b), F.lit(0.0),
                      lambda acc, v: acc + v)
    d = rows.join(F.broadcast(model))
    return d.withColumn(out, F.col(PRED) + dot + F.col("intercept")).drop(
        "alpha", "intercept", "coef", "mean", "scale", "cv_r2")


def correction_coefficients(model: DataFrame, columns: list[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in columns])
    return model.select("alpha", "intercept", F.explode(F.arrays_zip(
        names.alias("feature"), F.col("coef"))).alias("s")).select(
        "alpha", "intercept", "s.feature", "s.coef")


def correction_report(rows: DataFrame) -> DataFrame:
    """Metrics of the first and the corrected prediction."""
    stages = F.array(F.struct(F.lit("before").alias("stage"), F.col(PRED).alias("p")),
                     F.struct(F.lit("after").alias("stage"), F.col("pred_corrected").alias("p")))
    d = rows.withColumn("_s", F.explode(stages))
    d = d.withColumn(PRED, F.col("_s.p")).withColumn("stage", F.col("_s.stage"))
    return d.groupBy("stage").agg(*metrics.regression_aggs())


def residual_patterns(rows: DataFrame, min_n: int = 10, residual: str = "r_target") -> DataFrame:
    """Mean and spread of the residual by month and by horizon, small groups dropped."""
    r = F.col(residual)
    parts = []
    for dim in ("month", "horizon_days"):
        g = rows.where(r.isNotNull()).groupBy(F.col(dim).alias("value")).agg(
            F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean_residual"),
            F.stddev_pop(r).alias("std_residual"))
        parts.append(clean.safe_groups(g, "n", min_n).withColumn("dimension", F.lit(dim)))
    return parts[0].unionByName(parts[1])


# --- sliding evaluation -------------------------------------------------------------------------

Scorer = Callable[[DataFrame, str], DataFrame]


def scorers(base: PipelineModel, tuned: PipelineModel, correction: DataFrame,
            spec: FeatureSpec) -> dict[str, Scorer]:
    """The linear, base, tuned and corrected models, each as a function that adds its column."""

    def corrected(d: DataFrame, out: str) -> DataFrame:
        rows, cols = residual_features(predict(base, d, spec))
        done = apply_correction(rows, correction, cols, "_corrected")
        return done.withColumn(out, F.greatest("partial_kwh", "_corrected")).select(*d.columns, out)

    return {"linear": lambda d, out: d.withColumn(out, baselines.partial_linear()),
            "base": lambda d, out: predict(base, d, spec, out),
            "tuned": lambda d, out: predict(tuned, d, spec, out),
            "corrected": corrected}


def sliding_evaluation(
    daily: DataFrame, monthly: DataFrame, meter_days: tuple[int, ...],
    models: dict[str, Scorer] | None = None, horizons=hz.HORIZONS,
) -> DataFrame:
    """Predictions and errors of every model for every meter day in one job.

    Meter days are exploded on the daily table before the horizons are built, and the rows with
    their lags are built once: every model adds a column to them, and the columns become rows
    (``model``) in the end. Features are those known for any meter day.
    """
    rows = hz.build_horizon_table(daily, horizons, meter_days=meter_days)
    rows = with_base(hz.attach_alarm_context(rows, monthly))
    models = models or {"linear": lambda d, out: d.withColumn(out, baselines.partial_linear())}
    columns = list(rows.columns)
    for name, add in models.items():
        rows = add(rows, f"_p_{name}")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_p_{n}").alias(PRED))
                               for n in models]))
    return metrics.error_columns(rows.withColumn("_m", each).select(*columns, "_m.*"))


# --- tuning -------------------------------------------------------------------------------------

class CustomerSpreadEvaluator(Evaluator):
    """Median per-customer CVRMSE of rows whose month exceeds a floor; smaller is better."""

    def __init__(self, floor_kwh: float = 100.0):
        super().__init__()
        self.floor_kwh = floor_kwh

    def _evaluate(self, dataset: DataFrame) -> float:
        value = F.greatest(F.col("partial_kwh"), linear_base() + F.col("_residual"))
        d = dataset.where(F.col("full_month_kwh") > self.floor_kwh).withColumn(PRED, value)
        row = metrics.customer_spread(d, []).first()
        return float(row["cvrmse_median_pct"]) if row else float("inf")

    def isLargerBetter(self) -> bool:
        return False


def random_grid(n: int, seed: int = 7) -> list[dict]:
    """Random settings inside the search space of the tuning job."""
    rng = np.random.default_rng(seed)
    return [{"rate": float(np.exp(rng.uniform(np.log(0.01), np.log(0.15)))),
             "depth": int(rng.integers(3, 9)), "subsample": float(rng.uniform(0.5, 1.0)),
             "min_leaf": int(rng.integers(10, 101))} for _ in range(n)]


def tune(features: DataFrame, spec: FeatureSpec, trials: int = 150, rounds: int = 400,
         seed: int = 7, fit_rows: int | None = None, at_once: int | None = None,
         patience: int = 30) -> DataFrame:
    """Train on the first part, score the validation part; one row per setting, best first, with
    the rounds that were kept.

    ``fit_rows`` bounds the labelled rows that the settings are fitted on, chosen by a hash of
    the keys; all validation rows are scored. ``at_once`` settings train side by side; unless it
    is given, as many as there are cores for their tasks, four at least.
    """
    d = clean.with_suggested_split(prepared(features, spec)).where("split <> 'test'")
    d = write_and_read(d.withColumn("_is_val", F.col("split") == "val"), "tune")
    val_rows, fitted = d.where("_is_val"), d
    if fit_rows is not None:
        share = F.pmod(F.xxhash64(*[F.col(k) for k in KEYS]), F.lit(1 << 30)) / float(1 << 30)
        fitted = d.where(share * d.count() < fit_rows)
    # The settings read their rows many times: without the others, and in as many parts as it takes.
    fitted = few_tasks(write_and_read(fitted.where("not _is_val"), "fitted"), models=10)
    if at_once is None:
        cores = features.sparkSession.sparkContext.defaultParallelism
        at_once = max(4, cores // max(1, fitted.rdd.getNumPartitions()))
    ev, bins = CustomerSpreadEvaluator(), category_bins(d, spec)
    early_stop = not val_rows.isEmpty()

    def trial(g: dict) -> tuple[int, float]:
        m = boosted(fitted, val_rows if early_stop else None,
                    lambda n: _pipeline(spec, n, g["rate"], g["depth"], g["subsample"],
                                        min_leaf=g["min_leaf"], bins=bins), rounds, patience)
        return rounds_of(m), ev.evaluate(m.transform(val_rows))

    grid = random_grid(trials, seed)
    with ThreadPoolExecutor(at_once) as pool:
        scores = list(pool.map(trial, grid))
    rows = [(i, g["rate"], g["depth"], g["subsample"], g["min_leaf"], n, s)
            for i, (g, (n, s)) in enumerate(zip(grid, scores))]
    return features.sparkSession.createDataFrame(
        sorted(rows, key=lambda r: r[-1]),
        "trial int, rate double, depth int, subsample double, min_leaf int, rounds int, "
        "cvrmse_median double")


# --- solar generation ---------------------------------------------------------------------------

def solar_features(generation: DataFrame, weather: DataFrame) -> DataFrame:
    """Monthly national generation with weather, trend, daylight and temperature loss."""
    start = generation.agg(F.min("year_month").alias("_start"))
    d = generation.join(F.broadcast(weather), "year_month").join(F.broadcast(start))  # per month
    return d.withColumns({
        "month": F.month("year_month"), "year": F.year("year_month"),
        "months_since_start": F.months_between("year_month", "_start").cast("int"),
        "daylight_hours": daylight_hours(F.month("year_month")),
        "temp_loss": temperature_loss(F.col("temp_mean"))}).drop("_start")


SOLAR_COLUMNS = ("solar_mj_mean", "temp_mean", "temp_loss", "month", "year", "months_since_start",
                 "daylight_hours", "humidity_mean", "precip_sum")


def train_solar(rows: DataFrame, target: str = "btm_mwh", rounds: int = 200) -> PipelineModel:
    spec = FeatureSpec().without(FeatureSpec().numeric).plus(SOLAR_COLUMNS)
    d = rows.where(F.col(target) > 0).withColumns(
        {f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in SOLAR_COLUMNS})
    last = d.agg(F.max("year_month").alias("_last"))
    d = d.join(F.broadcast(last)).where(
        F.col("year_month") <= clean.default_train_end(F.col("_last"))).drop("_last")
    return boosted(d, None, lambda n: _pipeline(spec, n, 0.05, 4, 1.0, label=target), rounds, 0)


def predict_solar(model: PipelineModel, rows: DataFrame, out: str = "pred_btm_mwh") -> DataFrame:
    d = rows.withColumns(
        {f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in SOLAR_COLUMNS})
    keep = [c for c in rows.columns]
    return model.transform(d).select(*keep, F.col("_residual").alias(out))


