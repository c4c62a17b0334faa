"""Hold-out split, pooled out-of-fold predictions and the fit loop."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fold_salt, hash_uint32, split_salt
from ..operators.preprocess import numeric_columns
from ..session import cut_lineage
from .evaluate import cv_metric_columns, metric_columns
from .extra_trees import ExtraTreesRegressor
from .linear import MAX_FEATURES, as_pipeline_model, cell_moments, combine, prediction_sql, solve
from .registry import TREE_MODELS, ModelSpec, TrainStats, get_selected_models, tree_params
from .tree_grower import HOLDOUT, Grower, TreeModel

IS_TEST = "__is_test"
FOLD = "__fold"


@dataclass
class TrainingResult:
    model_name: str
    model: PipelineModel
    metrics: dict
    predictions: DataFrame            # hold-out (ts, actual, predicted)
    cv_predictions: DataFrame | None = None
    feature_columns: list = field(default_factory=list)
    certificate: dict | None = None   # lasso, elastic net: sweeps and duality gap of the hold-out fit


def feature_columns(df: DataFrame, target: str, ts: str, keys: Sequence[str] = ()) -> list[str]:
    """every numeric column but the target (timestamp and keys are not features)."""
    return numeric_columns(df, exclude=[target, ts, *keys])


def kth_of_counts(counts: DataFrame, share) -> tuple[int, int]:
    """(value, rest): the value at which the running count of (b, count) rows
    reaches ``share(total)``, and what is left of it inside that value."""
    rows = sorted((int(r["b"]), int(r["count"])) for r in counts.collect())
    k = share(sum(n for _, n in rows))
    for value, n in rows:
        if k <= n:
            return value, k
        k -= n
    raise ValueError("fewer rows than asked for")


def add_holdout_flag(df: DataFrame, ts: str, keys: Sequence[str] = (), test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """M9: ``__is_test`` for the ⌈test_size · n⌉ rows with the smallest hash of
    (keys, timestamp, seed): an exact share (equal draws stay together),
    independent of partitioning.  At least one row stays for training; a
    table with fewer than two rows cannot be split; ``test_size`` 0 holds
    nothing out.  The limit comes from two counting passes, over the upper
    and the lower 16 bits of the draws, of at most 65536 rows each."""
    if float(test_size) <= 0:
        return df.withColumn(IS_TEST, F.lit(False))
    draw = hash_uint32(ts, keys, split_salt(seed))
    draws = df.select(draw.alias("d"))
    high = F.shiftright("d", 16)

    def share(n: int) -> int:
        if n < 2:
            raise ValueError(f"{n} row(s) cannot be split into training and test rows")
        return min(max(1, math.ceil(float(test_size) * n)), n - 1)

    upper, k = kth_of_counts(draws.groupBy(high.alias("b")).count(), share)
    lower, _ = kth_of_counts(draws.where(high == upper).groupBy(F.col("d").bitwiseAND(65535).alias("b")).count(),
                             lambda n: k)
    return df.withColumn(IS_TEST, draw <= F.lit(upper * 65536 + lower))


def add_folds(df: DataFrame, ts: str, keys: Sequence[str] = (), folds: int = 5, seed: int = 42) -> DataFrame:
    """``__fold`` in 0..k-1 (k = max(2, folds)) from a differently salted hash."""
    k = max(2, int(folds))
    return df.withColumn(FOLD, F.pmod(hash_uint32(ts, keys, fold_salt(seed)), F.lit(k)).cast("int"))


def build_pipeline(spec: ModelSpec, features: Sequence[str], label: str, stats: TrainStats):
    est = spec.estimator(stats, label)
    if isinstance(est, ExtraTreesRegressor):
        return est
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return Pipeline(stages=[assembler, est])


def fit_pipeline(spec: ModelSpec, train: DataFrame, features: Sequence[str], label: str,
                 stats: TrainStats) -> PipelineModel:
    est = build_pipeline(spec, features, label, stats)
    if isinstance(est, ExtraTreesRegressor):
        return est.fit(train, features)
    return est.fit(train.select(*features, label))


def predict_with_model(model: PipelineModel, df: DataFrame, ts: str = "timestamp",
                       keys: Sequence[str] = ()) -> DataFrame:
    """``(keys…, ts, prediction)``; the target column is not a feature."""
    keep = [c for c in [*keys, ts] if c in df.columns]
    return model.transform(df).select(*keep, F.col("prediction").cast("double").alias("prediction"))


def _label_stats(df: DataFrame, label: str, folds: int) -> dict:
    """n and population std of the label for the hold-out training set and for
    every fold's training set, in one aggregation."""
    y = F.col(label)
    cols = [F.count(F.when(~F.col(IS_TEST), y)).alias("n_h"), F.stddev_pop(F.when(~F.col(IS_TEST), y)).alias("s_h")]
    for i in range(folds):
        cond = F.col(FOLD) != i
        cols += [F.count(F.when(cond, y)).alias(f"n_{i}"), F.stddev_pop(F.when(cond, y)).alias(f"s_{i}")]
    row = df.agg(*cols).first()
    out = {"holdout": TrainStats(int(row["n_h"]), float(row["s_h"] or 0.0))}
    for i in range(folds):
        out[i] = TrainStats(int(row[f"n_{i}"]), float(row[f"s_{i}"] or 0.0))
    return out


def _grow_trees(data: DataFrame, feats: list, target: str, specs: list, splits: list, row_hash) -> dict:
    """The tree models of all splits, from scans that all splits share."""
    out: dict = {}
    if not specs:
        return out
    fits = [HOLDOUT if s is None else s for s in splits]
    for spec in specs:
        grower = Grower(data, feats, target, FOLD, IS_TEST, row_hash)
        p, bins = tree_params(spec.name, spec.params, spec.seed, len(feats)), int(spec.params.get("max_bins", 32))
        if spec.name == "gradient_boosting":
            rate = float(spec.params["learning_rate"])
            found = grower.boost(fits, p, rate, float(spec.params["subsample"]), bins)
            made = {f: TreeModel(list(feats), trees, start, rate) for f, (start, trees) in found.items()}
        else:
            made = {f: TreeModel(list(feats), trees) for f, trees in grower.grow(fits, p, bins).items()}
        out.update({(spec.name, None if f == HOLDOUT else f): m for f, m in made.items()})
    return out


def train_models(df: DataFrame, target: str, ts: str, config: dict, random_state: int = 42,
                 keys: Sequence[str] = (), parallelism: int = 4, cross_validate: bool = True,
                 checkpoint: bool = True) -> list[TrainingResult]:
    """For each selected model fit on the hold-out training rows, score
    the hold-out rows, and pool out-of-fold predictions over k folds.
    Linear models (``linear_solver: "moments"``, the default) are fitted for
    all splits from one moment pass and scored by one more pass; tree models
    (``tree_grower: "levels"``, the default) are grown for all splits from
    shared scans; MLlib models are fitted in a driver thread pool.  Metrics of
    the latter two come from one grouped aggregation over their stacked
    predictions.

    The training table (features, label, split and fold columns) is written
    once as a reliable checkpoint: every fit then starts from a one-node
    plan instead of re-analysing the whole feature lineage, and a lost
    executor re-reads the checkpoint files instead of recomputing it."""
    keys = list(keys)
    specs = get_selected_models(config, random_state)
    feats = feature_columns(df, target, ts, keys)
    if not feats:
        raise ValueError("no numeric feature columns to train on")
    k = max(2, int(config.get("cross_validation_folds", 5)))
    data = add_folds(add_holdout_flag(df.select(*keys, ts, *feats, target), ts, keys,
                                      float(config.get("test_size", 0.2)), random_state), ts, keys, k, random_state)
    data = cut_lineage(data) if checkpoint else data.persist(StorageLevel.MEMORY_AND_DISK)
    train = data.where(~F.col(IS_TEST))
    test = data.where(F.col(IS_TEST))

    splits = [None, *(range(k) if cross_validate else [])]
    models: dict = {}
    solver = str(config.get("linear_solver", "moments")) if len(feats) <= MAX_FEATURES else "mllib"
    linear = [s for s in specs.values() if s.linear_kind and solver == "moments"]
    grown = [s for s in specs.values() if s.name in TREE_MODELS and config.get("tree_grower", "levels") == "levels"]
    rest = [s for s in specs.values() if s not in linear and s not in grown]
    actual = F.col(target).alias("actual")
    predictions: dict = {}
    certificates: dict = {}
    metrics: dict[str, dict] = {name: {} for name in specs}
    if linear:
        # all linear fits of all splits from one pass (see ml.linear); their
        # predictions are column expressions, so hold-out rows, out-of-fold
        # rows and every metric come from the training table without unions
        moments = cell_moments(data, feats, target, [FOLD, IS_TEST])
        cells = list(moments)
        errors = [F.col(IS_TEST), F.col(target).alias("__y")]
        for spec in linear:
            cols = {}
            for split in splits:
                chosen = [c for c in cells if (not c[1] if split is None else c[0] != split)]
                fit = solve(spec.linear_kind, spec.params, combine(moments, chosen))
                cols[split] = prediction_sql(feats, fit.w, fit.b)
                if split is None:
                    models[(spec.name, None)] = as_pipeline_model(feats, fit.w, fit.b)
                    if fit.sweeps is not None:
                        certificates[spec.name] = {"sweeps": fit.sweeps, "gap": fit.gap}
            hold_pred = F.expr(cols[None])
            hold = test.select(*keys, ts, actual, hold_pred.alias("predicted"))
            errors.append(hold_pred.alias(f"__h_{spec.name}"))
            oof = None
            if cross_validate:
                fold_pred = F.expr("CASE " + " ".join(f"WHEN `{FOLD}` = {i} THEN {cols[i]}" for i in range(k)) + " END")
                oof = data.select(*keys, ts, actual, fold_pred.alias("predicted"))
                errors.append(fold_pred.alias(f"__cv_{spec.name}"))
            predictions[spec.name] = (hold, oof)
        # predictions are projected once, then every metric reads the columns
        scored_rows = data.select(*errors)
        y_test = F.when(F.col(IS_TEST), F.col("__y"))
        aggs = []
        for spec in linear:
            aggs += metric_columns(y_test, F.when(F.col(IS_TEST), F.col(f"__h_{spec.name}")),
                                   prefix=f"{spec.name}\x1f")
            if cross_validate:
                aggs += cv_metric_columns(F.col("__y"), F.col(f"__cv_{spec.name}"), prefix=f"{spec.name}\x1f")
        row = scored_rows.agg(*aggs).first().asDict()
        for key, value in row.items():
            name, metric = key.split("\x1f")
            metrics[name][metric] = value

    models.update(_grow_trees(data, feats, target, grown, splits, hash_uint32(ts, keys, "tree")))
    stats = _label_stats(data, target, k) if any(s.needs_stats for s in rest) else \
        {key: TrainStats(0, 0.0) for key in ["holdout", *range(k)]}

    def fit(job):
        spec, split = job
        if split is None:
            return fit_pipeline(spec, train, feats, target, stats["holdout"])
        return fit_pipeline(spec, data.where(F.col(FOLD) != split), feats, target, stats[split])

    # the other (model, split) fits are independent: one pool for all of them
    jobs = [(spec, split) for spec in rest for split in splits]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        models.update(zip([(s.name, i) for s, i in jobs], pool.map(fit, jobs)))

    def scored(model, rows):
        return model.transform(rows).select(*keys, ts, actual, F.col("prediction").alias("predicted"))

    stacked = None
    for spec in [*grown, *rest]:
        hold = scored(models[(spec.name, None)], test)
        oof = None
        if cross_validate:
            parts = [scored(models[(spec.name, i)], data.where(F.col(FOLD) == i)) for i in range(k)]
            oof = parts[0]
            for p in parts[1:]:
                oof = oof.unionByName(p)
        predictions[spec.name] = (hold, oof)
        part = hold.select(F.lit(spec.name).alias("model"), F.lit("holdout").alias("kind"), "actual", "predicted")
        if oof is not None:
            part = part.unionByName(oof.select(F.lit(spec.name).alias("model"), F.lit("cv").alias("kind"),
                                               "actual", "predicted"))
        stacked = part if stacked is None else stacked.unionByName(part)
    if stacked is not None:
        for r in stacked.groupBy("model", "kind").agg(*metric_columns(), *cv_metric_columns()).collect():
            if r["kind"] == "holdout":
                metrics[r["model"]].update({m: r[m] for m in ("rmse", "mae", "r2", "mape")})
            else:
                metrics[r["model"]].update({"cv_rmse": r["cv_rmse"], "cv_mae": r["cv_mae"]})
    fitted = [(name, models[(name, None)], *predictions[name]) for name in specs]
    return [TrainingResult(name, model, metrics[name], hold, oof, feats, certificates.get(name))
            for name, model, hold, oof in fitted]
