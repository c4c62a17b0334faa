"""One linear model set per series (M11 with keys).

With ``models_per_key`` every series gets its own hold-out rows, its own fits
of each selected linear model, its own leaderboard and best model, as if the
series had been trained alone.  Everything is grouped by series: moments per
(series, fold, hold-out) cell from one pass, solves on the executors, and
coefficients attached to the rows by series.  Nothing per series goes to the
driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from ..functions.hashing import hash_uint32, split_salt
from ..operators.joins import attach
from ..session import cut_lineage
from .evaluate import BOARD, cv_metric_columns, metric_columns
from .linear import Moments, combine, moment_table, solve
from .registry import get_selected_models
from .train import FOLD, IS_TEST, add_folds, feature_columns

HOLDOUT = -1            # the split whose model is fitted to all training rows


@dataclass
class PerKeyResult:
    models: DataFrame           # (keys…, model, split, w, b, sweeps, gap)
    leaderboard: DataFrame      # (keys…, place, model, metrics…)
    predictions: DataFrame      # hold-out (keys…, ts, model, actual, predicted)
    cv_predictions: DataFrame   # the same, out of fold
    feature_columns: list

    def best_models(self) -> DataFrame:
        """(keys…, model): the first of each series' leaderboard."""
        return self.leaderboard.where("place = 1").drop("place", *BOARD[1:])


def _kth(counts: DataFrame, keys: list[str], k: Column) -> DataFrame:
    """Per series the value ``__b`` at which the running count reaches ``k``,
    and what is left of ``k`` inside it."""
    w = Window.partitionBy(*keys).orderBy("__b")
    run = counts.withColumn("__upto", F.sum("count").over(w)).withColumn("__k", k)
    return run.where((F.col("__upto") >= F.col("__k")) & (F.col("__upto") - F.col("count") < F.col("__k"))).select(
        *keys, "__b", (F.col("__k") - F.col("__upto") + F.col("count")).alias("__left"))


def add_holdout_per_key(df: DataFrame, ts: str, keys: Sequence[str], test_size: float = 0.2,
                        seed: int = 42) -> DataFrame:
    """``__is_test`` for the ⌈test_size · n⌉ smallest draws of each series, at
    least one and at most n − 1.  A series of one row has no test row."""
    keys = list(keys)
    draw = hash_uint32(ts, keys, split_salt(seed))
    draws = df.select(*keys, draw.alias("__d"))
    high = draws.groupBy(*keys, F.shiftright("__d", 16).alias("__b")).count()
    n = F.sum("count").over(Window.partitionBy(*keys))
    share = F.least(F.greatest(F.ceil(F.lit(float(test_size)) * n), F.lit(1)), n - 1)
    first = cut_lineage(_kth(high, keys, share).withColumnRenamed("__b", "__hi"))
    inside = attach(draws, first, keys).where(F.shiftright("__d", 16) == F.col("__hi"))
    low = inside.groupBy(*keys, "__hi", "__left", F.col("__d").bitwiseAND(65535).alias("__b")).count()
    w = Window.partitionBy(*keys).orderBy("__b")
    limit = (low.withColumn("__upto", F.sum("count").over(w)).where("__upto >= __left").groupBy(*keys)
             .agg(F.min(F.col("__hi") * 65536 + F.col("__b")).alias("__limit")))
    marked = attach(df, limit, keys)
    return marked.withColumn(IS_TEST, F.coalesce(draw <= F.col("__limit"), F.lit(False))).drop("__limit")


def train_models_per_key(df: DataFrame, target: str, ts: str, config: dict, random_state: int = 42,
                         keys: Sequence[str] = ()) -> PerKeyResult:
    """Fit every selected linear model to every series.  Series whose training
    side is empty in some split get no model for it."""
    keys = list(keys)
    if not keys:
        raise ValueError("models_per_key needs series keys")
    specs = get_selected_models(config, random_state)
    other = [s.name for s in specs.values() if not s.linear_kind]
    if other:
        raise ValueError(f"only linear models are fitted per series, not {other}")
    feats = feature_columns(df, target, ts, keys)
    if not feats:
        raise ValueError("no numeric feature columns to train on")
    k = max(2, int(config.get("cross_validation_folds", 5)))
    data = add_holdout_per_key(df.select(*keys, ts, *feats, target), ts, keys, float(config.get("test_size", 0.2)),
                               random_state)
    data = cut_lineage(add_folds(data, ts, keys, k, random_state))
    cells = [FOLD, IS_TEST]
    summed = moment_table(data, feats, target, [*keys, *cells])
    p = len(feats)
    schema = StructType([*(data.schema[c] for c in keys)])
    schema = schema.add("model", StringType()).add("split", IntegerType())
    schema = schema.add("w", ArrayType(DoubleType())).add("b", DoubleType())
    schema = schema.add("sweeps", IntegerType()).add("gap", DoubleType())

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        moments = {(r[FOLD], r[IS_TEST]): Moments.from_row(r["n"], r["mean"], r["scatter"])
                   for r in group.to_dict("records")}
        head = group.iloc[0][keys].tolist()
        rows = []
        for split in (HOLDOUT, *range(k)):
            chosen = [c for c in moments if (not c[1] if split == HOLDOUT else c[0] != split)]
            if not chosen:
                continue
            total = combine(moments, chosen)
            for spec in specs.values():
                made = solve(spec.linear_kind, spec.params, total)
                rows.append((*head, spec.name, split, made.w.tolist(), made.b, made.sweeps, made.gap))
        out = pd.DataFrame(rows, columns=schema.names)
        return out.astype({"sweeps": "Int32", "gap": "Float64"})

    models = cut_lineage(summed.groupBy(*keys).applyInPandas(fit, schema))
    dot = F.aggregate(F.zip_with("w", "x", lambda a, v: a * v), F.lit(0.0), lambda s, v: s + v)

    def scored(rows: DataFrame, split: Column) -> DataFrame:
        x = F.array(*[F.col(f"`{f}`").cast("double") for f in feats])
        rows = rows.select(*keys, ts, F.col(target).alias("actual"), split.alias("split"), x.alias("x"))
        joined = attach(rows, models, keys, ["split"], "inner", array_bytes=8 * p)
        return joined.select(*keys, ts, "model", "actual", (F.col("b") + dot).alias("predicted"))

    hold = scored(data.where(F.col(IS_TEST)), F.lit(HOLDOUT))
    oof = scored(data, F.col(FOLD))
    by = [*keys, "model"]
    one = hold.groupBy(*by).agg(*metric_columns())
    two = oof.groupBy(*by).agg(*cv_metric_columns())
    board = attach(one, two, keys, ["model"])
    sort_by = str(config.get("sort_by", "rmse"))
    sort_by = sort_by if sort_by in BOARD[1:] else "rmse"
    order = F.col(sort_by).asc_nulls_last() if config.get("ascending", True) else F.col(sort_by).desc_nulls_last()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "model"))
    return PerKeyResult(models, board.select(*keys, place.alias("place"), *BOARD), hold, oof, feats)


def scored_per_key(rows: DataFrame, coefficients: DataFrame, features: Sequence[str], ts: str, keys: Sequence[str],
                   carried: Sequence[Column] = (), how: str = "inner") -> DataFrame:
    """(keys…, ts, carried…, calibrated_prediction) with one (w, b) per series."""
    keys = list(keys)
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    rows = rows.select(*keys, ts, F.struct(F.lit(0), *carried).alias("carried"), x.alias("x"))
    dot = F.aggregate(F.zip_with("w", "x", lambda a, v: a * v), F.lit(0.0), lambda s, v: s + v)
    joined = attach(rows, coefficients.select(*keys, "w", "b"), keys, how=how, array_bytes=8 * len(features))
    names = [f.name for f in rows.schema["carried"].dataType.fields[1:]]
    return joined.select(*keys, ts, *[F.col("carried")[n].alias(n) for n in names],
                         (F.col("b") + dot).alias("calibrated_prediction"))


def calibrated_per_key(featured: DataFrame, result: PerKeyResult, ts: str, target: str,
                       keys: Sequence[str]) -> DataFrame:
    """(keys…, ts, reference_value, calibrated_prediction) with each series'
    best model."""
    keys = list(keys)
    coefficients = attach(result.models.where(F.col("split") == HOLDOUT), result.best_models(), keys, ["model"], "left_semi")
    return scored_per_key(featured, coefficients, result.feature_columns, ts, keys,
                          [F.col(target).alias("reference_value")], "left")
