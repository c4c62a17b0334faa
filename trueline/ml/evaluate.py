"""Metrics (E1-E6), leaderboard (O2) and best model (O3)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("rmse", "mae", "r2", "mape")
# Leaderboard columns.
BOARD = ("model", *METRICS, "cv_rmse", "cv_mae")


def metric_columns(y="actual", p="predicted", prefix: str = "") -> list[Column]:
    """rmse, mae, r2 (1 − SSE/SST; constant target → 1 if perfect else 0) and
    mape (percent, zero targets ignored, NULL if all targets are zero)."""
    y = F.col(y) if isinstance(y, str) else y
    p = F.col(p) if isinstance(p, str) else p
    err = y - p
    sse = F.sum(err * err)
    sst = F.var_pop(y) * F.count(y)
    r2 = (F.when(sst > 0, F.lit(1.0) - sse / sst)
          .when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    mape = F.avg(F.when(y != 0, F.abs(err / y))) * F.lit(100.0)
    return [F.sqrt(F.avg(err * err)).alias(prefix + "rmse"), F.avg(F.abs(err)).alias(prefix + "mae"),
            r2.alias(prefix + "r2"), mape.alias(prefix + "mape")]


def regression_metrics(pred: DataFrame, y: str = "actual", p: str = "predicted",
                       group: Sequence[str] = ()) -> DataFrame:
    """One row (per group) of rmse, mae, r2, mape."""
    g = pred.groupBy(*group) if group else pred.groupBy()
    return g.agg(*metric_columns(y, p))


def cv_metric_columns(y="actual", p="predicted", prefix: str = "") -> list[Column]:
    y = F.col(y) if isinstance(y, str) else y
    p = F.col(p) if isinstance(p, str) else p
    err = y - p
    return [F.sqrt(F.avg(err * err)).alias(prefix + "cv_rmse"), F.avg(F.abs(err)).alias(prefix + "cv_mae")]


def ranked(results: Sequence, config: dict) -> list:
    """Training results by the configured metric of their metric dicts
    (unknown → rmse, the direction is kept); missing metrics last, then by
    model name."""
    sort_by = str(config.get("sort_by", "rmse"))
    ascending = bool(config.get("ascending", True))
    if not results:
        raise ValueError("there is no training result to rank")
    if sort_by not in BOARD[1:] or sort_by not in results[0].metrics:
        sort_by = "rmse"

    def key(r):
        v = r.metrics.get(sort_by)
        missing = v is None or v != v
        return missing, (v if ascending else -v) if not missing else 0.0, r.model_name

    return sorted(results, key=key)
