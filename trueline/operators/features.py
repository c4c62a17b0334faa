"""Lag, rolling and calendar features (P3), all in one window pass."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window

from ..functions.timecols import US_PER_DAY, calendar_columns
from .ordered import DEFAULT_BLOCK_ROWS, ordered_select
from .preprocess import numeric_columns


def lag_feature_sql(columns: Sequence[str], lag_steps: Sequence[int]) -> list[str]:
    """W3 as SQL text over the window ``{w}`` (one parse per column)."""
    return [f"lag(`{c}`, {int(k)}) OVER ({{w}}) AS `{c}_lag_{k}`" for c in columns for k in lag_steps]


def rolling_feature_sql(columns: Sequence[str], windows: Sequence[int]) -> list[str]:
    """W4 / W5 as SQL text over the window ``{w}``."""
    out = []
    for c in columns:
        for n in windows:
            frame = f"({{w}} ROWS BETWEEN {int(n) - 1} PRECEDING AND CURRENT ROW)"
            out.append(f"avg(`{c}`) OVER {frame} AS `{c}_roll_mean_{n}`")
            out.append(f"coalesce(stddev_samp(`{c}`) OVER {frame}, 0.0D) AS `{c}_roll_std_{n}`")
    return out


def _window_features(df: DataFrame, ts: str, columns: Sequence[str], lag_steps, windows, keys,
                     block_rows, time_block_us) -> DataFrame:
    lag_steps = [int(k) for k in lag_steps]
    windows = [int(n) for n in windows]
    back = max([0, *lag_steps, *[n - 1 for n in windows]])
    if min([0, *lag_steps]) < 0:
        raise ValueError("lag steps must be positive")

    def build(w: Window):
        return lag_feature_sql(columns, lag_steps) + rolling_feature_sql(columns, windows)

    return ordered_select(df, ts, keys, back, 0, build, block_rows, time_block_us)


def create_lag_features(df: DataFrame, ts: str, columns: Sequence[str], lag_steps: Sequence[int],
                        keys: Sequence[str] = (), block_rows: int = DEFAULT_BLOCK_ROWS,
                        time_block_us: int = US_PER_DAY) -> DataFrame:
    return _window_features(df, ts, columns, lag_steps, [], keys, block_rows, time_block_us)


def create_rolling_features(df: DataFrame, ts: str, columns: Sequence[str], windows: Sequence[int],
                            keys: Sequence[str] = (), block_rows: int = DEFAULT_BLOCK_ROWS,
                            time_block_us: int = US_PER_DAY) -> DataFrame:
    return _window_features(df, ts, columns, [], windows, keys, block_rows, time_block_us)


def create_time_features(df: DataFrame, ts: str) -> DataFrame:
    """Hour, day_of_week (Mon=0), month, is_weekend."""
    return df.withColumns(calendar_columns(ts))


def engineer_features(df: DataFrame, ts: str, target: str, config: dict, keys: Sequence[str] = (),
                      block_rows: int = DEFAULT_BLOCK_ROWS, time_block_us: int = US_PER_DAY) -> DataFrame:
    """Features of every numeric column except the target, then drop
    rows with any NULL.  Source columns are fixed first (no lag of a lag)."""
    if not bool(config.get("enabled", True)):
        return df
    keys = list(keys)
    columns = numeric_columns(df, exclude=[ts, target, *keys])
    lag_steps = [int(k) for k in config.get("lag_steps", [1, 2, 3])]
    windows = [int(n) for n in config.get("rolling_windows", [3, 6])]
    out = df
    if columns and (lag_steps or windows):
        out = _window_features(df, ts, columns, lag_steps, windows, keys, block_rows, time_block_us)
        # pandas column order: all lags, then all rolling columns
        lag_cols = [f"{c}_lag_{k}" for c in columns for k in lag_steps]
        roll_cols = [f"{c}_roll_{s}_{n}" for c in columns for n in windows for s in ("mean", "std")]
        out = out.select(*df.columns, *lag_cols, *roll_cols)
    if bool(config.get("add_time_features", True)):
        out = create_time_features(out, ts)
    return out.dropna(how="any", subset=[c for c in out.columns if c not in keys])
