"""Default configuration (same sections and keys as the reference's YAML)."""

from __future__ import annotations

import copy

# The reference's default configuration.
DEFAULT_CONFIG = {
    "app": {"random_state": 42},
    "data": {"timestamp_column": "timestamp", "target_column": "pm25",
             "sensor_prefix": "sensor", "reference_prefix": "reference"},
    "preprocessing": {"missing_strategy": "median", "outlier_method": "iqr",
                      "outlier_multiplier": 1.5, "normalization": "standard"},
    "alignment": {"resample_rule": "1H", "aggregation": "mean", "max_lag_steps": 6, "lag_column": "auto"},
    "feature_engineering": {"enabled": True, "lag_steps": [1, 2, 3], "rolling_windows": [3, 6],
                            "add_time_features": True},
    "training": {"test_size": 0.2, "cross_validation_folds": 5,
                 "selected_models": ["linear_regression", "ridge", "lasso", "elastic_net", "random_forest",
                                     "gradient_boosting", "extra_trees", "xgboost"],
                 "model_params": {"ridge": {"alpha": 1.0},
                                  "random_forest": {"n_estimators": 200, "max_depth": 10},
                                  "xgboost": {"n_estimators": 300, "max_depth": 5, "learning_rate": 0.05}}},
    "evaluation": {"sort_by": "rmse", "ascending": True},
}
LINEAR_FAMILY = ["linear_regression", "ridge", "lasso", "elastic_net"]


def default_config() -> dict:
    return copy.deepcopy(DEFAULT_CONFIG)


def merged_config(overrides: dict | None = None) -> dict:
    """Deep-merge ``overrides`` into the defaults (sections are dicts)."""
    cfg = default_config()
    for section, values in (overrides or {}).items():
        if isinstance(values, dict) and isinstance(cfg.get(section), dict):
            cfg[section] = {**cfg[section], **values}
        else:
            cfg[section] = values
    return cfg
