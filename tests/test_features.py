import datetime as dt

import numpy as np
import pandas as pd

from trueline.operators.features import engineer_features


def test_features_match_pandas(spark):
    rng = np.random.default_rng(1)
    n = 40
    ts = [dt.datetime(2024, 1, 5) + dt.timedelta(hours=i) for i in range(n)]
    pdf = pd.DataFrame({"timestamp": ts, "y": rng.normal(size=n), "a": rng.normal(size=n), "b": rng.integers(0, 5, n) * 1.0})
    rows = [(t.to_pydatetime(), float(y), float(a), float(b)) for t, y, a, b in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, y double, a double, b double")
    cfg = {"lag_steps": [1, 3], "rolling_windows": [2, 4]}
    got = engineer_features(df, "timestamp", "y", cfg, block_rows=10).toPandas().sort_values("timestamp")
    exp = pdf.copy()
    for c in ["a", "b"]:
        for k in [1, 3]:
            exp[f"{c}_lag_{k}"] = exp[c].shift(k)
    for c in ["a", "b"]:
        for w in [2, 4]:
            r = exp[c].rolling(w, min_periods=1)
            exp[f"{c}_roll_mean_{w}"] = r.mean()
            exp[f"{c}_roll_std_{w}"] = r.std().fillna(0.0)
    t = pd.to_datetime(exp["timestamp"])
    exp["hour"], exp["day_of_week"], exp["month"] = t.dt.hour, t.dt.dayofweek, t.dt.month
    exp["is_weekend"] = t.dt.dayofweek.isin([5, 6]).astype(int)
    exp = exp.dropna().reset_index(drop=True)
    got = got.reset_index(drop=True)
    assert list(got.columns) == list(exp.columns)
    for c in exp.columns[1:]:
        assert np.allclose(got[c].astype(float), exp[c].astype(float), atol=1e-9), c


def test_disabled_returns_input(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, 2.0)], "timestamp timestamp_ntz, y double, a double")
    assert engineer_features(df, "timestamp", "y", {"enabled": False}).columns == df.columns
