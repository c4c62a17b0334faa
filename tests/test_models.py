import datetime as dt

import numpy as np
import pytest

from trueline.ml.evaluate import regression_metrics
from trueline.ml.registry import TrainStats, get_selected_models
from trueline.ml.train import fit_pipeline, predict_with_model, train_models
from trueline.plans.calibration import create_leaderboard, select_best


def synthetic(spark, n=300, p=4, seed=3, nonlinear=False):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p)) * np.array([1.0, 3.0, 0.5, 2.0])[:p]
    y = 2.0 + X @ np.array([1.5, -0.7, 0.0, 0.3])[:p] + rng.normal(scale=0.5, size=n)
    if nonlinear:
        y = np.sin(2 * X[:, 0]) * 3 + (X[:, 1] > 0) * 2 + rng.normal(scale=0.1, size=n)
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(n)]
    rows = [(ts[i], float(y[i]), *map(float, X[i])) for i in range(n)]
    cols = ", ".join(f"x{j} double" for j in range(p))
    return spark.createDataFrame(rows, f"timestamp timestamp_ntz, y double, {cols}"), X, y


def coordinate_descent(X, y, l1, l2, iters=20000):
    """scikit-learn objective (1/2n)|y - b - Xw|^2 + l1|w|_1 + l2/2 |w|^2."""
    n, p = X.shape
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.zeros(p)
    norms = (Xc ** 2).sum(0) / n
    for _ in range(iters):
        w_old = w.copy()
        for j in range(p):
            r = yc - Xc @ w + Xc[:, j] * w[j]
            z = Xc[:, j] @ r / n
            w[j] = np.sign(z) * max(abs(z) - l1, 0.0) / (norms[j] + l2)
        if np.max(np.abs(w - w_old)) < 1e-14:
            break
    return w, y.mean() - X.mean(0) @ w


def fitted(spark, name, params=None):
    df, X, y = synthetic(spark)
    spec = get_selected_models({"selected_models": [name], "model_params": {name: params or {}}})[name]
    stats = TrainStats(len(y), float(np.std(y)))
    model = fit_pipeline(spec, df, [f"x{j}" for j in range(X.shape[1])], "y", stats)
    lr = model.stages[-1]
    return np.array(lr.coefficients), lr.intercept, X, y


def test_ols_matches_lstsq(spark):
    w, b, X, y = fitted(spark, "linear_regression")
    A = np.c_[np.ones(len(y)), X]
    sol = np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose(w, sol[1:], atol=1e-8) and abs(b - sol[0]) < 1e-8


def test_ridge_matches_closed_form(spark):
    w, b, X, y = fitted(spark, "ridge", {"alpha": 5.0})
    Xc, yc = X - X.mean(0), y - y.mean()
    sol = np.linalg.solve(Xc.T @ Xc + 5.0 * np.eye(X.shape[1]), Xc.T @ yc)
    assert np.allclose(w, sol, atol=1e-6)
    assert abs(b - (y.mean() - X.mean(0) @ sol)) < 1e-6


@pytest.mark.parametrize("name,params,l1,l2", [("lasso", {"alpha": 0.1}, 0.1, 0.0),
                                               ("elastic_net", {"alpha": 0.2, "l1_ratio": 0.3}, 0.06, 0.14)])
def test_l1_models_match_coordinate_descent(spark, name, params, l1, l2):
    w, b, X, y = fitted(spark, name, params)
    sol, b0 = coordinate_descent(X, y, l1, l2)
    assert np.allclose(w, sol, atol=1e-5) and abs(b - b0) < 1e-5


def test_metrics_edge_cases(spark):
    zeros = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "actual double, predicted double")
    assert regression_metrics(zeros).collect()[0].mape is None
    const = spark.createDataFrame([(3.0, 3.0), (3.0, 3.0)], "actual double, predicted double")
    assert regression_metrics(const).collect()[0].r2 == 1.0
    off = spark.createDataFrame([(3.0, 2.0), (3.0, 3.0)], "actual double, predicted double")
    r = regression_metrics(off).collect()[0]
    assert r.r2 == 0.0 and abs(r.mape - 100 / 6) < 1e-12 and abs(r.rmse - np.sqrt(0.5)) < 1e-12


def test_registry_rules():
    specs = get_selected_models({"selected_models": ["xgboost", "ridge", "nope"]})
    assert list(specs) == ["ridge"]
    with pytest.raises(ValueError):
        get_selected_models({"selected_models": ["xgboost"]})
    with pytest.raises(ValueError):
        get_selected_models({"selected_models": ["ridge"], "model_params": {"ridge": {"gamma": 1}}})


def test_train_models_leaderboard_and_best(spark):
    df, _, _ = synthetic(spark, n=200)
    results = train_models(df, "y", "timestamp", {"selected_models": ["linear_regression", "lasso"],
                                                   "cross_validation_folds": 3}, 42)
    board = create_leaderboard(results, {"sort_by": "unknown"}).collect()
    assert [r.model for r in board] == sorted([r.model_name for r in results], key=lambda m: next(
        x.metrics["rmse"] for x in results if x.model_name == m))
    assert select_best(results, {"sort_by": "rmse"}).model_name == board[0].model
    assert results[0].cv_predictions.count() == 200
    assert set(results[0].metrics) == {"rmse", "mae", "r2", "mape", "cv_rmse", "cv_mae"}


def test_r2_descending_order(spark):
    df, _, _ = synthetic(spark, n=150)
    results = train_models(df, "y", "timestamp", {"selected_models": ["linear_regression", "lasso"]}, 42,
                           cross_validate=False)
    board = create_leaderboard(results, {"sort_by": "r2", "ascending": False}).collect()
    assert board[0].r2 >= board[1].r2


def test_forest_is_deterministic_by_seed(spark):
    df, _, _ = synthetic(spark, n=150, nonlinear=True)
    cfg = {"selected_models": ["random_forest"], "model_params": {"random_forest": {"n_estimators": 10, "max_depth": 4}}}
    a = train_models(df, "y", "timestamp", cfg, 7, cross_validate=False)[0].predictions.orderBy("timestamp").collect()
    b = train_models(df, "y", "timestamp", cfg, 7, cross_validate=False)[0].predictions.orderBy("timestamp").collect()
    assert a == b


@pytest.mark.parametrize("name,params", [("extra_trees", {"n_estimators": 8, "max_depth": 6}),
                                         ("gradient_boosting", {"n_estimators": 15})])
def test_tree_models_beat_mean(spark, name, params):
    df, _, y = synthetic(spark, n=300, nonlinear=True)
    r = train_models(df, "y", "timestamp", {"selected_models": [name], "model_params": {name: params}}, 42,
                     cross_validate=False)[0]
    assert r.metrics["rmse"] < 0.8 * float(np.std(y))
    scored = predict_with_model(r.model, df)
    assert scored.columns == ["timestamp", "prediction"] and scored.count() == 300


def _moments_fit(spark, df, feats, name, params=None):
    cfg = {"selected_models": [name], "model_params": {name: params or {}}, "test_size": 0.0,
           "linear_solver": "moments"}
    r = train_models(df, "y", "timestamp", cfg, 42, cross_validate=False)[0]
    return np.array([p.prediction for p in predict_with_model(r.model, df).orderBy("timestamp").collect()])


def test_moment_solver_matches_numpy(spark):
    df, X, y = synthetic(spark, n=250)
    feats = [f"x{j}" for j in range(X.shape[1])]
    A = np.c_[np.ones(len(y)), X]
    ols = A @ np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose(_moments_fit(spark, df, feats, "linear_regression"), ols, atol=1e-8)
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 2.0 * np.eye(X.shape[1]), Xc.T @ yc)
    assert np.allclose(_moments_fit(spark, df, feats, "ridge", {"alpha": 2.0}), y.mean() + Xc @ w, atol=1e-8)
    w, b = coordinate_descent(X, y, 0.06, 0.14)
    assert np.allclose(_moments_fit(spark, df, feats, "elastic_net", {"alpha": 0.2, "l1_ratio": 0.3}),
                       b + X @ w, atol=1e-6)


def test_moment_solver_collinear_and_constant_columns(spark):
    rng = np.random.default_rng(5)
    n = 120
    a = rng.normal(size=n)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(3 * a[i] + 1), float(a[i]), float(2 * a[i]), 5.0)
            for i in range(n)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, y double, x0 double, x1 double, flat double")
    pred = _moments_fit(spark, df, ["x0", "x1", "flat"], "linear_regression")
    assert np.allclose(pred, 3 * a + 1, atol=1e-8)


def test_moment_and_mllib_solvers_agree(spark):
    df, _, _ = synthetic(spark, n=200)
    base = {"selected_models": ["linear_regression", "ridge", "lasso", "elastic_net"], "cross_validation_folds": 3}
    a = {r.model_name: r.metrics for r in train_models(df, "y", "timestamp", {**base, "linear_solver": "moments"}, 42)}
    b = {r.model_name: r.metrics for r in train_models(df, "y", "timestamp", {**base, "linear_solver": "mllib"}, 42)}
    for m in a:
        for key in ("rmse", "mae", "cv_rmse"):
            assert abs(a[m][key] - b[m][key]) < 1e-6, (m, key)
