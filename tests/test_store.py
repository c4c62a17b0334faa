"""Calibrations saved as versions and scored again."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from trueline.plans.calibration import run_calibration_pipeline
from trueline.plans.store import load_calibration, save_calibration, versions
from trueline.sources import fixtures as fx

NO_FILTER = {"preprocessing": {"outlier_method": "none"}, "feature_engineering": {"lag_steps": [1], "rolling_windows": [3]}}


def same(a, b, keys):
    joined = a.alias("a").join(b.alias("b"), keys)
    off = joined.select(F.max(F.abs(F.col("a.calibrated_prediction") - F.col("b.calibrated_prediction")))).first()[0]
    assert a.count() == b.count() == joined.count() and off < 1e-9


@pytest.fixture(scope="module")
def plain(spark):
    ref, sen = fx.ref_clean(spark, SF_SMALL), fx.sen_clean(spark, SF_SMALL)
    config = {**NO_FILTER, "training": {"selected_models": ["ridge", "lasso"], "model_params": {}}}
    return ref, sen, run_calibration_pipeline(ref, sen, config, block_rows=64)


def test_reloaded_scores_equal_those_of_the_run(spark, plain, tmp_path):
    ref, sen, run = plain
    store = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no finished version"):
        load_calibration(store)
    first = save_calibration(run, store)
    second = save_calibration(run, store)
    assert versions(spark, store) == [first, second]
    loaded = load_calibration(store)
    assert loaded.path.endswith(second) and load_calibration(store, first).path.endswith(first)
    scored = loaded.score(sen, ref, 64)
    assert scored.columns == ["timestamp", "calibrated_prediction", "reference_value"]
    same(scored, run.calibrated_dataset, ["timestamp"])


def test_a_version_without_manifest_does_not_exist(spark, plain, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    good = save_calibration(plain[2], store)
    monkeypatch.setattr("trueline.plans.store.save_model", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        save_calibration(plain[2], store)
    assert versions(spark, store) == [good] and load_calibration(store).path.endswith(good)
    with pytest.raises(ValueError, match="no finished version nope"):
        load_calibration(store, "nope")


def test_new_readings_without_the_target(spark, plain, tmp_path):
    ref, sen, run = plain
    store = str(tmp_path / "store")
    save_calibration(run, store)
    loaded = load_calibration(store)
    scored = loaded.score(sen, ref.drop("pm25"), 64)
    assert scored.columns == ["timestamp", "calibrated_prediction"]
    same(scored, run.calibrated_dataset, ["timestamp"])
    with pytest.raises(ValueError, match="need the reference"):
        loaded.score(sen, None, 64)
    with pytest.raises(ValueError, match="no column"):
        loaded.score(sen.drop("humidity"), ref, 64)


def test_series_of_the_store_only(spark, tmp_path):
    ref, sen = fx.ref_keyed(spark, SF_SMALL), fx.sen_keyed(spark, SF_SMALL)
    config = {**NO_FILTER, "training": {"selected_models": ["linear_regression", "ridge"], "model_params": {},
                                        "models_per_key": True, "cross_validation_folds": 2}}
    run = run_calibration_pipeline(ref, sen, config, keys=["event_type"], block_rows=64)
    store = str(tmp_path / "store")
    save_calibration(run, store)
    other = lambda df: df.unionByName(df.where("event_type = 'click'").withColumn("event_type", F.lit("unseen")))
    scored = load_calibration(store).score(other(sen), other(ref), 64)
    assert scored.where("event_type = 'unseen'").count() == 0
    same(scored, run.calibrated_dataset, ["event_type", "timestamp"])
