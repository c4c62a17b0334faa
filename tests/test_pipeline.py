import pytest

from conftest import SF_SMALL
from trueline.config import LINEAR_FAMILY
from trueline.ml.train import predict_with_model
from trueline.plans.calibration import build_calibrated_dataset, preview, run_calibration_pipeline
from trueline.session import checkpoint_dir
from trueline.sources import fixtures as fx
from trueline.sources.sinks import load_model, save_model


@pytest.fixture(scope="module")
def result(spark):
    return run_calibration_pipeline(fx.ref_clean(spark, SF_SMALL), fx.sen_clean(spark, SF_SMALL),
                                    {"training": {"selected_models": LINEAR_FAMILY, "model_params": {}}},
                                    block_rows=64)


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["timestamp", "reference_value", "calibrated_prediction"]
    assert df.count() > 0


def test_pipeline_outputs(spark, result):
    assert result.alignment_metadata["lag_steps"] == -2
    assert result.best_model_name in LINEAR_FAMILY
    assert result.leaderboard.count() == 4
    assert result.calibrated_dataset.count() == result.featured_data.count()
    assert preview(result.calibrated_dataset).count() == 50
    other = [m for m in LINEAR_FAMILY if m != result.best_model_name][0]
    assert build_calibrated_dataset(result, other).count() == result.featured_data.count()
    params = result.preprocessing_artifacts["sensor"].table().collect()
    assert {r.column for r in params} == {"pm25_raw", "humidity", "voc", "flat"}


def test_model_roundtrip(spark, result, tmp_path):
    path = str(tmp_path / "model")
    save_model(result.best_model, path)
    a = predict_with_model(result.best_model, result.featured_data).orderBy("timestamp").collect()
    b = predict_with_model(load_model(path), result.featured_data).orderBy("timestamp").collect()
    assert a == b


def test_missing_target_fails_early(spark):
    ref = fx.ref_clean(spark, SF_SMALL).drop("pm25")
    with pytest.raises(ValueError, match="to calibrate against"):
        run_calibration_pipeline(ref, fx.sen_clean(spark, SF_SMALL), {})


def test_keyed_pipeline(spark):
    res = run_calibration_pipeline(fx.ref_keyed(spark, SF_SMALL), fx.sen_keyed(spark, SF_SMALL),
                                   {"training": {"selected_models": ["linear_regression"], "model_params": {}}},
                                   keys=["event_type"], block_rows=64)
    lags = {r.event_type: r.lag_steps for r in res.lag_table.collect()}
    assert len(lags) == 5
    assert res.calibrated_dataset.select("event_type").distinct().count() == 5


def test_checkpoint_dir_is_read_from_session(spark):
    assert checkpoint_dir(spark)
