import datetime as dt

import pytest

from trueline.operators import preprocess as pp
from trueline.session import checkpoint_dir
from trueline.sources.readers import scan_frame
from trueline.sources.sinks import write_csv, write_parquet


def frame(spark):
    return spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 1, 5), 1.5), (dt.datetime(2024, 1, 1, 1), 2.5)],
                                 "timestamp timestamp_ntz, v double")


def test_scan_frame_by_suffix(spark, tmp_path):
    df = frame(spark)
    assert scan_frame(df) is df
    write_parquet(df, str(tmp_path / "p"))
    assert sorted(r.v for r in scan_frame(str(tmp_path / "p"), spark).collect()) == [1.5, 2.5]
    write_csv(df, str(tmp_path / "c.csv"))
    back = scan_frame(str(tmp_path / "c.csv"), spark)
    assert dict(back.dtypes)["timestamp"] == "string"      # parsed later by validation
    assert back.count() == 2


def test_checkpoint_dir_requires_shared_folder_on_cluster(spark, monkeypatch):
    class FakeContext:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class FakeSession:
        sparkContext = FakeContext()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="shared folder"):
        checkpoint_dir(FakeSession())
    assert checkpoint_dir(spark)


def test_approx_quantiles_switch(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)], "x double")
    exact, _ = pp.remove_outliers_iqr(df, ["x"], 1.5)
    approx, params = pp.remove_outliers_iqr(df, ["x"], 1.5, approx=True)
    assert exact.count() == approx.count() == 100
    assert params.value("q__x")[0] in (25.0, 26.0)
