"""A store of calibrations: what a run fitted, scored by another session.

A store is a folder of versions.  A version holds the parameters of both series
(imputation, scaling), the lags, the model and, last of all, a manifest; a
version without a finished manifest does not exist for readers, so a run that
fails half-way leaves the store as it was, and versions are never changed.
Tables are Parquet and stay tables: parameters, lags and coefficients of many
series never pass the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import merged_config
from ..functions.rules import parse_rule
from ..ml.per_key import HOLDOUT, scored_per_key
from ..operators.align import apply_lag, keyed_join, prefix_columns
from ..operators.features import engineer_features
from ..operators.joins import attach
from ..operators.ordered import DEFAULT_BLOCK_ROWS, time_block_for
from ..operators.params import Params
from ..operators.preprocess import PreprocessingArtifacts
from ..operators.resample import resample_timeseries
from ..operators.validate import validate_series
from ..sources.readers import Source, scan_frame
from ..sources.sinks import load_model, save_model
from .calibration import CalibrationResult

SIDES = ("reference", "sensor")


def versions(spark: SparkSession, store: str) -> list[str]:
    """Finished versions, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(s.getPath().getName() for s in fs.listStatus(root)
                  if fs.exists(done(s.getPath(), "manifest/_SUCCESS")))


def save_calibration(result: CalibrationResult, store: str) -> str:
    """Write what ``result`` fitted as a new version; its name."""
    spark = result.featured_data.sparkSession
    version = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    at = f"{store}/{version}"
    sides = {}
    for side in SIDES:
        art = result.preprocessing_artifacts[side]
        sides[side] = {"columns": art.numeric_columns, "strategy": art.strategy, "normalization": art.normalization,
                       "parts": [p for p in ("imputer", "scaler") if getattr(art, p) is not None]}
        for part in sides[side]["parts"]:
            getattr(art, part).table.write.parquet(f"{at}/{side}-{part}")
    if result.lag_table is not None:
        result.lag_table.select(*result.keys, F.col("lag_steps").cast("int")).write.parquet(f"{at}/lags")
    if result.per_key is not None:
        models, best = result.per_key.models.where(F.col("split") == HOLDOUT), result.per_key.best_models()
        attach(models, best, result.keys, ["model"], "left_semi").select(
            *result.keys, "model", "w", "b").write.parquet(f"{at}/coefficients")
        features = result.per_key.feature_columns
    else:
        save_model(result.best_model, f"{at}/model")
        features = result.best_result.feature_columns
    about = {"keys": result.keys, "config": result.config, "sides": sides, "features": features,
             "lag_steps": result.alignment_metadata["lag_steps"], "per_key": result.per_key is not None}
    spark.range(1).select(F.lit(json.dumps(about, default=lambda schema: schema.simpleString())).alias("value")).coalesce(1).write.text(f"{at}/manifest")
    return version


@dataclass
class StoredCalibration:
    """A version of a store, ready to score new readings."""
    path: str
    about: dict
    artifacts: dict[str, PreprocessingArtifacts]
    lags: DataFrame | int

    @property
    def keys(self) -> list[str]:
        return self.about["keys"]

    def score(self, sensor: Source, reference: Source | None = None, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
        """(keys…, ts, calibrated_prediction) for new raw readings, and
        ``reference_value`` where the reference has the target.

        Readings are validated, imputed and scaled with the saved parameters (no
        outlier filter: a reading is scored, however unusual), put on the grid,
        shifted by the saved lag and given the same features.  The reference is
        needed only if the model has features of it.  Series that the run did
        not see have no parameters or coefficients and no rows in the result.
        Grids whose step does not divide a day start at the new readings' own
        first day, as in a run."""
        cfg, keys = merged_config(self.about["config"]), self.keys
        ts, target = str(cfg["data"]["timestamp_column"]), str(cfg["data"]["target_column"])
        prefixes = {"reference": str(cfg["data"].get("reference_prefix", "reference")),
                    "sensor": str(cfg["data"].get("sensor_prefix", "sensor"))}
        rule = str(cfg["alignment"]["resample_rule"])
        tblock = time_block_for(parse_rule(rule).width_us, block_rows)
        ref_target = f"{prefixes['reference']}_{target}"
        spark = SparkSession.active()
        sources = {"sensor": sensor} if reference is None else {"reference": reference, "sensor": sensor}
        grids = {}
        for side, source in sources.items():
            raw = validate_series(scan_frame(source, spark, ts, schema=cfg["data"].get("csv_schema"),
                                             options=cfg["data"].get("csv_options")), ts, keys, side.capitalize(),
                                  fmt=cfg["data"].get("timestamp_format"))
            wanted = [*self.artifacts[side].numeric_columns, *([target] if side == "reference" and target in raw.columns else [])]
            missing = [c for c in wanted if c not in raw.columns]
            if missing:
                raise ValueError(f"the new {side} readings have no column {missing}")
            raw = self._seen(raw, side).select(*keys, ts, *wanted)
            grid = resample_timeseries(self.artifacts[side].transform(raw), ts, rule, str(cfg["alignment"]["aggregation"]), keys)
            if side == "sensor":
                max_lag = int(cfg["alignment"]["max_lag_steps"]) if keys else None
                grid = apply_lag(grid, ts, self.lags, keys, max_lag, block_rows, tblock)
            grids[side] = prefix_columns(grid, prefixes[side], ts, keys)
        merged = grids["sensor"]
        if reference is not None:
            merged = keyed_join(grids["reference"], merged, keys, [ts])
        merged = merged.dropna(how="any", subset=[c for c in merged.columns if c not in (*keys, ref_target)])
        rows = engineer_features(merged.drop(ref_target), ts, ref_target, cfg["feature_engineering"], keys, block_rows, tblock)
        lost = [c for c in self.about["features"] if c not in rows.columns]
        if lost:
            raise ValueError(f"features {lost} need the reference's readings")
        features = self.about["features"]
        if self.about["per_key"]:
            coefficients = spark.read.parquet(f"{self.path}/coefficients")
            out = scored_per_key(rows, coefficients, features, ts, keys)
        else:
            out = load_model(f"{self.path}/model").transform(rows).select(
                *keys, ts, F.col("prediction").cast("double").alias("calibrated_prediction"))
        if ref_target not in merged.columns:
            return out
        return keyed_join(out, merged.select(*keys, ts, F.col(ref_target).alias("reference_value")), keys, [ts])

    def _seen(self, raw: DataFrame, side: str) -> DataFrame:
        """Rows of series that have parameters."""
        art = self.artifacts[side]
        known = art.imputer or art.scaler
        if not self.keys or known is None:
            return raw
        return attach(raw, known.table.select(*self.keys), self.keys, [], "left_semi", rows=known.rows)


def load_calibration(store: str, version: str | None = None) -> StoredCalibration:
    """The newest finished version, or the one named."""
    spark = SparkSession.active()
    found = versions(spark, store)
    if not found or (version is not None and version not in found):
        raise ValueError(f"{store} has no finished version" + (f" {version}" if version else ""))
    at = f"{store}/{version or found[-1]}"
    about = json.loads(spark.read.text(f"{at}/manifest").first()["value"])
    keys = about["keys"]
    artifacts = {}
    for side, a in about["sides"].items():
        parts = {p: Params(spark.read.parquet(f"{at}/{side}-{p}"), keys) for p in a["parts"]}
        artifacts[side] = PreprocessingArtifacts(a["columns"], keys, a["strategy"], parts.get("imputer"),
                                                 parts.get("scaler"), a["normalization"])
    lags = spark.read.parquet(f"{at}/lags") if keys else int(about["lag_steps"])
    return StoredCalibration(at, about, artifacts, lags)
