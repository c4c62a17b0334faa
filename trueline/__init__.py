"""trueline — sensor calibration against reference measurements on Spark."""

from .config import DEFAULT_CONFIG, LINEAR_FAMILY, default_config, merged_config
from .session import build_session, checkpoint_dir, local_session

__all__ = ["DEFAULT_CONFIG", "LINEAR_FAMILY", "default_config", "merged_config", "build_session",
           "checkpoint_dir", "local_session"]
