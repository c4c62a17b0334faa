import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


# Rerun the suite in another zone or with ANSI off:
#   TRUELINE_TEST_TZ=America/New_York TRUELINE_TEST_ANSI=false pytest tests/
TEST_TZ = os.environ.get("TRUELINE_TEST_TZ", "UTC")
TEST_ANSI = os.environ.get("TRUELINE_TEST_ANSI", "true")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("trueline-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", TEST_TZ)
         .config("spark.sql.ansi.enabled", TEST_ANSI)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
