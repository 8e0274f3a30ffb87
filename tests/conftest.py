import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
    s = builder.config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='tidemark-test-')}").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
