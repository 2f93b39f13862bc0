import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-riskloom-tests-")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """60 dates x 4 assets of simple returns, and the same as a matrix."""
    import datetime as dt

    import numpy as np

    rng = np.random.default_rng(5)
    m = rng.normal(0.001, 0.02, size=(60, 4))
    start = dt.date(2020, 1, 1)
    rows = [(f"X{a}", start + dt.timedelta(days=7 * t), float(m[t, a])) for t in range(60) for a in range(4)]
    return spark.createDataFrame(rows, "asset string, date date, r double"), m
