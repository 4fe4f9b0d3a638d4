from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[*]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def stream(spark):
    """Seeded random recordings of uneven length, as (frame, pandas)."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(3)
    parts = []
    for name, n in (("a", 5003), ("b", 1201), ("c", 37)):
        hot = rng.random(n) < 0.2
        parts.append(pd.DataFrame({
            "recording_id": name, "event_idx": np.arange(n), "t_us": np.sort(rng.integers(0, 10**6, n)),
            "x": np.where(hot, 3, rng.integers(0, 20, n)), "y": np.where(hot, 4, rng.integers(0, 15, n)),
            "p": rng.integers(0, 2, n), "label": rng.integers(0, 2, n), "score": rng.integers(0, 50, n) / 10.0,
            "keep": rng.random(n) < 0.4}))
    pdf = pd.concat(parts, ignore_index=True)
    frame = spark.createDataFrame(pdf)
    for c in ("x", "y", "p", "label"):
        frame = frame.withColumn(c, frame[c].cast("int"))
    return frame.repartition(5).cache(), pdf
