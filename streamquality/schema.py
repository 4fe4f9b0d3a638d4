"""Schemas, defaults and the method dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

# The metric's published defaults.
SLICE = 30_000
BLOCK = 10_240
SEED = 20260726
RETENTION_PCT = [5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 95, 100]
NATIVE_GRID_STEP = 0.05
NATIVE_REL_TOL = 0.5
HOT_PERCENTILE = 99.9
REGIME_WINDOW_US = 1_000
REGIME_MIN_EVENTS = 8
TAIL_SENTINEL = 2.0
KEEP_THRESHOLD = 0.005

EVENTS = T.StructType([
    T.StructField("recording_id", T.StringType(), False),
    T.StructField("event_idx", T.LongType(), False),
    T.StructField("t_us", T.LongType(), False),
    T.StructField("x", T.IntegerType(), False),
    T.StructField("y", T.IntegerType(), False),
    T.StructField("p", T.IntegerType(), False),
    T.StructField("label", T.IntegerType(), True),
])

METHODS = T.StructType([
    T.StructField("method", T.StringType(), False),
    T.StructField("is_oracle", T.BooleanType(), False),
    T.StructField("is_null", T.BooleanType(), False),
    T.StructField("has_native", T.BooleanType(), False),
])


@dataclass(frozen=True)
class Method:
    """One scorer. ``has_native`` marks two-level scores, which carry their own keep mask."""

    name: str
    is_oracle: bool = False
    is_null: bool = False
    has_native: bool = False


def method_table(spark: SparkSession, methods: list[Method]) -> DataFrame:
    """The method dimension; a handful of rows fixed by the job's configuration."""
    rows = [(m.name, m.is_oracle, m.is_null, m.has_native) for m in methods]
    return spark.createDataFrame(rows, METHODS)
