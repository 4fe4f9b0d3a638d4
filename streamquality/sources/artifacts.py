"""Nested result artifacts: reading, writing, resuming, publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

KEY = "recording_id"

POINT = T.StructType([
    T.StructField("r_pct", T.IntegerType()), T.StructField("mesr", T.DoubleType()),
    T.StructField("kept_events", T.LongType()), T.StructField("evaluable", T.BooleanType())])
ROW = T.StructType([
    T.StructField("raw_mesr", T.DoubleType()), T.StructField("error", T.StringType()),
    T.StructField("curve", T.ArrayType(POINT))])
RECORD = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField(KEY, T.StringType()),
    T.StructField("methods", T.MapType(T.StringType(), ROW))])


def nest_curve(curve: DataFrame) -> DataFrame:
    """One record per recording: methods, each with its curve in retention order.

    A record holds methods x retentions points, a number fixed by the grid.
    """
    point = F.struct(*[f.name for f in POINT])
    rows = curve.groupBy("dataset", KEY, "method").agg(
        F.max("raw_mesr").alias("raw_mesr"),
        F.when(F.count_if("evaluable") == 0, F.lit("no evaluable retention")).alias("error"),
        F.array_sort(F.collect_list(point)).alias("curve"))
    return rows.groupBy("dataset", KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "method", F.struct("raw_mesr", "error", "curve"))))).alias("methods"))


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").partitionBy("dataset").json(path)


def read_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(RECORD).option("multiLine", multi_line).json(path)


def flatten_records(records: DataFrame) -> DataFrame:
    """Records back to the curve table, without the cells that ended in an error."""
    cells = records.select("dataset", KEY, F.explode("methods").alias("method", "row")).where(
        F.col("row.error").isNull())
    return cells.select("dataset", KEY, "method", F.col("row.raw_mesr").alias("raw_mesr"),
                        F.inline("row.curve"))


def pending(recordings: DataFrame, done: DataFrame) -> DataFrame:
    """Recordings whose results are not stored yet."""
    return recordings.join(done.select("dataset", KEY).distinct(), ["dataset", KEY], "left_anti")


def publish(df: DataFrame, path: str) -> None:
    """All or nothing: written beside the target; the old result is renamed aside, the new one
    renamed in and the old one deleted, or put back if that fails."""
    spark = df.sparkSession
    partial = f"{path.rstrip('/')}.partial-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(partial)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(partial), hadoop.Path(path)
    system = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = hadoop.Path(partial.replace(".partial-", ".old-"))
    replaced = system.exists(target)
    if replaced and not system.rename(target, old):
        raise RuntimeError(f"could not put {path} aside")
    try:
        done = system.rename(source, target)
    except Exception:
        done = False
    if not done:
        if replaced:
            system.rename(old, target)
        raise RuntimeError(f"could not publish {path}")
    if replaced:
        system.delete(old, True)
