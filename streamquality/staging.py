"""Written intermediate tables.

A staged table cuts lineage: it is written once to the shared folder named by
``spark.checkpoint.dir`` and read back, so a lost executor re-reads files instead of
recomputing a range partitioning whose boundaries other tasks already used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return root


def attach(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
           name: str = "attached") -> DataFrame:
    """Join a large table with one that has few rows per key, without guessing its size.

    ``small`` is an aggregate, whose size the optimiser cannot know; unplanned, the join would
    shuffle the large side by ``keys`` and a hot key would land in one task. Staged, its size
    is on disk: Spark broadcasts it below ``spark.sql.autoBroadcastJoinThreshold`` and falls
    back to a shuffled join with skew handling above it.
    """
    return df.join(stage(small, name), keys, how)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the staging root and read it back."""
    spark = df.sparkSession
    path = f"{staging_root(spark).rstrip('/')}/streamquality/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
