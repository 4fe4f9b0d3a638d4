"""Incremental result sink: new recordings are scored as their files arrive.

The file stream's checkpoint remembers which event files were read, and recordings whose
results are stored already are left out, so a stopped run resumes where it was. A recording must
come whole: if more of it arrives in a file that its stored result did not see, the run fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import EVENTS
from ..sources.artifacts import pending


def append_results(spark: SparkSession, source: str, target: str, checkpoint: str, dataset: str,
                   score: Callable[[DataFrame], DataFrame]) -> None:
    """Score every unread file of whole recordings under ``source`` and append to ``target``."""

    def run(batch: DataFrame, _epoch: int) -> None:
        files = batch.groupBy("recording_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("_file"))).alias("files"))
        tagged = batch.drop("_file").withColumn("dataset", F.lit(dataset))
        try:
            stored = spark.read.parquet(target)
            done = stored.select("dataset", "recording_id")
            seen = stored.where(F.col("dataset") == dataset).select("recording_id", F.col("files").alias("seen")).distinct()
            later = files.join(seen, "recording_id").where("files <> seen").limit(1).collect()
            if later:
                raise ValueError(f"recording {later[0]['recording_id']} was scored without {later[0]['files']}")
        except Exception as error:  # the first batch finds no target
            if "PATH_NOT_FOUND" not in str(error):
                raise
            done = tagged.select("dataset", "recording_id").limit(0)
        fresh = pending(tagged, done)
        score(fresh.drop("dataset")).join(files, "recording_id").withColumn("dataset", F.lit(dataset)).write.mode(
            "append").partitionBy("dataset").parquet(target)

    stream = spark.readStream.schema(EVENTS).parquet(source).withColumn("_file", F.col("_metadata.file_path"))
    query = (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
