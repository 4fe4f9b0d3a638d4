"""Adapters from relational fact tables to event streams, and the derived report inputs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import micros
from ..operators import grid
from ..operators.order import assign_event_index
from ..operators.scorers import label_oracle, seeded_random
from ..schema import RETENTION_PCT, SEED, Method
from ..session import ship_package
from ..staging import stage


@dataclass(frozen=True)
class Corpus:
    """One data set: how it is sliced, its sensor, and its filters."""

    name: str
    slice_size: int
    block: int
    width: int = 64
    height: int = 48
    native: tuple[str, ...] = ("fa", "fb", "fc")


EVENT_STREAM = Corpus("ev", 150, 64)
WIDE_STREAM = Corpus("li", 600, 256)
CORPORA = (EVENT_STREAM, WIDE_STREAM)

METHODS = [
    Method("raw", is_null=True, has_native=True),
    Method("random_null", is_null=True),
    Method("label_oracle", is_oracle=True, has_native=True),
    Method("fa", has_native=True),
    Method("fb", has_native=True),
    Method("fc", has_native=True),
    Method("sc"),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as unordered event-stream rows with its native masks."""
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        kind.alias("recording_id"), F.col("event_id").alias("source_idx"),
        micros("ts").alias("t_us"),
        (F.col("user_id") % 64).cast("int").alias("x"),
        ((F.col("event_id") * 7) % 48).cast("int").alias("y"),
        (F.col("event_id") % 2).cast("int").alias("p"),
        F.when(F.col("value") > 20, 1).otherwise(0).alias("label"),
        (F.col("value") < 15).alias("fa"),
        (F.get_json_object("props", "$.k").cast("int") < 50).alias("fb"),
        (F.col("user_id") % 3 == 0).alias("fc"),
        F.col("value").alias("sc"),
        F.when(kind.isin("click", "view"), "ui").when(kind == "error", "sys")
        .otherwise("biz").alias("scene"))


WIDE_ORDER = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
              "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``lineitem`` table as unordered event-stream rows, keeping its full order key."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("recording_id"), *WIDE_ORDER,
        micros("l_shipdate").alias("t_us"),
        (F.col("l_partkey") % 64).cast("int").alias("x"),
        (F.col("l_suppkey") % 48).cast("int").alias("y"),
        (F.col("l_linenumber") % 2).cast("int").alias("p"),
        F.when(F.col("l_discount") >= 0.05, 1).otherwise(0).alias("label"),
        (F.col("l_quantity") <= 25).alias("fa"),
        (F.col("l_tax") < 0.03).alias("fb"),
        (F.col("l_linenumber") <= 3).alias("fc"),
        F.col("l_extendedprice").alias("sc"),
        F.col("l_returnflag").alias("scene"))


STREAM = ["recording_id", "event_idx", "t_us", "x", "y", "p", "label", "fa", "fb", "fc", "sc",
          "scene"]


def scores(algorithm: str = "md5", seed: int = SEED) -> dict[str, Column | None]:
    """The registered method set over the stream columns."""
    return {
        "raw": None,
        "random_null": seeded_random(seed, algorithm),
        "label_oracle": label_oracle(),
        **{m: F.when(F.col(m), 0.0).otherwise(1.0) for m in ("fa", "fb", "fc")},
        "sc": F.col("sc"),
    }


@dataclass
class Workspace:
    """Tables derived from one data folder, each written once per session and then shared."""

    spark: SparkSession
    sf_dir: str
    _made: dict[str, DataFrame] = field(default_factory=dict)

    def once(self, name: str, build) -> DataFrame:
        if name not in self._made:
            self._made[name] = stage(build(), name)
        return self._made[name]

    def stream(self, corpus: Corpus) -> DataFrame:
        """Indexed stream of one corpus; the index is assigned once and stored."""
        if corpus.name == "ev":
            build = lambda: assign_event_index(
                event_rows(self.spark, self.sf_dir), ["recording_id"], ["t_us", "source_idx"],
                "ev-order").select(*STREAM, "source_idx")
        else:
            build = lambda: assign_event_index(
                wide_rows(self.spark, self.sf_dir), ["recording_id"], WIDE_ORDER,
                "li-order").select(*STREAM)
        return self.once(f"stream-{corpus.name}", build)

    def both(self) -> DataFrame:
        return self.stream(EVENT_STREAM).select(F.lit("ev").alias("dataset"), *STREAM).unionByName(
            self.stream(WIDE_STREAM).select(F.lit("li").alias("dataset"), *STREAM))

    def recordings(self) -> DataFrame:
        """One row per recording: sensor, scene, origin and size."""
        return self.once("recordings", lambda: self.both().groupBy(
            "dataset", "recording_id", "scene").agg(F.count("*").alias("n_events")).withColumns({
                "width": F.lit(64), "height": F.lit(48),
                "synthetic": F.col("recording_id").isin("click", "view", "NO", "AO")}))

    def curve(self) -> DataFrame:
        """The benchmark grid: every recording, method and retention of both corpora."""
        def build():
            parts = [grid.curve(self.stream(c), scores(), c.slice_size, c.block, RETENTION_PCT)
                     .withColumn("dataset", F.lit(c.name)) for c in CORPORA]
            scenes = self.recordings().select("dataset", "recording_id", "scene")
            return parts[0].unionByName(parts[1]).drop("last_scored").join(scenes, ["dataset", "recording_id"])
        return self.once("curve", build)

    def native(self) -> DataFrame:
        """Native retention of every two-level method; NULL for the rest."""
        def build():
            kept = self.both().groupBy("dataset", "recording_id").agg(
                F.lit(1.0).alias("raw"), F.avg(1.0 - F.col("label")).alias("label_oracle"),
                *[F.avg(F.col(m).cast("double")).alias(m) for m in ("fa", "fb", "fc")])
            cells = F.array(*[F.struct(F.lit(m).alias("method"),
                                       F.col(m).alias("native_retention"))
                              for m in ("raw", "label_oracle", "fa", "fb", "fc")])
            return kept.select("dataset", "recording_id", F.inline(cells))
        return self.once("native", build)


_WORKSPACES: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    ship_package(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WORKSPACES:
        _WORKSPACES[key] = Workspace(spark, sf_dir)
    return _WORKSPACES[key]
