"""Scans of event corpora into the event schema, and checks on imported scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.hashing import word
from ..operators.order import assign_event_index, scene_of
from ..schema import KEEP_THRESHOLD, TAIL_SENTINEL
from ..staging import attach

KEY = "recording_id"


def parse_whitespace(lines: DataFrame, value: str = "value") -> DataFrame:
    """Whitespace rows ``t x y p [label]`` as typed columns.

    Blank rows and headers (whose first field begins with a letter or ``#``) go; any other row
    that is not made of integers fails the job. A missing fifth column leaves the label NULL.
    """
    parts = F.split(F.trim(F.col(value)), r"\s+")
    whole = F.col(value).rlike(r"^\s*-?[0-9]+(\s+-?[0-9]+){3,}\s*$")
    checked = F.when(whole, parts).otherwise(F.raise_error(F.concat(F.lit("not an event row: "), value)))
    typed = lines.where(~F.col(value).rlike(r"^\s*([A-Za-z#].*)?$")).withColumn("_p", checked)
    number = lambda i, t: F.get("_p", F.lit(i)).cast(t)
    return typed.select("*", number(0, "bigint").alias("t_us"), number(1, "int").alias("x"),
                        number(2, "int").alias("y"), number(3, "int").alias("p"),
                        number(4, "int").alias("label")).drop("_p", value)


def read_whitespace(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Text files of events; the source order is (file, line position in the file's splits)."""
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"),
                                        F.col("_metadata.file_block_start").alias("_block"))
    rows = raw.withColumn("source_idx", F.struct("_block", F.monotonically_increasing_id()))
    return parse_whitespace(rows).drop("_block")


def normalise_seconds(rows: DataFrame, seconds: str, polarity: str, *source: str) -> DataFrame:
    """Seconds since the first row **in file order** to whole microseconds, half-even; p >= 0.5.

    Rows of an equal place in ``source`` come in the order of the columns named after it.
    """
    first = rows.groupBy(KEY).agg(F.min_by(seconds, F.struct(*source)).alias("_s0"))
    return attach(rows, first, [KEY], name="first").withColumns({
        "t_us": F.rint((F.col(seconds) - F.col("_s0")) * 1e6).cast("bigint"),
        "p": (F.col(polarity) >= 0.5).cast("int")}).drop("_s0")


def repair_time_order(rows: DataFrame, source: str = "source_idx", name: str = "repaired") -> DataFrame:
    """Index rows by time, keeping source order inside equal times."""
    return assign_event_index(rows, [KEY], ["t_us", source], name)


def rate_scene(path: Column) -> dict[str, Column]:
    """``<rate>hz_<scene>`` in a file name."""
    return {"rate": F.regexp_extract(path, r"([0-9]+)hz_([^/.]+)", 1).cast("int"),
            "scene": F.regexp_extract(path, r"([0-9]+)hz_([^/.]+)", 2)}


def scan_subset(rows: DataFrame, scenes: list[str] | None, levels: list | None) -> DataFrame:
    """Two-axis subset of a corpus partitioned by scene and level: plain filters, so they prune."""
    if scenes is not None:
        rows = rows.where(F.col("scene").isin(scenes))
    if levels is not None:
        rows = rows.where(F.col("level").isin(levels))
    return rows


def with_scene_stride(recordings: DataFrame, part: str, scene: str, stride: int) -> DataFrame:
    """Every ``stride``-th scene of each part, with all its levels and repetitions.

    Scenes are numbered on the distinct list; recordings never enter the window.
    """
    scenes = recordings.select(part, scene).distinct()
    number = F.row_number().over(W.partitionBy(part).orderBy(scene)) - 1
    kept = scenes.withColumn("_i", number).where(F.col("_i") % stride == 0).select(part, scene)
    return attach(recordings, kept, [part, scene], "left_semi", "scenes")


def all_noise(rows: DataFrame, path: str) -> DataFrame:
    """A blank corpus: every event is noise; the level is the file name up to the first dash."""
    stem = F.regexp_extract(path, r"([^/]+)$", 1)
    return rows.withColumns({"label": F.lit(1), "level": F.split_part(stem, F.lit("-"), F.lit(1))})


def drop_sessions(files: DataFrame, path: str) -> DataFrame:
    """Recordings without calibration clips, with capture session and drop tag from the path."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[a-z0-9]+)?$", 1)
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    tag = F.get(F.split(stem, "_", 3), F.lit(1))
    return files.where(~F.col(path).contains("calibration")).withColumns({
        "session": F.when(folder.contains("HDD"), "HDD").otherwise("IV"),
        "drop_tag": F.coalesce(tag, F.lit("staircase"))})


def limit_recordings(events: DataFrame, recordings: DataFrame, limit: int) -> DataFrame:
    """Events of the first ``limit`` recordings in name order: a benchmark's own size option."""
    names = recordings.select("dataset", KEY).distinct().withColumn(
        "_i", F.row_number().over(W.partitionBy("dataset").orderBy(KEY)))
    chosen = names.where(F.col("_i") <= limit).drop("_i")
    return attach(events, chosen, ["dataset", KEY], "left_semi", "chosen")


def import_scores(events: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with imported scores, and per recording the rows without a partner on each side.

    Reading the first fails the job where an event lacks a score or a score its event; the second
    tells how many do.
    """
    on = [KEY, "event_idx"]
    left = events.select(*on, F.lit(1).alias("_e"))
    right = scores.select(*on, F.lit(1).alias("_s"))
    report = left.join(right, on, "full").groupBy(KEY).agg(
        F.count("_e").alias("events"), F.count("_s").alias("scores"),
        F.count_if(F.col("_e").isNull() | F.col("_s").isNull()).alias("unmatched"))
    both = events.withColumn("_e", F.lit(1)).join(scores.withColumn("_s", F.lit(1)), on, "full")
    paired = F.col("_e").isNotNull() & F.col("_s").isNotNull()
    fail = F.raise_error(F.concat(F.lit("no partner for "), KEY, F.lit(" event "), F.col("event_idx").cast("string")))
    # the check is the filter itself, so it can't be optimised away
    return both.where(F.when(paired, True).otherwise(fail.cast("boolean"))).drop("_e", "_s"), report


def score_manifest(scored: DataFrame, algorithm: str = "xxhash64") -> DataFrame:
    """Events, scored, kept and an order-free checksum of every recording's scores."""
    digest = word(F.col(KEY), F.col("event_idx"), F.round(F.col("score") * 1e6).cast("bigint"),
                  algorithm=algorithm)
    return scored.groupBy(KEY).agg(
        F.count("*").alias("events"), F.count_if(F.col("score") != TAIL_SENTINEL).alias("scored"),
        F.count_if(F.col("score") < KEEP_THRESHOLD).alias("kept"), F.bit_xor(digest).alias("checksum"))


def merge_methods(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Append methods to a result table whose old cells stay as they are.

    Fails inside the job when the recordings differ, their unfiltered score or size differ, or
    a method is already present. Both tables hold recording, method, raw_mesr, events, mesr.
    """
    one = lambda df, tag: df.groupBy(KEY).agg(
        F.max("raw_mesr").alias(f"_raw{tag}"), F.max("events").alias(f"_n{tag}"),
        F.collect_set("method").alias(f"_m{tag}"))
    keys = one(existing, "a").join(one(added, "b"), KEY, "full")
    problem = (F.when(F.col("_na").isNull() | F.col("_nb").isNull(), "different recordings")
               .when(~F.col("_rawa").eqNullSafe(F.col("_rawb")) | (F.col("_na") != F.col("_nb")),
                     "inputs differ between runs")
               .when(F.arrays_overlap("_ma", "_mb"), "method already present"))
    checked = keys.select(KEY, F.when(problem.isNotNull(), F.raise_error(
        F.concat(F.col(KEY), F.lit(": "), problem)).cast("int")).otherwise(1).alias("_ok"))
    both = existing.unionByName(added)
    # the check rides on the data as a left join, so it cannot be optimised away or skip rows
    return both.join(checked, KEY, "left").where(F.coalesce("_ok", F.lit(1)) == 1).drop("_ok")


def name_parts(name: str) -> dict[str, Column]:
    """Part, scene, level and repetition of ``corpus/part/Scene-NDxx-rep``."""
    pattern = r"^[^/]+/([^/]+)/(.+)-(ND[0-9]+)-([0-9]+)$"
    return {"part": F.regexp_extract(name, pattern, 1), "level": F.regexp_extract(name, pattern, 3),
            "repetition": F.regexp_extract(name, pattern, 4),
            "scene": scene_of(name, [(pattern, 2)])}
