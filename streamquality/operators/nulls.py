"""Analyses of label-blind controls: fixed-retention gain, draws, matched spans, shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import blind, lowest_terms
from ..staging import attach
from . import grid
from .order import frame_length, shuffle_marks
from .scorers import seeded_random

KEY = "recording_id"


def deltas(curve: DataFrame) -> DataFrame:
    """Evaluable points of a curve with Delta-over-Raw."""
    return curve.where("evaluable").withColumn("delta", F.col("mesr") - F.col("raw_mesr"))


def retention_profile(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per retention: mean, median, n and recordings above the unfiltered stream."""
    return points.groupBy(*keys, "r_pct").agg(
        F.avg("delta").alias("mean"), F.percentile("delta", F.lit(0.5)).alias("median"),
        F.count("*").alias("n"), F.count_if(F.col("delta") > 1e-12).alias("n_above_raw"))


def fixed_gain(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Best retention below 1 on the mean curve, and how many means are positive."""
    below = profile.where("r_pct < 100")
    best = F.max_by(F.struct("r_pct", "mean"), F.struct(blind("mean"), -F.col("r_pct")))
    return below.groupBy(*keys).agg(
        best.alias("_b"), F.count_if(blind("mean") > 0).alias("n_positive"),
        F.count("*").alias("n_below_one")).select(
        *keys, F.col("_b.r_pct").alias("best_r_pct"), F.col("_b.mean").alias("best_mean"),
        "n_positive", "n_below_one", (F.col("n_positive") > 0).alias("raises_mesr"))


def max_selected(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of each recording's own maximum: bounded below by the zero at r = 1."""
    per = points.groupBy(*keys, KEY).agg(F.max_by(
        F.struct("r_pct", "delta"), F.struct(blind("delta"), -F.col("r_pct"))).alias("_b"))
    return per.groupBy(*keys).agg(
        F.avg("_b.delta").alias("mean"), F.count("*").alias("n"),
        F.avg((F.col("_b.r_pct") == 100).cast("double")).alias("share_argmax_at_r1"))


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, range over draws."""
    sd = F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(0.0)
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        (F.max(value) - F.min(value)).alias("range"))


def draw_sensitivity(seed_profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Across-draw spread of the mean at each retention below 1, and draws above zero."""
    below = seed_profiles.where("r_pct < 100")
    counts = below.groupBy(*keys, "r_pct").agg(F.count_if(blind("mean") > 0).alias("seeds_positive"))
    return spread(below, [*keys, "r_pct"], "mean").join(counts, [*keys, "r_pct"])


def positive_counts(seed_profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Per draw: retentions below 1 with a positive mean."""
    return seed_profiles.where("r_pct < 100").groupBy(*keys, "seed").agg(
        F.count_if(blind("mean") > 0).alias("n_positive"), F.count("*").alias("n_below_one"))


def blank_lead(filters: DataFrame, controls: DataFrame, keys: list[str]) -> DataFrame:
    """Per draw, the filter with the largest paired mean lead over that draw's control.

    ``filters`` holds (keys, recording, method, delta); ``controls`` the same with ``seed``.
    """
    c = controls.select(*keys, KEY, "seed", F.col("delta").alias("control"))
    leads = filters.join(c, [*keys, KEY]).groupBy(*keys, "seed", "method").agg(
        F.avg(F.col("delta") - F.col("control")).alias("lead"), F.count("*").alias("n"))
    best = F.min_by(F.struct("method", "lead", "n"), F.struct(-blind("lead"), "method"))
    return leads.groupBy(*keys, "seed").agg(best.alias("_b")).select(
        *keys, "seed", F.col("_b.method").alias("best_filter"), F.col("_b.lead").alias("lead"),
        F.col("_b.n").alias("n"))


def seeds_as_methods(seeds: list[int], algorithm: str = "xxhash64",
                     key: str = KEY) -> dict[str, Column]:
    """One scorer per draw, so all draws share a pass over the stream."""
    return {f"s{seed}": seeded_random(seed, algorithm, key) for seed in seeds}


def seed_curves(events: DataFrame, seeds: list[int], slice_size: int, block: int,
                pcts: list[int], algorithm: str = "xxhash64") -> DataFrame:
    out = grid.curve(events, seeds_as_methods(seeds, algorithm), slice_size, block, pcts)
    return out.withColumn("seed", F.substring("method", 2, 20).cast("int")).drop("method")


def matched_span(events: DataFrame, seeds: list[int], slice_size: int, block: int,
                 pcts: list[int], algorithm: str = "xxhash64") -> DataFrame:
    """Original and matched-frame Delta of the random control, per recording, draw, retention.

    The frame depends on a retention only through its denominator, so retentions are grouped
    by denominator and each group is one grid pass over the framed streams.
    """
    below = [p for p in pcts if p < 100]
    sizes = events.groupBy(KEY).agg(F.count("*").alias("_n"))
    framed = None
    for v in sorted({lowest_terms(p)[1] for p in below}):
        mine = [p for p in below if lowest_terms(p)[1] == v]
        bounds = sizes.select(KEY, frame_length(F.col("_n"), mine[0], slice_size).alias("_frame"))
        cut = attach(events, bounds, [KEY], name="frames").where(
            F.col("event_idx") < F.col("_frame")).drop("_frame")
        part = seed_curves(cut, seeds, slice_size, block, mine, algorithm)
        framed = part if framed is None else framed.unionByName(part)
    original = seed_curves(events, seeds, slice_size, block, below, algorithm)
    keys = [KEY, "seed", "r_pct"]
    matched = framed.select(*keys, (F.col("mesr") - F.col("raw_mesr")).alias("delta_matched"))
    frames = F.create_map(*[x for p in below for x in (
        F.lit(p), frame_length(F.col("n_events"), p, slice_size))])
    return original.select(
        *keys, frames[F.col("r_pct")].alias("frame"),
        (frames[F.col("r_pct")] / F.col("n_events")).alias("frame_share"),
        (F.col("mesr") - F.col("raw_mesr")).alias("delta_original"),
        ((F.col("last_scored") + 1) / F.col("n_events")).alias("span_thinned"),
        (slice_size * F.floor(F.col("n_events") / slice_size) / F.col("n_events"))
        .alias("span_unfiltered")).join(matched, keys, "left")


def matched_span_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per draw and retention, both Deltas on the recordings that hold a frame there."""
    on = F.col("delta_matched").isNotNull()

    def of(column: str) -> Column:
        return F.when(on, F.col(column))

    median = lambda c: F.percentile(of(c), F.lit(0.5))
    mean_o, mean_m = F.avg(of("delta_original")), F.avg("delta_matched")
    return rows.groupBy(*keys, "seed", "r_pct").agg(
        F.count_if(on).alias("n"), F.count("delta_original").alias("n_original"),
        F.avg("delta_original").alias("mean_original_all"), mean_o.alias("mean_original"),
        median("delta_original").alias("median_original"),
        F.count_if(of("delta_original") > 0).alias("positive_original"),
        mean_m.alias("mean_matched"), median("delta_matched").alias("median_matched"),
        F.count_if(F.col("delta_matched") > 0).alias("positive_matched"),
        median("frame_share").alias("frame_share_median"),
        median("span_thinned").alias("span_thinned_median"),
        median("span_unfiltered").alias("span_unfiltered_median"),
        (F.signum(mean_m) == F.signum(mean_o)).alias("same_sign"))


def across_draws(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Range of the matched mean over draws and how many draws keep each sign."""
    return summary.where("n > 0").groupBy(*keys, "r_pct").agg(
        F.min("mean_matched").alias("matched_mean_min"),
        F.max("mean_matched").alias("matched_mean_max"),
        F.count_if(F.col("mean_matched") > 0).alias("seeds_positive"),
        F.count_if(F.col("mean_matched") < 0).alias("seeds_negative"),
        F.count_if("same_sign").alias("seeds_same_sign"), F.count("*").alias("seeds"))


def span_verdict(across: DataFrame, keys: list[str]) -> DataFrame:
    """Retentions positive, negative, or of unchanged sign under every draw."""
    every = F.col("seeds")
    return across.groupBy(*keys).agg(
        F.count_if(F.col("seeds_positive") == every).alias("positive_every_seed"),
        F.count_if(F.col("seeds_negative") == every).alias("negative_every_seed"),
        F.count_if(F.col("seeds_same_sign") == every).alias("same_sign_every_seed"))


def shuffled_curves(events: DataFrame, windows: list[int | None], seeds: list[int],
                    null_seed: int, slice_size: int, block: int, pcts: list[int],
                    algorithm: str = "xxhash64") -> DataFrame:
    """Curves of both controls on mark-shuffled streams, per (window, seed).

    ``window`` 0 is the stream as recorded, -1 the whole stream; the controls' priorities
    belong to the recording, not to the shuffle.
    """
    base = events.select(KEY, "event_idx", "x", "y", "label")
    streams = None
    for window in windows:
        for seed in seeds[:1] if window == 0 else seeds:
            moved = shuffle_marks(base, window, seed, ["x", "y"], algorithm=algorithm)
            tag = -1 if window is None else window
            part = moved.select(
                F.col(KEY).alias("source"), F.concat_ws("|", KEY, F.lit(tag), F.lit(seed)).alias(KEY),
                "event_idx", F.col("x_shuffled").alias("x"), F.col("y_shuffled").alias("y"), "label")
            streams = part if streams is None else streams.unionByName(part)
    scores = {"raw": None, "random_null": seeded_random(null_seed, algorithm, "source")}
    out = grid.curve(streams, scores, slice_size, block, pcts)
    bits = F.split(KEY, r"\|")
    return out.withColumns({"window": F.get(bits, F.lit(1)).cast("int"),
                            "seed": F.get(bits, F.lit(2)).cast("int"), KEY: F.get(bits, F.lit(0))})


def shuffle_summary(points: DataFrame, keys: list[str], reference_pct: int) -> DataFrame:
    """Per (window, control, draw): positive means, largest positive, mean at the reference."""
    means = points.where("r_pct < 100").groupBy(*keys, "window", "method", "seed", "r_pct").agg(
        F.avg("delta").alias("mean"))
    return means.groupBy(*keys, "window", "method", "seed").agg(
        F.count("*").alias("evaluable"), F.count_if(F.col("mean") > 0).alias("positive"),
        F.max(F.when(F.col("mean") > 0, F.col("mean"))).alias("largest_positive"),
        F.max(F.when(F.col("r_pct") == reference_pct, F.col("mean"))).alias("at_reference"))


def shuffle_profile(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per window and retention: mean over draws and the largest absolute mean."""
    means = points.where("r_pct < 100").groupBy(*keys, "window", "method", "seed", "r_pct").agg(
        F.avg("delta").alias("mean"))
    return means.groupBy(*keys, "window", "method", "r_pct").agg(
        F.avg("mean").alias("mean"), F.max(F.abs("mean")).alias("largest_abs"))


def check_unshuffled(shuffled: DataFrame, benchmark: DataFrame, keys: list[str],
                     tolerance: float = 1e-12) -> DataFrame:
    """Window-0 cells against the benchmark's: cells compared and cells that differ."""
    a = shuffled.where("window = 0").select(*keys, F.col("mesr").alias("a"))
    b = benchmark.select(*keys, F.col("mesr").alias("b"))
    pair = a.join(b, keys, "full")
    same = F.when(F.col("a").isNull() | F.col("b").isNull(), F.col("a").eqNullSafe(F.col("b"))
                  ).otherwise(F.abs(F.col("a") - F.col("b")) <= tolerance)
    return pair.groupBy("method").agg(F.count("*").alias("cells"), F.count_if(~same).alias("differ"))


def before_after(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Both Deltas on the recordings evaluable before and after, per key and retention."""
    on = [*keys, KEY, "method", "r_pct"]
    return before.select(*on, F.col("delta").alias("before")).join(
        after.select(*on, F.col("delta").alias("after")), on)


def specificity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys, "method", "r_pct").agg(
        F.count("*").alias("n"), F.avg("before").alias("before"), F.avg("after").alias("after"),
        F.count_if(F.col("after") - F.col("before") < -1e-12).alias("n_drop"))


def specificity_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.where("r_pct < 100").groupBy(*keys, "method").agg(
        F.count_if(blind("before") > 0).alias("n_positive_before"),
        F.count_if(blind("after") > 0).alias("n_positive_after"),
        F.count("*").alias("n_retentions"))


def blank_margins(before: DataFrame, after: DataFrame, methods: list[str], null: str,
                  keys: list[str]) -> DataFrame:
    """Each method's margin over the null on the recordings where every cell is present."""
    runs = before.withColumn("run", F.lit("before")).unionByName(after.withColumn("run", F.lit("after")))
    runs = runs.where(F.col("method").isin(methods))
    on = [*keys, "r_pct", KEY]
    cohort = runs.groupBy(*on).agg(F.count_distinct("run", "method").alias("_c")).where(
        F.col("_c") == 2 * len(methods)).select(*on)
    kept = runs.join(cohort, on)
    base = kept.where(F.col("method") == null).select(*on, "run", F.col("delta").alias("null_delta"))
    diff = F.col("delta") - F.col("null_delta")
    return kept.join(base, [*on, "run"]).groupBy(*keys, "r_pct", "run", "method").agg(
        F.count("*").alias("n"), F.avg("delta").alias("delta"), F.avg(diff).alias("minus_null"),
        F.count_if(blind(diff) > 0).alias("n_above_null"))


def best_margin(margins: DataFrame, keys: list[str], exclude: list[str]) -> DataFrame:
    return margins.where(~F.col("method").isin(exclude)).groupBy(*keys, "r_pct", "run").agg(
        F.min_by("method", F.struct(-blind("minus_null"), "method")).alias("best"), F.max("minus_null").alias("minus_null"))


def level_lead(points: DataFrame, method: str, null: str, keys: list[str]) -> DataFrame:
    """Recording by recording lead of one method over a control: count above, range."""
    a = points.where(F.col("method") == method).select(*keys, KEY, F.col("mesr").alias("a"))
    b = points.where(F.col("method") == null).select(*keys, KEY, F.col("mesr").alias("b"))
    lead = F.col("a") - F.col("b")
    return a.join(b, [*keys, KEY]).groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(blind(lead) > 0).alias("n_positive"),
        F.avg(lead).alias("mean"), F.min(lead).alias("min"), F.max(lead).alias("max"))


def monotone_fall(points: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Does ``value`` fall at every step of ``order``? Groups hold one row per injected rate."""
    prev = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    steps = points.withColumn("_fall", F.col(value) < prev)
    return steps.groupBy(*keys).agg(
        F.count("*").alias("points"), F.max_by(value, F.col(order)).alias("last"),
        F.min_by(value, F.col(order)).alias("first"), F.bool_and("_fall").alias("monotone_falling"))
