"""Downstream utility: clips, grids, frames and association of MESR with accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import ranks
from ..functions.numeric import div, kept_total
from ..functions.tails import chi2_sf, normal_cdf, two_sided_t
from .oracle import method_pairs
from .scorers import probit

DAY_US = 86_400_000_000


def condition_name(method: Column, r_pct: Column) -> Column:
    """``<method>_r0.35``; at r = 1 every method is the same input, named ``all``."""
    return F.when(r_pct >= 100, F.lit("all_r1.00")).otherwise(
        F.format_string("%s_r%.2f", method, r_pct / 100.0))


def dedupe_conditions(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of each condition name; a group holds at most one row per method."""
    w = W.partitionBy(*keys, "condition").orderBy(order)
    return rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


# --- clips -----------------------------------------------------------------------------------

def clip_events(events: DataFrame, intervals: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    """Events inside labelled intervals, start included and stop excluded.

    Intervals are repeated over the time buckets they touch and joined on (recording, bucket),
    so no task compares all events of a recording with all its intervals.
    """
    spans = intervals.select("*", F.explode(F.sequence(
        div("start_us", bucket_us), div(F.col("stop_us") - 1, bucket_us))).alias("_b"))
    tagged = events.withColumn("_b", div("t_us", bucket_us))
    inside = (F.col("t_us") >= F.col("start_us")) & (F.col("t_us") < F.col("stop_us"))
    return tagged.join(spans, ["recording_id", "_b"]).where(inside).drop("_b")


def clip_samples(clips: DataFrame, budget: int | None, minimum: int) -> DataFrame:
    """First ``budget`` events of every clip that has at least ``minimum``, time rebased.

    The index inside a clip is the recording's index minus the clip's first index.
    """
    head = clips.groupBy("clip").agg(F.min("event_idx").alias("_i0"), F.min("t_us").alias("_t0"),
                                     F.count("*").alias("clip_events"))
    out = clips.join(head.where(F.col("clip_events") >= minimum), "clip").withColumns({
        "j": F.col("event_idx") - F.col("_i0"), "t_rel": F.col("t_us") - F.col("_t0")})
    out = out.drop("_i0", "_t0")
    return out if budget is None else out.where(F.col("j") < budget).withColumn(
        "clip_events", F.least("clip_events", F.lit(budget)))


def clip_coverage(intervals: DataFrame, kept: DataFrame) -> DataFrame:
    """Clips offered and kept per class, with a total row (class NULL)."""
    marked = intervals.select("clip", "class").join(
        kept.select("clip").distinct().withColumn("_k", F.lit(1)), "clip", "left")
    measures = [F.count("*").alias("offered"), F.count("_k").alias("kept")]
    total = marked.agg(*measures).select(F.lit(None).cast(marked.schema["class"].dataType).alias("class"), "offered", "kept")
    return marked.groupBy("class").agg(*measures).unionByName(total)


def voxel_grid(samples: DataFrame, bins: int = 8) -> DataFrame:
    """Signed counts per (clip, time bin, y, x), sparse."""
    last = samples.groupBy("clip").agg(F.min("t_rel").alias("_a"), F.max("t_rel").alias("_z"))
    span = F.greatest(F.col("_z") - F.col("_a"), F.lit(1))
    b = F.least(div((F.col("t_rel") - F.col("_a")) * bins, span), F.lit(bins - 1))
    return samples.join(last, "clip").withColumn("bin", b.cast("int")).groupBy(
        "clip", "bin", "y", "x").agg(F.sum(F.when(F.col("p") > 0, 1).otherwise(-1)).alias("v"))


def number_frames(samples: DataFrame, bins: int = 16) -> DataFrame:
    """Counts per (clip, frame, p, y, x) with equally many events per frame.

    The last frame takes the remainder; a clip shorter than the frame count is all in it.
    """
    per = div("clip_events", bins)
    frame = F.when(per == 0, F.lit(bins - 1)).otherwise(
        F.least(div(F.col("j"), F.greatest(per, F.lit(1))), F.lit(bins - 1)))
    counts = samples.withColumn("frame", frame.cast("int")).groupBy(
        "clip", "frame", "p", "y", "x").agg(F.count("*").alias("n"))
    return counts.withColumn("n", F.when(F.col("n") > 65535, F.raise_error(
        F.lit("a frame count does not fit sixteen bits")).cast("bigint")).otherwise(F.col("n")))


def scored_share(sizes: DataFrame, n: str, pcts: list[int], block: int,
                 slice_size: int) -> DataFrame:
    """Share of kept events the metric reads, per stream length and retention."""
    cells = F.array(*[F.struct(F.lit(p).alias("r_pct"),
                               kept_total(F.col(n), p / 100.0, block).alias("kept")) for p in pcts])
    scored = div("kept", slice_size) * slice_size
    return sizes.select("*", F.inline(cells)).withColumns(
        {"scored": scored, "scored_share": scored / F.col("kept")})


# --- association of MESR and accuracy ---------------------------------------------------------
# Condition tables hold one row per (method, retention): bounded by the experiment's design.

def cohorts(conditions: DataFrame) -> DataFrame:
    """Conditions under each cohort: all, without r = 1, and r = 1 counted once."""
    first = F.row_number().over(W.partitionBy("dataset", "r_pct").orderBy("method")) == 1
    marked = conditions.where("mesr IS NOT NULL").withColumn("_f", first)
    below = F.col("r_pct") < 100
    tags = F.array_compact(F.array(
        F.lit("all"), F.when(below, F.lit("excluding_r1")),
        F.when(below | F.col("_f"), F.lit("distinct_inputs"))))
    return marked.select("*", F.explode(tags).alias("cohort")).drop("_f")


def condition_summary(conditions: DataFrame) -> DataFrame:
    """MESR-accuracy rho, the partial given retention, and retention's own associations."""
    rows = cohorts(conditions)
    keys = ["dataset", "cohort"]
    out = ranks.spearman(rows, keys, "mesr", "accuracy", small=True)
    partial = ranks.partial_spearman(rows, keys, "mesr", "accuracy", "r_pct", small=True)
    ra = ranks.spearman(rows, keys, "r_pct", "accuracy", small=True)
    rm = ranks.spearman(rows, keys, "r_pct", "mesr", small=True)
    return (out.join(partial.select(*keys, F.col("rho").alias("partial_rho")), keys)
            .join(ra.select(*keys, F.col("rho").alias("retention_accuracy")), keys)
            .join(rm.select(*keys, F.col("rho").alias("retention_mesr")), keys))


def with_rho_p(rows: DataFrame, rho: str, n: str, controls: int = 0) -> DataFrame:
    t = ranks.rho_t(F.col(rho), F.col(n), controls)
    return rows.withColumn(f"{rho}_p", two_sided_t(t, F.col(n) - 2 - controls))


def within_retention(conditions: DataFrame, keys: list[str]) -> DataFrame:
    """Rho across methods at each retention below 1."""
    rows = conditions.where("r_pct < 100 AND mesr IS NOT NULL")
    return ranks.spearman(rows, [*keys, "r_pct"], "mesr", "accuracy", small=True).where("n >= 3")


def mean_within(per_level: DataFrame, keys: list[str]) -> DataFrame:
    return per_level.where("rho IS NOT NULL").groupBy(*keys).agg(
        F.avg("rho").alias("mean_rho"), F.count("*").alias("levels"))


def fisher(per_level: DataFrame, keys: list[str]) -> DataFrame:
    """Fisher's combination of the per-retention p-values."""
    tested = with_rho_p(per_level.where("rho IS NOT NULL"), "rho", "n")
    return tested.groupBy(*keys).agg((-2.0 * F.sum(F.log("rho_p"))).alias("x"),
                                     F.count("*").alias("levels")).withColumn(
        "fisher_p", chi2_sf("x", 2 * F.col("levels")))


def detectable_rho(sizes: DataFrame, n: str = "n", alpha: float = 0.05) -> DataFrame:
    """Smallest |rho| that n points can call significant; NULL under five points."""
    z, se = probit(1 - alpha / 2), 1.0 / F.sqrt(F.col(n) - 3.0)
    return sizes.withColumn("min_detectable_rho", F.when(F.col(n) >= 5, F.tanh(z * se)))


def with_power(sizes: DataFrame, targets: list[float], n: str = "n", alpha: float = 0.05) -> DataFrame:
    z, se = probit(1 - alpha / 2), 1.0 / F.sqrt(F.col(n) - 3.0)
    for t in targets:
        sizes = sizes.withColumn(f"power_{int(t * 10)}", normal_cdf(
            (F.atanh(F.lit(abs(t))) - z * se) / se))
    return sizes


def aggregate_conditions(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy mean, deviation and map over seeds; MESR and kept share means."""
    return runs.groupBy(*keys, "method", "r_pct").agg(
        F.avg("accuracy").alias("accuracy"), F.stddev_samp("accuracy").alias("accuracy_sd"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("seed", "accuracy"))))
        .alias("accuracy_per_seed"), F.avg("mesr").alias("mesr"),
        F.avg("kept_fraction").alias("kept_fraction"))


def seed_differences(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Paired accuracy difference of every method pair per retention over seeds."""
    pairs = method_pairs(runs.where("r_pct < 100"), [*keys, "r_pct", "seed"], "accuracy")
    diff = F.col("value_a") - F.col("value_b")
    return pairs.groupBy(*keys, "r_pct", "a", "b").agg(
        F.count("*").alias("n_seeds"), F.avg(diff).alias("mean_difference"),
        F.stddev_samp(diff).alias("sd_of_difference"), F.stddev_samp("value_a").alias("marginal_sd_a"),
        F.stddev_samp("value_b").alias("marginal_sd_b"),
        (F.abs(F.avg(diff)) > F.stddev_samp(diff)).alias("resolved"),
        (F.bool_and(diff > 0) | F.bool_and(diff < 0)).alias("sign_consistent")).where("n_seeds >= 2")


def difference_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    marginal = rows.select(*keys, F.explode(F.array("marginal_sd_a", "marginal_sd_b")).alias("_m"))
    m = marginal.groupBy(*keys).agg(F.percentile("_m", F.lit(0.5)).alias("median_marginal_sd"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), F.count_if("resolved").alias("n_resolved"),
        F.count_if("sign_consistent").alias("n_sign_consistent"),
        F.percentile("sd_of_difference", F.lit(0.5)).alias("median_paired_sd"),
        F.percentile(F.abs("mean_difference"), F.lit(0.5)).alias("median_abs_mean_difference"))
    return out.join(m, keys).withColumn(
        "marginal_over_paired_sd", F.col("median_marginal_sd") / F.nullif("median_paired_sd", F.lit(0.0)))


def drop_scenarios(conditions: DataFrame, methods: list[str]) -> DataFrame:
    """Conditions once as they are and once per left-out method (scenario names the method)."""
    every = F.array(F.lit("none"), *[F.lit(m) for m in methods])
    return conditions.withColumn("dropped", F.explode(F.array_except(every, F.array("method"))))


def inversion(conditions: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy rank (1 = worst) of the method with the highest MESR, per retention."""
    rows = conditions.where("r_pct < 100 AND mesr IS NOT NULL")
    w = W.partitionBy(*keys, "r_pct").orderBy(F.round("accuracy", 12), "method")
    ranked = rows.withColumn("_rank", F.row_number().over(w))
    top = F.max_by(F.struct("method", "accuracy", "_rank"), F.struct(F.round("mesr", 12), "method"))
    return ranked.groupBy(*keys, "r_pct").agg(top.alias("_t"), F.count("*").alias("methods")).select(
        *keys, "r_pct", F.col("_t.method").alias("top_mesr_method"), F.col("_t.accuracy").alias("accuracy"),
        F.col("_t._rank").alias("accuracy_rank"), "methods")


def tie_break_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per order: best and worst methods by MESR and accuracy, keeping ties."""
    w = W.partitionBy(*keys)
    marked = rows.withColumns({
        "_mx": F.round("mesr", 12) == F.max(F.round("mesr", 12)).over(w),
        "_ax": F.col("accuracy") == F.max("accuracy").over(w),
        "_an": F.col("accuracy") == F.min("accuracy").over(w)})
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c), F.col("method")))), ",")
    return marked.groupBy(*keys).agg(
        names("_mx").alias("top_mesr"), names("_ax").alias("most_accurate"), names("_an").alias("least_accurate"),
        F.bool_or(F.col("_mx") & F.col("_an")).alias("top_mesr_least_accurate"))


# --- predictions -----------------------------------------------------------------------------

def accuracy(predictions: DataFrame, keys: list[str]) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        F.count("*").alias("clips"),
        F.avg((F.col("prediction") == F.col("target")).cast("double")).alias("accuracy"))


def confusion(predictions: DataFrame, keys: list[str]) -> DataFrame:
    return predictions.groupBy(*keys, "target", "prediction").agg(F.count("*").alias("n"))


def classification_metrics(predictions: DataFrame, keys: list[str], classes: int,
                           other: int) -> DataFrame:
    """Top-1, macro-F1 over all classes (absent ones count 0), top-1 without the other class."""
    cells = confusion(predictions, keys)
    right = F.col("target") == F.col("prediction")
    sides = cells.select(*keys, "n", F.inline(F.array(
        F.struct(F.col("target").alias("k"), F.when(right, F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"), F.when(right, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("prediction").alias("k"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(right, 0).otherwise(F.col("n")).alias("fp"),
                 F.lit(0).cast("bigint").alias("fn")))))
    per = sides.groupBy(*keys, "k").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    macro = per.groupBy(*keys).agg((F.sum(f1) / classes).alias("macro_f1"))
    named = F.col("target") != other
    top = cells.groupBy(*keys).agg(
        F.sum("n").alias("clips"), (F.sum(F.when(right, F.col("n")).otherwise(0)) / F.sum("n")).alias("top1"),
        (F.sum(F.when(right & named, F.col("n")).otherwise(0)) / F.sum(F.when(named, F.col("n")))).alias("top1_named"))
    return top.join(macro, keys)


def check_gate(metrics: DataFrame, expected: DataFrame, keys: list[str],
               tolerance: float = 1e-6) -> DataFrame:
    """Expected against measured values; ``passes`` is false where they differ."""
    on = metrics.join(expected, keys)
    gap = F.abs(F.col("top1") - F.col("expected_top1"))
    return on.select(*keys, gap.alias("gap"), (gap <= tolerance).alias("passes"))


def cohort_accuracy(predictions: DataFrame, scorable: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy on the clips that hold a slice (``scorable`` lists them)."""
    return accuracy(predictions.join(scorable.select("clip").distinct(), "clip", "left_semi"), keys)


def prefix_identity(prefix: DataFrame, retained: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Do two computations give the same value on every key?"""
    pair = prefix.select(*keys, F.col(value).alias("_a")).join(
        retained.select(*keys, F.col(value).alias("_b")), keys, "full")
    same = F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= 1e-12, F.col("_a").isNull() & F.col("_b").isNull())
    return pair.agg(F.count("*").alias("cells"), F.count_if(~same).alias("differ"))


def architecture_signs(conditions: DataFrame, keys: list[str]) -> DataFrame:
    """Sign of retention's association with accuracy, and the best and worst condition."""
    rho = ranks.spearman(conditions, keys, "r_pct", "accuracy", small=True)
    order = F.struct(F.round("accuracy", 12), F.col("method"), F.col("r_pct"))
    ends = conditions.groupBy(*keys).agg(
        F.max_by("condition", order).alias("best"), F.min_by("condition", order).alias("worst"))
    return rho.join(ends, keys).withColumn("sign", F.signum("rho"))
