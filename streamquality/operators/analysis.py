"""Corpus analyses over the curve table.

The curve table has one row per (recording, method, retention); windows here are per recording
and method (at most one row per retention) or per recording (one row per method).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import ranks
from .oracle import eligible, method_pairs, nearest_point
from .resample import cluster_bootstrap

KEY = "recording_id"
CELL = ["dataset", KEY, "method"]
GATE = 4


def usable(curve: DataFrame) -> DataFrame:
    return curve.where("evaluable").withColumn("r", F.col("r_pct") / 100.0)


def _first_max(value: str) -> Column:
    """Sort key of the first maximum along the grid, blind to the last float digits."""
    return F.struct(F.round(value, 12), -F.col("r_pct"))


def _first_min(value: str) -> Column:
    return F.struct(F.round(value, 12), F.col("r_pct"))


def trapezoid(points: DataFrame, keys: list[str], out: str = "auc") -> DataFrame:
    """Span-normalised trapezoid of MESR over r; a single point is its own value."""
    w = W.partitionBy(*keys).orderBy("r_pct")
    steps = points.select(*keys, "r", "mesr", (
        (F.col("mesr") + F.lag("mesr").over(w)) / 2 * (F.col("r") - F.lag("r").over(w)))
        .alias("_area"))
    span = F.max("r") - F.min("r")
    return steps.groupBy(*keys).agg(
        F.when(span > 0, F.sum("_area") / span).otherwise(F.max("mesr")).alias(out))


def curve_summary(curve: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Optimum, normalised area, evaluable range and whether the optimum sits on its floor.

    Cells without an evaluable point are absent; `error_cells` lists them.
    """
    points = usable(curve)
    head = points.groupBy(*keys).agg(
        F.max_by(F.struct("r", "mesr"), _first_max("mesr")).alias("_b"),
        F.min("r").alias("r_low"), F.max("r").alias("r_high"),
        F.first("raw_mesr").alias("raw_mesr"), F.count("*").alias("points"))
    return head.join(trapezoid(points, keys, "auc_over_r"), keys).select(
        *keys, F.col("_b.r").alias("r_star"), F.col("_b.mesr").alias("mesr_star"), "auc_over_r",
        "r_low", "r_high", "points", (F.col("_b.r") == F.col("r_low")).alias("optimum_at_floor"),
        "raw_mesr", (F.col("_b.mesr") - F.col("raw_mesr")).alias("delta_at_r_star"))


def floor_pinned(summary: DataFrame, keys: list[str]) -> DataFrame:
    """How many optima sit on the lowest evaluable retention."""
    return summary.groupBy(*keys).agg(
        F.count("*").alias("cells"), F.count_if("optimum_at_floor").alias("floor_pinned"),
        F.avg(F.col("optimum_at_floor").cast("double")).alias("share"))


def error_cells(curve: DataFrame) -> DataFrame:
    return curve.groupBy(*CELL).agg(F.count_if("evaluable").alias("n")).where("n = 0").drop("n")


def protocol_rows(curve: DataFrame, decomposition: DataFrame) -> DataFrame:
    """The self-describing row per cell: curve summary plus the first slice's factors."""
    d = decomposition.select("dataset", KEY, "ntss", "ln", "occupied_px", "n_events")
    return curve_summary(curve).join(d, ["dataset", KEY])


def rank_methods(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """1 = best by ``value``; equal values keep method order. Groups hold one row per method."""
    w = W.partitionBy(*keys).orderBy(F.round(value, 12).desc_nulls_last(), "method")
    return rows.withColumn(out, F.when(
        F.col(value).isNotNull(), F.row_number().over(w).cast("bigint")))


def at_native(curve: DataFrame, native: DataFrame) -> DataFrame:
    """Evaluable grid point nearest each method's own retention."""
    points = usable(curve).join(native, CELL)
    return nearest_point(points, CELL, "native_retention", ["mesr", "raw_mesr"])


def mean_rows(summary: DataFrame, native_points: DataFrame, native: DataFrame,
              methods: DataFrame) -> DataFrame:
    """Mean protocol row per method; native columns are NULL for continuous scorers."""
    rows = summary.join(native_points.select(*CELL, F.col("mesr").alias("_native")), CELL, "left")
    rows = rows.join(native, CELL, "left")
    means = rows.groupBy("dataset", "method").agg(
        F.avg("mesr_star").alias("mesr_star"), F.avg("delta_at_r_star").alias("delta_at_r_star"),
        F.avg("_native").alias("mesr_at_native"), F.avg("auc_over_r").alias("auc_over_r"),
        F.avg("r_star").alias("r_star"), F.avg("native_retention").alias("native_retention"),
        F.count("*").alias("recordings"))
    return means.join(methods.select("method", "is_oracle", "is_null"), "method")


def native_deltas(native_points: DataFrame, methods: DataFrame,
                  eligible_only: bool = True) -> DataFrame:
    """Delta at the native point against the unfiltered curve at its own native point."""
    base = native_points.where("method = 'raw'").select("dataset", KEY, F.col("mesr").alias("_raw"))
    rows = native_points.join(methods.where("has_native AND NOT is_oracle").select("method"),
                              "method", "left_semi").join(base, ["dataset", KEY])
    rows = rows.select(*CELL, "native_retention", (F.col("r_pct") / 100.0).alias("r"),
                       (F.col("mesr") - F.col("_raw")).alias("delta"))
    rows = rows.withColumn("eligible", eligible(F.col("native_retention"), F.col("r")))
    return rows.where("eligible") if eligible_only else rows


def eligibility_census(deltas: DataFrame, floors: DataFrame) -> DataFrame:
    """Per method and eligibility: cells, mean Delta, native and scored retention, below floor."""
    return deltas.where("method <> 'raw'").join(floors, CELL).groupBy(
        "dataset", "method", "eligible").agg(
        F.count("*").alias("cells"), F.avg("delta").alias("mean_delta"),
        F.avg("native_retention").alias("mean_native_r"), F.avg("r").alias("mean_scored_r"),
        F.count_if(F.col("native_retention") < F.col("r_low")).alias("below_floor"))


def aggressiveness(census: DataFrame) -> DataFrame:
    """Rank agreement of mean Delta with mean native retention over eligible method rows."""
    rows = census.where("eligible")
    rho = ranks.spearman(rows, ["dataset"], "mean_delta", "mean_native_r", small=True)
    tau = ranks.kendall(rows, ["dataset"], "method", "mean_delta", "mean_native_r")
    return rho.join(tau.select("dataset", "tau"), "dataset", "left")


def common_support_floor(curve: DataFrame) -> DataFrame:
    """The smallest retention every recording is evaluable at."""
    floors = curve.where("evaluable AND method = 'raw'").groupBy("dataset", KEY).agg(
        F.min("r_pct").alias("_lo"))
    return floors.groupBy("dataset").agg(F.max("_lo").alias("floor_r_pct"))


def delta_at_fixed(points: DataFrame, draws: int, algorithm: str) -> DataFrame:
    """Delta at one retention per method with a scene interval; ``points`` is already cut."""
    ci = cluster_bootstrap(points, ["dataset", "method"], "delta", "scene", draws,
                           algorithm=algorithm)
    mid = points.groupBy("dataset", "method").agg(
        F.percentile("delta", F.lit(0.5)).alias("median"))
    return ci.join(mid, ["dataset", "method"])


def reference_cells(records: DataFrame, published: DataFrame) -> DataFrame:
    """Per (part, level): paired means, reproduction error against a published table.

    ``records`` holds part, level, mesr (NULL where unevaluable), raw_mesr and retention; the
    published table has one row per cell.
    """
    on = F.col("mesr").isNotNull()
    cells = records.groupBy("part", "level").agg(
        F.avg("raw_mesr").alias("raw_mesr"),
        F.avg(F.when(on, F.col("raw_mesr"))).alias("raw_mesr_paired"),
        F.avg("mesr").alias("mesr"), F.avg("retention").alias("mean_retention"),
        F.count("*").alias("recordings"), F.count_if(on).alias("evaluable"))
    return cells.join(published, ["part", "level"]).withColumns({
        "delta_over_raw": F.col("mesr") - F.col("raw_mesr_paired"),
        "error": F.col("mesr") - F.col("published")})


def reference_summary(cells: DataFrame, records: DataFrame) -> DataFrame:
    pooled = records.where("mesr IS NOT NULL").agg(
        F.avg(F.col("mesr") - F.col("raw_mesr")).alias("pooled_delta"),
        F.count("*").alias("pooled_n"))
    return cells.agg(
        F.avg("delta_over_raw").alias("mean_delta"), F.min("mean_retention").alias("retention_min"),
        F.max("mean_retention").alias("retention_max"), F.avg("error").alias("error_mean"),
        F.min("error").alias("error_min"), F.max("error").alias("error_max"),
        F.max(F.abs("error")).alias("error_max_abs"), F.count("*").alias("n_cells"),
        F.sum("recordings").alias("recordings"), F.sum("evaluable").alias("evaluable")
    ).join(F.broadcast(pooled))


def coverage(curve: DataFrame) -> DataFrame:
    """n(r): recordings and cells evaluable at each retention, oracles left to the caller."""
    return curve.where("evaluable").groupBy("dataset", "r_pct").agg(
        F.count_distinct(KEY).alias("recordings"), F.count("*").alias("cells"))


def supports(curve: DataFrame) -> DataFrame:
    """Own, common and widest evaluable range of each recording, and cohort membership."""
    own = curve.where("evaluable").groupBy("dataset", KEY).agg(
        F.min("r_pct").alias("lo"), F.max("r_pct").alias("hi"))
    corpus = own.groupBy("dataset").agg(
        F.max("lo").alias("common_lo"), F.min("hi").alias("common_hi"),
        F.min("lo").alias("full_lo"), F.count_distinct("lo").alias("floors"))
    return own.join(corpus, "dataset").withColumns({
        "in_cohort": (F.col("lo") <= F.col("full_lo")) & (F.col("hi") >= F.col("common_hi")),
        "ragged": F.col("floors") > 1})


def support_variants(curve: DataFrame) -> DataFrame:
    """Mean area per method under its own range, the common grid and the common cohort."""
    points = usable(curve).join(supports(curve), ["dataset", KEY])
    r = F.col("r_pct")
    inside = [("own_range", F.lit(True)),
              ("common_grid", r.between(F.col("common_lo"), F.col("common_hi"))),
              ("common_cohort", F.col("in_cohort") & r.between(F.col("full_lo"), F.col("common_hi")))]
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in inside]))
    tagged = points.select(*CELL, "r_pct", "r", "mesr", F.explode(tags).alias("support"))
    areas = trapezoid(tagged, [*CELL, "support"])
    return areas.groupBy("dataset", "support", "method").agg(
        F.avg("auc").alias("auc"), F.count("*").alias("recordings"))


def agreement(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Spearman, Kendall and whether two method rankings differ; NULL under three methods."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rho = ranks.spearman(both, keys, a, b, small=True)
    tau = ranks.kendall(both, keys, "method", a, b).select(*keys, "tau")
    ranked = rank_methods(rank_methods(both, keys, a, "_ra"), keys, b, "_rb")
    differ = ranked.groupBy(*keys).agg(F.bool_or(F.col("_ra") != F.col("_rb")).alias("_d"))
    joined = rho.join(tau, keys, "left").join(differ, keys)
    enough = F.col("n") >= 3
    return joined.select(*keys, F.col("n").alias("n_methods"), "rho",
                         F.when(enough, F.col("tau")).alias("tau"),
                         F.when(enough, F.col("_d")).alias("differ"))


def paired_contrasts(deltas: DataFrame, draws: int, algorithm: str, family: bool = False,
                     seed: int | None = None) -> DataFrame:
    """Every pair of methods ordered by mean Delta: paired interval, median, share above.

    ``deltas`` holds dataset, recording, scene, method, delta. With ``family`` the interval is
    at 0.05 over the number of pairs of that data set.
    """
    means = deltas.groupBy("dataset", "method").agg(F.avg("delta").alias("_m"))
    rank = rank_methods(means, ["dataset"], "_m", "rank").select("dataset", "method", "rank")
    pairs = method_pairs(deltas.where(F.col("delta").isNotNull()), ["dataset", KEY, "scene"], "delta")
    ra = rank.select("dataset", F.col("method").alias("a"), F.col("rank").alias("_ka"))
    rb = rank.select("dataset", F.col("method").alias("b"), F.col("rank").alias("_kb"))
    pairs = pairs.join(ra, ["dataset", "a"]).join(rb, ["dataset", "b"])
    up = F.col("_ka") < F.col("_kb")
    ordered = pairs.select(
        "dataset", KEY, "scene", F.when(up, F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(up, F.col("b")).otherwise(F.col("a")).alias("b"),
        (F.abs(F.col("_ka") - F.col("_kb")) == 1).alias("adjacent"),
        F.when(up, F.col("value_a") - F.col("value_b"))
        .otherwise(F.col("value_b") - F.col("value_a")).alias("diff"))
    keys = ["dataset", "a", "b"]
    shape = ordered.groupBy(*keys).agg(
        F.percentile("diff", F.lit(0.5)).alias("median_difference"),
        F.avg((F.col("diff") > 1e-12).cast("double")).alias("share_a_above_b"),
        F.first("adjacent").alias("adjacent"))
    extra = {} if seed is None else {"seed": seed}
    if family:
        count = shape.groupBy("dataset").agg((0.05 / F.count("*")).alias("alpha"))
        ordered = ordered.join(count, "dataset")
        extra["alpha"] = "alpha"
    ci = cluster_bootstrap(ordered, keys, "diff", "scene", draws, algorithm=algorithm, **extra)
    return ci.withColumnRenamed("n", "n_recordings").join(shape, keys)


def contrast_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("dataset").agg(
        F.count("*").alias("pairs_total"), F.count_if("excludes_zero").alias("pairs_resolved"),
        F.bool_and(F.when(F.col("adjacent"), F.col("excludes_zero"))).alias("adjacent_all_resolved"))


# --- event-cap sensitivity -------------------------------------------------------------------

def cap_cells(deltas: DataFrame, sizes: DataFrame, caps: list[int]) -> DataFrame:
    """Spread of Delta across caps for cells scored under every cap.

    ``deltas`` has a ``cap`` column; ``truncated`` marks recordings the smallest cap can bind.
    """
    across = deltas.groupBy(*CELL).agg(
        F.count_distinct("cap").alias("_caps"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("cap", "delta")))).alias("by_cap"),
        (F.max("delta") - F.min("delta")).alias("spread"))
    return across.where(F.col("_caps") == len(caps)).drop("_caps").join(
        sizes.select("dataset", KEY, "n_events"), ["dataset", KEY]).withColumn(
        "truncated", F.col("n_events") >= min(caps)).drop("n_events")


def cap_summary(cells: DataFrame, unit: float) -> DataFrame:
    """Cap spread over bound cells; the unfiltered method is zero by construction and left out."""
    scored = F.col("truncated") & (F.col("method") != "raw")
    s = F.when(scored, F.col("spread"))
    return cells.groupBy("dataset").agg(
        F.count("*").alias("cells_compared"), F.count_if("truncated").alias("cells_bound"),
        F.count_if(scored).alias("cells_scored"), F.max(s).alias("max"),
        F.percentile(s, F.lit(0.5)).alias("median"), F.avg(s).alias("mean"),
        F.avg((s > unit).cast("double")).alias("share_above_unit"))


def cap_by_method(cells: DataFrame, caps: list[int]) -> DataFrame:
    means = [F.avg(F.element_at("by_cap", F.lit(c))) for c in caps]
    return cells.where("truncated").groupBy("dataset", "method").agg(
        F.count("*").alias("cells"), F.max("spread").alias("max_spread"),
        F.percentile("spread", F.lit(0.5)).alias("median_spread"),
        (F.greatest(*means) - F.least(*means)).alias("mean_spread_across_caps"))


def cap_worst(cells: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` cells that move most: a top-k report."""
    return cells.where("truncated AND method <> 'raw'").orderBy(
        F.desc("spread"), *CELL).limit(k).select(*CELL, "spread")


def cap_at_fixed(curves: DataFrame, r_pcts: list[int], caps: list[int], unit: float) -> DataFrame:
    """Cap effect on Delta at retentions evaluable under every cap."""
    pts = curves.where(F.col("r_pct").isin(r_pcts) & F.col("evaluable"))
    raw = pts.where("method = 'raw'").select("dataset", KEY, "cap", "r_pct", F.col("mesr").alias("_raw"))
    deltas = pts.where("method <> 'raw'").join(raw, ["dataset", KEY, "cap", "r_pct"]).withColumn(
        "delta", F.col("mesr") - F.col("_raw"))
    cells = deltas.groupBy(*CELL, "r_pct").agg(
        F.count_distinct("cap").alias("_c"), (F.max("delta") - F.min("delta")).alias("spread"))
    return cells.where(F.col("_c") == len(caps)).groupBy("dataset", "r_pct").agg(
        F.count("*").alias("cells"), F.percentile("spread", F.lit(0.5)).alias("median"),
        F.max("spread").alias("max"), F.avg((F.col("spread") > unit).cast("double")).alias("share_above_unit"))


def cap_range_changes(curves: DataFrame, caps: list[int]) -> DataFrame:
    """Cells whose evaluable range is the same under every cap."""
    ranges = curves.groupBy(*CELL, "cap").agg(F.struct(
        F.min(F.when(F.col("evaluable"), F.col("r_pct"))).alias("lo"),
        F.max(F.when(F.col("evaluable"), F.col("r_pct"))).alias("hi")).alias("range"))
    cells = ranges.groupBy(*CELL).agg(F.count("*").alias("_c"),
                                      F.size(F.collect_set("range")).alias("_r"))
    return cells.where(F.col("_c") == len(caps)).groupBy("dataset").agg(
        F.count("*").alias("cells"), F.count_if(F.col("_r") == 1).alias("identical_range"))


def cap_means(deltas: DataFrame, caps: list[int]) -> DataFrame:
    """Corpus means over every recording common to all caps, for methods scored on all of them."""
    common = deltas.groupBy("dataset", KEY).agg(F.count_distinct("cap").alias("_c")).where(
        F.col("_c") == len(caps)).select("dataset", KEY)
    size = common.groupBy("dataset").agg(F.count("*").alias("recordings"))
    means = deltas.join(common, ["dataset", KEY]).groupBy("dataset", "method", "cap").agg(
        F.avg("delta").alias("mean"), F.count("*").alias("n")).join(size, "dataset")
    full = means.where(F.col("n") == F.col("recordings"))
    return full.groupBy("dataset", "method", "recordings").agg(
        F.count("*").alias("_c"), (F.max("mean") - F.min("mean")).alias("spread_across_caps")
    ).where(F.col("_c") == len(caps)).drop("_c")


# --- slice-size rankings ---------------------------------------------------------------------

def complete_methods(sweep: DataFrame, sizes: int) -> DataFrame:
    """Methods of a recording that are evaluable at every slice size."""
    return sweep.groupBy(*CELL).agg(F.count("mesr").alias("_c")).where(
        F.col("_c") == sizes).select(*CELL)


def slice_rank_agreement(sweep: DataFrame, reference: int, sizes: int) -> DataFrame:
    """Kendall tau and discordant pairs of each size's ranking against the reference size."""
    cohort = sweep.join(complete_methods(sweep, sizes), CELL)
    ref = cohort.where(F.col("slice_size") == reference).select(*CELL, F.col("mesr").alias("ref"))
    both = cohort.join(ref, CELL)
    keys = ["dataset", KEY, "slice_size"]
    tau = ranks.kendall(both, keys, "method", "ref", "mesr")
    w = W.partitionBy(*keys)
    tops = both.withColumns({
        "_t": F.row_number().over(w.orderBy(F.round("mesr", 12).desc(), "method")),
        "_tr": F.row_number().over(w.orderBy(F.round("ref", 12).desc(), "method"))})
    tops = tops.groupBy(*keys).agg(
        F.count("*").alias("cohort"), F.max(F.when(F.col("_t") == 1, F.col("method"))).alias("top"),
        F.max(F.when(F.col("_tr") == 1, F.col("method"))).alias("top_reference"))
    return tops.join(tau, keys, "left").withColumn("top_changes", F.col("top") != F.col("top_reference"))


def slice_pair_flips(sweep: DataFrame, reference: int, sizes: int) -> DataFrame:
    """Mean paired difference of every method pair per size, and whether its sign flips."""
    cohort = sweep.join(complete_methods(sweep, sizes), CELL)
    pairs = method_pairs(cohort, ["dataset", KEY, "slice_size"], "mesr")
    means = pairs.groupBy("dataset", "a", "b", "slice_size").agg(
        F.avg(F.col("value_a") - F.col("value_b")).alias("diff"), F.count("*").alias("n_recordings"))
    ref = means.where(F.col("slice_size") == reference).select("dataset", "a", "b", F.col("diff").alias("_r"))
    return means.join(ref, ["dataset", "a", "b"]).withColumn(
        "flips", F.signum("diff") != F.signum("_r")).drop("_r")


def slice_rank_summary(agreements: DataFrame, reference: int) -> DataFrame:
    other = F.col("slice_size") != reference
    per = agreements.where("cohort >= 2").groupBy("dataset", KEY).agg(
        F.bool_or(F.col("discordant") > 0).alias("reordered"), F.bool_or("top_changes").alias("top_changed"),
        F.min(F.when(other, F.col("tau"))).alias("min_tau"), F.sum(F.when(other, F.col("tau"))).alias("_s"),
        F.count(F.when(other, F.col("tau"))).alias("_n"))
    return per.groupBy("dataset").agg(
        F.count("*").alias("ranked_recordings"), F.count_if("reordered").alias("reordered"),
        F.count_if("top_changed").alias("top_changed"), F.min("min_tau").alias("min_tau"),
        (F.sum("_s") / F.sum("_n")).alias("mean_tau"))


def slice_dependence(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """Spread over slice sizes and whether MESR never falls as the slice grows."""
    prev = F.lag("mesr").over(W.partitionBy(*keys).orderBy("slice_size"))
    steps = sweep.where("mesr IS NOT NULL").withColumn("_up", F.col("mesr") >= prev)
    return steps.groupBy(*keys).agg(
        F.count("*").alias("sizes"), (F.max("mesr") - F.min("mesr")).alias("spread"),
        F.bool_and("_up").alias("monotone_increasing")).where("sizes >= 2")


# --- repeatability and retention dependence --------------------------------------------------

def repeat_cells(repetitions: DataFrame, cell: str, value: str, full: int) -> DataFrame:
    """Mean, spread and deviation of each cell's repetitions; ``complete`` marks full cells."""
    cells = repetitions.where(F.col(value).isNotNull()).groupBy(cell).agg(
        F.count("*").alias("repetitions"), F.avg(value).alias("mean"),
        (F.max(value) - F.min(value)).alias("spread"), F.stddev_samp(value).alias("sd"))
    return cells.withColumn("complete", F.col("repetitions") == full)


def repeatability(cells: DataFrame, gap: float) -> DataFrame:
    """Pooled repeatability and the share of cells whose spread exceeds a published gap."""
    rows = cells.where("repetitions >= 2")
    return rows.agg(
        F.count("*").alias("cells"), F.avg("spread").alias("spread_mean"),
        F.percentile("spread", F.lit(0.5)).alias("spread_median"), F.min("spread").alias("spread_min"),
        F.max("spread").alias("spread_max"), F.sqrt(F.avg(F.col("sd") * F.col("sd"))).alias("pooled_sd"),
        F.count_if(F.col("spread") > gap).alias("cells_exceeding"),
        F.avg((F.col("spread") > gap).cast("double")).alias("share_exceeding"),
        F.max_by("cell", F.struct(F.round("spread", 12), "cell")).alias("worst_cell"))


def repeatability_by(cells: DataFrame, dimensions: list[str]) -> DataFrame:
    """Median spread by each dimension and overall, as grouping sets."""
    rows = cells.where("repetitions >= 2")
    measures = [F.percentile("spread", F.lit(0.5)).alias("median_spread"), F.count("*").alias("cells")]
    by = rows.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions]).agg(
        *[F.grouping(d).alias(f"all_{d}") for d in dimensions], *measures)
    # grouping sets give no total over no rows; a plain aggregate does
    total = rows.agg(*measures).select(
        *[F.lit(None).cast(rows.schema[d].dataType).alias(d) for d in dimensions],
        *[F.lit(1).cast("byte").alias(f"all_{d}") for d in dimensions], "median_spread", "cells")
    return by.unionByName(total)


def retention_dependence(curve: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Range of MESR over retentions and where its ends lie."""
    return usable(curve).groupBy(*keys).agg(
        F.min("mesr").alias("min_mesr"), F.max("mesr").alias("max_mesr"),
        (F.max("mesr") - F.min("mesr")).alias("spread"),
        F.max_by("r_pct", _first_max("mesr")).alias("argmax_r_pct"),
        F.min_by("r_pct", _first_min("mesr")).alias("argmin_r_pct"), F.count("*").alias("points"))


def spread_by_scene(spreads: DataFrame, keys: list[str]) -> DataFrame:
    return spreads.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("spread").alias("mean"), F.min("spread").alias("min"),
        F.max("spread").alias("max"))


def operating_point(events: DataFrame, score: str, threshold: float, sentinel: float) -> DataFrame:
    """Scored events, ROC AUC with noise as the positive class, and the released retention."""
    base = events.groupBy("dataset", KEY).agg(
        F.count("*").alias("events"), F.count_if(F.col(score) != sentinel).alias("scored"),
        F.avg((F.col(score) < threshold).cast("double")).alias("released_retention"))
    auc = ranks.roc_auc(events.where(F.col(score) != sentinel).withColumn(
        "_pos", F.col("label") == 1), ["dataset", KEY], "_pos", score)
    return base.join(auc.select("dataset", KEY, "auc"), ["dataset", KEY])


def effect_ratios(effects: DataFrame, gap: float, floor: DataFrame) -> DataFrame:
    """Each effect against a published gap and a measured floor (a one-row table)."""
    return effects.join(F.broadcast(floor)).withColumns({
        "over_gap": F.col("value") / gap, "over_floor": F.col("value") / F.col("floor"),
        "survives": F.col("value") / F.col("floor") >= 2}).drop("floor")


def mean_delta_curve(points: DataFrame) -> DataFrame:
    return points.groupBy("dataset", "method", F.round(F.col("r_pct") / 100.0, 4).alias("r")).agg(
        F.avg("delta").alias("delta"), F.count("*").alias("n"))


def rank_report(rows: DataFrame) -> DataFrame:
    """Rankings of methods with a native point, or ``undecidable`` under four of them.

    Oracles and nulls are not ranked.
    """
    keys = ["dataset"]
    pool = rows.where("NOT is_oracle AND NOT is_null AND mesr_at_native IS NOT NULL")
    size = pool.groupBy("dataset").agg(F.count("*").alias("n_methods"))
    missing = rows.where("NOT is_oracle AND mesr_at_native IS NULL").groupBy("dataset").agg(
        F.array_sort(F.collect_list("method")).alias("without_native"))
    out = size.join(missing, "dataset", "left")
    for name, a, b in (("star_native", "mesr_star", "mesr_at_native"),
                       ("star_auc", "mesr_star", "auc_over_r"),
                       ("auc_native", "auc_over_r", "mesr_at_native")):
        part = agreement(pool, keys, a, b).select(
            "dataset", F.col("rho").alias(f"rho_{name}"), F.col("tau").alias(f"tau_{name}"),
            F.col("differ").alias(f"differ_{name}"))
        out = out.join(part, "dataset", "left")
    gated = [F.when(F.col("n_methods") >= GATE, F.col(c)).alias(c)
             for c in out.columns if c.split("_")[0] in ("rho", "tau", "differ")]
    return out.select("dataset", "n_methods", "without_native", F.when(
        F.col("n_methods") >= GATE, "decided").otherwise("undecidable").alias("status"), *gated)
