"""The concentration metric and its curve over retentions.

Counts per pixel are sparse: empty pixels contribute nothing to either factor, so no dense
surface is built. Work is laid out by (recording, slice); a slice holds at most ``slice_size``
events, so no task depends on how long a recording is.
"""

from __future__ import annotations

from math import gcd, lcm

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import block_quota, div, esr, esr_terms, pixel, quota_of, thinning_base
from .order import PIECE, block_of, spread, with_mask_positions

KEY = "recording_id"


def pixel_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Events per occupied pixel within ``keys``."""
    return df.groupBy(*keys, "x", "y").agg(F.count("*").alias("n"))


def esr_per_slice(df: DataFrame, keys: list[str], slice_size: int,
                  slice_col: str = "slice", like: DataFrame | None = None) -> DataFrame:
    """ntss, ln, occupied pixels and ESR of every complete slice.

    One shuffle on (keys, slice) serves both aggregations that follow. ``like`` is a table of
    about as many rows that is cheaper to count.
    """
    laid = df.withColumn("px", pixel()).select(*keys, slice_col, "px")
    counts = (spread(laid, [*keys, slice_col], like)
              .groupBy(*keys, slice_col, "px").agg(F.count("*").alias("n")))
    return (counts.groupBy(*keys, slice_col)
            .agg(F.sum("n").alias("n_events"), F.count("*").alias("occupied_px"),
                 *esr_terms("n", slice_size))
            .where(F.col("n_events") == slice_size)
            .withColumn("esr", esr()))


def esr_of_counts(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """ESR of arbitrary pixel counts; NULL below two events.

    The exponent base depends on the group's own total, so counts are first folded to a
    histogram of distinct values: at most sqrt(2N) entries per group.
    """
    hist = counts.groupBy(*keys, F.col(n).alias("n")).agg(F.count("*").alias("pixels"))
    folded = hist.groupBy(*keys).agg(
        F.sum(F.col("n") * F.col("pixels")).alias("n_events"),
        F.sum("pixels").alias("occupied_px"),
        F.sum(F.col("n") * (F.col("n") - 1) * F.col("pixels")).alias("_pairs"),
        F.array_sort(F.collect_list(F.struct("n", "pixels"))).alias("_hist"))
    total = F.col("n_events")
    base = 1.0 - div(2 * total, 3) / total
    ln = F.aggregate("_hist", F.lit(0.0), lambda acc, h: acc + h["pixels"] * (
        1.0 - F.pow(base, h["n"])))
    enough = total >= 2
    return (folded
            .withColumn("ntss", F.when(enough, F.col("_pairs") / (total * (total - 1))))
            .withColumn("ln", F.when(enough, ln))
            .withColumn("esr", esr()).drop("_pairs", "_hist"))


def mesr_unfiltered(events: DataFrame, slice_size: int, keys: list[str] | None = None) -> DataFrame:
    """MESR of whole recordings: the event index already is the retained rank."""
    keys = keys or [KEY]
    sliced = events.withColumn("slice", div("event_idx", slice_size))
    return esr_per_slice(sliced, keys, slice_size, like=events).groupBy(*keys).agg(
        F.avg("esr").alias("mesr"), F.count("*").alias("slices"))


def mesr_of_masks(events: DataFrame, masks: list[str], slice_size: int, block: int) -> DataFrame:
    """MESR of several keep masks of the same recordings, in one pass."""
    placed = with_mask_positions(events, masks, block)
    choices = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}_pos").alias("pos"))
                        for m in masks])
    long = (placed.select(KEY, "x", "y", F.inline(choices)).where(F.col("pos").isNotNull())
            .withColumn("slice", div("pos", slice_size)))
    return esr_per_slice(long, [KEY, "method"], slice_size, like=events).groupBy(KEY, "method").agg(
        F.avg("esr").alias("mesr"), F.count("*").alias("slices"))


def decompose_first_slice(events: DataFrame, slice_size: int) -> DataFrame:
    """ntss, ln, occupied pixels and size of each recording's first ``slice_size`` events."""
    head = events.where(F.col("event_idx") < slice_size)
    return esr_of_counts(pixel_counts(head, [KEY]), [KEY])


def rank_in_block(events: DataFrame, score: Column | None, block: int) -> DataFrame:
    """Add ``block``, ``n_b`` and ``rk``: lowest score first, then arrival, inside the block."""
    tagged = events.withColumn("block", block_of(block))
    part = W.partitionBy(KEY, "block")
    if score is None:
        rank = (F.col("event_idx") - F.col("block") * block + 1).cast("int")
    else:
        tagged = tagged.withColumn("_score", score)
        rank = F.row_number().over(part.orderBy("_score", "event_idx"))
    ranked = spread(tagged, [KEY, "block"], events).withColumn("rk", rank).withColumn("n_b", F.count("*").over(part).cast("int"))
    return ranked.drop("_score")


def retain(events: DataFrame, score: Column | None, share: float, block: int) -> DataFrame:
    """The block-quota retention at one share: the lowest-scoring part of every block."""
    ranked = rank_in_block(events, score, block)
    return ranked.where(F.col("rk") <= block_quota(F.col("n_b"), share, block)).drop("rk", "n_b")


def retained_positions(events: DataFrame, score: Column | None, pcts: list[int],
                       block: int) -> DataFrame:
    """One row per (event, retention) that keeps it, with ``pos``, its rank among kept events.

    The retentions that keep an event are a suffix of the grid, so only those are emitted.
    Every full block keeps the same number, so the offset of a block is ``block * quota`` and
    only the rank inside the block needs a window.
    """
    ranked = rank_in_block(events, score, block)
    quotas = F.array(*[F.struct(
        F.lit(p).alias("r_pct"), block_quota(F.col("n_b"), p / 100.0, block).alias("k"),
        F.lit(quota_of(block, p / 100.0)).alias("full")) for p in pcts])
    kept = ranked.select(*events.columns, "block", F.inline(
        F.filter(quotas, lambda q: q["k"] >= F.col("rk"))))
    local = F.row_number().over(W.partitionBy(KEY, "block", "r_pct").orderBy("event_idx"))
    return (kept.withColumn("pos", F.col("block") * F.col("full") + local - 1)
            .drop("k", "full"))


def commensurable(sizes: list[int], length: int = 30_000) -> list[tuple[list[int], int]]:
    """Slice sizes in groups with a chunk length each that is a multiple of all of the group's.

    A chunk holds whole slices of every size of its group, so an event is shuffled once a group;
    sizes that would need chunks much over ``length`` get a group of their own.
    """
    groups: list[tuple[list[int], int]] = []
    for s in sorted(sizes, reverse=True):
        for i, (some, common) in enumerate(groups):
            if lcm(common, s) <= max(length, common):
                groups[i] = ([*some, s], lcm(common, s))
                break
        else:
            groups.append(([s], s))
    return [(some, common * max(1, length // common)) for some, common in groups]


def _sweeper(sizes: list[int], length: int):
    """Sum of ESR and number of whole slices of each size in one chunk of kept events."""
    def reduce_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["pos"].to_numpy() % length
        _, px = np.unique(pdf["px"].to_numpy(), return_inverse=True)
        width = int(px.max()) + 1
        out = []
        for size in sizes:
            whole = len(at) // size
            cell, n = np.unique(at // size * width + px, return_counts=True)
            slot = cell // width
            thin = 1.0 - thinning_base(size) ** np.arange(int(n.max()) + 1)
            pairs = np.bincount(slot, n * (n - 1))[:whole] / (float(size) * (size - 1))
            ln = np.bincount(slot, thin[n])[:whole]
            out.append((size, float(np.sqrt(pairs * ln).sum()), whole))
        frame = pd.DataFrame([o for o in out if o[2]], columns=["slice_size", "total", "slices"])
        frame.insert(0, "method", pdf["method"].iloc[0])
        frame.insert(0, KEY, pdf[KEY].iloc[0])
        return frame

    return reduce_chunk


def slice_size_sweep(events: DataFrame, masks: list[str], sizes: list[int],
                     block: int) -> DataFrame:
    """MESR of each mask at several slice sizes; NULL where a stream holds no whole slice.

    Kept events are shuffled once, in chunks that hold whole slices of all sizes.
    """
    placed = with_mask_positions(events, masks, block)
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}_pos").alias("pos"))
                      for m in masks])
    long = placed.select(KEY, pixel().cast("long").alias("px"), F.inline(cells)).where(F.col("pos").isNotNull())
    scored = None
    for some, length in commensurable(sizes):
        dealt = spread(long.withColumn("chunk", div("pos", length)), [KEY, "method", "chunk"], events)
        part = dealt.groupBy(KEY, "method", "chunk").applyInPandas(
            _sweeper(some, length), f"{KEY} string, method string, slice_size int, total double, slices long")
        scored = part if scored is None else scored.unionByName(part)
    scored = scored.groupBy(KEY, "method", "slice_size").agg(
        (F.sum("total") / F.sum("slices")).alias("mesr"))
    grid = (events.groupBy(KEY).agg(F.count("*").alias("n"))
            .select(KEY, F.explode(F.array(*[F.lit(m) for m in masks])).alias("method"))
            .select(KEY, "method",
                    F.explode(F.array(*[F.lit(s) for s in sizes])).alias("slice_size")))
    return grid.join(scored, [KEY, "method", "slice_size"], "left")


def declared_sensor(events: DataFrame, sensors: list[tuple[int, int]],
                    slice_size: int) -> DataFrame:
    """MESR of the first slice's worth of in-sensor events under several declared sensors.

    Dropping out-of-sensor events moves later slices, so positions are taken per sensor from
    kept counts, never by sorting a recording.
    """
    masks = [f"s{w}x{h}" for w, h in sensors]
    flagged = events.select("*", *[
        ((F.col("x") < w) & (F.col("y") < h)).alias(m) for m, (w, h) in zip(masks, sensors)])
    return mesr_of_masks(flagged, masks, slice_size, block=max(slice_size, 1024))


def occupancy(events: DataFrame, sensors: DataFrame, slice_size: int) -> DataFrame:
    """Occupied share of the sensor and thinned occupancy per occupied pixel, first slice."""
    d = decompose_first_slice(events, slice_size)
    return d.join(sensors, KEY).select(
        KEY, "n_events", "occupied_px", "ntss", "ln", "esr",
        (F.col("occupied_px") / (F.col("width") * F.col("height"))).alias("occupied_share"),
        (F.col("ln") / F.col("occupied_px")).alias("ln_per_occupied"))


def esr_v2(events: DataFrame, sensors: DataFrame, slice_size: int) -> DataFrame:
    """The median-filtered variant next to the plain ESR, per complete slice.

    Each occupied pixel offers its count to the nine pixels around it; the median of nine is
    the fifth smallest, and targets with fewer than five non-zero offers are zero.
    """
    keys = [KEY, "slice"]
    sliced = events.withColumn("slice", div("event_idx", slice_size))
    # every pixel is offered nine times
    counts = (spread(sliced.select(*keys, "x", "y"), keys, events, PIECE // 8)
              .groupBy(*keys, "x", "y").agg(F.count("*").alias("n")))
    plain = counts.groupBy(*keys).agg(F.sum("n").alias("n_events"), *esr_terms("n", slice_size))
    plain = plain.where(F.col("n_events") == slice_size).withColumn("esr", esr())
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                        for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    offers = (counts.join(sensors, KEY).select("*", F.inline(offsets))
              .select(*keys, "width", "height", "n", (F.col("x") + F.col("dx")).alias("x"),
                      (F.col("y") + F.col("dy")).alias("y"))
              .where((F.col("x") >= 0) & (F.col("y") >= 0)
                     & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))))
    filtered = (offers.groupBy(*keys, "x", "y")
                .agg(F.array_sort(F.collect_list("n")).alias("ns"),
                     F.first("width").alias("width"), F.first("height").alias("height"))
                .where(F.size("ns") >= 5)
                .withColumn("n", F.element_at("ns", F.size("ns") - 4)))
    v2 = filtered.groupBy(*keys).agg(
        F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.sum(1.0 - F.pow(F.lit(0.5), F.col("n"))).alias("occ"),
        F.first(F.col("width") * F.col("height")).alias("k"))
    joined = plain.join(v2, keys, "left")
    ratio = F.sqrt(F.col("squares") / (F.col("n_events") * F.col("n_events"))
                   * (F.col("occ") / F.col("k")))
    return joined.select(*keys, "n_events", "esr",
                         F.coalesce(1000.0 * ratio, F.lit(0.0)).alias("esr_v2"))


def esr_v2_survey(v2: DataFrame, corpus: str) -> DataFrame:
    """Variant-to-plain ratios over every slice that scores, of every recording: per corpus, with
    the factor ``1000 / sqrt(pixels)`` that would be the ratio if only the scale differed, and over all
    (corpus ``overall``). ``v2`` has the sensor's ``pixels``."""
    usable = v2.where(F.col("esr") > 0).withColumn("ratio", F.col("esr_v2") / F.col("esr"))
    return usable.rollup(corpus).agg(
        F.when(F.grouping(corpus) == 0, 1000.0 / F.sqrt(F.max("pixels"))).alias("thousand_over_sqrt_k"),
        F.grouping(corpus).alias("_all"),
        F.count("*").alias("slices"), F.percentile("ratio", F.lit(0.5)).alias("ratio_median"),
        F.min("ratio").alias("ratio_min"), F.max("ratio").alias("ratio_max"),
        F.count_if(F.col("ratio") == 0).alias("collapsed"),
        (F.log10(F.max("ratio") / F.min(F.when(F.col("ratio") > 0, F.col("ratio")))))
        .alias("spread_log10")).where("slices > 0").withColumn(
        corpus, F.when(F.col("_all") == 1, "overall").otherwise(F.col(corpus))).drop("_all")


def permute_pixels(events: DataFrame, a: int, b: int, width: int, height: int) -> DataFrame:
    """Relabel pixels by ``(a*px + b) mod K``, a bijection when a and K share no factor."""
    k = width * height
    if gcd(a, k) != 1:
        raise ValueError("the multiplier must be coprime to the pixel count")
    px = ((F.col("y") * width + F.col("x")) * a + b) % k
    return events.withColumns({"x": (px % width).cast("int"),
                               "y": div(px.cast("bigint"), width).cast("int")})


def majorises_next(events: DataFrame, slice_size: int) -> DataFrame:
    """Does the sorted count vector of each slice majorise that of the next one?

    Compared over the ranks both slices occupy; windows are slice-sized.
    """
    keys = [KEY, "slice"]
    sliced = events.withColumn("slice", div("event_idx", slice_size))
    counts = spread(sliced, keys, events).groupBy(*keys, "x", "y").agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys).orderBy(F.desc("n"), "x", "y")
    run = counts.select(*keys, F.row_number().over(w).alias("i"), F.sum("n").over(
        w.rowsBetween(W.unboundedPreceding, 0)).alias("cum"),
        F.sum("n").over(W.partitionBy(*keys)).alias("total")).where(F.col("total") == slice_size)
    following = run.select(KEY, (F.col("slice") - 1).alias("slice"), "i", F.col("cum").alias("cum2"))
    return run.join(following, [*keys, "i"]).groupBy(*keys).agg(
        (F.min(F.col("cum") - F.col("cum2")) >= 0).alias("majorises_next"),
        F.count("*").alias("ranks"))
