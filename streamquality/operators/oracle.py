"""Filters' own outputs against block-matched controls: the label oracle and a random draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import priority
from ..functions.numeric import blind, div, esr, esr_terms, pixel, quota
from ..schema import NATIVE_GRID_STEP, NATIVE_REL_TOL
from .order import PIECE, block_of, scored_events, spread, with_mask_positions

KEY = "recording_id"
WIN_MARGIN = 1e-12


def matched_positions(events: DataFrame, masks: list[str], slice_size: int, block: int,
                      seed: int, algorithm: str = "xxhash64") -> DataFrame:
    """Long (event, method, side, pos): each filter's scored prefix and its two controls.

    Both controls keep, in every block, as many events as the prefix does there: ``oracle``
    takes labelled signal first and then earliest arrivals, ``null`` draws uniformly. They
    share the prefix's block offsets, so nothing beyond block-sized windows is sorted.
    """
    placed = with_mask_positions(events, masks, block)
    part = W.partitionBy(KEY, "block")
    ranked = placed.select(
        "*", F.row_number().over(part.orderBy("label", "event_idx")).alias("_oracle"),
        *[(F.coalesce(F.col(f"{m}_pos"), F.lit(-1)).between(
            0, scored_events(F.col(f"{m}_total"), slice_size) - 1)).alias(f"_pre_{m}")
          for m in masks],
        *[priority(seed, F.col(KEY), F.lit(m), F.col("event_idx"), algorithm=algorithm)
          .alias(f"_prio_{m}") for m in masks])
    ranked = ranked.select("*", *[F.sum(F.col(f"_pre_{m}").cast("int")).over(part).alias(f"_a_{m}")
                                  for m in masks])
    for m in masks:
        ranked = ranked.withColumn(f"_null_{m}", F.row_number().over(
            part.orderBy(f"_prio_{m}", "event_idx")))
    run = part.orderBy("event_idx").rowsBetween(W.unboundedPreceding, 0)
    sides = {}
    for m in masks:
        sides[m, "oracle"] = F.col("_oracle") <= F.col(f"_a_{m}")
        sides[m, "null"] = F.col(f"_null_{m}") <= F.col(f"_a_{m}")
    placed = ranked.select("*", *[F.sum(c.cast("int")).over(run).alias(f"_run_{m}_{s}")
                                  for (m, s), c in sides.items()])
    cells = [F.struct(F.lit(m).alias("method"), F.lit("filter").alias("side"),
                      F.when(F.col(f"_pre_{m}"), F.col(f"{m}_pos")).alias("pos")) for m in masks]
    cells += [F.struct(F.lit(m).alias("method"), F.lit(s).alias("side"),
                       F.when(c, F.col(f"{m}_before") + F.col(f"_run_{m}_{s}") - 1).alias("pos"))
              for (m, s), c in sides.items()]
    return placed.select(*events.columns, "block", F.inline(F.array(*cells))).where(
        F.col("pos").isNotNull())


def native_cells(events: DataFrame, masks: list[str], slice_size: int, block: int, seed: int,
                 algorithm: str = "xxhash64") -> DataFrame:
    """One row per (recording, method): native output, oracle and null at equal block counts.

    Methods whose output is shorter than a slice have NULL scores and ``scored`` 0.
    """
    long = matched_positions(events, masks, slice_size, block, seed, algorithm).select(
        KEY, "method", "side", div("pos", slice_size).alias("slice"), pixel().alias("px"),
        (1 - F.col("label")).alias("_signal"))
    group = [KEY, "method", "side", "slice"]
    per = (spread(long, group, events, PIECE // 2).groupBy(*group, "px")
           .agg(F.count("*").alias("n"), F.sum("_signal").alias("_signal"))
           .groupBy(*group).agg(F.sum("n").alias("n"), F.sum("_signal").alias("tp"),
                                *esr_terms("n", slice_size)).withColumn("esr", esr()))

    def of(side: str, column: str, fn) -> Column:
        return fn(F.when(F.col("side") == side, F.col(column)))

    scored = per.groupBy(KEY, "method").agg(
        of("filter", "n", F.sum).alias("scored"), of("filter", "esr", F.avg).alias("mesr"),
        of("oracle", "esr", F.avg).alias("oracle_mesr"), of("null", "esr", F.avg).alias("null_mesr"),
        of("filter", "tp", F.sum).alias("tp"), of("oracle", "tp", F.sum).alias("oracle_tp"),
        of("oracle", "n", F.sum).alias("oracle_scored"), of("null", "n", F.sum).alias("null_scored"))
    flags = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("kept")) for m in masks])
    totals = events.select(KEY, "label", F.inline(flags)).groupBy(KEY, "method").agg(
        F.count("*").alias("n_events"), F.count_if("kept").alias("native_kept"),
        F.count_if(F.col("label") == 0).alias("n_signal"),
        F.count_if(F.col("label") == 1).alias("n_noise"))
    cells = totals.join(scored, [KEY, "method"], "left").withColumn(
        "scored", F.coalesce("scored", F.lit(0)))
    return cells.withColumns({
        "native_retention": F.col("native_kept") / F.col("n_events"),
        "fp": F.col("scored") - F.col("tp"),
        "mesr_win": F.col("mesr") - F.col("oracle_mesr") > WIN_MARGIN,
        "label_class": label_class("tp", "oracle_tp"),
        "signal_retention": F.try_divide("tp", "n_signal"),
        "oracle_signal_retention": F.try_divide("oracle_tp", "n_signal"),
    })


def label_class(tp: str, oracle_tp: str) -> Column:
    """Signal kept against the oracle's at equal counts; ``impossible`` must never occur."""
    return (F.when(F.col(tp) < F.col(oracle_tp), "strict")
            .when(F.col(tp) == F.col(oracle_tp), "tie")
            .when(F.col(tp) > F.col(oracle_tp), "impossible"))


def oracle_bound(events: DataFrame, masks: list[str], slice_size: int, block: int) -> DataFrame:
    """Sum over blocks of min(accepted, available signal): what the oracle must retain."""
    placed = with_mask_positions(events, masks, block)
    per = placed.groupBy(KEY, "block").agg(
        F.count_if(F.col("label") == 0).alias("signal"),
        *[F.count_if(F.col(f"{m}_pos") < scored_events(F.col(f"{m}_total"), slice_size)).alias(m)
          for m in masks])
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("a_b")) for m in masks])
    return per.select(KEY, "signal", F.inline(cells)).groupBy(KEY, "method").agg(
        F.sum(F.least("a_b", "signal")).alias("bound"))


def reversal_summary(cells: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Cells, strict cells and reversals per method and in total (method NULL)."""
    scored = F.col("scored") > 0
    strict = F.col("label_class") == "strict"
    return cells.rollup(dataset, "method").agg(
        F.count_if(scored).alias("cells"), F.count_if(~scored).alias("unevaluable"),
        F.count_if(strict).alias("strict"), F.count_if(strict & F.col("mesr_win")).alias("reversals"),
        F.count_if(F.col("label_class") == "tie").alias("tie"),
        F.count_if(F.col("label_class") == "impossible").alias("impossible")
    ).where(F.col(dataset).isNotNull())


def method_pairs(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both values of every pair of methods a < b that share the keys."""
    a = values.select(*keys, F.col("method").alias("a"), F.col(value).alias("value_a"))
    b = values.select(*keys, F.col("method").alias("b"), F.col(value).alias("value_b"))
    return a.join(b, keys).where(F.col("a") < F.col("b"))


def widest_filter_gap(cells: DataFrame, dataset: str = "dataset") -> DataFrame:
    """The method pair with the largest mean paired difference."""
    pairs = method_pairs(cells.where(F.col("mesr").isNotNull()), [dataset, KEY], "mesr")
    means = pairs.groupBy(dataset, "a", "b").agg(
        F.avg(F.col("value_a") - F.col("value_b")).alias("diff"), F.count("*").alias("n_recordings"))
    best = means.groupBy(dataset).agg(F.min_by(
        F.struct("a", "b", "diff", "n_recordings"), F.struct(-blind(F.abs("diff")), "a", "b")).alias("w"))
    up = F.col("w.diff") >= 0
    return best.select(dataset, F.abs("w.diff").alias("gap"),
                       F.when(up, F.col("w.a")).otherwise(F.col("w.b")).alias("higher"),
                       F.when(up, F.col("w.b")).otherwise(F.col("w.a")).alias("lower"),
                       F.col("w.n_recordings").alias("n_recordings"))


# --- matched retention over the grid ---------------------------------------------------------

def grid_pairs(curve: DataFrame, oracle: str, exclude: list[str]) -> DataFrame:
    """Every method's evaluable cell next to the oracle's at the same retention."""
    keys = ["dataset", KEY, "r_pct"]
    base = curve.where((F.col("method") == oracle) & F.col("evaluable")).select(
        *keys, F.col("mesr").alias("oracle_mesr"), F.col("tp").alias("oracle_tp"),
        F.col("scored_tp").alias("oracle_tp_scored"), F.col("kept_events").alias("oracle_kept"),
        F.col("scored_events").alias("oracle_scored"))
    cells = curve.where(F.col("evaluable") & ~F.col("method").isin(oracle, *exclude))
    return cells.join(base, keys).withColumns({
        "mesr_win": F.col("mesr") - F.col("oracle_mesr") > WIN_MARGIN,
        "label_class": label_class("scored_tp", "oracle_tp_scored"),
        "label_class_full_mask": label_class("tp", "oracle_tp"),
        "scored_fraction": F.col("scored_events") / F.col("kept_events"),
        "counts_match": (F.col("kept_events") == F.col("oracle_kept"))
        & (F.col("scored_events") == F.col("oracle_scored")),
    })


def eligible(native: Column, r: Column, step: float = NATIVE_GRID_STEP,
             rel: float = NATIVE_REL_TOL) -> Column:
    """May grid retention ``r`` stand in for ``native``? False where either is undefined."""
    gap = F.abs(r - native)
    return F.coalesce((gap <= step + 1e-9) & (gap <= rel * native + 1e-12), F.lit(False))


def nearest_point(points: DataFrame, keys: list[str], target: str, extra: list[str]) -> DataFrame:
    """The point of each group nearest ``target``; the smaller retention wins a tie."""
    gap = F.abs(F.col("r_pct") / 100.0 - F.col(target))
    best = F.min_by(F.struct("r_pct", *extra), F.struct(F.round(gap, 12), F.col("r_pct")))
    return points.where(F.col(target).isNotNull()).groupBy(*keys, target).agg(
        best.alias("_p")).select(*keys, target, "_p.*")


def tally(cells: DataFrame, *keys: str) -> DataFrame:
    """Wins over the oracle by label class on both domains, with the scored share's range."""
    win = F.col("mesr_win")

    def won(column: str, name: str) -> Column:
        return F.count_if(win & (F.col(column) == name))

    return cells.groupBy(*keys).agg(
        F.count("*").alias("cells"), F.count_if(win).alias("mesr_wins"),
        won("label_class", "strict").alias("strict"), won("label_class", "tie").alias("tie"),
        won("label_class", "impossible").alias("impossible"),
        won("label_class_full_mask", "strict").alias("full_strict"),
        won("label_class_full_mask", "tie").alias("full_tie"),
        won("label_class_full_mask", "impossible").alias("full_impossible"),
        F.min("scored_fraction").alias("fraction_min"),
        F.percentile("scored_fraction", F.lit(0.5)).alias("fraction_median"),
        F.max("scored_fraction").alias("fraction_max"))


def oracle_violations(best: DataFrame, oracle: str, grid_step: float) -> DataFrame:
    """Each side at its own maximum: an unmatched comparison kept as a secondary number.

    ``best`` holds dataset, recording, method, r_star, mesr_star, native_retention, is_null.
    """
    keys = ["dataset", KEY]
    o = best.where(F.col("method") == oracle).select(*keys, F.col("mesr_star").alias("oracle_star"))
    cells = best.where((F.col("method") != oracle) & ~F.col("is_null")).join(o, keys).withColumn(
        "margin", F.col("mesr_star") - F.col("oracle_star"))
    beats = F.col("margin") > WIN_MARGIN
    near = F.abs(F.col("r_star") - F.col("native_retention")) <= grid_step + 1e-9
    return cells.groupBy("dataset").agg(
        F.count("*").alias("comparable_cells"), F.count_if(beats).alias("cells_beating_oracle"),
        F.count_if(beats & F.coalesce(near, F.lit(False))).alias("violations_at_native"),
        F.max("margin").alias("max_margin"), F.avg("margin").alias("mean_margin"),
        F.min_by(F.when(beats, F.col("method")), F.struct(-blind("margin"), "method")).alias("worst_method"))


# --- native mask against the swept mask ------------------------------------------------------

def compare_masks(events: DataFrame, masks: list[str], share: dict[str, Column],
                  block: int) -> DataFrame:
    """Native mask against the block-quota mask at ``share`` (a column of each recording).

    Per block the two differ by exactly |accepted - quota|, because the quota takes accepted
    events first; ``symmetric_difference`` counts events and checks that identity.
    """

    tagged = spread(events.withColumn("block", block_of(block)), [KEY, "block"], events)
    part = W.partitionBy(KEY, "block")
    ranked = tagged.select("*", F.count("*").over(part).alias("n_b"), *[
        F.row_number().over(part.orderBy(F.when(F.col(m), 0).otherwise(1), "event_idx"))
        .alias(f"_rk_{m}") for m in masks])
    blocks = ranked.groupBy(KEY, "block").agg(F.first("n_b").alias("n_b"), *[
        F.count_if(F.col(m)).alias(f"a_{m}") for m in masks], *[
        F.count_if(F.col(m) != (F.col(f"_rk_{m}") <= quota(F.col("n_b"), share[m])))
        .alias(f"d_{m}") for m in masks], *[
        F.first(quota(F.col("n_b"), share[m])).alias(f"k_{m}") for m in masks])
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"a_{m}").alias("a_b"),
                               F.col(f"k_{m}").alias("k_b"), F.col(f"d_{m}").alias("diff"))
                      for m in masks])
    long = blocks.select(KEY, "n_b", F.inline(cells))
    return long.groupBy(KEY, "method").agg(
        F.sum("n_b").alias("n_events"), F.count("*").alias("n_blocks"),
        F.sum("a_b").alias("native_kept"), F.sum("k_b").alias("swept_kept"),
        F.sum("diff").alias("symmetric_difference"),
        (F.sum("diff") / F.greatest(F.lit(1), F.sum("a_b"))).alias("symmetric_difference_share"),
        F.sum(F.abs(F.col("a_b") - F.col("k_b"))).alias("predicted_by_block_identity"),
        F.count_if(F.col("k_b") > F.col("a_b")).alias("blocks_reintroducing_rejects"),
        (F.avg("a_b") / block).alias("accept_mean"), (F.stddev_pop("a_b") / block).alias("accept_sd"),
        (F.min("a_b") / block).alias("accept_min"), (F.max("a_b") / block).alias("accept_max"))


def mask_survey(exact: DataFrame, grid: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Medians and maxima of both comparisons, exact recoveries and the block identity."""
    keys = [dataset, KEY, "method"]
    share = "symmetric_difference_share"
    both = exact.select(*keys, F.col(share).alias("exact"),
                        (F.col("symmetric_difference") == F.col("predicted_by_block_identity"))
                        .alias("same")).join(
        grid.select(*keys, F.col(share).alias("grid"), "eligible"), keys)
    return both.groupBy(dataset).agg(
        F.count("*").alias("cells"), F.count_if("eligible").alias("eligible"),
        F.percentile("exact", F.lit(0.5)).alias("exact_median"), F.max("exact").alias("exact_max"),
        F.count_if(F.col("exact") == 0).alias("exact_recoveries"),
        F.percentile("grid", F.lit(0.5)).alias("grid_median"), F.max("grid").alias("grid_max"),
        F.bool_and("same").alias("identity_holds"))
