"""Tests on recording profiles: two-group, leave-one-out, matched levels, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ranks
from ..functions.tails import chi2_sf, two_sided_normal

# The registered separation bar.
P_BAR = 0.01
EFFECT_BAR = 0.8


def two_group(profiles: DataFrame, keys: list[str], first: str, value: str) -> DataFrame:
    """Mann-Whitney U, rank-biserial effect and the separation verdict per group of keys."""
    known = profiles.where(F.col(value).isNotNull())
    return ranks.mann_whitney(known, keys, first, value)


def with_separation(tested: DataFrame) -> DataFrame:
    """Add the p-value (normal approximation, tie-corrected) and the verdict."""
    return tested.withColumn("p_value", two_sided_normal("z")).withColumn(
        "separates", (F.col("p_value") < P_BAR) & (F.abs("rank_biserial") > EFFECT_BAR))


def long_stats(profiles: DataFrame, ids: list[str], stats: list[str]) -> DataFrame:
    """Profiles as (ids, stat, value) rows."""
    return profiles.unpivot(ids, [F.col(s).cast("double").alias(s) for s in stats], "stat", "value")


def corpus_means(profiles: DataFrame, corpus: str, stats: list[str]) -> DataFrame:
    """Per-corpus means that skip undefined values."""
    return profiles.groupBy(corpus).agg(F.count("*").alias("recordings"),
                                        *[F.avg(s).alias(s) for s in stats])


def leave_one_out(profiles: DataFrame, corpus: str, corpora: list[str]) -> DataFrame:
    """Every profile once per corpus left out; ``corpora`` is the configured list."""
    every = F.array(*[F.lit(c) for c in corpora])
    return profiles.withColumn("dropped", F.explode(F.array_except(every, F.array(corpus))))


def matched_levels(cells: DataFrame, scene: str, level: str, levels: list, value: str) -> DataFrame:
    """Scenes holding every level, one column per level; a NULL value fails the job."""
    wide = cells.groupBy(scene).pivot(level, levels).agg(F.first(F.struct(F.col(value).alias("v"))))
    full = wide.na.drop(subset=[str(x) for x in levels])

    def checked(name: str) -> Column:
        v = F.col(f"`{name}`.v")
        return F.when(v.isNull(), F.raise_error(F.lit("undefined value in a matched design"))
                      .cast("double")).otherwise(v).alias(f"l{name}")

    return full.select(scene, *[checked(str(x)) for x in levels])


def level_rows(matched: DataFrame, scene: str, levels: list) -> DataFrame:
    return matched.unpivot([scene], [f"l{x}" for x in levels], "level", "value")


def per_level(matched: DataFrame, scene: str, levels: list) -> DataFrame:
    return level_rows(matched, scene, levels).groupBy("level").agg(
        F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("median"),
        F.avg("value").alias("mean"), F.percentile("value", F.lit(0.25)).alias("q25"),
        F.percentile("value", F.lit(0.75)).alias("q75"))


def level_contrast(matched: DataFrame, scene: str, levels: list) -> DataFrame:
    """One row: Friedman chi-square, first-to-last signed ranks, rising and monotone scenes."""
    tag = F.lit(1).alias("_g")
    rows = level_rows(matched, scene, levels).select("*", tag)
    chi = ranks.friedman(rows, ["_g"], scene, len(levels), "value")
    cols = [f"l{x}" for x in levels]
    diff = matched.select(tag, (F.col(cols[0]) - F.col(cols[-1])).alias("d"))
    signed = ranks.wilcoxon(diff, ["_g"], "d")
    rising = F.lit(True)
    for a, b in zip(cols, cols[1:]):
        rising = rising & (F.col(b) > F.col(a))
    shape = matched.groupBy(tag).agg(
        F.count_if(F.col(cols[-1]) > F.col(cols[0])).alias("scenes_rising"),
        F.count_if(rising).alias("scenes_monotone"))
    return chi.join(signed, "_g", "left").join(shape, "_g").select(
        "blocks", "chi2", "w", "w_plus", "w_minus", "z", "scenes_rising", "scenes_monotone")


def with_level_p(contrast: DataFrame, levels: int) -> DataFrame:
    return contrast.withColumn("friedman_p", chi2_sf("chi2", F.lit(levels - 1))).withColumn(
        "wilcoxon_p", two_sided_normal("z"))


def containment(cells: DataFrame, inner: Column, outer: Column, value: str) -> DataFrame:
    """Share of the inner group's values inside the outer group's range."""
    bounds = cells.where(outer).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    inside = cells.where(inner).join(F.broadcast(bounds))
    return inside.groupBy("lo", "hi").agg(
        F.count("*").alias("n"), F.min(value).alias("inner_min"), F.max(value).alias("inner_max"),
        F.avg(F.col(value).between(F.col("lo"), F.col("hi")).cast("double")).alias("share_inside"))


def groupings(profiles: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
    """Profiles once per grouping rule (true, false or NULL = left out), as ``first``."""
    cells = F.array(*[F.struct(F.lit(g).alias("grouping"), rule.alias("first"))
                      for g, rule in rules.items()])
    return profiles.select("*", F.inline(cells)).where(F.col("first").isNotNull())


def duplicate_names(profiles: DataFrame, name: str) -> DataFrame:
    """Names that occur more than once; must be empty before groups are compared."""
    return profiles.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def blank_signature(profiles: DataFrame, corpus: str, blank: str, stats: list[str]) -> DataFrame:
    """Per corpus: the blank's median share against that corpus's mean, and undefined counts."""
    own = profiles.where(F.col(corpus) == blank).agg(
        F.percentile("hot_pixel_share", F.lit(0.5)).alias("blank_median"),
        F.min("hot_pixel_share").alias("blank_min"), F.max("hot_pixel_share").alias("blank_max"))
    others = profiles.groupBy(corpus).agg(
        F.avg("hot_pixel_share").alias("share_mean"),
        *[F.count_if(F.col(s).isNull()).alias(f"undefined_{s}") for s in stats])
    return others.join(F.broadcast(own)).withColumn(
        "ratio", F.col("blank_median") / F.col("share_mean"))
