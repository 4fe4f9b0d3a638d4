"""Rank statistics as aggregations over average ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.order import running_sums
from .numeric import safe_corr


def distinct_ranks(df: DataFrame, keys: list[str], value: str, out: str,
                   counts: dict[str, Column] | None = None) -> DataFrame:
    """Average rank of every distinct ``value`` within ``keys``, with its row counts.

    Distinct values are range-partitioned by (keys, value) and ranked by running sums over the
    ranges, so ranges are balanced however the values lie. Ties, however many, are one row
    (counted on the map side), and no task sorts a whole group. ``counts`` adds conditional row
    counts.
    """
    extra = [c.alias(n) for n, c in (counts or {}).items()]
    values = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("_c"), *extra)
    placed = running_sums(values, keys, [value], ["_c"], "ranks", df)
    return placed.select(*keys, value, *(counts or {}), F.col("_c").alias(f"{out}_ties"),
                         (F.col("_c_before") + (F.col("_c") + 1) / 2.0).alias(out))


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Add the average rank of ``value`` within ``keys``; rows with NULL values are dropped."""
    return df.join(distinct_ranks(df, keys, value, out), [*keys, value])


def small_group_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average ranks by window, for groups bounded by the design (methods, levels, retentions)."""
    w = W.partitionBy(*keys)
    ties = F.count("*").over(W.partitionBy(*keys, value))
    return (df.where(F.col(value).isNotNull()).withColumn(f"{out}_ties", ties)
            .withColumn(out, F.rank().over(w.orderBy(value)) + (F.col(f"{out}_ties") - 1) / 2.0))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, small: bool = False) -> DataFrame:
    """Spearman rho per group; NULL below 3 pairs or when one side is constant."""
    rank = small_group_ranks if small else average_ranks
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rank(rank(both, keys, x, "_rx"), keys, y, "_ry")
    flat = (F.min("_rx") == F.max("_rx")) | (F.min("_ry") == F.max("_ry"))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.when((F.count("*") >= 3) & ~flat, safe_corr("_rx", "_ry")).alias("rho"))


def kendall(df: DataFrame, keys: list[str], item: str, x: str, y: str) -> DataFrame:
    """Kendall tau-b per group of ``item`` (methods: a group bounded by the method table)."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a = both.select(*keys, F.col(item).alias("_i"), F.col(x).alias("_xa"), F.col(y).alias("_ya"))
    b = both.select(*keys, F.col(item).alias("_j"), F.col(x).alias("_xb"), F.col(y).alias("_yb"))
    sx, sy = F.signum(F.col("_xa") - F.col("_xb")), F.signum(F.col("_ya") - F.col("_yb"))
    pairs = a.join(b, keys).where(F.col("_i") < F.col("_j"))
    score = F.sum(sx * sy)
    dx, dy = F.count_if(sx != 0), F.count_if(sy != 0)
    return pairs.groupBy(*keys).agg(
        F.when((dx > 0) & (dy > 0), score / F.sqrt(dx * dy)).alias("tau"),
        F.count_if(sx * sy < 0).alias("discordant"), F.count("*").alias("pairs"))


def _tie_sum() -> Column:
    """Sum of t^3 - t over tie groups, from one row per distinct value."""
    t = F.col("_r_ties").cast("double")
    return F.sum(t * t * t - t)


def mann_whitney(df: DataFrame, keys: list[str], first: str, value: str) -> DataFrame:
    """U of the rows where ``first`` is true, rank-biserial effect and the normal z."""
    ranked = distinct_ranks(df, keys, value, "_r", {
        "_a": F.count_if(F.col(first)), "_b2": F.count_if(~F.col(first))})
    v, a, b = F.col(value), F.col("_a"), F.col("_b2")
    agg = ranked.groupBy(*keys).agg(
        F.sum("_a").alias("n1"), F.sum("_b2").alias("n2"), F.sum(a * F.col("_r")).alias("_r1"),
        F.try_divide(F.sum(a * v), F.sum("_a")).alias("mean_first"),
        F.try_divide(F.sum(b * v), F.sum("_b2")).alias("mean_second"), _tie_sum().alias("_ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    enough = (n1 >= 2) & (n2 >= 2)
    u = F.col("_r1") - n1 * (n1 + 1) / 2.0
    mean = n1 * n2 / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    gap = F.abs(u - mean)
    return agg.select(
        *keys, "n1", "n2", "mean_first", "mean_second", F.when(enough, u).alias("u"),
        F.when(enough, 1.0 - 2.0 * u / (n1 * n2)).alias("rank_biserial"),
        F.when(enough & (sd > 0), F.greatest(gap - 0.5, F.lit(0.0)) / sd).alias("z"))


def friedman(df: DataFrame, keys: list[str], block: str, treatments: int,
             value: str) -> DataFrame:
    """Friedman chi-square with tie correction; ranks are taken inside each block."""
    ranked = small_group_ranks(df, [*keys, block], value, "_r")
    k = treatments
    totals = ranked.groupBy(*keys, "level").agg(
        F.sum("_r").alias("_sum"), F.count("*").alias("_n"),
        F.sum(F.col("_r_ties").cast("double") * F.col("_r_ties") - 1).alias("_ties"))
    n = F.max("_n")
    raw = 12.0 / (n * k * (k + 1)) * F.sum(F.col("_sum") * F.col("_sum")) - 3.0 * n * (k + 1)
    correction = 1.0 - F.sum("_ties") / (n * (k * (k * k - 1)))
    return totals.groupBy(*keys).agg(n.alias("blocks"),
                                     F.when(correction > 0, raw / correction).alias("chi2"))


def wilcoxon(df: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """Signed-rank sums of non-zero differences and the normal z."""
    moved = df.where(F.col(diff) != 0).withColumn("_abs", F.abs(F.col(diff)))
    ranked = distinct_ranks(moved, keys, "_abs", "_r", {
        "_up": F.count_if(F.col(diff) > 0), "_down": F.count_if(F.col(diff) < 0)})
    agg = ranked.groupBy(*keys).agg(
        F.sum("_r_ties").alias("n"), F.sum(F.col("_up") * F.col("_r")).alias("w_plus"),
        F.sum(F.col("_down") * F.col("_r")).alias("w_minus"), _tie_sum().alias("_ties"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0)
    return agg.select(*keys, "n", F.least("w_plus", "w_minus").alias("w"), "w_plus", "w_minus",
                      F.when(sd > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4.0) / sd)
                      .alias("z"))


def roc_auc(df: DataFrame, keys: list[str], positive: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sum; ties count half."""
    ranked = distinct_ranks(df, keys, score, "_r", {
        "_p": F.count_if(F.col(positive)), "_q": F.count_if(~F.col(positive))})
    n1, n0 = F.sum("_p"), F.sum("_q")
    return ranked.groupBy(*keys).agg(
        F.sum("_r_ties").alias("n"), F.try_divide(
            F.sum(F.col("_p") * F.col("_r")) - n1 * (n1 + 1) / 2.0, n1 * n0).alias("auc"))


def partial_spearman(df: DataFrame, keys: list[str], x: str, y: str, control: str,
                     small: bool = False) -> DataFrame:
    """Spearman rho of x and y given a control; NULL below 4 rows or when collinear."""
    rank = small_group_ranks if small else average_ranks
    rows = df
    for c, name in ((x, "_rx"), (y, "_ry"), (control, "_rc")):
        rows = rank(rows, keys, c, name)
    flat = [F.min(c) == F.max(c) for c in ("_rx", "_ry", "_rc")]
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), safe_corr("_rx", "_ry").alias("_xy"),
        safe_corr("_rx", "_rc").alias("_xc"), safe_corr("_ry", "_rc").alias("_yc"),
        (flat[0] | flat[1] | flat[2]).alias("_flat"))
    denominator = F.sqrt(F.greatest(1 - F.col("_xc") * F.col("_xc"), F.lit(0.0))
                         * F.greatest(1 - F.col("_yc") * F.col("_yc"), F.lit(0.0)))
    ok = (F.col("n") >= 4) & ~F.col("_flat") & (denominator >= 1e-12)
    return agg.select(*keys, "n", F.when(ok, (
        F.col("_xy") - F.col("_xc") * F.col("_yc")) / denominator).alias("rho"))


def rho_t(rho: Column, n: Column, controls: int = 0) -> Column:
    """The t statistic of a (partial) rank correlation."""
    return rho * F.sqrt((n - 2 - controls) / F.greatest(1 - rho * rho, F.lit(2.2e-16)))
