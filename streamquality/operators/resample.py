"""Bootstrap intervals, repetition draws and paired accuracy tests.

A cluster bootstrap draws by multiplicity vectors: how often a draw picks each cluster, by hash of
draw and slot, so the work spreads over pieces of the draws and any piece can be recomputed on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import md5
from ..functions.hashing import pick
from ..schema import SEED
from ..staging import attach, stage

DRAWS = 10_000
PIECE = 200  # draws that a piece has at least
PICKS = 1 << 21  # picks that a task makes at least, and a piece unless it would have fewer draws
CELLS = 1 << 20  # multiplicities held at a time
SHARED = 64  # groups that share the multiplicities of a piece
HELD = 1 << 22  # clusters that these groups have together
ZERO = 1e-12  # below this a bound is rounding residue of an exact zero


def _picks(draws: np.ndarray, k: int, seed: int, algorithm: str) -> np.ndarray:
    """For each draw and slot, which of ``k`` clusters is picked; the same for all groups of ``k`` clusters."""
    if algorithm == "md5":
        return (md5.numbers(seed, draws, k) % np.uint32(k)).astype(np.int64)
    x = (draws.astype(np.uint64)[:, None] << np.uint64(32)) + np.arange(k, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.int64) % k


def _draw_means(seed: int, algorithm: str):
    """Means of a piece of the draws, from the clusters' sums and sizes: each cluster's multiplicity
    in a draw is how often a slot picks it, and a draw's mean weighs the clusters by it. Groups of
    equally many clusters that follow each other share the multiplicities."""
    def weighed(first: int, stop: int, groups: list) -> np.ndarray:
        k, n = len(groups[0][0]), len(groups)
        cells = np.array([c for pair in zip(*groups) for c in pair], float).T
        means = np.empty((stop - first, n))
        step = max(1, CELLS // k)
        for at in range(first, stop, step):
            piece = np.arange(at, min(at + step, stop))
            picks = _picks(piece, k, seed, algorithm) + np.arange(len(piece))[:, None] * k
            times = np.bincount(picks.ravel(), minlength=len(piece) * k).reshape(len(piece), k)
            both = times.astype(float) @ cells
            means[at - first:at - first + len(piece)] = both[:, :n] / both[:, n:]
        return means.T

    def run(batches):
        names, held, piece = [], [], None

        def done():
            means = weighed(*piece, [own for *_, own in held])
            ends = pa.array(np.arange(len(held) + 1) * means.shape[1], pa.int32())
            rows = [pa.concat_arrays([batch.column(c).slice(i, 1) for batch, i, _ in held]) for c in names]
            yield pa.RecordBatch.from_arrays([*rows, pa.ListArray.from_arrays(ends, pa.array(means.ravel()))], [*names, "_means"])
            held.clear()
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("_first", "_stop", "_sums", "_sizes")]
            sums, sizes = batch.column("_sums"), batch.column("_sizes")
            for i, span in enumerate(zip(batch.column("_first").to_pylist(), batch.column("_stop").to_pylist())):
                own = sums[i].values.to_numpy(zero_copy_only=False), sizes[i].values.to_numpy(zero_copy_only=False)
                k = len(own[0])
                if held and (span != piece or k != len(held[0][2][0]) or (len(held) + 1) * k > max(HELD, k)):
                    yield from done()
                piece = span
                held.append((batch, i, own))
        if held:
            yield from done()
    return run


def _dealt(packed: DataFrame, group: list[str], draws: int) -> DataFrame:
    """A row for each group and piece of the draws, ``_first`` to ``_stop - 1``, dealt out by the picks to be
    made, a mean counting as one: pieces of as many clusters go round the tasks, and groups share them by hash."""
    units, picks, kinds = 0, 0, []
    for k, n in sorted(map(tuple, packed.groupBy("n_clusters").count().collect())):
        pieces = max(1, min(-(-draws // PIECE), draws * k // PICKS))
        shares = -(-n // max(1, min(SHARED, HELD // k)))
        kinds.append((k, -(-draws // pieces), shares, units))
        units, picks = units + pieces * shares, picks + draws * (k * shares + n)
    parts = max(1, min(units, -(-picks // PICKS)))
    kinds = packed.sparkSession.createDataFrame(kinds, "n_clusters long, _draws int, _shares long, _unit long")
    rows = packed.join(F.broadcast(kinds), "n_clusters").select(
        *group, "n_clusters", "_draws", "_shares", "_unit", "_sums", "_sizes", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.col("_draws"))).alias("_first"))
    unit = F.col("_unit") + F.floor(F.col("_first") / F.col("_draws")) * F.col("_shares") + F.pmod(F.xxhash64("n_clusters", *group), "_shares")
    rows = rows.select(*group, "_first", F.least(F.col("_first") + F.col("_draws"), F.lit(draws)).alias("_stop"), "_sums", "_sizes",
                       F.pmod(unit, F.lit(parts)).cast("int").alias("_part"), unit.alias("_unit"))
    return rows.repartitionById(parts, F.col("_part")).sortWithinPartitions("_unit").drop("_part", "_unit")


def cluster_bootstrap(values: DataFrame, keys: list[str], value: str, cluster: str,
                      draws: int = DRAWS, seed: int = SEED, alpha: float | str = 0.05,
                      algorithm: str = "xxhash64") -> DataFrame:
    """Percentile interval of the pooled mean when whole clusters are resampled.

    Per group: mean, lo, hi, n, n_clusters, excludes_zero. Bounds are NULL below two clusters.
    ``alpha`` may be a column name. A draw's mean weights clusters by their size. Clusters are
    summed on the map side; a group's sums, two numbers a cluster, meet every piece of the draws,
    where the clusters' multiplicity vectors weigh them. No row stands for a pick.
    """
    level = F.col(alpha) if isinstance(alpha, str) else F.lit(alpha)
    group = [*keys, *([alpha] if isinstance(alpha, str) else [])]
    known = values.where(F.col(value).isNotNull())
    sums = stage(known.groupBy(*group, F.col(cluster).alias("_cluster")).agg(
        F.sum(value).cast("double").alias("_sum"), F.count("*").alias("_n")), "clusters")
    packed = sums.groupBy(*group).agg(
        (F.sum("_sum") / F.sum("_n")).alias("mean"), F.sum("_n").alias("n"), F.count("*").alias("n_clusters"),
        F.sort_array(F.collect_list(F.struct("_cluster", "_sum", "_n"))).alias("_all"))
    packed = stage(packed.select(*group, "mean", "n", "n_clusters", F.col("_all._sum").alias("_sums"), F.col("_all._n").alias("_sizes")), "packed-clusters")
    pieces = _dealt(packed.where("n_clusters >= 2"), group, draws)
    schema = ", ".join(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in group) + ", _means array<double>"
    means = pieces.mapInArrow(_draw_means(seed, algorithm), schema)
    bounds = _bounds_at(means, group, level)
    lo, hi = F.get("_ci", F.lit(0)), F.get("_ci", F.lit(1))
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    return packed.alias("h").join(bounds.alias("b"), same, "left").select(
        *[F.col(f"h.{c}").alias(c) for c in group], "mean", lo.alias("lo"), hi.alias("hi"), "n", "n_clusters",
        F.coalesce((lo > ZERO) | (hi < -ZERO), F.lit(False)).alias("excludes_zero"))


def _bounds_at(means: DataFrame, group: list[str], level: Column) -> DataFrame:
    """Linear-interpolated percentiles at a level that may differ by group.

    ``draws`` values per group are sorted in an array; their number is fixed by the call.
    """
    packed = means.groupBy(*group).agg(F.array_sort(F.flatten(F.collect_list("_means"))).alias("_all"))

    def at(q: Column) -> Column:
        spot = q * (F.size("_all") - 1)
        low = F.floor(spot).cast("int")
        a = F.get("_all", low)
        b = F.get("_all", F.least(low + 1, F.size("_all") - 1))
        return a + (b - a) * (spot - low)

    return packed.select(*group, F.array(at(level / 2), at(1 - level / 2)).alias("_ci"))


def bootstrap(values: DataFrame, keys: list[str], value: str, unit: str, draws: int = DRAWS,
              seed: int = SEED, algorithm: str = "xxhash64") -> DataFrame:
    """Percentile interval of a mean: every value is its own cluster, named by ``unit``."""
    return cluster_bootstrap(values, keys, value, unit, draws, seed, algorithm=algorithm)


def spread_summary(values: DataFrame, keys: list[str], value: str, unit: str,
                   draws: int = DRAWS, seed: int = SEED, algorithm: str = "xxhash64") -> DataFrame:
    """Mean with its interval, sample standard deviation and range."""
    ci = bootstrap(values, keys, value, unit, draws, seed, algorithm)
    shape = values.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    return ci.join(shape, keys).select(*keys, "n", "mean", "sd", "min", "max", "lo", "hi")


def repetition_draws(cells: DataFrame, keys: list[str], cell: str, rep: str, value: str,
                     draws: int, seed: int = SEED, algorithm: str = "xxhash64") -> DataFrame:
    """Pick one repetition per cell and average over cells, many times: sd and central width.

    Cells hold a handful of repetitions; their values ride along as an array, so a draw needs
    no join.
    """
    packed = cells.groupBy(*keys, cell).agg(
        F.array_sort(F.collect_list(F.struct(rep, value))).alias("_reps"))
    drawn = packed.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    chosen = F.get("_reps", pick(F.size("_reps"), seed, F.col("_draw"), F.col(cell),
                                 algorithm=algorithm).cast("int"))[value]
    means = drawn.groupBy(*keys, "_draw").agg(F.avg(chosen).alias("_mean"))
    ci = F.percentile("_mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*keys).agg(
        F.count("*").alias("draws"), F.avg("_mean").alias("mean"),
        F.stddev_samp("_mean").alias("sd"), (F.get(ci, F.lit(1)) - F.get(ci, F.lit(0)))
        .alias("central_width"))


def paired_accuracy(predictions: DataFrame, pairs: DataFrame, draws: int = DRAWS,
                    seed: int = SEED, algorithm: str = "xxhash64") -> DataFrame:
    """Accuracy difference of condition pairs (a, b) on shared clips.

    Subjects are the resampled clusters; ``only_a`` and ``only_b`` are the discordant clips.
    """
    right = predictions.select("condition", "clip", "subject",
                               (F.col("prediction") == F.col("target")).cast("int").alias("ok"))
    a = attach(right.withColumnsRenamed({"condition": "a", "ok": "ok_a"}), pairs, ["a"],
               name="pairs")
    b = right.select(F.col("condition").alias("b"), "clip", F.col("ok").alias("ok_b"))
    both = a.join(b, ["b", "clip"]).withColumn("delta", F.col("ok_a") - F.col("ok_b"))
    counts = both.groupBy("a", "b").agg(
        F.avg("ok_a").alias("accuracy_a"), F.avg("ok_b").alias("accuracy_b"),
        F.count_if(F.col("delta") > 0).alias("only_a"),
        F.count_if(F.col("delta") < 0).alias("only_b"))
    ci = cluster_bootstrap(both, ["a", "b"], "delta", "subject", draws, seed, algorithm=algorithm)
    return counts.join(ci, ["a", "b"])


def subject_deltas(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Accuracy difference of each condition pair within each subject, on shared clips."""
    right = predictions.select("condition", "clip", "subject", (F.col("prediction") == F.col("target")).cast("int").alias("ok"))
    a = attach(right.withColumnsRenamed({"condition": "a", "ok": "ok_a"}), pairs, ["a"], name="pairs")
    b = right.select(F.col("condition").alias("b"), "clip", F.col("ok").alias("ok_b"))
    return a.join(b, ["b", "clip"]).groupBy("a", "b", "subject").agg(
        F.avg(F.col("ok_a") - F.col("ok_b")).alias("delta"), F.count("*").alias("clips"))


def interval_verdicts(nominal: DataFrame, family: DataFrame, keys: list[str], at: str) -> DataFrame:
    """How often an interval lies above and below zero, nominally and family-wise, over ``at``;
    positive means, and where the nominal interval is not above zero (in order of ``at``)."""
    both = nominal.select(*keys, at, "mean", "lo", "hi").join(
        family.select(*keys, at, F.col("lo").alias("family_lo"), F.col("hi").alias("family_hi")), [*keys, at])
    above = F.coalesce(F.col("lo") > ZERO, F.lit(False))
    return both.groupBy(*keys).agg(
        F.count("*").alias("points"), F.count_if(F.col("mean") > ZERO).alias("positive_means"),
        F.count_if(above).alias("above"), F.count_if(F.col("hi") < -ZERO).alias("below"),
        F.count_if(F.col("family_lo") > ZERO).alias("family_above"), F.count_if(F.col("family_hi") < -ZERO).alias("family_below"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~above, F.col(at)))), lambda x: x.cast("string")), ",").alias("not_above"))


def baseline_pairs(conditions: DataFrame, direct: list[tuple[str, str]]) -> DataFrame:
    """Each condition against ``<prefix>__unfiltered``, plus declared direct pairs."""
    names = conditions.select("condition").distinct()
    base = F.concat(F.split_part("condition", F.lit("__"), F.lit(1)), F.lit("__unfiltered"))
    own = names.select(F.col("condition").alias("a"), base.alias("b")).where("a <> b")
    known = own.join(names.select(F.col("condition").alias("b")), "b", "left_semi")
    if not direct:
        return known.select("a", "b")
    spark = conditions.sparkSession
    declared = spark.createDataFrame(direct, "a string, b string")
    for side in ("a", "b"):
        declared = declared.join(names.select(F.col("condition").alias(side)), side, "left_semi")
    return known.select("a", "b").unionByName(declared.select("a", "b")).distinct()
