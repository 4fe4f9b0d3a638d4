"""Positions: event index, blocks, slices, kept ranks, frames and windows.

Nothing here sorts a whole recording in one task. A global position is always the sum of a
position inside a bounded piece (a range partition or a block) and the offset of that piece,
and offsets are prefix sums over one row per piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import priority
from ..functions.numeric import block_quota, div, lowest_terms
from ..schema import KEEP_THRESHOLD
from ..staging import attach, stage

ROW_BITS = 33
SPAN = 1024
PIECE = 1 << 18


def pieces(df: DataFrame, rows: int | None = None) -> int:
    """How many tasks ``df`` makes of ``rows`` rows (`PIECE`) each.

    Counted, as neither the session's partition count nor the size of shuffled bytes bounds a
    task: narrow event rows pack to some ten bytes, and sorted they take two hundred.
    """
    return max(1, -(-df.count() // (rows or PIECE)))


def spread(df: DataFrame, keys: list[str], like: DataFrame | None = None,
           rows: int | None = None) -> DataFrame:
    """``df`` dealt out by ``keys``, to tasks of about ``rows`` rows however large it is.

    ``keys`` name bounded groups (blocks, slices, chunks). ``like`` is a table with as many rows
    that is cheaper to count.
    """
    n = pieces(df if like is None else like, rows)
    if n == 1:
        return df.repartition(*keys)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


def running_offsets(counts: DataFrame, keys: list[str], piece: str, values: list[str],
                    span: int = SPAN) -> DataFrame:
    """Exclusive prefix sums of ``values`` over ``piece`` within ``keys``, and their totals.

    Pieces are summed inside spans of ``span`` consecutive ids, then spans are summed, so a
    recording with 10^8 blocks costs 10^5 tasks-worth of short windows instead of one long one.
    """
    spanned = counts.withColumn("_span", div(F.col(piece).cast("bigint"), span))
    inner = W.partitionBy(*keys, "_span").orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    local = spanned.select(*keys, "_span", piece, *[
        F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_in_{v}") for v in values])
    spans = spanned.groupBy(*keys, "_span").agg(*[F.sum(v).alias(v) for v in values])
    whole = W.partitionBy(*keys)
    spans = spans.select(*keys, "_span", *[
        F.coalesce(F.sum(v).over(outer), F.lit(0)).alias(f"_out_{v}") for v in values], *[
        F.sum(v).over(whole).alias(f"{v}_total") for v in values])
    return local.join(spans, [*keys, "_span"]).select(*keys, piece, *[
        (F.col(f"_in_{v}") + F.col(f"_out_{v}")).alias(f"{v}_before") for v in values], *[
        f"{v}_total" for v in values])


def range_ordered(df: DataFrame, keys: list[str], order: list[str], name: str,
                  like: DataFrame | None = None) -> DataFrame:
    """Stage ``df`` range-partitioned by ``keys`` and ``order``, with ``_part`` and ``_row``.

    Ranges are balanced whatever the key skew, because ``order`` (unique within ``keys``) is
    part of the range key. Writing it out fixes the boundaries for every later reader. There
    are as many ranges as the session has shuffle partitions, or more, so that none holds over
    `PIECE` rows or so. ``like`` is a table of at least as many rows that is cheaper to count.
    """
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                 pieces(df if like is None else like))
    ranged = (df.repartitionByRange(ranges, *[F.col(c) for c in [*keys, *order]])
              .sortWithinPartitions(*keys, *order)
              .withColumn("_pos", F.monotonically_increasing_id()))
    return stage(ranged.withColumn("_part", F.shiftright("_pos", ROW_BITS).cast("int"))
                 .withColumn("_row", F.col("_pos").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
                 .drop("_pos"), name)


def assign_event_index(df: DataFrame, keys: list[str], order: list[str],
                       name: str = "ordered") -> DataFrame:
    """Add ``event_idx``, the 0-based position within ``keys`` by ``order`` (a unique key)."""
    ordered = range_ordered(df, keys, order, name)
    pieces = ordered.groupBy(*keys, "_part").agg(F.count("*").alias("n"),
                                                 F.min("_row").alias("_first"))
    offsets = running_offsets(pieces, keys, "_part", ["n"])
    shift = offsets.join(pieces, [*keys, "_part"]).select(
        *keys, "_part", (F.col("n_before") - F.col("_first")).alias("_shift"))
    # one row per (recording, range): at most ranges + recordings
    return (attach(ordered, shift, [*keys, "_part"], name="shift")
            .withColumn("event_idx", F.col("_shift") + F.col("_row"))
            .drop("_part", "_row", "_shift"))


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: list[str],
                 name: str = "summed", like: DataFrame | None = None) -> DataFrame:
    """Exclusive running sums ``<value>_before`` of ``values`` by ``order`` within ``keys``."""
    ordered = range_ordered(df, keys, order, name, like)
    pieces = ordered.groupBy(*keys, "_part").agg(*[F.sum(v).alias(v) for v in values])
    offsets = running_offsets(pieces, keys, "_part", values).drop(*[f"{v}_total" for v in values])
    local = W.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    out = ordered.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"_in_{v}")
                                for v in values])
    out = attach(out, offsets, [*keys, "_part"], name="sums")
    for v in values:
        out = out.withColumn(f"{v}_before", F.col(f"{v}_before") + F.col(f"_in_{v}"))
    return out.drop("_part", "_row", *[f"_in_{v}" for v in values])


def time_order_report(df: DataFrame, key: str, source_idx: str, t: str = "t_us",
                      bucket: int = 65536) -> DataFrame:
    """Per recording: rows arriving with a smaller time than the row before them.

    Neighbours are compared inside buckets of ``bucket`` consecutive source rows; bucket edges
    are compared from one (first, last) row per bucket.
    """
    b = df.withColumn("_b", div(source_idx, bucket))
    inner = W.partitionBy(key, "_b").orderBy(source_idx)
    within = b.withColumn("_inv", (F.col(t) < F.lag(t).over(inner)).cast("int"))
    edges = within.groupBy(key, "_b").agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("_inv"), F.lit(0)).alias("inv"),
        F.min_by(t, source_idx).alias("t_first"), F.max_by(t, source_idx).alias("t_last"))
    prior = edges.select(key, (F.col("_b") + 1).alias("_b"), F.col("t_last").alias("t_prev"))
    joined = edges.join(prior, [key, "_b"], "left")
    return joined.groupBy(key).agg(
        F.sum("rows").alias("rows"),
        F.sum(F.col("inv") + F.coalesce((F.col("t_first") < F.col("t_prev")).cast("int"),
                                        F.lit(0))).alias("inversions")
    ).withColumn("repaired", F.col("inversions") > 0)


def cap_events(df: DataFrame, cap: int | Column) -> DataFrame:
    """The first ``cap`` events of every recording; a number is a filter that reaches the scan."""
    return df.where(F.col("event_idx") < cap)


def block_of(block: int, idx: str = "event_idx") -> Column:
    """Block id on the input order."""
    return div(idx, block)


def with_mask_positions(events: DataFrame, masks: list[str], block: int,
                        key: str = "recording_id") -> DataFrame:
    """For every boolean mask: 0-based rank among kept events, and the kept total.

    Adds ``<mask>_pos`` (NULL where dropped), ``<mask>_before`` (kept before the block) and
    ``<mask>_total``. One window on (recording, block) serves all masks.
    """
    flagged = events.withColumn("block", block_of(block))
    counts = flagged.groupBy(key, "block").agg(*[
        F.sum(F.col(m).cast("bigint")).alias(m) for m in masks])
    offsets = running_offsets(counts, [key], "block", masks)
    local = W.partitionBy(key, "block").orderBy("event_idx").rowsBetween(W.unboundedPreceding, 0)
    ranked = spread(flagged, [key, "block"], events).select("*", *[
        F.sum(F.col(m).cast("bigint")).over(local).alias(f"_in_{m}") for m in masks])
    joined = ranked.join(offsets, [key, "block"])
    for m in masks:
        joined = joined.withColumn(f"{m}_pos", F.when(
            F.col(m), F.col(f"{m}_before") + F.col(f"_in_{m}") - 1))
    return joined.drop(*[f"_in_{m}" for m in masks])


def scored_events(total: Column, slice_size: int) -> Column:
    """Events in whole slices."""
    return div(total, slice_size) * slice_size


def frame_length(n_events: Column, pct: int, slice_size: int) -> Column:
    """Longest leading frame that holds whole slices before and after thinning to ``pct``."""
    step = slice_size * lowest_terms(pct)[1]
    return div(n_events, step) * step


def with_time_window(events: DataFrame, window_us: int, key: str = "recording_id") -> DataFrame:
    """Add ``win``: fixed-duration windows anchored at each recording's first event."""
    first = events.groupBy(key).agg(F.min("t_us").alias("_t0"))
    return attach(events, first, [key], name="first").withColumn(
        "win", div(F.col("t_us") - F.col("_t0"), window_us)).drop("_t0")


def quota_table(events: DataFrame, pcts: list[int], block: int,
                key: str = "recording_id") -> DataFrame:
    """k_b(r) for every block and retention."""
    sized = events.groupBy(key, block_of(block).alias("block")).agg(F.count("*").alias("n_b"))
    cells = F.array(*[F.struct(F.lit(p).alias("r_pct"),
                               block_quota(F.col("n_b"), p / 100.0, block).alias("k_b"))
                      for p in pcts])
    return sized.select(key, "block", F.inline(cells))


def block_counts(events: DataFrame, masks: list[str], block: int,
                 key: str = "recording_id") -> DataFrame:
    """Events per block that each mask keeps, zero-count blocks included."""
    return events.groupBy(key, block_of(block).alias("block")).agg(
        *[F.count_if(F.col(m)).alias(m) for m in masks])


def scored_prefix(events: DataFrame, masks: list[str], slice_size: int, block: int,
                  key: str = "recording_id") -> DataFrame:
    """Kept events the metric reads: the first whole-slice multiple of every mask."""
    placed = with_mask_positions(events, masks, block, key)
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}_pos").alias("pos"),
                               F.col(f"{m}_total").alias("kept")) for m in masks])
    return placed.select(*events.columns, F.inline(cells)).where(
        F.col("pos") < scored_events(F.col("kept"), slice_size))


def scored_span(events: DataFrame, masks: list[str], slice_size: int, block: int,
                key: str = "recording_id") -> DataFrame:
    """Share of the input up to the last scored event; absent where nothing is scored."""
    last = scored_prefix(events, masks, slice_size, block, key).groupBy(key, "method").agg(
        F.max("event_idx").alias("last"))
    size = events.groupBy(key).agg(F.count("*").alias("n"))
    return last.join(size, key).select(
        key, "method",
                                       ((F.col("last") + 1) / F.col("n")).alias("span"))


def frames(events: DataFrame, pcts: list[int], slice_size: int,
           key: str = "recording_id") -> DataFrame:
    """`frame_length` of every recording and retention."""
    size = events.groupBy(key).agg(F.count("*").alias("n"))
    return size.select(key, F.inline(F.array(*[
        F.struct(F.lit(p).alias("r_pct"), frame_length(F.col("n"), p, slice_size).alias("frame"))
        for p in pcts])))


def released_mask(score: str) -> Column:
    """The released keep threshold; tail events carry a sentinel above it and are dropped."""
    return F.col(score) < KEEP_THRESHOLD


def min_max_normalise(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Scale a column to [0, 1] over each group, from one small row per group."""
    bounds = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return attach(df, bounds, keys, name="bounds").withColumn(
        f"{column}_norm", F.try_divide(
            F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def scene_of(name: str, patterns: list[tuple[str, int]]) -> Column:
    """First matching pattern's group; a name no pattern matches is its own scene."""
    out = F.col(name)
    for pattern, group in reversed(patterns):
        out = F.when(F.col(name).rlike(pattern), F.regexp_extract(name, pattern, group)).otherwise(out)
    return out


def shuffle_marks(events: DataFrame, window: int | None, seed: int, marks: list[str],
                  key: str = "recording_id", algorithm: str = "xxhash64",
                  buckets: int = 4096) -> DataFrame:
    """Permute ``marks`` inside windows of ``window`` consecutive events; times stay put.

    Adds ``<mark>_shuffled``. Window 0 changes nothing; None permutes the whole recording, and
    then the random rank is a bucket offset plus a rank inside one hash bucket, so no task
    sorts a whole recording.
    """
    if window == 0:
        return events.select("*", *[F.col(m).alias(f"{m}_shuffled") for m in marks])
    order_key = priority(seed, F.col(key), F.col("event_idx"), algorithm=algorithm)
    donors = events.select(key, "event_idx", *[F.col(m).alias(f"{m}_shuffled") for m in marks],
                           order_key.alias("_prio"))
    if window is None:
        donors = donors.withColumn("_bucket", F.shiftrightunsigned(
            "_prio", 52 - (buckets - 1).bit_length()))
        sizes = donors.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
        before = running_offsets(sizes, [key], "_bucket", ["_n"]).drop("_n_total")
        local = F.row_number().over(W.partitionBy(key, "_bucket").orderBy("_prio", "event_idx"))
        placed = donors.withColumn("_local", local).join(before, [key, "_bucket"]).withColumn(
            "_to", F.col("_n_before") + F.col("_local") - 1)
    else:
        placed = donors.withColumn("_win", div("event_idx", window))
        local = F.row_number().over(W.partitionBy(key, "_win").orderBy("_prio", "event_idx"))
        placed = placed.withColumn("_to", F.col("_win") * window + local - 1)
    moved = placed.select(key, F.col("_to").alias("event_idx"), *[f"{m}_shuffled" for m in marks])
    return events.join(moved, [key, "event_idx"])
