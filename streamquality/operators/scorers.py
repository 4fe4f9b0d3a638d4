"""Per-event scores: controls, imported decisions, attribution, neighbourhood support."""

from __future__ import annotations

from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import priority, uniform
from ..functions.numeric import div
from ..staging import attach, stage
from .attribution import attribute_kept, with_packet  # noqa: F401
from .order import PIECE, spread

KEY = "recording_id"
VALUE = ["t_us", "x", "y", "p"]


def block_prefix() -> None:
    """The block-prefix control: a constant score, so arrival order alone decides."""
    return None


def label_oracle(label: str = "label") -> Column:
    """Score = label; an unlabelled row fails the job instead of ranking anywhere."""
    return F.when(F.col(label).isNull(), F.raise_error(F.lit("label oracle needs labels"))
                  .cast("float")).otherwise(F.col(label).cast("float"))


def seeded_random(seed: int, algorithm: str = "xxhash64", key: str = KEY) -> Column:
    """The random subsampler: a repeatable random order, whatever the partitioning."""
    return priority(seed, F.col(key), F.col("event_idx"), algorithm=algorithm)


def two_level(accepted: Column) -> Column:
    """A keep/drop decision as a score: kept 0.0, dropped 1.0."""
    return F.when(accepted, F.lit(0.0)).otherwise(F.lit(1.0)).cast("float")


def tie_broken(accepted: Column, *parts, algorithm: str = "xxhash64") -> Column:
    """Accepted before rejected, in random order inside each; the key is shared by methods."""
    return F.struct((~accepted).cast("int").alias("rejected"),
                    priority(*parts, algorithm=algorithm).alias("key"))


def score_events(events: DataFrame, scores: dict[str, Column | None]) -> DataFrame:
    """Long (recording, event, method, score) table of several numeric scorers."""
    cells = [F.struct(F.lit(m).alias("method"),
                      (F.lit(0.0) if c is None else c).cast("double").alias("score"))
             for m, c in scores.items()]
    return events.select(KEY, "event_idx", F.inline(F.array(*cells)))


def native_retention(scored: DataFrame) -> DataFrame:
    """Share kept by a two-level scorer; NULL for any scorer with other values."""
    zero = F.col("score") == 0.0
    two = zero | (F.col("score") == 1.0)
    return scored.groupBy(KEY, "method").agg(
        F.count("*").alias("n_events"),
        F.when(F.count_if(~two) == 0, F.avg(zero.cast("double"))).alias("native_retention"))


def decisions_to_scores(events: DataFrame, accepted_ids: DataFrame) -> DataFrame:
    """Two-level scores from a table of accepted (recording, event_idx)."""
    mark = accepted_ids.select(KEY, "event_idx").distinct().withColumn("_kept", F.lit(True))
    return (events.join(mark, [KEY, "event_idx"], "left")
            .withColumn("score", two_level(F.col("_kept").isNotNull())).drop("_kept"))


def shifted_gaussian(seed: int, auc: float, algorithm: str = "xxhash64",
                     label: str = "label") -> Column:
    """Scores of known AUC: unit Gaussians whose noise class is moved by sqrt(2)*probit(auc)."""
    u = uniform(seed, "u", F.col(KEY), F.col("event_idx"), algorithm=algorithm)
    v = uniform(seed, "v", F.col(KEY), F.col("event_idx"), algorithm=algorithm)
    gauss = F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * v)
    return gauss + F.when(F.col(label) == 1, F.lit(sqrt(2.0) * probit(auc))).otherwise(0.0)


def probit(p: float) -> float:
    """Inverse normal distribution function of a driver-side constant."""
    from statistics import NormalDist
    return NormalDist().inv_cdf(p)


# --- attribution of returned rows to input rows ---------------------------------------------

def attribution_report(attributed: DataFrame, block: int = 65536) -> DataFrame:
    """Per recording: returned rows, unmatched rows and order inversions (both must be 0)."""
    b = attributed.withColumn("_b", div("kept_idx", block))
    prev = F.lag("event_idx").over(W.partitionBy(KEY, "_b").orderBy("kept_idx"))
    within = b.withColumn("_inv", (F.col("event_idx") <= prev).cast("int"))
    edges = within.groupBy(KEY, "_b").agg(
        F.count("*").alias("kept"), F.count_if(F.col("event_idx").isNull()).alias("unmatched"),
        F.coalesce(F.sum("_inv"), F.lit(0)).alias("inv"),
        F.min_by("event_idx", "kept_idx").alias("first"),
        F.max_by("event_idx", "kept_idx").alias("last"))
    prior = edges.select(KEY, (F.col("_b") + 1).alias("_b"), F.col("last").alias("before"))
    return edges.join(prior, [KEY, "_b"], "left").groupBy(KEY).agg(
        F.sum("kept").alias("kept"), F.sum("unmatched").alias("unmatched"),
        F.sum(F.col("inv") + F.coalesce((F.col("first") <= F.col("before")).cast("int"),
                                        F.lit(0))).alias("inversions"))


def identical_groups(events: DataFrame) -> DataFrame:
    """Per recording: groups of identical events, events in them, largest, mixed labels."""
    groups = events.groupBy(KEY, *VALUE).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("signal"))
    many = F.col("n") >= 2
    return groups.groupBy(KEY).agg(
        F.sum("n").alias("events"), F.count_if(many).alias("groups"),
        F.sum(F.when(many, F.col("n")).otherwise(0)).alias("events_in_groups"),
        F.max("n").alias("largest"),
        F.count_if(many & (F.col("signal") > 0) & (F.col("signal") < F.col("n")))
        .alias("mixed_groups"))


def summarise_groups(per_recording: DataFrame) -> DataFrame:
    return per_recording.agg(
        F.sum("events").alias("events"), F.sum("groups").alias("groups"),
        F.sum("events_in_groups").alias("events_in_groups"),
        F.count("*").alias("recordings"),
        F.count_if(F.col("groups") > 0).alias("recordings_with_groups"),
        F.max("largest").alias("largest"), F.sum("mixed_groups").alias("mixed_groups"),
        F.max("mixed_groups").alias("max_mixed_in_one_recording"))


def compare_routes(exact: DataFrame, whole: DataFrame, slice_size: int) -> DataFrame:
    """Two attributions of the same returned rows: rows that move, signal on the scored prefix.

    Both sides hold (recording, method, kept_idx, event_idx, label), the label of the input row.
    """
    keys = [KEY, "method", "kept_idx"]
    names = {"e": (exact, "event_idx"), "label_e": (exact, "label"), "w": (whole, "event_idx"), "label_w": (whole, "label")}
    # a row of each side per key: one aggregate, as a join would need both sides sorted
    sides = [df.select(*keys, *[(F.col(c) if of is df else F.lit(None).cast(of.schema[c].dataType)).alias(n) for n, (of, c) in names.items()])
             for df in (exact, whole)]
    pair = spread(sides[0].unionByName(sides[1]), [KEY, "kept_idx"], exact, PIECE // 2).groupBy(*keys).agg(
        *[F.max(n).alias(n) for n in names])
    total = exact.groupBy(KEY, "method").agg(F.count("*").alias("kept"))
    pair = attach(pair, total, [KEY, "method"], name="kept")
    scored = F.col("kept_idx") < div("kept", slice_size) * slice_size
    return pair.groupBy(KEY, "method").agg(
        F.first("kept").alias("kept"),
        F.count_if(~F.col("e").eqNullSafe(F.col("w"))).alias("moved"),
        F.count_if(scored).alias("scored"),
        F.count_if(scored & (F.col("label_e") == 0)).alias("tp_scored"),
        F.count_if(scored & (F.col("label_w") == 0)).alias("tp_scored_whole_merge"))


def summarise_routes(cells: DataFrame) -> DataFrame:
    change = F.col("tp_scored_whole_merge") - F.col("tp_scored")
    return cells.agg(
        F.count("*").alias("cells"), F.count_if(F.col("moved") > 0).alias("cells_moved"),
        F.sum("moved").alias("events_moved"), F.max("moved").alias("max_moved"),
        F.count_if(change != 0).alias("tp_changed_cells"),
        F.greatest(F.lit(0), F.max(change)).alias("max_tp_overcount"),
        F.greatest(F.lit(0), -F.min(change)).alias("max_tp_undercount"))


# --- packets without repeated events --------------------------------------------------------

def _repeats(events: DataFrame, block: int) -> DataFrame:
    """Rows whose value occurred before, with the index of the latest earlier copy."""
    keys = [KEY, *VALUE]
    tagged = events.select(KEY, "event_idx", *VALUE).withColumn("blk", div("event_idx", block))
    last = tagged.groupBy(*keys, "blk").agg(F.max("event_idx").alias("_last"))
    earlier = last.select(*keys, "blk", F.lag("_last").over(
        W.partitionBy(*keys).orderBy("blk")).alias("_earlier"))
    inside = F.lag("event_idx").over(W.partitionBy(*keys, "blk").orderBy("event_idx"))
    return (tagged.withColumn("_inside", inside).join(earlier, [*keys, "blk"])
            .select(KEY, "blk", "event_idx",
                    F.coalesce("_inside", "_earlier").alias("prev"))
            .where(F.col("prev").isNotNull()))


def _jumps(idx: np.ndarray, prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that raise the running maximum of ``prev``: the only possible first cuts."""
    top = np.maximum.accumulate(prev)
    rises = np.r_[True, top[1:] > top[:-1]]
    return idx[rises], prev[rises]


def _exit_of(cut: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For a packet opened at each cut, where the packet open at the block's end began."""
    follow = np.searchsorted(seen, cut)
    out = cut.copy()
    for i in range(len(cut) - 1, -1, -1):
        if follow[i] < len(cut):
            out[i] = out[follow[i]]
    return out


def _transfer(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("event_idx")
    cut, seen = _jumps(pdf["event_idx"].to_numpy(), pdf["prev"].to_numpy())
    leave = _exit_of(cut, seen)
    last = np.r_[leave[1:] != leave[:-1], True]
    return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "blk": [pdf["blk"].iloc[0]],
                         "seen": [seen[last].tolist()], "leave": [leave[last].tolist()]})


def _chain(first: tuple, then: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The step function of two neighbouring pieces of a recording, one after the other."""
    seen, leave = first
    at = np.searchsorted(then[0], leave)
    through = np.where(at < len(then[0]), then[1][np.minimum(at, len(then[1]) - 1)], leave)
    beyond = then[0] > seen[-1]
    s, out = np.r_[seen, then[0][beyond]], np.r_[through, then[1][beyond]]
    last = np.r_[out[1:] != out[:-1], True]
    return s[last], out[last]


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("blk", ascending=False)
    pieces = list(zip(pdf["seen"], pdf["leave"]))
    whole = pieces[0]
    for piece in pieces[1:]:
        whole = _chain(piece, whole)
    return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "span": [pdf["span"].iloc[0]],
                         "seen": [list(whole[0])], "leave": [list(whole[1])]})


def _entries(piece: str, given: bool):
    """Where the packet open at the start of each piece began, walking pieces in order."""
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(piece)
        start, entry = int(pdf["from"].iloc[0]) if given else 0, []
        for seen, leave in zip(pdf["seen"], pdf["leave"]):
            entry.append(start)
            at = int(np.searchsorted(seen, start))
            start = start if at == len(leave) else int(leave[at])
        return pd.DataFrame({KEY: pdf[KEY], piece: pdf[piece], "entry": entry})
    return walk


def _cuts(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("event_idx")
    cut, seen = _jumps(pdf["event_idx"].to_numpy(), pdf["prev"].to_numpy())
    start, found = int(pdf["entry"].iloc[0]), []
    at = int(np.searchsorted(seen, start))
    while at < len(cut):
        start = int(cut[at])
        found.append(start)
        at = int(np.searchsorted(seen, start))
    return pd.DataFrame({KEY: pdf[KEY].iloc[0], "start": np.array(found, dtype="int64")})


def packets(events: DataFrame, block: int = 1 << 20, span: int = 1024) -> DataFrame:
    """Fewest consecutive ranges [start, stop) that hold no event twice.

    Where a packet ends depends on where it began, so blocks are summarised in parallel as a
    step function from entry to exit. Blocks of a span are composed in parallel, spans are
    walked in order with one short row each, and the entries of blocks and the cuts are then
    read off in parallel.
    """
    repeats = stage(_repeats(events, block), "repeats")
    function = "seen array<bigint>, leave array<bigint>"
    steps = stage(repeats.groupBy(KEY, "blk").applyInPandas(
        _transfer, f"{KEY} string, blk bigint, {function}").withColumn(
        "span", div("blk", span)), "steps")
    composed = steps.groupBy(KEY, "span").applyInPandas(
        _compose, f"{KEY} string, span bigint, {function}")
    opened = composed.groupBy(KEY).applyInPandas(
        _entries("span", False), f"{KEY} string, span bigint, entry bigint")
    entries = steps.join(opened.withColumnRenamed("entry", "from"), [KEY, "span"]).groupBy(
        KEY, "span").applyInPandas(_entries("blk", True), f"{KEY} string, blk bigint, entry bigint")
    cuts = repeats.join(entries, [KEY, "blk"]).groupBy(KEY, "blk").applyInPandas(
        _cuts, f"{KEY} string, start bigint")
    sizes = events.groupBy(KEY).agg(F.count("*").alias("n"))
    starts = cuts.unionByName(sizes.select(KEY, F.lit(0).cast("bigint").alias("start")))
    # the stop of a packet is the next start; neighbours are found per block of starts
    b = starts.withColumn("blk", div("start", block))
    inside = F.lead("start").over(W.partitionBy(KEY, "blk").orderBy("start"))
    heads = b.groupBy(KEY, "blk").agg(F.min("start").alias("head"))
    following = heads.select(KEY, "blk", F.lead("head").over(
        W.partitionBy(KEY).orderBy("blk")).alias("after"))
    return (b.withColumn("_in", inside).join(following, [KEY, "blk"]).join(sizes, KEY)
            .select(KEY, "start", F.coalesce("_in", "after", "n").alias("stop")))


# --- neighbourhood support -----------------------------------------------------------------

def neighbourhood_support(events: DataFrame, radius: int, tau_us: int,
                          include_self_pixel: bool = True) -> DataFrame:
    """Events in the (2*radius+1)^2 neighbourhood within ``tau_us`` before each event.

    Background-activity filters keep an event when this count reaches a threshold. Pairs are
    never formed: every event adds one to the nine (or more) pixels around it and each pixel's
    additions are counted in a time-range window, partitioned by pixel and split in time
    buckets of ``tau_us`` so a hot pixel spreads over many tasks.
    """
    span = range(-radius, radius + 1)
    offsets = [(dx, dy) for dx in span for dy in span
               if include_self_pixel or (dx, dy) != (0, 0)]
    base = events.select(KEY, "event_idx", "t_us", "x", "y")
    bucket = div("t_us", tau_us)
    # contributions reach their own bucket and the next one, where they can still be in range
    adds = (base.select(KEY, "t_us", "x", "y", F.inline(F.array(*[
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])))
        .select(KEY, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"),
                "t_us", F.explode(F.array(bucket, bucket + 1)).alias("tb")))
    keys = [KEY, "x", "y", "tb"]
    asks = base.select(KEY, "x", "y", bucket.alias("tb"), "t_us", F.lit(0).alias("add"),
                       F.lit(1).alias("ask"))
    adds = adds.select(*keys, "t_us", F.lit(1).alias("add"), F.lit(0).alias("ask"))
    # equal times collapse to one row per (pixel, bucket, time) before the shuffle
    both = adds.unionByName(asks).groupBy(*keys, "t_us").agg(
        F.sum("add").alias("adds"), F.max("ask").alias("ask"))
    w = W.partitionBy(*keys).orderBy("t_us").rangeBetween(-tau_us, -1)
    counted = both.withColumn("support", F.coalesce(F.sum("adds").over(w), F.lit(0)))
    asked = counted.where(F.col("ask") == 1).select(KEY, "x", "y", "t_us", "support")
    return base.join(asked, [KEY, "x", "y", "t_us"]).select(KEY, "event_idx", "support")


def support_filter(support: DataFrame, minimum: int) -> DataFrame:
    """Keep decision of the support filter, as a two-level score."""
    return support.withColumn("score", two_level(F.col("support") >= minimum))


def attribute_in_packets(events: DataFrame, packet_table: DataFrame, kept: DataFrame) -> DataFrame:
    """Input index of rows a filter returned packet by packet.

    A packet holds no event twice, so the value alone names the input row. ``kept`` holds
    (recording, start, kept_idx, t, x, y, p); rows without a source have a NULL index.
    """
    source = with_packet(events.select(KEY, "event_idx", *VALUE), packet_table)
    return kept.join(source, [KEY, "start", *VALUE], "left")
