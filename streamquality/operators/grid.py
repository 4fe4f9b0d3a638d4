"""The benchmark grid: every method and retention of every recording in one pass.

Emitting one row per (event, method, retention) would multiply the stream about seventy times
before the first aggregation. Instead the stream is shuffled once, by (recording, chunk of whole
blocks), and each chunk is reduced to one row per slice with NumPy. Slices cut by a chunk edge
leave as pixel counts and are put together afterwards, so a recording of any length spreads over
as many tasks as it has chunks, and no result depends on where the chunks lie.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import div, esr, esr_terms, pixel, quota_of, thinning_base
from .order import spread

KEY = "recording_id"
PART = (f"{KEY} string, method string, r_pct int, slice bigint, n_events bigint, ntss double, "
        "ln double, signal bigint, last bigint, px array<int>, n array<int>, s array<int>")


def chunk_events(slice_size: int, block: int) -> int:
    """Chunk length: about 64 slices, in whole blocks."""
    return max(1, -(-64 * slice_size // block)) * block


def _block_ranks(score: np.ndarray, block: int) -> np.ndarray:
    """0-based rank of every event inside its block, lowest score first, then arrival."""
    rank = np.empty(len(score), dtype=np.int64)
    whole = len(score) // block * block
    order = np.argsort(score[:whole].reshape(-1, block), axis=1, kind="stable")
    np.put_along_axis(rank[:whole].reshape(-1, block), order,
                      np.broadcast_to(np.arange(block), order.shape), axis=1)
    rank[whole:][np.argsort(score[whole:], kind="stable")] = np.arange(len(score) - whole)
    return rank


def _runs(px: np.ndarray, signal: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Sorted runs of equal pixels inside rows of ``width``: row, pixel, count, signal."""
    order = np.argsort(px.reshape(-1, width), axis=1)
    rows = np.take_along_axis(px.reshape(-1, width), order, axis=1)
    first = np.ones(rows.shape, dtype=bool)
    first[:, 1:] = rows[:, 1:] != rows[:, :-1]
    at = np.flatnonzero(first)
    flat = np.take_along_axis(signal.reshape(-1, width), order, axis=1).ravel()
    return at // width, rows.ravel()[at], np.diff(np.r_[at, px.size]), np.add.reduceat(flat, at)


def _whole_slices(px: np.ndarray, signal: np.ndarray, size: int, base: float):
    """Pair concentration, thinned occupancy and signal of consecutive whole slices."""
    rows = np.sort(px.reshape(-1, size), axis=1)
    first = np.ones(rows.shape, dtype=bool)
    first[:, 1:] = rows[:, 1:] != rows[:, :-1]
    at = np.flatnonzero(first)
    n = np.diff(np.r_[at, px.size])
    row = at // size
    thin = 1.0 - base ** np.arange(n.max() + 1)
    pairs = np.bincount(row, n * (n - 1), len(rows))
    return (pairs / (float(size) * (size - 1)), np.bincount(row, thin[n], len(rows)),
            signal.reshape(-1, size).sum(axis=1))


def _reducer(methods: list[str], pcts: list[int], size: int, block: int
             ) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Chunk to slices: the function Spark runs on each (recording, chunk)."""
    base = thinning_base(size)
    full = {p: quota_of(block, p / 100.0) for p in pcts}

    def reduce_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_idx")
        px = pdf["px"].to_numpy()
        signal = pdf["signal"].to_numpy()
        first_event = int(pdf["event_idx"].iloc[0])
        first_block = first_event // block
        sizes = np.minimum(block, len(px) - np.arange(0, len(px), block))
        out = []

        def emit(method, pct, keep, start):
            at_events = np.arange(len(px)) if keep is None else np.flatnonzero(keep)
            p, s, idx = px[at_events], signal[at_events], at_events + first_event
            head = min(-start % size, len(p))
            body = (len(p) - head) // size * size
            at = start // size
            for where, a, b in ((at, 0, head), ((start + head + body) // size, head + body, len(p))):
                if b > a:
                    _, v, n, g = _runs(p[a:b], s[a:b], b - a)
                    out.append((method, pct, where, None, None, None, None, idx[b - 1], v, n, g))
            if body:
                ntss, ln, sig = _whole_slices(p[head:head + body], s[head:head + body], size, base)
                first, last = (start + head) // size, idx[head + size - 1:head + body:size]
                out.extend((method, pct, first + i, size, ntss[i], ln[i], sig[i], last[i], None,
                            None, None) for i in range(len(ntss)))

        for m in methods:
            rank = None if m not in pdf else _block_ranks(pdf[m].to_numpy(), block)
            if rank is None:
                rank = np.arange(len(px)) % block
            for pct in pcts:
                quota = np.array([full[pct] if n == block else quota_of(int(n), pct / 100.0)
                                  for n in sizes])
                emit(m, pct, rank < np.repeat(quota, sizes), first_block * full[pct])
        emit("*", 100, None, first_block * block)
        frame = pd.DataFrame(out, columns=["method", "r_pct", "slice", "n_events", "ntss", "ln",
                                           "signal", "last", "px", "n", "s"])
        frame.insert(0, KEY, pdf[KEY].iloc[0])
        frame["n_events"] = frame["n_events"].astype("Int64")
        frame["signal"] = frame["signal"].astype("Int64")
        return frame

    return reduce_chunk


def slices(events: DataFrame, scores: dict[str, Column | None], slice_size: int, block: int,
           pcts: list[int]) -> DataFrame:
    """One row per (recording, method, retention, slice), with the incomplete tail included.

    Method ``*`` at 100 is the unfiltered stream.
    """
    below = [p for p in pcts if p < 100]
    signal = (1 - F.col("label")) if "label" in events.columns else F.lit(0)
    narrow = events.select(
        KEY, "event_idx", pixel().cast("int").alias("px"), signal.cast("int").alias("signal"),
        div("event_idx", chunk_events(slice_size, block)).alias("chunk"),
        *[c.cast("double").alias(m) for m, c in scores.items() if c is not None])
    parts = spread(narrow, [KEY, "chunk"], events).groupBy(KEY, "chunk").applyInPandas(
        _reducer(list(scores), below, slice_size, block), PART)
    group = [KEY, "method", "r_pct", "slice"]
    # cut slices travel as arrays, one row for each side of the cut
    loose = spread(parts, group, events).select(
        *group, "n_events", "ntss", "ln", "signal", "last",
        F.explode_outer(F.arrays_zip("px", "n", "s")).alias("e"))
    joined = loose.groupBy(*group, F.col("e.px").alias("px")).agg(
        F.sum("e.n").alias("n"), F.sum("e.s").alias("s"), F.max("n_events").alias("n_events"),
        F.max("ntss").alias("ntss"), F.max("ln").alias("ln"), F.max("signal").alias("signal"),
        F.max("last").alias("last"))
    ntss, ln = esr_terms("n", slice_size)
    return joined.groupBy(*group).agg(
        F.coalesce(F.sum("n"), F.max("n_events")).alias("n_events"),
        F.coalesce(F.sum("s"), F.max("signal")).alias("signal"),
        F.coalesce(ntss, F.max("ntss")).alias("ntss"), F.coalesce(ln, F.max("ln")).alias("ln"),
        F.max("last").alias("last"))


def curve(events: DataFrame, scores: dict[str, Column | None], slice_size: int, block: int,
          pcts: list[int]) -> DataFrame:
    """MESR at every retention with evaluability and retained signal.

    r = 1 keeps the whole stream under every method, so it is measured once and repeated.
    Columns: recording_id, method, r_pct, mesr, kept_events, scored_events, tp, scored_tp,
    last_scored (index of the last event scored), raw_mesr, n_events, evaluable. ``tp`` counts label-0 events and means nothing on
    unlabelled streams.
    """
    whole = F.col("n_events") == slice_size
    measured = slices(events, scores, slice_size, block, pcts).groupBy(
        KEY, "method", "r_pct").agg(
        F.avg(F.when(whole, esr())).alias("mesr"), F.sum("n_events").alias("kept_events"),
        F.sum(F.when(whole, F.col("n_events")).otherwise(0)).alias("scored_events"),
        F.sum("signal").alias("tp"),
        F.sum(F.when(whole, F.col("signal")).otherwise(0)).alias("scored_tp"),
        F.max(F.when(whole, F.col("last"))).alias("last_scored"))
    # the unfiltered row joins the others of its recording without a second pass over events
    rows = F.struct("method", "r_pct", "mesr", "kept_events", "scored_events", "tp", "scored_tp",
                    "last_scored")
    per = measured.groupBy(KEY).agg(
        F.max(F.when(F.col("method") == "*", F.struct("mesr", "kept_events"))).alias("base"),
        F.collect_list(rows).alias("cells"))
    cells = per.select(KEY, F.col("base.mesr").alias("raw_mesr"),
                       F.col("base.kept_events").alias("n_events"), F.inline("cells"))
    named = cells.withColumn("method", F.explode(
        F.when(F.col("method") == "*", F.array(*[F.lit(m) for m in scores]))
        .otherwise(F.array("method"))))
    if 100 not in pcts:
        named = named.where(F.col("r_pct") < 100)
    return named.withColumn("evaluable", F.col("mesr").isNotNull())
