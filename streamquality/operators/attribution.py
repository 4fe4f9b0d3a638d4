"""Which input row a returned row is, by a forward scan.

A filter returns values, not indices. The scan walks the input once and gives each input row to
the next returned row if their values are equal, so every returned row gets the first copy behind
the row before it. What a block of input rows does is a function of the returned row it begins
with; such functions are evaluated for all blocks at once, at a guess of where each begins, and
again where the block before it ended elsewhere. The scan is done when every block begins where
the one before it ended, so the result is exact whatever the guesses were. A block starts a bit
early, where a run of equal times starts or in the run before it, so that a near guess has met the
true scan when the block itself begins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import div
from ..staging import attach, stage
from .order import PIECE, running_sums, spread

KEY = "recording_id"
VALUE = ["t_us", "x", "y", "p"]
BLOCK = 65536


def _heads(events: DataFrame, kept: DataFrame, block: int) -> DataFrame:
    """``KEY, blk, t_us, begin, start``: the time at which each block begins, and a guess of the first returned row to be asked for from input row ``start`` on.

    With both sides in time order, a run of equal times begins with the first returned row of that
    time, so a block starts where its first run does. If that is more than `_early` rows before the
    block, it starts so many rows early, and the guess goes by the share of the run passed half of
    them later: a scan that begins too far ahead meets the true one, one that lags may not.
    """
    early = _early(block)
    ends = stage(events.where(F.col("event_idx") % block == 0).select(KEY, div("event_idx", block).alias("blk"), "t_us"), "scan-blocks")
    runs = attach(events.select(KEY, "t_us", "event_idx"), ends.select(KEY, "t_us").distinct(), [KEY, "t_us"], name="scan-runs").groupBy(
        KEY, "t_us").agg(F.min("event_idx").alias("_first"), F.count("*").alias("_length"))
    asked = stage(kept.groupBy(KEY, "t_us").agg(F.count("*").alias("n")).withColumn("blk", F.lit(-1).cast("bigint")), "scan-asked")
    both = asked.unionByName(ends.select(KEY, "t_us", F.lit(0).cast("bigint").alias("n"), "blk"))
    upto = running_sums(both, [KEY], ["t_us", "blk"], ["n"], "scan-guess").where("blk >= 0")
    here = upto.select(KEY, "blk", F.col("n_before").alias("_upto")).join(ends, [KEY, "blk"]).join(
        runs, [KEY, "t_us"], "left").join(asked.drop("blk"), [KEY, "t_us"], "left")
    n = F.coalesce("n", F.lit(0))
    first = F.coalesce("_first", F.col("blk") * block)
    here = here.withColumn("start", F.greatest(first, F.col("blk") * block - early))
    passed = F.least(F.lit(1.0), (F.col("start") + early // 2 - first) / F.coalesce("_length", F.lit(1)))
    guess = F.col("_upto") - n + F.when(F.col("start") == first, 0).otherwise(F.floor(n * passed))
    return here.select(KEY, "blk", "t_us", F.when(F.col("blk") == 0, 0).otherwise(guess).cast("bigint").alias("begin"), "start")


def _early(block: int) -> int:
    """How many rows before itself a block may start."""
    return block // 4


def _scan(block: int, carry: list[str]):
    """One block: its input rows and the returned rows from ``begin`` on."""
    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        return _matched(pdf, block, carry)
    return scan


def _matched(pdf: pd.DataFrame, block: int, carry: list[str]) -> pd.DataFrame:
    pdf = pdf.sort_values("idx", kind="stable")
    codes = pdf.groupby(VALUE, sort=False, dropna=False).ngroup().to_numpy()
    is_source = pdf["blk_source"].to_numpy()
    index = pdf["idx"].to_numpy()[is_source]
    copies: dict[int, list[int]] = {}
    for place, code in enumerate(codes[is_source].tolist()):
        copies.setdefault(code, []).append(place)
    for places in copies.values():
        places.reverse()
    last, found = -1, []
    for code in codes[~is_source].tolist():
        places = copies.get(code, ())
        while places and places[-1] <= last:
            places.pop()
        if not places:
            break
        last = places.pop()
        found.append(last)
    at = np.array(found, dtype=np.int64)
    blk, asked = int(pdf["blk"].iloc[0]), int(pdf["begin"].iloc[0])
    # what matches before the block only tells where it begins
    at = at[index[at] >= blk * block]
    source = pdf[is_source]
    return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "blk": [blk], "begin": [asked + len(found) - len(at)], "after": [asked + len(found)],
                         "event_idx": [index[at].tolist()], **{c: [source[c].to_numpy()[at].tolist()] for c in carry}})


def _solve(events: DataFrame, kept: DataFrame, heads: DataFrame, block: int, carry: list[str], early: int = 0) -> DataFrame:
    """Evaluate ``heads`` blocks from ``start``, ``early`` rows before them at most, and ``begin``. n rows match n returned ones at most."""
    blk = div("event_idx", block)
    if early:
        blk = F.explode(F.when(F.col("event_idx") % block >= block - early, F.array(blk, blk + 1)).otherwise(F.array(blk)))
    source = attach(events.withColumn("blk", blk), heads, [KEY, "blk"], name="scan-heads").where("event_idx >= start").select(
        KEY, "blk", "begin", F.lit(True).alias("blk_source"), F.col("event_idx").alias("idx"), *VALUE, *carry)
    asks = heads.withColumn("_b", F.explode(F.array(*[div("begin", block) + i for i in range(3 if early else 2)])))
    target = attach(kept.withColumn("_b", div("kept_idx", block)), asks, [KEY, "_b"], name="scan-asks").where(
        (F.col("kept_idx") >= F.col("begin")) & (F.col("kept_idx") - F.col("begin") < (F.col("blk") + 1) * block - F.col("start")))
    target = target.select(KEY, "blk", "begin", F.lit(False).alias("blk_source"), F.col("kept_idx").alias("idx"), *VALUE,
                           *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in carry])
    kinds = "".join(f", {c} array<{events.schema[c].dataType.simpleString()}>" for c in carry)
    # a block's group holds its input rows and as many returned ones
    return spread(source.unionByName(target), [KEY, "blk"], heads, max(1, PIECE // (2 * block))).groupBy(KEY, "blk").applyInPandas(
        _scan(block, carry), f"{KEY} {events.schema[KEY].dataType.simpleString()}, blk bigint, begin bigint, after bigint, event_idx array<bigint>{kinds}")


def attribute_kept(events: DataFrame, kept: DataFrame, block: int = BLOCK, carry: list[str] | None = None) -> DataFrame:
    """Input index of every returned row: the first copy behind the one of the row before it.

    ``events`` are in time order. ``kept`` holds (recording, kept_idx from 0, t, x, y, p) in output order; both are read several times. From the
    first row that the scan can't find, rows have a NULL ``event_idx``: they are no ordered part of the input. Columns
    ``carry`` of the matched input rows come along. Each round evaluates the blocks that began at a
    wrong row; time-ordered streams take one, or two if runs of equal times are longer than a block,
    and more only where a filter's rate drifts within such a run.
    """
    carry = carry or []
    events = events.select(KEY, "event_idx", *VALUE, *carry)
    rows = kept.select(KEY, "kept_idx", *VALUE)
    heads = stage(_heads(events, rows, block), "scan-begin")
    rounds = [stage(_solve(events, rows, heads.drop("t_us"), block, carry, _early(block)), "scan")]
    ends_of = lambda i: rounds[i].select(KEY, "blk", "begin", "after", F.lit(i).alias("_round"))
    # a recording's blocks: one short row each
    solved = stage(ends_of(0), "scan-ends")
    order = W.partitionBy(KEY).orderBy("blk")
    while True:
        ends = solved.withColumn("_due", F.coalesce(F.lag("after").over(order), F.lit(0)))
        # a block that lags ends too early to tell where the next one begins
        ends = ends.withColumn("_wait", F.coalesce(F.lag(F.col("begin") < F.col("_due")).over(order), F.lit(False)))
        wrong = stage(ends.where("begin <> _due").select(KEY, "blk", F.col("_due").alias("begin"), "_wait"), "scan-wrong")
        if wrong.isEmpty():
            break
        # all before the first wrong block is right; if its row is of an earlier time, nothing behind matches any more
        first = wrong.groupBy(KEY).agg(F.min_by(F.struct("blk", "begin"), "blk").alias("_f")).select(KEY, "_f.*")
        asked = attach(rows.select(KEY, F.col("kept_idx").alias("begin"), F.col("t_us").alias("_t")), first, [KEY, "begin"], name="scan-first")
        over = stage(asked.join(heads.select(KEY, "blk", "t_us"), [KEY, "blk"]).where("_t < t_us").select(KEY, F.col("blk").alias("_over")), "scan-over")
        live = lambda df: df.join(over, KEY, "left").where("_over is null or blk < _over").drop("_over")
        again = live(wrong).where("not _wait").select(KEY, "blk", "begin", (F.col("blk") * block).alias("start"))
        rounds.append(stage(_solve(events, rows, again, block, carry), "scan"))
        new = ends_of(len(rounds) - 1)
        solved = stage(live(solved).join(new.select(KEY, "blk"), [KEY, "blk"], "left_anti").unionByName(new), "scan-ends")
    pairs = F.arrays_zip("event_idx", *carry)
    tables = [t.drop("begin", "after").withColumn("_round", F.lit(i)) for i, t in enumerate(rounds)]
    last = attach(reduce(DataFrame.unionByName, tables), solved.drop("after"), [KEY, "blk", "_round"], name="scan-last")
    found = last.select(KEY, "begin", F.posexplode(pairs).alias("_i", "_m")).select(
        KEY, (F.col("begin") + F.col("_i")).alias("kept_idx"), F.col("_m.event_idx").alias("event_idx"), *[F.col(f"_m.{c}").alias(c) for c in carry])
    reach = solved.groupBy(KEY).agg(F.max("after").alias("_reach"))
    lost = attach(rows, reach, [KEY], "left", name="scan-reach").where(F.coalesce("_reach", F.lit(0)) <= F.col("kept_idx")).select(
        KEY, "kept_idx", F.lit(None).cast("bigint").alias("event_idx"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in carry])
    return found.unionByName(lost)


def with_packet(events: DataFrame, packet_table: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add each event's packet ``start``: the last start at or before it, as a running maximum.

    The maximum runs inside blocks of consecutive events; what a block begins with comes from one
    row per block.
    """
    blk = div("event_idx", block)
    columns = [c for c in events.columns if c != KEY]
    marks = packet_table.select(KEY, F.col("start").alias("event_idx"), F.col("start").alias("_mark"), F.lit(None).cast(
        events.select(F.struct(*columns).alias("_row")).schema["_row"].dataType).alias("_row"))
    rows = events.select(KEY, "event_idx", F.lit(None).cast("bigint").alias("_mark"), F.struct(*columns).alias("_row"))
    both = rows.unionByName(marks).withColumn("_b", blk)
    tops = both.groupBy(KEY, "_b").agg(F.max("_mark").alias("_top"))
    before = W.partitionBy(KEY).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    entry = tops.select(KEY, "_b", F.max("_top").over(before).alias("_entry"))
    inside = W.partitionBy(KEY, "_b").orderBy("event_idx", F.col("_mark").isNull()).rowsBetween(W.unboundedPreceding, 0)
    placed = both.withColumn("_in", F.max("_mark").over(inside)).where(F.col("_row").isNotNull())
    return attach(placed, entry, [KEY, "_b"], name="entries").select(
        KEY, *[F.col(f"_row.{c}").alias(c) for c in columns], F.coalesce("_in", "_entry").alias("start"))
