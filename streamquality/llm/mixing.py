"""Mixing sources to target weights, by blocks.

A source's documents are laid end to end and cut into blocks of ``block`` words. Every output
shard draws how many blocks it takes of each source (a multinomial over the targets); the draws
of a source are numbered, and draw ``i`` is block ``permutation(i mod blocks)`` of pass ``i div
blocks``, under a pseudorandom permutation keyed by source and pass. So each block is taken
equally often give or take one, and who holds a block is a join by its index. As independent
draws miss a target by about the root of it, a source's surplus draws are put back and its
missing ones spread over the shards, both in a hashed order of shards.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import stage
from .common import arrow_map

SPREAD = 256
PIECE = 1 << 17  # slots that a task writes out
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """``total`` shared by weight; a source stops at ``most`` times its size, and what it can't
    take is shared again by weight among the others, until none is above."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in sorted(open_) if weights[i] * unit > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in above:
            out[i] = most * float(sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of ``range(n)``: four Feistel rounds over the next power of
    four, walked on until the value is below ``n`` again."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = x.astype(np.uint64).copy()
    open_ = np.arange(len(x))
    while len(open_):
        v = x[open_]
        left, right = v >> half, v & mask
        for r in range(4):
            with np.errstate(over="ignore"):
                f = _mixed(right + np.uint64((key * 4 + r) % (1 << 64)))
            left, right = right, left ^ (f & mask)
        x[open_] = left << half | right
        open_ = open_[x[open_] >= np.uint64(n)]
    return x.astype(np.int64)


def lay_out(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``key, size, source, offset``: where each document begins among its source's words. Sums
    run over hashed parts of a source, so no task holds a source."""
    rows = stage(df.select(
        F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(
            F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text)).alias("tie"), F.pmod(F.xxhash64(F.col(key)), F.lit(SPREAD)).alias("part")), "mix-sizes")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("before", F.coalesce(F.sum("words").over(
        Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("source", "part").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    parts = stage(parts, "mix-parts")
    same = rows["source"].eqNullSafe(parts["source"]) & (rows["part"] == parts["part"])
    return rows.join(parts, same).select("key", "tie", "size", rows["source"], (F.col("before") + F.col("inside")).alias("offset"))


def plan_sources(items: DataFrame, share: float, most: float, weights: list[float], block: int) -> list[dict]:
    """One entry per source, in code-point order with null last: the mixture itself, as a user
    would write it down. Its length is the number of sources, not of documents."""
    sizes = items.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    each = [weights[i % len(weights)] for i in range(len(sizes))]
    aims = targets([r["n"] for r in sizes], each, share * sum(r["n"] for r in sizes), most)
    plan = []
    for i, (r, aim) in enumerate(zip(sizes, aims)):
        blocks = -(-r["n"] // block)
        draws = min(int(aim * blocks / r["n"] + 0.5), int(most * blocks)) if r["n"] else 0
        plan.append({"no": i, "source": r["source"], "source_size": r["n"], "target": aim, "blocks": blocks, "draws": draws})
    return plan


def draw_slots(spark: SparkSession, plan: list[dict], seed: int, shard_slots: int) -> DataFrame:
    """``shard, no, turn, block, copy``: every slot of every output shard. ``copy`` is the pass
    over the source, from 0. A shard's draws of a source are one short row until they are dealt out to
    tasks of ``PIECE`` slots each."""
    drawn = [s for s in plan if s["draws"]]
    schema = "shard long, no int, turn long, block long, copy int"
    total = sum(s["draws"] for s in drawn)
    if not total:
        return spark.createDataFrame([], schema)
    shards = -(-total // shard_slots)
    odds = np.array([s["draws"] for s in drawn], float) / total
    nos = np.array([s["no"] for s in drawn], np.int32)

    def counts(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                slots = min(shard_slots, total - shard * shard_slots)
                n = np.random.default_rng([seed, shard]).multinomial(slots, odds)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard)), pa.array(nos), pa.array(n)],
                                                 ["shard", "no", "n"])
    spec = spark.createDataFrame([(s["no"], s["draws"], s["blocks"], zlib.crc32(repr((s["source"], seed)).encode()))
                                  for s in drawn], "no int, draws long, blocks long, salt long")
    order = Window.partitionBy("no").orderBy(F.xxhash64("shard", "no", F.lit(seed)), "shard")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.range(shards).mapInArrow(counts, "shard long, no int, n long").join(F.broadcast(spec), "no")
    rows = rows.withColumns({"seen": F.coalesce(F.sum("n").over(before), F.lit(0)), "rank": F.row_number().over(order) - 1,
                             "all": F.sum("n").over(Window.partitionBy("no"))})
    kept = F.least("n", F.greatest(F.col("draws") - F.col("seen"), F.lit(0)))
    missing = F.greatest(F.col("draws") - F.col("all"), F.lit(0))
    extra = F.floor(missing / shards) + (F.col("rank") < F.pmod(missing, F.lit(shards))).cast("long")
    rows = rows.withColumn("n", (kept + extra).cast("long"))
    rows = rows.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("n > 0")

    def slots(batches):
        for batch in batches:
            for r in batch.to_pylist():
                draw = np.arange(r["first"], r["first"] + r["n"])
                copy, at = draw // r["blocks"], draw % r["blocks"]
                block = np.concatenate([permuted(at[copy == c], r["blocks"], r["salt"] << 20 | int(c)) for c in np.unique(copy)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(draw), r["shard"])), pa.array(np.full(len(draw), r["no"], np.int32)),
                     pa.array(np.arange(len(draw))), pa.array(block), pa.array(copy.astype(np.int32))],
                    ["shard", "no", "turn", "block", "copy"])
    rows = rows.select("shard", "no", "first", "n", "blocks", "salt").repartition(-(-total // PIECE), "shard", "no")
    return rows.mapInArrow(slots, schema)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5,
        most: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0), block: int = 64, shard_slots: int = 4096,
        seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``items`` and ``slots`` of the mixture.

    ``items``: ``key, tie, size, source, no, source_size, target, offset``, a row for each document.
    ``tie`` is xxhash64 of the text. ``slots``: ``shard, turn, no, copy, offset, from_word, to_word``: which words of which
    document (the one at ``offset`` of source ``no``) fill a slot; a slot at a document's end has
    several rows. A null or blank text has size 0 and fills nothing. A null source is a source.
    Repeated rows are documents of their own. An empty table gives two empty tables. A block is
    taken ``most`` times at most, so no document exceeds ``most`` times its size; a source misses
    its target by less than two blocks. Equal inputs and seeds give equal mixtures."""
    spark = df.sparkSession
    items = stage(lay_out(df, key, text, source), "mix-items")
    plan = plan_sources(items, share, most, list(weights), block)
    spec = spark.createDataFrame([(s["no"], s["source"], s["source_size"], s["target"]) for s in plan],
                                 f"no int, name {df.schema[source].dataType.simpleString()}, source_size long, target double")
    items = items.join(F.broadcast(spec), items["source"].eqNullSafe(spec["name"])).drop("name")
    ends = F.col("offset") + F.col("size")
    pieces = items.filter("size > 0").select("no", "offset", "size", F.explode(F.sequence(
        F.floor(F.col("offset") / block), F.floor((ends - 1) / block))).alias("block"))
    pieces = pieces.select(
        "no", "block", "offset", F.greatest(F.lit(0), F.col("block") * block - F.col("offset")).alias("from_word"),
        F.least(F.col("size"), (F.col("block") + 1) * block - F.col("offset")).alias("to_word"))
    # Spark sizes slots by the short rows they are made of, and blocks by the documents: it would broadcast either
    slots = draw_slots(spark, plan, seed, shard_slots).hint("merge").join(pieces.hint("merge"), ["no", "block"])
    return items.withColumnRenamed("key", key), slots.select("shard", "turn", "no", "copy", "offset", "from_word", "to_word")


def mixed_texts(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The rows of ``df`` with the words that the mixture takes of each, pass by pass, in their
    order and with the white space between them; passes, and words apart, are parted by a line
    feed. A row of which nothing is taken is left out. Other columns are carried along, whatever their names."""
    items, slots = mix(df, key, text, source, **settings)
    runs = slots.groupBy("no", "offset").agg(F.sort_array(F.collect_list(F.struct("copy", "from_word", "to_word"))).alias("runs"))
    taken = items.filter("size > 0").join(runs, ["no", "offset"]).select(
        F.col(key).alias("k2"), F.col("tie").alias("tie2"), F.col("source").alias("s2"), "runs", "offset")
    order = Window.partitionBy("k2", "tie2", "s2").orderBy("offset")
    taken = taken.withColumn("copy2", F.row_number().over(order)).drop("offset")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("row"), F.col(key).alias("k"),
                     F.col(source).alias("s"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("tie"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("k", "tie", "s").orderBy(F.lit(0))))
    same = (F.col("k").eqNullSafe(F.col("k2")) & (F.col("tie") == F.col("tie2")) & F.col("s").eqNullSafe(F.col("s2")) & (F.col("copy") == F.col("copy2")))
    rows = rows.join(taken, same).select("row", "t", "runs")

    def cut(batch):
        texts = []
        for t, taken in zip(batch.column("t").to_pylist(), batch.column("runs").to_pylist()):
            at = [m.span() for m in _WORD.finditer(t)]
            joined: list[list[int]] = []
            for r in taken:
                if joined and joined[-1][0] == r["copy"] and joined[-1][2] == r["from_word"]:
                    joined[-1][2] = r["to_word"]
                else:
                    joined.append([r["copy"], r["from_word"], r["to_word"]])
            texts.append("\n".join(t[at[a][0]:at[b - 1][1]] for _, a, b in joined))
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "t"])
    done = arrow_map(rows, cut, rows.select("row", "t").schema, "t")
    return done.select(*[F.col("t").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])
