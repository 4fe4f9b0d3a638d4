"""Lempel-Ziv phrase fingerprints.

A text's bytes are parsed into the phrases of a growing dictionary: each phrase is the shortest
one not seen before. The set of their hashes stands for what a compressor would learn from the
text; its ``size`` smallest values are the fingerprint, and the share of the smallest values of
two fingerprints' union that both hold estimates the likeness of the phrase sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 128
_MASK = (1 << 64) - 1


class Phrases:
    """The dictionary, which goes on when more bytes come."""

    def __init__(self, step=None, hashes=None, node: int = 0):
        self.step, self.hashes, self.node = step or {}, hashes or [0], node

    def copy(self) -> Phrases:
        return Phrases(self.step.copy(), self.hashes.copy(), self.node)

    def feed(self, data: bytes) -> Phrases:
        step, hashes, node, get = self.step, self.hashes, self.node, self.step.get
        for b in data:
            key = node << 8 | b
            after = get(key)
            if after is None:
                step[key] = len(hashes)
                hashes.append((hashes[node] * 0x9E3779B97F4A7C15 + b + 1) & _MASK)
                node = 0
            else:
                node = after
        self.node = node
        return self

    def fingerprint(self, size: int) -> np.ndarray:
        x = np.array(self.hashes[1:], np.uint64)
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        x = np.unique((x >> np.uint64(32)).astype(np.uint32))
        return x[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """Estimated Jaccard likeness of two phrase sets; of two empty ones 1."""
    if not len(a) and not len(b):
        return 1.0
    smallest = np.union1d(a, b)[:size]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(smallest, both, assume_unique=True).sum() / len(smallest))


def text_of(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``key, fingerprint string`` of every row: the hashes in hex, ascending. A null text counts
    as empty and has the empty fingerprint; equal texts have equal ones; repeated rows stay."""
    def run(batches):
        for batch in batches:
            prints = [text_of(Phrases().feed((t or "").encode()).fingerprint(size)) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(prints, pa.string())], ["k", "fingerprint"])
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(
        run, f"k {df.schema[key].dataType.simpleString()}, fingerprint string")
    return rows.withColumnRenamed("k", key)


def in_order_with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """``part, extra, key, text``: rows by descending key in parts, each part followed by an extra
    row, the document that comes after it (after the last part the first of all). One shuffle of
    the texts; the driver sees one key per part."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    bounds = sorted(set(rows.filter("key is not null").approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)))
    at = F.lit(0)
    if bounds:
        over = F.array(*[F.lit(int(b)) for b in bounds])
        at = F.coalesce(F.size(F.filter(over, lambda b: b > F.col("key"))), F.lit(len(bounds)))
    rows = rows.withColumn("part", at)
    heads = sorted((r["part"], r["head"]) for r in rows.groupBy("part").agg(F.max("key").alias("head")).collect())
    follow = [(heads[(i + 1) % len(heads)][1], part) for i, (part, _) in enumerate(heads)]
    kind = df.schema[key].dataType.simpleString()
    follow = df.sparkSession.createDataFrame(follow, f"head {kind}, part int")
    first = [h for _, h in heads if h is not None]
    head = rows.filter(F.col("key").isin(first) | F.col("key").isNull() if any(h is None for _, h in heads) else F.col("key").isin(first))
    head = head.drop("part").join(F.broadcast(follow), F.col("key").eqNullSafe(F.col("head")))
    both = rows.select("part", F.lit(False).alias("extra"), "key", "text").union(
        head.select("part", F.lit(True).alias("extra"), "key", "text"))
    return both.repartitionById(max(1, len(bounds) + 1), F.col("part")).sortWithinPartitions(
        "part", "extra", F.col("key").desc_nulls_last(), F.col("text").desc_nulls_last())


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Every text's fingerprint against that of its edited text, whose last third (in code
    points, rounded down) is the beginning of the next document in descending key order (after
    the last the first), and against the next document's.

    ``key, n_chars, edited string, fingerprint, edited_fingerprint, near_edited, near_next``. A
    null text counts as empty; rows of equal keys are ordered by text, descending; null keys come
    last. The parse of the first two thirds is shared by a text and its edit."""
    def run(batches):
        held = extra_seen = None
        rows: list[tuple] = []

        def finish(row, after, after_print):
            k, t, own, whole, kept = row
            cut = len(t) // 3
            head = after[:cut]
            edited = whole.feed(head.encode()).fingerprint(size)
            rows.append((k, len(t), kept + head, text_of(own), text_of(edited), likeness(own, edited, size),
                         likeness(own, after_print, size)))

        for batch in batches:
            for k, t, extra in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "extra"))):
                if extra and extra_seen:
                    continue
                extra_seen = extra
                t = t or ""
                kept = t[:len(t) - len(t) // 3]
                shared = Phrases().feed(kept.encode())
                own = shared.copy().feed(t[len(kept):].encode()).fingerprint(size)
                if held:
                    finish(held, t, own)
                held = None if extra else (k, t, own, shared, kept)
                if sum(len(r[2]) for r in rows[-1:]) + len(rows) * 4000 > 4_000_000:
                    yield emit(rows)
                    rows = []
        if rows:
            yield emit(rows)

    kind = df.schema[key].dataType
    schema = (f"key {kind.simpleString()}, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.int64()), pa.int64(), pa.string(), pa.string(),
             pa.string(), pa.float64(), pa.float64()]

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return in_order_with_next(df, key, text).mapInArrow(run, schema).withColumnRenamed("key", key)
