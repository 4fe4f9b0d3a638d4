"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of consecutive words, a window into shingles. Shingles are ordered by
rarity, counted over all documents. A document that holds a window whole holds all its shingles,
so the shortest prefix that can't be missed is one: the window's rarest. Documents meet windows
at that shingle only; its places in both give where the window would begin, which must lie in the
document to its end (positional and length bound); then the words are compared one by one.

Before the join, shingles pass a bitmap of fixed size, so the texts are read in place and only
the few rows that may match are shuffled, however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .bitmap import BITS, bitmap, unpacked
from .common import WordHashes, rows_by_size

#: Bytes of a text that are split into words at a time.
SEGMENT = 4 << 20
#: ASCII letters in lower case and digits stay, other ASCII parts words; bytes of other characters are words'.
_FLAT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive words."""
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ hashes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out * np.uint64(0xD6E8FEB86659FD93)


def stretches(text: bytes, size: int) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """``base, lo, hi, words``: the words from the ``base``-th on, of which ``lo`` to ``hi`` are to be
    looked at now; up to ``size`` words stand on either side of them. Long texts give several."""
    flat = text.translate(_FLAT)
    start, base, lo, tail = 0, 0, 0, []
    while True:
        cut = flat.find(b" ", start + SEGMENT) if len(flat) - start > SEGMENT else -1
        words = tail + flat[start:None if cut < 0 else cut].split()
        hi = len(words) if cut < 0 else max(lo, len(words) - size)
        yield base, lo, hi, words
        if cut < 0:
            return
        first = max(0, hi - size)
        start, base, lo, tail = cut, base + first, hi - first, words[first:]


def _met(parts: list[tuple[int, int, int, list[bytes]]], widths: list[int], bits: np.ndarray, hashes: WordHashes):
    """``width, part, place, token`` of every shingle that the bitmap lets pass."""
    sizes = np.fromiter((len(p[3]) for p in parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(p[3] for p in parts)), np.uint64, int(sizes.sum()))
    lows, highs = (np.array([p[k] for p in parts], np.int64) for k in (1, 2))
    for width in widths:
        tokens = shingles(flat, width)
        at = np.flatnonzero(bits[tokens >> np.uint64(64 - BITS)])
        part = np.searchsorted(ends, at, "right")
        place = at - (ends[part] - sizes[part])
        fits = (place + width <= sizes[part]) & (place >= lows[part]) & (place < highs[part])
        yield width, part[fits], place[fits], tokens[at[fits]].view(np.int64)


def _windows(benchmark: DataFrame, item: str, text: str, size: int, width: int) -> DataFrame:
    """``item, window, length, tokens``: a row for each place of an item at which a window begins;
    the window as its words with single spaces between."""
    def cut(batches):
        for batch in batches:
            hashes = WordHashes()
            for i, t in enumerate(batch.column("t").to_pylist()):
                words = (t or "").encode().translate(_FLAT).split()
                if not words:
                    continue
                length = min(size, len(words))
                w = min(width, length)
                tokens = shingles(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), w).view(np.int64)
                each = length - w + 1
                for first in range(0, len(words) - length + 1, 10_000):
                    starts = range(first, min(first + 10_000, len(words) - length + 1))
                    n = len(starts)
                    lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * each, pa.array(
                        tokens[np.arange(first, first + n)[:, None] + np.arange(each)].ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("item").take(pa.array([i] * n)), pa.array([b" ".join(words[s:s + length]).decode() for s in starts], pa.string()),
                         pa.array([length] * n, pa.int32()), lists], ["item", "window", "length", "tokens"])
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("t"))
    kind = benchmark.schema[item].dataType.simpleString()
    return rows.mapInArrow(cut, f"item {kind}, window string, length int, tokens array<long>")


def _counts(docs: DataFrame, text: str, size: int, widths: list[int], tokens: DataFrame) -> DataFrame:
    """``token, n``: how often each of ``tokens`` stands in the documents."""
    packed = docs.sparkSession.sparkContext.broadcast(bitmap(tokens, "token"))

    def count(batches):
        bits, hashes = unpacked(packed.value), WordHashes()
        for batch in rows_by_size(batches, "t"):
            for parts in _packed(batch, size):
                found = [t for _, _, _, t in _met([p[1] for p in parts], widths, bits, hashes)]
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["token", "n"])
    found = docs.select(F.col(text).alias("t")).mapInArrow(count, "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n")).join(tokens, "token", "left_semi")


def _packed(batch: pa.RecordBatch, size: int) -> Iterator[list[tuple[int, tuple]]]:
    """Stretches of the batch's texts with their row, a bounded number of bytes at a time."""
    parts, held = [], 0
    for i, t in enumerate(batch.column("t").to_pylist()):
        for part in stretches((t or "").encode(), size):
            if held and held + len(part[3]) > SEGMENT // 4:
                yield parts
                parts, held = [], 0
            parts.append((i, part))
            held += len(part[3])
    if parts:
        yield parts


def _hits(docs: DataFrame, key: str, text: str, size: int, widths: list[int], prefixes: DataFrame) -> DataFrame:
    """Rows ``k, at, n_words`` of all documents, and rows ``at, place, token, context, left`` of the
    shingles that may be a prefix: ``context`` are the words that a window around it may cover, of
    which ``left`` stand before it."""
    packed = docs.sparkSession.sparkContext.broadcast(bitmap(prefixes, "token"))
    most = max(widths, default=1)

    def find(batches):
        bits, hashes = unpacked(packed.value), WordHashes()
        for batch in rows_by_size(batches, "t"):
            words = np.zeros(batch.num_rows, np.int64)
            ids = batch.column("at").to_numpy()
            for parts in _packed(batch, size):
                rows, stretch = [p[0] for p in parts], [p[1] for p in parts]
                for i, (base, _, _, held) in parts:
                    words[i] = base + len(held)
                at, places, tokens, contexts, left = [], [], [], [], []
                for width, part, place, token in _met(stretch, widths, bits, hashes):
                    side = size - 1 if width == most else 0
                    for p, k in zip(part.tolist(), place.tolist()):
                        base, _, _, held = stretch[p]
                        first = max(0, k - side)
                        contexts.append([w.decode() for w in held[first:k + max(side + 1, width)]])
                        at.append(ids[rows[p]])
                        places.append(base + k)
                        left.append(k - first)
                    tokens.append(token)
                if at:
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(n, batch.schema.field("k").type), pa.array(at, pa.int64()), pa.nulls(n, pa.int64()), pa.array(places, pa.int64()),
                         pa.array(np.concatenate(tokens)), pa.array(contexts, pa.list_(pa.string())), pa.array(left, pa.int32())], names)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("at"), pa.array(words), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                                              pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.int32())], names)
    names = ["k", "at", "n_words", "place", "token", "context", "left"]
    rows = docs.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("at"), F.col(text).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(find, f"k {kind}, at long, n_words long, place long, token long, context array<string>, left int")


def _merged(spans: DataFrame) -> DataFrame:
    """``at, spans``: the union of ``start, stop`` ranges of each document, in order."""
    order = Window.partitionBy("at").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("part", F.sum("new").over(order))
    whole = parts.groupBy("at", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return whole.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", size: int = 10, width: int = 4) -> DataFrame:
    """``key, n_words, spans, items`` of every row of ``docs``.

    Words are runs of ASCII letters (in lower case), digits and characters beyond ASCII. ``spans``
    are the ranges ``start, stop`` of the document's words that lie in an occurrence of a window of
    ``size`` words of a benchmark item (of all its words, if it has fewer); ranges that touch are
    one. ``items`` are the distinct ids, in their order, of the items with such windows. Rows stay
    as they are, repeated ones too; null and wordless texts have no words and no spans. Items
    without words have no windows; rows of one id are one item; windows of items with a null id
    count in ``spans``, not in ``items``. An empty benchmark leaves every document clean. Other columns
    are not read. Texts of any length are read in bounded parts; ``width`` words make a shingle."""
    cut = stage(_windows(benchmark, item, item_text, size, width), "windows-cut")
    windows = cut.groupBy("window").agg(F.first("length").alias("length"), F.first("tokens").alias("tokens"))
    windows = stage(windows.withColumn("id", F.monotonically_increasing_id()), "windows")
    owners = stage(cut.filter("item is not null").select("item", "window").distinct().join(windows.select("window", "id"), "window").select("item", "id"), "window-items")
    widths = sorted(r[0] for r in windows.select(F.least("length", F.lit(width))).distinct().collect())
    tokens = windows.select("id", F.posexplode("tokens").alias("offset", "token"))
    counts = _counts(docs, text, size, widths, tokens.select("token").distinct())
    rarest = tokens.join(counts, "token").groupBy("id").agg(F.min(F.struct("n", "token", "offset")).alias("one"), F.count("*").alias("known"))
    # a window of which a shingle stands nowhere can't occur
    prefixes = windows.join(rarest, "id").filter(F.col("known") == F.size("tokens"))
    prefixes = stage(prefixes.select("id", "window", "length", "one.token", "one.offset"), "window-prefixes")
    rows = stage(_hits(docs, key, text, size, widths, prefixes), "window-hits")
    documents = rows.filter("place is null").select("k", "at", "n_words")
    hits = rows.filter("place is not null").select("at", "place", "token", "context", "left")
    start, inner = F.col("place") - F.col("offset"), F.col("left") - F.col("offset")
    met = hits.join(prefixes, "token").filter(inner >= 0).filter(inner + F.col("length") <= F.size("context"))
    met = met.filter(F.array_join(F.slice("context", F.greatest(inner, F.lit(0)) + 1, F.col("length")), " ") == F.col("window"))
    met = stage(met.select("at", "id", start.alias("start"), (start + F.col("length")).alias("stop")), "window-met")
    spans = _merged(met.select("at", "start", "stop").distinct())
    items = met.select("at", "id").distinct().join(owners, "id").groupBy("at").agg(F.array_sort(F.collect_set("item")).alias("items"))
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return documents.join(spans, "at", "left").join(items, "at", "left").select(
        F.col("k").alias(key), "n_words", F.coalesce("spans", empty).alias("spans"),
        F.coalesce("items", F.array().cast(items.schema["items"].dataType)).alias("items"))
