"""Removal of byte strings that an earlier place of the corpus already holds, by sorted suffixes.

A suffix per byte would ship ``length`` bytes for each one of the corpus. Instead suffixes begin
at anchors: of every ``length`` bytes, the place whose ``gram`` has the smallest hash, so equal
strings have their anchor at the same place, and anchors whose gram occurs once can't lie in a
repeated string. For the others, the bytes after and before the anchor are dealt out by sampled
splitters on the leading bytes. Splitters are cut to a gram, so what must be compared never lies
across a boundary. Each bucket sorts what follows the anchors by multikey quicksort, and what
precedes them likewise, and reads from neighbours' common prefixes which strings around an anchor
have an earlier equal.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .common import rows_by_size

GRAM = 32
HEAVY = 200_000
_PLACE = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes at each place; ``gram`` is a power of two."""
    h, base, size = _BYTES[data], _BASE, 1
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * base + h[size:]
            base, size = base * base, size * 2
    return _mix(h)


def anchors(data: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors: for each window of ``length`` bytes the leftmost of
    its smallest grams. Long texts are read in overlapping parts."""
    places, hashes = [], []
    window, step = length - gram + 1, (1 << _PLACE) - length
    mask = np.uint64((1 << _PLACE) - 1)
    for start in range(0, max(1, len(data) - length + 1), step):
        part = np.frombuffer(data, np.uint8, min(len(data) - start, step + length - 1), start)
        if len(part) < length:
            break
        h = _gram_hashes(part, gram)
        low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= window:
            low, size = np.minimum(low[:-size], low[size:]), size * 2
        if size < window:
            low = np.minimum(low[:size - window], low[window - size:])
        at = low[np.r_[True, low[1:] != low[:-1]]] & mask
        places.append(at.astype(np.int64) + start)
        hashes.append(h[at.astype(np.int64)])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """The order of byte rows of equal width, by three-way quicksort on eight bytes at a time;
    few rows are sorted at once."""
    m, width = rows.shape
    words = np.zeros((m, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order, todo = np.arange(m), [(0, m, 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth >= words.shape[1]:
            continue
        here = order[lo:hi]
        if hi - lo <= 256:
            order[lo:hi] = here[np.lexsort(words[here, depth:].T[::-1])]
            continue
        key = words[here, depth]
        pivot = np.partition(key[[0, len(key) // 2, -1]], 1)[1]
        less, equal = key < pivot, key == pivot
        a, b = int(less.sum()), int(equal.sum())
        order[lo:hi] = np.concatenate([here[less], here[equal], here[~less & ~equal]])
        todo += [(lo, lo + a, depth), (lo + a, lo + a + b, depth + 1), (lo + a + b, hi, depth)]
    return order


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the common prefix of each with the one before it in that order."""
    order = multikey_order(rows)
    sorted_ = rows[order]
    other = sorted_[1:] != sorted_[:-1]
    common = np.where(other.any(1), other.argmax(1), rows.shape[1])
    return order, np.r_[0, common]


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of ``width`` bytes, and their lengths."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    size = np.diff(offsets)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    out = np.zeros((len(column), width), np.uint8)
    inside = np.arange(width) < size[:, None]
    out[inside] = data[offsets[0]:offsets[-1]]
    return out, size


def repeats(after: pa.Array, before: pa.Array, rank: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor, the smallest and largest number of bytes before it at which a string of
    ``length`` begins that an anchor of smaller ``rank`` has as well; -1 if none."""
    right, r_size = _matrix(after, length)
    left, l_size = _matrix(before, length - gram)
    r_order, r_common = _classes(right)
    l_order, l_common = _classes(left)
    low, high = np.full(len(rank), -1), np.full(len(rank), -1)
    r_class, l_class = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
    for d in range(length - gram + 1):
        r_class[r_order] = np.cumsum(r_common < length - d)
        l_class[l_order] = np.cumsum(l_common < d) if d else 0
        fit = np.flatnonzero((l_size >= d) & (r_size >= length - d))
        key = r_class[fit] * (len(rank) + 1) + l_class[fit]
        by = np.lexsort((rank[fit], key))
        if not len(by):
            continue
        starts = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        least = np.repeat(rank[fit[by[starts]]], np.diff(np.r_[starts, len(by)]))
        hit = fit[by[rank[fit[by]] > least]]
        low[hit] = np.where(low[hit] < 0, d, low[hit])
        high[hit] = d
    return low, high


_ROW = "bucket int, after binary, before binary, k bigint, tie bigint, pos int, lo int, hi int"
_NAMES = ["bucket", "after", "before", "k", "tie", "pos", "lo", "hi"]
_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _contexts(batches: Iterator[pa.RecordBatch], splitters: list[bytes], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """A row for each anchor with its surroundings. Where a task meets the same surroundings
    again, the later place is wholly a repeat: it leaves as an interval (``lo``, ``hi``), so
    frequent passages are sent once per task."""
    first: dict[tuple[bytes, bytes], tuple[int, int, int]] = {}
    rows: list[tuple] = []

    def whole(place, after, before, serial):
        k, tie, pos = place
        if len(after) + len(before) >= length:
            rows.append((serial % (len(splitters) + 1), None, None, k, tie, pos, pos - len(before), pos + len(after)))

    for batch in batches:
        for k, tie, at, t in zip(*(batch.column(c).to_pylist() for c in ("k", "tie", "at", "t"))):
            data = t.encode()
            for pos in at:
                after, before = data[pos:pos + length], data[max(0, pos - length + gram):pos][::-1]
                place, known = (k, tie, pos), first.get((after, before))
                if known is None:
                    if len(first) >= 100_000:
                        first.clear()
                    first[after, before] = place
                    rows.append((bisect.bisect_right(splitters, after[:gram]), after, before, k, tie, pos, None, None))
                elif known < place:
                    whole(place, after, before, len(rows))
                elif place < known:  # the earlier one goes on; the one already sent is a repeat of it
                    first[after, before] = place
                    rows.append((bisect.bisect_right(splitters, after[:gram]), after, before, k, tie, pos, None, None))
            if len(rows) > 20_000:
                yield _row_batch(rows)
                rows = []
    if rows:
        yield _row_batch(rows)


def _intervals(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """``k, tie, lo, hi``: what is repeated around each anchor of a sorted bucket. Anchors are
    taken together up to about 30,000, and always all of one gram."""
    names = ["k", "tie", "lo", "hi"]

    def solve(part: pa.Table):
        part = part.combine_chunks()
        batch = part.to_batches()[0]
        k, tie, pos = (batch.column(c).to_numpy() for c in ("k", "tie", "pos"))
        rank = np.empty(len(k), np.int64)
        order = np.lexsort((pos, tie, k))
        changed = np.r_[False, (k[order][1:] != k[order][:-1]) | (tie[order][1:] != tie[order][:-1]) | (pos[order][1:] != pos[order][:-1])]
        rank[order] = np.cumsum(changed)
        low, high = repeats(batch.column("after"), batch.column("before"), rank, length, gram)
        hit = high >= 0
        return pa.RecordBatch.from_arrays([pa.array(k[hit]), pa.array(tie[hit]), pa.array((pos - high)[hit].astype(np.int32)),
                                           pa.array((pos - low + length)[hit].astype(np.int32))], names)

    held, n = [], 0
    for batch in batches:
        done = batch.filter(pc.is_valid(batch.column("lo")))
        if done.num_rows:
            yield done.select(names)
        batch = batch.filter(pc.is_null(batch.column("lo")))
        if not batch.num_rows:
            continue
        grams = pc.binary_slice(batch.column("after"), 0, gram)
        new = pc.not_equal(grams.slice(1), grams.slice(0, len(grams) - 1)).to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.flatnonzero(new) + 1]
        if n >= 30_000 and pc.binary_slice(held[-1].column("after").slice(held[-1].num_rows - 1, 1), 0, gram)[0] != grams[0]:
            yield solve(pa.Table.from_batches(held))
            held, n = [], 0
        if n + batch.num_rows >= 30_000 and len(starts) > 1:
            cut = int(starts[-1])
            held.append(batch.slice(0, cut))
            yield solve(pa.Table.from_batches(held))
            held, n = [], 0
            batch = batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield solve(pa.Table.from_batches(held))


def _heavy_intervals(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for anchors of a gram too frequent for one task: every string around them is a
    row, and the earliest of equal ones is found by an aggregate."""
    place = F.struct("k", "tie", "pos")
    near = F.sequence(F.lit(0), F.lit(length - gram))
    each = rows.select(place.alias("place"), "after", "before", F.explode(near).alias("d")).filter(
        (F.length("before") >= F.col("d")) & (F.length("after") >= length - F.col("d")))
    text = F.concat(F.col("before").substr(F.lit(1), F.col("d")), F.col("after").substr(F.lit(1), length - F.col("d")))
    each = each.select("place", "d", F.sha2(text, 256).alias("text"))
    first = each.groupBy("d", "text").agg(F.min("place").alias("first"))
    later = each.join(first, ["d", "text"]).filter(F.col("first") < F.col("place"))
    spans = later.groupBy("place").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    return spans.select("place.k", "place.tie", (F.col("place.pos") - F.col("high")).cast("int").alias("lo"),
                        (F.col("place.pos") - F.col("low") + length).cast("int").alias("hi"))


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in rows_by_size(batches, "t"):
        h_out, k_out, tie_out, pos_out = [], [], [], []
        for k, tie, t in zip(*(batch.column(c).to_pylist() for c in ("k", "tie", "t"))):
            at, h = anchors(t.encode(), length, gram)
            h_out.append(h.astype(np.int64))
            pos_out.append(at.astype(np.int32))
            k_out.append(np.full(len(at), k))
            tie_out.append(np.full(len(at), tie))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (h_out, k_out, tie_out, pos_out)], ["h", "k", "tie", "pos"])


def _splitters(docs: DataFrame, parts: int, length: int, gram: int, sample: int) -> list[bytes]:
    """Leading bytes that cut the anchors' suffixes into ``parts`` of about one size, from those of
    ``sample`` texts at most. They decide only where a suffix is dealt to."""
    def leading(batches):
        for batch in batches:
            found = []
            for t in batch.column("t").to_pylist():
                data = t.encode()
                found += [data[p:p + gram] for p in anchors(data, length, gram)[0].tolist()[::8]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["b"])
    picked = docs.select("t").limit(sample).mapInArrow(leading, "b binary")
    found = sorted(bytes(r["b"]) for r in picked.collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def find(docs: DataFrame, key: str, text: str, length: int = 100, gram: int = GRAM, heavy: int = HEAVY, sample: int = 2000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows``: ``k, tie, t`` of every document; ``spans``: ``k, tie, lo, hi``, repeated bytes that
    overlap; ``firsts``: ``k, tie`` of the documents whose whole text is not that of an earlier one
    (the others, of ``length`` bytes or more, are repeats as a whole and not in ``spans``)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = F.coalesce(F.col(text), F.lit(""))
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), lowest).alias("k"), F.xxhash64(t).alias("tie"), t.alias("t"))
    full = rows.filter(F.octet_length("t") >= length).select("k", "tie", "t")
    marks = stage(full.select("k", "tie", F.sha2(F.col("t").cast("binary"), 256).alias("digest")), "repeat-texts")
    firsts = marks.groupBy("digest").agg(F.min(F.struct("k", "tie")).alias("f")).select("f.k", "f.tie")
    firsts = stage(firsts, "repeat-firsts")

    found = full.mapInArrow(lambda b: _anchor_rows(b, length, gram), "h long, k long, tie long, pos int")
    counts = stage(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "repeat-grams")
    shared = found.join(counts, "h").groupBy("k", "tie").agg(
        F.collect_set(F.when(F.col("n") <= heavy, F.col("pos"))).alias("at"), F.collect_set(F.when(F.col("n") > heavy, F.col("pos"))).alias("heavy_at"))
    shared = stage(shared.join(firsts, ["k", "tie"], "left_semi"), "repeat-anchors")
    splitters = _splitters(full, parts, length, gram, sample)

    def surroundings(at: str, cuts: list[bytes]) -> DataFrame:
        own = shared.filter(F.size(at) > 0).select("k", "tie", F.sort_array(at).alias("at"))
        return rows.select("k", "tie", "t").join(own, ["k", "tie"]).select("k", "tie", "at", "t").mapInArrow(
            lambda b: _contexts(rows_by_size(b, "t"), cuts, length, gram), _ROW)

    dealt = surroundings("at", splitters).repartitionById(len(splitters) + 1, F.col("bucket")).sortWithinPartitions("after", "before")
    spans = dealt.mapInArrow(lambda b: _intervals(b, length, gram), "k long, tie long, lo int, hi int")
    if not counts.filter(F.col("n") > heavy).isEmpty():
        wide = surroundings("heavy_at", [])
        spans = spans.union(wide.filter("lo is not null").select("k", "tie", "lo", "hi")).union(
            _heavy_intervals(wide.filter("lo is null"), length, gram))
    return rows, spans, firsts


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, gram: int = GRAM,
                   heavy: int = HEAVY) -> DataFrame:
    """``key, n_bytes, spans array<struct<start,end>>, kept binary`` of every row: the maximal runs
    of bytes covered by a ``length``-byte string that also begins earlier (in a smaller key, or in
    the same document before), and what is left.

    A null text counts as empty; texts under ``length`` bytes keep everything. Null keys come
    before all others. Rows that repeat a key are ordered by their text's hash; of rows that
    repeat key and text one is kept and the others are repeats of it. ``gram`` must be a power of
    two and below ``length``."""
    rows, spans, firsts = find(docs, key, text, length, gram, heavy)
    merged = spans.groupBy("k", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    marked = firsts.withColumn("first", F.lit(True)).join(merged, ["k", "tie"], "left")
    order = Window.partitionBy("k", "tie").orderBy("tie")
    joined = rows.join(marked, ["k", "tie"], "left").withColumn("first", F.col("first") & (F.row_number().over(order) == 1))

    def cut(batches):
        for batch in rows_by_size(batches, "t"):
            out: list[list] = [[], [], []]
            for t, first, runs in zip(*(batch.column(c).to_pylist() for c in ("t", "first", "runs"))):
                data = t.encode()
                if len(data) >= length and not first:
                    merged_runs = [[0, len(data)]]
                else:
                    merged_runs = []
                    for r in sorted((r["lo"], r["hi"]) for r in runs or []):
                        if merged_runs and r[0] <= merged_runs[-1][1]:
                            merged_runs[-1][1] = max(merged_runs[-1][1], r[1])
                        else:
                            merged_runs.append(list(r))
                edges = [0, *(x for run in merged_runs for x in run), len(data)]
                out[0].append(len(data))
                out[1].append([{"start": a, "end": b} for a, b in merged_runs])
                out[2].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(c, kind) for c, kind in zip(out, kinds))], ["k", "n_bytes", "spans", "kept"])
    result = joined.mapInArrow(cut, "k long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return result.select(F.when(F.col("k") != -(1 << 63), F.col("k")).alias(key), "n_bytes", "spans", "kept")
