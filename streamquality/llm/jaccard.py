"""Exact Jaccard join of documents on word n-grams, by a grouped prefix join.

Two sets as alike as asked share one of the first few elements of each, in any common order. The
order used is: elements of a hashed fifth of the universe first, rare before frequent (counted
over all documents), then the others by hash; so only a fifth of all elements is counted and
shuffled, and the result is the same. Elements that one document alone holds only take up places
of its prefix; a document whose prefix they fill is like no other and drops out.

Sets with the same prefix and size become one group. Groups meet in the bucket of each prefix
element; pairs pass by size and by two bounds of the difference of the sets from below: a parity
bitmap (bits in which a group's members differ don't count), and the elements that stand before the
bucket's own, as two sets that link pass in the bucket of their first common element. A bucket gives a spanning forest of
its passing pairs, not the pairs. The components of these forests, expanded to their members, hold
every link, and within them sets are rebuilt from the texts and compared exactly. Large components
are taken apart by size (sets that link differ little in it); what is still large, buckets included,
is split into blocks, and each pair of blocks is one piece of work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .bitmap import passes
from .common import WordHashes, arrow_map, held, rows_by_size
from .graph import components

BUCKET = 512
CELL = 1 << 21
_FIFTH = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_LONG = pa.int64()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word n-grams of a text, A-Z lowered; of a
    shorter text the one of all its words; of a wordless one none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(held("word hashes", WordHashes).__getitem__, words), np.uint64, len(words))
    span = min(width, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - span + 1, span, np.uint64)
        for k in range(span):
            h += w[k:len(w) - span + 1 + k] * (_ODD[k % 8] + np.uint64(2 * (k // 8) + 16 * span))
        h = (h ^ (h >> np.uint64(32))) * _ODD[4]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def identity(h: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes()))))


def parity(h: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``bits`` hashed classes hold an odd number of elements, as 64-bit words."""
    at = (h >> np.uint64(64 - (bits - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def prefix_size(n, percent: int):
    """Elements of which a set as alike as ``percent`` must share one: n - ceil(n * percent) + 1."""
    return n - (percent * n + 99) // 100 + 1


def most_apart(total, percent: int):
    """The largest difference of two sets of ``total`` elements together that still link."""
    return total - 2 * ((percent * total + 99 + percent) // (100 + percent))


def sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``key, tie, n, sid, b0..b3`` of every row."""
    def run(batch):
        rows = [shingles(t, width) for t in batch.column("t").to_pylist()]
        bits = np.array([parity(h, 256) for h in rows], np.uint64).reshape(len(rows), 4).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("k"), batch.column("tie"), pa.array([len(h) for h in rows], _LONG), pa.array(map(identity, rows), _LONG),
             *(pa.array(bits[:, c]) for c in range(4))], ["k", "tie", "n", "sid", "b0", "b1", "b2", "b3"])
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(rows, run, f"k {kind}, tie long, n long, sid long, b0 long, b1 long, b2 long, b3 long", "t")


def elements(docs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """``h, sid, n, counted, later``: each set's elements of the counted fifth, and of the others
    the first by hash where the prefix reaches so far. A set that a task has met before is left
    out there; whatever repeats across tasks is merged later."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for t in batch.column("t").to_pylist():
                h = shingles(t, width)
                if not len(h):
                    continue
                name = identity(h)
                if name in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(name)
                inside = h % np.uint64(_FIFTH) == 0
                own = h[inside]
                more = h[~inside][:max(0, prefix_size(len(h), percent) - len(own))]
                n = len(own) + len(more)
                for c, v in zip(cols, (np.concatenate([own, more]).astype(np.int64), np.full(n, name), np.full(n, len(h)), np.full(n, len(own)),
                                       np.repeat([0, 1], [len(own), len(more)]))):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], ["h", "sid", "n", "counted", "later"])
    return docs.select(F.col(text).alias("t")).mapInArrow(
        lambda batches: run(rows_by_size(batches, "t")), "h long, sid long, n long, counted long, later long")


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """``sid, n, prefix, alone``: the elements of each set's prefix that another set holds as well, and how
    many elements that no other set holds stand before them."""
    held = rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    shared = rows.join(held, "h").select("sid", "n", "counted", F.struct(
        "later", F.when(F.col("later") == 0, F.col("df")).otherwise(0).alias("df"), "h").alias("e"))
    per = shared.groupBy("sid", "n", "counted").agg(F.sort_array(F.collect_set("e")).alias("es"))
    later = F.size(F.filter("es", lambda e: e["later"] == 1))
    places = F.least(_prefix_column(percent), F.col("counted"))
    alone = F.col("counted") - (F.size("es") - later)
    room = places - alone
    take = F.greatest(room, F.lit(0)) + later
    return per.filter(take > 0).select(
        "sid", "n", F.transform(F.slice("es", F.lit(1), take.cast("int")), lambda e: e["h"]).alias("prefix"), alone.alias("alone"))


def _prefix_column(percent: int) -> Column:
    return F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a run of equal ``by`` ends, of sorted rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        last = np.ones(n, bool)
        for c in by:
            v = batch.column(c).to_numpy(zero_copy_only=False)
            last &= v == v[-1]
        cut = n - int(np.argmin(last[::-1])) if not last.all() else 0
        first = held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in by)
        if first:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _bucket_forests(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Edges ``a, b`` of a spanning forest of the passing pairs in each bucket."""
    for batch in _runs(batches, ["h", "i", "j"]):
        h, i, j, gid, n, place = (batch.column(c).to_numpy() for c in ("h", "i", "j", "gid", "n", "place"))
        bits = np.stack([batch.column(f"b{c}").to_numpy() for c in range(4)], 1).astype(np.uint64)
        mask = np.stack([batch.column(f"m{c}").to_numpy() for c in range(4)], 1).astype(np.uint64)
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        ends = np.r_[new[1:], len(h)]
        group = np.repeat(np.arange(len(new)), ends - new)

        def passing(x, y):
            # of a pair's first common element, what stands before it in either set is not in the other
            apart = np.maximum(np.bitwise_count((bits[x] ^ bits[y]) & ~mask[x] & ~mask[y]).sum(-1), place[x] + place[y])
            small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            return (100 * small >= percent * large) & (apart <= most_apart(small + large, percent)) & (gid[x] != gid[y])

        a_out, b_out = [], []
        small = ends - new <= 8
        for d in range(1, 8):  # all pairs of small buckets at once
            x = np.arange(len(h) - d)
            x = x[(group[x] == group[x + d]) & small[group[x]]]
            ok = x[passing(x, x + d)]
            a_out.append(gid[ok])
            b_out.append(gid[ok + d])
        for g in np.flatnonzero(~small):
            rest = np.arange(new[g], ends[g])
            while len(rest):
                front, rest = [rest[0]], rest[1:]
                reached = front.copy()
                while front and len(rest):
                    v = front.pop()
                    ok = passing(np.int64(v), rest)
                    reached += rest[ok].tolist()
                    front += rest[ok].tolist()
                    rest = rest[~ok]
                # a star about the smallest: what one bucket says, others often repeat
                a_out.append(np.full(len(reached) - 1, gid[reached].min()))
                b_out.append(np.sort(gid[reached])[1:])
        a, b = np.concatenate(a_out), np.concatenate(b_out)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _in_blocks(rows: DataFrame, by: str, blocks: Column, name: str) -> DataFrame:
    """``rows`` with ``i, j``: each once for each pair of blocks that its own one is part of."""
    own = F.pmod(F.xxhash64(F.col(name)), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.struct(
        F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j")))
    return rows.withColumn("own", own).withColumn("cell", F.explode(pairs)).withColumns({"i": F.col("cell.i"), "j": F.col("cell.j")}).drop("own", "cell")


def candidates(groups: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` between groups of which some members may link: each bucket's forest."""
    columns = [f"{x}{c}" for x in "bm" for c in range(4)]
    rows = groups.select("gid", "n", "alone", *columns, F.posexplode("prefix").alias("place", "h")).withColumn("place", F.col("alone") + F.col("place"))
    held = groups.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("size")).filter("size > 1")
    rows = rows.join(held, "h").withColumn("blocks", F.ceil(F.col("size") / BUCKET))
    rows = _in_blocks(rows, "h", F.col("blocks"), "gid").select("h", "i", "j", "gid", "n", "place", *columns)
    dealt = rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "gid")
    return dealt.mapInArrow(lambda batches: _bucket_forests(batches, percent), "a long, b long").distinct()


def _links(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Edges ``a, b`` of a spanning forest of the exact links in each cell. From each set, sets
    not reached so far are looked at if size and bitmap allow, and compared element by element."""
    def solve(members: dict[int, np.ndarray]):
        names, arrays = list(members), list(members.values())
        n = np.array([len(h) for h in arrays])
        bits = np.stack([parity(h, 2048) for h in arrays])
        rest = np.arange(len(names))
        out = []
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            reached = front.copy()
            while front and len(rest):
                v = front.pop()
                total = n[v] + n[rest]
                small = np.minimum(n[v], n[rest])
                may = (100 * small >= percent * (total - small)) & (np.bitwise_count(bits[rest] ^ bits[v]).sum(1) <= most_apart(total, percent))
                met = []
                for k in np.flatnonzero(may):
                    both = len(np.intersect1d(arrays[v], arrays[rest[k]], assume_unique=True))
                    if 100 * both >= percent * (total[k] - both):
                        met.append(k)
                reached += rest[met].tolist()
                front += rest[met].tolist()
                rest = np.delete(rest, met)
            first = min(names[k] for k in reached)
            out += [(first, names[k]) for k in reached if names[k] != first]
        return out

    here, members = None, {}
    for batch in batches:
        edges = []
        for *cell, sid, t in zip(*(batch.column(c).to_pylist() for c in ("family", "band", "i", "j", "sid", "t"))):
            if cell != here:
                if len(members) > 1:
                    edges += solve(members)
                here, members = cell, {}
            if sid not in members:
                h = shingles(t, width)
                if identity(h) == sid:
                    members[sid] = h
        if edges:
            yield _edge_batch(edges)
    if len(members) > 1 and (edges := solve(members)):
        yield _edge_batch(edges)


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges)
    return pa.RecordBatch.from_arrays([pa.array(a, _LONG), pa.array(b, _LONG)], ["a", "b"])


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, cell: int | None = None) -> DataFrame:
    """``key, n_shingles, component_id, first, tie`` of every row: rows of one component are joined by
    links, pairs whose sets share at least ``percent`` of their union; its id is its smallest key.
    ``first`` marks the row that stands for its component (rows, if it is repeated); ``tie`` is
    xxhash64 of the text.

    Equal sets are one node, so copies cost nothing but their row, and rows that repeat a key with
    another text keep apart. A null or wordless text has an empty set, links with nothing and is
    its own component. A null key is a row like others; a component of null keys alone has a null
    id. Sets are compared as 64-bit hashes of their n-grams. A task holds two blocks of ``cell`` elements (2^21), 8 bytes
    each; larger ones ship fewer copies of the texts of a large family."""
    cell = cell or CELL
    known = stage(sets(docs, key, text, width), "jaccard-sets")
    nodes = known.filter("n > 0").groupBy("sid").agg(
        F.first("n").alias("n"), F.min(F.struct("k", "tie")).alias("one"), *[F.first(f"b{c}").alias(f"b{c}") for c in range(4)])
    per = stage(prefixes(elements(docs, text, width, percent), percent).join(nodes.drop("n", "one"), "sid"), "jaccard-prefixes")
    groups = per.groupBy("n", "prefix").agg(
        F.min("sid").alias("gid"), F.min("alone").alias("alone"), *[F.bit_or(f"b{c}").alias(f"b{c}") for c in range(4)],
        *[F.bit_or(f"b{c}").bitwiseXOR(F.bit_and(f"b{c}")).alias(f"m{c}") for c in range(4)])
    groups = stage(groups, "jaccard-groups")
    members = stage(per.select("sid", "n", "prefix").join(groups.select("n", "prefix", "gid"), ["n", "prefix"]).select("sid", "n", "gid"), "jaccard-members")
    families = components(candidates(groups, percent))
    members = members.join(families.withColumnRenamed("node", "gid"), "gid", "left").select(
        "sid", "n", F.coalesce("root", "gid").alias("family"))
    sizes = members.groupBy("family").agg(F.sum("n").alias("all"), F.count("*").alias("m")).filter("m > 1")
    # sets that link are of the same or neighbouring size classes: a large family is looked at two classes at a time
    step = math.log(100 / percent) * (1 + 1e-6) if percent < 100 else 1e-9
    own = F.floor(F.log("n") / F.lit(step))
    work = members.join(sizes, "family").select("family", "sid", "n", F.explode(
        F.when(F.col("all") > cell, F.array(own - 1, own)).otherwise(F.array(F.lit(0).cast("long")))).alias("band"))
    bands = work.groupBy("family", "band").agg(F.sum("n").alias("all"), F.count("*").alias("m")).filter("m > 1")
    work = work.join(bands, ["family", "band"]).withColumn("blocks", F.ceil(F.col("all") / cell))
    work = _in_blocks(work, "family", F.col("blocks"), "sid").select("family", "band", "i", "j", "sid")
    work = work.join(nodes.select("sid", "one.*"), "sid").select("family", "band", "i", "j", "sid", F.col("k").alias("k2"), F.col("tie").alias("tie2"))
    work = stage(work, "jaccard-work")
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    may = passes(docs, work.select(F.xxhash64("k2", "tie2").alias("h")))
    texts = texts.filter(may(F.xxhash64("k", F.xxhash64("t"))))
    # both sides grow with the corpus, so neither is broadcast at any size
    cells = texts.join(work.hint("merge"), F.col("k").eqNullSafe(F.col("k2")) & (F.xxhash64("t") == F.col("tie2")))
    place = ["family", "band", "i", "j"]
    cells = cells.select(*place, "sid", "t").repartition(*place).sortWithinPartitions(*place)
    links = components(cells.mapInArrow(lambda batches: _links(batches, width, percent), "a long, b long"))
    rows = known.join(links.withColumnRenamed("node", "sid"), "sid", "left").select(
        "k", "tie", "n", F.coalesce("root", "sid").alias("root"))
    # of equal smallest keys and of null ones alone, the smaller tie stands first
    least = rows.filter("n > 0").groupBy("root").agg(F.min("k").alias("component"), F.min(F.struct(F.col("k").isNull(), "k", "tie")).alias("one"))
    linked, own = F.col("n") > 0, F.struct(F.col("k").isNull(), "k", "tie")
    return rows.join(least, "root", "left").select(
        F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(linked, F.col("component")).otherwise(F.col("k")).alias("component_id"),
        (~linked | own.eqNullSafe(F.col("one"))).alias("first"), "tie")


def distinct(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, cell: int | None = None) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component of :func:`join` the row of
    the smallest key, once. Rows without words stay."""
    found = join(docs, key, text, width, percent, cell).select(
        F.col(key).alias("_key"), F.col("tie").alias("_tie"), F.col("n_shingles").alias("_n"), "first")
    # rows of which some go: those that don't stand first, and repeated ones; the others stay where they are
    some = stage(found.filter("_n > 0").groupBy("_key", "_tie").agg(F.count("*").alias("_rows"), F.bool_or("first").alias("_first"))
                 .filter("not _first or _rows > 1"), "jaccard-dropped")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.col(key).alias("_k"), F.xxhash64(F.col(text)).alias("_t"))
    may = passes(docs, some.select(F.xxhash64("_key", "_tie").alias("h")))(F.xxhash64("_k", "_t"))
    met = rows.filter(may).join(some.hint("merge"), F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_tie")), "left")
    copy = F.row_number().over(Window.partitionBy("_k", "_t").orderBy("_t"))
    kept = met.withColumn("_copy", copy).filter("_first is null or (_first and _copy = 1)")
    return rows.filter(~may).select("_row.*").unionByName(kept.select("_row.*"))
