"""Hard negatives by anchor spanning trees.

Anchors are put into blocks of alike ones, and each block gets a spanning tree of short edges.
Candidates are dealt out by hash; in a block of candidates the root's scores are computed, and
the scores of a child lie around its parent's: an edge of length ``d`` moves the score of a candidate
by no more than ``d`` times the candidate's norm. Only candidates whose interval meets the window
of scores that the child still looks for are scored anew; the others keep the interval, which
bounds the scores of the child's own children.

The search is done twice: for the best of the same label (the positives), then for those of other
labels in the windows that the positives open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import assign_event_index
from ..staging import stage

#: Anchors of a tree; candidates of a cell (dealt out by hash), and of those looked at together.
TREE, CELL, CHUNK = 256, 16384, 4096
#: Trees that meet a cell's candidates in one task.
TREES = 256
#: Edges from the root to the farthest anchor.
DEPTH = 4
#: Below this norm, products of two vectors are whole numbers that doubles hold exactly.
EXACT = float(1 << 26)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of whole numbers, short ones filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) * width == len(values):
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def spanning_tree(vectors: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order (parents first), parent (as a place in that order, -1 for the root) and edge length. Each
    step joins the vector that is nearest to one less than ``depth`` edges from the root."""
    n = len(vectors)
    v = vectors.astype(float)
    squares = (v * v).sum(1)
    root = int(np.argmin(((v - v.mean(0)) ** 2).sum(1)))
    order, parent, edge, level = [root], [-1], [0.0], np.zeros(n, int)
    away = np.full(n, np.inf)
    nearest = np.zeros(n, int)
    open_ = np.ones(n, bool)
    place = np.zeros(n, int)
    last = root
    while len(order) < n:
        open_[last] = False
        if level[last] < depth:
            d = squares + squares[last] - 2 * (v @ v[last])
            closer = d < away
            away[closer], nearest[closer] = d[closer], last
        last = int(np.argmin(np.where(open_, away, np.inf)))
        if not open_[last]:  # every distance is infinite or no number
            last, nearest[last] = int(np.argmax(open_)), root
        place[last] = len(order)
        level[last] = level[nearest[last]] + 1
        parent.append(int(place[nearest[last]]))
        edge.append(float(np.sqrt(((v[last] - v[nearest[last]]) ** 2).sum())))
        order.append(last)
    return np.array(order), np.array(parent), np.array(edge)


def prepared(df: DataFrame, key: str, vector: str, label: Column, scale: float) -> DataFrame:
    """``id, tie, label, q``: rows that take part, equal ones once. ``q`` are whole numbers."""
    rows = df.select(F.col(key).alias("id"), label.alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long"))
    return rows.select("id", "label", whole.alias("q")).distinct().withColumn("tie", F.xxhash64("label", "q"))


def _trees(anchors: DataFrame) -> DataFrame:
    """Anchors with their tree (``block, turn, parent, edge``), neighbours in label and direction together."""
    signs = F.aggregate(F.slice("q", 1, 16), F.lit(0), lambda a, x: a * 2 + (x >= 0).cast("int"))
    placed = assign_event_index(anchors.withColumn("code", signs), [], ["label", "code", "id", "tie"], "negatives-anchors")
    dealt = placed.select(F.floor(F.col("event_idx") / TREE).cast("long").alias("block"), "id", "tie", "label", "q")

    def build(batches):
        for run in _runs(batches, ["block"]):
            rows = pa.Table.from_batches(run).combine_chunks()
            order, parent, edge = spanning_tree(_stacked([_matrix(b.column("q")) for b in run]))
            rows = rows.take(pa.array(order))
            batch = rows.combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(len(order), dtype=np.int32)), pa.array(parent.astype(np.int32)), pa.array(edge)],
                                             [*batch.schema.names, "turn", "parent", "edge"])
    sorted_ = dealt.repartition("block").sortWithinPartitions("block", "id", "tie")
    kind = anchors.schema
    schema = f"block long, id {kind['id'].dataType.simpleString()}, tie long, label {kind['label'].dataType.simpleString()}, q array<long>, turn int, parent int, edge double"
    return stage(sorted_.mapInArrow(build, schema), "negatives-trees")


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of sorted batches, run by run of equal ``by``."""
    here, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows]):
            name = tuple(c[a] for c in columns)
            if held and name != here:
                yield held
                held = []
            here = name
            held.append(batch.slice(a, b - a))
    if held:
        yield held


class Scores:
    """Scores of one tree's anchors against a chunk of candidates, as intervals that are points
    where they were computed."""

    def __init__(self, q: np.ndarray, norms: np.ndarray, anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.q, self.norms, self.anchors, self.parent, self.edge = q, norms, anchors, parent, edge
        self.low = np.full((len(anchors), len(q)), -np.inf)
        self.high = np.full((len(anchors), len(q)), np.inf)
        self.known = np.zeros((len(anchors), len(q)), bool)
        self.rescored = 0

    def levels(self) -> Iterator[np.ndarray]:
        level = np.zeros(len(self.parent), int)
        for i, p in enumerate(self.parent):
            level[i] = level[p] + 1 if p >= 0 else 0
        return (np.flatnonzero(level == k) for k in range(int(level.max()) + 1))

    def climb(self, wanted: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Level by level; ``wanted(rows, low, high)`` says which intervals meet a row's window."""
        for rows in self.levels():
            if self.parent[rows[0]] >= 0:
                up = self.parent[rows]
                slack = self.edge[rows][:, None] * self.norms * (1 + 1e-9) + 1e-3
                low, high = self.low[up] - slack, self.high[up] + slack
                meets = wanted(rows, low, high)
            else:
                low, high = self.low[rows], self.high[rows]
                meets = np.ones(low.shape, bool)
            some, any_ = np.flatnonzero(meets.any(1)), np.flatnonzero(meets.any(0))
            self.low[rows], self.high[rows] = low, high
            if len(some):
                exact = self.anchors[rows[some]] @ (self.q if len(any_) == len(self.q) else self.q[any_]).T
                at = np.ix_(rows[some], any_)
                self.low[at] = self.high[at] = exact
                self.known[at] = True
                self.rescored += exact.size


def _best(scores: np.ndarray, ids: np.ndarray, ties: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties by smaller id."""
    if len(scores) > 4 * n:
        bar = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = np.flatnonzero(scores >= bar)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ties[near], ids[near], -scores[near]))[:n]]


class _Cell:
    """Candidates of a cell, in chunks of equal labels as far as possible."""

    def __init__(self, run: list[pa.RecordBatch]):
        self.ids = np.concatenate([b.column("id").to_numpy() for b in run])
        self.ties = np.concatenate([b.column("tie").to_numpy() for b in run])
        self.labels = np.concatenate([b.column("label").to_numpy() for b in run])
        self.q = _stacked([_matrix(b.column("q")) for b in run])
        order = np.lexsort((self.ids, self.labels))
        self.ids, self.ties, self.labels, self.q = self.ids[order], self.ties[order], self.labels[order], self.q[order]
        floats = self.q.astype(float)
        self.norms = np.sqrt((floats * floats).sum(1))
        self.exact = not len(self.norms) or self.norms.max() < EXACT

    def meet(self, run: list[pa.RecordBatch], part: slice) -> tuple[Scores, np.ndarray]:
        anchors = _stacked([_matrix(b.column("q")) for b in run])
        parent, edge = (np.concatenate([b.column(c).to_numpy() for b in run]) for c in ("parent", "edge"))
        width = max(anchors.shape[1], self.q.shape[1])
        pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        q, anchors = pad(self.q[part]), pad(anchors)
        floats = anchors.astype(float)
        if self.exact and np.sqrt((floats * floats).sum(1)).max() < EXACT:
            q, anchors = q.astype(float), floats
        return Scores(q, self.norms[part], anchors, parent, edge), anchors

    def parts(self) -> Iterator[slice]:
        return (slice(a, min(a + CHUNK, len(self.ids))) for a in range(0, len(self.ids), CHUNK))


def _positives(cell: _Cell, run: list[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """``anchor, anchor_tie, id, tie, score`` of the best of a cell with the anchor's label, itself left out."""
    names = [np.concatenate([b.column(c).to_numpy() for b in run]) for c in ("id", "tie", "label")]
    held: list[list[tuple]] = [[] for _ in names[0]]
    for part in cell.parts():
        ids, ties, labels = cell.ids[part], cell.ties[part], cell.labels[part]
        if not np.isin(labels, names[2]).any():
            continue
        scores, _ = cell.meet(run, part)
        bar = np.array([h[-1][0] if len(h) == n else -np.inf for h in held])
        same = names[2][:, None] == labels
        scores.climb(lambda rows, low, high: same[rows] & (high >= bar[rows][:, None]))
        for i in range(len(held)):
            at = np.flatnonzero(same[i] & scores.known[i] & (scores.low[i] >= bar[i]) & ((ids != names[0][i]) | (ties != names[1][i])))
            if len(at):
                top = at[_best(scores.low[i, at], ids[at], ties[at], n)]
                found = held[i] + list(zip(scores.low[i, top].tolist(), ids[top].tolist(), ties[top].tolist()))
                held[i] = sorted(found, key=lambda r: (-r[0], r[1], r[2]))[:n]
    for anchor, tie, best in zip(names[0].tolist(), names[1].tolist(), held):
        for score, other, other_tie in best:
            yield anchor, tie, other, other_tie, int(score)


def _negatives(cell: _Cell, run: list[pa.RecordBatch], n: int, lowest: int, highest: int) -> Iterator[tuple]:
    """``anchor, anchor_tie, positive, positive_tie, positive_score, id, tie, score``: the best of a cell with another label
    in each window."""
    names = [np.concatenate([b.column(c).to_numpy() for b in run]) for c in ("id", "tie", "label")]
    positives = [x or [] for b in run for x in b.column("positives").to_pylist()]
    # per anchor and positive: the window's ends, rounded to whole scores, and what was found in it
    windows = [[(-(-lowest * p["score"] // 100), highest * p["score"] // 100, p, []) for p in each] for each in positives]
    for part in cell.parts():
        ids, ties, labels = cell.ids[part], cell.ties[part], cell.labels[part]
        scores, _ = cell.meet(run, part)
        from_ = np.array([min((max(lo, f[-1][0] if len(f) == n else lo) for lo, hi, _, f in w if lo <= hi), default=np.inf) for w in windows])
        to = np.array([max((hi for lo, hi, _, _ in w if lo <= hi), default=-np.inf) for w in windows])
        other = names[2][:, None] != labels
        scores.climb(lambda rows, low, high: other[rows] & (high >= from_[rows][:, None]) & (low <= to[rows][:, None]))
        for i, each in enumerate(windows):
            at = np.flatnonzero(other[i] & scores.known[i] & (scores.low[i] >= from_[i]) & (scores.low[i] <= to[i]))
            if not len(at):
                continue
            at = at[np.lexsort((ties[at], ids[at], -scores.low[i, at]))]
            s = scores.low[i, at]
            for k, (lo, hi, p, found) in enumerate(each):
                first = np.searchsorted(-s, -hi)
                top = [j for j in range(first, min(first + n, len(at))) if s[j] >= lo]
                if top:
                    found = found + [(s[j], int(ids[at[j]]), int(ties[at[j]])) for j in top]
                    each[k] = (lo, hi, p, sorted(found, key=lambda r: (-r[0], r[1], r[2]))[:n])
    for anchor, tie, each in zip(names[0].tolist(), names[1].tolist(), windows):
        for _, _, p, found in each:
            for score, other_id, other_tie in found:
                yield anchor, tie, p["id"], p["tie"], p["score"], other_id, other_tie, int(score)


def _search(rows: DataFrame, trees: DataFrame, cells: int, groups: int, find, schema: str) -> DataFrame:
    """``find`` on every tree and every cell of candidates. A task takes a cell and :data:`TREES` trees."""
    columns = ["id", "tie", "label", "q"]
    more = [c for c in ("positives",) if c in trees.columns]
    extra = [F.lit(None).cast(trees.schema[c].dataType).alias(c) for c in more]
    candidates = rows.select(F.pmod("tie", F.lit(cells)).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"),
                             F.lit(-1).cast("long").alias("block"), F.lit(0).alias("turn"), F.lit(-1).alias("parent"), F.lit(0.0).alias("edge"), *columns, *extra)
    anchors = trees.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"),
                           F.floor(F.col("block") / TREES).cast("int").alias("g"), "block", "turn", "parent", "edge", *columns, *more)
    dealt = candidates.union(anchors).repartition("cell", "g").sortWithinPartitions("cell", "g", "block", "turn")
    names = [f.split()[0] for f in schema.split(", ")]

    def work(batches):
        cell = where = None
        for run in _runs(batches, ["cell", "g", "block"]):
            here = tuple(run[0].column(c)[0].as_py() for c in ("cell", "g"))
            if run[0].column("block")[0].as_py() < 0:
                cell, where = _Cell(run), here
            elif where == here:
                found = list(find(cell, run))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names)
    return dealt.mapInArrow(work, schema)


def mine(df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, scale: float = 256.0,
         positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Vectors are scaled and rounded down to whole numbers; a score is their inner product. For
    each row where ``anchor`` (of column ``id``) holds, its positives are the ``positives`` best other rows
    of its label; for each of these the first ``negatives`` rows of other labels are returned whose
    score is ``lowest`` to ``highest`` percent of the positive's. Higher scores come first, ties by smaller
    id. Rows with a null id, label or vector, or a component that is null or not finite, take no part; fully equal
    rows count once; rows of one id that differ are rows of their own. A vector shorter than
    another is filled up with zeros. Labels and ids are whole numbers (``label``: another expression for it). Scores are exact
    below 2^63. An empty table, one without anchors, and one of a single label give no rows;
    other columns are not read."""
    rows = stage(prepared(df, key, vector, F.col("label") if label is None else label, scale), "negatives-rows")
    trees = _trees(rows.filter(anchor))
    n, blocks = rows.count(), trees.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]
    cells, groups = max(1, -(-n // CELL)), max(1, -(-blocks // TREES))
    best = _search(rows, trees, cells, groups, partial(_positives, n=positives), "anchor long, anchor_tie long, id long, tie long, score long")
    order = Window.partitionBy("anchor", "anchor_tie").orderBy(F.desc("score"), "id", "tie")
    best = best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= positives)
    best = best.groupBy("anchor", "anchor_tie").agg(F.collect_list(F.struct("id", "tie", "score")).alias("positives"))
    aimed = stage(trees.join(best, (trees["id"] == best["anchor"]) & (trees["tie"] == best["anchor_tie"]), "left").drop("anchor", "anchor_tie"), "negatives-aims")
    found = _search(rows, aimed, cells, groups, partial(_negatives, n=negatives, lowest=lowest, highest=highest),
                    "anchor long, anchor_tie long, positive long, positive_tie long, positive_score long, id long, tie long, score long")
    order = Window.partitionBy("anchor", "anchor_tie", "positive", "positive_tie").orderBy(F.desc("score"), "id", "tie")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                        "positive_score", F.col("score").alias("negative_score"))
