"""Merkle manifest of a data set, by a butterfly exchange.

Rows become leaves, ordered within their group. Aligned runs of ``fanout ** levels`` leaves are
packed into one row each, a *piece*, which hashes its own subtree. Then pieces exchange: in a
round, the pieces of ``fanout`` neighbouring subtrees send their subtree's root to each other, every
piece to the one at its own place in each of the other subtrees. So a piece gets the roots it
lacks in ``fanout - 1`` short messages, hashes their common parent itself, as all its neighbours do,
and keeps the roots it got as its proof at that height. When the groups' own rounds are over, the
same rounds go on over the groups. Each piece then holds the upper part of its leaves' proofs; no
root is sent back down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import assign_event_index
from ..staging import attach, stage
from .columns import let

FANOUT = 16


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    written = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's values; nulls, empty texts and neighbouring values can't be mistaken for one another."""
    return digest(*map(field, values))


def fold(start: Column, proof: Column) -> Column:
    """The root that ``start`` leads to through a proof of :func:`manifest`."""
    return F.aggregate(proof, start, lambda node, step: digest(step["before"], node, step["after"]))


def _joined(nodes: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(nodes, first + 1, n), "")


def _parents(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(_joined(nodes, i * FANOUT, F.lit(FANOUT)).cast("binary"), 256))


def _step(nodes: Column, at: Column) -> Column:
    """The siblings of node ``at`` among ``nodes``: those before it and those after it in its run."""
    place = F.pmod(at, F.lit(FANOUT))
    return F.struct(_joined(nodes, at - place, place).alias("before"),
                    _joined(nodes, at + 1, F.lit(FANOUT - 1) - place).alias("after"))


def _ladder(nodes: Column, total: Column, levels: int, body) -> Column:
    """``body`` of the node arrays of a piece, from its leaves up; a level that the group doesn't
    have (one node was left) repeats the one below."""
    def climb(l: int, made: list[Column]):
        if l > levels:
            return body(made)
        below = made[-1]
        return let(F.when(total > FANOUT ** (l - 1), _parents(below)).otherwise(below), lambda n: climb(l + 1, [*made, n]))
    return let(nodes, lambda n: climb(1, [n]))


def _pieces(rows: DataFrame, levels: int) -> DataFrame:
    """``group, piece, rows, total, pieces, node``: packed leaves, the leaves and pieces of the
    group, and the root of the piece's own subtree."""
    size = FANOUT ** levels
    packed = rows.groupBy("group", F.floor(F.col("event_idx") / size).cast("long").alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("event_idx", "row", "leaf"))).alias("rows"))
    packed = stage(packed, "merkle-packed")
    totals = packed.groupBy("group").agg(F.sum(F.size("rows")).cast("long").alias("total"))
    packed = attach(packed, totals, ["group"], name="merkle-totals")
    node = _ladder(F.transform("rows", lambda r: F.lower(F.hex(r["leaf"]))), F.col("total"), levels, lambda made: F.get(made[-1], F.lit(0)))
    return stage(packed.withColumns({"pieces": F.ceil(F.col("total") / size).cast("long"), "node": node}), "merkle-pieces")


def _exchange(state: DataFrame, asks: DataFrame, name: str) -> DataFrame:
    """One round. ``asks`` has a row ``no, piece, turn, own, from_no, from_piece`` for each message a piece
    is to get, its own place included; the state moves up to the parent node."""
    sent = state.select(F.col("no").alias("from_no"), F.col("piece").alias("from_piece"), "node")
    got = asks.join(sent, ["from_no", "from_piece"]).groupBy("no", "piece", "own").agg(
        F.sort_array(F.collect_list(F.struct("turn", "node"))).alias("got"))
    side = lambda keep: F.array_join(F.transform(F.filter("got", keep), lambda m: m["node"]), "")
    got = got.select("no", "piece", side(lambda m: m["turn"] < F.col("own")).alias("before"),
                     side(lambda m: m["turn"] > F.col("own")).alias("after"))
    moved = state.join(got, ["no", "piece"], "left")
    step = F.array(F.struct("before", "after"))
    took = F.col("before").isNotNull()
    return stage(moved.select("no", "piece", "pieces", "subroot", F.when(took, digest(F.col("before"), F.col("node"), F.col("after")))
                              .otherwise(F.col("node")).alias("node"),
                              F.when(took, F.concat("proof", step)).otherwise(F.col("proof")).alias("proof")), name)


def _partners(at: Column, n: Column, span: int) -> Column:
    """Array of ``turn, own, partner``: for each subtree of ``span`` in the run of ``at``, the one
    at the same place in it. The last subtree may be short, then places wrap around in it."""
    run = at - F.pmod(at, F.lit(span * FANOUT))
    own = F.floor((at - run) / span).cast("int")
    place = F.pmod(at, F.lit(span))
    turns = F.filter(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda t: run + t * span < n)
    return F.transform(turns, lambda t: F.struct(t.alias("turn"), own.alias("own"), (
        run + t * span + F.pmod(place, F.least(F.lit(span), n - (run + t * span)))).cast("long").alias("partner")))


def _rounds(most: int) -> list[int]:
    spans = []
    while not spans or spans[-1] * FANOUT < most:
        spans.append(spans[-1] * FANOUT if spans else 1)
    return spans if most > 1 else []


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "source", leaf: str = "leaf", levels: int = 2) -> DataFrame:
    """``rows`` with ``position, subroot, root, proof``, one row each.

    Leaves (hex digests in column ``leaf``) ascend by ``key`` within their ``group``; while several nodes
    remain, each run of 16 becomes one. Groups, null first and then by UTF-8 bytes, are joined in
    the same way. ``proof`` is an array of ``before, after``: the siblings' digests to the left and
    right, run by run from the leaf to the root; :func:`fold` follows it. Null keys come first, equal keys
    go by their leaf, and fully repeated rows are leaves of their own. A group of one leaf has it
    as its subroot, a single group's subroot is the root; an empty table gives no rows. Other
    columns are carried along, whatever their names. Keys and groups may be of any ordered type;
    groups are told apart by their text. ``levels`` sets how many leaves a piece packs (16 to that
    power): its row is the largest unit of work."""
    kept = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != leaf])
    source = stage(rows.select(kept.alias("row"), F.col(key).alias("key"), F.unhex(leaf).alias("leaf"),
                               F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("group"),
                               F.monotonically_increasing_id().alias("at")), "merkle-leaves")
    placed = assign_event_index(source, ["group"], ["key", "leaf", "at"], "merkle-ordered")
    pieces = _pieces(placed, levels)
    groups = assign_event_index(pieces.filter("piece = 0").select("group", "pieces"), [], ["group"], "merkle-groups")
    groups = stage(groups.withColumnRenamed("event_idx", "no"), "merkle-groups")
    sizes = groups.agg(F.count("*").alias("n"), F.coalesce(F.max("pieces"), F.lit(0)).alias("most")).first()
    pieces = attach(pieces, groups.select("group", "no"), ["group"], name="merkle-numbers")
    state = stage(pieces.select("no", "piece", "pieces", F.lit(None).cast("string").alias("subroot"), "node",
                                F.array().cast("array<struct<before:string,after:string>>").alias("proof")), "merkle-state")
    for span in _rounds(sizes["most"]):
        asks = state.filter(F.col("pieces") > span).select("no", "piece", F.inline(_partners(F.col("piece"), F.col("pieces"), span)))
        state = _exchange(state, asks.select("no", "piece", "turn", "own", F.col("no").alias("from_no"), F.col("partner").alias("from_piece")), "merkle-round")
    state = state.withColumn("subroot", F.col("node"))
    each = groups.select(F.col("no").alias("from_no"), F.col("pieces").alias("there"))
    for span in _rounds(sizes["n"]):
        asks = state.select("no", "piece", F.inline(_partners(F.col("no"), F.lit(sizes["n"]), span))).withColumnRenamed("partner", "from_no")
        asks = attach(asks, each, ["from_no"], name="merkle-there").withColumn("from_piece", F.pmod("piece", "there"))
        state = _exchange(state, asks, "merkle-round")
    whole = pieces.drop("node", "pieces").join(state, ["no", "piece"])
    total = F.col("total")

    def leaves(made: list[Column]) -> Column:
        def one(r: Column, i: Column) -> Column:
            own = [F.when(total > FANOUT ** l, F.array(_step(made[l], F.floor(i / FANOUT ** l).cast("int")))).otherwise(
                F.array().cast("array<struct<before:string,after:string>>")) for l in range(levels)]
            return F.struct(r["row"].alias("row"), F.lower(F.hex(r["leaf"])).alias("leaf"), r["event_idx"].alias("position"), F.concat(*own).alias("lower"))
        return F.transform("rows", one)
    nodes = F.transform("rows", lambda r: F.lower(F.hex(r["leaf"])))
    flat = whole.select(F.inline(_ladder(nodes, total, levels, leaves)), "subroot", "node", "proof")
    return flat.select("row.*", F.col("leaf").alias(leaf), "position", "subroot", F.col("node").alias("root"),
                       F.concat("lower", "proof").alias("proof"))
