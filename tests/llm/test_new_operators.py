"""Merkle manifest, benchmark overlap and hard negatives against plain formulas."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamquality.llm import credentials, decontaminate, extract, jaccard, merkle, mixing, negatives

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, at long, k string, row string, node string"
rng = random.Random(5)


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


# 11: Merkle manifest ----------------------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """Root, and per leaf its steps ``(before, after)``."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 16 * 16:p // 16 * 16 + 16]
            proofs[i].append(("".join(run[:p % 16]), "".join(run[p % 16 + 1:])))
        nodes = [h(*nodes[k:k + 16]) for k in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return nodes[0], proofs


def plain_manifest(rows):
    groups = defaultdict(list)
    for doc, group, leaf in rows:
        groups[(group is not None, (group or "").encode())].append((doc is not None, doc, leaf))
    trees = {g: plain_tree([r[2] for r in sorted(groups[g], key=lambda r: (r[0], r[1] or 0, r[2]))]) for g in groups}
    order = sorted(trees)
    root, upper = plain_tree([trees[g][0] for g in order])
    for g, up in zip(order, upper):
        for (_, doc, leaf), lower in zip(sorted(groups[g], key=lambda r: (r[0], r[1] or 0, r[2])), trees[g][1]):
            yield doc, leaf, trees[g][0], root, lower + up


def manifest_rows(spark, rows, levels):
    df = spark.createDataFrame([(d, g, x, "x") for d, g, x in rows], "doc_id long, source string, leaf string, node string").repartition(3)
    got = merkle.manifest(df, levels=levels).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.node == "x" and r.folded == r.root for r in got)
    return [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got]


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest(spark, levels):
    rows = [(i, g, h(g or "", str(i))) for g, n in (("b", 1), ("a", 16), (None, 17), ("", 2), ("é", 300), ("long", 600)) for i in range(n)]
    rows += [(i, f"s{i}", h(str(i))) for i in range(20)]
    rows += [(7, "a", h("other")), rows[3], rows[3], (None, "a", h("null")), (None, None, h("null")), (-3, "a", h("minus"))]
    same(manifest_rows(spark, rows, levels), list(plain_manifest(rows)))


def test_manifest_many_rounds(spark):
    rows = [(i, "big", h(str(i))) for i in range(4500)] + [(1, "one", h("x"))]
    same(manifest_rows(spark, rows, 1), list(plain_manifest(rows)))


def test_manifest_small(spark):
    assert manifest_rows(spark, [(3, None, h("a"))], 2) == [(3, h("a"), h("a"), h("a"), [])]
    empty = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert merkle.manifest(empty).count() == 0 and merkle.manifest(empty).columns[-3:] == ["subroot", "root", "proof"]


def test_leaf_and_tampering(spark):
    texts = [None, "", "-", "0:", "Ab", "é", "x" * 100_000]
    rows = [(i, t, None if i % 2 else "en", "s", 5, "leaf", i, "k", "row", "node") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = df.select("doc_id", merkle.leaf(F.col("doc_id"), F.col("text"), F.col("lang")).alias("h")).collect()
    assert {r.doc_id: r.h for r in got} == {r[0]: h(*map(plain_field, (r[0], r[1], r[2]))) for r in rows}
    assert len({r.h for r in got}) == len(texts)
    clash = merkle.manifest(df.withColumn("leaf", merkle.leaf(F.col("text"))).withColumnRenamed("at", "piece"))
    assert clash.count() == len(texts)
    wrong = merkle.leaf(F.lit("tampered"))
    assert clash.withColumn("v", merkle.fold(wrong, F.col("proof")) == F.col("root")).filter("v").count() == 0


# 12: benchmark overlap --------------------------------------------------------------------------

def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_overlap(docs, items, size):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for p in range(len(w) - n + 1) if n else ():
            windows[tuple(w[p:p + n])].add(item)
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                owners = windows.get(tuple(w[p:p + n]))
                if owners:
                    hit |= set(range(p, p + n))
                    found |= owners
        yield doc, len(w), sorted(hit), sorted(x for x in found if x is not None)


VOCABULARY = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 5))) for _ in range(60)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


ITEMS = [prose(n) for n in (30, 12, 10, 9, 3, 25)]


def overlap_rows(spark, docs, items, **settings):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, token string, at string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(d, b, **settings).collect()
    return [(r.doc_id, r.n_words, [w for s in r.spans for w in range(s.start, s.stop)], list(r.items)) for r in got]


@pytest.mark.parametrize("size,width", [(10, 4), (10, 1), (5, 5), (3, 4)])
def test_overlap(spark, size, width):
    docs = [(i, prose(rng.randint(0, 30)) + rng.choice([" ", ", ", "\n"]) + (lambda x: x.upper() if i % 3 else x)(rng.choice(ITEMS)) + " " + prose(rng.randint(0, 20)))
            for i in range(60)]
    docs += [(100 + i, prose(80)) for i in range(20)] + [(200, None), (201, ""), (202, " .,!"), (203, ITEMS[0]), (203, ITEMS[0]), (None, ITEMS[1]),
                                                         (204, " ".join(ITEMS[1].split()[:9])), (205, ITEMS[2] + " " + ITEMS[2]), (206, "a" * 500), (207, "the " * 50)]
    items = [*enumerate(ITEMS), (0, ITEMS[4]), (9, ITEMS[1]), (None, ITEMS[2]), (10, None), (11, "..."), (12, "the the the the the the the the the the the")]
    same(overlap_rows(spark, docs, items, size=size, width=width), list(plain_overlap(docs, items, size)))


def test_overlap_of_nothing(spark):
    assert overlap_rows(spark, [(1, "a b")], []) == [(1, 2, [], [])]
    assert overlap_rows(spark, [], [(1, "a b")]) == []
    assert overlap_rows(spark, [(1, "one two")], [(1, "two")]) == [(1, 2, [1], [1])]


def test_overlap_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 200)
    text = " ".join([prose(300), ITEMS[0], prose(200), ITEMS[1], prose(100)])
    for size in (4, 10):
        parts = list(decontaminate.stretches(text.encode(), size))
        seen = [base + k for base, lo, hi, _ in parts for k in range(lo, hi)]
        assert seen == list(range(len(words(text)))) and len(parts) > 5
        assert all(b" ".join(w) in b" ".join(x.encode() for x in words(text)) for _, _, _, w in parts)
    assert list(decontaminate.stretches(b"x" * 1000, 10)) == [(0, 0, 1, [b"x" * 1000])]


# 13: hard negatives -----------------------------------------------------------------------------

def plain_negatives(rows, every=5):
    kept = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (key, tuple(math.floor(256 * x) for x in vector), label)
        if row not in kept:
            kept.append(row)
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1]))
    for a in kept:
        if a[0] % every:
            continue
        rank = lambda r: (-score(a, r), r[0])
        for p in sorted((r for r in kept if r != a and r[2] == a[2]), key=rank)[:5]:
            ps = score(a, p)
            fits = sorted((r for r in kept if r[2] != a[2] and 50 * ps <= 100 * score(a, r) <= 95 * ps), key=rank)[:3]
            for k, r in enumerate(fits):
                yield a[0], p[0], k + 1, r[0], ps, score(a, r)


def mined(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, tie string, cell int").repartition(3)
    return [tuple(r) for r in negatives.mine(df, F.col("id") % 5 == 0, **settings).collect()]


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_negatives(spark, spread, monkeypatch):
    g = np.random.default_rng(3)
    centres = g.normal(size=(4, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 4] + spread * g.normal(size=8)], int(i % 4 if g.random() < 0.8 else g.integers(4))) for i in range(300)]
    rows += [(300 + i, rows[5][1], i % 3) for i in range(20)]  # copies: ties at every place
    rows += [rows[5], rows[5], (330, None, 1), (335, rows[1][1], None), (None, rows[1][1], 1), (340, [0.0] * 7 + [float("nan")], 1),
             (345, [1.0] * 7 + [None], 1), (350, [float("inf")] + [0.0] * 7, 2), (355, [0.5, 0.25], 1), (360, [], 2), (365, [0.0] * 8, 3), (370, [-x for x in centres[0]], 0)]
    rows = [(k, v and [x if x is None else float(np.float32(x)) for x in v], label) for k, v, label in rows]
    monkeypatch.setattr(negatives, "TREE", 16)
    monkeypatch.setattr(negatives, "TREES", 2)
    monkeypatch.setattr(negatives, "CELL", 64)
    same(mined(spark, rows), list(plain_negatives(rows)))


def test_large_components(spark):
    rows = [(i, [float(np.float32(3e5 * math.cos(i))), float(np.float32(2e5 * math.sin(i)))], i % 3) for i in range(60)]
    same(mined(spark, rows), list(plain_negatives(rows)))


def test_no_negatives(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(0, [1.0], 1), (5, [1.0], 1)]) == []


def test_bounds_spare_work():
    g = np.random.default_rng(1)
    anchors = np.concatenate([g.normal(size=(1, 16)) * 256 + g.normal(size=(20, 16)) for _ in range(1)]).round()
    order, parent, edge = negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(20)) and parent[0] == -1 and all(p < i for i, p in enumerate(parent))
    q = (g.normal(size=(5000, 16)) * 256).round()
    scores = negatives.Scores(q, np.sqrt((q * q).sum(1)), anchors[order], parent, edge)
    exact = anchors[order] @ q.T
    bar = np.sort(exact, axis=1)[:, -5]
    scores.climb(lambda rows, low, high: high >= bar[rows][:, None])
    assert (scores.low <= exact).all() and (exact <= scores.high).all()
    assert all(scores.known[i][exact[i] >= bar[i]].all() for i in range(20))
    assert scores.rescored < exact.size / 4


# 2: main text of odd markup ---------------------------------------------------------------------

def test_attributes_are_read_as_html_does():
    page = ("<body><article><p title=it's>One, two.</p><p>Three, four.</p><p title=don't>Five.</p><p data-x='a>b' title = \"it's\" x=/y/>Six.</p>"
            "<p data-note=class=ad>Nine.</p><p '>Ten.</p></article><div title='class=x' class=ad>Buy, now.</div></body>")
    assert extract.main_text(page) == "One, two.\nThree, four.\nFive.\nSix.\nNine.\nTen."
    assert extract.main_text("<body><p title=\"never closed>Seven, eight.</p><p>Nine.</p></body>") == "Seven, eight.\nNine."


@pytest.mark.parametrize("tag", ["div", "section class=x", "span", "a href=x", "li"])
def test_time_is_linear_in_nesting(tag):
    page = "<body><article>" + f"<{tag}>Some text, here. " * 5000
    began = time.process_time()
    assert extract.main_text(page)
    assert time.process_time() - began < 3


def test_stages_keep_columns_of_any_name(spark):
    names = "t spans runs row k k2 tie tie2 s s2 copy copy2 _k _runs _copy _row _t no offset `a.b`".split()
    text = " ".join(f"w{i}" for i in range(300)) + " password = hunter2secret"
    rows = [(i, text if i % 2 else None, "s", *range(len(names))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names))
    clean = credentials.redact(df).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in clean] == [r[2:] for r in rows] and all(r.text is None or r.text.endswith("[SECRET]") for r in clean)
    mixed = mixing.mixed_texts(df, block=8).orderBy("doc_id").collect()
    assert {r.doc_id for r in mixed} <= {1, 3, 5} and all(tuple(r)[3:] == tuple(range(len(names))) for r in mixed)
    unique = jaccard.distinct(df).orderBy("doc_id").collect()
    assert [r.doc_id for r in unique] == [0, 1, 2, 4] and all(tuple(r)[3:] == tuple(range(len(names))) for r in unique)
