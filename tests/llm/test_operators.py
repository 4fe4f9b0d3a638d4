"""The operators of the llm folder against plain formulas, on small tables with every odd case."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streamquality.llm import (bpe, credentials, extract, fingerprints, graph, jaccard, licenses, mixing, packed, pieces, quality,
                               substrings, vocab)

PATTERN = public_tokenizers.PATTERN
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, k string, tie string, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(11)
VOCABULARY = ["".join(rng.choice(["th", "er", "on", "ä", "né", "str", "a", "i"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text: str, changes: int) -> str:
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


BASE = [prose(120) for _ in range(6)]
PASSAGE = prose(60)
ODD = ["", " ", None, "one", "a b", "x y z", "Tab\tand\nline\r\n  two  spaces ", "日本語 🙂🙂 é ß", "\x00\x01", "a" * 400, "ab " * 200]


@pytest.fixture(scope="module")
def corpus():
    """Texts by row: copies, near copies with all degrees of change, shared passages, odd texts."""
    texts = [*ODD, *BASE, *BASE[:3], *[edited(t, c) for t in BASE for c in range(1, 12)], *[prose(40) + " " + PASSAGE + " " + prose(30) for _ in range(8)],
             prose(4000)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0, "ids", "k", "tie", "size") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (12, BASE[4], "en", "s1", 0, "", "", "", ""), (None, BASE[5], "en", None, 0, "", "", "", ""),
             (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


# 1: byte-level BPE ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def merges():
    return bpe.compile_merges(RANKS, PATTERN)


def test_transducer_is_the_merges(merges):
    ranks = bpe.read_ranks(RANKS)
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    small = bpe.Transducer(merges, limit=300, held=150)  # tables start anew again and again
    tokens = list(ranks)
    for _ in range(3000):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 8))) if rng.random() < 0.6 else bytes(
            rng.choice(b"aabcth er") for _ in range(rng.randint(1, 400)))
        assert small.encode(piece) == reference._core_bpe.encode_single_piece(piece)


def test_bpe_rows(docs, empty, corpus, merges):
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = bpe.round_trip(docs, merges).collect()
    same([(r.doc_id, r.ids, r.text) for r in got], [(r[0], reference.encode_ordinary(r[1] or ""), r[1] or "") for r in corpus])
    decoded = bpe.decode(bpe.encode(docs, merges), merges).collect()
    same([(r.doc_id, r.text) for r in decoded], [(r[0], r[1] or "") for r in corpus])
    assert bpe.round_trip(empty, merges).count() == 0


def test_utf8_machine_on_any_cut():
    for data in ("aé日🙂".encode(), b"\xff\xc3(\xe2\x82x\xf0\x9f", bytes(range(256))):
        for cut in range(len(data) + 1):
            m = bpe.Utf8Machine()
            assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.end() == data.decode(errors="replace")


def test_segments_join_again():
    text = " ".join(prose(50) for _ in range(200)) + "x" * 5000
    parts = list(pieces.segments(text, 100))
    assert "".join(parts) == text and max(map(len, parts[:-1])) < 200


# 2: main text -----------------------------------------------------------------------------------

def test_main_text(spark):
    inner = "<h1>Title&amp;more</h1><p><b>First, long  enough\n sentence of the article.<br><p>Second one; it has <a href=x>a link</a> in it.</p>"
    page = ("<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>var t='</p>';</script></head><body>"
            "<nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- ad --><div class=ad>Buy this, now, cheap.</div>"
            "<div id='cookie-notice'>We use cookies.</div><%s>" + inner + "<form><input>Name</form></%s>"
            "<aside>Side, text.</aside><div class='comments'><p>Nice article, really.</p></div><footer>&copy; me</footer></body></html>")
    want = "Title&more\nFirst, long enough sentence of the article.\nSecond one; it has a link in it."
    for tag in ("article", "main"):
        assert extract.main_text(page % (tag, tag)) == want
    rows = [(1, page % ("article", "article"), "x"), (2, None, "x"), (3, "", "x"), (4, "<p", "x"), (5, "plain &lt;text&gt;", "x"), (1, "<article><p>cut o", "x")]
    got = extract.extract(spark.createDataFrame(rows, "page_id int, html string, text string")).collect()
    same([(r.page_id, r.text) for r in got], [(1, want), (2, ""), (3, ""), (4, ""), (5, "plain <text>"), (1, "cut o")])


LONG = "<p>" + " ".join(f"The {w} paragraph goes on, and on, for quite a while." for w in ("first second third fourth fifth sixth " * 8).split()) + "</p>"
DEEP = ["<table><tbody><tr><td>Cell</td></tr></tbody></table>", "<table><tr><td>Cell</td></tr></table>", "<ul><li>Outer<ul><li>Cell</li></ul></li></ul>",
        "<section><blockquote><ul><li>Cell</li></ul></blockquote></section>", "<section id=two><div><ol><li>Outer<ul><li>Cell</li></ul></li></ol></div></section>",
        "<div>" * 20 + "Cell" + "</div>" * 20]


@pytest.mark.parametrize("inner", DEEP)
@pytest.mark.parametrize("page", ["<html><body><article>%s</article></body></html>", "<html><body><div class=page><div class=text>%s</div></div></body></html>",
                                  "<body><main><section id=one>%s</section></main></body>"])
def test_deep_parts_of_the_article(page, inner):
    assert extract.main_text(page % (LONG + inner)).split("\n")[-1] == "Cell"


def test_deep_text_outside_the_article():
    side = "<div class=a><div class=b><div class=c><div class=d>Aloof</div></div></div></div>"
    for tag in ("article", "div"):
        assert "Aloof" not in extract.main_text(f"<body><{tag} class=text>{LONG}</{tag}>{side}</body>")


@pytest.mark.parametrize("wrapper", ["form action=x", "div class='page has-sidebar'", "div class=no-comments", "div class=layout-form", "div id=search-page"])
@pytest.mark.parametrize("inner", ["%s", "<h1>Title</h1>%s", "<article>%s</article>", "<div class=text>%s</div>"])
def test_marked_wrapper_of_the_page(wrapper, inner):
    nav = "<nav><a href=/>Home</a> Menu of the site, for all.</nav>"
    thread = "<div class=comments><p>Nice article, really.</p></div><footer>All rights, reserved.</footer>"
    text = extract.main_text(f"<html><body><{wrapper}>{nav}{inner % LONG}{thread}</{wrapper.split()[0]}></body></html>")
    assert text.split("\n")[-1].startswith("The first paragraph") and len(text) > 2000
    assert not any(w in text for w in ("Menu", "Nice", "rights"))


def test_long_thread_stays_out():
    assert "Nice" not in extract.main_text(f"<body><article><h1>T</h1>{LONG}</article><div class=comments>{LONG * 2}<p>Nice, really.</p></div></body>")
    assert "Nice" not in extract.main_text(f"<body><div class='page has-sidebar'><h1>T</h1>{LONG}<div class=comments>{LONG * 2}<p>Nice, really.</p></div></div></body>")


@pytest.mark.parametrize("inner, want", [
    ("<section id=discussion><h2>Discussion</h2><p>Word.</p></section>", "Discussion\nWord."),
    ("<section id=discussion><p>Word.</p></section>", "Word."),
    ("<section class=discussion><h2>Discussion</h2><p>Word.</p></section>", "Discussion\nWord."),
    ("<div id=related-work><h2>Earlier work</h2><p>Word.</p></div>", "Earlier work\nWord."),
    ("<h2 id=related-work>Related work</h2><p>Word.</p>", "Related work\nWord."),
    ("<h2 id=search>Search</h2><p>Word.</p>", "Search\nWord."),
    ("<figure><img src=x><figcaption>What it shows.</figcaption></figure>", "What it shows."),
    ("<h2>References</h2><ol><li><a href=x>Doe, J. (2001). On words.</a></li></ol>", "References\nDoe, J. (2001). On words."),
    ("<ul><li><a href=x>More on this</a></li></ul>", ""),
    ("<section id=comments><h2>Comments</h2><p>Nice.</p></section>", ""),
    ("<div class=share><h3>Share</h3><p>Tell others.</p></div>", ""),
    ("<section class=related><h2>Related</h2><ul><li><a href=x>Another one of our stories</a></li></ul></section>", ""),
])
def test_marked_parts_of_the_article(inner, want):
    got = extract.main_text(f"<html><body><article><h1>Title</h1>{LONG}{inner}</article></body></html>").split("\n")
    assert got[0] == "Title" and "\n".join(got[2:]) == want


@pytest.mark.parametrize("raw", [
    "<svg class='icon'/>", "<svg/>", "<svg class=icon>", "<svg><title>A</title><svg><path d='M0'/></svg><text>Drawn.</text></svg>", "<svg><svg/><text>Drawn.</text></svg>",
    "<svg><!-- </svg> --><text>Drawn.</text></svg>", "<noscript>", "<template>", "<template><template>a</template>Drawn.</template>", "<SVG viewBox='0 > 1'>Drawn.</SVG>"])
@pytest.mark.parametrize("after", ["", "<p>Then, <svg>Drawn.</svg>the rest.</p>"])
def test_icons_and_open_raw_tags(raw, after):
    got = extract.main_text(f"<body><article><h1>Title</h1>{raw}{LONG}{after}</article></body>").split("\n")
    assert got[0] == "Title" and got[1].startswith("The first") and len(got[1]) > 2000
    assert got[2:] == (["Then, the rest."] if after else [])


# 3: Jaccard join --------------------------------------------------------------------------------

def plain_components(corpus, width, percent):
    def of(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    sets = [of(r[1]) for r in corpus]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(corpus):
        least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min((k for k in least[find(i)] if k is not None), default=None)) for i, r in enumerate(corpus)]


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard(docs, corpus, width, percent):
    got = jaccard.join(docs, width=width, percent=percent).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], plain_components(corpus, width, percent))


def test_jaccard_in_blocks(docs, corpus, empty, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 5)
    monkeypatch.setattr(jaccard, "CELL", 600)
    got = jaccard.join(docs, width=4, percent=85).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], plain_components(corpus, 4, 85))
    assert jaccard.join(empty).count() == 0


def test_jaccard_of_long_texts_that_share_a_passage(spark, monkeypatch):
    rng = random.Random(5)
    def words(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, texts = words(420), []
    for i in range(30):
        texts.append(passage + words(1200) if i % 3 else words(1600))
    for i, at in ((0, 700), (1, 900), (2, 1500)):  # near copies, a little under and over the threshold
        texts += [texts[i][:at] + words(k) + texts[i][at + k:] for k in (40, 100, 160, 175, 230)]
    corpus = list(enumerate(map(" ".join, texts)))
    made = []
    real = jaccard.candidates
    monkeypatch.setattr(jaccard, "candidates", lambda *a: made.append(real(*a)) or made[-1])
    got = jaccard.join(spark.createDataFrame(corpus, "doc_id long, text string"), width=5, percent=80).collect()
    want = plain_components(corpus, 5, 80)
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], want)
    assert len({c for *_, c in want}) < len(corpus)
    family = lambda i: i if i < 30 else (i - 30) // 5
    order = {jaccard.identity(jaccard.shingles(t, 5)): i for i, t in corpus}
    edges = [(order[a], order[b]) for a, b in made[0].collect()]
    assert edges and all(family(a) == family(b) for a, b in edges)  # a passage alone brings no two texts together


def test_distinct(docs, corpus):
    kept = jaccard.distinct(docs, width=4, percent=85)
    assert kept.columns == docs.columns
    want = plain_components(corpus, 4, 85)
    ids = [r.doc_id for r in kept.filter((F.length(F.trim("text")) > 2) & F.expr("doc_id is distinct from 12")).collect()]
    assert len(ids) == len(set(ids)) and set(ids) - {None} <= {c for _, n, c in want if n}
    assert {c for _, n, c in want if n} <= {r.doc_id for r in kept.collect()}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = dict(graph.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 4: token files ---------------------------------------------------------------------------------

@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_packing(bits):
    ids = np.array([rng.randrange(1 << bits) for _ in range(1001)], np.uint32)
    data = packed.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (packed.unpack(data, bits, 1001) == ids).all()
    with pytest.raises(ValueError):
        packed.pack(np.array([1 << bits if bits < 32 else 1 << 40], np.uint64), bits)


def test_token_files(spark, docs, corpus, tmp_path):
    from pyarrow.fs import LocalFileSystem
    path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = vocab.read_vocabulary(path, PATTERN)
    reference = Tokenizer.from_file(path)
    reference.encode_special_tokens = True
    for size in (vocabulary.size, 1 << 17):
        out = str(tmp_path / str(size))
        ordered = docs.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id", "text")
        packed.write_tokens(vocab.encode(ordered, vocabulary, end=2), out, size, block=7)
        got = packed.read_tokens(spark, out).collect()
        start = 0
        for r, (k, t, *_) in zip(sorted(got, key=lambda r: r.start), sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))):
            assert (r.doc_id, r.start, r.ids) == (k, start, reference.encode(t or "", add_special_tokens=False).ids + [2])
            start += len(r.ids)
        assert len(got) == len(corpus)
        name = next(p for p in (tmp_path / str(size)).iterdir() if p.suffix == ".tok")
        file = packed.TokenFile(LocalFileSystem(), str(name))
        whole = file.ids(0, file.n)
        assert all((file.ids(a, b) == whole[a:b]).all() for a, b in ((3, 4), (5, 29), (0, 7), (13, file.n)))


@pytest.mark.parametrize("more", [[], [dict(content="<|end", single_word=False, lstrip=False)], [dict(content="<|word|>", single_word=True, lstrip=True)]])
def test_added_tokens_in_texts(spark, tmp_path, more):
    file = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    end = file["added_tokens"][0]["content"]
    file["added_tokens"] += [dict(file["added_tokens"][0], id=50257 + i, **a) for i, a in enumerate(more)]
    path = str(tmp_path / "vocabulary.json")
    Path(path).write_text(json.dumps(file))
    reference = Tokenizer.from_file(path)  # as it comes: it takes added tokens out of the text
    texts = [f"a {end} b", end, end * 3, f"  {end}\n\n x{end}y ", f"<|end {end[:-1]} {end}", "a <|word|> b<|word|>c", *ODD, *BASE, f"{BASE[0]} {end}{BASE[1]}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    vocabulary = vocab.read_vocabulary(path, PATTERN)
    got = {r.doc_id: r.ids for r in vocab.encode(rows, vocabulary, end=2).collect()}
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    if not more:
        assert got[0] == [64, 220, 50256, 275, 2]


# 5: repeated substrings -------------------------------------------------------------------------

def plain_repeats(corpus, length):
    lowest = -(1 << 63)
    order = sorted(corpus, key=lambda r: lowest if r[0] is None else r[0])
    seen, out = set(), []
    for k, t, *_ in order:
        data = (t or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = data[i:i + length]
            if piece in seen:
                covered[i:i + length] = b"\1" * length
            seen.add(piece)
        runs = [[m.start(), m.end()] for m in re.finditer(b"\1+", bytes(covered))]
        out.append((k, len(data), runs, bytes(b for b, c in zip(data, covered) if not c)))
    return out


@pytest.mark.parametrize("length, gram, heavy", [(100, 32, 200_000), (100, 32, 3), (40, 16, 200_000)])
def test_repeats(docs, corpus, length, gram, heavy):
    one_each = [r for r in corpus if r[0] != 12 or r[1] == corpus[12][1]]  # rows of one key are ordered by hash: not known here
    rows = docs.filter("doc_id is null or doc_id <> 12 or text = '%s'" % corpus[12][1])
    got = substrings.remove_repeats(rows, length=length, gram=gram, heavy=heavy).collect()
    same([(r.doc_id, r.n_bytes, [[s.start, s.end] for s in r.spans], bytes(r.kept)) for r in got], plain_repeats(one_each, length))


def test_repeats_of_odd_tables(empty, docs):
    assert substrings.remove_repeats(empty).count() == 0
    assert substrings.remove_repeats(docs.filter("length(text) < 20")).filter("size(spans) > 0").count() == 0


def test_multikey_order():
    rows = np.array([[rng.choice(b"ab") for _ in range(30)] for _ in range(3000)], np.uint8)
    got = [bytes(r) for r in rows[substrings.multikey_order(rows)]]
    assert got == sorted(map(bytes, rows))


def test_anchors_of_long_texts(monkeypatch):
    data = "".join(prose(3000)).encode()
    whole = substrings.anchors(data, 100)
    monkeypatch.setattr(substrings, "_PLACE", 10)
    assert (substrings.anchors(data, 100)[0] == whole[0]).mean() == 1


# 6: source mix ----------------------------------------------------------------------------------

def test_targets():
    assert mixing.targets([10, 10, 10], [3, 1, 2], 45, 2) == [20, pytest.approx(25 / 3), pytest.approx(50 / 3)]
    assert mixing.targets([0, 0], [1, 1], 0, 2) == [0, 0]
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 9)) == list(range(n))


def test_mix(docs, corpus, empty):
    def run():
        items, slots = mixing.mix(docs, block=8, shard_slots=50)
        return items.collect(), slots.collect()
    items, slots = run()
    sizes = Counter()
    for r in corpus:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    same([(i.doc_id, i.size, i.source, i.source_size) for i in items], [(r[0], len(WORD.findall(r[1] or "")), r[3], sizes[r[3]]) for r in corpus])
    taken, by_source = Counter(), Counter()
    names = {i.no: i.source for i in items}
    for s in slots:
        taken[s.no, s.offset] += s.to_word - s.from_word
        by_source[names[s.no]] += s.to_word - s.from_word
    assert all(taken[i.no, i.offset] <= 2 * i.size for i in items if i.size)
    aims = {i.source: i.target for i in items}
    assert sum(aims.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(by_source[s] - aims[s]) <= 16 for s in aims)
    same(slots, run()[1])
    assert [d.count() for d in mixing.mix(empty)] == [0, 0]


def test_slots_are_neither_broadcast_nor_made_in_one_task(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 40)
    slots = mixing.mix(docs, block=8, shard_slots=50)[1]
    n = slots.count()
    rows = slots.select("*")
    assert len(rows.collect()) == n
    joins = re.findall(r"\w+Join \[[^\]]*block[^\]]*\]", rows._jdf.queryExecution().executedPlan().toString())
    assert joins and all(j.startswith("SortMergeJoin") for j in joins)
    plan = [{"no": i, "source": f"s{i}", "source_size": 800, "target": 0.0, "blocks": 100, "draws": 150} for i in range(2)]
    drawn = mixing.draw_slots(spark, plan, 7, 50)
    assert drawn.rdd.getNumPartitions() == 8  # 300 slots
    assert sorted(map(tuple, drawn.filter("no = 1 AND copy = 0").select("block").collect())) == [(i,) for i in range(100)]
    assert drawn.select("no", "copy", "block").distinct().count() == drawn.count() == 300


def test_mixed_texts(docs, corpus):
    rows = mixing.mixed_texts(docs, block=8).collect()
    items, slots = mixing.mix(docs, block=8)
    assert sum(len(WORD.findall(r.text)) for r in rows) == slots.agg(F.sum(F.col("to_word") - F.col("from_word"))).first()[0]
    texts = {r[0]: Counter(WORD.findall(r[1] or "")) for r in corpus if r[0] != 12}
    for r in rows:
        if r.doc_id in texts and r.doc_id is not None:
            assert all(n <= 2 * texts[r.doc_id][w] for w, n in Counter(WORD.findall(r.text)).items())


# 7: fingerprints --------------------------------------------------------------------------------

def test_fingerprints(spark, docs, corpus, empty):
    single = [r for r in corpus if r[0] is not None and r[0] != 12]
    rows = spark.createDataFrame(single, SCHEMA).repartition(5)
    got = {r.doc_id: r for r in fingerprints.compare_edited(rows).collect()}
    order = sorted(single, key=lambda r: -r[0])
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(rows).collect()}
    for i, (k, t, *_) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        r = got[k]
        assert (r.n_chars, r.edited, r.fingerprint) == (len(t), t[:len(t) - cut] + after[:cut], prints[k])
        assert r.edited_fingerprint == fingerprints.text_of(fingerprints.Phrases().feed(r.edited.encode()).fingerprint(128))
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
    assert np.mean([got[r[0]].near_edited - got[r[0]].near_next for r in order if r[1] in BASE]) > 0.1
    assert fingerprints.compare_edited(docs).count() == len(corpus)
    assert fingerprints.compare_edited(empty).count() == 0


# 8: quality rules -------------------------------------------------------------------------------

def test_quality(spark, docs, corpus, empty):
    trusted = spark.createDataFrame([(i,) for i in range(11, 40)] + [(None,), (11,)], "doc_id long")
    got = quality.rules(docs, trusted, buckets=500).collect()
    want = []
    for k, t, *_ in corpus:
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        inside = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((k, len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(inside),
                     len(w) < 50 or 100 * len(inside) > 50 * len(w)))
    same([tuple(r)[:7] for r in got], want)
    assert not any(r.kept and (r.base_failed or r.score < quality.THRESHOLD) for r in got)
    assert quality.rules(empty, trusted).count() == 0
    assert all(abs(r.score) < 1e-9 for r in quality.rules(docs, trusted.limit(0)).collect())


def test_quality_score(spark):
    good = [(i, " ".join(rng.choice("red green blue black white".split()) for _ in range(80)), 1) for i in range(40)]
    bad = [(100 + i, " ".join(rng.choice("zz$$ yy%% xx## ww&& vv!!".split()) for _ in range(80)), 0) for i in range(10)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, q int")
    got = {r.doc_id: r for r in quality.rules(docs, docs.filter("doc_id < 20").select("doc_id"), buckets=200).collect()}
    assert all(got[i].score > quality.THRESHOLD > -0.5 > got[j].score for i in range(40) for j in range(100, 110))
    kept = quality.filtered(docs, docs.filter("doc_id < 20").select("doc_id"), buckets=200)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}


# 9: licences ------------------------------------------------------------------------------------

def test_licenses(spark, docs, corpus, empty):
    texts = ["Released under the MIT License.", "x CC BY-NC 4.0, cc by nc", "This work is licensed under the GNU General Public License, version 3.",
             "apache License, VERSION 2 under the mit license", "the general public has a license", "under the\nmit license" * 2, None, "İcc by nc K"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for frame, given in ((rows, list(enumerate(texts))), (docs, corpus)):
        want = []
        for k, t, *_ in given:
            low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            at = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
            starts = [i for i, _ in at]
            want.append((k, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
        same([tuple(r)[:6] for r in licenses.scan(frame).collect()], want)
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert got[2].labels == "gpl-3" and got[2].score == 1 and got[4].labels == "" and got[4].score == 0
    assert got[3].labels == "apache-2,mit"
    assert licenses.scan(empty).count() == 0


def test_licence_by_its_key_phrase_in_any_corpus(spark):
    text = "code under the gnu general public license version 3 of 2007"
    rows = spark.createDataFrame([(0, text), (1, text)], "doc_id int, text string")
    for r in licenses.scan(rows).collect():  # the four words it lacks are the rarest here
        assert r.labels == "gpl-3" and r.score == pytest.approx(8 / 12) and r.n_base == 0


# 10: secrets ------------------------------------------------------------------------------------

def test_secrets(spark, docs, corpus, empty):
    key, mixed, hexes = "AKIA" + "Q7" * 8, "aB3dE5gH7jK9mN1pQ3sT5", "0123456789abcdef" * 2
    texts = [f"x {key} y", f'API_key = "{hexes}" password: short1', "token=abc", mixed, f"user: someone and {mixed} at https://db.example.com/x",
             f"{mixed}" + " word" * 200 + f" {key}", "see https://example.com for more", f"{key} {mixed} https://a.b/c", None, "AKIASHORT1234567 " + mixed]
    got = {r.doc_id: r for r in credentials.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn(
        "w", credentials.written(F.col("spans"))).collect()}
    kinds = {i: [x.split(":")[0] for x in r.w.split(",") if x] for i, r in got.items()}
    assert kinds == {0: ["access"], 1: ["assign", "hex", "assign"], 2: [], 3: [], 4: ["identifier", "secret", "endpoint"], 5: ["access"], 6: [],
                     7: ["access", "secret", "endpoint"], 8: [], 9: ["identifier", "secret"]}
    assert len(credentials.scan(docs).collect()) == len(corpus) and credentials.scan(empty).count() == 0
    clean = credentials.redact(spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string")).collect()
    assert len(clean) == 20
    by = {r.doc_id: r.text for r in clean}
    assert by[0] == "x [SECRET] y" and by[6] == texts[6] and by[8] is None and key not in by[7]
