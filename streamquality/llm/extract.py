"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their path of block tags from the root. A path is weighed by
its text and its punctuation per node; both ratios are smoothed with those of the containers they
lie in and fused, so a heading, a short paragraph or a cell of a table stands by the article around
it, however deep it lies. Paths above a share of the best are content. Names of tags and classes
that seldom hold an article take their paths out beforehand, unless the container holds most of the
page or is a section of the article with a title or id of its own; links weigh nothing.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: As HTML reads them: quotes hold a value only after the equals sign, an unquoted value ends at white space or ``>``.
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>]+)"""
_INSIDE = r"((?:[\s/=]|[^\s/>=]++(?:\s*+=\s*+%s?+)?+)*+)" % _VALUE
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)%s(?:>|\Z)" % _INSIDE, re.S)
_NAMED_TAG = r"<!--.*?(?:-->|\Z)|<(/?)%s(?![^\s/>])" + _INSIDE + r"(?:>|\Z)"
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(%s))?" % _VALUE)
_NAMING = frozenset(("class", "id", "role"))
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？«»“”]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
#: Of these, those that hold markup and may be nested or, by mistake, left open.
PAIRED = frozenset("svg template noscript".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
                   "time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that never hold an article, tags that seldom do, and words in class, id or role that say so.
NEVER_TAGS = frozenset("nav button select menu head".split()) | RAW
ASIDE_TAGS = frozenset("header footer aside form dialog".split()) | NEVER_TAGS
_ASIDE_WORDS = re.compile(
    r"(?:^|[^a-z])(nav\w*|menu\w*|header|masthead|footer|side-?bar|aside|ad|ads|adv|advert\w*|banner|promo\w*|sponsor\w*|cookie\w*|consent|"
    r"notice\w*|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|comment\w*|repl(?:y|ies)|respond|disqus|discussion|"
    r"share|sharing|social|related|recommend\w*|breadcrumb\w*|pagination|pager|widget\w*|copyright|legal|skip\w*|toolbar|search\w*|"
    r"form|contentinfo|complementary|navigation|dialog)(?=$|[^a-z])")
#: What readers write below an article, whatever its heading says.
_THREAD = re.compile(r"comment|repl(?:y|ies)|respond|disqus")
#: An open one ends where one of these begins: optional end tags of HTML.
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                      "menu nav ol p pre section table ul".split())
_SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
                "option": {"option"}}

#: Parts of a text: none of them is by itself the container of an article.
_PARTS = frozenset("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre section table tbody td tfoot th thead tr ul".split())


def _tag(name: str) -> str:
    return name.split(".")[0]


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each start tag of the name begins: the place behind the end tag that belongs to it."""
    out, open_at = {}, []
    for m in re.finditer(_NAMED_TAG.replace("%s", tag, 1), page, re.S | re.I):
        if m[1]:
            if open_at:
                out[open_at.pop()] = m.end()
        elif m[2] is not None and not (tag == "svg" and m[2].endswith("/")):
            open_at.append(m.start())
    return out


class Mark(NamedTuple):
    """A container that may be an aside: words of its class and role, and of its id, that say so."""

    tag: str
    by_class: tuple[str, ...]
    by_id: tuple[str, ...]
    inside: bool  # an article or main


class Paths:
    """Tag paths as a tree: a number for each path, behind that of the path it extends. 0 is the empty path."""

    def __init__(self) -> None:
        self.parent, self.tag, self.depth = [-1], [""], [0]
        self._known: dict[tuple[int, str], int] = {}

    def below(self, path: int, name: str) -> int:
        found = self._known.get((path, name))
        if found is None:
            found = self._known[path, name] = len(self.parent)
            self.parent.append(path)
            self.tag.append(_tag(name))
            self.depth.append(self.depth[path] + 1)
        return found


def blocks(page: str) -> tuple[Paths, list[tuple[int, str, bool, int]]]:
    """The page's paths, and ``(path, text, aside, characters in links)`` of each block of text, in page order."""
    paths = Paths()
    stack: list[tuple[str, int, tuple[int, ...]]] = []  # tag, path, marks of it and of what holds it
    out, parts, linked = [], [], [0, 0]  # characters in links, links open
    marks: list[Mark] = []
    openings: list[tuple[int, ...]] = []  # marks around each h1, article and main

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            out.append((stack[-1][1] if stack else 0, text, stack[-1][2] if stack else (), linked[0]))
        linked[0] = 0

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if linked[1]:
                linked[0] += len(text.strip())

    def pop_to(i: int) -> None:
        if any(tag not in INLINE for tag, _, _ in stack[i:]):
            flush()
        linked[1] -= sum(tag == "a" for tag, _, _ in stack[i:])
        del stack[i:]

    at, n = 0, len(page)
    ends: dict[str, dict[int, int]] = {}
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in _CLOSES_P:
                    break
        elif tag in _SELF_ENDING:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _SELF_ENDING[tag]:
                    pop_to(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag in RAW:  # its text is no markup: skip to the end tag
            if tag in PAIRED:
                if tag not in ends:
                    ends[tag] = _ends(page, tag)
                if not (tag == "svg" and m[3].endswith("/")):
                    at = ends[tag].get(m.start(), at)  # without an end tag, go on behind the start tag
                continue
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            if end is None:
                break
            close = page.find(">", end.end())
            at = n if close < 0 else close + 1
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        named = [(name.lower(), v.strip("\"'").lower()) for name, v in _ATTRIBUTE.findall(m[3] or "") if name.lower() in _NAMING]
        words = {True: (), False: ()}
        if tag not in ("html", "body", "main", "article"):
            for name, v in named:
                if name != "id" or tag not in HEADINGS:  # a heading's id repeats its words
                    words[name == "id"] += tuple(w.strip(".:_- ") for w in _ASIDE_WORDS.findall(v))
        held = stack[-1][2] if stack else ()
        if tag in ("h1", "article", "main"):
            openings.append(held)
        if tag in ASIDE_TAGS or words[True] or words[False]:
            held += (len(marks),)
            marks.append(Mark(tag, words[False], words[True], any(t in ("article", "main") for t, _, _ in stack)))
        first = " ".join(v for _, v in named).split()[:1]
        if (m[3] or "").endswith("/") and inline:
            continue
        around = stack[-1][1] if stack else 0
        stack.append((tag, around if inline else paths.below(around, tag + "".join("." + w for w in first)), held))
        linked[1] += tag == "a"
    flush()
    lifted = _lifted(out, marks, openings, paths)
    return paths, [(path, text, not lifted.issuperset(held), links) for path, text, held, links in out]


def _lifted(nodes: list, marks: list[Mark], openings: list[tuple[int, ...]], paths: Paths) -> set[int]:
    """The marks of no aside. One holds most of the page's text and punctuation, and the article's
    beginning or all but a sixth of the text that no other mark takes out; or it is a section
    inside the article that is named after its heading or by an id of its own."""
    if not marks:
        return set()
    inner = [[] for _ in marks]
    begun = [[] for _ in marks]
    sizes = []
    for k, (_, text, held, linked) in enumerate(nodes):
        plain = max(0, len(text) - linked)
        sizes.append((plain, len(_PUNCTUATION.findall(text)) * plain / len(text)))
        for i in held:
            inner[i].append(k)
    for k, held in enumerate(openings):
        for i in held:
            begun[i].append(k)
    # how many marks still take a node, or an opening, out
    left, closed = [len(held) for _, _, held, _ in nodes], [len(held) for held in openings]
    whole, points = sum(n for n, _ in sizes), sum(p for _, p in sizes)
    free, opened = sum(n for (n, _), c in zip(sizes, left) if not c), sum(not c for c in closed)
    lifted: set[int] = set()

    def lift(i: int) -> None:
        nonlocal free, opened
        lifted.add(i)
        for k in inner[i]:
            left[k] -= 1
            free += sizes[k][0] * (not left[k])
        for k in begun[i]:
            closed[k] -= 1
            opened += not closed[k]

    for i, mark in enumerate(marks):  # outer ones come first
        if mark.tag in NEVER_TAGS or not inner[i]:
            continue
        text = sum(sizes[k][0] for k in inner[i])
        if 2 * text > whole and 2 * sum(sizes[k][1] for k in inner[i]) >= points:
            if 5 * free < text or any(closed[k] == 1 for k in begun[i]) and not opened:
                lift(i)
        elif mark.inside and mark.tag not in ASIDE_TAGS and not any(map(_THREAD.search, mark.by_class + mark.by_id)):
            path, heading, _, _ = nodes[inner[i][0]]
            titled = paths.tag[path] in HEADINGS
            own_id = not mark.by_class and (titled or mark.tag == "section")
            by_title = mark.tag == "section" and titled and all(w in heading.lower() for w in mark.by_class)
            if (own_id or by_title) and text >= 0.4 * sum(len(nodes[k][1]) for k in inner[i]):
                lift(i)
    return lifted


def main_text(page: str, keep: float = 0.08) -> str:
    """The content blocks of a page, joined by line feeds. Time is linear in the page's size but for
    the search for what an end tag closes."""
    paths, nodes = blocks(page)
    parent, tag, depth = paths.parent, paths.tag, paths.depth
    length, points, held = [0.0] * len(parent), [0.0] * len(parent), [False] * len(parent)
    counted = set()
    for path, text, aside, linked in nodes:
        if not aside:
            plain = max(0, len(text) - linked)
            length[path] += plain
            points[path] += len(_PUNCTUATION.findall(text)) * plain / len(text)
            counted.add(path)
    if not counted:
        return ""
    for p in range(len(parent) - 1, 0, -1):  # a container gathers what lies in it
        if parent[p]:
            length[parent[p]] += length[p]
            points[parent[p]] += points[p]
        held[parent[p]] |= held[p] or p in counted
    top = [p for p in range(1, len(parent)) if not parent[p]]
    whole, marks = max(sum(length[p] for p in top), 1.0), max(sum(points[p] for p in top), 1.0)
    ratio = [0.7 * a / whole + 0.3 * b / marks for a, b in zip(length, points)]
    centre = max((p for p in range(1, len(parent)) if held[p] and tag[p] not in _PARTS and ratio[p] > 0.5), key=depth.__getitem__, default=0)

    # home: the article around a path, that is what the page calls so, or else the innermost container
    # that holds most of the page; 0 if it lies in neither
    named, home = [0] * len(parent), [0] * len(parent)
    # text and punctuation of the path, smoothed over the containers around it: each one farther out
    # counts half, down to its article, which counts no less than the first of them, or else to the body
    sums, scale, reaches = [0.0] * len(parent), [1.0] * len(parent), [False] * len(parent)
    scores = [1.0] * len(parent)
    under = [False] * len(parent)
    for p in range(1, len(parent)):
        up = parent[p]
        under[p] = p == centre or under[up]
        named[p] = p if tag[p] in ("article", "main") else named[up]
        h = home[p] = named[p] or (centre if under[p] else 0)
        own = tag[h] in ("article", "main")  # what the page itself calls its article
        sums[p] = ratio[p]
        if p == h:
            scores[p] = ratio[p] + 0.5 * own
            continue
        if tag[p] not in ("body", "html"):
            reaches[p] = h > 0 and up == h
            if up and up != h:
                sums[p] += sums[up] / 2
                scale[p] += scale[up] / 2
                reaches[p] = reaches[up]
        scores[p] = (sums[p] + 0.5 * ratio[h] + 0.25 * own) / (scale[p] + 0.5) if reaches[p] else sums[p] / scale[p]
    best = max(scores[p] for p in counted)
    kept = []
    for path, text, aside, linked in nodes:
        if not aside and scores[path] >= keep * best:
            within = home[path] if linked > 0.6 * len(text) else 0
            written = within and tag[within] not in ("body", "html") and (
                len(_PUNCTUATION.findall(text)) > 1 or text[-1] in ".!?…。！？")
            if linked <= 0.6 * len(text) or written:  # links that read as sentences: references, not a menu
                kept.append(text)
    return "\n".join(kept)


def extract(df: DataFrame, key: str = "page_id", page: str = "html", keep: float = 0.08) -> DataFrame:
    """``key, text`` of every row. A null, blank or textless page gives an empty text; repeated
    rows stay repeated; pages cut off in a tag or reference are read as far as they go."""
    def run(batch):
        texts = [main_text(p or "", keep) for p in batch.column("t").to_pylist()]
        rest = [c for c in batch.schema.names if c != "t"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, "text"])
    rows = df.select(F.col(key).alias("k"), F.col(page).alias("t"))
    return arrow_map(rows, run, f"k {df.schema[key].dataType.simpleString()}, text string", "t").withColumnRenamed("k", key)
