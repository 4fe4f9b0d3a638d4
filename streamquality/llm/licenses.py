"""Licence scan by a positional index of rare words.

Each template is a notice as a list of words. Its rarest words in the corpus at hand (highest
inverse document frequency) and those of its key phrases are posted with their place in it. A text looks up which posted words
it holds and where; each posting says where the template would begin. Where enough of a
template's postings agree on a beginning, the words there are compared one by one, and the
template's key phrases must stand in full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, total

#: Phrases that name a licence wherever they stand.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Label, notice, key phrases (all must stand in full).
TEMPLATES = [
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "this work is licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted", "free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "source and binary forms"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work", ["waived all copyright"]),
]
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def licence_words(text: Column) -> Column:
    r"""Runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z; none of a null text."""
    lower = F.translate(F.coalesce(text, F.lit("")), LETTERS, LETTERS.lower())
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def spread(docs: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """Number of texts, and of texts that hold each word of a template: a row per such word."""
    vocabulary = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    held = F.array_distinct(F.filter(licence_words(F.col(text)), lambda w: w.isin(vocabulary)))
    rows = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    found = {r["w"]: r["n"] for r in rows}
    return found.pop("", 0), {w: found.get(w, 0) for w in vocabulary}


def _postings(n: int, held: dict[str, int], rare: int, agree: int) -> list[tuple[str, int, int]]:
    """(word, template, place) of the ``rare`` words of each template with the highest IDF, and of
    ``agree`` such words of each of its key phrases, so a text with the phrases in full is compared
    in any corpus; equal ones in the order of the notice."""
    out = []
    for t, (_, notice, phrases) in enumerate(TEMPLATES):
        ws = notice.split()
        idf = [math.log((n + 1) / (held[w] + 1)) for w in ws]
        def rarest(places: range, many: int) -> list[int]:
            return sorted(places, key=lambda k: (-idf[k], k))[:many]
        chosen = {*rarest(range(len(ws)), rare)}
        for phrase in map(str.split, phrases):
            k = _place(ws, phrase)
            chosen.update(rarest(range(k, k + len(phrase)), agree))
        out += [(ws[k], t, k) for k in sorted(chosen)]
    return out


def _place(notice: list[str], phrase: list[str]) -> int:
    return next(k for k in range(len(notice)) if notice[k:k + len(phrase)] == phrase)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rare: int = 4, agree: int = 2, share: float = 0.6) -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    A null or wordless text has no places, null first and last word, empty labels and score 0.
    Repeated rows are scanned alike. ``labels`` holds the base labels and those of templates of
    which ``agree`` postings agree on a beginning, ``share`` of the words stand there and every
    key phrase stands in full; ``score`` is the highest such share, 1 where a base phrase stands.
    Everything happens within a row: no shuffle but that of the counts of template words."""
    n, held = spread(docs, text)
    postings = _postings(n, held, rare, agree)
    base_heads = {0: ("mit", 2), 1: ("apache", 0), 2: ("cc", 0)}  # each phrase's word to look up, and its place
    look_up = sorted({w for w, _, _ in postings} | {w for w, _ in base_heads.values()})

    def standing(ws: Column, start: Column, phrase: list[str]) -> Column:
        out = F.lit(True)
        for k, w in enumerate(phrase):
            out = out & F.coalesce(F.get(ws, start + k) == w, F.lit(False))
        return (start >= 0) & out

    def base(ws: Column, hits: Column) -> Column:
        def place(i: int) -> Column:
            head, at = base_heads[i]
            phrase, label = PHRASES[i]
            starts = F.transform(F.filter(hits, lambda h: h["w"] == head), lambda h: h["i"] - at)
            return F.transform(F.filter(starts, lambda s: standing(ws, s, phrase.split())), lambda s: F.struct(s.alias("at"), F.lit(label).alias("label")))
        return F.concat(*[place(i) for i in base_heads])

    def votes(hits: Column) -> Column:
        """Template and beginning that each posted word speaks for."""
        by_word: dict[str, list[tuple[int, int]]] = {}
        for w, t, k in postings:
            by_word.setdefault(w, []).append((t, k))
        none = F.array().cast("array<struct<t:int,s:int>>")
        def of(h: Column) -> Column:
            out = none
            for w, places in by_word.items():
                spoken = F.array(*[F.struct(F.lit(t).alias("t"), (h["i"] - k).alias("s")) for t, k in places])
                out = F.when(h["w"] == w, spoken).otherwise(out)
            return out
        return F.flatten(F.transform(hits, of))

    def found(ws: Column, hits: Column) -> Column:
        none = F.array().cast("array<struct<label:string,score:double>>")
        def check(c: Column) -> Column:
            out = none
            for t, (label, notice, phrases) in enumerate(TEMPLATES):
                notice = notice.split()
                matched = sum((F.coalesce((F.get(ws, c["s"] + k) == w).cast("int"), F.lit(0)) for k, w in enumerate(notice)), F.lit(0))
                full = F.lit(True)
                for phrase in map(str.split, phrases):
                    full = full & standing(ws, c["s"] + _place(notice, phrase), phrase)
                got = let(matched / len(notice), lambda s: F.when(full & (s >= share), F.array(F.struct(F.lit(label).alias("label"), s.alias("score")))).otherwise(none))
                out = F.when(c["t"] == t, got).otherwise(out)
            return out
        def candidates(v: Column) -> Column:
            return F.filter(F.array_distinct(v), lambda c: F.size(F.filter(v, lambda x: x == c)) >= agree)
        return F.flatten(F.transform(let(votes(hits), candidates), check))

    def result(ws: Column, hits: Column) -> Column:
        labels_of = lambda xs: F.array_join(F.sort_array(F.array_distinct(xs)), ",")
        def summed(b: Column, f: Column) -> Column:
            return F.struct(
                F.size(ws).cast("long").alias("n_words"), F.size(b).cast("long").alias("n_base"),
                F.array_min(F.transform(b, lambda x: x["at"])).cast("long").alias("first_word"),
                F.array_max(F.transform(b, lambda x: x["at"])).cast("long").alias("last_word"),
                labels_of(F.transform(b, lambda x: x["label"])).alias("base_labels"),
                labels_of(F.concat(F.transform(b, lambda x: x["label"]), F.transform(f, lambda x: x["label"]))).alias("labels"),
                F.when(F.size(b) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(f, lambda x: x["score"])), F.lit(0.0))).alias("score"))
        empty_b = F.array().cast("array<struct<at:int,label:string>>")
        empty_f = F.array().cast("array<struct<label:string,score:double>>")
        some = F.size(hits) > 0
        return let(F.when(some, base(ws, hits)).otherwise(empty_b), lambda b: let(
            F.when(some, found(ws, hits)).otherwise(empty_f), lambda f: summed(b, f)))

    def hits_of(ws: Column) -> Column:
        return F.filter(F.transform(ws, lambda w, i: F.when(w.isin(look_up), F.struct(i.alias("i"), w.alias("w")))), lambda h: h.isNotNull())

    rows = docs.select(F.col(key), let(licence_words(F.col(text)), lambda ws: let(hits_of(ws), lambda hits: result(ws, hits))).alias("r"))
    return rows.select(key, "r.*")
