"""Secret scan with linking of the parts of a credential.

Assignments, access identifiers and long hexadecimal runs are reported wherever they stand. Other
candidates are weak by themselves: a mixed token might be a secret, a short identifier or a user
name might belong to one, a host might be where they are used. They are joined as intervals: a
weak candidate is reported only if a part of another role, weak or strong, lies in its scope (the
same document, at most ``reach`` characters away): a secret needs an identifier, an identifier a
secret, an endpoint both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import arrow_map

ASSIGN, ACCESS, HEX, IDENTIFIER, SECRET, ENDPOINT = range(6)
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
#: Which of the three roles a kind plays.
ROLES = {ASSIGN: "secret", ACCESS: "identifier", HEX: "secret", IDENTIFIER: "identifier", SECRET: "secret", ENDPOINT: "endpoint"}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTIFIER = re.compile(r"""\b(?:client_?id|access_?key_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{4,}""", re.I | re.A)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s"'<>]+""", re.I | re.A)
_HEX_BYTES = bytes(120 if b in b"0123456789abcdef" else 32 for b in range(256))
_TOKEN_BYTES = bytes(120 if chr(b).isalnum() and b < 128 or b in b"+/_-" else 32 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of what is reported by itself, ordered. Cheap tests for the few
    letters that every match has come before the patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), ASSIGN, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), ACCESS, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode().translate(_HEX_BYTES):
        out += [(m.start(), HEX, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Candidates that need company, apart from what overlaps a base span."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), IDENTIFIER, m.end()) for m in _IDENTIFIER.finditer(text)]
        found += [(m.start(), ENDPOINT, m.end()) for m in _ENDPOINT.finditer(text)] if "://" in text else []
    if "AKIA" in text:
        found += [(m.start(), IDENTIFIER, m.end()) for m in _ACCESS.finditer(text) if 16 <= m.end() - m.start() < 20]
    if b"x" * 20 in text.encode().translate(_TOKEN_BYTES):
        found += [(m.start(), SECRET, m.end()) for m in _TOKEN.finditer(text) if _mixed(m[0])]
    taken = [(a, b) for a, _, b in base]
    at = 0
    for span in sorted(found):
        while at < len(taken) and taken[at][1] <= span[0]:
            at += 1
        if not any(a < span[2] and span[0] < b for a, b in taken[at:at + 3]):
            yield span


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, tie, base, weak`` of every row; ``tie`` tells texts of equal keys apart."""
    def run(batch):
        base, weak = [], []
        as_rows = lambda spans: [dict(zip(("start", "kind", "end"), s)) for s in spans]
        for t in batch.column("t").to_pylist():
            t = t or ""
            spans = base_spans(t)
            base.append(as_rows(spans))
            weak.append(as_rows(weak_spans(t, spans)))
        return pa.RecordBatch.from_arrays([batch.column("k"), batch.column("tie"), pa.array(base, _SPAN_TYPE), pa.array(weak, _SPAN_TYPE)],
                                          ["k", "tie", "base", "weak"])
    rows = df.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("t"))
    return arrow_map(rows, run, f"k {df.schema[key].dataType.simpleString()}, tie long, base {_SPANS}, weak {_SPANS}", "t")


def linked(found: DataFrame, reach: int) -> DataFrame:
    """``k, tie, added``: weak candidates with the company they need. The interval join meets on
    the document and the stretch of ``reach`` characters, so a long text is many small groups;
    texts without a weak candidate take no part."""
    spans = found.filter("size(weak) > 0").select("k", "tie", F.explode(F.concat("base", "weak")).alias("s"))
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("s.kind"))
    parts = spans.select("k", "tie", F.col("s"), role.alias("role"), F.floor(F.col("s.start") / reach).alias("stretch")).distinct()
    ends = F.floor((F.col("s.end") + reach) / reach)
    others = parts.select(
        F.col("k").alias("k2"), F.col("tie").alias("tie2"), F.col("s").alias("s2"), F.col("role").alias("role2"),
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("stretch") - 1), ends)).alias("at"))
    weak = parts.filter(F.col("s.kind") >= IDENTIFIER)
    weak = weak.withColumn("at", F.explode(F.sequence("stretch", F.floor((F.col("s.end") + reach) / reach))))
    near = ((F.col("s2.start") <= F.col("s.end") + reach) & (F.col("s.start") <= F.col("s2.end") + reach) & (F.col("role") != F.col("role2")))
    pairs = weak.join(others, F.col("k").eqNullSafe(F.col("k2")) & (F.col("tie") == F.col("tie2")) & (weak["at"] == others["at"]) & near)
    met = pairs.groupBy("k", "tie", "s", "role").agg(F.collect_set("role2").alias("met"))
    enough = F.when(F.col("role") == "secret", F.array_contains("met", "identifier")).when(
        F.col("role") == "identifier", F.array_contains("met", "secret")).otherwise(
        F.array_contains("met", "secret") & F.array_contains("met", "identifier"))
    return met.filter(enough).groupBy("k", "tie").agg(F.collect_list("s").alias("added"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 200) -> DataFrame:
    """``key, tie, base, spans`` of every row: arrays of ``(start, kind, end)``, code points, end
    exclusive, ordered by start, then kind. ``tie`` is xxhash64 of the text.

    A null or empty text has no spans. Repeated rows get the same spans each; rows of one key
    with different texts keep apart by ``tie``. An empty table gives an empty one."""
    found = stage(candidates(df, key, text), "secret-candidates")
    added = linked(found, reach).select(F.col("k").alias("k2"), F.col("tie").alias("tie2"), "added")
    rows = found.join(added, F.col("k").eqNullSafe(F.col("k2")) & (F.col("tie") == F.col("tie2")), "left")
    spans = F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(_SPANS))))
    return rows.select(F.col("k").alias(key), "tie", "base", spans.alias("spans"))


def written(spans) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``df`` with every reported span replaced by ``mark`` (overlapping ones by one).
    Rows without a span are untouched; null texts stay null. Other columns are carried along, whatever
    their names."""
    def cut(batch):
        texts = []
        for t, spans in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist()):
            out, at = [], 0
            for s in spans or []:
                if s["start"] >= at:
                    out += [t[at:s["start"]], mark]
                at = max(at, s["end"])
            texts.append(t if not spans else "".join(out) + t[at:])
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "t"])
    spans = scan(df, key, text, reach).filter("size(spans) > 0").select(
        F.col(key).alias("k2"), F.col("tie").alias("tie2"), "spans").dropDuplicates(["k2", "tie2"])
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))
    rows = rows.join(spans, F.col("k").eqNullSafe(F.col("k2")) & (F.xxhash64("t") == F.col("tie2")), "left").select("row", "t", "spans")
    done = arrow_map(rows, cut, rows.select("row", "t").schema, "t")
    return done.select(*[F.col("t").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])
