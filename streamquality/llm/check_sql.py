"""Check SQL of the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}


def _hashed(parts: list[str]) -> str:
    return "sha256(concat(%s))" % ", ".join(parts)


def _field(value: str) -> str:
    return f"coalesce(concat(strlen(CAST({value} AS VARCHAR)), ':', CAST({value} AS VARCHAR)), '-')"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _runs(name: str, levels: int) -> str:
    """Nodes of ``{name}0`` (grp, pos, h), level by level, each with its siblings; at most 16 to the
    power of ``levels`` of them a group."""
    out = []
    for l in range(levels):
        out.append(f"""{name}{l}s AS (SELECT grp, pos, h, n, coalesce(string_agg(h, '') OVER (PARTITION BY grp, pos // 16 ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (PARTITION BY grp, pos // 16
      ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
    FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}{l}))""")
        out.append(f"""{name}{l + 1} AS (SELECT grp, pos // 16 AS pos, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
    FROM {name}{l}s GROUP BY grp, pos // 16)""")
    return ",\n  ".join(out)


def _merkle(levels: int = 5) -> str:
    fields = ["doc_id", "source", "lang", "n_chars"]
    heights = [(name, l, f"{name}s{l}") for name in "dg" for l in range(levels)]
    at = {"d": ("u.grp", "u.pos"), "g": ("0", "r.pos")}
    joins = [f"JOIN {n}{l}s {t} ON {t}.grp = {at[n][0]} AND {t}.pos = {at[n][1]} // {16 ** l}" for n, l, t in heights]
    steps = [(f"{t}_n", f"{t}_a", f"{t}_b") for _, _, t in heights]
    carried = ", ".join(f"{t}.n AS {t}_n, {t}.a AS {t}_a, {t}.b AS {t}_b" for _, _, t in heights)
    # each step is a subquery, so that the expression stays short
    source = f"SELECT u.doc_id, u.leaf, d{levels}.h AS subroot, g{levels}.h AS root, u.start AS f0, {carried}\n  FROM u JOIN d{levels} ON d{levels}.grp = u.grp JOIN r ON r.grp = u.grp CROSS JOIN g{levels} " + " ".join(joins)
    for i, (n, a, b) in enumerate(steps):
        source = f"SELECT *, CASE WHEN {n} = 1 THEN f{i} ELSE sha256(concat({a}, f{i}, {b})) END AS f{i + 1} FROM ({source})"
    parts = ", ".join(x for n, a, b in steps for x in (a, b))
    return f"""WITH t AS (SELECT doc_id, coalesce(concat('1', source), '0') AS grp, {_hashed([_field(f) for f in fields + ["text"]])} AS leaf,
    {_hashed([_field(f) for f in fields] + [_field(_lower("text"))])} AS other,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS crc FROM documents),
  u AS (SELECT doc_id, grp, leaf, CASE WHEN crc % 5 = 0 THEN other ELSE leaf END AS start,
    row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM t),
  d0 AS (SELECT grp, pos, leaf AS h FROM u),
  {_runs("d", levels)},
  r AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS pos FROM d{levels}),
  g0 AS (SELECT 0 AS grp, r.pos, d{levels}.h FROM r JOIN d{levels} USING (grp)),
  {_runs("g", levels)}
SELECT doc_id, leaf, subroot, root, sha256(concat({parts})) AS proof_sha256, f{len(steps)} AS folded_root, f{len(steps)} = root AS verified
FROM ({source})"""


SQL["op11_merkle_manifest"] = _merkle()

SQL["op12_benchmark_overlap"] = f"""WITH d AS (SELECT row_number() OVER () AS nr, doc_id,
    regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
  v AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS gram
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
  g AS (SELECT nr, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram
    FROM (SELECT nr, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM v))),
  m AS (SELECT DISTINCT nr, g.n, p, item_id FROM g JOIN v USING (n, gram)),
  h AS (SELECT nr, count(DISTINCT word) AS n_hit FROM (SELECT nr, unnest(range(p, p + n)) AS word FROM m) GROUP BY nr),
  i AS (SELECT nr, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
    FROM m GROUP BY nr)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (nr) LEFT JOIN i USING (nr)"""

SQL["op13_hard_negatives"] = """WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""
