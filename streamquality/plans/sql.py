"""Shared pieces of the check SQL: each is one CTE body over the raw tables."""

from __future__ import annotations

SEED = 20260726

EV = """ev AS (
  SELECT event_type AS recording_id, event_id AS source_idx, event_id,
         row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) - 1 AS event_idx,
         epoch_us(ts) AS t_us, CAST(user_id % 64 AS INTEGER) AS x,
         CAST((event_id * 7) % 48 AS INTEGER) AS y, CAST(event_id % 2 AS INTEGER) AS p,
         CASE WHEN value > 20 THEN 1 ELSE 0 END AS label, value < 15 AS fa,
         CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 AS fb, user_id % 3 = 0 AS fc,
         value AS sc,
         CASE WHEN event_type IN ('click', 'view') THEN 'ui' WHEN event_type = 'error' THEN 'sys'
              ELSE 'biz' END AS scene
  FROM events)"""

LI = """li AS (
  SELECT concat(l_returnflag, l_linestatus) AS recording_id,
         row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_shipdate, l_orderkey,
             l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS event_idx,
         epoch_us(l_shipdate) AS t_us, CAST(l_partkey % 64 AS INTEGER) AS x,
         CAST(l_suppkey % 48 AS INTEGER) AS y, CAST(l_linenumber % 2 AS INTEGER) AS p,
         CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS label, l_quantity <= 25 AS fa,
         l_tax < 0.03 AS fb, l_linenumber <= 3 AS fc, l_extendedprice AS sc, l_returnflag AS scene
  FROM lineitem)"""

BOTH = """s AS (
  SELECT 'ev' AS dataset, recording_id, event_idx, t_us, x, y, p, label, fa, fb, fc, sc, scene,
         150 AS nsl, 64 AS blk FROM ev
  UNION ALL
  SELECT 'li', recording_id, event_idx, t_us, x, y, p, label, fa, fb, fc, sc, scene, 600, 256 FROM li)"""

GRID = """grid AS (SELECT CAST(5 * i AS INTEGER) AS r_pct, CAST(5 * i AS DOUBLE) / 100 AS r
  FROM range(1, 21) t(i))"""


def prio(*parts: str) -> str:
    """52 random bits from md5, as in `functions.hashing.priority`."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT)"


def word(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


SCORED = f"""scored AS (
  SELECT s.*, m.method, CASE m.method WHEN 'raw' THEN 0.0
      WHEN 'random_null' THEN CAST({prio(str(SEED), 'recording_id', 'event_idx')} AS DOUBLE)
      WHEN 'label_oracle' THEN CAST(label AS DOUBLE)
      WHEN 'fa' THEN CASE WHEN fa THEN 0.0 ELSE 1.0 END
      WHEN 'fb' THEN CASE WHEN fb THEN 0.0 ELSE 1.0 END
      WHEN 'fc' THEN CASE WHEN fc THEN 0.0 ELSE 1.0 END
      ELSE CAST(sc AS DOUBLE) END AS score
  FROM s CROSS JOIN (VALUES ('raw'), ('random_null'), ('label_oracle'), ('fa'), ('fb'), ('fc'), ('sc'))
       m(method))"""


def curve_ctes(source: str, out: str, keys: str = "dataset, recording_id, method") -> list[str]:
    """CTEs from a scored stream (keys, event_idx, x, y, label, score, nsl, blk) to a curve."""
    return [
        f"""{out}_rk AS (SELECT {keys}, event_idx, x, y, label, nsl, blk,
  row_number() OVER (PARTITION BY {keys}, event_idx // blk ORDER BY score, event_idx) AS rk,
  count(*) OVER (PARTITION BY {keys}, event_idx // blk) AS n_b FROM {source})""",
        f"""{out}_pos AS (SELECT {keys}, r_pct, x, y, label, nsl,
  (row_number() OVER (PARTITION BY {keys}, r_pct ORDER BY event_idx) - 1) // nsl AS slice
  FROM {out}_rk JOIN grid ON rk <= greatest(1, round_even(n_b * r, 0)))""",
        f"""{out}_px AS (SELECT {keys}, r_pct, slice, x, y, any_value(nsl) AS nsl, count(*) AS n,
  sum(1 - label) AS sg FROM {out}_pos GROUP BY {keys}, r_pct, slice, x, y)""",
        f"""{out}_sl AS (SELECT {keys}, r_pct, slice, any_value(nsl) AS nsl, sum(n) AS ne, sum(sg) AS sg,
  sqrt(sum(n * (n - 1)) / (CAST(any_value(nsl) AS DOUBLE) * (any_value(nsl) - 1))
       * sum(1 - pow(1 - CAST((2 * nsl) // 3 AS DOUBLE) / nsl, n))) AS esr
  FROM {out}_px GROUP BY {keys}, r_pct, slice)""",
        f"""{out} AS (SELECT {keys}, r_pct, avg(esr) FILTER (WHERE ne = nsl) AS mesr,
  CAST(sum(ne) AS BIGINT) AS kept_events,
  CAST(coalesce(sum(ne) FILTER (WHERE ne = nsl), 0) AS BIGINT) AS scored_events,
  CAST(sum(sg) AS BIGINT) AS tp, CAST(coalesce(sum(sg) FILTER (WHERE ne = nsl), 0) AS BIGINT) AS scored_tp
  FROM {out}_sl GROUP BY {keys}, r_pct)""",
    ]


CURVE = curve_ctes("scored", "crv0") + [
    """crv AS (SELECT c.dataset, c.recording_id, c.method, c.r_pct, c.mesr, c.kept_events, c.scored_events,
  c.tp, c.scored_tp, b.mesr AS raw_mesr, b.kept_events AS n_events, c.mesr IS NOT NULL AS evaluable, sc.scene
  FROM crv0 c JOIN crv0 b ON b.dataset = c.dataset AND b.recording_id = c.recording_id AND b.method = 'raw' AND b.r_pct = 100
  JOIN (SELECT DISTINCT dataset, recording_id, scene FROM s) sc
    ON sc.dataset = c.dataset AND sc.recording_id = c.recording_id)"""]

NATIVE = """nat AS (
  SELECT dataset, recording_id, method, avg(CASE WHEN score = 0 THEN 1.0 ELSE 0.0 END) AS native_retention
  FROM scored WHERE method NOT IN ('random_null', 'sc') GROUP BY ALL)"""

RECS = """recs AS (SELECT dataset, recording_id, scene, count(*) AS n_events, 64 AS width, 48 AS height,
  recording_id IN ('click', 'view', 'NO', 'AO') AS synthetic FROM s GROUP BY ALL)"""

STREAMS = [EV, LI, BOTH]
BENCH = [EV, LI, BOTH, GRID, SCORED, *CURVE]
FULL = [*BENCH, NATIVE, RECS]


def query(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def mesr_ctes(source: str, out: str, keys: str) -> list[str]:
    """CTEs from kept rows (keys, event_idx, x, y, nsl) to the MESR of each key."""
    return [
        f"""{out}_p AS (SELECT {keys}, x, y, nsl, (row_number() OVER (PARTITION BY {keys} ORDER BY event_idx) - 1) // nsl AS slice
  FROM {source})""",
        f"""{out}_c AS (SELECT {keys}, slice, x, y, any_value(nsl) AS nsl, count(*) AS n FROM {out}_p GROUP BY {keys}, slice, x, y)""",
        f"""{out}_s AS (SELECT {keys}, slice, any_value(nsl) AS nsl, sum(n) AS ne, count(*) AS occ,
  sum(n * (n - 1)) / (CAST(any_value(nsl) AS DOUBLE) * (any_value(nsl) - 1)) AS ntss,
  sum(1 - pow(1 - CAST((2 * nsl) // 3 AS DOUBLE) / nsl, n)) AS ln FROM {out}_c GROUP BY {keys}, slice)""",
        f"""{out} AS (SELECT {keys}, avg(sqrt(ntss * ln)) AS mesr, count(*) AS slices FROM {out}_s WHERE ne = nsl GROUP BY {keys})""",
    ]


# p-values: integrals by Simpson's rule over 2000 steps, binomial sums by lgamma

def _simpson(of: str, to: str) -> str:
    """Integral of ``of`` (in the variable ``v``) from 0 to ``to``."""
    return f"""((SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {of.replace("{v}", f"({to}) * i / 2000.0")})
  FROM range(0, 2001) g(i)) * ({to}) / 6000.0)"""


def normal_p(z: str) -> str:
    """Two-sided, of a standard normal."""
    return f"(1 - 2 / sqrt(2 * pi()) * {_simpson('exp(-0.5 * pow({v}, 2))', f'least(abs({z}), 12.0)')})"


def t_p(t: str, df: str) -> str:
    """Two-sided, of a t distribution: its tail as an integral over the angle."""
    tail = _simpson(f"pow(sin({{v}}), ({df}) - 1)", f"atan2(sqrt(CAST({df} AS DOUBLE)), abs({t}))")
    return f"CASE WHEN ({df}) > 0 THEN 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * {tail} END"


def rho_p(rho: str, n: str, controls: int = 0) -> str:
    t = f"({rho} * sqrt(greatest({n} - 2 - {controls}, 0) / greatest(1 - {rho} * {rho}, 2.2e-16)))"
    return t_p(t, f"{n} - 2 - {controls}")


def chi2_p_even(x: str, half: str) -> str:
    """Upper tail for 2 * ``half`` degrees of freedom."""
    return f"(SELECT sum(exp(-({x}) / 2 + i * ln(greatest(({x}) / 2, 1e-300)) - lgamma(i + 1))) FROM range(0, {half}) g(i))"


def chi2_p_three(x: str) -> str:
    return f"({normal_p(f'sqrt({x})')} + sqrt(2 * ({x}) / pi()) * exp(-({x}) / 2))"
