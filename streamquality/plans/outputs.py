"""Queries on scorers, labels, oracles and native outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ranks
from ..functions.numeric import div
from ..operators import metric, oracle, order, resample, scorers
from ..schema import SEED, method_table
from ..sources.tables import CORPORA, EVENT_STREAM, METHODS, scores
from ..staging import attach, stage
from . import sql as Q
from .base import Registry, rounded
from .positions import per_corpus

registry = Registry()
KEY = "recording_id"
MASKS = ["fa", "fb", "fc"]
DRAWS = resample.DRAWS


@registry.add("d1_d2_d3_controls", Q.query([*Q.STREAMS, Q.GRID, Q.SCORED], """
SELECT dataset, recording_id, method, count(*) AS kept, CAST(sum(event_idx % 1000003) AS BIGINT) AS idx_sum FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, recording_id, method, event_idx // blk ORDER BY score, event_idx) AS rk,
    count(*) OVER (PARTITION BY dataset, recording_id, method, event_idx // blk) AS n_b
  FROM scored WHERE method IN ('raw', 'label_oracle', 'random_null'))
WHERE rk <= greatest(1, round_even(n_b * CAST(0.25 AS DOUBLE), 0)) GROUP BY ALL"""))
def _(ws):
    s = scores()

    def one(c):
        parts = [metric.retain(ws.stream(c), s[m], 0.25, c.block).groupBy(KEY).agg(
            F.count("*").alias("kept"), F.sum(F.col("event_idx") % 1000003).alias("idx_sum"))
            .withColumn("method", F.lit(m)) for m in ("raw", "label_oracle", "random_null")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])
    return per_corpus(one)


@registry.add("d4_score_table", Q.query([*Q.STREAMS, Q.SCORED], """
SELECT recording_id, method, count(*) AS n, round(avg(score), 6) AS mean_score FROM scored
WHERE method <> 'random_null' GROUP BY ALL"""))
def _(ws):
    s = {m: c for m, c in scores().items() if m != "random_null"}
    return rounded(scorers.score_events(ws.both(), s).groupBy(KEY, "method").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_score")), 6)


@registry.add("d5_decisions_to_scores", Q.query([Q.EV], """
SELECT recording_id, CASE WHEN sc > 30 THEN 0.0 ELSE 1.0 END :: DOUBLE AS score, count(*) AS n, CAST(sum(event_idx % 1000003) AS BIGINT) AS idx_sum
FROM ev GROUP BY ALL"""))
def _(ws):
    s = ws.stream(EVENT_STREAM)
    return scorers.decisions_to_scores(s, s.where("sc > 30")).groupBy(
        KEY, F.col("score").cast("double").alias("score")).agg(
        F.count("*").alias("n"), F.sum(F.col("event_idx") % 1000003).alias("idx_sum"))


@registry.add("d6_native_retention", Q.query([*Q.STREAMS, Q.SCORED], """
SELECT recording_id, method, count(*) AS n_events, round(CASE WHEN count(*) FILTER (WHERE score NOT IN (0, 1)) = 0
  THEN avg(CASE WHEN score = 0 THEN 1.0 ELSE 0.0 END) END, 9) AS native_retention FROM scored GROUP BY ALL"""))
def _(ws):
    return rounded(scorers.native_retention(scorers.score_events(ws.both(), scores())))


def coarse(ws) -> DataFrame:
    """The wide stream on a coarse clock and sensor, so many events are identical."""
    s = ws.stream(CORPORA[1])
    return s.withColumns({"t_us": div("t_us", 2_592_000_000_000), "x": F.col("x") % 16,
                          "y": F.col("y") % 12})


COARSE = """co AS (SELECT recording_id, event_idx, t_us // 2592000000000 AS t_us, x % 16 AS x, y % 12 AS y, p, label, fa FROM li)"""


def kept_rows(ws) -> DataFrame:
    """Rows a filter returned, as values in output order, written once per session."""
    def build():
        placed = order.with_mask_positions(coarse(ws), ["fa"], CORPORA[1].block).where("fa")
        return placed.select(KEY, F.col("fa_pos").alias("kept_idx"), "event_idx", "t_us", "x", "y", "p", "label")
    return ws.once("kept-rows", build)


#: The forward scan, row by row: all times at once, as a scan can't go back to an earlier time.
FORWARD = ["""kept AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY event_idx) - 1 AS kept_idx, count(*) OVER (PARTITION BY recording_id) AS total FROM co WHERE fa)""",
    "tgt AS (SELECT *, row_number() OVER (PARTITION BY recording_id, t_us ORDER BY kept_idx) AS i FROM kept)",
    """scan AS (SELECT DISTINCT recording_id, t_us, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS kept_idx, CAST(-1 AS BIGINT) AS event_idx FROM kept UNION ALL
       SELECT c.recording_id, c.t_us, t.i, t.kept_idx, min(e.event_idx) FROM scan c JOIN tgt t ON t.recording_id = c.recording_id AND t.t_us = c.t_us AND t.i = c.i + 1
         JOIN co e ON e.recording_id = t.recording_id AND e.t_us = t.t_us AND e.x = t.x AND e.y = t.y AND e.p = t.p AND e.event_idx > c.event_idx
       GROUP BY c.recording_id, c.t_us, t.i, t.kept_idx)""",
    """att AS (SELECT k.recording_id, k.kept_idx, k.total, k.event_idx AS e, k.label AS le, c.event_idx AS w, s.label AS lw FROM kept k
       LEFT JOIN scan c ON c.recording_id = k.recording_id AND c.kept_idx = k.kept_idx LEFT JOIN co s ON s.recording_id = c.recording_id AND s.event_idx = c.event_idx)"""]


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes)


@registry.add("d7_attribution", recursive(Q.LI, COARSE, *FORWARD) + """
SELECT recording_id, count(*) AS kept, count(*) FILTER (WHERE w IS NULL) AS unmatched,
  count(*) FILTER (WHERE w <= prev) AS inversions, CAST(sum(w % 1000003) AS BIGINT) AS idx_sum FROM (
  SELECT *, lag(w) OVER (PARTITION BY recording_id ORDER BY kept_idx) AS prev FROM att) GROUP BY ALL""")
def _(ws):
    found = stage(scorers.attribute_kept(coarse(ws), kept_rows(ws)), "attributed")
    sums = found.groupBy(KEY).agg(F.sum(F.col("event_idx") % 1000003).alias("idx_sum"))
    return scorers.attribution_report(found).join(sums, KEY)


@registry.add("d8_packets", "WITH RECURSIVE " + ",\n".join([Q.LI, COARSE,
    """rep AS (SELECT recording_id, event_idx, prev FROM (SELECT *, lag(event_idx) OVER (PARTITION BY recording_id, t_us, x, y, p
       ORDER BY event_idx) AS prev FROM co) WHERE prev IS NOT NULL)""",
    """cut AS (SELECT recording_id, CAST(0 AS BIGINT) AS start FROM co GROUP BY recording_id UNION ALL
       SELECT c.recording_id, min(r.event_idx) AS start FROM cut c JOIN rep r ON r.recording_id = c.recording_id AND r.prev >= c.start
       GROUP BY c.recording_id)"""]) + """
SELECT cut.recording_id, start, coalesce(lead(start) OVER (PARTITION BY cut.recording_id ORDER BY start), n) AS stop
FROM cut JOIN (SELECT recording_id, count(*) AS n FROM co GROUP BY ALL) z ON z.recording_id = cut.recording_id""")
def _(ws):
    return scorers.packets(coarse(ws), block=2048)


@registry.add("d7_packet_attribution", recursive(*[Q.LI, COARSE, """pk AS (SELECT recording_id, event_idx, t_us, x, y, p, lag(event_idx) OVER (PARTITION BY recording_id, t_us, x, y, p ORDER BY event_idx) AS prev, fa FROM co)""",
    """cut AS (SELECT recording_id, CAST(0 AS BIGINT) AS start FROM co GROUP BY recording_id UNION ALL
       SELECT c.recording_id, min(r.event_idx) FROM cut c JOIN pk r ON r.recording_id = c.recording_id AND r.prev >= c.start GROUP BY c.recording_id)""",
    "ranges AS (SELECT *, lead(start) OVER (PARTITION BY recording_id ORDER BY start) AS stop FROM cut)",
    """src AS (SELECT pk.*, r.start FROM pk ASOF JOIN cut r ON r.recording_id = pk.recording_id AND pk.event_idx >= r.start)""",
    """found AS (SELECT k.recording_id, k.event_idx AS truth, s.event_idx FROM src k LEFT JOIN src s ON s.recording_id = k.recording_id AND s.start = k.start
       AND s.t_us = k.t_us AND s.x = k.x AND s.y = k.y AND s.p = k.p WHERE k.fa)"""]) + """
SELECT recording_id, count(*) AS kept, count(*) FILTER (WHERE event_idx IS NULL) AS unmatched, count(*) FILTER (WHERE event_idx <> truth) AS moved,
  CAST(sum(event_idx % 1000003) AS BIGINT) AS idx_sum FROM found GROUP BY ALL""")
def _(ws):
    events = coarse(ws)
    table = stage(scorers.packets(events, block=2048), "packets")
    kept = scorers.with_packet(kept_rows(ws), table).withColumnRenamed("event_idx", "truth")
    found = scorers.attribute_in_packets(events, table, kept)
    return found.groupBy(KEY).agg(
        F.count("*").alias("kept"), F.count_if(F.col("event_idx").isNull()).alias("unmatched"),
        F.count_if(F.col("event_idx") != F.col("truth")).alias("moved"),
        F.sum(F.col("event_idx") % 1000003).alias("idx_sum"))


GROUPS = """g AS (SELECT recording_id, t_us, x, y, p, count(*) AS n, count(*) FILTER (WHERE label = 0) AS sg FROM co GROUP BY ALL),
per AS (SELECT recording_id, CAST(sum(n) AS BIGINT) AS events, count(*) FILTER (WHERE n >= 2) AS groups,
  CAST(coalesce(sum(n) FILTER (WHERE n >= 2), 0) AS BIGINT) AS events_in_groups, max(n) AS largest,
  count(*) FILTER (WHERE n >= 2 AND sg > 0 AND sg < n) AS mixed_groups FROM g GROUP BY recording_id)"""


@registry.add("d9_identical_groups", Q.query([Q.LI, COARSE, GROUPS], "SELECT * FROM per"))
def _(ws):
    return scorers.identical_groups(coarse(ws))


@registry.add("d9_identical_groups_corpus", Q.query([Q.LI, COARSE, GROUPS], """
SELECT CAST(sum(events) AS BIGINT) AS events, CAST(sum(groups) AS BIGINT) AS groups, CAST(sum(events_in_groups) AS BIGINT) AS events_in_groups,
  count(*) AS recordings, count(*) FILTER (WHERE groups > 0) AS recordings_with_groups, max(largest) AS largest,
  CAST(sum(mixed_groups) AS BIGINT) AS mixed_groups, max(mixed_groups) AS max_mixed_in_one_recording FROM per"""))
def _(ws):
    return scorers.summarise_groups(scorers.identical_groups(coarse(ws)))


ROUTES = [*FORWARD, """routes AS (SELECT recording_id, 'fa' AS method, count(*) AS kept, count(*) FILTER (WHERE e IS DISTINCT FROM w) AS moved,
             count(*) FILTER (WHERE kept_idx < total // 600 * 600) AS scored,
             count(*) FILTER (WHERE kept_idx < total // 600 * 600 AND le = 0) AS tp_scored,
             count(*) FILTER (WHERE kept_idx < total // 600 * 600 AND lw = 0) AS tp_scored_whole_merge FROM att GROUP BY recording_id)"""]


def _routes(ws):
    rows = kept_rows(ws)
    columns = [KEY, F.lit("fa").alias("method"), "kept_idx", "event_idx", "label"]
    whole = scorers.attribute_kept(coarse(ws), rows, carry=["label"])
    return scorers.compare_routes(rows.select(*columns), whole.select(*columns), CORPORA[1].slice_size)


@registry.add("d10_route_comparison", recursive(Q.LI, COARSE, *ROUTES) + " SELECT * FROM routes")
def _(ws):
    return _routes(ws)


@registry.add("d10_route_summary", recursive(Q.LI, COARSE, *ROUTES) + """
SELECT count(*) AS cells, count(*) FILTER (WHERE moved > 0) AS cells_moved, CAST(sum(moved) AS BIGINT) AS events_moved, max(moved) AS max_moved,
  count(*) FILTER (WHERE tp_scored <> tp_scored_whole_merge) AS tp_changed_cells,
  greatest(0, max(tp_scored_whole_merge - tp_scored)) AS max_tp_overcount,
  greatest(0, -min(tp_scored_whole_merge - tp_scored)) AS max_tp_undercount FROM routes""")
def _(ws):
    return scorers.summarise_routes(_routes(ws))


@registry.add("d11_tie_break", Q.query(Q.STREAMS, f"""
SELECT dataset, recording_id, seed, CAST(sum(event_idx % 1000003) AS BIGINT) AS idx_sum, count(*) FILTER (WHERE fa) AS accepted, count(*) AS kept FROM (
  SELECT s.*, seed, row_number() OVER (PARTITION BY dataset, recording_id, seed, event_idx // blk ORDER BY CASE WHEN fa THEN 0 ELSE 1 END,
    {Q.prio('seed', 'recording_id', 'event_idx')}, event_idx) AS rk, count(*) OVER (PARTITION BY dataset, recording_id, seed, event_idx // blk) AS n_b
  FROM s CROSS JOIN (VALUES (1), (2), (3)) t(seed))
WHERE rk <= greatest(1, round_even(n_b * CAST(0.4 AS DOUBLE), 0)) GROUP BY ALL"""))
def _(ws):
    def one(c):
        s = ws.stream(c)
        out = None
        for seed in (1, 2, 3):
            key = scorers.tie_broken(F.col("fa"), seed, F.col(KEY), F.col("event_idx"), algorithm="md5")
            part = metric.retain(s, key, 0.4, c.block).groupBy(KEY).agg(
                F.sum(F.col("event_idx") % 1000003).alias("idx_sum"), F.count_if("fa").alias("accepted"),
                F.count("*").alias("kept")).withColumn("seed", F.lit(seed))
            out = part if out is None else out.unionByName(part)
        return out
    return per_corpus(one)


GAUSS = f"""gs AS (SELECT dataset, recording_id, label, sqrt(-2 * ln(u)) * cos(2 * pi() * v)
  + CASE WHEN label = 1 THEN sqrt(2.0) * {scorers.probit(0.93)!r} ELSE 0 END AS score FROM (
  SELECT *, ({Q.word("20260726", "'u'", 'recording_id', 'event_idx')} + 0.5) / 4294967296.0 AS u,
    ({Q.word("20260726", "'v'", 'recording_id', 'event_idx')} + 0.5) / 4294967296.0 AS v FROM s))"""

AUC = """rk AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2.0 AS r
  FROM {t} WINDOW w AS (PARTITION BY {k} ORDER BY score)),
auc AS (SELECT {k}, count(*) AS n, (sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) AS auc FROM rk GROUP BY {k})"""


@registry.add("d12_known_auc_scores", Q.query([*Q.STREAMS, GAUSS, AUC.format(t="gs", k="dataset, recording_id")], """
SELECT dataset, recording_id, n, round(auc, 9) AS auc FROM auc"""))
def _(ws):
    s = ws.both().withColumn("score", scorers.shifted_gaussian(SEED, 0.93, "md5"))
    return rounded(ranks.roc_auc(s.withColumn("pos", F.col("label") == 1), ["dataset", KEY], "pos", "score"))


@registry.add("d15_neighbourhood_support", Q.query([Q.EV], """
SELECT a.recording_id, a.event_idx, count(b.event_idx) AS support FROM ev a LEFT JOIN ev b ON b.recording_id = a.recording_id
  AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.t_us - b.t_us BETWEEN 1 AND 86400000000 GROUP BY ALL"""))
def _(ws):
    return scorers.neighbourhood_support(ws.stream(EVENT_STREAM), 1, 86_400_000_000)


@registry.add("d15_support_filter_mesr", Q.query([Q.EV,
    """sup AS (SELECT a.recording_id, a.event_idx, a.x, a.y, 150 AS nsl FROM ev a JOIN ev b ON b.recording_id = a.recording_id
       AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.t_us - b.t_us BETWEEN 1 AND 86400000000 GROUP BY ALL HAVING count(*) >= 1)""",
    *Q.mesr_ctes("sup", "m", "recording_id")], "SELECT recording_id, 'support' AS method, round(mesr, 9) AS mesr, slices FROM m"))
def _(ws):
    s = ws.stream(EVENT_STREAM)
    kept = scorers.support_filter(scorers.neighbourhood_support(s, 1, 86_400_000_000), 1)
    marked = s.join(kept.select(KEY, "event_idx", (F.col("score") == 0).alias("support")), [KEY, "event_idx"])
    return rounded(metric.mesr_of_masks(marked, ["support"], EVENT_STREAM.slice_size, EVENT_STREAM.block))


@registry.add("p21_method_flags", Q.query([*Q.STREAMS, Q.SCORED], """
SELECT method, count(*) AS n, method = 'label_oracle' AS is_oracle, method IN ('raw', 'random_null') AS is_null,
  method NOT IN ('random_null', 'sc') AS has_native FROM scored GROUP BY ALL"""))
def _(ws):
    counts = scorers.score_events(ws.both(), scores()).groupBy("method").agg(F.count("*").alias("n"))
    return counts.join(method_table(ws.spark, METHODS), "method")


# --- native outputs --------------------------------------------------------------------------

NATIVE = [
    """nk AS (SELECT dataset, recording_id, method, event_idx, x, y, label, nsl, blk, row_number() OVER (PARTITION BY dataset, recording_id, method ORDER BY event_idx) - 1 AS j,
       count(*) OVER (PARTITION BY dataset, recording_id, method) AS total FROM (
       SELECT *, 'fa' AS method FROM s WHERE fa UNION ALL SELECT *, 'fb' FROM s WHERE fb UNION ALL SELECT *, 'fc' FROM s WHERE fc))""",
    "pre AS (SELECT * FROM nk WHERE j < total // nsl * nsl)",
    "ab AS (SELECT dataset, recording_id, method, event_idx // blk AS block, count(*) AS a_b FROM pre GROUP BY ALL)",
    f"""rkd AS (SELECT s.*, m.method, row_number() OVER (PARTITION BY dataset, recording_id, m.method, event_idx // blk ORDER BY label, event_idx) AS ork,
       row_number() OVER (PARTITION BY dataset, recording_id, m.method, event_idx // blk ORDER BY {Q.prio(str(Q.SEED), 'recording_id', 'm.method', 'event_idx')}, event_idx) AS nrk
       FROM s CROSS JOIN (VALUES ('fa'), ('fb'), ('fc')) m(method))""",
    """sides AS (SELECT dataset, recording_id, method, 'filter' AS side, event_idx, x, y, label, nsl FROM pre
       UNION ALL SELECT r.dataset, r.recording_id, r.method, 'oracle', event_idx, x, y, label, nsl FROM rkd r JOIN ab ON ab.dataset = r.dataset
         AND ab.recording_id = r.recording_id AND ab.method = r.method AND ab.block = r.event_idx // r.blk WHERE ork <= a_b
       UNION ALL SELECT r.dataset, r.recording_id, r.method, 'null', event_idx, x, y, label, nsl FROM rkd r JOIN ab ON ab.dataset = r.dataset
         AND ab.recording_id = r.recording_id AND ab.method = r.method AND ab.block = r.event_idx // r.blk WHERE nrk <= a_b)""",
    *Q.mesr_ctes("sides", "sm", "dataset, recording_id, method, side"),
    """lab AS (SELECT dataset, recording_id, method, side, count(*) AS n, CAST(sum(1 - label) AS BIGINT) AS tp FROM sides GROUP BY ALL)""",
    """tot AS (SELECT dataset, recording_id, method, count(*) AS n_events, count(*) FILTER (WHERE CASE method WHEN 'fa' THEN fa WHEN 'fb' THEN fb ELSE fc END) AS native_kept,
       count(*) FILTER (WHERE label = 0) AS n_signal, count(*) FILTER (WHERE label = 1) AS n_noise
       FROM s CROSS JOIN (VALUES ('fa'), ('fb'), ('fc')) m(method) GROUP BY ALL)""",
    """cell AS (SELECT t.*, coalesce(lf.n, 0) AS scored, f.mesr, o.mesr AS oracle_mesr, u.mesr AS null_mesr, lf.tp, lo.tp AS oracle_tp, lo.n AS oracle_scored, ln.n AS null_scored,
       t.native_kept / CAST(t.n_events AS DOUBLE) AS native_retention, coalesce(lf.n, 0) - lf.tp AS fp, f.mesr - o.mesr > 1e-12 AS mesr_win,
       CASE WHEN lf.tp < lo.tp THEN 'strict' WHEN lf.tp = lo.tp THEN 'tie' WHEN lf.tp > lo.tp THEN 'impossible' END AS label_class,
       lf.tp / CAST(n_signal AS DOUBLE) AS signal_retention, lo.tp / CAST(n_signal AS DOUBLE) AS oracle_signal_retention
       FROM tot t
       LEFT JOIN sm f ON f.dataset = t.dataset AND f.recording_id = t.recording_id AND f.method = t.method AND f.side = 'filter'
       LEFT JOIN sm o ON o.dataset = t.dataset AND o.recording_id = t.recording_id AND o.method = t.method AND o.side = 'oracle'
       LEFT JOIN sm u ON u.dataset = t.dataset AND u.recording_id = t.recording_id AND u.method = t.method AND u.side = 'null'
       LEFT JOIN lab lf ON lf.dataset = t.dataset AND lf.recording_id = t.recording_id AND lf.method = t.method AND lf.side = 'filter'
       LEFT JOIN lab lo ON lo.dataset = t.dataset AND lo.recording_id = t.recording_id AND lo.method = t.method AND lo.side = 'oracle'
       LEFT JOIN lab ln ON ln.dataset = t.dataset AND ln.recording_id = t.recording_id AND ln.method = t.method AND ln.side = 'null')""",
]
CELLS = [*Q.STREAMS, *NATIVE]


def native_cells(ws) -> DataFrame:
    """Native cells of both corpora, computed once per session."""
    return ws.once("native-cells", lambda: per_corpus(lambda c: oracle.native_cells(
        ws.stream(c), MASKS, c.slice_size, c.block, SEED, "md5")))


@registry.add("d13_oracle_mask", Q.query(CELLS, """
SELECT dataset, recording_id, method, side, count(*) AS n, CAST(sum(event_idx % 1000003) AS BIGINT) AS idx_sum FROM sides WHERE side = 'oracle' GROUP BY ALL"""))
def _(ws):
    return _sides(ws, "oracle")


def _sides(ws, side):
    return per_corpus(lambda c: oracle.matched_positions(
        ws.stream(c), MASKS, c.slice_size, c.block, SEED, "md5").where(F.col("side") == side)
        .groupBy(KEY, "method", "side").agg(F.count("*").alias("n"), F.sum(F.col("event_idx") % 1000003).alias("idx_sum")))


@registry.add("d14_matched_random_mask", Q.query(CELLS, """
SELECT dataset, recording_id, method, side, count(*) AS n, CAST(sum(event_idx % 1000003) AS BIGINT) AS idx_sum FROM sides WHERE side = 'null' GROUP BY ALL"""))
def _(ws):
    return _sides(ws, "null")


@registry.add("o5_native_output_oracle", Q.query(CELLS, """
SELECT dataset, recording_id, method, n_events, native_kept, n_signal, n_noise, scored, round(mesr, 9) AS mesr, round(oracle_mesr, 9) AS oracle_mesr,
  tp, oracle_tp, oracle_scored, fp, mesr_win, label_class, round(native_retention, 9) AS native_retention,
  round(signal_retention, 9) AS signal_retention, round(oracle_signal_retention, 9) AS oracle_signal_retention FROM cell"""))
def _(ws):
    return rounded(native_cells(ws).drop("null_mesr", "null_scored"))


@registry.add("o5_oracle_bound", Q.query(CELLS, """
SELECT b.dataset, b.recording_id, m.method, CAST(sum(least(coalesce(a_b, 0), sg)) AS BIGINT) AS bound FROM (
  SELECT dataset, recording_id, event_idx // blk AS block, count(*) FILTER (WHERE label = 0) AS sg FROM s GROUP BY ALL) b
  CROSS JOIN (VALUES ('fa'), ('fb'), ('fc')) m(method) LEFT JOIN ab a
  ON b.dataset = a.dataset AND b.recording_id = a.recording_id AND b.block = a.block AND a.method = m.method GROUP BY ALL"""))
def _(ws):
    return per_corpus(lambda c: oracle.oracle_bound(ws.stream(c), MASKS, c.slice_size, c.block))


@registry.add("o6_reversal_summary", Q.query(CELLS, """
SELECT dataset, method, count(*) FILTER (WHERE scored > 0) AS cells, count(*) FILTER (WHERE scored = 0) AS unevaluable,
  count(*) FILTER (WHERE label_class = 'strict') AS strict, count(*) FILTER (WHERE label_class = 'strict' AND mesr_win) AS reversals,
  count(*) FILTER (WHERE label_class = 'tie') AS tie, count(*) FILTER (WHERE label_class = 'impossible') AS impossible
FROM cell GROUP BY GROUPING SETS ((dataset, method), (dataset))"""))
def _(ws):
    return oracle.reversal_summary(native_cells(ws))


@registry.add("o7_widest_filter_gap", Q.query([*CELLS, """
gaps AS (SELECT a.dataset, a.method AS a, b.method AS b, avg(a.mesr - b.mesr) AS diff, count(*) AS n_recordings FROM cell a JOIN cell b
  ON b.dataset = a.dataset AND b.recording_id = a.recording_id AND a.method < b.method WHERE a.mesr IS NOT NULL AND b.mesr IS NOT NULL GROUP BY ALL)"""], """
SELECT dataset, round(abs(diff), 9) AS gap, CASE WHEN diff >= 0 THEN a ELSE b END AS higher, CASE WHEN diff >= 0 THEN b ELSE a END AS lower, n_recordings
FROM gaps QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY round(abs(diff), 12) DESC, a, b) = 1"""))
def _(ws):
    return rounded(oracle.widest_filter_gap(native_cells(ws)))


@registry.add("o8_purity_points", Q.query(CELLS, """
SELECT dataset, recording_id, method, round(tp / CAST(scored AS DOUBLE), 9) AS purity, round(oracle_tp / CAST(scored AS DOUBLE), 9) AS oracle_purity,
  round(mesr - oracle_mesr, 9) AS margin FROM cell WHERE scored > 0"""))
def _(ws):
    return rounded(native_cells(ws).where("scored > 0").select(
        "dataset", KEY, "method", (F.col("tp") / F.col("scored")).alias("purity"),
        (F.col("oracle_tp") / F.col("scored")).alias("oracle_purity"),
        (F.col("mesr") - F.col("oracle_mesr")).alias("margin")))


@registry.add("o10_native_against_null", Q.query([*CELLS, *Q.mesr_ctes("s", "w", "dataset, recording_id")], """
SELECT dataset, recording_id, method, scored, round(c.mesr, 9) AS mesr, round(null_mesr, 9) AS null_mesr, round(c.mesr - w.mesr, 9) AS delta_over_raw,
  round(null_mesr - w.mesr, 9) AS null_delta_over_raw, round(c.mesr - null_mesr, 9) AS filter_minus_null
FROM cell c JOIN w USING (dataset, recording_id) WHERE scored > 0"""))
def _(ws):
    return rounded(native_contrasts(ws).select(
        "dataset", KEY, "method", "scored", "mesr", "null_mesr", "delta_over_raw",
        "null_delta_over_raw", "filter_minus_null"))


def native_contrasts(ws) -> DataFrame:
    raw = ws.curve().where("method = 'raw' AND r_pct = 100").select("dataset", KEY, "scene", "raw_mesr")
    return native_cells(ws).where("scored > 0").join(raw, ["dataset", KEY]).withColumns({
        "delta_over_raw": F.col("mesr") - F.col("raw_mesr"),
        "null_delta_over_raw": F.col("null_mesr") - F.col("raw_mesr"),
        "filter_minus_null": F.col("mesr") - F.col("null_mesr")})


CONTRAST = [*CELLS, *Q.mesr_ctes("s", "w", "dataset, recording_id"), """
con AS (SELECT c.dataset, c.recording_id, c.method, sc.scene, k.contrast, CASE k.contrast WHEN 'delta_over_raw' THEN c.mesr - w.mesr
  WHEN 'null_delta_over_raw' THEN null_mesr - w.mesr ELSE c.mesr - null_mesr END AS v, native_retention
  FROM cell c JOIN w USING (dataset, recording_id) JOIN (SELECT DISTINCT dataset, recording_id, scene FROM s) sc USING (dataset, recording_id)
  CROSS JOIN (VALUES ('delta_over_raw'), ('null_delta_over_raw'), ('filter_minus_null')) k(contrast) WHERE scored > 0)"""]


def boot_ctes(source: str, out: str, keys: str, value: str, cluster: str, draws: int = DRAWS,
              seed: int = Q.SEED, alpha: str = "0.05") -> list[str]:
    """CTEs of the cluster bootstrap with md5 picks."""
    return [
        f"""{out}_s AS (SELECT {keys}, {cluster} AS cl, sum({value}) AS sm, count(*) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL)""",
        f"""{out}_k AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY cl) - 1 AS slot, count(*) OVER (PARTITION BY {keys}) AS k FROM {out}_s)""",
        f"""{out}_p AS (SELECT k, d AS draw, slot, {Q.word(str(seed), 'd', 'slot')} % k AS pick FROM (SELECT DISTINCT k, slot FROM {out}_k WHERE k >= 2) CROSS JOIN range(0, {draws}) t(d))""",
        f"""{out}_m AS (SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, draw, sum(sm) / sum(n) AS m FROM {out}_k s JOIN {out}_p p ON s.k = p.k AND s.slot = p.pick GROUP BY ALL)""",
        f"""{out}_b AS (SELECT {keys}, quantile_cont(m, {alpha} / 2) AS lo, quantile_cont(m, 1 - {alpha} / 2) AS hi FROM {out}_m GROUP BY {keys})""",
        f"""{out} AS (SELECT h.*, lo, hi, coalesce(lo > 1e-12 OR hi < -1e-12, false) AS excludes_zero FROM (SELECT {keys}, sum(sm) / sum(n) AS mean, CAST(sum(n) AS BIGINT) AS n,
           count(*) AS n_clusters FROM {out}_s GROUP BY {keys}) h LEFT JOIN {out}_b USING ({keys}))""",
    ]


@registry.add("o11_native_marginals", Q.query([*CONTRAST, *boot_ctes("con", "bt", "dataset, method, contrast", "v", "scene")], """
SELECT dataset, method, contrast, round(mean, 9) AS mean, round(lo, 9) AS lo, round(hi, 9) AS hi, n, n_clusters, excludes_zero FROM bt"""))
def _(ws):
    long = native_contrasts(ws).unpivot(["dataset", KEY, "scene", "method"],
                                        ["delta_over_raw", "null_delta_over_raw", "filter_minus_null"],
                                        "contrast", "v")
    return rounded(resample.cluster_bootstrap(long, ["dataset", "method", "contrast"], "v", "scene",
                                              DRAWS, algorithm="md5"))


@registry.add("o11_native_census", Q.query([*CELLS], """
SELECT dataset, method, count(*) FILTER (WHERE scored > 0) AS evaluable, count(*) FILTER (WHERE scored = 0) AS unevaluable,
  round(avg(native_retention) FILTER (WHERE scored > 0), 9) AS native_retention_mean,
  count(*) FILTER (WHERE mesr > null_mesr) AS filter_above_null FROM cell GROUP BY ALL"""))
def _(ws):
    on = F.col("scored") > 0
    return rounded(native_cells(ws).groupBy("dataset", "method").agg(
        F.count_if(on).alias("evaluable"), F.count_if(~on).alias("unevaluable"),
        F.avg(F.when(on, F.col("native_retention"))).alias("native_retention_mean"),
        F.count_if(F.col("mesr") > F.col("null_mesr")).alias("filter_above_null")))


MASK_CMP = """mk AS (SELECT s.*, m.method, CASE m.method WHEN 'fa' THEN fa WHEN 'fb' THEN fb ELSE fc END AS acc FROM s CROSS JOIN (VALUES ('fa'), ('fb'), ('fc')) m(method)),
sh AS (SELECT dataset, recording_id, method, avg(CASE WHEN acc THEN 1.0 ELSE 0.0 END) AS native FROM mk GROUP BY ALL),
tgt AS (SELECT *, {share} AS share FROM sh),
ev2 AS (SELECT mk.*, share, row_number() OVER (PARTITION BY dataset, recording_id, method, event_idx // blk ORDER BY CASE WHEN acc THEN 0 ELSE 1 END, event_idx) AS rk,
  count(*) OVER (PARTITION BY dataset, recording_id, method, event_idx // blk) AS n_b FROM mk JOIN tgt USING (dataset, recording_id, method)),
bl AS (SELECT dataset, recording_id, method, event_idx // blk AS block, any_value(blk) AS blk, any_value(n_b) AS n_b, count(*) FILTER (WHERE acc) AS a_b,
  any_value(greatest(1, round_even(n_b * share, 0))) AS k_b, count(*) FILTER (WHERE acc <> (rk <= greatest(1, round_even(n_b * share, 0)))) AS d FROM ev2 GROUP BY ALL),
cmp AS (SELECT dataset, recording_id, method, CAST(sum(n_b) AS BIGINT) AS n_events, count(*) AS n_blocks, CAST(sum(a_b) AS BIGINT) AS native_kept, CAST(sum(k_b) AS BIGINT) AS swept_kept,
  CAST(sum(d) AS BIGINT) AS symmetric_difference, sum(d) / CAST(greatest(1, sum(a_b)) AS DOUBLE) AS symmetric_difference_share, CAST(sum(abs(a_b - k_b)) AS BIGINT) AS predicted_by_block_identity,
  count(*) FILTER (WHERE k_b > a_b) AS blocks_reintroducing_rejects, avg(a_b) / any_value(blk) AS accept_mean, stddev_pop(a_b) / any_value(blk) AS accept_sd,
  min(a_b) / CAST(any_value(blk) AS DOUBLE) AS accept_min, max(a_b) / CAST(any_value(blk) AS DOUBLE) AS accept_max FROM bl GROUP BY ALL)"""
EXACT = MASK_CMP.format(share="native")
NEAR = MASK_CMP.format(share="least(1.0, greatest(0.05, ceil(round(native * 20 - 0.5, 12)) / 20))")
CMP_COLS = ", ".join(f"round({c}, 9) AS {c}" if c.startswith("accept") or c.endswith("share") else c for c in (
    "dataset", "recording_id", "method", "n_events", "n_blocks", "native_kept", "swept_kept", "symmetric_difference",
    "symmetric_difference_share", "predicted_by_block_identity", "blocks_reintroducing_rejects", "accept_mean",
    "accept_sd", "accept_min", "accept_max"))


def _mask_shares(c, ws, near: bool):
    s = ws.stream(c)
    rates = s.groupBy(KEY).agg(*[F.avg(F.col(m).cast("double")).alias(f"nat_{m}") for m in MASKS])
    tagged = attach(s, rates, [KEY], name="rates")
    if not near:
        return tagged, {m: F.col(f"nat_{m}") for m in MASKS}
    # nearest grid point, the smaller one on a tie
    snap = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.ceil(F.round(v * 20 - 0.5, 12)) / 20))
    return tagged, {m: snap(F.col(f"nat_{m}")) for m in MASKS}


def _compare(ws, near: bool) -> DataFrame:
    def one(c):
        tagged, shares = _mask_shares(c, ws, near)
        return oracle.compare_masks(tagged, MASKS, shares, c.block)
    return per_corpus(one)


@registry.add("o12_masks_at_native", Q.query([*Q.STREAMS, EXACT], f"SELECT {CMP_COLS} FROM cmp"))
def _(ws):
    return rounded(_compare(ws, False))


@registry.add("o12_masks_at_grid", Q.query([*Q.STREAMS, NEAR], f"SELECT {CMP_COLS} FROM cmp"))
def _(ws):
    return rounded(_compare(ws, True))


@registry.add("o13_native_mask_survey", Q.query([*Q.STREAMS, EXACT,
    "cmp_x AS (SELECT * FROM cmp)",
    NEAR.replace("mk AS", "mk2 AS").replace("FROM mk ", "FROM mk2 ").replace("mk.*", "mk2.*").replace("sh AS", "sh2 AS").replace("FROM sh)", "FROM sh2)")
        .replace("tgt AS", "tgt2 AS").replace("JOIN tgt ", "JOIN tgt2 ").replace("ev2 AS", "ev3 AS").replace("FROM ev2 ", "FROM ev3 ").replace("bl AS", "bl2 AS")
        .replace("FROM bl ", "FROM bl2 ").replace("cmp AS", "cmp2 AS")], """
SELECT x.dataset, count(*) AS cells, count(*) FILTER (WHERE abs(t.share - t.native) <= 0.05 + 1e-9 AND abs(t.share - t.native) <= 0.5 * t.native + 1e-12) AS eligible,
  round(median(x.symmetric_difference_share), 9) AS exact_median, round(max(x.symmetric_difference_share), 9) AS exact_max,
  count(*) FILTER (WHERE x.symmetric_difference_share = 0) AS exact_recoveries, round(median(g.symmetric_difference_share), 9) AS grid_median,
  round(max(g.symmetric_difference_share), 9) AS grid_max, bool_and(x.symmetric_difference = x.predicted_by_block_identity) AS identity_holds
FROM cmp_x x JOIN cmp2 g USING (dataset, recording_id, method) JOIN tgt2 t USING (dataset, recording_id, method) GROUP BY ALL"""))
def _(ws):
    native = ws.native().where(F.col("method").isin(MASKS))
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.ceil(
        F.round(F.col("native_retention") * 20 - 0.5, 12)) / 20))
    ok = native.select("dataset", KEY, "method", oracle.eligible(F.col("native_retention"), near).alias("eligible"))
    grid = _compare(ws, True).join(ok, ["dataset", KEY, "method"])
    return rounded(oracle.mask_survey(_compare(ws, False), grid))


@registry.add("o14_reversal_tolerance", Q.query([*CELLS, "rev AS (SELECT c.*, sc.scene FROM cell c JOIN (SELECT DISTINCT dataset, recording_id, scene FROM s) sc USING (dataset, recording_id) WHERE mesr_win AND label_class = 'strict')"], """
SELECT dataset, scene, count(*) AS reversals, round(min(1 - tp / CAST(oracle_tp AS DOUBLE)), 9) AS tolerance_min, round(median(1 - tp / CAST(oracle_tp AS DOUBLE)), 9) AS tolerance_median,
  round(min((oracle_tp - tp) / CAST(scored AS DOUBLE)), 9) AS deficit_min, round(max((oracle_tp - tp) / CAST(scored AS DOUBLE)), 9) AS deficit_max,
  round(median(mesr - oracle_mesr), 9) AS margin_median, round(max(mesr - oracle_mesr), 9) AS margin_max FROM rev GROUP BY ALL"""))
def _(ws):
    scenes = ws.recordings().select("dataset", KEY, "scene")
    rev = native_cells(ws).where("mesr_win AND label_class = 'strict'").join(scenes, ["dataset", KEY])
    tol = 1 - F.col("tp") / F.col("oracle_tp")
    deficit = (F.col("oracle_tp") - F.col("tp")) / F.col("scored")
    margin = F.col("mesr") - F.col("oracle_mesr")
    return rounded(rev.groupBy("dataset", "scene").agg(
        F.count("*").alias("reversals"), F.min(tol).alias("tolerance_min"),
        F.percentile(tol, F.lit(0.5)).alias("tolerance_median"), F.min(deficit).alias("deficit_min"),
        F.max(deficit).alias("deficit_max"), F.percentile(margin, F.lit(0.5)).alias("margin_median"),
        F.max(margin).alias("margin_max")))


SPEAR = """{o} AS (SELECT {k}, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS rho FROM (
  SELECT *, rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY {k} ORDER BY {y}) + (count(*) OVER (PARTITION BY {k}, {y}) - 1) / 2.0 AS ry
  FROM {t} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {k})"""


@registry.add("o15_native_rank_correlation", Q.query([*CONTRAST,
    "ok AS (SELECT dataset, native_retention AS nr, v AS dl FROM con WHERE contrast = 'delta_over_raw')",
    SPEAR.format(o="sp", k="dataset", x="nr", y="dl", t="ok")], "SELECT dataset, n, round(rho, 9) AS rho FROM sp"))
def _(ws):
    return rounded(ranks.spearman(native_contrasts(ws), ["dataset"], "native_retention", "delta_over_raw"))


# --- label quality over the grid -------------------------------------------------------------

PAIRS = """gp AS (SELECT c.*, o.mesr AS oracle_mesr, o.tp AS oracle_tp, o.scored_tp AS oracle_tp_scored, o.kept_events AS oracle_kept, o.scored_events AS oracle_scored,
  c.mesr - o.mesr > 1e-12 AS mesr_win, CASE WHEN c.scored_tp < o.scored_tp THEN 'strict' WHEN c.scored_tp = o.scored_tp THEN 'tie' ELSE 'impossible' END AS label_class,
  CASE WHEN c.tp < o.tp THEN 'strict' WHEN c.tp = o.tp THEN 'tie' ELSE 'impossible' END AS label_class_full_mask, c.scored_events / CAST(c.kept_events AS DOUBLE) AS scored_fraction
  FROM crv c JOIN crv o ON o.dataset = c.dataset AND o.recording_id = c.recording_id AND o.r_pct = c.r_pct AND o.method = 'label_oracle' AND o.evaluable
  WHERE c.evaluable AND c.method NOT IN ('label_oracle', 'raw', 'random_null'))"""
LABELS = [*Q.FULL, PAIRS]
NULLS = ["raw", "random_null"]


def grid_pairs(ws) -> DataFrame:
    return oracle.grid_pairs(ws.curve(), "label_oracle", NULLS)


@registry.add("o1_label_quality", Q.query(Q.BENCH, """
SELECT dataset, recording_id, method, r_pct, kept_events AS kept, tp, kept_events - tp AS fp, scored_events AS scored, scored_tp AS tp_scored,
  scored_events - scored_tp AS fp_scored, round(scored_events / CAST(kept_events AS DOUBLE), 9) AS scored_fraction FROM crv"""))
def _(ws):
    return rounded(ws.curve().select(
        "dataset", KEY, "method", "r_pct", F.col("kept_events").alias("kept"), "tp",
        (F.col("kept_events") - F.col("tp")).alias("fp"), F.col("scored_events").alias("scored"),
        F.col("scored_tp").alias("tp_scored"), (F.col("scored_events") - F.col("scored_tp")).alias("fp_scored"),
        (F.col("scored_events") / F.col("kept_events")).alias("scored_fraction")))


@registry.add("o2_o3_matched_retention", Q.query(LABELS, """
SELECT dataset, recording_id, method, r_pct, round(mesr, 9) AS mesr, round(oracle_mesr, 9) AS oracle_mesr, mesr_win, label_class, label_class_full_mask,
  kept_events = oracle_kept AND scored_events = oracle_scored AS counts_match FROM gp"""))
def _(ws):
    return rounded(grid_pairs(ws).select("dataset", KEY, "method", "r_pct", "mesr", "oracle_mesr", "mesr_win",
                                         "label_class", "label_class_full_mask", "counts_match"))


TALLY = """count(*) AS cells, count(*) FILTER (WHERE mesr_win) AS mesr_wins, count(*) FILTER (WHERE mesr_win AND label_class = 'strict') AS strict,
  count(*) FILTER (WHERE mesr_win AND label_class = 'tie') AS tie, count(*) FILTER (WHERE mesr_win AND label_class = 'impossible') AS impossible,
  count(*) FILTER (WHERE mesr_win AND label_class_full_mask = 'strict') AS full_strict, count(*) FILTER (WHERE mesr_win AND label_class_full_mask = 'tie') AS full_tie,
  count(*) FILTER (WHERE mesr_win AND label_class_full_mask = 'impossible') AS full_impossible, round(min(scored_fraction), 9) AS fraction_min,
  round(median(scored_fraction), 9) AS fraction_median, round(max(scored_fraction), 9) AS fraction_max"""


@registry.add("o4_tally_all_matched", Q.query(LABELS, f"SELECT dataset, {TALLY} FROM gp GROUP BY dataset"))
def _(ws):
    return rounded(oracle.tally(grid_pairs(ws), "dataset"))


AT_NATIVE = """an AS (SELECT g.*, n.native_retention FROM gp g JOIN nat n USING (dataset, recording_id, method)
  QUALIFY row_number() OVER (PARTITION BY dataset, recording_id, method ORDER BY round(abs(g.r_pct / 100.0 - n.native_retention), 12), g.r_pct) = 1),
anok AS (SELECT * FROM an WHERE abs(r_pct / 100.0 - native_retention) <= 0.05 + 1e-9 AND abs(r_pct / 100.0 - native_retention) <= 0.5 * native_retention + 1e-12)"""


def at_native(ws) -> DataFrame:
    """Grid cells nearest each method's own retention, where that is near enough."""
    cells = grid_pairs(ws).join(ws.native(), ["dataset", KEY, "method"])
    extra = [c for c in grid_pairs(ws).columns if c not in ("dataset", KEY, "method", "r_pct")]
    near = oracle.nearest_point(cells, ["dataset", KEY, "method"], "native_retention", extra)
    return near.where(oracle.eligible(F.col("native_retention"), F.col("r_pct") / 100.0))


@registry.add("o4_tally_at_native", Q.query([*LABELS, AT_NATIVE], f"""
SELECT dataset, method, {TALLY} FROM anok GROUP BY GROUPING SETS ((dataset, method), (dataset))"""))
def _(ws):
    cells = at_native(ws)
    total = oracle.tally(cells, "dataset").withColumn("method", F.lit(None).cast("string"))
    return rounded(oracle.tally(cells, "dataset", "method").unionByName(total))


@registry.add("o4_any_win", Q.query(LABELS, """
SELECT dataset, count(*) AS pairs, count(*) FILTER (WHERE w) AS pairs_with_a_win FROM (
  SELECT dataset, recording_id, method, bool_or(mesr_win) AS w FROM gp GROUP BY ALL) GROUP BY ALL"""))
def _(ws):
    return grid_pairs(ws).groupBy("dataset", KEY, "method").agg(F.bool_or("mesr_win").alias("w")).groupBy(
        "dataset").agg(F.count("*").alias("pairs"), F.count_if("w").alias("pairs_with_a_win"))


@registry.add("o4_largest_deficit", Q.query([*LABELS, AT_NATIVE], """
SELECT dataset, round(max((oracle_tp - tp) / CAST(t.n_signal AS DOUBLE)), 9) AS largest_deficit, round(max(mesr - oracle_mesr), 9) AS max_margin
FROM anok JOIN (SELECT dataset, recording_id, count(*) FILTER (WHERE label = 0) AS n_signal FROM s GROUP BY ALL) t USING (dataset, recording_id)
WHERE mesr_win AND label_class = 'strict' GROUP BY dataset"""))
def _(ws):
    signal = ws.curve().where("r_pct = 100 AND method = 'raw'").select("dataset", KEY, F.col("tp").alias("n_signal"))
    strict = at_native(ws).where("mesr_win AND label_class = 'strict'").join(signal, ["dataset", KEY])
    return rounded(strict.groupBy("dataset").agg(
        F.max((F.col("oracle_tp") - F.col("tp")) / F.col("n_signal")).alias("largest_deficit"),
        F.max(F.col("mesr") - F.col("oracle_mesr")).alias("max_margin")))
