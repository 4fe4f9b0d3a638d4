"""Queries on slicing, quotas, projections and filters, and on the metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import div, kept_total
from ..operators import metric, order, regime
from ..schema import RETENTION_PCT
from ..sources.tables import CORPORA, EVENT_STREAM, Workspace, read
from ..staging import attach
from .base import Registry, rounded
from . import sql as Q

registry = Registry()
KEY = "recording_id"


def per_corpus(build) -> DataFrame:
    """Union of a job over both corpora, tagged with the data set."""
    parts = [build(c).withColumn("dataset", F.lit(c.name)) for c in CORPORA]
    return parts[0].unionByName(parts[1])


@registry.add("p1_slice_assignment", Q.query(Q.STREAMS, """
SELECT dataset, recording_id, event_idx // nsl AS slice, min(event_idx) AS first_idx, max(event_idx) AS last_idx
FROM s GROUP BY ALL HAVING count(*) = any_value(nsl)"""))
def _(ws: Workspace) -> DataFrame:
    return per_corpus(lambda c: ws.stream(c).groupBy(
        KEY, div("event_idx", c.slice_size).alias("slice")).agg(
        F.min("event_idx").alias("first_idx"), F.max("event_idx").alias("last_idx"),
        F.count("*").alias("n")).where(F.col("n") == c.slice_size).drop("n"))


@registry.add("p2_block_assignment", Q.query(Q.STREAMS, """
SELECT dataset, recording_id, event_idx // blk AS block, count(*) AS n_b FROM s GROUP BY ALL"""))
def _(ws):
    return per_corpus(lambda c: ws.stream(c).groupBy(
        KEY, order.block_of(c.block).alias("block")).agg(F.count("*").alias("n_b")))


@registry.add("p3_block_quota_retention", Q.query([*Q.STREAMS, Q.GRID], """
SELECT dataset, recording_id, count(*) AS kept, sum(event_idx % 1000003) AS idx_sum, round(sum(sc), 4) AS score_sum FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, recording_id, event_idx // blk ORDER BY sc, event_idx) AS rk,
         count(*) OVER (PARTITION BY dataset, recording_id, event_idx // blk) AS n_b FROM s)
WHERE rk <= greatest(1, round_even(n_b * CAST(0.35 AS DOUBLE), 0)) GROUP BY ALL""").replace(
    "sum(event_idx % 1000003)", "CAST(sum(event_idx % 1000003) AS BIGINT)"))
def _(ws):
    return per_corpus(lambda c: metric.retain(ws.stream(c), F.col("sc"), 0.35, c.block).groupBy(KEY).agg(
        F.count("*").alias("kept"), F.sum(F.col("event_idx") % 1000003).alias("idx_sum"),
        F.round(F.sum("sc"), 4).alias("score_sum")))


@registry.add("p4_block_quota_table", Q.query([*Q.STREAMS, Q.GRID], """
SELECT dataset, recording_id, block, r_pct, CAST(greatest(1, round_even(n_b * r, 0)) AS INTEGER) AS k_b
FROM (SELECT dataset, recording_id, event_idx // blk AS block, count(*) AS n_b FROM s GROUP BY ALL) CROSS JOIN grid"""))
def _(ws):
    return per_corpus(lambda c: order.quota_table(ws.stream(c), RETENTION_PCT, c.block))


@registry.add("p5_block_accept_counts", Q.query(Q.STREAMS, """
SELECT dataset, recording_id, event_idx // blk AS block, count(*) FILTER (WHERE fa) AS fa,
  count(*) FILTER (WHERE fb) AS fb, count(*) FILTER (WHERE fc) AS fc FROM s GROUP BY ALL"""))
def _(ws):
    return per_corpus(lambda c: order.block_counts(ws.stream(c), ["fa", "fb", "fc"], c.block))


@registry.add("p6_available_signal", Q.query(Q.STREAMS, """
SELECT dataset, recording_id, event_idx // blk AS block, count(*) FILTER (WHERE label = 0) AS signal FROM s GROUP BY ALL"""))
def _(ws):
    return per_corpus(lambda c: order.block_counts(
        ws.stream(c).withColumn("signal", F.col("label") == 0), ["signal"], c.block))


PREFIX_SQL = """kept AS (SELECT dataset, recording_id, method, event_idx, nsl, label,
  row_number() OVER (PARTITION BY dataset, recording_id, method ORDER BY event_idx) - 1 AS j,
  count(*) OVER (PARTITION BY dataset, recording_id, method) AS kept_total FROM (
    SELECT *, 'fa' AS method FROM s WHERE fa UNION ALL SELECT *, 'fb' FROM s WHERE fb
    UNION ALL SELECT *, 'fc' FROM s WHERE fc))"""


@registry.add("p7_scored_prefix", Q.query([*Q.STREAMS, PREFIX_SQL], """
SELECT dataset, recording_id, method, any_value(kept_total) AS kept, count(*) AS scored,
  max(event_idx) AS last_idx FROM kept WHERE j < kept_total // nsl * nsl GROUP BY ALL"""))
def _(ws):
    return per_corpus(lambda c: order.scored_prefix(ws.stream(c), ["fa", "fb", "fc"], c.slice_size, c.block)
                      .groupBy(KEY, "method").agg(
                          F.first("kept").alias("kept"), F.count("*").alias("scored"),
                          F.max("event_idx").alias("last_idx")))


@registry.add("p8_scored_span", Q.query([*Q.STREAMS, PREFIX_SQL], """
SELECT k.dataset, k.recording_id, method, round((max(event_idx) + 1) / CAST(any_value(n) AS DOUBLE), 9) AS span
FROM kept k JOIN (SELECT dataset, recording_id, count(*) AS n FROM s GROUP BY ALL) t
  ON t.dataset = k.dataset AND t.recording_id = k.recording_id
WHERE j < kept_total // nsl * nsl GROUP BY ALL"""))
def _(ws):
    return per_corpus(lambda c: rounded(order.scored_span(
        ws.stream(c), ["fa", "fb", "fc"], c.slice_size, c.block)))


@registry.add("p9_matched_frame", Q.query([*Q.STREAMS, Q.GRID], """
SELECT dataset, recording_id, r_pct, CAST(step * (n // step) AS BIGINT) AS frame FROM (
  SELECT dataset, recording_id, r_pct, n, nsl * (100 // gcd(r_pct, 100)) AS step
  FROM (SELECT dataset, recording_id, nsl, count(*) AS n FROM s GROUP BY ALL) CROSS JOIN grid) WHERE r_pct < 100"""))
def _(ws):
    return per_corpus(lambda c: order.frames(ws.stream(c), [p for p in RETENTION_PCT if p < 100], c.slice_size))


@registry.add("p10_declared_sensor", Q.query([*Q.STREAMS,
    """inside AS (SELECT s.*, d.method FROM s JOIN (VALUES (32, 24, 's32x24'), (48, 40, 's48x40'), (64, 48, 's64x48'), (4096, 4096, 's4096x4096'))
       d(w, h, method) ON x < w AND y < h)""", *Q.mesr_ctes("inside", "m", "dataset, recording_id, method")], """
SELECT dataset, recording_id, method, round(mesr, 9) AS mesr, slices FROM m"""))
def _(ws):
    return per_corpus(lambda c: rounded(metric.declared_sensor(
        ws.stream(c), [(32, 24), (48, 40), (64, 48), (4096, 4096)], c.slice_size)))


@registry.add("p11_time_windows", Q.query([Q.EV], """
SELECT recording_id, win, count(*) AS n FROM (
  SELECT recording_id, (t_us - min(t_us) OVER (PARTITION BY recording_id)) // 3600000000 AS win FROM ev)
GROUP BY ALL HAVING count(*) >= 2"""))
def _(ws):
    return (order.with_time_window(ws.stream(EVENT_STREAM), 3_600_000_000)
            .groupBy(KEY, "win").agg(F.count("*").alias("n")).where(F.col("n") >= 2))


def shuffle_sql(window: str, seed: int = 7) -> str:
    return f"""SELECT a.dataset, a.recording_id, CAST(sum((a.event_idx % 1000003) * (b.event_idx % 1000003) % 1000003) AS BIGINT) AS moved,
  CAST(sum((a.event_idx % 1000003) * (b.x + 64 * b.y)) AS BIGINT) AS marks, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY dataset, recording_id, {window} ORDER BY event_idx) AS rk FROM s) a
JOIN (SELECT *, row_number() OVER (PARTITION BY dataset, recording_id, {window} ORDER BY
      {Q.prio(str(seed), 'recording_id', 'event_idx')}, event_idx) AS rk FROM s) b
ON a.dataset = b.dataset AND a.recording_id = b.recording_id AND a.rk = b.rk AND {window.replace('event_idx', 'a.event_idx')} = {window.replace('event_idx', 'b.event_idx')}
GROUP BY ALL"""


def shuffled_digest(ws, window):
    def one(c):
        s = ws.stream(c)
        moved = order.shuffle_marks(s, window, 7, ["x", "y", "event_idx"], algorithm="md5")
        return moved.groupBy(KEY).agg(
            F.sum((F.col("event_idx") % 1000003) * (F.col("event_idx_shuffled") % 1000003) % 1000003).alias("moved"),
            F.sum((F.col("event_idx") % 1000003) * (F.col("x_shuffled") + 64 * F.col("y_shuffled"))).alias("marks"),
            F.count("*").alias("n"))
    return per_corpus(one)


@registry.add("p12_mark_shuffle_window", Q.query(Q.STREAMS, shuffle_sql("event_idx // 100")))
def _(ws):
    return shuffled_digest(ws, 100)


@registry.add("p12_mark_shuffle_whole", Q.query(Q.STREAMS, shuffle_sql("event_idx // 100000000000")))
def _(ws):
    return shuffled_digest(ws, None)


HOT = """hot AS (SELECT *, n >= quantile_cont(n, 0.99) OVER (PARTITION BY dataset, recording_id) AS is_hot FROM (
  SELECT dataset, recording_id, x, y, count(*) AS n FROM s GROUP BY ALL))"""


@registry.add("p13_hot_pixel_mask", Q.query([*Q.STREAMS, HOT],
    "SELECT dataset, recording_id, x, y, n FROM hot WHERE is_hot"))
def _(ws):
    return per_corpus(lambda c: regime.hot_pixels(ws.stream(c), 99.0).where("is_hot").select(KEY, "x", "y", "n"))


@registry.add("p14_hot_pixel_removal", Q.query([*Q.STREAMS, HOT], """
SELECT dataset, recording_id, CAST(sum(n) AS BIGINT) AS events_before,
  CAST(coalesce(sum(n) FILTER (WHERE is_hot), 0) AS BIGINT) AS events_removed,
  round(coalesce(sum(n) FILTER (WHERE is_hot), 0) / CAST(sum(n) AS DOUBLE), 9) AS share_removed,
  count(*) FILTER (WHERE is_hot) AS hot_pixels, count(*) AS occupied_pixels,
  count(*) FILTER (WHERE NOT is_hot) > 0 AS applied,
  CAST(CASE WHEN count(*) FILTER (WHERE NOT is_hot) > 0 THEN sum(n) FILTER (WHERE NOT is_hot) ELSE sum(n) END AS BIGINT) AS events_after
FROM hot GROUP BY ALL"""))
def _(ws):
    return per_corpus(lambda c: rounded(regime.hot_removal_report(regime.hot_pixels(ws.stream(c), 99.0))))


@registry.add("p14_hot_pixel_removed_mesr", Q.query([*Q.STREAMS, HOT,
    "cold AS (SELECT s.* FROM s JOIN hot USING (dataset, recording_id, x, y) WHERE NOT is_hot)",
    *Q.mesr_ctes("cold", "m", "dataset, recording_id")],
    "SELECT dataset, recording_id, round(mesr, 9) AS mesr, slices FROM m"))
def _(ws):
    return per_corpus(lambda c: rounded(metric.mesr_unfiltered(
        regime.remove_hot_pixels(ws.stream(c), 99.0, c.block), c.slice_size)))


@registry.add("p15_threshold_mask", Q.query(Q.STREAMS, """
SELECT dataset, recording_id, count(*) AS events, count(*) FILTER (WHERE score <> 2.0) AS scored,
  count(*) FILTER (WHERE score < 0.005) AS kept FROM (
  SELECT dataset, recording_id, CASE WHEN event_idx % 50 = 0 THEN 2.0
     ELSE CAST(sc AS DOUBLE) / 10000 END AS score FROM s) GROUP BY ALL"""))
def _(ws):
    return ws.both().withColumn("score", F.when(F.col("event_idx") % 50 == 0, 2.0).otherwise(
        F.col("sc") / 10000)).groupBy("dataset", KEY).agg(
        F.count("*").alias("events"), F.count_if(F.col("score") != 2.0).alias("scored"),
        F.count_if(order.released_mask("score")).alias("kept"))


@registry.add("p16_min_max_normalise", Q.query(Q.STREAMS, """
SELECT dataset, recording_id, round(avg(u), 9) AS mean_t, round(avg(CASE WHEN u < 0.5 THEN 1.0 ELSE 0.0 END), 9) AS first_half FROM (
  SELECT dataset, recording_id, (t_us - min(t_us) OVER w) / CAST(max(t_us) OVER w - min(t_us) OVER w AS DOUBLE) AS u
  FROM s WINDOW w AS (PARTITION BY dataset, recording_id)) GROUP BY ALL"""))
def _(ws):
    return rounded(order.min_max_normalise(ws.both(), ["dataset", KEY], "t_us").groupBy("dataset", KEY).agg(
        F.avg("t_us_norm").alias("mean_t"),
        F.avg((F.col("t_us_norm") < 0.5).cast("double")).alias("first_half")))


@registry.add("p20_scene_parsing", Q.query([], "").replace("WITH \n", "") + """
SELECT name, CASE WHEN regexp_matches(name, '^corpus/part/S[0-9]+-ND[0-9]+-[0-9]+$') THEN regexp_extract(name, '^corpus/part/(S[0-9]+)-', 1) ELSE name END AS scene,
  regexp_extract(name, '-ND([0-9]+)-', 1) AS level, split_part(name, '/', 1) AS corpus, n FROM (
SELECT concat('corpus/part/S', l_suppkey % 10, '-ND', l_linenumber % 4, '-', l_partkey % 3) AS name, count(*) AS n
FROM lineitem GROUP BY ALL)""")
def _(ws):
    name = F.concat(F.lit("corpus/part/S"), F.col("l_suppkey") % 10, F.lit("-ND"),
                    F.col("l_linenumber") % 4, F.lit("-"), F.col("l_partkey") % 3)
    names = read(ws.spark, ws.sf_dir, "lineitem").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return names.select(
        "name", order.scene_of("name", [(r"^corpus/part/(S[0-9]+)-ND[0-9]+-[0-9]+$", 1)]).alias("scene"),
        F.regexp_extract("name", r"-ND([0-9]+)-", 1).alias("level"),
        F.split_part("name", F.lit("/"), F.lit(1)).alias("corpus"), "n")


@registry.add("m1_pixel_counts", Q.query(Q.STREAMS, """
SELECT dataset, recording_id, event_idx // nsl AS slice, x, y, count(*) AS n FROM s GROUP BY ALL"""))
def _(ws):
    return per_corpus(lambda c: metric.pixel_counts(
        ws.stream(c).withColumn("slice", div("event_idx", c.slice_size)), [KEY, "slice"]))


WHOLE = [*Q.STREAMS, *Q.mesr_ctes("s", "m", "dataset, recording_id")]


@registry.add("m2_esr_per_slice", Q.query(WHOLE, """
SELECT dataset, recording_id, slice, CAST(ne AS BIGINT) AS n_events, occ AS occupied_px, round(ntss, 9) AS ntss,
  round(ln, 9) AS ln, round(sqrt(ntss * ln), 9) AS esr FROM m_s WHERE ne = nsl"""))
def _(ws):
    return per_corpus(lambda c: rounded(metric.esr_per_slice(
        ws.stream(c).withColumn("slice", div("event_idx", c.slice_size)), [KEY], c.slice_size)))


@registry.add("m3_mesr", Q.query(WHOLE, """
SELECT dataset, recording_id, round(mesr, 9) AS mesr, slices FROM m"""))
def _(ws):
    return per_corpus(lambda c: rounded(metric.mesr_unfiltered(ws.stream(c), c.slice_size)))


@registry.add("m3_mesr_of_masks", Q.query([*Q.STREAMS,
    """k AS (SELECT *, 'fa' AS method FROM s WHERE fa UNION ALL SELECT *, 'fb' FROM s WHERE fb UNION ALL SELECT *, 'fc' FROM s WHERE fc)""",
    *Q.mesr_ctes("k", "m", "dataset, recording_id, method")], """
SELECT dataset, recording_id, method, round(mesr, 9) AS mesr, slices FROM m"""))
def _(ws):
    return per_corpus(lambda c: rounded(metric.mesr_of_masks(
        ws.stream(c), ["fa", "fb", "fc"], c.slice_size, c.block)))


FIRST = """f AS (SELECT dataset, recording_id, x, y, count(*) AS n FROM s WHERE event_idx < nsl GROUP BY ALL),
d AS (SELECT dataset, recording_id, sum(n) AS nn, count(*) AS occ, sum(n * (n - 1)) AS pairs FROM f GROUP BY ALL),
dec AS (SELECT dataset, recording_id, any_value(nn) AS nn, any_value(occ) AS occ, any_value(pairs) / CAST(any_value(nn * (nn - 1)) AS DOUBLE) AS ntss,
  sum(1 - pow(1 - CAST((2 * nn) // 3 AS DOUBLE) / nn, n)) AS ln FROM f JOIN d USING (dataset, recording_id) GROUP BY ALL)"""


@registry.add("m4_decomposition", Q.query([*Q.STREAMS, FIRST], """
SELECT dataset, recording_id, CAST(nn AS BIGINT) AS n_events, occ AS occupied_px, round(ntss, 9) AS ntss,
  round(ln, 9) AS ln, round(sqrt(ntss * ln), 9) AS esr FROM dec"""))
def _(ws):
    return per_corpus(lambda c: rounded(metric.decompose_first_slice(ws.stream(c), c.slice_size)))


@registry.add("m5_mesr_curve", Q.query(Q.BENCH, """
SELECT dataset, recording_id, method, r_pct, round(mesr, 9) AS mesr, kept_events, evaluable, round(raw_mesr, 9) AS raw_mesr,
  n_events, scored_events, tp, scored_tp, scene FROM crv"""))
def _(ws):
    return rounded(ws.curve())


@registry.add("m5_curve_by_windows", Q.query(Q.BENCH, """
SELECT recording_id, r_pct, round(mesr, 9) AS mesr, kept_events FROM crv
WHERE dataset = 'ev' AND method = 'sc' AND r_pct IN (10, 35, 60, 85)"""))
def _(ws):
    c = EVENT_STREAM
    kept = metric.retained_positions(ws.stream(c).select(KEY, "event_idx", "x", "y", "sc"),
                                     F.col("sc"), [10, 35, 60, 85], c.block)
    per = metric.esr_per_slice(kept.withColumn("slice", div("pos", c.slice_size)), [KEY, "r_pct"], c.slice_size, like=ws.stream(c))
    sizes = ws.stream(c).groupBy(KEY).agg(F.count("*").alias("n"))
    share = F.create_map(*[F.lit(v) for p in (10, 35, 60, 85) for v in (p, p / 100.0)])
    totals = sizes.select(KEY, F.inline(F.array(*[F.struct(
        F.lit(p).alias("r_pct"), kept_total(F.col("n"), p / 100.0, c.block).alias("kept_events"))
        for p in (10, 35, 60, 85)])))
    return rounded(totals.join(per.groupBy(KEY, "r_pct").agg(F.avg("esr").alias("mesr")), [KEY, "r_pct"], "left"))


@registry.add("m6_slice_size_sweep", Q.query([*Q.STREAMS,
    "sizes AS (SELECT unnest([100, 200, 300, 500, 1000]) AS slice_size)",
    """k AS (SELECT s.* EXCLUDE (nsl), z.slice_size AS nsl, z.slice_size, m.method FROM s CROSS JOIN sizes z
       CROSS JOIN (VALUES ('fa'), ('fb'), ('fc')) m(method) WHERE CASE m.method WHEN 'fa' THEN fa WHEN 'fb' THEN fb ELSE fc END)""",
    *Q.mesr_ctes("k", "m", "dataset, recording_id, method, slice_size")], """
SELECT r.dataset, r.recording_id, mm.method, z.slice_size, round(m.mesr, 9) AS mesr
FROM (SELECT DISTINCT dataset, recording_id FROM s) r CROSS JOIN sizes z CROSS JOIN (VALUES ('fa'), ('fb'), ('fc')) mm(method)
LEFT JOIN m ON m.dataset = r.dataset AND m.recording_id = r.recording_id AND m.method = mm.method AND m.slice_size = z.slice_size"""))
def _(ws):
    return per_corpus(lambda c: rounded(metric.slice_size_sweep(
        ws.stream(c), ["fa", "fb", "fc"], [100, 200, 300, 500, 1000], c.block)))


MEDIAN = """cnt AS (SELECT dataset, recording_id, event_idx // nsl AS slice, x, y, any_value(nsl) AS nsl, count(*) AS n FROM s GROUP BY ALL),
spread AS (SELECT dataset, recording_id, slice, x + dx AS x, y + dy AS y, n FROM cnt CROSS JOIN (VALUES (-1), (0), (1)) a(dx)
  CROSS JOIN (VALUES (-1), (0), (1)) b(dy) WHERE x + dx BETWEEN 0 AND 63 AND y + dy BETWEEN 0 AND 47),
med AS (SELECT dataset, recording_id, slice, x, y, list_sort(list(n))[count(*) - 4] AS n FROM spread GROUP BY ALL HAVING count(*) >= 5),
v2 AS (SELECT dataset, recording_id, slice, sum(n * n) AS sq, sum(1 - pow(0.5, n)) AS occ FROM med GROUP BY ALL),
both2 AS (SELECT m_s.dataset, m_s.recording_id, m_s.slice, CAST(ne AS BIGINT) AS n_events, sqrt(ntss * ln) AS esr,
  coalesce(1000 * sqrt(sq / (CAST(ne AS DOUBLE) * ne) * (v2.occ / 3072)), 0) AS esr_v2
  FROM m_s LEFT JOIN v2 USING (dataset, recording_id, slice) WHERE ne = nsl)"""


@registry.add("m13_median_filter_variant", Q.query([*WHOLE, MEDIAN], """
SELECT dataset, recording_id, slice, n_events, round(esr, 9) AS esr, round(esr_v2, 9) AS esr_v2 FROM both2"""))
def _(ws):
    return rounded(_variant(ws))


def _variant(ws):
    sensors = ws.recordings().select(KEY, "width", "height")
    return per_corpus(lambda c: metric.esr_v2(ws.stream(c), sensors, c.slice_size))


@registry.add("m14_variant_survey", Q.query([*WHOLE, MEDIAN,
    "u AS (SELECT *, esr_v2 / esr AS ratio FROM both2 WHERE esr > 0)"], """
SELECT dataset, count(*) AS slices, round(median(ratio), 9) AS ratio_median, round(min(ratio), 9) AS ratio_min,
  round(max(ratio), 9) AS ratio_max, count(*) FILTER (WHERE ratio = 0) AS collapsed,
  round(log10(max(ratio) / min(ratio) FILTER (WHERE ratio > 0)), 9) AS spread_log10, round(1000 / sqrt(3072), 9) AS thousand_over_sqrt_k
FROM u GROUP BY dataset
UNION ALL SELECT 'overall', count(*), round(median(ratio), 9), round(min(ratio), 9), round(max(ratio), 9), count(*) FILTER (WHERE ratio = 0),
  round(log10(max(ratio) / min(ratio) FILTER (WHERE ratio > 0)), 9), NULL FROM u HAVING count(*) > 0"""))
def _(ws):
    pixels = ws.recordings().select(KEY, (F.col("width") * F.col("height")).alias("pixels"))
    return rounded(metric.esr_v2_survey(attach(_variant(ws), pixels, [KEY]), "dataset"))


@registry.add("m15_sensor_occupancy", Q.query([*Q.STREAMS, FIRST], """
SELECT dataset, recording_id, CAST(nn AS BIGINT) AS n_events, occ AS occupied_px, round(ntss, 9) AS ntss, round(ln, 9) AS ln,
  round(sqrt(ntss * ln), 9) AS esr, round(occ / 3072.0, 9) AS occupied_share, round(ln / occ, 9) AS ln_per_occupied FROM dec"""))
def _(ws):
    sensors = ws.recordings().select(KEY, "width", "height")
    return per_corpus(lambda c: rounded(metric.occupancy(ws.stream(c), sensors, c.slice_size)))


@registry.add("m16_permutation_invariance", Q.query([*Q.STREAMS,
    """moved AS (SELECT dataset, recording_id, event_idx, nsl, blk, CAST(((y * 64 + x) * 1021 + 17) % 3072 % 64 AS INTEGER) AS x,
       CAST(((y * 64 + x) * 1021 + 17) % 3072 // 64 AS INTEGER) AS y FROM s)""",
    *Q.mesr_ctes("s", "m", "dataset, recording_id"), *Q.mesr_ctes("moved", "mm", "dataset, recording_id")], """
SELECT dataset, recording_id, round(m.mesr, 9) AS mesr, round(mm.mesr, 9) AS mesr_permuted,
  abs(m.mesr - mm.mesr) < 1e-12 AS invariant FROM m JOIN mm USING (dataset, recording_id)"""))
def _(ws):
    def one(c):
        s = ws.stream(c)
        a = metric.mesr_unfiltered(s, c.slice_size).select(KEY, "mesr")
        b = metric.mesr_unfiltered(metric.permute_pixels(s, 1021, 17, c.width, c.height), c.slice_size)
        return a.join(b.select(KEY, F.col("mesr").alias("mesr_permuted")), KEY).withColumn(
            "invariant", F.abs(F.col("mesr") - F.col("mesr_permuted")) < 1e-12)
    return per_corpus(lambda c: rounded(one(c)))


@registry.add("m16_majorisation", Q.query([*WHOLE,
    "top AS (SELECT dataset, recording_id, slice, x, y, n, nsl FROM m_c)",
    """run AS (SELECT dataset, recording_id, slice, i, sum(n) OVER (PARTITION BY dataset, recording_id, slice ORDER BY i) AS cum FROM (
       SELECT *, row_number() OVER (PARTITION BY dataset, recording_id, slice ORDER BY n DESC, x, y) AS i FROM top))"""], """
SELECT a.dataset, a.recording_id, a.slice, min(a.cum - b.cum) >= 0 AS majorises_next, count(*) AS ranks
FROM run a JOIN run b ON b.dataset = a.dataset AND b.recording_id = a.recording_id AND b.slice = a.slice + 1 AND b.i = a.i
JOIN m_s ma ON ma.dataset = a.dataset AND ma.recording_id = a.recording_id AND ma.slice = a.slice AND ma.ne = ma.nsl
JOIN m_s mb ON mb.dataset = a.dataset AND mb.recording_id = a.recording_id AND mb.slice = a.slice + 1 AND mb.ne = mb.nsl
GROUP BY ALL"""))
def _(ws):
    return per_corpus(lambda c: metric.majorises_next(ws.stream(c), c.slice_size))
