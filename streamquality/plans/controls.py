"""Queries on label-blind controls and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import word
from ..functions.numeric import blind
from ..functions.tails import mcnemar_exact
from ..operators import grid, metric, nulls, regime, resample
from ..schema import RETENTION_PCT, SEED
from ..sources.tables import EVENT_STREAM, read, scores
from . import sql as Q
from .base import Registry, rounded
from .outputs import DRAWS, boot_ctes
from .positions import HOT, per_corpus

registry = Registry()
KEY = "recording_id"
NULLS = ["raw", "random_null"]
SEEDS = [1, 2, 3]
BELOW = [p for p in RETENTION_PCT if p < 100]

DELTA = "dl AS (SELECT *, mesr - raw_mesr AS delta FROM crv WHERE evaluable)"
PROFILE = """pr AS (SELECT dataset, method, r_pct, avg(delta) AS mean, median(delta) AS median, count(*) AS n, count(*) FILTER (WHERE delta > 1e-12) AS n_above_raw
  FROM dl WHERE method IN ('raw', 'random_null') GROUP BY ALL)"""


def points(ws) -> DataFrame:
    return nulls.deltas(ws.curve())


def null_points(ws) -> DataFrame:
    return points(ws).where(F.col("method").isin(NULLS))


@registry.add("n1_fixed_retention_profile", Q.query([*Q.BENCH, DELTA, PROFILE],
    "SELECT dataset, method, r_pct, round(mean, 9) AS mean, round(median, 9) AS median, n, n_above_raw FROM pr"))
def _(ws):
    return rounded(nulls.retention_profile(null_points(ws), ["dataset", "method"]))


@registry.add("n1_fixed_gain", Q.query([*Q.BENCH, DELTA, PROFILE], """
SELECT dataset, method, first(r_pct ORDER BY round(mean, 12) DESC, r_pct) AS best_r_pct, round(max(mean), 9) AS best_mean, count(*) FILTER (WHERE round(mean, 12) > 0) AS n_positive, count(*) AS n_below_one,
  count(*) FILTER (WHERE round(mean, 12) > 0) > 0 AS raises_mesr FROM pr WHERE r_pct < 100 GROUP BY ALL"""))
def _(ws):
    return rounded(nulls.fixed_gain(nulls.retention_profile(null_points(ws), ["dataset", "method"]), ["dataset", "method"]))


@registry.add("n1_max_selected", Q.query([*Q.BENCH, DELTA, """
mx AS (SELECT dataset, method, recording_id, r_pct, delta FROM dl WHERE method IN ('raw', 'random_null')
  QUALIFY row_number() OVER (PARTITION BY dataset, method, recording_id ORDER BY round(delta, 12) DESC, r_pct) = 1)"""], """
SELECT dataset, method, round(avg(delta), 9) AS mean, count(*) AS n, round(avg(CASE WHEN r_pct = 100 THEN 1.0 ELSE 0.0 END), 9) AS share_argmax_at_r1 FROM mx GROUP BY ALL"""))
def _(ws):
    return rounded(nulls.max_selected(null_points(ws), ["dataset", "method"]))


@registry.add("n1_fixed_retention_bootstrap", Q.query([*Q.BENCH, DELTA, "np AS (SELECT * FROM dl WHERE method IN ('raw', 'random_null'))",
    *boot_ctes("np", "bt", "dataset, method, r_pct", "delta", "recording_id", DRAWS)], """
SELECT dataset, method, r_pct, round(mean, 9) AS mean, round(lo, 9) AS lo, round(hi, 9) AS hi, n, n_clusters, excludes_zero FROM bt"""))
def _(ws):
    return rounded(resample.bootstrap(null_points(ws), ["dataset", "method", "r_pct"], "delta", KEY, DRAWS, algorithm="md5"))


@registry.add("n2_scene_intervals", Q.query([*Q.BENCH, DELTA, "np AS (SELECT * FROM dl WHERE method IN ('raw', 'random_null') AND r_pct < 100)",
    *boot_ctes("np", "bt", "dataset, method, r_pct", "delta", "scene", DRAWS, alpha="(0.05 / 19)")], """
SELECT dataset, method, r_pct, round(mean, 9) AS mean, round(lo, 9) AS lo, round(hi, 9) AS hi, n, n_clusters, excludes_zero FROM bt"""))
def _(ws):
    below = null_points(ws).where("r_pct < 100")
    return rounded(resample.cluster_bootstrap(below, ["dataset", "method", "r_pct"], "delta", "scene", DRAWS,
                                              alpha=0.05 / 19, algorithm="md5"))


@registry.add("n2_interval_verdicts", Q.query([*Q.BENCH, DELTA, "np AS (SELECT * FROM dl WHERE method IN ('raw', 'random_null') AND r_pct < 100)",
    *boot_ctes("np", "bn", "dataset, method, r_pct", "delta", "scene", DRAWS),
    *boot_ctes("np", "bf", "dataset, method, r_pct", "delta", "scene", DRAWS, alpha="(0.05 / 19)")], """
SELECT dataset, method, count(*) AS points, count(*) FILTER (WHERE bn.mean > 1e-12) AS positive_means,
  count(*) FILTER (WHERE bn.lo > 1e-12) AS above, count(*) FILTER (WHERE bn.hi < -1e-12) AS below,
  count(*) FILTER (WHERE bf.lo > 1e-12) AS family_above, count(*) FILTER (WHERE bf.hi < -1e-12) AS family_below,
  coalesce(string_agg(CAST(r_pct AS VARCHAR), ',' ORDER BY r_pct) FILTER (WHERE NOT coalesce(bn.lo > 1e-12, false)), '') AS not_above
FROM bn JOIN bf USING (dataset, method, r_pct) GROUP BY dataset, method"""))
def _(ws):
    below = null_points(ws).where("r_pct < 100")
    interval = lambda alpha: resample.cluster_bootstrap(below, ["dataset", "method", "r_pct"], "delta", "scene", DRAWS,
                                                        alpha=alpha, algorithm="md5")
    return resample.interval_verdicts(interval(0.05), interval(0.05 / 19), ["dataset", "method"], "r_pct")


SEEDED = [Q.EV, Q.LI, Q.BOTH, Q.GRID, f"""sscored AS (SELECT s.*, seed, CAST({Q.prio('seed', 'recording_id', 'event_idx')} AS DOUBLE) AS score
  FROM s CROSS JOIN (VALUES (1), (2), (3)) t(seed))""", *Q.curve_ctes("sscored", "sc0", "dataset, recording_id, seed"),
  """scv AS (SELECT c.*, b.mesr AS raw_mesr, c.mesr - b.mesr AS delta FROM sc0 c JOIN sc0 b ON b.dataset = c.dataset AND b.recording_id = c.recording_id AND b.seed = c.seed AND b.r_pct = 100)""",
  "sp AS (SELECT dataset, seed, r_pct, avg(delta) AS mean, count(*) AS n FROM scv WHERE delta IS NOT NULL GROUP BY ALL)"]


def seed_curves(ws) -> DataFrame:
    return ws.once("seed-curves", lambda: per_corpus(lambda c: nulls.seed_curves(
        ws.stream(c), SEEDS, c.slice_size, c.block, RETENTION_PCT, "md5")))


def seed_profiles(ws) -> DataFrame:
    return nulls.retention_profile(nulls.deltas(seed_curves(ws)), ["dataset", "seed"])


@registry.add("n3_draw_sensitivity", Q.query(SEEDED, """
SELECT dataset, r_pct, count(*) AS n, round(avg(mean), 9) AS mean, round(stddev_samp(mean), 9) AS sd, round(min(mean), 9) AS min, round(max(mean), 9) AS max,
  round(max(mean) - min(mean), 9) AS range, count(*) FILTER (WHERE round(mean, 12) > 0) AS seeds_positive FROM sp WHERE r_pct < 100 GROUP BY ALL"""))
def _(ws):
    return rounded(nulls.draw_sensitivity(seed_profiles(ws), ["dataset"]))


@registry.add("n3_positive_counts", Q.query(SEEDED, """
SELECT dataset, seed, count(*) FILTER (WHERE round(mean, 12) > 0) AS n_positive, count(*) AS n_below_one FROM sp WHERE r_pct < 100 GROUP BY ALL"""))
def _(ws):
    return nulls.positive_counts(seed_profiles(ws), ["dataset"])


@registry.add("n4_blank_lead", Q.query([*SEEDED, Q.SCORED, *Q.CURVE, DELTA,
    """ld AS (SELECT d.dataset, c.seed, d.method, avg(d.delta - c.delta) AS lead, count(*) AS n FROM dl d JOIN scv c ON c.dataset = d.dataset AND c.recording_id = d.recording_id
       AND c.r_pct = 60 WHERE d.r_pct = 60 AND d.method IN ('fa', 'fb', 'fc', 'sc') AND c.delta IS NOT NULL GROUP BY ALL)"""], """
SELECT dataset, seed, method AS best_filter, round(lead, 9) AS lead, n FROM ld QUALIFY row_number() OVER (PARTITION BY dataset, seed ORDER BY round(lead, 12) DESC, method) = 1"""))
def _(ws):
    filters = points(ws).where("r_pct = 60").where(F.col("method").isin("fa", "fb", "fc", "sc"))
    control = nulls.deltas(seed_curves(ws)).where("r_pct = 60")
    return rounded(nulls.blank_lead(filters, control, ["dataset"]))


FRAMES = [*SEEDED, """fs AS (SELECT q.*, nn // (nsl * (100 // gcd(r_pct, 100))) * (nsl * (100 // gcd(r_pct, 100))) AS frame FROM (
    SELECT s0.*, g.r_pct AS rp, g.r_pct, count(*) OVER (PARTITION BY dataset, recording_id, seed, g.r_pct) AS nn FROM sscored s0 CROSS JOIN grid g WHERE g.r_pct < 100) q),
fr_rk AS (SELECT dataset, recording_id, seed, r_pct, event_idx, x, y, nsl, nn, frame, row_number() OVER (PARTITION BY dataset, recording_id, seed, r_pct, event_idx // blk ORDER BY score, event_idx) AS rk,
  count(*) OVER (PARTITION BY dataset, recording_id, seed, r_pct, event_idx // blk) AS n_b FROM fs WHERE event_idx < frame),
fr_keep AS (SELECT * FROM fr_rk WHERE rk <= greatest(1, round_even(n_b * (CAST(r_pct AS DOUBLE) / 100), 0)))""",
    *Q.mesr_ctes("fr_keep", "fm", "dataset, recording_id, seed, r_pct"),
    *Q.mesr_ctes("fr_rk", "fw", "dataset, recording_id, seed, r_pct"),
    """lastk AS (SELECT dataset, recording_id, seed, r_pct, max(event_idx) AS last FROM (
       SELECT k.*, row_number() OVER (PARTITION BY dataset, recording_id, seed, r_pct ORDER BY event_idx) AS pos, count(*) OVER (PARTITION BY dataset, recording_id, seed, r_pct) AS kt
       FROM (SELECT r.*, g.r_pct FROM (SELECT dataset, recording_id, seed, event_idx, nsl, row_number() OVER (PARTITION BY dataset, recording_id, seed, event_idx // blk ORDER BY score, event_idx) AS rk,
         count(*) OVER (PARTITION BY dataset, recording_id, seed, event_idx // blk) AS n_b FROM sscored) r JOIN grid g ON rk <= greatest(1, round_even(n_b * g.r, 0)) WHERE g.r_pct < 100) k)
       WHERE pos <= kt // nsl * nsl GROUP BY ALL)""",
    """sizes AS (SELECT dataset, recording_id, any_value(nsl) AS nsl, count(*) AS nn FROM s GROUP BY ALL)""",
    """ms AS (SELECT c.dataset, c.recording_id, c.seed, c.r_pct, CAST(nn // (nsl * (100 // gcd(c.r_pct, 100))) * (nsl * (100 // gcd(c.r_pct, 100))) AS BIGINT) AS frame, nn,
       c.delta AS delta_original, (l.last + 1) / CAST(nn AS DOUBLE) AS span_thinned, nsl * (nn // nsl) / CAST(nn AS DOUBLE) AS span_unfiltered, fm.mesr - fw.mesr AS delta_matched
       FROM scv c JOIN sizes USING (dataset, recording_id) LEFT JOIN lastk l USING (dataset, recording_id, seed, r_pct)
       LEFT JOIN fm USING (dataset, recording_id, seed, r_pct) LEFT JOIN fw USING (dataset, recording_id, seed, r_pct) WHERE c.r_pct < 100)"""]


def span_rows(ws) -> DataFrame:
    return ws.once("matched-span", lambda: per_corpus(lambda c: nulls.matched_span(
        ws.stream(c), SEEDS, c.slice_size, c.block, RETENTION_PCT, "md5")))


@registry.add("n5_matched_span", Q.query(FRAMES, """
SELECT dataset, recording_id, seed, r_pct, frame, round(frame / CAST(nn AS DOUBLE), 9) AS frame_share, round(delta_original, 9) AS delta_original, round(span_thinned, 9) AS span_thinned,
  round(span_unfiltered, 9) AS span_unfiltered, round(delta_matched, 9) AS delta_matched FROM ms"""))
def _(ws):
    return rounded(span_rows(ws))


SUMMARY = """su AS (SELECT dataset, seed, r_pct, count(*) FILTER (WHERE delta_matched IS NOT NULL) AS n, avg(delta_original) FILTER (WHERE delta_matched IS NOT NULL) AS mo,
  avg(delta_matched) AS mm, median(delta_matched) AS dm FROM ms GROUP BY ALL)"""


@registry.add("n6_matched_span_summary", Q.query([*FRAMES, SUMMARY], """
SELECT dataset, seed, r_pct, n, round(mo, 9) AS mean_original, round(mm, 9) AS mean_matched, round(dm, 9) AS median_matched, sign(mm) = sign(mo) AS same_sign FROM su"""))
def _(ws):
    return rounded(nulls.matched_span_summary(span_rows(ws), ["dataset"]).select(
        "dataset", "seed", "r_pct", "n", "mean_original", "mean_matched", "median_matched", "same_sign"))


ACROSS = """ac AS (SELECT dataset, r_pct, min(mm) AS lo, max(mm) AS hi, count(*) FILTER (WHERE mm > 0) AS seeds_positive, count(*) FILTER (WHERE mm < 0) AS seeds_negative,
  count(*) FILTER (WHERE sign(mm) = sign(mo)) AS seeds_same_sign, count(*) AS seeds FROM su WHERE n > 0 GROUP BY ALL)"""


@registry.add("n6_across_draws", Q.query([*FRAMES, SUMMARY, ACROSS], """
SELECT dataset, r_pct, round(lo, 9) AS matched_mean_min, round(hi, 9) AS matched_mean_max, seeds_positive, seeds_negative, seeds_same_sign, seeds FROM ac"""))
def _(ws):
    return rounded(nulls.across_draws(nulls.matched_span_summary(span_rows(ws), ["dataset"]), ["dataset"]))


@registry.add("n6_span_verdict", Q.query([*FRAMES, SUMMARY, ACROSS], """
SELECT dataset, count(*) FILTER (WHERE seeds_positive = seeds) AS positive_every_seed, count(*) FILTER (WHERE seeds_negative = seeds) AS negative_every_seed,
  count(*) FILTER (WHERE seeds_same_sign = seeds) AS same_sign_every_seed FROM ac GROUP BY dataset"""))
def _(ws):
    return nulls.span_verdict(nulls.across_draws(nulls.matched_span_summary(span_rows(ws), ["dataset"]), ["dataset"]), ["dataset"])


def _shuf(win: str, tag: int, seed: int) -> str:
    prio = Q.prio(str(seed), 'recording_id', 'event_idx')
    return f"""SELECT a.dataset, a.recording_id, a.event_idx, {tag} AS win, {seed} AS seed, b.x, b.y, a.label, a.nsl, a.blk FROM (
  SELECT *, {win} AS w, row_number() OVER (PARTITION BY recording_id, {win} ORDER BY event_idx) AS rk FROM s WHERE dataset = 'ev') a JOIN (
  SELECT *, {win} AS w, row_number() OVER (PARTITION BY recording_id, {win} ORDER BY {prio}, event_idx) AS rk FROM s WHERE dataset = 'ev') b
  ON a.recording_id = b.recording_id AND a.w = b.w AND a.rk = b.rk"""


SHUF_SEEDS = [11, 12]
SHUFFLED = [Q.EV, Q.LI, Q.BOTH, Q.GRID, "sh AS (" + " UNION ALL ".join(
    ["SELECT dataset, recording_id, event_idx, 0 AS win, 11 AS seed, x, y, label, nsl, blk FROM s WHERE dataset = 'ev'"]
    + [_shuf("event_idx // 100", 100, sd) for sd in SHUF_SEEDS] + [_shuf("0", -1, sd) for sd in SHUF_SEEDS]) + ")",
    f"""shs AS (SELECT sh.*, 'raw' AS method, 0.0 AS score FROM sh UNION ALL
       SELECT sh.*, 'random_null', CAST({Q.prio(str(Q.SEED), 'recording_id', 'event_idx')} AS DOUBLE) FROM sh)""",
    *Q.curve_ctes("shs", "sv0", "recording_id, win, seed, method"),
    """sv AS (SELECT c.recording_id, c.win AS "window", c.seed, c.method, c.r_pct, c.mesr, c.mesr - b.mesr AS delta FROM sv0 c JOIN sv0 b ON b.recording_id = c.recording_id AND b.win = c.win
       AND b.seed = c.seed AND b.method = c.method AND b.r_pct = 100)""",
    '''smn AS (SELECT "window", method, seed, r_pct, avg(delta) AS mean FROM sv WHERE delta IS NOT NULL AND r_pct < 100 GROUP BY ALL)''']


def shuffled(ws) -> DataFrame:
    c = EVENT_STREAM
    return ws.once("shuffled", lambda: nulls.shuffled_curves(
        ws.stream(c), [0, 100, None], SHUF_SEEDS, SEED, c.slice_size, c.block, RETENTION_PCT, "md5"))


@registry.add("n7_shuffle_response", Q.query(SHUFFLED, """
SELECT recording_id, "window", seed, method, r_pct, round(delta, 9) AS delta FROM sv WHERE delta IS NOT NULL"""))
def _(ws):
    return rounded(nulls.deltas(shuffled(ws)).select(KEY, "window", "seed", "method", "r_pct", "delta"))


@registry.add("n8_unshuffled_identity", Q.query([*SHUFFLED, Q.SCORED, *Q.CURVE], """
SELECT v.method, count(*) AS cells, count(*) FILTER (WHERE (v.mesr IS NULL) <> (c.mesr IS NULL) OR abs(v.mesr - c.mesr) > 1e-12) AS differ
FROM sv v JOIN crv c ON c.dataset = 'ev' AND c.recording_id = v.recording_id AND c.method = v.method AND c.r_pct = v.r_pct WHERE "window" = 0 GROUP BY ALL"""))
def _(ws):
    bench = ws.curve().where("dataset = 'ev'").where(F.col("method").isin(NULLS))
    return nulls.check_unshuffled(shuffled(ws), bench, [KEY, "method", "r_pct"])


@registry.add("n9_shuffle_summary", Q.query(SHUFFLED, """
SELECT "window", method, seed, count(*) AS evaluable, count(*) FILTER (WHERE mean > 0) AS positive, round(max(mean) FILTER (WHERE mean > 0), 9) AS largest_positive,
  round(max(mean) FILTER (WHERE r_pct = 20), 9) AS at_reference FROM smn GROUP BY ALL"""))
def _(ws):
    return rounded(nulls.shuffle_summary(nulls.deltas(shuffled(ws)), [], 20))


@registry.add("n17_shuffle_profile", Q.query(SHUFFLED, """
SELECT "window", method, r_pct, round(avg(mean), 9) AS mean, round(max(abs(mean)), 9) AS largest_abs FROM smn GROUP BY ALL"""))
def _(ws):
    return rounded(nulls.shuffle_profile(nulls.deltas(shuffled(ws)), []))


COLD = [*Q.BENCH, DELTA, HOT, """cold AS (SELECT s.* EXCLUDE (event_idx), row_number() OVER (PARTITION BY dataset, recording_id ORDER BY event_idx) - 1 AS event_idx
  FROM s JOIN hot USING (dataset, recording_id, x, y) WHERE NOT is_hot)""",
    Q.SCORED.replace("scored AS", "cscored AS").replace("SELECT s.*", "SELECT cold.*").replace("FROM s CROSS", "FROM cold CROSS"),
    *Q.curve_ctes("cscored", "cc0"),
    """cdl AS (SELECT c.*, c.mesr - b.mesr AS delta FROM cc0 c JOIN cc0 b ON b.dataset = c.dataset AND b.recording_id = c.recording_id AND b.method = c.method AND b.r_pct = 100 WHERE c.mesr IS NOT NULL)""",
    """ba AS (SELECT a.dataset, a.recording_id, a.method, a.r_pct, a.delta AS before, b.delta AS after FROM dl a JOIN cdl b USING (dataset, recording_id, method, r_pct))"""]


def cold_points(ws) -> DataFrame:
    def build():
        return per_corpus(lambda c: grid.curve(
            regime.remove_hot_pixels(ws.stream(c), 99.0, c.block), scores(), c.slice_size, c.block, RETENTION_PCT))
    return nulls.deltas(ws.once("cold-curve", build))


@registry.add("n10_hot_pixel_specificity", Q.query(COLD, """
SELECT dataset, method, r_pct, count(*) AS n, round(avg(before), 9) AS before, round(avg(after), 9) AS after, count(*) FILTER (WHERE after - before < -1e-12) AS n_drop
FROM ba WHERE method = 'random_null' GROUP BY ALL"""))
def _(ws):
    pairs = nulls.before_after(points(ws), cold_points(ws), ["dataset"]).where("method = 'random_null'")
    return rounded(nulls.specificity(pairs, ["dataset"]))


@registry.add("n10_positive_before_after", Q.query([*COLD, "sp AS (SELECT dataset, method, r_pct, avg(before) AS b, avg(after) AS a FROM ba WHERE method = 'random_null' AND r_pct < 100 GROUP BY ALL)"], """
SELECT dataset, method, count(*) FILTER (WHERE round(b, 12) > 0) AS n_positive_before, count(*) FILTER (WHERE round(a, 12) > 0) AS n_positive_after, count(*) AS n_retentions FROM sp GROUP BY ALL"""))
def _(ws):
    pairs = nulls.before_after(points(ws), cold_points(ws), ["dataset"]).where("method = 'random_null'")
    return nulls.specificity_counts(nulls.specificity(pairs, ["dataset"]), ["dataset"])


MARGINS = [*COLD, """runs AS (SELECT 'before' AS run, dataset, recording_id, method, r_pct, delta FROM dl UNION ALL SELECT 'after', dataset, recording_id, method, r_pct, delta FROM cdl),
rr AS (SELECT * FROM runs WHERE method IN ('fa', 'fb', 'fc', 'sc', 'raw', 'random_null') AND r_pct IN (20, 60)),
co AS (SELECT dataset, recording_id, r_pct FROM rr GROUP BY ALL HAVING count(DISTINCT run || method) = 12),
mg AS (SELECT k.dataset, k.r_pct, k.run, k.method, count(*) AS n, avg(k.delta) AS delta, avg(k.delta - b.delta) AS minus_null, count(*) FILTER (WHERE round(k.delta - b.delta, 12) > 0) AS n_above_null
  FROM rr k JOIN co USING (dataset, recording_id, r_pct) JOIN rr b ON b.dataset = k.dataset AND b.recording_id = k.recording_id AND b.r_pct = k.r_pct AND b.run = k.run AND b.method = 'random_null'
  GROUP BY ALL)"""]


def margins(ws) -> DataFrame:
    at = lambda df: df.where("r_pct IN (20, 60)").select("dataset", KEY, "method", "r_pct", "delta")
    return nulls.blank_margins(at(points(ws)), at(cold_points(ws)), ["fa", "fb", "fc", "sc", *NULLS], "random_null", ["dataset"])


@registry.add("n11_blank_margins", Q.query(MARGINS, """
SELECT dataset, r_pct, run, method, n, round(delta, 9) AS delta, round(minus_null, 9) AS minus_null, n_above_null FROM mg"""))
def _(ws):
    return rounded(margins(ws))


@registry.add("n11_best_margin", Q.query(MARGINS, """
SELECT dataset, r_pct, run, first(method ORDER BY round(minus_null, 12) DESC, method) AS best, round(max(minus_null), 9) AS minus_null FROM mg WHERE method NOT IN ('raw', 'random_null') GROUP BY ALL"""))
def _(ws):
    return rounded(nulls.best_margin(margins(ws), ["dataset"], NULLS))


@registry.add("n12_level_lead", Q.query([*Q.BENCH], """
SELECT a.dataset, count(*) AS n, count(*) FILTER (WHERE round(a.mesr - b.mesr, 12) > 0) AS n_positive, round(avg(a.mesr - b.mesr), 9) AS mean, round(min(a.mesr - b.mesr), 9) AS min, round(max(a.mesr - b.mesr), 9) AS max
FROM crv a JOIN crv b USING (dataset, recording_id, r_pct) WHERE a.method = 'fc' AND b.method = 'random_null' AND r_pct = 60 AND a.evaluable AND b.evaluable GROUP BY ALL"""))
def _(ws):
    return rounded(nulls.level_lead(points(ws).where("r_pct = 60"), "fc", "random_null", ["dataset"]))


@registry.add("n13_scene_means", Q.query([*Q.BENCH, DELTA],
    "SELECT dataset, method, scene, round(avg(delta), 9) AS mean, count(*) AS n FROM dl WHERE r_pct = 20 GROUP BY ALL"))
def _(ws):
    return rounded(points(ws).where("r_pct = 20").groupBy("dataset", "method", "scene").agg(
        F.avg("delta").alias("mean"), F.count("*").alias("n")))


ADDED = [*Q.STREAMS, f"""addn AS (SELECT s.*, rate FROM s CROSS JOIN (VALUES (0), (25), (50), (100)) t(rate)
   WHERE label = 0 OR {Q.word("5", 'recording_id', 'event_idx')} % 100 < rate)""", *Q.mesr_ctes("addn", "am", "dataset, recording_id, rate"),
   """steps AS (SELECT *, mesr < lag(mesr) OVER (PARTITION BY dataset, recording_id ORDER BY rate) AS fall FROM am)"""]


@registry.add("n14_controlled_addition", Q.query(ADDED, """
SELECT dataset, recording_id, count(*) AS points, round(arg_max(mesr, rate), 9) AS last, round(arg_min(mesr, rate), 9) AS first, bool_and(fall) AS monotone_falling FROM steps GROUP BY ALL"""))
def _(ws):
    rates = [0, 25, 50, 100]

    def one(c):
        s = ws.stream(c)
        pick = word(5, F.col(KEY), F.col("event_idx"), algorithm="md5") % 100
        marked = s.select("*", *[((F.col("label") == 0) | (pick < r)).alias(f"a{r}") for r in rates])
        mesr = metric.mesr_of_masks(marked, [f"a{r}" for r in rates], c.slice_size, c.block)
        points = mesr.withColumn("rate", F.substring("method", 2, 9).cast("int"))
        return nulls.monotone_fall(points, [KEY], "rate", "mesr")
    return per_corpus(lambda c: rounded(one(c)))


@registry.add("n15_benchmark_scale", Q.query(Q.BENCH, """
SELECT dataset, count(DISTINCT recording_id) AS recordings, count(DISTINCT recording_id) FILTER (WHERE raw_mesr IS NOT NULL) AS evaluable_recordings,
  count(DISTINCT (recording_id, method)) FILTER (WHERE evaluable) AS cells FROM crv GROUP BY dataset"""))
def _(ws):
    return ws.curve().groupBy("dataset").agg(
        F.count_distinct(KEY).alias("recordings"),
        F.count_distinct(F.when(F.col("raw_mesr").isNotNull(), F.col(KEY))).alias("evaluable_recordings"),
        F.count_distinct(F.when(F.col("evaluable"), F.struct(KEY, "method"))).alias("cells"))


@registry.add("n16_controls_agreement", Q.query([*Q.BENCH, DELTA, PROFILE,
    "bb AS (SELECT dataset, first(r_pct ORDER BY round(mean, 12) DESC, r_pct) AS r_pct FROM pr WHERE method = 'random_null' AND r_pct < 100 GROUP BY dataset)"], """
SELECT a.dataset, a.r_pct, round(a.mean, 9) AS random_mean, round(b.mean, 9) AS prefix_mean, round(abs(a.mean - b.mean), 9) AS gap
FROM bb JOIN pr a USING (dataset, r_pct) JOIN pr b ON b.dataset = a.dataset AND b.r_pct = a.r_pct AND b.method = 'raw' WHERE a.method = 'random_null'"""))
def _(ws):
    prof = nulls.retention_profile(null_points(ws), ["dataset", "method"])
    best = nulls.fixed_gain(prof.where("method = 'random_null'"), ["dataset"]).select("dataset", F.col("best_r_pct").alias("r_pct"))
    at = prof.join(best, ["dataset", "r_pct"])
    mean = lambda m: F.max(F.when(F.col("method") == m, F.col("mean")))
    return rounded(at.groupBy("dataset", "r_pct").agg(
        mean("random_null").alias("random_mean"), mean("raw").alias("prefix_mean"),
        F.abs(mean("random_null") - mean("raw")).alias("gap")))


@registry.add("n16_widest_draw_sd", Q.query([*SEEDED, "ds AS (SELECT dataset, r_pct, stddev_samp(mean) AS sd, row_number() OVER (PARTITION BY dataset ORDER BY r_pct) AS i FROM sp WHERE r_pct < 100 GROUP BY dataset, r_pct)"], """
SELECT dataset, round(max(sd) FILTER (WHERE i = 1), 9) AS sd_first, round(max(sd) FILTER (WHERE i > 1), 9) AS sd_rest, first(r_pct ORDER BY round(sd, 12) DESC, r_pct) FILTER (WHERE i > 1) AS at_r_pct FROM ds GROUP BY dataset"""))
def _(ws):
    rows = nulls.draw_sensitivity(seed_profiles(ws), ["dataset"])
    floor = rows.groupBy("dataset").agg(F.min("r_pct").alias("floor"))
    first = F.col("r_pct") == F.col("floor")
    return rounded(rows.join(floor, "dataset").groupBy("dataset").agg(
        F.max(F.when(first, F.col("sd"))).alias("sd_first"), F.max(F.when(~first, F.col("sd"))).alias("sd_rest"),
        F.min_by("r_pct", F.when(~first, F.struct(-blind("sd"), "r_pct"))).alias("at_r_pct")))


# --- resampling ------------------------------------------------------------------------------

@registry.add("b1_bootstrap_mean", Q.query([*Q.BENCH, DELTA, "np AS (SELECT * FROM dl WHERE r_pct = 40)",
    *boot_ctes("np", "bt", "dataset, method", "delta", "recording_id", DRAWS)], """
SELECT dataset, method, round(mean, 9) AS mean, round(lo, 9) AS lo, round(hi, 9) AS hi, n, n_clusters, excludes_zero FROM bt"""))
def _(ws):
    return rounded(resample.bootstrap(points(ws).where("r_pct = 40"), ["dataset", "method"], "delta", KEY, DRAWS, algorithm="md5"))


@registry.add("b2_cluster_bootstrap", Q.query(["vals AS (SELECT l_returnflag AS grp, l_suppkey AS cl, CAST(round(l_discount * 100) AS BIGINT) AS v FROM lineitem)",
    *boot_ctes("vals", "bt", "grp", "v", "cl", DRAWS)], """
SELECT grp, round(mean, 9) AS mean, round(lo, 9) AS lo, round(hi, 9) AS hi, n, n_clusters, excludes_zero FROM bt"""))
def _(ws):
    rows = read(ws.spark, ws.sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("grp"), F.col("l_suppkey").alias("cl"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("v"))
    return rounded(resample.cluster_bootstrap(rows, ["grp"], "v", "cl", DRAWS, algorithm="md5"))


@registry.add("b3_spread_summary", Q.query([*Q.BENCH, "spd AS (SELECT dataset, recording_id, max(mesr) - min(mesr) AS sp FROM crv WHERE method = 'sc' AND evaluable GROUP BY ALL)",
    *boot_ctes("spd", "bt", "dataset", "sp", "recording_id", DRAWS)], """
SELECT dataset, n, round(mean, 9) AS mean, round(stddev_samp(sp), 9) AS sd, round(min(sp), 9) AS min, round(max(sp), 9) AS max, round(any_value(lo), 9) AS lo, round(any_value(hi), 9) AS hi
FROM bt JOIN spd USING (dataset) GROUP BY dataset, n, mean"""))
def _(ws):
    spreads = ws.curve().where("method = 'sc' AND evaluable").groupBy("dataset", KEY).agg((F.max("mesr") - F.min("mesr")).alias("sp"))
    return rounded(resample.spread_summary(spreads, ["dataset"], "sp", KEY, DRAWS, algorithm="md5"))


REPS = """reps AS (SELECT recording_id AS cell, CAST(event_id % 3 AS INTEGER) AS rep, avg(sc) AS v FROM ev GROUP BY ALL),
pk AS (SELECT 1 AS g, cell, list(v ORDER BY rep) AS vs, count(*) AS k FROM reps GROUP BY cell)"""


@registry.add("b4_repetition_draws", Q.query([Q.EV, REPS, f"""dm AS (SELECT d, avg(vs[1 + {Q.word(str(Q.SEED), 'd', 'cell')} % k]) AS m FROM pk CROSS JOIN range(0, 1000) t(d) GROUP BY d)"""], """
SELECT count(*) AS draws, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(quantile_cont(m, 0.975) - quantile_cont(m, 0.025), 6) AS central_width FROM dm"""))
def _(ws):
    reps = ws.stream(EVENT_STREAM).groupBy(F.col(KEY).alias("cell"), (F.col("source_idx") % 3).cast("int").alias("rep")).agg(F.avg("sc").alias("v"))
    out = resample.repetition_draws(reps.withColumn("g", F.lit(1)), ["g"], "cell", "rep", "v", 1000, algorithm="md5")
    return rounded(out.drop("g"), 6)


def predictions(ws) -> DataFrame:
    """Stored predictions of seven conditions: right above a value threshold, else off by one."""
    e = read(ws.spark, ws.sf_dir, "events")
    cut = F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(float(t)).alias("cut")) for n, t in CONDITIONS])
    return e.select(F.col("event_id").alias("clip"), (F.col("user_id") % 6).alias("subject"),
                    (F.col("event_id") % 11).alias("target"), "value", F.inline(cut)).select(
        "condition", "clip", "subject", "target",
        F.when(F.col("value") * 37 % 50 > F.col("cut"), F.col("target"))
        .otherwise((F.col("clip") + 1) % 11).alias("prediction"))


CONDITIONS = [("a__unfiltered", 5), ("a__fa", 12), ("a__fb", 8), ("a__fc", 20), ("b__unfiltered", 10), ("b__fa", 9), ("b__fc", 25)]
PRED = "pred AS (SELECT condition, event_id AS clip, user_id % 6 AS subject, event_id % 11 AS target, CASE WHEN value * 37 % 50 > cut THEN event_id % 11 ELSE (event_id + 1) % 11 END AS prediction FROM events CROSS JOIN (VALUES " + ", ".join(
    f"('{n}', CAST({t} AS DOUBLE))" for n, t in CONDITIONS) + ") t(condition, cut))"
PAIRSQL = """prs AS (SELECT DISTINCT a, b FROM (SELECT DISTINCT p.condition AS a, split_part(p.condition, '__', 1) || '__unfiltered' AS b FROM pred p
  UNION ALL SELECT 'a__fa', 'a__fc' UNION ALL SELECT 'b__fa', 'a__fa') WHERE a <> b)"""


def accuracy_pairs(ws) -> DataFrame:
    return resample.baseline_pairs(predictions(ws), [("a__fa", "a__fc"), ("b__fa", "a__fa")])


@registry.add("b5_paired_accuracy", Q.query([PRED, PAIRSQL,
    """j AS (SELECT p.a, p.b, x.subject, CAST(x.prediction = x.target AS INTEGER) AS oa, CAST(y.prediction = y.target AS INTEGER) AS ob, CAST(x.prediction = x.target AS INTEGER) - CAST(y.prediction = y.target AS INTEGER) AS d
       FROM prs p JOIN pred x ON x.condition = p.a JOIN pred y ON y.condition = p.b AND y.clip = x.clip)""",
    *boot_ctes("j", "bt", "a, b", "d", "subject", DRAWS)], """
SELECT a, b, round(accuracy_a, 9) AS accuracy_a, round(accuracy_b, 9) AS accuracy_b, only_a, only_b, round(mean, 9) AS mean, round(lo, 9) AS lo, round(hi, 9) AS hi, n, n_clusters, excludes_zero
FROM bt JOIN (SELECT a, b, avg(oa) AS accuracy_a, avg(ob) AS accuracy_b, count(*) FILTER (WHERE d > 0) AS only_a, count(*) FILTER (WHERE d < 0) AS only_b FROM j GROUP BY a, b) USING (a, b)"""))
def _(ws):
    return rounded(resample.paired_accuracy(predictions(ws), accuracy_pairs(ws), DRAWS, algorithm="md5"))


@registry.add("b5_subject_deltas", Q.query([PRED, PAIRSQL], """
SELECT p.a, p.b, x.subject, round(avg(CAST(x.prediction = x.target AS INTEGER) - CAST(y.prediction = y.target AS INTEGER)), 9) AS delta, count(*) AS clips
FROM prs p JOIN pred x ON x.condition = p.a JOIN pred y ON y.condition = p.b AND y.clip = x.clip GROUP BY ALL"""))
def _(ws):
    return rounded(resample.subject_deltas(predictions(ws), accuracy_pairs(ws)))


@registry.add("b5_mcnemar_p_values", Q.query([PRED, PAIRSQL,
    """mc AS (SELECT p.a, p.b, count(*) FILTER (WHERE x.prediction = x.target AND y.prediction <> y.target) AS only_a,
       count(*) FILTER (WHERE x.prediction <> x.target AND y.prediction = y.target) AS only_b
       FROM prs p JOIN pred x ON x.condition = p.a JOIN pred y ON y.condition = p.b AND y.clip = x.clip GROUP BY ALL)"""], """
SELECT a, b, only_a, only_b, round(least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2.0)))
  FROM range(0, least(only_a, only_b) + 1) g(i))), 7) AS p FROM mc"""))
def _(ws):
    right = predictions(ws).select("condition", "clip", (F.col("prediction") == F.col("target")).alias("right"))
    both = accuracy_pairs(ws).join(right.withColumnsRenamed({"condition": "a", "right": "right_a"}), "a").join(
        right.withColumnsRenamed({"condition": "b", "right": "right_b"}), ["b", "clip"])
    rows = both.groupBy("a", "b").agg(F.count_if(F.col("right_a") & ~F.col("right_b")).alias("only_a"),
                                      F.count_if(~F.col("right_a") & F.col("right_b")).alias("only_b"))
    return rows.select("a", "b", "only_a", "only_b", F.round(mcnemar_exact("only_a", "only_b"), 7).alias("p"))


@registry.add("b6_pairing_rule", Q.query([PRED, PAIRSQL], "SELECT a, b FROM prs"))
def _(ws):
    return accuracy_pairs(ws)
