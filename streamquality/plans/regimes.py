"""Queries on stream characterisation and profile tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ranks
from ..functions.tails import two_sided_t
from ..operators import contrasts, regime
from ..sources.tables import read
from . import sql as Q
from .base import Registry, rounded
from .outputs import SPEAR
from .positions import per_corpus

registry = Registry()
KEY = "recording_id"
WINDOWS = {"ev": 3_600_000_000, "li": 604_800_000_000}
STATS = ["spatial_autocorr", "local_global_coupling", "event_rate_per_px", "hot_pixel_share"]
SCENES = ["ui", "biz", "sys", "A", "N", "R"]

SHARES = """wn AS (SELECT dataset, recording_id, x, y, (t_us - min(t_us) OVER (PARTITION BY dataset, recording_id)) //
  CASE dataset WHEN 'ev' THEN 3600000000 ELSE 604800000000 END AS win FROM s),
wp AS (SELECT dataset, recording_id, win, x, y, count(*) AS n FROM wn GROUP BY ALL),
nb AS (SELECT a.dataset, a.recording_id, a.win, a.n, EXISTS (SELECT 1 FROM wp b WHERE b.dataset = a.dataset AND b.recording_id = a.recording_id AND b.win = a.win
   AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 AND (b.x <> a.x OR b.y <> a.y)) AS near FROM wp a),
shr AS (SELECT dataset, recording_id, win, CAST(sum(n) AS BIGINT) AS n, coalesce(sum(n) FILTER (WHERE near), 0) / CAST(sum(n) AS DOUBLE) AS share FROM nb GROUP BY ALL HAVING sum(n) >= 2)"""
PROF = [*Q.STREAMS, SHARES, """hotp AS (SELECT *, n >= quantile_cont(n, 0.999) OVER (PARTITION BY dataset, recording_id) AS is_hot FROM (
  SELECT dataset, recording_id, x, y, count(*) AS n FROM s GROUP BY ALL)),
hsh AS (SELECT dataset, recording_id, sum(n) FILTER (WHERE is_hot) / CAST(sum(n) AS DOUBLE) AS hot_pixel_share FROM hotp GROUP BY ALL),
rte AS (SELECT dataset, recording_id, any_value(scene) AS scene, count(*) AS events, count(*) / ((max(t_us) - min(t_us)) * 1e-6) / 3072 AS event_rate_per_px FROM s GROUP BY ALL),
loc AS (SELECT dataset, recording_id, avg(share) AS spatial_autocorr, CASE WHEN count(*) < 3 THEN NULL WHEN stddev_pop(share) = 0 OR stddev_pop(n) = 0 THEN 0
  ELSE corr(share, n) END AS local_global_coupling FROM shr GROUP BY ALL),
prof AS (SELECT *, recording_id IN ('click', 'view', 'NO', 'AO') AS synthetic FROM rte JOIN hsh USING (dataset, recording_id) LEFT JOIN loc USING (dataset, recording_id))"""]


def shares(ws, c) -> DataFrame:
    sensors = ws.recordings().where(F.col("dataset") == c.name)
    return regime.neighbour_shares(ws.stream(c), sensors, WINDOWS[c.name], 2)


def profiles(ws) -> DataFrame:
    """Regime profiles of all recordings, computed once per session."""
    def build():
        recs = ws.recordings()
        rows = per_corpus(lambda c: regime.regime_profile(
            ws.stream(c), recs.where(F.col("dataset") == c.name), WINDOWS[c.name], 2))
        return rows.join(recs.select("dataset", KEY, "scene", "synthetic"), ["dataset", KEY])
    return ws.once("profiles", build)


@registry.add("r1_neighbour_share", Q.query([*Q.STREAMS, SHARES],
    "SELECT dataset, recording_id, win, n, round(share, 9) AS share FROM shr"))
def _(ws):
    return per_corpus(lambda c: rounded(shares(ws, c)))


@registry.add("r2_spatial_autocorrelation", Q.query([*Q.STREAMS, SHARES],
    "SELECT dataset, recording_id, round(avg(share), 9) AS spatial_autocorr FROM shr GROUP BY ALL"))
def _(ws):
    return per_corpus(lambda c: rounded(regime.spatial_autocorrelation(shares(ws, c))))


@registry.add("r3_local_global_coupling", Q.query(PROF,
    "SELECT dataset, recording_id, round(local_global_coupling, 9) AS local_global_coupling FROM loc"))
def _(ws):
    return per_corpus(lambda c: rounded(regime.local_global_coupling(shares(ws, c))))


@registry.add("r4_hot_pixel_share", Q.query(PROF,
    "SELECT dataset, recording_id, round(hot_pixel_share, 9) AS hot_pixel_share FROM hsh"))
def _(ws):
    return per_corpus(lambda c: rounded(regime.hot_pixel_share(ws.stream(c))))


@registry.add("r5_event_rate", Q.query(PROF,
    "SELECT dataset, recording_id, events, round(event_rate_per_px, 15) AS event_rate_per_px FROM rte"))
def _(ws):
    return per_corpus(lambda c: rounded(regime.event_rate_per_px(ws.stream(c), ws.recordings()), 15))


@registry.add("r6_regime_profile", Q.query(PROF, """
SELECT dataset, recording_id, scene, synthetic, events, round(event_rate_per_px, 15) AS event_rate_per_px, round(hot_pixel_share, 9) AS hot_pixel_share,
  round(spatial_autocorr, 9) AS spatial_autocorr, round(local_global_coupling, 9) AS local_global_coupling FROM prof"""))
def _(ws):
    p = profiles(ws)
    return rounded(p.drop("event_rate_per_px")).join(
        p.select("dataset", KEY, F.round("event_rate_per_px", 15).alias("event_rate_per_px")), ["dataset", KEY])


@registry.add("r7_corpus_means", Q.query(PROF, """
SELECT scene, count(*) AS recordings, round(avg(spatial_autocorr), 9) AS spatial_autocorr, round(avg(local_global_coupling), 9) AS local_global_coupling,
  round(avg(event_rate_per_px) * 1e6, 9) AS event_rate_per_px, round(avg(hot_pixel_share), 9) AS hot_pixel_share FROM prof GROUP BY scene"""))
def _(ws):
    return rounded(contrasts.corpus_means(profiles(ws), "scene", STATS).withColumn(
        "event_rate_per_px", F.col("event_rate_per_px") * 1e6))


LONG = """lng AS (SELECT * FROM (UNPIVOT (SELECT dataset, recording_id, scene, synthetic, spatial_autocorr, local_global_coupling, event_rate_per_px, hot_pixel_share FROM prof)
  ON spatial_autocorr, local_global_coupling, event_rate_per_px, hot_pixel_share INTO NAME stat VALUE value))"""
UTEST = """{o}_r AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY value) + (count(*) OVER (PARTITION BY {k}, value) - 1) / 2.0 AS r,
  count(*) OVER (PARTITION BY {k}, value) AS ties FROM {t} WHERE value IS NOT NULL),
{o}_a AS (SELECT {k}, count(*) FILTER (WHERE first) AS n1, count(*) FILTER (WHERE NOT first) AS n2, sum(r) FILTER (WHERE first) AS r1,
  avg(value) FILTER (WHERE first) AS m1, avg(value) FILTER (WHERE NOT first) AS m2, sum(CAST(ties AS DOUBLE) * ties - 1) AS tt FROM {o}_r GROUP BY {k}),
{o} AS (SELECT {k}, n1, n2, m1, m2, CASE WHEN n1 >= 2 AND n2 >= 2 THEN r1 - n1 * (n1 + 1) / 2.0 END AS u,
  sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM {o}_a)"""
UOUT = """n1, n2, round(u, 9) AS u, round(1 - 2 * u / (n1 * n2), 9) AS rank_biserial,
  CASE WHEN sd > 0 AND u IS NOT NULL THEN round(greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0) / sd, 9) END AS z"""


def _uout(df: DataFrame, *keys: str) -> DataFrame:
    return rounded(df.select(*keys, "n1", "n2", "u", "rank_biserial", "z"))


def long_profiles(ws) -> DataFrame:
    return contrasts.long_stats(profiles(ws), ["dataset", KEY, "scene", "synthetic"], STATS)


@registry.add("r8_two_group_test", Q.query([*PROF, LONG, "f AS (SELECT *, synthetic AS first FROM lng)", UTEST.format(o="ut", k="stat", t="f")],
    f"SELECT stat, {UOUT} FROM ut"))
def _(ws):
    return _uout(contrasts.two_group(long_profiles(ws), ["stat"], "synthetic", "value"), "stat")


@registry.add("r8_separation_p_values", Q.query([*PROF, LONG, "f AS (SELECT *, synthetic AS first FROM lng)", UTEST.format(o="ut", k="stat", t="f"),
    "zz AS (SELECT stat, 1 - 2 * u / (n1 * n2) AS rb, CASE WHEN sd > 0 AND u IS NOT NULL THEN greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0) / sd END AS z FROM ut)",
    f"pp AS (SELECT stat, rb, CASE WHEN z IS NOT NULL THEN {Q.normal_p('z')} END AS p FROM zz)"],
    f"SELECT stat, round(p, 7) AS p_value, p < {contrasts.P_BAR} AND abs(rb) > {contrasts.EFFECT_BAR} AS separates FROM pp"))
def _(ws):
    tested = contrasts.with_separation(contrasts.two_group(long_profiles(ws), ["stat"], "synthetic", "value"))
    return rounded(tested.select("stat", "p_value", "separates"), 7)


@registry.add("r8_two_group_on_crossed", Q.query(["f AS (SELECT l_linenumber % 2 AS odd, l_quantity > 25 AS first, l_extendedprice AS value FROM lineitem)",
    UTEST.format(o="ut", k="odd", t="f")], f"SELECT odd, {UOUT} FROM ut"))
def _(ws):
    rows = read(ws.spark, ws.sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 2).alias("odd"), (F.col("l_quantity") > 25).alias("first"),
        F.col("l_extendedprice").alias("value"))
    return _uout(contrasts.two_group(rows, ["odd"], "first", "value"), "odd")


@registry.add("r9_leave_one_corpus_out", Q.query([*PROF, LONG,
    "f AS (SELECT l.*, d.dropped, synthetic AS first FROM lng l JOIN (SELECT DISTINCT scene AS dropped FROM prof) d ON l.scene <> d.dropped)",
    UTEST.format(o="ut", k="dropped, stat", t="f")], f"SELECT dropped, stat, {UOUT} FROM ut"))
def _(ws):
    kept = contrasts.leave_one_out(long_profiles(ws), "scene", SCENES)
    return _uout(contrasts.two_group(kept, ["dropped", "stat"], "synthetic", "value"), "dropped", "stat")


CROSSED = """cr AS (SELECT l_suppkey AS scene, l_linenumber % 4 AS level, avg(l_discount) AS stat, avg(l_tax) AS rate FROM lineitem GROUP BY ALL),
ml AS (SELECT scene, max(stat) FILTER (WHERE level = 0) AS l0, max(stat) FILTER (WHERE level = 1) AS l1, max(stat) FILTER (WHERE level = 2) AS l2,
  max(stat) FILTER (WHERE level = 3) AS l3 FROM cr GROUP BY scene HAVING count(*) = 4)"""
LEVELS = [0, 1, 2, 3]


def crossed(ws) -> DataFrame:
    li = read(ws.spark, ws.sf_dir, "lineitem")
    # sums of exact cents keep the averages equal in any order of addition
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint")) / F.count("*") / 100
    return li.groupBy(F.col("l_suppkey").alias("scene"), (F.col("l_linenumber") % 4).alias("level")).agg(
        cents("l_discount").alias("stat"), cents("l_tax").alias("rate"))


CROSSED = CROSSED.replace("avg(l_discount)", "sum(CAST(round(l_discount * 100) AS BIGINT)) / CAST(count(*) AS DOUBLE) / 100").replace(
    "avg(l_tax)", "sum(CAST(round(l_tax * 100) AS BIGINT)) / CAST(count(*) AS DOUBLE) / 100")


def matched(ws, value="stat") -> DataFrame:
    return contrasts.matched_levels(crossed(ws), "scene", "level", LEVELS, value)


@registry.add("r10_matched_levels", Q.query([CROSSED],
    "SELECT scene, round(l0, 9) AS l0, round(l1, 9) AS l1, round(l2, 9) AS l2, round(l3, 9) AS l3 FROM ml"))
def _(ws):
    return rounded(matched(ws))


MLR = "mlr AS (SELECT * FROM (UNPIVOT ml ON l0, l1, l2, l3 INTO NAME level VALUE value))"


@registry.add("r11_per_level", Q.query([CROSSED, MLR], """
SELECT level, count(*) AS n, round(median(value), 9) AS median, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.25), 9) AS q25,
  round(quantile_cont(value, 0.75), 9) AS q75 FROM mlr GROUP BY level"""))
def _(ws):
    return rounded(contrasts.per_level(matched(ws), "scene", LEVELS))


FRIED = """fr AS (SELECT scene, level, rank() OVER (PARTITION BY scene ORDER BY value) + (count(*) OVER (PARTITION BY scene, value) - 1) / 2.0 AS r,
  count(*) OVER (PARTITION BY scene, value) AS ties FROM mlr),
ft AS (SELECT level, sum(r) AS sr, count(*) AS n, sum(CAST(ties AS DOUBLE) * ties - 1) AS tt FROM fr GROUP BY level),
chi AS (SELECT max(n) AS blocks, (12.0 / (max(n) * 20) * sum(sr * sr) - 15.0 * max(n)) / (1 - sum(tt) / (max(n) * 60)) AS chi2 FROM ft)"""


SIGNED = ["df AS (SELECT l0 - l3 AS d FROM ml WHERE l0 <> l3)",
    """wr AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(d)) AS ties FROM df)""",
    """wx AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS wp, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS wm, sum(CAST(ties AS DOUBLE) * ties - 1) AS tt FROM wr)"""]


@registry.add("r11_level_contrast", Q.query([CROSSED, MLR, FRIED, *SIGNED,
    "shp AS (SELECT count(*) FILTER (WHERE l3 > l0) AS scenes_rising, count(*) FILTER (WHERE l0 < l1 AND l1 < l2 AND l2 < l3) AS scenes_monotone FROM ml)"], """
SELECT blocks, round(chi2, 9) AS chi2, least(wp, wm) AS w, wp AS w_plus, wm AS w_minus,
  round((least(wp, wm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tt / 48.0), 9) AS z, scenes_rising, scenes_monotone
FROM chi CROSS JOIN wx CROSS JOIN shp"""))
def _(ws):
    return rounded(contrasts.level_contrast(matched(ws), "scene", LEVELS))


@registry.add("r11_level_p_values", Q.query([CROSSED, MLR, FRIED, *SIGNED,
    "zz AS (SELECT blocks, chi2, (least(wp, wm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tt / 48.0) AS z FROM chi CROSS JOIN wx)"],
    f"SELECT blocks, round({Q.chi2_p_three('chi2')}, 7) AS friedman_p, round({Q.normal_p('z')}, 7) AS wilcoxon_p FROM zz"))
def _(ws):
    tested = contrasts.with_level_p(contrasts.level_contrast(matched(ws), "scene", LEVELS), 4)
    return rounded(tested.select("blocks", "friedman_p", "wilcoxon_p"), 7)


@registry.add("r12_range_containment", Q.query([CROSSED], """
SELECT lo, hi, count(*) AS n, round(min(stat), 9) AS inner_min, round(max(stat), 9) AS inner_max, round(avg(CASE WHEN stat BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 9) AS share_inside
FROM cr CROSS JOIN (SELECT min(stat) AS lo, max(stat) AS hi FROM cr WHERE level = 3) WHERE level = 0 GROUP BY ALL""".replace("SELECT lo, hi,", "SELECT round(lo, 9) AS lo, round(hi, 9) AS hi,")))
def _(ws):
    return rounded(contrasts.containment(crossed(ws), F.col("level") == 0, F.col("level") == 3, "stat"))


@registry.add("r12_containment_contrast", Q.query([CROSSED,
    "f AS (SELECT 'l0-l3' AS g, level = 0 AS first, stat AS value FROM cr WHERE level IN (0, 3))", UTEST.format(o="ut", k="g", t="f"),
    "sc AS (SELECT count(DISTINCT scene % 10) AS base_scenes FROM cr WHERE level = 3)"], f"SELECT g, {UOUT}, base_scenes FROM ut CROSS JOIN sc"))
def _(ws):
    rows = crossed(ws).where("level IN (0, 3)").withColumns({"g": F.lit("l0-l3"), "first": F.col("level") == 0})
    base = rows.where("level = 3").groupBy("g").agg(F.count_distinct(F.col("scene") % 10).alias("base_scenes"))
    return _uout(contrasts.two_group(rows, ["g"], "first", "stat"), "g").join(base, "g")


@registry.add("r13_three_groupings", Q.query([*PROF,
    """f AS (SELECT 'provenance' AS g, synthetic AS first, hot_pixel_share AS value FROM prof
       UNION ALL SELECT 'provenance without A', synthetic, hot_pixel_share FROM prof WHERE synthetic OR scene <> 'A'
       UNION ALL SELECT 'corpus identity', dataset = 'ev', hot_pixel_share FROM prof)""", UTEST.format(o="ut", k="g", t="f")],
    f"SELECT g AS grouping, {UOUT} FROM ut"))
def _(ws):
    p = profiles(ws)
    rows = contrasts.groupings(p, KEY, {
        "provenance": F.col("synthetic"),
        "provenance without A": F.when(F.col("synthetic") | (F.col("scene") != "A"), F.col("synthetic")),
        "corpus identity": F.col("dataset") == "ev"})
    return _uout(contrasts.two_group(rows, ["grouping"], "first", "hot_pixel_share"), "grouping")


@registry.add("r13_duplicate_names", Q.query(PROF, "SELECT scene AS name, count(*) AS n FROM prof GROUP BY scene HAVING count(*) > 1"))
def _(ws):
    return contrasts.duplicate_names(profiles(ws).withColumn("name", F.col("scene")), "name")


@registry.add("r14_rate_association", Q.query([CROSSED, "c2 AS (SELECT 1 AS g, rate, stat FROM cr)", SPEAR.format(o="sp", k="g", x="rate", y="stat", t="c2")],
    "SELECT n, round(rho, 9) AS rho FROM sp"))
def _(ws):
    return rounded(ranks.spearman(crossed(ws).withColumn("g", F.lit(1)), ["g"], "rate", "stat").select("n", "rho"))


@registry.add("r14_rate_by_level", Q.query([CROSSED.replace("max(stat)", "max(rate)"), MLR, FRIED,
    "md AS (SELECT level, round(median(value), 9) AS median FROM mlr GROUP BY level)"],
    "SELECT level, median, round(chi2, 9) AS chi2 FROM md CROSS JOIN chi"))
def _(ws):
    m = matched(ws, "rate")
    chi = ranks.friedman(contrasts.level_rows(m, "scene", LEVELS).withColumn("g", F.lit(1)), ["g"], "scene", 4, "value")
    return rounded(contrasts.per_level(m, "scene", LEVELS).select("level", "median").withColumn("g", F.lit(1))
                   .join(chi.select("g", "chi2"), "g").drop("g"))


@registry.add("r14_rate_p_values", Q.query([CROSSED, "c2 AS (SELECT 1 AS g, rate, stat FROM cr)", SPEAR.format(o="sp", k="g", x="rate", y="stat", t="c2")],
    f"SELECT n, round(rho, 9) AS rho, round({Q.rho_p('rho', 'n')}, 7) AS p FROM sp"))
def _(ws):
    rho = ranks.spearman(crossed(ws).withColumn("g", F.lit(1)), ["g"], "rate", "stat")
    tested = rho.select("n", "rho", two_sided_t(ranks.rho_t(F.col("rho"), F.col("n")), F.col("n") - 2).alias("p"))
    return tested.select("n", F.round("rho", 9).alias("rho"), F.round("p", 7).alias("p"))


@registry.add("r15_blank_signature", Q.query([*PROF, "bl AS (SELECT median(hot_pixel_share) AS md, min(hot_pixel_share) AS mn, max(hot_pixel_share) AS mx FROM prof WHERE dataset = 'ev')"], """
SELECT dataset, round(avg(hot_pixel_share), 9) AS share_mean, count(*) FILTER (WHERE spatial_autocorr IS NULL) AS undefined_spatial_autocorr,
  count(*) FILTER (WHERE local_global_coupling IS NULL) AS undefined_local_global_coupling, round(any_value(md), 9) AS blank_median, round(any_value(mn), 9) AS blank_min,
  round(any_value(mx), 9) AS blank_max, round(any_value(md) / avg(hot_pixel_share), 9) AS ratio FROM prof CROSS JOIN bl GROUP BY dataset"""))
def _(ws):
    return rounded(contrasts.blank_signature(profiles(ws), "dataset", "ev", ["spatial_autocorr", "local_global_coupling"]))
