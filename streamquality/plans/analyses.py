"""Queries on corpus analyses over the curve table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ranks
from ..functions.numeric import micros
from ..operators import analysis, grid, metric, oracle, resample
from ..operators.downstream import condition_name, dedupe_conditions
from ..operators.order import assign_event_index, cap_events
from ..schema import RETENTION_PCT, method_table
from ..sources.tables import METHODS, read, scores
from . import sql as Q
from .base import Registry, rounded
from .controls import DELTA, points
from .outputs import AUC, CONTRAST, DRAWS, SPEAR, boot_ctes, native_contrasts
from .positions import FIRST, per_corpus

registry = Registry()
KEY = "recording_id"
C3 = "dataset, recording_id, method"

SUMM = f"""us AS (SELECT *, r_pct / 100.0 AS r FROM crv WHERE evaluable),
tz AS (SELECT {C3}, CASE WHEN max(r) > min(r) THEN sum(area) / (max(r) - min(r)) ELSE max(mesr) END AS auc_over_r, min(r) AS r_low, max(r) AS r_high, count(*) AS points, any_value(raw_mesr) AS raw_mesr
  FROM (SELECT *, (mesr + lag(mesr) OVER w) / 2 * (r - lag(r) OVER w) AS area FROM us WINDOW w AS (PARTITION BY {C3} ORDER BY r_pct)) GROUP BY {C3}),
bst AS (SELECT {C3}, r AS r_star, mesr AS mesr_star FROM us QUALIFY row_number() OVER (PARTITION BY {C3} ORDER BY round(mesr, 12) DESC, r_pct) = 1),
summ AS (SELECT *, r_star = r_low AS optimum_at_floor, mesr_star - raw_mesr AS delta_at_r_star FROM tz JOIN bst USING ({C3}))"""
FULL = [*Q.FULL, SUMM]
NPT = f"""npt AS (SELECT u.dataset, u.recording_id, u.method, n.native_retention, u.r_pct, u.r, u.mesr, u.raw_mesr, u.scene FROM us u JOIN nat n USING ({C3})
  QUALIFY row_number() OVER (PARTITION BY {C3} ORDER BY round(abs(u.r_pct / 100.0 - n.native_retention), 12), u.r_pct) = 1)"""
FLAGS = "flg AS (SELECT * FROM (VALUES ('raw', false, true, true), ('random_null', false, true, false), ('label_oracle', true, false, true), ('fa', false, false, true), ('fb', false, false, true), ('fc', false, false, true), ('sc', false, false, false)) t(method, is_oracle, is_null, has_native))"
NDL = f"""ndl AS (SELECT a.dataset, a.recording_id, a.method, a.native_retention, a.r, a.mesr - b.mesr AS delta, a.scene, abs(a.r - a.native_retention) <= 0.05 + 1e-9 AND abs(a.r - a.native_retention) <= 0.5 * a.native_retention + 1e-12 AS eligible
  FROM npt a JOIN npt b ON b.dataset = a.dataset AND b.recording_id = a.recording_id AND b.method = 'raw' JOIN flg ON flg.method = a.method WHERE has_native AND NOT is_oracle)"""
NATIVE = [*FULL, NPT, FLAGS, NDL]


def summary(ws) -> DataFrame:
    return ws.once("curve-summary", lambda: analysis.curve_summary(ws.curve()))


def native_points(ws) -> DataFrame:
    return ws.once("native-points", lambda: analysis.at_native(ws.curve(), ws.native()))


def methods(ws) -> DataFrame:
    return method_table(ws.spark, METHODS)


def scenes(ws) -> DataFrame:
    return ws.curve().select("dataset", KEY, "scene").distinct()


def deltas(ws, eligible_only=True) -> DataFrame:
    return analysis.native_deltas(native_points(ws), methods(ws), eligible_only)


@registry.add("m7_curve_summary", Q.query(FULL, f"""
SELECT {C3}, r_star, round(mesr_star, 9) AS mesr_star, round(auc_over_r, 9) AS auc_over_r, r_low, r_high, points, optimum_at_floor, round(raw_mesr, 9) AS raw_mesr,
  round(delta_at_r_star, 9) AS delta_at_r_star FROM summ"""))
def _(ws):
    return rounded(summary(ws))


@registry.add("n15_floor_pinned_share", Q.query(FULL, """
SELECT dataset, count(*) AS cells, count(*) FILTER (WHERE optimum_at_floor) AS floor_pinned, round(avg(CASE WHEN optimum_at_floor THEN 1.0 ELSE 0.0 END), 9) AS share FROM summ GROUP BY dataset"""))
def _(ws):
    return rounded(analysis.floor_pinned(summary(ws), ["dataset"]))


@registry.add("m8_restricted_trapezoid", Q.query([*FULL, f"""tr AS (SELECT {C3}, CASE WHEN max(r) > min(r) THEN sum(area) / (max(r) - min(r)) ELSE max(mesr) END AS auc
  FROM (SELECT *, (mesr + lag(mesr) OVER w) / 2 * (r - lag(r) OVER w) AS area FROM us WHERE r_pct BETWEEN 20 AND 80 WINDOW w AS (PARTITION BY {C3} ORDER BY r_pct)) GROUP BY {C3})"""],
    f"SELECT {C3}, round(auc, 9) AS auc FROM tr"))
def _(ws):
    cut = analysis.usable(ws.curve()).where("r_pct BETWEEN 20 AND 80")
    return rounded(analysis.trapezoid(cut, analysis.CELL))


@registry.add("m9_delta_over_raw", Q.query([*Q.BENCH, DELTA], f"SELECT {C3}, r_pct, round(delta, 9) AS delta FROM dl"))
def _(ws):
    return rounded(points(ws).select(*analysis.CELL, "r_pct", "delta"))


@registry.add("m10_protocol_row", Q.query([*FULL, FIRST], f"""
SELECT {C3}, r_star, round(mesr_star, 9) AS mesr_star, round(auc_over_r, 9) AS auc_over_r, r_low, r_high, points, optimum_at_floor, round(raw_mesr, 9) AS raw_mesr,
  round(delta_at_r_star, 9) AS delta_at_r_star, round(ntss, 9) AS ntss, round(ln, 9) AS ln, occ AS occupied_px, CAST(nn AS BIGINT) AS n_events FROM summ JOIN dec USING (dataset, recording_id)"""))
def _(ws):
    dec = per_corpus(lambda c: metric.decompose_first_slice(ws.stream(c), c.slice_size))
    return rounded(analysis.protocol_rows(ws.curve(), dec))


@registry.add("m11_method_ranking", Q.query([*FULL, "mm AS (SELECT dataset, method, avg(mesr_star) AS m FROM summ GROUP BY ALL)"], """
SELECT dataset, method, round(m, 9) AS mesr_star, row_number() OVER (PARTITION BY dataset ORDER BY round(m, 12) DESC, method) AS rank FROM mm"""))
def _(ws):
    means = summary(ws).groupBy("dataset", "method").agg(F.avg("mesr_star").alias("mesr_star"))
    return rounded(analysis.rank_methods(means, ["dataset"], "mesr_star", "rank"))


TAU = """{o} AS (SELECT {k}, sum(sign(xa - xb) * sign(ya - yb)) / sqrt(CAST(count(*) FILTER (WHERE xa <> xb) * count(*) FILTER (WHERE ya <> yb) AS DOUBLE)) AS tau FROM (
  SELECT {ka}, a.{x} AS xa, b.{x} AS xb, a.{y} AS ya, b.{y} AS yb FROM {t} a JOIN {t} b ON {on} AND a.method < b.method
  WHERE a.{x} IS NOT NULL AND b.{x} IS NOT NULL AND a.{y} IS NOT NULL AND b.{y} IS NOT NULL) GROUP BY {k})"""


def tau_cte(out, table, keys, x, y):
    ks = [k.strip() for k in keys.split(",")]
    return TAU.format(o=out, t=table, k=keys, x=x, y=y, ka=", ".join(f"a.{k} AS {k}" for k in ks),
                      on=" AND ".join(f"a.{k} = b.{k}" for k in ks))


@registry.add("m12_rank_agreement", Q.query([*FULL, "rsum AS (SELECT dataset, recording_id, method, round(mesr_star, 12) AS mesr_star, round(auc_over_r, 12) AS auc_over_r FROM summ)", SPEAR.format(o="sp", k="dataset, recording_id", x="mesr_star", y="auc_over_r", t="rsum"),
    tau_cte("kt", "rsum", "dataset, recording_id", "mesr_star", "auc_over_r")], """
SELECT dataset, recording_id, n, round(rho, 9) AS rho, round(tau, 9) AS tau FROM sp JOIN kt USING (dataset, recording_id)"""))
def _(ws):
    keys = ["dataset", KEY]
    # methods whose optimum is r = 1 share one value; rounding keeps that tie exact
    rows = summary(ws).select(*analysis.CELL, F.round("mesr_star", 12).alias("mesr_star"),
                              F.round("auc_over_r", 12).alias("auc_over_r"))
    rho = ranks.spearman(rows, keys, "mesr_star", "auc_over_r", small=True)
    tau = ranks.kendall(rows, keys, "method", "mesr_star", "auc_over_r")
    return rounded(rho.join(tau.select(*keys, "tau"), keys))


@registry.add("p17_eligibility", Q.query([*Q.FULL], f"""
SELECT dataset, recording_id, method, r_pct, abs(r_pct / 100.0 - native_retention) <= 0.05 + 1e-9 AND abs(r_pct / 100.0 - native_retention) <= 0.5 * native_retention + 1e-12 AS eligible
FROM nat CROSS JOIN grid"""))
def _(ws):
    g = F.explode(F.array(*[F.lit(p) for p in RETENTION_PCT])).alias("r_pct")
    return ws.native().select(*analysis.CELL, "native_retention", g).select(
        *analysis.CELL, "r_pct", oracle.eligible(F.col("native_retention"), F.col("r_pct") / 100.0).alias("eligible"))


@registry.add("p18_nearest_evaluable", Q.query([*FULL, NPT], f"""
SELECT {C3}, round(native_retention, 9) AS native_retention, r_pct, round(mesr, 9) AS mesr, round(raw_mesr, 9) AS raw_mesr FROM npt"""))
def _(ws):
    return rounded(native_points(ws))


@registry.add("p19_exact_grid_point", Q.query(Q.BENCH, f"SELECT {C3}, round(mesr, 9) AS mesr FROM crv WHERE r_pct = 55"))
def _(ws):
    return rounded(ws.curve().where("r_pct = 55").select(*analysis.CELL, "mesr"))


@registry.add("p22_condition_names", Q.query(Q.BENCH, """
SELECT dataset, recording_id, condition, kept_events FROM (SELECT *, CASE WHEN r_pct = 100 THEN 'all_r1.00' ELSE printf('%s_r%.2f', method, r_pct / 100.0) END AS condition FROM crv)
GROUP BY ALL"""))
def _(ws):
    named = ws.curve().withColumn("condition", condition_name(F.col("method"), F.col("r_pct")))
    return dedupe_conditions(named, ["dataset", KEY], "method").select("dataset", KEY, "condition", "kept_events")


MEANS = f"""mrow AS (SELECT s.dataset, s.method, avg(s.mesr_star) AS mesr_star, avg(delta_at_r_star) AS delta_at_r_star, avg(npt.mesr) AS mesr_at_native, avg(auc_over_r) AS auc_over_r,
  avg(r_star) AS r_star, avg(nat.native_retention) AS native_retention, count(*) AS recordings, any_value(is_oracle) AS is_oracle, any_value(is_null) AS is_null
  FROM summ s LEFT JOIN npt USING ({C3}) LEFT JOIN nat USING ({C3}) JOIN flg ON flg.method = s.method GROUP BY s.dataset, s.method)"""


def mean_rows(ws) -> DataFrame:
    return analysis.mean_rows(summary(ws), native_points(ws), ws.native(), methods(ws))


@registry.add("a1_mean_protocol_rows", Q.query([*FULL, NPT, FLAGS, MEANS], """
SELECT dataset, method, round(mesr_star, 9) AS mesr_star, round(delta_at_r_star, 9) AS delta_at_r_star, round(mesr_at_native, 9) AS mesr_at_native, round(auc_over_r, 9) AS auc_over_r,
  round(r_star, 9) AS r_star, round(native_retention, 9) AS native_retention, recordings, is_oracle, is_null FROM mrow"""))
def _(ws):
    return rounded(mean_rows(ws))


@registry.add("a2_native_deltas", Q.query(NATIVE, f"""
SELECT {C3}, round(native_retention, 9) AS native_retention, r, round(delta, 9) AS delta, eligible FROM ndl"""))
def _(ws):
    return rounded(deltas(ws, False))


CENSUS = f"""cen AS (SELECT dataset, method, eligible, count(*) AS cells, avg(delta) AS mean_delta, avg(native_retention) AS mean_native_r, avg(r) AS mean_scored_r,
  count(*) FILTER (WHERE native_retention < r_low) AS below_floor FROM ndl JOIN (SELECT {C3}, r_low FROM summ) USING ({C3}) WHERE method <> 'raw' GROUP BY ALL)"""


def census(ws) -> DataFrame:
    return analysis.eligibility_census(deltas(ws, False), summary(ws).select(*analysis.CELL, "r_low"))


@registry.add("a3_eligibility_census", Q.query([*NATIVE, CENSUS], """
SELECT dataset, method, eligible, cells, round(mean_delta, 9) AS mean_delta, round(mean_native_r, 9) AS mean_native_r, round(mean_scored_r, 9) AS mean_scored_r, below_floor FROM cen"""))
def _(ws):
    return rounded(census(ws))


@registry.add("a3_aggressiveness", Q.query([*NATIVE, CENSUS, "ce AS (SELECT * FROM cen WHERE eligible)",
    SPEAR.format(o="sp", k="dataset", x="mean_delta", y="mean_native_r", t="ce"), tau_cte("kt", "ce", "dataset", "mean_delta", "mean_native_r")],
    "SELECT dataset, n, round(rho, 9) AS rho, round(tau, 9) AS tau FROM sp LEFT JOIN kt USING (dataset)"))
def _(ws):
    return rounded(analysis.aggressiveness(census(ws)))


@registry.add("a4_common_support_floor", Q.query(Q.BENCH, """
SELECT dataset, max(lo) AS floor_r_pct FROM (SELECT dataset, recording_id, min(r_pct) AS lo FROM crv WHERE evaluable AND method = 'raw' GROUP BY ALL) GROUP BY dataset"""))
def _(ws):
    return analysis.common_support_floor(ws.curve())


@registry.add("a5_delta_at_common_floor", Q.query([*Q.BENCH, DELTA,
    "fl AS (SELECT dataset, max(lo) AS r_pct FROM (SELECT dataset, recording_id, min(r_pct) AS lo FROM crv WHERE evaluable AND method = 'raw' GROUP BY ALL) GROUP BY dataset)",
    "fx AS (SELECT dl.* FROM dl JOIN fl USING (dataset, r_pct))", *boot_ctes("fx", "bt", "dataset, method", "delta", "scene", DRAWS)], """
SELECT dataset, method, round(bt.mean, 9) AS mean, round(lo, 9) AS lo, round(hi, 9) AS hi, bt.n, n_clusters, excludes_zero, round(median, 9) AS median
FROM bt JOIN (SELECT dataset, method, median(delta) AS median FROM fx GROUP BY ALL) USING (dataset, method)"""))
def _(ws):
    floor = analysis.common_support_floor(ws.curve()).withColumnRenamed("floor_r_pct", "r_pct")
    return rounded(analysis.delta_at_fixed(points(ws).join(floor, ["dataset", "r_pct"]), DRAWS, "md5"))


REF = """rcd AS (SELECT c.scene AS part, CASE WHEN c.recording_id < 'h' THEN 'ND00' ELSE 'ND04' END AS level, c.recording_id, c.mesr, c.raw_mesr, c.kept_events / CAST(c.n_events AS DOUBLE) AS retention
  FROM crv c WHERE c.method = 'sc' AND c.r_pct = 5 + 5 * (c.n_events % 4)),
pub AS (SELECT part, level, round(avg(raw_mesr), 1) AS published FROM rcd GROUP BY ALL),
rc AS (SELECT r.part, r.level, avg(raw_mesr) AS raw_mesr, avg(raw_mesr) FILTER (WHERE mesr IS NOT NULL) AS raw_mesr_paired, avg(mesr) AS mesr, avg(retention) AS mean_retention,
  count(*) AS recordings, count(mesr) AS evaluable, any_value(published) AS published FROM rcd r JOIN pub p ON p.part = r.part AND p.level = r.level GROUP BY r.part, r.level)"""


def reference(ws):
    c = ws.curve().where((F.col("method") == "sc") & (F.col("r_pct") == 5 + 5 * (F.col("n_events") % 4)))
    records = c.select(F.col("scene").alias("part"), F.when(F.col(KEY) < "h", "ND00").otherwise("ND04").alias("level"),
                       KEY, "mesr", "raw_mesr", (F.col("kept_events") / F.col("n_events")).alias("retention"))
    published = records.groupBy("part", "level").agg(F.round(F.avg("raw_mesr"), 1).alias("published"))
    return analysis.reference_cells(records, published), records


@registry.add("a6_reference_cells", Q.query([*Q.BENCH, REF], """
SELECT part, level, round(raw_mesr, 9) AS raw_mesr, round(raw_mesr_paired, 9) AS raw_mesr_paired, round(mesr, 9) AS mesr, round(mean_retention, 9) AS mean_retention, recordings, evaluable,
  published, round(mesr - raw_mesr_paired, 9) AS delta_over_raw, round(mesr - published, 9) AS error FROM rc"""))
def _(ws):
    return rounded(reference(ws)[0])


@registry.add("a6_reference_summary", Q.query([*Q.BENCH, REF], """
SELECT round(avg(mesr - raw_mesr_paired), 9) AS mean_delta, round(min(mean_retention), 9) AS retention_min, round(max(mean_retention), 9) AS retention_max, round(avg(mesr - published), 9) AS error_mean,
  round(min(mesr - published), 9) AS error_min, round(max(mesr - published), 9) AS error_max, round(max(abs(mesr - published)), 9) AS error_max_abs, count(*) AS n_cells,
  CAST(sum(recordings) AS BIGINT) AS recordings, CAST(sum(evaluable) AS BIGINT) AS evaluable, (SELECT round(avg(mesr - raw_mesr), 9) FROM rcd WHERE mesr IS NOT NULL) AS pooled_delta,
  (SELECT count(*) FROM rcd WHERE mesr IS NOT NULL) AS pooled_n FROM rc"""))
def _(ws):
    cells, records = reference(ws)
    return rounded(analysis.reference_summary(cells, records))


@registry.add("a7_coverage", Q.query(Q.BENCH, """
SELECT dataset, r_pct, count(DISTINCT recording_id) AS recordings, count(*) AS cells FROM crv WHERE evaluable AND method <> 'label_oracle' GROUP BY ALL"""))
def _(ws):
    return analysis.coverage(ws.curve().where("method <> 'label_oracle'"))


SUPPORT = f"""sup AS (SELECT * FROM (SELECT dataset, recording_id, min(r_pct) AS lo, max(r_pct) AS hi FROM us GROUP BY ALL) JOIN (
  SELECT dataset, max(lo) AS common_lo, min(hi) AS common_hi, min(lo) AS full_lo, count(DISTINCT lo) AS floors FROM (SELECT dataset, recording_id, min(r_pct) AS lo, max(r_pct) AS hi FROM us GROUP BY ALL) GROUP BY dataset) USING (dataset)),
tg AS (SELECT u.*, v.support FROM us u JOIN sup s USING (dataset, recording_id) CROSS JOIN (VALUES ('own_range'), ('common_grid'), ('common_cohort')) v(support)
  WHERE CASE v.support WHEN 'own_range' THEN true WHEN 'common_grid' THEN r_pct BETWEEN common_lo AND common_hi ELSE lo <= full_lo AND hi >= common_hi AND r_pct BETWEEN full_lo AND common_hi END),
sa AS (SELECT {C3}, support, CASE WHEN max(r) > min(r) THEN sum(area) / (max(r) - min(r)) ELSE max(mesr) END AS auc FROM (
  SELECT *, (mesr + lag(mesr) OVER w) / 2 * (r - lag(r) OVER w) AS area FROM tg WINDOW w AS (PARTITION BY {C3}, support ORDER BY r_pct)) GROUP BY {C3}, support),
sv AS (SELECT dataset, support, method, avg(auc) AS auc, count(*) AS recordings FROM sa WHERE method <> 'label_oracle' GROUP BY ALL)"""


def plain(ws) -> DataFrame:
    return ws.curve().where("method <> 'label_oracle'")


@registry.add("a8_support_areas", Q.query([*FULL, SUPPORT], "SELECT dataset, support, method, round(auc, 9) AS auc, recordings FROM sv"))
def _(ws):
    return rounded(analysis.support_variants(plain(ws)))


@registry.add("a8_support_ranges", Q.query([*FULL, SUPPORT], """
SELECT dataset, recording_id, lo, hi, common_lo, common_hi, full_lo, floors, lo <= full_lo AND hi >= common_hi AS in_cohort, floors > 1 AS ragged FROM sup"""))
def _(ws):
    return analysis.supports(plain(ws))


@registry.add("a8_support_agreement", Q.query([*FULL, NPT, SUPPORT, "nm AS (SELECT dataset, method, avg(mesr) AS nat_m FROM npt WHERE method NOT IN ('label_oracle') GROUP BY ALL)",
    "sj AS (SELECT * FROM sv JOIN nm USING (dataset, method))", SPEAR.format(o="sp", k="dataset, support", x="auc", y="nat_m", t="sj"), tau_cte("kt", "sj", "dataset, support", "auc", "nat_m"),
    """df AS (SELECT dataset, support, bool_or(ra <> rb) AS differ FROM (SELECT *, row_number() OVER (PARTITION BY dataset, support ORDER BY round(auc, 12) DESC, method) AS ra,
       row_number() OVER (PARTITION BY dataset, support ORDER BY round(nat_m, 12) DESC, method) AS rb FROM sj) GROUP BY ALL)"""], """
SELECT dataset, support, n AS n_methods, round(rho, 9) AS rho, round(tau, 9) AS tau, differ FROM sp JOIN kt USING (dataset, support) JOIN df USING (dataset, support)"""))
def _(ws):
    native = native_points(ws).where("method <> 'label_oracle'").groupBy("dataset", "method").agg(F.avg("mesr").alias("nat_m"))
    rows = analysis.support_variants(plain(ws)).join(native, ["dataset", "method"])
    return rounded(analysis.agreement(rows, ["dataset", "support"], "auc", "nat_m"))


PAIRS = [*CONTRAST, "pd AS (SELECT dataset, recording_id, scene, method, v AS delta FROM con WHERE contrast = 'delta_over_raw')",
    "pm AS (SELECT dataset, method, row_number() OVER (PARTITION BY dataset ORDER BY round(avg(delta), 12) DESC, method) AS rk FROM pd GROUP BY dataset, method)",
    """pp AS (SELECT x.dataset, x.recording_id, x.scene, x.method AS a, y.method AS b, x.delta - y.delta AS diff, my.rk - mx.rk = 1 AS adjacent FROM pd x
       JOIN pd y ON y.dataset = x.dataset AND y.recording_id = x.recording_id JOIN pm mx ON mx.dataset = x.dataset AND mx.method = x.method JOIN pm my ON my.dataset = y.dataset AND my.method = y.method
       WHERE mx.rk < my.rk)"""]


def contrasts(ws, family) -> DataFrame:
    rows = native_contrasts(ws).select("dataset", KEY, "scene", "method", F.col("delta_over_raw").alias("delta"))
    return analysis.paired_contrasts(rows, DRAWS, "md5", family)


@registry.add("a9_paired_contrasts", Q.query([*PAIRS, *boot_ctes("pp", "bt", "dataset, a, b", "diff", "scene", DRAWS)], """
SELECT dataset, a, b, round(bt.mean, 9) AS mean, round(lo, 9) AS lo, round(hi, 9) AS hi, bt.n AS n_recordings, n_clusters, excludes_zero, round(md, 9) AS median_difference, round(sh, 9) AS share_a_above_b, adjacent
FROM bt JOIN (SELECT dataset, a, b, median(diff) AS md, avg(CASE WHEN diff > 1e-12 THEN 1.0 ELSE 0.0 END) AS sh, any_value(adjacent) AS adjacent FROM pp GROUP BY ALL) USING (dataset, a, b)"""))
def _(ws):
    return rounded(contrasts(ws, False))


@registry.add("a9_familywise_contrasts", Q.query([*PAIRS, "pn AS (SELECT dataset, 0.05 / count(DISTINCT (a, b)) AS alpha FROM pp GROUP BY dataset)",
    *boot_ctes("pp", "bt", "dataset, a, b", "diff", "scene", DRAWS, alpha="(0.05 / 3)")], """
SELECT dataset, a, b, round(alpha, 9) AS alpha, round(bt.mean, 9) AS mean, round(lo, 9) AS lo, round(hi, 9) AS hi, excludes_zero FROM bt JOIN pn USING (dataset)"""))
def _(ws):
    return rounded(contrasts(ws, True).select("dataset", "a", "b", "alpha", "mean", "lo", "hi", "excludes_zero"))


@registry.add("a9_contrast_counts", Q.query([*PAIRS, *boot_ctes("pp", "bt", "dataset, a, b", "diff", "scene", DRAWS)], """
SELECT dataset, count(*) AS pairs_total, count(*) FILTER (WHERE excludes_zero) AS pairs_resolved, bool_and(excludes_zero) FILTER (WHERE adjacent) AS adjacent_all_resolved
FROM bt JOIN (SELECT DISTINCT dataset, a, b, adjacent FROM pp) USING (dataset, a, b) GROUP BY dataset"""))
def _(ws):
    return analysis.contrast_counts(contrasts(ws, False))


CAPS = [1000, 1500, 4000]
CAPPED = [*Q.STREAMS, Q.GRID, Q.SCORED, "cscored AS (SELECT scored.*, cap FROM scored CROSS JOIN (VALUES (1000), (1500), (4000)) t(cap) WHERE event_idx < cap AND method IN ('raw', 'fa', 'fb', 'fc'))",
    *Q.curve_ctes("cscored", "cp", "dataset, recording_id, method, cap"),
    "cnat AS (SELECT dataset, recording_id, method, cap, avg(CASE WHEN score = 0 THEN 1.0 ELSE 0.0 END) AS nr FROM cscored GROUP BY ALL)",
    """cnp AS (SELECT dataset, recording_id, method, cap, mesr FROM cp JOIN cnat USING (dataset, recording_id, method, cap) WHERE mesr IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY dataset, recording_id, method, cap ORDER BY round(abs(r_pct / 100.0 - nr), 12), r_pct) = 1)""",
    "cdl AS (SELECT a.*, a.mesr - b.mesr AS delta FROM cnp a JOIN cnp b ON b.dataset = a.dataset AND b.recording_id = a.recording_id AND b.cap = a.cap AND b.method = 'raw')",
    f"""cc AS (SELECT {C3}, max(delta) - min(delta) AS spread, map_from_entries(list((cap, delta) ORDER BY cap)) AS by_cap, any_value(n_events) >= 1000 AS truncated FROM cdl
       JOIN (SELECT dataset, recording_id, count(*) AS n_events FROM s GROUP BY ALL) USING (dataset, recording_id) GROUP BY {C3} HAVING count(DISTINCT cap) = 3)"""]


def cap_curves(ws) -> DataFrame:
    def build():
        chosen = {m: c for m, c in scores().items() if m in ("raw", "fa", "fb", "fc")}
        out = None
        for cap in CAPS:
            part = per_corpus(lambda c: grid.curve(cap_events(ws.stream(c), cap), chosen, c.slice_size, c.block, RETENTION_PCT))
            part = part.withColumn("cap", F.lit(cap))
            out = part if out is None else out.unionByName(part)
        return out
    return ws.once("cap-curves", build)


def cap_deltas(ws) -> DataFrame:
    def build():
        parts = None
        curves = cap_curves(ws)
        for cap in CAPS:
            head = cap_events(ws.both(), cap)
            kept = head.groupBy("dataset", KEY).agg(F.lit(1.0).alias("raw"), *[F.avg(F.col(m).cast("double")).alias(m) for m in ("fa", "fb", "fc")])
            native = kept.unpivot(["dataset", KEY], ["raw", "fa", "fb", "fc"], "method", "native_retention")
            near = analysis.at_native(curves.where(F.col("cap") == cap), native)
            part = analysis.native_deltas(near, methods(ws), False).withColumn("cap", F.lit(cap))
            parts = part if parts is None else parts.unionByName(part)
        return parts
    return ws.once("cap-deltas", build)


def cap_cells(ws) -> DataFrame:
    return analysis.cap_cells(cap_deltas(ws), ws.recordings(), CAPS)


@registry.add("a10_cap_summary", Q.query(CAPPED, """
SELECT dataset, count(*) AS cells_compared, count(*) FILTER (WHERE truncated) AS cells_bound, count(*) FILTER (WHERE truncated AND method <> 'raw') AS cells_scored,
  round(max(spread) FILTER (WHERE truncated AND method <> 'raw'), 9) AS max, round(median(spread) FILTER (WHERE truncated AND method <> 'raw'), 9) AS median,
  round(avg(spread) FILTER (WHERE truncated AND method <> 'raw'), 9) AS mean, round(avg(CASE WHEN spread > 0.0092 THEN 1.0 ELSE 0.0 END) FILTER (WHERE truncated AND method <> 'raw'), 9) AS share_above_unit
FROM cc GROUP BY dataset"""))
def _(ws):
    return rounded(analysis.cap_summary(cap_cells(ws), 0.0092))


@registry.add("a10_cap_by_method", Q.query([*CAPPED, "cmn AS (SELECT dataset, method, cap, avg(delta) AS m FROM cdl JOIN cc USING (dataset, recording_id, method) WHERE truncated GROUP BY ALL)"], """
SELECT dataset, method, count(*) AS cells, round(max(spread), 9) AS max_spread, round(median(spread), 9) AS median_spread, round(any_value(ms), 9) AS mean_spread_across_caps
FROM cc JOIN (SELECT dataset, method, max(m) - min(m) AS ms FROM cmn GROUP BY ALL) USING (dataset, method) WHERE truncated GROUP BY dataset, method"""))
def _(ws):
    return rounded(analysis.cap_by_method(cap_cells(ws), CAPS))


@registry.add("a10_cap_worst", Q.query(CAPPED, f"""
SELECT {C3}, round(spread, 9) AS spread FROM cc WHERE truncated AND method <> 'raw' ORDER BY cc.spread DESC, {C3} LIMIT 10"""))
def _(ws):
    return rounded(analysis.cap_worst(cap_cells(ws)))


@registry.add("a11_cap_at_fixed_retention", Q.query([*CAPPED,
    f"""cf AS (SELECT a.dataset, a.recording_id, a.method, a.r_pct, max(a.mesr - b.mesr) - min(a.mesr - b.mesr) AS spread FROM cp a JOIN cp b ON b.dataset = a.dataset AND b.recording_id = a.recording_id AND b.cap = a.cap
       AND b.r_pct = a.r_pct AND b.method = 'raw' WHERE a.r_pct IN (50, 95) AND a.method <> 'raw' AND a.mesr IS NOT NULL AND b.mesr IS NOT NULL GROUP BY ALL HAVING count(DISTINCT a.cap) = 3)"""], """
SELECT dataset, r_pct, count(*) AS cells, round(median(spread), 9) AS median, round(max(spread), 9) AS max, round(avg(CASE WHEN spread > 0.0092 THEN 1.0 ELSE 0.0 END), 9) AS share_above_unit FROM cf GROUP BY ALL"""))
def _(ws):
    return rounded(analysis.cap_at_fixed(cap_curves(ws), [50, 95], CAPS, 0.0092))


@registry.add("a11_cap_range_changes", Q.query([*CAPPED, f"crg AS (SELECT {C3}, cap, min(r_pct) FILTER (WHERE mesr IS NOT NULL) AS lo, max(r_pct) FILTER (WHERE mesr IS NOT NULL) AS hi FROM cp GROUP BY ALL)"], f"""
SELECT dataset, count(*) AS cells, count(*) FILTER (WHERE same) AS identical_range FROM (SELECT {C3}, count(DISTINCT (lo, hi)) = 1 AS same FROM crg GROUP BY {C3} HAVING count(*) = 3) GROUP BY dataset"""))
def _(ws):
    return analysis.cap_range_changes(cap_curves(ws), CAPS)


@registry.add("a11_cap_means_all_recordings", Q.query([*CAPPED,
    "cmon AS (SELECT dataset, recording_id FROM cdl GROUP BY ALL HAVING count(DISTINCT cap) = 3)",
    "csz AS (SELECT dataset, count(*) AS recordings FROM cmon GROUP BY dataset)",
    "cme AS (SELECT dataset, method, cap, avg(delta) AS m, count(*) AS n FROM cdl JOIN cmon USING (dataset, recording_id) GROUP BY ALL)"], """
SELECT dataset, method, recordings, round(max(m) - min(m), 9) AS spread_across_caps FROM cme JOIN csz USING (dataset) WHERE n = recordings GROUP BY ALL HAVING count(*) = 3"""))
def _(ws):
    return rounded(analysis.cap_means(cap_deltas(ws), CAPS))


SIZES = [100, 200, 300, 500, 1000]
SWEEP = [*Q.STREAMS, "sizes AS (SELECT unnest([100, 200, 300, 500, 1000]) AS slice_size)",
    """k AS (SELECT s.* EXCLUDE (nsl), z.slice_size AS nsl, z.slice_size, m.method FROM s CROSS JOIN sizes z CROSS JOIN (VALUES ('fa'), ('fb'), ('fc'), ('whole')) m(method)
       WHERE CASE m.method WHEN 'fa' THEN fa WHEN 'fb' THEN fb WHEN 'fc' THEN fc ELSE true END)""", *Q.mesr_ctes("k", "m", "dataset, recording_id, method, slice_size"),
    f"swf AS (SELECT {C3}, slice_size, mesr FROM m WHERE method <> 'whole')",
    f"coh AS (SELECT {C3} FROM swf GROUP BY {C3} HAVING count(mesr) = 5)", f"swc AS (SELECT swf.* FROM swf JOIN coh USING ({C3}))",
    f"swr AS (SELECT a.*, b.mesr AS ref FROM swc a JOIN swc b ON b.dataset = a.dataset AND b.recording_id = a.recording_id AND b.method = a.method AND b.slice_size = 300)",
    tau_cte("kt", "swr", "dataset, recording_id, slice_size", "ref", "mesr"),
    """ktd AS (SELECT a.dataset, a.recording_id, a.slice_size, count(*) FILTER (WHERE sign(a.ref - b.ref) * sign(a.mesr - b.mesr) < 0) AS discordant, count(*) AS pairs FROM swr a JOIN swr b
       ON b.dataset = a.dataset AND b.recording_id = a.recording_id AND b.slice_size = a.slice_size AND a.method < b.method GROUP BY ALL)""",
    """tops AS (SELECT dataset, recording_id, slice_size, count(*) AS cohort, max(CASE WHEN t = 1 THEN method END) AS top, max(CASE WHEN tr = 1 THEN method END) AS top_reference FROM (
       SELECT *, row_number() OVER (PARTITION BY dataset, recording_id, slice_size ORDER BY round(mesr, 12) DESC, method) AS t,
       row_number() OVER (PARTITION BY dataset, recording_id, slice_size ORDER BY round(ref, 12) DESC, method) AS tr FROM swr) GROUP BY ALL)""",
    "agr AS (SELECT *, top <> top_reference AS top_changes FROM tops LEFT JOIN kt USING (dataset, recording_id, slice_size) LEFT JOIN ktd USING (dataset, recording_id, slice_size))"]


def sweep(ws) -> DataFrame:
    return ws.once("slice-sweep", lambda: per_corpus(lambda c: metric.slice_size_sweep(
        ws.stream(c).withColumn("whole", F.lit(True)), ["fa", "fb", "fc", "whole"], SIZES, c.block)))


def agreements(ws) -> DataFrame:
    return analysis.slice_rank_agreement(sweep(ws).where("method <> 'whole'"), 300, len(SIZES))


@registry.add("a12_slice_rank_agreement", Q.query(SWEEP, """
SELECT dataset, recording_id, slice_size, cohort, top, top_reference, round(tau, 9) AS tau, discordant, pairs, top_changes FROM agr"""))
def _(ws):
    return rounded(agreements(ws))


@registry.add("a12_paired_flips", Q.query([*SWEEP,
    """fl AS (SELECT a.dataset, a.method AS a, b.method AS b, a.slice_size, avg(a.mesr - b.mesr) AS diff, count(*) AS n_recordings FROM swc a JOIN swc b ON b.dataset = a.dataset AND b.recording_id = a.recording_id
       AND b.slice_size = a.slice_size AND a.method < b.method GROUP BY ALL)"""], """
SELECT x.dataset, x.a, x.b, x.slice_size, round(x.diff, 9) AS diff, x.n_recordings, sign(x.diff) <> sign(y.diff) AS flips FROM fl x JOIN fl y ON y.dataset = x.dataset AND y.a = x.a AND y.b = x.b AND y.slice_size = 300"""))
def _(ws):
    return rounded(analysis.slice_pair_flips(sweep(ws).where("method <> 'whole'"), 300, len(SIZES)))


@registry.add("a12_slice_summary", Q.query([*SWEEP, """agp AS (SELECT dataset, recording_id, bool_or(discordant > 0) AS ro, bool_or(top_changes) AS tc, min(tau) FILTER (WHERE slice_size <> 300) AS mt,
    sum(tau) FILTER (WHERE slice_size <> 300) AS st, count(tau) FILTER (WHERE slice_size <> 300) AS nt FROM agr WHERE cohort >= 2 GROUP BY ALL)"""], """
SELECT dataset, count(*) AS ranked_recordings, count(*) FILTER (WHERE ro) AS reordered, count(*) FILTER (WHERE tc) AS top_changed, round(min(mt), 9) AS min_tau, round(sum(st) / sum(nt), 9) AS mean_tau FROM agp GROUP BY dataset"""))
def _(ws):
    return rounded(analysis.slice_rank_summary(agreements(ws), 300))


REPEAT = """rp AS (SELECT concat(event_type, '/', CASE WHEN event_id % 2 = 0 THEN 'D-END' ELSE 'N-END' END, '/ND0', user_id % 4) AS cell, event_id % 3 AS rep, epoch_us(ts) AS t_us, event_id, CAST(user_id % 64 AS INTEGER) AS x,
  CAST((event_id * 7) % 48 AS INTEGER) AS y, 40 AS nsl FROM events),
rpi AS (SELECT *, row_number() OVER (PARTITION BY cell, rep ORDER BY t_us, event_id) - 1 AS event_idx FROM rp)"""
REPEATED = [REPEAT, *Q.mesr_ctes("rpi", "rm", "cell, rep"), """rcl AS (SELECT cell, count(*) AS repetitions, avg(mesr) AS mean, max(mesr) - min(mesr) AS spread, stddev_samp(mesr) AS sd, split_part(cell, '/', 2) AS lighting,
  split_part(cell, '/', 3) AS nd FROM rm GROUP BY cell)"""]


def repeat_cells(ws) -> DataFrame:
    def build():
        e = read(ws.spark, ws.sf_dir, "events").select(
            F.concat("event_type", F.lit("/"), F.when(F.col("event_id") % 2 == 0, "D-END").otherwise("N-END"), F.lit("/ND0"),
                     (F.col("user_id") % 4).cast("string")).alias("cell"),
            (F.col("event_id") % 3).cast("int").alias("rep"), micros("ts").alias("t_us"), "event_id",
            (F.col("user_id") % 64).cast("int").alias("x"), ((F.col("event_id") * 7) % 48).cast("int").alias("y"))
        return assign_event_index(e.withColumn(KEY, F.concat_ws("#", "cell", "rep")), [KEY], ["t_us", "event_id"], "repeat-order")
    streams = ws.once("repeat-streams", build)
    mesr = metric.mesr_unfiltered(streams, 40).withColumn("cell", F.split_part(KEY, F.lit("#"), F.lit(1)))
    return analysis.repeat_cells(mesr, "cell", "mesr", 3).withColumns({
        "lighting": F.split_part("cell", F.lit("/"), F.lit(2)), "nd": F.split_part("cell", F.lit("/"), F.lit(3))})


@registry.add("a13_repeat_cells", Q.query(REPEATED, """
SELECT cell, repetitions, round(mean, 9) AS mean, round(spread, 9) AS spread, round(sd, 9) AS sd, repetitions = 3 AS complete, lighting, nd FROM rcl"""))
def _(ws):
    return rounded(repeat_cells(ws))


@registry.add("a13_repeatability", Q.query(REPEATED, """
SELECT count(*) AS cells, round(avg(spread), 9) AS spread_mean, round(median(spread), 9) AS spread_median, round(min(spread), 9) AS spread_min, round(max(spread), 9) AS spread_max,
  round(sqrt(avg(sd * sd)), 9) AS pooled_sd, count(*) FILTER (WHERE spread > 0.1) AS cells_exceeding, round(avg(CASE WHEN spread > 0.1 THEN 1.0 ELSE 0.0 END), 9) AS share_exceeding,
  first(cell ORDER BY round(spread, 12) DESC, cell DESC) AS worst_cell FROM rcl WHERE repetitions >= 2"""))
def _(ws):
    return rounded(analysis.repeatability(repeat_cells(ws), 0.1))


@registry.add("a13_repeatability_by_level", Q.query(REPEATED, """
SELECT nd, lighting, CAST(grouping(nd) AS TINYINT) AS all_nd, CAST(grouping(lighting) AS TINYINT) AS all_lighting, round(median(spread), 9) AS median_spread, count(*) AS cells FROM rcl WHERE repetitions >= 2
GROUP BY GROUPING SETS ((nd), (lighting), ())"""))
def _(ws):
    return rounded(analysis.repeatability_by(repeat_cells(ws), ["nd", "lighting"]))


RDEP = f"""rd AS (SELECT {C3}, scene, min(mesr) AS min_mesr, max(mesr) AS max_mesr, max(mesr) - min(mesr) AS spread, count(*) AS points FROM us GROUP BY ALL),
rdx AS (SELECT {C3}, r_pct AS argmax_r_pct FROM us QUALIFY row_number() OVER (PARTITION BY {C3} ORDER BY round(mesr, 12) DESC, r_pct) = 1),
rdn AS (SELECT {C3}, r_pct AS argmin_r_pct FROM us QUALIFY row_number() OVER (PARTITION BY {C3} ORDER BY round(mesr, 12), r_pct) = 1)"""


@registry.add("a14_retention_dependence", Q.query([*FULL, RDEP], f"""
SELECT {C3}, round(min_mesr, 9) AS min_mesr, round(max_mesr, 9) AS max_mesr, round(spread, 9) AS spread, argmax_r_pct, argmin_r_pct, points FROM rd JOIN rdx USING ({C3}) JOIN rdn USING ({C3})"""))
def _(ws):
    return rounded(analysis.retention_dependence(ws.curve()))


SDEP = """sst AS (SELECT dataset, recording_id, slice_size, mesr, mesr >= lag(mesr) OVER (PARTITION BY dataset, recording_id ORDER BY slice_size) AS up FROM m WHERE method = 'whole'),
sdp AS (SELECT dataset, recording_id, count(*) AS sizes, max(mesr) - min(mesr) AS spread, bool_and(up) AS monotone_increasing FROM sst GROUP BY ALL HAVING count(*) >= 2)"""


@registry.add("a15_slice_dependence", Q.query([*SWEEP, SDEP], "SELECT dataset, recording_id, sizes, round(spread, 9) AS spread, monotone_increasing FROM sdp"))
def _(ws):
    return rounded(analysis.slice_dependence(sweep(ws).where("method = 'whole'"), ["dataset", KEY]))


@registry.add("a15_slice_spread_interval", Q.query([*SWEEP, SDEP, *boot_ctes("sdp", "bt", "dataset", "spread", "recording_id", DRAWS)], """
SELECT dataset, n, round(mean, 9) AS mean, round(stddev_samp(spread), 9) AS sd, round(min(spread), 9) AS min, round(max(spread), 9) AS max, round(any_value(lo), 9) AS lo, round(any_value(hi), 9) AS hi
FROM bt JOIN sdp USING (dataset) GROUP BY dataset, n, mean"""))
def _(ws):
    rows = analysis.slice_dependence(sweep(ws).where("method = 'whole'"), ["dataset", KEY])
    return rounded(resample.spread_summary(rows, ["dataset"], "spread", KEY, DRAWS, algorithm="md5"))


@registry.add("a16_spread_by_scene", Q.query([*FULL, RDEP], """
SELECT dataset, scene, method, count(*) AS n, round(avg(spread), 9) AS mean, round(min(spread), 9) AS min, round(max(spread), 9) AS max FROM rd GROUP BY ALL"""))
def _(ws):
    rows = analysis.retention_dependence(ws.curve(), ["dataset", KEY, "scene", "method"])
    return rounded(analysis.spread_by_scene(rows, ["dataset", "scene", "method"]))


EXT = """xs AS (SELECT dataset, recording_id, label, CASE WHEN event_idx % 50 = 0 THEN 2.0 ELSE sc / 100000 END AS score FROM s), xk AS (SELECT * FROM xs WHERE score <> 2.0)"""


@registry.add("a17_operating_point", Q.query([*Q.STREAMS, EXT, AUC.format(t="xk", k="dataset, recording_id"),
    "xb AS (SELECT dataset, recording_id, count(*) AS events, count(*) FILTER (WHERE score <> 2.0) AS scored, avg(CASE WHEN score < 0.005 THEN 1.0 ELSE 0.0 END) AS rr FROM xs GROUP BY ALL)"], """
SELECT dataset, recording_id, events, scored, round(rr, 9) AS released_retention, round(auc, 9) AS auc FROM xb JOIN auc USING (dataset, recording_id)"""))
def _(ws):
    s = ws.both().withColumn("score", F.when(F.col("event_idx") % 50 == 0, 2.0).otherwise(F.col("sc") / 100000))
    return rounded(analysis.operating_point(s, "score", 0.005, 2.0))


@registry.add("a18_effect_ratios", Q.query([*FULL, RDEP, DELTA,
    "fxr AS (SELECT dataset, 'operating point' AS effect, avg(spread) AS value FROM rd WHERE method = 'sc' GROUP BY dataset UNION ALL SELECT dataset, 'random control', avg(delta) FROM dl WHERE method = 'random_null' AND r_pct = 20 GROUP BY dataset)",
    "flr AS (SELECT max(raw_mesr) - min(raw_mesr) AS fl FROM crv)"], """
SELECT dataset, effect, round(value, 9) AS value, round(value / 0.0092, 9) AS over_gap, round(value / fl, 9) AS over_floor, value / fl >= 2 AS survives FROM fxr CROSS JOIN flr"""))
def _(ws):
    a = analysis.retention_dependence(ws.curve()).where("method = 'sc'").groupBy("dataset").agg(F.avg("spread").alias("value")).withColumn("effect", F.lit("operating point"))
    b = points(ws).where("method = 'random_null' AND r_pct = 20").groupBy("dataset").agg(F.avg("delta").alias("value")).withColumn("effect", F.lit("random control"))
    floor = ws.curve().agg((F.max("raw_mesr") - F.min("raw_mesr")).alias("floor"))
    return rounded(analysis.effect_ratios(a.unionByName(b), 0.0092, floor))


@registry.add("a19_mean_delta_curve", Q.query([*Q.BENCH, DELTA], """
SELECT dataset, method, round(r_pct / 100.0, 4) AS r, round(avg(delta), 9) AS delta, count(*) AS n FROM dl GROUP BY ALL"""))
def _(ws):
    return rounded(analysis.mean_delta_curve(points(ws)))


def _agr(name, a, b):
    return [SPEAR.format(o=f"sp_{name}", k="dataset", x=a, y=b, t="pool"), tau_cte(f"kt_{name}", "pool", "dataset", a, b),
            f"""df_{name} AS (SELECT dataset, bool_or(ra <> rb) AS differ FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round({a}, 12) DESC, method) AS ra,
              row_number() OVER (PARTITION BY dataset ORDER BY round({b}, 12) DESC, method) AS rb FROM pool) GROUP BY dataset)"""]


AGR = [("star_native", "mesr_star", "mesr_at_native"), ("star_auc", "mesr_star", "auc_over_r"), ("auc_native", "auc_over_r", "mesr_at_native")]


@registry.add("a20_rank_report", Q.query([*FULL, NPT, FLAGS, MEANS, "pool AS (SELECT * FROM mrow WHERE NOT is_oracle AND method <> 'random_null' AND mesr_at_native IS NOT NULL)",
    "psz AS (SELECT dataset, count(*) AS n_methods FROM pool GROUP BY dataset)",
    "pms AS (SELECT dataset, string_agg(method, ',' ORDER BY method) AS without_native FROM mrow WHERE NOT is_oracle AND mesr_at_native IS NULL GROUP BY dataset)",
    *[c for a in AGR for c in _agr(*a)]], "SELECT dataset, n_methods, without_native, CASE WHEN n_methods >= 4 THEN 'decided' ELSE 'undecidable' END AS status, " + ", ".join(
    f"CASE WHEN n_methods >= 4 THEN round(sp_{n}.rho, 9) END AS rho_{n}, CASE WHEN n_methods >= 4 THEN round(kt_{n}.tau, 9) END AS tau_{n}, CASE WHEN n_methods >= 4 THEN df_{n}.differ END AS differ_{n}" for n, _, _ in AGR)
    + " FROM psz LEFT JOIN pms USING (dataset) " + " ".join(f"LEFT JOIN sp_{n} USING (dataset) LEFT JOIN kt_{n} USING (dataset) LEFT JOIN df_{n} USING (dataset)" for n, _, _ in AGR)))
def _(ws):
    # the block-prefix control stands in the ranking here, so that four methods have a native point
    rows = mean_rows(ws).withColumn("is_null", F.col("method") == "random_null")
    return rounded(analysis.rank_report(rows)).withColumn("without_native", F.array_join("without_native", ","))


@registry.add("o9_oracle_violations", Q.query([*FULL, FLAGS,
    f"""ov AS (SELECT a.dataset, a.recording_id, a.method, a.r_star, a.mesr_star - o.mesr_star AS margin, nat.native_retention FROM summ a JOIN summ o ON o.dataset = a.dataset AND o.recording_id = a.recording_id AND o.method = 'label_oracle'
       JOIN flg ON flg.method = a.method LEFT JOIN nat ON nat.dataset = a.dataset AND nat.recording_id = a.recording_id AND nat.method = a.method WHERE a.method <> 'label_oracle' AND NOT is_null)"""], """
SELECT dataset, count(*) AS comparable_cells, count(*) FILTER (WHERE margin > 1e-12) AS cells_beating_oracle, count(*) FILTER (WHERE margin > 1e-12 AND abs(r_star - native_retention) <= 0.05 + 1e-9) AS violations_at_native,
  round(max(margin), 9) AS max_margin, round(avg(margin), 9) AS mean_margin, first(CASE WHEN margin > 1e-12 THEN method END ORDER BY round(margin, 12) DESC, method) AS worst_method FROM ov GROUP BY dataset"""))
def _(ws):
    best = summary(ws).join(ws.native(), analysis.CELL, "left").join(methods(ws).select("method", "is_null"), "method")
    return rounded(oracle.oracle_violations(best, "label_oracle", 0.05))
