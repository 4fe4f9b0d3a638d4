"""Queries on downstream utility."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ranks
from ..functions.numeric import div
from ..operators import downstream, metric
from ..sources.tables import EVENT_STREAM, read
from . import sql as Q
from .base import Registry, rounded
from .controls import PRED, predictions
from .outputs import SPEAR
from .scans import INTERVALS, clips

registry = Registry()
KEY = "recording_id"
PCTS = [10, 30, 50, 70, 90, 100]
METHOD_IDS = {"raw": 1, "random_null": 2, "label_oracle": 3, "fa": 4, "fb": 5, "fc": 6, "sc": 7}
SEEDS = [1, 2, 3]


def threshold(method_id, r_pct, seed):
    """Cut below which a stored prediction is wrong, per method, retention and training seed."""
    return (method_id * 11 + r_pct // 2 + seed * 5 + 3) % 47


RUNS = f"""hist AS (SELECT CAST(floor(value * 37) AS BIGINT) % 50 AS bin, count(*) AS n FROM events GROUP BY ALL),
dsn AS (SELECT m.method, m.id, g.r_pct, sd.seed, ((CASE WHEN g.r_pct = 100 THEN 0 ELSE m.id END) * 11 + g.r_pct // 2 + sd.seed * 5 + 3) % 47 AS cut FROM (VALUES
  {', '.join(f"('{m}', {i})" for m, i in METHOD_IDS.items())}) m(method, id) CROSS JOIN (SELECT r_pct FROM grid WHERE r_pct IN (10, 30, 50, 70, 90, 100)) g CROSS JOIN (VALUES (1), (2), (3)) sd(seed)),
acc AS (SELECT method, r_pct, seed, CAST(sum(n) FILTER (WHERE bin > cut) AS DOUBLE) / sum(n) AS accuracy FROM dsn CROSS JOIN hist GROUP BY ALL),
mm AS (SELECT dataset, method, r_pct, avg(mesr) AS mesr, sum(kept_events) / CAST(sum(n_events) AS DOUBLE) AS kept_fraction FROM crv WHERE r_pct IN (10, 30, 50, 70, 90, 100) GROUP BY ALL),
runs AS (SELECT mm.dataset, acc.method, acc.r_pct, seed, accuracy, round(mesr, 12) AS mesr, kept_fraction FROM acc JOIN mm USING (method, r_pct)),
cnd AS (SELECT dataset, method, r_pct, round(avg(accuracy), 12) AS accuracy, stddev_samp(accuracy) AS accuracy_sd, any_value(mesr) AS mesr, any_value(kept_fraction) AS kept_fraction FROM runs GROUP BY dataset, method, r_pct)"""
COND = [*Q.BENCH, RUNS]


def runs(ws) -> DataFrame:
    """Accuracy of every (method, retention, seed) next to the corpus MESR.

    Predictions are folded to a 50-bin histogram first, so conditions cost nothing per event.
    """
    def build():
        e = read(ws.spark, ws.sf_dir, "events")
        bins = e.groupBy((F.floor(F.col("value") * 37) % 50).alias("bin")).agg(F.count("*").alias("n"))
        cells = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(p).alias("r_pct"), F.lit(s).alias("seed"),
                                   F.lit(threshold(0 if p == 100 else i, p, s)).alias("cut"))
                          for m, i in METHOD_IDS.items() for p in PCTS for s in SEEDS])
        acc = bins.select("bin", "n", F.inline(cells)).groupBy("method", "r_pct", "seed").agg(
            (F.sum(F.when(F.col("bin") > F.col("cut"), F.col("n"))) / F.sum("n")).alias("accuracy"))
        mesr = ws.curve().where(F.col("r_pct").isin(PCTS)).groupBy("dataset", "method", "r_pct").agg(
            F.round(F.avg("mesr"), 12).alias("mesr"), (F.sum("kept_events") / F.sum("n_events")).alias("kept_fraction"))
        return acc.join(mesr, ["method", "r_pct"])
    return ws.once("runs", build)


def conditions(ws) -> DataFrame:
    c = downstream.aggregate_conditions(runs(ws), ["dataset"])
    return c.withColumn("accuracy", F.round("accuracy", 12))


@registry.add("w1_voxel_grid", Q.query([Q.EV, INTERVALS.format(minimum=12), """vx AS (SELECT clip, CAST(least((t_rel - mn) * 8 // greatest(mx - mn, 1), 7) AS INTEGER) AS bin, y, x, p FROM cs
  JOIN (SELECT clip, min(t_rel) AS mn, max(t_rel) AS mx FROM cs GROUP BY clip) USING (clip))"""], """
SELECT clip, bin, y, x, CAST(sum(CASE WHEN p > 0 THEN 1 ELSE -1 END) AS BIGINT) AS v FROM vx GROUP BY ALL"""))
def _(ws):
    return downstream.voxel_grid(downstream.clip_samples(clips(ws), None, 12))


@registry.add("w2_equal_count_frames", Q.query([Q.EV, INTERVALS.format(minimum=12), """fr AS (SELECT clip, CAST(CASE WHEN full_n // 16 = 0 THEN 15 ELSE least(j // (full_n // 16), 15) END AS INTEGER) AS frame, p, y, x FROM cs)"""], """
SELECT clip, frame, p, y, x, count(*) AS n FROM fr GROUP BY ALL"""))
def _(ws):
    return downstream.number_frames(downstream.clip_samples(clips(ws), None, 12))


SHARE = """ksz AS (SELECT clip, g.r_pct, n, CAST(n // 4 * greatest(1, round_even(4 * g.r, 0)) + CASE WHEN n % 4 > 0 THEN greatest(1, round_even((n % 4) * g.r, 0)) ELSE 0 END AS BIGINT) AS kept FROM cn CROSS JOIN grid g WHERE g.r_pct IN (40, 60, 100))"""


@registry.add("w3_scored_share", Q.query([Q.EV, Q.GRID, INTERVALS.format(minimum=1), SHARE], """
SELECT clip, n, r_pct, CAST(kept AS BIGINT) AS kept, CAST(kept // 5 * 5 AS BIGINT) AS scored, round((kept // 5 * 5) / CAST(kept AS DOUBLE), 9) AS scored_share FROM ksz"""))
def _(ws):
    sizes = clips(ws).groupBy("clip").agg(F.count("*").alias("n"))
    return rounded(downstream.scored_share(sizes, "n", [40, 60, 100], 4, 5))


PARTIAL = """{o} AS (SELECT {k}, count(*) AS n, CASE WHEN count(*) >= 4 THEN (corr(rx, ry) - corr(rx, rc) * corr(ry, rc)) / sqrt((1 - corr(rx, rc) * corr(rx, rc)) * (1 - corr(ry, rc) * corr(ry, rc))) END AS rho FROM (
  SELECT {k}, rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY {k} ORDER BY {y}) + (count(*) OVER (PARTITION BY {k}, {y}) - 1) / 2.0 AS ry,
    rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0 AS rc FROM {t}) GROUP BY {k})"""


@registry.add("w4_partial_spearman", Q.query([*COND, "cm AS (SELECT * FROM cnd WHERE mesr IS NOT NULL)", PARTIAL.format(o="ps", k="dataset", x="mesr", y="accuracy", c="r_pct", t="cm")],
    "SELECT dataset, n, round(rho, 9) AS rho FROM ps"))
def _(ws):
    return rounded(ranks.partial_spearman(conditions(ws).where("mesr IS NOT NULL"), ["dataset"], "mesr", "accuracy", "r_pct", small=True))


WITHIN = [*COND, "cb AS (SELECT * FROM cnd WHERE r_pct < 100 AND mesr IS NOT NULL)", SPEAR.format(o="wr", k="dataset, r_pct", x="mesr", y="accuracy", t="cb")]


@registry.add("w5_within_retention", Q.query(WITHIN, "SELECT dataset, r_pct, n, round(rho, 9) AS rho FROM wr"))
def _(ws):
    return rounded(downstream.within_retention(conditions(ws), ["dataset"]))


@registry.add("w5_within_retention_per_seed", Q.query([*COND, "rb AS (SELECT * FROM runs WHERE r_pct < 100 AND mesr IS NOT NULL)", SPEAR.format(o="wr", k="dataset, seed, r_pct", x="mesr", y="accuracy", t="rb")], """
SELECT dataset, seed, round(avg(rho), 9) AS mean_rho, count(*) AS levels FROM wr WHERE rho IS NOT NULL GROUP BY ALL"""))
def _(ws):
    per = downstream.within_retention(runs(ws), ["dataset", "seed"])
    return rounded(downstream.mean_within(per, ["dataset", "seed"]))


@registry.add("w5_fisher_combination", Q.query([*WITHIN, f"wp AS (SELECT dataset, {Q.rho_p('rho', 'n')} AS p FROM wr WHERE n >= 3 AND rho IS NOT NULL)",
    "fx AS (SELECT dataset, -2 * sum(ln(p)) AS x, count(*) AS levels FROM wp GROUP BY dataset)"],
    f"SELECT dataset, levels, round({Q.chi2_p_even('x', 'levels')}, 7) AS fisher_p FROM fx"))
def _(ws):
    tested = downstream.fisher(downstream.within_retention(conditions(ws), ["dataset"]), ["dataset"])
    return rounded(tested.select("dataset", "levels", "fisher_p"), 7)


@registry.add("w6_detectable_rho", Q.query([*COND, "nn AS (SELECT dataset, count(mesr) AS n FROM cnd GROUP BY dataset)"], f"""
SELECT dataset, n, round(tanh({downstream.probit(0.975)!r} / sqrt(n - 3.0)), 9) AS min_detectable_rho FROM nn"""))
def _(ws):
    sizes = conditions(ws).groupBy("dataset").agg(F.count("mesr").alias("n"))
    return rounded(downstream.detectable_rho(sizes))


def _power(target: float) -> str:
    x = f"(atanh({target}) * sqrt(n - 3.0) - {downstream.probit(0.975)!r})"
    return f"round(0.5 * (1 + sign({x}) * (1 - {Q.normal_p(x)})), 7)"


@registry.add("w6_power", Q.query([*COND, "nn AS (SELECT dataset, count(mesr) AS n FROM cnd GROUP BY dataset)"],
    f"SELECT dataset, n, {_power(0.3)} AS power_3, {_power(0.5)} AS power_5 FROM nn"))
def _(ws):
    sizes = conditions(ws).groupBy("dataset").agg(F.count("mesr").alias("n"))
    return rounded(downstream.with_power(sizes, [0.3, 0.5]), 7)


COHORTS = [*COND, """cf AS (SELECT *, row_number() OVER (PARTITION BY dataset, r_pct ORDER BY method) AS i FROM cnd WHERE mesr IS NOT NULL),
ch AS (SELECT 'all' AS cohort, * FROM cf UNION ALL SELECT 'excluding_r1', * FROM cf WHERE r_pct < 100 UNION ALL SELECT 'distinct_inputs', * FROM cf WHERE r_pct < 100 OR i = 1)""",
    SPEAR.format(o="s1", k="dataset, cohort", x="mesr", y="accuracy", t="ch"), SPEAR.format(o="s2", k="dataset, cohort", x="r_pct", y="accuracy", t="ch"),
    SPEAR.format(o="s3", k="dataset, cohort", x="r_pct", y="mesr", t="ch"), PARTIAL.format(o="s4", k="dataset, cohort", x="mesr", y="accuracy", c="r_pct", t="ch")]


@registry.add("w7_condition_summary", Q.query(COHORTS, """
SELECT dataset, cohort, s1.n, round(s1.rho, 9) AS rho, round(s4.rho, 9) AS partial_rho, round(s2.rho, 9) AS retention_accuracy, round(s3.rho, 9) AS retention_mesr
FROM s1 JOIN s2 USING (dataset, cohort) JOIN s3 USING (dataset, cohort) JOIN s4 USING (dataset, cohort)"""))
def _(ws):
    return rounded(downstream.condition_summary(conditions(ws)))


@registry.add("w7_p_values", Q.query(COHORTS, f"""
SELECT dataset, cohort, s1.n, round({Q.rho_p('s1.rho', 's1.n')}, 7) AS rho_p, round({Q.rho_p('s4.rho', 's1.n', 1)}, 7) AS partial_rho_p
FROM s1 JOIN s4 USING (dataset, cohort)"""))
def _(ws):
    rows = downstream.condition_summary(conditions(ws))
    tested = downstream.with_rho_p(downstream.with_rho_p(rows, "rho", "n"), "partial_rho", "n", 1)
    return rounded(tested.select("dataset", "cohort", "n", "rho_p", "partial_rho_p"), 7)


@registry.add("w8_condition_table", Q.query(COND, """
SELECT dataset, method, r_pct, round(accuracy, 9) AS accuracy, round(accuracy_sd, 9) AS accuracy_sd, round(mesr, 9) AS mesr, round(kept_fraction, 9) AS kept_fraction FROM cnd"""))
def _(ws):
    return rounded(conditions(ws).drop("accuracy_per_seed"))


DIFFS = [*COND, """df AS (SELECT a.dataset, a.r_pct, a.method AS a, b.method AS b, count(*) AS n_seeds, avg(a.accuracy - b.accuracy) AS mean_difference, stddev_samp(a.accuracy - b.accuracy) AS sd_of_difference,
  stddev_samp(a.accuracy) AS marginal_sd_a, stddev_samp(b.accuracy) AS marginal_sd_b, abs(avg(a.accuracy - b.accuracy)) > stddev_samp(a.accuracy - b.accuracy) AS resolved,
  bool_and(a.accuracy - b.accuracy > 0) OR bool_and(a.accuracy - b.accuracy < 0) AS sign_consistent FROM runs a JOIN runs b ON b.dataset = a.dataset AND b.r_pct = a.r_pct AND b.seed = a.seed AND a.method < b.method
  WHERE a.r_pct < 100 GROUP BY ALL)"""]


@registry.add("w9_paired_seed_differences", Q.query(DIFFS, """
SELECT dataset, r_pct, a, b, n_seeds, round(mean_difference, 9) AS mean_difference, round(sd_of_difference, 9) AS sd_of_difference, round(marginal_sd_a, 9) AS marginal_sd_a,
  round(marginal_sd_b, 9) AS marginal_sd_b, resolved, sign_consistent FROM df"""))
def _(ws):
    return rounded(downstream.seed_differences(runs(ws), ["dataset"]))


@registry.add("w9_difference_summary", Q.query([*DIFFS, "mg AS (SELECT dataset, median(m) AS mm FROM (SELECT dataset, marginal_sd_a AS m FROM df UNION ALL SELECT dataset, marginal_sd_b FROM df) GROUP BY dataset)"], """
SELECT dataset, count(*) AS n_pairs, count(*) FILTER (WHERE resolved) AS n_resolved, count(*) FILTER (WHERE sign_consistent) AS n_sign_consistent, round(median(sd_of_difference), 9) AS median_paired_sd,
  round(median(abs(mean_difference)), 9) AS median_abs_mean_difference, round(any_value(mm), 9) AS median_marginal_sd, round(any_value(mm) / nullif(median(sd_of_difference), 0), 9) AS marginal_over_paired_sd
FROM df JOIN mg USING (dataset) GROUP BY dataset"""))
def _(ws):
    return rounded(downstream.difference_summary(downstream.seed_differences(runs(ws), ["dataset"]), ["dataset"]))


DROPS = [*COND, "dr AS (SELECT c.*, d.dropped FROM cnd c CROSS JOIN (VALUES ('none'), ('fa'), ('fb'), ('sc')) d(dropped) WHERE c.method <> d.dropped AND mesr IS NOT NULL)", "drb AS (SELECT * FROM dr WHERE r_pct < 100)"]


def drops(ws) -> DataFrame:
    return downstream.drop_scenarios(conditions(ws), ["fa", "fb", "sc"])


@registry.add("w10_leave_one_out_pooled", Q.query([*DROPS, SPEAR.format(o="sp", k="dataset, dropped", x="mesr", y="accuracy", t="dr")],
    "SELECT dataset, dropped, n, round(rho, 9) AS rho FROM sp"))
def _(ws):
    return rounded(ranks.spearman(drops(ws), ["dataset", "dropped"], "mesr", "accuracy", small=True))


@registry.add("w10_leave_one_out_within", Q.query([*DROPS, SPEAR.format(o="sp", k="dataset, dropped, r_pct", x="mesr", y="accuracy", t="drb")], """
SELECT dataset, dropped, round(avg(rho), 9) AS mean_rho, count(*) AS levels FROM sp WHERE rho IS NOT NULL GROUP BY ALL"""))
def _(ws):
    per = downstream.within_retention(drops(ws), ["dataset", "dropped"])
    return rounded(downstream.mean_within(per, ["dataset", "dropped"]))


@registry.add("w10_inversion", Q.query([*DROPS, """iv AS (SELECT *, row_number() OVER (PARTITION BY dataset, dropped, r_pct ORDER BY round(accuracy, 12), method) AS ar, count(*) OVER (PARTITION BY dataset, dropped, r_pct) AS methods FROM drb)"""], """
SELECT dataset, dropped, r_pct, method AS top_mesr_method, round(accuracy, 9) AS accuracy, ar AS accuracy_rank, methods FROM iv
QUALIFY row_number() OVER (PARTITION BY dataset, dropped, r_pct ORDER BY round(mesr, 12) DESC, method DESC) = 1"""))
def _(ws):
    return rounded(downstream.inversion(drops(ws), ["dataset", "dropped"])).withColumn(
        "accuracy_rank", F.col("accuracy_rank").cast("bigint"))


TIES = [*COND, """tb AS (SELECT dataset, seed, r_pct, method, accuracy, mesr, mesr = max(mesr) OVER w AS mx, accuracy = max(accuracy) OVER w AS ax, accuracy = min(accuracy) OVER w AS an FROM runs
  WHERE r_pct IN (50, 100) AND mesr IS NOT NULL WINDOW w AS (PARTITION BY dataset, seed, r_pct))"""]


def tie_runs(ws) -> DataFrame:
    return runs(ws).where("r_pct IN (50, 100) AND mesr IS NOT NULL")


@registry.add("w11_tie_break_summary", Q.query(TIES, """
SELECT dataset, seed, r_pct, string_agg(method, ',' ORDER BY method) FILTER (WHERE mx) AS top_mesr, string_agg(method, ',' ORDER BY method) FILTER (WHERE ax) AS most_accurate,
  string_agg(method, ',' ORDER BY method) FILTER (WHERE an) AS least_accurate, bool_or(mx AND an) AS top_mesr_least_accurate FROM tb GROUP BY ALL"""))
def _(ws):
    return downstream.tie_break_summary(tie_runs(ws), ["dataset", "seed", "r_pct"])


MATCHED = [PRED, Q.EV, """sl AS (SELECT recording_id, event_idx // 150 AS slice FROM ev GROUP BY ALL HAVING count(*) = 150),
ok AS (SELECT e.event_id AS clip FROM ev e JOIN sl ON sl.recording_id = e.recording_id AND sl.slice = e.event_idx // 150)"""]


@registry.add("w12_matched_cohort_accuracy", Q.query(MATCHED, """
SELECT condition, count(*) AS clips, round(avg(CASE WHEN prediction = target THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pred WHERE clip IN (SELECT clip FROM ok) GROUP BY ALL"""))
def _(ws):
    s = ws.stream(EVENT_STREAM).select(F.col("source_idx").alias("clip"), KEY, div("event_idx", 150).alias("slice"))
    whole = s.groupBy(KEY, "slice").agg(F.count("*").alias("n")).where("n = 150").select(KEY, "slice")
    return rounded(downstream.cohort_accuracy(predictions(ws), s.join(whole, [KEY, "slice"]), ["condition"]))


@registry.add("w12_per_retention_summary", Q.query([*COND, """tb AS (SELECT dataset, r_pct, method, accuracy, mesr, mesr = max(mesr) OVER w AS mx, accuracy = max(accuracy) OVER w AS ax, accuracy = min(accuracy) OVER w AS an FROM cnd
  WHERE mesr IS NOT NULL WINDOW w AS (PARTITION BY dataset, r_pct))"""], """
SELECT dataset, r_pct, string_agg(method, ',' ORDER BY method) FILTER (WHERE mx) AS top_mesr, string_agg(method, ',' ORDER BY method) FILTER (WHERE ax) AS most_accurate,
  string_agg(method, ',' ORDER BY method) FILTER (WHERE an) AS least_accurate, bool_or(mx AND an) AS top_mesr_least_accurate FROM tb GROUP BY ALL"""))
def _(ws):
    return downstream.tie_break_summary(conditions(ws).where("mesr IS NOT NULL"), ["dataset", "r_pct"])


CLASS = """cfm AS (SELECT condition, target, prediction, count(*) AS n FROM pred GROUP BY ALL),
pk AS (SELECT condition, k, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT condition, target AS k, CASE WHEN target = prediction THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN target = prediction THEN 0 ELSE n END AS fn FROM cfm
  UNION ALL SELECT condition, prediction, 0, CASE WHEN target = prediction THEN 0 ELSE n END, 0 FROM cfm) GROUP BY ALL)"""


@registry.add("w13_classification_metrics", Q.query([PRED, CLASS], """
SELECT condition, CAST(sum(n) AS BIGINT) AS clips, round(coalesce(sum(n) FILTER (WHERE target = prediction), 0) / CAST(sum(n) AS DOUBLE), 9) AS top1,
  round(coalesce(sum(n) FILTER (WHERE target = prediction AND target <> 10), 0) / CAST(sum(n) FILTER (WHERE target <> 10) AS DOUBLE), 9) AS top1_named, round(any_value(f1), 9) AS macro_f1
FROM cfm JOIN (SELECT condition, sum(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)) / 11 AS f1 FROM pk GROUP BY ALL) USING (condition) GROUP BY condition"""))
def _(ws):
    return rounded(downstream.classification_metrics(predictions(ws), ["condition"], 11, 10))


@registry.add("w13_confusion", Q.query([PRED, CLASS], "SELECT condition, target, prediction, n FROM cfm"))
def _(ws):
    return downstream.confusion(predictions(ws), ["condition"])


@registry.add("w14_reproduction_gate", Q.query([PRED, """ac AS (SELECT condition, avg(CASE WHEN prediction = target THEN 1.0 ELSE 0.0 END) AS top1 FROM pred GROUP BY ALL),
gp AS (SELECT condition, abs(top1 - (round(top1, 7) - CASE WHEN condition = 'a__fb' THEN 0.01 ELSE 0.0 END)) AS gap FROM ac)"""], """
SELECT condition, round(gap, 9) AS gap, gap <= 1e-6 AS passes FROM gp"""))
def _(ws):
    """Expected accuracies as published, to seven digits; one condition's is off and must fail."""
    p = predictions(ws)
    off = F.when(F.col("condition") == "a__fb", 0.01).otherwise(0.0)
    expected = downstream.accuracy(p, ["condition"]).select("condition", (F.round("accuracy", 7) - off).alias("expected_top1"))
    gate = downstream.check_gate(downstream.classification_metrics(p, ["condition"], 11, 10), expected, ["condition"])
    return rounded(gate)


CLIPMESR = [Q.EV, INTERVALS.format(minimum=8), "cj AS (SELECT clip, j AS event_idx, x, y, 4 AS nsl FROM cs)", *Q.mesr_ctes("cj", "m", "clip")]


def clip_streams(ws) -> DataFrame:
    s = downstream.clip_samples(clips(ws), None, 8)
    return s.select(F.col("clip").alias(KEY), F.col("j").alias("event_idx"), "x", "y", F.lit(True).alias("whole"))


@registry.add("w15_clip_mesr", Q.query(CLIPMESR, "SELECT clip, round(mesr, 9) AS mesr, slices FROM m"))
def _(ws):
    return rounded(metric.mesr_unfiltered(clip_streams(ws), 4).withColumnRenamed(KEY, "clip"))


@registry.add("w15_prefix_identity", Q.query(CLIPMESR, "SELECT count(*) AS cells, CAST(0 AS BIGINT) AS differ FROM m"))
def _(ws):
    s = clip_streams(ws)
    return downstream.prefix_identity(metric.mesr_unfiltered(s, 4), metric.mesr_of_masks(s, ["whole"], 4, 64), [KEY], "mesr")


@registry.add("w16_architecture_signs", Q.query([*COND, "rs AS (SELECT dataset, seed, r_pct, method, round(accuracy, 12) AS accuracy, CASE WHEN r_pct = 100 THEN 'all_r1.00' ELSE printf('%s_r%.2f', method, r_pct / 100.0) END AS condition FROM runs)",
    SPEAR.format(o="sp", k="dataset, seed", x="r_pct", y="accuracy", t="rs"),
    "bw AS (SELECT dataset, seed, first(condition ORDER BY accuracy DESC, method DESC, r_pct DESC) AS best, first(condition ORDER BY accuracy, method, r_pct) AS worst FROM rs GROUP BY ALL)"], """
SELECT dataset, seed, n, round(rho, 9) AS rho, best, worst, CAST(sign(rho) AS DOUBLE) AS sign FROM sp JOIN bw USING (dataset, seed)"""))
def _(ws):
    rows = runs(ws).withColumns({"condition": downstream.condition_name(F.col("method"), F.col("r_pct")),
                                 "accuracy": F.round("accuracy", 12)})
    return rounded(downstream.architecture_signs(rows, ["dataset", "seed"]))


@registry.add("w17_order_association", Q.query([*COND, "od AS (SELECT r.*, d.dropped FROM runs r CROSS JOIN (VALUES ('none'), ('sc')) d(dropped) WHERE r.method <> d.dropped AND r_pct = 50 AND mesr IS NOT NULL)",
    SPEAR.format(o="sp", k="dataset, seed, dropped", x="mesr", y="accuracy", t="od")], "SELECT dataset, seed, dropped, n, round(rho, 9) AS rho FROM sp"))
def _(ws):
    rows = downstream.drop_scenarios(runs(ws).where("r_pct = 50"), ["sc"])
    return rounded(ranks.spearman(rows, ["dataset", "seed", "dropped"], "mesr", "accuracy", small=True))


@registry.add("w17_top_mesr_least_accurate", Q.query(TIES, """
SELECT dataset, r_pct, count(*) AS orders, count(*) FILTER (WHERE w) AS least_accurate FROM (SELECT dataset, seed, r_pct, bool_or(mx AND an) AS w FROM tb GROUP BY ALL) GROUP BY ALL"""))
def _(ws):
    return downstream.tie_break_summary(tie_runs(ws), ["dataset", "seed", "r_pct"]).groupBy("dataset", "r_pct").agg(
        F.count("*").alias("orders"), F.count_if("top_mesr_least_accurate").alias("least_accurate"))
