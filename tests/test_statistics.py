from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamquality.functions import md5, ranks, tails
from streamquality.operators import analysis, contrasts, downstream, nulls, regime, resample
from streamquality.operators.order import range_ordered

# A published table of (method, retention %, MESR, accuracy).
PUBLISHED = [
    ("raw", 40, 1.4306636492292326, 0.6111111111111112), ("raw", 50, 1.4318214278460202, 0.7048611111111112),
    ("raw", 60, 1.430775803122275, 0.78125), ("raw", 80, 1.4304422401706383, 0.9305555555555556),
    ("all", 100, 1.4326925262364274, 0.9791666666666666),
    ("random_null", 40, 1.4103566517327621, 0.5659722222222222), ("random_null", 50, 1.4144866529098403, 0.6736111111111112),
    ("random_null", 60, 1.4170476230984836, 0.7951388888888888), ("random_null", 80, 1.4247806583249198, 0.9201388888888888),
    ("dwf", 40, 1.4225402210778348, 0.6736111111111112), ("dwf", 50, 1.4239900349165378, 0.7326388888888888),
    ("dwf", 60, 1.4235785021524119, 0.7916666666666666), ("dwf", 80, 1.4239647537552886, 0.9340277777777778),
    ("evflow", 40, 1.4861072384165122, 0.6944444444444444), ("evflow", 50, 1.472612293745984, 0.7638888888888888),
    ("evflow", 60, 1.4597074591392043, 0.8298611111111112), ("evflow", 80, 1.4424856525424923, 0.9270833333333334),
    ("knoise", 40, 1.4305158373887823, 0.65625), ("knoise", 50, 1.43682429158355, 0.7777777777777778),
    ("knoise", 60, 1.4361493098843805, 0.8541666666666666), ("knoise", 80, 1.4338932434792435, 0.9409722222222222),
    ("red", 40, 1.4988308256448106, 0.6423611111111112), ("red", 50, 1.495403656875848, 0.6388888888888888),
    ("red", 60, 1.4888502032270974, 0.6631944444444444), ("red", 80, 1.47016517866092, 0.8020833333333334),
    ("ts", 40, 1.4662296080456179, 0.6423611111111112), ("ts", 50, 1.456878447918162, 0.7743055555555556),
    ("ts", 60, 1.4479688861523914, 0.8368055555555556), ("ts", 80, 1.4372633282570373, 0.9201388888888888),
    ("ynoise", 40, 1.4347566218259995, 0.71875), ("ynoise", 50, 1.4355885116527451, 0.7604166666666666),
    ("ynoise", 60, 1.4392559702409302, 0.8402777777777778), ("ynoise", 80, 1.4441988167640991, 0.9340277777777778)]


@pytest.fixture(scope="module")
def published(spark):
    return spark.createDataFrame([("d", *r) for r in PUBLISHED], "dataset string, method string, r_pct int, mesr double, accuracy double").cache()


def test_published_pooled_and_within_retention(published):
    rows = downstream.drop_scenarios(published, ["red"])
    pooled = {r["dropped"]: r for r in downstream.with_rho_p(
        ranks.spearman(rows, ["dropped"], "mesr", "accuracy"), "rho", "n").collect()}
    assert pooled["none"]["rho"] == pytest.approx(-0.07204948580554367, abs=1e-12)
    assert pooled["none"]["rho_p"] == pytest.approx(0.6902968045918094, abs=1e-9)
    assert pooled["red"]["rho"] == pytest.approx(0.1466058988884, abs=1e-12)
    means = {r["dropped"]: r["mean_rho"] for r in downstream.mean_within(
        downstream.within_retention(rows, ["dropped"]), ["dropped"]).collect()}
    assert means["none"] == pytest.approx(0.04409779989109437, abs=1e-12)
    assert means["red"] == pytest.approx(0.4599033489037261, abs=1e-12)


def test_published_inversion(published):
    got = {(r["dropped"], r["r_pct"]): (r["top_mesr_method"], r["accuracy_rank"]) for r in
           downstream.inversion(downstream.drop_scenarios(published, ["red"]), ["dropped"]).collect()}
    assert [got["none", p] for p in (50, 60, 80)] == [("red", 1)] * 3
    assert got["red", 40] == ("evflow", 6) and got["red", 80][0] == "ynoise"


def test_published_detectable_rho(published):
    row = downstream.with_power(downstream.detectable_rho(published.groupBy("dataset").agg(F.count("*").alias("n"))), [0.3, 0.5]).first()
    assert row["min_detectable_rho"] == pytest.approx(0.3433089972376546)
    assert row["power_3"] == pytest.approx(0.3956375105707699) and row["power_5"] == pytest.approx(0.8528441206348292)


def test_both_rank_routes_agree(spark):
    rows = spark.range(2000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 101).cast("double").alias("v"), F.col("id"))
    a = {r["id"]: r["r"] for r in ranks.average_ranks(rows, ["k"], "v", "r").collect()}
    b = {r["id"]: r["r"] for r in ranks.small_group_ranks(rows, ["k"], "v", "r").collect()}
    assert a == b


def test_partial_is_null_when_the_control_is_collinear(spark):
    rows = spark.createDataFrame([("g", float(i), float(i * i % 7), float(i)) for i in range(8)], "g string, x double, y double, c double")
    assert ranks.partial_spearman(rows, ["g"], "x", "y", "c").first()["rho"] is None


def test_kendall_counts_one_crossing(spark):
    rows = spark.createDataFrame([("g", "a", 1.0, 1.0), ("g", "b", 2.0, 3.0), ("g", "c", 3.0, 2.0)], "g string, m string, x double, y double")
    row = ranks.kendall(rows, ["g"], "m", "x", "y").first()
    assert row["discordant"] == 1 and row["tau"] == pytest.approx(1 / 3)


def test_mann_whitney_separated_groups(spark):
    rows = spark.createDataFrame([("g", i < 4, float(i)) for i in range(9)], "g string, f boolean, v double")
    row = ranks.mann_whitney(rows, ["g"], "f", "v").first()
    assert row["u"] == 0 and row["rank_biserial"] == 1.0


def test_tails():
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert tails.chi2_tail(9.487729036781154, 4) == pytest.approx(0.05)
    assert tails.beta_cdf(2.0, 0.5, 4 / (4 + 2.7764451051977987 ** 2)) == pytest.approx(0.05)


def test_mcnemar(spark):
    rows = spark.createDataFrame([(0, 0), (5, 0), (3, 7)], "b int, c int")
    got = [r[0] for r in rows.select(tails.mcnemar_exact("b", "c")).collect()]
    want = 2 * sum(math.comb(10, i) for i in range(4)) / 2 ** 10
    assert got == pytest.approx([1.0, 0.0625, want])


def test_cluster_bootstrap_weights_scenes_by_size(spark):
    rows = spark.createDataFrame([("k", "s1", 1.0)] * 9 + [("k", "s2", 2.0)], "k string, s string, v double")
    row = resample.cluster_bootstrap(rows, ["k"], "v", "s", 400).first()
    assert row["mean"] == pytest.approx(1.1) and row["n_clusters"] == 2
    assert (row["lo"], row["hi"]) == (1.0, 2.0) and row["excludes_zero"]


def test_bootstrap_draws_whole_clusters_slot_by_slot(spark, monkeypatch):
    import hashlib
    monkeypatch.setattr(resample, "PIECE", 64)
    rows = [(g, f"c{i % k}", float(i * 7 % 13)) for g, k, n in (("a", 5, 40), ("b", 3, 20), (None, 5, 11), ("one", 1, 4)) for i in range(n)]
    frame = spark.createDataFrame(rows, "k string, s string, v double")
    got = {r["k"]: r for r in resample.cluster_bootstrap(frame, ["k"], "v", "s", 200, seed=9, algorithm="md5").collect()}
    for g in ("a", "b", None):
        values = {}
        for k, s, v in rows:
            if k == g:
                values.setdefault(s, []).append(v)
        clusters = [values[s] for s in sorted(values)]
        means = []
        for d in range(200):
            picks = [int(hashlib.md5(f"9|{d}|{slot}".encode()).hexdigest()[:8], 16) % len(clusters) for slot in range(len(clusters))]
            drawn = [v for p in picks for v in clusters[p]]
            means.append(sum(drawn) / len(drawn))
        means.sort()
        def at(q):
            spot = q * 199
            low = int(spot)
            return means[low] + (means[min(low + 1, 199)] - means[low]) * (spot - low)
        assert (got[g]["lo"], got[g]["hi"]) == pytest.approx((at(0.025), at(0.975)))
    assert got["one"]["lo"] is None


def test_md5_of_many_texts_is_hashlibs():
    import hashlib
    for seed, draws, k in ((7, [0, 9, 10, 99, 10_000], 1203), (-3, [5], 40_001), (10**30, range(95, 105), 12), (10**60, [1], 3)):
        want = [[int(hashlib.md5(f"{seed}|{d}|{slot}".encode()).hexdigest()[:8], 16) for slot in range(k)] for d in draws]
        assert md5.numbers(seed, np.array(draws), k).tolist() == want


def test_pieces_of_the_draws_go_round_the_tasks(spark, monkeypatch):
    import hashlib
    import re
    monkeypatch.setattr(resample, "PIECE", 30)
    monkeypatch.setattr(resample, "PICKS", 200)
    monkeypatch.setattr(resample, "SHARED", 2)
    sums = {(g, c): float((i * 7 + c * c) % 23) for i, g in enumerate("abcdefg") for c in range(3 if g == "g" else 6)}
    frame = spark.createDataFrame([(g, c, v) for (g, c), v in sums.items()], "k string, s int, v double")
    rows = resample.cluster_bootstrap(frame, ["k"], "v", "s", 101, seed=9, alpha=0.1, algorithm="md5")
    got = {r["k"]: r for r in rows.collect()}
    dealt = re.findall(r"direct_shuffle_partition_id\(.*, (\d+)\), REPARTITION_BY_NUM", rows._jdf.queryExecution().executedPlan().toString())
    # 101 draws: 3 shares of 6 groups of 6 clusters in 3 pieces, a group of 3 clusters in 1; 101 * (3 * 6 + 6 + 1 * 3 + 1) / 200 tasks at most
    assert set(dealt) == {"10"}
    for g, k in [*((g, 6) for g in "abcdef"), ("g", 3)]:
        draws = [[int(hashlib.md5(f"9|{d}|{slot}".encode()).hexdigest()[:8], 16) % k for slot in range(k)] for d in range(101)]
        means = sorted(sum(sums[g, c] for c in picks) / k for picks in draws)
        assert (got[g]["lo"], got[g]["hi"]) == pytest.approx((means[5], means[95])), g


def test_one_cluster_has_no_interval(spark):
    rows = spark.createDataFrame([("k", "s", 1.0), ("k", "s", 3.0)], "k string, s string, v double")
    row = resample.cluster_bootstrap(rows, ["k"], "v", "s", 50).first()
    assert row["mean"] == 2.0 and row["lo"] is None and not row["excludes_zero"]


def test_alpha_column_agrees_with_a_literal(spark):
    rows = spark.range(40).select(F.lit("k").alias("k"), (F.col("id") % 8).alias("s"), (F.col("id") * 37 % 11).cast("double").alias("v"))
    a = resample.cluster_bootstrap(rows, ["k"], "v", "s", 300, alpha=0.01).first()
    b = resample.cluster_bootstrap(rows.withColumn("alpha", F.lit(0.01)), ["k"], "v", "s", 300, alpha="alpha").first()
    assert a["lo"] == pytest.approx(b["lo"]) and a["hi"] == pytest.approx(b["hi"])


def curve(spark, deltas, method="m"):
    rows = [("d", rec, method, p, 1.0 + v, 1.0, True) for rec, vs in deltas.items() for p, v in vs.items()]
    return spark.createDataFrame(rows, "dataset string, recording_id string, method string, r_pct int, mesr double, raw_mesr double, evaluable boolean")


def test_a_control_that_only_lowers_the_score(spark):
    c = curve(spark, {r: {20: -0.4, 60: -0.2, 100: 0.0} for r in "abcd"})
    points = nulls.deltas(c)
    best = nulls.fixed_gain(nulls.retention_profile(points, ["dataset"]), ["dataset"]).first()
    top = nulls.max_selected(points, ["dataset"]).first()
    assert best["best_mean"] == pytest.approx(-0.2) and not best["raises_mesr"]
    assert top["mean"] == 0.0 and top["share_argmax_at_r1"] == 1.0


def test_curve_summary_flags_the_evaluable_floor(spark):
    c = curve(spark, {"a": {20: 0.5, 60: 0.2, 100: 0.0}}).unionByName(curve(spark, {"b": {50: 0.1}}))
    got = {r["recording_id"]: r for r in analysis.curve_summary(c).collect()}
    assert got["a"]["r_star"] == 0.2 and got["a"]["optimum_at_floor"]
    assert got["a"]["auc_over_r"] == pytest.approx(((1.5 + 1.2) / 2 * 0.4 + (1.2 + 1.0) / 2 * 0.4) / 0.8)
    assert got["b"]["auc_over_r"] == pytest.approx(1.1)


def test_all_unevaluable_curve_is_an_error_cell(spark):
    c = curve(spark, {"a": {20: 0.0}}).withColumns({"mesr": F.lit(None).cast("double"), "evaluable": F.lit(False)})
    assert analysis.curve_summary(c).count() == 0 and analysis.error_cells(c).count() == 1


def test_matched_levels_drop_incomplete_scenes_and_reject_nulls(spark):
    rows = [("s1", l, float(l)) for l in range(4)] + [("s2", 0, 1.0)]
    good = spark.createDataFrame(rows, "scene string, level int, v double")
    assert contrasts.matched_levels(good, "scene", "level", [0, 1, 2, 3], "v").count() == 1
    bad = good.unionByName(spark.createDataFrame([("s3", l, None if l == 2 else 1.0) for l in range(4)], "scene string, level int, v double"))
    with pytest.raises(Exception, match="undefined value"):
        contrasts.matched_levels(bad, "scene", "level", [0, 1, 2, 3], "v").collect()


def test_level_contrast_on_rising_scenes(spark):
    rows = spark.createDataFrame([(f"s{s}", l, s + l * 0.1) for s in range(10) for l in range(4)], "scene string, level int, v double")
    row = contrasts.level_contrast(contrasts.matched_levels(rows, "scene", "level", [0, 1, 2, 3], "v"), "scene", [0, 1, 2, 3]).first()
    assert row["chi2"] == pytest.approx(30.0) and row["scenes_monotone"] == 10 and row["w"] == 0


def hot(spark, pixels):
    rows = [("a", i, i, x, y) for i, (x, y) in enumerate(pixels)]
    return spark.createDataFrame(rows, "recording_id string, event_idx bigint, t_us bigint, x int, y int")


def test_hot_pixel_is_found_and_removed(spark):
    stream = hot(spark, [(3, 4)] * 500 + [(i % 8, i // 8 % 8) for i in range(2000)])
    report = regime.hot_removal_report(regime.hot_pixels(stream)).first()
    assert report["hot_pixels"] == 1 and report["applied"]
    left = regime.remove_hot_pixels(stream, 99.9, 64)
    assert left.count() == report["events_after"]
    assert left.agg(F.max("event_idx")).first()[0] == report["events_after"] - 1


def test_a_one_pixel_stream_is_reported_not_emptied(spark):
    stream = hot(spark, [(1, 1)] * 20)
    assert not regime.hot_removal_report(regime.hot_pixels(stream)).first()["applied"]
    assert regime.remove_hot_pixels(stream, 99.9, 8).count() == 20


def test_neighbour_share_stays_inside_the_sensor(spark):
    stream = hot(spark, [(0, 0), (7, 0), (3, 3), (4, 4), (4, 4)])
    sensors = spark.createDataFrame([("a", 8, 8)], "recording_id string, width int, height int")
    row = regime.neighbour_shares(stream, sensors, 1000, 1).first()
    assert row["share"] == pytest.approx(3 / 5)


def test_frames_short_clip_goes_to_the_last(spark):
    rows = spark.createDataFrame([("c", j, 0, 0, 1, 3) for j in range(3)], "clip string, j bigint, x int, y int, p int, clip_events bigint")
    got = downstream.number_frames(rows, 16).collect()
    assert [(r["frame"], r["n"]) for r in got] == [(15, 3)]


def test_ranks_of_values_with_an_outlier_stay_balanced(spark):
    rows = spark.range(20_000).select(F.lit("g").alias("k"), (F.col("id") / 7.0).alias("v")).union(
        spark.range(1).select(F.lit("g"), F.lit(1e9)))
    ranked = ranks.distinct_ranks(rows, ["k"], "v", "r")
    assert [tuple(r)[:1] for r in ranked.orderBy(F.desc("v")).select("r").limit(2).collect()] == [(20_001.0,), (20_000.0,)]
    parts = range_ordered(rows, ["k"], ["v"], "balance").groupBy("_part").count()
    assert parts.agg(F.max("count")).first()[0] < 20_000 / 4
