from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

import naive
from streamquality.functions.numeric import kept_total, quota_of
from streamquality.operators import grid, metric, order

SIZE, BLOCK = 100, 64
PCTS = [5, 15, 35, 50, 75, 95, 100]


def counts(spark, values):
    return spark.createDataFrame([("g", v) for v in values], "g string, n bigint")


def test_esr_of_a_small_surface(spark):
    row = metric.esr_of_counts(counts(spark, [2, 1]), ["g"]).first()
    assert row["esr"] == pytest.approx(math.sqrt((1 / 3) * (4 - (1 / 9 + 1 / 3 + 2))))


def test_esr_of_one_event_is_null(spark):
    row = metric.esr_of_counts(counts(spark, [1]), ["g"]).first()
    assert row["esr"] is None and row["n_events"] == 1


def test_concentration_can_lower_the_score(spark):
    one = metric.esr_of_counts(counts(spark, [30000]), ["g"]).first()["esr"]
    three = metric.esr_of_counts(counts(spark, [15000, 7500, 7500]), ["g"]).first()["esr"]
    assert one == pytest.approx(1.0) and three == pytest.approx(1.06063, abs=1e-5)


def test_mesr_drops_the_incomplete_tail(stream):
    frame, pdf = stream
    got = {r["recording_id"]: r for r in metric.mesr_unfiltered(frame, SIZE).collect()}
    assert set(got) == {"a", "b"} and got["a"]["slices"] == 50 and got["b"]["slices"] == 12
    for name, row in got.items():
        part = pdf[pdf.recording_id == name]
        assert row["mesr"] == pytest.approx(naive.mesr(list(zip(part.x, part.y)), SIZE))


def test_mesr_of_masks_matches_the_formula(stream):
    frame, pdf = stream
    got = {r["recording_id"]: r["mesr"] for r in metric.mesr_of_masks(frame, ["keep"], SIZE, BLOCK).collect()}
    for name in ("a", "b"):
        part = pdf[(pdf.recording_id == name) & pdf.keep]
        assert got[name] == pytest.approx(naive.mesr(list(zip(part.x, part.y)), SIZE))


def test_half_of_a_block_of_ten_is_five_lowest(spark):
    rows = spark.createDataFrame([("a", i, float(9 - i)) for i in range(10)], "recording_id string, event_idx bigint, s double")
    kept = [r["event_idx"] for r in metric.retain(rows, F.col("s"), 0.5, 10).collect()]
    assert sorted(kept) == [5, 6, 7, 8, 9]


def test_quota_rounds_half_to_even_and_keeps_one():
    assert (quota_of(10, 0.25), quota_of(10, 0.35), quota_of(3, 0.05)) == (2, 4, 1)


def test_kept_total_is_the_sum_of_quotas(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 63, 64, 65, 1000)], "n bigint")
    for pct in PCTS:
        for r in rows.select("n", kept_total(F.col("n"), pct / 100.0, BLOCK).alias("k")).collect():
            blocks = [min(BLOCK, r["n"] - s) for s in range(0, r["n"], BLOCK)]
            assert r["k"] == sum(quota_of(b, pct / 100.0) for b in blocks)


@pytest.mark.parametrize("chunks", [1, 3])
def test_curve_matches_the_formula_wherever_chunks_are_cut(stream, monkeypatch, chunks):
    frame, pdf = stream
    monkeypatch.setattr(grid, "chunk_events", lambda size, block: chunks * 3 * block)
    scores = {"raw": None, "score": F.col("score"), "oracle": F.col("label").cast("double")}
    got = {(r["recording_id"], r["method"], r["r_pct"]): r
           for r in grid.curve(frame, scores, SIZE, BLOCK, PCTS).collect()}
    assert len(got) == 3 * 3 * len(PCTS)
    for name in ("a", "b", "c"):
        part = pdf[pdf.recording_id == name]
        px, labels = list(zip(part.x, part.y)), list(part.label)
        for method, values in (("raw", [0.0] * len(px)), ("score", list(part.score)), ("oracle", labels)):
            for pct in PCTS:
                idx = naive.kept(values, pct / 100.0, BLOCK)
                row = got[name, method, pct]
                want = naive.mesr([px[i] for i in idx], SIZE)
                scored = idx[:len(idx) // SIZE * SIZE]
                assert row["kept_events"] == len(idx)
                assert row["evaluable"] == (want is not None)
                assert row["scored_events"] == len(scored)
                assert row["tp"] == sum(labels[i] == 0 for i in idx)
                assert row["scored_tp"] == sum(labels[i] == 0 for i in scored)
                assert row["last_scored"] == (scored[-1] if scored else None)
                if want is not None:
                    assert row["mesr"] == pytest.approx(want, abs=1e-12)


def test_window_curve_agrees_with_the_grid(stream):
    frame, _ = stream
    below = [p for p in PCTS if p < 100]
    kept = metric.retained_positions(frame, F.col("score"), below, BLOCK)
    slow = metric.esr_per_slice(kept.withColumn("slice", F.expr(f"pos div {SIZE}")), ["recording_id", "r_pct"], SIZE)
    slow = {(r[0], r[1]): r[2] for r in slow.groupBy("recording_id", "r_pct").agg(F.avg("esr")).collect()}
    fast = {(r["recording_id"], r["r_pct"]): r["mesr"] for r in grid.curve(
        frame, {"s": F.col("score")}, SIZE, BLOCK, below).collect() if r["evaluable"]}
    assert slow.keys() == fast.keys()
    assert all(slow[k] == pytest.approx(fast[k], abs=1e-12) for k in slow)


def test_median_variant_empties_an_isolated_pixel(spark):
    rows = spark.createDataFrame([("a", i, 3, 3) for i in range(10)], "recording_id string, event_idx bigint, x int, y int")
    sensors = spark.createDataFrame([("a", 8, 8)], "recording_id string, width int, height int")
    row = metric.esr_v2(rows, sensors, 10).first()
    assert row["esr_v2"] == 0.0 and row["esr"] > 0


def test_declared_sensor_does_not_change_the_score(stream):
    frame, _ = stream
    rows = metric.declared_sensor(frame, [(20, 15), (640, 480), (4096, 4096)], SIZE).collect()
    for name in ("a", "b"):
        values = [r["mesr"] for r in rows if r["recording_id"] == name]
        assert max(values) - min(values) < 1e-12


def test_permutation_leaves_the_score(stream):
    frame, _ = stream
    a = {r[0]: r["mesr"] for r in metric.mesr_unfiltered(frame, SIZE).collect()}
    b = {r[0]: r["mesr"] for r in metric.mesr_unfiltered(metric.permute_pixels(frame, 7, 5, 20, 15), SIZE).collect()}
    assert all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    with pytest.raises(ValueError):
        metric.permute_pixels(frame, 5, 0, 20, 15)


def test_frames_hold_whole_slices_on_both_sides(spark):
    rows = spark.createDataFrame([(n,) for n in (25_000, 600_000, 1_000_000)], "n bigint")
    for pct in range(5, 100, 5):
        for r in rows.select("n", order.frame_length(F.col("n"), pct, 30_000).alias("f")).collect():
            assert r["f"] % 30_000 == 0 and r["f"] * pct % (100 * 30_000) == 0 and r["f"] <= r["n"]


def test_scored_share_of_a_capped_budget(spark):
    from streamquality.operators.downstream import scored_share
    sizes = spark.createDataFrame([(80_000,)], "n bigint")
    got = {r["r_pct"]: (r["scored"], r["kept"]) for r in scored_share(sizes, "n", [40, 100], 10_240, 30_000).collect()}
    assert got == {40: (30_000, 32_000), 100: (60_000, 80_000)}


def test_sweep_of_sizes_without_a_common_chunk(spark, stream):
    sizes = [7, 40, 100, 997]
    assert metric.commensurable([100, 200, 300, 500, 1000]) == [([1000, 500, 300, 200, 100], 30_000)]
    groups = metric.commensurable(sizes)
    assert len(groups) == 2 and all(length % s == 0 for some, length in groups for s in some)
    events, _ = stream
    flagged = events.withColumn("all", events["x"] >= 0)
    got = {(r["recording_id"], r["method"], r["slice_size"]): r["mesr"]
           for r in metric.slice_size_sweep(flagged, ["keep", "all"], sizes, 64).collect()}
    assert len(got) == 3 * 2 * len(sizes)
    for size in sizes:
        want = {(r["recording_id"], r["method"], size): r["mesr"]
                for r in metric.mesr_of_masks(flagged, ["keep", "all"], size, 64).collect()}
        for key in [k for k in got if k[2] == size]:
            assert (got[key] is None) == (key not in want)
            assert got[key] is None or abs(got[key] - want[key]) < 1e-12


def test_curve_is_dealt_out_by_rows(spark, stream, monkeypatch):
    events, _ = stream
    scores = {"raw": None, "s": F.col("score")}
    numbered = lambda df: df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM")
    whole = grid.slices(events, scores, 40, 16, [30, 100])
    want = {tuple(r[:4]): r["ntss"] for r in whole.collect()}
    monkeypatch.setattr(order, "PIECE", 500)
    dealt = grid.slices(events, scores, 40, 16, [30, 100])
    assert numbered(dealt) == numbered(events) + 2
    got = {tuple(r[:4]): r["ntss"] for r in dealt.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
