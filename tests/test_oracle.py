from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import naive
from streamquality.operators import oracle

SIZE, BLOCK = 100, 64


def test_controls_match_the_prefix_block_by_block(stream):
    frame, pdf = stream
    long = oracle.matched_positions(frame, ["keep"], SIZE, BLOCK, 11).toPandas()
    for name, part in long.groupby("recording_id"):
        per = part.groupby(["side", "block"]).size().unstack(0).fillna(0)
        assert (per["filter"] == per["oracle"]).all() and (per["filter"] == per["null"]).all()
        for side, rows in part.groupby("side"):
            assert sorted(rows.pos) == list(range(len(rows)))
            assert rows.sort_values("pos").event_idx.is_monotonic_increasing


def test_native_cells_match_the_formula(stream):
    frame, pdf = stream
    got = {r["recording_id"]: r for r in oracle.native_cells(frame, ["keep"], SIZE, BLOCK, 11).collect()}
    bound = {r["recording_id"]: r["bound"] for r in oracle.oracle_bound(frame, ["keep"], SIZE, BLOCK).collect()}
    assert got["c"]["scored"] == 0 and got["c"]["mesr"] is None
    for name in ("a", "b"):
        part = pdf[pdf.recording_id == name].reset_index(drop=True)
        idx = part.index[part.keep].tolist()
        idx = idx[:len(idx) // SIZE * SIZE]
        chosen = []
        for start in range(0, len(part), BLOCK):
            quota = sum(start <= i < start + BLOCK for i in idx)
            block = range(start, min(start + BLOCK, len(part)))
            chosen += sorted(sorted(block, key=lambda i: (part.label[i], i))[:quota])
        px = list(zip(part.x, part.y))
        row = got[name]
        assert row["scored"] == len(idx) == row["oracle_scored"] == row["null_scored"]
        assert row["mesr"] == pytest.approx(naive.mesr([px[i] for i in idx], SIZE))
        assert row["oracle_mesr"] == pytest.approx(naive.mesr([px[i] for i in chosen], SIZE))
        assert row["oracle_tp"] == sum(part.label[i] == 0 for i in chosen) == bound[name]
        assert row["label_class"] in ("strict", "tie")


@pytest.mark.parametrize("quota,want", [(2, [1, 3]), (3, [0, 1, 3])])
def test_oracle_takes_signal_first_then_arrival(spark, quota, want):
    rows = spark.createDataFrame([("a", i, i, 0, l, i >= 4 - quota) for i, l in enumerate([1, 0, 1, 0])],
                                 "recording_id string, event_idx bigint, x int, y int, label int, m boolean")
    got = oracle.matched_positions(rows, ["m"], 1, 4, 3).where("side = 'oracle'").collect()
    assert sorted(r["event_idx"] for r in got) == want


def test_block_identity(stream):
    frame, _ = stream
    for share in (0.05, 0.4, 0.9):
        for r in oracle.compare_masks(frame, ["keep"], {"keep": F.lit(share)}, BLOCK).collect():
            assert r["symmetric_difference"] == r["predicted_by_block_identity"]


def test_eligibility_needs_both_tolerances(spark):
    rows = spark.createDataFrame([(0.30, 0.30), (0.30, 0.35), (0.30, 0.36), (0.01, 0.05), (None, 0.05)], "n double, r double")
    assert [r[0] for r in rows.select(oracle.eligible(F.col("n"), F.col("r"))).collect()] == [True, True, False, False, False]


def test_nearest_point_prefers_the_smaller_retention(spark):
    rows = spark.createDataFrame([("a", p, 0.125, p / 10.0) for p in (5, 10, 15)], "k string, r_pct int, t double, mesr double")
    assert oracle.nearest_point(rows, ["k"], "t", ["mesr"]).first()["r_pct"] == 10
