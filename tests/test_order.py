from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from streamquality.operators import order, scorers

EVENT = "recording_id string, event_idx bigint, t_us bigint, x int, y int, p int"


def events(spark, rows):
    return spark.createDataFrame([("a", i, *r) for i, r in enumerate(rows)], EVENT)


def test_event_index_is_dense_and_ordered_under_skew(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 7)).alias("recording_id"),
        (F.col("id") * 7919 % 50).alias("t_us"), F.col("id").alias("source_idx"))
    out = order.assign_event_index(rows.repartition(6), ["recording_id"], ["t_us", "source_idx"]).toPandas()
    for _, part in out.groupby("recording_id"):
        part = part.sort_values("event_idx")
        assert part.event_idx.tolist() == list(range(len(part)))
        assert part[["t_us", "source_idx"]].apply(tuple, axis=1).is_monotonic_increasing


@pytest.mark.parametrize("span", [1, 3, 1024])
def test_running_offsets_are_exclusive_prefix_sums(spark, span):
    rows = spark.createDataFrame([("a", i, i + 1, 2) for i in range(20)] + [("b", 5, 7, 1)],
                                 "k string, piece int, u bigint, v bigint")
    got = {(r["k"], r["piece"]): (r["u_before"], r["v_before"])
           for r in order.running_offsets(rows, ["k"], "piece", ["u", "v"], span).collect()}
    assert got["b", 5] == (0, 0)
    assert all(got["a", i] == (i * (i + 1) // 2, 2 * i) for i in range(20))


def test_running_sums_over_a_group(spark):
    rows = spark.range(1000).select(F.lit("g").alias("k"), F.col("id"), (F.col("id") % 5).alias("v"))
    got = order.running_sums(rows, ["k"], ["id"], ["v"]).orderBy("id").collect()
    total = 0
    for r in got:
        assert r["v_before"] == total
        total += r["v"]


@pytest.mark.parametrize("kept,scored", [(25, 20), (9, 0), (10, 10)])
def test_scored_prefix(spark, kept, scored):
    rows = spark.range(40).select(F.lit("a").alias("recording_id"), F.col("id").alias("event_idx"),
                                  (F.col("id") >= 40 - kept).alias("m"))
    got = sorted(r["event_idx"] for r in order.scored_prefix(rows, ["m"], 10, 7).collect())
    assert got == list(range(40 - kept, 40 - kept + scored))


@pytest.mark.parametrize("window", [0, 7, None])
def test_shuffle_permutes_marks_inside_windows(spark, window):
    rows = spark.range(100).select(F.lit("a").alias("recording_id"), F.col("id").alias("event_idx"),
                                   F.col("id").alias("mark"))
    got = order.shuffle_marks(rows, window, 5, ["mark"], buckets=8).orderBy("event_idx").collect()
    assert [r["event_idx"] for r in got] == list(range(100))
    moved = [r["mark_shuffled"] for r in got]
    assert sorted(moved) == list(range(100))
    if window == 0:
        assert moved == list(range(100))
    else:
        assert moved != list(range(100))
        assert all(m // (window or 100) == i // (window or 100) for i, m in enumerate(moved))


def test_time_order_report_sees_bucket_edges(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate([1, 2, 5, 4, 6, 7])] + [("b", 0, 1), ("b", 1, 1)],
                                 "recording_id string, source_idx bigint, t_us bigint")
    for bucket in (2, 3, 100):
        got = {r[0]: (r["inversions"], r["repaired"]) for r in
               order.time_order_report(rows, "recording_id", "source_idx", bucket=bucket).collect()}
        assert got == {"a": (1, True), "b": (0, False)}


A, B, C = (10, 1, 1, 0), (10, 2, 2, 0), (20, 3, 3, 1)


@pytest.mark.parametrize("block", [1, 2, 3, 64])
@pytest.mark.parametrize("rows,want", [
    ([A, A, B, A, C, C], [(0, 1), (1, 3), (3, 5), (5, 6)]),
    ([A, B, B, A], [(0, 2), (2, 4)]),
    ([(1, 0, 0, 0), (1, 0, 0, 1), (2, 0, 0, 0)], [(0, 3)]),
    ([A], [(0, 1)]),
])
def test_packets_are_the_fewest_without_repeats(spark, rows, want, block):
    got = scorers.packets(events(spark, rows), block).orderBy("start").collect()
    assert [(r["start"], r["stop"]) for r in got] == want


def test_packets_on_random_streams_match_a_scan(spark):
    import random
    random.seed(4)
    rows = [(i // 40, random.randrange(4), random.randrange(4), 0) for i in range(600)]
    want, seen, start = [], set(), 0
    for i, r in enumerate(rows):
        if r in seen:
            want.append((start, i))
            seen, start = set(), i
        seen.add(r)
    want.append((start, len(rows)))
    for block, span in ((17, 3), (9, 1), (100, 1024), (4096, 1024)):
        got = scorers.packets(events(spark, rows), block, span).orderBy("start").collect()
        assert [(r["start"], r["stop"]) for r in got] == want


def kept_of(frame, idx):
    picked = frame.where(F.col("event_idx").isin(idx)).select("recording_id", "event_idx", "t_us", "x", "y", "p")
    order_ = {v: i for i, v in enumerate(idx)}
    return picked.withColumn("kept_idx", F.create_map(*[F.lit(x).cast("bigint") for kv in order_.items() for x in kv])[F.col("event_idx")])


def test_whole_stream_attribution_takes_the_earliest_copy(spark):
    frame = events(spark, [A, A, C])
    kept = kept_of(frame, [1, 2]).drop("event_idx")
    got = [r["event_idx"] for r in scorers.attribute_kept(frame, kept).orderBy("kept_idx").collect()]
    assert got == [0, 2]


def values_of(spark, rows, name="a"):
    return spark.createDataFrame([(name, i, *v) for i, v in enumerate(rows)], "recording_id string, kept_idx bigint, t_us bigint, x int, y int, p int")


def forward_scan(source, target):
    out, i = [], 0
    for v in target:
        while i < len(source) and source[i] != v:
            i += 1
        if i == len(source):
            break
        out.append(i)
        i += 1
    return out + [None] * (len(target) - len(out))


def scanned(spark, cases, block):
    """Each case, a recording of its own, by the operator."""
    source = [(f"r{c}", i, *v) for c, (rows, _) in enumerate(cases) for i, v in enumerate(rows)]
    target = [(f"r{c}", i, *v) for c, (_, rows) in enumerate(cases) for i, v in enumerate(rows)]
    kept = spark.createDataFrame(target, "recording_id string, kept_idx bigint, t_us bigint, x int, y int, p int")
    got = scorers.attribute_kept(spark.createDataFrame(source, EVENT), kept, block).orderBy("kept_idx").collect()
    return [[r["event_idx"] for r in got if r["recording_id"] == f"r{c}"] for c in range(len(cases))]


@pytest.mark.parametrize("block", [1, 64])
def test_forward_scan_takes_the_first_copy_behind_the_last_match(spark, block):
    B_ = (A[0], A[1] + 1, A[2], A[3])
    cases = [([A, B_, A], [B_, A]), ([A, B_, A], [A, A]), ([A, B_, A], [B_, B_, A]), ([A, C], [C, A]), ([A, C], [])]
    assert scanned(spark, cases, block) == [[1, 2], [0, 2], [1, None, None], [1, None], []]


@pytest.mark.parametrize("block", [64, 300])
def test_forward_scan_on_random_streams(spark, block):
    import random
    r, cases = random.Random(block), []
    for clock in (40, 130, 10**9):
        rows = [(i // clock, r.randrange(3), r.randrange(2), 0) for i in range(900)]
        for share in (0.1, 0.5, 0.9):
            kept = [v for v in rows if r.random() < share]
            cases += [(rows, kept), (rows, kept[:40] + [(10**6, 0, 0, 0)] + kept[40:]), (rows, kept[::-1])]
    assert scanned(spark, cases, block) == [forward_scan(*c) for c in cases]


@pytest.mark.parametrize("shares", [(0.5, 0.5), (0.3, 0.6)])
def test_forward_scan_takes_no_round_per_block_of_a_long_run(spark, monkeypatch, shares):
    import random
    from streamquality.operators import attribution
    r, staged, n = random.Random(5), [], 40_000
    monkeypatch.setattr(attribution, "stage", lambda df, name, plain=attribution.stage: staged.append(name) or plain(df, name))
    rows = [(0, r.randrange(4), r.randrange(3), r.randrange(2)) for _ in range(n)]
    kept = [v for i, v in enumerate(rows) if r.random() < shares[2 * i // n]]
    assert scanned(spark, [(rows, kept)], 2000) == [forward_scan(rows, kept)]
    if shares[0] == shares[1]:  # a steady filter
        assert staged.count("scan") <= 2


def test_carried_columns_are_those_of_the_matched_row(spark):
    frame = events(spark, [A, A, C]).withColumn("label", F.col("event_idx") * 10)
    got = scorers.attribute_kept(frame, values_of(spark, [A, C, C]), carry=["label"]).orderBy("kept_idx").collect()
    assert [(r["event_idx"], r["label"]) for r in got] == [(0, 0), (2, 20), (None, None)]


def test_packet_attribution_finds_the_copy_that_was_kept(spark):
    frame = events(spark, [A, A, C])
    table = scorers.packets(frame).cache()
    for idx in ([1, 2], [0, 2], [0, 1, 2]):
        kept = scorers.with_packet(kept_of(frame, idx), table).drop("event_idx")
        got = [r["event_idx"] for r in scorers.attribute_in_packets(frame, table, kept).orderBy("kept_idx").collect()]
        assert got == idx


def test_attribution_report_flags_reordering_and_strangers(spark):
    frame = events(spark, [A, B, C])
    bad = kept_of(frame, [2, 0]).drop("event_idx")
    assert scorers.attribution_report(scorers.attribute_kept(frame, bad)).first()["unmatched"] == 1  # no ordered part of the input
    swapped = spark.createDataFrame([("a", 0, 5), ("a", 1, 3)], "recording_id string, kept_idx bigint, event_idx bigint")
    assert scorers.attribution_report(swapped).first()["inversions"] == 1
    alien = spark.createDataFrame([("a", 0, 99, 5, 5, 1)], "recording_id string, kept_idx bigint, t_us bigint, x int, y int, p int")
    assert scorers.attribution_report(scorers.attribute_kept(frame, alien)).first()["unmatched"] == 1


def test_label_oracle_refuses_unlabelled_rows(spark):
    rows = spark.createDataFrame([("a", 0, None)], "recording_id string, event_idx bigint, label int")
    with pytest.raises(Exception, match="needs labels"):
        rows.select(scorers.label_oracle()).collect()


def test_native_retention_is_null_for_continuous_scores(spark):
    rows = spark.createDataFrame([("a", m, float(s)) for m, ss in (("two", [0, 1, 1, 0]), ("many", [0, 1, 2, 0])) for s in ss],
                                 "recording_id string, method string, score double")
    got = {r["method"]: r["native_retention"] for r in scorers.native_retention(rows).collect()}
    assert got == {"two": 0.5, "many": None}


def test_support_filter_counts_earlier_neighbours_only(spark):
    rows = events(spark, [(0, 5, 5, 0), (4, 6, 5, 0), (4, 6, 6, 0), (15, 5, 5, 0), (15, 30, 30, 0)])
    got = {r["event_idx"]: r["support"] for r in scorers.neighbourhood_support(rows, 1, 12).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 0}


def test_tasks_follow_the_rows(spark, stream, monkeypatch):
    events, _ = stream
    flagged = events.withColumn("m", events["score"] < 2)
    before = {tuple(r) for r in order.with_mask_positions(flagged, ["m"], 16).select("recording_id", "event_idx", "m_pos").collect()}
    monkeypatch.setattr(order, "PIECE", 100)
    ranged = order.range_ordered(events, ["recording_id"], ["event_idx"], "many")
    assert ranged.select("_part").distinct().count() > 40
    dealt = order.spread(flagged, ["recording_id", "event_idx"])
    assert dealt.rdd.getNumPartitions() == -(-flagged.count() // 100)
    got = order.with_mask_positions(flagged, ["m"], 16).select("recording_id", "event_idx", "m_pos")
    assert {tuple(r) for r in got.collect()} == before


def test_shares_meet_the_stream_without_a_shuffle_by_recording(spark):
    from streamquality.plans import outputs
    from streamquality.sources.tables import CORPORA, workspace
    ws = workspace(spark, "/root/testdata/sf0.01")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        tagged, _ = outputs._mask_shares(CORPORA[1], ws, False)
        plan = tagged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
