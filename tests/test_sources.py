from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from streamquality.operators import metric
from streamquality.sources import artifacts, binary, headers, readers
from streamquality.streaming.incremental import append_results


def test_version_2_header_ends_at_its_marker(spark, tmp_path):
    first = (ord("#") << 24) | (5 << 12)
    words = b"".join(struct.pack(">II", a, t) for a, t in ((first, 10), (7 << 12 | 3 << 22 | 1 << 11, 20), (1 << 12, 30)))
    (tmp_path / "a.aedat").write_bytes(b"#!AER-DAT2.0\r\n# note\r\n#End Of ASCII Header\r\n" + words)
    got = binary.decode_v2(binary.byte_ranges(spark, str(tmp_path))).orderBy("source_idx").collect()
    assert [r["t_us"] for r in got] == [10, 20, 30]
    assert (got[1]["x"], got[1]["y"], got[1]["p"]) == (7, 3, 1)


def test_version_2_file_in_many_ranges(spark, tmp_path):
    body = b"".join(struct.pack(">II", (i % 346) << 12 | (i % 260) << 22, i) for i in range(500)) + b"\x00\x01\x02"
    (tmp_path / "a.aedat").write_bytes(b"# header\n" + body)
    got = binary.decode_v2(binary.byte_ranges(spark, str(tmp_path), size=64)).orderBy("source_idx").collect()
    assert [r["t_us"] for r in got] == list(range(500)) == [r["source_idx"] for r in got]
    assert all((r["x"], r["y"]) == (i % 346, i % 260) for i, r in enumerate(got))


def test_version_2_drops_words_outside_the_sensor(spark, tmp_path):
    body = b"".join(struct.pack(">II", x << 12 | y << 22, 1) for x, y in ((345, 259), (346, 0), (0, 260)))
    (tmp_path / "a.aedat").write_bytes(b"#End Of ASCII Header\n" + body)
    assert binary.decode_v2(binary.byte_ranges(spark, str(tmp_path))).count() == 1


def test_version_31_packets(spark, tmp_path):
    def packet(kind, overflow, events):
        body = b"".join(struct.pack("<II", w, t) for w, t in events)
        return struct.pack("<hhiiiiii", kind, 0, 8, 4, overflow, len(events), len(events), len(events)) + body
    word = lambda x, y, p, valid: x << 17 | y << 2 | p << 1 | valid
    data = (packet(1, 0, [(word(5, 6, 1, 1), 100), (word(9, 9, 0, 0), 101)]) + packet(0, 0, [(1, 1)])
            + packet(1, 2, [(word(127, 1, 0, 1), 7)]))
    (tmp_path / "u.aedat").write_bytes(b"#!AER-DAT3.1\r\n#End\r\n" + data)
    got = binary.decode_v31(binary.packet_bodies(binary.packet_index(spark, str(tmp_path)))).orderBy("source_idx").collect()
    assert [(r["source_idx"], r["t_us"], r["x"], r["y"], r["p"]) for r in got] == [(0, 100, 5, 6, 1), (2, (2 << 31) + 7, 127, 1, 0)]


def test_whitespace_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("t x y p label\n1 2 3 1 0\n  5\t6 7 0 1 \n9 1 1 1\n")
    got = readers.read_whitespace(spark, str(tmp_path)).orderBy("t_us").collect()
    assert [(r["t_us"], r["x"], r["y"], r["p"], r["label"]) for r in got] == [(1, 2, 3, 1, 0), (5, 6, 7, 0, 1), (9, 1, 1, 1, None)]
    assert [r["source_idx"] for r in got] == sorted(r["source_idx"] for r in got)


def test_seconds_rebase_on_file_order(spark):
    rows = spark.createDataFrame([("a", 0, 2.0, 0.9), ("a", 1, 1.0, 0.1), ("a", 2, 2.0000025, 0.5)], "recording_id string, i int, s double, q double")
    got = {r["i"]: (r["t_us"], r["p"]) for r in readers.normalise_seconds(rows, "s", "q", "i").collect()}
    assert got[0] == (0, 1) and got[1] == (-1_000_000, 0) and got[2][0] in (2, 3)


def test_seconds_rebase_on_one_row_of_equal_places(spark):
    rows = [("a", 7, e, 1.0 + e, 0.9) for e in range(40)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "recording_id string, i int, e int, s double, q double").repartition(4, "e")
        got = {r["e"]: r["t_us"] for r in readers.normalise_seconds(df, "s", "q", "i", "e").collect()}
        assert got == {e: e * 1_000_000 for e in range(40)}


def test_scene_stride_keeps_levels_together(spark):
    rows = spark.createDataFrame([("p", f"s{i}", l) for i in range(5) for l in range(4)], "part string, scene string, level int")
    got = readers.with_scene_stride(rows, "part", "scene", 2).groupBy("scene").count().collect()
    assert {(r["scene"], r["count"]) for r in got} == {("s0", 4), ("s2", 4), ("s4", 4)}


def result(spark, rows):
    return spark.createDataFrame(rows, "recording_id string, method string, raw_mesr double, events bigint, mesr double")


def test_merge_keeps_old_cells_and_refuses_mismatch(spark):
    old = result(spark, [("a", "m", 1.0, 10, 1.1), ("b", "m", 2.0, 20, 2.1)])
    new = result(spark, [("a", "n", 1.0, 10, 1.2), ("b", "n", 2.0, 20, 2.2)])
    assert readers.merge_methods(old, new).count() == 4
    for bad, why in ((new.where("recording_id = 'a'"), "different recordings"),
                     (new.withColumn("events", F.lit(1).cast("bigint")), "inputs differ"),
                     (new.withColumn("method", F.lit("m")), "already present")):
        with pytest.raises(Exception, match=why):
            readers.merge_methods(old, bad).collect()


def test_publish_replaces_whole_tables(spark, tmp_path):
    target = str(tmp_path / "out")
    artifacts.publish(spark.range(5), target)
    artifacts.publish(spark.range(3), target)
    assert spark.read.parquet(target).count() == 3
    assert not list(tmp_path.glob("*.partial*"))


def test_settings_and_fields(spark):
    rows = spark.createDataFrame([("f", "# AEChip: Davis"), ("f", '#  <entry key="C.DVS.Filter" value="true"/>'), ("f", '# <entry key="D.X" value="1"/>')], "file string, line string")
    assert [tuple(r) for r in headers.fields(rows, ["AEChip"]).collect()] == [("f", "AEChip", "Davis")]
    assert [tuple(r) for r in headers.settings(rows, "C.DVS.").collect()] == [("f", "Filter", "true")]
    with pytest.raises(Exception, match="no end of header in f"):
        headers.whole(rows).collect()
    ended = rows.union(spark.createDataFrame([("f", headers.END)], rows.schema))
    assert headers.whole(ended).count() == rows.count() + 1


def test_incremental_sink_resumes(spark, stream, tmp_path):
    frame, _ = stream
    source, target, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    columns = ["recording_id", "event_idx", "t_us", "x", "y", "p", "label"]
    score = lambda df: metric.mesr_unfiltered(df, 100)
    frame.where("recording_id = 'a'").select(columns).coalesce(1).write.parquet(source)
    append_results(spark, source, target, check, "d", score)
    append_results(spark, source, target, check, "d", score)
    assert [r["recording_id"] for r in spark.read.parquet(target).collect()] == ["a"]
    frame.where("recording_id = 'b'").select(columns).coalesce(1).write.mode("append").parquet(source)
    append_results(spark, source, target, check, "d", score)
    assert sorted(r["recording_id"] for r in spark.read.parquet(target).collect()) == ["a", "b"]
    frame.where("recording_id = 'a'").select(columns).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="scored without"):
        append_results(spark, source, target, check, "d", score)


def test_whitespace_rows_that_are_no_events_fail(spark):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    got = readers.parse_whitespace(rows("t x y p label", "# note", " ", "-5 1 2 0 1", " 7\t3 4 1")).collect()
    assert [(r["t_us"], r["x"], r["y"], r["p"], r["label"]) for r in got] == [(-5, 1, 2, 0, 1), (7, 3, 4, 1, None)]
    for bad in ("12.5 1 2 0 1", "1 2 3", "1 2 three 0 1"):
        with pytest.raises(Exception, match="not an event row"):
            readers.parse_whitespace(rows("t x y p", bad)).collect()


def test_scores_without_events_and_events_without_scores_fail(spark):
    events = spark.createDataFrame([("a", i) for i in range(3)], "recording_id string, event_idx long")
    scores = spark.createDataFrame([("a", i, 0.5) for i in range(3)], "recording_id string, event_idx long, score double")
    assert readers.import_scores(events, scores)[0].count() == 3
    for e, s in ((events, scores.where("event_idx < 2")), (events.where("event_idx < 2"), scores)):
        joined, report = readers.import_scores(e, s)
        assert report.first()["unmatched"] == 1
        with pytest.raises(Exception, match="no partner"):
            joined.collect()


def test_headers_of_any_length(spark, tmp_path):
    head = b"".join(b"# %d\n" % i for i in range(200_000))
    (tmp_path / "a.aedat").write_bytes(head + struct.pack(">II", 1 << 12, 9))
    assert [r["t_us"] for r in binary.decode_v2(binary.byte_ranges(spark, str(tmp_path))).collect()] == [9]


def test_failed_publish_keeps_the_old_table(spark, tmp_path):
    target = str(tmp_path / "out")
    artifacts.publish(spark.range(5), target)
    with pytest.raises(Exception):
        artifacts.publish(spark.range(3).selectExpr("raise_error('stop') as id"), target)
    assert spark.read.parquet(target).count() == 5
