"""Queries on scans, sources and sinks, over inputs Spark derives from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import div, micros
from ..operators import downstream, order
from ..sources import artifacts, binary, headers, readers
from ..sources.tables import EVENT_STREAM, event_rows, read
from ..staging import staging_root
from . import sql as Q
from .base import Registry, rounded

registry = Registry()
KEY = "recording_id"
DIGEST = """count(*) AS n, CAST(sum(t_us % 1000003) AS BIGINT) AS t_sum, CAST(sum(x) AS BIGINT) AS x_sum, CAST(sum(y) AS BIGINT) AS y_sum, CAST(sum(p) AS BIGINT) AS p_sum"""


def digest(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("t_us") % 1000003).alias("t_sum"), F.sum("x").alias("x_sum"),
                                 F.sum("y").alias("y_sum"), F.sum("p").alias("p_sum"))


@registry.add("s1_whitespace_table", Q.query([Q.EV], f"""
SELECT recording_id, {DIGEST}, CAST(sum(label) AS BIGINT) AS labels FROM ev WHERE t_us % 5 <> 0 GROUP BY ALL"""))
def _(ws):
    rows = event_rows(ws.spark, ws.sf_dir)
    line = F.when(F.col("t_us") % 5 == 0, F.lit("t x y p label")).otherwise(
        F.concat(F.lit("  "), F.concat_ws(" \t", "t_us", "x", "y", "p", "label")))
    lines = rows.select(KEY, line.alias("value"))
    parsed = readers.parse_whitespace(lines)
    return digest(parsed, KEY).join(parsed.groupBy(KEY).agg(F.sum("label").alias("labels")), KEY)


@registry.add("s2_rate_scene_scan", Q.query([], """
SELECT rate, scene, count(*) AS n FROM (SELECT CAST(l_linenumber AS INTEGER) AS rate, concat('scene-', l_returnflag) AS scene FROM lineitem) WHERE rate IN (1, 3, 5) GROUP BY ALL""").replace("WITH \n", "").strip())
def _(ws):
    path = F.concat(F.lit("/corpus/"), F.col("l_linenumber"), F.lit("hz_scene-"), F.col("l_returnflag"), F.lit(".txt"))
    files = read(ws.spark, ws.sf_dir, "lineitem").select(path.alias("path"))
    return files.withColumns(readers.rate_scene(F.col("path"))).where(F.col("rate").isin(1, 3, 5)).groupBy(
        "rate", "scene").agg(F.count("*").alias("n"))


@registry.add("s3_two_axis_scan", Q.query(Q.STREAMS, """
SELECT scene, CAST(event_idx % 4 AS INTEGER) AS level, count(*) AS n FROM s WHERE scene IN ('ui', 'A') AND event_idx % 4 IN (0, 3) GROUP BY ALL"""))
def _(ws):
    rows = ws.both().withColumn("level", (F.col("event_idx") % 4).cast("int"))
    return readers.scan_subset(rows, ["ui", "A"], [0, 3]).groupBy("scene", "level").agg(F.count("*").alias("n"))


@registry.add("s4_seconds_to_microseconds", """
SELECT recording_id, count(*) AS n, CAST(sum(t) AS BIGINT) AS t_sum, CAST(sum(p) AS BIGINT) AS p_sum, CAST(min(t) AS BIGINT) AS t_min FROM (
  SELECT recording_id, CAST(round_even((sec - first_value(sec) OVER (PARTITION BY recording_id ORDER BY src)) * 1e6, 0) AS BIGINT) AS t, CASE WHEN pol >= 0.5 THEN 1 ELSE 0 END AS p FROM (
    SELECT event_type AS recording_id, (event_id * 7919) % 104729 AS src, event_id AS e, CAST(epoch_us(ts) % 1000000000 AS DOUBLE) / 1000000 AS sec, (event_id % 10) / 10.0 AS pol FROM events))
GROUP BY ALL""")
def _(ws):
    e = read(ws.spark, ws.sf_dir, "events").select(
        F.col("event_type").alias(KEY), ((F.col("event_id") * 7919) % 104729).alias("src"), "event_id",
        ((micros("ts") % 1_000_000_000).cast("double") / 1_000_000).alias("sec"),
        ((F.col("event_id") % 10) / 10.0).alias("pol"))
    return readers.normalise_seconds(e, "sec", "pol", "src", "event_id").groupBy(KEY).agg(
        F.count("*").alias("n"), F.sum("t_us").alias("t_sum"), F.sum("p").alias("p_sum"), F.min("t_us").alias("t_min"))


NAMES = "concat('corpus/', CASE WHEN l_suppkey % 2 = 0 THEN 'D-END' ELSE 'N-END' END, '/S', lpad(CAST(l_suppkey AS VARCHAR), 4, '0'), '-ND', lpad(CAST(l_linenumber % 4 AS VARCHAR), 2, '0'), '-', l_partkey % 3)"


@registry.add("s5_scene_stride", f"""
WITH r AS (SELECT name, split_part(name, '/', 2) AS part, regexp_extract(name, '/(S[0-9]+)-ND', 1) AS scene, regexp_extract(name, '-(ND[0-9]+)-', 1) AS level,
  regexp_extract(name, '-([0-9]+)$', 1) AS repetition, n FROM (SELECT {NAMES} AS name, count(*) AS n FROM lineitem GROUP BY ALL)),
d AS (SELECT part, scene FROM (SELECT part, scene, row_number() OVER (PARTITION BY part ORDER BY scene) - 1 AS i FROM (SELECT DISTINCT part, scene FROM r)) WHERE i % 4 = 0)
SELECT name, part, scene, level, repetition, n FROM r JOIN d USING (part, scene) WHERE repetition IN ('0', '2')""")
def _(ws):
    c = F.col
    name = F.concat(F.lit("corpus/"), F.when(c("l_suppkey") % 2 == 0, "D-END").otherwise("N-END"), F.lit("/S"),
                    F.lpad(c("l_suppkey").cast("string"), 4, "0"), F.lit("-ND"),
                    F.lpad((c("l_linenumber") % 4).cast("string"), 2, "0"), F.lit("-"), (c("l_partkey") % 3).cast("string"))
    recs = read(ws.spark, ws.sf_dir, "lineitem").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    parsed = recs.withColumns(readers.name_parts("name"))
    return readers.with_scene_stride(parsed, "part", "scene", 4).where(c("repetition").isin("0", "2"))


@registry.add("s6_all_noise_scan", Q.query([Q.EV], """
SELECT concat('b', x % 7) AS level, count(*) AS n, count(*) AS labels FROM ev GROUP BY ALL"""))
def _(ws):
    path = F.concat(F.lit("/blank/b"), F.col("x") % 7, F.lit("-take-"), F.col("y"), F.lit(".aedat"))
    rows = readers.all_noise(ws.stream(EVENT_STREAM).drop("label").withColumn("path", path), "path")
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


def _hex(value, digits=8):
    return F.lpad(F.hex(value), digits, "0")


def _little(value):
    h = _hex(value)
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


@registry.add("s7_binary_v2_decode", Q.query([Q.EV], f"""
SELECT recording_id, {DIGEST} FROM (SELECT recording_id, t_us % 2147483648 AS t_us, x * 8 AS x, y * 6 AS y, p FROM ev) WHERE x < 346 AND y < 260 GROUP BY ALL"""))
def _(ws):
    s = ws.stream(EVENT_STREAM)
    address = F.shiftleft((F.col("x") * 8).cast("bigint"), 12).bitwiseOR(
        F.shiftleft((F.col("y") * 6).cast("bigint"), 22)).bitwiseOR(F.shiftleft(F.col("p").cast("bigint"), 11))
    pair = F.concat(_hex(address), _hex(F.col("t_us") % 2147483648))
    ranges = s.groupBy(KEY, div("event_idx", 512).alias("blk")).agg(
        F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_idx", pair.alias("h")))), lambda r: r["h"]), "")).alias("content"))
    decoded = binary.decode_v2(ranges.select(F.col(KEY).alias("path"), (F.col("blk") * 4096).alias("offset"), "content"))
    return digest(decoded.withColumnRenamed("path", KEY), KEY)


@registry.add("s8_binary_v31_decode", Q.query([Q.EV], f"""
SELECT recording_id, {DIGEST} FROM (SELECT recording_id, t_us % 2147483648 + (event_idx // 256 % 3) * 2147483648 AS t_us, x, y, p FROM ev WHERE event_idx % 11 <> 0) GROUP BY ALL"""))
def _(ws):
    s = ws.stream(EVENT_STREAM)
    w = F.shiftleft(F.col("x").cast("bigint"), 17).bitwiseOR(F.shiftleft(F.col("y").cast("bigint"), 2)).bitwiseOR(
        F.shiftleft(F.col("p").cast("bigint"), 1)).bitwiseOR((F.col("event_idx") % 11 != 0).cast("bigint"))
    pair = F.concat(_little(w), _little(F.col("t_us") % 2147483648))
    bodies = s.groupBy(KEY, div("event_idx", 256).alias("blk")).agg(
        F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_idx", pair.alias("h")))), lambda r: r["h"]), "")).alias("content"))
    decoded = binary.decode_v31(bodies.select(F.col(KEY).alias("path"), (F.col("blk") * 256).alias("first"),
                                              (F.col("blk") % 3).alias("overflow"), "content"))
    return digest(decoded.withColumnRenamed("path", KEY), KEY)


@registry.add("s9_session_scan", """
SELECT session, drop_tag, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'A' THEN 'HDD' ELSE 'IV' END AS session,
  CASE WHEN l_linenumber % 3 = 0 THEN 'staircase' ELSE concat(l_linenumber % 3, 'Hz') END AS drop_tag FROM lineitem WHERE l_linenumber <> 7) GROUP BY ALL""")
def _(ws):
    n = F.col("l_linenumber")
    stem = F.when(n == 7, "calibration_1_x").when(n % 3 == 0, "take").otherwise(F.concat(F.lit("take_"), n % 3, F.lit("Hz_a")))
    folder = F.when(F.col("l_returnflag") == "A", "rec-HDD").otherwise("rec-IV")
    files = read(ws.spark, ws.sf_dir, "lineitem").select(F.concat(F.lit("/r/"), folder, F.lit("/"), stem, F.lit(".aedat")).alias("path"))
    return readers.drop_sessions(files, "path").groupBy("session", "drop_tag").agg(F.count("*").alias("n"))


DISORDER = """dis AS (SELECT event_type AS recording_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS source_idx,
  epoch_us(ts) + CASE WHEN event_id % 9 = 0 THEN 3600000000 ELSE 0 END AS t_us, CAST(user_id % 64 AS INTEGER) AS x FROM events)"""


def disordered(ws) -> DataFrame:
    """Events in arrival order with every ninth timestamp an hour late."""
    def build():
        e = read(ws.spark, ws.sf_dir, "events").select(
            F.col("event_type").alias(KEY), "event_id",
            (micros("ts") + F.when(F.col("event_id") % 9 == 0, 3_600_000_000).otherwise(0)).alias("t_us"),
            (F.col("user_id") % 64).cast("int").alias("x"))
        return order.assign_event_index(e, [KEY], ["event_id"], "arrival").withColumnRenamed("event_idx", "source_idx")
    return ws.once("disordered", build)


@registry.add("s10_time_order_report", Q.query([DISORDER], """
SELECT recording_id, count(*) AS rows, CAST(coalesce(sum(inv), 0) AS BIGINT) AS inversions, coalesce(sum(inv), 0) > 0 AS repaired FROM (
  SELECT recording_id, CAST(t_us < lag(t_us) OVER (PARTITION BY recording_id ORDER BY source_idx) AS INTEGER) AS inv FROM dis) GROUP BY ALL"""))
def _(ws):
    return order.time_order_report(disordered(ws), KEY, "source_idx", bucket=300)


@registry.add("s10_stable_repair", Q.query([DISORDER, "fixed AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_us, source_idx) - 1 AS event_idx FROM dis)"], """
SELECT recording_id, count(*) AS n, CAST(sum((event_idx % 1000003) * x) AS BIGINT) AS digest, CAST(sum((event_idx % 1000003) * (source_idx % 1000003) % 1000003) AS BIGINT) AS moved FROM fixed GROUP BY ALL"""))
def _(ws):
    return readers.repair_time_order(disordered(ws)).groupBy(KEY).agg(
        F.count("*").alias("n"), F.sum((F.col("event_idx") % 1000003) * F.col("x")).alias("digest"),
        F.sum((F.col("event_idx") % 1000003) * (F.col("source_idx") % 1000003) % 1000003).alias("moved"))


@registry.add("s11_event_cap", Q.query([*Q.STREAMS, "cap AS (SELECT dataset, max(n) // 2 AS cap FROM (SELECT dataset, recording_id, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL)"], f"""
SELECT dataset, recording_id, {DIGEST} FROM s JOIN cap USING (dataset) WHERE event_idx < cap GROUP BY ALL"""))
def _(ws):
    """The cap is half of each corpus's longest recording, so the share it keeps holds at any size."""
    caps = ws.recordings().groupBy("dataset").agg(div(F.max("n_events"), 2).alias("cap"))
    return digest(order.cap_events(ws.both().join(F.broadcast(caps), "dataset"), F.col("cap")), "dataset", KEY)


@registry.add("s12_recording_limit", Q.query(Q.STREAMS, f"""
SELECT dataset, recording_id, {DIGEST} FROM s WHERE (dataset, recording_id) IN (SELECT (dataset, recording_id) FROM (
  SELECT dataset, recording_id, dense_rank() OVER (PARTITION BY dataset ORDER BY recording_id) AS i FROM (SELECT DISTINCT dataset, recording_id FROM s)) WHERE i <= 2) GROUP BY ALL"""))
def _(ws):
    return digest(readers.limit_recordings(ws.both(), ws.recordings(), 2), "dataset", KEY)


INTERVALS = """iv AS (SELECT recording_id, concat(recording_id, '-', d) AS clip, CAST(d % 11 AS INTEGER) AS class, d * 86400000000 AS start_us, d * 86400000000 + 21600000000 AS stop_us
  FROM (SELECT DISTINCT recording_id, t_us // 86400000000 AS d FROM ev)),
ce AS (SELECT iv.clip, iv.class, e.* FROM ev e JOIN iv ON iv.recording_id = e.recording_id AND e.t_us >= start_us AND e.t_us < stop_us),
cn AS (SELECT clip, count(*) AS n, min(event_idx) AS i0, min(t_us) AS t0 FROM ce GROUP BY clip),
cs AS (SELECT ce.*, ce.event_idx - i0 AS j, ce.t_us - t0 AS t_rel, n AS full_n FROM ce JOIN cn USING (clip) WHERE n >= {minimum})"""


def intervals(ws) -> DataFrame:
    day = div("t_us", downstream.DAY_US)
    days = ws.stream(EVENT_STREAM).select(KEY, day.alias("d")).distinct()
    return days.select(KEY, F.concat_ws("-", KEY, "d").alias("clip"), (F.col("d") % 11).cast("int").alias("class"),
                       (F.col("d") * downstream.DAY_US).alias("start_us"),
                       (F.col("d") * downstream.DAY_US + 21_600_000_000).alias("stop_us"))


def clips(ws) -> DataFrame:
    return downstream.clip_events(ws.stream(EVENT_STREAM), intervals(ws))


@registry.add("s13_clip_samples", Q.query([Q.EV, INTERVALS.format(minimum=12)], """
SELECT clip, class, count(*) AS n, CAST(sum(t_rel) AS BIGINT) AS t_sum, CAST(max(j) AS BIGINT) AS last_j FROM cs GROUP BY ALL"""))
def _(ws):
    s = downstream.clip_samples(clips(ws), None, 12)
    return s.groupBy("clip", "class").agg(F.count("*").alias("n"), F.sum("t_rel").alias("t_sum"), F.max("j").alias("last_j"))


@registry.add("s14_whole_clips", Q.query([Q.EV, INTERVALS.format(minimum=16)], """
SELECT clip, split_part(clip, '-', 1) AS subject, count(*) AS n, CAST(sum(t_rel) AS BIGINT) AS t_sum FROM cs GROUP BY ALL"""))
def _(ws):
    s = downstream.clip_samples(clips(ws), None, 16)
    return s.groupBy("clip", F.split_part("clip", F.lit("-"), F.lit(1)).alias("subject")).agg(
        F.count("*").alias("n"), F.sum("t_rel").alias("t_sum"))


@registry.add("s15_clip_coverage", Q.query([Q.EV, INTERVALS.format(minimum=14)], """
SELECT class, count(*) AS offered, count(k.clip) AS kept FROM iv LEFT JOIN (SELECT DISTINCT clip FROM cs) k ON k.clip = iv.clip GROUP BY GROUPING SETS ((class), ())"""))
def _(ws):
    return downstream.clip_coverage(intervals(ws), downstream.clip_samples(clips(ws), None, 14))


@registry.add("s16_nested_artifact", Q.query(Q.BENCH, """
SELECT dataset, recording_id, method, r_pct, round(raw_mesr, 9) AS raw_mesr, round(mesr, 9) AS mesr, kept_events, evaluable FROM crv"""))
def _(ws):
    path = f"{staging_root(ws.spark)}/streamquality/records-{uuid.uuid4().hex}"
    artifacts.write_records(artifacts.nest_curve(ws.curve()), path)
    return rounded(artifacts.flatten_records(artifacts.read_records(ws.spark, path)))


@registry.add("s17_resume_append", Q.query([*Q.STREAMS, "z AS (SELECT dataset, recording_id, count(*) AS n FROM s GROUP BY ALL)"], "SELECT dataset, recording_id, n FROM z"))
def _(ws):
    sizes = ws.both().groupBy("dataset", KEY).agg(F.count("*").alias("n"))
    path = f"{staging_root(ws.spark)}/streamquality/resume-{uuid.uuid4().hex}"
    sizes.where("dataset = 'ev'").write.partitionBy("dataset").parquet(path)
    left = artifacts.pending(sizes, ws.spark.read.parquet(path))
    left.write.mode("append").partitionBy("dataset").parquet(path)
    return ws.spark.read.parquet(path)


@registry.add("s18_atomic_publish", Q.query(Q.STREAMS, "SELECT dataset, scene, count(*) AS n FROM s GROUP BY ALL"))
def _(ws):
    path = f"{staging_root(ws.spark)}/streamquality/published-{uuid.uuid4().hex}"
    for part in (ws.both().where("dataset = 'ev'"), ws.both()):
        artifacts.publish(part.groupBy("dataset", "scene").agg(F.count("*").alias("n")), path)
    return ws.spark.read.parquet(path)


def imported(ws) -> DataFrame:
    return ws.stream(EVENT_STREAM).select(KEY, "event_idx", F.when(F.col("event_idx") % 40 == 0, 2.0).otherwise(
        F.col("sc") / 1000).alias("score"))


@registry.add("s19_score_import", Q.query([Q.EV], """
SELECT recording_id, count(*) AS events, count(*) FILTER (WHERE event_idx % 50 <> 0) AS scores, count(*) FILTER (WHERE event_idx % 50 = 0) AS unmatched FROM ev GROUP BY ALL"""))
def _(ws):
    scores = imported(ws).where("event_idx % 50 <> 0")
    return readers.import_scores(ws.stream(EVENT_STREAM), scores)[1]


@registry.add("s20_score_manifest", Q.query([Q.EV, "im AS (SELECT recording_id, event_idx, CASE WHEN event_idx % 40 = 0 THEN 2.0 ELSE sc / 1000 END AS score FROM ev)"], f"""
SELECT recording_id, count(*) AS events, count(*) FILTER (WHERE score <> 2.0) AS scored, count(*) FILTER (WHERE score < 0.005) AS kept,
  bit_xor({Q.word('recording_id', 'event_idx', 'CAST(round(score * 1e6) AS BIGINT)')}) AS checksum FROM im GROUP BY ALL"""))
def _(ws):
    return readers.score_manifest(imported(ws), "md5")


@registry.add("s21_merge_methods", Q.query(Q.BENCH, """
SELECT dataset || '/' || recording_id AS recording_id, method, round(raw_mesr, 9) AS raw_mesr, n_events AS events, round(mesr, 9) AS mesr FROM crv WHERE r_pct = 60 AND method IN ('fa', 'fb', 'sc')"""))
def _(ws):
    rows = ws.curve().where("r_pct = 60").select(
        F.concat_ws("/", "dataset", KEY).alias(KEY), "method", "raw_mesr", F.col("n_events").alias("events"), "mesr")
    return rounded(readers.merge_methods(rows.where("method IN ('fa', 'fb')"), rows.where("method = 'sc'")))


ATTR = r'([a-z]+)="[^"]*"'
ALLOWED = ["href", "lang", "class"]


@registry.add("s22_header_keys", f"""
SELECT key, count(*) AS n, count(DISTINCT page_id) AS files FROM (SELECT page_id, unnest(regexp_extract_all(html, '{ATTR}', 1)) AS key FROM pages) GROUP BY key""")
def _(ws):
    files = read(ws.spark, ws.sf_dir, "pages").select(F.col("page_id").alias("file"), "html")
    return headers.key_counts(headers.attribute_keys(files, "html", ATTR))


@registry.add("s22_unexpected_keys", f"""
SELECT key, count(*) AS n, count(DISTINCT page_id) AS files FROM (SELECT page_id, unnest(regexp_extract_all(html, '{ATTR}', 1)) AS key FROM pages) WHERE key NOT IN ('href', 'lang', 'class') GROUP BY key""")
def _(ws):
    files = read(ws.spark, ws.sf_dir, "pages").select(F.col("page_id").alias("file"), "html")
    return headers.unexpected_keys(headers.attribute_keys(files, "html", ATTR), ALLOWED)


def header_lines(ws) -> DataFrame:
    e = read(ws.spark, ws.sf_dir, "events")
    file = F.concat_ws("-", "event_type", F.col("user_id") % 40)
    field = F.concat(F.lit("# HardwareInterface: usb"), F.col("user_id") % 3)
    entry = F.concat(F.lit('#   <entry key="Chip.DVS.Filter'), F.col("event_id") % 6, F.lit('" value="'),
                     F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"), F.lit('"/>'))
    other = F.concat(F.lit('#   <entry key="Chip.Other" value="'), F.col("event_id") % 2, F.lit('"/>'))
    lines = e.select(file.alias("file"), F.explode(F.array(field, entry, other)).alias("line"))
    return headers.whole(lines.unionByName(lines.select("file", F.lit(headers.END).alias("line")).distinct()))


@registry.add("s23_header_fields", """
SELECT 'HardwareInterface' AS name, concat('usb', user_id % 3) AS value, count(DISTINCT concat(event_type, '-', user_id % 40)) AS files FROM events GROUP BY ALL""")
def _(ws):
    return headers.field_counts(headers.fields(header_lines(ws), ["HardwareInterface"]))


@registry.add("s23_device_filters", """
SELECT concat('Filter', event_id % 6) AS key, CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS value, count(DISTINCT concat(event_type, '-', user_id % 40)) AS files FROM events GROUP BY ALL""")
def _(ws):
    return headers.setting_counts(headers.settings(header_lines(ws), "Chip.DVS."))


CHAINS = """fl AS (SELECT l_orderkey % 500 AS file, min(l_returnflag) AS session, list_sort(list(DISTINCT concat('F', l_suppkey % 4)) FILTER (WHERE l_quantity > 48)) AS chain,
  coalesce(list_sort(list(DISTINCT concat('F', l_partkey % 6)) FILTER (WHERE l_tax > 0.075)), []) AS enabled FROM lineitem GROUP BY ALL)"""


def chain_files(ws) -> DataFrame:
    li = read(ws.spark, ws.sf_dir, "lineitem")
    chain = F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 48, F.concat(F.lit("F"), F.col("l_suppkey") % 4))))
    enabled = F.array_sort(F.collect_set(F.when(F.col("l_tax") > 0.075, F.concat(F.lit("F"), F.col("l_partkey") % 6))))
    files = li.groupBy((F.col("l_orderkey") % 500).alias("file")).agg(
        F.min("l_returnflag").alias("session"), chain.alias("chain"), enabled.alias("enabled"))
    return files.withColumn("chain", F.when(F.size("chain") > 0, F.col("chain")))


@registry.add("s24_filter_chains", Q.query([CHAINS], """
SELECT array_to_string(chain, ',') AS chain, count(*) AS files, count(*) FILTER (WHERE NOT list_has_any(chain, enabled)) AS idle, count(*) FILTER (WHERE session = 'A') AS session_a
FROM fl WHERE chain IS NOT NULL AND len(chain) > 0 GROUP BY ALL"""))
def _(ws):
    census = headers.chain_census(chain_files(ws))
    return census.select(F.array_join("chain", ",").alias("chain"), "files", "idle",
                         F.coalesce(F.try_element_at("sessions", F.lit("A")), F.lit(0)).alias("session_a"))


@registry.add("s24_enabled_filters", Q.query([CHAINS], """
SELECT filter, list_contains(chain, filter) AS in_chain, count(*) AS files FROM (SELECT chain, unnest(enabled) AS filter FROM fl WHERE chain IS NOT NULL AND len(chain) > 0) GROUP BY ALL"""))
def _(ws):
    return headers.enabled_filters(chain_files(ws))
