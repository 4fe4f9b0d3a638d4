"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from streamquality.plans.catalog import ALL
from streamquality.sources.tables import EVENT_STREAM, WIDE_STREAM, Workspace

CPUS = os.environ.get("BENCH_CPUS", "8")
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = [
    "m2_esr_per_slice", "m3_mesr", "m3_mesr_of_masks", "m13_median_filter_variant", "p3_block_quota_retention",
    "p12_mark_shuffle_whole", "p14_hot_pixel_removal", "d8_packets", "d10_route_comparison",
    "d12_known_auc_scores", "d15_neighbourhood_support", "r6_regime_profile", "r8_two_group_on_crossed",
    "o5_native_output_oracle", "o11_native_marginals", "o12_masks_at_native", "o4_tally_at_native",
    "n1_fixed_gain", "n3_draw_sensitivity", "n9_shuffle_summary", "b2_cluster_bootstrap", "b5_paired_accuracy",
    "a9_paired_contrasts", "a20_rank_report", "a12_slice_rank_agreement", "s13_clip_samples", "w7_condition_summary",
]


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    ws = Workspace(spark, SF_DIR)
    by_name = {q.name: q for q in ALL}
    timings: dict[str, float] = {}

    def timed(name, action) -> None:
        start = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - start, 3)

    timed("ingest_events", lambda: ws.stream(EVENT_STREAM))
    timed("ingest_wide", lambda: ws.stream(WIDE_STREAM))
    timed("benchmark_grid", lambda: ws.curve())
    for name in HEADLINE:
        timed(name, lambda: by_name[name].build(ws).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
