"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import workspace
from . import analyses, controls, outputs, positions, regimes, scans, utility

AREAS = (scans, positions, outputs, regimes, controls, analyses, utility)
ALL = [q for area in AREAS for q in area.registry]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = workspace(spark, sf_dir).curve()
    return curve.select("dataset", "recording_id", "method", "r_pct", "mesr", "kept_events",
                        "evaluable", (F.col("mesr") - F.col("raw_mesr")).alias("delta_over_raw"))
