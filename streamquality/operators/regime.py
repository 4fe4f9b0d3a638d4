"""Stream characterisation: busiest pixels, neighbour occupancy, coupling, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


from ..functions.numeric import safe_corr
from ..schema import HOT_PERCENTILE, REGIME_MIN_EVENTS, REGIME_WINDOW_US
from ..staging import attach
from .metric import pixel_counts
from .order import with_mask_positions, with_time_window

KEY = "recording_id"


def hot_pixels(events: DataFrame, percentile: float = HOT_PERCENTILE) -> DataFrame:
    """Counts per occupied pixel with ``is_hot``: at or above the percentile of the counts.

    One row per occupied pixel, so everything after the first aggregation is sensor-sized.
    """
    counts = pixel_counts(events, [KEY])
    bars = counts.groupBy(KEY).agg(F.percentile("n", F.lit(percentile / 100.0)).alias("_bar"))
    return counts.join(bars, KEY).withColumn("is_hot", F.col("n") >= F.col("_bar")).drop("_bar")


def hot_removal_report(pixels: DataFrame) -> DataFrame:
    """What removal would drop; ``applied`` is false where it would empty the recording."""
    hot = F.sum(F.when(F.col("is_hot"), F.col("n")).otherwise(0))
    total = F.sum("n")
    return pixels.groupBy(KEY).agg(
        total.alias("events_before"), hot.alias("events_removed"),
        (hot / total).alias("share_removed"), F.count_if("is_hot").alias("hot_pixels"),
        F.count("*").alias("occupied_pixels"),
        (F.count_if(~F.col("is_hot")) > 0).alias("applied")).withColumn(
        "events_after", F.when(F.col("applied"), F.col("events_before") - F.col("events_removed"))
        .otherwise(F.col("events_before")))


def remove_hot_pixels(events: DataFrame, percentile: float, block: int) -> DataFrame:
    """The stream without its busiest pixels, re-indexed; unchanged where nothing would remain."""
    pixels = hot_pixels(events, percentile)
    drop = pixels.where("is_hot").join(
        hot_removal_report(pixels).where("applied").select(KEY), KEY).select(
        KEY, "x", "y", F.lit(True).alias("_hot"))
    # only the busiest pixels travel, a thousandth of the sensor per recording
    kept = attach(events, drop, [KEY, "x", "y"], "left", "hot").withColumn(
        "cold", F.col("_hot").isNull()).drop("_hot")
    placed = with_mask_positions(kept, ["cold"], block)
    return placed.where("cold").withColumn("event_idx", F.col("cold_pos")).select(*events.columns)


def hot_pixel_share(events: DataFrame, percentile: float = HOT_PERCENTILE) -> DataFrame:
    return hot_pixels(events, percentile).groupBy(KEY).agg(
        (F.sum(F.when(F.col("is_hot"), F.col("n")).otherwise(0)) / F.sum("n"))
        .alias("hot_pixel_share"))


def neighbour_shares(events: DataFrame, sensors: DataFrame, window_us: int,
                     min_events: int) -> DataFrame:
    """Per time window: events, and the share with an occupied 8-neighbour in the window.

    Works on distinct occupied pixels. Each pixel announces itself to its neighbours; a pixel
    both occupied and announced to has a neighbour. No join: both facts meet in one aggregation.
    """
    keys = [KEY, "win"]
    pixels = with_time_window(events, window_us).groupBy(*keys, "x", "y").agg(
        F.count("*").alias("n"))
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                        for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    inside = ((F.col("x") >= 0) & (F.col("y") >= 0)
              & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height")))
    reach = pixels.select(*keys, "x", "y", "n", F.inline(offsets)).select(
        *keys, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"),
        F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("n")).alias("own"),
        F.when((F.col("dx") != 0) | (F.col("dy") != 0), 1).alias("near"))
    met = (reach.repartition(*keys).groupBy(*keys, "x", "y")
           .agg(F.sum("own").alias("n"), F.max("near").alias("near")).where(F.col("n").isNotNull()))
    met = met.join(sensors.select(KEY, "width", "height"), KEY)
    return met.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.when(F.col("near").isNotNull() & inside, F.col("n")).otherwise(0)) / F.sum("n"))
        .alias("share")).where(F.col("n") >= min_events)


def spatial_autocorrelation(shares: DataFrame) -> DataFrame:
    """Unweighted mean of the window shares."""
    return shares.groupBy(KEY).agg(F.avg("share").alias("spatial_autocorr"))


def local_global_coupling(shares: DataFrame) -> DataFrame:
    """Correlation of window share and window count; NULL below 3 windows, 0 if one is flat."""
    flat = (F.stddev_pop("share") == 0) | (F.stddev_pop("n") == 0)
    return shares.groupBy(KEY).agg(
        F.when(F.count("*") < 3, F.lit(None).cast("double")).when(flat, 0.0)
        .otherwise(safe_corr("share", F.col("n").cast("double"))).alias("local_global_coupling"))


def event_rate_per_px(events: DataFrame, sensors: DataFrame) -> DataFrame:
    span = F.max("t_us") - F.min("t_us")
    rate = events.groupBy(KEY).agg(F.count("*").alias("events"), span.alias("_span"))
    return rate.join(sensors.select(KEY, "width", "height"), KEY).select(
        KEY, "events", F.when(F.col("_span") <= 0, 0.0).otherwise(
            F.col("events") / (F.col("_span") * 1e-6) / (F.col("width") * F.col("height")))
        .alias("event_rate_per_px"))


def regime_profile(events: DataFrame, sensors: DataFrame, window_us: int = REGIME_WINDOW_US,
                   min_events: int = REGIME_MIN_EVENTS,
                   percentile: float = HOT_PERCENTILE) -> DataFrame:
    """The four statistics per recording."""
    shares = neighbour_shares(events, sensors, window_us, min_events)
    local = shares.groupBy(KEY).agg(
        F.avg("share").alias("spatial_autocorr"),
        F.when(F.count("*") < 3, F.lit(None).cast("double"))
        .when((F.stddev_pop("share") == 0) | (F.stddev_pop("n") == 0), 0.0)
        .otherwise(safe_corr("share", F.col("n").cast("double"))).alias("local_global_coupling"))
    return (event_rate_per_px(events, sensors).join(hot_pixel_share(events, percentile), KEY)
            .join(local, KEY, "left"))
