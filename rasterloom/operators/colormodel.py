"""Colour models: aggregates of HSV samples per frame."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.color import clamp8
from rasterloom.functions.numeric import lim_mod, wrap


def mean_hsv(pixels: DataFrame, legacy_units: bool = False) -> DataFrame:
    """Mean colour per frame, hue as a circular mean in degrees. `legacy_units` reads the hue as turns."""
    turn = F.col("h") * (2 * math.pi) if legacy_units else F.radians("h")
    back = 1 / (2 * math.pi) if legacy_units else 180 / math.pi
    hue = F.atan2(F.sum(F.sin(turn)), F.sum(F.cos(turn))) * back
    mean = pixels.groupBy("frame_id").agg(hue.alias("h"), F.avg("s").alias("s"), F.avg("v").alias("v"))
    return mean.withColumn("h", wrap(F.col("h"), 1.0 if legacy_units else 360.0))


def with_deviation(pixels: DataFrame) -> DataFrame:
    """Adds `deviation`, the distance to the frame's mean colour (circular hue, unit scales)."""
    mean = mean_hsv(pixels).select("frame_id", F.col("h").alias("mh"), F.col("s").alias("ms"), F.col("v").alias("mv"))
    d = F.abs(F.col("h") - F.col("mh")) / 360
    hue = F.least(d, 1 - d)
    out = F.sqrt(hue * hue + F.pow((F.col("s") - F.col("ms")) / 100, F.lit(2)) + F.pow((F.col("v") - F.col("mv")) / 100, F.lit(2)))
    return pixels.join(mean, "frame_id").withColumn("deviation", out).drop("mh", "ms", "mv")


def hsv_mad(pixels: DataFrame) -> DataFrame:
    """Mean distance to the mean colour per frame."""
    return with_deviation(pixels).groupBy("frame_id").agg(F.avg("deviation").alias("mad"))


def hue_buckets(pixels: DataFrame, size: int = 5) -> DataFrame:
    """Distinct (hue, s, v): each sample at every whole hue of its bucket."""
    low = lim_mod(F.floor("h").cast("int"), size)
    at = pixels.select(low.alias("low"), F.floor("s").cast("int").alias("s"), F.floor("v").cast("int").alias("v")).distinct()
    return at.select(F.explode(F.sequence(F.col("low"), F.col("low") + (size - 1))).alias("hue"), "s", "v")


def sample_regions(pixels: DataFrame, grow: int = 0, size: int = 5) -> DataFrame:
    """(hue, s, v_lo, v_hi): the span of the samples of each hue at every saturation between their
    extremes; missing saturations are interpolated between the nearest ones that have samples."""
    spans = hue_buckets(pixels, size).groupBy("hue", "s").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    reach = spans.groupBy("hue").agg(F.min("s").alias("s0"), F.max("s").alias("s1"))
    grid = reach.select("hue", F.explode(F.sequence("s0", "s1")).alias("s"))
    full = grid.join(spans, ["hue", "s"], "left").withColumn("at", F.when(F.col("lo").isNotNull(), F.col("s")))
    back = Window.partitionBy("hue").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("hue").orderBy("s").rowsBetween(0, Window.unboundedFollowing)
    ends = full.select(
        "hue", "s",
        *[F.last(c, True).over(back).alias(f"{c}0") for c in ("at", "lo", "hi")],
        *[F.first(c, True).over(ahead).alias(f"{c}1") for c in ("at", "lo", "hi")],
    )
    t = F.coalesce(F.try_divide((F.col("s") - F.col("at0")).cast("double"), F.col("at1") - F.col("at0")), F.lit(0.0))
    mix = lambda a: F.floor(F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * t).cast("int")
    return ends.select("hue", "s", F.greatest(mix("lo") - grow, F.lit(0)).alias("v_lo"), F.least(mix("hi") + grow, F.lit(100)).alias("v_hi"))


def deviation_bands(pixels: DataFrame) -> DataFrame:
    """Adds `alpha`, the deviation over the frame's largest, and `band`, its tenth (0..10)."""
    top = F.max("deviation").over(Window.partitionBy("frame_id"))
    alpha = F.coalesce(F.try_divide(F.col("deviation"), top), F.lit(0.0))
    return with_deviation(pixels).withColumn("alpha", alpha).withColumn("band", F.floor(F.col("alpha") * 10).cast("int"))


def average_filter(pixels: DataFrame) -> DataFrame:
    """Every pixel (a, r, g, b) as its frame's mean, rounded: one aggregate and a join on the frame."""
    mean = pixels.groupBy("frame_id").agg(*[clamp8(F.avg(c)).alias(c) for c in "argb"])
    return pixels.select("frame_id", "x", "y").join(mean, "frame_id")


def paint_specimen(pixels: DataFrame) -> DataFrame:
    """Absolute difference of opaque pixels and their frame's mean, per channel."""
    mean = pixels.groupBy("frame_id").agg(*[clamp8(F.avg(c)).alias(f"m{c}") for c in "rgb"])
    return pixels.join(mean, "frame_id").select("frame_id", "x", "y", *[F.abs(F.col(c) - F.col(f"m{c}")).alias(c) for c in "rgb"])
