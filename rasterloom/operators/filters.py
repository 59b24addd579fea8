"""Filters over pixel rows, hue regions and learned ink bands.

Pixels are rows (frame_id, x, y, ...); predicates are boolean columns, so each of these is one pass
over the rows, pushed down to the scan where the source allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCH, NO_MATCH = -1, -16777215


def filter_pixels(pixels: DataFrame, pred: Column) -> DataFrame:
    """Points (frame_id, x, y) of the pixels that satisfy the predicate."""
    return pixels.where(pred).select("frame_id", "x", "y")


def mask_pixels(pixels: DataFrame, pred: Column) -> DataFrame:
    """Every pixel as one of two marker colours."""
    return pixels.select("frame_id", "x", "y", F.when(pred, MATCH).otherwise(NO_MATCH).alias("argb"))


def split_pixels(pixels: DataFrame, pred: Column) -> tuple[DataFrame, DataFrame]:
    """Matching and other pixels; rows whose predicate is null are others."""
    known = F.coalesce(pred, F.lit(False))
    return pixels.where(known), pixels.where(~known)


def first_match(pixels: DataFrame, preds: list[Column]) -> DataFrame:
    """Adds `label`, the position of the first predicate that a pixel satisfies; null for none."""
    label = F.coalesce(*[F.when(p, i) for i, p in enumerate(preds)])
    return pixels.withColumn("label", label.cast("int"))


def pixels_of_color(pixels: DataFrame, argb: int) -> DataFrame:
    return filter_pixels(pixels, F.col("argb") == argb)


def columns_of_color(pixels: DataFrame, argb: int) -> DataFrame:
    """frame_id, x and the sorted y values of a colour."""
    found = pixels_of_color(pixels, argb)
    return found.groupBy("frame_id", "x").agg(F.array_sort(F.collect_list("y")).alias("ys"))


def build_hue_regions(lines: DataFrame, hue_min: int, hue_max: int, lower: bool = False) -> DataFrame:
    """(hue, s, v_lo, v_hi) filled below (or with `lower`, above) a boundary of lines (s0, v0, s1, v1)
    over saturations 0..100. Gaps between lines are bridged from one line's end to the next one's
    start, values stay within 0..100; saturations outside every line take the nearest end."""
    order = Window.orderBy("s0", "s1")  # a boundary is a handful of lines
    ends = lines.select("s0", "v0", "s1", "v1")
    gap = ends.withColumn("ns", F.lead("s0").over(order)).withColumn("nv", F.lead("v0").over(order))
    bridges = gap.where("ns > s1").select(F.col("s1").alias("s0"), F.col("v1").alias("v0"), F.col("ns").alias("s1"), F.col("nv").alias("v1"))
    pieces = ends.unionAll(bridges)
    first, last = ends.orderBy("s0").limit(1), ends.orderBy(F.desc("s1")).limit(1)
    flat = first.where("s0 > 0").select(F.lit(0).alias("s0"), "v0", F.col("s0").alias("s1"), F.col("v0").alias("v1"))
    tail = last.where("s1 < 100").select(F.col("s1").alias("s0"), F.col("v1").alias("v0"), F.lit(100).alias("s1"), "v1")
    every = pieces.unionByName(flat).unionByName(tail).withColumn("s", F.explode(F.sequence(F.col("s0").cast("int"), F.col("s1").cast("int"))))
    t = F.coalesce(F.try_divide((F.col("s") - F.col("s0")).cast("double"), F.col("s1") - F.col("s0")), F.lit(0.0))
    edge = F.floor(F.least(F.greatest(F.col("v0") + (F.col("v1") - F.col("v0")) * t, F.lit(0.0)), F.lit(100.0))).cast("int")
    at = every.select("s", edge.alias("edge")).groupBy("s").agg((F.min if lower else F.max)("edge").alias("edge"))
    low, high = (F.col("edge"), F.lit(100)) if lower else (F.lit(0), F.col("edge"))
    hues = at.withColumn("hue", F.explode(F.sequence(F.lit(hue_min), F.lit(hue_max))))
    return hues.select("hue", "s", low.alias("v_lo"), high.alias("v_hi"))


def _value_bits(cells: DataFrame, hues: int) -> DataFrame:
    """Rows (hue, s, low, high) of cells (hue, s, v_lo, v_hi): one for each hue and saturation, its values as
    bits of two numbers. Whatever the size of the table, at most `hues` x 101 rows are left."""
    each = cells.where(F.col("hue").between(0, hues - 1) & F.col("s").between(0, 100))
    bounded = each.select("hue", "s", F.greatest("v_lo", F.lit(0)).alias("lo"), F.least("v_hi", F.lit(100)).alias("hi")).where("lo <= hi")
    values = bounded.distinct().select("hue", "s", F.explode(F.sequence("lo", "hi")).alias("v"))
    bit = lambda low: F.bit_or(F.when((F.col("v") < 63) == F.lit(low), F.expr("shiftleft(1L, v % 63)")).otherwise(F.lit(0).cast("long")))
    return values.groupBy("hue", "s").agg(bit(True).alias("low"), bit(False).alias("high"))


def _in_cells(pixels: DataFrame, h: Column, s: Column, v: Column, cells: DataFrame, hues: int) -> DataFrame:
    """Pixels whose value is among those of their hue's and saturation's cell."""
    key = pixels.withColumns({"__h": h, "__s": s, "__v": v})
    bits = F.broadcast(_value_bits(cells, hues).select(F.col("hue").alias("__h"), F.col("s").alias("__s"), "low", "high"))
    both = key.where(F.col("__v").between(0, 100)).join(bits, ["__h", "__s"])
    hit = F.expr("(shiftrightunsigned(if(__v < 63, low, high), __v % 63) & 1) = 1")
    return both.where(hit).select(*[F.col(f"`{c}`") for c in pixels.columns])


def in_hue_region(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """Pixels (with h, s, v) inside a region of a table (hue, s, v_lo, v_hi), which is folded to 361 x 101
    cells at most before it is broadcast. Hue is floored, saturation and value truncated."""
    return _in_cells(pixels, F.floor("h").cast("int"), F.col("s").cast("int"), F.col("v").cast("int"), regions, 361)


def expand_regions(regions: DataFrame, dx: int, dy: int) -> DataFrame:
    """Regions grown by dx saturations to each side and dy values up and down."""
    wide = regions.withColumn("s", F.explode(F.sequence(F.col("s") - dx, F.col("s") + dx))).where("s between 0 and 100")
    low, high = F.greatest(F.min("v_lo") - dy, F.lit(0)), F.least(F.max("v_hi") + dy, F.lit(100))
    return wide.groupBy("hue", "s").agg(low.alias("v_lo"), high.alias("v_hi"))


def learn_ink_bands(pixels: DataFrame, is_white: Column) -> DataFrame:
    """(hue, sat, v_min, v_max, n) of the pixels that are not white: one row per cell of 360 x 101."""
    cell = pixels.where(~is_white).select(
        (F.floor("h").cast("int") % 360).alias("hue"), F.floor("s").cast("int").alias("sat"), F.floor("v").cast("int").alias("v")
    )
    return cell.groupBy("hue", "sat").agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.count("*").alias("n"))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The rows, or an error when there are none."""
    n = df.agg(F.count("*").alias("__n"))
    check = n.select(F.assert_true(F.col("__n") > 0, message).alias("__ok"))
    return df.join(F.broadcast(check), F.col("__ok").isNull()).drop("__ok")


def match_ink_bands(pixels: DataFrame, bands: DataFrame, padding: int = 1) -> DataFrame:
    """Pixels whose value lies in the band of their cell, with padding."""
    cells = bands.select("hue", F.col("sat").alias("s"), (F.col("v_min") - padding).alias("v_lo"), (F.col("v_max") + padding).alias("v_hi"))
    return _in_cells(pixels, F.floor("h").cast("int") % 360, F.floor("s").cast("int"), F.floor("v").cast("int"), cells, 360)


def color_window(h: Column, s: Column, v: Column, target: tuple, slack: float = 1.0) -> Column:
    """Within `slack` of a target colour in hue, saturation and value."""
    return (F.abs(h - target[0]) <= slack) & (F.abs(s - target[1]) <= slack) & (F.abs(v - target[2]) <= slack)
