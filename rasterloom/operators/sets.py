"""Set algebra over point sets (shape_id, x, y) and canvas selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT = ["shape_id", "x", "y"]
MODES = ("add", "subtract", "intersect", "replace")


def canvas(shapes: DataFrame, width: int, height: int) -> DataFrame:
    """All cells of a width x height canvas for every shape id of `shapes`."""
    xs, ys = F.sequence(F.lit(0), F.lit(width - 1)), F.sequence(F.lit(0), F.lit(height - 1))
    return shapes.select("shape_id").distinct().select("shape_id", F.explode(xs).alias("x")).select("*", F.explode(ys).alias("y"))


def on_canvas(points: DataFrame, width: int, height: int) -> DataFrame:
    return points.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def union_points(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(POINT).unionAll(b.select(POINT)).distinct()


def subtract_points(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(POINT).join(b.select(POINT).hint("merge"), POINT, "left_anti")


def intersect_points(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(POINT).join(b.select(POINT).hint("merge"), POINT, "left_semi")


def apply_mode(a: DataFrame, b: DataFrame, mode: str) -> DataFrame:
    """Combine a selection with another by name of the mode."""
    if mode not in MODES:
        raise ValueError(f"unknown selection mode {mode}")
    if mode == "replace":
        return b.select(POINT)
    return {"add": union_points, "subtract": subtract_points, "intersect": intersect_points}[mode](a, b)


def invert_selection(points: DataFrame, width: int, height: int) -> DataFrame:
    """Canvas cells that are not selected."""
    return subtract_points(canvas(points, width, height), points)


def bbox(points: DataFrame) -> DataFrame:
    """Bounds with inclusive (width, height) and exclusive (extent_w, extent_h) sizes."""
    g = points.groupBy("shape_id").agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    span = lambda c: F.col(f"{c}_max") - F.col(f"{c}_min")
    return g.withColumns({"width": span("x") + 1, "height": span("y") + 1, "extent_w": span("x"), "extent_h": span("y")})


def bbox_cells(points: DataFrame, pad: int = 0) -> DataFrame:
    b = bbox(points)
    row = b.select("shape_id", F.explode(F.sequence(F.col("x_min") - pad, F.col("x_max") + pad)).alias("x"), "y_min", "y_max")
    return row.select("shape_id", "x", F.explode(F.sequence(F.col("y_min") - pad, F.col("y_max") + pad)).alias("y"))


def inverse(points: DataFrame, pad: int = 0) -> DataFrame:
    """Complement inside the bounding box, grown by `pad`."""
    return subtract_points(bbox_cells(points, pad), points)


def rectangle(shapes: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    cells = canvas(shapes, width, height)
    return cells.select("shape_id", (F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return subtract_points(a, b).unionAll(subtract_points(b, a))


def contains(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per shape: does a hold all of b, and are they equal? Counts come from one full join."""
    l = a.select(POINT).distinct().withColumn("ina", F.lit(1))
    r = b.select(POINT).distinct().withColumn("inb", F.lit(1))
    g = l.join(r, POINT, "full").groupBy("shape_id").agg(
        F.count(F.when(F.col("ina").isNull(), 1)).alias("only_b"), F.count(F.when(F.col("inb").isNull(), 1)).alias("only_a"), F.count("inb").alias("n_b")
    )
    return g.select("shape_id", (F.col("only_b") == 0).alias("contains_all"), ((F.col("only_b") == 0) & (F.col("only_a") == 0)).alias("equal"))


def included(a: DataFrame, b: DataFrame, tolerance: float = 1.0, keys: tuple[str, ...] = ("shape_id", "x", "y")) -> DataFrame:
    """Share of a's points that b holds, and whether at least ceil(n * tolerance) are."""
    l, r = a.select(*keys).distinct(), b.select(*keys).distinct().withColumn("hit", F.lit(1))
    g = l.join(r, list(keys), "left").groupBy("shape_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return g.select("shape_id", (F.col("hits") / F.col("n")).alias("share"), (F.col("hits") >= F.ceil(F.col("n") * tolerance)).alias("includes"))
