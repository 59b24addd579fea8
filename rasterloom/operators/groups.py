"""Connected groups of points.

Points within `dist` of each other belong together. Links come from an equi-join of column runs with the
runs of the columns within reach, labels from repeated contraction of the link table: every round joins
each label to its smallest neighbour's choice, so the number of rounds grows with the logarithm of the
largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.numeric import encode_xy
from rasterloom.operators.points import from_runs, to_runs
from rasterloom.operators.sets import POINT
from rasterloom.sources.tables import materialise


def components(edges: DataFrame) -> DataFrame:
    """(key, node, label): smallest node of each component of edges (key, a, b), for nodes with an edge.

    Nodes point to the neighbour with the smallest hash, drawn anew each round, so that long monotone
    chains contract as fast as anything else."""
    live = materialise(edges.select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels, turn = None, 0
    while not live.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = live.unionAll(live.select("key", F.col("b").alias("a"), F.col("a").alias("b")))
        hop = both.groupBy("key", F.col("a").alias("node")).agg(F.min(order("b")).alias("m"))
        up = materialise(hop.select("key", "node", F.least(order("node"), "m")["n"].alias("up")))
        for _ in range(2):
            above = up.select("key", F.col("node").alias("up"), F.col("up").alias("upper"))
            up = up.join(above.hint("merge"), ["key", "up"]).select("key", "node", F.col("upper").alias("up"))
        up = materialise(up)
        end = lambda c: up.select("key", F.col("node").alias(c), F.col("up").alias(f"{c}2"))  # noqa: B023, E731
        live = live.join(end("a"), ["key", "a"]).join(end("b"), ["key", "b"])
        live = materialise(live.select("key", F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct())
        if labels is None:
            labels = up.select("key", "node", F.col("up").alias("root"))
        else:
            step = up.select("key", F.col("node").alias("root"), "up")
            labels = materialise(labels.join(step, ["key", "root"], "left").select("key", "node", F.coalesce("up", "root").alias("root")))
    if labels is None:
        return edges.select("key", F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    least = labels.groupBy("key", "root").agg(F.min("node").alias("label"))
    return labels.join(least, ["key", "root"]).select("key", "node", "label")


def group_points(points: DataFrame, dist: float | DataFrame) -> DataFrame:
    """Adds `label` = smallest (x, y) code of the point's group; `dist` is a number or one per shape
    (shape_id, dist), and shapes without one are left out. Groups are found on column runs."""
    if isinstance(dist, DataFrame):
        p = points.select(POINT).join(dist.select("shape_id", F.col("dist").cast("double").alias("dist")).hint("merge"), "shape_id")
    else:
        p = points.select(*POINT, F.lit(float(dist)).alias("dist"))
    # Nothing is within less than 1 of a cell, not even the next one of its column.
    alone = F.lit(dist < 1) if not isinstance(dist, DataFrame) else F.col("dist") < 1
    cells = p.select("shape_id", F.col("x").alias("col"), F.when(alone, F.col("x")).otherwise(F.col("x") + F.floor("dist")).alias("last"), F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y_lo"), F.col("y").alias("y_hi"), "dist")
    runs = group_runs(cells).select("shape_id", F.col("x0").alias("x"), "y_lo", "y_hi", F.col("label").alias("part"))
    # A run's smallest code is where y, taken as unsigned, is least.
    code = encode_xy(F.col("x"), F.when((F.col("y_lo") < 0) & (F.col("y_hi") >= 0), 0).otherwise(F.col("y_lo")))
    least = runs.groupBy("shape_id", "part").agg(F.min(code).alias("label"))
    return _labelled_cells(runs.join(least.hint("merge"), ["shape_id", "part"]))


def group_runs(blocks: DataFrame) -> DataFrame:
    """Blocks of cells (shape_id, col, last, x0, x1, y_lo, y_hi, dist) as column runs with the `label` of their group,
    the code of its first run.

    Blocks of a column `col` share x0 to x1, `last` is the last column within `dist` of it, a distance that is one
    for a shape. Blocks of a column that touch are one run, and runs of a column within the distance one node;
    a run is sent to the columns within reach and meets the runs that share a band of rows with it there."""
    column = Window.partitionBy("shape_id", "col").orderBy("y_lo")
    known = ["shape_id", "col", "last", "x0", "x1", "dist"]
    each = blocks.select(*known, "y_lo", "y_hi").repartition("shape_id", "col").distinct()
    before = F.coalesce(F.sum(F.col("y_hi") - F.col("y_lo") + 1).over(column.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Below a distance of 1 cells of a column do not touch either.
    island = F.when(F.col("dist") >= 1, F.col("y_lo") - before).otherwise(F.col("y_lo"))
    runs = each.withColumn("island", island).groupBy(*known, "island").agg(F.min("y_lo").alias("y_lo"), F.max("y_hi").alias("y_hi")).drop("island")
    runs = runs.withColumn("apart", F.coalesce(F.col("y_lo") - F.lag("y_hi").over(column) > F.col("dist"), F.lit(True)))
    first = F.last(F.when(F.col("apart"), F.col("y_lo")), True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    runs = materialise(runs.withColumn("node", encode_xy(F.col("x0"), first)).drop("apart"))

    reach = F.ceil("dist")
    side = F.greatest(F.lit(BAND), 4 * reach)
    band = lambda lo, hi: F.explode(F.sequence(F.floor(lo / side), F.floor(hi / side)))
    left = runs.where("last > col").withColumn("col", F.explode(F.sequence(F.col("col") + 1, F.col("last"))))
    left = left.select("shape_id", "col", "x1", "y_lo", "y_hi", "dist", F.col("node").alias("a"), band(F.col("y_lo") - reach, F.col("y_hi") + reach).alias("band"))
    right = runs.select("shape_id", F.col("col").cast(left.schema["col"].dataType).alias("col"), F.col("x0").alias("to"), F.col("y_lo").alias("lo"), F.col("y_hi").alias("hi"), F.col("node").alias("b"), band(F.col("y_lo"), F.col("y_hi")).alias("band"))
    across, down = (F.col("to") - F.col("x1")).cast("double"), F.greatest(F.lit(0), F.col("lo") - F.col("y_hi"), F.col("y_lo") - F.col("hi")).cast("double")
    pairs = left.join(right.hint("merge"), ["shape_id", "col", "band"]).where(across * across + down * down <= F.col("dist") * F.col("dist"))
    labels = components(pairs.select(F.col("shape_id").alias("key"), "a", "b"))
    named = labels.select(F.col("key").alias("shape_id"), "node", "label").hint("merge")
    return materialise(runs.join(named, ["shape_id", "node"], "left").withColumn("label", F.coalesce("label", "node")).drop("node"))


def group_by_grid(points: DataFrame, side: int = 3) -> DataFrame:
    """Groups of occupied grid squares that touch (eight neighbours): coarser and cheaper."""
    q = lambda c: F.floor(F.col(c) / side).cast("int")
    squares = points.select("shape_id", q("x").alias("x"), q("y").alias("y")).distinct()
    labels = group_points(squares, 1.5).select("shape_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "label")
    return points.select(*POINT, q("x").alias("sx"), q("y").alias("sy")).join(labels, ["shape_id", "sx", "sy"]).select(*POINT, "label")


def filter_to_groups(pixels: DataFrame, dist: float, pred: Column) -> DataFrame:
    """Groups of the pixels (frame_id, x, y, ...) that satisfy a predicate."""
    return group_points(pixels.where(pred).select(F.col("frame_id").alias("shape_id"), "x", "y"), dist)


def filter_to_groups_multi(pixels: DataFrame, dist: float, preds: list[Column]) -> DataFrame:
    """One grouping per predicate; each pixel goes to the first that it meets. `which` names it."""
    label = F.coalesce(*[F.when(p, i) for i, p in enumerate(preds)])
    hit = pixels.withColumn("which", label).where("which IS NOT NULL")
    n = len(preds)
    keyed = hit.select((F.col("frame_id") * n + F.col("which")).alias("shape_id"), "x", "y")
    out = group_points(keyed, dist)
    return out.select(F.expr(f"shape_id div {n}").alias("shape_id"), (F.col("shape_id") % n).cast("int").alias("which"), "x", "y", "label")


def derive_group(points: DataFrame, seeds: DataFrame, dist: float) -> DataFrame:
    """Everything reachable from seed points (shape_id, x, y)."""
    groups = materialise(group_points(points, dist))
    wanted = groups.join(seeds.select(POINT), POINT, "left_semi").select("shape_id", "label").distinct()
    return groups.join(wanted, ["shape_id", "label"], "left_semi").select(POINT)


def local_group(pixels: DataFrame, seeds: DataFrame, dist: float, pred: Column) -> DataFrame:
    """The group that holds each frame's seed; no rows when the seed fails the predicate."""
    return derive_group(pixels.where(pred).select(F.col("frame_id").alias("shape_id"), "x", "y"), seeds, dist)


def largest_group(groups: DataFrame) -> DataFrame:
    """Points of each shape's largest group, ties to the smaller label."""
    n = groups.groupBy("shape_id", "label").agg(F.count("*").alias("n"))
    best = n.groupBy("shape_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
    return groups.join(best, ["shape_id", "label"], "left_semi").select(POINT)


#: Rows of a band: a run meets those of the next column that share a band with it.
BAND = 64


def _connected_runs(runs: DataFrame, diagonals: bool) -> DataFrame:
    """Written runs (shape_id, x, y_lo, y_hi, ...) with the `label` of their group by 4- or 8-neighbours, the
    smallest (x, y) code in it."""
    runs = materialise(runs.withColumn("code", encode_xy(F.col("x"), F.col("y_lo"))))
    slack = 1 if diagonals else 0
    band = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BAND), F.floor(hi / BAND))).alias("band")
    left = runs.select("shape_id", "x", "y_lo", "y_hi", F.col("code").alias("a"), band(F.col("y_lo") - slack, F.col("y_hi") + slack))
    right = runs.select("shape_id", (F.col("x") - 1).alias("x"), F.col("y_lo").alias("lo"), F.col("y_hi").alias("hi"), F.col("code").alias("b"), band(F.col("y_lo"), F.col("y_hi")))
    touch = left.join(right.hint("merge"), ["shape_id", "x", "band"]).where((F.col("y_lo") <= F.col("hi") + slack) & (F.col("lo") <= F.col("y_hi") + slack))
    labels = components(touch.select(F.col("shape_id").alias("key"), "a", "b"))
    named = labels.select(F.col("key").alias("shape_id"), F.col("node").alias("code"), "label").hint("merge")
    return runs.join(named, ["shape_id", "code"], "left").withColumn("label", F.coalesce("label", "code")).drop("code")


def _labelled_cells(runs: DataFrame) -> DataFrame:
    return runs.select("shape_id", "x", F.explode(F.sequence("y_lo", "y_hi")).alias("y"), "label")


def group_connected(points: DataFrame, diagonals: bool) -> DataFrame:
    """Groups by 4- or 8-neighbours, found on column runs: far fewer nodes than points."""
    return _labelled_cells(_connected_runs(to_runs(points), diagonals))


def _void_runs(runs: DataFrame, diagonals: bool) -> DataFrame:
    """Labelled runs of the empty cells of a shape's bounding box, padded by one, that are not part of the
    outside; cells are never listed one by one."""
    bounds = runs.groupBy("shape_id").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y_lo").alias("low"), F.max("y_hi").alias("high"))
    columns = bounds.select("shape_id", F.explode(F.sequence(F.col("x_min") - 1, F.col("x_max") + 1)).alias("x"), "x_min", "low", "high")
    # Every column begins with a run that ends below the padded box, so that there is a gap after each of its runs.
    floor = columns.select("shape_id", "x", (F.col("low") - 2).alias("y_lo"), (F.col("low") - 2).alias("y_hi"), (F.col("high") + 1).alias("top"), encode_xy(F.col("x_min") - 1, F.col("low") - 1).alias("corner"))
    column = Window.partitionBy("shape_id", "x").orderBy("y_lo")
    kind = floor.schema["corner"].dataType
    both = floor.unionByName(runs.select("shape_id", "x", "y_lo", "y_hi", F.lit(None).cast("int").alias("top"), F.lit(None).cast(kind).alias("corner")))
    so_far = column.rowsBetween(Window.unboundedPreceding, 0)
    top = F.last("top", True).over(so_far)
    gaps = both.select("shape_id", "x", (F.col("y_hi") + 1).alias("y_lo"), F.coalesce(F.lead("y_lo").over(column) - 1, top).alias("y_hi"), F.last("corner", True).over(so_far).alias("corner"))
    # The corner of the padded box lies outside and is the smallest cell of its group.
    return _connected_runs(gaps.where("y_lo <= y_hi"), diagonals).where("label <> corner").drop("corner")


def enclosed(points: DataFrame) -> DataFrame:
    """Cells not reachable from outside through 4-neighbours, with the label of their void."""
    return _labelled_cells(_void_runs(materialise(to_runs(points)), diagonals=False))


def _filled(runs: DataFrame, void: DataFrame) -> DataFrame:
    return from_runs(runs.select("shape_id", "x", "y_lo", "y_hi").unionByName(void.select("shape_id", "x", "y_lo", "y_hi")))


def _areas(void: DataFrame) -> DataFrame:
    return void.groupBy("shape_id", "label").agg(F.sum(F.col("y_hi") - F.col("y_lo") + 1).alias("area"))


def fill_enclosed(points: DataFrame) -> DataFrame:
    runs = materialise(to_runs(points))
    return _filled(runs, _void_runs(runs, diagonals=False))


def remove_holes(points: DataFrame) -> DataFrame:
    """The band between outer and inner edge: the filled set without its largest void, the one of the smaller
    label if two are as large."""
    runs = materialise(to_runs(points))
    void = materialise(_void_runs(runs, diagonals=False))
    largest = _areas(void).groupBy("shape_id").agg(F.min_by("label", F.struct(-F.col("area"), F.col("label"))).alias("label"))
    return _filled(runs, void.join(largest.hint("merge"), ["shape_id", "label"], "left_anti"))


def fill_small_holes(points: DataFrame, max_area: int | DataFrame) -> DataFrame:
    """Adds closed 8-connected voids of at most max_area cells, a number or one per shape (shape_id, area)."""
    runs = materialise(to_runs(points))
    void = materialise(_void_runs(runs, diagonals=True))
    sized = _areas(void)
    if isinstance(max_area, DataFrame):
        small = sized.join(max_area.select("shape_id", F.col("area").alias("most")).hint("merge"), "shape_id").where("area <= most")
    else:
        small = sized.where(F.col("area") <= max_area)
    return _filled(runs, void.join(small.hint("merge"), ["shape_id", "label"], "left_semi"))


def magic_wand(pixels: DataFrame, seeds: DataFrame, tolerance: int, contiguous: bool = True, diagonals: bool = True) -> DataFrame:
    """Pixels (frame_id, x, y, r, g, b) whose channels are within the tolerance of their frame's seed
    (frame_id, x, y); only those connected to it if contiguous."""
    at = pixels.join(seeds, ["frame_id", "x", "y"]).select("frame_id", *[F.col(c).alias(f"s{c}") for c in "rgb"])
    near = F.lit(True)
    for c in "rgb":
        near = near & (F.abs(F.col(c) - F.col(f"s{c}")) <= tolerance)
    hit = pixels.join(at, "frame_id").where(near).select(F.col("frame_id").alias("shape_id"), "x", "y")
    if not contiguous:
        return hit
    groups = materialise(group_connected(hit, diagonals))
    wanted = groups.join(seeds.select(F.col("frame_id").alias("shape_id"), "x", "y"), POINT, "left_semi").select("shape_id", "label")
    return groups.join(wanted, ["shape_id", "label"], "left_semi").select(POINT)


def nearest_group(groups: DataFrame, target: DataFrame) -> DataFrame:
    """Label of the group with the least distance to a target set, per shape, ties to the smaller label."""
    from rasterloom.operators.points import _nearest_points

    groups = materialise(groups.select(*POINT, "label"))
    near = groups.join(_nearest_points(groups, target), POINT)
    return near.groupBy("shape_id").agg(F.min(F.struct(F.col("m.d").alias("d"), "label")).alias("b")).select("shape_id", F.col("b.label").alias("label"), F.sqrt("b.d").alias("distance"))


def group_anchors(groups: DataFrame) -> DataFrame:
    """Nearest member to the centroid of each shape's largest group."""
    from rasterloom.operators.points import centroid

    return centroid(largest_group(groups)).select("shape_id", F.col("near_x").alias("x"), F.col("near_y").alias("y"))


def mini_anchors(pixels: DataFrame, frames: DataFrame, dist: float, condition, preds: int = 1, accept_empty: bool = True) -> DataFrame:
    """(frame_id, which, x, y): for every one of several predicates, the anchor of the largest group that
    meets it on each frame's mini image, in image coordinates. `condition(pixels)` gives the pixels' rows
    and the list of predicates on their colours. A frame without a match is left out, or is an error.

    The mini image is not drawn: a pixel stands for the block of mini cells that show it, and blocks are grouped,
    counted and measured as their cells would be."""
    from rasterloom.operators.pixels import KEY, mini_blocks, mini_sizes, mini_to_image

    frames = materialise(frames.select("frame_id", "width", "height"))
    rows, tests = condition(pixels.select(*KEY, "argb"))
    if len(tests) != preds:
        raise ValueError("as many predicates are wanted as are announced")
    # A pixel may meet several predicates: each has a grouping of its own.
    each = rows.select(*KEY, F.explode(F.array(*[F.when(t, i) for i, t in enumerate(tests)])).alias("which")).where("which is not null")
    # Distances scale with the image, each frame by its own size.
    scale = F.greatest(F.col("width") / F.col("w"), F.col("height") / F.col("h"))
    sized = mini_blocks(each, mini_sizes(frames).withColumn("dist", F.greatest(F.lit(1.0), scale * dist)))
    # Columns are the image's or the mini image's, whichever are fewer.
    few = F.col("w") <= F.col("width")
    end = F.col("x1") + F.floor("dist")
    last = F.least(F.col("w") - 1, F.expr("((2 * (x1 + floor(dist)) + 1) * w) div (2 * width)"))
    blocks = sized.select(
        (F.col("frame_id") * preds + F.col("which")).alias("shape_id"), F.when(few, F.col("x")).otherwise(F.col("x0")).alias("col"),
        F.when(few, last).otherwise(end).alias("last"), "x0", "x1", F.col("y0").alias("y_lo"), F.col("y1").alias("y_hi"), "dist",
    )
    at = block_anchors(group_runs(blocks)).select(F.expr(f"shape_id div {preds}").alias("frame_id"), (F.col("shape_id") % preds).cast("int").alias("which"), "x", "y")
    found = mini_to_image(at, frames, "which").select("frame_id", "which", "x", "y")
    if accept_empty:
        return found
    wanted = frames.select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(preds - 1))).alias("which"))
    missing = F.raise_error(F.concat(F.lit("no pixel meets predicate "), F.col("which").cast("string"), F.lit(" in frame "), F.col("frame_id").cast("string")))
    both = wanted.join(found, ["frame_id", "which"], "left")
    return both.select("frame_id", "which", F.when(F.col("x").isNull(), missing.cast("int")).otherwise(F.col("x")).alias("x"), "y")


def block_anchors(runs: DataFrame) -> DataFrame:
    """(shape_id, x, y): the cell nearest to the centroid of each shape's largest group, ties to smaller x, then y, of
    labelled runs (shape_id, x0, x1, y_lo, y_hi, label) whose cells are not listed."""
    wide, high = F.col("x1") - F.col("x0") + 1, F.col("y_hi") - F.col("y_lo") + 1
    n = wide * high
    total = lambda lo, hi: F.sum(F.expr(f"({lo} + {hi}) * (x1 - x0 + 1) * (y_hi - y_lo + 1) div 2"))
    sums = runs.groupBy("shape_id", "label").agg(F.sum(n).alias("n"), total("x0", "x1").alias("sx"), total("y_lo", "y_hi").alias("sy"))
    best = sums.groupBy("shape_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "label", "n", "sx", "sy")).alias("b"))
    mean = lambda c: (F.col(f"b.{c}").cast("double") / F.col("b.n")).alias(f"c{c[1]}")
    best = best.select("shape_id", "b.label", mean("sx"), mean("sy"))
    near = lambda lo, hi, c: [F.greatest(F.col(lo), F.least(F.col(hi), (F.floor(c) + i).cast("int"))) for i in (0, 1)]
    d = lambda x, y: F.round(F.pow(x - F.col("cx"), F.lit(2)) + F.pow(y - F.col("cy"), F.lit(2)), 9)
    cells = [F.struct(d(x, y).alias("d"), x.alias("x"), y.alias("y")) for x in near("x0", "x1", "cx") for y in near("y_lo", "y_hi", "cy")]
    members = runs.join(best.hint("merge"), ["shape_id", "label"])
    return members.groupBy("shape_id").agg(F.min(F.least(*cells)).alias("m")).select("shape_id", "m.x", "m.y")


def mini_anchor_then_local(pixels: DataFrame, frames: DataFrame, dist: float, condition, pred: Column) -> DataFrame:
    """The full-size group around the anchor of the mini image's largest group."""
    at = mini_anchors(pixels, frames, dist, condition)
    return local_group(pixels, at.select(F.col("frame_id").alias("shape_id"), "x", "y"), dist, pred)
