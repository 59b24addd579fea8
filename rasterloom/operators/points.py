"""Points, runs and column spans.

Points are (shape_id, x, y); runs are (shape_id, x, y_lo, y_hi), the maximal stretches of a column;
spans are one (y_lo, y_hi) per column. Windows are per column of a shape, never per shape alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.sets import POINT, subtract_points

COLUMN = ["shape_id", "x"]


def to_runs(points: DataFrame) -> DataFrame:
    """Gaps and islands: y minus its rank is constant inside a run."""
    w = Window.partitionBy(*COLUMN).orderBy("y")
    island = points.select(POINT).distinct().withColumn("island", F.col("y") - F.row_number().over(w))
    return island.groupBy(*COLUMN, "island").agg(F.min("y").alias("y_lo"), F.max("y").alias("y_hi")).drop("island")


def from_runs(runs: DataFrame) -> DataFrame:
    return runs.select("shape_id", "x", F.explode(F.sequence("y_lo", "y_hi")).alias("y"))


def run_ends(runs: DataFrame) -> DataFrame:
    """Rows where a run begins or ends."""
    return runs.select("shape_id", "x", F.explode(F.array_distinct(F.array("y_lo", "y_hi"))).alias("y"))


def in_runs(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Points that some run of their column covers."""
    r = runs.select("shape_id", "x", "y_lo", "y_hi")
    return points.join(r, COLUMN).where(F.col("y").between(F.col("y_lo"), F.col("y_hi"))).select(points["*"])


def run_index(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Position of each covered point in its column's list of values."""
    w = Window.partitionBy(*COLUMN).orderBy("y_lo").rowsBetween(Window.unboundedPreceding, -1)
    based = runs.withColumn("base", F.coalesce(F.sum(F.col("y_hi") - F.col("y_lo") + 1).over(w), F.lit(0)))
    hit = points.join(based, COLUMN).where(F.col("y").between(F.col("y_lo"), F.col("y_hi")))
    return hit.select(*POINT, (F.col("base") + F.col("y") - F.col("y_lo")).alias("index"))


def merge_runs(runs: DataFrame, gap: int = 0) -> DataFrame:
    """Union of overlapping or touching intervals of each column (gaps up to `gap` close)."""
    w = Window.partitionBy(*COLUMN).orderBy("y_lo", "y_hi")
    top = F.max("y_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = runs.withColumn("new", F.when(F.col("y_lo") > top + 1 + gap, 1).otherwise(0))
    part = cut.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*COLUMN, "part").agg(F.min("y_lo").alias("y_lo"), F.max("y_hi").alias("y_hi")).drop("part")


def intersect_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    r = b.select("shape_id", "x", F.col("y_lo").alias("lo"), F.col("y_hi").alias("hi"))
    both = a.join(r, COLUMN).where("y_lo <= hi AND lo <= y_hi")
    return both.select("shape_id", "x", F.greatest("y_lo", "lo").alias("y_lo"), F.least("y_hi", "hi").alias("y_hi"))


def spans(points: DataFrame) -> DataFrame:
    return points.groupBy(*COLUMN).agg(F.min("y").alias("y_lo"), F.max("y").alias("y_hi"))


def in_span(points: DataFrame, spans_: DataFrame) -> DataFrame:
    return in_runs(points, spans_)


def extremes(points: DataFrame) -> DataFrame:
    """Extreme members; ties to the smaller other coordinate."""
    s = F.struct("x", "y")
    return points.groupBy("shape_id").agg(
        F.min(s).alias("left"), F.min_by(s, F.struct(-F.col("x"), F.col("y"))).alias("right"),
        F.min_by(s, F.struct("y", "x")).alias("low"), F.min_by(s, F.struct(-F.col("y"), F.col("x"))).alias("high"),
    )


def joint_bbox(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])


def centroid(points: DataFrame) -> DataFrame:
    """Mean point and the nearest member to it (ties to smaller x, then y)."""
    mean = points.groupBy("shape_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2))
    near = F.min(F.struct(F.round(d, 9).alias("d"), "x", "y"))
    out = points.join(mean, "shape_id").groupBy("shape_id", "cx", "cy").agg(near.alias("n"))
    return out.select("shape_id", "cx", "cy", F.col("n.x").alias("near_x"), F.col("n.y").alias("near_y"))


def translate(points: DataFrame, dx: int, dy: int) -> DataFrame:
    return points.select("shape_id", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))


def flip(points: DataFrame) -> DataFrame:
    return points.select("shape_id", F.col("y").alias("x"), F.col("x").alias("y"))


def rotate(points: DataFrame, degrees: float, about: tuple[float, float] = (0, 0)) -> DataFrame:
    """Rounded rotation; points that meet fall together."""
    a = F.radians(F.lit(float(degrees)))
    x, y = F.col("x") - about[0], F.col("y") - about[1]
    # Rounded first so that exact quarter turns stay exact in floating point.
    whole = lambda c, o: F.floor(F.round(c + o, 9) + 0.5).cast("int")
    return points.select("shape_id", whole(F.cos(a) * x - F.sin(a) * y, about[0]).alias("x"), whole(F.sin(a) * x + F.cos(a) * y, about[1]).alias("y")).distinct()


def hole(points: DataFrame) -> DataFrame:
    """Cells between the runs of a column."""
    w = Window.partitionBy(*COLUMN).orderBy("y_lo")
    gaps = to_runs(points).withColumn("next", F.lead("y_lo").over(w)).where("next IS NOT NULL")
    return gaps.select("shape_id", "x", F.explode(F.sequence(F.col("y_hi") + 1, F.col("next") - 1)).alias("y"))


def between(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Cells of the outer column spans that the inner column spans do not cover."""
    return subtract_points(from_runs(spans(outer)), from_runs(spans(inner)))


def _disk(r: int) -> list[tuple[int, int]]:
    """(dx, reach): how far a disk extends up and down at each column offset."""
    return [(dx, int((r * r - dx * dx) ** 0.5)) for dx in range(-r, r + 1)]


def dilate(points: DataFrame, r: int) -> DataFrame:
    """Disk dilation on runs: each run widens by the disk's reach at every column offset, 2 r + 1 rows a
    run whatever its length, then runs merge."""
    return from_runs(dilate_runs(to_runs(points), r))


def dilate_runs(runs: DataFrame, r: int) -> DataFrame:
    return stamp_runs(runs, [(dx, -reach, reach) for dx, reach in _disk(r)])


def stamp_runs(runs: DataFrame, stamp: list[tuple[int, int, int]]) -> DataFrame:
    """Runs of what a stamp (dx, lowest dy, highest dy) covers that is set on every cell."""
    table = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(low).alias("low"), F.lit(high).alias("high")) for dx, low, high in stamp])
    grown = runs.withColumn("d", F.explode(table)).select(
        "shape_id", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y_lo") + F.col("d.low")).alias("y_lo"), (F.col("y_hi") + F.col("d.high")).alias("y_hi")
    )
    return merge_runs(grown)


def erode(points: DataFrame, r: int) -> DataFrame:
    """Disk erosion on runs: a cell stays when, at every column offset, one run covers the disk's reach
    there: each run shrinks by the reach, and stretches found at all 2 r + 1 offsets stay."""
    return from_runs(erode_runs(to_runs(points), r))


def erode_runs(runs: DataFrame, r: int) -> DataFrame:
    """The same of maximal runs, whose ends alone are counted: a stretch is in as many shrunk runs as began before
    it and have not ended. Shrunk runs of one offset never touch, so that what is left is maximal too."""
    return _eroded(runs, _disk(r))


def _eroded(runs: DataFrame, shape: list[tuple[int, int]]) -> DataFrame:
    """The same by a symmetric shape (dx, reach)."""
    table = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(reach).alias("reach")) for dx, reach in shape])
    fit = runs.withColumn("d", F.explode(table)).where("y_hi - y_lo >= 2 * d.reach")
    ends = fit.select("shape_id", (F.col("x") - F.col("d.dx")).alias("x"), _ends((F.col("y_lo") + F.col("d.reach"), F.col("y_hi") - F.col("d.reach"), 1)).alias("e"))
    return depths(ends.select(*COLUMN, "e.*")).where(F.col("n") == len(shape)).drop("n")


def _ends(*stretches: tuple[Column, Column, int]) -> Column:
    """Rows (y, step) of the ends of stretches (first, last, weight) of a column."""
    end = lambda y, step: F.struct(y.alias("y"), F.lit(step).alias("step"))
    return F.explode(F.array(*[e for lo, hi, n in stretches for e in (end(lo, n), end(hi + 1, -n))]))


def depths(ends: DataFrame, *keys: str) -> DataFrame:
    """Stretches (shape_id, x, keys, y_lo, y_hi, n) between neighbouring ends (shape_id, x, y, step, and keys that are one for
    a shape) of a column, with the sum of the steps up to them; no cell is listed."""
    w = Window.partitionBy(*COLUMN).orderBy("y")
    steps = ends.repartition(*COLUMN).groupBy(*COLUMN, *keys, "y").agg(F.sum("step").alias("step"))
    return steps.select(*COLUMN, *keys, F.col("y").alias("y_lo"), (F.lead("y").over(w) - 1).alias("y_hi"), F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))


def _spread(runs: DataFrame, radii: DataFrame) -> DataFrame:
    """Column runs with their shape's radius r (0 if it has none), once for every column offset dx of a disk of
    that radius, with the disk's `half` height there."""
    runs = runs.join(radii.select("shape_id", "r"), "shape_id", "left").withColumn("r", F.coalesce("r", F.lit(0)))
    offsets = runs.withColumn("dx", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    half = F.floor(F.sqrt((F.col("r") * F.col("r") - F.col("dx") * F.col("dx")).cast("double"))).cast("int")
    return offsets.withColumn("half", half)


def dilate_by(points: DataFrame, radii: DataFrame) -> DataFrame:
    """Disk dilation with a radius per shape (shape_id, r); shapes without one stay as they are."""
    spread = _spread(to_runs(points.select(POINT)), radii)
    grown = spread.select("shape_id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y_lo") - F.col("half")).alias("y_lo"), (F.col("y_hi") + F.col("half")).alias("y_hi"))
    return from_runs(merge_runs(grown))


def erode_by(points: DataFrame, radii: DataFrame) -> DataFrame:
    """Disk erosion with a radius per shape (shape_id, r): a cell stays when no cell outside the set is
    within r; shapes without a radius, or with 0, stay as they are."""
    return from_runs(erode_runs_by(to_runs(points.select(POINT)), radii))


def erode_runs_by(runs: DataFrame, radii: DataFrame) -> DataFrame:
    """The same of maximal runs, as in `erode_runs`."""
    fit = _spread(runs, radii).where("y_hi - y_lo >= 2 * half")
    ends = fit.select("shape_id", "r", (F.col("x") - F.col("dx")).alias("x"), _ends((F.col("y_lo") + F.col("half"), F.col("y_hi") - F.col("half"), 1)).alias("e"))
    return depths(ends.select(*COLUMN, "r", "e.*"), "r").where("n = 2 * r + 1").drop("r", "n")


def boundary_runs(runs: DataFrame) -> DataFrame:
    """Stretches of the cells with a neighbour (of four) outside, of maximal runs: what is in a run but not, at once,
    above its first cell, below its last one and in runs of both columns beside it."""
    lo, hi, own = F.col("y_lo"), F.col("y_hi"), 4
    beside = [(dx, _ends((lo, hi, 1))) for dx in (-1, 1)]
    inner = _ends((lo, hi, own), (lo + 1, F.greatest(lo, hi - 1), 1))
    ends = None
    for dx, e in [(0, inner), *beside]:
        part = runs.select("shape_id", (F.col("x") + dx).alias("x"), e.alias("e")).select(*COLUMN, "e.*")
        ends = part if ends is None else ends.unionAll(part)
    return depths(ends).where(F.col("n").between(own, own + 2)).drop("n")


def close(points: DataFrame, r: int) -> DataFrame:
    return from_runs(close_runs(to_runs(points), r))


def close_runs(runs: DataFrame, r: int) -> DataFrame:
    return erode_runs(dilate_runs(runs, r), r)


def open_(points: DataFrame, r: int) -> DataFrame:
    return from_runs(open_runs(to_runs(points), r))


def open_runs(runs: DataFrame, r: int) -> DataFrame:
    return dilate_runs(erode_runs(runs, r), r)


def _near(points: DataFrame, to: DataFrame, d: int | Column, key: str = "shape_id") -> DataFrame:
    """Pairs of points of one shape in the same or neighbouring grid cells of side d, a number or a column of
    both sides that is one for a shape: the right side is copied to nine cells, so the join is an equi-join
    on cells of bounded content, and a merge join, as the copies are nine times what is known of their size."""
    cell = lambda c: F.floor(F.col(c) / d).cast("int")
    a = points.withColumns({"cx": cell("x"), "cy": cell("y")})
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = to.select(key, F.col("x").alias("tx"), F.col("y").alias("ty"), cell("x").alias("qx"), cell("y").alias("qy"), F.explode(shifts).alias("s"))
    b = b.select(key, "tx", "ty", (F.col("qx") + F.col("s.i")).alias("cx"), (F.col("qy") + F.col("s.j")).alias("cy"))
    return a.join(b.hint("merge"), [key, "cx", "cy"]).drop("cx", "cy")


def chamfer(dx: Column, dy: Column) -> Column:
    """Length of an offset in steps of 3 and diagonals of 4."""
    a, b = F.abs(dx), F.abs(dy)
    return F.lit(4) * F.least(a, b) + F.lit(3) * (F.greatest(a, b) - F.least(a, b))


def edge_of(points: DataFrame) -> DataFrame:
    """Points with a neighbour (of four) outside the set: what is nearest to a place outside it."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    lent = points.select(POINT).distinct().withColumn("s", F.explode(steps)).select("shape_id", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"))
    inner = lent.groupBy(*POINT).count().where("count = 4").select(POINT)
    return points.select(POINT).distinct().join(inner.hint("merge"), POINT, "left_anti")


def _closest(cells: DataFrame, to: DataFrame, cost: Column, sure, pick: Column, start: int = 8) -> DataFrame:
    """(shape_id, x, y, m): the least `pick` of the points `to` for every cell, exact at any distance; shapes
    without a point are left out. A cell first looks around it in a grid of side `start`; `sure` tells from
    the cost and the side whether nothing beyond can be nearer. Cells without a sure answer, and only
    they, look again in a grid twice as coarse, so near cells, most of them, stay cheap. Points inside the
    set are kept for the cells that are members, the edge for the others."""
    from rasterloom.sources.tables import materialise

    # Both sides are made once; their joins are merge joins, as materialised tables ask for it.
    known = materialise(to.select(POINT).distinct())
    asked = cells.select(POINT).distinct().join(known.select("shape_id").distinct(), "shape_id", "left_semi")
    asked = materialise(asked.join(known.withColumn("member", F.lit(True)), POINT, "left"))
    members = asked.where("member").select(*POINT, F.col("x").alias("tx"), F.col("y").alias("ty"))
    found = members.select(*POINT, pick.alias("m"))
    rest, edge, side = asked.where("member is null").select(POINT), materialise(edge_of(known)), start
    while not rest.isEmpty():
        near = _near(rest, edge, side).groupBy(*POINT).agg(F.min(pick).alias("m"), F.min(cost).alias("cost"))
        answered = materialise(near.where(sure(F.col("cost"), side)).select(*POINT, "m"))
        found = found.unionAll(answered)
        rest = materialise(rest.join(answered, POINT, "left_anti"))
        side *= 2
    return found


def chamfer_distance(cells: DataFrame, mask: DataFrame, limit: int | None = None) -> DataFrame:
    """Distance of every cell to the nearest mask point, steps costing 3 and diagonals 4; null where the
    shape has no mask point, or none within `limit` steps if that is given."""
    d = chamfer(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    if limit is None:
        found = _closest(cells, mask, d, lambda c, side: c <= 3 * side, d).select(*POINT, F.col("m").alias("distance"))
        return cells.select(POINT).join(found, POINT, "left")
    pairs = _near(cells.select(POINT), mask.select(POINT), limit)
    found = pairs.groupBy(*POINT).agg(F.min(d).alias("distance"))
    return cells.select(POINT).join(found.where(F.col("distance") <= 3 * limit), POINT, "left")


def chamfer_close(mask: DataFrame, r: int) -> DataFrame:
    """Closing by chamfer distance: cells near the mask that are not near the background. On runs: the cells within r
    of one are a stretch of each column, as those of a disk are."""
    ball = []
    for dx in range(-r, r + 1):
        # |dx| <= |dy|: 3 |dy| + |dx|; else 3 |dx| + |dy|, where the limit is that of the longer side.
        straight, slanted = (3 * r - abs(dx)) // 3, min(abs(dx), 3 * (r - abs(dx)))
        ball.append((dx, straight if straight >= abs(dx) else slanted))
    wide = stamp_runs(to_runs(mask), [(dx, -reach, reach) for dx, reach in ball])
    return from_runs(_eroded(wide, ball))


def _squared() -> Column:
    return F.pow((F.col("x") - F.col("tx")).cast("double"), F.lit(2.0)) + F.pow((F.col("y") - F.col("ty")).cast("double"), F.lit(2.0))


def _nearest_points(cells: DataFrame, to: DataFrame) -> DataFrame:
    """(shape_id, x, y, m) with m = (squared distance, x, y) of the nearest point."""
    pick = F.struct(_squared().alias("d"), "tx", "ty")
    return _closest(cells, to, _squared(), lambda c, side: c <= side * side, pick)


def min_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Least Euclidean distance between two point sets of one shape id; null where b has no such shape."""
    from rasterloom.sources.tables import materialise

    a = materialise(a.select(POINT).distinct())
    found = _nearest_points(a, b).groupBy("shape_id").agg(F.sqrt(F.min("m.d")).alias("distance"))
    return a.select("shape_id").distinct().join(found, "shape_id", "left")


def min_distance_1d(a: DataFrame, b: DataFrame, col: str = "value") -> DataFrame:
    """Least distance between two lists of numbers per key, by one sorted pass over their union."""
    both = a.select("key", F.col(col).alias("v"), F.lit(0).alias("side")).unionAll(b.select("key", F.col(col).alias("v"), F.lit(1).alias("side")))
    w = Window.partitionBy("key").orderBy("v", "side").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda s: F.last(F.when(F.col("side") == s, F.col("v")), True).over(w)
    near = both.select("key", F.when(F.col("side") == 0, F.col("v") - last(1)).otherwise(F.col("v") - last(0)).alias("d"))
    return near.groupBy("key").agg(F.min("d").alias("distance"))


def nearest(points: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query (shape_id, qx, qy), the nearest point at any distance (ties to smaller x, then y);
    queries of shapes without points give no row."""
    best = _nearest_points(queries.select("shape_id", F.col("qx").alias("x"), F.col("qy").alias("y")), points)
    return best.select("shape_id", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("m.tx").alias("x"), F.col("m.ty").alias("y"), F.sqrt("m.d").alias("distance"))


def nearest_on_line(points: DataFrame, queries: DataFrame, along: str) -> DataFrame:
    """For each query, the nearest point in its own column (`along` y) or row (`along` x), ties to the
    smaller place; no row where that line is empty. One sorted pass per line."""
    other = "x" if along == "y" else "y"
    pos = lambda d, x, y, side: d.select("shape_id", F.col(x).alias("x"), F.col(y).alias("y"), F.lit(side).alias("side"))
    both = pos(points, "x", "y", 0).unionAll(pos(queries, "qx", "qy", 1)).distinct()
    w = Window.partitionBy("shape_id", other).orderBy(along, "side")
    at = F.when(F.col("side") == 0, F.col(along))
    low = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumns({"low": low, "high": high}).where("side = 1 and (low is not null or high is not null)")
    found = F.when(F.col("high").isNull() | (F.col(along) - F.col("low") <= F.col("high") - F.col(along)), F.col("low")).otherwise(F.col("high"))
    named = {along: found, other: F.col(other)}
    return near.select("shape_id", F.col("x").alias("qx"), F.col("y").alias("qy"), named["x"].alias("x"), named["y"].alias("y"), F.abs(found - F.col(along)).alias("distance"))


def within_distance(points: DataFrame, queries: DataFrame, d: int) -> DataFrame:
    """Queries with some point within d: one look at the neighbouring cells of a grid of side d."""
    q = queries.select("shape_id", F.col("qx").alias("x"), F.col("qy").alias("y")).distinct()
    hit = _near(q, points.select(POINT), max(1, d)).where(_squared() <= d * d)
    return hit.select("shape_id", F.col("x").alias("qx"), F.col("y").alias("qy")).distinct()


def probe(points: DataFrame, starts: DataFrame, dx: int, dy: int) -> DataFrame:
    """Last member of the unbroken line from each start (shape_id, x, y) in one of eight directions."""
    if (dx, dy) == (0, 0) or abs(dx) > 1 or abs(dy) > 1:
        raise ValueError("a direction is one of the eight unit steps")
    # `line` tells parallel lines apart, `at` counts along them; members of a run share at - rank.
    line = F.col("x") * dy - F.col("y") * dx
    at = F.col("x") * dx if dx else F.col("y") * dy
    w = Window.partitionBy("shape_id", "line").orderBy("at")
    run = points.select(*POINT, line.alias("line"), at.alias("at")).withColumn("run", F.col("at") - F.row_number().over(w))
    end = run.groupBy("shape_id", "line", "run").agg(F.max(F.struct("at", "x", "y")).alias("e"))
    hit = starts.select(POINT).join(run, POINT).join(end, ["shape_id", "line", "run"])
    return hit.select(*POINT, F.col("e.x").alias("end_x"), F.col("e.y").alias("end_y"))


#: The four lines through a cell, each as the direction that counts as ahead.
AXES = ((1, 0), (0, 1), (1, 1), (1, -1))


def extents(points: DataFrame) -> DataFrame:
    """(shape_id, x, y, axis, ahead, behind): how many members follow one another from each member on, both
    ways along each of the four lines."""
    rows = points.select(POINT).distinct().withColumn("axis", F.explode(F.sequence(F.lit(0), F.lit(len(AXES) - 1))))
    pick = lambda values: F.get(F.array(*[v for v in values]), F.col("axis"))
    rows = rows.withColumns({"line": pick([F.col("x") * dy - F.col("y") * dx for dx, dy in AXES]), "at": pick([F.col("x") if dx else F.col("y") for dx, _ in AXES])})
    w = Window.partitionBy("shape_id", "axis", "line").orderBy("at")
    rows = rows.withColumn("run", F.col("at") - F.row_number().over(w))
    run = Window.partitionBy("shape_id", "axis", "line", "run")
    return rows.select(*POINT, "axis", (F.max("at").over(run) - F.col("at")).alias("ahead"), (F.col("at") - F.min("at").over(run)).alias("behind"))


def sizes(points: DataFrame) -> DataFrame:
    return points.groupBy("shape_id").agg(F.count("*").alias("n"), F.countDistinct("x").alias("n_x"), F.countDistinct("y").alias("n_y"))


def column_neighbours(points: DataFrame) -> DataFrame:
    """Occupied columns with the next lower and higher occupied one."""
    w = Window.partitionBy("shape_id").orderBy("x")
    return points.select(*COLUMN).distinct().select("shape_id", "x", F.lag("x").over(w).alias("lower"), F.lead("x").over(w).alias("higher"))


def shape_summary(points: DataFrame) -> DataFrame:
    """Size, bounds, share of the bounding box, and the inner pair around the middle row: the nearest
    members left and right of the centre column."""
    g = points.groupBy("shape_id").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{m}") for c in "xy" for m, f in (("min", F.min), ("max", F.max))])
    area = (F.col("x_max") - F.col("x_min") + 1) * (F.col("y_max") - F.col("y_min") + 1)
    g = g.withColumn("fill", F.col("n") / area).withColumns({"mid_x": F.expr("(x_min + x_max) div 2"), "mid_y": F.expr("(y_min + y_max) div 2")})
    row = points.join(g.select("shape_id", "mid_x", "mid_y"), "shape_id").where("y = mid_y").groupBy("shape_id").agg(
        F.max(F.when(F.col("x") <= F.col("mid_x"), F.col("x"))).alias("inner_left"), F.min(F.when(F.col("x") > F.col("mid_x"), F.col("x"))).alias("inner_right")
    )
    return g.drop("mid_x", "mid_y").join(row, "shape_id", "left")


#: Rows of a column farther apart than this belong to different groups; a group this near to the last
#: interpolated value keeps its nearest row, a column with a row this near is not interpolated, and a strand
#: of fewer steps is left alone (fixed values).
ROW_GAP, NEAR_GROUP, LEFT_ALONE, LEAST_STEPS = 3, 3, 5, 4


def border_strands(rows: DataFrame) -> DataFrame:
    """Adds `strand`, 0 or 1, to a border's rows (shape_id, x, y). Columns with several rows tell where the
    lower and the upper strand run; between such columns both run straight, beyond them level. A row belongs
    to the nearer one, the lower where they are as near; a border without such a column is one strand."""
    column = rows.groupBy("shape_id", "x").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    split = F.col("low") < F.col("high")
    w = Window.partitionBy("shape_id").orderBy("x")
    hit = F.when(split, F.struct("x", "low", "high"))
    column = column.withColumns({"before": F.last(hit, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first(hit, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    share = F.coalesce(F.try_divide(F.col("x") - F.col("before.x"), F.col("after.x") - F.col("before.x")), F.lit(0.0))
    runs = lambda c: F.coalesce(F.col(f"before.{c}") + share * (F.col(f"after.{c}") - F.col(f"before.{c}")), f"before.{c}", f"after.{c}")
    column = column.select("shape_id", "x", runs("low").alias("low"), runs("high").alias("high"))
    upper = F.abs(F.col("y") - F.col("high")) < F.abs(F.col("y") - F.col("low"))
    return rows.join(column, ["shape_id", "x"]).select("shape_id", "x", "y", F.when(upper, 1).otherwise(0).alias("strand"))


def interpolate_border(points: DataFrame, precision: float = 1.0) -> DataFrame:
    """(shape_id, x, y) in doubles: the border's points and, at every `precision` between the ends of a
    strand, interpolated ones where the column misses or has no row within 5 of the last value that a missing
    column of the strand was given. Where a whole column has a group of rows (gaps up to 3) within 3 of that
    value, only the group's nearest row stays. Strands under four steps are left alone."""
    from rasterloom.operators.stats import lagrange
    from rasterloom.sources.tables import materialise

    at = lambda c: F.round(F.round(c / F.lit(float(precision))) * F.lit(float(precision)), 9)
    cast = points.select("shape_id", at(F.col("x").cast("double")).alias("x"), F.col("y").cast("double").alias("y")).distinct()
    rows = materialise(border_strands(cast))
    # A strand has one row a column to be interpolated through.
    nodes = rows.groupBy("shape_id", "strand", "x").agg(F.min("y").alias("y"))
    key = F.struct("shape_id", "strand").alias("key")
    ends = nodes.groupBy("shape_id", "strand").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    steps = F.ceil((F.col("high") - F.col("low")) / F.lit(float(precision)) - F.lit(1e-9))
    wanted = ends.withColumn("steps", steps).where((F.col("high") - F.col("low")) / F.lit(float(precision)) >= LEAST_STEPS - 1e-9)
    each = wanted.select("shape_id", "strand", "low", F.explode(F.sequence(F.lit(0), F.col("steps").cast("int") - 1)).alias("i"))
    columns = each.select("shape_id", "strand", at(F.col("low") + F.col("i") * F.lit(float(precision))).alias("x"))
    present = rows.groupBy("shape_id", "x").agg(F.array_sort(F.collect_list("y")).alias("ys"))
    columns = columns.join(present, ["shape_id", "x"], "left")
    values = lagrange(nodes.select(key, "x", "y"), columns.select(key, "x")).select("key.shape_id", "key.strand", "x", F.col("y").alias("value"))
    columns = columns.join(values, ["shape_id", "strand", "x"])
    # The value carried on from the last missing column.
    w = Window.partitionBy("shape_id", "strand").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    columns = materialise(columns.withColumn("last", F.last(F.when(F.col("ys").isNull(), F.col("value")), True).over(w)))
    far = F.col("last").isNotNull() & (F.array_min(F.transform("ys", lambda y: F.abs(y - F.col("last")))) > LEFT_ALONE)
    added = columns.where(F.col("ys").isNull() | far).select("shape_id", "x", F.col("value").alias("y"))

    column = Window.partitionBy("shape_id", "strand", "x").orderBy("y")
    seen = columns.where("ys is not null and last is not null and x = floor(x)").select("shape_id", "strand", "x", "last", F.explode("ys").alias("y"))
    seen = seen.withColumn("cut", (F.coalesce(F.col("y") - F.lag("y").over(column), F.lit(0.0)) > ROW_GAP).cast("int"))
    seen = seen.withColumns({"grp": F.sum("cut").over(column), "off": F.abs(F.col("y") - F.col("last"))})
    one = Window.partitionBy("shape_id", "strand", "x")
    seen = seen.withColumn("near", F.min(F.when(F.col("off") <= NEAR_GROUP, F.col("grp"))).over(one)).where("grp = near")
    best = F.row_number().over(one.orderBy("off", "y"))
    crowd = seen.withColumn("place", best).where("place > 1").select("shape_id", "x", "y").distinct()
    return cast.join(crowd, ["shape_id", "x", "y"], "left_anti").unionAll(added)


def fill_border(points: DataFrame) -> DataFrame:
    """The border interpolated at whole columns, in whole numbers towards zero."""
    whole = lambda c: F.round(c, 6).cast("int").alias(c)
    return interpolate_border(points).select("shape_id", whole("x"), whole("y")).distinct()


def rescale_points(points: DataFrame, ratio: float) -> DataFrame:
    """Points of a display `ratio` times smaller than the image, at image size: gaps that the scaling opens
    are interpolated first."""
    whole = lambda c: F.round(F.col(c) * ratio, 4).cast("int").alias(c)
    return interpolate_border(points, 1 / ratio).select("shape_id", whole("x"), whole("y")).distinct()


def path_intersection(path: DataFrame, slope: float, forward: bool = True) -> DataFrame:
    """Where a line of the given slope from the path's end meets the path last; the far end if nowhere.
    The path has one y per x."""
    pick = F.min if forward else F.max
    end = path.groupBy("shape_id").agg(pick(F.struct("x", "y")).alias("o"), (F.max if forward else F.min)(F.struct("x", "y")).alias("far"))
    on = F.col("y") == (F.lit(slope) * (F.col("x") - F.col("o.x")) + F.col("o.y")).cast("int")
    hit = path.join(end, "shape_id").groupBy("shape_id").agg((F.max if forward else F.min)(F.when(on, F.struct("x", "y"))).alias("h"), F.first("far").alias("far"))
    at = F.coalesce("h", "far")
    return hit.select("shape_id", at["x"].alias("x"), at["y"].alias("y"))


def to_base(points: DataFrame, source: DataFrame, base: DataFrame) -> DataFrame:
    """Shift points so that the first column and row of `source` fall on those of `base`."""
    low = lambda d, n: d.groupBy("shape_id").agg(F.min("x").alias(f"{n}x"), F.min("y").alias(f"{n}y"))
    both = points.join(low(source, "s"), "shape_id").join(low(base, "b"), "shape_id")
    return both.select("shape_id", (F.col("x") + F.col("bx") - F.col("sx")).alias("x"), (F.col("y") + F.col("by") - F.col("sy")).alias("y"))


def apply_transform(points: DataFrame, dx: float, dy: float, scale: float) -> DataFrame:
    """(v + offset) * scale, rounded half up."""
    f = lambda c, o: F.floor((F.col(c) + o) * scale + 0.5).cast("int")
    return points.select("shape_id", f("x", dx).alias("x"), f("y", dy).alias("y"))


def unapply_transform(points: DataFrame, dx: float, dy: float, scale: float) -> DataFrame:
    f = lambda c, o: F.floor(F.col(c) / scale - o + 0.5).cast("int")
    return points.select("shape_id", f("x", dx).alias("x"), f("y", dy).alias("y"))


def clamp_to(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """Points moved into the bounding box of another set of the shape."""
    b = bounds.groupBy("shape_id").agg(*[f(c).alias(f"{c}_{m}") for c in "xy" for m, f in (("min", F.min), ("max", F.max))])
    f = lambda c: F.greatest(F.least(F.col(c), F.col(f"{c}_max")), F.col(f"{c}_min")).alias(c)
    return points.join(b, "shape_id").select("shape_id", f("x"), f("y"))


#: Cells of a column that one number holds; two bits more are for those above and below them.
WORD = 60


def to_words(points: DataFrame) -> DataFrame:
    """(shape_id, x, b, w): columns cut into stretches of WORD rows, bit i of `w` telling of the cell at b * WORD + i."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(y, {WORD}) as int))")
    return points.groupBy(*COLUMN, F.floor(F.col("y") / WORD).alias("b")).agg(F.bit_or(bit).alias("w"))


def from_words(words: DataFrame) -> DataFrame:
    set_ = F.expr(f"filter(sequence(0, {WORD - 1}), i -> (shiftright(w, i) & 1) = 1)")
    return words.select(*COLUMN, "b", F.explode(set_).alias("i")).select(*COLUMN, (F.col("b") * WORD + F.col("i")).cast("int").alias("y"))


def _least_two(bits: list[Column]) -> tuple[Column, Column]:
    """Where one at least, and where two at least, of the words have a bit."""
    one, two = bits[0], F.lit(0).cast("long")
    for v in bits[1:]:
        two, one = two.bitwiseOR(one.bitwiseAND(v)), one.bitwiseOR(v)
    return one, two


def _half_pass(words: DataFrame, first: bool) -> DataFrame:
    """A half-pass of thinning over (shape_id, x, b, w, before); words that become 0 stay."""
    own, low, high = F.shiftleft("w", 1), F.shiftright("w", WORD - 1), F.shiftleft(F.col("w").bitwiseAND(F.lit(1)), WORD + 1)
    sent = lambda dx, db, v, before: F.struct(F.lit(dx).alias("dx"), F.lit(db).alias("db"), v.alias("v"), before.alias("before"))
    none = F.lit(None).cast("long")
    # The word itself goes to its column and both beside it; its ends go to the words above and below there.
    out = F.array(sent(0, 0, own, F.col("before")), *[sent(dx, 0, own, none) for dx in (-1, 1)], *[sent(dx, db, v, none) for dx in (-1, 0, 1) for db, v in ((1, low), (-1, high))])
    each = words.withColumn("s", F.explode(F.filter(out, lambda s: (s["v"] != 0) | s["before"].isNotNull())))
    to = each.select("shape_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("b") + F.col("s.db")).alias("b"), "s.dx", "s.v", "s.before")
    # What a column gets from the one before it was sent ahead.
    got = lambda dx: F.coalesce(F.sum(F.when(F.col("dx") == dx, F.col("v"))), F.lit(0).cast("long"))
    g = to.groupBy(*COLUMN, "b").agg(got(1).alias("l"), got(0).alias("c"), got(-1).alias("r"), F.max("before").alias("before")).where("before is not null")
    mask = F.lit((1 << WORD) - 1)
    part = lambda c, k: F.shiftright(c, k).bitwiseAND(mask)
    # p2 .. p9, clockwise from the cell above.
    ring = [("c", 0), ("r", 0), ("r", 1), ("r", 2), ("c", 2), ("l", 2), ("l", 1), ("l", 0)]
    g = g.select(*COLUMN, "b", "before", part("c", 1).alias("w"), *[part(*at).alias(f"p{i}") for i, at in enumerate(ring, 2)])
    p = {i: F.col(f"p{i}") for i in range(2, 10)}
    off = {i: F.bitwise_not(v) for i, v in p.items()}
    two_on, two_off = _least_two(list(p.values()))[1], _least_two(list(off.values()))[1]
    turn, turns = _least_two([off[i].bitwiseAND(p[i + 1 if i < 9 else 2]) for i in range(2, 10)])
    a, b = ((2, 4, 6), (4, 6, 8)) if first else ((2, 4, 8), (2, 6, 8))
    full = lambda t: p[t[0]].bitwiseAND(p[t[1]]).bitwiseAND(p[t[2]])
    gone = F.col("w").bitwiseAND(two_on).bitwiseAND(two_off).bitwiseAND(turn).bitwiseAND(F.bitwise_not(turns))
    gone = gone.bitwiseAND(F.bitwise_not(full(a))).bitwiseAND(F.bitwise_not(full(b)))
    return g.select(*COLUMN, "b", F.col("w").bitwiseAND(F.bitwise_not(gone)).alias("w"), "before")


def thin(points: DataFrame, rounds: int = 128) -> DataFrame:
    """Zhang-Suen skeleton: half-passes until a whole round removes nothing.

    A half-pass works on words of 60 cells: three rows and the ends of each word are dealt out, not eight rows a
    cell, and the rule is one of bits. Shapes in which a round removes nothing are done; a round writes the words
    of the shapes that are left."""
    from rasterloom.sources.tables import materialise

    live = materialise(to_words(points))
    done = live.limit(0)
    for _ in range(rounds):
        out = materialise(_half_pass(_half_pass(live.withColumn("before", F.col("w")), True), False))
        active = materialise(out.where("w <> before").select("shape_id").distinct())
        left = out.where("w <> 0").select(*COLUMN, "b", "w")
        done = done.unionAll(left.join(active, "shape_id", "left_anti"))
        if active.isEmpty():
            break
        live = left.join(active, "shape_id", "left_semi")
    else:
        done = done.unionAll(live)
    return from_words(done)
