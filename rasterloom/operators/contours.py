"""Closed contours (shape_id, ord, x, y): tracing, measures, look-ups, filling and edits."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import numeric as N
from rasterloom.operators.points import COLUMN, boundary_runs, dilate, dilate_runs, erode_runs, erode_runs_by, from_runs, merge_runs, to_runs
from rasterloom.operators.sets import POINT

#: The eight directions in turning order, and the fewest cells of a traced component (fixed values).
DIRECTIONS = ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))
LEAST_CELLS = 4


def _order():
    return Window.partitionBy("shape_id").orderBy("ord")


def _shape():
    return Window.partitionBy("shape_id")


def boundary(points: DataFrame) -> DataFrame:
    """Members with a missing 4-neighbour, found on column runs."""
    return from_runs(boundary_runs(to_runs(points)))


def _loop(cells: set, start: tuple[int, int]) -> list[tuple[int, int]]:
    """Walk along boundary cells, each time turning two steps back and taking the first cell found."""
    at, heading, seen, path = start, 0, set(), []
    while (*at, heading) not in seen:  # eight states a cell at most
        seen.add((*at, heading))
        path.append(at)
        for turn in range(8):
            d = (heading + 6 + turn) % 8
            to = (at[0] + DIRECTIONS[d][0], at[1] + DIRECTIONS[d][1])
            if to in cells:
                at, heading = to, d
                break
        else:
            break
    clean: list[tuple[int, int]] = []
    for p in path:  # repeats and there-and-back spikes go
        if len(clean) > 1 and clean[-2] == p:
            clean.pop()
        elif not clean or clean[-1] != p:
            clean.append(p)
    return clean[:-1] if len(clean) > 1 and clean[0] == clean[-1] else clean


def _twice_area(loop: list[tuple[int, int]]) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(loop, loop[1:] + loop[:1]))


def trace(points: DataFrame) -> DataFrame:
    """The boundary loop with the largest area of each shape, counter-clockwise by the shoelace sign,
    from its largest y (then smallest x). Sequential inside a shape: one pandas group per shape, over
    boundary cells only."""
    return trace_runs(to_runs(points))


def trace_runs(runs: DataFrame) -> DataFrame:
    """The same of maximal column runs (shape_id, x, y_lo, y_hi), whose cells inside are never listed."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        cells, loops = set(zip(part["x"].tolist(), part["y"].tolist())), []
        left = set(cells)
        while left:
            component, todo = set(), [left.pop()]
            while todo:
                x, y = todo.pop()
                component.add((x, y))
                near = {(x + dx, y + dy) for dx, dy in DIRECTIONS} & left
                left -= near
                todo += near
            if len(component) >= LEAST_CELLS:
                loops.append(_loop(component, min(component, key=lambda p: (-p[1], p[0]))))
        if not loops:
            return pd.DataFrame({"shape_id": [], "ord": [], "x": [], "y": []}, dtype="int64")
        best = max(loops, key=lambda p: (abs(_twice_area(p)), len(p), p))
        if _twice_area(best) < 0:
            best = best[::-1]
        first = best.index(min(best, key=lambda p: (-p[1], p[0])))
        best = best[first:] + best[:first]
        return pd.DataFrame({"shape_id": part["shape_id"].iat[0], "ord": range(len(best)), "x": [p[0] for p in best], "y": [p[1] for p in best]})

    return from_runs(boundary_runs(runs)).groupBy("shape_id").applyInPandas(run, "shape_id long, ord int, x int, y int")


def edges(contour: DataFrame) -> DataFrame:
    """Adds the next vertex (nx, ny), the first after the last."""
    nxt = lambda c: F.coalesce(F.lead(c).over(_order()), F.first(c).over(_order()))
    return contour.select("shape_id", "ord", "x", "y", nxt("x").alias("nx"), nxt("y").alias("ny"))


def edge_at(contour: DataFrame, index: int) -> DataFrame:
    """Edge by index modulo the number of vertices."""
    n = F.count("*").over(_shape())
    return edges(contour).withColumn("n", n).where(F.col("ord") == F.pmod(F.lit(index), F.col("n"))).drop("n")


def with_previous(contour: DataFrame) -> DataFrame:
    """Adds previous (px, py) and next (nx, ny) vertices, around the end."""
    last = Window.partitionBy("shape_id").orderBy(F.desc("ord"))
    prev = lambda c: F.coalesce(F.lag(c).over(_order()), F.first(c).over(last))
    e = edges(contour)
    return e.withColumns({"px": prev("x"), "py": prev("y")})


def measures(contour: DataFrame) -> DataFrame:
    """Perimeter, signed area and orientation."""
    e = edges(contour)
    length = F.sqrt((F.pow(F.col("nx") - F.col("x"), F.lit(2)) + F.pow(F.col("ny") - F.col("y"), F.lit(2))).cast("double"))
    area = F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2
    g = e.groupBy("shape_id").agg(F.sum(length).alias("perimeter"), area.alias("area"))
    return g.withColumn("orientation", F.when(F.col("area") > 0, "counter-clockwise").when(F.col("area") < 0, "clockwise").otherwise("flat"))


def attributes(contour: DataFrame) -> DataFrame:
    """Adds centroid, raw angle, angle from the first vertex, radius and arc length up to the vertex."""
    cx, cy = F.avg("x").over(_shape()), F.avg("y").over(_shape())
    c = contour.withColumns({"cx": cx, "cy": cy})
    c = c.withColumn("raw", N.normalize_angle(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))))
    c = c.withColumn("angle", N.normalize_angle(F.col("raw") - F.first("raw").over(_order())))
    radius = F.sqrt(F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2)))
    back = F.sqrt((F.pow(F.col("x") - F.lag("x").over(_order()), F.lit(2)) + F.pow(F.col("y") - F.lag("y").over(_order()), F.lit(2))).cast("double"))
    c = c.withColumn("radius", radius).withColumn("step", F.coalesce(back, F.lit(0.0)))
    return c.withColumn("arc", F.sum("step").over(_order().rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def at_angle(contour: DataFrame, queries: DataFrame) -> DataFrame:
    """Nearest vertex to each query angle (shape_id, angle), its index, radius and place on the ray."""
    a = attributes(contour).select("shape_id", "ord", "x", "y", "radius", "cx", "cy", F.col("raw").alias("has"))
    d = F.round(N.angle_delta(F.col("has"), N.normalize_angle(F.col("angle"))), 9)
    best = queries.join(a, "shape_id").groupBy("shape_id", "angle").agg(F.min(F.struct(d.alias("d"), "ord", "x", "y", "radius", "cx", "cy")).alias("b"))
    return best.select(
        "shape_id", "angle", "b.ord", "b.x", "b.y", "b.radius",
        (F.col("b.cx") + F.cos("angle") * F.col("b.radius")).alias("ray_x"), (F.col("b.cy") + F.sin("angle") * F.col("b.radius")).alias("ray_y"),
    )


def at_arc(contour: DataFrame, queries: DataFrame) -> DataFrame:
    """Vertex at or before, and interpolated point at, a share (shape_id, share) of the perimeter."""
    a = attributes(contour).select("shape_id", "ord", "arc")
    e = edges(contour).join(a, ["shape_id", "ord"]).withColumn("len", F.sqrt((F.pow(F.col("nx") - F.col("x"), F.lit(2)) + F.pow(F.col("ny") - F.col("y"), F.lit(2))).cast("double")))
    total = e.groupBy("shape_id").agg(F.max(F.col("arc") + F.col("len")).alias("total"))
    want = queries.join(total, "shape_id").select("shape_id", (N.wrap(F.col("share")) * F.col("total")).alias("pos"), "share")
    # One sorted pass over vertices and places: a place takes the last vertex up to it.
    vertex = F.struct("ord", "x", "y", "nx", "ny", "arc", "len").alias("vertex")
    known = e.select("shape_id", F.col("arc").alias("pos"), F.lit(None).cast("double").alias("share"), vertex)
    asked = want.select("shape_id", "pos", F.col("share").cast("double"), F.lit(None).cast(known.schema["vertex"].dataType).alias("vertex"))
    w = Window.partitionBy("shape_id").orderBy("pos", F.asc_nulls_last("vertex")).rowsBetween(Window.unboundedPreceding, 0)
    hit = known.unionAll(asked).withColumn("v", F.last("vertex", True).over(w)).where("share is not null")
    t = F.coalesce(F.try_divide(F.col("pos") - F.col("v.arc"), F.col("v.len")), F.lit(0.0))
    return hit.select("shape_id", "share", "v.ord", (F.col("v.x") + (F.col("v.nx") - F.col("v.x")) * t).alias("x"), (F.col("v.y") + (F.col("v.ny") - F.col("v.y")) * t).alias("y"))


def nearest_vertex(contour: DataFrame, queries: DataFrame) -> DataFrame:
    """Nearest vertex to each (shape_id, qx, qy), ties to the smaller index."""
    d = F.pow(F.col("x") - F.col("qx"), F.lit(2)) + F.pow(F.col("y") - F.col("qy"), F.lit(2))
    best = queries.join(contour, "shape_id").groupBy("shape_id", "qx", "qy").agg(F.min(F.struct(d.alias("d"), "ord")).alias("b"))
    return best.select("shape_id", "qx", "qy", "b.ord", F.sqrt("b.d").alias("distance"))


def nearest_on_edges(contour: DataFrame, queries: DataFrame) -> DataFrame:
    """Least distance from each query to the outline, by projection on the edges."""
    e = queries.join(edges(contour), "shape_id")
    dx, dy = (F.col("nx") - F.col("x")).cast("double"), (F.col("ny") - F.col("y")).cast("double")
    t = F.coalesce(F.try_divide((F.col("qx") - F.col("x")) * dx + (F.col("qy") - F.col("y")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = N.clamp01(t)
    d = F.sqrt(F.pow(F.col("qx") - F.col("x") - dx * t, F.lit(2)) + F.pow(F.col("qy") - F.col("y") - dy * t, F.lit(2)))
    return e.groupBy("shape_id", "qx", "qy").agg(F.min(d).alias("distance"))


def in_contour(points: DataFrame, contour: DataFrame) -> DataFrame:
    """Points (shape_id, x, y) with `inside` by the even-odd rule; the edge counts as inside.

    One sorted pass over each row: a point lies inside after an odd number of edges, or on the last stretch of the
    outline that begins up to it."""
    e = edges(contour).select("shape_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("nx").alias("x1"), F.col("ny").alias("y1"))
    # Edges are dealt to the rows they span, so that points meet only edges of their row.
    e = e.withColumn("y", F.explode(F.sequence(F.least("y0", "y1"), F.greatest("y0", "y1"))))
    flat = F.col("y0") == F.col("y1")
    part = (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    at = F.when(flat, F.least("x0", "x1")).otherwise(F.col("x0") + F.try_divide(part.cast("double"), F.col("y1") - F.col("y0")))
    # The outline goes through a cell of the row only where it meets a whole place.
    to = F.when(flat, F.greatest("x0", "x1").cast("double")).when(F.coalesce(F.try_mod(part, F.col("y1") - F.col("y0")), F.lit(0)) == 0, at)
    crosses = ((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))).cast("int")
    marks = e.select("shape_id", "y", F.lit(None).cast(points.schema["x"].dataType).alias("x"), at.cast("double").alias("at"), to.alias("to"), crosses.alias("n"), F.lit(0).alias("side"))
    asked = points.select("shape_id", "y", "x", F.col("x").cast("double").alias("at"), F.lit(None).cast("double").alias("to"), F.lit(0).alias("n"), F.lit(1).alias("side"))
    w = Window.partitionBy("shape_id", "y").orderBy("at", "side")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.unionByName(asked).select("*", F.sum("n").over(so_far).alias("before"), F.max("to").over(so_far).alias("until"), F.lag("x").over(w).alias("last"))
    first = seen.where((F.col("side") == 1) & (F.col("last").isNull() | (F.col("last") != F.col("x"))))
    return first.select(*POINT, (F.coalesce(F.col("until") >= F.col("x"), F.lit(False)) | (F.col("before") % 2 == 1)).alias("inside"))


def contains_points(points: DataFrame, contour: DataFrame) -> DataFrame:
    return in_contour(points, contour).groupBy("shape_id").agg(F.bool_and("inside").alias("contained"))


def rasterize(contour: DataFrame) -> DataFrame:
    """Filled cells: crossings at the column centres are sorted and paired; vertices always belong."""
    return from_runs(rasterize_runs(contour))


def rasterize_runs(contour: DataFrame) -> DataFrame:
    """The same as maximal column runs."""
    e = edges(contour)
    left, right = F.least("x", "nx"), F.greatest("x", "nx")
    cols = e.where("x <> nx").withColumn("col", F.explode(F.sequence(left, right - 1)))
    at = F.col("y") + (F.col("ny") - F.col("y")) * ((F.col("col") + 0.5 - F.col("x")) / (F.col("nx") - F.col("x")))
    hits = cols.select("shape_id", F.col("col").alias("x"), at.alias("at"))
    w = Window.partitionBy(*COLUMN).orderBy("at")
    pairs = hits.withColumns({"k": F.row_number().over(w), "to": F.lead("at").over(w)}).where("k % 2 = 1 AND to IS NOT NULL")
    lo, hi = F.ceil(F.col("at") - 0.5).cast("int"), F.floor(F.col("to") - 0.5).cast("int")
    filled = pairs.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").select("shape_id", "x", F.col("lo").alias("y_lo"), F.col("hi").alias("y_hi"))
    return merge_runs(filled.unionAll(contour.select("shape_id", "x", F.col("y").alias("y_lo"), F.col("y").alias("y_hi"))))


def expand(contour: DataFrame, r: int) -> DataFrame:
    return trace_runs(dilate_runs(rasterize_runs(contour), r))


def contract(contour: DataFrame, r: int) -> DataFrame:
    return trace_runs(erode_runs(rasterize_runs(contour), r))


def contract_by(contour: DataFrame, radii: DataFrame) -> DataFrame:
    """Contours contracted by a radius per shape (shape_id, r)."""
    return trace_runs(erode_runs_by(rasterize_runs(contour), radii))


#: Rays of an outline: so many a unit of its perimeter, between these bounds (fixed values).
RAYS_PER_STEP, LEAST_RAYS, MOST_RAYS = 1.5, 720, 131_072


def ray_counts(contour: DataFrame) -> DataFrame:
    """(shape_id, bins): rays around each shape, by its perimeter."""
    n = F.ceil(F.col("perimeter") * RAYS_PER_STEP)
    return measures(contour).select("shape_id", F.least(F.lit(MOST_RAYS), F.greatest(F.lit(LEAST_RAYS), n)).cast("int").alias("bins"))


def outer_edge(contour: DataFrame, bins: int | DataFrame | None = None, inner: bool = False) -> DataFrame:
    """(shape_id, bin, radius): farthest (or nearest) hit of the ray from the centroid at the middle of
    each angular bin. An edge meets only the rays in its own span of angles. `bins` is a number for all, a
    table (shape_id, bins), or by the perimeter."""
    counts = bins if isinstance(bins, DataFrame) else ray_counts(contour) if bins is None else contour.select("shape_id").distinct().withColumn("bins", F.lit(bins))
    step = N.TAU / F.col("bins")
    a = attributes(contour).select("shape_id", "ord", "cx", "cy")
    e = edges(contour).join(a, ["shape_id", "ord"]).join(counts, "shape_id")
    rel = {"ax": F.col("x") - F.col("cx"), "ay": F.col("y") - F.col("cy"), "bx": F.col("nx") - F.col("cx"), "by": F.col("ny") - F.col("cy")}
    e = e.select("shape_id", "bins", *[v.alias(k) for k, v in rel.items()])
    t0 = F.atan2("ay", "ax")
    turn = F.atan2(F.col("ax") * F.col("by") - F.col("ay") * F.col("bx"), F.col("ax") * F.col("bx") + F.col("ay") * F.col("by"))
    lo, hi = F.least(t0, t0 + turn), F.greatest(t0, t0 + turn)
    ray = e.withColumns({"b0": F.ceil(lo / step - 0.5), "b1": F.floor(hi / step - 0.5)}).where("b0 <= b1").withColumn("b", F.explode(F.sequence("b0", "b1")))
    ang = (F.col("b") + 0.5) * step
    dx, dy = F.cos(ang), F.sin(ang)
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    r = F.try_divide(F.col("ax") * ey - F.col("ay") * ex, dx * ey - dy * ex)
    hit = ray.select("shape_id", F.pmod("b", "bins").cast("int").alias("bin"), r.alias("radius")).where("radius >= 0")
    return hit.groupBy("shape_id", "bin").agg((F.min if inner else F.max)("radius").alias("radius"))


def halfway(a: DataFrame, b: DataFrame, bins: int | None = None) -> DataFrame:
    """Midway between two outlines of a shape, ray by ray from the first one's centroid; as many rays as the
    first one's perimeter asks for, if no number is given."""
    counts = ray_counts(a) if bins is None else a.select("shape_id").distinct().withColumn("bins", F.lit(bins))
    centre = a.groupBy("shape_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).join(counts, "shape_id")
    r = outer_edge(a, counts).join(outer_edge(b, counts).withColumnRenamed("radius", "other"), ["shape_id", "bin"]).join(centre, "shape_id")
    mid, ang = (F.col("radius") + F.col("other")) / 2, (F.col("bin") + 0.5) * (N.TAU / F.col("bins"))
    whole = lambda v: F.floor(v + 0.5).cast("int")
    return r.select("shape_id", F.col("bin").alias("ord"), whole(F.col("cx") + F.cos(ang) * mid).alias("x"), whole(F.col("cy") + F.sin(ang) * mid).alias("y"))


def curvatures(contour: DataFrame) -> DataFrame:
    """Three-point curvature and the second difference of the place at every vertex."""
    p = with_previous(contour)
    pt = lambda x, y: N.point(F.col(x).cast("double"), F.col(y).cast("double"))
    k = F.nanvl(N.curvature(pt("px", "py"), pt("x", "y"), pt("nx", "ny")), F.lit(0.0))
    return p.select("shape_id", "ord", k.alias("curvature"), (F.col("nx") - 2 * F.col("x") + F.col("px")).alias("ddx"), (F.col("ny") - 2 * F.col("y") + F.col("py")).alias("ddy"))


def span_curvature(spans: DataFrame, side: str = "y_lo") -> DataFrame:
    """Second derivative of one side of column spans over unevenly spaced columns."""
    w = Window.partitionBy("shape_id").orderBy("x")
    s = spans.select("shape_id", "x", F.col(side).alias("y"), *[f(c).over(w).alias(f"{n}{i}") for i, f in ((0, F.lag), (1, F.lead)) for n, c in (("x", "x"), ("y", side))])
    h0, h1 = F.col("x") - F.col("x0"), F.col("x1") - F.col("x")
    second = 2.0 * ((F.col("y1") - F.col("y")) / h1 - (F.col("y") - F.col("y0")) / h0) / (h0 + h1)
    return s.where("x0 IS NOT NULL AND x1 IS NOT NULL").select("shape_id", "x", second.alias("second"))


def resample(contour: DataFrame, n: int) -> DataFrame:
    """n points at equal arc distances from the first vertex: (shape_id, ord, x, y) as doubles."""
    at = contour.select("shape_id").distinct().select("shape_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    out = at_arc(contour, at.select("shape_id", (F.col("i") / n).alias("share")))
    return out.select("shape_id", F.floor(F.col("share") * n + 0.5).cast("int").alias("ord"), "x", "y")


def best_shift(a: DataFrame, b: DataFrame, n: int = 32) -> DataFrame:
    """Circular shift of b's resampled points with the least RMSE to a's, per shape; n x n rows a shape."""
    p = resample(a, n).select("shape_id", F.col("ord").alias("i"), "x", "y")
    q = resample(b, n).select("shape_id", F.col("ord").alias("j"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    d = F.pow(F.col("x") - F.col("qx"), F.lit(2)) + F.pow(F.col("y") - F.col("qy"), F.lit(2))
    s = p.join(q, "shape_id").groupBy("shape_id", F.pmod(F.col("j") - F.col("i"), F.lit(n)).alias("shift")).agg(F.round(F.sqrt(F.avg(d)), 9).alias("rmse"))
    return s.groupBy("shape_id").agg(F.min(F.struct("rmse", "shift")).alias("b")).select("shape_id", "b.shift", "b.rmse")


def renumber(contour: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy("shape_id").orderBy(*(order or (F.col("ord"),)))
    return contour.select("shape_id", (F.row_number().over(w) - 1).alias("ord"), "x", "y")


def sort_by_angle(contour: DataFrame) -> DataFrame:
    a = attributes(contour)
    return renumber(a, F.round("raw", 9), F.col("radius"), F.col("ord"))


def add_vertex(contour: DataFrame, at: int, x: int, y: int) -> DataFrame:
    new = contour.select("shape_id").distinct().select("shape_id", (F.lit(at) - 0.5).alias("ord"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    return renumber(contour.select("shape_id", F.col("ord").cast("double").alias("ord"), "x", "y").unionAll(new))


def remove_vertices(contour: DataFrame, points: DataFrame) -> DataFrame:
    return renumber(contour.join(points.select(POINT), POINT, "left_anti").select("shape_id", "ord", "x", "y"))


def translate(contour: DataFrame, dx: int, dy: int) -> DataFrame:
    return contour.select("shape_id", "ord", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))


def walk_side(points: DataFrame, upper: bool = True, ascending: bool = True) -> DataFrame:
    """Steps along the upper or lower edge of a point set by x: (shape_id, step, x, y)."""
    edge = points.groupBy(*COLUMN).agg((F.max if upper else F.min)("y").alias("y"))
    w = Window.partitionBy("shape_id").orderBy(F.col("x") if ascending else F.desc("x"))
    return edge.select("shape_id", (F.row_number().over(w) - 1).alias("step"), "x", "y")


def walk_rows(points: DataFrame) -> DataFrame:
    """Row-by-row path over all members, rows from low y, turning at every other row, as segments."""
    odd = (F.dense_rank().over(Window.partitionBy("shape_id").orderBy("y")) % 2 == 0).alias("odd")
    rows = points.select(*POINT, odd)
    w = Window.partitionBy("shape_id").orderBy("y", F.when(F.col("odd"), -F.col("x")).otherwise(F.col("x")))
    out = rows.select("shape_id", (F.row_number().over(w) - 1).alias("step"), "x", "y", F.lead("x").over(w).alias("to_x"), F.lead("y").over(w).alias("to_y"))
    return out.where("to_x IS NOT NULL")


def draw_lines(lines: DataFrame) -> DataFrame:
    """Cells of segments (shape_id, x0, y0, x1, y1): one per step along the longer axis."""
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    at = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    f = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.coalesce(F.try_divide(F.col("i"), F.col("n")), F.lit(0.0)) + 0.5).cast("int")
    return at.select("shape_id", f("x0", "x1").alias("x"), f("y0", "y1").alias("y")).distinct()


_EDGE = ("d", "x", "y", "tx", "ty", "label", "other")


def spanning_edges(edges: DataFrame) -> DataFrame:
    """The edges (shape_id, label, other, d, x, y, tx, ty) of each shape's spanning trees with the least d, ties
    to the smaller ends: the ones that taking edges by rising d keeps, where they join separate parts.

    Every part takes its first edge, what is joined becomes a part, and so on; parts at least halve each
    round, and only edges between parts are kept."""
    from rasterloom.operators.groups import components
    from rasterloom.sources.tables import materialise

    edge = F.struct(*_EDGE)
    open_ = materialise(edges.select("shape_id", F.col("label").alias("a"), F.col("other").alias("b"), edge.alias("e")))
    kept = edges.select("shape_id", *_EDGE).limit(0)
    while not open_.isEmpty():
        ends = open_.select("shape_id", F.col("a").alias("part"), "a", "b", "e").unionAll(open_.select("shape_id", F.col("b").alias("part"), "a", "b", "e"))
        first = ends.groupBy("shape_id", "part").agg(F.min(F.struct("e", "a", "b")).alias("m"))
        chosen = materialise(first.select("shape_id", "m.e", "m.a", "m.b").distinct())
        kept = kept.unionAll(chosen.select("shape_id", "e.*"))
        part = materialise(components(chosen.select(F.col("shape_id").alias("key"), "a", "b")))
        side = lambda c: part.select(F.col("key").alias("shape_id"), F.col("node").alias(c), F.col("label").alias(f"{c}_part"))  # noqa: B023, E731
        # Every part with an edge has chosen one.
        joined = open_.join(side("a"), ["shape_id", "a"]).join(side("b"), ["shape_id", "b"])
        open_ = materialise(joined.where("a_part <> b_part").select("shape_id", F.col("a_part").alias("a"), F.col("b_part").alias("b"), "e"))
    return kept


def bridge(points: DataFrame, max_gap: int) -> DataFrame:
    """Joins components closer than max_gap with drawn segments, nearest first, only where they join two
    still separate parts. Pairs come from a grid join over boundary cells and are reduced to one per
    pair of components, of which a spanning tree is left."""
    from rasterloom.operators.groups import group_connected
    from rasterloom.operators.points import _near
    from rasterloom.sources.tables import materialise

    groups = materialise(group_connected(points, True))
    rim = boundary(points).join(groups, POINT)
    to = rim.select("shape_id", "x", "y")
    labels = rim.select("shape_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("label").alias("other"))
    d = F.pow(F.col("x") - F.col("tx"), F.lit(2)) + F.pow(F.col("y") - F.col("ty"), F.lit(2))
    near = _near(rim, to, max_gap).join(labels, ["shape_id", "tx", "ty"]).where((F.col("label") < F.col("other")) & (d <= max_gap * max_gap))
    best = near.groupBy("shape_id", "label", "other").agg(F.min(F.struct(d.alias("d"), "x", "y", "tx", "ty")).alias("b")).select("shape_id", "label", "other", "b.*")

    lines = spanning_edges(best).select("shape_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("tx").alias("x1"), F.col("ty").alias("y1"))
    return points.select(POINT).unionAll(draw_lines(lines)).distinct()


def outline_width(points: DataFrame, contour: DataFrame, rays: int = 64) -> DataFrame:
    """Least width of an outline band: outer minus inner radius over rays from the contour's centroid,
    where members within 1.25 px of the ray count."""
    c = contour.groupBy("shape_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    p = points.join(c, "shape_id").select("shape_id", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("r"))
    step = N.TAU / rays
    slack = F.coalesce(F.try_divide(F.lit(1.25), F.col("r")), F.lit(math.pi))
    t = F.atan2("dy", "dx")
    b = p.withColumns({"b0": F.ceil((t - slack) / step), "b1": F.floor((t + slack) / step)}).where("b0 <= b1").withColumn("ray", F.explode(F.sequence("b0", "b1")))
    g = b.groupBy("shape_id", F.pmod("ray", F.lit(rays)).alias("ray")).agg((F.max("r") - F.min("r")).alias("width"))
    return g.groupBy("shape_id").agg(F.min("width").alias("width"))


def smooth_path(contour: DataFrame, r: int) -> DataFrame:
    """Gaussian mean of the places around each vertex along the loop: (shape_id, ord, x, y) doubles."""
    n = contour.groupBy("shape_id").agg(F.count("*").alias("n"))
    taps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(math.exp(-2.0 * d * d / max(1, r * r))).alias("w")) for d in range(-r, r + 1)])
    at = contour.join(n, "shape_id").select("shape_id", "n", "x", "y", "ord", F.explode(taps).alias("k"))
    to = at.select("shape_id", F.pmod(F.col("ord") + F.col("k.d"), F.col("n")).cast("int").alias("ord"), "x", "y", F.col("k.w").alias("w"))
    mean = lambda c: (F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c)
    return to.groupBy("shape_id", "ord").agg(mean("x"), mean("y"))


def raster_band(path: DataFrame, thickness: int) -> DataFrame:
    """Cells within half a thickness of a path of doubles."""
    whole = path.select("shape_id", "ord", *[F.floor(F.col(c) + 0.5).cast("int").alias(c) for c in "xy"])
    e = edges(whole).select("shape_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("nx").alias("x1"), F.col("ny").alias("y1"))
    return dilate(draw_lines(e), max(0, thickness // 2))


def fill_missing_columns(points: DataFrame, contour: DataFrame, thickness: int) -> DataFrame:
    """Adds every cell of the inward band that an outline of this thickness should have."""
    inside = rasterize(contour)
    band = raster_band(contour, 2 * thickness).join(inside, POINT, "left_semi")
    return points.select(POINT).unionAll(band).distinct()


def thickness_of(points: DataFrame, contour: DataFrame) -> DataFrame:
    """(shape_id, thickness): a shape's cells over its contour's length, rounded half up, at least 1."""
    n = points.select(POINT).distinct().groupBy("shape_id").agg(F.count("*").alias("n"))
    share = F.floor(F.try_divide(F.col("n").cast("double"), F.col("perimeter")) + 0.5)
    return n.join(measures(contour), "shape_id").select("shape_id", F.greatest(F.lit(1), F.coalesce(share, F.lit(1))).cast("int").alias("thickness"))


def smooth_outline(points: DataFrame, contour: DataFrame) -> DataFrame:
    """Adds the inward band that an outline of each shape's own thickness should have, closes and opens by
    half of it, and fills holes of up to four times its square, 16 cells at least. Where opening, or closing,
    leaves nothing of a shape, the step before it stands."""
    from rasterloom.operators.groups import fill_small_holes
    from rasterloom.operators.points import dilate_by, erode_by
    from rasterloom.sources.tables import materialise

    t = materialise(thickness_of(points, contour))
    radii = t.select("shape_id", F.greatest(F.lit(1), F.expr("thickness div 2")).cast("int").alias("r"))
    line = draw_lines(edges(contour).select("shape_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("nx").alias("x1"), F.col("ny").alias("y1")))
    band = dilate_by(line, t.withColumnRenamed("thickness", "r")).join(rasterize(contour), POINT, "left_semi")
    band = band.join(t, "shape_id", "left_semi").select(POINT)
    stroke_ = materialise(points.select(POINT).unionAll(band).distinct())
    closed = materialise(erode_by(dilate_by(stroke_, radii), radii))
    opened = materialise(dilate_by(erode_by(closed, radii), radii))
    kept = opened.unionAll(closed.join(opened.select("shape_id").distinct(), "shape_id", "left_anti"))
    kept = kept.unionAll(stroke_.join(closed.select("shape_id").distinct(), "shape_id", "left_anti"))
    area = t.select("shape_id", F.greatest(F.lit(16), F.col("thickness") * F.col("thickness") * 4).alias("area"))
    return fill_small_holes(materialise(kept), area)


def stroke(contour: DataFrame, spacing: float) -> DataFrame:
    """Points at equal arc spacing along the closed loop."""
    total = measures(contour).select("shape_id", F.greatest(F.lit(1), F.floor(F.col("perimeter") / spacing)).alias("n"))
    at = total.select("shape_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i / F.col("n"))).alias("share"))
    p = at_arc(contour, at)
    return p.select("shape_id", F.floor(F.col("x") + 0.5).cast("int").alias("x"), F.floor(F.col("y") + 0.5).cast("int").alias("y"))
