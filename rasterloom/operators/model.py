"""Contour features, matching of two contours, and a small linear appearance model.

Features are rows (shape_id, ord, location, x, y, ...); location is the share of the perimeter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import numeric as N
from rasterloom.operators import contours as K
from rasterloom.operators.points import AXES, extents, nearest

INPUTS = ("location", "orientation", "derivative", "radius")
#: Measures with the bounds of their values and the strength of a predicted change (fixed values).
OUTPUTS = {"thickness": (0.5, 64.0, 1.10), "border_blend": (0.0, 1.0, 1.85), "opacity": (0.0, 1.0, 1.20), "blotch": (-64.0, 64.0, 0.18)}
#: Training constants (fixed values): rounds, rate, ridge, and the first guess's share of cov / var.
EPOCHS, RATE, RIDGE, FIRST_GUESS = 1400, 0.0125, 0.0004, 0.15
#: Reach of the match in samples and in arc share.
MATCH_SAMPLES, MATCH_ARC = 12, 0.025
#: Weights of the match score, what a match that does not return loses, and the least confidence (fixed values).
SCORE_WEIGHTS = {"place": 1.0, "orientation": 0.6, "derivative": 0.45, "radius": 0.3, "arc": 0.4}
MISMATCH, LEAST_CONFIDENCE = 0.35, 0.1


def local_frame(contour: DataFrame, size: int = 256) -> DataFrame:
    """Contours shifted so that their bounds are centred in a square box."""
    b = contour.groupBy("shape_id").agg(*[F.floor((F.min(c) + F.max(c)) / 2).cast("int").alias(f"m{c}") for c in "xy"])
    return contour.join(b, "shape_id").select("shape_id", "ord", (F.col("x") - F.col("mx") + size // 2).alias("x"), (F.col("y") - F.col("my") + size // 2).alias("y"))


def sample_vertices(contour: DataFrame, n: int | None = None, stride: int = 1) -> DataFrame:
    """(shape_id, sample, ord): every stride-th vertex, or n vertices (all, if there are fewer) at equal
    arcs. A sample whose vertex is taken moves on to the next free one, round the end of the loop if need be."""
    if n is None:
        return contour.where(F.col("ord") % stride == 0).select("shape_id", F.expr(f"ord div {stride}").cast("int").alias("sample"), "ord")
    size = contour.groupBy("shape_id").agg(F.count("*").cast("int").alias("size"))
    wanted = size.withColumn("n", F.least(F.lit(max(1, n)), F.col("size")))
    each = wanted.withColumn("sample", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("share", F.col("sample") / F.col("n"))
    at = K.at_arc(contour, each.select("shape_id", "share")).select("shape_id", "share", "ord").distinct()
    # Samples ask for vertices in rising order, so one pushed on takes the one after the last taken.
    w = Window.partitionBy("shape_id").orderBy("sample")
    each = each.join(at, ["shape_id", "share"]).withColumn("ord", F.max(F.col("ord") - F.col("sample")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("sample"))
    placed = each.where("ord < size").select("shape_id", "sample", "ord")
    free = contour.select("shape_id", "ord").join(placed, ["shape_id", "ord"], "left_anti")
    free = free.withColumn("turn", F.row_number().over(Window.partitionBy("shape_id").orderBy("ord")) - 1)
    round_ = each.where("ord >= size").select("shape_id", "sample", (F.col("ord") - F.col("size")).alias("turn"))
    moved = round_.join(free, ["shape_id", "turn"]).select("shape_id", "sample", "ord")
    return placed.unionByName(moved).select("shape_id", F.col("sample").cast("int").alias("sample"), F.col("ord").cast("int").alias("ord"))


def build_features(contour: DataFrame, n: int | None = None, stride: int = 1) -> DataFrame:
    """Location, tangent, inward normal, orientation, curvature and radius at every vertex, at every stride-th
    or at n of equal arcs; of these, `sample` tells the order."""
    from rasterloom.sources.tables import materialise

    # Read by every measure below.
    contour = materialise(contour)
    p = K.with_previous(contour)
    tx, ty = (F.col("nx") - F.col("px")).cast("double"), (F.col("ny") - F.col("py")).cast("double")
    unit = N.vec_normalize(N.point(tx, ty))
    base = p.select("shape_id", "ord", "x", "y", unit.alias("t"), F.pmod(F.atan2(ty, tx), F.lit(np.pi)).alias("orientation"))
    a = K.attributes(contour).select("shape_id", "ord", "arc", "radius")
    m = K.measures(contour).select("shape_id", "perimeter", F.when(F.col("area") < 0, -1.0).otherwise(1.0).alias("turn"))
    k = K.curvatures(contour).select("shape_id", "ord", F.col("curvature").alias("derivative"))
    full = base.join(a, ["shape_id", "ord"]).join(k, ["shape_id", "ord"]).join(m, "shape_id")
    full = full.select(
        "shape_id", "ord", (F.col("arc") / F.col("perimeter")).alias("location"), "x", "y", F.col("t.x").alias("tx"), F.col("t.y").alias("ty"),
        (-F.col("t.y") * F.col("turn")).alias("normal_x"), (F.col("t.x") * F.col("turn")).alias("normal_y"), "orientation", "derivative", "radius",
    )
    return full if n is None and stride == 1 else full.join(sample_vertices(contour, n, stride), ["shape_id", "ord"])


def loop_average(features: DataFrame, col: str, r: int) -> DataFrame:
    """Triangular moving average of a column over the loop, weights r + 1 - |d|."""
    n = features.groupBy("shape_id").agg(F.count("*").alias("n"))
    taps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(r + 1 - abs(d))).alias("w")) for d in range(-r, r + 1)])
    at = features.join(n, "shape_id").select("shape_id", "n", "ord", F.col(col).alias("v"), F.explode(taps).alias("k"))
    to = at.select("shape_id", F.pmod(F.col("ord") + F.col("k.d"), F.col("n")).cast("int").alias("ord"), "v", F.col("k.w").alias("w"))
    return to.groupBy("shape_id", "ord").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias(col))


#: Radii of averaged measures, of the opacity disk, of the border scan and of the local contour mean; the
#: share of two probes that is thickness; what an edge and an opacity must pass to blend; weights of the end
#: stop's parts and the thicknesses within which it is compact; the bound of blotches (fixed values).
MEASURE_RADIUS, OPACITY_RADIUS, BORDER_SCAN, BLOTCH_RADIUS = 4, 2, 15, 4
PROBE_SHARE, LEAST_EDGE, LEAST_OPACITY, MOST_BLOTCH = 0.82, 1e-6, 0.02, 16.0
COMPACT, UNEVEN, COMPACT_THICKNESSES = 0.55, 0.45, 2.75
_LENGTHS = [float(np.hypot(dx, dy)) for dx, dy in AXES]


def _whole(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def _axis(dx: Column, dy: Column) -> Column:
    """The line of the one of eight directions that has the signs of a unit vector's parts; parts of no size
    count as 0."""
    sx, sy = (F.signum(F.round(c, 9)).cast("int") for c in (dx, dy))
    return F.when(sy == 0, 0).when(sx == 0, 1).when(sx == sy, 2).otherwise(3)


def _darkness(cells: DataFrame, scan: DataFrame) -> DataFrame:
    """Cells (shape_id, x, y, ...) with the scan's darkness there as `dark`, 0 outside."""
    values = scan.select(F.col("frame_id").alias("shape_id"), "x", "y", F.col("value").alias("dark"))
    return cells.join(values, ["shape_id", "x", "y"], "left").withColumn("dark", F.coalesce("dark", F.lit(0.0)))


def measure(features: DataFrame, points: DataFrame, scan: DataFrame, ink: bool = False, r: int = MEASURE_RADIUS) -> DataFrame:
    """Adds anchor_x, anchor_y, thickness, opacity, border_blend, blotch and end_stop to the features of all
    vertices; `scan` (frame_id, x, y, value) tells darkness.

    A pencil's vertex is measured at its smoothed anchor; thickness and opacity are means over the anchors of
    r vertices either way, weights r + 1 - |d|, seen along its own normal. An ink's vertex is measured at the
    nearest cell of the drawing, without averages, and only ink has a border blend.
    - thickness: 0.5 and 0.82 of the unbroken cells along the normal, both ways from the drawing's cell at
      the anchor;
    - opacity: mean darkness of a disk at the anchor and of the next cells inward;
    - border_blend: mean darkness of 15 steps along the normal, near ones weighing more, as a share of the
      vertex's own; the larger of both sides;
    - blotch: half of how far the anchor, and half of how far the vertex from the mean of its neighbours,
      lies outward;
    - end_stop: how short against the thickness, and how uneven, the unbroken cells along the tangent are.
    A shape without cells has thickness 1, its vertices as anchors and no end stop."""
    from rasterloom.sources.tables import materialise

    key = ["shape_id", "ord"]
    f, points, scan = materialise(features), materialise(points), materialise(scan)
    n = f.groupBy("shape_id").agg(F.count("*").cast("int").alias("n"))
    if ink:
        near = nearest(points, f.select("shape_id", F.col("x").alias("qx"), F.col("y").alias("qy")).distinct())
        at = f.select(*key, F.col("x").alias("qx"), F.col("y").alias("qy")).join(near.select("shape_id", "qx", "qy", "x", "y"), ["shape_id", "qx", "qy"]).select(*key, "x", "y")
    else:
        at = anchors(f, points)
    at = at.select(*key, F.col("x").alias("anchor_x"), F.col("y").alias("anchor_y"))
    # The drawing's own cell at each anchor, from which probes start.
    asked = at.select("shape_id", F.col("anchor_x").alias("qx"), F.col("anchor_y").alias("qy")).distinct()
    start = nearest(points, asked).select("shape_id", F.col("qx").alias("anchor_x"), F.col("qy").alias("anchor_y"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    at = materialise(at.join(start, ["shape_id", "anchor_x", "anchor_y"]))
    f = f.join(at, key, "left").withColumns({"anchor_x": F.coalesce("anchor_x", "x"), "anchor_y": F.coalesce("anchor_y", "y")})
    f = materialise(f.withColumns({"normal_axis": _axis(F.col("normal_x"), F.col("normal_y")), "tangent_axis": _axis(F.col("tx"), F.col("ty"))}))

    radius = 0 if ink else r
    taps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(radius + 1 - abs(d))).alias("w")) for d in range(-radius, radius + 1)])
    each = f.join(n, "shape_id").select(*key, "n", "normal_axis", "normal_x", "normal_y", F.explode(taps).alias("tap"))
    each = each.withColumns({"to": F.pmod(F.col("ord") + F.col("tap.d"), F.col("n")).cast("int"), "w": F.col("tap.w")})
    other = f.select("shape_id", F.col("ord").alias("to"), "anchor_x", "anchor_y", "sx", "sy")
    each = materialise(each.join(other, ["shape_id", "to"]).drop("tap", "n"))
    runs = materialise(extents(points))
    steps = lambda name: F.get(F.array(*[F.lit(v) for v in _LENGTHS]), F.col("axis")) * F.col(name)
    along = lambda rows, axis: rows.withColumn("axis", F.col(axis)).join(runs.withColumnsRenamed({"x": "sx", "y": "sy"}), ["shape_id", "sx", "sy", "axis"])
    low, high, _ = OUTPUTS["thickness"]
    thick = N.bound(0.5 + (steps("ahead") + steps("behind")) * PROBE_SHARE, low, high)
    thickness = along(each, "normal_axis").groupBy(*key).agg(N.bound(F.sum(thick * F.col("w")) / F.sum("w"), low, high).alias("thickness"))

    disk = [(dx, dy) for dx in range(-OPACITY_RADIUS, OPACITY_RADIUS + 1) for dy in range(-OPACITY_RADIUS, OPACITY_RADIUS + 1) if dx * dx + dy * dy <= OPACITY_RADIUS**2]
    place = lambda dx, dy: F.struct(_whole(F.col("anchor_x") + dx).alias("x"), _whole(F.col("anchor_y") + dy).alias("y"))
    cells = F.array(*[place(F.lit(dx), F.lit(dy)) for dx, dy in disk], *[place(F.col("normal_x") * i, F.col("normal_y") * i) for i in range(1, OPACITY_RADIUS + 1)])
    spread = each.select(*key, "w", F.explode(cells).alias("c")).select(*key, "w", "c.x", "c.y")
    opacity = _darkness(spread, scan).groupBy(*key).agg(N.clamp01(F.sum(F.col("dark") * F.col("w")) / F.sum("w")).alias("opacity"))

    local = lambda c: loop_mean(f, n, c, BLOTCH_RADIUS).withColumnRenamed(c, f"mean_{c}")
    full = f.join(thickness, key, "left").join(opacity, key, "left").join(local("x"), key).join(local("y"), key)
    full = full.withColumns({"thickness": F.coalesce("thickness", F.lit(1.0)), "opacity": F.coalesce("opacity", F.lit(0.0))})
    outward = lambda x, y: -(x * F.col("normal_x") + y * F.col("normal_y"))
    blotch = outward(F.col("anchor_x") - F.col("x"), F.col("anchor_y") - F.col("y")) / 2 + outward(F.col("x") - F.col("mean_x"), F.col("y") - F.col("mean_y")) / 2
    ends = along(f, "tangent_axis").select(*key, steps("ahead").alias("ahead"), steps("behind").alias("behind"))
    full = full.withColumn("blotch", N.bound(blotch, -MOST_BLOTCH, MOST_BLOTCH)).join(ends, key, "left")
    span = F.col("ahead") + F.col("behind")
    compact = 1 - N.clamp01(span / F.greatest(F.lit(2.0), F.col("thickness") * COMPACT_THICKNESSES))
    uneven = F.coalesce(F.try_divide(F.abs(F.col("ahead") - F.col("behind")), span), F.lit(0.0))
    full = full.withColumn("end_stop", F.when(span.isNull(), 0.0).otherwise(N.clamp01(compact * COMPACT + uneven * UNEVEN)))
    if ink:
        blends = border_blends(full, scan)
        full = full.join(blends, key, "left").withColumn("border_blend", F.when(F.col("opacity") > LEAST_OPACITY, F.coalesce("border_blend", F.lit(0.0))).otherwise(0.0))
    else:
        full = full.withColumn("border_blend", F.lit(0.0))
    return full.drop("normal_axis", "tangent_axis", "sx", "sy", "ahead", "behind", "mean_x", "mean_y")


def border_blends(features: DataFrame, scan: DataFrame) -> DataFrame:
    """(shape_id, ord, border_blend) of the vertices that are dark themselves."""
    edge = _darkness(features.select("shape_id", "ord", "x", "y", "normal_x", "normal_y"), scan).where(F.col("dark") > LEAST_EDGE)
    # Steps on the vertex's two sides, with their weights.
    way = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(i).alias("i"), F.lit(1 - (i - 1) / BORDER_SCAN).alias("w")) for side in (-1, 1) for i in range(1, BORDER_SCAN + 1)])
    each = edge.select("shape_id", "ord", F.col("dark").alias("edge"), "x", "y", "normal_x", "normal_y", F.explode(way).alias("s"))
    step = F.col("s.side") * F.col("s.i")
    each = each.select("shape_id", "ord", "edge", "s.side", "s.w", _whole(F.col("x") + F.col("normal_x") * step).alias("x"), _whole(F.col("y") + F.col("normal_y") * step).alias("y"))
    side = _darkness(each, scan).groupBy("shape_id", "ord", "edge", "side").agg((F.sum(F.col("dark") * F.col("w")) / F.sum("w")).alias("mean"))
    return side.groupBy("shape_id", "ord").agg(F.max(N.clamp01(F.col("mean") / F.col("edge"))).alias("border_blend"))


def loop_mean(features: DataFrame, n: DataFrame, col: str, r: int) -> DataFrame:
    """(shape_id, ord, col): plain mean of the r vertices either way along the loop, without the vertex."""
    taps = F.array(*[F.lit(d) for d in range(-r, r + 1) if d])
    at = features.join(n, "shape_id").select("shape_id", "n", "ord", F.col(col).alias("v"), F.explode(taps).alias("d"))
    to = at.select("shape_id", F.pmod(F.col("ord") + F.col("d"), F.col("n")).cast("int").alias("ord"), "v")
    return to.groupBy("shape_id", "ord").agg(F.avg("v").alias(col))


#: Reach of the averages of contour points and of nearest members, and how far an anchor goes to the latter.
CONTOUR_RADIUS, ANCHOR_RADIUS, ANCHOR_BLEND = 3, 6, 0.82


def anchors(features: DataFrame, points: DataFrame) -> DataFrame:
    """(shape_id, ord, x, y): where a vertex lies on the drawing. The contour is averaged along the loop, every
    averaged vertex takes its nearest member of the point set, and these are averaged along the loop again;
    the anchor lies between the nearest member and that average, nearer to the latter. Whole numbers are
    rounded half up at every step. Shapes without points have no anchors."""
    half_up = lambda c: F.floor(F.col(c) + 0.5).cast("int").alias(c)

    def averaged(rows: DataFrame, r: int) -> DataFrame:
        both = loop_average(rows, "x", r).join(loop_average(rows, "y", r), ["shape_id", "ord"])
        return both.select("shape_id", "ord", half_up("x"), half_up("y"))

    smooth = averaged(features, CONTOUR_RADIUS).withColumnsRenamed({"x": "qx", "y": "qy"})
    found = nearest(points, smooth.select("shape_id", "qx", "qy")).drop("distance")
    near = smooth.join(found, ["shape_id", "qx", "qy"]).select("shape_id", "ord", "x", "y")
    mean = averaged(near, ANCHOR_RADIUS).withColumnsRenamed({"x": "mx", "y": "my"})
    pull = lambda c: F.floor(F.col(c) + (F.col(f"m{c}") - F.col(c)) * ANCHOR_BLEND + 0.5).cast("int").alias(c)
    return near.join(mean, ["shape_id", "ord"]).select("shape_id", "ord", pull("x"), pull("y"))


def map_averages(features: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Mean of the columns per shape, and each row's deviation of the first from its mean."""
    mean = features.groupBy("shape_id").agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])
    return features.join(mean, "shape_id").withColumn("deviation", F.col(cols[0]) - F.col(f"mean_{cols[0]}"))


def nearest_by_location(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each sample of a, the sample of b nearest on the circle of locations, ties to the smaller ord.

    b's locations are cut into as many cells as it has samples; a row meets its own cell and grows only
    by the cells around it that are empty, found by a two-sided as-of over the union."""
    pos = lambda d, side: d.select("shape_id", F.col("location").alias("loc"), "ord", F.lit(side).alias("side"))
    turns = F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0))
    right = pos(b, 1).withColumn("t", F.explode(turns)).select("shape_id", (F.col("loc") + F.col("t")).alias("loc"), "ord", "side")
    both = pos(a, 0).unionAll(right)
    w = Window.partitionBy("shape_id").orderBy("loc", "side")
    hit = F.when(F.col("side") == 1, F.struct("loc", "ord"))
    near = both.withColumns({"lo": F.last(hit, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "hi": F.first(hit, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    d = lambda c: F.struct(F.round(F.abs(F.col(c)["loc"] - F.col("loc")), 12).alias("d"), F.col(c)["ord"].alias("ord"))
    return near.where("side = 0").select("shape_id", "ord", F.least(d("lo"), d("hi")).alias("m")).select("shape_id", "ord", F.col("m.ord").alias("other"), F.col("m.d").alias("distance"))


def comparable(features: DataFrame) -> DataFrame:
    """Adds the place inside the contour's bounds (u, v in 0..1, 0.5 where the bounds are flat) and the
    radius as a share of their diagonal."""
    b = features.groupBy("shape_id").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo_", F.min), ("hi_", F.max))])
    at = lambda c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 0.5).otherwise((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")))
    diagonal = F.greatest(F.lit(1.0), F.hypot(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")))
    wide = features.join(b, "shape_id").withColumns({"u": at("x"), "v": at("y"), "share": F.col("radius") / diagonal})
    return wide.drop("lo_x", "lo_y", "hi_x", "hi_y")


def match_score(a: Column, b: Column) -> Column:
    """Weighted sum of the differences of two comparable feature structs; smaller is better. Tangents are
    compared as directions, over half a turn; the difference of derivatives counts up to 1."""
    turn = F.abs(F.atan2(a["ty"], a["tx"]) - F.atan2(b["ty"], b["tx"]))
    arc = F.abs(a["location"] - b["location"])
    parts = {
        "place": F.hypot(a["u"] - b["u"], a["v"] - b["v"]),
        "orientation": F.least(turn, 2 * np.pi - turn) / np.pi,
        "derivative": F.least(F.lit(1.0), F.abs(a["derivative"] - b["derivative"])),
        "radius": F.abs(a["share"] - b["share"]),
        "arc": F.least(arc, 1 - arc),
    }
    return sum((parts[k] * w for k, w in SCORE_WEIGHTS.items()), F.lit(0.0))


_FIELDS = ("ord", "u", "v", "tx", "ty", "derivative", "share", "location")


def _one_way(p: DataFrame, q: DataFrame) -> DataFrame:
    """(shape_id, ord, other, score) of the best of q for each sample of p."""
    from rasterloom.sources.tables import materialise

    n = q.groupBy("shape_id").agg(F.count("*").alias("n"))
    left = p.select("shape_id", "ord", F.struct(*_FIELDS).alias("a"))
    right = q.select("shape_id", F.col("ord").alias("to"), F.struct(*_FIELDS).alias("b"))
    start = nearest_by_location(p, q).select("shape_id", "ord", "other").join(n, "shape_id")
    near = start.withColumn("d", F.explode(F.sequence(F.lit(-MATCH_SAMPLES), F.lit(MATCH_SAMPLES))))
    near = near.withColumn("to", F.pmod(F.col("other") + F.col("d"), F.col("n")).cast("int")).select("shape_id", "ord", "d", "to")
    arc = F.abs(F.col("a.location") - F.col("b.location"))
    pairs = near.join(left, ["shape_id", "ord"]).join(right, ["shape_id", "to"]).where(F.least(arc, 1 - arc) <= MATCH_ARC)
    score = F.round(match_score(F.col("a"), F.col("b")), 12)
    best = lambda rows, tie: rows.groupBy("shape_id", "ord").agg(F.min(F.struct(score.alias("s"), tie, "to")).alias("m")).select("shape_id", "ord", F.col("m.to").alias("other"), F.col("m.s").alias("score"))
    local = materialise(best(pairs, "d"))
    # Samples without a partner nearby meet all samples of their shape.
    rest = left.join(local, ["shape_id", "ord"], "left_anti").join(right, "shape_id")
    return local.unionByName(best(rest, F.col("to").alias("d")))


def best_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """(shape_id, ord, other, score, location, confidence): least score among the samples of b within 12
    places of the nearest by location and 0.025 of the perimeter; among all of them where none is so near.
    Location is the mean of both. Confidence falls with the score, and where the match back is another."""
    from rasterloom.sources.tables import materialise

    a, b = materialise(comparable(materialise(a))), materialise(comparable(materialise(b)))
    there = _one_way(a, b)
    back = _one_way(b, a).select("shape_id", F.col("ord").alias("other"), F.col("other").alias("returned"))
    at = lambda d, key, name: d.select("shape_id", F.col("ord").alias(key), F.col("location").alias(name))
    both = there.join(back, ["shape_id", "other"]).join(at(a, "ord", "la"), ["shape_id", "ord"]).join(at(b, "other", "lb"), ["shape_id", "other"])
    sure = F.when(F.col("returned") == F.col("ord"), 1.0).otherwise(1 - MISMATCH) / (1 + F.col("score"))
    return both.select("shape_id", "ord", "other", "score", ((F.col("la") + F.col("lb")) / 2).alias("location"), N.bound(sure, LEAST_CONFIDENCE, 1.0).alias("confidence"))


def naive_match(a: DataFrame, b: DataFrame) -> DataFrame:
    return nearest_by_location(a, b).select("shape_id", "ord", "other", F.lit(1.0).alias("confidence"))


# -- the linear model: rows (inputs..., outputs..., confidence)


def standardize(rows: DataFrame, inputs: tuple[str, ...]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Inputs with mean 0 and deviation 1 (deviations under 1e-9 count as 1), and what was used."""
    r = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in inputs], *[F.stddev_pop(c).alias(f"s_{c}") for c in inputs]).first()
    used = {c: (r[f"m_{c}"] or 0.0, r[f"s_{c}"] if r[f"s_{c}"] and r[f"s_{c}"] >= 1e-9 else 1.0) for c in inputs}
    return rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in used.items()}), used


def vectorize(rows: DataFrame, inputs: tuple[str, ...], cross: bool = False) -> DataFrame:
    """Adds `features`: the inputs, optionally their pairwise products, and a bias of 1."""
    terms = [F.col(c).cast("double") for c in inputs]
    if cross:
        terms += [F.col(a) * F.col(b) for i, a in enumerate(inputs) for b in inputs[i:]]
    return rows.withColumn("features", F.array(*terms, F.lit(1.0)))


def _moments(rows: DataFrame, size: int, output: str) -> tuple[np.ndarray, np.ndarray, float]:
    """X'CX, X'Cy and the sum of confidences: size * (size + 3) / 2 sums in one pass."""
    x = lambda i: F.get("features", i)
    conf = F.col("confidence")
    sums = [F.sum(conf * x(i) * x(j)).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)]
    sums += [F.sum(conf * x(i) * F.col(output)).alias(f"y{i}") for i in range(size)]
    r = rows.agg(*sums, F.sum(conf).alias("c")).first()
    gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(size)] for i in range(size)])
    return gram, np.array([r[f"y{i}"] or 0.0 for i in range(size)]), r["c"] or 0.0


def init_weights(gram: np.ndarray, xy: np.ndarray, total: float) -> np.ndarray:
    """Weighted mean as bias (last) and a share of covariance over the feature's square mean."""
    w = np.zeros(len(xy))
    if total <= 0:
        return w
    w[-1] = xy[-1] / total
    for i in range(len(xy) - 1):
        square = gram[i, i] / total
        if square >= 1e-9:
            w[i] = FIRST_GUESS * (xy[i] - gram[i, -1] * w[-1]) / total / square
    return w


def first_weights(rows: DataFrame, inputs: tuple[str, ...], output: str, cross: bool = False) -> DataFrame:
    """(term, weight): the first guess for every input, and `bias`."""
    full = vectorize(rows, inputs, cross)
    names = list(inputs) + ([f"{a}*{b}" for i, a in enumerate(inputs) for b in inputs[i:]] if cross else []) + ["bias"]
    w = init_weights(*_moments(full, len(names), output))
    return rows.sparkSession.createDataFrame([(t, float(v)) for t, v in zip(names, w)], "term string, weight double")


def fit(rows: DataFrame, inputs: tuple[str, ...], output: str, cross: bool = False, epochs: int = EPOCHS, rate: float = RATE, ridge: float = RIDGE) -> np.ndarray:
    """Weighted ridge regression by gradient steps. The steps depend on the data through its moments
    alone, so one aggregate feeds all of them."""
    full = vectorize(rows, inputs, cross)
    size = len(inputs) + (len(inputs) * (len(inputs) + 1) // 2 if cross else 0) + 1
    gram, xy, total = _moments(full, size, output)
    w = init_weights(gram, xy, total)
    keep = np.ones(size)
    keep[-1] = 0.0  # the bias is not shrunk
    for _ in range(epochs if total > 0 else 0):
        w = w - rate * ((gram @ w - xy) / total + ridge * keep * w)
    return w


def predict(rows: DataFrame, inputs: tuple[str, ...], weights: np.ndarray, low: float, high: float, cross: bool = False) -> DataFrame:
    """Adds `predicted`, bounded."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    dot = F.aggregate(F.zip_with("features", w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return vectorize(rows, inputs, cross).withColumn("predicted", N.bound(dot, low, high))


def synthesise(rows: DataFrame, inputs: tuple[str, ...], weights: dict[str, np.ndarray], cross: bool = False) -> DataFrame:
    """Rows with each weighted measure moved on: its own value and the predicted change times its strength,
    within its bounds; what is no number becomes 0 first. Measures without weights stay."""
    unknown = set(weights) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"no such measure: {', '.join(sorted(unknown))}")
    full = vectorize(rows, inputs, cross)

    def moved(output: str, w: np.ndarray) -> Column:
        low, high, strength = OUTPUTS[output]
        given = F.array(*[F.lit(float(v)) for v in w])
        delta = F.aggregate(F.zip_with("features", given, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        value = F.col(output) + delta * strength
        finite = F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
        return N.bound(finite, low, high)

    return full.withColumns({o: moved(o, w) for o, w in weights.items()}).drop("features")


def rmse(rows: DataFrame, output: str) -> DataFrame:
    """Confidence-weighted root mean squared error of `predicted`."""
    d = F.pow(F.col("predicted") - F.col(output), F.lit(2))
    return rows.agg(F.sqrt(F.sum(F.col("confidence") * d) / F.sum("confidence")).alias("rmse"))


def session(a: DataFrame, b: DataFrame, inputs: tuple[str, ...] = INPUTS) -> tuple[DataFrame, DataFrame]:
    """Two contours of each shape, framed, described and matched, and the first weights by which the
    inputs of a tell how far b's radius lies from a's: (matches, weights)."""
    from rasterloom.sources.tables import materialise

    fa, fb = (materialise(build_features(local_frame(d))) for d in (a, b))
    matches = best_match(fa, fb)
    there = fb.select("shape_id", F.col("ord").alias("other"), F.col("radius").alias("other_radius"))
    pairs = fa.join(matches.select("shape_id", "ord", "other", "confidence"), ["shape_id", "ord"]).join(there, ["shape_id", "other"])
    rows, _ = standardize(pairs.withColumn("target", F.col("other_radius") - F.col("radius")), inputs)
    return matches, first_weights(rows, inputs, "target")
