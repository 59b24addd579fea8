"""The eight ready-made jobs, each over all frames at once.

Frames are pixels (frame_id, x, y, argb); borders and crops are tables keyed by frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.color import pack_argb, unpack_argb, with_hsv_of
from rasterloom.functions.predicates import is_black, is_default_ink
from rasterloom.operators import colormodel as CM
from rasterloom.operators import compare as CO
from rasterloom.operators import contours as K
from rasterloom.operators import filters as FI
from rasterloom.operators import groups as G
from rasterloom.operators import layers as L
from rasterloom.operators import pixels as X
from rasterloom.operators import points as T
from rasterloom.operators.sets import POINT
from rasterloom.sources.tables import materialise

KEY = ["frame_id", "x", "y"]


def with_hsv(pixels: DataFrame) -> DataFrame:
    parts = pixels.withColumn("u", unpack_argb(F.col("argb"))).select(*KEY, "argb", "u.r", "u.g", "u.b")
    return with_hsv_of(parts, *KEY, "argb")


def _framed(points: DataFrame) -> DataFrame:
    return points.select(F.col("shape_id").alias("frame_id"), "x", "y")


def ink(pixels: DataFrame) -> DataFrame:
    """Ink-like points as shapes (shape_id = frame)."""
    return with_hsv(pixels).where(_is_ink()).select(F.col("frame_id").alias("shape_id"), "x", "y")


def _hsv_points(pixels: DataFrame, pred: Column) -> DataFrame:
    return with_hsv(pixels).where(pred).select(F.col("frame_id").alias("shape_id"), "x", "y")


def object_outline(points: DataFrame, dist: float) -> DataFrame:
    """Contour of drawings (shape_id, x, y), with gaps up to dist bridged by growing."""
    return K.trace_runs(T.dilate_runs(T.to_runs(points), max(1, round(dist))))


def _largest_part(pixels: DataFrame, frames: DataFrame, dist: float, pred: Column) -> DataFrame:
    """The group of each frame's pixels around the anchor of the largest group on its mini image."""
    rows = with_hsv(pixels)
    return materialise(G.mini_anchor_then_local(rows, frames, dist, lambda mini: (with_hsv(mini), [pred]), pred))


#: A drawn part is contracted by this share of its outline's width.
CONTRACTED = 1 / 3


def contracted(points: DataFrame, contour: DataFrame) -> DataFrame:
    """Inside of a contour (shape_id, x, y), contracted by a third of its outline's width, rounded half up and
    one cell at least; `points` are the outline's cells."""
    width = F.greatest(F.lit(1), F.floor(F.coalesce("width", F.lit(0.0)) * CONTRACTED + 0.5).cast("int"))
    each = contour.select("shape_id").distinct().join(K.outline_width(points, contour), "shape_id", "left")
    return K.rasterize(K.contract_by(contour, materialise(each.select("shape_id", width.alias("r")))))


def part_select(pixels: DataFrame, background: DataFrame, border: DataFrame) -> DataFrame:
    """The pixels inside each frame's border columns (shape_id, x, y) copied on the background."""
    cells = _framed(T.from_runs(T.spans(border)))
    return X.replace_pixels(background, pixels, cells)


def part_combine(base: DataFrame, pixels: DataFrame, borders: DataFrame) -> DataFrame:
    """The insides of all frames' contours pasted on one base (x, y, argb); the last frame wins."""
    inside = _framed(K.rasterize(K.trace(borders)))
    top = pixels.join(inside, KEY, "left_semi").groupBy("x", "y").agg(F.max_by("argb", "frame_id").alias("new"))
    return base.join(top, ["x", "y"], "left").select("x", "y", F.coalesce("new", "argb").alias("argb"))


def paint_crop(pixels: DataFrame, background: DataFrame, rect: tuple[int, int, int, int], dist: float = 2.0, border: DataFrame | None = None, pred: Column | None = None) -> DataFrame:
    """The object inside a crop, contracted by a third of its outline's width, on the background.

    A given border (shape_id, x, y) is the object's outline; of it, what lies in the crop counts. Without
    one, the object is the largest group of what is ink, or meets another predicate on h, s and v."""
    x, y, w, h = rect
    within = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    if border is None:
        outline = materialise(G.largest_group(G.group_points(_hsv_points(pixels.where(within), _is_ink() if pred is None else pred), dist)))
        contour = materialise(object_outline(outline, dist))
    else:
        outline = materialise(border.where(within).select(POINT).distinct())
        contour = materialise(K.trace(outline))
    return X.replace_pixels(background, pixels, _framed(contracted(outline, contour)))


def part_overlay(pixels: DataFrame, background: DataFrame, frames: DataFrame, dist: float = 2.0) -> DataFrame:
    """The frame multiplied on the background, and the inside of its largest ink part laid over it plainly.
    The part is the ink around the anchor of the largest ink group on the mini image, contracted by a third
    of its outline's width. `frames` has frame_id, width and height."""
    # Read several times: each time what makes the frames would be shuffled anew.
    pixels = materialise(pixels.select(*KEY, "argb"))
    part = _largest_part(pixels, frames, dist, _is_ink())
    contour = materialise(object_outline(part, dist))
    inside = _framed(contracted(part, contour)).withColumn("inside", F.lit(True))
    src = pixels.select(*KEY, F.col("argb").alias("src")).join(inside, KEY, "left")
    both = background.join(src, KEY, "left")
    out = F.when(F.col("src").isNull(), F.col("argb")).when(F.col("inside"), F.col("src")).otherwise(L.composite(F.col("argb"), F.col("src"), "MULTIPLY"))
    return both.select(*KEY, out.alias("argb"))


#: The pencil drawing's saturation from, and value up to; steps it grows, shrinks and grows; brush width.
PENCIL, XEROX_STEPS, XEROX_BRUSH = (2, 98), (3, 4, 1), 5


def ink_xerox(pixels: DataFrame, frames: DataFrame, color: int, dist: float = 2.0) -> DataFrame:
    """The pencil drawing closed (grow 3, shrink 4, grow 1) and stamped by a hard 5 px brush on white. The
    drawing is what is neither gray nor white around the anchor of the largest such group on the mini image."""
    pencil = (F.col("s") >= PENCIL[0]) & (F.col("v") <= PENCIL[1])
    drawing = _largest_part(pixels, frames, dist, pencil)
    body = T.dilate(T.erode(T.dilate(drawing, XEROX_STEPS[0]), XEROX_STEPS[1]), XEROX_STEPS[2])
    brush = L.Brush(color, XEROX_BRUSH)
    white = pixels.select(*KEY, F.lit(-1).alias("argb"))
    return L.paint_coverage(white, L.stamp_points(body, brush), brush)


@dataclass(frozen=True)
class Specimen:
    """A piece of painted texture: `cells` (x, y, r, g, b) within `size` from (0, 0), and the sample colour
    (r, g, b) that is multiplied on the part it fills."""

    color: tuple[int, int, int]
    cells: DataFrame
    size: tuple[int, int]


#: How much larger, in hundredths, a region may be for a specimen to be scaled to it; most tiles of a specimen
#: at its own size, and its size, in hundredths, where it takes more (fixed values).
SCALED_UP_TO, MOST_TILES, TILE_PERCENT = 10, 10, 464.827586207


def paint_fill(pixels: DataFrame, frames: DataFrame, specimens: list[Specimen], dist: float = 2.0, painted: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """Fills the inner parts of drawn frames, one by each specimen.

    A part is what is no ink around a seed: the anchor of the largest group of the specimen's colour on the
    painted frame's mini image, an error where there is none, or, without painted frames, the given `seeds`
    (frame_id, which, x, y). Parts grow by a third of the way from the drawing's outline to the nearest part;
    the inside of a grown part is multiplied with the specimen's colour, and the specimen's difference from
    its mean is subtracted there. A specimen wider and higher than the part is centred on it, one that is
    at most a tenth smaller is scaled and centred; others are tiled over the grown part, enlarged where more
    than ten tiles would be needed. `frames` has frame_id, width and height."""
    n = len(specimens)
    if (painted is None) == (seeds is None):
        raise ValueError("either painted frames or seeds are wanted")
    # Read several times, and the ink rule right behind an aggregation makes code too large to compile.
    pixels, frames = materialise(pixels.select(*KEY, "argb")), materialise(frames.select("frame_id", "width", "height"))
    hsv = materialise(with_hsv(pixels).select(*KEY, _is_ink().alias("dark")))
    points = lambda d: d.select(F.col("frame_id").alias("shape_id"), "x", "y")
    if seeds is None:
        colors = [_hsv_of(s.color) for s in specimens]
        seeds = G.mini_anchors(painted, frames, 1.0, lambda mini: (with_hsv(mini), [_near_color(c) for c in colors]), n, accept_empty=False)
    seeds = materialise(seeds.select(F.col("frame_id").alias("shape_id"), "x", "y", "which"))
    split = lambda d: d.select(F.expr(f"shape_id div {n}").alias("frame_id"), (F.col("shape_id") % n).cast("int").alias("which"), *[c for c in d.columns if c != "shape_id"])
    # One grouping for all specimens; a group may hold the seeds of several.
    groups = materialise(G.group_points(points(hsv.where("not dark")), 1.0))
    wanted = groups.join(seeds, POINT).select("shape_id", "label", "which").distinct()
    part = materialise(groups.join(wanted.hint("merge"), ["shape_id", "label"]).select((F.col("shape_id") * n + F.col("which")).alias("shape_id"), "x", "y"))

    # How far from the drawing's outline, at its vertex nearest to the drawing's anchor, the nearest part lies.
    ink_anchor = materialise(points(G.mini_anchors(pixels, frames, dist, lambda mini: (with_hsv(mini), [_is_ink()]))))
    drawing = G.derive_group(points(hsv.where("dark")), ink_anchor, dist)
    outline = materialise(object_outline(materialise(drawing), dist))
    vertex = K.nearest_vertex(outline, ink_anchor.select("shape_id", F.col("x").alias("qx"), F.col("y").alias("qy")))
    vertex = materialise(vertex.select("shape_id", "ord").join(outline, ["shape_id", "ord"]).select("shape_id", F.col("x").alias("qx"), F.col("y").alias("qy")))
    # A frame has one such vertex, so that its cells are looked at once.
    far = F.pow((F.col("x") - F.col("qx")).cast("double"), F.lit(2.0)) + F.pow((F.col("y") - F.col("qy")).cast("double"), F.lit(2.0))
    inner = split(part).select(F.col("frame_id").alias("shape_id"), "x", "y")
    reach = inner.join(vertex, "shape_id").groupBy("shape_id").agg(F.sqrt(F.min(far)).alias("distance"))
    third = F.greatest(F.lit(1), F.floor(F.col("distance") / 3).cast("int")).alias("r")
    steps = reach.select(F.col("shape_id").alias("frame_id"), third)
    radii = materialise(split(part.select("shape_id").distinct()).join(steps, "frame_id", "left").select((F.col("frame_id") * n + F.col("which")).alias("shape_id"), F.coalesce("r", F.lit(1)).alias("r")))
    grown = materialise(T.dilate_by(part, radii))
    region = materialise(K.rasterize(K.trace(grown)))

    rgb = F.array(*[pack_argb(F.lit(255), *[F.lit(c) for c in s.color]) for s in specimens])
    fill = split(region).groupBy(*KEY).agg(F.array_sort(F.collect_list("which")).alias("parts"))
    top = materialise(_textures(specimens, part, grown, n).join(region, POINT, "left_semi"))
    noises = split(top).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("which", "noise"))).alias("noises"))
    both = pixels.join(fill, KEY, "left").join(noises, KEY, "left")
    # At most one entry for each specimen.
    none = F.array().cast("array<int>")
    multiplied = F.aggregate(F.coalesce("parts", none), F.col("argb"), lambda acc, i: L.composite(acc, F.get(rgb, i), "MULTIPLY"))
    done = both.select(*KEY, multiplied.alias("argb"), F.coalesce(F.transform("noises", lambda v: v["noise"]), none).alias("noises"))
    return done.select(*KEY, F.aggregate("noises", F.col("argb"), lambda acc, v: L.composite(acc, v, "SUBTRACT")).alias("argb"))


def _textures(specimens: list[Specimen], part: DataFrame, grown: DataFrame, n: int) -> DataFrame:
    """(shape_id, x, y, noise): each specimen's difference from its mean, centred, scaled or tiled on its
    parts (shape_id = frame x n + specimen). The parts of all frames that take one course go together."""
    sizes = part.groupBy("shape_id").agg(*[F.min(c).alias(f"{c}0") for c in "xy"], *[(F.max(c) - F.min(c) + 1).alias(f"{c}n") for c in "xy"])
    out: DataFrame | None = None
    for which, s in enumerate(specimens):
        w, h = s.size
        cells = CM.paint_specimen(s.cells.select(F.lit(0).alias("frame_id"), "x", "y", "r", "g", "b"))
        cells = materialise(cells.select(F.col("x").alias("tx"), F.col("y").alias("ty"), pack_argb(F.lit(255), F.col("r"), F.col("g"), F.col("b")).alias("noise")))
        own = sizes.where(F.col("shape_id") % n == which)
        over = lambda c, size: ((F.col(c) - size) * 100 / size).between(0, SCALED_UP_TO)
        how = F.when((F.col("xn") < w) & (F.col("yn") < h), "centre").when(over("xn", w) & over("yn", h), "scale").otherwise("tile")
        tiles = F.ceil(F.col("xn") / w) * F.ceil(F.col("yn") / h)
        percent = (
            F.when(how == "scale", F.greatest(F.col("xn") / w, F.col("yn") / h) + 1).when((how == "tile") & (tiles > MOST_TILES), TILE_PERCENT).otherwise(100.0)
        )
        own = materialise(own.withColumns({"how": how, "percent": F.when(how == "scale", percent * 100).otherwise(percent)}))
        big = lambda size: F.greatest(F.lit(1), F.floor(F.lit(size) * F.col("percent") / 100 + 0.5).cast("int"))
        own = own.withColumns({"w": big(w), "h": big(h)})
        half = lambda c, size: F.col(f"{c}0") + ((F.col(f"{c}n") - F.col(size)) / 2).cast("int")
        starts = own.where("how <> 'tile'").select("shape_id", "w", "h", "percent", half("x", "w").alias("x"), half("y", "h").alias("y"))
        tiled = own.where("how = 'tile'").select("shape_id", "w", "h", "percent")
        for r in tiled.select("w", "h").distinct().collect():  # a specimen has two sizes of tiles at most
            at = grown.join(tiled.where((F.col("w") == r["w"]) & (F.col("h") == r["h"])).select("shape_id"), "shape_id", "left_semi")
            placed = X.adaptive_tiles(at.withColumnRenamed("shape_id", "region_id"), r["w"], r["h"]).withColumnRenamed("region_id", "shape_id")
            starts = starts.unionByName(placed.join(tiled, "shape_id").select("shape_id", "w", "h", "percent", "x", "y"))
        column = starts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
        each = column.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
        back = lambda c, size: F.least((F.col(c) * 100 / F.col("percent")).cast("int"), F.lit(size - 1))
        # The cells are the specimen's, however many frames there are; by key all frames would meet in a few tasks.
        each = each.withColumns({"tx": back("i", w), "ty": back("j", h)}).join(F.broadcast(cells), ["tx", "ty"])
        laid = each.groupBy("shape_id", (F.col("x") + F.col("i")).alias("x"), (F.col("y") + F.col("j")).alias("y")).agg(F.max("noise").alias("noise"))
        out = laid if out is None else out.unionByName(laid)
    return out


def _hsv_of(color: tuple[int, int, int]) -> tuple[float, float, float]:
    import colorsys

    h, s, v = colorsys.rgb_to_hsv(*[c / 255 for c in color])
    return h * 360, s * 100, v * 100


def _near_color(color: tuple[float, float, float]) -> Column:
    """Hue and saturation within one, value within three, of a colour's whole parts."""
    import math

    within = lambda c, v, d: F.col(c).between(math.floor(v) - d, math.ceil(v) + d)
    return within("h", color[0], 1) & within("s", color[1], 1) & within("v", color[2], 3)


def _is_ink() -> Column:
    """The ink rule; a one-element array binds the colour, so that its many terms share one conversion."""
    bound = F.transform(F.array(F.struct("h", "s", "v")), lambda c: is_default_ink(c["h"], c["s"], c["v"]))
    return F.get(bound, 0)


#: How near a border cell of its row or column must be for a painted outline to be joined to it, and how far
#: black cells of one object may lie apart.
JOIN_REACH, OBJECT_GAP = 6, 3.0


def reached(steps: DataFrame) -> DataFrame:
    """(shape_id, ord) of the vertices that a walk from vertex 0 stops at, which goes from each vertex to
    `to`; pointers double, so that the number of rounds grows with the logarithm of the walk's length."""
    stops = materialise(steps.where("ord = 0").select("shape_id", "ord"))
    hops = materialise(steps.select("shape_id", "ord", "to"))
    n = stops.count()
    while True:
        new = stops.join(hops, ["shape_id", "ord"]).select("shape_id", F.col("to").alias("ord"))
        stops = materialise(stops.unionAll(new).distinct())
        grown = stops.count()
        if grown == n:
            return stops.join(steps.select("shape_id", "ord"), ["shape_id", "ord"], "left_semi")
        n = grown
        onward = hops.select("shape_id", F.col("ord").alias("to"), F.col("to").alias("then"))
        hops = materialise(hops.join(onward, ["shape_id", "to"]).select("shape_id", "ord", F.col("then").alias("to")))


def joined_to_border(contour: DataFrame, border: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Cells (shape_id, x, y) that join a painted outline to the object's border.

    Every vertex looks for the nearest border cell of its own column and row. The nearer one, the column's
    where both are as near, is joined by a straight line if it lies within 6; where neither does, the walk
    goes on only after as many further vertices as the nearer one is away. A border cell that is one of
    `extra`, the cells that the border has beyond its base, is first pushed on through them, away from the
    vertex. Where the walk changes between columns and rows, the whole box around both vertices and their
    border cells is taken."""
    vertices = contour.select("shape_id", "ord", F.col("x").alias("qx"), F.col("y").alias("qy"))
    asked = vertices.select("shape_id", "qx", "qy").distinct()
    for line in "yx":  # along y: in the same column
        near = T.nearest_on_line(border, asked, line).select("shape_id", "qx", "qy", F.struct("x", "y").alias(f"at_{line}"), F.col("distance").alias(f"d_{line}"))
        vertices = vertices.join(near, ["shape_id", "qx", "qy"], "left")
    both = F.least("d_x", "d_y")
    vertices = vertices.withColumn("near", F.coalesce(both <= JOIN_REACH, F.lit(False)))
    skip = F.when(F.col("near"), 1).otherwise(F.coalesce(both.cast("int") + 2, F.lit(1)))
    vertices = materialise(vertices.withColumn("to", F.col("ord") + skip))
    column = F.coalesce(F.col("d_y") <= F.col("d_x"), F.col("d_x").isNull())
    seen = vertices.where("near").join(reached(vertices), ["shape_id", "ord"], "left_semi")
    seen = seen.withColumn("column", column).withColumn("at", F.when(F.col("column"), F.col("at_y")).otherwise(F.col("at_x")))
    seen = seen.select("shape_id", "ord", F.col("qx").alias("x"), F.col("qy").alias("y"), "column", F.col("at.x").alias("bx"), F.col("at.y").alias("by"))
    if extra is not None:
        pushed = materialise(seen)
        for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            starts = pushed.select("shape_id", F.col("bx").alias("x"), F.col("by").alias("y")).distinct()
            ends = T.probe(extra, starts, dx, dy).select("shape_id", F.col("x").alias("bx"), F.col("y").alias("by"), "end_x", "end_y")
            ways = (F.signum(F.col("bx") - F.col("x")) == dx) & ~F.col("column") if dx else (F.signum(F.col("by") - F.col("y")) == dy) & F.col("column")
            moved = pushed.join(ends, ["shape_id", "bx", "by"], "left").withColumn("moves", F.coalesce(ways & F.col("end_x").isNotNull(), F.lit(False)))
            pushed = moved.select("shape_id", "ord", "x", "y", "column", *[F.when(F.col("moves"), F.col(f"end_{c}")).otherwise(F.col(f"b{c}")).alias(f"b{c}") for c in "xy"])
        seen = pushed
    w = Window.partitionBy("shape_id").orderBy("ord")
    turns = F.coalesce(F.lag("column").over(w) != F.col("column"), F.lit(False))
    before = [F.when(turns, F.lag(c).over(w)) for c in ("x", "bx", "y", "by")]
    boxes = seen.withColumns(dict(zip(("px", "pbx", "py", "pby"), before)))
    low = lambda *cs: F.least(*cs)
    boxes = boxes.select(
        "shape_id",
        low("x", "bx", "px", "pbx").alias("x0"), F.greatest("x", "bx", "px", "pbx").alias("x1"),
        low("y", "by", "py", "pby").alias("y0"), F.greatest("y", "by", "py", "pby").alias("y1"),
    )
    columns = boxes.withColumn("x", F.explode(F.sequence("x0", "x1")))
    return T.from_runs(T.merge_runs(columns.select("shape_id", "x", F.col("y0").alias("y_lo"), F.col("y1").alias("y_hi"))))


def paint_merge_fill(base: DataFrame, pixels: DataFrame, sample: DataFrame, dist: float = 2.0, border: DataFrame | None = None, selection: DataFrame | None = None) -> DataFrame:
    """Copies each frame's painted part to its place on the base.

    The base's object is what is black around a given border (shape_id, x, y), or its largest black group; a
    frame's object is the black group nearest to that. Pixels in the sample's colour regions, inside the
    object's outline and inside the selection (frame_id, x, y, width, height) if there is one, are the paint;
    its holes are filled and its outline is joined to the object. Paint and joins keep the frame's colours
    and move so that the objects' first column and row fall together. Frames without paint change nothing."""
    # Both are read several times, and colours of what a query has just aggregated make code too large to compile.
    base, pixels = (materialise(p.select(*KEY, "argb")) for p in (base, pixels))
    black = lambda p: _hsv_points(p, is_black(F.col("s"), F.col("v")))
    ground = black(base)
    root = materialise(G.largest_group(G.group_points(ground, OBJECT_GAP)) if border is None else G.derive_group(ground, border, OBJECT_GAP))
    groups = materialise(G.group_points(black(pixels), dist))
    object_ = materialise(groups.join(G.nearest_group(groups, root).select("shape_id", "label"), ["shape_id", "label"], "left_semi").select(POINT))
    contour = materialise(object_outline(object_, dist))
    regions = CM.sample_regions(with_hsv(sample), 2)
    painted = _chosen(FI.in_hue_region(with_hsv(pixels), regions), selection).select(F.col("frame_id").alias("shape_id"), "x", "y")
    painted = materialise(K.in_contour(painted, contour).where("inside").select(POINT))
    painted = materialise(G.fill_enclosed(painted))
    extra = materialise(object_.join(root, POINT, "left_anti"))
    joins = joined_to_border(materialise(K.trace(painted)), object_, extra)
    cells = _chosen(_framed(painted.unionAll(joins)).distinct(), selection).withColumnRenamed("frame_id", "shape_id")
    inside = materialise(K.in_contour(cells, contour).where("inside").select(POINT))
    colored = inside.select(F.col("shape_id").alias("frame_id"), "x", "y").join(pixels.select(*KEY, "argb"), KEY)
    low = lambda d, name: d.groupBy(F.col("shape_id").alias("frame_id")).agg(F.min("x").alias(f"{name}x"), F.min("y").alias(f"{name}y"))
    moved = colored.join(low(object_, "s"), "frame_id").join(low(root, "b"), "frame_id")
    new = moved.select("frame_id", *[(F.col(c) + F.col(f"b{c}") - F.col(f"s{c}")).alias(c) for c in "xy"], F.col("argb").alias("new"))
    return base.join(new, KEY, "left").select(*KEY, F.coalesce("new", "argb").alias("argb"))


def _chosen(cells: DataFrame, selection: DataFrame | None) -> DataFrame:
    """Rows (frame_id, x, y, ...) inside their frame's selected rectangle."""
    if selection is None:
        return cells
    s = selection.select("frame_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"))
    both = cells.join(s, "frame_id").where("x >= x0 and x < x1 and y >= y0 and y < y1")
    return both.drop("x0", "y0", "x1", "y1")


def auto_ink(pencil: DataFrame, inked: DataFrame, dist: float = 2.0, least: float | None = CO.LEAST_SIMILARITY, settings: CO.RenderSettings = CO.RenderSettings()) -> tuple[DataFrame, DataFrame]:
    """Compares the largest groups of dark cells of two scans per frame, and renders the pencil's in the
    ink's manner: (comparison, rendered grays). Each scan is registered once."""
    drawings, looks = _drawn_looks(pencil, inked, dist)
    return CO.compare_appearances(*looks, least), CO.generate(pencil, inked, settings, looks=looks, drawings=drawings)


def compare_drawings(pencil: DataFrame, inked: DataFrame, dist: float = 2.0, least: float | None = CO.LEAST_SIMILARITY) -> DataFrame:
    """The comparison of `auto_ink` by itself; nothing is rendered for it."""
    return CO.compare_appearances(*_drawn_looks(pencil, inked, dist)[1], least)


def _drawn_looks(pencil: DataFrame, inked: DataFrame, dist: float) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """The largest groups of dark cells of two scans, and the looks of the scans registered by them."""
    drawings = tuple(_largest_dark(s, dist) for s in (pencil, inked))
    return drawings, tuple(materialise(CO.registered_looks(s, drawing=d)) for s, d in zip((pencil, inked), drawings))


def _largest_dark(scan: DataFrame, dist: float) -> DataFrame:
    """The largest group (shape_id, x, y) of each scan's cells at or above its threshold."""
    return materialise(G.largest_group(G.group_points(CO.core_of(scan, CO.otsu(scan, CO.NOISE)), dist)))
