"""Blend modes, layer folding, masks and brush coverage. Integer arithmetic throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.color import channel, pack_argb, unpack_argb, with_alpha
from rasterloom.operators.points import from_runs, stamp_runs, to_runs

MODES = ("NORMAL", "MULTIPLY", "SCREEN", "OVERLAY", "DARKEN", "LIGHTEN", "ADD", "SUBTRACT", "DIFFERENCE")


def div255_round(v: Column) -> Column:
    """v / 255 to the nearest."""
    w = v + 128
    return F.shiftright(w + F.shiftright(w, 8), 8)


def div255(v: Column) -> Column:
    """(v + v / 256 + 1) / 256 in whole numbers; with + 127 beforehand the rounding of layer folding."""
    return F.shiftright(v + F.shiftright(v, 8) + 1, 8)


def blend_channel(mode: str, b: Column, s: Column) -> Column:
    """One channel of backdrop b under source s."""
    rest = lambda c: 255 - c
    screen = rest(div255_round(rest(b) * rest(s)))
    table = {
        "NORMAL": s,
        "MULTIPLY": div255_round(b * s),
        "SCREEN": screen,
        "OVERLAY": F.when(b <= 127, F.least(F.lit(255), div255_round(2 * b * s))).otherwise(rest(div255_round(2 * rest(b) * rest(s)))),
        "DARKEN": F.least(b, s),
        "LIGHTEN": F.greatest(b, s),
        "ADD": F.least(F.lit(255), b + s),
        "SUBTRACT": F.greatest(F.lit(0), b - s),
        "DIFFERENCE": F.abs(b - s),
    }
    if mode not in table:
        raise ValueError(f"unknown blend mode {mode}")
    return table[mode]


def composite_channels(b: Column, s: Column, mode: str | Column) -> Column:
    """Alpha-aware composite of structs a, r, g, b; `mode` may be a column of mode names."""
    ba, sa = b["a"], s["a"]

    def blended(c: str) -> Column:
        if isinstance(mode, str):
            return blend_channel(mode, b[c], s[c])
        out = F.when(mode == MODES[0], blend_channel(MODES[0], b[c], s[c]))
        for m in MODES[1:]:
            out = out.when(mode == m, blend_channel(m, b[c], s[c]))
        return out

    weight = sa * 255 + ba * (255 - sa)

    def channel_of(c: str) -> Column:
        mix = blended(c)
        solid = div255_round((255 - ba) * s[c] + ba * mix)
        # At most 3 * 255 ** 3, inside 32 bits.
        top = sa * (255 - ba) * s[c] + sa * ba * mix + ba * (255 - sa) * b[c]
        soft = F.floor((top + F.shiftright(weight, 1)) / F.greatest(weight, F.lit(1))).cast("int")
        return F.when(sa == 0, b[c]).when(ba == 0, s[c]).when(sa == 255, solid).otherwise(soft).alias(c)

    alpha = F.when(sa == 0, ba).when(ba == 0, sa).when(sa == 255, F.lit(255)).otherwise(div255_round(weight))
    return F.struct(alpha.alias("a"), channel_of("r"), channel_of("g"), channel_of("b"))


def pack(c: Column) -> Column:
    return pack_argb(c["a"], c["r"], c["g"], c["b"])


def composite(backdrop: Column, source: Column, mode: str | Column) -> Column:
    """The same of packed colours. One-element arrays bind the unpacked structs, so that they are
    computed once."""
    pair = F.array(F.struct(unpack_argb(backdrop).alias("b"), unpack_argb(source).alias("s")))
    mixed = F.get(F.transform(pair, lambda p: composite_channels(p["b"], p["s"], mode)), 0)
    packed = F.get(F.transform(F.array(mixed), pack), 0)
    return F.when(channel(source, 24) == 0, backdrop).when(channel(backdrop, 24) == 0, source).otherwise(packed)


def composite_modes(pairs: DataFrame, backdrop: str, source: str, modes: tuple[str, ...]) -> DataFrame:
    """One column per mode, in lower case, of two columns of packed colours. Colours are unpacked in a
    projection of their own, so all modes share them and the arithmetic stays in generated code."""
    names = [m.lower() for m in modes]
    apart = pairs.select("*", unpack_argb(F.col(backdrop)).alias("__b"), unpack_argb(F.col(source)).alias("__s"))
    mixed = apart.select("*", *[composite_channels(F.col("__b"), F.col("__s"), m).alias(f"__{n}") for m, n in zip(modes, names)])
    b, s = F.col("__b.a"), F.col("__s.a")
    done = [F.when(s == 0, F.col(backdrop)).when(b == 0, F.col(source)).otherwise(pack(F.col(f"__{n}"))).alias(n) for n in names]
    return mixed.select(*pairs.columns, *done)


def place(layer_pixels: DataFrame, layers: DataFrame, width: int, height: int) -> DataFrame:
    """Visible layer pixels shifted by their layer's offset, clipped to the canvas, opacity applied.

    `layers` is (doc_id, z, offset_x, offset_y, opacity, visible, blend, clipped)."""
    on = layer_pixels.join(layers.where("visible"), ["doc_id", "z"])
    moved = on.withColumns({"x": F.col("x") + F.col("offset_x"), "y": F.col("y") + F.col("offset_y")})
    inside = moved.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    opacity = F.floor(F.col("opacity") * 255 + 0.5).cast("int")
    a = channel(F.col("argb"), 24)
    faded = F.when(opacity == 255, F.col("argb")).otherwise(with_alpha(F.col("argb"), div255(a * opacity + 127)))
    return inside.withColumn("argb", faded).select("doc_id", "z", "x", "y", "argb", "blend", "clipped")


def mask_alpha(masks: DataFrame) -> DataFrame:
    """Largest alpha of a layer's masks (doc_id, z, mask_no, x, y, alpha) per pixel."""
    return masks.groupBy("doc_id", "z", "x", "y").agg(F.max("alpha").alias("mask"))


def apply_masks(placed: DataFrame, masks: DataFrame) -> DataFrame:
    """Multiplies alpha by the mask stack; layers with masks vanish where no mask covers them."""
    stacked = mask_alpha(masks)
    has = masks.select("doc_id", "z").distinct().withColumn("masked", F.lit(True))
    a = channel(F.col("argb"), 24)
    m = F.when(F.col("masked").isNull(), F.col("argb")).otherwise(
        with_alpha(F.col("argb"), div255(a * F.coalesce("mask", F.lit(0)) + 127))
    )
    joined = placed.join(has, ["doc_id", "z"], "left").join(stacked, ["doc_id", "z", "x", "y"], "left")
    return joined.withColumn("argb", m).drop("mask", "masked")


def clip_bases(layers: DataFrame) -> DataFrame:
    """Adds `base`, the z of the last unclipped layer below a clipped one (null for others)."""
    w = Window.partitionBy("doc_id").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    base = F.last(F.when(~F.col("clipped"), F.col("z")), True).over(w)
    return layers.withColumn("base", F.when(F.col("clipped"), base))


def clip_to_base(placed: DataFrame, layers: DataFrame) -> DataFrame:
    """Limits runs of clipped layers to the alpha of the layer they rest on."""
    bases = clip_bases(layers).select("doc_id", "z", "base")
    under = placed.select("doc_id", F.col("z").alias("base"), "x", "y", channel(F.col("argb"), 24).alias("under"))
    both = placed.join(bases, ["doc_id", "z"]).join(under, ["doc_id", "base", "x", "y"], "left")
    a = channel(F.col("argb"), 24)
    clipped = with_alpha(F.col("argb"), div255(a * F.coalesce("under", F.lit(0))))
    return both.withColumn("argb", F.when(F.col("base").isNull(), F.col("argb")).otherwise(clipped)).drop("base", "under")


def flatten(placed: DataFrame) -> DataFrame:
    """Folds the layers of every pixel bottom-up: one shuffle on (doc_id, x, y), then an ordered array
    fold, as only a pixel's few layers meet."""
    stack = F.array_sort(F.collect_list(F.struct("z", unpack_argb(F.col("argb")).alias("c"), "blend")))
    none = F.struct(*[F.lit(0).alias(n) for n in "argb"])
    folded = F.aggregate("stack", none, lambda acc, l: composite_channels(acc, l["c"], l["blend"]))
    stacked = placed.groupBy("doc_id", "x", "y").agg(stack.alias("stack"))
    return stacked.select("doc_id", "x", "y", folded.alias("c")).select("doc_id", "x", "y", pack(F.col("c")).alias("argb"))


def mask_from_layer(layer_pixels: DataFrame, source_z: int, dx: int, dy: int) -> DataFrame:
    """Another layer's alpha as a mask, shifted."""
    return layer_pixels.where(F.col("z") == source_z).select("doc_id", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), channel(F.col("argb"), 24).alias("alpha"))


def mask_from_selection(cells: DataFrame, selected: DataFrame) -> DataFrame:
    """255 on selected cells, else 0; cells and selection are (shape_id, x, y)."""
    hit = selected.select("shape_id", "x", "y").distinct().withColumn("hit", F.lit(255))
    return cells.join(hit, ["shape_id", "x", "y"], "left").select("shape_id", "x", "y", F.coalesce("hit", F.lit(0)).alias("alpha"))


def constant_mask(cells: DataFrame, alpha: int) -> DataFrame:
    """Reveal all (255) or hide all (0)."""
    return cells.select("shape_id", "x", "y", F.lit(alpha).alias("alpha"))


def invert_mask(mask: DataFrame) -> DataFrame:
    return mask.withColumn("alpha", 255 - F.col("alpha"))


def renumber(layers: DataFrame) -> DataFrame:
    """z from 0 without gaps, in the old order."""
    w = Window.partitionBy("doc_id").orderBy("z", "tie")
    tied = layers if "tie" in layers.columns else layers.withColumn("tie", F.lit(0))
    return tied.withColumn("z", F.row_number().over(w) - 1).drop("tie")


def insert_layer(layers: DataFrame, new: DataFrame, at: int) -> DataFrame:
    """Layers with a new one per document at a position."""
    shifted = layers.withColumn("z", F.when(F.col("z") >= at, F.col("z") + 1).otherwise(F.col("z")))
    return shifted.unionByName(new.withColumn("z", F.lit(at)))


def duplicate_layer(layers: DataFrame, at: int) -> DataFrame:
    return insert_layer(layers, layers.where(F.col("z") == at), at + 1)


def remove_layer(layers: DataFrame, at: int) -> DataFrame:
    return renumber(layers.where(F.col("z") != at))


def move_layer(layers: DataFrame, source: int, target: int) -> DataFrame:
    """The layer at `source` comes to lie at `target`."""
    z = F.col("z")
    between = z.between(min(source, target), max(source, target))
    step = -1 if target > source else 1
    return layers.withColumn("z", F.when(z == source, target).when(between, z + step).otherwise(z))


def merge_range(placed: DataFrame, low: int, high: int) -> DataFrame:
    """Layers low..high folded into one normal layer at `low`; those above move down."""
    inside = F.col("z").between(low, high)
    merged = flatten(placed.where(inside)).select("doc_id", F.lit(low).alias("z"), "x", "y", "argb", F.lit("NORMAL").alias("blend"), F.lit(False).alias("clipped"))
    z = F.when(F.col("z") > high, F.col("z") - (high - low)).otherwise(F.col("z"))
    return placed.where(~inside).withColumn("z", z).select("doc_id", "z", "x", "y", "argb", "blend", "clipped").unionByName(merged)


class Brush:
    """Soft elliptic dab: thickness in pixels, the others shares of 1 but for the angle in degrees."""

    def __init__(self, color: int, thickness: float, hardness=1.0, opacity=1.0, flow=1.0, spacing=0.25, roundness=1.0, angle=0.0, blend="NORMAL"):
        for name, v, low, high in (
            ("thickness", thickness, 0, 10_000), ("hardness", hardness, 0, 1), ("opacity", opacity, 0, 1), ("flow", flow, 0, 1),
            ("spacing", spacing, 0, 10), ("roundness", roundness, 0, 1),
        ):
            if not low <= v <= high or name in ("thickness", "spacing", "roundness") and v == 0:
                raise ValueError(f"{name} out of range: {v}")
        if blend not in MODES:
            raise ValueError(f"unknown blend mode {blend}")
        self.color, self.thickness, self.hardness, self.opacity = color, thickness, hardness, opacity
        self.flow, self.spacing, self.roundness, self.angle, self.blend = flow, spacing, roundness, angle, blend

    def dab(self) -> list[tuple[int, int, float]]:
        """(dx, dy, alpha) of one dab, centre at a pixel."""
        import math

        r, out = self.thickness / 2, []
        cos, sin = math.cos(math.radians(self.angle)), math.sin(math.radians(self.angle))
        for dy in range(-math.ceil(r), math.ceil(r) + 1):
            for dx in range(-math.ceil(r), math.ceil(r) + 1):
                u, v = dx * cos + dy * sin, (dy * cos - dx * sin) / self.roundness
                d = math.hypot(u, v) / r
                if d <= 1:
                    soft = 1.0 if d <= self.hardness or self.hardness == 1 else (1 - d) / (1 - self.hardness)
                    if soft > 0:
                        out.append((dx, dy, soft * self.flow))
        return out


def stamp_points(points: DataFrame, brush: Brush) -> DataFrame:
    """(shape_id, x, y, coverage) of one dab per point: 1 - product of (1 - alpha). A dab that is opaque throughout
    covers wholly what it covers at all: runs are stamped, and no dab is listed."""
    if all(a == 1 for _, _, a in brush.dab()):
        columns: dict[int, list[int]] = {}
        for x, y, _ in brush.dab():
            columns.setdefault(x, []).append(y)
        # A dab is an ellipse, whose columns have no gaps.
        runs = stamp_runs(to_runs(points), [(x, min(ys), max(ys)) for x, ys in columns.items()])
        return from_runs(runs).withColumn("coverage", F.lit(1.0))
    table = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(a).alias("a")) for x, y, a in brush.dab()])
    dabs = points.select("shape_id", "x", "y", F.explode(table).alias("d"))
    at = dabs.select("shape_id", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), F.col("d.a").alias("a"))
    return at.groupBy("shape_id", "x", "y").agg((1 - F.product(1 - F.col("a"))).alias("coverage"))


def paint_coverage(pixels: DataFrame, coverage: DataFrame, brush: Brush) -> DataFrame:
    """Pixels (frame_id, x, y, argb) under the brush colour with the coverage as alpha."""
    cov = coverage.select(F.col("shape_id").alias("frame_id"), "x", "y", "coverage")
    a = F.floor(F.col("coverage") * brush.opacity * channel(F.lit(brush.color), 24) + 0.5).cast("int")
    source = with_alpha(F.lit(brush.color), a)
    out = F.when(F.col("coverage").isNull(), F.col("argb")).otherwise(composite(F.col("argb"), source, brush.blend))
    return pixels.join(cov, ["frame_id", "x", "y"], "left").select("frame_id", "x", "y", out.alias("argb"))
