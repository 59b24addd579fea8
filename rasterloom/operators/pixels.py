"""Pixel filters and raster transforms over rows (frame_id, x, y, argb).

Frame sizes come as a table `frames` (frame_id, width, height) or as numbers. Transforms send every pixel
to the target cells that show it, so that nothing but the frames' sizes is joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.color import channel, clamp8, pack_argb, unpack_argb, with_alpha

KEY = ["frame_id", "x", "y"]


def frame_sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("frame_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def grid(frames: DataFrame) -> DataFrame:
    """All cells of every frame of (frame_id, width, height, ...)."""
    row = frames.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    return row.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))


def opacity(argb: Column, f: float) -> Column:
    f = max(0.0, min(1.0, f))
    return with_alpha(argb, F.floor(channel(argb, 24) * f + 0.5).cast("int"))


def gray_level(argb: Column) -> Column:
    c = unpack_argb(argb)
    return clamp8(c["r"] * 0.299 + c["g"] * 0.587 + c["b"] * 0.114)


def grayscale(argb: Column) -> Column:
    g = gray_level(argb)
    return pack_argb(channel(argb, 24), g, g, g)


def invert(argb: Column) -> Column:
    c = unpack_argb(argb)
    return pack_argb(c["a"], 255 - c["r"], 255 - c["g"], 255 - c["b"])


def threshold(argb: Column, t: int) -> Column:
    v = F.when(gray_level(argb) >= max(0, min(255, t)), 255).otherwise(0)
    return pack_argb(channel(argb, 24), v, v, v)


def brightness_contrast(argb: Column, brightness: float, contrast: float) -> Column:
    c = unpack_argb(argb)
    f = lambda v: clamp8((v - 127.5) * max(0.0, contrast) + 127.5 + brightness)
    return pack_argb(c["a"], f(c["r"]), f(c["g"]), f(c["b"]))


def alpha_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Alpha times the mask's (frame_id, x, y, mask) over 255, truncated; 0 outside the mask."""
    a = channel(F.col("argb"), 24)
    new = with_alpha(F.col("argb"), F.floor(a * F.coalesce("mask", F.lit(0)) / 255).cast("int"))
    return pixels.join(mask, KEY, "left").select(*KEY, new.alias("argb"))


def box_kernel(r: int) -> list[list[float]]:
    n = 2 * r + 1
    return [[1.0 / (n * n)] * n for _ in range(n)]


def gaussian_kernel(r: int) -> list[list[float]]:
    s2 = 2.0 * max(1.0, r / 2.0) ** 2
    raw = [[math.exp(-(x * x + y * y) / s2) for x in range(-r, r + 1)] for y in range(-r, r + 1)]
    total = sum(map(sum, raw))
    return [[v / total for v in row] for row in raw]


#: Sharpening kernel (fixed values).
SHARPEN = [[0.0, -1.0, 0.0], [-1.0, 5.0, -1.0], [0.0, -1.0, 0.0]]


def convolve(pixels: DataFrame, frames: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """Square kernel over all four channels with clamped edges.

    Every pixel is sent to the targets that sample it: to its neighbours, and from an edge also to the
    targets whose samples beyond the edge are clamped to it. One shuffle on the target key with
    map-side sums."""
    r = len(kernel) // 2
    taps = [(x - r, y - r, kernel[y][x]) for y in range(len(kernel)) for x in range(len(kernel)) if kernel[y][x]]
    table = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for dx, dy, w in taps])
    sized = pixels.join(frames.select("frame_id", "width", "height"), "frame_id").where("x >= 0 and y >= 0 and x < width and y < height")

    def targets(at: str, step: str, extent: str) -> Column:
        """The targets whose sample at a step from them is clamped to this place."""
        last, there = F.col(extent) - 1, F.col(at) - F.col(step)
        low = F.greatest(F.when(F.col(at) == 0, 0).otherwise(there), F.lit(0))
        high = F.least(F.when(F.col(at) == last, last).otherwise(there), last)
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    sent = sized.select("frame_id", "x", "y", "width", "height", unpack_argb(F.col("argb")).alias("c"), F.explode(table).alias("k"))
    sent = sent.withColumn("ty", targets("y", "k.dy", "height")).withColumn("tx", targets("x", "k.dx", "width"))
    sums = sent.groupBy("frame_id", F.col("tx").alias("x"), F.col("ty").alias("y")).agg(*[F.round(F.sum(F.col(f"c.{n}") * F.col("k.w")), 9).alias(n) for n in "argb"])
    return sums.select(*KEY, pack_argb(*[clamp8(F.col(n)) for n in "argb"]).alias("argb"))


def fill(frames: DataFrame, color: int) -> DataFrame:
    return grid(frames).select(*KEY, F.lit(color).alias("argb"))


def _sent(pixels: DataFrame, frames: DataFrame, across: tuple[Column, Column, Column], down: tuple[Column, Column, Column], shown) -> DataFrame:
    """Every pixel in the target cells that show it. `frames` has the target's (width, height) and further facts;
    `across` and `down` are the target's extent, the first place that may show the pixel, and the last;
    `shown(x, y)` tells whether a target cell shows it."""

    def targets(extent: Column, first: Column, last: Column) -> Column:
        low, high = F.greatest(F.floor(first) - 1, F.lit(0)), F.least(F.ceil(last) + 1, extent.cast("long") - 1)
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    sized = pixels.select("frame_id", F.col("x").alias("px"), F.col("y").alias("py"), "argb").join(frames, "frame_id")
    sent = sized.withColumn("x", targets(*across)).withColumn("y", targets(*down)).where(shown(F.col("x"), F.col("y")))
    return sent.select("frame_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "argb")


def _beyond(at: Column, source: Column, target: Column, last: Column) -> Column:
    """The last target place that may show a source place: the end of the target from the source's last one on."""
    return F.when(at >= source - 1, target).otherwise(last)


def upscale(pixels: DataFrame, frames: DataFrame, percent: float) -> DataFrame:
    """Nearest neighbour."""
    if percent <= 0:
        raise ValueError("the percentage must be positive")
    k = percent / 100.0
    size = lambda n: F.floor(F.col(n) * k + 0.5).cast("int")
    big = frames.select("frame_id", F.col("width").alias("w"), F.col("height").alias("h"), size("width").alias("width"), size("height").alias("height"))
    src = lambda v, n: F.least((v / k).cast("int"), F.col(n) - 1)
    reach = lambda p, n, extent: (F.col(extent), F.col(p) * k, _beyond(F.col(p), F.col(n), F.col(extent), (F.col(p) + 1) * k))
    return _sent(pixels, big, reach("px", "w", "width"), reach("py", "h", "height"), lambda x, y: (src(x, "w") == F.col("px")) & (src(y, "h") == F.col("py")))


def rotate_quarter(pixels: DataFrame, frames: DataFrame, turns: int) -> DataFrame:
    """Clockwise quarter turns (1, 2 or 3)."""
    both = pixels.join(frames.select("frame_id", "width", "height"), "frame_id")
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    new = {1: (h - 1 - y, x), 2: (w - 1 - x, h - 1 - y), 3: (y, w - 1 - x)}[turns % 4] if turns % 4 else (x, y)
    return both.select("frame_id", new[0].alias("x"), new[1].alias("y"), "argb")


MINI_PERCENT, MINI_WIDTH, MINI_HEIGHT = 10, 320, 240


def mini_sizes(frames: DataFrame) -> DataFrame:
    size = lambda n, low: F.greatest(F.lit(low), F.floor(F.col(n) * MINI_PERCENT / 100 + 0.5).cast("int"))
    return frames.select("frame_id", F.col("width").alias("w"), F.col("height").alias("h"), size("width", MINI_WIDTH).alias("width"), size("height", MINI_HEIGHT).alias("height"))


def _centre(v: Column, small: Column, size: Column) -> Column:
    return F.least(size - 1, ((v + 0.5) * size / small).cast("int"))


def mini_image(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Tenth-size copy, at least 320 x 240, sampled at the centres of its cells."""
    # A cell's centre lies half a cell on.
    reach = lambda p, n, extent: (F.col(extent), F.col(p) * F.col(extent) / F.col(n) - 0.5, _beyond(F.col(p), F.col(n), F.col(extent), (F.col(p) + 1) * F.col(extent) / F.col(n) - 0.5))
    shown = lambda x, y: (_centre(x, F.col("width"), F.col("w")) == F.col("px")) & (_centre(y, F.col("height"), F.col("h")) == F.col("py"))
    return _sent(pixels, mini_sizes(frames), reach("px", "w", "width"), reach("py", "h", "height"), shown)


def mini_blocks(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pixels (frame_id, x, y, ...) with the columns of their frame's `sizes` (as `mini_sizes` gives them) and the block
    x0 to x1, y0 to y1 of mini cells that show them; pixels that no cell shows are left out."""
    first = lambda p, n, extent: F.expr(f"cast((2L * {extent} * ({p}) + {n} - 1) div (2 * {n}) as int)")
    ends = {f"{c}{i}": first(f"{c} + {i}", n, extent) - i for c, n, extent in (("x", "w", "width"), ("y", "h", "height")) for i in (0, 1)}
    inside = pixels.join(sizes, "frame_id").where("x >= 0 and y >= 0 and x < w and y < h")
    return inside.withColumns(ends).where("x0 <= x1 and y0 <= y1")


def mini_to_image(points: DataFrame, frames: DataFrame, *carry: str) -> DataFrame:
    """Mini-image points (frame_id, x, y) in image coordinates, with the columns to carry."""
    both = points.join(mini_sizes(frames), "frame_id")
    return both.select("frame_id", *carry, _centre(F.col("x"), F.col("width"), F.col("w")).alias("x"), _centre(F.col("y"), F.col("height"), F.col("h")).alias("y"))


def fit_plan(frames: DataFrame, width: int, height: int) -> DataFrame:
    """How each frame reaches the reference size: none, rotate, scale or rotate_scale, with the factor;
    an error for a frame that cannot."""
    w, h = F.col("width"), F.col("height")
    near = lambda a, b: F.abs(a - b) < 1e-9
    s0, s90 = F.lit(width) / w, F.lit(width) / h
    straight, turned = near(s0, F.lit(height) / h), near(s90, F.lit(height) / w)
    same = (w == width) & (h == height)
    plan = (
        F.when(same, "none").when(turned & near(s90, F.lit(1.0)), "rotate").when(straight & near(s0, F.lit(1.0)), "none")
        .when(turned, "rotate_scale").when(straight, "scale")
        .otherwise(F.raise_error(F.concat(F.lit("frame does not fit the reference: "), F.col("frame_id").cast("string"))))
    )
    return frames.withColumn("plan", plan).withColumn("factor", F.when(F.col("plan").isin("rotate", "rotate_scale"), s90).otherwise(s0))


def fit_to_reference(pixels: DataFrame, frames: DataFrame, width: int, height: int) -> DataFrame:
    """Frames turned and scaled to the reference size, all in one pass over the target cells."""
    plan = fit_plan(frames, width, height).select("frame_id", F.col("width").alias("w"), F.col("height").alias("h"), "plan", "factor")
    turn = F.col("plan").isin("rotate", "rotate_scale")
    tw, th = F.when(turn, F.col("h")).otherwise(F.col("w")), F.when(turn, F.col("w")).otherwise(F.col("h"))
    # The pixel's place in the turned frame.
    ux, uy = F.when(turn, F.col("h") - 1 - F.col("py")).otherwise(F.col("px")), F.when(turn, F.col("px")).otherwise(F.col("py"))
    src = lambda v, n: F.least((v / F.col("factor")).cast("int"), n - 1)
    reach = lambda u, n, extent: (F.lit(extent), u * F.col("factor"), _beyond(u, n, F.lit(extent), (u + 1) * F.col("factor")))
    return _sent(pixels, plan, reach(ux, tw, width), reach(uy, th, height), lambda x, y: (src(x, tw) == ux) & (src(y, th) == uy))


def copy_rect(target: DataFrame, source: DataFrame, rect: tuple[int, int, int, int], to: tuple[int, int]) -> DataFrame:
    """Copies a rectangle (x, y, width, height) of the source to a place in the target, clipped to both."""
    x, y, w, h = rect
    part = source.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    part = part.select("frame_id", (F.col("x") - x + to[0]).alias("x"), (F.col("y") - y + to[1]).alias("y"), F.col("argb").alias("new"))
    return target.join(part, KEY, "left").select(*KEY, F.coalesce("new", "argb").alias("argb"))


def copy_row(target: DataFrame, source: DataFrame, y: int) -> DataFrame:
    return copy_rect(target, source, (0, y, 1 << 30, 1), (0, y))


def copy_column(target: DataFrame, source: DataFrame, x: int) -> DataFrame:
    return copy_rect(target, source, (x, 0, 1, 1 << 30), (x, 0))


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    inside = pixels.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return inside.select("frame_id", (F.col("x") - x).alias("x"), (F.col("y") - y).alias("y"), "argb")


def replace_pixels(target: DataFrame, source: DataFrame, points: DataFrame) -> DataFrame:
    """Target with the source's colours at the given points (frame_id, x, y)."""
    new = source.join(points.select(KEY).distinct(), KEY, "left_semi").select(*KEY, F.col("argb").alias("new"))
    return target.join(new, KEY, "left").select(*KEY, F.coalesce("new", "argb").alias("argb"))


def bilinear_sample(values: DataFrame, coords: DataFrame) -> DataFrame:
    """Values (frame_id, x, y, value) sampled at coords (frame_id, cid, u, v); 0 outside."""
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    at = coords.select("*", F.floor("u").alias("fu"), F.floor("v").alias("fv"), F.explode(corners).alias("k"))
    tu, tv = F.col("u") - F.col("fu"), F.col("v") - F.col("fv")
    w = F.when(F.col("k.i") == 1, tu).otherwise(1 - tu) * F.when(F.col("k.j") == 1, tv).otherwise(1 - tv)
    at = at.select("frame_id", "cid", (F.col("fu") + F.col("k.i")).cast("int").alias("x"), (F.col("fv") + F.col("k.j")).cast("int").alias("y"), w.alias("w"))
    hit = at.hint("merge").join(values, KEY, "left")
    return hit.groupBy("frame_id", "cid").agg(F.sum(F.coalesce("value", F.lit(0.0)) * F.col("w")).alias("value"))


def local_colors(points: DataFrame, pixels: DataFrame) -> DataFrame:
    return points.join(pixels, KEY)


def place_specimen(regions: DataFrame, specimen: tuple[int, int], most_tiles: int = 10) -> DataFrame:
    """How a specimen covers each region (region_id, width, height): centre, scale or tile.

    It is copied to the centre when it covers the region, scaled when more than `most_tiles` copies
    would be needed, and tiled otherwise; `factor` is the scale."""
    w, h = specimen
    cols, rows = F.ceil(F.col("width") / w), F.ceil(F.col("height") / h)
    fits = (F.col("width") <= w) & (F.col("height") <= h)
    ratio = F.greatest(F.col("width") / w, F.col("height") / h)
    how = F.when(fits, "centre").when(cols * rows > most_tiles, "scale").otherwise("tile")
    return regions.withColumns({"how": how, "tiles": (cols * rows).cast("int"), "factor": F.when(how == "scale", ratio).otherwise(F.lit(1.0))})


#: What a newly covered cell earns, and what cells of the region cost under a tile's edge and around its
#: corners (fixed values).
NEW_CELL, EDGE_CELL, CORNER_CELL, CORNER_REACH = 4096, 256, 8192, 2


def adaptive_tiles(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Greedy cover of each region (region_id, x, y) by width x height tiles: (region_id, tile, x, y).

    Every step covers the first cell, by row and column, that is still bare. A tile over it may start where
    it is centred on the cell, on the cell's unbroken row or column, or on the region, or where one of its
    edges meets one of these. It earns newly covered cells and pays for cells of the region under its edges
    and around its corners, where seams show, and for its distance from the centre of the cell's row and
    column; the first of equal tiles is taken. The order of steps decides, so a region is one pandas group;
    the group holds its bounding box."""
    import pandas as pd

    def cover(region: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x0, y0 = int(region["x"].min()), int(region["y"].min())
        inside = np.zeros((int(region["y"].max()) - y0 + 1, int(region["x"].max()) - x0 + 1), bool)
        inside[region["y"] - y0, region["x"] - x0] = True
        bare, out = inside.copy(), []
        # As lists: single numbers are read, many times.
        sums = np.pad(inside.cumsum(0, dtype=np.int64).cumsum(1), ((1, 0), (1, 0))).tolist()
        high, wide = inside.shape

        def count(x: int, y: int, w: int, h: int) -> int:
            """Cells of the region in a rectangle."""
            a, b = min(max(x, 0), wide), min(max(x + w, 0), wide)
            upper, lower = sums[min(max(y, 0), high)], sums[min(max(y + h, 0), high)]
            return lower[b] - upper[b] - lower[a] + upper[a]

        def unbroken(line: np.ndarray, at: int) -> tuple[int, int]:
            """First and last place of the run of cells around one."""
            gaps = np.flatnonzero(~line)
            i = int(np.searchsorted(gaps, at))
            return (int(gaps[i - 1]) + 1 if i else 0), (int(gaps[i]) - 1 if i < len(gaps) else len(line) - 1)

        def starts(at: int, run: tuple[int, int], extent: int, size: int) -> list[int]:
            centred = lambda a, b: (a + b - size + 1) // 2
            tried = [
                centred(*run), centred(0, extent - 1), at - size // 2, run[0], run[1] - size + 1,
                0, extent - size, at, at - size + 1,
            ]
            return [s for s in dict.fromkeys(tried) if s <= at < s + size]

        r = 2 * CORNER_REACH + 1
        for y in range(high):
            while (left := np.flatnonzero(bare[y])).size:
                x = int(left[0])
                across, down = unbroken(inside[y], x), unbroken(inside[:, x], y)
                ideal = (across[0] + across[1] - width + 1) // 2, (down[0] + down[1] - height + 1) // 2

                def worth(tx: int, ty: int) -> int:
                    new = int(bare[max(ty, 0) : ty + height, max(tx, 0) : tx + width].sum())  # noqa: B023
                    edge = count(tx, ty, width, height) - count(tx + 1, ty + 1, max(width - 2, 0), max(height - 2, 0))
                    corners = sum(count(cx - CORNER_REACH, cy - CORNER_REACH, r, r) for cx in (tx, tx + width - 1) for cy in (ty, ty + height - 1))
                    return new * NEW_CELL - edge * EDGE_CELL - corners * CORNER_CELL - abs(tx - ideal[0]) - abs(ty - ideal[1])  # noqa: B023

                tx, ty = max(((a, b) for a in starts(x, across, wide, width) for b in starts(y, down, high, height)), key=lambda p: worth(*p))
                bare[max(ty, 0) : ty + height, max(tx, 0) : tx + width] = False
                out.append((region["region_id"].iat[0], len(out), tx + x0, ty + y0))
        return pd.DataFrame(out, columns=["region_id", "tile", "x", "y"])

    return cells.groupBy("region_id").applyInPandas(cover, "region_id long, tile int, x int, y int")
