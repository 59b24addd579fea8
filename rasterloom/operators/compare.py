"""Scan comparison: thresholds, registration, shape and border measures over darkness values.

A scan is (frame_id, x, y, value) with darkness in 0..1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions import numeric as N
from rasterloom.functions.numeric import ratio_similarity

KEY = ["frame_id", "x", "y"]
#: Registration grid, margin and reach of the border probe (fixed values).
GRID, MARGIN, PROBE = 256, 20, 12
NOISE, PEAK_SHARE = 0.012, 0.22


def histogram(scan: DataFrame, floor: float = 0.0) -> DataFrame:
    """(frame_id, bin, n) over 256 bins of values from the floor on."""
    kept = scan.where(F.col("value") >= floor)
    b = F.floor(F.greatest(F.least(F.col("value"), F.lit(1.0)), F.lit(0.0)) * 255 + 0.5).cast("int")
    return kept.groupBy("frame_id", b.alias("bin")).agg(F.count("*").alias("n"))


def otsu(scan: DataFrame, floor: float) -> DataFrame:
    """Threshold per frame with the best variance between classes; the floor for an empty frame."""
    return _otsu_of(histogram(scan, floor), scan.select("frame_id").distinct(), floor)


def _otsu_of(h: DataFrame, frames: DataFrame, floor: float) -> DataFrame:
    """The same from histograms (frame_id, bin, n) of what lies above the floor."""
    low = max(1, math.ceil(floor * 255))
    total = h.groupBy("frame_id").agg(F.sum("n").alias("count"), F.sum(F.col("bin") * F.col("n")).alias("moment"))
    w = Window.partitionBy("frame_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = h.where(F.col("bin") >= low).withColumns({"bn": F.sum("n").over(w), "bm": F.sum(F.col("bin") * F.col("n")).over(w)})
    both = run.join(total, "frame_id").withColumn("fn", F.col("count") - F.col("bn")).where("fn > 0")
    d = F.col("bm") / F.col("bn") - (F.col("moment") - F.col("bm")) / F.col("fn")
    v = F.col("bn").cast("double") * F.col("fn") * d * d
    best = both.groupBy("frame_id").agg(F.min(F.struct((-F.round(v, 6)).alias("v"), "bin")).alias("b"))
    both = frames.join(total, "frame_id", "left").join(best, "frame_id", "left")
    return both.select("frame_id", F.when(F.col("count").isNull(), F.lit(floor)).otherwise(F.coalesce("b.bin", F.lit(low)) / 255).alias("threshold"))


def visible_bounds(scan: DataFrame, threshold: float) -> DataFrame:
    seen = scan.where(F.col("value") > threshold)
    return seen.groupBy("frame_id").agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])


def _gathered(scan: DataFrame) -> DataFrame:
    """(frame_id, width, height, at, cells): one row per frame with its cells' places, row by row from (0, 0), and
    darkness."""
    every = scan.groupBy("frame_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.collect_list(F.struct("x", "y", "value")).alias("c"))
    at = F.transform("c", lambda c: c["y"].cast("long") * F.col("width") + c["x"])
    return every.select("frame_id", "width", "height", at.alias("at"), F.transform("c", lambda c: c["value"].cast("double")).alias("cells"))


def _laid(at: np.ndarray, cells: np.ndarray, width: int, height: int) -> np.ndarray:
    """Row-major image of a frame's cells, 0 where it has none."""
    out = np.zeros(width * height)
    out[np.asarray(at, np.int64)] = cells
    return out


def raster(scan: DataFrame) -> DataFrame:
    """(frame_id, width, height, values): one row per frame with its darkness from (0, 0), row by row; cells
    that the scan leaves out are 0. A row is as large as its image."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        values = [_laid(*r) for r in zip(rows["at"], rows["cells"], rows["width"], rows["height"])]
        return rows[["frame_id", "width", "height"]].assign(values=values)

    return _in_blocks(_gathered(scan), work, _schema(scan, "width int, height int, values array<double>"), lambda r: int(r["width"]) * int(r["height"]))


#: Cells of a block of images that a task holds as arrays and hands on at once.
BLOCK = 1 << 20


def _schema(scan: DataFrame, rest: str) -> str:
    return f"frame_id {scan.schema['frame_id'].dataType.simpleString()}, {rest}"


def _in_blocks(rows: DataFrame, work, schema: str, cells) -> DataFrame:
    """The rows as `work` turns them, taken in blocks of BLOCK `cells` (a function of a row), or of one row where it
    has more. Batches are limited by rows and by bytes that come in, not by what comes of them."""

    def run(batches):
        for batch in batches:
            n = np.cumsum([cells(r) for r in batch.to_dict("records")], dtype=np.int64)
            start = 0
            while start < len(batch):
                end = max(start + 1, int(np.searchsorted(n, (n[start - 1] if start else 0) + BLOCK, "right")))
                yield work(batch.iloc[start:end])
                start = end

    # A frame is much work and few bytes: tasks are as many as the session's, not as few as bytes would make them.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "frame_id").mapInPandas(run, schema)


def _bounds(scan: DataFrame) -> DataFrame:
    """Bounds per frame of what is dark enough against the frame's peak, as width and height too."""
    peak = scan.groupBy("frame_id").agg(F.max("value").alias("peak"))
    seen = scan.join(peak, "frame_id").where(F.col("value") >= F.greatest(F.lit(NOISE), F.col("peak") * PEAK_SHARE))
    b = seen.groupBy("frame_id").agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    return b.withColumns({"b_width": F.col("x_max") - F.col("x_min") + 1, "b_height": F.col("y_max") - F.col("y_min") + 1})


def _marks(rasters: DataFrame, drawing: DataFrame) -> DataFrame:
    """(frame_id, at): places of a drawing's points (shape_id, x, y) inside the image, row by row."""
    inside = drawing.select(F.col("shape_id").alias("frame_id"), "x", "y").join(rasters.select("frame_id", "width", "height"), "frame_id")
    inside = inside.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height")))
    return inside.groupBy("frame_id").agg(F.collect_set(F.col("y") * F.col("width") + F.col("x")).alias("at"))


def _with_mask(rasters: DataFrame, drawing: DataFrame) -> DataFrame:
    """Adds `mask`, row-major booleans of a drawing's points (shape_id, x, y) inside the image."""
    return rasters.join(_marks(rasters, drawing), "frame_id").withColumn("mask", _marked("at", F.size("values"))).drop("at")


def register_rasters(scan: DataFrame, size: int = GRID, margin: int = MARGIN, drawing: DataFrame | None = None) -> DataFrame:
    """(frame_id, width, height, values, scale): scans drawn to one square grid, visible bounds scaled
    uniformly and centred, bilinear between pixel centres, 0 outside the image. Frames without anything
    visible are left out. With a drawing (points), its bounds count, and `core` marks the cells that have
    one of its points among their four corners."""
    marked = drawing is not None

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        drawn = [_drawn(r, size) for r in rows.to_dict("records")]
        out = pd.DataFrame({"frame_id": rows["frame_id"].to_numpy(), "width": size, "height": size, "values": [v for v, _ in drawn], "scale": rows["scale"].to_numpy()})
        return out.assign(core=[c for _, c in drawn]) if marked else out

    core = "" if drawing is None else ", core array<boolean>"
    return _in_blocks(_placed(scan, size, margin, drawing), work, _schema(scan, f"width int, height int, values array<double>, scale double{core}"), lambda _: size * size)


def _placed(scan: DataFrame, size: int, margin: int, drawing: DataFrame | None) -> DataFrame:
    """The gathered scans with the scale and the start (u0, v0) of the grid they are drawn to, and with the places
    `marked` of a drawing's points inside the image."""
    r = _gathered(scan)
    if drawing is None:
        b = _bounds(scan)
    else:
        b = drawing.groupBy(F.col("shape_id").alias("frame_id")).agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
        b = b.withColumns({"b_width": F.col("x_max") - F.col("x_min") + 1, "b_height": F.col("y_max") - F.col("y_min") + 1})
        r = r.join(_marks(r, drawing).withColumnRenamed("at", "marked"), "frame_id")
    r = r.join(b, "frame_id").withColumn("scale", F.lit(float(size - 2 * margin)) / F.greatest("b_width", "b_height"))
    start = lambda low, extent: F.col(low) - 0.5 + (0.5 - (F.lit(float(size)) - F.col(extent) * F.col("scale")) * 0.5) / F.col("scale")
    r = r.withColumns({"u0": start("x_min", "b_width"), "v0": start("y_min", "b_height")})
    return r.select("frame_id", "width", "height", "at", "cells", "scale", "u0", "v0", *([] if drawing is None else ["marked"]))


def _drawn(row: dict, size: int) -> tuple[np.ndarray, np.ndarray | None]:
    """A placed scan on its grid, and the cells of its core if a drawing marks it."""
    place = (int(row["width"]), row["u0"], row["v0"], row["scale"], size)
    values = _resampled(_laid(row["at"], row["cells"], int(row["width"]), int(row["height"])), *place)
    if "marked" not in row:
        return values, None
    mask = np.zeros(int(row["width"]) * int(row["height"]), bool)
    mask[np.asarray(row["marked"], np.int64)] = True
    return values, _resampled_mask(mask, *place)


def register(scan: DataFrame, size: int = GRID, margin: int = MARGIN) -> DataFrame:
    """The registered scans as cells (frame_id, x, y, value)."""
    return cells_of(register_rasters(scan, size, margin))


def cells_of(rasters: DataFrame, col: str = "values", *carry: str) -> DataFrame:
    each = rasters.select("frame_id", "width", *carry, F.posexplode(col).alias("i", "value"))
    return each.select("frame_id", *carry, (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), "value")


def _resampled(flat: np.ndarray, w: int, u: float, v: float, step: float, n: int) -> np.ndarray:
    """A row-major image drawn to n x n cells, cell (i, j) at (u + i / step, v + j / step): bilinear between
    neighbours, 0 outside."""
    image, along = np.asarray(flat, np.float64).reshape(-1, w), np.arange(n) / step

    def axis(at: np.ndarray, extent: int):
        inside = (at >= 0) & (at <= extent - 1)
        low = np.clip(np.floor(at), 0, extent - 1).astype(int)
        return inside, low, np.minimum(low + 1, extent - 1), at - low

    in_x, x0, x1, tx = axis(u + along, w)
    in_y, y0, y1, ty = axis(v + along, len(image))
    rows = image[:, x0] + (image[:, x1] - image[:, x0]) * tx
    drawn = rows[y0] + (rows[y1] - rows[y0]) * ty[:, None]
    return np.where(in_y[:, None] & in_x, drawn, 0.0).ravel()


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _marked(at: pd.Series, size: pd.Series) -> pd.Series:
    """Booleans, true at the given places."""

    def one(places: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, bool)
        out[np.asarray(places, np.int64)] = True
        return out

    return pd.Series([one(a, n) for a, n in zip(at, size)])


def _resampled_mask(flat: np.ndarray, w: int, u: float, v: float, step: float, n: int) -> np.ndarray:
    """Cells of the grid with a true corner among the four image cells around them."""
    image = np.pad(np.asarray(flat, bool).reshape(-1, w), 1)
    near = image[:-1, :-1] | image[1:, :-1] | image[:-1, 1:] | image[1:, 1:]
    x, y = (np.floor(a + np.arange(n) / step).astype(int) + 1 for a in (u, v))
    inside = lambda at, extent: (at >= 0) & (at < extent)
    ok = inside(y, len(near))[:, None] & inside(x, near.shape[1])
    return (near[np.clip(y, 0, len(near) - 1)][:, np.clip(x, 0, near.shape[1] - 1)] & ok).ravel()


#: Distance where a mask has no true cell.
FAR = 1_000_000


def _field(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance (3 a step, 4 a diagonal) of every cell of a mask, or of a stack of masks, to the nearest
    true cell: a pass down and a pass up; along a row, steps are a running minimum."""
    high, w = mask.shape[-2:]
    # Where every distance fits in 16 bits, they take half of the time.
    kind, far = (np.int16, 16_000) if 4 * (high + w) < 16_000 else (np.int32, FAR)
    d = np.where(mask, kind(0), kind(far))
    slope = 3 * np.arange(w, dtype=kind)
    for rows, step in ((range(high), -1), (range(high - 1, -1, -1), 1)):
        for y in rows:
            row = d[..., y, :]
            if 0 <= y + step < high:
                near = d[..., y + step, :]
                row = np.minimum(row, near + 3)
                row[..., 1:] = np.minimum(row[..., 1:], near[..., :-1] + 4)
                row[..., :-1] = np.minimum(row[..., :-1], near[..., 1:] + 4)
            row = np.minimum.accumulate(row - slope, -1) + slope
            d[..., y, :] = np.minimum.accumulate((row + slope)[..., ::-1], -1)[..., ::-1] - slope
    return np.where(d < far, d.astype(np.int32), np.int32(FAR))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _chamfer_field(mask: pd.Series, width: pd.Series) -> pd.Series:
    """Distance of every cell of row-major masks to the nearest true cell."""
    return pd.Series([_field(np.asarray(m, bool).reshape(-1, int(w))).ravel() for m, w in zip(mask, width)])


@F.pandas_udf(T.DoubleType())
def _apart(a: pd.Series, b: pd.Series, size: pd.Series) -> pd.Series:
    """Mean distance, in steps, of each of two packed square cores from the other, both ways. Pairs on one grid are taken
    together, about BLOCK cells at a time."""

    def several(packed: list[bytes], n: int) -> list[float]:
        cells = np.unpackbits(np.stack([np.frombuffer(c, np.uint8) for c in packed]), axis=1, count=n * n)
        cores = cells.astype(bool).reshape(-1, n, n)
        far = _field(cores)
        return [(far[k + 1][cores[k]].mean() / 3 + far[k][cores[k + 1]].mean() / 3) / 2 for k in range(0, len(cores), 2)]

    out, sizes, start = [], size.tolist(), 0
    while start < len(sizes):
        n, end = int(sizes[start]), start + 1
        while end < len(sizes) and sizes[end] == n and (end + 1 - start) * 2 * n * n <= BLOCK:
            end += 1
        out += several([c for k in range(start, end) for c in (a.iat[k], b.iat[k])], n)
        start = end
    return pd.Series(out, dtype=float)


@F.pandas_udf(T.BinaryType())
def _packed(core: pd.Series) -> pd.Series:
    return pd.Series([np.packbits(np.asarray(c, bool)).tobytes() for c in core])


_MEASURES = T.StructType([
    T.StructField("distance", T.ArrayType(T.IntegerType())), T.StructField("area", T.LongType()), T.StructField("edges", T.LongType()),
    T.StructField("opacity", T.DoubleType()), T.StructField("deviation", T.DoubleType()), T.StructField("rings", T.ArrayType(T.DoubleType())),
])


def _measure(values: np.ndarray, mask: np.ndarray, far: np.ndarray, reach: int) -> tuple:
    """Of an image, its core and the distance from there: the core's area, outer edges, mean and deviation of
    darkness, and the mean darkness of each ring 1..reach around it (NaN: no cell)."""
    inside = values[mask]
    shared = (mask[:, 1:] & mask[:, :-1]).sum() + (mask[1:] & mask[:-1]).sum()
    ring = np.where(mask, 0, np.minimum(np.floor(far / 3 + 0.5), reach + 1)).astype(np.int64).ravel()
    n, dark = np.bincount(ring, minlength=reach + 2), np.bincount(ring, values.ravel(), reach + 2)
    with np.errstate(invalid="ignore"):
        means = (dark / n)[1 : reach + 1]
    some = len(inside) > 0
    return int(mask.sum()), int(4 * mask.sum() - 2 * shared), float(inside.mean()) if some else None, float(inside.std()) if some else None, means


def _measured(reach: int):
    """Function of (values, core, width): distance from the core, and its measures."""

    def one(values: np.ndarray, core: np.ndarray, w: int):
        v, mask = np.asarray(values, np.float64).reshape(-1, w), np.asarray(core, bool).reshape(-1, w)
        far = _field(mask)
        return far.ravel(), *_measure(v, mask, far, reach)

    @F.pandas_udf(_MEASURES)
    def run(values: pd.Series, core: pd.Series, width: pd.Series) -> pd.DataFrame:
        rows = [one(v, c, int(w)) for v, c, w in zip(values, core, width)]
        return pd.DataFrame(rows, columns=_MEASURES.fieldNames())

    return run


def _limit(values: np.ndarray) -> float:
    """Threshold of an image's core, from the noise on: `otsu` of one image."""
    h = np.bincount(np.floor(np.clip(values[values >= NOISE], 0, 1) * 255 + 0.5).astype(np.int64), minlength=256)
    low, bins = max(1, math.ceil(NOISE * 255)), np.arange(256)
    count, moment = int(h.sum()), int((h * bins).sum())
    bn, bm = np.cumsum(h[low:]), np.cumsum((h * bins)[low:])
    some = np.flatnonzero((h[low:] > 0) & (bn < count))
    if not len(some):
        return max(NOISE, low / 255 if count else NOISE)
    bn, bm, fn = bn[some], bm[some], count - bn[some]
    d = bm / bn - (moment - bm) / fn
    v = bn.astype(np.float64) * fn * d * d
    # Larger ones have no seventh decimal that tells.
    v = np.where(v < 1e9, np.round(v, 6), v)
    return max(NOISE, (low + int(some[v.argmax()])) / 255)


@F.pandas_udf(T.DoubleType())
def _limits(values: pd.Series) -> pd.Series:
    return pd.Series([_limit(np.asarray(v)) for v in values])


def appearances(rasters: DataFrame, reach: int = PROBE) -> DataFrame:
    """Adds to rasters: core (array of booleans, by threshold if not there), distance (chamfer distance from the core),
    area, thickness, opacity, pressure, profile (relative darkness by ring 0..reach around the core, made
    monotone from outside) and border (its score). Frames with under four core cells are left out."""
    if "core" not in rasters.columns:
        rasters = rasters.withColumn("limit", _limits("values")).withColumn("core", F.transform("values", lambda v: v >= F.col("limit"))).drop("limit")
    g = rasters.withColumn("m", _measured(reach)("values", "core", "width")).select("*", "m.*").drop("m")
    return _described(g, reach)


def registered_looks(scan: DataFrame, size: int = GRID, margin: int = MARGIN, drawing: DataFrame | None = None, reach: int = PROBE) -> DataFrame:
    """The appearances of a scan's registered rasters, without rasters: only `bits`, the core's cells packed eight to
    a byte, tells its shape. A frame is drawn, measured and dropped in one task, a block at a time."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        drawn = [_drawn(r, size) for r in rows.to_dict("records")]
        cores = np.stack([v >= _limit(v) if c is None else c for v, c in drawn])
        images, masks = np.stack([v for v, _ in drawn]).reshape(-1, size, size), cores.reshape(-1, size, size)
        measures = [_measure(v, m, f, reach) for v, m, f in zip(images, masks, _field(masks))]
        out = pd.DataFrame(measures, columns=["area", "edges", "opacity", "deviation", "rings"])
        return out.assign(frame_id=rows["frame_id"].to_numpy(), width=size, scale=rows["scale"].to_numpy(), bits=[np.packbits(c).tobytes() for c in cores])

    schema = _schema(scan, "area long, edges long, opacity double, deviation double, rings array<double>, width int, scale double, bits binary")
    return _described(_in_blocks(_placed(scan, size, margin, drawing), work, schema, lambda _: size * size), reach)


def _described(measured: DataFrame, reach: int) -> DataFrame:
    g = measured.where("area >= 4")
    relative = F.transform("rings", lambda r: F.when(~F.isnan(r), N.clamp01(r / F.col("opacity"))))
    g = g.withColumn("relative", relative)
    weight = F.array(*[F.lit(1.0 - k / reach) for k in range(reach)])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    score = F.try_divide(total(F.zip_with("relative", weight, lambda r, w: r * w)), total(F.zip_with("relative", weight, lambda r, w: F.when(r.isNotNull(), w))))
    outward = lambda k: F.array_max(F.concat(F.array(F.lit(0.0)), F.slice("relative", F.lit(k), F.lit(max(reach - k, 0)))))
    profile = F.array(F.lit(0.0), *[outward(k) for k in range(1, reach)], F.lit(0.0))
    return g.withColumns({
        "thickness": 2.0 * F.col("area") / F.col("edges"), "pressure": N.clamp01(F.col("deviation") / F.greatest("opacity", F.lit(1e-9))),
        "border": N.clamp01(F.coalesce(score, F.lit(0.0))), "profile": profile,
    }).drop("relative", "rings", "deviation")


def core_of(scan: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Cells (shape_id, x, y) at or above their frame's threshold."""
    return scan.join(thresholds, "frame_id").where("value >= threshold").select(F.col("frame_id").alias("shape_id"), "x", "y")


def measure(scan: DataFrame, core: DataFrame) -> DataFrame:
    """Area, boundary edges, thickness, mean opacity and its variation per core."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    lent = core.select("shape_id", "x", "y", F.explode(steps).alias("s")).select("shape_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    inner = lent.join(core, ["shape_id", "x", "y"], "left_semi").groupBy("shape_id").agg(F.count("*").alias("inner"))
    v = core.join(scan.withColumnRenamed("frame_id", "shape_id"), ["shape_id", "x", "y"])
    g = v.groupBy("shape_id").agg(F.count("*").alias("area"), F.avg("value").alias("opacity"), F.stddev_pop("value").alias("pressure"))
    e = 4 * F.col("area") - F.coalesce("inner", F.lit(0))
    return g.join(inner, "shape_id", "left").select("shape_id", "area", e.alias("edges"), (2 * F.col("area") / e).alias("thickness"), "opacity", "pressure")


_LOOKS = ("thickness", "border", "opacity", "pressure")


def _pairs(a: DataFrame, b: DataFrame, *more: str) -> DataFrame:
    named = lambda d, n: d.select("frame_id", *[F.col(c).alias(f"{n}_{c}") for c in ("area", *_LOOKS, *more)])
    return named(a, "a").join(named(b, "b"), "frame_id")


def _paired_cores(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs with their cores, packed, and the side of their grid."""
    packed = lambda d: d if "bits" in d.columns else d.withColumn("bits", _packed("core"))
    return _pairs(packed(a), packed(b), "bits", "width")


def _with_shape(pairs: DataFrame, out: str) -> DataFrame:
    tolerance = F.greatest(F.lit(1.5), (F.col("a_thickness") + F.col("b_thickness")) * 0.75)
    # A pair is much work and few bytes, as a frame is in `_in_blocks`.
    dealt = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame_id")
    far = dealt.withColumn("far", _apart("a_bits", "b_bits", "a_width")).drop("a_bits", "b_bits")
    return far.withColumn(out, N.clamp01(F.exp(-F.col("far") / tolerance)))


def shape_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(frame_id, similarity) of two tables of appearances on one grid: exp of minus the mean distance of
    each core from the other, both ways, over a tolerance that grows with the strokes' thickness."""
    return _with_shape(_paired_cores(a, b), "similarity").select("frame_id", "similarity")


#: Shares of thickness, border and darkness in the likeness of two drawings; darkness is opacity and pressure.
LOOK_WEIGHTS = {"thickness": 1.0, "border": 1.5, "opacity": 1.0}
OPACITY_SHARE, LEAST_SIMILARITY = 0.65, 0.18


def _likeness(weights: dict[str, float]) -> Column:
    if not sum(weights.values()) > 0:
        raise ValueError("one weight must be positive")
    like = {k: ratio_similarity(F.col(f"a_{k}"), F.col(f"b_{k}")) for k in _LOOKS}
    like["opacity"] = like["opacity"] * OPACITY_SHARE + like["pressure"] * (1 - OPACITY_SHARE)
    score = sum((like[k] * w for k, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    return N.clamp01(score)


def _transfer() -> list[Column]:
    scale = lambda k: N.safe_ratio(F.col(f"b_{k}"), F.col(f"a_{k}")).alias(f"{k}_scale")
    return [*map(scale, _LOOKS), (F.col("b_border") - F.col("a_border")).alias("border_delta")]


def appearance_similarity(a: DataFrame, b: DataFrame, weights: dict[str, float] = LOOK_WEIGHTS) -> DataFrame:
    """(frame_id, similarity): weighted mean of the ratio similarities of thickness, border and darkness."""
    return _pairs(a, b).select("frame_id", _likeness(weights).alias("similarity"))


def transfer_profile(a: DataFrame, b: DataFrame) -> DataFrame:
    """What turns the looks of a into those of b: bounded ratios, and the difference of the borders."""
    return _pairs(a, b).select("frame_id", *_transfer())


def compare_appearances(a: DataFrame, b: DataFrame, least: float | None = LEAST_SIMILARITY) -> DataFrame:
    """frame_id, shape, appearance, overall and the transfer profile of two tables of appearances; an
    error where the shapes are less alike than `least` (None: never)."""
    both = _with_shape(_paired_cores(a, b), "shape").select("frame_id", "shape", _likeness(LOOK_WEIGHTS).alias("appearance"), *_transfer())
    if least is not None:
        checked = F.when(F.col("shape") >= least, F.col("shape")).otherwise(F.raise_error(F.lit("the scans do not show the same drawing")))
        both = both.withColumn("shape", checked)
    return both.withColumn("overall", F.col("shape") * F.col("appearance"))


def compare(a: DataFrame, b: DataFrame, least: float | None = LEAST_SIMILARITY, size: int = GRID, margin: int = MARGIN) -> DataFrame:
    """Registers two scans per frame and compares their shapes and looks."""
    return compare_appearances(registered_looks(a, size, margin), registered_looks(b, size, margin), least)


def source_stats(scan: DataFrame, core: DataFrame) -> DataFrame:
    """Mean and deviation of the core's darkness and its quantiles by 256-bin histogram."""
    v = scan.join(core.select(F.col("shape_id").alias("frame_id"), "x", "y"), KEY, "left_semi")
    h = histogram(v)
    w = Window.partitionBy("frame_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = h.withColumn("cum", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy("frame_id")))
    q = c.groupBy("frame_id").agg(*[(F.min(F.when(F.col("cum") >= p, F.col("bin"))) / 255).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)])
    return v.groupBy("frame_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation")).join(q, "frame_id")


def match_tones(source: DataFrame, target: DataFrame) -> DataFrame:
    """Histogram match: source values take the target's value at the same share, per frame, through
    256-row tables."""
    def cumulative(scan):
        w = Window.partitionBy("frame_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        return histogram(scan).withColumn("cum", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy("frame_id")), 12))

    s, t = cumulative(source).select("frame_id", "bin", "cum"), cumulative(target).select("frame_id", F.col("bin").alias("to"), F.col("cum").alias("has"))
    table = s.join(t, "frame_id").where("has >= cum").groupBy("frame_id", "bin").agg(F.min("to").alias("to"))
    b = F.floor(F.greatest(F.least(F.col("value"), F.lit(1.0)), F.lit(0.0)) * 255 + 0.5).cast("int")
    return source.withColumn("bin", b).join(table, ["frame_id", "bin"]).select(*KEY, (F.col("to") / 255).alias("value"))


@dataclass(frozen=True)
class RenderSettings:
    """How far thickness, border, opacity and pressure move from the pencil's to the ink's, 0 to 4 each."""

    thickness: float = 1.0
    border: float = 1.0
    opacity: float = 1.0
    pressure: float = 1.0

    def __post_init__(self):
        if not all(0 <= v <= 4 for v in (self.thickness, self.border, self.opacity, self.pressure)):
            raise ValueError("weights lie between 0 and 4")


def _source(scan: DataFrame, scales: DataFrame, drawing: DataFrame | None) -> DataFrame:
    """Rasters with core, scale to the registration grid, and the core's sorted 256-bin values and mean."""
    r = raster(scan).join(scales.select("frame_id", "scale"), "frame_id")
    if drawing is None:
        limits = otsu(scan, NOISE).select("frame_id", F.greatest("threshold", F.lit(NOISE)).alias("threshold"))
        r = r.join(limits, "frame_id").withColumn("core", F.transform("values", lambda v: v >= F.col("threshold"))).drop("threshold")
    else:
        r = _with_mask(r, drawing).withColumnRenamed("mask", "core")
    inside = F.array_compact(F.zip_with("values", "core", lambda v, c: F.when(c, v)))
    r = r.withColumn("inside", inside).where(F.size("inside") >= 4)
    bins = F.array_sort(F.transform("inside", lambda v: F.floor(N.clamp01(v) * 255 + 0.5).cast("int")))
    return r.withColumns({"bins": bins, "count": F.size("inside"), "mean": F.aggregate("inside", F.lit(0.0), lambda acc, v: acc + v) / F.size("inside")}).drop("inside")


def _quantile(bins: Column, share: Column | float) -> Column:
    """The sorted bins' value at a share, as darkness."""
    p = F.lit(share) if isinstance(share, float) else share
    return F.get(bins, (F.greatest(F.lit(1), F.ceil(N.clamp01(p) * F.size(bins))) - 1).cast("int")) / 255


def _closed(df: DataFrame, mask: str, radius: int | Column) -> DataFrame:
    """`mask` closed by chamfer distance."""
    radius = F.lit(radius) if isinstance(radius, int) else radius
    wide = df.withColumn("__d", _chamfer_field(F.col(mask), F.col("width"))).withColumn("__wide", F.transform("__d", lambda d: d <= 3 * radius))
    back = wide.withColumn("__b", _chamfer_field(F.transform("__wide", lambda v: ~v), F.col("width")))
    return back.withColumn(mask, F.zip_with("__wide", "__b", lambda v, d: v & (d > 3 * radius))).drop("__d", "__wide", "__b")


def _by_thickness(r: DataFrame, weight: float) -> DataFrame:
    """Adds `target`: the core grown or shrunk by half the difference of the thicknesses."""
    r = r.withColumn("grow", (F.col("b_thickness") - F.col("a_thickness")) * 0.5 * weight / F.col("scale"))
    r = r.withColumns({"to": _chamfer_field(F.col("core"), F.col("width")), "back": _chamfer_field(F.transform("core", lambda c: ~c), F.col("width"))})
    wider, thinner = F.zip_with("core", "to", lambda c, d: c | (d / 3 <= F.col("grow"))), F.zip_with("core", "back", lambda c, d: c & (d / 3 > -F.col("grow")))
    return r.withColumn("target", F.when(F.col("grow") >= 0, wider).otherwise(thinner)).drop("to", "back", "grow")


def _by_centre_line(r: DataFrame, weight: float) -> DataFrame:
    """Adds `target`: what lies within half the wanted thickness of the closed core's centre line; the
    closing bridges gaps of three quarters of the stroke, six pixels at most."""
    from rasterloom.operators.points import thin

    thick = F.col("a_thickness") / F.col("scale")
    radius = F.greatest(F.lit(1), F.least(F.lit(6), F.ceil(thick * 0.75))).cast("int")
    solid = _closed(r.select("frame_id", "width", F.col("core").alias("solid"), radius.alias("radius")), "solid", F.col("radius"))
    line = thin(cells_of(solid, "solid").where("value").select(F.col("frame_id").alias("shape_id"), "x", "y"))
    wanted = F.greatest(F.lit(0.75), F.col("a_thickness") + (F.col("b_thickness") - F.col("a_thickness")) * weight)
    reach = F.greatest(F.lit(0.5), wanted * 0.5 / F.col("scale"))
    far = _with_mask(r, line).withColumn("to", _chamfer_field(F.col("mask"), F.col("width"))).drop("mask")
    return far.withColumn("reach", reach).withColumn("target", F.transform("to", lambda d: d / 3 <= F.col("reach"))).drop("to", "reach")


#: How far to each side of a vertex its direction is taken, between these bounds and by so many vertices a
#: contour; how far outside a vertex its sides are probed; how far inward a cell may lie (fixed values).
LEAST_WINDOW, MOST_WINDOW, VERTICES_PER_STEP, SIDE_PROBE, INWARD_SLACK = 2, 10, 300, 1.5, 0.25


def contour_frames(contour: DataFrame, core: DataFrame) -> DataFrame:
    """Contours with, at every vertex, tangent (tx, ty), outward normal (ox, oy), `step`, the mean distance of
    the vertices around, and `location`, the share of the perimeter before it.

    Of the two normals the one whose side is not of the core (shape_id, x, y) is outward; where both sides
    are alike, the one away from the contour's centre."""
    from rasterloom.operators import contours as K

    sized = contour.join(contour.groupBy("shape_id").agg(F.count("*").cast("int").alias("n")), "shape_id")
    window = N.bound((F.col("n") / VERTICES_PER_STEP).cast("int"), LEAST_WINDOW, MOST_WINDOW)
    sized = sized.withColumn("window", window)
    at = contour.select("shape_id", F.col("ord").alias("to"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    for name, way in (("p", -1), ("q", 1)):
        sized = sized.withColumn("to", F.pmod(F.col("ord") + way * F.col("window"), F.col("n")).cast("int")).join(at, ["shape_id", "to"]).withColumnsRenamed({"vx": f"{name}x", "vy": f"{name}y"}).drop("to")
    dx, dy = (F.col("qx") - F.col("px")).cast("double"), (F.col("qy") - F.col("py")).cast("double")
    length = F.hypot(dx, dy)
    flat = length <= 1e-8
    sized = sized.withColumns({"tx": F.when(flat, 1.0).otherwise(dx / length), "ty": F.when(flat, 0.0).otherwise(dy / length), "length": F.when(flat, 1.0).otherwise(length)})
    cell = lambda c: F.floor(c + 0.5).cast("int")
    marked = core.select("shape_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.lit(True).alias("in")).distinct()
    for name, side in (("first", 1), ("second", -1)):
        probes = {"sx": cell(F.col("x") - F.col("ty") * side * SIDE_PROBE), "sy": cell(F.col("y") + F.col("tx") * side * SIDE_PROBE)}
        sized = sized.withColumns(probes).join(marked, ["shape_id", "sx", "sy"], "left").withColumnRenamed("in", name).drop("sx", "sy")
    facts = K.attributes(contour).join(K.measures(contour).select("shape_id", "perimeter"), "shape_id")
    facts = facts.select("shape_id", "ord", "cx", "cy", F.coalesce(F.try_divide("arc", "perimeter"), F.lit(0.0)).alias("location"))
    sized = sized.join(facts, ["shape_id", "ord"])
    away = -F.col("ty") * (F.col("x") - F.col("cx")) + F.col("tx") * (F.col("y") - F.col("cy")) >= 0
    first, second = F.coalesce("first", F.lit(False)), F.coalesce("second", F.lit(False))
    turn = F.when(first != second, F.when(first, -1.0).otherwise(1.0)).otherwise(F.when(away, 1.0).otherwise(-1.0))
    return sized.select(
        "shape_id", "ord", "x", "y", "tx", "ty", (-F.col("ty") * turn).alias("ox"), (F.col("tx") * turn).alias("oy"),
        (F.col("length") / F.greatest(F.lit(1.0), F.col("window") * 2.0)).alias("step"), "location",
    )


def warp_halo(target: DataFrame, ink: DataFrame, strength: float = 1.0, reach: float = PROBE) -> DataFrame:
    """(frame_id, x, y, halo): what the ink's surroundings look like around another drawing.

    `target` has rows (frame_id, x, y, core, far) of the drawing's image, far its distance from the core in
    units of the registration grid, and `ink` those of the ink's image with its darkness `value`. A cell
    outside the core, within reach, goes with its nearest contour vertex; its offset is told along that
    vertex's outward normal and tangent. The ink's vertex at the same share of its contour, with the offset
    turned into its own directions, normals by the drawings' extents and tangents by the distances of
    vertices, names the place that is read, between cells, if it is outside the ink's core and within reach
    too. Cells inside the contour, and drawings that leave no contour, have no halo."""
    from rasterloom.operators import contours as K
    from rasterloom.operators.pixels import bilinear_sample
    from rasterloom.operators.points import nearest
    from rasterloom.sources.tables import materialise

    def described(image: DataFrame) -> tuple[DataFrame, DataFrame]:
        core = materialise(image.where("core").select(F.col("frame_id").alias("shape_id"), "x", "y"))
        bounds = core.groupBy("shape_id").agg(*[(F.max(c) - F.min(c) + 1.0).alias(n) for c, n in (("x", "wide"), ("y", "high"))])
        contour = materialise(K.trace(core))
        return contour, materialise(contour_frames(contour, core).join(bounds, "shape_id"))

    contour, frames = described(target)
    i_contour, i_frames = described(ink)
    cells = target.where(~F.col("core") & (F.col("far") <= reach)).select(F.col("frame_id").alias("shape_id"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    near = nearest(contour.select("shape_id", "x", "y"), materialise(cells)).select("shape_id", "qx", "qy", "x", "y")
    # A cell that the contour passes more than once counts as its last vertex.
    own = contour.groupBy("shape_id", "x", "y").agg(F.max("ord").alias("ord"))
    at = near.join(own, ["shape_id", "x", "y"]).drop("x", "y").join(frames, ["shape_id", "ord"])
    dx, dy = F.col("qx") - F.col("x"), F.col("qy") - F.col("y")
    at = at.withColumns({"out": dx * F.col("ox") + dy * F.col("oy"), "on": dx * F.col("tx") + dy * F.col("ty")}).where(F.col("out") >= -INWARD_SLACK)
    unit = lambda p: F.hypot(F.col(f"{p}ox") / F.col(f"{p}wide"), F.col(f"{p}oy") / F.col(f"{p}high"))
    at = materialise(at.select("shape_id", "qx", "qy", "location", "on", "step", F.greatest(F.lit(0.0), "out").alias("out"), unit("").alias("unit")))
    shares = K.at_arc(i_contour, at.select("shape_id", F.col("location").alias("share")).distinct()).select("shape_id", F.col("share").alias("location"), "ord")
    there = i_frames.select("shape_id", "ord", *[F.col(c).alias(f"i_{c}") for c in ("x", "y", "tx", "ty", "ox", "oy", "step", "wide", "high")])
    both = at.join(shares, ["shape_id", "location"]).join(there, ["shape_id", "ord"])
    out = F.col("out") * F.col("unit") / F.greatest(unit("i_"), F.lit(1e-9))
    on = F.col("on") * F.col("i_step") / F.greatest("step", F.lit(1e-9))
    place = {c: F.col(f"i_{c}") + F.col(f"i_o{c}") * out + F.col(f"i_t{c}") * on for c in "xy"}
    both = both.select(F.col("shape_id").alias("frame_id"), "qx", "qy", place["x"].alias("u"), place["y"].alias("v"))
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    outside = ink.where(~F.col("core") & (F.col("far") <= reach)).select("frame_id", "x", "y")
    both = materialise(both.withColumns({"x": whole("u"), "y": whole("v")}).join(outside, KEY, "left_semi"))
    read = bilinear_sample(ink.select(*KEY, "value"), both.select("frame_id", F.struct("qx", "qy").alias("cid"), "u", "v"))
    return read.select("frame_id", F.col("cid.qx").alias("x"), F.col("cid.qy").alias("y"), N.clamp01(F.col("value") * strength).alias("halo"))


def _told_cells(rasters: DataFrame) -> DataFrame:
    """Cells (frame_id, x, y, core, far, value) of rasters; far is in units of the registration grid."""
    cols = [c for c in ("values", "core", "far") if c in rasters.columns]
    each = rasters.select("frame_id", "width", "scale", F.posexplode(F.arrays_zip(*cols)).alias("i", "c"))
    value = [F.col("c.values").alias("value")] if "values" in cols else []
    return each.select("frame_id", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), "c.core", (F.col("c.far") / 3 * F.col("scale")).alias("far"), *value)


def generate(pencil: DataFrame, ink: DataFrame, settings: RenderSettings = RenderSettings(), looks: tuple[DataFrame, DataFrame] | None = None, drawings: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The pencil drawing in the ink's manner: (frame_id, x, y, gray), 255 white.

    Without drawings the pencil's core grows or shrinks by half the difference of the two thicknesses,
    measured on the registration grid; with them (points of both, the cores), strokes are drawn anew around
    their centre line. The result is closed by one pixel. Inside, tones go by equal share of the cores'
    histograms and are scaled to the ink's black point; outside, the halo follows the ink's border profile,
    or, with drawings, is what lies around the ink at the same share of its contour (`warp_halo`). `looks` are the appearances of both, if they are known."""
    from rasterloom.sources.tables import materialise

    own, other = drawings or (None, None)
    a, b = looks or tuple(materialise(registered_looks(s, drawing=d).drop("bits")) for s, d in ((pencil, own), (ink, other)))
    looks_ = _pairs(a, b).join(b.select("frame_id", "profile"), "frame_id").select("frame_id", "a_thickness", "b_thickness", "profile")
    s = _source(pencil, a, own)
    whole_ink = _source(ink, b, other)
    i = whole_ink.select("frame_id", F.col("bins").alias("i_bins"), F.col("mean").alias("i_mean"))
    r = materialise(s.join(i, "frame_id").join(looks_, "frame_id"))
    shaped = _by_thickness(r, settings.thickness) if drawings is None else _by_centre_line(r, settings.thickness)
    r = _closed(shaped, "target", 1)
    r = r.withColumn("far", _chamfer_field(F.col("target"), F.col("width")))
    lerp = lambda x, y, t: x + (y - x) * t
    black = {n: lerp(_quantile(F.col("bins"), 0.9), _quantile(F.col("i_bins"), 0.9), t) for n, t in (("now", settings.pressure), ("wanted", settings.opacity))}
    share_of = lambda k: F.size(F.filter("bins", lambda v: v <= k)) / F.col("count")
    tones = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: _quantile(F.col("i_bins"), share_of(k)))
    r = r.withColumns({
        "boost": black["wanted"] / F.greatest(black["now"], F.lit(1e-8)),
        "middle": _quantile(F.col("bins"), 0.5),
        "floor": N.clamp01(lerp(_quantile(F.col("bins"), 0.5), _quantile(F.col("i_bins"), 0.5), settings.opacity)),
        "body": N.clamp01(lerp(F.col("mean"), F.col("i_mean"), settings.opacity)),
        "tones": tones,
    })
    r = materialise(r.drop("bins", "i_bins"))
    facts = ("width", "boost", "middle", "floor", "body", "scale")
    each = r.select("frame_id", *facts, F.posexplode(F.arrays_zip("values", "core", "target", "far")).alias("i", "c"))
    each = each.join(r.select("frame_id", "tones", "profile"), "frame_id")
    tone = F.when(F.col("c.core"), F.col("c.values")).otherwise(F.col("middle"))
    inked = F.get("tones", F.floor(N.clamp01(tone) * 255 + 0.5).cast("int"))
    drawn = F.greatest(F.col("floor"), N.clamp01(lerp(tone, inked, settings.pressure) * F.col("boost")))
    d = F.col("c.far") / 3 * F.col("scale")
    low = F.floor(d).cast("int")
    ring = F.when(d < 0.5, 0.0).when(d <= 1, F.get("profile", F.lit(1))).when(d >= PROBE, 0.0).otherwise(lerp(F.get("profile", low), F.get("profile", F.least(low + 1, F.lit(PROBE))), d - low))
    halo = F.col("body") * N.clamp01(ring * settings.border)
    if drawings is not None:
        fields = whole_ink.select("frame_id", "width", "scale", "values", "core", _chamfer_field(F.col("core"), F.col("width")).alias("far"))
        target = r.select("frame_id", "width", "scale", F.col("target").alias("core"), "far")
        warped = warp_halo(_told_cells(target), _told_cells(fields), settings.border)
        each = each.withColumns({"x": (F.col("i") % F.col("width")), "y": F.floor(F.col("i") / F.col("width")).cast("int")}).join(warped, KEY, "left")
        halo = F.coalesce("halo", F.lit(0.0))
    gray = F.floor(255 * (1 - F.when(F.col("c.target"), drawn).otherwise(halo)) + 0.5).cast("int")
    return each.select("frame_id", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), gray.alias("gray"))
