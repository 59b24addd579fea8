"""Pixel-filter, transform and layer queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from rasterloom import views
from rasterloom.operators import layers as L
from rasterloom.operators import pixels as X
from rasterloom.operators import points as T
from rasterloom.operators import sets as S
from rasterloom.queries.scalars import pack_sql
from rasterloom.registry import query

c = F.col
A = f"WITH RECURSIVE {views.ARGB}, q AS (SELECT frame_id, x, y, a, r, g, b, {pack_sql('a', 'r', 'g', 'b')} AS argb FROM ar)"


def px(name, sql, fn):
    query(name, f"{A}{sql}")(lambda spark, sf: fn(views.argb(spark, sf)))


def _frames(p):
    return p.select("frame_id").distinct().select("frame_id", F.lit(64).alias("width"), F.lit(48).alias("height"))


def _map(f):
    return lambda p: p.withColumn("argb", f(c("argb")))


_G = "CAST(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5) AS INT)"
_BC = "CAST(floor(least(greatest(({0} - 127.5) * 1.5 + 127.5 + 10, 0), 255) + 0.5) AS INT)"
px("pix1_opacity", f" SELECT frame_id, x, y, {pack_sql('CAST(floor(a * 0.4 + 0.5) AS INT)', 'r', 'g', 'b')} AS argb FROM q", _map(lambda v: X.opacity(v, 0.4)))
px("pix2_grayscale", f" SELECT frame_id, x, y, {pack_sql('a', _G, _G, _G)} AS argb FROM q", _map(X.grayscale))
px("pix2_invert", f" SELECT frame_id, x, y, {pack_sql('a', '255 - r', '255 - g', '255 - b')} AS argb FROM q", _map(X.invert))
px("pix2_threshold", f" SELECT frame_id, x, y, {pack_sql('a', *[f'(CASE WHEN {_G} >= 120 THEN 255 ELSE 0 END)'] * 3)} AS argb FROM q", _map(lambda v: X.threshold(v, 120)))
px("pix2_brightness_contrast", f" SELECT frame_id, x, y, {pack_sql('a', *[_BC.format(k) for k in 'rgb'])} AS argb FROM q", _map(lambda v: X.brightness_contrast(v, 10, 1.5)))
px("pix3_alpha_mask", f" SELECT frame_id, x, y, {pack_sql('CASE WHEN x < 40 THEN a * (x * 6) // 255 ELSE 0 END', 'r', 'g', 'b')} AS argb FROM q", lambda p: X.alpha_mask(p, p.where("x < 40").select("frame_id", "x", "y", (c("x") * 6).alias("mask"))))
_GRAY = f"WITH {views.GRAY}, g8 AS (SELECT frame_id, x, y, CAST(floor(value * 255 + 0.5) AS INT) AS v FROM gray)"


def _gray(spark, sf):
    from rasterloom.functions.color import pack_argb

    v = F.floor(c("value") * 255 + 0.5).cast("int")
    return views.gray(spark, sf).select("frame_id", "x", "y", pack_argb(F.lit(255), v, v, v).alias("argb"))


def _kernel(name, kernel):
    rows = ", ".join(f"({x - len(kernel) // 2}, {y - len(kernel) // 2}, {kernel[y][x]!r}::DOUBLE)" for y in range(len(kernel)) for x in range(len(kernel)))
    alpha = f"CAST(floor(least(greatest(round(255 * {sum(map(sum, kernel))!r}, 9), 0), 255) + 0.5) AS INT)"
    v = "CAST(floor(least(greatest(round(s, 9), 0), 255) + 0.5) AS INT)"
    sql = f"""{_GRAY}, k AS (SELECT * FROM (VALUES {rows}) t(dx, dy, w)),
 cv AS (SELECT a.frame_id, a.x, a.y, sum(b.v * w) AS s FROM g8 a, k JOIN g8 b ON a.frame_id = b.frame_id AND b.x = least(greatest(a.x + dx, 0), 7) AND b.y = least(greatest(a.y + dy, 0), 7) GROUP BY 1, 2, 3)
 SELECT frame_id, x, y, {pack_sql(alpha, v, v, v)} AS argb FROM cv"""

    def run(spark, sf):
        p = _gray(spark, sf)
        return X.convolve(p, p.select("frame_id").distinct().select("frame_id", F.lit(8).alias("width"), F.lit(8).alias("height")), kernel)

    query(name, sql)(run)


_kernel("pix4_sharpen", X.SHARPEN)
_kernel("pix5_box_blur", X.box_kernel(1))
_kernel("pix5_gaussian_blur", X.gaussian_kernel(2))
_CV = ", cv AS (SELECT frame_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT DISTINCT frame_id FROM q), range({0}) t(x), range({1}) u(y))"
px("pix6_fill", f"{_CV.format(64, 48)} SELECT *, -65536 AS argb FROM cv", lambda p: X.fill(_frames(p), -65536))
px("pix7_upscale", f"{_CV.format(96, 72)} SELECT cv.*, argb FROM cv JOIN q ON cv.frame_id = q.frame_id AND q.x = least(CAST(trunc(cv.x / 1.5) AS INT), 63) AND q.y = least(CAST(trunc(cv.y / 1.5) AS INT), 47)", lambda p: X.upscale(p, _frames(p), 150))
px("pix8_rotate90_cw", " SELECT frame_id, 47 - y AS x, x AS y, argb FROM q", lambda p: X.rotate_quarter(p, _frames(p), 1))
px("pix8_rotate90_ccw", " SELECT frame_id, y AS x, 63 - x AS y, argb FROM q", lambda p: X.rotate_quarter(p, _frames(p), 3))
px("pix8_rotate180", " SELECT frame_id, 63 - x AS x, 47 - y AS y, argb FROM q", lambda p: X.rotate_quarter(p, _frames(p), 2))
_MINI = "least({1} - 1, CAST(trunc((cv.{0} + 0.5) * {1} / {2}) AS INT))"
px("pix9_mini_image", f"{_CV.format(320, 240)} SELECT cv.frame_id, count(*) AS n, sum(CAST(argb AS BIGINT) * (cv.x + 1)) AS checksum FROM cv JOIN q ON cv.frame_id = q.frame_id AND q.x = {_MINI.format('x', 64, 320)} AND q.y = {_MINI.format('y', 48, 240)} GROUP BY 1", lambda p: X.mini_image(p, _frames(p)).groupBy("frame_id").agg(F.count("*").alias("n"), F.sum(c("argb").cast("long") * (c("x") + 1)).alias("checksum")))
px("pix9_mini_to_image", " SELECT frame_id, least(63, CAST(trunc((x * 5 + 0.5) * 64 / 320) AS INT)) AS x, least(47, CAST(trunc((y * 5 + 0.5) * 48 / 240) AS INT)) AS y FROM q", lambda p: X.mini_to_image(p.select("frame_id", (c("x") * 5).alias("x"), (c("y") * 5).alias("y")), _frames(p)))
px("pix10_fit_to_reference", f"{_CV.format(96, 128)} SELECT cv.*, argb FROM cv JOIN q ON cv.frame_id = q.frame_id AND q.x = CAST(trunc(cv.y / 2.0) AS INT) AND q.y = 47 - CAST(trunc(cv.x / 2.0) AS INT)", lambda p: X.fit_to_reference(p, _frames(p), 96, 128))
px("pix11_copy_rect", " SELECT t.frame_id, t.x, t.y, coalesce(s.argb, t.argb) AS argb FROM q t LEFT JOIN (SELECT frame_id, x + 15 AS x, y + 8 AS y, argb FROM q WHERE x BETWEEN 5 AND 34 AND y BETWEEN 4 AND 33) s USING (frame_id, x, y)", lambda p: X.copy_rect(p, p, (5, 4, 30, 30), (20, 12)))
px("pix12_crop", " SELECT frame_id, x - 10 AS x, y - 10 AS y, argb FROM q WHERE x BETWEEN 10 AND 29 AND y BETWEEN 10 AND 24", lambda p: X.crop(p, 10, 10, 20, 15))
px("pix13_replace_pixels", f" SELECT frame_id, x, y, CASE WHEN x < y THEN {pack_sql('a', '255 - r', '255 - g', '255 - b')} ELSE argb END AS argb FROM q", lambda p: X.replace_pixels(p, _map(X.invert)(p), p.where("x < y")))


@query("pix14_bilinear_sample", f"""WITH {views.GRAY}, co AS (SELECT frame_id, x + 8 * y AS cid, x * 0.9 + 0.35 AS u, y * 1.1 - 0.25 AS v FROM gray),
 k AS (SELECT co.*, floor(u) + i AS sx, floor(v) + j AS sy, (CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN j = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM co, range(2) t(i), range(2) s(j))
 SELECT k.frame_id, cid, round(sum(coalesce(value, 0) * w), 6) + 0.0 AS value FROM k LEFT JOIN gray ON gray.frame_id = k.frame_id AND gray.x = sx AND gray.y = sy GROUP BY 1, 2""")
def _(spark, sf):
    g = views.gray(spark, sf)
    co = g.select("frame_id", (c("x") + 8 * c("y")).alias("cid"), (c("x") * 0.9 + 0.35).alias("u"), (c("y") * 1.1 - 0.25).alias("v"))
    return X.bilinear_sample(g, co).withColumn("value", F.round("value", 6) + 0.0)


px("pix15_local_colors", " SELECT frame_id, x, y, argb FROM q WHERE x % 5 = 0", lambda p: X.local_colors(p.where("x % 5 = 0").select("frame_id", "x", "y"), p))


@query("pix16_adaptive_tiles")
def _(spark, sf):
    d = views.dark(spark, sf)
    return X.adaptive_tiles(T.dilate(d, 1).select(c("shape_id").alias("region_id"), "x", "y"), 8, 6)


query("pix17_tile_or_scale", f"WITH {views.DARK}, s AS (SELECT shape_id AS region_id, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM dark GROUP BY 1), t AS (SELECT *, CAST(ceil(width / 12.0) * ceil(height / 9.0) AS INT) AS tiles FROM s), u AS (SELECT *, CASE WHEN width <= 12 AND height <= 9 THEN 'centre' WHEN tiles > 10 THEN 'scale' ELSE 'tile' END AS how FROM t) SELECT *, CASE WHEN how = 'scale' THEN greatest(width / 12.0, height / 9.0) ELSE 1.0 END AS factor FROM u")(
    lambda spark, sf: X.place_specimen(S.bbox(views.dark(spark, sf)).select(c("shape_id").alias("region_id"), "width", "height"), (12, 9))
)

# -- layers
Y = f"WITH {views.LAYERS}"
#: To the nearest 255th; no half occurs, as 255 is odd.
_RND = "((({0}) + 127) // 255)"


def _blend_sql(mode, b, s):
    scr = f"(255 - {_RND.format(f'(255 - {b}) * (255 - {s})')})"
    return {
        "NORMAL": s, "MULTIPLY": _RND.format(f"{b} * {s}"), "SCREEN": scr,
        "OVERLAY": f"(CASE WHEN {b} <= 127 THEN least(255, {_RND.format(f'2 * {b} * {s}')}) ELSE 255 - {_RND.format(f'2 * (255 - {b}) * (255 - {s})')} END)",
        "DARKEN": f"least({b}, {s})", "LIGHTEN": f"greatest({b}, {s})", "ADD": f"least(255, {b} + {s})", "SUBTRACT": f"greatest(0, {b} - {s})", "DIFFERENCE": f"abs({b} - {s})",
    }[mode]


def _comp_sql(mode):
    """Channels of backdrop ba, br.. under source sa, sr.. with ba > 0."""
    w = "(sa * 255 + ba * (255 - sa))"

    def ch(k):
        bl = _blend_sql(mode, f"b{k}", f"s{k}")
        return f"CASE WHEN sa = 0 THEN b{k} WHEN sa = 255 THEN {_RND.format(f'(255 - ba) * s{k} + ba * {bl}')} ELSE (sa * (255 - ba) * s{k} + sa * ba * {bl} + ba * (255 - sa) * b{k} + {w} // 2) // {w} END"

    a = f"CASE WHEN sa = 0 THEN ba WHEN sa = 255 THEN 255 ELSE {_RND.format(w)} END"
    return pack_sql(a, ch("r"), ch("g"), ch("b"))


#: Both layers of a cell side by side, without a join.
_BOTH = ", both_ AS (SELECT doc_id, x, y, " + ", ".join(f"max({k}) FILTER (z = {z}) AS {n}{k}" for z, n in ((0, "b"), (1, "s")) for k in "argb") + " FROM lay GROUP BY doc_id, x, y)"
_PAIR = f"{_BOTH}, pr AS (SELECT * FROM both_ WHERE ba IS NOT NULL AND sa IS NOT NULL)"


def _pairs(spark, sf):
    lay = views.layers(spark, sf)
    low = lay.where("z = 0").select("doc_id", "x", "y", c("argb").alias("low"))
    return lay.where("z = 1").join(low, ["doc_id", "x", "y"])


@query("cmp1_composite", f"{Y}{_PAIR} SELECT doc_id, x, y, " + ", ".join(f"{_comp_sql(m)} AS {m.lower()}" for m in L.MODES) + " FROM pr")
def _(spark, sf):
    return L.composite_modes(_pairs(spark, sf), "low", "argb", L.MODES).select("doc_id", "x", "y", *[m.lower() for m in L.MODES])


def _layer_table(p, opacity=1.0, clipped=False, blend="MULTIPLY", visible=True):
    rows = F.array(
        F.struct(F.lit(0).alias("z"), F.lit(0).alias("offset_x"), F.lit(0).alias("offset_y"), F.lit(1.0).alias("opacity"), F.lit(True).alias("visible"), F.lit("NORMAL").alias("blend"), F.lit(False).alias("clipped")),
        F.struct(F.lit(1).alias("z"), F.lit(0).alias("offset_x"), F.lit(0).alias("offset_y"), F.lit(float(opacity)).alias("opacity"), F.lit(visible).alias("visible"), F.lit(blend).alias("blend"), F.lit(clipped).alias("clipped")),
    )
    return p.select("doc_id").distinct().select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


_FLAT = f"{_BOTH}, fl AS (SELECT doc_id, x, y, " + ", ".join(f"coalesce({n}{k}, 0) AS {n}{k}" for n in "bs" for k in "argb") + " FROM both_ WHERE x < 64 AND y < 48)"


def _flat_sql(mode):
    return f"{Y}{_FLAT} SELECT doc_id, x, y, CASE WHEN sa = 0 AND ba = 0 THEN 0 WHEN ba = 0 THEN {pack_sql('sa', 'sr', 'sg', 'sb')} ELSE {_comp_sql(mode)} END AS argb FROM fl"


@query("cmp2_flatten", _flat_sql("MULTIPLY"))
def _(spark, sf):
    p = views.layers(spark, sf)
    return L.flatten(L.place(p, _layer_table(p), 64, 48))


_D255 = "(({0}) // 255)"


@query("cmp3_place", f"{Y} SELECT doc_id, z, x, y, CASE WHEN z = 0 THEN {pack_sql('a', 'r', 'g', 'b')} ELSE {pack_sql(_D255.format('a * 102 + 127'), 'r', 'g', 'b')} END AS argb FROM lay WHERE x < 64 AND y < 48")
def _(spark, sf):
    p = views.layers(spark, sf)
    return L.place(p, _layer_table(p, 0.4), 64, 48).select("doc_id", "z", "x", "y", "argb")


@query("cmp4_mask_stack", f"{Y} SELECT doc_id, z, x, y, CASE WHEN z = 0 THEN {pack_sql('a', 'r', 'g', 'b')} ELSE {pack_sql(_D255.format('a * (CASE WHEN x % 2 = 0 THEN greatest(x * 3, y * 4) ELSE 0 END) + 127'), 'r', 'g', 'b')} END AS argb FROM lay WHERE x < 64 AND y < 48")
def _(spark, sf):
    p = views.layers(spark, sf)
    top = p.where("z = 1 AND x % 2 = 0").select("doc_id", "z", "x", "y")
    masks = top.select("*", F.lit(0).alias("mask_no"), (c("x") * 3).alias("alpha")).unionAll(top.select("*", F.lit(1).alias("mask_no"), (c("y") * 4).alias("alpha")))
    return L.apply_masks(L.place(p, _layer_table(p), 64, 48), masks).select("doc_id", "z", "x", "y", "argb")


@query("cmp5_clip", f"{Y} SELECT doc_id, z, x, y, CASE WHEN z = 0 THEN {pack_sql('a', 'r', 'g', 'b')} ELSE {pack_sql(_D255.format('a * coalesce(base, 0)'), 'r', 'g', 'b')} END AS argb FROM (SELECT *, max(a) FILTER (z = 0) OVER (PARTITION BY doc_id, x, y) AS base FROM lay WHERE x < 64 AND y < 48)")
def _(spark, sf):
    p = views.layers(spark, sf)
    t = _layer_table(p, clipped=True)
    return L.clip_to_base(L.place(p, t, 64, 48), t).select("doc_id", "z", "x", "y", "argb")


@query("cmp6_mask_from_layer", f"{Y} SELECT doc_id, x - 3 AS x, y - 2 AS y, a AS alpha FROM lay WHERE z = 1")
def _(spark, sf):
    return L.mask_from_layer(views.layers(spark, sf), 1, -3, -2)


_DK = f"WITH {views.DARK}, cv AS (SELECT shape_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT DISTINCT shape_id FROM dark), range(64) t(x), range(48) u(y))"


@query("cmp7_masks", f"{_DK} SELECT cv.*, CASE WHEN dark.x IS NULL THEN 255 ELSE 0 END AS alpha FROM cv LEFT JOIN dark USING (shape_id, x, y)".replace("CASE WHEN dark.x IS NULL", "CASE WHEN dark.shape_id IS NULL").replace("LEFT JOIN dark USING (shape_id, x, y)", "LEFT JOIN dark ON cv.shape_id = dark.shape_id AND cv.x = dark.x AND cv.y = dark.y"))
def _(spark, sf):
    d = views.dark(spark, sf)
    return L.invert_mask(L.mask_from_selection(S.canvas(d, 64, 48), d))


@query("cmp8_layer_edits", f"{Y} SELECT DISTINCT doc_id, z, blend FROM lay, (VALUES (0, 'MULTIPLY'), (1, 'NORMAL'), (2, 'NORMAL')) t(nz, blend), LATERAL (SELECT nz AS z)".replace("SELECT DISTINCT doc_id, z, blend", "SELECT DISTINCT doc_id, nz AS z, blend").replace(", LATERAL (SELECT nz AS z)", ""))
def _(spark, sf):
    p = views.layers(spark, sf)
    t = L.duplicate_layer(_layer_table(p), 0)  # normal, normal, multiply
    return L.renumber(L.move_layer(t, 2, 0)).select("doc_id", "z", "blend")


@query("cmp8_merge_range", _flat_sql("SCREEN"))
def _(spark, sf):
    p = views.layers(spark, sf)
    return L.merge_range(L.place(p, _layer_table(p, blend="SCREEN"), 64, 48), 0, 1).select("doc_id", "x", "y", "argb")


_BRUSH = L.Brush(-16776961, 5, hardness=0.4, flow=0.8)
_DABS = ", ".join(f"({x}, {y}, {a!r}::DOUBLE)" for x, y, a in _BRUSH.dab())
_COV = f", cov AS (SELECT shape_id, x + dx AS x, y + dy AS y, 1 - product(1 - al) AS coverage FROM dark, (VALUES {_DABS}) t(dx, dy, al) GROUP BY 1, 2, 3)"


@query("cmp9_stamp_points", f"WITH {views.DARK}{_COV} SELECT shape_id, x, y, round(coverage, 6) AS coverage FROM cov")
def _(spark, sf):
    return L.stamp_points(views.dark(spark, sf), _BRUSH).withColumn("coverage", F.round("coverage", 6))


@query("cmp11_paint_coverage", f"WITH {views.DARK}{_COV}, pr AS (SELECT px.frame_id, px.x, px.y, 255 AS ba, r AS br, g AS bg, b AS bb, CAST(floor(coverage * 255 + 0.5) AS INT) AS sa, 0 AS sr, 0 AS sg, 255 AS sb FROM px LEFT JOIN cov ON frame_id = shape_id AND px.x = cov.x AND px.y = cov.y) SELECT frame_id, x, y, CASE WHEN sa IS NULL THEN {pack_sql('255', 'br', 'bg', 'bb')} ELSE {_comp_sql('NORMAL')} END AS argb FROM pr")
def _(spark, sf):
    from rasterloom.functions.color import pack_argb

    p = views.px(spark, sf).select("frame_id", "x", "y", pack_argb(F.lit(255), c("r"), c("g"), c("b")).alias("argb"))
    return L.paint_coverage(p, L.stamp_points(views.dark(spark, sf), _BRUSH), _BRUSH)
