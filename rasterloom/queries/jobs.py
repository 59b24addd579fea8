"""Source, comparison, model and job queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rasterloom import views
from rasterloom.functions.color import pack_argb
from rasterloom.operators import compare as CO
from rasterloom.operators import contours as K
from rasterloom.operators import groups as GR
from rasterloom.operators import model as M
from rasterloom.operators import points as T
from rasterloom.operators import sets as S
from rasterloom.plans import jobs as J
from rasterloom.queries.scalars import ARGB_SQL
from rasterloom.registry import query
from rasterloom.sources import images, tables, text

c = F.col
D = f"WITH {views.DARK}"


def _path(spark, name):
    return f"{tables.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- sources and sinks
@query("src2_frames_from_pixels", f"WITH {views.ARGB} SELECT frame_id, x, y, {ARGB_SQL} AS argb FROM ar")
def _(spark, sf):
    """Pixels packed into row-major buffers and unpacked again; cells without a pixel are left out."""
    p = views.argb(spark, sf)
    cells = S.canvas(p.select(c("frame_id").alias("shape_id")), 64, 48).withColumnRenamed("shape_id", "frame_id")
    rows = F.array_sort(F.collect_list(F.struct((c("y") * 64 + c("x")).alias("i"), F.coalesce("argb", F.lit(0)).alias("v"))))
    packed = cells.join(p, ["frame_id", "x", "y"], "left").groupBy("frame_id").agg(F.transform(rows, lambda r: r["v"]).alias("pixels"))
    packed = packed.withColumns({"width": F.lit(64), "height": F.lit(48)})
    return images.frames_from_pixels(packed).join(p.select("frame_id", "x", "y"), ["frame_id", "x", "y"], "left_semi")


@query("src3_natural_order", "SELECT source AS name, CAST(row_number() OVER (ORDER BY CAST(substr(source, 4) AS INT)) AS INT) AS position FROM (SELECT DISTINCT source FROM documents)")
def _(spark, sf):
    return text.natural_order(views.table(spark, sf, "documents").select(c("source").alias("name")).distinct(), "name")


@query("src4_parse_border", f"{D} SELECT * FROM dark")
def _(spark, sf):
    return text.parse_border(text.encode_border(views.dark(spark, sf), "shape_id"), "shape_id", "border")


@query("src5_encode_border", f"{D}, b AS (SELECT shape_id, x, x || '=[' || string_agg(y, ', ' ORDER BY y) || ']' AS t FROM dark GROUP BY 1, 2) SELECT shape_id, '{{' || string_agg(t, ', ' ORDER BY x) || '}}' AS border FROM b GROUP BY 1")
def _(spark, sf):
    return text.encode_border(views.dark(spark, sf), "shape_id")


@query("src6_parse_rect", "SELECT l_orderkey, l_linenumber, l_partkey::INT AS x, l_suppkey::INT AS y, l_linenumber::INT AS width, CAST(l_quantity AS INT) AS height FROM lineitem")
def _(spark, sf):
    t = F.format_string("[x=%d,y=%d,width=%d,height=%d]", "l_partkey", "l_suppkey", "l_linenumber", c("l_quantity").cast("int"))
    return views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.parse_rect(t).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query("src7_parse_color_map", "SELECT l_orderkey, l_linenumber, [l_partkey % 256, l_suppkey % 256, l_linenumber] AS source, [0, 0, l_partkey % 7] AS target FROM lineitem")
def _(spark, sf):
    t = F.format_string("%d,%d,%d={0,0,%d}", c("l_partkey") % 256, c("l_suppkey") % 256, "l_linenumber", c("l_partkey") % 7)
    e = F.get(F.map_entries(text.parse_color_map(t)), 0)
    return views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", e["key"].alias("source"), e["value"].alias("target"))


@query("src8_encode_color_map", "SELECT l_orderkey, l_linenumber, '{' || l_partkey % 256 || ',' || l_suppkey % 256 || ',' || l_linenumber || '}={0,0,' || l_partkey % 7 || '}' AS text FROM lineitem")
def _(spark, sf):
    t = F.format_string("%d,%d,%d={0,0,%d}", c("l_partkey") % 256, c("l_suppkey") % 256, "l_linenumber", c("l_partkey") % 7)
    return views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.encode_color_map(text.parse_color_map(t)).alias("text"))


@query("src9_string_map", "SELECT event_id, rtrim(translate(base64(encode(event_type)), '+/', '-_'), '=') || ':' || rtrim(translate(base64(encode(props)), '+/', '-_'), '=') AS text, event_type AS k, props AS v FROM events")
def _(spark, sf):
    t = text.encode_string_map(F.create_map("event_type", "props"))
    e = views.table(spark, sf, "events").select("event_id", t.alias("text"))
    m = F.get(F.map_entries(text.parse_string_map(c("text"))), 0)
    return e.select("event_id", "text", m["key"].alias("k"), m["value"].alias("v"))


@query("src10_match_frames", "WITH n AS (SELECT DISTINCT source FROM documents) SELECT CAST(row_number() OVER (ORDER BY CAST(substr(source, 4) AS INT)) AS INT) AS position, source AS left, source || '.png' AS right FROM n")
def _(spark, sf):
    n = views.table(spark, sf, "documents").select(c("source").alias("name")).distinct()
    return images.match_frames(n, n.select(F.concat("name", F.lit(".png")).alias("name")))


@query("snk1_border_files", f"{D} SELECT * FROM dark")
def _(spark, sf):
    path = _path(spark, "borders")
    text.write_border(views.dark(spark, sf), path)
    return text.load_border(spark, path)


def _sparse_border(spark, sf):
    """Top and bottom of every third column of the dark points."""
    ends = T.spans(views.dark(spark, sf).where("x % 3 = 0"))
    return ends.select("shape_id", "x", F.explode(F.array("y_lo", "y_hi")).alias("y")).distinct()


@query("snk1_border_files_filled")
def _(spark, sf):
    path = _path(spark, "borders")
    text.write_border(_sparse_border(spark, sf), path)
    return text.load_border(spark, path, fill=True)


@query("pts30_interpolate_border")
def _(spark, sf):
    return T.interpolate_border(_sparse_border(spark, sf)).withColumn("y", F.round("y", 9))


@query("pts31_rescale_points")
def _(spark, sf):
    return T.rescale_points(_sparse_border(spark, sf), 2.0)


@query("src1_read_frames", f"WITH {views.PX} SELECT dense_rank() OVER (ORDER BY frame_id) AS frame_id, CAST(cx AS INT) AS x, CAST(cy AS INT) AS y, CAST(-16777216 + coalesce(r, 0) * 65536 + coalesce(g, 0) * 256 + coalesce(b, 0) AS INT) AS argb FROM (SELECT DISTINCT frame_id FROM px), range(64) s(cx), range(48) t(cy) LEFT JOIN px p ON p.frame_id = px.frame_id AND p.x = cx AND p.y = cy".replace("FROM (SELECT DISTINCT frame_id FROM px), range(64) s(cx), range(48) t(cy) LEFT JOIN px p ON p.frame_id = px.frame_id AND p.x = cx AND p.y = cy", "FROM (SELECT * FROM (SELECT DISTINCT frame_id FROM px), range(64) s(cx), range(48) t(cy)) LEFT JOIN (SELECT frame_id, x AS cx, y AS cy, r, g, b FROM px) USING (frame_id, cx, cy)"))
def _(spark, sf):
    """Frames written as bitmap files and read back; frame_id is the place of the file's name."""
    path = _path(spark, "images")
    images.write_bitmaps(_frames(spark, sf), path, 64, 48)
    return images.read_frames(spark, path)[1]


@query("snk2_write_frames", f"WITH {views.ARGB} SELECT frame_id, x, y, {ARGB_SQL} AS argb FROM ar")
def _(spark, sf):
    path = _path(spark, "frames")
    tables.write_frames(views.argb(spark, sf), path)
    return tables.read_frames_table(spark, path).select(c("frame_id").cast("long").alias("frame_id"), "x", "y", "argb")


@query("snk3_ink_bands", f"WITH {views.HSV} SELECT CAST(floor(h) AS INT) % 360 AS hue, CAST(floor(s) AS INT) AS sat, CAST(min(floor(v)) AS INT) AS v_min, CAST(max(floor(v)) AS INT) AS v_max, count(*) AS n FROM hsv GROUP BY 1, 2")
def _(spark, sf):
    from rasterloom.operators.filters import learn_ink_bands

    path = _path(spark, "bands")
    tables.write_ink_bands(learn_ink_bands(views.hsv(spark, sf), F.lit(False)), path, "all")
    return tables.read_ink_bands(spark, path, "all")


# -- comparison
G = f"WITH {views.GRAY}"
_OTSU = """hg AS (SELECT frame_id, CAST(floor(value * 255 + 0.5) AS INT) AS bin, count(*) AS n FROM gray WHERE value >= 0.05 GROUP BY 1, 2),
tt AS (SELECT frame_id, sum(n) AS count, sum(bin * n) AS moment FROM hg GROUP BY 1),
rn AS (SELECT *, sum(n) OVER w AS bn, sum(bin * n) OVER w AS bm FROM hg WHERE bin >= 13 WINDOW w AS (PARTITION BY frame_id ORDER BY bin)),
vr AS (SELECT frame_id, bin, round(CAST(bn AS DOUBLE) * (count - bn) * pow(CAST(bm AS DOUBLE) / bn - CAST(moment - bm AS DOUBLE) / (count - bn), 2), 6) AS v FROM rn JOIN tt USING (frame_id) WHERE count > bn),
ot AS (SELECT frame_id, arg_min(bin, (-v, bin)) / 255.0::DOUBLE AS threshold FROM vr GROUP BY 1)"""


@query("cmpr1_otsu", f"{G}, {_OTSU} SELECT frame_id, threshold FROM ot")
def _(spark, sf):
    return CO.otsu(views.gray(spark, sf), 0.05)


@query("cmpr2_visible_bounds", f"{G} SELECT frame_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM gray WHERE value > 0.7 GROUP BY 1")
def _(spark, sf):
    return CO.visible_bounds(views.gray(spark, sf), 0.7)


def _core(spark, sf):
    g = views.gray(spark, sf)
    return g, CO.core_of(g, CO.otsu(g, 0.05))


_REG = f"""{G}, pk AS (SELECT frame_id, greatest(0.012, max(value) * 0.22) AS low FROM gray GROUP BY 1),
bd AS (SELECT frame_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM gray JOIN pk USING (frame_id) WHERE value >= low GROUP BY 1),
sc AS (SELECT *, 216.0::DOUBLE / greatest(x1 - x0 + 1, y1 - y0 + 1) AS scale FROM bd),
gr AS (SELECT frame_id, i % 256 AS gx, i // 256 AS gy, x0 + ((i % 256) - (256 - (x1 - x0 + 1) * scale) * 0.5 + 0.5) / scale - 0.5 AS u, y0 + ((i // 256) - (256 - (y1 - y0 + 1) * scale) * 0.5 + 0.5) / scale - 0.5 AS v, scale FROM sc, range(65536) t(i)),
va AS (SELECT frame_id, list(value ORDER BY y * 8 + x) AS w FROM gray GROUP BY 1),
co AS (SELECT gr.*, w, CAST(floor(u) AS INT) AS fx, CAST(floor(v) AS INT) AS fy FROM gr JOIN va USING (frame_id) WHERE u >= 0 AND v >= 0 AND u <= 7 AND v <= 7),
bl AS (SELECT frame_id, scale, gx, gy, (1 - u + fx) * (1 - v + fy) * w[fy * 8 + fx + 1] + (u - fx) * (1 - v + fy) * w[fy * 8 + least(fx + 1, 7) + 1] + (1 - u + fx) * (v - fy) * w[least(fy + 1, 7) * 8 + fx + 1] + (u - fx) * (v - fy) * w[least(fy + 1, 7) * 8 + least(fx + 1, 7) + 1] AS value FROM co)
SELECT frame_id, round(any_value(scale), 6) AS scale, round(sum(value), 3) AS total, round(sum(value * gx), 2) AS by_x, round(sum(value * gy), 2) AS by_y FROM bl GROUP BY 1"""


@query("cmpr3_register", _REG)
def _(spark, sf):
    """All frames on the full grid; per frame the scale, the darkness and its moments."""
    moment = lambda f: F.round(F.sum(c("value") * f), 2)
    cells = CO.cells_of(CO.register_rasters(views.gray(spark, sf)), "values", "scale")
    return cells.groupBy("frame_id").agg(F.round(F.max("scale"), 6).alias("scale"), F.round(F.sum("value"), 3).alias("total"), moment(c("x")).alias("by_x"), moment(c("y")).alias("by_y"))


@query("cmpr4_measure", f"{G}, {_OTSU}, co AS (SELECT gray.* FROM gray JOIN ot USING (frame_id) WHERE value >= threshold), nb AS (SELECT a.frame_id, count(*) AS inner_ FROM co a JOIN co b ON a.frame_id = b.frame_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1) SELECT frame_id AS shape_id, count(*) AS area, 4 * count(*) - coalesce(any_value(inner_), 0) AS edges, round(2.0 * count(*) / (4 * count(*) - coalesce(any_value(inner_), 0)), 6) AS thickness, round(avg(value), 6) AS opacity, round(stddev_pop(value), 6) AS pressure FROM co LEFT JOIN nb USING (frame_id) GROUP BY 1")
def _(spark, sf):
    return CO.measure(*_core(spark, sf)).withColumns({k: F.round(k, 6) for k in ("thickness", "opacity", "pressure")})


def _halves(spark, sf):
    g = views.gray(spark, sf)
    half = lambda k: g.where(c("frame_id") % 2 == k).select(F.expr("frame_id div 2").alias("frame_id"), "x", "y", "value")
    return half(0), half(1)


def _looks(spark, sf):
    return tuple(tables.materialise(CO.registered_looks(h)) for h in _halves(spark, sf))


@query("cmpr5_border_profile")
def _(spark, sf):
    rounded = F.transform("profile", lambda v: F.round(v, 9))
    return CO.registered_looks(views.gray(spark, sf)).select("frame_id", F.round("border", 9).alias("border"), rounded.alias("profile"))


@query("cmpr6_shape_similarity")
def _(spark, sf):
    return CO.shape_similarity(*_looks(spark, sf))


@query("cmpr7_appearance_similarity")
def _(spark, sf):
    return CO.appearance_similarity(*_looks(spark, sf))


@query("cmpr7_transfer_profile")
def _(spark, sf):
    return CO.transfer_profile(*_looks(spark, sf))


@query("cmpr8_compare")
def _(spark, sf):
    """Different frames are compared here, so no pair is an error."""
    return CO.compare(*_halves(spark, sf), least=None)


@query("cmpr9_source_stats", f"{G}, {_OTSU}, co AS (SELECT gray.* FROM gray JOIN ot USING (frame_id) WHERE value >= threshold), hh AS (SELECT frame_id, CAST(floor(value * 255 + 0.5) AS INT) AS bin, count(*) AS n FROM co GROUP BY 1, 2), cu AS (SELECT *, sum(n) OVER (PARTITION BY frame_id ORDER BY bin) / CAST(sum(n) OVER (PARTITION BY frame_id) AS DOUBLE) AS cum FROM hh), qq AS (SELECT frame_id, min(CASE WHEN cum >= 0.25 THEN bin END) / 255.0::DOUBLE AS q25, min(CASE WHEN cum >= 0.5 THEN bin END) / 255.0::DOUBLE AS q50, min(CASE WHEN cum >= 0.75 THEN bin END) / 255.0::DOUBLE AS q75 FROM cu GROUP BY 1) SELECT frame_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, any_value(q25) AS q25, any_value(q50) AS q50, any_value(q75) AS q75 FROM co JOIN qq USING (frame_id) GROUP BY 1")
def _(spark, sf):
    return CO.source_stats(*_core(spark, sf)).withColumns({k: F.round(k, 6) for k in ("mean", "deviation")})


@query("cmpr10_generate")
def _(spark, sf):
    return CO.generate(*_halves(spark, sf))


@query("cmpr11_warp_halo")
def _(spark, sf):
    """Halo of the even frames' cores read from the odd frames."""
    def image(scan):
        core = CO.core_of(scan, CO.otsu(scan, 0.05)).select(c("shape_id").alias("frame_id"), "x", "y", F.lit(True).alias("in"))
        cells = scan.join(core, ["frame_id", "x", "y"], "left").withColumn("core", F.coalesce("in", F.lit(False)))
        far = T.chamfer_distance(scan.select(c("frame_id").alias("shape_id"), "x", "y"), core.select(c("frame_id").alias("shape_id"), "x", "y"))
        far = far.select(c("shape_id").alias("frame_id"), "x", "y", (c("distance") / 3).alias("far"))
        return tables.materialise(cells.join(far, ["frame_id", "x", "y"]).select("frame_id", "x", "y", "core", "far", "value"))

    a, b = _halves(spark, sf)
    return CO.warp_halo(image(a), image(b), 1.0, 3.0)


# -- features and model
@query("mod1_local_frame", f"WITH {views.POLY} SELECT shape_id, ord, x - CAST(floor((x0 + x1) / 2.0) AS INT) + 128 AS x, y - CAST(floor((y0 + y1) / 2.0) AS INT) + 128 AS y FROM poly JOIN (SELECT shape_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM poly GROUP BY 1) USING (shape_id)")
def _(spark, sf):
    return M.local_frame(views.poly(spark, sf))


@query("mod2_build_features")
def _(spark, sf):
    return M.build_features(views.poly(spark, sf))


@query("mod2_build_features_sampled")
def _(spark, sf):
    """As many samples of equal arcs as half of the vertices of a usual outline."""
    return M.build_features(views.poly(spark, sf), n=60)


def _measured(spark, sf, ink):
    p = views.poly(spark, sf)
    scan = views.px(spark, sf).select("frame_id", "x", "y", (1 - (c("r") + c("g") + c("b")) / 765.0).alias("value"))
    return M.measure(M.build_features(p), K.rasterize(p), scan, ink=ink)


@query("mod3_measure")
def _(spark, sf):
    return _measured(spark, sf, False)


@query("mod3_measure_ink")
def _(spark, sf):
    return _measured(spark, sf, True)


@query("mod4_anchors")
def _(spark, sf):
    return M.anchors(views.poly(spark, sf), views.dark(spark, sf))


@query("mod5_map_averages", f"WITH {views.POLY} SELECT shape_id, ord, round(y - avg(y) OVER (PARTITION BY shape_id), 6) + 0.0 AS deviation FROM poly")
def _(spark, sf):
    return M.map_averages(views.poly(spark, sf), ("y", "x")).select("shape_id", "ord", (F.round("deviation", 6) + 0.0).alias("deviation"))


def _two(spark, sf):
    p = views.poly(spark, sf)
    return M.build_features(p), M.build_features(K.renumber(p.where("ord % 2 = 0")))


@query("mod6_nearest_by_location")
def _(spark, sf):
    return M.nearest_by_location(*_two(spark, sf))


@query("mod8_best_match")
def _(spark, sf):
    return M.best_match(*_two(spark, sf))


@query("mod7_match_score")
def _(spark, sf):
    """Every vertex against the one a place further on."""
    f = M.comparable(M.build_features(views.poly(spark, sf)))
    n = f.groupBy("shape_id").agg(F.count("*").alias("n"))
    a = f.join(n, "shape_id").select("shape_id", "ord", F.pmod(c("ord") + 1, c("n")).cast("int").alias("to"), F.struct(*M._FIELDS).alias("a"))
    b = f.select("shape_id", c("ord").alias("to"), F.struct(*M._FIELDS).alias("b"))
    return a.join(b, ["shape_id", "to"]).select("shape_id", "ord", F.round(M.match_score(c("a"), c("b")), 9).alias("score"))


@query("mod9_naive_match")
def _(spark, sf):
    return M.naive_match(*_two(spark, sf))


@query("mod15_session")
def _(spark, sf):
    p = views.poly(spark, sf)
    return M.session(p, K.translate(p, 2, 1))[0]


def _samples(spark, sf):
    p = views.px(spark, sf)
    y = c("r") * 0.01 + c("g") * 0.02 - c("x") * 0.05
    return p.select("frame_id", "x", "y", (c("r") / 255.0).alias("r1"), (c("g") / 255.0).alias("g1"), (c("b") / 255.0).alias("b1"), y.alias("target"), ((c("y") + 1) / 48.0).alias("confidence"))


@query("mod10_vectorize", f"WITH {views.PX}, s AS (SELECT *, r / 255.0::DOUBLE AS r1, g / 255.0::DOUBLE AS g1 FROM px) SELECT frame_id, x, y, round(r1 * g1, 6) AS crossed, 6 AS n FROM s")
def _(spark, sf):
    v = M.vectorize(_samples(spark, sf), ("r1", "g1"), cross=True)
    return v.select("frame_id", "x", "y", F.round(F.get("features", 3), 6).alias("crossed"), F.size("features").alias("n"))


_SAMPLES_SQL = f"""WITH {views.PX}, s AS (SELECT *, r / 255.0::DOUBLE AS r1, g / 255.0::DOUBLE AS g1, b / 255.0::DOUBLE AS b1, r * 0.01::DOUBLE + g * 0.02::DOUBLE - x * 0.05::DOUBLE AS target, (y + 1) / 48.0::DOUBLE AS confidence FROM px),
z AS (SELECT frame_id, x, y, target, confidence, (r1 - avg(r1) OVER ()) / stddev_pop(r1) OVER () AS r1, (g1 - avg(g1) OVER ()) / stddev_pop(g1) OVER () AS g1, (b1 - avg(b1) OVER ()) / stddev_pop(b1) OVER () AS b1 FROM s),
me AS (SELECT sum(confidence * target) / sum(confidence) AS bias FROM z),
w0 AS (SELECT any_value(bias) AS bias, """ + ", ".join(f"0.15 * sum(confidence * {k} * (target - bias)) / sum(confidence * {k} * {k}) AS w_{k}" for k in ("r1", "g1", "b1")) + " FROM z, me)"


@query("mod11_init_weights", f"{_SAMPLES_SQL} SELECT term, round(CASE term WHEN 'r1' THEN w_r1 WHEN 'g1' THEN w_g1 WHEN 'b1' THEN w_b1 ELSE bias END, 9) AS weight FROM w0, (VALUES ('r1'), ('g1'), ('b1'), ('bias')) t(term)")
def _(spark, sf):
    s, _ = M.standardize(_samples(spark, sf), ("r1", "g1", "b1"))
    return M.first_weights(s, ("r1", "g1", "b1"), "target").withColumn("weight", F.round("weight", 9))


@query("mod13_predict", f"{_SAMPLES_SQL} SELECT frame_id, x, y, round(least(greatest(0.25 * r1 - 0.5 * g1 + 1.0 * b1 + 2.0, 0.5), 3.5), 9) AS predicted FROM z")
def _(spark, sf):
    """Given weights, bounded on both sides."""
    s, _ = M.standardize(_samples(spark, sf), ("r1", "g1", "b1"))
    return M.predict(s, ("r1", "g1", "b1"), [0.25, -0.5, 1.0, 2.0], 0.5, 3.5).select("frame_id", "x", "y", F.round("predicted", 9).alias("predicted"))


@query("mod13_synthesise", f"""{_SAMPLES_SQL} SELECT frame_id, x, y,
  round(least(greatest(target + 1.1 * (0.25 * r1 - 0.5 * g1 + 1.0 * b1 + 2.0), 0.5), 64.0), 6) AS thickness,
  round(least(greatest(confidence + 1.2 * (0.1 * r1 - 0.2), 0.0), 1.0), 6) AS opacity, 0.5::DOUBLE AS border_blend FROM z""")
def _(spark, sf):
    """Two measures moved on, a third left as it is."""
    s, _ = M.standardize(_samples(spark, sf), ("r1", "g1", "b1"))
    s = s.withColumns({"thickness": c("target"), "opacity": c("confidence"), "border_blend": F.lit(0.5)})
    done = M.synthesise(s, ("r1", "g1", "b1"), {"thickness": [0.25, -0.5, 1.0, 2.0], "opacity": [0.1, 0.0, 0.0, -0.2]})
    return done.select("frame_id", "x", "y", F.round("thickness", 6).alias("thickness"), F.round("opacity", 6).alias("opacity"), "border_blend")


def _fit_sql() -> str:
    """Weighted ridge regression by the normal equations in the steps' recurrence: 1400 steps over moments."""
    names = ("r1", "g1", "b1", "one")
    full = f"{_SAMPLES_SQL.replace('WITH', 'WITH RECURSIVE', 1)}, zz AS (SELECT *, 1.0::DOUBLE AS one FROM z), mo AS (SELECT sum(confidence) AS c, " + ", ".join(f"sum(confidence * {a} * {b}) AS g_{a}_{b}" for a in names for b in names) + ", " + ", ".join(f"sum(confidence * {a} * target) AS y_{a}" for a in names) + " FROM zz)"
    step = ", ".join(f"w_{a} - 0.0125 * ((" + " + ".join(f"g_{a}_{b} * w_{b}" for b in names) + f" - y_{a}) / c" + (f" + 0.0004 * w_{a}" if a != "one" else "") + ")" for a in names)
    return f"{full}, it(k, w_r1, w_g1, w_b1, w_one) AS (SELECT 0, w_r1, w_g1, w_b1, bias FROM w0 UNION ALL SELECT k + 1, {step} FROM it, mo WHERE k < 1400), fi AS (SELECT * FROM it WHERE k = 1400)"


@query("mod12_fit_predict", f"{_fit_sql()} SELECT frame_id, x, y, round(least(greatest(w_r1 * r1 + w_g1 * g1 + w_b1 * b1 + w_one, -10.0), 10.0), 6) AS predicted FROM zz, fi")
def _(spark, sf):
    s, _ = M.standardize(_samples(spark, sf), ("r1", "g1", "b1"))
    w = M.fit(s, ("r1", "g1", "b1"), "target")
    return M.predict(s, ("r1", "g1", "b1"), w, -10.0, 10.0).select("frame_id", "x", "y", F.round("predicted", 6).alias("predicted"))


@query("mod14_rmse", f"{_fit_sql()} SELECT round(sqrt(sum(confidence * pow(least(greatest(w_r1 * r1 + w_g1 * g1 + w_b1 * b1 + w_one, -10.0), 10.0) - target, 2)) / sum(confidence)), 6) AS rmse FROM zz, fi")
def _(spark, sf):
    s, _ = M.standardize(_samples(spark, sf), ("r1", "g1", "b1"))
    found = M.rmse(M.predict(s, ("r1", "g1", "b1"), M.fit(s, ("r1", "g1", "b1"), "target"), -10.0, 10.0), "target")
    return found.select(F.round("rmse", 6).alias("rmse"))


# -- jobs
def _frames(spark, sf):
    return views.px(spark, sf).select("frame_id", "x", "y", pack_argb(F.lit(255), c("r"), c("g"), c("b")).alias("argb"))


def _plain(p, color=-1):
    return p.select("frame_id", "x", "y", F.lit(color).alias("argb"))


@query("job1_part_select", f"WITH {views.DARK}, sp AS (SELECT shape_id, x, min(y) AS lo, max(y) AS hi FROM dark GROUP BY 1, 2) SELECT px.frame_id, px.x, px.y, CASE WHEN y BETWEEN lo AND hi THEN CAST(-16777216 + r * 65536 + g * 256 + b AS INT) ELSE -1 END AS argb FROM px LEFT JOIN sp ON shape_id = frame_id AND sp.x = px.x")
def _(spark, sf):
    p = _frames(spark, sf)
    return J.part_select(p, _plain(p), views.dark(spark, sf))


@query("job2_part_combine")
def _(spark, sf):
    p = _frames(spark, sf)
    return J.part_combine(_plain(p).select("x", "y", "argb").distinct(), p, T.dilate(views.dark(spark, sf), 2))


@query("job3_paint_crop")
def _(spark, sf):
    p = _frames(spark, sf)
    return J.paint_crop(p, _plain(p), (4, 4, 50, 40), 3.0)


@query("job3_paint_crop_border")
def _(spark, sf):
    """The dark points, grown, as the given border."""
    p = _frames(spark, sf)
    return J.paint_crop(p, _plain(p), (4, 4, 50, 40), border=T.dilate(views.dark(spark, sf), 3))


def _sizes(p):
    return p.select("frame_id").distinct().select("frame_id", F.lit(64).alias("width"), F.lit(48).alias("height"))


@query("job4_part_overlay")
def _(spark, sf):
    p = _frames(spark, sf)
    return J.part_overlay(p, _plain(p, -4144960), _sizes(p), 3.0)


@query("job5_ink_xerox")
def _(spark, sf):
    p = _frames(spark, sf)
    return J.ink_xerox(p, _sizes(p), -16777216, 1.0)


def _specimens(spark, sf):
    """Two specimens from the first frame: one to be tiled, one to be centred."""
    first = lambda w, h: views.px(spark, sf).where(f"frame_id = 0 AND x < {w} AND y < {h}").select("x", "y", "r", "g", "b")
    return [J.Specimen((204, 51, 51), first(6, 6), (6, 6)), J.Specimen((51, 102, 255), first(64, 48), (64, 48))]


@query("job6_paint_fill")
def _(spark, sf):
    """The painted frames carry two colours on top of the drawn ones."""
    p = _frames(spark, sf)
    spot = lambda x0, color: F.when(c("x").between(x0, x0 + 9) & c("y").between(10, 30), color)
    painted = p.withColumn("argb", F.coalesce(spot(8, -3394765), spot(40, -13408513), c("argb")))
    return J.paint_fill(p, _sizes(p), _specimens(spark, sf), 2.0, painted=painted)


@query("job6_paint_fill_seeds")
def _(spark, sf):
    """Without painted frames: the first cell of each frame that is no ink is the seed of both specimens."""
    p = _frames(spark, sf)
    bare = J.with_hsv(p).where(~J._is_ink()).groupBy("frame_id").agg(F.min(F.struct("x", "y")).alias("s"))
    seeds = bare.select("frame_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("which"), "s.x", "s.y")
    return J.paint_fill(p, _sizes(p), _specimens(spark, sf), 2.0, seeds=seeds)


@query("job7_paint_merge_fill")
def _(spark, sf):
    p = _frames(spark, sf)
    return J.paint_merge_fill(p, p, p.where("x < 8 AND y < 8"), 3.0)


@query("grp7_mini_anchors")
def _(spark, sf):
    p = views.hsv(spark, sf).select("frame_id", "x", "y", F.struct("h", "s", "v").alias("argb"))
    frames = p.select("frame_id").distinct().select("frame_id", F.lit(64).alias("width"), F.lit(48).alias("height"))
    tests = lambda m: (m, [c("argb.v") <= 50, c("argb.s") <= 15])
    return GR.mini_anchors(p, frames, 2.0, tests, 2)


@query("job8_auto_ink_comparison")
def _(spark, sf):
    return J.compare_drawings(*_halves(spark, sf), least=None)


@query("job8_auto_ink")
def _(spark, sf):
    a, b = _halves(spark, sf)
    return J.auto_ink(a, b, least=None)[1]
