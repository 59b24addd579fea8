"""Set, point, run and group queries on the sparse dark points."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import views
from rasterloom.operators import groups as G
from rasterloom.operators import points as T
from rasterloom.operators import sets as S
from rasterloom.registry import query

c = F.col
D = f"WITH RECURSIVE {views.DARK}, b AS (SELECT shape_id, x + 1 AS x, y FROM dark)"


def _a(spark, sf):
    return views.dark(spark, sf)


def _b(spark, sf):
    return T.translate(_a(spark, sf), 1, 0)


def two(name, sql, fn):
    query(name, f"{D}{sql}")(lambda spark, sf: fn(_a(spark, sf), _b(spark, sf)))


def one(name, sql, fn):
    query(name, f"{D}{sql}")(lambda spark, sf: fn(_a(spark, sf)))


two("set1_union_points", " SELECT * FROM dark UNION SELECT * FROM b", S.union_points)
two("set2_subtract_points", " SELECT * FROM dark EXCEPT SELECT * FROM b", S.subtract_points)
two("set3_intersect_points", " SELECT * FROM dark INTERSECT SELECT * FROM b", S.intersect_points)
two("set4_apply_mode", " SELECT * FROM b", lambda a, b: S.apply_mode(a, b, "replace"))
_CANVAS = ", cv AS (SELECT shape_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT DISTINCT shape_id FROM dark), range(64) t(x), range(48) u(y))"
one("set5_invert_selection", f"{_CANVAS} SELECT * FROM cv EXCEPT SELECT * FROM dark", lambda a: S.invert_selection(a, 64, 48))
_BB = ", bb AS (SELECT shape_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM dark GROUP BY 1)"
_CELLS = _BB + ", cells AS (SELECT shape_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT shape_id, unnest(range(x0 - {0}, x1 + 1 + {0})) AS x, y0, y1 FROM bb), LATERAL (SELECT unnest(range(y0 - {0}, y1 + 1 + {0})) AS y))"
one("set6_inverse", f"{_CELLS.format(0)} SELECT * FROM cells EXCEPT SELECT * FROM dark", S.inverse)
one("set7_rectangle", " SELECT shape_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT DISTINCT shape_id FROM dark), range(5, 15) t(x), range(7, 13) u(y)", lambda a: S.rectangle(a, 5, 7, 10, 6))
two("set12_symmetric_difference", " (SELECT * FROM dark EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM dark)", S.symmetric_difference)
one("set13_contains", " SELECT DISTINCT shape_id, true AS contains_all, shape_id NOT IN (SELECT shape_id FROM dark WHERE x % 2 = 1) AS equal FROM dark WHERE shape_id IN (SELECT shape_id FROM dark WHERE x % 2 = 0 OR true)", lambda a: S.contains(a, a.where("x % 2 = 0")))
two("set14_included", " SELECT dark.shape_id, count(b.x) / CAST(count(*) AS DOUBLE) AS share, count(b.x) >= ceil(count(*) * 0.05) AS includes FROM dark LEFT JOIN b USING (shape_id, x, y) GROUP BY 1", lambda a, b: S.included(a, b, 0.05))

_RUNS = ", rn AS (SELECT shape_id, x, min(y) AS y_lo, max(y) AS y_hi FROM (SELECT *, y - row_number() OVER (PARTITION BY shape_id, x ORDER BY y) AS g FROM dark) GROUP BY shape_id, x, g)"
one("pts1_to_runs", f"{_RUNS} SELECT * FROM rn", T.to_runs)
one("pts2_from_runs", " SELECT * FROM dark", lambda a: T.from_runs(T.to_runs(a)))
one("pts3_run_ends", f"{_RUNS} SELECT shape_id, x, y_lo AS y FROM rn UNION SELECT shape_id, x, y_hi FROM rn", lambda a: T.run_ends(T.to_runs(a)))
one("pts4_run_index", " SELECT *, row_number() OVER (PARTITION BY shape_id, x ORDER BY y) - 1 AS index FROM dark", lambda a: T.run_index(a, T.to_runs(a)))
two("pts5_intersect_runs", f"{_RUNS}, rb AS (SELECT shape_id, x + 1 AS x, y_lo, y_hi FROM rn) SELECT rn.shape_id, rn.x, greatest(rn.y_lo, rb.y_lo) AS y_lo, least(rn.y_hi, rb.y_hi) AS y_hi FROM rn JOIN rb ON rn.shape_id = rb.shape_id AND rn.x = rb.x AND rn.y_lo <= rb.y_hi AND rb.y_lo <= rn.y_hi", lambda a, b: T.intersect_runs(T.to_runs(a), T.to_runs(b)))
_SP = ", sp AS (SELECT shape_id, x, min(y) AS y_lo, max(y) AS y_hi FROM dark GROUP BY 1, 2)"
one("pts6_spans", f"{_SP} SELECT * FROM sp", T.spans)
one("pts7_span_fill", f"{_SP} SELECT shape_id, x, CAST(unnest(range(y_lo, y_hi + 1)) AS INT) AS y FROM sp", lambda a: T.from_runs(T.spans(a)))
two("pts8_in_span", f"{_SP} SELECT b.* FROM b JOIN sp ON b.shape_id = sp.shape_id AND b.x = sp.x AND y BETWEEN y_lo AND y_hi", lambda a, b: T.in_span(b, T.spans(a)))
one("pts9_bbox", " SELECT shape_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, max(x) - min(x) AS extent_w, max(y) - min(y) AS extent_h FROM dark GROUP BY 1", S.bbox)
one("pts9_extremes", " SELECT shape_id, arg_min(y, (x, y)) AS left_y, arg_min(y, (-x, y)) AS right_y, arg_min(x, (y, x)) AS low_x, arg_min(x, (-y, x)) AS high_x FROM dark GROUP BY 1", lambda a: T.extremes(a).select("shape_id", c("left.y").alias("left_y"), c("right.y").alias("right_y"), c("low.x").alias("low_x"), c("high.x").alias("high_x")))
one("pts10_centroid", ", m AS (SELECT shape_id, avg(x) AS cx, avg(y) AS cy FROM dark GROUP BY 1) SELECT shape_id, round(cx, 6) AS cx, round(cy, 6) AS cy, arg_min(x, (round(pow(x - cx, 2) + pow(y - cy, 2), 9), x, y)) AS near_x, arg_min(y, (round(pow(x - cx, 2) + pow(y - cy, 2), 9), x, y)) AS near_y FROM dark JOIN m USING (shape_id) GROUP BY shape_id, cx, cy", lambda a: T.centroid(a).withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)}))
one("pts11_rotate", " SELECT DISTINCT shape_id, CAST(floor(round(cos(radians(30)) * (x - 32) - sin(radians(30)) * (y - 24) + 32, 9) + 0.5) AS INT) AS x, CAST(floor(round(sin(radians(30)) * (x - 32) + cos(radians(30)) * (y - 24) + 24, 9) + 0.5) AS INT) AS y FROM dark", lambda a: T.rotate(a, 30, (32, 24)))
one("pts11_flip", " SELECT shape_id, y AS x, x + 2 AS y FROM dark", lambda a: T.flip(T.translate(a, 2, 0)))
_HOLE = f"{_RUNS}, hl AS (SELECT *, lead(y_lo) OVER (PARTITION BY shape_id, x ORDER BY y_lo) AS nx FROM rn)"
one("pts12_hole", f"{_HOLE} SELECT shape_id, x, CAST(unnest(range(y_hi + 1, nx)) AS INT) AS y FROM hl WHERE nx IS NOT NULL", T.hole)
two("pts13_between", ", o AS (SELECT shape_id, x, min(y) AS lo, max(y) AS hi FROM dark GROUP BY 1, 2), i AS (SELECT shape_id, x, min(y) AS lo, max(y) AS hi FROM b GROUP BY 1, 2) SELECT shape_id, x, CAST(unnest(range(lo, hi + 1)) AS INT) AS y FROM o EXCEPT SELECT shape_id, x, CAST(unnest(range(lo, hi + 1)) AS INT) FROM i", T.between)
_DISK = ", disk AS (SELECT CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy FROM range(-{0}, {0} + 1) t(dx), range(-{0}, {0} + 1) u(dy) WHERE dx * dx + dy * dy <= {0} * {0})"
_DIL = _DISK + ", dl AS (SELECT DISTINCT shape_id, x + dx AS x, y + dy AS y FROM dark, disk)"
_ERO = ", er AS (SELECT shape_id, x - dx AS x, y - dy AS y FROM {0}, disk GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM disk))"
one("pts14_dilate", f"{_DIL.format(2)} SELECT * FROM dl", lambda a: T.dilate(a, 2))
one("pts15_erode", f"{_DIL.format(2)}{_ERO.format('dl')} SELECT * FROM er", lambda a: T.erode(T.dilate(a, 2), 2))
one("pts16_close_open", f"{_DIL.format(3)}{_ERO.format('dl')}, e2 AS (SELECT shape_id, x - dx AS x, y - dy AS y FROM er, (SELECT * FROM disk WHERE dx * dx + dy * dy <= 1) GROUP BY 1, 2, 3 HAVING count(*) = 5) SELECT DISTINCT shape_id, x + dx AS x, y + dy AS y FROM e2, (SELECT * FROM disk WHERE dx * dx + dy * dy <= 1)", lambda a: T.from_runs(T.open_runs(T.close_runs(T.to_runs(a), 3), 1)))
_CH = "4 * least(abs(a.x - d.x), abs(a.y - d.y)) + 3 * abs(abs(a.x - d.x) - abs(a.y - d.y))"
one("pts17_chamfer_distance", f"{_CELLS.format(2)}, di AS (SELECT a.shape_id, a.x, a.y, min({_CH}) AS d FROM cells a JOIN dark d ON a.shape_id = d.shape_id GROUP BY 1, 2, 3) SELECT cells.*, d AS distance FROM cells LEFT JOIN di USING (shape_id, x, y)", lambda a: T.chamfer_distance(S.bbox_cells(a, 2), a))
one("pts18_chamfer_close", f"{_CELLS.format(6)}, wd AS (SELECT DISTINCT a.* FROM cells a JOIN dark d ON a.shape_id = d.shape_id AND abs(a.x - d.x) <= 2 AND abs(a.y - d.y) <= 2 AND {_CH} <= 6), ou AS (SELECT * FROM cells EXCEPT SELECT * FROM wd) SELECT a.* FROM wd a ANTI JOIN ou d ON a.shape_id = d.shape_id AND abs(a.x - d.x) <= 2 AND abs(a.y - d.y) <= 2 AND {_CH} <= 6", lambda a: T.chamfer_close(a, 2))
query("pts19_thin")(lambda spark, sf: T.thin(T.dilate(_a(spark, sf), 2)))
one("pts20_min_distance", " SELECT a.shape_id, min(sqrt(pow(a.x - d.x, 2) + pow(a.y - d.y, 2))) AS distance FROM dark a JOIN dark d ON a.shape_id = d.shape_id AND a.x < 30 AND d.x > 45 GROUP BY 1", lambda a: T.min_distance(a.where("x < 30"), a.where("x > 45")))
_NQ = ", q AS (SELECT shape_id, qx, qy FROM (SELECT DISTINCT shape_id FROM dark), (VALUES (10, 10), (30, 20), (50, 40), (150, -90)) t(qx, qy)), p AS (SELECT q.*, x, y, pow(x - qx, 2) + pow(y - qy, 2) AS d FROM q JOIN dark USING (shape_id))"


def _queries(a):
    at = F.array(*[F.struct(F.lit(x).alias("qx"), F.lit(y).alias("qy")) for x, y in ((10, 10), (30, 20), (50, 40), (150, -90))])
    return a.select("shape_id").distinct().select("shape_id", F.explode(at).alias("q")).select("shape_id", "q.*")


one("pts21_nearest", f"{_NQ} SELECT shape_id, qx, qy, arg_min(x, (d, x, y)) AS x, arg_min(y, (d, x, y)) AS y, sqrt(min(d)) AS distance FROM p GROUP BY 1, 2, 3", lambda a: T.nearest(a, _queries(a)))
one("pts21_nearest_same_x", f"{_NQ} SELECT shape_id, qx, qy, x, arg_min(y, (abs(y - qy), y)) AS y, min(abs(y - qy)) AS distance FROM p WHERE x = qx GROUP BY 1, 2, 3, 4", lambda a: T.nearest_on_line(a, _queries(a), "y"))
one("pts21_nearest_same_y", f"{_NQ} SELECT shape_id, qx, qy, arg_min(x, (abs(x - qx), x)) AS x, y, min(abs(x - qx)) AS distance FROM p WHERE y = qy GROUP BY 1, 2, 3, 5", lambda a: T.nearest_on_line(a, _queries(a), "x"))
one("pts22_probe", ", w AS (SELECT *, y - row_number() OVER (PARTITION BY shape_id, x ORDER BY y) AS g FROM dark) SELECT shape_id, x, y, x AS end_x, max(y) OVER (PARTITION BY shape_id, x, g) AS end_y FROM w", lambda a: T.probe(a, a, 0, 1))
one("pts23_within_distance", f"{_NQ} SELECT DISTINCT shape_id, qx, qy FROM p WHERE d <= 9", lambda a: T.within_distance(a, _queries(a), 3))
one("pts24_sizes", " SELECT shape_id, count(*) AS n, count(DISTINCT x) AS n_x, count(DISTINCT y) AS n_y FROM dark GROUP BY 1", T.sizes)
one("pts24_column_neighbours", " SELECT shape_id, x, lag(x) OVER w AS lower, lead(x) OVER w AS higher FROM (SELECT DISTINCT shape_id, x FROM dark) WINDOW w AS (PARTITION BY shape_id ORDER BY x)", T.column_neighbours)
one("pts29_shape_summary", ", g AS (SELECT shape_id, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM dark GROUP BY 1), m AS (SELECT g.shape_id, max(CASE WHEN x <= (x_min + x_max) // 2 THEN x END) AS inner_left, min(CASE WHEN x > (x_min + x_max) // 2 THEN x END) AS inner_right FROM g JOIN dark USING (shape_id) WHERE y = (y_min + y_max) // 2 GROUP BY 1) SELECT g.*, n / CAST((x_max - x_min + 1) * (y_max - y_min + 1) AS DOUBLE) AS fill, inner_left, inner_right FROM g LEFT JOIN m USING (shape_id)", T.shape_summary)
_PATH = ", path AS (SELECT shape_id, x, min(y) AS y FROM dark GROUP BY 1, 2), pe AS (SELECT shape_id, arg_min((x, y), x) AS o, arg_max((x, y), x) AS f FROM path GROUP BY 1), ph AS (SELECT path.shape_id, max(CASE WHEN y = CAST(trunc(0.5 * (x - o[1]) + o[2]) AS INT) THEN x END) AS hx FROM path JOIN pe USING (shape_id) GROUP BY 1)"
one("pts32_path_intersection", f"{_PATH} SELECT shape_id, x, y FROM ph JOIN path USING (shape_id) WHERE x = hx", lambda a: T.path_intersection(a.groupBy("shape_id", "x").agg(F.min("y").alias("y")), 0.5))
two("pts33_to_base", " SELECT * FROM b", lambda a, b: T.to_base(a, a, b))
one("pts34_transform", " SELECT shape_id, CAST(floor((x + 1.5) * 2 + 0.5) AS INT) AS x, CAST(floor((y - 2) * 2 + 0.5) AS INT) AS y FROM dark", lambda a: T.apply_transform(a, 1.5, -2, 2.0))
one("pts34_unapply", " SELECT shape_id, greatest(least(CAST(floor(x / 2.0 - 1.5 + 0.5) AS INT), 20), x0) AS x, greatest(least(CAST(floor(y / 2.0 + 2 + 0.5) AS INT), y1), y0) AS y FROM dark JOIN (SELECT shape_id, min(x) AS x0, min(y) AS y0, max(y) AS y1 FROM dark WHERE x <= 20 GROUP BY 1) USING (shape_id)".replace(", 20)", ", x1)").replace("min(x) AS x0,", "min(x) AS x0, max(x) AS x1,"), lambda a: T.clamp_to(T.unapply_transform(a, 1.5, -2, 2.0), a.where("x <= 20")))


@query("pts20_min_distance_1d", f"WITH {views.SERIES} SELECT a.key, round(min(abs(a.value - b.value)), 6) AS distance FROM series a JOIN series b ON a.key = b.key AND a.pos % 2 = 0 AND b.pos % 2 = 1 GROUP BY 1")
def _(spark, sf):
    s = views.series(spark, sf)
    return T.min_distance_1d(s.where("pos % 2 = 0"), s.where("pos % 2 = 1")).withColumn("distance", F.round("distance", 6))


# -- groups; labels are the smallest x << 32 | y of a group
def _reach(src, d2):
    """CTE lb (shape_id, x, y, label) of the transitive closure of `src` within squared distance d2."""
    return f""", src AS (SELECT *, CAST(x AS BIGINT) * 4294967296 + y AS code FROM ({src})),
ed AS (SELECT a.shape_id, a.code AS a, b.code AS b FROM src a JOIN src b ON a.shape_id = b.shape_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {d2}),
rc AS (SELECT shape_id, a, b FROM ed UNION SELECT rc.shape_id, rc.a, ed.b FROM rc JOIN ed ON rc.shape_id = ed.shape_id AND rc.b = ed.a),
lb AS (SELECT src.shape_id, x, y, min(b) AS label FROM src JOIN rc ON src.shape_id = rc.shape_id AND src.code = rc.a GROUP BY 1, 2, 3)"""


one("grp1_group_points", f"{_reach('SELECT * FROM dark', 4)} SELECT * FROM lb", lambda a: G.group_points(a, 2.0))


@query("grp2_filter_to_groups", f"{D}{_reach('SELECT frame_id AS shape_id, x, y FROM hsv WHERE v <= 40', 9)} SELECT * FROM lb")
def _(spark, sf):
    return G.filter_to_groups(views.hsv(spark, sf), 3.0, c("v") <= 40)


@query("grp3_filter_to_groups_multi", f"{D}{_reach('SELECT frame_id * 2 + CASE WHEN v <= 40 THEN 0 ELSE 1 END AS shape_id, x, y FROM hsv WHERE v <= 40 OR (s <= 15 AND v > 60)', 4)} SELECT shape_id // 2 AS shape_id, CAST(shape_id % 2 AS INT) AS which, x, y, label FROM lb")
def _(spark, sf):
    return G.filter_to_groups_multi(views.hsv(spark, sf), 2.0, [c("v") <= 40, (c("s") <= 15) & (c("v") > 60)])


def _seed(a):
    return a.groupBy("shape_id").agg(F.min(F.struct("x", "y")).alias("p")).select("shape_id", "p.*")


_SEED = ", sd AS (SELECT shape_id, min(CAST(x AS BIGINT) * 4294967296 + y) AS code FROM dark GROUP BY 1)"
one("grp5_derive_group", f"{_reach('SELECT * FROM dark', 9)}{_SEED} SELECT lb.shape_id, x, y FROM lb JOIN sd ON lb.shape_id = sd.shape_id AND label = code", lambda a: G.derive_group(a, _seed(a), 3.0))


@query("grp4_local_group", f"{D}{_reach('SELECT * FROM dark', 4)}{_SEED} SELECT lb.shape_id, x, y FROM lb JOIN sd ON lb.shape_id = sd.shape_id AND label = code")
def _(spark, sf):
    return G.local_group(views.hsv(spark, sf), _seed(_a(spark, sf)), 2.0, c("v") <= 50)


_BIG = ", bg AS (SELECT shape_id, arg_min(label, (-n, label)) AS label FROM (SELECT shape_id, label, count(*) AS n FROM lb GROUP BY 1, 2) GROUP BY 1)"
one("grp6_largest_group", f"{_reach('SELECT * FROM dark', 4)}{_BIG} SELECT lb.shape_id, x, y FROM lb JOIN bg USING (shape_id, label)", lambda a: G.largest_group(G.group_points(a, 2.0)))
one("grp7_group_anchors", f"{_reach('SELECT * FROM dark', 4)}{_BIG}, l AS (SELECT lb.shape_id, x, y FROM lb JOIN bg USING (shape_id, label)), m AS (SELECT shape_id, avg(x) AS cx, avg(y) AS cy FROM l GROUP BY 1) SELECT shape_id, arg_min(x, (round(pow(x - cx, 2) + pow(y - cy, 2), 9), x, y)) AS x, arg_min(y, (round(pow(x - cx, 2) + pow(y - cy, 2), 9), x, y)) AS y FROM l JOIN m USING (shape_id) GROUP BY 1", lambda a: G.group_anchors(G.group_points(a, 2.0)))
one("grp8_anchor_then_local", f"{_reach('SELECT * FROM dark', 4)}{_BIG} SELECT lb.shape_id, x, y FROM lb JOIN bg USING (shape_id, label)", lambda a: G.derive_group(a, G.group_anchors(G.group_points(a, 2.0)), 2.0))
one("grp9_group_by_grid", f"{_reach('SELECT DISTINCT shape_id, x // 3 AS x, y // 3 AS y FROM dark', 2.25)} SELECT dark.shape_id, dark.x, dark.y, label FROM dark JOIN lb ON dark.shape_id = lb.shape_id AND dark.x // 3 = lb.x AND dark.y // 3 = lb.y", lambda a: G.group_by_grid(a, 3))
one("grp11_nearest_group", f"{_reach('SELECT * FROM dark WHERE x < 30', 4)} SELECT lb.shape_id, arg_min(label, (pow(lb.x - d.x, 2) + pow(lb.y - d.y, 2), label)) AS label, sqrt(min(pow(lb.x - d.x, 2) + pow(lb.y - d.y, 2))) AS distance FROM lb JOIN dark d ON lb.shape_id = d.shape_id AND d.x > 45 GROUP BY 1", lambda a: G.nearest_group(G.group_points(a.where("x < 30"), 2.0), a.where("x > 45")))

_VOID = ", dd AS (SELECT DISTINCT shape_id, x + dx AS x, y + dy AS y FROM dark, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (2, 0), (0, 2)) t(dx, dy)), b2 AS (SELECT shape_id, min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1 FROM dd GROUP BY 1)"


def _blobs(a):
    out = a
    for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1), (2, 0), (0, 2)):
        out = out.unionAll(T.translate(a, dx, dy))
    return out.distinct()


#: The outside by recursion from the corner of the padded bounding box, moving over empty cells.
_OUT = _VOID + """, em AS (SELECT shape_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT shape_id, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM b2), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) EXCEPT SELECT * FROM dd),
ou AS (SELECT shape_id, CAST(x0 AS INT) AS x, CAST(y0 AS INT) AS y FROM b2 UNION SELECT em.shape_id, em.x, em.y FROM ou JOIN em ON em.shape_id = ou.shape_id AND {0})"""
_N4 = "abs(em.x - ou.x) + abs(em.y - ou.y) = 1"
_N8 = "greatest(abs(em.x - ou.x), abs(em.y - ou.y)) = 1"
one("set9_fill_enclosed", f"{_OUT.format(_N4)} SELECT * FROM dd UNION (SELECT * FROM em EXCEPT SELECT * FROM ou)", lambda a: G.fill_enclosed(_blobs(a)))
query("set10_remove_holes")(lambda spark, sf: G.remove_holes(_blobs(_a(spark, sf))))
one("set11_fill_small_holes", f"{_OUT.format(_N8)} SELECT * FROM dd UNION (SELECT * FROM em EXCEPT SELECT * FROM ou)", lambda a: G.fill_small_holes(_blobs(a), 100000))
_WSEED = ", ws AS (SELECT frame_id, arg_min((x, y, r, g, b), x * 100 + y) AS p FROM px GROUP BY 1)"


def _wseed(p):
    return p.groupBy("frame_id").agg(F.min_by(F.struct("x", "y"), c("x") * 100 + c("y")).alias("p")).select("frame_id", "p.*")


@query("set8_magic_wand", f"{D}{_WSEED} SELECT frame_id AS shape_id, x, y FROM px JOIN ws USING (frame_id) WHERE abs(r - p[3]) <= 60 AND abs(g - p[4]) <= 60 AND abs(b - p[5]) <= 60")
def _(spark, sf):
    p = views.px(spark, sf)
    return G.magic_wand(p, _wseed(p), 60, contiguous=False)


@query("set8_magic_wand_contiguous")
def _(spark, sf):
    p = views.px(spark, sf)
    return G.magic_wand(p, _wseed(p), 120)
