"""Contour queries on the outlines of the dark points."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import views
from rasterloom.operators import contours as K
from rasterloom.operators import layers as L
from rasterloom.operators import points as T
from rasterloom.registry import query

c = F.col
P = f"WITH RECURSIVE {views.POLY}"


def one(name, fn, sql=None, view=views.poly):
    query(name, sql and f"{P} {sql}")(lambda spark, sf: fn(view(spark, sf)))


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) + 0.0 for n in names})


one("ctr1_boundary", lambda d: K.boundary(T.dilate(d, 2)), ", di AS (SELECT CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy FROM range(-2, 3) t(dx), range(-2, 3) u(dy) WHERE dx * dx + dy * dy <= 4), dl AS (SELECT DISTINCT shape_id, x + dx AS x, y + dy AS y FROM dark, di) SELECT shape_id, x, y FROM dl WHERE NOT ((shape_id, x + 1, y) IN (SELECT (shape_id, x, y) FROM dl) AND (shape_id, x - 1, y) IN (SELECT (shape_id, x, y) FROM dl) AND (shape_id, x, y + 1) IN (SELECT (shape_id, x, y) FROM dl) AND (shape_id, x, y - 1) IN (SELECT (shape_id, x, y) FROM dl))".replace(" SELECT shape_id, x, y FROM dl WHERE", " SELECT shape_id, x, y FROM dl WHERE", 1), view=views.dark)
one("ctr2_trace", lambda d: K.trace(T.dilate(d, 2)), view=views.dark)
one("ctr3_bridge", lambda d: K.bridge(T.dilate(d, 1), 4), view=views.dark)
_AT = "att AS (SELECT p.*, cx, cy, (atan2(y - cy, x - cx) + 2 * pi()) % (2 * pi()) AS raw, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS radius FROM poly p JOIN (SELECT shape_id, avg(x) AS cx, avg(y) AS cy FROM poly GROUP BY 1) USING (shape_id))"
_ARC = "ar0 AS (SELECT shape_id, ord, x, y, nx, ny, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS len FROM ed), arc AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY shape_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS arc, sum(len) OVER (PARTITION BY shape_id) AS total FROM ar0)"
one("ctr4_attributes", lambda d: r6(K.attributes(d), "cx", "cy", "raw", "radius", "arc").select("shape_id", "ord", "cx", "cy", "raw", "radius", "arc"), f", {_AT}, {_ARC} SELECT att.shape_id, att.ord, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(raw, 6) + 0.0 AS raw, round(radius, 6) + 0.0 AS radius, round(arc.arc, 6) + 0.0 AS arc FROM att JOIN arc ON att.shape_id = arc.shape_id AND att.ord = arc.ord")
one("ctr5_measures", lambda d: r6(K.measures(d), "perimeter"), "SELECT shape_id, round(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))), 6) AS perimeter, sum(x * ny - nx * y) / 2.0 AS area, CASE WHEN sum(x * ny - nx * y) > 0 THEN 'counter-clockwise' WHEN sum(x * ny - nx * y) < 0 THEN 'clockwise' ELSE 'flat' END AS orientation FROM ed GROUP BY 1")
one("ctr6_edges", K.edges, "SELECT * FROM ed")
one("ctr6_edge_at", lambda d: K.edge_at(d, -3), "SELECT ed.* FROM ed JOIN pn USING (shape_id) WHERE ord = n - 3")


def _angles(d):
    a = F.array(*map(F.lit, (0.1, 1.3, 2.9, 4.0, 6.2)))
    return d.select("shape_id").distinct().select("shape_id", F.explode(a).alias("angle"))


_DEL = "round(least(abs(raw - angle), 2 * pi() - abs(raw - angle)), 9)"
one("ctr7_at_angle", lambda d: r6(K.at_angle(d, _angles(d)), "radius").drop("ray_x", "ray_y"), f", {_AT} SELECT shape_id, angle, arg_min(ord, ({_DEL}, ord)) AS ord, arg_min(x, ({_DEL}, ord)) AS x, arg_min(y, ({_DEL}, ord)) AS y, round(arg_min(radius, ({_DEL}, ord)), 6) AS radius FROM att, (SELECT unnest([0.1, 1.3, 2.9, 4.0, 6.2])::DOUBLE AS angle) GROUP BY 1, 2")


def _shares(d):
    a = F.array(*map(F.lit, (0.0, 0.123, 0.5, 0.77, 0.999)))
    return d.select("shape_id").distinct().select("shape_id", F.explode(a).alias("share"))


one("ctr8_at_arc", lambda d: r6(K.at_arc(d, _shares(d)), "x", "y"), f", {_ARC} SELECT shape_id, share, ord, round(x + (nx - x) * ((share * total - arc) / len), 6) + 0.0 AS x, round(y + (ny - y) * ((share * total - arc) / len), 6) + 0.0 AS y FROM arc, (SELECT unnest([0.0, 0.123, 0.5, 0.77, 0.999])::DOUBLE AS share) WHERE arc <= share * total AND share * total < arc + len")


def _qs(d):
    a = F.array(*[F.struct(F.lit(x).alias("qx"), F.lit(y).alias("qy")) for x, y in ((5, 5), (30, 20), (60, 47))])
    return d.select("shape_id").distinct().select("shape_id", F.explode(a).alias("q")).select("shape_id", "q.*")


_Q = "(VALUES (5, 5), (30, 20), (60, 47)) q(qx, qy)"
_T = "least(greatest(coalesce(((qx - x) * (nx - x) + (qy - y) * (ny - y)) / CAST(nullif((nx - x) * (nx - x) + (ny - y) * (ny - y), 0) AS DOUBLE), 0), 0), 1)"
one("ctr9_nearest_vertex", lambda d: K.nearest_vertex(d, _qs(d)), f"SELECT shape_id, qx, qy, arg_min(ord, (pow(x - qx, 2) + pow(y - qy, 2), ord)) AS ord, sqrt(min(pow(x - qx, 2) + pow(y - qy, 2))) AS distance FROM poly, {_Q} GROUP BY 1, 2, 3")
one("ctr9_nearest_on_edges", lambda d: r6(K.nearest_on_edges(d, _qs(d)), "distance"), f"SELECT shape_id, qx, qy, round(min(sqrt(pow(qx - x - (nx - x) * {_T}, 2) + pow(qy - y - (ny - y) * {_T}, 2))), 6) AS distance FROM ed, {_Q} GROUP BY 1, 2, 3")


def _cells(d):
    from rasterloom.operators.sets import canvas

    return canvas(d, 64, 50)


_IN = """, cv AS (SELECT shape_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM pn, range(64) t(x), range(50) u(y)),
ins AS (SELECT cv.shape_id, cv.x, cv.y, coalesce(bool_or((ny - ed.y) * (cv.x - ed.x) - (nx - ed.x) * (cv.y - ed.y) = 0 AND cv.x BETWEEN least(ed.x, nx) AND greatest(ed.x, nx) AND cv.y BETWEEN least(ed.y, ny) AND greatest(ed.y, ny)), false)
 OR coalesce(sum(CASE WHEN (ed.y > cv.y) <> (ny > cv.y) AND cv.x < ed.x + CAST((cv.y - ed.y) * (nx - ed.x) AS DOUBLE) / nullif(ny - ed.y, 0) THEN 1 ELSE 0 END), 0) % 2 = 1 AS inside FROM cv LEFT JOIN ed ON cv.shape_id = ed.shape_id GROUP BY 1, 2, 3)"""
one("ctr10_in_contour", lambda d: K.in_contour(_cells(d), d), f"{_IN} SELECT * FROM ins")
one("ctr11_contains", lambda d: K.contains_points(_cells(d).where("x between 20 and 24 and y between 20 and 24"), d), f"{_IN} SELECT shape_id, bool_and(inside) AS contained FROM ins WHERE x BETWEEN 20 AND 24 AND y BETWEEN 20 AND 24 GROUP BY 1")
one("ctr12_inside_points", lambda d: K.in_contour(_cells(d), d).where("inside").drop("inside"), f"{_IN} SELECT shape_id, x, y FROM ins WHERE inside")
_RAS = """, hit AS (SELECT shape_id, col AS x, y + (ny - y) * ((col + 0.5::DOUBLE - x) / (nx - x)) AS c_at FROM (SELECT *, CAST(unnest(range(least(x, nx), greatest(x, nx))) AS INT) AS col FROM ed WHERE x <> nx)),
pr AS (SELECT *, row_number() OVER (PARTITION BY shape_id, x ORDER BY c_at) AS k, lead(c_at) OVER (PARTITION BY shape_id, x ORDER BY c_at) AS to_ FROM hit),
ras AS (SELECT shape_id, x, CAST(unnest(range(CAST(ceil(c_at - 0.5) AS INT), CAST(floor(to_ - 0.5) AS INT) + 1)) AS INT) AS y FROM pr WHERE k % 2 = 1 AND to_ IS NOT NULL UNION SELECT shape_id, x, y FROM poly)"""
one("ctr13_rasterize", K.rasterize, f"{_RAS} SELECT * FROM ras")
one("ctr14_expand", lambda d: K.expand(d, 2))
one("ctr14_contract", lambda d: K.contract(d, 1))
one("ctr15_outer_edge", lambda d: r6(K.outer_edge(d), "radius"))
one("ctr16_halfway", lambda d: K.halfway(d, K.translate(d, 4, 0)))
one("ctr17_curvatures", lambda d: r6(K.curvatures(d), "curvature"), ", pv AS (SELECT ed.*, p.x AS px, p.y AS py FROM ed JOIN pn USING (shape_id) JOIN poly p ON p.shape_id = ed.shape_id AND p.ord = (ed.ord + n - 1) % n), dn AS (SELECT *, sqrt(pow(x - px, 2) + pow(y - py, 2)) * sqrt(pow(nx - x, 2) + pow(ny - y, 2)) * sqrt(pow(nx - px, 2) + pow(ny - py, 2)) AS den FROM pv) SELECT shape_id, ord, round(CASE WHEN den > 0 THEN 2.0 * ((x - px) * (ny - py) - (y - py) * (nx - px)) / den ELSE 0 END, 6) + 0.0 AS curvature, nx - 2 * x + px AS ddx, ny - 2 * y + py AS ddy FROM dn")
one("ctr18_span_curvature", lambda d: r6(K.span_curvature(T.spans(d)), "second"), "SELECT shape_id, x, round(second, 6) + 0.0 AS second FROM (SELECT shape_id, x, 2.0 * ((lead(y_lo) OVER w - y_lo) / CAST(lead(x) OVER w - x AS DOUBLE) - (y_lo - lag(y_lo) OVER w) / CAST(x - lag(x) OVER w AS DOUBLE)) / (lead(x) OVER w - lag(x) OVER w) AS second FROM (SELECT shape_id, x, min(y) AS y_lo FROM dark GROUP BY 1, 2) WINDOW w AS (PARTITION BY shape_id ORDER BY x)) WHERE second IS NOT NULL", view=views.dark)
one("ctr19_resample", lambda d: r6(K.resample(d, 24), "x", "y"))
one("ctr19_best_shift", lambda d: r6(K.best_shift(d, d, 24), "rmse"), "SELECT shape_id, 0 AS shift, 0.0::DOUBLE AS rmse FROM pn")
one("ctr20_edits", lambda d: K.remove_vertices(K.add_vertex(d, 1, 99, 99), T.translate(d, 0, 0).where("x % 2 = 0")), "SELECT shape_id, CAST(row_number() OVER (PARTITION BY shape_id ORDER BY o) - 1 AS INT) AS ord, x, y FROM (SELECT shape_id, ord::DOUBLE AS o, x, y FROM poly WHERE (shape_id, x, y) NOT IN (SELECT (shape_id, x, y) FROM poly WHERE x % 2 = 0) UNION ALL SELECT shape_id, 0.5, 99, 99 FROM pn)")
one("ctr20_sort_by_angle", K.sort_by_angle, f", {_AT} SELECT shape_id, CAST(row_number() OVER (PARTITION BY shape_id ORDER BY round(raw, 9), radius, ord) - 1 AS INT) AS ord, x, y FROM att")
one("ctr21_walk_side", lambda d: K.walk_side(d, upper=False, ascending=False), "SELECT shape_id, CAST(row_number() OVER (PARTITION BY shape_id ORDER BY x DESC) - 1 AS INT) AS step, x, min(y) AS y FROM dark GROUP BY shape_id, x", view=views.dark)
one("ctr21_walk_rows", K.walk_rows, ", o AS (SELECT *, dense_rank() OVER (PARTITION BY shape_id ORDER BY y) % 2 = 0 AS odd FROM dark), w AS (SELECT shape_id, CAST(row_number() OVER w - 1 AS INT) AS step, x, y, lead(x) OVER w AS to_x, lead(y) OVER w AS to_y FROM o WINDOW w AS (PARTITION BY shape_id ORDER BY y, CASE WHEN odd THEN -x ELSE x END)) SELECT * FROM w WHERE to_x IS NOT NULL", view=views.dark)
one("pts25_fill_missing_columns", lambda d: K.fill_missing_columns(d.select("shape_id", "x", "y"), d, 2))
one("pts26_smooth_outline", lambda d: K.smooth_outline(d.select("shape_id", "x", "y"), d))
one("pts27_smooth_path", lambda d: r6(K.smooth_path(d, 3), "x", "y"), ", tp AS (SELECT CAST(d AS INT) AS d, exp(-2.0 * d * d / 9) AS w FROM range(-3, 4) t(d)) SELECT ed.shape_id, CAST((ed.ord + d + n) % n AS INT) AS ord, round(sum(x * w) / sum(w), 6) AS x, round(sum(y * w) / sum(w), 6) AS y FROM ed JOIN pn USING (shape_id), tp GROUP BY 1, 2")
one("pts28_outline_width", lambda d: r6(K.outline_width(K.draw_lines(K.edges(d).select("shape_id", c("x").alias("x0"), c("y").alias("y0"), c("nx").alias("x1"), c("ny").alias("y1"))), d), "width"))
_BRUSH = L.Brush(-16776961, 3)
one("cmp10_stroke_contour", lambda d: r6(L.stamp_points(K.stroke(d, 2.5), _BRUSH), "coverage"))
