"""Filter, colour-model, statistics and ordered-lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import views
from rasterloom.functions import predicates as P
from rasterloom.operators import colormodel as CM
from rasterloom.operators import filters as FI
from rasterloom.operators import ordered as O
from rasterloom.operators import stats as S
from rasterloom.queries.scalars import INK_SQL, WHITE_SQL, _INT, pack_sql
from rasterloom.registry import query

c = F.col


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) + 0.0 for n in names})


BOX = "h BETWEEN 90 AND 270 AND s BETWEEN 20 AND 90 AND v BETWEEN 30 AND 80"


def _box():
    return P.hsv_box(c("h"), c("s"), c("v"), (90, 20, 30), (270, 90, 80))


@query("flt4_filter_pixels", f"WITH {views.HSV} SELECT frame_id, x, y FROM hsv WHERE {BOX}")
def _(spark, sf):
    return FI.filter_pixels(views.hsv(spark, sf), _box())


@query("flt5_mask_pixels", f"WITH {views.HSV} SELECT frame_id, x, y, CASE WHEN {BOX} THEN -1 ELSE -16777215 END AS argb FROM hsv")
def _(spark, sf):
    return FI.mask_pixels(views.hsv(spark, sf), _box())


@query("flt6_split_pixels", f"WITH {views.HSV} SELECT frame_id, count(*) FILTER ({BOX}) AS matched, count(*) FILTER (NOT ({BOX})) AS others FROM hsv GROUP BY 1")
def _(spark, sf):
    yes, no = FI.split_pixels(views.hsv(spark, sf), _box())
    tag = lambda d, n: d.select("frame_id", F.lit(n).alias("n"))
    both = tag(yes, 1).unionAll(tag(no, 0))
    return both.groupBy("frame_id").agg(F.sum("n").alias("matched"), F.sum(1 - c("n")).alias("others"))


@query("flt7_first_match", f"WITH {_INT} SELECT frame_id, x, y, CASE WHEN v <= 11 OR (s > 11 AND v <= 25) THEN 0 WHEN {WHITE_SQL} THEN 1 WHEN {INK_SQL} THEN 2 END AS label FROM hi")
def _(spark, sf):
    preds = [P.is_black(c("s"), c("v")), P.is_white(c("s"), c("v")), P.is_default_ink(c("h"), c("s"), c("v"))]
    return FI.first_match(views.hsv(spark, sf), preds).select("frame_id", "x", "y", "label")


_CA = views.ARGB + f", ca AS (SELECT frame_id, x, y, {pack_sql('255', 'r - r % 64', 'g - g % 64', 'b - b % 64')} AS argb FROM ar)"


def _coarse(spark, sf):
    from rasterloom.functions.color import pack_argb

    low = lambda n: c(n) - c(n) % 64
    return views.px(spark, sf).select("frame_id", "x", "y", pack_argb(F.lit(255), low("r"), low("g"), low("b")).alias("argb"))


@query("flt8_pixels_of_color", f"WITH {_CA} SELECT frame_id, x, list(y ORDER BY y) AS ys FROM ca WHERE argb = -16760768 GROUP BY 1, 2")
def _(spark, sf):
    return FI.columns_of_color(_coarse(spark, sf), -16760768)


#: Boundary lines (s0, v0, s1, v1).
LINES = ((0, 40, 30, 70), (35, 70, 60, 50), (60, 50, 90, 20))
_LINES = """ln AS (SELECT * FROM (VALUES (0, 40, 0, 40), (0, 40, 30, 70), (30, 70, 35, 70), (35, 70, 60, 50), (60, 50, 90, 20), (90, 20, 100, 20)) t(s0, v0, s1, v1)),
sv AS (SELECT CAST(s AS INT) AS s, max(floor(least(greatest(CASE WHEN s1 = s0 THEN v0 ELSE v0 + (v1 - v0) * (CAST(s - s0 AS DOUBLE) / (s1 - s0)) END, 0.0), 100.0))) AS edge
 FROM (SELECT *, unnest(range(s0, s1 + 1)) AS s FROM ln) GROUP BY 1),
regions AS (SELECT CAST(hue AS INT) AS hue, s, 0 AS v_lo, CAST(edge AS INT) AS v_hi FROM sv, range(100, 201) t(hue))"""


def _regions(spark):
    lines = spark.createDataFrame(LINES, "s0 int, v0 int, s1 int, v1 int")
    return FI.build_hue_regions(lines, 100, 200)


@query("flt9_build_hue_regions", f"WITH {views.HSV}, {_LINES} SELECT frame_id, r.hue, count(*) AS n, max(v_hi) AS v_hi FROM hsv JOIN regions r ON CAST(floor(h) AS INT) = r.hue AND CAST(floor(hsv.s) AS INT) = r.s GROUP BY 1, 2")
def _(spark, sf):
    p = views.hsv(spark, sf).select("frame_id", F.floor("h").cast("int").alias("hue"), F.floor("s").cast("int").alias("s"))
    return p.join(F.broadcast(_regions(spark)), ["hue", "s"]).groupBy("frame_id", "hue").agg(F.count("*").alias("n"), F.max("v_hi").alias("v_hi"))


_IN = "CAST(floor(h) AS INT) = r.hue AND CAST(floor(hsv.s) AS INT) = r.s AND CAST(floor(v) AS INT) BETWEEN v_lo AND v_hi"


@query("flt10_in_hue_region", f"WITH {views.HSV}, {_LINES} SELECT frame_id, x, y FROM hsv SEMI JOIN regions r ON {_IN}")
def _(spark, sf):
    return FI.in_hue_region(views.hsv(spark, sf), _regions(spark)).select("frame_id", "x", "y")


@query("flt11_expand_regions", f"WITH {views.HSV}, {_LINES}, wide AS (SELECT hue, s2 AS s, greatest(min(v_lo) - 2, 0) AS v_lo, least(max(v_hi) + 2, 100) AS v_hi FROM (SELECT *, unnest(range(s - 3, s + 4)) AS s2 FROM regions) WHERE s2 BETWEEN 0 AND 100 GROUP BY 1, 2) SELECT frame_id, x, y FROM hsv SEMI JOIN wide r ON {_IN}")
def _(spark, sf):
    return FI.in_hue_region(views.hsv(spark, sf), FI.expand_regions(_regions(spark), 3, 2)).select("frame_id", "x", "y")


_BANDS = f"{_INT}, bands AS (SELECT hi % 360 AS hue, si AS sat, min(vi) AS v_min, max(vi) AS v_max, count(*) AS n FROM hi WHERE NOT {WHITE_SQL} GROUP BY 1, 2)"


def _bands(spark, sf):
    return FI.learn_ink_bands(views.hsv(spark, sf), P.is_white(c("s"), c("v")))


@query("flt12_learn_ink_bands", f"WITH {_BANDS} SELECT * FROM bands")
def _(spark, sf):
    return _bands(spark, sf)


@query("flt13_match_ink_bands", f"WITH {_BANDS} SELECT frame_id, x, y FROM hi SEMI JOIN (SELECT * FROM bands WHERE n > 1) b ON hi % 360 = hue AND si = sat AND vi BETWEEN v_min - 1 AND v_max + 1")
def _(spark, sf):
    return FI.match_ink_bands(views.hsv(spark, sf), _bands(spark, sf).where("n > 1")).select("frame_id", "x", "y")


@query("flt14_color_bounds", f"WITH {views.HSV} SELECT frame_id, x, y FROM hsv WHERE abs(h - 200) <= 20 AND abs(s - 60) <= 20 AND abs(v - 60) <= 20")
def _(spark, sf):
    return FI.filter_pixels(views.hsv(spark, sf), FI.color_window(c("h"), c("s"), c("v"), (200, 60, 60), 20.0))


# -- colour models
_MEAN = "mean AS (SELECT frame_id, (degrees(atan2(sum(sin(radians(h))), sum(cos(radians(h))))) + 360) % 360 AS mh, avg(s) AS ms, avg(v) AS mv FROM hsv GROUP BY 1)"
_DEV = _MEAN + ", dev AS (SELECT hsv.*, sqrt(pow(least(abs(h - mh) / 360, 1 - abs(h - mh) / 360), 2) + pow((s - ms) / 100, 2) + pow((v - mv) / 100, 2)) AS deviation FROM hsv JOIN mean USING (frame_id))"


@query("clr1_mean_hsv", f"WITH {views.HSV}, {_MEAN} SELECT frame_id, round(mh, 6) AS h, round(ms, 6) AS s, round(mv, 6) AS v FROM mean")
def _(spark, sf):
    return r6(CM.mean_hsv(views.hsv(spark, sf)), "h", "s", "v")


@query("clr2_hsv_mad", f"WITH {views.HSV}, {_DEV} SELECT frame_id, round(avg(deviation), 6) AS mad FROM dev GROUP BY 1")
def _(spark, sf):
    return r6(CM.hsv_mad(views.hsv(spark, sf)), "mad")


_BUCK = """hb AS (SELECT DISTINCT CAST(unnest(range(floor(h)::INT - floor(h)::INT % 5, floor(h)::INT - floor(h)::INT % 5 + 5)) AS INT) AS hue,
 CAST(floor(s) AS INT) AS s, CAST(floor(v) AS INT) AS v FROM hsv)"""


@query("clr3_hue_buckets", f"WITH {views.HSV}, {_BUCK} SELECT * FROM hb")
def _(spark, sf):
    return CM.hue_buckets(views.hsv(spark, sf))


@query("clr4_sample_regions", f"""WITH {views.HSV}, {_BUCK}, sp AS (SELECT hue, s, min(v) AS lo, max(v) AS hi FROM hb GROUP BY 1, 2),
gr AS (SELECT hue, CAST(unnest(range(min(s), max(s) + 1)) AS INT) AS s FROM sp GROUP BY hue),
e AS (SELECT gr.hue, gr.s, a.s AS s0, a.lo AS l0, a.hi AS h0, b.s AS s1, b.lo AS l1, b.hi AS h1 FROM gr
 ASOF JOIN sp a ON gr.hue = a.hue AND gr.s >= a.s ASOF JOIN sp b ON gr.hue = b.hue AND gr.s <= b.s),
t AS (SELECT *, CASE WHEN s1 = s0 THEN 0.0 ELSE CAST(s - s0 AS DOUBLE) / (s1 - s0) END AS t FROM e)
SELECT hue, s, CAST(greatest(floor(l0 + (l1 - l0) * t) - 2, 0) AS INT) AS v_lo, CAST(least(floor(h0 + (h1 - h0) * t) + 2, 100) AS INT) AS v_hi FROM t""")
def _(spark, sf):
    return CM.sample_regions(views.hsv(spark, sf), 2)


@query("clr5_deviation_bands", f"WITH {views.HSV}, {_DEV} SELECT frame_id, x, y, round(deviation / max(deviation) OVER (PARTITION BY frame_id), 6) AS alpha FROM dev")
def _(spark, sf):
    return r6(CM.deviation_bands(views.hsv(spark, sf)), "alpha").select("frame_id", "x", "y", "alpha")


def _channels(spark, sf):
    from rasterloom.functions.color import unpack_argb

    return views.argb(spark, sf).withColumn("u", unpack_argb(c("argb"))).select("frame_id", "x", "y", "u.*")


_AVG = ", ".join(f"CAST(floor(avg({k}) + 0.5) AS INT) AS m{k}" for k in "argb")


@query("clr6_average_filter", f"WITH {views.ARGB}, m AS (SELECT frame_id, {_AVG} FROM ar GROUP BY 1) SELECT frame_id, x, y, ma AS a, mr AS r, mg AS g, mb AS b FROM ar JOIN m USING (frame_id)")
def _(spark, sf):
    return CM.average_filter(_channels(spark, sf))


@query("clr7_paint_specimen", f"WITH {views.ARGB}, m AS (SELECT frame_id, {_AVG} FROM ar GROUP BY 1) SELECT frame_id, x, y, abs(r - mr) AS r, abs(g - mg) AS g, abs(b - mb) AS b FROM ar JOIN m USING (frame_id)")
def _(spark, sf):
    return CM.paint_specimen(_channels(spark, sf))


# -- statistics on the event series
def _s(spark, sf):
    return views.series(spark, sf)


W = f"WITH {views.SERIES}"
_M = "m AS (SELECT key, avg(value) AS mean FROM series GROUP BY 1)"


@query("sta1_summary", f"{W} SELECT key, round(avg(value), 6) AS mean, count(value) AS n, round(sum(value), 6) AS total FROM series GROUP BY 1")
def _(spark, sf):
    return r6(S.summary(_s(spark, sf)), "mean", "total")


@query("sta2_mean_abs_deviation", f"{W}, {_M} SELECT key, round(avg(abs(value - mean)), 6) AS mad FROM series JOIN m USING (key) GROUP BY 1")
def _(spark, sf):
    return r6(S.mean_abs_deviation(_s(spark, sf)), "mad")


@query("sta3_variances", f"{W} SELECT key, round(var_pop(value), 6) AS var_pop, round(var_samp(value), 6) AS var_samp FROM series GROUP BY 1")
def _(spark, sf):
    return r6(S.variances(_s(spark, sf)), "var_pop", "var_samp")


@query("sta4_abs_deviation", f"{W}, {_M} SELECT key, pos, round(abs(value - mean), 6) AS deviation FROM series JOIN m USING (key)")
def _(spark, sf):
    return r6(S.abs_deviation(_s(spark, sf)), "deviation")


_FEN = """q AS (SELECT key, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM series GROUP BY 1),
f AS (SELECT key, CASE WHEN n >= 4 AND q3 > q1 THEN CAST(floor(q1 - 1.5 * (q3 - q1)) AS BIGINT) ELSE 0 END AS low,
 CASE WHEN n >= 4 AND q3 > q1 THEN CAST(ceil(q3 + 1.5 * (q3 - q1)) AS BIGINT) ELSE 0 END AS high FROM q)"""


@query("sta5_without_outliers", f"{W}, {_FEN} SELECT key, pos, value FROM series JOIN f USING (key) WHERE (low = 0 AND high = 0) OR value BETWEEN low AND high")
def _(spark, sf):
    return S.without_outliers(_s(spark, sf))


@query("sta6_mean_abs_difference", f"{W} SELECT a.key, round(avg(abs(a.value - b.value)), 6) AS difference FROM series a JOIN series b ON a.pos = b.pos + 1 AND a.key % 7 = b.key % 7 GROUP BY 1")
def _(spark, sf):
    s = _s(spark, sf)
    a = s.select((c("key") % 7).alias("k7"), "pos", "value", "key")
    b = s.select((c("key") % 7).alias("k7"), (c("pos") + 1).alias("pos"), c("value").alias("other"))
    both = a.join(b, ["k7", "pos"])
    left, right = both.select("key", "pos", "value"), both.select("key", "pos", c("other").alias("value"))
    return r6(S.mean_abs_difference(left, right), "difference")


@query("sta7_value_range", f"{W} SELECT key, round(arg_max(value, pos) - arg_min(value, pos), 6) + 0.0 AS range FROM series GROUP BY 1")
def _(spark, sf):
    return r6(S.value_range(_s(spark, sf)), "range")


@query("sta8_simpson_area", f"""{W}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY key) AS n, lag(value) OVER (PARTITION BY key ORDER BY pos) AS b FROM series),
l AS (SELECT *, n - 1 - (n - 1) % 2 AS last FROM n)
SELECT key, round(sum(CASE WHEN last = 0 OR i > last THEN 0 WHEN i = 0 OR i = last THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * value) / 3 + sum(CASE WHEN i > last THEN (value + b) / 2 ELSE 0 END), 6) AS area FROM l GROUP BY 1""")
def _(spark, sf):
    return r6(S.simpson_area(_s(spark, sf)), "area")


@query("sta9_lagrange", f"""{W}, nodes AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) * 2 AS x, value AS y FROM series),
q AS (SELECT key, x AS q FROM nodes WHERE x % 8 = 0), n AS (SELECT q.key, q, x, y, x < q AS l, row_number() OVER (PARTITION BY q.key, q, x < q ORDER BY abs(x - q)) AS k FROM q JOIN nodes USING (key) WHERE x <> q),
o AS (SELECT *, row_number() OVER (PARTITION BY key, q ORDER BY k, abs(x - q)) AS o FROM n), p AS (SELECT key, q, x, y FROM o WHERE o <= 4),
b AS (SELECT a.key, a.q, a.x, any_value(a.y) AS y, product((a.q - b.x) / CAST(a.x - b.x AS DOUBLE)) AS b FROM p a JOIN p b ON a.key = b.key AND a.q = b.q AND a.x <> b.x GROUP BY 1, 2, 3)
SELECT key, q AS x, round(sum(y * b), 4) + 0.0 AS y FROM b GROUP BY 1, 2""")
def _(spark, sf):
    nodes = O.rank_of(_s(spark, sf)).select("key", ((c("rank") + 1) * 2).cast("long").alias("x"), c("value").alias("y"))
    out = S.lagrange(nodes, nodes.where("x % 8 = 0").select("key", "x"))
    return out.withColumn("y", F.round("y", 4) + 0.0)


@query("sta10_step_count", f"{W} SELECT key, pos, CAST(list_count(list_filter([5.0, 10.0, 12.31, 20.0], lambda a: a < value)) AS DOUBLE) AS prefast, CAST(list_count(list_filter([5.0, 10.0, 12.31, 20.0], lambda a: a <= value)) AS DOUBLE) AS sloped, list_min(list_filter([5.0, 10.0, 12.31, 20.0], lambda a: a > value)) AS up, list_max(list_filter([5.0, 10.0, 12.31, 20.0], lambda a: a < value)) AS down FROM series")
def _(spark, sf):
    steps = S.add_step(S.remove_step(F.array(*map(F.lit, (5.0, 7.0, 10.0, 20.0))), 7.0), 12.31)
    return _s(spark, sf).select(
        "key", "pos", S.step_count(c("value"), steps, "prefast").alias("prefast"), S.step_count(c("value"), steps).alias("sloped"),
        S.next_step(c("value"), steps).alias("up"), S.previous_step(c("value"), steps).alias("down"),
    )


@query("sta11_ranges", f"{W} SELECT key, pos, CAST(list_sum(list_transform(range(1, pos % 9 + 2), lambda i: i * i)) AS DOUBLE) AS squares, CAST(factorial(CAST(pos % 9 + 1 AS INT)) AS DOUBLE) AS factorial FROM series")
def _(spark, sf):
    top = c("pos") % 9 + 1
    one = F.lit(1).cast("long")
    return _s(spark, sf).select("key", "pos", S.sum_range(one, top, lambda i: i * i).alias("squares"), S.product_range(one, top, lambda i: i).alias("factorial"))


# -- ordered lookup
for mode, op in (("floor", ">="), ("ceiling", "<="), ("lower", ">"), ("higher", "<")):

    def _run(spark, sf, mode=mode):
        s = _s(spark, sf)
        left = s.where("pos % 3 = 0").select("key", "pos")
        return O.asof(left, s.where("pos % 2 = 0"), mode)

    query(f"ord1_asof_{mode}", f"{W} SELECT l.key, l.pos, r.pos AS found_at, r.value AS found FROM (SELECT key, pos FROM series WHERE pos % 3 = 0) l ASOF LEFT JOIN (SELECT * FROM series WHERE pos % 2 = 0) r ON l.key = r.key AND l.pos {op} r.pos")(_run)


@query("ord2_first_meeting", f"{W} SELECT l.key, l.pos, r.pos AS found_at, r.value AS found FROM (SELECT key, pos FROM series WHERE pos % 5 = 0) l ASOF LEFT JOIN (SELECT * FROM series WHERE value > 10) r ON l.key = r.key AND l.pos <= r.pos")
def _(spark, sf):
    s = _s(spark, sf)
    return O.first_meeting(s.where("pos % 5 = 0").select("key", "pos"), s, c("value") > 10)


@query("ord3_rank", f"{W} SELECT key, pos, value, CAST(row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS INT) AS rank FROM series")
def _(spark, sf):
    return O.rank_of(_s(spark, sf))


@query("ord4_lookup", f"{W} SELECT key, a.pos, coalesce(b.value, -1.0) AS value FROM (SELECT key, pos + 1 - (pos % 2) AS pos FROM series) a LEFT JOIN series b USING (key, pos)")
def _(spark, sf):
    s = _s(spark, sf)
    return O.lookup(s.select("key", (c("pos") + 1 - c("pos") % 2).alias("pos")), s, -1.0)


@query("ord5_ranges", f"{W} SELECT key, min(pos) AS first_pos, arg_min(value, pos) AS first, max(pos) AS last_pos, arg_max(value, pos) AS last FROM series WHERE pos >= 100 GROUP BY 1")
def _(spark, sf):
    return O.ends(O.sub_range(_s(spark, sf), low=100))


@query("ord6_neighbours", f"{W} SELECT key, pos, lag(value) OVER w AS previous, value, lead(value) OVER w AS next FROM series WINDOW w AS (PARTITION BY key ORDER BY pos)")
def _(spark, sf):
    return O.neighbours(_s(spark, sf))


@query("ord7_closest", f"{W} SELECT key, arg_min(pos, (abs(value - 10.0), pos)) AS closest, arg_min(pos, (-abs(value - 10.0), pos)) AS furthest, min(abs(value - 10.0)) <= 1.0 AS within_one FROM series GROUP BY 1")
def _(spark, sf):
    return O.closest(_s(spark, sf), 10.0)


_ARR = "arr AS (SELECT key, list(value ORDER BY pos) AS v FROM series GROUP BY 1)"


@query("ord8_slices", f"""{W}, {_ARR} SELECT key, v[4:] AS from_index, v[:greatest(len(v) - 3, 0)] AS but_last,
 list_transform(list_filter(list_zip(v, range(len(v))), lambda p: p[2] % 2 = 0), lambda p: p[1]) AS even, list_transform(list_filter(list_zip(v, range(len(v))), lambda p: p[2] % 2 = 1), lambda p: p[1]) AS odd,
 v[CAST(floor(len(v) * 0.25) AS INT) + 1:CAST(floor(len(v) * 0.5) AS INT)] AS part, v[greatest(len(v) - 3, 0) + 1:] AS last_n, v[len(v) - 2] AS from_end FROM arr WHERE len(v) > 4""")
def _(spark, sf):
    arrays = O.group_values(_s(spark, sf)).where(F.size("values") > 4)
    return arrays.select("key", *[v.alias(k) for k, v in O.slices(c("values"), 3, (0.25, 0.5)).items()])


@query("ord9_invert", f"{W} SELECT value, list_sort(list(DISTINCT key)) AS keys, arg_max(key, pos) AS last_key FROM series GROUP BY 1")
def _(spark, sf):
    s = _s(spark, sf)
    return O.invert(s).join(O.invert_unique(s).withColumnRenamed("key", "last_key"), "value")


@query("ord10_group_values", f"{W} SELECT key, list(value ORDER BY pos) AS in_order, list_sort(list(DISTINCT value)) AS distinct_values FROM series GROUP BY 1")
def _(spark, sf):
    s = _s(spark, sf)
    return O.group_values(s).withColumnRenamed("values", "in_order").join(O.group_values(s, True).withColumnRenamed("values", "distinct_values"), "key")


@query("ord11_nested", f"{W}, p AS (SELECT key, pos % 3 AS part, list(value ORDER BY pos) AS v FROM series GROUP BY 1, 2), n AS (SELECT key, flatten(list(v ORDER BY part)) AS flat FROM p GROUP BY 1) SELECT key, flat, list_min(flat) AS low, list_max(flat) AS high FROM n")
def _(spark, sf):
    parts = _s(spark, sf).groupBy("key", (c("pos") % 3).alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    nested = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", F.transform("v", lambda r: r["value"]).alias("v")))).alias("n"))
    flat = F.flatten(F.transform("n", lambda r: r["v"]))
    return nested.select("key", flat.alias("flat"), F.array_min(flat).alias("low"), F.array_max(flat).alias("high"))


@query("ord12_integers_between", f"{W} SELECT key, min(pos) AS low, CAST(len(range(min(pos), max(pos) + 1)) AS INT) AS n FROM series GROUP BY 1")
def _(spark, sf):
    g = _s(spark, sf).groupBy("key").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    # Counted, not listed: a list is as long as the range, whatever the number of rows.
    return g.select("key", "low", (c("high") - c("low") + 1).cast("int").alias("n"))


@query("grp10_group_1d", f"{W}, b AS (SELECT *, CASE WHEN value - lag(value) OVER (PARTITION BY key ORDER BY value, pos) > 1.5 THEN 1 ELSE 0 END AS cut FROM series) SELECT key, pos, value, CAST(sum(cut) OVER (PARTITION BY key ORDER BY value, pos) AS BIGINT) AS grp FROM b")
def _(spark, sf):
    return O.group_1d(_s(spark, sf), 1.5)
