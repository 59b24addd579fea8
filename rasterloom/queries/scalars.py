"""Colour, numeric and predicate queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterloom import views
from rasterloom.functions import color as C
from rasterloom.functions import numeric as N
from rasterloom.functions import predicates as P
from rasterloom.registry import query

c, lit = F.col, F.lit
KEY = ("frame_id", "x", "y")


def r6(**cols):
    """Double columns rounded to six places, so that engines agree on the last bits."""
    return [(F.round(v, 6) + 0.0).alias(k) for k, v in cols.items()]


def s6(**cols):
    return ", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in cols.items())


def named(**cols):
    return [v.alias(k) for k, v in cols.items()]


def scalar(name, view, cte, rounded=None, plain=None, source=None):
    """Register a projection: {column: (function giving the Spark expression, SQL expression)}."""
    rounded, plain = rounded or {}, plain or {}
    parts = ["frame_id", "x", "y"] + [f"{v[1]} AS {k}" for k, v in plain.items()]
    parts += [f"round({v[1]}, 6) + 0.0 AS {k}" for k, v in rounded.items()]
    sql = f"WITH {cte} SELECT {', '.join(parts)} FROM {source or cte_name(cte)}"

    def run(spark, sf_dir):
        cols = named(**{k: v[0]() for k, v in plain.items()}) + r6(**{k: v[0]() for k, v in rounded.items()})
        return view(spark, sf_dir).select(*KEY, *cols)

    query(name, sql)(run)


def cte_name(cte):
    return {views.PX: "px", views.ARGB: "ar", views.HSV: "hsv", views.DARK: "dark"}[cte]


def _ch(i):
    return C.channel(c("argb"), i)


def pack_sql(a, r, g, b):
    """Signed 32-bit packing of channel expressions."""
    u = f"(({a}) * 16777216::BIGINT + ({r}) * 65536 + ({g}) * 256 + ({b}))"
    return f"CAST(CASE WHEN {u} >= 2147483648 THEN {u} - 4294967296 ELSE {u} END AS INT)"


ARGB_SQL = pack_sql("a", "r", "g", "b")

scalar("col1_unpack_argb", views.argb, views.ARGB, plain={k: (lambda k=k: C.unpack_argb(c("argb"))[k], k) for k in "argb"})
scalar("col2_pack_argb", views.argb, views.ARGB, plain={
    "packed": (lambda: c("argb"), ARGB_SQL),
    "clamped": (lambda: C.pack_argb(_ch(24) + 100, _ch(16) - 100, _ch(8) * 2, _ch(0)), pack_sql("least(a + 100, 255)", "greatest(r - 100, 0)", "least(g * 2, 255)", "b")),
})
scalar("col3_alpha", views.argb, views.ARGB, plain={
    "halved": (lambda: C.with_alpha(c("argb"), F.floor(_ch(24) / 2)), pack_sql("a // 2", "r", "g", "b")),
    "opaque": (lambda: C.impose_alpha(c("argb")), pack_sql("255", "r", "g", "b")),
})
scalar("col4_rgb_to_hsv", views.hsv, views.HSV, rounded={k: (lambda k=k: c(k), k) for k in "hsv"})


def _back():
    return C.hsv_to_rgb(c("h"), c("s"), c("v"))


scalar("col5_hsv_to_rgb", views.hsv, views.HSV, plain={k + "2": (lambda k=k: _back()[k], k) for k in "rgb"})
scalar("col6_scales", views.hsv, views.HSV, rounded={
    "h01": (lambda: N.normalize_range(c("h"), 0.0, 360.0), "h / 360.0"),
    "back": (lambda: N.denormalize_range(c("s") / 100, 0.0, 100.0), "s / 100 * 100"),
    "v255": (lambda: N.convert_scale(c("v"), 0.0, 100.0, 0.0, 255.0), "v / 100.0 * 255.0"),
})

_LIN = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
_T = [
    "(" + " + ".join(f"{m!r} * {ch}l" for m, ch in zip(row, "rgb")) + f") / {w!r}" for row, w in zip(C.SRGB_TO_XYZ_D50, C.WHITE_D50)
]
LAB = views.PX + f""", lin AS (SELECT *, {', '.join(_LIN.format(ch) + f' AS {ch}l' for ch in 'rgb')} FROM px),
xyz AS (SELECT *, {', '.join(f'{t} AS t{n}' for t, n in zip(_T, 'xyz'))} FROM lin),
fxyz AS (SELECT *, {', '.join(f'CASE WHEN t{n} > 216.0 / 24389.0 THEN pow(t{n}, 1 / 3.0) ELSE (t{n} * (24389.0 / 27.0) + 16.0) / 116.0 END AS f{n}' for n in 'xyz')} FROM xyz),
lab AS (SELECT frame_id, x, y, CAST(trunc((fy * 116 - 16) * 2.55 + 0.5) AS INT) AS l, CAST(trunc((fx - fy) * 500 + 0.5) AS INT) AS a,
 CAST(trunc((fy - fz) * 200 + 0.5) AS INT) AS b FROM fxyz)"""


def _lab():
    return C.rgb_to_lab(c("r"), c("g"), c("b"))


scalar("col7_rgb_to_lab", views.px, LAB, plain={k: (lambda k=k: _lab()[k], k) for k in "lab"}, source="lab")
scalar("col8_color_difference", views.px, LAB, rounded={
    "difference": (lambda: C.color_difference(_lab(), C.rgb_to_lab(lit(140), lit(140), lit(200))), "sqrt(pow(l - 153, 2) + pow(a - 10, 2) + pow(b - (-30), 2))"),
}, source="lab")

def _ar():
    return _ch(24), _ch(16), _ch(8), _ch(0)


scalar("col9_darkness", views.argb, views.ARGB, rounded={
    "darkness": (lambda: C.darkness(*_ar()), f"least(greatest((1.0 - (({_LIN.format('r')}) * 0.2126 + ({_LIN.format('g')}) * 0.7152 + ({_LIN.format('b')}) * 0.0722)) * (a / 255.0), 0), 1)"),
})
scalar("col10_darkness_mean", views.argb, views.ARGB, rounded={"darkness": (lambda: C.darkness_mean(*_ar()), "(1.0 - (r + g + b) / 765.0) * (a / 255.0)")})

def _q():
    return F.struct(lit(350.0).alias("h"), lit(50.0).alias("s"), lit(50.0).alias("v"))


scalar("col11_hsv_distance", views.hsv, views.HSV, rounded={
    "distance": (lambda: C.hsv_distance(F.struct("h", "s", "v"), _q()), "sqrt(pow(least(abs(h - 350) / 360, 1 - abs(h - 350) / 360), 2) + pow((s - 50) / 100, 2) + pow((v - 50) / 100, 2))"),
})
scalar("col12_hex_color", views.argb, views.ARGB, plain={
    "hex": (lambda: C.hex_color(c("argb")), "'#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0')"),
    "back": (lambda: C.from_hex_color(C.hex_color(c("argb"))), pack_sql("255", "r", "g", "b")),
})

# -- numbers, on h, s, v and r, g, b
scalar("num1_clamps", views.hsv, views.HSV, rounded={
    "bounded": (lambda: N.bound(c("h"), 90.0, 270.0), "least(greatest(h, 90.0), 270.0)"),
    "pos": (lambda: N.pos_bound(c("s") - 50), "greatest(s - 50, 0.0)"),
    "neg": (lambda: N.neg_bound(c("s") - 50), "least(s - 50, 0.0)"),
    "unit": (lambda: N.clamp01(c("v") / 50 - 0.5), "least(greatest(v / 50 - 0.5, 0.0), 1.0)"),
}, plain={"percent": (lambda: N.clamp_percent(c("h") - 100), "CAST(least(greatest(floor(h - 100), 0), 100) AS INT)")})
scalar("num2_rounding", views.hsv, views.HSV, rounded={
    "tenth": (lambda: N.round_to(c("h"), 0.1), "floor(h * (10.0 / (0.1 * 10.0)) + 0.5) / (10.0 / (0.1 * 10.0))"),
    "greater": (lambda: N.round_if_greater(c("s"), 0.7), "CASE WHEN s % 1.0 >= 0.7 THEN floor(s + 0.5) ELSE floor(s) END"),
    "lesser": (lambda: N.round_if_lesser(c("s"), 0.3), "CASE WHEN s % 1.0 <= 0.3 THEN floor(s + 0.5) ELSE ceil(s) END"),
    "threshold": (lambda: N.round_if_threshold(c("v"), 0.25, 0.75), "CASE WHEN v % 1.0 >= 0.75 THEN ceil(v) WHEN v % 1.0 <= 0.25 THEN floor(v) ELSE v END"),
})
scalar("num3_intervals", views.hsv, views.HSV, plain={
    "open": (lambda: N.between_open(c("r"), 10, 200), "r > 10 AND r < 200"),
    "closed": (lambda: N.between_closed(c("r"), 10, 200), "r >= 10 AND r <= 200"),
    "band": (lambda: N.within(c("r"), c("g"), 1.25), "r > g - g * (1.25 - 1) AND r <= g + g * (1.25 - 1)"),
    "above": (lambda: N.within_pos(c("r"), c("g") + 1, 20), "(r - (g + 1)) / (g + 1) * 100.0 >= 0 AND (r - (g + 1)) / (g + 1) * 100.0 <= 20"),
    "below": (lambda: N.within_neg(c("r"), c("g") + 1, 20), "(r - (g + 1)) / (g + 1) * 100.0 <= 0 AND (r - (g + 1)) / (g + 1) * 100.0 >= -20"),
})
scalar("num4_modulo", views.px, views.PX, plain={
    "low": (lambda: N.lim_mod(c("r"), 7), "r - r % 7"),
    "next": (lambda: N.next_mod(c("r"), 7), "r + (7 - r % 7)"),
    "even": (lambda: N.divisible(c("r"), 2), "r % 2 = 0"),
    "multiples": (lambda: F.size(N.mod_range(F.least("r", "g"), F.greatest("r", "g"), 16)), "CAST((greatest(r, g) - (least(r, g) - least(r, g) % 16)) // 16 + 1 AS INT)"),
})
scalar("num5_closer", views.px, views.PX, plain={
    "near": (lambda: N.closer(c("r"), c("g"), c("b")), "CASE WHEN abs(g - r) > abs(b - r) THEN b ELSE g END"),
    "near_is_g": (lambda: N.closer(c("r"), c("g"), c("b")) == c("g"), "CASE WHEN abs(g - r) > abs(b - r) THEN b ELSE g END = g"),
    "far": (lambda: N.farther(c("r"), c("g"), c("b")), "CASE WHEN abs(g - r) < abs(b - r) THEN b ELSE g END"),
})
scalar("num6_interpolation", views.hsv, views.HSV, rounded={
    "lerped": (lambda: N.lerp(c("h"), c("s"), 0.3), "h + (s - h) * 0.3"),
    "inverse": (lambda: N.inverse_lerp(c("r").cast("double"), c("g").cast("double"), c("b").cast("double")), "CASE WHEN r = g THEN 0.0 ELSE (b - r) / CAST(g - r AS DOUBLE) END"),
    "remapped": (lambda: N.remap(c("v"), 0.0, 100.0, -1.0, 1.0), "-1.0 + 2.0 * (v / 100.0)"),
    "middle": (lambda: N.midpoint(c("h"), c("s")), "(h + s) / 2.0"),
}, plain={"lerp_int": (lambda: N.lerp_int(c("r"), c("g"), 0.3), "CAST(floor(r + (g - r) * 0.3 + 0.5) AS INT)")})
_PI = repr(math.pi)

def _rad():
    return F.radians(c("h"))


def _rad2():
    return F.radians(c("s") * 3.6)


scalar("num7_angles", views.hsv, views.HSV, rounded={
    "wrapped": (lambda: N.wrap(c("h") - 180, 90.0), "(((h - 180) % 90.0) + 90.0) % 90.0"),
    "radians": (lambda: N.normalize_angle(_rad() - 1), f"((radians(h) - 1) % (2 * {_PI}) + 2 * {_PI}) % (2 * {_PI})"),
    "delta": (lambda: N.angle_delta(_rad(), _rad2()), f"least(abs(radians(h) - radians(s * 3.6)), 2 * {_PI} - abs(radians(h) - radians(s * 3.6)))"),
    "circle": (lambda: N.circular_distance(c("h") / 720, c("v") / 200), "least(abs(h / 720 - v / 200), 1 - abs(h / 720 - v / 200))"),
    "orientation": (lambda: N.orientation_distance(_rad() / 4, lit(0.0)), f"least(radians(h) / 4, {_PI} - radians(h) / 4) / ({_PI} / 2)"),
})
scalar("num8_small_functions", views.hsv, views.HSV, rounded={
    "roc": (lambda: N.rate_of_change(c("r"), c("g").cast("double"), c("b"), c("v")), "(v - g) / nullif(b - r, 0)"),
    "inverse": (lambda: N.reciprocal(c("h")), "1.0 / nullif(h, 0)"),
    "squared": (lambda: N.square(c("s")), "s * s"),
    "cubed": (lambda: N.cube(c("v") / 100), "pow(v / 100, 3)"),
    "part": (lambda: N.decimal_part(c("h")), "h % 1.0"),
    "filled": (lambda: N.non_zero(c("h"), 1.0), "CASE WHEN h = 0 THEN 1.0 ELSE h END"),
}, plain={
    "sign": (lambda: N.sign_clamp(c("r") - c("g")), "CASE WHEN r - g < 0 THEN -1 ELSE 1 END"),
    "same": (lambda: N.same_sign(c("r") - 128, c("g") - 128), "(r < 128) = (g < 128)"),
})

def _p():
    return N.point(c("x"), c("y"))


def _a():
    return N.point(c("r"), c("g"))


def _b():
    return N.point(c("b"), c("r"))


_n = "CAST((b - r) * (b - r) + (r - g) * (r - g) AS DOUBLE)"
_f = f"CASE WHEN {_n} = 0 THEN 0.0 ELSE ((x - r) * (b - r) + (y - g) * (r - g)) / {_n} END"
_t = f"least(greatest({_f}, 0.0), 1.0)"
_qx, _qy = f"floor(r + (b - r) * {_t} + 0.5)", f"floor(g + (r - g) * {_t} + 0.5)"
scalar("num9_segments", views.px, views.PX, rounded={
    "factor": (lambda: N.projection_factor(_p(), _a(), _b()), _f),
    "distance": (lambda: N.distance_to_segment(_p(), _a(), _b()), f"sqrt(pow(x - {_qx}, 2) + pow(y - {_qy}, 2))"),
}, plain={
    "turn": (lambda: N.cross_points(_a(), _b(), _p()), "(b - r) * (y - g) - (r - g) * (x - r)"),
    "qx": (lambda: N.project_to_segment(_p(), _a(), _b())["x"], f"CAST({_qx} AS INT)"),
})
_d = "sqrt(pow({0} - {2}, 2) + pow({1} - {3}, 2))"
_den = f"({_d.format('x', 'y', 'r', 'g')} * {_d.format('r', 'g', 'b', 'r')} * {_d.format('b', 'r', 'x', 'y')})"
scalar("num10_curvature", views.px, views.PX, rounded={
    "curve": (lambda: F.nanvl(N.curvature(_p(), _a(), _b()), lit(0.0)), f"CASE WHEN {_den} > 0 THEN 2.0 * ((r - x) * (r - y) - (g - y) * (b - x)) / {_den} ELSE 0.0 END"),
})

def _v():
    return N.point(c("r") + 1.0, c("g") + 2.0)


def _w():
    return N.point(c("b") + 1.0, c("r") - 3.0)


scalar("num11_vectors", views.px, views.PX, rounded={
    "length": (lambda: N.vec_length(_v()), "sqrt((r + 1.0) * (r + 1.0) + (g + 2.0) * (g + 2.0))"),
    "scaled": (lambda: N.vec_scale(_v(), 1.5)["x"], "(r + 1.0) * 1.5"),
    "dotted": (lambda: N.vec_dot(_v(), _w()), "(r + 1.0) * (b + 1.0) + (g + 2.0) * (r - 3.0)"),
    "crossed": (lambda: N.vec_cross(_v(), _w()), "(r + 1.0) * (r - 3.0) - (g + 2.0) * (b + 1.0)"),
    "unit": (lambda: N.vec_normalize(_v())["y"], "(g + 2.0) / sqrt((r + 1.0) * (r + 1.0) + (g + 2.0) * (g + 2.0))"),
    "perp": (lambda: N.vec_perpendicular(_v())["x"], "-(g + 2.0)"),
    "angle": (lambda: N.vec_angle(_v()), "atan2(g + 2.0, r + 1.0)"),
    "projected": (lambda: N.vec_project(_v(), _w())["x"], "(b + 1.0) * (((r + 1.0) * (b + 1.0) + (g + 2.0) * (r - 3.0)) / ((b + 1.0) * (b + 1.0) + (r - 3.0) * (r - 3.0)))"),
    "reflected": (lambda: N.vec_reflect(_v(), N.point(0.0, 1.0))["y"], "-(g + 2.0)"),
    "turned": (lambda: N.vec_rotate(_v(), 0.5)["x"], "(r + 1.0) * cos(0.5) - (g + 2.0) * sin(0.5)"),
})

def _l():
    return N.line(c("r"), c("g"), c("b"), c("r"))


def _m():
    return N.line(0, 0, 64, 48)


_sl = "CAST(r - g AS DOUBLE) / nullif(b - r, 0)"
_dd = "((b - r) * 48.0 - (r - g) * 64.0)"
scalar("num12_lines", views.px, views.PX, rounded={
    "slope": (lambda: N.line_slope(_l()), _sl),
    "inverse": (lambda: N.line_inverse_slope(_l()), "CAST(b - r AS DOUBLE) / nullif(r - g, 0)"),
    "y_at": (lambda: N.line_y(_l(), c("x")), f"g + {_sl} * (x - r)"),
    "x_at": (lambda: N.line_x(_l(), c("y")), "r + CAST(b - r AS DOUBLE) / nullif(r - g, 0) * (y - g)"),
    "moved": (lambda: N.line_y(N.line_translate(_m(), 1.0, 2.0), c("x")), "2.0 + 0.75 * (x - 1.0)"),
    "grown": (lambda: N.line_scale(_l(), 2.0)["x1"], "r + (b - r) * 2.0"),
    "meet_x": (lambda: N.line_intersection(_l(), _m())["x"], f"CASE WHEN {_dd} <> 0 THEN r + ((0.0 - r) * 48.0 - (0.0 - g) * 64.0) / {_dd} * (b - r) END"),
}, plain={"side": (lambda: N.line_side(_m(), _p()), "CASE WHEN y > 0.75 * x THEN 'above' WHEN y < 0.75 * x THEN 'below' ELSE 'on' END")})

def _o():
    return N.point(lit(32.0), lit(24.0))


def _bs():
    return N.point(lit(2.0), lit(4.0))


scalar("num13_planes", views.px, views.PX, rounded={
    "vx": (lambda: N.plane_to_vector(_p(), _o(), _bs())["x"], "(x - 32.0) / 2.0"),
    "direction": (lambda: N.plane_direction(_v()), "degrees(atan2(g + 2.0, r + 1.0))"),
}, plain={
    "px": (lambda: N.plane_to_point(N.plane_to_vector(_p(), _o(), _bs()), _o(), _bs())["x"], "x"),
    "steps": (lambda: F.size(N.plane_path(_v(), lit(4))), "5"),
    "mid_y": (lambda: F.get(N.plane_path(_v(), lit(4)), 2)["y"], "CAST(floor((g + 2.0) * 2 / 4 + 0.5) AS INT)"),
})
scalar("num14_ratios", views.px, views.PX, rounded={
    "similarity": (lambda: N.ratio_similarity(c("r").cast("double"), c("g").cast("double")), "CASE WHEN r < 1e-8 AND g < 1e-8 THEN 1.0 ELSE least(greatest(exp(-abs(ln((g + 1e-6) / (r + 1e-6)))), 0.0), 1.0) END"),
    "ratio": (lambda: N.safe_ratio(c("r").cast("double"), c("g").cast("double")), "CASE WHEN r < 1e-8 AND g < 1e-8 THEN 1.0 ELSE least(greatest(r / greatest(g, 1e-8), 0.05), 20.0) END"),
})
scalar("num15_encode_xy", views.px, views.PX, plain={"code": (lambda: N.encode_xy(c("x"), c("y")), "CAST(x AS BIGINT) * 4294967296 + y")})

# -- predicates
scalar("flt1_hsv_box", views.hsv, views.HSV, plain={
    "inside": (lambda: P.hsv_box(c("h"), c("s"), c("v"), (90, 20, 30), (270, 90, 80)), "h BETWEEN 90 AND 270 AND s BETWEEN 20 AND 90 AND v BETWEEN 30 AND 80"),
})


def _pieces(table, cmp):
    return "(" + " OR ".join(f"(si BETWEEN {a} AND {b} AND vi {cmp} floor((si - {a})::DOUBLE * ({k!r})::DOUBLE + {v}))" for a, b, k, v in table) + ")"


_INT = views.HSV + ", hi AS (SELECT *, CAST(floor(h) AS INT) AS hi, CAST(floor(s) AS INT) AS si, CAST(floor(v) AS INT) AS vi FROM hsv)"
WHITE_SQL = _pieces(P.WHITE_PIECES, ">=")
INK_SQL = f"CASE WHEN hi BETWEEN 20 AND 45 THEN {_pieces(P.WARM_INK_PIECES, '<=')} WHEN hi BETWEEN 215 AND 340 THEN {_pieces(P.COOL_INK_PIECES, '<=')} ELSE v <= 25 END"
scalar("flt2_black_white", views.hsv, _INT, plain={
    "black": (lambda: P.is_black(c("s"), c("v")), "v <= 11 OR (s > 11 AND v <= 25)"),
    "white": (lambda: P.is_white(c("s"), c("v")), WHITE_SQL),
}, source="hi")
scalar("flt3_default_ink", views.hsv, _INT, plain={"ink": (lambda: P.is_default_ink(c("h"), c("s"), c("v")), INK_SQL)}, source="hi")
