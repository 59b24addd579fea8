"""Scalar arithmetic, angles, vectors, lines and planes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def java_round(v: Column) -> Column:
    """floor(v + 0.5)."""
    return F.floor(v + 0.5)


# -- bounds and rounding


def bound(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, _c(low)), _c(high))


def pos_bound(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0))


def neg_bound(v: Column) -> Column:
    return F.least(v, F.lit(0.0))


def clamp01(v: Column) -> Column:
    return bound(v, 0.0, 1.0)


def clamp_percent(v: Column) -> Column:
    """Floor, then bound to 0..100, as an integer."""
    return bound(F.floor(v), 0, 100).cast("int")


def round_to(v: Column, precision: float) -> Column:
    """Round to a multiple of `precision`."""
    scale = 10.0 / (precision * 10.0)
    return java_round(v * scale) / scale


def decimal_part(v: Column) -> Column:
    return v % 1.0


def round_if_greater(v: Column, part: float) -> Column:
    return F.when(decimal_part(v) >= part, java_round(v)).otherwise(F.floor(v)).cast("double")


def round_if_lesser(v: Column, part: float) -> Column:
    return F.when(decimal_part(v) <= part, java_round(v)).otherwise(F.ceil(v)).cast("double")


def round_if_threshold(v: Column, low: float, high: float) -> Column:
    d = decimal_part(v)
    return F.when(d >= high, F.ceil(v).cast("double")).when(d <= low, F.floor(v).cast("double")).otherwise(v)


# -- interval tests


def between_open(v: Column, low, high) -> Column:
    return (v > low) & (v < high)


def between_closed(v: Column, low, high) -> Column:
    return (v >= low) & (v <= high)


def within(v: Column, target: Column, percent: float) -> Column:
    """In the half-open band of (percent - 1) around the target."""
    band = target * (percent - 1)
    return (v > target - band) & (v <= target + band)


def within_pos(v: Column, target: Column, percent: float) -> Column:
    d = (v - target) / target * 100.0
    return (d >= 0) & (d <= percent)


def within_neg(v: Column, target: Column, percent: float) -> Column:
    d = (v - target) / target * 100.0
    return (d <= 0) & (d >= -percent)


# -- modulo buckets


def lim_mod(v: Column, m: int) -> Column:
    return v - v % m


def next_mod(v: Column, m: int) -> Column:
    return v + (m - v % m)


def divisible(v: Column, m: int) -> Column:
    return v % m == 0


def mod_range(low: Column, high: Column, m: int) -> Column:
    """Array of the multiples of m from lim_mod(low) up to high."""
    return F.sequence(lim_mod(low, m), F.greatest(high, lim_mod(low, m)), F.lit(m))


# -- choice by distance


def closer(v: Column, a: Column, b: Column) -> Column:
    return F.when(F.abs(a - v) > F.abs(b - v), b).otherwise(a)


def farther(v: Column, a: Column, b: Column) -> Column:
    return F.when(F.abs(a - v) < F.abs(b - v), b).otherwise(a)


# -- interpolation


def lerp(a, b, t) -> Column:
    a = _c(a)
    return a + (_c(b) - a) * t


def lerp_int(a, b, t) -> Column:
    return java_round(lerp(a, b, t)).cast("int")


def inverse_lerp(a, b, v: Column) -> Column:
    a, b = _c(a), _c(b)
    return F.when(a == b, F.lit(0.0)).otherwise(F.try_divide(v - a, b - a))


def remap(v: Column, a0, a1, b0, b1) -> Column:
    return lerp(b0, b1, inverse_lerp(a0, a1, v))


def midpoint(a, b, ratio: float = 2.0) -> Column:
    return (_c(a) + _c(b)) / ratio


def normalize_range(v: Column, low: float, high: float) -> Column:
    return (v - low) / (high - low)


def denormalize_range(v: Column, low: float, high: float) -> Column:
    return v * (high - low) + low


def convert_scale(v: Column, a0: float, a1: float, b0: float, b1: float) -> Column:
    return denormalize_range(normalize_range(v, a0, a1), b0, b1)


# -- angles


def wrap(v: Column, period: float = 1.0) -> Column:
    """Into [0, period)."""
    return F.pmod(v, F.lit(period))


def normalize_angle(radians: Column) -> Column:
    return wrap(radians, TAU)


def angle_delta(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, TAU - d)


def circular_distance(a: Column, b: Column) -> Column:
    """Distance on a circle of circumference 1."""
    d = F.abs(wrap(a) - wrap(b))
    return F.least(d, 1.0 - d)


def orientation_distance(a: Column, b: Column) -> Column:
    """Difference of two undirected directions in radians, as a share of a right angle."""
    d = wrap(a - b, math.pi)
    return F.least(d, math.pi - d) / (math.pi / 2)


# -- small functions


def rate_of_change(x0, y0, x1, y1) -> Column:
    return F.try_divide(_c(y1) - _c(y0), _c(x1) - _c(x0))


def sign_clamp(v: Column) -> Column:
    return F.when(v < 0, -1).otherwise(1)


def same_sign(a: Column, b: Column) -> Column:
    return sign_clamp(a) == sign_clamp(b)


def reciprocal(v: Column) -> Column:
    return F.try_divide(F.lit(1.0), v)


def square(v: Column) -> Column:
    return v * v


def cube(v: Column) -> Column:
    return v * v * v


def non_zero(v: Column, instead: float = 1.0) -> Column:
    return F.when(v == 0, F.lit(instead)).otherwise(v)


def encode_xy(x: Column, y: Column) -> Column:
    """A long that orders by x, then by y as unsigned."""
    return F.shiftleft(x.cast("long"), 32).bitwiseOR(y.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def ratio_similarity(a: Column, b: Column) -> Column:
    both = (a < 1e-8) & (b < 1e-8)
    return F.when(both, F.lit(1.0)).otherwise(clamp01(F.exp(-F.abs(F.log((b + 1e-6) / (a + 1e-6))))))


def safe_ratio(num: Column, den: Column) -> Column:
    both = (num < 1e-8) & (den < 1e-8)
    return F.when(both, F.lit(1.0)).otherwise(bound(num / F.greatest(den, F.lit(1e-8)), 0.05, 20.0))


# -- points and segments; points are structs x, y


def point(x, y) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"))


def cross_points(a: Column, b: Column, p: Column) -> Column:
    """Cross product of a->b and a->p."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def projection_factor(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = (dx * dx + dy * dy).cast("double")
    return F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, n))


def lerp_point(a: Column, b: Column, t) -> Column:
    return point(lerp_int(a["x"], b["x"], t), lerp_int(a["y"], b["y"], t))


def project_to_segment(p: Column, a: Column, b: Column) -> Column:
    return lerp_point(a, b, clamp01(projection_factor(p, a, b)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow((a["x"] - b["x"]).cast("double"), F.lit(2.0)) + F.pow((a["y"] - b["y"]).cast("double"), F.lit(2.0)))


def distance_to_segment(p: Column, a: Column, b: Column) -> Column:
    return distance(p, project_to_segment(p, a, b))


def curvature(a: Column, b: Column, c: Column) -> Column:
    """Signed three-point curvature; NaN where two points coincide."""
    abx, aby = b["x"] - a["x"], b["y"] - a["y"]
    den = distance(a, b) * distance(b, c) * distance(c, a)
    num = 2.0 * (abx * (c["y"] - a["y"]) - aby * (c["x"] - a["x"]))
    return F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(float("nan")))


# -- vectors (structs x, y of doubles)


def vec_length(v: Column) -> Column:
    return F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])


def vec_scale(v: Column, k) -> Column:
    return point(v["x"] * k, v["y"] * k)


def vec_dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"]


def vec_cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - a["y"] * b["x"]


def vec_normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays."""
    n = vec_length(v)
    return point(F.coalesce(F.try_divide(v["x"], n), F.lit(0.0)), F.coalesce(F.try_divide(v["y"], n), F.lit(0.0)))


def vec_perpendicular(v: Column) -> Column:
    return point(-v["y"], v["x"])


def vec_angle(v: Column) -> Column:
    return F.atan2(v["y"], v["x"])


def vec_project(a: Column, b: Column) -> Column:
    """Projection of a on b."""
    return vec_scale(b, F.coalesce(F.try_divide(vec_dot(a, b), vec_dot(b, b)), F.lit(0.0)))


def vec_reflect(v: Column, normal: Column) -> Column:
    k = 2.0 * vec_dot(v, normal)
    return point(v["x"] - normal["x"] * k, v["y"] - normal["y"] * k)


def vec_rotate(v: Column, radians) -> Column:
    c, s = F.cos(_c(radians)), F.sin(_c(radians))
    return point(v["x"] * c - v["y"] * s, v["x"] * s + v["y"] * c)


# -- lines through two points (structs x0, y0, x1, y1)


def line(x0, y0, x1, y1) -> Column:
    return F.struct(*[_c(v).cast("double").alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])


def line_slope(l: Column) -> Column:
    """Null for a vertical line."""
    return F.try_divide(l["y1"] - l["y0"], l["x1"] - l["x0"])


def line_inverse_slope(l: Column) -> Column:
    return F.try_divide(l["x1"] - l["x0"], l["y1"] - l["y0"])


def line_y(l: Column, x) -> Column:
    return l["y0"] + line_slope(l) * (_c(x) - l["x0"])


def line_x(l: Column, y) -> Column:
    return l["x0"] + line_inverse_slope(l) * (_c(y) - l["y0"])


def line_side(l: Column, p: Column) -> Column:
    """above, below or on, by the height of the line at the point's x; null for a vertical line."""
    y = line_y(l, p["x"])
    return F.when(p["y"] > y, "above").when(p["y"] < y, "below").when(p["y"] == y, "on")


def line_translate(l: Column, dx, dy) -> Column:
    return line(l["x0"] + dx, l["y0"] + dy, l["x1"] + dx, l["y1"] + dy)


def line_scale(l: Column, k) -> Column:
    """Scaled about its start."""
    return line(l["x0"], l["y0"], lerp(l["x0"], l["x1"], k), lerp(l["y0"], l["y1"], k))


def line_intersection(l: Column, m: Column) -> Column:
    """Meeting point of two infinite lines; null when they are parallel."""
    den = (l["x1"] - l["x0"]) * (m["y1"] - m["y0"]) - (l["y1"] - l["y0"]) * (m["x1"] - m["x0"])
    t = F.try_divide((m["x0"] - l["x0"]) * (m["y1"] - m["y0"]) - (m["y0"] - l["y0"]) * (m["x1"] - m["x0"]), den)
    return F.when(den != 0, point(l["x0"] + t * (l["x1"] - l["x0"]), l["y0"] + t * (l["y1"] - l["y0"])))


# -- planes: an origin and a unit basis of x and y scale


def plane_to_vector(p: Column, origin: Column, basis: Column) -> Column:
    return point((p["x"] - origin["x"]) / basis["x"], (p["y"] - origin["y"]) / basis["y"])


def plane_to_point(v: Column, origin: Column, basis: Column) -> Column:
    return point(java_round(v["x"] * basis["x"] + origin["x"]).cast("int"), java_round(v["y"] * basis["y"] + origin["y"]).cast("int"))


def plane_direction(v: Column) -> Column:
    """Degrees in [0, 360)."""
    return wrap(F.degrees(vec_angle(v)), 360.0)


def plane_path(v: Column, steps: Column) -> Column:
    """Array of the rounded points of the vector at 0/steps .. steps/steps."""
    return F.transform(F.sequence(F.lit(0), steps), lambda i: point(java_round(v["x"] * i / steps).cast("int"), java_round(v["y"] * i / steps).cast("int")))
