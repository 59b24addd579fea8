"""Colour predicates over HSV columns (h 0..360, s and v 0..100)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hsv_box(h: Column, s: Column, v: Column, low: tuple, high: tuple) -> Column:
    """All three parts inside closed bounds."""
    return h.between(low[0], high[0]) & s.between(low[1], high[1]) & v.between(low[2], high[2])


def is_black(s: Column, v: Column) -> Column:
    return (v <= 11) | (s > 11) & (v <= 25)


def _steps(table, s: Column, v: Column, upper: bool) -> Column:
    """v on one side of floor(slope * (s - start) + base) in any of the saturation pieces."""
    out = F.lit(False)
    for s0, s1, slope, base in table:
        limit = F.floor((s - s0) * F.lit(float(slope)) + base)
        out = out | (s.between(s0, s1) & ((v <= limit) if upper else (v >= limit)))
    return out


#: Pieces (s from, s to, slope, v at the start), fixed values: white from these values of v on ...
WHITE_PIECES = ((0, 4, 2 / 4, 87), (4, 9, 8 / 5, 89), (9, 11, 3 / 2, 97))
#: ... and ink up to these, for hues 20..45 and for hues 215..340.
WARM_INK_PIECES = (
    (0, 16, (40 - 34) / 16, 34),
    (16, 24, (53 - 40) / (24 - 16), 40),
    (24, 31, (70 - 53) / (31 - 24), 53),
    (31, 41, (80 - 62) / (41 - 31), 62),
    (41, 57, (52 - 64) / (57 - 41), 64),
    (57, 88, (40 - 52) / (88 - 57), 52),
    (88, 100, 0, 40),
)
COOL_INK_PIECES = (
    (0, 10, 4 / 10, 29),
    (10, 20, 6 / 10, 33),
    (20, 29, 14 / 9, 39),
    (29, 42, 10 / 13, 53),
    (42, 48, -1 / 6, 63),
    (48, 68, -31 / 20, 62),
    (68, 88, -2 / 20, 31),
    (88, 100, -1 / 12, 29),
)
OTHER_INK_VALUE = 25


def is_white(s: Column, v: Column) -> Column:
    return _steps(WHITE_PIECES, s.cast("int"), v.cast("int"), upper=False)


def is_default_ink(h: Column, s: Column, v: Column) -> Column:
    hue, sat, val = (F.floor(c).cast("int") for c in (h, s, v))
    return (
        F.when(hue.between(20, 45), _steps(WARM_INK_PIECES, sat, val, upper=True))
        .when(hue.between(215, 340), _steps(COOL_INK_PIECES, sat, val, upper=True))
        .otherwise(v <= OTHER_INK_VALUE)
    )
