"""Colour columns: packed ARGB, HSV, Lab and darkness. Channels are integers from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.numeric import clamp01, java_round


def clamp8(v: Column) -> Column:
    """Round half up and bound to a channel."""
    return java_round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v.cast("double")))).cast("int")


def channel(argb: Column, shift: int) -> Column:
    return F.shiftrightunsigned(argb, shift).bitwiseAND(F.lit(255))


def unpack_argb(argb: Column) -> Column:
    """struct a, r, g, b."""
    return F.struct(*[channel(argb, s).alias(n) for n, s in (("a", 24), ("r", 16), ("g", 8), ("b", 0))])


def pack_argb(a: Column, r: Column, g: Column, b: Column) -> Column:
    """Signed 32-bit colour of channels, each bounded to 0..255."""
    byte = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c.cast("int")))
    rgb = F.shiftleft(byte(r), 16).bitwiseOR(F.shiftleft(byte(g), 8)).bitwiseOR(byte(b))
    return F.shiftleft(byte(a), 24).bitwiseOR(rgb)


def with_alpha(argb: Column, a: Column) -> Column:
    c = unpack_argb(argb)
    return pack_argb(a, c["r"], c["g"], c["b"])


def impose_alpha(argb: Column) -> Column:
    """Opaque version of a colour."""
    return argb.bitwiseOR(F.lit(-16777216))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """struct h (0..360), s and v (0..100), through 32-bit floats."""
    f32 = lambda c: c.cast("float")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    share = lambda c: f32(F.try_divide((top - c).cast("double"), (top - low).cast("double")))
    rc, gc, bc = share(r), share(g), share(b)
    sextant = F.when(r == top, bc - gc).when(g == top, F.lit(2.0).cast("float") + rc - bc).otherwise(F.lit(4.0).cast("float") + gc - rc)
    hue = f32(F.when(top == low, F.lit(0.0).cast("float")).otherwise(sextant).cast("double") / 6.0)
    hue = F.when(hue < 0, hue + F.lit(1.0).cast("float")).otherwise(hue)
    sat = F.when(top == 0, F.lit(0.0).cast("float")).otherwise(f32((top - low).cast("double") / F.greatest(top, F.lit(1))))
    val = f32(top.cast("double") / 255.0)
    return F.struct((hue.cast("double") * 360).alias("h"), (sat.cast("double") * 100).alias("s"), (val.cast("double") * 100).alias("v"))


def with_hsv_of(df: DataFrame, *keep: str) -> DataFrame:
    """Columns `keep`, r, g, b of `df`, and h, s, v as `rgb_to_hsv` gives them. Every part is a column of its own: written as one
    expression, the conditions repeat their parts into a method that is too large to be compiled."""
    f32 = lambda c: c.cast("float")
    r, g, b, top, low = (F.col(c) for c in ("r", "g", "b", "__top", "__low"))
    ends = df.select(*keep, "r", "g", "b", F.greatest(r, g, b).alias("__top"), F.least(r, g, b).alias("__low"))
    share = lambda c, name: f32(F.try_divide((top - c).cast("double"), (top - low).cast("double"))).alias(name)
    shares = ends.select("*", share(r, "__r"), share(g, "__g"), share(b, "__b"))
    rc, gc, bc = (F.col(c) for c in ("__r", "__g", "__b"))
    sextant = F.when(r == top, bc - gc).when(g == top, F.lit(2.0).cast("float") + rc - bc).otherwise(F.lit(4.0).cast("float") + gc - rc)
    hues = shares.withColumn("__hue", f32(F.when(top == low, F.lit(0.0).cast("float")).otherwise(sextant).cast("double") / 6.0))
    hue = F.when(F.col("__hue") < 0, F.col("__hue") + F.lit(1.0).cast("float")).otherwise(F.col("__hue"))
    sat = F.when(top == 0, F.lit(0.0).cast("float")).otherwise(f32((top - low).cast("double") / F.greatest(top, F.lit(1))))
    val = f32(top.cast("double") / 255.0)
    parts = [(c.cast("double") * n).alias(name) for c, n, name in ((hue, 360, "h"), (sat, 100, "s"), (val, 100, "v"))]
    return hues.select(*keep, "r", "g", "b", *parts)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """struct r, g, b of h in degrees, s and v in percent."""
    h6, s1, v1 = F.pmod(h / 360.0, F.lit(1.0)) * 6.0, s / 100.0, v / 100.0
    f = h6 - F.floor(h6)
    part = {"p": v1 * (1 - s1), "q": v1 * (1 - s1 * f), "t": v1 * (1 - s1 * (1 - f)), "v": v1}
    to8 = lambda c: F.floor(c * 255.0 + 0.5).cast("int")
    sextants = ("vtp", "qvp", "pvt", "pqv", "tpv", "vpq")

    def pick(i: int) -> Column:
        out = to8(part[sextants[5][i]])
        for k in range(4, -1, -1):
            out = F.when(F.floor(h6) == k, to8(part[sextants[k][i]])).otherwise(out)
        return out

    return F.struct(pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))


def linear_channel(c: Column) -> Column:
    """sRGB channel (0..1) as linear light."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


#: D50 white point and sRGB to XYZ matrix (fixed values).
WHITE_D50 = (0.964221, 1.0, 0.825211)
SRGB_TO_XYZ_D50 = (
    (0.436052025, 0.385081593, 0.143087414),
    (0.222491598, 0.71688606, 0.060621486),
    (0.013929122, 0.097097002, 0.71418547),
)


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """struct l (scaled to 0..255), a, b: integer CIE Lab."""
    lin = [linear_channel(c.cast("double") / 255.0) for c in (r, g, b)]

    def f(row, white):
        t = sum((m * c for m, c in zip(row[1:], lin[1:])), row[0] * lin[0]) / white
        return F.when(t > 216.0 / 24389.0, F.pow(t, F.lit(1 / 3.0))).otherwise((t * (24389.0 / 27.0) + 16.0) / 116.0)

    fx, fy, fz = (f(row, w) for row, w in zip(SRGB_TO_XYZ_D50, WHITE_D50))
    trunc = lambda c: c.cast("int")
    return F.struct(
        trunc((fy * 116 - 16) * 2.55 + 0.5).alias("l"), trunc((fx - fy) * 500 + 0.5).alias("a"), trunc((fy - fz) * 200 + 0.5).alias("b")
    )


def color_difference(lab1: Column, lab2: Column) -> Column:
    """CIE76 distance of two Lab structs."""
    return F.sqrt(sum((F.pow((lab1[c] - lab2[c]).cast("double"), F.lit(2.0)) for c in "ab"), F.pow((lab1["l"] - lab2["l"]).cast("double"), F.lit(2.0))))


def darkness(a: Column, r: Column, g: Column, b: Column) -> Column:
    """1 - linear luminance, times alpha."""
    r, g, b = (linear_channel(c.cast("double") / 255.0) for c in (r, g, b))
    return clamp01((1.0 - (r * 0.2126 + g * 0.7152 + b * 0.0722)) * (a.cast("double") / 255.0))


def darkness_mean(a: Column, r: Column, g: Column, b: Column) -> Column:
    """1 - mean channel, times alpha."""
    return clamp01((1.0 - (r + g + b).cast("double") / 765.0) * (a.cast("double") / 255.0))


def hsv_distance(a: Column, b: Column) -> Column:
    """Distance of two HSV structs, hue circular, all parts scaled to 0..1."""
    d = F.abs(a["h"] - b["h"]) / 360.0
    hue = F.least(d, 1.0 - d)
    return F.sqrt(hue * hue + F.pow((a["s"] - b["s"]) / 100.0, F.lit(2.0)) + F.pow((a["v"] - b["v"]) / 100.0, F.lit(2.0)))


def hex_color(argb: Column) -> Column:
    """#rrggbb."""
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(argb.bitwiseAND(F.lit(0xFFFFFF)))), 6, "0"))


def from_hex_color(text: Column) -> Column:
    """Opaque colour of #rrggbb; null when malformed."""
    ok = text.rlike("^#[0-9A-Fa-f]{6}$")
    return F.when(ok, F.conv(F.substring(text, 2, 6), 16, 10).cast("int").bitwiseOR(F.lit(-16777216)))
