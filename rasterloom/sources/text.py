"""Text formats of names, borders, rectangles, colours and maps, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits in which the length of a digit run is told.
LENGTH_DIGITS = 10


def natural_key(name: Column) -> Column:
    """Sort key under which digit runs compare as numbers and letters without case: every digit run is
    preceded by its length without leading zeros and followed by that with them, in ten digits each."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D)"), F.lit(1))
    bare = lambda p: F.ltrim(p, F.lit("0"))

    def key(p: Column) -> Column:
        told = lambda c: F.lpad(F.length(c).cast("string"), LENGTH_DIGITS, "0")
        digits = F.concat(F.lit("0"), told(bare(p)), bare(p), told(p))
        return F.when(p.rlike(r"^\d"), digits).otherwise(p)

    return F.array_join(F.transform(parts, key), "")


def natural_order(df: DataFrame, col: str) -> DataFrame:
    """Adds `position` from 1. Names are sorted by range; the numbers of rows of the ranges before a name's
    own, one row a range, turn its place there into its position."""
    from rasterloom.sources.tables import materialise

    order = [F.col("__key"), F.length(col), F.col(col)]
    keyed = df.withColumn("__key", natural_key(F.col(col)))
    ranged = materialise(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    placed = ranged.withColumn("__at", F.row_number().over(inside)).join(bases, "__part")
    return placed.select(*df.columns, (F.col("__base") + F.col("__at")).cast("int").alias("position"))


def parse_border(df: DataFrame, key: str, col: str) -> DataFrame:
    """`{10=[4, 5], 11=[4]}` as rows (key, x, y)."""
    column = F.explode(F.regexp_extract_all(F.col(col), F.lit(r"-?\d+=\[[^\]]*\]"), F.lit(0))).alias("c")
    x = F.split("c", "=")[0].cast("int").alias("x")
    ys = F.transform(F.regexp_extract_all(F.split("c", "=")[1], F.lit(r"-?\d+"), F.lit(0)), lambda y: y.cast("int"))
    return df.select(F.col(key), column).select(key, x, F.explode(ys).alias("y"))


def encode_border(points: DataFrame, key: str) -> DataFrame:
    """The inverse, columns and rows in ascending order."""
    cols = points.groupBy(key, "x").agg(F.array_sort(F.collect_set("y")).alias("ys"))
    text = F.concat(F.col("x").cast("string"), F.lit("=["), F.array_join(F.transform("ys", lambda y: y.cast("string")), ", "), F.lit("]"))
    rows = F.array_sort(F.collect_list(F.struct("x", text.alias("t"))))
    joined = F.array_join(F.transform(rows, lambda r: r["t"]), ", ")
    return cols.groupBy(key).agg(F.concat(F.lit("{"), joined, F.lit("}")).alias("border"))


def parse_fields(text: Column) -> Column:
    """`[x=1,y=2,width=3,height=4]` as a map of integers."""
    return F.transform_values(F.str_to_map(F.regexp_replace(text, r"[\[\]\s]", ""), F.lit(","), F.lit("=")), lambda _, v: v.cast("int"))


def parse_rect(text: Column) -> Column:
    m = parse_fields(text)
    return F.struct(*[m[k].alias(k) for k in ("x", "y", "width", "height")])


def parse_point(text: Column) -> Column:
    m = parse_fields(text)
    return F.struct(m["x"].alias("x"), m["y"].alias("y"))


def parse_color(text: Column) -> Column:
    """`{r,g,b}` as an array of doubles."""
    return F.transform(F.split(F.regexp_replace(text, r"[{}]", ""), ","), lambda v: F.trim(v).cast("double"))


def parse_color_map(text: Column) -> Column:
    """`r,g,b=r,g,b;...` as a map of integer triples; an error for a malformed pair."""

    def triple(t: Column) -> Column:
        v = F.transform(F.split(F.regexp_replace(t, r"[{}\s]", ""), ","), lambda x: x.try_cast("int"))
        return F.when((F.size(v) == 3) & ~F.exists(v, lambda x: x.isNull()), v).otherwise(F.raise_error(F.concat(F.lit("not three whole numbers: "), t)))

    def pair(t: Column) -> Column:
        sides = F.split(t, "=")
        ok = F.when(F.size(sides) == 2, sides).otherwise(F.raise_error(F.concat(F.lit("not a colour pair: "), t)))
        return F.struct(triple(ok[0]).alias("k"), triple(ok[1]).alias("v"))

    pairs = F.when(F.trim(text) == "", F.array().cast("array<struct<k:array<int>,v:array<int>>>")).otherwise(F.transform(F.split(text, ";"), pair))
    return F.map_from_entries(pairs)


def encode_color_map(colors: Column) -> Column:
    show = lambda v: F.concat(F.lit("{"), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("}"))
    return F.array_join(F.transform(F.map_entries(colors), lambda e: F.concat(show(e["key"]), F.lit("="), show(e["value"]))), ";")


def encode_string_map(m: Column) -> Column:
    """`k:v;...`, both sides in URL-safe Base64 without padding."""
    b64 = lambda s: F.rtrim(F.translate(F.base64(s.cast("binary")), "+/", "-_"), F.lit("="))
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(b64(e["key"]), F.lit(":"), b64(e["value"]))), ";")


def parse_string_map(text: Column) -> Column:
    whole = lambda s: F.rpad(s, (F.ceil(F.length(s) / 4) * 4).cast("int"), F.lit("="))
    plain = lambda s: F.unbase64(whole(F.translate(s, "-_", "+/"))).cast("string")
    pair = lambda t: F.struct(plain(F.split(t, ":")[0]).alias("k"), plain(F.split(t, ":")[1]).alias("v"))
    return F.when(F.trim(text) == "", F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))).otherwise(F.map_from_entries(F.transform(F.split(text, ";"), pair)))


def write_border(points: DataFrame, path: str) -> None:
    """One border text per frame (shape_id)."""
    encode_border(points, "shape_id").select("shape_id", "border").write.mode("overwrite").partitionBy("shape_id").text(path)


def load_border(spark, path: str, fill: bool = False) -> DataFrame:
    """Borders written before; with `fill`, gaps between their columns are interpolated."""
    from rasterloom.operators.points import fill_border

    read = parse_border(spark.read.text(path), "shape_id", "value").select(F.col("shape_id").cast("long").alias("shape_id"), "x", "y")
    return fill_border(read) if fill else read
