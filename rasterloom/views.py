"""Raster-shaped views of the test tables, each with the same definition as a DuckDB CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions.color import pack_argb, rgb_to_hsv

WIDTH, HEIGHT = 64, 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (frame_id, x, y, r, g, b) of 64 x 48 frames made from `lineitem`."""
    cell = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 1000").alias("frame_id"),
        (F.col("l_partkey") % WIDTH).cast("int").alias("x"),
        ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % HEIGHT).cast("int").alias("y"),
        ((F.col("l_orderkey") * 37 + F.col("l_partkey") * 11) % 256).cast("int").alias("r"),
        ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 29) % 256).cast("int").alias("g"),
        ((F.col("l_partkey") * 7 + F.col("l_quantity").cast("int") * 13) % 256).cast("int").alias("b"),
    )
    return cell.groupBy("frame_id", "x", "y").agg(*[F.max(c).alias(c) for c in "rgb"])


PX = """px AS (SELECT l_orderkey // 1000 AS frame_id, CAST(l_partkey % 64 AS INT) AS x,
 CAST((l_suppkey * 7 + l_linenumber) % 48 AS INT) AS y,
 CAST(max((l_orderkey * 37 + l_partkey * 11) % 256) AS INT) AS r,
 CAST(max((l_suppkey * 53 + l_linenumber * 29) % 256) AS INT) AS g,
 CAST(max((l_partkey * 7 + CAST(l_quantity AS INT) * 13) % 256) AS INT) AS b
 FROM lineitem GROUP BY 1, 2, 3)"""


def argb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px with a packed colour; alpha varies with the place."""
    return px(spark, sf_dir).select(
        "frame_id", "x", "y", pack_argb((F.col("x") * 37 + F.col("y") * 11) % 256, F.col("r"), F.col("g"), F.col("b")).alias("argb")
    )


ARGB = PX + """, ar AS (SELECT frame_id, x, y, (x * 37 + y * 11) % 256 AS a, r, g, b FROM px)"""


def hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = px(spark, sf_dir)
    return base.withColumn("hsv", rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))).select("frame_id", "x", "y", "r", "g", "b", "hsv.h", "hsv.s", "hsv.v")


HSV = PX + """, hsv0 AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM px),
hsv1 AS (SELECT *, CAST(mx - r AS FLOAT) / CAST(nullif(mx - mn, 0) AS FLOAT) AS rc,
 CAST(mx - g AS FLOAT) / CAST(nullif(mx - mn, 0) AS FLOAT) AS gc, CAST(mx - b AS FLOAT) / CAST(nullif(mx - mn, 0) AS FLOAT) AS bc FROM hsv0),
hsv2 AS (SELECT *, CAST(CASE WHEN mx = mn THEN CAST(0 AS FLOAT) WHEN r = mx THEN bc - gc WHEN g = mx THEN CAST(2 AS FLOAT) + rc - bc
 ELSE CAST(4 AS FLOAT) + gc - rc END AS FLOAT) / CAST(6 AS FLOAT) AS hh FROM hsv1),
hsv AS (SELECT frame_id, x, y, r, g, b, CAST(CASE WHEN hh < 0 THEN hh + CAST(1 AS FLOAT) ELSE hh END AS DOUBLE) * 360 AS h,
 CAST(CASE WHEN mx = 0 THEN CAST(0 AS FLOAT) ELSE CAST(mx - mn AS FLOAT) / CAST(mx AS FLOAT) END AS DOUBLE) * 100 AS s,
 CAST(CAST(mx AS FLOAT) / CAST(255 AS FLOAT) AS DOUBLE) * 100 AS v FROM hsv2)"""


def dark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse points (shape_id, x, y): pixels whose value is at most 50."""
    return hsv(spark, sf_dir).where("v <= 50").select(F.col("frame_id").alias("shape_id"), "x", "y")


DARK = HSV + """, dark AS (SELECT frame_id AS shape_id, x, y FROM hsv WHERE v <= 50)"""


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 8 x 8 frames (frame_id, x, y, value) from `embeddings`."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("i", "e"))
    value = F.least(F.greatest(F.col("e").cast("double") + 0.5, F.lit(0.0)), F.lit(1.0))
    return e.select("frame_id", (F.col("i") % 8).alias("x"), F.expr("cast(i div 8 as int)").alias("y"), value.alias("value"))


GRAY = """gray AS (SELECT vec_id AS frame_id, CAST((i - 1) % 8 AS INT) AS x, CAST((i - 1) // 8 AS INT) AS y,
 least(greatest(CAST(embedding[i] AS DOUBLE) + 0.5, 0.0), 1.0) AS value
 FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, pos, value): each user's events in order; pos counts seconds."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("pos"), F.col("value")
    )


SERIES = "series AS (SELECT user_id AS key, event_id AS pos, value FROM events)"


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer pixels (doc_id, z, x, y, argb): px at z = 0, and shifted by (3, 2) with its own alpha at z = 1."""
    low = px(spark, sf_dir).select(F.col("frame_id").alias("doc_id"), F.lit(0).alias("z"), "x", "y", pack_argb(F.lit(255), F.col("r"), F.col("g"), F.col("b")).alias("argb"))
    high = argb(spark, sf_dir).select(F.col("frame_id").alias("doc_id"), F.lit(1).alias("z"), (F.col("x") + 3).alias("x"), (F.col("y") + 2).alias("y"), "argb")
    return low.unionAll(high)


LAYERS = ARGB + """, lay AS (SELECT frame_id AS doc_id, 0 AS z, x, y, 255 AS a, r, g, b FROM px
 UNION ALL SELECT frame_id, 1, x + 3, y + 2, a, r, g, b FROM ar)"""


def poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed x-monotone outlines (shape_id, ord, x, y) around the dark points: lower edge left to
    right, then upper edge right to left."""
    sp = dark(spark, sf_dir).groupBy("shape_id", "x").agg(F.min("y").alias("lo"), (F.max("y") + 1).alias("hi"))
    low = sp.select("shape_id", F.lit(0).alias("side"), F.col("x").alias("k"), "x", F.col("lo").alias("y"))
    high = sp.select("shape_id", F.lit(1).alias("side"), (-F.col("x")).alias("k"), "x", F.col("hi").alias("y"))
    w = Window.partitionBy("shape_id").orderBy("side", "k")
    return low.unionAll(high).select("shape_id", (F.row_number().over(w) - 1).alias("ord"), "x", "y")


POLY = DARK + """, psp AS (SELECT shape_id, x, min(y) AS lo, max(y) + 1 AS hi FROM dark GROUP BY 1, 2),
poly AS (SELECT shape_id, CAST(row_number() OVER (PARTITION BY shape_id ORDER BY side, k) - 1 AS INT) AS ord, x, y
 FROM (SELECT shape_id, 0 AS side, x AS k, x, lo AS y FROM psp UNION ALL SELECT shape_id, 1, -x, x, hi FROM psp)),
pn AS (SELECT shape_id, count(*) AS n FROM poly GROUP BY 1),
ed AS (SELECT a.shape_id, a.ord, a.x, a.y, b.x AS nx, b.y AS ny FROM poly a JOIN pn USING (shape_id) JOIN poly b ON a.shape_id = b.shape_id AND b.ord = (a.ord + 1) % n)"""
