"""Image folders as frames and pixel rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.sources.text import natural_order


def read_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(frames, pixels) of an image file or folder, decoded by Spark's image source; frame_id is the
    position in natural name order. A file that cannot be decoded is an error."""
    images = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    broken = F.raise_error(F.concat(F.lit("not a readable image: "), F.col("origin")))
    images = images.withColumn("width", F.when(F.col("width") > 0, F.col("width")).otherwise(broken.cast("int")))
    names = images.select("origin", F.element_at(F.split("origin", "/"), -1).alias("name"))
    ids = natural_order(names, "name").select("origin", F.col("position").cast("long").alias("frame_id"))
    # As many rows as files on both sides: no broadcast.
    framed = images.join(ids.hint("merge"), "origin")
    frames = framed.select("frame_id", F.col("origin").alias("path"), "width", "height", (F.col("nChannels") == 4).alias("has_alpha"))
    return frames, decode(framed)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _line_colors(line: pd.Series, channels: pd.Series) -> pd.Series:
    """Packed colours of lines of blue-green-red(-alpha) or gray bytes."""

    def one(data: bytes, n: int) -> np.ndarray:
        v = np.frombuffer(data, np.uint8).reshape(-1, n).astype(np.uint32)
        b, g, r = (v[:, 0], v[:, 0], v[:, 0]) if n == 1 else (v[:, 0], v[:, 1], v[:, 2])
        a = v[:, 3] if n == 4 else np.uint32(255)
        return (a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b).view(np.int32)

    return pd.Series([one(d, n) for d, n in zip(line, channels)])


def decode(framed: DataFrame) -> DataFrame:
    """Rows (frame_id, x, y, argb) of packed blue-green-red(-alpha) bytes. The buffer is cut into lines first,
    so that a pixel row refers to its own line and not to the whole image."""
    step = F.col("width") * F.col("nChannels")
    lines = framed.select("frame_id", "nChannels", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.substring("data", y * step + 1, step))).alias("y", "line"))
    colors = lines.select("frame_id", "y", _line_colors("line", "nChannels").alias("colors"))
    return colors.select("frame_id", "y", F.posexplode("colors").alias("x", "argb")).select("frame_id", "x", "y", "argb")


def frames_from_pixels(packed: DataFrame, column_major: bool = False) -> DataFrame:
    """Rows of packed buffers (frame_id, width, height, pixels array) with their place."""
    one = packed.select("frame_id", "width", "height", F.posexplode("pixels").alias("i", "argb"))
    x, y = (F.expr("cast(i div height as int)"), F.col("i") % F.col("height")) if column_major else (F.col("i") % F.col("width"), F.expr("cast(i div width as int)"))
    return one.select("frame_id", x.alias("x"), y.alias("y"), "argb")


def match_frames(left: DataFrame, right: DataFrame, col: str = "name") -> DataFrame:
    """Pairs the i-th names of two folders in natural order; an error when their numbers differ."""
    a = natural_order(left.select(F.col(col).alias("left")), "left")
    b = natural_order(right.select(F.col(col).alias("right")), "right")
    both = a.join(b, "position", "full")
    ok = F.when(F.col("left").isNull() | F.col("right").isNull(), F.raise_error(F.lit("the folders hold different numbers of frames"))).otherwise(F.col("left"))
    return both.select("position", ok.alias("left"), "right")


def write_bitmaps(pixels: DataFrame, path: str, width: int, height: int) -> None:
    """One 24-bit bitmap file per frame, `frame <id>.bmp`, black where a pixel is missing. Frames are encoded
    in the tasks, all at once, and streamed one by one to the file system by the driver: for samples, not for corpora."""
    from rasterloom.sources.tables import materialise

    def encode(part: pd.DataFrame) -> pd.DataFrame:
        line = -(-width * 3 // 4) * 4
        body = np.zeros((height, line), np.uint8)
        argb = part["argb"].to_numpy().astype(np.int64)
        for k in range(3):
            body[height - 1 - part["y"].to_numpy(), part["x"].to_numpy() * 3 + k] = (argb >> (8 * k)) & 255
        number = lambda v, n: int(v).to_bytes(n, "little")
        size = line * height
        head = b"BM" + number(54 + size, 4) + number(0, 4) + number(54, 4) + number(40, 4) + number(width, 4) + number(height, 4) + number(1, 2) + number(24, 2) + number(0, 4) + number(size, 4) + number(0, 16)
        return pd.DataFrame({"name": [f"frame {part['frame_id'].iat[0]}.bmp"], "data": [head + body.tobytes()]})

    spark = pixels.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # Written first: read by the driver as they come, partitions would be encoded one after another.
    files = materialise(pixels.groupBy("frame_id").applyInPandas(encode, "name string, data binary"))
    for r in files.toLocalIterator(prefetchPartitions=True):
        out = system.create(jvm.org.apache.hadoop.fs.Path(folder, r["name"]))
        out.write(r["data"])
        out.close()
