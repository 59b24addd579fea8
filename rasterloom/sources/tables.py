"""Intermediate and named tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Local sessions, as in tests,
    get one; a cluster must name its own, as no executor sees another's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage of iterative operators in a way
    that survives the loss of an executor.

    Joins with the table are merge joins: its files are a small part of its rows in memory, and as large as
    its input, so their size is no reason to send it to the driver and on to every executor."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def write_frames(pixels: DataFrame, path: str) -> None:
    """Pixel rows, one folder per frame, with one file: were a frame's rows in every task, files would be as many as
    tasks times frames."""
    pixels.repartition("frame_id").write.mode("overwrite").partitionBy("frame_id").parquet(path)


def read_frames_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_ink_bands(bands: DataFrame, path: str, model: str) -> None:
    """A learned colour table under its model's name."""
    bands.write.mode("overwrite").parquet(f"{path}/model_name={model}")


def read_ink_bands(spark: SparkSession, path: str, model: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("model_name") == model).drop("model_name")
