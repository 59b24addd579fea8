"""Keys of any size: rows dealt to ranges of key and order, and what goes on from one range to the next.

A window over a key needs all of its rows in one task. Here rows are sorted into ranges, as many as there are
shuffle partitions, so that a key with most of the rows fills many of them; windows run inside a range, and a
row per key and range carries on what the ranges before it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.sources.tables import materialise

RANGE = "__range"


def dealt(rows: DataFrame, by: str, *order: Column, ranges: int | None = None) -> DataFrame:
    """The rows, written, with the number of their range; numbers rise with key and order."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(rows.repartitionByRange(n, F.col(by), *order).withColumn(RANGE, F.spark_partition_id()))


def _carried(each: DataFrame, by: str, before: Column) -> DataFrame:
    """Rows (by, range, ...), one per key and range, with `carried`, which `before` makes of the earlier ones."""
    w = Window.partitionBy(by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(F.col(by).alias("__by"), F.col(RANGE).alias("__at"), before.over(w).alias("carried"))


def _with(rows: DataFrame, carried: DataFrame, by: str) -> DataFrame:
    return rows.join(carried, F.col(by).eqNullSafe(F.col("__by")) & (F.col(RANGE) == F.col("__at"))).drop("__by", "__at", RANGE)


def last_so_far(rows: DataFrame, by: str, value: str, out: str, *order: Column, ranges: int | None = None) -> DataFrame:
    """Adds `out`: the last `value` that is not null up to each row, in the key's order."""
    d = dealt(rows, by, *order, ranges=ranges)
    w = Window.partitionBy(by, RANGE).orderBy(*order)
    local = d.withColumn(out, F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(by, RANGE).orderBy(*order))
    held = d.where(F.col(value).isNotNull()).select(by, RANGE, value, place.alias("__place"))
    ends = held.groupBy(by, RANGE).agg(F.max_by(value, "__place").alias(value))
    every = d.groupBy(by, RANGE).agg(F.count("*").alias("__n")).join(ends.withColumnsRenamed({by: "__by", RANGE: "__at"}), F.col(by).eqNullSafe(F.col("__by")) & (F.col(RANGE) == F.col("__at")), "left").drop("__by", "__at")
    both = _with(local, _carried(every, by, F.last(value, True)), by)
    return both.withColumn(out, F.coalesce(out, "carried")).drop("carried")


def ranked(rows: DataFrame, by: str, out: str, *order: Column, ranges: int | None = None) -> DataFrame:
    """Adds `out`: the row's number in the key's order, from 0."""
    d = dealt(rows, by, *order, ranges=ranges)
    local = d.withColumn(out, F.row_number().over(Window.partitionBy(by, RANGE).orderBy(*order)) - 1)
    sizes = d.groupBy(by, RANGE).agg(F.count("*").alias("__n"))
    both = _with(local, _carried(sizes, by, F.sum("__n")), by)
    return both.withColumn(out, F.col(out) + F.coalesce("carried", F.lit(0))).drop("carried")
