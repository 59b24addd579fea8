"""Ordered lookup, neighbours, slices and map-like regrouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.ranges import last_so_far, ranked

MODES = ("floor", "ceiling", "lower", "higher")


def asof(left: DataFrame, right: DataFrame, mode: str = "floor", by: str = "key", on: str = "pos", ranges: int | None = None) -> DataFrame:
    """Each left row (by, on, ...) with the nearest right key and value: at or below (floor), at or
    above (ceiling), strictly below or above (lower, higher). One sorted pass over the union, in ranges of
    key and place: no row meets more than its neighbour, and a frequent key spreads over many tasks."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    back = mode in ("floor", "lower")
    # Where keys tie, the right side comes first for floor and ceiling, last for the strict forms.
    tie = F.lit(0 if mode in ("floor", "ceiling") else 1)
    r = right.select(F.col(by), F.col(on), tie.alias("__o"), F.struct(F.col(on).alias("at"), F.col("value")).alias("__hit"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("__row"))
    own = F.lit(1 if mode in ("floor", "ceiling") else 0)
    l = left.select(F.col(by), F.col(on), own.alias("__o"), F.lit(None).cast(r.schema["__hit"].dataType).alias("__hit"), F.struct(*[F.col(c) for c in left.columns]).alias("__row"))
    place = F.col(on) if back else F.col(on).desc()
    both = last_so_far(l.unionAll(r), by, "__hit", "__found", place, F.col("__o"), ranges=ranges)
    return both.where(F.col("__row").isNotNull()).select("__row.*", F.col("__found.at").alias("found_at"), F.col("__found.value").alias("found"))


def first_meeting(left: DataFrame, right: DataFrame, pred: Column, after: bool = True) -> DataFrame:
    """Each left row (key, pos) with the first right entry from it on (or the last before it) that
    satisfies the predicate over the right value."""
    return asof(left, right.where(pred), "ceiling" if after else "lower")


def rank_of(series: DataFrame) -> DataFrame:
    """Adds `rank` from 0 in the key's order."""
    return ranked(series, "key", "rank", F.col("pos")).withColumn("rank", F.col("rank").cast("int"))


def nth(series: DataFrame, n: int) -> DataFrame:
    return rank_of(series).where(F.col("rank") == n).drop("rank")


def lookup(queries: DataFrame, entries: DataFrame, default: float) -> DataFrame:
    """Aligned lookup of (key, pos) with a default."""
    hit = entries.select("key", "pos", F.col("value").alias("__v"))
    return queries.join(hit, ["key", "pos"], "left").withColumn("value", F.coalesce("__v", F.lit(default))).drop("__v")


def sub_range(series: DataFrame, low=None, high=None) -> DataFrame:
    """Entries from low (inclusive) up to high (exclusive)."""
    out = series if low is None else series.where(F.col("pos") >= low)
    return out if high is None else out.where(F.col("pos") < high)


def ends(series: DataFrame) -> DataFrame:
    """First and last entry of each key."""
    return series.groupBy("key").agg(
        F.min("pos").alias("first_pos"), F.min_by("value", "pos").alias("first"), F.max("pos").alias("last_pos"), F.max_by("value", "pos").alias("last")
    )


def neighbours(series: DataFrame) -> DataFrame:
    """Previous, current and next value."""
    w = Window.partitionBy("key").orderBy("pos")
    return series.select("key", "pos", F.lag("value").over(w).alias("previous"), "value", F.lead("value").over(w).alias("next"))


def closest(series: DataFrame, target: float) -> DataFrame:
    """Closest and furthest entry to a value, ties to the earlier position."""
    d = F.abs(F.col("value") - target)
    return series.groupBy("key").agg(
        F.min(F.struct(d.alias("d"), "pos")).alias("c"), F.min(F.struct((-d).alias("d"), "pos")).alias("f"), F.min(d).alias("least")
    ).select("key", F.col("c.pos").alias("closest"), F.col("f.pos").alias("furthest"), (F.col("least") <= 1.0).alias("within_one"))


def slices(values: Column, start: int, share: tuple[float, float]) -> dict[str, Column]:
    """Positional slices of an array: from an index, all but the last n, even and odd places, a share
    of its length, the last n, the n-th from the end."""
    n = F.size(values)
    low, high = F.floor(n * F.lit(share[0])).cast("int"), F.floor(n * F.lit(share[1])).cast("int")
    return {
        "from_index": F.slice(values, start + 1, F.greatest(n, F.lit(1))),
        "but_last": F.slice(values, 1, F.greatest(n - start, F.lit(0))),
        "even": F.filter(values, lambda _, i: i % 2 == 0),
        "odd": F.filter(values, lambda _, i: i % 2 == 1),
        "part": F.slice(values, low + 1, F.greatest(high - low, F.lit(0))),
        "last_n": F.slice(values, F.greatest(n - start, F.lit(0)) + 1, F.lit(start)),
        "from_end": F.get(values, n - start),
    }


def invert(entries: DataFrame) -> DataFrame:
    """value -> sorted keys."""
    return entries.groupBy("value").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def invert_unique(entries: DataFrame) -> DataFrame:
    """value -> the last key that held it."""
    return entries.groupBy("value").agg(F.max_by("key", "pos").alias("key"))


def group_values(entries: DataFrame, unique: bool = False) -> DataFrame:
    """key -> values in order of position (distinct and sorted if unique)."""
    if unique:
        return entries.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("values"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return entries.groupBy("key").agg(F.transform(rows, lambda r: r["value"]).alias("values"))


def group_1d(series: DataFrame, gap: float, col: str = "value") -> DataFrame:
    """Adds `grp`: runs of a sorted column whose steps do not exceed the gap."""
    w = Window.partitionBy("key").orderBy(col, "pos")
    step = F.col(col) - F.lag(col).over(w)
    cut = series.withColumn("__b", F.when(step > gap, 1).otherwise(0))
    return cut.withColumn("grp", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")
