"""Statistics and numeric series per key; a series is (key, pos, value)."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(series: DataFrame) -> DataFrame:
    """Mean, count and sum."""
    return series.groupBy("key").agg(F.avg("value").alias("mean"), F.count("value").alias("n"), F.sum("value").alias("total"))


def _with_mean(series: DataFrame) -> DataFrame:
    """Joined to the aggregate rather than windowed: the key's rows need not meet in one task."""
    return series.join(series.groupBy("key").agg(F.avg("value").alias("mean")), "key")


def abs_deviation(series: DataFrame) -> DataFrame:
    """Each value's absolute deviation from its key's mean."""
    return _with_mean(series).select("key", "pos", F.abs(F.col("value") - F.col("mean")).alias("deviation"))


def mean_abs_deviation(series: DataFrame) -> DataFrame:
    return abs_deviation(series).groupBy("key").agg(F.avg("deviation").alias("mad"))


def variances(series: DataFrame) -> DataFrame:
    return series.groupBy("key").agg(F.var_pop("value").alias("var_pop"), F.var_samp("value").alias("var_samp"))


def quantiles(series: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(key, n, one column a share): exact quantiles of each key's values, between neighbours by share. Values
    are ranked in ranges, so that no task holds a key's values together."""
    from rasterloom.operators.ranges import ranked

    values = ranked(series.where("value is not null").select("key", F.col("value").cast("double").alias("value")), "key", "rank", F.col("value"))
    n = series.groupBy("key").agg(F.count("value").alias("n"))
    wanted = n.withColumn("share", F.explode(F.array(*[F.lit(float(p)) for p in shares.values()])))
    wanted = wanted.withColumn("at", F.col("share") * (F.col("n") - 1)).withColumn("k", F.explode(F.array(F.floor("at"), F.floor("at") + 1)))
    # The neighbour above the last value has no share.
    weight = 1 - F.abs(F.col("at") - F.col("k"))
    found = wanted.withColumn("w", weight).where("w > 0").join(values.select("key", F.col("rank").alias("k"), "value"), ["key", "k"])
    pick = [F.sum(F.when(F.col("share") == p, F.col("value") * F.col("w"))).alias(name) for name, p in shares.items()]
    return n.join(found.groupBy("key").agg(*pick), "key", "left")


def iqr_fences(series: DataFrame) -> DataFrame:
    """Whole-number fences 1.5 interquartile ranges outside the quartiles; 0, 0 for fewer than four
    values or equal quartiles."""
    q = quantiles(series, {"q1": 0.25, "q3": 0.75})
    q1, q3 = F.col("q1"), F.col("q3")
    usable = (F.col("n") >= 4) & (q3 - q1 > 0)
    return q.select(
        "key",
        F.when(usable, F.floor(q1 - (q3 - q1) * 1.5)).otherwise(0).cast("long").alias("low"),
        F.when(usable, F.ceil(q3 + (q3 - q1) * 1.5)).otherwise(0).cast("long").alias("high"),
    )


def without_outliers(series: DataFrame) -> DataFrame:
    """Values inside the fences; keys without usable fences keep all."""
    f = iqr_fences(series)
    ok = (F.col("low") == 0) & (F.col("high") == 0) | F.col("value").between(F.col("low"), F.col("high"))
    return series.join(f, "key").where(ok).select("key", "pos", "value")


def mean_abs_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean absolute difference of two series by position."""
    both = a.join(b.select("key", "pos", F.col("value").alias("other")), ["key", "pos"])
    return both.groupBy("key").agg(F.avg(F.abs(F.col("value") - F.col("other"))).alias("difference"))


def value_range(series: DataFrame) -> DataFrame:
    """Last value minus first, by position."""
    return series.groupBy("key").agg((F.max_by("value", "pos") - F.min_by("value", "pos")).alias("range"))


def simpson_area(series: DataFrame, step: float = 1.0) -> DataFrame:
    """Simpson's rule over evenly spaced values; an odd number of intervals closes with a trapezoid."""
    order = Window.partitionBy("key").orderBy("pos")
    ranked = series.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("key")), "before": F.lag("value").over(order)})
    last = F.col("n") - 1 - (F.col("n") - 1) % 2  # end of the Simpson part
    weight = F.when(F.col("i") > last, 0).when((F.col("i") == 0) | (F.col("i") == last), 1).when(F.col("i") % 2 == 1, 4).otherwise(2)
    weight = F.when(last == 0, 0).otherwise(weight)
    tail = F.when((F.col("i") > last), (F.col("value") + F.col("before")) / 2 * step).otherwise(0.0)
    return ranked.groupBy("key").agg((F.sum(weight * F.col("value")) * (step / 3) + F.sum(tail)).alias("area"))


def lagrange(nodes: DataFrame, at: DataFrame, degree: int = 3, exclude_self: bool = True) -> DataFrame:
    """Interpolated value at every `at` (key, x): Lagrange polynomial through the nearest nodes
    (key, x, y) on both sides, (degree + 1) / 2 a side and more from the side that has them."""
    n = degree + 1
    # A node's number, and how many nodes lie up to each query: no query meets more than its neighbours.
    order = Window.partitionBy("key").orderBy("x")
    numbered = nodes.select("key", "x", "y", F.row_number().over(order).alias("i"))
    node = F.struct("x", "i").alias("node")
    both = numbered.select("key", "x", node).unionAll(at.select("key", "x", F.lit(None).cast(numbered.select(node).schema["node"].dataType)).distinct())
    upto = Window.partitionBy("key").orderBy("x", F.asc_nulls_last("node")).rowsBetween(Window.unboundedPreceding, 0)
    q = both.withColumn("below", F.last("node", True).over(upto)).where("node is null").select("key", F.col("x").alias("q"), "below")
    number = F.coalesce("below.i", F.lit(0))
    left = F.when(F.col("below.x") == F.col("q"), number - 1).otherwise(number) if exclude_self else number
    places = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(k.alias("k"), (left - k + 1).alias("left"), (number + k).alias("right")))
    near = q.withColumn("p", F.explode(places))
    near = near.select("key", "q", "p.k", F.explode(F.array("p.left", "p.right")).alias("i")).join(numbered, ["key", "i"])
    pick = Window.partitionBy("key", "q").orderBy("k", F.abs(F.col("x") - F.col("q")))
    chosen = near.withColumn("o", F.row_number().over(pick)).where(F.col("o") <= n).select("key", "q", "x", "y")
    other = chosen.select("key", "q", F.col("x").alias("x2"))
    pairs = chosen.join(other, ["key", "q"]).where("x <> x2")
    basis = pairs.groupBy("key", "q", "x", "y").agg(F.product((F.col("q") - F.col("x2")) / (F.col("x") - F.col("x2"))).alias("basis"))
    return basis.groupBy("key", "q").agg(F.sum(F.col("y") * F.col("basis")).alias("y")).withColumnRenamed("q", "x")


def lagrange_basis(nodes: Column, index: int, x: float) -> Column:
    """Value at x of the basis polynomial of one node of an array."""
    own = F.get(nodes, index)
    term = lambda acc, v: F.when(v == own, acc).otherwise(acc * F.try_divide(F.lit(x) - v, own - v))
    return F.aggregate(nodes, F.lit(1.0), term)


STEP_MODES = ("prefast", "sloped", "continuous")


def step_count(x: Column, thresholds: Column, mode: str = "sloped") -> Column:
    """How many thresholds lie below x: strictly (prefast), or at it too (sloped); `continuous` adds a
    smooth ramp for the step being climbed."""
    if mode not in STEP_MODES:
        raise ValueError(f"unknown mode {mode}")
    below = F.size(F.filter(thresholds, lambda a: a < x if mode == "prefast" else a <= x))
    if mode != "continuous":
        return below.cast("double")
    root = lambda d: F.signum(d) * F.pow(F.abs(d), F.lit(1 / 27))
    return F.aggregate(thresholds, F.lit(0.0), lambda acc, a: acc + F.least(F.greatest(0.5 + 0.5 * root(x - a), F.lit(0.0)), F.lit(1.0)))


def next_step(x: Column, thresholds: Column) -> Column:
    return F.array_min(F.filter(thresholds, lambda a: a > x))


def previous_step(x: Column, thresholds: Column) -> Column:
    return F.array_max(F.filter(thresholds, lambda a: a < x))


def add_step(thresholds: Column, a) -> Column:
    return F.array_sort(F.array_distinct(F.array_append(thresholds, F.lit(a))))


def remove_step(thresholds: Column, a) -> Column:
    return F.array_remove(thresholds, a)


def sum_range(low: Column, high: Column, term) -> Column:
    """Sum of term(i) over low..high."""
    return F.aggregate(F.sequence(low, high), F.lit(0.0), lambda acc, i: acc + term(i))


def product_range(low: Column, high: Column, term) -> Column:
    return F.aggregate(F.sequence(low, high), F.lit(1.0), lambda acc, i: acc * term(i))
