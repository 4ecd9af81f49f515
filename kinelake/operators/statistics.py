"""Normalisation statistics and other aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import range_of

BINS = 5000


def vector_values(df: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """key, dim, x of every element of a vector column, whatever dimensions lie before the last one."""
    depth = df.schema[column].dataType.simpleString().count("array<")
    x = F.col(column)
    for _ in range(depth - 1):
        df, x = df.withColumn("_flat", F.explode(x)), F.col("_flat")
    return df.select(F.lit(key or column).alias("key"), F.posexplode(x).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def norm_stats(values: DataFrame, by: Sequence[str] = ("key", "dim"), low: float = 0.01, high: float = 0.99, bins: int = BINS) -> DataFrame:
    """n, mean, std (of the population), q01 and q99 of x for each group.

    A quantile is the left edge of the first of bins equal parts of [min, max] at which the cumulated count reaches its
    share, so it is exact to one part. Two passes, each an aggregate of a few numbers (and of bins) for a group. The values
    meet their group's range by a broadcast of one row for each group, so that they are never shuffled by group.
    """
    by = list(by)
    whole = values.groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("_min"), F.max("x").alias("_max"))
    width = (F.col("_max") - F.col("_min")) / bins
    part = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("_min")) / width), F.lit(bins - 1))).otherwise(0)
    histogram = values.where("x IS NOT NULL").join(F.broadcast(whole.select(*by, "_min", "_max")), by).groupBy(*by, part.alias("_part")).agg(F.count("*").alias("_count"))
    so_far = F.sum("_count").over(Window.partitionBy(*by).orderBy("_part"))
    reached = histogram.withColumn("_so_far", so_far).join(whole.select(*by, "n"), by).groupBy(*by).agg(
        *[F.min(F.when(F.col("_so_far") >= F.col("n") * q, F.col("_part"))).alias(name) for q, name in ((low, "_low"), (high, "_high"))]
    )
    edge = lambda p: F.col("_min") + F.col(p) * width
    return whole.join(reached, by).select(*by, "n", "mean", "std", edge("_low").alias("q01"), edge("_high").alias("q99"))


def exact_stats(values: DataFrame, by: Sequence[str], quantiles: Sequence[float], ranges: int | None = None) -> DataFrame:
    """n, mean, std and exact interpolated quantiles of x for each group; no task holds a whole group.

    Distinct values are counted, numbered within ranges of x of about as many of them each, and offset by the counts of the
    group's ranges before; a quantile lies between the values at the two places around it.
    """
    by, names = list(by), [f"p{round(q * 100):02d}" for q in quantiles]
    k = ranges or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = values.where("x IS NOT NULL").groupBy(*by, F.col("x").cast("double").alias("x")).agg(F.count("*").alias("_c"))
    cuts = sorted(set(counts.agg(F.percentile_approx("x", [i / k for i in range(1, k)], 50 * k)).first()[0] or [])) if k > 1 else []
    placed = counts.withColumn("_range", range_of(F.col("x"), cuts))
    so_far = lambda *w: F.coalesce(F.sum("_c").over(Window.partitionBy(*w).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = placed.groupBy(*by, "_range").agg(F.sum("_c").alias("_c")).withColumn("_o", F.col("_range"))
    starts = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_r"), so_far(*by).alias("_start"), F.sum("_c").over(Window.partitionBy(*by)).alias("_n"))
    own = placed.withColumn("_o", F.col("x")).withColumn("_own", so_far(*by, "_range"))
    same = F.col("_range") == F.col("_r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    first = F.col("_start") + F.col("_own")
    ends = []
    for q, name in zip(quantiles, names, strict=True):
        at = (F.col("_n") - 1) * F.lit(float(q))
        for place, end in ((F.floor(at), "l"), (F.ceil(at), "h")):
            ends.append(F.max(F.when((first <= place) & (place < first + F.col("_c")), F.col("x"))).alias(f"_{end}{name}"))
    found = own.join(starts, same).groupBy(*by).agg(*ends).select(*[F.col(c).alias(f"_{c}") for c in by], *[f"_{e}{n}" for n in names for e in "lh"])
    whole = values.groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    def between(q: float, name: str) -> Column:
        at, low, high = (F.col("n") - 1) * F.lit(float(q)), F.col(f"_l{name}"), F.col(f"_h{name}")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name)

    return whole.join(found, same, "left").select(*by, "n", "mean", "std", *[between(q, n) for q, n in zip(quantiles, names, strict=True)])


def stats_arrays(stats: DataFrame, key: str = "key") -> DataFrame:
    """One row for each key, with arrays over dimensions: mean, std, q01, q99."""
    names = ("mean", "std", "q01", "q99")
    rows = stats.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dim", *names))).alias("_s"))
    return rows.select(key, *[F.col(f"_s.{n}").alias(n) for n in names])


def checked_stats(stats: DataFrame) -> DataFrame:
    """Fails where a group has fewer than two values."""
    return stats.withColumn("n", F.when(F.col("n") < 2, F.raise_error(F.lit("statistics need two values at least"))).otherwise(F.col("n")))


def success_rates(df: DataFrame, group: str, success: Column) -> DataFrame:
    """The share of success for each group, and over all (is_total = 1)."""
    rows = df.select(F.col(group), success.cast("double").alias("_s"))
    return rows.rollup(group).agg(F.grouping_id().cast("int").alias("is_total"), F.count("*").alias("n"), F.avg("_s").alias("rate"))


def interval_means(df: DataFrame, step: str, size: int, *metrics: str) -> DataFrame:
    """Means of metrics over intervals of steps; nulls don't count."""
    at = F.floor(F.col(step) / size).cast("long").alias("interval")
    return df.groupBy(at).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def moving_average(df: DataFrame, key: str, order: str, value: str, decay: float) -> DataFrame:
    """The last value of avg <- decay avg + (1 - decay) value for each key, begun with its first value.

    As a weighted sum: value t of n weighs (1 - decay) decay**(n - 1 - t), the first one without its (1 - decay), so that
    no key's values have to meet in one array.
    """
    w = Window.partitionBy(key).orderBy(order)
    t, left = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(key)) - F.row_number().over(w)
    weight = F.pow(F.lit(decay), left) * F.when(t == 0, 1.0).otherwise(1 - decay)
    return df.select(key, (F.col(value) * weight).alias("_w")).groupBy(key).agg(F.sum("_w").alias("average"))


def global_norm(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))


def ended(df: DataFrame, batch: str, tokens: str, end: int) -> DataFrame:
    """Whether all of a batch's token arrays hold the end token."""
    return df.groupBy(batch).agg(F.every(F.array_contains(tokens, end)).alias("all_ended"), F.some(F.array_contains(tokens, end)).alias("any_ended"))


def latest_checkpoint(names: DataFrame, name: str) -> DataFrame:
    """The greatest step among names that are numbers."""
    return names.where(F.col(name).rlike("^[0-9]+$")).agg(F.max(F.col(name).cast("long")).alias("step"))
