"""Normalisation statistics in one pass, as states that merge: over partitions, files, days or micro-batches.

A state is a row for each group: count, mean, sum of squared deviations, least and greatest value, and a KLL sketch of the
values. States of parts are merged into the state of the whole; its quantiles are within `rank_error(k)` of the asked rank
(exact while a group has no more than k values), whatever the order and the number of merges. With the values at hand,
`exact_quantiles` makes them exact in two more passes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 2048


def rank_error(k: int = K) -> float:
    """Half the width, as a share of the count, of the interval that holds a quantile's true rank in 99 of 100 cases."""
    return 2.296 / k**0.9723


def states(values: DataFrame, by: Sequence[str] = ("key", "dim"), k: int = K) -> DataFrame:
    """by, n, mean, m2, low, high, sketch of x in values; nulls don't count."""
    x = F.col("x").cast("double")
    rows = values.where("x IS NOT NULL").groupBy(*by)
    return rows.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count("*")).alias("m2"), F.min(x).alias("low"), F.max(x).alias("high"), F.kll_sketch_agg_double(x, k).alias("sketch"))


def merged(parts: DataFrame, by: Sequence[str] = ("key", "dim"), k: int = K) -> DataFrame:
    """One state for each group of states."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    # the means' own spread is their weighted variance, which no cancellation touches
    sums = parts.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), F.sum("m2").alias("_m2"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", k).alias("sketch"), F.collect_list(F.struct("n", "mean")).alias("_p"))
    between = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return sums.select(*by, "n", "mean", (F.col("_m2") + between).alias("m2"), "low", "high", "sketch")


def statistics(parts: DataFrame, by: Sequence[str] = ("key", "dim"), low: float = 0.01, high: float = 0.99) -> DataFrame:
    """by, n, mean, std (of the population), q01 and q99 that states tell."""
    q = lambda r: F.kll_sketch_get_quantile_double("sketch", F.lit(r))
    return parts.select(*by, "n", "mean", F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.col("n")).alias("std"), q(low).alias("q01"), q(high).alias("q99"))


def exact_quantiles(values: DataFrame, whole: DataFrame, quantiles: Mapping[str, float], by: Sequence[str] = ("key", "dim"), k: int = K) -> DataFrame:
    """by and, named, the value at place ceil(quantile x n) of each group's x in ascending order, exact however large the group.

    whole: the groups' states over the same values. The sketch brackets each quantile, one pass counts what lies below and within,
    and one more counts the distinct values within alone. A bracket that missed its place is the group's whole range instead.
    No task holds more than a bracket's distinct values, and the broadcast a row for each group.
    """
    by, names = list(by), list(quantiles)
    x, wide = F.col("x").cast("double"), 4 * rank_error(k)
    at = lambda r, end: F.col(end) if not 0 < r < 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(r))
    place = lambda q: F.greatest(F.lit(1), F.ceil(F.col("n").cast("decimal(20,0)") * F.lit(Decimal(str(q))))).cast("long")
    own = [F.struct(F.lit(i).alias("i"), place(q).alias("place"), at(q - wide, "low").alias("lo"), at(q + wide, "high").alias("hi")) for i, q in enumerate(quantiles.values())]
    rows = values.where("x IS NOT NULL").select(*by, x.alias("x"))

    def bracketed(table: DataFrame) -> DataFrame:
        """rows with their group's brackets (_b); null keys are a group too."""
        right = F.broadcast(table.select(*[F.col(c).alias(f"_{c}") for c in by], "_b"))
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
        return rows.join(right, same).select(*by, "x", "_b")

    each = bracketed(whole.select(*by, F.array(*own).alias("_b")))
    count = lambda test: F.sum(F.when(test, 1).otherwise(0))
    b = [F.col("_b")[i] for i in range(len(names))]
    found = each.groupBy(*by, "_b").agg(*[count(F.col("x") < v["lo"]).alias(f"_l{i}") for i, v in enumerate(b)], *[count(F.col("x") <= v["hi"]).alias(f"_h{i}") for i, v in enumerate(b)])

    def settled(i: int) -> Column:
        met = (F.col(f"_l{i}") < b[i]["place"]) & (b[i]["place"] <= F.col(f"_h{i}"))
        end = lambda v: F.when(met, v)
        return F.struct(F.lit(i).alias("i"), b[i]["place"].alias("place"), end(b[i]["lo"]).alias("lo"), end(b[i]["hi"]).alias("hi"), F.when(met, F.col(f"_l{i}")).otherwise(0).alias("below"))

    inside = F.filter("_b", lambda v: v["lo"].isNull() | ((F.col("x") >= v["lo"]) & (F.col("x") <= v["hi"])))
    told = bracketed(found.select(*by, F.array(*[settled(i) for i in range(len(names))]).alias("_b"))).select(*by, "x", F.explode(inside).alias("_v"))
    counts = told.groupBy(*by, "_v.i", "_v.place", "_v.below", "x").agg(F.count("*").alias("_c"))
    so_far = F.col("below") + F.sum("_c").over(Window.partitionBy(*by, "i").orderBy("x"))
    reached = counts.withColumn("_so_far", so_far).where("_so_far >= place")
    return reached.groupBy(*by).agg(*[F.min(F.when(F.col("i") == i, F.col("x"))).alias(name) for i, name in enumerate(names)])


def rank_of(x: Column) -> Column:
    """The share of a state's values that are at or below x."""
    return F.kll_sketch_get_rank_double("sketch", x)


def keep_states(stream: DataFrame, path: str, by: Sequence[str], k: int = K):
    """A streaming writer: each micro-batch's states in a folder of its own, so that a batch that is run again replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        states(batch, by, k).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(keep)


def read_states(spark, path: str, by: Sequence[str], k: int = K) -> DataFrame:
    """The state of everything that keep_states has written."""
    return merged(spark.read.parquet(path), by, k)
