"""Gapless numbers over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_of(key: Column, cuts: list) -> Column:
    """How many of the ascending cut points are at or below key (null: none), by halving: a few comparisons for each row."""
    return place_among(key, F.array(*[F.lit(c) for c in cuts]), len(cuts)) if cuts else F.lit(0)


def place_among(key: Column, points: Column, n: int) -> Column:
    """range_of for an ascending array of n points."""
    steps = [1 << b for b in reversed(range(n.bit_length()))]
    step = lambda place, s: place + F.when(F.get(points, place + s - 1) <= key, s).otherwise(0)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def with_row_index(df: DataFrame, key: str, name: str = "index", ranges: int | None = None, ties: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """df with name: its rows' places from 0 in ascending order of key (a number), then of ties; nulls come first.

    Ranges of the key are numbered each for itself and start at the number of rows before them. The driver receives the
    ranges' borders, and a row for each range is broadcast; neither grows with the input. total: a column for the number of rows.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 50 * n)).first()[0] or [])) if n > 1 else []
    placed = df.withColumn("_range", range_of(F.col(key), cuts))
    sums = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = [F.sum("_n").over(Window.partitionBy(F.lit(0))).alias(total)] if total else []
    starts = sums.select("_range", before.alias("_before"), *whole)  # as many rows as there are ranges
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_first(), *ties))
    return placed.withColumn("_row", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_range", "_row", "_before")
