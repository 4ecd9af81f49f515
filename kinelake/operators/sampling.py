"""Mixing, shuffling, batching and sharding of rows, all decided by arithmetic on their keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from .numbering import with_row_index

_PRIME, _MODULUS = 2_654_435_761, 1 << 32


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on an integer key and the seed alone."""
    a = F.pmod(key.cast("long") * 69_069 + seed * 7_919 + 12_345, F.lit(_MODULUS))
    b = F.pmod(F.pmod(a, F.lit(65_536)) * 40_503 + F.floor(a / 65_536) * 30_011 + seed, F.lit(_MODULUS))
    return F.pmod(b * 69_069 + 1, F.lit(_MODULUS)) / _MODULUS


def weighted_mix(df: DataFrame, source: str, key: str, weights: Mapping[str, float], total: int, seed: int = 0) -> DataFrame:
    """Rows of each source so often that it makes up its weight of total rows: the rate's whole part, and one more by chance.

    Sources without a weight are left out. Weights must sum to 1. One small count for each source is broadcast.
    """
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    named = df.where(F.col(source).isin(*weights))
    goal = F.create_map(*[F.lit(v) for k, w in weights.items() for v in (k, float(w * total))])
    counts = named.groupBy(source).agg(F.count("*").alias("_n"))  # at most a row for each weight
    rated = named.join(F.broadcast(counts), source).withColumn("_copies", F.floor(goal[F.col(source)] / F.col("_n") + uniform(F.col(key), seed)).cast("int"))
    return rated.where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_n", "_copies")


def sampled(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    return df.where(uniform(F.col(key), seed) < share)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A total order that the seed decides; ranges of it are the output's partitions."""
    return df.orderBy(uniform(F.col(key), seed), key)


def chosen_code(logits: Column, temperature: float, draw: Column) -> Column:
    """The place of the greatest logit where temperature is 0 or less; else a place drawn with softmax(logits / temperature).

    draw: a number in [0, 1); the place is the first one up to which the probabilities add up to more.
    """
    if temperature <= 0:
        return arrays.arg_max(logits)
    shares = arrays.softmax(F.transform(logits, lambda v: v / temperature))
    step = lambda s, p: F.struct((s["sum"] + p).alias("sum"), (s["at"] + (s["sum"] + p <= draw).cast("int")).alias("at"))
    passed = F.aggregate(shares, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at")), step, lambda s: s["at"])
    return F.least(passed, F.size(logits) - 1)


def batches(df: DataFrame, key: str, size: int, drop_last: bool = False, most_rows: int | None = None) -> DataFrame:
    """df with index and batch (index // size); drop_last leaves out a batch that isn't full; most_rows // size batches at most."""
    out = with_row_index(df, key, total="_all").withColumn("batch", F.floor(F.col("index") / size).cast("long"))
    if drop_last:
        out = out.where(F.col("batch") < F.floor(F.col("_all") / size))
    return (out if most_rows is None else out.where(F.col("batch") < most_rows // size)).drop("_all")


def loaded(df: DataFrame, key: str, size: int, times: int = 1) -> DataFrame:
    """Full batches, times over (column epoch); fails where there are fewer rows than a batch takes."""
    if (n := df.count()) < size:
        raise ValueError(f"a batch of {size} is more than the {n} rows there are")
    full = with_row_index(df, key).where(F.col("index") < n // size * size).withColumn("batch", F.floor(F.col("index") / size).cast("long"))
    return repeated(full, times)


def rank_shard(df: DataFrame, key: str, world: int, rank: int, drop_last: bool = True) -> DataFrame:
    """Every world-th row from rank on; drop_last gives all ranks the same number."""
    out = with_row_index(df, key, total="_all").where(F.col("index") % world == rank)
    return (out.where(F.col("index") < F.floor(F.col("_all") / world) * world) if drop_last else out).drop("_all")


def collated(df: DataFrame, batch: str, order: str, *columns: str) -> DataFrame:
    """One row for each batch, its columns as arrays in order; a batch's size bounds what a task gathers."""
    rows = df.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("_rows"))
    return rows.select(batch, *[F.col(f"_rows.{c}").alias(c) for c in columns])


def repeated(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def nearest_name(names: DataFrame, name: str, wanted: str) -> DataFrame:
    """The name of the least edit distance."""
    return names.select(name, F.levenshtein(F.col(name), F.lit(wanted)).alias("distance")).orderBy("distance", name).limit(1)
