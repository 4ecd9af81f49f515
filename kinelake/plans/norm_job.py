"""The job that makes a pipeline's normalisation statistics, and their way back into it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sketch
from ..operators import statistics as S
from ..operators.numbering import with_row_index
from ..operators.shuffle import Permutation
from ..sources import files
from .pipelines import Data

KEYS = ("state", "actions")


def counted_rows(df: DataFrame, key: str, batch: int, most: int | None = None, seed: int = 0) -> DataFrame:
    """The rows that make full batches: of all in order of key, or, with fewer than all asked for, of a shuffled choice of most."""
    n = df.count()
    numbered = with_row_index(df, key, "_index")
    if most is not None and most < n:
        place, left = Permutation(n, seed).place(F.col("_index")), most // batch * batch
    else:
        place, left = F.col("_index"), n // batch * batch
    return numbered.where(place < left).drop("_index")


def statistics_of(rows: DataFrame, keys: Sequence[str] = KEYS, sketched: bool = False) -> DataFrame:
    """key, mean, std, q01, q99 (arrays by dimension) of vector columns; sketched: in one pass, quantiles by rank error."""
    values = None
    for k in keys:
        own = S.vector_values(rows, k)
        values = own if values is None else values.unionByName(own)
    found = sketch.statistics(sketch.states(values)) if sketched else S.norm_stats(values)
    return S.stats_arrays(S.checked_stats(found))


def run(df: DataFrame, data: Data, folder: str, key: str, batch: int = 32, most: int | None = None, keys: Sequence[str] = KEYS, sketched: bool = False) -> Data:
    """Statistics of what the pipeline makes of a dataset's rows before normalising them, as folder/norm_stats.json.

    Gives the pipeline with those statistics. key (a number) orders the rows, and stays out of them.
    """
    made = data.for_stats()(counted_rows(df, key, batch, most))
    files.write_norm_stats(df.sparkSession, folder, statistics_of(made, keys, sketched))
    return with_stats(df.sparkSession, data, folder)


def loaded_stats(spark: SparkSession, folder: str) -> Mapping[str, Mapping[str, list[float]]]:
    """What a file of statistics holds, by key; a missing file raises FileNotFoundError."""
    return {r.key: {k: list(r[k]) for k in ("mean", "std", "q01", "q99") if r[k] is not None} for r in files.read_norm_stats(spark, folder).collect()}


def with_stats(spark: SparkSession, data: Data, folder: str) -> Data:
    return replace(data, stats=loaded_stats(spark, folder))
