"""A dataset folder: declared features and frame rate, tasks, and steps in files by episodes."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocks import SIZE, Strided
from ..operators.reshape import with_task_prompt
from ..operators.time_windows import at_frames
from .files import read_dataset_info, window_steps, write_steps, write_text


def declared(df: DataFrame, features: T.StructType, exact: bool = True) -> DataFrame:
    """df with the declared columns alone, in order, cast to their types; fails for one that is missing, of another kind, or (exact) not declared.

    Numbers may be cast to numbers, and arrays of them to such arrays; anything else has to be of the type declared.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    if gone := [f.name for f in features.fields if f.name not in have]:
        raise ValueError(f"missing: {gone}")
    if exact and (odd := [c for c in df.columns if c not in features.names]):
        raise ValueError(f"not declared: {odd}")

    def fits(a: T.DataType, b: T.DataType) -> bool:
        if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
            return fits(a.elementType, b.elementType)
        return a == b or isinstance(a, T.NumericType) and isinstance(b, T.NumericType) or a.simpleString() == b.simpleString()

    if wrong := [f.name for f in features.fields if not fits(have[f.name], f.dataType)]:
        raise ValueError(f"of another type: {[(n, have[n].simpleString(), features[n].dataType.simpleString()) for n in wrong]}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in features.fields])


def checked_sizes(df: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """df; a row whose array is not of its declared size fails."""
    for c, n in sizes.items():
        odd = F.raise_error(F.concat(F.lit(f"{c} has "), F.size(c).cast("string"), F.lit(f" elements, not {n}")))
        df = df.withColumn(c, F.when(F.size(c) == n, F.col(c)).when(F.col(c).isNull(), F.lit(None)).otherwise(odd.cast(df.schema[c].dataType)))
    return df


def write_dataset(df: DataFrame, folder: str, features: T.StructType, fps: float, tasks: Mapping[int, str] | None = None, sizes: Mapping[str, int] | None = None, episode: str = "episode_index", step: str = "frame_index") -> None:
    """Declared columns, in place of the dataset that is there: data/, then meta/tasks.jsonl, and meta/info.json last."""
    spark, base = df.sparkSession, folder.rstrip("/")
    write_steps(checked_sizes(declared(df, features), sizes or {}), f"{base}/data", episode, step)
    write_text(spark, f"{base}/meta/tasks.jsonl", "".join(json.dumps({"task_index": k, "task": v}) + "\n" for k, v in sorted((tasks or {}).items())))
    write_text(spark, f"{base}/meta/info.json", json.dumps({"fps": fps, "features": json.loads(features.json()), "sizes": dict(sizes or {})}))


def read_features(spark: SparkSession, folder: str) -> T.StructType:
    """The features that a dataset declares."""
    whole = spark.read.text(f"{folder.rstrip('/')}/meta/info.json", wholetext=True).first()[0]
    return T.StructType.fromJson(json.loads(whole)["features"])


def read_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """A dataset's steps, by its declared features."""
    features = read_features(spark, folder)
    return spark.read.schema(features).parquet(f"{folder.rstrip('/')}/data").select(*features.names)


def folder_sizes(found: DataFrame, depth: int) -> DataFrame:
    """files and bytes of find_files' rows by folder, its first depth parts."""
    folder = F.array_join(F.slice(F.split(F.regexp_replace("path", r"^\w+:/*", "/"), "/"), 2, depth), "/")
    return found.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def with_checkpoint(df: DataFrame, environment: str, checkpoints: Mapping[str, tuple[str, str]], own: Column | None = None) -> DataFrame:
    """df with config and checkpoint of the row's environment; own: a struct of both that goes first. An environment that isn't known fails."""
    pairs = F.create_map(*[x for k, (c, p) in checkpoints.items() for x in (F.lit(k), F.struct(F.lit(c).alias("config"), F.lit(p).alias("checkpoint")))])
    found = pairs[F.col(environment)]
    known = F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no checkpoint for "), F.coalesce(F.col(environment), F.lit("null")))).cast("struct<config:string,checkpoint:string>"))
    chosen = known if own is None else F.coalesce(own, known)
    return df.withColumn("_c", chosen).select(*df.columns, "_c.config", "_c.checkpoint")


def read_windows(spark: SparkSession, folder: str, seconds: Mapping[str, Sequence[float]], episode: str = "episode_index", step: str = "frame_index", block: int = SIZE) -> DataFrame:
    """A dataset's steps with columns as windows at offsets in seconds (the dataset's rate makes them frames), each with <column>_is_pad.

    Offsets may be uneven and negative, but have to lie on frames; outside its episode a window repeats the first or the last frame.
    With task_index among the features the task's text is the prompt.
    """
    fps, tasks = read_dataset_info(spark, folder)
    rows = read_dataset(spark, folder)
    for column, own in seconds.items():
        made = at_frames(rows, Strided(episode, step, block), column, window_steps(own, fps), "_window")
        rows = made.drop(column).withColumnsRenamed({"_window": column, "_window_is_pad": f"{column}_is_pad"})
    return with_task_prompt(rows, tasks) if tasks and "task_index" in rows.columns else rows
