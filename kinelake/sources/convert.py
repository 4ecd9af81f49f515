"""Robot logs as one episode dataset: sources united, steps and cameras joined, instructions looked up, actions put together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import images
from ..operators.reshape import with_language

# Fixed value: the instruction of an episode without one.
NO_INSTRUCTION = "Do something"


def united(sources: Sequence[DataFrame], episode: str = "episode_index") -> DataFrame:
    """The sources one after the other; a source's episodes are numbered from where the one before ends.

    One small aggregate for each source; columns that a source lacks are null.
    """
    out, offset = [], 0
    for i, s in enumerate(sources):
        out.append(s.withColumn(episode, (F.col(episode) + offset).cast("long")).withColumn("source_index", F.lit(i)))
        offset += (s.agg(F.max(episode)).first()[0] or 0) + 1
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def with_cameras(steps: DataFrame, frames: DataFrame, roles: Column, episode: str, step: str, height: int, width: int) -> DataFrame:
    """steps with a map from camera role to image; frames: (episode, step, image and what roles reads), blue first.

    Images are turned to red first and resized once they are needed, after the join.
    """
    ready = frames.select(episode, step, roles.alias("_role"), images.resized(images.flipped_channels(F.col("image")), height, width).alias("_image"))
    views = ready.groupBy(episode, step).agg(F.map_from_entries(F.collect_list(F.struct("_role", "_image"))).alias("images"))
    return steps.join(views, [episode, step])


def with_actions(steps: DataFrame, *parts: str) -> DataFrame:
    """actions: the parts' vectors in a row (a lone number counts as a vector of one)."""
    kinds = dict(steps.dtypes)
    return steps.withColumn("actions", F.concat(*[F.col(p) if kinds[p].startswith("array") else F.array(p) for p in parts]))


def with_task(steps: DataFrame, notes: DataFrame | None = None, key: str = "episode", constant: str | None = None) -> DataFrame:
    """task: one for all, or the episode's note, or what stands for none."""
    if notes is None:
        return steps.withColumn("task", F.lit(constant or NO_INSTRUCTION))
    return with_language(steps, notes.select(key, F.col("note").alias("task")), key, "task", NO_INSTRUCTION)


def moving_steps(steps: DataFrame, column: str = "movement_enabled") -> DataFrame:
    """Steps in which the robot was free to move; without the column or a value all are."""
    return steps.where(F.coalesce(F.col(column), F.lit(True))) if column in steps.columns else steps
