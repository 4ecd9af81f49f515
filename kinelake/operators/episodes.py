"""Steps of episodes: indices, idle stretches, allow-lists, action chunks, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_step_index(df: DataFrame, episode: str, order: str, name: str = "step") -> DataFrame:
    """The step's place in its episode, from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(episode).orderBy(order)) - 1).cast("int"))


def with_idle(df: DataFrame, episode: str, step: str, vector: Column, threshold: float, name: str = "idle") -> DataFrame:
    """Whether every dimension changed by less than threshold since the step before; an episode's first step isn't idle."""
    before = F.lag(vector).over(Window.partitionBy(episode).orderBy(step))
    still = F.forall(F.zip_with(vector, before, lambda a, b: F.abs(a - b) < threshold), lambda x: x)
    return df.withColumn(name, F.coalesce(still, F.lit(False)))


def runs(df: DataFrame, episode: str, step: str, flag: str) -> DataFrame:
    """episode, flag, start, length of each maximal run of steps with equal flags."""
    own = Window.partitionBy(episode, flag).orderBy(step)
    island = df.select(episode, step, flag, (F.row_number().over(Window.partitionBy(episode).orderBy(step)) - F.row_number().over(own)).alias("_island"))
    return island.groupBy(episode, flag, "_island").agg(F.min(step).alias("start"), F.count("*").cast("int").alias("length")).drop("_island")


def keep_ranges(df: DataFrame, episode: str, step: str, vector: Column, threshold: float = 1e-3, min_idle: int = 7, min_keep: int = 16, trim: int = 10) -> DataFrame:
    """Half-open step ranges (episode, start, end) worth keeping.

    Idle runs of min_idle steps or more are dropped; of what is left, runs of min_keep or more stay, but for their last
    trim steps. Steps count from 0 without gaps. One shuffle, by episode; everything else keeps that partitioning.
    """
    in_order = Window.partitionBy(episode).orderBy(step)
    idle = with_idle(df.select(episode, step, vector.alias("_v")), episode, step, F.col("_v"), threshold, "_idle")
    island = F.col(step) - F.row_number().over(Window.partitionBy(episode, "_idle").orderBy(step))
    long_run = F.count("*").over(Window.partitionBy(episode, "_idle", "_island")) >= min_idle
    kept = idle.withColumn("_island", island).withColumn("_keep", ~(F.col("_idle") & long_run)).select(episode, step, "_keep")
    changes = F.when(F.col("_keep") != F.lag("_keep", 1, False).over(in_order), 1).otherwise(0)
    numbered = kept.withColumn("_run", F.sum(changes).over(in_order)).where("_keep")
    found = numbered.groupBy(episode, "_run").agg(F.min(step).alias("start"), F.count("*").alias("_n")).where(F.col("_n") >= min_keep)
    return found.select(episode, F.col("start").cast("int").alias("start"), (F.col("start") + F.col("_n") - trim).cast("int").alias("end"))


def allow_frames(steps: DataFrame, ranges: DataFrame | None, episode: str, step: str) -> DataFrame:
    """Steps that lie in a range (episode, start, end) of their episode; without ranges all of them.

    The ranges stay intervals: an equi-join on the episode with the interval as a condition, not a row for each frame.
    """
    if ranges is None:
        return steps
    r = ranges.select(F.col(episode).alias("_e"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    return steps.join(r, (F.col(episode) == F.col("_e")) & (F.col(step) >= F.col("_start")) & (F.col(step) < F.col("_end")), "left_semi")


def action_chunks(df: DataFrame, episode: str, step: str, action: str, horizon: int, name: str = "chunk") -> DataFrame:
    """Of each step the actions of it and the next ones, horizon in all; at the end the last one is repeated.

    Chunks see all steps: filter afterwards. An episode's steps meet in one task; at most horizon of them are held in a row.
    """
    ahead = Window.partitionBy(episode).orderBy(step).rowsBetween(0, horizon - 1)
    own = F.collect_list(action).over(ahead)
    return df.withColumn(name, F.concat(own, F.array_repeat(F.element_at(own, -1), horizon - F.size(own))))


def brokered(df: DataFrame, episode: str, step: str, chunk: str, horizon: int) -> DataFrame:
    """What an agent does that asks for a chunk, carries it out, and only then asks again: infer_step, offset and action.

    The chunk of a step is its infer_step's; action is its element at offset.
    """
    first = F.first(chunk).over(Window.partitionBy(episode, "infer_step").orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df.withColumn("infer_step", (F.floor(F.col(step) / horizon) * horizon).cast("int")).withColumn("offset", (F.col(step) % horizon).cast("int"))
    return out.withColumn("action", F.get(first, F.col("offset")))


def arrival_rate(df: DataFrame, key: str, ts: str, last: int = 50) -> DataFrame:
    """df with rate: one over the mean distance of the last arrivals of the key, in 1/s; null for the first."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.avg("_gap").over(w.rowsBetween(-(last - 2), 0))
    between = F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts)) / 1e6
    return df.withColumn("_gap", between).withColumn("rate", 1 / F.when(gap != 0, gap)).drop("_gap")


def joined_until_missing(steps: DataFrame, frames: DataFrame, episode: str, step: str) -> DataFrame:
    """Steps with their frames, each episode up to its first step without one."""
    there = steps.join(frames.withColumn("_there", F.lit(True)), [episode, step], "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    so_far = F.min("_there").over(Window.partitionBy(episode).orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    return there.withColumn("_so_far", so_far).where("_so_far").drop("_there", "_so_far")


def sampled_steps(df: DataFrame, episode: str, step: str, n: int, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """n steps of each episode (or all), without replacement: those of the least draw, by default a hash of episode and step."""
    w = Window.partitionBy(episode).orderBy(F.xxhash64(F.lit(seed), episode, step) if draw is None else draw, step)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def interpolated(df: DataFrame, start: Column, stop: Column, count: Column) -> DataFrame:
    """count rows (tick, value) for each row, evenly from start to stop, ends included."""
    out = df.withColumn("_count", count.cast("int")).where("_count > 0").withColumn("tick", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    share = F.col("tick") / F.greatest(F.col("_count") - 1, F.lit(1))
    return out.withColumn("value", start + (stop - start) * share).drop("_count")


def chosen_once(key: Column, options: Sequence[Column], seed: int = 0) -> Column:
    """One of the options, the same for all rows of a key."""
    return F.get(F.array(*options), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(len(options))).cast("int"))


def latest_by_key(df: DataFrame, key: str, ts: str, *values: str) -> DataFrame:
    """The values of each key's last row."""
    return df.groupBy(key).agg(*[F.max_by(v, ts).alias(v) for v in values], F.max(ts).alias(ts))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """left with value of right's last row of the key at or before ts: one sort of both, not a join of pairs."""
    both = left.withColumn("_right", F.lit(0)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(key, ts, F.col(value).alias("_value"), F.lit(1).alias("_right")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(ts, F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_right = 0").drop("_right", "_value")


def with_previous(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """df with the value of the key's row before; null for the first."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def cut_episodes(df: DataFrame, step: str, most: int) -> DataFrame:
    """Steps from most on are left out."""
    return df.where(F.col(step) < most)
