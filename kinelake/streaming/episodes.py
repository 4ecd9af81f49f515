"""Keyed state over live steps: action-chunk brokers, latest values, running statistics, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def broker_stream(requests: DataFrame, horizon: int, key: str = "episode", step: str = "step", chunk: str = "chunk") -> DataFrame:
    """(key, step, offset, action) of a stream of requests: chunks are taken when the last one is used up, one action a step.

    The state of an episode is its chunk and how much of it is used; a request with reset = true begins anew. Requests
    are handled in order of step within a micro-batch. chunk is what the policy would answer at that step.
    """
    resets = "reset" in requests.columns
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(step).cast("long").alias("step"), F.col(chunk).cast("array<double>").alias("chunk"), (F.col("reset") if resets else F.lit(False)).alias("reset"))

    def step_on(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, used = state.get if state.exists else ([], horizon)
        held = [float(x) for x in held]
        out = []
        for r in pd.concat(list(frames)).sort_values("step").itertuples():
            if r.reset or used >= min(horizon, len(held)):
                held, used = [float(x) for x in r.chunk], 0
            out.append((k[0], r.step, used, float(held[used])))
            used += 1
        state.update((held, int(used)))
        yield pd.DataFrame(out, columns=["key", "step", "offset", "action"])

    return rows.groupBy("key").applyInPandasWithState(step_on, "key string, step long, offset int, action double", "chunk array<double>, used int", "append", GroupStateTimeout.NoTimeout)


def with_event_time(events: DataFrame, ts: str, late: str) -> DataFrame:
    """events with ts as a timestamp (watermarks need one) and a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, ts: str, size: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sliding(events: DataFrame, ts: str, size: str, slide: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def running_stats(values: DataFrame, *keys: str) -> DataFrame:
    """n, mean, std, min, max so far, from mergeable sums; for complete or update mode."""
    return values.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))


def first_seen(events: DataFrame, *keys: str) -> DataFrame:
    """events without repeats of keys within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def latest(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each key's last value; for complete or update mode."""
    return events.groupBy(key).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))
