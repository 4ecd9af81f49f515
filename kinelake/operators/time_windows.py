"""Windows at offsets in time or in frames: forward, backward, uneven, and clamped at an episode's ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B


def nearest(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, tolerance: float, most: int = B.SIZE, name: str | None = None) -> DataFrame:
    """left with the value of right's row of the key nearest in time, before or after, and its distance (right's time less left's) in s.

    Of two equally near the earlier one; null where none is within tolerance seconds. ts is a number of seconds. One sort of
    both sides, read forwards and backwards; a key of more than most rows is cut along ts.
    """
    rest = [c for c in left.columns if c not in (key, ts)]
    rows = left.select(key, ts, F.struct(*(rest or [F.lit(1).alias("_")])).alias("_left"), F.lit(None).cast(_pair(right, ts, value)).alias("_pair"), F.lit(1).alias("_side"))
    other = right.where(F.col(ts).isNotNull()).select(key, ts, F.struct(F.col(ts).alias("t"), F.col(value).alias("v")).alias("_pair"), F.lit(0).alias("_side"))
    both = rows.unionByName(other, allowMissingColumns=True)
    cuts = B.cut_points(both.select(key, ts), key, ts, most)
    seen = B.running(both, cuts, {"_before": ("last", F.col("_pair"))}, ties=["_side"])
    seen = B.running(seen, cuts, {"_after": ("last", F.col("_pair"))}, backwards=True, ties=["_side"]).where("_side = 1")
    back, ahead = F.col(ts) - F.col("_before.t"), F.col("_after.t") - F.col(ts)
    pick = F.when(F.coalesce(back <= ahead, back.isNotNull()), F.col("_before")).otherwise(F.col("_after"))
    out = seen.withColumn("_pick", pick).withColumn("_gap", F.col("_pick.t") - F.col(ts))
    near = F.abs("_gap") <= tolerance
    return out.select(key, ts, *[f"_left.{c}" for c in rest], F.when(near, F.col("_pick.v")).alias(name or value), F.when(near, F.col("_gap")).alias("gap")).select(*left.columns, name or value, "gap")


def _pair(right: DataFrame, ts: str, value: str) -> str:
    return f"struct<t:{right.schema[ts].dataType.simpleString()},v:{right.schema[value].dataType.simpleString()}>"


def at_offsets(df: DataFrame, episode: str, ts: str, value: str, offsets: Sequence[float], tolerance: float, most: int = B.SIZE) -> DataFrame:
    """A row (k, offset, value, is_pad) for each row of df and each offset in seconds from its ts: the episode's frame nearest to it.

    A time before the first frame, or after the last one, by more than tolerance is clamped to it, and is_pad says so. Within the
    episode a time with no frame within tolerance has a null value. ts is a number of seconds.
    """
    ends = df.groupBy(episode).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    each = F.posexplode(F.array(*[F.lit(float(o)) for o in offsets])).alias("k", "offset")
    asked = df.select(episode, F.col(ts).alias("_own"), each).join(ends, episode)
    aim = F.col("_own") + F.col("offset")
    pad = (aim < F.col("_first") - tolerance) | (aim > F.col("_last") + tolerance)
    asked = asked.select(episode, F.col("_own"), "k", "offset", pad.alias("is_pad"), F.greatest(F.least(aim, F.col("_last")), F.col("_first")).alias(ts))
    found = nearest(asked, df.select(episode, ts, value), episode, ts, value, tolerance, most)
    return found.select(episode, F.col("_own").alias(ts), "k", "offset", value, "is_pad")


def at_frames(df: DataFrame, blocks: B.Strided, value: str, offsets: Sequence[int], name: str = "window") -> DataFrame:
    """df with name (values at offsets in frames, in their order) and name_is_pad (whether that frame lies outside the episode).

    Offsets may be uneven and negative; outside the episode its first or last frame stands. One exchange by (episode, block).
    """
    low, high = min(0, *offsets), max(0, *offsets)
    rows = blocks.with_halo(df, before=-low, after=high)
    seen = F.collect_list(F.struct(F.col(blocks.step).cast("long").alias("s"), F.col(value).alias("v"))).over(Window.partitionBy(blocks.episode, "_block").orderBy(blocks.step).rowsBetween(low, high))
    rows = rows.withColumn("_seen", seen).where("_own").drop("_block", "_own")
    first, last = F.get("_seen", F.lit(0))["s"], F.element_at("_seen", -1)["s"]
    at = F.transform(F.array(*[F.lit(int(o)) for o in offsets]), lambda o: F.col(blocks.step) + o)
    own = lambda t: F.get("_seen", (F.greatest(F.least(t, last), first) - first).cast("int"))["v"]
    return rows.withColumn(name, F.transform(at, own)).withColumn(f"{name}_is_pad", F.transform(at, lambda t: (t < first) | (t > last))).drop("_seen")


def offsets_in_frames(seconds: Sequence[float], fps: float) -> list[int]:
    """The nearest frame of each offset in time."""
    return [int(round(s * fps)) for s in seconds]


def stacked(rows: DataFrame, keys: Sequence[str], value: Column, order: str = "k") -> DataFrame:
    """Long windows as one array for each row; an offset for each element bounds it."""
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda p: p["v"]).alias("window"))
