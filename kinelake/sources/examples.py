"""Rows as robots send them, made up: for tests and trials of what takes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.noise import uniform_at

SIDE, PROMPT = 224, "do something"


def _vector(place: str, n: int, seed: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: uniform_at(seed, place, F.col("id"), i))


def _picture(place: str, seed: int, side: int, channels_first: bool = False) -> Column:
    """Random bytes by digests, eight of 32 at a time."""
    n = side * side * 3
    digests = F.transform(F.sequence(F.lit(0), F.lit(-(-n // 32) - 1)), lambda i: F.sha2(F.concat_ws(":", F.lit(f"{seed}:{place}"), F.col("id").cast("string"), i.cast("string")).cast("binary"), 256))
    data = F.unhex(F.substring(F.array_join(digests, ""), 1, 2 * n))
    h, w, c = (3, side, side) if channels_first else (side, side, 3)
    return F.struct(F.lit(h).alias("height"), F.lit(w).alias("width"), F.lit(c).alias("channels"), data.alias("data"))


def two_arm_rows(spark: SparkSession, rows: int, seed: int = 0, side: int = SIDE) -> DataFrame:
    """All-ones states, four cameras' pictures with channels first, and a prompt."""
    cameras = ("cam_high", "cam_low", "cam_left_wrist", "cam_right_wrist")
    views = F.create_map(*[x for c in cameras for x in (F.lit(c), _picture(c, seed, side, True))])
    return spark.range(rows).select(F.array_repeat(F.lit(1.0), 14).alias("state"), views.alias("images"), F.lit(PROMPT).alias("prompt"))


def field_arm_rows(spark: SparkSession, rows: int, seed: int = 0, side: int = SIDE) -> DataFrame:
    """Two pictures, seven joints and a gripper in [0, 1), and a prompt, under the names that requests have."""
    views = [_picture(v, seed, side).alias(f"observation/{v}") for v in ("exterior_image_1_left", "wrist_image_left")]
    return spark.range(rows).select(*views, _vector("joints", 7, seed).alias("observation/joint_position"), _vector("gripper", 1, seed).alias("observation/gripper_position"), F.lit(PROMPT).alias("prompt"))


def table_arm_rows(spark: SparkSession, rows: int, seed: int = 0, side: int = SIDE) -> DataFrame:
    """Two pictures, a state of eight numbers in [0, 1), and a prompt."""
    views = [_picture(v, seed, side).alias(f"observation/{v}") for v in ("image", "wrist_image")]
    return spark.range(rows).select(_vector("state", 8, seed).alias("observation/state"), *views, F.lit(PROMPT).alias("prompt"))
