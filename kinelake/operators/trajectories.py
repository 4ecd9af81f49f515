"""Raw robot trajectories as training frames: which episodes, which views and instructions, which steps, what they hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames
from ..functions.text import step_id
from . import blocks as B
from .episodes import allow_frames, chosen_once, joined_until_missing

SPACES = ("joint_position", "joint_velocity")


def successful(episodes: DataFrame, file_path: str, word: str = "success") -> DataFrame:
    """Episodes whose file's path, in any line of it, holds the word; a null path doesn't."""
    return episodes.where(F.contains(F.col(file_path), F.lit(word)))


def restructured(steps: DataFrame, episode: str, step: str, folder: str, file_path: str, space: str = "joint_position", exterior: Sequence[str] = ("exterior_image_1_left", "exterior_image_2_left"), instructions: Sequence[str] = ("language_instruction", "language_instruction_2", "language_instruction_3"), seed: int = 0) -> DataFrame:
    """episode, step, actions, observation (image, wrist_image, joint_position, gripper_position), prompt, step_id of steps.

    steps has action_dict and observation as structs. All steps of an episode show the same one of the exterior views and
    the same one of the instructions, by a hash of the episode. actions: the space's joints, then the gripper.
    """
    if space not in SPACES:
        raise ValueError(f"{space} is none of {', '.join(SPACES)}")
    view = chosen_once(F.col(episode), [F.col(f"observation.{v}") for v in exterior], seed)
    prompt = chosen_once(F.col(episode), [F.col(i) for i in instructions], seed + 1)
    seen = F.struct(view.alias("image"), F.col("observation.wrist_image_left").alias("wrist_image"), F.col("observation.joint_position").alias("joint_position"), F.col("observation.gripper_position").alias("gripper_position"))
    return steps.select(episode, step, F.concat(f"action_dict.{space}", "action_dict.gripper_position").alias("actions"), seen.alias("observation"), prompt.alias("prompt"), step_id(F.col(folder), F.col(file_path), F.col(step)).alias("step_id"))


def training_frames(steps: DataFrame, blocks: B.Strided, horizon: int, ranges: DataFrame | None = None, decode: bool = True, **names) -> DataFrame:
    """Steps of successful episodes as frames of horizon actions, of which those in ranges (episode, start, end) stay.

    Chunks are made before steps are left out, so they run over them; pictures are decoded last, for what is left.
    names: as restructured takes them.
    """
    e, s = blocks.episode, blocks.step
    made = restructured(successful(steps, names["file_path"]), e, s, **names)
    chunks = B.action_chunks(made, blocks, "actions", horizon).drop("actions").withColumnRenamed("chunk", "actions")
    kept = allow_frames(chunks, ranges, e, s)
    if not decode:
        return kept
    seen = F.col("observation")
    return kept.withColumn("observation", seen.withField("image", frames.decoded(seen["image"])).withField("wrist_image", frames.decoded(seen["wrist_image"])))


def sampled_trajectories(steps: DataFrame, pictures: DataFrame, episode: str, step: str, n: int | None = None, coefficient: float = 1.5, moving: str | None = None, draw=None) -> DataFrame:
    """Steps joined with their pictures, up to an episode's first step without any, and n of an episode's steps at most.

    moving: a boolean column; steps where it is false go (null counts as true), and so that n may be left, coefficient
    times as many are drawn first. Drawn steps come in order; the end is looked for among those alone. draw(seed): a random
    number for each row, by default a hash of episode and step.
    """
    draw = draw or (lambda seed: F.xxhash64(F.lit(seed), F.col(episode), F.col(step)))

    def least(df: DataFrame, many: int, seed: int) -> DataFrame:
        # Spark keeps many rows an episode in each task before it shuffles
        w = Window.partitionBy(episode).orderBy(draw(seed), step)
        return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= many).drop("_k")

    chosen = steps if n is None else least(steps, int(n * coefficient) if moving else n, 0)
    out = joined_until_missing(chosen, pictures, episode, step)
    if moving:
        out = out.where(F.coalesce(moving, F.lit(True)))
    return out if n is None else least(out, n, 1)


def cameras(views: Column, without: Sequence[str]) -> Column:
    """A map of views without those whose names hold one of the words."""
    return F.map_filter(views, lambda k, _: ~F.exists(F.array(*[F.lit(w) for w in without]), lambda w: F.contains(k, w)))
