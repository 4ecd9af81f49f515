"""What a model sees, as columns: from a record, to a record, and made ready for training or inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import images
from .pipelines import FLOW_VIEWS

#: Columns of an observation beside images, image_masks and state, each of which may be missing.
OPTIONAL = ("tokenized_prompt", "tokenized_prompt_mask", "token_ar_mask", "token_loss_mask")
SIZE = (224, 224)


def from_record(df: DataFrame) -> DataFrame:
    """image, image_mask, state and tokens as an observation: images as floats in [-1, 1].

    Tokens and their mask come together or not at all. Columns of neither an observation nor actions are dropped.
    """
    if gone := {"image", "image_mask", "state"} - set(df.columns):
        raise ValueError(f"missing: {sorted(gone)}")
    if ("tokenized_prompt" in df.columns) != ("tokenized_prompt_mask" in df.columns):
        raise ValueError("tokenized_prompt and tokenized_prompt_mask come together")
    whole = "array<float>" not in df.schema["image"].dataType.simpleString()
    views = images.floats_map(F.col("image")) if whole else F.col("image")
    rest = [c for c in (*OPTIONAL, "actions") if c in df.columns]
    return df.select(views.alias("images"), F.col("image_mask").alias("image_masks"), "state", *rest)


def to_record(df: DataFrame) -> DataFrame:
    """The inverse, with None for what an observation may lack; images stay floats."""
    kinds = {"tokenized_prompt": "array<int>", "tokenized_prompt_mask": "array<boolean>", "token_ar_mask": "array<int>", "token_loss_mask": "array<boolean>"}
    rest = [F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    return df.select(F.col("images").alias("image"), F.col("image_masks").alias("image_mask"), "state", *rest, *[c for c in ("actions",) if c in df.columns])


def _has(views: Column, names: Sequence[str]) -> Column:
    return F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(F.map_keys(views), n))


def ready(df: DataFrame, key: str | None = None, train: bool = False, views: Sequence[str] = FLOW_VIEWS, size: tuple[int, int] = SIZE, seed: int = 0) -> DataFrame:
    """A record (images as bytes) with the wanted views alone, each in size, and a mask for each; for training also augmented.

    A row without one of the views fails. Masks that are missing are true. Augmenting draws from key and seed; views whose
    names hold "wrist" are neither cropped nor turned.
    """
    if train and key is None:
        raise ValueError("training draws from a key")
    shown = F.when(_has(F.col("image"), views), F.col("image")).otherwise(F.raise_error(F.lit(f"images lack one of {', '.join(views)}")).cast(df.schema["image"].dataType))
    own = F.map_filter(images.resized_map(shown, *size), lambda k, _: k.isin(*views))
    out = df.withColumn("image", own)
    if train:
        made = {v: images.augmented(F.col("image")[v], F.concat_ws(":", F.lit(v), F.col(key).cast("string")), "wrist" in v, seed) for v in views}
        out = out.withColumn("image", F.create_map(*[x for k, v in made.items() for x in (F.lit(k), v)]))
    masks = F.create_map(*[x for v in views for x in (F.lit(v), F.coalesce(F.col("image_mask")[v], F.lit(True)) if "image_mask" in df.columns else F.lit(True))])
    return out.withColumn("image_mask", masks)
