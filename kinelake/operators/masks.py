"""Attention over texts whose tokens are rows: what each sees, as a range, however long the text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(df: DataFrame, keys: Sequence[str], place: str, valid: Column, breaks: Column) -> DataFrame:
    """df with block, end and seen: a token sees the valid ones at places below end, which are seen in number.

    breaks: 1 where a block begins, else 0; a token sees its own block and those before it, and one that isn't valid
    sees none. Three windows over one exchange by keys; nothing grows faster than the tokens.
    """
    in_order = Window.partitionBy(*keys).orderBy(place)
    rows = df.withColumn("block", F.sum(breaks).over(in_order)).withColumn("_so_far", F.sum(valid.cast("int")).over(in_order))
    own = Window.partitionBy(*keys, "block")
    out = rows.withColumn("end", F.max(place).over(own) + 1).withColumn("seen", F.when(valid, F.max("_so_far").over(own)).otherwise(0).cast("int"))
    return out.drop("_so_far")
