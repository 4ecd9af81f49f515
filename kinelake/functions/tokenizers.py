"""SentencePiece in Arrow-batched UDFs; the model's path is a parameter and every executor must reach it."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import fit_to, valid_mask
from .encodings import token_to_action
from .text import action_part, action_prefix, clean_prompt, sequence_masks


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_ids(text: Column, path: str, begin: bool = False, end: bool = False) -> Column:
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        ids = _model(path).encode(texts[known].tolist(), add_bos=begin, add_eos=end, num_threads=1) if known.any() else []
        out[known] = pd.Series(ids, index=texts.index[known], dtype=object)
        return out

    return run(text)


def piece_text(ids: Column, path: str) -> Column:
    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _model(path).decode([int(i) for i in x]) for x in col], dtype=object)

    return run(ids)


def prompt_tokens(prompt: Column, path: str, size: int) -> Column:
    """A struct of tokens and mask: the prompt's ids with a beginning, then a line end's, padded with 0 or cut to size."""
    ids = F.concat(piece_ids(clean_prompt(prompt), path, begin=True), piece_ids(F.lit("\n"), path))
    return F.struct(fit_to(ids, size, F.lit(0)).alias("tokens"), valid_mask(ids, size).alias("mask"))


def action_sequence(prompt: Column, state: Column, actions: Column, path: str, vocabulary: int, size: int) -> Column:
    """A struct of tokens, mask, ar and loss for a token model; actions: codes, or null where they are to be predicted."""
    prefix = piece_ids(action_prefix(prompt, state), path, begin=True)
    own = F.concat(piece_ids(F.lit("Action: "), path), F.transform(actions, lambda t: token_to_action(t, vocabulary)), piece_ids(F.lit("|"), path, end=True))
    suffix = F.coalesce(own, F.array().cast("array<int>"))
    masks = sequence_masks(prefix, suffix)
    both = F.concat(prefix, suffix)
    return F.struct(
        fit_to(both, size, F.lit(0)).alias("tokens"), valid_mask(both, size).alias("mask"), fit_to(masks["ar"], size, F.lit(0)).alias("ar"), fit_to(masks["loss"], size, F.lit(False)).alias("loss")
    )


def action_codes(decoded: Column, path: str, vocabulary: int) -> Column:
    """The action codes in a decoded text; none where it holds no actions."""
    ids = piece_ids(F.coalesce(action_part(decoded), F.lit("")), path)
    return F.when(action_part(decoded).isNull(), F.array().cast("array<int>")).otherwise(F.transform(ids, lambda t: token_to_action(t, vocabulary)))


def codes_to_chunk(codes: Column, horizon: int, dims: int, bins: int = 256) -> Column:
    """A chunk of horizon actions of dims dimensions; zeros where there are too few codes."""
    row = lambda h: F.transform(F.slice(codes, h * dims + 1, dims), lambda t: t / bins * 2 - 1)
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), dims), horizon)
    return F.when(F.size(codes) < horizon * dims, zeros).otherwise(F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), row))
