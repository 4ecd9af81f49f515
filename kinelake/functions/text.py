"""Prompts, file names and token sequences as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import fit_to, valid_mask
from .encodings import digitize

#: What Python's strip() takes off, for Java's patterns.
WHITE = r"[\s\x0b\x1c-\x1f\x85\xa0  -     　]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def clean_prompt(text: Column) -> Column:
    """Without outer white space; underscores and line ends are spaces."""
    return F.translate(strip(text), "_\n", "  ")


def lower_prompt(text: Column) -> Column:
    """In lower case without outer white space; underscores are spaces, line ends stay."""
    return F.translate(strip(F.lower(text)), "_", " ")


def state_text(state: Column, closed: bool = True) -> Column:
    """A normalised state's bins, with spaces between; those beyond [-1, 1) are -1 and 255, or go on in equal steps if not closed."""
    own = (lambda v: digitize(v)) if closed else (lambda v: F.floor((v + 1) * 128).cast("int"))
    return F.array_join(F.transform(state, lambda v: own(v.cast("double")).cast("string")), " ")


# The prompt formats that models are trained on.
ACTION_PROMPT, ACTION_PREFIX = "Task: %s, State: %s;\nAction: ", "Task: %s, State: %s;\n"


def action_prompt(prompt: Column, state: Column, closed: bool = True) -> Column:
    return F.format_string(ACTION_PROMPT, clean_prompt(prompt), state_text(state, closed))


def action_prefix(prompt: Column, state: Column) -> Column:
    return F.format_string(ACTION_PREFIX, lower_prompt(prompt), state_text(state))


def padded_tokens(tokens: Column, size: int, pad: Column) -> Column:
    """A struct of tokens and mask, both of size."""
    return F.struct(fit_to(tokens, size, pad).alias("tokens"), valid_mask(tokens, size).alias("mask"))


def sequence_masks(prefix: Column, suffix: Column) -> Column:
    """A struct of ar (0 over the prefix, 1 over the suffix) and loss (the suffix alone)."""
    ar = F.concat(F.array_repeat(F.lit(0), F.size(prefix)), F.array_repeat(F.lit(1), F.size(suffix)))
    return F.struct(ar.alias("ar"), F.transform(ar, lambda v: v == 1).alias("loss"))


def action_part(decoded: Column) -> Column:
    """What a decoded text holds between "Action: " and the next bar; null where it holds no actions."""
    after = F.substring_index(decoded, "Action: ", -1)
    return F.when(F.contains(decoded, F.lit("Action: ")), strip(F.split(after, r"\|")[0]))


def last_part(file_name: Column) -> Column:
    """A file's name up to its first dot, and of that what follows the last underscore."""
    return F.substring_index(F.substring_index(file_name, ".", 1), "_", -1)


def from_bytes(raw: Column) -> Column:
    """UTF-8 bytes as text."""
    return F.decode(raw, "UTF-8")


def slug(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("_"))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy_MM_dd_HH:mm:ss")


def step_id(*parts: Column) -> Column:
    return F.concat_ws("--", *[p.cast("string") for p in parts])
