"""Vectors and matrices as array columns: normalisation, action differences, padding, masks, alignment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps a scale from being zero.
EPSILON = 1e-6


def vector(values: Column | Sequence) -> Column:
    return values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def normalize_z(x: Column, mean: Column | Sequence, std: Column | Sequence) -> Column:
    """(x - mean) / (std + EPSILON) by dimension; statistics may be longer than x."""
    mean, std = vector(mean), vector(std)
    return F.transform(x, lambda v, i: (v - F.get(mean, i)) / (F.get(std, i) + EPSILON))


def normalize_q(x: Column, low: Column | Sequence, high: Column | Sequence) -> Column:
    """low and high map to -1 and 1; nothing is clipped."""
    low, high = vector(low), vector(high)
    return F.transform(x, lambda v, i: (v - F.get(low, i)) / (F.get(high, i) - F.get(low, i) + EPSILON) * 2 - 1)


def unnormalize_z(x: Column, mean: Column | Sequence, std: Column | Sequence) -> Column:
    """The inverse of normalize_z; dimensions beyond the statistics have mean 0 and deviation 1."""
    mean, std = vector(mean), vector(std)
    return F.transform(x, lambda v, i: v * (F.coalesce(F.get(std, i), F.lit(1.0)) + EPSILON) + F.coalesce(F.get(mean, i), F.lit(0.0)))


def unnormalize_q(x: Column, low: Column | Sequence, high: Column | Sequence) -> Column:
    """The inverse of normalize_q; dimensions beyond the statistics stay as they are."""
    low, high = vector(low), vector(high)
    back = lambda v, i: (v + 1) / 2 * (F.get(high, i) - F.get(low, i) + EPSILON) + F.get(low, i)
    return F.transform(x, lambda v, i: F.when(i < F.size(low), back(v, i)).otherwise(v))


def bool_mask(*dims: int) -> list[bool]:
    """n gives n times True, -n gives n times False."""
    return [n > 0 for n in dims for _ in range(abs(n))]


def _shifted(actions: Column, state: Column, mask: Sequence[bool] | None, sign: int) -> Column:
    if mask is None:
        return actions
    own = F.array(*[F.lit(bool(m)) for m in mask])
    base = lambda i: F.when(F.coalesce(F.get(own, i), F.lit(False)), F.get(state, i)).otherwise(0.0)
    return F.transform(actions, lambda a: F.transform(a, lambda v, i: v + sign * base(i)))


def delta_actions(actions: Column, state: Column, mask: Sequence[bool] | None) -> Column:
    """Actions of a chunk relative to the state, in the masked dimensions; without a mask as they are."""
    return _shifted(actions, state, mask, -1)


def absolute_actions(actions: Column, state: Column, mask: Sequence[bool] | None) -> Column:
    """The inverse of delta_actions."""
    return _shifted(actions, state, mask, 1)


def pad_to(x: Column, size: int, value: Column) -> Column:
    """x with value on its right up to size; a longer x stays whole."""
    return F.concat(x, F.array_repeat(value, F.greatest(F.lit(0), size - F.size(x))))


def fit_to(x: Column, size: int, value: Column) -> Column:
    """x padded or cut to size."""
    return F.slice(pad_to(x, size, value), 1, size)


def valid_mask(x: Column, size: int) -> Column:
    """Which of size places x fills."""
    return let(F.size(x), lambda n: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i < n))


def every(x: Column, stride: int) -> Column:
    """Every stride-th element from the first on."""
    return F.filter(x, lambda _, i: i % stride == 0)


def first_dims(actions: Column, size: int) -> Column:
    """A chunk's actions with their first size dimensions alone."""
    return F.transform(actions, lambda a: F.slice(a, 1, size))


def align_right(x: Column, length: Column) -> Column:
    """The first length elements moved to the end, what follows them to the front."""
    n = F.greatest(F.size(x) - length, F.lit(0))
    head = F.when(n > 0, F.slice(x, length + 1, n)).otherwise(F.slice(x, 1, 0))
    return F.concat(head, F.slice(x, F.lit(1), length))


def put_at(x: Column, index: Column, value: Column) -> Column:
    """x with value at a place counted from 0."""
    return F.transform(x, lambda v, i: F.when(i == index, value).otherwise(v))


def prefix_sums(x: Column) -> Column:
    """Running totals of an array of numbers, in time that grows with its length."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: np.cumsum(np.asarray(v, np.float64)), na_action="ignore")

    return run(x)


def visible_ends(breaks: Column) -> Column:
    """For each place one past the last place of its block: it sees the valid places before that. breaks: over 0 where a block begins.

    All that an attention mask says, in one number a place (see also operators.masks, for texts in rows).
    """

    def ends(v) -> np.ndarray:
        starts = np.flatnonzero(np.asarray(v) > 0)
        return np.append(starts, len(v))[np.searchsorted(starts, np.arange(len(v)), side="right")].astype(np.int32)

    @F.pandas_udf("array<int>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(ends, na_action="ignore")

    return run(breaks)


def attention_mask(valid: Column, breaks: Column) -> Column:
    """Which place may see which, written out place by place: both valid, and the seen one's block not after its own."""
    row = lambda s, i: F.transform(s["valid"], lambda v, j: (j < F.get(s["end"], i)) & F.get(s["valid"], i) & v)
    return let(F.struct(visible_ends(breaks).alias("end"), valid.alias("valid")), lambda s: F.transform(s["end"], lambda _, i: row(s, i)))


def softmax(x: Column) -> Column:
    e = let(F.struct(x.alias("x"), F.array_max(x).alias("top")), lambda s: F.transform(s["x"], lambda v: F.exp(v - s["top"])))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    return let(F.struct(e.alias("e")), lambda s: let(F.struct(s["e"].alias("e"), total(s["e"]).alias("total")), lambda t: F.transform(t["e"], lambda v: v / t["total"])))


def log_softmax(x: Column) -> Column:
    log_total = lambda s: F.log(F.aggregate(s["x"], F.lit(0.0), lambda a, v: a + F.exp(v - s["top"]))) + s["top"]
    with_top = let(F.struct(x.alias("x"), F.array_max(x).alias("top")), lambda s: F.struct(s["x"].alias("x"), log_total(s).alias("log")))
    return let(with_top, lambda s: F.transform(s["x"], lambda v: v - s["log"]))


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("int"))


def arg_max(x: Column) -> Column:
    """The first place, from 0, of the greatest element."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def masked_mean(values: Column, mask: Column) -> Column:
    """The mean of the values where the mask is true; 0 where it is nowhere true."""
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    return total / F.greatest(F.size(F.filter(mask, lambda m: m)), F.lit(1))


def mean_square(a: Column, b: Column) -> Column:
    """Mean of the squared differences of two vectors."""
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def mean_absolute(a: Column, b: Column) -> Column:
    """Mean of the absolute differences of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def gated_residual(x: Column, y: Column, gate: Column | None) -> Column:
    """x + y * gate; without a gate x + y, and without y x."""
    scaled = F.zip_with(y, gate, lambda v, g: v * F.coalesce(g, F.lit(1.0))) if gate is not None else y
    return F.when(y.isNull(), x).otherwise(F.zip_with(x, scaled, lambda v, w: v + w))


def interpolate(noise: Column, target: Column, t: Column) -> Column:
    """t noise + (1 - t) target."""
    return F.zip_with(noise, target, lambda n, a: t * n + (1 - t) * a)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def model_masks(image_masks: Column, patches: int, text_mask: Column, horizon: int, state_token: bool) -> Column:
    """A struct of valid and ar over a model's whole input: patches of each image, the prompt, then a state token and the actions.

    Images and prompt see each other; the state token and the actions each begin a block of their own.
    """
    images = F.flatten(F.transform(image_masks, lambda m: F.array_repeat(m, patches)))
    own = (1 if state_token else 0) + horizon
    breaks = [1] * (2 if state_token else 1) + [0] * (horizon - 1)
    ar = F.concat(F.array_repeat(F.lit(0), F.size(images) + F.size(text_mask)), F.array(*[F.lit(b) for b in breaks]))
    return F.struct(F.concat(images, text_mask, F.array_repeat(F.lit(True), own)).alias("valid"), ar.alias("ar"))
