"""Random numbers that depend on a seed, a stream and a row's own key alone: the same on any partitioning and any retry.

A number is a hash of its counter (key and place), so nothing is carried from row to row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A rational approximation of the normal distribution's inverse (relative error below 1.2e-9): numerator and
#: denominator of the middle part, then of the tails, highest power first; and where the tails begin.
_MIDDLE_OVER = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_MIDDLE_UNDER = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL_OVER = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_UNDER = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL = 0.02425


def uniform_at(seed: int, stream: str, *counter: Column) -> Column:
    """A number in (0, 1), a multiple of 2**-53 and half of it, by 64-bit hashes."""
    h = F.xxhash64(F.lit(seed), F.lit(stream), *counter)
    return F.shiftrightunsigned(h, 11).cast("double") * 2.0**-53 + 2.0**-54


def uniform_by_digest(seed: int, stream: str, *counter: Column) -> Column:
    """uniform_at by MD5 of the counter's text, 48 bits: slower, and the same in any engine."""
    text = F.concat_ws(":", F.lit(f"{seed}:{stream}"), *[c.cast("string") for c in counter])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48


def _polynomial(x: Column, powers: tuple[float, ...]) -> Column:
    out = F.lit(powers[0])
    for p in powers[1:]:
        out = out * x + p
    return out


def normal_of(u: Column) -> Column:
    """The standard normal value below which a share of u lies, 0 < u < 1."""

    def value(p: Column) -> Column:
        tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
        far = _polynomial(tail, _TAIL_OVER) / _polynomial(tail, _TAIL_UNDER)
        middle = lambda q: F.get(F.transform(F.array(q * q), lambda r: q * _polynomial(r, _MIDDLE_OVER) / _polynomial(r, _MIDDLE_UNDER)), F.lit(0))
        return F.when(p < _TAIL, far).when(p > 1 - _TAIL, -far).otherwise(middle(p - 0.5))

    return F.get(F.transform(F.array(u), value), F.lit(0))  # u is worked out once


def normal_vector(size: int, seed: int, stream: str, *key: Column, uniform=uniform_at) -> Column:
    """size independent standard normal numbers of a row."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: normal_of(uniform(seed, stream, *key, i)))


def noise_like(actions: Column, seed: int, *key: Column, uniform=uniform_at) -> Column:
    """Standard normal numbers in the shape of an action chunk [steps][dims]; ragged rows keep their lengths."""
    return F.transform(actions, lambda a, i: F.transform(a, lambda _, j: normal_of(uniform(seed, "noise", *key, i, j))))


def flow_time(seed: int, *key: Column, uniform=uniform_at) -> Column:
    """A random time in (0.001, 1): Beta(1.5, 1) by its inverse, moved off 0."""
    return F.pow(uniform(seed, "time", *key), F.lit(1 / 1.5)) * 0.999 + 0.001
