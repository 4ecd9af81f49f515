"""Positions, codes and schedules as plain column arithmetic."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def digitize(x: Column, bins: int = 256) -> Column:
    """The bin, 0 to bins - 1, of x among equal ones over [-1, 1): -1 below, the last one above and for NaN.

    The edges are compared, not only computed, so a value next to an edge falls on its own side.
    """
    half = bins / 2
    guess = F.least(F.greatest(F.floor((x + 1) * half), F.lit(-1)), F.lit(bins - 1))
    edge = lambda i: i / half - 1
    exact = F.when((guess >= 0) & (edge(guess) > x), guess - 1).when((guess < bins - 1) & (edge(guess + 1) <= x), guess + 1).otherwise(guess)
    return F.when(F.isnan(x), bins - 1).otherwise(exact).cast("int")


def undigitize(token: Column, bins: int = 256) -> Column:
    """The lower edge of a bin."""
    return token / bins * 2 - 1


# Bins by dimension for a codebook of 2**k codes.
CODEBOOK_BINS = {
    8: (8, 6, 5),
    10: (8, 5, 5, 5),
    12: (7, 5, 5, 5, 5),
    14: (8, 8, 8, 6, 5),
    16: (8, 8, 8, 5, 5, 5),
}


def codebook_bins(kind: str, size: int) -> tuple[int, ...]:
    """Bins by dimension. fsq: the table's; square: two dimensions of the same; signs: two bins in each of log2(size) dimensions."""
    power = size.bit_length() - 1
    if size < 2 or size != 1 << power:
        raise ValueError(f"{size} is not a power of two")
    if kind == "signs":
        return (2,) * power
    if kind not in ("fsq", "square") or power not in CODEBOOK_BINS:
        raise ValueError(f"no {kind} codebook of {size}")
    return CODEBOOK_BINS[power] if kind == "fsq" else (1 << power // 2,) * 2


def codebook_index(z: Column, bins: Sequence[int]) -> Column:
    """A vector in [-1, 1] quantised to bins levels by dimension, as one mixed-radix number; ties go to the even level."""
    place, total = 1, F.lit(0)
    for i, b in enumerate(bins):
        total = total + F.rint((F.get(z, F.lit(i)) + 1) * (b - 1) / 2).cast("int") * place
        place *= b
    return total


def codebook_levels(index: Column, bins: Sequence[int]) -> Column:
    """The vector that a number stands for."""
    place, out = 1, []
    for b in bins:
        digit = F.floor(index / place) % b
        out.append(digit / ((b - 1) / 2) - 1)
        place *= b
    return F.array(*out)


def bits_index(z: Column) -> Column:
    """Signs of a vector as a number: the i-th bit is set where the i-th element is over 0."""
    return F.aggregate(F.transform(z, lambda v, i: F.when(v > 0, F.pow(F.lit(2.0), i)).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v).cast("long")


def bits_vector(index: Column, size: int) -> Column:
    """The inverse of bits_index, with -1 and 1."""
    return F.array(*[F.when(F.floor(index / 2**i) % 2 == 1, 1).otherwise(-1) for i in range(size)])


def token_to_action(token: Column, vocabulary: int, skipped: int = 128) -> Column:
    """Action codes are a vocabulary's last tokens but skipped, in reverse; the function is its own inverse."""
    return vocabulary - 1 - skipped - token


def sincos(position: Column, dims: int, shortest: float, longest: float) -> Column:
    """Sines, then cosines, of a position at dims / 2 periods from shortest to longest, evenly spaced in the logarithm."""
    if dims % 2:
        raise ValueError("dims must be even")
    half = dims // 2
    rates = [2 * math.pi / (shortest * (longest / shortest) ** (i / max(half - 1, 1))) for i in range(half)]
    return F.array(*[F.sin(position * r) for r in rates], *[F.cos(position * r) for r in rates])


def sincos_grid(x: Column, y: Column, dims: int, base: float = 10_000.0) -> Column:
    """Sines and cosines of x, then of y, each at dims / 4 rates from 1 down to 1 / base."""
    if dims % 4:
        raise ValueError("dims must be a multiple of four")
    n = dims // 4
    rates = [base ** (-i / max(n - 1, 1)) for i in range(n)]
    return F.array(*[wave(place * r) for place in (x, y) for wave in (F.sin, F.cos) for r in rates])


def rotary(x: Column, position: Column, dims: int, base: float = 10_000.0) -> Column:
    """The two halves of x rotated by position / base**(2 i / dims)."""
    half = dims // 2
    angle = [position * (base ** (-2 * i / dims)) for i in range(half)]
    a, b = [F.get(x, F.lit(i)) for i in range(half)], [F.get(x, F.lit(i + half)) for i in range(half)]
    return F.array(*[p * F.cos(t) - q * F.sin(t) for p, q, t in zip(a, b, angle, strict=True)], *[q * F.cos(t) + p * F.sin(t) for p, q, t in zip(a, b, angle, strict=True)])


def log_spaced(position: Column, dims: int, base: float = 1e4) -> Column:
    """Sine and cosine in turn at rates exp(-2 i ln(base) / dims)."""
    out = []
    for i in range(dims // 2):
        r = math.exp(-2 * i * math.log(base) / dims)
        out += [F.sin(position * r), F.cos(position * r)]
    return F.array(*out)


def block_mask(query: Column, key: Column, query_block: int, key_block: int) -> Column:
    """Whether a query place sees a key place, by blocks; each place is divided by the other side's block size."""
    return F.floor(query / key_block) >= F.floor(key / query_block)


def warmup_cosine(step: Column, warmup: int, peak: float, decay: int, end: float) -> Column:
    """From peak / (warmup + 1) linearly up to peak, then by a half cosine down to end at step decay."""
    first = peak / (warmup + 1)
    along = F.least(F.lit(1.0), (step - warmup) / max(1, decay - warmup))
    return F.when(step < warmup, first + (peak - first) * step / warmup if warmup else F.lit(peak)).otherwise(end + (peak - end) * 0.5 * (1 + F.cos(math.pi * along)))


def warmup_rsqrt(step: Column, warmup: int, peak: float, timescale: float) -> Column:
    """From peak / (warmup + 1) linearly up to peak, then peak / sqrt((timescale + step - warmup) / timescale)."""
    first = peak / (warmup + 1)
    return F.when(step < warmup, first + (peak - first) * step / warmup if warmup else F.lit(peak)).otherwise(peak / F.sqrt((timescale + step - warmup) / timescale))


def adapter_scale(alpha: float, rank: int, stabilised: bool = False) -> float:
    """What a low-rank update is multiplied by."""
    return alpha / math.sqrt(rank) if stabilised else alpha / rank


def euler_steps(x: Column, velocity: Callable[[Column, Column], Column], steps: int = 10) -> Column:
    """x carried from time 1 to 0 by velocity(x, t) in equal steps."""
    dt = -1.0 / steps
    move = lambda v, k: F.zip_with(v, velocity(v, 1.0 + k * dt), lambda a, b: a + dt * b)
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), x, move)
