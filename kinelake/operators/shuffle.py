"""Shuffles by arithmetic: a row's new place is a keyed permutation of its number, so nothing is sorted or kept.

The permutation is a Feistel network over pairs (l, r) of a number l * b + r, 0 <= l < a, 0 <= r < b, a b hardly over n: each
round adds a keyed hash of one half to the other, which is undone by subtracting it, so no two numbers meet. What lands at or
beyond n goes through again until it is below; that ends, as a permutation's cycle leads back to where it began.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import with_row_index

_PRIME = 2_147_483_647
ROUNDS, _WALKS, _TRIED = 6, 48, 512


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 to n - 1, decided by seed and epoch."""

    n: int
    seed: int = 0
    epoch: int = 0

    @property
    def sides(self) -> tuple[int, int]:
        """(a, b), of those tried between half the root of n and the root that with the least a b - n."""
        if self.n < 1:
            raise ValueError("there is nothing to permute")
        root = math.isqrt(self.n - 1) + 1
        return min(((a, -(-self.n // a)) for a in range(root - min(_TRIED, root // 2), root + 1)), key=lambda s: (s[0] * s[1] - self.n, s[1] - s[0]))

    @property
    def keys(self) -> list[tuple[int, int, int, int]]:
        """Of each round the two hashes' factors and summands."""
        draw = random.Random(f"{self.seed}:{self.epoch}")
        return [tuple(draw.randrange(1, _PRIME) for _ in range(4)) for _ in range(ROUNDS)]

    def _once(self, x: Column) -> Column:
        a, b = self.sides
        keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(k)]) for k in self.keys])
        start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

        def step(s: Column, k: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(s["r"] * k["k0"] + k["k1"], F.lit(_PRIME)), F.lit(a))
            # the second half needs the first one's new value: worked out once, as an array of one
            both = F.transform(F.array(left), lambda v: F.struct(v.cast("long").alias("l"), F.pmod(s["r"] + F.pmod(v * k["k2"] + k["k3"], F.lit(_PRIME)), F.lit(b)).cast("long").alias("r")))
            return F.get(both, F.lit(0))

        return F.aggregate(keys, start, step, lambda s: s["l"] * b + s["r"])

    def place(self, index: Column) -> Column:
        """The new place of row number index, 0 <= index < n."""
        a, b = self.sides
        x = self._once(index.cast("long"))
        walks = min(a * b - self.n, _WALKS)
        if not walks:
            return x
        x = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), x, lambda v, _: F.when(v >= self.n, self._once(v)).otherwise(v))
        # one in (a b / n - 1)**-_WALKS rows at most; never a wrong place
        return F.when(x < self.n, x).otherwise(F.raise_error(F.lit("the permutation's walk was too long; take another seed")).cast("long"))


def shuffled(df: DataFrame, index: str, n: int, seed: int = 0, epoch: int = 0, name: str = "place") -> DataFrame:
    """df (rows numbered 0 to n - 1 by index) with each row's place in the shuffled order."""
    return df.withColumn(name, Permutation(n, seed, epoch).place(F.col(index))) if n else df.withColumn(name, F.lit(None).cast("long"))


def buffered(df: DataFrame, index: str, n: int, size: int, seed: int = 0, epoch: int = 0, name: str = "place") -> DataFrame:
    """df with places of a shuffle that moves no row by size places or more, as one through a buffer of size rows does.

    Each stretch of size rows is permuted in itself, the last, shorter one too; stretches begin at another row each epoch.
    """
    if n <= size:
        return shuffled(df, index, n, seed, epoch, name)
    first = random.Random(f"{seed}:{epoch}:first").randrange(size)
    own = F.floor((F.col(index) + (size - first) % size) / size).cast("long")
    begin = F.greatest(own * size - (size - first) % size, F.lit(0))
    last = (n - 1 + (size - first) % size) // size
    head, tail = (first or size), n - max(last * size - (size - first) % size, 0)
    # every whole stretch adds an amount of its own to its rows' numbers, so that stretches differ
    turned = lambda m: F.pmod(F.col(index) - begin + F.pmod(own * 1_000_003 + seed + epoch, F.lit(m)), F.lit(m))
    at = lambda m: Permutation(m, seed, epoch).place(turned(m))
    return df.withColumn(name, begin + F.when(own == 0, at(head)).when(own == last, at(tail)).otherwise(at(size)))


def epochs(df: DataFrame, key: str, size: int, times: int, seed: int = 0, drop_last: bool = True) -> DataFrame:
    """df with epoch, place and batch (place // size) for times passes, each in an order of its own; drop_last leaves out what fills no batch.

    Rows are numbered once, by ranges of key; an epoch is arithmetic on the number. Fails where there are fewer rows than a batch takes.
    """
    n = df.count()
    if n < size:
        raise ValueError(f"a batch of {size} is more than the {n} rows there are")
    numbered = with_row_index(df, key, "_index")
    place = F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), Permutation(n, seed, e).place(F.col("_index")).alias("place")) for e in range(times)]))
    out = numbered.withColumn("_p", place).select(*df.columns, "_p.*").withColumn("batch", F.floor(F.col("place") / size).cast("long"))
    return out.where(F.col("place") < n // size * size) if drop_last else out
