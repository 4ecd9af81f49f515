"""Best-fit packing of documents into sequences of several permitted lengths.

Best fit needs only the number of pieces of each length, of which there are no more than the longest sequence has
tokens, whatever the corpus holds. The pieces are counted by Spark; the plan is made on those counts, many equal bins at
a time; pieces of one length are numbered by Spark, and each looks up its place in the plan.

The plan takes lengths from the longest on. A piece goes to the open bin that it leaves least room in. Where none has
room, bins are opened in the permitted size of the least cost for each token, judged by what the lengths still left could
fill it with. When all pieces are placed each bin shrinks to the least permitted size that holds its contents. A
sequence of c tokens costs c + OVERHEAD.

Defined results: a null text or one without words is one token, its end; a text longer than the longest sequence is cut
into pieces of that length and a rest; equal rows get places of their own; null ids are numbered first; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored

CAPACITIES, OVERHEAD = (256, 512, 1024, 2048, 4096), 32
#: Parts, by hash, in which the pieces of one length are numbered.
_PARTS = 64


def token_count(text: Column) -> Column:
    """Words between ASCII white space, and an end."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long")


@dataclass
class Plan:
    """Segments: pieces first_rank.. of a length go to bins first_bin.., at offset in each. Bins from start on have capacity."""

    length: np.ndarray
    first_rank: np.ndarray
    first_bin: np.ndarray
    offset: np.ndarray
    start: np.ndarray
    capacity: np.ndarray
    n_bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bin, offset, capacity) of pieces by length and rank."""
        at = np.searchsorted(self.length * (1 << 44) + self.first_rank, length * (1 << 44) + rank, side="right") - 1
        b = self.first_bin[at] + rank - self.first_rank[at]
        return b, self.offset[at], self.capacity[np.searchsorted(self.start, b, side="right") - 1]


class _Left:
    """Pieces still to be placed, by length; the longest of at most some length."""

    def __init__(self, counts: np.ndarray):
        self.count = counts.tolist()
        self.below = list(range(len(counts)))

    def at_most(self, n: int) -> int:
        path = []
        while n and not self.count[n]:
            path.append(n)
            n = self.below[n] if self.below[n] < n else n - 1
        for p in path:
            self.below[p] = n
        return n


def _fill(left: _Left, length: int, capacity: int) -> tuple[int, int]:
    """What a bin of capacity that begins with a piece of length would hold, longest first, and how many such bins there are."""
    used, room, n = {length: 1}, capacity - length, min(length, capacity - length)
    while room and n:
        n = left.at_most(min(n, room))
        if not n:
            break
        take = min(room // n, left.count[n] - used.get(n, 0))
        if take > 0:
            used[n] = used.get(n, 0) + take
            room -= take * n
        n -= 1
    return capacity - room, max(1, min(left.count[k] // u for k, u in used.items()))


def plan(counts: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> Plan:
    """counts: the pieces of each length, from 0 to the greatest capacity."""
    sizes = sorted(capacities)
    left = _Left(np.asarray(counts))
    # open bins by room: ranges (first bin, number, capacity); rooms in ascending order
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    segments: list[tuple[int, int, int, int]] = []
    n_bins = 0

    def put(room: int, entry: tuple[int, int, int]) -> None:
        if room not in ranges:
            bisect.insort(rooms, room)
            ranges[room] = []
        ranges[room].append(entry)

    rank: dict[int, int] = {}
    while length := left.at_most(len(left.count) - 1):
        i = bisect.bisect_left(rooms, length)
        if i == len(rooms):
            costs = []
            for c in (c for c in sizes if c >= length):
                filled, many = _fill(left, length, c)
                shrunk = sizes[bisect.bisect_left(sizes, filled)]
                costs.append(((shrunk + overhead) / filled, c, many))
            _, c, many = min(costs)
            put(c, (n_bins, many, c))
            n_bins += many
            continue
        room = rooms[i]
        first, n, capacity = ranges[room].pop()
        take = min(n, left.count[length])
        if take < n:
            ranges[room].append((first + take, n - take, capacity))
        elif not ranges[room]:
            del ranges[room]
            rooms.pop(i)
        at = rank.get(length, 0)
        segments.append((length, at, first, capacity - room))
        rank[length] = at + take
        left.count[length] -= take
        put(room - length, (first, take, capacity))
    ends = sorted((first, sizes[bisect.bisect_left(sizes, capacity - room)]) for room, r in ranges.items() for first, _, capacity in r)
    seg = np.array(sorted(segments), np.int64).reshape(-1, 4)
    last = np.array(ends, np.int64).reshape(-1, 2)
    return Plan(*seg.T, *last.T, n_bins)


def pack(docs: DataFrame, length: Column, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, piece, start (in the document), length, bin, bin_offset, capacity of each piece of docs.

    length: the tokens of a row, over 0. The driver gets a count for each length up to the greatest capacity.
    """
    spark = docs.sparkSession
    most = max(capacities)
    cut = docs.select("doc_id", length.cast("long").alias("n")).withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / most).cast("int"))))
    start = F.col("piece").cast("long") * most
    pieces = cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(most)).cast("int").alias("length"))
    pieces = stored(pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(_PARTS)).cast("int")), "pieces")
    sums = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    counts = np.zeros(most + 1, np.int64)
    for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        counts[r.length] = r.n
    held = spark.sparkContext.broadcast(plan(counts, capacities, overhead))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_part").orderBy(F.col("doc_id").asc_nulls_first(), "piece"))
    ranked = pieces.withColumn("_row", own).join(starts, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)

    @F.pandas_udf("struct<bin:long,bin_offset:int,capacity:int>")
    def placed(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        b, offset, capacity = held.value.place(n.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"bin": b, "bin_offset": offset.astype(np.int32), "capacity": capacity.astype(np.int32)})

    return ranked.withColumn("_at", placed("length", "_rank")).select("doc_id", "piece", "start", "length", "_at.bin", "_at.bin_offset", "_at.capacity")


def op5_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), token_count(F.col("text")))
