"""Sum-of-squares packing: each document goes, as it comes, where it leaves the levels of open windows most even.

A window holds at most SIZE tokens; its level is how many it holds. Of the partially filled windows only their number at
each level is tracked, in one array. A document of s tokens goes to the level h, of those that have a window (or to a new
window), for which the sum of the squared numbers of all levels becomes least; of equal ones to the fullest. A full window
counts at no level. Documents over SIZE are cut from the front into full windows and a rest.

Spark deals the rows: every input partition is packed by itself while its texts are encoded, without a shuffle. What is
left open at a partition's end are windows of a level, and these go, each as one piece, through the same rule once more with
those of the other partitions of its group of GROUP partitions. Windows that even then stay open are laid end to end and cut
at SIZE, so that one window of a group, the last, is padded. A task holds the ids of its open windows alone (at most SIZE - 1
of them, by far fewer in practice); a group's task gets a row for each open window, at most GROUP * (SIZE - 1).

Defined results: a null text is empty, and an empty one is its end id alone; rows are packed in the order in which they
are read, so equal rows get places of their own and another partitioning gives another packing; a null doc_id is kept; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches, stored
from .words import byte_chunks

SIZE, END_ID, GROUP = 4096, 2, 64
#: A worker remembers the ids of at most so many parts of words, each of at most so many bytes.
CACHE_PARTS, PART_BYTES = 1 << 20, 48
#: Room for the windows of one partition, and of one group, in sequence_id.
_WINDOWS = 1 << 36
#: A word, or its leading letters where a digit or a mark other than the apostrophe follows: the tokenizer begins a new piece there.
_PARTS = re.compile(rb"[A-Za-z]++(?=[\x21-\x26\x28-\x40\x5b-\x60\x7b-\x7e]|\s|\Z)|\S+")


class Levels:
    """The level array, and which windows stand at each level."""

    def __init__(self, size: int = SIZE):
        self.size = size
        # twice the number of windows at each level; at 0 and at size such that a new or a full window costs nothing
        self.twice = np.zeros(size + 1, np.int64)
        self.twice[0], self.twice[size] = 1, -1
        self.at: dict[int, list[int]] = {}
        self.windows = 0

    def place(self, s: int) -> tuple[int, int]:
        """(window, offset) for s tokens, 1 to size of them."""
        here, there = self.twice[: self.size + 1 - s], self.twice[s:]
        change = np.where(here > 0, there - here, np.iinfo(np.int64).max)
        h = len(change) - 1 - int(np.argmin(change[::-1]))
        if h:
            window = self.at[h].pop()
            self.twice[h] -= 2
        else:
            window = self.windows
            self.windows += 1
        if h + s < self.size:
            self.twice[h + s] += 2
            self.at.setdefault(h + s, []).append(window)
        return window, h

    def open(self) -> list[tuple[int, int]]:
        """(window, level) of the partially filled ones, in order of window."""
        return sorted((w, h) for h, ws in self.at.items() for w in ws)


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space; words and parts of them are asked for once each.

    ASCII white space parts pieces of such a tokenizer, and so does the place between an ASCII letter and an ASCII digit or
    mark other than the apostrophe. A word that holds a special token's name stays whole.
    """

    def __init__(self, path: str, most: int = CACHE_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}

    def _parts(self, raw: bytes) -> list[bytes]:
        return raw.split() if any(s in raw for s in self.special) else _PARTS.findall(raw)

    def encode(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """For each text its ids, as unsigned 32-bit integers."""
        for lo, hi in byte_chunks(texts):
            each = [self._parts(t.encode("utf-8", "replace")) for t in texts[lo:hi]]
            missing = list({p for parts in each for p in parts}.difference(self.known))
            if len(self.known) + len(missing) > self.most:
                self.known.clear()
                missing = list({p for parts in each for p in parts})
            asked = self.tokenizer.encode_batch_fast([p.decode() for p in missing], add_special_tokens=False)
            new = {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(missing, asked, strict=True)}
            known = {**self.known, **new} if len(new) > self.most else self.known
            known.update(new)
            for parts in each:
                yield np.frombuffer(b"".join([known[p] for p in parts]), "<u4")
            for p in new:
                if len(p) > PART_BYTES:
                    known.pop(p, None)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard int, window long, offset long, level long, ids binary"
_PIECE_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [("shard", pa.int32())] + [(n, pa.int64()) for n in ("window", "offset", "level")] + [("ids", pa.binary())])


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def placed_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The pieces of docs (doc_id, text), packed partition by partition: shard is the partition, window counts in it.

    Pieces in windows that stay open have the window's level and their ids; those in full ones have null there.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, levels, shard = encoder(tokenizer), Levels(size), TaskContext.get().partitionId()
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            out: list[tuple] = []
            ids_of = own.encode(batch.column("text").to_pylist())
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
                ids = np.append(body, end)
                for start in range(0, len(ids), size):
                    part = ids[start : start + size]
                    window, offset = levels.place(len(part))
                    held.setdefault(window, []).append((doc_id, start, len(part), _crc(part), len(ids), shard, window, offset, None, part.tobytes()))
                    if offset + len(part) == size:
                        out += [(*piece[:-1], None) for piece in held.pop(window)]
            yield _batch(out)
        for window, level in levels.open():
            yield _batch([(*piece[:-2], level, piece[-1]) for piece in held[window]])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in _PIECE_ARROW]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE_ARROW, strict=True)], schema=_PIECE_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(place, _PIECE)


def joined_windows(opened: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """shard, window, group, at: where each open window (shard, window, level) begins in its group's row of windows of size.

    Windows go through the sum-of-squares rule as if they were documents; those that then stay open follow end to end.
    """

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        rows, levels = rows.sort_values(["shard", "window"]), Levels(size)
        to = np.array([levels.place(int(s)) for s in rows["level"]], np.int64).reshape(-1, 2)
        still = dict(levels.open())
        begin = np.full(levels.windows + 1, -1, np.int64)
        full = [w for w in range(levels.windows) if w not in still]
        begin[full] = np.arange(len(full)) * size
        end = len(full) * size
        for w, level in still.items():
            begin[w] = end
            end += level
        return rows[["shard", "window", "group"]].assign(at=begin[to[:, 0]] + to[:, 1])

    each = opened.select("shard", "window", "level").distinct().withColumn("group", F.floor(F.col("shard") / group).cast("int"))
    return each.groupBy("group").applyInPandas(again, "shard int, window long, group int, at long")


def pack_levels(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs (doc_id, text)."""
    pieces = stored(placed_pieces(docs, tokenizer, size, end_id), "pieces")
    opened = pieces.where("level IS NOT NULL")
    # even ids: windows that their own partition filled; odd ones: those of a group
    full = pieces.where("level IS NULL").withColumn("sequence_id", F.col("shard").cast("long") * 2 * _WINDOWS + F.col("window"))
    at = F.col("at") + F.col("offset")
    first = F.least(F.lit(size) - at % size, F.col("length"))  # tokens up to the next cut
    sides = F.array(F.struct(F.lit(0).cast("long").alias("skip"), first.alias("n")), F.struct(first.alias("skip"), (F.col("length") - first).alias("n")))
    moved = opened.join(joined_windows(opened, size, group), ["shard", "window"]).withColumn("_at", at).withColumn("_side", F.explode(sides)).where("_side.n > 0")
    place = F.col("_at") + F.col("_side.skip")
    ids = F.substring("ids", (F.col("_side.skip") * 4 + 1).cast("int"), (F.col("_side.n") * 4).cast("int"))
    moved = moved.select(
        "doc_id", (F.col("start") + F.col("_side.skip")).alias("start"), F.col("_side.n").alias("length"), F.crc32(ids).alias("ids_crc32"), "doc_tokens",
        ((F.col("group").cast("long") * 2 + 1) * _WINDOWS + F.floor(place / size)).alias("sequence_id"), (place % size).alias("offset"),
    )
    return full.select(*moved.columns).unionByName(moved)


def op13_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_levels(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
