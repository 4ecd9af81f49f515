"""Document fingerprints: a homomorphic hash of the multiset of a document's paragraphs (its lines).

Each paragraph is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors, lane by
lane, modulo powers of two. The order of paragraphs doesn't matter, and a paragraph is added to or taken from a
fingerprint without the rest of the document. The vector has two parts: EXACT lanes modulo 2**64 of a cryptographic
hash of the paragraph's bytes, which decide equality, and LIKE lanes modulo 2**16, in which each run of SHINGLE_WORDS
words of the paragraph adds 1 or -1 to one lane. Of those, products of two documents' lanes estimate how many runs they
share: likeness is 2 a.b / (a.a + b.b), cut to 0..1, with a standard error near 1 / sqrt(LIKE).

Defined results: a null text counts as the empty one, which is one empty paragraph; equal texts have equal
fingerprints and likeness 1; texts without words are unlike all but those of equal fingerprints; a lane wraps beyond
32,767 repeats of one run, which only blurs likeness; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ordered_parts, partitions, small_batches
from .words import chunks, shingles

EXACT, LIKE = 8, 128
SHINGLE_WORDS = 5
#: Bytes of text that are fingerprinted at once, a longer one by itself.
BATCH_BYTES = 1 << 22


class Fingerprints:
    """Fingerprints of some texts: exact uint64 [n, EXACT] and like int16 [n, LIKE]."""

    def __init__(self, exact: np.ndarray, like: np.ndarray):
        self.exact, self.like = exact, like

    def __add__(self, other: Fingerprints) -> Fingerprints:
        """Of the documents with the other's paragraphs added."""
        return Fingerprints(self.exact + other.exact, self.like + other.like)

    def __sub__(self, other: Fingerprints) -> Fingerprints:
        """Of the documents with the other's paragraphs taken out."""
        return Fingerprints(self.exact - other.exact, self.like - other.like)

    def strings(self) -> list[str]:
        return [a.tobytes().hex() + b.tobytes().hex() for a, b in zip(self.exact.astype("<u8"), self.like.astype("<i2"), strict=True)]

    @classmethod
    def parse(cls, strings: Sequence[str]) -> Fingerprints:
        raw = np.frombuffer(b"".join(map(bytes.fromhex, strings)), np.uint8).reshape(len(strings), EXACT * 8 + LIKE * 2)
        return cls(raw[:, : EXACT * 8].copy().view("<u8"), raw[:, EXACT * 8 :].copy().view("<i2"))

    def likeness(self, other: Fingerprints) -> np.ndarray:
        a, b = self.like.astype(np.float64), other.like.astype(np.float64)
        same = (self.exact == other.exact).all(1)
        norm = (a * a).sum(1) + (b * b).sum(1)
        return np.where(same, 1.0, np.clip(2 * (a * b).sum(1) / np.maximum(norm, 1), 0, 1))


def fingerprints(texts: Sequence[str | None]) -> Fingerprints:
    exact = np.zeros((len(texts), EXACT), np.uint64)
    like = np.zeros((len(texts), LIKE), np.int16)
    for c in chunks(texts, lower=False):
        ends = np.flatnonzero(c.data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        first = np.searchsorted(starts, c.doc_start)
        raw = c.data.tobytes()
        digest = b"".join(hashlib.blake2b(raw[a:b], digest_size=8 * EXACT).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
        exact[c.lo : c.hi] = np.add.reduceat(np.frombuffer(digest, "<u8").reshape(-1, EXACT), first, axis=0)
        h, paragraph = shingles(c.word, np.searchsorted(ends, c.start), len(ends), SHINGLE_WORDS)
        doc = np.searchsorted(first, paragraph, side="right") - 1
        at = doc * LIKE + (h % np.uint64(LIKE)).astype(np.int64)
        sign = ((h >> np.uint64(32)) & np.uint64(1)).astype(np.float64) * 2 - 1
        n = c.hi - c.lo
        like[c.lo : c.hi] = np.bincount(at, sign, n * LIKE).reshape(n, LIKE).astype(np.int64).astype(np.int16)
    return Fingerprints(exact, like)


def add_fingerprints(docs: DataFrame) -> DataFrame:
    """docs with a column fingerprint of text, which replaces one of that name."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def made(text: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(text.tolist()).strings(), dtype=object)

    return docs.withColumn("fingerprint", made("text"))


def with_next(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, int]:
    """Partitions of docs (doc_id, text) in descending order of doc_id, each followed by a copy of the next one's first row.

    Columns: doc_id, text, part, role (0: a row of its own, 1: such a copy); after the last partition comes the first.
    The driver gets the first doc_id of each range (and its text's checksum) and nothing else; texts are shuffled once.
    """
    part, n, cut_up = ordered_parts(docs, buckets or partitions(docs.sparkSession), ascending=False)
    # texts are read for the first rows alone where one doc_id fills ranges; elsewhere rows of one doc_id are few
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")) if cut_up else F.lit(None).cast("long")
    # the greatest id has the least complement, which every id has
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), F.bitwise_not(F.col("doc_id").cast("long")).alias("turned"), crc.alias("crc")))
    heads = {r.part: (None if r.first.void else ~r.first.turned, r.first.crc) for r in docs.select(part.alias("part"), "doc_id", "text").groupBy("part").agg(first.alias("first")).collect()}
    filled = sorted(heads)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}
    table = lambda v, kind: F.array(*[F.lit(v.get(p)).cast(kind) for p in range(n)])
    head, check, prior = table({p: h for p, (h, _) in heads.items()}, "long"), table({p: c for p, (_, c) in heads.items()}, "long"), table({p: before.get(p, 0) for p in range(n)}, "int")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), part.cast("int").alias("part"))
    copied = F.col("doc_id").eqNullSafe(F.get(head, F.col("part"))) & (F.get(check, F.col("part")).isNull() | (F.get(check, F.col("part")) == F.crc32(F.col("text").cast("binary"))))
    places = F.array_compact(F.array(F.struct(F.col("part"), F.lit(0).alias("role")), F.when(copied, F.struct(F.get(prior, F.col("part")).alias("part"), F.lit(1).alias("role")))))
    rows = own.withColumn("at", F.explode(places)).select("doc_id", "text", F.col("at.part").alias("part"), F.col("at.role").alias("role"))
    return rows.repartitionById(n, F.col("part")).sortWithinPartitions("role", F.col("doc_id").desc_nulls_last(), F.crc32(F.col("text").cast("binary"))), n


def compare_edited(docs: DataFrame) -> DataFrame:
    """Of each document: its fingerprint, that of its edited text, and how like both and the next document's are.

    The edited text is the document's with the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document in descending order of doc_id; the first one follows the last.
    """
    small_batches(docs.sparkSession)
    rows, _ = with_next(docs)
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("null_id"), "text", "role")

    def made(held: list[tuple], after: str) -> pd.DataFrame:
        texts = [t for _, _, t in held]
        following = [*texts[1:], after]
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
        own = fingerprints([*texts, after])
        new = fingerprints(edited)
        this, nxt = Fingerprints(own.exact[:-1], own.like[:-1]), Fingerprints(own.exact[1:], own.like[1:])
        return pd.DataFrame(
            {
                "doc_id": [d for d, _, _ in held],
                "null_id": [n for _, n, _ in held],
                "n_chars": [len(t) for t in texts],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                "fingerprint": this.strings(),
                "edited_fingerprint": new.strings(),
                "near_edited": this.likeness(new),
                "near_next": this.likeness(nxt),
            }
        )

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for pdf in frames:
            for row in zip(pdf["doc_id"].tolist(), pdf["null_id"].tolist(), pdf["text"].tolist(), pdf["role"].tolist(), strict=True):
                if row[3] == 1:  # the copies come last; the first of them follows the last row
                    if held:
                        yield made(held, row[2])
                        held = []
                    continue
                if size > BATCH_BYTES:
                    yield made(held, row[2])
                    held, size = [], 0
                held.append(row[:3])
                size += 2 * len(row[2])
        assert not held

    out = rows.mapInPandas(walked, "doc_id long, null_id boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.when(~F.col("null_id"), F.col("doc_id"))).drop("null_id")


def op7_paragraph_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(documents(spark, sf_dir).select("doc_id", "text"))
