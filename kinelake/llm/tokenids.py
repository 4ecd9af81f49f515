"""Token ids in binary files: every id in the fewest bits that the vocabulary needs, in blocks with an offset table.

A file holds the ids of a contiguous range of documents, in ascending order of id. Its layout, all little endian::

    magic (8 bytes)
    blocks: BLOCK_IDS ids each (the last one fewer), bits per id, the first id in the lowest bits, padded to bytes
    block_offset  uint64[n_blocks]      where each block starts in the file
    doc_id        int64[n_docs]         0 where it is null
    doc_null      uint8[n_docs]
    doc_start     uint64[n_docs + 1]    ids in the file before each document
    footer: bits, block_ids uint32; n_ids, n_blocks, n_docs, index_at uint64; magic

An id range is read by its blocks alone and unpacked by numpy without a step for each id. Files are written under a
temporary name and moved to their own, so a task that is run again, or twice at once, leaves one whole file.

Defined results: a null text counts as the empty one, which has the end id alone; rows with a null doc_id come first;
rows of one doc_id are ordered by their texts' checksums (rows equal in both, however many, are in one task), and equal
rows keep a row each; an empty table gives no file
and no rows; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ordered_parts, partitions, scratch_dir, small_batches
from .words import byte_chunks

BLOCK_IDS = 1 << 16
MAGIC = b"PKIDS001"
_FOOTER = struct.Struct("<IIQQQQ8s")
#: Documents that a task reads back at once.
READ_DOCS = 4096
#: A worker remembers the ids of at most so many pieces of text, each of at most so many bytes.
CACHE_PIECES, PIECE_BYTES = 1 << 20, 48

#: Bytes that are, or begin, a character which is surely no white space: ASCII ones and those of two bytes from U+00C0 on.
_BEGINS = np.zeros(256, bool)
_BEGINS[0x21:0x7F] = _BEGINS[0xC3:0xE0] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[0x21:0x7F] = ~_LETTER[0x21:0x7F]
_MARK[ord("'")] = False
_LINE, _SPACE = 10, 32
#: Slots for parts of up to _SHORT bytes, and ids that are kept for them.
SLOT_BITS, STORED_IDS, _SHORT = 20, 1 << 22, 15
#: The first n bytes of eight, and factors that mix them.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def width(vocabulary: int) -> int:
    """Bits that the ids 0 to vocabulary - 1 need."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids one after the other, the first in the lowest bits."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """count ids from the first-th on, of what pack() made."""
    raw = np.frombuffer(data + bytes(8), np.uint8)
    at = (np.arange(count, dtype=np.int64) + first) * bits
    byte, out = at >> 3, np.zeros(count, np.uint64)
    for k in range((bits + 7) // 8 + (bits % 8 != 0)):
        out |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


class IdWriter:
    """Appends documents to one file."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.pending: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.offsets: list[int] = []
        self.doc_id: list[int] = []
        self.null: list[int] = []
        self.start = [0]
        out.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        self.doc_id.append(0 if doc_id is None else int(doc_id))
        self.null.append(doc_id is None)
        self.n_ids += len(ids)
        self.start.append(self.n_ids)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        lo = 0
        while len(ids) - lo >= self.block_ids or last and lo < len(ids):
            block = pack(ids[lo : lo + self.block_ids], self.bits)
            self.offsets.append(self.at)
            self.out.write(block)
            self.at += len(block)
            lo += self.block_ids
        rest = ids[lo:]
        self.pending, self.held = [rest] if len(rest) else [], len(rest)

    def close(self) -> int:
        """Writes the index and returns the file's size."""
        self._blocks(True)
        index = b"".join(np.array(v, t).tobytes() for v, t in ((self.offsets, "<u8"), (self.doc_id, "<i8"), (self.null, "u1"), (self.start, "<u8")))
        self.out.write(index)
        self.out.write(_FOOTER.pack(self.bits, self.block_ids, self.n_ids, len(self.offsets), len(self.doc_id), self.at, MAGIC))
        return self.at + len(index) + _FOOTER.size


class IdReader:
    """Random access to one file, given as a seekable stream."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size() if callable(getattr(stream, "size", None)) else stream.seek(0, os.SEEK_END)
        self.bits, self.block_ids, self.n_ids, n_blocks, self.n_docs, at, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        self.index_at = at
        self.doc_id_at = at + 8 * n_blocks
        self.null_at = self.doc_id_at + 8 * self.n_docs
        self.start_at = self.null_at + self.n_docs

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def _index(self, at: int, kind: str, lo: int, hi: int) -> np.ndarray:
        """Entries lo to hi of one table of the index; the rest of it isn't read."""
        size = np.dtype(kind).itemsize
        return np.frombuffer(self._read(at + lo * size, (hi - lo) * size), kind)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids start to stop of the file; only their blocks are read."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        # after the last block comes the index, whose first entry is not an offset
        begins = np.append(self._index(self.index_at, "<u8", first, last + 1), self.index_at).astype(np.int64)
        if (last + 1) * self.block_ids < self.n_ids:
            begins[-1] = self._index(self.index_at, "<u8", last + 1, last + 2)[0]
        data, out = self._read(int(begins[0]), int(begins[-1] - begins[0])), []
        for b in range(first, last + 1):
            i, j = max(start, b * self.block_ids), min(stop, (b + 1) * self.block_ids)
            lo, hi = (int(x - begins[0]) for x in begins[b - first : b - first + 2])
            out.append(unpack(data[lo:hi], self.bits, i - b * self.block_ids, j - i))
        return np.concatenate(out)

    def documents(self, lo: int, hi: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the file before it, its ids) of the documents lo to hi."""
        at = self._index(self.start_at, "<u8", lo, hi + 1).astype(np.int64)
        doc_id, null = self._index(self.doc_id_at, "<i8", lo, hi), self._index(self.null_at, "u1", lo, hi)
        ids = self.ids(int(at[0]), int(at[-1]))
        for k in range(hi - lo):
            yield None if null[k] else int(doc_id[k]), int(at[k]), ids[at[k] - at[0] : at[k + 1] - at[0]]


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Texts are cut where byte-level BPE always begins a new piece: at a single space between two characters that aren't white
    space, between a letter and an ASCII digit or mark other than the apostrophe, and on either side of a single line break between others. So
    the parts have the ids that they have in the whole (a text with a special token's name stays whole). The library is asked once for each part, mostly a word, and what it
    says is remembered under the part's own bytes; long parts are asked for each time. Parts of up to 15 bytes, which are nearly all, are
    looked up many at once: a hash finds a part's slot, and the bytes and the length that are kept there decide.
    """

    def __init__(self, path: str, most: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[bytes, bytes] = {}
        # a slot for a part of few bytes: the part itself and its length as two numbers, and where its ids are in the store
        self.key, self.length_key = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.uint64)
        self.first, self.count = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
        self.store, self.stored = np.zeros(1 << 16, "<u4"), 0
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a line break between a part's end and a space, or what is no white space, is a piece by itself, so parts without one can be asked for together
        line = self.tokenizer.encode("a\n b", add_special_tokens=False).ids
        self.line = line[1] if len(line) == 3 else None

    def _asked(self, parts: list[bytes]) -> list[bytes]:
        text = {p: p.decode() for p in parts}
        plain = [p for p in parts if self.line is not None and b"\n" not in p and (p[:1] == b" " or not text[p][0].isspace()) and not text[p][-1].isspace() and not any(x in text[p] for x in self.special)]
        rest = sorted(set(parts).difference(plain))
        groups = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        got = self.tokenizer.encode_batch_fast(["\n".join(map(text.get, g)) for g in groups] + list(map(text.get, rest)), add_special_tokens=False)
        found: dict[bytes, bytes] = {}
        for g, e in zip(groups, got):
            ids = np.array(e.ids, "<u4")
            cut, raw = 4 * np.flatnonzero(ids == self.line), ids.tobytes()
            for p, a, b in zip(g, [0, *(cut + 4).tolist()], [*cut.tolist(), len(raw)], strict=True):
                found[p] = raw[a:b]
        found |= {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(rest, got[len(groups) :], strict=True)}
        return [found[p] for p in parts]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """For each text its ids, as unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        for lo, hi in byte_chunks(texts):
            out += self._encoded([t.encode() for t in texts[lo:hi]])
        return out

    def _encoded(self, raw: list[bytes]) -> list[np.ndarray]:
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        begins = np.zeros(len(data) + 1, bool)
        cut = np.flatnonzero((data[1:-1] == _SPACE) | _MARK[data[1:-1]] | (data[1:-1] == _LINE)) + 1
        this, before, wide = data[cut], data[cut - 1], data[np.maximum(cut - 2, 0)]
        solid = np.where(before < 0x80, _BEGINS[before], (wide >= 0xC3) & (wide < 0xE0))
        letter = np.where(before < 0x80, _LETTER[before], (wide >= 0xC3) & (wide < 0xC9) & (before != 0x97) & (before != 0xB7))
        begins[cut[np.where(this == _SPACE, solid & _BEGINS[data[cut + 1]], np.where(this == _LINE, solid, letter))]] = True
        after = cut[(this == _LINE) & solid] + 1
        begins[after[_BEGINS[data[after]]]] = True
        for i in [i for i, r in enumerate(raw) if any(x.encode() in r for x in self.special)]:
            begins[ends[i] - len(raw[i]) : ends[i]] = False
        begins[ends - [len(r) for r in raw]] = True
        begin = np.flatnonzero(begins[:-1])
        first, count = self._looked_up(joined, begin)
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.store[np.repeat(first - total[:-1], count) + np.arange(total[-1])]
        if self.stored > STORED_IDS:
            self.stored, self.length_key[:] = 0, 0
        edge = total[np.searchsorted(begin, np.concatenate([[0], ends]))]
        return [ids[a:b] for a, b in zip(edge.tolist(), edge[1:].tolist())]

    def _looked_up(self, joined: bytes, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the store the ids of the parts that begin there are, and how many."""
        size = np.diff(begin, append=len(joined))
        eight = np.ndarray(len(joined) + 8, "<u8", joined + bytes(16), strides=(1,))  # the eight bytes from each place on
        key = eight[begin] & _FIRST[np.minimum(size, 8)]
        length_key = eight[begin + 8] & _FIRST[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
        slot = ((key ^ length_key * _ODD[0]) * _ODD[1] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        short = size <= _SHORT
        first, count = self.first[slot], self.count[slot]
        miss = np.flatnonzero(~(short & (self.key[slot] == key) & (self.length_key[slot] == length_key)))
        if len(miss):
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(joined[a:b], len(number)) for a, b in zip(begin[miss].tolist(), (begin + size)[miss].tolist())])
            got = self._ids(list(number))
            lengths = np.fromiter(map(len, got), np.int64, len(got)) // 4
            ends = self.stored + np.cumsum(lengths)
            if ends[-1] > len(self.store):
                self.store = np.concatenate([self.store[: self.stored], np.zeros(2 * int(ends[-1]) - self.stored, "<u4")])
            self.store[self.stored : ends[-1]] = np.frombuffer(b"".join(got), "<u4")
            self.stored = int(ends[-1])
            first[miss], count[miss] = (ends - lengths)[which], lengths[which]
            put = miss[short[miss]]
            for table, own in ((self.key, key), (self.length_key, length_key), (self.first, first), (self.count, count)):
                table[slot[put]] = own[put]
        return first, count

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts."""
        got = list(map(self.known.get, parts))
        missing = [p for p, g in zip(parts, got, strict=True) if g is None]
        if missing:
            new = dict(zip(missing, self._asked(missing), strict=True))
            got = [new[p] if g is None else g for p, g in zip(parts, got, strict=True)]
            if len(self.known) + len(new) > self.most:
                self.known.clear()
            self.known.update((p, ids) for p, ids in new.items() if len(p) <= PIECE_BYTES)
        return got


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary: what it remembers serves the worker's later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system, name


def _replace(system, held: str, name: str) -> None:
    """Moves held to name; what another attempt of the task left there goes."""
    try:
        system.move(held, name)
    except OSError:
        system.delete_file(name)
        system.move(held, name)


@dataclass
class TokenFiles:
    """What write_ids() wrote: (path, documents, ids, bytes) of each file, in order."""

    files: list[tuple[str, int, int, int]]

    @property
    def n_ids(self) -> int:
        return sum(f[2] for f in self.files)


def write_ids(docs: DataFrame, tokenizer: str, out_dir: str, end_id: int = 0, buckets: int | None = None) -> TokenFiles:
    """Encodes docs (doc_id, text) and writes a file for each range of doc_id, in ascending order.

    A doc_id (or the null one) that alone fills a range is cut further by its texts' checksums. The driver gets one row
    for each file. out_dir is a URI that all executors reach.
    """
    spark = docs.sparkSession
    small_batches(spark)
    part, n, _ = ordered_parts(docs, buckets or partitions(spark))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), part.alias("bucket"))
    rows = rows.repartitionById(n, F.col("bucket")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32(F.col("text").cast("binary")))
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("null_id"), "text", "bucket")
    end = np.array([end_id], "<u4")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer)
        bits = width(max(own.tokenizer.get_vocab_size(), end_id + 1))
        writer = None
        for pdf in frames:
            texts = pdf["text"].tolist()
            ids, nulls = pdf["doc_id"].tolist(), pdf["null_id"].tolist()
            for lo, hi in byte_chunks(texts):
                if writer is None:
                    bucket = int(pdf["bucket"].iloc[0])
                    system, name = _open(f"{out_dir}/ids-{bucket:06d}.bin")
                    system.create_dir(os.path.dirname(name), recursive=True)
                    raw = system.open_output_stream(held := f"{name}.{uuid.uuid4().hex}.tmp")
                    writer = IdWriter(raw, bits)
                for doc_id, null_id, own_ids in zip(ids[lo:hi], nulls[lo:hi], own.encode(texts[lo:hi]), strict=True):
                    writer.add(None if null_id else doc_id, np.append(own_ids, end))
        if writer is not None:
            size = writer.close()
            raw.close()
            _replace(system, held, name)
            yield pd.DataFrame({"bucket": [bucket], "n_docs": [len(writer.doc_id)], "n_ids": [writer.n_ids], "bytes": [size]})

    made = rows.mapInPandas(write, "bucket int, n_docs long, n_ids long, bytes long").collect()
    return TokenFiles([(f"{out_dir}/ids-{r.bucket:06d}.bin", r.n_docs, r.n_ids, r.bytes) for r in sorted(made)])


def read_ids(spark: SparkSession, written: TokenFiles, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document, from the files.

    With with_ids also the ids themselves. The driver sends a row for each file; a task reads READ_DOCS documents by their
    own blocks and index entries.
    """
    files, start = [], 0
    for path, n_docs, n_ids, _ in written.files:
        files.append((path, start, n_docs))
        start += n_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    todo = spark.createDataFrame(files, "path string, start long, n_docs long").select("path", "start", "n_docs", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(READ_DOCS))).alias("lo"))
    todo = todo.select("path", "start", "lo", F.least(F.col("lo") + READ_DOCS, "n_docs").alias("hi")).repartition(4 * partitions(spark))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, start, lo, hi in pdf.itertuples(index=False):
                system, name = _open(path)
                with system.open_input_file(name) as stream:
                    out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                    for doc_id, before, ids in IdReader(stream).documents(lo, hi):
                        out["doc_id"].append(doc_id)
                        out["start"].append(start + before)
                        out["n_tokens"].append(len(ids))
                        out["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                        if with_ids:
                            out["ids"].append(ids.astype(np.int64))
                yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    return todo.mapInPandas(read, schema)


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    written = write_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), scratch_dir(spark, "ids"))
    return read_ids(spark, written)
