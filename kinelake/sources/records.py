"""Framed record files of feature maps: framing, CRC-32C and the wire format, by whole batches in numpy.

A file is a row of records: length (uint64), masked CRC-32C of those eight bytes, the bytes, their masked CRC-32C, all
little endian. A record is a protocol buffer message: field 1 holds the features, a map (field 1: key, field 2: value) of
names to lists, which are of bytes (field 1), 32-bit floats (field 2) or 64-bit integers (field 3), each list's values being
its own field 1, packed or not.

A file is read from any byte on: the next record begins where eight bytes and the four after them agree, and so do the bytes
that they count; a chance of agreeing by accident is one in 2^64. A record that held a whole record file longer than a split
could still mislead a reader that begins inside it; split by more than the longest record then.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

BYTES, FLOATS, INTS = 1, 2, 3
#: The generator of CRC-32C, lowest bit first, and what is added to a turned checksum.
_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8
_LANE = 64
_HEAD, _TAIL = 12, 4


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> 1) ^ np.where(t & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
    return t


_TABLE = _crc_table()


def _moved(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """c after as many zero bytes as the tables stand for."""
    return tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]


def _zero_tables(powers: int = 40) -> list[np.ndarray]:
    """Tables of 2**k zero bytes, for each byte of a checksum."""
    one = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    out = [_TABLE[one & 255] ^ (one >> 8)]
    for _ in range(powers - 1):
        out.append(_moved(out[-1], out[-1]))
    return out


_ZEROS = _zero_tables()


def crc32c(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32C of the spans data[start : start + size].

    Spans are laid into lanes of _LANE bytes, with zeros in front, where they change nothing; all lanes advance together,
    and neighbours are then joined two by two.
    """
    lanes = -(-size // _LANE)
    begin = np.cumsum(lanes) - lanes
    flat = np.zeros(int(lanes.sum()) * _LANE, np.uint8)
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat((begin + lanes) * _LANE - size, size) + offset] = data[np.repeat(start, size) + offset]
    rows, c = flat.reshape(-1, _LANE), np.zeros(len(flat) // _LANE, np.uint32)
    for k in range(_LANE):
        c = _TABLE[(c ^ rows[:, k]) & 255] ^ (c >> 8)
    level = _LANE.bit_length() - 1
    while len(lanes) and lanes.max() > 1:
        pairs = -(-lanes // 2)
        slots = np.zeros(int(pairs.sum()) * 2, np.uint32)
        inner = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        slots[np.repeat(np.cumsum(pairs) * 2 - lanes, lanes) + inner] = c
        c, lanes, level = _moved(_ZEROS[level], slots[0::2]) ^ slots[1::2], pairs, level + 1
    whole = np.zeros(len(size), np.uint32)
    whole[lanes > 0] = c
    first = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for k in range(int(size.max()).bit_length() if len(size) else 0):
        on = size >> k & 1 == 1
        first[on] = _moved(_ZEROS[k], first[on])
    return whole ^ first ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> 15 | crc << 17) + np.uint32(_MASK)


def frame(bodies: Sequence[bytes]) -> bytes:
    """bodies as records."""
    heads = [struct.pack("<Q", len(b)) for b in bodies]
    parts = [x for pair in zip(heads, bodies, strict=True) for x in pair]
    size = np.array([len(p) for p in parts], np.int64)
    crc = masked(crc32c(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size)).astype("<u4")
    return b"".join(p + crc[i].tobytes() for i, p in enumerate(parts))


def heads(data: np.ndarray) -> np.ndarray:
    """Offsets at which a record's length and its checksum agree, in ascending order."""
    n = len(data) - _HEAD + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    c = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(8):
        c = _TABLE[(c ^ data[k : k + n]) & 255] ^ (c >> 8)
    said = sum(data[8 + k : 8 + k + n].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
    return np.flatnonzero(masked(c ^ np.uint32(0xFFFFFFFF)) == said)


class Corrupt(ValueError):
    pass


@dataclass
class _Window:
    """Bytes of a file, read on as they are asked for."""

    stream: object
    size: int
    slab: int
    at: int = 0
    data: bytes = b""

    def have(self, lo: int, hi: int) -> bool:
        """Whether the file has bytes lo to hi; if so, they're in data."""
        if hi > self.size:
            return False
        if lo < self.at or hi > self.at + len(self.data):
            self.stream.seek(lo)
            self.at, self.data = lo, self.stream.read(max(hi - lo, min(self.slab, self.size - lo)))
        return True

    def get(self, lo: int, hi: int) -> bytes:
        return self.data[lo - self.at : hi - self.at]


def _check(data: bytes) -> int:
    one = np.zeros(1, np.int64)
    return int(masked(crc32c(np.frombuffer(data, np.uint8), one, one + len(data)))[0])


def _whole(w: _Window, at: int) -> bool:
    """Whether a record that agrees with both its checksums begins at byte at."""
    if not w.have(at, at + _HEAD):
        return False
    head = w.get(at, at + _HEAD)
    (n,) = struct.unpack_from("<Q", head)
    if _check(head[:8]) != int.from_bytes(head[8:], "little") or not w.have(at, at + _HEAD + n + _TAIL):
        return False
    body = w.get(at + _HEAD, at + _HEAD + n + _TAIL)
    return _check(body[:n]) == int.from_bytes(body[n:], "little")


def _next_record(w: _Window, lo: int) -> int:
    """Where the first whole record at or after byte lo begins; the file's size if there's none."""
    while lo + _HEAD <= w.size:
        hi = min(lo + w.slab, w.size)
        w.have(lo, hi)
        block = w.get(lo, hi)
        for h in heads(np.frombuffer(block, np.uint8)).tolist():
            if _whole(w, lo + h):
                return lo + h
        lo = hi - _HEAD + 1 if hi < w.size else w.size
    return w.size


def read_records(stream, size: int, lo: int, hi: int, skip_corrupt: bool = False, slab: int = 8 << 20) -> Iterator[list[bytes]]:
    """The bodies, by batches of about slab bytes, of the records of a seekable file that begin at bytes lo to hi.

    skip_corrupt leaves out records whose checksums disagree, and goes on at the next whole one; else Corrupt is raised.
    """
    w = _Window(stream, size, slab)
    at = _next_record(w, lo) if lo else 0
    bodies: list[bytes] = []
    crcs: list[bytes] = []
    held = 0

    def checked() -> list[bytes]:
        n = np.array([len(b) for b in bodies], np.int64)
        good = masked(crc32c(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(n) - n, n)) == np.frombuffer(b"".join(crcs), "<u4")
        if not good.all() and not skip_corrupt:
            raise Corrupt(f"{int((~good).sum())} records disagree with their checksums, before byte {at}")
        return [b for b, g in zip(bodies, good.tolist(), strict=True) if g]

    while at < min(hi, size):
        head = w.get(at, at + _HEAD) if w.have(at, at + _HEAD) else b""
        sound = len(head) == _HEAD and _check(head[:8]) == int.from_bytes(head[8:], "little")
        n = struct.unpack("<Q", head[:8])[0] if sound else 0
        if not sound or not w.have(at, at + _HEAD + n + _TAIL):
            if not skip_corrupt:
                raise Corrupt(f"no whole record at byte {at}")
            at = _next_record(w, at + 1)
            continue
        body = w.get(at + _HEAD, at + _HEAD + n + _TAIL)
        bodies.append(body[:n])
        crcs.append(body[n:])
        held += n
        at += _HEAD + n + _TAIL
        if held >= slab:
            yield checked()
            bodies, crcs, held = [], [], 0
    if bodies:
        yield checked()
    # the next split starts at the first whole record; were the one that follows here not whole, nobody would miss it
    if not skip_corrupt and at < size and not _whole(w, at):
        raise Corrupt(f"no whole record at byte {at}")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        if x < 128:
            return value, i
        shift += 7


def _fields(b: bytes, i: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(number, wire type, where the value begins, where it ends) of a message's fields."""
    while i < end:
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 2:
            n, i = _varint(b, i)
            stop = i + n
        elif kind == 0:
            _, stop = _varint(b, i)
        elif kind in (1, 5):
            stop = i + (8 if kind == 1 else 4)
        else:
            raise Corrupt(f"wire type {kind}")
        if stop > end:
            raise Corrupt("a field ends after its message")
        yield tag >> 3, kind, i, stop
        i = stop


def features(body: bytes) -> dict[str, tuple[int, int, int]]:
    """Of each feature its kind and where the list's message lies; of a name that comes twice the last."""
    out: dict[str, tuple[int, int, int]] = {}
    for number, _, i, end in _fields(body, 0, len(body)):
        if number != 1:
            continue
        for entry, _, j, stop in _fields(body, i, end):
            if entry != 1:
                continue
            name, value = "", None
            for k, _, a, z in _fields(body, j, stop):
                if k == 1:
                    name = body[a:z].decode()
                elif k == 2:
                    value = next(((kind, p, q) for kind, _, p, q in _fields(body, a, z) if kind in (BYTES, FLOATS, INTS)), None)
            if value:
                out[name] = value
    return out


def varints(data: np.ndarray) -> np.ndarray:
    """The varints that follow each other in data, as 64-bit integers."""
    ends = np.flatnonzero(data < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    begins = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(ends[-1] + 1) - np.repeat(begins, ends - begins + 1)
    bits = (data[: ends[-1] + 1] & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(bits, begins).view(np.int64)


def _packed(body: bytes, kind: int, i: int, end: int) -> bytes:
    """A list's values as they're packed."""
    return b"".join(body[a:z] for number, _, a, z in _fields(body, i, end) if number == 1)


def _column(bodies: Sequence[bytes], at: list[tuple[int, int, int] | None], kind: int, name: str) -> tuple[np.ndarray, pa.Array]:
    """(values of each record, -1 where the feature is missing; all values)."""
    if any(x and x[0] != kind for x in at):
        raise Corrupt(f"{name} is not of one kind")
    if kind == BYTES:
        lists = [[b[a:z] for number, _, a, z in _fields(b, x[1], x[2]) if number == 1] if x else None for b, x in zip(bodies, at, strict=True)]
        counts = np.array([-1 if v is None else len(v) for v in lists], np.int64)
        return counts, pa.array([v for own in lists if own for v in own], pa.binary())
    packed = [_packed(b, *x) if x else b"" for b, x in zip(bodies, at, strict=True)]
    data = np.frombuffer(b"".join(packed), np.uint8)
    size = np.array([len(p) for p in packed], np.int64)
    if kind == FLOATS:
        counts, values = size // 4, pa.array(data.view("<f4"))
    else:
        total = np.concatenate([[0], np.cumsum(data < 128)])
        ends = np.cumsum(size)
        counts, values = total[ends] - total[ends - size], pa.array(varints(data))
    return np.where([x is None for x in at], -1, counts), values


def kind_of(t: T.DataType) -> int:
    inner = t.elementType if isinstance(t, T.ArrayType) else t
    if isinstance(inner, (T.BinaryType, T.StringType)):
        return BYTES
    if isinstance(inner, (T.FloatType, T.DoubleType)):
        return FLOATS
    if isinstance(inner, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return INTS
    raise ValueError(f"no feature is a {t.simpleString()}")


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def decode(bodies: Sequence[bytes], schema: T.StructType) -> pa.RecordBatch:
    """The schema's columns of records; a missing feature is null. A column that is no array takes features of one value."""
    found = [features(b) for b in bodies]
    columns, fields = [], []
    for f in schema.fields:
        counts, values = _column(bodies, [x.get(f.name) for x in found], kind_of(f.dataType), f.name)
        fields.append(pa.field(f.name, _arrow(f.dataType)))
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(inner, T.BooleanType):
            values = pa.array(values.to_numpy(zero_copy_only=False) != 0)
        elif isinstance(inner, T.StringType):
            values = values.cast(pa.string())
        values = values.cast(_arrow(inner))
        missing = counts < 0
        if isinstance(f.dataType, T.ArrayType):
            offsets = np.concatenate([[0], np.cumsum(np.where(missing, 0, counts))]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), values, type=fields[-1].type, mask=pa.array(missing)))
        else:
            if (counts > 1).any():
                raise Corrupt(f"{f.name} has {int(counts.max())} values in a record, and its column takes one")
            place = np.where(counts == 1, np.cumsum(np.maximum(counts, 0)) - 1, 0)
            columns.append(values.take(pa.array(place, mask=counts != 1)))
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))


def probed(body: bytes) -> T.StructType:
    """The columns of one record: arrays of bytes, floats or long integers, by name."""
    kinds = {BYTES: T.BinaryType(), FLOATS: T.FloatType(), INTS: T.LongType()}
    return T.StructType([T.StructField(n, T.ArrayType(kinds[k])) for n, (k, _, _) in sorted(features(body).items())])


def _uint(v: int) -> bytes:
    v &= (1 << 64) - 1
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def _block(number: int, body: bytes) -> bytes:
    return _uint(number << 3 | 2) + _uint(len(body)) + body


def encode(row: Mapping[str, object], schema: T.StructType) -> bytes:
    """One row as a record's body; nulls are left out."""
    entries = []
    for f in schema.fields:
        v = row[f.name]
        if v is None:
            continue
        own, kind = v if isinstance(f.dataType, T.ArrayType) else [v], kind_of(f.dataType)
        if any(x is None for x in own):
            raise ValueError(f"{f.name} holds a null, for which there's no place in a record")
        if kind == BYTES:
            values = b"".join(_block(1, x.encode() if isinstance(x, str) else bytes(x)) for x in own)
        else:
            values = _block(1, np.asarray(own, "<f4").tobytes() if kind == FLOATS else b"".join(_uint(int(x)) for x in own)) if len(own) else b""
        entries.append(_block(1, _block(1, f.name.encode()) + _block(2, _block(kind, values))))
    return _block(1, b"".join(entries))
