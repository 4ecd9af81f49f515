"""AVI motion-JPEG columns: RIFF indexes, intra frames, and shots found by adaptive histogram differences.

``read_avi`` parses a file's headers and its frame index (idx1, OpenDML's ix##, or else the movi list itself).
``decode_dc`` and ``decode_pixels`` decode baseline JPEG frames of any sampling, tables and restart interval. All
restart intervals of a batch of frames are decoded in step, one symbol of each at a time, by numpy. ``shots`` compares
each frame's histogram of block means with the one before; a cut is where the difference is over a floor and well
over the differences of the frames before it.

``avi_of_bytes`` stores bytes without loss: 192 of them are the 16 x 12 flat blocks of a 128 x 96 grey frame. A flat
block of value s has the DC coefficient s - 128 at quantiser 8, and decodes to s exactly.

Defined results: a null or unreadable file has no frames, hence no clips; a null text counts as the empty one, which
makes one frame of spaces; equal texts make equal files; a frame that can't be decoded (cut short, or a coding other
than baseline) raises ValueError in the functions for one file and counts as a frame without a histogram in the
column functions; an empty table gives an empty one; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, small_batches

UNIT, BLOCKS_X, BLOCKS_Y = 192, 16, 12
FPS = 25
#: Frames that are encoded or decoded at once.
BATCH_FRAMES = 8192
#: Histogram bins; a cut's least difference; frames before it that it is compared with; deviations over their mean.
BINS, FLOOR, BEFORE, DEVIATIONS = 32, 0.15, 12, 3.0

# Fixed values of the JPEG standard: the zigzag order and the Huffman tables that frames without own tables use.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28]
    + [35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
STANDARD_DC = {0: "00010501010101010100000000000000", 1: "00030101010101010101010000000000"}
STANDARD_AC = {
    0: "0002010303020403050504040000017d"
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
    "838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    1: "00020102040403040705040400010277"
    "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
    "82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
}
#: Of our own frames: DC categories by code length (for differences of text), and an AC code that only ends blocks.
_DC_COUNTS, _DC_VALUES = (0, 1, 4, 2, 1, 1), (4, 2, 3, 5, 7, 0, 1, 6, 8)


_FULL = (1 << np.arange(32)) - 1
_HALF = np.where(_FULL > 0, (_FULL + 1) >> 1, 0)


def _codes(counts: bytes | tuple, values: bytes | tuple) -> list[tuple[int, int, int]]:
    """(value, code, length) of a canonical Huffman table."""
    out, code, k = [], 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out.append((values[k], code, n))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def _lookup(counts: bytes, values: bytes, ac: bool) -> np.ndarray:
    """By the next 16 bits: the code's length (0: none), the category after it, and the run of zeros, 5 bits each."""
    out = np.zeros(1 << 16, np.int64)
    for v, code, n in _codes(counts, values):
        out[code << (16 - n) : (code + 1) << (16 - n)] = n | (v & 15 if ac else v) << 5 | (v >> 4 if ac else 0) << 10
    return out


@dataclass(frozen=True)
class Layout:
    """What a frame's headers say; components: (blocks across and down in an MCU, quantiser, DC table, AC table)."""

    width: int
    height: int
    components: tuple
    restart: int

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(c[0] for c in self.components), max(c[1] for c in self.components)
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))


@lru_cache(maxsize=256)
def _layout(head: bytes) -> Layout:
    """From a frame's bytes up to its scan."""
    quant: dict[int, tuple] = {}
    tables: dict[tuple[int, int], tuple[bytes, bytes]] = {(0, k): (bytes.fromhex(v), bytes(range(12))) for k, v in STANDARD_DC.items()}
    tables |= {(1, k): (bytes.fromhex(v)[:16], bytes.fromhex(v)[16:]) for k, v in STANDARD_AC.items()}
    size, parts, restart, at = (0, 0), {}, 0, 2
    while at + 4 <= len(head):
        kind, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body, at = head[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            i = 0
            while i < len(body):
                wide, k = body[i] >> 4, body[i] & 15
                quant[k] = struct.unpack_from(">64H" if wide else ">64B", body, i + 1)
                i += 129 if wide else 65
        elif kind == 0xC4:
            i = 0
            while i < len(body):
                m = sum(body[i + 1 : i + 17])
                tables[body[i] >> 4, body[i] & 15] = body[i + 1 : i + 17], body[i + 17 : i + 17 + m]
                i += 17 + m
        elif kind in (0xC0, 0xC1):
            bits, h, w, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not h or not w:
                raise ValueError("only frames of 8-bit samples are read")
            size, parts = (h, w), {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if len(scan) != len(parts):
                raise ValueError("only frames of one scan are read")
            one = len(scan) == 1
            return Layout(size[1], size[0], tuple((1 if one else parts[c][0], 1 if one else parts[c][1], quant[parts[c][2]], tables[0, d], tables[1, a]) for c, d, a in scan), restart)
    raise ValueError("a frame without a scan")


def _head(frame: bytes) -> int:
    """Where the frame's scan begins."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while at + 4 <= len(frame):
        n = 2 + struct.unpack_from(">H", frame, at + 2)[0]
        if frame[at + 1] == 0xDA:
            return at + n
        at += n
    raise ValueError("a frame without a scan")


_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _coefficients(layout: Layout, scans: list[bytes], ac: bool) -> list[np.ndarray]:
    """Of each component: quantised coefficients by frame and block, in raster order; 64 in natural order, or the DC alone."""
    rows, cols = layout.mcus
    total = rows * cols
    step = layout.restart or total
    pieces, frame, first = [], [], []
    for f, scan in enumerate(scans):
        for k, piece in enumerate(_RESTART.split(scan) if layout.restart else [scan]):
            if k * step < total:
                pieces.append(piece.replace(b"\xff\x00", b"\xff"))
                frame.append(f)
                first.append(k * step)
    if len(pieces) < len(scans) * -(-total // step):
        raise ValueError("a frame without some of its intervals")
    frame, first = np.array(frame, np.int64), np.array(first, np.int64)
    data = np.frombuffer(b"".join(p + bytes(8) for p in pieces), np.uint8)
    sizes = np.array([len(p) + 8 for p in pieces], np.int64)
    start = (np.cumsum(sizes) - sizes) * 8
    window = np.zeros(len(data) - 7, np.uint64)  # the 64 bits from each byte on
    for k in range(8):
        window |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    pos, end = start.copy(), start + (sizes - 8) * 8 + 7
    out = [np.zeros((len(scans), rows * c[1] * cols * c[0]) + ((64,) if ac else ()), np.int16) for c in layout.components]
    pred = np.zeros((len(layout.components), len(pieces)), np.int64)
    look = [(_lookup(*c[3], False), _lookup(*c[4], True)) for c in layout.components]

    def symbol(w: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(entries of the table, values, bits taken, what follows in w) of the symbols at the front of w."""
        entry = table[(w >> np.uint64(48)).view(np.int64)]
        n, size = entry & 31, (entry >> 5) & 31
        w = w << n.view(np.uint64)
        v = (w >> np.uint64(48)).view(np.int64) >> (16 - size)
        v -= np.where(v < _HALF[size], _FULL[size], 0)
        return entry, v, n + size, w << size.view(np.uint64)

    def ahead(p: np.ndarray) -> np.ndarray:
        return window[np.minimum(p >> 3, len(window) - 1)] << (p & 7).view(np.uint64)

    def step_on(who: np.ndarray | slice, entry: np.ndarray, taken: np.ndarray) -> None:
        pos[who] += taken
        if not (entry & 31).all() or (pos[who] > end[who]).any():
            raise ValueError("a frame that is cut short or damaged")

    for m in range(step):
        live: np.ndarray | slice = slice(None) if total % step == 0 else np.flatnonzero(first + m < total)
        mcu = first[live] + m
        if not len(mcu):
            break
        y, x = np.divmod(mcu, cols)
        for c, (h, v, *_rest) in enumerate(layout.components):
            for by in range(v):
                for bx in range(h):
                    block = (y * v + by) * (cols * h) + x * h + bx
                    entry, value, taken, w = symbol(ahead(pos[live]), look[c][0])
                    pred[c, live] += value
                    if ac:
                        out[c][frame[live], block, 0] = pred[c, live]
                    else:
                        out[c][frame[live], block] = pred[c, live]
                    step_on(live, entry, taken)
                    flat = look[c][1][(w >> np.uint64(48)).view(np.int64)]  # most often all these blocks end here
                    if ((flat >> 5) == 0).all():
                        step_on(live, flat, flat & 31)
                        continue
                    who = np.arange(len(pieces))[live]
                    k = np.ones(len(who), np.int64)
                    f, b = frame[live], block
                    while len(who):
                        entry, value, taken, _ = symbol(ahead(pos[who]), look[c][1])
                        step_on(who, entry, taken)
                        size, run = (entry >> 5) & 31, entry >> 10
                        ends = (size == 0) & (run < 15)
                        k = k + run
                        if (k[~ends] > 63).any():
                            raise ValueError("a damaged frame")
                        if ac:
                            put = size > 0
                            out[c][f[put], b[put], ZIGZAG[k[put]]] = value[put]
                        k = k + 1
                        on = ~ends & (k <= 63)
                        who, k, f, b = who[on], k[on], f[on], b[on]
    return out


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)


def _by_head(frames: list[bytes]) -> Iterator[tuple[Layout, list[int], list[bytes]]]:
    """Frames with equal headers together: their layout, places and scans."""
    groups: dict[bytes, tuple[list[int], list[bytes]]] = {}
    head = None
    for i, frame in enumerate(frames):
        if head is None or not frame.startswith(head):
            head = frame[: _head(frame)]
        at, scans = groups.setdefault(head, ([], []))
        end = frame.rfind(b"\xff\xd9")
        at.append(i)
        scans.append(frame[len(head) : end if end >= len(head) else len(frame)])
    for head, (at, scans) in groups.items():
        yield _layout(head), at, scans


def decode_dc(frames: list[bytes]) -> list[np.ndarray]:
    """Each frame's block means of the first component (its brightness): a uint8 picture of an eighth of the size."""
    out: list = [None] * len(frames)
    for layout, at, scans in _by_head(frames):
        h, v, quant, *_ = layout.components[0]
        rows, cols = layout.mcus
        for lo in range(0, len(scans), BATCH_FRAMES):
            dc = _coefficients(layout, scans[lo : lo + BATCH_FRAMES], False)[0].astype(np.int32)
            mean = np.clip(np.rint(dc * (quant[0] / 8)) + 128, 0, 255).astype(np.uint8).reshape(len(dc), rows * v, cols * h)
            for i, m in zip(at[lo : lo + BATCH_FRAMES], mean, strict=True):
                out[i] = m
    return out


def decode_pixels(frames: list[bytes]) -> list[np.ndarray]:
    """Each frame's samples, uint8 [height, width, components], components scaled up to the frame's size (no colour change)."""
    out: list = [None] * len(frames)
    for layout, at, scans in _by_head(frames):
        rows, cols = layout.mcus
        top_h, top_v = max(c[0] for c in layout.components), max(c[1] for c in layout.components)
        planes = []
        for (h, v, quant, *_), coef in zip(layout.components, _coefficients(layout, scans, True), strict=True):
            q = np.zeros(64)
            q[ZIGZAG] = quant
            block = (coef * q).reshape(len(scans), rows * v, cols * h, 8, 8)
            flat = np.einsum("ux,fabuv,vy->faxby", _basis(), block, _basis(), optimize=True).reshape(len(scans), rows * v * 8, cols * h * 8)
            full = np.clip(np.rint(flat) + 128, 0, 255).astype(np.uint8)
            planes.append(full.repeat(top_v // v, 1).repeat(top_h // h, 2)[:, : layout.height, : layout.width])
        for i, picture in zip(at, np.stack(planes, -1), strict=True):
            out[i] = picture
    return out


@dataclass
class Avi:
    width: int = 0
    height: int = 0
    fps: float = 0.0
    codec: bytes = b""
    #: Place and length of each frame's bytes; whether it is marked as a key frame.
    frames: list[tuple[int, int, bool]] = field(default_factory=list)


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(id, list type, place and length of the body) of the chunks between at and end; what a length claims is cut at end."""
    while at + 8 <= end:
        kind, n = struct.unpack_from("<4sI", data, at)
        lists = kind in (b"RIFF", b"LIST")
        yield kind, data[at + 8 : at + 12] if lists else b"", at + 8 + 4 * lists, max(min(n, end - at - 8) - 4 * lists, 0)
        at += 8 + n + (n & 1)


def read_avi(data: bytes | None) -> Avi:
    """Headers and frames of the first video stream; a file that isn't an AVI has no frames."""
    out, stream, number, found = Avi(), -1, None, []
    if not data or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return out
    movi: list[tuple[int, int]] = []
    index = b""
    for kind, form, at, n in _chunks(data, 0, len(data)):
        if kind != b"RIFF" or form not in (b"AVI ", b"AVIX"):
            continue
        for kind, form, at, n in _chunks(data, at, at + n):
            if form == b"hdrl":
                for kind, form, at, n in _chunks(data, at, at + n):
                    if form != b"strl":
                        continue
                    stream += 1
                    for kind, _, at, n in _chunks(data, at, at + n):
                        if kind == b"strh" and n >= 32 and data[at : at + 4] == b"vids" and number is None:
                            number = stream
                            scale, rate = struct.unpack_from("<II", data, at + 20)
                            out.codec, out.fps = data[at + 4 : at + 8], rate / scale if scale else 0.0
                        elif kind == b"strf" and n >= 40 and number == stream:
                            out.width, out.height = struct.unpack_from("<ii", data, at + 4)
            elif form == b"movi":
                movi.append((at, n))
            elif kind == b"idx1":
                index = data[at : at + n]
    own = (b"%02ddc" % (number or 0), b"%02ddb" % (number or 0))
    if index and movi:  # offsets count from the list's type, or in some files from the file's start
        entries = [(e[0], e[1], e[2], e[3]) for e in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16])]
        mine = [e for e in entries if e[0] in own]
        base = movi[0][0] - 4
        if mine and data[mine[0][2] : mine[0][2] + 4] == mine[0][0] and data[base + mine[0][2] : base + mine[0][2] + 4] != mine[0][0]:
            base = 0
        found = [(base + at + 8, n, bool(flags & 16)) for _, flags, at, n in mine if base + at + 8 + n <= len(data)]
    for at, n in movi[1 if found else 0 :]:
        inside = list(_chunks(data, at, at + n))
        parts = [c for c in inside if c[0] == b"ix%02d" % (number or 0) and c[3] >= 24]
        if parts:
            for _, _, at, n in parts:
                count, base = struct.unpack_from("<I", data, at + 4)[0], struct.unpack_from("<Q", data, at + 12)[0]
                for o, size in struct.iter_unpack("<II", data[at + 24 : at + 24 + 8 * min(count, (n - 24) // 8)]):
                    found.append((base + o, size & 0x7FFFFFFF, not size >> 31))
        else:
            for kind, form, at, n in inside:
                found += [(at, n, True)] if kind in own else [(a, m, True) for k, _, a, m in _chunks(data, at, at + n) if k in own] if form == b"rec " else []
    out.frames = found
    return out


def frames_of(data: bytes, avi: Avi) -> list[bytes]:
    return [data[at : at + n] for at, n, _ in avi.frames]


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """An AVI file of JPEG frames, with an idx1 index."""
    padded = [f + b"\0" * (len(f) & 1) for f in frames]
    sizes = [len(f) for f in frames]
    movi = b"movi" + b"".join(b"00dc" + n.to_bytes(4, "little") + f for n, f in zip(sizes, padded, strict=True))
    index = np.zeros((len(frames), 4), "<u4")
    if frames:
        index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 16, sizes
        index[:, 2] = 4 + np.concatenate([[0], np.cumsum([8 + len(f) for f in padded])[:-1]])
    most = max(sizes, default=0)
    chunk = lambda kind, body: kind + len(body).to_bytes(4, "little") + body
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", movi) + chunk(b"idx1", index.tobytes()))


@lru_cache(maxsize=1)
def _flat_tables() -> tuple[bytes, np.ndarray, np.ndarray]:
    """A flat-block frame's headers; bits and their number for each DC difference (from -255 on), the end of block included."""
    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    head = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([8] * 64)) + segment(0xC0, struct.pack(">BHHB", 8, BLOCKS_Y * 8, BLOCKS_X * 8, 1) + b"\x01\x11\x00")
    head += segment(0xC4, b"\x00" + bytes(_DC_COUNTS) + bytes(16 - len(_DC_COUNTS)) + bytes(_DC_VALUES)) + segment(0xC4, b"\x10\x01" + bytes(15) + b"\x00")
    head += segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    code = {v: (c, n) for v, c, n in _codes(_DC_COUNTS, _DC_VALUES)}
    bits, number = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        c, n = code[size]
        bits[d + 255] = ((c << size) | (d if d >= 0 else d + (1 << size) - 1)) << 1
        number[d + 255] = n + size + 1
    return head, bits, number


def flat_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG frames of samples (uint8 [frames, UNIT]), a flat block each."""
    head, bits, number = _flat_tables()
    dc = samples.astype(np.int16) - 128
    diff = np.diff(dc, axis=1, prepend=np.int16(0)) + 255
    value, n = bits[diff], number[diff]
    ends = np.cumsum(n, 1)
    size = (ends[:, -1] + 7) >> 3
    base = np.cumsum(size) - size
    at = (ends - n) + base[:, None] * 8
    byte = (at >> 3).ravel()
    word = (value << (np.uint64(32) - n.astype(np.uint64) - (at & 7).astype(np.uint64))).ravel()
    raw = np.zeros(int(size.sum()) + 4, np.uint8)
    for k in range(4):  # bits of different symbols never meet, so that sums are what an "or" gives
        part = (word >> np.uint64(24 - 8 * k)) & np.uint64(255)
        raw += np.bincount(byte + k, weights=part, minlength=len(raw)).astype(np.uint8)
    raw[base + size - 1] |= ((1 << (-ends[:, -1] & 7)) - 1).astype(np.uint8)
    data = raw.tobytes()
    return [head + data[a : a + b].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, b in zip(base.tolist(), size.tolist(), strict=True)]


def payload(text: str | None) -> bytes:
    """A text as UTF-8, with spaces up to a positive multiple of UNIT."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def avi_of_bytes(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload (whose lengths are multiples of UNIT)."""
    frames: list[bytes] = []
    whole = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    for lo in range(0, len(whole), BATCH_FRAMES):
        frames += flat_frames(whole[lo : lo + BATCH_FRAMES])
    out, at = [], 0
    for p in payloads:
        out.append(write_avi(frames[at : at + len(p) // UNIT], BLOCKS_X * 8, BLOCKS_Y * 8))
        at += len(p) // UNIT
    return out


def histograms(means: list[np.ndarray]) -> np.ndarray:
    """Each picture's histogram of BINS bins, in shares; a picture that is missing counts as an empty one."""
    out = np.zeros((len(means), BINS))
    sizes = {m.shape for m in means if m is not None}
    if len(sizes) == 1 and all(m is not None for m in means):
        flat = np.stack(means).reshape(len(means), -1) >> 3
        at = np.arange(len(means))[:, None] * BINS + flat
        return np.bincount(at.ravel(), minlength=out.size).reshape(out.shape) / flat.shape[1]
    for i, m in enumerate(means):
        if m is not None:
            out[i] = np.bincount(m.ravel() >> 3, minlength=BINS) / m.size
    return out


def cuts(hist: np.ndarray) -> np.ndarray:
    """Frames that begin a shot (but the first): those whose difference is over FLOOR, and over the mean of up to BEFORE
    differences before it by DEVIATIONS of their standard deviations."""
    if len(hist) < 2:
        return np.zeros(0, np.int64)
    d = 0.5 * np.abs(np.diff(hist, axis=0)).sum(1)
    c1, c2 = (np.concatenate([[0.0], np.cumsum(x)]) for x in (d, d * d))
    at = np.arange(len(d))
    lo = np.maximum(at - BEFORE, 0)
    n = np.maximum(at - lo, 1)
    mean = (c1[at] - c1[lo]) / n
    spread = np.sqrt(np.maximum((c2[at] - c2[lo]) / n - mean**2, 0))
    return np.flatnonzero((d > FLOOR) & (d > mean + DEVIATIONS * spread)) + 1


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """[first frame, frame after the last) of each shot."""
    if not len(hist):
        return []
    edges = [0, *cuts(hist).tolist(), len(hist)]
    return list(zip(edges, edges[1:]))


def _means(files: list[bytes | None], strict: bool) -> list[tuple[Avi, list]]:
    """Headers and block means of the frames of each file; the frames of all files are decoded together."""
    avis = [read_avi(f) for f in files]
    frames = [x for f, a in zip(files, avis, strict=True) for x in (frames_of(f, a) if f else [])]
    try:
        got = decode_dc(frames)
    except ValueError:
        if strict:
            raise
        got = []
        for x in frames:
            try:
                got += decode_dc([x])
            except (ValueError, KeyError, struct.error, IndexError):
                got.append(None)
    out, at = [], 0
    for a in avis:
        out.append((a, got[at : at + len(a.frames)]))
        at += len(a.frames)
    return out


def clips(df: DataFrame, media: str = "media") -> DataFrame:
    """A row for each shot of each file: its other columns, and clip, first_frame, n_frames, start_s, end_s, brightness (which replace columns of those names) in place of media."""

    @F.pandas_udf("array<struct<clip:int,first_frame:int,n_frames:int,start_s:double,end_s:double,brightness:double>>")
    def found(col: pd.Series) -> pd.Series:
        out = []
        for lo in range(0, len(col), 64):
            for avi, means in _means(col.iloc[lo : lo + 64].tolist(), False):
                rate = avi.fps or float(FPS)
                light = [float(m.mean()) if m is not None else 0.0 for m in means]
                out.append([(i, a, b - a, a / rate, b / rate, round(float(np.mean(light[a:b])), 6)) for i, (a, b) in enumerate(shots(histograms(means)))])
        return pd.Series(out)

    made = ("clip", "first_frame", "n_frames", "start_s", "end_s", "brightness")
    rest = [c for c in df.columns if c != media and c not in made]
    at = fresh("_clip", df)
    return df.withColumn(at, F.explode(found(F.col(media)))).select(*[f"`{c}`" for c in rest], *[F.col(at)[c].alias(c) for c in made])


def _groups(sizes: list[int], most: int) -> Iterator[slice]:
    lo = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(lo, i)
            lo, held = i, 0
        held += n
    if held or sizes:
        yield slice(lo, len(sizes))


def text_media(docs: DataFrame) -> DataFrame:
    """docs with n_bytes and media (which replace columns of those names): each whole text as an AVI file, in place of text."""

    @F.pandas_udf("binary")
    def made(text: pd.Series) -> pd.Series:
        raw = [payload(t) for t in text]
        return pd.Series([f for part in _groups([len(p) for p in raw], 1 << 20) for f in avi_of_bytes(raw[part])])

    return docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("media", made("text")).drop("text")


def media_digest(df: DataFrame) -> DataFrame:
    """df with what is read back from the column media, in its place: the payload's length and digests, the file's, and the shots."""
    schema = "struct<payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>"

    @F.pandas_udf(schema)
    def read(media: pd.Series) -> pd.DataFrame:
        files, out = media.tolist(), []
        for part in _groups([len(f) for f in files], 2 << 20):
            for f, (avi, means) in zip(files[part], _means(files[part], True), strict=True):
                raw = b"".join(m.tobytes() for m in means)
                starts = [a for a, _ in shots(histograms(means))]
                feature = f"{len(means)} frames {avi.width}x{avi.height} {avi.codec.decode('latin-1')} {avi.fps:g}/s shots {len(starts)} at {' '.join(map(str, starts))}"
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(f), hashlib.sha256(f).hexdigest(), feature))
        return pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    made = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    rest = [c for c in df.columns if c != "media" and c not in made]
    at = fresh("_read", df)
    return df.withColumn(at, read("media")).select(*[f"`{c}`" for c in rest], *[F.col(at)[c].alias(c) for c in made])


def op6_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return media_digest(text_media(documents(spark, sf_dir).select("doc_id", "text")))
