"""PNG and baseline JPEG frames as images (see `images`), decoded by batches.

PNG: rows of all frames of one shape are undone together, predictor by predictor. JPEG: entropy decoding is a step for
each symbol; everything after it (dequantising, inverse transform, upsampling, colour) is an operation over all blocks of a
frame. Defined results: a null stays null; bytes that are no such frame raise, or give null where skip is set; interlaced PNG
and progressive, arithmetic or 12-bit JPEG count as none.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .images import IMAGE, _from_stacks

_PNG = b"\x89PNG\r\n\x1a\n"
#: Channels of each PNG colour type.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class NoFrame(ValueError):
    pass


def _png_parts(raw: bytes) -> tuple[tuple[int, int, int, int], bytes, np.ndarray | None]:
    """((width, height, bit depth, colour type), filtered rows, palette) of a file."""
    at, head, data, palette = 8, None, [], None
    while at + 8 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        if len(body) < n:
            raise NoFrame("a PNG chunk is cut off")
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if interlaced or colour not in _CHANNELS or not w or not h:
                raise NoFrame("a PNG of a kind that isn't read")
            head = (w, h, depth, colour)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or (head[3] == 3 and palette is None):
        raise NoFrame("a PNG without a header or a palette")
    try:
        return head, zlib.decompress(b"".join(data)), palette
    except zlib.error as e:
        raise NoFrame(f"a PNG whose data don't inflate: {e}") from e


def unfiltered(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Bytes [n, h, stride] of frames whose row y has predictor kinds[:, y], step bytes a pixel, undone row by row."""
    n, h, stride = rows.shape
    out = np.zeros((n, h + 1, stride), np.uint8)
    for y in range(h):
        row, above = rows[:, y], out[:, y]
        this = out[:, y + 1]
        for kind in np.unique(kinds[:, y]).tolist():
            own = np.flatnonzero(kinds[:, y] == kind)
            a, up = row[own], above[own]
            if kind == 0:
                this[own] = a
            elif kind == 1:
                this[own] = np.cumsum(a.reshape(len(own), -1, step), axis=1, dtype=np.uint8).reshape(len(own), stride)
            elif kind == 2:
                this[own] = a + up
            elif kind in (3, 4):
                pixels, ups = a.reshape(len(own), -1, step), up.reshape(len(own), -1, step).astype(np.int16)
                left = np.zeros((len(own), step), np.int16)
                corner = np.zeros((len(own), step), np.int16)
                made = np.empty_like(pixels)
                for x in range(pixels.shape[1]):
                    b = ups[:, x]
                    if kind == 3:
                        guess = (left + b) >> 1
                    else:
                        # the neighbour nearest to left + above - corner; left before above before corner
                        pl, pb, pc = np.abs(b - corner), np.abs(left - corner), np.abs(left + b - 2 * corner)
                        guess = np.where((pl <= pb) & (pl <= pc), left, np.where(pb <= pc, b, corner))
                    made[:, x] = pixels[:, x] + guess.astype(np.uint8)
                    left, corner = made[:, x].astype(np.int16), b
                this[own] = made.reshape(len(own), stride)
            else:
                raise NoFrame(f"PNG predictor {kind}")
    return out[:, 1:]


def png_images(files: Sequence[bytes], skip: bool = False) -> list[np.ndarray | None]:
    """[h, w, c] of each file: 1 to 4 channels of bytes; 16-bit samples keep their upper byte, palettes become colours."""
    out: list[np.ndarray | None] = [None] * len(files)
    alike: dict[tuple[int, int, int, int], list[tuple[int, bytes, np.ndarray | None]]] = {}
    for i, raw in enumerate(files):
        try:
            head, rows, palette = _png_parts(raw)
            stride = -(-head[0] * _CHANNELS[head[3]] * head[2] // 8)
            if len(rows) != head[1] * (stride + 1):
                raise NoFrame("a PNG with too many or too few bytes")
        except (NoFrame, struct.error) as e:
            if not skip:
                raise NoFrame(str(e)) from e
            continue
        alike.setdefault(head, []).append((i, rows, palette))
    for (w, h, depth, colour), own in alike.items():
        c = _CHANNELS[colour]
        stride = -(-w * c * depth // 8)
        raw = np.frombuffer(b"".join(r for _, r, _ in own), np.uint8).reshape(len(own), h, stride + 1)
        rows = unfiltered(raw[:, :, 1:], raw[:, :, 0], max(1, c * depth // 8))
        if depth == 16:
            rows = rows[:, :, ::2]
        elif depth < 8:
            bits = np.unpackbits(rows, axis=2).reshape(len(own), h, -1, depth)[:, :, :w]
            rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(3).astype(np.uint8)
            if colour == 0:
                rows = rows * np.uint8(255 // ((1 << depth) - 1))
        for k, (i, _, palette) in enumerate(own):
            out[i] = palette[rows[k]] if colour == 3 else rows[k].reshape(h, w, c)
    return out


def _order() -> np.ndarray:
    """Places of an 8 x 8 block along its diagonals, to and fro."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else -p[0]))
    return np.array([y * 8 + x for y, x in cells])


_DIAGONAL = _order()
_WAVES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else np.sqrt(0.125)) for x in range(8)] for u in range(8)])


def _lookup(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """For each next 16 bits the code's length (0: none) and its symbol."""
    sizes, values = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    at = k = 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            span = 1 << (16 - n)
            sizes[at : at + span], values[at : at + span] = n, symbols[k]
            at, k = at + span, k + 1
    return sizes.tolist(), values.tolist()


def _scan(data: bytes, plan: list[tuple[int, tuple, tuple]], units: int) -> list[list[int]]:
    """Coefficients (place, value pairs: block * 64 + place, value), in order, of one restart interval; plan: (component, DC, AC) of each block."""
    total = len(data) * 8
    # a window of 64 bits at each byte, so that any code and its value are one shift away
    padded = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
    windows = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        windows |= padded[k : k + len(data) + 1] << np.uint64(56 - 8 * k)
    window = windows.tolist()
    at, last, places, values, block = 0, {}, [], [], 0
    for _ in range(units):
        for component, (dc_size, dc_symbol), (ac_size, ac_symbol) in plan:
            k = 0
            while k < 64:
                if at >= total:
                    raise NoFrame("a JPEG scan ends too soon")
                head = window[at >> 3] << (at & 7)
                peek = head >> 48 & 0xFFFF
                n, s = (dc_size[peek], dc_symbol[peek]) if k == 0 else (ac_size[peek], ac_symbol[peek])
                if not n:
                    raise NoFrame("a JPEG code that isn't in its table")
                at += n
                size = s & 15
                v = 0
                if size:
                    v = window[at >> 3] << (at & 7)
                    v = v >> (64 - size) & ((1 << size) - 1)
                    at += size
                    if not v >> (size - 1):
                        v -= (1 << size) - 1
                if k == 0:
                    v += last.get(component, 0)
                    last[component] = v
                    places.append(block * 64)
                    values.append(v)
                    k = 1
                elif size:
                    k += s >> 4
                    if k > 63:
                        raise NoFrame("a JPEG block is too long")
                    places.append(block * 64 + k)
                    values.append(v)
                    k += 1
                elif s == 0xF0:
                    k += 16
                elif s:
                    raise NoFrame("a JPEG code that isn't baseline")
                else:
                    break
            block += 1
    return [places, values]


def jpeg_image(raw: bytes) -> np.ndarray:
    """[h, w, c] of a baseline JPEG: one channel, or three as red, green and blue."""
    at, tables, codes, frame, restart = 2, {}, {}, None, 0
    if raw[:2] != b"\xff\xd8":
        raise NoFrame("no JPEG")
    while True:
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise NoFrame("a JPEG without a scan")
        marker, n = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        if marker == 0xFF:
            at += 1
            continue
        body = raw[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                tables[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                many = sum(body[1:17])
                codes[body[0]] = _lookup(body[1:17], body[17 : 17 + many])
                body = body[17 + many :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise NoFrame("a JPEG of more than 8 bits")
            h, w = struct.unpack_from(">HH", body, 1)
            frame = (h, w, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])])
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise NoFrame("a JPEG that isn't baseline")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if frame is None or len(chosen) != len(frame[2]) or len(frame[2]) not in (1, 3):
        raise NoFrame("a JPEG of several scans, or of another number of components")
    h, w, parts = frame
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-w // (8 * most_h)), -(-h // (8 * most_v))
    plan = [(c, codes[chosen[c] >> 4], codes[16 | chosen[c] & 15]) for c, ph, pv, _ in parts for _ in range(ph * pv)]
    # the scan up to the next marker, cut at restarts, without the zeros that follow 255
    data = np.frombuffer(raw, np.uint8)[at:]
    marks = np.flatnonzero((data[:-1] == 255) & (data[1:] != 0) & (data[1:] != 255))
    pieces, begin = [], 0
    for m in marks.tolist():
        pieces.append(data[begin:m])
        begin = m + 2
        if not 0xD0 <= data[m + 1] <= 0xD7:
            break
    else:
        pieces.append(data[begin:])
    blocks = np.zeros(across * down * len(plan) * 64)
    done = 0
    for piece in pieces:
        units = min(restart or across * down, across * down - done)
        if units <= 0:
            break
        places, values = _scan(piece.tobytes().replace(b"\xff\x00", b"\xff"), plan, units)
        blocks[np.array(places, np.int64) + done * len(plan) * 64] = values
        done += units
    if done < across * down:
        raise NoFrame("a JPEG that is cut off")
    units = blocks.reshape(down, across, len(plan), 64)
    planes, first = [], 0
    for _, ph, pv, q in parts:
        own = np.zeros((down, across, ph * pv, 64))
        own[..., _DIAGONAL] = units[:, :, first : first + ph * pv] * tables[q]
        first += ph * pv
        pixels = np.einsum("...uv,uy,vx->...yx", own.reshape(down, across, pv, ph, 8, 8), _WAVES, _WAVES, optimize=True)
        plane = np.clip(np.rint(pixels.transpose(0, 2, 4, 1, 3, 5).reshape(down * pv * 8, across * ph * 8) + 128), 0, 255)
        planes.append(plane.repeat(most_v // pv, 0).repeat(most_h // ph, 1)[:h, :w])
    if len(planes) == 1:
        return planes[0].astype(np.uint8)[:, :, None]
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def decoded_images(files: Sequence[bytes | None], skip: bool = False) -> list[np.ndarray | None]:
    """PNG and JPEG files, told apart by how they begin."""
    out: list[np.ndarray | None] = [None] * len(files)
    png = [i for i, f in enumerate(files) if f is not None and f[:8] == _PNG]
    for i, a in zip(png, png_images([files[i] for i in png], skip), strict=True):
        out[i] = a
    for i, f in enumerate(files):
        if f is None or f[:8] == _PNG:
            continue
        try:
            out[i] = jpeg_image(f)
        except (NoFrame, KeyError, IndexError, struct.error) as e:
            if not skip:
                raise NoFrame(f"no frame that can be read: {e}") from e
    return out


def decoded(frame: Column, skip: bool = False) -> Column:
    """Bytes of a PNG or JPEG file as an image."""

    @F.pandas_udf(IMAGE)
    def run(files: pd.Series) -> pd.DataFrame:
        made = decoded_images([None if f is None else bytes(f) for f in files], skip)
        return _from_stacks(len(files), ((np.array([i]), a[None]) for i, a in enumerate(made) if a is not None))

    return run(frame)


def png_file(a: np.ndarray, predictor: int = 0) -> bytes:
    """An image [h, w, c] of bytes as a PNG whose rows all have one predictor."""
    h, w, c = a.shape
    x = a.astype(np.int16).reshape(h, w, c)
    left, above = np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], above[1:] = x[:, :-1], x[:-1]
    corner = np.zeros_like(x)
    corner[1:, 1:] = x[:-1, :-1]
    pl, pb, pc = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
    guess = [np.zeros_like(x), left, above, (left + above) >> 1, np.where((pl <= pb) & (pl <= pc), left, np.where(pb <= pc, above, corner))][predictor]
    rows = np.concatenate([np.full((h, 1), predictor, np.uint8), (x - guess).astype(np.uint8).reshape(h, w * c)], 1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    colour = {n: k for k, n in _CHANNELS.items() if k != 3}[c]
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def encoded_png(image: Column) -> Column:
    """An image as the bytes of a PNG file."""

    @F.pandas_udf("binary")
    def run(images: pd.DataFrame) -> pd.Series:
        shape = images[["height", "width", "channels"]].to_numpy(dtype=float, na_value=0).astype(int)
        return pd.Series([None if d is None else png_file(np.frombuffer(d, np.uint8).reshape(s), 2) for d, s in zip(images["data"], shape, strict=True)], dtype=object)

    return run(image)
