"""Frames of PNG and JPEG files, resampling kernels, and images by stacks."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.functions import frames, images


def picture(rng, h, w, c):
    yy, xx = np.mgrid[0:h, 0:w]
    base = 120 + 60 * np.sin(yy / 5 + rng.random() * 6) + 50 * np.cos(xx / 7)
    return np.clip(base[:, :, None] + rng.normal(0, 3, (h, w, c)), 0, 255).astype(np.uint8)


def test_png_of_every_predictor_is_exact():
    rng = np.random.default_rng(1)
    made = [rng.integers(0, 256, (h, w, c), np.uint8) if rough else picture(rng, h, w, c) for h, w in ((1, 1), (7, 5), (16, 33)) for c in (1, 2, 3, 4) for rough in (0, 1) for _ in range(5)]
    files = [frames.png_file(a, i % 5) for i, a in enumerate(made)]
    for a, got in zip(made, frames.png_images(files), strict=True):
        assert (a == got).all()


def plain_png(w, h, depth, colour, rows, palette=None):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = zlib.compress(b"".join(b"\x00" + r for r in rows))
    half = len(data) // 2
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", data[:half]) + chunk(b"IDAT", data[half:]) + chunk(b"IEND", b"")


def test_png_of_other_depths():
    assert frames.png_images([plain_png(10, 2, 1, 0, [b"\xaa\x80", b"\x55\x40"])])[0][:, :, 0].tolist() == [[255, 0] * 5, [0, 255] * 5]
    assert frames.png_images([plain_png(3, 1, 4, 3, [b"\x02\x10"], bytes(range(9)))])[0].tolist() == [[[0, 1, 2], [6, 7, 8], [3, 4, 5]]]
    assert frames.png_images([plain_png(2, 1, 16, 0, [b"\x12\x34\xff\x00"])])[0].tolist() == [[[0x12], [0xFF]]]
    bad = [plain_png(2, 1, 8, 0, [b"\x01"]), b"\x89PNG\r\n\x1a\nnothing", plain_png(1, 1, 8, 0, [b"a"])[:-30]]
    for f in bad:
        with pytest.raises(frames.NoFrame):
            frames.png_images([f])
    assert frames.png_images(bad, skip=True) == [None] * 3


def jpeg_file(a, sampling=1, restart=0, step=1):
    """A plain encoder, a symbol at a time, with codes of equal lengths for all symbols."""
    h, w, c = a.shape
    x = a.astype(float)
    if c == 3:
        r, g, b = x[..., 0], x[..., 1], x[..., 2]
        x = np.stack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b], 2)
    unit = 8 * sampling
    x = np.pad(x, ((0, -h % unit), (0, -w % unit), (0, 0)), mode="edge") - 128
    waves = np.array([[np.cos((2 * i + 1) * u * np.pi / 16) * (0.5 if u else 8**-0.5) for i in range(8)] for u in range(8)])
    zig = sorted(((v, u) for v in range(8) for u in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else -p[0]))
    ac = [run << 4 | s for run in range(16) for s in range(1, 11)] + [0, 0xF0]
    seg = lambda k, body: bytes([255, k]) + (len(body) + 2).to_bytes(2, "big") + body
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0] + [step] * 64))
    out += seg(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([c]) + b"".join(bytes([i + 1, (sampling * 17 if i == 0 and c == 3 else 17), 0]) for i in range(c)))
    out += seg(0xC4, bytes([0] + [0] * 3 + [12] + [0] * 12) + bytes(range(12))) + seg(0xC4, bytes([16] + [0] * 7 + [len(ac)] + [0] * 8) + bytes(ac))
    if restart:
        out += seg(0xDD, restart.to_bytes(2, "big"))
    out += seg(0xDA, bytes([c]) + b"".join(bytes([i + 1, 0]) for i in range(c)) + b"\x00\x3f\x00")
    bits, last, done, marker = [], [0] * c, 0, 0

    def put(v, n):
        bits.append(format(v, f"0{n}b") if n else "")

    def amount(v):
        n = abs(v).bit_length()
        return n, (v if v > 0 else v + (1 << n) - 1)

    def flush():
        s = "".join(bits)
        s += "1" * (-len(s) % 8)
        bits.clear()
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")

    for uy in range(0, x.shape[0], unit):
        for ux in range(0, x.shape[1], unit):
            if restart and done and done % restart == 0:
                out += flush() + bytes([255, 0xD0 + marker % 8])
                marker, last = marker + 1, [0] * c
            done += 1
            for i in range(c):
                plane = x[uy : uy + unit, ux : ux + unit, i]
                if i and sampling > 1:
                    plane = plane.reshape(8, sampling, 8, sampling).mean((1, 3))
                for by in range(0, plane.shape[0], 8):
                    for bx in range(0, plane.shape[1], 8):
                        q = np.rint(waves @ plane[by : by + 8, bx : bx + 8] @ waves.T / step).astype(int)
                        flat = [int(q[v, u]) for v, u in zig]
                        n, v = amount(flat[0] - last[i])
                        last[i] = flat[0]
                        put(n, 4), put(v, n)
                        run = 0
                        end = max((k for k in range(1, 64) if flat[k]), default=0)
                        for k in range(1, end + 1):
                            if not flat[k]:
                                run += 1
                                continue
                            while run > 15:
                                put(ac.index(0xF0), 8)
                                run -= 16
                            n, v = amount(flat[k])
                            put(ac.index(run << 4 | n), 8), put(v, n)
                            run = 0
                        if end < 63:
                            put(ac.index(0), 8)
    return out + flush() + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_jpeg_is_within_a_level(restart):
    rng = np.random.default_rng(2)
    for h, w in ((8, 8), (17, 30), (40, 16)):
        grey = picture(rng, h, w, 1)
        got = frames.jpeg_image(jpeg_file(grey, restart=restart))
        assert got.shape == grey.shape and np.abs(got.astype(int) - grey).max() <= 1
        colour = picture(rng, h, w, 3)
        got = frames.jpeg_image(jpeg_file(colour, restart=restart))
        d = np.abs(got.astype(int) - colour)  # each plane is within a level, and the colour transform adds three of them up
        assert d.max() <= 4 and d.mean() < 1
        tone = np.clip(grey.astype(int) + np.array([0, -40, 30]), 0, 255).astype(np.uint8)
        smooth = np.clip(grey.astype(int) * 0 + 100 + np.array([0, -40, 30]), 0, 255).astype(np.uint8)
        assert np.abs(frames.jpeg_image(jpeg_file(smooth, 2, restart)).astype(int) - smooth).max() <= 1 and tone.shape == (h, w, 3)


def test_frames_that_are_none(spark):
    rng = np.random.default_rng(3)
    a = picture(rng, 12, 9, 3)
    good = jpeg_file(a)
    for bad in (b"", b"\xff\xd8\xff", good[:200], good[: len(good) // 2], good.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises(frames.NoFrame):
            frames.decoded_images([bad])
    rows = [(0, frames.png_file(a, 4)), (1, good), (2, None), (3, b"x"), (4, frames.png_file(a[:5], 1))]
    df = spark.createDataFrame(rows, "id int, frame binary")
    got = {r.id: r.i for r in df.select("id", frames.decoded(F.col("frame"), skip=True).alias("i")).collect()}
    assert (images.to_array(got[0]) == a).all() and np.abs(images.to_array(got[1]).astype(int) - a).max() <= 4 and got[4].height == 5
    assert all(got[k] is None or got[k].data is None for k in (2, 3))
    back = df.where("id = 0").select(frames.encoded_png(frames.decoded(F.col("frame"))).alias("f")).first().f
    assert (frames.png_images([bytes(back)])[0] == a).all()


def plain_resize(a, height, width, kernel):
    """Sample by sample."""
    h, w, c = a.shape
    out = np.zeros((height, width, c))

    def weights(n, m, at):
        scale = max(n / m, 1)
        centre = (at + 0.5) * n / m
        own = [float(images.KERNELS[kernel](np.array((i + 0.5 - centre) / scale))) for i in range(n)]
        return [v / sum(own) for v in own]

    for y in range(height):
        wy = weights(h, height, y)
        for x in range(width):
            wx = weights(w, width, x)
            for k in range(c):
                out[y, x, k] = sum(wy[i] * wx[j] * a[i, j, k] for i in range(h) for j in range(w))
    return out


@pytest.mark.parametrize("kernel", sorted(images.KERNELS))
def test_kernels_against_single_samples(kernel):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (3, 6, 5, 2), np.uint8)
    for size in ((3, 4), (9, 11), (6, 5)):
        got = images.resize(a, *size, kernel=kernel)
        for k in range(3):
            assert np.allclose(got[k], plain_resize(a[k].astype(float), *size, kernel))
    assert np.allclose(images.kernel_weights(9, 4, kernel).sum(1), 1)
    flat = np.full((4, 4, 1), 77, np.uint8)
    assert (np.rint(images.resize(flat, 7, 3, kernel=kernel)) == 77).all()


def test_float_images_are_padded_with_minus_one(spark):
    x = np.linspace(-1, 1, 4 * 8).reshape(4, 8, 1).astype(np.float32)
    df = spark.createDataFrame([(0, (4, 8, 1, x.ravel().tolist())), (1, None)], f"id int, i {images.FLOAT_IMAGE}")
    got = {r.id: r.i for r in df.select("id", images.resized_floats(F.col("i"), 8, 8).alias("i")).collect()}
    a = np.array(got[0].data).reshape(8, 8, 1)
    assert (a[:2] == -1).all() and (a[6:] == -1).all() and np.allclose(a[2:6], x, atol=1e-6) and got[1] is None


def test_stacks_of_several_shapes_and_nulls(spark):
    rng = random.Random(5)
    made = [np.array([[[rng.randrange(256) for _ in range(c)] for _ in range(w)] for _ in range(h)], np.uint8) for h, w, c in [(2, 4, 3), (3, 2, 4), (2, 4, 3), (1, 1, 3)] * 3]
    df = spark.createDataFrame([(i, images.to_row(a)) for i, a in enumerate(made)] + [(99, None)], f"id int, i {images.IMAGE}").coalesce(1)
    for f, g in ((images.turned, lambda a: a[::-1, ::-1]), (images.flipped_channels, lambda a: a[:, :, ::-1]), (images.without_alpha, lambda a: a[:, :, :3]), (images.channels_first, lambda a: a.transpose(2, 0, 1)), (images.left_half, lambda a: a[:, : a.shape[1] // 2])):
        got = {r.id: r.i for r in df.where("id <> 11 AND id <> 3 AND id <> 7").select("id", f(F.col("i")).alias("i")).collect()}
        assert got.pop(99) is None
        for k, r in got.items():
            assert (images.to_array(r) == g(made[k])).all()
    both = df.select("id", images.beside(F.col("i"), F.col("i")).alias("b"), images.channels_last(images.channels_first(F.col("i"))).alias("l"), images.scaled(F.col("i")).alias("s")).collect()
    for r in both:
        if r.id == 99:
            assert r.s is None and (r.b is None or r.b.data is None)
        else:
            a = made[r.id]
            assert (images.to_array(r.b) == np.concatenate([a, a], 1)).all() and np.allclose(r.s, a.ravel() / 255 * 2 - 1, atol=1e-6)
            assert a.shape[2] != 3 or (images.to_array(r.l) == a).all()
    half = df.where("id = 0").select(images.resized_exactly(F.col("i"), 4, 2).alias("i")).first().i
    assert (half.height, half.width) == (4, 2)
