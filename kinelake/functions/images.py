"""Images as structs of height, width, channels and bytes (uint8, row by row): resizing, layout, colour, augmentation.

Catalyst has no pixel functions, so these are Arrow-batched UDFs over numpy; a batch's images of one shape are one array. Defined results: a null image stays null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = "struct<height:int,width:int,channels:int,data:binary>"
FLOAT_IMAGE = "struct<height:int,width:int,channels:int,data:array<float>>"


def to_array(row) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(int(row["height"]), int(row["width"]), int(row["channels"]))


def to_row(a: np.ndarray) -> tuple:
    a = np.ascontiguousarray(a, np.uint8)
    return a.shape[0], a.shape[1], a.shape[2], a.tobytes()


def _axis(size: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours and the second one's share for out samples of a line of size, by half-pixel centres."""
    at = (np.arange(out) + 0.5) * size / out - 0.5
    lo = np.floor(at).astype(int)
    return np.clip(lo, 0, size - 1), np.clip(lo + 1, 0, size - 1), at - lo


def _cubic(x: np.ndarray) -> np.ndarray:
    """Keys' cubic of a = -0.5."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


#: Kernels of resampling over the distance from a sample's centre.
KERNELS = {
    "box": lambda x: ((x >= -0.5) & (x < 0.5)).astype(float),
    "linear": lambda x: np.maximum(0, 1 - np.abs(x)),
    "cubic": _cubic,
    "lanczos": _lanczos,
}


def kernel_weights(size: int, out: int, kernel: str = "linear") -> np.ndarray:
    """Weights [out, size]: a kernel that widens where the line shrinks, cut at the ends, each row summing to 1."""
    scale = max(size / out, 1.0)
    centre = (np.arange(out) + 0.5) * size / out
    w = KERNELS[kernel]((np.arange(size)[None, :] + 0.5 - centre[:, None]) / scale)
    return w / w.sum(1, keepdims=True)


def resize(a: np.ndarray, height: int, width: int, antialias: bool = True, kernel: str = "linear") -> np.ndarray:
    """Images [..., h, w, c] resampled by a separable kernel, as floats; without antialias bilinear between neighbours."""
    x = a.astype(np.float64)
    h, w = a.shape[-3:-1]
    if antialias:
        return np.einsum("yh,...hwc,xw->...yxc", kernel_weights(h, height, kernel), x, kernel_weights(w, width, kernel), optimize=True)
    y0, y1, fy = _axis(h, height)
    x0, x1, fx = _axis(w, width)
    rows = x[..., y0, :, :] * (1 - fy)[:, None, None] + x[..., y1, :, :] * fy[:, None, None]
    return rows[..., :, x0, :] * (1 - fx)[None, :, None] + rows[..., :, x1, :] * fx[None, :, None]


def resize_with_pad(a: np.ndarray, height: int, width: int, kernel: str = "linear") -> np.ndarray:
    """As large as fits without distortion, centred; the rest of an odd border is at the bottom and right.

    Images [..., h, w, c] of bytes, on 0, or of floats in [-1, 1], on -1 and kept within.
    """
    h, w = a.shape[-3:-1]
    if (h, w) == (height, width):
        return a
    whole = a.dtype == np.uint8
    ratio = max(w / width, h / height)
    nh, nw = max(1, int(h / ratio)), max(1, int(w / ratio))
    out = np.full((*a.shape[:-3], height, width, a.shape[-1]), 0 if whole else -1, a.dtype)
    top, left = (height - nh) // 2, (width - nw) // 2
    made = resize(a, nh, nw, kernel=kernel)
    out[..., top : top + nh, left : left + nw, :] = np.clip(np.rint(made), 0, 255) if whole else np.clip(made, -1, 1)
    return out


def _stacks(frame: pd.DataFrame, dtype=np.uint8):
    """(places, images [n, h, w, c]) of a batch's images of each shape; nulls are in none."""
    there = frame["data"].notna().to_numpy()
    shape = frame[["height", "width", "channels"]].to_numpy(dtype=float, na_value=0).astype(int)
    for own in np.unique(shape[there], axis=0):
        at = np.flatnonzero(there & (shape == own).all(1))
        data = frame["data"].to_numpy()[at]
        flat = np.frombuffer(b"".join(data), dtype) if dtype == np.uint8 else np.concatenate([np.asarray(d, dtype) for d in data])
        yield at, flat.reshape(len(at), *own)


def _from_stacks(n: int, made, floats: bool = False) -> pd.DataFrame:
    """A batch of n images from (places, images); what no place names is null."""
    out = np.full((n, 4), None, object)
    for at, a in made:
        a = np.ascontiguousarray(a, np.float32 if floats else np.uint8)
        out[at, :3] = a.shape[1:]
        for k, i in enumerate(at.tolist()):
            out[i, 3] = a[k].ravel() if floats else a[k].tobytes()
    frame = pd.DataFrame(out, columns=["height", "width", "channels", "data"])
    return frame.astype({"height": "Int32", "width": "Int32", "channels": "Int32"})


def _mapped(f):
    """f over stacks of images [n, h, w, c] of equal shape, each of them one operation; a null image stays null."""

    @F.pandas_udf(IMAGE)
    def run(images: pd.DataFrame) -> pd.DataFrame:
        return _from_stacks(len(images), ((at, f(a)) for at, a in _stacks(images)))

    return lambda c: F.when(c.isNotNull(), run(c))


def resized(image: Column, height: int, width: int, kernel: str = "linear") -> Column:
    return _mapped(lambda a: resize_with_pad(a, height, width, kernel))(image)


def resized_exactly(image: Column, height: int, width: int, kernel: str = "cubic") -> Column:
    """To height and width whatever the proportions; rounded to whole samples after either direction."""

    def run(a: np.ndarray) -> np.ndarray:
        whole = lambda x: np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)
        return whole(resize(whole(resize(a, a.shape[1], width, kernel=kernel)), height, width, kernel=kernel))

    return _mapped(run)(image)


def resized_floats(image: Column, height: int, width: int, kernel: str = "linear") -> Column:
    """A float image (FLOAT_IMAGE, samples in [-1, 1]) as large as fits, centred on -1."""

    @F.pandas_udf(FLOAT_IMAGE)
    def run(images: pd.DataFrame) -> pd.DataFrame:
        return _from_stacks(len(images), ((at, resize_with_pad(a, height, width, kernel)) for at, a in _stacks(images, np.float32)), floats=True)

    return F.when(image.isNotNull(), run(image))


def flipped_channels(image: Column) -> Column:
    """Blue, green, red as red, green, blue, and back."""
    return _mapped(lambda a: a[..., ::-1])(image)


def without_alpha(image: Column) -> Column:
    return _mapped(lambda a: a[..., :3])(image)


def turned(image: Column) -> Column:
    """By half a turn."""
    return _mapped(lambda a: a[:, ::-1, ::-1])(image)


def channels_last(image: Column) -> Column:
    """An image whose height field is a channel count of 3 (channels first) in the usual layout."""
    return _mapped(lambda a: a.transpose(0, 2, 3, 1) if a.shape[1] == 3 else a)(image)


def channels_first(image: Column) -> Column:
    """The layout that channels_last takes, its fields being channels, height and width."""
    return _mapped(lambda a: a.transpose(0, 3, 1, 2))(image)


def left_half(image: Column) -> Column:
    return _mapped(lambda a: a[:, :, : a.shape[2] // 2])(image)


def right_half(image: Column) -> Column:
    return _mapped(lambda a: a[:, :, a.shape[2] // 2 :])(image)


def beside(a: Column, b: Column) -> Column:
    """Two images of equal height next to each other; null where one of them is."""

    @F.pandas_udf(IMAGE)
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        made = []
        for at, left in _stacks(x):
            for own, right in _stacks(y.iloc[at]):
                made.append((at[own], np.concatenate([left[own], right], 2)))
        return _from_stacks(len(x), made)

    return run(a, b)


def scaled(image: Column) -> Column:
    """Samples as floats in [-1, 1]."""

    @F.pandas_udf("array<float>")
    def run(images: pd.DataFrame) -> pd.Series:
        out = np.full(len(images), None, object)
        for at, a in _stacks(images):
            made = a.reshape(len(at), -1).astype(np.float32) / 255 * 2 - 1
            for k, i in enumerate(at.tolist()):
                out[i] = made[k]
        return pd.Series(out)

    return run(image)


def to_uint8(samples: Column, height: int, width: int, channels: int = 3) -> Column:
    """Floats in [0, 1] as an image, cut to whole numbers."""

    @F.pandas_udf(IMAGE)
    def run(x: pd.Series) -> pd.DataFrame:
        at = np.flatnonzero(x.notna())
        made = [] if not len(at) else [(at, (255 * np.stack(x.to_numpy()[at]).astype(np.float64)).astype(np.uint8).reshape(len(at), height, width, channels))]
        return _from_stacks(len(x), made)

    return run(samples)


def parsed(image: Column, floats: bool = False) -> Column:
    """A camera's picture as an image: channels first becomes last; floats in [0, 1] (FLOAT_IMAGE) become bytes, cut to whole numbers."""

    @F.pandas_udf(IMAGE)
    def run(images: pd.DataFrame) -> pd.DataFrame:
        made = []
        for at, a in _stacks(images, np.float32 if floats else np.uint8):
            a = (255 * a).astype(np.uint8) if floats else a
            made.append((at, a.transpose(0, 2, 3, 1) if a.shape[1] == 3 and a.shape[3] != 3 else a))
        return _from_stacks(len(images), made)

    return F.when(image.isNotNull(), run(image))


def black_like(image: Column) -> Column:
    """An image of zeros of another one's size."""
    size = image["height"] * image["width"] * image["channels"]
    return F.struct(image["height"].alias("height"), image["width"].alias("width"), image["channels"].alias("channels"), F.unhex(F.repeat(F.lit("00"), size)).alias("data"))


def floats_map(views: Column) -> Column:
    """A map's images as FLOAT_IMAGEs in [-1, 1]."""

    @F.pandas_udf(f"array<{FLOAT_IMAGE}>")
    def run(values: pd.Series) -> pd.Series:
        one = lambda r: None if r is None or r["data"] is None else {**r, "data": np.frombuffer(r["data"], np.uint8).astype(np.float32) / 255 * 2 - 1}
        return pd.Series([None if v is None else [one(r) for r in v] for v in values], dtype=object)

    return F.map_from_arrays(F.map_keys(views), run(F.map_values(views)))


def augment(a: np.ndarray, rng: np.random.Generator, wrist: bool) -> np.ndarray:
    """A random crop of 95 %, resized back, and a turn of up to 5 degrees, but for wrist views; and brightness, contrast, saturation."""
    h, w = a.shape[:2]
    x = a.astype(np.float64) / 255
    if not wrist:
        ch, cw = max(1, int(h * 0.95)), max(1, int(w * 0.95))
        y0, x0 = rng.integers(0, h - ch + 1), rng.integers(0, w - cw + 1)
        x = resize(x[y0 : y0 + ch, x0 : x0 + cw], h, w, antialias=False)
        t = np.deg2rad(rng.uniform(-5, 5))
        yy, xx = np.mgrid[0:h, 0:w]
        cy, cx = (h - 1) / 2, (w - 1) / 2
        sy = np.rint(cy + (yy - cy) * np.cos(t) - (xx - cx) * np.sin(t)).astype(int)
        sx = np.rint(cx + (yy - cy) * np.sin(t) + (xx - cx) * np.cos(t)).astype(int)
        inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
        x = np.where(inside[:, :, None], x[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 0)
    x = x * (1 + rng.uniform(-0.3, 0.3))
    mean = x.mean()
    x = (x - mean) * (1 + rng.uniform(-0.4, 0.4)) + mean
    grey = x.mean(2, keepdims=True)
    x = (x - grey) * (1 + rng.uniform(-0.5, 0.5)) + grey
    return np.clip(np.rint(x * 255), 0, 255).astype(np.uint8)


def augmented(image: Column, key: Column, wrist: bool = False, seed: int = 0) -> Column:
    """A row's own draw, from its key and the seed."""

    @F.pandas_udf(IMAGE)
    def run(images: pd.DataFrame, keys: pd.Series) -> pd.DataFrame:
        rows = [to_row(augment(to_array(r), np.random.default_rng([seed, abs(int(k))]), wrist)) for r, k in zip(images.to_dict("records"), keys, strict=True)]
        return pd.DataFrame(rows, columns=["height", "width", "channels", "data"])

    return run(image, F.xxhash64(key))


def constant(height: int, width: int, channels: int = 3, value: int = 0) -> Column:
    """An image of one value, as a literal."""
    return F.struct(F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(channels).alias("channels"), F.lit(bytes([value]) * (height * width * channels)).alias("data"))


def or_black(image: Column, height: int, width: int) -> tuple[Column, Column]:
    """(the image or a black one, whether there is one)."""
    return F.coalesce(image, constant(height, width)), image.isNotNull()


def resized_map(views: Column, height: int, width: int) -> Column:
    """Every image of a map resized, in one pass of Python over the map."""

    @F.pandas_udf(f"array<{IMAGE}>")
    def run(values: pd.Series) -> pd.Series:
        # the views of all rows as one batch, and the rows again
        counts = [-1 if v is None else len(v) for v in values]
        fields = ["height", "width", "channels", "data"]
        flat = pd.DataFrame([[None] * 4 if r is None else [r[f] for f in fields] for v in values if v is not None for r in v], columns=fields)
        made = _from_stacks(len(flat), ((at, resize_with_pad(a, height, width)) for at, a in _stacks(flat))).astype(object)
        rows = [None if r["data"] is None else r for r in made.where(made.notna(), None).to_dict("records")]
        out, at = [], 0
        for n in counts:
            out.append(None if n < 0 else rows[at : at + n])
            at += max(n, 0)
        return pd.Series(out, dtype=object)

    return F.map_from_arrays(F.map_keys(views), run(F.map_values(views)))


def with_masks(views: Column, masks: Column | None) -> Column:
    """A map's masks; without any all views count."""
    every = F.transform_values(views, lambda _, v: F.lit(True))
    return every if masks is None else F.coalesce(masks, every)
