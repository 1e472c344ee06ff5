"""Pixel operators that neighbourhoods or warps make too heavy for expressions: Arrow batches of equally shaped images.

Own rules, stated per function: other image libraries round and sample differently.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from samplery.shipping import ship
from samplery.sources.records import decode_raw, encode_raw


def _apply(function: Callable[[np.ndarray], np.ndarray], spark: SparkSession) -> Callable[[Column], Column]:
    """A pandas UDF that runs ``function`` on a stack of images (n, pixels) of one length; null images stay null."""
    ship(spark)

    @F.pandas_udf("array<double>")
    def run(images: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(images)
        own = [(k, x) for k, x in enumerate(images) if x is not None]
        for n in {len(x) for _, x in own}:
            part = [(k, x) for k, x in own if len(x) == n]
            for (k, _), row in zip(part, function(np.stack([x for _, x in part]).astype(np.float64)), strict=True):
                out[k] = row
        return pd.Series(out)

    return run


def sample(images: np.ndarray, h: int, w: int, ys: np.ndarray, xs: np.ndarray, border: str = "replicate") -> np.ndarray:
    """Bilinear values of (n, h, w, c) at real coordinates; outside: nearest edge, mirrored without repeating the edge if ``border`` is reflect, or zero if constant."""
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    out = 0.0
    for dy in (0, 1):
        for dx in (0, 1):
            y, x = y0 + dy, x0 + dx
            weight = np.abs(1 - dy - (ys - y0)) * np.abs(1 - dx - (xs - x0))
            if border == "constant":
                weight = weight * ((y >= 0) & (y < h) & (x >= 0) & (x < w))
            out = out + images[:, _inside(y, h, border), _inside(x, w, border)] * weight[None, ..., None]
    return out


def _inside(at: np.ndarray, n: int, border: str) -> np.ndarray:
    """Places on an axis of ``n`` for places that may lie outside."""
    if border == "reflect":
        at = np.abs((at + n - 1) % max(1, 2 * n - 2) - (n - 1))
    return np.clip(at, 0, n - 1)


def window(image: np.ndarray, w: int, h: int, channels: int, dx: int, dy: int, width: int, height: int, border: str = "constant", value: float = 0.0) -> np.ndarray:
    """A ``width`` x ``height`` frame in which the image is moved by (dx, dy), as points move; what it does not cover follows the border."""
    y, x = (np.arange(height) - dy)[:, None], (np.arange(width) - dx)[None, :]
    got = image.reshape(h, w, channels)[_inside(y, h, border), _inside(x, w, border)]
    if border == "constant":
        got = np.where(((y >= 0) & (y < h) & (x >= 0) & (x < w))[..., None], got, value)
    return got


def flip(image: np.ndarray, w: int, h: int, channels: int, horizontal: bool, vertical: bool, transpose: bool) -> np.ndarray:
    """Flips, then swaps rows and columns."""
    got = image.reshape(h, w, channels)[:: -1 if vertical else 1, :: -1 if horizontal else 1]
    return got.transpose(1, 0, 2) if transpose else got


def resize(images: np.ndarray, w: int, h: int, width: int, height: int, channels: int = 1, nearest: bool = False) -> np.ndarray:
    """Nearest: source pixel floor(x * w / width). Linear: pixel centres at half pixels, edges replicated."""
    stack = images.reshape(len(images), h, w, channels)
    if nearest:
        got = stack[:, (np.arange(height) * h // height)[:, None], (np.arange(width) * w // width)[None, :]]
    else:
        ys, xs = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
        got = sample(stack, h, w, np.clip(ys, 0, h - 1)[:, None] + 0 * xs[None, :], np.clip(xs, 0, w - 1)[None, :] + 0 * ys[:, None])
    return got.reshape(len(images), -1)


def rotate(images: np.ndarray, w: int, h: int, degrees: float, channels: int = 1, border: str = "constant", nearest: bool = False) -> np.ndarray:
    """Turns about (w div 2, h div 2) as points turn; every target pixel samples its source point, linearly or at the nearest pixel (halves up)."""
    a, b = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = x - w // 2, y - h // 2
    ys, xs = b * dx + a * dy + h // 2, a * dx - b * dy + w // 2
    if nearest:  # the sum of tiny errors must not decide at a half
        ys, xs = (np.floor(np.round(v, 9) + 0.5) for v in (ys, xs))
    got = sample(images.reshape(len(images), h, w, channels), h, w, ys, xs, border)
    return got.reshape(len(images), -1)


def blur(images: np.ndarray, w: int, h: int, sigma: float, channels: int = 1, border: str = "reflect") -> np.ndarray:
    """Gaussian of an odd kernel of about 3 sigma, edges mirrored without repeating the edge pixel, replicated, or zero outside if ``border`` is constant."""
    size = int(round(3 * sigma))
    size += 1 - size % 2
    if size <= 1:
        return images
    at = np.arange(size) - size // 2
    kernel = np.exp(-at * at / (2 * sigma * sigma))
    kernel /= kernel.sum()
    stack = images.reshape(len(images), h, w, channels)
    for axis, n in ((1, h), (2, w)):
        place = np.arange(n)[:, None] + at[None, :]
        weight = np.where((place >= 0) & (place < n), kernel, 0.0) if border == "constant" else np.broadcast_to(kernel, place.shape)
        if border == "reflect":
            place = np.abs(place)
            place = np.where(place >= n, 2 * (n - 1) - place, place) if n > 1 else place * 0
        stack = (np.take(stack, np.clip(place, 0, n - 1).ravel(), axis).reshape(*stack.shape[:axis], n, size, *stack.shape[axis + 1 :]) * weight.reshape(n, size, *[1] * (3 - axis))).sum(axis=axis + 1)
    return stack.reshape(len(images), -1)


def fill_polygons(points: np.ndarray, w: int, h: int) -> np.ndarray:
    """(n, h, w) flags of the pixels whose centre lies inside each of n polygons of equally many points (even-odd rule)."""
    y, x = np.mgrid[0:h, 0:w] + 0.5
    inside = np.zeros((len(points), h, w), bool)
    for k in range(points.shape[1]):
        (x1, y1), (x2, y2) = (points[:, j].T[:, :, None, None] for j in (k, (k + 1) % points.shape[1]))
        rise = np.where(y1 == y2, 1.0, y2 - y1)
        inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / rise + x1)
    return inside


def fill(points: np.ndarray, w: int, h: int) -> tuple[slice, slice, np.ndarray]:
    """Rows and columns of a polygon's box inside of a ``w`` x ``h`` frame, and the flags of ``fill_polygons`` there."""
    (x0, y0), (x1, y1) = points.min(axis=0), points.max(axis=0)
    rows, cols = (slice(int(np.clip(np.floor(lo - 0.5), 0, n)), int(np.clip(np.ceil(hi + 0.5), 0, n))) for lo, hi, n in ((y0, y1, h), (x0, x1, w)))
    y, x = np.arange(rows.start, rows.stop)[:, None] + 0.5, np.arange(cols.start, cols.stop)[None, :] + 0.5
    inside = np.zeros((len(y), x.shape[1]), bool)
    ends = points.tolist()
    for (ax, ay), (bx, by) in zip(ends, [*ends[1:], ends[0]], strict=True):
        if ay != by:  # level edges cross no line of pixels
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return rows, cols, inside


def spans(points: np.ndarray, at: np.ndarray, w: int, h: int) -> np.ndarray:
    """Runs of pixels that polygons cover, as rows (polygon, y, first x, x after the last) in the polygons' order: polygon k has ``points[at[k]:at[k + 1]]``.

    A line of pixels is inside between each other pair of its crossings with edges, which all lines of all polygons of
    as many points are cut by together.
    """
    sizes = np.diff(at)
    found = []
    for n in np.unique(sizes[sizes > 0]):
        own = np.flatnonzero(sizes == n)
        p = points[at[own][:, None] + np.arange(n)]
        top, end = (np.clip(v, 0, h).astype(int) for v in (np.floor(p[..., 1].min(axis=1) - 0.5), np.ceil(p[..., 1].max(axis=1) + 0.5)))
        high = end - top
        of = np.repeat(np.arange(len(own)), high)
        y = np.arange(len(of)) - np.repeat(np.cumsum(high) - high, high) + top[of]
        a, b = p[of], np.roll(p, -1, axis=1)[of]
        line = y[:, None] + 0.5
        cut = (a[..., 1] > line) != (b[..., 1] > line)
        rise = np.where(cut, b[..., 1] - a[..., 1], 1.0)
        x = np.sort(np.where(cut, (b[..., 0] - a[..., 0]) * (line - a[..., 1]) / rise + a[..., 0], np.inf), axis=1)
        x = np.clip(np.ceil(x - 0.5), 0, w).astype(int)
        for k in range(0, n - 1, 2):
            some = x[:, k] < x[:, k + 1]
            found.append(np.stack([own[of[some]], y[some], x[some, k], x[some, k + 1]], axis=1))
    every = np.concatenate(found) if found else np.zeros((0, 4), int)
    return every[np.argsort(every[:, 0], kind="stable")]


def rasterize(spark: SparkSession, w: int, h: int) -> Callable[[Column, Column], Column]:
    """Draws polygons (arrays of pixel points, in order) with their values; later ones cover earlier ones. Null polygons give null."""
    ship(spark)

    @F.arrow_udf("array<double>")
    def run(polygons: pa.Array, values: pa.Array) -> pa.Array:
        shapes = polygons.values
        points = np.stack([shapes.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
        row_at, value_at = polygons.offsets.to_numpy(), values.offsets.to_numpy()
        first = int(row_at[0])
        row_of = np.repeat(np.arange(len(polygons)), np.diff(row_at))
        value = values.values.to_numpy(zero_copy_only=False)[value_at[row_of] + np.arange(len(row_of)) - (row_at[row_of] - first)]
        canvas = np.zeros(len(polygons) * h * w)
        shape, y, x0, x1 = spans(points, shapes.offsets.to_numpy()[first : first + len(row_of) + 1], w, h).T
        line = (row_of[shape] * h + y) * w
        for lo, hi, v in zip((line + x0).tolist(), (line + x1).tolist(), value[shape].tolist(), strict=True):
            canvas[lo:hi] = v
        return pa.ListArray.from_arrays(pa.array(np.arange(len(polygons) + 1, dtype=np.int32) * (h * w)), pa.array(canvas), mask=polygons.is_null())

    return run


def resizer(spark: SparkSession, w: int, h: int, width: int, height: int, nearest: bool = False) -> Callable[[Column], Column]:
    return _apply(lambda x: resize(x, w, h, width, height, nearest=nearest), spark)


def rotator(spark: SparkSession, w: int, h: int, degrees: float) -> Callable[[Column], Column]:
    return _apply(lambda x: rotate(x, w, h, degrees), spark)


def blurrer(spark: SparkSession, w: int, h: int, sigma: float) -> Callable[[Column], Column]:
    return _apply(lambda x: blur(x, w, h, sigma), spark)


def per_row(spark: SparkSession, function: Callable[[np.ndarray, int, int, int, list], np.ndarray]) -> Callable[..., Column]:
    """A pandas UDF of an image, its width and height and an array of numbers: ``function(pixels, w, h, channels, numbers)`` on one image of its own size at a time; null images stay null."""
    ship(spark)

    @F.pandas_udf("array<double>")
    def run(images: pd.Series, widths: pd.Series, heights: pd.Series, numbers: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = []
        for x, w, h, own in zip(images, widths, heights, numbers, strict=True):
            if x is None:
                out.append(None)
                continue
            w, h = int(w), int(h)
            if w * h < 1 or len(x) % (w * h):
                raise ValueError(f"{len(x)} numbers are no image of {w} x {h} pixels")
            out.append(np.asarray(function(np.asarray(x, np.float64), w, h, len(x) // (w * h), list(own)), np.float64).ravel())
        return pd.Series(out, dtype=object)

    return run


def raw_decoder(spark: SparkSession, channels: int = -1, dtype: str = "float32") -> Callable[[Column], Column]:
    """A pandas UDF of raw matrices' bytes: width, height, channels (1 and 3 turn into each other, -1: as they are) and pixels, in the range of ``dtype``; null for bytes that are no raw matrix."""
    ship(spark)

    @F.pandas_udf("width bigint, height bigint, channels int, data array<double>")
    def run(images: pd.Series) -> pd.DataFrame:
        rows = []
        for x in images:
            try:
                m = decode_raw(x or b"")
            except ValueError:
                rows.append((None, None, None, None))
                continue
            m = convert(m[..., None] if m.ndim == 2 else m, channels, dtype)
            rows.append((m.shape[1], m.shape[0], m.shape[2], m.ravel()))
        out = pd.DataFrame(rows, columns=["width", "height", "channels", "data"], dtype=object)
        return out.astype({"width": "Int64", "height": "Int64", "channels": "Int32"})

    return run


def raw_resizer(spark: SparkSession) -> Callable[[Column, Column, Column], Column]:
    """A pandas UDF of raw matrices' bytes, a width and a height: the matrix in that size, linearly, in its own type (whole ones rounded); null stays null."""
    ship(spark)

    @F.pandas_udf("binary")
    def run(images: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
        out: list[bytes | None] = []
        for x, w, h in zip(images, widths, heights, strict=True):
            if x is None:
                out.append(None)
                continue
            m, shape = decode_raw(x), (int(h), int(w))
            deep = m.shape[2] if m.ndim == 3 else 1
            new = resize(m.reshape(1, -1).astype(np.float64), m.shape[1], m.shape[0], shape[1], shape[0], deep).reshape(shape + m.shape[2:])
            if m.dtype.kind in "iu":
                ends = np.iinfo(m.dtype)
                new = np.clip(np.rint(new), ends.min, ends.max)
            out.append(encode_raw(new.astype(m.dtype)))
        return pd.Series(out, dtype=object)

    return run


def fitter(spark: SparkSession, dtype: str) -> Callable[..., Column]:
    """A pandas UDF of an image's pixels, width and height and a shape: the image in that width, height and channels, in the range of ``dtype``; null stays null."""
    ship(spark)

    @F.pandas_udf("array<double>")
    def run(images: pd.Series, ws: pd.Series, hs: pd.Series, widths: pd.Series, heights: pd.Series, channels: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = []
        for x, w, h, *shape in zip(images, ws, hs, widths, heights, channels, strict=True):
            if x is None:
                out.append(None)
                continue
            w, h, width, height, deep = (int(v) for v in (w, h, *shape))
            own = np.asarray(x, np.float64).reshape(h, w, -1)
            if (w, h) != (width, height):
                own = resize(own.reshape(1, -1), w, h, width, height, own.shape[2]).reshape(height, width, -1)
            out.append(convert(own, deep, dtype).ravel())
        return pd.Series(out, dtype=object)

    return run


# Fixed values of the PNG format: its signature, and the colour type of 1, 3 and 4 channels.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_COLOURS = {1: 0, 3: 2, 4: 6}


def encode_png(image: np.ndarray) -> bytes:
    """A matrix (rows, columns, channels) as a PNG of 8 bits: grey, or blue, green, red and opacity; values are rounded and stop at 0 and 255."""
    h, w, channels = image.shape
    if channels not in PNG_COLOURS or not h or not w:
        raise ValueError(f"no PNG has {w} x {h} pixels of {channels} channels")
    own = np.clip(np.rint(image), 0, 255).astype(np.uint8)
    own = own[..., [2, 1, 0, 3][:channels]] if channels > 1 else own
    lines = np.concatenate([np.zeros((h, 1), np.uint8), own.reshape(h, -1)], axis=1)  # each line without a filter

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, PNG_COLOURS[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def png_encoder(spark: SparkSession) -> Callable[[Column, Column, Column], Column]:
    """A pandas UDF of an image's pixels, width and height: the image as a PNG (see ``encode_png``); null stays null."""
    ship(spark)

    @F.pandas_udf("binary")
    def run(images: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else encode_png(np.asarray(x, np.float64).reshape(int(h), int(w), -1)) for x, w, h in zip(images, widths, heights, strict=True)], dtype=object)

    return run


def convert(image: np.ndarray, channels: int, dtype: str) -> np.ndarray:
    """(h, w, c) numbers with so many channels, rounded and cut to the range of a whole type."""
    image = image.astype(np.float64)
    deep = image.shape[2]
    if channels == 1 and deep >= 3:
        image = (image[..., :3] @ np.array([0.114, 0.587, 0.299]))[..., None]
    elif channels == 3 and deep == 1:
        image = np.repeat(image, 3, axis=2)
    elif channels == 3 and deep == 4:
        image = image[..., :3]
    elif channels not in (-1, deep):
        raise ValueError(f"an image of {deep} channels has no form of {channels}")
    if dtype == "float32":
        return image
    ends = np.iinfo(dtype)
    return np.clip(np.rint(image), ends.min, ends.max)


def as_dtype(values: np.ndarray, dtype: str) -> np.ndarray:
    """Whole types round to the nearest and stop at their ends."""
    if dtype == "float32":
        return values.astype(np.float32)
    ends = np.iinfo(dtype)
    return np.clip(np.rint(values), ends.min, ends.max).astype(dtype)


def erode(image: np.ndarray, w: int, h: int, channels: int, radius: int, iterations: int = 1, border: str = "constant") -> np.ndarray:
    """Least value in a square, ``iterations`` times; outside counts 1, or nothing but the mirrored or repeated pixels."""
    reach = radius * iterations
    stack = np.pad(image.reshape(h, w, channels), ((reach, reach), (reach, reach), (0, 0)), constant_values=1.0 if border == "constant" else np.inf)
    stack = np.lib.stride_tricks.sliding_window_view(stack, 2 * reach + 1, axis=0).min(axis=-1)
    return np.lib.stride_tricks.sliding_window_view(stack, 2 * reach + 1, axis=1).min(axis=-1)


def draw(canvas: np.ndarray, w: int, h: int, kind: str, points: np.ndarray, colour: np.ndarray, thickness: int = -1, rings: list[int] | None = None) -> None:
    """Draws a shape of annotated images on (h, w, channels): filled as ``fill_polygons`` does, or its outline of ``thickness`` pixels; points are discs of 5 pixels, ellipses fill their box."""
    y, x = np.mgrid[0:h, 0:w] + 0.5
    if kind == "point":
        far = np.hypot(x - 0.5 - np.round(points[0, 0]), y - 0.5 - np.round(points[0, 1]))
        canvas[far <= 5 if thickness < 0 else np.abs(far - 5) <= thickness / 2] = colour
        return
    if kind == "ellipse":
        mid, half = (points.min(axis=0) + points.max(axis=0)) / 2, np.ptp(points, axis=0) / 2
        inside = lambda more: (half + more > 0).all() & (((x - mid[0]) / np.maximum(half[0] + more, 1e-12)) ** 2 + ((y - mid[1]) / np.maximum(half[1] + more, 1e-12)) ** 2 <= 1)
        canvas[inside(0) if thickness < 0 else inside(thickness / 2) & ~inside(-thickness / 2)] = colour
        return
    if kind == "rect":
        points = points[[0, 2, 1, 3]]
    elif kind == "arect":  # from middles of sides to corners
        points = points + np.roll(points, -1, axis=0) - (points[0] + points[2]) / 2
    elif kind not in ("polygon", "polygons"):
        raise ValueError(f"shapes of type {kind} cannot be drawn")
    parts = np.split(points, np.cumsum(rings)[:-1]) if rings is not None and len(rings) else [points]
    on = np.zeros((h, w), bool)
    for p in parts:
        if thickness < 0:
            rows, cols, inside = fill(p, w, h)
            on[rows, cols] ^= inside
            continue
        for a, b in zip(p, np.roll(p, -1, axis=0), strict=True):
            d = b - a
            t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / max(float(d @ d), 1e-12), 0, 1)
            on |= np.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1]) <= thickness / 2
    canvas[on] = colour


def keypoint_maps(spark: SparkSession, classes: int, downsize: int, radius: float) -> Callable[..., Column]:
    """A pandas UDF of width, height and shapes' labels (from 1) and controls: per cell and class 1 and the offset (x, y) to a point within ``radius`` pixels, else zeros; later points overwrite."""
    ship(spark)

    @F.pandas_udf("array<double>")
    def run(widths: pd.Series, heights: pd.Series, labels: pd.Series, controls: pd.Series) -> pd.Series:
        out = []
        for w, h, own, shapes in zip(widths, heights, labels, controls, strict=True):
            if w is None or w != w:
                out.append(None)
                continue
            w, h = int(w), int(h)
            y, x = np.mgrid[0 : h // downsize, 0 : w // downsize] * downsize
            maps = np.zeros((*y.shape, classes, 3))
            for label, points in zip(() if own is None else own, () if shapes is None else shapes, strict=True):
                if label is None or not 1 <= int(label) <= classes:
                    continue
                for p in points:
                    dx, dy = p["x"] - x, p["y"] - y
                    near = np.hypot(dx, dy) <= radius
                    maps[near, int(label) - 1] = np.stack([np.ones(int(near.sum())), dx[near], dy[near]], axis=1)
            out.append(np.r_[maps[..., 0].ravel(), maps[..., 1:].ravel()])
        return pd.Series(out, dtype=object)

    return run


# --- colour spaces of matrices (..., 3): the same rules as those of single pixels below


def hsv_of(image: np.ndarray) -> np.ndarray:
    """Hue in degrees, saturation and value, of blue, green and red in [0, 1]."""
    b, g, r = np.moveaxis(image, -1, 0)
    v = image.max(axis=-1)
    d = v - image.min(axis=-1)
    by = np.where(d == 0, 1.0, d)
    hue = np.select([d == 0, v == r, v == g], [0.0 * d, 60 * (g - b) / by, 120 + 60 * (b - r) / by], 240 + 60 * (r - g) / by)
    return np.stack([np.where(hue < 0, hue + 360, hue), np.where(v == 0, 0.0, d / np.where(v == 0, 1.0, v)), v], axis=-1)


def bgr_of_hsv(image: np.ndarray) -> np.ndarray:
    h, s, v = np.moveaxis(image, -1, 0)
    k = [(shift + h / 60) % 6 for shift in (1, 3, 5)]
    return np.stack([v - v * s * np.clip(np.minimum(x, 4 - x), 0, 1) for x in k], axis=-1)


def lab_of(image: np.ndarray) -> np.ndarray:
    """CIE L*, a*, b* (D65) of sRGB channels in [0, 1]."""
    b, g, r = np.moveaxis(np.where(image > 0.04045, ((np.maximum(image, 0) + 0.055) / 1.055) ** 2.4, image / 12.92), -1, 0)
    x, y, z = (0.412453 * r + 0.357580 * g + 0.180423 * b) / _WHITE[0], 0.212671 * r + 0.715160 * g + 0.072169 * b, (0.019334 * r + 0.119193 * g + 0.950227 * b) / _WHITE[2]
    fx, fy, fz = (np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116) for t in (x, y, z))
    return np.stack([np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y), 500 * (fx - fy), 200 * (fy - fz)], axis=-1)


def bgr_of_lab(image: np.ndarray) -> np.ndarray:
    l, a, b = np.moveaxis(image, -1, 0)  # noqa: E741
    dark = l <= 7.9996
    y = np.where(dark, l / 903.3, ((l + 16) / 116) ** 3)
    fy = np.where(dark, 7.787 * y + 16 / 116, (l + 16) / 116)
    x, z = (np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * white for f, white in ((fy + a / 500, _WHITE[0]), (fy - b / 200, _WHITE[2])))
    lines = np.stack([0.055648 * x - 0.204043 * y + 1.057311 * z, -0.969256 * x + 1.875991 * y + 0.041556 * z, 3.240479 * x - 1.537150 * y - 0.498535 * z], axis=-1)
    lines = np.clip(lines, 0, 1)
    return np.where(lines > 0.0031308, 1.055 * np.maximum(lines, 1e-12) ** (1 / 2.4) - 0.055, 12.92 * lines)


# --- colour spaces of single pixels: built-in expressions on (blue, green, red)


def grey(b: Column, g: Column, r: Column) -> Column:
    return 0.114 * b + 0.587 * g + 0.299 * r


def to_hsv(b: Column, g: Column, r: Column) -> Column:
    """Hue in degrees, saturation and value, of channels in [0, 1]."""
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    d = v - low
    hue = F.when(d == 0, 0.0).when(v == r, 60 * (g - b) / d).when(v == g, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - g) / d)
    return F.struct(F.when(hue < 0, hue + 360).otherwise(hue).alias("h"), F.when(v == 0, 0.0).otherwise(d / v).alias("s"), v.alias("v"))


def from_hsv(hsv: Column) -> Column:
    """Blue, green, red of hue, saturation and value."""
    def channel(shift: float) -> Column:
        k = F.pmod(F.lit(shift) + hsv["h"] / 60, F.lit(6.0))
        return hsv["v"] - hsv["v"] * hsv["s"] * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return F.struct(channel(1).alias("b"), channel(3).alias("g"), channel(5).alias("r"))


_WHITE = (0.950456, 1.0, 1.088754)


def to_lab(b: Column, g: Column, r: Column) -> Column:
    """CIE L*, a*, b* (D65) of sRGB channels in [0, 1]."""
    b, g, r = (F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92) for v in (b, g, r))
    curve = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    x = (0.412453 * r + 0.357580 * g + 0.180423 * b) / _WHITE[0]
    y = 0.212671 * r + 0.715160 * g + 0.072169 * b
    z = (0.019334 * r + 0.119193 * g + 0.950227 * b) / _WHITE[2]
    return F.struct(F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y).alias("l"), (500 * (curve(x) - curve(y))).alias("a"), (200 * (curve(y) - curve(z))).alias("b"))


def from_lab(lab: Column) -> Column:
    """Blue, green, red in [0, 1] of L*, a*, b*."""
    y = F.when(lab["l"] <= 7.9996, lab["l"] / 903.3).otherwise(F.pow((lab["l"] + 16) / 116, F.lit(3.0)))
    fy = F.when(lab["l"] <= 7.9996, 7.787 * y + 16 / 116).otherwise((lab["l"] + 16) / 116)
    back = lambda f: F.when(f > 0.206893, F.pow(f, F.lit(3.0))).otherwise((f - 16 / 116) / 7.787)
    x, z = back(fy + lab["a"] / 500) * _WHITE[0], back(fy - lab["b"] / 200) * _WHITE[2]
    curve = lambda v: F.when(v > 0.0031308, 1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * v)
    cut = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.struct(*[curve(cut(v)).alias(n) for n, v in (("b", 0.055648 * x - 0.204043 * y + 1.057311 * z), ("g", -0.969256 * x + 1.875991 * y + 0.041556 * z), ("r", 3.240479 * x - 1.537150 * y - 0.498535 * z))])
