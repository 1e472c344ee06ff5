"""Images as arrays of numbers, row by row: built-in expressions only. ``w`` and ``h`` are plain numbers (a column's fixed shape)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _build(n: int, value: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value)


def pick(image: Column, w: int, h: int, at: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A ``w`` x ``h`` image whose pixel (x, y) is the source's at ``at(x, y)`` = (index, width of source)."""
    return let(image, lambda m: _build(w * h, lambda i: F.get(m, at((i % w).cast("int"), F.floor(i / w).cast("int"))[0].cast("int"))))


def hflip(image: Column, w: int, h: int) -> Column:
    return pick(image, w, h, lambda x, y: (y * w + (w - 1 - x), x))


def vflip(image: Column, w: int, h: int) -> Column:
    return pick(image, w, h, lambda x, y: ((h - 1 - y) * w + x, x))


def transpose(image: Column, w: int, h: int) -> Column:
    """An ``h`` x ``w`` image with rows and columns swapped."""
    return pick(image, h, w, lambda x, y: (x * w + y, x))


def pad(image: Column, w: int, h: int, width: int, height: int, value: float = 0.0) -> Column:
    """Top-left on a larger canvas; the image must fit."""
    if width < w or height < h:
        raise ValueError("the image does not fit the canvas")
    inside = lambda i: (i % width < w) & (F.floor(i / width) < h)
    return let(image, lambda m: _build(width * height, lambda i: F.when(inside(i), F.get(m, (F.floor(i / width) * w + i % width).cast("int"))).otherwise(F.lit(value))))


def crop(image: Column, w: int, x: int, y: int, width: int, height: int) -> Column:
    return pick(image, width, height, lambda a, b: ((b + y) * w + a + x, a))


def normalize(image: Column, mean: list[float], std: list[float]) -> Column:
    """Subtracts the mean and divides by the deviation of each channel (pixels hold their channels side by side)."""
    c = max(len(mean), len(std))
    of = lambda v, i, d: F.element_at(F.array(*[F.lit(float(x)) for x in (v or [d])]), (i % max(1, len(v or [d])) + 1).cast("int"))
    return F.transform(image, lambda v, i: (v.cast("double") - of(mean, i % c, 0.0)) / of(std, i % c, 1.0))


def add(image: Column, delta: Column) -> Column:
    return F.transform(image, lambda v: v.cast("double") + delta)


def invert(image: Column) -> Column:
    return F.transform(image, lambda v: F.lit(255) - v.cast("double"))


def mask(n: int, value: float = 1.0) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def erode(image: Column, w: int, h: int, radius: int, border: float = 1.0) -> Column:
    """Least value in a square of ``radius`` around each pixel, along rows and then along columns; outside the image the border counts."""
    def along(source: Column, place: Callable[[Column], Column], step: int, n: int) -> Column:
        def value(i: Column) -> Column:
            at = place(i)
            seen = [F.when((at + d >= 0) & (at + d < n), F.get(source, (i + d * step).cast("int")).cast("double")).otherwise(F.lit(border)) for d in range(-radius, radius + 1)]
            return F.least(*seen) if radius else seen[0]

        return _build(w * h, value)

    return let(let(image, lambda m: along(m, lambda i: i % w, 1, w)), lambda rows: along(rows, lambda i: F.floor(i / w), w, h))


def foreground(image: Column, w: Column | int) -> Column:
    """Least and largest x and y of the pixels above 0; null without any."""
    at = F.filter(F.transform(image, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    xs, ys = F.transform(at, lambda i: (i % w).cast("int")), F.transform(at, lambda i: F.floor(i / w).cast("int"))
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def one_hot(label: Column, classes: int) -> Column:
    """``classes`` numbers; null for a label that is no class."""
    ok = (label == F.floor(label)) & (label >= 0) & (label < classes)
    return F.when(ok, F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, 1.0).otherwise(0.0)))


def planes(image: Column, pixels: int, channels: int, reverse: bool = False) -> Column:
    """Channels one after the other (NCHW) instead of side by side; ``reverse`` swaps BGR and RGB."""
    of = lambda c: (channels - 1 - c) if reverse else c
    return let(image, lambda m: _build(pixels * channels, lambda i: F.get(m, ((i % pixels) * channels + of(F.floor(i / pixels))).cast("int"))))


def fill(image: Column, n: int) -> Column:
    """Zeros where there is no image."""
    return F.coalesce(image, F.array_repeat(F.lit(0.0), n))


# Palettes, black first and then classes from 1 on, the triples as they stand.
TABLEAU20 = (
    (0, 0, 0),
    (31, 119, 180), (174, 199, 232), (255, 127, 14), (255, 187, 120), (44, 160, 44), (152, 223, 138), (214, 39, 40), (255, 152, 150), (148, 103, 189), (197, 176, 213),
    (140, 86, 75), (196, 156, 148), (227, 119, 194), (247, 182, 210), (127, 127, 127), (199, 199, 199), (188, 189, 34), (219, 219, 141), (23, 190, 207), (158, 218, 229),
)
TABLEAU20A = (
    (0, 0, 0),
    (188, 189, 34), (219, 219, 141), (23, 190, 207), (158, 218, 229), (44, 160, 44), (152, 223, 138), (214, 39, 40), (255, 152, 150), (31, 119, 180), (174, 199, 232),
    (255, 127, 14), (255, 187, 120), (227, 119, 194), (247, 182, 210), (127, 127, 127), (199, 199, 199), (148, 103, 189), (197, 176, 213), (140, 86, 75), (196, 156, 148),
)
PALETTES = {"tableau20": TABLEAU20, "tableau20a": TABLEAU20A}


def palette(label: Column, name: str = "tableau20") -> Column:
    """The palette's triple of a class; black for classes outside of it."""
    table = F.array(*[F.array(*[F.lit(v) for v in triple]) for triple in PALETTES[name]])
    return F.coalesce(F.get(table, label.cast("int")), F.array(F.lit(0), F.lit(0), F.lit(0)))


def window_mean(image: Column, w: int, x: Column, y: Column, width: Column, height: Column) -> Column:
    """Mean of the pixels of a window inside an image."""
    inside = F.filter(image, lambda v, i: (i % w >= x) & (i % w < x + width) & (F.floor(i / w) >= y) & (F.floor(i / w) < y + height))
    return F.aggregate(inside, F.lit(0.0), lambda a, v: a + v.cast("double")) / (width * height)
