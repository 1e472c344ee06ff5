"""Size and offset arithmetic of geometric transforms (whole numbers, division towards zero)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Whole division of numbers that are not negative."""
    return F.floor(a / b).cast("long")


def resize(w: Column, h: Column, max_size: int = 2**31 - 1, min_size: int = 0) -> tuple[Column, Column]:
    """Shrinks so that the long side is at most ``max_size``; else grows so that the short side is at least ``min_size``."""
    most, least = F.greatest(w, h), F.least(w, h)
    scaled = lambda v: F.when(most > max_size, div(v * max_size, most)).when(least < min_size, div(v * min_size, least)).otherwise(v.cast("long"))
    return scaled(w), scaled(h)


def limit(w: Column, h: Column, most: int, least: int) -> tuple[Column, Column]:
    """First the long side down to ``most``, then the short side up to ``least``."""
    first = lambda v: F.when(F.greatest(w, h) > most, div(v * most, F.greatest(w, h))).otherwise(v.cast("long"))
    a, b = first(w), first(h)
    second = lambda v: F.when(F.least(a, b) < least, div(v * least, F.least(a, b))).otherwise(v)
    return second(a), second(b)


def import_limit(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """Bounds the short side, as imports do."""
    short = F.least(w, h)
    scaled = lambda v: F.when(short > most, div(v * most, short)).otherwise(v.cast("long"))
    return scaled(w), scaled(h)


def downsize(w: Column, h: Column, size: int) -> tuple[Column, Column]:
    """Shrinks so that both sides are at most ``size``."""
    return resize(w, h, max_size=size)


def clip_stages(p: str, s: Column, crop1: Column, crop2: Column, least: int, most: int, multiple: int, shift: Column, draw: Column) -> list[dict[str, Column]]:
    """Columns to add one dictionary after the other, each from those before, so that no expression is repeated inside another. Under names that begin with ``p``: the result's ``size`` on one axis, where the source window ``begin``s and its ``length``, where it lands (``to``), and what points ``move`` by.

    Crops both ends, keeps at least ``least`` and at most ``most`` (0: any), rounds down to ``multiple``, shifts the
    window; ``draw`` (0 without perturbation) places it where it is smaller or larger.
    """
    c = lambda name: F.col(p + name)
    inner = c("grown") - c("c1") - c("c2")
    cut = F.when((F.lit(most) > 0) & (inner > most), most + c("c1") + c("c2")).otherwise(c("grown"))
    stages = [
        {"grown": F.greatest(s, F.lit(least)).cast("long")},
        {"lack": F.greatest(crop1 + crop2 - (c("grown") - least), F.lit(0))},
        {"give": F.least(crop2, c("lack") - F.least(crop1, div(c("lack"), 2)))},  # what one crop cannot give back, the other does
        {"c1": crop1 - (c("lack") - c("give")), "c2": crop2 - c("give")},
        {"whole": cut - c("c1") - c("c2")},
        {"size": c("whole") - c("whole") % multiple if multiple else c("whole"), "at": c("c1") + F.greatest(shift, F.lit(0)), "left": F.greatest(s - c("c1") - c("c2") - F.greatest(shift, F.lit(0)), F.lit(0)), "to0": F.greatest(-shift, F.lit(0))},
        {"room": F.greatest(c("size") - c("to0"), F.lit(0))},
        {"pad": F.greatest(c("room") - c("left"), F.lit(0)), "cut": F.greatest(c("left") - c("room"), F.lit(0))},
        {
            "to": F.when((c("pad") > 0) & (c("at") == 0), c("to0") + draw % F.greatest(c("pad"), F.lit(1))).otherwise(c("to0")),
            "begin": F.when((c("cut") > 0) & (c("to0") == 0), c("at") + draw % F.greatest(c("cut"), F.lit(1))).otherwise(c("at")),
            "length": F.least(c("left"), c("room")),
        },
        {"move": c("to") - c("begin")},
    ]
    return [{p + k: v for k, v in stage.items()} for stage in stages]


def clip_axis(rows: DataFrame, p: str, *axis) -> DataFrame:
    """Adds the columns of ``clip_stages``."""
    for stage in clip_stages(p, *axis):
        rows = rows.withColumns(stage)
    return rows


def square_window(s: Column, target: int, draw: Column | None = None) -> tuple[Column, Column]:
    """Offset of a window of ``target`` in an axis of ``s``, and padding where the axis is shorter; ``draw`` None centres."""
    off = div(s - target, 2) if draw is None else draw % F.greatest(s - target + 1, F.lit(1))
    pad = div(target - s, 2) if draw is None else draw % F.greatest(target - s + 1, F.lit(1))
    return F.when(s >= target, off).otherwise(0).cast("long"), F.when(s < target, pad).otherwise(0).cast("long")


def clip_square(w: Column, h: Column, shift: Column) -> tuple[Column, Column, Column]:
    """Side of the centred square, and its offset on each axis after a shift of the long one."""
    side = F.least(w, h)
    off = lambda v: F.when(v > side, F.greatest(F.lit(0), F.least(div(v - side, 2) + shift, v - side))).otherwise(0)
    return side.cast("long"), off(w).cast("long"), off(h).cast("long")


def round_size(s: Column, divisor: int, remainder: int) -> Column:
    """The largest size of at most ``s`` that is ``remainder`` modulo ``divisor``."""
    v = div(s, divisor) * divisor + remainder
    return F.when(v > s, v - divisor).otherwise(v)


def grid(size: Column, patch: int, step: int) -> tuple[Column, Column]:
    """How many tiles of ``patch`` cover an axis, and the even step between them; the last tile ends at the edge."""
    span = F.greatest(size - patch, F.lit(0))
    n = F.ceil(span / step).cast("long")
    even = F.when(n > 0, step - div(n * step - span, F.greatest(n, F.lit(1)))).otherwise(step)
    return n + 1, even.cast("long")


def annotation_zoom(w: Column, h: Column, x: Column, y: Column, bw: Column, bh: Column, ratio: float) -> Column:
    """Window (x, y, w, h in pixels) about a box of an area below ``ratio`` of the image, so that it fills that share; else the whole image."""
    rate = F.sqrt(bw * bh / (ratio * w * h))
    ww, wh = F.round(w * rate).cast("long"), F.round(h * rate).cast("long")
    at = lambda o, b, v, full: F.greatest(F.lit(0), F.least(F.floor(o - F.floor((v - b) / 2)), full - v)).cast("long")
    small = (bw * bh > 0) & (bw * bh < ratio * w * h)
    pick = lambda a, b: F.when(small, a).otherwise(b).cast("long")
    return F.struct(pick(at(x, bw, ww, w), F.lit(0)).alias("x"), pick(at(y, bh, wh, h), F.lit(0)).alias("y"), pick(ww, w).alias("w"), pick(wh, h).alias("h"))


def pyramid(w: Column, h: Column, count: int, rate: float) -> Column:
    """Sizes of ``count`` smaller copies, each ``rate`` of the one before, not rounded in between."""
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.struct(F.floor(w * F.pow(F.lit(rate), i)).cast("long").alias("w"), F.floor(h * F.pow(F.lit(rate), i)).cast("long").alias("h")))
