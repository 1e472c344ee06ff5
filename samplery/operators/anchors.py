"""Training targets from annotated boxes: dense anchors, box features, key points, proposals and non-maximum suppression."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _covered(items: DataFrame, downsize: int, x: Column, y: Column, reach_x: Column, reach_y: Column) -> DataFrame:
    """Items (with their image's ``width`` and ``height``) once for each grid point (``cx``, ``cy`` in cells, ``px``, ``py`` in pixels) that may lie within their reach of (x, y)."""
    def span(mid: Column, reach: Column, size: str) -> Column:
        last = F.floor(F.col(size) / downsize) - 1
        lo = F.greatest(F.lit(0), F.floor((mid - reach) / downsize).cast("long"))
        hi = F.least(last, F.ceil((mid + reach) / downsize).cast("long"))
        return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi)))

    out = items.withColumn("cy", F.explode(span(y, reach_y, "height"))).withColumn("cx", F.explode(span(x, reach_x, "width")))
    return out.withColumn("px", (F.col("cx") * downsize).cast("double")).withColumn("py", (F.col("cy") * downsize).cast("double"))


def _score(b: Column, kind: str, priors: Sequence[tuple[float, float]], px: Column, py: Column, prior: Column) -> tuple[Column, list[Column], Column]:
    """Score, parameters and weight of a truth (a struct with the box in pixels: ``bx``, ``by``, ``bw``, ``bh``) at a cell."""
    dx, dy = b["bx"] + b["bw"] / 2 - px, b["by"] + b["bh"] / 2 - py
    far = F.sqrt(dx * dx + dy * dy)
    if kind == "point":
        return F.exp(-far), [dx, dy], F.lit(1.0)
    if kind == "circle":
        r = F.sqrt(b["bw"] * b["bh"]) / 2
        return (r - far) / r, [dx, dy, r], 1 / (r * r)
    if not priors:
        score = F.least((b["bw"] - 2 * F.abs(dx)) / b["bw"], (b["bh"] - 2 * F.abs(dy)) / b["bh"])
    else:
        pw, ph = (F.element_at(F.array(*[F.lit(float(p[k])) for p in priors]), prior + 1) for k in (0, 1))
        along = lambda d, x, y: F.greatest(F.lit(0.0), F.least(d + x / 2, y / 2) - F.greatest(d - x / 2, -y / 2))
        inter = along(dx, b["bw"], pw) * along(dy, b["bh"], ph)
        score = inter / (b["bw"] * b["bh"] + pw * ph - inter + 1e-5)
    return score, [dx, dy, b["bw"], b["bh"]], 1 / (b["bw"] * b["bh"])


def _best(own: Column | str, kind: str, lower: float, weighted: bool, priors: Sequence[tuple[float, float]], px: Column, py: Column, prior: Column) -> Column:
    """The truth with the largest score at a cell, the first of equal ones: score, parameters ``p`` and weight ``m``; null without any."""
    def candidate(b: Column) -> Column:
        score, params, weight = _score(b, kind, priors, px, py, prior)
        return F.when((score > 0) & (score >= lower), F.struct(score.alias("score"), (-b["serial"]).alias("s"), F.array(*params).alias("p"), (weight if weighted else F.lit(1.0)).alias("m")))

    return F.array_max(F.transform(own, candidate))


def anchor_arrays(own: Column, width: Column, height: Column, kind: str = "box", downsize: int = 1, upper: float = 0.6, lower: float = 0.4, weighted: bool = False, default: float = 0.0, priors: Sequence[tuple[float, float]] = ()) -> dict[str, tuple[Column, int]]:
    """``dense_anchors`` of one row's boxes (``serial``, ``bx``, ``by``, ``bw``, ``bh`` in pixels) as arrays by row, column and prior, each with its numbers a cell."""
    many, across = max(1, len(priors)), F.floor(width / downsize)
    count = across * F.floor(height / downsize) * many
    at = lambda i: (F.floor(i / many) % across * downsize, F.floor(i / many / across) * downsize, (i % many).cast("int"))
    each = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(count, F.lit(1))), lambda i: _best(own, kind, lower, weighted, priors, *at(i - 1)))
    cells_ = F.slice(each, F.lit(1), count.cast("int"))
    size = {"point": 2, "circle": 3}.get(kind, 4)
    none = F.array(*[F.lit(float(default))] * size)
    hit = lambda b: F.coalesce(b["score"] >= upper, F.lit(False))
    return {
        "label": (F.transform(cells_, lambda b: F.when(hit(b), 1.0).otherwise(0.0)), many),
        "label_mask": (F.transform(cells_, lambda b: F.when(b.isNotNull() & ~hit(b), 0.0).otherwise(1.0)), many),
        "params": (F.flatten(F.transform(cells_, lambda b: F.coalesce(b["p"], none))), many * size),
        "params_mask": (F.transform(cells_, lambda b: F.coalesce(b["m"], F.lit(0.0))), many),
    }


def dense_anchors(images: DataFrame, boxes: DataFrame, kind: str = "box", downsize: int = 1, upper: float = 0.6, lower: float = 0.4, weighted: bool = False, default: float = 0.0, priors: Sequence[tuple[float, float]] = ()) -> DataFrame:
    """Per cell and prior: ``label``, ``label_mask``, ``params`` and ``params_mask``.

    The truth of a cell is the box of its image with the largest score above 0, the first of equal ones. From
    ``lower`` on its parameters count (with weight 1, or by size if ``weighted``); from ``upper`` on the label is 1;
    between the two the label is masked out. A box meets only the cells that it can score on; the best box of each
    such cell is one aggregate, and the other cells follow from their image's size. ``images`` have different ids. Boxes
    without an area are left out, but for ``kind`` point, which takes (``x``, ``y``) alone.
    """
    many = max(1, len(priors))
    sized = images.select(F.col("image").alias("__i"), "width", "height")
    own = boxes.select("image", "serial", (F.col("x") * F.col("width")).alias("bx"), (F.col("y") * F.col("height")).alias("by"), (F.col("w") * F.col("width")).alias("bw"), (F.col("h") * F.col("height")).alias("bh"))
    if kind == "point":  # a point is (x, y) itself
        own = own.where("bx is not null and by is not null").withColumns({"bw": F.lit(0.0), "bh": F.lit(0.0)})
    else:
        own = own.where("bw > 0 and bh > 0")
    own = own.join(sized, F.col("image") == F.col("__i")).drop("__i")
    half = {"x": F.col("bw") / 2, "y": F.col("bh") / 2}
    if kind == "point":
        far = F.lit(-math.log(lower) if lower > 0 else float("inf"))
        reach = dict.fromkeys("xy", F.least(far, F.greatest("width", "height") + half["x"] + half["y"]))
    elif kind == "circle":
        reach = dict.fromkeys("xy", F.sqrt(F.col("bw") * F.col("bh")) / 2)
    else:
        reach = {c: half[c] + max((p[k] for p in priors), default=0.0) / 2 for k, c in enumerate("xy")}
    near = _covered(own, downsize, F.col("bx") + half["x"], F.col("by") + half["y"], reach["x"], reach["y"])
    if priors:
        near = near.withColumn("prior", F.explode(F.array(*[F.lit(k) for k in range(many)])))
    score, params, weight = _score(F.struct("bx", "by", "bw", "bh"), kind, priors, F.col("px"), F.col("py"), F.col("prior") if priors else F.lit(0))
    cell = (F.col("cy") * F.floor(F.col("width") / downsize) + F.col("cx")) * many + (F.col("prior") if priors else F.lit(0))
    near = near.select("image", cell.cast("int").alias("cell"), score.alias("score"), (-F.col("serial")).alias("s"), F.array(*params).alias("p"), (weight if weighted else F.lit(1.0)).alias("m"))
    near = near.where((F.col("score") > 0) & (F.col("score") >= lower))
    best = near.groupBy("image", "cell").agg(F.max(F.struct("score", "s", "p", "m")).alias("b")).groupBy(F.col("image").alias("__i")).agg(F.collect_list(F.struct("cell", "b.score", "b.p", "b.m")).alias("hits"))
    both = images.select("image", "width", "height").join(best, F.col("image") == F.col("__i"), "left").drop("__i")
    count = (F.floor(F.col("width") / downsize) * F.floor(F.col("height") / downsize) * many).cast("int")
    hit = both.select("image", "width", F.explode("hits").alias("h")).select("image", "width", F.col("h.cell").alias("cell"), F.when(F.col("h.score") >= upper, 1.0).otherwise(0.0).alias("label"), F.when(F.col("h.score") >= upper, 1.0).otherwise(0.0).alias("label_mask"), F.col("h.p").alias("params"), F.col("h.m").alias("params_mask"))
    every = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))
    rest = F.when(F.col("hits").isNull(), every).otherwise(F.array_except(every, F.transform("hits", lambda h: h["cell"])))
    none = F.array(*[F.lit(float(default))] * {"point": 2, "circle": 3}.get(kind, 4))
    miss = both.where(count > 0).select("image", "width", F.explode(rest).alias("cell")).select("image", "width", "cell", F.lit(0.0).alias("label"), F.lit(1.0).alias("label_mask"), none.alias("params"), F.lit(0.0).alias("params_mask"))
    across, at = F.floor(F.col("width") / downsize), F.floor(F.col("cell") / many)
    return hit.unionByName(miss).select("image", F.floor(at / across).alias("cy"), (at % across).alias("cx"), (F.col("cell") % many).alias("prior"), "label", "label_mask", "params", "params_mask")


def box_feature(boxes: DataFrame, min_area: float = 1.0) -> DataFrame:
    """Per box: label, tag, and corners clipped to the image's last pixels; boxes whose clipped area is below ``min_area`` go."""
    clip = lambda v, s: F.greatest(F.lit(0.0), F.least(v * F.col(s), F.col(s) - 1.0))
    out = boxes.select("image", "serial", F.col("label").cast("double").alias("label"), F.coalesce("tag", F.lit(0.0)).alias("tag") if "tag" in boxes.columns else F.lit(0.0).alias("tag"), clip(F.col("x"), "width").alias("x1"), clip(F.col("y"), "height").alias("y1"), clip(F.col("x") + F.col("w"), "width").alias("x2"), clip(F.col("y") + F.col("h"), "height").alias("y2"))
    return out.where((F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1) >= min_area)


def keypoints(images: DataFrame, points: DataFrame, classes: int, downsize: int, radius: float) -> DataFrame:
    """Per cell and class within ``radius`` pixels of a point (``image``, ``serial``, ``label`` from 1, ``kx``, ``ky`` in pixels): offset to it; later points overwrite.

    A point meets only the cells about it.
    """
    sized = images.select(F.col("image").alias("__i"), "width", "height")
    own = points.where(F.col("label").between(1, classes)).select("image", "serial", (F.col("label") - 1).cast("int").alias("class"), "kx", "ky")
    own = own.join(sized, F.col("image") == F.col("__i")).drop("__i")
    near = _covered(own, downsize, F.col("kx"), F.col("ky"), F.lit(float(radius)), F.lit(float(radius)))
    near = near.withColumn("dx", F.col("kx") - F.col("px")).withColumn("dy", F.col("ky") - F.col("py")).where(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) <= radius)
    last = near.groupBy("image", "cy", "cx", "class").agg(F.max(F.struct("serial", "dx", "dy")).alias("k"))
    return last.select("image", "cy", "cx", "class", F.lit(1.0).alias("mask"), F.col("k.dx").alias("dx"), F.col("k.dy").alias("dy"))


def decode_proposals(rows: DataFrame, threshold: float, upsize: int = 1) -> DataFrame:
    """Boxes of cells (``cx``, ``cy``, ``prob``, ``params`` = dx, dy, w, h) with enough chance: corners in pixels."""
    mx, my = F.col("cx") * upsize + F.col("params")[0], F.col("cy") * upsize + F.col("params")[1]
    w, h = F.col("params")[2], F.col("params")[3]
    return rows.where(F.col("prob") >= threshold).select("image", "cy", "cx", "prior", "prob", (mx - w / 2).alias("x1"), (my - h / 2).alias("y1"), (mx + w / 2).alias("x2"), (my + h / 2).alias("y2"))


def box_overlap(a: Column, b: Column) -> Column:
    inter = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda s: (s["x2"] - s["x1"]) * (s["y2"] - s["y1"])
    return inter / (area(a) + area(b) - inter + 1)


def circle_overlap(a: Column, b: Column) -> Column:
    r = F.greatest(a["r"], b["r"]) + 1
    return (r - F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))) / r


def suppress(proposals: DataFrame, threshold: float, circles: bool = False) -> DataFrame:
    """Greedy non-maximum suppression in each image, by falling ``prob`` (ties: row, column, prior): a kept shape removes later ones that overlap it by more than ``threshold``.

    Shapes are boxes (``x1``, ``y1``, ``x2``, ``y2``) or circles (``x``, ``y``, ``r``). The order makes it sequential
    within an image, so an image's proposals are folded as one sorted array, which the image's grid bounds.
    """
    overlap = circle_overlap if circles else box_overlap
    rest = [c for c in proposals.columns if c != "image"]
    item = F.struct((-F.col("prob")).alias("__order"), "cy", "cx", "prior", *[c for c in rest if c not in ("cy", "cx", "prior")])
    sorted_ = proposals.groupBy("image").agg(F.sort_array(F.collect_list(item)).alias("all"))
    none = F.slice("all", 1, 0)
    kept = F.aggregate("all", none, lambda done, s: F.when(F.exists(done, lambda k: overlap(k, s) > threshold), done).otherwise(F.concat(done, F.array(s))))
    return sorted_.select("image", F.explode(kept).alias("s")).select("image", *[F.col(f"s.{c}").alias(c) for c in rest]).select(*proposals.columns)


def feature_batch(features: DataFrame, plan: DataFrame, size: int) -> DataFrame:
    """Feature rows of a plan's images (``image``, ``draw``), with the batch and the image's place in it."""
    placed = plan.select(F.col("image").alias("__image"), F.floor(F.col("draw") / size).cast("long").alias("batch"), (F.col("draw") % size).cast("int").alias("place"))
    return features.join(placed, F.col("image") == F.col("__image")).drop("__image")
