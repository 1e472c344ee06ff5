"""Dataset operators: filter, split, merge, tiles and crops of annotated images."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplery.functions import images as I
from samplery.functions import shapes as S
from samplery.functions import sizes as Z


def keep(records: DataFrame, ids: DataFrame, on: str = "serial") -> DataFrame:
    """Rows whose position is in ``ids`` (one column of that name); ids may repeat."""
    return records.join(ids.select(on), on, "left_semi")


def exclude(records: DataFrame, ids: DataFrame, on: str = "serial") -> DataFrame:
    return records.join(ids.select(on), on, "left_anti")


def pick_labels(records: DataFrame, labels: Sequence[int]) -> DataFrame:
    return records.where(F.col("label").cast("int").isin(*labels))


def has_annotation(text: Column) -> Column:
    """Whether an annotation holds at least one shape."""
    return F.coalesce(F.size(S.parse_annotation(text)) > 0, F.lit(False))


def merge(parts: Sequence[DataFrame], label_by_input: bool = False, hide_annotation: bool = False) -> DataFrame:
    """All rows of all inputs in their order (``file``), duplicates kept; optionally the input's number as label, or only the first field."""
    out = []
    for k, p in enumerate(parts):
        p = p.withColumn("file", F.lit(k))
        if label_by_input:
            p = p.withColumn("label", F.lit(k).cast(p.schema["label"].dataType))
        if hide_annotation and "fields" in p.columns:
            p = p.withColumn("fields", F.slice("fields", 1, 1))
        out.append(p)
    return reduce(DataFrame.unionByName, out)


def duplicate(records: DataFrame, label2_groups: bool = False) -> DataFrame:
    """A copy, grouped by label2 if asked."""
    return records.withColumn("grp", F.col("label2").cast(records.schema["grp"].dataType)) if label2_groups else records


def grid_tiles(images: DataFrame, patch: int, step: int) -> DataFrame:
    """Tiles of each row (``width``, ``height``): ``tile_x``, ``tile_y``, ``tile_w``, ``tile_h``; the whole axis where it is shorter than ``patch``, and the last tile at the edge."""
    out = images
    for axis, size in (("x", "width"), ("y", "height")):
        n, even = Z.grid(F.col(size), patch, step)
        out = out.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        origin = F.least(F.col("__at") * even, F.greatest(F.col(size) - patch, F.lit(0)))
        out = out.withColumn(f"tile_{axis}", origin.cast("long")).withColumn("tile_w" if axis == "x" else "tile_h", F.least(F.col(size), F.lit(patch)).cast("long")).drop("__at")
    return out


def bright_tiles(tiles: DataFrame, width: int, floor: float, image: str = "image") -> DataFrame:
    """Tiles (``tile_x`` ... ``tile_h``) whose mean over their window of a one-channel image, an array ``width`` pixels wide, is at least ``floor``."""
    return tiles.where(I.window_mean(F.col(image), width, *[F.col(f"tile_{c}") for c in "xywh"]) >= floor)


def overlaps(x: Column, y: Column, w: Column, h: Column, tx: Column, ty: Column, tw: Column, th: Column) -> Column:
    """Whether two boxes share an area."""
    return (F.least(x + w, tx + tw) > F.greatest(x, tx)) & (F.least(y + h, ty + th) > F.greatest(y, ty))


def tile_shapes(tiles: DataFrame, boxes: DataFrame, image: str = "image") -> DataFrame:
    """Boxes (fractions) that overlap each tile of their image, zoomed to the tile and not cut at its edge (an equi-join by image, with the overlap as condition).

    Tiles were exploded, so their size estimate is far too low: the hint keeps them from being broadcast on it.
    """
    b = boxes.select(F.col(image).alias("__image"), "serial", "label", "x", "y", "w", "h")
    t = tiles.select(image, "width", "height", "tile_x", "tile_y", "tile_w", "tile_h").dropDuplicates()
    zx, zy, zw, zh = (F.col(a) / F.col(b_) for a, b_ in (("tile_x", "width"), ("tile_y", "height"), ("tile_w", "width"), ("tile_h", "height")))
    joined = t.hint("merge").join(b, (F.col(image) == F.col("__image")) & overlaps(*[F.col(c) for c in ("x", "y", "w", "h")], zx, zy, zw, zh))
    return joined.select(image, "tile_x", "tile_y", "serial", "label", ((F.col("x") - zx) / zw).alias("x"), ((F.col("y") - zy) / zh).alias("y"), (F.col("w") / zw).alias("w"), (F.col("h") / zh).alias("h"))


def rezoom(controls: Column, zx: Column, zy: Column, zw: Column, zh: Column) -> Column:
    """Points seen from a window: minus its origin, divided by its size."""
    return F.transform(controls, lambda p: S.point((p["x"] - zx) / zw, (p["y"] - zy) / zh))


def crop_boxes(boxes: DataFrame) -> DataFrame:
    """Each shape's box as a crop of its image in whole pixels inside it, with label 0; empty crops are left out."""
    x0, y0 = (F.greatest(F.floor(F.col(a) * F.col(s)), F.lit(0)).cast("long") for a, s in (("x", "width"), ("y", "height")))
    x1, y1 = (F.least(F.floor((F.col(a) + F.col(d)) * F.col(s)), F.col(s)).cast("long") for a, d, s in (("x", "w", "width"), ("y", "h", "height")))
    out = boxes.withColumn("crop_x", x0).withColumn("crop_y", y0).withColumn("crop_w", x1 - x0).withColumn("crop_h", y1 - y0).withColumn("label", F.lit(0))
    return out.where((F.col("crop_w") > 0) & (F.col("crop_h") > 0))


def region_patch(boxes: DataFrame, size: int, patch: int) -> DataFrame:
    """For each shape the scale at which the root of its area is ``size`` pixels, and the patch of at least ``patch`` around it, kept inside the scaled image."""
    scale = F.lit(float(size)) / F.sqrt(F.col("w") * F.col("h") * F.col("width") * F.col("height"))
    out = boxes.where("w > 0 and h > 0").withColumn("scale", scale)
    for o, d, s, p in (("x", "w", "width", "patch_x"), ("y", "h", "height", "patch_y")):
        full = F.round(F.col(s) * F.col("scale")).cast("long")
        at, own = F.floor(F.col(o) * full).cast("long"), F.floor(F.col(d) * full).cast("long")
        more = F.greatest(F.lit(patch) - own, F.lit(0))
        length = F.least(own + more, full)
        out = out.withColumn(p, F.greatest(F.lit(0), F.least(at - Z.div(more, 2), full - length)).cast("long")).withColumn(p.replace("patch_", "patch_w" if d == "w" else "patch_h").rstrip("xy"), length)
    return out


def point_to_ellipse(annotation: Column, width: Column, height: Column, radius: float) -> Column:
    """An annotation's JSON with each point shape turned into an ellipse of ``radius`` pixels about it; other shapes stay as they are."""
    keep_ = "array<struct<type:string,geometry:struct<x:double,y:double,width:double,height:double>>>"
    parsed = F.from_json(annotation, f"shapes {keep_}")["shapes"]
    rw, rh = F.lit(radius) / width, F.lit(radius) / height
    turned = lambda s: F.struct(F.lit("ellipse").alias("type"), F.struct((s["geometry"]["x"] - rw).alias("x"), (s["geometry"]["y"] - rh).alias("y"), (rw * 2).alias("width"), (rh * 2).alias("height")).alias("geometry"))
    return F.transform(parsed, lambda s: F.when(s["type"] == "point", turned(s)).otherwise(s))
