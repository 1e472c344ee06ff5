"""Geometry of annotated shapes as column expressions. Coordinates are fractions of the image unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplery.functions.images import let

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
#: What annotation JSON may hold; other keys are ignored.
ANNOTATION = T.StructType([T.StructField("shapes", T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("tag", T.DoubleType()),
    T.StructField("geometry", T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "width", "height", "w", "h", "a")] + [T.StructField("points", T.StringType())])),
])))])


def parse_annotation(text: Column) -> Column:
    """``shapes`` of an annotation's JSON; null where the text isn't JSON or is empty."""
    return F.from_json(text, ANNOTATION)["shapes"]


def controls_of(shape: Column, width: Column, height: Column) -> Column:
    """A parsed shape's points in pixels: all but ``arect`` are given as fractions of the image. An unknown type is an error."""
    g = shape["geometry"]
    scaled = lambda p: point(p["x"] * width, p["y"] * height)
    one = F.from_json(g["points"], T.ArrayType(POINT))
    many = F.flatten(F.from_json(g["points"], T.ArrayType(T.ArrayType(POINT))))
    box = rect_controls(g["x"] * width, g["y"] * height, g["width"] * width, g["height"] * height)
    of = F.when(shape["type"].isin("rect", "ellipse"), box).when(shape["type"] == "point", F.array(scaled(g)))
    of = of.when(shape["type"] == "arect", arect_controls(g["x"], g["y"], g["w"], g["h"], g["a"]))
    of = of.when(shape["type"] == "polygon", F.transform(one, scaled)).when(shape["type"] == "polygons", F.transform(many, scaled))
    return of.otherwise(F.raise_error(F.concat(F.lit("unknown shape type "), F.coalesce(shape["type"], F.lit("null")))).cast(T.ArrayType(POINT)))


def rings_of(shape: Column) -> Column:
    """How many points each ring of a ``polygons`` shape has; null for other shapes."""
    many = F.from_json(shape["geometry"]["points"], T.ArrayType(T.ArrayType(POINT)))
    return F.when(shape["type"] == "polygons", F.transform(many, F.size))


def shapes_of(text: Column, width: Column, height: Column) -> Column:
    """An annotation's shapes as transforms take them: type, label, tag, controls in pixels and rings; none for a text that is no annotation."""
    made = lambda s: F.struct(s["type"].alias("type"), s["label"].alias("label"), F.coalesce(s["tag"], F.lit(0.0)).alias("tag"), controls_of(s, width, height).alias("controls"), rings_of(s).alias("rings"))
    return let(parse_annotation(text), lambda own: F.transform(F.coalesce(own, F.from_json(F.lit('{"shapes":[]}'), ANNOTATION)["shapes"]), made))


def label_channels(label: Column) -> Column:
    """A number fills 4 channels, a list its own and zeros, nothing ones."""
    many = F.from_json(label, T.ArrayType(T.DoubleType()))
    one = label.try_cast("double")
    return F.when(label.isNull(), F.array(*[F.lit(1.0)] * 4)).when(one.isNotNull(), F.array(*[one] * 4)).otherwise(F.slice(F.concat(many, F.array(*[F.lit(0.0)] * 4)), 1, 4))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def rect_controls(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Two opposite corners, then the two others."""
    return F.array(point(x, y), point(x + w, y + h), point(x + w, y), point(x, y + h))


def arect_controls(x: Column, y: Column, w: Column, h: Column, angle: Column) -> Column:
    """Middles of the four sides of a rectangle in pixels, turned by ``angle`` radians about its centre."""
    c, s = F.cos(angle), F.sin(angle)
    return F.array(*[point(x + c * dx - s * dy, y + s * dx + c * dy) for dx, dy in ((w / 2, F.lit(0.0)), (F.lit(0.0), h / 2), (-w / 2, F.lit(0.0)), (F.lit(0.0), -h / 2))])


def bbox(controls: Column) -> Column:
    """Smallest upright box of the points: x, y, w, h."""
    xs, ys = F.transform(controls, lambda p: p["x"]), F.transform(controls, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def move(controls: Column, dx: Column, dy: Column) -> Column:
    return F.transform(controls, lambda p: point(p["x"] + dx, p["y"] + dy))


def flip(controls: Column, width: Column, height: Column, horizontal: Column, vertical: Column, transpose: Column) -> Column:
    """Flips in a ``width`` x ``height`` frame, then swaps the axes."""
    x = lambda p: F.when(horizontal, width - p["x"]).otherwise(p["x"])
    y = lambda p: F.when(vertical, height - p["y"]).otherwise(p["y"])
    return F.transform(controls, lambda p: point(F.when(transpose, y(p)).otherwise(x(p)), F.when(transpose, x(p)).otherwise(y(p))))


def rotate(controls: Column, width: Column, height: Column, degrees: Column) -> Column:
    """Turns points in pixels about (width div 2, height div 2); the frame keeps its size."""
    a, b = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    cx, cy = F.floor(width / 2), F.floor(height / 2)
    return F.transform(controls, lambda p: point(a * p["x"] + b * p["y"] + (1 - a) * cx - b * cy, a * p["y"] - b * p["x"] + b * cx + (1 - a) * cy))


def distance(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def refit_rect(controls: Column) -> Column:
    """After a transform: the upright rectangle about the points' box centre with the box's proportions and the moved rectangle's area."""
    def refit(c: Column) -> Column:
        p = [c[k] for k in range(4)]
        lo, hi = ([f(*[q[k] for q in p]) for k in "xy"] for f in (F.least, F.greatest))
        area = distance(p[2], p[0]) * distance(p[3], p[0])
        sides = F.struct(*[v.alias(n) for n, v in (("x", lo[0]), ("y", lo[1]), ("w", hi[0] - lo[0]), ("h", hi[1] - lo[1]), ("a", area))])
        return let(sides, rewritten)

    def rewritten(b: Column) -> Column:
        half = F.sqrt((b["a"] + 1) / (b["w"] * b["h"] + 1)) / 2
        return let(F.struct((b["x"] + b["w"] / 2).alias("x"), (b["y"] + b["h"] / 2).alias("y"), (b["w"] * half).alias("w"), (b["h"] * half).alias("h")), lambda m: rect_controls(m["x"] - m["w"], m["y"] - m["h"], m["w"] * 2, m["h"] * 2))

    return let(controls, refit)


def render_colour(tag: Column, serial: Column, colour: Column, use_tag: bool = False, use_serial: bool = False) -> Column:
    """What a shape is drawn with: its tag, else its serial, else its colour."""
    return tag if use_tag else serial.cast("double") if use_serial else colour
