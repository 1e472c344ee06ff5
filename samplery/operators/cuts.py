"""Records of cut images: crops of shapes, grid tiles and patches about shapes, each with its pixels and its annotation.

Which windows a record gives is a column, computed from its header and its annotation's points; one Arrow function then
reads each image once and gives out all its cuts. A cut of a scaled image samples its own window only, never the whole
scaled image.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplery.functions import images as I
from samplery.functions import pixels as P
from samplery.functions import shapes as S
from samplery.functions import sizes as Z
from samplery.shipping import map_arrow
from samplery.sources import records as R

#: A cut: the part of the source that is scaled (x, y, w, h), its size after that (fw, fh), and the window in it.
WINDOW = "struct<sx:bigint,sy:bigint,sw:bigint,sh:bigint,fw:bigint,fh:bigint,x:bigint,y:bigint,w:bigint,h:bigint>"
_NAMES = ("sx", "sy", "sw", "sh", "fw", "fh", "x", "y", "w", "h")
#: Cuts of an image: serial numbers of cuts are its serial times this, plus their place.
MOST_CUTS = 1 << 20
#: Bytes of cuts that a task holds before it gives them out.
HELD = 16 << 20


def _window(**parts: Column | int) -> Column:
    return F.struct(*[(parts[n] if isinstance(parts[n], Column) else F.lit(parts[n])).cast("long").alias(n) for n in _NAMES])


def _of(rows: DataFrame) -> DataFrame:
    """Records with ``__image``, ``__note`` (bytes), ``__w``, ``__h``, whether the note is JSON, and its shapes' boxes in pixels."""
    rows = rows.withColumns({"__image": R.field(F.col("fields"), 0), "__note": R.field(F.col("fields"), 1), "__type": R.field_type(F.col("fields"), 1)})
    size, text = R.raw_size(F.col("__image")), F.decode(F.col("__note"), "UTF-8")
    rows = rows.withColumns({"__w": size["width"], "__h": size["height"], "__json": F.when(F.col("__type") == R.NONE, R.sniff(text)).otherwise(F.col("__type")) == R.ANNOTATION_JSON})
    shapes = S.shapes_of(F.when(F.col("__json"), text), F.col("__w"), F.col("__h"))
    return rows.withColumn("__boxes", F.transform(shapes, lambda s: S.bbox(s["controls"])))


def _placed(part: np.ndarray, fw: int, fh: int, x: int, y: int, w: int, h: int, nearest: bool) -> np.ndarray:
    """The window (x, y, w, h) of ``part`` scaled to fw x fh, as resizing all of it would give."""
    rows, cols = part.shape[:2]
    if (fw, fh) == (cols, rows):
        return part[y : y + h, x : x + w]
    at_y, at_x = np.arange(y, y + h), np.arange(x, x + w)
    if nearest:
        return part[(at_y * rows // fh)[:, None], (at_x * cols // fw)[None, :]]
    ys, xs = np.clip((at_y + 0.5) * rows / fh - 0.5, 0, rows - 1), np.clip((at_x + 0.5) * cols / fw - 0.5, 0, cols - 1)
    got = P.sample(part.reshape(1, rows, cols, -1).astype(np.float64), rows, cols, ys[:, None] + 0 * xs[None, :], xs[None, :] + 0 * ys[:, None]).reshape(h, w, *part.shape[2:])
    if part.dtype.kind in "iu":
        ends = np.iinfo(part.dtype)
        got = np.clip(np.rint(got), ends.min, ends.max)
    return got.astype(part.dtype)


def _points(shape: dict) -> list[dict]:
    g = shape["geometry"]
    if shape["type"] == "polygon":
        return g["points"]
    return [p for ring in g["points"] for p in ring] if shape["type"] == "polygons" else [g]


def _box(shape: dict, width: int, height: int) -> tuple[float, float, float, float]:
    """A shape's upright box as fractions: x, y and the opposite corner."""
    g = shape["geometry"]
    if shape["type"] in ("rect", "ellipse"):
        return g["x"], g["y"], g["x"] + g["width"], g["y"] + g["height"]
    if shape["type"] == "arect":
        c, s = abs(np.cos(g["a"])), abs(np.sin(g["a"]))
        dx, dy = max(c * g["w"], s * g["h"]) / 2, max(s * g["w"], c * g["h"]) / 2
        return (g["x"] - dx) / width, (g["y"] - dy) / height, (g["x"] + dx) / width, (g["y"] + dy) / height
    xs, ys = [p["x"] for p in _points(shape)], [p["y"] for p in _points(shape)]
    return min(xs), min(ys), max(xs), max(ys)


def _zoomed(shapes: list[dict], width: int, height: int, fw: int, fh: int, x: int, y: int, w: int, h: int) -> str:
    """The shapes that share an area with the window, as seen from it; they are not cut at its edge."""
    zx, zy, zw, zh = x / fw, y / fh, w / fw, h / fh
    kept = []
    for s in shapes:
        x0, y0, x1, y1 = _box(s, width, height)
        if not (min(x1, zx + zw) > max(x0, zx) and min(y1, zy + zh) > max(y0, zy)):
            continue
        own = json.loads(json.dumps(s))
        g = own["geometry"]
        if s["type"] == "arect":  # in pixels
            g["x"], g["y"], g["w"], g["h"] = g["x"] * fw / width - x, g["y"] * fh / height - y, g["w"] * fw / width, g["h"] * fh / height
        else:
            for p in _points(own):
                p["x"], p["y"] = (p["x"] - zx) / zw, (p["y"] - zy) / zh
            if "width" in g:
                g["width"], g["height"] = g["width"] / zw, g["height"] / zh
        kept.append(own)
    return json.dumps({"shapes": kept})


def cut(rows: DataFrame, windows: Column, notes: bool = True, least: float = 0.0) -> DataFrame:
    """New records, one for each of the ``windows`` (an array of ``WINDOW``) of a record with the columns that ``_of`` adds.

    Field 0 is the window's pixels in the image's own type; with ``notes`` field 1 is its annotation: JSON as seen from
    the window, or the same window of an image that is a mask, by its nearest pixels. Labels are 0; ``id`` and
    ``serial`` are the source's serial times 2^20 plus the cut's place among its windows that are not empty. Empty windows are left out, and of images of one
    channel cuts with a mean below ``least``. Fields that are no raw matrix give nothing.
    """
    rows = rows.withColumn("__windows", F.filter(windows.cast(f"array<{WINDOW}>"), lambda c: (c["w"] > 0) & (c["h"] > 0) & (c["fw"] > 0) & (c["fh"] > 0)))
    # rows without windows are passed over in the tasks: as a filter, the windows would be computed once more at the scan

    def cuts(serial: int, image: bytes, note: bytes | None, is_json: bool, own: list[dict]) -> Iterator[tuple]:
        try:
            source = R.decode_raw(image) if own else None
        except ValueError:
            return
        if source is None:
            return
        height, width = source.shape[:2]
        shapes = json.loads(note).get("shapes", []) if notes and is_json and note else []
        try:
            mask = R.decode_raw(note or b"") if notes and not is_json else None
        except ValueError:
            mask = None
        for k, c in enumerate(own):
            sx, sy, sw, sh, *place = (c[n] for n in _NAMES)
            part = _placed(source[sy : sy + sh, sx : sx + sw], *place, False)
            if not part.size or part.ndim == 2 and least > 0 and part.mean() < least:
                continue
            text = None
            if mask is not None and mask.shape[:2] == source.shape[:2]:
                text = R.encode_raw(np.ascontiguousarray(_placed(mask[sy : sy + sh, sx : sx + sw], *place, True)))
            elif notes and is_json:
                text = _zoomed(shapes, width, height, *place).encode()
            yield serial * MOST_CUTS + k, R.encode_raw(np.ascontiguousarray(part)), text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("serial", pa.int64()), ("image", pa.binary()), ("note", pa.binary())])
        done: list[tuple] = []
        held = 0
        for b in batches:
            for row in zip(*(c for c in b.columns), strict=True):
                for made in cuts(*(x.as_py() for x in row)):
                    done.append(made)
                    held += len(made[1]) + len(made[2] or b"")
                    if held >= HELD:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema)
                        done, held = [], 0
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema)

    made = map_arrow(rows.select("serial", "__image", "__note", "__json", "__windows"), run, "serial long, image binary, note binary")
    made = made.select(F.col("serial").alias("id"), "serial", F.lit(0.0).alias("label"), "image", "note")
    return R.make_records(made, [("image", R.IMAGE), ("note", R.NONE)] if notes else [("image", R.IMAGE)])


def crops(records: DataFrame, scale: float = 1.0) -> DataFrame:
    """A record of each shape's box in whole pixels, as far as it lies in the image, scaled; without annotations."""
    def window(b: Column) -> Column:
        x, y = (F.greatest(F.floor(b[k]), F.lit(0)) for k in "xy")
        w, h = (F.least(F.floor(b[d]) + F.floor(b[o]), F.col(size)) - at for d, o, size, at in (("w", "x", "__w", x), ("h", "y", "__h", y)))
        fw, fh = F.round(w * scale), F.round(h * scale)
        return _window(sx=x, sy=y, sw=w, sh=h, fw=fw, fh=fh, x=0, y=0, w=fw, h=fh)

    return cut(_of(records), F.transform("__boxes", window), notes=False)


def tiles(records: DataFrame, size: int, step: int, scale: float = 1.0, least: float = 0.0) -> DataFrame:
    """A record of each grid tile of the scaled image (see ``datasets.grid_tiles`` for where they lie)."""
    rows = _of(records)
    for axis in "wh":  # in columns of their own, or each tile would compute them again
        rows = rows.withColumn(f"__f{axis}", F.round(F.col(f"__{axis}") * scale).cast("long"))
        n, step_ = Z.grid(F.col(f"__f{axis}"), size, step)
        rows = rows.withColumns({f"__n{axis}": n, f"__d{axis}": step_, f"__m{axis}": F.greatest(F.col(f"__f{axis}") - size, F.lit(0)), f"__t{axis}": F.least(F.col(f"__f{axis}"), F.lit(size))})

    def window(k: Column) -> Column:
        x, y = F.least(k % F.col("__nw") * F.col("__dw"), F.col("__mw")), F.least(F.floor(k / F.col("__nw")) * F.col("__dh"), F.col("__mh"))
        return _window(sx=0, sy=0, sw=F.col("__w"), sh=F.col("__h"), fw=F.col("__fw"), fh=F.col("__fh"), x=x, y=y, w=F.col("__tw"), h=F.col("__th"))

    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__nw") * F.col("__nh") - 1), window)
    return cut(rows, F.when(F.col("__w").isNotNull(), every), least=least)


def patches(records: DataFrame, size: int, patch: int, scaled: bool = True, least_patch: int = 0) -> DataFrame:
    """A record about each shape with an area, kept inside the image.

    ``scaled``: the image is seen at the scale at which the root of the shape's area is ``size`` pixels, and the patch
    has at least ``patch`` pixels a side. Else at its own scale, and the patch has the same share of the shape: root of
    the area / ``size`` times ``patch`` pixels, and no less than ``least_patch``.
    """
    def scaled_box(b: Column) -> Column:
        by = F.lit(float(size)) / F.sqrt(b["w"] * b["h"]) if scaled else F.lit(1.0)
        full = F.struct(*[F.round(F.col(f"__{k}") * by).cast("long").alias(k) for k in "wh"])
        return I.let(full, lambda f: F.struct(f["w"].alias("fw"), f["h"].alias("fh"), *[F.floor(b[k] / F.col(f"__{d}") * f[d]).cast("long").alias(k) for k, d in (("x", "w"), ("y", "h"), ("w", "w"), ("h", "h"))]))

    def window(b: Column) -> Column:
        side = F.lit(patch) if scaled else F.greatest(F.floor(F.sqrt(b["w"] * b["h"]) / size * patch).cast("long"), F.lit(least_patch))
        axes = {}
        for o, d in (("x", "w"), ("y", "h")):
            more = F.greatest(side - b[d], F.lit(0))
            length = F.least(b[d] + more, b[f"f{d}"])
            axes |= {d: length, o: F.greatest(F.lit(0), F.least(b[o] - Z.div(more, 2), b[f"f{d}"] - length))}
        return _window(sx=0, sy=0, sw=F.col("__w"), sh=F.col("__h"), fw=b["fw"], fh=b["fh"], **axes)

    return cut(_of(records), F.transform(F.transform(F.filter("__boxes", lambda b: (b["w"] > 0) & (b["h"] > 0)), scaled_box), window))


def zoomed(records: DataFrame, ratio: float) -> DataFrame:
    """Each record cut to a window about all its shapes, so that these fill at least ``ratio`` of it; others whole."""
    ends = lambda k, d, f: f(F.transform("__boxes", lambda b: b[k] + (b[d] if d else F.lit(0.0))))
    x, y = (F.coalesce(F.round(ends(k, None, F.array_min)), F.lit(0)) for k in "xy")
    w, h = (F.coalesce(F.round(ends(k, d, F.array_max) - ends(k, None, F.array_min)), F.lit(0)) for k, d in (("x", "w"), ("y", "h")))
    rows = _of(records).withColumns({"__bx": x, "__by": y, "__bw": w, "__bh": h})
    z = Z.annotation_zoom(*[F.col(f"__{k}") for k in ("w", "h", "bx", "by", "bw", "bh")], ratio)
    own = F.transform(F.array(z), lambda v: _window(sx=0, sy=0, sw=F.col("__w"), sh=F.col("__h"), fw=F.col("__w"), fh=F.col("__h"), **{k: v[k] for k in "xywh"}))
    return cut(rows, F.when(F.col("__w").isNotNull(), own))
