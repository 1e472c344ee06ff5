"""Transform pipelines: an ordered list of ``{"type": ..., ...}`` compiled to column steps on annotated images.

A row holds ``serial``, ``width``, ``height`` (pixels) and perhaps ``shapes``, an array of structs with ``controls``
(points in pixels), ``image``, its pixels, and ``label``, a mask of the same size. Facet 0 is the image, facet 1 the
annotation (its shapes, its mask); steps that append number theirs on from there. Every step is a pure function of the
row: its random parameters are hashes of the seed, the step's place and the row's serial, so a retried task or another
partitioning gives the same result, and all facets of a row get the same parameters.

Steps on geometry move images, labels and shapes: labels by their nearest pixel where images are interpolated (but for
``augment.scale``). Steps on colour change images only, ``normalize`` facet 0 only. A step that names a facet
(``index``, ``ref``, ``copy``) means that one. Pixel work is noted and runs once at the end (see ``plans.facets``).

Steps that build from the geometry append to ``targets``, an array of structs ``name``, ``width``, ``height``, ``channels``
and ``data`` (by row, column and channel).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplery.functions import images as I
from samplery.functions import pixels as P
from samplery.functions import shapes as S
from samplery.functions import sizes as Z
from samplery.functions.keys import between, integer, uniform
from samplery.operators import anchors as A
from samplery.plans import facets as M
from samplery.plans.facets import Frame, Plan, Sample
from samplery.plans.sampling import SampleConfig

#: A step of this module notes its pixel work on the plan; one of a user's own gets rows whose ``image`` is up to date, and the configuration.
Step = Callable[[DataFrame, dict, str, Plan], DataFrame]
REGISTRY: dict[str, Step] = {}
#: The steps that note their pixel work.
NOTED: set[str] = set()
#: Augmentation and masks, then sizes and clips, then targets. Masks and drawings follow later steps, targets cannot.
_STAGE = {"resize": 1, "scale": 1, "pad": 1, "clip": 1, "clip_square": 1, "random_square_clip": 1, "pyramid": 1, "anchors.": 2, "box_feature": 2, "keypoints.": 2}
#: Steps that leave geometry as it is: any place will do.
_ANYWHERE = ("rasterize", "mask", "erode_mask", "drop", "featurize", "normalize", "colorspace", "augment.add", "augment.blur", "augment.flip_color")


def register(name: str) -> Callable[[Step], Step]:
    """Adds a step of a user's own: a function of rows, the step's settings, its place and the configuration."""
    def put(step: Step) -> Step:
        REGISTRY[name] = step
        NOTED.discard(name)
        return step

    return put


def _noted(name: str) -> Callable[[Step], Step]:
    def put(step: Step) -> Step:
        REGISTRY[name] = step
        NOTED.add(name)
        return step

    return put


def validate(transforms: Sequence[dict]) -> None:
    """Known types, in an order that keeps targets true: no geometry after anchors, features or key points."""
    last = 0
    for t in transforms:
        if t.get("type") == "augment.affine":
            raise NotImplementedError("augment.affine is not supported")
        if t.get("type") not in REGISTRY:
            raise ValueError(f"unknown transform {t.get('type')!r}")
        anywhere = t["type"] in _ANYWHERE
        stage = last if anywhere else next((v for k, v in _STAGE.items() if t["type"].startswith(k)), 0)
        if last == 2 and stage < 2:
            raise ValueError(f"{t['type']} may not follow what was built from the geometry before it")
        last = max(last, stage)
        validate(t.get("transforms", ()))


def flat(transforms: Sequence[dict]) -> Iterator[dict]:
    """All steps, also those inside others."""
    for t in transforms:
        yield t
        yield from flat(t.get("transforms", ()))


def apply(rows: DataFrame, transforms: Sequence[dict], config: SampleConfig, place: str = "") -> DataFrame:
    """The steps in order; an image whose pixels don't make ``width`` x ``height`` is an error.

    ``image`` and ``label`` are changed; ``raster`` is facet 1's pixels if a step has drawn them, ``mask`` the last
    appended mask; ``facets`` lists all facets' kinds, sizes and pixels. Without pixels anywhere nothing runs in Python.
    """
    validate(transforms)
    plan = M.of_rows(rows, config)
    rows = steps(plan.begin(rows), transforms, plan, place)
    if plan.notes:
        rows = _finished(rows, plan)
    elif plan.inputs and transforms:
        rows = rows.withColumns({i.column: _agreeing(F.col(i.column), F.col("width"), F.col("height")) for i in plan.inputs.values()})
    return rows.drop(*[c for c in rows.columns if c.startswith(("__begun", "__pixels"))])


def steps(rows: DataFrame, transforms: Sequence[dict], plan: Plan, place: str = "") -> DataFrame:
    """The steps in order on a plan that is still to be run."""
    for k, t in enumerate(transforms):
        step = REGISTRY[t["type"]]
        if t["type"] in NOTED:
            rows = step(rows, t, f"{place}{k}", plan)
        else:
            rows = plan.begin(step(_finished(rows, plan), t, f"{place}{k}", plan.config))
    return rows


def _agreeing(image: Column, width: Column, height: Column) -> Column:
    """The image, if it has a whole number of channels at this size."""
    area, n = width * height, F.size(image)
    agrees = F.coalesce(F.when(area > 0, n % area == 0).otherwise(n == 0), F.lit(False))
    error = F.raise_error(F.format_string("%d numbers are no image of %s x %s pixels", n, width.cast("string"), height.cast("string")))
    return F.when(image.isNull() | agrees, image).otherwise(error)


def _finished(rows: DataFrame, plan: Plan) -> DataFrame:
    """Runs the plan's notes and puts facets into columns, from which the plan may go on."""
    rows = plan.run(rows)
    names = {0: "image", 1: "label" if "label" in rows.columns else "raster"} | {k: "mask" for k in plan.masks[-1:]}
    data = {k: F.col("facets")[k]["data"] for k in sorted(plan.pixels)}
    rows = rows.withColumns({names[k]: v for k, v in data.items() if k in names} | {f"__pixels{k}": v for k, v in data.items() if k not in names})
    if plan.pyramids:
        copies = F.array(*[F.struct(F.lit("pyramid").alias("name"), *[F.col("facets")[k][f].alias(f) for f in ("width", "height", "channels", "data")]) for k in plan.pyramids]).cast(_TARGETS)
        rows = rows.withColumn("targets", F.concat(copies, F.coalesce(F.col("targets"), F.array().cast(_TARGETS))) if "targets" in rows.columns else copies)
    plan.ran({k: M.Input(names.get(k, f"__pixels{k}")) for k in data})
    return rows


def _shapes(rows: DataFrame, frame: Frame, change: Callable[[Column], Column], rect: Callable[[Column], Column] | None = None) -> DataFrame:
    """Changes the points of a frame's shapes; ``rect`` those of rectangles and ellipses."""
    def of(s: Column) -> Column:
        own = change(s["controls"])
        return s.withField("controls", F.when(s["type"].isin("rect", "ellipse"), rect(s["controls"])).otherwise(own) if rect else own)

    return rows.withColumns({c: F.transform(c, of) for c in frame.shapes.values()}) if frame.shapes else rows


def _frames(rows: DataFrame, plan: Plan, change: Callable[[DataFrame, Frame, Column, Column], DataFrame]) -> DataFrame:
    """``change`` for each frame, with its width and height."""
    for frame in plan.frames:
        rows = change(rows, frame, F.col(frame.width), F.col(frame.height))
    return rows


def _sized(rows: DataFrame, plan: Plan, frame: Frame, width: Column, height: Column, nearest: bool = True) -> DataFrame:
    """New sizes, points and pixels scaled along; labels by their nearest pixel, or like images."""
    def change(x: np.ndarray, n: list[float], label: bool) -> np.ndarray:
        h, w, c = x.shape
        if n == [w, h]:
            return x
        new = int(n[1]), int(n[0]), c
        return P.resize(x.reshape(1, -1), w, h, new[1], new[0], c, label and nearest).reshape(new) if min(new) >= 1 else np.zeros((max(new[0], 0), max(new[1], 0), c))

    rows = rows.withColumns({"__w": width.cast("long"), "__h": height.cast("long"), "__fx": width / F.col(frame.width), "__fy": height / F.col(frame.height)})
    rows = plan.each(rows, frame.facets, change, [F.col("__w"), F.col("__h")])
    rows = _shapes(rows, frame, lambda c: F.transform(c, lambda p: S.point(p["x"] * F.col("__fx"), p["y"] * F.col("__fy"))))
    return rows.withColumns({frame.width: F.col("__w"), frame.height: F.col("__h")}).drop("__fx", "__fy", "__w", "__h")


def _moved(rows: DataFrame, plan: Plan, frame: Frame, dx: Column, dy: Column, width: Column, height: Column, border: str = "constant", value: float = 0.0) -> DataFrame:
    """New frames, points and pixels moved in them; pixels that come from outside follow the border."""
    def change(x: np.ndarray, n: list[float], label: bool) -> np.ndarray:
        return P.window(x, x.shape[1], x.shape[0], x.shape[2], *map(int, n), border, value)

    rows = rows.withColumns({"__dx": dx, "__dy": dy, "__w": width.cast("long"), "__h": height.cast("long")})
    rows = plan.each(rows, frame.facets, change, [F.col(f"__{k}") for k in ("dx", "dy", "w", "h")])
    rows = _shapes(rows, frame, lambda c: S.move(c, F.col("__dx"), F.col("__dy")))
    return rows.withColumns({frame.width: F.col("__w"), frame.height: F.col("__h")}).drop("__dx", "__dy", "__w", "__h")


def _draw(name: str, low: float, high: float, plan: Plan, rest: float) -> Column:
    return between(name, low, high, F.col("serial"), seed=plan.seed) if plan.perturb else F.lit(float(rest))


def _coin(name: str, on: bool, plan: Plan) -> Column:
    return uniform(name, F.col("serial"), seed=plan.seed) < 0.5 if plan.perturb and on else F.lit(False)


@_noted("resize")
def _resize(rows, t, place, plan):
    def change(rows: DataFrame, frame: Frame, w: Column, h: Column) -> DataFrame:
        if any(t.get(k) for k in ("size", "width", "height")):
            return _sized(rows, plan, frame, F.lit(int(t.get("width", t.get("size")))), F.lit(int(t.get("height", t.get("size")))))
        return _sized(rows, plan, frame, *Z.resize(w, h, t.get("max_size", 2**31 - 1), t.get("min_size", 0)))

    return _frames(rows, plan, change)


@_noted("scale")
def _scale(rows, t, place, plan):
    k = F.lit(float(t.get("scale", 1.0)))
    return _frames(rows, plan, lambda rows, frame, w, h: _sized(rows, plan, frame, F.floor(w * k), F.floor(h * k)))


@_noted("augment.scale")
def _augment_scale(rows, t, place, plan):
    r = t.get("range", 0)
    rows = rows.withColumn("__k", _draw(f"{place}.scale", t.get("min", 1 - r), t.get("max", 1 + r), plan, 1.0))
    return _frames(rows, plan, lambda rows, frame, w, h: _sized(rows, plan, frame, F.round(w * F.col("__k")), F.round(h * F.col("__k")), False)).drop("__k")


@_noted("augment.flip")
def _flip(rows, t, place, plan):
    names = ("horizontal", "vertical", "transpose")
    flags = [F.col(f"__{n}") for n in names]
    rows = rows.withColumns({f"__{n}": _coin(f"{place}.{n}", t.get(n, False), plan) for n in names})

    def change(rows: DataFrame, frame: Frame, w: Column, h: Column) -> DataFrame:
        rows = plan.each(rows, frame.facets, lambda x, n, label: P.flip(x, x.shape[1], x.shape[0], x.shape[2], *map(bool, n)), flags)
        rows = rows.withColumns({"__w": w, "__h": h})
        rows = _shapes(rows, frame, lambda c: S.flip(c, F.col("__w"), F.col("__h"), *flags))
        return rows.withColumns({frame.width: F.when(flags[2], F.col("__h")).otherwise(F.col("__w")), frame.height: F.when(flags[2], F.col("__w")).otherwise(F.col("__h"))}).drop("__w", "__h")

    return _frames(rows, plan, change).drop(*[f"__{n}" for n in names])


@_noted("augment.rotate")
def _rotate(rows, t, place, plan):
    r, border = t.get("range", 0), _border(t)
    rows = rows.withColumn("__a", _draw(f"{place}.angle", t.get("min", -r), t.get("max", r), plan, 0.0))

    def turn(x: np.ndarray, n: list[float], label: bool) -> np.ndarray:
        h, w, c = x.shape
        return P.rotate(x.reshape(1, -1), w, h, n[0], c, border, label).reshape(h, w, c) if n[0] else x

    def change(rows: DataFrame, frame: Frame, w: Column, h: Column) -> DataFrame:
        rows = plan.each(rows, frame.facets, turn, [F.col("__a")])
        turned = lambda c: S.rotate(c, w, h, F.col("__a"))
        return _shapes(rows, frame, turned, lambda c: S.refit_rect(turned(c)))

    return _frames(rows, plan, change).drop("__a")


@_noted("pad")
def _pad(rows, t, place, plan):
    def change(rows: DataFrame, frame: Frame, width: Column, height: Column) -> DataFrame:
        w, h = F.lit(t.get("width", t.get("size", 400))), F.lit(t.get("height", t.get("size", 400)))
        fits = (width <= w) & (height <= h)
        w = F.when(F.assert_true(F.coalesce(fits, F.lit(True)), F.lit("the image does not fit the canvas")).isNull(), w)
        return _moved(rows, plan, frame, F.lit(0), F.lit(0), w, h)

    return _frames(rows, plan, change)


@_noted("clip")
def _clip(rows, t, place, plan):
    def change(rows: DataFrame, frame: Frame, width: Column, height: Column) -> DataFrame:
        draws, axes = {}, []
        for name, letter, size in (("width", "w", width), ("height", "h", height)):
            of = lambda k, name=name: t.get(f"{k}_{name}", t.get(k, 0))
            drawn = lambda k, bound, letter=letter: integer(f"{place}.{letter}.{k}", bound, F.col("serial"), seed=plan.seed) if plan.perturb and bound else F.lit(0).cast("long")
            most = of("shift")
            draws |= {f"__{letter}1": drawn("crop1", of("max_crop")), f"__{letter}2": drawn("crop2", of("max_crop")), f"__{letter}r": drawn("place", 1 << 20)}
            draws[f"__{letter}s"] = drawn("shift", 2 * most + 1) - most if plan.perturb and most else F.lit(0).cast("long")
            own = [F.col(f"__{letter}{k}") for k in "12sr"]
            axes.append(Z.clip_stages(f"__{letter}_", size.cast("long"), *own[:2], of("size") or of("min"), of("size") or of("max"), of("round"), *own[2:]))
        before = set(rows.columns)
        rows = rows.withColumns(draws)
        for both in zip(*axes, strict=True):
            rows = rows.withColumns(both[0] | both[1])
        stays = (F.col("__w_size") == width) & (F.col("__h_size") == height) & (F.col("__ws") == 0) & (F.col("__hs") == 0)
        rows = rows.withColumns({f"__{a}move": F.when(stays, 0).otherwise(F.col(f"__{a}_move")) for a in "wh"})
        noted = len(plan.slots)
        out = _moved(rows, plan, frame, F.col("__wmove"), F.col("__hmove"), F.col("__w_size"), F.col("__h_size"), _border(t))
        return out.drop(*[c for c in out.columns if c not in before and c not in plan.slots[noted:]])

    return _frames(rows, plan, change)


@_noted("clip_square")
def _clip_square(rows, t, place, plan):
    s = t.get("shift", 0)
    shift = integer(f"{place}.shift", 2 * s + 1, F.col("serial"), seed=plan.seed) - s if plan.perturb and s else F.lit(0)

    def change(rows: DataFrame, frame: Frame, w: Column, h: Column) -> DataFrame:
        side, x, y = Z.clip_square(w, h, shift)
        return _moved(rows, plan, frame, -x, -y, side, side)

    return _frames(rows, plan, change)


@_noted("random_square_clip")
def _random_square_clip(rows, t, place, plan):
    size = t.get("size", 512)
    draw = lambda k: None if t.get("center") or not plan.perturb else integer(f"{place}.{k}", 1 << 20, F.col("serial"), seed=plan.seed)

    def change(rows: DataFrame, frame: Frame, w: Column, h: Column) -> DataFrame:
        x, px = Z.square_window(w, size, draw("x"))
        y, py = Z.square_window(h, size, draw("y"))
        return _moved(rows, plan, frame, px - x, py - y, F.lit(size), F.lit(size), value=float(t.get("pad", 0.0)))

    return _frames(rows, plan, change)


# Steps on colours: images only, whatever their sizes.


def _images(plan: Plan) -> list[int]:
    return list(range(len(plan.kinds)))


def _four(value, rest: float) -> np.ndarray:
    """Numbers for up to four channels; a single number is for all of them, channels that a list leaves out get ``rest``."""
    if value is None:
        return np.full(4, rest)
    return np.array([*value, *[rest] * 4][:4], np.float64) if isinstance(value, (list, tuple)) else np.full(4, float(value))


@_noted("normalize")
def _normalize(rows, t, place, plan):
    """Subtracts ``mean`` from facet 0 and divides it by ``std``, channel by channel."""
    mean, std = _four(t.get("mean"), 0.0), _four(t.get("std"), 1.0)

    def change(x: np.ndarray, n: list[float], label: bool) -> np.ndarray:
        c = min(4, x.shape[2])
        out = x.copy()
        out[..., :c] = (x[..., :c] - mean[:c]) / std[:c]
        return out

    return plan.each(rows, [0], change, kinds=(M.IMAGE, M.LABEL, M.FEATURE))


@_noted("augment.add")
def _add(rows, t, place, plan):
    """Each of the first three channels gets a delta of its own; ``space`` SAME: one for all, HSV or Lab: of that space's channels (BGR in [0, 1], as ``colorspace`` has it)."""
    space = t.get("space", "BGR")
    if space not in ("BGR", "SAME", "HSV", "Lab"):
        raise ValueError(f"unknown space {space!r}")
    if not plan.perturb:
        return rows
    if space in ("HSV", "Lab"):
        rows = _colorspace(rows, {"code": f"BGR2{space}"}, place, plan)
        rows = _add(rows, t | {"space": "BGR"}, place, plan)
        return _colorspace(rows, {"code": f"{space}2BGR"}, place, plan)
    r = [t.get(f"range{k + 1}", t.get("range", 0)) for k in range(3)]
    deltas = [_draw(f"{place}.add{k}", t.get(f"min{k + 1}", -r[k]), t.get(f"max{k + 1}", r[k]), plan, 0.0) for k in range(3)]

    def change(x: np.ndarray, n: list[float], label: bool) -> np.ndarray:
        if space == "SAME":
            return x + n[0]
        out, c = x.copy(), min(3, x.shape[2])
        out[..., :c] += n[:c]
        return out

    return plan.each(rows, _images(plan), change, deltas, (M.IMAGE,))


@_noted("augment.flip_color")
def _flip_color(rows, t, place, plan):
    coin = _coin(f"{place}.flip_color", True, plan)
    return plan.each(rows, _images(plan), lambda x, n, label: 255 - x if n[0] else x, [coin], (M.IMAGE,)) if plan.perturb else rows


def _border(t: dict) -> str:
    kind = t.get("border_type", "constant")
    if kind not in ("constant", "replicate", "reflect"):
        raise ValueError(f"unknown border type {kind!r}")
    return kind


@_noted("augment.blur")
def _blur(rows, t, place, plan):
    border = _border(t)
    if not plan.perturb:
        return rows
    sigma = _draw(f"{place}.sigma", t.get("min", 0), t.get("max", 3), plan, 0.0)

    def change(x: np.ndarray, n: list[float], label: bool) -> np.ndarray:
        return P.blur(x.reshape(1, -1), x.shape[1], x.shape[0], n[0], x.shape[2], border).reshape(x.shape)

    return plan.each(rows, _images(plan), change, [sigma], (M.IMAGE,))


#: Channels before, and the pixels after, of each colour code; channels are in [0, 1], hue in degrees.
_CODES: dict[str, tuple[int, Callable[[np.ndarray], np.ndarray]]] = {
    "BGR2GRAY": (3, lambda x: (x @ np.array([0.114, 0.587, 0.299]))[..., None]),
    "GRAY2BGR": (1, lambda x: np.repeat(x, 3, axis=2)),
    "BGR2RGB": (3, lambda x: x[..., ::-1]),
    "BGR2HSV": (3, P.hsv_of),
    "HSV2BGR": (3, P.bgr_of_hsv),
    "BGR2Lab": (3, P.lab_of),
    "Lab2BGR": (3, P.bgr_of_lab),
}


@_noted("colorspace")
def _colorspace(rows, t, place, plan):
    """Multiplies by ``mul0``, converts by ``code``, multiplies by ``mul1``."""
    code = t.get("code")
    if code not in _CODES:
        raise ValueError(f"unknown colour code {code!r}")
    channels = _CODES[code][0]
    before, after = float(t.get("mul0", 1.0)), float(t.get("mul1", 1.0))

    def change(x: np.ndarray, n: list[float], label: bool) -> np.ndarray:
        if x.shape[2] != channels:
            raise ValueError(f"{code} needs {channels} channels")
        return _CODES[code][1](x * before) * after

    return plan.each(rows, _images(plan), change, kinds=(M.IMAGE,))


# Steps on single facets.


@_noted("mask")
def _mask(rows, t, place, plan):
    """A label facet of facet ``ref``'s size that holds one value: a new one, or instead of ``index``'s pixels."""
    value, frame = float(t.get("value", 1)), plan.frame(plan.facet(t.get("ref", 0)))
    if t.get("index", -1) < 0:
        own = plan.append(M.LABEL, frame)
        plan.masks.append(own)
    else:
        own = plan.facet(t["index"])
        plan.move(own, frame)
        plan.pixels.add(own)

    def work(sample: Sample, n: list[float]) -> None:
        sample.kinds[own], sample.images[own] = M.LABEL, np.full((int(n[1]), int(n[0]), 1), value)

    sizes = [F.col(frame.width), F.col(frame.height)]
    return plan.note(rows, work, F.when(sizes[0].isNotNull() & sizes[1].isNotNull(), F.array(*[v.cast("double") for v in sizes])))


@_noted("erode_mask")
def _erode_mask(rows, t, place, plan):
    """Erodes facet ``index``, -1: the last one."""
    radius, times, border = int(t.get("radius", 0)), int(t.get("iterations", 1)), _border(t)
    own = plan.facet(t.get("index", -1))
    if own not in plan.pixels or plan.kinds[own] != M.LABEL:
        raise ValueError("there is no mask to erode")
    return plan.each(rows, [own], lambda x, n, label: P.erode(x, x.shape[1], x.shape[0], x.shape[2], radius, times, border))


def _kind(plan: Plan, rows: DataFrame, index: int, kind: str) -> DataFrame:
    own = plan.facet(index)

    def work(sample: Sample, n: list[float]) -> None:
        sample.kinds[own] = kind

    if not plan.flags:
        plan.later[own] = kind
    return plan.note(rows, work)


@_noted("drop")
def _drop(rows, t, place, plan):
    return _kind(plan, rows, t.get("index", 1), M.NONE)


@_noted("featurize")
def _featurize(rows, t, place, plan):
    return _kind(plan, rows, t.get("index", 1), M.FEATURE)


@_noted("pyramid")
def _pyramid(rows, t, place, plan):
    """Smaller copies of facet 0, which later steps change by their own sizes; without an image they have no pixels."""
    count, rate = int(t.get("count", 0)), float(t.get("rate", 0.5))
    if count < 0 or rate <= 0:
        raise ValueError("a pyramid has a count from 0 and a rate above 0")
    if not count:
        return rows
    base = plan.frame(0)
    rows = rows.withColumn("__sizes", Z.pyramid(F.col(base.width), F.col(base.height), count, rate))
    for k in range(count):
        at = len(plan.frames)
        frame = Frame(f"width_{at}", f"height_{at}", [])
        plan.frames.append(frame)
        rows = rows.withColumns({frame.width: F.col("__sizes")[k]["w"], frame.height: F.col("__sizes")[k]["h"]})
        own = plan.append(M.IMAGE, frame)
        plan.pyramids.append(own)
        rows = plan.note(rows, _copy(own), [F.col(frame.width), F.col(frame.height)])
    return rows.drop("__sizes")


def _copy(own: int) -> Callable[[Sample, list[float]], None]:
    def work(sample: Sample, n: list[float]) -> None:
        x = sample.images[0]
        if x is not None:
            h, w, c = x.shape
            new = int(n[1]), int(n[0]), c
            sample.images[own] = P.resize(x.reshape(1, -1), w, h, new[1], new[0], c).reshape(new) if min(new) >= 1 else np.zeros((max(new[0], 0), max(new[1], 0), c))

    return work


_TARGETS = "array<struct<name:string,width:bigint,height:bigint,channels:int,data:array<double>>>"


def _target(name: str, width: Column, height: Column, channels: int, data: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), width.cast("long").alias("width"), height.cast("long").alias("height"), F.lit(channels).alias("channels"), data.cast("array<double>").alias("data"))


def _append(rows: DataFrame, targets: Column) -> DataFrame:
    old = F.coalesce(F.col("targets"), F.array().cast(_TARGETS)) if "targets" in rows.columns else F.array().cast(_TARGETS)
    return rows.withColumn("targets", F.concat(old, targets.cast(_TARGETS)))


def _field(rows: DataFrame, shapes: str, name: str, default: float) -> Callable[[Column], Column]:
    """A number of a shape, the default where shapes have no such field or it is null; a label that lists channels gives its first."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema[shapes].dataType.elementType.fields}
    if name not in kinds:
        return lambda s: F.lit(float(default))
    if name == "label" and kinds[name] == "string":
        return lambda s: S.label_channels(s["label"])[0]
    return lambda s: F.coalesce(s[name].cast("double"), F.lit(float(default)))


def _divisible(size: str, by: int) -> Column:
    return F.when(F.assert_true(F.coalesce(F.col(size) % by == 0, F.lit(True)), F.lit(f"{size} is not a multiple of {by}")).isNull(), F.col(size))


def _dense(kind: str) -> Step:
    def step(rows, t, place, plan):
        d = int(t.get("downsize", 1))
        frame, shapes = plan.shapes(plan.facet(t.get("index", 1)))
        priors = [tuple(map(float, p)) for p in t.get("priors", ())] if kind == "box" else []
        if kind == "point":
            single = F.forall(F.coalesce(shapes, F.slice(shapes, 1, 0)), lambda s: F.size(s["controls"]) == 1)
            rows = rows.withColumn(shapes, F.when(F.assert_true(single, F.lit("point anchors take shapes of one point")).isNull(), F.col(shapes)))
        boxes = F.transform(shapes, lambda s, i: F.struct(i.alias("serial"), *[S.bbox(s["controls"])[k].alias(f"b{k}") for k in "xywh"]))
        rows = rows.withColumn("__own", boxes if kind == "point" else F.filter(boxes, lambda b: (b["bw"] > 0) & (b["bh"] > 0)))
        rows = rows.withColumn("__own", F.coalesce("__own", F.slice("__own", 1, 0))).withColumns({s: _divisible(s, d) for s in (frame.width, frame.height)})
        w, h = F.col(frame.width), F.col(frame.height)
        made = A.anchor_arrays(F.col("__own"), w, h, kind, d, float(t.get("upper_th", 0.6)), float(t.get("lower_th", 0.4)), bool(t.get("weighted", False)), float(t.get("params_default", 0)), priors)
        return _append(rows, F.array(*[_target(f"anchors.{n}", F.floor(w / d), F.floor(h / d), c, data) for n, (data, c) in made.items()])).drop("__own")

    return step


for _kind_ in ("point", "circle", "box"):
    _noted(f"anchors.dense.{_kind_}")(_dense(_kind_))


@_noted("box_feature")
def _box_feature(rows, t, place, plan):
    """Per shape label, tag and corners clipped to the last pixels; shapes whose clipped area is below ``min_area`` go."""
    frame, shapes = plan.shapes(plan.facet(t.get("index", 1)))
    label, tag = _field(rows, shapes, "label", 1.0), _field(rows, shapes, "tag", 0.0)
    clip = lambda v, size: F.greatest(F.lit(0.0), F.least(v, F.col(size) - 1.0))

    def feature(s: Column) -> Column:
        b = S.bbox(s["controls"])
        return F.array(label(s), tag(s), clip(b["x"], frame.width), clip(b["y"], frame.height), clip(b["x"] + b["w"], frame.width), clip(b["y"] + b["h"], frame.height))

    kept = F.filter(F.transform(shapes, feature), lambda f: (f[4] - f[2] + 1) * (f[5] - f[3] + 1) >= float(t.get("min_area", 1)))
    rows = rows.withColumn("__f", kept)
    return _append(rows, F.array(_target("box_feature", F.lit(6), F.size("__f"), 1, F.flatten("__f")))).drop("__f")


@_noted("keypoints.basic")
def _keypoints(rows, t, place, plan):
    """A mask and offsets (x, y) per cell and class of the shapes' points."""
    d, classes = int(t.get("downsize", 1)), int(t.get("classes", 1))
    frame, shapes = plan.shapes(plan.facet(t.get("index", 1)))
    label = _field(rows, shapes, "label", 1.0)
    rows = rows.withColumns({s: _divisible(s, d) for s in (frame.width, frame.height)})
    made = P.keypoint_maps(rows.sparkSession, classes, d, float(t.get("radius", 5)))(F.col(frame.width), F.col(frame.height), F.transform(shapes, label), F.transform(shapes, lambda s: s["controls"]))
    rows = rows.withColumn("__k", made)
    w, h = F.floor(F.col(frame.width) / d), F.floor(F.col(frame.height) / d)
    n = (w * h * classes).cast("int")
    return _append(rows, F.array(_target("keypoints.mask", w, h, classes, F.slice("__k", F.lit(1), n)), _target("keypoints.offset", w, h, 2 * classes, F.slice("__k", n + 1, 2 * n)))).drop("__k")


#: Numbers that stand for shapes' types where their points go to the drawing.
_TYPES = ("point", "ellipse", "rect", "arect", "polygon", "polygons")


@_noted("rasterize")
def _rasterize(rows, t, place, plan):
    """Draws the shapes of facet ``index`` in order on its pixels (zeros without any; facet ``copy``'s if given) and takes them out of the row."""
    if t.get("use_palette") and t.get("use_tag"):
        raise ValueError("tag and palette cannot both colour the shapes")
    own = plan.facet(t.get("index", 1))
    frame, shapes = plan.shapes(own)
    copy, channels, thickness = t.get("copy", -1), int(t.get("channels", 1)), int(t.get("thickness", -1))
    copy = plan.facet(copy) if copy >= 0 else None
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema[shapes].dataType.elementType.fields}
    label, tag = _field(rows, shapes, "label", 1.0), _field(rows, shapes, "tag", 0.0)

    def colour(s: Column, i: Column) -> Column:
        if t.get("use_tag") or t.get("use_serial"):
            return F.array(*[S.render_colour(tag(s), i + 1, label(s), bool(t.get("use_tag")), bool(t.get("use_serial")))] * 4)
        if t.get("use_palette"):
            four = I.palette(integer(f"{place}.palette", len(I.TABLEAU20) - 1, F.col("serial"), i, seed=plan.seed) + 1).cast("array<double>")
            return F.slice(F.concat(four, F.array(F.lit(0.0))), 1, 4)
        return S.label_channels(s["label"]) if kinds.get("label") == "string" else F.array(*[label(s)] * 4)

    def numbers(s: Column, i: Column) -> Column:
        """Type, number of points, rings and their sizes, four numbers of colour, points."""
        rings = F.coalesce(s["rings"].cast("array<double>"), F.array().cast("array<double>")) if "rings" in kinds else F.array().cast("array<double>")
        kind = F.coalesce(F.array_position(F.array(*map(F.lit, _TYPES)), s["type"]) - 1, F.lit(-1))
        head = F.array(kind.cast("double"), F.size(s["controls"]).cast("double"), F.size(rings).cast("double"))
        return F.concat(head, rings, colour(s, i).cast("array<double>"), F.flatten(F.transform(s["controls"], lambda p: F.array(p["x"], p["y"]))))

    def work(sample: Sample, n: list[float]) -> None:
        w, h = int(n[0]), int(n[1])
        base = sample.images[own if copy is None else copy]
        canvas = np.zeros((h, w, channels)) if base is None else base.copy()
        at = 2
        while at < len(n):
            kind, points, rings = (int(v) for v in n[at : at + 3])
            sizes = [int(v) for v in n[at + 3 : at + 3 + rings]]
            at += 3 + rings
            P.draw(canvas, w, h, _TYPES[kind] if kind >= 0 else "unknown", np.array(n[at + 4 : at + 4 + 2 * points]).reshape(-1, 2), np.resize(np.array(n[at : at + 4]), canvas.shape[2]), thickness, sizes or None)
            at += 4 + 2 * points
        sample.images[own], sample.kinds[own] = canvas, M.LABEL if sample.kinds[own] == M.IMAGE else sample.kinds[own]

    sized = F.col(frame.width).isNotNull() & F.col(frame.height).isNotNull()
    drawn = F.concat(F.array(F.col(frame.width).cast("double"), F.col(frame.height).cast("double")), F.coalesce(F.flatten(F.transform(shapes, numbers)), F.array().cast("array<double>")))
    rows = plan.note(rows, work, F.when(sized, drawn))
    plan.move(own, frame)
    plan.pixels.add(own)
    return rows.withColumn(shapes, F.slice(shapes, 1, 0))


def _where(rows: DataFrame, plan: Plan, flag: str, children: Sequence[dict], place: str) -> DataFrame:
    """The children's steps where the flag is set. Other rows go through as nulls, which cost nothing there, and get their values back: one pass, however many choices there are."""
    whole = any(t["type"] not in NOTED for t in flat(children))  # a step of a user's own sees all columns
    rows = plan.begin(_finished(rows, plan)) if whole else rows
    sizes = {c for f in plan.frames for c in (f.width, f.height, *f.shapes.values())}
    own = [c for c in rows.columns if c != "serial" and not c.startswith("__") and (whole or c in sizes or c == "targets")]
    kept = f"{flag}_old"
    plan.flags.append(flag)
    rows = rows.withColumn(kept, F.struct(*own)).withColumns({c: F.when(F.col(flag), F.col(c)) for c in own})
    old = set(rows.columns)
    new = steps(rows, children, plan, place)
    new = plan.begin(_finished(new, plan)) if whole else new
    plan.flags.pop()
    fresh = [c for c in new.columns if c not in old and not c.startswith("__")]
    back = {c: F.when(F.col(flag), F.col(c)).otherwise(F.col(f"{kept}.{c}")) for c in own} | {c: F.when(F.col(flag), F.col(c)) for c in fresh}
    return new.withColumns(back).drop(kept, flag)


def _flag(place: str) -> str:
    return f"__do_{place.replace('.', '_')}"


@_noted("sometimes")
def _sometimes(rows, t, place, plan):
    if not plan.perturb:
        return rows
    flag = _flag(place)
    rows = rows.withColumn(flag, uniform(f"{place}.chance", F.col("serial"), seed=plan.seed) <= t.get("chance", 0.5))
    return _where(rows, plan, flag, t["transforms"], f"{place}.")


@_noted("some_of")
def _some_of(rows, t, place, plan):
    """``count`` different children, drawn per row, applied in their listed order."""
    if not plan.perturb:
        return rows
    chosen = some_of(len(t["transforms"]), t.get("count", 1), f"{place}.pick", plan.seed)
    flags = [_flag(f"{place}.{k}") for k in range(len(t["transforms"]))]
    rows = rows.withColumns({f: F.array_contains(chosen, k) for k, f in enumerate(flags)})
    for k, (flag, child) in enumerate(zip(flags, t["transforms"], strict=True)):
        rows = _where(rows, plan, flag, [child], f"{place}.{k}.")
    return rows


def some_of(children: int, count: int, name: str, seed: int) -> Column:
    """Sorted numbers of ``count`` of ``children``, the ones whose hashes come first for the row."""
    ranked = F.sort_array(F.array(*[F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.lit(name), F.lit(k), F.col("serial").cast("string"))).alias("h"), F.lit(k).alias("k")) for k in range(children)]))
    return F.sort_array(F.transform(F.slice(ranked, 1, count), lambda x: x["k"]))
