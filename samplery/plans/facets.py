"""The state of a transform pipeline: typed facets, and the pixel work of all its steps as one Arrow function.

A row's facets are numbered: its images, then its annotations, then what steps append. Each is an ``IMAGE``, a
``LABEL`` (a mask, or an annotation that has been drawn), a ``FEATURE`` or ``NONE``. Sizes, shapes and drawn parameters
are columns, so geometry stays in generated code; facets of one size share a *frame*. What a step does to pixels is
only noted, with its numbers as one more column, and all notes run together on each row's matrices when the pipeline
ends: pixels go to Python and back once, however many steps there are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplery.functions.pixels import as_dtype, convert
from samplery.shipping import ship
from samplery.sources.records import decode_raw

#: What a facet is in a result: its kind, size, and pixels by row, column and channel.
FACET = "struct<kind:string,width:bigint,height:bigint,channels:int,data:{}>"
IMAGE, LABEL, FEATURE, NONE = "IMAGE", "LABEL", "FEATURE", "NONE"
#: ``function(pixels (h, w, channels), numbers, nearest) -> pixels``.
Change = Callable[[np.ndarray, list[float], bool], np.ndarray]


class Sample:
    """One row's matrices (h, w, channels; None: no pixels) and kinds, while the noted work runs."""

    def __init__(self, images: list[np.ndarray | None], kinds: list[str]) -> None:
        self.images, self.kinds = images, kinds


@dataclass
class Frame:
    """Names of the size columns of some facets, of whose they are, and of the shape columns in it by facet."""

    width: str
    height: str
    facets: list[int]
    shapes: dict[int, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Input:
    """Where a facet's pixels come from: a column of numbers of a frame's size, or of a raw matrix's bytes that become ``channels`` of ``dtype``."""

    column: str
    raw: bool = False
    channels: int = -1
    dtype: str = "float32"


@dataclass
class Plan:
    """What is known of a pipeline before it runs. Its first frame's columns are ``width``, ``height`` and ``shapes``."""

    config: object
    frames: list[Frame]
    kinds: list[str]
    inputs: dict[int, Input]
    notes: list[tuple[Callable[[Sample, list[float]], None], int]] = field(default_factory=list)
    slots: list[str] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)
    pixels: set[int] = field(default_factory=set)
    pyramids: list[int] = field(default_factory=list)
    masks: list[int] = field(default_factory=list)
    later: dict[int, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.pixels |= set(self.inputs)

    @property
    def perturb(self) -> bool:
        return self.config.perturb

    @property
    def seed(self) -> int:
        return self.config.seed

    def facet(self, number: int) -> int:
        """A facet's number, -1 for the last one; an unknown one is an error."""
        own = len(self.kinds) - 1 if number < 0 else number
        if not 0 <= own < len(self.kinds):
            raise ValueError(f"there is no facet {number}")
        return own

    def frame(self, facet: int) -> Frame:
        return next(f for f in self.frames if facet in f.facets or facet in f.shapes)

    def shapes(self, facet: int) -> tuple[Frame, str]:
        """The frame and the column of an annotation's shapes."""
        for f in self.frames:
            if facet in f.shapes:
                return f, f.shapes[facet]
        raise ValueError(f"facet {facet} is no annotation")

    def move(self, facet: int, frame: Frame) -> None:
        """From now on the facet's pixels follow the frame."""
        for f in self.frames:
            if facet in f.facets:
                f.facets.remove(facet)
        frame.facets.append(facet)

    def append(self, kind: str, frame: Frame) -> int:
        self.kinds.append(kind)
        frame.facets.append(len(self.kinds) - 1)
        self.pixels.add(len(self.kinds) - 1)
        return len(self.kinds) - 1

    def note(self, rows: DataFrame, work: Callable[[Sample, list[float]], None], numbers: Column | Sequence[Column] = ()) -> DataFrame:
        """Notes work on each row's sample. Rows in which a flag is not set are passed over."""
        name = f"__n{len(self.slots)}"
        own = (F.array(*[n.cast("double") for n in numbers]) if numbers else F.array().cast("array<double>")) if not isinstance(numbers, Column) else numbers
        for f in self.flags:
            own = F.when(F.col(f), own)
        self.slots.append(name)
        self.notes.append((work, len(self.slots) - 1))
        return rows.withColumn(name, own)

    def each(self, rows: DataFrame, facets: Sequence[int], change: Change, numbers: Sequence[Column] = (), kinds: Sequence[str] = (IMAGE, LABEL)) -> DataFrame:
        """Notes a change of these facets' pixels, where they have some and are of these kinds."""
        own = [f for f in facets if f in self.pixels]
        return self.note(rows, _Each(own, change, tuple(kinds)), numbers) if own else rows

    def run(self, rows: DataFrame, data: str = "array<double>", dtype: str = "float32") -> DataFrame:
        """Runs what is noted: adds ``facets``, an array of ``FACET`` with pixels as numbers, or as ``data`` = 'binary' bytes of ``dtype``; what is noted later runs on these."""
        ship(rows.sparkSession)
        inputs = sorted(self.inputs)
        columns = [F.col(self.inputs[k].column) if self.inputs[k].raw else F.col(self.inputs[k].column).cast("array<double>") for k in inputs]
        worker = _worker(list(self.kinds), [(k, self.inputs[k]) for k in inputs], list(self.notes), data, dtype)
        arguments = F.array(*[F.col(s) for s in self.slots]) if self.slots else F.array().cast("array<array<double>>")
        first = F.array(*[F.col(f"__begun{k}") for k in inputs]) if inputs else F.array().cast("array<array<double>>")
        work = F.arrow_udf(worker, f"array<{FACET.format(data)}>").asNondeterministic()  # else a filter on what it gives would run it twice
        return rows.withColumn("facets", work(first, arguments, *columns)).drop(*self.slots, *[f"__begun{k}" for k in inputs])

    def ran(self, inputs: dict[int, Input]) -> None:
        """Starts anew after a run, from what it has left."""
        self.inputs, self.notes, self.slots, self.pyramids = inputs, [], [], []
        for k, kind in self.later.items():
            self.kinds[k] = kind

    def begin(self, rows: DataFrame) -> DataFrame:
        """Keeps the sizes that the inputs have before any step."""
        own = {k: self.frame(k) for k in sorted(self.inputs)}
        return rows.withColumns({f"__begun{k}": F.array(F.col(f.width).cast("double"), F.col(f.height).cast("double")) for k, f in own.items()})


class _Each:
    def __init__(self, facets: list[int], change: Change, kinds: tuple[str, ...]) -> None:
        self.facets, self.change, self.kinds = facets, change, kinds

    def __call__(self, sample: Sample, numbers: list[float]) -> None:
        for f in self.facets:
            image, kind = sample.images[f], sample.kinds[f]
            if image is not None and kind in self.kinds:
                sample.images[f] = np.asarray(self.change(image, numbers, kind == LABEL), np.float64)


def _matrix(values: np.ndarray, width: float | None, height: float | None) -> np.ndarray:
    """Numbers as an image of this size, which must be a whole number of channels."""
    w, h = int(width or 0), int(height or 0)
    if w * h < 1 or len(values) % (w * h):
        if w * h == 0 and len(values) == 0 and width is not None:
            return np.zeros((h, w, 1))
        raise ValueError(f"{len(values)} numbers are no image of {w} x {h} pixels")
    return values.reshape(h, w, -1)


def _raw(content: bytes | None, own: Input) -> np.ndarray | None:
    try:
        m = decode_raw(content or b"")
    except ValueError:
        return None
    return convert(m[..., None] if m.ndim == 2 else m, own.channels, own.dtype)


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    """Rows of an array of lists of numbers as views of its values."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[at[k] : at[k + 1]] if valid[k] else None for k in range(len(column))]


def _nested(column: pa.Array) -> list[list[np.ndarray | None]]:
    """Rows of an array of lists of lists of numbers."""
    at, inner = column.offsets.to_numpy(), _lists(column.values)
    return [inner[at[k] : at[k + 1]] for k in range(len(column))]


def _worker(kinds: list[str], inputs: list[tuple[int, Input]], notes: list, data: str, dtype: str) -> Callable[..., pa.Array]:
    def run(first: pa.Array, arguments: pa.Array, *columns: pa.Array) -> pa.Array:
        own = [c.to_pylist() if i.raw else _lists(c) for (_, i), c in zip(inputs, columns, strict=True)]
        out: list[Sample] = []
        for row, (sizes, numbers) in enumerate(zip(_nested(first), _nested(arguments), strict=True)):
            sample = Sample([None] * len(kinds), list(kinds))
            for place, (k, i) in enumerate(inputs):
                x = own[place][row]
                if x is not None:
                    w, h = (None if v != v else v for v in sizes[place])
                    sample.images[k] = _raw(x, i) if i.raw else _matrix(x, w, h)
            for work, slot in notes:
                if numbers[slot] is not None:
                    work(sample, numbers[slot].tolist())
            out.append(sample)
        return _facets(out, len(kinds), data, dtype)

    run.__annotations__ = {"first": pa.Array, "arguments": pa.Array, "columns": pa.Array, "return": pa.Array}
    return run


def _facets(samples: list[Sample], count: int, data: str, dtype: str) -> pa.Array:
    """Samples as an array of ``count`` facets a row; those of kind ``NONE`` have no pixels."""
    flat = [(k, x) for s in samples for k, x in zip(s.kinds, s.images, strict=True)]
    shown = [None if k == NONE else x for k, x in flat]
    shape = lambda n, kind: pa.array([None if x is None else x.shape[n] for x in shown], kind)
    if data == "binary":
        pixels = pa.array([None if x is None else as_dtype(x, dtype).tobytes() for x in shown], pa.binary())
    else:
        lengths = np.array([0 if x is None else x.size for x in shown], np.int64)
        values = np.concatenate([x.ravel() for x in shown if x is not None]) if lengths.any() else np.zeros(0)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        pixels = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.float64)), mask=pa.array([x is None for x in shown], pa.bool_()))
    each = pa.StructArray.from_arrays([pa.array([k for k, _ in flat], pa.string()), shape(1, pa.int64()), shape(0, pa.int64()), shape(2, pa.int32()), pixels], ["kind", "width", "height", "channels", "data"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(samples) + 1, dtype=np.int32) * count), each)


def of_rows(rows: DataFrame, config) -> Plan:
    """The plan of rows with ``width`` and ``height`` and, if there, ``image``, ``label`` (a mask of the same size) and ``shapes``: facet 0 is the image, facet 1 the annotation."""
    frame = Frame("width", "height", [0], {1: "shapes"} if "shapes" in rows.columns else {})
    inputs = {k: Input(c) for k, c in ((0, "image"), (1, "label")) if c in rows.columns}
    kinds = [IMAGE] + [LABEL] * (bool(frame.shapes) or "label" in rows.columns)
    if len(kinds) > 1:
        frame.facets.append(1)
    return Plan(config, [frame], kinds, inputs)
