"""One path from a record table to training batches: sample, fetch, decode, transform, batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields, replace
from itertools import groupby
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplery.functions import pixels as P
from samplery.functions import shapes as S
from samplery.plans import sampling as M
from samplery.plans import transforms
from samplery.plans.facets import IMAGE, LABEL, Frame, Input, Plan
from samplery.sources import records as R

#: Rows of the second file get serial numbers from here on, so that one number names a row.
SECOND = 1 << 40
#: Rows of a slice of an endless stream (a batch at least), whose records are fetched by one filter, and draws that are planned at once.
SLICE_ROWS, PLANNED = 2048, 16384
#: Rows, in whole batches, that a task decodes for an ordered stream.
TASK_ROWS = 256
_KEYS = {f.name for f in fields(M.SampleConfig)}
_MIXIN = {"mixin": None, "mixin_group_reset": -1, "mixin_group_delta": 0, "mixin_max": 0, "mixin_randomize": False}
_CLUSTERS = {"preload", "threads", "dump"}
#: Steps that take the shapes out of an annotation.
_TAKES = ("rasterize", "anchors.", "box_feature", "keypoints.", "drop")


class Meta(NamedTuple):
    """Ids and labels of a batch, and a list of bytes for each raw field."""

    ids: np.ndarray
    labels: np.ndarray
    raw: list[list[bytes]]


def read_config(given: dict[str, Any]) -> tuple[M.SampleConfig, dict[str, Any]]:
    """Sampling configuration and the other keys (``db``, ``cache``, ``mixin*``) of a plain dictionary. Every key is obeyed or refused."""
    rest = dict(_MIXIN, db=None, cache=True)
    own = {}
    for key, value in given.items():
        if key in _KEYS:
            own[key] = tuple(value or ()) if isinstance(value, (list, tuple)) or (key == "annotate" and not value) else value
        elif key in rest:
            rest[key] = value
        elif key in _CLUSTERS:
            raise ValueError(f"{key} is not a setting here: tasks and executors are the cluster's, and results are columns")
        else:
            raise ValueError(f"unknown key {key}")
    config = M.SampleConfig(**own)
    if config.raw and min(config.raw) < 0 or not config.images or min(config.images) < 0:
        raise ValueError("fields are numbered from 0, and a stream has at least one image")
    return config, rest


def decoded(rows: DataFrame, config: M.SampleConfig, packed: bool = False) -> DataFrame:
    """Records (``serial``, ``fields``) with the facets that the configuration asks for, after its transforms: structs ``image<k>`` and ``label<k>``, then ``added<k>`` that steps have appended; ``targets`` that they have made, ``kinds`` of the facets and ``left``, how many shapes annotations still have; ``auto``, the first image again as its own label, for an autoencoder.

    All facets of a row are transformed by the same parameters, which are drawn from its serial number, and in one
    pass through Python. An annotation is JSON, whose shapes live in the first image's frame, or an image, a label of
    its own size. Pixels are numbers, or bytes of the configured type if ``packed``.
    """
    first = len(config.images)
    binary = lambda f: R.field(F.col("fields"), f)
    rest = [c for c in rows.columns if c != "fields"]
    own = rows.withColumns({f"raw{k}": binary(f) for k, f in enumerate(config.raw)} | {f"__bytes{k}": binary(f) for k, f in enumerate((*config.images, *config.annotate))} | {f"__type{k}": R.field_type(F.col("fields"), f) for k, f in enumerate(config.annotate)}).drop("fields")
    frames, inputs = [], {}
    for k in range(first + len(config.annotate)):
        name = ("width", "height") if k == 0 else (f"width_{k}", f"height_{k}")
        size = R.raw_size(F.col(f"__bytes{k}"))
        own = own.withColumns({n: size[n.split("_")[0]] for n in name})
        frames.append(Frame(*name, [k]))
        inputs[k] = Input(f"__bytes{k}", True, *((config.channels, config.dtype) if k < first else (-1, "float32")))
    for k in range(len(config.annotate)):
        text = F.decode(F.col(f"__bytes{first + k}"), "UTF-8")
        kind = F.when(F.col(f"__type{k}") == R.NONE, R.sniff(text)).otherwise(F.col(f"__type{k}"))
        column = "shapes" if k == 0 else f"shapes_{k}"
        own = own.withColumn(column, S.shapes_of(F.when(kind == R.ANNOTATION_JSON, text), F.col("width"), F.col("height")))
        frames[0].shapes[first + k] = column
    plan = Plan(config, frames, [IMAGE] * first + [LABEL] * len(config.annotate), inputs)
    transforms.validate(config.transforms)
    if any(t["type"] not in transforms.NOTED for t in transforms.flat(config.transforms)):
        raise ValueError("a stream takes the library's own steps; apply others to its rows")
    own = transforms.steps(plan.begin(own), config.transforms, plan)
    shapes = list(frames[0].shapes.values())
    left = F.array(*[F.size(c) for c in shapes]) if shapes else F.array().cast("array<int>")
    out = plan.run(own.withColumn("left", left), "binary" if packed else "array<double>", config.dtype)
    facet = lambda k: F.col("facets")[k]
    shown = {f"{'image' if k < first else 'label'}{k if k < first else k - first}": k for k in inputs} | {f"added{n}": k for n, k in enumerate(range(len(inputs), len(plan.kinds)))}
    structs = [F.when(facet(k)["data"].isNotNull(), facet(k).dropFields("kind")).alias(name) for name, k in shown.items()]
    return out.select(*rest, *[f"raw{k}" for k in range(len(config.raw))], *structs, F.transform("facets", lambda f: f["kind"]).alias("kinds"), "left", *[c for c in ("targets",) if c in out.columns], *([structs[0].alias("auto")] if config.autoencoder else []))


def batch_pictures(rows: DataFrame, size: int, batches: int) -> DataFrame:
    """``name`` and ``content`` of PNGs of the first ``batches`` batches of ``size`` draws: ``{batch}_{facet}_{place in the batch}.png``.

    ``rows`` are those of ``ImageStream.rows``. Facets are its images, then its annotations, then what steps have appended. What is missing, dropped or
    a feature, or has neither 1 nor 3 channels, gives no picture but keeps its number.
    """
    facets = [c for kind in ("image", "label", "added") for c in rows.columns if c.removeprefix(kind).isdigit()]
    own = rows.where(F.col("draw") < size * batches)
    pictured = F.array(*[F.when(~F.get("kinds", F.lit(k)).isin("NONE", "FEATURE"), F.struct(F.lit(k).alias("facet"), F.col(c).alias("own"))) for k, c in enumerate(facets)])
    each = own.select("draw", F.explode(pictured).alias("x")).where(F.col("x.own.channels").isin(1, 3))
    name = F.concat(F.concat_ws("_", F.floor(F.col("draw") / size).cast("long"), "x.facet", (F.col("draw") % size).cast("long")), F.lit(".png"))
    return each.select(name.alias("name"), P.png_encoder(rows.sparkSession)(F.col("x.own.data"), F.col("x.own.width"), F.col("x.own.height")).alias("content"))


class ImageStream:
    """Batches of a record table for a dictionary of settings: iterating yields lists of ``Meta`` and one numpy array per facet (None for a facet that was dropped or has nothing).

    ``rows`` is the same as a DataFrame, for jobs that stay on the cluster. An endless stream (``loop``) is planned
    slice by slice, so its only state is a draw number.
    """

    def __init__(self, spark: SparkSession, config: dict[str, Any]) -> None:
        self.config, rest = read_config(config)
        if rest["db"] is None:
            raise ValueError("db is missing")
        self.spark, self.tables = spark, [R.read(spark, rest["db"])]
        self.index = R.index(self.tables[0]).withColumn("file", F.lit(0))
        if rest["mixin"]:
            self.tables.append(R.read(spark, rest["mixin"]))
            second = R.index(self.tables[1]).withColumn("serial", F.col("serial") + SECOND)
            self.index = M.mixin(self.index, second, rest["mixin_group_reset"], rest["mixin_group_delta"], rest["mixin_max"], rest["mixin_randomize"], self.config.seed)
        self.index = self.index.select("id", "label", "grp", "serial")
        if rest["cache"] and self.config.loop:
            self.index = self.index.persist()
        self.config = M.usable_groups(self.index, self.config)
        self.reset()

    def close(self) -> None:
        """Lets go of the index that an endless stream keeps."""
        self.index.unpersist()

    def __enter__(self) -> ImageStream:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _records(self, serials: list[int] | None = None) -> DataFrame:
        """``serial`` and ``fields`` of all records, or of these by filters that reach the scans."""
        parts = []
        for k, t in enumerate(self.tables):
            own = t if serials is None else R.at_serials(t, [s - k * SECOND for s in serials if s // SECOND == k])
            parts.append(own.select((F.col("serial") + k * SECOND).alias("serial") if k else F.col("serial"), "fields"))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _decoded(self, chosen: DataFrame, packed: bool) -> DataFrame:
        # a draw repeats a record in every epoch, and each time with other parameters
        key = F.concat_ws(":", "serial", "draw") if self.config.loop else F.col("serial")
        return decoded(chosen.withColumn("serial", key), self.config, packed)

    def _plan(self, offset: int, draws: int | None) -> DataFrame:
        if self.config.loop:
            if draws is None:
                raise ValueError("an endless stream has no last draw")
            plan = M.looped_draws(self.index, self.config, draws, offset, True)
        else:
            plan = M.draw_order(self.index, self.config)
            if offset or draws is not None:
                plan = plan.where((F.col("draw") >= offset) & (F.col("draw") < (offset + draws if draws is not None else 1 << 62)))
        return plan.select(F.col("draw").cast("long").alias("draw"), "id", "label", "serial")

    def rows(self, offset: int = 0, draws: int | None = None, packed: bool = False) -> DataFrame:
        """``draw``, ``id``, ``label`` and the facets (see ``decoded``) of the draws from ``offset`` on; all of a finite stream if ``draws`` is None."""
        return self._decoded(M.with_payload(self._plan(offset, draws), self._records()), packed)

    def slice_rows(self, plan: list) -> DataFrame:
        """The rows of a slice's plan (``draw``, ``id``, ``label``, ``serial``, at most a slice long): its serials are a filter on the scan, and the plan is handed to the tasks, so that no payload is joined by a shuffle."""
        schema = self.index.select("id", "label", "serial").schema
        local = self.spark.createDataFrame(plan, "draw long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))
        serials = [r["serial"] for r in plan]
        records = self._records(serials if len(serials) <= max(SLICE_ROWS, 1) else None)
        return records.join(F.broadcast(local), "serial")

    def size(self) -> int:
        """Rows that a pass over the table yields."""
        return M.split(self.index, self.config).count()

    __len__ = size

    def reset(self) -> None:
        self._batches = self._fetch()

    def __iter__(self) -> Iterator[list]:
        self.reset()
        return self

    def __next__(self) -> list:
        return next(self._batches)

    next = __next__

    def _fetch(self) -> Iterator[list]:
        size = self.config.batch
        if not self.config.loop:
            yield from self._numpy(M.with_payload(self._plan(0, None), self._records()), 0, self.size())
            return
        step, at = max(1, SLICE_ROWS // size) * size, 0
        while True:
            planned = max(1, PLANNED // step) * step  # index rows alone, and no more than that
            plan = sorted(self._plan(at, planned).collect())
            if not plan:
                return
            for first in range(at, at + planned, step):
                own = [r for r in plan if first <= r["draw"] < first + step]
                yield from self._numpy(self.slice_rows(own), first, step)
            at += planned

    def _numpy(self, chosen: DataFrame, first: int, count: int) -> Iterator[list]:
        """Batches of the ``count`` draws from ``first`` on: undecoded records move once, to the task of their range of draws, and rows come in order from there."""
        size = self.config.batch
        per = max(1, TASK_ROWS // size) * size
        own = chosen.repartitionById(max(1, -(-count // per)), F.floor((F.col("draw") - first) / per).cast("int")).sortWithinPartitions("draw")
        rows = self._decoded(own, True)
        for _, batch in groupby(rows.toLocalIterator(prefetchPartitions=True), lambda r: r["draw"] // size):
            each = list(batch)
            yield to_numpy({"rows": len(each)} | {c: [r[c] for r in each] for c in rows.columns}, self.config)


def to_numpy(batch: dict[str, Any], config: M.SampleConfig) -> list:
    """``Meta`` and the facets of one batch of ``decoded`` rows."""
    n = batch["rows"]
    out: list = [Meta(np.array(batch["id"], np.int64), np.array(batch["label"], np.float32), [[bytes(x) for x in batch[f"raw{k}"]] for k in range(len(config.raw))])]
    names = [t["type"] for t in transforms.flat(config.transforms)]
    first = len(config.images)
    added = sum(c.removeprefix("added").isdigit() for c in batch)
    for k, name in enumerate([*(f"image{k}" for k in range(first)), *(f"label{k}" for k in range(len(config.annotate))), *(f"added{k}" for k in range(added))]):
        kinds = [row[k] for row in batch["kinds"]]
        if name.startswith("label") and any(row[k - first] and kind != "NONE" for row, kind in zip(batch["left"], kinds, strict=True)) and not any(step.startswith(_TAKES) for step in names):
            raise ValueError("an annotation was not rasterized: add a rasterize step, or drop it")
        out.append(stacked(batch[name], n, config, kinds, k < first))
        if config.autoencoder and k == first + len(config.annotate) - 1:
            out.append(stacked(batch["auto"], n, config, [row[0] for row in batch["kinds"]], True))
    made = batch.get("targets") or []
    for name in dict.fromkeys((k, t["name"]) for row in made for k, t in enumerate(row or ())):
        each = [row[name[0]] if row and len(row) > name[0] and row[name[0]]["name"] == name[1] else None for row in made]
        if name[1] == "box_feature":
            out.append(np.array([[b, *v] for b, t in enumerate(each) if t is not None for v in np.reshape(t["data"], (-1, 6))], np.float32).reshape(-1, 7))
        else:
            out.append(stacked(each, n, replace(config, dtype="float32"), ["LABEL"] * n, False))
    return out


def stacked(images: list, n: int, config: M.SampleConfig, kinds: list[str], colour: bool) -> np.ndarray | None:
    """Images of one shape as one array, missing and dropped ones zero; None without any. Features give their rows, each after the image's place in the batch; they do not mix with others."""
    own = [None if x is None or x["data"] is None or kind == "NONE" else x for x, kind in zip(images, kinds, strict=True)]
    some = [(x, kind == "FEATURE") for x, kind in zip(own, kinds, strict=True) if x is not None]
    if not some:
        return None
    if len({feature for _, feature in some}) > 1:
        raise ValueError("a facet is a feature in some rows of a batch only")
    if some[0][1]:
        return np.array([[b, *v] for b, x in enumerate(own) if x is not None for v in _values(x, config).reshape(x["height"], -1)], config.dtype)
    shapes = {(x["height"], x["width"], x["channels"]) for x, _ in some}
    if len(shapes) > 1:
        raise ValueError(f"images of a batch must have one shape, not {sorted(shapes)}")
    out = np.zeros((n, *shapes.pop()), config.dtype)
    for k, x in enumerate(own):
        if x is not None:
            out[k] = _values(x, config).reshape(out.shape[1:])
    if colour and config.colorspace == "RGB" and out.shape[-1] == 3:
        out = out[..., ::-1]
    return out.transpose(0, 3, 1, 2) if config.order == "NCHW" else out


def _values(facet: dict, config: M.SampleConfig) -> np.ndarray:
    """A facet's numbers in the configured type, from numbers or from packed bytes of that type."""
    data = facet["data"]
    return np.frombuffer(data, config.dtype) if isinstance(data, (bytes, bytearray)) else P.as_dtype(np.asarray(data), config.dtype)


class ImageLoader:
    """Single images through the same decoding and transforms: an array of one image."""

    def __init__(self, spark: SparkSession, config: dict[str, Any]) -> None:
        self.spark = spark
        self.config, _ = read_config({k: v for k, v in config.items() if k != "db"})
        self.config = replace(self.config, images=(0,), annotate=(), raw=())

    def load_binary(self, image: bytes) -> np.ndarray:
        """An image as the bytes of a raw matrix."""
        rows = self.spark.createDataFrame([(0, bytearray(image))], "serial long, bytes binary")
        return self._one(rows.select("serial", F.array(F.struct(F.lit(R.IMAGE).cast("tinyint").alias("type"), "bytes")).alias("fields")))

    def load_path(self, path: str) -> np.ndarray:
        """An image file that Spark's ``image`` source reads."""
        return self._one(R.import_images(self.spark, path).select("serial", "fields"))

    def _one(self, rows: DataFrame) -> np.ndarray:
        row = decoded(rows, self.config, True).first()
        got = stacked([row["image0"]], 1, self.config, row["kinds"][:1], True)
        if got is None:
            raise ValueError("this is no image")
        return got
