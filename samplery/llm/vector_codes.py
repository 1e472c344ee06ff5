"""Product codes of vectors: each part of a vector becomes the index of its codebook's nearest entry.

Codebooks are bounded by their parameters (entries x length of a vector), so they and a kd-tree for each are handed to
every task of a round; the tasks return integer sums, which Spark adds up. All arithmetic is on integers, so results do
not depend on partitioning or on the order of additions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplery.llm.common import attach, col, columns, free_prefix, materialize, scratched
from samplery.shipping import map_arrow

#: A component x counts as floor(SCALE * x).
SCALE = 256
#: Integers beyond this count as this, so that squared distances of up to 512 components fit a long.
LARGEST = 1 << 26
#: A kd-tree's cell with at most this many entries is searched entry by entry.
LEAF = 8
#: Rows that a task searches at a time.
ROWS = 4096


@dataclass(frozen=True)
class Tree:
    """A kd-tree over a codebook's entries: either a leaf with ``index`` of entries, or a cut of ``axis`` between ``low`` and ``high`` values of its two sides."""

    index: np.ndarray | None = None
    axis: int = 0
    low: int = 0
    high: int = 0
    below: Tree | None = None
    above: Tree | None = None


def kd_tree(entries: np.ndarray, index: np.ndarray | None = None) -> Tree:
    """Cuts the axis of largest spread at its middle entry until a cell has few entries or equal ones only."""
    index = np.arange(len(entries)) if index is None else index
    own = entries[index]
    spread = np.ptp(own, axis=0) if own.size else np.zeros(1)
    if len(index) <= LEAF or not spread.any():
        return Tree(np.sort(index))
    axis = int(spread.argmax())
    order = index[np.argsort(entries[index, axis], kind="stable")]
    values = entries[order, axis]
    cut = int(np.searchsorted(values, values[len(values) // 2], "left")) or int(np.searchsorted(values, values[0], "right"))
    return Tree(None, axis, int(values[cut - 1]), int(values[cut]), kd_tree(entries, order[:cut]), kd_tree(entries, order[cut:]))


def nearest(tree: Tree, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equally near ones) and squared distance of each point, by branch and bound.

    A side is left out only if its bound exceeds the best distance: one with an equal bound may hold a lower index.
    All points of a call go down the tree together.
    """
    best = np.full(len(points), np.iinfo(np.int64).max)
    found = np.full(len(points), len(entries))

    def visit(node: Tree, who: np.ndarray, gaps: np.ndarray) -> None:
        """``gaps``: for each point, its distance to the node's cell along each axis."""
        if not len(who):
            return
        if node.index is not None:
            d = ((points[who, None, :] - entries[node.index][None, :, :]) ** 2).sum(axis=2)
            k = d.argmin(axis=1)
            near, which = d[np.arange(len(who)), k], node.index[k]
            wins = (near < best[who]) | ((near == best[who]) & (which < found[who]))
            best[who[wins]], found[who[wins]] = near[wins], which[wins]
            return
        x = points[who, node.axis]
        first = x - node.low <= node.high - x
        for side in (True, False):
            mine = first == side
            group, own = who[mine], gaps[mine]
            visit(node.below if side else node.above, group, own)
            own = own.copy()
            own[:, node.axis] = np.maximum(own[:, node.axis], (node.high - x[mine]) if side else (x[mine] - node.low))
            maybe = (own**2).sum(axis=1) <= best[group]
            visit(node.above if side else node.below, group[maybe], own[maybe])

    if len(entries):
        visit(tree, np.arange(len(points)), np.zeros_like(points))
    return found, best


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part's codebook, as an integer array (parts, entries, components)."""

    entries: np.ndarray

    def trees(self) -> list[Tree]:
        return [kd_tree(e) for e in self.entries]

    def listed(self) -> str:
        """All components by part, entry and position."""
        return ",".join(map(str, self.entries.ravel().tolist()))

    def assign(self, vectors: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances (rows, parts) of integer vectors."""
        parts, _, size = self.entries.shape
        cut = vectors.reshape(len(vectors), parts, size)
        both = [nearest(t, e, np.ascontiguousarray(cut[:, k])) for k, (t, e) in enumerate(zip(trees, self.entries, strict=True))]
        return np.stack([b[0] for b in both], axis=1), np.stack([b[1] for b in both], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that codes (rows, parts) stand for."""
        return self.entries[np.arange(self.entries.shape[0]), codes].reshape(len(codes), -1)


def _integers(values: pa.Array, width: int) -> np.ndarray:
    """Rows of integer components, shorter ones filled up with zeros."""
    values = values.cast(pa.list_(values.type.value_type))
    offsets = values.offsets.to_numpy()
    flat = np.floor(values.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64) * SCALE)
    whole = np.clip(flat, -LARGEST, LARGEST).astype(np.int64)
    out = np.zeros((len(values), width), np.int64)
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(values)), lengths)
    out[rows, np.arange(len(whole)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = whole
    return out


def valid(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and has only finite components."""
    own = col(vector)
    return vectors.where(own.isNotNull() & ~F.exists(own, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _start(vectors: DataFrame, id: str, vector: str, parts: int, entries: int) -> Codebooks:
    """The vectors of the ``entries`` smallest ids, cut into parts; at most that many rows come to the driver."""
    longest = vectors.agg(F.max(F.size(col(vector)))).first()[0] or 0
    width = -(-longest // parts) * parts
    rows = vectors.select(col(id).alias("i"), col(vector).alias("v")).orderBy(F.col("i").asc_nulls_last(), F.col("v")).limit(entries).collect()
    whole = _integers(pa.array([r.v for r in rows], pa.list_(pa.float64())), width)
    return Codebooks(whole.reshape(len(rows), parts, width // parts).transpose(1, 0, 2).copy())


def _handed(vectors: DataFrame, books: Codebooks) -> Broadcast:
    """The codebooks and their trees for every executor; their size follows from the parameters, not from the rows."""
    return vectors.sparkSession.sparkContext.broadcast((books, books.trees()))


def _sums(handed: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over Arrow batches of vectors that gives, per task, the sums of what each entry has got."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = handed.value
        parts, entries, size = books.entries.shape
        total, count = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _integers(batch.column(0).slice(at, ROWS), parts * size)
                codes, _ = books.assign(x, trees)
                for k in range(parts):
                    np.add.at(total[k], codes[:, k], x[:, k * size : (k + 1) * size])
                    count[k] += np.bincount(codes[:, k], minlength=entries)
        k, e = np.nonzero(count)
        p = np.arange(size)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k, size)), pa.array(np.repeat(e, size)), pa.array(np.tile(p, len(k))), pa.array(np.repeat(count[k, e], size)), pa.array(total[k, e].ravel())], ["part", "entry", "pos", "n", "total"])

    return run


def _moved(books: Codebooks, sums: pd.DataFrame) -> Codebooks:
    """Entries replaced by the floor of their vectors' mean; unused ones stay."""
    entries = books.entries.copy()
    entries[sums.part, sums.entry, sums.pos] = sums.total // sums.n
    return Codebooks(entries)


def fit(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks:
    """Codebooks after ``rounds`` rounds over all valid vectors. What comes to the driver is entries x components in each round."""
    own = valid(vectors, vector)
    books = _start(own, id, vector, parts, entries)
    for _ in range(rounds if books.entries.size else 0):
        each = map_arrow(own.select(col(vector)), _sums(_handed(vectors, books)), "part long, entry long, pos long, n long, total long")
        books = _moved(books, each.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas())
    return books


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """Adds ``__code`` (two hex digits a part, or as many as an index needs) and ``__error`` (long) to the valid vectors' rows."""
    own = valid(vectors, vector)
    names, handed = own.columns, _handed(vectors, books)
    at = names.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = handed.value
        parts, entries, size = books.entries.shape
        digits = max(2, len(f"{max(entries - 1, 0):x}"))
        text = np.array([f"{k:0{digits}x}" for k in range(entries)], dtype=object)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                codes, errors = books.assign(_integers(some.column(at), parts * size), trees)
                code = ["".join(row) for row in text[codes]]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(code, pa.string()), pa.array(errors.sum(axis=1), pa.int64())], [*(f"c{k}" for k in range(len(names))), "code", "error"])

    schema = own.toDF(*[f"c{k}" for k in range(len(names))]).schema.add("code", "string").add("error", "long")
    return map_arrow(own, run, schema).toDF(*names, "__code", "__error")


@scratched
def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Fits codebooks on all vectors, encodes them and sums errors by label: the columns of ``encode`` without the vector, with ``__label_error`` and ``__codebooks``.

    Rows whose vector is null or holds null or non-finite components are left out. Other rows all stay, repeated ids
    too: entries start from the smallest ids (null last, equal ids by their vectors), and with fewer rows than entries
    each row is one. A vector shorter than the longest counts as filled up with zeros, and the longest is filled up to
    a multiple of ``parts``; components beyond +-2^26 after scaling count as that. Null labels are one label. An empty
    table gives an empty result. ``__codebooks`` is the SHA-256 of all entries' components, comma-joined.
    """
    books = fit(vectors, id, vector, parts, entries, rounds)
    p = free_prefix(vectors)
    coded = encode(vectors, books, vector)
    kept = [c for c in coded.columns if c != vector]
    done = materialize(coded.select(columns(kept)), "vector-codes", keep=True)
    by_label = materialize(done.groupBy(col(label).alias(f"{p}label")).agg(F.sum("__error").alias("__label_error")), "label-errors", keep=True)
    return attach(done, by_label, [(label, f"{p}label")]).withColumn("__codebooks", F.sha2(F.lit(books.listed()), 256))
