"""Embedding near-dedup: random-hyperplane hashing in several tables, exact cosines, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplery.llm.bitslice import local_roots
from samplery.llm.common import attach, col, connected_components, deal_buckets, free_prefix, materialize, scratched
from samplery.shipping import map_arrow

#: Chance that all tables miss a pair that lies exactly at the threshold; closer pairs are missed far more rarely.
MISS = 1e-9
#: Vectors to a block of a large bucket, and the bucket size that the number of hash bits aims at.
BLOCK, AIM = 512, 64
#: Rows that a task gathers before it compares them.
ROWS = 1 << 14
#: Bits of a sketch.
SKETCH = 256
#: What is known of a candidate: its bucket's group and its number.
CANDIDATE = ("grp", "row", "t", "blk", "cross")


def table_sizes(largest: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits to a table and number of tables for labels of up to ``largest`` different vectors.

    The bits follow the number of vectors, so that unlike vectors share a bucket with about ``AIM`` others at any
    size; the tables follow the bits, so that the chance to miss a pair doesn't grow.
    """
    bits = max(4, math.ceil(math.log2(max(1, largest) / AIM)))
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, 1 if agree >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, also where squares would overflow or vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sketch_radius(threshold: float, miss: float = MISS) -> int:
    """Differing bits of two sketches beyond which vectors at the threshold lie with a chance of at most ``miss``."""
    p, n = math.acos(min(1.0, threshold)) / math.pi, SKETCH
    beyond = 1.0
    for k in range(n + 1):
        beyond -= math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if beyond <= miss:
            return k
    return n


class Planes:
    """Random hyperplanes of each vector length, the same in every task: ``bits * tables`` of the tables, then ``SKETCH`` of the sketch."""

    def __init__(self, bits: int, tables: int, seed: int) -> None:
        self.bits, self.tables, self.seed = bits, tables, seed
        self.own: dict[int, np.ndarray] = {}

    def sides(self, x: np.ndarray) -> np.ndarray:
        dim = x.shape[1]
        if dim not in self.own:
            self.own[dim] = np.random.default_rng([self.seed, dim]).standard_normal((dim, self.bits * self.tables + SKETCH))
        return x @ self.own[dim] >= 0

    def signs(self, sides: np.ndarray) -> np.ndarray:
        """(n, tables) numbers of the tables' bits."""
        own = sides[:, : self.bits * self.tables].reshape(len(sides), self.tables, self.bits)
        return (own * (1 << np.arange(self.bits, dtype=np.int64))).sum(axis=2)


def _vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all vectors and where each begins and ends."""
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), ends - ends[0]


def _signatures(bits: int, tables: int, seed: int):
    """Per node its sketch and the number of its bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Planes(bits, tables, seed)
        for b in batches:
            values, ends = _vectors(b.column("embedding"))
            dims = np.diff(ends)
            signs, sketch = np.zeros((len(dims), tables), np.int64), np.zeros((len(dims), SKETCH // 8), np.uint8)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                sides = planes.sides(unit_rows(values[ends[at][:, None] + np.arange(dim)]))
                signs[at], sketch[at] = planes.signs(sides), np.packbits(sides[:, -SKETCH:], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1) * tables, pa.int32()), pa.array(signs.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("row"), pa.array(dims, pa.int32()), pa.array([x.tobytes() for x in sketch], pa.binary()), lists], ["label", "row", "dim", "sketch", "signs"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a partition sorted by ``grp`` in tables of about ``ROWS`` rows that cut no group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(len(x) for x in held) >= ROWS:
            rows = pa.Table.from_batches(held)
            grp = rows.column("grp").to_numpy()
            whole = int(np.searchsorted(grp, grp[-1]))  # the last group may go on
            if whole:
                yield rows.slice(0, whole).combine_chunks()
                held = rows.slice(whole).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _groups(rows: pa.Table) -> Iterator[tuple[int, int]]:
    """First and last row of each group of at least two."""
    grp = rows.column("grp").to_numpy()
    first = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]]) if len(grp) else np.zeros(0, int)
    return ((lo, hi) for lo, hi in zip(first, np.r_[first[1:], len(grp)], strict=True) if hi - lo > 1)


def _candidates(radius: int):
    """Per complete group the rows that some other one to be compared lies near by sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(rows), -1)
            block, cross = rows.column("blk").to_numpy(), rows.column("cross").to_numpy()
            near = np.zeros(len(rows), bool)
            for lo, hi in _groups(rows):
                own = sketch[lo:hi]
                for k in range(0, hi - lo, BLOCK):
                    part = own[k : k + BLOCK]
                    apart = np.zeros((len(part), hi - lo), np.uint16)
                    for word in range(own.shape[1]):
                        apart += np.bitwise_count(part[:, word, None] ^ own[None, :, word])
                    close = apart <= radius
                    close[np.arange(len(part)), k + np.arange(len(part))] = False
                    if cross[lo]:
                        close &= block[lo + k : lo + k + len(part), None] != block[None, lo:hi]
                    near[lo + k : lo + k + len(part)] |= close.any(axis=1)
            yield pa.RecordBatch.from_arrays([rows.column(c).combine_chunks() if rows.column(c).num_chunks != 1 else rows.column(c).chunk(0) for c in CANDIDATE], list(CANDIDATE)).filter(pa.array(near))

    return run


def _compare(threshold: float, bits: int, tables: int, seed: int):
    """Per complete group: exact cosines; a link counts in the first table in which the two vectors share a bucket.

    Rows with n = 0 are edges between nodes' ids, the others the links that a node's number gets.
    """

    def links(x: np.ndarray, block: np.ndarray, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(x), BLOCK):
            close = x[k : k + BLOCK] @ x.T >= threshold
            i, j = np.nonzero(close)
            i = i + k
            ok = i < j
            if cross:
                ok &= block[i] != block[j]
            yield i[ok], j[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Planes(bits, tables, seed)
        for rows in _whole_groups(batches):
            row, node, copies, table, block, cross = (rows.column(c).to_numpy() for c in ("row", "node", "copies", "t", "blk", "cross"))
            values, ends = _vectors(rows.column("embedding").combine_chunks())
            nodes, counts, us, vs = [], [], [], []
            for lo, hi in _groups(rows):
                x = unit_rows(values[ends[lo] : ends[hi]].reshape(hi - lo, -1))
                own, sign = row[lo:hi], None
                for i, j in links(x, block[lo:hi], bool(cross[lo])):
                    if not len(i):
                        continue
                    root = local_roots(len(own), i, j)
                    linked = root != np.arange(len(own))
                    us.append(node[lo:hi][linked])
                    vs.append(node[lo:hi][root[linked]])
                    sign = planes.signs(planes.sides(x)) if sign is None else sign
                    new = ~(sign[i, : table[lo]] == sign[j, : table[lo]]).any(axis=1)
                    i, j = i[new], j[new]
                    count = np.bincount(i, copies[lo:hi][j], len(own)) + np.bincount(j, copies[lo:hi][i], len(own))
                    nodes.append(own[count > 0])
                    counts.append(count[count > 0].astype(np.int64))
            empty = np.zeros(0, np.int64)
            edges, counted = np.concatenate([empty, *us]), np.concatenate([empty, *nodes])
            v = np.r_[np.concatenate([empty, *vs]), counted]
            n = np.r_[np.zeros(len(edges), np.int64), np.concatenate([empty, *counts])]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[edges, counted]), pa.array(v), pa.array(n)], ["u", "v", "n"])

    return run


@scratched
def embedding_duplicates(vectors: DataFrame, threshold: float = 0.98, seed: int = 11, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each row: links join vectors of one label with cosine >= ``threshold``.

    Equal vectors of a label are one node with a count, so copies never meet in a task; nodes are hashed by the signs
    of random projections into several tables (``table_sizes``). What goes to the buckets of all tables are sketches,
    ``SKETCH`` more signs of a node: only nodes with another one near by sketch get their vectors, are compared
    exactly in double precision, and each link is counted in the first table where it shows. Buckets over ``BLOCK``
    nodes are dealt over pairs of blocks. Only vectors of equal length compare.

    Nulls: a row with a null id, label or vector, or a vector that is empty, zero or holds a null or non-finite value
    links with nothing: its component is its own id, and it is kept unless its id is null. Equal rows are linked
    copies of one another. Rows that share an id are classed each by its own vector. No rows: no rows. Other columns
    don't matter.
    """
    rows = vectors.select(col(id_col).alias("vec_id"), col(label_col).alias("label"), col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    keyed = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("a", F.xxhash64("embedding")).withColumn("b", F.xxhash64(F.lit(7), "embedding"))
    nodes = keyed.where("ok").groupBy("label", "a", "b").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    nodes = materialize(nodes.withColumn("row", F.monotonically_increasing_id()), "vector-nodes")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = table_sizes(largest, threshold)
    kinds = dict(nodes.dtypes)
    signed = map_arrow(nodes.select("label", "row", "embedding"), _signatures(bits, tables, seed), f"label {kinds['label']}, row long, dim int, sketch binary, signs array<long>")
    signed = materialize(signed, "vector-signs")
    keys = signed.select("label", "dim", "row", "sketch", F.posexplode("signs").alias("t", "sign"))
    dealt = deal_buckets(keys, ["label", "dim", "t", "sign"], "row", BLOCK)
    dealt = dealt.select("grp", "row", "t", "blk", "cross", "sketch").repartition("grp").sortWithinPartitions("grp")
    near = materialize(map_arrow(dealt, _candidates(sketch_radius(threshold)), "grp long, row long, t int, blk int, cross boolean"), "vector-candidates")
    whole = nodes.select(F.col("row").alias("r"), "node", "copies", "embedding")
    fetched = near.join(whole, near["row"] == whole["r"]).drop("r").repartition("grp").sortWithinPartitions("grp")
    found = materialize(map_arrow(fetched, _compare(threshold, bits, tables, seed), "u long, v long, n long"), "vector-links")
    links = found.where("n > 0").groupBy(F.col("u").alias("l")).agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("n = 0").select("u", "v"))
    known = nodes.join(links, nodes["row"] == links["l"], "left").join(parts.withColumnRenamed("node", "p"), F.col("node") == F.col("p"), "left")
    known = known.select(F.col("label").alias("kl"), F.col("a").alias("ka"), F.col("b").alias("kb"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    known = materialize(known, "vector-classes", keep=True)
    narrow = keyed.select("vec_id", "label", "a", "b", "ok")
    out = narrow.join(known, (narrow["label"] == known["kl"]) & (narrow["a"] == known["ka"]) & (narrow["b"] == known["kb"]) & narrow["ok"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


@scratched
def without_duplicates(vectors: DataFrame, **options) -> DataFrame:
    """The rows of kept vectors with all columns of ``vectors``. Ids are taken to be unique: rows that share one stay if one of them is kept; those without an id go."""
    p, id_col = free_prefix(vectors), options.get("id_col", "vec_id")
    kept = embedding_duplicates(vectors, **options).where("kept").select(F.col("vec_id").alias(p + "id")).distinct()
    return attach(vectors, materialize(kept, "kept-vectors", keep=True), [(id_col, p + "id")], "left_semi")
