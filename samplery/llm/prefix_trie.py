"""The trie of conversations' turns, built as a Patricia tree over ranges of the sorted conversations.

A conversation becomes one sortable key: 20 bytes a turn, 16 of a digest of its role and text and 4 of the text's length.
Rows sorted by key and id are cut into ranges; each task builds the compressed tree (points where sequences branch or
end) of its own range, sums over it and expands the edges between its points. A node whose members go on into the next
range lies on the path of a range's first or last key, as deep as that key agrees with its neighbour's: only such
nodes' parts are brought together by a shuffle, and whatever equal keys a range holds, the sort by id spreads over tasks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samplery.llm.common import attach, col, materialize, scratch_dir, scratched
from samplery.shipping import map_arrow

#: Bytes of a turn in a key: a digest, then the length of the text.
TURN, DIGEST = 20, 16
#: Bytes of keys to a range: what one task holds.
RANGE = 16 << 20
#: Rows of an Arrow batch that a task gives out, and characters of a piece of a list of ids.
ROWS, PIECE = 8192, 1 << 20
_NODE = "depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, conv_id long, parent_conv_id long, ends_sha256 string"
#: ``node`` and ``parent`` are prefixes' digests, where a node or its parent has parts in other ranges; ``made`` counts the
#: nodes first seen in this range, so that its sum over all parts is 1; ``piece`` is a part of a list of ids.
_BUILT = f"{_NODE}, node binary, parent binary, range int, at int, piece string"


# --- from turns to keys


def turn_code(role: Column, text: Column) -> Column:
    """40 hexadecimal digits: half a SHA-256 of role and text, and the text's length in bytes; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.concat(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST), F.lpad(F.lower(F.hex(F.octet_length(text))), 8, "0"))


def sequences(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id`` and ``codes``, its turns' codes in order of ``turn`` (null first; equal ones by code). Rows without an id belong to no conversation.

    Only codes are gathered, 40 bytes a turn, never texts.
    """
    coded = turns.where(col(id).isNotNull()).select(col(id).cast("long").alias("conv_id"), F.struct(col(turn).alias("turn"), turn_code(col(role), col(text)).alias("code")).alias("t"))
    return coded.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["code"]).alias("codes"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations that share beginnings: c starts with the first h turns of c - c % 5, h = crc32(c) % 9, and goes on with its own from there."""
    c, h = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    base = own.where(c % 5 == 0).select(c.alias("base"), F.col("codes").alias("first"))
    joined = own.join(base, c - c % 5 == F.col("base"), "left").withColumn("h", h)
    begin = F.slice(F.coalesce("first", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    rest = F.when(F.size("codes") > F.col("h"), F.slice("codes", F.col("h") + 1, F.size("codes"))).otherwise(F.array().cast("array<string>"))
    return joined.select("conv_id", F.concat(begin, rest).alias("codes"))


# --- one range's compressed tree


def _agree(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    n = min(len(a), len(b)) // TURN
    if a[: n * TURN] == b[: n * TURN]:
        return n
    return bisect_left(range(n), True, key=lambda k: a[: (k + 1) * TURN] != b[: (k + 1) * TURN])


class _Point:
    """A branch, end or leaf of a range's tree, with sums over what is below it."""

    __slots__ = ("below", "bytes_in", "bytes_new", "depth", "ends", "first", "last", "leaves", "n", "new", "smallest")

    def __init__(self, depth: int, first: int) -> None:
        self.depth, self.first, self.last = depth, first, first
        self.n = self.leaves = self.bytes_in = self.bytes_new = self.new = 0
        self.smallest: int | None = None
        self.ends: int | None = None
        self.below: list[_Point] = []


class _Range:
    """The sorted keys of one range: distinct keys, where each one's ids begin, and how deep its neighbours agree with it."""

    def __init__(self, number: int, before: int, after: int) -> None:
        self.number, self.before, self.after = number, before, after
        self.keys: list[bytes] = []
        self.ids: list[int] = []
        self.starts: list[int] = []

    def add(self, key: bytes, id: int) -> None:
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
            self.starts.append(len(self.ids))
        self.ids.append(id)

    def sizes(self, k: int) -> list[int]:
        """Lengths of the texts of a key's turns, the root's zero first."""
        key = self.keys[k]
        return [0, *(int.from_bytes(key[at + DIGEST : at + TURN], "big") for at in range(0, len(key), TURN))]

    def members(self, k: int) -> list[int]:
        return self.ids[self.starts[k] : self.starts[k + 1] if k + 1 < len(self.starts) else len(self.ids)]

    def shared(self, point: _Point, depth: int) -> bool:
        """Whether the node at this depth of the point's edge has members in other ranges too."""
        return (point.first == 0 and depth <= self.before) or (point.last == len(self.keys) - 1 and depth <= self.after)

    def made_here(self, point: _Point, depth: int) -> bool:
        return not (point.first == 0 and depth <= self.before)

    # building: points are closed from the deepest up, and each hands its sums to the one above

    def tree(self) -> _Point:
        root = _Point(0, 0)
        path = [root]
        for k, key in enumerate(self.keys):
            agreed = _agree(self.keys[k - 1], key) if k else 0
            self._close(path, agreed, k)
            depth = len(key) // TURN
            if depth > path[-1].depth:
                path.append(_Point(depth, k))
            point = path[-1]
            ids = self.members(k)
            point.ends, point.n, point.smallest = k, len(ids), ids[0]
            after = _agree(key, self.keys[k + 1]) if k + 1 < len(self.keys) else self.after
            point.leaves = int(after < depth)
        self._close(path, -1, len(self.keys))
        return root

    def _close(self, path: list[_Point], agreed: int, k: int) -> None:
        """Closes the path's points deeper than ``agreed``; a branch inside of an edge becomes a point of its own."""
        while path[-1].depth > agreed:
            point = path.pop()
            point.last = k - 1
            sizes = self.sizes(point.first)
            point.bytes_in += point.n * sizes[point.depth]
            point.bytes_new += sizes[point.depth] * self.made_here(point, point.depth)
            if not path:
                return
            if path[-1].depth < agreed:
                path.append(_Point(agreed, point.first))
            above = path[-1]
            edge = range(above.depth + 1, point.depth)
            above.below.append(point)
            above.n += point.n
            above.leaves += point.leaves
            above.bytes_in += point.bytes_in + point.n * sum(sizes[d] for d in edge)
            above.bytes_new += point.bytes_new + sum(sizes[d] for d in edge if self.made_here(point, d))
            above.new += self.made_here(point, above.depth + 1)
            above.smallest = point.smallest if above.smallest is None else min(above.smallest, point.smallest)

    # giving out: edges are expanded, and sums over an edge's rest are suffix sums

    def rows(self) -> Iterator[tuple]:
        root = self.tree()
        todo: list[tuple[_Point, _Point | None]] = [(root, None)]
        while todo:
            point, above = todo.pop()
            todo += [(b, point) for b in point.below]
            yield from self._edge(point, above)

    def _edge(self, point: _Point, above: _Point | None) -> Iterator[tuple]:
        sizes = self.sizes(point.first)
        top = above.depth + 1 if above else 0
        depths = range(point.depth - 1, top - 1, -1)
        inside = [0, *accumulate(point.n * sizes[d] for d in depths)]
        fresh = [0, *accumulate(sizes[d] * self.made_here(point, d) for d in depths)]
        for up, d in enumerate(range(point.depth, top - 1, -1)):
            at_point = d == point.depth
            shared = self.shared(point, d)
            holder = above if d == top else point
            parent_shared = d > 0 and self.shared(holder, d - 1)
            children = point.new if at_point else int(self.made_here(point, d + 1))
            saved = point.bytes_in + inside[up] - point.bytes_new - fresh[up]
            ends = at_point and point.ends is not None
            key = self.keys[point.first]
            yield (
                d, point.n, children, point.leaves, saved, point.smallest,
                holder.smallest if d and not parent_shared and not shared else None,
                None if shared else hashlib.sha256(",".join(map(str, self.members(point.ends))).encode() if ends else b"").hexdigest(),
                _digest(key, d) if shared else None,
                _digest(key, d - 1) if d and (shared or parent_shared) else None,
                self.number, 0, None,
            )
            if shared and ends:
                for k, piece in enumerate(_pieces(self.members(point.ends))):
                    yield (None,) * 8 + (_digest(key, d), None, self.number, k, piece)


def _digest(key: bytes, depth: int) -> bytes:
    """Names a prefix: unlike prefixes of one length have unlike digests, and the length is named too."""
    return hashlib.sha256(key[: depth * TURN]).digest()[:DIGEST] + depth.to_bytes(4, "big")


def _pieces(ids: list[int]) -> Iterator[str]:
    """The ids, comma-joined, in strings of bounded length."""
    own, length = [], 0
    for i in ids:
        own.append(str(i))
        length += len(own[-1]) + 1
        if length >= PIECE:
            yield ",".join(own)
            own, length = [], 0
    if own:
        yield ",".join(own)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    own: list[tuple] = []
    for row in rows:
        own.append(row)
        if len(own) >= ROWS:
            yield _batch(own, schema)
            own = []
    if own:
        yield _batch(own, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_BUILT_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}[t]) for n, t in (x.strip().split() for x in _BUILT.split(","))])


def _ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last key of each range that a task meets."""
    found: dict[int, list[bytes]] = {}
    for b in batches:
        ranges, keys = b.column(0), b.column(2)
        for k in (0, b.num_rows - 1) if b.num_rows else ():
            own = found.setdefault(ranges[k].as_py(), [keys[k].as_py()] * 2)
            own[1] = keys[k].as_py()
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v[0] for v in found.values()], pa.binary()), pa.array([v[1] for v in found.values()], pa.binary())], ["range", "first", "last"])


def _agreements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        number, first, previous = (b.column(k).to_pylist() for k in (0, 1, 3))
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array([-1 if p is None else _agree(p, f) for p, f in zip(previous, first, strict=True)], pa.int32())], ["range", "agreed"])


def _built(agreed: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Range | None = None
        for b in batches:
            for number, id, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own is None or own.number != number:
                    if own:
                        yield from _batches(own.rows(), _BUILT_ARROW)
                    own = _Range(number, *agreed[number])
                own.add(key, id)
        if own:
            yield from _batches(own.rows(), _BUILT_ARROW)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in their order, one running hash at a time."""
    at, state, out = None, None, []
    for b in batches:
        for node, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if node != at:
                if state:
                    out.append((at, state.hexdigest()))
                at, state = node, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
            if len(out) >= ROWS:
                yield _named(out)
                out = []
    if state:
        out.append((at, state.hexdigest()))
    if out:
        yield _named(out)


def _named(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])


# --- all ranges


def _checkpointed(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` in the shared checkpoint folder with its partitions and their order as they are."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    return df.checkpoint()


@scratched
def prefix_trie(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per distinct prefix of the conversations' turns, from the empty one on; ``change`` (as ``rebuilt``) may alter the conversations' ``codes`` first.

    ``conv_id``: its smallest member, that is, conversation that starts with it; ``depth``: its turns; ``parent_conv_id``:
    the smallest member of the prefix without its last turn (null for the empty one); ``n_convs``: members;
    ``n_children``: prefixes one turn longer; ``n_leaves``: prefixes below it, or itself, that no other goes on from;
    ``saved_tokens``: over itself and all below it, (members - 1) times the bytes of the last text; ``ends_sha256``: of
    the ids that end here, ascending and comma-joined. A conversation without turns ends at the empty prefix. Turns
    without an id belong to no conversation; null roles and texts are empty ones; null turn numbers come first, and rows
    with equal numbers, repeated rows too, in the order of their codes. Other columns may have any name. An empty table
    gives an empty result.

    The longest step that no cluster shortens is one hash over the ids of one hot sequence, which SHA-256 takes in order;
    it streams them in pieces of at most 1 MiB.
    """
    spark = turns.sparkSession
    own = sequences(turns, id, turn, role, text)
    own = change(materialize(own, "sequences")) if change else own
    keyed = materialize(own.select("conv_id", F.unhex(F.array_join("codes", "")).alias("key")), "keys")
    ranges = max(1, (keyed.agg(F.sum(F.octet_length("key") + F.lit(8))).first()[0] or 0) // RANGE, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = keyed.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    runs = _checkpointed(sorted_.select(F.spark_partition_id().alias("range"), "conv_id", "key"), spark)

    ends = materialize(map_arrow(runs, _ends_of, "range int, first binary, last binary"), "range-ends")  # a row a range
    linked = ends.withColumn("previous", F.lag("last").over(Window.orderBy("range")))
    before = {r["range"]: r["agreed"] for r in map_arrow(linked, _agreements, "range int, agreed int").collect()}
    order = sorted(before)
    agreed = {r: (before[r], before[n] if n is not None else -1) for r, n in zip(order, [*order[1:], None], strict=False)}

    built = materialize(map_arrow(runs, _built(agreed), _BUILT), "trie", keep=True)
    parts = built.where(F.col("node").isNotNull())
    pieces = parts.where(F.col("piece").isNotNull()).select("node", "piece", "range", "at").repartition("node").sortWithinPartitions("node", "range", "at")
    hashes = map_arrow(pieces.select("node", "piece"), _hashed, "node binary, ends_sha256 string").withColumnRenamed("node", "hashed")
    whole = parts.where(F.col("piece").isNull()).groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("depth", "parent")], *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.min("conv_id").alias("conv_id")
    )
    whole = materialize(whole.join(hashes, F.col("node") == F.col("hashed"), "left").drop("hashed").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "shared-nodes", keep=True)
    names = [c.split()[0] for c in _NODE.split(", ")]
    lone = built.where(F.col("node").isNull())
    waiting = lone.where(F.col("parent").isNotNull()).drop("parent_conv_id").select("parent", *[n for n in names if n != "parent_conv_id"])
    waiting = waiting.unionByName(whole.select("parent", *[n for n in names if n != "parent_conv_id"]))
    above = whole.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return lone.where(F.col("parent").isNull()).select(*names).unionByName(attach(waiting, above, [("parent", "above")]).select(*names))
