"""What several corpus operators share: column names, scratch tables, size-checked joins, bucket spreading, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, for trimming.
SPACE = " \t\n\x0b\x0c\r"
#: A table is broadcast up to this many rows; each caller's rows are narrow (tens of bytes).
BROADCAST_ROWS = 500_000


# --- column names


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def col(name: str) -> Column:
    """A column by its whole name, whatever characters that has."""
    return F.col(quoted(name))


def columns(names: Sequence[str]) -> list[Column]:
    return [col(c) for c in names]


def free_prefix(*tables: DataFrame) -> str:
    """A prefix that no column of the tables begins with, for temporary columns."""
    taken = [c.lower() for t in tables for c in t.columns]
    k = 0
    while any(c.startswith(f"__{k}_") for c in taken):
        k += 1
    return f"__{k}_"


# --- scratch tables

_local: list[str] = []
_left: list[tuple[SparkSession, str]] = []
_open: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("scratch", default=(_left,))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``, or the context's checkpoint folder; a temporary one only on a local master without either."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="samplery-"))
    return _local[0]


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that are written inside the block go when it ends, so results must be used within it. Outside of any block they go with the process."""
    own: list[tuple[SparkSession, str]] = []
    token = _open.set((*_open.get(), own))
    try:
        yield
    finally:
        _open.reset(token)
        _remove(own)


def scratched(function: Callable) -> Callable:
    """``function`` in a ``scratch`` block of its own; what it writes with ``keep`` belongs to its caller."""

    @wraps(function)
    def run(*args, **options):
        with scratch():
            return function(*args, **options)

    return run


@atexit.register
def _clear() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        _remove(_left)


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder, removed as ``scratch`` says; ``keep``: with the block around this one, as this one's result reads it."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    blocks = _open.get()
    blocks[max(0, len(blocks) - 1 - keep)].append((spark, path))
    return path


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: lineage ends here, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- joins and buckets


def same(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality of several columns."""
    condition = F.lit(True)
    for a, b in on:
        condition = condition & left[quoted(a)].eqNullSafe(right[quoted(b)])
    return condition


def attach(big: DataFrame, small: DataFrame, on: Sequence[tuple[str, str]], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a written table to ``big``: by broadcast if a count shows at most ``rows`` rows, else by a shuffled join, whose skew adaptive execution splits."""
    side = F.broadcast(small) if small.limit(rows + 1).count() <= rows else small
    joined = big.join(side, same(big, small, on), how)
    return joined if how.startswith("left_") else joined.drop(*[small[quoted(b)] for _, b in on])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def deal_buckets(rows: DataFrame, key: Sequence[str], member: str, limit: int) -> DataFrame:
    """Adds ``grp`` (long), ``blk`` and ``cross`` so that equal ``grp`` brings together every two rows of a bucket, with about ``limit`` rows to a block.

    A bucket of at most ``limit`` rows is one group. A larger one is cut into blocks by a hash of ``member`` and each
    row goes once to each pair of blocks that holds its own; in groups with ``cross`` only rows of unlike ``blk`` are
    still to be compared. ``rows`` must be a written table, as it is read twice.
    """
    large = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    large = materialize(large.select(*[F.col(k).alias(f"__{k}") for k in key], F.ceil(F.col("__n") / limit).cast("int").alias("__blocks")), "large-buckets")
    cut = attach(rows, large, [(k, f"__{k}") for k in key]).withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    cut = cut.withColumn("blk", F.pmod(F.xxhash64(member), F.col("__blocks")).cast("int"))
    cut = cut.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    low, high = F.least("blk", "__other"), F.greatest("blk", "__other")
    return cut.withColumn("grp", F.xxhash64(*key, low, high)).withColumn("cross", low != high).drop("__blocks", "__other")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as a written table of long columns ``u`` and ``v``.

    Returns ``node``, ``component`` (the smallest node of its component) for each node but the smallest ones
    themselves; rows with a null or with u = v are no edges. Alternates large-star and small-star steps, each one
    grouped minimum and one join, and writes the edges after each round; only a row count and a checksum come to the
    driver. An empty table gives an empty result.
    """

    def oriented(e: DataFrame) -> DataFrame:
        return e.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least(e: DataFrame) -> DataFrame:
        """Smallest neighbour of each node: written, so that joining it can spare a hub's edges one task."""
        return materialize(e.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")), "least-neighbours")

    def step(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = attach(both.where(F.col("v") > F.col("u")), least(both), [("u", "c")], "inner")
        large = materialize(near.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large-star")
        low = least(large)
        small = attach(large, low, [("u", "c")], "inner").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return materialize(oriented(small.unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v")))), "small-star", keep=True)

    e = materialize(oriented(edges), "edges")
    before = sign(e)
    while before[0]:
        e = scratched(step)(e)
        after = sign(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
