"""Record tables: schema, reading and writing, ids, fields, and imports of files."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samplery.sources import files

FIELD = "struct<type:tinyint,bytes:binary>"
#: Payload columns come last, so that index scans read a prefix of narrow columns.
SCHEMA = f"id long, label float, label2 short, grp float, file int, serial long, size long, fields array<{FIELD}>"
MOST_FIELDS = 6
#: Values of a list that Spark pushes to Parquet one by one (``spark.sql.parquet.pushdown.inFilterThreshold``).
PUSHED_LIST = 10
INDEX = ("id", "label", "label2", "grp", "file", "serial", "size")
NONE, IMAGE, ANNOTATION_IMAGE, ANNOTATION_JSON = range(4)
_SCHEMES = r"^(?i)(https?|ftp)://"


def index(records: DataFrame) -> DataFrame:
    """All but the payload: the scan reads no field bytes."""
    return records.select(*[c for c in INDEX if c in records.columns])


def at_serials(records: DataFrame, serials: Sequence[int]) -> DataFrame:
    """Positional reads: row groups without any of these serials are skipped if the table is sorted by serial.

    A list of more than ten values reaches a Parquet scan as its least and largest only, so the filter is made of lists
    of ten, each of which is compared value by value.
    """
    own = sorted(set(serials))
    parts = [F.col("serial").isin(*own[k : k + PUSHED_LIST]) for k in range(0, len(own), PUSHED_LIST)] or [F.lit(False)]
    while len(parts) > 1:  # a balanced tree
        parts = [parts[k] | parts[k + 1] if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return records.where(parts[0])


def auto_id(rows: DataFrame, order: Sequence[str], start: int = 0) -> DataFrame:
    """``id`` counting from ``start`` in the order of the columns ``order``; equal keys are numbered in any order.

    Rows are range-partitioned and kept on disk, so that the ranges stay as they are; an id is its range's offset (a
    table of one row a partition) and the rank inside. No task holds all rows.
    """
    ranged = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__part").count().select(F.col("__part").alias("__p"), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__ahead"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn("id", (rank + F.col("__ahead") + start).cast("long")).drop("__part", "__p", "__ahead")


def field(records_fields: Column, n: int) -> Column:
    """Bytes of field ``n``; empty if there is no such field."""
    return F.coalesce(F.get(records_fields, F.lit(n))["bytes"], F.lit(b""))


def field_type(records_fields: Column, n: int) -> Column:
    return F.coalesce(F.get(records_fields, F.lit(n))["type"], F.lit(NONE).cast("tinyint"))


def replace_field(records_fields: Column, n: int, value: Column, kind: int | None = None) -> Column:
    new = lambda f: F.struct((f["type"] if kind is None else F.lit(kind).cast("tinyint")).alias("type"), value.alias("bytes"))
    return F.transform(records_fields, lambda f, i: F.when(i == n, new(f)).otherwise(f))


def copy_meta(records: DataFrame) -> DataFrame:
    """New records with the ids, labels and places of others, but without fields."""
    bare = records.withColumn("fields", F.array().cast(f"array<{FIELD}>")).withColumn("size", F.lit(0).cast("long"))
    return bare.select(*[c for c in (*INDEX, "fields") if c in bare.columns])


def sniff(text: Column) -> Column:
    """What an untyped annotation is: JSON if its first character that is not blank is ``{``, else an image; nothing is nothing."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, NONE).when(F.regexp_like(text, F.lit(r"^[ \t\n]*\{")), ANNOTATION_JSON).otherwise(ANNOTATION_IMAGE)


def is_url(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(_SCHEMES)), F.lit(False))


def cache_name(url: Column) -> Column:
    """File name under which a fetched URL is kept."""
    return F.sha1(url.cast("binary"))


def make_records(rows: DataFrame, fields: Sequence[tuple[str, int]], label2_groups: bool = False) -> DataFrame:
    """Records from rows with ``id``, ``serial``, ``label`` and, if there, ``label2`` and ``file``; ``fields`` names binary columns and their types.

    ``grp`` is the label, or label2 if ``label2_groups``. Trailing null fields are left out.
    """
    if not 1 <= len(fields) <= MOST_FIELDS:
        raise ValueError(f"a record has 1 to {MOST_FIELDS} fields")
    own = set(rows.columns)
    all_ = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("type"), F.coalesce(F.col(c).cast("binary"), F.lit(b"")).alias("bytes")) for c, k in fields])
    width = F.greatest(*[F.when(F.col(c).isNotNull(), F.lit(i + 1)).otherwise(0) for i, (c, _) in enumerate(fields)], F.lit(1))
    label2 = F.col("label2").cast("short") if "label2" in own else F.lit(0).cast("short")
    out = rows.withColumn("__fields", F.slice(all_, 1, width.cast("int")))
    size = F.aggregate("__fields", F.lit(0).cast("long"), lambda a, f: a + F.octet_length(f["bytes"]))
    return out.select(F.col("id").cast("long"), F.col("label").cast("float").alias("label"), label2.alias("label2"), (label2 if label2_groups else F.col("label")).cast("float").alias("grp"), (F.col("file").cast("int") if "file" in own else F.lit(0)).alias("file"), F.col("serial").cast("long").alias("serial"), size.alias("size"), F.col("__fields").cast(f"array<{FIELD}>").alias("fields"))


def write(records: DataFrame, path: str, mode: str = "error", sort: bool = True) -> None:
    """Parquet, sorted by serial inside files for positional reads; ``mode`` as Spark's ('error' refuses to overwrite, 'append' adds)."""
    (records.sortWithinPartitions("file", "serial") if sort else records).write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


class Reader:
    """Iterates, indexes and counts a record table for a local client; rows stream in partition by partition."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.records = read(spark, path)
        self.reset()

    def reset(self) -> None:
        self._rows = self.records.orderBy("file", "serial").toLocalIterator(prefetchPartitions=True)

    def __iter__(self) -> Iterator:
        self.reset()
        return self._rows

    def next(self):
        return next(self._rows)

    def size(self) -> int:
        return self.records.count()

    __len__ = size

    def read(self, serial: int):
        row = self.records.where(F.col("serial") == serial).first()
        if row is None:
            raise IndexError(serial)
        return row


# --- imports


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _numbered(rows: DataFrame) -> DataFrame:
    return auto_id(rows, ["path"]).withColumn("serial", F.col("id"))


def import_directory(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a folder, label 0, numbered by path."""
    return make_records(_numbered(_files(spark, path).withColumn("label", F.lit(0.0))), [("content", IMAGE)])


def import_images(spark: SparkSession, path: str) -> DataFrame:
    """Images that Spark's ``image`` source decodes, as raw matrices of bytes; label 0, numbered by path. Files that are no images are left out."""
    image = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    deep = F.col("nChannels")
    rows = image.select(F.col("origin").alias("path"), raw_bytes((deep - 1) * 8, F.col("height"), F.col("width"), deep, F.col("data")).alias("content"), F.lit(0.0).alias("label"))
    return make_records(_numbered(rows), [("content", IMAGE)])


def import_records(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Another record table's first two fields with their labels, numbered anew in its order; at most ``limit`` records (0: all)."""
    rows = read(spark, path).select(F.struct("file", "serial").alias("at"), "label", "label2", "grp", "fields")
    rows = auto_id(rows.orderBy("at").limit(limit) if limit > 0 else rows, ["at"])
    two = F.slice("fields", 1, 2)
    size = F.aggregate(two, F.lit(0).cast("long"), lambda a, f: a + F.octet_length(f["bytes"]))
    return rows.select("id", "label", "label2", "grp", F.lit(0).alias("file"), F.col("id").alias("serial"), size.alias("size"), two.alias("fields"))


def import_classes(spark: SparkSession, path: str) -> DataFrame:
    """Folders named 0 .. N-1 are labels; fails unless they are at least two without a gap."""
    rows = _files(spark, path).withColumn("label", F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).try_cast("int"))
    seen = rows.agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count_distinct("label").alias("n"), F.count_if(F.col("label").isNull()).alias("odd")).first()
    if seen["odd"] or not seen["n"] or seen["lo"] != 0 or seen["n"] < 2 or seen["hi"] != seen["n"] - 1:
        raise ValueError("class folders must be named 0 to N-1, with at least two of them")
    return make_records(_numbered(rows), [("content", IMAGE)])


def import_list(spark: SparkSession, list_path: str, root: str, kind: str = "label", sep: str = "\t", keep_path: bool = False) -> DataFrame:
    """Lines ``path<sep>value``: ``kind`` is 'label' (a number), 'json' (an annotation) or 'mask' (the path of an image, may be empty). Lines that don't parse, or whose file is missing, are left out. ``keep_path``: labelled records get a field of JSON that holds the path as the list has it.

    Tasks open the files that their lines name; others below ``root`` are not even listed.
    """
    lines = spark.read.text(list_path).select(F.split("value", sep, 2).alias("p")).where(F.size("p") >= (1 if kind == "mask" else 2)).select(F.col("p")[0].alias("name"), F.try_element_at("p", F.lit(2)).alias("value"))
    prefix = root.rstrip("/") + "/"
    named = lambda c: F.when(F.col(c).startswith("/") | F.col(c).contains("://"), F.col(c)).otherwise(F.concat(F.lit(prefix), F.col(c)))
    if kind == "label":
        lines = lines.withColumn("label", F.col("value").try_cast("float")).where("label is not null")
    whole = {"start": F.lit(0).cast("long"), "length": F.lit(None).cast("long")}
    rows = files.read_parts(files.spread(lines, "name").withColumns({"path": named("name"), **whole}), "skip").withColumn("path", F.col("name"))
    if kind == "label":
        rows = rows.withColumn("origin", F.encode(F.to_json(F.struct(F.col("name").alias("path"))), "UTF-8"))
        return make_records(_numbered(rows), [("content", IMAGE), *([("origin", NONE)] if keep_path else [])])
    rows = rows.withColumn("label", F.lit(0.0))
    if kind == "json":
        return make_records(_numbered(rows.withColumn("note", F.encode("value", "UTF-8"))), [("content", IMAGE), ("note", ANNOTATION_JSON)])
    wanted = lines.where(F.coalesce("value", F.lit("")) != "").select(F.col("value").alias("mask_name")).distinct()
    masks = files.read_parts(files.spread(wanted, "mask_name").withColumns({"path": named("mask_name"), **whole}), "skip").select("mask_name", F.col("content").alias("mask"))
    rows = rows.join(masks, F.col("value") == F.col("mask_name"), "left")
    return make_records(_numbered(rows), [("content", IMAGE), ("mask", ANNOTATION_IMAGE)])


def import_tars(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Regular members of tar files; the label is the file's place in ``paths``. Headers are read first, then each task seeks to its own members, so that no tar is held."""
    rows = files.read_members(files.tar_members(spark, paths)).withColumn("label", F.col("tar").cast("float"))
    return make_records(auto_id(rows, ["tar", "member"]).withColumn("serial", F.col("id")), [("content", IMAGE)])


def import_cifar(spark: SparkSession, path: str | Sequence[str], side: int = 32) -> DataFrame:
    """Rows of one label byte and three planes of ``side`` x ``side`` bytes: label and planes (red, green, blue), of one file or several; a file's rows are read by many tasks."""
    cut = files.read_rows(spark, [path] if isinstance(path, str) else path, 1 + 3 * side * side)
    rows = cut.select("path", "n", F.conv(F.hex(F.substring("row", 1, 1)), 16, 10).cast("float").alias("label"), F.expr("substring(row, 2)").alias("planes"))
    return make_records(auto_id(rows, ["path", "n"]).withColumn("serial", F.col("id")), [("planes", NONE)])


def read_idx(content: bytes) -> np.ndarray:
    """An IDX file of unsigned bytes (magic 0x0803 for images, 0x0801 for labels)."""
    magic, = struct.unpack(">I", content[:4])
    if magic not in (0x0803, 0x0801):
        raise ValueError(f"not an IDX file of bytes: {magic:#x}")
    dims = struct.unpack(f">{magic & 0xFF}I", content[4 : 4 + 4 * (magic & 0xFF)])
    return np.frombuffer(content, np.uint8, offset=4 + 4 * len(dims)).reshape(dims)


def _idx_rows(spark: SparkSession, path: str) -> DataFrame:
    """``serial`` and ``bytes`` of an IDX file's items, read by ranges; only its header comes to the driver."""
    with files.opened(path) as f:
        magic, = struct.unpack(">I", f.read(4))
        if magic not in (0x0803, 0x0801):
            raise ValueError(f"not an IDX file of bytes: {magic:#x}")
        deep = magic & 0xFF
        dims = struct.unpack(f">{deep}I", f.read(4 * deep))
    rows = files.read_rows(spark, [path], int(np.prod(dims[1:])), 4 + 4 * deep)
    return rows.where(F.col("n") < dims[0]).select(F.col("n").alias("serial"), F.col("row").alias("bytes"))


def import_idx(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """One image file and one label file; rows pair by position."""
    pictures, marks = (_idx_rows(spark, p) for p in (images, labels))
    rows = pictures.join(marks.select("serial", F.conv(F.hex("bytes"), 16, 10).cast("float").alias("label")), "serial").withColumn("id", F.col("serial"))
    return make_records(rows, [("bytes", NONE)])


# --- raw matrices: a type code, rows, columns and bytes of an element, then the rows

# Depth codes of the raw matrix format.
DEPTHS = ("uint8", "int8", "uint16", "int16", "int32", "float32", "float64")


def encode_raw(matrix: np.ndarray) -> bytes:
    if matrix.ndim not in (2, 3) or str(matrix.dtype) not in DEPTHS:
        raise ValueError("a raw matrix has 2 or 3 dimensions and a supported type")
    channels = matrix.shape[2] if matrix.ndim == 3 else 1
    code = DEPTHS.index(str(matrix.dtype)) + 8 * (channels - 1)
    return struct.pack("<4i", code, matrix.shape[0], matrix.shape[1], matrix.itemsize * channels) + np.ascontiguousarray(matrix).tobytes()


def raw_bytes(code: Column, rows: Column, cols: Column, size: Column, data: Column) -> Column:
    """A raw matrix of columns: its type's code, rows, columns, bytes of an element, and the elements."""
    digits = lambda v: F.lpad(F.hex(v.cast("long")), 8, "0")
    little = lambda v: F.unhex(F.concat(*[F.substring(digits(v), k, 2) for k in (7, 5, 3, 1)]))
    return F.concat(little(code), little(rows), little(cols), little(size), data)


def raw_size(data: Column) -> Column:
    """``width`` and ``height`` in a raw matrix's header; null for bytes whose length is not what their header says."""
    def number(at: int) -> Column:
        digits = F.hex(F.substring(data, at, 4))
        return F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")

    true = F.octet_length(data) - 16 == F.try_multiply(F.try_multiply(number(5), number(9)), number(13))  # any bytes may come
    return F.when((F.octet_length(data) >= 16) & true, F.struct(number(9).alias("width"), number(5).alias("height")))


def decode_raw(data: bytes) -> np.ndarray:
    if len(data) < 16:
        raise ValueError("not a raw matrix")
    code, rows, cols, size = struct.unpack("<4i", data[:16])
    if not 0 <= code < 512 or code % 8 >= len(DEPTHS):
        raise ValueError("not a raw matrix")
    kind, channels = np.dtype(DEPTHS[code % 8]), code // 8 + 1
    if size != kind.itemsize * channels or len(data) != 16 + rows * cols * size:
        raise ValueError("not a raw matrix")
    out = np.frombuffer(data, kind, offset=16).reshape(rows, cols, channels)
    return out[:, :, 0] if channels == 1 else out
