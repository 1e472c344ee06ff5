"""Images of records in other sizes, encoded again: what imports, copies and downsizing do to their first field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplery.functions import pixels as P
from samplery.functions import sizes as Z
from samplery.sources import records as R

Size = Callable[[Column, Column], tuple[Column, Column]]


def resized(records: DataFrame, size: Size, n: int = 0) -> DataFrame:
    """Records whose field ``n``, a raw matrix, has the width and height that ``size`` makes of its own (one pixel at least).

    Sizes come from the matrices' headers, so only the bytes of those that change go to Python; others, and fields
    that are no raw matrix, stay as they are, byte by byte. Ids, labels and the other fields stay.
    """
    rows = records.withColumn("__data", R.field(F.col("fields"), n)).withColumn("__own", R.raw_size(F.col("__data")))
    w, h = (F.greatest(v, F.lit(1)).cast("long") for v in size(F.col("__own.width"), F.col("__own.height")))
    rows = rows.withColumns({"__w": w, "__h": h})
    changes = (F.col("__w") != F.col("__own.width")) | (F.col("__h") != F.col("__own.height"))
    whole = F.when((F.col("__own.width") > 0) & (F.col("__own.height") > 0) & changes, F.col("__data"))
    rows = rows.withColumn("__new", P.raw_resizer(records.sparkSession)(whole, F.col("__w"), F.col("__h")))
    rows = rows.withColumn("fields", F.when(F.col("__new").isNull(), F.col("fields")).otherwise(R.replace_field(F.col("fields"), n, F.col("__new"))))
    if "size" in records.columns:
        rows = rows.withColumn("size", F.aggregate("fields", F.lit(0).cast("long"), lambda a, f: a + F.octet_length(f["bytes"])))
    return rows.select(*records.columns)


def downsized(records: DataFrame, size: int) -> DataFrame:
    """Both sides at most ``size``."""
    return resized(records, lambda w, h: Z.downsize(w, h, size))


def import_limited(records: DataFrame, most: int = 0, square: int = 0) -> DataFrame:
    """As imports limit images: ``square`` x ``square`` pixels if it is given, else a short side of at most ``most`` (0: any)."""
    if square > 0:
        return resized(records, lambda w, h: (F.lit(square), F.lit(square)))
    return resized(records, lambda w, h: Z.import_limit(w, h, most)) if most > 0 else records


def limited(records: DataFrame, most: int = 2**31 - 1, least: int = 0) -> DataFrame:
    """The long side at most ``most``, then the short side at least ``least``."""
    return resized(records, lambda w, h: Z.limit(w, h, most, least))


#: How a batch's size is chosen from those of its images.
FITS = ("first", "largest", "smallest")


def fitted(rows: DataFrame, size: int, mode: str = "first", facet: str = "image0", channels: int = -1, dtype: str = "uint8") -> DataFrame:
    """Images of unlike sizes in one shape a batch: ``facet`` (width, height, channels, data) of rows with a ``draw``, ``size`` draws to a batch.

    The batch's width, height and channels are those of its ``first`` image, or the ``largest`` or ``smallest`` of each
    among its images; ``channels`` may be fixed. Images are resized linearly, turned grey, repeated or freed of opacity,
    and rounded to ``dtype``. Only sizes are aggregated and joined back; missing images stay null, and a batch without
    any has no shape.
    """
    if mode not in FITS:
        raise ValueError(f"a batch's size is one of {FITS}, not {mode!r}")
    own = F.col(facet)
    batch = F.floor(F.col("draw") / size).cast("long")
    there = rows.where(own["data"].isNotNull())
    shape = F.struct(*[own[k].alias(k) for k in ("width", "height", "channels")])
    if mode == "first":
        chosen = F.min_by(shape, "draw")
    else:
        chosen = F.struct(*[(F.max if mode == "largest" else F.min)(own[k]).alias(k) for k in ("width", "height", "channels")])
    shapes = there.groupBy(batch.alias("__batch")).agg(chosen.alias("__shape"))
    both = rows.withColumn("__own", batch).join(shapes, F.col("__own") == F.col("__batch"), "left")
    deep = F.lit(channels) if channels > 0 else F.col("__shape.channels")
    new = P.fitter(rows.sparkSession, dtype)(own["data"], own["width"], own["height"], F.col("__shape.width"), F.col("__shape.height"), deep)
    made = F.struct(F.col("__shape.width").alias("width"), F.col("__shape.height").alias("height"), deep.cast("int").alias("channels"), F.col("__new").alias("data"))
    out = both.withColumn("__new", new).withColumn("__made", F.when(F.col("__new").isNotNull(), made))
    return out.select(*[F.col("__made").alias(c) if c == facet else F.col(c) for c in rows.columns])
