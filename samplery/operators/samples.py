"""Training samples for object detectors: grey crops of the marked region of each image, all of one size."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplery.functions import images as I
from samplery.functions import pixels as P


def sample_size(aspect: float, least: int) -> tuple[int, int]:
    """Width and height of samples of this aspect whose shorter side is ``least``."""
    return (least, int(least / aspect)) if aspect < 1 else (int(least * aspect), least)


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with the box ``at`` of their mask's pixels above 0."""
    at = I.foreground(F.col("mask.data"), F.col("mask.width"))
    return rows.where("image is not null and mask is not null").select("serial", "image", at.alias("at")).where("at.x0 is not null")


def vector_samples(rows: DataFrame, least: int) -> DataFrame:
    """Contents of a file of samples: ``content`` of each ``place``, the head at place -1, then a sample for each ``serial``.

    ``rows`` holds serial, ``image`` and ``mask`` (structs of width, height, channels and data, of one size). A sample is the
    image inside the box of its mask's pixels above 0, in grey, in the size that has the boxes' mean aspect and
    ``least`` as its shorter side. The head holds the number of samples and of pixels and four zero bytes, a sample
    two zero bytes and its pixels, as little-endian whole numbers of 4 and 2 bytes. Rows without an image, a mask or
    a pixel above 0 have no sample; without any sample there are no rows.
    """
    marked = _marked(rows)
    side = lambda a, b: F.col(b) - F.col(a) + 1
    row = marked.agg(F.avg(side("at.x0", "at.x1") / side("at.y0", "at.y1")).alias("aspect"), F.count(F.lit(1)).alias("n")).first()
    width, height = sample_size(row["aspect"] or 1.0, least)

    def sample(image: np.ndarray, w: int, h: int, channels: int, box: list) -> np.ndarray:
        x0, y0, x1, y1 = (int(v) for v in box)
        part = P.convert(image.reshape(h, w, channels)[y0 : y1 + 1, x0 : x1 + 1], 1, "uint8")
        return np.clip(np.rint(P.resize(part.reshape(1, -1).astype(np.float64), x1 - x0 + 1, y1 - y0 + 1, width, height)), 0, 255)

    box = F.array(*[F.col(f"at.{c}").cast("double") for c in ("x0", "y0", "x1", "y1")])
    pixels = P.per_row(rows.sparkSession, sample)(F.col("image.data"), F.col("image.width"), F.col("image.height"), box)
    short = lambda v: F.concat(F.lpad(F.hex(v.cast("long")), 2, "0"), F.lit("00"))
    samples = marked.withColumn("pixels", pixels).select(F.col("serial").cast("long").alias("place"), F.unhex(F.concat(F.lit("0000"), F.array_join(F.transform("pixels", short), ""))).alias("content"))
    head = struct.pack("<iihh", row["n"], width * height, 0, 0)
    heads = rows.sparkSession.range(1 if row["n"] else 0).select(F.lit(-1).cast("long").alias("place"), F.lit(head).alias("content"))
    return heads.unionByName(samples)
