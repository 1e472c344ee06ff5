"""Sinks: annotation lines, unpacked fields, split writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def yolo_line(label: Column, x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """``label x y w h`` of a box, in rounded pixels."""
    return F.format_string("%d %d %d %d %d", label.cast("long"), *[F.round(a * b).cast("long") for a, b in ((x, width), (y, height), (w, width), (h, height))])


def write_yolo(boxes: DataFrame, path: str, files: int = 64) -> None:
    """Text of ``image<tab>label x y w h`` in ``files`` files by a hash of the image, an image's lines together; ``boxes`` has image, label, x, y, w, h (fractions), width and height."""
    line = yolo_line(*[F.col(c) for c in ("label", "x", "y", "w", "h", "width", "height")])
    lines = boxes.select("image", F.concat_ws("\t", F.col("image").cast("string"), line).alias("value"))
    lines.repartition(files, "image").sortWithinPartitions("image", "value").select("value").write.text(path)


def unpacked(records: DataFrame, n: int = 0, suffix: str = ".jpg") -> DataFrame:
    """``name`` (serial and suffix) and ``content`` of field ``n`` of each record that has one."""
    content = F.get("fields", F.lit(n))["bytes"]
    return records.where(content.isNotNull()).select(F.concat(F.col("serial").cast("string"), F.lit(suffix)).alias("name"), content.alias("content"))


def write_parts(records: DataFrame, flag: str, path: str, names: tuple[str, str]) -> None:
    """Writes rows with a false ``flag`` and rows with a true one as two tables, e.g. train and test."""
    for name, keep in zip(names, (~F.col(flag), F.col(flag)), strict=True):
        records.where(keep).drop(flag).write.parquet(f"{path}.{name}")
