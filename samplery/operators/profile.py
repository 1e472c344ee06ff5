"""Dataset profiles: counts, sizes, layouts, and what a dataset looks like it is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stat(index: DataFrame) -> DataFrame:
    """Rows of each group, if all groups are whole numbers; no rows else."""
    odd = index.agg(F.count_if(F.col("grp") != F.floor("grp")).alias("odd"))
    counts = index.groupBy(F.col("grp").cast("long").alias("grp")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.crossJoin(F.broadcast(odd)).where("odd = 0").drop("odd")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def shape_type(annotation: Column) -> Column:
    """The first ``"type"`` in an annotation that has a geometry; null else."""
    found = F.regexp_extract(annotation, r'"type"\s*:\s*"([^"]*)"', 1)
    return F.when(annotation.contains("geometry") & (found != ""), found)


def task(shapes: Column, labels: Column, fractional: Column) -> Column:
    """Shapes mean segmentation; fractional labels, if several, regression; several labels classification."""
    return F.when(shapes > 0, "segmentation").when((fractional > 0) & (labels > 1), "regression").when(labels > 1, "classification").otherwise("none")


def overview(index: DataFrame) -> DataFrame:
    """One row over ``label``, ``grp``, ``size`` and ``n_shapes``: record counts, sizes, distinct values, and the task guessed from them."""
    size = F.col("size").cast("double")
    out = index.agg(
        F.count(F.lit(1)).alias("records"), F.avg(size).alias("mean_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.var_pop(size).alias("var_size"),
        F.count_distinct("label").alias("labels"), F.count_distinct("grp").alias("groups"), F.count_if(F.col("label") != F.floor("label")).alias("fractional_labels"), F.count_if(F.col("grp") != F.col("label")).alias("group_not_label"), F.coalesce(F.sum("n_shapes"), F.lit(0)).cast("long").alias("shapes"),
    )
    return out.withColumn("task", task(F.col("shapes"), F.col("labels"), F.col("fractional_labels"))).withColumn("grouped_by", F.when(F.col("group_not_label") == 0, "label").otherwise("other"))


def layout(images: DataFrame) -> DataFrame:
    """Mean sides and root of area over ``width`` and ``height``, and whether images are rather portrait or landscape."""
    out = images.agg(F.avg(F.sqrt(F.col("width") * F.col("height"))).alias("mean_root_area"), F.avg("width").alias("mean_width"), F.avg("height").alias("mean_height"))
    return out.withColumn("layout", F.when(F.col("mean_width") >= F.col("mean_height"), "landscape").otherwise("portrait"))


def roi_ratio(boxes: DataFrame, groups: list[str]) -> DataFrame:
    """Mean and deviation of the boxes' share of their image."""
    share = F.col("w") * F.col("h")
    return boxes.groupBy(*groups).agg(F.avg(share).alias("mean_share"), F.stddev_pop(share).alias("dev_share"), F.count(F.lit(1)).alias("boxes"))


def union_area(boxes: DataFrame, image: str = "image") -> DataFrame:
    """``roi``: the share of each image that its boxes (``x``, ``y``, ``w``, ``h`` as fractions) cover together, as far as they lie in it; 0 where none has an area.

    A sweep: between two neighbouring edges in x the covered height is the sum of what each box, by its upper end, adds
    to those before it. A box meets the strips that it spans, of its own image only.
    """
    end = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    own = boxes.select(image, end(F.col("x")).alias("x0"), end(F.col("x") + F.col("w")).alias("x1"), end(F.col("y")).alias("y0"), end(F.col("y") + F.col("h")).alias("y1"))
    some = own.where("x1 > x0 and y1 > y0")
    edges = some.select(image, F.explode(F.array("x0", "x1")).alias("from")).distinct()
    strips = edges.withColumn("to", F.lead("from").over(Window.partitionBy(image).orderBy("from"))).where("to is not null").withColumnRenamed(image, "__image")
    held = some.join(strips.hint("merge"), (F.col(image) == F.col("__image")) & (F.col("x0") <= F.col("from")) & (F.col("x1") >= F.col("to")))
    before = F.max("y1").over(Window.partitionBy(image, "from").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    more = held.withColumn("more", F.greatest(F.col("y1") - F.greatest(F.col("y0"), F.coalesce(before, F.lit(0.0))), F.lit(0.0)))
    area = more.groupBy(image).agg(F.sum(F.col("more") * (F.col("to") - F.col("from"))).alias("__roi")).withColumnRenamed(image, "__image")
    every = boxes.select(image).distinct()
    return every.join(area, F.col(image) == F.col("__image"), "left").select(image, F.coalesce("__roi", F.lit(0.0)).alias("roi"))


def roi_stats(first: DataFrame, second: DataFrame, image: str = "image") -> DataFrame:
    """Mean and deviation of the covered share of the first annotation's images, and of the root of the second's share over the first's where that is above 0."""
    a, b = union_area(first, image), union_area(second, image).select(F.col(image).alias("__image"), F.col("roi").alias("roi2"))
    scale = F.when(F.col("roi") > 0, F.sqrt(F.coalesce("roi2", F.lit(0.0)) / F.col("roi")))
    both = a.join(b, F.col(image) == F.col("__image"), "left")
    return both.agg(F.avg("roi").alias("mean_share"), F.stddev_pop("roi").alias("dev_share"), F.avg(scale).alias("mean_scale"), F.stddev_pop(scale).alias("dev_scale"), F.count(F.lit(1)).alias("images"))


def scale_stats(patches: DataFrame) -> DataFrame:
    """Least, mean and largest ``scale`` of region patches."""
    return patches.agg(F.min("scale").alias("min_scale"), F.avg("scale").alias("mean_scale"), F.max("scale").alias("max_scale"), F.count(F.lit(1)).alias("patches"))


def mean_aspect(boxes: DataFrame) -> DataFrame:
    """Mean width over height in pixels of boxes that have a height."""
    own = boxes.where("w > 0 and h > 0")
    return own.agg(F.avg(F.col("w") * F.col("width") / (F.col("h") * F.col("height"))).alias("mean_aspect"), F.count(F.lit(1)).alias("boxes"))


def annotation_bbox(boxes: DataFrame, image: str = "image") -> DataFrame:
    """Envelope of each image's boxes with an area."""
    own = boxes.where("w > 0 and h > 0").groupBy(image).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    return own.select(image, "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))


def label_sources(index: DataFrame) -> DataFrame:
    """How many groups are no whole numbers, differ from the label, and differ from label2."""
    return index.agg(F.count_if(F.col("grp") != F.floor("grp")).alias("fractional"), F.count_if(F.col("grp") != F.col("label")).alias("not_label"), F.count_if(F.col("grp") != F.col("label2")).alias("not_label2"))


def loader_task(annotated: Column, classes: Column) -> Column:
    """What a loader delivers: annotation or label, as one number or one-hot."""
    return F.when(annotated, F.when(classes > 0, "pixel classification").otherwise("pixel regression")).otherwise(F.when(classes > 0, "classification").otherwise("regression"))
