"""Ranks and running sums in key order, without putting a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hex digits of a uniform key that make its buckets: 4,096 of a group.
DIGITS = 3
#: Rows that a bucket of consecutive numbers holds.
BUCKET_ROWS = 200_000


def ranked(df: DataFrame, key: str | Sequence[str], ties: Sequence[str], groups: Sequence[str] = (), weight: Column | None = None, digits: int = DIGITS, bucket: Column | None = None, slice_: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``pos`` (rank from 0 in the order of ``key``, then ``ties``, within ``groups``), ``n`` (rows of the group) and, with a ``weight``, ``before`` (its sum over the rows before).

    Rows are cut into buckets that follow the key's order: by the leading digits of a key of uniform hex text, or by
    ``bucket``, an expression that rises with the key. Buckets' counts are summed ahead (a table of at most 16**digits
    rows a group), and only a bucket's own rows are put in order in one task, so a hot group is spread too.

    ``slice_`` names two columns, alike in a group's rows: only the rows from the first position up to before the
    second are wanted, and buckets outside of that are left out before anything is put in order; of the others all
    rows come.
    """
    keys = [key] if isinstance(key, str) else list(key)
    amount = F.lit(0) if weight is None else weight
    cut = bucket if bucket is not None else F.substring(keys[0], 1, digits) if digits else F.lit("")
    rows = df.withColumn("__bucket", cut).withColumn("__amount", amount)
    ends = [F.min(c).alias(f"__end{k}") for k, c in enumerate(slice_ or ())]
    sums = rows.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__count"), F.sum("__amount").alias("__sum"), *ends)
    ahead = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("*", F.coalesce(F.sum("__count").over(ahead), F.lit(0)).alias("__ahead"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__sum_ahead"), F.sum("__count").over(Window.partitionBy(*groups)).alias("n"))
    if slice_:
        sums = sums.where((F.col("__ahead") < F.col("__end1")) & (F.col("__ahead") + F.col("__count") > F.col("__end0")))
    sums = sums.select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("__bucket").alias("__b"), "__ahead", "__sum_ahead", "n")
    on = F.col("__bucket") == F.col("__b")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    inside = Window.partitionBy(*groups, "__bucket").orderBy(*keys, *ties)
    out = rows.join(sums, on).withColumn("pos", F.row_number().over(inside) - 1 + F.col("__ahead"))
    if weight is not None:
        out = out.withColumn("before", F.coalesce(F.sum("__amount").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__sum_ahead"))
    return out.drop("__bucket", "__amount", "__b", "__ahead", "__sum_ahead", *[f"__{g}" for g in groups])
