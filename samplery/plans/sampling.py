"""Sampling plans over an index (``serial``, ``grp`` and other narrow columns): split, balance, endless draws, mixin, batches.

Plans never touch payloads: they are made on the index, and ``with_payload`` joins the chosen rows back to their records.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplery.functions.keys import SEED, order_key, uniform
from samplery.plans.ordering import BUCKET_ROWS, ranked

MOST_CATEGORIES = 2000


@dataclass(frozen=True)
class SampleConfig:
    """How to sample; defaults as a plain, endless, shuffled stream without folds."""

    seed: int = SEED
    loop: bool = True
    shuffle: bool = True
    reshuffle: bool = True
    stratify: bool = False
    oversample: bool = False
    perturb: bool = False
    split: int = 1
    split_fold: int = 0
    split_negate: bool = False
    split_keys: tuple[int, ...] = ()
    batch: int = 1
    order: Literal["NHWC", "NCHW"] = "NHWC"
    colorspace: Literal["BGR", "RGB"] = "BGR"
    dtype: Literal["uint8", "float32", "int32"] = "uint8"
    channels: int = -1
    images: tuple[int, ...] = (0,)
    annotate: tuple[int, ...] = ()
    raw: tuple[int, ...] = ()
    transforms: tuple[dict, ...] = ()
    autoencoder: bool = False

    def __post_init__(self) -> None:
        if self.split < 1 or self.batch < 1:
            raise ValueError("split and batch must be positive")
        if self.split == 1 and (self.split_negate or self.split_fold > 0 or self.split_keys):
            raise ValueError("a fold needs split > 1")
        if self.split_keys and (self.split_fold >= 0 or any(not 0 <= k < self.split for k in self.split_keys)):
            raise ValueError("split_keys need split_fold < 0 and folds below split")
        if self.channels not in (-1, 1, 3):
            raise ValueError("channels must be -1, 1 or 3")
        if self.order not in ("NHWC", "NCHW") or self.colorspace not in ("BGR", "RGB") or self.dtype not in ("uint8", "float32", "int32"):
            raise ValueError("unknown order, colorspace or dtype")

    @property
    def folds(self) -> tuple[int, ...]:
        """The folds that stay: all but ``split_fold`` (all, if it is out of range), or ``split_keys``; or the complement."""
        own = sorted(set(self.split_keys)) if self.split_keys else [k for k in range(self.split) if k != self.split_fold]
        return tuple(k for k in range(self.split) if k not in own) if self.split_negate else tuple(own)


def categories_usable(index: DataFrame) -> DataFrame:
    """One row: ``usable`` (groups are whole numbers from 0 below the limit, and not all 0) and ``categories`` (highest group + 1)."""
    whole = F.coalesce(F.bool_and((F.col("grp") == F.floor("grp")) & (F.col("grp") >= 0)), F.lit(False))
    top = F.max("grp")
    return index.agg((whole & F.coalesce((top < MOST_CATEGORIES) & (top > 0), F.lit(False))).alias("usable"), (F.floor(top) + 1).cast("long").alias("categories"))


def usable_groups(index: DataFrame, config: SampleConfig) -> SampleConfig:
    """``config``, without ``stratify`` (and a warning) where the groups are no categories: a group that is no whole number or negative, none above 0, or ``MOST_CATEGORIES`` and more."""
    if not config.stratify or categories_usable(index).first()["usable"]:
        return config
    warnings.warn("groups are no categories: they are not stratified", stacklevel=3)
    return replace(config, stratify=False)


def _shuffled(index: DataFrame, config: SampleConfig, groups: tuple[str, ...], epoch: Column | int = 0, slice_: tuple[str, str] | None = None) -> DataFrame:
    """Ranks in the order of an epoch, or of the serial numbers, whose ranges are the buckets then."""
    if not config.shuffle:
        return ranked(index, "serial", [], groups, bucket=F.floor(F.col("serial") / BUCKET_ROWS), slice_=slice_)
    rows = index.withColumn("__key", order_key(F.col("serial"), seed=config.seed, epoch=epoch))
    return ranked(rows, "__key", ["serial"], groups, slice_=slice_).drop("__key")


def in_folds(pos: Column, n: Column, split: int, folds: tuple[int, ...]) -> Column:
    inside = F.lit(False)
    for k in folds:
        inside = inside | ((pos >= F.floor(n * k / split)) & (pos < F.floor(n * (k + 1) / split)))
    return inside


def split(index: DataFrame, config: SampleConfig) -> DataFrame:
    """The rows of the chosen folds; ranks are taken per group if ``stratify`` (and the groups are categories), over all rows else."""
    return _split(index, config if config.split == 1 else usable_groups(index, config))


def _split(index: DataFrame, config: SampleConfig) -> DataFrame:
    if config.split == 1:
        return index
    rows = _shuffled(index, config, ("grp",) if config.stratify else ())
    return rows.where(in_folds(F.col("pos"), F.col("n"), config.split, config.folds)).drop("pos", "n")


def draw_order(index: DataFrame, config: SampleConfig) -> DataFrame:
    """The finite stream: the split's rows with ``draw`` from 0.

    Balanced (``stratify`` and ``oversample``): a round takes one row of each group that has any left, in group order,
    which is the order by (position in group, group); as many rounds make a bucket as surely fit one. Otherwise one
    pool in another random order.
    """
    config = usable_groups(index, config)
    rows = _split(index, config)
    if not (config.stratify and config.oversample):
        return _shuffled(rows, config, (), epoch=1).withColumnRenamed("pos", "draw").drop("n")
    own = _shuffled(rows, config, ("grp",)).drop("n").withColumnRenamed("pos", "__turn")
    rounds = F.floor(F.col("__turn") / (BUCKET_ROWS // MOST_CATEGORIES))
    return ranked(own, ["__turn", "grp"], [], bucket=rounds).withColumnRenamed("pos", "draw").drop("__turn", "n")


def looped_draws(index: DataFrame, config: SampleConfig, draws: int, offset: int = 0, checked: bool = False) -> DataFrame:
    """``draws`` rows of the endless stream from ``offset`` on, closed form: draw i takes group i mod G in its turn t = i div G, of
    which epoch t div n and position t mod n; every epoch has its own order if ``reshuffle``.

    Only the epochs that the slice meets are made, and of these only the buckets with its positions are put in order.
    ``checked``: ``usable_groups`` has seen the configuration.
    """
    config = config if checked else usable_groups(index, config)
    rows = _split(index, config)
    balanced = config.stratify and config.oversample
    rows = rows if balanced else rows.withColumn("__own", F.col("grp")).withColumn("grp", F.lit(0))
    groups = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    # one row a group: fewer than MOST_CATEGORIES
    groups = groups.withColumn("g", F.row_number().over(Window.orderBy("grp")) - 1).withColumn("groups", F.count(F.lit(1)).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    turn = lambda draw: F.greatest(F.lit(0), F.ceil((F.lit(draw) - F.col("g")) / F.col("groups")))  # noqa: E731  turns of the group before that draw
    groups = groups.withColumn("first", turn(offset)).withColumn("last", turn(offset + draws)).where("last > first")
    epochs = groups.select(F.col("grp").alias("__grp"), F.col("n").alias("__n"), "g", "groups", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / F.col("n")), F.floor((F.col("last") - 1) / F.col("n")))).alias("epoch"))
    epochs = epochs.withColumn("__lo", F.col("first") - F.col("epoch") * F.col("__n")).withColumn("__hi", F.col("last") - F.col("epoch") * F.col("__n"))
    own = rows.join(epochs, F.col("grp") == F.col("__grp")).drop("__grp", "first", "last")
    own = _shuffled(own, config, ("grp", "epoch"), F.col("epoch") if config.reshuffle else 0, ("__lo", "__hi"))
    own = own.where((F.col("pos") >= F.col("__lo")) & (F.col("pos") < F.col("__hi")))
    own = own.withColumn("draw", (F.col("epoch") * F.col("__n") + F.col("pos")) * F.col("groups") + F.col("g"))
    out = own.drop("pos", "n", "__n", "g", "groups", "__lo", "__hi")
    return out if balanced else out.drop("grp").withColumnRenamed("__own", "grp")


def mixin(primary: DataFrame, second: DataFrame, group_reset: float = -1, group_delta: float = 0, most: int = 0, randomize: bool = False, seed: int = SEED) -> DataFrame:
    """Both indexes, the second as ``file`` 1: its groups set to ``group_reset`` (if not negative) plus ``group_delta``, and at most ``most`` of its rows (0: all), the first or, with ``randomize``, random ones."""
    grp = F.col("grp") if group_reset < 0 else F.lit(group_reset)
    other = second.withColumn("grp", (grp + F.lit(group_delta)).cast(primary.schema["grp"].dataType))
    if most > 0:
        order = [order_key(F.lit(1), F.col("serial"), seed=seed)] if randomize else []
        other = other.orderBy(*order, "serial").limit(most)
    return primary.withColumn("file", F.lit(0)).unionByName(other.withColumn("file", F.lit(1)))


def kfold(index: DataFrame, folds: int = 5, fold: int = 0, most_test: int = 0, seed: int = SEED) -> DataFrame:
    """``part`` ('train' or 'test') for each row: the fold is test, but rows beyond ``most_test`` (0: no limit) go to train."""
    rows = _shuffled(index, SampleConfig(seed=seed), ())
    lo = F.floor(F.col("n") * fold / folds)
    test = (F.col("pos") >= lo) & (F.col("pos") < F.floor(F.col("n") * (fold + 1) / folds))
    if most_test > 0:
        test = test & (F.col("pos") - lo < most_test)
    return rows.withColumn("part", F.when(test, "test").otherwise("train")).drop("pos", "n")


def byte_budget_sample(index: DataFrame, budget: int, seed: int = SEED) -> DataFrame:
    """Random rows until their sizes pass ``budget``; the last may pass it. All rows if they are less than 1.2 times the budget."""
    key = order_key(F.col("serial"), seed=seed)
    rows = ranked(index.withColumn("key", key), "key", ["serial"], weight=F.col("size"))
    total = index.agg(F.sum("size").alias("total"))
    return rows.crossJoin(F.broadcast(total)).where((F.col("total") < 1.2 * budget) | (F.col("before") < budget)).drop("key", "pos", "n", "total")


def random_ids(spark, rows: int, count: int, seed: int = SEED) -> DataFrame:
    """``count`` draws of a serial below ``rows``, with replacement."""
    return spark.range(count).select(F.col("id").alias("draw"), F.floor(uniform("random_ids", F.col("id"), seed=seed) * rows).cast("long").alias("serial"))


def _of(name: str):
    return lambda item: item[name]


def batches(plan: DataFrame, size: int, columns: tuple[str, ...]) -> DataFrame:
    """``batch`` (draw div size) with ordered lists of ``columns``; the last batch may be shorter. A batch is at most ``size`` rows."""
    item = F.struct("draw", *columns)
    grouped = plan.groupBy(F.floor(F.col("draw") / size).cast("long").alias("batch")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select("batch", F.size("items").alias("rows"), *[F.transform("items", _of(c)).alias(c) for c in columns])


def padded(plan: DataFrame, size: int) -> DataFrame:
    """The finite plan with its first rows again at the end (``pad`` is true there), so that the last batch is full."""
    total = F.broadcast(plan.agg(F.count(F.lit(1)).alias("__total")))
    both = plan.crossJoin(total)
    missing = F.pmod(-F.col("__total"), F.lit(size))
    again = both.where(F.col("draw") < missing).withColumn("draw", F.col("draw") + F.col("__total")).withColumn("pad", F.lit(True))
    return both.withColumn("pad", F.lit(False)).unionByName(again).drop("__total")


def with_payload(plan: DataFrame, records: DataFrame) -> DataFrame:
    """The plan's rows with their records' other columns (late materialisation by serial)."""
    return plan.join(records.drop(*[c for c in plan.columns if c != "serial" and c in records.columns]), "serial")
