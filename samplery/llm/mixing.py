"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplery.llm.common import attach, col, columns, free_prefix, materialize, same, scratched, word_count

_SPAN = 1 << 60


def capped_targets(sources: DataFrame, total: float, max_epochs: int = 2) -> DataFrame:
    """Adds ``target`` to a written table of one row per source (``weight`` > 0, ``size``): shares of ``total`` by weight, none above ``max_epochs * size``.

    Water-filling: a target is min(cap, level * weight). Each round clamps the sources whose cap the level passes and
    shares what they leave by weight among the others, which raises the level; it ends when no further source is
    clamped. If all caps together fall short of ``total``, every source is at its cap. A round is one aggregate over
    the sources, of which three numbers come to the driver.
    """
    cap = max_epochs * F.col("size").cast("double")
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else cap / F.col("weight") <= level
        caps, weight, n = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if n == clamped:
            return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))
        level, clamped = (total - (caps or 0.0)) / weight if weight else float("inf"), n


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``place``, counting from 0 by code point (null last): ranges of sources are counted ahead, so that no task holds all of them."""
    order = F.col("source").asc_nulls_last()
    ranged = materialize(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = ranged.groupBy("part").count().select(F.col("part").alias("p"), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.join(F.broadcast(offsets), F.col("part") == F.col("p")).withColumn("place", rank + F.col("ahead")).drop("part", "p", "ahead")


def draw_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A seeded place in [0, 2**60) from a document's id and text; it doesn't depend on partitions or retries."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _cuts(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source, where the fractional repetition ends in draw order: all of ``bucket < cut_bucket``, in that bucket all keys below ``cut_key``, and ``cut_fit`` of the ``cut_rows`` equal rows with that key.

    Two levels: about sqrt(n) buckets of the draw key per source hold sums, and only the different keys of the one
    bucket in which the sum crosses the remainder are put in order, so that no task sees more than about sqrt(n) rows.
    """
    rows = attach(sized, sources.select(F.col("source").alias("__s"), "rest", "buckets"), [("source", "__s")])
    rows = rows.withColumn("bucket", bucket_of(F.col("draw"), F.col("buckets")))
    sums = rows.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(by_source), F.lit(0)))
    cross = sums.where((F.col("before") <= F.col("rest")) & (F.col("rest") > 0)).groupBy("source").agg(F.max(F.struct("bucket", "before")).alias("c"))
    cross = materialize(cross.select(F.col("source").alias("__s"), F.col("c.bucket").alias("cut_bucket"), F.col("c.before").alias("before")), "mix-cross")
    inside = attach(rows, cross, [("source", "__s")], "inner").where(F.col("bucket") == F.col("cut_bucket"))
    inside = inside.groupBy("source", "before", "rest", F.struct("draw", "size", "tie").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    size = F.col("key.size")
    in_order = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("before") + F.coalesce(F.sum(size * F.col("n")).over(in_order), F.lit(0))
    # one more row as long as more than half of it is in the rest
    fit = F.when(size > 0, F.greatest(F.lit(0), F.least(F.col("n"), F.floor((2 * F.col("rest") - 2 * so_far + size) / (2 * size))))).when(so_far <= F.col("rest"), F.col("n")).otherwise(0)
    taken = inside.withColumn("fit", fit).where("fit > 0").groupBy(F.col("source").alias("__t")).agg(F.max(F.struct("key", "fit", "n")).alias("c"))
    return cross.join(taken, same(cross, taken, [("__s", "__t")]), "left").select("__s", "cut_bucket", F.col("c.key").alias("cut_key"), F.col("c.fit").alias("cut_fit"), F.col("c.n").alias("cut_rows"))


def bucket_of(draw: Column, buckets: Column) -> Column:
    return F.floor(draw.cast("double") / _SPAN * buckets).cast("long")


def _last_row(tied: DataFrame, source: str, row: str, fit: str) -> DataFrame:
    """Of a written table of equal rows, per source the row number up to which ``fit`` of them stand: partitions are counted first, and only one partition's rows are put in order."""
    counts = tied.groupBy(col(source).alias("s"), col(fit).alias("fit"), F.shiftright(col(row), 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where(F.col("before") < F.col("fit"))
    last = materialize(counts.groupBy("s", "fit").agg(F.max(F.struct("part", "before")).alias("c")).select(F.col("s").alias("__s"), F.col("fit").alias("__fit"), F.col("c.part").alias("__part"), F.col("c.before").alias("__before")), "mix-tie-parts")
    own = attach(tied.select(col(source).alias("s"), col(row).alias("r")), last, [("s", "__s")], "inner").where(F.shiftright("r", 33) == F.col("__part"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("s").orderBy("r")) + F.col("__before"))
    return materialize(ranked.where(F.col("rank") == F.col("__fit")).select(F.col("s").alias("__s"), F.col("r").alias("__last")), "mix-tie-rows", keep=True)


@scratched
def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, max_epochs: int = 2, seed: int = 7, cycle: tuple[int, ...] = (5, 2, 1), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prefix: str = "__") -> DataFrame:
    """Each row of ``docs`` with ``__size`` (words), ``__source_size``, ``__target`` and ``__copies`` (how often the mix takes it).

    The mix holds ``share`` times the words of ``docs``, shared among sources by weight (``weights``: columns source,
    weight > 0; a source that is missing there is not taken; if None, ``cycle`` repeats over the sources by code point,
    null last) with at most ``max_epochs`` repetitions of a source. A source with a target of t times its words gives
    floor(t) whole repetitions of all its documents; the fraction is a seeded prefix of its documents in hash order
    whose words come nearest to the rest, whole documents always.

    Nulls: a null source is a source; a null text has no words; a null id draws by text. Documents without words are
    taken like any others and add nothing. Equal rows (id, text and source alike) draw alike; of those at the cut as
    many repeat as the rest asks for, the first in the order of the input's partitions. No documents: no rows. Other
    columns pass through, but for one that has an added name (``prefix`` begins them), which is replaced.
    """
    p = free_prefix(docs)
    own = [id_col, text_col, source_col]
    sized = docs.select(*[col(c).alias(a) for c, a in zip(own, ("doc_id", "text", "source"), strict=True)])
    sized = sized.select("source", word_count(F.col("text")).alias("size"), draw_key(F.col("doc_id"), F.col("text"), seed).alias("draw"), F.xxhash64("text").alias("tie"))
    sized = materialize(sized, "mix-sizes")
    sources = materialize(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    total = share * (sources.agg(F.sum("size")).first()[0] or 0)
    if weights is None:
        sources = numbered(sources).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("place") % len(cycle) + 1).cast("int"))).drop("place")
    else:
        given = weights.select(F.col("source").alias("__w"), F.col("weight").cast("double").alias("weight")).where("weight > 0")
        sources = sources.join(given, sources["source"].eqNullSafe(given["__w"])).drop("__w")
    filled = capped_targets(materialize(sources, "mix-weights"), total, max_epochs)
    whole = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(max_epochs))).otherwise(0).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("size"))
    filled = materialize(filled.select("source", "size", "target", "whole", "rest", F.ceil(F.sqrt("n")).alias("buckets")), "mix-targets")
    cuts = _cuts(sized, filled)
    plan = filled.join(cuts, filled["source"].eqNullSafe(cuts["__s"]), "left").drop("__s")
    names = {"source": "source", "size": "source_size", "target": "target"}
    plan = materialize(plan.select(*[F.col(c).alias(p + names.get(c, c)) for c in plan.columns]), "mix-plan", keep=True)
    rows = docs.withColumn(p + "size", word_count(col(text_col))).withColumn(p + "draw", draw_key(col(id_col), col(text_col), seed)).withColumn(p + "tie", F.xxhash64(col(text_col)))
    rows = attach(rows, plan, [(source_col, p + "source")])
    key = F.struct(col(p + "draw").alias("draw"), col(p + "size").alias("size"), col(p + "tie").alias("tie"))
    rows = rows.withColumn(p + "at", F.coalesce(key == col(p + "cut_key"), F.lit(False)))
    bucket = bucket_of(col(p + "draw"), col(p + "buckets"))
    extra = (bucket < col(p + "cut_bucket")) | ((bucket == col(p + "cut_bucket")) & (key < col(p + "cut_key"))) | col(p + "at")
    added = {"size": "size", "source_size": "source_size", "target": "target"}

    def with_copies(part: DataFrame, once_more: Column) -> DataFrame:
        copies = F.coalesce(col(p + "whole"), F.lit(0)) + F.when(once_more, 1).otherwise(0)
        rest = [c for c in docs.columns if c.lower() not in {prefix + a for a in (*added, "copies")}]
        return part.select(*columns(rest), *[col(p + a).alias(prefix + a) for a in added], copies.alias(prefix + "copies"))

    if not plan.where(col(p + "cut_fit") < col(p + "cut_rows")).limit(1).count():
        return with_copies(rows, extra)
    split = col(p + "at") & (col(p + "cut_fit") < col(p + "cut_rows"))
    tied = materialize(rows.where(split).withColumn(p + "row", F.monotonically_increasing_id()), "mix-ties", keep=True)
    last = _last_row(tied, source_col, p + "row", p + "cut_fit").withColumnsRenamed({"__s": p + "s", "__last": p + "last"})
    tied = attach(tied, last, [(source_col, p + "s")])
    return with_copies(rows.where(~F.coalesce(split, F.lit(False))), extra).unionByName(with_copies(tied, col(p + "row") <= col(p + "last")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    p = free_prefix(docs)
    mixed = mix(docs, prefix=p, **options)
    return mixed.withColumn(p + "copy", F.explode(F.array_repeat(F.lit(0), col(p + "copies").cast("int")))).select(*columns(docs.columns))
