"""Sharding by extendible hashing (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplery.llm.common import attach, col, columns, free_prefix, materialize, scratched

#: Bits of the hash that the directory may use.
BITS = 60
#: Production limit of a shard's text, in bytes.
SHARD_BYTES = 64 << 20


def shard_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of an MD5 over id and text; ids that repeat or are null still spread by text."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _high_bits(value: Column, have: int, depth: Column) -> Column:
    """The first ``depth`` of ``have`` bits."""
    return F.call_function("shiftright", value, (F.lit(have) - depth).cast("int"))


def _directory(slots: DataFrame, bits: int, limit: int) -> DataFrame:
    """For each directory slot (``slot`` of ``bits`` bits, ``bytes``, ``alone``) the bucket that holds it: ``depth``, ``shard_bytes``.

    A bucket splits on one more bit as long as it is over ``limit``, so a slot's bucket is its shortest prefix that
    fits. Slots that do not fit even by themselves have a null depth, or depth 60 if all their rows have one hash.
    """
    at = slots.select("slot", "bytes", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    at = at.withColumn("prefix", _high_bits(F.col("slot"), bits, F.col("depth")))
    fits = at.groupBy("depth", "prefix").agg(F.sum("bytes").alias("held")).where(F.col("held") <= limit)
    fits = fits.select(F.col("depth").alias("d"), F.col("prefix").alias("p"), "held")
    found = at.join(fits, (at["depth"] == fits["d"]) & (at["prefix"] == fits["p"])).groupBy(F.col("slot").alias("s")).agg(F.min(F.struct("depth", "held")).alias("b"))
    out = slots.join(found, slots["slot"] == found["s"], "left")
    lone = F.col("b").isNull() & F.col("alone")
    return out.select("slot", F.when(lone, BITS).otherwise(F.col("b.depth")).alias("depth"), F.when(lone, F.col("bytes")).otherwise(F.col("b.held")).alias("shard_bytes"))


@scratched
def shard(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", prefix: str = "__") -> DataFrame:
    """Each row of ``docs`` with ``__bytes``, ``__depth``, ``__shard`` (its bucket's hash prefix as text of bits) and ``__shard_bytes``.

    The directory has a slot for each prefix of as many bits as the whole size asks for, and a few more; the sums of
    the slots roll up to all shorter prefixes. Slots still over the limit get a deeper directory of their own in the
    next round. One document larger than ``limit``, or equal rows (same id and text) larger than it together, cannot
    be split by any hash: they are a shard of depth 60, alone.

    Nulls: a null text has no bytes; a null id hashes by text. No documents: no rows. Other columns pass through, but
    for one that has an added name (``prefix`` begins them), which is replaced.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    p = free_prefix(docs)
    size = F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long")
    narrow = docs.select(shard_hash(col(id_col), col(text_col)).alias("h"), size.alias("bytes"))
    narrow = materialize(narrow, "shard-sizes")
    total = narrow.agg(F.sum("bytes")).first()[0] or 0
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, total) / limit))) + 4)
    rows, rounds = narrow, []
    while True:
        slots = rows.groupBy(_high_bits(F.col("h"), BITS, F.lit(bits)).alias("slot")).agg(F.sum("bytes").alias("bytes"), (F.min("h") == F.max("h")).alias("alone"))
        found = _directory(materialize(slots, "shard-slots"), bits, limit)
        if bits == BITS:
            found = found.withColumn("depth", F.coalesce("depth", F.lit(BITS)))
        found = materialize(found, "shard-directory", keep=True)
        rounds.append((bits, found))
        over = found.where(F.col("depth").isNull()).select("slot")
        if bits == BITS or not over.limit(1).count():
            break
        over = materialize(over.withColumnRenamed("slot", "__slot"), "shard-over")
        rows = attach(rows.withColumn("__at", _high_bits(F.col("h"), BITS, F.lit(bits))), over, [("__at", "__slot")], "left_semi").select("h", "bytes")
        bits = min(BITS, bits + 8)
    out = docs.withColumn(p + "h", shard_hash(col(id_col), col(text_col))).withColumn(p + "bytes", size)
    depth, held = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, (bits, found) in enumerate(rounds):
        names = [F.col(c).alias(f"{p}{c}{k}") for c in ("slot", "depth", "shard_bytes")]
        out = attach(out.withColumn(f"{p}at{k}", _high_bits(col(p + "h"), BITS, F.lit(bits))), found.select(*names), [(f"{p}at{k}", f"{p}slot{k}")])
        depth, held = F.coalesce(depth, col(f"{p}depth{k}")), F.coalesce(held, col(f"{p}shard_bytes{k}"))
    out = out.withColumn(p + "depth", depth.cast("int"))
    name = F.call_function("lpad", F.bin(_high_bits(col(p + "h"), BITS, col(p + "depth"))), col(p + "depth"), F.lit("0"))
    added = {"bytes": col(p + "bytes"), "depth": col(p + "depth"), "shard": name, "shard_bytes": held}
    rest = [c for c in docs.columns if c.lower() not in {prefix + a for a in added}]
    return out.select(*columns(rest), *[c.alias(prefix + a) for a, c in added.items()])


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, **options) -> None:
    """Writes each shard as a folder ``shard=s<bits>`` (a column ``shard`` of ``docs`` is replaced).

    As a shard fits the limit, one task writes it; rows of one that no hash can split are spread over as many tasks as
    they fill limits.
    """
    p = free_prefix(docs)
    sharded = shard(docs, limit, prefix=p, **options)
    rest = [c for c in docs.columns if c.lower() != "shard"]
    part = F.pmod(F.monotonically_increasing_id(), F.ceil(F.greatest(col(p + "shard_bytes"), F.lit(1)) / limit)).alias(p + "part")
    dealt = sharded.select(*columns(rest), F.concat(F.lit("s"), col(p + "shard")).alias("shard"), part).repartition("shard", p + "part")
    dealt.drop(p + "part").write.partitionBy("shard").parquet(path)
