"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplery.llm.common import SPACE, attach, col, columns, free_prefix, materialize, quoted, scratched

#: A line on more than this share of a host's pages is boilerplate.
RATIO = 0.1
#: Hosts, and digests of 16 bytes in all their lists, up to which the lists are broadcast.
BROADCAST_HOSTS, BROADCAST_LINES = 20_000, 500_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(value: Column) -> Column:
    """128 bits of two differently seeded hashes."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(7), value).alias("b"))


def _core(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


@scratched
def boilerplate(docs: DataFrame, ratio: float = RATIO, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``host``, ``line`` (digest) of each host's boilerplate lines, a written table.

    Pages are a host's different texts: copies of a page count once. A line counts once on a page, without the white
    space around it; blank lines don't count. A line is boilerplate if more than one page holds it and its pages are
    more than ``ratio`` of the host's, at any number of pages; a line of a single page repeats nothing. A host has at
    most (lines a page / ratio) such lines, however many pages it has.
    """
    pages = docs.where(col(text_col).isNotNull()).select(col(host_col).alias("host"), col(text_col).alias("text"))
    totals = pages.select("host", _digest(F.col("text")).alias("page")).distinct().groupBy(F.col("host").alias("__h")).agg(F.count(F.lit(1)).alias("pages"))
    totals = materialize(totals, "host-pages")
    cores = F.filter(F.transform(_lines(F.col("text")), _core), lambda x: x != "")
    seen = pages.select("host", _digest(F.col("text")).alias("page"), F.explode(F.array_distinct(F.transform(cores, _digest))).alias("line"))
    counts = seen.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = attach(counts, totals, [("host", "__h")], "inner").where(F.col("n") / F.col("pages") > ratio)
    return materialize(often.select("host", "line"), "boilerplate", keep=True)


def _with_lists(docs: DataFrame, bad: DataFrame, out: str, host_col: str, text_col: str) -> DataFrame:
    """``docs`` with the array ``out`` of boilerplate digests (null: none).

    Hosts' lists travel as a broadcast of bounded size. If they are larger, lines meet them by (host, digest) without
    their texts, and a page gets just the digests that it holds: texts are then shuffled by page, never by host.
    """
    p = free_prefix(docs)
    hosts = materialize(bad.groupBy("host").agg(F.collect_list("line").alias("lines")), "boilerplate-lists", keep=True).withColumnsRenamed({"host": p + "host", "lines": out})
    if bad.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES and hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        return attach(docs, hosts, [(host_col, p + "host")], rows=BROADCAST_HOSTS)
    text = col(text_col)
    pages = docs.where(text.isNotNull()).select(col(host_col).alias("host"), _digest(text).alias("page"), F.explode(F.array_distinct(F.transform(_lines(text), lambda x: _digest(_core(x))))).alias("line")).distinct()
    named = bad.withColumnsRenamed({"host": "h", "line": "l"})
    held = pages.join(named, pages["host"].eqNullSafe(named["h"]) & (pages["line"] == named["l"]))
    held = materialize(held.groupBy(F.col("host").alias(p + "host"), F.col("page").alias(p + "of")).agg(F.collect_list("line").alias(out)), "boilerplate-pages", keep=True)
    return attach(docs.withColumn(p + "page", F.when(text.isNotNull(), _digest(text))), held, [(host_col, p + "host"), (p + "page", p + "of")], rows=0).drop(p + "page")


@scratched
def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, host_col: str = "source", text_col: str = "text", prefix: str = "__") -> DataFrame:
    """``docs`` with ``__text`` (the text without its host's boilerplate lines), ``__lines`` and ``__dropped`` (line counts).

    Nulls: a null host is a host; a null text stays null with no lines. An empty text has one blank line; blank lines
    always stay. A text of boilerplate only becomes empty; its row stays. Equal rows are one page. No documents: no
    rows. Other columns pass through, but for one that has an added name (``prefix`` begins them), which is replaced.
    """
    p = free_prefix(docs)
    rows = _with_lists(docs, boilerplate(docs, ratio, host_col, text_col), p + "bad", host_col, text_col)
    lines = _lines(col(text_col))
    kept = F.filter(lines, lambda x: (_core(x) == "") | ~F.array_contains(col(p + "bad"), _digest(_core(x))))
    rows = rows.withColumn(p + "kept", F.when(col(p + "bad").isNull(), lines).otherwise(kept))
    count = lambda c: F.when(col(text_col).isNull(), 0).otherwise(F.size(c)).cast("long")
    added = {"text": F.array_join(quoted(p + "kept"), "\n"), "lines": count(lines), "dropped": count(lines) - count(col(p + "kept"))}
    rest = [c for c in docs.columns if c.lower() not in {prefix + a for a in added}]
    return rows.select(*columns(rest), *[c.alias(prefix + a) for a, c in added.items()])


def without_boilerplate(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The cleaned documents with the columns of ``docs``; ``n_chars``, if there, is counted again."""
    p = free_prefix(docs)
    clean = drop_boilerplate(docs, text_col=text_col, prefix=p, **options)
    new = {text_col: col(p + "text")} | ({"n_chars": F.length(col(p + "text")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return clean.select(*[new.get(c, col(c)).alias(c) for c in docs.columns])
