"""SimHash near-dedup: fingerprints, exact search within a Hamming radius by bit-sliced comparison, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplery.llm.bitslice import local_roots, pairs_within
from samplery.llm.common import attach, col, columns, connected_components, deal_buckets, free_prefix, materialize, scratched
from samplery.shipping import map_arrow

#: Fingerprints to a block of a large bucket.
BLOCK = 512
#: Lanes that one bit-sliced comparison holds.
LANES = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles: lower-cased A-Z, repeats included; no words: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only ASCII letters and white space count
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``tie`` (hash of the text) and ``fp`` (the fingerprint as a signed long), one row per document, written."""
    rows = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("tie"), col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(fps.view(np.int64))], ["doc_id", "tie", "fp"])

    kind = dict(rows.dtypes)["doc_id"]
    return materialize(map_arrow(rows, run, f"doc_id {kind}, tie long, fp long"), "fingerprints", keep=True)


def block_masks(n: int, radius: int) -> list[int]:
    """Masks of key bits: fingerprints within ``radius`` agree on all bits of at least one mask.

    The 64 bits are cut into radius + j blocks and each mask takes j of them (at most ``radius`` blocks can differ).
    j grows with the number of fingerprints, so that buckets of unlike fingerprints stay small.
    """
    j = 1 if n <= 1 << 22 else 2 if n <= 1 << 28 else 3
    edges = [64 * k // (radius + j) for k in range(radius + j + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, j)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(radius: int):
    """Links of the complete groups of a sorted stream, as edges from each fingerprint to the smallest that it reaches in its group."""

    def edges(fps: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fps, groups))
        fps, groups = fps[order], groups[order]
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]), len(groups)])
        size_of = np.repeat(sizes, sizes)
        u, v = [], []
        low = 1
        while low < (sizes.max() if len(sizes) else 0):  # groups of like size together: the largest sets the number of shifts
            own = (size_of > low) & (size_of <= 2 * low)
            f, g = fps[own], groups[own]
            i, j = pairs_within(f.view(np.uint64), g, radius)
            root = local_roots(len(f), i, j)
            linked = root != np.arange(len(f))
            u.append(f[linked])
            v.append(f[root[linked]])
            low *= 2
        empty = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *u])), pa.array(np.concatenate([empty, *v]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, groups = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            fps = np.r_[fps, b.column("fp").to_numpy()]
            groups = np.r_[groups, b.column("grp").to_numpy()]
            if len(fps) >= LANES:
                whole = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
                yield edges(fps[:whole], groups[:whole])
                fps, groups = fps[whole:], groups[whole:]
        yield edges(fps, groups)

    return run


@scratched
def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges ``u``, ``v`` that connect all fingerprints (column ``fp``, each once, a written table) at distance <= radius.

    Fingerprints meet in buckets by the bits of each mask; none within the radius is missed. Buckets over ``BLOCK``
    rows go to several tasks as pairs of blocks.
    """
    masks = block_masks(fps.count(), radius)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(masks)])).alias("key"))
    dealt = deal_buckets(keyed.select("fp", "key.t", "key.bits"), ["t", "bits"], "fp", BLOCK)
    dealt = dealt.select("fp", "grp").repartition("grp").sortWithinPartitions("grp")
    return materialize(map_arrow(dealt, _stars(radius), "u long, v long"), "fingerprint-links", keep=True)


@scratched
def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``tie``, ``fp``, ``root`` (its component's fingerprint) and ``component_id`` (smallest doc_id of the component), one row per document.

    Equal fingerprints are one node, so groups of copies never meet in a task; only different fingerprints are
    compared, and only components of fingerprints reach the documents.

    Nulls: a null or empty text has fingerprint 0 and links like any other; a null doc_id gets a fingerprint and a
    component, but is never its smallest id (null only if a component has no id). Equal rows are in one component. No
    documents: no rows.
    """
    rows = fingerprints(docs, id_col, text_col, shingle)
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    parts = connected_components(fingerprint_links(nodes.select("fp"), radius))
    rooted = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = materialize(rooted, "fingerprint-roots")
    named = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    labelled = rooted.join(named, rooted["root"] == named["r"]).select(F.col("fp").alias("f"), "root", "component_id")
    labelled = materialize(labelled, "fingerprint-components", keep=True)
    return rows.join(labelled, rows["fp"] == labelled["f"]).drop("f")


def hex_of(fp: str):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


@scratched
def without_near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id (null last, then by the text's hash), with the columns of ``docs``. Ids may be of any ordered type."""
    p = free_prefix(docs)
    found = materialize(near_duplicates(docs, radius, shingle, id_col, text_col), "near-duplicates")
    rank = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("tie"))
    best = found.groupBy(F.col("root").alias("r")).agg(F.min(rank).alias("best"), F.sum(F.lit(1)).alias("n"))
    best = materialize(best.where("n > 1"), "near-duplicate-groups").drop("n")
    member = found.join(best, found["root"] == best["r"]).withColumn("stays", rank.eqNullSafe(F.col("best")))
    marked = member.groupBy("doc_id", "tie").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = marked.select(F.col("doc_id").alias(p + "id"), F.col("tie").alias(p + "tie"), F.col("stays").alias(p + "stays"), F.col("n").alias(p + "n"))
    marked = materialize(marked.where(~col(p + "stays") | (col(p + "n") > 1)), "near-duplicate-marks", keep=True)
    rows = docs.withColumn(p + "t", F.xxhash64(col(text_col)))
    on, own = [(id_col, p + "id"), (p + "t", p + "tie")], columns(docs.columns)
    kept = attach(rows, marked.select(p + "id", p + "tie"), on, "left_anti").select(*own)
    again = materialize(marked.where(p + "stays"), "near-duplicate-repeats", keep=True).select(p + "id", p + "tie")
    if again.limit(1).count():  # equal rows, of which one stays
        once = attach(rows, again, on, "left_semi").groupBy(col(id_col), p + "t").agg(F.first(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(own)])).alias(p + "row"))
        kept = kept.unionByName(once.select(*[F.col(f"{p}row.c{k}").alias(c) for k, c in enumerate(docs.columns)]))
    return kept
