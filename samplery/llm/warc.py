"""WARC archives: writing with payload dedup, reading back, and one globally ordered capture index merged from sorted runs."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplery.llm.common import attach, materialize, scratch_path, scratched
from samplery.shipping import map_arrow

#: Index rows to a task of the merge, and records to an archive.
MERGE_ROWS, ARCHIVE_ROWS = 100_000, 50_000
#: What ends a record, and a record's headers.
GAP = "\r\n\r\n"
_ID = "urn:samplery:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: Column) -> Column:
    """Base32 of the SHA-1: each 5 hex digits are 4 digits of base 32."""
    sha = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(sha, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Sort key of a URL: lower-case host labels from the last to the first, without scheme, user, port and ``www``, then path and query."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", ""), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\d*\.", ""), r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


@scratched
def write_archives(pages: DataFrame, path: str, time: Column | None = None, archive_rows: int = ARCHIVE_ROWS) -> None:
    """Writes one record per row of ``pages`` (``page_id``, ``url``, ``html``) as gzip archives under ``path``: each partition's records, ``archive_rows`` to an archive.

    Of the rows with equal payloads, those with the largest page_id are written as responses and the others as
    revisits of it, without their payload. Rows are sorted by URL key and time within each archive, so each is a
    sorted run of captures. ``time`` is the capture time (default: as many seconds after 2024 begins as the page_id).
    Spark's text writer commits the archives: a record ends with the blank lines that the format asks for, and a retried
    task leaves no half archive. No payload is shuffled unless the digests of repeated payloads are too many for a
    broadcast.
    """
    id_text = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    when = time if time is not None else F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.pmod("page_id", F.lit(1 << 31)), F.lit(0)))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), when.alias("time"))
    repeated = rows.select(payload_digest(F.col("html")).alias("digest"), "page_id").groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(repeated.where("n > 1").select(F.col("digest").alias("d"), "first"), "repeated-payloads")
    rows = attach(rows.withColumn("digest", payload_digest(F.col("html"))), repeated, [("digest", "d")])
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.octet_length("html").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    target = F.coalesce(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("urn:samplery:unknown"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{_ID}"), id_text, F.lit(">"))),
        line("WARC-Date", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", F.concat(F.lit(f"<{_ID}"), F.col("first").cast("string"), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    runs = rows.select(record.alias("value"), url_key(F.col("url")).alias("key"), "time", "page_id").sortWithinPartitions("key", "time", "page_id")
    runs.select("value").write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", archive_rows).text(path)


def records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive that comes as its parts between ``GAP``s; raises ValueError where it isn't one."""
    gap = GAP.encode()
    rest: bytes | None = b""
    while True:
        while rest is not None and not (rest := rest.lstrip(b"\r\n")):
            rest = next(parts, None)
        if rest is None:
            return
        if not rest.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {rest[:40]!r}")
        lines = [x.partition(":") for x in rest.decode("utf-8").split("\r\n")[1:]]
        headers = {name.strip().lower(): value.removeprefix(" ") for name, _, value in lines}  # a URL may end in blanks
        size = int(headers["content-length"])
        held, length = [next(parts, b"")], 0
        length = len(held[0])
        while length < size:
            part = next(parts, None)
            if part is None:
                raise ValueError("the archive ends within a record")
            held.append(part)
            length += len(gap) + len(part)
        block = gap.join(held)
        rest = block[size:]
        yield headers, block[:size]


def capture(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, type, digest, refers_to, payload bytes, URL, date of a record; a response's payload must have its digest."""
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:] if ": " in x)
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {headers['warc-record-id']} is not what its digest says")
    number = lambda x: None if x in (None, "null") else int(x)
    of = lambda name: number(headers[name][1:-1].removeprefix(_ID)) if name in headers else None
    size = len(payload) if headers["warc-type"] == "response" else int(fields["Content-Length"])
    return of("warc-record-id"), headers["warc-type"], digest, of("warc-refers-to"), size, headers["warc-target-uri"], headers["warc-date"]


_INDEX = "page_id long, record_type string, payload_digest string, refers_to long, payload_bytes long, url string, date string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives under ``path``: the columns of the index, and ``run`` and ``place`` (archive and position in it).

    Spark's text reader unpacks an archive and streams it in parts between blank lines, in order, to one task, which
    puts the records together again: it holds one record at a time, however large the archive is.
    """
    lines = spark.read.option("lineSep", GAP).option("pathGlobFilter", "*.gz").text(path).select(F.col("_metadata.file_path").alias("run"), F.col("value").cast("binary").alias("value"))
    names = [x.split()[0] for x in _INDEX.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*names, "run", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((name, value.as_py()) for b in batches for name, value in zip(b.column("run").to_pylist(), b.column("value"), strict=True))
        got = []
        for name, own in groupby(each, lambda x: x[0]):
            for place, (headers, block) in enumerate(records(x[1] for x in own)):
                got.append((*capture(headers, block), name, place))
                if len(got) == 5000:
                    yield pack(got)
                    got = []
        if got:
            yield pack(got)

    return map_arrow(lines, run, f"{_INDEX}, run string, place long")


def loser_tree(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges sorted iterators. Each inner node holds the loser of its match, so a new item replays one path to the root."""
    k = len(runs)
    heads: list[tuple | None] = [next(r, None) for r in runs]

    def beats(a: int, b: int) -> bool:
        """An exhausted run loses; of equal heads the earlier run wins."""
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a], a) < (heads[b], b)

    if not k:
        return
    losers = [-1] * k
    winner = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winner[1] if k > 1 else 0
    while heads[best] is not None:
        yield heads[best]
        heads[best] = next(runs[best], None)
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def merged(rows: pa.Table) -> np.ndarray:
    """The order of a range's rows, which come run after run, by URL key, date and page_id (null first): each run is a sorted slice, and the slices are merged."""
    key, date, page = (rows.column(c).to_pylist() for c in ("url_key", "date", "page_id"))
    names = rows.column("run").to_numpy()
    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    runs = []
    for n, (lo, hi) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True)):
        own = [(key[k], date[k], page[k] is not None, page[k] or 0, n, k) for k in range(lo, hi)]
        if any(a > b for a, b in zip(own, own[1:], strict=False)):
            own.sort()  # a foreign archive that was not written in order
        runs.append(iter(own))
    return np.frombuffer(array("q", [x[-1] for x in loser_tree(runs)]), np.int64)


def capture_history(index: DataFrame) -> DataFrame:
    """The index in the global order of URL key, date and page_id: partitions follow one another, and are sorted inside.

    Range partitioning cuts every run (``run``, sorted by ``place``) into slices; Spark's sort, which spills, lays them
    one after another, and a task merges the slices of its range with a loser tree. It holds one range, about
    ``MERGE_ROWS`` rows however many there are in all. Ranges are cut within a URL's history too, so that one URL may
    hold any share of all rows. ``index`` must be a written table, as it is read twice.
    """
    keyed = index.withColumn("url_key", url_key(F.col("url")))
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.count() // MERGE_ROWS + 1)
    ranged = keyed.repartitionByRange(parts, "url_key", "date", "page_id", "run", "place").sortWithinPartitions("run", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(len(b) for b in held):
            rows = pa.Table.from_batches(held).combine_chunks()
            order = merged(rows)
            for lo in range(0, len(order), 10_000):
                yield from rows.take(pa.array(order[lo : lo + 10_000])).combine_chunks().to_batches()

    return map_arrow(ranged, run, keyed.schema)


@scratched
def archive_round_trip(pages: DataFrame, path: str | None = None, time: Column | None = None, archive_rows: int = ARCHIVE_ROWS) -> DataFrame:
    """Writes all ``pages`` as archives (under ``path``; else they go when their index is read), reads them back and merges their index: one row per record in capture order.

    Nulls: a null html is an empty payload; a null URL is archived as ``urn:samplery:unknown``; rows with a null
    page_id are archived without a number (revisits if an equal payload has a number). Equal rows with the largest
    page_id of their payload are all responses. No pages: no rows. Other columns of ``pages`` are not archived.
    """
    path = path or scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path, time, archive_rows)
    return capture_history(materialize(read_archives(pages.sparkSession, path), "capture-runs", keep=True))
