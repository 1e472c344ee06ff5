"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings over hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplery.llm.common import SPACE, col, columns, free_prefix, materialize, scratched
from samplery.shipping import map_arrow

#: Buckets of the hashed features: words below ``WORDS``, shapes from there on.
BUCKETS, WORDS = 1 << 18, 1 << 17
#: Bound of the labelled documents that the fit gathers.
TRAIN_ROWS = 8000
#: A bucket needs this many training documents, and this many standard errors between the shares of documents that hold
#: it above and below some grade, to get a weight; others weigh nothing, or rare words would learn single documents.
LEAST_DOCS, LEAST_Z = 5, 4.0
#: Weight of the share of words that repeat the word before.
REPEAT = 5.0
#: A document is selected if its chance of the top grade is at least this.
SELECT = 0.5
#: Words whose buckets a worker remembers.
CACHE = 150_000
#: Rows that go back to Spark at once, as they carry their texts.
SLICE = 1000

_SHAPES = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]{2,}"), b"B"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^a-zA-Z0-9])\1+"), rb"\1\1"))


_MARKS = bytes(k for k in range(33, 127) if not chr(k).isalnum())


def word_buckets(word: bytes) -> tuple[int, int]:
    """Bucket of the word in lower case without the marks around it, and of its shape (kinds of letters, digits, and its marks)."""
    shape = word
    for pattern, to in _SHAPES:
        shape = pattern.sub(to, shape)
    return zlib.crc32(word.strip(_MARKS).lower() or word) % WORDS, WORDS + zlib.crc32(shape, 1) % (BUCKETS - WORDS)


_REPEAT_BUCKET = WORDS + zlib.crc32(b"word as before", 2) % (BUCKETS - WORDS)


def repeats(words: list[bytes]) -> float:
    return sum(map(bytes.__eq__, words, words[1:])) / len(words) if words else 0.0


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a whole text: each different word gives 1 to its own bucket and 1 / sqrt(number of different words) to its shape's."""
    words = (text or "").encode("utf-8", "replace").split()
    own = set(words)
    at = np.array([b for w in own for b in word_buckets(w)] + [_REPEAT_BUCKET], np.int64)
    buckets, inverse = np.unique(at, return_inverse=True)
    value = np.r_[np.tile([1.0, 1 / max(1, len(own)) ** 0.5], len(own)), REPEAT * repeats(words)]
    return buckets, np.bincount(inverse, value)


@dataclass
class OrdinalModel:
    """Chance of a grade above k: 1 / (1 + exp(thresholds[k] - score)), with one shared score and rising thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """(n, grades - 1) chances of a grade above k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def thresholds(param: np.ndarray, weights: int) -> np.ndarray:
    """The parameters after the weights: the first threshold, and the logarithms of the steps to the next ones, which keep them apart."""
    return np.cumsum(np.r_[param[weights], np.exp(param[weights + 1 :])])


def loss(param: np.ndarray, y: np.ndarray, doc: np.ndarray, at: np.ndarray, value: np.ndarray, weights: int, ridge: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of the grades ``y`` with half a ridge on the weights, and its gradient; ``value[k]`` is feature ``at[k]`` of document ``doc[k]``."""
    big, n, grades = 50.0, len(y), len(param) - weights + 1
    score = np.bincount(doc, value * param[at], n)
    cut = np.r_[-big, thresholds(param, weights), big]
    upper = 1 / (1 + np.exp(-np.clip(cut[y + 1] - score, -big, big)))
    lower = 1 / (1 + np.exp(-np.clip(cut[y] - score, -big, big)))
    chance = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
    slope = (du - dl) / n  # by score
    by_cut = (np.bincount(y + 1, -du, grades + 1) + np.bincount(y, dl, grades + 1))[1:grades] / n
    tail = np.cumsum(by_cut[::-1])[::-1]
    grad = np.r_[np.bincount(at, value * slope[doc], weights) + ridge * param[:weights], tail[:1], tail[1:] * np.exp(param[weights + 1 :])]
    return float(-np.log(chance).mean() + ridge / 2 * (param[:weights] ** 2).sum()), grad


def fit_ordinal(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, steps: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood with a ridge by Adam on all rows; rows hold grade, buckets and values.

    A single word may lower the score but not raise it: else the many plain words of a long text would outweigh the
    few that are wrong with it. Shapes, which are shares of the text, go both ways.
    """
    y = np.array([r[0] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at = np.concatenate([r[1] for r in rows])
    value = np.concatenate([r[2] for r in rows])
    held = np.bincount(at, minlength=BUCKETS)
    apart = np.zeros(BUCKETS)
    for k in range(grades - 1):
        p = max(1e-6, (y > k).mean())
        apart = np.maximum(apart, np.abs(np.bincount(at, (y > k)[doc], BUCKETS) - held * p) / np.sqrt(np.maximum(held, 1) * p * max(1e-6, 1 - p)))
    used = np.flatnonzero((held >= LEAST_DOCS) & (apart >= LEAST_Z) | (np.arange(BUCKETS) == _REPEAT_BUCKET))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    own = place[at] >= 0
    doc, at, value = doc[own], place[at[own]], value[own]
    # thresholds start at the log odds of the grades' shares, and are kept apart by exponential steps
    share = np.clip(np.array([(y <= k).mean() for k in range(grades - 1)]), 1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    param = np.r_[np.zeros(len(used)), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))]
    m, v = np.zeros_like(param), np.zeros_like(param)

    for step in range(1, steps + 1):
        grad = loss(param, y, doc, at, value, len(used), ridge)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        param = param - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        param[: len(used)] = np.where(used < WORDS, np.minimum(param[: len(used)], 0), param[: len(used)])
    weights = np.zeros(BUCKETS)
    weights[used] = param[: len(used)]
    return OrdinalModel(weights, thresholds(param, len(used)))


def grades_of(labels: DataFrame) -> DataFrame:
    """``doc_id``, ``grade``: 0 for poor text, 1 for good but toxic text, 2 for good clean text; of several labels the worst counts.

    Labels without an id or a quality are left out; a null toxic counts as not toxic.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    grade = F.when(F.col("quality") <= 0, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    return rows.groupBy("doc_id").agg(F.min(grade).alias("grade"))


@scratched
def train(docs: DataFrame, labels: DataFrame, grades: int = 3, rows: int = TRAIN_ROWS, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel | None:
    """The model from at most ``rows`` labelled documents (a sample by hash); None without labelled documents.

    The labelled ids are chosen first, so that only their texts are read into features. Where ids repeat, of all their
    rows the ``rows`` first by a hash of id and text are taken, equal rows once; no more than these come to the driver.
    """
    chosen = grades_of(labels).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    chosen = materialize(chosen.select(F.col("doc_id").alias("__id"), "grade"), "graded")
    own = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(x.as_py()) for x in b.column("text")]
            columns = [pa.array([f[k].astype(t).tobytes() for f in found], pa.binary()) for k, t in ((0, "<i4"), (1, "<f4"))]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("grade"), *columns], ["key", "grade", "buckets", "value"])

    keyed = own.select(F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"), "grade", "text")
    different = map_arrow(keyed, run, "key long, grade int, buckets binary, value binary").groupBy("key").agg(F.min(F.struct("grade", "buckets", "value")).alias("row"))
    got = [r[0] for r in different.orderBy("key").limit(rows).select("row").collect()]
    if not got:
        return None
    return fit_ordinal([(r[0], np.frombuffer(r[1], "<i4").astype(np.int64), np.frombuffer(r[2], "<f4").astype(float)) for r in sorted(got)], grades)


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", prefix: str = "__") -> DataFrame:
    """``docs`` with ``__grade`` (expected grade) and ``__tail`` (chance of the top grade) of the whole text.

    The text goes to Python next to the row's other columns, batch by batch; the model travels as one broadcast of
    fixed size.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    rest = [c for c in docs.columns if c.lower() not in (prefix + "grade", prefix + "tail")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = shared.value
        own = OrdinalModel(weights, cuts)
        known: dict[bytes, tuple[float, float]] = {}
        alike: dict[tuple[float, float], tuple[float, float]] = {}  # most words weigh alike: one object for all of them
        for b in (whole.slice(k, SLICE) for whole in batches for k in range(0, len(whole), SLICE)):
            scores = np.zeros(len(b))
            for k, x in enumerate(b.column(text_col)):
                words = (x.as_py() or "").encode("utf-8", "replace").split()
                different = set(words)
                if len(known) > CACHE:
                    known.clear()
                    alike.clear()
                for w in different.difference(known):
                    i, j = word_buckets(w)
                    pair = float(weights[i]), float(weights[j])
                    known[w] = alike.setdefault(pair, pair)
                own_, shape = map(sum, zip(*map(known.__getitem__, different), strict=True)) if different else (0.0, 0.0)
                scores[k] = own_ + shape / max(1, len(different)) ** 0.5 + REPEAT * repeats(words) * float(weights[_REPEAT_BUCKET])
            tails = own.tails(scores)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], [*rest, prefix + "grade", prefix + "tail"])

    return map_arrow(docs, run, T.StructType([*[docs.schema[c] for c in rest], *[T.StructField(prefix + c, T.DoubleType()) for c in ("grade", "tail")]]))


def classify(docs: DataFrame, labels: DataFrame, select: float = SELECT, id_col: str = "doc_id", text_col: str = "text", prefix: str = "__") -> DataFrame:
    """``docs`` with ``__grade``, ``__tail`` and ``__kept`` (``__tail`` >= ``select``).

    Nulls: a null text, or one without words, has nothing to judge: grade and tail are null and it is kept. A null id
    is judged like any other. Without labelled documents nothing is judged and all is kept. Equal rows are judged
    alike. No documents: no rows. Other columns pass through, but for one that has an added name (``prefix`` begins
    them), which is replaced.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    grade, tail = prefix + "grade", prefix + "tail"
    if model is None:
        out = docs.withColumns({c: F.lit(None).cast("double") for c in (grade, tail)})
    else:
        wordless = F.coalesce(F.btrim(col(text_col), F.lit(SPACE)) == "", F.lit(True))
        out = score(docs, model, text_col, prefix)
        out = out.withColumns({c: F.when(~wordless, col(c)) for c in (grade, tail)})
    return out.withColumn(prefix + "kept", F.coalesce(col(tail) >= select, F.lit(True)))


def selected(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The kept documents with the columns of ``docs``."""
    p = free_prefix(docs)
    return classify(docs, labels, prefix=p, **options).where(col(p + "kept")).select(*columns(docs.columns))
