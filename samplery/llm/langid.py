"""Language identification in two levels: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplery.llm.common import attach, col, materialize, scratched
from samplery.shipping import map_arrow

# Language families by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "sl"),
}
#: Buckets of hashed letter n-grams of 1 to 3 bytes.
BUCKETS = 4096
#: Bounds of the documents of a language that the fit gathers, and of all languages together.
TRAIN_ROWS, TRAIN_MOST = 500, 8000
#: Rows of a language that are drawn for each one that is wanted, as its count is approximate.
SPARE = 1.5
#: Words whose scores a worker remembers.
CACHE = 150_000
UNKNOWN = "und"

def _letters() -> re.Pattern:
    """Runs of letters as ``str.isalpha`` has them: of all word characters but the digits, fractions and the like are none."""
    odd = [c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
    return re.compile(rf"[^\W\d_{''.join(odd)}]+")


#: Runs of word characters but decimal digits, which are letters but for rare characters that the slower second pattern cuts out.
_WORDS, _LETTERS = re.compile(r"[^\W\d_]+"), _letters()


def family_of(language: str) -> str:
    return next((f for f, own in FAMILIES.items() if language in own), language)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    words = _WORDS.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in ([w] if w.isalpha() else _LETTERS.findall(w))]


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, each with a blank before and after, and the word that each belongs to."""
    data = np.frombuffer((" " + " ".join(words) + " ").encode("utf-8", "replace"), np.uint8).astype(np.int64)
    blank = data == 32
    word = np.cumsum(blank) - 1  # of the blank before a word and its letters
    buckets, owners = [], []
    for n in (1, 2, 3):
        code = np.zeros(max(0, len(data) - n + 1), np.int64)
        inside = np.ones(len(code), bool)
        for k in range(n):
            part = data[k : k + len(code)]
            code = code * 257 + part + 1
            if n == 1 or 0 < k < n - 1:
                inside &= part != 32
        if n == 2:
            inside &= ~(blank[: len(code)] & blank[1:])
        bucket = (code * 2654435761 + n * 97) % 4294967291 % BUCKETS
        buckets.append(bucket[inside])
        owners.append(word[: len(code)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def features(text: str | None) -> np.ndarray:
    """Mean n-gram counts of a whole text."""
    words = words_of(text)
    if not words:
        return np.zeros(BUCKETS, np.float32)
    buckets, _ = ngrams(words)
    return (np.bincount(buckets, minlength=BUCKETS) / len(buckets)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM (y = 1 or -1) by accelerated gradient steps; both classes weigh the same, the bias is not shrunk."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    y = y.astype(x.dtype)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(10):  # largest curvature
        v = x.T @ (weight * (x @ v))
        v /= max(np.linalg.norm(v), 1e-12)
    size = 1 / (2 * float(v @ (x.T @ (weight * (x @ v)))) + 2 + ridge)
    w = z = np.zeros(x.shape[1], x.dtype)
    b = c = 0.0
    for k in range(steps):
        pull = 2 * weight * y * np.maximum(0, 1 - y * (x @ z + c))
        new, new_b = z - size * (ridge * z - x.T @ pull), c + size * float(pull.sum())
        momentum = k / (k + 3)
        z, c, w, b = new + momentum * (new - w), new_b + momentum * (new_b - b), new, new_b
    return w.astype(np.float64), b


@dataclass
class LanguageModel:
    """Linear functions of mean n-gram counts: columns of ``weights`` and ``bias``, first a family each, then a pair of languages each."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray
    bias: np.ndarray
    _at: dict = field(default_factory=dict)

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score for each row: the family with the largest margin, then the most pairwise wins (ties: larger sum of margins)."""
        chance = 1 / (1 + np.exp(-np.clip(3 * margins, -60, 60)))
        n = len(self.families)
        family = margins[:, :n].argmax(axis=1) if n else np.zeros(len(margins), int)
        total = chance[:, :n].sum(axis=1)
        sure = chance[np.arange(len(margins)), family] / np.maximum(total, 1e-12)
        languages, scores = [""] * len(margins), np.zeros(len(margins))
        for f, name in enumerate(self.families):
            at = np.flatnonzero(family == f)
            own = self.members[name]
            votes = np.zeros((len(at), len(own)))
            worst = np.ones((len(at), len(own)))
            for k, (of, a, b) in enumerate(self.pairs):
                if of == name:
                    i, j, m, c = own.index(a), own.index(b), margins[at, n + k], chance[at, n + k]
                    votes[:, i] += (m > 0) + 1e-3 * np.tanh(m)
                    votes[:, j] += (m <= 0) - 1e-3 * np.tanh(m)
                    worst[:, i] = np.minimum(worst[:, i], c)
                    worst[:, j] = np.minimum(worst[:, j], 1 - c)
            best = votes.argmax(axis=1)
            for row, k in zip(at.tolist(), best.tolist(), strict=True):
                languages[row] = own[k]
            scores[at] = sure[at] * worst[np.arange(len(at)), best]
        return languages, scores


def fit_languages(x: np.ndarray, languages: list[str]) -> LanguageModel:
    lang = np.array(languages)
    family = np.array([family_of(a) for a in languages])
    families = sorted(set(family))
    members = {f: sorted(set(lang[family == f])) for f in families}
    mean, scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64)
    scale = np.where(scale > 0, 1 / np.maximum(scale, 1e-4), 0) / np.sqrt(BUCKETS)
    z = ((x - mean) * scale).astype(np.float32)
    columns, bias = [], []

    def add(rows: np.ndarray, y: np.ndarray) -> None:
        w, b = linear_svm(z[rows], y) if len(set(y)) > 1 else (np.zeros(x.shape[1]), 1.0)
        columns.append(w * scale)
        bias.append(b - float((w * scale) @ mean))

    everything = np.arange(len(lang))
    for f in families:
        add(everything, np.where(family == f, 1.0, -1.0))
    pairs = [(f, a, b) for f in families for a, b in combinations(members[f], 2)]
    for _, a, b in pairs:
        rows = np.flatnonzero((lang == a) | (lang == b))
        add(rows, np.where(lang[rows] == a, 1.0, -1.0))
    return LanguageModel(families, members, pairs, np.array(columns).T, np.array(bias))


@scratched
def train(docs: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_MOST, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """The model from a hash sample of at most ``rows`` documents of each language that are not held out, and of at most ``most`` in all; None without any.

    The hash is of id and text and equal rows count once, so neither repeated ids nor repeated rows change how many are
    taken. Approximate counts of different rows set each language's sampling rate: with many languages each gives its
    equal part of ``most``, one row at least while ``most`` lasts. The sample's n-gram counts come to the driver
    (buckets that are not empty, 6 bytes each).
    """
    own = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), col(lang_col).alias("lang"))
    own = own.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    own = own.withColumn("__key", F.xxhash64(F.lit(seed), "doc_id", "text"))
    counts = materialize(own.groupBy(F.col("lang").alias("__l")).agg(F.approx_count_distinct("__key").alias("n"), F.min("__key").alias("least")), "language-counts")
    each = max(1, min(rows, most // max(1, counts.count())))
    rate = counts.select("__l", "least", (F.lit(SPARE * each) / F.col("n")).alias("rate"))
    draw = F.pmod("__key", F.lit(1 << 30)) / (1 << 30)
    sample = attach(own, rate, [("lang", "__l")], "inner").where((draw < F.col("rate")) | (F.col("__key") == F.col("least")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column("text")]
            at = [np.flatnonzero(v).astype("<u2") for v in x]
            columns = [pa.array([k.tobytes() for k in at], pa.binary()), pa.array([v[k].tobytes() for v, k in zip(x, at, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("__key"), b.column("lang"), *columns], ["__key", "lang", "at", "x"])

    found = map_arrow(sample.select("__key", "lang", "text"), run, "__key long, lang string, at binary, x binary").where(F.octet_length("at") > 0)
    different = materialize(found.groupBy("lang", "__key").agg(F.min(F.struct("at", "x")).alias("v")), "language-sample")
    # a language has about SPARE * each different rows here
    first = different.withColumn("__turn", F.row_number().over(Window.partitionBy("lang").orderBy("__key"))).where(F.col("__turn") <= each)
    got = sorted((r["lang"], r["v"]["at"], r["v"]["x"]) for r in first.orderBy("__turn", "__key").limit(most).collect())
    if not got:
        return None
    x = np.zeros((len(got), BUCKETS), np.float32)
    for k, (_, at, value) in enumerate(got):
        x[k, np.frombuffer(at, "<u2")] = np.frombuffer(value, np.float32)
    return fit_languages(x, [r[0] for r in got])


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for each row, from the whole text alone.

    A worker scores a different word once: the model is linear in n-grams, so a text's margins are sums over its words.
    """
    rows = docs.select(col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"), col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place: dict[str, int] = {}
        table = np.zeros((0, 0))
        for b in batches:
            texts = [words_of(x.as_py()) for x in b.column("text")]
            languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if model is not None:
                if len(place) > CACHE or not len(table):
                    place, table = {}, np.zeros((0, model.weights.shape[1] + 1))
                new = list(set().union(*texts).difference(place))
                if new:
                    added = np.zeros((len(new), table.shape[1]))
                    for lo in range(0, len(new), 20_000):
                        part = new[lo : lo + 20_000]
                        buckets, owner = ngrams(part)
                        for k in range(model.weights.shape[1]):
                            added[lo : lo + len(part), k] = np.bincount(owner, model.weights[buckets, k], len(part))
                        added[lo : lo + len(part), -1] = np.bincount(owner, minlength=len(part))
                    place.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                    table = np.concatenate([table, added])
                lettered = [k for k, words in enumerate(texts) if words]
                sums = np.array([table[list(map(place.__getitem__, texts[k]))].sum(axis=0) for k in lettered]).reshape(len(lettered), table.shape[1])
                found, sure = model.decide(sums[:, :-1] / np.maximum(sums[:, -1:], 1) + model.bias)
                for k, name in zip(lettered, found, strict=True):
                    languages[k] = name
                scores[lettered] = sure
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(languages, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the documents that are not held out and predicts all of them (see ``predict``).

    Nulls: a null text, or one without letters, is ``und`` with score 0; a null id is never held out and never learned
    from; a null language is not learned from. Without anything to learn from all is ``und``. Equal rows are predicted
    alike. No documents: no rows.
    """
    return predict(docs, train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col, text_col)
