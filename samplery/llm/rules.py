"""Quality rules: per-document rule statistics, and an isolation forest over them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samplery.llm.common import SPACE, attach, col, materialize, scratched
from samplery.shipping import map_arrow

#: Trees, and the levels at which each of them splits all documents. They bound the model, not what it is fitted on. Of
#: the heights 3 to 8, this one did well on held-out labels at all sizes (README); higher trees resolve groups of odd documents.
TREES, HEIGHT = 100, 4
#: Documents a tree of ``tree_samples``; scores count paths against the expected one among so many.
TREE_SAMPLE = 256
#: Share of good labelled documents that the threshold must keep.
KEEP_GOOD = 0.995
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest sees: how words look. Logarithms of rates, so that they judge alike at any length; the text counts as
#: if ``PRIOR`` plain words came before it, which keeps very short texts from looking odd by chance. Repetition is left
#: to the fixed rules: most good texts repeat nothing, so that any repetition is soon isolated, and neither in this
#: forest nor in one of its own did its rates catch a further poor text of held-out labels.
FEATURES = ("chars_a_word", "symbols_a_word", "upper_share", "mark_share")
#: Words, characters in them, and punctuation marks of the plain text before each text.
PRIOR = (50, 250, 8)


def repeated_words(ids: np.ndarray, window: int = 5) -> int:
    """Words that lie in a window of ``window`` words which occurs at least twice, its first place included."""
    n = len(ids)
    if n <= window:
        return 0
    rank = ids.astype(np.int64)
    key = rank[: n - window + 1]
    top = int(rank.max()) + 1
    for k in range(1, window):
        if (int(key.max()) + 1) * top >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * top + rank[k : n - window + 1 + k]
    order = np.argsort(key, kind="stable")
    run = key[order]
    same = run[1:] == run[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


_KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?.,;:"), 1):
    _KIND[list(_chars)] = _k


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """``BASE`` counts and ``FEATURES`` of a whole text."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()  # bytes.split() cuts at ASCII white space only
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n = len(words)
    _, spaces, symbols, upper, marks = (int(x) for x in np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=5))
    chars = len(text) - spaces
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            repeated += line in seen
            seen.add(line)
    again = repeated_words(ids)
    words_, chars_, marks_ = n + PRIOR[0], chars + PRIOR[1], marks + PRIOR[2]
    rates = np.array([chars_ / words_, symbols / words_, upper / chars_, marks_ / words_])
    return [n, chars, symbols, repeated, again], np.log(rates + 0.02).tolist()


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the ``BASE`` counts and ``features`` (array of double) of every whole text, one row per row of ``docs``."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [statistics(x.as_py()) for x in b.column("text")]
            counts = np.array([x[0] for x in both], np.int64).reshape(-1, len(BASE))
            features = pa.array([x[1] for x in both], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(counts[:, k]) for k in range(len(BASE))], features], ["doc_id", *BASE, "features"])

    counts = ", ".join(f"{c} long" for c in BASE)
    return map_arrow(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, {counts}, features array<double>")


def tree_samples(passing: DataFrame, trees: int = TREES, sample: int = TREE_SAMPLE, seed: int = 3) -> list[np.ndarray]:
    """Features of each tree's own ``sample`` rows, drawn without replacement from a pool: the ``trees`` x ``sample`` first of all rows by a hash.

    For forests of samples (``grow_forest``); ``fit_rules`` grows its forest on all rows instead.

    Only rows whose hash is below a bound are gathered, equal ones counted; it rises until the pool is full or holds all
    rows. The hash's order is random, so a full pool is dealt out and no row is in two trees; of fewer rows each tree
    draws for itself.
    """
    total, want = passing.count(), trees * sample
    share = 1.2 * want / max(total, 1)
    ties = [F.col("doc_id").cast("string"), *[F.col(c) for c in BASE], F.col("features")]
    rank = F.xxhash64(F.lit(seed), "doc_id", *BASE)
    while total:
        bound = min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))
        each = passing.where(rank <= F.lit(bound)).groupBy(rank.alias("rank"), *[c.alias(f"t{k}") for k, c in enumerate(ties)]).agg(F.count(F.lit(1)).alias("n"))
        held = sorted((r[0], r[1] or "", *r[2:]) for r in each.collect())
        if share >= 1 or sum(r[-1] for r in held) >= want:
            pool = np.array([r[-2] for r in held for _ in range(min(r[-1], want))][:want])
            if len(pool) == want:
                return [pool[k::trees] for k in range(trees)]
            rng = np.random.default_rng(seed)
            return [pool[np.sort(rng.choice(len(pool), min(sample, len(pool)), replace=False))] for _ in range(trees)]
        share *= 4
    return []


def grow_forest(samples: list[np.ndarray], seed: int = 3) -> list[dict[str, np.ndarray]]:
    """An isolation tree of each sample, as arrays: each inner node splits a random feature at a random value between its least and largest."""
    rng = np.random.default_rng(seed)
    forest = []
    for own in samples:
        depth = max(1, int(np.ceil(np.log2(max(2, len(own))))))
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int, nodes: list = nodes, depth: int = depth) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, at, at, level + expected_path(len(rows))])
            spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 and level < depth else []
            if len(spread):
                f = int(rng.choice(spread))
                cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
                left = rows[:, f] <= cut
                nodes[at][:2] = [f, cut]
                nodes[at][2] = grow(rows[left], level + 1)
                nodes[at][3] = grow(rows[~left], level + 1)
            return at

        grow(own, 0)
        table = np.array(nodes)
        forest.append({"feature": table[:, 0].astype(int), "cut": table[:, 1], "left": table[:, 2].astype(int), "right": table[:, 3].astype(int), "path": table[:, 4]})
    return forest


def _reached(passing: DataFrame, feature: np.ndarray, cut: np.ndarray, level: int) -> DataFrame:
    """``tree``, ``node``, ``n``, ``low``, ``high``: how many of all rows reach each node of a level, and their least and largest features. Node k has the children 2k + 1 and 2k + 2."""
    trees, first, width = len(feature), (1 << level) - 1, 1 << level
    feature, cut = feature[:, :first], cut[:, :first]
    names = [f"{side}{k}" for side in ("low", "high") for k in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((trees, width), np.int64)
        low, high = (np.full((len(FEATURES), trees, width), end) for end in (np.inf, -np.inf))
        for b in batches:
            x = b.column("features").flatten().to_numpy().reshape(len(b), len(FEATURES))
            for t in range(trees):
                rows, at = np.arange(len(x)), np.zeros(len(x), int)
                for _ in range(level):
                    f = feature[t][at]
                    inner = f >= 0
                    rows, at, f = rows[inner], at[inner], f[inner]
                    at = 2 * at + 1 + (x[rows, f] > cut[t][at])
                n[t] += np.bincount(at - first, minlength=width)
                for k in range(len(FEATURES)):
                    np.minimum.at(low[k, t], at - first, x[rows, k])
                    np.maximum.at(high[k, t], at - first, x[rows, k])
        t, at = np.nonzero(n)
        ends = [pa.array(side[k, t, at]) for side in (low, high) for k in range(len(FEATURES))]
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(at + first), pa.array(n[t, at]), *ends], ["tree", "node", "n", *names])

    parts = map_arrow(passing.select("features"), run, f"tree long, node long, n long, {', '.join(f'{c} double' for c in names)}")
    low, high = (F.array(*[end(f"{side}{k}") for k in range(len(FEATURES))]).alias(side) for side, end in (("low", F.min), ("high", F.max)))
    return parts.groupBy("tree", "node").agg(F.sum("n").alias("n"), low, high)


def grow_on_all(passing: DataFrame, trees: int = TREES, height: int = HEIGHT, seed: int = 3) -> list[dict[str, np.ndarray]]:
    """Isolation trees of all rows, in the form of ``grow_forest``; none without rows.

    They grow one level a pass over the rows: each inner node splits a random feature at a random value between the
    least and largest of all rows that reach it, and paths that end at ``height`` count the rows left there. Only nodes
    come to the driver, fewer than 2 ** (``height`` + 1) a tree; the draws depend on seed, tree and node alone.
    """
    size = (2 << height) - 1
    feature, cut, count = np.full((trees, size), -1, np.int8), np.zeros((trees, size)), np.zeros((trees, size), np.int64)
    for level in range(height + 1):
        more = False
        for t, at, n, low, high in _reached(passing, feature, cut, level).collect():
            count[t, at] = n
            spread = [k for k in range(len(FEATURES)) if low[k] < high[k]]
            if spread and level < height:
                rng = np.random.default_rng((seed, t, at))
                k = spread[int(rng.integers(len(spread)))]
                feature[t, at], cut[t, at] = k, min(rng.uniform(low[k], high[k]), np.nextafter(high[k], low[k]))
                more = True
        if not more:
            break
    forest = []
    for f, c, n in zip(feature.astype(int), cut, count, strict=True):
        at = np.flatnonzero(n)
        place, inner, own = np.cumsum(n > 0) - 1, f[at] >= 0, np.arange(len(at))
        left, right = (np.where(inner, place[np.minimum(2 * at + k, size - 1)], own) for k in (1, 2))
        path = np.array([int(k + 1).bit_length() - 1 + expected_path(int(n[k])) for k in at])
        forest.append({"feature": f[at], "cut": c[at], "left": left, "right": right, "path": path})
    return forest if count[:, 0].any() else []


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n values."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def anomaly(forest: list[dict[str, np.ndarray]], x: np.ndarray, sample: int = TREE_SAMPLE) -> np.ndarray:
    """2 ** (- mean path / expected path): near 1 for rows that few random splits isolate."""
    total = np.zeros(len(x))
    lanes = np.arange(len(x))
    for tree in forest:
        at = np.zeros(len(x), int)
        while True:
            f = tree["feature"][at]
            inner = f >= 0
            if not inner.any():
                break
            low = x[lanes, np.maximum(f, 0)] <= tree["cut"][at]
            at = np.where(inner, np.where(low, tree["left"][at], tree["right"][at]), at)
        total += tree["path"][at]
    return 2.0 ** (-total / max(1, len(forest)) / max(expected_path(sample), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray, keep: float = KEEP_GOOD) -> float:
    """The score above which rows go: it best separates good from bad rows among those that keep ``keep`` of the good ones."""
    if not good.any():
        return float("inf")
    least = float(np.quantile(scores[good], keep, method="higher"))
    if good.all():
        return float(scores.max())
    cuts = np.unique(scores[scores >= least])
    order_good, order_bad = np.sort(scores[good]), np.sort(scores[~good])
    kept = np.searchsorted(order_good, cuts, "right") / len(order_good)
    caught = 1 - np.searchsorted(order_bad, cuts, "right") / len(order_bad)
    return float(cuts[np.argmax(kept + caught)])


def threshold(graded: DataFrame, keep: float = KEEP_GOOD) -> float:
    """``calibrate`` of all rows of ``graded`` (``anomaly``, ``good``): equal scores are counted, and ranges of scores ahead, so that no task holds all of them."""
    each = materialize(graded.groupBy("anomaly").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")), "rule-scores")
    n_good, n_bad, most = each.agg(F.sum("good"), F.sum("bad"), F.max("anomaly")).first()
    if not n_good:
        return float("inf")
    if not n_bad:
        return most
    ranged = materialize(each.repartitionByRange("anomaly").withColumn("part", F.spark_partition_id()), "rule-score-ranges")
    ahead = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = ranged.groupBy(F.col("part").alias("p")).agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    offsets = offsets.select("p", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("g", "b")])
    up_to = Window.partitionBy("part").orderBy("anomaly").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ranged.select("anomaly", "part", *[F.sum(c).over(up_to).alias(c) for c in ("good", "bad")]).join(F.broadcast(offsets), F.col("part") == F.col("p"))
    good, bad = F.col("good") + F.col("g"), F.col("bad") + F.col("b")
    gain = good / F.lit(float(n_good)) + (1 - bad / F.lit(float(n_bad)))
    best = counted.where(good > math.ceil(keep * (n_good - 1))).agg(F.max(F.struct(gain.alias("gain"), (-F.col("anomaly")).alias("least")))).first()[0]
    return -best["least"]


@scratched
def fit_rules(stats: DataFrame, labels: DataFrame, seed: int = 3, keep: float = KEEP_GOOD) -> tuple[list[dict[str, np.ndarray]], float] | None:
    """The forest and its threshold; None without documents that pass the fixed rules.

    Trees grow on all documents, labelled or not, that pass the fixed rules; labels (``doc_id``, ``quality`` 0/1) only set
    the threshold, all of those documents that have one (of several the worst counts).
    """
    passing = stats.where(~base_failed())
    forest = grow_on_all(passing, seed=seed)
    if not forest:
        return None
    graded = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((F.min("quality") > 0).alias("good"))
    rows = attach(passing.select("doc_id", "features"), materialize(graded, "rule-labels"), [("doc_id", "id")], "inner")
    return forest, threshold(_scored(rows.select("features", "good"), forest), keep)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _scored(rows: DataFrame, forest: list[dict[str, np.ndarray]]) -> DataFrame:
    """``rows`` with ``anomaly`` (0 without a forest) in place of ``features``."""
    rest = [c for c in rows.columns if c != "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("features").flatten().to_numpy().reshape(len(b), len(FEATURES))
            scores = anomaly(forest, x) if forest and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(scores)], [*rest, "anomaly"])

    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in rest)
    return map_arrow(rows, run, f"{kinds}, anomaly double")


def judge(stats: DataFrame, fitted: tuple[list[dict[str, np.ndarray]], float] | None) -> DataFrame:
    """``stats`` with ``base_failed``, ``anomaly`` (0 to 1) and ``kept``."""
    scored = _scored(stats, fitted[0] if fitted else []).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed")
    return scored.withColumn("kept", kept & (F.col("anomaly") <= fitted[1]) if fitted else kept)


@scratched
def quality_rules(docs: DataFrame, labels: DataFrame, keep: float = KEEP_GOOD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the ``BASE`` counts, ``base_failed``, ``anomaly`` and ``kept``.

    A document goes if it fails the fixed rules, or if the isolation forest over ``FEATURES`` isolates it sooner than
    the threshold that all labelled documents calibrate, which keeps at least ``keep`` of the good ones. Nulls: a null or empty text has no words and fails; a null id is judged like any other, but no label reaches
    it. Without labels only the fixed rules decide. Equal rows get equal verdicts. No documents: no rows. Other columns
    of ``docs`` don't matter.
    """
    stats = materialize(rule_statistics(docs, id_col, text_col), "rule-statistics", keep=True)
    return judge(stats, fit_rules(stats, labels, keep=keep))
