"""Personal data, vector codes and the prefix trie against brute force; samples of fits stay bounded."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplery.llm import langid, ordinal, pii, prefix_trie, rules, vector_codes, warc

# --- personal data


def plain_base(text):
    """The contract's own patterns, as they are written."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def spans(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.find(rows).select("doc_id", pii.listed(pii.of_kinds(F.col("__pii"), "email", "ip", "card", "phone")).alias("base"), pii.listed(F.col("__pii")).alias("all"), "__pii").collect()}


def test_base_spans_are_the_contract_s(spark):
    rng = random.Random(3)
    bits = ["a.b@c.de", "._x@d.ee", "@", "x@y", "1.2.3.4", "300.1.1.1", "0255.0.0.01", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-567", "+1", " ", "é😀", "\n", "5", ".", "-", "a", "_", "%", "ab@cd.ef-", "+12345678901234567", "0000000000000"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(400)] + ["", None]
    got = spans(spark, texts)
    for k, t in enumerate(texts):
        assert got[k]["base"] == ",".join(plain_base(t or "")), t


@pytest.mark.parametrize("text,found", [
    ("IBAN DE89 3704 0044 0532 0130 00 OK", ["DE89 3704 0044 0532 0130 00"]), ("GB82WEST12345698765432", ["GB82WEST12345698765432"]), ("DE89370400440532013001", []), ("xDE89370400440532013000", []),
    ("DE89370400440532013000a", []), ("ZZ89 3704 0044 0532 0130 00", []), ("DE89370400440532013000 DE", ["DE89370400440532013000"]),
    ("call 415-555-1234 now", ["415-555-1234"]), ("see 415-555-1234 now", []), ("tel (415) 555-1234", ["(415) 555-1234"]), ("recall 415-555-1234", []), ("tel 1415-555-12345", []), ("order tel 415 555 1234", []),
    ("SSN: 123-45-6789", ["123-45-6789"]), ("123-45-6789", []), ("ssn 000-45-6789", []), ("ssn 123-45-6789-1", []), ("ssn 123-45-0000", []),
])
def test_checksums_and_context_add_spans(spark, text, found):
    assert [s["value"] for s in spans(spark, [text])[0]["__pii"] if s["kind"] not in ("email", "ip", "card", "phone")] == found


def test_scores_redaction_and_odd_tables(spark):
    rows = spark.createDataFrame([(1, "mail a@b.cc or 10.0.0.1 and after much else version 1.2.3.4", "x"), (1, "mail a@b.cc or 10.0.0.1 and after much else version 1.2.3.4", "x"), (None, None, None)], "doc_id long, text string, `__0_t` string")
    got = pii.find(rows).orderBy("doc_id").collect()
    assert len(got) == 3 and got[0]["__pii"] == [] and got[1] == got[2] and got[1]["__0_t"] == "x"
    assert [(s["kind"], s["score"]) for s in got[1]["__pii"]] == [("email", 100), ("ip", 60), ("ip", 30)]
    assert [r["text"] for r in pii.redact(rows).orderBy("doc_id").collect()] == [None] + ["mail <EMAIL> or <IP> and after much else version <IP>"] * 2
    assert pii.find(rows.where("doc_id > 9")).count() == 0
    plan = pii.find(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a@", "A1", "+1((", "a@b.cc ", "1 "])
def test_long_runs_are_linear(spark, unit):
    text = unit * (200_000 // len(unit))
    want = plain_base(text) if unit in ("1.", "a@b.cc ") else None
    got = spans(spark, [text])[0]["base"]
    assert want is None or got == ",".join(want)


# --- vector codes


def test_trees_find_what_all_pairs_find():
    rng = np.random.default_rng(1)
    for n, size, spread in ((64, 4, 3), (64, 4, 200), (200, 2, 5), (1, 3, 9), (9, 1, 2), (40, 4, 1)):
        entries, points = rng.integers(-spread, spread, (n, size)), rng.integers(-spread - 2, spread + 2, (500, size))
        d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        found, best = vector_codes.nearest(vector_codes.kd_tree(entries), entries, points)
        assert (found == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(id, vector) rows of one length: codes, errors and all entries."""
    rows = sorted(rows)
    x = np.floor(np.array([v for _, v in rows]) * 256).astype(int).reshape(len(rows), parts, -1)
    book = x[:entries].copy()
    for turn in range(rounds + 1):
        d = ((x[:, None] - book[None]) ** 2).sum(axis=3)
        code = d.argmin(axis=1)
        if turn < rounds:
            for p, e in itertools.product(range(parts), range(len(book))):
                own = x[code[:, p] == e, p]
                if len(own):
                    book[e, p] = own.sum(axis=0) // len(own)
    sha = hashlib.sha256(",".join(map(str, book.transpose(1, 0, 2).ravel().tolist())).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for k in c), int(e)) for (i, _), c, e in zip(rows, code, d.min(axis=1).sum(axis=1), strict=True)}, sha


def test_codes_against_plain_rounds(spark):
    rng = np.random.default_rng(2)
    own = [(k, [float(v) for v in np.round(rng.normal(0, 0.02, 32), 2)]) for k in range(150)]  # coarse, so that distances tie
    bad = [(900, None), (901, [1.0] * 31 + [None]), (902, [float("nan")] + [1.0] * 31), (903, [float("inf")] * 32)]
    table = spark.createDataFrame([(k, v, None if k % 5 == 0 else k % 3, "x") for k, v in own + bad], "vec_id long, embedding array<double>, label int, `__code` string").drop("__code")
    want, sha = plain_codes(own)
    got = {r["vec_id"]: r for r in vector_codes.compress(table.repartition(5)).collect()}
    assert {k: (r["__code"], r["__error"]) for k, r in got.items()} == want and {r["__codebooks"] for r in got.values()} == {sha}
    for r in got.values():
        assert r["__label_error"] == sum(x["__error"] for x in got.values() if x["label"] == r["label"])


def test_codes_of_odd_tables(spark):
    rows = spark.createDataFrame([(2, [0.5] * 3, 1), (1, [], None), (None, [1e30, -0.001], 1), (2, [0.5] * 3, 1)], "vec_id long, embedding array<double>, label int")
    books = vector_codes.fit(rows)
    assert books.entries.shape == (16, 4, 1) and books.entries[0, :, 0].tolist() == [0, 128, 128, vector_codes.LARGEST] and books.entries[1, 3, 0] == -1
    got = vector_codes.compress(rows).collect()
    assert len(got) == 4 and all(r["__error"] == 0 for r in got)
    code = next(r["__code"] for r in got if r["vec_id"] is None)
    assert (books.decode(np.array([[int(code[2 * k : 2 * k + 2], 16) for k in range(16)]]))[0, :2] == [vector_codes.LARGEST, -1]).all()
    assert vector_codes.compress(rows.where("vec_id > 5")).count() == 0
    assert vector_codes.compress(rows.where("vec_id = 1")).first()["__code"] == "00" * 16


# --- prefix trie


def plain_trie(rows):
    """Every prefix as a node, straight from the definition."""
    own = {}
    for c, turn, role, text in rows:
        own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    out = set()
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        children = sum(len(q) == len(p) + 1 for q in under)
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children, sum(map(leaf, under)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("ranges", ["1", "4", "37"])
def test_trie_against_all_prefixes(spark, ranges):
    """Few different turns, so that prefixes are shared across ranges of any size; equal conversations; nulls; no own turns left."""
    rng = random.Random(5)
    rows = []
    for c in [*range(120), 503, 701]:
        turns = rng.randrange(1, 12)
        same = c % 4 == 1
        rows += [(c, None if k == 0 and c % 7 == 0 else k, None if rng.random() < 0.1 else "user", ("ü" * (k % 3) if same else None if rng.random() < 0.1 else rng.choice(["hi", "", "é", "yes"]))) for k in range(turns)]
    turns = spark.createDataFrame([(*r, "x") for r in rows] + [(None, 0, "user", "lost", "x")], "conv_id long, turn long, role string, text string, codes string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = prefix_trie.prefix_trie(turns, change=prefix_trie.rebuilt)
        assert {tuple(r[c] for c in NODE) for r in got.collect()} == plain_trie(rows) and got.count() == len(plain_trie(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_trie_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    equal = spark.createDataFrame([(k, 0, "user", "one") for k in range(300)] + [(7, 0, "user", "one")], schema)  # 7 says it twice
    got = {(r["depth"], r["conv_id"]): r for r in prefix_trie.prefix_trie(equal).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 7)} and got[0, 0]["saved_tokens"] == got[1, 0]["saved_tokens"] == 3 * 299 and got[1, 0]["n_leaves"] == 1
    assert got[1, 0]["ends_sha256"] == hashlib.sha256(",".join(str(k) for k in range(300) if k != 7).encode()).hexdigest()
    long = [f"{k}" for k in range(3000)]
    deep = spark.createDataFrame([(c, k, "user", t) for c in (1, 2) for k, t in enumerate(long)], schema)
    rows = prefix_trie.prefix_trie(deep).collect()
    assert len(rows) == 3001 and {r["n_convs"] for r in rows} == {2} and max(r["saved_tokens"] for r in rows) == sum(map(len, long))


# --- fits gather no more than they say


def test_quality_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.range(2, 30).select(F.col("id").alias("doc_id"), F.lit("other text here").alias("text")))
    labels = spark.range(1, 30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    seen = []
    own = ordinal.fit_ordinal
    try:
        ordinal.fit_ordinal = lambda rows, *a, **k: seen.append(len(rows)) or own(rows, *a, **k)
        assert ordinal.train(docs, labels, rows=20) is not None
        assert ordinal.train(docs.where("doc_id > 1").unionByName(docs.where("doc_id > 1")), labels.where("quality = 1"), rows=20) is not None
    finally:
        ordinal.fit_ordinal = own
    assert seen[0] == 20 and seen[1] <= 14
    one = ordinal.classify(docs.where("doc_id > 1"), labels.where("quality = 1"))
    assert one.where("not __kept").count() == 0  # a single grade: nothing to reject


def test_every_language_is_learned(spark):
    """Rows that share an id, or are equal, neither crowd out nor lose a language, and held-out rows teach nothing."""
    free = [k for k in range(60) if zlib.crc32(str(k).encode()) % 4 != 2]
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 4 == 2]
    rows = [(free[0], f"das ist ein wort nummer {k} und noch mehr", "de") for k in range(3000)]
    rows += [(free[1], "always the same english words over there", "en")] * 2000 + [(k, f"the words and the things are many {k}", "en") for k in free[2:20]]
    rows += [(free[20], "los dias son largos y hay muchas cosas", "es")] + [(k, "zzz qqq xxx", "xx") for k in held]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    own = langid.fit_languages
    try:
        langid.fit_languages = lambda x, languages: seen.append(languages) or own(x, languages)
        model = langid.train(docs, rows=100, most=250)
    finally:
        langid.fit_languages = own
    count = {a: seen[0].count(a) for a in set(seen[0])}
    assert set(count) == {"de", "en", "es"} and count["de"] == 83 and 2 <= count["en"] <= 19 and count["es"] == 1
    # the sums over words are the plain linear model
    texts = [r[1] for r in rows[::400]] + ["Ein Test, the Test!", "²³ 12"]
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    margins = np.array([langid.features(t).astype(float) @ model.weights + model.bias for t in texts])
    languages, scores = model.decide(margins)
    got = {r["doc_id"]: r for r in langid.predict(some, model).collect()}
    for k, t in enumerate(texts):
        want = (languages[k], scores[k]) if langid.words_of(t) else ("und", 0.0)
        assert got[k]["lang_pred"] == want[0] and got[k]["score"] == pytest.approx(want[1], abs=1e-5)


def test_rules_verdict_is_that_of_plain_paths(spark):
    """``kept`` end to end: the fixed rules, then the forest's score by walking its trees one by one."""

    def path(tree, x):
        at = 0
        while tree["feature"][at] >= 0:
            at = tree["left"][at] if x[tree["feature"][at]] <= tree["cut"][at] else tree["right"][at]
        return tree["path"][at]

    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "###", "omega,", "line\nline", "x1"]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60)))) for k in range(300)] + [(300, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    stats = rules.rule_statistics(docs)
    forest, cut = rules.fit_rules(stats, labels)
    got = {r["doc_id"]: r for r in rules.judge(stats, (forest, cut)).collect()}
    assert len(got) == 301 and not got[300]["kept"]
    for r in stats.collect():
        x = np.array(r["features"])
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        score = 2 ** (-np.mean([path(t, x) for t in forest]) / rules.expected_path(rules.TREE_SAMPLE))
        assert got[r["doc_id"]]["anomaly"] == pytest.approx(score)
        assert got[r["doc_id"]]["base_failed"] == failed
        assert got[r["doc_id"]]["kept"] == (not failed and got[r["doc_id"]]["anomaly"] <= cut)


def test_archives_keep_urls_as_they_are(spark):
    (headers, block), = warc.records(iter([b"WARC/1.0\r\nWARC-Target-URI:  http://a/b c \r\nContent-Length: 2", b"ok"]))
    assert headers["warc-target-uri"] == " http://a/b c " and block == b"ok"
    pages = spark.createDataFrame([(1, " http://a.b/c d ", "x"), (2, "http://a.b/", None)], "page_id long, url string, html string")
    assert {r["url"] for r in warc.archive_round_trip(pages).collect()} == {" http://a.b/c d ", "http://a.b/"}
