"""Contracts of the corpus operators that small tables rarely meet: rows repeated at a cut, odd column names, windows and slices, fitted models against plain arithmetic, scratch tables, and the pipeline against brute force."""

import hashlib
import os
import random
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_corpus_ops import brute_components, needs_model, plain_fingerprint, size_of, water_fill, words

from samplery.llm import common, embed_dedup, langid, line_dedup, mixing, ordinal, pieces, rules, sharding, simhash, warc

ODD = ["__size", "__h", "__draw", "__bad", "__kept", "__0_x", "a.b", "we`ird", "piece_ids", "Tie"]


def with_odd_columns(df):
    return df.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in ODD])


def odd_intact(df, but=()):
    own = df.select("doc_id", *[common.col(c).alias(f"o{k}") for k, c in enumerate(ODD)])
    return all(r[f"o{k}"] == f"{c} {'-' if r['doc_id'] is None else r['doc_id']}" for r in own.collect() for k, c in enumerate(ODD) if c not in but)


# --- scratch tables


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_dir", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(k, words(random.Random(k % 9), 12)) for k in range(30)], "doc_id long, text string")
    with common.scratch():
        assert simhash.without_near_duplicates(docs).count() == 9
        assert 0 < len(os.listdir(tmp_path)) <= 3  # what the result reads
    assert os.listdir(tmp_path) == []
    kept = simhash.near_duplicates(docs)
    assert kept.count() == 30 and {x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)} == {"fingerprints", "fingerprint-components"}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    for master, ok in (("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False)):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        if ok:
            assert os.path.isdir(common.scratch_dir(session))
        else:
            with pytest.raises(ValueError, match="checkpoint"):
                common.scratch_dir(session)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: "hdfs://x/y"))
    assert common.scratch_dir(named) == "hdfs://x/y"


# --- mixing


def brute_mix(rows, seed=7):
    """(id, text, source) -> how often each row is taken, as a sorted list."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size_of(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out = []
    for s in order:
        whole = min(2, int(target[s] // sizes[s])) if sizes[s] else 0
        rest, before = target[s] - whole * sizes[s], 0
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: (int(md5(f"{seed}:{'' if r[0] is None else r[0]}:{md5(r[1] or '')}")[:15], 16), size_of(r[1]))):
            out.append((str(r[0]), r[1] or "", str(s), whole + (rest > 0 and 2 * before + size_of(r[1]) <= 2 * rest)))
            before += size_of(r[1])
    return sorted(out)


def test_equal_rows_at_the_cut_are_split(spark):
    rng = random.Random(11)
    rows = [(7, "seven words stand in this one row", "a")] * 290 + [(None, "five words and no id", "b")] * 200 + [(k, words(rng, 9), "b") for k in range(30)] + [(k, words(rng, 5), rng.choice("cd")) for k in range(100)] + [(5, None, "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = brute_mix(rows)
    for df in (docs, docs.repartition(5)):
        mixed = mixing.mix(with_odd_columns(df))
        got = mixed.select("doc_id", "text", "source", "__copies", "__size", "__target").collect()
        assert sorted((str(r["doc_id"]), r["text"] or "", str(r["source"]), r["__copies"]) for r in got) == want
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["__copies"] * r["__size"] for r in own) - own[0]["__target"]) <= 9
    assert odd_intact(mixed, but=("__size",))
    taken = mixing.mixed_documents(with_odd_columns(docs))
    assert taken.columns == [*docs.columns, *ODD] and odd_intact(taken)
    assert taken.count() == sum(w[3] for w in want)


def test_many_sources_fill_like_few(spark):
    rng = random.Random(12)
    rows = [(k, words(rng, rng.choice([1, 5, 40])), f"host{int(rng.paretovariate(0.6)) % 97}") for k in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["source"], r["__copies"]) for r in got) == brute_mix(rows)


# --- lines


def test_small_hosts_and_large_lists(spark, monkeypatch):
    rows = [(1, "same\nown 1", "three"), (2, "same\nown 2", "three"), (3, "other\nown 3", "three"), (4, "alone\nline", "one"), (5, "alone\nline", "one"), (6, "x\ny", None), (7, "x\nz", None), (8, None, "one"), (None, "same", "three")]
    rows += [(100 + k, f"menu\nline {k}\n" * 2, "big") for k in range(40)]
    docs = with_odd_columns(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    want = {1: "own 1", 2: "own 2", 3: "other\nown 3", 4: "alone\nline", 5: "alone\nline", 6: "y", 7: "z", 8: None, None: ""} | {100 + k: f"line {k}\nline {k}\n" for k in range(40)}
    for limit in (line_dedup.BROADCAST_LINES, 0):  # lists as a broadcast, and lines joined by host and digest
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
        clean = line_dedup.drop_boilerplate(docs)
        assert {r["doc_id"]: r["__text"] for r in clean.collect()} == want
        assert odd_intact(clean)
    out = line_dedup.without_boilerplate(docs)
    assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()} == want


# --- SimHash, sharding


def test_near_duplicates_with_other_names_and_kinds(spark):
    rng = random.Random(13)
    base = [words(rng, 40) for _ in range(6)]
    rows = [(f"id{k:03}", base[k % 6] if k % 4 else base[k % 6] + " ", k) for k in range(40)] + [("id005", base[5], 900), ("id005", base[5], 900), (None, base[0], 1), (None, "quite another text", 2), (None, "quite another text", 2)]
    docs = spark.createDataFrame(rows, "key string, body string, n int").withColumn("__t", F.lit("t")).withColumn("stays", F.lit(1))
    kept = simhash.without_near_duplicates(docs, id_col="key", text_col="body")
    assert kept.columns == docs.columns
    roots = brute_components({plain_fingerprint(t) for _, t, _ in rows}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for key, text, _ in rows:
        root = roots[plain_fingerprint(text)]
        least[root] = min(least.get(root, (True, "")), (key is None, key or ""))
    assert sorted((r["key"] is None, r["key"] or "") for r in kept.collect()) == sorted(least.values())


def test_shards_are_written_whole(spark, tmp_path):
    rng = random.Random(14)
    rows = [(k, words(rng, 60)) for k in range(80)] + [(1000, "equal rows")] * 200 + [(None, None)]
    docs = with_odd_columns(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("shard", F.lit("own"))
    sharding.write_shards(docs, str(tmp_path / "s"), limit=1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in back.select("doc_id", "text").collect()) == sorted((str(a), str(b)) for a, b in rows)
    assert odd_intact(back)
    for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("held"), F.count_distinct("doc_id").alias("ids")).collect():
        assert r["held"] <= 1000 or r["ids"] == 1
    assert odd_intact(sharding.shard(docs, 5000))


# --- embeddings


def test_no_link_is_lost_in_a_large_label(spark):
    rng = np.random.default_rng(15)
    x = rng.standard_normal((12_000, 24)).astype(np.float32)
    near = rng.integers(0, 12_000, 3000)
    x = np.concatenate([x, x[near] + (rng.random((3000, 1)) * 0.3 * rng.standard_normal((3000, 24))).astype(np.float32)])
    assert embed_dedup.table_sizes(len(x), 0.98)[0] >= 8
    unit = embed_dedup.unit_rows(x)
    left, right = [], []
    for k in range(0, len(unit), 3000):
        i, j = np.nonzero(unit[k : k + 3000] @ unit.T >= 0.98)
        own = i + k < j
        left.append(i[own] + k)
        right.append(j[own])
    left, right = np.concatenate(left), np.concatenate(right)
    assert len(left) > 500
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "label": np.ones(len(x), np.int32), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = {r["vec_id"]: r for r in embed_dedup.embedding_duplicates(df).collect()}
    links = np.bincount(np.r_[left, right], minlength=len(x))
    assert [got[k]["n_links"] for k in range(len(x))] == links.tolist()
    from samplery.llm.bitslice import local_roots

    assert [got[k]["component_id"] for k in range(len(x))] == local_roots(len(x), left, right).tolist()


def test_kept_vectors_keep_their_columns(spark):
    rows = [(1, [1.0, 0.0], 0, "p"), (2, [1.0, 0.001], 0, "q"), (3, [0.0, 1.0], 0, "r"), (4, None, 0, "s"), (None, [1.0, 0.0], 0, "t")]
    out = embed_dedup.without_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string"))
    assert sorted((r["vec_id"], r["node"]) for r in out.collect()) == [(1, "p"), (3, "r"), (4, "s")]


def test_sketches_of_links_lie_within_the_radius():
    r = embed_dedup.sketch_radius(0.98)
    p = np.arccos(0.98) / np.pi
    chance = (np.random.default_rng(1).binomial(256, p, 2_000_000) > r).mean()
    assert chance == 0 and 30 < r < 60


# --- pieces


@needs_model
def test_another_vocabulary_gets_another_encoder():
    one = pieces.PieceModel.load()
    two = pieces.PieceModel(list(one.pieces), list(one.scores), list(one.kinds), one.prefix, one.unknown)
    assert one.digest == two.digest and pieces._encoder(one) is pieces._encoder(two)
    at = one.pieces.index("▁the")
    two = pieces.PieceModel([*one.pieces[:at], "▁theqz", *one.pieces[at + 1 :]], one.scores, one.kinds, one.prefix, one.unknown)
    ids = pieces._encoder(one).encode(["the"])[0].tolist()
    assert ids == [at] and pieces._encoder(two).encode(["the"])[0].tolist() != ids


@needs_model
def test_long_texts_without_blanks(monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(16)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéñ.,漢字", k=n)) for n in (39, 40, 41, 900, 60_000)] + ["ab" * 30_000, "x" * 20_000]
    monkeypatch.setattr(pieces, "INDEX_CHARS", 1000)  # many windows
    encoder = pieces.Encoder(pieces.PieceModel.load())
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == library.encode(texts)
    assert max(map(len, encoder.place)) <= pieces.SHORT and len(encoder.ends) == len(encoder.place) + 1


@needs_model
def test_encoding_keeps_odd_columns(spark):
    docs = with_odd_columns(spark.createDataFrame([(1, "one text"), (None, None), (2, "")], "doc_id long, text string"))
    model = pieces.PieceModel.load()
    out = pieces.encode(docs, model)
    assert sorted(out.columns) == sorted(c for c in docs.columns if c != "text") and odd_intact(out, but=("piece_ids",))
    assert {r["doc_id"]: r["piece_ids"] for r in out.collect()}[2] == []
    back = pieces.decode(pieces.encode(docs, model, out_col="x`y"), model, "x`y")
    assert odd_intact(back) and {r["doc_id"]: r["text"] for r in back.collect()} == {1: "one text", None: None, 2: ""}


# --- classifier


def test_likelihood_and_gradient(spark):
    rng = np.random.default_rng(17)
    n, f, grades = 30, 6, 4
    y, doc, at, value = rng.integers(0, grades, n), rng.integers(0, n, 90), rng.integers(0, f, 90), rng.random(90)
    param = np.r_[rng.standard_normal(f), -1.0, rng.standard_normal(grades - 2) * 0.3]
    x = np.zeros((n, f))
    np.add.at(x, (doc, at), value)
    cut = [-1e9, *np.cumsum(np.r_[param[f], np.exp(param[f + 1 :])]), 1e9]
    above = lambda t, s: 1 / (1 + np.exp(np.clip(t - s, -500, 500)))  # noqa: E731  chance of a grade above the threshold
    plain = -np.mean([np.log(above(cut[k], s) - above(cut[k + 1], s)) for k, s in zip(y, x @ param[:f], strict=True)]) + 0.05 * (param[:f] ** 2).sum()
    got, grad = ordinal.loss(param, y, doc, at, value, f, 0.1)
    assert got == pytest.approx(plain)
    for k in range(len(param)):
        step = np.eye(len(param))[k] * 1e-6
        change = (ordinal.loss(param + step, y, doc, at, value, f, 0.1)[0] - ordinal.loss(param - step, y, doc, at, value, f, 0.1)[0]) / 2e-6
        assert grad[k] == pytest.approx(change, abs=1e-6)
    model = ordinal.OrdinalModel(rng.standard_normal(ordinal.BUCKETS).astype(np.float32).astype(float), np.array([-1.0, 0.5]))
    texts = ["", None, "One two  two THREE!!", words(random.Random(1), 500), "word " * 200_000, "x" * 300_000]
    docs = with_odd_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    scored = ordinal.score(docs, model)
    assert odd_intact(scored)
    for r in scored.collect():
        buckets, values = ordinal.features(r["text"])
        tails = 1 / (1 + np.exp(np.clip(model.thresholds - (model.weights[buckets] * values).sum(), -60, 60)))
        assert (r["__grade"], r["__tail"]) == pytest.approx((tails.sum(), tails[-1]), rel=1e-5)
    judged = ordinal.classify(docs, spark.createDataFrame([(k, k % 2, 0) for k in range(6)], "doc_id long, quality int, toxic int"))
    assert odd_intact(judged, but=("__kept",)) and judged.count() == 6
    assert ordinal.selected(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).columns == docs.columns


# --- rules


def plain_path(rows, tree, node, x, level):
    if tree["feature"][node] < 0:
        n = len(rows)
        rest = 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
        return level + rest
    f, cut = tree["feature"][node], tree["cut"][node]
    assert rows[:, f].min() <= cut < rows[:, f].max()
    low = x[f] <= cut
    return plain_path(rows[(rows[:, f] <= cut) == low], tree, tree["left" if low else "right"][node], x, level + 1)


def test_forest_paths_and_thresholds():
    rng = np.random.default_rng(18)
    samples = [rng.standard_normal((n, 3)).round(1) for n in (256, 256, 40, 1)]
    forest = rules.grow_forest(samples)
    x = np.concatenate([rng.standard_normal((50, 3)), 6 * rng.standard_normal((5, 3))])
    mean = np.array([np.mean([plain_path(s, t, 0, r, 0) for s, t in zip(samples, forest, strict=True)]) for r in x])
    expected = 2 * (np.log(255) + np.euler_gamma) - 2 * 255 / 256
    assert rules.anomaly(forest, x) == pytest.approx(2 ** (-mean / expected))
    scores, good = np.arange(100) / 100, np.r_[np.ones(90, bool), np.zeros(10, bool)]
    assert rules.calibrate(scores, good, 0.9) == 0.89 and rules.calibrate(scores, ~good, 0.9) == 0.99
    assert rules.calibrate(scores, good & False, 0.9) == float("inf") and rules.calibrate(scores, good | True, 0.9) == 0.99


def test_rules_without_labels_and_with_long_texts(spark):
    rows = [(1, "plain words " * 3), (2, "a b c"), (3, None), (None, words(random.Random(2), 300)), (4, words(random.Random(3), 200_000, 10**6)), (5, "x" * 1_000_000)]
    docs = with_odd_columns(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in rules.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert {k: r["kept"] for k, r in got.items()} == {1: False, 2: False, 3: False, None: True, 4: True, 5: False}
    assert all(r["kept"] != r["base_failed"] for r in got.values()) and got[4]["n_words"] == 200_000


# --- languages


def test_digits_and_fractions_are_no_letters(spark):
    rows = [(k, "the thing is here", "en") for k in range(20)] + [(k, "das ding ist hier", "de") for k in range(20, 40)]
    rows += [(100, "² ½ ①", "en"), (101, "12 _ %", "de"), (102, "", None), (103, None, None), (104, "the ² thing", None), (105, "das " * 100_000, None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(with_odd_columns(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()}
    assert [got[k] for k in range(100, 104)] == [("und", 0.0)] * 4 and got[104][0] == "en" and got[105][0] == "de"
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert "".join(langid._LETTERS.findall(every)) == "".join(c for c in every if c.isalpha())
    assert langid.words_of("A1b²c½ ①x_y Ünï-漢") == ["a", "b", "c", "x", "y", "ünï", "漢"]


def test_votes_against_plain_loops():
    rng = np.random.default_rng(19)
    members = {"a": ["a1"], "b": ["b1", "b2", "b3", "b4"], "c": ["c1", "c2"]}
    pairs = [(f, x, y) for f, own in members.items() for k, x in enumerate(own) for y in own[k + 1 :]]
    model = langid.LanguageModel(sorted(members), members, pairs, np.zeros((1, 3 + len(pairs))), np.zeros(3 + len(pairs)))
    margins = rng.standard_normal((300, 3 + len(pairs)))
    got, scores = model.decide(margins)
    for row, name, score in zip(margins, got, scores, strict=True):
        family = sorted(members)[int(np.argmax(row[:3]))]
        wins = dict.fromkeys(members[family], 0.0)
        for k, (f, x, y) in enumerate(pairs):
            if f == family:
                wins[x if row[3 + k] > 0 else y] += 1
                wins[x] += 1e-3 * np.tanh(row[3 + k])
                wins[y] -= 1e-3 * np.tanh(row[3 + k])
        assert name == max(members[family], key=lambda k: wins[k]) and 0 <= score <= 1
    x = rng.random((40, langid.BUCKETS)).astype(np.float32)
    y = np.where(x[:, 0] > 0.5, 1.0, -1.0)
    x[:, 0] += y
    w, b = langid.linear_svm(x - x.mean(axis=0), y)
    assert (np.sign((x - x.mean(axis=0)) @ w + b) == y).all()


def test_the_sample_of_many_languages_is_bounded(spark, monkeypatch):
    rows = [(k, f"text of language {k % 60} w{k}", f"l{k % 60}") for k in range(6000)]
    seen = []
    monkeypatch.setattr(langid, "fit_languages", lambda x, languages: seen.append((x.shape, len(set(languages)))))
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=600)
    assert 400 < seen[0][0][0] < 800 and seen[0][1] == 60


# --- archives


def test_records_that_blank_lines_cut(spark, tmp_path):
    bodies = ["", "\r\n", "\r\n\r\n", "a\r\n\r\nb", "\r\n\r\n\r\n", "x\r\n\r\n\r\n", "\n", "WARC/1.1\r\n\r\n", "é\r", "same", "same", None, "\r\n\r"]
    pages = spark.createDataFrame([(k, f"http://h{k % 3}/{k % 5}", b) for k, b in enumerate(bodies * 6)], "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    got = warc.archive_round_trip(pages, str(tmp_path / "w"), archive_rows=7).collect()
    assert len([f for f in os.listdir(tmp_path / "w") if f.endswith(".gz")]) >= 78 // 7
    latest = {b or "": k for k, b in enumerate(bodies * 6)}
    for r in got:
        body = (bodies * 6)[r["page_id"]] or ""
        assert r["payload_bytes"] == len(body.encode()) and r["refers_to"] == (None if latest[body] == r["page_id"] else latest[body])
    keys = [(r["url_key"], r["date"], r["page_id"]) for r in got]
    assert keys == sorted(keys) and len({r["run"] for r in got}) > 2


def test_a_cut_archive_is_an_error():
    head = b"WARC/1.1\r\nContent-Length: 5"
    assert [b for _, b in warc.records(iter([head, b"12345", head, b"1", b""]))] == [b"12345", b"1\r\n\r\n"[:5]]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(iter([head, b"12"])))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.records(iter([b"<html>"])))


def test_unsorted_runs_merge_too():
    rng = random.Random(20)
    rows = [(f"u{rng.randrange(4)}", f"d{rng.randrange(3)}", rng.choice([None, 1, 2]), run) for run in ("x", "y", "z") for _ in range(20)]
    order = warc.merged(pa.table(dict(zip(("url_key", "date", "page_id", "run"), zip(*rows, strict=True), strict=True))))
    key = lambda r: (r[0], r[1], r[2] is not None, r[2] or 0)
    assert sorted(order.tolist()) == list(range(60)) and [key(rows[k]) for k in order] == sorted(map(key, rows))


# --- the pipeline


@needs_model
def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import sentencepiece

    rng = random.Random(21)
    rows = []
    for k in range(240):
        w = words(rng, rng.choice([12, 40, 90]))
        text = w.upper().replace(" ", "!! ") if k % 8 == 0 else "menu home\n" * (k % 3 == 0) + w + "\nlast line" * (k % 5 == 0)
        rows.append([k, text, "en", rng.choice(["a", "b", "B", None]), len(text)])
    rows[11][1] = rows[12][1] = rows[13][1]
    rows[14][1], rows[15][1], rows[16][1], rows[17][1] = None, None, "", " \n"
    rows += [list(rows[21]), list(rows[21]), [None, "no id but a few words here", "en", "a", 26], [None, None, None, None, None]]
    os.makedirs(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "sf/documents.parquet"))
    labels = spark.createDataFrame([(k, int(k % 8 > 0), 0) for k in range(0, 240, 2)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "sf/labels.parquet"))
    sf, key = str(tmp_path / "sf"), lambda r: tuple(map(repr, r))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = ordinal.train(docs, labels)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)

    def quality(rows):
        def stays(text):
            buckets, value = ordinal.features(text)
            return not (text or "").strip(common.SPACE) or model.tails(np.array([(model.weights[buckets] * value).sum()]))[0, -1] >= ordinal.SELECT

        return [r for r in rows if stays(r[1])]

    def lines(rows):
        pages, out = {}, []
        for t, s in {(r[1], r[3]) for r in rows if r[1] is not None}:
            pages.setdefault(s, []).append({x.strip(common.SPACE) for x in t.split("\n")})
        for r in rows:
            if r[1] is not None:
                own = pages[r[3]]
                held = lambda x: sum(x.strip(common.SPACE) in p for p in own)  # noqa: B023, E731
                text = "\n".join(x for x in r[1].split("\n") if not x.strip(common.SPACE) or held(x) < 2 or held(x) / len(own) <= 0.1)
                r = (r[0], text, r[2], r[3], len(text))
            out.append(r if r[1] is not None else (*r[:4], None))
        return out

    def near(rows):
        roots, best = brute_components({plain_fingerprint(r[1]) for r in rows}, lambda a, b: (a ^ b).bit_count() <= 3), {}
        for r in rows:
            root = roots[plain_fingerprint(r[1])]
            best[root] = min(best.get(root, ((True, 0), r)), ((r[0] is None, r[0] or 0), r), key=lambda x: x[0])
        return [r for _, r in best.values()]

    def mix(rows):
        taken = {(i, t, s): n for i, t, s, n in brute_mix([(r[0], r[1], r[3]) for r in rows])}
        return [r for r in rows for _ in range(taken[str(r[0]), r[1] or "", str(r[3])])]

    def tokens(rows):
        return [(*[v for k, v in enumerate(r) if k != 1], None if r[1] is None else library.encode(r[1])) for r in rows]

    own = [tuple(r) for r in rows]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (quality, lines, near, mix, tokens), strict=True):
        before, own = own, plain(own)
        docs = common.materialize(stage(spark, docs, sf), "stage")
        assert sorted(key(r) for r in docs.collect()) == sorted(map(key, own)), name
        assert own != before, name
    final = sorted(key(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert final == sorted(map(key, own))
