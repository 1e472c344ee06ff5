"""Corpus operators against brute force on small tables with nulls, ties, copies, empty and long texts and clashing columns."""

import base64
import hashlib
import math
import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from samplery.llm import bitslice, common, embed_dedup, langid, line_dedup, mixing, ordinal, pieces, rules, sharding, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, component_id string"
PAGES = "page_id long, url string, html string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def sample_docs(n=120, seed=1):
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([1, 3, 20, 80, 300])) for _ in range(n)]
    texts[5] = texts[6] = texts[7]
    texts[8] = texts[7].replace("w1", "w2", 1)
    texts[9], texts[10], texts[11] = "", None, "  \n\t "
    texts[12] = "long " * 30_000
    rows = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "B", None, "a", "a"]), len(t or ""), "x", "y") for k, t in enumerate(texts)]
    return rows + [rows[3], (None, "no id here at all", "en", "a", 3, "x", "y"), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample_docs(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def at(doc_id):
    return -1 if doc_id is None else doc_id


def size_of(text):
    return len((text or "").encode().split())


# --- mixing


def water_fill(sizes, weights, total, cap):
    left, fixed = dict(sizes), {}
    while left:
        rest = total - sum(fixed.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
        over = [s for s in left if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = cap * sizes[s]
            del left[s]
    return fixed


def test_mix_targets_and_words(docs):
    rows = mixing.mix(docs).collect()
    sizes = {}
    for r in rows:
        assert r["__size"] == size_of(r["text"]) and 0 <= r["__copies"] <= 2
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["__size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    for s in order:
        own = [r for r in rows if r["source"] == s]
        assert own[0]["__target"] == pytest.approx(want[s])
        assert own[0]["__source_size"] == sizes[s]
        assert abs(sum(r["__copies"] * r["__size"] for r in own) - want[s]) <= max(r["__size"] for r in own)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((at(r["doc_id"]), r["__copies"]) for r in rows) == sorted((at(r["doc_id"]), r["__copies"]) for r in again)


def test_mix_takes_given_weights_and_empty_tables(spark, docs, none):
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).columns == none.columns
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    taken = {r["source"] for r in mixing.mixed_documents(docs, weights=weights, share=0.5).collect()}
    assert taken <= {"a", "b"} and taken


# --- components, bit planes, SimHash


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in common.connected_components(common.materialize(spark.createDataFrame(edges, "u long, v long"), "e")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 160)}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_bit_sliced_pairs_are_those_of_popcounts(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)), base ^ np.uint64(7), base ^ np.uint64(0xF0F)])
    groups = np.sort(rng.integers(0, 5, len(fps)))
    i, j = bitslice.pairs_within(fps, groups, radius)
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if groups[a] == groups[b] and int(fps[a] ^ fps[b]).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_against_brute_force(spark, docs, none):
    rows = simhash.near_duplicates(docs).collect()
    fps = [(r["doc_id"], r["fp"] % (1 << 64)) for r in rows]
    assert sorted((at(d), f) for d, f in fps) == sorted((at(r[0]), plain_fingerprint(r[1])) for r in sample_docs())
    roots = brute_components({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 3)
    for r in rows:
        own = [d for d, f in fps if d is not None and roots[f] == roots[r["fp"] % (1 << 64)]]
        assert r["component_id"] == (min(own) if own else None)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len({r["root"] for r in rows})
    assert simhash.near_duplicates(none).count() == 0 and simhash.without_near_duplicates(none).count() == 0


def test_simhash_matches_spark_hash(spark):
    text = "The quick Brown fox"
    row = spark.sql("select xxhash64('the quick brown') a, xxhash64('quick brown fox') b").first()
    votes = [(row["a"] % (1 << 64)), (row["b"] % (1 << 64))]
    assert simhash.fingerprint(text) == votes[0] & votes[1]


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    base = [k * 7919 % 4096 << 40 for k in range(60)]
    fps = sorted({b ^ x for b in base for x in (0, 1, 3)})
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    table = common.materialize(spark.createDataFrame([(f,) for f in fps], "fp long"), "fps")
    found = common.connected_components(simhash.fingerprint_links(table))
    got = {f: f for f in fps} | {r["node"]: r["component"] for r in found.collect()}
    assert got == roots


# --- embeddings


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    rows = []
    for k in range(200):
        v = base[k % 30] + 0.03 * rng.standard_normal(16) * (k % 4)
        rows.append((k, v.astype(np.float32).tolist(), k % 30 % 3))
    hot = rng.standard_normal(16)
    rows += [(1000 + k, (hot + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist(), 1) for k in range(70)]
    rows += [(300, rows[3][1], 0), (301, rows[3][1], 0), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, rows[3][1], None), (306, [1.0, None], 0), (307, [], 0), (308, [1.0, 2.0], 0), (None, rows[3][1], 0), (309, [1e30, 1e30], 2), (310, [2e30, 2e30], 2)]
    got = {r["vec_id"]: r for r in embed_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}

    def usable(r):
        return r[0] is not None and r[1] and r[2] is not None and None not in r[1] and np.isfinite(np.float64(r[1])).all() and any(r[1])

    own = {r[0]: (embed_dedup.unit_rows(np.array([r[1]], np.float32))[0], r[2]) for r in rows if usable(r)}
    linked = lambda a, b: own[a][1] == own[b][1] and len(own[a][0]) == len(own[b][0]) and own[a][0] @ own[b][0] >= 0.98
    roots = brute_components(list(own), linked)
    for r in rows:
        g = got[r[0]]
        assert g["component_id"] == (roots[r[0]] if r[0] in own else r[0])
        assert g["n_links"] == (sum(linked(r[0], b) for b in own if b != r[0]) if r[0] in own else 0)
        assert g["kept"] == (r[0] is not None and g["component_id"] == r[0])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.embedding_duplicates(empty).count() == 0


def test_more_bits_bring_more_tables():
    for largest in (10, 10_000, 10**9):
        bits, tables = embed_dedup.table_sizes(largest, 0.98)
        agree = (1 - math.acos(0.98) / math.pi) ** bits
        assert (1 - agree) ** tables <= embed_dedup.MISS


# --- sharding


@pytest.mark.parametrize("limit", [500, 5_000, 200_000, 1 << 30])
def test_shards_fit_and_are_no_deeper_than_needed(docs, limit):
    rows = sharding.shard(docs, limit).collect()
    assert len(rows) == docs.count()
    held = {}
    for r in rows:
        held[r["__shard"]] = held.get(r["__shard"], 0) + r["__bytes"]
        assert len(r["__shard"]) == r["__depth"] and r["__bytes"] == len((r["text"] or "").encode())
    for r in rows:
        assert held[r["__shard"]] == r["__shard_bytes"]
        assert r["__shard_bytes"] <= limit or r["__depth"] == sharding.BITS
    for s in held:
        assert not any(o != s and (o.startswith(s)) for o in held)
        if s and len(s) < sharding.BITS:
            assert sum(v for o, v in held.items() if o.startswith(s[:-1])) > limit


def test_sharding_of_nothing(none):
    assert sharding.shard(none).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(none, 0)


# --- lines


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        lines = [words(rng, 4) for _ in range(3)] + ["", "menu | home "] * (k % 3 == 0) + ["licence"] * (k % 11 == 0)
        rows.append((k, "\n".join(lines), "a" if k % 2 else None))
    rows += [(100 + k, rows[1][1], "a") for k in range(30)] + [(200, None, "a"), (201, "", "a"), (202, " menu | home", "a")]
    rows += [(300 + k, f"own line {k}" + "\nof two pages" * (k < 2), "b") for k in range(8)]  # two pages are enough of so few
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for d, text, host in rows:
        if text is None:
            assert got[d]["__text"] is None and got[d]["__lines"] == 0
            continue
        pages = {t for _, t, h in rows if h == host and t is not None}
        bad = lambda x: x.strip(common.SPACE) != "" and (n := sum(x.strip(common.SPACE) in [y.strip(common.SPACE) for y in p.split("\n")] for p in pages)) > 1 and n / len(pages) > 0.1
        kept = [x for x in text.split("\n") if not bad(x)]
        assert got[d]["__text"] == "\n".join(kept)
        assert (got[d]["__lines"], got[d]["__dropped"]) == (len(text.split("\n")), len(text.split("\n")) - len(kept))
    assert any(r["__dropped"] for r in got.values()) and [got[300 + k]["__dropped"] for k in range(3)] == [1, 1, 0]


def test_lines_keep_columns(docs, none):
    assert line_dedup.without_boilerplate(docs).columns == docs.columns
    assert line_dedup.without_boilerplate(none).count() == 0


# --- quality rules


def plain_base(text):
    text = text or ""
    w = text.encode().split()
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    covered = {k + x for k, v in enumerate(windows) if windows.count(v) > 1 for x in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    chars = sum(c not in common.SPACE for c in text)
    return [len(w), chars, sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_rule_counts_against_brute_force():
    rng = random.Random(8)
    for text in [None, "", "a b c d", "a a a a a a a", "x\nx\n\n \nx", "é# ü* |", *(words(rng, n, 6).replace("w1 ", "\n") for n in (10, 40, 120, 300)), words(rng, 200, 9000) * 2]:
        assert rules.statistics(text)[0] == plain_base(text)


def test_large_vocabularies_stay_exact():
    ids = np.r_[np.arange(100_000), np.arange(50, 60)]
    assert rules.repeated_words(ids) == 20


def test_rules_catch_odd_documents_and_keep_plain_ones(spark, none):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(400):
        bad = k % 12 == 0
        odd = rng.uniform(0.3, 1) if bad else 0
        text = " ".join(f"word{rng.randrange(900)}" + (rng.choice("#*$%") * rng.randint(1, 4) if rng.random() < odd else "") for _ in range(rng.randint(30, 300))) + "."
        rows.append((k, text, "en", "a", 0, "", ""))
        labels.append((k, 0 if bad else 1))
    rows += [(1000, None, "en", "a", 0, "", ""), (1001, "too short", "en", "a", 0, "", "")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rules.quality_rules(spark.createDataFrame(rows, DOCS), lab, keep=0.98).collect()}
    good = [got[k]["kept"] for k in range(400) if k % 12]
    assert sum(good) >= 0.98 * len(good)
    assert sum(not got[k]["kept"] for k in range(0, 400, 12)) >= 28  # of 34
    assert not got[1000]["kept"] and got[1001]["base_failed"]
    assert rules.quality_rules(none, lab).count() == 0


def test_each_tree_draws_from_all_rows(spark):
    rows = [(k, 20 + k % 7, 100, 0, 0, 0, [float(k)] * len(rules.FEATURES)) for k in range(6000)] + [(77, 20, 100, 0, 0, 0, [-1.0] * len(rules.FEATURES))] * 300
    stats = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>")
    drawn = rules.tree_samples(stats)
    assert [len(x) for x in drawn] == [256] * 100 and len({x for own in drawn for x in own[:, 0]}) > 4096
    again = rules.tree_samples(stats.repartition(7))
    assert all((a == b).all() for a, b in zip(drawn, again, strict=True))
    assert all(len(set(own[:, 0])) >= 200 for own in drawn)  # 6,300 rows: each tree draws for itself
    few = rules.tree_samples(stats, trees=4, sample=50)
    first = [r["features"][0] for r in stats.orderBy(F.xxhash64(F.lit(3), "doc_id", *rules.BASE), "doc_id").limit(200).collect()]
    assert [x for k in range(50) for x in (own[k, 0] for own in few)] == first  # dealt out, no row twice
    few = rules.tree_samples(stats.where("doc_id < 10"), trees=3)
    assert [len(x) for x in few] == [10] * 3 and rules.tree_samples(stats.limit(0)) == []


def test_forest_and_threshold_come_from_all_rows(spark):
    """Each node counts all rows that reach it, and all labelled rows set the threshold, however they are dealt out."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((9000, len(rules.FEATURES))).round(2)
    x[rng.permutation(9000)[:40]] += 6
    rows = [(k % 8990, 20 + (k % 9 == 0) * -15, 100, 0, 0, 0, v) for k, v in enumerate(x.tolist())]
    stats = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>")
    passing = np.array([r[1] >= 10 for r in rows])
    graded = {k: int(x[k].sum() < 2 + rng.standard_normal()) for k in range(0, 8990) if k % 6}
    labels = spark.createDataFrame([*graded.items(), (1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    forest, cut = rules.fit_rules(stats, labels, keep=0.97)
    assert len(forest) == rules.TREES
    for tree in forest[:7]:
        todo, seen = [(0, 0, np.flatnonzero(passing))], 0
        while todo:
            at, level, own = todo.pop()
            f, seen = tree["feature"][at], seen + 1
            assert tree["path"][at] == pytest.approx(level + rules.expected_path(len(own)))
            if f < 0:
                assert level == rules.HEIGHT or len(np.unique(x[own], axis=0)) == 1
                continue
            low = x[own, f] <= tree["cut"][at]
            assert x[own, f].min() <= tree["cut"][at] < x[own, f].max() and level < rules.HEIGHT
            todo += [(tree["left"][at], level + 1, own[low]), (tree["right"][at], level + 1, own[~low])]
        assert seen == len(tree["feature"])
    labelled = [k for k, r in enumerate(rows) if passing[k] and r[0] in graded]
    scores, good = rules.anomaly(forest, x[labelled]), np.array([graded[rows[k][0]] for k in labelled]) > 0
    assert len(labelled) > 4096 and cut == rules.calibrate(scores, good, 0.97)
    again, same = rules.fit_rules(stats.repartition(7), labels.repartition(3), keep=0.97)
    assert same == cut and all((a[c] == b[c]).all() for a, b in zip(forest, again, strict=True) for c in a)


def test_threshold_equals_that_of_plain_arrays(spark):
    rng = np.random.default_rng(7)
    for keep, bad in ((0.9, 0.2), (0.995, 0.5), (1.0, 0.1), (0.5, 0.0), (0.9, 1.0)):
        scores, good = rng.random(3000).round(3), rng.random(3000) >= bad
        scores[~good] = (scores[~good] + 0.3).round(3)
        graded = spark.createDataFrame(list(zip(scores.tolist(), good.tolist(), strict=True)), "anomaly double, good boolean").repartition(5)
        assert rules.threshold(graded, keep) == rules.calibrate(scores, good, keep)
    assert rules.threshold(graded.limit(0)) == float("inf")


# --- classifier


def test_classifier_orders_grades(spark, none):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(900):
        grade = k % 3
        w = [f"word{rng.randrange(3000)}" for _ in range(80)]
        if grade == 0:
            w = [x.upper() + "!!" for x in w]
        if grade == 1:
            w[10] = w[40] = rng.choice(["nasty", "vile", "foul"])
        rows.append((k, " ".join(w)))
        if k < 600:
            labels += [(k, int(grade > 0), int(grade == 1))]
    labels += [(0, 1, 0), (None, 1, 0), (1, None, 1)]
    docs = spark.createDataFrame([*rows, (None, None), (9999, " ")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in ordinal.classify(docs, lab).collect()}
    held = [(k % 3, got[k]["__kept"]) for k in range(600, 900)]
    assert sum(kept == (grade == 2) for grade, kept in held) >= 0.97 * len(held)
    mean = [np.mean([got[k]["__grade"] for k in range(600 + g, 900, 3)]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert got[None]["__kept"] and got[9999]["__tail"] is None
    assert ordinal.selected(docs, lab.limit(0)).count() == docs.count()
    assert ordinal.classify(none, lab).count() == 0


# --- language


def test_languages_held_out_accuracy(spark, none):
    rng = random.Random(7)
    vocabulary = {"en": ["the", "thing", "with", "when", "other"], "de": ["der", "und", "schloss", "nicht", "über"], "fr": ["être", "qui", "eau", "avec", "leçon"], "es": ["que", "niño", "ción", "para", "llave"], "fi": ["hyvää", "yötä", "kiitos", "sää", "äiti"]}
    rows = [(k, " ".join(rng.choices(vocabulary[lang], k=12)), lang) for k, lang in enumerate(rng.choices(list(vocabulary), k=500))]
    rows += [(1000, None, "en"), (1001, "123 !!", "de"), (None, "the thing with", None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    import zlib

    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(500))
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows[:500])
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[None]["lang_pred"] == "en" and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none).count() == 0


def test_ngrams_stay_inside_words():
    buckets, owner = langid.ngrams(["ab", "é"])
    assert (owner == 0).sum() == 2 + 3 + 2 and (owner == 1).sum() == 2 + 3 + 2


# --- pieces

needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file")


@needs_model
def test_pieces_match_the_library_and_round_trip(spark, docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(9)
    texts = ["", " ", "  two  blanks ", "new\nline\n\n x", "naïve café – 漢字かな 🙂 \U0001f9ea", "aaaaaaaaaaaaaaaaaaaaaaaa", "▁ mark", "\t tab", "x" * 5000, " " * 77, "supercalifragilistic" * 40]
    texts += ["".join(rng.choices("abcdeéñ \n.,THE", k=80)) for _ in range(200)]
    model = pieces.PieceModel.load()
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t)
        assert decoder.decode(ids.tolist()) == t.replace(pieces.BLANK, " ")
    encoded = pieces.encode(docs, model)
    assert [c for c in docs.columns if c != "text"] + ["piece_ids"] == encoded.columns
    back = pieces.decode(encoded, model)
    assert sorted((at(r["doc_id"]), r["text"] or "") for r in back.collect()) == sorted((at(r[0]), r[1] or "") for r in sample_docs())
    assert all(r["exact"] for r in pieces.round_trips(docs, model).collect())
    assert pieces.encode(none, model).count() == 0


@needs_model
def test_nul_and_replacement_characters_stay_apart(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["a\0b", "\0", "\0\0 \0", "a\ufffdb", "\0\ufffd\0", "end\0", "\0begin \0 mid\0dle\n\0\n", "\U0010ffff\0"]
    model = pieces.PieceModel.load()
    ids = [x.tolist() for x in pieces.Encoder(model).encode(texts)]
    assert ids == [library.encode(t) for t in texts]
    assert [pieces.Decoder(model).decode(x) for x in ids] == texts == [library.decode(x) for x in ids]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in pieces.decode(pieces.encode(docs, model), model).orderBy("doc_id").collect()] == texts
    rows = pieces.round_trips(docs, model).orderBy("doc_id").collect()
    assert all(r["exact"] for r in rows) and [r["n_pieces"] for r in rows] == [len(x) for x in ids]


# --- archives


def test_archives_round_trip(spark):
    rng = random.Random(10)
    rows = [(k, rng.choice([None, f"https://www.Host{k % 7}.example.com:80/p?q={k}#f", "http://host1.example.com/", f"//b.example/{k % 3}"]), rng.choice([f"<p>{k}</p>\r\n\r\nWARC/1.1\r\n\r\n é", "same\r\n", "", None])) for k in range(80)]
    rows += [rows[-1], (None, "http://x/\n", "same\r\n"), (500, "http://x/", "big" * 100_000)]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    got = warc.archive_round_trip(pages).collect()
    assert len(got) == len(rows)
    payload = lambda h: (h or "").encode()
    for r in got:
        html = next(h for p, _, h in rows if p == r["page_id"])
        last = max(p for p, _, h in rows if p is not None and payload(h) == payload(html))
        assert r["payload_bytes"] == len(payload(html)) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload(html)).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == last else ("revisit", last))
    keys = [(r["url_key"], r["date"], r["page_id"] is not None, r["page_id"] or 0) for r in got]
    assert keys == sorted(keys)
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_url_keys(spark):
    rows = [("https://www2.News.Example.com:8080/a?b#c", "com,example,news)/a?b"), ("http://user@x.org", "org,x)/"), (None, ")/")]
    got = spark.createDataFrame(rows, "u string, k string").select(warc.url_key(F.col("u")).alias("g"), "k").collect()
    assert all(r["g"] == r["k"] for r in got)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 20])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(50), i) for _ in range(rng.randrange(9))) for i in range(k)]
    assert list(warc.loser_tree([iter(r) for r in runs])) == sorted(sum(runs, []))
