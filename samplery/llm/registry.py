"""The corpus operators' queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplery.llm import embed_dedup, langid, line_dedup, mixing, ordinal, pieces, pii, prefix_trie, rules, sharding, simhash, vector_codes, warc


#: The kinds of personal data that operator 11 counts.
BASE = ("email", "ip", "card", "phone")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharded.select("doc_id", F.col("__bytes").alias("n_bytes"), F.col("__depth").alias("depth"), F.col("__shard").alias("shard"), F.col("__shard_bytes").alias("shard_bytes"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return clean.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.length("__text").cast("long").alias("kept_chars"), F.md5("__text").alias("kept_md5"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ordinal.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", F.col("__grade").alias("expected_grade"), F.col("__tail").alias("top_grade_chance"), F.col("__kept").alias("kept"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), pieces.PieceModel.load())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("__pii")
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(pii.of_kinds(spans, kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(pii.of_kinds(spans, *BASE)), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", F.col("__code").alias("code"), F.col("__error").alias("error"), F.col("__label_error").alias("label_error"), F.col("__codebooks").alias("codebooks_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), change=prefix_trie.rebuilt)


def sharding_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 with a limit of 64 KiB, at which small tables split over several levels too."""
    sharded = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 1 << 16)
    return sharded.select("doc_id", F.col("__bytes").alias("n_bytes"), F.col("__depth").alias("depth"), F.col("__shard").alias("shard"), F.col("__shard_bytes").alias("shard_bytes"))


def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all pages with their host as payload, so that many payloads are equal."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.regexp_extract("url", "//([^/]*)", 1))
    history = warc.archive_round_trip(pages)
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_simhash": op3_simhash,
    "op4_sharding": op4_sharding,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_line_dedup": op6_line_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_pii": op11_pii,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
    "sharding_levels": sharding_levels,
    "warc_revisits": warc_revisits,
}


def _warc_sql(html: str) -> str:
    return rf"""
WITH p AS (
  SELECT page_id, {html} AS html, sha1({html}) AS sha FROM pages),
d AS (
  SELECT *, max(page_id) OVER (PARTITION BY sha) AS latest,
         array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform(range(0, 4), lambda j:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, (5 * k + 1)::INTEGER, 5))::INTEGER >> (15 - 5 * j)::INTEGER) & 31) + 1, 1)), '')), '') AS digest
  FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM d"""


def _sharding_sql(limit: int) -> str:
    return rf"""
WITH h AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, row_number() OVER () AS rn,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
ups AS (SELECT rn, n_bytes, d, h >> (60 - d) AS p FROM h, range(0, 61) r(d)),
held AS (SELECT d, p, sum(n_bytes)::BIGINT AS held FROM ups GROUP BY d, p),
own AS (SELECT rn, coalesce(min(CASE WHEN held <= {limit} THEN ups.d END), 60) AS depth FROM ups JOIN held ON ups.d = held.d AND ups.p = held.p GROUP BY rn)
SELECT doc_id, n_bytes, depth::INTEGER AS depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth::INTEGER, '0') END AS shard, held AS shard_bytes
FROM h JOIN own USING (rn) JOIN held ON held.d = depth AND held.p = h >> (60 - depth)"""


def _vector_codes_sql(rounds: int = 2) -> str:
    ctes = [r"""
v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn, vec_id, label,
         list_transform(embedding, lambda x: least(greatest(floor(x::DOUBLE * 256), -67108864), 67108864)::BIGINT) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND list_position(embedding, NULL) IS NULL AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
w AS (SELECT ((max(len(e)) + 15) // 16)::BIGINT AS size FROM v),
c AS MATERIALIZED (SELECT rn, p, list_transform(range(p * size, (p + 1) * size), lambda k: coalesce(e[k + 1], 0)) AS x FROM v, w, range(16) r(p)),
b0 AS MATERIALIZED (SELECT p, rn - 1 AS k, x FROM c WHERE rn <= 64)"""]
    for r in range(rounds + 1):
        ctes.append(rf"""
a{r} AS MATERIALIZED (
  SELECT rn, p, arg_min(k, (d, k)) AS k, min(d) AS d
  FROM (SELECT c.rn, c.p, b.k, list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM c JOIN b{r} b ON c.p = b.p) GROUP BY rn, p)""")
        if r < rounds:
            ctes.append(rf"""
m{r} AS (SELECT p, k, list(m ORDER BY j) AS x FROM (
  SELECT p, k, j, floor(sum(y) / count(*))::BIGINT AS m
  FROM (SELECT c.p, a.k, unnest(c.x) AS y, generate_subscripts(c.x, 1) AS j FROM c JOIN a{r} a ON c.rn = a.rn AND c.p = a.p) GROUP BY p, k, j) GROUP BY p, k),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.k = m.k)""")
    return "WITH " + ",".join(ctes) + rf""",
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS sha FROM b{rounds}),
o AS (SELECT rn, string_agg(lpad(lower(hex(k)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rn)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM v JOIN o USING (rn), h"""


def _pii_sql() -> str:
    """Each kind's matches with the gaps around them, checked and scored; RE2 has no possessive quantifiers and needs none."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    part = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    size = "CASE WHEN n IS NULL THEN 0 WHEN len(replace(m[:n], ' ', '')) = n THEN n WHEN len(replace(m[:n + (n - 1) // 4], ' ', '')) = n THEN n + (n - 1) // 4 ELSE 0 END"
    luhn = f"list_sum(list_transform(range(len({digits})), lambda k: CASE WHEN k % 2 = 0 THEN {digits}[len({digits}) - k]::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][{digits}[len({digits}) - k]::INT + 1] END)) % 10 = 0"
    lengths = ", ".join(f"('{x[:2]}', {x[2:]})" for x in pii.IBAN_LENGTHS.split())
    apart = "AND NOT regexp_matches(g[-4:], '{}') AND NOT regexp_matches(a[:1], '[0-9]')"
    code = "replace(m[:size], ' ', '')"
    mod97 = f"list_reduce(list_prepend(0, list_transform(string_split({code}[5:] || {code}[:4], ''), lambda ch: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ch) - 1)), lambda r, x: (r * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1"
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_matches(m, '^{part}(\.{part}){{3}}$')"),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN len({digits}) BETWEEN 13 AND 19 THEN {luhn} ELSE false END"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"len({digits}) BETWEEN 9 AND 15"),
        "iban": (r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9])+", f"CASE WHEN size = 0 THEN false ELSE NOT regexp_matches(g[-1:], '[A-Za-z0-9]') AND m[size + 1:size + 1] IN ('', ' ') AND NOT (size = len(m) AND regexp_matches(a[:1], '[A-Za-z0-9]')) AND {mod97} END"),
        "local_phone": (r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", "true " + apart.format("[0-9+][ .(-]*$")),
        "national_id": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "true " + apart.format("[0-9-]$") + " AND NOT starts_with(a, '-') AND NOT regexp_matches(m, '^(000|666|9)|-00-|0000$')"),
    }
    near = f"translate(g[-{pii.BEFORE}:] || ' # ' || a[:{pii.AFTER}], '{pii.UPPER}', '{pii.LOWER}')"
    parts = []
    for i, k in enumerate(pii.KINDS):
        pattern, holds = rules[k.name]
        score = f"{k.prior} + CASE WHEN regexp_matches({near}, '(^|[^a-z])({k.words})($|[^a-z])') THEN {pii.FOR} ELSE 0 END"
        if k.against:
            score += f" + CASE WHEN regexp_matches({near}, '(^|[^a-z])({k.against})($|[^a-z])') THEN {pii.AGAINST} ELSE 0 END"
        least = "" if k.always else f" AND {score} >= {pii.THRESHOLD}"
        parts.append(rf"""
SELECT rn, {i} AS o, '{k.name}' AS kind, start, start + {'size' if k.length else 'len(m)'} AS stop FROM (
  SELECT *, {size if k.length else '0'} AS size FROM (
    SELECT rn, ms[i] AS m, gs[i] AS g, gs[i + 1] AS a, (list_sum(list_transform(gs[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: len(x))), 0))::BIGINT AS start
    FROM (SELECT rn, ms, string_split_regex(text, '{pattern}') AS gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rn, text, regexp_extract_all(text, '{pattern}') AS ms FROM t) WHERE len(ms) > 0))
  LEFT JOIN (VALUES {lengths if k.length else "('', 0)"}) l(country, n) ON country = m[:2]) WHERE {holds}{least}""")
    union = " UNION ALL ".join(parts)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({union}),
d AS (SELECT rn, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) AS spans, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) FILTER (o < {len(BASE)}) AS base FROM s GROUP BY rn)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN d USING (rn)"""


ORACLE_SQL: dict[str, str] = {
    "op11_pii": _pii_sql(),
    "op12_vector_codes": _vector_codes_sql(),
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] || lpad(lower(hex(strlen(coalesce(text, '')))), 8, '0') AS code
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, list({'code': code, 'size': strlen(text)} ORDER BY turn NULLS FIRST, code) AS codes,
         xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END), 4294967295) % 9 AS h
  FROM t GROUP BY c),
r AS (SELECT o.c, list_concat(coalesce(b.codes[:o.h], []), o.codes[o.h + 1:]) AS codes FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 5),
p AS MATERIALIZED (SELECT c, d, list_transform(codes[:d], lambda x: x.code) AS prefix, CASE WHEN d > 0 THEN codes[d].size ELSE 0 END AS size, d = len(codes) AS ends FROM (SELECT c, codes, unnest(range(len(codes) + 1)) AS d FROM r)),
node AS MATERIALIZED (SELECT d, prefix, min(c) AS v, count(*) AS n, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, prefix),
own_node AS MATERIALIZED (SELECT p.c, p.d, node.v FROM p JOIN node ON p.d = node.d AND p.prefix = node.prefix),
child AS (SELECT a.v, a.d, count(*) AS k FROM node x JOIN own_node a ON a.c = x.v AND a.d = x.d - 1 GROUP BY a.v, a.d),
under AS (SELECT a.v, a.d, sum((x.n - 1) * x.size) AS saved, count(*) FILTER (child.k IS NULL) AS leaves
  FROM node x JOIN own_node a ON a.c = x.v AND a.d <= x.d LEFT JOIN child ON child.v = x.v AND child.d = x.d GROUP BY a.v, a.d)
SELECT node.v AS conv_id, node.d::BIGINT AS depth, a.v AS parent_conv_id, node.n::BIGINT AS n_convs, coalesce(child.k, 0)::BIGINT AS n_children,
       under.leaves::BIGINT AS n_leaves, under.saved::BIGINT AS saved_tokens, ends_sha256
FROM node LEFT JOIN own_node a ON a.c = node.v AND a.d = node.d - 1 LEFT JOIN child ON child.v = node.v AND child.d = node.d JOIN under ON under.v = node.v AND under.d = node.d""",
    "op1_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS draw
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source),
lev AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM src)
          - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src),
tgt AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM lev) * weight) AS target FROM lev),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS whole FROM tgt),
ord AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ord""",
    "op2_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_position(embedding, NULL) IS NULL
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN comp ON comp.a = vec_id LEFT JOIN deg ON deg.a = vec_id""",
    "op10_warc": _warc_sql("coalesce(html, '')"),
    "warc_revisits": _warc_sql("regexp_extract(url, '//([^/]*)', 1)"),
    "op4_sharding": _sharding_sql(64 << 20),
    "sharding_levels": _sharding_sql(1 << 16),
    "op6_line_dedup": r"""
WITH doc AS (SELECT row_number() OVER () AS rn, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
ln AS (SELECT rn, source, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM doc),
co AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM ln),
tot AS (SELECT source, count(DISTINCT text) AS pages FROM doc GROUP BY source),
bad AS (
  SELECT c.source, core FROM (SELECT source, core, count(DISTINCT text) AS n FROM co WHERE core <> '' GROUP BY source, core) c
  JOIN tot ON c.source IS NOT DISTINCT FROM tot.source WHERE n > 1 AND n / pages > 0.1),
kept AS (
  SELECT rn, count(*) AS n_lines, count(*) FILTER (bad.core IS NOT NULL) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (bad.core IS NULL), '') AS kept
  FROM co LEFT JOIN bad ON co.source IS NOT DISTINCT FROM bad.source AND co.core = bad.core GROUP BY rn)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN text IS NOT NULL THEN length(kept) END::BIGINT AS kept_chars, CASE WHEN text IS NOT NULL THEN md5(kept) END AS kept_md5
FROM doc LEFT JOIN kept USING (rn)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
