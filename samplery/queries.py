"""One query per operator over the driver's tables, each beside its SQL.

Mappings: a record is a row of ``embeddings`` (label = group, the vector an 8 x 8 image), of ``events`` (group = place of
its type among the five) or of ``documents``; an annotated image is an order, its boxes are its line items.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samplery.functions import images as I
from samplery.functions import pixels as P
from samplery.functions import shapes as S
from samplery.functions import sizes as Z
from samplery.functions import uris as U
from samplery.functions.keys import SEED, integer, uniform
from samplery.operators import anchors as A
from samplery.operators import datasets as D
from samplery.operators import cuts, profile, samples, transcode
from samplery.plans import sampling as M
from samplery.plans import transforms as T
from samplery.plans.transforms import some_of
from samplery.sources import exports, records
from samplery.streaming.images import batch_pictures, decoded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    """Rounded for comparison, without negative zeros."""
    return F.round(c, 6) + F.lit(0.0)


def embeddings(spark: SparkSession, sf_dir: str, payload: bool = False) -> DataFrame:
    t = table(spark, sf_dir, "embeddings")
    own = t.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("serial"), "label", F.col("label").alias("grp"), *(["embedding"] if payload else []))
    return own


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    kinds = t.select("event_type").distinct().select(F.col("event_type").alias("k"), (F.row_number().over(Window.orderBy("event_type")) - 1).alias("grp"))
    return t.join(F.broadcast(kinds), F.col("event_type") == F.col("k")).select(F.col("event_id").alias("serial"), "grp", F.length("props").cast("long").alias("size"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    own = t.select(
        F.col("l_orderkey").alias("image"), (32 * (1 + F.col("l_orderkey") % 8)).cast("long").alias("width"), (32 * (1 + F.floor(F.col("l_orderkey") / 8) % 8)).cast("long").alias("height"),
        F.col("l_linenumber").alias("label"), (F.col("l_discount") * 5).alias("x"), (F.col("l_tax") * 5).alias("y"), (F.col("l_quantity") / 100).alias("w"), ((F.col("l_suppkey") % 50 + 1) / 100).alias("h"),
    )
    return own.withColumn("serial", F.row_number().over(Window.partitionBy("image").orderBy("label", "x", "y", "w", "h")))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as images."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("image"), (32 * (1 + k % 8)).cast("long").alias("width"), (32 * (1 + F.floor(k / 8) % 8)).cast("long").alias("height"))


BOX = """
b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY label, x, y, w, h) AS serial FROM (
  SELECT l_orderkey AS image, 32 * (1 + l_orderkey % 8) AS width, 32 * (1 + (l_orderkey // 8) % 8) AS height, l_linenumber AS label,
         l_discount * 5 AS x, l_tax * 5 AS y, l_quantity / 100 AS w, (l_suppkey % 50 + 1) / 100 AS h FROM lineitem))"""
PIC = "p AS (SELECT o_orderkey AS image, 32 * (1 + o_orderkey % 8) AS width, 32 * (1 + (o_orderkey // 8) % 8) AS height FROM orders)"
EV = "e AS (SELECT event_id AS serial, k.grp, length(props)::BIGINT AS size FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS grp FROM (SELECT DISTINCT event_type FROM events)) k USING (event_type))"


def sql_key(row: str, epoch: str = "0") -> str:
    return f"md5(concat_ws(':', '{SEED}', {epoch}::VARCHAR, ({row})::VARCHAR))"


def sql_uniform(name: str, row: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{SEED}', '{name}', ({row})::VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def sql_r6(e: str) -> str:
    return f"round({e}, 6) + 0.0::DOUBLE"


# --- scans and fields


@query("SELECT event_id AS serial, grp::INTEGER AS grp, size FROM (WITH " + EV + " SELECT serial AS event_id, grp, size FROM e)")
def index_scan(spark, sf_dir):
    return events(spark, sf_dir).withColumn("grp", F.col("grp").cast("int"))


@query("SELECT vec_id AS serial, label, embedding[1]::DOUBLE AS first_value FROM embeddings WHERE vec_id IN (3, 77, 300, 499)")
def record_lookup(spark, sf_dir):
    return records.at_serials(embeddings(spark, sf_dir, True), [3, 77, 300, 499]).select("serial", "label", F.col("embedding")[0].cast("double").alias("first_value"))


@query(r"""SELECT CASE WHEN length(t) = 0 THEN 0 WHEN regexp_matches(t, '^[ \t\n]*\{') THEN 3 ELSE 2 END AS kind, count(*) AS n
FROM (SELECT coalesce(props, '') AS t FROM events UNION ALL SELECT coalesce(text, '') FROM documents) GROUP BY 1""")
def field_sniff(spark, sf_dir):
    texts = table(spark, sf_dir, "events").select(F.col("props").alias("t")).unionAll(table(spark, sf_dir, "documents").select("text"))
    return texts.select(records.sniff(F.col("t")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id AS id, strlen(html)::BIGINT AS bytes, md5(html) AS raw_md5 FROM pages")
def raw_projection(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("serial"), F.lit(0.0).alias("label"), "html")
    made = records.make_records(t, [("html", records.NONE)])
    return made.select("id", F.octet_length(records.field(F.col("fields"), 0)).cast("long").alias("bytes"), F.md5(records.field(F.col("fields"), 0)).alias("raw_md5"))


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1)::BIGINT AS id FROM customer")
def auto_id(spark, sf_dir):
    return records.auto_id(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey", "c_custkey"]).select("c_custkey", "id")


@query(r"SELECT page_id, sha1(url) AS name, regexp_matches(url, '^(?i)(https?|ftp)://') AS is_url FROM pages")
def sha1_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", records.cache_name(F.col("url")).alias("name"), records.is_url(F.col("url")).alias("is_url"))


# --- filters and unions


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def filter_keep(spark, sf_dir):
    return D.keep(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def filter_exclude(spark, sf_dir):
    return D.exclude(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT vec_id AS id, label FROM embeddings WHERE label IN (2, 5, 7)")
def label_pick(spark, sf_dir):
    return D.pick_labels(embeddings(spark, sf_dir), [2, 5, 7]).select("id", "label")


@query("WITH " + BOX + ", " + PIC + " SELECT p.image, count(b.image) FILTER (WHERE b.h > 0.25) > 0 AS annotated FROM p LEFT JOIN b ON p.image = b.image GROUP BY p.image")
def annotation_split(spark, sf_dir):
    own = boxes(spark, sf_dir).where("h > 0.25").groupBy(F.col("image").alias("i")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.lit("rect").alias("type"), F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height")).alias("geometry"))).alias("shapes"))).alias("note"))
    return pictures(spark, sf_dir).join(own, F.col("image") == F.col("i"), "left").select("image", D.has_annotation(F.col("note")).alias("annotated"))


_PARTS = "SELECT vec_id AS id, label, 0 AS file FROM embeddings UNION ALL SELECT doc_id, quality, 1 FROM labels UNION ALL SELECT p_partkey, p_size, 2 FROM part"


def _parts(spark, sf_dir):
    """Three tables as record sets, with ids that repeat between them."""
    named = (("labels", "doc_id", "quality"), ("part", "p_partkey", "p_size"))
    return [embeddings(spark, sf_dir).select("id", "label"), *[table(spark, sf_dir, t).select(F.col(i).alias("id"), F.col(v).alias("label")) for t, i, v in named]]


@query(_PARTS)
def merge_union(spark, sf_dir):
    return D.merge(_parts(spark, sf_dir)).select("id", "label", "file")


@query(f"SELECT id, file AS label, file FROM ({_PARTS})")
def merge_label_by_input(spark, sf_dir):
    return D.merge(_parts(spark, sf_dir), label_by_input=True).select("id", "label", "file")


@query("SELECT vec_id AS serial, label AS grp, 0 AS file FROM embeddings UNION ALL SELECT event_id, 9 + 20, 1 FROM events")
def mixin_group_reset_delta(spark, sf_dir):
    first = embeddings(spark, sf_dir).select("serial", "grp")
    return M.mixin(first, table(spark, sf_dir, "events").select(F.col("event_id").alias("serial"), F.lit(4).alias("grp")), group_reset=9, group_delta=20).select("serial", "grp", "file")


@query(f"SELECT * FROM (SELECT vec_id AS serial, label AS grp, 0 AS file FROM embeddings UNION ALL SELECT * FROM (SELECT event_id, 2, 1 FROM events ORDER BY md5(concat_ws(':', '{SEED}', '0', '1', event_id::VARCHAR)), event_id LIMIT 100))")
def mixin_max_randomized(spark, sf_dir):
    first = embeddings(spark, sf_dir).select("serial", "grp")
    return M.mixin(first, table(spark, sf_dir, "events").select(F.col("event_id").alias("serial"), F.lit(2).alias("grp")), most=100, randomize=True).select("serial", "grp", "file")


# --- sampling plans


@query("SELECT 'label' AS grouping, bool_and(label >= 0) AND max(label) < 2000 AND max(label) > 0 AS usable, max(label)::BIGINT + 1 AS categories FROM embeddings UNION ALL SELECT 'price', bool_and(floor(o_totalprice) = o_totalprice AND o_totalprice >= 0) AND max(o_totalprice) < 2000 AND max(o_totalprice) > 0, floor(max(o_totalprice))::BIGINT + 1 FROM orders")
def category_check(spark, sf_dir):
    one = M.categories_usable(embeddings(spark, sf_dir)).withColumn("grouping", F.lit("label"))
    two = M.categories_usable(table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("grp"))).withColumn("grouping", F.lit("price"))
    return one.unionByName(two)


def _ranked_sql(groups: str, source: str = "embeddings", row: str = "vec_id", grp: str = "label") -> str:
    part = f"PARTITION BY {groups} " if groups else ""
    return f"r AS (SELECT {row} AS serial, {grp} AS grp, row_number() OVER ({part}ORDER BY {sql_key(row)}, {row}) - 1 AS pos, count(*) OVER ({part}) AS n FROM {source})"


@query("WITH " + _ranked_sql("label") + " SELECT serial, grp FROM r WHERE NOT (pos >= n * 3 // 7 AND pos < n * 4 // 7)")
def kfold_train(spark, sf_dir):
    return M.split(embeddings(spark, sf_dir), M.SampleConfig(stratify=True, split=7, split_fold=3)).select("serial", "grp")


@query("WITH " + _ranked_sql("label") + " SELECT serial, grp FROM r WHERE pos >= n * 3 // 7 AND pos < n * 4 // 7")
def kfold_val(spark, sf_dir):
    return M.split(embeddings(spark, sf_dir), M.SampleConfig(stratify=True, split=7, split_fold=3, split_negate=True)).select("serial", "grp")


@query("WITH " + EV + ", r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY " + sql_key("serial") + ", serial) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM e) SELECT serial, grp::INTEGER AS grp FROM r WHERE (pos >= n * 1 // 5 AND pos < n * 2 // 5) OR (pos >= n * 4 // 5)")
def kfold_keys(spark, sf_dir):
    return M.split(events(spark, sf_dir), M.SampleConfig(stratify=True, split=5, split_fold=-1, split_keys=(4, 1))).select("serial", F.col("grp").cast("int").alias("grp"))


@query("WITH " + _ranked_sql("") + " SELECT serial, CASE WHEN pos >= n // 5 AND pos < n * 2 // 5 AND pos - n // 5 < 30 THEN 'test' ELSE 'train' END AS part FROM r")
def kfold_max_test(spark, sf_dir):
    return M.kfold(embeddings(spark, sf_dir), folds=5, fold=1, most_test=30).select("serial", "part")


@query("SELECT event_id AS serial, (row_number() OVER (ORDER BY " + sql_key("event_id", "1") + ", event_id) - 1)::BIGINT AS draw FROM events")
def pooled_shuffle_order(spark, sf_dir):
    return M.draw_order(events(spark, sf_dir), M.SampleConfig()).select("serial", F.col("draw").cast("long").alias("draw"))


_BALANCED = "WITH " + _ranked_sql("label") + ", k AS (SELECT serial, grp, row_number() OVER (PARTITION BY grp ORDER BY " + sql_key("serial") + ", serial) - 1 AS pos FROM r WHERE NOT (pos >= n * 3 // 7 AND pos < n * 4 // 7)), o AS (SELECT serial, grp, (row_number() OVER (ORDER BY pos, grp) - 1)::BIGINT AS draw FROM k)"
_TRAIN = M.SampleConfig(stratify=True, oversample=True, split=7, split_fold=3, batch=32)


@query(_BALANCED + " SELECT serial, grp, draw FROM o")
def round_robin_order(spark, sf_dir):
    return M.draw_order(embeddings(spark, sf_dir), _TRAIN).select("serial", "grp", F.col("draw").cast("long").alias("draw"))


def _epochs(spark, sf_dir) -> int:
    """Draws of two and a half epochs of the largest group."""
    top = embeddings(spark, sf_dir).groupBy("grp").count().agg(F.max("count").alias("n"), F.count(F.lit(1)).alias("groups")).first()
    return 5 * top["n"] * top["groups"] // 2


def _looped_sql(epoch: str) -> str:
    return f"""WITH g AS (SELECT label AS grp, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS g, count(*) OVER () AS gs FROM embeddings GROUP BY label),
i AS (SELECT draw, draw % (SELECT max(gs) FROM g) AS g, draw // (SELECT max(gs) FROM g) AS t FROM (SELECT unnest(range((SELECT 5 * max(n) * max(gs) // 2 FROM g))) AS draw)),
d AS (SELECT draw, grp, t // n AS epoch, t % n AS pos FROM i JOIN g USING (g)),
r AS (SELECT vec_id AS serial, label AS grp, ep AS epoch, row_number() OVER (PARTITION BY label, ep ORDER BY {sql_key('vec_id', epoch)}, vec_id) - 1 AS pos FROM embeddings, range(0, 200) x(ep) WHERE ep <= (SELECT max(epoch) FROM d))
SELECT draw::BIGINT AS draw, serial, grp FROM d JOIN r USING (grp, epoch, pos)"""


@query(_looped_sql("0"))
def looped_draws(spark, sf_dir):
    return M.looped_draws(embeddings(spark, sf_dir), M.SampleConfig(stratify=True, oversample=True, reshuffle=False), _epochs(spark, sf_dir)).select(F.col("draw").cast("long").alias("draw"), "serial", "grp")


@query(_looped_sql("ep"))
def epoch_reshuffle(spark, sf_dir):
    return M.looped_draws(embeddings(spark, sf_dir), M.SampleConfig(stratify=True, oversample=True), _epochs(spark, sf_dir)).select(F.col("draw").cast("long").alias("draw"), "serial", "grp")


@query("WITH r AS (SELECT vec_id AS serial, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings) SELECT d::BIGINT AS draw, serial FROM r, range(0, 3) e(k), (SELECT 0) z(o), LATERAL (SELECT k * n + pos AS d) WHERE d >= n // 2 AND d < n // 2 + 2 * n")
def unshuffled_slice(spark, sf_dir):
    """Two epochs from the middle of the first one on, in the order of the serials."""
    n = embeddings(spark, sf_dir).count()
    return M.looped_draws(embeddings(spark, sf_dir), M.SampleConfig(shuffle=False), 2 * n, n // 2).select(F.col("draw").cast("long").alias("draw"), "serial")


@query("WITH " + EV + ", r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY " + sql_key("serial") + ", serial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM e) SELECT serial, size FROM r WHERE total < 1.2 * 20000 OR before < 20000")
def byte_budget_sample(spark, sf_dir):
    return M.byte_budget_sample(events(spark, sf_dir), 20_000).select("serial", "size")


@query(f"SELECT k AS draw, floor({sql_uniform('random_ids', 'k')} * (SELECT count(*) FROM events))::BIGINT AS serial FROM (SELECT unnest(range((SELECT count(*) FROM embeddings))) AS k)")
def random_ids(spark, sf_dir):
    return M.random_ids(spark, table(spark, sf_dir, "events").count(), table(spark, sf_dir, "embeddings").count())


# --- profiles


@query("WITH " + EV + " SELECT grp::BIGINT AS grp, count(*) AS n FROM e GROUP BY grp")
def stat_histogram(spark, sf_dir):
    return profile.stat(events(spark, sf_dir)).withColumnRenamed("rows", "n")


_DOCS = "d AS (SELECT quality AS label, toxic AS grp, strlen(text) AS size, CASE WHEN quality = 1 THEN 2 ELSE 0 END AS n_shapes FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_DOCS} SELECT count(*) AS records, {sql_r6('avg(size::DOUBLE)')} AS mean_size, min(size)::BIGINT AS min_size, max(size)::BIGINT AS max_size, round(var_pop(size::DOUBLE), 2) AS var_size, count(DISTINCT label) AS labels, count(DISTINCT grp) AS groups, 0::BIGINT AS fractional_labels, count(*) FILTER (grp <> label) AS group_not_label, sum(n_shapes)::BIGINT AS shapes, 'segmentation' AS task, 'other' AS grouped_by FROM d")
def overview_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("quality").alias("label"), F.col("toxic").alias("grp"), F.octet_length("text").cast("long").alias("size"), F.when(F.col("quality") == 1, 2).otherwise(0).alias("n_shapes"))
    return profile.overview(d).withColumn("mean_size", r6(F.col("mean_size"))).withColumn("var_size", F.round("var_size", 2))


@query("SELECT o_orderpriority AS priority, CASE WHEN count(*) FILTER (o_totalprice > 400000) > 0 THEN 'segmentation' WHEN count(DISTINCT o_totalprice) > 1 AND count(*) FILTER (o_totalprice <> floor(o_totalprice)) > 0 THEN 'regression' WHEN count(DISTINCT o_totalprice) > 1 THEN 'classification' ELSE 'none' END AS task FROM orders GROUP BY 1")
def guess_task(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_if(F.col("o_totalprice") > 400000).alias("s"), F.count_distinct("o_totalprice").alias("l"), F.count_if(F.col("o_totalprice") != F.floor("o_totalprice")).alias("f"))
    return o.select("priority", profile.task(F.col("s"), F.col("l"), F.col("f")).alias("task"))


_KINDS = ("rect", "point", "ellipse")


@query("WITH " + BOX + " SELECT CASE label % 3 WHEN 0 THEN 'rect' WHEN 1 THEN 'point' ELSE 'ellipse' END AS type, count(*) AS n FROM b GROUP BY 1")
def shape_histogram(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("label") % 3 + 1).cast("int"))
    notes = boxes(spark, sf_dir).select(F.to_json(F.struct(F.array(F.struct(kind.alias("type"), F.struct("x", "y").alias("geometry"))).alias("shapes"))).alias("note"))
    return profile.histogram(notes.select(profile.shape_type(F.col("note")).alias("type")), "type").withColumnRenamed("rows", "n")


@query("WITH " + BOX + f" SELECT label, {sql_r6('avg(w * h)')} AS mean_share, {sql_r6('stddev_pop(w * h)')} AS dev_share, count(*) AS boxes FROM b GROUP BY label")
def roi_ratio(spark, sf_dir):
    return profile.roi_ratio(boxes(spark, sf_dir), ["label"]).withColumn("mean_share", r6(F.col("mean_share"))).withColumn("dev_share", r6(F.col("dev_share")))


@query("WITH " + BOX + f" SELECT {sql_r6('avg(w * width / (h * height))')} AS mean_aspect, count(*) AS boxes FROM b WHERE w > 0 AND h > 0")
def mean_aspect(spark, sf_dir):
    return profile.mean_aspect(boxes(spark, sf_dir)).withColumn("mean_aspect", r6(F.col("mean_aspect")))


@query("WITH " + PIC + f" SELECT {sql_r6('avg(sqrt(width * height))')} AS mean_root_area, avg(width) AS mean_width, avg(height) AS mean_height, CASE WHEN avg(width) >= avg(height) THEN 'landscape' ELSE 'portrait' END AS layout FROM p")
def image_layout(spark, sf_dir):
    return profile.layout(pictures(spark, sf_dir)).withColumn("mean_root_area", r6(F.col("mean_root_area")))


@query("WITH " + BOX + f" SELECT image, {sql_r6('min(x)')} AS x, {sql_r6('min(y)')} AS y, {sql_r6('max(x + w) - min(x)')} AS w, {sql_r6('max(y + h) - min(y)')} AS h FROM b WHERE w > 0 AND h > 0 GROUP BY image")
def annotation_envelope(spark, sf_dir):
    return profile.annotation_bbox(boxes(spark, sf_dir)).select("image", *[r6(F.col(c)).alias(c) for c in "xywh"])


# --- shapes and geometry


def _rects(spark, sf_dir, pixels: bool = True):
    b = boxes(spark, sf_dir)
    of = lambda c, s: F.col(c) * F.col(s) if pixels else F.col(c)
    return b.withColumn("controls", S.rect_controls(of("x", "width"), of("y", "height"), of("w", "width"), of("h", "height")))


def _flat(df, *keep, controls="controls"):
    names = [f"{c}{k}" for k in range(4) for c in "xy"]
    return df.select(*keep, *[r6(F.col(controls)[k // 2]["xy"[k % 2]]).alias(n) for k, n in enumerate(names)])


@query("WITH " + BOX + f", n AS (SELECT image, to_json(list({{'label': label, 'x': x, 'y': y}} ORDER BY serial)) AS note FROM b GROUP BY image) SELECT image, serial::INTEGER AS serial, label, {sql_r6('x')} AS x, {sql_r6('y')} AS y FROM b")
def shapes_explode(spark, sf_dir):
    shape = F.struct("serial", F.lit("rect").alias("type"), F.col("label").cast("string").alias("label"), F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height")).alias("geometry"))
    notes = boxes(spark, sf_dir).groupBy("image").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(shape)), lambda s: F.struct(s["type"].alias("type"), s["label"].alias("label"), s["geometry"].alias("geometry"))).alias("shapes"))).alias("note"))
    parsed = notes.select("image", F.posexplode(S.parse_annotation(F.col("note"))).alias("pos", "s"))
    return parsed.select("image", (F.col("pos") + 1).alias("serial"), S.label_channels(F.col("s.label"))[0].cast("int").alias("label"), r6(F.col("s.geometry.x")).alias("x"), r6(F.col("s.geometry.y")).alias("y"))


_RC = ", ".join(f"{sql_r6(e)} AS {n}" for n, e in (("x0", "x * width"), ("y0", "y * height"), ("x1", "(x * width + w * width)"), ("y1", "(y * height + h * height)"), ("x2", "(x * width + w * width)"), ("y2", "y * height"), ("x3", "x * width"), ("y3", "(y * height + h * height)")))


@query("WITH " + BOX + f" SELECT image, serial::INTEGER AS serial, {_RC} FROM b")
def rect_controls(spark, sf_dir):
    return _flat(_rects(spark, sf_dir), "image", "serial")


_FLIP = {n: sql_uniform(n, "image") + " < 0.5" for n in ("hflip", "vflip", "transpose")}


@query("WITH " + BOX + f", f AS (SELECT *, {_FLIP['hflip']} AS fh, {_FLIP['vflip']} AS fv, {_FLIP['transpose']} AS ft, x * width AS px, y * height AS py, x * width + w * width AS qx, y * height + h * height AS qy FROM b), g AS (SELECT *, CASE WHEN fh THEN width - px ELSE px END AS ax, CASE WHEN fh THEN width - qx ELSE qx END AS bx, CASE WHEN fv THEN height - py ELSE py END AS ay, CASE WHEN fv THEN height - qy ELSE qy END AS by_ FROM f) SELECT image, serial::INTEGER AS serial, " + ", ".join(f"{sql_r6(f'CASE WHEN ft THEN {b_} ELSE {a} END')} AS {n}" for n, a, b_ in (("x0", "ax", "ay"), ("y0", "ay", "ax"), ("x1", "bx", "by_"), ("y1", "by_", "bx"), ("x2", "bx", "ay"), ("y2", "ay", "bx"), ("x3", "ax", "by_"), ("y3", "by_", "ax"))) + " FROM g")
def rect_flip(spark, sf_dir):
    flags = [uniform(n, F.col("image")) < 0.5 for n in ("hflip", "vflip", "transpose")]
    return _flat(_rects(spark, sf_dir).withColumn("c", S.flip(F.col("controls"), F.col("width"), F.col("height"), *flags)), "image", "serial", controls="c")


@query("WITH " + BOX + f""", f AS (SELECT *, cos(radians(a)) AS ca, sin(radians(a)) AS sa, width // 2 AS cx, height // 2 AS cy, x * width AS px, y * height AS py, x * width + w * width AS qx, y * height + h * height AS qy
  FROM (SELECT *, -30 + 60 * {sql_uniform('angle', 'image')} AS a FROM b)),
m AS (SELECT image, serial, [[px, py], [qx, qy], [qx, py], [px, qy]] AS c, ca, sa, cx, cy FROM f),
r AS (SELECT image, serial, list_transform(c, lambda p: ca * p[1] + sa * p[2] + (1 - ca) * cx - sa * cy) AS xs, list_transform(c, lambda p: ca * p[2] - sa * p[1] + sa * cx + (1 - ca) * cy) AS ys FROM m),
s AS (SELECT image, serial, list_min(xs) AS lx, list_max(xs) - list_min(xs) AS sx, list_min(ys) AS ly, list_max(ys) - list_min(ys) AS sy,
  sqrt((xs[3] - xs[1]) * (xs[3] - xs[1]) + (ys[3] - ys[1]) * (ys[3] - ys[1])) * sqrt((xs[4] - xs[1]) * (xs[4] - xs[1]) + (ys[4] - ys[1]) * (ys[4] - ys[1])) AS area FROM r),
z AS (SELECT *, sqrt((area + 1) / (sx * sy + 1)) AS rate FROM s)
SELECT image, serial::INTEGER AS serial, round(lx + sx / 2 - sx * rate / 2, 4) + 0.0::DOUBLE AS x, round(ly + sy / 2 - sy * rate / 2, 4) + 0.0::DOUBLE AS y, round(sx * rate, 4) + 0.0::DOUBLE AS w, round(sy * rate, 4) + 0.0::DOUBLE AS h FROM z""")
def rect_rotate_refit(spark, sf_dir):
    angle = -30 + 60 * uniform("angle", F.col("image"))
    turned = _rects(spark, sf_dir).withColumn("c", S.rotate(F.col("controls"), F.col("width"), F.col("height"), angle)).withColumn("c", S.refit_rect(F.col("c"))).withColumn("b", S.bbox(F.col("c")))
    return turned.select("image", "serial", *[(F.round(F.col(f"b.{c}"), 4) + F.lit(0.0)).alias(c) for c in "xywh"])


@query("WITH " + BOX + f" SELECT image, serial::INTEGER AS serial, {sql_r6('greatest(x * width, 10)')} AS x1, {sql_r6('greatest(y * height, 10)')} AS y1, {sql_r6('least((x + w) * width, 100)')} AS x2, {sql_r6('least((y + h) * height, 100)')} AS y2 FROM b WHERE least(x + w, 100.0::DOUBLE / width) > greatest(x, 10.0::DOUBLE / width) AND least(y + h, 100.0::DOUBLE / height) > greatest(y, 10.0::DOUBLE / height)")
def clip_boxes(spark, sf_dir):
    b = boxes(spark, sf_dir)
    lo = lambda s: F.lit(10.0) / F.col(s)
    hi = lambda s: F.lit(100.0) / F.col(s)
    inside = (F.least(F.col("x") + F.col("w"), hi("width")) > F.greatest(F.col("x"), lo("width"))) & (F.least(F.col("y") + F.col("h"), hi("height")) > F.greatest(F.col("y"), lo("height")))
    return b.where(inside).select("image", "serial", r6(F.greatest(F.col("x") * F.col("width"), F.lit(10.0))).alias("x1"), r6(F.greatest(F.col("y") * F.col("height"), F.lit(10.0))).alias("y1"), r6(F.least((F.col("x") + F.col("w")) * F.col("width"), F.lit(100.0))).alias("x2"), r6(F.least((F.col("y") + F.col("h")) * F.col("height"), F.lit(100.0))).alias("y2"))


@query("WITH " + PIC + " SELECT image, CASE WHEN greatest(width, height) > 160 THEN width * 160 // greatest(width, height) WHEN least(width, height) < 100 THEN width * 100 // least(width, height) ELSE width END AS w, CASE WHEN greatest(width, height) > 160 THEN height * 160 // greatest(width, height) WHEN least(width, height) < 100 THEN height * 100 // least(width, height) ELSE height END AS h FROM p")
def resize_limits(spark, sf_dir):
    w, h = Z.resize(F.col("width"), F.col("height"), 160, 100)
    return pictures(spark, sf_dir).select("image", w.alias("w"), h.alias("h"))


@query("WITH " + PIC + f" SELECT image, round(width * k)::BIGINT AS w, round(height * k)::BIGINT AS h FROM (SELECT *, 0.75::DOUBLE + (1.25::DOUBLE - 0.75::DOUBLE) * {sql_uniform('scale', 'image')} AS k FROM p)")
def augment_scale_sizes(spark, sf_dir):
    from samplery.functions.keys import between

    k = between("scale", 0.75, 1.25, F.col("image"))
    return pictures(spark, sf_dir).select("image", F.round(F.col("width") * k).cast("long").alias("w"), F.round(F.col("height") * k).cast("long").alias("h"))


_DRAW = {a: f"floor({sql_uniform('square.' + a, 'image')} * 1048576)::BIGINT" for a in "xy"}


@query("WITH " + PIC + f" SELECT image, CASE WHEN width >= 128 THEN {_DRAW['x']} % greatest(width - 128 + 1, 1) ELSE 0 END AS off_x, CASE WHEN width < 128 THEN {_DRAW['x']} % greatest(128 - width + 1, 1) ELSE 0 END AS pad_x, CASE WHEN height >= 128 THEN {_DRAW['y']} % greatest(height - 128 + 1, 1) ELSE 0 END AS off_y, CASE WHEN height < 128 THEN {_DRAW['y']} % greatest(128 - height + 1, 1) ELSE 0 END AS pad_y FROM p")
def random_square_clip_offsets(spark, sf_dir):
    x, px = Z.square_window(F.col("width"), 128, integer("square.x", 1 << 20, F.col("image")))
    y, py = Z.square_window(F.col("height"), 128, integer("square.y", 1 << 20, F.col("image")))
    return pictures(spark, sf_dir).select("image", x.alias("off_x"), px.alias("pad_x"), y.alias("off_y"), py.alias("pad_y"))


@query("WITH c AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY md5(concat_ws(':', '2016', 'pick', k::VARCHAR, vec_id::VARCHAR))) AS rn FROM embeddings, range(0, 5) x(k)) SELECT vec_id AS serial, list(k::INTEGER ORDER BY k)::VARCHAR AS chosen FROM c WHERE rn <= 2 GROUP BY vec_id")
def some_of_choice(spark, sf_dir):
    return embeddings(spark, sf_dir).select("serial", some_of(5, 2, "pick", SEED).alias("c")).select("serial", F.concat(F.lit("["), F.array_join("c", ", "), F.lit("]")).alias("chosen"))


_GRID = """g AS (SELECT *, greatest(width - 64, 0) AS sw, greatest(height - 64, 0) AS sh FROM p),
n AS (SELECT *, ceil(sw / 48)::BIGINT AS nx, ceil(sh / 48)::BIGINT AS ny FROM g),
s AS (SELECT *, CASE WHEN nx > 0 THEN 48 - (nx * 48 - sw) // nx ELSE 48 END AS stx, CASE WHEN ny > 0 THEN 48 - (ny * 48 - sh) // ny ELSE 48 END AS sty FROM n),
t AS (SELECT image, width, height, least(i * stx, sw)::BIGINT AS tile_x, least(j * sty, sh)::BIGINT AS tile_y, least(width, 64) AS tile_w, least(height, 64) AS tile_h FROM s, range(0, 8) a(i), range(0, 8) c(j) WHERE i <= nx AND j <= ny)"""


@query("WITH " + PIC + ", " + _GRID + " SELECT * FROM t")
def grid_tiles(spark, sf_dir):
    return D.grid_tiles(pictures(spark, sf_dir), 64, 48).select("image", "width", "height", "tile_x", "tile_y", "tile_w", "tile_h")


@query("WITH " + PIC + ", " + BOX + ", " + _GRID + f""", u AS (SELECT DISTINCT image, width, height, tile_x, tile_y, tile_x::DOUBLE / width AS zx, tile_y::DOUBLE / height AS zy, tile_w::DOUBLE / width AS zw, tile_h::DOUBLE / height AS zh FROM t)
SELECT u.image, tile_x, tile_y, serial::INTEGER AS serial, label, {sql_r6('(x - zx) / zw')} AS x, {sql_r6('(y - zy) / zh')} AS y, {sql_r6('w / zw')} AS w, {sql_r6('h / zh')} AS h
FROM u JOIN b ON u.image = b.image AND least(x + w, zx + zw) > greatest(x, zx) AND least(y + h, zy + zh) > greatest(y, zy)""")
def tile_shape_overlap(spark, sf_dir):
    found = D.tile_shapes(D.grid_tiles(pictures(spark, sf_dir), 64, 48), boxes(spark, sf_dir))
    return found.select("image", "tile_x", "tile_y", "serial", "label", *[r6(F.col(c)).alias(c) for c in "xywh"])


@query("WITH " + BOX + ", c AS (SELECT image, serial, greatest(floor(x * width), 0)::BIGINT AS crop_x, greatest(floor(y * height), 0)::BIGINT AS crop_y, least(floor((x + w) * width), width)::BIGINT AS x1, least(floor((y + h) * height), height)::BIGINT AS y1 FROM b) SELECT image, serial::INTEGER AS serial, crop_x, crop_y, x1 - crop_x AS crop_w, y1 - crop_y AS crop_h FROM c WHERE x1 > crop_x AND y1 > crop_y")
def crop_per_shape(spark, sf_dir):
    return D.crop_boxes(boxes(spark, sf_dir)).select("image", "serial", "crop_x", "crop_y", "crop_w", "crop_h")


@query("WITH " + BOX + " SELECT image, serial::INTEGER AS serial, " + ", ".join(f"{sql_r6(e)} AS {n}" for n, e in (("x0", "(x - 0.25::DOUBLE) / 0.5::DOUBLE"), ("y0", "(y - 0.1::DOUBLE) / 0.8::DOUBLE"), ("x1", "((x + w) - 0.25::DOUBLE) / 0.5::DOUBLE"), ("y1", "((y + h) - 0.1::DOUBLE) / 0.8::DOUBLE"), ("x2", "((x + w) - 0.25::DOUBLE) / 0.5::DOUBLE"), ("y2", "(y - 0.1::DOUBLE) / 0.8::DOUBLE"), ("x3", "(x - 0.25::DOUBLE) / 0.5::DOUBLE"), ("y3", "((y + h) - 0.1::DOUBLE) / 0.8::DOUBLE"))) + " FROM b")
def rezoom_shapes(spark, sf_dir):
    return _flat(_rects(spark, sf_dir, False).withColumn("c", D.rezoom(F.col("controls"), F.lit(0.25), F.lit(0.1), F.lit(0.5), F.lit(0.8))), "image", "serial", controls="c")


@query("WITH " + BOX + f" SELECT image, serial::INTEGER AS serial, CASE WHEN label % 2 = 0 THEN 'ellipse' ELSE 'rect' END AS type, CASE WHEN label % 2 = 0 THEN {sql_r6('x - 6.0::DOUBLE / width')} ELSE {sql_r6('x')} END AS x, CASE WHEN label % 2 = 0 THEN {sql_r6('6.0::DOUBLE / width * 2')} ELSE {sql_r6('w')} END AS w FROM b")
def point_to_ellipse(spark, sf_dir):
    kind = F.when(F.col("label") % 2 == 0, "point").otherwise("rect")
    note = F.to_json(F.struct(F.array(F.struct(kind.alias("type"), F.struct("x", "y", F.when(kind == "rect", F.col("w")).alias("width"), F.when(kind == "rect", F.col("h")).alias("height")).alias("geometry"))).alias("shapes")))
    turned = boxes(spark, sf_dir).withColumn("note", note).select("image", "serial", D.point_to_ellipse(F.col("note"), F.col("width"), F.col("height"), 6.0)[0].alias("s"))
    return turned.select("image", "serial", F.col("s.type").alias("type"), r6(F.col("s.geometry.x")).alias("x"), r6(F.col("s.geometry.width")).alias("w"))


@query("WITH " + BOX + """, s AS (SELECT image, serial, x, y, w, h, width, height, 48.0::DOUBLE / sqrt(w * h * width * height) AS scale FROM b WHERE w > 0 AND h > 0),
f AS (SELECT *, round(width * scale)::BIGINT AS fw, round(height * scale)::BIGINT AS fh FROM s),
o AS (SELECT *, floor(x * fw)::BIGINT AS ax, floor(w * fw)::BIGINT AS ow, floor(y * fh)::BIGINT AS ay, floor(h * fh)::BIGINT AS oh FROM f),
m AS (SELECT *, greatest(64 - ow, 0) AS mw, greatest(64 - oh, 0) AS mh FROM o),
l AS (SELECT *, least(ow + mw, fw) AS patch_w, least(oh + mh, fh) AS patch_h FROM m)
SELECT image, serial::INTEGER AS serial, """ + sql_r6("scale") + " AS scale, greatest(0, least(ax - mw // 2, fw - patch_w)) AS patch_x, greatest(0, least(ay - mh // 2, fh - patch_h)) AS patch_y, patch_w, patch_h FROM l")
def split_region(spark, sf_dir):
    return D.region_patch(boxes(spark, sf_dir), 48, 64).select("image", "serial", r6(F.col("scale")).alias("scale"), "patch_x", "patch_y", "patch_w", "patch_h")


# --- targets


def _anchor_sql(score: str, params: str, upper: float = 0.6, lower: float = 0.4, d: int = 16, weight: str = "1.0::DOUBLE", extra: str = "") -> str:
    return f"""WITH {BOX}, {PIC},
c AS (SELECT image, cy, cx, (cx * {d})::DOUBLE AS px, (cy * {d})::DOUBLE AS py FROM p, range(0, 16) a(cx), range(0, 16) q(cy) WHERE cx < width // {d} AND cy < height // {d}),
t AS (SELECT image, serial, x * width AS bx, y * height AS by_, w * width AS bw, h * height AS bh FROM b WHERE w * width > 0 AND h * height > 0),
m AS (SELECT c.*, serial, bw, bh, bx + bw / 2 - px AS dx, by_ + bh / 2 - py AS dy FROM c LEFT JOIN t ON c.image = t.image),
s AS (SELECT *, {score} AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY image, cy, cx ORDER BY CASE WHEN score > 0 AND score >= {lower} THEN score END DESC NULLS LAST, serial) AS rn, coalesce(score > 0 AND score >= {lower}, false) AS ok FROM s)
SELECT image, cy, cx, CASE WHEN ok AND score >= {upper} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, CASE WHEN ok AND score < {upper} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label_mask,
{params}, CASE WHEN ok THEN {sql_r6(weight)} ELSE 0.0::DOUBLE END AS params_mask FROM r WHERE rn = 1"""


def _anchor_params(*names: str) -> str:
    return ", ".join(f"CASE WHEN ok THEN {sql_r6(e)} ELSE 0.0::DOUBLE END AS p{k}" for k, e in enumerate(names))


def _anchors(spark, sf_dir, kind, n, **options):
    truth = boxes(spark, sf_dir)
    truth = truth.drop("w", "h").withColumns({"w": F.lit(None).cast("double"), "h": F.lit(0.0)}) if kind == "point" else truth
    found = A.dense_anchors(pictures(spark, sf_dir), truth, kind=kind, downsize=16, **options)
    return found.select("image", "cy", "cx", "label", "label_mask", *[r6(F.col("params")[k]).alias(f"p{k}") for k in range(n)], r6(F.col("params_mask")).alias("params_mask"))


@query(_anchor_sql("least((bw - 2 * abs(dx)) / bw, (bh - 2 * abs(dy)) / bh)", _anchor_params("dx", "dy", "bw", "bh")))
def dense_anchor_box(spark, sf_dir):
    return _anchors(spark, sf_dir, "box", 4)


@query(_anchor_sql("(sqrt(bw * bh) / 2 - sqrt(dx * dx + dy * dy)) / (sqrt(bw * bh) / 2)", _anchor_params("dx", "dy", "sqrt(bw * bh) / 2"), weight="1 / ((sqrt(bw * bh) / 2) * (sqrt(bw * bh) / 2))"))
def dense_anchor_circle(spark, sf_dir):
    return _anchors(spark, sf_dir, "circle", 3, weighted=True)


@query(_anchor_sql("exp(-sqrt(dx * dx + dy * dy))", _anchor_params("dx", "dy"), upper=0.2, lower=0.02).replace("w * width AS bw, h * height AS bh FROM b WHERE w * width > 0 AND h * height > 0", "0.0::DOUBLE AS bw, 0.0::DOUBLE AS bh FROM b"))
def dense_anchor_point(spark, sf_dir):
    return _anchors(spark, sf_dir, "point", 2, upper=0.2, lower=0.02)


_BF = {"x1": "greatest(0.0::DOUBLE, least(x * width, width - 1.0::DOUBLE))", "y1": "greatest(0.0::DOUBLE, least(y * height, height - 1.0::DOUBLE))", "x2": "greatest(0.0::DOUBLE, least((x + w) * width, width - 1.0::DOUBLE))", "y2": "greatest(0.0::DOUBLE, least((y + h) * height, height - 1.0::DOUBLE))"}


@query("WITH " + BOX + ", c AS (SELECT image, serial, label::DOUBLE AS label, " + ", ".join(f"{e} AS {n}" for n, e in _BF.items()) + f" FROM b) SELECT image, serial::INTEGER AS serial, label, 0.0::DOUBLE AS tag, {', '.join(f'{sql_r6(n)} AS {n}' for n in _BF)} FROM c WHERE (x2 - x1 + 1) * (y2 - y1 + 1) >= 400")
def box_feature(spark, sf_dir):
    return A.box_feature(boxes(spark, sf_dir), 400.0).select("image", "serial", "label", "tag", *[r6(F.col(c)).alias(c) for c in _BF])


@query("WITH " + BOX + ", " + PIC + f""", c AS (SELECT image, cy, cx, (cx * 8)::DOUBLE AS px, (cy * 8)::DOUBLE AS py FROM p, range(0, 32) a(cx), range(0, 32) q(cy) WHERE cx < width // 8 AND cy < height // 8),
k AS (SELECT image, serial, label - 1 AS class, (x + w / 2) * width AS kx, (y + h / 2) * height AS ky FROM b WHERE label BETWEEN 1 AND 3),
m AS (SELECT c.image, cy, cx, class, serial, kx - px AS dx, ky - py AS dy FROM c JOIN k ON c.image = k.image),
r AS (SELECT *, row_number() OVER (PARTITION BY image, cy, cx, class ORDER BY serial DESC) AS rn FROM m WHERE sqrt(dx * dx + dy * dy) <= 10)
SELECT image, cy, cx, class, 1.0::DOUBLE AS mask, {sql_r6('dx')} AS dx, {sql_r6('dy')} AS dy FROM r WHERE rn = 1""")
def keypoints(spark, sf_dir):
    points = boxes(spark, sf_dir).select("image", "serial", "label", ((F.col("x") + F.col("w") / 2) * F.col("width")).alias("kx"), ((F.col("y") + F.col("h") / 2) * F.col("height")).alias("ky"))
    return A.keypoints(pictures(spark, sf_dir), points, 3, 8, 10.0).select("image", "cy", "cx", "class", "mask", r6(F.col("dx")).alias("dx"), r6(F.col("dy")).alias("dy"))


def _proposals(spark, sf_dir):
    """Every box as a proposal of its cell, with a chance from its own numbers."""
    b = boxes(spark, sf_dir)
    cell = lambda a, d, s: F.floor((F.col(a) + F.col(d) / 2) * F.col(s) / 8).cast("long")
    return b.select("image", cell("y", "h", "height").alias("cy"), cell("x", "w", "width").alias("cx"), F.col("serial").alias("prior"), ((F.col("label") * 13 + F.col("serial") * 7) % 10 / 10).alias("prob"), F.array(F.lit(1.0), F.lit(-1.0), F.col("w") * F.col("width"), F.col("h") * F.col("height")).alias("params"))


_PROPOSE = "q AS (SELECT image, floor((y + h / 2) * height / 8)::BIGINT AS cy, floor((x + w / 2) * width / 8)::BIGINT AS cx, serial AS prior, (label * 13 + serial * 7) % 10 / 10 AS prob, w * width AS pw, h * height AS ph FROM b)"


@query("WITH " + BOX + ", " + _PROPOSE + f" SELECT image, cy, cx, prior::INTEGER AS prior, {sql_r6('cx * 8 + 1.0::DOUBLE - pw / 2')} AS x1, {sql_r6('cy * 8 - 1.0::DOUBLE - ph / 2')} AS y1, {sql_r6('cx * 8 + 1.0::DOUBLE + pw / 2')} AS x2, {sql_r6('cy * 8 - 1.0::DOUBLE + ph / 2')} AS y2 FROM q WHERE prob >= 0.5")
def proposal_decode(spark, sf_dir):
    return A.decode_proposals(_proposals(spark, sf_dir), 0.5, 8).select("image", "cy", "cx", "prior", *[r6(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")])


def _nms_sql(fields: str, shape: str, overlap: str) -> str:
    """Proposals of an image one after another, each against those kept so far."""
    new = "{" + ", ".join(f"'{f}': {f}" for f in shape.split()) + "}"
    return f"""WITH RECURSIVE {BOX[1:]}, {_PROPOSE},
p AS (SELECT image, cy, cx, prior, prob, cx * 8 + 1.0::DOUBLE - pw / 2 AS x1, cy * 8 - 1.0::DOUBLE - ph / 2 AS y1, cx * 8 + 1.0::DOUBLE + pw / 2 AS x2, cy * 8 - 1.0::DOUBLE + ph / 2 AS y2 FROM q WHERE prob >= 0.3),
v AS (SELECT image, cy, cx, prior, prob, {fields} FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY prob DESC, cy, cx, prior) AS rn FROM v),
f(image, rn, kept, hit) AS (
  SELECT image, rn, [{new}], false FROM s WHERE rn = 1
  UNION ALL
  SELECT image, rn, CASE WHEN hit THEN kept ELSE list_append(kept, {new}) END, hit
  FROM (SELECT s.*, f.kept, len(list_filter(f.kept, lambda k: {overlap} > 0.3::DOUBLE)) > 0 AS hit FROM f JOIN s ON s.image = f.image AND s.rn = f.rn + 1))
SELECT s.image, cy, cx, prior::INTEGER AS prior, prob, {', '.join(f'{sql_r6(f)} AS {f}' for f in shape.split())} FROM s JOIN f ON s.image = f.image AND s.rn = f.rn WHERE NOT hit"""


_INTER = "(greatest(0.0::DOUBLE, least(k.x2, s.x2) - greatest(k.x1, s.x1)) * greatest(0.0::DOUBLE, least(k.y2, s.y2) - greatest(k.y1, s.y1)))"
_FAR = "(greatest(k.r, s.r) + 1)"


@query(_nms_sql("x1, y1, x2, y2", "x1 y1 x2 y2", f"{_INTER} / ((k.x2 - k.x1) * (k.y2 - k.y1) + (s.x2 - s.x1) * (s.y2 - s.y1) - {_INTER} + 1)"))
def nms_box(spark, sf_dir):
    kept = A.suppress(A.decode_proposals(_proposals(spark, sf_dir), 0.3, 8), 0.3)
    return kept.select("image", "cy", "cx", "prior", "prob", *[r6(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(_nms_sql("(x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, sqrt((x2 - x1) * (y2 - y1)) / 2 AS r", "x y r", f"({_FAR} - sqrt((k.x - s.x) * (k.x - s.x) + (k.y - s.y) * (k.y - s.y))) / {_FAR}"))
def nms_circle(spark, sf_dir):
    p = A.decode_proposals(_proposals(spark, sf_dir), 0.3, 8)
    circles = p.select("image", "cy", "cx", "prior", "prob", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), (F.sqrt((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))) / 2).alias("r"))
    return A.suppress(circles, 0.3, circles=True).select("image", "cy", "cx", "prior", "prob", *[r6(F.col(c)).alias(c) for c in "xyr"])


# --- images


def _image_sql(value: str, n: int = 64) -> str:
    return f"SELECT vec_id AS id, i::INTEGER AS i, {value} AS v FROM embeddings, range(0, {n}) x(i)"


def _pixels(spark, sf_dir, make, digits: int = 6):
    e = embeddings(spark, sf_dir, True)
    out = e.select("id", F.posexplode(make(F.col("embedding"))).alias("i", "v"))
    return out.select("id", "i", (F.round(F.col("v").cast("double"), digits) + F.lit(0.0)).alias("v"))


def _v(e: str) -> str:
    return f"round(({e})::DOUBLE, 6) + 0.0::DOUBLE"


@query(_image_sql(_v("embedding[(i // 8) * 8 + (7 - i % 8) + 1]")))
def image_hflip(spark, sf_dir):
    return _pixels(spark, sf_dir, lambda e: I.hflip(e, 8, 8))


@query(_image_sql(_v("embedding[(i % 8) * 8 + i // 8 + 1]")))
def image_transpose(spark, sf_dir):
    return _pixels(spark, sf_dir, lambda e: I.transpose(e, 8, 8))


@query(_image_sql(f"CASE WHEN i % 10 < 8 AND i // 10 < 8 THEN {_v('embedding[(i // 10) * 8 + i % 10 + 1]')} ELSE 0.0::DOUBLE END", 120))
def image_pad(spark, sf_dir):
    return _pixels(spark, sf_dir, lambda e: I.pad(e, 8, 8, 10, 12))


@query(_image_sql(_v("(embedding[i + 1]::DOUBLE - [0.1::DOUBLE, -0.2::DOUBLE][i % 2 + 1]) / [0.5::DOUBLE, 2.0::DOUBLE][i % 2 + 1]")))
def image_normalize(spark, sf_dir):
    return _pixels(spark, sf_dir, lambda e: I.normalize(e, [0.1, -0.2], [0.5, 2.0]))


@query(_image_sql(_v(f"embedding[i + 1]::DOUBLE + (-0.5::DOUBLE + (0.5::DOUBLE - -0.5::DOUBLE) * {sql_uniform('add', 'vec_id')})")))
def image_add(spark, sf_dir):
    from samplery.functions.keys import between

    return _pixels(spark, sf_dir, lambda e: I.add(e, between("add", -0.5, 0.5, F.col("id"))))


@query("SELECT vec_id AS id, i::INTEGER AS i, " + _v("list_min([CASE WHEN " + " ELSE 1.0::DOUBLE END, CASE WHEN ".join(f"i % 8 + {dx} >= 0 AND i % 8 + {dx} < 8 AND i // 8 + {dy} >= 0 AND i // 8 + {dy} < 8 THEN embedding[(i // 8 + {dy}) * 8 + i % 8 + {dx} + 1]::DOUBLE" for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + " ELSE 1.0::DOUBLE END])") + " AS v FROM embeddings, range(0, 64) x(i)")
def image_erode(spark, sf_dir):
    return _pixels(spark, sf_dir, lambda e: I.erode(e, 8, 8, 1))


@query("SELECT vec_id AS id, min(i % 8)::INTEGER AS x0, max(i % 8)::INTEGER AS x1, min(i // 8)::INTEGER AS y0, max(i // 8)::INTEGER AS y1 FROM embeddings, range(0, 64) x(i) WHERE embedding[i + 1] > 0.2::FLOAT GROUP BY vec_id")
def foreground_bounds(spark, sf_dir):
    above = F.transform("embedding", lambda v: F.when(v > F.lit(0.2).cast("float"), 1).otherwise(0))
    return embeddings(spark, sf_dir, True).select("id", I.foreground(above, 8).alias("f")).select("id", "f.*").where("x0 is not null")


@query("SELECT vec_id AS id, i::INTEGER AS i, CASE WHEN label = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM embeddings, range(0, 10) x(i)")
def one_hot(spark, sf_dir):
    return embeddings(spark, sf_dir).select("id", F.posexplode(I.one_hot(F.col("label"), 10)).alias("i", "v"))


@query("""SELECT vec_id AS id, coalesce([[0,0,0],[31,119,180],[174,199,232],[255,127,14],[255,187,120],[44,160,44],[152,223,138],[214,39,40],[255,152,150],[148,103,189],[197,176,213],
[140,86,75],[196,156,148],[227,119,194],[247,182,210],[127,127,127],[199,199,199],[188,189,34],[219,219,141],[23,190,207],[158,218,229]][label * 3 + 1], [0,0,0])::INTEGER[]::VARCHAR AS plain,
coalesce([[0,0,0],[188,189,34],[219,219,141],[23,190,207],[158,218,229],[44,160,44],[152,223,138],[214,39,40],[255,152,150],[31,119,180],[174,199,232],
[255,127,14],[255,187,120],[227,119,194],[247,182,210],[127,127,127],[199,199,199],[148,103,189],[197,176,213],[140,86,75],[196,156,148]][label * 3 + 1], [0,0,0])::INTEGER[]::VARCHAR AS other FROM embeddings""")
def palette_lookup(spark, sf_dir):
    text = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    return embeddings(spark, sf_dir).select("id", text(I.palette(F.col("label") * 3)).alias("plain"), text(I.palette(F.col("label") * 3, "tableau20a")).alias("other"))


@query(_image_sql(_v("embedding[(i % 16) * 4 + (3 - i // 16) + 1]")))
def batch_layout_nchw(spark, sf_dir):
    return _pixels(spark, sf_dir, lambda e: I.planes(e, 16, 4, reverse=True))


@query(_BALANCED + " SELECT draw // 32 AS batch, count(*)::INTEGER AS n, list(serial ORDER BY draw)::VARCHAR AS ids, list(grp ORDER BY draw)::VARCHAR AS labels FROM o GROUP BY 1")
def batch_meta(spark, sf_dir):
    plan = M.draw_order(embeddings(spark, sf_dir), _TRAIN)
    text = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    return M.batches(plan, 32, ("serial", "label")).select("batch", F.col("rows").alias("n"), text("serial").alias("ids"), text("label").alias("labels"))


@query("WITH " + BOX + " SELECT image, serial::INTEGER AS serial, concat_ws(' ', label, round(x * width)::BIGINT, round(y * height)::BIGINT, round(w * width)::BIGINT, round(h * height)::BIGINT) AS line FROM b")
def yolo_lines(spark, sf_dir):
    return boxes(spark, sf_dir).select("image", "serial", exports.yolo_line(*[F.col(c) for c in ("label", "x", "y", "w", "h", "width", "height")]).alias("line"))


def _bilinear(border: str = "replicate") -> str:
    """Value at (sx, sy) of the 8 x 8 image ``e``, whose pixel (x0, y0) lies before it."""
    terms = []
    for dy in (0, 1):
        for dx in (0, 1):
            term = f"e[least(greatest(y0 + {dy}, 0), 7) * 8 + least(greatest(x0 + {dx}, 0), 7) + 1] * (abs(1 - {dy} - (sy - y0)) * abs(1 - {dx} - (sx - x0)))"
            terms.append(term if border == "replicate" else f"CASE WHEN y0 + {dy} BETWEEN 0 AND 7 AND x0 + {dx} BETWEEN 0 AND 7 THEN {term} ELSE 0.0::DOUBLE END")
    return " + ".join(terms)


def _scaled(place: str, n: str) -> str:
    """Source place of a pixel when 8 pixels become ``n``: centres lie at half pixels, and edges go on."""
    return f"least(greatest(({place} + 0.5::DOUBLE) * 8 / {n} - 0.5::DOUBLE, 0), 7)"


def _blurred(border: str) -> str:
    """Gaussian of sigma 1 over 3 x 3 pixels at (x, y)."""
    weight, total = "exp(-(a * a + b * b) / 2.0::DOUBLE)", "(1 + 2 * exp(-0.5::DOUBLE)) * (1 + 2 * exp(-0.5::DOUBLE))"
    if border == "constant":
        value = "CASE WHEN x + a BETWEEN 0 AND 7 AND y + b BETWEEN 0 AND 7 THEN e[(y + b) * 8 + x + a + 1] ELSE 0.0::DOUBLE END"
    else:  # mirrored
        at = lambda p: f"CASE WHEN {p} < 0 THEN -({p}) WHEN {p} > 7 THEN 14 - ({p}) ELSE {p} END"
        value = f"e[({at('y + b')}) * 8 + ({at('x + a')}) + 1]"
    return f"list_sum(list_transform([-1, 0, 1], lambda b: list_sum(list_transform([-1, 0, 1], lambda a: {weight} / ({total}) * {value}))))"


def _warp_sql(sx: str, sy: str, w: int, n: int, border: str) -> str:
    return f"""WITH g AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, i, i % {w} AS x, i // {w} AS y FROM embeddings, range(0, {n}) t(i)),
m AS (SELECT *, {sx} AS sx, {sy} AS sy FROM g), k AS (SELECT *, floor(sx)::BIGINT AS x0, floor(sy)::BIGINT AS y0 FROM m)
SELECT id, i::INTEGER AS i, {sql_r6(_bilinear(border))} AS v FROM k"""


@query(_warp_sql(_scaled("x", "12"), _scaled("y", "6"), 12, 72, "replicate"))
def image_resize(spark, sf_dir):
    return _pixels(spark, sf_dir, P.resizer(spark, 8, 8, 12, 6))


@query(_warp_sql("cos(radians(30)) * (x - 4) - sin(radians(30)) * (y - 4) + 4", "sin(radians(30)) * (x - 4) + cos(radians(30)) * (y - 4) + 4", 8, 64, "constant"))
def image_rotate(spark, sf_dir):
    return _pixels(spark, sf_dir, P.rotator(spark, 8, 8, 30.0))


@query("WITH g AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, i, i % 8 AS x, i // 8 AS y FROM embeddings, range(0, 64) t(i)) SELECT id, i::INTEGER AS i, " + sql_r6(_blurred("reflect")) + " AS v FROM g")
def image_blur(spark, sf_dir):
    return _pixels(spark, sf_dir, P.blurrer(spark, 8, 8, 1.0))


@query("WITH " + BOX + """, c AS (SELECT image, serial, label, x * width / width * 16 AS ax, (x * width + w * width) / width * 16 AS bx, y * height / height * 16 AS ay, (y * height + h * height) / height * 16 AS by_ FROM b),
t AS (SELECT image, i, max_by(label, serial) AS v FROM c, range(0, 256) p(i) WHERE i % 16 + 0.5 >= ax AND i % 16 + 0.5 < bx AND i // 16 + 0.5 >= ay AND i // 16 + 0.5 < by_ GROUP BY image, i),
d AS (SELECT image, count(*) AS filled, sum(v)::DOUBLE AS total, sum(v * (i + 1))::DOUBLE AS weighted, sum(v * (i + 1) * (i + 1))::DOUBLE AS squares FROM t GROUP BY image)
SELECT image, coalesce(filled, 0)::BIGINT AS filled, coalesce(total, 0) AS total, coalesce(weighted, 0) AS weighted, coalesce(squares, 0) AS squares FROM (SELECT DISTINCT image FROM b) LEFT JOIN d USING (image)""")
def rasterize_polygon(spark, sf_dir):
    """Each image's boxes as polygons on 16 x 16 pixels, as moments of the drawn mask."""
    ring = F.transform(F.array(F.col("controls")[0], F.col("controls")[2], F.col("controls")[1], F.col("controls")[3]), lambda p: S.point(p["x"] / F.col("width") * 16, p["y"] / F.col("height") * 16))
    drawn = _rects(spark, sf_dir).withColumn("ring", ring).groupBy("image").agg(F.sort_array(F.collect_list(F.struct("serial", "ring", F.col("label").cast("double").alias("v")))).alias("s"))
    masks = drawn.select("image", P.rasterize(spark, 16, 16)(F.transform("s", lambda x: x["ring"]), F.transform("s", lambda x: x["v"])).alias("m"))
    moment = lambda power: F.aggregate(F.transform("m", lambda v, i: v * F.pow(i + 1, F.lit(power))), F.lit(0.0), lambda a, v: a + v)
    return masks.select("image", F.size(F.filter("m", lambda v: v > 0)).cast("long").alias("filled"), *[moment(k).alias(n) for k, n in enumerate(("total", "weighted", "squares"))])


_LAB = """f AS (SELECT *, CASE WHEN b > 0.04045 THEN pow((b + 0.055) / 1.055, 2.4) ELSE b / 12.92 END AS lb, CASE WHEN g > 0.04045 THEN pow((g + 0.055) / 1.055, 2.4) ELSE g / 12.92 END AS lg, CASE WHEN r > 0.04045 THEN pow((r + 0.055) / 1.055, 2.4) ELSE r / 12.92 END AS lr FROM c),
z AS (SELECT *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 AS xx, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb AS yy, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS zz FROM f),
y AS (SELECT *, CASE WHEN xx > 0.008856 THEN pow(xx, 1.0::DOUBLE / 3) ELSE 7.787 * xx + 16.0::DOUBLE / 116 END AS fx, CASE WHEN yy > 0.008856 THEN pow(yy, 1.0::DOUBLE / 3) ELSE 7.787 * yy + 16.0::DOUBLE / 116 END AS fy, CASE WHEN zz > 0.008856 THEN pow(zz, 1.0::DOUBLE / 3) ELSE 7.787 * zz + 16.0::DOUBLE / 116 END AS fz FROM z)"""


@query("WITH e AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda v: abs(v) % 1) AS u FROM embeddings), c AS (SELECT id, k, u[k + 1] AS b, u[k + 2] AS g, u[k + 3] AS r, greatest(u[k + 1], u[k + 2], u[k + 3]) AS v, greatest(u[k + 1], u[k + 2], u[k + 3]) - least(u[k + 1], u[k + 2], u[k + 3]) AS d FROM e, range(0, 62) t(k)), " + _LAB + f"""
SELECT id, k::INTEGER AS k, {sql_r6("0.114 * b + 0.587 * g + 0.299 * r")} AS grey,
  {sql_r6("CASE WHEN d = 0 THEN 0 WHEN v = r THEN (60 * (g - b) / d + 360) % 360 WHEN v = g THEN 120 + 60 * (b - r) / d ELSE 240 + 60 * (r - g) / d END")} AS hue, {sql_r6("CASE WHEN v = 0 THEN 0 ELSE d / v END")} AS saturation, {sql_r6("v")} AS value,
  {sql_r6("CASE WHEN yy > 0.008856 THEN 116 * fy - 16 ELSE 903.3 * yy END")} AS l, {sql_r6("500 * (fx - fy)")} AS a, {sql_r6("200 * (fy - fz)")} AS lab_b, true AS back FROM y""")
def colorspace_roundtrip(spark, sf_dir):
    """Every three neighbours of a vector as a pixel: in grey, HSV and Lab, and whether the way back gives it again."""
    unit = embeddings(spark, sf_dir, True).select("id", F.transform("embedding", lambda x: F.abs(x.cast("double")) % 1).alias("u"))
    bgr = unit.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(61)), lambda k: F.struct(*[F.get("u", k + j).alias(c) for j, c in enumerate("bgr")]))).alias("k", "p")).select("id", "k", "p.*")
    three = [F.col(c) for c in "bgr"]
    both = bgr.withColumn("hsv", P.to_hsv(*three)).withColumn("lab", P.to_lab(*three)).withColumn("one", P.from_hsv(F.col("hsv"))).withColumn("two", P.from_lab(F.col("lab")))
    error = F.greatest(*[F.abs(F.col(c) - F.col(f"one.{c}")) for c in "bgr"], *[F.abs(F.col(c) - F.col(f"two.{c}")) / 1000 for c in "bgr"])
    named = {"grey": P.grey(*three), "hue": F.col("hsv.h"), "saturation": F.col("hsv.s"), "value": F.col("hsv.v"), "l": F.col("lab.l"), "a": F.col("lab.a"), "lab_b": F.col("lab.b")}
    return both.select("id", "k", *[r6(c).alias(n) for n, c in named.items()], (error < 1e-5).alias("back"))


# --- further sizes, fields and plans

_DRAWS = {k: f"floor({sql_uniform('clip.' + k, 'image')} * {n})::BIGINT" for k, n in (("c1", 20), ("c2", 20), ("sh", 13), ("r", 1048576))}


@query("WITH " + PIC + f""", a AS (SELECT image, width AS s, {_DRAWS['c1']} AS k1, {_DRAWS['c2']} AS k2, {_DRAWS['sh']} - 6 AS t, {_DRAWS['r']} AS r FROM p),
b AS (SELECT *, greatest(s, 100) AS e0, greatest(k1 + k2 - (greatest(s, 100) - 100), 0) AS lack FROM a),
b2 AS (SELECT *, CASE WHEN lack // 2 > k1 THEN k1 WHEN lack - lack // 2 > k2 THEN lack - k2 ELSE lack // 2 END AS give FROM b),
c AS (SELECT *, k1 - give AS c1, k2 - (lack - give) AS c2 FROM b2),
d AS (SELECT *, CASE WHEN e0 - c1 - c2 > 200 THEN 200 + c1 + c2 ELSE e0 END AS e1 FROM c),
f AS (SELECT *, e1 - (e1 - c1 - c2) % 8 - c1 - c2 AS out, c1 + greatest(t, 0) AS beg, greatest(s - c1 - c2 - greatest(t, 0), 0) AS len, greatest(-t, 0) AS dst FROM d),
g AS (SELECT *, greatest(out - dst, 0) AS room FROM f),
h AS (SELECT *, greatest(room - len, 0) AS pad, greatest(len - room, 0) AS cut FROM g),
i AS (SELECT *, CASE WHEN pad > 0 AND beg = 0 THEN dst + r % greatest(pad, 1) ELSE dst END AS dst2, CASE WHEN cut > 0 AND dst = 0 THEN beg + r % greatest(cut, 1) ELSE beg END AS beg2 FROM h)
SELECT image, out AS size, beg2 AS begin_at, least(len, room) AS length, dst2 AS to_at, dst2 - beg2 AS move FROM i""")
def clip_axis(spark, sf_dir):
    i = lambda k, n: integer(f"clip.{k}", n, F.col("image"))
    drawn = pictures(spark, sf_dir).withColumns({"c1": i("c1", 20), "c2": i("c2", 20), "shift": i("sh", 13) - 6, "place": i("r", 1 << 20)})
    own = Z.clip_axis(drawn, "x_", F.col("width"), F.col("c1"), F.col("c2"), 100, 200, 8, F.col("shift"), F.col("place"))
    return own.select("image", *[F.col(f"x_{k}").cast("long").alias(n) for k, n in (("size", "size"), ("begin", "begin_at"), ("length", "length"), ("to", "to_at"), ("move", "move"))])


@query("WITH " + PIC + " SELECT image, least(width, height) AS side, CASE WHEN width > height THEN greatest(0, least((width - height) // 2 + 5, width - height)) ELSE 0 END AS x, CASE WHEN height > width THEN greatest(0, least((height - width) // 2 + 5, height - width)) ELSE 0 END AS y FROM p")
def clip_square(spark, sf_dir):
    side, x, y = Z.clip_square(F.col("width"), F.col("height"), F.lit(5))
    return pictures(spark, sf_dir).select("image", side.alias("side"), x.alias("x"), y.alias("y"))


@query("WITH " + PIC + """, a AS (SELECT *, CASE WHEN greatest(width, height) > 150 THEN width * 150 // greatest(width, height) ELSE width END AS w1, CASE WHEN greatest(width, height) > 150 THEN height * 150 // greatest(width, height) ELSE height END AS h1 FROM p)
SELECT image, CASE WHEN greatest(width, height) > 120 THEN width * 120 // greatest(width, height) ELSE width END AS down_w, CASE WHEN least(w1, h1) < 60 THEN w1 * 60 // least(w1, h1) ELSE w1 END AS limit_w, CASE WHEN least(w1, h1) < 60 THEN h1 * 60 // least(w1, h1) ELSE h1 END AS limit_h,
CASE WHEN least(width, height) > 90 THEN width * 90 // least(width, height) ELSE width END AS import_w, CASE WHEN (width // 48) * 48 + 7 > width THEN (width // 48) * 48 + 7 - 48 ELSE (width // 48) * 48 + 7 END AS round_w FROM a""")
def legacy_sizes(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    lw, lh = Z.limit(w, h, 150, 60)
    return pictures(spark, sf_dir).select("image", Z.downsize(w, h, 120)[0].alias("down_w"), lw.alias("limit_w"), lh.alias("limit_h"), Z.import_limit(w, h, 90)[0].alias("import_w"), Z.round_size(w, 48, 7).alias("round_w"))


@query("WITH " + BOX + """, k AS (SELECT image, serial, width, height, floor(x * width)::BIGINT AS bx, floor(y * height)::BIGINT AS by_, ceil(w * width)::BIGINT AS bw, ceil(h * height)::BIGINT AS bh FROM b),
r AS (SELECT *, sqrt(bw * bh / (0.2::DOUBLE * width * height)) AS rate, bw * bh > 0 AND bw * bh < 0.2::DOUBLE * width * height AS small FROM k),
v AS (SELECT *, round(width * rate)::BIGINT AS ww, round(height * rate)::BIGINT AS wh FROM r)
SELECT image, serial::INTEGER AS serial, CASE WHEN small THEN greatest(0, least(bx - floor((ww - bw) / 2)::BIGINT, width - ww)) ELSE 0 END AS x, CASE WHEN small THEN greatest(0, least(by_ - floor((wh - bh) / 2)::BIGINT, height - wh)) ELSE 0 END AS y, CASE WHEN small THEN ww ELSE width END AS w, CASE WHEN small THEN wh ELSE height END AS h FROM v""")
def annotation_zoom(spark, sf_dir):
    px = lambda f, c, s: f(F.col(c) * F.col(s)).cast("long")
    z = Z.annotation_zoom(F.col("width"), F.col("height"), px(F.floor, "x", "width"), px(F.floor, "y", "height"), px(F.ceil, "w", "width"), px(F.ceil, "h", "height"), 0.2)
    return boxes(spark, sf_dir).select("image", "serial", z.alias("z")).select("image", "serial", "z.*")


@query("WITH " + PIC + " SELECT image, i::INTEGER AS level, floor(width * pow(0.5::DOUBLE, i))::BIGINT AS w, floor(height * pow(0.5::DOUBLE, i))::BIGINT AS h FROM p, range(1, 4) x(i)")
def pyramid_sizes(spark, sf_dir):
    levels = pictures(spark, sf_dir).select("image", F.posexplode(Z.pyramid(F.col("width"), F.col("height"), 3, 0.5)).alias("k", "s"))
    return levels.select("image", (F.col("k") + 1).alias("level"), "s.w", "s.h")


@query("SELECT page_id, url_encode(url || ' ~*+%zz') AS escaped, url || ' ~*+%zz' AS restored, url_encode('a b') || '=' || url_encode(url) || '&h=' || url_encode(html) AS form FROM pages")
def uri_codec(spark, sf_dir):
    own = table(spark, sf_dir, "pages").withColumn("t", F.concat("url", F.lit(" ~*+%zz")))
    form = lambda pairs: U.encode_form(F.array(*[F.struct(F.lit(k).alias("key"), F.col(v).alias("value")) for k, v in pairs]))
    made = own.select("page_id", U.escape(F.col("t")).alias("escaped"), U.unescape(U.escape(F.col("t"))).alias("restored"), form((("a b", "url"), ("h", "html"))).alias("f"))
    return made.select("page_id", "escaped", "restored", U.encode_form(U.parse_form(F.col("f"))).alias("form"))


@query(_image_sql(_v("embedding[(7 - i // 8) * 8 + i % 8 + 1]")))
def image_vflip(spark, sf_dir):
    return _pixels(spark, sf_dir, lambda e: I.vflip(e, 8, 8))


@query(_image_sql(_v("embedding[(i // 4 + 3) * 8 + i % 4 + 2 + 1]"), 20))
def image_crop(spark, sf_dir):
    return _pixels(spark, sf_dir, lambda e: I.crop(e, 8, 2, 3, 4, 5))


@query(_image_sql(_v("255 - embedding[i + 1]::DOUBLE")))
def image_invert(spark, sf_dir):
    return _pixels(spark, sf_dir, I.invert)


@query("WITH " + BOX + f", c AS (SELECT *, cos(label * 0.3::DOUBLE) AS ca, sin(label * 0.3::DOUBLE) AS sa, x * 100 AS ax, y * 100 AS ay, w * 50 AS aw, h * 50 AS ah FROM b) SELECT image, serial::INTEGER AS serial, {', '.join(f'{sql_r6(e)} AS {n}' for n, e in (('x0', 'ax + ca * (aw / 2)'), ('y0', 'ay + sa * (aw / 2)'), ('x1', 'ax - sa * (ah / 2)'), ('y1', 'ay + ca * (ah / 2)'), ('x2', 'ax - ca * (aw / 2)'), ('y2', 'ay - sa * (aw / 2)'), ('x3', 'ax + sa * (ah / 2)'), ('y3', 'ay - ca * (ah / 2)')))} FROM c")
def arect_controls(spark, sf_dir):
    c = S.arect_controls(F.col("x") * 100, F.col("y") * 100, F.col("w") * 50, F.col("h") * 50, F.col("label") * F.lit(0.3))
    return _flat(boxes(spark, sf_dir).withColumn("c", c), "image", "serial", controls="c")


@query("WITH " + BOX + " SELECT image, serial::INTEGER AS serial, CASE label % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN label::DOUBLE ELSE label::DOUBLE END AS c0, CASE label % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN label::DOUBLE ELSE 0.0::DOUBLE END AS c3, serial::DOUBLE AS drawn FROM b")
def label_channels(spark, sf_dir):
    text = F.when(F.col("label") % 3 == 1, F.col("label").cast("string")).when(F.col("label") % 3 == 2, F.concat(F.lit("["), F.col("label").cast("string"), F.lit(",2]")))
    return boxes(spark, sf_dir).withColumn("c", S.label_channels(text)).select("image", "serial", F.col("c")[0].alias("c0"), F.col("c")[3].alias("c3"), S.render_colour(F.lit(0.0), F.col("serial"), F.col("c")[0], use_serial=True).alias("drawn"))


@query("SELECT vec_id AS serial, label AS grp, 0 AS file FROM embeddings UNION ALL SELECT event_id, 3, 1 FROM events WHERE event_id IN (SELECT event_id FROM events ORDER BY event_id LIMIT 50)")
def mixin_max_first(spark, sf_dir):
    second = table(spark, sf_dir, "events").select(F.col("event_id").alias("serial"), F.lit(3).alias("grp"))
    return M.mixin(embeddings(spark, sf_dir).select("serial", "grp"), second, most=50).select("serial", "grp", "file")


@query("WITH " + _ranked_sql("") + " SELECT serial, grp FROM r WHERE NOT (pos >= n * 3 // 7 AND pos < n * 4 // 7)")
def kfold_unstratified(spark, sf_dir):
    return M.split(embeddings(spark, sf_dir), M.SampleConfig(split=7, split_fold=3)).select("serial", "grp")


@query("SELECT doc_id AS id, quality AS label, toxic AS grp FROM labels")
def duplicate_label2(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.col("toxic").alias("label2"), F.col("quality").alias("grp"))
    return D.duplicate(t, label2_groups=True).select("id", "label", "grp")


@query("WITH t AS (SELECT (o_orderkey % 7) / 2 AS grp, o_custkey % 5 AS label, o_orderkey % 3 AS label2 FROM orders) SELECT sum(CASE WHEN grp * 2 % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS fractional, sum(CASE WHEN grp = label THEN 0 ELSE 1 END)::BIGINT AS not_label, sum(CASE WHEN grp = label2 THEN 0 ELSE 1 END)::BIGINT AS not_label2 FROM t")
def label_sources(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7 / 2).alias("grp"), (F.col("o_custkey") % 5).alias("label"), (F.col("o_orderkey") % 3).alias("label2"))
    return profile.label_sources(own)


@query("SELECT doc_id, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'pixel classification' ELSE 'pixel regression' END ELSE CASE WHEN toxic = 1 THEN 'classification' ELSE 'regression' END END AS task FROM labels")
def loader_task(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", profile.loader_task(F.col("quality") == 1, F.col("toxic")).alias("task"))


@query(_BALANCED + ", t AS (SELECT count(*) AS n FROM o) SELECT serial, draw, false AS pad FROM o UNION ALL SELECT serial, draw + n, true FROM o, t WHERE draw < (32 - n % 32) % 32")
def padded_batches(spark, sf_dir):
    plan = M.draw_order(embeddings(spark, sf_dir), _TRAIN).select("serial", F.col("draw").cast("long").alias("draw"))
    return M.padded(plan, 32).select("serial", "draw", "pad")


@query("WITH " + BOX + ", " + PIC + ", o AS (SELECT image, row_number() OVER (ORDER BY " + sql_key("image", "1") + ", image) - 1 AS draw FROM p), c AS (SELECT image, serial, label::DOUBLE AS label, " + ", ".join(f"{e} AS {n}" for n, e in _BF.items()) + f" FROM b) SELECT draw // 16 AS batch, (draw % 16)::INTEGER AS place, c.image, serial::INTEGER AS serial, label, {sql_r6('x1')} AS x1, {sql_r6('y2')} AS y2 FROM c JOIN o ON c.image = o.image WHERE (x2 - x1 + 1) * (y2 - y1 + 1) >= 400")
def feature_batch(spark, sf_dir):
    plan = M.draw_order(pictures(spark, sf_dir).select("image", F.col("image").alias("serial"), F.lit(0).alias("grp")), M.SampleConfig())
    rows = A.feature_batch(A.box_feature(boxes(spark, sf_dir), 400.0), plan, 16)
    return rows.select("batch", "place", "image", "serial", "label", r6(F.col("x1")).alias("x1"), r6(F.col("y2")).alias("y2"))


@query("WITH " + BOX + f", s AS (SELECT 48.0::DOUBLE / sqrt(w * h * width * height) AS scale FROM b WHERE w > 0 AND h > 0) SELECT {sql_r6('min(scale)')} AS min_scale, {sql_r6('avg(scale)')} AS mean_scale, {sql_r6('max(scale)')} AS max_scale, count(*) AS patches FROM s")
def scale_stats(spark, sf_dir):
    found = profile.scale_stats(D.region_patch(boxes(spark, sf_dir), 48, 64))
    return found.select(*[r6(F.col(c)).alias(c) for c in ("min_scale", "mean_scale", "max_scale")], "patches")


@query("WITH t AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, a * 2 AS tile_x, c * 2 AS tile_y FROM embeddings, range(0, 3) x(a), range(0, 3) y(c)) SELECT id, tile_x, tile_y FROM t WHERE list_sum(list_transform(range(0, 16), lambda i: e[(tile_y + i // 4) * 8 + tile_x + i % 4 + 1])) / 16 >= 0.01")
def tile_floor(spark, sf_dir):
    own = embeddings(spark, sf_dir, True).select("id", "embedding", F.lit(8).cast("long").alias("width"), F.lit(8).cast("long").alias("height"))
    return D.bright_tiles(D.grid_tiles(own, 4, 2), 8, 0.01, "embedding").select("id", "tile_x", "tile_y")


# --- transform steps, each through ``transforms.apply``


def annotated(spark, sf_dir):
    """Every vector as an 8 x 8 image with one rectangle."""
    v = F.col("vec_id")
    rect = S.rect_controls(*[c.cast("double") for c in (v % 4, v % 3, 2 + v % 3, F.lit(3))])
    shape = F.struct(F.lit("rect").alias("type"), (v % 3 + 1).cast("double").alias("label"), (v % 5).cast("double").alias("tag"), rect.alias("controls"))
    side = F.lit(8).cast("long")
    return table(spark, sf_dir, "embeddings").select(v.alias("serial"), side.alias("width"), side.alias("height"), F.array(shape).alias("shapes"), F.col("embedding").cast("array<double>").alias("image"))


_ROWS = "r AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, (vec_id % 4)::DOUBLE AS ax, (vec_id % 3)::DOUBLE AS ay, (vec_id % 4 + 2 + vec_id % 3)::DOUBLE AS bx, (vec_id % 3 + 3)::DOUBLE AS by_ FROM embeddings)"
_WHOLE = "CASE WHEN sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7 THEN e[sy * 8 + sx + 1] ELSE {} END"


def _step_sql(params: str = "", w: str = "8", h: str = "8", n: int = 64, sx: str = "x", sy: str = "y", value: str = _WHOLE.format("0.0::DOUBLE"), corners: tuple[str, str, str, str] = ("ax", "ay", "bx", "by_"), more: str = "") -> str:
    """Pixels and the rectangle's first two corners after a step; pixel (x, y) of the w x h result comes from (sx, sy)."""
    bend = "k AS (SELECT *, floor(sx)::BIGINT AS x0, floor(sy)::BIGINT AS y0 FROM m)"
    return f"""WITH {_ROWS}, q AS (SELECT *{', ' + params if params else ''} FROM r){more}, s AS (SELECT *, ({w})::BIGINT AS w, ({h})::BIGINT AS h FROM {'z' if more else 'q'}),
g AS (SELECT *, i % w AS x, i // w AS y FROM s, range(0, {n}) t(i) WHERE i < w * h), m AS (SELECT *, {sx} AS sx, {sy} AS sy FROM g), {bend}
SELECT id, w AS width, h AS height, i::INTEGER AS i, {sql_r6(value)} AS v, {', '.join(f'{sql_r6(c)} AS {k}' for k, c in zip(('ax', 'ay', 'bx', 'by'), corners, strict=True))} FROM k"""


_PERTURB = M.SampleConfig(perturb=True)


def _step(name: str, sql: str, *steps: dict) -> None:
    def run(spark, sf_dir):
        done = T.apply(annotated(spark, sf_dir), steps, _PERTURB)
        c = F.col("shapes")[0]["controls"]
        corners = [r6(c[k // 2]["xy"[k % 2]]).alias(n) for k, n in enumerate(("ax", "ay", "bx", "by"))]
        pixels = done.select(F.col("serial").alias("id"), "width", "height", *corners, F.posexplode("image").alias("i", "v"))
        return pixels.withColumn("v", r6(F.col("v")))

    run.__name__ = name
    query(sql)(run)


def pointed(spark, sf_dir):
    """The annotated images with two points each instead of the rectangle."""
    v = F.col("serial")
    shape = lambda k, x, y: F.struct(F.lit("point").alias("type"), F.lit(float(k)).alias("label"), F.lit(0.0).alias("tag"), F.array(S.point(x, y)).alias("controls"))
    return annotated(spark, sf_dir).withColumn("shapes", F.array(shape(1, v % 4 + 0.5, v % 3 + 0.25), shape(2, F.lit(5.0), (v % 7).cast("double"))))


def _made(name: str, sql: str, column: str, *steps: dict, rows=None) -> None:
    """A step that makes an array beside the image: ``targets`` by name, or ``mask`` or ``raster``."""
    def run(spark, sf_dir):
        done = T.apply((rows or annotated)(spark, sf_dir), steps, _PERTURB).withColumnRenamed("serial", "id")
        if column == "targets":
            done = done.select("id", F.explode("targets").alias("t")).select("id", "t.name", F.posexplode("t.data").alias("i", "v"))
            return done.withColumn("v", r6(F.col("v")))
        return done.select("id", F.posexplode(column).alias("i", "v")).withColumn("v", r6(F.col("v")))

    run.__name__ = name
    query(sql)(run)


def _u(name: str) -> str:
    return sql_uniform(name, "id")


_step("step_resize", _step_sql("", "12", "6", 72, _scaled("x", "12"), _scaled("y", "6"), _bilinear(), ("ax * 1.5", "ay * 0.75", "bx * 1.5", "by_ * 0.75")), {"type": "resize", "width": 12, "height": 6})
_step("step_scale", _step_sql("", "12", "12", 144, _scaled("x", "12"), _scaled("y", "12"), _bilinear(), ("ax * 1.5", "ay * 1.5", "bx * 1.5", "by_ * 1.5")), {"type": "scale", "scale": 1.5})
_GROWN = f"round(8 * (0.5::DOUBLE + (2.0::DOUBLE - 0.5::DOUBLE) * {_u('0.scale')}))::BIGINT AS u"
_step("step_augment_scale", _step_sql(_GROWN, "u", "u", 256, _scaled("x", "u"), _scaled("y", "u"), _bilinear(), tuple(f"{c} * (u / 8)" for c in ("ax", "ay", "bx", "by_"))), {"type": "augment.scale", "min": 0.5, "max": 2})
_COINS = ", ".join(f"{_u('0.' + n)} < 0.5 AS {c}" for c, n in (("fh", "horizontal"), ("fv", "vertical"), ("ft", "transpose")))
_TURN = lambda a, b, fa, fb: f"CASE WHEN ft THEN CASE WHEN {fb} THEN 8 - {b} ELSE {b} END ELSE CASE WHEN {fa} THEN 8 - {a} ELSE {a} END END"
_FROM = lambda a, b, f: f"CASE WHEN {f} THEN 7 - (CASE WHEN ft THEN {b} ELSE {a} END) ELSE (CASE WHEN ft THEN {b} ELSE {a} END) END"
_step("step_flip", _step_sql(_COINS, sx=_FROM("x", "y", "fh"), sy=_FROM("y", "x", "fv"), corners=(_TURN("ax", "ay", "fh", "fv"), _TURN("ay", "ax", "fv", "fh"), _TURN("bx", "by_", "fh", "fv"), _TURN("by_", "bx", "fv", "fh"))), {"type": "augment.flip", "horizontal": True, "vertical": True, "transpose": True})
_ANGLE = f"radians(-40.0::DOUBLE + (40.0::DOUBLE - -40.0::DOUBLE) * {_u('0.angle')}) AS t"
_REFIT = """, n AS (SELECT *, cos(t) AS ca, sin(t) AS sa, [[ax, ay], [bx, by_], [bx, ay], [ax, by_]] AS c FROM q),
o AS (SELECT *, list_transform(c, lambda p: ca * p[1] + sa * p[2] + (1 - ca) * 4 - sa * 4) AS xs, list_transform(c, lambda p: ca * p[2] - sa * p[1] + sa * 4 + (1 - ca) * 4) AS ys FROM n),
p AS (SELECT *, list_min(xs) AS lx, list_max(xs) - list_min(xs) AS wx, list_min(ys) AS ly, list_max(ys) - list_min(ys) AS wy, sqrt((xs[3] - xs[1]) * (xs[3] - xs[1]) + (ys[3] - ys[1]) * (ys[3] - ys[1])) * sqrt((xs[4] - xs[1]) * (xs[4] - xs[1]) + (ys[4] - ys[1]) * (ys[4] - ys[1])) AS area FROM o),
z AS (SELECT *, sqrt((area + 1) / (wx * wy + 1)) AS rate FROM p)"""
_step("step_rotate", _step_sql(_ANGLE, sx="ca * (x - 4) - sa * (y - 4) + 4", sy="sa * (x - 4) + ca * (y - 4) + 4", value=_bilinear("constant"), corners=("lx + wx / 2 - wx * rate / 2", "ly + wy / 2 - wy * rate / 2", "lx + wx / 2 + wx * rate / 2", "ly + wy / 2 + wy * rate / 2"), more=_REFIT), {"type": "augment.rotate", "min": -40, "max": 40})
_step("step_pad", _step_sql("", "12", "10", 120), {"type": "pad", "width": 12, "height": 10})
_CROPS = ", ".join(f"floor({_u(f'0.{a}.crop{k}')} * 3)::BIGINT AS {a}{k}" for a in "wh" for k in (1, 2))
_step("step_clip", _step_sql(_CROPS, "8 - w1 - w2", "8 - h1 - h2", 64, "x + w1", "y + h1", corners=("ax - w1", "ay - h1", "bx - w1", "by_ - h1")), {"type": "clip", "max_crop": 3})
_PLACES = ", ".join(f"floor({_u(f'0.{a}.place')} * 1048576)::BIGINT % {m} AS o{a}" for a, m in (("w", 3), ("h", 2)))
_step("step_clip_window", _step_sql(_PLACES, "5", "10", 50, "x + ow", "y - oh", corners=("ax - ow", "ay + oh", "bx - ow", "by_ + oh")), {"type": "clip", "size_width": 5, "size_height": 10})
_SHIFT = f"least(greatest(2 + floor({_u('1.shift')} * 5)::BIGINT - 2, 0), 4) AS o"
_step("step_clip_square", _step_sql(_SHIFT, sx="x + o", corners=("ax - o", "ay", "bx - o", "by_")), {"type": "pad", "width": 12, "height": 8}, {"type": "clip_square", "shift": 2})
_WINDOW = ", ".join(f"floor({_u('0.' + a)} * 1048576)::BIGINT % 4 AS o{a}" for a in "xy")
_step("step_square_clip", _step_sql(_WINDOW, "11", "11", 121, "x - ox", "y - oy", _WHOLE.format("0.5::DOUBLE"), ("ax + ox", "ay + oy", "bx + ox", "by_ + oy")), {"type": "random_square_clip", "size": 11, "pad": 0.5})
_step("step_normalize", _step_sql(value="(e[i + 1] - 0.1::DOUBLE) / 0.5::DOUBLE"), {"type": "normalize", "mean": [0.1, -0.2], "std": [0.5, 2.0]})
_step("step_add", _step_sql(f"-0.5::DOUBLE + (0.5::DOUBLE - -0.5::DOUBLE) * {_u('0.add0')} AS d0", value="e[i + 1] + d0"), {"type": "augment.add", "range": 0.5, "range2": 7})
_step("step_flip_color", _step_sql(f"{_u('0.flip_color')} < 0.5 AS f", value="CASE WHEN f THEN 255 - e[i + 1] ELSE e[i + 1] END"), {"type": "augment.flip_color"})
_step("step_blur", _step_sql(value=_blurred("constant")), {"type": "augment.blur", "min": 1, "max": 1})
_step("step_colorspace", _step_sql("", "8", "8", 64, value="e[i + 1] * 2"), {"type": "colorspace", "code": "GRAY2BGR", "mul0": 2}, {"type": "colorspace", "code": "BGR2RGB"}, {"type": "colorspace", "code": "BGR2GRAY"})
_step("step_sometimes", _step_sql(f"{_u('0.chance')} <= 0.4 AS f, {_u('0.0.horizontal')} < 0.5 AS g", w="CASE WHEN f THEN 9 ELSE 8 END", n=72, sx="CASE WHEN f AND g THEN 7 - x ELSE x END", corners=("CASE WHEN f AND g THEN 8 - ax ELSE ax END", "ay", "CASE WHEN f AND g THEN 8 - bx ELSE bx END", "by_")), {"type": "sometimes", "chance": 0.4, "transforms": [{"type": "augment.flip", "horizontal": True}, {"type": "pad", "width": 9, "height": 8}]})
_PICKS = ", list_contains(list_transform(list_sort(list_transform([0, 1, 2], lambda k: md5(concat_ws(':', '2016', '0.pick', k::VARCHAR, id::VARCHAR)) || k::VARCHAR))[1:2], lambda t: substr(t, 33, 1)), '{}') AS p{}"
_step("step_some_of", _step_sql("1 AS one" + "".join(_PICKS.format(k, k) for k in range(3)) + f", {_u('0.1.0.horizontal')} < 0.5 AS g", value="(CASE WHEN p0 THEN 10 ELSE 1 END) * " + _WHOLE.format("0.0::DOUBLE") + " - CASE WHEN p2 THEN 0.25 ELSE 0 END", sx="CASE WHEN p1 AND g THEN 7 - x ELSE x END", corners=("CASE WHEN p1 AND g THEN 8 - ax ELSE ax END", "ay", "CASE WHEN p1 AND g THEN 8 - bx ELSE bx END", "by_")), {"type": "some_of", "count": 2, "transforms": [{"type": "normalize", "std": 0.1}, {"type": "augment.flip", "horizontal": True}, {"type": "normalize", "mean": 0.25}]})

# --- the same steps on rows with an image of three channels and a mask: labels keep their values


def faceted(spark, sf_dir):
    """Every vector as a 5 x 4 image of three channels, a mask of that size with the classes 0 to 2, and one rectangle."""
    v, e = F.col("vec_id"), F.transform("embedding", lambda x: x.cast("double"))
    rect = S.rect_controls(*[c.cast("double") for c in (v % 3, F.lit(1), F.lit(2), F.lit(2))])
    shape = F.struct(F.lit("rect").alias("type"), F.lit(7.0).alias("label"), rect.alias("controls"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (F.floor(F.abs(F.get(F.col("embedding"), i * 3).cast("double")) * 100) % 3).cast("double"))
    return table(spark, sf_dir, "embeddings").select(v.alias("serial"), F.lit(5).cast("long").alias("width"), F.lit(4).cast("long").alias("height"), F.array(shape).alias("shapes"), F.slice(e, 1, 60).alias("image"), mask.alias("label"))


_PIXEL = "e[(({y}) * 5 + ({x})) * 3 + c + 1]"
_CLASS = "m[({y}) * 5 + ({x}) + 1]"


def _at(pixel: str, x: str, y: str, outside: str = "0.0::DOUBLE") -> str:
    """A pixel at whole coordinates, or what counts outside."""
    return f"CASE WHEN {x} BETWEEN 0 AND 4 AND {y} BETWEEN 0 AND 3 THEN {pixel.format(x=x, y=y)} ELSE {outside} END"


def _between(pixel: str, replicate: bool = True) -> str:
    """Linear between the four pixels about (sx, sy)."""
    near = lambda dx, dy: pixel.format(x=f"least(greatest(x0 + {dx}, 0), 4)", y=f"least(greatest(y0 + {dy}, 0), 3)") if replicate else _at(pixel, f"(x0 + {dx})", f"(y0 + {dy})")
    return "(" + " + ".join(f"abs({1 - dy} - (sy - y0)) * abs({1 - dx} - (sx - x0)) * {near(dx, dy)}" for dy in (0, 1) for dx in (0, 1)) + ")"


def _facet_sql(image: str = _at(_PIXEL, "sx", "sy"), mask: str = _at(_CLASS, "sx", "sy"), params: str = "", w: str = "5", h: str = "4", sx: str = "x", sy: str = "y", channels: int = 3, label: str = "LABEL", more: str = "") -> str:
    """Pixels of facets 0 and 1 after a step, those of the w x h result being taken from (sx, sy)."""
    return f"""WITH r AS (SELECT vec_id AS id, embedding[1:60]::DOUBLE[] AS e, list_transform(range(0, 20), lambda i: (floor(abs(embedding[i * 3 + 1]::DOUBLE) * 100)::BIGINT % 3)::DOUBLE) AS m FROM embeddings),
s AS (SELECT *, ({w})::BIGINT AS w, ({h})::BIGINT AS h FROM (SELECT *{', ' + params if params else ''} FROM r)), g AS (SELECT *, i % w AS x, i // w AS y FROM s, range(0, 200) t(i) WHERE i < w * h),
n AS (SELECT *, {sx} AS sx, {sy} AS sy FROM g), k AS (SELECT *, floor(sx)::BIGINT AS x0, floor(sy)::BIGINT AS y0 FROM n)
SELECT id, 0 AS facet, 'IMAGE' AS kind, w AS width, h AS height, (i * {channels} + c)::INTEGER AS i, {sql_r6(image)} AS v FROM k, range(0, {channels}) u(c)
UNION ALL SELECT id, 1, '{label}', w, h, i::INTEGER, {sql_r6(mask)} FROM k{more}"""


def _facet(name: str, sql: str, *steps: dict) -> None:
    def run(spark, sf_dir):
        done = T.apply(faceted(spark, sf_dir), steps, _PERTURB)
        each = done.select(F.col("serial").alias("id"), F.posexplode("facets").alias("facet", "f")).select("id", "facet", "f.kind", "f.width", "f.height", F.posexplode("f.data").alias("i", "v"))
        return each.withColumn("v", r6(F.col("v")))

    run.__name__ = name
    query(sql)(run)


_WIDE = {"sx": "least(greatest((x + 0.5::DOUBLE) * 5 / w - 0.5::DOUBLE, 0), 4)", "sy": "least(greatest((y + 0.5::DOUBLE) * 4 / h - 0.5::DOUBLE, 0), 3)"}
_CLOSEST = _CLASS.format(x="x * 5 // w", y="y * 4 // h")
_facet("facet_resize", _facet_sql(_between(_PIXEL), _CLOSEST, w="8", h="3", **_WIDE), {"type": "resize", "width": 8, "height": 3})
_facet("facet_scale", _facet_sql(_between(_PIXEL), _CLOSEST, w="7", h="6", **_WIDE), {"type": "scale", "scale": 1.5})
_facet("facet_augment_scale", _facet_sql(_between(_PIXEL), _between(_CLASS), f"0.5::DOUBLE + (2.0::DOUBLE - 0.5::DOUBLE) * {_u('0.scale')} AS u", "round(5 * u)", "round(4 * u)", **_WIDE), {"type": "augment.scale", "min": 0.5, "max": 2})
_TILT = f"cos(radians(-40.0::DOUBLE + (40.0::DOUBLE - -40.0::DOUBLE) * {_u('0.angle')})) AS ca, sin(radians(-40.0::DOUBLE + (40.0::DOUBLE - -40.0::DOUBLE) * {_u('0.angle')})) AS sa"
_BACK = {"sx": "ca * (x - 2) - sa * (y - 2) + 2", "sy": "sa * (x - 2) + ca * (y - 2) + 2"}
_ROUND = [f"floor(round({v}, 9) + 0.5)::BIGINT" for v in ("sx", "sy")]
_facet("facet_rotate", _facet_sql(_between(_PIXEL, False), _at(_CLASS, *_ROUND), _TILT, **_BACK), {"type": "augment.rotate", "min": -40, "max": 40})
_facet("facet_flip", _facet_sql(params=f"{_u('0.horizontal')} < 0.5 AS f", sx="CASE WHEN f THEN 4 - x ELSE x END"), {"type": "augment.flip", "horizontal": True})
_facet("facet_pad", _facet_sql(w="7", h="5"), {"type": "pad", "width": 7, "height": 5})
_facet("facet_clip", _facet_sql(params=", ".join(f"floor({_u(f'0.{a}.crop{k}')} * 2)::BIGINT AS {a}{k}" for a in "wh" for k in (1, 2)), w="5 - w1 - w2", h="4 - h1 - h2", sx="x + w1", sy="y + h1"), {"type": "clip", "max_crop": 2})
_facet("facet_square_clip", _facet_sql(_at(_PIXEL, "sx", "sy", "0.5::DOUBLE"), _at(_CLASS, "sx", "sy", "0.5::DOUBLE"), ", ".join(f"floor({_u('0.' + a)} * 1048576)::BIGINT % {m} AS o{a}" for a, m in (("x", 3), ("y", 4))), "7", "7", "x - ox", "y - oy"), {"type": "random_square_clip", "size": 7, "pad": 0.5})
_facet("facet_normalize", _facet_sql(f"({_PIXEL.format(x='x', y='y')} - [0.1::DOUBLE, -0.2::DOUBLE, 0.0::DOUBLE][c + 1]) / [0.5::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][c + 1]"), {"type": "normalize", "mean": [0.1, -0.2], "std": [0.5, 2.0]})
_DELTAS = ", ".join(f"{-r}::DOUBLE + ({r}::DOUBLE - {-r}::DOUBLE) * {_u(f'0.add{k}')} AS d{k}" for k, r in enumerate((0.5, 0.5, 10.0)))
_facet("facet_add", _facet_sql(f"{_PIXEL.format(x='x', y='y')} + [d0, d1, d2][c + 1]", params=_DELTAS), {"type": "augment.add", "range": 0.5, "range3": 10.0})
_facet("facet_flip_color", _facet_sql(f"CASE WHEN f THEN 255 - {_PIXEL.format(x='x', y='y')} ELSE {_PIXEL.format(x='x', y='y')} END", params=f"{_u('0.flip_color')} < 0.5 AS f"), {"type": "augment.flip_color"})
_BELL = [math.exp(-0.5 * d * d) / (1 + 2 * math.exp(-0.5)) for d in (-1, 0, 1)]
_facet("facet_blur", _facet_sql("(" + " + ".join(f"{_BELL[dx + 1] * _BELL[dy + 1]!r}::DOUBLE * ({_at(_PIXEL, f'(x + {dx})', f'(y + {dy})')})" for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + ")"), {"type": "augment.blur", "min": 1, "max": 1})
_facet("facet_colorspace", _facet_sql("2 * (0.114::DOUBLE * e[i * 3 + 1] + 0.587::DOUBLE * e[i * 3 + 2] + 0.299::DOUBLE * e[i * 3 + 3])", channels=1), {"type": "colorspace", "code": "BGR2GRAY", "mul0": 2})
_facet("facet_erode", _facet_sql(mask="list_min([" + ", ".join(_at(_CLASS, f"(x + {dx})", f"(y + {dy})", "1.0::DOUBLE") for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + "])"), {"type": "erode_mask", "radius": 1})
_facet("facet_rasterize", _facet_sql(mask=f"CASE WHEN x >= id % 3 AND x < id % 3 + 2 AND y BETWEEN 1 AND 2 THEN 7.0::DOUBLE ELSE {_CLASS.format(x='x', y='y')} END"), {"type": "rasterize"})
_facet("facet_mask", _facet_sql(_between(_PIXEL, False), _at(_CLASS, *_ROUND), _TILT.replace("0.angle", "1.angle"), more=f" UNION ALL SELECT id, 2, 'LABEL', w, h, i::INTEGER, CASE WHEN {_ROUND[0]} BETWEEN 0 AND 4 AND {_ROUND[1]} BETWEEN 0 AND 3 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END FROM k", **_BACK), {"type": "mask", "value": 3}, {"type": "augment.rotate", "min": -40, "max": 40})
_facet("facet_featurize", _facet_sql(mask=_CLASS.format(x="x", y="y"), label="FEATURE", w="7", h="5").replace("UNION ALL SELECT id, 1, 'FEATURE', w, h, i::INTEGER", "UNION ALL SELECT id, 1, 'FEATURE', 5, 4, (y * 5 + x)::INTEGER") + " WHERE x < 5 AND y < 4", {"type": "featurize"}, {"type": "pad", "width": 7, "height": 5})
_facet("facet_sometimes", _facet_sql(f"{_PIXEL.format(x='x', y='y')} + CASE WHEN f THEN d ELSE 0 END", params=f"{_u('0.chance')} <= 0.4 AS f, -1.0::DOUBLE + 2.0::DOUBLE * {_u('0.0.add0')} AS d", more=" UNION ALL SELECT id, 2, 'LABEL', w, h, i::INTEGER, 1.0::DOUBLE FROM k WHERE f"), {"type": "sometimes", "chance": 0.4, "transforms": [{"type": "augment.add", "space": "SAME", "range": 1}, {"type": "mask"}]})


_made("mask_constant", f"WITH {_ROWS}, q AS (SELECT id, {_GROWN} FROM r) SELECT id, i::INTEGER AS i, 3.0::DOUBLE AS v FROM q, range(0, 256) t(i) WHERE i < u * u", "mask", {"type": "augment.scale", "min": 0.5, "max": 2}, {"type": "mask", "value": 3})
_made("step_pyramid", f"WITH {_ROWS}, g AS (SELECT *, i % n AS x, i // n AS y FROM r, (VALUES (4), (2)) v(n), range(0, 16) t(i) WHERE i < n * n), m AS (SELECT *, {_scaled('x', 'n')} AS sx, {_scaled('y', 'n')} AS sy FROM g), k AS (SELECT *, floor(sx)::BIGINT AS x0, floor(sy)::BIGINT AS y0 FROM m) SELECT id, 'pyramid' AS name, i::INTEGER AS i, {sql_r6(_bilinear())} AS v FROM k", "targets", {"type": "pyramid", "count": 2, "rate": 0.5})


def _anchor_step_sql(score: str, params: tuple[str, ...], upper: float, lower: float) -> str:
    each = " UNION ALL ".join(f"SELECT id, 'anchors.params' AS name, (i * {len(params)} + {k})::INTEGER AS i, CASE WHEN ok THEN {sql_r6(v)} ELSE 0.0::DOUBLE END AS v FROM s" for k, v in enumerate(params))
    return f"""WITH {_ROWS}, c AS (SELECT id, i, ax + (bx - ax) / 2 - i % 4 * 2 AS dx, ay + (by_ - ay) / 2 - i // 4 * 2 AS dy, bx - ax AS bw, by_ - ay AS bh FROM r, range(0, 16) t(i)),
d AS (SELECT *, {score} AS score FROM c), s AS (SELECT *, score > 0 AND score >= {lower} AS ok FROM d)
SELECT id, 'anchors.label' AS name, i::INTEGER AS i, CASE WHEN ok AND score >= {upper} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM s
UNION ALL SELECT id, 'anchors.label_mask', i::INTEGER, CASE WHEN ok AND score < {upper} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END FROM s
UNION ALL SELECT id, 'anchors.params_mask', i::INTEGER, CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM s UNION ALL {each}"""


_R = "(sqrt(bw * bh) / 2)"
_made("step_anchors_box", _anchor_step_sql("least((bw - 2 * abs(dx)) / bw, (bh - 2 * abs(dy)) / bh)", ("dx", "dy", "bw", "bh"), 0.6, 0.2), "targets", {"type": "anchors.dense.box", "downsize": 2, "lower_th": 0.2})
_made("step_anchors_circle", _anchor_step_sql(f"({_R} - sqrt(dx * dx + dy * dy)) / {_R}", ("dx", "dy", _R), 0.6, 0.2), "targets", {"type": "anchors.dense.circle", "downsize": 2, "lower_th": 0.2})
_POINTS = "c AS (SELECT id, i, list_reverse_sort(list_transform([[id % 4 + 0.5::DOUBLE, id % 3 + 0.25::DOUBLE, 2], [5.0::DOUBLE, id % 7, 1]], lambda p: [exp(-sqrt((p[1] - i % 4 * 2) * (p[1] - i % 4 * 2) + (p[2] - i // 4 * 2) * (p[2] - i // 4 * 2))), p[3], p[1] - i % 4 * 2, p[2] - i // 4 * 2]))[1] AS t FROM r, range(0, 16) t(i)),\nd AS (SELECT id, i, t[1] AS score, t[3] AS dx, t[4] AS dy FROM c)"
_POINT_SQL = _anchor_step_sql("0", ("dx", "dy"), 0.3, 0.05)
_made("step_anchors_point", _POINT_SQL[: _POINT_SQL.index("c AS (")] + _POINTS + _POINT_SQL[_POINT_SQL.index(", s AS (") :], "targets", {"type": "anchors.dense.point", "downsize": 2, "upper_th": 0.3, "lower_th": 0.05}, rows=pointed)
_made("step_box_feature", f"WITH {_ROWS}, f AS (SELECT id, [(id % 3 + 1)::DOUBLE, (id % 5)::DOUBLE, least(ax, 7), least(ay, 7), least(bx, 7), least(by_, 7)] AS v FROM r) SELECT id, 'box_feature' AS name, i::INTEGER AS i, v[i + 1] AS v FROM f, range(0, 6) t(i) WHERE (v[5] - v[3] + 1) * (v[6] - v[4] + 1) >= 14", "targets", {"type": "box_feature", "min_area": 14})
_CELLS = f"WITH {_ROWS}, c AS (SELECT id, j, (j % 4) * 2 AS px, (j // 4) * 2 AS py, list_filter([[bx, ay, 3], [ax, by_, 4], [bx, by_, 2], [ax, ay, 1]], lambda p: sqrt((p[1] - (j % 4) * 2) * (p[1] - (j % 4) * 2) + (p[2] - (j // 4) * 2) * (p[2] - (j // 4) * 2)) <= 2) AS near FROM r, range(0, 16) t(j)), b AS (SELECT *, list_reverse_sort(list_transform(near, lambda p: [p[3], p[1], p[2]]))[1] AS p FROM c)"
_made("step_keypoints", _CELLS + " SELECT id, 'keypoints.mask' AS name, (j * 3 + k)::INTEGER AS i, CASE WHEN p IS NOT NULL AND k = id % 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM b, range(0, 3) t(k) UNION ALL SELECT id, 'keypoints.offset', ((j * 3 + k) * 2 + c)::INTEGER, CASE WHEN p IS NOT NULL AND k = id % 3 THEN CASE c WHEN 0 THEN p[2] - px ELSE p[3] - py END ELSE 0.0::DOUBLE END FROM b, range(0, 3) t(k), range(0, 2) u(c)", "targets", {"type": "keypoints.basic", "classes": 3, "downsize": 2, "radius": 2})
_DRAWN = "CASE WHEN {x} + 0.5 >= ax AND {x} + 0.5 < bx AND {y} + 0.5 >= ay AND {y} + 0.5 < by_ THEN (id % 3 + 1)::DOUBLE ELSE 0.0::DOUBLE END"
_made("step_rasterize", f"WITH {_ROWS} SELECT id, i::INTEGER AS i, {_DRAWN.format(x='i % 8', y='i // 8')} AS v FROM r, range(0, 64) t(i)", "raster", {"type": "rasterize"})
_NEAR = ", ".join(f"CASE WHEN i % 8 + {dx} BETWEEN 0 AND 7 AND i // 8 + {dy} BETWEEN 0 AND 7 THEN {_DRAWN.format(x=f'i % 8 + {dx}', y=f'i // 8 + {dy}')} ELSE 1.0::DOUBLE END" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
_made("step_erode_mask", f"WITH {_ROWS} SELECT id, i::INTEGER AS i, list_min([{_NEAR}]) AS v FROM r, range(0, 64) t(i)", "raster", {"type": "rasterize"}, {"type": "erode_mask", "index": 1, "radius": 1})


_BYTES = "v AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: floor(abs(x) * 100)::BIGINT % 256) AS b FROM embeddings)"


def byte_images(spark, sf_dir):
    """Vectors as byte images of 8 x 8 pixels (even ids) or 16 x 4."""
    v, even = F.col("vec_id"), F.col("vec_id") % 2 == 0
    byte = lambda x: F.lpad(F.hex(F.floor(F.abs(x.cast("double")) * 100).cast("long") % 256), 2, "0")
    matrix = records.raw_bytes(F.lit(0), F.when(even, 8).otherwise(4), F.when(even, 8).otherwise(16), F.lit(1), F.unhex(F.array_join(F.transform("embedding", byte), "")))
    own = table(spark, sf_dir, "embeddings").select(v.alias("id"), v.alias("serial"), "label", matrix.alias("image"))
    return records.make_records(own, [("image", records.IMAGE)])


def decoded_field(rows):
    got = rows.withColumn("image", P.raw_decoder(rows.sparkSession)(records.field(F.col("fields"), 0)))
    return got.select("id", "size", F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.posexplode("image.data").alias("i", "v"))


@query(f"""WITH {_BYTES}, g AS (SELECT id, i, id % 2 = 0 AS even, b, (i // 8) * 32 + (i % 8) * 2 AS o FROM v, range(0, 64) t(i) WHERE id % 2 = 0 OR i < 16)
SELECT id, CASE WHEN even THEN 80 ELSE 32 END::BIGINT AS size, 8::BIGINT AS width, CASE WHEN even THEN 8 ELSE 2 END::BIGINT AS height, i::INTEGER AS i,
CASE WHEN even THEN b[i + 1]::DOUBLE ELSE round_even((b[o + 1] + b[o + 2] + b[o + 17] + b[o + 18]) / 4.0::DOUBLE, 0) END AS v FROM g""")
def transcode_downsize(spark, sf_dir):
    return decoded_field(transcode.downsized(byte_images(spark, sf_dir), 8))


@query(f"""WITH {_BYTES}, g AS (SELECT id, i, b, i % 4 AS x, i // 4 AS y FROM v, range(0, 16) t(i)),
c AS (SELECT id, i, CASE WHEN id % 2 = 0 THEN (b[y * 16 + x * 2 + 1] + b[y * 16 + x * 2 + 2] + b[y * 16 + x * 2 + 9] + b[y * 16 + x * 2 + 10]) / 4.0::DOUBLE ELSE (b[y * 16 + x * 4 + 2] + b[y * 16 + x * 4 + 3]) / 2.0::DOUBLE END AS v FROM g)
SELECT id, 32::BIGINT AS size, 4::BIGINT AS width, 4::BIGINT AS height, i::INTEGER AS i, round_even(v, 0) AS v FROM c""")
def transcode_square(spark, sf_dir):
    return decoded_field(transcode.import_limited(byte_images(spark, sf_dir), square=4))


@query("""SELECT doc_id AS id, CASE WHEN source IS NULL THEN 1 ELSE 2 END::INTEGER AS n_fields, CASE WHEN source IS NULL THEN 0 ELSE 3 END::INTEGER AS kind,
upper(coalesce(source, '')) AS second, md5(coalesce(text, '')) AS first_md5 FROM documents""")
def field_replace(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("serial"), F.lit(0.0).alias("label"), "text", "source")
    own = records.make_records(t, [("text", records.NONE), ("source", records.NONE)])
    upper = F.encode(F.upper(F.decode(records.field(F.col("fields"), 1), "UTF-8")), "UTF-8")
    new = own.withColumn("fields", records.replace_field(F.col("fields"), 1, upper, records.ANNOTATION_JSON))
    f = F.col("fields")
    return new.select("id", F.size(f).alias("n_fields"), records.field_type(f, 1).cast("int").alias("kind"), F.decode(records.field(f, 1), "UTF-8").alias("second"), F.md5(records.field(f, 0)).alias("first_md5"))


@query("SELECT page_id AS id, page_id AS serial, (strlen(html) % 7)::DOUBLE AS label, (page_id % 5)::INTEGER AS label2, 0::BIGINT AS size, 0 AS n_fields FROM pages")
def meta_copy(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("serial"), (F.octet_length("html") % 7).alias("label"), (F.col("page_id") % 5).alias("label2"), "html")
    bare = records.copy_meta(records.make_records(t, [("html", records.NONE)]))
    return bare.select("id", "serial", F.col("label").cast("double").alias("label"), F.col("label2").cast("int").alias("label2"), "size", F.size("fields").alias("n_fields"))


_STREAM = M.SampleConfig(stratify=True, oversample=True, split=7, split_fold=3, perturb=True, dtype="uint8", channels=3, annotate=(1,), raw=(1,), transforms=({"type": "augment.flip", "horizontal": True}, {"type": "rasterize"}))


@query(_BALANCED + f""", v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, {sql_uniform('0.horizontal', 'vec_id')} < 0.5 AS f, vec_id % 4 AS ax, vec_id % 4 + 2 + vec_id % 3 AS bx, vec_id % 3 AS ay, vec_id % 3 + 3 AS by_ FROM embeddings),
g AS (SELECT draw, v.*, i, CASE WHEN f THEN 7 - i % 8 ELSE i % 8 END AS x, i // 8 AS y FROM o JOIN v ON o.serial = v.id, range(0, 64) t(i))
SELECT draw, id, i::INTEGER AS i, (floor(abs(e[y * 8 + x + 1]) * 100)::BIGINT % 256)::DOUBLE AS v, CASE WHEN x >= ax AND x < bx AND y >= ay AND y < by_ THEN (id % 3 + 1)::DOUBLE ELSE 0.0::DOUBLE END AS label, 3 AS channels, f AS flipped FROM g""")
def image_stream(spark, sf_dir):
    """Plan, records, decoding, transforms and facets of a stream in one: vectors as byte images, their rectangle as JSON."""
    t = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    byte = lambda x: F.lpad(F.hex(F.floor(F.abs(x.cast("double")) * 100).cast("long") % 256), 2, "0")
    matrix = records.raw_bytes(F.lit(0), F.lit(8), F.lit(8), F.lit(1), F.unhex(F.array_join(F.transform("embedding", byte), "")))
    box = F.struct((v % 4 / 8).alias("x"), (v % 3 / 8).alias("y"), ((2 + v % 3) / 8).alias("width"), F.lit(3 / 8).alias("height"))
    note = F.encode(F.to_json(F.struct(F.array(F.struct(F.lit("rect").alias("type"), (v % 3 + 1).alias("label"), box.alias("geometry"))).alias("shapes"))), "UTF-8")
    own = records.make_records(t.select(v.alias("id"), v.alias("serial"), "label", matrix.alias("image"), note.alias("note")), [("image", records.IMAGE), ("note", records.NONE)])
    plan = M.draw_order(records.index(own), _STREAM).select("draw", "id", "serial")
    done = decoded(M.with_payload(plan, own.select("serial", "fields")), _STREAM)
    flat = done.select(F.col("draw").cast("long").alias("draw"), "id", F.posexplode("label0.data").alias("i", "label"), "image0", F.col("image0.channels").alias("channels"))
    flipped = uniform("0.horizontal", F.col("id")) < 0.5
    return flat.select("draw", "id", "i", F.get("image0.data", F.col("i") * 3 + 1).alias("v"), "label", "channels", flipped.alias("flipped"))


@query(f"""WITH {_BYTES}, r AS (SELECT id, b, id % 4 AS x0, 2 + id % 2 * 2 AS w, id % 3 AS y0 FROM v),
s AS (SELECT count(*) AS n, avg(w / 4.0::DOUBLE) AS aspect FROM r),
z AS (SELECT n, CASE WHEN aspect < 1 THEN 2 ELSE floor(2 * aspect)::INTEGER END AS sw, CASE WHEN aspect < 1 THEN floor(2 / aspect)::INTEGER ELSE 2 END AS sh FROM s),
p AS (SELECT id, j, (SELECT avg(b[(y0 + j // 2 * 2 + dy) * 8 + x0 + j % 2 * (w // 2) + dx + 1]) FROM range(0, 2) a(dy), range(0, w // 2) c(dx)) AS m FROM r, range(0, 4) t(j))
SELECT -1 AS id, format('{{:02X}}{{:02X}}0000', n % 256, n // 256) || format('{{:02X}}000000', sw * sh) || '00000000' AS content FROM z WHERE n > 0
UNION ALL SELECT id, '0000' || string_agg(format('{{:02X}}00', round_even(m, 0)::INTEGER), '' ORDER BY j) FROM p GROUP BY id""")
def vector_dump(spark, sf_dir):
    """Vectors as byte images of 8 x 8 pixels with a marked box of 2 or 4 by 4."""
    v = F.col("vec_id")
    byte = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 100) % 256).cast("double"))
    x0, y0 = v % 4, v % 3
    inside = lambda i: (i % 8 >= x0) & (i % 8 < x0 + 2 + v % 2 * 2) & (F.floor(i / 8) >= y0) & (F.floor(i / 8) < y0 + 4)
    facet = lambda data: F.struct(F.lit(8).cast("long").alias("width"), F.lit(8).cast("long").alias("height"), F.lit(1).alias("channels"), data.alias("data"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(inside(i), 1.0).otherwise(0.0))
    own = table(spark, sf_dir, "embeddings").select(v.alias("serial"), facet(byte).alias("image"), facet(mask).alias("mask"))
    return samples.vector_samples(own, 2).select(F.col("place").alias("id"), F.hex("content").alias("content"))


@query("WITH " + _ranked_sql("label") + ", e AS (SELECT vec_id AS serial, row_number() OVER (ORDER BY " + sql_key("vec_id", "1") + """, vec_id) - 1 AS draw FROM embeddings)
SELECT (draw // 16) || '_0_' || (draw % 16) || '.png' AS name, CASE WHEN serial % 2 = 0 THEN 8 ELSE 16 END::BIGINT AS width, CASE WHEN serial % 2 = 0 THEN 8 ELSE 4 END::BIGINT AS height, 2 AS colours FROM e WHERE draw < 48""")
def batch_dump(spark, sf_dir):
    """The first three batches of an epoch as pictures, whose sizes are read from their bytes."""
    own = byte_images(spark, sf_dir)
    config = M.SampleConfig(channels=3, dtype="uint8", split=1, split_fold=-1)
    plan = M.draw_order(records.index(own), config).select("draw", "id", "serial")
    dumped = batch_pictures(decoded(M.with_payload(plan, own.select("serial", "fields")), config), 16, 3)
    number = lambda at, n: F.conv(F.hex(F.substring("content", at, n)), 16, 10).cast("long")
    return dumped.select("name", number(17, 4).alias("width"), number(21, 4).alias("height"), number(26, 1).cast("int").alias("colours"))


# --- cut images as records


def noted_images(spark, sf_dir):
    """Vectors as byte images of 8 x 8 pixels whose annotation is one rectangle, as records."""
    t = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    byte = lambda x: F.lpad(F.hex(F.floor(F.abs(x.cast("double")) * 100).cast("long") % 256), 2, "0")
    matrix = records.raw_bytes(F.lit(0), F.lit(8), F.lit(8), F.lit(1), F.unhex(F.array_join(F.transform("embedding", byte), "")))
    box = F.struct((v % 4 / 8).alias("x"), (v % 3 / 8).alias("y"), ((2 + v % 3) / 8).alias("width"), F.lit(3 / 8).alias("height"))
    note = F.encode(F.to_json(F.struct(F.array(F.struct(F.lit("rect").alias("type"), (v % 3 + 1).alias("label"), box.alias("geometry"))).alias("shapes"))), "UTF-8")
    return records.make_records(t.select(v.alias("id"), v.alias("serial"), "label", matrix.alias("image"), note.alias("note")), [("image", records.IMAGE), ("note", records.NONE)])


def _cut_rows(made, notes=True):
    """Pixels of cut records beside the box of their first shape."""
    own = made.withColumn("m", P.raw_decoder(made.sparkSession)(records.field(F.col("fields"), 0)))
    g = F.get(S.parse_annotation(F.decode(records.field(F.col("fields"), 1), "UTF-8")), F.lit(0))["geometry"]
    box = {"bx": g["x"], "by": g["y"], "bw": g["width"], "bh": g["height"]} if notes else {}
    rows = own.select(F.floor(F.col("serial") / cuts.MOST_CUTS).alias("id"), (F.col("serial") % cuts.MOST_CUTS).alias("cut"), F.col("m.width").alias("width"), F.col("m.height").alias("height"), *[r6(c).alias(n) for n, c in box.items()], F.posexplode("m.data").alias("i", "v"))
    return rows


_CUT = """v AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: floor(abs(x) * 100)::BIGINT % 256) AS e, vec_id % 4 AS ax, vec_id % 3 AS ay, 2 + vec_id % 3 AS aw, 3 AS ah FROM embeddings)"""
_NEAR4 = "round_even(" + " + ".join(f"abs({1 - dy} - (sy - y0)) * abs({1 - dx} - (sx - x0)) * e[least(greatest(y0 + {dy}, {{y1}}), {{y2}}) * 8 + least(greatest(x0 + {dx}, {{x1}}), {{x2}}) + 1]" for dy in (0, 1) for dx in (0, 1)) + ", 0)"


def _cut_sql(windows: str, box: bool = True, source: tuple[str, str, str, str] = ("0", "0", "8", "8")) -> str:
    """Cuts of ``windows`` (id, cut, fw, fh, x, y, w, h beside the columns of v): the source's part scaled to fw x fh, seen through the window."""
    x0, y0, sw, sh = source
    note = f", {sql_r6('CASE WHEN seen THEN (ax / 8.0 - x / fw::DOUBLE) / (w / fw::DOUBLE) END')} AS bx, {sql_r6('CASE WHEN seen THEN (ay / 8.0 - y / fh::DOUBLE) / (h / fh::DOUBLE) END')} AS by, {sql_r6('CASE WHEN seen THEN aw / 8.0 / (w / fw::DOUBLE) END')} AS bw, {sql_r6('CASE WHEN seen THEN ah / 8.0 / (h / fh::DOUBLE) END')} AS bh" if box else ""
    return f"""WITH {_CUT}, c AS ({windows}), s AS (SELECT *, least((ax + aw) / 8.0::DOUBLE, (x + w) / fw::DOUBLE) > greatest(ax / 8.0::DOUBLE, x / fw::DOUBLE) AND least((ay + ah) / 8.0::DOUBLE, (y + h) / fh::DOUBLE) > greatest(ay / 8.0::DOUBLE, y / fh::DOUBLE) AS seen FROM c WHERE w > 0 AND h > 0),
p AS (SELECT *, least(greatest((x + i % w + 0.5::DOUBLE) * ({sw}) / fw - 0.5::DOUBLE, 0), ({sw}) - 1) + ({x0}) AS sx, least(greatest((y + i // w + 0.5::DOUBLE) * ({sh}) / fh - 0.5::DOUBLE, 0), ({sh}) - 1) + ({y0}) AS sy FROM s, range(0, 5000) t(i) WHERE i < w * h),
k AS (SELECT *, floor(sx)::BIGINT AS x0, floor(sy)::BIGINT AS y0 FROM p)
SELECT id, cut::BIGINT AS cut, w::BIGINT AS width, h::BIGINT AS height{note}, i::INTEGER AS i, {_NEAR4.format(x1=x0, y1=y0, x2=f"({x0}) + ({sw}) - 1", y2=f"({y0}) + ({sh}) - 1")}::DOUBLE AS v FROM k"""


@query(_cut_sql("SELECT *, gy * 4 + gx AS cut, 12 AS fw, 12 AS fh, least(gx * 3, 7) AS x, least(gy * 3, 7) AS y, 5 AS w, 5 AS h FROM v, range(0, 4) a(gx), range(0, 4) b(gy)"))
def cut_tiles(spark, sf_dir):
    """Tiles of 5 pixels every 3 of images that are half as large again, with pixels and what their annotation shows there."""
    return _cut_rows(cuts.tiles(noted_images(spark, sf_dir), 5, 3, 1.5))


@query(_cut_sql("SELECT *, 0 AS cut, 2 * aw AS fw, 2 * ah AS fh, 0 AS x, 0 AS y, 2 * aw AS w, 2 * ah AS h FROM v", False, ("ax", "ay", "aw", "ah")))
def cut_crops(spark, sf_dir):
    return _cut_rows(cuts.crops(noted_images(spark, sf_dir), 2.0), False)


_SIDES = ", ".join(f"least(o{d} + greatest({{side}} - o{d}, 0), f{d}) AS {d}" for d in "wh")
_CORNERS = ", ".join(f"greatest(0, least(o{o} - greatest({{side}} - o{d}, 0) // 2, f{d} - {d})) AS {o}" for o, d in (("x", "w"), ("y", "h")))
_FITTED = ", ".join(f"floor(a{k} / 8.0::DOUBLE * f{d})::BIGINT AS o{k}" for k, d in (("x", "w"), ("y", "h"), ("w", "w"), ("h", "h")))


@query(_cut_sql(f"SELECT *, {_CORNERS.format(side='12')} FROM (SELECT *, {_SIDES.format(side='12')} FROM (SELECT *, {_FITTED} FROM (SELECT *, 0 AS cut, round(8 * (10 / sqrt(aw * ah)))::BIGINT AS fw, round(8 * (10 / sqrt(aw * ah)))::BIGINT AS fh FROM v)))"))
def cut_patches(spark, sf_dir):
    """Patches about shapes of images scaled so that the shapes have a like size."""
    return _cut_rows(cuts.patches(noted_images(spark, sf_dir), 10, 12))


@query(_cut_sql(f"SELECT *, {_CORNERS.format(side='side')} FROM (SELECT *, {_SIDES.format(side='side')} FROM (SELECT *, greatest(floor(sqrt(ow * oh) / 4 * 6)::BIGINT, 4) AS side FROM (SELECT *, {_FITTED} FROM (SELECT *, 0 AS cut, 8 AS fw, 8 AS fh FROM v))))"))
def cut_patches_unscaled(spark, sf_dir):
    return _cut_rows(cuts.patches(noted_images(spark, sf_dir), 4, 6, False, 4))


@query(_cut_sql("SELECT v.*, 0 AS cut, 8 AS fw, 8 AS fh, greatest(0, least(ax - (side - aw) // 2, 8 - side)) AS x, greatest(0, least(ay - (side - ah) // 2, 8 - side)) AS y, side AS w, side AS h FROM (SELECT *, CASE WHEN aw * ah < 0.5 * 64 THEN round(8 * sqrt(aw * ah / (0.5::DOUBLE * 64)))::BIGINT ELSE 8 END AS side FROM v) v"))
def cut_zoomed(spark, sf_dir):
    return _cut_rows(cuts.zoomed(noted_images(spark, sf_dir), 0.5))


_FIT = "least(greatest((i % tw + 0.5::DOUBLE) * w / tw - 0.5::DOUBLE, 0), w - 1) AS sx, least(greatest((i // tw + 0.5::DOUBLE) * h / th - 0.5::DOUBLE, 0), h - 1) AS sy"
_FIT4 = " + ".join(f"abs({1 - dy} - (sy - y0)) * abs({1 - dx} - (sx - x0)) * e[least(y0 + {dy}, h - 1) * w + least(x0 + {dx}, w - 1) + 1]" for dy in (0, 1) for dx in (0, 1))


def _fit_sql(width: str, height: str) -> str:
    return f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 16 END AS w, CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 4 END AS h FROM embeddings),
t AS (SELECT *, {width} AS tw, {height} AS th FROM v), g AS (SELECT *, {_FIT} FROM t, range(0, 128) r(i) WHERE i < tw * th), k AS (SELECT *, floor(sx)::BIGINT AS x0, floor(sy)::BIGINT AS y0 FROM g)
SELECT id, tw::BIGINT AS width, th::BIGINT AS height, (i * 3 + c)::INTEGER AS i, {sql_r6(_FIT4)} AS v FROM k, range(0, 3) u(c)"""


def unlike_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as grey images of 8 x 8 pixels (even ids) or 16 x 4."""
    v = F.col("vec_id")
    size = lambda a, b: F.when(v % 2 == 0, a).otherwise(b).cast("long")
    image = F.struct(size(8, 16).alias("width"), size(8, 4).alias("height"), F.lit(1).alias("channels"), F.col("embedding").cast("array<double>").alias("data"))
    return table(spark, sf_dir, "embeddings").select(v.alias("id"), v.alias("serial"), image.alias("image0"))


def _fitted(rows, mode):
    """In batches of five, in one shape of three channels; rows that only fill a batch (``pad``) are not shown."""
    made = transcode.fitted(rows, 5, mode, channels=3, dtype="float32").where("not pad")
    return made.select("id", "image0.width", "image0.height", F.posexplode("image0.data").alias("i", "v")).withColumn("v", r6(F.col("v")))


@query(_fit_sql("CASE WHEN id // 5 % 2 = 0 THEN 8 ELSE 16 END", "CASE WHEN id // 5 % 2 = 0 THEN 8 ELSE 4 END"))
def fit_first(spark, sf_dir):
    return _fitted(unlike_images(spark, sf_dir).withColumns({"draw": F.col("serial"), "pad": F.lit(False)}), "first")


@query(_fit_sql("16", "8"))
def fit_largest(spark, sf_dir):
    """Every batch is full, as its SQL has it: draws count the ids without gaps, and the first rows, drawn again, fill the last batch."""
    plan = M.draw_order(embeddings(spark, sf_dir).select("serial").distinct(), M.SampleConfig(shuffle=False))
    return _fitted(M.with_payload(M.padded(plan, 5), unlike_images(spark, sf_dir)), "largest")


_CELLS_SQL = """{k}c AS (SELECT image, least(greatest(x, 0), 1) AS x0, least(greatest(x + {f} * w, 0), 1) AS x1, least(greatest(y, 0), 1) AS y0, least(greatest(y + {f} * h, 0), 1) AS y1 FROM b),
{k}x AS (SELECT image, v AS a, lead(v) OVER (PARTITION BY image ORDER BY v) AS z FROM (SELECT DISTINCT image, unnest([x0, x1]) AS v FROM {k}c)), {k}y AS (SELECT image, v AS a, lead(v) OVER (PARTITION BY image ORDER BY v) AS z FROM (SELECT DISTINCT image, unnest([y0, y1]) AS v FROM {k}c)),
{k}r AS (SELECT i.image, coalesce(sum(s.area), 0) AS roi FROM (SELECT DISTINCT image FROM b) i LEFT JOIN (SELECT DISTINCT p.image, p.a, q.a AS d, (p.z - p.a) * (q.z - q.a) AS area FROM {k}x p JOIN {k}y q ON p.image = q.image JOIN {k}c c ON c.image = p.image AND c.x0 <= p.a AND c.x1 >= p.z AND c.y0 <= q.a AND c.y1 >= q.z) s ON i.image = s.image GROUP BY i.image)"""


@query("WITH " + BOX + ", " + _CELLS_SQL.format(k="f", f="1.0::DOUBLE") + f" SELECT image, {sql_r6('roi')} AS roi FROM fr")
def roi_union(spark, sf_dir):
    """The share of an image that its overlapping boxes cover together."""
    return profile.union_area(boxes(spark, sf_dir)).withColumn("roi", r6(F.col("roi")))


@query("WITH " + BOX + ", " + _CELLS_SQL.format(k="f", f="1.0::DOUBLE") + ", " + _CELLS_SQL.format(k="s", f="0.5::DOUBLE") + f", j AS (SELECT fr.roi AS roi, CASE WHEN fr.roi > 0 THEN sqrt(sr.roi / fr.roi) END AS scale FROM fr JOIN sr ON fr.image = sr.image) SELECT {sql_r6('avg(roi)')} AS mean_share, {sql_r6('stddev_pop(roi)')} AS dev_share, {sql_r6('avg(scale)')} AS mean_scale, {sql_r6('stddev_pop(scale)')} AS dev_scale, count(*) AS images FROM j")
def roi_scale(spark, sf_dir):
    """Boxes against the same boxes with half the sides."""
    own = boxes(spark, sf_dir)
    half = own.withColumns({"w": F.col("w") * 0.5, "h": F.col("h") * 0.5})
    return profile.roi_stats(own, half).select(*[r6(F.col(c)).alias(c) for c in ("mean_share", "dev_share", "mean_scale", "dev_scale")], "images")



def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced training batches: stratified 7-fold split, oversampled round robin, batches of 32."""
    return batch_meta(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)

