"""Records, sampling plans, geometry, images, targets and delivery: invariants, hand-made goldens and small literals."""

import math
import os
import random
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplery.functions import images, pixels, shapes, sizes
from samplery.operators import anchors, datasets, profile
from samplery.plans import ordering, sampling, transforms
from samplery.plans.sampling import SampleConfig
from samplery.sources import exports, records
from samplery.streaming import delivery


@pytest.fixture(scope="module")
def index(spark):
    """853 records, label floor(sqrt(i)) mod 5."""
    return spark.range(853).select(F.col("id"), F.col("id").alias("serial"), (F.floor(F.sqrt("id")) % 5).cast("int").alias("label"), (F.floor(F.sqrt("id")) % 5).cast("int").alias("grp"), (F.col("id") % 17).alias("size")).cache()


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


# --- plans


def test_label_counts_and_fold_sizes(index):
    assert {r["grp"]: r["rows"] for r in profile.stat(index).collect()} == {0: 156, 1: 168, 2: 180, 3: 192, 4: 157}
    train, val = (sampling.split(index, SampleConfig(stratify=True, split=7, split_fold=3, split_negate=n)) for n in (False, True))
    assert [v for _, v in sorted((r["grp"], r["count"]) for r in val.groupBy("grp").count().collect())] == [23, 24, 25, 27, 22]
    a, b = {r["id"] for r in train.collect()}, {r["id"] for r in val.collect()}
    assert not a & b and len(a | b) == 853 and len(a) == 732
    assert sampling.split(index, SampleConfig(split=7, split_fold=3)).count() == 731
    assert sampling.split(index, SampleConfig(split=7, split_fold=9)).count() == 853


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_bucketed_ranks_are_plain_ranks(spark, digits):
    rng = random.Random(digits)
    rows = [(k, rng.randrange(3), "%032x" % rng.getrandbits(128), rng.randrange(9)) for k in range(500)]
    got = ordering.ranked(spark.createDataFrame(rows, "id long, g int, key string, size long"), "key", ["id"], ("g",), F.col("size"), digits).collect()
    for g in range(3):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        mine = {r["id"]: r for r in got if r["g"] == g}
        before = 0
        for pos, r in enumerate(own):
            assert (mine[r[0]]["pos"], mine[r[0]]["n"], mine[r[0]]["before"]) == (pos, len(own), before)
            before += r[3]


def test_plans_do_not_depend_on_partitions(index):
    config = SampleConfig(stratify=True, oversample=True, split=5, split_fold=1)
    assert pairs(sampling.draw_order(index, config), "draw", "id") == pairs(sampling.draw_order(index.repartition(13), config), "draw", "id")


def simulate(groups, draws, loop):
    """Round robin over (group, ordered ids per epoch)."""
    live = {g: [0, 0] for g in sorted(groups)}
    out = []
    while live and len(out) < draws:
        for g in sorted(live):
            if g not in live or len(out) >= draws:
                continue
            turn, epoch = live[g]
            own = groups[g](epoch)
            if turn == len(own):
                if not loop:
                    del live[g]
                    continue
                epoch, turn, own = epoch + 1, 0, groups[g](epoch + 1)
            out.append(own[turn])
            live[g] = [turn + 1, epoch]
    return out


@pytest.mark.parametrize("reshuffle", [False, True])
def test_draws_are_those_of_a_round_robin(spark, reshuffle):
    import hashlib

    rng = random.Random(1)
    rows = [(k, rng.choice([0, 1, 1, 1, 4])) for k in range(60)]
    table = spark.createDataFrame(rows, "serial long, grp int")

    def own(g):
        return lambda e: sorted((s for s, x in rows if x == g), key=lambda s: (hashlib.md5(f"2016:{e if reshuffle else 0}:{s}".encode()).hexdigest(), s))

    groups = {g: own(g) for g in {x for _, x in rows}}
    config = SampleConfig(stratify=True, oversample=True, reshuffle=reshuffle)
    assert [s for _, s in pairs(sampling.looped_draws(table, config, 250), "draw", "serial")] == simulate(groups, 250, True)
    if not reshuffle:
        assert [s for _, s in pairs(sampling.draw_order(table, config), "draw", "serial")] == simulate(groups, 10**6, False)
    assert pairs(delivery.endless(table, config, 100, 50), "draw", "serial") == pairs(sampling.looped_draws(table, config, 150), "draw", "serial")[100:]


def test_balance_of_a_long_stream(index):
    config = SampleConfig(stratify=True, oversample=True, split=7, split_fold=3)
    counts = [r["count"] for r in sampling.looped_draws(index, config, 38070).groupBy("label").count().collect()]
    assert max(counts) - min(counts) <= 1
    ids = [r["count"] for r in sampling.looped_draws(index, SampleConfig(split=7, split_fold=3), 7310).groupBy("id").count().collect()]
    assert len(ids) == 731 and set(ids) == {10}


def test_pooled_order_is_a_permutation(index):
    got = pairs(sampling.draw_order(index, SampleConfig()), "draw", "id")
    assert [d for d, _ in got] == list(range(853)) and sorted(i for _, i in got) == list(range(853)) and [i for _, i in got] != list(range(853))
    plain = pairs(sampling.draw_order(index, SampleConfig(shuffle=False)), "draw", "id")
    assert [i for _, i in plain] == list(range(853))


def test_config_refuses_impossible_folds():
    for bad in ({"split": 0}, {"split_fold": 1}, {"split_negate": True}, {"split": 3, "split_keys": (1,)}, {"split": 3, "split_fold": -1, "split_keys": (3,)}, {"channels": 2}):
        with pytest.raises(ValueError):
            SampleConfig(**bad)
    assert SampleConfig(split=4, split_fold=-1, split_keys=(2, 0, 2)).folds == (0, 2)


def test_mixin_kfold_budget_and_batches(spark, index):
    mixed = sampling.mixin(index.select("serial", "grp"), index.select("serial", "grp"), group_reset=7, group_delta=1, most=10)
    assert pairs(mixed.where("file = 1"), "serial", "grp") == [(k, 8) for k in range(10)]
    parts = sampling.kfold(index, 5, 2, most_test=50)
    assert parts.where("part = 'test'").count() == 50 and parts.count() == 853
    total = sum(k % 17 for k in range(853))
    assert sampling.byte_budget_sample(index, total).count() == 853
    some = [r["size"] for r in sampling.byte_budget_sample(index, 1000).collect()]
    assert 1000 <= sum(some) < 1017
    batches = sampling.batches(sampling.draw_order(index, SampleConfig()), 100, ("id",)).orderBy("batch").collect()
    assert [b["rows"] for b in batches] == [100] * 8 + [53]
    usable = sampling.categories_usable(index).first()
    assert usable["usable"] and usable["categories"] == 5
    assert not sampling.categories_usable(index.limit(0)).first()["usable"]


# --- records


def test_records_round_trip(spark, tmp_path):
    rows = spark.range(50).select("id", F.col("id").alias("serial"), (F.col("id") % 3).alias("label"), F.col("id").cast("string").cast("binary").alias("a"), F.when(F.col("id") % 2 == 0, F.lit(b" {}")).alias("b"))
    made = records.make_records(rows, [("a", records.IMAGE), ("b", records.ANNOTATION_JSON)])
    records.write(made, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists"):
        records.write(made, str(tmp_path / "t"))
    reader = records.Reader(spark, str(tmp_path / "t"))
    assert len(reader) == 50 and [r["id"] for r in reader] == list(range(50))
    assert bytes(reader.read(7)["fields"][0]["bytes"]) == b"7" and len(reader.read(7)["fields"]) == 1
    with pytest.raises(IndexError):
        reader.read(50)
    read = reader.records.select(records.field(F.col("fields"), 1).alias("f"), records.field_type(F.col("fields"), 1).alias("t"), "id").collect()
    assert all((bytes(r["f"]), r["t"]) == ((b" {}", 3) if r["id"] % 2 == 0 else (b"", 0)) for r in read)
    assert "fields" not in records.index(reader.records).columns


def test_ids_follow_the_order(spark):
    rows = [(k * 37 % 101, "x") for k in range(101)]
    got = records.auto_id(spark.createDataFrame(rows, "k long, x string").repartition(5), ["k"], start=5)
    assert pairs(got, "k", "id") == [(k, k + 5) for k in range(101)]


def test_imports(spark, tmp_path):
    for label in (0, 1):
        os.makedirs(tmp_path / "c" / str(label))
        for k in range(3):
            (tmp_path / "c" / str(label) / f"{k}.bin").write_bytes(bytes([label, k]))
    root = str(tmp_path / "c")
    assert pairs(records.import_directory(spark, root), "id", "label") == [(k, 0.0) for k in range(6)]
    assert [x for _, x in pairs(records.import_classes(spark, root), "id", "label")] == [0.0] * 3 + [1.0] * 3
    (tmp_path / "list").write_text("0/0.bin\t4\n1/2.bin\t5.5\nbad line\n0/missing.bin\t1\n0/1.bin\tx\n")
    assert pairs(records.import_list(spark, str(tmp_path / "list"), root), "label") == [(4.0,), (5.5,)]
    (tmp_path / "masks").write_text("0/0.bin\t1/1.bin\n0/1.bin\t\n")
    assert sorted(len(r["fields"]) for r in records.import_list(spark, str(tmp_path / "masks"), root, "mask").collect()) == [1, 2]
    (tmp_path / "json").write_text('0/0.bin\t{"shapes":[]}\n')
    assert records.import_list(spark, str(tmp_path / "json"), root, "json").first()["fields"][1]["type"] == records.ANNOTATION_JSON
    for n in (0, 1):
        with tarfile.open(tmp_path / f"{n}.tar", "w") as t:
            t.add(root, "in")
    assert [x for _, x in pairs(records.import_tars(spark, [str(tmp_path / "1.tar"), str(tmp_path / "0.tar")]), "id", "label")] == [0.0] * 6 + [1.0] * 6
    (tmp_path / "cifar.bin").write_bytes(b"".join(bytes([k]) + bytes(3 * 4) for k in range(5)))
    assert pairs(records.import_cifar(spark, str(tmp_path / "cifar.bin"), side=2), "id", "label") == [(k, float(k)) for k in range(5)]
    (tmp_path / "i.idx").write_bytes(struct.pack(">4I", 0x803, 3, 2, 2) + bytes(range(12)))
    (tmp_path / "l.idx").write_bytes(struct.pack(">2I", 0x801, 3) + bytes([9, 8, 7]))
    assert pairs(records.import_idx(spark, str(tmp_path / "i.idx"), str(tmp_path / "l.idx")), "id", "label") == [(0, 9.0), (1, 8.0), (2, 7.0)]
    os.rename(tmp_path / "c" / "1", tmp_path / "c" / "2")
    with pytest.raises(ValueError):
        records.import_classes(spark, root)


@pytest.mark.parametrize("kind", records.DEPTHS)
def test_raw_matrices(kind):
    for shape in ((2, 3), (2, 3, 3)):
        m = np.arange(np.prod(shape)).reshape(shape).astype(kind)
        assert (records.decode_raw(records.encode_raw(m)) == m).all()
    with pytest.raises(ValueError):
        records.decode_raw(records.encode_raw(m)[:-1])
    with pytest.raises(ValueError):
        records.encode_raw(np.zeros(3))


def test_png_decodes_through_the_image_source(spark, tmp_path):
    raw = b"".join(b"\0" + bytes([10 * (y * 3 + x) for x in range(3)]) for y in range(2))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    image = spark.read.format("image").load(str(tmp_path)).first()["image"]
    assert (image["height"], image["width"], image["nChannels"]) == (2, 3, 1) and bytes(image["data"]) == bytes(range(0, 60, 10))


# --- geometry


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_shapes(spark):
    text = '  {"shapes":[{"type":"rect","label":[1,2],"geometry":{"x":0.1,"y":0.2,"width":0.3,"height":0.4},"odd":1},{"type":"point","tag":2,"geometry":{"x":0.5,"y":0.5}}]}'
    r = values(spark, s=shapes.parse_annotation(F.lit(text)), none=shapes.parse_annotation(F.lit("")), kind=records.sniff(F.lit(text)), other=records.sniff(F.lit("\x89PNG")), a=shapes.label_channels(F.lit("[1,2]")), b=shapes.label_channels(F.lit("3")), c=shapes.label_channels(F.lit(None).cast("string")))
    assert [s["type"] for s in r["s"]] == ["rect", "point"] and not r["none"] and (r["kind"], r["other"]) == (3, 2)
    assert (r["a"], r["b"], r["c"]) == ([1, 2, 0, 0], [3] * 4, [1] * 4)
    rect = shapes.rect_controls(*[F.lit(float(v)) for v in (10, 20, 30, 10)])
    quarter = shapes.refit_rect(shapes.rotate(rect, F.lit(100), F.lit(100), F.lit(90.0)))
    b = values(spark, b=shapes.bbox(quarter), same=shapes.bbox(shapes.refit_rect(rect)), flip=shapes.bbox(shapes.flip(rect, F.lit(100), F.lit(50), F.lit(True), F.lit(True), F.lit(True))), a=shapes.bbox(shapes.arect_controls(*[F.lit(float(v)) for v in (20, 20, 10, 6, 0)])))
    assert (b["b"]["w"], b["b"]["h"]) == (pytest.approx(10), pytest.approx(30))
    assert [b["same"][k] for k in "xywh"] == pytest.approx([10, 20, 30, 10])
    assert [b["flip"][k] for k in "xywh"] == pytest.approx([20, 60, 10, 30])
    assert [b["a"][k] for k in "xywh"] == pytest.approx([15, 17, 10, 6])


def test_sizes(spark):
    w, h = F.lit(200), F.lit(100)
    r = values(spark, a=F.array(*sizes.resize(w, h, 160, 100)), b=F.array(*sizes.resize(w, h, 400, 150)), c=F.array(*sizes.limit(w, h, 150, 100)), d=F.array(*sizes.import_limit(w, h, 50)), e=F.array(*sizes.clip_square(w, h, F.lit(90))), f=sizes.round_size(F.lit(37), 8, 3), g=F.array(*sizes.grid(F.lit(160), 64, 48)), z=sizes.annotation_zoom(w, h, F.lit(90), F.lit(40), F.lit(20), F.lit(20), 0.1))
    assert r["a"] == [160, 80] and r["b"] == [300, 150] and r["c"] == [200, 100] and r["d"] == [100, 50]
    assert r["e"] == [100, 100, 0] and r["f"] == 35 and r["g"] == [3, 48]
    assert r["z"].asDict() == {"x": 56, "y": 28, "w": 89, "h": 45}


def test_grids_leave_no_gap(spark):
    rows = [(w, 100) for w in (10, 64, 65, 100, 111, 112, 113, 500)]
    tiles = datasets.grid_tiles(spark.createDataFrame(rows, "width long, height long"), 64, 48).collect()
    for w, _ in rows:
        own = sorted({(t["tile_x"], t["tile_x"] + t["tile_w"]) for t in tiles if t["width"] == w})
        assert own[0][0] == 0 and own[-1][1] == w and all(b[0] <= a[1] for a, b in zip(own, own[1:], strict=False))


def test_clip_axis(spark):
    cases = {"plain": (100, 0, 0), "crop": (100, 10, 5), "round": (100, 0, 0, 0, 0, 16), "most": (100, 0, 0, 0, 60, 0, 0, 7), "least": (50, 0, 0, 80, 0, 0, 0, 5), "shift": (100, 0, 0, 0, 0, 0, -4), "kept": (100, 30, 30, 60), "handed": (100, 0, 6, 100)}
    r = {}
    for name, own in cases.items():
        s, c1, c2, least, most, multiple, shift, draw = (*own, *[0] * 8)[:8]
        whole = [F.lit(v).cast("long") for v in (s, c1, c2, shift, draw)]
        got = sizes.clip_axis(spark.range(1), "k", *whole[:3], least, most, multiple, *whole[3:]).first()
        r[name] = [got[f"k{k}"] for k in ("size", "begin", "length", "to")]
    assert r["plain"] == [100, 0, 100, 0] and r["crop"] == [85, 10, 85, 0] and r["round"] == [96, 0, 96, 0]
    assert r["most"] == [60, 7, 60, 0] and r["least"] == [80, 0, 50, 5] and r["shift"] == [100, 0, 96, 4] and r["kept"] == [60, 20, 60, 0] and r["handed"] == [100, 0, 100, 0]


def test_pipelines(spark):
    rect = shapes.rect_controls(*[F.lit(float(v)) for v in (10, 20, 30, 10)])
    rows = spark.range(40).select(F.col("id").alias("serial"), F.lit(100).cast("long").alias("width"), F.lit(60).cast("long").alias("height"), F.array(F.struct(F.lit("rect").alias("type"), rect.alias("controls"))).alias("shapes"))
    steps = [{"type": "augment.flip", "horizontal": True, "transpose": True}, {"type": "augment.rotate", "range": 10}, {"type": "sometimes", "chance": 0.5, "transforms": [{"type": "augment.scale", "min": 2, "max": 2}]}, {"type": "some_of", "count": 1, "transforms": [{"type": "augment.flip", "vertical": True}, {"type": "augment.scale", "range": 0.1}]}, {"type": "clip", "round": 16}]
    plain = transforms.apply(rows, steps, SampleConfig()).collect()
    assert all((r["width"], r["height"]) == (96, 48) for r in plain)
    one = transforms.apply(rows, steps, SampleConfig(perturb=True))
    two = transforms.apply(rows.repartition(7), steps, SampleConfig(perturb=True))
    key = lambda df: sorted((r["serial"], r["width"], r["height"], str(r["shapes"])) for r in df.collect())
    assert key(one) == key(two) and len({r[1] for r in key(one)}) > 2 and len(key(one)) == 40
    with pytest.raises(NotImplementedError):
        transforms.validate([{"type": "augment.affine"}])
    with pytest.raises(ValueError):
        transforms.validate([{"type": "anchors.dense.box"}, {"type": "resize", "size": 3}])
    with pytest.raises(ValueError):
        transforms.validate([{"type": "no such thing"}])
    with pytest.raises(Exception, match="does not fit"):
        transforms.apply(rows, [{"type": "pad", "size": 80}], SampleConfig()).collect()
    moved = transforms.apply(rows, [{"type": "random_square_clip", "size": 80, "center": 1}, {"type": "clip_square"}, {"type": "resize", "size": 40}, {"type": "scale", "scale": 0.5}], SampleConfig()).first()
    assert (moved["width"], moved["height"]) == (20, 20)
    assert [round(moved["shapes"][0]["controls"][0][k], 6) for k in "xy"] == [0.0, 7.5]


def test_pixel_steps(spark):
    rows = spark.range(30).select(F.col("id").alias("serial"), F.lit(2).cast("long").alias("width"), F.lit(1).cast("long").alias("height"), F.array(F.lit(10.0), F.lit(20.0)).alias("image"))
    steps = [{"type": "normalize", "mean": [10, 0], "std": 2}, {"type": "mask", "value": 3}, {"type": "featurize"}]
    r = transforms.apply(rows, steps, SampleConfig()).first()
    assert r["image"] == [0, 5] and r["mask"] == [3, 3] and [f["kind"] for f in r["facets"]] == ["IMAGE", "FEATURE"]
    dropped = transforms.apply(rows, [*steps, {"type": "drop", "index": 0}], SampleConfig()).first()
    assert dropped["image"] is None and [f["kind"] for f in dropped["facets"]] == ["NONE", "FEATURE"]
    same = transforms.apply(rows, [{"type": "augment.add", "range": 5}, {"type": "augment.flip_color"}], SampleConfig()).first()
    assert same["image"] == [10, 20]
    some = [r["image"] for r in transforms.apply(rows, [{"type": "augment.add", "range": 5}, {"type": "augment.flip_color"}], SampleConfig(perturb=True)).collect()]
    assert all(abs(a - 10) <= 5 or abs(255 - a - 10) <= 5 for a, _ in some) and len({a for a, _ in some}) == 30 and {a > 128 for a, _ in some} == {True, False}
    with pytest.raises(ValueError, match="no facet"):
        transforms.apply(rows, [{"type": "drop", "index": 1}], SampleConfig())


def annotated(spark, boxes, w, h, **columns):
    """One row with rectangles (x, y, w, h in pixels), their labels and tags."""
    shape = lambda k, b: F.struct(F.lit("rect").alias("type"), F.lit(float(k + 1)).alias("label"), F.lit(float(10 * k)).alias("tag"), shapes.rect_controls(*[F.lit(float(v)) for v in b]).alias("controls"))
    return spark.range(1).select(F.col("id").alias("serial"), F.lit(w).cast("long").alias("width"), F.lit(h).cast("long").alias("height"), F.array(*[shape(k, b) for k, b in enumerate(boxes)]).alias("shapes"), *[F.array(*[F.lit(float(x)) for x in v]).alias(k) for k, v in columns.items()])


def targets(row):
    return {t["name"]: t for t in row["targets"]}


def test_no_step_is_skipped(spark):
    rows = annotated(spark, [(1, 1, 4, 4)], 8, 8)
    for kind in ("augment.no such step", "anchors.sparse", "resize2", "colour"):
        with pytest.raises(ValueError, match="unknown transform"):
            transforms.apply(rows, [{"type": kind}], SampleConfig())
        with pytest.raises(ValueError, match="unknown transform"):
            transforms.apply(rows, [{"type": "sometimes", "transforms": [{"type": kind}]}], SampleConfig())
    steps = ("colorspace", "pyramid", "anchors.dense.point", "anchors.dense.circle", "anchors.dense.box", "box_feature", "keypoints.basic", "rasterize", "erode_mask", "augment.blur")
    assert set(steps) <= set(transforms.REGISTRY)


@pytest.mark.parametrize("kind", ["point", "circle", "box"])
def test_anchor_steps_are_the_operator(spark, kind):
    boxes = [(3, 5, 20, 11), (30, 2, 9, 25), (28, 3, 16, 16)]
    priors = [[20, 10], [8, 8]] if kind == "box" else []
    rows = annotated(spark, boxes, 64, 32)
    if kind == "point":
        with pytest.raises(Exception, match="one point"):
            transforms.apply(rows, [{"type": "anchors.dense.point", "downsize": 4}], SampleConfig()).collect()
        rows = rows.withColumn("shapes", F.transform("shapes", lambda s: s.withField("controls", F.slice(s["controls"], 1, 1))))
    row = transforms.apply(rows, [{"type": f"anchors.dense.{kind}", "downsize": 4, "priors": priors, "upper_th": 0.3, "lower_th": 0.01, "weighted": True, "params_default": -1}], SampleConfig()).first()
    table = spark.createDataFrame([(0, k, x / 64, y / 32, w / 64, h / 32, 64, 32) for k, (x, y, w, h) in enumerate(boxes)], "image long, serial int, x double, y double, w double, h double, width long, height long")
    pics = spark.createDataFrame([(0, 64, 32)], "image long, width long, height long")
    want = anchors.dense_anchors(pics, table, kind, 4, 0.3, 0.01, True, -1.0, [tuple(map(float, p)) for p in priors]).orderBy("cy", "cx", "prior").collect()
    got = targets(row)
    assert (got["anchors.label"]["width"], got["anchors.label"]["height"], got["anchors.label"]["channels"]) == (16, 8, max(1, len(priors)))
    for name in ("label", "label_mask", "params_mask"):
        assert got[f"anchors.{name}"]["data"] == pytest.approx([r[name] for r in want])
    assert got["anchors.params"]["data"] == pytest.approx([v for r in want for v in r["params"]])
    assert sum(r["label"] for r in want) > 0
    with pytest.raises(Exception, match="not a multiple"):
        transforms.apply(rows.withColumn("width", F.lit(63).cast("long")), [{"type": f"anchors.dense.{kind}", "downsize": 4}], SampleConfig()).collect()


def test_points_are_anchored(spark):
    """A point has no area; its nearest cell gets the label."""
    pics = spark.createDataFrame([(1, 16, 8)], "image long, width long, height long")
    own = spark.createDataFrame([(1, 0, 0.5, 0.5, None, None, 16, 8), (1, 1, None, 0.5, 0.0, 0.0, 16, 8)], "image long, serial int, x double, y double, w double, h double, width long, height long")
    got = anchors.dense_anchors(pics, own, "point", 4, 0.9, 0.01).collect()
    assert len(got) == 8 and [(r["cy"], r["cx"], r["params"]) for r in got if r["label"] == 1] == [(1, 2, [0.0, 0.0])]


def test_target_and_mask_steps(spark):
    rows = annotated(spark, [(1, 1, 3, 2), (4, 3, 20, 20), (9, 9, 1, 1)], 8, 6)
    row = transforms.apply(rows, [{"type": "box_feature", "min_area": 3}, {"type": "keypoints.basic", "classes": 2, "downsize": 2, "radius": 1.5}, {"type": "rasterize", "use_serial": True}, {"type": "erode_mask", "index": 1, "radius": 1}, {"type": "mask", "value": 3}, {"type": "erode_mask", "radius": 1, "iterations": 2}], SampleConfig()).first()
    got = targets(row)
    assert got["box_feature"]["data"] == [1, 0, 1, 1, 4, 3, 2, 10, 4, 3, 7, 5] and (got["box_feature"]["width"], got["box_feature"]["height"]) == (6, 2)
    mask, offset = np.zeros((3, 4, 2)), np.zeros((3, 4, 2, 2))
    for label, points in ((0, [(1, 1), (4, 3), (4, 1), (1, 3)]), (1, [(4, 3), (24, 23), (24, 3), (4, 23)])):
        for px, py in points:
            for y in range(3):
                for x in range(4):
                    if math.hypot(px - 2 * x, py - 2 * y) <= 1.5:
                        mask[y, x, label], offset[y, x, label] = 1, (px - 2 * x, py - 2 * y)
    assert got["keypoints.mask"]["data"] == mask.ravel().tolist() and got["keypoints.offset"]["data"] == offset.ravel().tolist() and got["keypoints.offset"]["channels"] == 4
    drawn = np.zeros((6, 8))
    drawn[1:3, 1:4] = 1
    drawn[3:, 4:] = 2
    padded = np.pad(drawn, 1, constant_values=1.0)
    assert row["raster"] == [padded[y : y + 3, x : x + 3].min() for y in range(6) for x in range(8)] and row["shapes"] == []
    inner = np.full((6, 8), 1.0)
    inner[2:4, 2:6] = 3
    assert row["mask"] == inner.ravel().tolist()
    outline = transforms.apply(annotated(spark, [(2, 2, 4, 4)], 8, 8), [{"type": "rasterize", "thickness": 2, "use_tag": True}, {"type": "rasterize"}], SampleConfig()).first()["raster"]
    assert set(outline) == {0.0}
    over = transforms.apply(annotated(spark, [(2, 2, 4, 4)], 8, 8, image=[5] * 64), [{"type": "rasterize", "thickness": 2, "copy": 0}], SampleConfig()).first()["raster"]
    assert np.array(over).reshape(8, 8)[3:5, 3:5].tolist() == [[5, 5], [5, 5]] and over.count(1.0) == 32
    with pytest.raises(ValueError, match="no mask"):
        transforms.apply(rows, [{"type": "erode_mask"}], SampleConfig())


def masked(spark, image, label, w, h, n=1):
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in np.ravel(v)])
    return spark.range(n).select(F.col("id").alias("serial"), F.lit(w).cast("long").alias("width"), F.lit(h).cast("long").alias("height"), numbers(image).alias("image"), numbers(label).alias("label"))


def test_labels_keep_their_values(spark):
    """Pixel steps change images of three channels, never masks; geometry takes a mask's nearest pixel."""
    image, label = np.arange(48.0).reshape(4, 4, 3), np.arange(16).reshape(4, 4) % 2 * 2
    rows = masked(spark, image, label, 4, 4, 20)
    colour = [{"type": "normalize", "mean": 5, "std": 3}, {"type": "augment.add", "range": 9}, {"type": "augment.blur", "min": 1, "max": 2}, {"type": "augment.flip_color"}, {"type": "colorspace", "code": "BGR2GRAY"}]
    for r in transforms.apply(rows, colour, SampleConfig(perturb=True)).collect():
        assert r["label"] == label.ravel().tolist() and len(r["image"]) == 16 and [f["channels"] for f in r["facets"]] == [1, 1]
    for step in ({"type": "resize", "size": 7}, {"type": "scale", "scale": 1.7}, {"type": "augment.rotate", "range": 60}):
        for r in transforms.apply(rows, [step], SampleConfig(perturb=True)).collect():
            assert set(r["label"]) <= {0.0, 2.0} and len(r["label"]) == r["width"] * r["height"]
    wide = np.array(transforms.apply(rows, [{"type": "resize", "width": 8, "height": 4}], SampleConfig()).first()["label"]).reshape(4, 8)
    assert (wide == np.repeat(label, 2, axis=1)).all()
    deltas = np.array([np.array(r["image"]).reshape(4, 4, 3) - image for r in transforms.apply(rows, [{"type": "augment.add", "range3": 10}], SampleConfig(perturb=True)).collect()])
    assert not deltas[..., :2].any() and np.ptp(deltas[:, 0, 0, 2]) > 5 and np.abs(deltas).max() <= 10


def test_facets_by_number(spark):
    """Masks take another facet's size and follow later steps; some rows may not have them."""
    rows = masked(spark, np.arange(16.0), np.zeros(16), 4, 4, 40)
    r = transforms.apply(rows, [{"type": "mask", "value": 5, "ref": 1}, {"type": "pad", "width": 6, "height": 5}, {"type": "mask", "index": 1, "value": 7}, {"type": "erode_mask", "index": 2, "radius": 1, "border_type": "replicate"}], SampleConfig()).first()
    assert len(r["facets"]) == 3 and set(r["label"]) == {7.0} and np.array(r["mask"]).reshape(5, 6)[:3, :3].tolist() == [[5] * 3] * 3 and r["mask"].count(5.0) == 9
    some = transforms.apply(rows, [{"type": "sometimes", "chance": 0.5, "transforms": [{"type": "mask", "value": 2}, {"type": "featurize"}]}, {"type": "resize", "size": 2}], SampleConfig(perturb=True)).collect()
    assert {(len(r["mask"]) if r["mask"] else None, r["facets"][1]["kind"], len(r["label"])) for r in some} == {(4, "FEATURE", 16), (None, "LABEL", 4)}


def test_pixel_work_is_one_python_step(spark):
    """Five steps on pixels go to Python once; a step of one's own sees the pixels as they are by then."""
    rows = masked(spark, np.arange(16.0), np.zeros(16), 4, 4, 3)
    five = [{"type": "normalize", "mean": 1}, {"type": "resize", "size": 8}, {"type": "augment.rotate", "range": 5}, {"type": "pad", "size": 9}, {"type": "augment.blur"}]
    done = transforms.apply(rows, five, SampleConfig(perturb=True))
    assert done._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1

    @transforms.register("test.double")
    def double(rows, t, place, config):
        return rows.withColumn("image", F.transform("image", lambda v: v * t["by"]))

    try:
        steps = [{"type": "normalize", "mean": 1}, {"type": "mask", "value": 4}, {"type": "test.double", "by": 2}, {"type": "normalize", "mean": -1}, {"type": "pad", "width": 5, "height": 4}]
        r = transforms.apply(rows, steps, SampleConfig()).first()
        assert np.array(r["image"]).reshape(4, 5)[:, :4].ravel().tolist() == [(v - 1) * 2 + 1 for v in range(16)] and r["mask"].count(4.0) == 16 and len(r["mask"]) == 20
        often = transforms.apply(rows, [{"type": "sometimes", "chance": 1.0, "transforms": [{"type": "test.double", "by": 3}]}], SampleConfig(perturb=True)).first()
        assert often["image"] == [3.0 * v for v in range(16)]
        assert not [c for c in r.asDict() if c.startswith("__")]
    finally:
        transforms.REGISTRY.pop("test.double")


def test_colour_blur_and_pyramid_steps(spark):
    rows = annotated(spark, [(0, 0, 1, 1)], 2, 1, image=[0, 0, 255, 255, 255, 255])
    turn = lambda *steps: transforms.apply(rows, [{"type": "colorspace", **s} for s in steps], SampleConfig()).first()["image"]
    unit = {"mul0": 1 / 255}
    assert turn({"code": "BGR2RGB"}) == [255, 0, 0, 255, 255, 255] and turn({"code": "BGR2GRAY"}, {"code": "GRAY2BGR"}) == pytest.approx([0.299 * 255] * 3 + [255] * 3)
    assert turn({"code": "BGR2HSV", **unit}) == pytest.approx([0, 1, 1, 0, 0, 1])
    assert turn({"code": "BGR2Lab", **unit}) == pytest.approx([53.24, 80.09, 67.20, 100, 0, 0], abs=0.02)
    for code in ("HSV", "Lab"):
        assert turn({"code": f"BGR2{code}", **unit}, {"code": f"{code}2BGR", "mul1": 255}) == pytest.approx([0, 0, 255, 255, 255, 255], abs=0.02)
    with pytest.raises(Exception, match="channels"):
        turn({"code": "GRAY2BGR"})
    with pytest.raises(ValueError):
        turn({"code": "BGR2XYZ"})
    steps = [{"type": "pyramid", "count": 2, "rate": 0.5}]
    first, second = transforms.apply(annotated(spark, [(0, 0, 1, 1)], 4, 4, image=range(16)), steps, SampleConfig()).first()["targets"]
    assert first["data"] == [2.5, 4.5, 10.5, 12.5] and second["data"] == [7.5] and (second["width"], second["height"], second["channels"]) == (1, 1, 1)
    spot = annotated(spark, [(0, 0, 1, 1)], 5, 5, image=[float(k == 12) for k in range(25)])
    blur = {"type": "augment.blur", "min": 1, "max": 1}
    assert transforms.apply(spot, [blur], SampleConfig()).first()["image"][12] == 1
    near = np.exp(-np.array([1, 0, 1]) / 2)
    kernel = np.outer(near, near) / near.sum() ** 2
    soft = np.array(transforms.apply(spot, [blur], SampleConfig(perturb=True)).first()["image"]).reshape(5, 5)
    assert np.allclose(soft[1:4, 1:4], kernel) and soft[0].sum() == 0
    flat = annotated(spark, [(0, 0, 1, 1)], 5, 5, image=[1.0] * 25)
    edges = {b: transforms.apply(flat, [{**blur, "border_type": b}], SampleConfig(perturb=True)).first()["image"][0] for b in ("constant", "replicate", "reflect")}
    assert edges == pytest.approx({"constant": (1 - near[0] / near.sum()) ** 2, "replicate": 1, "reflect": 1})


@pytest.mark.parametrize("step,near", [
    ({"type": "resize", "width": 24, "height": 10}, 1e-6), ({"type": "scale", "scale": 2}, 1e-6), ({"type": "augment.scale", "min": 1, "max": 2}, 0.5),
    ({"type": "augment.flip", "horizontal": True, "vertical": True, "transpose": True}, 1e-6), ({"type": "augment.rotate", "range": 20}, 0.8),
    ({"type": "pad", "width": 20, "height": 12}, 1e-6), ({"type": "clip", "max_crop": 2, "round": 4}, 1e-6), ({"type": "clip", "min": 14}, 1e-6),
    ({"type": "clip_square", "shift": 1}, 1e-6), ({"type": "random_square_clip", "size": 11}, 1e-6),
])
def test_pixels_follow_the_shapes(spark, step, near):
    """A bright pixel stays under its box, in both channels, at the size that the row states."""
    bright = np.zeros((10, 12, 2))
    bright[5, 6] = (100, 50)
    row = annotated(spark, [(6, 5, 1, 1)], 12, 10, image=bright.ravel())
    rows = row.crossJoin(spark.range(12).select(F.col("id").alias("n"))).withColumn("serial", F.col("n")).drop("n")
    seen = set()
    for r in transforms.apply(rows, [step], SampleConfig(perturb=True)).collect():
        got = np.array(r["image"]).reshape(r["height"], r["width"], 2)
        xs, ys = ([p[k] for p in r["shapes"][0]["controls"]] for k in "xy")
        x, y = sum(xs) / 4, sum(ys) / 4
        seen.add((r["width"], r["height"], round(x, 3), round(y, 3)))
        light = got[..., 0]
        assert light.sum() > 0 and np.allclose(got[..., 1] * 2, light)
        at = np.mgrid[0 : r["height"], 0 : r["width"]] + 0.5
        assert abs((light * at[1]).sum() / light.sum() - x) <= near and abs((light * at[0]).sum() / light.sum() - y) <= near
    assert len(seen) > 1 or step["type"] in ("resize", "scale", "pad")


def test_pixels_from_outside(spark):
    rows = annotated(spark, [(0, 0, 1, 1)], 3, 2, image=range(1, 7))
    image = lambda *steps: transforms.apply(rows, list(steps), SampleConfig()).first()["image"]
    assert image({"type": "pad", "width": 4, "height": 3}) == [1, 2, 3, 0, 4, 5, 6, 0, 0, 0, 0, 0]
    assert image({"type": "random_square_clip", "size": 5, "center": 1, "pad": 9}) == [9] * 6 + [1, 2, 3, 9, 9, 4, 5, 6] + [9] * 11
    for border, want in (("constant", [1, 2, 3, 0, 0]), ("replicate", [1, 2, 3, 3, 3]), ("reflect", [1, 2, 3, 2, 1])):
        assert image({"type": "clip", "size_width": 5, "size_height": 2, "border_type": border})[:5] == want
    nothing = rows.withColumn("image", F.lit(None).cast("array<double>"))
    assert transforms.apply(nothing, [{"type": "resize", "size": 4}, {"type": "pad", "size": 9}], SampleConfig()).first()["image"] is None
    with pytest.raises(Exception, match="no image of"):
        transforms.apply(rows.withColumn("width", F.lit(4).cast("long")), [{"type": "resize", "size": 4}], SampleConfig()).collect()


# --- images


def test_array_images(spark):
    a = F.array(*[F.lit(float(v)) for v in range(6)])  # 3 x 2
    r = values(spark, h=images.hflip(a, 3, 2), v=images.vflip(a, 3, 2), t=images.transpose(a, 3, 2), p=images.pad(a, 3, 2, 4, 3, 9.0), c=images.crop(a, 3, 1, 0, 2, 2), n=images.planes(a, 2, 3), rgb=images.planes(a, 2, 3, True), i=images.invert(a), e=images.erode(a, 3, 2, 1, 1.0), f=images.foreground(a, 3), o=images.one_hot(F.lit(1.5), 3), hot=images.one_hot(F.lit(2), 3), z=images.fill(F.lit(None).cast("array<double>"), 2), black=images.palette(F.lit(99)))
    assert r["h"] == [2, 1, 0, 5, 4, 3] and r["v"] == [3, 4, 5, 0, 1, 2] and r["t"] == [0, 3, 1, 4, 2, 5]
    assert r["p"] == [0, 1, 2, 9, 3, 4, 5, 9, 9, 9, 9, 9] and r["c"] == [1, 2, 4, 5]
    assert r["n"] == [0, 3, 1, 4, 2, 5] and r["rgb"] == [2, 5, 1, 4, 0, 3] and r["i"][5] == 250
    assert r["e"] == [0, 0, 1, 0, 0, 1] and r["f"].asDict() == {"x0": 0, "x1": 2, "y0": 0, "y1": 1}
    assert r["o"] is None and r["hot"] == [0, 0, 1] and r["z"] == [0, 0] and r["black"] == [0, 0, 0]
    with pytest.raises(ValueError):
        images.pad(a, 3, 2, 2, 2)


def test_pixel_operators(spark):
    x = np.arange(12.0).reshape(1, 12)  # 4 x 3
    assert pixels.resize(x, 4, 3, 4, 3).tolist() == x.tolist()
    assert pixels.resize(x, 4, 3, 2, 1, nearest=True).tolist() == [[0, 2]]
    assert pixels.resize(np.full((1, 12), 3.0), 4, 3, 9, 7).round(9).tolist() == [[3.0] * 63]
    assert pixels.rotate(x, 4, 3, 0.0).tolist() == x.tolist()
    assert pixels.rotate(np.eye(5).reshape(1, 25), 5, 5, 90.0).round(9).reshape(5, 5).tolist() == np.fliplr(np.eye(5)).tolist()
    assert pixels.blur(np.full((1, 12), 2.0), 4, 3, 1.0).round(9).tolist() == [[2.0] * 12]
    assert pixels.blur(x, 4, 3, 0.0).tolist() == x.tolist()
    square = pixels.fill_polygons(np.array([[(1, 1), (3, 1), (3, 3), (1, 3)]]), 4, 4)[0]
    assert square.sum() == 4 and square[1:3, 1:3].all()
    ring = lambda lo, hi: [(float(lo), float(lo)), (float(hi), float(lo)), (float(hi), float(hi)), (float(lo), float(hi))]
    drawn = spark.createDataFrame([([ring(0, 3), ring(1, 2)], [1.0, 2.0]), ([ring(0, 1)[:3]], [5.0]), ([], [])], "p array<array<struct<x:double,y:double>>>, v array<double>")
    masks = [r["m"] for r in drawn.select(pixels.rasterize(spark, 3, 3)(F.col("p"), F.col("v")).alias("m")).collect()]
    assert masks[0] == [1, 1, 1, 1, 2, 1, 1, 1, 1] and masks[1][1:] == [0.0] * 8 and masks[2] == [0.0] * 9
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, None)], "id int, a array<double>")
    got = {r["id"]: r["b"] for r in df.select("id", pixels.resizer(spark, 2, 2, 1, 1)(F.col("a")).alias("b")).collect()}
    assert got[1] == [2.5] and got[2] is None


# --- targets


def test_anchors_against_plain_loops(spark):
    rng = random.Random(2)
    boxes = [(i, s + 1, 1, rng.random() * 0.6, rng.random() * 0.6, 0.1 + rng.random() * 0.4, 0.1 + rng.random() * 0.4, 64, 32) for i in range(4) for s in range(3)]
    table = spark.createDataFrame(boxes, "image long, serial int, label int, x double, y double, w double, h double, width long, height long")
    pics = spark.createDataFrame([(i, 64, 32) for i in range(5)], "image long, width long, height long")
    priors = [(20.0, 10.0), (8.0, 8.0)]
    got = {(r["image"], r["cy"], r["cx"], r["prior"]): r for r in anchors.dense_anchors(pics, table, downsize=8, priors=priors, upper=0.5, lower=0.2, default=-1.0).collect()}
    assert len(got) == 5 * 8 * 4 * 2

    def iou(dx, dy, w, h, p):
        along = lambda d, a, b: max(0.0, min(d + a / 2, b / 2) - max(d - a / 2, -b / 2))
        inter = along(dx, w, p[0]) * along(dy, h, p[1])
        return inter / (w * h + p[0] * p[1] - inter + 1e-5)

    for (i, cy, cx, k), r in got.items():
        best = None
        for b in boxes:
            if b[0] == i:
                dx, dy, w, h = b[3] * 64 + b[5] * 32 - cx * 8, b[4] * 32 + b[6] * 16 - cy * 8, b[5] * 64, b[6] * 32
                s = iou(dx, dy, w, h, priors[k])
                if s > 0 and (best is None or s > best[0]):
                    best = (s, [dx, dy, w, h])
        on = best is not None and best[0] >= 0.2
        assert r["label"] == float(on and best[0] >= 0.5) and r["label_mask"] == float(not on or best[0] >= 0.5)
        assert r["params"] == pytest.approx(best[1] if on else [-1.0] * 4) and r["params_mask"] == float(on)


def test_suppression(spark):
    rows = [(1, 0, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 0, 0, 1, 0.8, 1.0, 1.0, 11.0, 11.0), (1, 1, 0, 0, 0.9, 50.0, 50.0, 60.0, 60.0), (2, 0, 0, 0, 0.1, 0.0, 0.0, 5.0, 5.0)]
    table = spark.createDataFrame(rows, "image long, cy long, cx long, prior int, prob double, x1 double, y1 double, x2 double, y2 double")
    assert pairs(anchors.suppress(table, 0.3), "image", "cy", "prior") == [(1, 0, 0), (1, 1, 0), (2, 0, 0)]
    assert anchors.suppress(table, 0.99).count() == 4
    circles = spark.createDataFrame([(1, 0, 0, 0, 0.5, 0.0, 0.0, 5.0), (1, 0, 1, 0, 0.4, 1.0, 0.0, 5.0), (1, 0, 2, 0, 0.3, 30.0, 0.0, 5.0)], "image long, cy long, cx long, prior int, prob double, x double, y double, r double")
    assert pairs(anchors.suppress(circles, 0.5, circles=True), "cx") == [(0,), (2,)]


def test_keypoints_and_features(spark):
    pics = spark.createDataFrame([(1, 32, 32)], "image long, width long, height long")
    points = spark.createDataFrame([(1, 1, 1, 8.0, 8.0), (1, 2, 1, 9.0, 8.0), (1, 3, 9, 0.0, 0.0)], "image long, serial int, label int, kx double, ky double")
    got = anchors.keypoints(pics, points, 2, 8, 3.0).collect()
    assert [(r["cy"], r["cx"], r["class"], r["dx"], r["dy"]) for r in got] == [(1, 1, 0, 1.0, 0.0)]
    box = spark.createDataFrame([(1, 1, 2, 0.5, 0.5, 1.0, 0.1, 32, 32), (1, 2, 2, 2.0, 2.0, 0.1, 0.1, 32, 32)], "image long, serial int, label int, x double, y double, w double, h double, width long, height long")
    rows = anchors.box_feature(box, 2.0).collect()
    assert len(rows) == 1 and [rows[0][c] for c in ("x1", "y1", "x2", "y2")] == pytest.approx([16, 16, 31, 19.2])


# --- datasets, sinks, delivery


def test_dataset_operators(spark, tmp_path, index):
    ids = spark.createDataFrame([(3,), (3,), (9000,), (5,)], "serial long")
    assert pairs(datasets.keep(index, ids), "serial") == [(3,), (5,)] and datasets.exclude(index, ids).count() == 851
    both = datasets.merge([index.limit(3), index.limit(2)], label_by_input=True)
    assert sorted(r["label"] for r in both.collect()) == [0, 0, 0, 1, 1]
    note = spark.createDataFrame([('{"shapes":[]}',), ('{"shapes":[{"type":"point","geometry":{"x":0.5,"y":0.5}}]}',), (None,), ("",)], "t string")
    assert [r[0] for r in note.select(datasets.has_annotation(F.col("t"))).collect()] == [False, True, False, False]
    exports.write_parts(index.withColumn("test", F.col("id") < 10), "test", str(tmp_path / "p"), ("train", "test"))
    assert spark.read.parquet(str(tmp_path / "p.test")).count() == 10
    boxes = spark.createDataFrame([(1, 2, 0.1, 0.2, 0.5, 0.5, 100, 50)], "image long, label int, x double, y double, w double, h double, width long, height long")
    exports.write_yolo(boxes, str(tmp_path / "y"))
    assert spark.read.text(str(tmp_path / "y")).first()["value"] == "1\t2 10 10 50 25"
    task = values(spark, a=profile.task(F.lit(1), F.lit(0), F.lit(0)), b=profile.task(F.lit(0), F.lit(5), F.lit(1)), c=profile.task(F.lit(0), F.lit(5), F.lit(0)), d=profile.task(F.lit(0), F.lit(1), F.lit(0)))
    assert list(task) == ["segmentation", "regression", "classification", "none"]


def test_delivery(spark, index, tmp_path):
    image = index.withColumn("image", F.when(F.col("id") != 4, F.array(*[F.col("id") * 10 + k for k in range(6)]).cast("array<double>")))
    config = SampleConfig(batch=400, order="NCHW", colorspace="RGB", dtype="int32", shuffle=False)
    plan = sampling.with_payload(sampling.draw_order(index, config), image)
    got = list(delivery.numpy_batches(plan, config, (1, 2, 3)))
    assert [len(g[0]) for g in got] == [400, 400, 53] and got[0][2].shape == (400, 3, 1, 2)
    assert got[0][2][7, :, 0, 0].tolist() == [72, 71, 70] and not got[0][2][4].any()
    rows = delivery.Peekable(plan)
    assert rows.peek()["draw"] == 0 and next(rows)["draw"] == 0 and next(rows)["draw"] == 1 and delivery.size(index, SampleConfig(split=7)) == 732
    seen = {}
    (tmp_path / "ticks").mkdir()
    for k in range(3):
        spark.range(1).coalesce(1).write.parquet(str(tmp_path / "ticks" / str(k)))
    ticks = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "ticks"))
    query = delivery.stream_batches(ticks, index, None, SampleConfig(), 100, lambda df, n: seen.update({n: [r["draw"] for r in df.orderBy("draw").collect()]}), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert seen[1] == list(range(100, 200)) and math.isclose(sum(map(len, seen.values())), 300)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
