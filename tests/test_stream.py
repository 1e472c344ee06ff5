"""Image streams, loaders, annotation shapes and plans over serial ranges."""

import glob
import json
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from samplery.functions import images, pixels, shapes, uris
from samplery.operators import datasets, samples, transcode
from samplery.plans import ordering, sampling, transforms
from samplery.plans.sampling import SampleConfig
from samplery.sources import exports, records
from samplery.streaming import images as stream

SIDE = 4


def picture(k, side=SIDE):
    return (np.arange(side * side * 3).reshape(side, side, 3) + k).astype(np.uint8)


def note(k):
    return json.dumps({"shapes": [{"type": "rect", "label": int(k) % 3 + 1, "geometry": {"x": 0.25, "y": 0, "width": 0.5, "height": 0.5}}]})


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "records")
    rows = [(k, k, float(k % 4), bytearray(records.encode_raw(picture(k))), bytearray(note(k).encode())) for k in range(41)]
    made = records.make_records(spark.createDataFrame(rows, "id long, serial long, label double, image binary, note binary"), [("image", records.IMAGE), ("note", records.NONE)])
    records.write(made, path)
    return path


def test_finite_stream(spark, db):
    s = stream.ImageStream(spark, {"db": db, "loop": False, "stratify": True, "oversample": True, "split": 5, "split_fold": 1, "batch": 8, "channels": 3, "dtype": "uint8", "images": [0], "annotate": [1], "raw": [1], "transforms": [{"type": "rasterize"}]})
    got = list(s)
    plan = [r["id"] for r in sampling.draw_order(records.index(records.read(spark, db)), SampleConfig(stratify=True, oversample=True, split=5, split_fold=1)).orderBy("draw").collect()]
    assert len(s) == len(plan) and [int(i) for b in got for i in b[0].ids] == plan and [len(b[0].ids) for b in got[:-1]] == [8] * (len(got) - 1)
    meta, image, label = got[0]
    assert image.shape == (8, SIDE, SIDE, 3) and image.dtype == np.uint8 and (image[3] == picture(meta.ids[3])).all()
    assert meta.raw[0][2] == note(meta.ids[2]).encode() and meta.labels.tolist() == [float(i % 4) for i in meta.ids]
    want = np.zeros((SIDE, SIDE))
    want[:2, 1:3] = meta.ids[5] % 3 + 1
    assert label.shape == (8, SIDE, SIDE, 1) and (label[5, ..., 0] == want).all()
    assert [b[0].ids.tolist() for b in s] == [b[0].ids.tolist() for b in got]


def test_endless_stream_with_mixin(spark, db):
    s = stream.ImageStream(spark, {"db": db, "mixin": db, "mixin_group_delta": 4, "mixin_max": 10, "batch": 16, "channels": 1, "dtype": "float32", "order": "NCHW", "perturb": True, "stratify": True, "oversample": True, "transforms": [{"type": "augment.add", "range": 9}, {"type": "drop", "index": 0}, {"type": "mask", "value": 2}]})
    assert s.size() == 51
    seen = [next(s) for _ in range(3)]
    meta, image, mask = seen[0]
    assert image is None and mask.shape == (16, 1, SIDE, SIDE) and (mask == 2).all()
    counts = np.bincount(np.concatenate([b[0].labels for b in seen]).astype(int))
    assert counts.max() - counts.min() <= 24  # labels of both files; groups take turns
    rows = s.rows(5, 70).collect()
    assert sorted(r["draw"] for r in rows) == list(range(5, 75))
    with pytest.raises(ValueError, match="no last draw"):
        s.rows()
    plain = stream.ImageStream(spark, {"db": db, "shuffle": False, "reshuffle": False, "batch": 41, "colorspace": "RGB", "dtype": "float32", "perturb": True, "transforms": [{"type": "augment.add", "range": 5}]})
    one, two = next(plain), next(plain)
    assert one[0].ids.tolist() == two[0].ids.tolist() == list(range(41))
    assert np.abs(one[1][7] - picture(7)[..., ::-1]).max() <= 5 and not (one[1] == two[1]).all()


def test_streams_obey_or_refuse(spark, db):
    for bad in ({"threads": 4}, {"no_such_key": 1}, {"images": []}, {"channels": 2}, {"dtype": "int8"}, {"split": 3, "split_fold": -1, "split_keys": [5]}):
        with pytest.raises(ValueError):
            stream.ImageStream(spark, {"db": db, **bad})
    with pytest.raises(ValueError, match="db"):
        stream.ImageStream(spark, {})
    assert stream.read_config({"annotate": False, "split": 3, "split_keys": [1], "split_fold": -1})[0].folds == (1,)
    s = stream.ImageStream(spark, {"db": db, "loop": False, "annotate": [1], "batch": 3})
    with pytest.raises(ValueError, match="not rasterized"):
        next(s)
    s = stream.ImageStream(spark, {"db": db, "loop": False, "annotate": [1], "images": [0, 0], "batch": 3, "transforms": [{"type": "resize", "size": 2}, {"type": "box_feature", "index": 2}]})
    meta, one, two, label, boxes = next(s)
    assert label is None and one.shape == (3, 2, 2, 3) and (one == two).all()
    assert boxes.tolist() == [[b, i % 3 + 1, 0, 0.5, 0, 1, 1] for b, i in enumerate(meta.ids.tolist())]
    with pytest.raises(ValueError, match="one shape"):
        stream.stacked([{"height": 1, "width": 2, "channels": 1, "data": [1, 2]}, {"height": 2, "width": 1, "channels": 1, "data": [1, 2]}], 2, SampleConfig(), ["IMAGE"] * 2, True)


def test_payloads_are_fetched_by_position(spark, tmp_path):
    """A slice's serials reach the scan, which skips row groups without them, and its payloads move only to be put in order."""
    path = str(tmp_path / "sorted")
    rows = [(k, k, 0.0, bytearray(records.encode_raw(picture(k)))) for k in range(400)]
    made = records.make_records(spark.createDataFrame(rows, "id long, serial long, label double, image binary").coalesce(1), [("image", records.IMAGE)])
    made.sortWithinPartitions("serial").write.option("parquet.block.size", 4096).option("parquet.block.size.row.check.min", 10).option("parquet.page.size.row.check.min", 10).parquet(path)
    with stream.ImageStream(spark, {"db": path, "batch": 4, "transforms": [{"type": "resize", "size": 2}]}) as s:
        plan = s._plan(0, 12).collect()
        own = s.slice_rows(plan)
        text = own._jdf.queryExecution().executedPlan().toString()
        pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
        assert "In(serial" in pushed and "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
        assert sorted((r["draw"], r["serial"]) for r in own.collect()) == sorted((r["draw"], r["serial"]) for r in plan)
        got = [next(s)[0].ids.tolist() for _ in range(3)]
        assert [i for b in got for i in b] == [r["id"] for r in sorted(plan)]

    def scanned(serials):
        some = records.at_serials(records.read(spark, path), serials)
        plan = some._jdf.queryExecution().executedPlan()
        assert some.count() == len(serials)
        plan.executeCollect()
        leaf = plan
        while not leaf.children().isEmpty():
            leaf = leaf.children().head()
        return leaf.metrics().apply("numOutputRows").value()

    groups = pq.ParquetFile(glob.glob(f"{path}/*.parquet")[0]).num_row_groups
    assert groups > 10 and scanned(list(range(0, 400, 100))) <= 5 * 400 // groups * 2 < 400
    far = list(range(0, 12)) + list(range(388, 400))  # more than ten values, at both ends
    assert scanned(far) < 200


def test_image_masks_in_streams(spark, tmp_path):
    """An annotation that is an image is a label: colours pass it by, sizes take its nearest pixel; rows may differ in kind and in what steps have made."""
    mask = lambda k: (np.arange(16).reshape(4, 4) + k) % 3
    rows = [(k, k, 0.0, bytearray(records.encode_raw(picture(k))), bytearray(records.encode_raw(mask(k).astype(np.uint8))) if k % 2 else bytearray(note(k).encode())) for k in range(12)]
    made = records.make_records(spark.createDataFrame(rows, "id long, serial long, label double, image binary, note binary"), [("image", records.IMAGE), ("note", records.NONE)])
    records.write(made, str(tmp_path / "db"))
    own = {"db": str(tmp_path / "db"), "loop": False, "annotate": [1], "batch": 12, "dtype": "float32", "perturb": True}
    (meta, image, label), = list(stream.ImageStream(spark, {**own, "transforms": [{"type": "normalize", "mean": 9}, {"type": "augment.add", "range": 4}, {"type": "augment.blur"}, {"type": "resize", "width": 8, "height": 4}, {"type": "rasterize"}]}))
    for k, i in enumerate(meta.ids.tolist()):
        if i % 2:
            assert (label[k, ..., 0] == np.repeat(mask(i), 2, axis=1)).all()
        else:
            assert set(np.unique(label[k])) == {0, i % 3 + 1}
    assert image.shape == (12, 4, 8, 3) and label.shape == (12, 4, 8, 1)
    got, = list(stream.ImageStream(spark, {**own, "transforms": [{"type": "sometimes", "chance": 0.5, "transforms": [{"type": "mask", "value": 2}, {"type": "box_feature"}]}, {"type": "rasterize"}]}))
    added = got[3].reshape(12, -1)
    assert set(added.max(axis=1)) == {0, 2} and got[4].shape[1] == 7 and set(got[4][:, 0]) <= {b for b in range(12) if added[b].any()}
    with pytest.raises(ValueError, match="some rows"):
        next(stream.ImageStream(spark, {**own, "transforms": [{"type": "rasterize"}, {"type": "sometimes", "transforms": [{"type": "featurize"}]}]}))


def test_autoencoders_get_their_image_as_label(spark, db):
    s = stream.ImageStream(spark, {"db": db, "loop": False, "batch": 8, "autoencoder": True, "transforms": [{"type": "resize", "size": 2}, {"type": "mask"}]})
    meta, image, label, mask = next(s)
    assert image.shape == (8, 2, 2, 3) and (image == label).all() and mask.shape == (8, 2, 2, 1)


def test_single_images(spark, tmp_path):
    loader = stream.ImageLoader(spark, {"channels": 3, "dtype": "uint8", "transforms": [{"type": "pad", "size": 5}]})
    got = loader.load_binary(records.encode_raw(picture(9)))
    assert got.shape == (1, 5, 5, 3) and (got[0, :4, :4] == picture(9)).all() and not got[0, 4].any()
    raw = b"".join(b"\0" + bytes([10 * (y * 3 + x) for x in range(3)]) for y in range(2))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    (tmp_path / "b.png").write_bytes(b"no image")
    one = records.import_images(spark, str(tmp_path)).collect()
    assert len(one) == 1 and records.decode_raw(bytes(one[0]["fields"][0]["bytes"])).tolist() == [[0, 10, 20], [30, 40, 50]]
    (tmp_path / "b.png").unlink()
    assert stream.ImageLoader(spark, {"channels": 1}).load_path(str(tmp_path / "a.png"))[0, ..., 0].tolist() == [[0, 10, 20], [30, 40, 50]]
    with pytest.raises(ValueError, match="no image"):
        loader.load_binary(b"12345")
    grey = pixels.convert(np.array([[[10.0, 20.0, 30.0]]]), 1, "uint8")
    assert grey.tolist() == [[[22]]] and pixels.convert(grey, 3, "float32").shape == (1, 1, 3)
    with pytest.raises(ValueError):
        pixels.convert(np.zeros((1, 1, 2)), 3, "uint8")


def test_records_from_records(spark, db, tmp_path):
    some = records.import_records(spark, db, 7)
    assert [(r["id"], r["label"], len(r["fields"])) for r in some.orderBy("id").collect()] == [(k, float(k % 4), 2) for k in range(7)]
    assert records.import_records(spark, db).count() == 41
    out = {r["name"]: bytes(r["content"]) for r in exports.unpacked(some, 1, ".json").collect()}
    assert out["3.json"] == note(3).encode() and len(out) == 7
    changed = some.withColumn("fields", records.replace_field(F.col("fields"), 1, F.lit(b"new"), records.IMAGE)).where("id = 2").first()["fields"]
    assert (bytes(changed[1]["bytes"]), changed[1]["type"]) == (b"new", records.IMAGE) and changed[0]["type"] == records.IMAGE


def test_annotations_become_shapes(spark):
    text = json.dumps({"shapes": [
        {"type": "polygons", "label": [1, 2], "geometry": {"points": [[{"x": 0.1, "y": 0.2}, {"x": 0.3, "y": 0.4}], [{"x": 0.5, "y": 0.6}]]}},
        {"type": "polygon", "tag": 4, "geometry": {"points": [{"x": 0, "y": 0}, {"x": 1, "y": 0}, {"x": 1, "y": 1}]}},
        {"type": "arect", "geometry": {"x": 5, "y": 5, "w": 4, "h": 2, "a": 0}}, {"type": "point", "geometry": {"x": 0.5, "y": 0.5}},
    ]})
    rows = spark.createDataFrame([(text,), ("",), (None,), ('{"shapes":[]}',)], "t string").select(shapes.shapes_of(F.col("t"), F.lit(10), F.lit(20)).alias("s")).collect()
    own = [[(p["x"], p["y"]) for p in s["controls"]] for s in rows[0]["s"]]
    assert np.allclose(own[0], [(1, 4), (3, 8), (5, 12)]) and rows[0]["s"][0]["rings"] == [2, 1] and own[1] == [(0, 0), (10, 0), (10, 20)]
    assert own[2][0] == (7, 5) and own[3] == [(5, 10)] and rows[0]["s"][1]["tag"] == 4 and [r["s"] for r in rows[1:]] == [[], [], []]
    with pytest.raises(Exception, match="unknown shape type"):
        spark.createDataFrame([('{"shapes":[{"type":"star","geometry":{"x":1}}]}',)], "t string").select(shapes.shapes_of(F.col("t"), F.lit(1), F.lit(1))).collect()
    canvas = np.zeros((9, 9, 1))
    pixels.draw(canvas, 9, 9, "ellipse", np.array([(1.0, 2.0), (8.0, 7.0), (8.0, 2.0), (1.0, 7.0)]), np.array([1.0]))
    want = [[((x + 0.5 - 4.5) / 3.5) ** 2 + ((y + 0.5 - 4.5) / 2.5) ** 2 <= 1 for x in range(9)] for y in range(9)]
    assert (canvas[..., 0] == np.array(want)).all()
    ring = np.zeros((9, 9, 1))
    pixels.draw(ring, 9, 9, "ellipse", np.array([(1.0, 1.0), (8.0, 8.0)]), np.array([1.0]), thickness=1)
    assert 0 < ring.sum() < 40 and ring[4, 4, 0] == 0


def test_serials_are_cut_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 10)
    index = spark.range(95).select(F.col("id").alias("serial"), (F.col("id") % 3).alias("grp"))
    rows = sampling._shuffled(index, SampleConfig(shuffle=False), ())
    assert {(r["serial"], r["pos"], r["n"]) for r in rows.collect()} == {(k, k, 95) for k in range(95)}
    slice_ = sampling.looped_draws(index, SampleConfig(shuffle=False), 30, 180).orderBy("draw").collect()
    assert [(r["draw"], r["serial"]) for r in slice_] == [(d, d % 95) for d in range(180, 210)]
    few = ordering.ranked(index.withColumn("lo", F.lit(12)).withColumn("hi", F.lit(20)), "serial", [], bucket=F.floor(F.col("serial") / 10), slice_=("lo", "hi"))
    assert sorted(r["pos"] for r in few.collect()) == list(range(10, 20))


def test_odd_groups_are_not_stratified(spark):
    index = spark.range(40).select(F.col("id").alias("serial"), (F.col("id") / 2).alias("grp"))
    config = SampleConfig(stratify=True, oversample=True, split=4, split_fold=0)
    with pytest.warns(UserWarning, match="no categories"):
        got = sampling.draw_order(index, config)
    pooled = sampling.draw_order(index, SampleConfig(split=4, split_fold=0))
    assert sorted((r["draw"], r["serial"]) for r in got.collect()) == sorted((r["draw"], r["serial"]) for r in pooled.collect())


def test_uris_and_palettes(spark):
    odd = "a b&c=d/é%2 %zz+~*"
    row = spark.range(1).select(uris.escape(F.lit(odd)).alias("e"), uris.unescape(F.lit("%41%zz+%c3%A9%")).alias("u"), uris.parse_form(F.lit("a=1&b%20c=x%3Dy=z&")).alias("f"), images.palette(F.lit(0)).alias("p"), images.palette(F.lit(1), "tableau20a").alias("q"), images.palette(F.lit(-1)).alias("n")).first()
    assert row["e"] == "a%20b%26c%3Dd%2F%C3%A9%252%20%25zz%2B~%2A" and row["u"] == "A%zz+é%"
    assert [tuple(x) for x in row["f"]] == [("a", "1"), ("b c", "x=y=z")] and (row["p"], row["q"], row["n"]) == ([0, 0, 0], [188, 189, 34], [0, 0, 0])
    with pytest.raises(Exception, match="a form is"):
        spark.range(1).select(uris.parse_form(F.lit("a=&b=1"))).collect()


def test_dark_tiles_go(spark):
    rows = spark.createDataFrame([(1, 4, 2, [float(v) for v in (0, 0, 9, 9, 0, 0, 9, 9)])], "id long, width long, height long, image array<double>")
    tiles = datasets.bright_tiles(datasets.grid_tiles(rows, 2, 2), 4, 5.0)
    assert [(r["tile_x"], r["tile_y"]) for r in tiles.collect()] == [(2, 0)]


def test_images_in_other_sizes(spark):
    wide = np.arange(48, dtype=np.int16).reshape(2, 8, 3) - 20
    images_ = [records.encode_raw(wide), records.encode_raw(np.full((1, 1), 2.5, np.float32)), b"no matrix", b"", records.encode_raw(np.zeros((0, 3), np.uint8))]
    own = records.make_records(spark.createDataFrame([(k, k, 1.0, bytearray(x), bytearray(b"rest")) for k, x in enumerate(images_)], "id long, serial long, label double, image binary, rest binary"), [("image", records.IMAGE), ("rest", records.NONE)])
    small = {r["id"]: r for r in transcode.downsized(own, 4).collect()}
    got = records.decode_raw(bytes(small[0]["fields"][0]["bytes"]))
    # 8 x 2 pixels become 4 x 1: each the mean of 2 x 2
    want = np.rint(wide.astype(float).reshape(1, 2, 4, 2, 3).mean(axis=(1, 3)))
    assert got.dtype == np.int16 and got.shape == (1, 4, 3) and (got == want).all() and small[0]["size"] == 16 + 24 + 4
    assert all(bytes(small[k]["fields"][0]["bytes"]) == images_[k] for k in (1, 2, 3, 4)) and all(bytes(r["fields"][1]["bytes"]) == b"rest" for r in small.values())
    large = {r["id"]: records.decode_raw(bytes(r["fields"][0]["bytes"])) for r in transcode.limited(own, 8, 3).where("id < 2").collect()}
    assert large[0].shape == (3, 12, 3) and large[1].tolist() == [[2.5] * 3] * 3
    assert transcode.import_limited(own) is own and transcode.downsized(own.where("id < 0"), 4).count() == 0
    bare = records.copy_meta(own).first()
    assert bare["fields"] == [] and bare["size"] == 0 and bare["label"] == 1


def test_lists_with_their_paths(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for name in ("a.bin", "b.bin"):
        (tmp_path / "files" / name).write_bytes(name.encode())
    (tmp_path / "list").write_text("b.bin 2\nmissing.bin 3\na.bin 5\nnothing\n")
    got = records.import_list(spark, str(tmp_path / "list"), str(tmp_path / "files"), sep=" ", keep_path=True).orderBy("id").collect()
    assert [(r["label"], bytes(r["fields"][0]["bytes"]), json.loads(bytes(r["fields"][1]["bytes"]))) for r in got] == [(5.0, b"a.bin", {"path": "a.bin"}), (2.0, b"b.bin", {"path": "b.bin"})]


def test_colours_change_in_other_spaces(spark):
    config = SampleConfig(perturb=True, seed=5)
    pixel = [0.2, 0.5, 0.4]
    rows = spark.createDataFrame([(k, 1, 1, pixel) for k in range(20)], "serial long, width long, height long, image array<double>")
    run = lambda **t: [r["image"] for r in transforms.apply(rows, [{"type": "augment.add", **t}], config).orderBy("serial").collect()]
    same = np.array(run(space="SAME", range=0.1)) - pixel
    assert np.allclose(same, same[:, :1]) and np.ptp(same[:, 0]) > 0.05 and np.abs(same).max() <= 0.1
    for space in ("HSV", "Lab"):
        assert np.allclose(run(space=space, range=0), pixel, atol=1e-4)
    bright = np.array(run(space="HSV", range3=0.1, range1=0, range2=0))
    assert np.ptp(bright[:, 1]) > 0.05 and np.allclose(bright / bright[:, 1:2], np.array(pixel) / 0.5)  # value alone: hue and saturation stay
    with pytest.raises(ValueError):
        run(space="XYZ")


def test_batches_as_pictures(spark, db, tmp_path):
    """Spark's image source gives the pixels back; dropped facets keep their number."""
    s = stream.ImageStream(spark, {"db": db, "loop": False, "batch": 4, "channels": 3, "dtype": "uint8", "images": [0, 0], "annotate": [1], "transforms": [{"type": "rasterize", "index": 2}, {"type": "drop", "index": 1}]})
    rows = s.rows()
    got = {r["name"]: bytes(r["content"]) for r in stream.batch_pictures(rows, 4, 2).collect()}
    assert sorted(got) == sorted(f"{b}_{f}_{k}.png" for b in range(2) for f in (0, 2) for k in range(4))
    ids = {r["draw"]: r["id"] for r in rows.select("draw", "id").collect()}
    for name, content in got.items():
        (tmp_path / name).write_bytes(content)
    for r in spark.read.format("image").load(str(tmp_path)).select("image.*").collect():
        batch, facet, k = (int(x) for x in r["origin"].rsplit("/", 1)[1][:-4].split("_"))
        pixels_ = np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["height"], r["width"], r["nChannels"])
        i = ids[batch * 4 + k]
        want = np.zeros((SIDE, SIDE, 1))
        want[:2, 1:3] = i % 3 + 1
        assert (pixels_ == (picture(i) if facet == 0 else want)).all()
    assert stream.batch_pictures(rows.where("draw < 0"), 4, 2).count() == 0
    with pytest.raises(ValueError):
        pixels.encode_png(np.zeros((2, 2, 2)))
    assert pixels.encode_png(np.array([[[-3.0], [300.0]]])) == pixels.encode_png(np.array([[[0.0], [255.0]]]))


def test_vector_samples(spark):
    facet = "struct<width:long,height:long,channels:int,data:array<double>>"
    image = [float(v) for v in range(12)]
    mask = [float(v) for v in (0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 1, 0)]
    rows = [(5, (4, 3, 1, image), (4, 3, 1, mask)), (6, (4, 3, 3, [float(v) for v in np.repeat(image, 3)]), (4, 3, 1, mask)), (7, (4, 3, 1, image), (4, 3, 1, [0.0] * 12)), (8, None, (4, 3, 1, mask)), (9, (4, 3, 1, image), None)]
    own = spark.createDataFrame(rows, f"serial long, image {facet}, mask {facet}")
    got = {r["place"]: bytes(r["content"]) for r in samples.vector_samples(own, 2).collect()}
    body = struct.pack("<5h", 0, 5, 6, 9, 10)
    assert got == {-1: struct.pack("<iihh", 2, 4, 0, 0), 5: body, 6: body}
    assert samples.vector_samples(own.where("serial > 6"), 2).count() == 0
    assert samples.sample_size(0.75, 2) == (2, 2) and samples.sample_size(1.5, 10) == (15, 10)


def test_images_agree_with_their_sizes(spark):
    rows = lambda n, w: spark.createDataFrame([(1, w, 2, [1.0] * n), (2, None, None, None)], "serial long, width long, height long, image array<double>")
    steps = [{"type": "normalize", "mean": 1}]
    assert transforms.apply(rows(12, 3), steps, SampleConfig()).where("serial = 1").first()["image"] == [0.0] * 12
    for n, w in ((13, 3), (4, 0)):
        with pytest.raises(Exception, match="are no image of"):
            transforms.apply(rows(n, w), steps, SampleConfig()).collect()
