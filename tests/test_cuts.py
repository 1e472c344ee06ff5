"""Cut records: pixels, annotations and masks of crops, tiles and patches; parts of files."""

import json
import os
import tarfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplery import queries
from samplery.functions import pixels
from samplery.operators import cuts, transcode
from samplery.plans import sampling
from samplery.sources import files, records
from samplery.streaming import delivery

PIXELS = np.arange(8 * 10 * 3, dtype=np.uint8).reshape(8, 10, 3)
SHAPES = [
    {"type": "rect", "label": 2, "tag": 5, "geometry": {"x": 0.1, "y": 0.25, "width": 0.4, "height": 0.5}},
    {"type": "point", "geometry": {"x": 0.5, "y": 0.5}},
    {"type": "polygon", "geometry": {"points": [{"x": 0.5, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 0.5}]}},
    {"type": "polygons", "geometry": {"points": [[{"x": 0.0, "y": 0.5}, {"x": 0.2, "y": 0.5}], [{"x": 0.2, "y": 1.0}]]}},
    {"type": "arect", "geometry": {"x": 5, "y": 4, "w": 4, "h": 2, "a": 0}},
]


def made(spark, rows):
    return records.make_records(spark.createDataFrame([(k, k, 3.0, bytearray(i) if i else None, bytearray(n) if n else None) for k, (i, n) in enumerate(rows)], "id long, serial long, label double, image binary, note binary"), [("image", records.IMAGE), ("note", records.NONE)])


@pytest.fixture(scope="module")
def noted(spark):
    grey = np.zeros((4, 4), np.uint8)
    grey[:2] = 100
    return made(spark, [(records.encode_raw(PIXELS), json.dumps({"shapes": SHAPES}).encode()), (b"no image", b'{"shapes": []}'), (records.encode_raw(grey), None), (None, None)])


def got(df):
    out = {}
    for r in df.collect():
        fields = [bytes(f["bytes"]) for f in r["fields"]]
        assert r["id"] == r["serial"] and r["label"] == 0 and r["size"] == sum(map(len, fields))
        out[divmod(r["serial"], cuts.MOST_CUTS)] = (records.decode_raw(fields[0]), fields[1] if len(fields) > 1 else None)
    return out


def test_crops(noted):
    own = got(cuts.crops(noted))
    assert set(own) == {(0, 0), (0, 1), (0, 2), (0, 3)}  # a point has no area
    assert (own[0, 0][0] == PIXELS[2:6, 1:5]).all() and (own[0, 1][0] == PIXELS[0:4, 5:10]).all() and own[0, 0][1] is None
    double = got(cuts.crops(noted, 2.0))[0, 0][0]
    want = pixels.resize(PIXELS[2:6, 1:5].reshape(1, -1), 4, 4, 8, 8, 3).reshape(8, 8, 3)
    assert (double == np.rint(want)).all()


def test_tiles(noted):
    own = got(cuts.tiles(noted, 5, 3))
    assert len([k for k in own if k[0] == 0]) == 6 and all(t.shape == (5, 5, 3) for k, (t, _) in own.items() if k[0] == 0)
    first, note = own[0, 0]
    assert (first == PIXELS[:5, :5]).all()
    shapes = json.loads(note)["shapes"]
    assert [s["type"] for s in shapes] == ["rect", "polygons", "arect"] and shapes[0]["tag"] == 5 and shapes[0]["label"] == 2
    assert shapes[0]["geometry"] == pytest.approx({"x": 0.2, "y": 0.4, "width": 0.8, "height": 0.8})
    assert shapes[1]["geometry"]["points"][1][0] == pytest.approx({"x": 0.4, "y": 1.6}) and shapes[2]["geometry"]["w"] == 4
    assert set(got(cuts.tiles(noted, 2, 2, least=1.0))) >= {(2, 0), (2, 1)} and (2, 2) not in got(cuts.tiles(noted, 2, 2, least=1.0))
    whole = got(cuts.tiles(noted, 100, 50))
    assert set(whole) == {(0, 0), (2, 0)} and (whole[0, 0][0] == PIXELS).all() and len(json.loads(whole[0, 0][1])["shapes"]) == 4


def test_masks_are_cut_too(spark):
    mask = (np.arange(80).reshape(8, 10) % 3).astype(np.uint8)
    own = got(cuts.tiles(made(spark, [(records.encode_raw(PIXELS), records.encode_raw(mask))]), 8, 4, 2.0))
    twice = np.repeat(np.repeat(mask, 2, axis=0), 2, axis=1)
    big = np.rint(pixels.resize(PIXELS.reshape(1, -1), 10, 8, 20, 16, 3).reshape(16, 20, 3))
    at = [(y, x) for y in (0, 4, 8) for x in (0, 4, 8, 12)]
    assert len(own) == 12
    for k, (y, x) in enumerate(at):
        image, note = own[0, k]
        assert (records.decode_raw(note) == twice[y : y + 8, x : x + 8]).all() and (image == big[y : y + 8, x : x + 8]).all()


def test_patches_and_windows(noted):
    own = got(cuts.patches(noted, 8, 10))
    assert set(own) == {(0, 0), (0, 1), (0, 2), (0, 3)}
    scale = 8 / (4 * 4) ** 0.5  # twice the size
    image, note = own[0, 0]
    big = np.rint(pixels.resize(PIXELS.reshape(1, -1), 10, 8, 20, 16, 3).reshape(16, 20, 3))
    assert scale == 2 and image.shape == (10, 10, 3) and (image == big[3:13, 1:11]).all()
    assert json.loads(note)["shapes"][0]["geometry"] == pytest.approx({"x": 0.1, "y": 0.1, "width": 0.8, "height": 0.8})
    plain = got(cuts.patches(noted, 4, 6, scaled=False))[0, 0]
    assert (plain[0] == PIXELS[1:7, 0:6]).all()
    zoomed = got(cuts.zoomed(made(noted.sparkSession, [(records.encode_raw(PIXELS), json.dumps({"shapes": SHAPES[:1]}).encode())]), 0.8))[0, 0]
    assert (zoomed[0] == PIXELS[2:6, 1:6]).all() and json.loads(zoomed[1])["shapes"][0]["geometry"]["width"] == pytest.approx(0.8)
    assert cuts.crops(noted.where("id > 9")).count() == 0


# --- polygons


def test_runs_of_pixels_are_those_inside():
    rng = np.random.default_rng(4)
    own = [np.round(rng.uniform(-4, 14, (n, 2)) * 2) / 2 for n in rng.integers(1, 9, 200)]
    at = np.concatenate([[0], np.cumsum([len(p) for p in own])])
    flags = np.zeros((len(own), 7, 9), bool)
    for k, y, x0, x1 in pixels.spans(np.concatenate(own), at, 9, 7):
        flags[k, y, x0:x1] = True
    for k, p in enumerate(own):
        want = pixels.fill_polygons(p[None], 9, 7)[0]
        rows, cols, inside = pixels.fill(p, 9, 7)
        some = np.zeros((7, 9), bool)
        some[rows, cols] = inside
        assert (flags[k] == want).all() and (some == want).all()


# --- batches of one shape


@pytest.mark.parametrize("mode,want", [("first", (4, 2, 3)), ("largest", (4, 3, 4)), ("smallest", (2, 2, 1))])
def test_unlike_images_in_one_shape(spark, mode, want):
    facet = "struct<width:long,height:long,channels:int,data:array<double>>"
    own = [(0, None), (1, (4, 2, 3, [10.0] * 24)), (2, (2, 3, 1, [7.4] * 6)), (3, (3, 3, 4, [20.0, 30.0, 40.0, 9.0] * 9)), (4, (9, 9, 1, [1.0] * 81)), (8, None)]
    rows = spark.createDataFrame(own, f"draw long, image0 {facet}")
    if mode == "largest":
        rows = rows.withColumn("image0", F.when(F.col("image0.channels") == 4, F.col("image0")).otherwise(F.lit(None)))
    got = {r["draw"]: r["image0"] for r in transcode.fitted(rows, 4, mode).collect()}
    assert len(got) == 6 and got[0] is None and got[8] is None
    for k in (1, 2, 3):
        if got[k] is not None:
            assert (got[k]["width"], got[k]["height"]) == (want[:2] if mode != "largest" else (3, 3)) and len(got[k]["data"]) == got[k]["width"] * got[k]["height"] * got[k]["channels"]
    if mode == "first":
        assert set(got[2]["data"]) == {7.0} and got[3]["data"][:3] == [20, 30, 40] and (got[4]["width"], got[4]["height"]) == (9, 9)
    if mode == "smallest":
        assert set(got[3]["data"]) == {np.rint(0.114 * 20 + 0.587 * 30 + 0.299 * 40)}
    with pytest.raises(ValueError):
        transcode.fitted(rows, 4, "widest")


@pytest.mark.parametrize("ids", [range(6), [0, 1, 2, 3, 4, 10, 10]])
def test_last_batch_is_filled(spark, tmp_path, ids):
    """The sixth image is not alone in its batch, whose largest sides are those of the first images too."""
    own = [(i, np.random.default_rng(k).normal(size=64).tolist()) for k, i in enumerate(ids)]
    spark.createDataFrame([(i, i % 2, e) for i, e in own], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = queries.fit_largest(spark, str(tmp_path)).collect()
    assert {(r["width"], r["height"]) for r in rows} == {(16, 8)}
    want = []
    for i, e in own:
        image = pixels.resize(np.array([e], np.float32).astype(float), 8 if i % 2 == 0 else 16, 8 if i % 2 == 0 else 4, 16, 8)[0]
        want += [(i, k, v) for k, v in enumerate(np.repeat(image, 3))]
    for got, (i, k, v) in zip(sorted((r["id"], r["i"], r["v"]) for r in rows), sorted(want), strict=True):
        assert got[:2] == (i, k) and abs(got[2] - v) <= 1e-6


# --- parts of files


def test_large_tars_are_listed_by_their_headers(spark, tmp_path):
    """A sparse tar of 3 GB: its members are found without reading it, and small ones are read by position."""
    path = str(tmp_path / "big.tar")
    with open(path, "wb") as f:
        for name, size in (("a", 5), ("hole", 3 << 30), ("b", 7)):
            info = tarfile.TarInfo(name)
            info.size = size
            f.write(info.tobuf())
            if size < 10:
                f.write(name.encode() * size)
            f.seek(-(-size // 512) * 512 - (size if size < 10 else 0), os.SEEK_CUR)
        f.write(b"\0" * 1024)
    found = files.tar_members(spark, [path])
    assert [(r["name"], r["length"]) for r in found.orderBy("member").collect()] == [("a", 5), ("hole", 3 << 30), ("b", 7)]
    small = files.read_members(found.where("length < 10")).orderBy("member").collect()
    assert [bytes(r["content"]) for r in small] == [b"a" * 5, b"b" * 7]


def test_rows_of_one_file_go_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART", 40)
    (tmp_path / "rows").write_bytes(b"head" + bytes(range(200)) + b"rest")
    got = files.read_rows(spark, [str(tmp_path / "rows")], 10, 4)
    assert [(r["n"], bytes(r["row"])) for r in got.orderBy("n").collect()] == [(k, bytes(range(10 * k, 10 * k + 10))) for k in range(20)]
    assert len({r[0] for r in got.groupBy(F.spark_partition_id()).count().collect()}) > 1


def test_only_listed_files_are_opened(spark, tmp_path):
    """A pipe that is not in the list would never end if it were opened."""
    (tmp_path / "root").mkdir()
    os.mkfifo(tmp_path / "root" / "pipe")
    (tmp_path / "root" / "a.bin").write_bytes(b"a")
    (tmp_path / "list").write_text("a.bin\t4\nmissing.bin\t5\na.bin\tx\n")
    got = records.import_list(spark, str(tmp_path / "list"), str(tmp_path / "root")).collect()
    assert [(r["label"], bytes(r["fields"][0]["bytes"])) for r in got] == [(4.0, b"a")]
    with pytest.raises(Exception, match="missing|No such"):
        files.read_parts(spark.createDataFrame([(str(tmp_path / "missing"), 0, None)], "path string, start long, length long")).collect()


# --- draws as a streaming source


def test_draws_go_on_from_the_checkpoint(spark, tmp_path):
    """Micro-batches of a stated number of draws; a restart, even with another number, gives the next draw."""
    index = spark.createDataFrame([(k, float(k % 3), k) for k in range(50)], "id long, grp double, serial long")
    config = sampling.SampleConfig(stratify=True, oversample=True)
    want = {r["draw"]: r["id"] for r in sampling.looped_draws(index, config, 400).collect()}

    def some(per, batches):
        seen = []
        query = delivery.stream_draws(spark, index, None, config, per, lambda rows, n: seen.append(sorted((r["draw"], r["id"]) for r in rows.collect())), str(tmp_path / "checkpoint"))
        try:
            for _ in range(600):
                if len(seen) >= batches or query.exception():
                    break
                time.sleep(0.1)
        finally:
            query.stop()
        assert query.exception() is None and len(seen) >= batches
        return seen

    first = some(40, 2)
    assert [len(b) for b in first[:2]] == [40, 40] and first[0][0][0] == 0 and first[1][0][0] == 40
    second = some(25, 1)
    assert second[0][0][0] in {40 * len(first) - 40, 40 * len(first)}  # the last batch once more, if it was not noted as done
    for batch in first + second:
        assert all(want[d] == i for d, i in batch if d in want) and [d for d, _ in batch] == list(range(batch[0][0], batch[0][0] + len(batch)))
    with pytest.raises(Exception, match="at least one"):
        delivery.stream_draws(spark, index, None, config, 0, lambda rows, n: None, str(tmp_path / "other")).processAllAvailable()
