import io
import struct
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.functions.geo import Affine
from pixelmill.sources import raster, tiff

PLACE = Affine(300000.0, 4200000.0, 10.0, -10.0)


def image(profile, seed=1):
    r = np.random.default_rng(seed)
    shape = (profile.bands, profile.height, profile.width)
    return r.random(shape).astype(profile.dtype) if profile.dtype.startswith("float") else r.integers(0, 200, shape).astype(profile.dtype)


def saved(path, profile, values):
    with open(path, "wb") as f:
        tiff.write_array(f, profile, values)
    return str(path)


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "int32", "float32", "float64"])
def test_round_trip_and_windows(tmp_path, dtype):
    p = tiff.Profile(70, 51, 3, dtype, PLACE, 32630, 0.0, ("red", "nir & more", 'a"b<c>'), {"aoi": "south & <x>", "legend": "1 a\n2 b"}, tile=(32, 16))
    v = image(p)
    path = saved(tmp_path / "a.tif", p, v)
    got, layout = raster.header(path)
    assert got == p and len(layout.offsets) == 3 * 3 * 4
    with open(path, "rb") as f:
        for window in ((0, 0, 70, 51), (31, 15, 2, 2), (69, 50, 1, 1), (5, 3, 40, 33), (0, 0, 0, 0)):
            r, c, h, w = window
            assert (tiff.read_window(f, got, layout, window) == v[:, r : r + h, c : c + w]).all()
        assert (tiff.read_window(f, got, layout, (1, 2, 3, 4), [2]) == v[2:, 1:4, 2:6]).all()
        with pytest.raises(ValueError, match="leaves"):
            tiff.read_window(f, got, layout, (60, 0, 11, 5))


def test_only_touched_chunks_are_read(tmp_path):
    p = tiff.Profile(512, 512, 2, "float32", tile=(64, 64))
    path = saved(tmp_path / "a.tif", p, image(p))
    raw, asked = open(path, "rb").read(), []

    def ask(request: urllib.request.Request) -> bytes:
        a, _, b = request.get_header("Range").removeprefix("bytes=").partition("-")
        asked.append(int(b) - int(a) + 1)
        return raw[int(a) : int(b) + 1]

    file = raster.RangeFile("http://x/a.tif", ask)
    profile, layout = tiff.read_header(file)
    assert (tiff.read_window(file, profile, layout, (10, 10, 20, 20), [1]) == image(p)[1:, 10:30, 10:30]).all()
    assert sum(asked) < len(raw) / 20


def packed_lzw(data):
    """A plain encoder of the format's LZW."""
    table, out, width, w = {bytes([k]): k for k in range(256)}, [(256, 9)], 9, b""
    for k in data:
        c = w + bytes([k])
        if c in table:
            w = c
            continue
        out.append((table[w], width))
        table[c] = len(table) + 2
        n = len(table) + 2
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        w = bytes([k])
        if n == 4094:
            out += [(table[w], width), (256, width)]
            table, width, w = {bytes([j]): j for j in range(256)}, 9, b""
    if w:
        out.append((table[w], width))
    bits = "".join(f"{c:0{n}b}" for c, n in [*out, (257, width)])
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


@pytest.mark.parametrize("n", [0, 1, 300, 3000, 40_000])
def test_lzw(n):
    r = np.random.default_rng(n)
    for data in (r.integers(0, 4, n).astype(np.uint8).tobytes(), r.integers(0, 256, n).astype(np.uint8).tobytes(), b"a" * n):
        assert tiff.unpacked_lzw(packed_lzw(data)) == data


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("compression", "predictor", "together"), [(1, 1, True), (5, 2, True), (8, 2, False), (5, 1, False)])
def test_strips_of_other_writers(order, compression, predictor, together):
    import zlib

    v = np.random.default_rng(7).integers(0, 5000, (2, 9, 11)).astype(np.uint16)
    per = 4
    chunks = []
    for band in [v.transpose(1, 2, 0)] if together else [v[0][:, :, None], v[1][:, :, None]]:
        for r in range(0, 9, per):
            part = band[r : r + per].astype(np.int64)
            if predictor == 2:
                part = np.concatenate((part[:, :1], np.diff(part, axis=1)), axis=1)
            raw = part.astype(np.uint16).astype(np.dtype(np.uint16).newbyteorder(order)).tobytes()
            chunks.append({1: lambda b: b, 5: packed_lzw, 8: zlib.compress}[compression](raw))
    body = b"".join(chunks)
    offsets = [8 + sum(map(len, chunks[:k])) for k in range(len(chunks))]
    tags = [(256, 3, [11]), (257, 3, [9]), (258, 3, [16, 16]), (259, 3, [compression]), (273, 4, offsets), (277, 3, [2]), (278, 3, [per]), (279, 4, list(map(len, chunks))), (284, 3, [1 if together else 2]), (317, 3, [predictor])]
    extra, at, entries = b"", 8 + len(body), b""
    for tag, kind, values in tags:
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            entries += struct.pack(order + "HHII", tag, kind, len(values), at + len(extra))
            extra += raw
        else:
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    whole = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at + len(extra)) + body + extra + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4
    file = io.BytesIO(whole)
    p, layout = tiff.read_header(file)
    assert (p.height, p.width, p.bands, p.dtype, p.tile) == (9, 11, 2, "uint16", (4, 11))
    assert (tiff.read_window(file, p, layout, (0, 0, 9, 11)) == v).all()
    assert (tiff.read_window(file, p, layout, (3, 2, 3, 5), [1]) == v[1:, 3:6, 2:7]).all()


def test_what_is_no_raster_is_an_error():
    for raw in (b"", b"junk" * 9, b"II*\0\x08\0\0\0\xff\xff"):
        with pytest.raises((ValueError, struct.error)):
            tiff.read_header(io.BytesIO(raw))


def test_resized_parts_equal_the_whole():
    v = np.random.default_rng(2).random((2, 13, 9)).astype(np.float32)
    read = lambda w: v[:, w[0] : w[0] + w[2], w[1] : w[1] + w[3]]
    for factor in (2, 0.5, 1.5, 6):
        for method in ("nearest", "bilinear"):
            whole = tiff.resized(read, (1, 2, 11, 6), factor, method)
            assert whole.shape == (2, int(11 * factor), int(6 * factor))
            h, w = whole.shape[1] // 2, whole.shape[2] // 2
            assert np.allclose(tiff.resized(read, (1, 2, 11, 6), factor, method, (h, w, 2, 1)), whole[:, h : h + 2, w : w + 1])
    assert (tiff.resized(read, (0, 0, 13, 9), 2, "nearest") == v.repeat(2, 1).repeat(2, 2)).all()
    with pytest.raises(ValueError, match="cubic"):
        tiff.resized(read, (0, 0, 2, 2), 2, "cubic")


def test_reads_are_retried(tmp_path):
    waits, left = [], [3]

    def flaky():
        left[0] -= 1
        if left[0] > 0:
            raise OSError("gone")
        return 7

    assert raster.retried(flaky, sleep=waits.append) == 7 and waits == [2, 2]
    with pytest.raises(OSError):
        raster.header(str(tmp_path / "none.tif"), sleep=waits.append)
    assert len(waits) == 6 and max(waits) <= 60


def test_spark_reads_windows_and_pushes_bounds(spark, tmp_path):
    raster.register(spark)
    p = tiff.Profile(40, 30, 2, "uint16", PLACE, 32630, 0.0, ("red", "scl"), tile=(16, 16))
    v = image(p)
    saved(tmp_path / "s1.tif", p, v)
    saved(tmp_path / "s2.tif", p, image(p, 2))
    df = spark.read.format("geotiff").option("tile", 16).load(str(tmp_path))
    assert df.columns == ["file", "row", "col", "red", "scl"] and df.count() == 2400
    got = df.where("file = 's1.tif' and row >= 30 and row < 33 and col = 7").collect()
    assert sorted((r.row, r.red) for r in got) == [(k, int(v[0, k, 7]) or None) for k in range(30, 33)]
    reader = raster.GeoTiffReader({"path": str(tmp_path), "tile": "16"}, df.schema)
    list(reader.pushFilters([raster.GreaterThanOrEqual(("row",), 30), raster.LessThan(("row",), 33), raster.EqualTo(("col",), 7)]))
    assert [x.part for x in reader.partitions()] == [(30, 7, 3, 1)] * 2
    small = spark.read.format("geotiff").option("window", "4,6,8,10").option("factor", "2").load(str(tmp_path / "s1.tif"))
    assert small.count() == 320 and {(r.row, r.col): r.red for r in small.collect()}[15, 19] == (int(v[0, 11, 15]) or None)
    assert df.where("row > 1000").count() == 0


def test_spark_writes_what_it_reads(spark, tmp_path):
    raster.register(spark)
    p = tiff.Profile(45, 33, 2, "float32", PLACE, 32630, float("nan"), ("ndvi", "red"), {"aoi": "south"}, tile=(16, 32))
    rows = [(r, c, (r * 33 + c) / 7, None if c % 5 == 0 else float(c)) for r in range(45) for c in range(33) if r < 16 or r > 33]
    df = spark.createDataFrame(rows, "row int, col int, ndvi double, red double").repartition(4)
    path = str(tmp_path / "out" / "a.tif")
    raster.write_raster(df, path, p)
    got, _ = raster.header(path)
    assert got.names == p.names and got.tags == p.tags and got.place == p.place and got.epsg == 32630
    back = {(r.row, r.col): (r.ndvi, r.red) for r in spark.read.format("geotiff").load(path).collect()}
    assert len(back) == 45 * 33
    want = {(r, c): (a, b) for r, c, a, b in rows}
    for at, (a, b) in back.items():
        x, y = want.get(at, (None, None))
        assert (a, b) == (None if x is None else pytest.approx(x, rel=1e-6), y)
    with pytest.raises(Exception, match="beyond"):
        raster.write_raster(spark.createDataFrame([(99, 0, 1.0, 1.0)], df.schema), str(tmp_path / "b.tif"), p)
    assert not list(tmp_path.glob("b.tif*"))


def test_scene_of_bands_of_several_resolutions(spark, tmp_path):
    raster.register(spark)
    fine, coarse = tiff.Profile(40, 40, 1, "uint16", PLACE, 32630, tile=(16, 16)), tiff.Profile(20, 20, 1, "uint16", PLACE, 32630, tile=(16, 16))
    a, b = image(fine), image(coarse, 5)
    assets = {"B04_10m": saved(tmp_path / "b4.tif", fine, a), "SCL_20m": saved(tmp_path / "scl.tif", coarse, b), "B11_20m": saved(tmp_path / "b11.tif", coarse, b)}
    out = tiff.Profile(20, 20, 3, "uint16", PLACE, 32630, tile=(16, 16))
    with pytest.raises(ValueError, match="height"):
        raster.write_scene(spark, str(tmp_path / "x.tif"), out, (0, 0, 10, 10), 10, assets, {"B04_10m": 10}, ("red",))
    raster.write_scene(spark, str(tmp_path / "x.tif"), out, (0, 0, 10, 10), 10, assets, {"SCL_20m": 20, "B11_20m": 20}, ("scl", "swir1"))
    got = raster.read_scene(str(tmp_path / "x.tif"))
    assert (got[0] == b[0, :10, :10].repeat(2, 0).repeat(2, 1)).all()
    assert (got[1] == raster.read_scene(assets["B11_20m"], (0, 0, 10, 10), 2, "bilinear")[0]).all()
    assert raster.header(str(tmp_path / "x.tif"))[0].names == ("scl", "swir1")


def test_labels_with_colours_and_legend(spark, tmp_path):
    raster.register(spark)
    p = tiff.Profile(8, 8, 1, "uint8", PLACE, 32630, 0.0, tile=(16, 16))
    df = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), (F.col("id") % 3).cast("int").alias("class"))
    path = str(tmp_path / "l.tif")
    raster.write_labels(df, path, p, {10: 1, 20: 2}, {1: "trees", 2: "shrubs"}, {1: (0, 100, 0), 2: (255, 187, 34)})
    got, _ = raster.header(path)
    assert got.colours[1] == (0, 100, 0) and got.colours[2] == (255, 187, 34) and got.tags["legend"] == "1 trees\n2 shrubs" and got.tags["class_mapping"] == "10->1; 20->2"
    assert (raster.read_scene(path)[0].ravel() == np.arange(64) % 3).all()
