import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import geo, names, pixel
from pixelmill.operators import dataset, forest
from pixelmill.sources import config, scenes, sinks
from pixelmill.streaming import incremental

RAW = {
    "aoi": {"year": 2021, "size": 50000, "candidates": {"south": [-4.7, 37.2]}, "selected": "south"},
    "stac": {"url": "https://example.org", "collection": "c"},
    "msi": {"target_resolution": 10, "band_order": ["blue", "red", "scl"], "bands": {"10": {"B02_10m": "blue", "B04_10m": "red"}, "20": {"SCL_20m": "scl"}}},
    "composites": {"seasons": {"DJF": ["2020-12-01", "2021-02-28"]}},
    "labels": {"year": 2021, "version": "v200", "class_map": {"10": 1}},
    "patches": {"size": 256, "block_size": 1024},
}


def test_config_loads_and_derives(tmp_path):
    c = config.from_dict(RAW)
    assert c.msi.scl_band_index == 2 and c.msi.num_bands == 3 and c.patches.patches_per_block == 4
    assert c.labels.class_map == {10: 1} and c.msi.assets() == ["B02_10m", "B04_10m", "SCL_20m"] and c.msi.reference_asset(20) == "SCL_20m"


@pytest.mark.parametrize(
    ("section", "change", "message"),
    [("msi", {"band_order": ["blue", "blue", "scl"]}, "duplicates"), ("msi", {"band_order": ["blue", "scl"]}, "differs"), ("patches", {"block_size": 1000}, "multiple"), ("patches", {"split": {"train": 0.5, "val": 0.5}}, "needs"),
     ("patches", {"split": {"train": 0.5, "val": 0.1, "test": 0.1}}, "sum"), ("patches", {"percentiles": [99, 1]}, "ascend"), ("patches", {"max_nan": 2}, "fraction"), ("aoi", {"selected": "north"}, "candidate")],
)
def test_config_refuses(section, change, message):
    with pytest.raises(ValueError, match=message):
        config.from_dict(RAW | {section: RAW[section] | change})


def test_reporting_writer():
    with pytest.raises(ValueError, match="yaml"):
        config.Reporting(writer="yaml")


@pytest.mark.parametrize(("block", "ok"), [(1, True), (256, True), (10240, True), (3, False), (300, False), (20480, False)])
def test_blocks_fill_the_raster(block, ok):
    if ok:
        assert config.validated_raster(10240, block) == 10240 // block
    else:
        with pytest.raises(ValueError):
            config.validated_raster(10240, block)


def test_stac_files(spark, tmp_path):
    items = [{"id": f"i{k}", "datetime": f"2021-0{k + 1}-01T00:00:00", "bbox": [0, 0, 1, 1], "properties": {"eo:cloud_cover": 10.0 * k, "grid:code": "MGRS-30STG"}, "assets": {"B02_10m": {"href": "u"}}} for k in range(4)]
    path = tmp_path / "items.json"
    path.write_text("\n".join(map(json.dumps, items)))
    df = scenes.stac_items(spark, str(path))
    assert df.count() == 4 and df.first().assets == {"B02_10m": "u"} and df.first().east == 1
    scenes.register(spark)
    got = spark.read.format("stac").load(str(path)).where((F.col("cloud_cover") < 20) & (F.col("grid_code") == "MGRS-30STG"))
    assert sorted(r.id for r in got.collect()) == ["i0", "i1"]


def test_npy_pairs(spark, tmp_path):
    for k in range(2):
        np.save(tmp_path / f"patch_{k:04d}_feature.npy", np.full((3, 4, 5), k / 10, np.float32))
        np.save(tmp_path / f"patch_{k:04d}_label.npy", np.full((4, 5), k, np.uint8))
    np.save(tmp_path / "patch_0009_label.npy", np.zeros((4, 5), np.uint8))
    rows = scenes.npy_patches(spark, str(tmp_path)).collect()
    assert [r["shape"] for r in rows] == [[3, 4, 5]] * 2 and rows[1].labels == [1] * 20
    (tmp_path / "patch_0000_label.npy").unlink()
    with pytest.raises(Exception, match="no labels"):
        scenes.npy_patches(spark, str(tmp_path)).collect()


def test_normalisation_json(spark):
    flat = {"low": [0, 10], "high": [1, 20], "median": [0.5, 15]}
    for raw in (flat, {"normalization": flat}):
        assert [tuple(r) for r in scenes.normalisation(spark, json.dumps(raw)).orderBy("channel").collect()] == [(0, 0, 1, 0.5), (1, 10, 20, 15)]
    with pytest.raises(ValueError, match="above"):
        scenes.normalisation(spark, json.dumps(flat | {"low": [2, 10]}))


def test_pixels_round_trip_with_window(spark, tmp_path):
    df = spark.range(64).select(F.lit("DJF").alias("season"), F.floor(F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), F.col("id").alias("v"))
    sinks.write_pixels(df, f"{tmp_path}/p", 4)
    got = scenes.pixels(spark, f"{tmp_path}/p", (2, 3, 2, 2), ["row", "col", "v"], 4)
    assert sorted(r.v for r in got.collect()) == [19, 20, 27, 28]


def test_report(tmp_path, spark):
    r = sinks.Report()
    r.add("step", {"n": np.int64(3), "p": tmp_path}, note="x")
    assert json.loads(r.save(tmp_path / "r.json").read_text())[0]["data"]["n"] == 3
    assert sinks.report_table(spark, r).first().step == "step"
    with pytest.raises(ValueError):
        r.save(tmp_path / "r.txt")
    with pytest.raises(TypeError):
        json.dumps(object(), default=sinks.encoded)


def test_once_computes_once(spark, tmp_path):
    calls = []
    for _ in range(2):
        df = incremental.once(spark, f"{tmp_path}/o", lambda: calls.append(1) or spark.range(3))
        assert df.count() == 3
    assert len(calls) == 1


def test_names(spark):
    df = spark.createDataFrame([("MGRS-30stg ",), ("30STG",), ("",), (None,)], "c string")
    assert [r.x for r in df.select(names.tile_id(F.col("c")).alias("x")).collect()] == ["30STG", "30STG", None, None]
    one = spark.range(1)
    assert one.select(names.slug(F.lit("All Bands (June)")).alias("x")).first().x == "all_bands_june"
    assert one.select(names.legend(F.lit("10 Tree cover\n 20 Shrubs\n")).alias("x")).first().x == {10: "Tree cover", 20: "Shrubs"}
    assert one.select(names.patch_file(F.lit(7), "label").alias("x")).first().x == "patch_0007_label.npy"
    assert one.select(names.label_url(F.lit("N36W006"), "2021", "v200").alias("x")).first().x.endswith("v200_N36W006_Map.tif")
    with pytest.raises(Exception, match="no resolution"):
        one.select(names.resolution(F.lit("visual"))).collect()


def test_npy_patches_are_written_and_read(spark, tmp_path):
    rows = [(s, n, [[float(n), None, 2.0, 3.0], [0.5] * 4], [0, 1, 255, n]) for s, n in (("train", 0), ("train", 1), ("test", 0))]
    df = spark.createDataFrame(rows, "set_name string, number int, features array<array<float>>, labels array<int>")
    for _ in range(2):  # a repeated run replaces the files
        assert {r.set_name: r.n for r in sinks.write_npy_patches(df, f"{tmp_path}/p", 2).collect()} == {"train": 2, "test": 1}
    assert sorted(str(p.relative_to(tmp_path / "p")) for p in (tmp_path / "p").rglob("*")) == ["test", "test/patch_0000_feature.npy", "test/patch_0000_label.npy", "train", *[f"train/patch_000{k}_{x}.npy" for k in (0, 1) for x in ("feature", "label")], "val"]
    x = np.load(tmp_path / "p/train/patch_0001_feature.npy")
    assert x.dtype == np.float32 and x.shape == (2, 2, 2) and np.isnan(x[0, 0, 1]) and x[0, 0, 0] == 1
    y = np.load(tmp_path / "p/train/patch_0001_label.npy")
    assert y.dtype == np.uint8 and y.tolist() == [[0, 1], [255, 1]]
    assert [r["shape"] for r in scenes.npy_patches(spark, f"{tmp_path}/p/train").collect()] == [[2, 2, 2]] * 2


def test_dataset_items(spark, tmp_path):
    for k in range(3):
        x = np.stack([np.full((4, 5), c * 10 + k, np.float32) for c in range(3)])
        x[0, 0, 0] = np.nan
        np.save(tmp_path / f"patch_{k:04d}_feature.npy", x)
        np.save(tmp_path / f"patch_{k:04d}_label.npy", np.arange(20, dtype=np.uint8).reshape(4, 5))
    stats = spark.createDataFrame([(c, c * 10.0, c * 10.0 + 10 * (c < 2), c * 10.0 + 5) for c in range(3)], "channel int, low double, high double, median double")
    got = list(dataset.arrays(dataset.loaded(spark, str(tmp_path), stats)))
    assert len(got) == 3 and all(x.dtype == np.float32 and y.dtype == np.int64 and y.shape == (4, 5) for x, y in got)
    for k, (x, _) in enumerate(got):
        assert x[0, 0, 0] == 0.5 and np.allclose(x[0].ravel()[1:], k / 10) and np.allclose(x[1], k / 10) and (x[2] == 0).all()
    turned = [dataset.arrays(dataset.loaded(spark, str(tmp_path), stats, True, s)) for s in (1, 1, 2)]
    a, b, c = ([(x.shape, y.tolist()) for x, y in t] for t in turned)
    assert a == b != c and all(sorted(sum(y, [])) == list(range(20)) for _, y in a)
    with pytest.raises(Exception, match="channels"):
        dataset.loaded(spark, str(tmp_path), stats.where("channel < 2")).collect()
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        dataset.loaded(spark, str(tmp_path / "empty"), stats)


def test_patches_metadata(spark):
    kept = spark.createDataFrame([(0, 0, 0, True), (0, 1, 2, False), (1, 0, 1, True), (1, 1, 0, True)], "row int, col int, set_id int, keep boolean")
    fractions = spark.createDataFrame([("train", 0, 0, 0.1), ("val", 1, 0, 0.2), ("train", 1, 1, 0.9)], "set_name string, patch_row int, patch_col int, nan_fraction double")
    counts = spark.createDataFrame([("train", 1, 7), ("val", 0, 2)], "set_name string, idx int, n long")
    got = sinks.patches_metadata(3, 1, 4, 16, ["DJF"], ["DJF_red"], {10: 0, 20: 1}, {10: "trees", 20: "shrubs"}, kept, fractions, counts, 0.3)
    assert json.loads(json.dumps(got)) == got
    assert got["patches_per_split"] == {"train": 1, "val": 1, "test": 0} and got["class_counts_per_split"] == {"train": [0, 7], "val": [2, 0], "test": [0, 0]}
    assert got["discarded"] == [{"row": 1, "col": 1, "nan_fraction_features": 0.9}] and got["block_labels"] == [[0, 2], [1, 0]] and got["keep_mask"] == [[1, 0], [1, 1]]
    assert got["grid_shape"] == [2, 2] and got["class_names"] == {"0": "trees", "1": "shrubs"} and got["label_mapping"] == {"10": 0, "20": 1} and "git_sha" in got


def test_analysis_of_candidates(spark):
    tiles = spark.createDataFrame([("a", "30S"), ("a", "30T"), ("a", "30S"), ("b", "31S")], "candidate string, tile string")
    counts = spark.createDataFrame([(c, s, n) for c, n in (("a", 6), ("b", 4)) for s in ("DJF", "MAM", "JJA", "SON")], "candidate string, season string, n_scenes long")
    got = sinks.analysis({"a": (0, 0, 1, 1), "b": (1, 1, 2, 2), "c": (3, 3, 4, 4)}, tiles, counts, 20, 5)
    assert got.valid_candidates == ["a"] and got.candidates_results["a"].grid_code == ["30S", "30T"] and got.candidates_results["c"].scene_counts["DJF"] == 0
    assert json.loads(json.dumps(got, default=sinks.encoded))["candidates_results"]["b"]["bbox"] == [1, 1, 2, 2]


def test_provenance_tags():
    tags = sinks.raster_tags(["red", "nir"], "south", stage="x", n=3)
    assert tags["channel_names"] == "red,nir" and tags["n_channels"] == "2" and tags["n"] == "3" and {"created_utc", "git_sha", "git_dirty", "aoi"} <= set(tags) and all(isinstance(v, str) for v in tags.values())


def grid_file(path, polygons, **more):
    features = [{"type": "Feature", "properties": {"ll_tile": k}, "geometry": {"type": kind, "coordinates": c}} for k, (kind, c) in polygons.items()]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features, **more}))
    return str(path)


def test_grid_polygons_that_meet_an_area(spark, tmp_path):
    ring = lambda *p: [[list(map(float, x)) for x in (*p, p[0])]]
    polygons = {
        "inside": ("Polygon", ring((1.2, 1.2), (1.4, 1.2), (1.3, 1.4))), "around": ("Polygon", ring((-9, -9), (9, -9), (9, 9), (-9, 9))), "touches": ("Polygon", ring((2, 2), (3, 2), (3, 3))),
        "corner only of its box": ("Polygon", ring((3.2, 0.9), (3.2, 3.2), (0.9, 3.2))), "far": ("Polygon", ring((5, 5), (6, 5), (6, 6))), "crosses": ("Polygon", ring((0, 1.4), (3, 1.5), (3, 1.6), (0, 1.5))),
        "hole": ("Polygon", ring((-9, -9), (9, -9), (9, 9), (-9, 9)) + ring((0, 0), (3, 0), (3, 3), (0, 3))), "part": ("MultiPolygon", [ring((7, 7), (8, 7), (8, 8)), ring((1, 1), (1.5, 1), (1, 1.5))]),
    }
    df = scenes.vector_grid(spark, grid_file(tmp_path / "g.json", polygons))
    met = lambda box, d=df: {r.ll_tile for r in d.where(geo.polygon_intersects(F.col("rings"), geo.corners(box))).collect()}
    assert met((1.0, 1.0, 2.0, 2.0)) == {"inside", "around", "touches", "crosses", "part"}
    assert met((5.2, 5.1, 5.3, 5.15)) == {"around", "hole", "far"}
    assert df.first().epsg == 4326
    with pytest.raises(Exception, match="no reference system"):
        scenes.vector_grid(spark, grid_file(tmp_path / "n.json", polygons, crs=None)).collect()
    named = scenes.vector_grid(spark, grid_file(tmp_path / "u.json", polygons, crs={"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32630"}}))
    assert named.first().epsg == 32630
    x, y = geo.utm(-4.7, 37.25)
    utm = {"home": ("Polygon", ring((x - 50, y - 50), (x + 50, y - 50), (x + 50, y + 50), (x - 50, y + 50))), "away": ("Polygon", ring((x + 9e4, y), (x + 9.1e4, y), (x + 9e4, y + 10)))}
    there = scenes.vector_grid(spark, grid_file(tmp_path / "v.json", utm, crs={"type": "name", "properties": {"name": "EPSG:32630"}}))
    assert {r.ll_tile for r in there.where(geo.polygon_intersects(F.col("rings"), geo.corners((-4.71, 37.24, -4.69, 37.26), 32630))).collect()} == {"home"}
    with pytest.raises(ValueError, match="3857"):
        geo.corners((0, 0, 1, 1), 3857)


def test_polygons_against_sampling(spark):
    """Random triangles and a box: whether they meet, by dense sampling of the triangle."""
    r = np.random.default_rng(4)
    rows, want = [], {}
    t = np.array([(a, b) for a in np.linspace(0, 1, 60) for b in np.linspace(0, 1, 60) if a + b <= 1])
    for k in range(150):
        p = r.random((3, 2)) * 4
        pts = p[0] + t[:, :1] * (p[1] - p[0]) + t[:, 1:] * (p[2] - p[0])
        inside = ((pts >= 1.5) & (pts <= 2.5)).all(1).any()
        near = ((pts >= 1.42) & (pts <= 2.58)).all(1).any()
        if inside or not near:
            want[k] = bool(inside)
            rows.append((k, [[*map(list, p.tolist()), p[0].tolist()]]))
    df = spark.createDataFrame(rows, "k int, rings array<array<array<double>>>")
    got = {x.k: x.m for x in df.select("k", geo.polygon_intersects(F.col("rings"), geo.corners((1.5, 1.5, 2.5, 2.5))).alias("m")).collect()}
    assert got == want and 20 < sum(want.values()) < len(want) - 20


def test_guards(spark):
    from pixelmill.operators import split

    df = spark.createDataFrame([(0, 0, 0, 1)], "seed int, row int, col int, set_id int")
    with pytest.raises(ValueError, match="exceeds"):
        split.buffered(df, 3, (2, 9))
    for section, change, message in (("msi", {"target_resolution": 15}, "target"), ("stac", {"url": ""}, "url"), ("stac", {"collection": ""}, "collection")):
        with pytest.raises(ValueError, match=message):
            config.from_dict(RAW | {section: RAW[section] | change})
    c = config.from_dict(RAW)
    assert c.msi.channels == ("blue", "red", "NDVI", "NDBI", "NDWI") and c.msi.by_band()["scl"] == "SCL_20m" and c.msi.by_asset()["B02_10m"] == "blue"


def test_seasons_by_windows(spark):
    w = {"DJF": ("2021-12-01", "2022-02-28"), "MAM": ("2021-03-01", "2021-05-31")}
    df = spark.createDataFrame([("2021-01-15 10:00:00",), ("2021-12-01 00:00:00",), ("2022-02-28 23:59:59",), ("2022-03-01 00:00:00",), ("2021-05-31 12:00:00",), (None,)], "d string")
    got = [r.s for r in df.select(pixel.season_in(F.col("d").cast("timestamp_ntz"), w).alias("s")).collect()]
    assert got == [None, "DJF", "DJF", None, "MAM", None]


def test_forest(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("idx"), (F.col("id") % 2 * 5 + F.rand(1)).alias("a"), F.when(F.col("id") % 7 > 0, F.rand(2)).alias("b"))
    noisy = df.unionByName(df.limit(5).withColumn("idx", F.lit(255)))
    got = forest.predicted(forest.fitted(noisy, ["a", "b"], 5, 3), df)
    assert got.columns == ["idx", "a", "b", "predicted"] and got.where("idx = predicted").count() == 400


def test_stac_folder(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps({"id": f"i{k}", "datetime": "2021", "properties": {"eo:cloud_cover": k * 1.0}}) + "\n\n")
    scenes.register(spark)
    df = spark.read.format("stac").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3 and df.count() == 3
