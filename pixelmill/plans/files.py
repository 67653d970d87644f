"""Queries that write files and read them again, and those over small tables, with the SQL that says the same."""

from __future__ import annotations

import http.server
import json
import threading
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import geo, names, pixel
from pixelmill.operators import catalog, dataset, patches
from pixelmill.plans import queries as q
from pixelmill.plans import tables as t
from pixelmill.plans.queries import query
from pixelmill.sources import client, config, raster, scenes, sinks, tiff
from pixelmill.sources.scratch import Scratch
from pixelmill.streaming import incremental

_CHANNELS = ", ".join(pixel.CHANNELS)


def _put(spark: SparkSession, path: str, text: str) -> str:
    """A small text file in any file system Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path


# --- pixels and rasters in files


@query(f'with {t.COMPOSITE_SQL} select season, "row", col, red, nir, ndvi from composite where "row" between 13 and 42 and col between 20 and 31')
def pixels_window(spark: SparkSession, d: str) -> DataFrame:
    """A composite laid out by season and block, and a window of some bands of it."""
    where = Scratch(spark, "pixels").path("composite")
    sinks.write_pixels(q._composite(spark, d), where, t.BLOCK)
    return scenes.pixels(spark, where, (13, 20, 30, 12), ["season", "row", "col", "red", "nir", "ndvi"], t.BLOCK)


@query(f"""with {t.COMPOSITE_SQL} select season, "row", col, {_CHANNELS} from composite where season in ('DJF', 'JJA') and "row" < 64 and col < 64""")
def composite_files(spark: SparkSession, d: str) -> DataFrame:
    """Composites of two seasons, without partial blocks, each made once as a GeoTIFF of 13 bands and read again."""
    raster.register(spark)
    scratch = Scratch(spark, "composites")
    made = scratch.write(q._composite(spark, d).where("row < 64 and col < 64"), "composite")
    tags = sinks.raster_tags(list(pixel.CHANNELS), "south", stage="seasonal_composite")
    profile = tiff.Profile(64, 64, 13, "float64", geo.Affine(200780.0, 4151040.0, 640.0, -640.0), 32630, float("nan"), pixel.CHANNELS, tags, tile=(32, 32))
    out = None
    for season in ("DJF", "JJA"):
        path = scratch.path(f"{season}_SEASONAL.tif")
        raster.write_raster(made.where(F.col("season") == season), path, profile)
        found = spark.read.format("geotiff").option("tile", "32").load(path).join(made.where(F.col("season") == season).select("row", "col"), ["row", "col"], "left_semi")
        part = found.select(F.regexp_extract("file", "^([A-Z]+)_", 1).alias("season"), "row", "col", *pixel.CHANNELS)
        out = part if out is None else out.unionByName(part)
    return out


@query("select * from (values ('channel_names', 'blue,green,red,red_edge1,red_edge2,red_edge3,nir,narrow_nir,swir1,swir2,ndvi,ndbi,ndwi'), ('n_channels', '13'), ('aoi', 'south'), ('stage', 'seasonal_composite'), ('size', '6x7x2'), ('epsg', '32630'), ('corner', '200780,4151040'), ('pixel', '640'), ('has_time', 'true'), ('has_revision', 'true')) v(name, value)")
def raster_header(spark: SparkSession, d: str) -> DataFrame:
    """What a raster's header says of it: size, place, names, and provenance tags."""
    tags = sinks.raster_tags(list(pixel.CHANNELS), "south", stage="seasonal_composite")
    path = Scratch(spark, "header").path("a.tif")
    profile = tiff.Profile(6, 7, 2, "uint16", geo.Affine(200780.0, 4151040.0, 640.0, -640.0), 32630, 0.0, ("a", "b"), tags, tile=(16, 16))
    raster.write_raster(spark.range(1).selectExpr("0 as row", "0 as col", "1 as a", "2 as b"), path, profile)
    found, _ = raster.header(path)
    rows = [(k, found.tags[k]) for k in ("channel_names", "n_channels", "aoi", "stage")]
    rows += [("size", f"{found.height}x{found.width}x{found.bands}"), ("epsg", str(found.epsg)), ("corner", f"{found.place.x0:.0f},{found.place.y0:.0f}"), ("pixel", f"{abs(found.place.a):.0f}")]
    rows += [("has_time", str(found.tags.get("created_utc", "").startswith("20")).lower()), ("has_revision", str("git_sha" in found.tags and "git_dirty" in found.tags).lower())]
    return spark.createDataFrame(rows, "name string, value string")


@query(f'with {t.RAW_SQL}, b as (select "row", col, max(red) as red, max(scl) as scl from raw where season = \'MAM\' and "row" < 40 and col < 40 group by all) select cast("row" * 2 + i as int) as "row", cast(col * 2 + j as int) as col, scl from b, (select unnest(range(0, 2)) as i), (select unnest(range(0, 2)) as j)')
def scene_files(spark: SparkSession, d: str) -> DataFrame:
    """A scene of two bands at half the resolution, resampled band by band into one file: classes keep their values."""
    raster.register(spark)
    scratch = Scratch(spark, "scene")
    made = scratch.write(t.raw_pixels(spark, d).where("season = 'MAM' and row < 40 and col < 40").groupBy("row", "col").agg(F.max("red").alias("red"), F.max("scl").alias("scl")), "bands")
    coarse = tiff.Profile(40, 40, 1, "uint16", geo.Affine(200780.0, 4151040.0, 20.0, -20.0), 32630, 60000.0, tile=(16, 16))
    assets = {"B04_20m": scratch.path("b4.tif"), "SCL_20m": scratch.path("scl.tif")}
    for asset, band in zip(assets, ("red", "scl"), strict=True):
        raster.write_raster(made, assets[asset], coarse, [band])
    fine = tiff.Profile(80, 80, 2, "uint16", geo.Affine(200780.0, 4151040.0, 10.0, -10.0), 32630, 60000.0, tile=(32, 32))
    raster.write_scene(spark, scratch.path("s_ALLBANDS.tif"), fine, (0, 0, 40, 40), 10, assets, dict.fromkeys(assets, 20), ("red", "scl"))
    return spark.read.format("geotiff").load(scratch.path("s_ALLBANDS.tif")).where("scl is not null").select("row", "col", "scl")


_COLOURS = {1: (0, 100, 0), 2: (255, 187, 34), 3: (255, 255, 76), 4: (240, 150, 255)}


@query("select * from (values " + ", ".join(f"({k}, '{v}', {_COLOURS.get(k, (0, 0, 0))[0]}, {_COLOURS.get(k, (0, 0, 0))[1]}, {_COLOURS.get(k, (0, 0, 0))[2]})" for k, v in q.NAMES.items()) + ') v("class", name, red, green, blue)')
def label_legend(spark: SparkSession, d: str) -> DataFrame:
    """The legend and the colours that a label raster carries, read from its header."""
    path = Scratch(spark, "labels").path("labels.tif")
    profile = tiff.Profile(t.SIDE, t.SIDE, 1, "uint8", geo.Affine(200780.0, 4151040.0, 640.0, -640.0), 32630, 0.0, tile=(32, 32))
    raster.write_labels(t.label_raster(spark, d), path, profile, {10 * k: k for k in q.NAMES}, q.NAMES, _COLOURS)
    found, _ = raster.header(path)
    text = spark.createDataFrame([(found.tags["legend"],)], "legend string")
    legend = text.select(F.explode(names.legend(F.col("legend"))).alias("class", "name"))
    colours = spark.createDataFrame([(k, *v) for k, v in found.colours.items() if k in q.NAMES], "class int, red int, green int, blue int")
    return legend.join(colours, "class")


@query(f'with {t.LABEL_SQL} select "class", count(*) as pixels from labels_r group by "class"')
def computed_once(spark: SparkSession, d: str) -> DataFrame:
    """A table that is made by the first of two runs and only read by the second."""
    path, made = Scratch(spark, "once").path("counts"), []

    def make() -> DataFrame:
        made.append(1)
        return t.label_raster(spark, d).groupBy("class").agg(F.count("*").alias("pixels"))

    incremental.once(spark, path, make)
    found = incremental.once(spark, path, make)
    if len(made) != 1:
        raise RuntimeError("the table was made again")
    return found


# --- grids and geometry


@query(f"with {t.GRID_SQL} select ll_tile, 4326 as epsg, west, south, east, north from grid")
def grid_file(spark: SparkSession, d: str) -> DataFrame:
    """The grid written as GeoJSON and read again."""
    rows = t.grid(spark, d).orderBy("ll_tile").collect()  # a row per tile: 25
    ring = lambda r: [[[r.west, r.south], [r.east, r.south], [r.east, r.north], [r.west, r.north], [r.west, r.south]]]
    features = [{"type": "Feature", "properties": {"ll_tile": r.ll_tile}, "geometry": {"type": "Polygon", "coordinates": ring(r)}} for r in rows]
    path = _put(spark, Scratch(spark, "grid").path("grid.geojson"), json.dumps({"type": "FeatureCollection", "features": features}))
    return scenes.vector_grid(spark, path).select("ll_tile", "epsg", "west", "south", "east", "north")


@query("""with p as (select n_nationkey as k, (n_nationkey % 5) * 2.0 as x, (n_nationkey // 5) * 2.0 as y from nation) select k from p where (x + 1.5 >= 2.5 and x + 0.5 <= 6.5 and y + 1.5 >= 1.5 and y + 0.5 <= 4.5) and x + y + 2 >= 4 and (x + 1) - (y + 1.5) <= 5 and (x + 1) + (y + 0.5) <= 11 and (y + 0.5) - (x + 1) <= 2""")
def polygons_meet_area(spark: SparkSession, d: str) -> DataFrame:
    """Diamonds of half a degree around points that meet a box."""
    n = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 5 * 2.0).alias("x"), (F.floor(F.col("n_nationkey") / 5) * 2.0).alias("y"))
    x, y = F.col("x") + 1, F.col("y") + 1
    ring = F.array(*[F.array(x + a, y + b) for a, b in ((0.5, 0.0), (0.0, 0.5), (-0.5, 0.0), (0.0, -0.5), (0.5, 0.0))])
    return n.where(geo.polygon_intersects(F.array(ring), geo.corners((2.5, 1.5, 6.5, 4.5)))).select("k")


@query("select p_partkey, cast(ceil(p_size * 50.0 / 10 / 256) as int) as radius from part")
def buffer_radii(spark: SparkSession, d: str) -> DataFrame:
    """Patches that buffers of 50 m times the part's size span, from a table of the 50 sizes."""
    sizes = spark.createDataFrame([(k, geo.buffer_radius(k * 50.0, 256, 10.0)) for k in range(1, 51)], "p_size int, radius int")
    return t.table(spark, d, "part").select("p_partkey", "p_size").join(F.broadcast(sizes), "p_size").select("p_partkey", "radius")


@query(f'with {t.LABEL_SQL} select "row", col, 200780.0::double + (col + 0.5::double) * 640.0::double as x, 4151040.0::double + ("row" + 0.5::double) * -640.0::double as y from labels_r')
def pixel_centres(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.Affine(200780.0, 4151040.0, 640.0, -640.0).centre(F.col("row"), F.col("col"))
    return t.label_raster(spark, d).select("row", "col", x.alias("x"), y.alias("y"))


def _northing(phi: str, lam: str) -> str:
    """Krüger's forward series in SQL: (easting, northing) of radians of latitude and of longitude from the meridian."""
    e = 2 * np.sqrt(geo._N) / (1 + geo._N)
    sinh, cosh, atanh = (lambda z: f"((exp({z}) - exp(-({z}))) / 2)"), (lambda z: f"((exp({z}) + exp(-({z}))) / 2)"), (lambda z: f"(ln((1 + ({z})) / (1 - ({z}))) / 2)")
    tau = sinh(f"{atanh(f'sin({phi})')} - {float(e)!r}::double * {atanh(f'{float(e)!r}::double * sin({phi})')}")
    xs = " + ".join(f"{c!r}::double * cos({2 * j} * xi) * {sinh(f'{2 * j} * eta')}" for j, c in enumerate(geo._FORWARD, 1))
    ys = " + ".join(f"{c!r}::double * sin({2 * j} * xi) * {cosh(f'{2 * j} * eta')}" for j, c in enumerate(geo._FORWARD, 1))
    return f"""tau as (select *, {tau} as tau from ll), m as (select *, atan2(tau, cos({lam})) as xi, {atanh(f"sin({lam}) / sqrt(1 + tau * tau)")} as eta from tau),
xy as (select *, 500000 + {geo.SCALE!r}::double * (eta + {xs}) as x, {geo.SCALE!r}::double * (xi + {ys}) as y from m)"""


_BOXES = [(k, -5.2 + 0.13 * k, 36.9 + 0.07 * k, -4.8 + 0.13 * k, 37.2 + 0.07 * k) for k in range(12)]
_EDGES = """select k, w + (e - w) * t as lon, s as lat from b, ts union all select k, e, s + (n - s) * t from b, ts union all select k, w + (e - w) * t, n from b, ts union all select k, w, s + (n - s) * t from b, ts"""


@query(f"""with b as (select * from (values {', '.join(f'({k}, {w!r}::double, {s!r}::double, {e!r}::double, {n!r}::double)' for k, w, s, e, n in _BOXES)}) v(k, w, s, e, n)), ts as (select unnest(range(0, 21)) / 20.0::double as t),
pts as ({_EDGES}), ll as (select k, radians(lat) as phi, radians(lon + 3.0::double) as lam from pts), {_northing('phi', 'lam')},
o as (select k, min(x) as x1, max(x) as x2, min(y) as y1, max(y) as y2 from xy group by k)
select k, cast(floor((4200000 - y2) / 10) as bigint) as "row", cast(floor((x1 - 199980) / 10) as bigint) as col, cast(round_even((y2 - y1) / 10, 0) as bigint) as height, cast(round_even((x2 - x1) / 10, 0) as bigint) as width from o""")
def area_windows(spark: SparkSession, d: str) -> DataFrame:
    """The pixel windows of boxes in degrees on a UTM raster, their edges densified."""
    rows = [(k, *[int(geo.pixel_window((w, s, e, n), 199980.0, 4200000.0, 10.0)[c]) for c in ("row", "col", "height", "width")]) for k, w, s, e, n in _BOXES]
    return spark.createDataFrame(rows, "k int, row long, col long, height long, width long")


# --- catalogues


@query(f"with {t.ITEMS_SQL}, c as (select *, upper(trim(regexp_replace(grid_code, '^MGRS-', ''))) as tile from items where cloud_cover < 10), top as (select tile from c group by tile order by count(*) desc, min((datetime, id)) limit 1) select id, tile from c where tile = (select tile from top)")
def scenes_of_commonest_tile(spark: SparkSession, d: str) -> DataFrame:
    found = catalog.of_most_frequent_tile(t.stac_items(spark, d).where("cloud_cover < 10"))
    return found.select("id", names.tile_id(F.col("grid_code")).alias("tile"))


@query(f"with {t.ITEMS_SQL} select upper(trim(regexp_replace(grid_code, '^MGRS-', ''))) as tile, count(*) as n_scenes, min(datetime) as first_day from items group by 1")
def distinct_tiles(spark: SparkSession, d: str) -> DataFrame:
    return catalog.tile_counts(t.stac_items(spark, d)).select("tile", "n_scenes", F.col("first_seen.datetime").alias("first_day"))


@query(f"with {t.ITEMS_SQL} select id::varchar as id, round(cloud_cover, 6) as cloud_cover, grid_code from items where cloud_cover < 20 and grid_code = 'MGRS-2-HIGH'")
def catalogue_files(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue written as JSON lines and searched through the data source, which takes the predicates."""
    scenes.register(spark)
    where = Scratch(spark, "items").path("items")
    properties = F.struct(F.col("cloud_cover").alias("eo:cloud_cover"), F.col("grid_code").alias("grid:code"))
    items = t.stac_items(spark, d).select(F.col("id").cast("string").alias("id"), F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), properties.alias("properties"))
    items.write.json(where)
    found = spark.read.format("stac").load(where).where((F.col("cloud_cover") < 20) & (F.col("grid_code") == "MGRS-2-HIGH"))
    return found.select("id", F.round("cloud_cover", 6).alias("cloud_cover"), "grid_code")


# --- statistics, dataset items, tags, configuration


@query(f"with {q._STATS} select cast(channel as int) as channel, round(low, 6) as low, round(high, 6) as high, round(median, 6) as median, round(case when high > low then (least(greatest(median, low), high) - low) / (high - low) else 0 end, 6) as normalised_median from stats")
def normalisation_file(spark: SparkSession, d: str) -> DataFrame:
    """Statistics written as JSON and read again, with the normalised median."""
    stats = patches.channel_stats(Scratch(spark, "stats").write(t.vector_values(spark, d), "values"), places=None)
    text = json.dumps({"normalization": sinks.statistics(stats, (1.0, 99.0), list(pixel.SEASONS), names.channel_names())}, default=sinks.encoded)
    found = scenes.normalisation(spark, text)
    own = pixel.normalised(F.col("median"), F.col("low"), F.col("high"), F.col("median"))
    return found.select("channel", *[F.round(c, 6).alias(c) for c in ("low", "high", "median")], F.round(own, 6).alias("normalised_median"))


@query(f"""with {q._LABELLED}, v as (select set_name, number, "row", col, idx, {", ".join(f"case when JJA_{c} is null then null else JJA_{c} end as {c}" for c in ("red", "nir"))} from placed where set_name = 'val'),
n as (select *, case when red is null then 0.25::double else least(greatest(red, 0), 0.5::double) * 2 end as x, case when nir is null then 0.75::double else least(greatest(nir, 0), 0.5::double) * 2 end as y from v)
select 'val/patch_' || lpad(number::varchar, 4, '0') as name, 2 * {t.PATCH * t.PATCH} as n_values, round(sum(x), 4) as red, round(sum(y), 4) as nir, sum(idx)::bigint as labels from n group by set_name, number""")
def dataset_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of two channels, normalised: the sums of each channel and of the labels."""
    two = ["JJA_red", "JJA_nir"]
    where = Scratch(spark, "items").path("patches")
    sinks.write_npy_patches(patches.tensors(q._placed(spark, d).where("set_name = 'val'"), two, t.PATCH), where, t.PATCH).collect()
    stats = spark.createDataFrame([(0, 0.0, 0.5, 0.125), (1, 0.0, 0.5, 0.375)], "channel int, low double, high double, median double")
    found = dataset.items(scenes.npy_patches(spark, where + "/*"), stats)
    total = lambda a, b: F.aggregate(F.slice("features", a, b), F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    n = t.PATCH * t.PATCH
    return found.select(F.regexp_extract("name", "([a-z]+/patch_[0-9]+)$", 1).alias("name"), F.size("features").alias("n_values"), F.round(total(1, n), 4).alias("red"), F.round(total(n + 1, n), 4).alias("nir"), F.aggregate("labels", F.lit(0).cast("long"), lambda acc, v: acc + v).alias("labels"))


@query("select * from (values (1, '10=trees; 20=shrubs'), (2, 'a=1')) v(k, tags)")
def tag_strings(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, {"20": "shrubs", "10": "trees"}), (2, {"a": "1"})], "k int, tags map<string, string>")
    return rows.select("k", names.joined_tags(F.col("tags")).alias("tags"))


_BANDS = {10: {"B02_10m": "blue", "B04_10m": "red", "B08_10m": "nir"}, 20: {"B11_20m": "swir1", "SCL_20m": "scl"}}


@query("select * from (values (0, 'blue', 'B02_10m', 10, true), (1, 'red', 'B04_10m', 10, true), (2, 'nir', 'B08_10m', 10, true), (3, 'swir1', 'B11_20m', 20, true), (4, 'scl', 'SCL_20m', 20, false)) v(place, band, asset, resolution, spectral)")
def band_table(spark: SparkSession, d: str) -> DataFrame:
    """Bands in order with their assets, from a TOML file."""
    body = '[aoi]\nyear = 2021\nsize = 50000\nselected = "south"\n[aoi.candidates]\nsouth = [-4.7, 37.2]\n[stac]\nurl = "https://example.org"\ncollection = "c"\n[msi]\ntarget_resolution = 10\nband_order = ["blue", "red", "nir", "swir1", "scl"]\n'
    body += "".join(f"[msi.bands.{r}]\n" + "".join(f'{a} = "{b}"\n' for a, b in own.items()) for r, own in _BANDS.items())
    body += '[composites.seasons]\nDJF = ["2021-12-01", "2022-02-28"]\n[labels]\nyear = 2021\nversion = "v200"\n[labels.class_map]\n10 = 1\n[patches]\nsize = 256\nblock_size = 1024\n'
    msi = config.from_toml(body).msi
    rows = [(msi.position(b), b, msi.by_band()[b], b in msi.spectral) for b in msi.band_order]
    table = spark.createDataFrame(rows, "place int, band string, asset string, spectral boolean")
    return table.select("place", "band", "asset", names.resolution(F.col("asset")).cast("int").alias("resolution"), "spectral")


@query("select * from (values ('patch_split', '{\"seed\": 3, \"n\": 7}', 'south', true), ('paths', '{\"root\": \"/data\"}', null, true)) v(step, data, aoi, is_utc)")
def report_entries(spark: SparkSession, d: str) -> DataFrame:
    """A report's steps; times are ISO in UTC."""
    report = sinks.Report()
    report.add("patch_split", {"seed": np.int64(3), "n": np.int32(7)}, aoi="south")
    report.add("paths", {"root": Path("/data")})
    return sinks.report_table(spark, report).select("step", "data", F.col("metadata")["aoi"].alias("aoi"), F.col("ts").endswith("+00:00").alias("is_utc"))


# --- a service, folders, and what configurations give and refuse


class _Service:
    """A catalogue of a few items on this machine, ten a page; every other request is refused at first."""

    def __init__(self, items: list[dict]):
        service, self.refused = self, set()

        class Handler(http.server.BaseHTTPRequestHandler):
            def log_message(self, *args: object) -> None:
                pass

            def do_POST(self) -> None:
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                self._answer(int(body.get("from", 0)), body)

            def _answer(self, start: int, body: dict) -> None:
                if start not in service.refused and start % 20 == 0:
                    service.refused.add(start)
                    self.send_response(503)
                    self.send_header("Retry-After", "0")
                    self.end_headers()
                    return
                most = body["query"]["eo:cloud_cover"]["lt"]
                found = [i for i in items if i["properties"]["eo:cloud_cover"] < most]
                page: dict = {"features": found[start : start + 10]}
                if start + 10 < len(found):
                    page["links"] = [{"rel": "next", "method": "POST", "href": f"{service.url}/search", "body": body | {"from": start + 10}}]
                raw = json.dumps(page).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(raw)

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@query("select 'N' || n_nationkey as id, n_nationkey * 2.0::double as cloud_cover, 'MGRS-' || n_name as grid_code, n_nationkey - 9.0::double as west, 'u' || n_nationkey as href from nation where n_nationkey * 2 < 45")
def catalogue_service(spark: SparkSession, d: str) -> DataFrame:
    """A search of a service on this machine: pages are followed, refused requests are tried again."""
    rows = t.table(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 rows
    items = [{"id": f"N{r.n_nationkey}", "datetime": "2021-03-04T05:06:07Z", "bbox": [r.n_nationkey - 9, 0, r.n_nationkey - 8, 1], "properties": {"eo:cloud_cover": r.n_nationkey * 2.0, "grid:code": f"MGRS-{r.n_name}"}, "assets": {"B02_10m": {"href": f"u{r.n_nationkey}"}}} for r in rows]
    service = _Service(items)
    try:
        found = client.StacClient(config.Stac(service.url, "c"), sleep=lambda s: None).search(spark, (-9, 0, 20, 1), "2021-01-01", "2021-12-31", 45.0)
        return found.select("id", F.col("properties.`eo:cloud_cover`").alias("cloud_cover"), F.col("properties.`grid:code`").alias("grid_code"), F.col("bbox")[0].alias("west"), F.col("assets")["B02_10m"]["href"].alias("href"))
    finally:
        service.server.shutdown()
        service.server.server_close()


@query(f"with {t.COMPOSITE_SQL} select season, count(*) as n, count(red) as n_red from composite group by season")
def season_folders(spark: SparkSession, d: str) -> DataFrame:
    """Composites by folders of seasons; a folder of another name is passed over."""
    where = Scratch(spark, "seasons").path("composite")
    made = q._composite(spark, d).select("season", "row", "col", "red")
    made.unionByName(made.limit(1).withColumn("season", F.lit("extra"))).write.partitionBy("season").parquet(where)
    return scenes.season_stack(spark, where).groupBy("season").agg(F.count("*").alias("n"), F.count("red").alias("n_red"))


_SLUG = "regexp_replace(replace(lower('Part (' || p_name || ') By ' || p_brand), ' ', '_'), '[()]', '', 'g')"


@query(f"select p_partkey, {_SLUG} as slug from part")
def figure_slugs(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.lit("Part ("), F.col("p_name"), F.lit(") By "), F.col("p_brand"))
    return t.table(spark, d, "part").select("p_partkey", names.slug(title).alias("slug"))


def _config(**change: dict) -> dict:
    raw = {
        "aoi": {"year": 2021, "size": 50000, "candidates": {"south": [-4.7, 37.2]}, "selected": "south"}, "stac": {"url": "https://example.org", "collection": "c"},
        "msi": {"target_resolution": 10, "band_order": ["blue", "red", "scl"], "bands": {"10": {"B02_10m": "blue", "B04_10m": "red"}, "20": {"SCL_20m": "scl"}}},
        "composites": {"seasons": {"DJF": ["2021-12-01", "2022-02-28"]}}, "labels": {"year": 2021, "version": "v200", "class_map": {"10": 1}}, "patches": {"size": 256, "block_size": 1024},
    }
    return {k: v | change.get(k, {}) for k, v in raw.items()}


_REFUSED = {
    "duplicate band": {"msi": {"band_order": ["blue", "blue", "scl"]}}, "unknown band": {"msi": {"band_order": ["blue", "nir", "scl"]}}, "no scene classes": {"msi": {"band_order": ["blue", "red"], "bands": {"10": {"B02_10m": "blue", "B04_10m": "red"}}}},
    "unknown resolution": {"msi": {"target_resolution": 15}}, "no address": {"stac": {"url": ""}}, "no collection": {"stac": {"collection": ""}}, "block of no whole patches": {"patches": {"block_size": 1000}},
    "split without test": {"patches": {"split": {"train": 0.5, "val": 0.5}}}, "split beyond one": {"patches": {"split": {"train": 0.9, "val": 0.1, "test": 0.1}}}, "falling percentiles": {"patches": {"percentiles": [99, 1]}},
    "unknown area": {"aoi": {"selected": "north"}}, "none": {},
}


@query("select * from (values " + ", ".join(f"('{k}', {str(bool(v)).lower()})" for k, v in _REFUSED.items()) + ") v(fault, refused)")
def refused_configurations(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for fault, change in _REFUSED.items():
        try:
            config.from_dict(_config(**change))
            rows.append((fault, False))
        except ValueError:
            rows.append((fault, True))
    return spark.createDataFrame(rows, "fault string, refused boolean")


@query("select * from (values ('num_bands', '3'), ('scl_band_index', '2'), ('patches_per_block', '4'), ('reference_asset', 'SCL_20m'), ('channels', 'blue,red,NDVI,NDBI,NDWI'), ('class_map', '10->1'), ('blocks', '10'), ('raw', '/r/raw/season=DJF'), ('labels', '/r/labels')) v(name, value)")
def derived_configuration(spark: SparkSession, d: str) -> DataFrame:
    c, paths = config.from_dict(_config()), config.Paths("/r")
    rows = [("num_bands", c.msi.num_bands), ("scl_band_index", c.msi.scl_band_index), ("patches_per_block", c.patches.patches_per_block), ("reference_asset", c.msi.reference_asset(20)), ("channels", ",".join(c.msi.channels))]
    rows += [("class_map", "; ".join(f"{a}->{b}" for a, b in c.labels.class_map.items())), ("blocks", config.validated_raster(10240, 1024)), ("raw", paths.raw("DJF")), ("labels", paths.labels)]
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "name string, value string")


@query(f"""with {t.ITEMS_SQL}, i as (select candidate, {t.SEASON_SQL.format('datetime')} as season, upper(trim(regexp_replace(grid_code, '^MGRS-', ''))) as tile from items where cloud_cover < 10),
n as (select candidate, count(*) filter (where season = 'DJF') as djf, count(*) filter (where season = 'MAM') as mam, count(*) filter (where season = 'JJA') as jja, count(*) filter (where season = 'SON') as son, count(distinct tile) as n_tiles from i group by candidate)
select 'area' || candidate as candidate, djf::bigint as djf, n_tiles::bigint as n_tiles, djf + mam + jja + son >= 30 and least(djf, mam, jja, son) >= 5 as is_valid from n""")
def candidate_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The report of all areas: tiles, scenes by season, and which are good enough."""
    items = t.stac_items(spark, d).where("cloud_cover < 10").withColumn("candidate", F.concat(F.lit("area"), "candidate"))
    boxes = {r.candidate: (0.0, 0.0, 1.0, 1.0) for r in items.select("candidate").distinct().orderBy("candidate").collect()}
    found = sinks.analysis(boxes, items.select("candidate", names.tile_id(F.col("grid_code")).alias("tile")), catalog.season_counts(items), 30, 5)
    raw = json.loads(json.dumps(found, default=sinks.encoded))
    rows = [(c, r["scene_counts"]["DJF"], len(r["grid_code"]), c in raw["valid_candidates"]) for c, r in raw["candidates_results"].items()]
    return spark.createDataFrame(rows, "candidate string, djf long, n_tiles long, is_valid boolean")


@query(f"""with {q._LABELLED}, sets as (select * from (values ('train'), ('val'), ('test')) v(set_name)),
c as (select set_name, idx, count(*) as n from placed where idx <> 255 group by all),
per as (select s.set_name, string_agg(coalesce(c.n, 0)::varchar, ',' order by k.idx) as counts from sets s cross join known k left join c on c.set_name = s.set_name and c.idx = k.idx group by s.set_name),
n as (select set_name, count(*) as n_patches from numbered group by set_name), lost as (select count(*) as n_discarded from fractions where nan_fraction > {q._MOST_MISSING})
select set_name, coalesce(n_patches, 0)::bigint as n_patches, counts as class_counts, (select seed from best)::bigint as seed, n_discarded::bigint as n_discarded, (select count(*) from kept where keep and seed = (select seed from best))::bigint as n_kept from per left join n using (set_name), lost""")
def patches_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What the JSON beside the patches says of each split."""
    scratch = Scratch(spark, "metadata")
    kept = scratch.write(q._kept(spark), "kept")
    seed = int(q.split.best_seed(q._scores(spark, d, kept)).first().seed)
    fractions = scratch.write(patches.missing_fraction(q._inside(spark, d), list(q._STACKED)), "fractions")
    classes = [r["class"] for r in q.labels.remap_table(t.label_raster(spark, d)).orderBy("idx").collect()]  # 255 at most
    made = sinks.patches_metadata(seed, q.RADIUS, t.PATCH, t.BLOCK, list(pixel.SEASONS), names.channel_names(), {c: k for k, c in enumerate(classes)}, q.NAMES | {5: "built"}, kept.where(F.col("seed") == seed), fractions, patches.split_class_counts(q._placed(spark, d)), q._MOST_MISSING)
    raw = json.loads(json.dumps(made))
    rows = [(s, raw["patches_per_split"][s], ",".join(map(str, raw["class_counts_per_split"][s])), raw["seed"], len(raw["discarded"]), sum(map(sum, raw["keep_mask"]))) for s in q.split.SETS]
    return spark.createDataFrame(rows, "set_name string, n_patches long, class_counts string, seed long, n_discarded long, n_kept long")
