"""Every raster operator as a query over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import geo, names, pixel
from pixelmill.operators import catalog, composite, labels, network, patches, quantiles, resample, split
from pixelmill.plans import tables as t
from pixelmill.sources import raster, scenes, sinks, tiff
from pixelmill.sources.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
AOI = {"west": -5.0, "south": 37.0, "east": -4.4, "north": 37.5}
NAMES = {0: "no data", 1: "trees", 2: "shrubs", 3: "grass", 4: "crops"}
#: As many seeds as the reference tries.
SEEDS, RADIUS = 200, 1


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _masked(spark: SparkSession, d: str) -> DataFrame:
    return composite.masked_pixels(t.raw_pixels(spark, d))


def _composite(spark: SparkSession, d: str) -> DataFrame:
    return composite.seasonal_composite(_masked(spark, d))


# --- pixels

_P = 'season, scene_id, "row", col'


@query(f"with {t.RAW_SQL} select {_P}, scl, scl in (0, 1, 3, 7, 8, 9, 10, 11) as is_masked from raw")
def scl_mask(spark: SparkSession, d: str) -> DataFrame:
    return t.raw_pixels(spark, d).select("season", "scene_id", "row", "col", "scl", pixel.hidden(F.col("scl")).alias("is_masked"))


@query(f"with {t.RAW_SQL} select {_P}, " + ", ".join(f"case when {b} = 0 then null else greatest({b} * cast(0.0001 as double) + cast(-0.1 as double), 0.0::double) end as {b}" for b in pixel.BANDS) + " from raw")
def rescale_reflectance(spark: SparkSession, d: str) -> DataFrame:
    return t.raw_pixels(spark, d).select("season", "scene_id", "row", "col", *[pixel.reflectance(F.col(b)).alias(b) for b in pixel.BANDS])


@query(f"with {t.MASKED_SQL} select {_P}, {', '.join(pixel.CHANNELS)} from masked")
def masked_bands_and_indices(spark: SparkSession, d: str) -> DataFrame:
    return _masked(spark, d).select("season", "scene_id", "row", "col", *pixel.CHANNELS)


def _index(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _masked(spark, d).select("season", "scene_id", "row", "col", name)

    run.__name__ = name
    return query(f"with {t.MASKED_SQL} select {_P}, {name} from masked")(run)


ndvi, ndbi, ndwi = map(_index, pixel.INDICES)


@query(f'with {t.COMPOSITE_SQL} select season, "row", col, {", ".join(pixel.CHANNELS)} from composite')
def seasonal_composite(spark: SparkSession, d: str) -> DataFrame:
    return _composite(spark, d)


@query(f'with {t.COMPOSITE_SQL} select season, "row", col, {", ".join(pixel.CHANNELS)} from composite')
def seasonal_composite_median(spark: SparkSession, d: str) -> DataFrame:
    return composite.seasonal_composite_median(_masked(spark, d))


_MISSING = " + ".join(f"case when {c} is null then 1 else 0 end" for c in pixel.CHANNELS)


@query(f'with {t.MASKED_SQL} select season, scene_id, cast("row" // {t.BLOCK} as int) as block_row, cast(col // {t.BLOCK} as int) as block_col, round_even(100.0::double * sum({_MISSING}) / (count(*) * 13), 2) as nan_pct from masked group by all')
def nan_pct_by_block(spark: SparkSession, d: str) -> DataFrame:
    return composite.missing_by_block(_masked(spark, d), t.BLOCK)


@query(f'with {t.RAW_SQL} select {_P}, scl from raw where "row" < 72 and col < 72')
def partial_block_crop(spark: SparkSession, d: str) -> DataFrame:
    return composite.crop_partial(t.raw_pixels(spark, d), t.SIDE, t.SIDE, 24).select("season", "scene_id", "row", "col", "scl")


_STACKED = tuple(f"{s}_{c}" for s in pixel.SEASONS for c in pixel.CHANNELS)
_STACK = ", ".join(f"max(case when season = '{s}' then {c} end) as {s}_{c}" for s in pixel.SEASONS for c in pixel.CHANNELS)


@query(f'with {t.COMPOSITE_SQL} select "row", col, {_STACK} from composite group by "row", col having count(distinct season) = 4')
def season_stack(spark: SparkSession, d: str) -> DataFrame:
    return composite.season_stack(_composite(spark, d))


@query("select * from (values " + ", ".join(f"('{n}', {k})" for k, n in enumerate(names.channel_names())) + ") v(channel, place)")
def channel_names(spark: SparkSession, d: str) -> DataFrame:
    seasons, channels = F.array(*map(F.lit, pixel.SEASONS)), F.array(*[F.lit(b) for b in (*pixel.BANDS, *[i.upper() for i in pixel.INDICES])])
    every = F.flatten(F.transform(seasons, lambda s: F.transform(channels, lambda c: F.concat_ws("_", s, c))))
    return spark.range(1).select(F.posexplode(every).alias("place", "channel")).select("channel", "place")


@query(f'with {t.COMPOSITE_SQL}, p as (select quantile_cont(red, 0.02) as lo, quantile_cont(red, 0.98) as hi from composite) select season, "row", col, round(case when red is null then null else least(greatest((red - lo) / nullif(hi - lo, 0), 0), 1) end, 9) as stretched from composite, p')
def contrast_stretch(spark: SparkSession, d: str) -> DataFrame:
    pixels = Scratch(spark, "stretch").write(_composite(spark, d).select("season", "row", "col", "red"), "red")
    limits = quantiles.checked(quantiles.percentiles(pixels, [], "red", {"lo": 0.02, "hi": 0.98}), 1)
    return pixels.crossJoin(limits).select("season", "row", "col", F.round(pixel.stretched(F.col("red"), F.col("lo"), F.col("hi")), 9).alias("stretched"))


@query(f'with {t.MASKED_SQL} select season, count(*) as n, min(red) as min_red, max(red) as max_red, round(avg(red), 9) as mean_red, round(stddev_pop(red), 9) as std_red from masked group by season')
def band_summary(spark: SparkSession, d: str) -> DataFrame:
    return _masked(spark, d).groupBy("season").agg(F.count("*").alias("n"), F.min("red").alias("min_red"), F.max("red").alias("max_red"), F.round(F.avg("red"), 9).alias("mean_red"), F.round(F.stddev_pop("red"), 9).alias("std_red"))


# --- catalogue


@query(f"with {t.ITEMS_SQL} select id, datetime, cloud_cover, grid_code from items where datetime >= '1996-03-01' and datetime < '1996-06-01' and cloud_cover < 30 and grid_code = 'MGRS-1-URGENT'")
def scene_search(spark: SparkSession, d: str) -> DataFrame:
    return catalog.search(t.stac_items(spark, d), "1996-03-01", "1996-05-31", 30.0, grid="MGRS-1-URGENT").select("id", "datetime", "cloud_cover", "grid_code")


@query(f"with {t.ITEMS_SQL}, s as (select *, {t.SEASON_SQL.format('datetime')} as season from items), dims as (select * from (select distinct candidate from items), (values ('DJF'), ('MAM'), ('JJA'), ('SON')) v(season)) select dims.candidate, dims.season, count(s.id) as n_scenes from dims left join s on s.candidate = dims.candidate and s.season = dims.season and s.cloud_cover < 10 group by all")
def season_scene_counts(spark: SparkSession, d: str) -> DataFrame:
    items = t.stac_items(spark, d)
    return catalog.season_counts(items.select("candidate", F.when(F.col("cloud_cover") < 10, F.col("datetime")).alias("datetime")))


_WINDOWS = {"DJF": ("1996-12-01", "1997-02-28"), "MAM": ("1996-03-01", "1996-05-31"), "JJA": ("1996-06-01", "1996-08-31"), "SON": ("1996-09-01", "1996-11-30")}


@query(f"with {t.ITEMS_SQL} select id, season from items join (values {', '.join(f'({chr(39)}{k}{chr(39)}, date {chr(39)}{a}{chr(39)}, date {chr(39)}{b}{chr(39)})' for k, (a, b) in _WINDOWS.items())}) v(season, a, b) on cast(datetime as date) between a and b")
def season_windows(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of one year's seasons by their first and last days; the winter ends in the next year."""
    return t.stac_items(spark, d).select("id", pixel.season_in(F.col("datetime"), _WINDOWS).alias("season")).where("season is not null")


@query(f"with {t.ITEMS_SQL}, c as (select candidate, {', '.join(f'count(*) filter (where {t.SEASON_SQL.format("datetime")} = {chr(39)}{s}{chr(39)}) as {s}' for s in pixel.SEASONS)} from items where cloud_cover < 10 group by candidate) select candidate, cast(DJF + MAM + JJA + SON as bigint) as total, DJF + MAM + JJA + SON >= 30 and least(DJF, MAM, JJA, SON) >= 5 as is_valid from c")
def aoi_validity(spark: SparkSession, d: str) -> DataFrame:
    return catalog.validity(catalog.season_counts(t.stac_items(spark, d).where("cloud_cover < 10")), 30, 5)


@query(f"with {t.ITEMS_SQL} select upper(trim(regexp_replace(grid_code, '^MGRS-', ''))) as tile, count(*) as n_scenes from items where cloud_cover < 10 group by 1 order by 2 desc, min((datetime, id)) limit 1")
def most_frequent_tile(spark: SparkSession, d: str) -> DataFrame:
    return catalog.most_frequent_tile(t.stac_items(spark, d).where("cloud_cover < 10"))


@query(f"with {t.ITEMS_SQL}, s as (select id, datetime, candidate, {t.SEASON_SQL.format('datetime')} as season from items where cloud_cover < 10), p as (select *, row_number() over w - 1 as place, count(*) over (partition by candidate, season) as n from s window w as (partition by candidate, season order by datetime, id)) select candidate, season, id, place from p where n <= 10 or list_contains(list_transform(range(0, 10), lambda i: cast(round_even(i * ((n - 1) / 9::double), 0) as bigint)), place)")
def evenly_spaced_scenes(spark: SparkSession, d: str) -> DataFrame:
    items = t.stac_items(spark, d).where("cloud_cover < 10").withColumn("season", pixel.season_of(F.month("datetime")))
    return catalog.evenly_spaced(items, 10, ["candidate", "season"], ["datetime", "id"]).select("candidate", "season", "id", F.col("place").cast("long").alias("place"))


@query(f"with {t.ITEMS_SQL} select id, nullif(upper(trim(regexp_replace(grid_code, '^MGRS-', ''))), '') as tile, 'MGRS-' || nullif(upper(trim(regexp_replace(grid_code, '^MGRS-', ''))), '') as code from items")
def tile_id_parse(spark: SparkSession, d: str) -> DataFrame:
    tile = names.tile_id(F.col("grid_code"))
    return t.stac_items(spark, d).select("id", tile.alias("tile"), names.grid_code(tile).alias("code"))


@query("select p_partkey, cast(regexp_extract('B' || lpad(cast(p_size % 12 + 1 as varchar), 2, '0') || '_' || cast((p_size % 3 + 1) * 10 as varchar) || 'm', '_([0-9]+)m$', 1) as double) as resolution from part")
def resolution_from_name(spark: SparkSession, d: str) -> DataFrame:
    name = F.format_string("B%02d_%dm", F.col("p_size") % 12 + 1, (F.col("p_size") % 3 + 1) * 10)
    return t.table(spark, d, "part").select("p_partkey", names.resolution(name).alias("resolution"))


@query(f"with {t.ITEMS_SQL} select id, cast(id as varchar) || '_ALLBANDS.tif' as scene, {t.SEASON_SQL.format('datetime')} || '_SEASONAL.tif' as season, 'patch_' || lpad(cast(id % 10000 as varchar), 4, '0') || '_label.npy' as label from items")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    feature = names.patch_file(F.col("id") % 10000, "feature")
    season = names.season_file(pixel.season_of(F.month("datetime")))
    return t.stac_items(spark, d).select("id", names.scene_file(F.col("id").cast("string")).alias("scene"), season.alias("season"), names.label_path(feature).alias("label"))


# --- labels

_CODED = "case \"class\" when 0 then 0 when 1 then 10 when 2 then 20 when 3 then 30 when 4 then 40 else 50 end"


@query(f'with {t.LABEL_SQL}, coded as (select "row", col, {_CODED} as code from labels_r) select "row", col, case code when 10 then 1 when 20 then 2 when 30 then 2 when 50 then 3 else 0 end as "class" from coded')
def reclass_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.reclass(t.label_raster(spark, d).withColumn("class", F.col("class") * 10), {10: 1, 20: 2, 30: 2, 50: 3})


@query(f'with {t.LABEL_SQL}, known as (select "class", dense_rank() over (order by "class") - 1 as idx from (select distinct "class" from labels_r where "class" <> 0)) select l."row", l.col, l."class", cast(coalesce(idx, 255) as int) as idx from labels_r l left join known using ("class")')
def remap_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.remapped(t.label_raster(spark, d)).select("row", "col", "class", "idx")


@query(f'with {t.LABEL_SQL} select cast("row" - 5 as int) as "row", cast(col - 11 as int) as col, "class" from labels_r where "row" between 5 and 64 and col between 11 and 70')
def geotiff_window(spark: SparkSession, d: str) -> DataFrame:
    """The labels written as a GeoTIFF, and a window of it read again; pixels that no scene has are missing."""
    raster.register(spark)
    where = Scratch(spark, "geotiff").path("labels.tif")
    profile = tiff.Profile(t.SIDE, t.SIDE, 1, "uint8", geo.Affine(200780.0, 4151040.0, 640.0, -640.0), 32630, 255.0, ("class",), tile=(32, 32))
    raster.write_raster(t.label_raster(spark, d), where, profile)
    return spark.read.format("geotiff").option("window", "5,11,60,60").option("tile", "32").load(where).where("`class` is not null").select("row", "col", "class")


_NAME = "case \"class\" " + " ".join(f"when {k} then '{v}'" for k, v in NAMES.items()) + " else 'unknown' end"


@query(f'with {t.LABEL_SQL}, n as (select "class", count(*) as pixels from labels_r group by 1), s as (select *, sum(pixels) over () as total, sum(case when "class" <> 0 then pixels end) over () as valid from n) select "class", {_NAME} as name, pixels, round_even(100.0::double * pixels / total, 3) as pct_total, case when "class" <> 0 then round_even(100.0::double * pixels / valid, 3) end as pct_valid, "class" <> 0 and 100.0::double * pixels / valid < 0.5 as is_rare from s')
def class_stats(spark: SparkSession, d: str) -> DataFrame:
    return labels.class_stats(t.label_raster(spark, d), NAMES)


@query(f'with {t.LABEL_SQL}, n as (select "class", count(*) as pixels from labels_r group by 1) select cast(sum(pixels) as bigint) as total_pixels, round_even(100.0::double * coalesce(sum(pixels) filter (where "class" = 0), 0) / sum(pixels), 3) as nodata_pct, count(*) filter (where "class" <> 0) as n_classes_present, (select string_agg(cast(v as varchar), \',\' order by v) from (select unnest(range(0, 12)) as v) where v not in (select "class" from n)) as missing_classes, round_even(max(pixels) filter (where "class" <> 0) / (min(pixels) filter (where "class" <> 0))::double, 2) as imbalance_ratio from n')
def class_summary(spark: SparkSession, d: str) -> DataFrame:
    return labels.class_summary(t.label_raster(spark, d), list(range(12)))


@query(f'with {t.LABEL_SQL} select v as "class" from (select unnest(range(0, 12))::int as v) where v not in (select "class" from labels_r)')
def missing_classes(spark: SparkSession, d: str) -> DataFrame:
    known = spark.range(12).select(F.col("id").cast("int").alias("class"))
    return known.join(t.label_raster(spark, d).select("class").distinct(), "class", "left_anti")


_COUNTS = f'counts as (select cast("row" // {t.PATCH} as int) as patch_row, cast(col // {t.PATCH} as int) as patch_col, "class", count(*) as n from labels_r group by all)'


@query(f"with {t.LABEL_SQL}, {_COUNTS} select * from counts")
def patch_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels.patch_class_counts(t.label_raster(spark, d), t.PATCH)


@query(f'with {t.LABEL_SQL}, {t.SECOND_SQL}, tiles as (select *, 2 as k from labels_r where col >= 30 union all select *, 1 as k from labels_s where col < 50) select "row", col, coalesce(arg_min("class", k) filter (where "class" <> 0), 0) as "class" from tiles group by all')
def mosaic_first_valid(spark: SparkSession, d: str) -> DataFrame:
    a, b = t.label_raster(spark, d).where("col >= 30"), t.second_raster(spark, d).where("col < 50")
    return labels.mosaic(a.withColumn("tile_order", F.lit(2)).unionByName(b.withColumn("tile_order", F.lit(1))))


@query(f'with {t.LABEL_SQL}, {t.SECOND_SQL} select "row", col, coalesce(nullif(a."class", 0), nullif(b."class", 0), 0) as "class" from labels_s a full join labels_r b using ("row", col)')
def overlay_rasters(spark: SparkSession, d: str) -> DataFrame:
    return labels.overlaid(t.second_raster(spark, d), t.label_raster(spark, d))


@query(f'with {t.LABEL_SQL}, {t.SECOND_SQL} select a."class" as class_a, b."class" as class_b, count(*) as n from labels_r a join labels_s b using ("row", col) group by all')
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return labels.confusion(t.label_raster(spark, d), t.second_raster(spark, d))


@query(f'with {t.LABEL_SQL}, {t.SECOND_SQL} select 100.0::double * count(*) filter (where a."class" <> b."class") / count(*) as disagreement_pct from labels_r a join labels_s b using ("row", col)')
def raster_disagreement(spark: SparkSession, d: str) -> DataFrame:
    return labels.disagreement(labels.confusion(t.label_raster(spark, d), t.second_raster(spark, d)))


# --- split

_CELLS = f"cells as (select seed, block, row_number() over (partition by seed order by md5(seed || ':' || block)) as place from (select unnest(range(0, {SEEDS}))::int as seed), (select unnest(range(0, 25))::int as block)), blocks as (select seed, cast(block // 5 as int) as block_row, cast(block % 5 as int) as block_col, case when place <= 4 then 2 when place <= 8 then 1 else 0 end as set_id from cells)"
_EXPANDED = f'{_CELLS}, patches as (select seed, cast(block_row * 4 + i as int) as "row", cast(block_col * 4 + j as int) as col, set_id from blocks, (select unnest(range(0, 4)) as i), (select unnest(range(0, 4)) as j))'
_KEPT = f'{_EXPANDED}, kept as (select p.seed, p."row", p.col, p.set_id, bool_and(p.set_id = q.set_id) as keep from patches p join patches q on p.seed = q.seed and q."row" between p."row" - {RADIUS} and p."row" + {RADIUS} and q.col between p.col - {RADIUS} and p.col + {RADIUS} group by all)'
_SCORED = f'{_KEPT}, sizes as (select seed, count(*) filter (where keep and set_id = 0) as n_train, count(*) filter (where keep and set_id = 1) as n_val, count(*) filter (where keep and set_id = 2) as n_test from kept group by seed), {t.LABEL_SQL}, {_COUNTS}, pairs as (select seed, count(distinct (set_id, "class")) as pairs from kept join counts on "row" = patch_row and col = patch_col where keep group by seed), scored as (select seed, n_train, n_val, n_test, least(n_train, n_val, n_test) as score, coalesce(pairs, 0) = 3 * (select count(distinct "class") from counts) as covers from sizes left join pairs using (seed))'
_BEST = f"{_SCORED}, best as (select * from scored where covers order by score desc, seed limit 1)"


def _kept(spark: SparkSession) -> DataFrame:
    return split.buffered(split.expanded(split.assigned_by_hash(spark, 5, SEEDS), 4), RADIUS)


def _scores(spark: SparkSession, d: str, kept: DataFrame | None = None) -> DataFrame:
    return split.seed_scores(_kept(spark) if kept is None else kept, labels.patch_class_counts(t.label_raster(spark, d), t.PATCH))


def _specs(spark: SparkSession, d: str) -> DataFrame:
    kept = Scratch(spark, "split").write(_kept(spark), "kept")
    best = split.best_seed(_scores(spark, d, kept)).select("seed")  # one row: no need to collect it
    name = F.element_at(F.array(*map(F.lit, split.SETS)), F.col("set_id") + 1)
    return kept.where("keep").join(F.broadcast(best), "seed", "left_semi").select("row", "col", name.alias("set_name"))


_SPECS = f"{_BEST}, specs as (select \"row\", col, case set_id when 0 then 'train' when 1 then 'val' else 'test' end as set_name from kept where keep and seed = (select seed from best))"


@query(f"with {_CELLS} select * from blocks")
def assign_blocks_md5(spark: SparkSession, d: str) -> DataFrame:
    return split.assigned_by_hash(spark, 5, SEEDS)


@query(f"with {_EXPANDED} select * from patches")
def expand_blocks(spark: SparkSession, d: str) -> DataFrame:
    return split.expanded(split.assigned_by_hash(spark, 5, SEEDS), 4)


@query(f"with {_KEPT} select * from kept")
def buffer_mask(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark)


@query(f"with {_SCORED} select * from scored")
def seed_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


@query(f"with {_BEST} select * from best")
def select_seed(spark: SparkSession, d: str) -> DataFrame:
    return split.best_seed(_scores(spark, d))


@query(f"with {_SPECS} select * from specs")
def patch_specs(spark: SparkSession, d: str) -> DataFrame:
    return _specs(spark, d)


def _shuffled(seed: int) -> list[int]:
    """The set of each of 25 blocks, as numpy's default generator deals them: 4 of test, 4 of validation, 17 of training."""
    ids = np.array([2] * 4 + [1] * 4 + [0] * 17, np.uint8)
    np.random.default_rng(seed).shuffle(ids)
    return ids.tolist()


_DRAWN = ", ".join(f"({seed}, {_shuffled(seed)})" for seed in range(SEEDS))


@query(f"with drawn as (select * from (values {_DRAWN}) v(seed, ids)), b as (select seed, unnest(range(0, 25)) as k, ids from drawn) select seed, cast(k // 5 as int) as block_row, cast(k % 5 as int) as block_col, cast(ids[k + 1] as int) as set_id from b")
def assign_blocks_rng(spark: SparkSession, d: str) -> DataFrame:
    return split.assigned_by_rng(spark, 5, list(range(SEEDS)))


# --- patches: all channels of all seasons, every pixel of the grid (one that no scene has is missing), all seeds

_MOST_MISSING = 0.3
_FRACTIONS = f"""{_SPECS}, {t.COMPOSITE_SQL}, stack as (select "row", col, {_STACK} from composite group by "row", col),
cells_in as (select cast(s."row" * {t.PATCH} + i as int) as "row", cast(s.col * {t.PATCH} + j as int) as col, s."row" as patch_row, s.col as patch_col, set_name from specs s, (select unnest(range(0, {t.PATCH})) as i), (select unnest(range(0, {t.PATCH})) as j)),
inside as (select c.*, {", ".join(_STACKED)} from cells_in c left join stack d on d."row" = c."row" and d.col = c.col),
fractions as (select set_name, patch_row, patch_col, sum({' + '.join(f'case when {c} is null then 1 else 0 end' for c in _STACKED)}) / ({t.PATCH * t.PATCH} * 52)::double as nan_fraction from inside group by all)"""
_NUMBERED = f"{_FRACTIONS}, numbered as (select *, cast(row_number() over (partition by set_name order by patch_row // 4, patch_col // 4, patch_row, patch_col) - 1 as int) as number from fractions where nan_fraction <= {_MOST_MISSING})"
_LABELLED = f'{_NUMBERED}, known as (select "class", cast(dense_rank() over (order by "class") - 1 as int) as idx from (select distinct "class" from labels_r where "class" <> 0)), placed as (select i.*, number, coalesce(idx, 255) as idx from inside i join numbered n using (patch_row, patch_col) left join labels_r l on l."row" = i."row" and l.col = i.col left join known k on k."class" = l."class")'


def _inside(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of the chosen patches with all channels, written once: what follows reads them several times."""
    step = F.sequence(F.lit(0), F.lit(t.PATCH - 1))
    patch = _specs(spark, d).select(F.col("row").alias("patch_row"), F.col("col").alias("patch_col"), "set_name")
    rows = patch.select("*", F.explode(step).alias("i")).select("*", F.explode(step).alias("j"))
    pixels = rows.select((F.col("patch_row") * t.PATCH + F.col("i")).alias("row"), (F.col("patch_col") * t.PATCH + F.col("j")).alias("col"), "patch_row", "patch_col", "set_name")
    return Scratch(spark, "patches").write(pixels.join(composite.season_stack(_composite(spark, d), complete=False), ["row", "col"], "left"), "inside")


def _filtered(inside: DataFrame) -> DataFrame:
    return patches.kept_patches(patches.missing_fraction(inside, list(_STACKED)), _MOST_MISSING)


def _numbered(inside: DataFrame) -> DataFrame:
    return patches.numbered(_filtered(inside), 4)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    inside = _inside(spark, d)
    kept = inside.drop("set_name").join(_numbered(inside).select("patch_row", "patch_col", "set_name", "number"), ["patch_row", "patch_col"])
    placed = kept.join(labels.remapped(Scratch(spark, "labels").write(t.label_raster(spark, d), "labels")).select("row", "col", "idx"), ["row", "col"], "left")
    return placed.withColumn("idx", F.coalesce("idx", F.lit(pixel.IGNORE)))


@query(f"with {_FRACTIONS} select * from fractions where nan_fraction <= {_MOST_MISSING}")
def patch_nan_filter(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(_inside(spark, d))


@query(f"with {_NUMBERED} select set_name, patch_row, patch_col, number from numbered")
def patch_numbering(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(_inside(spark, d)).select("set_name", "patch_row", "patch_col", "number")


@query(f"with {_LABELLED} select set_name, idx, count(*) as n from placed where idx <> 255 group by all")
def split_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return patches.split_class_counts(_placed(spark, d))


@query(f"with {_NUMBERED} select set_name, count(*) as n_patches from numbered group by all")
def split_patch_counts(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(_inside(spark, d)).groupBy("set_name").agg(F.count("*").alias("n_patches"))


@query(f"with {_LABELLED} select \"row\", col, {', '.join(_STACKED)} from placed where set_name = 'train' and (\"row\" * 7919 + col * 104729) % 100 < 25")
def train_sample(spark: SparkSession, d: str) -> DataFrame:
    return patches.sampled(_placed(spark, d).where("set_name = 'train'"), 25).select("row", "col", *_STACKED)


_MICRO = "case when {0} is null then '' else cast(cast(round({0} * 1000000) as bigint) as varchar) end"


@query(f"""with {_LABELLED},
channels as (select set_name, number, "row", col, idx, [{', '.join(_MICRO.format(c) for c in _STACKED)}] as v from placed),
flat as (select set_name, number, list(v order by "row", col) as pixels, array_to_string(list(idx order by "row", col), ',') as labels from channels group by set_name, number)
select set_name, number, array_to_string(list_transform(range(1, 53), lambda c: array_to_string(list_transform(pixels, lambda p: p[c]), ',')), ';') as features, labels from flat""")
def extract_patches(spark: SparkSession, d: str) -> DataFrame:
    """The tensors as text: millionths, channels apart by semicolons, pixels by commas; a missing value is empty."""
    found = patches.tensors(_placed(spark, d), list(_STACKED), t.PATCH, "double")
    micro = lambda v: F.coalesce(F.round(v * 1_000_000).cast("long").cast("string"), F.lit(""))
    channels = F.transform("features", lambda c: F.array_join(F.transform(c, micro), ","))
    return found.select("set_name", "number", F.array_join(channels, ";").alias("features"), F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query(f"""with {_LABELLED},
missing as (select set_name, number, sum({' + '.join(f'case when {c} is null then 1 else 0 end' for c in _STACKED)})::bigint as n_missing, array_to_string(list(idx order by "row", col), ',') as labels from placed group by set_name, number)
select set_name || '/patch_' || lpad(number::varchar, 4, '0') as name, n_missing, labels, {52 * t.PATCH * t.PATCH}::bigint as n_values from missing""")
def npy_patch_files(spark: SparkSession, d: str) -> DataFrame:
    """The patches written as pairs of .npy files and read again."""
    where = Scratch(spark, "npy").path("patches")
    sinks.write_npy_patches(patches.tensors(_placed(spark, d), list(_STACKED), t.PATCH), where, t.PATCH).collect()
    found = scenes.npy_patches(spark, where + "/*")
    missing = F.size(F.filter("features", lambda v: v.isNull() | F.isnan(v)))
    name = F.regexp_extract("name", "([a-z]+/patch_[0-9]+)$", 1)
    return found.select(name.alias("name"), missing.cast("long").alias("n_missing"), F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"), F.size("features").cast("long").alias("n_values"))


@query(f"with {_SPECS} select \"row\" as patch_row, col as patch_col, set_name, cast(\"row\" * {t.PATCH} as int) as \"row\", cast(col * {t.PATCH} as int) as col, {t.PATCH} as height, {t.PATCH} as width from specs")
def patch_windows(spark: SparkSession, d: str) -> DataFrame:
    found = _specs(spark, d).withColumn("w", pixel.patch_window(F.col("row"), F.col("col"), t.PATCH))
    return found.select(F.col("row").alias("patch_row"), F.col("col").alias("patch_col"), "set_name", "w.*")


_STATS = f"{t.VALUES_SQL}, stats as (select channel, quantile_cont(value, 0.01) as low, quantile_cont(value, 0.99) as high, median(value) as median, avg(value) as mean, stddev_pop(value) as std from vals group by channel)"


@query(f"with {_STATS} select cast(channel as int) as channel, round(low, 6) as low, round(high, 6) as high, round(median, 6) as median, round(mean, 6) as mean, round(std, 6) as std from stats")
def channel_stats(spark: SparkSession, d: str) -> DataFrame:
    return patches.channel_stats(Scratch(spark, "stats").write(t.vector_values(spark, d), "values"))


@query(f"with {_STATS} select cast(channel as int) as channel, round(high - low, 6) as width from stats")
def percentile_range(spark: SparkSession, d: str) -> DataFrame:
    stats = patches.channel_stats(Scratch(spark, "stats").write(t.vector_values(spark, d), "values"), places=None)
    return stats.select("channel", F.round(pixel.percentile_range(F.col("low"), F.col("high")), 6).alias("width"))


@query(f"with {_STATS} select vec_id, cast(channel as int) as channel, round(case when high > low then (least(greatest(value, low), high) - low) / (high - low) else 0 end, 6) as norm from vals join stats using (channel)")
def normalize_pixels(spark: SparkSession, d: str) -> DataFrame:
    values = Scratch(spark, "normalise").write(t.vector_values(spark, d), "values")
    found = patches.normalised(values, patches.channel_stats(values, places=None))
    return found.select("vec_id", "channel", F.round("norm", 6).alias("norm"))


_DRAW = "('0x' || substr(md5('0:' || patch_id), 1, 4))::int"
_AUG = f'{t.LABEL_SQL}, p as (select cast("row" // 4 * 20 + col // 4 as int) as patch_id, cast("row" % 4 as int) as r0, cast(col % 4 as int) as c0, "class" from labels_r), a as (select *, {_DRAW} as draw from p), f as (select patch_id, "class", draw // 4 % 4 as turns, case when draw % 2 = 1 then 3 - c0 else c0 end as c, case when draw // 2 % 2 = 1 then 3 - r0 else r0 end as r from a)'


@query(f'with {_AUG} select patch_id, "class", cast(case turns when 1 then 3 - c when 2 then 3 - r when 3 then c else r end as int) as "row", cast(case turns when 1 then r when 2 then 3 - c when 3 then 3 - r else c end as int) as col from f')
def flip_rot90(spark: SparkSession, d: str) -> DataFrame:
    placed = t.label_raster(spark, d).select((pixel.block(F.col("row"), 4) * 20 + pixel.block(F.col("col"), 4)).alias("patch_id"), (F.col("row") % 4).alias("row"), (F.col("col") % 4).alias("col"), "class")
    return patches.augmented(placed, 4)


# --- geometry and resampling

_LAT, _LON = "(36.0::double + s_suppkey % 40 * 0.1::double)", "(-6.0::double + s_suppkey % 70 * 0.1::double)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    s = t.table(spark, d, "supplier")
    return s.select("s_suppkey", (F.lit(36.0) + F.col("s_suppkey") % 40 * F.lit(0.1)).alias("lat"), (F.lit(-6.0) + F.col("s_suppkey") % 70 * F.lit(0.1)).alias("lon"))


@query(f"select s_suppkey, round(50000 / 110574.0::double, 9) as dlat, round(50000 / (111320.0::double * cos(radians({_LAT}))), 9) as dlon from supplier")
def deg_per_m(spark: SparkSession, d: str) -> DataFrame:
    dlat, dlon = geo.degrees_for(50000.0, F.col("lat"))
    return _points(spark, d).select("s_suppkey", F.round(dlat, 9).alias("dlat"), F.round(dlon, 9).alias("dlon"))


@query(f"with p as (select s_suppkey, {_LAT} as lat, {_LON} as lon from supplier), h as (select *, 25000 / 110574.0::double as dlat, 25000 / (111320.0::double * cos(radians(lat))) as dlon from p) select s_suppkey, round(lon - dlon, 9) as west, round(lat - dlat, 9) as south, round(lon + dlon, 9) as east, round(lat + dlat, 9) as north from h")
def create_bbox(spark: SparkSession, d: str) -> DataFrame:
    sides = geo.box(F.col("lat"), F.col("lon"), 50000.0)
    return _points(spark, d).select("s_suppkey", *[F.round(c, 9).alias(k) for k, c in sides.items()])


@query(f"with {t.GRID_SQL} select ll_tile from grid where west <= {AOI['east']} and east >= {AOI['west']} and south <= {AOI['north']} and north >= {AOI['south']}")
def grid_intersects_aoi(spark: SparkSession, d: str) -> DataFrame:
    return t.grid(spark, d).where(geo.intersects({k: F.col(k) for k in AOI}, {k: F.lit(v) for k, v in AOI.items()})).select("ll_tile")


@query(f'with {t.LABEL_SQL} select cast("row" * 2 + i as int) as "row", cast(col * 2 + j as int) as col, "class" from labels_r, (select unnest(range(0, 2)) as i), (select unnest(range(0, 2)) as j)')
def nearest_upsample(spark: SparkSession, d: str) -> DataFrame:
    return resample.nearest_up(t.label_raster(spark, d), 2)


_AXIS = "select unnest(range(0, 160))::int as t"
_BILINEAR = f"""{t.LABEL_SQL}, axis as (select t, greatest(0, least((t + 0.5) / 2 - 0.5, 79)) as centre from ({_AXIS})),
w as (select t, x, 1 - abs(centre - x) as w from axis, (select unnest(range(0, 80))::int as x) where abs(centre - x) < 1)"""


@query(f'with {_BILINEAR} select r.t as "row", c.t as col, round(sum(r.w * c.w * l."class") / sum(r.w * c.w), 9) as value from labels_r l join w r on r.x = l."row" join w c on c.x = l.col group by all')
def bilinear_upsample(spark: SparkSession, d: str) -> DataFrame:
    up = resample.bilinear_up(t.label_raster(spark, d).withColumn("value", F.col("class").cast("double")), "value", 2, t.SIDE, t.SIDE)
    return up.select("row", "col", F.round("value", 9).alias("value"))


@query(f'with {t.LABEL_SQL} select cast("row" // 4 as int) as "row", cast(col // 4 as int) as col, "class" from labels_r where "row" % 4 = 0 and col % 4 = 0')
def decimate(spark: SparkSession, d: str) -> DataFrame:
    return resample.decimated(t.label_raster(spark, d), 4)


def _series(terms: tuple[float, ...], angle: str, other: str, outer: str, inner: str) -> str:
    """A Krüger series in SQL: the sum of c * outer(2j * angle) * inner(2j * other)."""
    part = {"sinh": "((exp({0}) - exp(-({0}))) / 2)", "cosh": "((exp({0}) + exp(-({0}))) / 2)", "": "1"}[inner]
    return " + ".join(f"({c!r}::double) * {outer}({2 * k} * {angle}) * {part.format(f'{2 * k} * {other}')}" for k, c in enumerate(terms, 1))


_REPROJECTED = f"""{t.LABEL_SQL}, {t.SECOND_SQL},
m as (select "row", col, (4151040.0::double + ("row" + 0.5::double) * -640.0) / {geo.SCALE!r}::double as xi, (200780.0::double + (col + 0.5::double) * 640.0 - 500000.0) / {geo.SCALE!r}::double as eta from labels_r),
ab as (select "row", col, xi - ({_series(geo.BACK, 'xi', 'eta', 'sin', 'cosh')}) as a, eta - ({_series(geo.BACK, 'xi', 'eta', 'cos', 'sinh')}) as b from m),
chi as (select *, asin(sin(a) / ((exp(b) + exp(-b)) / 2)) as chi from ab),
ll as (select "row", col, chi + {_series(geo.LATITUDE, 'chi', '0', 'sin', '')} as phi, -3.0::double + degrees(atan2((exp(b) - exp(-b)) / 2, cos(a))) as lon from chi),
placed as (select "row", col, cast(floor((degrees(phi) - 38.0::double) / -0.02::double) as int) as r, cast(floor((lon + 6.5::double) / 0.02::double) as int) as c from ll)"""


@query(f'with {_REPROJECTED} select p."row", p.col, coalesce(s."class", 0) as "class" from placed p left join labels_s s on s."row" = p.r and s.col = p.c')
def reproject_nearest(spark: SparkSession, d: str) -> DataFrame:
    target = t.label_raster(spark, d).select("row", "col")
    source = t.second_raster(spark, d)
    return resample.reprojected_nearest(target, geo.Affine(200780.0, 4151040.0, 640.0, -640.0), source, geo.Affine(-6.5, 38.0, 0.02, -0.02))


# --- names, colours, network


_URL = names.LABEL_URL.format(version="v200", year="2021", tile="\0").split("\0")


@query(f"with {t.GRID_SQL} select ll_tile, '{_URL[0]}' || ll_tile || '{_URL[1]}' as url from grid")
def label_urls(spark: SparkSession, d: str) -> DataFrame:
    return t.grid(spark, d).select("ll_tile", names.label_url(F.col("ll_tile"), "2021", "v200").alias("url"))


@query("select p_partkey, p_size % 256 / 255.0::double as r, p_partkey % 256 / 255.0::double as g from part")
def rgb_unit(spark: SparkSession, d: str) -> DataFrame:
    unit = pixel.rgb_unit(F.array((F.col("p_size") % 256).cast("double"), (F.col("p_partkey") % 256).cast("double")))
    return t.table(spark, d, "part").select("p_partkey", unit.alias("c")).select("p_partkey", F.col("c")[0].alias("r"), F.col("c")[1].alias("g"))


_LAYERS = network.layers(network.Shape())


@query("select sum(case kind when 'pair' then 9 * a * b + 9 * b * b + 4 * b when 'up' then 4 * a * b + b else a * b + b end)::bigint as parameters from (values " + ", ".join(f"('{k}', {a}::bigint, {b}::bigint)" for _, k, a, b in _LAYERS) + ") v(kind, a, b)")
def network_parameters(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(_LAYERS, "name string, kind string, a long, b long")
    a, b = F.col("a"), F.col("b")
    size = F.when(F.col("kind") == "pair", 9 * a * b + 9 * b * b + 4 * b).when(F.col("kind") == "up", 4 * a * b + b).otherwise(a * b + b)
    return rows.agg(F.sum(size).alias("parameters"))
