"""String functions: tile ids, band names, file names, legends, and addresses of label tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelmill.functions.pixel import BANDS, INDICES, SEASONS

#: Fixed value: where the public label tiles are.
LABEL_URL = "https://esa-worldcover.s3.eu-central-1.amazonaws.com/{version}/{year}/map/ESA_WorldCover_10m_{year}_{version}_{tile}_Map.tif"


def tile_id(code: Column) -> Column:
    """A grid code without its MGRS- prefix, trimmed, in upper case; null for nothing."""
    return F.nullif(F.upper(F.trim(F.regexp_replace(code, "^MGRS-", ""))), F.lit(""))


def grid_code(tile: Column) -> Column:
    return F.concat(F.lit("MGRS-"), tile)


def resolution(band: Column) -> Column:
    """Metres in an asset's name such as B05_20m; an error for a name without."""
    digits = F.regexp_extract(band, "_([0-9]+)m$", 1)
    return F.when(digits != "", digits.cast("double")).otherwise(F.raise_error(F.concat(F.lit("no resolution in band name "), band)))


def is_scene_class(band: Column) -> Column:
    return F.contains(band, F.lit("SCL"))


def channel_names(seasons: tuple[str, ...] = SEASONS, bands: tuple[str, ...] = BANDS) -> list[str]:
    """{season}_{band} of all seasons, season by season, indices last in each."""
    return [f"{s}_{b}" for s in seasons for b in (*bands, *(i.upper() for i in INDICES))]


def scene_file(scene: Column) -> Column:
    return F.concat(scene, F.lit("_ALLBANDS.tif"))


def season_file(season: Column) -> Column:
    return F.concat(season, F.lit("_SEASONAL.tif"))


def patch_file(number: Column, kind: str) -> Column:
    return F.format_string(f"patch_%04d_{kind}.npy", number.cast("long"))


def label_path(feature_path: Column) -> Column:
    """The label file that belongs to a feature file."""
    return F.replace(feature_path, F.lit("_feature.npy"), F.lit("_label.npy"))


def label_url(tile: Column, year: str, version: str) -> Column:
    before, after = LABEL_URL.format(version=version, year=year, tile="\0").split("\0")
    return F.concat(F.lit(before), tile, F.lit(after))


def slug(title: Column) -> Column:
    """A figure's title as a file name."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), " ", "_"), "[()]", "")


def joined_tags(tags: Column) -> Column:
    """A map as 'key=value; key=value', by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")


def legend(text: Column) -> Column:
    """Lines of 'code name' as a map."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.split(x, "\\s+", 2)[0].cast("int"), F.split(x, "\\s+", 2)[1])))
