"""Scene catalogues: search, tiles, counts by season, validity of an area, evenly spaced choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.functions import geo, names, pixel


def search(items: DataFrame, start: str, end: str, max_cloud: float, grid: str | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Items from the first to the last day, cloudier ones excluded, by grid code and box if given; all pushed to the scan."""
    found = items.where((F.col("datetime") >= F.lit(start).cast("timestamp_ntz")) & (F.col("datetime") < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day")) & (F.col("cloud_cover") < max_cloud))
    if grid is not None:
        found = found.where(F.col("grid_code") == grid)
    if box is not None:
        west, south, east, north = map(F.lit, box)
        found = found.where(geo.intersects({k: F.col(k) for k in ("west", "south", "east", "north")}, {"west": west, "south": south, "east": east, "north": north}))
    return found


def tile_counts(items: DataFrame) -> DataFrame:
    """(tile, n_scenes, first_seen): first_seen is the earliest (datetime, id) of the tile."""
    named = items.withColumn("tile", names.tile_id(F.col("grid_code"))).where(F.col("tile").isNotNull())
    return named.groupBy("tile").agg(F.count("*").alias("n_scenes"), F.min(F.struct("datetime", "id")).alias("first_seen"))


def most_frequent_tile(items: DataFrame) -> DataFrame:
    """The tile of most scenes, the first seen of equals; no row for no item."""
    return tile_counts(items).orderBy(F.desc("n_scenes"), "first_seen").limit(1).select("tile", "n_scenes")


def of_most_frequent_tile(items: DataFrame) -> DataFrame:
    top = most_frequent_tile(items).select(F.col("tile").alias("top"))  # one row
    return items.join(F.broadcast(top), names.tile_id(F.col("grid_code")) == F.col("top"), "left_semi")


def season_counts(items: DataFrame, by: str = "candidate") -> DataFrame:
    """(by, season, n_scenes) with zeros for seasons without scenes; items without a date are skipped."""
    counted = [F.count_if(F.col("season") == s).alias(s) for s in pixel.SEASONS]
    wide = items.withColumn("season", pixel.season_of(F.month("datetime"))).groupBy(by).agg(*counted)
    return wide.unpivot([by], list(pixel.SEASONS), "season", "n_scenes")


def validity(counts: DataFrame, min_scenes: int, min_per_season: int, by: str = "candidate") -> DataFrame:
    """(by, total, is_valid): enough scenes in all, and in every season."""
    good = (F.sum("n_scenes") >= min_scenes) & F.bool_and(F.col("n_scenes") >= min_per_season)
    return counts.groupBy(by).agg(F.sum("n_scenes").alias("total"), good.alias("is_valid"))


def spaced_position(i: Column, n: Column, k: int) -> Column:
    """The place of the i-th of k picks among n; divided first, and half to even."""
    return F.bround(i * ((n - 1) / F.lit(k - 1))).cast("long") if k > 1 else F.lit(0).cast("long")


def evenly_spaced(items: DataFrame, k: int, by: list[str], order: list[str]) -> DataFrame:
    """At most k items of each group, evenly spaced in order, all if there are no more than k."""
    w = Window.partitionBy(*by)
    placed = items.withColumns({"place": F.row_number().over(w.orderBy(*order)) - 1, "n": F.count("*").over(w)})
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: spaced_position(i, F.col("n"), k))
    return placed.where((F.col("n") <= k) | F.array_contains(picks, F.col("place").cast("long"))).drop("n")
