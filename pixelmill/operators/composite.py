"""Scenes to seasonal composites: masking, reflectances, indices, per-pixel medians, season stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import pixel

#: What a composite is made by. Catalogues of several tiles or years name those too, before the pixel.
KEYS = ("season", "row", "col")


def masked_pixels(raw: DataFrame, classes: tuple[int, ...] = pixel.HIDDEN_CLASSES) -> DataFrame:
    """Raw numbers to reflectances and indices; hidden pixels stay as rows of nulls. Narrow: one generated stage."""
    keys = [c for c in raw.columns if c not in (*pixel.BANDS, "scl")]
    bands = raw.select(*keys, *[pixel.reflectance(pixel.masked(F.col(b), F.col("scl"), classes)).alias(b) for b in pixel.BANDS])
    return bands.withColumns(pixel.indices(F.col("nir"), F.col("red"), F.col("swir1"), F.col("green")))


def seasonal_composite(masked: DataFrame, channels: tuple[str, ...] = pixel.CHANNELS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The median over scenes by ``keys``, skipping nulls; a pixel that is always hidden keeps a row of nulls.

    With ("tile", "year", *KEYS), tiles and years of one catalogue stay apart. A pixel's values are sorted in its row: it
    has as many as scenes, some tens at most, for which this takes less than the counting of Spark's ``median``.
    """
    def middle(values: Column) -> Column:
        n = F.size(values)
        low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2)

    lists = masked.groupBy(*keys).agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in channels])
    return lists.select(*keys, *[middle(F.col(c)).alias(c) for c in channels])


def seasonal_composite_median(masked: DataFrame, channels: tuple[str, ...] = pixel.CHANNELS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same by Spark's ``median``, which counts distinct values: for catalogues with very many scenes of a pixel."""
    return masked.groupBy(*keys).agg(*[F.median(c).alias(c) for c in channels])


def crop_partial(pixels: DataFrame, height: int, width: int, tile: int) -> DataFrame:
    """Without the right and bottom pixels that fill no whole tile."""
    return pixels.where((F.col("row") < height - height % tile) & (F.col("col") < width - width % tile))


def missing_by_block(masked: DataFrame, block: int, channels: tuple[str, ...] = pixel.CHANNELS) -> DataFrame:
    """Percent of missing values of all channels by season, scene and block, to two places (half to even)."""
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in channels), F.lit(0))
    keys = [*[F.col(k) for k in ("tile", "year") if k in masked.columns], F.col("season"), F.col("scene_id"), pixel.block(F.col("row"), block).alias("block_row"), pixel.block(F.col("col"), block).alias("block_col")]
    share = F.lit(100.0) * F.sum(missing) / (F.count("*") * len(channels))
    return masked.groupBy(*keys).agg(F.bround(share, 2).alias("nan_pct"))


def season_stack(composite: DataFrame, channels: tuple[str, ...] = pixel.CHANNELS, seasons: tuple[str, ...] = pixel.SEASONS, complete: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per pixel, with columns {season}_{channel}: one aggregate in place of three joins.

    ``composite`` has one row per ``keys``, as :func:`seasonal_composite` makes it. Pixels that lack a season are left out, or have nulls for it if not ``complete``.
    """
    picked = [F.first(F.when(F.col("season") == s, F.col(c)), ignorenulls=True).alias(f"{s}_{c}") for s in seasons for c in channels]
    stack = composite.where(F.col("season").isin(*seasons)).groupBy(*[k for k in keys if k != "season"]).agg(F.count("*").alias("n_seasons"), *picked)
    return (stack.where(F.col("n_seasons") == len(seasons)) if complete else stack).drop("n_seasons")


def channel_rows(stack: DataFrame, channels: list[str]) -> DataFrame:
    """(row, col, channel, value) of a wide table."""
    return stack.unpivot(["row", "col"], channels, "channel", "value")
