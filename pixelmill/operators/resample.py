"""Resampling and reprojection as arithmetic on pixel coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import geo


def nearest_up(pixels: DataFrame, factor: int) -> DataFrame:
    """Each pixel repeated factor x factor times."""
    step = F.sequence(F.lit(0), F.lit(factor - 1))
    rest = [c for c in pixels.columns if c not in ("row", "col")]
    wide = pixels.select("*", F.explode(step).alias("_i")).select("*", F.explode(step).alias("_j"))
    return wide.select((F.col("row") * factor + F.col("_i")).alias("row"), (F.col("col") * factor + F.col("_j")).alias("col"), *rest)


def bilinear_up(pixels: DataFrame, value: str, factor: int, height: int, width: int) -> DataFrame:
    """(row, col, value) at ``factor`` times the resolution, sample centres as in image warping, edges clamped.

    Every source pixel sends its weighted value to the targets that use it, so it is one partial aggregate rather than
    four joins. A target with a missing neighbour weighs the others up; one without any is null.
    """
    def axis(x, n):
        """Offsets and weights of the targets of source index x along an axis of n."""
        def entry(t):
            centre = F.greatest(F.lit(0.0), F.least((t + 0.5) / factor - 0.5, F.lit(n - 1.0)))
            return F.struct(t.cast("int").alias("t"), F.greatest(F.lit(0.0), 1 - F.abs(centre - x)).alias("w"))

        targets = F.sequence(F.greatest(F.lit(0), (x - 1) * factor), F.least(F.lit(n * factor - 1), (x + 2) * factor - 1))
        return F.filter(F.transform(targets, entry), lambda e: e["w"] > 0)

    sent = pixels.select(F.explode(axis(F.col("row"), height)).alias("r"), "col", F.col(value).alias("v")).select("r", "v", F.explode(axis(F.col("col"), width)).alias("c"))
    weight = F.col("r.w") * F.col("c.w")
    part = sent.select(F.col("r.t").alias("row"), F.col("c.t").alias("col"), F.when(F.col("v").isNotNull(), weight).alias("w"), (weight * F.col("v")).alias("wv"))
    return part.groupBy("row", "col").agg((F.sum("wv") / F.nullif(F.sum("w"), F.lit(0.0))).alias(value))


def decimated(pixels: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row and column."""
    return pixels.where((F.col("row") % step == 0) & (F.col("col") % step == 0)).withColumns({"row": F.floor(F.col("row") / step).cast("int"), "col": F.floor(F.col("col") / step).cast("int")})


def reprojected_nearest(target: DataFrame, place: geo.Affine, source: DataFrame, source_place: geo.Affine, zone: int = 30, nodata: int = 0) -> DataFrame:
    """Classes of a raster in degrees on a UTM grid: each target's centre looks up the pixel that holds it."""
    x, y = place.centre(F.col("row"), F.col("col"))
    lon, lat = geo.utm_inverse_columns(x, y, zone)
    looked = target.select("row", "col", F.floor((lat - source_place.y0) / source_place.e).cast("int").alias("_r"), F.floor((lon - source_place.x0) / source_place.a).cast("int").alias("_c"))
    values = source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "class")
    return looked.join(values, ["_r", "_c"], "left").select("row", "col", F.coalesce("class", F.lit(nodata)).alias("class"))
