"""Label rasters: class tables, statistics, mosaics, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.functions import pixel


def reclass(labels: DataFrame, mapping: dict[int, int], column: str = "class") -> DataFrame:
    return labels.withColumn(column, pixel.reclass(F.col(column), mapping))


def remap_table(labels: DataFrame, nodata: int = 0) -> DataFrame:
    """(class, idx): the distinct classes but nodata, in order, from 0; at most 256 rows."""
    distinct = labels.where(F.col("class") != nodata).select("class").distinct()
    return distinct.select("class", (F.dense_rank().over(Window.orderBy("class")) - 1).alias("idx"))


def remapped(labels: DataFrame, nodata: int = 0) -> DataFrame:
    """``labels`` with ``idx``, 255 where the class has none. The table has a row per class: an error beyond 255 of them."""
    table = remap_table(labels, nodata)
    few = table.withColumn("idx", F.when(F.col("idx") < pixel.IGNORE, F.col("idx")).otherwise(F.raise_error(F.lit("more than 255 classes")).cast("int")))
    return labels.join(F.broadcast(few), "class", "left").withColumn("idx", F.coalesce("idx", F.lit(pixel.IGNORE)))


def class_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("class").agg(F.count("*").alias("pixels"))


def class_stats(labels: DataFrame, names: dict[int, str], nodata: int = 0, rare_pct: float = 0.5) -> DataFrame:
    """(class, name, pixels, pct_total, pct_valid, is_rare): three places, half to even; rarity before rounding."""
    every = Window.partitionBy(F.lit(1))  # over counts, a row per class
    n = class_counts(labels).withColumns({"total": F.sum("pixels").over(every), "valid": F.sum(F.when(F.col("class") != nodata, F.col("pixels"))).over(every)})
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    share = F.when(F.col("class") != nodata, F.lit(100.0) * F.col("pixels") / F.col("valid"))
    return n.select(
        "class", F.coalesce(table[F.col("class")], F.lit("unknown")).alias("name"), "pixels",
        F.bround(F.lit(100.0) * F.col("pixels") / F.col("total"), 3).alias("pct_total"), F.bround(share, 3).alias("pct_valid"), F.coalesce(share < rare_pct, F.lit(False)).alias("is_rare"),
    )


def class_summary(labels: DataFrame, known: list[int], nodata: int = 0) -> DataFrame:
    """One row: totals, nodata percent, classes present and missing, imbalance (null without a valid class)."""
    valid = F.col("class") != nodata
    one = class_counts(labels).agg(
        F.sum("pixels").alias("total_pixels"), F.coalesce(F.sum(F.when(~valid, F.col("pixels"))), F.lit(0)).alias("nodata_pixels"), F.count_if(valid).alias("n_classes_present"),
        F.max(F.when(valid, F.col("pixels"))).alias("most"), F.min(F.when(valid, F.col("pixels"))).alias("least"), F.collect_set("class").alias("present"),
    )
    missing = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in known]), "present"))
    return one.select("total_pixels", F.bround(F.lit(100.0) * F.col("nodata_pixels") / F.col("total_pixels"), 3).alias("nodata_pct"), "n_classes_present",
                      F.array_join(missing.cast("array<string>"), ",").alias("missing_classes"), F.bround(F.col("most") / F.col("least"), 2).alias("imbalance_ratio"))


def patch_class_counts(labels: DataFrame, patch: int) -> DataFrame:
    """(patch_row, patch_col, class, n): counts by patch and class, without zeros."""
    return labels.groupBy(pixel.block(F.col("row"), patch).alias("patch_row"), pixel.block(F.col("col"), patch).alias("patch_col"), "class").agg(F.count("*").alias("n"))


def mosaic(tiles: DataFrame, nodata: int = 0) -> DataFrame:
    """(row, col, class): the first tile in order that has data there, else nodata. One partial aggregate."""
    first = F.min_by("class", F.when(F.col("class") != nodata, F.col("tile_order")))
    return tiles.groupBy("row", "col").agg(F.coalesce(first, F.lit(nodata)).alias("class"))


def overlaid(a: DataFrame, b: DataFrame, nodata: int = 0) -> DataFrame:
    """(row, col, class): a where it has data, else b."""
    joined = a.withColumnRenamed("class", "class_a").join(b.withColumnRenamed("class", "class_b"), ["row", "col"], "full_outer")
    return joined.select("row", "col", F.coalesce(F.nullif("class_a", F.lit(nodata)), F.nullif("class_b", F.lit(nodata)), F.lit(nodata)).alias("class"))


def confusion(a: DataFrame, b: DataFrame) -> DataFrame:
    """(class_a, class_b, n) over pixels that both have."""
    joined = a.select("row", "col", F.col("class").alias("class_a")).join(b.select("row", "col", F.col("class").alias("class_b")), ["row", "col"])
    return joined.groupBy("class_a", "class_b").agg(F.count("*").alias("n"))


def disagreement(counts: DataFrame) -> DataFrame:
    """Percent of pixels whose classes differ, from a confusion table."""
    return counts.agg((F.lit(100.0) * F.sum(F.when(F.col("class_a") != F.col("class_b"), F.col("n")).otherwise(0)) / F.sum("n")).alias("disagreement_pct"))
