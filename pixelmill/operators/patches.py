"""Patches of pixels: extraction, filtering, numbering, statistics, normalisation, tensors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.functions import pixel
from pixelmill.operators import quantiles

PLACES = 6


def in_patches(pixels: DataFrame, specs: DataFrame, patch: int) -> DataFrame:
    """Pixels of the kept patches, with patch_row, patch_col and set_name. Specs are a row per patch; Spark picks the join."""
    placed = pixels.withColumns({"patch_row": pixel.block(F.col("row"), patch), "patch_col": pixel.block(F.col("col"), patch)})
    return placed.join(specs.select(F.col("row").alias("patch_row"), F.col("col").alias("patch_col"), "set_name"), ["patch_row", "patch_col"])


def missing_fraction(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """(set_name, patch_row, patch_col, nan_fraction) over all channels and pixels."""
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in channels), F.lit(0))
    return pixels.groupBy("set_name", "patch_row", "patch_col").agg((F.sum(missing) / (F.count("*") * len(channels))).alias("nan_fraction"))


def kept_patches(fractions: DataFrame, most: float) -> DataFrame:
    """Patches that don't miss more than ``most``."""
    return fractions.where(F.col("nan_fraction") <= most)


def numbered(patches: DataFrame, per_block: int) -> DataFrame:
    """``patches`` with ``number``, from 0 by set, in the order of blocks, then of patches.

    Blocks are counted, and where each begins follows from sums over rows of blocks, then over the blocks of a row; so no
    task sorts a whole set, only a row's blocks or a block's patches.
    """
    placed = patches.withColumns({"_r": pixel.block(F.col("patch_row"), per_block), "_c": pixel.block(F.col("patch_col"), per_block)})
    counts = placed.groupBy("set_name", "_r", "_c").agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = counts.groupBy("set_name", "_r").agg(F.sum("n").alias("n")).select("set_name", "_r", before(Window.partitionBy("set_name").orderBy("_r")).alias("line"))
    blocks = counts.select("set_name", "_r", "_c", before(Window.partitionBy("set_name", "_r").orderBy("_c")).alias("block")).join(lines, ["set_name", "_r"])
    own = F.row_number().over(Window.partitionBy("set_name", "_r", "_c").orderBy("patch_row", "patch_col")) - 1
    return placed.withColumn("_k", own).join(blocks, ["set_name", "_r", "_c"]).withColumn("number", (F.col("line") + F.col("block") + F.col("_k")).cast("int")).select(*patches.columns, "number")


def split_class_counts(pixels: DataFrame, ignore: int = pixel.IGNORE) -> DataFrame:
    """(set_name, idx, n) of the labels that aren't ignored."""
    return pixels.where(F.col("idx") != ignore).groupBy("set_name", "idx").agg(F.count("*").alias("n"))


def sampled(pixels: DataFrame, percent: int) -> DataFrame:
    """About ``percent`` of the pixels, chosen by their place, so all channels of a pixel go together."""
    return pixels.where((F.col("row") * 7919 + F.col("col") * 104729) % 100 < percent)


def channel_stats(values: DataFrame, low: float = 0.01, high: float = 0.99, places: int | None = PLACES) -> DataFrame:
    """(channel, low, high, median, mean, std) of (channel, value): exact percentiles, population deviation, nulls skipped.

    A channel of any size: see :mod:`pixelmill.operators.quantiles`. A channel without a value has a row of nulls.
    """
    fix = (lambda c: F.round(c, places)) if places is not None else (lambda c: F.col(c))
    moments = values.groupBy("channel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    found = quantiles.percentiles(values, ["channel"], "value", {"low": low, "high": high, "median": 0.5})
    return moments.join(found, "channel", "left").select("channel", *[fix(c).alias(c) for c in ("low", "high", "median", "mean", "std")])


def normalised(values: DataFrame, stats: DataFrame) -> DataFrame:
    """``values`` with ``norm``; stats are a row per channel, computed once, counted and broadcast: values don't move."""
    joined = values.join(quantiles.checked(stats.select("channel", "low", "high", "median")), "channel")
    return joined.withColumn("norm", pixel.normalised(F.col("value"), F.col("low"), F.col("high"), F.col("median"))).drop("low", "high", "median")


def augmentation(patch_id: Column, seed: int = 0) -> dict[str, Column]:
    """Flips and quarter turns drawn from a hash of the patch: flip_w, flip_h (even odds), turns (0 to 3)."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), patch_id).cast("binary")), 1, 4), 16, 10).cast("int")
    return {"flip_w": draw % 2 == 1, "flip_h": F.floor(draw / 2) % 2 == 1, "turns": (F.floor(draw / 4) % 4).cast("int")}


def augmented(pixels: DataFrame, size: int, patch_id: str = "patch_id", seed: int = 0) -> DataFrame:
    """Pixels (patch_id, row, col within the patch) at their augmented places; labels and features move together."""
    drawn = pixels.withColumns(augmentation(F.col(patch_id), seed))
    row, col = pixel.mirrored(F.col("row"), F.col("col"), size, size, F.col("flip_w"), F.col("flip_h"), F.col("turns"))
    return drawn.withColumns({"row": row, "col": col}).drop("flip_w", "flip_h", "turns")


def tensors(pixels: DataFrame, channels: list[str], size: int, kind: str = "float") -> DataFrame:
    """(set_name, number, features array<array<float>>, labels array<int>): channels first, pixels by row and column.

    A patch is of fixed size, so a group is bounded by size * size rows.
    """
    value = F.struct(F.col("row"), F.col("col"), *[F.col(c).cast(kind).alias(c) for c in channels], F.col("idx"))
    flat = pixels.groupBy("set_name", "number").agg(F.array_sort(F.collect_list(value)).alias("p"))
    return flat.select("set_name", "number", F.array(*[F.col(f"p.{c}") for c in channels]).alias("features"), F.col("p.idx").alias("labels"))


def predicted(patches: DataFrame, model: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> DataFrame:
    """``model`` over batches of [n, channels, h, w] features; its [n, h, w] classes come back as arrays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack([np.stack([np.asarray(c, np.float32) for c in f]) for f in frame.features]).reshape(len(frame), -1, *shape)
                yield pd.DataFrame({"set_name": frame.set_name, "number": frame.number, "classes": list(model(x).reshape(len(frame), -1))})

    return patches.select("set_name", "number", "features").mapInPandas(run, "set_name string, number int, classes array<int>")
