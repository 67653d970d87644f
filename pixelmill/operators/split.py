"""Train, validation and test patches with a spatial buffer, and the search for a seed."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETS = ("train", "val", "test")


def set_sizes(n: int, val: float = 0.15, test: float = 0.15) -> tuple[int, int, int]:
    """Blocks of train, validation and test; the latter two are rounded up."""
    v, t = math.ceil(n * val), math.ceil(n * test)
    if n - v - t < 0:
        raise ValueError(f"{n} blocks are too few")
    return n - v - t, v, t


def assigned_by_hash(spark: SparkSession, grid: int, seeds: int, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """(seed, block_row, block_col, set_id): blocks in the order of md5('seed:block'), test first, then validation."""
    _, v, t = set_sizes(grid * grid, val, test)
    cells = spark.range(seeds).select(F.col("id").cast("int").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1))).alias("block"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.md5(F.concat_ws(":", "seed", "block").cast("binary"))))
    set_id = F.when(place <= t, 2).when(place <= t + v, 1).otherwise(0)
    return cells.select("seed", F.floor(F.col("block") / grid).cast("int").alias("block_row"), (F.col("block") % grid).cast("int").alias("block_col"), set_id.alias("set_id"))


def assigned_by_rng(spark: SparkSession, grid: int, seeds: list[int], val: float = 0.15, test: float = 0.15) -> DataFrame:
    """The same from numpy's default generator: an array of test, validation and train ids, shuffled by seed."""
    train, v, t = set_sizes(grid * grid, val, test)
    rows = []
    for seed in seeds:
        ids = np.repeat(np.array([2, 1, 0], np.uint8), (t, v, train))
        np.random.default_rng(seed).shuffle(ids)
        rows += [(seed, k // grid, k % grid, int(s)) for k, s in enumerate(ids)]
    return spark.createDataFrame(rows, "seed int, block_row int, block_col int, set_id int")


def expanded(blocks: DataFrame, per_block: int) -> DataFrame:
    """(seed, row, col, set_id) of patches: each block has per_block x per_block."""
    step = F.sequence(F.lit(0), F.lit(per_block - 1))
    rows = blocks.select("seed", "block_row", "block_col", "set_id", F.explode(step).alias("i"))
    both = rows.select("*", F.explode(step).alias("j"))
    return both.select("seed", (F.col("block_row") * per_block + F.col("i")).alias("row"), (F.col("block_col") * per_block + F.col("j")).alias("col"), "set_id")


def buffered(patches: DataFrame, radius: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """``patches`` with ``keep``: whether all patches within the radius, diagonals included, are of the same set.

    Each patch is sent to the cells that see it, so it is one equi-aggregate; cells beyond the grid see nothing, which
    equals padding by the edge. With ``shape``, the grid's rows and columns, a radius beyond either is an error.
    """
    if shape is not None and radius > min(shape):
        raise ValueError(f"a radius of {radius} exceeds the grid of {shape[0]} x {shape[1]} patches")
    if radius < 1:
        return patches.withColumn("keep", F.lit(True))
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    seen = patches.select("seed", F.col("row").alias("r"), F.col("col").alias("c"), "set_id", F.explode(offsets).alias("dr")).select("*", F.explode(offsets).alias("dc"))
    own = (F.col("dr") == 0) & (F.col("dc") == 0)
    cells = seen.groupBy("seed", (F.col("r") + F.col("dr")).alias("row"), (F.col("c") + F.col("dc")).alias("col"))
    found = cells.agg(F.max(F.when(own, F.col("set_id"))).alias("set_id"), F.min("set_id").alias("low"), F.max("set_id").alias("high"))
    return found.where("set_id is not null").select("seed", "row", "col", "set_id", (F.col("low") == F.col("high")).alias("keep"))


def seed_scores(kept: DataFrame, counts: DataFrame) -> DataFrame:
    """(seed, n_train, n_val, n_test, score, covers): kept patches by set; whether every set has every class.

    ``counts`` is (patch_row, patch_col, class, n) and has no row of n = 0.
    """
    keep = kept.where("keep")
    sizes = kept.groupBy("seed").agg(*[F.count_if(F.col("keep") & (F.col("set_id") == k)).alias(f"n_{s}") for k, s in enumerate(SETS)])
    cells = counts.select(F.col("patch_row").alias("row"), F.col("patch_col").alias("col"), "class")
    pairs = keep.join(cells, ["row", "col"]).groupBy("seed").agg(F.count_distinct("set_id", "class").alias("pairs"))
    present = counts.agg(F.count_distinct("class").alias("present"))  # one row
    scored = sizes.join(pairs, "seed", "left").crossJoin(F.broadcast(present))
    return scored.select("seed", *[f"n_{s}" for s in SETS], F.least(*[f"n_{s}" for s in SETS]).alias("score"), (F.coalesce("pairs", F.lit(0)) == 3 * F.col("present")).alias("covers"))


def best_seed(scores: DataFrame) -> DataFrame:
    """The covering seed of the highest score, the lowest of equals; no row if none covers."""
    return scores.where("covers").orderBy(F.desc("score"), "seed").limit(1)


def selected_seed(scores: DataFrame) -> int:
    """The best seed, or an error."""
    row = best_seed(scores).first()
    if row is None:
        raise ValueError("no seed has every class in every set")
    return row.seed


def specs(kept: DataFrame, seed: int) -> DataFrame:
    """(row, col, set_name) of one seed's kept patches."""
    name = F.element_at(F.array(*map(F.lit, SETS)), F.col("set_id") + 1)
    return kept.where((F.col("seed") == seed) & F.col("keep")).select("row", "col", name.alias("set_name"))
