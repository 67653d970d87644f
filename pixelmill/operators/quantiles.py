"""Exact percentiles of groups of any size.

Spark's ``percentile`` holds every distinct value of a group in one task. Here order statistics are found by refinement:
a histogram over each group's range says which bin holds a wanted rank, a second one over that bin's own range narrows it
down, and only the values of the last bins are sorted. A round is left out where the ranges hold few enough values to be
sorted at once. Every pass over the values is a partial aggregate of at most BINS rows per range and task; the ranges, two
per group and fraction at most, are joined to the values by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Bins of a histogram, and how often bins are refined before values are sorted.
BINS, ROUNDS = 2048, 2
#: Values in all ranges together that are sorted without another histogram.
SORTED = 1 << 20
#: Groups, at most: it bounds what is broadcast.
GROUPS = 1 << 14


def _ranges(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))


def _bin(bins: int) -> Column:
    """The bin of a value in its range: never falls as the value rises, whatever the rounding."""
    width = F.col("hi") - F.col("lo")
    return F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("lo")) / width * bins))).otherwise(F.lit(0)).cast("int")


def percentiles(values: DataFrame, keys: list[str], value: str, fractions: dict[str, float], bins: int = BINS, rounds: int = ROUNDS) -> DataFrame:
    """(keys, one column per fraction): percentiles with linear interpolation, by group; nulls are skipped.

    A group without a value has no row; more than GROUPS groups are an error. ``values`` is read ``rounds`` + 2 times at
    most, so it should be a table or cheap. The ranges of a round are counted and held by the driver before the next one
    starts.
    """
    rows = values.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    groups = _ranges(rows, keys)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in fractions.items()])
    ranks = groups.select(*keys, "lo", "hi", "n", F.lit(0).cast("long").alias("below"), F.explode(wanted).alias("w"), ((F.col("n") - 1) * F.col("w.p")).alias("at"))
    both = F.array(F.floor("at"), F.ceil("at"))
    ranks = ranks.select(*keys, F.col("w.name").alias("name"), "at", "lo", "hi", "n", "below", F.explode(F.array_distinct(both)).alias("rank"))
    order = Window.partitionBy(*keys, "lo", "hi")
    last, left = False, rounds
    while not last:
        held = collected(ranks, 2 * len(fractions) * GROUPS)
        ranks = values.sparkSession.createDataFrame([tuple(r) for r in held], ranks.schema)
        last = not left or sum({tuple(r[c] for c in (*keys, "lo", "hi")): r.n for r in held}.values()) <= SORTED
        left -= 1
        limits = F.broadcast(ranks.select(*keys, "lo", "hi", "below").distinct())
        inside = rows.join(limits, keys) if keys else rows.crossJoin(limits)
        inside = inside.where("_v between lo and hi")
        cell = F.col("_v") if last else _bin(bins)
        counted = inside.select(*keys, "lo", "hi", "below", cell.alias("cell"), "_v").groupBy(*keys, "lo", "hi", "below", "cell").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        through = F.sum("n").over(order.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
        cells = counted.withColumn("through", through).select(*keys, "lo", "hi", "low", "high", "n", (F.col("through") - F.col("n")).alias("from"), "through")
        met = ranks.drop("below", "n").join(cells, [*keys, "lo", "hi"]).where("rank >= `from` and rank < through")
        ranks = met.select(*keys, "name", "at", "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), "n", F.col("from").alias("below"))
    # in the last round a cell is a value: lo = hi
    share = F.col("at") - F.floor("at")
    low, high = F.min("lo"), F.max("lo")
    found = ranks.groupBy(*keys, "name").agg((low + (high - low) * F.max(share)).alias("v"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in fractions])


def collected(table: DataFrame, most: int) -> list[Row]:
    """The rows of a small table; an error if it has more than ``most``."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows to broadcast")
    return rows


def checked(stats: DataFrame, most: int = GROUPS) -> DataFrame:
    """A small table fit for broadcast: computed once, held by the driver; an error if it has more than ``most`` rows."""
    return F.broadcast(stats.sparkSession.createDataFrame([tuple(r) for r in collected(stats, most)], stats.schema))
