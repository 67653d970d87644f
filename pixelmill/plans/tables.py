"""The raster tables, derived from the driver's tables by integer arithmetic, in Spark and in DuckDB SQL.

The grid has 80 x 80 pixels, patches of 4, blocks of 16: 5 x 5 blocks of 4 x 4 patches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import pixel

SIDE, PATCH, BLOCK = 80, 4, 16
#: Multipliers of (part, supplier, order) keys by band.
_MIX = {
    "blue": (43, 7, 13), "green": (19, 23, 3), "red": (31, 17, 7), "red_edge1": (11, 37, 17), "red_edge2": (23, 41, 19), "red_edge3": (29, 3, 31),
    "nir": (13, 29, 11), "narrow_nir": (7, 19, 43), "swir1": (37, 5, 41), "swir2": (17, 13, 37),
}
CODES = (0, 10, 20, 30, 40, 50)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number(band: str) -> str:
    a, b, c = _MIX[band]
    return f"cast((l_partkey * {a} + l_suppkey * {b} + l_orderkey * {c}) % 10001 as int) as {band}"


_SCL = "cast(case when (l_partkey + l_linenumber) % 24 < 12 then (l_partkey + l_linenumber) % 24 else 4 + ((l_partkey + l_linenumber) % 24) % 3 end as int) as scl"
_SEASON = "case when month({0}) in (12, 1, 2) then 'DJF' when month({0}) in (3, 4, 5) then 'MAM' when month({0}) in (6, 7, 8) then 'JJA' else 'SON' end"


def raw_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(season, scene_id, row, col, bands, scl)."""
    items = table(spark, sf_dir, "lineitem")
    keys = [pixel.season_of(F.month("l_shipdate")).alias("season"), F.year("l_shipdate").cast("string").alias("scene_id"), (F.col("l_orderkey") % SIDE).cast("int").alias("row"), (F.col("l_partkey") % SIDE).cast("int").alias("col")]
    return items.select(*keys, *[F.expr(_number(b)) for b in pixel.BANDS], F.expr(_SCL))


def label_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, class): classes 0 to 5."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy((F.col("l_orderkey") % SIDE).cast("int").alias("row"), (F.col("l_partkey") % SIDE).cast("int").alias("col")).agg((F.min(F.col("l_partkey") * 7 + F.col("l_orderkey")) % 6).cast("int").alias("class"))


def second_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another label raster on the same grid, with gaps."""
    items = table(spark, sf_dir, "lineitem").where("l_linenumber > 2")
    return items.groupBy((F.col("l_orderkey") % SIDE).cast("int").alias("row"), (F.col("l_partkey") % SIDE).cast("int").alias("col")).agg((F.max(F.col("l_partkey") + F.col("l_orderkey")) % 6).cast("int").alias("class"))


def stac_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, datetime, cloud_cover, grid_code, candidate)."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("datetime"), (F.col("o_totalprice") / 5000).alias("cloud_cover"), F.concat(F.lit("MGRS-"), "o_orderpriority").alias("grid_code"), (F.col("o_custkey") % 3).cast("int").alias("candidate"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ll_tile, west, south, east, north): tiles of three degrees."""
    n = table(spark, sf_dir, "nation")
    west, south = F.lit(-9.0) + 3 * (F.col("n_nationkey") % 5), F.lit(33.0) + 3 * F.floor(F.col("n_nationkey") / 5)
    return n.select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("ll_tile"), west.alias("west"), south.alias("south"), (west + 3).alias("east"), (south + 3).alias("north"))


def vector_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, channel, value) of the embeddings."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("channel", "value"))
    return e.select("vec_id", "channel", F.col("value").cast("double").alias("value"))


# --- the same in DuckDB SQL, as common table expressions

RAW_SQL = f"""raw as (select {_SEASON.format('l_shipdate')} as season, cast(year(l_shipdate) as varchar) as scene_id, cast(l_orderkey % {SIDE} as int) as "row", cast(l_partkey % {SIDE} as int) as col, {', '.join(_number(b) for b in pixel.BANDS)}, {_SCL} from lineitem)"""
_HIDE = "(" + ", ".join(map(str, pixel.HIDDEN_CLASSES)) + ")"


def _reflectance(b: str) -> str:
    return f"case when scl in {_HIDE} or {b} = 0 then null else greatest({b} * cast(0.0001 as double) + cast(-0.1 as double), 0.0::double) end as {b}"


MASKED_SQL = f"""{RAW_SQL},
bands as (select season, scene_id, "row", col, {', '.join(_reflectance(b) for b in pixel.BANDS)} from raw),
masked as (select *, (nir - red) / nullif(nir + red, 0) as ndvi, (swir1 - nir) / nullif(swir1 + nir, 0) as ndbi, (green - nir) / nullif(green + nir, 0) as ndwi from bands)"""
COMPOSITE_SQL = f"""{MASKED_SQL},
composite as (select season, "row", col, {', '.join(f'median({c}) as {c}' for c in pixel.CHANNELS)} from masked group by all)"""
LABEL_SQL = f"""labels_r as (select cast(l_orderkey % {SIDE} as int) as "row", cast(l_partkey % {SIDE} as int) as col, cast(min(l_partkey * 7 + l_orderkey) % 6 as int) as "class" from lineitem group by 1, 2)"""
SECOND_SQL = f"""labels_s as (select cast(l_orderkey % {SIDE} as int) as "row", cast(l_partkey % {SIDE} as int) as col, cast(max(l_partkey + l_orderkey) % 6 as int) as "class" from lineitem where l_linenumber > 2 group by 1, 2)"""
ITEMS_SQL = """items as (select o_orderkey as id, o_orderdate as datetime, o_totalprice / 5000 as cloud_cover, 'MGRS-' || o_orderpriority as grid_code, cast(o_custkey % 3 as int) as candidate from orders)"""
GRID_SQL = """grid as (select 'T' || cast(n_nationkey as varchar) as ll_tile, -9.0::double + 3 * (n_nationkey % 5) as west, 33.0::double + 3 * (n_nationkey // 5) as south, -9.0::double + 3 * (n_nationkey % 5) + 3 as east, 33.0::double + 3 * (n_nationkey // 5) + 3 as north from nation)"""
VALUES_SQL = """vals as (select vec_id, unnest(range(0, len(embedding))) as channel, unnest(embedding)::double as value from embeddings)"""
SEASON_SQL = _SEASON
