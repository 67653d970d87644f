"""Readers: scene catalogues, vector grids, pixel tables, patch files, normalisation statistics."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan

from pixelmill.functions import pixel
from pixelmill.sources.scratch import file_system, listed

ITEM = "id string, datetime timestamp_ntz, bbox array<double>, properties struct<`eo:cloud_cover`: double, `grid:code`: string>, assets map<string, struct<href: string>>"


def stac_items(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue items, one JSON object a line, as (id, datetime, cloud_cover, grid_code, box, assets)."""
    raw = spark.read.schema(ITEM).json(path)
    box = [F.get("bbox", k).alias(n) for k, n in enumerate(("west", "south", "east", "north"))]
    return raw.select("id", "datetime", F.col("properties.`eo:cloud_cover`").alias("cloud_cover"), F.col("properties.`grid:code`").alias("grid_code"), *box, F.transform_values("assets", lambda _, v: v["href"]).alias("assets"))


def vector_grid(spark: SparkSession, path: str) -> DataFrame:
    """(ll_tile, epsg, rings, west, south, east, north) of a GeoJSON file of polygons; rings holds all rings of all parts.

    A file whose reference system is null is an error; one that names none is in degrees (4326), as the format has it.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))  # one row: a grid is a small file
    system = F.get_json_object("v", "$.crs.properties.name")
    code = F.regexp_extract(system, "([0-9]+)$", 1)
    epsg = F.when(F.col("v").rlike('"crs"\\s*:\\s*null'), F.raise_error(F.lit("the grid has no reference system")).cast("int")).when(system.isNull() | system.endswith("CRS84"), 4326).otherwise(code.cast("int"))
    feature = "array<struct<properties: struct<ll_tile: string>, geometry: struct<type: string, coordinates: string>>>"
    f = text.select(epsg.alias("epsg"), F.explode(F.from_json("v", f"features {feature}")["features"]).alias("f"))
    ring = "array<array<array<double>>>"
    body = F.col("f.geometry.coordinates")
    parts = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(F.from_json(body, f"array<{ring}>"))).otherwise(F.from_json(body, ring))
    rows = f.select(F.col("f.properties.ll_tile").alias("ll_tile"), "epsg", parts.alias("rings"))
    xs, ys = F.transform(F.flatten("rings"), lambda p: p[0]), F.transform(F.flatten("rings"), lambda p: p[1])
    return rows.select("*", F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def pixels(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, columns: list[str] | None = None, tile: int | None = None) -> DataFrame:
    """A pixel table, within (row, col, height, width) if given.

    With ``tile`` the table is laid out by block_row and block_col, and the window prunes these partitions too.
    """
    df = spark.read.parquet(path)
    if window:
        row, col, height, width = window
        df = df.where(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))
        if tile:
            df = df.where(F.col("block_row").between(row // tile, (row + height - 1) // tile) & F.col("block_col").between(col // tile, (col + width - 1) // tile))
    return df.select(*columns) if columns else df


def season_stack(spark: SparkSession, path: str) -> DataFrame:
    """Composites laid out as season=DJF and so on; other folders are ignored."""
    return spark.read.parquet(path).where(F.col("season").isin(*pixel.SEASONS))


def npy_patches(spark: SparkSession, path: str) -> DataFrame:
    """(name, features array<float>, shape array<int>, labels array<int>) of pairs of .npy files; an error if a label is missing.

    Labels without features are ignored.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    key = F.regexp_replace(F.col("path"), "_(feature|label)\\.npy$", "")
    side = lambda kind: files.where(F.col("path").endswith(f"_{kind}.npy")).select(key.alias("name"), F.col("content").alias(kind))
    missing = F.raise_error(F.concat(F.lit("no labels for "), F.col("name")))
    pairs = side("feature").join(side("label"), "name", "left").withColumn("label", F.coalesce("label", missing.cast("binary")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = [np.load(io.BytesIO(b)) for b in frame.feature]
            y = [np.load(io.BytesIO(b)) for b in frame.label]
            yield pd.DataFrame({"name": frame.name, "features": [a.astype(np.float32).ravel() for a in x], "shape": [list(a.shape) for a in x], "labels": [a.astype(np.int32).ravel() for a in y]})

    return pairs.mapInPandas(run, "name string, features array<float>, shape array<int>, labels array<int>").orderBy("name")


def normalisation(spark: SparkSession, text: str) -> DataFrame:
    """(channel, low, high, median) of normalisation statistics in JSON, flat or under 'normalization'."""
    raw = json.loads(text)
    stats = raw.get("normalization", raw)
    low, high, median = (stats[k] for k in ("low", "high", "median"))
    if not len(low) == len(high) == len(median):
        raise ValueError("low, high and median differ in length")
    if any(a > b for a, b in zip(low, high, strict=True)):
        raise ValueError("a low is above its high")
    rows = [(k, float(a), float(b), float(m)) for k, (a, b, m) in enumerate(zip(low, high, median, strict=True))]
    return spark.createDataFrame(rows, "channel int, low double, high double, median double")


class StacSource(DataSource):
    """A catalogue as a data source: ``spark.read.format("stac").load(file)``; the search is pushed down to the reader.

    Here the catalogue is JSON lines in a file or a folder of them; a subclass of the reader can ask a service with the same predicates.
    """

    @classmethod
    def name(cls) -> str:
        return "stac"

    def schema(self) -> str:
        return "id string, datetime string, cloud_cover double, grid_code string"

    def reader(self, schema) -> DataSourceReader:
        return StacReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets it push filters down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StacSource)


class StacReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, LessThan, GreaterThanOrEqual)) and f.attribute[0] in ("cloud_cover", "grid_code", "datetime"):
                self.wanted.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """A partition per file: ``path`` is a file, or a folder of files, in any file system that Arrow knows."""
        return [InputPartition(f) for f in listed(self.path)] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        tests = {"EqualTo": lambda a, b: a == b, "LessThan": lambda a, b: a < b, "GreaterThanOrEqual": lambda a, b: a >= b}
        path = partition.value
        if not path:
            return
        fs, name = file_system(path)
        with fs.open_input_stream(name) as raw:
            for line in io.TextIOWrapper(raw, encoding="utf-8"):
                if not line.strip():
                    continue
                item = json.loads(line)
                row = {"id": item["id"], "datetime": item.get("datetime"), "cloud_cover": item["properties"].get("eo:cloud_cover"), "grid_code": item["properties"].get("grid:code")}
                if all(row[c] is not None and tests[t](row[c], v) for c, t, v in self.wanted):
                    yield tuple(row.values())
