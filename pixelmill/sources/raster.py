"""GeoTIFF scenes as a Spark data source, and their writers: tiles are read and packed by tasks."""

from __future__ import annotations

import io
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from pixelmill.functions import pixel
from pixelmill.sources import tiff
from pixelmill.sources.scratch import Scratch, file_system, listed

T = TypeVar("T")
Window = tuple[int, int, int, int]
#: Pixels a side of a partition.
TILE = 512
_KINDS = {"uint8": "int", "int8": "int", "uint16": "int", "int16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "uint64": "bigint", "float32": "float", "float64": "double"}


class RangeFile(io.RawIOBase):
    """A remote file read by ranges: what is read costs a request, what is skipped nothing."""

    def __init__(self, url: str, ask: Callable[[urllib.request.Request], bytes] | None = None):
        self.url, self.at = url, 0
        self.ask = ask or self._ask

    @staticmethod
    def _ask(request: urllib.request.Request) -> bytes:
        with urllib.request.urlopen(request, timeout=60) as answer:
            if answer.status != 206:
                raise OSError(f"{request.full_url} doesn't serve ranges")
            return answer.read()

    def seek(self, offset: int, whence: int = 0) -> int:
        if whence:
            raise OSError("only absolute seeks")
        self.at = offset
        return offset

    def read(self, size: int = -1) -> bytes:
        if size == 0:
            return b""
        last = "" if size < 0 else str(self.at + size - 1)
        out = self.ask(urllib.request.Request(self.url, headers={"Range": f"bytes={self.at}-{last}"}))
        self.at += len(out)
        return out


def opened(path: str):
    """A file to read at any place, by any address that pyarrow or a web server knows."""
    if path.startswith(("http://", "https://")):
        return RangeFile(path)
    fs, name = file_system(path)
    return fs.open_input_file(name)


def retried(run: Callable[[], T], attempts: int = 5, least: float = 2, most: float = 60, sleep: Callable[[float], None] = time.sleep) -> T:
    """What ``run`` returns; after an error of input or output it is tried again, each time after twice the wait."""
    for k in range(attempts):
        try:
            return run()
        except OSError:
            if k + 1 == attempts:
                raise
            sleep(min(most, max(least, 2.0**k)))
    raise AssertionError("unreachable")


def header(path: str, **waits) -> tuple[tiff.Profile, tiff.Layout]:
    """Profile and layout of a raster; reads the header only."""

    def run() -> tuple[tiff.Profile, tiff.Layout]:
        with opened(path) as file:
            return tiff.read_header(file)

    return retried(run, **waits)


def read_scene(path: str, window: Window | None = None, factor: float = 1.0, method: str = "nearest", bands: Iterable[int] | None = None, part: Window | None = None, **waits) -> np.ndarray:
    """[bands, int(h * factor), int(w * factor)] of a window (row, col, height, width), the whole raster by default.

    ``part`` reads that much of the result only.
    """

    def run() -> np.ndarray:
        with opened(path) as file:
            profile, layout = tiff.read_header(file)
            read = lambda w: tiff.read_window(file, profile, layout, w, bands)
            whole = window or (0, 0, profile.height, profile.width)
            if factor == 1 and part is None:
                return read(whole)
            return tiff.resized(read, whole, factor, method, part)

    return retried(run, **({"most": 10} | waits))


def columns(profile: tiff.Profile) -> list[str]:
    return [n or f"band_{k + 1}" for k, n in enumerate(profile.names or [""] * profile.bands)]


@dataclass
class Piece(InputPartition):
    path: str
    part: Window


class GeoTiffSource(DataSource):
    """``spark.read.format("geotiff").load(path)``: (file, row, col, a column per band); missing values are null.

    ``path`` is a file, also one on a web server, or a folder of files with the bands of the first. Options: ``window``
    (row,col,height,width), ``factor`` and ``method`` (nearest or bilinear) to resample it, ``tile`` (pixels a side of a
    partition). Rows and columns count from the window's corner where one is given. Bounds on row and col are pushed down:
    parts outside are not read.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        profile, _ = header(_files(self.options["path"])[0])
        return "file string, row int, col int, " + ", ".join(f"`{c}` {_KINDS[profile.dtype]}" for c in columns(profile))

    def reader(self, schema) -> DataSourceReader:
        return GeoTiffReader(dict(self.options), schema)


def _files(path: str) -> list[str]:
    if path.startswith(("http://", "https://")):
        return [path]
    found = listed(path, (".tif", ".tiff"))
    if not found:
        raise FileNotFoundError(f"no rasters in {path}")
    return found


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema):
        self.path, self.names = options["path"], schema.fieldNames()[3:]
        self.kinds = [f.dataType.simpleString() for f in schema.fields[3:]]
        self.window = tuple(int(x) for x in options["window"].split(",")) if options.get("window") else None
        self.factor, self.method, self.tile = float(options.get("factor", 1)), options.get("method", "nearest"), int(options.get("tile", TILE))
        self.low, self.high = {"row": 0, "col": 0}, {"row": 1 << 31, "col": 1 << 31}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if name in self.low:
                value = int(f.value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], value + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in _files(self.path):
            profile, _ = header(path)
            if len(columns(profile)) != len(self.names):
                raise ValueError(f"{path} has {profile.bands} bands, where the first file has {len(self.names)}")
            _, _, h, w = self.window or (0, 0, profile.height, profile.width)
            h, w = min(int(h * self.factor), self.high["row"]), min(int(w * self.factor), self.high["col"])
            for r in range(self.low["row"], h, self.tile):
                for c in range(self.low["col"], w, self.tile):
                    out.append(Piece(path, (r, c, min(self.tile, h - r), min(self.tile, w - c))))
        return out or [Piece("", (0, 0, 0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        r, c, h, w = partition.part
        if not h or not w:
            return
        profile, _ = header(partition.path)
        values = read_scene(partition.path, self.window, self.factor, self.method, None, partition.part)
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
        arrays = [pa.array(np.repeat(np.arange(r, r + h, dtype=np.int32), w)), pa.array(np.tile(np.arange(c, c + w, dtype=np.int32), h))]
        for band, kind in zip(values, self.kinds, strict=True):
            flat = np.ascontiguousarray(band).ravel()
            missing = np.isnan(flat) if flat.dtype.kind == "f" else np.zeros(len(flat), bool)
            if profile.nodata is not None and not np.isnan(profile.nodata):
                missing |= flat == profile.nodata
            arrays.append(pa.array(flat, mask=missing).cast(kinds[kind]))
        name = partition.path.rpartition("/")[2]
        yield pa.RecordBatch.from_arrays([pa.array([name] * (h * w)), *arrays], names=["file", "row", "col", *self.names])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets it push bounds down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)


# --- writing

_PACKED = "band int, i int, j int, data binary"


def _assembled(spark: SparkSession, tiles: DataFrame, path: str, profile: tiff.Profile) -> None:
    """One file of packed tiles: their sizes come to the driver, their bytes pass through it one by one. Whole or absent."""
    scratch = Scratch(spark, "raster")
    held = scratch.write(tiles, "tiles")
    down, across = profile.grid
    place = (F.col("band") * down + F.col("i")) * across + F.col("j")
    sizes = {r.place: r.size for r in held.select(place.alias("place"), F.octet_length("data").alias("size")).collect()}  # a row per tile
    fill = 0 if profile.nodata is None else profile.nodata
    empty = tiff.packed(np.full((1, 1), fill, profile.dtype), profile.tile, fill)
    order = range(profile.bands * down * across)
    rows = ((r.place, bytes(r.data)) for r in held.select(place.alias("place"), "data").orderBy("place").toLocalIterator())

    def chunks() -> Iterator[bytes]:
        for k in order:
            if k in sizes:
                at, data = next(rows)
                if at != k:
                    raise ValueError("a tile is there twice")
                yield data
            else:
                yield empty

    fs, name = file_system(path)
    folder = name.rpartition("/")[0]
    if folder:
        fs.create_dir(folder, recursive=True)
    temporary = f"{name}.tmp"
    try:
        with fs.open_output_stream(temporary) as out:
            tiff.write(out, profile, [sizes.get(k, len(empty)) for k in order], chunks())
        fs.move(temporary, name)
    except BaseException:
        if fs.get_file_info(temporary).type == pafs.FileType.File:
            fs.delete_file(temporary)
        raise
    finally:
        scratch.drop("tiles")


def write_raster(pixels: DataFrame, path: str, profile: tiff.Profile, bands: list[str] | None = None) -> None:
    """Pixels (row, col, bands) as one GeoTIFF; nulls and absent pixels are the profile's nodata (0 without one).

    A tile's pixels meet in one task, which packs them: tile x tile rows at most. Pixels beyond the raster are an error.
    """
    bands = bands or list(profile.names)
    if len(bands) != profile.bands:
        raise ValueError(f"{len(bands)} columns for {profile.bands} bands")
    th, tw = profile.tile
    fill = 0 if profile.nodata is None else profile.nodata

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["_i"].iloc[0]), int(rows["_j"].iloc[0])
        out = []
        for k in range(len(bands)):
            tile = np.full((th, tw), fill, profile.dtype)
            v = rows[f"_{k}"].to_numpy(np.float64 if profile.dtype.startswith("float") else None, na_value=fill)
            tile[rows["row"].to_numpy() - i * th, rows["col"].to_numpy() - j * tw] = v
            out.append((k, i, j, tiff.packed(tile, profile.tile, fill)))
        return pd.DataFrame(out, columns=["band", "i", "j", "data"])

    inside = F.col("row").between(0, profile.height - 1) & F.col("col").between(0, profile.width - 1)
    row = F.when(inside, F.col("row")).otherwise(F.raise_error(F.lit("a pixel lies beyond the raster")).cast("int"))
    placed = pixels.select(row.cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(bands)])
    tiles = placed.withColumns({"_i": pixel.block(F.col("row"), th), "_j": pixel.block(F.col("col"), tw)}).groupBy("_i", "_j").applyInPandas(pack, _PACKED)
    _assembled(pixels.sparkSession, tiles, path, replace(profile, names=profile.names or tuple(bands)))


def write_scene(spark: SparkSession, path: str, profile: tiff.Profile, window: Window, target: float, assets: dict[str, str], bands: dict[str, float], channels: tuple[str, ...]) -> None:
    """All bands of a scene as one GeoTIFF: ``bands`` are the assets in order with their resolutions.

    Bands of another resolution than ``target`` are resampled, scene classes (SCL) by nearest pixels, others bilinearly;
    the window is in each band's own pixels. A band whose result has not the profile's shape is an error. Tasks read and
    pack a tile each.
    """
    down, across = profile.grid
    th, tw = profile.tile
    plan = []
    for asset, resolution in bands.items():
        factor = resolution / target
        tiff.check_shape(profile, np.broadcast_to(np.zeros(1), (int(window[2] * factor), int(window[3] * factor))))
        plan.append((assets[asset], factor, "nearest" if "SCL" in asset else "bilinear"))
    final = replace(profile, bands=len(plan), names=tuple(channels))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n in frame["id"].tolist():
                band, i, j = n // (down * across), n // across % down, n % across
                href, factor, method = plan[band]
                part = (i * th, j * tw, min(th, final.height - i * th), min(tw, final.width - j * tw))
                values = read_scene(href, window, factor, method, [0], part)[0]
                yield pd.DataFrame({"band": [band], "i": [i], "j": [j], "data": [tiff.packed(values.astype(final.dtype), final.tile)]})

    n = len(plan) * down * across
    _assembled(spark, spark.range(0, n, 1, min(n, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(pack, _PACKED), path, final)


def write_labels(labels: DataFrame, path: str, profile: tiff.Profile, mapping: dict[int, int], names: dict[int, str], colours: dict[int, tuple[int, int, int]], tags: dict[str, str] | None = None) -> None:
    """Labels (row, col, class) as a GeoTIFF with a colour table, and the legend of the mapped classes as tags.

    ``names`` and ``colours`` are by mapped class; ``mapping`` is from source classes and goes into the tags.
    """
    legend = {"legend": "\n".join(f"{k} {v}" for k, v in sorted(names.items())), "class_legend": "; ".join(f"{k}={v}" for k, v in sorted(names.items())), "class_mapping": "; ".join(f"{a}->{b}" for a, b in sorted(mapping.items()))}
    final = replace(profile, bands=1, dtype="uint8", names=("lulc_class",), colours=colours, tags={**(tags or {}), **legend})
    write_raster(labels.select("row", "col", F.col("class").alias("lulc_class")), path, final)
