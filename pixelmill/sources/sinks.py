"""Writers: pixel tables by block, labels with their legend, patches, statistics, reports, provenance."""

from __future__ import annotations

import dataclasses
import io
import json
import subprocess
import uuid
from collections.abc import Iterator
from datetime import date, datetime, timezone
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import pixel
from pixelmill.operators.split import SETS
from pixelmill.sources.scratch import file_system


def write_pixels(df: DataFrame, path: str, tile: int, by: tuple[str, ...] = ("season",), mode: str = "errorifexists") -> None:
    """A pixel table partitioned by ``by`` and clustered by block, so that windows prune files and row groups.

    Spark's commit protocol makes the output whole or absent; mode 'ignore' skips what exists.
    """
    blocks = {"block_row": pixel.block(F.col("row"), tile), "block_col": pixel.block(F.col("col"), tile)}
    placed = df.withColumns(blocks)
    placed.repartitionByRange(*by, "block_row", "block_col").sortWithinPartitions(*by, "block_row", "block_col", "row", "col").write.mode(mode).partitionBy(*by).parquet(path)


def write_labels(df: DataFrame, path: str, names: dict[int, str], colours: dict[int, tuple[int, int, int, int]]) -> None:
    """Labels, and beside them a table of (class, name, rgba)."""
    df.write.parquet(f"{path}/raster")
    rows = [(k, v, list(colours.get(k, (0, 0, 0, 0)))) for k, v in sorted(names.items())]
    df.sparkSession.createDataFrame(rows, "class int, name string, rgba array<int>").coalesce(1).write.parquet(f"{path}/legend")


def write_patches(df: DataFrame, path: str) -> None:
    """Tensors by split."""
    df.write.partitionBy("set_name").parquet(path)


def write_npy_patches(df: DataFrame, path: str, size: int) -> DataFrame:
    """Tensors (set_name, number, features, labels) as pairs of .npy files, {set}/patch_{number}_feature.npy and _label.npy.

    Features are float32 [channels, size, size], missing ones NaN; labels uint8 [size, size]. Tasks write under temporary
    names and rename, so a repeated task leaves whole files only. Returns (set_name, n) of what was written.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = file_system(path)
        for frame in frames:
            for name, number, features, labels in zip(frame.set_name, frame.number, frame.features, frame.labels, strict=True):
                x = np.stack([np.array([np.nan if v is None else v for v in c], np.float32) for c in features]).reshape(-1, size, size)
                fs.create_dir(f"{root}/{name}", recursive=True)
                for kind, values in (("feature", x), ("label", np.asarray(labels, np.uint8).reshape(size, size))):
                    own = f"{root}/{name}/patch_{number:04d}_{kind}.npy"
                    body = io.BytesIO()
                    np.save(body, values)
                    temporary = f"{own}.{uuid.uuid4().hex}.tmp"
                    with fs.open_output_stream(temporary) as out:
                        out.write(body.getvalue())
                    fs.move(temporary, own)
            yield pd.DataFrame({"set_name": frame.set_name, "n": np.ones(len(frame), np.int64)})

    fs, root = file_system(path)
    for name in SETS:  # a split without patches is an empty folder
        fs.create_dir(f"{root}/{name}", recursive=True)
    written = df.select("set_name", "number", "features", "labels").mapInPandas(run, "set_name string, n long")
    rows = written.groupBy("set_name").agg(F.sum("n").alias("n")).collect()  # a row per split
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], "set_name string, n long")


def patches_metadata(
    seed: int, radius: int, size: int, block_size: int, seasons: list[str], channels: list[str], mapping: dict[int, int], names: dict[int, str],
    kept: DataFrame, fractions: DataFrame, class_counts: DataFrame, most_missing: float,
) -> dict:
    """What the patches were made of, as the JSON beside them; all tables have a row per patch, or fewer.

    ``kept`` are the chosen seed's (row, col, set_id, keep); ``fractions`` (set_name, patch_row, patch_col, nan_fraction) of
    the patches before the filter; ``class_counts`` (set_name, idx, n); ``mapping`` is from classes to indexes.
    """
    grid = kept.select("row", "col", "set_id", F.col("keep").cast("int").alias("keep")).orderBy("row", "col").collect()
    shape = (max(r.row for r in grid) + 1, max(r.col for r in grid) + 1) if grid else (0, 0)
    table = lambda c: [[r[c] for r in grid[k * shape[1] : (k + 1) * shape[1]]] for k in range(shape[0])]
    n = {s: 0 for s in SETS} | {r.set_name: r.n for r in fractions.where(F.col("nan_fraction") <= most_missing).groupBy("set_name").agg(F.count("*").alias("n")).collect()}
    counts = {s: [0] * len(mapping) for s in SETS}
    for r in class_counts.collect():
        counts[r.set_name][r.idx] = r.n
    lost = fractions.where(F.col("nan_fraction") > most_missing).orderBy("patch_row", "patch_col").collect()
    return {
        "seed": seed, "buffer_radius": radius, "grid_shape": list(shape), "patch_size": size, "block_size": block_size, "num_channels": len(channels), "seasons": seasons, "channel_names": channels, **git_tags(),
        "label_mapping": {str(k): v for k, v in mapping.items()}, "class_names": {str(v): names[k] for k, v in mapping.items()}, "patches_per_split": n, "class_counts_per_split": counts,
        "discarded": [{"row": r.patch_row, "col": r.patch_col, "nan_fraction_features": r.nan_fraction} for r in lost], "block_labels": table("set_id"), "keep_mask": table("keep"),
    }


@dataclasses.dataclass(frozen=True)
class CandidateResult:
    """What was found for one area: the tiles counted, its box (west, south, east, north) and the scenes by season."""

    grid_code: list[str]
    bbox: tuple[float, float, float, float]
    scene_counts: dict[str, int]


@dataclasses.dataclass(frozen=True)
class AnalysisResult:
    """Which areas are good enough, and what was found for each."""

    valid_candidates: list[str] = dataclasses.field(default_factory=list)
    candidates_results: dict[str, CandidateResult] = dataclasses.field(default_factory=dict)


def analysis(boxes: dict[str, tuple[float, float, float, float]], tiles: DataFrame, counts: DataFrame, least: int, least_by_season: int) -> AnalysisResult:
    """The result of the first look at all areas, from (candidate, tile) and (candidate, season, n_scenes); a few rows each."""
    by_tile: dict[str, list[str]] = {c: [] for c in boxes}
    for r in tiles.select("candidate", "tile").distinct().orderBy("candidate", "tile").collect():
        by_tile[r.candidate].append(r.tile)
    found = {c: {s: 0 for s in pixel.SEASONS} for c in boxes}
    for r in counts.collect():
        found[r.candidate][r.season] = r.n_scenes
    good = [c for c in boxes if sum(found[c].values()) >= least and min(found[c].values()) >= least_by_season]
    return AnalysisResult(good, {c: CandidateResult(by_tile[c], boxes[c], found[c]) for c in boxes})


def statistics(stats: DataFrame, percentiles: tuple[float, float], seasons: list[str], channels: list[str]) -> dict:
    """Normalisation statistics, a row per channel, as the JSON that readers take."""
    rows = sorted(stats.collect(), key=lambda r: r.channel)
    return {"percentiles": list(percentiles), "seasons": seasons, "channel_names": channels, "git": git_revision(), **{k: [r[k] for r in rows] for k in ("low", "high", "median", "mean", "std")}}


def git_revision(folder: str | Path = ".") -> dict:
    """{'sha', 'dirty'} of a work tree; nulls outside one."""
    def ask(*args: str) -> str | None:
        out = subprocess.run(["git", "-C", str(folder), *args], capture_output=True, text=True, check=False)
        return out.stdout.strip() if out.returncode == 0 else None

    sha, state = ask("rev-parse", "HEAD"), ask("status", "--porcelain")
    return {"sha": sha, "dirty": None if state is None else bool(state)}


def git_tags(folder: str | Path = ".") -> dict:
    git = git_revision(folder)
    return {"git_sha": git["sha"], "git_dirty": git["dirty"]}


def raster_tags(channels: list[str], aoi: str, **extra: object) -> dict[str, str]:
    """Provenance as strings: time, channels, area, revision."""
    git = {k: str(v) for k, v in git_tags().items()}
    return {"created_utc": datetime.now(timezone.utc).isoformat(), "channel_names": ",".join(channels), "n_channels": str(len(channels)), "aoi": aoi, **git, **{k: str(v) for k, v in extra.items()}}


def stamped(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    """``df`` whose first column carries the tags as metadata, which parquet keeps."""
    first = df.columns[0]
    return df.withMetadata(first, {"provenance": tags})


def encoded(value: object) -> object:
    """For json.dumps: dataclasses, paths, dates and numpy scalars; anything else is an error."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return dataclasses.asdict(value)
    if isinstance(value, Path):
        return str(value)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, np.generic):
        return value.item()
    raise TypeError(f"{type(value).__name__} can't be written as JSON")


class Report:
    """Steps with their data, saved as one JSON list."""

    def __init__(self, dt_format: str | None = None, indent: int = 2):
        self.entries: list[dict] = []
        self.dt_format, self.indent = dt_format, indent

    def add(self, step: str, data: object, **metadata: object) -> None:
        self.entries.append({"step": step, "timestamp": datetime.now(timezone.utc).isoformat(), "data": data, "metadata": metadata})

    def save(self, path: str | Path) -> Path:
        path = Path(path)
        if path.suffix != ".json":
            raise ValueError(f"{path} is no .json file")
        if self.dt_format:
            path = path.with_name(f"{path.stem}-{datetime.now(timezone.utc).strftime(self.dt_format)}.json")
        path.write_text(json.dumps(self.entries, default=encoded, indent=self.indent))
        return path


def report_table(spark: SparkSession, report: Report) -> DataFrame:
    """A report's entries as (step, ts, data, metadata)."""
    rows = [(e["step"], e["timestamp"], json.dumps(e["data"], default=encoded), {k: str(v) for k, v in e["metadata"].items()}) for e in report.entries]
    return spark.createDataFrame(rows, "step string, ts string, data string, metadata map<string, string>")
