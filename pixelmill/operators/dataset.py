"""Items for training: patches loaded, normalised, augmented, and handed out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pixelmill.sources import scenes


def _normalised(x: np.ndarray, low: np.ndarray, high: np.ndarray, median: np.ndarray) -> np.ndarray:
    """[channels, h, w] in [0, 1]: missing values are the normalised median, a channel without range is 0."""
    span = (high - low)[:, None, None]
    place = lambda v: np.where(span > 0, (np.clip(v, low[:, None, None], high[:, None, None]) - low[:, None, None]) / np.where(span > 0, span, 1), 0)
    return np.where(np.isnan(x), place(median[:, None, None]), place(x)).astype(np.float32)


def _augmented(x: np.ndarray, y: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Both flipped and turned alike: flips with even odds, then none to three quarter turns."""
    for axis in (-1, -2):
        if draw.random() < 0.5:
            x, y = np.flip(x, axis), np.flip(y, axis)
    turns = int(draw.integers(4))
    return np.ascontiguousarray(np.rot90(x, turns, (-2, -1))), np.ascontiguousarray(np.rot90(y, turns, (-2, -1)))


def items(patches: DataFrame, stats: DataFrame, augment: bool = False, seed: int = 0) -> DataFrame:
    """(name, features array<float>, shape, labels array<int>) of :func:`scenes.npy_patches` rows, normalised and augmented.

    ``stats`` are (channel, low, high, median), a row per channel, and come to the driver. The draw of an item depends on
    the seed and its name only, so a repeated task gives the same item.
    """
    rows = sorted(stats.collect(), key=lambda r: r.channel)
    low, high, median = (np.array([r[c] for r in rows], np.float64) for c in ("low", "high", "median"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, flat, shape, labels in zip(frame["name"], frame["features"], frame["shape"], frame["labels"], strict=True):
                x, y = np.asarray(flat, np.float32).reshape(shape), np.asarray(labels, np.int32).reshape(shape[1:])
                if len(x) != len(low):
                    raise ValueError(f"{name} has {len(x)} channels, the statistics {len(low)}")
                x = _normalised(x, low, high, median)
                if augment:
                    x, y = _augmented(x, y, np.random.default_rng([seed, *name.rpartition("/")[2].encode()]))
                out.append((name, x.ravel(), list(x.shape), y.ravel()))
            yield pd.DataFrame(out, columns=["name", "features", "shape", "labels"])

    return patches.mapInPandas(run, "name string, features array<float>, shape array<int>, labels array<int>")


def loaded(spark, path: str, stats: DataFrame, augment: bool = False, seed: int = 0) -> DataFrame:
    """The items of a folder of .npy pairs; an error if it has none."""
    found = scenes.npy_patches(spark, path)
    if found.isEmpty():
        raise FileNotFoundError(f"no patches in {path}")
    return items(found, stats, augment, seed)


def arrays(items: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features float32 [channels, h, w], labels int64 [h, w]), one item after another; a partition at a time is held."""
    for r in items.toLocalIterator():
        yield np.array(r["features"], np.float32).reshape(r["shape"]), np.array(r["labels"], np.int64).reshape(r["shape"][1:])
