"""Configuration: one TOML file, checked when it is loaded."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pixelmill.functions.pixel import INDICES


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class Aoi:
    """The area of interest and what makes a candidate good enough."""

    year: int
    size: float
    candidates: dict[str, tuple[float, float]]
    selected: str = ""
    max_cloud_coverage: float = 10.0
    min_scenes: int = 30
    min_scenes_per_season: int = 5
    single_tile: bool = False
    bbox: tuple[float, float, float, float] | None = None

    def __post_init__(self):
        _require(self.size > 0, "aoi.size must be positive")
        _require(0 <= self.max_cloud_coverage <= 100, "aoi.max_cloud_coverage must be a percentage")
        _require(not self.selected or self.selected in self.candidates, f"aoi.selected {self.selected!r} is no candidate")


@dataclass(frozen=True)
class Stac:
    """The scene catalogue and how to retry it."""

    url: str
    collection: str
    retries: int = 5
    backoff: float = 1.0
    statuses: tuple[int, ...] = (429, 500, 502, 503, 504)

    def __post_init__(self):
        _require(bool(self.url), "stac.url must not be empty")
        _require(bool(self.collection), "stac.collection must not be empty")


@dataclass(frozen=True)
class Msi:
    """Bands of the instrument; ``bands`` maps a native resolution to {asset: band}."""

    target_resolution: float
    band_order: tuple[str, ...]
    bands: dict[int, dict[str, str]]
    scl_mask_classes: tuple[int, ...] = (0, 1, 3, 7, 8, 9, 10, 11)

    def __post_init__(self):
        _require(len(set(self.band_order)) == len(self.band_order), "msi.band_order has duplicates")
        provided = {b for by_asset in self.bands.values() for b in by_asset.values()}
        missing, extra = provided - set(self.band_order), set(self.band_order) - provided
        _require(not missing and not extra, f"msi.band_order differs from the bands: lacks {sorted(missing)}, adds {sorted(extra)}")
        _require("scl" in self.band_order, "msi.band_order lacks scl")
        _require(self.target_resolution in self.bands, f"no band has the target resolution of {self.target_resolution} m")

    @property
    def num_bands(self) -> int:
        return len(self.band_order)

    @property
    def scl_band_index(self) -> int:
        return self.band_order.index("scl")

    @property
    def spectral(self) -> tuple[str, ...]:
        return tuple(b for b in self.band_order if b != "scl")

    @property
    def channels(self) -> tuple[str, ...]:
        """The channels of a composite: the spectral bands, then the indices."""
        return (*self.spectral, *(i.upper() for i in INDICES))

    def by_asset(self) -> dict[str, str]:
        """Asset to band."""
        return {asset: band for own in self.bands.values() for asset, band in own.items()}

    def by_band(self) -> dict[str, str]:
        """Band to asset."""
        return {band: asset for asset, band in self.by_asset().items()}

    def position(self, band: str) -> int:
        _require(band in self.band_order, f"unknown band {band!r}")
        return self.band_order.index(band)

    def assets(self) -> list[str]:
        """Asset names in band order."""
        by_band = self.by_band()
        return [by_band[b] for b in self.band_order]

    def reference_asset(self, resolution: int) -> str:
        """An asset whose native resolution is this."""
        _require(bool(self.bands.get(resolution)), f"no asset of {resolution} m")
        return next(iter(self.bands[resolution]))


@dataclass(frozen=True)
class Indices:
    """Which band plays which part in the indices."""

    roles: dict[str, str] = field(default_factory=lambda: {"nir": "nir", "red": "red", "swir": "swir1", "green": "green"})

    def resolved(self, msi: Msi) -> dict[str, int]:
        return {role: msi.position(band) for role, band in self.roles.items()}


@dataclass(frozen=True)
class Composites:
    """First and last days of the seasons; December belongs to the winter of the next year."""

    seasons: dict[str, tuple[str, str]]
    max_scenes: int = 10
    tile_size: int = 1024
    discard_partial: bool = True


@dataclass(frozen=True)
class Labels:
    year: str
    version: str
    grid_url: str = ""
    nodata: int = 0
    class_map: dict[int, int] = field(default_factory=dict)
    class_names: dict[int, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Patches:
    size: int
    block_size: int
    buffer: float = 1000.0
    max_nan: float = 0.5
    percentiles: tuple[float, float] = (1.0, 99.0)
    stats_retention_fraction: float = 0.25
    seed: int = 3
    seeds: int = 200
    split: dict[str, float] = field(default_factory=lambda: {"train": 0.7, "val": 0.15, "test": 0.15})

    def __post_init__(self):
        _require(self.size > 0 and self.block_size % self.size == 0, "patches.block_size must be a multiple of patches.size")
        _require(set(self.split) == {"train", "val", "test"}, "patches.split needs train, val and test")
        _require(abs(sum(self.split.values()) - 1) < 1e-9, "patches.split must sum to 1")
        _require(all(v > 0 for v in self.split.values()), "patches.split must be positive")
        low, high = self.percentiles
        _require(0 <= low < high <= 100, "patches.percentiles must ascend within 0 to 100")
        _require(0 <= self.max_nan <= 1, "patches.max_nan must be a fraction")
        _require(0 < self.stats_retention_fraction <= 1, "patches.stats_retention_fraction must be a fraction")
        _require(self.buffer >= 0, "patches.buffer must not be negative")

    @property
    def patches_per_block(self) -> int:
        return self.block_size // self.size


@dataclass(frozen=True)
class Reporting:
    writer: str = "json"
    dt_format: str = "%Y%m%d-%H%M%S"
    indent: int = 2

    def __post_init__(self):
        _require(self.writer == "json", f"unknown report writer {self.writer!r}")


@dataclass(frozen=True)
class Config:
    aoi: Aoi
    stac: Stac
    msi: Msi
    indices: Indices
    composites: Composites
    labels: Labels
    patches: Patches
    reporting: Reporting = field(default_factory=Reporting)


def _numbered(table: dict) -> dict:
    return {int(k): v for k, v in table.items()}


def validated_raster(size: int, block: int) -> int:
    """The number of blocks a side; an error unless they fill the raster."""
    _require(0 < block <= size and size % block == 0, f"a raster of {size} pixels has no whole blocks of {block}")
    return size // block


def from_dict(raw: dict) -> Config:
    """A checked configuration; keys of class and resolution tables become integers."""
    for section in ("aoi", "stac", "msi", "composites", "labels", "patches"):
        _require(section in raw, f"the configuration lacks [{section}]")
    aoi, msi, labels = dict(raw["aoi"]), dict(raw["msi"]), dict(raw["labels"])
    aoi["candidates"] = {k: tuple(v) for k, v in aoi["candidates"].items()}
    if aoi.get("bbox"):
        aoi["bbox"] = tuple(aoi["bbox"])
    msi |= {"band_order": tuple(msi["band_order"]), "bands": _numbered(msi["bands"])}
    if "scl_mask_classes" in msi:
        msi["scl_mask_classes"] = tuple(msi["scl_mask_classes"])
    for k in ("class_map", "class_names"):
        labels[k] = _numbered(labels.get(k, {}))
    labels["year"] = str(labels["year"])
    composites = dict(raw["composites"]) | {"seasons": {k: tuple(v) for k, v in raw["composites"]["seasons"].items()}}
    patches = dict(raw["patches"])
    if "percentiles" in patches:
        patches["percentiles"] = tuple(patches["percentiles"])
    reporting = raw.get("reporting", {})
    return Config(Aoi(**aoi), Stac(**raw["stac"]), Msi(**msi), Indices(**({"roles": raw["indices"]} if "indices" in raw else {})), Composites(**composites), Labels(**labels), Patches(**patches), Reporting(**reporting))


def from_toml(text: str) -> Config:
    return from_dict(tomllib.loads(text))


def load(path: str | Path) -> Config:
    with open(path, "rb") as f:
        return from_dict(tomllib.load(f))


@dataclass(frozen=True)
class Paths:
    """Where everything is, under one root."""

    root: str

    def raw(self, season: str = "") -> str:
        return f"{self.root}/raw" + (f"/season={season}" if season else "")

    def composite(self, season: str = "") -> str:
        return f"{self.root}/composite" + (f"/season={season}" if season else "")

    @property
    def labels(self) -> str:
        return f"{self.root}/labels"

    @property
    def patches(self) -> str:
        return f"{self.root}/patches"

    @property
    def reports(self) -> str:
        return f"{self.root}/reports"
