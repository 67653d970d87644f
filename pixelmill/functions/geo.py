"""Geometry: degrees and metres, boxes, transverse Mercator, pixel windows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a degree of latitude, and in one of longitude on the equator.
METRES_LAT, METRES_LON = 110574.0, 111320.0


def degrees_for(metres: Column | float, latitude: Column) -> tuple[Column, Column]:
    """(degrees of latitude, degrees of longitude) that so many metres span at a latitude."""
    m = metres if isinstance(metres, Column) else F.lit(float(metres))
    return m / F.lit(METRES_LAT), m / (F.lit(METRES_LON) * F.cos(F.radians(latitude)))


def box(lat: Column, lon: Column, size_m: float) -> dict[str, Column]:
    """The square of ``size_m`` a side around a point."""
    dlat, dlon = degrees_for(size_m / 2, lat)
    return {"west": lon - dlon, "south": lat - dlat, "east": lon + dlon, "north": lat + dlat}


def intersects(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes share a point; touching counts."""
    return (a["west"] <= b["east"]) & (a["east"] >= b["west"]) & (a["south"] <= b["north"]) & (a["north"] >= b["south"])


def corners(box: tuple[float, float, float, float], epsg: int = 4326) -> list[tuple[float, float]]:
    """The corners of a box in degrees (w, s, e, n), in order around it, in degrees or on a northern UTM map (326xx)."""
    w, s, e, n = box
    ring = [(w, s), (e, s), (e, n), (w, n)]
    if epsg == 4326:
        return ring
    if not 32601 <= epsg <= 32660:
        raise ValueError(f"EPSG:{epsg} isn't supported")
    return [tuple(float(v) for v in utm(x, y, epsg - 32600)) for x, y in ring]


def polygon_intersects(rings: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a polygon (all rings of all its parts) and a convex one share a point; touching counts, holes don't belong.

    Either an edge meets an edge, or one lies within the other: then a corner of the one is inside the other.
    """
    number = lambda v: F.lit(float(v))
    sides = list(zip(corners, corners[1:] + corners[:1], strict=True))

    def turn(ax, ay, bx, by, px, py):
        return (bx - ax) * (py - ay) - (by - ay) * (px - ax)

    def between(a, b, p):
        return (F.least(a, b) <= p) & (p <= F.greatest(a, b))

    def meets(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        out = F.lit(False)
        for (cx, cy), (dx, dy) in sides:
            cx, cy, dx, dy = map(number, (cx, cy, dx, dy))
            a, b = turn(cx, cy, dx, dy, x1, y1), turn(cx, cy, dx, dy, x2, y2)
            c, d = turn(x1, y1, x2, y2, cx, cy), turn(x1, y1, x2, y2, dx, dy)
            cross = (F.signum(a) * F.signum(b) < 0) & (F.signum(c) * F.signum(d) < 0)
            on = lambda t, ax, ay, bx, by, px, py: (t == 0) & between(ax, bx, px) & between(ay, by, py)
            out = out | cross | on(a, cx, cy, dx, dy, x1, y1) | on(b, cx, cy, dx, dy, x2, y2) | on(c, x1, y1, x2, y2, cx, cy) | on(d, x1, y1, x2, y2, dx, dy)
        return out

    def edges(ring: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda k: F.struct(F.get(ring, k)[0].alias("x1"), F.get(ring, k)[1].alias("y1"), F.get(ring, k + 1)[0].alias("x2"), F.get(ring, k + 1)[1].alias("y2")))

    every = F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), edges))
    px, py = map(number, corners[0])
    right = lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    holds = F.size(F.filter(every, lambda e: F.coalesce(right(e), F.lit(False)))) % 2 == 1
    vertex = F.get(F.get(rings, 0), 0)
    signs = [F.signum(turn(*map(number, (*a, *b)), vertex[0], vertex[1])) for a, b in sides]
    held = F.coalesce(F.greatest(*signs) <= 0, F.lit(False)) | F.coalesce(F.least(*signs) >= 0, F.lit(False))
    return F.exists(every, lambda e: meets(e["x1"], e["y1"], e["x2"], e["y2"])) | holds | held


def buffer_radius(buffer_m: float, patch: int, resolution: float) -> int:
    """Patches that a buffer spans, rounded up."""
    return math.ceil(buffer_m / resolution / patch)


@dataclass(frozen=True)
class Affine:
    """Pixel (row, col) to map: x = x0 + col * a, y = y0 + row * e."""

    x0: float
    y0: float
    a: float
    e: float

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return self.x0 + (col + 0.5) * self.a, self.y0 + (row + 0.5) * self.e


#: The WGS 84 ellipsoid and UTM.
_A, _F, _K0, _EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)

#: Metres of a radian on the map.
SCALE = _K0 * _RADIUS


def utm(lon, lat, zone: int = 30):
    """Eastings and northings (north of the equator) by Krüger's series of three terms; arrays or numbers."""
    lam, phi = np.radians(np.asarray(lon) - (zone * 6 - 183)), np.radians(lat)
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(_FORWARD, 1):
        x = x + c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y = y + c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return _EASTING + SCALE * x, SCALE * y


def utm_inverse_columns(x: Column, y: Column, zone: int = 30) -> tuple[Column, Column]:
    """(lon, lat) columns of eastings and northings."""
    xi, eta = y / F.lit(SCALE), (x - F.lit(_EASTING)) / F.lit(SCALE)
    a, b = xi, eta
    for j, c in enumerate(BACK, 1):
        a = a - F.lit(c) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
        b = b - F.lit(c) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for j, c in enumerate(LATITUDE, 1):
        phi = phi + F.lit(c) * F.sin(chi * (2 * j))
    return F.lit(float(zone * 6 - 183)) + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(phi)


def pixel_window(box: tuple[float, float, float, float], x0: float, y0: float, resolution: float, zone: int = 30, points: int = 21) -> dict[str, float]:
    """The window of a box in degrees (w, s, e, n) on a UTM raster: offsets are floored, lengths rounded.

    The edges are densified, as straight lines in degrees are curved on the map.
    """
    w, s, e, n = box
    t = np.linspace(0, 1, points)
    lon = np.concatenate((w + (e - w) * t, np.full(points, e), w + (e - w) * t, np.full(points, w)))
    lat = np.concatenate((np.full(points, s), s + (n - s) * t, np.full(points, n), s + (n - s) * t))
    x, y = utm(lon, lat, zone)
    col, row = math.floor((x.min() - x0) / resolution), math.floor((y0 - y.max()) / resolution)
    width, height = round((x.max() - x.min()) / resolution), round((y.max() - y.min()) / resolution)
    return {"row": row, "col": col, "height": height, "width": width, "x0": x0 + col * resolution, "y0": y0 - row * resolution}
