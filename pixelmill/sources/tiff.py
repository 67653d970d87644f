"""TIFF images with georeference, read by windows and written by tiles; numpy and zlib only.

Read: classic and big files in either byte order, in strips or tiles, bands apart or together, uncompressed, deflate or LZW,
with no, horizontal or floating-point predictor. Only the header and the chunks that a window touches are read, so a remote
file costs what is used of it. Written: classic or big little-endian files of deflated tiles, bands apart.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np

from pixelmill.functions.geo import Affine

# Numbers of tags and codes of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, COLOURS, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, EXTRA_SAMPLES, FORMAT = 317, 320, 322, 323, 324, 325, 338, 339
PIXEL_SCALE, TIE_POINT, MATRIX, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34264, 34735, 42112, 42113
PROJECTED, GEOGRAPHIC, MODEL_TYPE, RASTER_TYPE = 3072, 2048, 1024, 1025
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass(frozen=True)
class Profile:
    """What a raster is: its size, type, place and names."""

    height: int
    width: int
    bands: int
    dtype: str
    place: Affine | None = None
    epsg: int | None = None
    nodata: float | None = None
    names: tuple[str, ...] = ()
    tags: dict[str, str] = field(default_factory=dict)
    colours: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    tile: tuple[int, int] = (256, 256)

    @property
    def grid(self) -> tuple[int, int]:
        """Rows and columns of tiles."""
        return -(-self.height // self.tile[0]), -(-self.width // self.tile[1])


@dataclass(frozen=True)
class Layout:
    """Where an image's chunks are in its file, and how they are packed."""

    order: str
    compression: int
    predictor: int
    together: bool
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]


def _entries(file: BinaryIO) -> tuple[str, dict[int, tuple]]:
    """The byte order and the tags of the first image."""
    file.seek(0)
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise ValueError("not a TIFF file")
    version = struct.unpack(order + "H", head[2:4])[0]
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    count, entry, inline = ("Q", "HHQ", 8) if big else ("H", "HHI", 4)
    start = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    file.seek(start)
    n = struct.unpack(order + count, file.read(struct.calcsize("=" + count)))[0]
    size = struct.calcsize("=" + entry) + inline
    table = file.read(n * size)
    if len(table) < n * size:
        raise ValueError("the file's directory is cut off")
    out = {}
    for k in range(n):
        raw = table[k * size : (k + 1) * size]
        tag, kind, length = struct.unpack(order + entry, raw[:-inline])
        code = _TYPES.get(kind)
        if code is None:
            continue
        bytes_ = struct.calcsize("=" + code) * length
        if bytes_ > inline:
            file.seek(struct.unpack(order + ("Q" if big else "I"), raw[-inline:])[0])
            body = file.read(bytes_)
        else:
            body = raw[-inline:][:bytes_]
        out[tag] = (body,) if code == "s" else struct.unpack(f"{order}{length * len(code)}{code[0]}", body)
    return order, out


def read_header(file: BinaryIO) -> tuple[Profile, Layout]:
    """The profile and the layout of the file's first image."""
    order, tags = _entries(file)
    height, width, bands = tags[HEIGHT][0], tags[WIDTH][0], tags.get(SAMPLES, (1,))[0]
    bits, kind = set(tags.get(BITS, (1,))), set(tags.get(FORMAT, (1,)))
    if len(bits) > 1 or len(kind) > 1 or not kind <= set(_KINDS) or not bits <= {8, 16, 32, 64}:
        raise ValueError(f"samples of {sorted(bits)} bits and formats {sorted(kind)} aren't supported")
    dtype = np.dtype(f"{_KINDS[kind.pop()]}{bits.pop() // 8}")
    if TILES in tags:
        tile, offsets, sizes = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]), tags[TILES], tags[TILE_SIZES]
    else:
        tile, offsets, sizes = (min(tags.get(ROWS_PER_STRIP, (height,))[0], height), width), tags[STRIPS], tags[STRIP_SIZES]
    place = None
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        (a, e, _), (i, j, _, x, y, _) = tags[PIXEL_SCALE][:3], tags[TIE_POINT][:6]
        place = Affine(x - i * a, y + j * e, a, -e)
    elif MATRIX in tags:
        m = tags[MATRIX]
        if m[1] or m[4]:
            raise ValueError("rotated rasters aren't supported")
        place = Affine(m[3], m[7], m[0], m[5])
    keys = tags.get(GEO_KEYS, ())
    geo = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    text = lambda t: tags[t][0].rstrip(b"\0 ").decode("utf-8", "replace") if t in tags else None
    names, extra = [""] * bands, {}
    if text(METADATA):
        for item in ElementTree.fromstring(text(METADATA)).iter("Item"):
            if item.get("role") == "description" and 0 <= int(item.get("sample", "-1")) < bands:
                names[int(item.get("sample"))] = item.text or ""
            elif item.get("sample") is None:
                extra[item.get("name", "")] = item.text or ""
    table = tags.get(COLOURS, ())
    n = len(table) // 3
    colours = {k: tuple(table[k + c * n] // 257 for c in range(3)) for k in range(n)}
    nodata = float(text(NODATA)) if text(NODATA) else None
    profile = Profile(height, width, bands, dtype.name, place, geo.get(PROJECTED, geo.get(GEOGRAPHIC)), nodata, tuple(names) if any(names) else (), extra, colours, tile)
    return profile, Layout(order, tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], tags.get(PLANAR, (1,))[0] == 1, offsets, sizes)


def unpacked_lzw(data: bytes) -> bytes:
    """The bytes of an LZW stream, most significant bit first, codes of 9 to 12 bits."""
    fresh = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, width, held, bits, last = list(fresh), [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(fresh), 9, b""
            continue
        if code < len(table):
            found = table[code]
        elif last and code == len(table):
            found = last + last[:1]
        else:
            raise ValueError("a damaged LZW stream")
        out.append(found)
        if last:
            table.append(last + found[:1])
        last = found
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _unpacked(raw: bytes, layout: Layout, dtype: np.dtype, shape: tuple[int, int, int]) -> np.ndarray:
    """A chunk [rows, columns, samples] of its bytes; a last strip may be short."""
    if layout.compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif layout.compression == LZW:
        raw = unpacked_lzw(raw)
    elif layout.compression != NONE:
        raise ValueError(f"compression {layout.compression} isn't supported")
    rows = len(raw) // (shape[1] * shape[2] * dtype.itemsize)
    shape = (min(rows, shape[0]), *shape[1:])
    size = shape[0] * shape[1] * shape[2]
    if layout.predictor == 3:
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize).reshape(shape[0], -1)
        whole = np.cumsum(planes.reshape(shape[0], -1, shape[2]), axis=1, dtype=np.uint8).reshape(shape[0], dtype.itemsize, -1)
        return np.ascontiguousarray(whole.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(shape).astype(dtype)
    out = np.frombuffer(raw, dtype.newbyteorder(layout.order), size).reshape(shape).astype(dtype)
    if layout.predictor == 2:
        out = np.cumsum(out, axis=1, dtype=dtype)
    elif layout.predictor != 1:
        raise ValueError(f"predictor {layout.predictor} isn't supported")
    return out


def read_window(file: BinaryIO, profile: Profile, layout: Layout, window: tuple[int, int, int, int], bands: Iterable[int] | None = None) -> np.ndarray:
    """[bands, height, width] of the window (row, col, height, width), which must lie within the raster."""
    row, col, height, width = window
    if row < 0 or col < 0 or height < 0 or width < 0 or row + height > profile.height or col + width > profile.width:
        raise ValueError(f"the window {window} leaves the raster of {profile.height} x {profile.width}")
    bands = list(range(profile.bands)) if bands is None else list(bands)
    dtype = np.dtype(profile.dtype)
    out = np.zeros((len(bands), height, width), dtype)
    th, tw = profile.tile
    down, across = profile.grid
    for i in range(row // th, -(-(row + height) // th) if height and width else 0):
        for j in range(col // tw, -(-(col + width) // tw)):
            r0, r1, c0, c1 = max(row, i * th), min(row + height, (i + 1) * th), max(col, j * tw), min(col + width, (j + 1) * tw)
            cut = slice(r0 - i * th, r1 - i * th), slice(c0 - j * tw, c1 - j * tw)
            to = slice(r0 - row, r1 - row), slice(c0 - col, c1 - col)
            chunk = None
            for k, band in enumerate(bands):
                if chunk is None or not layout.together:
                    at = (0 if layout.together else band * down * across) + i * across + j
                    samples = profile.bands if layout.together else 1
                    if layout.sizes[at]:
                        file.seek(layout.offsets[at])
                        raw = file.read(layout.sizes[at])
                        if len(raw) < layout.sizes[at]:
                            raise ValueError("a chunk is cut off")
                        chunk = _unpacked(raw, layout, dtype, (th, tw, samples))
                    else:  # a sparse file leaves out empty chunks
                        chunk = np.full((th, tw, samples), 0 if profile.nodata is None else profile.nodata, dtype)
                out[(k, *to)] = chunk[(*cut, band if layout.together else 0)]
    return out


def packed(tile: np.ndarray, shape: tuple[int, int], fill: float = 0) -> bytes:
    """A deflated tile of one band; tiles at the right and bottom edges are filled up."""
    whole = np.full(shape, fill, tile.dtype)
    whole[: tile.shape[0], : tile.shape[1]] = tile
    return zlib.compress(whole.astype(whole.dtype.newbyteorder("<")).tobytes(), 6)


def write(file: BinaryIO, profile: Profile, sizes: list[int], chunks: Iterable[bytes]) -> None:
    """A file of deflated tiles, band by band, each by rows of tiles; ``sizes`` are the chunks' lengths, in order.

    The header comes first, so chunks are streamed and only their sizes are held. Beyond 4 GB the file is a big one.
    """
    down, across = profile.grid
    n = profile.bands * down * across
    if len(sizes) != n:
        raise ValueError(f"{n} tiles are needed, not {len(sizes)}")
    dtype = np.dtype(profile.dtype)
    big = sum(sizes) + 64 * n > (1 << 32) - (1 << 20)
    xml = "".join(f'<Item name="{escape(k, {chr(34): "&quot;"})}">{escape(str(v))}</Item>' for k, v in profile.tags.items())
    xml += "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{escape(v)}</Item>' for k, v in enumerate(profile.names))
    tags: dict[int, tuple[int, tuple | bytes]] = {
        WIDTH: (4, (profile.width,)), HEIGHT: (4, (profile.height,)), BITS: (3, (dtype.itemsize * 8,) * profile.bands), COMPRESSION: (3, (DEFLATE,)), PHOTOMETRIC: (3, (3 if profile.colours else 1,)),
        SAMPLES: (3, (profile.bands,)), PLANAR: (3, (2,)), TILE_WIDTH: (4, (profile.tile[1],)), TILE_HEIGHT: (4, (profile.tile[0],)), FORMAT: (3, ({"u": 1, "i": 2, "f": 3}[dtype.kind],) * profile.bands),
        TILES: (16 if big else 4, (0,) * n), TILE_SIZES: (16 if big else 4, tuple(sizes)),
    }
    if profile.bands > 1:
        tags[EXTRA_SAMPLES] = (3, (0,) * (profile.bands - 1))
    if profile.colours:
        size = 1 << dtype.itemsize * 8
        tags[COLOURS] = (3, tuple(profile.colours.get(k, (0, 0, 0))[c] * 257 for c in range(3) for k in range(size)))
    if profile.place:
        tags[PIXEL_SCALE] = (12, (profile.place.a, -profile.place.e, 0.0))
        tags[TIE_POINT] = (12, (0.0, 0.0, 0.0, profile.place.x0, profile.place.y0, 0.0))
    if profile.epsg:
        degrees = 4000 <= profile.epsg < 5000
        tags[GEO_KEYS] = (3, (1, 1, 0, 3, MODEL_TYPE, 0, 1, 2 if degrees else 1, RASTER_TYPE, 0, 1, 1, GEOGRAPHIC if degrees else PROJECTED, 0, 1, profile.epsg))
    if xml:
        tags[METADATA] = (2, f"<GDALMetadata>{xml}</GDALMetadata>".encode() + b"\0")
    if profile.nodata is not None:
        tags[NODATA] = (2, f"{profile.nodata:g}".encode() + b"\0")
    inline, word = (8, "Q") if big else (4, "I")
    begin = 16 if big else 8
    place = begin + (8 if big else 2) + len(tags) * (12 + inline if big else 12) + inline

    def laid() -> tuple[bytes, int]:
        entries, bodies, at = b"", b"", place
        for tag, (kind, values) in sorted(tags.items()):
            body = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
            entries += struct.pack("<HHQ" if big else "<HHI", tag, kind, len(values))
            if len(body) > inline:
                entries += struct.pack("<" + word, at + len(bodies))
                bodies += body + b"\0" * (len(body) % 2)
            else:
                entries += body.ljust(inline, b"\0")
        head = (b"II" + struct.pack("<HHHQ", 43, 8, 0, begin) + struct.pack("<Q", len(tags))) if big else (b"II" + struct.pack("<HI", 42, begin) + struct.pack("<H", len(tags)))
        return head + entries + b"\0" * inline + bodies, place + len(bodies)

    _, start = laid()
    offsets = start + np.concatenate(([0], np.cumsum(sizes[:-1], dtype=np.int64))) if n else np.zeros(0, np.int64)
    tags[TILES] = (tags[TILES][0], tuple(int(x) for x in offsets))
    file.write(laid()[0])
    for size, chunk in zip(sizes, chunks, strict=True):
        if len(chunk) != size:
            raise ValueError("a tile differs from its announced size")
        file.write(chunk)


def write_array(file: BinaryIO, profile: Profile, values: np.ndarray) -> None:
    """A file of an array [bands, height, width]."""
    check_shape(profile, values)
    th, tw = profile.tile
    down, across = profile.grid
    fill = 0 if profile.nodata is None else profile.nodata
    chunks = [packed(band[i * th : (i + 1) * th, j * tw : (j + 1) * tw].astype(profile.dtype), profile.tile, fill) for band in values for i in range(down) for j in range(across)]
    write(file, profile, [len(c) for c in chunks], chunks)


def check_shape(profile: Profile, values: np.ndarray) -> None:
    """An error unless the last two dimensions, of two or three, are the profile's."""
    if values.ndim not in (2, 3):
        raise ValueError(f"{values.ndim} dimensions, where a raster has 2 or 3")
    for name, want, got in (("height", profile.height, values.shape[-2]), ("width", profile.width, values.shape[-1])):
        if want != got:
            raise ValueError(f"a {name} of {got}, where {want} is needed")


def resized(read: Callable[[tuple[int, int, int, int]], np.ndarray], window: tuple[int, int, int, int], factor: float, method: str, part: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """The window at ``factor`` times its resolution, int(h * factor) x int(w * factor), by 'nearest' or 'bilinear'.

    ``read`` gives [bands, h, w] of a source window; only the rows and columns that ``part`` (of the result) needs are read.
    Sample centres are those of image warping, and edges of the window are clamped.
    """
    row, col, height, width = window
    whole = int(height * factor), int(width * factor)
    r, c, h, w = part or (0, 0, *whole)
    axes = []
    for start, size, n, total in ((r, h, height, whole[0]), (c, w, width, whole[1])):
        at = (np.arange(start, start + size) + 0.5) * n / total - 0.5
        if method == "nearest":
            low = high = np.clip(np.floor(at + 0.5).astype(int), 0, n - 1)
            share = np.zeros(size)
        elif method == "bilinear":
            at = np.clip(at, 0, n - 1)
            low = np.floor(at).astype(int)
            high, share = np.minimum(low + 1, n - 1), at - low
        else:
            raise ValueError(f"unknown method {method!r}")
        axes.append((low, high, share))
    (r0, r1, rs), (c0, c1, cs) = axes
    if not h or not w:
        return read((row, col, 0, 0)).reshape(-1, h, w)
    top, left = int(r0.min()), int(c0.min())
    source = read((row + top, col + left, int(r1.max()) - top + 1, int(c1.max()) - left + 1))
    if method == "nearest":
        return source[:, r0 - top][:, :, c0 - left]
    pick = lambda a, b: source[:, a - top][:, :, b - left].astype(np.float64)
    rs, cs = rs[None, :, None], cs[None, None, :]
    mixed = (pick(r0, c0) * (1 - cs) + pick(r0, c1) * cs) * (1 - rs) + (pick(r1, c0) * (1 - cs) + pick(r1, c1) * cs) * rs
    return (np.rint(mixed) if source.dtype.kind in "ui" else mixed).astype(source.dtype)
