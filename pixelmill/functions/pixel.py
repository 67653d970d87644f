"""Column functions over pixels. Missing values are null everywhere; NaN never enters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digital numbers to reflectances.
SCALE, OFFSET = 0.0001, -0.1
#: Scene classes that hide the ground.
HIDDEN_CLASSES = (0, 1, 3, 7, 8, 9, 10, 11)
BANDS = ("blue", "green", "red", "red_edge1", "red_edge2", "red_edge3", "nir", "narrow_nir", "swir1", "swir2")
INDICES = ("ndvi", "ndbi", "ndwi")
CHANNELS = (*BANDS, *INDICES)
SEASONS = ("DJF", "MAM", "JJA", "SON")
IGNORE = 255


def to_missing(x: Column) -> Column:
    """NaN becomes null, for columns read from files that mark missing values so."""
    return F.when(~F.isnan(x), x)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """x within [low, high]; null stays null, which least and greatest alone would not keep."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.when(x.isNotNull(), F.least(F.greatest(x, as_column(low)), as_column(high)))


def hidden(scl: Column, classes: tuple[int, ...] = HIDDEN_CLASSES) -> Column:
    """True for pixels whose scene class is to be masked."""
    return scl.isin(*classes)


def masked(band: Column, scl: Column, classes: tuple[int, ...] = HIDDEN_CLASSES) -> Column:
    return F.when(~hidden(scl, classes), band)


def reflectance(dn: Column) -> Column:
    """Number 0 is missing; others scale, and negative ones are 0."""
    return F.when(dn != 0, F.greatest(dn * F.lit(SCALE) + F.lit(OFFSET), F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null where the sum is 0 or an input is null."""
    return (a - b) / F.nullif(a + b, F.lit(0.0))


def indices(nir: Column, red: Column, swir: Column, green: Column) -> dict[str, Column]:
    return {"ndvi": ratio(nir, red), "ndbi": ratio(swir, nir), "ndwi": ratio(green, nir)}


def season_of(month: Column) -> Column:
    """The season of a calendar month; null for null."""
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").when(month.isin(9, 10, 11), "SON")


def reclass(code: Column, mapping: dict[int, int]) -> Column:
    """Class codes by table; what isn't in it is 0."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return F.coalesce(table[code], F.lit(0))


def normalised(x: Column, low: Column, high: Column, median: Column) -> Column:
    """Clipped min-max scaling; a constant channel is 0, and a missing value takes the median's place."""
    value = F.least(F.greatest(F.coalesce(x, median), low), high)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.when(value.isNotNull(), F.lit(0.0)))


def stretched(x: Column, low: Column, high: Column) -> Column:
    """Contrast stretch to [0, 1]."""
    return clip((x - low) / F.nullif(high - low, F.lit(0.0)), 0.0, 1.0)


def rgb_unit(rgb: Column) -> Column:
    """Colour components of 0 to 255 as 0 to 1."""
    return F.transform(rgb, lambda x: x / F.lit(255.0))


def block(x: Column, size: int) -> Column:
    """The index of the block of ``size`` that a non-negative coordinate is in."""
    return F.floor(x / F.lit(size)).cast("int")


def mirrored(row: Column, col: Column, height: int, width: int, flip_w: Column, flip_h: Column, turns: Column) -> tuple[Column, Column]:
    """Where a pixel goes when a patch is flipped in width, then in height, then turned by quarters counter-clockwise."""
    c = F.when(flip_w, F.lit(width - 1) - col).otherwise(col)
    r = F.when(flip_h, F.lit(height - 1) - row).otherwise(row)
    to_row = F.when(turns == 1, F.lit(width - 1) - c).when(turns == 2, F.lit(height - 1) - r).when(turns == 3, c).otherwise(r)
    to_col = F.when(turns == 1, r).when(turns == 2, F.lit(width - 1) - c).when(turns == 3, F.lit(height - 1) - r).otherwise(c)
    return to_row.cast("int"), to_col.cast("int")


def percentile_range(low: Column, high: Column) -> Column:
    """What normalisation divides by."""
    return high - low


def patch_window(row: Column, col: Column, size: int) -> Column:
    """The pixels of a patch: a struct of row, col, height and width."""
    return F.struct((row * size).cast("int").alias("row"), (col * size).cast("int").alias("col"), F.lit(size).alias("height"), F.lit(size).alias("width"))


def season_in(day: Column, windows: dict[str, tuple[str, str]]) -> Column:
    """The season whose first and last day (ISO dates) hold the day; null outside all. Unlike :func:`season_of`, December
    belongs to the winter that its window names, be it of the next year."""
    date, out = F.to_date(day), F.lit(None).cast("string")
    for name, (first, last) in reversed(windows.items()):
        out = F.when(date.between(F.to_date(F.lit(first)), F.to_date(F.lit(last))), name).otherwise(out)
    return out
