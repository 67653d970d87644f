import math

import numpy as np
import pytest

from pixelmill.functions import geo
from pixelmill.operators import split


@pytest.mark.parametrize(("n", "want"), [(100, (70, 15, 15)), (25, (17, 4, 4)), (16, (10, 3, 3))])
def test_set_sizes(n, want):
    assert split.set_sizes(n) == want


@pytest.mark.parametrize(("args", "want"), [((0, 256, 10), 0), ((100, 256, 10), 1), ((1000, 256, 10), 1), ((2560, 256, 10), 1), ((2570, 256, 10), 2), ((1000, 256, 20), 1), ((10000, 256, 10), 4)])
def test_buffer_radius(args, want):
    assert geo.buffer_radius(*args) == want


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_buffer_equals_brute_force(spark, radius):
    grid = np.random.default_rng(radius).integers(0, 2, (6, 6))
    df = spark.createDataFrame([(0, i, j, int(grid[i, j])) for i in range(6) for j in range(6)], "seed int, row int, col int, set_id int")
    got = {(r.row, r.col): r.keep for r in split.buffered(df, radius).collect()}
    padded = np.pad(grid, max(radius, 1), mode="edge")
    for i in range(6):
        for j in range(6):
            around = padded[i + max(radius, 1) - radius : i + max(radius, 1) + radius + 1, j + max(radius, 1) - radius : j + max(radius, 1) + radius + 1]
            assert got[i, j] == bool((around == grid[i, j]).all())


def test_rng_assignment_has_the_sizes(spark):
    rows = split.assigned_by_rng(spark, 5, [0, 1]).collect()
    for seed in (0, 1):
        assert sorted(np.bincount([r.set_id for r in rows if r.seed == seed]).tolist()) == [4, 4, 17]


def counts(spark, table):
    return spark.createDataFrame([(i, j, k, n) for (i, j), own in table.items() for k, n in own.items()], "patch_row int, patch_col int, class int, n long")


def test_ties_take_the_lowest_seed_and_none_is_an_error(spark):
    kept = split.buffered(split.expanded(split.assigned_by_hash(spark, 4, 20), 2), 0)
    everywhere = counts(spark, {(i, j): {0: 1} for i in range(8) for j in range(8)})
    scores = split.seed_scores(kept, everywhere)
    assert split.selected_seed(scores) == 0
    alone = counts(spark, {(i, j): {0: 1} | ({1: 1} if (i, j) == (0, 0) else {}) for i in range(8) for j in range(8)})
    with pytest.raises(ValueError, match="no seed"):
        split.selected_seed(split.seed_scores(kept, alone))


def test_degrees_and_box(spark):
    from pyspark.sql import functions as F

    box = spark.range(1).select(*[c.alias(k) for k, c in geo.box(F.lit(37.0), F.lit(-5.0), 50000.0).items()]).first()
    assert box.north - box.south == pytest.approx(50000 / 110574)
    assert box.east - box.west == pytest.approx(50000 / (111320 * math.cos(math.radians(37))))


def test_utm_round_trip(spark):
    from pyspark.sql import functions as F

    x, y = geo.utm(-4.7, 37.25)
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(geo.utm_inverse_columns(F.lit(float(x)), F.lit(float(y))), ("lon", "lat"), strict=True)]).first()
    assert row.lon == pytest.approx(-4.7, abs=1e-7) and row.lat == pytest.approx(37.25, abs=1e-7)
    assert geo.utm(-3.0, 0.0)[0] == pytest.approx(500000)
