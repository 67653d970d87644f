import numpy as np
import pytest

from pixelmill.plans import files  # noqa: F401  (adds its queries)
from pixelmill.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, duck, sf):
    got, want = same_rows(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_reprojection_finds_the_pixel_that_holds_a_centre(spark, sf):
    """Against the forward series: each target's centre in degrees, by search over the source's corners."""
    from pixelmill.functions import geo
    from pixelmill.operators import resample

    target = spark.createDataFrame([(i, j) for i in range(0, 80, 9) for j in range(0, 80, 7)], "row int, col int")
    source = spark.createDataFrame([(i, j, (i * 7 + j) % 50 + 1) for i in range(80) for j in range(80)], "row int, col int, class int")
    got = {(r.row, r.col): r["class"] for r in resample.reprojected_nearest(target, geo.Affine(200780.0, 4151040.0, 640.0, -640.0), source, geo.Affine(-6.5, 38.0, 0.02, -0.02)).collect()}
    lon, lat = np.meshgrid(-6.5 + (np.arange(8000) + 0.5) * 0.0002, 38.0 - (np.arange(8000) + 0.5) * 0.0002)
    x, y = geo.utm(lon[::25, ::25], lat[::25, ::25])
    for (i, j), found in got.items():
        centre = 200780.0 + (j + 0.5) * 640, 4151040.0 - (i + 0.5) * 640
        k = np.unravel_index(np.argmin((x - centre[0]) ** 2 + (y - centre[1]) ** 2), x.shape)
        near = lat[::25, ::25][k], lon[::25, ::25][k]
        # the nearest sample lies within 0.0025 degrees, so the pixel is one of those around it
        cells = {(int((38.0 - near[0] + a) // 0.02), int((near[1] + b + 6.5) // 0.02)) for a in (-0.003, 0, 0.003) for b in (-0.003, 0, 0.003)}
        assert found in {(r * 7 + c) % 50 + 1 if 0 <= r < 80 and 0 <= c < 80 else 0 for r, c in cells}
    assert sum(v > 0 for v in got.values()) > 60


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
