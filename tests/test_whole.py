import pytest

from pixelmill.functions import pixel
from pixelmill.operators import patches
from pixelmill.plans import queries as q
from pixelmill.plans import tables as t
from tests.conftest import TABLES, same_rows

#: With fewer rows, no patch of 52 channels has values enough.
SF = "/root/testdata/sf0.01"
PATCHES = ["patch_nan_filter", "patch_numbering", "split_class_counts", "split_patch_counts", "train_sample", "extract_patches"]


@pytest.fixture(scope="module")
def fuller():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", PATCHES)
def test_equals_sql_where_patches_are_kept(name, spark, fuller):
    got, want = same_rows(q.QUERIES[name](spark, SF), fuller, q.ORACLE_SQL[name])
    assert got and got == want


def test_patches_have_every_channel_and_pixel(spark):
    got = patches.tensors(q._placed(spark, SF), list(q._STACKED), t.PATCH).collect()
    assert got and all(len(r.features) == 4 * len(pixel.CHANNELS) == 52 for r in got)
    assert all(len(c) == len(r.labels) == 16 for r in got for c in r.features)


def test_all_seeds_are_tried(spark):
    assert q.QUERIES["seed_scores"](spark, SF).count() == 200
