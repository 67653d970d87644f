import random

import numpy as np
import pytest

from pixelmill.operators import patches, quantiles

FRACTIONS = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.98, "e": 1.0}


@pytest.mark.parametrize(("bins", "rounds", "at_once"), [(4, 2, 0), (64, 1, 0), (2048, 2, 0), (8, 0, 0), (8, 3, 100), (2048, 2, 1 << 20)])
def test_percentiles_equal_numpy(spark, monkeypatch, bins, rounds, at_once):
    monkeypatch.setattr(quantiles, "SORTED", at_once)
    r = random.Random(bins)
    groups = {
        "even": [r.random() for _ in range(1000)], "heavy": [r.paretovariate(0.3) for _ in range(777)], "ties": [r.choice((0.0, 1.0, 1.0 + 1e-15, 5.0)) for _ in range(500)],
        "one": [3.25], "two": [-1.0, 4.0], "equal": [2.0] * 50, "far": [1e-300, 1e300, -1e300, 0.0, -0.0, 5e-324],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("even", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x.k: x for x in quantiles.percentiles(df, ["k"], "v", FRACTIONS, bins, rounds).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, p in FRACTIONS.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-320 if k == "far" else 1e-300)


def test_percentiles_of_a_whole_table(spark):
    df = spark.range(1001).selectExpr("cast(id as double) as v")
    assert tuple(quantiles.percentiles(df, [], "v", {"x": 0.25, "y": 0.9999}).first()) == (250.0, pytest.approx(999.9))
    assert quantiles.percentiles(df.where("v < 0"), [], "v", {"x": 0.25}).where("x is not null").count() == 0


def test_small_tables_are_counted(spark):
    assert quantiles.checked(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError, match="more than 2"):
        quantiles.checked(spark.range(3), 2)


def test_channel_without_a_value(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, None)], "channel int, value double")
    got = {r.channel: r for r in patches.channel_stats(df).collect()}
    assert (got[0].median, got[0].mean, got[0].std) == (2.0, 2.0, 1.0) and got[1].median is None and got[1].mean is None


def test_statistics_are_broadcast_not_values(spark):
    values = spark.range(10_000).selectExpr("cast(id % 5 as int) as channel", "cast(id as double) as value")
    plan = patches.normalised(values, patches.channel_stats(values))._jdf.queryExecution().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_numbering_equals_one_window(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(40), r.randrange(40)) for _ in range(900)]
    rows = sorted(set(rows))
    got = {(x.set_name, x.patch_row, x.patch_col): x.number for x in patches.numbered(spark.createDataFrame(rows, "set_name string, patch_row int, patch_col int"), 4).collect()}
    for s in "ab":
        own = sorted((x for x in rows if x[0] == s), key=lambda x: (x[1] // 4, x[2] // 4, x[1], x[2]))
        assert [got[x] for x in own] == list(range(len(own)))
