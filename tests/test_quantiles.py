"""Percentiles by refined histograms equal numpy's."""

import numpy as np
import pytest

from sunloom.operators import quantiles


@pytest.mark.parametrize("few, bins", [(1, 2), (3, 4), (50, 16), (2048, 1024)])
def test_percentiles_equal_numpy(spark, few, bins):
    rng = np.random.default_rng(few)
    groups = {
        1: rng.normal(size=700),
        2: np.repeat([5.0, 7.0, 7.0, 9.0], 60),
        3: np.full(90, 3.25),
        4: np.array([1.0]),
        5: np.array([-1e300, 1e300, 0.0, 1e-300]),
        6: np.concatenate([rng.normal(size=300), [1e12, -1e12]]),
        7: np.nextafter(1.0, 2.0) ** np.arange(100),
    }
    shares = [0.0, 0.013, 0.5, 0.9, 0.99, 1.0]
    rows = [(g, float(v), "x") for g, vs in groups.items() for v in rng.permutation(vs)]
    rows += [(1, None, "x"), (1, float("nan"), "x"), (1, float("inf"), "x"), (8, None, "x"), (None, 1.0, "x")]
    made = quantiles.percentiles(spark.createDataFrame(rows, "g long, value double, share string"), ["g"], "value", shares, few, bins)
    got = {(r.g, r.share): r.level for r in made.collect()}
    assert set(got) == {(g, s) for g in groups for s in shares}
    for (g, s), level in got.items():
        assert np.isclose(level, np.quantile(groups[g], s), rtol=1e-12, atol=1e-300), (g, s)


def test_all_rows_as_one_group_and_none(spark):
    df = spark.range(1001).selectExpr("cast(id * id % 1009 as double) v")
    made = quantiles.wide(quantiles.percentiles(df, [], "v", [0.25, 0.5], few=10, bins=8), [], {"low": 0.25, "middle": 0.5}).first()
    assert [made.low, made.middle] == np.quantile([k * k % 1009 for k in range(1001)], [0.25, 0.5]).tolist()
    assert quantiles.percentiles(df.limit(0), [], "v", [0.5]).count() == 0
