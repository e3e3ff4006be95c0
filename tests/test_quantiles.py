"""Exact quantiles of large groups against numpy, with the bounds on what a task orders set low."""

from __future__ import annotations

import random

import numpy as np
import pytest

from taxaloom.operators.quantiles import group_medians, group_quantiles

TAUS = [0.0, 0.1, 0.5, 0.73, 1.0]


def groups() -> dict:
    rng = random.Random(4)
    return {
        "uniform": [rng.random() for _ in range(3000)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(1500)] + [1.7e308, -1.7e308],
        "ties": [5.0] * 2000 + [7.0] * 3 + [1.0],
        "one": [3.5],
        "even": [1.0, 2.0, 3.0, 10.0],
        None: [float(k) for k in range(700)],
    }


@pytest.mark.parametrize("ordered_rows", [20, 1000, 100_000])
def test_group_quantiles_equal_numpy(spark, ordered_rows):
    held = groups()
    rows = [(g, v, -v, 0) for g, vs in held.items() for v in vs] + [("uniform", None, float("nan"), 1), ("empty", None, None, 2)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double, w double, _v int").repartition(4)
    got = {r.g: r for r in group_quantiles(df, ["g"], ["v", "w"], TAUS, buckets=16, ordered_rows=ordered_rows).collect()}
    assert set(got) == {*held, "empty"} and got["empty"].v_quantiles is None
    for g, vs in held.items():
        assert np.allclose(got[g].v_quantiles, np.quantile(vs, TAUS), rtol=1e-12), g
        assert np.allclose(got[g].w_quantiles, np.quantile([-v for v in vs], TAUS), rtol=1e-12), g


@pytest.mark.parametrize("ordered_rows", [50, 100_000])
def test_quantiles_of_a_whole_table(spark, ordered_rows):
    values = groups()["uniform"]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert np.allclose(group_quantiles(df, [], ["v"], TAUS, ordered_rows=ordered_rows).first().v_quantiles, np.quantile(values, TAUS))
    assert group_medians(df.where("false"), [], ["v"]).collect()[0][0] is None
    assert group_medians(df.withColumn("k", df["v"]).where("false"), ["k"], ["v"]).count() == 0
