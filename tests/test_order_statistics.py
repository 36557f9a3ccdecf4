"""Exact order statistics against sorted lists, also where values crowd or spread over all magnitudes."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cartwarden.operators import order_statistics as O

SCHEMA = "key string, value double"


def groups() -> dict:
    r = random.Random(6)
    return {
        "even": [r.uniform(-5, 5) for _ in range(3000)], "one": [7.5], "same": [2.0] * 500, "few": [r.choice([1.0, 2.0, 2.0, 9.0]) for _ in range(901)], "wide": [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(1500)],
        "crowded": [1.0 + r.random() * 1e-12 for _ in range(1500)] + [1e300, -1e300], "ends": [1.7e308, -1.7e308, 0.0, -0.0, 5e-324], None: [float(i) for i in range(100)],
    }


@pytest.mark.parametrize("few", [50, 100_000])
def test_percentiles_equal_sorted_lists(spark, few):
    data = groups()
    rows = [(k, v) for k, values in data.items() for v in values] + [("even", None), ("even", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    levels = {"a": 0.0, "b": 0.5, "c": 0.9, "d": 1.0}
    found = {r.key: r for r in O.percentiles(df, levels, nearest=True, few=few).collect()}
    between = {r.key: r for r in O.percentiles(df, levels, few=few).collect()}
    assert found.keys() == data.keys() == between.keys()
    for k, values in data.items():
        ordered = sorted(values)
        assert found[k].n == len(values)
        for name, level in levels.items():
            assert found[k][name] == ordered[round(level * (len(values) - 1))]
            if k not in ("ends", "wide", "crowded"):  # whose differences overflow or vanish
                assert math.isclose(between[k][name], float(np.quantile(ordered, level)), rel_tol=1e-12, abs_tol=1e-12)


def test_nothing_and_ranks_outside(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], SCHEMA)
    wanted = spark.createDataFrame([("a", -1), ("a", 1), ("a", 1), ("a", 2), ("b", 0)], "key string, rank long")
    assert [tuple(r) for r in O.values_at(df, wanted).collect()] == [("a", 1, 2.0)]
    assert O.percentiles(df.limit(0), {"p": 0.5}).count() == 0
