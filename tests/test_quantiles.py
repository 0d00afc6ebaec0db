"""Exact quantiles in bounded memory against a sort of all values."""

import random

import numpy as np
import pytest

from tracklake.operators import profiles as P
from tracklake.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("few", [1, 1_000_000])
def test_exact_quantiles(spark, few):
    rng = random.Random(few)
    kinds = {
        "even": [rng.uniform(-5, 5) for _ in range(4000)], "ties": [float(rng.choice([0, 0, 0, 0, 1, 2])) for _ in range(3000)], "wide": [10.0 ** rng.randint(-30, 30) * rng.choice([-1, 1]) for _ in range(2500)],
        "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 500, None: [float(i) for i in range(1000)],
    }
    rows = [(k, x) for k, values in kinds.items() for x in values] + [("even", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, v double").repartition(5)
    shares = [0.0, 0.01, 0.37, 0.5, 0.98, 1.0]
    got = {r.key: [r[f"q{i}"] for i in range(len(shares))] for r in exact_quantiles(df, ["key"], shares, few).collect()}
    assert set(got) == set(kinds)
    for k, values in kinds.items():
        np.testing.assert_allclose(got[k], np.quantile(values, shares), rtol=1e-12)


def test_colour_limits_of_all(spark):
    m = spark.createDataFrame([(r, r % 2, r, 0, [float(r), None]) for r in range(100)], "row_id long, group_id int, ord long, sample int, bins array<float>")
    row = P.colour_limits(m, "all").collect()
    assert len(row) == 1 and row[0].asDict() == {"zmin": pytest.approx(0.99), "zmax": pytest.approx(97.02)}
