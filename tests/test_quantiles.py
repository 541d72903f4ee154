"""Percentiles by selection against sorting, also where values are repeated or hardly fit a sketch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import quantiles as Q

POINTS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]


@pytest.mark.parametrize("held", [20_000, 60])
def test_equal_to_sorting(spark, monkeypatch, held):
    monkeypatch.setattr(Q, "HELD", held)
    rng = random.Random(held)
    columns = {
        "spread": [rng.lognormvariate(0, 3) for _ in range(3000)],
        "tied": [rng.choice([0.0] * 20 + [1.5, 2.5, 2.5, -7.0, rng.random()]) for _ in range(3000)],
        "same": [4.25] * 3000,
    }
    rows = [tuple(float(columns[c][i]) for c in columns) for i in range(3000)] + [(None, float("nan"), None)] * 5
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(6)
    for c, values in columns.items():
        got = Q.exact_percentiles(df, c, POINTS)
        assert got == pytest.approx(list(np.quantile(np.array(values), POINTS)), rel=1e-12, abs=1e-12)


def test_few_values_and_texts(spark):
    df = spark.createDataFrame([("3",), ("x",), (None,), ("1.5",)], "v string")
    assert Q.exact_percentiles(df, "v", [0.0, 0.5, 1.0]) == [1.5, 2.25, 3.0]
    assert Q.exact_percentiles(df.filter("v = 'x'"), "v", [0.5]) == [None]
    assert Q.exact_percentiles(spark.range(1).select(F.col("id").alias("v")), "v", [0.3]) == [0.0]
