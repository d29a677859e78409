"""Forecasters that fail, and resamples, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import models as M


def test_rows_that_a_forecaster_fails_on_are_null(spark):
    def failing():
        def model(contexts):
            if any(c[0] == 7 for c in contexts):
                raise RuntimeError("no forecast for 7")
            return [float("nan") if c[0] == 5 else c[-1] / c[0] - 1 for c in contexts]

        return model

    rows = [(i, None if i == 3 else [float(i), 2.0 * i]) for i in range(1, 40)] + [(77, [7.0, 1.0])]
    got = {r.i: r.f for r in M.forecast(spark.createDataFrame(rows, "i int, c array<double>").coalesce(1), "c", failing, "f").collect()}
    assert {i for i, f in got.items() if f is None} == {3, 5, 7, 77} and all(f == 1 for i, f in got.items() if f is not None)
    short = M.forecast(spark.createDataFrame(rows[:2], "i int, c array<double>"), "c", lambda: lambda contexts: [1.0, 2.0, 3.0], "f")
    assert [r.f for r in short.collect()] == [None, None]


def plain_ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.mark.parametrize("at_once", [3, 50])
def test_rank_correlation_of_draws(spark, at_once):
    """Each draw again with its rows copied; several rows share an index, some indices have none, values tie."""
    rng = np.random.default_rng(4)
    data = [(int(i), float(a), float(a + e)) for i, a, e in zip(rng.integers(0, 30, 200), rng.integers(0, 25, 200), rng.integers(0, 12, 200), strict=True) if i != 4]
    pairs = spark.createDataFrame([*data, (2, None, 1.0)], "i int, a double, b double").repartition(5)
    times = {}
    for r in M.resampled(spark, 30, 4, 7, 3).collect():
        times.setdefault(r.draw, {})[r["index"]] = r.times
    assert all(sum(t.values()) == 30 for t in times.values()) and len(times) == 7
    got = {r.draw: r.correlation for r in M.bootstrapped_rank_correlation(pairs, "i", "a", "b", 30, 4, 7, 3, at_once).collect()}
    for draw, own in times.items():
        copied = np.array([(a, b) for i, a, b in data for _ in range(own.get(i, 0))])
        assert math.isclose(got[draw], np.corrcoef(plain_ranks(copied[:, 0]), plain_ranks(copied[:, 1]))[0, 1], rel_tol=1e-9)


def test_block_bootstrap_weighs_known_values(spark):
    series = spark.createDataFrame([(i, None if i == 2 else float(i * i)) for i in range(9)], "i int, v double")
    times = M.resampled(spark, 9, 4, 5).groupBy("draw").agg(F.map_from_entries(F.collect_list(F.struct("index", "times"))).alias("t"))
    want = {r.draw: sum(n * i * i for i, n in r.t.items() if i != 2) / sum(n for i, n in r.t.items() if i != 2) for r in times.collect()}
    got = {r.draw: r["mean"] for r in M.block_bootstrap(series, "i", "v", 9, 4, 5).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d]) for d in want)


def test_ranks_are_told_from_parts_of_bounded_size(spark, monkeypatch):
    """However few partitions Spark would make, no group in Python holds more than about RANKED_ROWS rows."""
    real, taken = M.saved, []
    monkeypatch.setattr(M, "RANKED_ROWS", 100)
    monkeypatch.setattr(M, "saved", lambda df: (taken.append(df.rdd.getNumPartitions()), real(df))[1])
    rows = spark.range(1000).select(F.col("id").alias("_row"), (F.col("id") * 1.5).alias("x"), F.array(F.lit(1)).alias("_w"))
    ranks, _ = M._weighted_ranks(rows, "x", 1)
    assert taken[0] == 11 and sorted(r[0] for r in ranks.select(F.get("_rank", F.lit(0))).collect()) == [i - 499.5 for i in range(1000)]
