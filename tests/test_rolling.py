"""Rolling beta, paths and quantiles against plain Python."""

import math
import random

import numpy as np
import pytest

from panelwright.operators import rolling as R
from panelwright.operators.quantiles import exact_quantiles


def plain_beta(pairs, rows, least):
    out = []
    for i in range(len(pairs)):
        window = pairs[max(0, i - rows + 1) : i + 1]
        both = [(y, x) for y, x in window if y is not None and x is not None]
        xs = [x for _, x in window if x is not None]
        if len(both) < max(least, 2) or len(xs) < max(least, 2) or not np.var(xs):
            out.append(None)
            continue
        out.append(float(np.cov(np.array(both).T)[0, 1] / np.var(xs, ddof=1)))
    return out


@pytest.mark.parametrize(("level", "rows", "least"), [(0.0, 60, 5), (1e7, 60, 20), (1e7, 1, 1), (0.0, 500, 2)])
def test_rolling_beta_at_any_level(spark, level, rows, least):
    rng = random.Random(5)
    series = {}
    for e in ("a", "b"):
        x = [level + rng.gauss(0, 1) for _ in range(400)]
        y = [1.3 * v + rng.gauss(0, 0.1) for v in x]
        series[e] = [(None if rng.random() < 0.05 else v, None if rng.random() < 0.05 else u) for v, u in zip(y, x, strict=True)]
    data = [(e, i, *p) for e, s in series.items() for i, p in enumerate(s)]
    df = spark.createDataFrame(data, "e string, t int, y double, x double").repartition(3)
    got = {(r.e, r.t): r.b for r in R.rolling_beta(df, "y", "x", "e", "t", rows, least, "b").collect()}
    for e, s in series.items():
        for t, want in enumerate(plain_beta(s, rows, least)):
            assert (got[e, t] is None) == (want is None) and (want is None or math.isclose(got[e, t], want, rel_tol=1e-6))


def test_a_nan_leaves_with_its_window(spark):
    data = [("a", i, float(2 * i % 7), float("nan") if i == 9 else math.inf if i == 30 else float(i % 7)) for i in range(60)]
    got = {r.t: r.b for r in R.rolling_beta(spark.createDataFrame(data, "e string, t int, y double, x double"), "y", "x", "e", "t", 8, 4, "b").collect()}
    bad = {t for t, b in got.items() if b is not None and not math.isfinite(b)}
    assert bad == {*range(9, 17), *range(30, 38)} and all(b is not None for t, b in got.items() if t >= 3)


def path(spark, values):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "s string, t int, v double").selectExpr("s", "date_add(date'2020-01-01', t * 30) as t", "v")


def test_metrics_of_returns_hold_the_first_one(spark):
    (m,) = R.path_metrics(path(spark, [-0.5, 0.1, 0.1]), ["s"], "t", "v", per_year=12.0).collect()
    assert math.isclose(m.total, 0.5 * 1.1 * 1.1 - 1) and m.years == 0.25 and m.max_dd == 0 and math.isclose(m.cagr, 0.605**4 - 1)
    (m,) = R.path_metrics(path(spark, [0.1, -0.2, None, 0.05]), ["s"], "t", "v", per_year=12.0).collect()
    assert math.isclose(m.total, 1.1 * 0.8 * 1.05 - 1) and m.years == 0.25 and math.isclose(m.max_dd, -0.2)


def test_metrics_of_an_equity_path(spark):
    (m,) = R.path_metrics(path(spark, [50.0, 25.0, 100.0]), ["s"], "t", "v", of="equity").collect()
    assert m.total == 1 and math.isclose(m.years, 60 / 365.25) and m.max_dd == -0.5
    assert math.isclose(m.sharpe, np.mean([-0.5, 3]) / np.std([-0.5, 3], ddof=1) * 252**0.5) and m.sortino == 0


def test_a_loss_of_everything_stays(spark):
    rows = path(spark, [0.1, -1.0, 0.1, 0.2])
    assert [round(r.v, 9) for r in rows.select("t", R.cumulated("v", "s", "t").alias("v")).orderBy("t").collect()] == [1.1, 0, 0, 0]
    (m,) = R.path_metrics(rows, ["s"], "t", "v", per_year=12.0).collect()
    assert m.total == -1 and m.cagr == -1 and m.max_dd == -1 and m.calmar == -1


@pytest.mark.parametrize(("bins", "rows"), [(4, 3), (1024, 10_000)])
def test_exact_quantiles(spark, bins, rows):
    """Values within one percent, ties, negative and huge ones, NULL keys, one value, none; equal to linear interpolation."""
    rng = random.Random(bins)
    groups = {
        "close": [100 + rng.random() for _ in range(700)], "ties": [float(rng.randint(0, 3)) for _ in range(200)], None: [rng.gauss(0, 1) * 10 ** rng.randint(-8, 8) for _ in range(300)],
        "one": [7.0], "two": [1.0, 2.0], "same": [5.0] * 50, "small": [1e-9 * rng.random() for _ in range(100)],
    }
    data = [(k, v) for k, vs in groups.items() for v in [*vs, None]] + [("none", None)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, v double")
    shares = {"least": 0.0, "p05": 0.05, "q1": 0.25, "p50": 0.5, "p95": 0.95, "most": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", shares, bins, rows).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, p in shares.items():
            assert math.isclose(got[k][name], float(np.quantile(vs, p)), rel_tol=1e-12, abs_tol=1e-300), (k, name)
    every = [v for vs in groups.values() for v in vs]
    (all_rows,) = exact_quantiles(df, [], "v", {"m": 0.5}, bins, rows).collect()
    assert math.isclose(all_rows.m, float(np.quantile(every, 0.5)), rel_tol=1e-12)
    (none,) = exact_quantiles(df.limit(0), [], "v", {"m": 0.5}, bins, rows).collect()
    assert none.m is None


def test_exact_quantiles_of_values_made_anew(spark):
    """Values whose last digits depend on when they are computed, as sums of doubles do on a cluster."""
    from time import time_ns

    from pyspark.sql import functions as F

    shaken = F.udf(lambda x: x * (1 + 1e-16 * (time_ns() % 9973)), "double").asNondeterministic()
    df = spark.createDataFrame([(k, 1000 + (i * 37) % 101 / 1e4) for k in range(6) for i in range(101)], "k int, x double").select("k", shaken("x").alias("v"))
    got = exact_quantiles(df, ["k"], "v", {"low": 0.05, "mid": 0.5, "high": 0.955}).collect()
    assert [tuple(round(x, 6) for x in r[1:]) for r in got] == [(1000.0005, 1000.005, 1000.00955)] * 6
