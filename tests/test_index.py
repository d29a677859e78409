import numpy as np
import pytest

from panelwright.operators import index as I


@pytest.mark.parametrize(("rows", "queries", "cells"), [(20_000, 5_000, 16), (7, 3, 5), (20_000, 5_000, 1)])
def test_equals_a_full_scan_and_leaves_cells_out(spark, monkeypatch, rows, queries, cells):
    """Clusters, ties, NULL and zero vectors, queries that are rows and one that is not; parts of cells and blocks of queries."""
    monkeypatch.setattr(I, "ROWS", rows)
    monkeypatch.setattr(I, "QUERIES", queries)
    rng = np.random.default_rng(cells)
    middles = rng.normal(size=(8, 6)) * 3
    vectors = (middles[rng.integers(0, 8, 400)] + rng.normal(size=(400, 6)) * 0.2).round(2)
    vectors[10], vectors[11], vectors[12] = vectors[9], vectors[9] * 2, 0
    table = spark.createDataFrame([(i, None if i == 13 else v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, cell string").repartition(3)
    asked = table.where("vec_id % 9 = 1 or vec_id in (12, 13)").selectExpr("vec_id as q", "embedding as qe").union(spark.createDataFrame([(9000, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])], "q long, qe array<double>"))
    best, scanned = I.VectorIndex(table, cells, 100).nearest(asked, 5)
    got = {}
    for r in best.collect():
        got.setdefault(r.q, []).append((-round(r.sim, 9), r.vec_id))
    known = [i for i in range(400) if i not in (12, 13)]
    unit = {i: vectors[i] / np.linalg.norm(vectors[i]) for i in known} | {9000: np.array([1.0, 0, 0, 0, 0, 0])}
    wanted = {q: sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in known if i != q)[:5] for q in [i for i in known if i % 9 == 1] + [9000]}
    assert {q: sorted(x) for q, x in got.items()} == wanted
    share = sum(r.scanned for r in scanned.collect()) / (len(wanted) * len(known))
    assert share < 0.6 if cells == 16 else share <= 1


def test_few_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    asked = rows.selectExpr("vec_id as q", "embedding as qe")
    assert {tuple(r) for r in I.VectorIndex(rows).nearest(asked, 5)[0].collect()} == {(1, 2, 0.0), (2, 1, 0.0)}
    assert I.VectorIndex(rows).nearest(asked.limit(0), 5)[0].count() == 0
    assert I.VectorIndex(rows.limit(0)).nearest(asked, 5)[0].count() == 0
