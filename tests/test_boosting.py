import math
import random

import pytest
from pyspark.ml.linalg import Vectors

from panelwright.operators import boosting as B
from panelwright.operators import models as M


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(8)
    data = [(float(rng.random() < 0.3 + 0.4 * (x > 0.5)), x, rng.random(), None if rng.random() < 0.1 else y) for x, y in ((rng.random(), rng.random()) for _ in range(160))]
    rows = spark.createDataFrame(data, "label double, a double, b double, c double")
    return rows, M.fit_fold(rows, ["a", "b", "c"], "label", trees=12, depth=3)


def test_every_prefix_as_in_a_plain_loop(fitted):
    """AUC by counting pairs, margins from each tree's own predict()."""
    rows, model = fitted
    held = [(r.label, Vectors.dense(r.a, r.b, r.c or 0.0)) for r in rows.collect()]
    booster, margins, want = model.stages[-1], [0.0] * len(held), []
    for tree, weight in zip(booster.trees, booster.treeWeights, strict=True):
        margins = [m + weight * tree.predict(x) for m, (_, x) in zip(margins, held, strict=True)]
        up, down = ([m for m, (label, _) in zip(margins, held, strict=True) if label == y] for y in (1.0, 0.0))
        want.append(sum((round(p, 12) > round(n, 12)) + (round(p, 12) == round(n, 12)) / 2 for p in up for n in down) / (len(up) * len(down)))
    got = sorted((r["round"], r.auc) for r in B.staged_auc(model, rows, "label", ["a", "b", "c"]).collect())
    assert [n for n, _ in got] == list(range(1, len(want) + 1))
    assert all(math.isclose(a, w, abs_tol=2e-3) for (_, a), w in zip(got, want, strict=True))
    assert B.rounds_kept(got, 3) == plain_kept([a for _, a in got], 3)


def plain_kept(values, patience):
    best, at = values[0], 0
    for i, v in enumerate(values):
        if v > best:
            best, at = v, i
        elif i - at >= patience:
            break
    return at + 1


def test_rounds_kept():
    assert B.rounds_kept([(1, 0.5), (2, 0.6), (3, 0.6), (4, 0.6), (5, 0.9)], 2) == 2
    assert B.rounds_kept([(1, 0.5), (2, 0.6), (3, 0.6), (4, 0.7)], 2) == 4
    assert B.rounds_kept([(1, None), (2, None)]) == 2 and B.rounds_kept([]) == 0


def test_all_rounds_score_as_the_model_does(fitted):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    rows, model = fitted
    key = ["a", "b"]
    own = model.transform(rows.fillna(0.0, ["c"])).select(*key, F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
    ours = B.contributions(model, rows, ["a", "b", "c"]).select(*key, B.prefix_score(12).alias("q"))
    both = own.join(ours, key).collect()
    assert len(both) == 160 and all(math.isclose(r.p, r.q, rel_tol=1e-9) for r in both)
