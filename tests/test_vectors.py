import numpy as np

from panelwright.operators.vectors import nearest


def test_nearest_in_blocks(spark):
    """Against all cosines in plain numpy: several blocks of queries, ties, NULL and zero vectors, queries that are rows."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(120, 5)).round(1)
    vectors[10], vectors[11], vectors[12] = vectors[9], vectors[9], 0
    rows = [(i, None if i == 13 else [float(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind int").repartition(5)
    asked = table.where("vec_id % 7 = 2 or vec_id in (12, 13)").selectExpr("vec_id as q", "embedding as qe")
    for most in (1 << 20, 300):
        got = {}
        for r in nearest(table, asked, 4, ["kind"], most).collect():
            got.setdefault((r.q, r.kind), []).append((-round(r.sim, 9), r.vec_id))
        known = [i for i in range(120) if i not in (12, 13)]
        unit = {i: vectors[i] / np.linalg.norm(vectors[i]) for i in known}
        for q in (i for i in known if i % 7 == 2):
            for kind in range(3):
                best = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in known if i % 3 == kind and i != q)[:4]
                assert sorted(got[q, kind]) == best
        assert not any(q in (12, 13) for q, _ in got)
    assert nearest(table, asked.limit(0), 4, ["kind"]).count() == 0 and nearest(table.limit(0), asked, 4, ["kind"]).count() == 0


def test_unit_makes_the_size_once_for_a_row(spark, capsys):
    from pyspark.sql import functions as F

    from panelwright.operators.vectors import unit

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(unit(F.col("v"))).collect()] == [[0.6, 0.8], None, None]
    df.select(unit(F.col("v"))).explain(True)
    # Not SQRT inside the lambda that divides each element.
    assert "/ SQRT" not in capsys.readouterr().out
