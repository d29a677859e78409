import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from conftest_data import ODD

from panelwright.llm import toxicity as tx


def slow_segments(scores):
    """Ruzzo and Tompa's definition by recursion: the best segment, then the best on either side of it."""
    if not scores:
        return []
    sums = np.concatenate([[0], np.cumsum(scores)])
    best = max(((round(sums[j] - sums[i], 9), -(j - i), -i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[2], best[3]
    return slow_segments(scores[:i]) + [(best[0], i, j - 1)] + [(s, a + j, b + j) for s, a, b in slow_segments(scores[j:])]


def test_segments_are_all_maximal_ones():
    rng = random.Random(2)
    for _ in range(200):
        raw = [rng.choice([0, 0, 0, 0, 1.0, 2.3, 4.1, -1.7]) * (1 + rng.random() / 9) for _ in range(rng.randint(0, 25))]
        at = [i for i, s in enumerate(raw) if s]
        gaps = [b - a - 1 for a, b in zip([-1, *at], at, strict=False)]
        got = [(round(s, 9), at[i], at[j]) for s, i, j in tx.segments([raw[i] for i in at], gaps)]
        want = slow_segments([s - tx.DRIFT for s in raw])
        assert sorted(s for s, _, _ in got) == sorted(s for s, _, _ in want)


def test_segments_take_linear_time():
    for n in (20_000, 200_000):
        began = time.perf_counter()
        assert len(tx.segments([3.0] * n, [20] * n)) == n  # each stands apart
        assert len(tx.segments([3.0] * n, [0] * n)) == 1
        # Segments that begin lower and lower and are merged by a last one.
        assert tx.segments([*([1.0] * n), 1e9], [*([9] * n), 0])[-1][0] > 1e8
        assert time.perf_counter() - began < n * 1e-5


def plain_scores(texts, labels):
    """The whole model and all scores in plain Python, from texts by id and labels by id."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    learn = {i: y for i, y in labels.items() if i in texts and zlib.crc32(str(i).encode()) % 3 != 1}
    counts = {0: Counter(), 1: Counter()}
    for i, y in learn.items():
        for w in words(texts[i]):
            counts[y][w] += 1
            if len(w) > 4:
                counts[y][w[:4] + "."] += 1
    total = {y: sum(n for w, n in counts[y].items() if not w.endswith(".")) for y in (0, 1)}
    prior, weight = 0.1 * (total[0] + total[1]), {}
    for w in counts[0].keys() | counts[1].keys():
        y0, y1 = counts[0][w], counts[1][w]
        a = (y0 + y1) / (total[0] + total[1]) * prior
        odds = [math.log((y + a) / max(total[k] + prior - y - a, 1.0)) for k, y in ((0, y0), (1, y1))]
        delta = odds[1] - odds[0]
        if abs(delta) / math.sqrt(1 / (y1 + a) + 1 / (y0 + a)) >= 2.5 and y0 + y1 >= 4 and (not w.endswith(".") or y1 >= 9 * y0):
            weight[w] = delta
    found = {i: [b for b, _, _ in slow_segments([weight.get(w, weight.get(w[:4] + ".", 0.0) if len(w) > 4 else 0.0) - 0.5 for w in words(t)])] for i, t in texts.items()}
    size = {i: max(len(words(t)), 1) for i, t in texts.items()}
    clean = [i for i, y in learn.items() if y == 0]
    top = np.array([max(found[i], default=0.0) for i in clean])
    lam = math.pi / (math.sqrt(6) * max(top.std(), 0.25))
    k = math.exp(np.mean(lam * top - np.log([size[i] for i in clean])) - 0.5772156649)
    x = {i: math.log1p(sum(max(0.0, lam * s - math.log(k * size[i])) for s in found[i])) for i in texts}
    a, b = tx.curve(np.array([x[i] for i in learn]), np.array([learn[i] for i in learn], float))
    return {i: 1 / (1 + math.exp(-a - b * x[i])) for i in texts}


def test_query_equals_plain_scores(spark, make_docs):
    rng = random.Random(12)
    some = lambda n, w: " ".join(rng.choice(w) for _ in range(n))
    good, bad = [f"good{c}" for c in "abcdefghijklmnop"], ["vile", "rottenly", "nasty", "rottenish"]
    texts = {i: some(rng.randint(0, 30), good) + " " + (some(rng.randint(1, 4), bad) if i % 3 == 0 else "") + " " + some(rng.randint(0, 30), good) for i in range(150)}
    texts |= {150: None, 151: "", 152: " ".join(["vile " + some(9, good)] * 9), 153: texts[3], 154: texts[3]}
    labels = {i: int(i % 3 == 0) for i in range(120)}
    folder = make_docs(list(texts.values()), labels={"doc_id": list(labels), "toxic": list(labels.values()), "quality": [1] * len(labels)})
    got = {r.doc_id: r.score for r in tx.op3_toxic_segments(spark, folder).collect()}
    want = plain_scores(texts, labels)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert got[152] > got[3] and got[153] == got[154] == got[3]


def test_columns_of_the_results_names_are_replaced(spark):
    rows = spark.createDataFrame([(1, "a b", 9, 9), (1, "a b", 9, 9)], "doc_id long, text string, score int, _found int")
    model = {"weights": {"a": 3.0}, "lambda": 1.0, "k": 0.1, "curve": [0.0, 1.0]}
    found = tx.score(rows, model, ["doc_id", "score", "_found"])
    assert found.columns == ["doc_id", "_found", "score", "n_passages", "passages"] and len({r.score for r in found.collect()}) == 1


def auc(y, x):
    order = np.argsort(np.argsort(x))
    return (order[y == 1].sum() + (y == 1).sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_accuracy_on_given_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in tx.op3_toxic_segments(spark, folder).collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    labels = [(x["doc_id"], x["toxic"]) for x in pq.read_table(f"{folder}/labels.parquet").to_pylist() if rows[x["doc_id"]].held_out]
    y, x = np.array([t for _, t in labels]), np.array([rows[i].score for i, _ in labels])
    assert auc(y, x) > 0.85


def test_odd_texts_and_labels(spark, make_docs):
    rng = random.Random(9)
    clean = lambda: " ".join(f"w{chr(97 + rng.randint(0, 20))}x" for _ in range(40))
    texts = [clean() + (" vile nasty rotten vile " if i % 4 == 0 else " ") + clean() for i in range(240)] + ODD
    folder = make_docs(texts, labels={"doc_id": [*range(240), 0, 999, None], "toxic": [int(i % 4 == 0) for i in range(240)] + [1, 1, 0], "quality": [1] * 243})
    rows = {r.doc_id: r for r in tx.op3_toxic_segments(spark, folder).collect()}
    held = [i for i in range(240) if rows[i].held_out]
    assert all((rows[i].predicted == 1) == (i % 4 == 0) for i in held)
    assert rows[240].score == rows[241].score < 0.5 and rows[240].n_passages == 0
    none = make_docs(texts[:5], labels={"doc_id": [1], "toxic": [0], "quality": [1]})
    assert {r.score for r in tx.op3_toxic_segments(spark, none).collect()} == {0.0}
    docs = spark.read.parquet(f"{none}/documents.parquet").limit(0)
    assert tx.score(docs, None, ["doc_id"]).count() == 0
