import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest_data import ODD

from panelwright.llm import resample


def features(text, most):
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 1000 for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, most, percent, least):
    ours, theirs = Counter(), Counter()
    for _, text in rows:
        ours.update(features(text, most)[1])
    for text in target:
        theirs.update(features(text, most)[1])
    s, t = sum(ours.values()), sum(theirs.values())
    out = []
    for doc_id, text in rows:
        words, own = features(text, most)
        weight = sum(math.floor(1000 * math.log((theirs[b] + 1) * (s + 1000) / ((ours[b] + 1) * (t + 1000)))) for b in own)
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for rank, x in enumerate(able[: len(able) * percent // 100], 1):
        x[5] = rank
    return sorted(map(str, out))


@pytest.mark.parametrize("most", [1, 2, 4])
def test_equals_plain_counts(spark, make_docs, sample, most):
    line = "one Two\x00three\n\n ÉCOLE été x_y\n"
    texts = ODD + [line * 3, line + "z", "a\nb\nc\nd", "a\n\n\nb c", "A" * 50 + "\n" + "b " * 400] + [x["text"] for x in sample[:60]] + [None, "", line * 3]
    ids = [None if i % 9 == 4 else i - 5 for i in range(len(texts) - 1)] + [17]
    rows = list(zip(ids, texts, strict=True)) + [(17, line * 3)] * 4
    target = [x["text"] for x in sample[60:70]] + [None, "", line]
    docs = spark.read.parquet(make_docs([t for _, t in rows], ids=[i for i, _ in rows]) + "/documents.parquet")
    docs = docs.selectExpr("*", "'x' as line1", "1 as text1", "2 as rows", "3 as `a.b`", "4 as weight")
    found = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), most, 1000, 40, 7, 5)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in found.collect()) == brute(rows, target, most, 40, 5)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0 and resample.resample(none, some).count() == 0
    found = resample.resample(some, none, percent=50, least_words=1).collect()
    assert sorted((r.doc_id, r.n_features) for r in found) == [(1, 2), (2, 1)] and [r.rank for r in found if r.rank] == [1]


def test_query(spark, make_docs, sample):
    folder = make_docs([x["text"] for x in sample], benchmark={"item_id": [1, 2], "text": [sample[3]["text"], None]})
    found = resample.op11_importance_resampling(spark, folder).collect()
    able = sum(len(features(x["text"], 1)[0]) >= 20 for x in sample)
    assert len(found) == len(sample) and sorted(r["rank"] for r in found if r["rank"]) == list(range(1, able * 10 // 100 + 1))
