import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest_data import ODD

from panelwright.llm import suffix


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for k, r in enumerate(raw):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((k, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [text(n) for n in (199, 200, 201, 260, 700, 40)]
    texts = [text(rng.randint(0, 500)) + rng.choice(passages) + text(rng.randint(0, 900)) for _ in range(60)]
    base = text(3000)
    texts += [base[:i] + "#" + base[i + 1 :] for i in rng.sample(range(3000), 6)] + ["ab" * 400, "ab" * 150, "z" * 1000, passages[4] * 2, base, base]
    return texts


def test_suffix_order():
    rng = random.Random(3)
    for alphabet, n in ((b"ab", 300), (b"a", 50), (b"abcdefgh", 500), (bytes(range(256)), 800), (b"ab\x00\xff", 200)):
        data = bytes(rng.choice(alphabet) for _ in range(n))
        order = suffix.suffix_order(np.frombuffer(data, np.uint8), n + 8)
        assert order.tolist() == sorted(range(n), key=lambda i: data[i:])
    assert len(suffix.suffix_order(np.zeros(0, np.uint8))) == 0


@pytest.mark.parametrize("many", [1000, 3])
def test_equals_all_strings(spark, make_docs, sample, many, monkeypatch):
    monkeypatch.setattr(suffix, "SORTED", 5000)
    texts = ODD + corpus(random.Random(many)) + [x["text"] for x in sample[:60]]
    docs = spark.read.parquet(make_docs(texts) + "/documents.parquet")
    got = suffix.without_repeats(docs, many=many).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == brute(texts, 200)


def test_query(spark, make_docs, sample):
    texts = [x["text"] for x in sample]
    got = suffix.op10_suffix_dedup(spark, make_docs(texts)).collect()
    assert sorted(map(tuple, got)) == brute(texts, 200)


def test_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcd ") for _ in range(4000))
    rows = [(0, text), (1, text[700:2500] + "x"), (None, None), (0, text)]
    monkeypatch.setattr(suffix, "PART", 1000)
    ends = [suffix.fragments(np.frombuffer(text.encode(), np.uint8), np.array([4000]))]
    assert (ends[0][3] >= ends[0][2]).all() and (ends[0][3] - ends[0][2]).sum() + len(ends[0][2]) == 3801
    got = suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_removed, r.n_spans) for r in got), key=str) == [(0, 4000, 1), (0, 4000, 1), (1, 1800, 1), (None, 0, 0)]
    assert suffix.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
