import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest_data import ODD

from panelwright.llm import periodic


def plain_runs(words, least):
    """Every period by itself: stretches in which words p apart are identical."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def edited(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 or not words:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute(doc_id, text):
    words = edited(doc_id, re.findall("[^\x20\x09-\x0d]+", text or ""))
    found = plain_runs(words, 12)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    exponent = 1000 * best[1] // best[2] if found else None
    return [doc_id, len(found), *best, exponent, digest("".join(f"{s},{n},{p}\n" for s, n, p in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone))]


def test_cover():
    assert {(x - y) % periodic.MODULUS for x in periodic.COVER for y in periodic.COVER} == set(range(periodic.MODULUS))


@pytest.mark.parametrize("places", [1 << 15, 5])
def test_equals_all_periods(places, monkeypatch):
    monkeypatch.setattr(periodic, "PLACES", places)
    rng = random.Random(places)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(0, 6)):
            n, kinds = rng.choice([0, 1, 5, 12, 30, 100, 300]), rng.choice([1, 2, 3, 50])
            t = [rng.randrange(kinds) for _ in range(n)]
            a, p = rng.randrange(n + 1), rng.randint(1, 60)
            texts.append(t[:a] + [t[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(a, n)] if rng.random() < 0.6 else t)
        least = rng.choice([2, 4, 12])
        got = periodic.find_runs([np.array(t, np.int64) for t in texts], least)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t, least) for t in texts]


def test_long_texts():
    """More words than a grid's first table and than its parts, random ones between a repeated passage."""
    rng = np.random.default_rng(2)
    noise, passage = rng.integers(0, 1 << 40, 30_000), rng.integers(0, 1 << 40, 7_000)
    (found,) = periodic.find_runs([np.concatenate([noise, np.tile(passage, 4)[:25_000], noise[:9_000], np.tile(noise[:3], 9)])])
    assert found.tolist() == [[30_000, 25_000, 7_000], [64_000, 27, 3]]
    assert periodic.find_runs([np.zeros(300_000, np.int64)])[0].tolist() == [[0, 300_000, 1]]


def test_copies_that_begin_alike_behind_other_texts():
    """Copies whose first words, as many as a block, begin at places of the cover, behind texts without a far question."""
    copy = np.tile(np.arange(50), 4)
    for last in range(periodic.MODULUS):
        found = periodic.find_runs([copy, np.arange(511), copy, np.arange(last)])
        assert [f.tolist() for f in found] == [[[0, 200, 50]], [], [[0, 200, 50]], []]


def test_query_equals_brute_force(spark, make_docs, sample):
    texts = [t[:3000] if t else t for t in ODD] + ["a b " * 6, "a b a b a b a b a b a", "A a " * 8, " ".join("xyzzy" * 40), "no run here", None] + [x["text"] for x in sample[:150]]
    ids = [None if i % 17 == 3 else i * 7 - 40 for i in range(len(texts))]
    texts += [texts[-1]] * 2
    ids += [ids[-1]] * 2
    folder = make_docs(texts, ids=ids)
    got = periodic.op13_periodic_runs(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [brute(i, t) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(str, map(list, got.collect()))) == sorted(map(str, want)) and sum(w[1] > 0 for w in want) > 10


def test_operator_gives_runs_and_text_and_takes_any_columns(spark):
    rows = [(1, "x " + "b c d " * 5 + "y", 5, 6), (None, None, 5, 6), (2, "one two three", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long, `a.b` long")
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()}
    assert got == {1: (17, [(1, 15, 3)], "x b c d y"), None: (0, [], ""), 2: (1, [], "one two three")}
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
