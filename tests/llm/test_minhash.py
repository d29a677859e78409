import random
import re

import numpy as np
import pytest
from conftest_data import ODD

from panelwright.llm import minhash
from panelwright.llm.shingles import shingle_hashes, word_hashes


def brute(texts, words, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    return sorted((ids[i], len(sets[i]), find(ids[i]), find(ids[i]) == ids[i]) for i in range(len(texts)))


def edited(rng, base, share):
    return " ".join(f"new{rng.random()}" if rng.random() < share else w for w in base)


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for n in (3, 5, 6, 7, 12, 40, 60, 64, 70, 81, 150, 400):
        base = rng.choices(vocabulary, k=n)
        texts += [edited(rng, base, s) for s in (0, 0, 0.01, 0.02, 0.04, 0.06, 0.1)] + [" ".join(base[: n * 9 // 10]), " ".join(base[: n * 8 // 10]).upper()]
    passage = rng.choices(vocabulary, k=60)
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.randint(5, 90))) for _ in range(60)]
    large = rng.choices(vocabulary, k=90)
    texts += [edited(rng, large, rng.choice([0.01, 0.03, 0.05])) for _ in range(80)]
    return texts


@pytest.mark.parametrize(("words", "block"), [(2, 64), (5, 64), (2, 9)])
def test_equals_all_pairs(spark, make_docs, sample, words, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = ODD + corpus(random.Random(words)) + [x["text"] for x in sample[:80]]
    rng = random.Random(1)
    rng.shuffle(texts)
    docs = spark.read.parquet(make_docs(texts) + "/documents.parquet")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs, words).collect())
    assert got == brute(texts, words)


def test_large_sets_near_the_threshold(spark, make_docs):
    """Hundreds of sets of 100 to 900 shingles, in pairs at 0.80 to 0.83: parts of each other, and edited ones; values of all frequencies."""
    rng = random.Random(11)
    texts = []
    for k in range(120):
        n = rng.randint(100, 900)
        words = [f"w{rng.randint(0, 400) if rng.random() < 0.5 else rng.randint(0, 10**6)}" for _ in range(n)]
        share = rng.uniform(0.80, 0.83)
        if k % 2:
            other = words[: int(n * share) + 1]
        else:  # each changed word costs two shingles
            changed = set(rng.sample(range(n), int(n * (1 - share) / (1 + share) / 2)))
            other = [f"new{k}-{i}" if i in changed else w for i, w in enumerate(words)]
        texts += [" ".join(words), " ".join(other)]
    docs = spark.read.parquet(make_docs(texts) + "/documents.parquet")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs, 2).collect())
    want = brute(texts, 2)
    assert got == want and sum(not r[3] for r in want) > 80


def test_query_and_stage(spark, make_docs, sample):
    texts = [x["text"] for x in sample]
    folder = make_docs(texts)
    assert sorted(tuple(r) for r in minhash.op4_minhash_dedup(spark, folder).collect()) == brute(texts, 2)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stay = minhash.dedup_stage(spark, docs, folder)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == [r[0] for r in brute(texts, 5) if r[3]]


def test_repeated_and_null_ids_and_empty_table(spark):
    a, b, c = "one two three four", "five six seven eight", "nine ten eleven twelve"
    rows = [(3, a), (3, a), (1, b), (3, b), (None, a), (None, None), (7, c), (8, None)]
    got = sorted(map(str, (tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())))
    assert got == sorted(map(str, [(3, 3, 1, False), (3, 3, 1, False), (1, 3, 1, True), (3, 3, 1, False), (None, 3, None, True), (None, 0, None, True), (7, 3, 7, True), (8, 0, 8, True)]))
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("long", [1024, 8])
def test_other_documents_do_not_hide_a_pair(spark, long, monkeypatch):
    """Shared values are parted by unshared ones in the order of rarity, because of how often other documents hold them: pairs at 0.80 and 0.86 are found all the same."""
    monkeypatch.setattr(minhash, "LONG", long)
    rows, common = [], " ".join(f"c{i}" for i in range(9))  # so frequent that the other documents are listed under what they share with the texts
    for first, keep in ((1, 80), (1001, 86)):
        for trial in range(10_000):  # texts with enough values in one sketch only
            words = [f"s{first}x{trial}y{i}" for i in range(101)]
            order = np.argsort(shingle_hashes(next(word_hashes([" ".join(words)])), 2).view(np.int64)).tolist()
            whole, part = order[:64], [i for i in order if i < keep][:64]
            shared, only, other = [i for i in whole if i in part], [i for i in whole if i not in part], [i for i in part if i not in whole]
            if min(len(only), len(other)) >= 12:
                break
        rows += [(first, " ".join(words)), (first + 1, " ".join(words[: keep + 1]))]
        # From rare to frequent: a shared value, one of the first text, a shared value, one of the second, and so on.
        ranked = [x for i, v in enumerate(shared) for x in ((v, (only, other)[i % 2][i // 2]) if i < 24 else (v,))]
        for often, i in enumerate(ranked, 1):
            rows += [(5000 + len(rows) + n, f"{words[i]} {words[i + 1]} z{len(rows)}-{n} {common}") for n in range(often)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got[1] == got[2] == 1 and got[1001] == got[1002] == 1001


def test_forest_spans_each_list():
    """Two lists of one crowd of different labels: every member is reached in each, by one edge less than there are members; equal labels do not meet."""
    n = 40
    rep, key = np.tile(np.arange(n), 2), np.repeat([1, 2], n)
    ones = np.ones(2 * n, np.int64)
    bits = np.zeros((2 * n, 8), np.uint64)
    args = (ones * 100, ones * 64, ones * 32, ones * 2, bits, 80)
    assert len(minhash.forest(key, rep, rep, *args)) == 2 * (n - 1)
    assert minhash.forest(key, rep, ones, *args) == []
    bits[5] = bits[n + 5] = np.uint64(2**64 - 1)  # 512 places apart
    assert {5} & {x for e in minhash.forest(key, rep, rep, *args) for x in e} == set()
