import re
import zlib

import numpy as np
from conftest_data import ODD

from panelwright.llm import langid


def plain_grams(text):
    """(2-grams, 3-grams) of a text in plain Python."""
    letters = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    line = re.sub(" +", " ", letters)
    return [line[i : i + 2] for i in range(len(line) - 1)], [line[i : i + 3] for i in range(len(line) - 2)]


def plain_model(texts, langs, dims):
    """Bits and weights as langid.fit's, from plain counts of hashed grams."""
    names = sorted({x for x in langs if x is not None})
    counts = {x: np.zeros(2 * dims) for x in names}
    for t, lang in zip(texts, langs, strict=True):
        if t is not None and lang is not None:
            for i, gs in enumerate(plain_grams(t)):
                for g in gs:
                    counts[lang][hashed(g, dims) + i * dims] += 1
    share = {x: np.concatenate([(h + 0.5) / (h + 0.5).sum() for h in (counts[x][:dims], counts[x][dims:])]) for x in names}
    code = langid.codewords(len(names))
    bits = []
    for b in range(code.shape[1]):
        yes = sum(share[x] for i, x in enumerate(names) if code[i, b] > 0) / (code[:, b] > 0).sum()
        no = sum(share[x] for i, x in enumerate(names) if code[i, b] < 0) / (code[:, b] < 0).sum()
        weight = np.float32(np.log(yes / no)).astype(float)
        bits.append((weight, ((yes - no) * np.log(yes / no)).sum() / 2))
    mean = sum(apart for _, apart in bits) / len(bits)
    return names, code, [(w, apart / mean) for w, apart in bits]


def hashed(gram, dims):
    value = ord(gram[0]) * 2**21 + ord(gram[1])
    if len(gram) == 3:
        value = (value * 0x2545F4914F6CDD1D + ord(gram[2])) % 2**64
    return (value * 0x9E3779B97F4A7C15 % 2**64 >> 40) % dims


def plain_prediction(text, model, dims):
    names, code, bits = model
    two, three = plain_grams(text)
    grams = [hashed(g, dims) for g in two] + [hashed(g, dims) + dims for g in three]
    if not any(c.isalpha() for c in (text or "").lower()):
        return "und", 0.0
    scale = min(len(grams), 200) / len(grams)
    loss = []
    for c in range(len(names)):
        loss.append(sum(w2 * np.logaddexp(0, -code[c, b] * scale * sum(w[g] for g in grams)) for b, (w, w2) in enumerate(bits)))
    likely = np.exp(-(np.array(loss) - min(loss)))
    return names[int(np.argmin(loss))], float(likely.max() / likely.sum())


def test_query_equals_plain_decoding(spark, make_docs, sample):
    texts, langs = ODD + ["a", "é", "Z9"] + [x["text"] for x in sample[:60]], [None] * (len(ODD) + 3) + [x["lang"] for x in sample[:60]]
    rows = {r.doc_id: r for r in langid.op6_language_id(spark, make_docs(texts, langs)).collect()}
    learned = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 0]
    model = plain_model([texts[i] for i in learned], [langs[i] for i in learned], langid.DIMS)
    for i, t in enumerate(texts):
        lang, score = plain_prediction(t, model, langid.DIMS)
        assert rows[i].lang_pred == lang and abs(rows[i].score - score) < 1e-3, (i, t)


def test_clashing_names_pass(spark):
    rows = spark.createDataFrame([(1, "a text", "x", 1, 2)], "doc_id long, text string, lang_pred string, score int, _found int")
    found = langid.predict(rows, langid.fit(spark.createDataFrame([(1, "a text", "x"), (2, "otro", "y")], "doc_id long, text string, lang string")))
    assert found.columns == ["doc_id", "text", "_found", "lang_pred", "score", "ambiguous", "second"] and found.count() == 1
    docs = spark.createDataFrame([(1, "plain words here", "x", 7), (2, "otro texto mas", "y", 7), (3, "12", None, 7)], "doc_id long, text string, lang string, row int")
    assert langid.language_stage(spark, docs, "").columns == docs.columns


def test_grams_of_a_batch_are_those_of_each_text(sample):
    texts = [x["text"] for x in sample[:40]] + ODD + ["a", "İ", "b"]
    assert len(langid.grams(["a"], 1024)[0]) == 3
    found, owner = langid.grams(texts, 1024)
    for i, t in enumerate(texts):
        alone, _ = langid.grams([t], 1024)
        assert sorted(found[owner == i]) == sorted(alone)


def test_codes_keep_apart():
    for n in (2, 4, 7, 12, 40):
        code = langid.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert code.shape[0] == n and apart[~np.eye(n, dtype=bool)].min() >= 1 and (n in (2,) or apart[~np.eye(n, dtype=bool)].min() >= 2)


def test_query(spark, make_docs, sample):
    texts, langs = ODD + [x["text"] for x in sample], [None] * len(ODD) + [x["lang"] for x in sample]
    rows = {r.doc_id: r for r in langid.op6_language_id(spark, make_docs(texts, langs)).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows.values())
    assert [rows[i].lang_pred for i in range(4)] == ["und"] * 4
    held = [i for i in rows if rows[i].held_out and langs[i]]
    assert np.mean([rows[i].lang_pred == langs[i] for i in held]) > 0.9


def test_nothing_to_learn_from(spark, make_docs):
    rows = langid.op6_language_id(spark, make_docs(["a b", None])).collect()
    assert [r.lang_pred for r in rows] == ["und", "und"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.predict(empty, langid.fit(empty)).count() == 0
