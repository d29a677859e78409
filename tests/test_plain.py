"""Queries that SQL cannot express, held against plain Python on the given tables."""

import html
import math
import os
import re
import zlib

import pyarrow.parquet as pq
import pytest

from panelwright.operators import text as X
from panelwright.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}


def run(spark, name):
    return catalog.queries()[name](spark, FOLDER).collect()


def test_html_text(spark):
    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{FOLDER}/pages.parquet").to_pylist()}
    got = {r.page_id: r.text for r in run(spark, "tx1_html_text")}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        plain = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>", "<>", re.sub(r"(?s)<!--.*?-->", "<>", page))
        parts = [html.unescape(x).strip() for x in re.split(r"<[^<>]*>", plain)]
        assert re.sub(r"\s+", " ", got[i]).strip() == re.sub(r"\s+", " ", "\n".join(x for x in parts if x)).strip(), i


def strip(text):
    return re.sub(r"^\s+|\s+$", "", text, flags=re.A)


def tidy(lines):
    return strip(re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(lines))))


def test_reports_without_boilerplate(spark, docs):
    got = {r.doc_id: r.clean for r in run(spark, "tx2_clean_report")}
    assert got.keys() == docs.keys()
    for i, d in docs.items():
        lines = [strip(x) for x in (d["text"] or "").split("\n")]
        for pattern in X.BOILERPLATE:
            lines = [re.sub(pattern, "", x, flags=re.A) for x in lines]
        total, seen, over, kept = sum(map(len, lines)), 0, False, []
        for x in lines:
            over = over or (any(m.lower() in x.lower() for m in X.LEGAL) and seen > total * 0.7)
            seen += len(x)
            if not (over and x):
                kept.append(x)
        cut = tidy(kept)
        assert got[i] == (tidy(lines) if len(cut.split()) < 100 and len(lines) > 20 else cut), i


def windows(words, size, step, least):
    return [(at, " ".join(words[at : at + size])) for at in range(0, max(0, len(words) - least + 1), step)]


def test_sections(spark, docs):
    want = set()
    for i, d in docs.items():
        text = d["text"]
        if i % 2 == 0 and text is not None:
            text = f"Item 1. Business {text}\nItem 7. Management's discussion {text}"
        found = []
        for name, pattern in X.SECTIONS.items():
            found += [(m.start(), name) for m in re.finditer(pattern, text or "", re.I | re.A)]
        found.sort()
        bodies = {}
        for (a, name), (b, _) in zip(found, [*found, (len(text or ""), None)][1:], strict=True):
            if len(text[a:b].split()) >= 50:
                bodies[name] = text[a:b]
        for name, body in bodies.items() if bodies else [(None, text)]:
            want |= {(i, name, k, at, len(part)) for k, (at, part) in enumerate(windows((body or "").split(), 1000, 800, 40))}
    assert {tuple(r) for r in run(spark, "tx5_sections")} == want


def test_packed_paragraphs(spark, docs):
    want = set()
    for i, d in docs.items():
        paragraphs = [p.split() for p in re.split(r"\n\s*\n", (d["text"] or "").replace("\n", "\n\n"), flags=re.A)]
        texts = [strip(p) for p in re.split(r"\n\s*\n", (d["text"] or "").replace("\n", "\n\n"), flags=re.A)]
        done, held = [], []
        for words, text in zip(paragraphs, texts, strict=True):
            if len(words) < 5:
                continue
            if held and sum(n for n, _ in held) + len(words) > 120:
                done.append(held)
                held = held[-1:]
            held = [*held, (len(words), text)]
        want |= {(i, k, " ".join(t for _, t in pack)) for k, pack in enumerate([*done, held] if held else done)}
    assert {tuple(r) for r in run(spark, "tx6_packed_paragraphs")} == want


def test_embeddings(spark, docs):
    for r in run(spark, "tx12_embeddings"):
        words, v = (docs[r.doc_id]["text"] or "").lower().split(), [0.0] * 256
        for w in set(words):
            for k in range(3):
                h = zlib.crc32(f"{k} {w}".encode())
                v[h % 256] += math.log(1 + words.count(w)) * (1 if h >= 2**31 else -1)
        size = math.sqrt(sum(x * x for x in v))
        assert (r.first is None) if size == 0 else (r.dims == 256 and abs(r.first - v[0] / size) < 1e-5)


def test_models_of_folds(spark):
    rows = run(spark, "ml3_boosted_trees")
    months = sorted({r.test_month for r in rows})
    folds = sorted((r.fold, r.test_month) for r in run(spark, "ml1_folds"))
    assert months == [m for f, m in folds if f % 12 == 1] and len(rows) == 2 * len(months)
    for m in months:
        assert abs(sum(r.importance for r in rows if r.test_month == m) - 1) < 1e-5 and all(1 <= r.trees <= 20 for r in rows if r.test_month == m)


def test_frozen_model(spark):
    got = run(spark, "ml4b_frozen_scores")
    folds = sorted((r.fold, r.test_month) for r in run(spark, "ml1_folds"))
    rows = run(spark, "ml6_labelled_dataset")
    assert {(r.entity, r.month) for r in got} == {(r.entity, r.month) for r in rows if r.month >= folds[0][1] and r.ret is not None} or {r.month for r in got} == {r.month for r in rows if r.month >= folds[0][1]}
    assert all(0 <= r.score <= 1 for r in got)
