import hashlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq

import corpus_pipeline
from pyspark.sql import functions as F
from panelwright.llm.bpe import encoding

from test_decontaminate import brute as contaminated
from test_linededup import brute as line_cut
from test_minhash import brute as groups
from panelwright.llm import linededup as ld


def test_stages_in_turn_against_brute_force(spark, make_docs, sample):
    texts, langs = [x["text"] for x in sample], [x["lang"] for x in sample]
    items = [x["text"] for x in pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()]
    texts += ["12345 67890", "", "intro words before " + items[0] + " and after", texts[0], texts[1] + "\none more line of words to keep here"]
    langs += [None] * 5
    folder = make_docs(texts, langs, benchmark={"item_id": list(range(len(items))), "text": items})
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, folder)
        if name == "byte_bpe":
            out.write.parquet(f"{folder}/{name}")
            rows = spark.read.parquet(f"{folder}/{name}").collect()
            break
        assert out.columns == columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert len(texts) - 5 not in kept[name] and len(texts) - 4 not in kept[name] and len(kept[name]) >= len(texts) - 6
        ids = sorted(before)
        plain = [before[i] for i in ids]
        if name == "line_dedup":
            gone = {ids[k]: n for k, _, n, _ in line_cut(plain)}
            assert {i for i in ids if i not in kept[name]} == {i for i in ids if gone[i] and not "\n".join(kept[name].get(i, "")).strip()} and gone[len(texts) - 2]
            digests = {ids[k]: d for k, _, _, d in line_cut(plain)}
            assert all(hashlib.sha256((t or "").encode()).hexdigest() == digests[i] for i, t in kept[name].items())
        if name == "near_dedup":
            assert sorted(kept[name]) == [r[0] for r in groups(plain, 5, ids) if r[3]]
        if name == "decontamination":
            hit = {ids[i] for i, _ in contaminated(plain, items)}
            assert set(kept[name]) == set(ids) - hit and len(texts) - 3 in hit
    enc = encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: enc.encode_ordinary(t or "") for i, t in kept["decontamination"].items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in rows)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in whole) == sorted((r.doc_id, r.n_tokens) for r in rows)
    assert ld.WORDS == 5


def test_odd_tables(spark, make_docs, sample):
    """NULL and repeated ids and rows, empty texts, an empty table; a table of just the columns that stages read."""
    texts, langs = [x["text"] for x in sample[:60]], [x["lang"] for x in sample[:60]]
    items = {"item_id": [1], "text": [sample[70]["text"] or "some words of a benchmark item here"]}
    ids = [None, None, *range(2, 58), 57, 57]
    folder = make_docs([*texts, None, "", texts[5]], [*langs, None, "en", None], [*ids, 900, 901, 902], benchmark=items)
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = [r.doc_id for r in rows]
    assert all(r.round_trip for r in rows) and set(kept) <= {*ids, 902} and 900 not in kept and 901 not in kept and 902 not in kept
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for part in (docs.limit(0), docs.select("doc_id", "text", "lang")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, part, folder)
            assert name == "byte_bpe" or out.columns == part.columns
            part = spark.createDataFrame(out.collect(), out.schema)


def test_columns_of_any_name_pass_through(spark, make_docs, sample):
    """Names that stages use themselves, names with dots, in each stage."""
    items = {"item_id": [1], "text": [sample[3]["text"]]}
    folder = make_docs([x["text"] for x in sample[:25]], [x["lang"] for x in sample[:25]], benchmark=items)
    names = ["_hit_id", "_hit_text", "_text_sha256", "row", "digest", "a.b", "_", "rep", "label", "cell", "component"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", "decoded", "kept")
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(f"{i}"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        left = [c for c in docs.columns if c != "text"]
        assert [c for c in out.columns if c in left] == left
        rows = out.collect()
        assert rows and all([r[c] for c in names] == [str(i) for i in range(len(names))] and r["decoded"] == 7 for r in rows), name
