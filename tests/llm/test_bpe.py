import hashlib
import struct

import public_tokenizers
from conftest_data import ODD

from panelwright.llm import bpe


def brute(text):
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_equals_the_library(spark, make_docs, sample):
    texts = ODD + [x["text"] for x in sample[:60]]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op1_byte_bpe(spark, make_docs(texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_cutting_at_safe_boundaries_changes_no_id(sample):
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in [t for t in ODD if t] + [x["text"] for x in sample[:30]] + ["a  \n  b 12ab'll c  ", "x1" * 500, "it's 4's" * 300, "这是一个句子。还有一个，" * 90, "don't.'s,'ll-x 'S ''re" * 60]:
        for most in (1, 7, 100):
            assert bpe.unpack(bpe.pack(text, enc, most), enc, 5) == text.encode()
            assert bpe.pack(text, enc, most) == bpe.pack(text, enc, 1 << 30)


def test_empty_table_and_other_columns(spark):
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = spark.createDataFrame([("a b", 1, "old")], "text string, doc_id long, ids string")
    coded = bpe.encode(rows, *args)
    assert coded.columns == ["doc_id", "ids"] and bpe.decode(coded, *args).first().decoded == b"a b"
    assert bpe.encode(rows.limit(0), *args).count() == 0


def test_texts_without_blanks_are_cut(sample):
    text = "这是一个句子。还有一个，" * 500
    parts = list(bpe.pieces(text, 100))
    assert "".join(parts) == text and max(map(len, parts)) <= 110
