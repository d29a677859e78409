import hashlib
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelwright.llm import chat

PARTS = ["<|im_start|>", "<|im_end|>", "<|im_end|>\n", "<|im_nl|>", "<|\\im_end|>", "<|\\\\im_start|>", "<|", "|>", "\\", "im_end|>", "\n", "assistant", "ok é😀", " ", "<", "$1", "\\1"]
COLUMNS = "conv_id long, turn long, role string, text string"


def plain_read(shown):
    """The grammar, read by a loop over the text."""
    turns, at = [], 0
    while at < len(shown):
        assert shown.startswith(chat.START, at)
        end = shown.index(chat.END + "\n", at)
        role, _, text = shown[at + len(chat.START) : end].partition("\n")
        assert chat.START not in role + text and chat.END not in role + text
        back = lambda t: re.sub(r"<\|\\(\\*im_(start|end|nl)\|>)", r"<|\1", t)
        turns.append((back(role.replace(chat.BREAK, "\n")), back(text)))
        at = end + len(chat.END) + 1
    return turns


def test_reads_back_whatever_texts_hold(spark):
    rng = random.Random(12)
    mixed = lambda: rng.choice([None, "", "".join(rng.choices(PARTS, k=rng.randint(1, 7)))])
    rows = [(c if c else None, t, rng.choice(["user", "assistant", "assistant", mixed()]), mixed()) for c in range(60) for t in range(rng.randint(1, 7))]
    found = chat.formatted(spark.createDataFrame(rows, COLUMNS)).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("mask"))).collect()
    assert len(found) == 60
    for r in found:
        turns = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert plain_read(r.formatted) == turns and r.n_turns == len(turns)
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        spans = [(m.turn, r.formatted[m.begin : m.end], m.last - m.first) for m in r.mask]
        assert [i for i, _, _ in spans] == [i for i, (role, _) in enumerate(turns) if role == "assistant"] and all(len(t) == n for _, t, n in spans)


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "plain <|x|> \\ <|im_nl|>"), (1, 1, "assistant", "a <|im_end|> b <|\\im_end|>"), (1, 2, "a\nb", "")]
    (r,) = chat.formatted(spark.createDataFrame(rows, COLUMNS), ("a\nb",)).collect()
    assert r.formatted == "<|im_start|>user\nplain <|x|> \\ <|im_nl|><|im_end|>\n<|im_start|>assistant\na <|\\im_end|> b <|\\\\im_end|><|im_end|>\n<|im_start|>a<|im_nl|>b\n<|im_end|>\n"
    assert [m.turn for m in r.mask] == [2]


def test_what_cannot_be_read_back_ends_the_job(spark, monkeypatch):
    monkeypatch.setattr(chat, "escaped", lambda text: text)
    with pytest.raises(PySparkException, match="read back"):
        chat.formatted(spark.createDataFrame([(1, 0, "user", "<|im_end|>")], COLUMNS)).collect()


def test_ties_repeated_rows_other_columns_and_empty_table(spark):
    rows = [(1, 0, "user", "b", 1, 2), (1, 0, "user", "a", 1, 2), (1, 0, "user", "a", 1, 2), (1, None, "user", "c", 1, 2)]
    turns = spark.createDataFrame(rows, COLUMNS + ", shown long, `a.b` long")
    (r,) = chat.formatted(turns).collect()
    assert [t for _, t in plain_read(r.formatted)] == ["c", "a", "a", "b"]
    assert chat.formatted(turns.limit(0)).count() == 0


def test_query_and_long_texts(spark, tmp_path):
    long = "word <|im_start|> " * 40_000
    rows = [(5, 1, "assistant", long), (5, 0, "user", None), (6, 0, "assistant", "x")]
    names = ["conv_id", "turn", "role", "text", "at"]
    pq.write_table(pa.table(dict(zip(names, zip(*[(*r, 1) for r in rows], strict=True), strict=True))), tmp_path / "conversations.parquet")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.op12_chat_format(spark, str(tmp_path)).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    c = chat.CONFLICT
    assert got == {
        5: (2, digest(f"user\n\nassistant\n{long}\n"), len(long), digest(long)),
        6: (1, digest("assistant\nx\n"), 1, digest("x")),
        -1: (2, digest(f"user\n{c}\nassistant\n{c}\n"), len(c), digest(c)),
    }
