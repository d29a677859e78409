import hashlib
import re

from conftest_data import ODD
from pyspark.sql import functions as F

from panelwright.llm import fingerprint as fp


def test_edits_order_and_equality(spark, make_docs, sample):
    texts = ODD + [x["text"] for x in sample]
    got = {r.doc_id: r for r in fp.op2_multiset_fingerprint(spark, make_docs(texts)).collect()}
    assert len(got) == len(texts)
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        after, half = plain[i - 1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    as_set = lambda t: tuple(sorted(re.split(r"(?<=[.!?\n])", t)))
    assert len({(as_set(t), got[i].fingerprint) for i, t in enumerate(plain)}) == len({as_set(t) for t in plain}) == len({r.fingerprint for r in got.values()})
    long = [r for i, r in got.items() if len(re.split(r"(?<=[.!?\n])", plain[i])) > 20 and i > len(ODD)]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_sums_are_homomorphic(spark):
    rows = spark.createDataFrame([("One. Two! Three?", "Two!", "One. Three?", "Three? One. Two!")], "a string, b string, c string, d string")
    rows = spark.createDataFrame([("One.Two!Three?", "Two!", "One.Three?", "Three?One.Two!")], "a string, b string, c string, d string")
    # Each text of k paragraphs that ends in a terminator also has the empty paragraph after it.
    f = {c: fp.fingerprint(F.col(c)) for c in "abcd"}
    empty = fp.fingerprint(F.lit(""))
    r = rows.select(f["a"].alias("a"), f["d"].alias("d"), fp.combine(fp.combine(f["c"], f["b"]), empty, -1).alias("in"), fp.combine(fp.combine(f["a"], f["b"], -1), empty).alias("out"), f["c"].alias("c")).first()
    assert r.a == r.d == r["in"] and r.out == r.c


def test_next_document_over_ranges(spark):
    ids = [5, -3, 100, 2**40, 8, 9, 10, 11, None, 55, 56, 57, 58, 59, 60, 61, 62]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    for n in ("1", "3", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.text: r.next_text for r in fp.with_next(rows).collect()}
        down = sorted(ids, key=lambda i: -(2**63) if i is None else i, reverse=True)
        assert got == {f"t{a}": f"t{b}" for a, b in zip(down, down[1:] + down[:1], strict=True)}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert fp.with_next(rows.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id long, text string")
    pairs = sorted((r.text, r.next_text) for r in fp.with_next(one).collect())
    assert pairs == [("a", "a"), ("a", "b"), ("b", "a")]


def test_rows_of_one_id_make_one_ring(spark):
    """Repeated and NULL ids fall into many ranges; each text is the next of just one row, and prints go with texts."""
    many = [(None if i % 3 else 7, f"text {i}.") for i in range(300)]
    rows = spark.createDataFrame(many, "doc_id long, text string")
    got = fp.with_next(rows).collect()
    assert sorted(r.text for r in got) == sorted(r.next_text for r in got) == sorted(t for _, t in many)
    prints = {r.text: r["print"] for r in got}
    assert all(r.next_print == prints[r.next_text] for r in got)
    following, at, seen = {r.text: r.next_text for r in got}, got[0].text, 0
    while True:
        at, seen = following[at], seen + 1
        if at == got[0].text:
            break
    assert seen == len(many)


def test_counters_of_many_paragraphs(spark):
    rows = spark.createDataFrame([("".join(f"a{i}." for i in range(80_000)), "".join(f"b{i}." for i in range(80_000)), "\n" * 70_000)], "a string, b string, c string")
    f = {c: fp.fingerprint(F.col(c)) for c in "abc"}
    joined = fp.fingerprint(F.concat("a", "c"))
    prints = rows.select(*(f[c].alias(c) for c in "abc"), joined.alias("j"))
    near = {f"{x}{y}": fp.likeness(fp.counters(F.col(x)), fp.counters(F.col(y))) for x, y in ("aa", "ab", "aj")}
    r = prints.select("*", fp.combine(F.col("a"), F.col("c")).alias("in"), fp.combine(F.col("j"), F.col("c"), -1).alias("out"), fp.fingerprint(F.lit("")).alias("e"), *(v.alias(k) for k, v in near.items())).first()
    assert r.aa == 1 and r.ab < 0.4 and r.aj < 0.4
    # The joined text has one empty paragraph less than its parts.
    whole = [(x - y) % 2**64 for x, y in zip(r["in"], r.e, strict=True)]
    assert whole == [x % 2**64 for x in r.j]
    assert [(x - y) % 2**64 for x, y in zip(r.out, r.a, strict=True)] == [-y % 2**64 for y in r.e]
