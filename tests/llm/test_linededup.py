import hashlib
import random

from conftest_data import ODD
from pyspark.sql import functions as F

from panelwright.llm import linededup as ld


def plain_align(a, b):
    """Patience diff of two lists of lines by its definition, recursive and with difflib-like plain lists; '' is no anchor."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in plain_align(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return plain_align(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    once = [(i, b.index(x)) for i, x in enumerate(a) if x and a.count(x) == 1 and b.count(x) == 1]
    best = []  # the longest increasing chain by each end; of several, as patience piles give them, the one of the latest link
    for k, (_, j) in enumerate(once):
        before = max((p for p in range(k) if once[p][1] < j), key=lambda p: (len(best[p]), p), default=None)
        best.append([*(best[before] if before is not None else []), once[k]])
    links = max(reversed(best), key=len, default=[])
    out, at, bt = [], 0, 0
    for i, j in [*links, (len(a), len(b))] if links else []:
        out += [(x + at, y + bt) for x, y in plain_align(a[at:i], b[bt:j])]
        if (i, j) != (len(a), len(b)):
            out.append((i, j))
        at, bt = i + 1, j + 1
    return out


def plain_blocks(a, b, least=5):
    """Lines of a in blocks of `least` words that are aligned with b."""
    found, out, block = plain_align(a, b), set(), []
    for k, (i, j) in enumerate(found):
        block = [*block, i] if k and found[k - 1] == (i - 1, j - 1) else [i]
        if sum(len(a[x].split()) for x in block) >= least:
            out |= set(block)
    return out


def brute(texts):
    """Each document against all earlier ones, with none of the module's functions."""
    lines = [[x.strip() for x in t.split("\n")] if t else [] for t in texts]
    out = []
    for i, t in enumerate(texts):
        gone = set()
        for j in range(i):
            if set(lines[i]) & set(lines[j]) - {""}:
                gone |= plain_blocks(lines[i], lines[j])
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t or ""
        out.append((i, len(lines[i]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(rng):
    line = lambda: " ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(1, 12)))
    shared = [line() for _ in range(12)] + ["", "short"]
    base = [line() for _ in range(20)]
    texts = ["\n".join(rng.choice([line(), rng.choice(shared), rng.choice(shared)]) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    return texts + ["\n".join(base), "\n".join(base), "\n".join(base[3:9] + [line()] + base[12:]), "\n".join(base[::-1])]


def test_query_equals_plain_alignment(spark, make_docs, sample):
    texts = ODD + corpus(random.Random(4)) + [x["text"] for x in sample[:100]]
    got = sorted(tuple(r) for r in ld.op8_line_dedup(spark, make_docs(texts)).collect())
    assert got == brute(texts)


def test_first_holders_scattered(spark, make_docs):
    """Copies lose all their lines although each line's first holder is another document."""
    x, y = "three words here and more", "another line of five words"
    texts = [f"{x}\na", f"{y}\nb", f"{x}\n{y}", f"{x}\n{y}", "p q\nr s", "p q\nz\nr s t", "r s\np q", "p q\nr s t\nz"]
    three = ["x one two", "y one two", "x one two\ny one two", "x one two\ny one two"]
    for case in (texts, three):
        got = sorted(tuple(r) for r in ld.op8_line_dedup(spark, make_docs(case)).collect())
        assert got == brute(case) and got[3][2] == 2


def test_patience():
    assert ld.align([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert ld.align([5, 1, 2, 5, 3], [7, 1, 5, 2, 8, 3]) == [(1, 1), (2, 3), (4, 5)]
    assert ld.align([], [1]) == [] and ld.align([0, 0], [0]) == [(0, 0)]
    assert ld.chain([(0, 5), (1, 1), (2, 2), (3, 6), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    assert ld.common_blocks([1, 2, 3], [1, 2, 9], [2, 2, 9]) == [] and ld.common_blocks([1, 2, 3], [1, 2, 9], [2, 3, 9]) == [0, 1]


def test_stage_and_odd_tables(spark, make_docs):
    copy = "one two three four five six\nseven eight nine ten eleven twelve"
    folder = make_docs([copy, copy, copy + "\nand this line is its own", None, "", "x"])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stay = {r.doc_id: (r.text, r.n_chars) for r in ld.line_stage(spark, docs, folder).collect()}
    assert stay == {0: (copy, len(copy)), 2: ("and this line is its own", 24), 3: (None, None), 4: ("", 0), 5: ("x", 1)}
    assert ld.line_stage(spark, docs, folder).columns == docs.columns
    bare = docs.select("doc_id", "text", F.lit(1).alias("_lost"), F.lit(2).alias("_ld_id"), F.lit(3).alias("_cut"), F.lit(4).alias("_kept_0"), F.lit(5).alias("gone"))
    cut = ld.line_stage(spark, bare, folder)
    assert cut.columns == bare.columns and {(r.doc_id, r.text, r[2:]) for r in cut.collect()} == {(i, t, (1, 2, 3, 4, 5)) for i, (t, _) in stay.items()}
    rows = spark.createDataFrame([(1, copy), (1, copy), (None, copy), (0, None)], "doc_id long, text string")
    assert [r.n_gone for r in ld.without_shared_lines(rows).collect()] == [0] * 4
    assert ld.without_shared_lines(rows.limit(0)).count() == 0


def test_all_earlier_holders(spark, make_docs):
    a, b, c = "the first line of five", "the second line of five", "the third line of five"
    # The first holder has the lines in another order, a later one in the same; a line repeats; short lines make a block.
    texts = ["\n".join(x) for x in ([a, b, c], [c, b, a], [c, b, a, "own"], ["x y", "", "z u", c, c], [c, "own", c, "x y", "", "z u", "v"], ["z u", "v", "w w w"])]
    texts += ["\n".join(random.Random(k).sample([a, b, c, "x y", "z u", ""], 4)) for k in range(30)] + corpus(random.Random(8))
    got = sorted(tuple(r) for r in ld.op8_line_dedup(spark, make_docs(texts)).collect())
    assert got == brute(texts) and got[2][2] == 3


def test_runs():
    assert sorted(ld.runs([1, 2, 3], [2, 2, 2], 5)) == [(0, 2)] and ld.runs([1], [4], 5) == [] and ld.runs([], [], 5) == []
    assert sorted(ld.runs([1, 0, 2], [5, 0, 6], 5)) == [(0, 0), (0, 1), (1, 2), (2, 2)]
