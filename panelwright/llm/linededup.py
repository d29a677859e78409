"""Line deduplication by pairwise alignment (operator 8).

A line is cut if any earlier document aligns with it in a block of `words` words or more. Such a block contains one of the
line's runs, neighbouring lines that reach `words` words going forward or backward from it, so only earlier documents
that hold an open run need to be aligned: a run is open while one of its lines is uncut. Round by round open runs lead to
further holders: to their first one, then to about `GROWTH` others, then to `GROWTH` times as many in each round. A run
that its first holders cut never meets the rest, and what stays uncut has met them all.

Two documents are aligned by patience diff over their line hashes: common heads and tails, then the longest increasing
chain of lines that occur once in both, then the same between its links. Blocks
of aligned lines, neighbours in both documents, are deleted from the later document if they hold `words` words or more.

A document comes later if its (doc_id, text hash) is greater. Lines are split at line feeds and compared without blanks
at their ends; blank lines are no anchors but may lie within a block.

Defined results: NULL and empty texts have no lines to delete and stay as they are; rows equal in id and text are one
document and are treated alike; rows with a NULL doc_id are neither aligned nor changed; a document may lose all its
lines, its text is then empty; an empty table gives an empty table; other columns pass through, whatever their names. The
stage renews `n_chars` where there is such a column.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import small_batches, stored, table

WORDS = 5
GROWTH = 16


def split_lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def line_hashes(text: str | None) -> tuple[list[int], list[int]]:
    """Hash and number of words of each line; blank lines have hash 0."""
    hashes, words = [], []
    for line in split_lines(text):
        stripped = line.strip()
        hashes.append(int.from_bytes(hashlib.blake2b(stripped.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if stripped else 0)
        words.append(len(stripped.split()))
    return hashes, words


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, in the order of their first places, whose second places increase."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect.bisect_left(tops, b)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[k], at[k] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of equal lines by patience diff, increasing in both."""
    found: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        many_a, many_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: i for i, x in enumerate(b[b0:b1], b0) if x and many_b[x] == 1}
        links = chain([(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if x in where and many_a[x] == 1])
        at, bt = a0, b0
        for i, j in links:
            found.append((i, j))
            open_.append((at, i, bt, j))
            at, bt = i + 1, j + 1
        if links:
            open_.append((at, a1, bt, b1))
    return sorted(found)


def common_blocks(later: list[int], earlier: list[int], words: list[int], least: int = WORDS) -> list[int]:
    """Places in `later` of aligned blocks with `least` words or more."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*align(later, earlier), (-9, -9)]:
        if (i - 1, j - 1) != last:
            if sum(words[x] for x in block) >= least:
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


def runs(lines: list[int], words: list[int], least: int = WORDS) -> list[tuple[int, int]]:
    """Places (first, last) of each run: for each line the shortest one of `least` words forward, and the same backward."""
    out: list[tuple[int, int]] = []
    n, end, total = len(lines), 0, 0
    for i in range(n):  # forward: total is the sum of words[i:end]
        while end < n and total < least:
            total += words[end]
            end += 1
        if total < least:
            break
        out.append((i, end - 1))
        total -= words[i]
    start, total = n - 1, 0
    for i in range(n - 1, -1, -1):  # backward: total is the sum of words[start + 1 : i + 1]
        while start >= 0 and total < least:
            total += words[start]
            start -= 1
        if total < least:
            break
        out.append((start + 1, i))
        total -= words[i]
    return list(dict.fromkeys(out))


def run_key(lines: list[int], a: int, b: int) -> int:
    if a == b:
        return lines[a]
    return int.from_bytes(hashlib.blake2b(np.asarray(lines[a : b + 1], "<i8").tobytes(), digest_size=8).digest(), "little", signed=True)


def open_runs(lines: list[int], words: list[int], gone: set[int], least: int = WORDS) -> list[int]:
    """Distinct keys of the runs of which a line is not gone."""
    return list({run_key(lines, a, b) for a, b in runs(lines, words, least) if not gone or any(i not in gone for i in range(a, b + 1))})


def shared_lines(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """(_id, _hash, gone): the lines that each later document loses."""
    small_batches(docs.sparkSession)
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), "text")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[a : a + 1000] for b in batches for a in range(0, len(b), 1000)):
            found = [line_hashes(t) for t in batch["text"]]
            keys = [open_runs(x, n, set(), least) for x, n in found]
            yield pd.DataFrame({"_id": batch["_id"], "_hash": batch["_hash"], "lines": [x for x, _ in found], "words": [x for _, x in found], "keys": keys})

    lines = stored(rows.mapInPandas(hashed, "_id long, _hash long, lines array<long>, words array<int>, keys array<long>"))
    # Once each and stored: the joins below are plain shuffles of it, so that a document many others meet can be split over tasks.
    if not lines.groupBy("_id", "_hash").count().where("count > 1").isEmpty():
        lines = stored(lines.dropDuplicates(["_id", "_hash"]))
    doc = F.struct("_id", "_hash").alias("doc")
    each = lines.select(doc, F.explode("keys").alias("key"))
    # Stored, so that both sides of the join are plain shuffles and a frequent run's rows can be split over tasks.
    firsts = stored(each.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last"))
    later = lines.select(doc, F.col("lines").alias("new"), "words")
    earlier = lines.select(doc.alias("first"), F.col("lines").alias("old"))

    @F.pandas_udf("array<int>")
    def gone(new: pd.Series, old: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([common_blocks(np.asarray(a).tolist(), np.asarray(b).tolist(), np.asarray(w).tolist(), least) for a, b, w in zip(new, old, words, strict=True)])

    @F.pandas_udf("array<long>")
    def still(new: pd.Series, words: pd.Series, keys: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for a, w, k, g in zip(new, words, keys, gone, strict=True):
            left = set(open_runs(np.asarray(a).tolist(), np.asarray(w).tolist(), set(np.asarray(g).tolist()) if g is not None else set(), least))
            out.append([x for x in np.asarray(k).tolist() if x in left])
        return pd.Series(out)

    def cut_by(pairs: DataFrame) -> DataFrame:
        aligned = pairs.join(later, "doc").join(earlier, "first").select("doc", gone("new", "old", "words").alias("gone"))
        aligned = aligned.where(F.size("gone") > 0).select("doc", F.explode("gone").alias("line"))
        return aligned.groupBy("doc").agg(F.collect_set("line").alias("gone"))

    asked = each.join(firsts.select("key", "first", "n"), "key").where("doc > first")
    total = stored(cut_by(asked.select("doc", "first").distinct()))
    # Runs whose only earlier holder is the first one are settled: n counts it and the document itself.
    asked = stored(asked.where("n > 2").groupBy("doc").agg(F.collect_set("key").alias("keys")))

    def narrowed(asked: DataFrame, total: DataFrame) -> DataFrame:
        state = asked.join(later, "doc").join(total, "doc", "left")
        return stored(state.select("doc", still("new", "words", "keys", "gone").alias("keys")).where(F.size("keys") > 0))

    asked = narrowed(asked, total)
    if asked.isEmpty():
        return total.select("doc.*", "gone")
    wanted = asked.select(F.explode("keys").alias("key")).distinct()
    few = firsts.join(wanted, "key", "left_semi").select("key", F.col("first").alias("least"), "n")
    draw = F.pmod(F.xxhash64("doc", F.lit("share")), F.lit(2**40))
    # A run's holders in an order of chance: `turn` says in which round they are met, the first GROWTH ones, then GROWTH times as many.
    turn = F.greatest(F.lit(1), F.ceil(F.log(draw / 2**40 * F.col("n") + 1e-9) / math.log(GROWTH))).cast("int")
    holders = stored(each.join(few, "key").where("doc > least").select("key", F.col("doc").alias("first"), turn.alias("turn")).distinct())
    last = holders.agg(F.max("turn")).first()[0] or 0
    for now in range(1, last + 1):
        here = holders.where(F.col("turn") == now).drop("turn")
        pairs = asked.select("doc", F.explode("keys").alias("key")).join(here, "key").where("first < doc").select("doc", "first").distinct()
        total = stored(total.unionByName(cut_by(pairs)).select("doc", F.explode("gone").alias("line")).groupBy("doc").agg(F.collect_set("line").alias("gone")))
        if now == last:
            break
        asked = narrowed(asked, total)
        if asked.isEmpty():
            break
    return total.select("doc.*", "gone")


def without_shared_lines(docs: DataFrame, least: int = WORDS, names: tuple[str, str] = ("n_lines", "n_gone")) -> DataFrame:
    """docs with what later documents share cut from `text`; n_lines and n_gone are added and replace columns of those names."""
    gone = shared_lines(docs, least).toDF("_ld_id", "_ld_hash", "_ld_gone")

    @F.pandas_udf("text string, n_lines int, n_gone int")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, gone, strict=True):
            lines, lost = split_lines(text), set(np.asarray(found).tolist()) if found is not None else set()
            out.append(("\n".join(x for i, x in enumerate(lines) if i not in lost) if lost else text, len(lines), len(lost)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_gone"])

    others = [c for c in docs.columns if c != "text" and c not in names]
    kept = [F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(others)]
    keyed = docs.select(*kept, F.col("text").alias("_text"), F.col("doc_id").cast("long").alias("_ld_doc"), F.xxhash64("text").alias("_ld_same"))
    same = (F.col("_ld_doc") == F.col("_ld_id")) & (F.col("_ld_same") == F.col("_ld_hash"))
    done = keyed.join(gone, same, "left").withColumn("_cut", cut("_text", "_ld_gone"))
    named = {c: F.col(f"_kept_{i}").alias(c) for i, c in enumerate(others)} | {"text": F.col("_cut.text").alias("text")}
    return done.select(*(named[c] for c in docs.columns if c not in names), *(F.col(f"_cut.{n}").alias(new) for n, new in zip(("n_lines", "n_gone"), names, strict=True)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_gone").cast("long").alias("n_gone"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they share with earlier ones; those of which nothing but blanks is left go."""
    count, lost = (next(n for n in (f"_{x}" + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns) for x in ("lines", "lost"))
    done = without_shared_lines(docs, names=(count, lost))
    left = done.where((F.col(lost) == 0) | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
