"""Text jobs: cleaning, chunking, dictionary scores, batch scoring, embedding, chunk stores."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.scalar import strip

#: Lines that match one of these are boilerplate.
BOILERPLATE = (
    r"(?i)^.*forward[- ]looking\s+statement.*$",
    r"(?i)^.*safe\s+harbor\b.*$",
    r"(?i)^.*this\s+press\s+release\s+contains\s+forward.*$",
    r"(?i)^.*(?:about|contact)\s+(?:the\s+)?company\s*$",
    r"(?i)^.*investor\s+(?:relations|contact).*$",
    r"(?i)###\s*$",
    r"(?i)press\s+release\s*$",
)
#: From one of these on, past 70 % of a text, only legal text follows.
LEGAL = ("This press release contains forward-looking", "Safe Harbor Statement", "Non-GAAP Financial Measures", "Cautionary Statement", "Private Securities Litigation Reform Act")
#: Headings of the sections of a report.
SECTIONS = {
    "business": r"item\s+1[\.\s]+business\b",
    "risk_factors": r"item\s+1a[\.\s]+risk\s+factors",
    "mda": r"item\s+7[\.\s]+management.{0,10}discussion",
    "quantitative_risk": r"item\s+7a[\.\s]+quantitative",
    "financial_statements": r"item\s+8[\.\s]+financial\s+statements",
    "controls": r"item\s+9a[\.\s]+controls",
}


#: Words whose places an encoder remembers.
KNOWN = 100_000


def small_batches(rows: int = 200) -> None:
    """Arrow batches of `rows` rows at most in this session: texts are long, and Python workers keep what a batch took."""
    spark, key = SparkSession.active(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def words(text: Column) -> Column:
    """Words between white space; none for NULL or blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


class _Text(HTMLParser):
    def __init__(self, dropped: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.dropped, self.depth, self.parts = dropped, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.dropped

    def handle_endtag(self, tag):
        self.depth -= tag in self.dropped and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def html_text(html: Column, dropped: tuple[str, ...] = ("script", "style", "head")) -> Column:
    """Text of a page, one line for each piece; NULL stays NULL."""
    gone = frozenset(dropped)
    small_batches()

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        def one(page):
            if page is None:
                return None
            parser = _Text(gone)
            parser.feed(page)
            parser.close()
            return "\n".join(parser.parts)

        return pages.map(one)

    return read(html)


def without_boilerplate(text: Column, least_words: int = 100, after: float = 0.7) -> Column:
    """Boilerplate lines blanked, the rest cut at a legal marker past 70 % of the characters; if under least_words remain of over 20 lines, uncut."""
    lines = F.transform(F.split(text, "\n"), strip)
    for pattern in BOILERPLATE:
        lines = _replaced(lines, pattern)
    legal = lambda x: F.exists(F.array(*(F.lit(m.lower()) for m in LEGAL)), lambda m: F.contains(F.lower(x), m))
    zero = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("at"), F.lit(-1).alias("first"))

    def tidy(parts):
        return strip(F.regexp_replace(F.regexp_replace(F.array_join(parts, "\n"), r"\n{3,}", "\n\n"), r"[ \t]+", " "))

    def first_legal(x, total):
        def step(s, y):
            first = F.when((s["first"] < 0) & (s["seen"] > total * after) & legal(y), s["at"]).otherwise(s["first"])
            return F.struct((s["seen"] + F.length(y)).alias("seen"), (s["at"] + 1).alias("at"), first.alias("first"))

        return F.aggregate(x, zero, step, lambda s: s["first"])

    def of(x):
        total = F.aggregate(x, F.lit(0), lambda s, y: s + F.length(y))
        first = _bound(total, lambda n: first_legal(x, n))
        cut = _bound(first, lambda k: tidy(F.filter(x, lambda y, i: (k < 0) | (i < k) | (y == ""))))
        return _bound(cut, lambda c: F.when((F.size(words(c)) < least_words) & (F.size(x) > 20), tidy(x)).otherwise(c))

    return _bound(lines, of)


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value made once: an expression inside a function over elements is made again for each of them."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _replaced(lines: Column, pattern: str) -> Column:
    return F.transform(lines, lambda x: F.regexp_replace(x, pattern, ""))


def fixed_chunks(text: Column, size: int = 435) -> Column:
    """Runs of `size` words."""
    return windows(text, size, size, 1)


def windows(text: Column, size: int = 1000, step: int = 800, least: int = 40) -> Column:
    """Array of (offset, text) of word windows; it ends before the first window of under `least` words."""
    return _bound(words(text), lambda w: _windows_of(w, size, step, least))


def _windows_of(w: Column, size: int, step: int, least: int) -> Column:
    """windows() of words that are made already: w is used more than once."""
    starts = F.when(F.size(w) >= least, F.sequence(F.lit(0), F.size(w) - least, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("offset"), F.array_join(F.slice(w, i + 1, F.lit(size)), " ").alias("text")))


def _common_start(patterns: list[str]) -> str:
    """Letters that all matches of all patterns begin with, as far as that is plain to see."""
    common = re.match("[A-Za-z]*", os.path.commonprefix(patterns))[0]
    if any("|" in p or p[len(common) :][:1] in ("?", "*", "{") for p in patterns):
        return ""
    return common


def _sections_of(text: Column, patterns: dict[str, str], least: int) -> Column:
    """Array of (section, body, words) of a text: from a heading to the next; of sections of one name the last with `least` words.

    The text is cut once, at all places where a heading begins, and the words of a part are made once. Where two headings begin
    at one place the later pattern's counts. The start that the headings share is looked for first: to try them all at every
    character takes four times as long.
    """
    heading = "|".join(f"(?:{p})" for p in patterns.values())
    parts = F.split(text, f"(?i)(?={_common_start([*patterns.values()])})(?={heading})")

    def name(part):
        return F.coalesce(*(F.when(part.rlike(f"(?i)^(?:{p})"), F.lit(n)) for n, p in reversed(patterns.items())))

    headed = F.filter(F.transform(parts, lambda p: F.struct(name(p).alias("section"), p.alias("body"))), lambda x: x["section"].isNotNull())
    each = F.filter(F.transform(headed, lambda x: F.struct(x["section"], x["body"], words(x["body"]).alias("words"))), lambda x: F.size(x["words"]) >= least)
    last = lambda x, n: F.try_element_at(F.filter(x, lambda y: y["section"] == n), F.lit(-1))
    return _bound(each, lambda x: F.array_compact(F.array(*(last(x, n) for n in patterns))))


def sections(df: DataFrame, key: str, text: str, patterns: dict[str, str] = SECTIONS, least: int = 50) -> DataFrame:
    """(key, section, body) of each row's text: from a heading to the next; of sections of one name the last with `least` words stays."""
    each = df.select(key, F.explode(_sections_of(F.col(text), patterns, least)).alias("x"))
    return each.select(key, "x.section", strip(F.col("x.body")).alias("body"))


def section_chunks(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200, least: int = 40) -> DataFrame:
    """(key, section, chunk, word_offset, text): windows within each section; a text without sections is windowed as a whole, section NULL.

    All is made from a row by itself, so that no text is shuffled.
    """
    whole = F.array(F.struct(F.lit(None).cast("string").alias("section"), words(F.col(text)).alias("words")))
    found = _bound(_sections_of(F.col(text), SECTIONS, 50), lambda x: F.when(F.size(x) > 0, F.transform(x, lambda y: F.struct(y["section"], y["words"]))).otherwise(whole))
    cut = F.transform(found, lambda x: F.struct(x["section"], _windows_of(x["words"], size, size - overlap, least).alias("windows")))
    each = df.select(key, F.explode(cut).alias("x")).select(key, "x.section", F.posexplode("x.windows").alias("chunk", "w"))
    return each.select(key, "section", "chunk", F.col("w.offset").alias("word_offset"), F.col("w.text").alias("text"))


def packed_paragraphs(text: Column, budget: int = 800, least: int = 20) -> Column:
    """Paragraphs of `least` words packed up to a budget of words, each pack beginning with the last paragraph of the one before."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: F.size(words(p)) >= least)
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(s, p):
        n = F.size(words(p))
        full = (s["n"] + n > budget) & (F.size(s["open"]) > 0)
        last = F.slice(s["open"], -1, 1)
        kept = F.when(full, last).otherwise(s["open"])
        held = F.when(full, F.aggregate(last, F.lit(0), lambda a, x: a + F.size(words(x)))).otherwise(s["n"])
        return F.struct(F.when(full, F.array_append(s["done"], F.array_join(s["open"], " "))).otherwise(s["done"]).alias("done"), F.array_append(kept, p).alias("open"), (held + n).alias("n"))

    return F.aggregate(paragraphs, zero, step, lambda s: F.when(F.size(s["open"]) > 0, F.array_append(s["done"], F.array_join(s["open"], " "))).otherwise(s["done"]))


def note_body(text: Column, least: int = 30) -> Column:
    """A note without front matter; NULL under `least` words."""
    body = strip(F.regexp_replace(text, r"(?s)^---\s*\n.*?\n---\s*\n", ""))
    return F.when(F.size(words(body)) >= least, body)


def dehyphenated(text: Column) -> Column:
    """Lines of over 20 characters and blank ones, words broken at a line end joined."""
    kept = F.filter(F.split(text, "\n"), lambda x: (F.length(strip(x)) > 20) | (strip(x) == ""))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"(\w)-\n(\w)", "$1$2"))


def dictionary_counts(df: DataFrame, key: str, text: str, dictionary: DataFrame, categories: list[str]) -> DataFrame:
    """Counts of each category, of all tokens, and net = (positive - negative) / max(tokens, 1); dictionary(word, *categories of 0/1)."""
    tokens = F.regexp_extract_all(F.upper(F.coalesce(F.col(text), F.lit(""))), F.lit("([A-Z']+)"), F.lit(1))
    totals = df.select(key, F.size(tokens).alias("total"), tokens.alias("_t"))
    found = totals.select(key, F.explode("_t").alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("_n")).join(dictionary, "word")
    counts = found.groupBy(key).agg(*(F.sum(F.col("_n") * F.col(c)).alias(c) for c in categories))
    out = totals.drop("_t").join(counts, key, "left").fillna(0, categories)
    return out.withColumn("net", (F.col("positive") - F.col("negative")) / F.greatest("total", F.lit(1)))


def tokens_of(text: str) -> list[str]:
    """The tokens that dictionary_counts() takes."""
    return re.findall(r"[A-Z']+", text.upper())


def dictionary_scorer(values: dict[str, int]) -> Callable[[pd.Series], pd.Series]:
    """A scorer over a dictionary of word values: their sum over the number of tokens, as dictionary_counts() gives it."""

    def one(text: str) -> float:
        found = tokens_of(text)
        return sum(values.get(w, 0) for w in found) / max(len(found), 1)

    return lambda texts: texts.map(one)


def pieces(text: str, most: int) -> list[str]:
    """The text in pieces of `most` characters at most that end behind a blank where there is one; joined they give the text."""
    out, at = [], 0
    while len(text) - at > most:
        end = next((i for i in range(at + most, at, -1) if text[i - 1].isspace()), at + most)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def scored(df: DataFrame, text: str, scorer: Callable[[], Callable[[pd.Series], pd.Series]], name: str = "score", most: int = 10_000, weigh: Callable[[str], list] = str.split) -> DataFrame:
    """Scores of texts by a model that `scorer()` loads once in each worker; empty texts score 0.

    The model takes `most` characters: longer texts are scored in pieces that end at a blank where there is one, and the
    pieces' scores are averaged, weighted by their words (the length of `weigh(piece)`), so that a mean over words comes
    out as on the whole text (a single word longer than `most` counts once for each piece).
    """

    small_batches()

    @F.pandas_udf("double")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = scorer()
        for batch in batches:
            cut = [pieces(t, most) for t in batch.fillna("")]
            plain = pd.Series([x for p in cut for x in p], dtype=object)
            scores = model(plain).astype(float).where(plain.str.strip() != "", 0.0).tolist()
            out, at = [], 0
            for p in cut:
                words = [len(weigh(x)) for x in p] if len(p) > 1 else [1]
                out.append(sum(s * n for s, n in zip(scores[at : at + len(p)], words, strict=True)) / max(sum(words), 1) if len(p) > 1 else scores[at])
                at += len(p)
            yield pd.Series(out, index=batch.index, dtype=float)

    return df.withColumn(name, call(F.col(text)))


def hashed_terms(dims: int = 256, hashes: int = 3) -> Callable[[pd.Series], pd.Series]:
    """Signed hashed term vectors: each word in `hashes` places, so that two words seldom share all of theirs; ln(1 + count) weighs it."""
    import math
    import zlib
    from collections import Counter

    known: dict[str, list[int]] = {}

    def places(word: str) -> list[int]:
        """h % dims, twice: even where the sign is +, odd where it is -."""
        if len(known) >= KNOWN:
            known.clear()
        found = known[word] = [h % dims * 2 + (h < 0x80000000) for h in (zlib.crc32(f"{k} {word}".encode()) for k in range(hashes))]
        return found

    def encode(texts: pd.Series) -> pd.Series:
        def one(text):
            counts = Counter(text.lower().split())
            if not counts:
                return np.zeros(dims)
            at = np.array([known.get(w) or places(w) for w in counts]).ravel()
            weights = np.repeat([math.log1p(n) for n in counts.values()], hashes)
            return np.bincount(at >> 1, np.where(at & 1, -weights, weights), dims)

        return texts.map(one)

    return encode


def embedded(df: DataFrame, text: str, name: str = "embedding", encoder: Callable[[], Callable[[pd.Series], pd.Series]] = hashed_terms) -> DataFrame:
    """Unit vectors of texts by an encoder loaded once in each worker; a text without words is NULL."""
    from panelwright.operators.vectors import unit

    small_batches()

    @F.pandas_udf("array<double>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for batch in batches:
            yield model(batch.fillna(""))

    return df.withColumn(name, call(F.col(text))).withColumn(name, unit(F.col(name)))


def batched_by_length(df: DataFrame, kind: str, text: str) -> DataFrame:
    """Dealt and sorted by (kind, length), so that batches hold texts of like length."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("_len", n).repartitionByRange(kind, "_len").sortWithinPartitions(kind, "_len").drop("_len")


def routed(chunks: DataFrame, source: str, collections: dict[str, str], key: str, default: str = "other") -> DataFrame:
    """Chunks with the collection of their source, one for each id."""
    of = F.create_map(*(x for k, v in collections.items() for x in (F.lit(k), F.lit(v))))
    return chunks.withColumn("collection", F.coalesce(of[F.col(source)], F.lit(default))).dropDuplicates(["collection", key])
