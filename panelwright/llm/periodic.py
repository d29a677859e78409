"""Detection of periodic runs of words (operator 13).

A run is a longest stretch of words with smallest period q that holds at least two periods (and `LEAST` words). Runs are
enumerated on harmonic grids: a run of period p holds two neighbouring multiples of p, b - p and b, and the words that
follow (or precede) them in common give its end (or start). For n words that is n ln n questions for the longest common
extension of two places. Most end within a few words. The others compare words until both places, equally far on, lie in
a difference cover: a set of residues modulo `MODULUS` whose differences are all residues, so that this takes less than
`MODULUS` steps. Only suffixes at cover places are sorted, by blocks of `MODULUS` words first and then by doubling, and
only in texts with a question that gets so far; common prefixes of neighbours in that order and a sparse table of their
minima answer the rest at once. Periods that are multiples of a run's smallest one give the same stretch and fall away.

Texts are taken together up to about 256,000 characters; a longer one stands alone and takes memory in proportion to its
words times their logarithm. There is no shuffle.

Defined results: a NULL, empty or blank text has no words and no runs; repeated rows and rows with a NULL doc_id are texts
like any other; other columns are not used; an empty table gives an empty table. Words are kept as they are, in any case.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import runs, small_batches, table

LEAST = 12
#: A planar difference set, every residue but 0 is the difference of exactly one pair.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Places of a grid that are asked for at once.
PLACES = 1 << 15
GAP = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


@functools.lru_cache(maxsize=1)
def steps_to_cover() -> np.ndarray:
    """[i, d]: steps until residues i and i + d are both in the cover."""
    held = np.zeros(MODULUS, bool)
    held[list(COVER)] = True
    i, d, t = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    return np.argmax(held[(i + t) % MODULUS] & held[(i + d + t) % MODULUS], axis=2)


class Extensions:
    """Longest common extensions to the right in words that end, text by text, with a mark of their own; place to text is given by `owner`."""

    def __init__(self, words: np.ndarray, owner: np.ndarray) -> None:
        self.size, self.owner = len(words), owner
        self.words = np.concatenate([words, words.max(initial=0) + 1 + np.arange(2 * MODULUS)]).astype(np.uint32)

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in common up to the first place in the cover, and whether the question is still open there."""
        steps = steps_to_cover()[i % MODULUS, (j - i) % MODULUS]
        n, live, t = np.zeros(len(i), np.int64), np.arange(len(i)), 0
        while len(live := live[steps[live] > t]):
            live = live[self.words[i[live] + t] == self.words[j[live] + t]]
            t += 1
            n[live] = t
        # A difference at the place itself, such as a mark, is an answer too.
        return n, (n == steps) & (self.words[i + n] == self.words[j + n])

    def sort(self, wanted: np.ndarray) -> None:
        """Sorts the suffixes at cover places of the texts in `wanted` and prepares minima of common prefixes."""
        place = np.arange(self.size)
        place = place[np.isin(place % MODULUS, COVER) & np.isin(self.owner, wanted)]
        at = np.full(self.size + 1, -1, np.int64)
        at[place] = np.arange(len(place))
        blocks = np.lib.stride_tricks.sliding_window_view(self.words, MODULUS)[place].astype(">u4")
        names = [np.unique(blocks.view(f"V{4 * MODULUS}").reshape(-1), return_inverse=True)[1].astype(np.int64)]
        width, following = MODULUS, []
        while len(place) and names[-1].max() < len(place) - 1:
            following.append(at[np.minimum(place + width, self.size)])
            ahead = np.where(following[-1] < 0, 0, names[-1][following[-1]] + 1)
            names.append(np.unique(names[-1] * (len(place) + 1) + ahead, return_inverse=True)[1])
            width *= 2
        self.at, self.rank = at, names[-1]
        order = np.empty(len(place), np.int64)
        order[self.rank] = np.arange(len(place))
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), np.int64)
        for level in range(len(following) - 1, -1, -1):
            same = (a >= 0) & (b >= 0) & (names[level][a] == names[level][b])
            common += same * (MODULUS << level)
            a, b = np.where(same, following[level][a], a), np.where(same, following[level][b], b)
        # The blocks that differ still have less than MODULUS words in common.
        more = self._direct(np.maximum(place[order[:-1]] + common, 0), np.maximum(place[order[1:]] + common, 0))
        self.least = [(common + more).astype(np.int32)]
        while (1 << len(self.least)) <= len(self.least[0]):
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def _direct(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, live = np.zeros(len(i), np.int64), np.arange(len(i))
        for t in range(MODULUS):
            live = live[self.words[np.minimum(i[live] + t, len(self.words) - 1)] == self.words[np.minimum(j[live] + t, len(self.words) - 1)]]
            n[live] = t + 1
        return n

    def far(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in common from two different places of the cover on."""
        a, b = self.rank[self.at[i]], self.rank[self.at[j]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.least[k][low[m]], self.least[k][high[m] - (1 << int(k))])
        return out


def grid(start: int, end: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(b, p): all multiples b of each period p up to `most`, start <= b < end and b >= p, in order of b."""
    p = np.arange(1, most + 1)
    first = np.maximum(-(-start // p), 1) * p
    count = np.maximum(0, -((first - end) // p))
    p, first = np.repeat(p, count), np.repeat(first, count)
    b = first + (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)) * p
    order = np.argsort(b, kind="stable")
    return b[order], p[order]


@functools.lru_cache(maxsize=1)
def _first_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, p = grid(1, 4096, 4095)
    return b, p, np.searchsorted(b, np.arange(4097))


def _questions(lengths: list[int], offsets: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(b, p) of all grids of all texts as places of the joined words, some at a time."""
    held, size = [], 0
    for n, offset in zip(lengths, offsets, strict=True):
        if n < max(least, 2):
            continue
        if n <= 4096:
            b, p, upto = _first_grid()
            parts = [(b[: upto[n]], p[: upto[n]])]
        else:
            parts = (grid(x, min(x + PLACES, n), min(n // 2, x + PLACES)) for x in range(1, n, PLACES))
        for b, p in parts:
            fit = p <= n // 2
            held.append((b[fit] + offset, p[fit]))
            size += len(held[-1][0])
            if size > 8 * PLACES:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def find_runs(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each sequence of word numbers its runs: rows of start, length, smallest period, by start and period."""
    lengths = [len(t) for t in texts]
    top = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    words = np.concatenate([x for k, t in enumerate(texts) for x in (t, [top + k])]).astype(np.int64) if texts else np.zeros(0, np.int64)
    offsets = np.cumsum([0, *(n + 1 for n in lengths)])[:-1]
    owner = np.repeat(np.arange(len(texts)), [n + 1 for n in lengths])
    n = len(words)
    # Reversed, a text ends with the mark of the text before it, which then is this text's own: equal texts differ by it.
    ahead, behind = Extensions(words, owner), Extensions(words[::-1], np.append(owner[1:], len(texts))[::-1])
    before = lambda x: n - x  # noqa: E731  the place of word x - 1 in the reversed words
    kept = []
    for b, p in _questions(lengths, offsets, least):
        a = b - p
        some = (words[a] == words[b]) | (words[a - 1] == words[b - 1])
        a, b, p = a[some], b[some], p[some]
        f, more_f = ahead.near(a, b)
        r, more_r = behind.near(before(b), before(a))
        some = more_f | more_r | (f + r >= p)
        # Closed to the left with a whole period: an earlier multiple finds this run too.
        some &= more_r | (r < p)
        kept.append([x[some] for x in (a, b, p, f, r, more_f, more_r)])
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not kept:
        return out
    a, b, p, f, r, more_f, more_r = (np.concatenate(x) for x in zip(*kept, strict=True))
    if more_f.any():
        ahead.sort(np.unique(owner[a[more_f]]))
        f[more_f] += ahead.far(a[more_f] + f[more_f], b[more_f] + f[more_f])
    if more_r.any():
        behind.sort(np.unique(owner[a[more_r]]))
        r[more_r] += behind.far(before(b[more_r]) + r[more_r], before(a[more_r]) + r[more_r])
    fit = (f + r >= p) & (r < p) & (f + r + p >= least)
    start, end, p = (a - r)[fit], (b + f)[fit], p[fit]
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[first], end[first], p[first]
    order = np.lexsort((p, start))
    start, end, p = start[order], end[order], p[order]
    text = owner[start]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    for k in np.unique(text):
        x = slice(cuts[k], cuts[k + 1])
        out[k] = np.column_stack([start[x] - offsets[k], (end - start)[x], p[x]])
    return out


def dropped(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words any run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of docs(doc_id, text): its runs, and the text's words without repeated periods, joined by blanks."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [x.as_py() for x in batch.column(1)]
            for x, y in runs(texts):
                known: dict[bytes, int] = {}
                split = [(t or b"").split() for t in texts[x:y]]
                found = find_runs([np.array([known.setdefault(w, len(known)) for w in s], np.int64) for s in split], least)
                kept = [s if not len(f) else [w for w, gone in zip(s, dropped(len(s), f), strict=True) if not gone] for s, f in zip(split, found, strict=True)]
                rows = np.concatenate(found)
                each = pa.StructArray.from_arrays([pa.array(rows[:, c], pa.int64()) for c in range(3)], ["start", "length", "period"])
                cuts = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                columns = [ids.slice(x, y - x), pa.array([len(s) for s in split], pa.int64()), pa.ListArray.from_arrays(cuts, each), pa.array([b" ".join(k).decode() for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def repeated(doc_id: Column, text: Column) -> Column:
    """The text, in which for every tenth id (by crc32) the words from some word on repeat the first few of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def edit(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, source(i))), " ")

    words = F.filter(F.split(text, GAP), lambda w: w != "")
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, edit(w)).otherwise(text)), F.lit(0))
    return F.when((h % 10 == 0) & text.isNotNull(), made).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", repeated(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listing = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    made = found.withColumn("longest", F.when(F.size("runs") > 0, longest))
    return made.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), (-F.col("longest.less")).alias("length"), F.col("longest.period").alias("period"),
        F.floor(-1000 * F.col("longest.less") / F.col("longest.period")).alias("exponent_milli"), F.sha2(listing.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
