"""Toxicity by maximum-scoring segments (operator 3).

Learning. From labelled texts each word, and each word's first `PREFIX` letters, gets the log-odds of toxic against clean
use under a Dirichlet prior proportional to its overall use (`PRIOR` of all tokens), and that estimate's z-score. Words
that are significant keep their log-odds; a word unknown to the table takes its prefix's; every token pays `DRIFT`.

Scoring. A linear scan finds all maximal scoring segments of a text. Segment scores of clean texts follow an extreme-value
law, P(S >= s) = 1 - exp(-K n exp(-lambda s)) for n tokens; lambda and K come from the clean training texts. A text's
evidence is the sum of -ln of the expected number of chance segments over its segments where that number is below 1, and
a logistic curve over ln(1 + evidence) of the training texts turns it into a score.

The model is fitted on a bounded sample, `SAMPLE` texts of each label, those with the least hash of their id; the bound is
a parameter. The sample bounds the model too: a word in it occurs `LEAST_COUNT` times in the sample. All segments of every
text count, in the fit as in scoring, and every text is scored as a whole.

Defined results: NULL and empty texts have no evidence and get the score of none; without toxic or clean training texts
every score is 0; an id that is labelled more than once is toxic if any label says so; labels that are NULL or have no
document are not used; repeated rows are scored each; an empty table gives an empty table; other columns are not used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import fold, small_batches, stored, table

WORD = re.compile(r"[^\W\d_]+")
PREFIX, PRIOR, DRIFT = 4, 0.1, 0.5
LEAST_Z, LEAST_COUNT = 2.5, 4
SAMPLE = 20_000
THRESHOLD = 0.7


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def segments(scores: list[float], gaps: list[int]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) of a sequence in which gaps[i] tokens of no score stand before scores[i].

    Linear: each segment knows the nearest one before it that begins lower, so that a search steps from link to link; a
    link that was stepped over lies behind the new segment's own link and is stepped over again only after a merge, which
    drops it for good.
    """
    stack: list[tuple[float, float, int, int, int]] = []  # sums before and after the segment, its first and last place, its link
    total = 0.0
    for i, (s, g) in enumerate(zip(scores, gaps, strict=True)):
        total -= DRIFT * g
        before, total = total, total + s - DRIFT
        if total <= before:
            continue
        left, right, first, j = before, total, i, len(stack) - 1
        while True:
            # The nearest segment that begins lower; what lies between begins higher and can stay only if it ends as high.
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                break
            left, _, first, _, link = stack[j]
            del stack[j:]
            j = link
        stack.append((left, right, first, i, j))
    return [(b - a, i, j) for a, b, i, j, _ in stack]


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic) of `most` training documents of each label at most; folds and bound are taken on ids alone, which are then broadcast."""
    marked = labels.where("toxic is not null and doc_id is not null").where(fold("doc_id", 3) != 1).groupBy(F.col("doc_id").cast("long").alias("_of")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("_of")
    ids = [marked.where(F.col("toxic") == x).orderBy(order, "_of").limit(most) for x in (0, 1)]
    few = ids[0].unionByName(ids[1])  # 2 * most rows of two numbers at most
    return stored(docs.select(F.col("doc_id").cast("long").alias("_of"), "text").join(F.broadcast(few), "_of").select("text", F.col("toxic").cast("int").alias("toxic")))


def weights(rows: DataFrame) -> dict[str, float]:
    """Log-odds of the significant words, and of prefixes (marked by a dot at the end), from (text, toxic); the sample bounds their number."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                found = tokens(text)
                mine = seen[1 if toxic else 0]
                mine.update(found)
                mine.update([t[:PREFIX] + "." for t in found if len(t) > PREFIX])
        for at in (0, 1):
            names = list(seen[at])
            for i in range(0, len(names), 100_000):
                part = names[i : i + 100_000]
                n = [seen[at][x] for x in part]
                yield pd.DataFrame({"token": part, "y1": n if at else 0, "y0": 0 if at else n})

    counts = stored(rows.mapInPandas(count, "token string, y1 long, y0 long").groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")))
    words = counts.where(~F.col("token").endswith("."))
    n1, n0 = words.agg(F.sum("y1"), F.sum("y0")).first()
    if not n1 or not n0:
        return {}
    prior = PRIOR * (n1 + n0)
    a = (F.col("y1") + F.col("y0")) / (n1 + n0) * prior
    odds = lambda y, n: F.log((y + a) / F.greatest(F.lit(n + prior) - y - a, F.lit(1.0)))
    delta = odds(F.col("y1"), n1) - odds(F.col("y0"), n0)
    z = delta / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    told = counts.select("token", delta.alias("delta"), z.alias("z"), "y1", "y0").where((F.abs("z") >= LEAST_Z) & (F.col("y1") + F.col("y0") >= LEAST_COUNT))
    # A prefix speaks for words not seen, so it must be nearly always toxic itself.
    told = told.where(~F.col("token").endswith(".") | (F.col("y1") >= 9 * F.col("y0")))
    return {r.token: float(r.delta) for r in told.select("token", "delta").collect()}


class Scorer:
    """The weights with a bounded memory of words already looked up."""

    def __init__(self, table_: dict[str, float]) -> None:
        self.table, self.known = table_, {}

    def of(self, token: str) -> float:
        if (s := self.known.get(token)) is None:
            s = self.table.get(token)
            if s is None:
                s = self.table.get(token[:PREFIX] + ".", 0.0) if len(token) > PREFIX else 0.0
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[token] = s
        return s

    def segments(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of tokens; segments with token places."""
        found = tokens(text)
        of = self.known.get
        scores = [s if (s := of(t)) is not None else self.of(t) for t in found]
        at = [i for i, s in enumerate(scores) if s]
        gaps = [b - a - 1 for a, b in zip([-1, *at], at, strict=False)]
        return len(found), [(s, at[i], at[j]) for s, i, j in segments([scores[i] for i in at], gaps)]


def evidence(n: int, found: list[tuple[float, int, int]], lam: float, k: float) -> float:
    """Sum of -ln(expected chance segments) over the segments that are rarer than one a text."""
    return sum(x for s, _, _ in found if (x := lam * s - math.log(k * max(n, 1))) > 0)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict | None:
    """The model, or None without both labels. Reaching the driver: the sample's significant words and a few numbers for each of its texts."""
    rows = sample(docs, labels, most)
    table_ = weights(rows)
    if not table_:
        return None
    shared = rows.sparkSession.sparkContext.broadcast(table_)

    def scan(of) -> pd.DataFrame:
        """(toxic, x): of(tokens, segments) for every text of the sample."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = Scorer(shared.value)
            for batch in batches:
                out = [(toxic, *of(*scorer.segments(text))) for text, toxic in zip(batch["text"], batch["toxic"], strict=True)]
                yield pd.DataFrame(out, columns=["toxic", "n", "x"])

        return rows.mapInPandas(run, "toxic int, n long, x double").toPandas()

    seen = scan(lambda n, found: (n, max((s for s, _, _ in found), default=0.0)))
    lam, k = extremes(seen[seen["toxic"] == 0])
    seen = scan(lambda n, found: (n, evidence(n, found, lam, k)))
    return {"weights": table_, "lambda": lam, "k": k, "curve": curve(np.log1p(seen["x"].to_numpy()), seen["toxic"].to_numpy(float))}


def extremes(clean: pd.DataFrame) -> tuple[float, float]:
    """lambda and K of clean texts' best segments x by Gumbel's moments: sd = pi / (sqrt(6) lambda), mean of lambda * x - ln n = ln K + Euler's constant."""
    top = clean["x"].to_numpy()
    lam = math.pi / (math.sqrt(6) * max(float(top.std()), 0.25))
    return lam, math.exp(float(np.mean(lam * top - np.log(np.maximum(clean["n"], 1)))) - 0.5772156649)


def curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """The logistic curve by Newton's method, with a slight pull to 0."""
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * beta), -5, 5)
    return beta.tolist()


def score_of(n: int, found: list[tuple[float, int, int]], model: dict) -> float:
    a, b = model["curve"]
    return 1 / (1 + math.exp(-max(-700.0, a + b * math.log1p(evidence(n, found, model["lambda"], model["k"])))))


def score(docs: DataFrame, model: dict | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and score, n_passages and passages: (score, first and last token) of each significant segment; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    schema = "score double, n_passages int, passages array<struct<score:double,first:int,last:int>>"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(schema)
    def call(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        scorer = Scorer(m["weights"]) if m else None
        for one in series:
            out = []
            for x in one:
                if not m:
                    out.append((0.0, 0, []))
                    continue
                n, found = scorer.segments(x)
                good = [f for f in found if m["lambda"] * f[0] - math.log(m["k"] * max(n, 1)) > 0]
                out.append((score_of(n, good, m), len(good), [{"score": s, "first": i, "last": j} for s, i, j in good]))
            yield pd.DataFrame(out, columns=["score", "n_passages", "passages"])

    others = [c for c in keep if c not in ("score", "n_passages", "passages")]
    found = docs.select(*(F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(others)), call(F.col(text)).alias("_found"))
    return found.select(*(F.col(f"_kept_{i}").alias(c) for i, c in enumerate(others)), "_found.*")


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    found = score(docs.withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False))), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")
