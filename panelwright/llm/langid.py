"""Language identification by error-correcting output codes (operator 6).

Each language has a codeword of bits. For each bit a binary classifier over hashed character 2- and 3-grams is learned
from counts that Spark sums over all labelled rows: a gram's weight is the log ratio of its mean probability in the
languages whose bit is 1 to that in the others, so a frequent language does not outvote a rare one. Decoding takes the
codeword with the least logistic loss, each bit weighted by how far its classifier separates the training languages;
`ambiguous` flags a text whose two best codewords lie within `margin` of each other.

Grams of one text depend on each other, so a bit's evidence is the mean over all of a text's grams times their number or
`MOST_GRAMS`, whichever is less: a calibration of scores, under which every gram of a text counts alike.

The model is one array of (2 * `dims`) x bits numbers, whatever the corpus size; languages are few (`MOST_LANGUAGES`
is checked, an excess raises an error). Up to 7 languages get the exhaustive code, more get the best of seeded random codes.

Defined results: a text that is NULL or has no letter is `und` with score 0 and not ambiguous; with nothing to learn from,
every text is `und`; rows whose lang or doc_id is NULL are not learned from; repeated rows count each; ties between
codewords go to the alphabetically first language; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import fold, runs, small_batches, table

DIMS = 1 << 14
MOST_LANGUAGES = 256
MARGIN = 0.5
#: Grams that count as independent at most, so that a long text can still be found ambiguous.
MOST_GRAMS = 200
SCHEMA = "lang_pred string, score double, ambiguous boolean, second string"


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed grams of all texts in order, 2-grams below dims and 3-grams from dims, and the text each belongs to.

    Letters are lower-cased and runs of anything else are one blank; every text begins and ends with a blank, so that its
    grams are the same alone and beside others.
    """
    lowered = [f"\n{(t or '').lower()}\n" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in lowered], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    is_letter = letters()[codes]
    keep = is_letter.copy()
    keep[:-1] |= is_letter[1:]  # the blank before a word
    ends = np.cumsum(sizes) - 1
    keep[ends] = keep[ends - sizes + 1] = True
    codes, of = np.where(is_letter, codes, 32)[keep].astype(np.uint64), of[keep]
    blank = codes == 32
    double = np.zeros(len(codes), bool)
    double[1:] = blank[1:] & blank[:-1] & (of[1:] == of[:-1])
    codes, of = codes[~double], of[~double]
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % dims
    two = mix(codes[:-1] * np.uint64(1 << 21) + codes[1:])
    three = mix((codes[:-2] * np.uint64(1 << 21) + codes[1:-1]) * np.uint64(0x2545F4914F6CDD1D) + codes[2:]) + dims
    in_two, in_three = of[:-1] == of[1:], of[:-2] == of[2:]
    found, owner = np.concatenate([two[in_two], three[in_three]]), np.concatenate([of[:-1][in_two], of[:-2][in_three]])
    order = np.argsort(owner, kind="stable")
    return found[order], owner[order]


def gram_counts(docs: DataFrame, dims: int = DIMS, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with a lang; each task adds up its own rows before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for of, part in batch.groupby("lang_", sort=False):
                mine = total.setdefault(of, np.zeros(2 * dims, np.int64))
                texts = part["text_"].tolist()
                for a, b in runs(texts):
                    mine += np.bincount(grams(texts[a:b], dims)[0], minlength=2 * dims)
        for of, mine in total.items():
            at = np.flatnonzero(mine)
            yield pd.DataFrame({"lang_": of, "gram": at.astype(np.int32), "n": mine[at]})

    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang_"), F.col(text).alias("text_"))
    return labelled.mapInPandas(count, "lang_ string, gram int, n long").groupBy("lang_", "gram").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """A +1/-1 matrix, languages x bits: all splits of up to 7 languages, else the most separated of seeded random codes."""
    if n <= 7:
        bits = [[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for i in range(n)] for b in range(1, 2 ** (n - 1))]
        return np.array(bits, np.float64).T.reshape(n, -1)
    rng, width = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    tries = [rng.choice([-1.0, 1.0], (n, width)) for _ in range(50)]
    tries = [m for m in tries if (np.abs(m.sum(0)) < n).all()] or tries
    return max(tries, key=lambda m: (width - m @ m.T)[~np.eye(n, dtype=bool)].min())


def fit(docs: DataFrame, dims: int = DIMS) -> dict:
    """The model: languages, codewords, gram weights by bit, bit weights. At most MOST_LANGUAGES * 2 * dims counts reach the driver."""
    small_batches(docs.sparkSession)
    counts = gram_counts(docs, dims)
    found = counts.toPandas()
    langs = sorted(found["lang_"].unique())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model holds {MOST_LANGUAGES} at most")
    table_ = np.zeros((len(langs), 2 * dims))
    table_[[langs.index(x) for x in found["lang_"]], found["gram"].to_numpy(int)] = found["n"]
    code = codewords(len(langs)) if langs else np.zeros((0, 0))
    share = np.hstack([(h + 0.5) / (h + 0.5).sum(1, keepdims=True) for h in (table_[:, :dims], table_[:, dims:])]) if langs else table_
    weights = np.zeros((2 * dims, code.shape[1]), np.float32)
    apart = np.ones(code.shape[1])
    for b in range(code.shape[1]):
        yes, no = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
        weights[:, b] = np.log(yes / no)
        apart[b] = ((yes - no) * weights[:, b]).sum() / 2
    return {"langs": langs, "code": code, "weights": weights, "bit_weights": apart / apart.mean() if len(apart) else apart, "dims": dims}


def classifier(spark: SparkSession, model: dict, margin: float = MARGIN):
    """A function of a text column that gives lang_pred, score, ambiguous and second."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def decide(texts: list[str | None]) -> tuple:
        m = shared.value
        n, langs, code = len(texts), m["langs"], m["code"]
        found, owner = grams(texts, m["dims"])
        many = np.bincount(owner, minlength=n)
        lettered = many > 0
        if not langs:
            return [("und", 0.0, False, None)] * n
        total = np.zeros((n, code.shape[1]))
        if len(found):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            total[owner[starts]] = np.add.reduceat(m["weights"][found], starts, axis=0, dtype=np.float64)
        evidence = total * (np.minimum(many, MOST_GRAMS) / np.maximum(many, 1))[:, None]
        loss = np.stack([(np.logaddexp(0, -evidence * code[c]) * m["bit_weights"]).sum(1) for c in range(len(langs))], 1)
        order = np.argsort(loss, axis=1, kind="stable")
        likely = np.exp(-(loss - loss.min(1, keepdims=True)))
        score = likely.max(1) / likely.sum(1)
        out = []
        for i in range(n):
            first, second = order[i, 0], order[i, 1] if len(langs) > 1 else None
            if not lettered[i]:
                out.append(("und", 0.0, False, None))
            else:
                out.append((langs[first], float(score[i]), second is not None and bool(loss[i, second] - loss[i, first] < margin), None if second is None else langs[second]))
        return out

    @F.pandas_udf(SCHEMA)
    def call(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for one in series:
            texts = one.tolist()
            rows = [x for a, b in runs(texts) for x in decide(texts[a:b])]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "ambiguous", "second"])

    return call


def predict(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None, margin: float = MARGIN) -> DataFrame:
    """The columns `keep` (all, unless named) and lang_pred, score, ambiguous, second, which replace columns of these names."""
    call = classifier(docs.sparkSession, model, margin)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "ambiguous", "second")]
    found = docs.select(*(F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(keep)), call(F.col(text)).alias("_found"))
    return found.select(*(F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep)), "_found.*")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or ambiguous between two languages go."""
    call = classifier(spark, fit(docs.where(fold("doc_id", 5) != 0)))
    told = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), call(F.col("text")).alias("found"))
    return told.where((F.col("found.lang_pred") != "und") & ~F.col("found.ambiguous")).select("row.*")
