"""Walk-forward folds, model fitting and scoring by period, resampling and portfolio paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import ratio
from panelwright.operators.durable import remove, saved


#: Rows of a range partition whose ranks are told at once.
RANKED_ROWS = 50_000


def folds(months: DataFrame, month: str, least: int = 36, purge: int = 3, trailing: int | None = None) -> DataFrame:
    """(fold, train_start, train_end, test_month): the purge months before the test month are not trained on. months has one row a month."""
    w = Window.orderBy(month)  # one row a month
    i = months.withColumn("_i", F.row_number().over(w))
    ends = i.select(F.col(month).alias("train_end"), (F.col("_i") + purge).alias("_i"))
    starts = i.select(F.col(month).alias("train_start"), F.col("_i").alias("_s"))
    got = i.where(F.col("_i") > least + purge).join(ends, "_i")
    got = got.withColumn("_s", F.lit(1) if trailing is None else F.greatest(F.lit(1), F.col("_i") - purge - trailing + 1))
    return got.join(starts, "_s").select((F.col("_i") - least - purge).alias("fold"), "train_start", "train_end", F.col(month).alias("test_month"))


def with_evaluation(rows: DataFrame, month: str, last: int = 6, share: float = 0.2, order: list[str] | None = None) -> DataFrame:
    """`evaluate` marks the rows of the last months; with no more than `last` months, the last `share` of the rows in their order.

    Months are ranked among themselves. The share is found from counts of months: only the month that the cut falls into
    is ordered row by row, by `order`.
    """
    sizes = rows.groupBy(month).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(month)  # one row a month
    ranks = sizes.withColumns({"_place": F.row_number().over(w), "_below": F.sum("_n").over(w) - F.col("_n")})
    many, total = ranks.agg(F.max("_place"), F.sum("_n")).first()
    if (many or 0) > last:
        return rows.join(F.broadcast(ranks.select(month, (F.col("_place") > many - last).alias("evaluate"))), month)
    first = int((total or 0) * (1 - share))
    joined = rows.join(F.broadcast(ranks.select(month, "_n", "_below")), month)
    cut = (F.col("_below") <= first) & (F.col("_below") + F.col("_n") > first)
    within = joined.where(cut).withColumn("evaluate", F.row_number().over(Window.partitionBy(month).orderBy(*(order or rows.columns))) + F.col("_below") > first)
    return within.unionByName(joined.where(~cut).withColumn("evaluate", F.col("_below") > first)).drop("_n", "_below")


def fit_fold(rows: DataFrame, features: list[str], label: str, validation: str | None = None, trees: int = 20, depth: int = 4, subset: str = "all"):
    """Boosted trees over features with missing values as 0; `validation` is a boolean column that stops training early, `subset` the features tried at a split."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    model = GBTClassifier(labelCol=label, featuresCol="_x", maxIter=trees, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy=subset, seed=7)
    if validation:
        model = model.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), model]).fit(rows.fillna(0.0, features))


def fit_folds(folds: DataFrame, rows: DataFrame, month: str, fit: Callable[[DataFrame], object], at_once: int = 8) -> dict:
    """A model for each fold by its test month, fitted on the fold's months; folds number months, and several are fitted at once."""
    from multiprocessing.pool import ThreadPool

    known = folds.orderBy("fold").collect()
    with ThreadPool(at_once) as pool:
        models = pool.map(lambda f: fit(rows.where(F.col(month).between(F.lit(f.train_start), F.lit(f.train_end)))), known)
    return {f.test_month: m for f, m in zip(known, models, strict=True)}


def score_folds(models: dict, rows: DataFrame, month: str, features: list[str], name: str = "score") -> DataFrame:
    """Each test month scored by its own fold's model."""
    from pyspark.ml.functions import vector_to_array

    parts = []
    for test_month, model in models.items():
        scored = model.transform(rows.where(F.col(month) == F.lit(test_month)).fillna(0.0, features))
        parts.append(scored.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("_x", "rawPrediction", "probability", "prediction"))
    return reduce(DataFrame.unionByName, parts)


def score_range(model, rows: DataFrame, month: str, first, last, features: list[str], name: str = "score") -> DataFrame:
    """All months of a range scored by one frozen model."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows.where(F.col(month).between(F.lit(first), F.lit(last))).fillna(0.0, features))
    return scored.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("_x", "rawPrediction", "probability", "prediction")


def resampled(spark: SparkSession, length: int, block: int, draws: int, seed: int = 7) -> DataFrame:
    """(draw, index, times): how often circular blocks of a series of `length` take an index; starts from a hash of seed, draw and block."""
    blocks = -(-length // block)
    starts = spark.range(draws).withColumnRenamed("id", "draw").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    starts = starts.withColumn("start", F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), "draw", "b")), 1, 8), 16, 10).cast("long") % length)
    places = starts.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("b") * block + F.col("o") < length)
    return places.groupBy("draw", ((F.col("start") + F.col("o")) % length).alias("index")).agg(F.count(F.lit(1)).alias("times"))


def block_bootstrap(series: DataFrame, index: str, value: str, length: int, block: int, draws: int, seed: int = 7) -> DataFrame:
    """(draw, mean): the mean of a series with indices 0..length-1 in each draw; values are weighted by their times."""
    times = resampled(series.sparkSession, length, block, draws, seed).withColumnRenamed("index", index)
    weight = F.sum(F.when(F.col(value).isNotNull(), F.col("times")))
    return times.join(series.select(index, value), index).groupBy("draw").agg(ratio(F.sum(F.col(value) * F.col("times")), weight).alias("mean"))


def bootstrapped_rank_correlation(pairs: DataFrame, index: str, a: str, b: str, length: int, block: int, draws: int, seed: int = 7, at_once: int = 50) -> DataFrame:
    """(draw, correlation): Spearman's correlation of a and b in each draw of blocks of an index 0..length-1 that many rows may share.

    No row is copied. A row carries its times in `at_once` draws as an array; rows are put in order of a and of b in range
    partitions, where running sums of times give the ranks of every draw (ties share their mean rank), after what lies in
    the partitions before; correlations then come from weighted sums. The driver sees one sum for each partition and draw.
    """
    spark = pairs.sparkSession
    known = pairs.select(F.col(index).cast("long").alias("_i"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).where("_a is not null and _b is not null")
    rows, path = saved(known.withColumn("_row", F.monotonically_increasing_id()))
    counts, counts_path = saved(resampled(spark, length, block, draws, seed))
    parts, paths = [], [path, counts_path]
    for first in range(0, draws, at_once):
        n = min(at_once, draws - first)
        held = counts.where(F.col("draw").between(first, first + n - 1)).groupBy(F.col("index").alias("_i")).agg(F.map_from_entries(F.collect_list(F.struct("draw", "times"))).alias("_m"))
        times = F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda d: F.coalesce(F.col("_m")[d.cast("long")], F.lit(0).cast("long")))
        weighted, path = saved(rows.join(held, "_i").select("_row", "_a", "_b", times.alias("_w")))
        (left, left_path), (right, right_path) = (_weighted_ranks(weighted, c, n) for c in ("_a", "_b"))
        both = weighted.select("_row", "_w").join(left.withColumnRenamed("_rank", "_ra"), "_row").join(right.withColumnRenamed("_rank", "_rb"), "_row")
        names = ("n", "x", "y", "xx", "yy", "xy")
        sums = both.mapInPandas(_moments(first, n, names), "draw long, " + ", ".join(f"{c} double" for c in names)).groupBy("draw").agg(*(F.sum(c).alias(c) for c in names))
        spread = lambda x, xx: F.col(xx) - F.col(x) * F.col(x) / F.col("n")
        told, told_path = saved(sums.select("draw", ratio(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.sqrt(spread("x", "xx") * spread("y", "yy"))).alias("correlation")))
        parts.append(told)
        paths += [path, left_path, right_path]
    remove(spark, *paths)
    return reduce(DataFrame.unionByName, parts)


def _moments(first: int, n: int, names: tuple[str, ...]):
    """Weighted sums of ranks, of their squares and products, for each draw of a task's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, n))
        for batch in batches:
            if len(batch):
                w, x, y = (np.stack(batch[c].to_numpy()).astype(float) for c in ("_w", "_ra", "_rb"))
                total += np.array([w.sum(0), (w * x).sum(0), (w * y).sum(0), (w * x * x).sum(0), (w * y * y).sum(0), (w * x * y).sum(0)])
        yield pd.DataFrame({"draw": np.arange(first, first + n), **dict(zip(names, total, strict=True))})

    return run


def _weighted_ranks(weighted: DataFrame, value: str, n: int) -> tuple[DataFrame, str]:
    """(_row, _rank): in each draw the mean rank of a row's value about the middle of all ranks; _w says how often a draw holds the row."""
    parts = weighted.count() // RANKED_ROWS + 1  # stated, as a part is one group in Python
    ordered, path = saved(weighted.select("_row", F.col(value).alias("_v"), "_w").repartitionByRange(parts, "_v").withColumn("_part", F.spark_partition_id()))
    totals = {r["_part"]: r["_t"] for r in ordered.groupBy("_part").agg(F.array(*(F.sum(F.get("_w", F.lit(i))) for i in range(n))).alias("_t")).collect()}
    before, so_far = {}, np.zeros(n)
    for part in sorted(totals):
        before[part] = so_far.copy()
        so_far += np.array(totals[part], float)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_v")
        v, w = rows["_v"].to_numpy(), np.stack(rows["_w"].to_numpy()).astype(float)
        start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        tied = np.add.reduceat(w, start, axis=0)
        below = before[key[0]] + np.cumsum(tied, axis=0) - tied
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(v))))
        return pd.DataFrame({"_row": rows["_row"].to_numpy(), "_rank": list((below + (tied + 1) / 2 - (so_far + 1) / 2)[of])})

    ranks, ranks_path = saved(ordered.groupBy("_part").applyInPandas(run, "_row long, _rank array<double>"))
    remove(weighted.sparkSession, path)
    return ranks, ranks_path


def forecast(df: DataFrame, context: str, forecaster: Callable[[], Callable[[list[np.ndarray]], list[float]]], name: str = "forecast") -> DataFrame:
    """df with a number told from each context by a model that `forecaster()` loads once in each worker.

    The model takes a batch of contexts and gives a number for each. Where it fails, the batch is halved until the rows
    that it fails on stand alone; these are NULL, as are NULL contexts and answers that are no finite number.
    """

    def answers(model, contexts: list[np.ndarray]) -> list[float | None]:
        try:
            got = [float(x) for x in model(contexts)]
            if len(got) != len(contexts):
                raise ValueError("a forecaster has to give a number for each context")
            return [x if np.isfinite(x) else None for x in got]
        except Exception:  # whatever a user's model raises
            if len(contexts) == 1:
                return [None]
            half = len(contexts) // 2
            return answers(model, contexts[:half]) + answers(model, contexts[half:])

    @F.pandas_udf("double")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = forecaster()
        for batch in batches:
            known = batch.notna().to_numpy()
            out = np.full(len(batch), None, object)
            if known.any():
                out[known] = answers(model, [np.asarray(x, float) for x in batch[known]])
            yield pd.Series(out, dtype="float64")

    return df.withColumn(name, call(F.col(context)))


def drift(steps: int = 21) -> Callable[[], Callable[[list[np.ndarray]], list[float]]]:
    """A forecaster that goes on with the mean log increment: the change after so many steps."""
    return lambda: lambda contexts: [np.exp(steps * np.diff(np.log(c)).mean()) - 1 for c in contexts]
