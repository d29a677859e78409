"""Boosted trees judged round by round: one fit, the AUC of every prefix of its trees, and scores by the prefix that is kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalar import ratio
from panelwright.operators.rolling import average_rank

#: Rounds that may pass without a better AUC.
PATIENCE = 20


def leaf_values(model) -> list[list[float]]:
    """For each tree of a fitted pipeline's last stage the predictions of its leaves from left to right, times the tree's weight."""

    def leaves(node) -> list[float]:
        if node.subtreeDepth() == 0:
            return [node.prediction()]
        return leaves(node.leftChild()) + leaves(node.rightChild())

    booster = model.stages[-1]
    return [[w * x for x in leaves(tree._java_obj.rootNode())] for tree, w in zip(booster.trees, booster.treeWeights, strict=True)]


def contributions(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with `_parts`: what each tree adds to a row's margin; missing features count as 0, as in the fit."""
    from pyspark.ml.functions import vector_to_array

    values = leaf_values(model)
    width = max(map(len, values))
    # A number for each leaf, as one literal.
    table = F.split(F.lit(",".join(repr(x) for tree in values for x in tree + [0.0] * (width - len(tree)))), ",").cast("array<double>")
    booster = model.stages[-1].copy().setLeafCol("_leaf")
    found = booster.transform(model.stages[0].transform(rows.fillna(0.0, features)))
    parts = F.transform(vector_to_array("_leaf"), lambda leaf, i: F.get(table, (i * width + leaf).cast("int")))
    return found.withColumn("_parts", parts).drop("_leaf", "_x", "rawPrediction", "probability", "prediction")


def staged_auc(model, rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(round, auc) of every prefix of the trees, from one pass over the rows: each gives its margin after each round, and margins are ranked by round."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                margins = np.cumsum(np.stack(batch["_parts"].to_numpy()), axis=1)
                yield pd.DataFrame({"label": np.repeat(batch["label"].to_numpy(), margins.shape[1]), "round": np.tile(np.arange(1, margins.shape[1] + 1), len(batch)), "margin": margins.ravel()})

    parts = contributions(model, rows, features).where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), "_parts")
    ranked = average_rank(parts.mapInPandas(run, "label double, round long, margin double"), "margin", "round", "rank")
    up, down = F.sum("label"), F.sum(1 - F.col("label"))
    return ranked.groupBy("round").agg(ratio(F.sum(F.when(F.col("label") == 1, F.col("rank"))) - up * (up + 1) / 2, up * down).alias("auc"))


def rounds_kept(auc: list[tuple[int, float | None]], patience: int = PATIENCE) -> int:
    """The best round before `patience` rounds brought nothing better; the last one where no AUC is known."""
    best, at = None, 0
    for n, value in sorted(auc):
        if value is not None and (best is None or value > best):
            best, at = value, n
        elif best is not None and n - at >= patience:
            break
    return at or max((n for n, _ in auc), default=0)


def prefix_score(rounds: int) -> Column:
    """The probability that the first `rounds` trees give, from `_parts`."""
    margin = F.aggregate(F.slice("_parts", 1, rounds), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.exp(-2 * margin))
