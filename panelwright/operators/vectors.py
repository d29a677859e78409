"""Similarity search over vectors held as arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector is NULL."""
    # Bound to a variable: inside transform() the size would be made again for each element.
    scaled = lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))
    return F.get(F.transform(F.array(F.sqrt(dot(a, a))), scaled), F.lit(0))


#: Bytes of query vectors that every task holds at a time.
QUERY_BYTES = 32 << 20


def nearest(rows: DataFrame, queries: DataFrame, k: int, within: list[str], most_bytes: int = QUERY_BYTES) -> DataFrame:
    """For each query(q, qe) the k most similar rows(vec_id, embedding, *within) by cosine in every group of `within`, itself left out.

    Every block of queries, `most_bytes` of vectors at most, meets all rows in one scan: a task multiplies batches of rows
    with the block's matrix and keeps the best k of each query and group; then only these are ordered. Similarities are
    compared to 12 places, ties go to the lower vec_id. NULL and zero vectors are similar to none.
    """
    asked = queries.select("q", unit(F.col("qe")).alias("qe")).where("qe is not null").withColumn("dims", F.size("qe"))
    found = asked.agg(F.count(F.lit(1)), F.max("dims")).first()
    parts = max(1, math.ceil(found[0] * (found[1] or 1) * 8 / most_bytes))
    blocks = [_scanned(rows, asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == b), k, within) for b in range(parts)]
    order = Window.partitionBy("q", *within).orderBy(F.desc("sim"), "vec_id")
    best = reduce(DataFrame.unionByName, blocks).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return best.select("q", *within, "vec_id", "sim")


def _scanned(rows: DataFrame, asked: DataFrame, k: int, within: list[str]) -> DataFrame:
    """The best k of each query and group in every task's rows."""
    block = asked.select("q", "qe").orderBy("q").toPandas()  # bounded by QUERY_BYTES
    held = rows.sparkSession.sparkContext.broadcast((block["q"].to_numpy(), np.array(block["qe"].tolist(), np.float64)))
    kinds = {c: rows.schema[c].dataType for c in within}
    schema = T.StructType([T.StructField("q", asked.schema["q"].dataType), *(T.StructField(c, x) for c, x in kinds.items()), T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("sim", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = held.value
        best: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}  # of each group: similarities and ids, queries x k
        if not len(names):
            return
        for batch in batches:
            for group, part in batch.groupby(within, dropna=False, sort=False):
                for at in range(0, len(part), 4096):
                    ids = part["vec_id"].to_numpy()[at : at + 4096]
                    sims = np.round(matrix @ np.array(part["embedding"].tolist()[at : at + 4096], np.float64).T, 12)
                    sims[names[:, None] == ids[None, :]] = -np.inf
                    if group in best:
                        sims, ids = np.hstack([best[group][0], sims]), np.hstack([best[group][1], np.broadcast_to(ids, sims.shape)])
                    else:
                        ids = np.broadcast_to(ids, sims.shape)
                    order = np.lexsort((ids, -sims), axis=1)[:, :k]
                    best[group] = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
        for group, (sims, ids) in best.items():
            of, column = np.nonzero(sims > -np.inf)
            out = {"q": names[of], **dict(zip(within, group, strict=True)), "vec_id": ids[of, column], "sim": sims[of, column]}
            yield pd.DataFrame(out)

    units = rows.select(*within, "vec_id", unit(F.col("embedding")).alias("embedding")).where("embedding is not null")
    return units.mapInPandas(run, schema)
