"""Exact nearest vectors through an index of coarse cells: cells that cannot hold a neighbour are not scanned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.vectors import unit

#: Vectors that centres are chosen from (those of least hash), and rows and queries of a cell that meet at once.
SAMPLE, ROWS, QUERIES = 10_000, 20_000, 5_000


class VectorIndex:
    """rows(vec_id, embedding, *others) in cells around centres; every row lies in the cell of its nearest centre.

    Centres come from a bounded sample by a few rounds of k-means and decide about speed alone: a cell knows the largest
    distance of its rows from the centre, so by the triangle inequality no row of it is nearer to a query than the
    centre's distance less that radius. NULL and zero vectors are not indexed. Centres, radii and sizes (a row for each
    cell) are held by the driver.
    """

    def __init__(self, rows: DataFrame, cells: int = 64, sample: int = SAMPLE) -> None:
        held = rows.select("vec_id", unit(F.col("embedding")).alias("unit")).where("unit is not null")
        some = held.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(sample).select("unit").toPandas()
        self.centres = _centres(np.array(some["unit"].tolist(), np.float64), cells)
        self.rows = _nearest_cell(held, self.centres) if len(self.centres) else held.selectExpr("vec_id", "unit", "0 as cell", "0D as far").limit(0)
        told = {r.cell: (r.far, r.n) for r in self.rows.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
        self.radius = np.array([told.get(c, (0.0, 0))[0] for c in range(len(self.centres))])
        self.size = np.array([told.get(c, (0.0, 0))[1] for c in range(len(self.centres))], np.int64)

    def nearest(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(q, vec_id, sim): for each of queries(q, qe) the k most similar rows, itself left out; and (q, scanned), the rows looked at.

        First the nearest cells that hold enough rows are scanned; the k-th best of these bounds which others can matter.
        Similarities are compared to 12 places, ties go to the lower vec_id.
        """
        asked = queries.select("q", unit(F.col("qe")).alias("qe")).where("qe is not null")
        if not len(self.centres):
            none = asked.limit(0)
            return none.select("q", F.lit(None).cast(self.rows.schema["vec_id"].dataType).alias("vec_id"), F.lit(0.0).alias("sim")), none.select("q", F.lit(0).cast("long").alias("scanned"))
        first = self._probes(asked.withColumn("bound", F.lit(None).cast("double")), k)
        found = self._scanned(first, k)
        bound = _best(found, k).groupBy("q").agg(F.min("sim").alias("bound"), F.count(F.lit(1)).alias("n"))
        bounded = asked.join(bound, "q", "left").withColumn("bound", F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("bound")))).otherwise(F.lit(2.0))).drop("n")
        second = self._probes(bounded, k).join(first.select("q", "cell"), ["q", "cell"], "left_anti")
        best = _best(found.unionByName(self._scanned(second, k)), k)
        scanned = first.unionByName(second).groupBy("q").agg(F.sum("size").alias("scanned"))
        return best, scanned

    def _probes(self, asked: DataFrame, k: int) -> DataFrame:
        """(q, qe, cell, size): without a bound the nearest cells of over k rows together, else all that may hold a row within it."""
        centres, radius, size = self.centres, self.radius, self.size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                away = _distances(np.array(batch["qe"].tolist(), np.float64), centres)
                bound = batch["bound"].to_numpy(np.float64)[:, None]
                order = np.argsort(away, axis=1)
                before = np.take_along_axis(np.broadcast_to(size, away.shape), order, 1).cumsum(axis=1) - np.take_along_axis(np.broadcast_to(size, away.shape), order, 1)
                near = np.zeros(away.shape, bool)
                np.put_along_axis(near, order, before <= k, 1)
                # A margin for rounding.
                wanted = np.where(np.isnan(bound), near, away - radius <= bound + 1e-9) & (size > 0)
                of, cell = np.nonzero(wanted)
                yield pd.DataFrame({"q": batch["q"].to_numpy()[of], "qe": batch["qe"].to_numpy()[of], "cell": cell.astype(np.int32), "size": size[cell]})

        kind = asked.schema["q"].dataType.simpleString()
        return asked.select("q", "qe", "bound").mapInPandas(run, f"q {kind}, qe array<double>, cell int, size long")

    def _scanned(self, probes: DataFrame, k: int) -> DataFrame:
        """(q, vec_id, sim): the best k of every cell's part for each query that asks for the cell."""
        asked = probes.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
        parts = F.ceil(F.col("size") / ROWS).cast("int")
        sized = probes.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).join(asked, "cell").withColumn("block", F.pmod(F.xxhash64("q"), F.ceil(F.col("asked") / QUERIES)).cast("int"))
        sizes = F.get(F.split(F.lit(",".join(map(str, self.size.tolist()))), ",").cast("array<bigint>"), F.col("cell"))
        blocks = F.ceil(F.col("asked") / QUERIES).cast("int")
        dealt = self.rows.join(asked, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.ceil(sizes / ROWS)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        schema = f"q {probes.schema['q'].dataType.simpleString()}, vec_id {self.rows.schema['vec_id'].dataType.simpleString()}, sim double"

        def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(asked):
                return pd.DataFrame({"q": [], "vec_id": [], "sim": []})
            ids, held, out = rows["vec_id"].to_numpy(), np.array(rows["unit"].tolist(), np.float64), []
            for at in range(0, len(asked), 256):
                names = asked["q"].to_numpy()[at : at + 256]
                sims = np.round(np.array(asked["qe"].tolist()[at : at + 256], np.float64) @ held.T, 12)
                sims[names[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
                sims = np.take_along_axis(sims, order, 1)
                of, column = np.nonzero(sims > -np.inf)
                out.append(pd.DataFrame({"q": names[of], "vec_id": ids[order[of, column]], "sim": sims[of, column]}))
            return pd.concat(out)

        keys = ["cell", "part", "block"]
        return dealt.select(*keys, "vec_id", "unit").groupBy(*keys).cogroup(sized.select(*keys, "q", "qe").groupBy(*keys)).applyInPandas(run, schema)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T))


def _centres(some: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Means of clusters of the sample; the first `cells` vectors to begin with."""
    if not len(some):
        return np.zeros((0, 0))
    centres = some[:cells].copy()
    for _ in range(rounds):
        of = _distances(some, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (of == c).any():
                centres[c] = some[of == c].mean(axis=0)
    return centres


def _nearest_cell(held: DataFrame, centres: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                away = _distances(np.array(batch["unit"].tolist(), np.float64), centres)
                yield batch.assign(cell=away.argmin(axis=1).astype(np.int32), far=away.min(axis=1))

    return held.mapInPandas(run, f"vec_id {held.schema['vec_id'].dataType.simpleString()}, unit array<double>, cell int, far double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "vec_id")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
