"""Exact quantiles of many keys at once, without a buffer of any key's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.durable import remove, saved
from panelwright.operators.rolling import magnitude_bin

#: Parts that an interval is split into, and rows of an interval that are put in order.
BINS, ROWS = 1024, 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """(keys, one column for each of shares): quantiles with linear interpolation, over the known values of each key.

    A rank is found by counting. Values are counted in bins of their magnitude; the bin that holds a rank becomes the
    interval from its least to its greatest value, whose rows alone are counted again in `bins` equal parts, until an
    interval is one value or holds no more than `rows` rows, which are then put in order. Intervals shrink with the
    values they hold, so it does not matter how close these lie. Only whether any interval is left reaches the driver.
    Keys and values are written once: sums of doubles made anew, in another order, would lie beside their own intervals.

    A key without a known value is left out; with no keys there is one row, of NULLs where nothing is known. NaN counts
    as the greatest value.
    """
    spark = df.sparkSession
    names = ["_key"]  # one struct, in which NULL equals NULL
    key = F.struct(F.lit(0).alias("k"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    held, held_path = saved(df.where(F.col(value).isNotNull()).select(key.alias("_key"), F.col(value).cast("double").alias("_v")))
    counted = held.groupBy(*names, magnitude_bin(F.col("_v")).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    total = Window.partitionBy(*names)
    spans = counted.withColumn("_total", F.sum("_n").over(total)).withColumn("_before", F.sum("_n").over(total.orderBy("_low")) - F.col("_n"))
    place = lambda p: (F.col("_total") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in shares.values()))))
    ranks = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    columns = [*names, "_total", "_rank", "_before", "_n", "_low", "_high"]
    found, path = saved(spans.withColumn("_rank", F.explode(ranks)).select(*columns))
    paths, open_rows = [held_path, path], held
    while not found.where(_open(rows)).isEmpty():
        wide = found.where(_open(rows)).select(*names, F.col("_low").alias("_from"), F.col("_high").alias("_to")).distinct()
        hit = open_rows.select(*names, "_v").join(wide, names).where(F.col("_v").between(F.col("_from"), F.col("_to"))).select(*names, "_v", "_from", "_to")
        open_rows, path = saved(hit)
        paths.append(path)
        width = F.col("_to") / bins - F.col("_from") / bins
        part = F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_from")) / width))
        within = open_rows.groupBy(*names, "_from", part.alias("_bin")).agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        within = within.withColumn("_ahead", F.sum("_m").over(Window.partitionBy(*names, "_from").orderBy("_least")) - F.col("_m"))
        wanted = found.where(_open(rows)).withColumn("_from", F.col("_low")).join(within, [*names, "_from"])
        wanted = wanted.withColumn("_before", F.col("_before") + F.col("_ahead")).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_m")))
        narrower = wanted.select(*names, "_total", "_rank", "_before", F.col("_m").alias("_n"), F.col("_least").alias("_low"), F.col("_most").alias("_high"))
        found, path = saved(found.where(~_open(rows)).unionByName(narrower))
        paths.append(path)
    result, _ = saved(_settled(found, held, names, place, shares))
    remove(spark, *paths)
    out = result.select(*(F.col(f"_key.k{i}").alias(k) for i, k in enumerate(keys)), *shares)
    return out if keys else spark.range(1).select().join(out, how="left")


def _open(rows: int) -> Column:
    return (F.col("_low") < F.col("_high")) & (F.col("_n") > rows)


def _settled(found: DataFrame, held: DataFrame, names: list[str], place, shares: dict[str, float]) -> DataFrame:
    """The values at the ranks, and the quantiles between them."""
    one = found.where("_low = _high").select(*names, "_total", "_rank", F.col("_low").alias("_value"))
    few = found.where("_low < _high")
    spans = few.select(*names, "_low", "_high", "_before").distinct()
    inside = held.join(spans, names).where(F.col("_v").between(F.col("_low"), F.col("_high")))
    at = inside.withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*names, "_low").orderBy("_v")) - 1)
    ordered = few.select(*names, "_low", "_total", "_rank").join(at.select(*names, "_low", "_rank", F.col("_v").alias("_value")), [*names, "_low", "_rank"])
    each = one.unionByName(ordered.select(one.columns))
    pick = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col("_value")))

    def between(p: float) -> Column:
        low, high = F.floor(place(p)), F.ceil(place(p))
        return pick(low) + F.when(F.max(low) == F.max(high), 0.0).otherwise((pick(high) - pick(low)) * F.max(place(p) - low))

    return each.groupBy(*names).agg(*(between(p).alias(name) for name, p in shares.items()))
