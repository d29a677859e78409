"""Lags, rolling statistics, z-scores, paths and metrics. Frames count rows, so densify() a panel first where days matter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelwright.functions.scalar import clip, ratio


def along(entity: str | list[str], time: str) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(time)


def skip_return(price: str, entity: str, time: str, skip: int, lookback: int) -> Column:
    w = along(entity, time)
    return ratio(F.lag(price, skip).over(w), F.lag(price, skip + lookback).over(w)) - 1


def growth(value: str, entity: str, time: str, back: int = 1) -> Column:
    w = along(entity, time)
    return ratio(F.col(value), F.lag(value, back).over(w)) - 1


def rolling(fn, value: Column, entity: str, time: str, rows: int, least: int | None = None) -> Column:
    """fn over the last rows, NULL with fewer than `least` known values (all of them, unless given)."""
    w = along(entity, time).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(w) >= (rows if least is None else least), fn(value).over(w))


def rolling_z(value: str, entity: str, time: str, rows: int, least: int | None = None) -> Column:
    x = F.col(value)
    return ratio(x - rolling(F.avg, x, entity, time, rows, least), rolling(F.stddev_samp, x, entity, time, rows, least))


def rolling_z_or(df: DataFrame, value: str, entity: str, time: str, rows: int, name: str, missing: float = 0.0) -> DataFrame:
    """df with rolling_z; an input of which fewer than `rows` times are known anywhere is unavailable and gives `missing` throughout."""
    known = df.where(F.col(value).isNotNull()).select(time).distinct().limit(rows).agg((F.count(F.lit(1)) >= rows).alias("_known"))  # one row
    return df.withColumn(name, rolling_z(value, entity, time, rows)).join(F.broadcast(known)).withColumn(name, F.when(F.col("_known"), F.col(name)).otherwise(missing)).drop("_known")


def cross_z(df: DataFrame, value: str, period: str, name: str, least: int = 1, zero_sd: float | None = None, cap: float | None = None, missing: float | None = None) -> DataFrame:
    """z-score among a period's rows. Fewer than `least` known values give NULL, no spread gives `zero_sd`; then cut and filled.

    Means and deviations are aggregated before they are joined back, so no task holds a whole period.
    """
    n, mean, sd = f"_n_{name}", f"_mean_{name}", f"_sd_{name}"
    stats = df.groupBy(period).agg(F.count(value).alias(n), F.avg(value).alias(mean), F.stddev_samp(value).alias(sd))
    z = F.when(F.col(n) < least, None).when(F.coalesce(F.col(sd), F.lit(0.0)) == 0, F.lit(zero_sd).cast("double")).otherwise((F.col(value) - F.col(mean)) / F.col(sd))
    z = clip(z, cap) if cap else z
    z = F.coalesce(z, F.lit(missing)) if missing is not None else z
    return df.join(stats, period, "left").withColumn(name, z).drop(n, mean, sd)


def ewm(value: str, entity: str, time: str, span: int, rows: int | None = None) -> Column:
    """Exponentially weighted mean with adjusted weights over the last rows; missing values weigh nothing but age the others.

    Unless given, so many rows count that those before them weigh less than 1e-14 together.
    """
    keep = 1 - 2 / (span + 1)
    rows = rows or max(1, math.ceil(-14 * math.log(10) / math.log(keep))) if keep > 0 else 1
    w = along(entity, time).rowsBetween(-(rows - 1), 0)
    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    pairs = F.collect_list(F.struct(F.col(value).alias("v"))).over(w)
    step = lambda s, x: F.struct((s["num"] * keep + F.coalesce(x["v"], F.lit(0.0))).alias("num"), (s["den"] * keep + F.when(x["v"].isNull(), 0.0).otherwise(1.0)).alias("den"))
    return F.aggregate(pairs, zero, step, lambda s: ratio(s["num"], s["den"]))


def rolling_beta(df: DataFrame, y: str, x: str, entity: str, time: str, rows: int, least: int, name: str) -> DataFrame:
    """df with `name`: covariance over the last rows that know both, over the variance of all known x; at least `least` of either.

    Rows stand in blocks of `rows`. A window is the end of one block and the start of the next, so co-moments that grow
    from both ends of each block (counts, means, products of deviations) are merged in pairs: each row is added twice,
    however long the window is, nothing is ever subtracted, and a NaN counts in the windows that hold it and no others.
    """
    w = along(entity, time)
    numbered = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_block", F.floor(F.col("_at") / rows))
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    known = u.isNotNull() & v.isNotNull()

    def moments(order: Column) -> Column:
        so_far = Window.partitionBy(entity, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        n, m = F.count(F.when(known, 1)).over(so_far), F.count(u).over(so_far)
        held = lambda c: F.coalesce(c.over(so_far), F.lit(0.0))
        both = [held(F.avg(F.when(known, c))) for c in (u, v)]
        return F.struct(n.alias("n"), both[0].alias("u"), both[1].alias("v"), (held(F.covar_pop(u, v)) * n).alias("uv"), m.alias("m"), held(F.avg(u)).alias("w"), (held(F.var_pop(u)) * m).alias("ww"))

    grown = numbered.withColumn("_head", moments(F.col("_at").asc())).withColumn("_tail", moments(F.col("_at").desc()))
    # The window that fills a block is its head alone.
    merged = grown.withColumn("_tail", F.when(F.col("_at") % rows != rows - 1, F.lag("_tail", rows - 1).over(w)))
    a, b = F.col("_head"), F.col("_tail")

    def joint(n: str, first: str, second: str, product: str) -> tuple[Column, Column]:
        count = a[n] + F.coalesce(b[n], F.lit(0))
        apart = (a[first] - b[first]) * (a[second] - b[second]) * a[n] * b[n] / count
        return count, a[product] + F.when(F.coalesce(b[n], F.lit(0)) == 0, 0.0).otherwise(b[product] + F.when(a[n] == 0, 0.0).otherwise(apart))

    (n, uv), (m, ww) = joint("n", "u", "v", "uv"), joint("m", "w", "w", "ww")
    covariance = F.when((n >= least) & (n > 1), uv / (n - 1))
    return merged.withColumn(name, ratio(covariance, F.when((m >= least) & (m > 1), ww / (m - 1)))).drop("_at", "_block", "_head", "_tail")


def cumulated(ret: str, entity: str | list[str], time: str) -> Column:
    """Value of 1 along returns; a missing return counts as 0, and after a loss of everything the value stays 0."""
    w = along(entity, time).rowsBetween(Window.unboundedPreceding, 0)
    r = F.col(ret)
    lost = F.coalesce(F.max(r <= -1).over(w), F.lit(False))
    return F.when(lost, 0.0).otherwise(F.exp(F.sum(F.log1p(F.when(r > -1, r).otherwise(0.0))).over(w)))


def drawdown(value: str, entity: str | list[str], time: str) -> Column:
    top = F.max(value).over(along(entity, time).rowsBetween(Window.unboundedPreceding, 0))
    return ratio(F.col(value), top) - 1


def path_metrics(df: DataFrame, keys: list[str], time: str, value: str, of: str = "return", per_year: float = 252.0, ddof: int = 1, downside: str = "std") -> DataFrame:
    """total, years, cagr, sharpe, sortino, max_dd, calmar of each key's path.

    of="return": value is a period's return. The total is the product of all 1 + r, less 1, years are known returns over
    per_year, and drawdowns are those of the value after each return (the 1 before the first one is no peak).
    of="equity": value is what the path is worth. The total is the last over the first worth, less 1, years are calendar
    days over 365.25, returns are changes from row to row.
    cagr is NULL where less than nothing is left; sharpe, sortino and calmar are 0 where they would divide by 0.
    """
    if of == "equity":
        path = df.withColumn("_value", F.col(value).cast("double")).withColumn("_ret", growth("_value", keys, time))
        total, years = F.max_by("_value", time) / F.min_by("_value", time) - 1, F.date_diff(F.max(time), F.min(time)) / 365.25
    else:
        path = df.withColumn("_ret", F.col(value).cast("double")).withColumn("_value", cumulated("_ret", keys, time))
        total, years = F.max_by("_value", time) - 1, F.count("_ret") / F.lit(per_year)
    low = F.stddev_samp(F.when(F.col("_ret") < 0, F.col("_ret"))) if downside == "std" else F.sqrt(F.avg(F.pow(F.least(F.col("_ret"), F.lit(0.0)), 2)))
    got = path.withColumn("_dd", drawdown("_value", keys, time)).groupBy(*keys).agg(
        total.alias("total"), years.alias("years"), F.avg("_ret").alias("_mean"), (F.stddev_samp("_ret") if ddof == 1 else F.stddev_pop("_ret")).alias("_sd"),
        low.alias("_low"), F.min("_dd").alias("max_dd"),
    )
    scale = math.sqrt(per_year)
    flat = F.coalesce(F.col("_sd"), F.lit(0.0)) == 0
    got = got.withColumn("cagr", F.when(F.col("total") >= -1, F.pow(1 + F.col("total"), 1 / F.greatest("years", F.lit(0.01))) - 1))
    got = got.withColumn("sharpe", F.when(flat, 0.0).otherwise(F.col("_mean") / F.col("_sd") * scale))
    got = got.withColumn("sortino", F.when(flat | ~F.coalesce(F.col("_low") > 0, F.lit(False)), 0.0).otherwise(F.col("_mean") / F.col("_low") * scale))
    got = got.withColumn("calmar", F.when(F.col("max_dd") != 0, F.col("cagr") / F.abs("max_dd")).otherwise(0.0))
    return got.select(*keys, "total", "years", "cagr", "sharpe", "sortino", "max_dd", "calmar")


def magnitude_bin(value: Column, steps: int = 64) -> Column:
    """A bin that does not fall as the value rises: `steps` bins for each doubling of |value| + 1, so that ranges of rows can be ordered apart."""
    return F.signum(value) * F.floor(F.log2(F.abs(value) + 1) * steps)


def average_rank(df: DataFrame, value: str, period: str | None, name: str) -> DataFrame:
    """Rank among a period's rows, ties sharing their mean rank: counts of each value, summed in order, joined back.

    Without a period all rows are ranked: bins of values are ordered each by itself, after the bins before it are counted.
    """
    if period is None:
        seen = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bin", magnitude_bin(F.col(value)))
        bins = seen.groupBy("_bin").agg(F.sum("_n").alias("_all"))
        before = bins.select("_bin", F.coalesce(F.sum("_all").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each bin
        run = F.sum("_n").over(Window.partitionBy("_bin").orderBy(value))
        ranks = seen.join(F.broadcast(before), "_bin").select(value, (F.col("_before") + run - (F.col("_n") - 1) / 2).alias(name))
        return df.join(ranks, value, "left")
    counts = df.where(F.col(value).isNotNull()).groupBy(period, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(period).orderBy(value)
    ranks = counts.withColumn(name, F.sum("_n").over(w) - (F.col("_n") - 1) / 2)
    return df.join(ranks.drop("_n"), [period, value], "left")


def islands(df: DataFrame, entity: str, number: str, label: str) -> DataFrame:
    """Runs of one label over consecutive numbers: first, last, length."""
    group = F.col(number) - F.row_number().over(Window.partitionBy(entity, label).orderBy(number))
    return df.withColumn("_run", group).groupBy(entity, label, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("length")).drop("_run")


def top_n(df: DataFrame, period: str, score: str, entity: str, n: int, above: float | None = None) -> DataFrame:
    """The n best of each period (ties by entity), with weight 1 / number chosen.

    Each period's rows are first cut within salted parts, so that no task orders a whole large period.
    """
    rows = df.where(F.col(score).isNotNull() if above is None else F.col(score) > above)
    salted = Window.partitionBy(period, "_salt").orderBy(F.desc(score), entity)
    best = rows.withColumn("_salt", F.pmod(F.xxhash64(entity), F.lit(32))).withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= n)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy(period).orderBy(F.desc(score), entity))).where(F.col("rank") <= n).drop("_salt", "_r")
    return best.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(period)))
