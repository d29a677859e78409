"""Calendars, period ends, as-of joins and fills over long tables (entity, time, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a calendar or key list that may be broadcast; counted before it is.
MOST_SMALL = 1_000_000


def small(df: DataFrame, most: int = MOST_SMALL) -> DataFrame:
    """df with a broadcast hint if it has `most` rows or fewer, else as it is, for a shuffled join."""
    return F.broadcast(df) if len(df.limit(most + 1).agg(F.count(F.lit(1)).alias("n")).where(f"n > {most}").take(1)) == 0 else df


def densify(df: DataFrame, entity: str = "entity", time: str = "day") -> DataFrame:
    """A row for each entity and each time any entity has; absent values are NULL."""
    spine = df.select(entity).distinct().crossJoin(small(df.select(time).distinct()))
    return spine.join(df, [entity, time], "left")


def calendar(first: Column, last: Column, step: str = "interval 1 month") -> Column:
    """Period starts from first to last, for explode()."""
    return F.sequence(first, last, F.expr(step))


def last_known(df: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """The last value that is not missing, column by column, so that a row may mix source rows."""
    return df.groupBy(*keys).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(time))).alias(v) for v in values))


def to_period(df: DataFrame, period: Column, entity: str, time: str, values: list[str], name: str = "period") -> DataFrame:
    return last_known(df.withColumn(name, period), [entity, name], time, values)


def filled(value: Column, entity: str, time: str, most: int | None = None) -> Column:
    """The last known value, at most `most` rows back."""
    window = Window.partitionBy(entity).orderBy(time)
    return F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding if most is None else -most, 0))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], forward: bool = False, most_days: int | None = None, clamp: bool = False, at: str | None = None) -> DataFrame:
    """left with the last values of right at or before each row's time (forward: the first at or after), by one shuffle.

    Both sides are united and the known values carried along each key; a value older than most_days is NULL. Values of
    right that are NULL are passed over, column by column; of several rows of right at one time the greatest value counts.
    clamp: where nothing is found, the value at the end of the key, its last one (forward) or its first. at: a column for
    the time of the first value found, whatever its age.
    """
    names = [f"_{v}" for v in values]
    a = left.withColumns({n: F.lit(None).cast(right.schema[v].dataType) for n, v in zip(names, values, strict=True)} | {"_at": F.lit(None).cast(right.schema[time].dataType), "_side": F.lit(1)})
    b = right.select(*keys, time, *(F.col(v).alias(n) for n, v in zip(names, values, strict=True)), F.col(time).alias("_at"), F.lit(0).alias("_side"))
    rows = a.unionByName(b, allowMissingColumns=True)
    # Forward, time runs backward: what was carried so far then lies at or after a row.
    along = Window.partitionBy(*keys).orderBy(F.desc(time) if forward else time, "_side", *names).rowsBetween(Window.unboundedPreceding, 0)
    known = {v: F.when(F.col(n).isNotNull(), F.struct("_at", n)) for n, v in zip(names, values, strict=True)}
    got = rows.withColumns({f"_got_{v}": F.last(c, ignorenulls=True).over(along) for v, c in known.items()})
    if clamp:
        end = F.max if forward else F.min
        got = got.withColumns({f"_got_{v}": F.coalesce(f"_got_{v}", end(c).over(Window.partitionBy(*keys))) for v, c in known.items()})
    got = got.where("_side = 1")
    found = {}
    for n, v in zip(names, values, strict=True):
        fresh = F.lit(True) if most_days is None else F.abs(F.date_diff(F.col(time), F.col(f"_got_{v}._at"))) <= most_days
        found[v] = F.when(fresh, F.col(f"_got_{v}.{n}"))
    seen = {at: F.col(f"_got_{values[0]}._at")} if at else {}
    return got.withColumns(found | seen).select(*[c for c in left.columns if c not in values], *values, *seen)


def merge_left(spine: DataFrame, frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """The spine with the columns of every frame; all sides are dealt by the same keys, so they are shuffled once each."""
    return reduce(lambda a, b: a.join(b, keys, "left"), frames, spine)


def full_outer_series(frames: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """One column for each named frame, a row for each key any of them has: one shuffle instead of a chain of joins."""
    rows = reduce(DataFrame.unionByName, (df.select(*keys, F.lit(name).alias("_name"), value) for name, df in frames.items()))
    return rows.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in frames))


def reconcile(target: DataFrame, actual: DataFrame, key: str | list[str], band: float) -> DataFrame:
    """target(key, target), actual(key, actual): difference, side where it leaves the band, and turn: sells come first, they free the cash for buys."""
    both = target.join(actual, key, "full").fillna(0.0, ["target", "actual"]).withColumn("delta", F.col("target") - F.col("actual"))
    return both.withColumn("side", F.when(F.col("delta") < -band, "SELL").when(F.col("delta") > band, "BUY").otherwise("HOLD")).withColumn("turn", F.when(F.col("delta") < -band, 1).when(F.col("delta") > band, 2).otherwise(3))


def with_fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All of first, and of second the keys that first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def mirrored(df: DataFrame, entity: str, source: str, copy: str) -> DataFrame:
    """The rows of one entity also stand for another one, whose own rows go."""
    return df.where(F.col(entity) != copy).unionByName(df.where(F.col(entity) == source).withColumn(entity, F.lit(copy)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
