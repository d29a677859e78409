"""Registration of queries beside their SQL, and the inputs that many of them share, in Spark and in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.scalar import month_end, quarter_end
from panelwright.operators.durable import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Shared inputs as SQL; a query's text names those it needs, and they name others.
CTES = {
    "panel": "SELECT p_brand AS entity, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "cal": "SELECT DISTINCT day FROM panel",
    "ents": "SELECT DISTINCT entity FROM panel",
    "dense": "SELECT ents.entity, cal.day, price, volume FROM ents CROSS JOIN cal LEFT JOIN panel ON panel.entity = ents.entity AND panel.day = cal.day",
    "monthly": "SELECT entity, last_day(day) AS month, arg_max(price, day) AS price, sum(volume) AS volume FROM panel GROUP BY 1, 2",
    "macro": "SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 10000 AS value FROM orders GROUP BY 1, 2",
    "mmonth": "SELECT series, last_day(day) AS month, arg_max(value, day) AS value FROM macro GROUP BY 1, 2",
    "two": "SELECT month, max(CASE WHEN series = '1-URGENT' THEN value END) AS vix, max(CASE WHEN series = '2-HIGH' THEN value END) - 25 AS spread FROM mmonth GROUP BY 1",
    "facts": """SELECT p_brand AS entity, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS quarter,
        sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_extendedprice * (1 - l_discount)) - 0.6 * sum(p_retailprice * l_quantity) AS gross_profit,
        sum(p_retailprice * l_quantity) AS assets, sum(l_quantity) AS shares,
        sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS debt, sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS equity,
        sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS current_assets, sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS current_liabilities,
        sum(l_extendedprice * (1 - l_discount) * (1 - l_tax)) - 0.6 * sum(p_retailprice * l_quantity) AS operating_cf,
        sum(l_extendedprice * l_discount) AS capex, avg(l_discount) AS eps FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "news": "SELECT event_id, user_id AS key, CAST(ts AS TIMESTAMP) AS ts, CAST(ts AS DATE) AS day, event_type AS source, greatest(-1, least(1, (value - 50) / 50)) AS score, props FROM events",
    "fwd": "SELECT entity, month, price, lead(price) OVER (PARTITION BY entity ORDER BY month) / price - 1 AS fwd FROM monthly",
    "bench": "SELECT month, avg(fwd) AS bench FROM fwd WHERE fwd IS NOT NULL GROUP BY 1",
    "ret": "SELECT entity, month, price / lag(price) OVER (PARTITION BY entity ORDER BY month) - 1 AS ret FROM monthly",
    "scored": "SELECT entity, month, fwd, CASE WHEN fwd > bench THEN 1 ELSE 0 END AS label, (CAST(floor(price * 100 + 0.3) AS BIGINT) % 997) / 997.0 AS score FROM fwd JOIN bench USING (month) WHERE fwd IS NOT NULL",
    "index_ret": "SELECT month, avg(ret) AS ret FROM ret WHERE ret IS NOT NULL GROUP BY 1",
    "strat": "SELECT entity AS strategy, month, ret FROM ret WHERE ret IS NOT NULL",
}


def query(name: str, sql: str | None = None, doubles: str = "", dates: str = "", longs: str = ""):
    """Registers a query. In its result and in the SQL's doubles are rounded to 6 places, dates are text, integers are longs."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presented(fn(Tables(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            SQL[name] = full_sql(sql, doubles.split(), dates.split(), longs.split())
        return fn

    return add


def presented(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def full_sql(sql: str, doubles: list[str], dates: list[str], longs: list[str]) -> str:
    needed: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b{name}\b", text) and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text) and name not in needed:
                need(CTES[name])
                needed.append(name)

    need(sql)
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in needed)
    swaps = [f"round(CAST({c} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {c}" for c in doubles] + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs]
    body = f"SELECT *{f' REPLACE ({', '.join(swaps)})' if swaps else ''} FROM ({sql})"
    return f"WITH {ctes} {body}" if ctes else body


class Tables:
    """The given tables, and the panels derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def scratch(self) -> str:
        """A new folder that the driver and all executors share."""
        return scratch_dir(self.spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def lines(self) -> DataFrame:
        return self.read("lineitem").join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))

    @property
    def panel(self) -> DataFrame:
        keys = F.col("p_brand").alias("entity"), F.col("l_shipdate").cast("date").alias("day")
        return self.lines.groupBy(*keys).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"), F.sum("l_quantity").alias("volume"))

    @property
    def dense(self) -> DataFrame:
        from panelwright.operators.panel import densify

        return densify(self.panel)

    @property
    def monthly(self) -> DataFrame:
        return self.panel.groupBy("entity", month_end(F.col("day")).alias("month")).agg(F.max_by("price", "day").alias("price"), F.sum("volume").alias("volume"))

    @property
    def macro(self) -> DataFrame:
        return self.read("orders").groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("day")).agg((F.avg("o_totalprice") / 10000).alias("value"))

    @property
    def mmonth(self) -> DataFrame:
        return self.macro.groupBy("series", month_end(F.col("day")).alias("month")).agg(F.max_by("value", "day").alias("value"))

    @property
    def two(self) -> DataFrame:
        pick = lambda s: F.max(F.when(F.col("series") == s, F.col("value")))
        return self.mmonth.groupBy("month").agg(pick("1-URGENT").alias("vix"), (pick("2-HIGH") - 25).alias("spread"))

    @property
    def facts(self) -> DataFrame:
        when = lambda c, v: F.sum(F.when(F.col(c) == v, F.col("l_extendedprice")))
        net, cost = F.col("l_extendedprice") * (1 - F.col("l_discount")), 0.6 * F.sum(F.col("p_retailprice") * F.col("l_quantity"))
        return self.lines.groupBy(F.col("p_brand").alias("entity"), quarter_end(F.col("l_shipdate").cast("date")).alias("quarter")).agg(
            F.sum(net).alias("revenue"), (F.sum(net) - cost).alias("gross_profit"), F.sum(F.col("p_retailprice") * F.col("l_quantity")).alias("assets"),
            F.sum("l_quantity").alias("shares"), when("l_returnflag", "R").alias("debt"), when("l_returnflag", "N").alias("equity"),
            when("l_linestatus", "O").alias("current_assets"), when("l_linestatus", "F").alias("current_liabilities"),
            (F.sum(net * (1 - F.col("l_tax"))) - cost).alias("operating_cf"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("capex"), F.avg("l_discount").alias("eps"),
        )

    @property
    def news(self) -> DataFrame:
        score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 50))
        return self.read("events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("source"), score.alias("score"), "props")

    @property
    def fwd(self) -> DataFrame:
        from panelwright.operators.rolling import along

        return self.monthly.select("entity", "month", "price", (F.lead("price").over(along("entity", "month")) / F.col("price") - 1).alias("fwd"))

    @property
    def ret(self) -> DataFrame:
        from panelwright.operators.rolling import growth

        return self.monthly.select("entity", "month", growth("price", "entity", "month").alias("ret"))

    @property
    def scored(self) -> DataFrame:
        fwd = self.fwd.where("fwd is not null")
        bench = fwd.groupBy("month").agg(F.avg("fwd").alias("bench"))
        score = (F.floor(F.col("price") * 100 + 0.3).cast("long") % 997) / 997.0
        return fwd.join(bench, "month").select("entity", "month", "fwd", F.when(F.col("fwd") > F.col("bench"), 1).otherwise(0).alias("label"), score.alias("score"))
