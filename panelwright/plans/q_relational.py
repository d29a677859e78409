"""Queries over sources, filters, joins and sets: SRC, SNK, FLT, JN, SET, TK."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.scalar import content_key, ratio
from panelwright.operators import panel as P
from panelwright.operators import rolling as R
from panelwright.plans.registry import Tables, query

# Sources


@query("src1_price_scan", "SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, l_extendedprice FROM lineitem WHERE l_suppkey IN (1, 2, 3) AND l_shipdate >= '1996-01-01' AND l_shipdate < '1998-01-01'", "l_extendedprice", "day")
def src1(t: Tables):
    rows = t.read("lineitem").where(F.col("l_suppkey").isin(1, 2, 3) & (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    return rows.select("l_partkey", F.col("l_shipdate").cast("date").alias("day"), "l_extendedprice")


@query("src2_series_scan", "SELECT o_orderpriority AS series, o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", "o_totalprice")
def src2(t: Tables):
    return t.read("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderpriority").alias("series"), "o_orderkey", "o_totalprice")


@query("src6_parquet_scan", "SELECT c_custkey, c_acctbal FROM customer", "c_acctbal")
def src6(t: Tables):
    return t.read("customer").select("c_custkey", "c_acctbal")


@query("src15_keys_minus_denied", "SELECT DISTINCT c_mktsegment AS key FROM customer WHERE c_mktsegment NOT IN (SELECT min(c_mktsegment) FROM customer)")
def src15(t: Tables):
    keys = t.read("customer").select(F.col("c_mktsegment").alias("key")).distinct()
    return keys.join(keys.agg(F.min("key").alias("key")), "key", "left_anti")


# Sinks


@query("snk1_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 < 5 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders", "o_totalprice")
def snk1(t: Tables):
    """A table written, and new rows put in by key; they touch five of its seven partitions."""
    from panelwright.sources.sinks import upsert

    path = t.scratch()
    old = t.read("orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 7).cast("int").alias("part"))
    new = old.where("o_orderkey % 3 = 0 and part < 5").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    for rows in (old, new):
        upsert(t.spark, path, rows, ["part", "o_orderkey"], "part")
    return t.spark.read.parquet(path).select("o_orderkey", "o_totalprice")


@query("snk2_insert_absent", "SELECT p_name, p_brand, CASE WHEN bool_or(p_partkey % 2 = 0) THEN 'first' ELSE 'second' END AS run FROM part GROUP BY 1, 2")
def snk2(t: Tables):
    """Two runs of a write-once sink: the second brings all rows, and what the first one wrote stays as it is."""
    from panelwright.sources.sinks import insert_absent

    path = t.scratch()
    rows = t.read("part").select("p_partkey", "p_name", "p_brand", content_key(F.col("p_name"), F.col("p_brand")).alias("hash"))
    for run, part in (("first", rows.where("p_partkey % 2 = 0")), ("second", rows)):
        insert_absent(t.spark, path, part.select("hash", "p_name", "p_brand", F.lit(run).alias("run")), ["hash"])
    return t.spark.read.parquet(path).select("p_name", "p_brand", "run")


@query("snk6_nested_holdings", "SELECT month, array_to_string(list(entity || ':' || rank ORDER BY rank), ',') AS holdings FROM (SELECT entity, month, row_number() OVER (PARTITION BY month ORDER BY score DESC, entity) AS rank FROM scored) WHERE rank <= 3 GROUP BY 1", "", "month")
def snk6(t: Tables):
    held = R.top_n(t.scored, "month", "score", "entity", 3)
    got = held.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("rank", "entity"))).alias("h"))
    return got.select("month", F.array_join(F.transform("h", lambda x: F.concat_ws(":", x["entity"], x["rank"])), ",").alias("holdings"))


# Filters

STEPS = {"segment": "c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')", "balance": "c_acctbal >= 1000", "nation": "c_nationkey < 20"}


@query("flt1_screen_counts", f"SELECT count(*) AS n, count(*) FILTER ({STEPS['segment']}) AS after_segment, count(*) FILTER ({STEPS['segment']} AND {STEPS['balance']}) AS after_balance, count(*) FILTER ({' AND '.join(STEPS.values())}) AS after_nation FROM customer")
def flt1(t: Tables):
    """Survivors after each step of a conjunctive screen, in one pass."""
    so_far, counts = F.lit(True), [F.count(F.lit(1)).alias("n")]
    for name, step in STEPS.items():
        so_far = so_far & F.coalesce(F.expr(step), F.lit(False))
        counts.append(F.count_if(so_far).alias(f"after_{name}"))
    return t.read("customer").agg(*counts)


@query("flt2_product_threshold", "SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS traded FROM lineitem WHERE l_quantity * l_extendedprice > 1000000", "traded", "", "l_linenumber")
def flt2(t: Tables):
    return t.read("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * F.col("l_extendedprice")).alias("traded")).where("traded > 1000000")


@query("flt3_null_or_bound", "SELECT p_partkey, d FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE DATE '2000-01-01' + CAST(p_size AS INTEGER) END AS d FROM part) WHERE d IS NULL OR d <= DATE '2000-01-20'", "", "d")
def flt3(t: Tables):
    raw = F.when(F.col("p_size") % 5 == 0, "no date").otherwise(F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size")).cast("string"))
    d = raw.try_cast("date")
    return t.read("part").select("p_partkey", d.alias("d")).where("d is null or d <= date '2000-01-20'")


@query("flt4_weighted_count", "SELECT l_suppkey AS key, sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 4 ELSE 0 END) AS quarters FROM lineitem GROUP BY 1 HAVING sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 4 ELSE 0 END) >= 8", "", "", "quarters")
def flt4(t: Tables):
    weight = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 4).otherwise(0)
    return t.read("lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.sum(weight).alias("quarters")).where("quarters >= 8")


@query("flt5_enough_observations", "SELECT entity, day, price FROM panel WHERE entity IN (SELECT entity FROM panel GROUP BY 1 HAVING count(*) >= 200)", "price", "day")
def flt5(t: Tables):
    enough = t.panel.groupBy("entity").count().where("count >= 200")
    return t.panel.join(enough, "entity", "left_semi").select("entity", "day", "price")


MISS = "CASE WHEN debt IS NULL THEN 1 ELSE 0 END + CASE WHEN equity IS NULL THEN 1 ELSE 0 END + CASE WHEN current_assets IS NULL THEN 1 ELSE 0 END + CASE WHEN current_liabilities IS NULL THEN 1 ELSE 0 END"


@query("flt6_mostly_known", f"SELECT entity, quarter FROM facts WHERE ({MISS}) / 4.0 <= 0.25", "", "quarter")
def flt6(t: Tables):
    missing = sum(F.col(c).isNull().cast("int") for c in ("debt", "equity", "current_assets", "current_liabilities"))
    return t.facts.where(missing / 4 <= 0.25).select("entity", "quarter")


@query("flt7_drop_missing", "SELECT 'any' AS how, entity, quarter FROM facts WHERE debt IS NOT NULL AND equity IS NOT NULL UNION ALL SELECT 'all', entity, quarter FROM facts WHERE debt IS NOT NULL OR equity IS NOT NULL", "", "quarter")
def flt7(t: Tables):
    keep = lambda how: t.facts.dropna("any" if how == "any" else "all", subset=["debt", "equity"]).select(F.lit(how).alias("how"), "entity", "quarter")
    return keep("any").unionByName(keep("all"))


@query("flt8_date_range", "SELECT entity, month, price FROM monthly WHERE month BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'", "price", "month")
def flt8(t: Tables):
    return t.monthly.where("month between date '1997-01-01' and date '1998-12-31'").select("entity", "month", "price")


@query("flt10_long_enough", r"SELECT doc_id, len(string_split_regex(trim(text), '\s+')) AS words FROM documents WHERE length(text) >= 500 AND len(string_split_regex(trim(text), '\s+')) >= 100", "", "", "words")
def flt10(t: Tables):
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return t.read("documents").where((F.length("text") >= 500) & (words >= 100)).select("doc_id", words.alias("words"))


@query("flt11_complete_periods", "SELECT entity, last_day(day) AS month, count(*) AS n FROM panel WHERE last_day(day) <= (SELECT max(day) FROM panel) GROUP BY 1, 2", "", "month", "n")
def flt11(t: Tables):
    end = t.panel.agg(F.max("day").alias("end"))
    rows = t.panel.withColumn("month", F.last_day("day")).join(F.broadcast(end), F.col("month") <= F.col("end"))
    return rows.groupBy("entity", "month").agg(F.count(F.lit(1)).alias("n"))


@query("flt12_unique_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", "", "", "l_linenumber n")
def flt12(t: Tables):
    return P.duplicate_keys(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


# Joins


@query("jn1_left_merge", "SELECT s.entity, s.month, m.price, r.ret FROM (SELECT entity, month FROM monthly) s LEFT JOIN monthly m USING (entity, month) LEFT JOIN ret r USING (entity, month)", "price ret", "month")
def jn1(t: Tables):
    keys = ["entity", "month"]
    return P.merge_left(t.monthly.select(*keys), [t.monthly.select(*keys, "price"), t.ret.select(*keys, "ret")], keys)


@query("jn2_period_values", "SELECT m.entity, m.month, two.vix FROM monthly m LEFT JOIN two USING (month)", "vix", "month")
def jn2(t: Tables):
    return t.monthly.select("entity", "month").join(P.small(t.two.select("month", "vix")), "month", "left")


@query("jn3_full_outer", "SELECT month, a.value AS urgent, b.value AS high FROM (SELECT * FROM mmonth WHERE series = '1-URGENT') a FULL JOIN (SELECT * FROM mmonth WHERE series = '2-HIGH') b USING (month)", "urgent high", "month")
def jn3(t: Tables):
    pick = lambda s: t.mmonth.where(F.col("series") == s)
    return P.full_outer_series({"urgent": pick("1-URGENT"), "high": pick("2-HIGH")}, ["month"], "value")


@query("jn4_spine", "SELECT entity, count(*) AS days, count(price) AS filled FROM dense GROUP BY 1", "", "", "days filled")
def jn4(t: Tables):
    return t.dense.groupBy("entity").agg(F.count(F.lit(1)).alias("days"), F.count("price").alias("filled"))


SPREAD = "(SELECT p.entity, p.day, s.series FROM panel p CROSS JOIN (SELECT DISTINCT series FROM macro) s) p"
ASOF = f"SELECT p.entity, p.day, p.series, {{1}} FROM {SPREAD} ASOF LEFT JOIN macro m ON p.series = m.series AND p.day {{0}} m.day"


def _macro_as_of(t: Tables, **how):
    """Macro values are the same for all entities: each series is looked up once a day, then joined."""
    days = t.panel.select("day").distinct().crossJoin(P.small(t.macro.select("series").distinct()))
    found = P.as_of(days, t.macro, ["series"], "day", ["value"], **how)
    return t.panel.select("entity", "day").join(found, "day", "left")


@query("jn5_as_of_backward", ASOF.format(">=", "m.value"), "value", "day")
def jn5(t: Tables):
    return _macro_as_of(t).select("entity", "day", "series", "value")


@query("jn6_as_of_forward", f"SELECT entity, day, series, coalesce(value, last) AS value FROM ({ASOF.format('<=', 'm.value')}) JOIN (SELECT series, arg_max(value, day) AS last FROM macro GROUP BY 1) USING (series)", "value", "day")
def jn6(t: Tables):
    """The first value at or after each day; past a series' end its last one."""
    return _macro_as_of(t, forward=True, clamp=True).select("entity", "day", "series", "value")


@query("jn7_as_of_stale", ASOF.format(">=", "CASE WHEN p.day - m.day <= 1 THEN m.value END AS value, coalesce(p.day - m.day > 1, FALSE) AS stale"), "value", "day")
def jn7(t: Tables):
    """The last value of each series; one older than a day is NULL and flagged."""
    rows = _macro_as_of(t, most_days=1, at="seen")
    return rows.select("entity", "day", "series", "value", F.coalesce(F.date_diff("day", "seen") > 1, F.lit(False)).alias("stale"))


@query("jn8_latest_value", "SELECT series, max(day) AS day, arg_max(value, day) AS value FROM macro GROUP BY 1", "value", "day")
def jn8(t: Tables):
    return t.macro.groupBy("series").agg(F.max_by(F.struct("day", "value"), F.when(F.col("value").isNotNull(), F.col("day"))).alias("x")).select("series", "x.day", "x.value")


@query("jn9_unprocessed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn9(t: Tables):
    return t.read("documents").select("doc_id").join(t.read("labels").select("doc_id"), "doc_id", "left_anti")


@query("jn10_has_data", f"SELECT s.entity, s.month FROM scored s WHERE s.score > 0.5 AND EXISTS (SELECT 1 FROM ret r WHERE r.entity = s.entity AND r.month = s.month AND r.ret IS NOT NULL)", "", "month")
def jn10(t: Tables):
    return t.scored.where("score > 0.5").join(t.ret.where("ret is not null"), ["entity", "month"], "left_semi").select("entity", "month")


TOP = "SELECT entity, month, score, r AS rank, 1.0 / count(*) OVER (PARTITION BY month) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, entity) AS r FROM scored WHERE score > 0.52) WHERE r <= 5"
FOLDS = "SELECT month AS test_month, row_number() OVER (ORDER BY month) AS i FROM (SELECT DISTINCT month FROM scored)"


@query("jn11_expanding_windows", f"SELECT f.test_month, count(*) AS n, avg(s.fwd) AS mean FROM ({FOLDS}) f JOIN ({FOLDS}) e ON e.i = f.i - 3 JOIN scored s ON s.month <= e.test_month WHERE f.i > 39 GROUP BY 1", "mean", "test_month", "n")
def jn11(t: Tables):
    """Each fold's training rows are all rows up to its end: monthly sums, joined to the folds that hold the month."""
    return of_folds(t, None)


@query("jn11b_trailing_windows", f"SELECT f.test_month, count(*) AS n, avg(s.fwd) AS mean FROM ({FOLDS}) f JOIN ({FOLDS}) e ON e.i = f.i - 3 JOIN ({FOLDS}) a ON a.i = greatest(1, f.i - 3 - 24 + 1) JOIN scored s ON s.month BETWEEN a.test_month AND e.test_month WHERE f.i > 39 GROUP BY 1", "mean", "test_month", "n")
def jn11b(t: Tables):
    """The same for windows of the last 24 months."""
    return of_folds(t, 24)


def of_folds(t: Tables, trailing: int | None):
    from panelwright.operators.models import folds

    sums = t.scored.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("fwd").alias("s"))
    windows = folds(t.scored.select("month").distinct(), "month", 36, 3, trailing)
    both = windows.join(P.small(sums), F.col("month").between(F.col("train_start"), F.col("train_end")))  # months with months
    return both.groupBy("test_month").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))


@query("jn12_reconcile", f"""SELECT month, entity, coalesce(t.weight, 0) AS target, coalesce(a.weight, 0) AS actual, CASE WHEN coalesce(t.weight, 0) - coalesce(a.weight, 0) < -0.0025 THEN 'SELL' WHEN coalesce(t.weight, 0) - coalesce(a.weight, 0) > 0.0025 THEN 'BUY' ELSE 'HOLD' END AS side,
 CASE WHEN coalesce(t.weight, 0) - coalesce(a.weight, 0) < -0.0025 THEN 1 WHEN coalesce(t.weight, 0) - coalesce(a.weight, 0) > 0.0025 THEN 2 ELSE 3 END AS turn FROM (SELECT month, entity, weight FROM ({TOP})) t FULL JOIN (SELECT last_day(month + INTERVAL 1 MONTH) AS month, entity, weight FROM ({TOP})) a USING (month, entity)""", "target actual", "month", "turn")
def jn12(t: Tables):
    """Each month's weights against those of the month before."""
    held = R.top_n(t.scored, "month", "score", "entity", 5, 0.52).select("month", "entity", "weight")
    before = held.select(F.last_day(F.add_months("month", 1)).alias("month"), "entity", F.col("weight").alias("actual"))
    return P.reconcile(held.withColumnRenamed("weight", "target"), before, ["month", "entity"], 0.0025).drop("delta")


@query("jn13_mirror", "SELECT entity, month, price FROM monthly WHERE entity <> 'Brand#12' UNION ALL SELECT 'Brand#12', month, price FROM monthly WHERE entity = 'Brand#11'", "price", "month")
def jn13(t: Tables):
    return P.mirrored(t.monthly.select("entity", "month", "price"), "entity", "Brand#11", "Brand#12")


@query("jn14_inner_align", "SELECT m.entity, m.month, m.price, f.fwd FROM monthly m JOIN (SELECT * FROM fwd WHERE fwd IS NOT NULL) f ON f.entity = m.entity AND f.month = m.month", "price fwd", "month")
def jn14(t: Tables):
    return t.monthly.select("entity", "month", "price").join(t.fwd.where("fwd is not null").select("entity", "month", "fwd"), ["entity", "month"])


@query("jn15_enrich", "SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jn15(t: Tables):
    place = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.read("customer").join(P.small(place), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_mktsegment", "n_name", "r_name")


@query("jn16_fallback", "SELECT entity, quarter, gross_profit AS value, 'a' AS src FROM facts WHERE debt IS NOT NULL UNION ALL SELECT entity, quarter, revenue, 'b' FROM facts WHERE debt IS NULL", "value", "quarter")
def jn16(t: Tables):
    a = t.facts.where("debt is not null").select("entity", "quarter", F.col("gross_profit").alias("value"), F.lit("a").alias("src"))
    b = t.facts.select("entity", "quarter", F.col("revenue").alias("value"), F.lit("b").alias("src"))
    return P.with_fallback(a, b, ["entity", "quarter"])


# Sets


@query("set1_union_all", "SELECT c_custkey AS key, c_acctbal AS value FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier", "value")
def set1(t: Tables):
    return t.read("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")).unionByName(t.read("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value")))


@query("set2_union_distinct", "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier", "", "", "key")
def set2(t: Tables):
    return t.read("customer").select(F.col("c_nationkey").alias("key")).union(t.read("supplier").select("s_nationkey")).distinct()


@query("set3_requested_keys", "SELECT DISTINCT p_brand AS key FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'no brand')")
def set3(t: Tables):
    """The requested keys that exist, or all requested ones if none does."""
    asked = t.spark.createDataFrame([("Brand#11",), ("Brand#22",), ("no brand",)], "key string")
    found = t.read("part").select(F.col("p_brand").alias("key")).intersect(asked)
    return found.unionByName(asked.join(F.broadcast(found.agg(F.count("key").alias("n"))), F.col("n") == 0).select("key"))


@query("set4_difference", "SELECT DISTINCT p_brand AS key FROM part EXCEPT SELECT 'Brand#11'")
def set4(t: Tables):
    return t.read("part").select(F.col("p_brand").alias("key")).subtract(t.spark.createDataFrame([("Brand#11",)], "key string"))


# Top-k

@query("tk1_top_per_period", TOP, "score weight", "month", "rank")
def tk1(t: Tables):
    return R.top_n(t.scored, "month", "score", "entity", 5, 0.52).select("entity", "month", "score", "rank", "weight")


@query("tk2_global_top", "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)", "o_totalprice")
def tk2(t: Tables):
    return t.read("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("tk3_work_queue", "SELECT key, source, rank, lag, row_number() OVER (ORDER BY rank, lag DESC, key, source) AS place FROM (SELECT key, source, CASE WHEN count(*) >= 5 THEN 1 ELSE 0 END AS rank, DATE '2024-01-31' - max(day) AS lag FROM news GROUP BY 1, 2) QUALIFY place <= 100", "", "", "rank lag place")
def tk3(t: Tables):
    """The 100 windows served next: unfinished before stale ones, longest lag first."""
    w = t.news.groupBy("key", "source").agg(F.when(F.count(F.lit(1)) >= 5, 1).otherwise(0).alias("rank"), F.date_diff(F.lit("2024-01-31").cast("date"), F.max("day")).alias("lag"))
    queue = w.orderBy("rank", F.desc("lag"), "key", "source").limit(100)
    from pyspark.sql import Window

    return queue.withColumn("place", F.row_number().over(Window.orderBy("rank", F.desc("lag"), "key", "source")))


@query("tk4_snapshot", "SELECT entity, quarter, revenue FROM facts WHERE quarter = (SELECT max(quarter) FROM facts WHERE quarter <= DATE '1998-05-15')", "revenue", "quarter")
def tk4(t: Tables):
    last = t.facts.where("quarter <= date '1998-05-15'").agg(F.max("quarter").alias("quarter"))
    return t.facts.join(F.broadcast(last), "quarter", "left_semi").select("entity", "quarter", "revenue")


@query("tk5_latest_row", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def tk5(t: Tables):
    return t.read("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("tk6_latest_known", "SELECT entity, max(quarter) AS quarter, arg_max(debt, quarter) AS debt, arg_max(equity, quarter) AS equity FROM (SELECT * FROM facts WHERE debt IS NOT NULL AND equity IS NOT NULL) GROUP BY 1", "debt equity", "quarter")
def tk6(t: Tables):
    known = t.facts.dropna("any", subset=["debt", "equity"])
    return known.groupBy("entity").agg(F.max_by(F.struct("quarter", "debt", "equity"), "quarter").alias("x")).select("entity", "x.*")


@query("tk7_first_alternative", "SELECT entity, quarter, coalesce(debt, equity, revenue) AS value, CASE WHEN debt IS NOT NULL THEN 'debt' WHEN equity IS NOT NULL THEN 'equity' ELSE 'revenue' END AS tag FROM facts", "value", "quarter")
def tk7(t: Tables):
    names = ("debt", "equity", "revenue")
    tag = F.coalesce(*(F.when(F.col(n).isNotNull(), F.lit(n)) for n in names))
    return t.facts.select("entity", "quarter", F.coalesce(*names).alias("value"), tag.alias("tag"))


NEAR = """SELECT q, vec_id, collection, sim FROM (SELECT a.vec_id AS q, b.vec_id, b.label % 3 AS collection, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"""


@query("tk8_nearest_vectors", f"SELECT q, collection, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY q, collection ORDER BY sim DESC, vec_id) AS r FROM ({NEAR})) WHERE r <= 3", "sim", "", "collection")
def tk8(t: Tables):
    from panelwright.operators.vectors import nearest

    rows = t.read("embeddings").select("vec_id", "embedding", (F.col("label") % 3).alias("collection"))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))
    return nearest(rows, queries, 3, ["collection"])


@query("tk8b_nearest_overall", f"SELECT q, collection, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS r FROM ({NEAR})) WHERE r <= 5", "sim", "", "collection")
def tk8b(t: Tables):
    """The best of all collections together, through an index that leaves out cells without a neighbour."""
    from panelwright.operators.index import VectorIndex

    rows = t.read("embeddings").select("vec_id", "embedding", (F.col("label") % 3).alias("collection"))
    best, _ = VectorIndex(rows).nearest(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe")), 5)
    return best.join(rows.select("vec_id", "collection"), "vec_id")


@query("tk9_filtered_retrieval", f"SELECT q, vec_id, sim, 'doc ' || vec_id || ' | c' || collection AS citation FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS r FROM (SELECT *, max(CASE WHEN collection = q % 4 THEN 1 ELSE 0 END) OVER (PARTITION BY q) AS has FROM ({NEAR})) WHERE has = 0 OR collection = q % 4) WHERE r <= 4", "sim")
def tk9(t: Tables):
    """The best of the wanted collection, or of all where it holds nothing."""
    from panelwright.operators.vectors import nearest

    rows = t.read("embeddings").select("vec_id", "embedding", (F.col("label") % 3).alias("collection"))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe"))
    best = nearest(rows, queries, 4, ["collection"])
    from pyspark.sql import Window

    wanted = best.withColumn("has", F.max((F.col("collection") == F.col("q") % 4).cast("int")).over(Window.partitionBy("q"))).where("has = 0 or collection = q % 4")
    top = wanted.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "vec_id"))).where("r <= 4")
    return top.select("q", "vec_id", "sim", F.concat(F.lit("doc "), "vec_id", F.lit(" | c"), "collection").alias("citation"))


@query("tk10_sample_per_group", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('42-' || event_id) DESC, event_id) AS r FROM events) WHERE r <= 5")
def tk10(t: Tables):
    """Five rows of each type in a random order that a seed and the id settle: a sample is the feature here, and a lost executor does not change it."""
    rows = t.read("events").select("event_type", "event_id", F.md5(F.concat(F.lit("42-"), "event_id")).alias("u"))
    return R.top_n(rows, "event_type", "u", "event_id", 5).select("event_type", "event_id")


@query("fn10_safe_ratio", "SELECT entity, quarter, debt / nullif(equity, 0) AS r FROM facts", "r", "quarter")
def fn10(t: Tables):
    return t.facts.select("entity", "quarter", ratio(F.col("debt"), F.col("equity")).alias("r"))


REGIME_SQL = "CASE WHEN vix > 25 OR (vix > 20 AND spread < 0) THEN 0.5 WHEN vix < 20 AND spread > 0 THEN 1.2 ELSE 1.0 END"
