"""Queries over readers and sinks that work on files: each derives the files from the given tables, writes them and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import models as M
from panelwright.operators import rolling as R
from panelwright.operators.durable import saved
from panelwright.plans.q_windows import METRICS, metrics_sql
from panelwright.plans.registry import Tables, query
from panelwright.sources import readers as RD
from panelwright.sources import sinks as SK

# Sources


@query("src3_read_or_empty", "SELECT s_suppkey, n_name, CAST(NULL AS DOUBLE) AS ratio FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey", "ratio")
def src3(t: Tables):
    """A table that is there and one that is not, joined alike."""
    there = RD.read_or_empty(t.spark, f"{t.dir}/nation.parquet", "n_nationkey int, n_name string")
    absent = RD.read_or_empty(t.spark, f"{t.dir}/no_such_table.parquet", "s_suppkey long, ratio double")
    rows = t.read("supplier").join(there, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(absent, "s_suppkey", "left")
    return rows.select("s_suppkey", "n_name", "ratio")


@query("src4_optional_columns", "SELECT c_custkey, c_acctbal, CAST(NULL AS DOUBLE) AS c_limit, CAST(NULL AS VARCHAR) AS c_since FROM customer", "c_acctbal c_limit")
def src4(t: Tables):
    return RD.with_optional(t.read("customer").select("c_custkey", "c_acctbal"), {"c_acctbal": "double", "c_limit": "double", "c_since": "string"})


@query("src5_csv_dimension", "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS listed FROM orders", "", "listed")
def src5(t: Tables):
    """A CSV with a header; its dates are parsed, bad ones are NULL."""
    path = t.scratch()
    day = F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    SK.write_csv(t.read("orders").select("o_orderkey", "o_orderpriority", day.alias("listed")), path)
    rows = RD.read_csv(t.spark, path, "o_orderkey long, o_orderpriority string, listed string")
    return rows.withColumn("listed", F.col("listed").try_cast("date"))


@query("src7_bulk_articles", """SELECT upper(source) AS ticker, strftime(DATE '2020-01-01' + CAST(doc_id % 400 AS INTEGER), '%Y-%m-%d') || ' 06:30:54' AS published_at, 'A "quoted", ' || doc_id || chr(10) || 'title' AS title, nullif(substr(t, 1, 2000), '') AS snippet
 FROM (SELECT *, regexp_replace(regexp_replace(replace(text, chr(13), ' '), '^\\s+|\\s+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents) WHERE doc_id % 10 <> 0 AND doc_id % 400 < 366 AND source IN (SELECT DISTINCT source FROM documents WHERE lang = 'en')""")
def src7(t: Tables):
    """Bulk CSV with quoted fields of many lines; rows of known symbols within dates, rows whose date cannot be read dropped."""
    path = t.scratch()
    docs = t.read("documents").withColumn("text", F.replace("text", F.lit("\r"), F.lit(" ")))
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd")
    when = F.when(F.col("doc_id") % 10 == 0, "no date").otherwise(F.concat(day, F.lit(" 06:30:54 UTC")))
    title = F.concat(F.lit('A "quoted", '), "doc_id", F.lit("\ntitle"))
    raw = docs.select(when.alias("Date"), title.alias("Article_title"), F.col("source").alias("Stock_symbol"), F.col("text").alias("Article"), F.lit(None).cast("string").alias("Lsa_summary"))
    SK.write_csv(raw, path)
    rows = RD.read_csv(t.spark, path, "Date string, Article_title string, Stock_symbol string, Article string, Lsa_summary string", multiline=True)
    universe = t.read("documents").where("lang = 'en'").select(F.upper("source").alias("ticker")).distinct()
    got = RD.articles(rows, universe, "2020-01-01", "2020-12-31 23:59:59")
    return got.select("ticker", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "title", "snippet")


def _facts_json(t: Tables) -> DataFrame:
    """(entity, json): filings' facts as nested JSON, one text for each entity (its quarters bound it)."""
    entry = lambda v, form: F.collect_list(F.when(F.col(v).isNotNull(), F.struct(F.col("quarter").cast("string").alias("end"), F.col(v).alias("val"), F.lit(form).alias("form"))))
    own = t.facts.groupBy("entity").agg(entry("revenue", "10-Q").alias("a"), entry("debt", "10-K").alias("b"))
    tags = F.struct(F.struct(F.struct(F.col("a").alias("USD")).alias("units")).alias("Revenues"), F.struct(F.struct(F.col("b").alias("USD")).alias("units")).alias("Debt"))
    return own.select("entity", F.to_json(F.struct(F.struct(tags.alias("us-gaap")).alias("facts"))).alias("json"))


FACTS = "SELECT entity, 'us-gaap' AS namespace, {0} AS tag, 'USD' AS unit, quarter AS period_end, {1} AS val, {2} AS form FROM facts WHERE {1} IS NOT NULL"
FACTS = FACTS.format("'Revenues'", "revenue", "'10-Q'") + " UNION ALL " + FACTS.format("'Debt'", "debt", "'10-K'")


@query("src8_company_facts", FACTS, "val", "period_end")
def src8(t: Tables):
    """Nested JSON documents, read as text and taken apart: namespace, tag, unit, entries."""
    path = t.scratch()
    _facts_json(t).write.parquet(path)
    return RD.company_facts(t.spark.read.parquet(path), "entity", "json").select("entity", "namespace", "tag", "unit", F.col("end").alias("period_end"), "val", "form")


@query("src8b_facts_by_priority", "SELECT entity, quarter AS period_end, coalesce(debt, revenue) AS val, CASE WHEN debt IS NOT NULL THEN 'Debt' ELSE 'Revenues' END AS tag FROM facts WHERE coalesce(debt, revenue) IS NOT NULL", "val", "period_end")
def src8b(t: Tables):
    """Of a period's alternative tags the first wanted one."""
    facts = RD.company_facts(_facts_json(t), "entity", "json")
    return RD.by_priority(facts, ["entity", "end"], "tag", ["Debt", "Revenues"]).select("entity", F.col("end").alias("period_end"), "val", "tag")


@query("src9_filing_index", """SELECT o_custkey AS key, form, day AS filed, CAST(o_orderkey AS VARCHAR) AS accession FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
 WHERE form IN ('10-K', '10-Q') AND day BETWEEN '1994-01-01' AND '1997-12-31' AND o_orderkey % 7 <> 0""")
def src9(t: Tables):
    """Parallel arrays of a filing index to rows: wanted forms and dates, incomplete ones dropped."""
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K")
    day, number = F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderkey").cast("string"))
    one = F.struct(form.alias("form"), day.alias("filingDate"), number.alias("accessionNumber"), F.lit("main.htm").alias("primaryDocument"), day.alias("reportDate"))
    index = t.read("orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list(one).alias("r"))
    names = ("form", "filingDate", "accessionNumber", "primaryDocument", "reportDate")
    raw = index.select("key", F.to_json(F.struct(*(F.col(f"r.{n}").alias(n) for n in names))).alias("json"))
    read = raw.select("key", F.from_json("json", ", ".join(f"{n} array<string>" for n in names)).alias("recent"))
    got = RD.filing_index(read, "key", "recent", ["10-K", "10-Q"], "1994-01-01", "1997-12-31")
    return got.select("key", "form", F.col("filingDate").alias("filed"), F.col("accessionNumber").alias("accession"))


@query("src10_news_feed", """SELECT 'K' || user_id AS ticker, CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS published_at, event_type AS title, props AS snippet, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 100) / 100.0 END AS relevance FROM events""", "relevance")
def src10(t: Tables):
    """Feed pages as JSON; each row's ticker finds its own relevance in a nested array, bad times and numbers are NULL."""
    when = F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss"))
    ticker, value = F.concat(F.lit("k"), "user_id"), F.when(F.col("event_id") % 5 == 0, "none").otherwise((F.col("event_id") % 100 / 100).cast("string"))
    said = F.array(F.struct(F.lit("OTHER").alias("ticker"), F.lit("0.9").alias("relevance_score")), F.struct(ticker.alias("ticker"), value.alias("relevance_score")))
    item = F.struct(when.alias("time_published"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("title"), F.col("props").alias("summary"), F.lit("site").alias("source_domain"), said.alias("ticker_sentiment"))
    raw = t.read("events").select(F.upper(ticker).alias("ticker"), F.to_json(F.struct(F.array(item).alias("feed"))).alias("json"))
    got = RD.news_feed(raw, "ticker", "json")
    return got.select("ticker", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "title", "snippet", "relevance")


@query("src11_short_volume", "SELECT entity AS ticker, day AS date, floor(volume * 0.4) AS short_volume, CASE WHEN month(day) <> 2 THEN volume END AS total_volume, CASE WHEN month(day) <> 2 THEN floor(volume * 0.4) / nullif(volume, 0) END AS short_ratio FROM panel", "short_volume total_volume short_ratio", "date")
def src11(t: Tables):
    """Pipe-delimited text; numbers that cannot be read are NULL."""
    path = t.scratch()
    total = F.when(F.month("day") == 2, "x").otherwise(F.col("volume").cast("string"))
    raw = t.panel.select(F.date_format("day", "yyyyMMdd").alias("Date"), F.col("entity").alias("Symbol"), F.floor(F.col("volume") * 0.4).alias("ShortVolume"), total.alias("TotalVolume"))
    raw.write.option("header", True).option("sep", "|").csv(path)
    return RD.short_volume(RD.read_csv(t.spark, path, "Date string, Symbol string, ShortVolume string, TotalVolume string", sep="|"))


@query("src12_compact_json", "SELECT entity, CAST(quarter AS VARCHAR) AS period, eps AS value FROM facts", "value")
def src12(t: Tables):
    """Columns-and-data JSON; the value column is found by its name."""
    row = F.array(F.col("entity"), F.col("quarter").cast("string"), F.col("eps").cast("string"))
    doc = t.facts.groupBy("entity").agg(F.collect_list(row).alias("data"))
    columns = F.array(*map(F.lit, ("Ticker", "Fiscal Period", "EPS (Diluted)")))
    raw = doc.select("entity", F.to_json(F.struct(columns.alias("columns"), "data")).alias("json"))
    return RD.compact_column(raw, "entity", "json", "eps")


@query("src13_notes", "SELECT 'nation=' || s_nationkey AS section, CAST(s_suppkey AS VARCHAR) AS key, '[a: b]' AS tags, s_name || chr(10) || 'has ' || s_suppkey AS body FROM supplier")
def src13(t: Tables):
    """Whole-file notes, a file for each, in a folder for each section; front matter is split off."""
    path = t.scratch()
    text = F.concat(F.lit("---\nkey: "), "s_suppkey", F.lit("\ntags: [a: b]\n---\n"), "s_name", F.lit("\nhas "), "s_suppkey")
    SK.write_notes(t.read("supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", text.alias("value")), path, "nation", "s_suppkey", "value")
    return RD.notes(t.spark, path).select("section", F.col("front")["key"].alias("key"), F.col("front")["tags"].alias("tags"), "body")


@query("src14_largest_document", "SELECT arg_max('f/' || o_orderkey || '_' || strftime(o_orderdate, '%Y-%m-%d') || '/doc' || l_linenumber || '.htm', CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber) AS path, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS length, CAST(o_orderdate AS DATE) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber > 1 GROUP BY o_orderkey, o_orderdate", "", "date")
def src14(t: Tables):
    """The largest document of each folder that is no index; the folder's name holds the date."""
    lines = t.read("lineitem").join(t.read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.when(F.col("l_linenumber") == 1, "index.htm").otherwise(F.concat(F.lit("doc"), "l_linenumber", F.lit(".htm")))
    path = F.concat(F.lit("f/"), "o_orderkey", F.lit("_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/"), name)
    return RD.largest_per_folder(lines.select(path.alias("path"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("length"))).select("path", "length", "date")


@query("src16_jdbc_table", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 1000", "c_acctbal")
def src16(t: Tables):
    """A table of a database, read in parts with its predicate evaluated there.

    spark.panelwright.jdbc.url names the database; unset, it is one within this process, which serves a single machine.
    """
    url = t.spark.conf.get("spark.panelwright.jdbc.url", None)
    if url is None:
        if t.spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.panelwright.jdbc.url")
        url = "jdbc:derby:memory:panelwright;create=true"
    name = f"customer_{t.scratch()[-12:]}"
    t.read("customer").select("c_custkey", "c_acctbal").write.jdbc(url, name)
    low, high = t.read("customer").agg(F.min("c_custkey"), F.max("c_custkey")).first()
    got = RD.jdbc_table(t.spark, url, name, '"c_acctbal" >= 1000', "c_custkey", low or 0, (high or 0) + 1, 4)
    return got.select("c_custkey", "c_acctbal")


@query("src17_required_series", "SELECT day, value FROM macro WHERE series = '1-URGENT'", "value", "day")
def src17(t: Tables):
    """A series without which a job must not go on."""
    return RD.required(t.macro.where("series = '1-URGENT'"), "1-URGENT").select("day", "value")


# Sinks


@query("snk3_sorted_panel", "SELECT entity, month, price, row_number() OVER (ORDER BY month, entity) AS place FROM monthly", "price", "month", "place")
def snk3(t: Tables):
    """A panel written in the order of (period, entity); place is told from the order of files and of rows within them."""
    path = t.scratch()
    SK.write_panel(t.monthly.select("entity", "month", "price"), path, "month", "entity")
    rows = t.spark.read.parquet(path).select("*", F.input_file_name().alias("_file"), F.col("_metadata.row_index").alias("_at"))
    ends = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    # As many rows as files: their names ascend with the ranges.
    before = ends.select("_file", F.coalesce(F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_file").select("entity", "month", "price", (F.col("_before") + F.col("_at") + 1).alias("place"))


@query("snk4_without_empty_columns", "SELECT entity, quarter, debt, eps FROM facts", "debt eps", "quarter")
def snk4(t: Tables):
    rows = t.facts.select("entity", "quarter", "debt", F.lit(None).cast("double").alias("nothing"), "eps", F.lit(None).cast("string").alias("none"))
    return SK.without_empty_columns(rows)


@query("snk5_records_json", """SELECT '{"c_custkey":' || c_custkey || CASE WHEN c_custkey % 3 <> 0 THEN ',"segment":"' || c_mktsegment || '"' ELSE '' END || ',"nation":' || c_nationkey || '}' AS json FROM customer""")
def snk5(t: Tables):
    rows = t.read("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"))
    return SK.as_json(rows)


EQUITY = "SELECT month, product(1 + ret) OVER (ORDER BY month) AS equity FROM index_ret"


@query("snk7_equity_csv", f"SELECT month, equity, equity / max(equity) OVER (ORDER BY month) - 1 AS drawdown FROM ({EQUITY})", "equity drawdown", "month")
def snk7(t: Tables):
    """The equity path written as CSV with a header and read back."""
    path = t.scratch()
    index = t.ret.where("ret is not null").groupBy("month").agg(F.avg("ret").alias("ret")).withColumn("all", F.lit("index"))
    equity = index.withColumn("equity", R.cumulated("ret", "all", "month")).withColumn("drawdown", R.drawdown("equity", "all", "month"))
    SK.write_csv(equity.select("month", "equity", "drawdown"), path)
    return RD.read_csv(t.spark, path, "month date, equity double, drawdown double")


STATS = metrics_sql("series", "SELECT 'strategy' AS series, month, ret FROM index_ret UNION ALL SELECT 'benchmark', month, ret FROM ret WHERE entity = 'Brand#11' AND ret IS NOT NULL")


@query("snk7b_stats_csv", f"SELECT metric, max(CASE WHEN series = 'strategy' THEN value END) AS strategy, max(CASE WHEN series = 'benchmark' THEN value END) AS benchmark FROM (SELECT series, unnest(['total', 'years', 'cagr', 'sharpe', 'sortino', 'max_dd', 'calmar']) AS metric, unnest([total, years, cagr, sharpe, sortino, max_dd, calmar]) AS value FROM ({STATS})) GROUP BY 1", "strategy benchmark")
def snk7b(t: Tables):
    """Metrics of a path beside those of a benchmark, a row for each, written as CSV and read back."""
    path, ret = t.scratch(), t.ret.where("ret is not null")
    index = ret.groupBy("month").agg(F.avg("ret").alias("ret")).select(F.lit("strategy").alias("series"), "month", "ret")
    got = R.path_metrics(index.unionByName(ret.where("entity = 'Brand#11'").select(F.lit("benchmark").alias("series"), "month", "ret")), ["series"], "month", "ret", per_year=12.0)
    long = got.unpivot("series", METRICS.split(), "metric", "value")
    SK.write_csv(long.groupBy("metric").pivot("series", ["strategy", "benchmark"]).agg(F.first("value")), path)
    return RD.read_csv(t.spark, path, "metric string, strategy double, benchmark double")


FOLDS = "SELECT month AS test_month, row_number() OVER (ORDER BY month) AS i FROM (SELECT DISTINCT month FROM scored)"


@query("snk8_stored_models", f"SELECT f.i - 39 AS fold, e.test_month AS train_end, f.test_month, (SELECT count(*) FROM scored s WHERE s.month <= e.test_month) AS n_rows, 'score,fwd' AS features, (SELECT count(*) FROM scored s WHERE s.month = f.test_month) AS n_scored FROM ({FOLDS}) f JOIN ({FOLDS}) e ON e.i = f.i - 3 WHERE f.i > 39 AND (f.i - 39) % 12 = 1", "", "train_end test_month", "fold n_rows n_scored")
def snk8(t: Tables):
    """Models refitted once a year are stored with their metadata; both are read back and each model scores its test month."""
    path, features = t.scratch(), ["score", "fwd"]
    rows = saved(t.scored.select("entity", "month", F.col("label").cast("double").alias("label"), F.col("score"), "fwd"))[0].cache()
    folds = M.folds(rows.select("month").distinct(), "month", 36, 3).where("fold % 12 = 1")
    fit = lambda part: M.fit_fold(part, features, "label", trees=2, depth=2)
    models = M.fit_folds(folds, rows, "month", fit)
    sizes = rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    trained = folds.join(F.broadcast(sizes), F.col("month") <= F.col("train_end")).groupBy("fold", "train_end", "test_month").agg(F.sum("n").alias("n_rows"))
    SK.save_models(models, path, trained.withColumn("features", F.lit(",".join(features))))
    again, meta = SK.load_models(t.spark, path)
    scored = M.score_folds(again, rows.withColumnRenamed("score", "x").withColumn("score", F.col("x")), "month", features, "p").groupBy(F.col("month").alias("test_month")).agg(F.count("p").alias("n_scored"))
    return meta.join(scored, "test_month").select("fold", "train_end", "test_month", "n_rows", "features", "n_scored")


@query("snk9_dated_payload", """SELECT month, '{"entity":"' || entity || '","rank":' || rank || CASE WHEN month >= DATE '1998-01-01' THEN ',"run":2}' ELSE ',"run":1}' END AS payload FROM (SELECT entity, month, row_number() OVER (PARTITION BY month ORDER BY score DESC, entity) AS rank FROM scored) WHERE rank = 1""", "", "month")
def snk9(t: Tables):
    """A payload for each month; the second run replaces the months it has and no others."""
    path = t.scratch()
    best = R.top_n(t.scored, "month", "score", "entity", 1).select("month", "entity", "rank")
    SK.write_payload(best.withColumn("run", F.lit(1)), path, "month")
    SK.write_payload(best.where("month >= date '1998-01-01'").withColumn("run", F.lit(2)), path, "month")
    return t.spark.read.parquet(path).select(F.col("month").cast("date").alias("month"), "payload")


@query("flt9_output_columns", "SELECT CAST(NULL AS VARCHAR) AS sector, n_name, CAST(NULL AS DOUBLE) AS beta, n_nationkey FROM nation", "beta")
def flt9(t: Tables):
    return RD.in_order(t.read("nation"), {"sector": "string", "n_name": "string", "beta": "double", "n_nationkey": "int"})
