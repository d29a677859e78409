"""Queries over scalar functions: FN1-FN22 (FN10, FN14 and FN16 stand with the tables they need)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import scalar as S
from panelwright.plans.registry import Tables, query


@query("fn1_parse_timestamp", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS at FROM orders""")
def fn1(t: Tables):
    d = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("not a date")
    return t.read("orders").select("o_orderkey", F.date_format(S.parse_timestamp(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("fn2_content_key", "SELECT p_partkey, sha256(p_name || '|' || CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END || '|' || p_type) AS key FROM part")
def fn2(t: Tables):
    brand = F.when(F.col("p_size") % 3 != 0, F.col("p_brand"))
    return t.read("part").select("p_partkey", S.content_key(F.col("p_name"), brand, F.col("p_type")).alias("key"))


@query("fn3_chunk_id", """SELECT doc_id, sha1(coalesce(text, '') || '{' || concat_ws(',', CASE WHEN lang IS NOT NULL THEN '"lang":"' || lang || '"' END, CASE WHEN source IS NOT NULL THEN '"source":"' || source || '"' END) || '}') AS chunk_id FROM documents""")
def fn3(t: Tables):
    meta = F.map_filter(F.create_map(F.lit("source"), "source", F.lit("lang"), "lang"), lambda k, v: v.isNotNull())
    return t.read("documents").select("doc_id", S.chunk_id(F.coalesce("text", F.lit("")), meta).alias("chunk_id"))


@query("fn4_clean_field", "SELECT c_custkey, upper(c_mktsegment) AS segment, nullif(substr(trim('  ' || c_name || '  '), 1, 8), '') AS name, coalesce(CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'odd' END, 'even') AS first FROM customer")
def fn4(t: Tables):
    name = S.clean_field(F.concat(F.lit("  "), "c_name", F.lit("  ")), 8)
    kept = F.coalesce(S.clean_field(F.when(F.col("c_custkey") % 2 == 0, " ").otherwise("odd")), F.lit("even"))
    return t.read("customer").select("c_custkey", F.upper("c_mktsegment").alias("segment"), name.alias("name"), kept.alias("first"))


@query("fn5_text_and_shape", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || '. ' || p_type END AS text, CASE WHEN p_size % 2 = 0 THEN 'title_only' ELSE 'title_snippet' END AS shape FROM part")
def fn5(t: Tables):
    text, shape = S.title_and_snippet(F.col("p_name"), F.when(F.col("p_size") % 2 != 0, F.col("p_type")))
    return t.read("part").select("p_partkey", text.alias("text"), shape.alias("shape"))


@query("fn6_period_ends", "SELECT o_orderkey, last_day(o_orderdate) AS m, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS q FROM orders", "", "m q")
def fn6(t: Tables):
    d = F.col("o_orderdate").cast("date")
    return t.read("orders").select("o_orderkey", S.month_end(d).alias("m"), S.quarter_end(d).alias("q"))


@query("fn7_last_month_end", "SELECT o_orderkey, last_day(CAST(date_trunc('month', o_orderdate) AS DATE) - INTERVAL 1 DAY) AS m FROM orders", "", "m")
def fn7(t: Tables):
    return t.read("orders").select("o_orderkey", S.last_completed_month_end(F.col("o_orderdate").cast("date")).alias("m"))


@query("fn8_year_windows", "SELECT o_orderpriority, y AS year, y || '-01..' || y || '-12' AS period, make_date(y, 1, 1) AS first, least(make_date(y, 12, 31), last) AS until FROM (SELECT o_orderpriority, CAST(max(o_orderdate) AS DATE) AS last, unnest(range(year(min(o_orderdate)), year(max(o_orderdate)) + 1)) AS y FROM orders GROUP BY 1)", "", "first until", "year")
def fn8(t: Tables):
    spans = t.read("orders").groupBy("o_orderpriority").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    years = spans.withColumn("year", F.explode(F.sequence(F.year("a"), F.year("b"))))
    end = F.least(F.make_date("year", F.lit(12), F.lit(31)), "b")
    return years.select("o_orderpriority", "year", F.format_string("%d-01..%d-12", "year", "year").alias("period"), F.make_date("year", F.lit(1), F.lit(1)).alias("first"), end.alias("until"))


@query("fn9_winsorise", "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN greatest(-3, least(3, c_acctbal / 1000)) END AS z FROM customer", "z")
def fn9(t: Tables):
    return t.read("customer").select("c_custkey", S.clip(F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") / 1000), 3.0).alias("z"))


@query("fn11_free_cash_flow", "SELECT entity, quarter, operating_cf - abs(capex) AS fcf, abs(debt) AS size FROM facts", "fcf size", "quarter")
def fn11(t: Tables):
    return t.facts.select("entity", "quarter", S.free_cash_flow(F.col("operating_cf"), F.col("capex")).alias("fcf"), F.abs("debt").alias("size"))


@query("fn12_shrink", "SELECT key, n / (n + 10.0) * raw + 10 / (n + 10.0) * prior AS value FROM (SELECT key, avg(score) AS raw, count(*) AS n FROM news GROUP BY 1) CROSS JOIN (SELECT avg(score) AS prior FROM news)", "value")
def fn12(t: Tables):
    own = t.news.groupBy("key").agg(F.avg("score").alias("raw"), F.count(F.lit(1)).alias("n"))
    prior = t.news.agg(F.avg("score").alias("prior"))
    return own.join(F.broadcast(prior)).select("key", S.shrink(F.col("raw"), F.col("n"), F.col("prior")).alias("value"))


@query("fn13_regimes", """SELECT month, CASE WHEN vix > 25 OR (vix > 20 AND spread < 0) THEN 'RISK_OFF' WHEN vix < 20 AND spread > 0 THEN 'RISK_ON' ELSE 'NEUTRAL' END AS label, coalesce(vix < 25, false) AND coalesce(spread > 0, false) AS daily, coalesce(vix < 20 AND spread > 0, false) AS risk_on, coalesce(vix > 25, false) OR coalesce(spread < 0, false) AS risk_off, coalesce(infl > 4, false) AS high_inflation, coalesce(chg > 0.25, false) AS rate_rising,
 CASE WHEN vix IS NOT NULL AND spread IS NOT NULL THEN CASE WHEN vix > 25 OR spread < 0 THEN 'RISK-OFF' WHEN vix < 18 AND spread > 0.5 THEN 'RISK-ON' ELSE 'NEUTRAL' END END AS snapshot
 FROM (SELECT month, vix, spread, (vix / lag(vix, 12) OVER (ORDER BY month) - 1) * 100 AS infl, spread - lag(spread, 3) OVER (ORDER BY month) AS chg FROM two)""", "", "month")
def fn13(t: Tables):
    from panelwright.operators.rolling import along, growth

    rows = t.two.withColumn("one", F.lit(1))
    rows = rows.withColumns({"infl": growth("vix", "one", "month", 12) * 100, "chg": F.col("spread") - F.lag("spread", 3).over(along("one", "month"))})
    v, s = F.col("vix"), F.col("spread")
    flags = S.regime_flags(v, s, F.col("infl"), F.col("chg"))
    return rows.select("month", S.graded_regime(v, s).alias("label"), S.daily_risk_on(v, s).alias("daily"), *(c.alias(n) for n, c in flags.items()), S.snapshot_label(v, s).alias("snapshot"))


@query("fn15_blend", "SELECT month, CASE WHEN stale THEN 'NEUTRAL' WHEN second = 'SKIPPED' OR second = rule THEN rule ELSE 'NEUTRAL' END AS label FROM (SELECT month, CASE WHEN vix > 25 OR (vix > 20 AND spread < 0) THEN 'RISK_OFF' WHEN vix < 20 AND spread > 0 THEN 'RISK_ON' ELSE 'NEUTRAL' END AS rule, CASE month(month) % 3 WHEN 0 THEN 'SKIPPED' WHEN 1 THEN 'RISK_OFF' ELSE 'RISK_ON' END AS second, month(month) = 5 AS stale FROM two)", "", "month")
def fn15(t: Tables):
    m = F.month("month") % 3
    second = F.when(m == 0, "SKIPPED").when(m == 1, "RISK_OFF").otherwise("RISK_ON")
    return t.two.select("month", S.blend(S.graded_regime(F.col("vix"), F.col("spread")), second, F.month("month") == 5).alias("label"))


@query("fn17_pivotality", """SELECT o_orderkey, (phi AND a AND s) <> false AND NOT (x AND y) AS price, (phi AND a AND p) AND NOT (x AND y) AS state, (x <> false) AND y AND NOT (phi AND a AND s AND p) AS second FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS a, o_orderkey % 3 > 0 AS phi, o_orderkey % 5 > 1 AS s, o_totalprice > 100000 AS p, true AS x, o_orderkey % 7 < 3 AS y FROM orders)""")
def fn17(t: Tables):
    k = F.col("o_orderkey")
    c = {"case1": k % 2 == 0, "phi_pos": k % 3 > 0, "falling": k % 5 > 1, "price_ok": F.col("o_totalprice") > 100000, "second": F.lit(True), "permits": k % 7 < 3}
    return t.read("orders").select("o_orderkey", S.pivotal("price_ok", **c).alias("price"), S.pivotal("falling", **c).alias("state"), S.pivotal("second", **c).alias("second"))


@query("fn18_json_number", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events", "k")
def fn18(t: Tables):
    return t.read("events").select("event_id", S.relevance(F.col("props"), "$.k").alias("k"))


@query("fn19_symbol_in_text", "SELECT doc_id, list_extract(list_filter(['THE', 'DE'], lambda s: list_contains(string_split_regex(upper(replace(text, 'ß', 'ss')), '[^A-Z0-9]+'), s)), 1) AS symbol FROM documents")
def fn19(t: Tables):
    """The longest known symbol among a text's words."""
    return t.read("documents").select("doc_id", S.first_symbol(F.col("text"), ["THE", "DE"]).alias("symbol"))


@query("fn20_path_parts", r"SELECT page_id, nullif(regexp_extract(path, '(19\d\d|20\d\d)', 1), '') AS year, nullif(regexp_extract(path, '([^/]+)/[^/]+$', 1), '') AS folder FROM (SELECT page_id, 'papers/' || list_extract(string_split(url, '/'), -1) || '/paper_2019.pdf' AS path FROM pages)")
def fn20(t: Tables):
    rows = t.read("pages").withColumn("path", F.concat(F.lit("papers/"), F.substring_index("url", "/", -1), F.lit("/paper_2019.pdf")))
    return rows.select("page_id", S.year_in_path(F.col("path")).alias("year"), S.parent_folder(F.col("path")).alias("folder"))


@query("fn21_fill_zero", "SELECT entity, quarter, coalesce(debt, 0) AS debt, coalesce(equity, 0) AS equity FROM facts", "debt equity", "quarter")
def fn21(t: Tables):
    return t.facts.select("entity", "quarter", "debt", "equity").fillna(0.0, ["debt", "equity"])


@query("fn22_slug_citation", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, concat_ws(' | ', p_brand, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_type END, CAST(p_size AS VARCHAR)) AS citation, p_retailprice AS price FROM part", "price")
def fn22(t: Tables):
    cite = S.citation(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")), F.col("p_size").cast("string"))
    return t.read("part").select("p_partkey", S.slug(F.col("p_name")).alias("slug"), cite.alias("citation"), F.col("p_retailprice").alias("price"))
