"""Queries over aggregations: AG1-AG32."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import graded_regime, ratio
from panelwright.operators import panel as P
from panelwright.operators import rolling as R
from panelwright.operators.durable import saved
from panelwright.operators.quantiles import exact_quantiles
from panelwright.plans.q_windows import row_mean, surprises
from panelwright.plans.registry import Tables, query


@query("ag1_period_last", "SELECT entity, last_day(day) AS month, arg_max(price, day) AS price, arg_max(volume, day) AS volume FROM panel GROUP BY 1, 2", "price volume", "month")
def ag1(t: Tables):
    return P.to_period(t.panel, F.last_day("day"), "entity", "day", ["price", "volume"], "month")


@query("ag2_mean_count", "SELECT key, CAST(date_trunc('week', day) AS DATE) AS week, avg(score) AS mean, count(*) AS n FROM news GROUP BY 1, 2", "mean", "week", "n")
def ag2(t: Tables):
    return t.news.groupBy("key", F.trunc("day", "week").alias("week")).agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))


@query("ag3_mean_of_means", "SELECT day, coalesce(avg(m), 0) AS mean FROM (SELECT DISTINCT day FROM news) LEFT JOIN (SELECT day, key, avg(score) AS m FROM news WHERE source = 'click' GROUP BY 1, 2) USING (day) GROUP BY 1", "mean", "day")
def ag3(t: Tables):
    own = t.news.where("source = 'click'").groupBy("day", "key").agg(F.avg("score").alias("m")).groupBy("day").agg(F.avg("m").alias("mean"))
    return t.news.select("day").distinct().join(own, "day", "left").select("day", F.coalesce("mean", F.lit(0.0)).alias("mean"))


AG4 = """SELECT key, week, sum(score * days) / sum(days) AS mean FROM (SELECT key, score, w AS week, date_diff('day', greatest(day, w), least(nxt, w + 7)) AS days FROM (SELECT key, day, score, coalesce(lead(day) OVER (PARTITION BY key ORDER BY day), DATE '2024-02-05') AS nxt FROM (SELECT key, day, avg(score) AS score FROM news GROUP BY 1, 2)) JOIN (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS w FROM news) ON day < w + 7 AND nxt > w) WHERE days > 0 GROUP BY 1, 2"""


@query("ag4_time_weighted_mean", AG4, "mean", "week")
def ag4(t: Tables):
    """Each value holds until the next one (the last until `as_of`): days by period, without a row for each day."""
    daily = t.news.groupBy("key", "day").agg(F.avg("score").alias("score"))
    until = F.coalesce(F.lead("day").over(R.along("key", "day")), F.lit("2024-02-05").cast("date"))
    spans = daily.withColumn("until", until)
    weeks = F.sequence(F.trunc("day", "week"), F.trunc(F.date_sub("until", 1), "week"), F.expr("interval 7 days"))
    last = t.news.agg(F.max(F.trunc("day", "week")).alias("last"))
    cut = spans.withColumn("week", F.explode(weeks)).join(F.broadcast(last), F.col("week") <= F.col("last"))
    days = F.date_diff(F.least("until", F.date_add("week", 7)), F.greatest("day", "week"))
    return cut.withColumn("days", days).groupBy("key", "week").agg((F.sum(F.col("score") * F.col("days")) / F.sum("days")).alias("mean"))


@query("ag5_conditional_counts", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY 1", "", "", "n done large")
def ag5(t: Tables):
    return t.read("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


@query("ag6_two_key_histogram", "SELECT o_orderstatus, year(o_orderdate) AS year, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1, 2", "low high", "", "year n")
def ag6(t: Tables):
    return t.read("orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("ag7_duplicates", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", "", "", "n")
def ag7(t: Tables):
    return P.duplicate_keys(t.read("lineitem"), ["l_partkey", "l_suppkey"])


@query("ag8_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1", "", "", "parts suppliers")
def ag8(t: Tables):
    return t.read("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


MISSING = "SELECT {0} AS period, unnest(['debt', 'equity']) AS feature, unnest([d, e]) AS rate, unnest([d, e]) > 0.3 AS flagged FROM (SELECT {1} avg(CASE WHEN debt IS NULL THEN 1.0 ELSE 0 END) AS d, avg(CASE WHEN equity IS NULL THEN 1.0 ELSE 0 END) AS e FROM facts {2})"


@query("ag9_missing_rates", f"{MISSING.format('CAST(quarter AS VARCHAR)', 'quarter,', 'GROUP BY 1')} UNION ALL {MISSING.format(chr(39) + 'all' + chr(39), '', '')}", "rate")
def ag9(t: Tables):
    """Missing rates of each quarter and of all rows, in one pass over quarters."""
    names = ("debt", "equity")
    counts = t.facts.rollup("quarter").agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names)).withColumn("period", F.coalesce(F.col("quarter").cast("string"), F.lit("all"))).drop("quarter")
    return counts.unpivot("period", list(names), "feature", "rate").withColumn("flagged", F.col("rate") > 0.3)


@query("ag10_summary", "SELECT count(l_quantity) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, min(l_quantity) AS low, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS high FROM lineitem", "mean sd low q1 q2 q3 high", "", "n")
def ag10(t: Tables):
    x = "l_quantity"
    lines = t.read("lineitem")
    told = lines.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))
    return told.join(exact_quantiles(lines, [], x, {"q1": 0.25, "q2": 0.5, "q3": 0.75}))  # one row each


WEIGHTS = {"debt": 0.5, "equity": 0.3, "revenue": 0.2}
_NUM = " + ".join(f"coalesce({w} * {c}, 0)" for c, w in WEIGHTS.items())
_DEN = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END" for c, w in WEIGHTS.items())


@query("ag11_renormalised_composite", f"SELECT entity, quarter, ({_NUM}) / nullif({_DEN}, 0) AS score, concat_ws(',', {', '.join(f'CASE WHEN {c} IS NOT NULL THEN {chr(39)}{c}{chr(39)} END' for c in WEIGHTS)}) AS used, concat_ws(',', {', '.join(f'CASE WHEN {c} IS NULL THEN {chr(39)}{c}{chr(39)} END' for c in WEIGHTS)}) AS missing FROM facts", "score", "quarter")
def ag11(t: Tables):
    """Weights renormalised over the inputs that are there; none there gives NULL."""
    score = ratio(sum(F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in WEIGHTS.items()), sum(F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in WEIGHTS.items()))
    names = lambda known: F.concat_ws(",", *(F.when(F.col(c).isNotNull() == known, F.lit(c)) for c in WEIGHTS))
    return t.facts.select("entity", "quarter", score.alias("score"), names(True).alias("used"), names(False).alias("missing"))


@query("ag12_fixed_composite", "SELECT entity, quarter, 0.5 * debt + 0.3 * equity + 0.2 * revenue AS score FROM facts", "score", "quarter")
def ag12(t: Tables):
    return t.facts.select("entity", "quarter", sum(F.col(c) * w for c, w in WEIGHTS.items()).alias("score"))


@query("ag13_row_mean", "SELECT entity, quarter, list_avg(list_filter([debt, equity, current_assets], lambda x: x IS NOT NULL)) AS mean FROM facts", "mean", "quarter")
def ag13(t: Tables):
    return t.facts.select("entity", "quarter", row_mean("debt", "equity", "current_assets").alias("mean"))


@query("ag14_mean_of_frames", "SELECT entity, month, avg(r) AS mean FROM (SELECT entity, month, price / lag(price, 1) OVER (PARTITION BY entity ORDER BY month) - 1 AS r FROM monthly UNION ALL SELECT entity, month, price / lag(price, 3) OVER (PARTITION BY entity ORDER BY month) - 1 FROM monthly) GROUP BY 1, 2", "mean", "month")
def ag14(t: Tables):
    frame = lambda n: t.monthly.select("entity", "month", R.growth("price", "entity", "month", n).alias("r"))
    return frame(1).unionByName(frame(3)).groupBy("entity", "month").agg(F.avg("r").alias("mean"))


@query("ag15_top_n_hits", "SELECT month, count(*) AS selected, sum(label) AS correct, avg(label) AS rate, avg(score) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, entity) AS r FROM scored) WHERE r <= 5 GROUP BY 1", "rate mean", "month", "selected correct")
def ag15(t: Tables):
    return R.top_n(t.scored, "month", "score", "entity", 5).groupBy("month").agg(F.count(F.lit(1)).alias("selected"), F.sum("label").alias("correct"), F.avg("label").alias("rate"), F.avg("score").alias("mean"))


REGIME = "CASE WHEN vix > 25 OR (vix > 20 AND spread < 0) THEN 'RISK_OFF' WHEN vix < 20 AND spread > 0 THEN 'RISK_ON' ELSE 'NEUTRAL' END"


@query("ag16_regime_segments", f"SELECT regime, count(*) AS months, avg(CASE WHEN hits * 2 > n THEN 1.0 ELSE 0 END) AS majority, avg(inside) AS inside, avg(outside) AS outside FROM (SELECT month, {REGIME} AS regime FROM two) JOIN (SELECT month, count(*) FILTER (r <= 5) AS n, count(*) FILTER (r <= 5 AND label = 1) AS hits, avg(CASE WHEN r <= 5 THEN score END) AS inside, avg(CASE WHEN r > 5 THEN score END) AS outside FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, entity) AS r FROM scored) GROUP BY 1) USING (month) GROUP BY 1", "majority inside outside", "", "months")
def ag16(t: Tables):
    top = R.top_n(t.scored, "month", "score", "entity", 5).select("entity", "month", F.lit(True).alias("chosen"))
    rows = t.scored.join(top, ["entity", "month"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    by_month = rows.groupBy("month").agg(F.count_if("chosen").alias("n"), F.count_if(F.col("chosen") & (F.col("label") == 1)).alias("hits"), F.avg(F.when(F.col("chosen"), F.col("score"))).alias("inside"), F.avg(F.when(~F.col("chosen"), F.col("score"))).alias("outside"))
    regime = t.two.select("month", graded_regime(F.col("vix"), F.col("spread")).alias("regime"))
    return by_month.join(regime, "month").groupBy("regime").agg(F.count(F.lit(1)).alias("months"), F.avg((F.col("hits") * 2 > F.col("n")).cast("double")).alias("majority"), F.avg("inside").alias("inside"), F.avg("outside").alias("outside"))


@query("ag17_outcomes", "SELECT coalesce(l_returnflag, 'all') AS trigger, count(*) AS n, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END) AS hit, avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 0.5) AS median, sum(l_extendedprice) / 1000000 AS total FROM lineitem GROUP BY ROLLUP (l_returnflag)", "hit mean median total", "", "n")
def ag17(t: Tables):
    x, key = "l_extendedprice", F.coalesce("l_returnflag", F.lit("all")).alias("trigger")
    got = t.read("lineitem").rollup("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("l_discount") > 0.05).cast("double")).alias("hit"), F.avg(x).alias("mean"), (F.sum(x) / 1000000).alias("total"))
    rows = t.read("lineitem").select(F.explode(F.array(F.col("l_returnflag"), F.lit("all"))).alias("trigger"), x)
    return got.select(key, "n", "hit", "mean", "total").join(exact_quantiles(rows, ["trigger"], x, {"median": 0.5}), "trigger")


@query("ag18_concentration", "SELECT count(*) FILTER (running <= 0.5 * total) + 1 AS n FROM (SELECT sum(v) OVER (ORDER BY v DESC, o_custkey) AS running, sum(v) OVER () AS total FROM (SELECT o_custkey, abs(sum(o_totalprice - 150000)) AS v FROM orders GROUP BY 1))", "", "", "n")
def ag18(t: Tables):
    """Smallest number of entities with half of the absolute total: running sums of ranges, each range ordered by itself."""
    v = t.read("orders").groupBy("o_custkey").agg(F.abs(F.sum(F.col("o_totalprice") - 150000)).alias("v"))
    step = v.withColumn("bin", F.floor(F.log2(F.col("v") + 1) * 8))
    bins = step.groupBy("bin").agg(F.sum("v").alias("s"))
    above = bins.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("total", F.sum("s").over(Window.partitionBy(F.lit(0))))
    run = step.join(F.broadcast(above), "bin").withColumn("running", F.col("before") + F.sum("v").over(Window.partitionBy("bin").orderBy(F.desc("v"), "o_custkey")))
    return run.agg((F.count_if(F.col("running") <= 0.5 * F.col("total")) + 1).alias("n"))


PAIRS = "SELECT key, day, avg(CASE WHEN source = 'click' THEN score END) AS a, avg(CASE WHEN source <> 'click' THEN score END) AS b FROM news GROUP BY 1, 2"
_RANKS = f"SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM ({PAIRS}) WHERE a IS NOT NULL AND b IS NOT NULL"
_EACH = f"SELECT day, unnest([a, b]) AS v FROM ({PAIRS}) WHERE a IS NOT NULL AND b IS NOT NULL"
AGREE = f"SELECT * FROM (SELECT count(*) AS n, avg(a - b) AS difference, stddev_samp(a) / nullif(stddev_samp(b), 0) AS sd_ratio, corr(ra, rb) AS rank_corr FROM ({_RANKS})) CROSS JOIN (SELECT stddev_samp(v) AS pooled_sd FROM ({_EACH})) CROSS JOIN (SELECT avg(sd) AS period_sd FROM (SELECT stddev_samp(v) AS sd FROM ({_EACH}) GROUP BY day))"


def paired_means(t: Tables):
    of = lambda c: F.avg(F.when(c, F.col("score")))
    return t.news.groupBy("key", "day").agg(of(F.col("source") == "click").alias("a"), of(F.col("source") != "click").alias("b")).dropna("any", subset=["a", "b"])


def agreement(t: Tables):
    """One row: difference, ratio of deviations and rank correlation of paired means, their pooled deviation and the mean of periods' deviations."""
    pairs, _ = saved(paired_means(t))
    ranked = R.average_rank(R.average_rank(pairs, "a", None, "ra"), "b", None, "rb")
    told = ranked.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("a") - F.col("b")).alias("difference"), ratio(F.stddev_samp("a"), F.stddev_samp("b")).alias("sd_ratio"), F.corr("ra", "rb").alias("rank_corr"))
    each = pairs.select("day", F.explode(F.array("a", "b")).alias("v"))
    pooled = each.agg(F.stddev_samp("v").alias("pooled_sd"))
    period = each.groupBy("day").agg(F.stddev_samp("v").alias("sd")).agg(F.avg("sd").alias("period_sd"))
    return told.join(F.broadcast(pooled)).join(F.broadcast(period))  # one row each


@query("ag19_agreement", AGREE, "difference sd_ratio rank_corr pooled_sd period_sd", "", "n")
def ag19(t: Tables):
    return agreement(t)


@query("ag20_decision", f"SELECT n, CASE WHEN n < 30 THEN 'TOO_FEW' WHEN rank_corr >= 0.5 AND abs(difference) < 0.25 * pooled_sd THEN 'POOL' WHEN rank_corr >= 0.1 THEN 'RESCALE' ELSE 'SEPARATE' END AS decision FROM ({AGREE})", "", "", "n")
def ag20(t: Tables):
    decision = F.when(F.col("n") < 30, "TOO_FEW").when((F.col("rank_corr") >= 0.5) & (F.abs("difference") < 0.25 * F.col("pooled_sd")), "POOL").when(F.col("rank_corr") >= 0.1, "RESCALE").otherwise("SEPARATE")
    return agreement(t).select("n", decision.alias("decision"))


RULES = "SELECT key, day, unnest(['all', CASE WHEN source = 'click' THEN 'click only' ELSE 'without click' END]) AS rule FROM news"


@query("ag21_density", f"SELECT year, rule, quantile_cont(n, 0.5) AS median FROM (SELECT year(day) AS year, rule, key, date_trunc('week', day) AS week, count(*) AS n FROM ({RULES}) GROUP BY ALL) GROUP BY 1, 2", "median", "", "year")
def ag21(t: Tables):
    """Median items of a key's week, by year and by which sources a rule takes."""
    rule = F.explode(F.array(F.lit("all"), F.when(F.col("source") == "click", "click only").otherwise("without click")))
    n = t.news.select("key", "day", rule.alias("rule")).groupBy(F.year("day").alias("year"), "rule", "key", F.trunc("day", "week").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("year", "rule").agg(F.percentile("n", 0.5).alias("median"))  # counts: few different values


@query("ag22_shrinkage", "SELECT week, avg(n / (n + 10.0)) AS own_weight, quantile_cont(n, 0.5) AS median, avg(CASE WHEN n = 0 THEN 1.0 ELSE 0 END) AS prior_share FROM (SELECT w.week, k.key, count(m.key) AS n FROM (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS week FROM news) w CROSS JOIN (SELECT DISTINCT key FROM news) k LEFT JOIN news m ON m.key = k.key AND CAST(date_trunc('week', m.day) AS DATE) = w.week GROUP BY 1, 2) GROUP BY 1", "own_weight median prior_share", "week")
def ag22(t: Tables):
    n = t.news.groupBy(F.trunc("day", "week").alias("week"), "key").agg(F.count(F.lit(1)).alias("n"))
    cells = P.densify(n, "key", "week").fillna(0, ["n"])
    return cells.groupBy("week").agg(F.avg(F.col("n") / (F.col("n") + 10.0)).alias("own_weight"), F.percentile("n", 0.5).alias("median"), F.avg((F.col("n") == 0).cast("double")).alias("prior_share"))


IC = "SELECT month, corr(ra, rb) AS ic FROM (SELECT month, rank() OVER (PARTITION BY month ORDER BY score) + (count(*) OVER (PARTITION BY month, score) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY month ORDER BY fwd) + (count(*) OVER (PARTITION BY month, fwd) - 1) / 2.0 AS rb FROM scored) GROUP BY 1 HAVING count(*) >= 3"


@query("ag23_information_coefficient", f"SELECT count(*) AS months, avg(ic) AS mean, stddev_samp(ic) AS sd, avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS t FROM ({IC})", "mean sd t", "", "months")
def ag23(t: Tables):
    ranked = R.average_rank(R.average_rank(t.scored, "score", "month", "ra"), "fwd", "month", "rb")
    ic = ranked.groupBy("month").agg(F.corr("ra", "rb").alias("ic"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return ic.agg(F.count(F.lit(1)).alias("months"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), (F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count(F.lit(1)))).alias("t"))


@query("ag24_path_variants", "SELECT month, avg(fwd) AS hold_all, avg(CASE WHEN score < 0.2 THEN 0 ELSE fwd END) AS to_cash, avg(CASE WHEN score >= 0.2 THEN fwd END) AS survivors, avg(CASE WHEN score < 0.2 AND label = 0 THEN 0 ELSE fwd END) AS one_trigger FROM scored GROUP BY 1", "hold_all to_cash survivors one_trigger", "month")
def ag24(t: Tables):
    out = F.col("score") < 0.2
    cash = lambda c: F.avg(F.when(c, 0.0).otherwise(F.col("fwd")))
    return t.scored.groupBy("month").agg(F.avg("fwd").alias("hold_all"), cash(out).alias("to_cash"), F.avg(F.when(~out, F.col("fwd"))).alias("survivors"), cash(out & (F.col("label") == 0)).alias("one_trigger"))


@query("ag25_tail", "SELECT entity, quantile_cont(fwd, 0.05) AS p05, quantile_cont(fwd, 0.5) AS p50, quantile_cont(fwd, 0.95) AS p95, min(fwd) AS worst FROM fwd WHERE fwd IS NOT NULL GROUP BY 1", "p05 p50 p95 worst")
def ag25(t: Tables):
    fwd = t.fwd.where("fwd is not null")
    shares = exact_quantiles(fwd, ["entity"], "fwd", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return shares.join(fwd.groupBy("entity").agg(F.min("fwd").alias("worst")), "entity")


LIMITS = {"click": 5, "view": 3}


@query("ag26_freshness", "SELECT source, max(day) AS last, DATE '2024-02-01' - max(day) AS age, CASE source WHEN 'click' THEN 5 WHEN 'view' THEN 3 ELSE 2 END AS most, DATE '2024-02-01' - max(day) <= CASE source WHEN 'click' THEN 5 WHEN 'view' THEN 3 ELSE 2 END AS ok FROM news GROUP BY 1", "", "last", "age most")
def ag26(t: Tables):
    most = F.when(F.col("source") == "click", 5).when(F.col("source") == "view", 3).otherwise(2)
    got = t.news.groupBy("source").agg(F.max("day").alias("last"))
    got = got.withColumns({"age": F.date_diff(F.lit("2024-02-01").cast("date"), "last"), "most": most})
    return got.withColumn("ok", F.col("age") <= F.col("most"))


IMPORTANCE = "SELECT month, u.feature, abs(corr(u.x, fwd)) AS importance FROM (SELECT month, fwd, unnest([{'feature': 'score', 'x': score}, {'feature': 'label', 'x': CAST(label AS DOUBLE)}]) AS u FROM scored) GROUP BY 1, 2 HAVING abs(corr(u.x, fwd)) IS NOT NULL AND NOT isnan(corr(u.x, fwd))"


def importances(t: Tables):
    long = t.scored.select("month", "fwd", F.explode(F.array(F.struct(F.lit("score").alias("feature"), F.col("score").alias("x")), F.struct(F.lit("label").alias("feature"), F.col("label").cast("double").alias("x")))).alias("u"))
    got = long.groupBy("month", "u.feature").agg(F.abs(F.corr("u.x", "fwd")).alias("importance"))
    return got.where("importance is not null and not isnan(importance)")


@query("ag27_mean_importance", f"SELECT feature, avg(importance) AS mean, avg(importance) < 0.3 AS low FROM ({IMPORTANCE}) GROUP BY 1", "mean")
def ag27(t: Tables):
    return importances(t).groupBy("feature").agg(F.avg("importance").alias("mean")).withColumn("low", F.col("mean") < 0.3)


@query("ag28_deflated_t", f"SELECT feature, avg(importance) / ((stddev_samp(importance) + 1e-8) / sqrt(count(*))) / (sqrt(2 * ln(2)) + 1e-8) AS t FROM ({IMPORTANCE}) GROUP BY 1", "t")
def ag28(t: Tables):
    rows = importances(t)
    many = rows.agg(F.count_distinct("feature").alias("p"))
    got = rows.groupBy("feature").agg(F.avg("importance").alias("m"), F.stddev_samp("importance").alias("s"), F.count(F.lit(1)).alias("n")).join(F.broadcast(many))
    return got.select("feature", (F.col("m") / ((F.col("s") + 1e-8) / F.sqrt("n")) / (F.sqrt(2 * F.log("p")) + 1e-8)).alias("t"))


@query("ag29_class_weight", "SELECT neg / pos AS ratio, CASE WHEN neg / pos < 0.67 OR neg / pos > 1.5 THEN neg / pos ELSE 1 END AS weight FROM (SELECT count(*) FILTER (quality = 1) * 1.0 AS pos, count(*) FILTER (quality = 0) * 1.0 AS neg FROM labels)", "ratio weight")
def ag29(t: Tables):
    got = t.read("labels").agg(ratio(F.count_if(F.col("quality") == 0).cast("double"), F.count_if(F.col("quality") == 1).cast("double")).alias("ratio"))
    return got.withColumn("weight", F.when((F.col("ratio") < 0.67) | (F.col("ratio") > 1.5), F.col("ratio")).otherwise(1.0))


FLIPS = """SELECT entity, n, mu, s0, r1, r2, r, (r1 + r2 / r) / (n / 252.0) AS lam1, (r * r1 + r2) / (n / 252.0) AS lam2 FROM (SELECT entity, count(z) AS n, avg(z) * 252 AS mu, stddev_samp(z) AS s0, count(*) FILTER (z < 0 AND nz >= 0) * 1.0 AS r1, count(*) FILTER (z > 0 AND nz <= 0) * 1.0 AS r2, count(*) FILTER (z > 0) * 1.0 / nullif(count(*) FILTER (z < 0), 0) AS r FROM (SELECT entity, z, lead(z) OVER (PARTITION BY entity ORDER BY day) AS nz FROM (SELECT entity, day, ln(price / lag(price) OVER (PARTITION BY entity ORDER BY day)) AS z FROM panel) WHERE z IS NOT NULL) GROUP BY 1)"""


def persistence(t: Tables):
    w = R.along("entity", "day")
    z = t.panel.select("entity", "day", F.log(ratio(F.col("price"), F.lag("price").over(w))).alias("z")).where("z is not null").withColumn("nz", F.lead("z").over(w))
    one = F.lit(1.0)
    got = z.groupBy("entity").agg(F.count("z").alias("n"), (F.avg("z") * 252).alias("mu"), F.stddev_samp("z").alias("s0"), (F.count_if((F.col("z") < 0) & (F.col("nz") >= 0)) * one).alias("r1"), (F.count_if((F.col("z") > 0) & (F.col("nz") <= 0)) * one).alias("r2"), ratio(F.count_if(F.col("z") > 0) * one, F.count_if(F.col("z") < 0) * one).alias("r"))
    years = F.col("n") / 252.0
    return got.withColumns({"lam1": ratio(F.col("r1") + ratio(F.col("r2"), F.col("r")), years), "lam2": ratio(F.col("r") * F.col("r1") + F.col("r2"), years)})


@query("ag30_persistence", FLIPS, "mu s0 r1 r2 r lam1 lam2", "", "n")
def ag30(t: Tables):
    return persistence(t)


@query("ag31_table_fingerprint", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, bit_xor(h) AS digest, sum(h) AS sum FROM (SELECT *, CAST('0x' || substr(sha256(o_orderkey || '|' || o_custkey || '|' || CAST(round(o_totalprice * 100) AS BIGINT) || '|' || strftime(o_orderdate, '%Y-%m-%d')), 1, 8) AS BIGINT) AS h FROM orders)", "", "", "n keys digest sum")
def ag31(t: Tables):
    """Rows, keys, first and last, and digests of all rows that their order does not change."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    row = F.concat_ws("|", "o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long"), day("o_orderdate"))
    h = F.conv(F.substring(F.sha2(row, 256), 1, 8), 16, 10).cast("long")
    return t.read("orders").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("keys"), day(F.min("o_orderdate")).alias("first"), day(F.max("o_orderdate")).alias("last"), F.bit_xor(h).alias("digest"), F.sum(h).alias("sum"))


@query("ag32_compare_snapshots", "SELECT CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS kind, count(*) AS n FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 11 <> 0) b ON a.k = b.k GROUP BY 1", "", "", "n")
def ag32(t: Tables):
    rows = t.read("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    a = rows.where("k % 7 <> 0").select("k", F.struct("v").alias("a"))
    b = rows.where("k % 11 <> 0").select("k", F.struct(F.when(F.col("k") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("v")).alias("b"))
    kind = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, "k", "full").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("fn16_sell_rule", f"SELECT entity, phi, CASE WHEN phi <= 0 THEN 'NONE' WHEN f1 >= 0.05 THEN 'I' ELSE 'II' END AS kase, threshold, coalesce(1.0 >= threshold, false) AS sell FROM (SELECT *, CASE WHEN f1 >= 0.05 AND phi > 0 THEN (0.05 + lam1 - f1) / (0.05 + lam1) * 0.001 * beta / (beta - 1) END AS threshold FROM (SELECT *, ((0.05 + lam1) * f2 + (0.05 + lam2) * f1 - sqrt(greatest(0, power((0.05 + lam1) * f2 + (0.05 + lam2) * f1, 2) - 4 * f1 * f2 * ((0.05 + lam1) * (0.05 + lam2) - lam1 * lam2)))) / (2 * f1 * f2) AS beta FROM (SELECT *, (0.05 + lam1 - f1) * (0.05 + lam2 - f2) - lam1 * lam2 AS phi FROM (SELECT *, mu + s0 / sqrt(1 / 252.0) * sqrt(lam1 * (lam1 + lam2) / (2 * lam2)) AS f1, mu - s0 / sqrt(1 / 252.0) * sqrt(lam2 * (lam1 + lam2) / (2 * lam1)) AS f2 FROM ({FLIPS}) WHERE lam1 > 0 AND lam2 > 0))))", "phi threshold")
def fn16(t: Tables):
    from panelwright.functions.scalar import sell_rule

    c = F.col
    p = persistence(t).where("lam1 > 0 and lam2 > 0")
    sigma = c("s0") / F.sqrt(F.lit(1 / 252.0))
    p = p.withColumns({"f1": c("mu") + sigma * F.sqrt(c("lam1") * (c("lam1") + c("lam2")) / (2 * c("lam2"))), "f2": c("mu") - sigma * F.sqrt(c("lam2") * (c("lam1") + c("lam2")) / (2 * c("lam1")))})
    rule = sell_rule(c("f1"), c("f2"), c("lam1"), c("lam2"), F.lit(1.0), F.lit(True), 0.05, 0.001)
    return p.select("entity", rule["phi"].alias("phi"), rule["case"].alias("kase"), rule["threshold"].alias("threshold"), rule["sell"].alias("sell"))


@query("w15b_direction_counts", "SELECT direction, count(*) AS n FROM (SELECT CASE WHEN sue - lag(sue) OVER (PARTITION BY entity ORDER BY quarter) > 0 THEN 'up' ELSE 'down' END AS direction FROM (SELECT * FROM (SELECT entity, quarter, surprise, CASE WHEN count(surprise) OVER w >= 4 THEN surprise / nullif(stddev_samp(surprise) OVER w, 0) END AS sue FROM (SELECT entity, quarter, eps - lag(eps, 4) OVER (PARTITION BY entity ORDER BY quarter) AS surprise FROM facts) WINDOW w AS (PARTITION BY entity ORDER BY quarter ROWS 7 PRECEDING)) WHERE sue IS NOT NULL)) GROUP BY 1", "", "", "n")
def w15b(t: Tables):
    known = surprises(t).where("sue is not null")
    up = F.coalesce(F.col("sue") - F.lag("sue").over(R.along("entity", "quarter")) > 0, F.lit(False))
    return known.select(F.when(up, "up").otherwise("down").alias("direction")).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))
