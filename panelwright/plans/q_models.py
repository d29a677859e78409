"""Queries over model, evaluation and portfolio jobs: ML1-ML17."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import clip, graded_regime, multiplier, ratio, shrink
from panelwright.operators import boosting as B
from panelwright.operators import models as M
from panelwright.operators import panel as P
from panelwright.operators import rolling as R
from panelwright.operators.durable import saved
from panelwright.operators.quantiles import exact_quantiles
from panelwright.plans.q_aggregates import PAIRS, WEIGHTS, paired_means
from panelwright.plans.q_relational import FOLDS, REGIME_SQL, TOP
from panelwright.plans.q_windows import METRICS, metrics_sql
from panelwright.plans.registry import Tables, query

FOLD_SQL = f"SELECT f.i - 39 AS fold, a.test_month AS train_start, e.test_month AS train_end, f.test_month FROM ({FOLDS}) f JOIN ({FOLDS}) e ON e.i = f.i - 3 JOIN ({FOLDS}) a ON a.i = greatest(1, f.i - 3 - 24 + 1) WHERE f.i > 39"


@query("ml1_folds", FOLD_SQL, "", "train_start train_end test_month", "fold")
def ml1(t: Tables):
    return M.folds(t.scored.select("month").distinct(), "month", 36, 3, 24)


@query("ml2_evaluation_split", "SELECT entity, month, month IN (SELECT month FROM (SELECT DISTINCT month FROM scored) ORDER BY month DESC LIMIT 6) AS evaluate FROM scored", "", "month")
def ml2(t: Tables):
    return M.with_evaluation(t.scored.select("entity", "month"), "month", 6).select("entity", "month", "evaluate")


SHORT = "SELECT entity, month, row_number() OVER (ORDER BY month, entity) AS r, count(*) OVER () AS n FROM scored WHERE month IN (SELECT month FROM (SELECT DISTINCT month FROM scored) ORDER BY month LIMIT 5)"


@query("ml2b_evaluation_fallback", f"SELECT entity, month, r > floor(n * 0.8) AS evaluate FROM ({SHORT})", "", "month")
def ml2b(t: Tables):
    """With five months there are too few for six of evaluation: the last fifth of the rows is taken."""
    rows = t.scored.select("entity", "month")
    first = F.broadcast(rows.select("month").distinct().orderBy("month").limit(5))
    return M.with_evaluation(rows.join(first, "month"), "month", 6, order=["entity"]).select("entity", "month", "evaluate")


def _boosted(t: Tables):
    """Rows that all folds read: written once, so that fits have as many tasks as the rows fill and not one for each shuffle partition of the tables behind them."""
    rows, _ = saved(t.scored.join(t.ret, ["entity", "month"]).select("entity", "month", F.col("label").cast("double").alias("label"), F.col("score").alias("x"), "ret"))
    return rows.cache()


def _early_stopping(trees: int, depth: int):
    """Fits a fold: its last six months stop the training."""
    return lambda part: M.fit_fold(M.with_evaluation(part, "month", 6, order=["entity"]), ["x", "ret"], "label", "evaluate", trees, depth, "0.8")


@query("ml3_boosted_trees")
def ml3(t: Tables):
    """A boosted-tree model for each yearly fold, stopped early by its last six months: trees kept and importance of each feature."""
    rows = _boosted(t)
    folds = M.folds(rows.select("month").distinct(), "month", 36, 3).where("fold % 12 = 1")
    models = M.fit_folds(folds, rows, "month", _early_stopping(20, 4))
    told = [(m, len(x.stages[-1].trees), f, w) for m, x in models.items() for f, w in zip(["x", "ret"], x.stages[-1].featureImportances.toArray().tolist(), strict=True)]
    return t.spark.createDataFrame(told, "test_month date, trees int, feature string, importance double")


@query("ml3c_staged_rounds")
def ml3c(t: Tables):
    """For the last fold: one fit on all but its last six months, the AUC on these of every prefix of its trees, and which prefix is kept."""
    features = ["score", "fwd_lag"]
    rows = t.scored.withColumn("fwd_lag", F.lag("fwd").over(R.along("entity", "month"))).select("entity", "month", F.col("label").cast("double").alias("label"), "score", "fwd_lag")
    last = M.folds(rows.select("month").distinct(), "month", 36, 3).orderBy(F.desc("fold")).first()
    told = M.with_evaluation(rows.where(F.col("month") <= F.lit(last.train_end)), "month", order=["month", "entity"])
    model = M.fit_fold(told.where("not evaluate"), features, "label", trees=30, depth=3)
    auc = B.staged_auc(model, told.where("evaluate"), "label", features)
    kept = B.rounds_kept([tuple(r) for r in auc.collect()])  # a row for each round
    return auc.withColumn("kept", F.lit(kept) == F.col("round"))


@query("ml4_walk_forward_scores")
def ml4(t: Tables):
    """All folds, each scored by its own model, which its last six months stop early."""
    rows = _boosted(t)
    folds = M.folds(rows.select("month").distinct(), "month", 36, 3)
    models = M.fit_folds(folds, rows, "month", _early_stopping(5, 3))
    return M.score_folds(models, rows, "month", ["x", "ret"]).select("entity", "month", "label", "score")


@query("ml4b_frozen_scores")
def ml4b(t: Tables):
    """The first fold's model, frozen, scores all months after its training."""
    rows = _boosted(t)
    fold = M.folds(rows.select("month").distinct(), "month", 36, 3).where("fold = 1")
    model = list(M.fit_folds(fold, rows, "month", _early_stopping(10, 3)).items())
    last = rows.agg(F.max("month")).first()[0]
    return M.score_range(model[0][1], rows, "month", model[0][0], last, ["x", "ret"]).select("entity", "month", "label", "score")


RANKED = "SELECT period, label, rank() OVER (PARTITION BY period ORDER BY score) + (count(*) OVER (PARTITION BY period, score) - 1) / 2.0 AS r FROM (SELECT CAST(year(month) AS VARCHAR) AS period, label, score FROM scored UNION ALL SELECT 'all', label, score FROM scored)"
AUC = f"SELECT period, (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0) AS auc FROM ({RANKED}) GROUP BY 1"


@query("ml5_auc", AUC, "auc")
def ml5(t: Tables):
    """AUC of each year and of all rows."""
    rows = t.scored.select(F.year("month").cast("string").alias("period"), "label", "score")
    yearly = R.average_rank(rows, "score", "period", "r")
    every = R.average_rank(rows.select(F.lit("all").alias("period"), "label", "score"), "score", None, "r")
    pos, neg = F.sum("label"), F.sum(1 - F.col("label"))
    area = ratio(F.sum(F.when(F.col("label") == 1, F.col("r"))) - pos * (pos + 1) / 2, (pos * neg).cast("double"))
    return yearly.select("period", "label", "r").unionByName(every.select("period", "label", "r")).groupBy("period").agg(area.alias("auc"))


@query("ml5b_score_distribution", "SELECT label, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS sd, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS q2, quantile_cont(score, 0.75) AS q3 FROM scored GROUP BY 1", "mean sd q1 q2 q3", "", "label n")
def ml5b(t: Tables):
    """Scores by label, with exact quartiles."""
    told = t.scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))
    return told.join(exact_quantiles(t.scored, ["label"], "score", {"q1": 0.25, "q2": 0.5, "q3": 0.75}), "label")


@query("ml6_labelled_dataset", "SELECT s.entity, s.month, r.ret, two.vix, s.fwd, s.label FROM scored s LEFT JOIN ret r USING (entity, month) LEFT JOIN two USING (month)", "ret vix fwd", "month", "label")
def ml6(t: Tables):
    rows = P.merge_left(t.scored.select("entity", "month", "fwd", "label"), [t.ret], ["entity", "month"])
    return rows.join(P.small(t.two.select("month", "vix")), "month", "left").select("entity", "month", "ret", "vix", "fwd", "label")


ML7 = """SELECT * FROM (SELECT e.entity, c.month, last_value(m.price IGNORE NULLS) OVER w AS price, last_value(r.ret IGNORE NULLS) OVER (PARTITION BY e.entity ORDER BY c.month ROWS 2 PRECEDING) AS ret, f.revenue, two.vix FROM (SELECT DISTINCT entity FROM monthly) e CROSS JOIN (SELECT DISTINCT month FROM monthly) c LEFT JOIN monthly m ON m.entity = e.entity AND m.month = c.month LEFT JOIN ret r ON r.entity = e.entity AND r.month = c.month LEFT JOIN facts f ON f.entity = e.entity AND f.quarter = c.month LEFT JOIN two ON two.month = c.month WINDOW w AS (PARTITION BY e.entity ORDER BY c.month)) WHERE (CASE WHEN price IS NULL THEN 1 ELSE 0 END + CASE WHEN ret IS NULL THEN 1 ELSE 0 END + CASE WHEN revenue IS NULL THEN 1 ELSE 0 END + CASE WHEN vix IS NULL THEN 1 ELSE 0 END) / 4.0 <= 0.5"""


@query("ml7_feature_matrix", ML7, "price ret revenue vix", "month")
def ml7(t: Tables):
    """Price, filing and macro features on every (entity, month end): filled forward, rows mostly missing dropped."""
    spine = P.densify(t.monthly.select("entity", "month", "price"), "entity", "month")
    facts = t.facts.select("entity", F.col("quarter").alias("month"), "revenue")
    rows = P.merge_left(spine, [t.ret, facts], ["entity", "month"]).join(P.small(t.two.select("month", "vix")), "month", "left")
    rows = rows.withColumns({"price": P.filled(F.col("price"), "entity", "month"), "ret": P.filled(F.col("ret"), "entity", "month", 2)})
    missing = sum(F.col(c).isNull().cast("int") for c in ("price", "ret", "revenue", "vix"))
    return rows.where(missing / 4 <= 0.5).select("entity", "month", "price", "ret", "revenue", "vix")


ML8_CELLS = "SELECT k.key, w.week, coalesce(c.n, 0) AS n, c.raw FROM (SELECT DISTINCT key FROM news) k CROSS JOIN (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS week FROM news) w LEFT JOIN (SELECT key, CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS n, avg(score) AS raw FROM news GROUP BY 1, 2) c ON c.key = k.key AND c.week = w.week"
ML8_SHRUNK = f"SELECT key, week, n, CASE WHEN n = 0 THEN prior ELSE n / (n + 10.0) * raw + 10 / (n + 10.0) * prior END AS shrunk FROM ({ML8_CELLS}) JOIN (SELECT week, coalesce(avg(raw), 0) AS prior FROM ({ML8_CELLS}) GROUP BY 1) USING (week)"
ML8_SMOOTH = f"SELECT a.key, a.week, max(a.n) AS n, sum(b.shrunk * power(0.6, a.i - b.i)) / sum(power(0.6, a.i - b.i)) AS smooth FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY week) AS i FROM ({ML8_SHRUNK})) a JOIN (SELECT *, row_number() OVER (PARTITION BY key ORDER BY week) AS i FROM ({ML8_SHRUNK})) b ON a.key = b.key AND b.i <= a.i GROUP BY 1, 2"


@query("ml8_news_factor", f"SELECT key, week, n, smooth, CASE WHEN coalesce(stddev_samp(smooth) OVER (PARTITION BY week), 0) = 0 THEN 0 ELSE greatest(-3, least(3, (smooth - avg(smooth) OVER (PARTITION BY week)) / stddev_samp(smooth) OVER (PARTITION BY week))) END AS z FROM ({ML8_SMOOTH})", "smooth z", "week", "n")
def ml8(t: Tables):
    """Mean by key and period, shrunk to the period's mean of means, smoothed, made a z-score."""
    own = t.news.groupBy("key", F.trunc("day", "week").alias("week")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("raw"))
    cells = P.densify(own, "key", "week").fillna(0, ["n"])
    prior = cells.groupBy("week").agg(F.coalesce(F.avg("raw"), F.lit(0.0)).alias("prior"))
    cells = cells.join(P.small(prior), "week").withColumn("shrunk", shrink(F.col("raw"), F.col("n"), F.col("prior")))
    smooth = cells.select("key", "week", "n", R.ewm("shrunk", "key", "week", 4).alias("smooth"))
    return R.cross_z(smooth, "smooth", "week", "z", zero_sd=0.0, cap=3.0, missing=0.0).select("key", "week", "n", "smooth", "z")


@query("ml9_forecast_factor", "SELECT entity, month, exp(21 * (ln(last) - ln(first)) / (n - 1)) - 1 AS forecast FROM (SELECT m.entity, m.month, count(*) AS n, arg_min(p.price, p.day) AS first, arg_max(p.price, p.day) AS last FROM (SELECT DISTINCT entity, last_day(day) AS month FROM panel) m JOIN (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day) AS i FROM panel) p ON p.entity = m.entity AND p.day <= m.month JOIN (SELECT entity, last_day(day) AS month, max(i) AS top FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day) AS i FROM panel) GROUP BY 1, 2) x ON x.entity = m.entity AND x.month = m.month AND p.i > x.top - 252 GROUP BY 1, 2) WHERE n >= 63", "forecast", "month")
def ml9(t: Tables):
    """A forecaster over context windows; the default one goes on with the mean log increment for 21 steps."""
    from panelwright.plans.q_windows import contexts

    return M.forecast(contexts(t.panel), "context", M.drift(21)).select("entity", "month", "forecast")


HOLD = f"SELECT entity, month, weight FROM ({TOP})"
DAILY = f"SELECT d.day, p.entity, coalesce(h.weight, 0) AS weight FROM (SELECT day, (SELECT max(month) FROM ({HOLD}) x WHERE x.month <= day) AS month FROM cal) d CROSS JOIN ents p LEFT JOIN ({HOLD}) h ON h.month = d.month AND h.entity = p.entity WHERE d.month IS NOT NULL"


def daily_weights(t: Tables):
    held = R.top_n(t.scored, "month", "score", "entity", 5, 0.52).select("entity", "month", "weight")
    days = t.panel.select("day").distinct().withColumn("one", F.lit(1))
    marks = held.select("month").distinct().select(F.lit(1).alias("one"), F.col("month").alias("day"), "month")
    at = P.as_of(days, marks, ["one"], "day", ["month"]).where("month is not null").select("day", "month")
    spine = at.crossJoin(P.small(t.panel.select("entity").distinct()))
    return spine.join(held, ["entity", "month"], "left").select("day", "entity", F.coalesce("weight", F.lit(0.0)).alias("weight"))


@query("ml10_daily_weights", DAILY, "weight", "day")
def ml10(t: Tables):
    return daily_weights(t)


@query("fn14_exposure_series", f"SELECT w.day, w.entity, w.weight * coalesce(r.m, 1.0) AS weight FROM ({DAILY}) w ASOF LEFT JOIN (SELECT month, {REGIME_SQL} AS m FROM two) r ON w.day >= r.month", "weight", "day")
def fn14(t: Tables):
    """Monthly multipliers carried to days and scaled into the daily weights; before the first month the exposure is 1."""
    months = t.two.select(F.lit(1).alias("one"), F.col("month").alias("day"), multiplier(graded_regime(F.col("vix"), F.col("spread"))).alias("m"))
    days = t.panel.select("day").distinct().withColumn("one", F.lit(1))
    exposure = P.as_of(days, months, ["one"], "day", ["m"]).select("day", F.coalesce("m", F.lit(1.0)).alias("m"))
    return daily_weights(t).join(P.small(exposure), "day").select("day", "entity", (F.col("weight") * F.col("m")).alias("weight"))


ML11 = f"""SELECT day, gross - cost AS ret, b.ret AS benchmark FROM (SELECT day, sum(coalesce(pw, 0) * coalesce(r, 0)) AS gross, sum(abs(weight - coalesce(pw, 0))) * 0.0015 AS cost FROM (SELECT w.day, w.entity, w.weight, lag(w.weight) OVER (PARTITION BY w.entity ORDER BY w.day) AS pw, d.r FROM ({DAILY}) w JOIN (SELECT entity, day, price / lag(price) OVER (PARTITION BY entity ORDER BY day) - 1 AS r FROM dense) d ON d.entity = w.entity AND d.day = w.day) GROUP BY 1) LEFT JOIN (SELECT day, p / lag(p) OVER (ORDER BY day) - 1 AS ret FROM (SELECT day, avg(price) AS p FROM panel GROUP BY 1)) b USING (day)"""


@query("ml11_portfolio_path", ML11, "ret benchmark", "day")
def ml11(t: Tables):
    """Yesterday's weights earn today's returns; turnover costs fee and slippage; beside it the mean price, bought and held."""
    rets = t.dense.select("entity", "day", R.growth("price", "entity", "day").alias("r"))
    rows = daily_weights(t).join(rets, ["entity", "day"]).withColumn("pw", F.coalesce(F.lag("weight").over(R.along("entity", "day")), F.lit(0.0)))
    path = rows.groupBy("day").agg((F.sum(F.col("pw") * F.coalesce("r", F.lit(0.0))) - F.sum(F.abs(F.col("weight") - F.col("pw"))) * 0.0015).alias("ret"))
    index = t.panel.groupBy("day").agg(F.avg("price").alias("p")).withColumn("index", F.lit("mean"))  # one row a day
    return path.join(P.small(index.select("day", R.growth("p", "index", "day").alias("benchmark"))), "day", "left")


@query("ml12_comparison", f"SELECT metric, strategy, value, strategy = arg_max(strategy, value) OVER (PARTITION BY metric) AS winner FROM (SELECT strategy, unnest(['total', 'cagr', 'sharpe', 'max_dd']) AS metric, unnest([total, cagr, sharpe, max_dd]) AS value FROM ({metrics_sql('strategy', 'SELECT strategy, month, ret FROM strat')}))", "value")
def ml12(t: Tables):
    """Every metric of every strategy, and which one is best."""
    got = R.path_metrics(t.ret.where("ret is not null").withColumnRenamed("entity", "strategy"), ["strategy"], "month", "ret", per_year=12.0)
    long = got.unpivot("strategy", ["total", "cagr", "sharpe", "max_dd"], "metric", "value")
    best = long.groupBy("metric").agg(F.max_by("strategy", "value").alias("best"))
    return long.join(F.broadcast(best), "metric").select("metric", "strategy", "value", (F.col("strategy") == F.col("best")).alias("winner"))


INDEXED = "SELECT ret, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS n FROM index_ret"
DRAWS = f"SELECT d.draw, avg(x.ret) AS mean FROM (SELECT unnest(range(200)) AS draw) d CROSS JOIN (SELECT max(n) AS n FROM ({INDEXED})) c CROSS JOIN LATERAL (SELECT unnest(range((c.n + 5) // 6)) AS b) e CROSS JOIN (SELECT unnest(range(6)) AS o) f JOIN ({INDEXED}) x ON x.i = (CAST('0x' || substr(md5('7-' || d.draw || '-' || e.b), 1, 8) AS BIGINT) % c.n + f.o) % c.n WHERE e.b * 6 + f.o < c.n GROUP BY 1"


@query("ml13_block_bootstrap", f"SELECT quantile_cont(mean, 0.05) AS p05, quantile_cont(mean, 0.5) AS p50, quantile_cont(mean, 0.95) AS p95 FROM ({DRAWS})", "p05 p50 p95")
def ml13(t: Tables):
    """Percentiles of the mean monthly return over 200 circular block resamples."""
    index = t.ret.where("ret is not null").groupBy("month").agg(F.avg("ret").alias("ret")).withColumn("i", F.row_number().over(Window.orderBy("month")) - 1)
    draws = M.block_bootstrap(index, "i", "ret", index.count(), 6, 200)
    return draws.agg(F.percentile("mean", 0.05).alias("p05"), F.percentile("mean", 0.5).alias("p50"), F.percentile("mean", 0.95).alias("p95"))


RANKED = """SELECT draw, day, a, b, times, sum(times) OVER (PARTITION BY draw ORDER BY a) - sum(times) OVER (PARTITION BY draw, a) + (sum(times) OVER (PARTITION BY draw, a) + 1) / 2.0 AS ra,
 sum(times) OVER (PARTITION BY draw ORDER BY b) - sum(times) OVER (PARTITION BY draw, b) + (sum(times) OVER (PARTITION BY draw, b) + 1) / 2.0 AS rb"""
DAYS = f"SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM ({PAIRS}) WHERE a IS NOT NULL AND b IS NOT NULL)"
TIMES = f"SELECT d.draw, x.day, count(*) AS times FROM (SELECT unnest(range(100)) AS draw) d CROSS JOIN (SELECT max(n) AS n FROM ({DAYS})) c CROSS JOIN LATERAL (SELECT unnest(range((c.n + 4) // 5)) AS b) e CROSS JOIN (SELECT unnest(range(5)) AS o) f JOIN ({DAYS}) x ON x.i = (CAST('0x' || substr(md5('7-' || d.draw || '-' || e.b), 1, 8) AS BIGINT) % c.n + f.o) % c.n WHERE e.b * 5 + f.o < c.n GROUP BY 1, 2"
CORRELATED = f"SELECT draw, (sum(times * ra * rb) - sum(times * ra) * sum(times * rb) / sum(times)) / sqrt((sum(times * ra * ra) - sum(times * ra) * sum(times * ra) / sum(times)) * (sum(times * rb * rb) - sum(times * rb) * sum(times * rb) / sum(times))) AS r FROM ({RANKED} FROM ({PAIRS}) p JOIN ({TIMES}) w USING (day) WHERE a IS NOT NULL AND b IS NOT NULL) GROUP BY 1"


@query("ml13b_correlation_interval", f"SELECT quantile_cont(r, 0.05) AS p05, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.95) AS p95 FROM ({CORRELATED})", "p05 p50 p95")
def ml13b(t: Tables):
    """An interval of the rank correlation of paired means: 100 resamples of blocks of five days, each with all its pairs."""
    pairs = paired_means(t)
    days = pairs.select("day").distinct().withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)  # a row for each day
    draws = M.bootstrapped_rank_correlation(pairs.join(P.small(days), "day"), "i", "a", "b", days.count(), 5, 100)
    return draws.agg(*(F.percentile("correlation", p).alias(n) for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))))  # a row for each draw


@query("ml14_perturbed_worlds", "SELECT quantile_cont(sharpe, 0.05) AS p05, quantile_cont(sharpe, 0.5) AS p50, quantile_cont(sharpe, 0.95) AS p95 FROM (SELECT world, avg(m) / nullif(stddev_samp(m), 0) * sqrt(12) AS sharpe FROM (SELECT world, month, avg(fwd * (1 + ((world * 7 + month(month)) % 5 - 2) * 0.1)) AS m FROM scored CROSS JOIN (SELECT unnest(range(20)) AS world) GROUP BY 1, 2) GROUP BY 1)", "p05 p50 p95")
def ml14(t: Tables):
    worlds = t.spark.range(20).withColumnRenamed("id", "world")
    draw = F.col("fwd") * (1 + ((F.col("world") * 7 + F.month("month")) % 5 - 2) * 0.1)
    paths = t.scored.crossJoin(F.broadcast(worlds)).groupBy("world", "month").agg(F.avg(draw).alias("m"))
    sharpe = paths.groupBy("world").agg((ratio(F.avg("m"), F.stddev_samp("m")) * F.sqrt(F.lit(12.0))).alias("sharpe"))
    return sharpe.agg(*(F.percentile("sharpe", p).alias(n) for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))))


@query("ml15_estimator_stability", "SELECT entity, stddev_samp(fwd) / nullif(abs(avg(fwd)), 0) AS rse, avg(CASE WHEN fwd < 0 THEN 1.0 ELSE 0 END) AS flips FROM fwd WHERE fwd IS NOT NULL GROUP BY 1", "rse flips")
def ml15(t: Tables):
    return t.fwd.where("fwd is not null").groupBy("entity").agg(ratio(F.stddev_samp("fwd"), F.abs(F.avg("fwd"))).alias("rse"), F.avg((F.col("fwd") < 0).cast("double")).alias("flips"))


@query("ml16_target_book", f"SELECT t.month, t.entity, t.weight * {REGIME_SQL} AS weight, sum(t.weight * {REGIME_SQL}) OVER (PARTITION BY t.month) AS gross, 1 - sum(t.weight * {REGIME_SQL}) OVER (PARTITION BY t.month) AS cash FROM ({TOP}) t JOIN two USING (month)", "weight gross cash", "month")
def ml16(t: Tables):
    regime = t.two.select("month", multiplier(graded_regime(F.col("vix"), F.col("spread"))).alias("m"))
    book = R.top_n(t.scored, "month", "score", "entity", 5, 0.52).join(P.small(regime), "month")
    book = book.select("month", "entity", (F.col("weight") * F.col("m")).alias("weight"))
    gross = book.groupBy("month").agg(F.sum("weight").alias("gross"))
    return book.join(P.small(gross), "month").withColumn("cash", 1 - F.col("gross"))


WEIGHED = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} / den ELSE 0 END" for c, w in WEIGHTS.items())
DEN = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END" for c, w in WEIGHTS.items())


@query("ml17_panel_checks", f"""SELECT 'null_without_inputs' AS rule, count(*) FILTER ((ret IS NULL) <> (z IS NULL)) AS violations FROM (SELECT ret, CASE WHEN ret IS NOT NULL THEN greatest(-3, least(3, ret)) END AS z FROM ret) UNION ALL SELECT 'infinite', count(*) FILTER (isinf(ret)) FROM ret
 UNION ALL SELECT 'early_coverage', count(*) FILTER (n < 3) FROM (SELECT month, count(ret) AS n FROM ret GROUP BY 1 ORDER BY 1 LIMIT 12) UNION ALL SELECT 'late_coverage', count(*) FILTER (n < 3) FROM (SELECT month, count(ret) AS n FROM ret GROUP BY 1 ORDER BY 1 DESC LIMIT 12)
 UNION ALL SELECT 'used_weights', count(*) FILTER (abs({WEIGHED} - 1) > 1e-9) FROM (SELECT *, nullif({DEN}, 0) AS den FROM facts) UNION ALL SELECT 'nothing_used', count(*) FILTER (({DEN}) = 0) FROM facts""", "", "", "violations")
def ml17(t: Tables):
    """Violations of each rule: scores are NULL where inputs are, none is infinite, the first and last year's months are covered, used weights sum to 1."""
    z = clip(F.col("ret"), 3.0)
    of = lambda df, name, bad: df.agg(F.count_if(bad).alias("violations")).select(F.lit(name).alias("rule"), "violations")
    no = F.lit(False)
    months = t.ret.groupBy("month").agg(F.count("ret").alias("n"))
    weights = {c: F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in WEIGHTS.items()}
    total = sum(weights.values())
    share = sum(ratio(w, total) for w in weights.values())
    checks = [
        of(t.ret, "null_without_inputs", F.col("ret").isNull() != z.isNull()),
        of(t.ret, "infinite", F.coalesce(F.abs("ret") == float("inf"), no)),
        of(months.orderBy("month").limit(12), "early_coverage", F.col("n") < 3),
        of(months.orderBy(F.desc("month")).limit(12), "late_coverage", F.col("n") < 3),
        of(t.facts, "used_weights", F.coalesce(F.abs(share - 1) > 1e-9, no)),
        of(t.facts, "nothing_used", total == 0),
    ]
    return reduce(DataFrame.unionByName, checks)
