"""Queries over windows: W1-W31."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import clip, ratio
from panelwright.operators import panel as P
from panelwright.operators import rolling as R
from panelwright.plans.registry import Tables, query

W_DENSE = "OVER (PARTITION BY entity ORDER BY day"
W_Q = "OVER (PARTITION BY entity ORDER BY quarter"


@query("w1_skip_return", f"""SELECT entity, day, lag(price, 5) {W_DENSE}) / lag(price, 26) {W_DENSE}) - 1 AS m21, lag(price, 5) {W_DENSE}) / lag(price, 68) {W_DENSE}) - 1 AS m63 FROM dense""", "m21 m63", "day")
def w1(t: Tables):
    return t.dense.select("entity", "day", *(R.skip_return("price", "entity", "day", 5, n).alias(f"m{n}") for n in (21, 63)))


@query("w2_volume_z", f"""SELECT entity, day, CASE WHEN count(volume) {W_DENSE} ROWS 19 PRECEDING) = 20 THEN (volume - avg(volume) {W_DENSE} ROWS 19 PRECEDING)) / nullif(stddev_samp(volume) {W_DENSE} ROWS 19 PRECEDING), 0) END AS z, 0.0 AS z_unavailable FROM panel""", "z z_unavailable", "day")
def w2(t: Tables):
    """Rolling z of volume; of an input that is wholly unavailable it is 0."""
    rows = t.panel.withColumn("turnover", F.lit(None).cast("double"))
    rows = R.rolling_z_or(R.rolling_z_or(rows, "volume", "entity", "day", 20, "z"), "turnover", "entity", "day", 20, "z_unavailable")
    return rows.select("entity", "day", "z", "z_unavailable")


@query("w3_realised_vol", f"""SELECT entity, day, vol, 1 / nullif(vol, 0) AS inverse FROM (SELECT entity, day, CASE WHEN count(lr) {W_DENSE} ROWS 20 PRECEDING) = 21 THEN stddev_samp(lr) {W_DENSE} ROWS 20 PRECEDING) * sqrt(252) END AS vol FROM (SELECT entity, day, ln(price / lag(price) {W_DENSE})) AS lr FROM panel))""", "vol inverse", "day")
def w3(t: Tables):
    lr = t.panel.withColumn("lr", F.log(ratio(F.col("price"), F.lag("price").over(R.along("entity", "day")))))
    vol = lr.select("entity", "day", (R.rolling(F.stddev_samp, F.col("lr"), "entity", "day", 21) * F.sqrt(F.lit(252.0))).alias("vol"))
    return vol.withColumn("inverse", ratio(F.lit(1.0), F.col("vol")))


def _z(value: str, least: int, zero: str, missing: str | None, table: str, period: str) -> str:
    w = f"OVER (PARTITION BY {period})"
    z = f"CASE WHEN count({value}) {w} < {least} THEN NULL WHEN coalesce(stddev_samp({value}) {w}, 0) = 0 THEN {zero} ELSE ({value} - avg({value}) {w}) / stddev_samp({value}) {w} END"
    z = f"CASE WHEN {z} IS NOT NULL THEN greatest(-3, least(3, {z})) END"
    return f"SELECT entity, {period}, {f'coalesce({z}, {missing})' if missing else z} AS z FROM {table}"


@query("w4_cross_z", _z("price", 1, "NULL", None, "monthly", "month"), "z", "month")
def w4(t: Tables):
    return R.cross_z(t.monthly, "price", "month", "z", cap=3.0).select("entity", "month", "z")


@query("w5_cross_z_least", _z("debt / nullif(equity, 0)", 10, "0", None, "facts", "quarter"), "z", "quarter")
def w5(t: Tables):
    df = t.facts.withColumn("leverage", ratio(F.col("debt"), F.col("equity")))
    return R.cross_z(df, "leverage", "quarter", "z", least=10, zero_sd=0.0, cap=3.0).select("entity", "quarter", "z")


@query("w6_cross_z_filled", _z("ret", 1, "0", "0", "ret", "month"), "z", "month")
def w6(t: Tables):
    return R.cross_z(t.ret, "ret", "month", "z", zero_sd=0.0, cap=3.0, missing=0.0).select("entity", "month", "z")


@query("w7_macro_z", """SELECT series, month, CASE WHEN count(value) OVER w >= 12 THEN (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) END AS z FROM mmonth WINDOW w AS (PARTITION BY series ORDER BY month ROWS 35 PRECEDING)""", "z", "month")
def w7(t: Tables):
    return t.mmonth.select("series", "month", R.rolling_z("value", "series", "month", 36, 12).alias("z"))


@query("w8_growth", f"""SELECT entity, quarter, yoy, yoy - lag(yoy) {W_Q}) AS acceleration FROM (SELECT entity, quarter, revenue / nullif(lag(revenue, 4) {W_Q}), 0) - 1 AS yoy FROM facts)""", "yoy acceleration", "quarter")
def w8(t: Tables):
    g = t.facts.select("entity", "quarter", R.growth("revenue", "entity", "quarter", 4).alias("yoy"))
    return g.withColumn("acceleration", F.col("yoy") - F.lag("yoy").over(R.along("entity", "quarter")))


SIGNALS = {
    "roa": "gross_profit / nullif(assets, 0)", "leverage": "debt / nullif(assets, 0)", "margin": "gross_profit / nullif(revenue, 0)",
    "turnover": "revenue / nullif(assets, 0)", "liquidity": "current_assets / nullif(current_liabilities, 0)", "cfo": "operating_cf / nullif(assets, 0)",
}
W9_SQL = f"""SELECT entity, quarter, CASE WHEN gross_profit IS NOT NULL OR operating_cf IS NOT NULL OR assets IS NOT NULL OR debt IS NOT NULL OR current_assets IS NOT NULL OR current_liabilities IS NOT NULL OR shares IS NOT NULL OR revenue IS NOT NULL THEN
 CASE WHEN roa > 0 THEN 1 ELSE 0 END + CASE WHEN operating_cf > 0 THEN 1 ELSE 0 END + CASE WHEN roa > lag(roa, 4) {W_Q}) THEN 1 ELSE 0 END + CASE WHEN cfo - roa < 0 THEN 1 ELSE 0 END
 + CASE WHEN leverage < lag(leverage, 4) {W_Q}) THEN 1 ELSE 0 END + CASE WHEN liquidity > lag(liquidity, 4) {W_Q}) THEN 1 ELSE 0 END + CASE WHEN shares <= lag(shares, 4) {W_Q}) THEN 1 ELSE 0 END
 + CASE WHEN margin > lag(margin, 4) {W_Q}) THEN 1 ELSE 0 END + CASE WHEN turnover > lag(turnover, 4) {W_Q}) THEN 1 ELSE 0 END END AS score
 FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in SIGNALS.items())} FROM facts)"""


@query("w9_nine_signals", W9_SQL, "", "quarter", "score")
def w9(t: Tables):
    """The sum of nine year-ago comparisons; a missing input fails its signal, all inputs missing give NULL."""
    c = F.col
    df = t.facts.withColumns({"roa": ratio(c("gross_profit"), c("assets")), "leverage": ratio(c("debt"), c("assets")), "margin": ratio(c("gross_profit"), c("revenue")), "turnover": ratio(c("revenue"), c("assets")), "liquidity": ratio(c("current_assets"), c("current_liabilities")), "cfo": ratio(c("operating_cf"), c("assets"))})
    ago = lambda x: F.lag(x, 4).over(R.along("entity", "quarter"))
    fires = [c("roa") > 0, c("operating_cf") > 0, c("roa") > ago("roa"), c("cfo") - c("roa") < 0, c("leverage") < ago("leverage"), c("liquidity") > ago("liquidity"), c("shares") <= ago("shares"), c("margin") > ago("margin"), c("turnover") > ago("turnover")]
    score = sum(F.coalesce(f, F.lit(False)).cast("long") for f in fires)
    any_known = F.coalesce(*(c(x).cast("double") for x in ("gross_profit", "operating_cf", "assets", "debt", "current_assets", "current_liabilities", "shares", "revenue"))).isNotNull()
    return df.select("entity", "quarter", F.when(any_known, score).alias("score"))


ROE = "CASE WHEN equity > 0 THEN gross_profit / equity END"


@query("w10_ratio_sd", f"""SELECT entity, quarter, CASE WHEN count(roe) OVER w = 5 THEN stddev_samp(roe) OVER w END AS sd FROM (SELECT entity, quarter, {ROE} AS roe FROM facts) WINDOW w AS (PARTITION BY entity ORDER BY quarter ROWS 4 PRECEDING)""", "sd", "quarter")
def w10(t: Tables):
    df = t.facts.withColumn("roe", F.when(F.col("equity") > 0, ratio(F.col("gross_profit"), F.col("equity"))))
    return df.select("entity", "quarter", R.rolling(F.stddev_samp, F.col("roe"), "entity", "quarter", 5).alias("sd"))


BETA = """SELECT entity, quarter, arg_max(beta, day) AS beta FROM (SELECT entity, day, last_day(CAST(date_trunc('quarter', day) AS DATE) + INTERVAL 2 MONTH) AS quarter,
 CASE WHEN count(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN 1 END) OVER w >= 60 THEN covar_samp(r, m) OVER w END / nullif(CASE WHEN count(m) OVER w >= 60 THEN var_samp(m) OVER w END, 0) AS beta
 FROM (SELECT entity, day, r, m FROM (SELECT entity, day, price / lag(price) OVER (PARTITION BY entity ORDER BY day) - 1 AS r FROM dense) JOIN (SELECT day, price / lag(price) OVER (ORDER BY day) - 1 AS m FROM (SELECT day, avg(price) AS price FROM panel GROUP BY 1)) USING (day)) WINDOW w AS (PARTITION BY entity ORDER BY day ROWS 251 PRECEDING)) GROUP BY 1, 2"""


def beta_panel(t: Tables):
    """Quarter-end beta to the mean price of all entities."""
    own = t.dense.select("entity", "day", R.growth("price", "entity", "day").alias("r"))
    index = t.panel.groupBy("day").agg(F.avg("price").alias("price")).withColumn("one", F.lit("index"))
    market = index.select("day", R.growth("price", "one", "day").alias("m"))
    both = R.rolling_beta(own.join(market, "day"), "r", "m", "entity", "day", 252, 60, "beta").select("entity", "day", "beta")
    from panelwright.functions.scalar import quarter_end

    return P.to_period(both, quarter_end(F.col("day")), "entity", "day", ["beta"], "quarter")


@query("w11_rolling_beta", BETA, "beta", "quarter")
def w11(t: Tables):
    return beta_panel(t).select("entity", "quarter", "beta")


def _zsql(x: str) -> str:
    w = "OVER (PARTITION BY quarter)"
    return f"CASE WHEN count({x}) {w} < 10 THEN NULL WHEN {x} IS NULL THEN CASE WHEN coalesce(stddev_samp({x}) {w}, 0) = 0 THEN 0 END WHEN coalesce(stddev_samp({x}) {w}, 0) = 0 THEN 0 ELSE greatest(-3, least(3, ({x} - avg({x}) {w}) / stddev_samp({x}) {w})) END"


MEAN3 = "list_avg(list_filter([{0}], lambda x: x IS NOT NULL))"


@query("w12_safety_pillar", f"""SELECT entity, quarter, {MEAN3.format('-za, -zb, -zc')} AS safety FROM (SELECT entity, quarter, {_zsql('a')} AS za, {_zsql('b')} AS zb, {_zsql('c')} AS zc FROM
 (SELECT f.entity, f.quarter, CASE WHEN equity > 0 THEN debt / equity END AS a, CASE WHEN count({ROE}) OVER w = 5 THEN stddev_samp({ROE}) OVER w END AS b, beta AS c FROM facts f LEFT JOIN ({BETA}) q ON q.entity = f.entity AND q.quarter = f.quarter WINDOW w AS (PARTITION BY f.entity ORDER BY f.quarter ROWS 4 PRECEDING)))""", "safety", "quarter")
def w12(t: Tables):
    df = t.facts.withColumns({"a": F.when(F.col("equity") > 0, ratio(F.col("debt"), F.col("equity"))), "roe": F.when(F.col("equity") > 0, ratio(F.col("gross_profit"), F.col("equity")))})
    df = df.withColumn("b", R.rolling(F.stddev_samp, F.col("roe"), "entity", "quarter", 5)).join(beta_panel(t).withColumnRenamed("beta", "c"), ["entity", "quarter"], "left")
    for x in "abc":
        df = R.cross_z(df, x, "quarter", f"z{x}", least=10, zero_sd=0.0, cap=3.0)
    return df.select("entity", "quarter", row_mean(*(-F.col(f"z{x}") for x in "abc")).alias("safety"))


def row_mean(*columns):
    known = F.array_compact(F.array(*columns))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


@query("w13_payout_pillar", f"""SELECT entity, quarter, {MEAN3.format('za, zb')} AS payout FROM (SELECT entity, quarter, {_zsql('a')} AS za, {_zsql('b')} AS zb FROM (SELECT entity, quarter, -(shares - lag(shares, 4) {W_Q})) / nullif(lag(shares, 4) {W_Q}), 0) AS a, (coalesce(debt, 0) + coalesce(capex, 0)) / nullif(assets, 0) AS b FROM facts))""", "payout", "quarter")
def w13(t: Tables):
    ago = F.lag("shares", 4).over(R.along("entity", "quarter"))
    df = t.facts.withColumns({"a": -ratio(F.col("shares") - ago, ago), "b": ratio(F.coalesce("debt", F.lit(0.0)) + F.coalesce("capex", F.lit(0.0)), F.col("assets"))})
    for x in "ab":
        df = R.cross_z(df, x, "quarter", f"z{x}", least=10, zero_sd=0.0, cap=3.0)
    return df.select("entity", "quarter", row_mean("za", "zb").alias("payout"))


SUE = f"""SELECT entity, quarter, surprise, CASE WHEN count(surprise) OVER w >= 4 THEN surprise / nullif(stddev_samp(surprise) OVER w, 0) END AS sue FROM (SELECT entity, quarter, eps - lag(eps, 4) {W_Q}) AS surprise FROM facts) WINDOW w AS (PARTITION BY entity ORDER BY quarter ROWS 7 PRECEDING)"""


def surprises(t: Tables):
    df = t.facts.select("entity", "quarter", (F.col("eps") - F.lag("eps", 4).over(R.along("entity", "quarter"))).alias("surprise"))
    return df.withColumn("sue", ratio(F.col("surprise"), R.rolling(F.stddev_samp, F.col("surprise"), "entity", "quarter", 8, 4)))


@query("w14_seasonal_surprise", SUE, "surprise sue", "quarter")
def w14(t: Tables):
    return surprises(t)


@query("w15_revisions", f"""SELECT entity, quarter, d1 AS revision_1, sue - lag(sue, 3) {W_Q}) AS revision_3, CASE WHEN coalesce(d1, 0) > 0 THEN 'up' ELSE 'down' END AS direction, abs(coalesce(d1, 0)) AS magnitude FROM (SELECT entity, quarter, sue, sue - lag(sue) {W_Q}) AS d1 FROM ({SUE}) WHERE sue IS NOT NULL)""", "revision_1 revision_3 magnitude", "quarter")
def w15(t: Tables):
    w = R.along("entity", "quarter")
    d1 = F.col("sue") - F.lag("sue").over(w)
    known = surprises(t).where("sue is not null")
    return known.select("entity", "quarter", d1.alias("revision_1"), (F.col("sue") - F.lag("sue", 3).over(w)).alias("revision_3"), F.when(F.coalesce(d1, F.lit(0.0)) > 0, "up").otherwise("down").alias("direction"), F.abs(F.coalesce(d1, F.lit(0.0))).alias("magnitude"))


@query("w16_ratio_to_mean", f"""SELECT entity, day, CASE WHEN count(volume) {W_DENSE} ROWS 19 PRECEDING) >= 5 THEN volume / nullif(avg(volume) {W_DENSE} ROWS 19 PRECEDING), 0) END AS cover FROM panel""", "cover", "day")
def w16(t: Tables):
    return t.panel.select("entity", "day", ratio(F.col("volume"), R.rolling(F.avg, F.col("volume"), "entity", "day", 20, 5)).alias("cover"))


@query("w17_ewm", """SELECT a.entity, a.month, sum(b.ret * power(0.6, a.i - b.i)) / nullif(sum(CASE WHEN b.ret IS NOT NULL THEN power(0.6, a.i - b.i) END), 0) AS smooth FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY month) AS i FROM ret) a JOIN (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY month) AS i FROM ret) b ON a.entity = b.entity AND b.i <= a.i AND b.i > a.i - 64 GROUP BY 1, 2""", "smooth", "month")
def w17(t: Tables):
    return t.ret.select("entity", "month", R.ewm("ret", "entity", "month", 4).alias("smooth"))


@query("w18_fill", f"""SELECT entity, day, last_value(price IGNORE NULLS) {W_DENSE} ROWS UNBOUNDED PRECEDING) AS filled, last_value(price IGNORE NULLS) {W_DENSE} ROWS 2 PRECEDING) AS filled_2 FROM dense""", "filled filled_2", "day")
def w18(t: Tables):
    return t.dense.select("entity", "day", P.filled(F.col("price"), "entity", "day").alias("filled"), P.filled(F.col("price"), "entity", "day", 2).alias("filled_2"))


@query("w19_event_snapshot", """SELECT q.key, q.week, (SELECT arg_max(s.score, s.day) FROM (SELECT key, day, avg(score) AS score FROM news GROUP BY 1, 2) s WHERE s.key = q.key AND s.day <= q.week) AS score FROM (SELECT key, w.week FROM (SELECT DISTINCT key FROM news) CROSS JOIN (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) + 6 AS week FROM news) w) q""", "score", "week")
def w19(t: Tables):
    daily = t.news.groupBy("key", "day").agg(F.avg("score").alias("score"))
    weeks = t.news.select(F.date_add(F.trunc("day", "week"), 6).alias("week")).distinct()
    ends = daily.select("key").distinct().crossJoin(P.small(weeks)).withColumn("day", F.col("week"))
    return P.as_of(ends, daily, ["key"], "day", ["score"]).select("key", "week", "score")


@query("w20_forward_return", "SELECT entity, month, fwd FROM fwd", "fwd", "month")
def w20(t: Tables):
    return t.fwd.select("entity", "month", "fwd")


@query("w21_beats_benchmark", "SELECT entity, month, fwd, bench, CASE WHEN fwd > bench THEN 1 ELSE 0 END AS label FROM fwd JOIN bench USING (month) WHERE fwd IS NOT NULL", "fwd bench", "month", "label")
def w21(t: Tables):
    fwd = t.fwd.where("fwd is not null")
    bench = fwd.groupBy("month").agg(F.avg("fwd").alias("bench"))
    return fwd.join(bench, "month").select("entity", "month", "fwd", "bench", F.when(F.col("fwd") > F.col("bench"), 1).otherwise(0).alias("label"))


PATH = "SELECT strategy, month, value, value / max(value) OVER (PARTITION BY strategy ORDER BY month) - 1 AS dd, ret FROM (SELECT strategy, month, ret, product(1 + ret) OVER (PARTITION BY strategy ORDER BY month) AS value FROM strat)"


def strategies(t: Tables):
    return t.ret.where("ret is not null").withColumnRenamed("entity", "strategy")


@query("w22_drawdown", f"SELECT strategy, month, value, dd FROM ({PATH})", "value dd", "month")
def w22(t: Tables):
    path = strategies(t).withColumn("value", R.cumulated("ret", "strategy", "month"))
    return path.select("strategy", "month", "value", R.drawdown("value", "strategy", "month").alias("dd"))


def metrics_sql(keys: str, source: str) -> str:
    """Of monthly returns: the product of all 1 + r over n / 12 years, drawdowns of the running product."""
    k = keys.replace(" ", ", ")
    path = f"SELECT *, value / max(value) OVER (PARTITION BY {k} ORDER BY month) - 1 AS dd FROM (SELECT *, product(1 + ret) OVER (PARTITION BY {k} ORDER BY month) AS value FROM ({source}))"
    raw = f"SELECT {k}, product(1 + ret) - 1 AS total, count(ret) / 12.0 AS years, avg(ret) AS mean, stddev_samp(ret) AS sd, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS low, min(dd) AS max_dd FROM ({path}) GROUP BY {k}"
    return ratios_sql(k, raw, 12)


def equity_sql(key: str, time: str, value: str, source: str) -> str:
    """Of daily values: last over first, calendar years, returns from row to row."""
    path = f"SELECT {key}, {time}, {value} AS value, {value} / lag({value}) OVER (PARTITION BY {key} ORDER BY {time}) - 1 AS ret, {value} / max({value}) OVER (PARTITION BY {key} ORDER BY {time}) - 1 AS dd FROM ({source})"
    raw = f"SELECT {key}, arg_max(value, {time}) / arg_min(value, {time}) - 1 AS total, date_diff('day', min({time}), max({time})) / 365.25 AS years, avg(ret) AS mean, stddev_samp(ret) AS sd, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS low, min(dd) AS max_dd FROM ({path}) GROUP BY {key}"
    return ratios_sql(key, raw, 252)


def ratios_sql(k: str, raw: str, per_year: int) -> str:
    more = f"SELECT *, power(1 + total, 1 / greatest(years, 0.01)) - 1 AS cagr, CASE WHEN coalesce(sd, 0) = 0 THEN 0 ELSE mean / sd * sqrt({per_year}) END AS sharpe, CASE WHEN coalesce(sd, 0) = 0 OR NOT coalesce(low > 0, false) THEN 0 ELSE mean / low * sqrt({per_year}) END AS sortino FROM ({raw})"
    return f"SELECT {k}, total, years, cagr, sharpe, sortino, max_dd, CASE WHEN max_dd <> 0 THEN cagr / abs(max_dd) ELSE 0 END AS calmar FROM ({more})"


METRICS = "total years cagr sharpe sortino max_dd calmar"


@query("w23_metrics", metrics_sql("strategy", "SELECT strategy, month, ret FROM strat"), METRICS)
def w23(t: Tables):
    return R.path_metrics(strategies(t), ["strategy"], "month", "ret", per_year=12.0)


@query("w23b_equity_metrics", equity_sql("entity", "day", "price", "SELECT * FROM panel"), METRICS)
def w23b(t: Tables):
    """Metrics of what a path is worth from day to day."""
    return R.path_metrics(t.panel, ["entity"], "day", "price", of="equity")


@query("w24_segment_metrics", metrics_sql("strategy segment", "SELECT strategy, month, ret, unnest(CASE WHEN year(month) >= 1999 THEN ['full', 'test'] ELSE ['full', 'train'] END) AS segment FROM strat"), METRICS)
def w24(t: Tables):
    segment = F.when(F.year("month") >= 1999, F.array(F.lit("full"), F.lit("test"))).otherwise(F.array(F.lit("full"), F.lit("train")))
    return R.path_metrics(strategies(t).withColumn("segment", F.explode(segment)), ["strategy", "segment"], "month", "ret", per_year=12.0)


@query("w25_chain", f"""SELECT strategy, month, CASE WHEN year(month) < 1999 THEN value ELSE value * scale END AS value FROM (SELECT a.strategy, a.month, a.price AS value, s.scale FROM (SELECT entity AS strategy, month, price FROM monthly) a JOIN (SELECT entity AS strategy, arg_max(CASE WHEN year(month) < 1999 THEN price END, CASE WHEN year(month) < 1999 THEN month END) / nullif(arg_min(CASE WHEN year(month) >= 1999 THEN price END, CASE WHEN year(month) >= 1999 THEN month END), 0) AS scale FROM monthly GROUP BY 1) s USING (strategy))""", "value", "month")
def w25(t: Tables):
    early = F.year("month") < 1999
    pick = lambda fn, cond: fn(F.when(cond, F.col("price")), F.when(cond, F.col("month")))
    scale = t.monthly.groupBy("entity").agg(ratio(pick(F.max_by, early), pick(F.min_by, ~early)).alias("scale"))
    rows = t.monthly.join(scale, "entity")
    return rows.select(F.col("entity").alias("strategy"), "month", F.when(early, F.col("price")).otherwise(F.col("price") * F.col("scale")).alias("value"))


@query("w26_rebase", "SELECT entity, month, price / first_value(price) OVER (PARTITION BY entity ORDER BY month) * 100 AS value FROM monthly", "value", "month")
def w26(t: Tables):
    return t.monthly.select("entity", "month", (F.col("price") / F.first("price").over(R.along("entity", "month")) * 100).alias("value"))


@query("w27_equal_weight_index", "SELECT month, product(1 + ret) OVER (ORDER BY month) AS value FROM index_ret", "value", "month")
def w27(t: Tables):
    index = t.ret.where("ret is not null").groupBy("month").agg(F.avg("ret").alias("ret"))
    return index.withColumn("series", F.lit("index")).select("month", R.cumulated("ret", "series", "month").alias("value"))


@query("w28_bands", """SELECT label, min(n) AS first, max(n) AS last, count(*) AS length FROM (SELECT label, n, n - row_number() OVER (PARTITION BY label ORDER BY n) AS g FROM (SELECT year(month) * 12 + month(month) AS n, CASE WHEN vix > 25 OR (vix > 20 AND spread < 0) THEN 'RISK_OFF' WHEN vix < 20 AND spread > 0 THEN 'RISK_ON' ELSE 'NEUTRAL' END AS label FROM two)) GROUP BY label, g""", "", "", "first last length")
def w28(t: Tables):
    from panelwright.functions.scalar import graded_regime

    rows = t.two.select(F.lit("all").alias("entity"), (F.year("month") * 12 + F.month("month")).alias("n"), graded_regime(F.col("vix"), F.col("spread")).alias("label"))
    return R.islands(rows, "entity", "n", "label").drop("entity")


HELD = "SELECT entity, month FROM (SELECT entity, month, row_number() OVER (PARTITION BY month ORDER BY score DESC, entity) AS r FROM scored) WHERE r <= 5"


@query("w29_still_held", f"SELECT h.entity, h.month, n.entity IS NOT NULL AS still FROM ({HELD}) h LEFT JOIN ({HELD}) n ON n.entity = h.entity AND n.month = last_day(h.month + INTERVAL 1 MONTH)", "", "month")
def w29(t: Tables):
    held = R.top_n(t.scored, "month", "score", "entity", 5).select("entity", "month")
    after = held.select("entity", F.last_day(F.add_months("month", -1)).alias("month"), F.lit(True).alias("still"))
    return held.join(after, ["entity", "month"], "left").fillna(False, ["still"])


@query("w30_from_low", "SELECT entity, last_day(day) AS month, min(price) AS low, arg_max(price, day) / nullif(min(price), 0) - 1 AS best FROM panel GROUP BY 1, 2", "low best", "month")
def w30(t: Tables):
    got = t.panel.groupBy("entity", F.last_day("day").alias("month")).agg(F.min("price").alias("low"), F.max_by("price", "day").alias("last"))
    return got.select("entity", "month", "low", (ratio(F.col("last"), F.col("low")) - 1).alias("best"))


@query("w31_context", """SELECT entity, month, n, first, last FROM (SELECT m.entity, m.month, count(*) AS n, 1.0 AS first, arg_max(p.price, p.day) / arg_min(p.price, p.day) AS last FROM (SELECT DISTINCT entity, last_day(day) AS month FROM panel) m JOIN (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS back FROM panel) p ON p.entity = m.entity AND p.day <= m.month WHERE p.back < (SELECT min(q.back) FROM (SELECT entity, day, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS back FROM panel) q WHERE q.entity = m.entity AND q.day <= m.month) + 252 GROUP BY 1, 2) WHERE n >= 63""", "first last", "month", "n")
def w31(t: Tables):
    """Up to 252 last prices at each month end, divided by the first of them; fewer than 63 are no context."""
    shape = F.transform("context", lambda x: x / F.get("context", F.lit(0)))
    rows = contexts(t.panel).select("entity", "month", F.size("context").alias("n"), shape.alias("shape"))
    return rows.select("entity", "month", "n", F.get("shape", F.lit(0)).alias("first"), F.element_at("shape", -1).alias("last"))


def contexts(panel, most: int = 252, least: int = 63):
    """(entity, month, context): the last `most` prices at each month's last day, at least `least`.

    Each price goes to the month ends that it is in reach of, so lists are made for month ends and not for every day.
    """
    rows = panel.where("price is not null").select("entity", "day", "price", F.last_day("day").alias("month"), F.row_number().over(R.along("entity", "day")).alias("i"))
    ends = rows.groupBy("entity", "month").agg(F.max("i").alias("end"))
    # Months that a row is in reach of follow on its own; there are at most as many as rows in a context.
    ahead = ends.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("end", "month"))).alias("ends"))
    near = rows.join(ahead, "entity").withColumn("e", F.explode(F.filter("ends", lambda e: (e["end"] >= F.col("i")) & (e["end"] - most < F.col("i")))))
    lists = near.groupBy("entity", F.col("e.month").alias("month")).agg(F.array_sort(F.collect_list(F.struct("i", "price"))).alias("all"))
    return lists.where(F.size("all") >= least).select("entity", "month", F.transform("all", lambda x: x["price"]).alias("context"))
