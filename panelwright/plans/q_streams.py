"""Queries over streaming jobs: ST1-ST8. Each takes the events table through a stream with availableNow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.panel import small
from panelwright.operators.text import dictionary_scorer, scored, tokens_of
from panelwright.plans.registry import Tables, query
from panelwright.streaming import jobs as J


def events(t: Tables) -> DataFrame:
    """The events table as a stream; times are cast, since a watermark needs a time zone."""
    raw = J.landed(t.spark, f"{t.dir}/events.parquet", t.read("events").schema)
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 50))
    return raw.select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), score.alias("score"), "props")


def articles(t: Tables) -> DataFrame:
    return events(t).select(F.concat(F.lit("k"), F.col("key")).alias("ticker"), F.when(F.col("event_id") % 50 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("published_at"), F.col("source").alias("title"), F.col("props").alias("snippet"), "event_id")


ARRIVED = "SELECT 'K' || user_id AS ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published_at, event_type AS title FROM events WHERE event_id % 50 <> 0 AND 'K' || user_id IN (SELECT 'K' || user_id FROM events WHERE user_id % 2 = 0)"


@query("st1_ingest", f"SELECT DISTINCT ticker, published_at, sha256(ticker || '|' || published_at || '|' || title) AS article_hash FROM ({ARRIVED})")
def st1(t: Tables):
    universe = t.read("events").where("user_id % 2 = 0").select(F.concat(F.lit("K"), "user_id").alias("ticker")).distinct()
    return J.run_to_table(J.ingested(articles(t), universe), t.scratch()).select("ticker", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "article_hash")


@query("st2_score_once", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS score FROM events", "score")
def st2(t: Tables):
    path, model = t.scratch(), dictionary_scorer({"PURCHASE": 1, "ERROR": -1})
    rows = articles(t).select("event_id", F.col("title").alias("text"))
    write = J.scored_once(f"{path}/scores", lambda df: scored(df, "text", scorer=lambda: model, weigh=tokens_of).select("event_id", "score"), "event_id")
    for run in (1, 2):  # the second run finds everything scored
        rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint-{run}").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/scores")


CLOSED = "SELECT key, day, avg(score) AS mean, count(*) AS n FROM news WHERE day + 1 <= (SELECT max(ts) FROM news) - INTERVAL 1 DAY GROUP BY 1, 2"


@query("st3_closed_days", CLOSED, "mean", "day", "n")
def st3(t: Tables):
    return J.run_to_table(J.daily_means(events(t), "key", "ts", "score"), t.scratch())


@query("st4_high_water", "SELECT key, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, strftime(max(ts) - INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS resume FROM news GROUP BY 1")
def st4(t: Tables):
    latest = J.resume_points(J.run_to_table(J.high_water(events(t), "key", "ts"), t.scratch(), "update", ["key"]))
    return latest.select("key", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("latest", "resume")))


def arrivals(t: Tables, folder: str, part: str = "event_id % 3"):
    """The events in three arrivals, each landing in the folder when it is asked for."""
    for i in range(3):
        t.read("events").where(f"{part} = {i}").write.mode("append").parquet(folder)
        yield i


@query("st4b_kept_marks", "SELECT key, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, max(event_id) AS last_event FROM news GROUP BY 1", "", "", "last_event")
def st4b(t: Tables):
    """Marks kept up in update mode over three runs; even keys come in the first two, odd ones in the last two."""
    folder, path = t.scratch(), t.scratch()
    for _ in arrivals(t, folder, "event_id % 2 + user_id % 2"):
        rows = J.landed(t.spark, folder, t.read("events").schema).groupBy(F.col("user_id").alias("key"))
        marks = J.run_to_table(rows.agg(F.max(F.col("ts").cast("timestamp")).alias("latest"), F.max("event_id").alias("last_event")), path, "update", ["key"])
    return marks.select("key", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"), "last_event")


@query("st5_quarantine", "SELECT CASE WHEN event_id % 50 = 0 THEN 'bad' ELSE 'good' END AS kind, count(*) AS n FROM events GROUP BY 1", "", "", "n")
def st5(t: Tables):
    path = t.scratch()
    articles(t).writeStream.foreachBatch(J.quarantined(None, f"{path}/good", f"{path}/bad")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    count = lambda kind: t.spark.read.parquet(f"{path}/{kind}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("good").unionByName(count("bad"))


LATE = """SELECT e.event_id % 3 AS epoch, count(*) FILTER (event_id % 50 <> 0 AND NOT late) AS good, count(*) FILTER (event_id % 50 = 0) AS bad, count(*) FILTER (event_id % 50 <> 0 AND late) AS late
 FROM (SELECT event_id, coalesce(ts < line, false) AS late FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_id % 3 AS part FROM events) x LEFT JOIN (SELECT p.part, (SELECT max(CAST(ts AS TIMESTAMP)) FROM events WHERE event_id % 3 < p.part AND event_id % 50 <> 0) - INTERVAL 20 DAY AS line FROM (SELECT unnest([0, 1, 2]) AS part) p) y USING (part)) e GROUP BY 1"""


@query("st5b_late_rows", LATE, "", "", "epoch good bad late")
def st5b(t: Tables):
    """Rows of each batch by where they went: none is lost, whether its time cannot be read or lies behind the watermark."""
    folder, path = t.scratch(), t.scratch()
    write = J.sorted_out(path, "ts", "20 days", F.col("event_id") % 50 != 0)
    for _ in arrivals(t, folder):
        rows = J.landed(t.spark, folder, t.read("events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
        rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = t.spark.read.parquet(f"{path}/rows").groupBy("epoch").pivot("kind", list(J.KINDS)).count().fillna(0)
    return kept.select("epoch", *J.KINDS)


LOG = """SELECT user_id AS key, event_type AS source, CASE user_id % 4 WHEN 0 THEN '2024-01..2024-07' ELSE '2024-01..2024-12' END AS period, CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'error' WHEN 2 THEN 'empty' ELSE 'ok' END AS status, user_id % 7 AS completed_at FROM (SELECT DISTINCT user_id, event_type FROM events)
 UNION ALL SELECT user_id, event_type, '2024-01..2024-12', 'error', 9 FROM (SELECT DISTINCT user_id, event_type FROM events WHERE user_id % 8 = 0)"""
FOLDED = f"SELECT l.key, l.source, '2024-01..2024-12' AS period, arg_max(status, (CASE WHEN period = '2024-01..2024-12' THEN 100 ELSE 0 END) + completed_at) AS before, max((CASE WHEN period = '2024-01..2024-12' THEN 100 ELSE 0 END) + completed_at) % 100 AS completed_at, any_value(coalesce(n, 0)) AS n, any_value(coalesce(DATE '2024-01-31' - last, 30)) AS gap FROM (SELECT key, source, period, coalesce(status, '?') AS status, completed_at FROM ({LOG})) l LEFT JOIN (SELECT key, source, count(*) AS n, max(day) AS last FROM news WHERE source <> 'click' GROUP BY 1, 2) a USING (key, source) GROUP BY 1, 2"
JUDGED = f"SELECT *, CASE WHEN n = 0 THEN CASE WHEN before = 'empty' THEN 'empty' ELSE 'error' END WHEN n >= 3 AND gap > 2 THEN 'partial' ELSE 'ok' END AS after FROM ({FOLDED})"


def status_log(t: Tables):
    """A log of windows asked for, one for each key and source; clicks were asked for and never came."""
    pairs = t.read("events").select(F.col("user_id").alias("key"), F.col("event_type").alias("source")).distinct()
    c = F.col("key")
    status = F.when(c % 5 == 1, "error").when(c % 5 == 2, "empty").when(c % 5 > 2, "ok").otherwise("?")
    own = pairs.select("key", "source", F.when(c % 4 == 0, "2024-01..2024-07").otherwise("2024-01..2024-12").alias("period"), status.alias("status"), (c % 7).alias("completed_at"))
    again = pairs.where(c % 8 == 0).select("key", "source", F.lit("2024-01..2024-12").alias("period"), F.lit("error").alias("status"), F.lit(9).cast("long").alias("completed_at"))
    return own.unionByName(again), t.news.where("source <> 'click'").select("key", "source", "day")


@query("st6b_log_changes", f"SELECT key, source, period, 'rekey' AS change, period AS before, '2024-01..2024-12' AS after FROM ({LOG}) WHERE period <> '2024-01..2024-12' UNION ALL SELECT key, source, period, 'status', before, after FROM ({JUDGED}) WHERE before <> after")
def st6b(t: Tables):
    """What a reconciliation of the log with the articles would change."""
    return J.log_changes(*status_log(t), ["key", "source"], "2024-01-31", 3, 2)


@query("st6c_log_reconciled", f"SELECT key, source, period, after AS status, completed_at FROM ({JUDGED})", "", "", "completed_at")
def st6c(t: Tables):
    """The log as it is after that."""
    return J.reconciled(*status_log(t), ["key", "source"], "2024-01-31", 3, 2)


@query("st6_window_status", "SELECT key, source, w AS week, n AS rows, gap AS gap_days, CASE WHEN n = 0 THEN CASE WHEN answered THEN 'empty' ELSE 'error' END WHEN n >= 3 AND gap > 1 THEN 'partial' ELSE 'ok' END AS status FROM (SELECT l.key, l.source, l.w, count(e.key) AS n, coalesce(l.w + 6 - max(e.day), 7) AS gap, bool_or(l.key % 3 <> 0 OR l.source = 'click') AS answered FROM (SELECT DISTINCT a.key, b.source, c.w FROM (SELECT DISTINCT key FROM news) a CROSS JOIN (SELECT DISTINCT source FROM news) b CROSS JOIN (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS w FROM news) c) l LEFT JOIN news e ON e.key = l.key AND e.source = l.source AND CAST(date_trunc('week', e.day) AS DATE) = l.w GROUP BY 1, 2, 3)", "", "week", "rows gap_days")
def st6(t: Tables):
    found = t.news.groupBy("key", "source", F.trunc("day", "week").alias("week")).agg(F.count(F.lit(1)).alias("rows"), F.max("day").alias("last"))
    weeks = t.news.select(F.trunc("day", "week").alias("week")).distinct()
    ids = t.news.select("key").distinct().crossJoin(small(t.news.select("source").distinct()))
    cells = ids.crossJoin(small(weeks)).join(found, ["key", "source", "week"], "left").fillna(0, ["rows"])
    gap = F.coalesce(F.date_diff(F.date_add("week", 6), "last"), F.lit(7))
    # As evidence stands whether a request was answered at all: here, that of every third key was for clicks only.
    answered = (F.col("key") % 3 != 0) | (F.col("source") == "click")
    return J.window_status(cells.select("key", "source", "week", "rows", gap.alias("gap_days"), answered.alias("answered")), 3, 1).drop("answered")


@query("st7_freshness", "SELECT source, DATE '2024-02-01' - CAST(max(ts) AS DATE) AS age, CASE source WHEN 'click' THEN 5 WHEN 'view' THEN 3 ELSE 5 END AS most, DATE '2024-02-01' - CAST(max(ts) AS DATE) <= CASE source WHEN 'click' THEN 5 WHEN 'view' THEN 3 ELSE 5 END AS ok FROM news GROUP BY 1", "", "", "age most")
def st7(t: Tables):
    latest = J.run_to_table(J.high_water(events(t), "source", "ts"), t.scratch(), "update", ["source"])
    return J.freshness(latest, "source", {"click": 5, "view": 3}, "2024-02-01").drop("latest")


@query("st8_enriched", "SELECT event_id, source, upper(source) || '!' AS name FROM news")
def st8(t: Tables):
    names = t.read("events").select(F.col("event_type").alias("source")).distinct().withColumn("name", F.concat(F.upper("source"), F.lit("!")))
    return J.run_to_table(J.enriched(events(t).select("event_id", "source"), small(names), "source").select("event_id", "source", "name"), t.scratch())
