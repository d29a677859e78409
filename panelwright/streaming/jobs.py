"""Incremental jobs on Structured Streaming. Each takes a streaming DataFrame, so any source will do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.scalar import clean_field, content_key, parse_timestamp, strip
from panelwright.operators.panel import small
from panelwright.sources.readers import path_exists
from panelwright.sources.sinks import merge_batch


def landed(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """New files of a folder as a stream; a path that is one file is taken through its folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def ingested(articles: DataFrame, universe: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Articles(ticker, published_at as text, title, snippet) of known tickers: normalised, keyed by content, once each within the watermark."""
    rows = articles.select(F.upper(strip(F.col("ticker"))).alias("ticker"), parse_timestamp(F.col("published_at")).alias("published_at"), F.coalesce(clean_field(F.col("title")), F.lit("")).alias("title"), clean_field(F.col("snippet"), 2000).alias("snippet"))
    rows = rows.where("published_at is not null").join(small(universe.select("ticker")), "ticker", "left_semi")
    rows = rows.withColumn("article_hash", content_key(F.col("ticker"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.col("title")))
    return rows.withWatermark("published_at", lateness).dropDuplicatesWithinWatermark(["article_hash"])


def quarantined(articles: DataFrame, good: str, bad: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows whose time can be read go to `good`, the others to `bad`; none is dropped."""

    def write(batch: DataFrame, epoch: int) -> None:
        known = parse_timestamp(F.col("published_at")).isNotNull()
        batch.where(known).write.mode("append").parquet(good)
        batch.where(~known).write.mode("append").parquet(bad)

    return write


def sorted_out(path: str, ts: str, lateness: str, readable: Column) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every row goes to rows/epoch=../kind= good, bad (not `readable`) or late (before the watermark); none vanishes.

    A batch's watermark is the latest time of the batches before it less `lateness`. Each batch is written once, with
    its counts and latest time observed on the way, and leaves them in marks/; a repeated batch finds the same watermark
    and overwrites its own folders only. What is good never lies behind the watermark, so jobs with state can follow.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        marks = counted(spark, path).where(F.col("epoch") < epoch).agg((F.max("latest") - F.expr(f"interval {lateness}")).alias("line"))  # a row for each batch
        line = marks.first()["line"]
        late = F.col(ts) < F.lit(line) if line is not None else F.lit(False)
        kind = F.when(~F.coalesce(readable & F.col(ts).isNotNull(), F.lit(False)), "bad").when(late, "late").otherwise("good")
        seen = Observation()
        counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
        told = batch.withColumn("kind", kind).observe(seen, *counts, F.max(F.when(F.col("kind") != "bad", F.col(ts))).alias("latest"))
        told.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/rows/epoch={epoch}")
        latest = max((x for x in (seen.get["latest"], line and counted(spark, path).where(F.col("epoch") < epoch).agg(F.max("latest")).first()[0]) if x), default=None)
        spark.createDataFrame([(*(seen.get[k] for k in KINDS), latest)], MARKS).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/epoch={epoch}")

    return write


#: Where rows of a stream go, and what a batch leaves behind.
KINDS = ("good", "bad", "late")
MARKS = "good long, bad long, late long, latest timestamp"


def counted(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, good, bad, late, latest): rows of each batch by kind, and the latest time up to it."""
    if not path_exists(spark, f"{path}/marks"):
        return spark.createDataFrame([], f"{MARKS}, epoch long")
    return spark.read.schema(f"{MARKS}, epoch long").parquet(f"{path}/marks")


def scored_once(path: str, score: Callable[[DataFrame], DataFrame], key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: scores rows whose key has no score yet, once; a repeated batch adds nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        if path_exists(spark, path):
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
        score(new).write.mode("append").parquet(path)

    return write


def daily_means(events: DataFrame, key: str, ts: str, value: str, lateness: str = "1 day") -> DataFrame:
    """Mean and count by key and day; a day appears once it is closed."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(key, F.window(ts, "1 day"))
        .agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
        .select(key, F.to_date("window.start").alias("day"), "mean", "n")
    )


def high_water(events: DataFrame, key: str, ts: str) -> DataFrame:
    """The latest time of each key, for update or complete mode."""
    return events.groupBy(key).agg(F.max(ts).alias("latest"))


def resume_points(latest: DataFrame, overlap_days: int = 7) -> DataFrame:
    """Where to start again: overlap_days before the latest time; the overlap is harmless with write-once sinks."""
    return latest.withColumn("resume", F.col("latest") - F.make_dt_interval(F.lit(overlap_days)))


def freshness(latest: DataFrame, source: str, limits: dict[str, int], as_of: str, default: int = 5) -> DataFrame:
    """Age in days against each source's limit."""
    most = F.coalesce(*(F.when(F.col(source) == k, F.lit(v)) for k, v in limits.items()), F.lit(default))
    got = latest.withColumns({"age": F.date_diff(F.lit(as_of).cast("date"), F.to_date("latest")), "most": most})
    return got.withColumn("ok", F.col("age") <= F.col("most"))


def window_status(log: DataFrame, full: int, gap: int) -> DataFrame:
    """log(rows, gap_days, answered) with a status told from evidence.

    A window that was answered without rows is `empty` and done; one that was not answered is an `error` and asked again
    (without a column `answered`, every window without rows); many rows that end early are `partial`.
    """
    none = F.when(F.coalesce("answered", F.lit(False)), "empty").otherwise("error") if "answered" in log.columns else F.lit("error")
    return log.withColumn("status", F.when(F.col("rows") == 0, none).when((F.col("rows") >= full) & (F.col("gap_days") > gap), "partial").otherwise("ok"))


#: Windows in these states are not asked for again.
DONE = ("ok", "empty")


def open_windows(log: DataFrame) -> DataFrame:
    """The windows of a status log that have to be asked for again."""
    return log.where(~F.col("status").isin(*DONE))


def _year(period: Column) -> Column:
    return F.substring(period, 1, 4)


def audited(log: DataFrame, articles: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """log(keys, period, status, ..) with what articles(keys, day) hold of each window: rows, last, gap_days; one row for each key and year.

    A period is `YYYY-MM..YYYY-MM`. Periods that do not span their year have drifted; they are folded onto the year's
    stable period, where a stable row counts before drifted ones and a later `completed_at` before an earlier one.
    """
    year = _year(F.col("period"))
    stable = F.concat(year, F.lit("-01.."), year, F.lit("-12"))
    best = F.struct((F.col("period") == stable).alias("own"), "completed_at", "period", *(c for c in log.columns if c not in (*keys, "period", "completed_at")))
    folded = log.groupBy(*keys, stable.alias("_stable"), year.alias("_year")).agg(F.max(best).alias("_row"))
    rest = [c for c in log.columns if c not in (*keys, "period")]
    folded = folded.select(*keys, F.col("_stable").alias("period"), "_year", *(F.col(f"_row.{c}").alias(c) for c in rest))
    held = articles.groupBy(*keys, F.year("day").cast("string").alias("_year")).agg(F.count(F.lit(1)).alias("rows"), F.max("day").alias("last"))
    first, end = F.make_date(F.col("_year").cast("int"), F.lit(1), F.lit(1)), F.least(F.make_date(F.col("_year").cast("int"), F.lit(12), F.lit(31)), F.lit(as_of).cast("date"))
    joined = folded.join(held, [*keys, "_year"], "left").fillna(0, ["rows"])
    return joined.withColumn("gap_days", F.date_diff(end, F.coalesce("last", first))).drop("_year")


def reconciled(log: DataFrame, articles: DataFrame, keys: list[str], as_of: str, full: int, gap: int) -> DataFrame:
    """The log with one row for each key and year, and statuses told from the articles at hand.

    No rows are an `error`, to be asked for again, unless the log says that the window was answered and `empty`; `full`
    rows or more that end over `gap` days early are `partial`; all else is `ok`. A second run changes nothing.
    """
    found = audited(log, articles, keys, as_of)
    none = F.when(F.col("status") == "empty", "empty").otherwise("error")
    status = F.when(F.col("rows") == 0, none).when((F.col("rows") >= full) & (F.col("gap_days") > gap), "partial").otherwise("ok")
    return found.withColumn("status", status).select(*log.columns)


def log_changes(log: DataFrame, articles: DataFrame, keys: list[str], as_of: str, full: int, gap: int) -> DataFrame:
    """(keys, period, change, before, after): what reconciled() would change, as a dry run: a `rekey` for each drifted period, a `status` for each that differs."""
    year = _year(F.col("period"))
    stable = F.concat(year, F.lit("-01.."), year, F.lit("-12"))
    moved = log.where(F.col("period") != stable).select(*keys, "period", F.lit("rekey").alias("change"), F.col("period").alias("before"), stable.alias("after"))
    after = reconciled(log, articles, keys, as_of, full, gap).select(*keys, "period", F.col("status").alias("after"))
    before = audited(log, articles, keys, as_of).select(*keys, "period", F.col("status").alias("before"))
    differing = before.join(after, [*keys, "period"]).where(~F.col("before").eqNullSafe(F.col("after")))
    return moved.unionByName(differing.withColumn("change", F.lit("status")))


def enriched(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """A stream with the columns of a static table."""
    return events.join(dimension, key, "left")


def run_to_table(stream: DataFrame, path: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Takes what is there now through the stream and returns the result.

    Complete results replace the table. Update mode needs the `keys` of the result: each batch's rows are merged into
    those of the batches before it, in this run or an earlier one with the same path.
    """
    spark = stream.sparkSession
    schema = stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{path}/data")
    elif mode == "complete":
        query = writer.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/data")).start()
    elif keys:
        query = writer.foreachBatch(lambda batch, epoch: merge_batch(spark, f"{path}/data", batch, keys, epoch)).start()
    else:
        raise ValueError("update mode keeps a row for each key: name the keys")
    query.awaitTermination()
    if not path_exists(spark, f"{path}/data"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/data").select(*schema.names)
