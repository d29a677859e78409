"""Streams over several batches: state that is kept, rows that come late, logs that are reconciled."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelwright.sources import sinks as SK
from panelwright.streaming import jobs as J

EVENTS = "k string, n long, ts timestamp"


def land(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_update_mode_keeps_keys_of_earlier_batches(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    day = datetime(2024, 1, 1)
    steps = [([("a", 1, day), ("b", 2, day), (None, 5, day)], {("a", 1), ("b", 2), (None, 5)}), ([("a", 9, day)], {("a", 9), ("b", 2), (None, 5)}), ([("c", 3, day), (None, 6, day)], {("a", 9), ("b", 2), ("c", 3), (None, 6)})]
    for rows, want in steps:
        land(spark, folder, rows)
        stream = J.landed(spark, folder, EVENTS).groupBy("k").agg(F.max("n").alias("n"))
        assert {tuple(r) for r in J.run_to_table(stream, path, "update", ["k"]).collect()} == want
    with pytest.raises(ValueError, match="keys"):
        J.run_to_table(stream, str(tmp_path / "other"), "update")


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(r, "k string, n long")
    held = lambda: sorted((r.k, r.n) for r in spark.read.parquet(path).collect())
    SK.merge_batch(spark, path, rows(("a", 1), ("b", 2)), ["k"], 0)
    SK.merge_batch(spark, path, rows(("a", 5)), ["k"], 1)
    assert held() == [("a", 5), ("b", 2)]
    SK.merge_batch(spark, path, rows(("a", 7)), ["k"], 1)
    SK.merge_batch(spark, path, rows(("a", 0), ("b", 0)), ["k"], 0)
    SK.merge_batch(spark, path, rows().limit(0), ["k"], 2)
    assert held() == [("a", 5), ("b", 2)]


def test_every_row_is_good_bad_or_late(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda d: datetime(2024, 1, d)
    batches = [[("a", 1, at(10)), ("a", 2, at(1)), ("a", 3, None)], [("a", 4, at(7)), ("a", 5, at(8)), ("bad", 6, at(30))], [("a", 7, at(20)), ("a", 8, at(8))], [("a", 9, at(16)), ("a", 10, at(19))]]
    write = J.sorted_out(path, "ts", "2 days", F.col("k") != "bad")
    for rows in batches:
        land(spark, folder, rows)
        J.landed(spark, folder, EVENTS).writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kinds = {r.n: r.kind for r in spark.read.parquet(f"{path}/rows").collect()}
    assert kinds == {1: "good", 2: "good", 3: "bad", 4: "late", 5: "good", 6: "bad", 7: "good", 8: "good", 9: "late", 10: "good"}
    marks = sorted((r.epoch, r.good, r.bad, r.late, r.latest.day) for r in J.counted(spark, path).collect())
    assert marks == [(0, 2, 1, 0, 10), (1, 1, 1, 1, 10), (2, 2, 0, 0, 20), (3, 1, 0, 1, 20)]
    write(spark.createDataFrame(batches[1], EVENTS), 1)  # a repeated batch
    assert {r.n: r.kind for r in spark.read.parquet(f"{path}/rows").collect()} == kinds and len(J.counted(spark, path).collect()) == 4


def test_reconciling_twice_changes_nothing_more(spark):
    log = [("a", "2023-01..2023-12", "ok", 1), ("a", "2024-01..2024-07", "ok", 2), ("b", "2024-01..2024-12", "empty", 1), ("c", "2024-01..2024-12", None, 1), ("c", "2024-01..2024-03", "ok", 5), ("d", "2024-01..2024-12", "partial", 1)]
    held = [("a", f"2023-12-{d}") for d in (20, 30)] + [("c", f"2024-0{m}-01") for m in (1, 2, 3)] + [("d", "2024-05-30")] * 4
    logs = spark.createDataFrame(log, "k string, period string, status string, completed_at long")
    articles = spark.createDataFrame(held, "k string, day string").withColumn("day", F.col("day").cast("date"))
    args = (articles, ["k"], "2024-06-01", 3, 14)
    changes = {tuple(r) for r in J.log_changes(logs, *args).collect()}
    stable = "2024-01..2024-12"
    assert changes == {
        ("a", "2024-01..2024-07", "rekey", "2024-01..2024-07", stable), ("c", "2024-01..2024-03", "rekey", "2024-01..2024-03", stable),
        ("a", stable, "status", "ok", "error"), ("c", stable, "status", None, "partial"), ("d", stable, "status", "partial", "ok"),
    }
    after = J.reconciled(logs, *args)
    assert {tuple(r) for r in after.collect()} == {("a", "2023-01..2023-12", "ok", 1), ("a", stable, "error", 2), ("b", stable, "empty", 1), ("c", stable, "partial", 1), ("d", stable, "ok", 1)}
    assert J.log_changes(after, *args).count() == 0 and J.reconciled(after, *args).exceptAll(after).count() == 0
    assert {r.k for r in J.open_windows(after).collect()} == {"a", "c"}
