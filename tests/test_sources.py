"""Readers, sinks and stream jobs that SQL on the given tables cannot check."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from panelwright.operators import models as M
from panelwright.operators import panel as P
from panelwright.operators import rolling as R
from panelwright.operators import text as X
from panelwright.sources import readers as RD
from panelwright.sources import sinks as SK
from panelwright.streaming import jobs as J


def test_missing_tables_and_columns(spark, tmp_path):
    empty = RD.read_or_empty(spark, f"{tmp_path}/none", "a int, b string")
    assert empty.count() == 0 and empty.columns == ["a", "b"]
    rows = spark.createDataFrame([(1,)], "a int")
    assert RD.in_order(rows, {"b": "double", "a": "int"}).collect() == [(None, 1)]
    with pytest.raises(LookupError):
        RD.required(empty, "benchmark")
    assert RD.required(rows, "x") is rows


def test_csv_articles_with_quoted_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Article_title,Stock_symbol,Url,Publisher,Article,Lsa_summary\n2020-06-05 06:30:54 UTC,"A ""quoted""\ntitle",aapl,u,p,"body, with comma",\nbad date,t,aapl,u,p,b,s\n2020-06-06,t,ZZZ,u,p,b,s\n')
    schema = "Date string, Article_title string, Stock_symbol string, Url string, Publisher string, Article string, Lsa_summary string"
    rows = RD.read_csv(spark, str(tmp_path / "a.csv"), schema, multiline=True)
    got = RD.articles(rows, spark.createDataFrame([("AAPL",)], "ticker string"), "2020-01-01", "2020-12-31").collect()
    assert [(r.ticker, r.title, r.snippet, str(r.published_at)) for r in got] == [("AAPL", 'A "quoted"\ntitle', "body, with comma", "2020-06-05 06:30:54")]


def test_nested_facts_feeds_and_indices(spark):
    facts = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"end": "2021-03-31", "val": 5.0, "form": "10-Q", "frame": "x"}]}}, "Sales": {"units": {"USD": [{"end": "2021-03-31", "val": 7.0, "form": "10-K"}]}}}}}
    rows = RD.company_facts(spark.createDataFrame([("A", json.dumps(facts))], "ticker string, j string"), "ticker", "j")
    assert {(r.tag, r.end, r.val) for r in rows.collect()} == {("Revenues", datetime.date(2021, 3, 31), 5.0), ("Sales", datetime.date(2021, 3, 31), 7.0)}
    assert [r.val for r in RD.by_priority(rows, ["ticker", "end"], "tag", ["None", "Sales", "Revenues"]).collect()] == [7.0]
    feed = {"feed": [{"time_published": "20240102T030405", "title": " T ", "summary": "s", "source_domain": "d", "ticker_sentiment": [{"ticker": "b", "relevance_score": "0.1"}, {"ticker": "A", "relevance_score": "0.5"}]}, {"time_published": "nonsense", "title": "U", "summary": "", "source_domain": "d", "ticker_sentiment": [{"ticker": "A", "relevance_score": "?"}]}]}
    got = RD.news_feed(spark.createDataFrame([("a", json.dumps(feed))], "ticker string, j string"), "ticker", "j").collect()
    assert [(str(r.published_at), r.title, r.relevance) for r in got] == [("2024-01-02 03:04:05", "T", 0.5), ("None", "U", None)]
    recent = (["8-K", "10-K", "8-K"], ["2021-01-02", "2021-02-03", "2021-03-04"], ["a1", "a2", ""], ["d1", "d2", "d3"], ["", "", ""])
    raw = spark.createDataFrame([("A", recent)], "ticker string, recent struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>,reportDate:array<string>>")
    assert [r.accessionNumber for r in RD.filing_index(raw, "ticker", "recent", ["8-K"], "2021-01-01", "2021-12-31").collect()] == ["a1"]
    compact = json.dumps({"columns": ["Ticker", "Fiscal Period", "EPS (Diluted)"], "data": [["A", "Q1", "1.5"], ["A", "Q2", "?"]]})
    got = RD.compact_column(spark.createDataFrame([("A", compact)], "ticker string, j string"), "ticker", "j", "eps").collect()
    assert [(r.period, r.value) for r in got] == [("Q1", 1.5), ("Q2", None)]


def test_short_volume_notes_and_folders(spark, tmp_path):
    (tmp_path / "v.txt").write_text("Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market\n20210104|AAA|40|0|100|N\n20210105|AAA|x|0|100|N\n")
    rows = RD.short_volume(RD.read_csv(spark, str(tmp_path / "v.txt"), "Date string, Symbol string, ShortVolume string, ShortExemptVolume string, TotalVolume string, Market string", sep="|"))
    assert [(str(r.date), r.short_ratio) for r in rows.collect()] == [("2021-01-04", 0.4), ("2021-01-05", None)]
    (tmp_path / "notes" / "macro").mkdir(parents=True)
    (tmp_path / "notes" / "macro" / "view.md").write_text("---\nticker: AAA\ntags: [a: b]\n---\nBody text\n")
    got = RD.notes(spark, str(tmp_path / "notes")).first()
    assert (got["name"], got.section, got.front, got.body) == ("view", "macro", {"ticker": "AAA", "tags": "[a: b]"}, "Body text")
    files = spark.createDataFrame([("r/2021-02-03_x/a.htm", 5), ("r/2021-02-03_x/index.htm", 99), ("r/2021-02-03_x/b.htm", 9)], "path string, length long")
    assert [(r.path, str(r.date)) for r in RD.largest_per_folder(files).collect()] == [("r/2021-02-03_x/b.htm", "2021-02-03")]


def test_notes_are_written_a_file_each_from_many_tasks(spark, tmp_path):
    rows = [(i % 3, f"n{i}", f"---\nkey: {i}\n---\nbody {i}") for i in range(40)] + [(0, "n0", "again"), (0, "n0", "again"), (None, "a/b", None)]
    path = f"file://{tmp_path}/notes of all"
    SK.write_notes(spark.createDataFrame(rows, "part int, title string, text string").coalesce(1), path, "part", "title", "text")
    assert len(list((tmp_path / "notes of all").glob("part=*/*.txt"))) == len(rows)
    got = RD.notes(spark, path)
    assert sorted(map(str, (r.body for r in got.collect()))) == sorted([*(f"body {i}" for i in range(40)), "again", "again", ""])
    assert {r.section for r in got.collect()} == {"part=0", "part=1", "part=2", "part=__HIVE_DEFAULT_PARTITION__"}


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/prices"
    rows = lambda *x: spark.createDataFrame(list(x), "d int, k string, v double")
    SK.upsert(spark, path, rows((1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)), ["d", "k"], "d")
    SK.upsert(spark, path, rows((1, "a", 9.0), (3, "c", 4.0)), ["d", "k"], "d")
    assert sorted(map(tuple, spark.read.parquet(path).select("d", "k", "v").collect())) == [(1, "a", 9.0), (1, "b", 2.0), (2, "a", 3.0), (3, "c", 4.0)]
    for _ in range(2):
        SK.insert_absent(spark, f"{tmp_path}/once", rows((1, "x", 1.0), (2, "x", 5.0), (1, "y", 2.0)), ["k"])
    assert spark.read.parquet(f"{tmp_path}/once").count() == 2
    SK.write_panel(rows((2, "b", 1.0), (1, "a", 1.0)), f"{tmp_path}/panel", "d", "k")
    assert spark.read.parquet(f"{tmp_path}/panel").count() == 2
    assert SK.without_empty_columns(rows((1, None, 1.0))).columns == ["d", "v"]
    assert SK.as_json(rows((1, None, 1.0))).first().json == '{"d":1,"v":1.0}'
    SK.write_csv(rows((1, "a", 1.0)), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == ["d", "k", "v"]
    for v in (1.0, 2.0):
        SK.write_payload(rows((1, "a", v)), f"{tmp_path}/targets", "d")
    assert [r.payload for r in spark.read.parquet(f"{tmp_path}/targets").collect()] == ['{"k":"a","v":2.0}']


def test_models_round_trip_and_folds(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = spark.createDataFrame([(m, float(i), float(i > 5)) for m in range(50) for i in range(10)], "month int, x double, label double")
    folds = M.folds(rows.select("month").distinct(), "month", 36, 3).orderBy("fold").collect()
    assert [tuple(f) for f in folds][:2] == [(1, 0, 36, 39), (2, 0, 37, 40)] and len(folds) == 11
    model = M.fit_fold(rows, ["x"], "label", trees=3)
    SK.save_models({"fold_1": model}, str(tmp_path))
    again = PipelineModel.load(f"{tmp_path}/fold_1")
    scored = M.score_folds({49: again}, rows, "month", ["x"]).collect()
    assert len(scored) == 10 and all((r.score > 0.5) == (r.label > 0) for r in scored)


def test_text_jobs(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c(F.col("t")).alias("r")).first().r
    assert one(X.html_text, "<html><head><title>x</title></head><body><p>A &amp; B</p><script>no()</script><p>C</p></body></html>") == "A & B\nC"
    body = "\n".join(f"line {i} of the report has some words" for i in range(40))
    got = one(X.without_boilerplate, body + "\nInvestor Relations contact us\nSafe Harbor Statement here\nCautionary Statement\nlegal text")
    assert "line 39" in got and "legal text" not in got and "Investor" not in got
    assert one(X.without_boilerplate, "a\n\n\n\nb  c") == "a\n\nb c"
    w = [f"w{i}" for i in range(130)]
    assert [(r.offset, len(r.text.split())) for r in one(lambda c: X.windows(c, 100, 80, 40), " ".join(w))] == [(0, 100), (80, 50)]
    paragraphs = [" ".join([f"p{i}"] * 30) for i in range(4)] + ["too short"]
    assert [len(x.split()) for x in one(lambda c: X.packed_paragraphs(c, 70, 20), "\n\n".join(paragraphs))] == [60, 60, 60]
    assert one(X.note_body, "---\na: b\n---\n" + "x " * 30) == ("x " * 30).strip() and one(X.note_body, "short") is None
    docs = spark.createDataFrame([(1, "intro Item 1. Business " + "b " * 60 + "ITEM 1A. Risk Factors " + "r " * 60 + "Item 8. Financial Statements few")], "k long, t string")
    assert {(r.section, len(r.body.split())) for r in X.sections(docs, "k", "t").collect()} == {("business", 63), ("risk_factors", 64)}
    vectors = X.embedded(spark.createDataFrame([("a b c",), ("",)], "t string"), "t").collect()
    assert abs(sum(x * x for x in vectors[0].embedding) - 1) < 1e-9 and vectors[1].embedding is None
    assert X.scored(spark.createDataFrame([(None,), ("",)], "t string"), "t", lambda: lambda texts: texts.str.len() + 1).select("score").collect() == [(0.0,), (0.0,)]


def test_sections_come_from_each_row_alone(spark):
    b, r = "b " * 60, "r " * 70
    texts = [(1, f"Item 1. Business {b}\x01 {b}ITEM  1A.Risk Factors {r}"), (2, f"item 8. financial statements {b}"), (2, f"x {r}"), (None, f"{b}Item 9A. Controls {r}item 9a. controls few"), (3, f"Item 1. Business few {b[:20]}\u00a0{r}item"), (4, None), (5, "")]
    got = X.section_chunks(spark.createDataFrame(texts, "k long, t string"), "k", "t", 100, 20, 40)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    have = sorted(((x.k, x.section, x.chunk, x.word_offset, len(x.text.split(" "))) for x in got.collect()), key=str)
    want = [(1, "business", 0, 0, 100), (1, "business", 1, 80, 44), (1, "risk_factors", 0, 0, 73), (2, "financial_statements", 0, 0, 64), (2, None, 0, 0, 71), (None, "controls", 0, 0, 73), (3, "business", 0, 0, 85)]
    assert have == sorted(want, key=str)
    for patterns in ({"a": "alpha|beta", "b": "alp?x"}, {"a": "alpha|beta", "b": "gamma"}, {"a": "beta", "b": "alp?x"}):
        found = X.sections(spark.createDataFrame([(1, "0 beta 1 2 alx 3 4 5")], "k long, t string"), "k", "t", patterns, 1)
        assert {(x.section, x.body) for x in found.collect()} == ({("a", "beta 1 2"), ("b", "alx 3 4 5")} if "alp?x" in patterns.values() else {("a", "beta 1 2 alx 3 4 5")})


def test_operator_edges(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, None), ("b", 2, 3.0)], "e string, t int, v double")
    z = {(r.e, r.t): r.z for r in R.cross_z(rows, "v", "t", "z", least=1).collect()}
    assert z["a", 1] is None and abs(z["b", 2] - 0.70710678) < 1e-6
    left, right = spark.createDataFrame([("a", "2024-01-10")], "k string, d string"), spark.createDataFrame([("a", "2024-01-01", 5.0), ("a", "2024-01-09", None)], "k string, d string, v double")
    as_day = lambda df: df.withColumn("d", F.to_date("d"))
    assert P.as_of(as_day(left), as_day(right), ["k"], "d", ["v"]).first().v == 5.0
    assert P.as_of(as_day(left), as_day(right), ["k"], "d", ["v"], most_days=5).first().v is None
    assert P.as_of(as_day(left), as_day(right), ["k"], "d", ["v"], forward=True).first().v is None
    assert P.densify(rows.where("e = 'a' or t = 2"), "e", "t").count() == 4


def test_stream_status(spark):
    log = spark.createDataFrame([(0, 9), (950, 20), (950, 2), (5, 40)], "rows int, gap_days int")
    assert [r.status for r in J.window_status(log, 900, 14).collect()] == ["error", "partial", "ok", "ok"]


def test_empty_windows_are_done(spark):
    log = spark.createDataFrame([(0, 9, True), (0, 9, False), (0, 9, None), (950, 20, True), (5, 1, True)], "rows int, gap_days int, answered boolean")
    told = J.window_status(log, 900, 14)
    assert [r.status for r in told.collect()] == ["empty", "error", "error", "partial", "ok"]
    assert sorted(r.status for r in J.open_windows(told).collect()) == ["error", "error", "partial"]
