from panelwright.operators import text as X


def test_long_texts_are_scored_whole(spark):
    texts = ["is " * 4_000 + "elephants " * 2_000, "a " + "x" * 25_000, "", "  ", None, "elephants is"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")

    def by_length(texts):
        return texts.map(lambda t: sum((len(x) > 6) - (len(x) < 3) for x in t.split()) / max(len(t.split()), 1))

    got = {r.i: round(r.score, 9) for r in X.scored(rows, "text", lambda: by_length).collect()}
    assert got == {0: round((2_000 - 4_000) / 6_000, 9), 1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_pieces():
    for text in ("", "ab cd ef", "abcdefgh", "ab  cdefgh i", " " * 9):
        cut = X.pieces(text, 4)
        assert "".join(cut) == text and all(len(p) <= 4 for p in cut)
    assert X.pieces("ab cd ef", 4) == ["ab ", "cd ", "ef"]


def test_reports_of_many_lines_take_time_in_proportion(spark):
    """Lines are cleaned once each, not once more for each line."""
    from time import monotonic

    lines = [f"line {i} of a long report" for i in range(3000)] + ["Safe Harbor Statement: x", "Cautionary Statement", "", "tail"]
    df = spark.createDataFrame([("\n".join(lines),), (None,)], "text string")
    start = monotonic()
    got = [r[0] for r in df.select(X.without_boilerplate(df.text)).collect()]
    assert got == ["\n".join(lines[:3000]), None] and monotonic() - start < 60


def test_texts_come_in_small_batches(spark):
    rows = spark.range(3000).selectExpr("'a b' AS text").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        assert X.scored(rows, "text", lambda: lambda texts: texts.map(lambda t: float(len(texts)))).agg({"score": "max"}).first()[0] <= 200
    finally:
        spark.conf.set(key, before)
