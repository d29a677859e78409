from panelwright.sources import chunks as C
from panelwright.sources import readers as RD

ROUTES = {"filing": "filings", "news": "news"}


def test_only_what_is_new_is_added_and_embedded(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(r, "source string, text string, metadata string")
    added = lambda df: {r.collection: r.added for r in C.add_chunks(spark, path, df, ROUTES, "notes").collect()}
    assert added(rows(("filing", "one two", "b"), ("filing", "one two", "a"), ("news", "one two", "c"), (None, "three", None), ("news", None, "x"))) == {"filings": 1, "news": 1, "notes": 1}
    assert added(rows(("filing", "one two", "0"), ("filing", "four", "d"), ("else", "three", "z"))) == {"filings": 1, "news": 0, "notes": 0}
    assert added(rows().limit(0)) == {"filings": 0, "news": 0, "notes": 0}
    held = {(r.collection, r.text): r for r in C.stored_chunks(spark, path).collect()}
    assert {k: r.metadata for k, r in held.items()} == {("filings", "one two"): "a", ("news", "one two"): "c", ("notes", "three"): None, ("filings", "four"): "d"}
    assert held["filings", "one two"].embedding == held["news", "one two"].embedding and all(r.embedding for r in held.values())
    assert {r.collection: r.n for r in C.counts(spark, path).collect()} == {"filings": 2, "news": 1, "notes": 1}


def test_lookup_reads_touched_buckets_only(spark, tmp_path, capsys):
    path = str(tmp_path / "store")
    C.add_chunks(spark, path, spark.createDataFrame([("news", f"text {i}", None) for i in range(200)], "source string, text string, metadata string"), ROUTES)
    touched = spark.createDataFrame([("news", 3)], "collection string, bucket int")
    C.stored_chunks(spark, path).join(touched, ["collection", "bucket"], "left_semi").select("id").explain("formatted")
    assert "PartitionFilters" in capsys.readouterr().out


def test_dictionary_from_categories(spark, tmp_path):
    read = lambda text: sorted(tuple(r) for r in RD.read_lexicon(spark, write(text), ["Positive", "Negative", "Litigious"]).collect())

    def write(text):
        path = tmp_path / f"{abs(hash(text))}.csv"
        path.write_text(text)
        return str(path)

    assert read("Word,Negative,Positive,Other\nabandon,2009,0,1\nGood,0,2009,\nabandon,0,2011,1\n\"BOTH\",2009,1.5,x\nnone,,n/a,\n") == [("ABANDON", 1, 1, 0), ("BOTH", 1, 1, 0), ("GOOD", 1, 0, 0), ("NONE", 0, 0, 0)]
    assert read("Term,Negative\nabandon,1\n") == []
