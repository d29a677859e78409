"""Queries over text and vector jobs: TX1-TX15."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators import text as X
from panelwright.operators.panel import small
from panelwright.plans.registry import Tables, query
from panelwright.sources.chunks import add_chunks, counts
from panelwright.sources.readers import read_lexicon
from panelwright.sources.sinks import write_csv

W = r"list_filter(string_split_regex(trim(coalesce(text, '')), '\s+'), lambda x: x <> '')"
#: Fixed values of the example dictionary: words and the categories they belong to.
LEXICON = [("THE", 1, 0, 0, 0), ("AND", 0, 1, 0, 0), ("WORTHLESS", 0, 1, 1, 0), ("DE", 1, 0, 0, 1), ("LA", 0, 0, 1, 0)]
VALUES = ", ".join(str(x) for x in LEXICON)


@query("tx1_html_text")
def tx1(t: Tables):
    return t.read("pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@query("tx2_clean_report")
def tx2(t: Tables):
    return t.read("documents").select("doc_id", X.without_boilerplate(F.coalesce("text", F.lit(""))).alias("clean"))


@query("tx3_fixed_chunks", f"SELECT doc_id, i AS chunk, array_to_string(list_slice(w, i * 435 + 1, i * 435 + 435), ' ') AS text FROM (SELECT doc_id, w, unnest(range((len(w) + 434) // 435)) AS i FROM (SELECT doc_id, {W} AS w FROM documents))", "", "", "chunk")
def tx3(t: Tables):
    each = t.read("documents").select("doc_id", F.posexplode(X.fixed_chunks(F.col("text"))).alias("chunk", "c"))
    return each.select("doc_id", "chunk", F.col("c.text").alias("text"))


@query("tx4_word_windows", f"SELECT doc_id, i * 160 AS word_offset, array_to_string(list_slice(w, i * 160 + 1, i * 160 + 200), ' ') AS text FROM (SELECT doc_id, w, unnest(range(CASE WHEN len(w) < 40 THEN 0 ELSE (len(w) - 40) // 160 + 1 END)) AS i FROM (SELECT doc_id, {W} AS w FROM documents))", "", "", "word_offset")
def tx4(t: Tables):
    each = t.read("documents").select("doc_id", F.explode(X.windows(F.col("text"), 200, 160, 40)).alias("c"))
    return each.select("doc_id", F.col("c.offset").alias("word_offset"), F.col("c.text").alias("text"))


@query("tx5_sections")
def tx5(t: Tables):
    """Windows within sections; every other document has headings, the others fall back to windows of the whole."""
    headed = F.concat(F.lit("Item 1. Business "), "text", F.lit("\nItem 7. Management's discussion "), "text")
    docs = t.read("documents").withColumn("text", F.when(F.col("doc_id") % 2 == 0, headed).otherwise(F.col("text")))
    return X.section_chunks(docs, "doc_id", "text").select("doc_id", "section", "chunk", "word_offset", F.length("text").alias("n_chars"))


@query("tx6_packed_paragraphs")
def tx6(t: Tables):
    paragraphs = F.regexp_replace("text", "\n", "\n\n")
    return t.read("documents").select("doc_id", F.posexplode(X.packed_paragraphs(paragraphs, 120, 5)).alias("chunk", "text"))


@query("tx7_notes", rf"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents WHERE len({W}) >= 30")
def tx7(t: Tables):
    notes = t.read("documents").withColumn("text", F.concat(F.lit("---\ntags: a\n---\n"), "text"))
    return notes.select("doc_id", X.note_body(F.col("text")).alias("body")).where("body is not null")


CATEGORIES = ("positive", "negative", "uncertainty", "litigious")
TOKENS = "regexp_extract_all(upper(replace(coalesce({0}, ''), 'ß', 'ss')), '[A-Z'']+')"
_SUMS = ", ".join(f"coalesce((SELECT sum(d.{c}) FROM (SELECT unnest(w) AS word) x JOIN (VALUES {VALUES}) d(word, positive, negative, uncertainty, litigious) USING (word)), 0) AS {c}" for c in CATEGORIES)
TX8 = f"SELECT doc_id, lang, total, positive, negative, uncertainty, litigious, (positive - negative) / greatest(total, 1) AS net FROM (SELECT doc_id, lang, len(w) AS total, {_SUMS} FROM (SELECT doc_id, lang, {TOKENS.format('text')} AS w FROM documents))"


@query("tx8_dictionary_scores", f"SELECT * EXCLUDE (lang) FROM ({TX8})", "net", "", "total positive negative uncertainty litigious")
def tx8(t: Tables):
    """The dictionary comes from a CSV with a column for each category, as such lists are published; the year a word was added marks its members."""
    path = t.scratch()
    write_csv(t.spark.createDataFrame([(w.title(), *(2009 * x for x in sets)) for w, *sets in LEXICON], "Word string, Positive int, Negative int, Uncertainty int, Litigious int"), path)
    lexicon = read_lexicon(t.spark, path, ["Positive", "Negative", "Uncertainty", "Litigious"])
    return X.dictionary_counts(t.read("documents"), "doc_id", "text", small(lexicon), list(CATEGORIES))


def lexicon_scores(df, text: str = "text"):
    """Texts scored by the example dictionary, as a model would be plugged in."""
    model = X.dictionary_scorer({w: p - n for w, p, n, _, _ in LEXICON})
    return X.scored(df, text, scorer=lambda: model, weigh=X.tokens_of)


@query("tx9_model_scores", f"SELECT doc_id, net AS score FROM ({TX8})", "score")
def tx9(t: Tables):
    return lexicon_scores(t.read("documents").select("doc_id", "text")).select("doc_id", "score")


_CASES = " ".join(f"WHEN '{w}' THEN {p - n}" for w, p, n, _, _ in LEXICON)
_NET = f"list_sum(list_transform({TOKENS.format('c')}, lambda x: CASE x {_CASES} ELSE 0 END))"


@query("tx10_document_scores", f"SELECT doc_id, greatest(-1, least(1, avg(s))) AS score, count(*) AS chunks FROM (SELECT doc_id, coalesce({_NET}, 0) / greatest(len({TOKENS.format('c')}), 1) AS s FROM (SELECT doc_id, array_to_string(list_slice(w, i * 435 + 1, i * 435 + 435), ' ') AS c FROM (SELECT doc_id, w, unnest(range((len(w) + 434) // 435)) AS i FROM (SELECT doc_id, {W} AS w FROM documents)))) GROUP BY 1", "score", "", "chunks")
def tx10(t: Tables):
    """Mean of chunk scores, cut to +-1."""
    chunks = t.read("documents").select("doc_id", F.explode(X.fixed_chunks(F.col("text"))).alias("c")).select("doc_id", F.col("c.text").alias("text"))
    got = lexicon_scores(chunks).groupBy("doc_id").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("chunks"))
    return got.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score")))


@query("tx11_batched_scores", f"SELECT doc_id, lang, net AS score FROM ({TX8})", "score")
def tx11(t: Tables):
    rows = X.batched_by_length(t.read("documents").select("doc_id", "lang", "text"), "lang", "text")
    return lexicon_scores(rows).select("doc_id", "lang", "score")


@query("tx12_embeddings")
def tx12(t: Tables):
    return X.embedded(t.read("documents").select("doc_id", "text"), "text").select("doc_id", F.size("embedding").alias("dims"), F.get("embedding", F.lit(0)).alias("first"))


ROUTE = "CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE 'other' END"


@query("tx13_chunk_store", f"SELECT collection, n, added FROM (SELECT {ROUTE} AS collection, count(DISTINCT sha256(text)) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1) JOIN (SELECT collection, count(*) FILTER (NOT early) AS added FROM (SELECT {ROUTE} AS collection, sha256(text) AS id, bool_or(doc_id % 3 <> 0) AS early FROM documents WHERE text IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (collection)", "", "", "n added")
def tx13(t: Tables):
    """Two overlapping adds to a store of chunks; the second adds the difference only."""
    path = t.scratch()
    rows = t.read("documents").select("doc_id", F.col("lang").alias("source"), "text", F.to_json(F.struct("source", "doc_id")).alias("metadata"))
    for part in (rows.where("doc_id % 3 <> 0"), rows):
        added = add_chunks(t.spark, path, part, {"en": "english", "de": "german"})
    return counts(t.spark, path).join(added, "collection")


@query("tx14_context", f"SELECT lang, string_agg(t, ' ... ' ORDER BY doc_id) AS context FROM (SELECT lang, doc_id, array_to_string(list_slice({W}, 1, 300), ' ') AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 6 GROUP BY 1")
def tx14(t: Tables):
    """The first six of each language (a top-k, taken within salted parts first), each cut to 300 words."""
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy("doc_id")
    rows = t.read("documents").withColumn("r", F.row_number().over(salted)).where("r <= 6")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("r <= 6")
    cut = rows.select("lang", "doc_id", F.array_join(F.slice(X.words(F.col("text")), 1, 300), " ").alias("t"))
    return cut.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "t"))), lambda x: x["t"]), " ... ").alias("context"))


@query("tx15_dehyphenated", r"SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) > 20 OR regexp_replace(x, '^\s+|\s+$', '', 'g') = ''), chr(10)), '(\w)-\n(\w)', '\1\2', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def tx15(t: Tables):
    return t.read("documents").select("doc_id", X.dehyphenated(F.col("text")).alias("text"))
