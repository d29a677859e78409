"""Reading tables, nested documents and text files, each with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import strip

FACTS = "map<string,map<string,struct<units:map<string,array<struct<end:string,val:double,form:string,frame:string>>>>>>"
FEED = "struct<feed:array<struct<time_published:string,title:string,summary:string,source_domain:string,ticker_sentiment:array<struct<ticker:string,relevance_score:string>>>>>"
COMPACT = "struct<columns:array<string>,data:array<array<string>>>"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can reach the path, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that are missing are added as typed NULLs."""
    return df.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in columns.items() if c not in df.columns))


def in_order(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return with_optional(df, columns).select(*columns)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", multiline: bool = False) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=sep, multiLine=multiline, escape='"', enforceSchema=False)


def read_lexicon(spark: SparkSession, path: str, categories: list[str], word: str = "Word") -> DataFrame:
    """(word, *categories in lower case): a dictionary from a CSV whose category columns hold a number (the year a word was added) above 0 for members.

    Words are upper-cased, and one that stands twice belongs to the categories of either row. A missing category has no
    members; without the word column there are no words.
    """
    rows = spark.read.csv(path, header=True, escape='"')
    of = lambda c: (F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)) > 0).cast("int") if c in rows.columns else F.lit(0)
    if word not in rows.columns:
        return spark.createDataFrame([], ", ".join(["word string", *(f"{c.lower()} int" for c in categories)]))
    return rows.where(F.col(word).isNotNull()).groupBy(F.upper(F.col(word)).alias("word")).agg(*(F.max(of(c)).alias(c.lower()) for c in categories))


def articles(rows: DataFrame, universe: DataFrame, first: str, last: str) -> DataFrame:
    """Bulk articles of known symbols within dates; unparseable dates are dropped."""
    from panelwright.functions.scalar import clean_field, parse_timestamp

    at = parse_timestamp(F.col("Date"))
    got = rows.select(F.upper(strip(F.col("Stock_symbol"))).alias("ticker"), at.alias("published_at"), F.coalesce(clean_field(F.col("Article_title")), F.lit("")).alias("title"), F.coalesce(clean_field(F.col("Lsa_summary"), 2000), clean_field(F.col("Article"), 2000)).alias("snippet"))
    return got.where(at.isNotNull() & F.col("published_at").between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"))).join(universe.select("ticker"), "ticker", "left_semi")


def company_facts(raw: DataFrame, key: str, json: str) -> DataFrame:
    """(key, namespace, tag, unit, end, val, form, frame) of nested facts."""
    ns = raw.select(key, F.explode(F.from_json(F.get_json_object(json, "$.facts"), FACTS)).alias("namespace", "tags"))
    tags = ns.select(key, "namespace", F.explode("tags").alias("tag", "x"))
    units = tags.select(key, "namespace", "tag", F.explode("x.units").alias("unit", "entries"))
    return units.select(key, "namespace", "tag", "unit", F.inline("entries")).withColumn("end", F.col("end").try_cast("date"))


def by_priority(facts: DataFrame, keys: list[str], name: str, wanted: list[str]) -> DataFrame:
    """Of alternatives the first wanted one that is there, for each key; of rows in equal place the one with the greatest other values."""
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col(name))
    w = Window.partitionBy(*keys).orderBy("_place", *(F.desc(c) for c in facts.columns if c not in (*keys, name)))
    return facts.withColumn("_place", place).where("_place > 0").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_place", "_r")


def filing_index(raw: DataFrame, key: str, recent: str, forms: list[str], first: str, last: str) -> DataFrame:
    """Rows of parallel arrays, of the given forms and dates, complete ones only."""
    names = ("form", "filingDate", "accessionNumber", "primaryDocument", "reportDate")
    each = raw.select(key, F.inline(F.arrays_zip(*(F.col(f"{recent}.{n}").alias(n) for n in names))))
    kept = each.where(F.col("form").isin(forms) & (F.col("filingDate") >= first) & (F.col("filingDate") <= last))
    return kept.where(F.nullif(F.col("accessionNumber"), F.lit("")).isNotNull() & F.nullif(F.col("primaryDocument"), F.lit("")).isNotNull())


def news_feed(raw: DataFrame, ticker: str, json: str) -> DataFrame:
    """Articles of a feed page for each row's ticker, with the relevance that the page gives it; bad times are NULL."""
    items = raw.select(ticker, F.explode(F.from_json(json, FEED)["feed"]).alias("a"))
    own = F.get(F.filter("a.ticker_sentiment", lambda s: F.upper(s["ticker"]) == F.upper(F.col(ticker))), F.lit(0))
    return items.select(
        ticker, F.try_to_timestamp("a.time_published", F.lit("yyyyMMdd'T'HHmmss")).alias("published_at"), strip(F.col("a.title")).alias("title"), F.substring(strip(F.col("a.summary")), 1, 2000).alias("snippet"),
        F.col("a.source_domain").alias("site"), own["relevance_score"].try_cast("double").alias("relevance"),
    )


def short_volume(lines: DataFrame) -> DataFrame:
    """(ticker, date, short_volume, total_volume, short_ratio) of pipe-delimited rows."""
    c = lambda n: F.col(n).try_cast("double")
    day = F.try_to_timestamp(F.col("Date").cast("string"), F.lit("yyyyMMdd")).cast("date")
    return lines.select(F.col("Symbol").alias("ticker"), day.alias("date"), c("ShortVolume").alias("short_volume"), c("TotalVolume").alias("total_volume"), F.try_divide(c("ShortVolume"), c("TotalVolume")).alias("short_ratio"))


def compact_column(raw: DataFrame, key: str, json: str, pattern: str) -> DataFrame:
    """(key, period, value) of column-and-data JSON; the value column is the first whose name matches."""
    doc = raw.select(key, F.from_json(json, COMPACT).alias("d"))
    at = lambda p: F.array_position(F.transform("d.columns", lambda n: F.lower(n).rlike(p)), True) - 1
    each = doc.select(key, at("period|date").alias("p"), at(pattern).alias("v"), F.explode("d.data").alias("row"))
    return each.where("v >= 0").select(key, F.get("row", F.col("p")).alias("period"), F.get("row", F.col("v")).try_cast("double").alias("value"))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, section, front, body) of whole-file notes with front matter between `---` lines."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    head = r"(?s)^---\s*\n(.*?)\n---\s*\n"
    name = F.regexp_extract("path", r"([^/]+)\.\w+$", 1)
    return raw.select("path", name.alias("name"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("section"), front_matter(F.regexp_extract("text", head, 1)).alias("front"), strip(F.regexp_replace("text", head, "")).alias("body"))


def front_matter(text: Column) -> Column:
    """`key: value` lines as a map."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)), strip(F.regexp_replace(x, r"^[^:]*:", ""))))
    return F.map_from_entries(F.array_distinct(pairs))


def largest_per_folder(files: DataFrame) -> DataFrame:
    """Of files(path, length) the largest in each folder that is no index; the folder's name gives the date."""
    rows = files.where(~F.lower("path").rlike(r"index[^/]*$")).withColumn("folder", F.regexp_replace("path", r"/[^/]*$", ""))
    best = rows.groupBy("folder").agg(F.max_by("path", F.struct("length", "path")).alias("path"), F.max("length").alias("length"))
    return best.withColumn("date", F.regexp_extract("folder", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date"))


def jdbc_table(spark: SparkSession, url: str, table: str, where: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A table of a database, its predicate evaluated there, read in parts of a numeric column."""
    return spark.read.jdbc(url, f"(SELECT * FROM {table} WHERE {where}) t", column=column, lowerBound=low, upperBound=high, numPartitions=parts)


def required(df: DataFrame, name: str) -> DataFrame:
    """df, or an error if it has no rows."""
    if df.isEmpty():
        raise LookupError(f"{name}: required rows are missing")
    return df
