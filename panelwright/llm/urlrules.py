"""URL filters: fixed rules first, then mined association rules (operator 7).

A fixed rule (host, path) fits its host and all subdomains if the url's path starts with the rule's path; the longest rule
that fits gives the verdict. For all other urls Spark's FP-growth mines combinations of url tokens from labelled pages
(a page is labelled if labels has its id; quality 0 means block). Rules that conclude `block` are kept if they reach
`CONFIDENCE` and occur in `SUPPORT` of the labelled pages and in `LEAST` of them (two conditions on a rule, whatever the
tables' size), and a rule that adds tokens to another one without a higher confidence is dropped.

Tokens that occur on exactly the same labelled pages, such as a host and its words, are one class and one item for
FP-growth: a rule of classes stands for all rules that take a token of each, which have the same support and confidence,
and rules with two tokens of a class would add one without a higher confidence. So the result is that of all tokens, and
a host's many names do not double its combinations. Rules are pruned size by size, each against those with one item less;
none is left out before.

Rules are matched through an inverted index: postings (token, rule, item) are joined with the tokens of the urls, and a
rule fires where all of its items met a token. A page is blocked if a rule fires, else allowed.

Defined results: a NULL url, or one without `://`, has empty host and path, no tokens, fits no rule and is allowed; an
empty path fits no fixed rule; repeated rows are judged each, and count each as labelled pages; an id that is labelled
more than once is blocked if any label says so; without labelled pages of both verdicts nothing is mined; an empty table
gives an empty table; other columns are not used.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import stored, table

FIXED = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SUPPORT, LEAST, CONFIDENCE = 0.001, 8, 0.6
BLOCK = "=block"
RULES = "rule long, items array<array<string>>, confidence double"


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end."""
    rest = after_scheme(url)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fixed_rule(host: Column, path: Column, rules=FIXED) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits."""
    name = verdict = None
    for own, start, says in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name = F.when(fits, own + start) if name is None else name.when(fits, own + start)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return name, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: host, its ends at each dot, path segments and the names of the query, digits written as 0."""
    host, path = host_and_path(url)
    plain = lambda x: F.regexp_replace(x, r"\d+", "0")
    labels = F.split(host, r"\.")
    ends = F.transform(labels, lambda _, i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    segments = F.transform(F.array_remove(F.split(path, "/"), ""), lambda x: F.concat(F.lit("p:"), plain(x)))
    query = F.regexp_extract(after_scheme(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.array_remove(F.split(query, "&"), ""), lambda x: F.concat(F.lit("q:"), plain(F.regexp_extract(x, r"(?s)^([^=]*)", 1))))
    words = F.transform(F.array_remove(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), ""), lambda x: F.concat(F.lit("w:"), plain(x)))
    return F.array_distinct(F.concat(F.array_remove(ends, "h:"), words, segments, names))


def classes(baskets: DataFrame, least: int) -> DataFrame:
    """(token, item): tokens of `least` baskets (_row, tokens) or more; those of the same baskets have the least of them as their item."""
    each = baskets.select("_row", F.explode("tokens").alias("token"))
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "_row").bitwiseAND(F.lit(2**31 - 1).cast("long")))
    seen = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), part(1).alias("x"), part(2).alias("y"), part(3).alias("z")).where(F.col("n") >= least)
    same = ["n", "x", "y", "z"]
    return seen.join(seen.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item")


def pruned(rules: DataFrame, confidence: float) -> DataFrame:
    """(items, confidence) of rules that reach it and exceed every rule on fewer of their items; rules has all combinations of its rules' items."""
    widest = rules.agg(F.max(F.size("items"))).first()[0]
    level = stored(rules.where(F.size("items") == 1).select("items", "confidence", F.lit(-1.0).alias("best")))
    kept = level
    for size in range(2, widest + 1):
        smaller = level.select(F.col("items").alias("part"), F.greatest("confidence", "best").alias("as_good"))
        wide = rules.where(F.size("items") == size)
        parts = wide.select("items", "confidence", F.explode(F.transform("items", lambda x: F.array_remove(F.col("items"), x))).alias("part"))
        level = stored(parts.join(smaller, "part").groupBy("items", "confidence").agg(F.max("as_good").alias("best")))
        kept = kept.unionByName(level)
    return kept.where((F.col("confidence") >= confidence) & (F.col("confidence") > F.col("best"))).select("items", "confidence")


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """(rule, items, confidence): pruned rules that conclude block; an item is the list of tokens of which a url has to have one."""
    spark = pages.sparkSession
    none = spark.createDataFrame([], RULES)
    said = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("_of")).agg(F.min("quality").alias("_quality"))
    marked = pages.select(F.col("page_id").cast("long").alias("_of"), "url").join(said, "_of")
    baskets = stored(marked.select(F.monotonically_increasing_id().alias("_row"), tokens(F.col("url")).alias("tokens"), (F.col("_quality") == 0).alias("blocked")))
    n, bad = baskets.agg(F.count(F.lit(1)), F.count_if("blocked")).first()
    if not bad:
        return none
    least = max(least, math.ceil(support * n))
    names = stored(classes(baskets, least))
    reduced = baskets.select("_row", F.explode("tokens").alias("token")).join(names, "token").groupBy("_row").agg(F.collect_set("item").alias("items"))
    reduced = baskets.select("_row", "blocked").join(reduced, "_row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    reduced = stored(reduced.select(F.when(F.col("blocked"), F.array_append("items", BLOCK)).otherwise(F.col("items")).alias("items")))
    # A hair below, so that a rule of just `least` pages is not lost to rounding.
    growth = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n), minConfidence=0.0, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = growth.fit(reduced).associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK)))
    rules = stored(found.select(F.array_sort("antecedent").alias("items"), "confidence"))
    if rules.where(F.col("confidence") >= confidence).isEmpty():
        return none
    kept = stored(pruned(rules, confidence).select(F.xxhash64("items").alias("rule"), "items", "confidence"))
    alike = names.groupBy("item").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    each = kept.select("rule", "confidence", F.explode("items").alias("item")).join(alike, "item")
    return each.groupBy("rule", "confidence").agg(F.array_sort(F.collect_list("tokens")).alias("items")).select("rule", "items", "confidence")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence of the mined rule (NULL if none fired) for every row of pages."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id"), F.col("url"), host.alias("host"), path.alias("path"), F.xxhash64("url").alias("_url"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": name, "fixed": verdict})
    rules = stored(rules)
    slots = rules.select("rule", "confidence", F.size("items").alias("size"), F.posexplode("items").alias("item", "tokens"))
    postings = slots.select(F.col("rule").alias("fired"), "confidence", "size", "item", F.explode("tokens").alias("token"))
    asked = rows.where("fixed is null and url is not null").select("url").distinct()
    # Spark broadcasts the postings if they are small and shuffles them by token if not.
    met = asked.select("url", F.explode(tokens(F.col("url"))).alias("token")).join(postings, "token")
    fired = met.groupBy("url", "fired", "size", "confidence").agg(F.count_distinct("item").alias("n")).where(F.col("n") == F.col("size"))
    # Stored, so that a frequent url's rows can be split over tasks.
    best = stored(fired.groupBy("url").agg(F.max("confidence").alias("confidence")))
    judged = rows.join(best, "url", "left")
    by_method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("fixed", by_method).alias("verdict"), F.when(F.col("fixed").isNull(), F.col("confidence")).alias("confidence"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, mine(pages, table(spark, sf_dir, "labels")))
