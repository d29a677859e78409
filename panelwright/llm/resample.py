"""Importance resampling towards a target distribution (operator 11).

A word ends at every line break, so texts are cut into lines, and the n-gram counts of a line are made once for each
distinct line: its features are hashed into buckets, multiplied by the line's occurrences for the counts of the whole
corpus, and summed under the buckets' gains for the weights of all documents that hold the line. N-grams whose words
stand on several lines belong to no line; they are made from the documents and added to both sums. A bucket's gain is the
log ratio of its smoothed shares in the target and in the corpus, in thousandths. Documents are drawn without
replacement by the Gumbel trick: the weight plus noise that a seeded hash of the id gives, highest first.

Lines travel once, to be counted; after that a line or a text is named by two 64-bit hashes. Line counts are combined
before they are shuffled, and both sides of the join by line are stored tables, so rows of a line that a third of all
documents hold can be split. Only the counts of the buckets (a parameter) and of the sorted parts reach the driver; ranks
come from range partitions, so no task holds all scores.

Defined results: a NULL or empty text has no words, weight 0 and no rank; rows that repeat an id and a text are drawn
each, with the same noise, in any order among themselves; a NULL id has the noise of an empty id and comes last among
equal scores; an empty corpus gives an empty table, an empty target counts nothing; other columns are not used. A text of
any length is cut into lines; a line is held as one row.
"""

from __future__ import annotations

import itertools
import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import discard, stored, table

BUCKETS, PERCENT, SEED, LEAST_WORDS = 10_000, 10, 2024, 20
#: All characters but digits, a-z and those beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LINE = ["line1", "line2"]
DOC = ["doc_id", "text1", "text2"]

ORACLE_SQL = """
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS crc),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words FROM documents),
aim AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS word FROM benchmark),
each AS (SELECT doc_id, unnest(words) AS word FROM doc),
held AS (SELECT DISTINCT word, hex(encode(word)) AS code FROM (SELECT word FROM each UNION ALL SELECT word FROM aim)),
bytes AS (SELECT word, list_transform(range(CAST(length(code) / 2 AS BIGINT)), lambda i: (instr('0123456789ABCDEF', code[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', code[2 * i + 2]) - 1) AS code FROM held),
place AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), code), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
ours AS (SELECT bucket, count(*) AS s FROM each JOIN place USING (word) GROUP BY 1),
theirs AS (SELECT bucket, count(*) AS t FROM aim JOIN place USING (word) GROUP BY 1),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT count(*) FROM each) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT count(*) FROM aim) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM ours LEFT JOIN theirs USING (bucket)),
total AS (SELECT doc_id, sum(gain) AS weight FROM each JOIN place USING (word) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM doc LEFT JOIN total USING (doc_id)),
noisy AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM ranked
"""


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), GAP), lambda w: w != "")


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def grams(own: Column, size: int, buckets: int) -> Column:
    """Buckets of all runs of `size` words of an array."""
    if size == 1:
        return F.transform(own, lambda w: bucket(w, buckets))
    starts = lambda n: F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return _let(own, lambda a: F.transform(starts(F.size(a)), lambda i: bucket(F.array_join(F.slice(a, i, F.lit(size)), " "), buckets)))


def crossing(text: Column, most: int, buckets: int) -> Column:
    """Buckets of all runs of 2 to `most` words of a text that stand on more than one line."""
    each = F.transform(F.split(text, "\n"), lambda line, i: F.transform(words(line), lambda w: F.struct(i.alias("line"), w.alias("word"))))
    line, word = (lambda x: x["line"]), (lambda x: x["word"])

    def of(size: int, a: Column) -> Column:
        starts = F.when(F.size(a) >= size, F.sequence(F.lit(1), F.size(a) - size + 1)).otherwise(F.array().cast("array<int>"))
        across = F.filter(starts, lambda i: line(F.element_at(a, i)) != line(F.element_at(a, i + size - 1)))
        return F.transform(across, lambda i: bucket(F.array_join(F.transform(F.slice(a, i, F.lit(size)), word), " "), buckets))

    return _let(F.flatten(each), lambda a: F.concat(*(of(size, a) for size in range(2, most + 1))))


def named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text1"), F.xxhash64(F.lit(1), text).alias("text2"))


def line_features(texts: DataFrame, most: int, buckets: int) -> DataFrame:
    """(line1, line2, n_words, features, occurrences) of the distinct lines of texts(text), features being the buckets of a line's n-grams."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("occurrences"))
    own = words(F.col("line"))
    made = lines.select(*_line_name(F.col("line")), own.alias("own"), "occurrences")
    return made.select(*LINE, F.size("own").alias("n_words"), F.concat(*(grams(F.col("own"), size, buckets) for size in range(1, most + 1))).alias("features"), "occurrences")


def _line_name(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias(LINE[0]), F.xxhash64(F.lit(1), line).alias(LINE[1])]


def bucket_counts(lines: DataFrame, texts: DataFrame, most: int, buckets: int) -> dict[int, int]:
    """How often each bucket occurs in all texts; as many numbers as there are buckets at most."""
    found = lines.select(F.explode("features").alias("bucket"), "occurrences")
    if most > 1:
        found = found.unionByName(texts.select(F.explode(crossing(F.col("text"), most, buckets)).alias("bucket"), F.lit(1).cast("long").alias("occurrences")))
    return {r.bucket: r.n for r in found.groupBy("bucket").agg(F.sum("occurrences").alias("n")).collect()}


def gains(ours: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    s, t = sum(ours.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + buckets) / ((ours.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)]


def weights(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row of docs(doc_id, text); target(text) is the distribution to reach."""
    texts, aims = named(docs), target.select(F.coalesce("text", F.lit("")).alias("text"))
    lines = stored(line_features(texts, most, buckets))
    found = gains(bucket_counts(lines, texts, most, buckets), bucket_counts(line_features(aims, most, buckets), aims, most, buckets), buckets)
    # One literal array, as long as there are buckets.
    gain = F.split(F.lit(",".join(map(str, found))), ",").cast("array<bigint>")
    total = lambda features: F.aggregate(features, F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get(gain, b))
    of_line = lines.select(*LINE, "n_words", F.size("features").alias("n_features"), total(F.col("features")).alias("weight"))
    rows = texts.select(*DOC, F.posexplode(F.split("text", "\n")).alias("at", "line")).select(*DOC, (F.col("at") == 0).cast("long").alias("rows"), *_line_name(F.col("line")))
    sums = rows.join(of_line, LINE).select(*DOC, "rows", "n_words", "n_features", "weight")
    if most > 1:
        across = crossing(F.col("text"), most, buckets)
        own = texts.select(*DOC, across.alias("across"))
        sums = sums.unionByName(own.select(*DOC, *(F.lit(0).cast("long").alias(c) for c in ("rows", "n_words")), F.size("across").alias("n_features"), total(F.col("across")).alias("weight")))
    # Equal rows were summed together: each has its share.
    each = sums.groupBy(*DOC).agg(*(F.sum(c).alias(c) for c in ("rows", "n_words", "n_features", "weight")))
    share = lambda c: F.expr(f"{c} div rows").alias(c)
    made = stored(each.select("doc_id", share("n_words"), share("n_features"), share("weight"), F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("_")).drop("_"))
    discard(lines)
    return made


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored with the rank of the floor(percent * N / 100) highest scores among the N rows of `least_words` words or more, NULL elsewhere."""
    spark = scored.sparkSession
    able = scored.where(F.col("n_words") >= least_words)
    wanted = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The id holds a part's number above 33 bits and the place in the part below.
    placed = stored(able.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    split = placed.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["part"]: r["count"] for r in split.groupBy("part").count().collect()}  # one number for each part
    before = list(itertools.accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)), initial=0))
    start = F.get(F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>"), F.col("part").cast("int"))
    rank = start + F.col("place") + 1
    ranked = split.withColumn("rank", F.when(rank <= wanted, rank)).drop("part", "place")
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of docs(doc_id, text); rows with a rank are the sample."""
    made = weights(docs, target, most, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return drawn(made.withColumn("score", F.col("weight") + noise), percent, least_words)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
