"""Document fingerprints by a homomorphic multiset hash (operator 2). DataFrame functions only.

A text is the multiset of its paragraphs: stretches that end with a line break or a full stop, exclamation or question
mark, terminators kept, so that the paragraphs of a text joined give the text. Each paragraph is hashed to a vector and a
document's fingerprint is the sum of its paragraphs' vectors. The vector has two parts:

* `IDENTITY` words of 64 bits, summed modulo 2^64: equal multisets have equal sums, and different ones differ but for a
  collision of 2 x 64 independent hash bits;
* `SKETCH` words of 64 bits, each holding two counters of 32 bits, one for each bit of a hash; a text has less than 2^31
  paragraphs, so none overflows into the other. A counter of m paragraphs
  less m/2 is a random sign sum, so the distance of two fingerprints estimates the size of the multisets' difference.

Sums make the fingerprint independent of order and let paragraphs be inserted or deleted without the text (`combine`).
Likeness is 1 - |A - B|^2 / (|A|^2 + |B|^2) with multiset norms estimated from the counters, cut to 0..1.

Defined results: NULL and empty texts are one empty paragraph and equal each other. The next document is the next row by
descending doc_id and, for repeated ids, descending text hash and text; the last row's next is the first; a single document is its own
next; NULL ids come last. An empty table gives an empty table; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.common import stored, table

#: After each of these a paragraph ends.
BOUNDARY = r"(?<=[.!?\n])"
IDENTITY, SKETCH = 4, 64
COUNTERS = 2 * SKETCH
#: Ranges of the order for each shuffle partition, so that several small ones share a task and a large one is none.
RANGES = 4
#: One bit in each of two counters of 32 bits.
SPREAD = 0x0000000100000001


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), BOUNDARY, -1)


def _added(total: Column, hashes: Column, sign: int = 1) -> Column:
    """Word-wise sum of two vectors; long arithmetic wraps, as bit operations on halves avoid overflow errors."""
    return F.zip_with(total, hashes, lambda a, b: wrapping_add(a, b if sign > 0 else wrapping_add(F.bitwise_not(b), F.lit(1).cast("long"))))


def wrapping_add(a: Column, b: Column) -> Column:
    """a + b modulo 2^64: low and high halves apart, because ANSI mode rejects overflow."""
    low = F.lit(0xFFFFFFFF).cast("long")
    lows = a.bitwiseAND(low) + b.bitwiseAND(low)
    highs = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(lows, 32)
    return F.shiftleft(highs, 32).bitwiseOR(lows.bitwiseAND(low))


def fingerprint(text: Column) -> Column:
    """Array of IDENTITY + SKETCH longs, then the number of paragraphs.

    Counters and halves are summed as plain longs that cannot overflow (at most 2^31 paragraphs); carries are settled once.
    """
    half = F.lit(0xFFFFFFFF).cast("long")
    spread = F.lit(SPREAD).cast("long")
    hashes = F.transform(
        paragraphs(text),
        lambda p: F.struct(F.xxhash64(F.lit(11), p).alias("a"), F.xxhash64(F.lit(12), p).alias("b")),
    )
    fields = {"n": lambda h: F.lit(1).cast("long")}
    for i in range(IDENTITY):
        word = (lambda h: h["a"]) if i == 0 else (lambda h: h["b"]) if i == 1 else (lambda h, i=i: F.xxhash64(F.lit(i), h["a"], h["b"]))
        fields[f"l{i}"] = lambda h, word=word: word(h).bitwiseAND(half)
        fields[f"h{i}"] = lambda h, word=word: F.shiftrightunsigned(word(h), 32)
    for i in range(SKETCH):
        fields[f"s{i}"] = lambda h, i=i: F.shiftrightunsigned(h["a"] if i < 32 else h["b"], i % 32).bitwiseAND(spread)
    zero = F.struct(*(F.lit(0).cast("long").alias(k) for k in fields))
    total = F.aggregate(hashes, zero, lambda s, h: F.struct(*((s[k] + make(h)).alias(k) for k, make in fields.items())))
    words = lambda t: F.array(
        *(F.shiftleft(t[f"h{i}"] + F.shiftrightunsigned(t[f"l{i}"], 32), 32).bitwiseOR(t[f"l{i}"].bitwiseAND(half)) for i in range(IDENTITY)),
        *(t[f"s{i}"] for i in range(SKETCH)),
        t["n"],
    )
    return F.element_at(F.transform(F.array(total), words), 1)


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """The fingerprint of a text with paragraphs inserted (sign 1) or deleted (sign -1), from the fingerprints of both."""
    return _added(left, right, sign)


def as_hex(vector: Column) -> Column:
    """Lower-case hex of all words, 16 digits each."""
    return F.array_join(F.transform(vector, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def counters(vector: Column) -> Column:
    """The signed counters, doubled: 2 * counter - paragraphs."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    n = F.element_at(vector, IDENTITY + SKETCH + 1)
    words = F.slice(vector, IDENTITY + 1, SKETCH)
    apart = F.flatten(F.transform(words, lambda w: F.array(*(F.shiftrightunsigned(w, 32 * k).bitwiseAND(mask) for k in range(2)))))
    return F.transform(apart, lambda c: (2 * c - n).cast("double"))


def likeness(left: Column, right: Column) -> Column:
    """0 to 1 from two arrays of counters; 1 if they are equal."""
    squares = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    apart = squares(F.zip_with(left, right, lambda a, b: a - b))
    both = squares(left) + squares(right)
    return F.when(both == 0, F.when(apart == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - apart / both))


def bounds(docs: DataFrame) -> DataFrame:
    """One row with `cuts`, the ordered lists of lists of (_key, _row) at which ranges of rows begin: RANGES for each partition of Spark's shuffles.

    Ranges are those of Spark's own range partitioning of (key, hash of the text), so rows of one repeated or NULL doc_id
    fall into many of them.
    """
    many = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, so that small rows' ranges are not coalesced
    rows = docs.select("_key", "_row").repartitionByRange(many, "_key", "_row").select(F.spark_partition_id().alias("_part"), F.struct("_key", "_row").alias("_at"))
    least = rows.groupBy("_part").agg(F.min("_at").alias("_at"))
    cuts = least.agg(F.array_sort(F.collect_list("_at")).alias("all"))
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("all")))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - 1), step), lambda i: F.slice("all", i + 1, step))
    return stored(cuts.select(parts.alias("cuts")))


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), print, next_text and next_print: text and fingerprint of the next row by descending (doc_id, text hash, text), the last row's being the first's.

    Rows are put into ranges of the order and each range is ordered by itself, so text is shuffled once and a fingerprint
    is made once; the last row below each range, one for each, is handed on to the next. Sorted rows stream through the
    window, so a range need not fit into memory.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("_key"), F.xxhash64(text).alias("_row"))
    own = F.struct("_key", "_row")
    # Two levels of bounds, so that finding a row's range takes about 2 * sqrt(bounds) comparisons.
    known = rows.withColumn("_cuts", bounds(rows).scalar())
    below = lambda cuts, at: F.size(F.filter(cuts, at))
    coarse = known.withColumn("_coarse", below(F.col("_cuts"), lambda x: F.get(x, 0) <= own))
    fine = below(F.get("_cuts", F.col("_coarse") - 1), lambda x: x <= own)
    placed = coarse.withColumn("_range", F.struct("_coarse", fine.alias("_fine"))).drop("_cuts", "_coarse")
    # Of each range the greatest row: the range above (or, for the topmost, the lowest) needs its text.
    tops = placed.groupBy("_range").agg(F.max(own).alias("_top"))
    ring = Window.orderBy("_range")  # as many rows as ranges
    tops = tops.withColumn("_to", F.coalesce(F.lead("_range").over(ring), F.min("_range").over(Window.partitionBy(F.lit(1)))))
    carried = placed.join(F.broadcast(tops), (placed["_range"] == tops["_range"]) & (own == tops["_top"])).groupBy("_to").agg(F.max("text").alias("text"))
    # Carried rows sort below every row of their range.
    every = placed.select("_range", F.lit(1).alias("_own"), "_key", "_row", "doc_id", "text").unionByName(
        carried.select(F.col("_to").alias("_range"), F.lit(0).alias("_own"), F.lit(0).cast("long").alias("_key"), F.lit(0).cast("long").alias("_row"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text")
    )
    order = Window.partitionBy("_range").orderBy("_own", "_key", "_row", "text")
    # Fingerprints are made between two windows of one order: after the shuffle and once for a row.
    every = every.withColumn("next_text", F.lag("text").over(order)).withColumn("print", fingerprint(F.col("text")))
    return every.withColumn("next_print", F.lag("print").over(order)).where("_own = 1").select("doc_id", "text", "print", "next_text", "next_print")


def op2_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("n_chars", F.char_length("text").cast("long"))
    half = (F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", edited.alias("edited"), F.col("print").alias("f"), F.col("next_print").alias("x"))
    prints = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "f", fingerprint(F.col("edited")).alias("e"), "x")
    counted = prints.withColumns({"cf": counters(F.col("f")), "ce": counters(F.col("e")), "cx": counters(F.col("x"))})
    return counted.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("f")).alias("fingerprint"), as_hex(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("cf"), F.col("ce")).alias("near_edited"), likeness(F.col("cf"), F.col("cx")).alias("near_next"),
    )
