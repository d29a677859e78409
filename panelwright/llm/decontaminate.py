"""Benchmark decontamination by SimHash windows and multi-index Hamming search (operator 5). DataFrame functions only.

Words are lower-cased runs of letters and digits; a text's shingles are its runs of five words in order. A document
matches an item if some window of as many shingles as the item has, or fewer at the text's end, reaches a weighted
similarity of 0.8, the sum of the smaller over the sum of the larger weights, a shingle weighing as often as it occurs.

1. Windows. Moving a window's start to the next shingle that occurs in an item of its size loses no shared one, so windows
   of an item's size start at such shingles, all of them.
2. Fingerprints. A window's SimHash has 64 bits, each the majority of that bit among the hashes of its shingles. Bits are
   counted by running sums along a text, two counters to a word; a window's counts are the difference of two sums.
3. Search. Fingerprints are cut into 5 blocks. If two differ in `RADIUS` bits or fewer, some block differs in 3 at most,
   so items are listed under every block value within 3 bits of theirs and windows look up their blocks: all fingerprints
   within the radius meet.
4. Far windows. At a similarity of exactly 0.8 fewer than one window in a thousand lies beyond the radius, and more of
   items of few shingles. A window that matches holds all but a fifth of the item's shingles, so one at least of any fifth
   of them and one more: pairs of a text and an item that meet in the item's rarest shingles so many are candidates too,
   if the text holds enough of the item's shingles. So none is missed.
5. Candidates are verified on the weighted shingles themselves: an occurrence of a shingle that an item holds c times
   counts in all windows that begin after the c-th occurrence before it, so sums along the text give the shared weight of
   every window.

All steps take time in proportion to texts, items and meetings (but for sorting), however long a text or item is. The
shingles of items are broadcast if there are `MOST` at most, counted beforehand; otherwise they are joined by a shuffle.

Defined results: a text or item without words matches nothing; one of fewer than five words is a single shingle and can
match only as a whole; equal items each match; rows equal in doc_id and text are one; a NULL doc_id is reported as NULL;
empty tables give no rows; other columns are not used.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.common import all_of, stored, table, unused

SIZE, PERCENT = 5, 80
#: Bits of each block; two fingerprints that differ in RADIUS bits differ in RADIUS // 5 at most in one of them.
BLOCKS, RADIUS = (13, 13, 13, 13, 12), 19
MOST = 1_000_000
#: One bit in each of two counters of 32 bits.
SPREAD = 0x0000000100000001
KEYS = ["doc_id", "_id", "_hash"]


def shingles(text: Column, size: int = SIZE) -> Column:
    """Hashes of a text's runs of words in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
        return F.when(F.size(w) >= size, runs).when(F.size(w) > 0, F.array(F.xxhash64(F.lit("whole"), w))).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(words), of), 1)


def bit_counts(h: Column) -> dict[str, Column]:
    """Bits k and k + 32 of a hash as two counters in a word, for k below 32; zeros for NULL."""
    return {f"c{k}": F.coalesce(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(SPREAD).cast("long")), F.lit(0).cast("long")) for k in range(32)}


def majority(n: Column) -> Column:
    """The 64 bits that more than half of n hashes have, from the sums c0 to c31 of their bit counts."""
    half, one = F.lit(0xFFFFFFFF).cast("long"), F.lit(1).cast("long")
    found = F.lit(0).cast("long")
    for k in range(32):
        for at, count in ((k, F.col(f"c{k}").bitwiseAND(half)), (k + 32, F.shiftrightunsigned(F.col(f"c{k}"), 32))):
            found = found.bitwiseOR(F.when(count * 2 > n, F.shiftleft(one, at)).otherwise(F.lit(0).cast("long")))
    return found


def blocks(fingerprint: Column) -> Column:
    ends = [sum(BLOCKS[:b]) for b in range(len(BLOCKS))]
    return F.array(*(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fingerprint, end).bitwiseAND(F.lit(2**bits - 1).cast("long")).alias("value")) for b, (end, bits) in enumerate(zip(ends, BLOCKS, strict=True))))


def near_blocks(fingerprint: Column) -> Column:
    """Every block with each value within as many bits as a block may differ in."""
    flips = [F.array(*(F.lit(sum(1 << i for i in bits)).cast("long") for n in range(RADIUS // len(BLOCKS) + 1) for bits in combinations(range(size), n))) for size in BLOCKS]
    of_size = F.array(*flips)
    return F.flatten(F.transform(blocks(fingerprint), lambda b: F.transform(F.get(of_size, b["block"]), lambda x: F.struct(b["block"].alias("block"), b["value"].bitwiseXOR(x).alias("value")))))


def item_prints(bench: DataFrame) -> DataFrame:
    """(item, m, target): size and SimHash of each item."""
    each = bench.select("item", "m", F.explode("own").alias("h"))
    sums = each.groupBy("item", "m").agg(*(F.sum(c).alias(k) for k, c in bit_counts(F.col("h")).items()))
    return sums.select("item", "m", majority(F.col("m")).alias("target"))


def window_prints(texts: DataFrame) -> DataFrame:
    """(keys, start, m, print) of the wanted windows (at, m) of texts(keys, own, wanted)."""
    end = lambda w: F.least(w["at"] + w["m"], F.size("own"))
    low, high = F.array_min(F.transform("wanted", lambda w: w["at"])), F.array_max(F.transform("wanted", end))
    none = F.lit(None).cast("long")
    row = lambda at, h, start, m, sign: F.struct(at.alias("at"), F.lit(1 if sign is None else 0).alias("kind"), h.alias("h"), start.alias("start"), m.alias("m"), F.lit(sign or 0).alias("sign"))
    nothing = F.lit(None).cast("int")
    # Along the text: its shingles as far as windows reach, and before them the marks at which windows begin and end.
    shingles_ = F.transform(F.sequence(low, high - 1), lambda i: row(i, F.get("own", i), nothing, nothing, None))
    marks = F.flatten(F.transform("wanted", lambda w: F.array(row(w["at"], none, w["at"], w["m"], -1), row(end(w), none, w["at"], w["m"], 1))))
    along = texts.select(*KEYS, F.explode(F.concat(shingles_, marks)).alias("e")).select(*KEYS, "e.*")
    so_far = Window.partitionBy(*KEYS).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = along.select(*KEYS, "at", "kind", "start", "m", "sign", *(F.sum(c).over(so_far).alias(k) for k, c in bit_counts(F.col("h")).items())).where("kind = 0")
    each = sums.groupBy(*KEYS, "start", "m").agg(F.sum(F.col("sign") * F.col("at")).alias("size"), *(F.sum(F.col("sign") * F.col(f"c{k}")).alias(f"c{k}") for k in range(32)))
    return each.select(*KEYS, "start", "m", majority(F.col("size")).alias("print"))


def close_windows(hits: DataFrame, rows: DataFrame, bench: DataFrame) -> DataFrame:
    """(keys, start, item, m): windows whose fingerprint lies within the radius of an item's."""
    sizes = bench.select(F.explode(F.array_distinct("own")).alias("h"), "m").distinct()
    wanted = hits.join(sizes, "h").groupBy(*KEYS).agg(F.collect_set(F.struct("at", "m")).alias("wanted"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"w.{c}")) if c == "doc_id" else F.col(f"t.{c}") == F.col(f"w.{c}") for c in KEYS]
    joined = rows.alias("t").join(wanted.alias("w"), same[1:]).where(same[0]).select("t.*", "w.wanted").dropDuplicates(["_id", "_hash"])
    windows = stored(window_prints(joined.select(*KEYS, shingles(F.col("text")).alias("own"), "wanted")))
    listed = stored(item_prints(bench))
    probes = listed.select("item", "m", "target", F.explode(near_blocks(F.col("target"))).alias("b")).select("item", "m", "target", "b.*")
    looked = windows.select(*KEYS, "start", "m", "print", F.explode(blocks(F.col("print"))).alias("b")).select(*KEYS, "start", "m", "print", "b.*")
    close = looked.join(probes, ["m", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("target"))) <= RADIUS)
    return close.select(*KEYS, "start", "item", "m").distinct()


def far_pairs(hits: DataFrame, bench: DataFrame, percent: int) -> DataFrame:
    """(keys, item): texts that hold one of an item's rarest shingles, a fifth of them and one more, and enough of its shingles."""
    held = hits.groupBy("h").agg(F.count(F.lit(1)).alias("held"))
    own = stored(bench.select("item", "m", F.explode("own").alias("h")).groupBy("item", "m", "h").agg(F.count(F.lit(1)).alias("c")))
    rising = Window.partitionBy("item").orderBy("held", "h")  # one item's shingles
    before = F.sum("c").over(rising.rowsBetween(Window.unboundedPreceding, -1))
    rare = own.join(held, "h", "left").withColumn("held", F.coalesce("held", F.lit(0))).withColumn("before", F.coalesce(before, F.lit(0)))
    rare = rare.where(F.col("before") * 100 <= F.col("m") * (100 - percent)).select("item", "h")
    pairs = hits.join(rare, "h").select("_id", "_hash", "item").distinct()
    each = hits.join(own, "h").join(pairs, ["_id", "_hash", "item"], "left_semi")
    return each.groupBy(*KEYS, "item", "m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 100 >= F.col("m") * percent).select(*KEYS, "item")


def verified(hits: DataFrame, pairs: DataFrame, bench: DataFrame, percent: int) -> DataFrame:
    """(keys, item, similarity, start): the best window of each pair of a text and an item that reaches the similarity."""
    own = bench.select("item", "m", F.explode("own").alias("h")).groupBy("item", "m", "h").agg(F.count(F.lit(1)).alias("c"))
    of = ["_id", "_hash", "item"]
    each = hits.join(own, "h").join(pairs.select(*of).distinct(), of, "left_semi")
    rank = F.row_number().over(Window.partitionBy(*of, "h").orderBy("at"))
    each = stored(each.withColumn("rank", rank))
    # The c-th occurrence before: a window that begins at or before it holds c of this shingle without the present one.
    back = each.where("c < rank").select(*of, "h", "at", (F.col("rank") - F.col("c")).alias("rank"))
    past = back.join(each.select(*of, "h", "rank", F.col("at").alias("past")), [*of, "h", "rank"]).select(*of, "at", "past")
    met = each.join(past, [*of, "at"], "left")
    first = F.greatest(F.coalesce(F.col("past") + 1, F.lit(0)), F.col("at") - F.col("m") + 1, F.lit(0))
    row = lambda at, kind, delta: F.struct(at.alias("pos"), F.lit(kind).alias("kind"), F.lit(delta).alias("delta"))
    along = met.select(*KEYS, "item", "m", "n", F.explode(F.array(row(first, 0, 1), row(F.col("at") + 1, 0, -1), row(F.col("at"), 1, 0))).alias("e")).select(*KEYS, "item", "m", "n", "e.*")
    so_far = Window.partitionBy(*of).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = along.withColumn("shared", F.sum("delta").over(so_far)).where("kind = 1")
    either = F.least(F.col("m"), F.col("n") - F.col("pos")) + F.col("m") - F.col("shared")
    good = sums.withColumn("either", either).where(F.col("shared") * 100 >= F.col("either") * percent)
    best = F.max(F.struct((F.col("shared") / F.col("either")).alias("similarity"), (-F.col("pos")).alias("start")))
    found = good.groupBy(*KEYS, "item").agg(best.alias("best"))
    return found.select(*KEYS, "item", "best.similarity", (-F.col("best.start")).alias("start"))


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, similarity, start): matches with the best window's similarity and first word."""
    return matches(docs, items, percent).drop("_id", "_hash")


def found_places(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed rows, distinct items (item, own, m), and the places (keys, n, at, h) of items' shingles in texts of n shingles."""
    own = items.select(shingles(F.col("text")).alias("own")).where(F.size("own") > 0).distinct()
    bench = stored(own.select(F.xxhash64("own").alias("item"), "own", F.size("own").alias("m")))
    vocabulary = stored(bench.select(F.explode("own").alias("h")).distinct())
    if vocabulary.count() <= MOST:
        vocabulary = F.broadcast(vocabulary)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", F.lit("id")).alias("_id"), F.xxhash64(text).alias("_hash"))
    each = rows.select(*KEYS, shingles(F.col("text")).alias("own")).select(*KEYS, F.size("own").alias("n"), F.posexplode("own").alias("at", "h"))
    return rows, bench, stored(each.join(vocabulary, "h").select(*KEYS, "n", "at", "h").distinct())


def matches(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, _id, _hash, item_id, similarity, start): matches with the best window's similarity and first word."""
    rows, bench, hits = found_places(docs, items)
    close = close_windows(hits, rows, bench).select(*KEYS, "item")
    pairs = stored(close.unionByName(far_pairs(hits, bench, percent)).distinct())
    found = verified(hits, pairs, bench, percent)
    ids = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(shingles(F.col("text"))).alias("item")).distinct()
    return found.join(ids, "item").select(*KEYS, "item_id", "similarity", F.col("start").cast("int").alias("start"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found; of rows with a NULL or repeated doc_id only those whose own text matched go."""
    id_, text_ = (unused(docs.columns, n) for n in ("_hit_id", "_hit_text"))
    hit = matches(docs, table(spark, sf_dir, "benchmark")).select(F.col("_id").alias(id_), F.col("_hash").alias(text_)).distinct()
    own = (F.xxhash64(docs["doc_id"], F.lit("id")) == F.col(id_)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(text_))
    return docs.join(hit, own, "left_anti").select(*all_of(docs.columns))
