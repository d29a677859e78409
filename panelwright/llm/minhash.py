"""Near-duplicate groups by bottom-k sketches (operator 4).

One hash function orders all shingles; a document retains its `k` least values. Documents with the same shingle set form
a class, and only class representatives are compared. Inverted lists of retained values generate pairs: of a sketch of
m values the m - overlap + 1 rarest (by counters that values share by residue, an order that is the same for all) are listed, because two sketches that share at least
`overlap` values then share a listed one. For sets that fit into the sketch together with any partner, overlap is what
the similarity demands, so nothing can be missed; for larger sets it is m/2, and a pair at exactly the threshold of 0.8
fails to share so many of 64 values with a probability of 2e-8. Rare values first keep a phrase that a third of all
documents hold from generating pairs.

A list's members are not compared pair by pair. Two sketches are told apart by the parities of their values in `BITS`
places: these differ in no more places than the sketches differ in values, so a pair that differs in more than its overlap
allows falls away, and no other. A first pass contracts copies: sketches are listed under two of these values at a time,
neighbours in the order of rarity, each member of a list meets the list's least one, and what full sets confirm is linked.
The second pass misses nothing: sketches are listed under every single value, and within a list all members of different
components meet, by parities, in their task. Of the pairs that are left a list gives a spanning forest, so a crowd yields
as many rows as it has members; lists of over `LONG` members meet in blocks. Documents that these forests connect are a
family, and families are compared as a whole, but for what is linked already.

Families of up to `BLOCK` members are compared in cells of about so many documents each. Of a larger one the members
outside of its largest component meet all blocks of the family, in cells of two blocks, which covers every pair of
different components. In a cell the overlap of sketches and then the similarity estimated on the union's sketch (kept
within 6 standard deviations of the threshold, half of the sketch; a pair at the threshold falls below with a probability
of 2e-8) filter the pairs, and full sets confirm them; pairs that the cell's links already connect are skipped. So a group
of copies yields about one link for each copy, texts travel once for a block and not once for a pair, and yet no
component is missed. No list, candidate or partner is dropped.

Defined results: a text without words (NULL, empty, blank) has an empty set, links with nothing and is kept. Fewer words
than a shingle holds are one shingle. Rows that repeat a doc_id are one document: they stay or go together, and a document
with several texts links by any of them. Rows with a NULL doc_id are not linked and are kept. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import all_of, small_batches, stored, table
from panelwright.llm.graph import components
from panelwright.llm.shingles import set_key, shingle_sets

K = 64
BLOCK = 128
#: Places of a sketch's parities.
BITS = 512
#: Counters of how often values occur.
COUNTERS = 1 << 20
#: Counters that travel to the driver in one row.
PACKED = 4096
#: Members of a list that meet at once.
LONG = 1024
#: Rows of lists in a group of lists.
LISTED = 20_000


def parities(sketch: np.ndarray) -> np.ndarray:
    """One bit for each of BITS residues, in longs: whether an odd number of values have it."""
    return np.packbits(np.bincount(sketch & (BITS - 1), minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def sketches(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, key, sketch): the set's size, a 128-bit name of the set, and its k least values in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(len(s), set_key(s) if len(s) else None, s[:k].copy()) for s in shingle_sets(batch["text"].tolist(), words)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": [r[0] for r in rows], "key": [r[1] for r in rows], "sketch": [r[2] for r in rows]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_shingles long, key binary, sketch array<long>")


def rarity(classes: DataFrame) -> np.ndarray:
    """How many retained values of all sketches fall into each of COUNTERS residues: a table of fixed size, whatever the documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(np.concatenate(batch["sketch"].tolist()) & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at.astype(np.int32), "n": total[at]})

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(PACKED, np.int64)
        counts[rows["at"].to_numpy() % PACKED] = rows["n"].to_numpy()
        return pd.DataFrame({"part": [int(rows["at"].iloc[0]) // PACKED], "counts": [counts.tobytes()]})

    sums = classes.select("sketch").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found = sums.groupBy(F.floor(F.col("at") / PACKED)).applyInPandas(packed, "part int, counts binary").collect()
    counts = np.zeros((COUNTERS // PACKED, PACKED), np.int64)
    for r in found:
        counts[r.part] = np.frombuffer(r["counts"], np.int64)
    return counts.reshape(-1)


def listed(classes: DataFrame, percent: int, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(rep, own): the values under which each sketch is listed, rarest first, that another sketch is listed under too; and (rep, n, m, needed, sign) of all sketches."""
    counts = classes.sparkSession.sparkContext.broadcast(rarity(classes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n, sketch in zip(batch["n"].tolist(), batch["sketch"].tolist(), strict=True):
                m = len(sketch)
                needed = -(-n * percent // 100) if n * 100 <= k * percent else m // 2
                often = counts.value[sketch & (COUNTERS - 1)]
                order = np.lexsort((sketch, often))[: m - needed + 1]
                out.append((m, needed, parities(sketch), sketch[order][often[order] > 1]))
            m, needed, sign, own = zip(*out, strict=True) if out else ((),) * 4
            yield pd.DataFrame({"rep": batch["rep"], "n": batch["n"], "m": m, "needed": needed, "sign": sign, "own": own})

    held = stored(classes.select("rep", "n", "sketch").mapInPandas(run, "rep long, n long, m long, needed long, sign array<long>, own array<long>"))
    each = held.select("rep", F.posexplode("own").alias("at", "value"))
    # Stored, so that both sides of the join are plain shuffles and a frequent value's rows can be split over tasks.
    shared = stored(each.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value"))
    own = each.join(shared, "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("own"))
    return stored(own.select("rep", F.transform("own", lambda x: x["value"]).alias("own"))), held.drop("own")


def under_neighbours(lists: DataFrame) -> DataFrame:
    """(key, rep): two neighbouring values at a time; a single value where there is no second one."""
    pairs = F.zip_with(F.slice("own", F.lit(1), F.size("own") - 1), F.slice("own", F.lit(2), F.size("own") - 1), lambda x, y: F.xxhash64(x, y))
    keys = F.when(F.size("own") > 1, pairs).otherwise(F.transform("own", lambda x: F.xxhash64(x)))
    return lists.select("rep", F.explode(keys).alias("key"))


def copies(lists: DataFrame, signs: DataFrame, docs: DataFrame, words: int, percent: int, k: int = K) -> DataFrame:
    """(a, b): confirmed links between members of lists under neighbours and the least member of each."""
    keyed = under_neighbours(lists)
    least = stored(keyed.groupBy("key").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "least"))
    pairs = keyed.join(least, "key").where("rep <> least").select("rep", "least").distinct()
    other = signs.select(*(F.col(c).alias({"rep": "least"}.get(c, f"{c}_")) for c in signs.columns))
    apart = F.aggregate(F.zip_with("sign", "sign_", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    alike = (F.least("n", "n_") * 100 >= F.greatest("n", "n_") * percent) & (apart <= F.col("m") + F.col("m_") - 2 * F.greatest("needed", "needed_"))
    pairs = stored(pairs.join(signs, "rep").join(other, "least").where(alike).select("rep", "least"))
    # The lists of a few members share cells; a long one has cells of its own, which all hold its least member.
    cells = max(1, -(-pairs.count() // BLOCK))
    sizes = pairs.groupBy("least").agg(_blocks_of(F.count(F.lit(1))).alias("blocks"))
    cell = F.when(F.col("blocks") == 1, F.struct(F.lit(-1).cast("long").alias("f"), F.pmod(F.xxhash64("least"), F.lit(cells)).cast("int").alias("b"))).otherwise(F.struct(F.col("least").alias("f"), F.col("b"))).alias("cell")
    members = pairs.join(sizes, "least").withColumn("b", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).select(cell, "rep", F.lit(1).alias("side"))
    heads = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(cell, F.col("least").alias("rep"), F.lit(0).alias("side"))
    # Stored, so that Spark knows its size: texts are shuffled for a large one only.
    rows = stored(members.unionByName(heads).distinct())
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(rows.select("rep"), "rep", "left_semi"))
    return stored(_met(rows.withColumn("label", F.col("rep")), texts, words, percent, k))


def forest(key: np.ndarray, rep: np.ndarray, label: np.ndarray, n: np.ndarray, m: np.ndarray, needed: np.ndarray, side: np.ndarray, bits: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that span, in each list, the pairs of different labels whose parities leave them their overlap; rows stand in order of their list."""
    left, right, d = [], [], 1
    last = np.searchsorted(key, key, side="right")
    live = np.arange(len(key))
    while len(live := live[live + d < last[live]]):
        i, j = live, live + d
        some = (label[i] != label[j]) & ((side[i] != side[j]) | (side[i] == 2)) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
        i, j = i[some], j[some]
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        some = apart <= m[i] + m[j] - 2 * np.maximum(needed[i], needed[j])
        left.append(i[some])
        right.append(j[some])
        d += 1
    if not left:
        return []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    # Rows are nodes, so that lists stay apart: a pair that meets in one list need not in another.
    for i, j in zip(np.concatenate(left).tolist(), np.concatenate(right).tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((int(rep[i]), int(rep[j])))
    return out


def meetings(lists: DataFrame, signs: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): forests of all lists under single values, between different labels(node, component)."""
    named = lists.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "own", F.coalesce("component", "rep").alias("label"))
    rows = named.select("rep", "label", F.explode("own").alias("value"))
    open_ = stored(rows.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members")).where("low < high").select("value", "members"))
    blocks = F.ceil(F.col("members") / LONG).cast("int")
    at = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    met = rows.join(open_, "value").withColumns({"blocks": blocks, "at": at}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.when(F.col("blocks") == 1, F.col("value")).otherwise(F.xxhash64("value", F.least("at", "other"), F.greatest("at", "other")))
    side = F.when(F.col("at") == F.col("other"), 2).otherwise((F.col("at") > F.col("other")).cast("int"))
    met = stored(met.select("rep", "label", key.alias("list"), side.alias("side")))
    cells = max(1, -(-met.count() // LISTED))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["list", "rep"])
        bits = np.stack(rows["sign"].to_numpy()).view(np.uint64)
        columns = (rows[c].to_numpy() for c in ("list", "rep", "label", "n", "m", "needed", "side"))
        return pd.DataFrame(starred(forest(*columns, bits, percent)), columns=["a", "b"])

    return met.join(signs, "rep").groupBy(F.pmod(F.xxhash64("list"), F.lit(cells)).alias("cell")).applyInPandas(run, "a long, b long")


def cell_links(ids: list[int], sides: list[int], labels: list[int], sets: list[np.ndarray], percent: int, k: int = K) -> list[tuple[int, int]]:
    """Links that connect what is similar in a cell: pairs of side 0 and side 1, or all pairs of side 2; equal labels are connected already."""
    root = {x: x for x in labels}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    tops = [s[:k] for s in sets]
    values, column = np.unique(np.concatenate(tops), return_inverse=True)
    held = np.zeros((len(sets), len(values)), np.float32)
    held[np.repeat(np.arange(len(sets)), [len(x) for x in tops]), column] = 1
    overlap = held @ held.T
    t = percent / 100
    slack = 6 * (t * (1 - t) / k) ** 0.5
    n_all, m_all, side, label = np.array([len(x) for x in sets]), np.array([len(x) for x in tops]), np.array(sides), np.array(labels)
    # A sketch of a whole small set holds all that is shared; of a larger one half is shared, as for the lists.
    needed = np.where(n_all * 100 <= k * percent, -(-n_all * percent // 100), m_all // 2)
    both_sizes = np.minimum.outer(n_all, n_all) * 100 >= np.maximum.outer(n_all, n_all) * percent
    may = (overlap >= np.maximum(1, np.maximum.outer(needed, needed))) & both_sizes & (np.not_equal.outer(side, side) | (side == 2)[:, None]) & np.not_equal.outer(label, label)
    out = []
    for i, j in zip(*np.nonzero(np.triu(may, 1)), strict=True):
        n, m = len(sets[i]), len(sets[j])
        a, b = find(labels[i]), find(labels[j])
        if ids[i] == ids[j] or a == b:
            continue
        if n > k or m > k:
            union = np.union1d(tops[i], tops[j])[:k]
            both = np.intersect1d(tops[i], tops[j], assume_unique=True)
            if np.searchsorted(both, union[-1], side="right") < (t - slack) * len(union):
                continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if both * 100 >= (n + m - both) * percent:
            root[b] = a
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return starred(out)


def starred(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same components, every node linked to the least of its own."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [(find(x), x) for x in root if find(x) != x]


def _met(cells: DataFrame, texts: DataFrame, words: int, percent: int, k: int) -> DataFrame:
    """The links of all cells(cell, rep, side, label)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = list(shingle_sets(rows["text"].tolist(), words))
        return pd.DataFrame(cell_links(rows["rep"].tolist(), rows["side"].tolist(), rows["label"].tolist(), sets, percent, k), columns=["a", "b"])

    return cells.join(texts, "rep").groupBy("cell").applyInPandas(run, "a long, b long")


def joined_within(found: DataFrame, labels: DataFrame, docs: DataFrame, words: int, percent: int, k: int = K) -> DataFrame:
    """(node, component): labels(node, component), joined further by all that is similar within families found(rep, family)."""
    named = found.join(labels.withColumnsRenamed({"node": "rep", "component": "label"}), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    main = named.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("most"))
    members = stored(named.join(main, "family"))
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members.select("rep"), "rep", "left_semi"))
    small, large = members.where(f"size <= {BLOCK}"), members.where(f"size > {BLOCK}").withColumn("parts", _blocks_of(F.col("size") - F.col("most")))
    cells = max(1, -(-small.count() // BLOCK))
    shared = small.select(F.struct(F.lit(-1).cast("long").alias("f"), F.lit(0).alias("u"), F.pmod(F.xxhash64("family"), F.lit(cells)).cast("int").alias("b")).alias("cell"), "rep", F.lit(2).alias("side"), "label")
    blocks, block = _blocks_of(F.col("size")), F.pmod(F.xxhash64("rep"), _blocks_of(F.col("size"))).cast("int")
    at = lambda u, b: F.struct(F.col("family").alias("f"), u.alias("u"), b.alias("b")).alias("cell")
    rest = large.where("label <> main").withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.select(at(F.pmod(F.xxhash64(F.lit("part"), "rep"), F.col("parts")).cast("int"), F.col("b")), "rep", F.lit(0).alias("side"), "label")
    every = large.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(at(F.col("u"), block), "rep", F.lit(1).alias("side"), "label")
    links = stored(_met(shared.unionByName(rest).unionByName(every), texts, words, percent, k))
    return labels if links.isEmpty() else components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def linked(classes: DataFrame, docs: DataFrame, words: int, percent: int, k: int = K) -> DataFrame:
    """(node, component) of all representatives that are similar to another one."""
    lists, signs = listed(classes, percent, k)
    labels = components(copies(lists, signs, docs, words, percent, k))
    met = stored(meetings(lists, signs, labels, percent))
    if met.isEmpty():
        return labels
    found = components(met).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    return joined_within(found, labels, docs, words, percent, k)


def _blocks_of(count):
    return F.ceil(count / BLOCK).cast("int")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    rows = stored(sketches(docs, words, k))
    linkable = rows.where("key is not null and doc_id is not null")
    classes = stored(linkable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    found = linked(classes, docs, words, percent, k)
    of_class = classes.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    result = rows.drop("sketch").join(of_class, "key", "left")
    if not rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        # A repeated id may stand in several classes: they are one document.
        same = result.groupBy("doc_id").agg(F.min("component_id").alias("least"))
        result = result.join(same, "doc_id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with 0.8 of their five-word shingles in common, the one with the least id."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*all_of(docs.columns))
