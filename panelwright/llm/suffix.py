"""Removal of repeated byte strings by suffix sorting (operator 10).

Every byte covered by a string of `LENGTH` bytes that also starts anywhere else is removed. A suffix array of all text
would not fit into any task, so the work is first dealt out: a string of LENGTH bytes names an anchor, the leftmost least
hash of its GRAM-byte parts, and equal strings have equal anchors at equal places. The starts of one text that share an
anchor are neighbours and form a fragment of less than 2 * LENGTH bytes. Equal strings therefore meet among the fragments
of one anchor, and

* an anchor that occurs once has nothing that repeats;
* equal fragments (by anchor and 64-bit hash) repeat as a whole, and one of them stands for all in what follows;
* the starts of the different fragments of an anchor are taken in ranges, and the strings of a range have most of their
  bytes in common, their core. Where no core occurs twice, none of the anchor's strings repeats. The fragments of all
  other anchors are sorted by suffixes, whole anchors together, up to about a MB at a time. The sort has two stages:
  suffixes smaller than their successors are sorted directly, all others are induced by a scan of the buckets of first
  bytes. Common prefixes of neighbours then tell which strings start twice;
* an anchor with over `MANY` different fragments would make one task large, so its ranges are taken apart by their cores,
  and those of a core are sorted together. A core that over `MANY` fragments share is divided again: first by what holds
  all strings of the range (where that occurs twice, all of them repeat), then into narrower ranges, in `STEPS` down to
  single starts, whose core is the string itself, so that nothing is left to sort.

Counts are combined before they are shuffled and no list is kept for an anchor, so a passage held by a third of all
documents costs each task no more than others.

Defined results: a NULL or empty text has no bytes and nothing is removed; texts are taken as UTF-8; repeated rows are
texts of their own, so each loses what it shares with the other; rows with a NULL doc_id take part; other columns are
not used; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import discard, runs, stored, table
from panelwright.llm.shingles import _power, mix

LENGTH, GRAM = 200, 16
MANY = 1000
#: Bytes of a text that are taken at once, and of fragments that are sorted together.
PART, SORTED = 1 << 20, 1 << 19
#: Starts in a range of a crowded anchor's strings; each divides the one before it.
STEPS = (30, 5, 1)
_VALUES = np.random.default_rng(10).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
KEYS = ["_id", "_hash"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with a row's keys, never NULL; equal rows have equal keys."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("_id"), F.xxhash64(text).alias("_hash"))


def least_places(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of its leftmost least value (by its upper 42 bits)."""
    n = len(grams)
    packed = (grams & ~np.uint64(0x3FFFFF)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = packed
    square = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(square, axis=1).reshape(-1)
    return (np.minimum(ahead[: n - width + 1], behind[width - 1 : n]) & np.uint64(0x3FFFFF)).astype(np.int64)


def fragments(data: np.ndarray, owner_ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of texts joined in `data`, each ending at owner_ends: (anchor, fragment hash, first start, last start, anchor's place) of all fragments."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 5
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * _power("up", n), out=sums[1:])
    down = _power("down", n + 1)
    gram = min(GRAM, length)
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    place = least_places(grams, length - gram + 1)
    starts = np.concatenate([[0], owner_ends[:-1]])
    room = np.maximum(owner_ends - starts - length + 1, 0)
    fits = np.repeat(starts - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
    if not len(fits):
        return (np.zeros(0, np.int64),) * 5
    place = place[fits]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (fits[1:] != fits[:-1] + 1)])
    first = fits[new]
    last = fits[np.concatenate([new[1:], [True]])]
    anchor = place[new]
    size = (last + length - first).astype(np.uint64)
    whole = mix((sums[last + length] - sums[first]) * down[first] + size * np.uint64(0x9FB21C651E98DF25) + (anchor - first).astype(np.uint64))
    return grams[anchor].view(np.int64), whole.view(np.int64), first, last, anchor


def anchors(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_id, _hash, anchor, fragment, lo, hi, place) of all fragments of all texts: first and last start, and the anchor's place after the first."""

    def of_parts(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        ends = np.cumsum([len(p[2]) for p in parts])
        anchor, fragment, lo, hi, place = fragments(np.frombuffer(b"".join(p[2] for p in parts), np.uint8), ends, length)
        part = np.searchsorted(ends, lo, side="right")
        shift = np.array([p[1] for p in parts]) - np.concatenate([[0], ends[:-1]])
        return np.array([p[0] for p in parts])[part], anchor, fragment, lo + shift[part], hi + shift[part], place - lo

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids, hashes = batch["text"].tolist(), batch["_id"].to_numpy(), batch["_hash"].to_numpy()
            for a, b in runs(texts, PART):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts[a:b]]
                # A text of over PART bytes goes in parts whose starts follow on each other.
                parts = [(a + i, at, r[at : at + PART + length - 1]) for i, r in enumerate(raw) for at in range(0, max(1, len(r) - length + 1), PART)]
                for x, y in runs([p[2] for p in parts], 2 * PART):
                    row, anchor, fragment, lo, hi, place = of_parts(parts[x:y])
                    yield pd.DataFrame({"_id": ids[row], "_hash": hashes[row], "anchor": anchor, "fragment": fragment, "lo": lo, "hi": hi, "place": place})

    return rows.select(*KEYS, "text").mapInPandas(run, "_id long, _hash long, anchor long, fragment long, lo long, hi long, place int")


def suffix_order(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes of bytes in the order of their first `depth` bytes at least, by two-stage sorting."""
    n = len(data)
    wide = np.concatenate([data.astype(np.int64) + 1, np.zeros(1, np.int64)])  # the end is less than any byte
    ends = np.flatnonzero(wide[1:] != wide[:-1]) + 1
    follows = wide[ends[np.searchsorted(ends, np.arange(n), side="right")]]  # the first other value after each place
    smaller = follows > wide[:n]  # than its successor

    # First stage: direct sorting of those, eight bytes after eight.
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    words = np.zeros(n + depth + 8, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + len(words)]
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(words[direct], kind="stable")]
    group = np.cumsum(np.concatenate([[0], words[direct][1:] != words[direct][:-1]])) if len(direct) else direct
    for step in range(8, depth, 8):
        tied = np.zeros(len(direct), bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        word = words[np.minimum(direct[at] + step, len(words) - 1)]
        order = np.lexsort((word, group[at]))
        direct[at] = direct[at[order]]
        word = word[order]
        split = np.zeros(len(direct), np.int64)
        split[at[1:]] = (group[at[1:]] == group[at[:-1]]) & (word[1:] != word[:-1])
        group = group + np.cumsum(split)

    # Second stage: bucket by bucket of first bytes, the larger ones in the order of their successors, then the smaller ones.
    rank = np.full(n + 1, -1, np.int64)
    rank[n] = 0
    larger = np.flatnonzero(~smaller)
    from_below = larger[wide[larger + 1] < wide[larger]]
    by_byte = lambda places: np.split(places, np.searchsorted(wide[places], np.arange(2, 257)))
    below, straight = by_byte(from_below[np.argsort(wide[from_below], kind="stable")]), by_byte(direct)
    out, done = [], 1
    for byte in range(256):
        layer = below[byte]
        layer = layer[np.argsort(rank[layer + 1], kind="stable")]
        while len(layer):
            rank[layer] = np.arange(done, done + len(layer))
            done += len(layer)
            out.append(layer)
            before = layer[layer > 0] - 1
            layer = before[wide[before] == byte + 1]  # in a run of one byte the suffix before is larger still
        rank[straight[byte]] = np.arange(done, done + len(straight[byte]))
        done += len(straight[byte])
        out.append(straight[byte])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part the places at which a string of `length` bytes starts that also starts elsewhere in the parts."""
    data = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)  # no UTF-8 text holds this byte, so nothing crosses a seam
    order = suffix_order(data, length)
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    room = np.zeros(len(data), bool)
    for i, p in enumerate(parts):
        room[starts[i] : starts[i] + max(0, len(p) - length + 1)] = True
    order = order[room[order]]
    left, right = order[:-1], order[1:]
    same = np.ones(len(left), bool)
    for at in range(length):  # common prefixes of neighbours, as far as they matter
        live = np.flatnonzero(same)
        if not len(live):
            break
        same[live] = data[left[live] + at] == data[right[live] + at]
    hit = np.zeros(len(data), bool)
    hit[left[same]] = True
    hit[right[same]] = True
    return [np.flatnonzero(hit[starts[i] : starts[i + 1]]) for i in range(len(parts))]


def spans_of(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Covered bytes of sorted starts, as (start, end)."""
    if not len(starts):
        return []
    new = np.concatenate([[True], np.diff(starts) > length])
    return list(zip(starts[new].tolist(), (starts[np.concatenate([new[1:], [True]])] + length).tolist(), strict=True))


def _sorted_spans(cut: DataFrame, length: int) -> DataFrame:
    """(_id, _hash, start, end) of what repeats among the different fragments of each anchor; alone: those to report."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        hits = repeated_starts(rows["bytes"].tolist(), length)
        out = [(i, h, lo + a, lo + b) for i, h, lo, alone, starts in zip(rows["_id"], rows["_hash"], rows["lo"], rows["alone"], hits, strict=True) if alone for a, b in spans_of(starts, length)]
        return pd.DataFrame(out, columns=["_id", "_hash", "start", "end"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            weights, names = batch["bytes"].map(len).to_numpy(), batch["anchor"].to_numpy()
            at = 0
            for stop in np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])):
                # Between two anchors only: what is held goes once it is large enough.
                size += int(weights[at:stop].sum())
                if size >= SORTED and (stop or (held and held[-1]["anchor"].iloc[-1] != names[0])):
                    yield found(pd.concat([*held, batch.iloc[at:stop]]))
                    held, size = [], 0
                elif stop > at:
                    held.append(batch.iloc[at:stop])
                at = stop
            held.append(batch.iloc[at:])
            size += int(weights[at:].sum())
        if held:
            yield found(pd.concat(held))

    dealt = cut.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInPandas(run, "_id long, _hash long, start long, end long")


def _ranges(cut: DataFrame, length: int, step: int, wide: int) -> DataFrame:
    """cut with `within`, the ranges of `step` starts that a fragment has in its range of `wide` starts, and each one's core.

    first and last are the fragment's starts, counted from the first one that an anchor can be reached from.
    """
    inside = F.sequence(F.greatest("first", F.col("range") * wide), F.least("last", F.col("range") * wide + wide - 1))
    ranges = F.array_distinct(F.transform(inside, lambda s: F.floor(s / step).cast("int")))
    core = lambda r: F.xxhash64(F.lit(1), F.substr(F.col("bytes"), r * step + step - F.col("first"), F.lit(length - step + 1)))
    return cut.withColumn("within", F.transform(ranges, lambda r: F.struct(r.alias("range"), core(r).alias("core"))))


def _with_starts(pieces: DataFrame, length: int) -> DataFrame:
    reach = length - min(GRAM, length)  # an anchor lies so many bytes after a start at most
    return pieces.withColumns({"first": reach - F.col("place"), "last": reach - F.col("place") + F.octet_length("bytes") - length, "range": F.lit(0)})


def _sharing(pieces: DataFrame, length: int) -> DataFrame:
    """(anchor): anchors of which some range's core occurs in two different fragments."""
    ranged = _ranges(_with_starts(pieces, length), length, STEPS[0], length)
    each = ranged.select("anchor", F.explode("within").alias("w")).groupBy("anchor", "w.range", "w.core").agg(F.count(F.lit(1)).alias("n"))
    return each.where("n > 1").select("anchor").distinct()


def _divided(cut: DataFrame, length: int, many: int) -> tuple[DataFrame, DataFrame]:
    """Of anchors with very many fragments: spans told from counts alone, and the pieces to be sorted, under names of their own as anchors."""
    spark = cut.sparkSession
    spans = spark.createDataFrame([], "_id long, _hash long, start long, end long")
    parts = spark.createDataFrame([], "_id long, _hash long, anchor long, lo long, place int, alone boolean, crowded boolean, bytes binary")
    live, wide = _with_starts(cut, length), length
    for step in STEPS:
        if live.isEmpty():
            break
        each = _ranges(live, length, step, wide).select(*cut.columns, "first", "last", F.explode("within").alias("w")).select(*cut.columns, "first", "last", "w.*")
        # Places in the fragment's bytes of the range's first and last start.
        low, high = F.col("range") * step - F.col("first"), F.col("range") * step + step - 1 - F.col("first")
        whole = (low >= 0) & (high + length <= F.octet_length("bytes"))
        each = stored(each.withColumn("hull", F.when(whole, F.xxhash64(F.lit(2), F.substr("bytes", low + 1, F.lit(length + step - 1))))))
        sizes = each.groupBy("anchor", "range", "core").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        told = stored(each.join(sizes, ["anchor", "range", "core"]))
        discard(each)
        if step > 1:
            a, b = F.greatest(low, F.lit(0)), F.least(high, F.octet_length("bytes") - length)
            few = told.where(F.col("n") <= many).select(
                *KEYS, F.xxhash64("anchor", "range", "core").alias("anchor"), (F.col("lo") + a).alias("lo"), "place", "alone", "crowded", F.substr("bytes", a + 1, b - a + length).alias("bytes")
            )
            parts = parts.unionByName(few)
            told = told.where(F.col("n") > many)
            # The core that very many fragments share may have all its strings from end to end in common as well.
            again = told.where("hull is not null").groupBy("anchor", "range", "core", "hull").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("anchor", "range", "core", "hull", F.lit(True).alias("all"))
            told = told.join(again, ["anchor", "range", "core", "hull"], "left").withColumn("all", F.coalesce("all", F.lit(False)))
        else:
            told = told.withColumn("all", F.lit(True))
        start = F.col("lo") + F.col("range") * step - F.col("first")
        found = told.where("all and alone").select(*KEYS, start.alias("start"), (start + (step - 1 + length)).alias("end"))
        spans = spans.unionByName(found)
        live, wide = told.where("not all").select(*cut.columns, "first", "last", "range"), step
    return spans, parts


def repeated_spans(rows: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """(_id, _hash, start, end) of bytes of keyed rows that repeated strings cover; spans may overlap."""
    every = stored(anchors(rows, length))
    seen = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("fragment").alias("x"), F.max("fragment").alias("y"))
    # Stored, so that both sides of the join are plain shuffles and a frequent anchor's rows can be split over tasks.
    again = stored(seen.where("n > 1").select("anchor", (F.col("x") != F.col("y")).alias("mixed")))
    met = stored(every.join(again, "anchor"))
    discard(every, again)
    whole = lambda df: df.select(*KEYS, F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    alike = whole(met.where("not mixed"))
    one = F.min(F.struct(*KEYS, "lo", "hi", "place")).alias("one")
    kinds = stored(met.where("mixed").groupBy("anchor", "fragment").agg(F.count(F.lit(1)).alias("n"), one))
    copies = kinds.where("n > 1").select("anchor", "fragment")
    copied = whole(met.where("mixed").join(copies, ["anchor", "fragment"], "left_semi"))
    crowded = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > many).select("anchor", F.lit(True).alias("crowded"))
    asked = kinds.join(crowded, "anchor", "left").select("one.*", "anchor", (F.col("n") == 1).alias("alone"), F.coalesce("crowded", F.lit(False)).alias("crowded"))
    asked = asked.groupBy(*KEYS).agg(F.collect_list(F.struct("anchor", "lo", "hi", "place", "alone", "crowded")).alias("asked"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                out = []
                for i, h, text, wanted in batch.iloc[a : a + 256][[*KEYS, "text", "asked"]].itertuples(index=False):
                    raw = text.encode("utf-8", "surrogatepass")
                    out += [(i, h, w["anchor"], w["lo"], w["place"], w["alone"], w["crowded"], raw[w["lo"] : w["hi"] + length]) for w in wanted]
                yield pd.DataFrame(out, columns=["_id", "_hash", "anchor", "lo", "place", "alone", "crowded", "bytes"])

    # Equal rows give the same fragment; one of them is enough.
    texts = rows.select(*KEYS, "text").join(asked, KEYS)
    pieces = stored(texts.mapInPandas(cut, "_id long, _hash long, anchor long, lo long, place int, alone boolean, crowded boolean, bytes binary"))
    # Stored, so that both sides of the join are plain shuffles.
    sharing = stored(_sharing(pieces, length))
    live = pieces.join(sharing, "anchor", "left_semi")
    told, parts = _divided(live.where("crowded"), length, many)
    apart = _sorted_spans(live.where("not crowded").unionByName(parts), length)
    return alike.unionByName(copied).unionByName(told).unionByName(apart)


def without_repeats(docs: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row."""
    rows = keyed(docs)
    spans = repeated_spans(rows, length, many).groupBy(*KEYS).agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, spans, strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            kept, at, n = [], 0, 0
            for start, end in sorted((s["start"], s["end"]) for s in (found if found is not None else ())):
                if start > at or not n:
                    kept.append(raw[at:start])
                    n += 1
                at = max(at, end)
            kept = b"".join([*kept, raw[at:]])
            out.append((len(raw), len(raw) - len(kept), n, kept))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    done = rows.join(spans, KEYS, "left").select("doc_id", cut("text", "spans").alias("r"))
    return done.select("doc_id", "r.*")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
