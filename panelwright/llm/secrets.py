"""Secret scanning through a trigram inverted index (operator 9). DataFrame functions only.

From every rule's regular expression a Boolean trigram query is derived: AND over what must follow in sequence, OR over
alternatives, with the literal strings of short sequences joined before trigrams are taken. The index has a posting
(trigram, doc_id) for each trigram that some rule needs and each lower-cased text that holds it; a rule's candidates are
the documents whose postings fulfil its query, and only they are verified with the regular expression. A rule without
mandatory trigrams (a run of hex digits) is verified on every text.

Spans are in code points, end exclusive. Matches are leftmost and do not overlap within a kind; those that fail the
length test of a rule are dropped after matching, as the rule says. Every pattern takes time in proportion to the text
and no pattern repeats a group, so no length of text is too long for it.

Defined results: NULL and empty texts have no spans; repeated rows are each scanned, and a candidate id makes every row
of that id a candidate; rows with a NULL doc_id are verified for all rules, since postings cannot name them; an empty
table gives an empty table; other columns are not used.
"""

from __future__ import annotations

import itertools
import re._constants as kinds
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import table

#: Literal alternatives kept apart for one sequence; beyond it the sequence is cut and its parts are ANDed.
MOST_STRINGS = 64
#: Matches in a block of running sums.
CHUNK = 128


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters that `group` has at least, tested after matching
    group: int = 0
    ignore_case: bool = False
    base: bool = False

    @property
    def java(self) -> str:
        return f"(?i:{self.pattern})" if self.ignore_case else self.pattern


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, False, True),
    # Greedy runs are maximal, so a length test after matching equals a bound within the pattern.
    Rule("hex", r"[0-9a-f]{16,}", 16, 0, False, True),
    # Repeated parts are single classes: Java's matcher recurses on repeated groups, and a long text would overflow its stack.
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # Only the start of a run is tried, so that a long run is scanned once.
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The query in disjunctive form: a text can match only if it holds all (lower-case) trigrams of one of the sets.

    [frozenset()] means that the pattern has no mandatory trigram.
    """

    def ways(parsed) -> set[tuple[frozenset[str], str, bool]]:
        """Alternatives of a sequence: trigrams found so far, the literal text open at its end, whether its start is cut off from that text."""
        found = {(frozenset(), "", False)}
        for op, value in parsed:
            if op is kinds.LITERAL:
                more = {(frozenset(), chr(value).lower(), False)}
            elif op is kinds.IN and len(value) <= 8 and all(k is kinds.LITERAL for k, _ in value):
                more = {(frozenset(), chr(c).lower(), False) for _, c in value}
            elif op is kinds.SUBPATTERN:
                more = ways(value[3])
            elif op is kinds.BRANCH:
                more = set().union(*map(ways, value[1]))
            elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and tuple(value[:2]) == (0, 1):
                more = {(frozenset(), "", False), *ways(value[2])}
            elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] >= 1:
                more = {(have | trigrams(tail), "", True) for have, tail, _ in ways(value[2])}
            else:
                more = {(frozenset(), "", True)}
            found = {(a | b | trigrams(x), y, True) if cut else (a | b, x + y, was) for a, x, was in found for b, y, cut in more}
            if len(found) > MOST_STRINGS:
                found = {(frozenset.intersection(*(have | trigrams(tail) for have, tail, _ in found)), "", True)}
        return found

    sets = {have | trigrams(tail) for have, tail, _ in ways(parser.parse(pattern))}
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(trigram, doc_id), for the wanted trigrams that a text holds."""
    lowered = docs.select("doc_id", F.lower("text").alias("_low"))
    held = F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in wanted)))
    return lowered.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): the kinds whose trigram query a document's postings fulfil."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    wanted = sorted(set().union(*itertools.chain.from_iterable(queries.values())))
    found = postings(docs.where(F.col("doc_id").isNotNull()), wanted).groupBy("doc_id").agg(F.collect_set("trigram").alias("_held"))
    met = [
        F.when(F.exists(F.array(*(F.array(*map(F.lit, sorted(s))) for s in sets)), lambda s: F.size(F.array_except(s, "_held")) == 0), F.lit(kind))
        for kind, sets in queries.items()
    ]
    return found.select("doc_id", F.array_compact(F.array(*met)).alias("rules")).where(F.size("rules") > 0)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(steps: Column) -> Column:
    """(start, end, ok) of each step (gap, n, ok): running sums, which are kept by blocks so that appending copies little."""
    width = lambda s, x: s + x["gap"] + x["n"]
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda b: F.slice(steps, b * CHUNK + 1, F.lit(CHUNK)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    offsets = lambda parts: F.aggregate(
        F.transform(parts, lambda part: F.aggregate(part, F.lit(0), width)),
        begin,
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")),
        lambda s: s["out"],
    )

    def inside(part: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int,ok:boolean>>").alias("found"))
        one = lambda s, x: F.struct((s["at"] + x["gap"]).alias("start"), width(s["at"], x).alias("end"), x["ok"].alias("ok"))
        return F.aggregate(part, zero, lambda s, x: F.struct(width(s["at"], x).alias("at"), F.array_append(s["found"], one(s, x)).alias("found")), lambda s: s["found"])

    every = _let(blocks, lambda parts: F.flatten(F.zip_with(parts, offsets(parts), inside)))
    return F.when(F.size(steps) > 0, every).otherwise(F.array().cast("array<struct<start:int,end:int,ok:boolean>>"))


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of a rule's matches, from the lengths of the matches and of what lies between them."""
    matches = F.regexp_extract_all(text, F.lit(f"({rule.java})"), F.lit(1))
    between = F.split(text, rule.java, -1)
    if rule.group:
        values = F.regexp_extract_all(text, F.lit(f"({rule.java})"), F.lit(rule.group + 1))
        checked = F.zip_with(matches, values, lambda m, v: F.struct(F.char_length(m).alias("n"), (F.char_length(v) >= rule.least).alias("ok")))
    else:
        checked = F.transform(matches, lambda m: F.struct(F.char_length(m).alias("n"), (F.char_length(m) >= rule.least).alias("ok")))
    steps = F.zip_with(between, checked, lambda b, m: F.struct(F.char_length(b).alias("gap"), m["n"].alias("n"), m["ok"].alias("ok")))
    placed = _let(F.filter(steps, lambda s: s["n"].isNotNull()), _placed)
    return F.transform(F.filter(placed, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and one array of (start, end) for each rule, named by its kind."""
    indexed = tuple(r for r in rules if trigram_query(r.pattern) != [frozenset()])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if indexed:
        rows = rows.join(candidates(rows, indexed), "doc_id", "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    columns = []
    for r in rules:
        checked = spans(F.col("text"), r)
        if r in indexed:
            checked = F.when(F.array_contains("rules", r.kind) | F.col("doc_id").isNull(), checked).otherwise(none)
        columns.append(checked.alias(r.kind))
    return rows.select("doc_id", *columns)


def listed(rules: tuple[Rule, ...]) -> Column:
    """kind:start:end by start, then kind in the order of the rules, comma-joined."""

    def ranked(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    each = [ranked(i, r.kind) for i, r in enumerate(rules)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = tuple(r for r in RULES if r.base)
    count = lambda kind: F.size(kind).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in base), F.sha2(listed(base), 256).alias("base_sha256"), listed(RULES).alias("spans"))
