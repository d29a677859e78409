import itertools
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from panelwright.llm import urlrules as ur


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest, re.S)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in ur.FIXED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [None, "", "nothing", "http://", "HTTP://Example.COM/en/1?x=://b/c#d", "https://www.example.com/en/", "https://www.example.com/fr/1", "http://a.net/es/", "http://net/fr/x", "http://b.net/es", "http://com", "http://com/", "http://xcom/", "http://b.org?u=http://c.com/", "http://h\n.org/p\nq?r", "ftp://ÄB.org/é/123/é#x?y", "http://www.example.com/en/", "http://www.example.com/en/"]


def test_fixed_rules(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    none = spark.createDataFrame([], ur.RULES)
    got = {r.page_id: r for r in ur.judge(rows, none).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u
    assert ur.judge(rows.limit(0), none).count() == 0


def test_mined_rules_match_by_whole_combinations(spark):
    urls = [f"http://s{i % 7}.bad-shop.org/{'buy' if i % 2 else 'read'}/{i}?ref=z" for i in range(120)] + [f"http://good{i % 5}.org/{'buy' if i % 3 else 'read'}/{i}" for i in range(120)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 120 and i % 2 else 1, 0) for i in range(0, 240)] + [(5, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rules = ur.mine(pages, labels)
    kept = {(frozenset(x), r.confidence) for r in rules.collect() for x in itertools.product(*r["items"])}
    baskets = {r.page_id: set(r.t) for r in pages.select("page_id", ur.tokens(F.col("url")).alias("t")).collect()}
    quality = {i: 0 if i < 120 and i % 2 and i != 7 else 1 for i in range(240)} | {7: 0}
    assert kept == plain_rules([(baskets[i], q == 0) for i, q in quality.items()])
    got = {r.page_id: r.verdict for r in ur.judge(pages, rules).collect()}
    assert got == {i: "block" if any(items <= b for items, _ in kept) else "allow" for i, b in baskets.items()}
    assert {i for i, v in got.items() if v == "block"} == {i for i in range(120) if i % 2}


def plain_rules(baskets):
    """All rules of enough support and confidence that no rule on fewer of their tokens equals, from all combinations of tokens."""
    held, bad = Counter(), Counter()
    for items, blocked in baskets:
        for n in range(1, len(items) + 1):
            for part in itertools.combinations(sorted(items), n):
                held[part] += 1
                bad[part] += blocked
    least = max(ur.LEAST, math.ceil(ur.SUPPORT * len(baskets)))
    odds = {k: bad[k] / held[k] for k in held if bad[k] >= least}
    best = {}
    for k in sorted(odds, key=len):
        best[k] = max((max(odds[p], best[p]) for p in itertools.combinations(k, len(k) - 1) if p), default=-1.0)
    return {(frozenset(k), c) for k, c in odds.items() if c >= ur.CONFIDENCE and c > best[k]}


def test_all_rules_of_random_pages(spark):
    rng = random.Random(3)
    urls = [f"http://{rng.choice('ab')}.h{rng.randint(1, 4)}.org/{rng.choice('xyz')}/{rng.choice('uv')}?{rng.choice('kl')}=1&m" for _ in range(300)]
    bad = [("/x/" in u and ("?k" in u or rng.random() < 0.5)) or ("h1" in u and rng.random() < 0.7) for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad)], "doc_id long, quality int")
    rules = ur.mine(pages, labels)
    kept = {(frozenset(x), r.confidence) for r in rules.collect() for x in itertools.product(*r["items"])}
    baskets = {r.page_id: set(r.t) for r in pages.select("page_id", ur.tokens(F.col("url")).alias("t")).collect()}
    assert kept == plain_rules([(baskets[i], b) for i, b in enumerate(bad)]) and len(kept) > 5
    more = pages.union(spark.createDataFrame([(900, "nothing?k=1&m"), (901, None), (902, "http://h1.org/x"), (903, "http://h1.org/x")], pages.schema)).withColumns({"url_": F.lit(1), "rule": F.lit(1), "token": F.lit("t"), "verdict": F.lit(2)})
    got = {(r.page_id, r.verdict) for r in ur.judge(more, rules).collect()}
    assert {(900, "allow"), (901, "allow")} <= got and len(got) == 304
    tokens = {r.page_id: set(r.t) for r in more.select("page_id", ur.tokens(F.col("url")).alias("t")).collect()}
    assert got == {(i, "block" if any(items <= b for items, _ in kept) else "allow") for i, b in tokens.items()} and not tokens[900]


def test_query_and_nothing_to_mine(spark):
    rows = ur.op7_url_rules(spark, "/root/testdata/sf0.001").collect()
    assert rows and {r.verdict for r in rows} <= {"allow", "block"}
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert ur.mine(pages, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
