import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from patchloom.llm.urls import MAX_TOKENS, MIN_CONFIDENCE, MIN_SUPPORT, MINED_TOKENS, MinedRule, filter_urls, host_of, op9_url_rules, path_of, pruned, tokens

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
SCHEMA = "page_id long, url string, html string, host string, verdict int, tokens string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def ruled(host, path):
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def check(rows, got):
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, url in rows:
        r = by[i]
        assert (r.host, r.path) == parts(url)
        rule, verdict = ruled(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block")
        if rule:
            assert r.verdict == verdict and r.mined is None


def test_query(spark, data_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{data_dir}/pages.parquet").select("page_id", "url").collect()]
    check(pages, op9_url_rules(spark, data_dir).collect())


def test_mined_rules_decide(spark):
    urls = [f"http://x{k}.net/es/{k}" for k in range(30)] + [f"http://x{k}.com/de/{k}" for k in range(30)] + ["http://y.org/es/1", "http://y.org/de/2", "http://q.net/zz/1"]
    odd = [None, "", "no scheme", "://", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.www.example.com/en/", "http://example.com", "http://notexample.com/en/a", "http://net/es/", "a\nb://C.net/fr/\n?x", "http://é.NET/es/" + "s/" * 4000, "x://y://z.com/", "http://y.org/es/1"]
    rows = list(enumerate(urls + odd))
    df = spark.createDataFrame([(i, u, None, "h", 1, "t") for i, u in rows], SCHEMA)
    got = filter_urls(df, min_support=0.1).collect()
    check(rows, got)
    by = {r.page_id: r for r in got}
    assert by[60].verdict == "block" and "first:es" in by[60].mined
    assert by[61].verdict == "allow" and by[72].verdict == "block" and by[63].verdict == "allow"


def mined_by_hand(rows, got, support=MIN_SUPPORT):
    """Holds got against rules counted one itemset after the other, from (id, url, tokens); the number of rows that a mined rule judges."""
    labelled = [(set(t), ruled(*parts(url))[1]) for _, url, t in rows if ruled(*parts(url))[1]]
    held, by = Counter(), Counter()
    for t, v in labelled:
        for k in range(1, MAX_TOKENS + 1):
            for c in combinations(sorted(t), k):
                held[c] += 1
                by[c, v] += 1
    n = len(labelled)
    rules = {(frozenset(c), v): (x / held[c], x / n) for (c, v), x in by.items() if x >= support * n and x / held[c] >= MIN_CONFIDENCE}
    parts_of = lambda c: (frozenset(p) for k in range(1, len(c)) for p in combinations(c, k))
    kept = [(c, v) for (c, v), (conf, _) in rules.items() if not any(rules.get((p, v), (-1,))[0] >= conf for p in parts_of(c))]
    kept.sort(key=lambda r: (-rules[r][0], -rules[r][1], len(r[0]), sorted(r[0])))
    got, mined = {r.page_id: r for r in got}, 0
    for i, url, t in rows:
        if not ruled(*parts(url))[0]:
            best = next((r for r in kept if r[0] <= set(t)), None)
            mined += best is not None
            assert (got[i].verdict, got[i].mined) == ((best[1], " & ".join(sorted(best[0]))) if best else ("allow", None))
    return mined


def with_tokens(pages):
    return [(r.page_id, r.url, r.t) for r in pages.select("page_id", "url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).withColumn("t", tokens("url", "h", "p")).collect()]


def test_mined_verdicts_of_the_query(spark, data_dir):
    rows = with_tokens(spark.read.parquet(f"{data_dir}/pages.parquet"))
    assert max(len(t) for *_, t in rows) <= MINED_TOKENS
    assert mined_by_hand(rows, op9_url_rules(spark, data_dir).collect())


def test_mined_verdicts_of_urls_with_many_tokens(spark):
    """Up to 26 frequent tokens a URL: what FP-growth finds in narrow ones and what grows in wide ones, counted over all."""
    r = random.Random(4)
    words = [f"s{chr(97 + j)}" for j in range(22)]
    some = lambda share: "/".join(w for w in words if r.random() < share)
    urls = [f"http://h{k}.net/es/{some(0.9)}" for k in range(30)] + [f"http://h{k}.com/de/{some(0.6)}" for k in range(30)] + [f"http://h{k}.net/fr/{some(0.1)}?a=1" for k in range(20)] + [f"http://h{k}.com/{some(0.2)}#f" for k in range(20)]
    urls += [f"https://y{k}.org/{some(0.1 * (k % 10))}" for k in range(40)] + ["http://z.org/es/sb", "http://z.org/a?a=2", "http://z.org/sc#f"]
    df = spark.createDataFrame([(i, u, None, "h", 1, "t") for i, u in enumerate(urls)], SCHEMA)
    rows = with_tokens(df)
    assert max(len(t) for *_, t in rows) > 22 and mined_by_hand(rows, filter_urls(df, min_support=0.1).collect(), 0.1) > 20
    wide = df.where("page_id < 30 or page_id >= 100")  # no narrow one has a verdict
    assert mined_by_hand(with_tokens(wide), filter_urls(wide, min_support=0.1).collect(), 0.1) > 20


def test_many_tokens_that_go_together(spark):
    urls = [f"http://h{k}.net/es/" + "/".join(f"s{chr(97 + j)}" for j in range(22)) for k in range(40)] + [f"http://h{k}.com/x" for k in range(40)] + ["http://y.org/sa/" + "/".join(f"s{chr(97 + j)}" for j in range(22))]
    df = spark.createDataFrame([(i, u, None, "h", 1, "t") for i, u in enumerate(urls)], SCHEMA)
    got = filter_urls(df).collect()
    assert {r.page_id: r for r in got}[80].verdict == "block" and len(got) == 81
    assert mined_by_hand(with_tokens(df), got)


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert filter_urls(df).collect() == []
    got = filter_urls(spark.createDataFrame([(1, "http://a.org/x", None, "h", 1, "t")], SCHEMA)).collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow")]


def test_pruned():
    general, special = MinedRule(frozenset("a"), "block", 0.9, 0.3), MinedRule(frozenset("ab"), "block", 0.85, 0.2)
    better, other = MinedRule(frozenset("ac"), "block", 0.95, 0.1), MinedRule(frozenset("ab"), "allow", 0.8, 0.1)
    assert pruned([special, other, general, better]) == [better, general, other]
