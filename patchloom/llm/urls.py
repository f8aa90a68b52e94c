"""URL filters by association rules.

Fixed host and path rules judge some pages; those verdicts are the labels. Spark's FP-growth mines
the combinations of URL tokens that go with a verdict; the rules that are supported, confident and
not implied by a shorter one judge the other pages, found through an index from tokens to rules.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

# Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.01, 0.8, 3
#: Frequent tokens of a labelled URL that FP-growth is given at most: each URL holds 2^13 itemsets with its verdict, so
#: there are no more than 2^13 / MIN_SUPPORT frequent ones. URLs with more tokens are counted level by level instead.
MINED_TOKENS = 12
DEFAULT = "allow"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: str, host: str, path: str) -> Column:
    """The distinct tokens of a URL: scheme, host endings and labels, path segments with digits as #, file ending, query keys, fragment."""
    u, h, p = (f"`{c}`" for c in (url, host, path))
    labels = f"split({h}, '[.]')"
    segments = f"filter(split({p}, '/'), x -> x <> '')"
    query = f"regexp_extract({u}, '(?s)^[^?#]*[?]([^#]*)', 1)"
    return F.expr(f"""case when {u} is null or {h} = '' then cast(array() as array<string>) else array_distinct(concat(
        array(concat('scheme:', lower(substring_index({u}, '://', 1))), concat('top:', element_at({labels}, -1))),
        if(size({labels}) > 1, array(concat('site:', element_at({labels}, -2), '.', element_at({labels}, -1))), array()),
        transform(slice({labels}, 1, greatest(size({labels}) - 2, 0)), x -> concat('label:', x)),
        transform({segments}, (x, i) -> concat(if(i = 0, 'first:', 'path:'), regexp_replace(x, '[0-9]+', '#'))),
        filter(array(concat('file:', regexp_extract({p}, '[.]([A-Za-z0-9]+)$', 1))), x -> x <> 'file:'),
        transform(filter(split({query}, '&'), x -> x <> ''), x -> concat('query:', substring_index(x, '=', 1))),
        if(instr({u}, '#') > 0, array('fragment'), array()))) end""")


@dataclass(frozen=True)
class MinedRule:
    tokens: frozenset
    verdict: str
    confidence: float
    support: float

    def order(self) -> tuple:
        return (-self.confidence, -self.support, len(self.tokens), sorted(self.tokens))


def pruned(rules: list[MinedRule]) -> list[MinedRule]:
    """Without rules that a shorter one with the same verdict and no less confidence implies; best first."""
    known = {(r.tokens, r.verdict): r.confidence for r in rules}
    parts = lambda r: (frozenset(c) for k in range(1, len(r.tokens)) for c in combinations(r.tokens, k))
    return sorted((r for r in rules if not any(known.get((p, r.verdict), -1) >= r.confidence for p in parts(r))), key=MinedRule.order)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, most: int = MINED_TOKENS) -> list[MinedRule]:
    """Rules of up to MAX_TOKENS tokens from (tokens, verdict), exact for any number of tokens. No rows: no rules.

    FP-growth mines the URLs of up to `most` frequent tokens. Where there are others, combinations are grown in them
    level by level; what is frequent overall is frequent in one of the two parts, and what is found in either is
    counted over all rows. The number of rules is bounded by the support, not by the rows.
    """
    total = labelled.count()
    if not total:
        return []
    often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= min_support * total)
    ranked = [r.token for r in often.orderBy(F.desc("count"), "token").collect()]  # at most a URL's mean number of tokens / min_support
    if not ranked:
        return []
    held = labelled.select(F.array_intersect(F.array(*map(F.lit, ranked)), "tokens").alias("own"), "verdict")
    wide = held.where(F.size("own") > most)
    grown = grown_combinations(wide, min_support) if wide.limit(1).count() else []
    narrow = held.where(F.size("own") <= most) if grown else held
    found = []
    if not grown or narrow.limit(1).count():
        baskets = narrow.select(F.concat("own", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0 if grown else min_confidence).fit(baskets)
        found = model.associationRules.where(F.col("consequent")[0].startswith("verdict:") & (F.size("antecedent") <= MAX_TOKENS)).collect()
    if not grown:
        return pruned([MinedRule(frozenset(r.antecedent), r.consequent[0][len("verdict:") :], r.confidence, r.support) for r in found])
    candidates = sorted({tuple(sorted(r.antecedent)) for r in found} | set(grown))
    fitting = held.select("verdict", F.explode(matcher(candidates, every=True)("own")).alias("n"))
    counts = fitting.groupBy("n", "verdict").count().collect()  # candidates x verdicts
    whole: dict[int, int] = {}
    for r in counts:
        whole[r.n] = whole.get(r.n, 0) + r["count"]
    rules = [MinedRule(frozenset(candidates[r.n]), r.verdict, r["count"] / whole[r.n], r["count"] / total) for r in counts]
    return pruned([r for r in rules if r.support >= min_support and r.confidence >= min_confidence])


def grown_combinations(wide: DataFrame, min_support: float) -> list[tuple]:
    """The combinations of up to MAX_TOKENS of own that go with a verdict in min_support of the rows (own, verdict) or more, each from a frequent one of a token less."""
    least = min_support * wide.count()
    wide = wide.select("verdict", F.array_sort("own").alias("own"))
    level = wide.select("verdict", "own", F.explode("own").alias("t")).select("verdict", "own", F.array("t").alias("items"))
    found: set[tuple] = set()
    for size in range(1, MAX_TOKENS + 1):
        counts = stored(level.groupBy("verdict", "items").count().where(F.col("count") >= least).select("verdict", "items"), "grown")
        found |= {tuple(r["items"]) for r in counts.select("items").distinct().collect()}  # combinations of a URL / min_support
        if size < MAX_TOKENS:
            level = level.join(counts, ["verdict", "items"], "left_semi")
            level = level.select("verdict", "own", "items", F.explode(F.expr("filter(own, t -> t > element_at(items, -1))")).alias("t"))
            level = level.select("verdict", "own", F.concat("items", F.array("t")).alias("items"))
    return sorted(found)


def matcher(combos: Sequence[Collection[str]], every: bool = False):
    """A function from token arrays to the least number of a combination whose tokens are all there, or null; with every, to all their numbers."""
    index: dict[str, list[int]] = {}
    for n, own in enumerate(combos):
        for t in own:
            index.setdefault(t, []).append(n)
    sizes = [len(own) for own in combos]

    @F.pandas_udf("array<int>" if every else "int")
    def best(items: pd.Series) -> pd.Series:
        out = []
        for own in items:
            left: dict[int, int] = {}
            for t in own:
                for n in index.get(t, ()):
                    left[n] = left.get(n, sizes[n]) - 1
            full = [n for n, x in left.items() if not x]
            out.append(full if every else min(full, default=None))
        return pd.Series(out, dtype="object")

    return best


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(id, host, path, rule, verdict, mined): the verdict of the longest fixed rule, else of the best mined rule, else allow.

    Null URLs and URLs without :// have an empty host and path, no tokens and no rule: allowed.
    Repeated rows are judged alike and count as often as they occur. mined is the mined rule's
    tokens where it decided. Without pages that a fixed rule fits, nothing is mined.
    """
    spark = pages.sparkSession
    parts = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    rule, verdict = ruled("host", "path", rules)
    judged = stored(parts.withColumns({"rule": rule, "verdict": verdict, "tokens": tokens("_url", "host", "path")}).drop("_url"), "urls")
    found = mine(judged.where("verdict is not null").select("tokens", "verdict"), min_support, min_confidence)
    if found:
        names = spark.createDataFrame([(n, r.verdict, " & ".join(sorted(r.tokens))) for n, r in enumerate(found)], "_n int, _verdict string, mined string")
        judged = judged.withColumn("_n", F.when(F.col("verdict").isNull(), matcher([r.tokens for r in found])("tokens"))).join(names, "_n", "left")
    else:
        judged = judged.withColumns({"_verdict": F.lit(None).cast("string"), "mined": F.lit(None).cast("string")})
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", "_verdict", F.lit(DEFAULT)).alias("verdict"), "mined")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
