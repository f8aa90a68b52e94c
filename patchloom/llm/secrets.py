"""Secret scans in Spark SQL expressions alone.

Three fixed patterns give the base spans. Other secrets are found by entropy: a window slides over
every candidate string, its character counts change by one added and one dropped character, and
the Shannon entropy that follows from the counts is held against the threshold of the candidate's
character class. An allow-list suppresses candidates known to be harmless.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The base patterns. Group 2 of assign has 6 characters or more.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits a character that a window must reach, by class: hexadecimal digits, letters and digits, and those with +/_=-.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: Candidates that match one of these are no secrets: version-4-like identifiers, runs of the alphabet or of digits, stand-ins, paths of plain words.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)abcdefghij|0123456789|1234567890",
    r"(?i)example|sample|placeholder|changeme|your[_-]?(key|token|secret)",
    r"^[A-Za-z]++(?:[/_=-]++(?:[A-Za-z]++|[0-9]{1,4}+))++[/_=-]*+$",
)
MARK = "[SECRET]"
SPAN = "struct<start:int,rank:int,end:int,kind:string>"
#: Elements that a running total copies at a time, and code points of the pieces that long texts are cut into.
RUN, PIECE = 64, 4096


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(v: str, merge: str) -> str:
    """SQL: for each element of the integer array named v what merge (of a and x) makes of 0 and all elements before it.

    Runs of elements are merged first and then the elements of each run, since an array that grows
    by one element is copied each time.
    """
    scan = lambda items, start: f"aggregate({items}, named_struct('at', {start}, 'out', cast(array() as array<int>)), (c, x) -> named_struct('at', {_let('a', 'c.at', merge)}, 'out', concat(c.out, array(c.at))), c -> c.out)"
    runs, run = f"sequence(0, cast((size({v}) - 1) div {RUN} as int))", f"slice({v}, r * {RUN} + 1, {RUN})"
    sums = f"transform({runs}, r -> aggregate({run}, 0, (a, x) -> {merge}))"
    return _let("sums", sums, _let("starts", scan("sums", "0"), f"flatten(transform({runs}, r -> {scan(run, 'starts[r]')}))"))


def _places(text: str, pattern: str, item: str, kind: str, condition: str, extra: str = "") -> str:
    """SQL: for each match of pattern, item (in terms of at: code points before it, i: its number from 0, f.m: the matches), where condition holds."""
    p = _lit(pattern)
    found = f"named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', transform(split({text}, {p}, -1), x -> length(x)){extra})"
    lengths = "transform(f.m, (x, i) -> f.g[i] + length(x))"
    kept = f"filter(sequence(0, size(f.m) - 1), i -> {condition})"
    walk = _let("lengths", lengths, _let("before", _running("lengths", "a + x"), f"transform({kept}, i -> {_let('at', 'before[i] + f.g[i]', item)})"))
    return f"case when {text} rlike {p} then {_let('f', found, walk)} else cast(array() as array<{kind}>) end"


def _base(text: str, pattern: str, rank: int, condition: str = "true", extra: str = "") -> str:
    return _places(text, pattern, f"named_struct('start', at, 'rank', {rank}, 'end', at + length(f.m[i]), 'kind', '{KINDS[rank]}')", SPAN, condition, extra)


def _candidates(text: str) -> str:
    mixed = "(f.m[i] rlike '[0-9]' and f.m[i] rlike '[A-Za-z]' or f.m[i] rlike '[a-z][A-Z]+[a-z]')"
    allowed = " or ".join(f"f.m[i] rlike {_lit(x)}" for x in ALLOWED)
    return _places(text, CANDIDATE, "named_struct('start', at, 's', f.m[i])", "struct<start:int,s:string>", f"{mixed} and not ({allowed})")


def _entropy_spans(candidates: str) -> str:
    """SQL: the spans between the first and the last window whose entropy reaches the threshold."""
    scale = 1 << 20  # c * log2(c) as whole numbers, so that adding and dropping leaves no rounding error
    f = "array(" + ", ".join(f"{round(c * math.log2(c) * scale) if c else 0}L" for c in range(WINDOW + 1)) + ")"
    limit = {k: math.floor(WINDOW * (math.log2(WINDOW) - t) * scale) for k, t in THRESHOLDS.items()}
    lim = f"case when c.s rlike '^[0-9a-fA-F]+$' then {limit['hex']}L when c.s rlike '^[A-Za-z0-9]+$' then {limit['alnum']}L else {limit['base64']}L end"
    codes = f"transform(regexp_extract_all(c.s, '.', 0), x -> instr('{ALPHABET}', x))"
    steps = f"transform(codes, (x, k) -> named_struct('i', k + 1, 'add', x, 'drop', if(k >= {WINDOW}, codes[k - {WINDOW}], 0)))"
    n = lambda which: f"(ascii(substring(acc.counts, t.{which}, 1)) - 97)"
    added = f"overlay(acc.counts placing chr(98 + {n('add')}) from t.add)"
    counts = f"case when t.add = t.drop then acc.counts when t.drop = 0 then {added} else overlay({added} placing chr(96 + {n('drop')}) from t.drop) end"
    change = f"case when t.add = t.drop then 0L else {f}[{n('add')} + 1] - {f}[{n('add')}] + if(t.drop = 0, 0L, {f}[{n('drop')} - 1] - {f}[{n('drop')}]) end"
    hit = f"t.i > {WINDOW} and acc.sum <= lim"  # of the window that ended before this step
    step = f"named_struct('counts', {counts}, 'sum', acc.sum + {change}, 'first', if(acc.first = 0 and {hit}, t.i - 1, acc.first), 'last', if({hit}, t.i - 1, acc.last))"
    finish = "named_struct('first', if(acc.first = 0 and acc.sum <= lim, size(codes), acc.first), 'last', if(acc.sum <= lim, size(codes), acc.last))"
    ends = f"aggregate({steps}, named_struct('counts', repeat('a', {len(ALPHABET)}), 'sum', 0L, 'first', 0, 'last', 0), (acc, t) -> {step}, acc -> {finish})"
    spans = f"transform({candidates}, c -> named_struct('start', c.start, 'e', {_let('lim', lim, _let('codes', codes, ends))}))"
    return f"transform(filter({spans}, x -> x.e.first > 0), x -> named_struct('start', x.start + x.e.first - {WINDOW}, 'rank', 3, 'end', x.start + x.e.last, 'kind', 'entropy'))"


def _untouched(spans: str, base: str) -> str:
    """SQL: those of the spans that no span of base overlaps, by the furthest end of what starts before theirs."""
    events = f"array_sort(concat(transform({spans}, (x, k) -> named_struct('at', x.end, 'base', 0, 'reach', 0, 'k', k)), transform({base}, x -> named_struct('at', x.start, 'base', 1, 'reach', x.end, 'k', -1))))"
    reach = _let("reaches", "transform(events, x -> x.reach)", _running("reaches", "greatest(a, x)"))
    kept = f"transform(filter(transform(events, (x, j) -> named_struct('k', x.k, 'reach', reach[j])), x -> x.k >= 0 and x.reach <= {spans}[x.k].start), x -> {spans}[x.k])"
    return f"case when size({spans}) = 0 or size({base}) = 0 then {spans} else {_let('events', events, _let('reach', reach, kept))} end"


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _base and _spans, arrays of (start, rank, end, kind) by start, then kind.

    Positions are code points, ends exclusive. Entropy spans that touch a base span are left out. A
    null text is empty and has no spans; rows, repeated ones too, and other columns stay as they are.
    """
    text = f"coalesce(`{text_col}`, '')"
    found = docs.withColumns({
        "_assign": F.expr(_base(text, ASSIGN, 0, "length(f.v[i]) >= 6", f", 'v', regexp_extract_all({text}, {_lit(ASSIGN)}, 2)")),
        "_access": F.expr(_base(text, ACCESS, 1)),
        "_hex": F.expr(_base(text, HEX, 2)),
        "_candidates": F.expr(_candidates(text)),
    })
    found = found.withColumn("_base", F.expr("sort_array(concat(_assign, _access, _hex))")).withColumn("_entropy", F.expr(_entropy_spans("_candidates")))
    return found.withColumn("_spans", F.sort_array(F.concat("_base", F.expr(_untouched("_entropy", "_base"))))).select(*docs.columns, "_base", "_spans")


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = MARK) -> DataFrame:
    """The documents with every span, overlapping ones as one, replaced by mark; a null text stays null."""
    text = f"`{text_col}`"
    part = f"if(b <= a, '', array_join(transform(sequence(cast(a div {PIECE} as int), cast((b - 1) div {PIECE} as int)), c -> substring(pieces[c], greatest(a - c * {PIECE}, 0) + 1, least(b, (c + 1) * {PIECE}) - greatest(a, c * {PIECE}))), ''))"
    between = lambda a, b, more="": _let("a", a, _let("b", b, f"concat({part}{more})"))
    marked = f"transform(_spans, (x, k) -> if(x.start >= reach[k], {between('reach[k]', 'x.start', ', ' + _lit(mark))}, ''))"
    rest = between("array_max(transform(_spans, x -> x.end))", f"length({text})")
    reach = _let("reaches", "transform(_spans, x -> x.end)", _running("reaches", "greatest(a, x)"))
    clean = _let("pieces", f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)", _let("reach", reach, f"concat(array_join({marked}, ''), {rest})"))
    return scan_secrets(docs, text_col).withColumn(text_col, F.when(F.size("_spans") > 0, F.expr(clean)).otherwise(F.col(text_col))).select(*docs.columns)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(_base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_spans").alias("spans"))
