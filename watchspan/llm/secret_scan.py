"""Secret scans over a trigram index.

From each rule's regular expression a Boolean query of trigrams is derived that every match must fulfil. The trigrams
of all queries are the vocabulary of an inverted index: ``postings`` holds a row for each of them and each text that
contains it. Intersecting and uniting postings gives the candidates of each rule, and only these are verified with the
rule's expression; a rule without a mandatory trigram (a run of hex digits) is matched against every text. Only texts
that hold the rarest trigram of some conjunction, by the length of its postings, travel to meet the candidates.
Everything is DataFrame functions; there is no Python in the tasks.

Defined cases: a null text is empty and has no spans; texts are scanned whole; spans of one kind never overlap, those
of different kinds may; a row is known by a 64-bit hash of id and text, so repeated rows each get a row, and equal
hashes of different rows only cost a verification; an empty table gives none; ``scan`` keeps all columns and adds
``spans``, in place of one of that name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.llm.common import keep, table


@dataclass(frozen=True)
class Rule:
    """``least`` characters in the group, or the match counts for nothing."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ that are long enough
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
)
RULES = BASE + MORE

Query = bool | str | tuple  # True, a trigram, or ("and" | "or", queries)
WIDEST = 64
#: Numbers of a text's matches are summed in runs of so many, as every step copies its list.
RUN = 256


def _join(kind: str, parts: list[Query]) -> Query:
    absorbing = kind == "or"
    if any(p is absorbing for p in parts):
        return absorbing
    own = list(dict.fromkeys(p for p in parts if not isinstance(p, bool)))
    return own[0] if len(own) == 1 else (kind, tuple(own)) if own else not absorbing


def _of_strings(strings: set[str]) -> Query:
    return _join("or", [_join("and", [s[k:k + 3] for k in range(len(s) - 2)]) if len(s) > 2 else True for s in sorted(strings)])


def _exact(op, arg) -> set[str] | None:
    """All strings that an element can match, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "AT":
        return {""}
    if name == "IN":
        out: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if name == "SUBPATTERN":
        return _exact_all(arg[3])
    if name == "BRANCH":
        parts = [_exact_all(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 3:
        one, out, last = _exact_all(arg[2]), set(), {""}
        for k in range(int(arg[1]) + 1 if one is not None else 0):
            out |= last if k >= arg[0] else set()
            last = {a + b for a in last for b in one}
        return out if one is not None and len(out) <= WIDEST else None
    return None


def _exact_all(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        one = _exact(op, arg)
        if one is None or len(out) * len(one) > WIDEST:
            return None
        out = {a + b for a in out for b in one}
    return out


def _query(items) -> Query:
    found: list[Query] = []
    run = {""}
    for op, arg in items:
        one = _exact(op, arg)
        if one is not None and len(run) * len(one) <= WIDEST:
            run = {a + b for a in run for b in one}
            continue
        found.append(_of_strings(run))
        run = one if one is not None else {""}
        if one is None and str(op) == "SUBPATTERN":
            found.append(_query(arg[3]))
        elif one is None and str(op) == "BRANCH":
            found.append(_join("or", [_query(x) for x in arg[1]]))
        elif one is None and str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            found.append(_query(arg[2]))
    return _join("and", [*found, _of_strings(run)])


def trigram_query(pattern: str) -> Query:
    """What every text with a match fulfils, in lower-case trigrams; True if nothing is mandatory."""
    return _query(re._parser.parse(pattern))


def trigrams(query: Query) -> set[str]:
    return set() if isinstance(query, bool) else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _holds(query: Query, test) -> Column:
    if isinstance(query, bool):
        return F.lit(query)
    if isinstance(query, str):
        return test(query)
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [_holds(q, test) for q in query[1]])


def _rarest(query: Query, length: dict[str, int]) -> tuple[int, set[str]]:
    """The trigrams of which every match has one, with the fewest postings."""
    if isinstance(query, str):
        return length.get(query, 0), {query}
    parts = [_rarest(q, length) for q in query[1]]
    if query[0] == "and":
        return min(parts, key=lambda p: (p[0], sorted(p[1])))
    return sum(p[0] for p in parts), set().union(*(p[1] for p in parts))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(trigram, key): the texts that contain each trigram of the vocabulary, in any case."""
    low = docs.select(row_key().alias("key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in vocabulary]))
    return low.select("key", F.explode(held).alias("trigram")).select("trigram", "key")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): which rules' queries hold, from the postings alone."""
    names = sorted(set().union(*map(trigrams, queries.values())))
    bit = {g: k for k, g in enumerate(names)}
    if len(names) > 63:
        held = index.groupBy("key").agg(F.collect_set("trigram").alias("held"))
        test = lambda g: F.array_contains("held", g)
    else:
        number = reduce(lambda out, g: out.when(F.col("trigram") == g, F.lit(1 << bit[g]).cast("long")), names[1:],
                        F.when(F.col("trigram") == names[0], F.lit(1).cast("long")))
        held = index.groupBy("key").agg(F.bit_or(number).alias("held"))
        test = lambda g: F.col("held").bitwiseAND(F.lit(1 << bit[g]).cast("long")) != 0
    kinds = F.array_compact(F.array(*[F.when(_holds(q, test), F.lit(k)) for k, q in queries.items()]))
    return held.select("key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, join: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """What ``join`` makes of each number of an array and all before it; lists grow inside blocks of ``RUN`` only."""
    def within(block: Column) -> Column:
        return F.aggregate(block, F.array().cast("array<bigint>"), lambda done, x: F.array_append(
            done, F.coalesce(join(F.get(done, F.size(done) - 1), x), x)))

    def onward(parts: Column) -> Column:
        lasts = F.transform(parts, lambda p: F.get(p, F.size(p) - 1))
        return bound(running(lasts, join, levels - 1), lambda sums: F.flatten(F.transform(
            parts, lambda part, i: F.transform(part, lambda x: F.coalesce(join(F.get(sums, i - 1), x), x)))))

    if not levels:
        return within(values)
    return bound(values, lambda v: bound(F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / RUN).cast("int")), lambda b: within(F.slice(v, b * RUN + 1, F.lit(RUN)))), onward))


def _steps(text: Column, rule: Rule, place: int) -> Column:
    """For each leftmost match of a rule the characters before it, in it and in its group, and at last those after all matches."""
    between, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    found = [("gap", between), ("size", whole)]
    if rule.group:
        found.append(("chars", F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))))
    return F.transform(F.arrays_zip(*[F.transform(x, F.char_length).alias(name) for name, x in found]), lambda p: F.struct(
        F.lit(place).alias("place"), p.gap.alias("gap"), F.coalesce(p["size"], F.lit(0)).alias("size"),
        F.coalesce(p["chars" if rule.group else "size"], F.lit(-1)).alias("chars")))


def _found(rules, which: Column | None) -> Column:
    """Spans of the given rules (with ``which``: of those named in it), by start and kind.

    The steps of all rules stand in one array, and those of each rule add up to the length of the text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds, least, places = ([f(r) for r in rules] for f in (lambda r: r.kind, lambda r: r.least, RULES.index))
    parts = []
    for k, r in enumerate(rules):
        may = F.regexp_like(text, F.lit(r.pattern))
        absent = F.array(F.struct(F.lit(k).alias("place"), F.char_length(text).alias("gap"), F.lit(0).alias("size"), F.lit(-1).alias("chars")))
        parts.append(F.when(F.array_contains(which, r.kind) & may if which is not None else may, _steps(text, r, k)).otherwise(absent))

    def spans(steps: Column, length: Column) -> Column:
        ends = running(F.transform(steps, lambda p: (p.gap + p["size"]).cast("long")), lambda a, b: a + b)
        long_enough = F.filter(F.arrays_zip(steps.alias("step"), ends.alias("end")),
                               lambda p: p.step.chars >= F.get(F.array(*map(F.lit, least)), p.step.place))
        return F.transform(long_enough, lambda p: bound(
            (p.end - p.step.place * length).cast("int"), lambda end: F.struct(
                (end - p.step["size"]).alias("start"), F.get(F.array(*map(F.lit, places)), p.step.place).alias("place"), end.alias("end"),
                F.get(F.array(*map(F.lit, kinds)), p.step.place).alias("kind"))))

    return F.sort_array(bound(F.char_length(text), lambda length: bound(F.flatten(F.array(*parts)), lambda steps: spans(steps, length))))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``spans``: (start, place, end, kind) in code points, end exclusive."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    always = [r for r in rules if r.kind not in indexed]
    by_index = [r for r in rules if r.kind in indexed]
    docs = docs.drop("spans")
    names = sorted(set().union(*map(trigrams, indexed.values())))
    index = keep(postings(docs, names))
    length = {r.trigram: r["count"] for r in index.groupBy("trigram").count().collect()}
    rare = sorted(set().union(*(_rarest(q, length)[1] for q in indexed.values())))
    hits = keep(candidates(index, indexed))
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    may = reduce(lambda a, b: a | b, [F.contains(low, F.lit(g)) for g in rare])
    row = docs.select(F.struct("*").alias("_row"), F.col("text"), F.col("doc_id"))
    none = F.array().cast("array<string>")
    meet = row.filter(may).withColumn("key", row_key()).join(hits, "key", "left").select("_row", "text", F.coalesce("kinds", none).alias("kinds"))
    seen = meet.select("_row.*", F.sort_array(F.concat(_found(always, None), _found(by_index, F.col("kinds")))).alias("spans"))
    return seen.unionByName(row.filter(~may).select("_row.*", _found(always, None).alias("spans")))


def _stretches(spans: Column) -> Column:
    """(start, end) of the stretches that spans, in order of their starts, cover together."""
    def heads(ends: Column) -> Column:
        first = F.filter(F.transform(spans, lambda s, i: F.struct(s.start.alias("start"), i.alias("at"))),
                         lambda s: (s["at"] == 0) | (s.start >= F.get(ends, s["at"] - 1)))
        return bound(first, lambda own: F.transform(own, lambda s, i: F.struct(
            s.start.alias("start"), F.get(ends, F.coalesce(F.get(own, i + 1)["at"], F.size(ends)) - 1).cast("int").alias("end"))))

    return bound(running(F.transform(spans, lambda s: s.end.cast("long")), lambda a, b: F.greatest(a, b)), heads)


def redact(docs: DataFrame) -> DataFrame:
    """Every stretch of text under a span becomes ``[secret]``; ``n_chars``, where there is one, follows the text.

    Pieces are cut from four bytes per code point, so that none is looked for from the beginning of its text.
    """
    marked = docs.select("*", F.when(F.size("spans") > 0, _stretches(F.col("spans"))).alias("_cut"))
    piece = lambda wide, start, stop: F.decode(F.concat(
        F.lit(bytearray(b"\0\0\xfe\xff")), F.substring(wide, 4 * start + 1, 4 * (stop - start))), "UTF-32")
    rest = F.array(F.struct(F.char_length("text").alias("start"), F.lit(None).cast("int").alias("end")))

    def pieces(wide: Column) -> Column:
        return bound(F.concat("_cut", rest), lambda cut: F.array_join(F.transform(cut, lambda s, i: piece(
            wide, F.coalesce(F.get(cut, i - 1).end, F.lit(0)), s.start)), "[secret]"))

    out = marked.withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(bound(F.encode("text", "UTF-32"), pieces)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cut").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.drop("_cut", "spans")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    base = F.filter("spans", lambda s: s.place < len(BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    number = lambda rule: F.size(F.filter("spans", lambda s: s.kind == rule.kind)).cast("long").alias(f"n_{rule.kind}")
    return found.select("doc_id", *[number(r) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _sql() -> str:
    def spans(place: int, rule: Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
  SELECT n, {place} AS place, '{rule.kind}' AS kind, s.start, s.start + s.size AS stop FROM (
    SELECT n, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start': CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'size': length(m[i]), 'chars': length(v[i])}})) AS s
    FROM (SELECT n, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS v FROM d)
  ) WHERE s.chars >= {rule.least}"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(spans(k, r) for k, r in enumerate(RULES))}),
g AS (SELECT n, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < {len(BASE)}) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM s GROUP BY n)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (n)
"""


SQL = _sql()
