"""Quality rules: a decision list over text statistics, learned by sequential covering.

``text_stats`` describes each text by counts (whole texts, one projection, no shuffle). ``learn`` reads labelled
statistics and builds rules that reject: a rule *grows* on two thirds of the labelled rows, one threshold at a time by
information gain, until it covers no good row; it is then *pruned* on the other third to the prefix that does best
there; rows it covers are set aside and the next rule begins. Every step is one aggregation over all labelled rows;
what comes to the driver is a histogram of at most ``cuts`` x 2 bins per feature. The result is an ordered conditional
expression of Spark, readable with ``str``.

Defined cases: a null or empty text has no words and fails the base test; ratios over nothing are 0; rows without a
label are not learned from; of several labels for one document the lowest counts; without labelled rows, or without
bad ones, the list is empty and rejects nothing; repeated rows each get a row; other columns pass through
``text_stats`` (its own are named in ``STATS``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.llm.common import SPACE, keep, table, words_of

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]
WINDOW = 5


def _repeated(hashes: Column) -> Column:
    """The places of windows (sorted by hash) that have a neighbour with the same hash."""
    same = lambda x, at: F.equal_null(x.h, F.get(hashes, at).h)
    return F.sort_array(F.transform(F.filter(hashes, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x.i))


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns ``STATS``.

    Windows of five words are compared by 64-bit hashes of word hashes. For n windows of one text, a false
    repetition has a chance of n^2 / 2^65: under one in a billion for a text of 100,000 words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    left = lambda pattern: F.char_length(F.regexp_replace(body, pattern, "")).cast("long")
    first = docs.select(
        "*", words_of(body).alias("_words"), lines.alias("_lines"), left(r"[^#*$%&|<>]+").alias("n_symbols"),
        left("[^A-Z]+").alias("n_upper"), left("[^0-9]+").alias("n_digits"), left("[^!?]+").alias("n_marks"))
    second = first.select(
        "*", F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_w"))
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(
        F.slice("_w", F.lit(1), F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(F.col("_w"), i + k) for k in range(1, WINDOW)])))
    third = second.drop("_words", "_lines").select("*", windows.alias("_h")).drop("_w")
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    fourth = third.select("*", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    fifth = fourth.drop("_h").select("*", F.when(F.col("_s").isNotNull(), _repeated(F.col("_s"))).alias("_p")).drop("_s")
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(
        F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), i + 1), p + WINDOW) - p)), F.lit(0).cast("long"), lambda a, n: a + n)
    return fifth.select("*", F.coalesce(covered, F.lit(0)).alias("n_repeat_words")).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "words": F.col("n_words").cast("double"), "mean_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"),
        "repeat_words": per("n_repeat_words", "n_words"), "upper": per("n_upper", "word_chars"),
        "digits": per("n_digits", "word_chars"), "marks_per_word": per("n_marks", "n_words"),
        "words_per_line": per("n_words", "n_lines")}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        value = of[self.feature]
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def __str__(self) -> str:
        return f"reject if {' and '.join(map(str, self.conditions))} (pruning rows: {self.bad} bad, {self.good} good)"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def rejects(self, of: dict[str, Column] | None = None) -> Column:
        """The first rule that holds decides; otherwise the text is kept."""
        of = of or features()
        found = F.lit(False)
        for rule in reversed(self.rules):
            found = F.when(_all(c.column(of) for c in rule.conditions), F.lit(True)).otherwise(found)
        return found


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _gain(p: float, n: float, before: float) -> float:
    return p * (math.log2(p / (p + n)) - before) if p else 0.0


def _bin(value: Column, edges: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda edge: edge <= value)) if edges else F.lit(0)


def learn(labelled: DataFrame, names: list[str], cuts: int = 32, max_rules: int = 6, max_conditions: int = 3,
          min_precision: float = 0.95, min_share: float = 0.005) -> DecisionList:
    """From the columns ``names`` (double), ``bad`` (boolean) and ``key`` (long; deals rows to growing or pruning).

    A rule is kept if, among the pruning rows that it covers, at least ``min_precision`` are bad, and these are at
    least ``min_share`` of the bad ones there. All labelled rows are used.
    """
    quantiles = [k / cuts for k in range(cuts + 1)]
    found = labelled.agg(*[F.percentile_approx(F.when(F.col("bad") == bad, F.col(f)), quantiles, 10_000).alias(f"{f}:{bad}")
                           for f in names for bad in (True, False)]).first()
    edges = {f: sorted({x for bad in (True, False) for x in found[f"{f}:{bad}"] or []}) for f in names}
    binned = keep(labelled.select("bad", (F.pmod(F.xxhash64("key"), F.lit(3)) > 0).alias("grow"), *[
        _bin(F.col(f), edges[f]).alias(f) for f in names]))
    index = {f: {e: k + 1 for k, e in enumerate(edges[f])} for f in names}
    inside = lambda c: F.col(c.feature) >= index[c.feature][c.threshold] if c.above else F.col(c.feature) < index[c.feature][c.threshold]
    rules: list[Rule] = []
    left = binned
    while len(rules) < max_rules:
        grown: list[Condition] = []
        while len(grown) < max_conditions:
            rows = left.filter("grow").filter(_all(map(inside, grown)))
            bins = rows.select("bad", F.explode(F.create_map(*[x for f in names for x in (F.lit(f), F.col(f))])).alias("feature", "bin"))
            counts = bins.groupBy("feature", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            best = _best(counts, edges)
            if best is None:
                break
            grown.append(best[0])
            if best[1] == 0:
                break
        if not grown:
            break
        held = left.filter("not grow").agg(F.count_if("bad").alias("all"), *[
            F.count_if(_all(map(inside, grown[:k])) & (F.col("bad") == bad)).alias(f"{k}:{bad}") for k in range(1, len(grown) + 1) for bad in (True, False)]).first()
        score = {k: (held[f"{k}:True"] + 1) / (held[f"{k}:True"] + held[f"{k}:False"] + 2) for k in range(1, len(grown) + 1)}
        size = max(score, key=lambda k: (score[k], -k))
        p, n = held[f"{size}:True"], held[f"{size}:False"]
        if not p or p < min_precision * (p + n) or p < min_share * held["all"]:
            break
        rules.append(Rule(tuple(grown[:size]), p, n))
        left = left.filter(~_all(map(inside, grown[:size])))
    return DecisionList(tuple(rules))


def _best(counts, edges: dict[str, list[float]]) -> tuple[Condition, int] | None:
    """The threshold with the highest gain, and how many good rows it lets in."""
    best = None
    for f, cut in edges.items():
        own = sorted((r["bin"], r["p"], r["n"]) for r in counts if r["feature"] == f)
        all_p, all_n = sum(r[1] for r in own), sum(r[2] for r in own)
        if not all_p or not all_n:
            continue
        before = math.log2(all_p / (all_p + all_n))
        for k, edge in enumerate(cut, 1):
            p, n = sum(r[1] for r in own if r[0] >= k), sum(r[2] for r in own if r[0] >= k)
            for above, a, b in ((True, p, n), (False, all_p - p, all_n - n)):
                gain = _gain(a, b, before)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, Condition(f, above, edge), b)
    return best and best[1:]


def fit(stats: DataFrame, labels: DataFrame, **options) -> DecisionList:
    """Learns from the documents with a label that pass the base test. ``stats`` has doc_id and ``STATS``."""
    one = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    of = features()
    rows = stats.filter(~base_failed()).join(one, "doc_id").select(
        (F.col("quality") == 0).alias("bad"), F.col("doc_id").alias("key"), *[c.alias(f) for f, c in of.items()])
    return learn(rows, list(of), **options)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base test and the learned list.

    Statistics are computed once and written next to the rows: a filter on expressions of this size would otherwise be
    pushed into the scan and repeat them. Learning then reads the few numbers only.
    """
    marked = keep(text_stats(docs.select(F.struct("*").alias("_row"), F.col("doc_id"), F.col("text"))).drop("text"))
    rejects = fit(marked.select("doc_id", *STATS), labels).rejects()
    return marked.filter(~base_failed() & ~rejects).select("_row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    stats = keep(text_stats(docs).select("doc_id", *STATS))
    rejects = fit(stats, table(spark, sf_dir, "labels", ["doc_id", "quality"])).rejects()
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base_failed().alias("base_failed"), (~base_failed() & ~rejects).alias("kept"))
