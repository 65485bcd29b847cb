"""URL filters: host and path rules, and gradient-boosted trees on lexical features where no rule fits.

Features of a url: its length, depth of the path, share of digits, entropy of its characters, number of parameters,
labels of the host, hyphens, and how often urls with the same host suffix were blocked among the labelled ones
(smoothed; suffixes fall into ``BUCKETS`` slots, so that the table has a fixed size). Trees are grown level by level
for the logistic loss: each labelled url is a vector of bins, equal vectors are counted together first, and a level is
one aggregation of gradients and Hessians by node, feature and bin, from which the driver takes the best splits. The
model is a sum of nested conditional expressions of Spark; labelling and scoring need no Python and no join.

Labels come from whoever has them; ``op4`` learns from the urls that its rules decide.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and has its features like any
text (a null: zeros); of rules that fit, the longest wins; repeated rows each get a row and each count in training;
without labels of both kinds everything is allowed; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.llm.common import keep, table

BUCKETS, BINS = 256, 32


@dataclass(frozen=True)
class Rule:
    allow: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


# The rules of the contract.
RULES = (
    Rule(True, "com", "/"),
    Rule(False, "example.com", "/en/"),
    Rule(True, "www.example.com", "/en/"),
    Rule(False, "net", "/es/"),
    Rule(False, "net", "/fr/"),
)


def parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``, in place of columns of these names."""
    rest = F.substring(F.col(url), F.locate("://", F.col(url)) + 3, F.length(F.col(url)))
    has = F.coalesce(F.locate("://", F.col(url)) > 0, F.lit(False))
    whole = F.when(has, rest).otherwise("")
    host = F.regexp_extract(whole, r"^[^/?#]*", 0)
    path = F.regexp_extract(whole, r"^[^/?#]*(/[^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return urls.drop("host", "path").select("*", F.translate(host, upper, lower).alias("host"), path.alias("path"))


def ruled(rules=RULES) -> Column:
    """(rule, allow) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        found = F.when(rule.fits(F.col("host"), F.col("path")), F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.allow).alias("allow"))).otherwise(found)
    return found


def suffix_slot() -> Column:
    """The last label of the host, as one of ``BUCKETS`` slots."""
    return F.pmod(F.xxhash64(F.substring_index(F.col("host"), ".", -1)), F.lit(BUCKETS)).cast("int")


def lexical(url: str = "url") -> dict[str, Column]:
    text = F.coalesce(F.col(url), F.lit(""))
    chars = F.char_length(text)
    count = lambda pattern: F.char_length(F.regexp_replace(text, pattern, "")).cast("double")
    share = lambda c: (chars - F.char_length(F.replace(text, c, F.lit("")))) / chars
    entropy = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda e, c: e - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return {
        "length": chars.cast("double"), "depth": F.char_length(F.regexp_replace("path", "[^/]+", "")).cast("double"),
        "digits": F.when(chars > 0, count("[^0-9]+") / chars).otherwise(0.0), "entropy": F.when(chars > 0, entropy).otherwise(0.0),
        "parameters": F.when(F.contains(text, F.lit("?")), count("[^&=]+")).otherwise(0.0),
        "labels": F.char_length(F.regexp_replace("host", "[^.]+", "")).cast("double"), "hyphens": count("[^-]+")}


@dataclass
class Tree:
    """``split`` (feature, threshold, lower, upper) or a leaf's ``value``."""

    value: float = 0.0
    split: tuple[str, float, "Tree", "Tree"] | None = None

    def column(self, of: dict[str, Column]) -> Column:
        if self.split is None:
            return F.lit(self.value)
        feature, threshold, lower, upper = self.split
        return F.when(of[feature] < threshold, lower.column(of)).otherwise(upper.column(of))


@dataclass
class Model:
    prior: float
    suffix: list[float]
    trees: list[Tree]

    def logit(self) -> Column:
        """Above 0: block. Needs ``features``, made by ``with_features``."""
        of = {name: F.col("features")[name] for name in [*lexical(), "suffix"]}
        return reduce(lambda a, b: a + b, [t.column(of) for t in self.trees], F.lit(self.prior))


def with_features(urls: DataFrame, suffix: list[float]) -> DataFrame:
    rate = F.get(F.array(*map(F.lit, suffix)), suffix_slot())
    return urls.withColumn("features", F.struct(*[c.alias(n) for n, c in lexical().items()], rate.alias("suffix")))


def _bin(value: Column, edges: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= value)) if edges else F.lit(0)


def fit(labelled: DataFrame, trees: int = 10, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> Model:
    """From (url, host, path, block). Uses all rows; what comes to the driver is histograms of fixed size."""
    totals = labelled.groupBy(suffix_slot().alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.count_if("block").alias("blocked")).collect()
    n, blocked = sum(r.n for r in totals), sum(r.blocked for r in totals)
    if not blocked or blocked == n:
        return Model(-1.0, [0.0] * BUCKETS, [])
    # Both kinds weigh the same in total: how often rules block says nothing about urls without a rule.
    heavy, light = n / (2 * blocked), n / (2 * (n - blocked))
    suffix = [0.5] * BUCKETS
    for r in totals:
        ours, others = heavy * r.blocked, light * (r.n - r.blocked)
        suffix[r.slot] = (ours + 10) / (ours + others + 20)
    rows = with_features(labelled, suffix)
    names = [*lexical(), "suffix"]
    made = keep(rows.select("features.*", "block"))
    cuts = made.agg(*[F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 10_000).alias(f) for f in names]).first()
    edges = {f: sorted(set(cuts[f])) for f in names}
    binned = made.select("block", *[_bin(F.col(f), edges[f]).alias(f) for f in names])
    vectors = keep(binned.groupBy(*names).agg((F.count_if("block") * heavy).alias("y"), (F.count_if(~F.col("block")) * light).alias("z")))
    weight = F.col("y") + F.col("z")
    at = {f: F.col(f) for f in names}
    grown: list[Tree] = []  # thresholds are bins here
    prior = 0.0
    for _ in range(trees):
        root = Tree()
        level = {0: root}
        for _ in range(depth):
            logit = reduce(lambda a, b: a + b, [t.column(at) for t in grown], F.lit(prior))
            p = 1 / (1 + F.exp(-logit))
            hist = vectors.select(_node(root, level, at).alias("node"), (F.col("y") - weight * p).alias("g"), (weight * p * (1 - p)).alias("h"),
                                  F.explode(F.create_map(*[x for f in names for x in (F.lit(f), F.col(f))])).alias("feature", "bin")).filter("node is not null")
            sums = defaultdict(list)
            for r in hist.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums[r.node].append((r.feature, r.bin, r.g, r.h))
            following = {}
            for node, tree in level.items():
                for child in _split(tree, sums[node], names, rate, l2):
                    following[len(following)] = child
            level = following
            if not level:
                break
        if root.split is None:
            break
        grown.append(root)
    return Model(prior, suffix, [_with_values(t, edges) for t in grown])


def _node(root: Tree, level: dict[int, Tree], at: dict[str, Column]) -> Column:
    """The number of the open node that a row falls into."""
    number = {id(t): k for k, t in level.items()}

    def walk(tree: Tree) -> Column:
        if tree.split is None:
            return F.lit(number.get(id(tree))).cast("int")
        feature, threshold, lower, upper = tree.split
        return F.when(at[feature] < threshold, walk(lower)).otherwise(walk(upper))

    return walk(root)


def _split(tree: Tree, sums: list[tuple], names: list[str], rate: float, l2: float) -> list[Tree]:
    """Sets the best split of a node by second-order gain, and the values of both sides."""
    best = None
    for f in names:
        own = sorted((b, g, h) for feature, b, g, h in sums if feature == f)
        all_g, all_h = sum(x[1] for x in own), sum(x[2] for x in own)
        left_g = left_h = 0.0
        for (_, g, h), (upper, _, _) in zip(own, own[1:]):
            left_g, left_h = left_g + g, left_h + h
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - all_g**2 / (all_h + l2)
            if min(left_h, right_h) >= 1 and gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, upper, Tree(rate * left_g / (left_h + l2)), Tree(rate * right_g / (right_h + l2)))
    if best is None:
        return []
    tree.split = best[1:]
    return [best[3], best[4]]


def _with_values(tree: Tree, edges: dict[str, list[float]]) -> Tree:
    if tree.split is None:
        return tree
    feature, upper, a, b = tree.split
    return Tree(split=(feature, edges[feature][upper - 1], _with_values(a, edges), _with_values(b, edges)))


def judge(urls: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """Adds host, path, rule, verdict and the model's ``logit``, in place of columns of these names."""
    decided = parts(urls.drop("rule", "verdict", "logit", "features")).withColumn("_ruled", ruled(rules))
    scored = with_features(decided, model.suffix).withColumn("logit", model.logit())
    blocked = F.coalesce(~F.col("_ruled.allow"), F.col("logit") > 0)
    return scored.withColumn("rule", F.col("_ruled.rule")).withColumn("verdict", F.when(blocked, "block").otherwise("allow")).drop("_ruled", "features")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", ["page_id", "url"])
    labelled = parts(pages).withColumn("_ruled", ruled()).filter("_ruled is not null").select("url", "host", "path", (~F.col("_ruled.allow")).alias("block"))
    return judge(pages, fit(labelled)).select("page_id", "host", "path", "rule", "verdict", "logit")
