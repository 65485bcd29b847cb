"""Window forms against the row-by-row models on random groups with many equal instants."""

import random

import brute_force
import pytest
from pyspark.sql import functions as F

from watchspan.operators import dense
from watchspan.operators.bursts import find_bursts
from watchspan.operators.chains import find_chains
from watchspan.operators.correlation import Correlation

GROUPS = 400
# Slices are at least a second wide; this unit makes most groups reach over several of them.
UNIT = 500_000


def random_groups(seed):
    rng = random.Random(seed)
    groups = {}
    for g in range(GROUPS):
        length = rng.choice([3, 8, 30])
        reach = rng.choice([4, 20, 80])
        rows = sorted((rng.randrange(reach) * UNIT, f"{i:03d}", rng.choice("aaabbc"),
                       rng.choice(["u", "v", "w", None, "-"])) for i in range(length))
        groups[f"g{g}"] = [(ts, rule, None if value == "-" else value, f"{g}-{ident}")
                           for ts, ident, rule, value in rows]
    return groups


def as_matches(spark, groups):
    rows = [(rule, ts, ident, "", {"g": g, **({"v": value} if value else {})})
            for g, members in groups.items() for ts, rule, value, ident in members]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "rule string, ts_us bigint, match_id string, entity string, "
                                       "fields map<string,string>")


def collected(df, *columns):
    return sorted((r["rule"], r["grp"][0], *[r[c] for c in columns]) for r in df.collect())


@pytest.fixture(scope="module")
def groups():
    return random_groups(7)


@pytest.fixture(scope="module")
def matches(spark, groups):
    return as_matches(spark, groups).cache()


@pytest.fixture(params=[dense.PER_BUCKET, 2])
def per_bucket(request, monkeypatch):
    """As it is, and so small that most groups are cut into many buckets."""
    monkeypatch.setattr(dense, "PER_BUCKET", request.param)
    monkeypatch.setattr(dense, "BLOCK", 3)


def test_counts_and_distinct_counts(groups, matches, per_bucket):
    correlations, expected = [], []
    for span in (0, 1, 2, 5, 8):
        for op in ("gte", "gt", "eq"):
            for threshold in (0, 1, 2, 3, 4):
                for kind in ("event_count", "value_count"):
                    name = f"{kind}/{span}/{op}/{threshold}"
                    correlations.append(Correlation(name, kind, ["a", "b", "c"], ["g"], span * UNIT,
                                                    op, threshold, "v" if kind == "value_count" else None))
                    model = getattr(brute_force, kind)
                    expected += [(name, g, *burst) for g, rows in groups.items()
                                 for burst in model(rows, span * UNIT, op, threshold)]
    found = collected(find_bursts(matches, correlations),
                      "first_us", "trigger_us", "last_us", "n_matches")
    assert found == sorted(expected)


def test_temporal(groups, matches, per_bucket):
    correlations, expected = [], []
    for span in (0, 1, 3, 8):
        for rules in ("ab", "abc", "c"):
            name = f"{rules}/{span}"
            correlations.append(Correlation(name, "temporal", list(rules), ["g"], span * UNIT))
            for g, rows in groups.items():
                rows = [r for r in rows if r[1] in rules]
                expected += [(name, g, *b) for b in brute_force.temporal(rows, span * UNIT, rules)]
    found = collected(find_bursts(matches, correlations),
                      "first_us", "trigger_us", "last_us", "n_matches")
    assert found == sorted(expected)


@pytest.mark.parametrize("rules", ["a", "ab", "abc", "aa", "aba", "aab", "aaa", "abb", "abab"])
def test_ordered(groups, matches, rules):
    correlations, expected = [], []
    for span in (0, 1, 3, 8):
        name = f"{rules}/{span}"
        correlations.append(Correlation(name, "temporal_ordered", list(rules), ["g"], span * UNIT))
        for g, rows in groups.items():
            rows = [r for r in rows if r[1] in rules]
            expected += [(name, g, *c) for c in brute_force.ordered(rows, span * UNIT, rules)]
    found = find_chains(matches, correlations)
    assert collected(found, "first_us", "last_us") == sorted(expected)


def test_bag_union_counts_a_rule_listed_twice(spark):
    matches = as_matches(spark, {"x": [(0, "a", None, "1"), (UNIT, "a", None, "2")]})
    twice = Correlation("t", "event_count", ["a", "a"], ["g"], 10 * UNIT, "gte", 4)
    assert collected(find_bursts(matches, [twice]), "n_matches") == [("t", "x", 4)]


def one_group(spark, instants, step, values=3):
    return spark.range(instants).select(
        F.lit("a").alias("rule"), (F.col("id") * step).alias("ts_us"), F.col("id").cast("string").alias("match_id"), F.lit("").alias("entity"),
        F.create_map(F.lit("g"), F.lit("hot"), F.lit("v"), (F.col("id") % values).cast("string")).alias("fields"))


def test_a_group_over_many_buckets_is_still_one_burst(spark, per_bucket, monkeypatch):
    if dense.PER_BUCKET == 2:
        monkeypatch.setattr(dense, "PER_BUCKET", 700)
    every = Correlation("n", "event_count", ["a"], [], 1_000_000, "gte", 4)
    kinds = Correlation("d", "value_count", ["a"], ["g"], 1_000_000, "gte", 3, "v")
    found = sorted((r["rule"], r["grp"], r["first_us"], r["trigger_us"], r["last_us"], r["n_matches"])
                   for r in find_bursts(one_group(spark, 20_000, 300_000), [every, kinds]).collect())
    last = 19_999 * 300_000
    assert found == [("d", ["hot"], 0, 600_000, last, 20_000), ("n", [], 0, 900_000, last, 20_000)]


def test_a_dense_group_inside_one_span_is_spread_over_tasks(spark, monkeypatch):
    """200,000 instants, all live at once: no bucket holds more than a few per cent of them or of the ends of their spans."""
    monkeypatch.setattr(dense, "PER_BUCKET", 10_000)
    rows, span = one_group(spark, 200_000, 1, 50), 1_000_000
    every = Correlation("n", "event_count", ["a"], [], span, "gte", 150_001)
    kinds = Correlation("d", "value_count", ["a"], ["g"], span, "gte", 50, "v")
    found = sorted((r["rule"], r["first_us"], r["trigger_us"], r["last_us"], r["n_matches"]) for r in find_bursts(rows, [every, kinds]).collect())
    assert found == [("d", 0, 49, 199_999, 200_000), ("n", 0, 150_000, 199_999, 200_000)]
    points = rows.select(F.lit("n").alias("corr"), F.array().cast("array<string>").alias("grp"), F.explode(F.array("ts_us", F.col("ts_us") + span)).alias("at"))
    sizes = [r["count"] for r in dense.placed(points, dense.cuts_of(points), "at").groupBy("bucket").count().collect()]
    assert sum(sizes) == 400_000 and max(sizes) < 0.04 * sum(sizes)


def test_leaving_out_idle_groups_changes_nothing(matches):
    windowed = [Correlation("n", "event_count", ["a", "c"], ["g"], 2 * UNIT, "gte", 4),
                Correlation("q", "event_count", ["a"], ["g"], 2 * UNIT, "eq", 0),
                Correlation("e", "event_count", ["a", "b"], ["g"], 2 * UNIT, "eq", 3),
                Correlation("d", "value_count", ["a", "b"], ["g"], 2 * UNIT, "gt", 2, "v"),
                Correlation("t", "temporal", ["a", "b", "c"], ["g"], 3 * UNIT)]
    plain, pruned = (collected(find_bursts(matches, windowed, prune), "first_us", "trigger_us", "last_us",
                               "n_matches") for prune in (False, True))
    assert plain == pruned and {r[0] for r in plain} == {"n", "e", "d", "t"}
    ordered = [Correlation("o", "temporal_ordered", ["a", "b"], ["g"], UNIT),
               Correlation("p", "temporal_ordered", ["a", "b", "a"], ["g"], 2 * UNIT)]
    plain, pruned = (collected(find_chains(matches, ordered, prune), "first_us", "last_us")
                     for prune in (False, True))
    assert plain == pruned and {r[0] for r in plain} == {"o", "p"}
