"""Streamed correlations against the batch form on the same hits in random order."""

import random

import pytest
from pyspark.sql import functions as F
from test_correlations_random import UNIT, as_matches, random_groups

from watchspan.operators.bursts import find_bursts
from watchspan.operators.chains import find_chains
from watchspan.operators.correlation import Correlation
from watchspan.streaming.correlations import STORE, correlation_stream

CORRELATIONS = [
    Correlation("n", "event_count", ["a", "c"], ["g"], 2 * UNIT, "gte", 4),
    Correlation("e", "event_count", ["a", "b"], ["g"], 2 * UNIT, "eq", 3),
    Correlation("d", "value_count", ["a", "b"], ["g"], 5 * UNIT, "gt", 2, "v"),
    Correlation("t", "temporal", ["a", "b", "c"], ["g"], 3 * UNIT),
    Correlation("o", "temporal_ordered", ["a", "b"], ["g"], UNIT),
    Correlation("p", "temporal_ordered", ["a", "b", "a"], ["g"], 4 * UNIT),
    Correlation("q", "temporal_ordered", ["a", "b", "c"], ["g"], 8 * UNIT),
    Correlation("all", "event_count", ["c"], [], UNIT, "gte", 5),
]
# Times at or before the epoch are late from the start.
BASE = 1_000_000 * UNIT
COLUMNS = ["rule", "grp", "first_us", "trigger_us", "last_us", "n_matches", "alert_id"]


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    yield
    spark.conf.set(key, before)


def run(spark, path, tmp_path, name, lateness):
    schema = spark.read.parquet(path).schema
    stream = correlation_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), CORRELATIONS, lateness)
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / f"checkpoint-{name}")).trigger(availableNow=True).start())
    query.awaitTermination(600)
    assert not query.exception()
    return spark.table(name), query.recentProgress


def test_shuffled_batches_give_the_rows_of_the_batch_job(spark, store, tmp_path):
    groups = {g: [(BASE + ts, *rest) for ts, *rest in members] for g, members in list(random_groups(11).items())[:60]}
    path, rng = str(tmp_path / "hits"), random.Random(2)
    rows = as_matches(spark, groups).collect()
    rng.shuffle(rows)
    late = [r for r in rows if r.ts_us >= BASE + 40 * UNIT]
    # The second half of time comes last; within each part any order is possible.
    for part in ([r for r in rows if r.ts_us < BASE + 40 * UNIT][0::2], [r for r in rows if r.ts_us < BASE + 40 * UNIT][1::2], late):
        spark.createDataFrame(part, as_matches(spark, {}).schema).coalesce(1).write.mode("append").parquet(path)
    expected = (find_bursts(spark.read.parquet(path), [c for c in CORRELATIONS if c.kind != "temporal_ordered"]).select(*COLUMNS).collect()
                + find_chains(spark.read.parquet(path), [c for c in CORRELATIONS if c.kind == "temporal_ordered"]).select(*COLUMNS).collect())
    end = BASE + 10_000 * UNIT  # a hit far ahead, of no other consequence, moves the watermark past all
    as_matches(spark, {"z": [(end, "a", None, "z-0")]}).coalesce(1).write.mode("append").parquet(path)
    found, progress = run(spark, path, tmp_path, "found", "40 seconds")
    assert {r.rule for r in expected} == {c.name for c in CORRELATIONS}
    assert sorted(found.select(*COLUMNS).collect()) == sorted(expected)
    # All that is left is the hit far ahead: a row that waits or lies in a window for each correlation that takes it.
    assert progress[-1].stateOperators[0].numRowsTotal <= 3 * len(CORRELATIONS)


def test_bursts_come_once_the_watermark_has_passed_their_span(spark, store, tmp_path):
    path = str(tmp_path / "hits")
    first = [(BASE + k * UNIT, "a", None, f"x-{k}") for k in range(6)]
    for group in (first, [(BASE + 200 * UNIT, "b", None, "x-6")], [(BASE + 201 * UNIT, "b", None, "x-7")]):
        as_matches(spark, {"x": group}).coalesce(1).write.mode("append").parquet(path)
    found, _ = run(spark, path, tmp_path, "early", "10 seconds")
    assert found.filter(F.col("rule") == "e").count() == 1
