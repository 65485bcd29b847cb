"""What must hold for the physical plans, whatever the data."""

from helpers import event, event_table
from pyspark.sql import functions as F

from watchspan.operators.bursts import find_bursts
from watchspan.operators.correlation import Correlation
from watchspan.operators.evidence import first_events
from watchspan.operators.matching import match_events
from watchspan.rules import load_rules

MATCHES = "rule string, ts_us bigint, match_id string, entity string, fields map<string,string>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scan_per_source_and_only_needed_columns(spark, tmp_path):
    path = str(tmp_path / "events")
    event_table(spark, [event(0, s) for s in ("nginx", "ssh", "windows")]).write.partitionBy("source").parquet(path)
    text = plan(match_events(spark.read.parquet(path), load_rules()))
    assert text.count("FileScan") == 3
    for source in ("nginx", "ssh", "windows"):
        assert f"= {source})]" in text
    # No shipped rule looks at the raw line.
    assert "raw:string" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_any_number_of_count_correlations_takes_two_shuffles(spark):
    matches = spark.createDataFrame([], MATCHES)
    many = [Correlation(f"c{i}", "event_count", ["a"], ["g"], (i + 1) * 1_000_000, "gte", i) for i in range(40)]
    for chosen in (many[:1], many):
        text = plan(find_bursts(matches, chosen))
        assert text.count("Exchange hashpartitioning") == 2
        # Counted on the map side first, and by instant before anything is put in order.
        assert "partial_count" in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_top_of_an_alert_is_cut_before_it_is_shuffled(spark):
    evidence = spark.range(10_000).select(
        F.lit("r").alias("rule"), (F.col("id") % 2).cast("string").alias("alert_id"), F.col("id").cast("string").alias("event_id"), F.lit(0).alias("step"),
        F.col("id").alias("at_us"), F.lit("m").alias("member_id"), F.col("id").alias("ts_us"))
    assert plan(first_events(evidence, 1000)).count("Partial") >= 2
    assert sorted(r["pos"] for r in first_events(evidence, 3).collect()) == [0, 0, 1, 1, 2, 2]


def test_lookups_read_only_the_days_of_the_evidence(spark, tmp_path):
    from watchspan.plans.lookup import alert_events, events_of
    from watchspan.plans.score import shown_evidence

    path, day = str(tmp_path / "events"), 86_400
    rows = event_table(spark, [event(k * day, "ssh") for k in range(6)])
    rows.withColumns({"origin": F.lit("f"), "day": F.to_date("ts")}).write.partitionBy("source", "day").parquet(path)
    events = spark.read.parquet(path)
    third = events.orderBy("ts").collect()[2]
    evidence = spark.createDataFrame([("r", "x", third.event_id, 0, third.ts_us, "m", third.ts_us)],
                                     "rule string, alert_id string, event_id string, step int, at_us long, member_id string, ts_us long")
    for found in (alert_events("x", evidence, events), events_of(evidence, events), shown_evidence(evidence, events)):
        assert [r.event_id for r in found.collect()] == [third.event_id]
        text = plan(found)
        assert "dynamicpruning" in text, text
    assert events_of(evidence.select("event_id"), events).count() == 1
