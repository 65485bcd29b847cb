"""How often detection goes through what it reads; results are compared elsewhere."""

from checks import shipped
from watchspan.operators import dense
from watchspan.operators.matching import match_events
from watchspan.plans.detect import detect
from watchspan.rules import load_rules


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_scenes_are_sent_to_the_events_however_many_there_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "150000")
    try:
        found = plan(shipped.scenes(spark, "/root/testdata/sf0.1"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in found and "SortMergeJoin" not in found


def test_matches_are_not_grouped_again_to_look_for_dense_groups(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(dense, "has_dense_groups", lambda points: asked.append(plan(points)) or False)
    detect(match_scenes(spark), load_rules())
    assert len(asked) == 2 and not any("Join" in p or "Aggregate" in p for p in asked)


def test_evidence_that_a_later_level_looks_up_is_kept(spark):
    kept = []
    found = detect(match_scenes(spark), load_rules(), keep=lambda df: kept.append(df.columns) or stored(df))
    assert any("event_id" in columns and "member_id" in columns for columns in kept)
    rows = found.evidence.join(found.alerts.filter("rule = 'ssh_compromise'"), "alert_id", "left_semi").groupBy("alert_id").count().collect()
    assert rows and {r["count"] for r in rows} == {9}


def match_scenes(spark):
    events = shipped.scenes(spark, "/root/testdata/sf0.001")
    assert not match_events(events, load_rules()).isEmpty()
    return events


def stored(df):
    from watchspan.session import stable_storage
    return stable_storage(df)
