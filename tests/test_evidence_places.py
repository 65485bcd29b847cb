"""Numbers of the events behind an alert."""

import random

from pyspark.sql import functions as F

from watchspan.operators.evidence import numbered

COLUMNS = "rule string, alert_id string, event_id string, step int, at_us bigint, member_id string, ts_us bigint"


def test_places_in_one_huge_alert_and_many_small_ones(spark):
    dice = random.Random(11)
    # Most events of the huge alert share one instant and one member.
    rows = [("r", "huge", f"e{k}", 0, 5 if k % 3 else dice.randrange(9), "m" if k % 2 else f"m{k}", dice.randrange(4)) for k in range(6000)]
    rows += [("r", f"a{k % 50}", f"s{k}", k % 2, dice.randrange(3), None if k % 7 == 0 else "m", 1) for k in range(400)]
    dice.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(spark.createDataFrame(rows, COLUMNS).repartition(5))
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        found = {(r.alert_id, r.event_id): r.pos for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.columns == [*COLUMNS.replace(",", "").split()[::2], "pos"]
    assert len(sizes) > 3 and max(sizes) < len(rows) / 2
    by_alert = {}
    for row in rows:
        by_alert.setdefault(row[1], []).append(row)
    want = {}
    for alert, own in by_alert.items():
        own.sort(key=lambda r: (r[3], r[4], r[5] is not None, r[5] or "", r[6], r[2]))
        want |= {(alert, r[2]): n for n, r in enumerate(own)}
    assert found == want


def test_no_evidence(spark):
    assert numbered(spark.createDataFrame([], COLUMNS)).count() == 0
