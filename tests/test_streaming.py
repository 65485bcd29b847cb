from helpers import T0, badge, event_table, rules
from pyspark.sql import functions as F

from watchspan.operators.matching import match_events
from watchspan.streaming.hits import event_stream, hit_stream, merged_hit_stream

ROOT = """
title: root
name: root
logsource: {service: sshd}
detection:
  s: {action: accepted, user: ines}
  condition: s
"""


def drain(stream, spark, name, checkpoint):
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination(120)
    return spark.table(name)


def test_streams_give_what_the_batch_gives(spark, tmp_path):
    chosen = rules(ROOT)
    path = str(tmp_path / "events")

    def store(rows):
        (event_table(spark, rows).withColumns({"origin": F.lit("f"), "day": F.to_date("ts")})
         .write.mode("append").partitionBy("source", "day").parquet(path))

    store([badge(0, "accepted"), badge(300, "accepted"), badge(601, "accepted"), badge(5, "failed_password"), badge(10, "accepted", reader="9.9.9.9")])
    store([badge(90_000, "accepted")])
    hits = drain(hit_stream(event_stream(spark, path), chosen), spark, "hits", str(tmp_path / "c1"))
    batch = match_events(spark.read.parquet(path), chosen)
    assert sorted(hits.drop("ts").select("rule", "match_id", "entity").collect()) == sorted(
        batch.select("rule", "match_id", "entity").collect())
    merged = drain(merged_hit_stream(hit_stream(event_stream(spark, path, 1), chosen)), spark, "merged", str(tmp_path / "c2"))
    closed = sorted((r["entity"], round(r["ts_first"].timestamp()) - T0, r["count"]) for r in merged.collect())
    # The last hit may still grow.
    assert [c for c in closed if c[1] < 90_000] == [("192.0.2.40", 0, 2), ("192.0.2.40", 601, 1), ("9.9.9.9", 10, 1)]
