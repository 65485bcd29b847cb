"""Made-up events for tests: a warehouse with doors, badges and a few log sources."""

from datetime import datetime, timezone
from itertools import count

from pyspark.sql import functions as F

from watchspan.plans.detect import by_time, detect
from watchspan.rules import check_rules, rules_from_text

OPENING = datetime(2031, 3, 2, 4, 30, tzinfo=timezone.utc)
T0 = int(OPENING.timestamp())
LAYOUT = {"event_id": "string", "ts_us": "bigint", "source": "string", "host": "string", "fields": "map<string,string>", "raw": "string"}
serial = count(start=700_001, step=3)


def event(seconds, source="ssh", host="gate-a", raw="-", **fields):
    """``seconds`` after the warehouse opens."""
    moment = T0 * 1_000_000 + round(seconds * 1_000_000)
    texts = dict(zip(fields, map(str, fields.values())))
    return dict(zip(LAYOUT, (f"w{next(serial)}", moment, source, host, texts, raw)))


def badge(seconds, result, reader="192.0.2.40", holder="ines"):
    """A badge held to a reader: ``refused`` or ``opened``."""
    return event(seconds, action=result, src_ip=reader, user=holder)


def event_table(spark, rows):
    schema = ", ".join(f"{name} {kind}" for name, kind in LAYOUT.items())
    table = spark.createDataFrame([[row[name] for name in LAYOUT] for row in rows], schema)
    return table.withColumn("ts", F.timestamp_micros("ts_us"))


def rules(text):
    return check_rules(rules_from_text(text))


def alerts(spark, rule_list, rows):
    return by_time(detect(event_table(spark, rows), rule_list).alerts).collect()
