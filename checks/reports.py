"""Lookups, searches, summaries and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.tables import address, events, table, text_id, utc
from watchspan.plans import lookup, score, summary
from watchspan.rules import build_rule
from watchspan.schema import LEVELS, level_rank

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query
    return keep


# Every event stands for an alert; its type decides rule and level.
LEVEL_OF = {"click": "informational", "view": "low", "signup": "medium", "purchase": "high", "error": "critical"}
RANK_SQL = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"
LEVEL_SQL = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in LEVEL_OF.items()) + " END"


def alerts(spark, sf_dir) -> DataFrame:
    level = F.element_at(F.create_map(*[F.lit(x) for pair in LEVEL_OF.items() for x in pair]), F.col("event_type"))
    user = F.when(F.col("user_id") % 10 == 0, "-").otherwise(F.concat(F.lit("user "), F.col("user_id")))
    return events(spark, sf_dir).select(
        text_id().alias("alert_id"), F.col("event_type").alias("rule"),
        F.concat(F.lit("Seen: "), "event_type").alias("title"), level.alias("level"), level_rank(level).alias("level_rank"),
        F.lit("").alias("description"), F.array().cast("array<string>").alias("tags"), F.lit("rule").alias("kind"),
        utc().alias("ts_first"), utc().alias("ts_last"), utc().alias("ts_trigger"),
        F.floor("value").cast("bigint").alias("count"),
        F.create_map(F.lit("who"), user, F.lit("k"), F.get_json_object("props", "$.k")).alias("grp"),
        F.array(text_id()).alias("event_ids"))


def chosen(df: DataFrame) -> DataFrame:
    return df.select(F.col("alert_id").cast("bigint").alias("id"), "rule", "level")


@register("scan_source", "SELECT doc_id, lang FROM documents WHERE source = 'src3'")
def scan_source(spark, sf_dir):
    return lookup.scan_events(table(spark, sf_dir, "documents"), "src3").select("doc_id", "lang")


@register("scan_days", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09' AND event_type = 'view'")
def scan_days(spark, sf_dir):
    """A source between two days, both included."""
    stored = events(spark, sf_dir).withColumns({"day": F.to_date(utc()), "source": F.col("event_type")})
    return lookup.scan_events(stored, "view", "2024-01-05", "2024-01-08").select("event_id", "event_type")


@register("count_events", "SELECT count(*) AS events FROM events")
def count_events(spark, sf_dir):
    return lookup.count_events(events(spark, sf_dir))


@register("events_by_id", "SELECT event_id, event_type FROM events WHERE event_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def events_by_id(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("event_id"))
    return lookup.events_of(ids, events(spark, sf_dir)).select("event_id", "event_type")


def stored_documents(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select(text_id("doc_id").alias("event_id"), (F.lit(1704067200) + F.col("doc_id") % 977).cast("timestamp").alias("ts"),
                       F.when(F.col("lang") == "en", "nginx").when(F.col("lang") == "de", "ssh").otherwise("windows").alias("source"),
                       F.col("text").alias("raw"))


DOC_SOURCE = "CASE lang WHEN 'en' THEN 'nginx' WHEN 'de' THEN 'ssh' ELSE 'windows' END"


@register("search_events", """
SELECT doc_id AS id FROM documents WHERE lang = 'en' AND contains(lower(text), 'tion on')
ORDER BY doc_id % 977 DESC, doc_id DESC""")
def search_events(spark, sf_dir):
    found = lookup.search_events(stored_documents(spark, sf_dir), "nginx", "Tion ON")
    return found.select(F.col("event_id").cast("bigint").alias("id"))


@register("search_events_no_wildcards", r"""
SELECT doc_id AS id FROM documents WHERE contains(lower(text), '%%% ') OR FALSE ORDER BY doc_id % 977 DESC, doc_id DESC""")
def search_events_no_wildcards(spark, sf_dir):
    """An unknown source is no restriction, and a percent sign is a percent sign."""
    found = lookup.search_events(stored_documents(spark, sf_dir), "mainframe", "%%% ")
    return found.select(F.col("event_id").cast("bigint").alias("id"))


@register("alerts_by_time", f"SELECT event_id AS id, event_type AS rule, {LEVEL_SQL} AS level FROM events ORDER BY ts, event_id")
def alerts_by_time(spark, sf_dir):
    return chosen(lookup.alerts_by_time(alerts(spark, sf_dir)))


@register("alerts_at_least", f"SELECT event_id AS id, event_type AS rule, {LEVEL_SQL} AS level FROM events WHERE {RANK_SQL} >= 3")
def alerts_at_least(spark, sf_dir):
    return chosen(lookup.at_least(alerts(spark, sf_dir), "high"))


@register("search_alerts", f"""
SELECT event_id AS id, event_type AS rule, {LEVEL_SQL} AS level FROM events
WHERE {RANK_SQL} >= 1 AND (contains(event_type, '"k": "1') OR contains(concat('{{"k": "', json_extract_string(props, '$.k'), '", "who": "', CASE WHEN user_id % 10 = 0 THEN '-'
  ELSE concat('user ', user_id) END, '"}}'), '"k": "1'))
ORDER BY {RANK_SQL} DESC, ts, event_id""")
def search_alerts(spark, sf_dir):
    """The term is looked for in the group as it is printed."""
    return chosen(lookup.search_alerts(alerts(spark, sf_dir), "low", '"K": "1'))


@register("alerts_as_json", f"""
SELECT event_id AS id, event_type AS rule, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time, floor(value)::BIGINT AS n,
       json_extract_string(props, '$.k') AS k FROM events""")
def alerts_as_json(spark, sf_dir):
    text = lookup.alerts_json(alerts(spark, sf_dir))
    value = {name: F.get_json_object("json", path) for name, path in
             (("rule", "$.rule"), ("time", "$.time"), ("n", "$.count"), ("k", "$.grp.k"))}
    return text.select(F.col("alert_id").cast("bigint").alias("id"), value["rule"].alias("rule"), value["time"].alias("time"),
                       value["n"].cast("bigint").alias("n"), value["k"].alias("k"))


@register("alerts_as_text", f"""
SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time, {LEVEL_SQL} AS level, event_type AS rule,
       floor(value)::BIGINT AS n, concat('who=', CASE WHEN user_id % 10 = 0 THEN '-' ELSE concat('user ', user_id) END,
       ', k=', json_extract_string(props, '$.k')) AS grp FROM events""")
def alerts_as_text(spark, sf_dir):
    return lookup.alerts_text(alerts(spark, sf_dir)).select(
        F.col("alert_id").cast("bigint").alias("id"), "time", "level", "rule", F.col("count").alias("n"),
        F.col("group").alias("grp"))


def user_evidence(spark, sf_dir) -> DataFrame:
    """One alert per user with all of their events behind it."""
    us = F.unix_micros(utc())
    return events(spark, sf_dir).select(
        F.lit("user").alias("rule"), F.col("user_id").cast("string").alias("alert_id"), text_id().alias("event_id"),
        F.lit(0).alias("step"), us.alias("at_us"), text_id().alias("member_id"), us.alias("ts_us"))


@register("alert_events", """
SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events WHERE user_id = 7
ORDER BY ts, event_id""")
def alert_events(spark, sf_dir):
    stored = events(spark, sf_dir).withColumns({"event_id": text_id(), "ts": utc()})
    return lookup.alert_events("7", user_evidence(spark, sf_dir), stored).select(
        F.col("event_id").cast("bigint").alias("event_id"), "event_type", F.col("pos").cast("bigint").alias("pos"))


@register("events_by_source", f"SELECT {DOC_SOURCE} AS source, count(*) AS events FROM documents GROUP BY 1")
def events_by_source(spark, sf_dir):
    return summary.events_by_source(stored_documents(spark, sf_dir))


@register("events_range", """
SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last, count(*) AS events FROM events""")
def events_range(spark, sf_dir):
    return summary.events_range(events(spark, sf_dir).withColumn("ts", utc()))


LEVELS_SQL = "(VALUES " + ", ".join(f"('{name}')" for name in LEVELS) + ") AS l(level)"


@register("alerts_by_level", f"""
SELECT level, coalesce(n, 0) AS alerts FROM {LEVELS_SQL}
LEFT JOIN (SELECT replace({LEVEL_SQL}, 'medium', 'high') AS level, count(*) AS n FROM events GROUP BY 1) USING (level)""")
def alerts_by_level(spark, sf_dir):
    """No alert is of the medium level."""
    return summary.alerts_by_level(alerts(spark, sf_dir).withColumn("level", F.replace("level", F.lit("medium"), F.lit("high"))))


@register("alerts_by_rule", "SELECT event_type AS rule, count(*) AS alerts FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def alerts_by_rule(spark, sf_dir):
    return summary.alerts_by_rule(alerts(spark, sf_dir))


@register("top_entities", f"""
WITH e AS (SELECT CASE WHEN user_id % 10 <> 0 THEN concat('user ', user_id) END AS entity, {RANK_SQL} AS rank FROM events
           UNION ALL SELECT json_extract_string(props, '$.k'), {RANK_SQL} FROM events)
SELECT entity, count(*) AS alerts, (list_value({', '.join(repr(x) for x in LEVELS)}))[max(rank) + 1] AS worst
FROM e WHERE entity IS NOT NULL GROUP BY entity ORDER BY max(rank) DESC, alerts DESC, entity LIMIT 8""")
def top_entities(spark, sf_dir):
    return summary.top_entities(alerts(spark, sf_dir))


def timeline_sql(where: str, size: int) -> str:
    counts = ", ".join(f"count(*) FILTER (level = '{name}') AS {name}" for name in LEVELS)
    filled = ", ".join(f"coalesce({name}, 0) AS {name}" for name in LEVELS)
    return f"""
WITH a AS (SELECT epoch(date_trunc('second', ts))::BIGINT // {size} * {size} AS bucket, {LEVEL_SQL} AS level FROM events WHERE {where}),
c AS (SELECT bucket, {counts} FROM a GROUP BY bucket),
s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM a), (SELECT max(bucket) FROM a), {size})) AS bucket)
SELECT strftime(make_timestamp(bucket * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS t, {size}::BIGINT AS bucket_seconds, {filled}
FROM s LEFT JOIN c USING (bucket)"""


@register("timeline_daily", timeline_sql("TRUE", 86400))
def timeline_daily(spark, sf_dir):
    return summary.timeline(alerts(spark, sf_dir))


@register("timeline_hourly", timeline_sql("ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 12:00:00'", 3600))
def timeline_hourly(spark, sf_dir):
    """A range of two and a half days is what the hourly form is for."""
    return summary.timeline(alerts(spark, sf_dir).filter("ts_first >= '2024-01-10' and ts_first < '2024-01-12 12:00:00'"))


RULE_NAMES = ["error", "purchase", "never"]


@register("rules_with_counts", """
SELECT rule, title, level, coalesce(n, 0) AS alerts FROM
 (VALUES ('error', 'Rule error', 'high'), ('purchase', 'Rule purchase', 'high'), ('never', 'Rule never', 'high')) AS r(rule, title, level)
LEFT JOIN (SELECT event_type AS rule, count(*) AS n FROM events GROUP BY 1) USING (rule)""")
def rules_with_counts(spark, sf_dir):
    rules = [build_rule({"title": f"Rule {name}", "name": name, "level": "high", "logsource": {"service": "sshd"},
                         "detection": {"s": {"action": name}, "condition": "s"}}) for name in RULE_NAMES]
    return summary.rules_with_counts(spark, rules, alerts(spark, sf_dir)).select("rule", "title", "level", "alerts")


# Scoring: one alert per user and event type. Every third user is a scenario. Users divisible by four have
# no address in their events and are recognised by host and time instead.
PLAIN_USER = "user_id % 4 = 0"


def scored(spark, sf_dir):
    rows = events(spark, sf_dir)
    us = F.unix_micros(utc())
    alert_id = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    hidden = F.expr(PLAIN_USER)
    found = rows.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("count"), F.min(utc()).alias("ts_first"), F.max(utc()).alias("ts_last")).select(
        alert_id.alias("alert_id"), F.col("event_type").alias("rule"), F.lit("high").alias("level"), "count",
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("grp"), "ts_first", "ts_last",
        F.col("ts_last").alias("ts_trigger"))
    evidence = rows.select(F.col("event_type").alias("rule"), alert_id.alias("alert_id"), text_id().alias("event_id"),
                           F.lit(0).alias("step"), us.alias("at_us"), text_id().alias("member_id"), us.alias("ts_us"))
    stored = rows.select(text_id().alias("event_id"), F.concat(F.lit("host"), F.col("user_id")).alias("host"),
                         F.when(~hidden, F.create_map(F.lit("SRC_IP"), address(F.col("user_id")))).otherwise(
                             F.create_map(F.lit("src_ip"), F.lit("-"))).alias("fields"))
    seconds = us / 1_000_000
    scenarios = rows.filter("user_id % 3 = 0").groupBy("user_id").agg(
        F.min(seconds).alias("start"), F.max(seconds).alias("end")).select(
        F.col("user_id").alias("scenario_id"), F.concat(F.lit("user "), F.col("user_id")).alias("name"),
        F.when(hidden, F.array().cast("array<string>")).otherwise(F.array(address(F.col("user_id")))).alias("ips"),
        F.when(hidden, F.concat(F.lit("host"), F.col("user_id"))).otherwise("").alias("host"),
        (F.col("start") + F.when(F.col("user_id") % 8 == 0, 86400).otherwise(0)).alias("start"), "end",
        F.array(F.lit("error"), F.lit("purchase"), F.lit("never")).alias("expect"))
    benign = rows.filter("user_id % 3 <> 0").agg(F.count(F.lit(1)).alias("benign_events"))
    return score.score(found, evidence, stored, scenarios, benign)


SCORED_SQL = f"""
a AS (SELECT user_id, event_type AS rule, count(*) AS n, min(ts) AS ts_first, max(ts) AS ts_trigger FROM events GROUP BY ALL),
s AS (SELECT user_id, epoch_us(min(ts)) / 1000000 + CASE WHEN user_id % 8 = 0 THEN 86400 ELSE 0 END AS start,
             epoch_us(max(ts)) / 1000000 AS stop FROM events WHERE user_id % 3 = 0 GROUP BY user_id),
i AS (SELECT a.*, s.start FROM a JOIN s ON a.user_id = s.user_id AND
      (NOT a.{PLAIN_USER} OR epoch_us(ts_first) / 1000000 BETWEEN s.start - 120 AND s.stop + 120)),
x AS (SELECT user_id, start, unnest(['error', 'purchase', 'never']) AS rule FROM s),
e AS (SELECT x.user_id, x.rule, i.user_id IS NOT NULL AS detected,
             round_even(epoch_us(i.ts_trigger) / 1000000 - x.start, 1) AS seconds
      FROM x LEFT JOIN i ON i.user_id = x.user_id AND i.rule = x.rule),
u AS (SELECT a.*, i.user_id IS NOT NULL AS touched FROM a LEFT JOIN i USING (user_id, rule)
      WHERE NOT (i.user_id IS NOT NULL AND a.rule IN ('error', 'purchase')))"""


@register("score_expectations", f"""
WITH {SCORED_SQL}
SELECT concat('user ', user_id) AS scenario, rule, detected, seconds AS seconds_to_detect,
       CASE WHEN detected THEN concat(user_id, '/', rule) END AS alert_id FROM e""")
def score_expectations(spark, sf_dir):
    return scored(spark, sf_dir).expectations.select("scenario", "rule", "detected", "seconds_to_detect", "alert_id")


@register("score_unexpected", f"""
WITH {SCORED_SQL}
SELECT concat(user_id, '/', rule) AS alert_id, rule, strftime(ts_first, '%Y-%m-%dT%H:%M:%SZ') AS time, n,
       CASE WHEN touched THEN concat('user ', user_id) ELSE '' END AS scenarios,
       CASE WHEN touched THEN 'extra' ELSE 'false positive' END AS verdict FROM u""")
def score_unexpected(spark, sf_dir):
    return scored(spark, sf_dir).unexpected.select(
        "alert_id", "rule", "time", F.col("count").alias("n"), F.array_join("scenarios", ", ").alias("scenarios"), "verdict")


@register("score_totals", f"""
WITH {SCORED_SQL}
SELECT (SELECT count(*) FROM e WHERE detected) AS detected, (SELECT count(*) FROM e) AS expected,
       (SELECT count(*) FILTER (detected) * 100 / count(*) FROM e) AS percent,
       (SELECT count(*) FROM u WHERE touched) AS extra_alerts, (SELECT count(*) FROM u WHERE NOT touched) AS false_positives,
       (SELECT count(*) FROM a) AS total_alerts, (SELECT count(*) FROM events WHERE user_id % 3 <> 0) AS benign_events""")
def score_totals(spark, sf_dir):
    return scored(spark, sf_dir).totals
