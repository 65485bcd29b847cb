"""Sliding windows, sequences, bursts, chaining, alerts and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.tables import ADDRESS_SQL, DAY, HOUR, as_sshd, matches
from watchspan.operators.bursts import find_bursts
from watchspan.operators.chains import find_chains
from watchspan.operators.correlation import Correlation
from watchspan.operators.evidence import first_events
from watchspan.plans.detect import detect
from watchspan.rules import check_rules, rules_from_text

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query
    return keep


def shown(bursts: DataFrame) -> DataFrame:
    return bursts.select(F.get("grp", F.lit(0)).alias("entity"), "first_us", "trigger_us", "last_us",
                         "n_matches")


def burst_sql(source: str, fires: str, span: int, key: str = "entity") -> str:
    """Sessions by gap, first firing per session, members from one span before it."""
    return f"""
WITH m AS ({source}),
f AS (SELECT *, coalesce(t - lag(t) OVER w > {span}, TRUE) AS opens, ({fires}) AS fires FROM m
      WINDOW w AS (PARTITION BY {key} ORDER BY t, event_id)),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY {key} ORDER BY t, event_id) AS session FROM f),
g AS (SELECT *, min(CASE WHEN fires THEN t END) OVER (PARTITION BY {key}, session) AS trigger_us FROM s)
SELECT {key} AS entity, min(t) AS first_us, min(trigger_us) AS trigger_us, max(t) AS last_us,
       count(*) AS n_matches
FROM g WHERE t >= trigger_us - {span} GROUP BY {key}, session"""


def hits(types: str, entity: str = "user_id::VARCHAR") -> str:
    return (f"SELECT event_id, event_type, props, {entity} AS entity, epoch_us(ts) AS t FROM events "
            f"WHERE event_type IN ({types})")


@register("event_count_gte", burst_sql(hits("'error'"), f"coalesce(t - lag(t, 2) OVER w <= {DAY}, FALSE)", DAY))
def event_count_gte(spark, sf_dir):
    rule = Correlation("many_errors", "event_count", ["error"], ["user_id"], DAY, "gte", 3)
    return shown(find_bursts(matches(spark, sf_dir), [rule]))


@register("event_count_gt", burst_sql(hits("'error'"), f"coalesce(t - lag(t, 2) OVER w <= {12 * HOUR}, FALSE)", 12 * HOUR))
def event_count_gt(spark, sf_dir):
    rule = Correlation("more_errors", "event_count", ["error"], ["user_id"], 12 * HOUR, "gt", 2)
    return shown(find_bursts(matches(spark, sf_dir), [rule]))


@register("event_count_eq", burst_sql(
    hits("'error'"), f"coalesce(t - lag(t, 1) OVER w <= {DAY}, FALSE) AND NOT coalesce(t - lag(t, 2) OVER w <= {DAY}, FALSE)", DAY))
def event_count_eq(spark, sf_dir):
    rule = Correlation("two_errors", "event_count", ["error"], ["user_id"], DAY, "eq", 2)
    return shown(find_bursts(matches(spark, sf_dir), [rule]))


ALL_TYPES = "'click', 'error', 'purchase', 'signup', 'view'"
DISTINCT = ("count(DISTINCT {value}) OVER (PARTITION BY entity ORDER BY t "
            "RANGE BETWEEN {span} PRECEDING AND CURRENT ROW) >= {least}")


@register("value_count", burst_sql(
    hits(ALL_TYPES), DISTINCT.format(value="event_type", span=DAY, least=4), DAY))
def value_count(spark, sf_dir):
    rule = Correlation("all_kinds", "value_count", ["click", "error", "purchase", "signup", "view"],
                       ["user_id"], DAY, "gte", 4, "event_type")
    return shown(find_bursts(matches(spark, sf_dir), [rule]))


K = "json_extract_string(props, '$.k')"


@register("value_count_missing_values", burst_sql(
    f"SELECT *, CASE WHEN {K}::INT % 3 = 0 THEN NULL ELSE {K} END AS k FROM ({hits(ALL_TYPES)})",
    DISTINCT.format(value="k", span=12 * HOUR, least=3), 12 * HOUR))
def value_count_missing_values(spark, sf_dir):
    """Matches without a value count as members of a burst but not as a value."""
    k = F.get_json_object("props", "$.k")
    sparse = matches(spark, sf_dir, k=F.when(k.cast("int") % 3 == 0, F.when(k.cast("int") % 2 == 0, "-")
                                             .otherwise("")).otherwise(k))
    rule = Correlation("many_k", "value_count", ["click", "error", "purchase", "signup", "view"],
                       ["user_id"], 12 * HOUR, "gte", 3, "k")
    return shown(find_bursts(sparse, [rule]))


def latest(kind: str) -> str:
    return (f"coalesce(max(CASE WHEN event_type = '{kind}' THEN t END) OVER (PARTITION BY entity ORDER BY t, event_id)"
            f" >= t - {{span}}, FALSE)")


def both_sql(first: str, second: str, span: int, entity: str = "user_id::VARCHAR") -> str:
    fires = f"{latest(first)} AND {latest(second)}".format(span=span)
    return burst_sql(hits(f"'{first}', '{second}'", entity), fires, span)


@register("temporal", both_sql("error", "purchase", 12 * HOUR))
def temporal(spark, sf_dir):
    rule = Correlation("both", "temporal", ["error", "purchase"], ["user_id"], 12 * HOUR)
    return shown(find_bursts(matches(spark, sf_dir), [rule]))


@register("temporal_aliases", both_sql("error", "purchase", 6 * HOUR))
def temporal_aliases(spark, sf_dir):
    """Two kinds of rows that name the same entity differently meet under one alias."""
    base = matches(spark, sf_dir)
    errors = base.filter("rule = 'error'").withColumn("fields", F.create_map(F.lit("uid"), F.col("entity")))
    buys = base.filter("rule = 'purchase'").withColumn("fields", F.create_map(F.lit("cust"), F.col("entity")))
    rule = Correlation("cross", "temporal", ["error", "purchase"], ["who"], 6 * HOUR,
                       aliases={"who": {"error": "uid", "purchase": "cust"}})
    return shown(find_bursts(errors.unionByName(buys), [rule]))


@register("bag_union", burst_sql(
    f"{hits(chr(39) + 'signup' + chr(39) + ', ' + chr(39) + 'purchase' + chr(39))} "
    f"UNION ALL {hits(chr(39) + 'signup' + chr(39))}",
    "count(*) OVER (PARTITION BY entity ORDER BY t "
    f"RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW) >= 4", 12 * HOUR))
def bag_union(spark, sf_dir):
    """A rule listed twice counts twice."""
    rule = Correlation("bag", "event_count", ["signup", "purchase", "signup"], ["user_id"], 12 * HOUR, "gte", 4)
    return shown(find_bursts(matches(spark, sf_dir), [rule]))


@register("missing_group_values", burst_sql(
    f"SELECT * FROM ({hits(chr(39) + 'view' + chr(39))}) WHERE {K}::INT % 4 NOT IN (0, 1)",
    f"coalesce(t - lag(t, 1) OVER w <= {12 * HOUR}, FALSE)", 12 * HOUR))
def missing_group_values(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    key = F.when(k % 4 == 0, "").when(k % 4 == 1, "-").otherwise(F.col("user_id").cast("string"))
    rule = Correlation("pairs", "event_count", ["view"], ["key"], 12 * HOUR, "gte", 2)
    return shown(find_bursts(matches(spark, sf_dir, key=key), [rule]))


@register("global_event_count", burst_sql(
    hits("'error'", "'all'"), f"coalesce(t - lag(t, 9) OVER w <= {HOUR}, FALSE)", HOUR))
def global_event_count(spark, sf_dir):
    """No group-by: one group holds every match, spread over time slices."""
    rule = Correlation("storm", "event_count", ["error"], [], HOUR, "gte", 10)
    return shown(find_bursts(matches(spark, sf_dir), [rule])).withColumn("entity", F.lit("all"))


@register("merged_hits", burst_sql(hits("'click'"), "TRUE", 6 * HOUR))
def merged_hits(spark, sf_dir):
    rule = Correlation("click", "merge", ["click"], span_us=6 * HOUR)
    return shown(find_bursts(matches(spark, sf_dir), [rule]))


@register("merged_hits_five_minutes", burst_sql(hits(ALL_TYPES, "event_type"), "TRUE", 300_000_000))
def merged_hits_five_minutes(spark, sf_dir):
    """The fixed gap of plain alerts, with the event type as the entity: a few very large groups."""
    rows = matches(spark, sf_dir).withColumns({"entity": F.col("rule"), "rule": F.lit("any")})
    rule = Correlation("any", "merge", ["any"], span_us=300_000_000)
    return shown(find_bursts(rows, [rule]))


def chains(found: DataFrame) -> DataFrame:
    return found.select(F.get("grp", F.lit(0)).alias("entity"), "first_us", "last_us",
                        F.element_at("chain", 1)["match_id"].cast("bigint").alias("first_event"),
                        F.element_at("chain", -1)["match_id"].cast("bigint").alias("last_event"))


@register("ordered_two", f"""
WITH a AS ({hits("'error'")}), b AS ({hits("'purchase'")}),
n AS (SELECT a.entity, a.t AS first_us, a.event_id AS first_event, min(b.t) AS last_us,
             arg_min(b.event_id, b.t) AS last_event
      FROM a JOIN b ON a.entity = b.entity AND b.t >= a.t AND b.t <= a.t + {12 * HOUR}
      GROUP BY ALL)
SELECT entity, min(first_us) AS first_us, last_us, arg_min(first_event, first_us) AS first_event,
       any_value(last_event) AS last_event
FROM n GROUP BY entity, last_us""")
def ordered_two(spark, sf_dir):
    rule = Correlation("seq", "temporal_ordered", ["error", "purchase"], ["user_id"], 12 * HOUR)
    return chains(find_chains(matches(spark, sf_dir), [rule]))


def greedy_sql(steps: list[str], span: int) -> str:
    """Earliest continuation of every start, then starts accepted one after another per entity."""
    first, *rest = steps
    sql = f"WITH RECURSIVE e AS ({hits(ALL_TYPES)}), c0 AS (SELECT entity, t AS first_us, event_id AS first_event, t, event_id FROM e WHERE event_type = '{first}')"
    for i, step in enumerate(rest, 1):
        sql += f""",
c{i} AS (SELECT c.entity, c.first_us, c.first_event, min(e.t) AS t, arg_min(e.event_id, e.t) AS event_id
      FROM c{i - 1} c JOIN e ON e.entity = c.entity AND e.event_type = '{step}' AND e.t >= c.t
           AND e.event_id <> c.event_id AND e.t <= c.first_us + {span} GROUP BY ALL)"""
    last = len(rest)
    return sql + f""",
r AS (SELECT entity, first_us, t AS last_us, first_event, event_id AS last_event,
             row_number() OVER (PARTITION BY entity ORDER BY first_us) AS n FROM c{last}),
p AS (SELECT r.*, (SELECT min(q.n) FROM r q WHERE q.entity = r.entity AND q.first_us > r.last_us) AS follower FROM r),
g AS (SELECT * FROM p WHERE n = 1
      UNION ALL SELECT p.* FROM g JOIN p ON p.entity = g.entity AND p.n = g.follower)
SELECT entity, first_us, last_us, first_event, last_event FROM g"""


@register("ordered_three", greedy_sql(["view", "click", "purchase"], DAY))
def ordered_three(spark, sf_dir):
    rule = Correlation("funnel", "temporal_ordered", ["view", "click", "purchase"], ["user_id"], DAY)
    return chains(find_chains(matches(spark, sf_dir), [rule]))


@register("ordered_repeated", greedy_sql(["error", "error", "signup"], DAY))
def ordered_repeated(spark, sf_dir):
    rule = Correlation("again", "temporal_ordered", ["error", "error", "signup"], ["user_id"], DAY)
    return chains(find_chains(matches(spark, sf_dir), [rule]))


RULES = """
title: failed
name: failed
level: informational
logsource: {service: sshd}
detection:
  failed: {action: failed_password}
  condition: failed
---
title: accepted
name: accepted
level: informational
logsource: {service: sshd}
detection:
  accepted: {action: accepted}
  condition: accepted
---
title: got in as u7
name: got_in
level: medium
logsource: {service: sshd}
detection:
  accepted: {action: accepted}
  special: {user: u7}
  condition: accepted and special
---
title: guessing
name: guessing
level: high
alert: true
correlation: {type: event_count, rules: [failed], group-by: [src_ip], timespan: 1d, condition: {gte: 3}}
---
title: guessed
name: guessed
level: critical
correlation: {type: temporal_ordered, rules: [guessing, accepted], group-by: [src_ip], timespan: 1d}
"""
IP = ADDRESS_SQL
DETECTED_SQL = f"""
guessing AS ({burst_sql(hits("'error'", IP), f"coalesce(t - lag(t, 2) OVER w <= {DAY}, FALSE)", DAY)}),
got_in AS ({burst_sql(f"SELECT * FROM ({hits(chr(39) + 'purchase' + chr(39), IP)}) WHERE {K} = '7'", "TRUE", 300_000_000)}),
buys AS ({hits("'purchase'", IP)}),
steps AS (SELECT g.entity, g.trigger_us AS first_us, g.first_us AS from_us, g.last_us AS to_us, min(b.t) AS last_us,
                 arg_min(b.event_id, b.t) AS last_event
          FROM guessing g JOIN buys b ON g.entity = b.entity AND b.t >= g.trigger_us AND b.t <= g.trigger_us + {DAY}
          GROUP BY ALL),
guessed AS (SELECT entity, min(first_us) AS first_us, last_us, arg_min(from_us, first_us) AS from_us,
                   arg_min(to_us, first_us) AS to_us, any_value(last_event) AS last_event
            FROM steps GROUP BY entity, last_us),
errors AS ({hits("'error'", IP)}),
evidence AS (
  SELECT 'guessing' AS rule, g.entity, g.first_us, e.event_id, e.t, 0 AS step
  FROM guessing g JOIN errors e ON e.entity = g.entity AND e.t BETWEEN g.first_us AND g.last_us
  UNION ALL
  SELECT 'guessed', g.entity, g.first_us, e.event_id, e.t, 0
  FROM guessed g JOIN errors e ON e.entity = g.entity AND e.t BETWEEN g.from_us AND g.to_us
  UNION ALL
  SELECT 'guessed', entity, first_us, last_event, last_us, 1 FROM guessed
  UNION ALL
  SELECT 'got_in', g.entity, g.first_us, b.event_id, b.t, 0
  FROM got_in g JOIN buys b ON b.entity = g.entity AND b.t BETWEEN g.first_us AND g.last_us
   AND json_extract_string(b.props, '$.k') = '7')"""
ALERTS_SQL = f"""
WITH {DETECTED_SQL},
sizes AS (SELECT rule, entity, first_us, count(*) AS n_events FROM evidence GROUP BY ALL),
spans AS (SELECT 'guessing' AS rule, 'high' AS level, entity, first_us, trigger_us, last_us FROM guessing
          UNION ALL SELECT 'got_in', 'medium', entity, first_us, trigger_us, last_us FROM got_in
          UNION ALL SELECT 'guessed', 'critical', entity, first_us, last_us, last_us FROM guessed)
SELECT rule, level, entity, first_us, trigger_us, last_us, n_events FROM spans JOIN sizes USING (rule, entity, first_us)"""


def detected(spark, sf_dir):
    return detect(as_sshd(spark, sf_dir), check_rules(rules_from_text(RULES)))


@register("detect_alerts", ALERTS_SQL)
def detect_alerts(spark, sf_dir):
    """Rules on stored events, a correlation on a correlation, silencing, merging, counts."""
    return detected(spark, sf_dir).alerts.select(
        "rule", "level", F.get(F.map_values("grp"), F.lit(0)).alias("entity"),
        F.unix_micros("ts_first").alias("first_us"), F.unix_micros("ts_trigger").alias("trigger_us"),
        F.unix_micros("ts_last").alias("last_us"), F.col("count").alias("n_events"))


@register("detect_evidence", f"WITH {DETECTED_SQL} SELECT rule, entity, event_id FROM evidence")
def detect_evidence(spark, sf_dir):
    """Every event behind every alert, through the inner correlation too."""
    found = detected(spark, sf_dir)
    key = found.alerts.select("alert_id", F.get(F.map_values("grp"), F.lit(0)).alias("entity"))
    return found.evidence.join(key, "alert_id").select(
        "rule", "entity", F.col("event_id").cast("bigint").alias("event_id"))


@register("evidence_rank", f"""
WITH {DETECTED_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY rule, entity, first_us ORDER BY step, t, event_id) - 1 AS pos FROM evidence)
SELECT rule, entity, event_id, pos FROM ranked WHERE pos < 2""")
def evidence_rank(spark, sf_dir):
    """The first two events of every alert."""
    found = detected(spark, sf_dir)
    key = found.alerts.select("alert_id", F.get(F.map_values("grp"), F.lit(0)).alias("entity"))
    return first_events(found.evidence, 2).join(key, "alert_id").select(
        "rule", "entity", F.col("event_id").cast("bigint").alias("event_id"),
        F.col("pos").cast("bigint").alias("pos"))
