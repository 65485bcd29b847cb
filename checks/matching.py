"""Field tests, conditions, routing and the one-pass matcher over texts and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.tables import address, as_sshd, events, table, text_id, utc
from watchspan.functions.network import in_network, ipv4_value
from watchspan.operators.matching import match_events
from watchspan.operators.networks import with_network
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


def rule_file(logsource: str, detections: dict[str, str]) -> str:
    return "\n---\n".join(f"title: {name}\nname: {name}\nlogsource: {logsource}\ndetection:\n{body}"
                          for name, body in detections.items())


def hits(stored: DataFrame, logsource: str, detections: dict[str, str]) -> DataFrame:
    rules = check_rules(rules_from_text(rule_file(logsource, detections)))
    return match_events(stored, rules).select("rule", F.col("match_id").cast("bigint").alias("id"))


def union_sql(table_name: str, key: str, tests: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS rule, {key} AS id FROM {table_name} WHERE {test}"
                              for name, test in tests.items())


def stored_texts(rows: DataFrame, key: str, raw: str, *columns: str) -> DataFrame:
    fields = F.create_map(*[c for name in columns for c in (F.lit(name), F.col(name).cast("string"))])
    return rows.select(text_id(key).alias("event_id"), F.lit(0).cast("bigint").alias("ts_us"),
                       F.lit("nginx").alias("source"), F.lit("web").alias("host"),
                       F.map_filter(fields, lambda k, v: v.isNotNull()).alias("fields"), F.col(raw).alias("raw"))


def documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn(
        "note", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, "").otherwise("given"))
    return stored_texts(rows, "doc_id", "text", "text", "lang", "source", "n_chars", "note")


WEB = "{category: webserver}"


@register("match_text_tests", union_sql("documents", "doc_id", {
    "contains_any": "contains(lower(text), 'token') OR contains(lower(text), 'copyright')",
    "contains_all": "contains(lower(text), 'the') AND contains(lower(text), 'license')",
    "contains_wildcard": "regexp_matches(lower(text), '(?s)token.*\"')",
    "starts": "starts_with(lower(text), 'the ') OR starts_with(lower(text), 'el')",
    "ends": "suffix(lower(text), 's.') OR suffix(lower(text), 'e.')",
    "equal_any_case": "lower(lang) = 'en'",
    "equal_number": "source = 'src3' AND n_chars IN (416, 380)",
    "wildcard": "lang LIKE 'e_' AND source LIKE 'src%5'",
    "empty_list": "FALSE",
    "empty_map": "TRUE",
}))
def match_text_tests(spark, sf_dir):
    return hits(documents(spark, sf_dir), WEB, {
        "contains_any": "  s: {text|contains: [Token, COPYRIGHT]}\n  condition: s",
        "contains_all": "  s: {text|contains|all: [the, License]}\n  condition: s",
        "contains_wildcard": "  s: {text|contains: 'token*\"'}\n  condition: s",
        "starts": "  s: {text|startswith: ['The ', El]}\n  condition: s",
        "ends": "  s: {text|endswith: ['s.', 'e.']}\n  condition: s",
        "equal_any_case": "  s: {lang: EN}\n  condition: s",
        "equal_number": "  s: {source: src3, n_chars: [416, 380]}\n  condition: s",
        "wildcard": "  s: {lang: 'E?', source: 'src*5'}\n  condition: s",
        "empty_list": "  s: {lang: []}\n  condition: s",
        "empty_map": "  s: {}\n  condition: s",
    })


@register("match_numbers_and_missing", union_sql("documents", "doc_id", {
    "at_least": "n_chars >= 1000", "above": "n_chars > 416", "below": "n_chars < 416.5", "at_most": "n_chars <= 380",
    "band": "n_chars >= 500 AND n_chars < 900",
    "not_a_number": "FALSE",
    "exists": "doc_id % 3 = 2", "missing": "doc_id % 3 <> 2", "no_value": "doc_id % 3 <> 2",
    "not_equal": "doc_id % 3 <> 2",
}))
def match_numbers_and_missing(spark, sf_dir):
    return hits(documents(spark, sf_dir), WEB, {
        "at_least": "  s: {n_chars|gte: 1000}\n  condition: s",
        "above": "  s: {n_chars|gt: 416}\n  condition: s",
        "below": "  s: {N_CHARS|lt: 416.5}\n  condition: s",
        "at_most": "  s: {n_chars|lte: 380}\n  condition: s",
        "band": "  s: {n_chars|gte: 500}\n  t: {n_chars|lt: 900}\n  condition: s and t",
        "not_a_number": "  s: {lang|gte: 0}\n  condition: s",
        "exists": "  s: {note|exists: true}\n  condition: s",
        "missing": "  s: {note|exists: false}\n  condition: s",
        "no_value": "  s: {note: null}\n  condition: s",
        "not_equal": "  s: {note: given}\n  condition: not s",
    })


@register("match_conditions", union_sql("documents", "doc_id", {
    "grouped": "(lang = 'en' OR lang = 'de') AND NOT source = 'src1'",
    "precedence": "lang = 'en' OR (lang = 'de' AND NOT source = 'src1')",
    "one_of": "lang = 'en' OR lang = 'de'",
    "all_of": "lang = 'en' AND lang = 'de'",
    "one_of_them": "lang = 'en' OR lang = 'de' OR source = 'src1'",
    "listed": "lang = 'de' OR source = 'src1'",
    "maps": "(lang = 'fr' AND source = 'src0') OR (lang = 'es' AND source = 'src2')",
    "keywords": "contains(lower(text), 'license') OR contains(lower(text), 'token =')",
}))
def match_conditions(spark, sf_dir):
    named = "  sel_en: {lang: en}\n  sel_de: {lang: de}\n  other: {source: src1}\n  condition: "
    return hits(documents(spark, sf_dir), WEB, {
        "grouped": named + "(sel_en or sel_de) and not other",
        "precedence": named + "sel_en OR sel_de AND NOT other",
        "one_of": named + "1 of sel_*",
        "all_of": named + "all of sel_*",
        "one_of_them": named + "1 of them",
        "listed": named + "[sel_de, other]",
        "maps": "  s:\n    - {lang: fr, source: src0}\n    - {lang: es, source: src2}\n  condition: s",
        "keywords": "  s: [License, 'token =']\n  condition: s",
    })


@register("match_regex", union_sql("pages", "page_id", {
    "digits_at_end": "regexp_matches(url, '/[0-9]+$')",
    "case_counts": "FALSE",
    "either_case": "regexp_matches(url, 'example\\.org')",
    "groups": "regexp_matches(url, '(en|de)/[0-9]{2}[^0-9]?')",
    "dot_all": "regexp_matches(html, '(?s)<title>.*</title>.*</html>')",
}))
def match_regex(spark, sf_dir):
    pages = stored_texts(table(spark, sf_dir, "pages"), "page_id", "url", "url", "html")
    return hits(pages, WEB, {
        "digits_at_end": "  s: {url|re: '/[0-9]+$'}\n  condition: s",
        "case_counts": "  s: {url|re: 'EXAMPLE'}\n  condition: s",
        "either_case": "  s: {url|re: '(?i)EXAMPLE\\.ORG'}\n  condition: s",
        "groups": "  s: {url|re: '(?P<lang>en|de)/[0-9]{2}[^0-9]?'}\n  condition: s",
        "dot_all": "  s: {html|re: '<title>.*</title>.*</html>'}\n  condition: s",
    })


@register("match_conversations", union_sql("conversations", "conv_id * 1000 + turn", {
    "user_the": "role = 'user' AND contains(lower(text), 'the')",
    "not_user": "NOT starts_with(role, 'us')",
    "word_in_line": "contains(lower(text), 'est') OR contains(lower(text), 'und')",
}))
def match_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return hits(stored_texts(rows, "id", "text", "role", "text"), WEB, {
        "user_the": "  s: {role: USER, text|contains: the}\n  condition: s",
        "not_user": "  s: {role|startswith: us}\n  condition: not s",
        "word_in_line": "  s: [EST, und]\n  condition: s",
    })


QUAD = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
QUAD_VALUE = " + ".join(f"split_part(address, '.', {i + 1})::BIGINT * {256 ** (3 - i)}" for i in range(4))


@register("match_networks_in_texts", f"""
WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '{QUAD}')) AS address FROM documents),
valid AS (SELECT *, {QUAD_VALUE} AS value FROM found
          WHERE regexp_full_match(address, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.|$)){{4}}'))
SELECT doc_id, address, value, value >= {128 << 24} AS upper_half,
       value BETWEEN {172 << 24} AND {(173 << 24) - 1} AS net_172 FROM valid""")
def match_networks_in_texts(spark, sf_dir):
    """Dotted quads in whole documents against two networks."""
    found = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(QUAD), F.lit(0))).alias("address"))
    return found.select("doc_id", "address", ipv4_value(F.col("address")).alias("value"),
                        in_network(F.col("address"), "128.0.0.0/1").alias("upper_half"),
                        in_network(F.col("address"), "172.9.9.9/8").alias("net_172")).filter("value is not null")


def valid_address(user: Column) -> Column:
    """An IPv4 address per user that stays one for any number of users; the first 64,000 have the same as in ``address``."""
    octets = [10 + F.floor(user / 16_384_000), F.floor(user / 64_000) % 256, F.floor(user / 250) % 256, user % 250]
    return F.concat_ws(".", *[octet.cast("string") for octet in octets])


@register("match_networks", f"""
SELECT event_id AS id, user_id < 250 AND user_id % 250 BETWEEN 64 AND 127 AS v4, event_id BETWEEN 256 AND 511 AS v6,
       user_id % 2 = 0 AS mixed FROM events""")
def match_networks(spark, sf_dir):
    """IPv4 and IPv6 networks on addresses made of user and event numbers."""
    v6 = F.concat(F.lit("2001:DB8::"), F.lower(F.hex(F.floor(F.col("event_id") / 65536))), F.lit(":"),
                  F.hex(F.col("event_id") % 65536))
    v4 = valid_address(F.col("user_id"))
    either = F.when(F.col("user_id") % 2 == 0, v4).otherwise(v6)
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"), in_network(v4, "10.0.0.64/26").alias("v4"),
        in_network(v6, "2001:db8::1ff/120").alias("v6"),
        in_network(either, "0.0.0.0/0").alias("mixed"))


@register("match_network_list", """
WITH nets AS (
  SELECT 10 * 16777216 + (c_custkey % 250) * 65536 + (c_custkey // 250 % 250) * 256 + c_nationkey AS value, 16 + c_custkey % 17 AS bits FROM customer),
keyed AS (SELECT DISTINCT bits, value >> (32 - bits) AS prefix FROM nets),
asked AS (SELECT event_id AS id, 10 * 16777216 + (event_id % 250) * 65536 + (user_id % 250) * 256 + event_id % 25 AS value FROM events)
SELECT id, max(bits)::BIGINT AS bits FROM asked LEFT JOIN keyed ON value >> (32 - bits) = prefix GROUP BY id""")
def match_network_list(spark, sf_dir):
    """The longest of as many networks as there are customers for the address of every event."""
    key = F.col("c_custkey")
    address = F.concat_ws(".", F.lit("10"), key % 250, F.floor(key / 250) % 250, F.col("c_nationkey"))
    nets = table(spark, sf_dir, "customer").select(F.concat(address, F.lit("/"), 16 + key % 17).alias("network"))
    asked = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.concat_ws(
        ".", F.lit("10"), F.col("event_id") % 250, F.col("user_id") % 250, F.col("event_id") % 25).alias("address"))
    return with_network(asked, nets).select("id", F.substring_index("network", "/", -1).cast("bigint").alias("bits"))


@register("match_rule_networks", """
SELECT 'inside' AS rule, event_id AS id FROM events WHERE user_id < 250 AND user_id % 250 BETWEEN 32 AND 63
UNION ALL SELECT 'outside', event_id FROM events WHERE NOT (user_id < 250 AND user_id % 250 BETWEEN 32 AND 63)""")
def match_rule_networks(spark, sf_dir):
    """Networks as a modifier of rules."""
    stored = as_sshd(spark, sf_dir)
    return hits(stored, "{service: sshd}", {
        "inside": "  s: {src_ip|cidr: [10.0.0.32/27, 2001:db8::/32]}\n  condition: s",
        "outside": "  s: {src_ip|cidr: 10.0.0.32/27}\n  condition: not s"})


@register("match_predicates", """
SELECT 'late' AS rule, event_id AS id FROM events WHERE hour(ts) >= 20
UNION ALL SELECT 'failed', event_id FROM events WHERE event_type = 'error'
UNION ALL SELECT 'dear', event_id FROM events WHERE value > 40""")
def match_predicates(spark, sf_dir):
    """Rules given as columns, next to one from a file."""
    stored = as_sshd(spark, sf_dir).join(events(spark, sf_dir).select(text_id().alias("event_id"), "value"), "event_id")
    rules = check_rules(rules_from_text(rule_file("{service: sshd}", {"failed": "  s: {action: failed_password}\n  condition: s"})))
    found = match_events(stored, rules, {"late": ("ssh", F.hour("ts") >= 20), "dear": ("ssh", F.col("value") > 40), "never": ("nginx", F.lit(True))})
    return found.select("rule", F.col("match_id").cast("bigint").alias("id"))


@register("match_routing", """
SELECT 'started' AS rule, event_id AS id FROM events WHERE event_type IN ('click', 'view') AND user_id % 2 = 0
UNION ALL SELECT 'any_windows', event_id FROM events WHERE user_id % 2 = 0
UNION ALL SELECT 'sshd_lines', event_id FROM events WHERE user_id % 2 = 1 AND event_type = 'error'""")
def match_routing(spark, sf_dir):
    """Log sources choose the events; process_creation also asks for the event numbers 1 and 4688."""
    number = (F.when(F.col("event_type") == "click", "1").when(F.col("event_type") == "view", "4688")
              .otherwise("4624"))
    stored = events(spark, sf_dir).select(
        text_id().alias("event_id"), F.unix_micros(utc()).alias("ts_us"), F.lit("h").alias("host"),
        F.when(F.col("user_id") % 2 == 0, "windows").otherwise("ssh").alias("source"),
        F.create_map(F.lit("eventid"), number, F.lit("kind"), F.col("event_type")).alias("fields"),
        F.col("props").alias("raw"))
    text = "\n---\n".join([
        rule_file("{category: process_creation, product: windows}", {"started": "  s: {kind|exists: true}\n  condition: s"}),
        rule_file("{product: windows}", {"any_windows": "  s: {EventID|gte: 1}\n  condition: s"}),
        rule_file("{product: linux, service: SSHD}", {"sshd_lines": "  s: {kind: error}\n  condition: s"})])
    return match_events(stored, check_rules(rules_from_text(text))).select(
        "rule", F.col("match_id").cast("bigint").alias("id"))


@register("match_one_pass", """
SELECT rule, count(*) AS n FROM (
  SELECT unnest([CASE WHEN event_type = 'error' THEN 'failed' END, CASE WHEN event_type = 'purchase' THEN 'accepted' END,
                 CASE WHEN json_extract_string(props, '$.k')::INT >= 50 THEN 'upper' END,
                 CASE WHEN event_type IN ('error', 'purchase') AND json_extract_string(props, '$.k') LIKE '7%' THEN 'seven' END]) AS rule
  FROM events) WHERE rule IS NOT NULL GROUP BY rule""")
def match_one_pass(spark, sf_dir):
    """Several rules in one scan; an event may fulfil more than one."""
    text = rule_file("{service: sshd}", {
        "failed": "  s: {action: failed_password}\n  condition: s",
        "accepted": "  s: {action: accepted}\n  condition: s",
        "upper": "  s: {user|re: '^u([5-9][0-9]|[0-9]{3,})$'}\n  condition: s",
        "seven": "  s: {action: [failed_password, accepted], user|startswith: u7}\n  condition: s"})
    return match_events(as_sshd(spark, sf_dir), check_rules(rules_from_text(text))).groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"))
