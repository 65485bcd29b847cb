"""The shipped rules over the whole events table: every event stands for a small scene that a rule is meant to see or not."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.tables import events, text_id, utc
from watchspan.operators.matching import match_events
from watchspan.plans.detect import detect
from watchspan.rules import load_rules
from watchspan.session import local_table, shared_folder
from watchspan.sources.ingest import EventTable, read_logs

QUERIES: dict = {}
SQL: dict[str, str] = {}

WHO = "{who}"  # an address of the scene's own


def fails(n, gap, one_user=True):
    return [(k * gap, "ssh", {"action": "failed_password", "src_ip": WHO, "user": "ines" if one_user else f"u{k}"}, ["ssh_failed_login"]) for k in range(n)]


def enters(at, user="ines"):
    plain = ["ssh_accepted_login"] + ["ssh_root_login"] * (user == "root")
    return [(at, "ssh", {"action": "accepted", "src_ip": WHO, "user": user}, plain)]


def asks(fields, plain=(), n=1, gap=0):
    return [(k * gap, "nginx", {"c-ip": WHO, **fields}, list(plain)) for k in range(n)]


def refused(n, gap, one_user=True, address=WHO):
    plain = ["win_failed_logon"] if address == WHO else []
    return [(k * gap, "windows", {"EventID": "4625", "IpAddress": address, "TargetUserName": "ines" if one_user else f"u{k}"}, plain) for k in range(n)]


def record(number, plain=(), **fields):
    return [(0, "windows", {"EventID": str(number), **fields}, list(plain))]


FORM = {"cs-method": "POST", "cs-uri-stem": "/shop/login", "sc-status": "401"}
# Each scene: its lines as (second, source, fields, plain rules that match) and the alerts it makes as (rule, level, events).
SCENES = [
    (fails(8, 40), [("ssh_bruteforce", "high", 8)]),
    (fails(7, 40), []),
    (fails(20, 180), [("ssh_slow_bruteforce", "medium", 20)]),
    (fails(19, 180), []),
    (fails(5, 140, one_user=False), [("ssh_password_spray", "high", 5)]),
    (fails(4, 140, one_user=False), []),
    (fails(8, 40) + enters(300), [("ssh_bruteforce", "high", 8), ("ssh_compromise", "critical", 9)]),
    (fails(7, 40) + enters(300), []),
    (enters(0, "root"), [("ssh_root_login", "medium", 1)]),
    (enters(0, "toor"), []),
    (asks({"cs-uri-query": "id=7 UNION SELECT 1"}, ["web_sqli"]), [("web_sqli", "high", 1)]),
    (asks({"cs-uri-query": "union+of+states"}), []),
    (asks({"cs-uri-query": "q=<SCRIPT>"}, ["web_xss"]), [("web_xss", "medium", 1)]),
    (asks({"cs-uri-query": "q=script"}), []),
    (asks({"cs-uri-stem": "/a/../b"}, ["web_path_traversal"]), [("web_path_traversal", "high", 1)]),
    (asks({"cs-uri-query": "f=c:\\Windows\\x"}, ["web_path_traversal"]), [("web_path_traversal", "high", 1)]),
    (asks({"cs-uri-stem": "/a/..b"}), []),
    (asks({"cs-referer": "x${jndi:ldap}"}, ["web_log4shell"]), [("web_log4shell", "high", 1)]),
    (asks({"cs-user-agent": "{jndi:}"}), []),
    (asks({"cs-user-agent": "Fuzz Faster/1"}, ["web_scanner_useragent"]), [("web_scanner_useragent", "medium", 1)]),
    (asks({"cs-uri-stem": "/x/.git/HEAD"}, ["web_sensitive_probe"], 3, 150), [("web_scanner_probing", "medium", 3)]),
    (asks({"cs-uri-stem": "/x/.git/HEAD"}, ["web_sensitive_probe"], 2, 150), []),
    (asks({"sc-status": "404"}, ["web_404"], 25, 2.5), [("web_404_flood", "medium", 25)]),
    (asks({"sc-status": "404"}, ["web_404"], 24, 2.5), []),
    (asks(FORM, ["web_login_failure"], 10, 13), [("web_login_bruteforce", "high", 10)]),
    (asks(FORM, ["web_login_failure"], 9, 13), []),
    (asks({**FORM, "cs-method": "GET"}, [], 10, 13), []),
    (refused(8, 40), [("win_bruteforce", "high", 8)]),
    (refused(7, 40), []),
    (refused(5, 140, one_user=False), [("win_password_spray", "high", 5)]),
    (refused(8, 40) + [(300, "windows", {"EventID": "4624", "LogonType": "10", "IpAddress": WHO}, ["win_logon_success"])],
     [("win_bruteforce", "high", 8), ("win_compromise", "critical", 9)]),
    (refused(8, 40) + [(300, "windows", {"EventID": "4624", "LogonType": "2", "IpAddress": WHO}, [])], [("win_bruteforce", "high", 8)]),
    (refused(12, 10, address="127.0.0.1"), []),
    (record(4720, ["win_user_created"], IpAddress=WHO), [("win_user_created", "medium", 1)]),
    (record(4721, IpAddress=WHO), []),
    (record(4756, ["win_admin_group_added"], TargetUserName="domain admins", IpAddress=WHO), [("win_admin_group_added", "high", 1)]),
    (record(4756, TargetUserName="guests", IpAddress=WHO), []),
    (record(1102, ["win_log_cleared"], IpAddress=WHO), [("win_log_cleared", "high", 1)]),
    (record(104, ["win_log_cleared"], Channel="System", IpAddress=WHO), [("win_log_cleared", "high", 1)]),
    (record(104, Channel="Setup", IpAddress=WHO), []),
    (record(7045, ["win_service_installed"], IpAddress=WHO), [("win_service_installed", "medium", 1)]),
    (record(4688, ["win_encoded_powershell"], Image="C:\\x\\pwsh.EXE", CommandLine="pwsh -EC abc", IpAddress=WHO), [("win_encoded_powershell", "high", 1)]),
    (record(4689, Image="C:\\x\\pwsh.exe", CommandLine="pwsh -ec abc", IpAddress=WHO), []),
    (record(1, ["win_office_spawns_shell"], ParentImage="D:\\o\\EXCEL.exe", Image="C:\\mshta.exe", IpAddress=WHO), [("win_office_spawns_shell", "high", 1)]),
    (record(1, ParentImage="D:\\o\\excel.exe", Image="C:\\calc.exe", IpAddress=WHO), []),
    (record(4688, ["win_credential_dumping_cli"], CommandLine="rundll32 COMSVCS.dll, minidump", IpAddress=WHO), [("win_credential_dumping_cli", "critical", 1)]),
]
LINES = [(scene, step, at, source, fields, plain) for scene, (lines, _) in enumerate(SCENES) for step, (at, source, fields, plain) in enumerate(lines)]


def scenes(spark, sf_dir):
    """The lines of all scenes as stored events."""
    steps = local_table(spark, [(scene, step, float(at), source, list(fields.items())) for scene, step, at, source, fields, _ in LINES],
                        "scene long, step int, at double, source string, fields map<string,string>")
    us = F.unix_micros(utc()) + (F.col("at") * 1_000_000).cast("bigint")
    acts = events(spark, sf_dir).withColumn("scene", F.col("event_id") % len(SCENES)).join(steps, "scene").withColumn("who", F.concat(F.lit("n"), "event_id"))
    return acts.select(
        F.concat_ws("/", text_id(), "step").alias("event_id"), F.timestamp_micros(us).alias("ts"), us.alias("ts_us"), "source",
        F.lit("shop").alias("host"), F.transform_values("fields", lambda _, v: F.replace(v, F.lit(WHO), F.col("who"))).alias("fields"), F.lit("").alias("raw"))


def values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


SQL["shipped_rule_matches"] = f"""
WITH p(scene, step, rule) AS (VALUES {values((scene, step, rule) for scene, step, *_, plain in LINES for rule in plain)})
SELECT rule, event_id, step::BIGINT AS step FROM events JOIN p ON event_id % {len(SCENES)} = scene"""


def shipped_rule_matches(spark, sf_dir):
    parts = F.split("match_id", "/")
    return match_events(scenes(spark, sf_dir), load_rules()).select(
        "rule", F.get(parts, F.lit(0)).cast("bigint").alias("event_id"), F.get(parts, F.lit(1)).cast("bigint").alias("step"))


SQL["shipped_rule_alerts"] = f"""
WITH p(scene, rule, level, n) AS (VALUES {values((scene, *alert) for scene, (_, alerts) in enumerate(SCENES) for alert in alerts)})
SELECT rule, level, concat('n', event_id) AS who, n::BIGINT AS n FROM events JOIN p ON event_id % {len(SCENES)} = scene"""


def shipped_rule_alerts(spark, sf_dir):
    found = detect(scenes(spark, sf_dir), load_rules()).alerts
    return found.select("rule", "level", F.get(F.map_values("grp"), F.lit(0)).alias("who"), F.col("count").cast("bigint").alias("n"))


SQL["ingest_files"] = """
SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS seconds, 1::BIGINT AS stored, strftime(ts, '%Y-%m-%d') AS day FROM events"""


def ingest_files(spark, sf_dir):
    """All events as access-log files: written, read, stored, read and stored again."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    line = F.concat(F.lit("192.0.2.9 - - "), F.date_format(utc(), "'['dd/MMM/yyyy:HH:mm:ss' +0000]'"), F.lit(' "GET /e/'), "event_id", F.lit(' HTTP/1.1" 200 1'))
    events(spark, sf_dir).repartition(3, "user_id").select(line.alias("value")).write.text(f"{folder}/logs")
    table = EventTable(f"{folder}/events")
    for _ in range(2):
        table.append(read_logs(spark, "nginx", f"{folder}/logs"))
    number = F.substring_index(F.try_element_at("fields", F.lit("cs-uri-stem")), "/", -1).cast("bigint")
    return table.read(spark).groupBy(number.alias("event_id")).agg(
        F.min(F.unix_seconds("ts")).alias("seconds"), F.count(F.lit(1)).alias("stored"), F.min(F.col("day").cast("string")).alias("day"))


QUERIES.update({f.__name__: f for f in (shipped_rule_matches, shipped_rule_alerts, ingest_files)})
