"""Log files to stored events, alerts, summaries and a score."""

import json
from datetime import datetime, timezone

import pytest

from watchspan.plans import lookup, summary
from watchspan.plans.detect import detect
from watchspan.plans.score import score
from watchspan.rules import load_rules
from watchspan.sources.ingest import EventTable, read_logs
from watchspan.sources.tables import benign_events_of, read_alerts, read_truth, replace_alerts, scenarios_of

START = 1_790_000_000
NOW = datetime(2026, 12, 1, tzinfo=timezone.utc)


def at(seconds):
    return datetime.fromtimestamp(START + seconds, timezone.utc)


def write_logs(folder):
    ssh = [f"{at(i * 4):%b %d %H:%M:%S} web01 sshd[1]: Failed password for root from 203.0.113.13 port 22 ssh2" for i in range(12)]
    ssh += [f"{at(60):%b %d %H:%M:%S} web01 sshd[1]: Accepted password for root from 203.0.113.13 port 22 ssh2",
            f"{at(90):%b %d %H:%M:%S} web01 sshd[1]: Accepted publickey for alice from 10.0.0.21 port 22 ssh2"]
    web = [f'203.0.113.25 - - [{at(5000 + i):%d/%b/%Y:%H:%M:%S} +0000] "GET /search?q=%3Cscript%3E HTTP/1.1" 200 9 "-" "sqlmap/1"'
           for i in range(3)]
    web += [f'198.18.0.7 - - [{at(i * 60):%d/%b/%Y:%H:%M:%S} +0000] "GET / HTTP/1.1" 200 9 "-" "Mozilla"' for i in range(50)]
    windows = [{"@timestamp": f"{at(9000):%Y-%m-%dT%H:%M:%S}.500Z", "winlog": {
        "event_id": "1102", "computer_name": host, "channel": "Security", "event_data": {"SubjectUserName": "x"}}}
        for host in ("DC1", "DC2")]
    (folder / "auth.log").write_text("\n".join(ssh))
    (folder / "access.log").write_text("\n".join(web))
    (folder / "windows.jsonl").write_text("\n".join(json.dumps(d) for d in windows))
    scenarios = [
        ("guessed", ["203.0.113.13"], "web01", 0, 70, ["ssh_bruteforce", "ssh_compromise", "ssh_root_login"]),
        ("script", ["203.0.113.25"], "", 5000, 5010, ["web_xss"]),
        ("cleared", [], "DC1", 9060, 9100, ["win_log_cleared"]),
        ("missed", ["203.0.113.99"], "", 0, 10, ["web_sqli"])]
    truth = {"seed": 1, "start": START, "hours": 3, "benign_events": {"nginx": 50, "ssh": 1}, "scenarios": [
        {"name": n, "description": "", "source": "x", "ips": ips, "host": host, "start": START + a, "end": START + b, "expect": e}
        for n, ips, host, a, b, e in scenarios]}
    (folder / "truth.json").write_text(json.dumps(truth, indent=2))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    write_logs(folder)
    table = EventTable(str(folder / "events"))
    for kind, name in (("ssh", "auth.log"), ("nginx", "access.log"), ("windows", "windows.jsonl")):
        table.append(read_logs(spark, kind, str(folder / name), **({"year": 2026, "now": NOW} if kind == "ssh" else {})))
    events = table.read(spark)
    replace_alerts(detect(events, load_rules()), str(folder / "out"))
    return events, read_alerts(spark, str(folder / "out")), folder


def test_alerts_of_the_files(stored):
    _, found, _ = stored
    rows = {(a["rule"], *a["grp"].values()): a for a in found.alerts.collect()}
    assert set(rows) == {
        ("ssh_bruteforce", "203.0.113.13"), ("ssh_compromise", "203.0.113.13"), ("ssh_root_login", "203.0.113.13"),
        ("web_xss", "203.0.113.25"), ("web_scanner_useragent", "203.0.113.25"), ("win_log_cleared", "DC1"), ("win_log_cleared", "DC2")}
    assert rows[("ssh_compromise", "203.0.113.13")]["count"] == 13
    assert rows[("ssh_bruteforce", "203.0.113.13")]["ts_trigger"] == at(28).replace(tzinfo=None)


def scored(spark, events, found, folder):
    truth = read_truth(spark, str(folder / "truth.json"))
    return score(found.alerts, found.evidence, events, scenarios_of(truth), benign_events_of(truth))


def test_score(spark, stored):
    result = scored(spark, stored[0], stored[1], stored[2])
    rows = result.expectations.orderBy("scenario_id", "position").collect()
    assert [(r["scenario"], r["rule"], r["detected"], r["seconds_to_detect"]) for r in rows] == [
        ("guessed", "ssh_bruteforce", True, 28.0), ("guessed", "ssh_compromise", True, 60.0), ("guessed", "ssh_root_login", True, 60.0),
        ("script", "web_xss", True, 0.0), ("cleared", "win_log_cleared", True, -59.5), ("missed", "web_sqli", False, None)]
    left = sorted((r["rule"], r["verdict"], list(r["scenarios"])) for r in result.unexpected.collect())
    assert left == [("web_scanner_useragent", "extra", ["script"]), ("win_log_cleared", "false positive", [])]
    assert [tuple(r) for r in result.totals.collect()] == [(5, 6, pytest.approx(83.33, abs=0.01), 1, 1, 7, 51)]


def test_the_score_notices_a_missing_rule(spark, stored):
    events, _, folder = stored
    fewer = detect(events, [r for r in load_rules() if r.name != "web_xss"])
    rows = scored(spark, events, fewer, folder).expectations.filter("not detected").collect()
    assert sorted(r["rule"] for r in rows) == ["web_sqli", "web_xss"]


def test_detection_is_repeatable(stored):
    events, found, _ = stored
    assert sorted(detect(events, load_rules()).alerts.collect()) == sorted(found.alerts.collect())


def test_lookups(spark, stored):
    events, found, _ = stored
    assert lookup.search_events(events, "nginx", "SCRIPT").count() == 3
    assert lookup.search_events(events, "nginx", "_cript").count() == 0
    assert lookup.search_events(events, "nginx", limit=2).count() == 2 and lookup.search_events(events, "nginx").count() == 53
    assert lookup.search_events(events, "nginx").first()["ts"] == at(5002).replace(tzinfo=None)
    worst = lookup.search_alerts(found.alerts, "high").collect()
    assert [a["rule"] for a in worst] == ["ssh_compromise", "ssh_bruteforce", "win_log_cleared", "win_log_cleared"]
    assert lookup.search_alerts(found.alerts, term='"C-IP').count() == 0
    assert lookup.search_alerts(found.alerts, term='{"entity": "dc1"}').count() == 1
    detail = lookup.alert_events(worst[0]["alert_id"], found.evidence, events).collect()
    assert len(detail) == 13 and detail[-1]["fields"]["action"] == "accepted"
    assert lookup.alert_events("none", found.evidence, events).count() == 0
    as_text = lookup.alerts_text(found.alerts).first()
    assert (as_text["level"], as_text["group"]) == ("high", "src_ip=203.0.113.13")


def test_summaries(spark, stored):
    events, found, _ = stored
    assert {r["source"]: r["events"] for r in summary.events_by_source(events).collect()} == {"nginx": 53, "ssh": 14, "windows": 2}
    assert [tuple(r) for r in summary.alerts_by_level(found.alerts).collect()] == [
        ("critical", 1), ("high", 3), ("medium", 3), ("low", 0), ("informational", 0)]
    assert summary.alerts_by_rule(found.alerts).first()["rule"] == "win_log_cleared"
    assert [tuple(r) for r in summary.top_entities(found.alerts, 2).collect()] == [
        ("203.0.113.13", 3, "critical"), ("DC1", 1, "high")]
    hours = summary.timeline(found.alerts).collect()
    assert [r["bucket_seconds"] for r in hours] == [3600] * 3 and sum(r["medium"] for r in hours) == 3
    assert summary.timeline(found.alerts.filter("false")).collect() == []
    counts = {r["rule"]: r["alerts"] for r in summary.rules_with_counts(spark, load_rules(), found.alerts).collect()}
    assert counts["win_log_cleared"] == 2 and counts["web_sqli"] == 0 and len(counts) == 30
