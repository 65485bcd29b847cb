import ipaddress
import random

import pytest
from helpers import alerts, event, event_table, rules
from pyspark.sql import functions as F

from watchspan.functions.network import in_network, ipv4_value, ipv6_hex
from watchspan.functions.predicates import RuleError
from watchspan.functions.timespan import timespan_us
from watchspan.operators.matching import match_events
from watchspan.plans.summary import rule_catalogue, rule_list
from watchspan.rules import check_patterns, levels_of, load_rules, rules_from_text, silenced

# (detection, fields that fulfil it, fields that do not). Raw lines are passed as "raw".
CASES = [
    ("s: {sc-status: 404, cs-method: get}", [{"sc-status": 404, "cs-method": "GET"}], [{"sc-status": 200, "cs-method": "GET"}, {}]),
    ("s: {u|contains: ['/.env', passwd]}", [{"u": "/a/.ENV"}, {"u": "/etc/passwd"}], [{"u": "/home"}, {}]),
    ("s: {u|contains: 'a*c?e'}", [{"u": "xxa--cde"}], [{"u": "ace"}]),
    ("s: {u|startswith: /api, v|endswith: curl}", [{"u": "/API/x", "v": "xx Curl"}], [{"u": "/x", "v": "curl"}]),
    ("s: {u|startswith: '/a*'}", [{"u": "/a*b"}], [{"u": "/ab"}]),
    ("s: {u|contains|all: ['a=1', 'b=2']}", [{"u": "b=2&a=1"}], [{"u": "a=1"}]),
    ("s: {u: '/a/*/c?.php'}", [{"u": "/a/b/b/c1.PHP"}, {"u": "/a/\n/c1.php"}], [{"u": "/a/b/c12.php"}, {"u": "x/a/b/c1.php"}]),
    (r"s: {u: 'a\*b'}", [{"u": "a*b"}], [{"u": "aXb"}, {"u": r"a\*b"}]),
    (r"s: {u: 'a\\*b'}", [{"u": r"a\Xb"}, {"u": "a\\b"}], [{"u": "a*b"}]),
    (r"s: {u: 'a.c[d]*'}", [{"u": "a.c[d]z"}], [{"u": "abcdz"}]),
    ("s: {u|re: '^/v[0-9]+/admin$'}", [{"u": "/v2/admin"}, {"u": "/v2/admin\n"}], [{"u": "/V2/admin"}, {"u": "/v2/admin\r"}, {}]),
    ("s: {u|re: 'a.b'}", [{"u": "xa\nbx"}], [{"u": "ab"}]),
    (r"s: {u|re: '(?P<q_1>x)(?P=q_1)\w'}", [{"u": "xxé"}], [{"u": "xyz"}]),
    ("s: {ip|cidr: 203.0.113.7/24}", [{"ip": "203.0.113.77"}], [{"ip": "203.0.114.1"}, {"ip": "203.0.113.077"}, {"ip": "x"}, {"ip": "::1"}, {}]),
    ("s: {ip|cidr: ['10.0.0.0/8', '2001:db8::/32']}", [{"ip": "10.9.9.9"}, {"ip": "2001:DB8::1.2.3.4"}], [{"ip": "::10.0.0.1"}]),
    ("s: {n|gte: 1000}", [{"n": 1000}, {"n": " 1e3 "}, {"n": "inf"}, {"n": "1_000"}], [{"n": 999}, {"n": "nan"}, {"n": "1000d"}, {"n": ""}, {}]),
    ("s: {n|lt: 5}", [{"n": -1}, {"n": ".5"}, {"n": "-Infinity"}], [{"n": 5}, {"n": "x"}, {}]),
    ("s: {n|lte: 5, m|gt: 1}", [{"n": 5, "m": 2}], [{"n": 5, "m": 1}]),
    ("s: {r: null}", [{}, {"r": ""}], [{"r": "x"}]),
    ("s: {r: [null, x]}", [{}, {"r": "X"}], [{"r": "y"}]),
    ("s: {r|exists: true}", [{"r": "x"}], [{}, {"r": ""}]),
    ("s: {r|exists: false}", [{}, {"r": ""}], [{"r": "x"}]),
    ("s: {r: true}", [{"r": "true"}, {"r": "True"}], [{"r": "1"}]),
    ("s: {RefErer: x}", [{"referer": "x"}, {"REFERER": "x"}], [{"RefErer": "y", "referer": "x"}]),
    ("s: [jndi, 'union select']", [{"raw": "GET ${JNDI:x}"}], [{"raw": "GET /"}]),
    ("s:\n    - {a: 1}\n    - {b: 2, c: 3}", [{"a": 1}, {"b": 2, "c": 3}], [{"b": 2}]),
    ("s: {a: []}", [], [{"a": ""}, {}]),
    ("s: {'a|all': []}", [{}], []),
]
CONDITIONS = [
    ("(sel_a and sel_b) and not other", ["ab"], ["abo", "a", ""]),
    ("sel_a OR sel_b And Not other", ["a", "ao", "b"], ["bo", ""]),
    ("not not sel_a", ["a"], ["b"]),
    ("not (sel_a or sel_b)", ["", "o"], ["a", "bo"]),
    ("all of sel_*", ["ab"], ["a", "bo"]),
    ("1 of sel*", ["a", "bo"], ["o"]),
    ("1 OF them", ["o"], [""]),
    ("all of them", ["abo"], ["ab"]),
    ("not 1 of sel_* and other", ["o"], ["ao", ""]),
    ("[sel_a, other]", ["a", "o"], ["b"]),
]


def rule_text(name, body, condition="s"):
    return (f"title: {name}\nname: {name}\nlogsource: {{category: webserver}}\ndetection:\n  {body}\n"
            f"  condition: {condition}\n")


def matched(spark, text, events):
    found = match_events(event_table(spark, events), rules(text)).select("rule", "match_id").collect()
    return {(r["rule"], r["match_id"]) for r in found}


def test_field_tests(spark):
    texts, events, case_of, expected = [], [], {}, set()
    for i, (body, good, bad) in enumerate(CASES):
        texts.append(rule_text(f"case{i}", body))
        for sample in good + bad:
            fields = {k: v for k, v in sample.items() if k != "raw"}
            row = event(0, "nginx", raw=sample.get("raw", "x"), **fields)
            events.append(row)
            case_of[row["event_id"]] = f"case{i}"
            if sample in good:
                expected.add((f"case{i}", row["event_id"]))
    found = {hit for hit in matched(spark, "\n---\n".join(texts), events) if hit[0] == case_of[hit[1]]}
    assert found == expected


def test_conditions(spark):
    named = "sel_a: {a: 1}\n  sel_b: {b: 1}\n  other: {o: 1}"
    texts = "\n---\n".join(rule_text(f"c{i}", named, c) for i, (c, _, _) in enumerate(CONDITIONS))
    kinds = {"".join(k): event(0, "nginx", **{x: 1 for x in k}) for k in ("", "a", "b", "o", "ab", "ao", "bo", "abo")}
    found = matched(spark, texts, list(kinds.values()))
    for i, (condition, good, bad) in enumerate(CONDITIONS):
        for kind in good:
            assert (f"c{i}", kinds[kind]["event_id"]) in found, (condition, kind)
        for kind in bad:
            assert (f"c{i}", kinds[kind]["event_id"]) not in found, (condition, kind)


def test_log_sources(spark):
    text = rule_text("web", "s: {x: 1}") + "\n---\n" + "\n---\n".join(
        f"title: t\nname: {name}\nlogsource: {source}\ndetection: {{s: {{x: 1}}, condition: s}}" for name, source in (
            ("ssh", "{product: linux, service: SSHD}"), ("proc", "{category: process_creation, product: windows}"),
            ("service_first", "{service: ssh, category: process_creation, product: windows}")))
    rows = [event(0, "nginx", x=1), event(0, "ssh", x=1), event(0, "windows", x=1, EventID=4688),
            event(0, "windows", x=1, eventid=1), event(0, "windows", x=1, EventID=4624), event(0, "ssh", x=1, EventID=1)]
    ids = [r["event_id"] for r in rows]
    assert matched(spark, text, rows) == {
        ("web", ids[0]), ("ssh", ids[1]), ("ssh", ids[5]), ("proc", ids[2]), ("proc", ids[3]), ("service_first", ids[5])}


GOOD = rule_text("t", "s: {a: x}")
CORRELATION = "title: c\nname: c\ncorrelation: {type: event_count, rules: [t], timespan: 1m, condition: {gte: 2}}\n"


@pytest.mark.parametrize("text, word", [
    (rule_text("t", "s: {a|base64: x}"), "modifier"),
    (rule_text("t", "s: {a: x}", "'s | count() > 5'"), "aggregation"),
    (rule_text("t", "s: {a: x}", "s and nope"), "unknown selection"),
    (rule_text("t", "s: {a: x}", "(s"), "'\\)'"),
    (rule_text("t", "s: {a: x}", "s)"), "well formed"),
    (rule_text("t", "s: {a: x}", "s s"), "well formed"),
    (rule_text("t", "s: {a: x}", "s and"), "well formed"),
    (rule_text("t", "s: {a: x}", "1 of y*"), "no selection"),
    (rule_text("t", "s: {a: x}", "2 of s*"), "unknown selection"),
    (rule_text("t", "s: {a|re: '('}"), "not a pattern"),
    (rule_text("t", "s: {a|cidr: 1.2.3.4/99}"), "not a network"),
    (rule_text("t", "s: {a|gt: many}"), "number"),
    (rule_text("t", "s: just text"), "a selection is"),
    (rule_text("t", "s: [{a: 1}, text]"), "a selection is"),
    (GOOD.replace("webserver", "mainframe"), "logsource"),
    (GOOD.replace("title: t", "level: urgent\ntitle: t"), "level"),
    (GOOD.replace("title: t", ""), "title"),
    (GOOD.replace("name: t", ""), "name"),
    (GOOD.replace("  condition: s\n", ""), "condition"),
    (GOOD + "  timeframe: 5m\n", "timeframe"),
    ("title: t\nname: t\nlogsource: {category: webserver}\ndetection: {condition: x}", "no selections"),
    ("title: t\nname: t\ndetection: {s: {a: 1}, condition: s}", "logsource"),
    ("- just\n- a list", "mapping"),
    ("title: [", "YAML"),
    (GOOD + "---\n" + GOOD, "duplicate"),
    (GOOD + "---\n" + CORRELATION.replace("[t]", "[ghost]"), "unknown rule"),
    (GOOD + "---\n" + CORRELATION.replace("event_count", "sum"), "type"),
    (GOOD + "---\n" + CORRELATION.replace("[t]", "[]"), "rules"),
    (GOOD + "---\n" + CORRELATION.replace("gte", "lte"), "condition"),
    (GOOD + "---\n" + CORRELATION.replace("{gte: 2}", "{gte: 2, gt: 1}"), "exactly one"),
    (GOOD + "---\n" + CORRELATION.replace("{gte: 2}", "{gte: many}"), "whole number"),
    (GOOD + "---\n" + CORRELATION.replace("event_count", "value_count"), "field"),
    (GOOD + "---\n" + CORRELATION.replace("1m", "1 week"), "timespan"),
])
def test_unusable_rules_are_refused_when_read(text, word):
    with pytest.raises(RuleError, match=word):
        rules(text)


def test_patterns_java_cannot_read_are_refused_before_the_job(spark):
    with pytest.raises(RuleError, match="regex"):
        check_patterns(spark, rules_from_text(rule_text("t", r"s: {a|re: '(x)?(?(1)c|d)'}")))


def test_timespans():
    assert [timespan_us(t) for t in ("30s", " 5m ", "1h", "1d", 2, 0.5)] == [
        30_000_000, 300_000_000, 3_600_000_000, 86_400_000_000, 2_000_000, 500_000]
    with pytest.raises(ValueError):
        timespan_us("5 min")


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(3)
    texts = ["", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.4 ", ":", "::", ":::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7",
             "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "::12345", "::g", "fe80::1%eth0", "fe80::1%", "::ffff:1.2.3.4",
             "::1.2.3.400", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "1.2.3.4::", "::1.2.3.4:5", ":1:2:3:4:5:6:7", "A::b", "a:b"]
    for _ in range(400):
        texts.append(str(ipaddress.ip_address(rng.getrandbits(32))))
        six = ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))
        texts.append(rng.choice([str(six), six.exploded, str(six).upper()]))
    nets = ["10.0.0.0/8", "128.0.0.0/2", "0.0.0.0/0", "::/0", "::/1", "2000::/3", "fe80::/10", "::ffff:0:0/96"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", ipv4_value(F.col("t")).alias("v4"), ipv6_hex(F.col("t")).alias("v6"),
        *[in_network(F.col("t"), net).alias(f"n{i}") for i, net in enumerate(nets)]).collect()
    for row in rows:
        try:
            address = ipaddress.ip_address(row["t"])
        except ValueError:
            address = None
        four = address is not None and address.version == 4
        six = address is not None and address.version == 6
        assert row["v4"] == (int(address) if four else None), row["t"]
        assert row["v6"] == (f"{int(address):032x}" if six else None), row["t"]
        for i, net in enumerate(nets):
            assert row[f"n{i}"] == (address is not None and address in ipaddress.ip_network(net)), (row["t"], net)


def test_shipped_rules():
    shipped = load_rules()
    assert len(shipped) == 30
    assert all(r.tags or r.level == "informational" for r in shipped)
    assert silenced(shipped) == {r.name for r in shipped if r.level == "informational"}
    assert [[r.name for r in level] for level in levels_of(shipped)][1] == ["ssh_compromise", "win_compromise"]


# For every shipped rule on single events: fields that make it fire, and the one change that does not.
SHIPPED = {
    "ssh_root_login": ("ssh", {"action": "accepted", "user": "root"}, {"user": "toor"}),
    "web_sqli": ("nginx", {"cs-uri-query": "id=1' OR 1=1--"}, {"cs-uri-query": "q=union+of+states"}),
    "web_xss": ("nginx", {"cs-uri-query": "q=<ScRipt>"}, {"cs-uri-query": "q=script"}),
    "web_path_traversal": ("nginx", {"cs-uri-stem": "/x/../y"}, {"cs-uri-stem": "/x/..."}),
    "web_log4shell": ("nginx", {"cs-referer": "${JNDI:ldap://x}"}, {"cs-referer": "$jndi"}),
    "web_scanner_useragent": ("nginx", {"cs-user-agent": "Nikto/2"}, {"cs-user-agent": "Mozilla"}),
    "win_user_created": ("windows", {"EventID": 4720}, {"EventID": 4721}),
    "win_admin_group_added": ("windows", {"EventID": 4732, "TargetUserName": "administratorer"}, {"TargetUserName": "Users"}),
    "win_log_cleared": ("windows", {"EventID": 104, "Channel": "System"}, {"Channel": "Setup"}),
    "win_service_installed": ("windows", {"EventID": 7045}, {"EventID": 7046}),
    "win_encoded_powershell": ("windows", {"EventID": 4688, "Image": "C:\\PowerShell.exe", "CommandLine": "p -Enc x"}, {"EventID": 4689}),
    "win_office_spawns_shell": ("windows", {"EventID": 1, "ParentImage": "C:\\WINWORD.EXE", "Image": "C:\\cmd.exe"}, {"Image": "C:\\calc.exe"}),
    "win_credential_dumping_cli": ("windows", {"EventID": 4688, "CommandLine": "x SEKURLSA::y"}, {"CommandLine": "lsadump::sam"}),
}


def test_every_shipped_rule_fires_and_only_on_its_own_sample(spark):
    rows, expected, host = [], [], 0
    for name, (source, fields, change) in SHIPPED.items():
        for sample, fires in ((fields, True), ({**fields, **change}, False)):
            host += 1
            rows.append(event(0, source, host=f"h{host}", **sample))
            if fires:
                expected.append((name, f"h{host}"))

    def repeat(n, gap, source, **fields):
        rows.extend(event(i * gap, source, **{k: v(i) if callable(v) else v for k, v in fields.items()}) for i in range(n))

    for n, ip in ((8, "8.0.0.1"), (7, "8.0.0.2")):
        repeat(n, 40, "ssh", action="failed_password", src_ip=ip, user="a")
        repeat(n, 40, "windows", EventID=4625, IpAddress=ip, TargetUserName="a")
    for n, ip in ((20, "8.0.1.1"), (19, "8.0.1.2")):
        repeat(n, 180, "ssh", action="failed_password", src_ip=ip, user="a")
    for n, ip in ((5, "8.0.2.1"), (4, "8.0.2.2")):
        repeat(n, 140, "ssh", action="failed_password", src_ip=ip, user=lambda i: f"u{i}")
        repeat(n, 140, "windows", EventID=4625, IpAddress=ip, TargetUserName=lambda i: f"u{i}")
    for n, ip in ((3, "8.0.3.1"), (2, "8.0.3.2")):
        repeat(n, 100, "nginx", **{"cs-uri-stem": "/.env", "c-ip": ip})
    for n, ip in ((25, "8.0.4.1"), (24, "8.0.4.2")):
        repeat(n, 2, "nginx", **{"sc-status": 404, "c-ip": ip})
    for n, ip in ((10, "8.0.5.1"), (9, "8.0.5.2")):
        repeat(n, 10, "nginx", **{"cs-method": "POST", "cs-uri-stem": "/wp-login.php", "sc-status": 403, "c-ip": ip})
    rows.append(event(300, "ssh", action="accepted", src_ip="8.0.0.1", user="a"))
    rows.append(event(300, "ssh", action="accepted", src_ip="8.0.0.2", user="a"))
    rows.append(event(300, "windows", EventID=4624, LogonType=10, IpAddress="8.0.0.1"))
    rows.append(event(300, "windows", EventID=4624, LogonType=2, IpAddress="8.0.0.1"))
    # Local failures do not count, and one without any address matches but belongs to no group.
    repeat(20, 1, "windows", EventID=4625, IpAddress="127.0.0.1")
    repeat(20, 1, "windows", EventID=4625)
    expected += [("ssh_bruteforce", "8.0.0.1"), ("win_bruteforce", "8.0.0.1"), ("ssh_compromise", "8.0.0.1"), ("win_compromise", "8.0.0.1"),
                 ("ssh_slow_bruteforce", "8.0.1.1"), ("ssh_password_spray", "8.0.2.1"), ("win_password_spray", "8.0.2.1"),
                 ("web_scanner_probing", "8.0.3.1"), ("web_404_flood", "8.0.4.1"), ("web_login_bruteforce", "8.0.5.1")]
    shipped = load_rules()
    found = sorted((a["rule"], *a["grp"].values()) for a in alerts(spark, shipped, rows))
    assert found == sorted(expected)
    assert {name for name, _ in found} == {r.name for r in shipped} - silenced(shipped)


def test_rule_tables(spark):
    shipped = load_rules()
    catalogue = rule_catalogue(spark, shipped).collect()
    assert [(r["folder"], r["rule"]) for r in catalogue[:2]] == [("ssh", "ssh_compromise"), ("ssh", "ssh_bruteforce")]
    assert catalogue[0]["tags"] == "credential access, T1110, initial access, T1078"
    listed = {r["rule"]: (r["kind"], r["alerts"]) for r in rule_list(spark, shipped).collect()}
    assert listed["ssh_failed_login"] == ("rule", "no") and listed["ssh_bruteforce"] == ("event_count", "yes")
