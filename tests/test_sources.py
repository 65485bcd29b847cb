"""Log formats line by line, and files: numbering, telling layouts apart, reading again."""

import json
from datetime import date, datetime, timezone

import pytest

from watchspan.sources.access import access_events
from watchspan.sources.ingest import EventTable, ingest_report, read_logs, rejects
from watchspan.sources.lines import read_lines
from watchspan.sources.sshd import sshd_events
from watchspan.sources.windows import windows_json_events, windows_xml_events

UTC = timezone.utc


def rows_of(spark, texts):
    return spark.createDataFrame([("file", k, t) for k, t in enumerate(texts)], "origin string, lineno long, raw string")


def read_one(spark, normaliser, text, **options):
    """The event of a line as (time, host, fields), or None if it is not understood."""
    row, = normaliser(rows_of(spark, [text]), **options).collect()
    return (row["ts"], row["host"], row["fields"]) if row["ok"] else None


def read_all(spark, normaliser, texts, **options):
    found = normaliser(rows_of(spark, texts), **options).orderBy("lineno").collect()
    return [(r["ts"], r["host"], r["fields"]) if r["ok"] else None for r in found]


REQUESTS = {
    # request line: method, uri, stem, query, version
    "PUT /shelf/7?box=a%2Bb+c&x=%E2%82%AC HTTP/2.0": ("PUT", "/shelf/7?box=a%2Bb+c&x=%E2%82%AC", "/shelf/7", "box=a+b c&x=€", "HTTP/2.0"),
    "GET /a%2Fb??%q HTTP/1.1": ("GET", "/a%2Fb??%q", "/a/b", "?%q", "HTTP/1.1"),
    "ping": ("", "ping", "ping", "", ""),
    "HEAD / HTTP/1.1": ("HEAD", "/", "/", "", "HTTP/1.1"),
}


def test_requests_of_an_access_log(spark):
    texts = [f'2001:db8::7 - clerk [09/Mar/2031:23:59:58 -0330] "{request}" 207 0042 "-" "cart/2"' for request in REQUESTS]
    for (ts, host, got), want in zip(read_all(spark, access_events, texts, host="shop"), REQUESTS.values()):
        assert (ts, host) == (datetime(2031, 3, 10, 3, 29, 58), "shop")
        assert tuple(got[k] for k in ("cs-method", "cs-uri", "cs-uri-stem", "cs-uri-query", "cs-version")) == want
        assert (got["c-ip"], got["cs-username"], got["sc-status"], got["sc-bytes"]) == ("2001:db8::7", "clerk", "207", "42")
        assert (got["cs-referer"], got["cs-user-agent"]) == ("-", "cart/2")


def test_edges_of_an_access_log(spark):
    start = '10.9.8.7 - - [01/Jan/2031:00:00:00 +0000] "GET /x HTTP/1.1" 200'
    no_agent, dashes, quoted = read_all(spark, access_events, [f"{start} 17", f'{start} - "-" "-"', f'{start} 1 "a \\"b\\"" "c" more'])
    assert [no_agent[2][k] for k in ("cs-referer", "cs-user-agent", "cs-username")] == ["", "", ""]
    assert dashes[2]["sc-bytes"] == "0" and quoted[2]["cs-referer"] == 'a \\"b\\"'
    bad = ["", "10.9.8.7 GET /x", start.replace("01/Jan", "31/Feb") + " 1", start.replace("200", "2xx") + " 1", start.replace("[", "") + " 1"]
    assert read_all(spark, access_events, bad) == [None] * len(bad)


@pytest.mark.parametrize("unit", ["long ", '\\"', "\\\\"])
def test_a_line_of_a_million_characters(spark, unit):
    agent = unit * (1_000_000 // len(unit))
    got = read_one(spark, access_events, f'10.9.8.7 - - [01/Jan/2031:00:00:00 +0000] "GET /x HTTP/1.1" 200 1 "-" "{agent}"')
    assert got[2]["cs-user-agent"] == agent


# message: action, user, address, port, method, invalid_user
MESSAGES = {
    "Failed publickey for ines from 192.0.2.1 port 50022 ssh2: ED25519 SHA256:q": ("failed_password", "ines", "192.0.2.1", "50022", "publickey", "false"),
    "Failed keyboard-interactive/pam for invalid user omar from 2001:db8::1 port 9 ssh2": ("failed_password", "omar", "2001:db8::1", "9", "keyboard-interactive/pam", "true"),
    "Accepted password for li from 192.0.2.2 port 7 ssh2": ("accepted", "li", "192.0.2.2", "7", "password", "false"),
    "Invalid user ada from 192.0.2.3 port 11": ("invalid_user", "ada", "192.0.2.3", "11", "", "true"),
    "Connection closed by invalid user guest 192.0.2.4 port 12 [preauth]": ("preauth_close", "guest", "192.0.2.4", "12", "", "false"),
    "error: maximum authentication attempts exceeded for invalid user x from 192.0.2.5 port 13 ssh2 [preauth]": ("max_auth", "x", "192.0.2.5", "13", "", "false"),
}


def test_messages_of_sshd(spark):
    texts = [f"Mar  2 05:06:07 store sshd[88]: {m}" for m in [*MESSAGES, "Received signal 15; terminating."]]
    *known, other = read_all(spark, sshd_events, texts, year=2031, now=datetime(2031, 4, 1, tzinfo=UTC))
    for (ts, host, got), (message, want) in zip(known, MESSAGES.items()):
        assert (ts, host, got["message"], got["service"], got["process_id"]) == (datetime(2031, 3, 2, 5, 6, 7), "store", message, "sshd", "88")
        assert tuple(got[k] for k in ("action", "user", "src_ip", "src_port", "auth_method", "invalid_user")) == want, message
    assert other[2]["action"] == "other" and "user" not in other[2]


def test_times_of_sshd(spark):
    now = datetime(2031, 1, 3, tzinfo=UTC)
    texts = ["Dec 30 12:00:00 h sshd: x", "Jan  3 12:00:00 h sshd: x", "Jan  5 12:00:00 h sshd: x", "2030-06-01T01:02:03.5-04:00 h sshd: x",
             "2030-06-01T01:02:03 h sshd: x", "Nov 31 12:00:00 h sshd: x", "Jan  3 12:00:00 h crond: x"]
    got = read_all(spark, sshd_events, texts, offset="-02:00", now=now, host="named")
    assert [g and g[0] for g in got] == [datetime(2030, 12, 30, 14), datetime(2031, 1, 3, 14), datetime(2030, 1, 5, 14), datetime(2030, 6, 1, 5, 2, 3, 500000),
                                         datetime(2030, 6, 1, 3, 2, 3), None, None]
    assert {g[1] for g in got if g} == {"named"}
    with pytest.raises(ValueError):
        sshd_events(rows_of(spark, ["x"]), offset="somewhere")


def test_windows_records_in_json(spark):
    shelf = {"TargetUserName": "ines", "LogonType": 3, "Gone": None, "List": [1, {"k": "v"}], "Computer": "inside", "Sure": False}
    nested = {"@timestamp": "2031-03-02T05:06:07.25Z", "winlog": {"event_id": 4624, "computer_name": "PC-1", "channel": "Security", "provider_name": "Auth", "event_data": shelf}}
    flat = {"TimeCreated": 1930194367.5, "EventID": "4688", "Computer": "", "EventData": {"NewProcessName": "D:\\tool.exe", "ParentProcessName": "D:\\boss.exe"}}
    ticks = {"SystemTime": "/Date(1930194367500)/", "Id": 5, "MachineName": "PC-2"}
    first, second, third = read_all(spark, windows_json_events, [json.dumps(d) for d in (nested, flat, ticks)])
    assert first[:2] == (datetime(2031, 3, 2, 5, 6, 7, 250000), "PC-1")
    assert first[2] == {"TargetUserName": "ines", "LogonType": "3", "List": '[1,{"k":"v"}]', "Sure": "false", "EventID": "4624", "Channel": "Security",
                        "Provider": "Auth", "Computer": "PC-1"}
    assert second[:2] == (datetime(2031, 3, 2, 5, 6, 7, 500000), "windows")
    assert (second[2]["Image"], second[2]["ParentImage"]) == ("D:\\tool.exe", "D:\\boss.exe")
    assert third[:2] == (datetime(2031, 3, 2, 5, 6, 7, 500000), "PC-2")
    bad = ["{", "7", '"text"', "[]", json.dumps({**flat, "EventID": "many"}), json.dumps({"EventID": 4688}), json.dumps({**flat, "TimeCreated": "noon"})]
    assert read_all(spark, windows_json_events, bad) == [None] * len(bad)


@pytest.mark.parametrize("text, want", [("20310302T050607Z", (5, 6, 7)), ("20310302T0506+0100", (4, 6, 0)), ("20310302T050607.5", (5, 6, 7)),
                                        ("203103021", None), ("20310302T05x", None)])
def test_times_in_the_basic_form(spark, text, want):
    got = read_one(spark, windows_json_events, json.dumps({"EventID": 1, "TimeCreated": text}))
    assert (got and (got[0].hour, got[0].minute, got[0].second)) == want


def element(number="4625", time="2031-03-02T05:06:07.123456700Z", computer="PC-3", data="", more=""):
    return (f'<Event xmlns="urn:made-up"><System><Provider Name="Door &amp; Lock"/><EventID>{number}</EventID><TimeCreated SystemTime="{time}"/>'
            f"<Channel>Security</Channel><Computer>{computer}</Computer></System><EventData>{data}</EventData>{more}</Event>")


def test_windows_records_in_xml(spark):
    data = '<Data Name="TargetUserName">ines &lt;3</Data><Data Name="Blank"/><Data>loose</Data>'
    more = '<UserData><k:Case xmlns:k="urn:k"><k:Colour> red &amp; bl&#x75;e </k:Colour><Note><![CDATA[a < b & c]]></Note><None/></k:Case></UserData>'
    full, unnamed, cut, empty, word = read_all(spark, windows_xml_events, [
        element(data=data, more=more), element("4688", computer="", data='<Data Name="NewProcessName">D:\\tool.exe</Data>'), element()[:-12], "<Event/>", element("many")])
    assert full[:2] == (datetime(2031, 3, 2, 5, 6, 7, 123456), "PC-3")
    assert full[2] == {"TargetUserName": "ines <3", "Blank": "", "Data": "loose", "Colour": "red & blue", "Note": "a < b & c", "None": "", "EventID": "4625", "Channel": "Security",
                       "Provider": "Door & Lock", "Computer": "PC-3"}
    assert unnamed[1] == "windows" and unnamed[2]["Image"] == "D:\\tool.exe" and unnamed[2]["ParentImage"] == ""
    assert cut is None and empty is None and word is None


def test_line_numbers_do_not_depend_on_where_files_are_cut(spark, tmp_path):
    wanted = {}
    for name, n in (("long.log", 4000), ("short.log", 3)):
        texts = [b"" if k % 17 == 3 else b" \t" if k % 17 == 9 else b"\xffbad %d" % k if k % 17 == 5 else b"line %d of many" % k for k in range(n)]
        (tmp_path / name).write_bytes(b"\n".join(texts))
        wanted |= {(name, k + 1): t.decode("utf-8", "replace") for k, t in enumerate(texts) if t.strip()}
    size = "spark.sql.files.maxPartitionBytes"
    try:
        spark.conf.set(size, "3000")
        read = read_lines(spark, [str(tmp_path / "long.log"), str(tmp_path / "short.log"), str(tmp_path / "short.log")])
        spark.conf.set(size, "1100")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "23")
        assert {(r["origin"].rsplit("/", 1)[1], r["lineno"]): r["raw"] for r in read.collect()} == wanted
    finally:
        spark.conf.unset(size)
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_a_folder_of_mixed_exports(spark, tmp_path):
    names = {"whole.xml": f"<?xml version='1.0'?>\n<Events>{element(computer='w1')}\n{element(computer='w2')}</Events>\n", "bare.xml": element(computer="b1") + element(computer="b2"),
             "cut.xml": element(computer="c1") + element(computer="c2")[:-len("<EventData></EventData></Event>")], "only.xml": "  \n" + element(computer="o1")[:90],
             "lines.json": "\n\n" + "\n".join(json.dumps({"EventID": 1, "TimeCreated": "2031-03-02T05:06:07Z", "Computer": f"j{k}"}) for k in range(300)) + "\n<Event >\n"}
    for name, text in names.items():
        (tmp_path / name).write_text(text)
    read = read_logs(spark, "windows", str(tmp_path)).collect()
    assert sorted(r["host"] for r in read if r["ok"] and r["host"][0] != "j") == ["b1", "b2", "c1", "w1", "w2"]
    own = [r for r in read if r["origin"].endswith("lines.json")]
    assert len(own) == 301 and {r["lineno"] for r in own if not r["ok"]} == {303}
    assert read_logs(spark, "windows", str(tmp_path / "bare.xml"), layout="xml").count() == 2
    with pytest.raises(ValueError):
        read_logs(spark, "windows", str(tmp_path), layout="yaml")


def test_a_file_read_twice_is_stored_once(spark, tmp_path):
    log, table = tmp_path / "door.log", EventTable(str(tmp_path / "events"))

    def ingest(seconds):
        log.write_text("".join(f"Mar  2 05:06:{s:02d} gate sshd[1]: hello\n" if s < 60 else "noise\n" for s in seconds))
        read = read_logs(spark, "ssh", str(log), year=2031, now=datetime(2031, 4, 1, tzinfo=UTC))
        told, = table.ingest(read).collect()
        return told["stored"], told["duplicates"], told["not_understood"], told["wrong_type"]

    assert ingest([1, 2, 2, 99]) == (3, 0, 1, False)
    assert ingest([1, 2, 2, 99]) == (0, 3, 1, False)
    assert ingest([1, 2, 2, 7, 99, 99]) == (1, 3, 2, False)
    assert table.read(spark).count() == 4
    strange = read_logs(spark, "nginx", str(log))
    assert [r["wrong_type"] for r in ingest_report(strange, table.new_events(strange)).collect()] == [True] and rejects(strange).count() == 6
    with pytest.raises(ValueError):
        read_logs(spark, "toaster", str(log))


def test_new_files_are_not_compared_with_stored_events(spark, tmp_path):
    table, line = EventTable(str(tmp_path / "events")), "Mar  {} 05:06:07 gate sshd[1]: hello\n"
    read = lambda name: read_logs(spark, "ssh", str(tmp_path / name), year=2031, now=datetime(2031, 4, 1, tzinfo=UTC))
    for day, name in enumerate(("a.log", "b.log", "c.log"), 2):
        (tmp_path / name).write_text(line.format(day))
    table.append(read("a.log"))
    looks_at = lambda df: {str(day) for day in range(2, 5) if any(f"day=2031-03-0{day}" in f for f in df.inputFiles())}
    assert looks_at(table.new_events(read("b.log"))) == set()
    table.append(read("b.log"))
    # A file that was read before is compared with the days it had.
    plan = table.new_events(read("b.log"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and plan.count("2031-03-03") >= 2 and "2031-03-02" not in plan
    assert sorted((r.origin[-5:], r.events) for r in table.files(spark).collect()) == [("a.log", 1), ("b.log", 1)]

    # A run that broke off after listing its file: the next one adds the events.
    table.files(spark).limit(0).unionByName(spark.createDataFrame([((tmp_path / "c.log").as_uri(), date(2031, 3, 4), date(2031, 3, 4), 1)],
                                                                  table.files(spark).schema)).write.mode("append").parquet(f"{table.path}/_files")
    table.append(read("c.log"))
    table.append(read("c.log"))
    assert table.read(spark).count() == 3
