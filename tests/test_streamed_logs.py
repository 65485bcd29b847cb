"""Logs read as a stream, file by file, against the batch."""

import os
import time

import pytest
from helpers import rules

from watchspan.operators.matching import match_events
from watchspan.sources.ingest import read_logs, with_event_id
from watchspan.streaming.hits import hit_stream
from watchspan.streaming.logs import log_stream

SSHD = ["Mar  3 10:00:01 gate sshd[11]: Failed password for ines from 192.0.2.9 port 4100 ssh2", "", "not a log line",
        "Mar  3 10:00:05 gate sshd[11]: Accepted password for ines from 192.0.2.9 port 4100 ssh2"]
ACCESS = '198.51.100.4 - - [03/Mar/2031:10:00:0{} +0000] "GET /a HTTP/1.1" 404 12 "-" "probe"'
EVENT = "<Event><System><Provider Name='P'/><EventID>{}</EventID><TimeCreated SystemTime='2031-03-03T10:00:00Z'/><Computer>c</Computer></System><EventData/></Event>"
LOGS = {
    "ssh": {"a.log": "\n".join(SSHD) + "\n", "b.log": "\r\n".join(reversed(SSHD)), "empty.log": ""},
    "nginx": {"a.log": "\n\n".join(ACCESS.format(k) for k in range(5)), "b.log": ACCESS.format(7).replace("probe", "caf\xe9")},
    "windows": {"a.xml": "﻿ <Events>" + "".join(map(EVENT.format, (1, 2, 2))) + "</Events>", "cut.xml": EVENT.format(3) + EVENT.format(4)[:-9],
                "bare.xml": EVENT.format(5) + "\n" * 10_000, "b.json": '{"EventID": 7, "TimeCreated": "2031-03-03T10:00:00Z", "Computer": "j"}\n\n{"EventID": '},
}


def put(folder, name, text):
    """As one step, so that a stream never sees half a file; a stream goes by the time of change, in milliseconds."""
    scratch = folder.parent / f"scratch-{name}"
    scratch.write_bytes(text.encode("latin-1" if "\xe9" in text else "utf-8"))
    time.sleep(0.02)
    os.utime(scratch)
    scratch.replace(folder / name)


def drained(stream, checkpoint):
    rows = []
    query = (stream.drop("arrived").writeStream.foreachBatch(lambda df, _: rows.extend(r.asDict() for r in df.collect()))
             .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start())
    query.awaitTermination(300)
    return rows


@pytest.mark.parametrize("kind", LOGS)
def test_files_that_arrive_one_by_one_give_the_events_of_the_batch(spark, tmp_path, kind):
    folder, options = tmp_path / kind, {"year": 2031} if kind == "ssh" else {}
    folder.mkdir()
    for name, text in LOGS[kind].items():
        put(folder, name, text)
    batch = [r.asDict() for r in with_event_id(read_logs(spark, kind, str(folder), **options)).collect()]
    found = drained(log_stream(spark, kind, str(folder), 1, max_file_age="1ms", **options), tmp_path / "checkpoint")
    by_id = lambda rows: sorted(rows, key=lambda r: r["event_id"])
    assert by_id(found) == by_id(batch) and len(batch) >= 4

    # The same files again add nothing, a grown one what is new.
    for name, text in LOGS[kind].items():
        put(folder, name, text)
    if kind == "nginx":
        put(folder, "a.log", LOGS[kind]["a.log"] + "\n" + ACCESS.format(9))
    again = drained(log_stream(spark, kind, str(folder), 1, max_file_age="1ms", **options), tmp_path / "checkpoint")
    new = again if kind != "nginx" else [r for r in again if ":09 " not in r["raw"]]
    assert new == [] and len(again) == (kind == "nginx")


def test_rules_match_what_streams_in(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for name, text in LOGS["ssh"].items():
        put(tmp_path / "logs", name, text)
    chosen = rules("title: r\nname: r\nlogsource: {service: sshd}\ndetection: {s: {action: accepted}, condition: s}")
    hits = drained(hit_stream(log_stream(spark, "ssh", str(tmp_path / "logs"), 1, year=2031), chosen), tmp_path / "checkpoint")
    batch = match_events(with_event_id(read_logs(spark, "ssh", str(tmp_path / "logs"), year=2031)), chosen).collect()
    assert sorted(h["match_id"] for h in hits) == sorted(m.match_id for m in batch) and len(batch) == 2


def test_an_export_keeps_its_last_event(spark, tmp_path):
    """Blanks behind the last event, however many, cut nothing off; what was never closed is no event."""
    texts = {"blanks": EVENT.format(1) + EVENT.format(2) + "\n" * 10_000, "bare": EVENT.format(3), "wrapped": f"﻿<Events>{EVENT.format(4)}</Events>\n",
             "cut": EVENT.format(5) + EVENT.format(6)[:-8], "bom": "﻿" + EVENT.format(7), "bom-cut": "﻿" + EVENT.format(8) + EVENT.format(9)[:-8], "empty": "", "blank": " \n" * 3000}
    for name, text in texts.items():
        (tmp_path / f"{name}.xml").write_text(text, encoding="utf-8")
    found = read_logs(spark, "windows", str(tmp_path)).filter("ok").selectExpr("fields.EventID").collect()
    assert sorted(int(r.EventID) for r in found) == [1, 2, 3, 4, 5, 7, 8]
