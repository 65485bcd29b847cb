from datetime import datetime

import duckdb
import pytest

from checks import matching, sources

MODULES = {"match_networks": matching, "sshd_year_rollover": sources}


def events(spark, folder, rows):
    rows = [(event, datetime.fromisoformat(ts), user, "view", 1.0, '{"k": 1}') for event, ts, user in rows]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/events.parquet")


def differences(spark, folder, name):
    got = [tuple(r) for r in MODULES[name].QUERIES[name](spark, str(folder)).collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    wanted = db.execute(MODULES[name].SQL[name]).fetchall()
    assert len(wanted) == len(got)
    return set(wanted) ^ set(got)


@pytest.mark.parametrize("user", [100, 249, 63_999, 64_000, 64_102, 600_100, 16_384_064])
def test_networks_of_many_users(spark, tmp_path, user):
    events(spark, tmp_path, [(300, "2024-01-05 01:02:03", user), (70_000, "2024-01-05 01:02:03", user + 1)])
    assert not differences(spark, tmp_path, "match_networks")


def test_year_of_events_inside_a_second(spark, tmp_path):
    times = ["2024-01-11 00:00:00", "2024-01-11 00:00:00.000001", "2024-01-11 00:00:00.999999", "2024-01-10 23:59:59.999999",
             "2024-01-11 00:00:01", "2024-01-01 00:00:00", "2024-12-31 23:59:59", "2024-12-31 23:59:59.5"]
    events(spark, tmp_path, [(k, ts, 1) for k, ts in enumerate(times)])
    assert not differences(spark, tmp_path, "sshd_year_rollover")
