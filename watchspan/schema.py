"""Table layouts and the fixed vocabulary shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names in rising order.
LEVELS = ["informational", "low", "medium", "high", "critical"]
# Event sources.
SOURCES = ["nginx", "ssh", "windows"]
# Fields that may carry the address of the acting party, in order of preference.
ADDRESS_FIELDS = ["c-ip", "src_ip", "IpAddress"]
# Texts that count as "no value" besides an absent field.
MISSING_TEXTS = ["", "-"]
# Single-event hits of one rule and entity stay one alert while gaps do not exceed this.
MERGE_GAP_SECONDS = 300
# Evidence ids kept inside an alert row unless ``detect`` is told another number; the evidence table holds all.
EVIDENCE_IN_ALERT = 1000

MICROS = 1_000_000

EVENTS = ("event_id string, ts timestamp, ts_us bigint, source string, host string, "
          "fields map<string,string>, raw string, origin string, day date")
MATCHES = ("rule string, ts_us bigint, match_id string, entity string, "
           "fields map<string,string>")
BURSTS = ("rule string, grp array<string>, first_us bigint, trigger_us bigint, last_us bigint, "
          "n_matches bigint, alert_id string")


def level_rank(level: Column) -> Column:
    """0 for the mildest level, 4 for the worst."""
    return (F.array_position(F.array(*[F.lit(name) for name in LEVELS]), level) - 1).cast("int")


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in LEVELS]), rank.cast("int") + 1)


def to_timestamp_us(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def iso_seconds(ts: Column) -> Column:
    """UTC text floored to whole seconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
