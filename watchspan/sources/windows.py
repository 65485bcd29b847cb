"""Exported Windows events: JSON lines in two layouts, and XML."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.sources.lines import iso_time, not_blank, once, parsed, read_lines, whole_lines

TEXT_MAP = "map<string,string>"
# Keys of the flat layout, the first one present counts.
FLAT_KEYS = {
    "event_id": ["EventID", "EventId", "Id"],
    "time": ["TimeCreated", "SystemTime", "@timestamp"],
    "computer": ["Computer", "MachineName"],
    "channel": ["Channel", "LogName"],
    "provider": ["Provider", "ProviderName"],
}
# Keys of the nested layout, below "winlog".
NESTED_KEYS = {"event_id": "event_id", "computer": "computer_name", "channel": "channel",
               "provider": "provider_name"}
# Names that describe the event itself and win over its data.
ENVELOPE = ["EventID", "Channel", "Provider", "Computer"]
PROCESS_CREATED = 4688
# Epoch numbers above this are milliseconds.
MILLISECONDS_ABOVE = 1e11

XML_EVENT = ("struct<System: struct<Provider: struct<_Name: string>, EventID: string, "
             "TimeCreated: struct<_SystemTime: string>, Channel: string, Computer: string>, "
             "EventData: struct<Data: array<struct<_Name: string, _VALUE: string>>>>")


def _is_number(raw: Column, path: str) -> Column:
    """Whether the JSON value at the path is a number and not a text that looks like one."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), path, "variant"))
    return kind.rlike("BIGINT|DECIMAL|DOUBLE|FLOAT")


def event_time(text: Column, is_number: Column) -> Column:
    """Epoch seconds or milliseconds, ``/Date(milliseconds)/`` or ISO-8601, UTC unless it says so."""
    number = text.try_cast("double")
    seconds = F.when(number > MILLISECONDS_ABOVE, number / 1000).otherwise(number)
    micros = F.round(seconds * 1_000_000).try_cast("bigint")
    legacy = r"\A\s*/Date\((\d+)\)/\s*\z"
    # Nested, so that it is only looked up for the few texts that are numbers.
    return (F.when(text.rlike(r"\A-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\z"),
                   F.when(is_number, F.timestamp_micros(micros)))
            .when(text.rlike(legacy), F.timestamp_millis(F.regexp_extract(text, legacy, 1).try_cast("bigint")))
            .when(text.rlike(r"\A\s|\s\z"), iso_time(F.regexp_replace(text, r"\A\s+|\s+\z", ""), "+00:00"))
            .otherwise(iso_time(text, "+00:00")))


def event_number(text: Column, is_number: Column) -> Column:
    return (F.when(text.rlike(r"\A\s*[+-]?\d+\s*\z"), F.trim(text).try_cast("bigint"))
            .when(text.rlike(r"\A[+-]?\d+\.\d+\z"),
                  F.when(is_number, text.try_cast("double").try_cast("bigint"))))


ENTRIES = "array<struct<key:string,value:string>>"


def _last_of_each_key(entries: Column) -> Column:
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.when(F.size(F.array_distinct(keys)) < F.size(entries), last).otherwise(entries)


def _entry(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), value.alias("value"))


def _fields(kept: Column, number: Column, channel: Column, provider: Column, computer: Column) -> Column:
    """Event data and envelope in one map. New processes get an image if the data has none."""
    values = (number.cast("string"), channel, provider, computer)
    envelope = F.array(*[_entry(name, value) for name, value in zip(ENVELOPE, values)])

    def named(origin: str) -> Column:
        return F.coalesce(F.get(F.filter(kept, lambda e: e["key"] == origin), F.lit(0))["value"], F.lit(""))

    images = F.filter(F.array(_entry("Image", named("NewProcessName")),
                              _entry("ParentImage", named("ParentProcessName"))),
                      lambda image: ~F.exists(kept, lambda e: e["key"] == image["key"]))
    return F.map_from_entries(F.when(number == PROCESS_CREATED, F.concat(kept, envelope, images))
                              .otherwise(F.concat(kept, envelope)))


def _finished(rows: DataFrame, host: str, ts: Column, number: Column, channel: Column, provider: Column,
              computer: Column, data: Column) -> DataFrame:
    """``data`` are the entries of the event data; the envelope wins over them, NULL is dropped."""
    rows = once(rows, number=number, data=F.coalesce(data, F.array().cast(ENTRIES)),
                channel=F.coalesce(channel, F.lit("")), provider=F.coalesce(provider, F.lit("")),
                computer=F.coalesce(computer, F.lit("")))
    rows = once(rows, kept=F.filter(_last_of_each_key(F.col("data")),
                                    lambda e: e["value"].isNotNull() & ~e["key"].isin(ENVELOPE)))
    named = F.when(F.col("computer") == "", "windows").otherwise(F.col("computer"))
    fields = _fields(F.col("kept"), F.col("number"), F.col("channel"), F.col("provider"), F.col("computer"))
    return parsed(rows, "windows", ts, F.lit(host) if host else named, fields, F.col("number").isNotNull())


def windows_json_events(lines: DataFrame, host: str = "") -> DataFrame:
    """Normalise (origin, lineno, raw) with one JSON object per line."""
    whole = F.when(F.col("raw").rlike(r"\}\s*\z"), F.from_json("raw", TEXT_MAP))
    rows = once(lines, doc=whole)
    rows = once(rows, winlog=F.when(F.try_element_at("doc", F.lit("winlog")).startswith("{"),
                                    F.from_json(F.try_element_at("doc", F.lit("winlog")), TEXT_MAP)))
    nested = F.col("winlog").isNotNull()

    def flat(what: str) -> Column:
        """The first key that is there counts, even if its value is NULL."""
        keys = FLAT_KEYS[what]
        value = F.when(F.map_contains_key("doc", keys[0]), F.try_element_at("doc", F.lit(keys[0])))
        for key in keys[1:]:
            value = value.when(F.map_contains_key("doc", key), F.try_element_at("doc", F.lit(key)))
        return value

    def flat_is_number(what: str) -> Column:
        keys = FLAT_KEYS[what]
        test = F.when(F.map_contains_key("doc", keys[0]), _is_number(F.col("raw"), f"$['{keys[0]}']"))
        for key in keys[1:]:
            test = test.when(F.map_contains_key("doc", key), _is_number(F.col("raw"), f"$['{key}']"))
        return test

    def either(what: str) -> Column:
        return F.when(nested, F.try_element_at("winlog", F.lit(NESTED_KEYS[what]))).otherwise(flat(what))

    rows = once(
        rows, time_text=F.when(nested, F.try_element_at("doc", F.lit("@timestamp"))).otherwise(flat("time")),
        id_text=either("event_id"),
        data_text=F.when(nested, F.try_element_at("winlog", F.lit("event_data"))).otherwise(
            F.try_element_at("doc", F.lit("EventData"))))
    time_is_number = F.when(nested, _is_number(F.col("raw"), "$['@timestamp']")).otherwise(flat_is_number("time"))
    id_is_number = F.when(nested, _is_number(F.col("raw"), "$.winlog.event_id")).otherwise(
        flat_is_number("event_id"))
    return _finished(rows, host, event_time(F.col("time_text"), time_is_number),
                     event_number(F.col("id_text"), id_is_number), either("channel"), either("provider"),
                     either("computer"), F.map_entries(F.from_json("data_text", TEXT_MAP)))


# What an element without children holds: text and CDATA sections.
_INSIDE = r"[^<]*(?:<!\[CDATA\[(?s:.*?)\]\]>[^<]*)*"


def _other_leaves(chunk: Column) -> Column:
    """Elements without children in UserData, and in EventData other than Data: name and text.

    Each is cut out as it stands and read by the XML reader, so that references and CDATA mean what they say.
    """
    section = F.concat(
        F.regexp_extract(chunk, r"(?s)<UserData[^>]*>(.*)</UserData>", 1),
        F.regexp_replace(F.regexp_extract(chunk, r"(?s)<EventData[^>]*>(.*)</EventData>", 1),
                         rf"<Data(?:\s[^<>]*)?(?:/>|>{_INSIDE}</Data>)", ""))
    leaves = F.regexp_extract_all(section, F.lit(rf"<([^\s<>/!]+)[^<>]*(?:/>|>{_INSIDE}</\1\s*>)"), F.lit(0))

    def entry(leaf: Column) -> Column:
        tag = F.regexp_extract(leaf, r"\A<(?:[^\s<>/:]+:)?([^\s<>/:]+)", 1)
        read = F.from_xml(leaf, F.lit("_VALUE string, _Name string"))
        name = F.coalesce(read["_Name"], F.lit(""))
        return F.struct(F.when(name != "", name).otherwise(tag).alias("key"), F.coalesce(read["_VALUE"], F.lit("")).alias("value"))

    return F.when(chunk.contains("<UserData") | (section != ""), F.transform(leaves, entry)).otherwise(
        F.array().cast("array<struct<key:string,value:string>>"))


def windows_xml_events(chunks: DataFrame, host: str = "") -> DataFrame:
    """Normalise (origin, lineno, raw) with one ``<Event>`` element per row.

    Namespaces are ignored; an element that is not well formed is not understood.
    """
    rows = once(chunks, doc=F.from_xml("raw", XML_EVENT), others=_other_leaves(F.col("raw")))
    system = F.col("doc")["System"]
    data = F.transform(F.coalesce(F.col("doc")["EventData"]["Data"], F.array()), lambda d: F.struct(
        F.when(F.coalesce(d["_Name"], F.lit("")) != "", d["_Name"]).otherwise("Data").alias("key"),
        F.coalesce(d["_VALUE"], F.lit("")).alias("value")))
    no = F.lit(False)
    return _finished(rows, host, event_time(system["TimeCreated"]["_SystemTime"], no),
                     event_number(system["EventID"], no), system["Channel"], system["Provider"]["_Name"],
                     system["Computer"], F.concat(data, F.col("others")))


def xml_chunks(rows: DataFrame) -> DataFrame:
    """Text that ended at ``</Event>``, from the opening of the element on; other text is dropped."""
    start = F.regexp_instr(F.col("raw"), F.lit("<Event[ >]"))
    return once(rows, start=start).filter("start > 0").withColumn(
        "raw", F.concat(F.substring("raw", F.col("start"), F.length("raw")), F.lit(CLOSING))).drop("start")


CLOSING = "</Event>"


def _xml_files(spark: SparkSession, files: list[str]) -> set[str]:
    """Those whose first mark is ``<``. Tasks look; the driver sees one character of each file."""
    mark = F.substring(F.regexp_replace("value", r"\A[\s\x{FEFF}]+", ""), 1, 1)
    rows = spark.read.text(files).select(F.input_file_name().alias("origin"), mark.alias("mark"),
                                         F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place")).filter("mark <> ''")
    first = rows.groupBy("origin").agg(F.min_by("mark", "place").alias("mark")).filter("mark = '<'")
    return {r.origin for r in first.select("origin").collect()}


def read_windows(spark: SparkSession, paths: str | Iterable[str], host: str = "",
                 layout: str | None = None) -> DataFrame:
    """Events of JSON or XML exports. Without ``layout`` each file's first mark decides.

    Every file is read by the separator of its own layout. Text after the last closed ``<Event>`` of a file, as of a
    file that was cut off, is no event.
    """
    if layout not in (None, "json", "xml"):
        raise ValueError(f"layout {layout!r} is neither json nor xml")
    chosen = [paths] if isinstance(paths, str) else list(paths)
    if layout == "json":
        return windows_json_events(read_lines(spark, chosen), host)
    files = spark.read.text(chosen).inputFiles()
    xml = set(files) if layout == "xml" else _xml_files(spark, files) if files else set()
    parts = []
    if len(xml) < len(files) or not files:
        parts.append(windows_json_events(read_lines(spark, [f for f in files if f not in xml] or chosen), host))
    if xml:
        parts.append(windows_xml_events(xml_chunks(read_lines(spark, sorted(xml), CLOSING, closed=True)), host))
    return reduce(DataFrame.unionByName, parts)


def whole_windows(files: DataFrame, host: str = "") -> DataFrame:
    """Events of exports that are one row each, (origin, text) and others."""
    rest = [c for c in files.columns if c not in ("origin", "text")]
    is_xml = F.ltrim(F.col("text"), F.lit(" \t\n\x0b\f\r\ufeff")).startswith("<")
    pieces = F.split("text", CLOSING, -1)
    chunks = files.filter(is_xml).select("origin", *rest, F.posexplode(F.slice(pieces, 1, F.size(pieces) - 1)).alias("pos", "raw"))
    chunks = not_blank(chunks).withColumn("lineno", (F.col("pos") + 1).cast("bigint"))
    return windows_json_events(whole_lines(files.filter(~is_xml)), host).unionByName(windows_xml_events(xml_chunks(chunks), host))
