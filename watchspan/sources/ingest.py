"""Raw logs into the event table."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.session import stable_storage, use_utc
from watchspan.sources.access import access_events
from watchspan.sources.lines import read_lines
from watchspan.sources.sshd import sshd_events
from watchspan.sources.windows import read_windows


def _read_access(spark, paths, host="", **_):
    return access_events(read_lines(spark, paths), host)


def _read_sshd(spark, paths, host="", year=None, offset="+00:00", now=None, **_):
    return sshd_events(read_lines(spark, paths), host, year, offset, now)


def _read_windows(spark, paths, host="", layout=None, **_):
    return read_windows(spark, paths, host, layout)


READERS = {"nginx": _read_access, "ssh": _read_sshd, "windows": _read_windows}


def read_logs(spark: SparkSession, kind: str, paths: str | Iterable[str], **options) -> DataFrame:
    """Parsed lines of one kind of log: ``ok`` tells events from lines that were not understood."""
    if kind not in READERS:
        raise ValueError(f"log type {kind!r} is not one of {sorted(READERS)}")
    return READERS[kind](use_utc(spark), paths, **options)


def with_event_id(parsed: DataFrame) -> DataFrame:
    """Understood lines as events. The id is the same whenever the same line is read again."""
    key = F.concat_ws("|", "source", "origin", F.col("lineno").cast("string"), "raw")
    return parsed.filter("ok").select(
        F.sha1(key).alias("event_id"), "ts", F.unix_micros("ts").alias("ts_us"), "source", "host",
        "fields", "raw", "origin", F.to_date("ts").alias("day"),
        *[c for c in parsed.columns if c == "arrived"])


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~F.col("ok")).select("origin", "lineno", "source", "raw")


def first_of_each(events: DataFrame) -> DataFrame:
    """Lines that reached the table on two ways are kept once. A read of distinct files has none."""
    return events.dropDuplicates(["event_id"])


def unstored(parsed: DataFrame, stored: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Understood lines that are not in ``stored``.

    Only files that were read before can hold stored events. Events of all other files, which is
    all of them in the usual case, pass without being compared or moved. ``files`` lists the files that were read, with
    their days; without it the stored events are asked.
    """
    events = with_event_id(parsed)
    files = days_of_files(stored) if files is None else files
    again = stable_storage(files.join(parsed.select("origin").distinct(), "origin", "left_semi"))
    first, last = again.agg(F.min("first_day"), F.max("last_day")).first()
    if first is None:
        return events
    ids = stored.filter(F.col("day").between(F.lit(first), F.lit(last))).join(again, "origin", "left_semi").select("event_id")
    return (events.join(again, "origin", "left_anti")
            .unionByName(events.join(again, "origin", "left_semi")
                         .join(ids, "event_id", "left_anti").select(*events.columns)))


def days_of_files(events: DataFrame) -> DataFrame:
    return events.groupBy("origin").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("events"))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
    except AnalysisException:
        return False
    return True


@dataclasses.dataclass(frozen=True)
class EventTable:
    """Parquet files by source and day, and a small table of the log files they came from.

    A file is listed before its events are written. If a run breaks off between the two, the next one finds the file listed,
    compares its events with the stored ones and adds what is missing.
    """

    path: str

    @property
    def _listing(self) -> str:
        return f"{self.path.rstrip('/')}/_files"

    def exists(self, spark: SparkSession) -> bool:
        return _exists(spark, self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def files(self, spark: SparkSession) -> DataFrame:
        """(origin, first_day, last_day, events) of each time a file was read. A table without a listing gets one."""
        if not _exists(spark, self._listing):
            days_of_files(self.read(spark)).write.mode("append").parquet(self._listing)
        return spark.read.parquet(self._listing)

    def new_events(self, parsed: DataFrame) -> DataFrame:
        spark = parsed.sparkSession
        if not self.exists(spark):
            return with_event_id(parsed)
        return unstored(parsed, self.read(spark), self.files(spark))

    def append(self, parsed: DataFrame, gather: bool = False) -> None:
        self.ingest(parsed, gather)

    def ingest(self, parsed: DataFrame, gather: bool = False) -> DataFrame:
        """Store new events, sorted by time inside each file, and report on every file.

        The batch is parsed once and kept for all that looks at it. A split of a log covers few days, so every task writes a
        few files of good size and nothing is moved. ``gather`` brings rows of a day together first; use it for many tiny inputs.
        """
        parsed = stable_storage(parsed)
        new = stable_storage(self.new_events(parsed))
        days_of_files(with_event_id(parsed)).write.mode("append").parquet(self._listing)
        (new.hint("rebalance", "source", "day") if gather else new).sortWithinPartitions(
            "source", "day", "ts_us").write.mode("append").partitionBy("source", "day").parquet(self.path)
        return ingest_report(parsed, new)


def ingest_report(parsed: DataFrame, new: DataFrame) -> DataFrame:
    """Per file: events that are new, events already there, lines not understood.

    ``wrong_type`` is true for a file in which nothing was understood.
    """
    counts = new.groupBy("origin").agg(F.count(F.lit(1)).alias("n_new"))
    seen = parsed.groupBy("origin").agg(F.count_if("ok").alias("understood"),
                                        F.count_if(~F.col("ok")).alias("not_understood"))
    stored = F.coalesce("n_new", F.lit(0))
    return seen.join(counts, "origin", "left").select(
        "origin", stored.alias("stored"), (F.col("understood") - stored).alias("duplicates"),
        "not_understood", ((F.col("understood") == 0) & (F.col("not_understood") > 0)).alias("wrong_type"))
