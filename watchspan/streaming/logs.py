"""Events from log files as they arrive.

A file of the stream is one row, so its lines are numbered where it is read and get the ids they have in a batch, with no
copy in between; a file must therefore fit into one string, as rotated logs do. The source reads a name once; it forgets names of
files that are older than the newest one by ``max_file_age``, and then reads a file that has changed again. Events that came
before are kept out: their ids are remembered until files arrive that are newer by ``remember``, which should be longer. So a file that is read again, grown
or not, adds only what is new. Event time plays no part in that: an old log may arrive late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.session import use_utc
from watchspan.sources.access import access_events
from watchspan.sources.ingest import with_event_id
from watchspan.sources.lines import whole_lines
from watchspan.sources.sshd import sshd_events
from watchspan.sources.windows import whole_windows

FORMATS = {
    "nginx": lambda files, host="", **_: access_events(whole_lines(files), host),
    "ssh": lambda files, host="", year=None, offset="+00:00", now=None, **_: sshd_events(whole_lines(files), host, year, offset, now),
    "windows": lambda files, host="", **_: whole_windows(files, host),
}


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 100, max_file_age: str = "7d") -> DataFrame:
    """(origin, arrived, text) of every new file."""
    return (use_utc(spark).readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger)
            .option("maxFileAge", max_file_age).load(path)
            .select(F.input_file_name().alias("origin"), F.col("_metadata.file_modification_time").alias("arrived"),
                    F.make_valid_utf8("value").alias("text")))


def log_stream(spark: SparkSession, kind: str, path: str, files_per_trigger: int = 100, max_file_age: str = "7d",
               remember: str = "14 days", **options) -> DataFrame:
    """Events of one kind of log, with the ids that ``read_logs`` and ``with_event_id`` give, each once; ``arrived`` is added."""
    if kind not in FORMATS:
        raise ValueError(f"log type {kind!r} is not one of {sorted(FORMATS)}")
    events = with_event_id(FORMATS[kind](file_stream(spark, path, files_per_trigger, max_file_age), **options))
    return events.withWatermark("arrived", remember).dropDuplicatesWithinWatermark(["event_id"])
