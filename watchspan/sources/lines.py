"""Raw text as one row per line, with file name and line number."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchspan.session import stable_storage

# Columns every normaliser returns. ``ok`` is false for a line that was not understood.
PARSED = ["origin", "lineno", "raw", "ok", "ts", "source", "host", "fields"]


def parsed(lines: DataFrame, source: str, ts: Column, host: Column, fields: Column,
           ok: Column) -> DataFrame:
    """``fields`` is only built for lines that are ``ok`` and have a time. ``arrived`` is carried on if there."""
    timed = once(lines, ts=F.when(ok, ts))
    sound = F.col("ts").isNotNull()
    return timed.select("origin", "lineno", "raw", sound.alias("ok"), "ts", F.lit(source).alias("source"),
                        F.when(sound, host).alias("host"), F.when(sound, fields).alias("fields"),
                        *[c for c in lines.columns if c == "arrived"])


# White space in any script, as a character class body.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = rf"[^{SPACE}]"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often they are read.

    The optimizer copies the expression of a plain column into filters and into every other place
    that reads it, which for parsing is most of the cost. It does not copy through an explode.
    """
    made = F.explode(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    return df.withColumn("_made", made).withColumns(
        {name: F.col("_made")[name] for name in columns}).drop("_made")


def groups_of(text: Column, pattern: str, count: int) -> Column:
    """All groups of a pattern that covers the whole text, as an array; one element if no match.

    A line never holds a line feed, so it can separate the groups, and one pass of the pattern is
    enough for all of them.
    """
    return F.split(F.regexp_replace(text, pattern, "\n".join(f"${i + 1}" for i in range(count))), "\n", -1)


def with_offset(ts_text: Column, date_format: str) -> Column:
    """A time with a zone offset, written ``+hhmm`` or ``+hh:mm``; NULL if it is not one."""
    return F.coalesce(F.try_to_timestamp(ts_text, F.lit(f"{date_format} Z")),
                      F.try_to_timestamp(ts_text, F.lit(f"{date_format} XXX")))


_ISO_DAY = r"\A\d{4}-\d{2}-\d{2}"
_ISO_ZONE = r"(?:Z|[+-]\d{2}:?\d{2})"


def _extended(text: Column) -> Column:
    """The basic form, ``20310302T050607Z``, with its dashes and colons."""
    day = F.regexp_replace(text, r"\A(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    full = F.regexp_replace(day, rf"({_ISO_DAY}T\d{{2}})(\d{{2}})(\d{{2}})", "$1:$2:$3")
    return F.regexp_replace(full, rf"({_ISO_DAY}T\d{{2}})(\d{{2}})(?=Z|[+-]|\z)", "$1:$2")


def iso_time(text: Column, offset: str) -> Column:
    """An ISO-8601 time; ``offset`` applies if it names no zone. NULL if it is not one."""
    text = F.when(text.rlike(r"\A\d{8}(?:T|\z)"), _extended(text)).otherwise(text)
    complete = text.rlike(rf"{_ISO_DAY}[T ]\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?{_ISO_ZONE}\z")
    shortened = text.rlike(rf"{_ISO_DAY}(?:[T ]\d{{2}}:\d{{2}}(?::\d{{2}}(?:[.,]\d+)?)?)?{_ISO_ZONE}?\z")
    timed = F.regexp_replace(F.regexp_replace(text, rf"{_ISO_DAY}(?![T ])", "$0T00:00"),
                             rf"{_ISO_DAY}[T ]\d{{2}}:\d{{2}}(?!:)", "$0:00")
    zoned = F.concat(F.replace(timed, F.lit(","), F.lit(".")),
                     F.when(text.rlike(rf":\d{{2}}.*{_ISO_ZONE}\z"), "").otherwise(offset))
    return F.when(complete, text.try_cast("timestamp")).when(shortened, zoned.try_cast("timestamp"))


def whole_number(text: Column) -> Column:
    """Digits without leading zeros."""
    return F.regexp_replace(text, r"\A0+(?=\d)", "")


LINE_END = r"\r\n|\r|\n"


def not_blank(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("raw").rlike(r"\A\s*\z"))


def read_lines(spark: SparkSession, paths: str | Iterable[str], line_sep: str | None = None, closed: bool = False) -> DataFrame:
    """(origin, lineno, raw) of every line in the files, blank ones left out but counted.

    Files are read once, in splits by many tasks, and written with the split and the place in it. Line numbers come
    from that copy alone: where Spark cuts files depends on the cluster of the moment, so two scans need not agree.
    Bytes that are no UTF-8 become U+FFFD. With ``closed``, text at the end of a file that no ``line_sep`` follows is left
    out: there the bytes of all pieces and one separator for each are more than the file has (of a compressed file this is unknown, so it stays).
    """
    chosen = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    rows = stable_storage(reader.text(chosen).select(
        F.input_file_name().alias("origin"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"), F.make_valid_utf8("value").alias("raw"),
        *([F.octet_length("value").alias("bytes"), F.col("_metadata.file_size").alias("size")] if closed else [])))
    of_file = Window.partitionBy("origin")
    before = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    open_end = F.lit(False)
    if closed:
        compressed = F.lower("origin").rlike(r"\.(gz|bz2|zst|snappy|lz4|deflate)\z")
        pieces = F.sum("bytes").over(of_file) + F.sum("n").over(of_file) * len(line_sep.encode())
        open_end = (pieces > F.col("size")) & ~compressed & (F.col("block") == F.max("block").over(of_file))
    splits = (rows.groupBy("origin", "block")
              .agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n"),
                   *([F.sum("bytes").alias("bytes"), F.max("size").alias("size")] if closed else []))
              .withColumns({"earlier": F.coalesce(F.sum("n").over(before), F.lit(0)),
                            "open_id": F.when(open_end, F.col("first_id") + F.col("n") - 1)})
              .select("origin", "block", "first_id", "earlier", "open_id"))
    return (not_blank(rows).join(splits, ["origin", "block"])
            .filter(F.col("open_id").isNull() | (F.col("row_id") < F.col("open_id")))
            .select("origin", (F.col("earlier") + F.col("row_id") - F.col("first_id") + 1).alias("lineno"), "raw"))


def whole_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """The same rows from files that are one row each, (origin, text) and others; no copy is needed to number them."""
    rest = [c for c in files.columns if c not in ("origin", text)]
    lines = files.select("origin", *rest, F.posexplode(F.split(text, LINE_END, -1)).alias("pos", "raw"))
    return not_blank(lines).select("origin", (F.col("pos") + 1).cast("bigint").alias("lineno"), "raw", *rest)
