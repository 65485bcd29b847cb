"""Web access logs in the combined format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchspan.sources.lines import TOKEN, groups_of, once, parsed, whole_number, with_offset

# What stands between quotes, with backslash escapes. Possessive and without alternation: the
# matcher neither steps back nor recurses, however long the text is.
QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
# Fixed format: address, ident, user, [time], "request", status, bytes, and maybe "referer" "agent".
LINE = (rf"(?s)\A({TOKEN}+) {TOKEN}+ ({TOKEN}+) \[([^\]]+)\] " + QUOTED + r" ([0-9]{3}) ([0-9]+|-)"
        r"(?: " + QUOTED + " " + QUOTED + r")?.*\z")
TIME = "d/MMM/yyyy:H:m:s"


def url_decoded(text: Column) -> Column:
    """Decoded once. A percent sign that starts no escape stays; bytes that are no UTF-8 become U+FFFD."""
    safe = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.rlike("[%+]"), F.url_decode(safe)).otherwise(text)


def request_parts(request: Column) -> tuple[Column, Column, Column]:
    """Method, address and version; a request without a space is all address."""
    words = F.split(request, " ", -1)
    split = F.size(words) >= 2
    return (F.when(split, F.get(words, F.lit(0))).otherwise(""),
            F.when(split, F.get(words, F.lit(1))).otherwise(request),
            F.when(split, F.coalesce(F.get(words, F.lit(2)), F.lit(""))).otherwise(""))


def address_parts(uri: Column) -> tuple[Column, Column]:
    """What is before and after the first question mark."""
    mark = F.instr(uri, "?")
    return (F.substring_index(uri, "?", 1),
            F.when(mark > 0, F.substring(uri, mark + 1, F.length(uri))).otherwise(""))


def access_events(lines: DataFrame, host: str = "web") -> DataFrame:
    """Normalise (origin, lineno, raw). The log does not name its host, so the caller does."""
    split = once(lines, part=groups_of(F.col("raw"), LINE, 8))
    part = [F.get("part", F.lit(i)) for i in range(8)]
    address, user, time, request, status, size, referer, agent = part
    method, uri, version = request_parts(request)
    requested = split.withColumns({"method": method, "uri": uri, "version": version})
    stem, query = address_parts(F.col("uri"))
    values = {
        "c-ip": address,
        "cs-username": F.when(user == "-", "").otherwise(user),
        "cs-method": F.col("method"),
        "cs-uri": F.col("uri"),
        "cs-uri-stem": url_decoded(stem),
        "cs-uri-query": url_decoded(query),
        "cs-version": F.col("version"),
        "sc-status": whole_number(status),
        "sc-bytes": F.when(size == "-", "0").otherwise(whole_number(size)),
        "cs-referer": referer,
        "cs-user-agent": agent,
    }
    fields = F.create_map(*[c for name, value in values.items() for c in (F.lit(name), value)])
    return parsed(requested, "nginx", with_offset(time, TIME), F.lit(host), fields, F.size("part") == 8)
