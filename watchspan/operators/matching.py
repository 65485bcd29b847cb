"""All plain rules over the event table, in one pass per source."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchspan.functions.fields import any_case, entity, lower_names
from watchspan.functions.predicates import RuleError, TextColumns
from watchspan.rules import Rule, check_patterns


def needed_fields(rules: list[Rule]) -> list[str]:
    """Fields that correlations read from a match."""
    correlations = [r.correlation for r in rules if r.correlation]
    names = {name for c in correlations for name in [*c.group_by, c.field] if name}
    names |= {field for c in correlations for m in c.aliases.values() for field in m.values()}
    return sorted(names)


def _match_source(events: DataFrame, rules: list[Rule], keep: list[str], own: Mapping[str, Column]) -> DataFrame:
    names = sorted(set().union(*[r.field_names for r in rules]))
    number = {name: i for i, name in enumerate(names)}
    # Each field is looked up and put in lower case once per event, however many rules test it.
    fields = F.col("fields")
    listed = events.select("event_id", "ts_us", "host", "fields", "raw",
                           lower_names(fields).alias("names"),
                           F.reverse(F.map_values(fields)).alias("values"),
                           *[test.alias(f"own_{i}") for i, test in enumerate(own.values())])
    looked_up = listed.select(
        "event_id", "ts_us", "host", "fields", "raw", *[f"own_{i}" for i in range(len(own))],
        *[any_case(fields, name, F.col("names"), F.col("values")).alias(f"text_{i}")
          for name, i in number.items()])
    prepared = looked_up.withColumns({
        "raw_lower": F.lower("raw"), **{f"lower_{i}": F.lower(f"text_{i}") for i in number.values()}})

    def lookup(name: str | None) -> TextColumns:
        if name is None:
            return TextColumns(F.col("raw"), F.col("raw_lower"))
        return TextColumns(F.col(f"text_{number[name]}"), F.col(f"lower_{number[name]}"))

    hits = F.array_compact(F.array(*[F.when(r.column(lookup), F.lit(r.name)) for r in rules],
                                   *[F.when(F.col(f"own_{i}"), F.lit(name)) for i, name in enumerate(own)]))
    kept = F.map_filter("fields", lambda name, _: name.isin(keep)) if keep else F.create_map().cast(
        "map<string,string>")
    return (prepared.select("event_id", "ts_us", "host", "fields", F.explode(hits).alias("rule"))
            .select("rule", "ts_us", F.col("event_id").alias("match_id"),
                    entity(F.col("fields"), F.col("host")).alias("entity"), kept.alias("fields")))


def match_events(events: DataFrame, rules: list[Rule],
                 predicates: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """One row per event and plain rule it fulfils.

    ``predicates`` are rules given as code: name -> (source, a boolean column of the event table). They are
    tested in the same pass and can be referenced by correlations like rules from files.
    """
    plain = [r for r in rules if not r.correlation]
    own = dict(predicates or {})
    twice = sorted(set(own) & {r.name for r in rules})
    if twice:
        raise RuleError(f"predicates named like rules: {', '.join(twice)}")
    check_patterns(events.sparkSession, plain)
    keep = needed_fields(rules)
    parts = [_match_source(events.filter(F.col("source") == source),
                           [r for r in plain if r.source == source], keep,
                           {name: test for name, (at, test) in own.items() if at == source})
             for source in sorted({r.source for r in plain} | {at for at, _ in own.values()})]
    if not parts:
        return events.sparkSession.createDataFrame([], "rule string, ts_us bigint, match_id string, "
                                                       "entity string, fields map<string,string>")
    return reduce(DataFrame.unionByName, parts)
