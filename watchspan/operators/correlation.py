"""What a correlation rule asks for, and the match rows that take part in it."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.functions.fields import present
from watchspan.schema import MERGE_GAP_SECONDS, MICROS
from watchspan.session import local_table


@dataclasses.dataclass(frozen=True)
class Correlation:
    """``kind`` is event_count, value_count, temporal, temporal_ordered or merge.

    ``merge`` is the plain grouping of single-event hits per entity.
    """

    name: str
    kind: str
    rules: list[str]
    group_by: list[str] = dataclasses.field(default_factory=list)
    span_us: int = 0
    op: str = "gte"
    threshold: int = 1
    field: str | None = None
    aliases: dict[str, dict[str, str]] = dataclasses.field(default_factory=dict)
    generate: bool = False

    @property
    def distinct(self) -> bool:
        return self.kind in ("value_count", "temporal")

    @property
    def limit(self) -> tuple[str, int]:
        """The condition with ``gt`` folded into ``gte``."""
        if self.kind == "temporal":
            return "gte", len(set(self.rules))
        if self.op == "gt":
            return "gte", self.threshold + 1
        return self.op, self.threshold


def merge_of(rule: str) -> Correlation:
    return Correlation(rule, "merge", [rule], span_us=MERGE_GAP_SECONDS * MICROS)


def rule_list(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table with one row per rule reference."""
    return local_table(spark, rows, schema)


def members(matches: DataFrame, correlations: list[Correlation]) -> DataFrame:
    """Bag union of the referenced matches per correlation, with the group key each falls under.

    A rule listed twice counts twice. Aliases let every rule name its own field for a group key.
    Rows lacking any key value are left out; an empty group-by gives the one group ``[]``.
    """
    rows = [(rule, c.name, position, c.kind == "merge",
             [c.aliases.get(g, {}).get(rule, g) for g in c.group_by],
             c.field, c.kind == "temporal")
            for c in correlations for position, rule in enumerate(c.rules)]
    references = rule_list(
        matches.sparkSession, rows,
        "rule string, corr string, position int, by_entity boolean, key_fields array<string>, "
        "value_field string, value_is_rule boolean")
    fields = F.col("fields")
    named = F.transform("key_fields", lambda name: present(F.try_element_at(fields, name)))
    value = (F.when(F.col("value_is_rule"), F.col("rule"))
             .when(F.col("value_field").isNotNull(),
                   present(F.try_element_at(fields, F.col("value_field")))))
    return (matches.join(references, "rule")
            .select("corr", "position", "rule", "ts_us", "match_id",
                    F.when(F.col("by_entity"), F.array("entity")).otherwise(named).alias("grp"),
                    value.alias("value"))
            .filter(~F.exists("grp", lambda key: key.isNull())))


SEQUENCES = ("temporal", "temporal_ordered")


def without_idle_groups(rows: DataFrame, correlations: list[Correlation]) -> DataFrame:
    """Leave out groups that cannot fire: too few matches in all, or none of a rule they need.

    Most groups of real logs are like that, and this spares them the ordered steps. It costs one more
    pass over the matches with a map-side combine, so these should be stored.
    """
    needs = rule_list(
        rows.sparkSession,
        [(c.name, c.limit[1] if c.kind in ("event_count", "value_count") else 1,
          len(c.rules) if c.kind in SEQUENCES else 0) for c in correlations],
        "corr string, least bigint, positions int")
    sequences = [len(c.rules) for c in correlations if c.kind in SEQUENCES]
    seen = [F.max((F.col("position") == i).cast("int")).alias(f"seen_{i}") for i in range(max(sequences, default=0))]
    able = F.col("n") >= F.col("least")
    for i in range(len(seen)):
        able = able & ((F.col("positions") <= i) | (F.col(f"seen_{i}") == 1))
    groups = (rows.groupBy("corr", "grp").agg(F.count(F.lit(1)).alias("n"), *seen)
              .join(needs, "corr").filter(able).select("corr", "grp"))
    return rows.join(groups, ["corr", "grp"], "left_semi")
