"""Field access on the ``fields`` map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchspan.schema import ADDRESS_FIELDS, MISSING_TEXTS


def present(value: Column) -> Column:
    """The value, or NULL when it counts as missing."""
    return F.when(~value.isin(MISSING_TEXTS), value)


def lower_names(fields: Column) -> Column:
    """Field names in lower case, last one first."""
    return F.reverse(F.transform(F.map_keys(fields), F.lower))


def any_case(fields: Column, name: str, names: Column | None = None,
             values: Column | None = None) -> Column:
    """Value of ``name``: the exact key, else the last key equal to it ignoring case.

    ``names`` and ``values`` may be passed when ``lower_names(fields)`` and the reversed values
    are already at hand.
    """
    names = lower_names(fields) if names is None else names
    values = F.reverse(F.map_values(fields)) if values is None else values
    spelled = F.get(values, F.array_position(names, name.lower()).cast("int") - 1)
    return F.coalesce(F.try_element_at(fields, F.lit(name)), spelled)


def entity(fields: Column, host: Column) -> Column:
    """The acting address if the event has one, else the host that logged it."""
    return F.coalesce(*[present(any_case(fields, name)) for name in ADDRESS_FIELDS], host)
