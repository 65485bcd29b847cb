"""Length of time windows."""

from __future__ import annotations

from watchspan.schema import MICROS

# Unit letters and what they stand for, in microseconds.
UNITS = {"s": MICROS, "m": 60 * MICROS, "h": 3600 * MICROS, "d": 86400 * MICROS}


def timespan_us(value: object) -> int:
    """Microseconds of a whole number with a unit letter, as ``90s``, or of a plain number of seconds."""
    if isinstance(value, int | float):
        return round(MICROS * value)
    number, unit = str(value).strip()[:-1].rstrip(), str(value).strip()[-1:]
    if unit not in UNITS or not (number.isascii() and number.isdecimal()):
        raise ValueError(f"{value!r} is no timespan: give a whole number and one of {', '.join(UNITS)}")
    return UNITS[unit] * int(number)
