"""Sizes and durations written as text."""

from __future__ import annotations

from datetime import timedelta
from decimal import Decimal, InvalidOperation

#: Names of each unit of time.
TIMES = {
    "seconds": {"s", "sec", "secs", "second", "seconds"},
    "minutes": {"m", "min", "mins", "minute", "minutes"},
    "hours": {"h", "hr", "hrs", "hour", "hours"},
    "days": {"d", "day", "days"},
    "weeks": {"w", "week", "weeks"},
}
#: Names of each power of 1024 bytes.
SIZES = [{"", "b"}, {"k", "kb", "kib"}, {"m", "mb", "mib"}, {"g", "gb", "gib"}, {"t", "tb", "tib"}]


def quantity(text: str) -> tuple[Decimal, str]:
    """The number that a text begins with and what follows it, in lower case; no sign, no exponent."""
    given = str(text).strip().casefold()
    unit = given.lstrip("0123456789.")
    try:
        number = Decimal(given[: len(given) - len(unit)])
    except InvalidOperation:
        raise ValueError(f"no number at the start of {text!r}") from None
    return number, unit.strip()


def size(text: str) -> int:
    """Bytes of a size such as 500k or 1.5M, by powers of 1024; a leading sign is dropped."""
    number, unit = quantity(str(text).strip().lstrip("+-"))
    for power, names in enumerate(SIZES):
        if unit in names:
            return int(number * 1024**power)
    raise ValueError(f"unknown size unit: {text!r}")


def duration(text: str) -> float:
    """Seconds of a duration such as 2h, 30min or 1d; without a unit the number is seconds."""
    number, unit = quantity(text)
    for name, names in TIMES.items():
        if unit in names or (not unit and name == "seconds"):
            return timedelta(**{name: float(number)}).total_seconds()
    raise ValueError(f"unknown duration unit: {text!r}")
