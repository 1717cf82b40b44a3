"""Arrays and values in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, though it be named many times: as a lambda's variable, which no optimizer writes out."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
