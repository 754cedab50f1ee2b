"""Values that an expression uses more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a column that stands in several places would be computed in each."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))
