"""Arrays to rows without evaluating the array twice.

For ``explode(expr)`` Spark adds a filter ``size(expr) > 0`` and pushes it to
the scan, so a costly ``expr`` (tokenising, a fold, a Python function) runs
twice. The outer generators have no such filter; the one null row of an empty
array is dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inline_rows(df: DataFrame, keep: Sequence[str | Column], array: Column) -> DataFrame:
    """``keep`` and the fields of each struct of ``array``."""
    rows = df.select(*keep, F.explode_outer(array).alias("_item"))
    names = [c for c in rows.columns if c != "_item"]
    return rows.filter("_item IS NOT NULL").select(*names, "_item.*")


def explode_rows(df: DataFrame, keep: Sequence[str | Column], array: Column, pos: str, value: str) -> DataFrame:
    """``keep``, the 0-based position and the value of each element of ``array``."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Inside a lambda Spark evaluates an outer expression again for every
    element; a clip's peak used to scale its samples would make the scaling
    quadratic. Bound as a lambda variable it is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
