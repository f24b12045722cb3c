"""Helpers of column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row: a lambda variable isn't inlined into inner loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df``'s (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        name = f"__{n}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def get_or(table: Column, key, default) -> Column:
    """The map's value of a key; the default where the key, its value or the map is missing."""
    value = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(table, key if isinstance(key, Column) else F.lit(key)), value)
