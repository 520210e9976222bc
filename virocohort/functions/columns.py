"""Small column helpers used by many operators."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def contains_any(text: Column, terms) -> Column:
    """True when the text holds at least one of the terms as a substring."""
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def joined(*parts: Column, sep: str = ";") -> Column:
    """Non-null parts in order, joined; empty when all are null."""
    return F.array_join(F.array_compact(F.array(*parts)), sep)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator)


def fraction(value: Column) -> Column:
    """Percentages written above 1 become fractions."""
    return F.when(value > 1, value / 100.0).otherwise(value)
