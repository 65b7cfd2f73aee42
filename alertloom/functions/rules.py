"""Tables of rules compiled to Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def every_match(text: Column, rules: Mapping[str, str]) -> Column:
    """The labels of all rules whose pattern is found in the text, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in rules.items()]))


def first_match(cases: Iterable[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    out: Column | None = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return otherwise if out is None else out.otherwise(otherwise)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """A small table as a map literal; keys that it lacks give null."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def in_order(labels: Column, order: list[str]) -> Column:
    """Distinct labels in the given order."""
    return F.filter(F.array(*[F.lit(x) for x in order]), lambda x: F.array_contains(labels, x))


def flags(*each: Column) -> Column:
    """The flags that are set, in this order."""
    return F.array_compact(F.array(*each))
