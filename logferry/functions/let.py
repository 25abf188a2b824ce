"""Small combinators for building column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Referring to a Column twice duplicates its whole expression; a chain of such
    references grows exponentially. A lambda variable is evaluated once per row.
    """
    return F.transform(F.array(value), body).getItem(0)


def first_of(*options: tuple[Column, Column]) -> Column:
    """``CASE WHEN c1 THEN v1 WHEN c2 THEN v2 … END`` from (condition, value) pairs."""
    return reduce(lambda acc, cv: acc.when(*cv), options[1:], F.when(*options[0]))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_in(value: Column, words: list[str]) -> Column:
    return value.isin(*words)


def words_pattern(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def empty_strings() -> Column:
    return F.array().cast("array<string>")
