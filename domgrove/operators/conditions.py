"""Conditions on elements, as boolean Columns over the node table.

Positions count all element siblings and are not renumbered by other conditions. A missing
attribute reads as the empty string. Join conditions with ``&``, ``|`` and ``~`` or with
`all_of`, `any_of` and `negate`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from domgrove.functions.attributes import attribute

_COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}


def _position(of: str) -> tuple[Column, Column]:
    if of == "sibling":
        return F.col("sib_pos"), F.col("sib_count")
    if of == "tag":
        return F.col("tag_pos"), F.col("tag_count")
    raise ValueError(f"positions are counted among 'sibling' or 'tag', not {of!r}")


def nth(n: int, of: str = "sibling") -> Column:
    """The n-th element, counted from 1 among all siblings or among those of its tag."""
    return _position(of)[0] == n


def last(of: str = "sibling") -> Column:
    position, count = _position(of)
    return position == count


def pos(op: str | None = None, n: int | None = None, of: str = "sibling") -> Column:
    """Position compared with a number; without a comparison it holds for every element."""
    if op is None:
        return F.lit(True)
    if op not in _COMPARE or n is None:
        raise ValueError(f"not a comparison of positions: {op!r} {n!r}")
    return _COMPARE[op](_position(of)[0], F.lit(n))


def has(name: str) -> Column:
    return F.map_contains_key("attr", name.lower())


def eq(name: str, value: str) -> Column:
    return attribute(name) == value


def ne(name: str, value: str) -> Column:
    """Also holds where the attribute is missing, unless the value is empty."""
    return attribute(name) != value


def contains(name: str, value: str) -> Column:
    return attribute(name).contains(value)


def starts_with(name: str, value: str) -> Column:
    return attribute(name).startswith(value)


def text_eq(value: str) -> Column:
    """Own text, blanks collapsed, is the value."""
    return F.col("own_text") == value


def text_contains(value: str) -> Column:
    return F.col("own_text").contains(value)


def has_text() -> Column:
    return F.col("own_text") != ""


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def negate(condition: Column) -> Column:
    return ~condition
