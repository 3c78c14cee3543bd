"""Attributes of a start tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from domgrove.functions.text import decode_references
from domgrove.functions.tokens import _INSIDE_TAG

START_TAG = r"^<[a-zA-Z][^\s/>]*+(" + _INSIDE_TAG + r")>"
_ATTRIBUTE = r"""[^\s/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|\S*+))?+"""
_NAME = r"^[^\s/=]++"
_VALUE = r"""(?s)^[^\s/=]++\s*+=\s*+(["']?)(.*)\1$"""


def start_tag(raw: Column) -> Column:
    """The start tag at the front of a token (an opaque token holds content after it)."""
    return F.regexp_extract(raw, START_TAG, 0)


def parse_attributes(tag_text: Column) -> Column:
    """array<struct<name,value>> in source order. Names are lowercased, values decoded, the
    first of several attributes with one name wins, one without a value has the empty string.
    """
    inside = F.regexp_extract(tag_text, START_TAG, 1)
    found = F.transform(
        F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(0)),
        lambda m: F.struct(
            F.lower(F.regexp_extract(m, _NAME, 0)).alias("name"),
            decode_references(F.regexp_extract(m, _VALUE, 2), in_attribute=True).alias("value"),
        ),
    )
    none = F.expr("array()").cast("array<struct<name:string,value:string>>")
    return F.when(inside.rlike(r"[^\s/]"), found).otherwise(none)


def first_of_each_name(attrs: Column) -> Column:
    """Drop later attributes of the same name; costs nothing more for tags without any."""
    names = F.transform(attrs, lambda a: a["name"])
    repeated = F.size(F.array_distinct(names)) < F.size(names)
    return F.when(
        repeated,
        F.filter(attrs, lambda a, i: F.array_position(names, a["name"]) == i + 1),
    ).otherwise(attrs)


def attribute_map(attrs: Column) -> Column:
    return F.map_from_entries(attrs)


def attribute(name: str, attr: Column | None = None) -> Column:
    """Value of an attribute; the empty string when it is missing."""
    column = F.col("attr") if attr is None else attr
    return F.coalesce(F.try_element_at(column, F.lit(name.lower())), F.lit(""))
