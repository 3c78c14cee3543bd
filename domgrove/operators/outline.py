"""Outline of a page: one row per element in document order, with a line to show for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domgrove.functions import vocabulary as V
from domgrove.functions.attributes import attribute

# Fixed values.
KEY_ATTRIBUTES = ["href", "src", "title", "alt", "data-src", "data-original"]
MAX_KEYS = 2
LONGEST_VALUE, CUT_VALUE = 28, 25
SHOWN_TEXT = 24


def class_text() -> Column:
    return F.trim(attribute("class"))


def display_text() -> Column:
    """``<tag#id.class attr="value" «text»>``."""
    def shown(name: str) -> Column:
        value = attribute(name)
        cut = F.when(F.length(value) <= LONGEST_VALUE, value).otherwise(
            F.concat(F.substring(value, 1, CUT_VALUE), F.lit("...")))
        return F.when(F.map_contains_key("attr", name),
                      F.concat(F.lit(f' {name}="'), cut, F.lit('"')))

    keys = F.slice(F.array_compact(F.array(*[shown(n) for n in KEY_ATTRIBUTES])), 1, MAX_KEYS)
    text = F.substring("own_text", 1, SHOWN_TEXT)
    return F.concat(
        F.lit("<"), F.col("tag"),
        F.when(F.map_contains_key("attr", "id"), F.concat(F.lit("#"), attribute("id"))).otherwise(""),
        F.when(class_text() != "", F.concat(F.lit("."), class_text())).otherwise(""),
        F.array_join(keys, ""),
        F.when(text != "", F.concat(F.lit(" «"), text, F.lit("»"))).otherwise(""),
        F.lit(">"),
    )


def outline(nodes: DataFrame) -> DataFrame:
    """Elements below the root, without scripts and styles.

    item counts from 0 in document order; depth is 0 for the children of the root.
    """
    order = W.partitionBy("page_id").orderBy("node_id")
    return (
        nodes.filter((F.col("depth") >= 1) & ~V.is_one_of(V.SCRIPT_LIKE))
        .select(
            "page_id", "node_id", "end_pos", "parent_id",
            (F.row_number().over(order) - 1).alias("item"),
            (F.col("depth") - 1).alias("depth"), "tag",
            display_text().alias("display"), "own_text",
            # In document order the first child follows its parent at once.
            F.coalesce(F.lead("parent_id").over(order) == F.col("node_id"), F.lit(False))
            .alias("has_children"),
        )
    )
