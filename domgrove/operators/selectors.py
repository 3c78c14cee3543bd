"""Generated selectors: a path that leads to an element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domgrove.functions.attributes import attribute
from domgrove.operators.outline import class_text
from domgrove.operators.shred import CHUNK

# Fixed value: own text must be longer than this to identify an element.
SHORT_TEXT = 3


def selector_step() -> Column:
    """Tag and conditions: id, class; else own text; else a data attribute; and the index."""
    quoted = lambda name, value: F.concat(F.lit(f"@{name}='"), value, F.lit("'"))
    has_id, has_class = F.map_contains_key("attr", "id"), class_text() != ""
    by_text = ~has_id & ~has_class & (F.length("own_text") > SHORT_TEXT)
    data = F.filter("attrs", lambda a: a["name"].startswith("data-") & (F.trim(a["value"]) != ""))
    first_data = F.try_element_at(data, F.lit(1))
    conditions = F.array_compact(F.array(
        F.when(has_id, quoted("id", attribute("id"))),
        F.when(has_class, quoted("class", class_text())),
        F.when(by_text, F.concat(F.lit("text()='"), F.replace(F.col("own_text"), F.lit("'"), F.lit("")),
                                 F.lit("'"))),
        F.when(~has_id & ~has_class & ~by_text & first_data.isNotNull(),
               F.concat(F.lit("@"), first_data["name"], F.lit("='"), first_data["value"],
                        F.lit("'"))),
        F.when(F.col("tag_count") > 1, F.col("tag_pos").cast("string")),
    ))
    return F.when(F.size(conditions) == 0, F.col("tag")).otherwise(
        F.concat(F.col("tag"), F.lit("["), F.array_join(conditions, " and "), F.lit("]")))


def _paths(rows: Column) -> Column:
    """The path of each element of a page, in document order; rows have depth, is_top and step.

    A fold carries the paths of the elements around the current one, by depth. The paths of a chunk
    of elements are carried, too, and put behind those of the chunks before.
    """
    strings = F.array().cast("array<string>")

    def place(state: Column, row: Column) -> Column:
        above = F.coalesce(F.get(state["open"], row["depth"] - 1), F.lit(""))
        path = F.when(row["is_top"], "").when(above == "", row["step"]).otherwise(F.concat_ws("/", above, row["step"]))
        return F.struct(F.array_append(F.slice(state["open"], F.lit(1), row["depth"]), path).alias("open"),
                        F.array_append(state["out"], path).alias("out"))

    def fold(state: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, F.struct(state["open"].alias("open"), strings.alias("out")), place, lambda now: F.struct(
            now["open"].alias("open"), F.concat(state["out"], now["out"]).alias("out")))

    starts = F.sequence(F.lit(1), F.size(rows), F.lit(CHUNK))
    return F.aggregate(F.transform(starts, lambda at: F.slice(rows, at, F.lit(CHUNK))),
                       F.struct(strings.alias("open"), strings.alias("out")), fold, lambda state: state["out"])


def selectors(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, selector: the steps from below html and body down to the element.

    The elements of a page meet once, in document order, where their pages are if the node table is
    bucketed; the path of an element is that of the one around it and its own step.
    """
    row = F.struct("node_id", "depth", F.col("tag").isin("html", "body").alias("is_top"), selector_step().alias("step"))
    pages = nodes.groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    found = F.zip_with("rows", _paths(F.col("rows")), lambda row, path: F.struct(
        row["node_id"].alias("node_id"), F.concat(F.lit("//"), path).alias("selector")))
    # The outer form: for the inner one Spark would add a filter that folds once more.
    return pages.select("page_id", F.explode_outer(found).alias("found")).select("page_id", "found.*")
