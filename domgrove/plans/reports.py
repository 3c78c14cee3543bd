"""Reports over results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domgrove.functions import reports as R
from domgrove.functions.text import escape_html


def coverage(results: DataFrame) -> DataFrame:
    """Results per page and rule."""
    return results.groupBy("page_id", "rule").agg(F.count(F.lit(1)).alias("n_results"))


def not_found(pages: DataFrame, rules: Iterable[str], results: DataFrame) -> DataFrame:
    """Pages and rules that gave nothing. One row per page is joined; what is missing is exploded."""
    asked = F.array(*[F.lit(r) for r in rules])
    found = results.groupBy("page_id").agg(F.collect_set("rule").alias("found"))
    missing = F.array_except(asked, F.coalesce("found", F.array().cast("array<string>")))
    return (pages.select("page_id").join(found, "page_id", "left")
            .select("page_id", F.explode(missing).alias("rule")))


def enrich(results: DataFrame) -> DataFrame:
    """Add badges, estimated lines, a mark for long ones and for markup, and escaped text."""
    value = F.col("value")
    return results.withColumns({
        "badges": R.badges(value),
        "line_est": R.line_estimate(value),
        "is_long": R.is_long(value),
        "is_html": R.looks_like_html(value),
        "escaped": escape_html(value),
    })


def clipped(nodes: DataFrame) -> DataFrame:
    """Elements that the end tag of another one cut short, because the two crossed: page_id, node_id,
    tag, end_pos, clipped_by and clipped_by_tag, the element whose end tag it was."""
    # Every element stands at its own place, and once more beside the one that cut it short.
    places = F.array_compact(F.array(
        F.struct(F.col("node_id").alias("at"), F.lit(False).alias("is_cut")),
        F.when(F.col("clipped_by").isNotNull(), F.struct(F.col("clipped_by").alias("at"), F.lit(True).alias("is_cut")))))
    by = F.max(F.when(~F.col("is_cut"), F.col("tag"))).over(W.partitionBy("page_id", "at"))
    return (nodes.select("page_id", "node_id", "tag", "end_pos", "clipped_by", F.explode(places).alias("place"))
            .select("*", "place.*").withColumn("clipped_by_tag", by).filter("is_cut AND clipped_by_tag IS NOT NULL")
            .select("page_id", "node_id", "tag", "end_pos", "clipped_by", "clipped_by_tag"))


def nesting(nodes: DataFrame) -> DataFrame:
    """Per page: elements, depth, tokens, and elements that another one's end tag cut short."""
    return nodes.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_elements"),
        F.max("depth").alias("max_depth"),
        F.max("end_pos").alias("n_tokens"),
        F.count("clipped_by").alias("n_crossing"))
