"""Text search in an outline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def search(outlined: DataFrame, query: str) -> DataFrame:
    """Rows that hold the query, in any case, and all rows around them.

    is_hit marks the rows found, is_open those with a hit below, is_first the first hit of a
    page. A row has a hit below when the next hit after it comes before its end.
    """
    needle = query.lower()
    if not needle:
        raise ValueError("nothing to search for")
    is_hit = (F.contains(F.lower("display"), F.lit(needle))
              | F.contains(F.lower("own_text"), F.lit(needle)))
    hit_at = F.when(F.col("is_hit"), F.col("node_id"))
    backwards = W.partitionBy("page_id").orderBy(F.desc("node_id"))
    next_hit = F.last(hit_at, ignorenulls=True).over(
        backwards.rowsBetween(W.unboundedPreceding, -1))
    return (
        outlined.withColumn("is_hit", is_hit)
        .withColumn("is_open", F.coalesce(next_hit < F.col("end_pos"), F.lit(False)))
        .filter("is_hit OR is_open")
        .withColumn("is_first", F.coalesce(
            F.col("node_id") == F.min(hit_at).over(W.partitionBy("page_id")), F.lit(False)))
    )
