"""Places of rows in a sorted order, and running sums, without collecting a group in one task.

Rows are dealt by range of keys and order, so a group of any size is spread over several parts.
What a part holds of a group is a run; the sizes and sums of runs, one row for each part and group
in it, are added up in the order of the parts, and what lies before a run is added to its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domgrove.sources.tables import cut_lineage


def same(left: str, right: str, keys: list[str]) -> Column:
    """Rows of two aliased frames agree in all keys; null agrees with null."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def dealt(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows sorted by keys and order (nulls first) with `part` and `at`, a number that ascends in it.

    Rows that agree in everything are told apart by where they were read. The frame is written, for
    the caller to `forget`.
    """
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    return cut_lineage(
        tied.repartitionByRange(*keys, *order, "tie").sortWithinPartitions(*keys, *order, "tie").drop("tie")
        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))


def runs(placed: DataFrame, keys: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """part, keys, first (`at` of the first row), n (rows of the group), and what lies before the run:
    size_before and for each x of sums x_before."""
    made = placed.groupBy("part", *keys).agg(
        F.count("*").alias("size"), F.min("at").alias("first"), *[F.sum(c).alias(c) for c in sums])
    group, earlier = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return made.select(
        "part", *keys, "first", F.sum("size").over(group).alias("n"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("size", *sums)])


def beside(placed: DataFrame, made: DataFrame, keys: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """The placed rows with what their runs have, and x_before as the sum of all rows before."""
    here = W.partitionBy("part", *keys).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    local = placed.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"{c}_here") for c in sums])
    joined = local.alias("l").join(made.alias("r"), same("l", "r", ["part", *keys]))
    own = {*keys, "part", *[f"{c}_before" for c in sums]}
    return joined.select(*[f"l.{c}" for c in placed.columns], *[f"r.{c}" for c in made.columns if c not in own],
                         *[(F.col(f"{c}_here") + F.col(f"{c}_before")).alias(f"{c}_before") for c in sums])


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with `rank` (from 0) and `n` (how many) among those of equal keys; and the frame that
    they are read from, for the caller to `forget`."""
    placed = dealt(rows, keys, order)
    rank = (F.col("at") - F.col("first") + F.col("size_before")).alias("rank")
    return beside(placed, runs(placed, keys), keys).select(*rows.columns, rank, "n"), placed
