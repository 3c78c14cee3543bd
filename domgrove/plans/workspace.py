"""Node tables shared by the queries of one session."""

from __future__ import annotations

from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from domgrove.operators.shred import blocks, elements, partitions_for, shred
from domgrove.session import configure
from domgrove.sources.pages import read_pages
from domgrove.sources.tables import load_nodes, remove_folder, save_blocks, save_nodes, save_pages

# By application and folder: the node table, the pages beside it, and names of saved tables.
_tables: dict[tuple[str, str], tuple[DataFrame, DataFrame, list[str]]] = {}


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    return read_pages(configure(spark), f"{folder}/pages.parquet")[0]


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that the cluster names for files which all executors share."""
    return spark.conf.get("spark.checkpoint.dir", None)


def _made(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, list[str]]:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _tables:
        pages = pages_of(spark, folder)
        shared = shared_folder(spark)
        if shared:
            buckets = partitions_for(pages) or int(spark.conf.get("spark.sql.shuffle.partitions"))
            names = [f"{kind}_{uuid4().hex}" for kind in ("pages", "nodes")]
            half = f"blocks_{uuid4().hex}"
            save_pages(pages, names[0], f"{shared}/{names[0]}", buckets)
            pages = spark.table(names[0])
            # In two stages: a whole shred compiles 134 classes, and a session keeps 100 unless told
            # otherwise, so that every task would compile most of them again.
            save_blocks(blocks(pages), half, f"{shared}/{half}", buckets)
            save_nodes(elements(spark.table(half)), names[1], f"{shared}/{names[1]}", buckets)
            _drop(spark, half, f"{shared}/{half}")
            _tables[key] = load_nodes(spark, names[1]), pages, names
        else:
            _tables[key] = shred(pages).persist(StorageLevel.MEMORY_AND_DISK), pages, []
    return _tables[key]


def nodes_of(spark: SparkSession, folder: str) -> DataFrame:
    """The node table of a folder of pages, shredded once per session.

    On a cluster that names a shared folder it is a bucketed table there, which outlives any
    executor; elsewhere it is persisted, and lost parts are shredded again.
    """
    return _made(spark, folder)[0]


def pages_beside(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of a folder, bucketed like its node table: joins of the two move no html."""
    return _made(spark, folder)[1]


def release(spark: SparkSession) -> None:
    """Drop the node tables of this session and delete their files."""
    shared = shared_folder(spark)
    for key in [k for k in _tables if k[0] == spark.sparkContext.applicationId]:
        nodes, _, names = _tables.pop(key)
        nodes.unpersist()
        for name in names:
            _drop(spark, name, f"{shared}/{name}")


def _drop(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    remove_folder(spark, path)
