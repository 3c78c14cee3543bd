"""Tables in and out: node tables, results, and cuts in a long lineage."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def save_pages(pages: DataFrame, name: str, path: str, buckets: int) -> None:
    """Keep pages bucketed by page_id: shredding them then needs no exchange at all."""
    (pages.repartition(buckets, "page_id").write.mode("overwrite").format("parquet")
     .option("path", path).bucketBy(buckets, "page_id").saveAsTable(name))


def save_blocks(tags: DataFrame, name: str, path: str, buckets: int) -> None:
    """Keep the first half of a shred, bucketed by page_id, so that the second one reads it in place."""
    (tags.write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, "page_id").saveAsTable(name))


def save_nodes(nodes: DataFrame, name: str, path: str, buckets: int) -> None:
    """Keep a node table, bucketed by page_id, so that rules read it without an exchange."""
    (nodes.write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, "page_id").sortBy("page_id", "node_id").saveAsTable(name))


def load_nodes(spark: SparkSession, name: str) -> DataFrame:
    """A saved node table; rules over it use its buckets and read only the columns they need."""
    return spark.table(name)


def write_results(results: DataFrame, path: str, mode: str = "errorifexists",
                  rows_per_file: int = 5_000_000) -> None:
    """Write results, one folder per rule, in files of at most `rows_per_file` rows.

    Results are computed once and kept nowhere. They are rebalanced by rule: when their sizes are
    known, Spark (adaptive plans) puts rare rules together in one task and deals a frequent one out
    to as many as its bytes ask for, so neither makes a file in every task. Without adaptive plans a
    rule is written by one task.
    """
    (results.hint("rebalance", "rule").write.mode(mode).option("maxRecordsPerFile", rows_per_file)
     .partitionBy("rule").parquet(path))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="domgrove-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write out what was computed so far, so that plans of several rounds stay small."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames that `cut_lineage` made and that nothing will read again.

    The driver is asked to collect its garbage, too: executors keep the shuffle files of what has
    been written until it does, which by itself happens every half an hour.
    """
    for frame in frames:
        written = frame._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if written.isDefined():
            remove_folder(frame.sparkSession, written.get())
    gc.collect()
    frames[0].sparkSession._jvm.System.gc()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
