"""Run the batch job on pages as they arrive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from domgrove.operators.shred import shred
from domgrove.plans.rules import Rule, run_rules
from domgrove.sources.pages import sift, split_by_ids, split_pages
from domgrove.sources.tables import remove_folder, write_results

PAGE_SCHEMA = "page_id long, url string, html string"


def run_stream(spark: SparkSession, source: str, target: str, state: str,
               rules: Mapping[str, Rule], format: str = "parquet",
               max_files: int | None = None, once: bool = False, repeated: str = "reject",
               remember: int | None = None) -> StreamingQuery:
    """Watch a folder of page tables and write results and rejects of each batch.

    Trees never depend on another page. What is kept between batches are the ids of pages that were
    worked on, a folder of them for each batch. A page whose id an earlier batch had is rejected, or
    with repeated="replace" worked on: then its earlier results do not count, see `stream_results`.
    With `remember`, ids are forgotten after so many batches. Pages that share an id within a batch
    are rejected either way. A batch looks at batches before it only, writes its own folders by
    number and replaces them, so a replay changes nothing.
    """
    if repeated not in ("reject", "replace"):
        raise ValueError(f"repeated ids are for reject or replace, not {repeated!r}")
    reader = spark.readStream.schema(PAGE_SCHEMA).format(format)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def work(batch: DataFrame, number: int) -> None:
        pages, rejects = split_pages(batch)
        known = _earlier_ids(batch.sparkSession, target, pages, number, remember)
        if known is not None and repeated == "reject":
            pages, again = split_by_ids(pages, known)
            rejects = rejects.unionByName(again.select(
                "page_id", "url", F.lit("page id of an earlier batch").alias("reason")))
        nodes = shred(pages).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            write_results(run_rules(pages, rules, nodes), f"{target}/results/batch={number}", "overwrite")
            rejects.write.mode("overwrite").parquet(f"{target}/rejects/batch={number}")
            # The roots stand for the pages.
            worked = nodes.filter("parent_id IS NULL").select("page_id")
            worked.write.mode("overwrite").parquet(f"{target}/ids/batch={number}")
            if repeated == "replace":
                ids = known if known is not None else worked.filter("false")
                ids.write.mode("overwrite").parquet(f"{target}/replaced/batch={number}")
        finally:
            nodes.unpersist()
        if remember is not None and number - remember >= 0:
            remove_folder(batch.sparkSession, f"{target}/ids/batch={number - remember}")

    writer = reader.load(source).writeStream.foreachBatch(work).option("checkpointLocation", state)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def _batches(spark: SparkSession, folder: str) -> DataFrame | None:
    """page_id and batch of what batches have written; None if none has."""
    try:
        return spark.read.schema("page_id long, batch int").parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _earlier_ids(spark: SparkSession, target: str, pages: DataFrame, number: int, remember: int | None
                 ) -> DataFrame | None:
    """Ids of `pages` that earlier batches have worked on; None if there are none.

    The ids of the batch are few beside those kept: these are sifted by them where they lie.
    """
    kept = _batches(spark, f"{target}/ids") if number else None
    if kept is None:
        return None
    first = 0 if remember is None else max(0, number - remember)
    own = pages.select("page_id")
    earlier = sift(kept.filter(F.col("batch").between(first, number - 1)).select("page_id"), "page_id", own)
    found = own.join(earlier.filter("is_suspect").select("page_id"), "page_id", "left_semi").distinct()
    return None if found.isEmpty() else found


def stream_results(spark: SparkSession, target: str) -> DataFrame:
    """page_id, rule, idx, value, batch of all batches; of a page that came again only the last ones."""
    results = spark.read.parquet(f"{target}/results").select("page_id", "rule", "idx", "value", "batch")
    replaced = _batches(spark, f"{target}/replaced")
    if replaced is None:
        return results
    last = replaced.groupBy("page_id").agg(F.max("batch").alias("last"))
    old, now = results.alias("r"), last.alias("l")
    return old.join(now, (F.col("r.page_id") == F.col("l.page_id")) & (F.col("r.batch") < F.col("l.last")), "left_anti")
