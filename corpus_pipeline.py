"""From documents to packed training sequences: five operators one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domgrove.llm import decontaminate, near, packing, substring, toxicity
from domgrove.llm.common import documents, shared_folder, table
from domgrove.sources.tables import remove_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic; the model is fitted on labelled rows of docs."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of near duplicates."""
    return near.drop_near_duplicates(docs, once=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 20-word passages that stood earlier; n_chars follows the text."""
    kept = substring.cut_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_leaking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaking),
    ("packing", pack),
]

#: A trained model and a search decide; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; the result stays in its folder."""
    docs, folder = documents(spark, sf_dir), None
    for _, stage in STAGES:
        out = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(out)
        if folder:
            remove_folder(spark, folder)
        docs, folder = spark.read.parquet(out), out
    return docs
