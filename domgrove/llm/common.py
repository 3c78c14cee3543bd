"""What the operators of this subpackage share: reading documents, words, and tasks over Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from domgrove.sources.tables import ensure_checkpoint_dir

#: A-Z to a-z, and nothing else; on UTF-8 bytes.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Rows of an Arrow batch, unless the session says otherwise: texts can be long.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table `documents`."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small where the session has not set their size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and 9 to 13: what bytes.split() splits on."""
    return text.split()


def text_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the text as bytes; every other column is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("binary").alias("text"))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]],
              schema: str) -> DataFrame:
    """mapInArrow with a function that yields dicts of columns, cast to the schema."""
    small_batches(df.sparkSession)
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for columns in fn(batches):
            arrays = []
            for field in arrow:
                value = columns[field.name]
                if isinstance(value, pa.ChunkedArray):
                    value = value.combine_chunks()
                if not isinstance(value, pa.Array):
                    value = pa.array(value, type=field.type)
                arrays.append(value if value.type == field.type else value.cast(field.type))
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, kind)


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch as bytes, null as empty."""
    return [x or b"" for x in batch.column("text").to_pylist()]


def map_rows(docs: DataFrame, start: Callable[[], Callable[[list], dict]], schema: str) -> DataFrame:
    """One row for each document: doc_id and the columns that start()(texts) returns."""
    def run(batches):
        each = start()
        for batch in batches:
            if batch.num_rows:
                yield {"doc_id": batch.column("doc_id")} | each(texts_of(batch))

    return arrow_map(text_rows(docs), run, f"doc_id long, {schema}")


def map_whole_rows(docs: DataFrame, start: Callable[[], Callable[[list], dict]], schema: str
                   ) -> DataFrame:
    """All columns of docs in one struct `doc`, beside the columns that start()(texts) returns.

    Nothing is joined back, so rows stay where they are whatever their keys; columns of docs that
    are named like a result cannot clash with it.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        each = start()
        for batch in batches:
            if batch.num_rows:
                doc = batch.column("doc")
                texts = doc.field(at).cast(pa.binary()).to_pylist()
                yield {"doc": doc} | each([x or b"" for x in texts])

    return arrow_map(whole, run, f"doc {whole.schema[0].dataType.simpleString()}, {schema}")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir, for tables."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


class Cached(dict):
    """A dict that computes what it lacks; emptied when it has grown beyond `limit` entries."""

    def __init__(self, fn: Callable, limit: int = 1_000_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix of each element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chained(ids: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every n consecutive elements; one element of the result for each start."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    m = len(ids) - n + 1
    out = np.full(m, (seed * 0x9E3779B97F4A7C15 + 1) % 2**64, np.uint64)
    for i in range(n):
        out ^= ids[i:i + m]
        out *= np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)
