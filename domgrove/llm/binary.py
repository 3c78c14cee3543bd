"""Token ids in training order: fixed-stride shards after a keyed permutation.

Documents are cut into sequences of `length` tokens (the first of a document may be shorter and is
filled up with end_id). Documents are numbered densely, by counting the rows of each task; piece p
of document d has the number d * M + p, where M is more pieces than any text can have. A keyed
Feistel network over the least even number of bits that hold all D * M numbers, applied again
while its result is none of them (cycle-walking), permutes the numbers without a table.

The order of the permuted numbers is the training order: range partitions, known beforehand because
permuted numbers are spread evenly, sort what they get and write one shard each, record after
record. A sequence's slot is its place in that order, dense from 0; its record stands at
(slot - first slot of its shard) * stride. So texts are tokenised once, and a reader goes on from
any slot. Shards appear under their names when they are whole: a task that is run again replaces
its shard by the same bytes.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domgrove.llm.common import arrow_map, mix, shared_folder, text_rows, texts_of
from domgrove.llm.tokens import encoder, forget

ROUNDS = 6


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of sequence numbers below n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key % 2**64))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        x = left << np.uint64(half) | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def files_at(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder given as Spark names it."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder else (pyarrow.fs.LocalFileSystem(), folder)


def write_shards(docs: DataFrame, folder: str | None = None, length: int = 256, key: int = 20240607,
                 shard_bytes: int = 16 << 20, end_id: int = 2,
                 ranks_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Writes shards and manifest.json; returns doc_id, piece, start, n_tokens, ids_crc32, slot,
    shard and offset (bytes) of every sequence.

    Ids are little-endian unsigned 16-bit integers. shard_bytes is the text behind a shard, on
    average. The folder must be one that all executors share; by default it is a new one below
    spark.checkpoint.dir. Null and empty texts are end_id alone. Repeated rows have their own slots.
    Other columns of docs are not looked at; an empty table gives no shards and an empty result.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    rows = text_rows(docs)
    sizes = (rows.groupBy(F.spark_partition_id().alias("task"))
             .agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("bytes"))
             .collect())  # a row for each task
    expected = {r["task"]: r["n"] for r in sizes}
    begins, n_docs = {}, 0
    for task in sorted(expected):
        begins[task], n_docs = n_docs, n_docs + expected[task]
    most = (max((r["longest"] or 0 for r in sizes), default=0) + 1) // length + 1
    domain = max(1, n_docs * most)
    n_shards = max(1, -(-sum(r["bytes"] or 0 for r in sizes) // shard_bytes))
    width = -(-domain // n_shards)
    end = np.array([end_id], "<u4").tobytes()
    stride = 2 * length

    def place(batches):
        task = TaskContext.get().partitionId()
        code = encoder(ranks_file)
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        at = begins.get(task, 0)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "n_tokens", "ids_crc32", "number", "record")}
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), code.encode_all(texts_of(batch))):
                ids += end
                n = len(ids) // 4
                short = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                cuts = [0, *range(n % length or length, n + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for name, value in (("doc_id", doc_id), ("piece", k), ("start", a), ("n_tokens", b - a),
                                        ("ids_crc32", zlib.crc32(ids[4 * a:4 * b])), ("number", at * most + k),
                                        ("record", pack(short[2 * a:2 * b]))):
                        out[name].append(value)
                at += 1
            order = permute(np.array(out.pop("number"), np.uint64), domain, key)
            yield out | {"order": order, "shard": order // width}
        if at - begins.get(task, 0) != expected.get(task, 0):
            raise RuntimeError("the documents changed after they were counted")

    names = ["doc_id", "piece", "start", "n_tokens", "ids_crc32", "shard"]
    placed = arrow_map(rows, place, "doc_id long, piece int, start long, n_tokens long, ids_crc32 long, "
                       "order long, shard int, record binary")
    ranged = placed.repartitionById(n_shards, "shard").sortWithinPartitions("order")

    def write(batches):
        forget()  # a worker that has tokenised before needs its memory no more
        fs, root = files_at(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        filler = np.full(length, end_id, "<u2").tobytes()
        stream, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                name = f"{root}/shard-{batch.column('shard')[0].as_py():08d}.bin"
                part = f"{root}/.{uuid.uuid4().hex}.part"
                stream = fs.open_output_stream(part)
            stream.write(b"".join([(unpack(r) + filler)[:stride] for r in batch.column("record").to_pylist()]))
            yield {c: batch.column(c) for c in names} | {"nth": n + np.arange(batch.num_rows)}
            n += batch.num_rows
        if stream is not None:
            stream.close()
            fs.move(part, name)

    fs, root = files_at(folder)
    fs.create_dir(root, recursive=True)
    written = arrow_map(ranged, write, "doc_id long, piece int, start long, n_tokens long, ids_crc32 long, "
                        "shard int, nth long")
    written.write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    full = index.groupBy("shard").agg(F.count("*").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    firsts = full.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"length": length, "stride": stride, "dtype": "<u2", "key": key, "end_id": end_id,
                              "shards": [[r["shard"], r["n"]] for r in full.orderBy("shard").collect()]}).encode())
    return index.join(firsts.drop("n"), "shard").select(
        "doc_id", "piece", "start", "n_tokens", "ids_crc32", (F.col("first") + F.col("nth")).alias("slot"),
        "shard", (F.col("nth") * stride).alias("offset"))


def read_slots(folder: str, start: int, n: int) -> np.ndarray:
    """Records start..start+n-1 of a written folder, one row each: what a training loop reads next."""
    fs, root = files_at(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as file:
        kept = json.loads(file.read())
    ends = np.cumsum([m for _, m in kept["shards"]]).tolist()
    stop = min(start + n, ends[-1] if ends else 0)
    rows = []
    while start < stop:
        k = bisect_right(ends, start)
        shard, size = kept["shards"][k]
        at = start - (ends[k] - size)
        m = min(stop - start, size - at)
        with fs.open_input_file(f"{root}/shard-{shard:08d}.bin") as file:
            rows.append(np.frombuffer(file.read_at(m * kept["stride"], at * kept["stride"]), kept["dtype"]))
        start += m
    return np.concatenate(rows or [np.zeros(0, "<u2")]).reshape(-1, kept["length"])
