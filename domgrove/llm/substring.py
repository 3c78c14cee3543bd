"""Substring dedup of word windows behind a count-min sketch.

Every window of `size` words holds an anchor: of its runs of `size // 2` words the one with the
least hash. Equal windows have equal anchors at equal places, so a window can only repeat if its
anchor does. Tasks count the anchors of their rows in partition sketches (counters that stop at
two), which are sent as non-zero cells, merged block by block, and reduced to one bit per cell:
counted twice or more. Estimates are never too low, so no repeat is lost.

A second pass over the texts takes the windows whose anchors are estimated repeated and groups
them exactly, by 128 bits of hash: the smallest (doc_id, start) of each is its first. In a third
pass a document's candidate windows other than the firsts it holds are removed. Groups are reduced
to one row in each task before they are moved, so no number of copies makes a large group.

The sketch has a fixed size, whatever the input: two rows of `cells`, half a bit of broadcast for
each counter (16 MB). With many more anchors than cells it lets more windows through, which costs
time and changes nothing in the result; `cells` can be raised.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domgrove.llm.common import arrow_map, mix, texts_of
from domgrove.llm.text import Block, covered, in_blocks, prefix, range_hash, sliding_min

CELLS = 1 << 26
BLOCK_CELLS = 1 << 20
ROWS = 2


def anchored(block: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the place of each one's anchor, hashes of all runs, and hashes of words."""
    words = block.hashes()
    run = size // 2
    starts = block.windows(size)
    n_runs = max(0, len(words) - run + 1)
    at = np.arange(n_runs)
    runs = range_hash(prefix(words, 1), at, at + run)
    anchors = sliding_min(runs, size - run + 1)[starts] if len(starts) else starts
    return starts, anchors, runs, words


def cells_of(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(hashes + np.uint64(row + 1)) & np.uint64(cells - 1)).astype(np.int64)


def anchors_seen(texts: list[bytes], size: int) -> np.ndarray:
    """Hashes of the anchors of all windows, each place once."""
    _, anchors, runs, _ = anchored(Block(texts), size)
    return runs[np.unique(anchors)]


def packed_cells(own: np.ndarray, twice: np.ndarray, n_cells: int) -> bytes:
    """Cells in ascending order and whether they counted twice: two bytes for each, behind the number
    of them in each run of 32,768 cells."""
    sizes = np.bincount(own >> 15, minlength=max(1, n_cells >> 15))
    return sizes.astype("<u4").tobytes() + ((own & 0x7FFF) * 2 + twice).astype("<u2").tobytes()


def unpacked_cells(used: bytes, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(1, n_cells >> 15)
    sizes, coded = np.frombuffer(used, "<u4", n), np.frombuffer(used, "<u2", offset=4 * n)
    return (coded >> 1) + np.repeat(np.arange(n) << 15, sizes), (coded & 1).astype(np.uint8)


def repeated_cells(docs: DataFrame, seen_in: Callable[[list[bytes]], np.ndarray], cells: int = CELLS,
                   n_rows: int = ROWS) -> list[np.ndarray]:
    """For each row of the sketch the bits of cells that the hashes seen in texts count twice or
    more, packed."""
    small = min(cells, BLOCK_CELLS)

    def count(batches):
        rows = [np.zeros(cells, np.uint8) for _ in range(n_rows)]
        for batch in batches:
            texts = texts_of(batch)
            for a, b in in_blocks(texts):
                seen = seen_in(texts[a:b])
                for row, counters in enumerate(rows):
                    own, n = np.unique(cells_of(seen, row, cells), return_counts=True)
                    counters[own] = np.minimum(counters[own] + np.minimum(n, 2), 2)
        for row, counters in enumerate(rows):
            for at in range(0, cells, small):
                part = counters[at:at + small]
                own = np.flatnonzero(part)
                if len(own):
                    yield {"block": [row * cells // small + at // small],
                           "used": [packed_cells(own, part[own] > 1, small)]}

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, used in zip(batch.column("block").to_pylist(), batch.column("used").to_pylist()):
                counters = held.setdefault(block, np.zeros(small, np.uint8))
                own, twice = unpacked_cells(used, small)
                counters[own] = np.minimum(counters[own] + 1 + twice, 2)
        for block, counters in held.items():
            yield {"block": [block], "used": [np.packbits(counters > 1).tobytes()]}

    schema = "block int, used binary"
    parts = arrow_map(docs.select(F.col("text").cast("binary").alias("text")), count, schema)
    merged = arrow_map(parts.repartition("block"), merge, schema).collect()  # at most n_rows * cells bits
    bits = [np.zeros(cells // 8, np.uint8) for _ in range(n_rows)]
    for r in merged:
        row, at = divmod(r["block"] * small, cells)
        bits[row][at // 8:(at + small) // 8] = np.frombuffer(r["used"], np.uint8)
    return bits


def estimated_repeated(hashes: np.ndarray, bits: list[np.ndarray], cells: int) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for row, packed in enumerate(bits):
        at = cells_of(hashes, row, cells)
        out &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def candidates(block: Block, size: int, bits: list[np.ndarray], cells: int):
    """Starts of the windows whose anchors are estimated repeated, and the words' hashes."""
    starts, anchors, runs, words = anchored(block, size)
    own, back = np.unique(anchors, return_inverse=True)
    return starts[estimated_repeated(runs[own], bits, cells)[back]] if len(starts) else starts, words


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Documents with what tells rows of one doc_id apart: 31 bits of hash of the text.

    With `whole` the columns other than text come along, in a struct `doc`.
    """
    text = F.col("text").cast("binary")
    rest = [F.struct(F.lit(True).alias("_row"), *[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("doc")]
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("place"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(text, F.lit(b""))).bitwiseAND(F.lit(0x7FFFFFFF)).alias("mark"),
        text.alias("text"), *rest * whole)


def with_firsts(docs: DataFrame, size: int, cells: int, whole: bool = False):
    """The keyed documents with `firsts`, the starts of those of their candidate windows that are
    the first of their kind; and the broadcast sketch, to find the candidates again."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(repeated_cells(docs, lambda texts: anchors_seen(texts, size), cells))

    def windows(batches):
        bits = sketch.value
        for batch in batches:
            texts = texts_of(batch)
            place = batch.column("place").to_numpy(zero_copy_only=False)
            mark = batch.column("mark").to_numpy(zero_copy_only=False)
            for a, b in in_blocks(texts):
                block = Block(texts[a:b])
                starts, words = candidates(block, size, bits, cells)
                h1 = range_hash(prefix(words, 1), starts, starts + size)
                h2 = range_hash(prefix(words, 2), starts, starts + size)
                doc = block.doc[starts]
                at = (mark[a:b][doc] << 32) | (starts - block.first[doc])
                own = place[a:b][doc]
                order = np.lexsort((at, own, h2, h1))
                new = np.ones(len(order), bool)
                x, y = order[1:], order[:-1]
                new[1:] = (h1[x] != h1[y]) | (h2[x] != h2[y])
                one = order[new]  # the first of each kind here; the rest cannot be the first of all
                yield {"h1": h1[one].view(np.int64), "h2": h2[one].view(np.int64),
                       "place": own[one], "at": at[one]}

    found = arrow_map(keyed(docs), windows, "h1 long, h2 long, place long, at long")
    firsts = (found.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.min_by("at", "place").alias("at"))
              .groupBy("place", F.shiftright("at", 32).alias("mark"))
              .agg(F.collect_list(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("firsts")))
    return keyed(docs, whole).join(firsts, ["place", "mark"], "left"), sketch


def removed_words(batch, bits: list[np.ndarray], size: int, cells: int):
    """For blocks of a batch: range of rows, Block, which words go, and how many of each text."""
    texts = texts_of(batch)
    lists = batch.column("firsts").to_pylist()
    for a, b in in_blocks(texts):
        block = Block(texts[a:b])
        starts, _ = candidates(block, size, bits, cells)
        first = np.zeros(len(block.doc), bool)
        for i, own in enumerate(lists[a:b]):
            if own:
                first[block.first[i] + np.array(own)] = True
        gone = covered(starts[~first[starts]], size, len(block.doc))
        yield a, b, block, gone, np.diff(np.r_[0, np.cumsum(gone)][block.first])


def spans(block: Block, gone: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last removed word of each run in text i."""
    here = gone[block.first[i]:block.first[i + 1]].astype(np.int8)
    edge = np.diff(np.r_[0, here, 0])
    return block.first[i] + np.flatnonzero(edge == 1), block.first[i] + np.flatnonzero(edge == -1) - 1


def dedup_words(docs: DataFrame, size: int = 20, cells: int = CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and `spans`: begin and end of each removed run of
    words in bytes of the text, one after the other.

    A word goes if a window of `size` words covers it whose words also start earlier: in a smaller
    doc_id, or before it in the same row. Null texts have no words; rows without doc_id come before
    all others. Repeated rows are one place, and keep the same; of rows that share a doc_id and
    differ, one counts as the earlier. Other columns of docs are not looked at.
    """
    joined, sketch = with_firsts(docs, size, cells)

    def run(batches):
        for batch in batches:
            texts, ids = texts_of(batch), batch.column("doc_id").to_pylist()
            for a, b, block, gone, n_removed in removed_words(batch, sketch.value, size, cells):
                digests, cuts = [], []
                for i in range(b - a):
                    own, cut = texts[a + i].split(), []
                    if n_removed[i]:
                        begin, end = spans(block, gone, i)
                        cut = (np.c_[block.starts[begin], block.ends[end]] - block.begins[i]).ravel().tolist()
                        here = gone[block.first[i]:block.first[i + 1]].tolist()
                        own = [w for w, g in zip(own, here) if not g]
                    digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
                    cuts.append(cut)
                yield {"doc_id": ids[a:b], "n_words": block.n_words, "n_removed": n_removed,
                       "kept_sha256": digests, "spans": cuts}

    return arrow_map(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string, "
                     "spans array<long>")


def cut_repeats(docs: DataFrame, size: int = 20, cells: int = CELLS) -> DataFrame:
    """The rows of docs, all columns as they came, with texts that lack the words that go.

    A removed run takes the white space behind it along; a text without removed words is not
    changed, and one of which nothing is left is empty.
    """
    joined, sketch = with_firsts(docs, size, cells, whole=True)
    rest = joined.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b, block, gone, n_removed in removed_words(batch, sketch.value, size, cells):
                out = texts[a:b]
                for i in np.flatnonzero(n_removed).tolist():
                    begin, end = spans(block, gone, i)
                    last = block.first[i + 1] - 1
                    parts, at = [], 0
                    for x, y in zip(begin.tolist(), end.tolist()):
                        parts.append(out[i][at:block.starts[x] - block.begins[i]])
                        at = block.starts[y + 1] - block.begins[i] if y < last else len(out[i])
                    out[i] = b"".join([*parts, out[i][at:]])
                yield {"doc": batch.column("doc").slice(a, b - a), "text": out}

    kept = arrow_map(joined, run, f"doc {rest}, text binary")
    return kept.select([F.col("text").cast("string").alias(c) if c.lower() == "text" else F.col(f"doc.`{c}`")
                        for c in docs.columns])
