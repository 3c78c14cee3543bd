"""Benchmark decontamination by greedy string tiling.

Tokens are words in lower case (A-Z) without ASCII punctuation. Rolling (Karp-Rabin) hashes of
`shortest` tokens are looked up among those of the test items: a seed is a place in a document and
a place in an item with the same hash. Seeds that follow each other are a run; the longest run is
marked as a tile (of several the first in the document, then in the item), what touches it is cut
from the others, and so on until none is left. Tiles never overlap, in the document or in the item,
and may stand in any order, so a passage whose sentences were moved is covered like one that was
copied. A document leaks an item if its tiles cover at least `coverage` of the item's tokens.

Seeds are made in slices of bounded number and kept as runs only, so a repetitive text against a
repetitive item costs a row for each diagonal, not for each pair of places. Items of fewer tokens than
`shortest` have no seed; they are looked for as a whole.

Equal items are one. They are looked up from each task, in blocks of bounded size: one pass over the
documents per block, and no document is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domgrove.llm.common import LOWER, arrow_map, map_whole_rows, text_rows, texts_of
from domgrove.llm.text import Block, in_blocks, prefix, range_hash

PLAIN = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else LOWER[c] for c in range(256))
BLOCK_BYTES = 32 << 20
#: Seeds that are made at a time.
SLICE = 1 << 20
#: Items without seeds are looked for if their tokens have so many bytes together: shorter ones, such
#: as a single common word, stand in documents that have nothing to do with them.
LEAST_BYTES = 16


class Items:
    """Seeds of a block of test items, sorted by hash, and hashes of the short ones as a whole."""

    def __init__(self, names: list, texts: list[bytes], shortest: int, least_bytes: int = LEAST_BYTES):
        self.names, self.shortest = names, shortest
        block = Block([t.translate(PLAIN) for t in texts])
        starts, hashes = seeds(block, shortest)
        order = np.argsort(hashes, kind="stable")
        self.hashes, starts = hashes[order], starts[order]
        self.item = block.doc[starts] if len(starts) else starts
        self.place = starts - block.first[self.item]
        self.n_tokens = block.n_words
        size = np.r_[0, np.cumsum(block.ends - block.starts)]
        short = (block.n_words > 0) & (block.n_words < shortest) & (size[block.first[1:]] - size[block.first[:-1]] >= least_bytes)
        self.whole = {}
        for n in np.unique(block.n_words[short]).tolist():
            own = np.flatnonzero(short & (block.n_words == n))
            first = block.first[own]
            found = range_hash(prefix(block.hashes(), 1), first, first + n)
            order = np.argsort(found, kind="stable")
            self.whole[n] = found[order], own[order]

    def found(self, texts: list[bytes], coverage: float) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, tiles, covered tokens) wherever tiles cover enough of an item."""
        block = Block([t.translate(PLAIN) for t in texts])
        doc, item, start, place, length = self.runs(block)
        edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), True]) if len(doc) else []
        for a, b in zip(edge[:-1], edge[1:]):
            total = self.n_tokens[item[a]]
            if _reach(place[a:b], length[a:b] + self.shortest - 1) < coverage * total:
                continue
            n_tiles, covered = tile(start[a:b], place[a:b], length[a:b], self.shortest)
            if covered >= coverage * total:
                yield int(doc[a]), int(item[a]), n_tiles, covered
        for n, (hashes, own) in self.whole.items():
            starts, seen = seeds(block, n)
            low, high = (np.searchsorted(hashes, seen, side=side) for side in ("left", "right"))
            hit = np.flatnonzero(high > low)
            # Items are distinct as texts, but their tokens may be the same.
            pairs = {(int(block.doc[starts[k]]), int(i)) for k in hit.tolist() for i in own[low[k]:high[k]]}
            for d, i in sorted(pairs):
                yield d, i, 1, n

    def runs(self, block: Block) -> tuple[np.ndarray, ...]:
        """Seeds that follow each other in text and item: text, item, first place in either, how many;
        by text, item, diagonal and place."""
        starts, hashes = seeds(block, self.shortest)
        low = np.searchsorted(self.hashes, hashes)
        known = low < len(self.hashes)
        known[known] = self.hashes[low[known]] == hashes[known]
        starts, low = starts[known], low[known]
        n = np.searchsorted(self.hashes, hashes[known], side="right") - low
        first = np.r_[0, np.cumsum(n)]
        parts = []
        for a in range(0, int(first[-1]), SLICE):
            at = np.arange(a, min(a + SLICE, first[-1]))
            k = np.searchsorted(first, at, side="right") - 1
            own = low[k] + at - first[k]
            parts.append(joined(block.doc[starts[k]], self.item[own], starts[k], self.place[own], np.ones(len(at), np.int64)))
        return joined(*map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, np.int64),) * 5


def joined(doc: np.ndarray, item: np.ndarray, start: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs put together where one follows another, in order."""
    order = np.lexsort((start, start - place, item, doc))
    doc, item, start, place, length = (x[order] for x in (doc, item, start, place, length))
    if not len(doc):
        return doc, item, start, place, length
    follows = ((doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (start[1:] - place[1:] == start[:-1] - place[:-1])
               & (start[1:] == start[:-1] + length[:-1]))
    begin = np.flatnonzero(np.r_[True, ~follows])
    return doc[begin], item[begin], start[begin], place[begin], np.add.reduceat(length, begin)


def seeds(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    starts = block.windows(n)
    return starts, range_hash(prefix(block.hashes(), 1), starts, starts + n)


def _reach(places: np.ndarray, sizes: np.ndarray) -> int:
    """Item tokens that lie in any run: no tiling covers more."""
    order = np.argsort(places, kind="stable")
    begin, end = places[order], np.maximum.accumulate((places + sizes)[order])
    return int((end - np.maximum(begin, np.r_[begin[0], end[:-1]])).clip(0).sum())


def tile(starts: np.ndarray, places: np.ndarray, lengths: np.ndarray, n: int) -> tuple[int, int]:
    """Number of tiles and tokens they cover, from runs of seeds of n tokens."""
    count = covered = 0
    while len(starts):
        longest = np.flatnonzero(lengths == lengths.max())
        k = longest[np.lexsort((places[longest], starts[longest]))[0]]
        a, b, size = starts[k], places[k], int(lengths[k]) + n - 1
        count, covered = count + 1, covered + size
        # Seeds of a run that touch the tile, in the document and in the item: ranges of it.
        low = [np.clip(x - n + 1 - own, 0, lengths) for x, own in ((a, starts), (b, places))]
        high = [np.clip(x + size - own, 0, lengths) for x, own in ((a, starts), (b, places))]
        empty = [x >= y for x, y in zip(low, high)]
        for x, y, none in zip(low, high, empty):
            x[none], y[none] = lengths[none], lengths[none]
        swap = low[1] < low[0]
        first = [np.where(swap, q, p) for p, q in (low, high)]
        second = [np.where(swap, p, q) for p, q in (low, high)]
        left = [(np.zeros(len(starts), np.int64), first[0]), (first[1], second[0]), (np.maximum(first[1], second[1]), lengths)]
        kept = [(starts[ok] + x[ok], places[ok] + x[ok], (y - x)[ok]) for x, y in left for ok in [y > x]]
        starts, places, lengths = (np.concatenate(c) for c in zip(*kept))
    return count, covered


def blocks(benchmark: DataFrame, shortest: int) -> Iterator[Items]:
    """The distinct items, named by the MD5 of their text, some 32 MB of text at a time."""
    rows = benchmark.select(F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n = max(1, -(-int(size) // BLOCK_BYTES))
    for k in range(n):
        own = rows.filter(F.expr(f"pmod(xxhash64(text), {n}) = {k}")).select(F.md5("text").alias("name"), "text").collect()
        own.sort(key=lambda r: r["name"])
        yield Items([r["name"] for r in own], [r["text"] for r in own], shortest)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, shortest: int = 5) -> DataFrame:
    """doc_id, item_id, n_tiles, n_covered, coverage: a row for each item that a document leaks.

    Null and empty texts leak nothing and are never leaked. Items of fewer than `shortest` tokens are
    leaked where they stand as a whole, if they have LEAST_BYTES bytes. Repeated documents and
    repeated items each have their own rows. Other columns are not looked at.
    """
    rows = text_rows(docs)
    out = None
    for items in blocks(benchmark, shortest):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, held=held):
            items = held.value
            for batch in batches:
                texts, ids = texts_of(batch), batch.column("doc_id").to_pylist()
                for a, b in in_blocks(texts):
                    found = list(items.found(texts[a:b], coverage))
                    yield {"doc_id": [ids[a + d] for d, _, _, _ in found],
                           "name": [items.names[i] for _, i, _, _ in found],
                           "n_tiles": [n for _, _, n, _ in found],
                           "n_covered": [c for _, _, _, c in found],
                           "coverage": [c / int(items.n_tokens[i]) for _, i, _, c in found]}

        part = arrow_map(rows, run, "doc_id long, name string, n_tiles long, n_covered long, coverage double")
        out = part if out is None else out.unionByName(part)
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.md5(F.col("text").cast("binary")).alias("name"))
    return out.join(named, "name").select("doc_id", "item_id", "n_tiles", "n_covered", "coverage")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, shortest: int = 5) -> DataFrame:
    """The rows of docs that leak no item, all columns as they came."""
    for items in blocks(benchmark, shortest):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def start(held=held):
            def each(texts):
                leaking = np.zeros(len(texts), bool)
                for a, b in in_blocks(texts):
                    for d, _, _, _ in held.value.found(texts[a:b], coverage):
                        leaking[a + d] = True
                return {"leaking": leaking}

            return each

        docs = map_whole_rows(docs, start, "leaking boolean").filter("NOT leaking").select("doc.*")
    return docs
