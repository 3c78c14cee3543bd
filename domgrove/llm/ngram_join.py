"""Jaccard self-join of word shingles with adaptive multi-match prefixes.

Shingles are put in one order: those that fewer documents hold come first, as far as a table of
counters tells (any order gives the same links). Of two sets with a Jaccard similarity of at least
t, each shares ceil(t * size) shingles with the other; so for every m the first
size - ceil(t * size) + m shingles of both, their m-prefixes, have m in common. A document chooses
its own m by what its prefix would cost: the documents that its shingles would bring together, and
the verification of those that could share m of them. Longer prefixes bring more together and pass
fewer on. Two documents are verified if their prefixes for the smaller m of both share as many.

Alike sets are of like size, too: sizes are cut into classes of such a width that alike ones are of
one class or of neighbouring ones, and a bucket is a shingle and a class. Each node is at home in the
buckets of its class and visits those of the next.

Equal sets are one node. Nodes that meet are first linked with the most central node of their
buckets; what is left are pairs of different components in a bucket, which are looked at block
against block inside tasks. There nearly all that are not alike are told by a bit for each of many
cells, the parity of how many shingles fall in it: two sets differ in no more bits than in shingles,
so nothing is lost where too many bits differ. What is left leaves the task, once for each bucket it
meets in; pairs that meet often enough are verified on full sets. Links with centres go past the same
bits before full sets are made for them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domgrove.llm.common import arrow_map, mix, text_rows, texts_of
from domgrove.llm.near import components, fingerprints, full_sets, judged, shingle_sets, verified
from domgrove.llm.substring import CELLS as SKETCH_CELLS
from domgrove.llm.substring import estimated_repeated, repeated_cells
from domgrove.llm.text import in_blocks
from domgrove.sources.tables import cut_lineage, forget

#: Rows of the sketch that keeps back buckets of one document.
SKETCH_ROWS = 3
POSTING = "key long, is_home boolean, node binary, n long, m int"
#: Counters of shingles (16 MB as they are broadcast), and how many are merged at a time.
COUNTERS, PIECE, LANES = 1 << 22, 1 << 16, 32
#: The longest prefix that is tried shares so many shingles.
MOST = 8
#: Verifying a pair costs as much as this share of a set's size in places of prefix lists.
CHECK = 0.05
#: Bits of parity of a set of up to LARGE shingles; twice as many for each time it is twice as large.
PARITY, LARGE = 256, 300
#: Members of a bucket that are compared with each other at once.
BLOCK = 512


def counted(docs: DataFrame, size: int, counters: int = COUNTERS) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n_shingles, node (fingerprint of the set; null for an empty one), written; and how many
    documents hold a shingle of each counter.

    Every task counts the shingles of all its texts; counters are added up piece by piece, in two steps.
    """
    piece = min(counters, PIECE)

    def count(batches):
        held = np.zeros(counters, np.int64)
        for batch in batches:
            texts, ids = texts_of(batch), batch.column("doc_id")
            for a, b in in_blocks(texts):
                hashes, at = shingle_sets(texts[a:b], size)
                held += np.bincount((hashes & np.uint64(counters - 1)).astype(np.int64), minlength=counters)
                n = np.diff(at)
                names = [f if k else None for f, k in zip(fingerprints(hashes, at), n.tolist())]
                yield {"doc_id": ids.slice(a, b - a), "n_shingles": n, "node": names, "piece": [None] * len(n), "held": [None] * len(n)}
        for at in range(0, counters, piece):
            part = held[at:at + piece]
            if part.any():
                yield {"doc_id": [None], "n_shingles": [None], "node": [None], "piece": [at // piece],
                       "held": [zlib.compress(part.astype("<u4").tobytes(), 1)]}

    def merge(batches):
        added: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, held in zip(batch.column("piece").to_pylist(), batch.column("held").to_pylist()):
                own = added.setdefault(at, np.zeros(piece, np.int64))
                own += np.frombuffer(zlib.decompress(held), "<u4")
        for at, held in added.items():
            yield {"piece": [at], "held": [zlib.compress(np.minimum(held, 2**32 - 1).astype("<u4").tobytes(), 1)]}

    rows = cut_lineage(arrow_map(text_rows(docs), count, "doc_id long, n_shingles long, node binary, piece int, held binary"))
    parts = rows.filter("piece IS NOT NULL").select("piece", "held", F.expr(f"spark_partition_id() % {LANES}").alias("lane"))
    parts = arrow_map(parts.repartition("piece", "lane"), merge, "piece int, held binary")
    held = np.zeros(counters, np.uint32)
    # At most 4 bytes for each counter.
    for r in arrow_map(parts.repartition("piece"), merge, "piece int, held binary").collect():
        held[r["piece"] * piece:(r["piece"] + 1) * piece] = np.frombuffer(zlib.decompress(r["held"]), "<u4")
    return rows, held


class Order:
    """The order of shingles, and the prefixes of sets in it."""

    def __init__(self, held: np.ndarray, percent: int):
        self.held, self.percent = held, percent
        #: What a counter holds by chance.
        self.usual = int(np.median(held))

    def prefixes(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For sets of sorted hashes, set i from at[i] to at[i + 1]: the shingles of their prefixes one
        after the other, where each begins, the number m that each set chose, and its size."""
        n = np.diff(at)
        owner = np.repeat(np.arange(len(n)), n)
        seen = self.held[(hashes & np.uint64(len(self.held) - 1)).astype(np.int64)].astype(np.int64)
        order = np.lexsort((hashes, seen, owner))
        hashes, seen = hashes[order], seen[order]
        need = -(-self.percent * n // 100)
        others = np.r_[0, np.cumsum(np.maximum(seen - 1 - self.usual, 0))]
        least = np.full(len(n), np.inf)
        chosen = np.zeros(len(n), np.int64)
        for m in range(1, MOST + 1):
            length = n - need + m
            meet = others[np.minimum(at[:-1] + length, at[1:])] - others[at[:-1]]
            cost = length + meet + CHECK * n * meet / m
            better = (m <= need) & (cost < least)
            least[better], chosen[better] = cost[better], m
        length = np.where(n > 0, n - need + chosen, 0)
        begin = np.r_[0, np.cumsum(length)]
        take = np.arange(begin[-1]) - np.repeat(begin[:-1] - at[:-1], length)
        return hashes[take], begin, chosen, n


def prefixes(docs: DataFrame, size: int, order) -> DataFrame:
    """node, n, m, `text` (n and the shingles of the prefix as bytes) and the parities `odd` and
    `odd_next` (as in the next class of sizes; null if that is the same) for every document that has
    shingles; written, so that texts are not read again."""
    def run(batches):
        percent = order.value.percent
        for batch in batches:
            texts = texts_of(batch)
            for a, b in in_blocks(texts):
                hashes, at = shingle_sets(texts[a:b], size)
                tokens, begin, m, n = order.value.prefixes(hashes, at)
                own, names = np.flatnonzero(n), fingerprints(hashes, at)
                bits = [parity_bits(classes(n[own], percent) + k, percent) for k in (0, 1)]
                sets = [hashes[at[i]:at[i + 1]] for i in own.tolist()]
                yield {"node": [names[i] for i in own.tolist()], "n": n[own], "m": m[own],
                       "text": [n[i].tobytes() + tokens[begin[i]:begin[i + 1]].tobytes() for i in own.tolist()],
                       "odd": [parity(x, k) for x, k in zip(sets, bits[0].tolist())],
                       "odd_next": [None if k == j else parity(x, k) for x, j, k in zip(sets, *map(np.ndarray.tolist, bits))]}

    return cut_lineage(arrow_map(text_rows(docs), run, "node binary, n long, m int, text binary, odd binary, odd_next binary"))


def parity_bits(own: np.ndarray, percent: int) -> np.ndarray:
    """How many bits of parity sets of a class have."""
    largest = np.exp((own + 1) * (np.log(100 / percent) + 1e-6))
    return PARITY << np.maximum(0, np.ceil(np.log2(largest / LARGE))).astype(np.int64)


def parity(hashes: np.ndarray, bits: int) -> bytes:
    """Whether the number of shingles in each cell is odd."""
    cells = (mix(hashes + np.uint64(77)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=bits) & 1).tobytes()


def classes(n: np.ndarray, percent: int) -> np.ndarray:
    """Classes of sizes: of two sizes of which one is at least so many percent of the other, they
    differ by one at most."""
    return np.floor(np.log(n) / (np.log(100 / percent) + 1e-6)).astype(np.int64)


def buckets(raw: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of `text`: for each shingle whose it is, and its buckets at home and on a visit."""
    whole = np.frombuffer(b"".join(raw), np.uint64)
    sizes = np.array([len(x) // 8 for x in raw], np.int64)
    first = np.cumsum(sizes) - sizes
    is_token = np.ones(len(whole), bool)
    is_token[first] = False
    who = np.repeat(np.arange(len(raw)), sizes)[is_token]
    tokens, own = whole[is_token], classes(whole[first].astype(np.int64), percent)[who].astype(np.uint64)
    home, visit = (mix(tokens + mix(own + np.uint64(k))) for k in (1, 2))
    return who, home, visit


def postings(held: DataFrame, bits, cells: int, percent: int) -> DataFrame:
    """key (a bucket), is_home, node, n, m: the buckets of nodes that other nodes are in, too."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            who, *keys = buckets(batch.column("text").to_pylist(), percent)
            for is_home, key in zip((True, False), keys):
                own = np.flatnonzero(estimated_repeated(key, bits.value, cells))
                yield {"key": key[own].view(np.int64), "is_home": [is_home] * len(own)} | {
                    c: batch.column(c).take(pa.array(who[own])) for c in ("node", "n", "m")}

    return in_company(arrow_map(held, run, POSTING))


def in_company(rows: DataFrame) -> DataFrame:
    """Rows of POSTING whose key several nodes have, each node of a key once.

    They are moved once. In each task they come sorted; a row is held back until the next one tells
    whether its key has another node, so no bucket is held, however large.
    """
    def run(batches):
        held, last = None, (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            key = rows.column("key").to_numpy()
            name = np.frombuffer(b"".join(rows.column("node").to_pylist()), np.uint64).reshape(-1, 2)
            again = np.r_[(key[0], name[0].tobytes()) == last, (key[1:] == key[:-1]) & (name[1:] == name[:-1]).all(1)]
            own = np.flatnonzero(~again)
            if not len(own):
                continue
            key = key[own]
            before = np.r_[last[0] == key[0], key[1:] == key[:-1]]
            keep = before | np.r_[before[1:], False]
            at = int(own[-1])
            held = None if before[-1] else rows.slice(at, 1).to_batches()[0]
            if held is None:
                last = (key[-1], name[at].tobytes())
            taken = rows.take(pa.array(own[keep]))
            yield {c: taken.column(c) for c in taken.column_names}

    return arrow_map(rows.repartition("key").sortWithinPartitions("key", "node"), run, POSTING)


def across(mixed: DataFrame, odds: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may be alike and whose prefixes share enough.

    mixed has key, is_home, node, n, m, root, top (the component with most members in the bucket,
    whose members need not be compared with each other) and size, that of the bucket. Members of a
    bucket are dealt to blocks of some BLOCK; for each pair of blocks a part compares what is not
    `top` in either with everything in the other. odds has node, odd and odd_next.
    """
    placed = (mixed.withColumn("blocks", F.expr(f"cast(ceil(size / {BLOCK}) AS int)"))
              .withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
              .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
              .withColumn("x", F.least("block", "other").cast("int")).withColumn("y", F.greatest("block", "other").cast("int")))
    columns = ["key", "x", "y", "left", "is_home", "node", "root", "usual", "n", "m", "odd"]
    rows = (placed.join(odds, "node")
            .select("key", "x", "y", F.expr("block = x").alias("left"), "is_home", "node", "root", F.expr("root = top").alias("usual"),
                    "n", "m", F.expr("CASE WHEN is_home THEN odd ELSE coalesce(odd_next, odd) END").alias("odd"))
            .repartition("key", "x", "y").sortWithinPartitions("key", "x", "y"))

    def compare(part):
        _, x, y = part[0][:3]
        left, home, usual, n, m = (np.array([r[k] for r in part]) for k in (3, 4, 7, 8, 9))
        names, numbers = [r[5] for r in part], {}
        roots = np.array([numbers.setdefault(r[6], len(numbers)) for r in part])
        odd = np.frombuffer(b"".join([r[10] for r in part]), np.uint8).reshape(len(part), -1)
        for u in np.flatnonzero(~usual).tolist():
            # Each pair once: with the usual ones, and of two others from the later one; visitors meet at home.
            allowed = (roots != roots[u]) & (usual | (np.arange(len(part)) < u)) & (home | home[u])
            if x != y:
                allowed &= left != left[u]
            others = np.flatnonzero(allowed & (100 * np.minimum(n, n[u]) >= percent * np.maximum(n, n[u])))
            differ = np.bitwise_count(odd[others] ^ odd[u]).sum(1, dtype=np.int64)
            for v in others[differ * (100 + percent) <= (n[others] + n[u]) * (100 - percent)].tolist():
                yield min(names[u], names[v]), max(names[u], names[v]), int(min(m[u], m[v]))

    def run(batches):
        part: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if part and part[0][:3] != row[:3]:
                    found += compare(part)
                    part = []
                part.append(row)
            yield {"a": [r[0] for r in found], "b": [r[1] for r in found], "least": [r[2] for r in found]}
        found = list(compare(part)) if part else []
        yield {"a": [r[0] for r in found], "b": [r[1] for r in found], "least": [r[2] for r in found]}

    met = arrow_map(rows, run, "a binary, b binary, least int")
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("least").alias("least")).filter("shared >= least").select("a", "b")


def stars(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) and the `total` of their sizes: each node with the centre of its buckets with which
    it shares most, if that is enough. The centre of a bucket is its node with the largest buckets."""
    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    centres = (members.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", "node", "n", "m")).alias("best"))
               .select("key", F.col("best.node").alias("centre"), F.col("best.n").alias("n_centre"), F.col("best.m").alias("m_centre")))
    shared = (members.join(centres, "key").filter("node != centre")
              .filter(100 * F.least("n", "n_centre") >= percent * F.greatest("n", "n_centre"))
              .groupBy("node", "centre").agg(F.count("*").alias("shared"), F.min(F.least("m", "m_centre")).alias("least"),
                                             F.min(F.col("n") + F.col("n_centre")).alias("total")))
    best = shared.filter("shared >= least").groupBy("node").agg(F.max(F.struct("shared", "centre", "total")).alias("best"))
    return best.select(F.least("node", "best.centre").alias("a"), F.greatest("node", "best.centre").alias("b"), "best.total").distinct()


def maybe_alike(pairs: DataFrame, odds: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of which the parities do not tell that they are not alike, so that full sets are
    made and moved for few others than links. pairs has a, b and total; odds has node, odd and odd_next."""
    joined = pairs
    for side in "ab":
        joined = joined.join(odds.select(F.col("node").alias(side), F.col("odd").alias(f"odd_{side}"),
                                         F.col("odd_next").alias(f"next_{side}")), side)

    def run(batches):
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("total", "odd_a", "next_a", "odd_b", "next_b"))
            for i, (total, x, next_x, y, next_y) in enumerate(zip(*columns)):
                # Of neighbouring classes the smaller one has its bits as in the other class, too.
                if len(x) < len(y):
                    x = next_x
                elif len(y) < len(x):
                    y = next_y
                differ = int.bit_count(int.from_bytes(x) ^ int.from_bytes(y))
                if differ * (100 + percent) <= total * (100 - percent):
                    keep.append(i)
            yield {s: batch.column(s).take(pa.array(keep, pa.int64())) for s in "ab"}

    return arrow_map(joined, run, "a binary, b binary")


def labelled(docs: DataFrame, size: int = 4, percent: int = 85, cells: int = SKETCH_CELLS) -> DataFrame:
    """doc_id, n_shingles, node, root (the same for all rows that links reach; null for empty sets),
    written, for the caller to `forget`."""
    spark = docs.sparkSession
    rows, held_in = counted(docs, size)
    made = cut_lineage(rows.filter("piece IS NULL").select("doc_id", "n_shingles", "node"))
    forget(rows)
    nodes = cut_lineage(made.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    order = spark.sparkContext.broadcast(Order(held_in, percent))

    begun = prefixes(docs, size, order)
    bits = spark.sparkContext.broadcast(repeated_cells(begun, lambda texts: np.concatenate(buckets(texts, percent)[1:]), cells, SKETCH_ROWS))
    placed = cut_lineage(postings(begun, bits, cells, percent))
    odds = cut_lineage(begun.select("node", "odd", "odd_next").dropDuplicates(["node"]))
    forget(begun)
    members = cut_lineage(placed.join(placed.groupBy("key").agg(F.count("*").alias("size"), F.max("is_home").alias("some")).filter("size > 1 AND some").drop("some"), "key"))
    forget(placed)

    likely = cut_lineage(maybe_alike(stars(members, percent), odds, percent))
    held = full_sets(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), nodes, docs, size)
    links = cut_lineage(verified(likely, held, percent))
    forget(likely, held)

    # Pairs of one bucket that no link has joined yet.
    edges = components(links)
    told = cut_lineage(members.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
                       .select("key", "is_home", "node", "n", "m", "size", F.coalesce("root", "node").alias("root")))
    forget(members, edges)
    top = (told.groupBy("key", "root").agg(F.count("*").alias("k"))
           .groupBy("key").agg(F.max(F.struct("k", "root")).alias("best"), F.count("*").alias("n_roots"))
           .filter("n_roots > 1").select("key", F.col("best.root").alias("top")))
    mixed = cut_lineage(told.join(top, "key"))
    del top
    forget(told)
    pairs = cut_lineage(across(mixed, odds.join(mixed.select("node").distinct(), "node", "left_semi"), percent))
    forget(mixed, odds)
    held = full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, docs, size)
    all_links = cut_lineage(links.union(verified(pairs, held, percent)))
    forget(held, nodes, pairs, links)
    edges = components(all_links)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = cut_lineage(made.join(roots, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("root", "node").alias("root")))
    forget(all_links, edges, made)
    order.unpersist()
    bits.unpersist()
    return out


def similar(docs: DataFrame, size: int = 4, percent: int = 85, cells: int = SKETCH_CELLS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) for every row.

    Words are lower-cased (A-Z only); fewer words than `size` are one shingle. Two rows link when
    100 * intersection >= percent * union. Null and empty texts and texts without words have no
    shingle and link with nothing. Rows that share a doc_id are judged by their own texts; rows
    without doc_id give no component_id to others. Other columns of docs are not looked at.
    """
    return judged(labelled(docs, size, percent, cells)).select("doc_id", "n_shingles", "component_id")
