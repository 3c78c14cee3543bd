"""Near-duplicate detection with SetSketch registers.

A document's set is its distinct word shingles. Register i of its sketch is floor(1 - log_b(x)),
clipped to 0..q+1, of the least x of an exponential variable that each shingle draws for i:
exponentially spaced, truncated minima. The register of a union is the larger of two, and two
sets agree in a register about as often as in a share J of their elements.

Documents with equal sets are one node from the start. Nodes that agree in all registers of a band
are candidates: first each with the most central node of its buckets (the one with the largest
buckets, if the two meet in more than one), then, when the links found so far have been joined to components, those of different
components in one bucket. A pair within one component needs no check, so a large group of copies
costs some links per member and bucket. Pairs of the second kind are compared inside tasks, block
against block, however large a bucket is; a pair that meets in several buckets counts in the first.
Candidates whose similarity, estimated by maximum likelihood from the registers and the set sizes
together, cannot be near the threshold are dropped, and the rest verified on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domgrove.llm.common import arrow_map, map_whole_rows, mix, text_rows, texts_of
from domgrove.llm.text import Block, in_blocks, prefix, range_hash
from domgrove.sources.tables import cut_lineage, forget

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, LAST = 1.001, 20.0, 2**16 - 2
#: Some five standard deviations of the estimate below 0.75. Pruning only saves work: links are verified.
PRUNE = 0.55
#: Members of a bucket that are compared with each other at once.
BLOCK = 512

_R = np.random.default_rng(20240607)
_A, _B, _C = (_R.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1) for _ in range(3))


def shingle_sets(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of some texts, sorted by text and hash, and where each text begins.

    Words are lower-cased (A-Z only). Fewer words than `size` are one shingle; no words, none.
    """
    block = Block(texts, lower=True)
    sums = prefix(block.hashes(), 1)
    starts = block.windows(size)
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < size))
    first = np.r_[starts, block.first[short]]
    end = np.r_[starts + size, block.first[short + 1]]
    hashes = range_hash(sums, first, end)
    doc = block.doc[first] if len(first) else np.zeros(0, np.int64)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


def fingerprints(hashes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits of each set, the same in whatever order."""
    sums = []
    for salt in (0x51, 0xA7):
        total = np.r_[np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(salt << 40)))]
        sums.append(mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)))
    return [a + b for a, b in zip(*([x.tobytes() for x in s.astype(">u8")] for s in sums))]


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sketches of sets, one row of uint16 for each."""
    least = np.full((len(at) - 1, REGISTERS), 2**32 - 1, np.uint32)
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for a in range(0, len(hashes), 4096):
        draw = low[a:a + 4096, None] * _A
        draw += high[a:a + 4096, None] * _B
        draw += _C
        draw ^= draw >> np.uint32(15)
        draw *= np.uint32(0x2C1B3C6D)
        draw ^= draw >> np.uint32(13)
        own = owner[a:a + 4096]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        part = np.minimum.reduceat(draw, begin, axis=0)
        least[own[begin]] = np.minimum(least[own[begin]], part)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LAST + 1).astype("<u2")


def sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, node (fingerprint of the set; null for an empty one), registers."""
    def run(batches):
        for batch in batches:
            texts, ids = texts_of(batch), batch.column("doc_id")
            for a, b in in_blocks(texts):
                hashes, at = shingle_sets(texts[a:b], size)
                n = np.diff(at)
                rows = registers(hashes, at)
                yield {"doc_id": ids.slice(a, b - a), "n_shingles": n,
                       "node": [f if k else None for f, k in zip(fingerprints(hashes, at), n.tolist())],
                       "registers": [r.tobytes() if k else None for r, k in zip(rows, n.tolist())]}

    return arrow_map(text_rows(docs), run, "doc_id long, n_shingles long, node binary, registers binary")


def band_keys(rows: np.ndarray) -> np.ndarray:
    """The bucket of each band, for rows of registers."""
    cut = rows.reshape(len(rows), BANDS, ROWS)
    key = np.zeros((len(rows), BANDS), np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + cut[:, :, i] + np.uint64(1))
    return mix(key + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def bands(nodes: DataFrame) -> DataFrame:
    """A row (bucket, node) for each band of each node."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                key, names = band_keys(unpacked(batch.column("registers"))), batch.column("node").to_pylist()
                for i in range(BANDS):
                    yield {"bucket": key[:, i].copy(), "node": names}

    return arrow_map(nodes.select("node", "registers"), run, "bucket long, node binary")


def likeliest(own: np.ndarray, other: np.ndarray, n_own: np.ndarray, n_other: np.ndarray) -> np.ndarray:
    """Maximum-likelihood estimates of J for pairs of sketches of sets of known sizes."""
    more, less = (own > other).sum(1), (own < other).sum(1)
    same = own.shape[1] - more - less
    u = (n_own / (n_own + n_other))[:, None]
    grid = np.linspace(0, 1, 101)[None, :]
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * grid), p(v - u * grid)
    with np.errstate(divide="ignore"):
        parts = [np.where(k[:, None] > 0, k[:, None] * np.log(np.maximum(q, 1e-300)), 0)
                 for k, q in ((more, up), (less, down), (same, 1 - up - down))]
    total = np.where(grid <= np.minimum(u / v, v / u) + 0.01, sum(parts), -np.inf)
    return grid[0][np.argmax(total, axis=1)]


def _indices(keep: np.ndarray) -> pa.Array:
    return pa.array(keep, pa.int64())


def probable(pairs: DataFrame, nodes: DataFrame, prune: float = PRUNE) -> DataFrame:
    """Pairs (a, b) of nodes whose estimated similarity is at least `prune`."""
    sides = [nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"),
                          F.col("registers").alias(f"r_{s}")) for s in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, other = (unpacked(batch.column(f"r_{s}")) for s in "ab")
            n = [batch.column(f"n_{s}").to_numpy(zero_copy_only=False).astype(float) for s in "ab"]
            keep = np.flatnonzero(likeliest(own, other, *n) >= prune)
            yield {s: batch.column(s).take(_indices(keep)) for s in "ab"}

    return arrow_map(joined, run, "a binary, b binary")


def maybe_among(docs: DataFrame, ids: DataFrame, most_bits: int = 1 << 28) -> DataFrame:
    """Rows of docs whose doc_id is among `ids` (one column), and few others.

    A bitmap of hashes, 16 bits for each id and most_bits (32 MB) in all, is broadcast, so that texts
    nobody asked for are not moved. With more ids than it has room for it lets more rows through.
    """
    name = ids.columns[0]
    bits = 1 << min(most_bits.bit_length() - 1, max(16, (16 * max(1, ids.count()) - 1).bit_length()))

    def place(column):
        return F.pmod(F.xxhash64(column), F.lit(bits))

    maps = (ids.select(place(F.col(name)).alias("bit")).groupBy(F.expr("bit div 32768").alias("part"))
            .agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("map")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = whole.withColumn("bit", place(F.col("row.doc_id").cast("long"))).join(
        F.broadcast(maps), F.expr("bit div 32768 = part"))
    byte = F.conv(F.hex(F.expr("substring(map, cast(bit % 32768 div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.expr("cast(bit % 8 AS int)")).bitwiseAND(F.lit(1)) == 1
    return found.filter(hit).select("row.*")


def full_sets(needed: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node and members (sorted 64-bit hashes) of the nodes in `needed` (one column, distinct)."""
    asked = cut_lineage(nodes.join(needed, "node")
                        .select(F.col("doc_id").alias("asked_id"), F.col("node").alias("asked")))
    texts = (maybe_among(text_rows(docs), asked.select("asked_id"))
             .join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id"))).select("text", "asked"))

    def sets(batches):
        for batch in batches:
            asked = batch.column("asked").to_pylist()
            texts = texts_of(batch)
            for a, b in in_blocks(texts):
                hashes, at = shingle_sets(texts[a:b], size)
                made = fingerprints(hashes, at)
                own = [i for i in range(b - a) if made[i] == asked[a + i]]
                yield {"node": [made[i] for i in own],
                       "members": [hashes[at[i]:at[i + 1]].tobytes() for i in own]}

    held = cut_lineage(arrow_map(texts, sets, "node binary, members binary").dropDuplicates(["node"]))
    forget(asked)
    return held


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    joined = (pairs.join(held.select(F.col("node").alias("a"), F.col("members").alias("m_a")), "a")
              .join(held.select(F.col("node").alias("b"), F.col("members").alias("m_b")), "b"))

    def run(batches):
        for batch in batches:
            own, other = (batch.column(f"m_{s}") for s in "ab")
            keep = [i for i in range(batch.num_rows)
                    if alike(*(np.frombuffer(side[i].as_buffer(), np.uint64) for side in (own, other)), percent)]
            yield {s: batch.column(s).take(_indices(np.array(keep, np.int64))) for s in "ab"}

    return arrow_map(joined, run, "a binary, b binary")


def across(mixed: DataFrame, nodes: DataFrame, held: DataFrame, percent: int, prune: float = PRUNE) -> DataFrame:
    """Linked pairs of nodes of one bucket but of different components.

    The sets travel with the members, because many pairs that are nearly alike would weigh more
    than the members do: those are judged where they meet, and only links leave the task.

    mixed has bucket, node, root, top (the component with most members, whose members need not be
    compared with each other) and n, the size of the bucket. Members of a bucket are dealt to
    blocks of some BLOCK; for each pair of blocks a part compares what is not `top` in either with
    everything in the other.
    """
    n_blocks = F.expr(f"cast(ceil(n / {BLOCK}) AS int)")
    placed = (mixed.withColumn("blocks", n_blocks).withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
              .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
              .withColumn("x", F.least("block", "other").cast("int")).withColumn("y", F.greatest("block", "other").cast("int")))
    rows = (placed.join(nodes.select("node", "n_shingles", "registers").join(held, "node"), "node")
            .select("bucket", "x", "y", F.expr("block = x").alias("left"), "node", "root",
                    F.expr("root = top").alias("usual"), "n_shingles", "registers", "members")
            .repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y"))

    def compare(part):
        """Links of one part, whose rows have the columns below."""
        bucket, x, y = part[0][:3]
        names, numbers = [r[4] for r in part], {}
        roots = np.array([numbers.setdefault(r[5], len(numbers)) for r in part])
        usual, n = np.array([r[6] for r in part]), np.array([r[7] for r in part], float)
        left = np.array([r[3] for r in part])
        registers = np.frombuffer(b"".join([r[8] for r in part]), "<u2").reshape(-1, REGISTERS)
        keys = band_keys(registers)
        band = int(np.argmax(keys[0] == bucket))
        few = np.flatnonzero(~usual)
        for u in few.tolist():
            # Each pair once: with the usual ones, and of two others from the later one.
            allowed = (roots != roots[u]) & (usual | (np.arange(len(part)) < u))
            if x != y:
                allowed &= left != left[u]
            others = np.flatnonzero(allowed)
            same = (registers[others] == registers[u]).sum(1)
            others = others[same >= (prune - 0.05) * REGISTERS]
            others = others[~(keys[others, :band] == keys[u, :band]).any(1)]
            if len(others):
                own = np.broadcast_to(registers[u], (len(others), REGISTERS))
                good = likeliest(own, registers[others], np.full(len(others), n[u]), n[others]) >= prune
                mine = np.frombuffer(part[u][9], np.uint64)
                for v in others[good].tolist():
                    if not alike(mine, np.frombuffer(part[v][9], np.uint64), percent):
                        continue
                    yield (names[u], names[v]) if names[u] < names[v] else (names[v], names[u])

    def run(batches):
        columns = ["bucket", "x", "y", "left", "node", "root", "usual", "n_shingles", "registers", "members"]
        part: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if part and part[0][:3] != row[:3]:
                    found += compare(part)
                    part = []
                part.append(row)
            yield {"a": [p for p, _ in found], "b": [q for _, q in found]}
        found = list(compare(part)) if part else []
        yield {"a": [p for p, _ in found], "b": [q for _, q in found]}

    return arrow_map(rows, run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """u and v, the root (the smallest node), of every linked node that is no root, by alternating
    large and small stars. They are written, for the caller to `forget`."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .filter("u != v").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u AND v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.filter("u != m").select("u", F.col("m").alias("v"))).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        before, edges = edges, cut_lineage(small)
        forget(before)
    return edges


def stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b): each node with the most central one of its buckets, if the two meet more than once."""
    central = members.groupBy("node").agg(F.sum("n").alias("weight"))
    centres = (members.join(central, "node").groupBy("bucket")
               .agg(F.max(F.struct("weight", "node")).alias("best")).select("bucket", F.col("best.node").alias("centre")))
    return (members.join(centres, "bucket").filter("node != centre")
            .groupBy(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))
            .agg(F.count("*").alias("m")).filter("m > 1").drop("m"))


def labelled(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, node, root (the same for all rows that links reach; null for empty sets).

    What is written on the way is deleted as soon as nothing reads it any more; the result is
    written too, for the caller to `forget`.
    """
    made = cut_lineage(sketches(docs, size))
    nodes = cut_lineage(
        made.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
        .join(made.select("doc_id", F.col("node").alias("own"), "n_shingles", "registers"),
              F.expr("node = own AND doc_id <=> least"))
        .select("node", "doc_id", "n_shingles", "registers").dropDuplicates(["node"]))
    bare = cut_lineage(made.select("doc_id", "n_shingles", "node"))
    forget(made)
    placed = bands(nodes)
    members = cut_lineage(placed.join(placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket"))
    # Pairs that meet once only are left to the second round.
    likely = cut_lineage(probable(stars(members), nodes))
    held = full_sets(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), nodes, docs, size)
    links = cut_lineage(verified(likely, held, percent))
    forget(likely, held)

    # Candidates in one bucket that no link has joined yet.
    edges = components(links)
    told = cut_lineage(members.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
                       .select("bucket", "node", "n", F.coalesce("root", "node").alias("root")))
    forget(members, edges)
    mixed = cut_lineage(told.join(
        told.groupBy("bucket", "root").agg(F.count("*").alias("m"))
        .groupBy("bucket").agg(F.max(F.struct("m", "root")).alias("best"), F.count("*").alias("n_roots"))
        .filter("n_roots > 1").select("bucket", F.col("best.root").alias("top")), "bucket"))
    forget(told)
    held = full_sets(mixed.select("node").distinct(), nodes, docs, size)
    all_links = cut_lineage(links.union(across(mixed, nodes, held, percent)))
    forget(mixed, held, nodes, links)
    edges = components(all_links)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    rows = cut_lineage(bare.join(roots, "node", "left").select(
        "doc_id", "n_shingles", "node", F.coalesce("root", "node").alias("root")))
    forget(all_links, edges, bare)
    return rows


def judged(rows: DataFrame) -> DataFrame:
    """The labelled rows with component_id and kept."""
    least = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return (rows.join(least, "root", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.expr("component_id <=> doc_id")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    component_id is the smallest doc_id that links reach; kept where that is the row's own. Empty
    sets (null or empty texts, or no words) are linked with nothing. Rows that share a doc_id stand
    for the same document in component_id and are kept or not by their own component; rows without
    doc_id give no component_id to others. Other columns of docs are not looked at.
    """
    return judged(labelled(docs, size, percent)).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, once: bool = False) -> DataFrame:
    """The rows of docs that near_duplicates keeps, each by its own doc_id and set.

    With `once` a single row of each component stays: that of the smallest doc_id (rows without one
    come last), then of the smallest fingerprint, then of the smallest hash. Rows with empty sets
    all stay.

    Rows whose doc_id no other row has are told by it alone. Only rows of repeated or missing ids,
    of which some stay, have their sets hashed again.
    """
    written = rows = labelled(docs, size, percent)
    if once:
        best = rows.filter("root IS NOT NULL").groupBy("root").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"))
        rows = rows.join(best, "root", "left").withColumn(
            "kept", F.expr("node IS NULL OR (doc_id <=> best.doc_id AND node = best.node)"))
    else:
        rows = judged(rows)
    told = cut_lineage(rows.select("doc_id", "node", "kept"))
    forget(written)
    ids = cut_lineage(told.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("some"))
                      .filter("NOT some OR n > 1 OR doc_id IS NULL"))
    several = ids.filter("some").select("doc_id")
    gone = ids.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("gone_id"))
    # Rows travel as one struct, so that none of their columns can clash with those of the joins.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    plain = (whole.filter("doc.doc_id IS NOT NULL")
             .join(gone, F.col("doc.doc_id").cast("long") == F.col("gone_id"), "left_anti"))
    if several.isEmpty():
        forget(told)
        return plain.select("doc.*")

    def start():
        def each(texts):
            names = []
            for a, b in in_blocks(texts):
                hashes, at = shingle_sets(texts[a:b], size)
                names += [f if k else None for f, k in zip(fingerprints(hashes, at), np.diff(at).tolist())]
            return {"node": names}

        return each

    own = map_whole_rows(maybe_among(docs, several), start, "node binary").withColumn("id", F.col("doc.doc_id").cast("long"))
    # All rows with a set, also those let through by chance: only keys of `several` are looked for.
    sets = own.filter("node IS NOT NULL")
    if once:  # before the join, so that copies under one id are combined where they lie
        sets = sets.groupBy("id", "node").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    stay = (told.filter("kept AND node IS NOT NULL").join(several.withColumnRenamed("doc_id", "key"), F.expr("doc_id <=> key"))
            .select(F.col("doc_id").alias("key"), F.col("node").alias("name")).distinct())
    bare = own.filter("node IS NULL").join(several.withColumnRenamed("doc_id", "key"), F.expr("id <=> key"), "left_semi")
    found = sets.join(stay, F.expr("id <=> key AND node = name"), "left_semi").select("doc").unionByName(bare.select("doc"))
    return plain.select("doc").unionByName(found).select("doc.*")
