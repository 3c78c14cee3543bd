"""A Merkle manifest of a dataset, rolled up over nested structs.

Every document is a leaf. The leaves of a language, by doc_id, are joined two by two until one hash
is left, its subroot; the subroots, by language, likewise give the root of the dataset.

A leaf's rank is cut into digits of BITS bits, and ranks into blocks of DIGITS digits. Within a
block the digits are grouped away one after the other, the lowest first: each grouping nests up to
2^BITS child structs in their parent, beside the hashes of the levels between. So a block becomes
one row, whose size is bounded, and the hashes of blocks are the leaves of the next tier. On the
way back the siblings above a block meet its row in one more grouping, and a transform over the
nested structs gives every leaf its siblings, which are then exploded: no proof is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domgrove.llm.ranks import ranked
from domgrove.sources.tables import cut_lineage, forget

#: Levels that one grouping closes, and groupings of a block: 4096 leaves.
BITS, DIGITS = 4, 3


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The hash of a document; columns may be replaced, as n_chars=..."""
    return digest(*[field(changed.get(c, F.col(c))) for c in ("doc_id", "source", "lang", "n_chars", "text")])


def _levels(base: int) -> Column:
    """The hashes of `kids`, and those of each level up to the next digit, as arrays in an array.

    Below the height of its tree a last run of one is hashed too; from there on nothing is left to join.
    """
    last = "element_at(made, -1)"
    joined = (f"transform(sequence(0, (size({last}) - 1) div 2), i -> "
              f"sha2(concat({last}[2 * i], coalesce(get({last}, 2 * i + 1), '')), 256))")
    return F.expr(f"aggregate(sequence({base}, {base + BITS - 1}), array(transform(kids, k -> k.node.hash)), "
                  f"(made, level) -> CASE WHEN level < height THEN concat(made, array({joined})) ELSE made END)")


def _nested(nodes: DataFrame, keys: list[str], tier: int) -> DataFrame:
    """One row for each block of nodes (keys, height, rank, node: a struct with hash): keys, height,
    block, and node with the children nested in it."""
    digits = [f"digit_{i}" for i in range(DIGITS)]
    here = nodes.select(
        *keys, "height", F.shiftright("rank", BITS * DIGITS).alias("block"), "node",
        *[F.shiftright("rank", BITS * i).bitwiseAND(F.lit(2**BITS - 1)).cast("int").alias(d) for i, d in enumerate(digits)])
    # All groupings of a block stay where this puts it.
    here = here.repartition(*keys, "block")
    for i, digit in enumerate(digits):
        kids = F.sort_array(F.collect_list(F.struct(F.col(digit).alias("digit"), "node")))
        levels = _levels((tier * DIGITS + i) * BITS)
        here = (here.groupBy(*keys, "height", "block", *digits[i + 1:]).agg(kids.alias("kids"))
                .withColumn("levels", levels)
                .withColumn("node", F.struct(F.element_at("levels", -1)[0].alias("hash"), "levels", "kids"))
                .drop("kids", "levels"))
    return here


def _siblings(node: str, i: str) -> str:
    """Siblings of child i and of what it is joined to inside its parent; null where there is none."""
    return (f"transform(slice({node}.levels, 1, size({node}.levels) - 1), "
            f"(row, level) -> get(row, shiftright({i}, level) ^ 1))")


def _unnested(blocks: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """One row for each node below blocks (keys, node, above, top): keys, `payload` of the node,
    its siblings from the lowest level up, top."""
    def below(parent: str, depth: int, above: str) -> str:
        kid, i = f"kid{depth}", f"i{depth}"
        path = f"concat({_siblings(parent, i)}, {above})"
        inner = (f"named_struct('payload', {kid}.node.{payload}, 'siblings', {path})" if depth + 1 == DIGITS
                 else below(f"{kid}.node", depth + 1, path))
        made = f"transform({parent}.kids, ({kid}, {i}) -> {inner})"
        return made if depth + 1 == DIGITS else f"flatten({made})"

    return (blocks.select(*keys, "top", F.explode(F.expr(below("node", 0, "above"))).alias("leaf"))
            .select(*keys, F.col("leaf.payload").alias(payload), "leaf.siblings", "top"))


def roll_up(nodes: DataFrame, keys: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """The root of each tree of nodes (keys, n, rank, node: a struct with hash and leaf), one row for
    equal keys: keys and hash; and the tiers of blocks, for `proofs`, to be forgotten afterwards."""
    height = F.expr("CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END")
    here, tiers = nodes.withColumn("height", height), []
    while not tiers or not tiers[-1].filter("block > 0").isEmpty():
        if tiers:
            here = tiers[-1].select(*keys, "height", F.col("block").alias("rank"),
                                    F.struct(F.col("node.hash").alias("hash"), "block").alias("node"))
        tiers.append(cut_lineage(_nested(here, keys, len(tiers))))
    return tiers[-1].select(*keys, F.col("node.hash").alias("hash")), tiers


def proofs(tiers: list[DataFrame], keys: list[str], above: DataFrame) -> DataFrame:
    """For each leaf of rolled-up trees: keys, leaf, siblings from the lowest level up (null where a
    node has none), top. `above` has for each tree keys, siblings above its root, and top, a struct
    that all its leaves receive."""
    told = above.withColumn("block", F.lit(0).cast("long"))
    for i in reversed(range(len(tiers))):
        blocks = tiers[i].select(*keys, "block", "node")
        both = blocks.unionByName(told, allowMissingColumns=True).groupBy(*keys, "block").agg(
            *[F.first(c, ignorenulls=True).alias(a) for c, a in (("node", "node"), ("siblings", "above"), ("top", "top"))])
        told = _unnested(both, keys, "block" if i else "leaf")
    return told


def manifest(docs: DataFrame, **claims: Column) -> DataFrame:
    """doc_id, hash, siblings, spot, subroot, root for every row of docs, beside `claims`, columns
    made from docs.

    Leaves of one language ascend by doc_id (null first), rows of one doc_id by their hash; languages
    ascend too, null first. Nulls in any column are part of the hash. Siblings are listed from the
    leaf to the root, null where a level joins a node with nothing; bit i of `spot` is set where
    sibling i stands on the left (see `folded`). An empty table gives no rows; other columns of docs
    are not looked at.
    """
    made = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"),
                       leaf().alias("hash"), *[c.alias(f"claim_{name}") for name, c in claims.items()])
    placed, written = ranked(made, ["lang"], ["doc_id", "hash"])
    payload = F.struct("doc_id", "hash", "rank", "n", *[F.col(f"claim_{c}").alias(c) for c in claims])
    subroots, tiers = roll_up(
        placed.select("lang", "n", "rank", F.struct("hash", payload.alias("leaf")).alias("node")), ["lang"])
    forget(written)

    langs, written = ranked(subroots.withColumn("all", F.lit(0)), ["all"], ["lang"])
    payload = F.struct("lang", "hash", "rank")
    roots, lang_tiers = roll_up(
        langs.select("all", "n", "rank", F.struct("hash", payload.alias("leaf")).alias("node")), ["all"])
    forget(written)
    none = F.array().cast("array<string>")
    above = proofs(lang_tiers, ["all"], roots.select("all", none.alias("siblings"), F.struct("hash").alias("top")))
    above = above.select("leaf.lang", "siblings", F.struct(
        F.col("leaf.hash").alias("subroot"), F.col("top.hash").alias("root"), F.col("leaf.rank").alias("place")).alias("top"))
    height = "CASE WHEN leaf.n > 1 THEN length(bin(leaf.n - 1)) ELSE 0 END"
    return proofs(tiers, ["lang"], above).select(
        "leaf.doc_id", "leaf.hash", "siblings", F.expr(f"leaf.rank + shiftleft(top.place, {height})").alias("spot"),
        "top.subroot", "top.root", *[f"leaf.{c}" for c in claims])


def folded(start: Column, siblings: str = "siblings", spot: str = "spot") -> Column:
    """The root that a leaf's hash and its siblings lead to."""
    steps = F.transform(F.col(siblings), lambda s, i: F.struct(s.alias("sibling"), i.alias("level")))
    left = lambda x: F.call_function("shiftright", F.col(spot), x["level"]).bitwiseAND(F.lit(1)) == 1
    return F.aggregate(steps, start, lambda own, x: F.sha2(
        F.when(x["sibling"].isNull(), own).when(left(x), F.concat(x["sibling"], own))
        .otherwise(F.concat(own, x["sibling"])), 256))


def checked(docs: DataFrame) -> DataFrame:
    """The digest of a manifest of docs of which some were tampered with: doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified.

    Where 7 divides the CRC-32 of the decimal doc_id, n_chars is one larger at verification than it
    was in the manifest; null stays null, and rows without doc_id are left as they are.
    """
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    rows = manifest(docs, tampered=F.when(hit, leaf(n_chars=more)))
    return (rows.withColumn("folded_root", folded(F.coalesce("tampered", "hash")))
            .select("doc_id", F.col("hash").alias("leaf"), "subroot", "root",
                    F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root",
                    F.expr("folded_root = root").alias("verified")))
