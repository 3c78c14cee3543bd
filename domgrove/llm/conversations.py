"""A trie of conversation prefixes, rolled up by bands of depth.

A node is a distinct sequence of turns. Its key is made of sums of hashes of its turns and their
places, so the keys of all prefixes of a conversation are running sums, and the key of a parent is
a difference: no task needs a whole conversation.

Depths are cut into bands of BAND. What a node adds to the subtrees around it goes to its ancestors
in its own band only. The first nodes of bands (band roots) then hold the totals of their bands;
they are a trie of their own, of a depth smaller by the factor BAND, whose totals are found in the
same way. Completed totals of band roots go to the ancestors in the band above. So the rounds grow
with the logarithm of the depth, and no row is copied more than BAND times in a round.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domgrove.llm.common import arrow_map
from domgrove.llm.ranks import beside, dealt, runs
from domgrove.sources.tables import cut_lineage, forget

#: Depths of a band.
BAND = 8
#: Conversations share the head of the first of so many, of up to HEADS - 1 turns.
FAMILY, HEADS = 20, 4
#: Ids of a node that are joined to one string before they are hashed together.
CHUNK = 4096

PARTS = ("p0", "p1", "p2", "p3")


def n_words(text: Column) -> Column:
    """Runs of characters other than space and 9 to 13."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def _hashes(content: Column, depth: Column) -> list[Column]:
    """128 bits that depend on a turn and its place, in four numbers whose sums cannot overflow."""
    out = []
    for seed in (11, 29):
        h = F.xxhash64(F.lit(seed), depth.cast("long"), content)
        out += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return out


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("long"), *sums)))


def rebuilt(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Turns of rebuilt conversations: conv_id, depth, total (turns of the conversation), words, key
    and parent (the keys of the prefixes that end with the turn and before it). Each conversation
    also has a row of depth 0, without turn and parent.

    Turns are ordered by turn, null first, then by the MD5 of role and text; null role and text are
    empty. Of conversation c the first h turns, h being the CRC-32 of the decimal c modulo `heads`,
    are replaced by those of conversation c - c % family, as far as it has them, or by nothing. Rows
    without conv_id belong to no conversation. Other columns are not looked at.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("content"),
        n_words(text).alias("words"))
    conv = ["conv_id"]
    placed = dealt(turns, conv, ["turn", "content"])
    parts = cut_lineage(runs(placed, conv))
    rank = F.col("at") - F.col("first") + F.col("size_before")
    starts = (beside(placed, parts, conv).withColumn("rank", rank).filter((F.col("rank") < heads - 1) & (F.col("conv_id") % family == 0))
              .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rank", "content", "words"))).alias("start"))
              .select(F.col("conv_id").alias("base"), "start"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own_head = F.slice(F.coalesce("start", F.array().cast("array<struct<rank:bigint,content:string,words:bigint>>")),
                       F.lit(1), F.col("h").cast("int"))
    known = cut_lineage(
        parts.select("conv_id", "n").distinct().withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % family})
        .join(starts, "base", "left").withColumn("head", own_head).drop("base", "start")
        .withColumn("total", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))

    # The head stands before all parts of a conversation.
    head = (known.select("conv_id", "total", F.posexplode("head").alias("i", "turn"))
            .select("conv_id", F.lit(-1).alias("part"), F.col("i").cast("long").alias("at"), (F.col("i") + 1).cast("long").alias("depth"),
                    "total", "turn.content", "turn.words"))
    told = parts.join(known.select("conv_id", "h", "total", F.size("head").alias("n_head")), "conv_id")
    own = (beside(placed, told, conv).withColumn("rank", rank).filter("rank >= h")
           .select("conv_id", "part", "at", (F.col("rank") - F.col("h") + F.col("n_head") + 1).alias("depth"),
                   "total", "content", "words"))
    both = head.unionByName(own)
    both = cut_lineage(both.select("*", *[p.alias(n) for p, n in zip(_hashes(F.col("content"), F.col("depth")), PARTS)]).drop("content"))
    summed = beside(both, runs(both, conv, PARTS), conv, PARTS)
    before = [F.col(f"{p}_before") for p in PARTS]
    key = _key(F.col("depth"), [b + F.col(p) for b, p in zip(before, PARTS)])
    rows = summed.select("conv_id", "depth", "total", "words", key.alias("key"), _key(F.col("depth") - 1, before).alias("parent"))
    roots = known.select("conv_id", F.lit(0).cast("long").alias("depth"), "total", F.lit(0).cast("long").alias("words"),
                         _key(F.lit(0), [F.lit(0).cast("long")] * len(PARTS)).alias("key"), F.lit(None).cast("binary").alias("parent"))
    made = cut_lineage(rows.unionByName(roots))
    forget(placed, parts, known, both)
    return made


def banded(turns: DataFrame, tier: int, band: int) -> DataFrame:
    """One row for each node whose depth is a multiple of band^tier: key, depth, words, parent, n_convs,
    conv_id (the smallest), up (its ancestors in its band, the band root first), and for band roots
    bridge (those in the band above).

    The turns of a conversation in a band, with the root of the next one, are a path; equal paths are
    counted once with their number, and nodes are taken from distinct paths.
    """
    step = band ** tier
    place = F.expr(f"depth div {step}")
    bands = F.when((F.col("i") % band == 0) & (F.col("i") > 0), F.array(F.expr(f"i div {band}"), F.expr(f"i div {band} - 1"))
                   ).otherwise(F.array(F.expr(f"i div {band}")))
    steps = (turns.filter(F.col("depth") % step == 0).withColumn("i", place).withColumn("band", F.explode(bands))
             .groupBy("conv_id", "band").agg(F.sort_array(F.collect_list(F.struct("i", "key", "depth", "words", "parent"))).alias("path")))
    paths = (steps.groupBy("band", F.element_at("path", -1)["key"].alias("tail"))
             .agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("path").alias("path")))
    items = paths.select("band", "n", "conv_id", F.transform("path", lambda x: x["key"]).alias("keys"), F.posexplode("path").alias("at", "x"))
    inside = F.expr(f"x.i div {band} = band")
    above = F.slice("keys", F.lit(1), F.col("at"))
    return (items.groupBy("x.key").agg(
        F.first("x.depth").alias("depth"), F.first("x.words").alias("words"), F.first("x.parent").alias("parent"),
        F.sum(F.when(inside, F.col("n"))).alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.first(F.when(inside, above), ignorenulls=True).alias("up"),
        F.first(F.when(~inside, above), ignorenulls=True).alias("bridge")))


def totals(tiers: list[DataFrame], values: DataFrame, names: list[str]) -> DataFrame:
    """key and the sums of `names` over the subtree of every node of the first tier."""
    def summed(rows: DataFrame, to: str) -> DataFrame:
        return (rows.select(F.explode(F.expr(to)).alias("key"), *names)
                .groupBy("key").agg(*[F.sum(c).alias(c) for c in names]))

    within = []
    for nodes in tiers:
        within.append(cut_lineage(summed(nodes.select("key", "up").join(values, "key"), "array_append(up, key)")))
        values = within[-1]
    done = within[-1]
    for nodes, own in zip(tiers[-2::-1], within[-2::-1]):
        below = summed(nodes.filter("bridge IS NOT NULL").select("key", "bridge").join(done, "key"), "bridge")
        both = cut_lineage(own.unionByName(below).groupBy("key").agg(*[F.sum(c).alias(c) for c in names]))
        forget(own, done)
        done = both
    return done


def ends(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key and ends_sha256, the hash of the ids of conversations that end at a node, ascending, joined
    by commas.

    Ids are dealt by range of key and id and joined to strings of `chunk` ids where they lie. The
    strings of a node go through one hash in order, because SHA-256 runs through its input from
    beginning to end; they stream, and only the state of the hash is held.
    """
    own = (turns.filter("depth = total").select("key", "conv_id")
           .repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"))

    def join(batches):
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            out: dict[str, list] = {"key": [], "least": [], "ids": []}
            a = 0
            for b in range(1, len(keys) + 1):
                if b == len(keys) or keys[b] != keys[a] or b - a == chunk:
                    out["key"].append(keys[a])
                    out["least"].append(ids[a])
                    out["ids"].append(",".join(map(str, ids[a:b])))
                    a = b
            yield out

    def digest(batches):
        last, state = None, None
        for batch in batches:
            out: dict[str, list] = {"key": [], "ends_sha256": []}
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == last:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    out["key"].append(last)
                    out["ends_sha256"].append(state.hexdigest())
                last, state = key, hashlib.sha256(ids.encode())
            yield out
        if state:
            yield {"key": [last], "ends_sha256": [state.hexdigest()]}

    strings = arrow_map(own, join, "key binary, least long, ids string")
    return arrow_map(strings.repartition("key").sortWithinPartitions("key", "least"), digest, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, band: int = BAND) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see `rebuilt`): conv_id (the smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    saved_tokens sums over the subtree of a node the words of each last turn once for every member
    but one. An empty table has no node, not even the root. Repeated rows are turns of their own.
    """
    turns = rebuilt(conversations, family, heads)
    deepest = turns.agg(F.max("depth")).first()[0] or 0
    tiers = [cut_lineage(banded(turns, 0, band))]
    while deepest // band ** len(tiers) > 0:
        tiers.append(cut_lineage(banded(turns, len(tiers), band)))
    nodes = tiers[0]
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    known = cut_lineage(nodes.join(children, "key", "left").select(
        "key", "depth", "parent", "n_convs", "conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    values = known.select("key", (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    sums = totals(tiers, values, ["n_leaves", "saved_tokens"])
    forget(*tiers)
    full = known.join(sums, "key").join(cut_lineage(ends(turns)), "key", "left")
    forget(turns)
    above = known.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(above, F.col("parent") == F.col("above"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
