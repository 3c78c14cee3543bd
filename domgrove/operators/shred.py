"""Shred pages into one row per element.

One exchange puts the rows of a page together; every later window and aggregate is keyed by
page_id first and reuses it. The tree is found in three steps, from the outside in:

1. containers (div, ul, table, ...) pair with their end tags by nesting level of the name;
2. items (li, td, p, ...) end at the next token of their container that rules them out;
3. inline elements pair inside the innermost container or item. What has no end tag there
   ends with the element around it.

So an end tag never reaches across a container. Where inline elements cross, an element ends with
the one around it, if that ends first, and its own end tag then ends nothing; so every interval nests
in another: what begins inside an element ends no later than it. `clipped_by` tells of an element
that was cut short by whose end tag that happened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domgrove.functions import vocabulary as V
from domgrove.functions.attributes import (
    attribute_map,
    first_of_each_name,
    parse_attributes,
    start_tag,
)
from domgrove.functions.text import collapse, decode_references
from domgrove.functions.tokens import (
    CLOSE,
    END,
    MISC,
    OPAQUE,
    OPEN,
    TEXT,
    VOID,
    explode_tokens,
    token_length,
)

RANKS = sorted(set(V.ITEM_RANK.values()))

# Kinds of rows beside those of the tokens: start of a paired container, and its end tag.
CONTAINER, SCOPE_END = 11, 12

# A place in a page is one number: token position * 2^32 + character offset. It orders like
# the position and knows where the element starts or ends in the source.
_SHIFT = 32
_MASK = (1 << _SHIFT) - 1


def _place(position: Column, offset: Column) -> Column:
    return F.shiftleft(position.cast("bigint"), _SHIFT).bitwiseOR(offset.cast("bigint"))


def _position(place: Column) -> Column:
    return F.shiftright(place, _SHIFT).cast("int")


def _offset(place: Column) -> Column:
    return place.bitwiseAND(F.lit(_MASK)).cast("int")


def _rows(*keys: str) -> W:
    return W.partitionBy("page_id", *keys).orderBy("at")


def _so_far(*keys: str) -> W:
    return _rows(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)


def _before(*keys: str) -> W:
    return _rows(*keys).rowsBetween(W.unboundedPreceding, -1)


def _is(*kinds: int) -> Column:
    return F.expr(f"kind IN ({', '.join(map(str, kinds))})")


def _step(opening: Column, closing: Column) -> Column:
    return F.when(opening, 1).when(closing, -1).otherwise(0)


def open_tags(pages: DataFrame) -> DataFrame:
    """Start tags with their attributes: page_id, node_id, tag, attrs, attr.

    A narrow step without sort or exchange, enough for rules that look at a tag and its attributes
    only. Its node_id is the one `shred` gives.
    """
    tags = explode_tokens(pages).filter(_is(OPEN, VOID, OPAQUE))
    return _with_attributes(
        tags.select("page_id", F.col("pos").alias("node_id"), "tag",
                    F.col("raw").alias("tag_text"))
    ).drop("tag_text")


def _with_attributes(tags: DataFrame) -> DataFrame:
    return (
        tags.withColumn("attrs", parse_attributes(F.col("tag_text")))
        .withColumn("attrs", first_of_each_name(F.col("attrs")))
        .withColumn("attr", attribute_map(F.col("attrs")))
    )


def _tags(pages: DataFrame) -> DataFrame:
    """One row per tag, with the text that follows it as `tail`.

    Text rows go away here, so the windows below move tags and comments only.
    """
    row = W.partitionBy("page_id").orderBy("pos")
    opaque_text = F.regexp_extract("raw", r"(?s)^<[^>]*>(.*?)(?:</[^>]*>)?$", 1)
    is_comment = F.col("raw").startswith("<!--")
    comment = F.regexp_extract("raw", r"(?s)^<!--(?:-?>|(.*?)(?:--!?>)?$)", 1)
    rank = F.coalesce(*[
        F.when(V.is_one_of([t for t, r in V.ITEM_RANK.items() if r == rank]), rank)
        for rank in RANKS
    ])
    return (
        explode_tokens(pages)
        .withColumn("len", token_length(F.col("raw")))
        .select(
            "page_id", "pos", "tag", "kind", "raw", "len",
            F.sum("len").over(row.rowsBetween(W.unboundedPreceding, -1)).alias("off"),
            F.when(F.lead("kind").over(row) == TEXT, F.lead("raw").over(row)).alias("tail"),
        )
        .filter((F.col("kind") < TEXT) | (F.col("kind") == END) | F.col("tail").isNotNull() | is_comment)
        .filter(F.col("kind") != TEXT)
        .select(
            "page_id", _place(F.col("pos"), F.coalesce("off", F.lit(0))).alias("at"),
            "kind", "len", "tag", F.when(_is(OPEN, CLOSE), rank).alias("rank"),
            F.when(_is(OPEN, VOID, OPAQUE), start_tag(F.col("raw"))).alias("tag_text"),
            F.when(_is(OPAQUE) & ~V.is_one_of(V.SCRIPT_LIKE), opaque_text).when(_is(MISC) & is_comment, comment).alias("text"),
            "tail",
        )
    )


def _pair_containers(tags: DataFrame) -> DataFrame:
    """Pair start and end tags of containers by nesting level of the name."""
    is_container = V.is_one_of(V.CONTAINERS) & _is(OPEN, CLOSE)
    key = F.when(is_container,
                 F.when(V.is_one_of(V.HEADINGS), "heading").otherwise(F.col("tag")))
    has_key = F.col("key").isNotNull()
    opening, closing = has_key & _is(OPEN), has_key & _is(CLOSE)
    level = F.sum(_step(opening, closing)).over(_so_far("key")) + closing.cast("int")
    by_level = _rows("key", "level")
    kind = (
        F.when(opening & (F.lead("kind").over(by_level) == CLOSE), CONTAINER)
        .when(closing & (F.lag("kind").over(by_level) == OPEN), SCOPE_END)
        .when(closing, MISC)
        .otherwise(F.col("kind"))
    )
    return (
        tags.withColumn("key", key)
        .withColumn("level", level)
        .withColumn("kind", kind)
        .filter(~_is(MISC) | F.col("tail").isNotNull() | F.col("text").isNotNull())
        .drop("key", "level")
    )


def _scope_by_container(tags: DataFrame) -> DataFrame:
    """Give every tag the container it stands in (-1: none).

    A start tag also stands at the head of its own scope, so that what follows can find it;
    an end tag stands in the scope it closes, and once more behind it if text follows.
    """
    here = F.col("depth")
    opening, closing = _is(CONTAINER), _is(SCOPE_END)

    def place(level: Column, kind, tail=F.col("tail")) -> Column:
        kind = F.lit(kind) if isinstance(kind, int) else kind
        return F.struct(level.alias("level"), kind.alias("kind"), tail.alias("tail"))

    head_of_scope = 0
    places = (
        F.when(opening, F.array(place(here - 1, CONTAINER), place(here, head_of_scope)))
        .when(closing & F.col("tail").isNull(), F.array(place(here + 1, SCOPE_END)))
        .when(closing, F.array(place(here + 1, SCOPE_END, F.lit(None).cast("string")),
                               place(here, MISC)))
        .otherwise(F.array(place(here, F.col("kind"))))
    )
    scope = F.last(F.when(_is(head_of_scope), F.col("at")), ignorenulls=True).over(_so_far("level"))
    return (
        tags.withColumn("depth", F.sum(_step(opening, closing)).over(_so_far()))
        .select("page_id", "at", "len", "tag", "rank", "tag_text", "text",
                F.explode(places).alias("place"))
        .select("page_id", "at", "len", "tag", "rank", "tag_text", "text", "place.*")
        .withColumn("scope", F.when(F.col("level") == 0, -1).otherwise(scope))
        .filter(~_is(head_of_scope))
        .drop("level")
    )


def _end_items(tags: DataFrame) -> DataFrame:
    """End of every item, and for every tag the innermost container or item around it."""
    backwards = W.partitionBy("page_id", "scope").orderBy(F.desc("at"))
    following = backwards.rowsBetween(W.unboundedPreceding, -1)
    is_item = _is(OPEN) & F.col("rank").isNotNull()
    starts = _is(OPEN, CONTAINER, VOID, OPAQUE)
    shows_text = F.col("tail").rlike(r"[^\s\p{Z}]")

    def closes(rank: int) -> Column:
        hit = _is(SCOPE_END, END) | (_is(OPEN, CLOSE) & (F.col("rank") <= rank))
        if rank == V.PARAGRAPH_RANK:
            hit = hit | (starts & V.is_one_of(V.ENDS_PARAGRAPH))
        if rank == V.HEAD_RANK:
            hit = hit | (starts & ~V.is_one_of([*V.HEAD_CONTENT, "head"]))
        return hit

    end = F.coalesce(*[
        F.when(F.col("rank") == rank,
               F.min(F.when(closes(rank), F.col("at"))).over(following))
        for rank in RANKS
    ])
    latest = [
        F.last(F.when(is_item & (F.col("rank") == rank),
                      F.struct(F.col("at").alias("id"), F.col("end").alias("end"))),
               ignorenulls=True).over(_before("scope"))
        for rank in RANKS
    ]
    around = F.coalesce(
        F.greatest(*[F.when(item["end"] > F.col("at"), item) for item in latest]),
        F.struct(F.col("scope").alias("id"), F.col("scope_end").alias("end")),
    )
    ended = F.coalesce(*[
        F.when((F.col("rank") == rank) & (item["end"] == F.col("at")), item["id"])
        for rank, item in zip(RANKS, latest)
    ])
    return (
        tags.withColumns({
            "end": F.when(is_item, end),
            "scope_end": F.max("at").over(
                backwards.rowsBetween(W.unboundedPreceding, W.currentRow)),
        })
        .withColumns({
            "block": around,
            "ends": F.when(_is(SCOPE_END), F.col("scope")).when(_is(CLOSE), ended),
        })
        .select("page_id", "at", "len", "tag", "tag_text", "text", "tail", "end", "ends",
                F.when(_is(CLOSE) & F.col("rank").isNotNull(), MISC).otherwise(F.col("kind"))
                .alias("kind"),
                F.col("block.id").alias("block"), F.col("block.end").alias("block_end"))
        .filter(~_is(MISC) | F.col("tail").isNotNull() | F.col("ends").isNotNull() | F.col("text").isNotNull())
    )


#: Of all pages that a task shreds: so many characters of html and so many "<", of which a tag has one
#: or two. A tag takes a row of some hundred bytes in each of the sorts of a shred.
SHARE_CHARS, SHARE_TAGS = 8_000_000, 200_000

#: Rows of a block that are folded at a time: what a fold carries is copied for every row.
CHUNK = 512


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once. Spark copies both, so they are to be small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _nest_inline(marks: Column) -> Column:
    """For each row of a block, in document order: parent, end and clipped_by of an inline element.

    marks has `at`, `stop` (where an element's own end tag is, or the end of the block; null for rows
    that are no inline elements with content) and `is_paired` (it is its own end tag).

    A fold carries the elements that are open: id, end, and the element whose end tag is that end.
    Every element ends with the one around it if not before, so what is open ends from the inside
    out, and what has ended by a row stands at the top. Results of a chunk of rows are carried, too,
    and put behind those of the chunks before; so a row costs what is open there and one chunk.
    """
    longs = F.array().cast("array<bigint>")
    empty = F.struct(*[longs.alias(c) for c in ("ids", "ends", "by", "out")])

    def look(state: Column, mark: Column) -> Column:
        """How many elements are still open, and what the row makes of the innermost."""
        ends, stop = state["ends"], mark["stop"]
        n_open = F.when(F.try_element_at(ends, F.lit(-1)) > mark["at"], F.size(ends)).otherwise(
            F.size(F.filter(ends, lambda end: end > mark["at"])))

        def told(n: Column) -> Column:
            limit = F.get(ends, n - 1)
            is_cut = F.coalesce(limit < stop, F.lit(False))
            return F.struct(
                n.alias("n"), F.get(state["ids"], n - 1).alias("parent"),
                F.when(stop.isNotNull(), F.least(stop, limit)).alias("end"),
                F.when(is_cut, F.get(state["by"], n - 1)).otherwise(mark["at"]).alias("by"),
                (is_cut & mark["is_paired"]).alias("is_clipped"), mark["at"].alias("at"))

        return _let(n_open, told)

    def move(state: Column, seen: Column) -> Column:
        def stacked(name: str, value: str) -> Column:
            left = F.when(seen["n"] == F.size(state[name]), state[name]).otherwise(F.slice(state[name], F.lit(1), seen["n"]))
            return F.when(seen["end"].isNotNull(), F.array_append(left, seen[value])).otherwise(left).alias(name)

        found = F.array(seen["parent"], seen["end"], F.when(seen["is_clipped"], seen["by"]))
        return F.struct(stacked("ids", "at"), stacked("ends", "end"), stacked("by", "by"),
                        F.concat(state["out"], found).alias("out"))

    def fold(state: Column, chunk: Column) -> Column:
        fresh = F.struct(state["ids"].alias("ids"), state["ends"].alias("ends"), state["by"].alias("by"), longs.alias("out"))
        return F.aggregate(
            chunk, fresh, lambda now, mark: F.aggregate(F.array(look(now, mark)), now, move),
            lambda now: F.struct(now["ids"].alias("ids"), now["ends"].alias("ends"), now["by"].alias("by"),
                                 F.concat(state["out"], now["out"]).alias("out")))

    def rows(state: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(state["out"]) - 3, F.lit(3))
        return F.transform(at, lambda i: F.struct(*[
            F.get(state["out"], i + k).alias(name) for k, name in enumerate(("parent", "end", "clipped_by"))]))

    starts = F.sequence(F.lit(1), F.size(marks), F.lit(CHUNK))
    return F.aggregate(F.transform(starts, lambda at: F.slice(marks, at, F.lit(CHUNK))), empty, fold, rows)


def _end_inline(tags: DataFrame) -> DataFrame:
    """Ends of the other elements, and the parent of every element and text.

    Start and end tags of one name pair by nesting level in their block. Then each block is folded
    in document order, see `_nest_inline`: an element ends at its own end tag, or before it with the
    element around it. The end tag of an element that has ended so ends nothing.
    """
    has_key = F.col("key").isNotNull()
    opening, closing = has_key & _is(OPEN), has_key & _is(CLOSE)
    level = F.sum(_step(opening, closing)).over(_so_far("block", "key")) + closing.cast("int")
    by_level = _rows("block", "key", "level")
    is_paired = opening & (F.lead("kind").over(by_level) == CLOSE)
    own_end = F.when(F.col("is_paired"), F.lead("at").over(by_level))
    own_len = F.when(F.col("is_paired"), F.lead("len").over(by_level))

    # Elements with content whose end is not known yet: of the others the end is, or follows from the tag.
    stop = F.when(_is(OPEN) & F.col("end").isNull(), F.coalesce("own_end", "block_end"))
    carried = ["at", "kind", "len", "tag", "tag_text", "text", "tail", "end", "ends", "own_end", "own_len"]
    folded = F.zip_with("rows", _nest_inline(F.col("marks")), lambda row, found: F.struct(
        row.alias("row"), found.alias("found")))
    end = (
        F.when(F.col("row.end").isNotNull(), F.col("row.end"))
        .when(F.expr(f"row.kind IN ({VOID}, {OPAQUE})"), F.col("row.at") + F.col("row.len"))
        .when(F.col("row.own_end") == F.col("found.end"), F.col("row.own_end") + F.col("row.own_len"))
        .otherwise(F.col("found.end"))
    )
    return (
        tags.withColumn("key", F.when(_is(OPEN, CLOSE) & F.col("end").isNull(), F.col("tag")))
        .withColumn("level", level)
        .withColumn("is_paired", F.coalesce(is_paired, F.lit(False)))
        .withColumns({"own_end": own_end, "own_len": own_len})
        .filter(~_is(CLOSE) | F.col("tail").isNotNull())
        .withColumn("stop", stop)
        .groupBy("page_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct(*carried))).alias("rows"),
             F.sort_array(F.collect_list(F.struct("at", "stop", "is_paired"))).alias("marks"))
        # The outer form: for the inner one Spark would add a filter that folds once more.
        .select("page_id", "block", F.explode_outer(folded).alias("pair"))
        .select("page_id", "block", "pair.*")
        .select("page_id", "row.at", "row.kind", "row.len", "row.tag", "row.tag_text", "row.text", "row.tail",
                F.coalesce("found.parent", "block").alias("parent"), end.alias("end"), "row.ends",
                F.when(F.col("row.own_end") > F.col("found.end"), F.col("found.clipped_by")).alias("clipped_by"))
    )


def _gather(tags: DataFrame) -> DataFrame:
    """One row per element, with the pieces of text that stand directly in it."""
    empty = {
        "node": "bigint", "parent": "bigint", "head": "struct<tag:string,tag_text:string>",
        "end": "bigint", "clipped_by": "bigint", "piece": "struct<at:bigint,is_break:boolean,text:string>",
        "comment": "struct<pos:int,text:string>",
    }

    def role(**fields: Column) -> Column:
        return F.struct(*[
            fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in empty.items()])

    def piece(text: Column) -> Column:
        return F.struct("at", F.coalesce(F.col("tag") == "br", F.lit(False)), text)

    at, parent = F.col("at"), F.col("parent")
    head = F.struct("tag", "tag_text")
    inner = F.coalesce("text", F.when(_is(OPEN, CONTAINER), F.col("tail")))
    comment = F.when(_is(MISC) & F.col("text").isNotNull(), F.struct(_position(at), "text"))
    is_element = _is(OPEN, CONTAINER, VOID, OPAQUE)
    follows = ~_is(OPEN, CONTAINER) & (F.col("tail").isNotNull() | (F.col("tag") == "br"))
    roles = F.array_compact(F.array(
        F.when(is_element, role(node=at, parent=parent, head=head, end=F.col("end"), clipped_by=F.col("clipped_by"),
                                piece=F.when(inner.isNotNull(), piece(inner)))),
        # Text behind a tag belongs to the element around it; so does a line break.
        F.when(follows, role(node=parent, piece=piece(F.col("tail")))),
        F.when(comment.isNotNull(), role(node=parent, comment=comment)),
        # An end tag is part of the element it ends.
        F.when(F.col("ends").isNotNull(), role(node=F.col("ends"), end=at + F.col("len"))),
    ))
    return (
        tags.select("page_id", F.explode(roles).alias("role"))
        .select("page_id", "role.*")
        .groupBy("page_id", "node")
        .agg(
            F.max("parent").alias("parent"),
            F.first("head", ignorenulls=True).alias("head"),
            F.max("end").alias("end"),
            F.max("clipped_by").alias("clipped_by"),
            F.sort_array(F.collect_list("piece")).alias("pieces"),
            F.sort_array(F.collect_list("comment")).alias("comments"),
        )
        .filter("head IS NOT NULL")
        .select(
            "page_id", _position(F.col("node")).alias("node_id"),
            _position(F.col("end")).alias("end_pos"),
            F.when(F.col("parent") >= 0, _position(F.col("parent"))).alias("parent_id"),
            "head.tag", "head.tag_text", _offset(F.col("node")).alias("off"),
            (_offset(F.col("end")) - _offset(F.col("node"))).alias("len"), "pieces",
            _position(F.col("clipped_by")).alias("clipped_by"), "comments",
        )
    )


def _with_depth(nodes: DataFrame) -> DataFrame:
    """Depth of every element: starts before it minus ends before it, one running sum."""
    def event(at: str, step: int) -> Column:
        return F.struct(F.col(at).alias("event_at"), F.lit(step).alias("step"))

    # A void element starts and ends at one place: it holds nothing and needs no end.
    events = F.when(F.col("end_pos") > F.col("node_id"),
                    F.array(event("node_id", 1), event("end_pos", -1))
                    ).otherwise(F.array(event("node_id", 0)))
    running = F.sum("step").over(
        W.partitionBy("page_id").orderBy("event_at", "step")
        .rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        nodes.select("*", F.explode(events).alias("event")).select("*", "event.*")
        .withColumn("depth", (running - F.col("step")).cast("int"))
        .filter("step >= 0")
        .drop("event", "event_at", "step")
    )


def partitions_for(pages: DataFrame) -> int | None:
    """Into how many parts pages are to be dealt, so that the memory of a task does not grow with their
    number: as many as SHARE_CHARS and SHARE_TAGS ask for, and one for each core if the session has that
    many. None where one is enough: then the session's number will do, whatever Spark makes of it.

    Pages are read for that, in a job of its own. Their sizes on disk would not tell: html that repeats
    takes little there.
    """
    html = F.col("html")
    chars, tags = pages.agg(
        F.sum(F.length(html)), F.sum(F.length(html) - F.length(F.replace(html, F.lit("<"), F.lit(""))))).first()
    needed = max(-(-(chars or 0) // SHARE_CHARS), -(-(tags or 0) // SHARE_TAGS))
    spark = pages.sparkSession
    cores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(needed, cores) if needed > 1 else None


def shred(pages: DataFrame, partitions: int | None = None, clustered: bool = False) -> DataFrame:
    """One row per element of every page; see the README for the columns.

    `pages` needs page_id (unique: see split_pages), and html (not null). They are moved once, to
    `partitions` or as many as `partitions_for` finds. `clustered` tells that they come from a table
    bucketed by page_id: then they are worked on where they are.
    """
    pages = pages.select("page_id", "html")
    if clustered:
        spread = pages
    else:
        # With a number given, Spark does not put parts together again by what they take when packed.
        spread = pages.repartition(*[n for n in [partitions or partitions_for(pages)] if n], "page_id")
    return elements(blocks(spread))


def blocks(pages: DataFrame) -> DataFrame:
    """The first half of a shred: tags with the container or item they stand in. Nothing is moved."""
    return _end_items(_scope_by_container(_pair_containers(_tags(pages.select("page_id", "html")))))


def elements(tags: DataFrame) -> DataFrame:
    """The second half of a shred: the node table from what `blocks` gives."""
    found = _gather(_end_inline(tags))
    siblings = W.partitionBy("page_id", "parent_id")
    same_tag = W.partitionBy("page_id", "parent_id", "tag")
    decoded = F.transform("pieces", lambda p: F.struct(
        _position(p["at"]).alias("pos"), p["is_break"].alias("is_break"),
        F.when(V.is_one_of(V.RAW_TEXT), p["text"])
        .otherwise(decode_references(p["text"])).alias("text")))
    texts = F.filter(
        F.transform("pieces", lambda p: F.struct(p["pos"].alias("pos"),
                                                 collapse(p["text"]).alias("text"))),
        lambda t: t["text"] != "")
    joined = F.array_join(F.transform("pieces", lambda p: F.concat(
        F.when(p["is_break"], " ").otherwise(""), F.coalesce(p["text"], F.lit("")))), "")
    # Most elements have one text or none.
    own_text = (
        F.when(F.size("pieces") > 1, collapse(joined))
        .when(F.size("texts") == 1, F.col("texts")[0]["text"])
        .otherwise("")
    )
    return (
        _with_attributes(
            _with_depth(found)
            .withColumns({
                "sib_pos": F.row_number().over(siblings.orderBy("node_id")),
                "sib_count": F.count(F.lit(1)).over(siblings).cast("int"),
            })
            .withColumns({
                "tag_pos": F.row_number().over(same_tag.orderBy("node_id")),
                "tag_count": F.count(F.lit(1)).over(same_tag).cast("int"),
            })
            .withColumn("pieces", decoded)
            .withColumn("texts", texts)
            .withColumn("own_text", own_text)
        )
        .select("page_id", "node_id", "end_pos", "parent_id", "depth", "tag", "attrs", "attr",
                "texts", "own_text", "sib_pos", "sib_count", "tag_pos", "tag_count", "off", "len", "clipped_by", "comments")
    )
