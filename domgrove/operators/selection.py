"""Location steps and emitters over the node table.

A selection is the set of elements a path has reached. Steps down are windows over one pass, steps
up equi-joins on (page_id, node); every emitter returns page_id, idx (1-based, per page, in document
order) and value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domgrove.functions.attributes import attribute
from domgrove.functions.links import resolve_link
from domgrove.functions.markup import full_text


def number(values: DataFrame, *keys: str) -> DataFrame:
    """Give values a running number from their place: node, then position inside the node."""
    order = W.partitionBy("page_id", *keys).orderBy("node_id", "item")
    return values.select("page_id", *keys, F.row_number().over(order).alias("idx"), "value")


def tag_test(test: str) -> Column:
    """Condition for a tag of this name in any case; a prefix such as svg: is not part of it."""
    return F.lit(True) if test == "*" else F.col("tag") == test.rsplit(":", 1)[-1].lower()


class Selection:
    """Elements reached by a path; without steps, the page roots.

    Child and descendant steps are kept until the elements are asked for, and are then taken one after
    the other in one pass over the node table: a node table that is not saved is shredded once for them.
    """

    def __init__(self, nodes: DataFrame, pages: DataFrame | None = None,
                 picked: DataFrame | None = None, repeats: bool = False,
                 path: tuple[tuple[str, Column], ...] = ()):
        self._nodes = nodes
        self._pages = pages
        self._picked = picked
        self._repeats = repeats
        # Steps from the roots, or from `picked`: axis, and what an element is to meet.
        self._path = path

    def _on(self, path: tuple[tuple[str, Column], ...]) -> Selection:
        return Selection(self._nodes, self._pages, self._picked, self._repeats, path)

    def nodes(self) -> DataFrame:
        """The selected rows of the node table."""
        if self._path:
            return self._walk().filter("is_in").select(self._nodes.columns)
        return self._nodes.filter("parent_id IS NULL") if self._picked is None else self._picked

    # -- steps ---------------------------------------------------------------------------

    def child(self, test: str = "*") -> Selection | Comments:
        if test == "comment()":
            is_start = not self._path and self._picked is None
            return Comments(self.nodes().filter("false") if is_start else self.nodes())
        return self._on((*self._path, ("child", tag_test(test))))

    def descendant(self, test: str = "*") -> Selection | Comments:
        """Elements at any depth below the selected ones."""
        if test == "comment()":
            if not self._path and self._picked is None:
                return Comments(self._nodes)
            # The elements themselves and what is below them, each once.
            return Comments(self._on((*self._path, ("descendant_or_self", F.lit(True)))).nodes())
        return self._on((*self._path, ("descendant", tag_test(test))))

    def _walk(self, also: Column | None = None) -> DataFrame:
        """The steps of the path: rows of the node table with is_in, and with is_also where `also` is
        given, for elements that are to come along. Other rows go as soon as no step looks at them.

        All conditions are decided in one pass; then every step is a window over the rows of a page,
        which stay where they are.
        """
        steps, rows = list(self._path), self._nodes
        if self._picked is None:
            axis, is_in = steps.pop(0)
            # All elements are below the roots of the pages, which themselves stand below nothing.
            is_in = is_in & F.col("parent_id").isNull() if axis == "child" else is_in
        else:
            ids = self._picked.select("page_id", "node_id")
            ids = (ids.distinct() if self._repeats else ids).withColumn("is_start", F.lit(True))
            rows, is_in = rows.join(ids, ["page_id", "node_id"], "left"), F.col("is_start")
        asked = {"is_in": is_in, **{f"meets_{i}": condition for i, (_, condition) in enumerate(steps)}}
        if also is not None:
            asked["is_also"] = also
        rows = rows.filter(reduce(lambda a, b: a | b, asked.values())).withColumns(
            {name: F.coalesce(condition, F.lit(False)) for name, condition in asked.items()})
        for i, (axis, _) in enumerate(steps):
            later = [name for name in asked if name not in ["is_in", *(f"meets_{k}" for k in range(i + 1))]]
            take = _children if axis == "child" else _descendants
            rows = take(rows, f"meets_{i}", later, axis == "descendant_or_self")
        return rows

    def parent(self, keep_duplicates: bool = False) -> Selection:
        children = self.nodes().filter("parent_id IS NOT NULL").select(
            "page_id", F.col("parent_id").alias("node_id"))
        how = "inner" if keep_duplicates else "left_semi"
        return Selection(self._nodes, self._pages, self._nodes.join(children, ["page_id", "node_id"], how),
                         keep_duplicates)

    def self_(self) -> Selection:
        return self

    def step(self, axis: str, test: str = "*") -> Selection:
        """A step by name: child, descendant, parent (..) or self (.)."""
        if axis == "child":
            return self.child(test)
        if axis == "descendant":
            return self.descendant(test)
        if axis in ("parent", ".."):
            return self.parent()
        if axis in ("self", "."):
            return self.self_()
        raise ValueError(f"unknown axis {axis!r}")

    def where(self, *conditions: Column | str) -> Selection:
        """Keep elements that meet all conditions: Columns over the node table, or Spark SQL."""
        found = self
        for condition in conditions:
            if not isinstance(condition, (Column, str)):
                raise TypeError(f"not a condition: {condition!r}")
            column = F.expr(condition) if isinstance(condition, str) else condition
            found = found._where(column)
        return found

    def _where(self, column: Column) -> Selection:
        picked = (self._nodes if self._picked is None else self._picked).filter(column)  # tells what is not understood
        if self._path:
            *before, (axis, condition) = self._path
            return self._on((*before, (axis, condition & column)))
        if self._picked is None:
            return self._on((("child", column),))
        return Selection(self._nodes, self._pages, picked, self._repeats)

    # -- emitters ------------------------------------------------------------------------

    def values(self, emit: str) -> DataFrame:
        """Values with their place, not numbered: page_id, node_id, item, value."""
        if emit in ("html", "full_text"):
            return self._markup(full_text if emit == "full_text" else lambda markup: markup)
        if emit == "count":
            return self._counts()
        if emit.startswith("abs:"):
            return self._links(emit.removeprefix("abs:"))
        return self.nodes().select(
            "page_id", "node_id", F.posexplode(values_of(emit)).alias("item", "value"))

    def attr(self, name: str) -> DataFrame:
        """One value per element, the empty string where the attribute is missing."""
        return number(self.values(f"attr:{name}"))

    def attrs(self) -> DataFrame:
        """``name=value`` for every attribute."""
        return number(self.values("attrs"))

    def text(self) -> DataFrame:
        """Every text directly in an element, trimmed, without empty ones."""
        return number(self.values("text"))

    def normalized_text(self) -> DataFrame:
        """The texts directly in an element as one string, also when empty."""
        return number(self.values("normalized_text"))

    def html(self) -> DataFrame:
        """The source of every element, exactly as on the page."""
        return number(self.values("html"))

    def full_text(self) -> DataFrame:
        """The text of an element and all below it."""
        return number(self.values("full_text"))

    def abs_attr(self, name: str) -> DataFrame:
        """An attribute as absolute address, against the base of the page."""
        return number(self.values(f"abs:{name}"))

    def count(self) -> DataFrame:
        """Number of elements for every page, zero included."""
        return number(self.values("count"))

    def _page_column(self, name: str) -> DataFrame:
        if self._pages is None:
            raise ValueError(f"this needs {name} of the pages: Selection(nodes, pages)")
        return self._pages.select("page_id", name)

    def _markup(self, shape) -> DataFrame:
        slice_ = F.substr("html", F.col("off") + 1, F.col("len"))
        picked = self.nodes().select("page_id", "node_id", "off", "len")
        return picked.join(self._page_column("html"), "page_id").select(
            "page_id", "node_id", F.lit(0).alias("item"), shape(slice_).alias("value"))

    def _counts(self) -> DataFrame:
        # Every page has exactly one root row, so the roots stand for the pages.
        roots = self._nodes.filter("parent_id IS NULL").select("page_id", "node_id")
        counted = self.nodes().groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
        return roots.join(counted, "page_id", "left").select(
            "page_id", "node_id", F.lit(0).alias("item"),
            F.coalesce("n", F.lit(0)).cast("string").alias("value"))

    def _links(self, name: str) -> DataFrame:
        is_base = (F.col("tag") == "base") & F.map_contains_key("attr", "href")
        url, base = F.col("url"), F.col("base_href")
        address = F.when(F.coalesce(base, F.lit("")) == "", url).otherwise(resolve_link(url, base))
        link = [attribute(name).alias("link"), F.map_contains_key("attr", name.lower()).alias("present")]
        if self._path:
            # Elements that name a base come along; the address of a page is worked out where they are.
            by_page = W.partitionBy("page_id")
            first = F.min_by("address", F.when(F.col("is_also"), F.col("node_id"))).over(by_page)
            placed = (
                self._walk(is_base).select("page_id", "node_id", "is_in", "is_also", attribute("href").alias("base_href"), *link)
                .join(self._page_column("url"), "page_id")
                .withColumn("address", F.when(F.col("is_also"), address))
                .withColumn("base", F.coalesce(first, url))
                .filter("is_in")
            )
        else:
            bases = self._nodes.filter(is_base).groupBy("page_id").agg(
                F.min_by(attribute("href"), "node_id").alias("base_href"))
            # The address of a page is worked out once per page, not once per link.
            addresses = (self._page_column("url").join(bases, "page_id", "left")
                         .select("page_id", address.alias("base")))
            placed = self.nodes().select("page_id", "node_id", *link).join(addresses, "page_id")
        value = F.when(F.col("present"), resolve_link(F.col("base"), F.col("link"))).otherwise("")
        return placed.select("page_id", "node_id", F.lit(0).alias("item"), value.alias("value"))


def _any(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, map(F.col, names))


def _children(rows: DataFrame, meets: str, later: list[str], _: bool) -> DataFrame:
    """is_in of elements that meet a condition and whose parent is in: elements that are in stand at
    the head of their children, and the others among those of their parent."""
    places = F.array_compact(F.array(
        F.when(F.col("is_in"), F.struct(F.col("node_id").alias("family"), F.lit(True).alias("is_head"))),
        F.when(_any([meets, *later]), F.struct(F.col("parent_id").alias("family"), F.lit(False).alias("is_head")))))
    below = F.max("is_head").over(W.partitionBy("page_id", "family"))
    return (
        rows.select("*", F.explode(places).alias("place")).select("*", "place.*")
        .withColumn("is_in", F.col(meets) & below)
        .filter(~F.col("is_head") & _any(["is_in", *later]))
        .drop("place", "family", "is_head", meets)
    )


def _descendants(rows: DataFrame, meets: str, later: list[str], or_self: bool) -> DataFrame:
    """is_in of elements that meet a condition and lie below one that is in, or are in themselves.

    Starts (+1) and ends (-1) of the elements that are in are merged with the candidates in
    document order; a candidate with a positive running sum before it lies inside one.
    """
    is_context = F.col("is_in") & (F.col("end_pos") > F.col("node_id"))

    def event(when: Column, at: str, step: int) -> Column:
        return F.when(when, F.struct(F.col(at).alias("at"), F.lit(step).alias("step")))

    events = F.array_compact(F.array(
        event(_any([meets, *later]), "node_id", 0), event(is_context, "node_id", 1),
        event(is_context, "end_pos", -1)))
    # At one place ends come first and starts last: nothing is below itself.
    inside = F.sum("step").over(
        W.partitionBy("page_id").orderBy("at", "step")
        .rowsBetween(W.unboundedPreceding, W.currentRow)) > 0
    return (
        rows.select("*", F.explode(events).alias("event")).select("*", "event.*")
        .withColumn("is_in", F.col(meets) & (inside | F.col("is_in") if or_self else inside))
        .filter((F.col("step") == 0) & _any(["is_in", *later]))
        .drop("event", "at", "step", meets)
    )


class Comments:
    """Comments directly in some elements, each a node with a place and a parent."""

    def __init__(self, holders: DataFrame):
        self._holders = holders

    def nodes(self) -> DataFrame:
        """page_id, node_id (the place of the comment), parent_id, value."""
        return self._holders.select("page_id", F.col("node_id").alias("parent_id"), F.explode("comments").alias("comment")).select(
            "page_id", F.col("comment.pos").alias("node_id"), "parent_id", F.col("comment.text").alias("value"))

    def text(self) -> DataFrame:
        """What stands in every comment, as it is on the page, in document order."""
        return number(self.nodes().withColumn("item", F.lit(0)))


def values_of(emit: str) -> Column:
    """What an element emits by itself, as an array of strings."""
    if emit.startswith("attr:"):
        return F.array(attribute(emit.removeprefix("attr:")))
    if emit == "attrs":
        return F.transform("attrs", lambda a: F.concat_ws("=", a["name"], a["value"]))
    if emit == "comments":
        return F.transform("comments", lambda c: c["text"])
    if emit == "text":
        return F.transform("texts", lambda t: t["text"])
    if emit == "normalized_text":
        joined = F.array_join(F.transform("texts", lambda t: t["text"]), " ")
        return F.array(F.trim(F.regexp_replace(joined, r"\s+", " ")))
    raise ValueError(f"unknown emitter {emit!r}")
