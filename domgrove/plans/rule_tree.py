"""Rule sets as a prefix tree: every step that rules share is taken once.

The steps of all rules are merged into a tree. An element carries the numbers of the tree's nodes
that have reached it. Conditions look at one element alone, so all of them are decided in one pass
over the node table; then the tree is walked level by level, all steps of a level and axis at a time:
children look at their parent and parents at their children in one window, descendants are found by
one running sum of starts and ends. No step joins anything, and rows stay with their page.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domgrove.operators.selection import Selection, tag_test, values_of

ROOT = -1


@dataclass
class Tree:
    """Steps by number: (axis, condition, number of the step before, level); and conditions."""

    steps: list[tuple[str, int, int, int]] = field(default_factory=list)
    conditions: list[Column] = field(default_factory=list)
    _numbers: dict = field(default_factory=dict)

    def _number(self, key, make: Iterable, items: list) -> int:
        if key not in self._numbers:
            self._numbers[key] = len(items)
            items.append(make)
        return self._numbers[key]

    def add(self, steps: Iterable) -> int:
        """The number of a path's last step; ROOT for a path without any."""
        at, level = ROOT, 0
        for step in steps:
            axis = {"..": "parent", ".": "self"}.get(step.axis, step.axis)
            if axis not in ("child", "descendant", "parent", "self"):
                raise ValueError(f"unknown axis {step.axis!r}")
            if axis == "self" and not step.where:
                continue
            test = step.test.rsplit(":", 1)[-1].lower() if axis in ("child", "descendant") else "*"
            # A condition that is a Column is shared where it is the same object.
            where = tuple(c if isinstance(c, str) else id(c) for c in step.where)
            made = tag_test(test)
            for c in step.where:
                made = made & (F.expr(c) if isinstance(c, str) else c)
            condition = self._number(("condition", test, where), made, self.conditions)
            level += 1
            at = self._number(("step", at, axis, condition), (axis, condition, at, level), self.steps)
        return at

    def of(self, level: int, axis: str) -> list[tuple[int, int, int]]:
        """Steps of a level and axis: number, condition, step before."""
        return [(t, k, p) for t, (a, k, p, n) in enumerate(self.steps) if (a, n) == (axis, level)]

    @property
    def depth(self) -> int:
        return max((n for *_, n in self.steps), default=0)


def _table(rows: list, kind: str) -> Column:
    """A constant array: what goes with each number."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


def _taken(tree: Tree, steps: list[tuple[int, int, int]], reached: Column) -> Column:
    """Steps whose condition the element meets, and whose step before is in `reached`."""
    by_condition: list[list[dict[str, int]]] = [[] for _ in tree.conditions]
    for t, k, p in steps:
        by_condition[k].append({"t": t, "p": p})
    table = _table(by_condition, "array<struct<t:int,p:int>>")
    return F.flatten(F.transform("meets", lambda k: F.transform(
        F.filter(F.get(table, k), lambda s: F.array_contains(reached, s["p"])), lambda s: s["t"])))


def _with(rows: DataFrame, taken: Column) -> DataFrame:
    return rows.withColumn("reached", F.array_union("reached", taken))


def _family(rows: DataFrame) -> tuple[DataFrame, W]:
    """Every element twice: as the head of its children, and among those of its parent."""
    places = F.array(F.struct(F.col("node_id").alias("family"), F.lit(True).alias("is_head")),
                     F.struct(F.col("parent_id").alias("family"), F.lit(False).alias("is_head")))
    return (rows.select("*", F.explode(places).alias("place")).select("*", "place.*").drop("place"),
            W.partitionBy("page_id", "family"))


def _children(rows: DataFrame, tree: Tree, steps: list) -> DataFrame:
    twice, family = _family(rows)
    told = twice.withColumn("above", F.max(F.when(F.col("is_head"), F.col("reached"))).over(family)).filter("NOT is_head")
    return _with(told, _taken(tree, steps, F.coalesce("above", F.array().cast("array<int>")))).drop("above", "family", "is_head")


def _parents(rows: DataFrame, tree: Tree, steps: list) -> DataFrame:
    twice, family = _family(rows)
    befores = sorted({p for _, _, p in steps})
    below = F.array_compact(F.array(*[
        F.when(F.max(F.when(~F.col("is_head"), F.array_contains("reached", p))).over(family), F.lit(p)) for p in befores]))
    told = twice.withColumn("below", below).filter("is_head")
    return _with(told, _taken(tree, steps, F.col("below"))).drop("below", "family", "is_head")


def _descendants(rows: DataFrame, tree: Tree, steps: list) -> DataFrame:
    befores = sorted({p for _, _, p in steps})

    def event(p: int, at: str, step: int) -> Column:
        return F.struct(F.lit(p).alias("p"), F.col(at).alias("at"), F.lit(step).alias("step"))

    events = [event(ROOT, "node_id", 0)]  # every element once
    for p in befores:
        wanted = F.arrays_overlap("meets", F.array(*[F.lit(k) for _, k, q in steps if q == p]))
        is_context = F.array_contains("reached", p) & (F.col("end_pos") > F.col("node_id"))
        events += [F.when(wanted, event(p, "node_id", 0)), F.when(is_context, event(p, "node_id", 1)),
                   F.when(is_context, event(p, "end_pos", -1))]
    # At one place ends come first and starts last: nothing is below itself.
    inside = F.sum("step").over(W.partitionBy("page_id", "p").orderBy("at", "step").rowsBetween(W.unboundedPreceding, W.currentRow))
    told = (rows.select("*", F.explode(F.array_compact(F.array(*events))).alias("event")).select("*", "event.*")
            .withColumn("inside", inside).filter("step = 0")
            .groupBy("page_id", "node_id").agg(
                *[F.first(c).alias(c) for c in ("parent_id", "end_pos", "meets", "reached")],
                F.collect_set(F.when(F.col("inside") > 0, F.col("p"))).alias("around")))
    return _with(told, _taken(tree, steps, F.col("around"))).drop("around")


def reached(nodes: DataFrame, tree: Tree) -> DataFrame:
    """page_id, node_id, parent_id and `reached`, the steps of the tree that end at an element; rows
    for elements that meet no condition are left out, except for the roots of pages."""
    meets = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(tree.conditions)]))
    rows = nodes.select("page_id", "node_id", "parent_id", "end_pos", meets.alias("meets")).filter(
        (F.size("meets") > 0) | F.col("parent_id").isNull())
    is_root = F.col("parent_id").isNull()
    root = F.array(F.lit(ROOT))
    none = F.array().cast("array<int>")
    first = [F.when(is_root, _taken(tree, tree.of(1, a), root)).otherwise(none) for a in ("child", "self")]
    rows = rows.withColumn("reached", F.array_distinct(F.concat(*first, _taken(tree, tree.of(1, "descendant"), root))))
    for level in range(2, tree.depth + 1):
        for axis, take in (("child", _children), ("parent", _parents), ("descendant", _descendants)):
            steps = tree.of(level, axis)
            if steps:
                rows = take(rows, tree, steps)
        steps = tree.of(level, "self")
        if steps:
            rows = _with(rows, _taken(tree, steps, F.col("reached")))
    return rows.drop("meets", "end_pos")


def _hits(rules: str, values: Column) -> Column:
    """Each value of an element for each of the rules that end at it."""
    return F.flatten(F.transform(rules, lambda rule: F.transform(
        values, lambda value, item: F.struct(rule.alias("rule"), item.alias("item"), value.alias("value")))))


def run_tree(pages: DataFrame, nodes: DataFrame, rules: Mapping) -> list[DataFrame]:
    """Values of rules, page_id, node_id, rule, item, value: one frame for each kind of emitter."""
    tree = Tree()
    ends = {name: tree.add(item.steps) for name, item in rules.items()}
    found = reached(nodes, tree)
    kinds: dict[str, dict[str, dict[int, list[str]]]] = {}
    for name, item in rules.items():
        kind = item.emit if item.emit in ("html", "full_text", "count") else "abs" if item.emit.startswith("abs:") else "own"
        kinds.setdefault(kind, {}).setdefault(item.emit, {}).setdefault(ends[name], []).append(name)

    def named(names: dict[int, list[str]]) -> Column:
        """The rules of one emitter that end at an element."""
        # Steps are counted from 0; a path without steps ends at the roots.
        table = _table([names.get(t, []) for t in range(ROOT, len(tree.steps))], "array<string>")
        ended = F.when(F.col("parent_id").isNull(), F.concat(F.col("reached"), F.array(F.lit(ROOT)))).otherwise(F.col("reached"))
        return F.flatten(F.transform(ended, lambda t: F.get(table, t + 1)))

    parts = []
    for kind, emits in kinds.items():
        if kind == "count":
            parts.append(_counts(found, named(emits["count"]), [n for own in emits["count"].values() for n in own]))
            continue
        asked = found.select("page_id", "node_id", *[named(names).alias(f"rules_{i}") for i, names in enumerate(emits.values())])
        some = F.greatest(*[F.size(f"rules_{i}") for i in range(len(emits))], F.lit(0)) > 0
        asked = asked.filter(some)
        if kind == "own":
            hits = [_hits(f"rules_{i}", values_of(emit)) for i, emit in enumerate(emits)]
            parts.append(nodes.join(asked, ["page_id", "node_id"]).select("page_id", "node_id", F.explode(F.concat(*hits)).alias("hit"))
                         .select("page_id", "node_id", "hit.*"))
            continue
        for i, emit in enumerate(emits):
            own = asked.filter(F.size(f"rules_{i}") > 0).select("page_id", "node_id", F.col(f"rules_{i}").alias("rules"))
            picked = nodes.join(own.select("page_id", "node_id"), ["page_id", "node_id"], "left_semi")
            values = Selection(nodes, pages, picked).values(emit)
            parts.append(values.join(own, ["page_id", "node_id"]).select(
                "page_id", "node_id", F.explode("rules").alias("rule"), "item", "value"))
    return parts


def _counts(found: DataFrame, rules: Column, names: list[str]) -> DataFrame:
    """Numbers of elements for every page and rule, zero included: every page has a root row."""
    hits = F.explode(F.concat(F.array_distinct(rules), F.when(F.col("parent_id").isNull(), F.array(*[F.lit(n) for n in names]))
                              .otherwise(F.array().cast("array<string>"))))
    is_root = F.col("parent_id").isNull()
    counted = (found.select("page_id", "node_id", is_root.alias("is_root"), rules.alias("own"), hits.alias("rule"))
               .select("page_id", "node_id", "is_root", "rule", F.array_contains("own", F.col("rule")).alias("is_hit")).distinct()
               .groupBy("page_id", "rule").agg(F.min(F.when(F.col("is_root"), F.col("node_id"))).alias("node_id"),
                                               F.count(F.when(F.col("is_hit"), 1)).alias("n")))
    return counted.select("page_id", "node_id", "rule", F.lit(0).alias("item"), F.col("n").cast("string").alias("value"))
