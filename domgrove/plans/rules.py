"""Rule sets: many rules over many pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domgrove.operators.selection import Selection, number, tag_test, values_of
from domgrove.operators.shred import open_tags
from domgrove.plans.rule_tree import run_tree


@dataclass(frozen=True)
class Step:
    """One location step with its conditions (Columns or Spark SQL strings)."""

    axis: str
    test: str = "*"
    where: Sequence[Column | str] = ()


@dataclass(frozen=True)
class Rule:
    """A path and what to emit: attr:<name>, abs:<name>, attrs, text, normalized_text, comments,
    html, full_text or count."""

    steps: Sequence[Step] = field(default_factory=tuple)
    emit: str = "html"

    def select(self, start: Selection) -> Selection:
        selection = start
        for step in self.steps:
            selection = selection.step(step.axis, step.test).where(*step.where)
        return selection

    def on(self, start: Selection) -> DataFrame:
        return number(self.select(start).values(self.emit))

    @property
    def one_look(self) -> bool:
        """Whether one look at every element alone answers the rule."""
        local = self.emit.startswith("attr") or self.emit in ("text", "normalized_text", "comments")
        return local and len(self.steps) == 1 and self.steps[0].axis == "descendant"

    def condition(self) -> Column:
        step = self.steps[0]
        return reduce(lambda a, b: a & b, [
            F.expr(c) if isinstance(c, str) else c for c in step.where], tag_test(step.test))


def rule(path: Sequence[tuple], emit: str = "html") -> Rule:
    """`rule([("descendant", "ul"), ("child", "li", nth(1))], "text")`."""
    steps = (Step(axis, *rest[:1], tuple(rest[1:])) if rest else Step(axis) for axis, *rest in path)
    return Rule(tuple(steps), emit)


def _with(name: str) -> str:
    return f"map_contains_key(attr, '{name}')"


# The ready-made rules: titles, links, two kinds of lazily loaded images, all text.
PRESETS: dict[str, Rule] = {
    "@title": rule([("descendant", "*", _with("title"))], "attr:title"),
    "@href": rule([("descendant", "a")], "attr:href"),
    "@data-original": rule([("descendant", "*", _with("data-original"))], "attr:data-original"),
    "@data-src": rule([("descendant", "*", _with("data-src"))], "attr:data-src"),
    "text()": rule([("descendant", "*")], "text"),
}


def rules_from_table(table: DataFrame) -> dict[str, Rule]:
    """Rules kept as rows: rule, steps array<struct<axis,test,where>>, emit.

    `where` is a Spark SQL condition over the node table, or empty. A rule set becomes the plan of
    a job, so it is read to the driver. Rows that make no sense make rules that `check_rules` tells.
    """
    rows = table.select("rule", "steps", "emit").collect()
    return {
        row["rule"] or "": Rule(
            tuple(Step(s["axis"] or "", s["test"] or "", (s["where"],) if s["where"] else ())
                  for s in row["steps"] or () if s),
            row["emit"] or "")
        for row in rows
    }


#: Emitters, and those that are followed by the name of an attribute.
EMITTERS = ("attrs", "text", "normalized_text", "comments", "html", "full_text", "count")
NAMED_EMITTERS = ("attr:", "abs:")
AXES = ("child", "descendant", "parent", "..", "self", ".")


def _problem(nodes: DataFrame, name: str, item: Rule) -> tuple[int | None, str] | None:
    """The step (from 1) that is wrong with a rule, if it is one, and why; None for a good rule."""
    if not name.strip() or not item.steps:
        return None, "blank rule"
    for i, step in enumerate(item.steps, 1):
        if step.axis not in AXES:
            return i, "unknown axis"
        if not step.test.strip():
            return i, "no test"
        for condition in step.where:
            if not isinstance(condition, (Column, str)):
                return i, "not a condition"
            try:
                nodes.filter(F.expr(condition) if isinstance(condition, str) else condition)
            except AnalysisException as error:
                return i, f"condition: {(error.getCondition() or 'not understood').split('.')[0]}"
    if item.emit not in EMITTERS and not any(item.emit.startswith(e) and len(item.emit) > len(e) for e in NAMED_EMITTERS):
        return None, "unknown emitter"
    return None


def check_rules(nodes: DataFrame, rules: Mapping[str, Rule]) -> tuple[dict[str, Rule], DataFrame]:
    """The rules that can be answered from a node table, and (rule, step, reason) of the others.

    Every rule is analysed by itself, without running anything, so one that makes no sense takes no
    other along. step counts from 1 and is null where the whole rule is wrong.
    """
    problems = {name: _problem(nodes, name, item) for name, item in rules.items()}
    rows = [(name, *problem) for name, problem in problems.items() if problem]
    errors = nodes.sparkSession.createDataFrame(rows, "rule string, step int, reason string")
    return {name: item for name, item in rules.items() if not problems[name]}, errors


def _check(rules: Mapping[str, Rule]) -> None:
    if not rules:
        raise ValueError("no rules")
    for name, item in rules.items():
        if not name.strip() or not item.steps:
            raise ValueError(f"rule {name!r} is blank")


def _one_look(tags: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """All rules that look at single elements, in one pass over the elements."""
    def hits(name: str, item: Rule) -> Column:
        found = F.transform(values_of(item.emit), lambda value, i: F.struct(
            F.lit(name).alias("rule"), i.alias("item"), value.alias("value")))
        return F.when(item.condition(), found).otherwise(
            F.array().cast("array<struct<rule:string,item:int,value:string>>"))

    # The tags asked for are looked up first, so that other elements are not read or parsed.
    wanted = reduce(lambda a, b: a | b, [item.condition() for item in rules.values()])
    every = F.flatten(F.array(*[hits(name, item) for name, item in rules.items()]))
    return tags.filter(wanted).select("page_id", "node_id", F.explode(every).alias("hit")).select(
        "page_id", "node_id", "hit.*")


def _answered_by(tags: DataFrame, item: Rule) -> bool:
    """Whether the columns at hand are enough for a rule; Spark's analysis tells."""
    try:
        tags.filter(item.condition()).select(values_of(item.emit))
        return True
    except AnalysisException:
        return False


def run_rules(pages: DataFrame, rules: Mapping[str, Rule],
              nodes: DataFrame | None = None) -> DataFrame:
    """Results of all rules: page_id, rule, idx, value.

    Rules on single elements share one pass over the elements; the steps of the others are merged
    into a prefix tree and taken once each, see `rule_tree`. Without `nodes` only rules on a tag and its attributes can be answered: they
    read the pages in one narrow pass and need no tree. Else shred once, keep the node table,
    and give it here.
    """
    _check(rules)
    single = {name: item for name, item in rules.items() if item.one_look}
    rest = {name: item for name, item in rules.items() if not item.one_look}
    if nodes is not None:
        elements = nodes
    else:
        elements = open_tags(pages)
        heavy = [*rest, *(n for n, item in single.items() if not _answered_by(elements, item))]
        if heavy:
            raise ValueError(f"these rules need the node table: {sorted(heavy)}")
    parts = [_one_look(elements, single)] if single else []
    if rest:
        parts += run_tree(pages, nodes, rest)
    return number(reduce(DataFrame.unionByName, parts), "rule")
