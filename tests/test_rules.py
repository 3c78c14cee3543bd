"""Steps, conditions and emitters on small pages."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from domgrove.operators import conditions as C
from domgrove.operators.selection import Selection
from domgrove.operators.shred import shred
from domgrove.plans.rules import PRESETS, Rule, Step, rule, rules_from_table, run_rules

SHELF = """<section id="shelf" lang="en"><h3>Two books</h3>
<ol class="rows odd"><li><em>7</em> <a title="Seven" href="/book/7?x">Blue book</a>
<li><a href="/book/9" title="Nine">Red book</a></ol></section>"""
MIXED = """<div class=row>1</div><p id=a class="x y">two</p><div class='row' id=b>3</div>
<div class="hidden item">4<span>s</span>tail <i>i</i> end</div><p>it's and more</p><p> </p>"""
DEEP = "<div id=1><div id=2><p>a</p><div id=3><p>b</p></div></div><p>c</p></div><p>d</p>"
LAZY = """<img data-original=/a.jpg src=x alt=A title=T><img DATA-SRC='/b.jpg'>
<h1 title="">head</h1>text<!-- c --><b>bold</b>"""
LINKS = """<a href="x">1</a><a href="/y?q#z">2</a><a href="//o.example/p">3</a>
<a href="https://abs.example/">4</a><a href="#top">5</a><a href="">6</a><a>7</a>
<a href="?k=v">8</a><a href="../up/./file">9</a><a href="mailto:me@x.example">10</a>"""
BASED = '<base href="/root/"><a href="x">1</a>'
PAGES = [SHELF, MIXED, DEEP, LAZY, LINKS, BASED]
SHELF_, MIXED_, DEEP_, LAZY_, LINKS_, BASED_ = range(6)


@pytest.fixture(scope="module")
def pages(make_pages):
    return make_pages(PAGES)


@pytest.fixture(scope="module")
def nodes(pages):
    return shred(pages, 4).persist()


@pytest.fixture(scope="module")
def start(nodes, pages):
    return Selection(nodes, pages)


def values(df, page):
    rows = sorted(df.filter(df.page_id == page).collect(), key=lambda r: r.idx)
    assert [r.idx for r in rows] == list(range(1, len(rows) + 1))
    return [r.value for r in rows]


def own(selection, page):
    return values(selection.normalized_text(), page)


def ids(selection, page):
    return values(selection.attr("id"), page)


def test_shelf_rules(start):
    links = start.descendant("a")
    assert values(links.attr("href"), SHELF_) == ["/book/7?x", "/book/9"]
    assert values(links.attr("title"), SHELF_) == ["Seven", "Nine"]
    assert values(links.text(), SHELF_) == ["Blue book", "Red book"]
    last = start.descendant("ol").child("li").where(C.last())
    assert values(last.full_text(), SHELF_) == ["Red book"]
    inside = start.descendant("section").where(C.eq("lang", "en")).descendant("a")
    assert values(inside.attr("href"), SHELF_) == ["/book/7?x", "/book/9"]
    assert values(links.count(), SHELF_) == ["2"]
    assert values(links.where(C.starts_with("href", "/shelf")).attr("href"), SHELF_) == []
    assert values(links.html(), SHELF_)[0] == '<a title="Seven" href="/book/7?x">Blue book</a>'
    assert values(links.where(C.text_eq("Red book")).attr("href"), SHELF_) == ["/book/9"]


def test_steps(start):
    assert values(start.child("html").child("body").child("section").attr("id"), SHELF_) == ["shelf"]
    assert values(start.child("body").attr("id"), SHELF_) == []
    assert ids(start.step("descendant", "DIV"), DEEP_) == ["1", "2", "3"]
    assert ids(start.step("descendant", "svg:div").step("self"), DEEP_) == ["1", "2", "3"]
    # strictly below, at any depth, each once
    assert ids(start.descendant("div").descendant("div"), DEEP_) == ["2", "3"]
    assert ids(start.descendant("div").descendant("*").where(C.has("id")), DEEP_) == ["2", "3"]
    assert own(start.descendant("div").descendant("p"), DEEP_) == ["a", "b", "c"]
    assert own(start.descendant("div").child("div").descendant("p"), DEEP_) == ["a", "b"]
    assert ids(start.descendant("p").parent(), DEEP_) == ["", "1", "2", "3"]
    assert own(start.descendant("li").parent().parent().descendant("a"), SHELF_) == [
        "Blue book", "Red book"]
    twice = start.descendant("li").parent(keep_duplicates=True)
    assert values(twice.attr("class"), SHELF_) == ["rows odd", "rows odd"]
    assert own(twice.descendant("a"), SHELF_) == ["Blue book", "Red book"]
    assert values(start.descendant("br").count(), DEEP_) == ["0"]
    # tests for other kinds of nodes are known and select no element
    assert start.descendant("div").child("comment()").nodes().isEmpty()
    assert start.descendant("div").child("node()").nodes().isEmpty()
    with pytest.raises(ValueError):
        start.step("following", "div")


@pytest.mark.parametrize("condition, expected", [
    (lambda: C.nth(1), ["1"]), (lambda: C.nth(2), []), (lambda: C.nth(3), ["3"]),
    (lambda: C.nth(0), []), (lambda: C.nth(2, of="tag"), ["3"]),
    (lambda: C.last(), []), (lambda: C.last(of="tag"), ["4tail end"]),
    (lambda: C.pos(), ["1", "3", "4tail end"]), (lambda: C.pos("=", 1), ["1"]),
    (lambda: C.pos("!=", 1), ["3", "4tail end"]), (lambda: C.pos("<", 3), ["1"]),
    (lambda: C.pos(">", 3), ["4tail end"]), (lambda: C.pos("<=", 3), ["1", "3"]),
    (lambda: C.pos(">=", 3), ["3", "4tail end"]),
    (lambda: C.has("id"), ["3"]), (lambda: C.eq("class", "row"), ["1", "3"]),
    (lambda: C.eq("title", ""), ["1", "3", "4tail end"]),
    (lambda: C.ne("id", "b"), ["1", "4tail end"]),
    (lambda: C.contains("class", "id"), ["4tail end"]),
    (lambda: C.contains("class", ""), ["1", "3", "4tail end"]),
    (lambda: C.starts_with("class", "ro"), ["1", "3"]),
    (lambda: C.starts_with("class", "ow"), []),
    (lambda: C.text_eq("4tail end"), ["4tail end"]), (lambda: C.text_contains("tail"), ["4tail end"]),
    (lambda: C.has_text(), ["1", "3", "4tail end"]),
    (lambda: C.all_of(C.eq("class", "row"), C.eq("id", "b")), ["3"]),
    (lambda: C.any_of(C.eq("id", "b"), C.nth(1)), ["1", "3"]),
    (lambda: C.negate(C.has("id")), ["1", "4tail end"]),
    (lambda: C.negate(C.contains("class", "hidden")), ["1", "3"]),
    (lambda: (C.eq("class", "row") & ~C.has("id")) | C.text_contains("4"), ["1", "4tail end"]),
    (lambda: "attr['class'] = 'row' AND sib_pos > 1", ["3"]),
])
def test_conditions(nodes, condition, expected):
    found = nodes.filter((F.col("page_id") == MIXED_) & (F.col("tag") == "div"))
    expected_pages = [r.own_text for r in found.filter(condition()).orderBy("node_id").collect()]
    assert expected_pages == expected


def test_conditions_see_unchanged_positions(start):
    divs = start.descendant("div")
    assert own(divs.where(C.eq("class", "row"), C.nth(3)), MIXED_) == ["3"]
    assert own(divs.where(C.eq("class", "row")).where(C.nth(2)), MIXED_) == []
    assert own(start.descendant("p").where(C.text_eq("it's and more")), MIXED_) == ["it's and more"]


def test_wrong_conditions(start):
    with pytest.raises(TypeError):
        start.descendant("a").where(True)
    with pytest.raises(AnalysisException):
        start.descendant("a").where("no_such_thing(href)")
    with pytest.raises(ValueError):
        C.pos("~", 1)
    with pytest.raises(ValueError):
        C.nth(1, of="class")
    with pytest.raises(ValueError):
        start.descendant("a").values("nonsense")


def test_emitters(start):
    div = start.descendant("div").where(C.has("class"))
    assert values(div.where(C.nth(4)).text(), MIXED_) == ["4", "tail", "end"]
    assert own(div.where(C.nth(4)), MIXED_) == ["4 tail end"]
    assert own(start.descendant("p"), MIXED_) == ["two", "it's and more", ""]
    assert values(start.descendant("p").text(), MIXED_) == ["two", "it's and more"]
    assert values(start.descendant("p").attrs(), MIXED_) == ["id=a", "class=x y"]
    assert values(start.descendant("p").attr("ID"), MIXED_) == ["a", "", ""]
    assert values(div.full_text(), MIXED_) == ["1", "3", "4stail i end"]
    assert values(start.descendant("div").where(C.eq("id", "2")).html(), DEEP_) == [
        "<div id=2><p>a</p><div id=3><p>b</p></div></div>"]
    assert values(start.descendant("div").where(C.eq("id", "1")).full_text(), DEEP_) == ["a b c"]


def test_absolute_links(start):
    links = start.descendant("a").abs_attr("href")
    assert values(links, LINKS_) == [
        "https://site.example/dir/x", "https://site.example/y?q#z", "https://o.example/p",
        "https://abs.example/", "https://site.example/dir/page.html?x=1#top",
        "https://site.example/dir/page.html?x=1#f", "", "https://site.example/dir/page.html?k=v",
        "https://site.example/up/file", "mailto:me@x.example"]
    assert values(links, BASED_) == ["https://site.example/root/x"]


def test_presets(pages, nodes):
    for given in (nodes, None):
        rules = {n: r for n, r in PRESETS.items() if given is not None or n != "text()"}
        found = run_rules(pages, rules, given)
        by_rule = {name: values(found.filter(F.col("rule") == name).drop("rule"), LAZY_)
                   for name in rules}
        assert by_rule["@title"] == ["T", ""]
        assert by_rule["@data-original"] == ["/a.jpg"]
        assert by_rule["@data-src"] == ["/b.jpg"]
        assert by_rule["@href"] == []
        if given is not None:
            assert by_rule["text()"] == ["text", "head", "bold"]


def test_rule_sets(spark, pages, nodes):
    rules = {
        "links": rule([("descendant", "a")], "attr:href"),
        "rows": rule([("descendant", "div", C.eq("class", "row"), C.nth(3))], "text"),
        "nested": Rule((Step("descendant", "div"), Step("child", "p")), "html"),
        "up": rule([("descendant", "p"), ("..",)], "attr:id"),
        "n": rule([("descendant", "p")], "count"),
    }
    rows = run_rules(pages, rules, nodes).collect()
    got = {(r.page_id, r.rule, r.idx): r.value for r in rows}
    assert len(got) == len(rows)
    assert got[SHELF_, "links", 2] == "/book/9"
    assert got[MIXED_, "rows", 1] == "3"
    assert [got[DEEP_, "nested", i] for i in (1, 2, 3)] == ["<p>a</p>", "<p>b</p>", "<p>c</p>"]
    assert [got[DEEP_, "up", i] for i in (1, 2, 3, 4)] == ["", "1", "2", "3"]
    assert [got[p, "n", 1] for p in range(6)] == ["0", "3", "4", "0", "0", "0"]
    with pytest.raises(ValueError, match="need the node table"):
        run_rules(pages, rules)
    with pytest.raises(ValueError, match="blank"):
        run_rules(pages, {" ": rules["links"]}, nodes)
    with pytest.raises(ValueError, match="blank"):
        run_rules(pages, {"x": Rule()}, nodes)

    table = spark.createDataFrame(
        [("links", [("descendant", "a", "")], "attr:href"),
         ("rows", [("descendant", "div", "attr['class'] = 'row' AND sib_pos = 3")], "text")],
        "rule string, steps array<struct<axis:string,test:string,where:string>>, emit string")
    stored = {(r.page_id, r.rule, r.idx): r.value
              for r in run_rules(pages, rules_from_table(table), nodes).collect()}
    assert stored == {k: v for k, v in got.items() if k[1] in ("links", "rows")}


def test_descendants_against_brute_force(spark):
    nodes = shred(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), 4).persist()
    rows = nodes.select("page_id", "node_id", "end_pos", "tag").collect()
    for context, test in [("article", "*"), ("p", "br"), ("html", "li"), ("*", "b")]:
        start = [r for r in rows if context in ("*", r.tag)]
        expected = {(r.page_id, r.node_id) for r in rows if test in ("*", r.tag) and any(
            c.page_id == r.page_id and c.node_id < r.node_id < c.end_pos for c in start)}
        found = Selection(nodes).descendant(context).descendant(test).nodes().collect()
        assert len(found) == len(expected)
        assert {(r.page_id, r.node_id) for r in found} == expected
    nodes.unpersist()


def drawn_rules(n, seed):
    """Paths that share their beginnings, over all axes, conditions and emitters."""
    draw = random.Random(seed)
    columns = [C.nth(1), C.has("class"), C.last()]
    emits = ["attr:class", "text", "attrs", "normalized_text", "html", "full_text", "count", "abs:href"]
    out = {}
    for i in range(n):
        steps = [Step(*draw.choice([("descendant", "div"), ("child", "html"), ("descendant", "*"), ("self", "*", ("tag = 'html'",))]))]
        for _ in range(draw.randrange(0, 4)):
            where = draw.choice([(), (), ("sib_pos < 3",), ("attr['class'] = 'row'",), (draw.choice(columns),), ("depth > 2", columns[0])])
            steps.append(Step(draw.choice(["child", "descendant", "..", "self", "child"]), draw.choice(["*", "p", "x:DIV", "a", "body"]), where))
        out[f"r'{i}"] = Rule(tuple(steps), draw.choice(emits))
    return out


def test_rule_tree_equals_single_rules(pages, nodes):
    rules = drawn_rules(70, 3)
    found = {}
    for r in run_rules(pages, rules, nodes).collect():
        found.setdefault(r.rule, []).append((r.page_id, r.idx, r.value))
    hits = 0
    for name, item in rules.items():
        expected = sorted(tuple(r) for r in item.on(Selection(nodes, pages)).collect())
        assert sorted(found.get(name, [])) == expected, (name, item)
        hits += bool(expected)
    assert hits > 25


def test_thousand_rules_plan_as_one(spark, pages, nodes):
    """Whatever the number of rules: one join for all values, and windows by level of the tree."""
    def plan(n):
        rules = {f"r{i}": Rule((Step("descendant", "div"), Step("child", "p", (f"sib_pos = {i % 100}",)),
                                Step("descendant", "*", (f"depth > {i // 100}",))), ["text", "attr:class"][i % 2]) for i in range(n)}
        return run_rules(pages, rules, spark.table("tree_nodes"))._jdf.queryExecution().executedPlan().toString()

    nodes.createOrReplaceTempView("tree_nodes")
    few, many = plan(8), plan(1000)
    for node in ("Join", "Window ", "Exchange", "FileScan"):
        assert few.count(node) == many.count(node)
    assert many.count("Join") <= 1 + few.count("InMemoryTableScan")
