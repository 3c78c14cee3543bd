"""Golden trees of small pages: one page per behaviour, all shredded in one job."""

import random

import pytest

from domgrove.operators import shred as shredding
from domgrove.operators.shred import open_tags, partitions_for, shred
from domgrove.plans.reports import clipped, nesting

# name: (page, expected tree below body or html as nested text)
PAGES = {
    "closed": ("<div><p>a</p><p>b</p></div>", "div(p(a) p(b))"),
    "open_p": ("<p>a<p>b", "p(a) p(b)"),
    "p_ended_by_block": ("<p>a<div>b</div>c", "p(a) div(b) c"),
    "p_not_reopened": ("<p>a<p>b</p>c</p>d", "p(a) p(b) c d"),
    "hr_ends_p": ("<p>a<hr>b", "p(a) hr b"),
    "inline_keeps_p": ("<p>a<b>c</b>d</p>e", "p(a b(c) d) e"),
    "open_b": ("<p><b>x<br>y<p>z</p>", "p(b(x br y)) p(z)"),
    "list": ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "ul(li(a) li(b ul(li(c))) li(d)) e"),
    "half_closed_list": ("<ul><li>a<ul><li>b</ul></li>t<li>c</ul>",
                         "ul(li(a ul(li(b))) t li(c))"),
    "open_div_in_item": ("<ul><li><div>a<li>b</ul>", "ul(li(div(a)) li(b))"),
    "definitions": ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "dl(dt(a) dd(b) dt(c) dd(d))"),
    "table": ("<table><thead><tr><th>h<tbody><tr><td>a<td>b<tr><td>c</table>e",
              "table(thead(tr(th(h))) tbody(tr(td(a) td(b)) tr(td(c)))) e"),
    "nested_table": ("<table><tr><td><table><tr><td>a</table>b</td><td>c</table>",
                     "table(tr(td(table(tr(td(a))) b) td(c)))"),
    "item_in_cell": ("<table><tr><td><li>a<li>b</td><td>c</table>",
                     "table(tr(td(li(a) li(b)) td(c)))"),
    "options": ("<select><optgroup><option>a<option>b<optgroup><option>c</select>",
                "select(optgroup(option(a) option(b)) optgroup(option(c)))"),
    "stray_end": ("<div>a</b></p></li>b</div></div>c", "div(a b) c"),
    "crossing_inline": ("<p><b><i>x</b>y</i>z", "p(b(i(x)) y z)"),
    "crossing_three": ("<p><b><i><u>x</b></i></u>y", "p(b(i(u(x))) y)"),
    "crossing_chain": ("<p><a>1<b>2</a>3<i>4</b>5<u>6</i>7</u>8</p>", "p(a(1 b(2)) 3 i(4 5 u(6)) 7 8)"),
    "crossing_deep": ("<em>b<q>c<s>d</em>e<u>f</s>g</q>h", "em(b q(c s(d))) e u(f g h)"),
    "crossing_inside": ("<span>1<b>2<i>3</b>4</i>5</span>6", "span(1 b(2 i(3)) 4 5) 6"),
    "crossing_same": ("<b>1<b>2<i>3</b>4</i>5</b>6", "b(1 b(2 i(3)) 4 5) 6"),
    "crossing_ended": ("<b>1<i>2<b>3</i>4</b>5", "b(1 i(2 b(3)) 4 5)"),
    "crossing_twice": ("<b>1<i>2</b>3</i>4<i>5<b>6</i>7</b>8", "b(1 i(2)) 3 4 i(5 b(6)) 7 8"),
    "crossing_loose": ("<b>1<i>2<u>3</b>4</i>5", "b(1 i(2 u(3))) 4 5"),
    "crossing_blocks": ("<div><section>a</div>b</section>c", "div(section(a) b) c"),
    "end_tag_beyond_block": ("<div><b>a</div><div>b</b>c</div>", "div(b(a)) div(b c)"),
    "inline_around_block": ("<a><div>x</div>y</a>z", "a(div(x) y) z"),
    "loose_in_pair": ("<span><a>1<b>2</a>3</span>4", "span(a(1 b(2)) 3) 4"),
    "headings": ("<h1>a</h2>b", "h1(a) b"),
    "cut_page": ("<div><ul><li>a<li>b", "div(ul(li(a) li(b)))"),
    "cut_in_tag": ("<p>a<a href='x", "p(a)"),
    "void": ("a<img src=x>b<br/>c<input>", "a img b br c input"),
    "self_closed": ("<div/>a<x-y/>b<svg:rect/>", "div(a x-y b svg:rect)"),
    "script": ("a<script>if (a<b) '</p><p>'</script>x<style>p>a{}</style>", "a script x style"),
    "open_script": ("a<script>x<p>", "a script"),
    "textarea": ("<textarea><b>x</b></textarea>y", "textarea(<b>x</b>) y"),
    "comments": ("a<!-- <p> -->b<!--x-->c<!-->d<!-- open <p>e", "a b c d"),
    "declarations": ("a<?php x ?>b</3 x>c<!x>d", "a b c d"),
    "lone_less": ("1 < 2 << 3 <= 4 <", "1 < 2 << 3 <= 4 <"),
    "references": ("&lt;b&gt; &amp;lt; &#65;&#x42;&#128512;&#150; &nbsp;&eacute;&eacute &copy &zz; &",
                   "<b> &lt; AB😀– éé © &zz; &"),
    "blanks": ("<p>  a \n\t b  </p> <p> </p>", "p(a b) p"),
    "quotes_in_tag": ("<a title='>' alt=\"'>\">x</a>", "a(x)"),
    "upper": ("<DIV><P>a</p></Div>", "div(p(a))"),
    "text": ("just text", "just text"),
    "empty": ("", ""),
}
WHOLE = {
    "implied": ("<title>t</title>x", "html(head(title(t)) body(x))"),
    "implied_head": ("<html><body>x</body></html>", "html(head body(x))"),
    "open_head": ("<!DOCTYPE html><html><head><title>t</title><body>x</body></html>",
                  "html(head(title(t)) body(x))"),
    "implied_body": ("<html><head><title>t</title></head><p>x</html>",
                     "html(head(title(t)) body(p(x)))"),
    "late_html": ("<p>a<html><body class=c>b", "html(head body(p(a b)))"),
    "head_content_first": ("<meta a=b><head><link></head><div>x</div>",
                           "html(head(meta link) body(div(x)))"),
    "nothing": ("", "html(head body)"),
}


@pytest.fixture(scope="module")
def trees(spark, make_pages):
    named = {**PAGES, **WHOLE}
    nodes = shred(make_pages([page for page, _ in named.values()]), 4).collect()
    by_page = {}
    for row in nodes:
        by_page.setdefault(row.page_id, []).append(row)
    return {name: sorted(by_page[i], key=lambda r: r.node_id) for i, name in enumerate(named)}


def draw(rows, node):
    parts = [(r.node_id, r.tag, r) for r in rows if r.parent_id == node.node_id]
    parts += [(t.pos + 0.5, t.text, None) for t in node.texts]
    inside = " ".join(draw(rows, r) if r is not None else label
                      for _, label, r in sorted(parts, key=lambda p: p[0]))
    return f"{node.tag}({inside})" if inside else node.tag


@pytest.mark.parametrize("name", PAGES)
def test_tree_in_body(trees, name):
    rows = trees[name]
    body = next(r for r in rows if r.tag == "body")
    drawn = draw(rows, body)
    assert drawn == (f"body({PAGES[name][1]})" if PAGES[name][1] else "body")


def test_clipped(spark, make_pages):
    """What another element's end tag cut short, and by which; what has no end tag is not cut short."""
    html = ["<p><a>1<b>2</a>3<i>4</b>5<u>6</i>7</u>8</p>", "<em>b<q>c<s>d</em>e<u>f</s>g</q>h", "<b>1<i>2<u>3</b>4</i>",
            "<b>1<i>2</i>3", "<q><s><i>x</i></q></s>"]
    nodes = shred(make_pages(html), 2)
    tags = {(r.page_id, r.node_id): r.tag for r in nodes.collect()}
    found = {(r.page_id, r.tag, r.clipped_by_tag) for r in clipped(nodes).collect()}
    assert found == {(0, "b", "a"), (0, "u", "i"), (1, "q", "em"), (1, "s", "em"), (2, "i", "b"), (4, "s", "q")}
    assert all(tags[r.page_id, r.clipped_by] == r.clipped_by_tag for r in clipped(nodes).collect())
    assert {r.page_id: r.n_crossing for r in nesting(nodes).collect()} == {0: 2, 1: 2, 2: 1, 3: 0, 4: 1}


def stack_tree(tokens):
    """Intervals of inline elements in one block by the plain method: pairs by level, then a stack."""
    level, pairs, opens = {}, {}, {}
    for at, t in enumerate(tokens):
        if t.startswith("</"):
            stack = opens.get(t[2:-1])
            if stack:
                pairs[stack.pop()] = at
        elif t.startswith("<"):
            opens.setdefault(t[1:-1], []).append(at)
    ends, stack = {}, []
    for at, t in enumerate(tokens):
        while stack and ends[stack[-1]] <= at:
            stack.pop()
        if t.startswith("<") and not t.startswith("</"):
            around = stack[-1] if stack else None
            ends[at] = min(pairs.get(at, len(tokens)), ends[around] if stack else len(tokens))
            level[at] = around
            stack.append(at)
    return level, ends


def test_inline_against_a_stack(spark, make_pages):
    draw = random.Random(11)
    pages = []
    for i in range(400):
        tokens = draw.choices(["<b>", "</b>", "<i>", "</i>", "<u>", "</u>", "x"], k=draw.randrange(1, 60))
        pages.append([t if t != "x" else f"x{k}" for k, t in enumerate(tokens) if t != "x" or k == 0 or tokens[k - 1] != "x"])
    rows = shred(make_pages(["<p>" + "".join(p) for p in pages]), 2).collect()
    for i, tokens in enumerate(pages):
        own = {r.node_id: r for r in rows if r.page_id == i}
        base = next(r.node_id for r in own.values() if r.tag == "p") + 1
        parents, ends = stack_tree(tokens)
        assert {at + base for at in parents} == {n for n in own if n >= base}
        for at, parent in parents.items():
            assert own[at + base].parent_id == base + (-1 if parent is None else parent)
            assert own[at + base].end_pos == base + ends[at]


def test_many_crossing_elements(spark, make_pages, monkeypatch):
    """Thousands that cross in one paragraph, side by side and inside each other, in short chunks too."""
    n = 3000
    pages = ["<p>" + "<b>x<i>y</b></i>" * n, "<p>" + "<b>x" * 700 + "<i>y" * 700 + "</b>" * 700 + "</i>" * 700]
    nodes = shred(make_pages(pages), 2).persist()
    assert {r.page_id: (r.n_elements, r.n_crossing) for r in nesting(nodes).collect()} == {
        0: (4 + 2 * n, n), 1: (4 + 1400, 700)}
    assert nodes.filter("page_id = 0 AND tag = 'b' AND parent_id <> 3").count() == 0
    monkeypatch.setattr("domgrove.operators.shred.CHUNK", 7)
    again = shred(make_pages(pages), 2)
    assert sorted(map(str, again.collect())) == sorted(map(str, nodes.collect()))
    nodes.unpersist()


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tree(trees, name):
    rows = trees[name]
    assert draw(rows, rows[0]) == WHOLE[name][1]


@pytest.mark.parametrize("name", {**PAGES, **WHOLE})
def test_intervals_nest(trees, name):
    rows = {r.node_id: r for r in trees[name]}
    html = {**PAGES, **WHOLE}[name][0]
    for row in rows.values():
        assert row.end_pos >= row.node_id
        assert 0 <= row.off and row.off + row.len <= len(html)
        if row.parent_id is None:
            assert row.tag == "html" and row.depth == 0
            continue
        parent = rows[row.parent_id]
        assert parent.node_id < row.node_id and row.end_pos <= parent.end_pos
        assert row.depth == parent.depth + 1
        family = [r for r in rows.values() if r.parent_id == row.parent_id]
        assert sorted(r.sib_pos for r in family) == list(range(1, len(family) + 1))
        same = [r for r in family if r.tag == row.tag]
        assert sorted(r.tag_pos for r in same) == list(range(1, len(same) + 1))
        assert row.sib_count == len(family) and row.tag_count == len(same)


def test_source_slices(trees):
    def sources(name):
        html = PAGES[name][0]
        return [html[r.off:r.off + r.len] for r in trees[name] if r.depth > 1]
    assert sources("list")[:3] == [
        "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<li>a", "<li>b<ul><li>c</ul>"]
    assert sources("open_b")[:3] == ["<p><b>x<br>y", "<b>x<br>y", "<br>"]
    assert sources("crossing_inline") == ["<p><b><i>x</b>y</i>z", "<b><i>x</b>", "<i>x"]


def test_own_text(spark, make_pages):
    pages = ["<p>Hello<b>x</b>there <i>y</i> you</p>", "<p>a<br>b</p>", "<p>a&shy;b&#8203;c</p>"]
    rows = shred(make_pages(pages), 2).filter("tag = 'p'").orderBy("page_id").collect()
    assert [r.own_text for r in rows] == ["Hellothere you", "a b", "abc"]
    assert [[t.text for t in r.texts] for r in rows] == [
        ["Hello", "there", "you"], ["a", "b"], ["abc"]]


ATTRIBUTES = [
    ("<a x=\"1\" y='2' z=3 w>", [("x", "1"), ("y", "2"), ("z", "3"), ("w", "")]),
    ("<a x = \"1 > 0\"\n\ty= '\"'>", [("x", "1 > 0"), ("y", '"')]),
    ("<a x=1 X=2 y=3 x=4>", [("x", "1"), ("y", "3")]),
    ("<a DATA-X=Q title=it's/>", [("data-x", "Q"), ("title", "it's/")]),
    ("<a href='?a=1&copy=2&amp;b=3&lt;'>", [("href", "?a=1&copy=2&b=3<")]),
    ("<img/src=x/>", [("src", "x/")]),
    ("<a x=''>", [("x", "")]),
    ("<a>", []),
]


def test_attributes(spark, make_pages):
    pages = make_pages([page for page, _ in ATTRIBUTES])
    for rows in (open_tags(pages), shred(pages, 2)):
        found = rows.filter("tag IN ('a', 'img')").orderBy("page_id").collect()
        assert [[(a.name, a.value) for a in r.attrs] for r in found] == [e for _, e in ATTRIBUTES]
        assert all(r.attr == {a.name: a.value for a in r.attrs} for r in found)


def test_open_tags_agree_with_tree(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    light = open_tags(pages).select("page_id", "node_id", "tag", "attrs")
    full = shred(pages, 4).select("page_id", "node_id", "tag", "attrs")
    assert light.exceptAll(full).isEmpty() and full.exceptAll(light).isEmpty()


def test_large_input(spark, make_pages):
    """Input that makes careless patterns recurse or backtrack."""
    pages = make_pages([
        "<!--" + "x" * 2_000_000 + "--><p>a",
        "<p title=\"" + "y" * 2_000_000 + "\">a",
        "<" * 100_000 + "p>a",
        "<p " + " ".join(f"a{i}={i}" for i in range(1500)) + ">a",
        "<p x=" + "z" * 100_000 + ">a",
        "<a " * 50_000,
        "".join(f"<b id={i}>" for i in range(3000)),
    ])
    rows = {r.page_id: r for r in shred(pages, 4).groupBy("page_id").agg(
        {"node_id": "count", "depth": "max"}).collect()}
    assert [rows[i]["count(node_id)"] for i in range(7)] == [4, 4, 4, 4, 4, 3, 3003]
    assert rows[6]["max(depth)"] == 3001


MIXES = {
    "all": ["div", "p", "b", "i", "ul", "li", "table", "tr", "td", "a", "h1", "h2", "span", "dl",
            "dd", "select", "option", "section"],
    "inline": ["b", "i", "u", "a", "em", "q", "s", "span"],
    "inline_in_blocks": ["b", "i", "u", "a", "em", "p", "div", "li"],
}


@pytest.mark.parametrize("mix", MIXES)
def test_random_markup_nests(spark, make_pages, mix):
    """Any mix of tags gives a tree: every element lies inside its parent, text in its element."""
    random.seed(7)
    tags = MIXES[mix]
    pages = ["".join(random.choice([f"<{t}>", f"</{t}>", "x", " "])
                     for t in random.choices(tags, k=60)) for _ in range(300)]
    nodes = shred(make_pages(pages), 4)
    rows = nodes.collect()
    index = {(r.page_id, r.node_id): r for r in rows}
    starts = sum(page.count(f"<{t}>") for page in pages for t in tags)
    assert len(rows) == starts + 3 * len(pages)
    for row in rows:
        if row.parent_id is not None:
            parent = index[row.page_id, row.parent_id]
            assert parent.node_id < row.node_id and row.end_pos <= parent.end_pos
            assert row.depth == parent.depth + 1
        else:
            assert row.tag == "html"
    assert sum(r.n_crossing for r in nesting(nodes).collect()) == clipped(nodes).count()
    text = sum(len(t.text.replace(" ", "")) for r in rows for t in r.texts)
    assert text == sum(page.count("x") for page in pages)
    # The source of an element holds as many letters as it and the elements below it have as text.
    total = {}
    for row in sorted(rows, key=lambda r: -r.node_id):
        key = (row.page_id, row.node_id)
        total[key] = total.get(key, 0) + sum(len(t.text.replace(" ", "")) for t in row.texts)
        if row.parent_id is not None:
            up = (row.page_id, row.parent_id)
            total[up] = total.get(up, 0) + total[key]
        assert pages[row.page_id][row.off:row.off + row.len].count("x") == total[key]


def test_tasks_take_so_many_tags_at_most(make_pages, monkeypatch):
    # Once Spark put parts together by what they take when packed: these pages pack to next to nothing.
    pages = make_pages([f"<p>{k}" + "<b>x</b><i>y" * 50 for k in range(60)])
    assert partitions_for(pages) is None and partitions_for(make_pages([""])) is None
    whole = sorted(map(str, shred(pages).drop("attr").collect()))
    chars, tags = (sum(part(r.html) for r in pages.collect()) for part in (len, lambda html: html.count("<")))
    for share, total in (("SHARE_TAGS", tags), ("SHARE_CHARS", chars)):
        with monkeypatch.context() as patch:
            patch.setattr(shredding, share, total // 20)
            assert partitions_for(pages) in (20, 21)
            nodes = shred(pages)
            assert nodes.rdd.getNumPartitions() == partitions_for(pages)
            assert sorted(map(str, nodes.drop("attr").collect())) == whole
            # At least one for each core.
            patch.setattr(shredding, share, total - 1)
            assert partitions_for(pages) == 4
