"""Reports, outline, selectors, search, sources and streaming."""

import re

import pytest
from pyspark.sql import functions as F

from domgrove.functions import reports as R
from domgrove.functions.text import escape_html
from domgrove.operators import conditions as C
from domgrove.operators.outline import outline
from domgrove.operators.search import search
from domgrove.operators.selection import Selection
from domgrove.operators.selectors import selectors
from domgrove.operators.shred import shred
from domgrove.plans.reports import clipped, coverage, enrich, not_found
from domgrove.plans.queries import QUERIES
from domgrove.plans.rules import PRESETS, Rule, Step, check_rules, rule, rules_from_table, run_rules
from domgrove.plans.workspace import pages_of
from domgrove.sources.pages import read_html_files, read_pages, repeated_ids, split_by_ids, split_pages, without_repeated
from domgrove.sources.tables import load_nodes, save_nodes, save_pages, write_results
from domgrove.streaming.run import run_stream, stream_results

RULES = {
    "links": rule([("descendant", "a")], "attr:href"),
    "items": rule([("descendant", "ul"), ("child", "li")], "full_text"),
    "text": PRESETS["text()"],
}


def column_of(spark, make, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_badges(spark):
    values = ["x @href and @data-src, @href", "Text() @a", 'say text="b"', "HREF and Class", "",
              "@a @b @c @d @e @f @g", "title href src data-src data-original alt class id"]
    assert column_of(spark, R.badges, values) == [
        "@href  @data-src", "@a  text()", "text()", "@href  @class", "",
        "@a  @b  @c  @d  @e  @f",
        "@title  @href  @src  @data-src  @data-original  @alt"]


def test_line_estimate(spark):
    values = ["", "x" * 39, "x" * 40, "x" * 81, "a\nb\n\nc", "\n", "a\n"]
    assert column_of(spark, R.line_estimate, values) == [0, 1, 2, 3, 4, 2, 2]
    assert column_of(spark, R.is_long, ["a\nb\nc", "a\nb\nc\nd"]) == [False, True]


def test_looks_like_html(spark):
    values = {"": False, "a": False, "a < b": False, "a < b > c": False, "<b>": True,
              "x <br> y": True, "x\n<br>": False, "x\n</b>": True, "<!x>": True,
              " <?xml\n?> ": True, "x <?y?>": True}
    assert column_of(spark, R.looks_like_html, list(values)) == list(values.values())


def test_escape(spark):
    assert column_of(spark, escape_html, ['<a b="c">&amp;']) == [
        "&lt;a b=&quot;c&quot;&gt;&amp;amp;"]


def test_coverage_and_not_found(make_pages):
    pages = make_pages(["<ul><li><a href=x>1</a><li>2</ul>", "plain", "<a>n</a>"])
    results = run_rules(pages, RULES, shred(pages, 2))
    counts = {(r.page_id, r.rule): r.n_results for r in coverage(results).collect()}
    assert counts == {(0, "links"): 1, (0, "items"): 2, (0, "text"): 2, (1, "text"): 1,
                      (2, "links"): 1, (2, "text"): 1}
    missing = {(r.page_id, r.rule) for r in not_found(pages, RULES, results).collect()}
    assert missing == {(1, "links"), (1, "items"), (2, "items")}
    first = enrich(results).filter("rule = 'links' AND page_id = 0").first()
    assert (first.value, first.line_est, first.is_long, first.is_html) == ("x", 1, False, False)


OUTLINES = [
    f'<div id=m class=" a b " href="{"x" * 28}" title="{"y" * 29}" src=z>{"t" * 25}</div>',
    '<p data-src="" alt=q data-original=r>  one \n two </p><script>s</script><ul><li></ul>',
]


def test_outline(make_pages):
    rows = outline(shred(make_pages(OUTLINES), 2)).orderBy("page_id", "item").collect()
    got = [(r.item, r.depth, r.display, r.has_children) for r in rows]
    assert got == [
        (0, 0, "<head>", False), (1, 0, "<body>", True),
        (2, 1, f'<div#m.a b href="{"x" * 28}" src="z" «{"t" * 24}»>', False),
        (0, 0, "<head>", False), (1, 0, "<body>", True),
        (2, 1, '<p alt="q" data-src="" «one two»>', False),
        (3, 1, "<ul>", True), (4, 2, "<li>", False)]
    long_title = outline(shred(make_pages([f"<b title={'y' * 29}>"]), 1)).filter("tag = 'b'")
    assert long_title.first().display == f'<b title="{"y" * 25}...">'


SELECTED = [
    "<div id=i class='c d'>long text<p>one<p>two's text<p data-x='' data-y=v></p></div>"
    "<div><span data-k=1></span><b>abc</b></div><ul><li>a<li>b<ul><li class=z>c</ul></ul>",
]


def test_selectors(make_pages):
    nodes = shred(make_pages(SELECTED), 2)
    got = [r.selector for r in selectors(nodes).orderBy("node_id").collect()]
    assert got == [
        "//", "//head", "//",
        "//div[@id='i' and @class='c d' and 1]",
        "//div[@id='i' and @class='c d' and 1]/p[1]",
        "//div[@id='i' and @class='c d' and 1]/p[text()='twos text' and 2]",
        "//div[@id='i' and @class='c d' and 1]/p[@data-y='v' and 3]",
        "//div[2]", "//div[2]/span[@data-k='1']", "//div[2]/b",
        "//ul", "//ul/li[1]", "//ul/li[2]", "//ul/li[2]/ul", "//ul/li[2]/ul/li[@class='z']"]


def chain_of(start, selector):
    """Read a generated selector back as a chain, with positions among the same tag."""
    for i, step in enumerate(re.findall(r"(?:[^/\[]|\[[^\]]*\])+", selector[2:])):
        tag, _, inside = step.partition("[")
        start = start.descendant(tag) if i == 0 else start.child(tag)
        for part in filter(None, inside.rstrip("]").split(" and ")):
            name, _, value = part.partition("=")
            value = value.strip("'")
            if part.isdigit():
                start = start.where(C.nth(int(part), of="tag"))
            elif name == "text()":
                start = start.where(F.replace("own_text", F.lit("'"), F.lit("")) == value)
            else:
                start = start.where(F.trim(F.col("attr")[name[1:]]) == value)
    return start


def test_selectors_lead_back(make_pages):
    nodes = shred(make_pages(SELECTED), 2).persist()
    for row in selectors(nodes).filter("selector <> '//'").collect():
        found = chain_of(Selection(nodes), row.selector).nodes().collect()
        assert row.node_id in [r.node_id for r in found], row.selector
    nodes.unpersist()


def test_search(make_pages):
    pages = make_pages(["<div><p>Find me</p><p>no<b title=FINDER>x</b></p></div><div>no</div>",
                        "<p>nothing</p>"])
    outlined = outline(shred(pages, 2))
    rows = search(outlined, "fInD").orderBy("node_id").collect()
    assert [(r.tag, r.is_hit, r.is_open, r.is_first) for r in rows] == [
        ("body", False, True, False), ("div", False, True, False), ("p", True, False, True),
        ("p", False, True, False), ("b", True, False, False)]
    assert search(outlined, "zzz").count() == 0
    with pytest.raises(ValueError):
        search(outlined, "")


def test_pages_and_rejects(spark, tmp_path):
    data = [(1, "https://a", "<p>"), (2, " ", "x"), (3, "https://", "x"), (4, "https://b", None),
            (5, None, "x"), (None, "https://c", "x"), (6, "https://d", "")]
    path = str(tmp_path / "pages")
    spark.createDataFrame(data, "page_id long, url string, html string").write.parquet(path)
    pages, rejects = read_pages(spark, path)
    assert sorted(r.page_id for r in pages.collect()) == [1, 6]
    assert {(r.page_id, r.reason) for r in rejects.collect()} == {
        (2, "no address"), (3, "no address"), (4, "no body"), (5, "no address"),
        (None, "no page id")}
    doubled = pages.union(pages.filter("page_id = 1"))
    assert [(r.page_id, r.n_rows) for r in repeated_ids(doubled).collect()] == [(1, 2)]


def test_repeated_ids_are_rejected(spark, tmp_path):
    """By default: when tables are read, by the queries' own reader and by the stream."""
    source = str(tmp_path / "folder" / "pages.parquet")
    data = [(1, "https://a", "<ul><li>1"), (2, "https://b", "<ul><li>2"), (2, "https://c", "<ul><li>3")]
    spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1).write.parquet(source)
    pages, rejects = read_pages(spark, source)
    assert [r.page_id for r in pages.collect()] == [1]
    told = [(2, "https://b", "repeated page id"), (2, "https://c", "repeated page id")]
    assert sorted(map(tuple, rejects.collect())) == told
    assert [r.page_id for r in pages_of(spark, str(tmp_path / "folder")).collect()] == [1]
    target = str(tmp_path / "out")
    run_stream(spark, source, target, str(tmp_path / "state"), RULES, once=True).awaitTermination()
    assert {r.page_id for r in spark.read.parquet(f"{target}/results").collect()} == {1}
    assert sorted(map(tuple, spark.read.parquet(f"{target}/rejects").drop("batch").collect())) == told


def counted(pages, **more):
    """What without_repeated gives for pages that are all valid: kept and repeated rows."""
    alone, repeated = without_repeated(pages, pages, **more)
    return sorted(map(tuple, alone.collect())), sorted(map(tuple, repeated.collect())) if repeated is not None else None


def test_id_check_ways(spark):
    """Few suspects, many of them, and a map so small that it holds back nearly everything."""
    rows = [(i, f"u{i}", "h") for i in range(300)] + [(i, f"v{i}", "k") for i in range(0, 300, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    kept = sorted(r for r in rows if r[0] % 3)
    gone = sorted(r for r in rows if not r[0] % 3)
    for more in ({}, {"few": 10}, {"few": 10, "most_bits": 1 << 15}, {"few": 99}, {"few": 100}):
        assert counted(pages, **more) == (kept, gone), more
    assert counted(pages.filter("html = 'h'")) == (sorted(r for r in rows if r[2] == "h"), None)
    assert counted(pages.filter("false")) == ([], None)


@pytest.mark.parametrize("few", [0, 1, 100])
def test_split_by_ids(spark, few):
    rows = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("h").alias("html"))
    ids = spark.createDataFrame([(3,), (7,), (99,)], "page_id long")
    others, among = split_by_ids(rows, ids, few)
    assert sorted(r.page_id for r in among.collect()) == [3, 7]
    assert sorted(r.page_id for r in others.collect()) == [i for i in range(50) if i not in (3, 7)]
    assert others.columns == among.columns == rows.columns


def test_only_valid_pages_repeat(spark):
    """A page stays if the other rows of its id cannot be worked on; rows without id are told apart."""
    rows = [(1, "https://a", "x"), (1, "https://a", None), (1, "", "y"), (2, "https://b", "x"), (2, "https://c", "x"),
            (None, "https://d", "x"), (None, "https://d", "x")]
    pages, rejects = split_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert [r.page_id for r in pages.collect()] == [1]
    assert sorted((r.page_id or 0, r.reason) for r in rejects.collect()) == [
        (0, "no page id"), (0, "no page id"), (1, "no address"), (1, "no body"),
        (2, "repeated page id"), (2, "repeated page id")]


def test_html_is_scanned_once(spark):
    """With broadcasts and adaptive plans off, the id check adds no scan of html and moves none."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        folder = "/root/testdata/sf0.001"
        for name in ("links", "tag_census"):
            df = QUERIES[name](spark, folder)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan parquet") == 1 and "Join" not in plan
        # A few repeated ids are broadcast by themselves: still nothing that holds html is moved.
        pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
        few = pages.withColumn("page_id", F.when(F.col("page_id") == 3, 4).otherwise(F.col("page_id")))
        kept, _ = split_pages(few)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert len(moves) == 1  # of the suspects' ids
        assert kept.count() == pages.count() - 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_html_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.html").write_text(f"<p>{name}\n</p>")
    pages, rejects = split_pages(read_html_files(spark, str(tmp_path)))
    rows = Selection(shred(pages, 2)).descendant("p").text().collect()
    assert sorted(r.value for r in rows) == ["a", "b"] and rejects.isEmpty()
    assert len({r.page_id for r in rows}) == 2


def test_file_ids_that_collide(spark, tmp_path):
    """No file is lost, ids stay the same, and those that do not collide keep their hash."""
    for i in range(40):
        (tmp_path / f"{i}.html").write_text(f"<p>{i}</p>")
    few = lambda address: F.pmod(F.xxhash64(address), F.lit(16))
    rows = [sorted(map(tuple, read_html_files(spark, str(tmp_path), few).select("url", "page_id", "html").collect())) for _ in range(2)]
    assert rows[0] == rows[1] and len({r[1] for r in rows[0]}) == 40 == len({r[2] for r in rows[0]})
    assert sum(0 <= r[1] < 16 for r in rows[0]) >= 10
    plain = read_html_files(spark, str(tmp_path))
    assert plain.select("page_id").distinct().count() == 40
    assert plain.filter(F.col("page_id") != F.xxhash64("url")).isEmpty()


def test_result_files(spark, tmp_path):
    """A rare rule is one file, a frequent one several; results are computed once and kept nowhere."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "page_id long, rule string, idx int, value string"
    rows = spark.range(40_000, numPartitions=8).select(
        F.col("id").alias("page_id"), F.when(F.col("id") % 4000 == 0, "rare").otherwise("frequent").alias("rule"),
        F.lit(1).alias("idx"), F.md5(F.col("id").cast("string")).alias("value"))
    write_results(rows.mapInArrow(count, schema), str(tmp_path / "r"), rows_per_file=10_000)
    assert seen.value == 40_000
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "r").iterdir() if d.is_dir()}
    assert files["rule=rare"] == 1 and 4 <= files["rule=frequent"] <= 8
    assert spark.read.parquet(str(tmp_path / "r")).count() == 40_000


def test_comments(make_pages):
    pages = ["<!-- top --><div>a<!--1-->b<p>c<!-- 2 --><b>x<!--3--></p>y</div><!--4--><ul><li><!--5-->z</ul><!--open <p>q",
             "<p>none</p>", "<title>t</title><!----><!--><p>x<!--a--!>", "<p><!--1--><!--2--><i>x</p><script><!--no--></script>"]
    nodes = shred(make_pages(pages), 2).persist()
    start = Selection(nodes)

    def values(found):
        out = {}
        for r in found.text().collect():
            out.setdefault(r.page_id, {})[r.idx] = r.value
        return {p: [v for _, v in sorted(own.items())] for p, own in out.items()}

    assert values(start.descendant("comment()")) == {
        0: ["1", " 2 ", "3", "4", "5", "open <p>q"], 2: ["", "", "a"], 3: ["1", "2"]}
    assert values(start.descendant("div").child("comment()")) == {0: ["1"]}
    assert values(start.descendant("div").descendant("comment()")) == {0: ["1", " 2 ", "3"]}
    assert values(start.descendant("*").descendant("comment()")) == values(start.descendant("comment()"))
    assert start.child("comment()").text().isEmpty()
    places = {(r.page_id, r.node_id): r.parent_id for r in start.descendant("comment()").nodes().collect()}
    tags = {(r.page_id, r.node_id): r.tag for r in nodes.collect()}
    assert [tags[p, places[p, n]] for p, n in sorted(places)] == ["div", "p", "b", "body", "li", "body", "head", "head", "p", "p", "p"]
    found = run_rules(make_pages(pages), {"c": rule([("descendant", "p")], "comments")}, nodes)
    assert sorted((r.page_id, r.value) for r in found.collect()) == [(0, " 2 "), (2, "a"), (3, "1"), (3, "2")]
    nodes.unpersist()


def test_selectors_in_one_pass(spark, make_pages, tmp_path):
    """Deep and long pages, without a checkpoint or more than one exchange."""
    deep = "".join(f"<div id=d{i}>" for i in range(700))
    pages = [deep, "<ul>" + "<li><b>x</b>" * 900 + "</ul>"]
    nodes = shred(make_pages(pages), 2)
    save_nodes(nodes, "path_nodes", str(tmp_path / "nodes"), 2)
    found = selectors(spark.table("path_nodes"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {(r.page_id, r.node_id): r.selector for r in found.collect()}
    spark.sql("DROP TABLE path_nodes")
    assert len(rows) == 3 + 700 + 3 + 1 + 1800
    assert rows[0, 702] == "//" + "/".join(f"div[@id='d{i}']" for i in range(700))
    assert sum(s.endswith("/b") for s in rows.values()) == 900 and "//ul/li[900]/b" in rows.values()


def test_errors_by_rule(spark, make_pages):
    nodes = shred(make_pages(["<p class=a>1</p><p>2</p>"]), 2)
    table = spark.createDataFrame(
        [("good", [("descendant", "p", "attr['class'] = 'a'")], "text"), ("column", [("descendant", "p", "nothing = 1")], "text"),
         ("syntax", [("child", "html", ""), ("child", "body", "sib_pos ==== 1")], "text"), ("type", [("descendant", "p", "sib_pos + 1")], "text"),
         ("axis", [("up", "p", "")], "text"), ("test", [("child", None, "")], "text"), ("emitter", [("descendant", "p", "")], "attr:"),
         ("none", None, "text"), ("null emitter", [("descendant", "p", "")], None), (None, [("descendant", "p", "")], "text")],
        "rule string, steps array<struct<axis:string,test:string,where:string>>, emit string")
    rules = rules_from_table(table) | {"object": Rule((Step("descendant", "p", (7,)),), "text")}
    good, errors = check_rules(nodes, rules)
    assert {(r.rule, r.step, r.reason) for r in errors.collect()} == {
        ("column", 1, "condition: UNRESOLVED_COLUMN"), ("syntax", 2, "condition: PARSE_SYNTAX_ERROR"),
        ("type", 1, "condition: DATATYPE_MISMATCH"), ("axis", 1, "unknown axis"), ("test", 1, "no test"),
        ("emitter", None, "unknown emitter"), ("none", None, "blank rule"), ("null emitter", None, "unknown emitter"),
        ("", None, "blank rule"), ("object", 1, "not a condition")}
    assert [r.value for r in run_rules(make_pages([]), good, nodes).collect()] == ["1"]
    assert check_rules(nodes, {})[1].isEmpty()


def test_saved_nodes_and_results(spark, make_pages, tmp_path):
    pages = make_pages(["<ul><li><a href=x>1</a><li>2</ul>", "<div><ul><li>3"])
    nodes = shred(pages, 4)
    save_nodes(nodes, "saved_nodes", str(tmp_path / "nodes"), 4)
    saved = load_nodes(spark, "saved_nodes")
    assert sorted(map(str, saved.collect())) == sorted(map(str, nodes.collect()))
    results = run_rules(pages, RULES, saved)
    write_results(results, str(tmp_path / "results"))
    back = spark.read.parquet(str(tmp_path / "results"))
    assert sorted(map(str, back.select(results.columns).collect())) == sorted(
        map(str, results.collect()))
    # Joins over the saved table move nothing between executors.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = Selection(saved).descendant("ul").child("li").child("a").attr("href")
        below = Selection(saved).descendant("ul").child("li").descendant("a").attr("href")
        for df in (steps, below):
            df.collect()
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE saved_nodes")


def test_bucketed_pages_stay_in_place(spark, make_pages, tmp_path):
    pages = make_pages(["<ul><li>1<li>2</ul>", "<p>t", "<b>u", "v"])
    save_pages(pages, "saved_pages", str(tmp_path / "pages"), 4)
    nodes = shred(spark.table("saved_pages"))
    assert "Exchange" not in nodes._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, nodes.collect())) == sorted(map(str, shred(pages, 3).collect()))
    spark.sql("DROP TABLE saved_pages")


def test_one_exchange(spark):
    """Shredding, every window and the joins of a chain share one exchange by page_id."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = shred(pages, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange") == 1
    assert "Python" not in plan


def test_stream_equals_batch(spark, make_pages, tmp_path):
    pages = make_pages(["<ul><li><a href=x>1</a><li>2</ul>", "<a href=y>z", "<p>t", "<ul><li>u"])
    source = str(tmp_path / "in")
    for i in range(2):
        pages.filter(F.col("page_id") % 2 == i).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(9, "https://", "x")], pages.schema).coalesce(1).write.mode(
        "append").parquet(source)
    target = str(tmp_path / "out")

    def run(state):
        query = run_stream(spark, source, target, state, RULES, max_files=1, once=True)
        query.awaitTermination()
        return sorted(map(str, spark.read.parquet(f"{target}/results").select(
            "page_id", "rule", "idx", "value").collect()))

    expected = sorted(map(str, run_rules(pages, RULES, shred(pages, 2)).collect()))
    assert run(str(tmp_path / "state1")) == expected
    # A replay writes the same batches again.
    assert run(str(tmp_path / "state2")) == expected
    assert [r.page_id for r in spark.read.parquet(f"{target}/rejects").collect()] == [9]


def batches_of(spark, source, *batches):
    """Page tables that a stream reads one by one, in this order."""
    import os
    import time
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(source)
        for name in os.listdir(source):
            path = os.path.join(source, name)
            if name.startswith("part-") and os.path.getmtime(path) > 1000:
                os.utime(path, (i + 1, i + 1))


@pytest.mark.parametrize("way, remember", [("reject", None), ("replace", None), ("reject", 1)])
def test_ids_across_batches(spark, tmp_path, way, remember):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    page = lambda i, text: (i, f"https://s/{text}", f"<ul><li>{text}</ul>")
    batches_of(spark, source, [page(1, "a"), page(2, "b")], [page(1, "c"), page(3, "d"), page(4, "e"), page(4, "f")],
               [page(2, "g"), page(1, "h"), page(4, "i"), page(5, "j")])

    def run(state):
        run_stream(spark, source, target, str(tmp_path / state), RULES, max_files=1, once=True, repeated=way,
                   remember=remember).awaitTermination()
        rows = stream_results(spark, target).filter("rule = 'items'").collect()
        rejects = spark.read.parquet(f"{target}/rejects").collect()
        return (sorted((r.page_id, r.value, r.batch) for r in rows), sorted((r.page_id, r.url[-1], r.reason, r.batch) for r in rejects))

    again, twice = "page id of an earlier batch", "repeated page id"
    inside = [(4, "e", twice, 1), (4, "f", twice, 1)]
    results, rejects = {
        ("reject", None): ([(1, "a", 0), (2, "b", 0), (3, "d", 1), (4, "i", 2), (5, "j", 2)],
                           [(1, "c", again, 1), (1, "h", again, 2), (2, "g", again, 2), *inside]),
        ("replace", None): ([(1, "h", 2), (2, "g", 2), (3, "d", 1), (4, "i", 2), (5, "j", 2)], inside),
        # What only the batch before the last had is forgotten.
        ("reject", 1): ([(1, "a", 0), (1, "h", 2), (2, "b", 0), (2, "g", 2), (3, "d", 1), (4, "i", 2), (5, "j", 2)],
                        [(1, "c", again, 1), *inside]),
    }[way, remember]
    assert run("state1") == (results, sorted(rejects))
    assert run("state2") == (results, sorted(rejects))


def test_steps_shred_once(make_pages):
    """Steps, bases of links and clipped elements need no second shred of pages that are not saved."""
    pages = make_pages(["<base href=/a/><base href=/b/><ul><li><a href=x>1</a><li><b><i><a href=y>2</b>3</i></ul>",
                        "<ul><li><a>4</a><ol><li><a href=z>5</ol></ul>"])
    nodes = shred(pages, 2)
    start = Selection(nodes, pages)
    items = start.child("html").child("body").child("ul").child("li")
    asked = {
        "child": (items.child("a").attr("href"), [(0, 1, "x"), (1, 1, "")]),
        "descendant": (items.descendant("a").attr("href"), [(0, 1, "x"), (0, 2, "y"), (1, 1, ""), (1, 2, "z")]),
        "links": (items.descendant("a").abs_attr("href"), [
            (0, 1, "https://site.example/a/x"), (0, 2, "https://site.example/a/y"), (1, 1, ""), (1, 2, "https://site.example/dir/z")]),
        "where": (start.where("depth = 0").descendant("li").where("sib_pos = 1").child("a").text(), [(0, 1, "1"), (1, 1, "4"), (1, 2, "5")]),
    }
    for name, (found, expected) in asked.items():
        assert found._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all(html") == 1, name
        assert sorted(map(tuple, found.select("page_id", "idx", "value").collect())) == expected, name
    cut = clipped(nodes)
    assert cut._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all(html") == 1
    assert [(r.page_id, r.tag, r.clipped_by_tag) for r in cut.collect()] == [(0, "i", "b")]


def test_steps_from_repeated_elements(make_pages):
    """What is below elements that stand several times is found once."""
    pages = make_pages(["<div><p><b>1</b></p><p><b>2</b></p></div>"])
    parents = Selection(shred(pages, 2).persist(), pages).descendant("p").parent(keep_duplicates=True)
    assert [r.tag for r in parents.nodes().collect()] == ["div", "div"]
    assert parents.child("p").nodes().count() == 2
    assert sorted(r.value for r in parents.descendant("b").text().collect()) == ["1", "2"]
    assert sorted(r.tag for r in parents.where("tag = 'div'").child().child("b").parent().nodes().collect()) == ["p", "p"]
