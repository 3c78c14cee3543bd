"""Registered queries: every one runs over the whole pages table of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domgrove.operators import conditions as C
from domgrove.operators.outline import outline
from domgrove.operators.search import search
from domgrove.operators.selection import Selection
from domgrove.operators.selectors import selectors
from domgrove.operators.shred import open_tags, shred
from domgrove.plans import reports
from domgrove.plans.rules import PRESETS, Rule, Step, check_rules, rules_from_table, run_rules
from domgrove.plans.workspace import nodes_of, pages_beside, pages_of
from domgrove.sources.pages import split_pages

Query = Callable[[SparkSession, str], DataFrame]


def _start(spark: SparkSession, folder: str) -> Selection:
    return Selection(nodes_of(spark, folder), pages_beside(spark, folder))


def _light(name: str) -> Query:
    """A preset that needs tags and attributes only: one narrow pass over the pages."""
    def run(spark, folder):
        return run_rules(pages_of(spark, folder), {name: PRESETS[name]}).select(
            "page_id", "idx", "value")
    return run


def _values(build: Callable[[Selection], DataFrame]) -> Query:
    return lambda spark, folder: build(_start(spark, folder))


def _elements(build: Callable[[Selection], Selection]) -> Query:
    return lambda spark, folder: build(_start(spark, folder)).nodes().select(
        "page_id", "node_id", "tag")


RULE_SET: dict[str, Rule] = {
    **PRESETS,
    "nav": Rule((Step("descendant", "nav"), Step("child", "ul"), Step("child", "li"),
                 Step("child", "a")), "text"),
    "ad": Rule((Step("descendant", "div", ("attr['class'] = 'ad'",)),), "normalized_text"),
    "title": Rule((Step("descendant", "title"),), "text"),
    "first_link": Rule((Step("descendant", "li", ("sib_pos = 1",)), Step("child", "a")),
                       "attr:href"),
    "articles": Rule((Step("descendant", "article"),), "count"),
}


def _rule_set(spark, folder) -> DataFrame:
    return run_rules(pages_beside(spark, folder), RULE_SET, nodes_of(spark, folder))


def _rule_table(spark, folder) -> DataFrame:
    table = spark.createDataFrame(
        [("headings", [("descendant", "h1", "")], "text"),
         ("second_items", [("descendant", "ul", ""), ("child", "li", "sib_pos = 2")],
          "full_text"),
         ("plain_links", [("descendant", "a", "NOT contains(attr['href'], ',')")], "attr:href")],
        "rule string, steps array<struct<axis:string,test:string,where:string>>, emit string")
    return run_rules(pages_beside(spark, folder), rules_from_table(table), nodes_of(spark, folder))


def _coverage(spark, folder) -> DataFrame:
    return reports.coverage(_rule_set(spark, folder))


def _not_found(spark, folder) -> DataFrame:
    rules = {"quoted": Rule((Step("descendant", "h1", ("contains(own_text, '\"')",)),), "text"),
             "slash_t": Rule((Step("descendant", "a", ("startswith(attr['href'], '/t')",)),),
                             "attr:href"),
             "@title": PRESETS["@title"]}
    pages, nodes = pages_of(spark, folder), nodes_of(spark, folder)
    return reports.not_found(pages, rules, run_rules(pages, rules, nodes))


def _reports_on(emit: str, tag: str) -> Query:
    def run(spark, folder):
        results = run_rules(pages_beside(spark, folder),
                            {tag: Rule((Step("descendant", tag),), emit)},
                            nodes_of(spark, folder))
        return reports.enrich(results)
    return run


def _tree(spark, folder) -> DataFrame:
    return nodes_of(spark, folder).select(
        "page_id", "node_id", "parent_id", "depth", "tag", "own_text", "sib_pos", "sib_count",
        "tag_pos", "tag_count", "off",
        F.size("attrs").alias("n_attrs"), F.size("texts").alias("n_texts"))


def _tag_census(spark, folder) -> DataFrame:
    return (open_tags(pages_of(spark, folder)).groupBy("tag")
            .agg(F.count(F.lit(1)).alias("n_elements"),
                 F.countDistinct("page_id").alias("n_pages")))


def _outline(spark, folder) -> DataFrame:
    return outline(nodes_of(spark, folder)).select(
        "page_id", "node_id", "parent_id", "item", "depth", "display", "has_children")


def _selectors(spark, folder) -> DataFrame:
    return selectors(nodes_of(spark, folder))


def _search(query: str) -> Query:
    return lambda spark, folder: search(outline(nodes_of(spark, folder)), query).select(
        "page_id", "node_id", "tag", "is_hit", "is_open", "is_first")


def _rejects(spark, folder) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select(
        "page_id",
        F.when(F.col("url").contains("#top"), "https://").when(
            F.col("url").contains("utm_source"), "  ").otherwise(F.col("url")).alias("url"),
        F.when(~F.col("url").contains("ref=x"), F.col("html")).alias("html"))
    return split_pages(pages)[1]


def rewritten(spark: SparkSession, folder: str, *changes: tuple[str, str]) -> DataFrame:
    """All pages of a folder with regular expressions replaced in the html."""
    html = F.col("html")
    for pattern, replacement in changes:
        html = F.regexp_replace(html, pattern, replacement)
    return pages_of(spark, folder).withColumn("html", html)


# The pages with each link turned into an image that is loaded late, and items with a title.
LAZY = (("<a href=", "<img data-src="), ("</a>", ""), ("<li>", "<li title='t &amp; u'>"))
# Attributes without quotes or in single ones, repeated, and in capitals; numeric references.
QUOTES = (('<a href="([^"]*)"', "<A HREF='$1' href=x\n rel=no&#45;follow>"), ("<p>", "<p>&#65;&#x42;&#150; "))
# Pages without start tags of html, head and body, and lists without end tags of items.
BARE = (("</?(html|head|body)>", ""), ("</li>", ""))
# Bold text whose end tag comes after that of an inserted element.
CROSSED = (("<b>", "<b><i>"), ("</b>", "</b></i>"))
# Links that begin in one element and end behind its end tag, and in turn cut another one short.
CROSSED_LINKS = (("<a href=", "<em><i><a href="), ("</a>", "</em> </a></i>"))


# Comments inside list items; attributes without value; pages without headings.
REMARKS = (("<li>", "<li><!--x &amp; y-->"),)
VALUELESS = (("<a href=", "<a download href="),)
HEADLESS = (("<h1>[^<]*</h1>", ""),)
# A base address, and links of every shape beside those that begin with a slash.
SHAPES = (("<head>", '<head><base href="/base/dir/">'),
          ('<a href="/([^"]*)">', '<a href="../up/$1"></a><a href="?q=$1"></a><a href="//o.example/$1"></a><a href="./$1">'))
# Elements with an id, and with a data attribute in place of text.
NAMED = (("<article>", "<article id='main' class=wide>"), ("<br>", "<br data-kind='line break'>"))


def _shredded(*changes: tuple[str, str]) -> Callable:
    def run(spark, folder):
        pages = rewritten(spark, folder, *changes)
        return Selection(shred(pages), pages)
    return run


def _lazy(name: str) -> Query:
    return lambda spark, folder: run_rules(
        rewritten(spark, folder, *LAZY, *([("data-src", "data-original")] if name == "@data-original" else [])),
        {name: PRESETS[name]}).select("page_id", "idx", "value")


def _quoted(spark, folder) -> DataFrame:
    return _shredded(*QUOTES)(spark, folder).descendant("a").attrs()


def _references(spark, folder) -> DataFrame:
    return _shredded(*QUOTES)(spark, folder).descendant("p").normalized_text()


def _bare(spark, folder) -> DataFrame:
    """Items under the tags that were put in."""
    return (_shredded(*BARE)(spark, folder).child("html").child("body").child("nav").child("ul").child("li")
            .child("a").attr("href"))


def _crossed(spark, folder) -> DataFrame:
    pages = rewritten(spark, folder, *CROSSED)
    return reports.nesting(shred(pages)).select("page_id", "n_elements", "n_crossing")


def _crossed_text(spark, folder) -> DataFrame:
    return _shredded(*CROSSED)(spark, folder).descendant("b").child("i").normalized_text()


def _crossed_links(spark, folder) -> DataFrame:
    return reports.nesting(shred(rewritten(spark, folder, *CROSSED_LINKS))).select(
        "page_id", "n_elements", "max_depth", "n_crossing")


def _clipped(spark, folder) -> DataFrame:
    return reports.clipped(shred(rewritten(spark, folder, *CROSSED_LINKS)))


def _repeated(spark, folder) -> DataFrame:
    """Every tenth page stands twice; all copies are rejected."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return split_pages(pages.union(pages.filter("page_id % 10 = 0")), check_ids=True)[1]


#: Rules as rows, of which only the first two can be answered.
ODD_RULES = [
    ("headings", [("descendant", "h1", "")], "text"),
    ("first_links", [("descendant", "li", "sib_pos = 1"), ("child", "a", "")], "attr:href"),
    ("no_column", [("descendant", "li", "sib_pos = 1"), ("child", "a", "colour = 'red'")], "text"),
    ("no_condition", [("descendant", "a", "sib_pos = = 1")], "text"),
    ("no_axis", [("sideways", "a", "")], "text"),
    ("no_emitter", [("descendant", "a", "")], "xml"),
    ("no_steps", [], "text"),
]


def _rule_report(spark, folder) -> DataFrame:
    """Every rule of a table: how many results on how many pages, or what is wrong with it."""
    nodes = nodes_of(spark, folder)
    table = spark.createDataFrame(ODD_RULES, "rule string, steps array<struct<axis:string,test:string,where:string>>, emit string")
    rules, errors = check_rules(nodes, rules_from_table(table))
    found = reports.coverage(run_rules(pages_beside(spark, folder), rules, nodes)).groupBy("rule").agg(
        F.sum("n_results").alias("n_results"), F.count("*").alias("n_pages"))
    return found.unionByName(errors, allowMissingColumns=True)


def _nesting(spark, folder) -> DataFrame:
    return reports.nesting(nodes_of(spark, folder)).select(
        "page_id", "n_elements", "max_depth", "n_crossing")


def _children_by_position(s: Selection) -> Selection:
    return s.descendant("article").child("*").where(C.pos(">=", 2), C.pos("<=", 4))


QUERIES: dict[str, Query] = {
    # shredding
    "tag_census": _tag_census,
    "tree": _tree,
    "nesting": _nesting,
    "rejects": _rejects,
    "rejects_repeated": _repeated,
    "quoted_attributes": _quoted,
    "numeric_references": _references,
    "bare_pages": _bare,
    "crossed_nesting": _crossed,
    "crossed_text": _crossed_text,
    "crossed_links": _crossed_links,
    "clipped": _clipped,
    "comments": _values(lambda s: s.descendant("comment()").text()),
    "li_comments": lambda spark, folder: _shredded(*REMARKS)(spark, folder).descendant("li").child("comment()").text(),
    "nav_comments": lambda spark, folder: _shredded(*REMARKS)(spark, folder).descendant("nav").descendant("comment()").nodes(),
    "valueless_attributes": lambda spark, folder: (
        _shredded(*VALUELESS)(spark, folder).descendant("a").where(C.has("download")).attrs()),
    # presets
    "links": _light("@href"),
    "preset_title": _lazy("@title"),
    "preset_data_original": _lazy("@data-original"),
    "preset_data_src": _lazy("@data-src"),
    "all_text": _values(lambda s: s.descendant("*").text()),
    # steps
    "absolute_path": _values(lambda s: s.child("html").child("body").child("nav").child("ul")
                             .child("li").child("a").attr("href")),
    "nav_links": _values(lambda s: s.descendant("nav").child("ul").child("li").child("a").text()),
    "under_article": _elements(lambda s: s.descendant("article").descendant("*")),
    "bold_under_body": _elements(lambda s: s.descendant("body").descendant("b")),
    "parents_of_li": _elements(lambda s: s.descendant("li").parent()),
    "parents_repeated": _elements(lambda s: s.descendant("li").parent(keep_duplicates=True)),
    "prefixed_tag": _elements(lambda s: s.step("descendant", "x:ul").self_().step("child", "LI")),
    # conditions
    "li_first": _elements(lambda s: s.descendant("li").where(C.nth(1))),
    "li_last": _elements(lambda s: s.descendant("li").where(C.last())),
    "li_pos_lt3": _elements(lambda s: s.descendant("li").where(C.pos("<", 3))),
    "li_pos_any": _elements(lambda s: s.descendant("li").where(C.pos())),
    "h1_first_child": _elements(lambda s: s.descendant("h1").where(C.nth(1))),
    "p_first_child": lambda spark, folder: (
        _shredded(*HEADLESS)(spark, folder).descendant("p").where(C.nth(1)).nodes().select("page_id", "node_id", "tag")),
    "p_second_sibling": _elements(lambda s: s.descendant("p").where(C.nth(2))),
    "p_second_of_tag": _elements(lambda s: s.descendant("p").where(C.nth(2, of="tag"))),
    "children_by_position": _elements(_children_by_position),
    "has_class": _elements(lambda s: s.descendant("*").where(C.has("class"))),
    "div_ad": _values(lambda s: s.descendant("div").where(C.eq("class", "ad"))
                      .normalized_text()),
    "not_ad": _elements(lambda s: s.descendant("body").descendant("*")
                        .where(C.ne("class", "ad"), C.negate(C.eq("class", "other")))),
    "href_prefix": _values(lambda s: s.descendant("a").where(C.starts_with("href", "/t"))
                           .attr("href")),
    "href_contains": _values(lambda s: s.descendant("a").where(C.contains("href", "in"))
                             .attr("href")),
    "text_eq": _values(lambda s: s.descendant("a").where(C.text_eq("the")).attr("href")),
    "text_contains": _values(lambda s: s.descendant("p").where(C.text_contains(" the "))
                             .text()),
    "has_text": _elements(lambda s: s.descendant("*").where(C.has_text())),
    "and_or": _elements(lambda s: s.descendant("li").where(
        C.any_of(C.all_of(C.pos("=", 2), C.last()), C.nth(1), C.all_of(C.nth(4), C.last())))),
    # emitters
    "titles": _values(lambda s: s.descendant("title").text()),
    "article_paras": _values(lambda s: s.descendant("article").child("p").text()),
    "missing_attribute": _values(lambda s: s.descendant("li").attr("title")),
    "attr_pairs": _values(lambda s: s.descendant("*").attrs()),
    "normalized_text": _values(lambda s: s.descendant("footer").normalized_text()),
    "li_html": _values(lambda s: s.descendant("li").html()),
    "nav_html": _values(lambda s: s.descendant("nav").html()),
    "nav_full_text": _values(lambda s: s.descendant("nav").full_text()),
    "abs_links": _values(lambda s: s.descendant("a").abs_attr("href")),
    "abs_links_of_shapes": lambda spark, folder: _shredded(*SHAPES)(spark, folder).descendant("a").abs_attr("href"),
    "count_links": _values(lambda s: s.descendant("a").where(C.contains("href", ","))
                           .count()),
    # rule sets and reports
    "rule_set": _rule_set,
    "rule_table": _rule_table,
    "rule_report": _rule_report,
    "coverage": _coverage,
    "not_found": _not_found,
    "reports_on_links": _reports_on("attr:href", "a"),
    "reports_on_text": _reports_on("text", "p"),
    "reports_on_html": _reports_on("html", "ul"),
    # outline
    "outline": _outline,
    "outline_of_named": lambda spark, folder: outline(shred(rewritten(spark, folder, *NAMED))).filter(
        "tag IN ('article', 'br')").select("page_id", "node_id", "display"),
    "selectors": _selectors,
    "selectors_of_named": lambda spark, folder: selectors(shred(rewritten(spark, folder, *NAMED))).filter(
        "selector LIKE '%main%h1%' OR selector LIKE '%data-kind%'"),
    "search": _search("the"),
    "search_attribute": _search('HREF="/A'),
}
