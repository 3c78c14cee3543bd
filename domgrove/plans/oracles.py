"""The registered queries in SQL for DuckDB.

They do not build a tree: they use regular expressions and the fixed shape of the test pages.
"""

from __future__ import annotations

_TOKEN = (
    r"(?is)(<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title>.*?</title>"
    r"""|<![^>]*>|</?[a-z](?:[^>"]|"[^"]*")*>|[^<]+|<)"""
)


def _plain(x: str) -> str:
    """References replaced (the last one of a text may be cut short), blanks collapsed."""
    for name, character in [("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")]:
        x = f"regexp_replace({x}, '&{name}(;|$)', '{character}', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


# The shape of the pages: element, the element around it, and its depth.
_SHAPE = {
    "html": (None, 0), "head": ("html", 1), "meta": ("head", 2), "title": ("head", 2),
    "style": ("head", 2), "script": ("head", 2), "body": ("html", 1), "nav": ("body", 2),
    "ul": ("nav", 3), "li": ("ul", 4), "a": ("li", 5), "div": ("body", 2),
    "article": ("body", 2), "h1": ("article", 3), "p": ("article", 3), "b": ("p", 4),
    "br": ("b", 5), "footer": ("body", 2),
}
_PARENT = "CASE tag " + " ".join(
    f"WHEN '{t}' THEN '{p}'" for t, (p, _) in _SHAPE.items() if p) + " END"
_DEPTH = "CASE tag " + " ".join(f"WHEN '{t}' THEN {d}" for t, (_, d) in _SHAPE.items()) + " END"

_LAST = ",\n".join(
    f"max(CASE WHEN tag = '{t}' THEN pos END) OVER before AS last_{t}"
    for t in ("html", "head", "body", "nav", "ul", "li", "article", "p", "b"))
_PARENT_ID = "CASE tag " + " ".join(
    f"WHEN '{t}' THEN last_{p}" for t, (p, _) in _SHAPE.items() if p) + " END"

NODES = f"""
WITH lists AS (SELECT page_id, regexp_extract_all(html, '{_TOKEN.replace("'", "''")}', 1) AS t FROM pages),
tok AS (SELECT page_id, unnest(t) AS raw, unnest(range(len(t))) AS pos FROM lists),
placed AS (
  SELECT page_id, pos, raw, lower(regexp_extract(raw, '^<([a-zA-Z][^\\s/>]*)', 1)) AS tag,
    lead(raw) OVER w AS following,
    coalesce(sum(length(raw)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
shaped AS (
  SELECT *, {_LAST} FROM placed
  WINDOW before AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
el AS (
  SELECT page_id, CAST(pos AS INTEGER) AS node_id, tag, raw, CAST(off AS INTEGER) AS off,
    CAST({_PARENT_ID} AS INTEGER) AS parent_id, CAST({_DEPTH} AS INTEGER) AS depth,
    CASE WHEN tag = 'title' THEN {_plain("regexp_extract(raw, '(?s)^<title>(.*)</title>$', 1)")}
         WHEN tag IN ('style', 'script', 'br', 'meta') OR following LIKE '<%' OR following IS NULL THEN ''
         ELSE {_plain("following")} END AS own_text,
    regexp_extract_all(CASE WHEN tag IN ('title', 'style', 'script') THEN '' ELSE raw END,
                       '\\s([a-z]+)="([^"]*)"', 1) AS names,
    regexp_extract_all(CASE WHEN tag IN ('title', 'style', 'script') THEN '' ELSE raw END,
                       '\\s([a-z]+)="([^"]*)"', 2) AS vals
  FROM shaped WHERE tag <> ''),
nodes AS (
  SELECT *,
    CAST(row_number() OVER (PARTITION BY page_id, parent_id ORDER BY node_id) AS INTEGER) AS sib_pos,
    CAST(count(*) OVER (PARTITION BY page_id, parent_id) AS INTEGER) AS sib_count,
    CAST(row_number() OVER (PARTITION BY page_id, parent_id, tag ORDER BY node_id) AS INTEGER) AS tag_pos,
    CAST(count(*) OVER (PARTITION BY page_id, parent_id, tag) AS INTEGER) AS tag_count,
    coalesce(vals[list_position(names, 'href')], '') AS href,
    coalesce(vals[list_position(names, 'class')], '') AS class
  FROM el)
"""


def _numbered(select: str) -> str:
    """Number rows of (page_id, node_id, item, value)."""
    return f"""{NODES}
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY node_id, item) AS INTEGER) AS idx, value
FROM ({select})"""


def _rows(where: str) -> str:
    return f"{NODES} SELECT page_id, node_id, tag FROM nodes WHERE {where}"


def _found(pattern: str, value: str = "v", where: str = "true", html: str = "html") -> str:
    """Direct use of a regular expression: the n-th match of a page is result n."""
    return f"""
WITH m AS (SELECT page_id, regexp_extract_all({html}, '{pattern}', 1) AS l FROM pages),
r AS (SELECT page_id, unnest(l) AS v, unnest(range(len(l))) AS i FROM m)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER) AS idx, {value} AS value
FROM r WHERE {where}"""



_RULE_SET = f"""{NODES},
hits AS (
  SELECT page_id, '@href' AS rule, node_id, href AS value FROM nodes WHERE tag = 'a'
  UNION ALL SELECT page_id, 'text()', node_id, own_text FROM nodes WHERE own_text <> ''
  UNION ALL SELECT page_id, 'nav', node_id, own_text FROM nodes WHERE tag = 'a' AND own_text <> ''
  UNION ALL SELECT page_id, 'ad', node_id, own_text FROM nodes WHERE tag = 'div' AND class = 'ad'
  UNION ALL SELECT page_id, 'title', node_id, own_text FROM nodes WHERE tag = 'title' AND own_text <> ''
  UNION ALL SELECT a.page_id, 'first_link', a.node_id, a.href FROM nodes a JOIN nodes l
    ON a.page_id = l.page_id AND a.parent_id = l.node_id WHERE a.tag = 'a' AND l.sib_pos = 1
  UNION ALL SELECT page_id, 'articles', 0, CAST(count(*) FILTER (tag = 'article') AS VARCHAR)
    FROM nodes GROUP BY page_id),
results AS (SELECT page_id, rule,
  CAST(row_number() OVER (PARTITION BY page_id, rule ORDER BY node_id) AS INTEGER) AS idx, value FROM hits)
"""


def _reports(tag: str, value: str) -> str:
    badge = " || ".join([
        "list_transform(list_distinct(regexp_extract_all(value, '@([0-9A-Za-z_][0-9A-Za-z_-]*)', 1)), lambda n: '@' || n)"])
    common = "list_filter(['title','href','src','data-src','data-original','alt','class','id'], lambda a: contains(lower(value), a))"
    estimate = ("CASE WHEN value = '' THEN 0 ELSE list_sum(list_transform(string_split(value, chr(10)), "
                "lambda s: length(s) // 40 + 1)) END")
    return f"""{NODES},
r AS (SELECT page_id, '{tag}' AS rule, node_id, {value} AS value FROM nodes WHERE tag = '{tag}'),
n AS (SELECT page_id, rule, CAST(row_number() OVER (PARTITION BY page_id ORDER BY node_id) AS INTEGER) AS idx, value
      FROM r WHERE value IS NOT NULL),
b AS (SELECT *, {badge} AS named,
        contains(lower(value), 'text()') OR contains(lower(value), 'text="') AS speaks FROM n)
SELECT page_id, rule, idx, value,
  array_to_string((CASE WHEN len(named) > 0 OR speaks
     THEN named || CASE WHEN speaks THEN ['text()'] ELSE [] END
     ELSE list_transform({common}, lambda a: '@' || a) END)[1:6], '  ') AS badges,
  CAST({estimate} AS INTEGER) AS line_est,
  CAST({estimate} AS INTEGER) > 3 AS is_long,
  contains(value, '<') AND contains(value, '>') AND (contains(trim(value), '</')
     OR starts_with(trim(value), '<!')
     OR regexp_full_match(trim(value), '.*<[a-zA-Z!?][^>]*>.*')) AS is_html,
  replace(replace(replace(replace(value, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped
FROM b"""


_DISPLAY = """'<' || tag || CASE WHEN class <> '' THEN '.' || class ELSE '' END
  || CASE WHEN list_contains(names, 'href') THEN ' href="' ||
       CASE WHEN length(href) <= 28 THEN href ELSE substr(href, 1, 25) || '...' END || '"' ELSE '' END
  || CASE WHEN own_text <> '' THEN ' «' || substr(own_text, 1, 24) || '»' ELSE '' END || '>'"""

_OUTLINE = f"""{NODES},
shown AS (SELECT *, {_DISPLAY} AS display FROM nodes WHERE depth >= 1 AND tag NOT IN ('script', 'style')),
bounds AS (SELECT s.*, (SELECT max(1) FROM shown c WHERE c.page_id = s.page_id AND c.parent_id = s.node_id) AS kids
           FROM shown s)
"""

_STEP = """tag || CASE
  WHEN class <> '' AND tag_count > 1 THEN '[@class=''' || class || ''' and ' || tag_pos || ']'
  WHEN class <> '' THEN '[@class=''' || class || ''']'
  WHEN length(own_text) > 3 AND tag_count > 1
    THEN '[text()=''' || replace(own_text, '''', '') || ''' and ' || tag_pos || ']'
  WHEN length(own_text) > 3 THEN '[text()=''' || replace(own_text, '''', '') || ''']'
  WHEN tag_count > 1 THEN '[' || tag_pos || ']'
  ELSE '' END"""

_SELECTORS = f"""{NODES.replace("WITH lists", "WITH RECURSIVE lists", 1)},
paths AS (
  SELECT page_id, node_id, CASE WHEN tag IN ('html', 'body') THEN '' ELSE {_STEP} END AS path
  FROM nodes WHERE depth = 0 OR tag = 'body' OR (depth = 1)
  UNION ALL
  SELECT c.page_id, c.node_id, CASE WHEN p.path = '' THEN '' ELSE p.path || '/' END || {_STEP.replace("tag", "c.tag").replace("class", "c.class").replace("@c.class", "@class").replace("own_text", "c.own_text").replace("c.c.", "c.")}
  FROM nodes c JOIN paths p ON c.page_id = p.page_id AND c.parent_id = p.node_id WHERE c.depth >= 2)
SELECT page_id, node_id, '//' || path AS selector FROM paths"""


def _search(needle: str) -> str:
    """Hits, and the elements found by walking up from them."""
    n = needle.lower()
    return f"""{NODES.replace("WITH lists", "WITH RECURSIVE lists", 1)},
shown AS (SELECT *, {_DISPLAY} AS display FROM nodes WHERE depth >= 1 AND tag NOT IN ('script', 'style')),
hit AS (SELECT * FROM shown WHERE contains(lower(display), '{n}') OR contains(lower(own_text), '{n}')),
up AS (SELECT page_id, parent_id FROM hit UNION
       SELECT s.page_id, s.parent_id FROM up JOIN shown s ON s.page_id = up.page_id AND s.node_id = up.parent_id)
SELECT s.page_id, s.node_id, s.tag, h.node_id IS NOT NULL AS is_hit, u.parent_id IS NOT NULL AS is_open,
  s.node_id = min(h.node_id) OVER (PARTITION BY s.page_id) AND h.node_id IS NOT NULL AS is_first
FROM shown s LEFT JOIN hit h ON h.page_id = s.page_id AND h.node_id = s.node_id
LEFT JOIN up u ON u.page_id = s.page_id AND u.parent_id = s.node_id
WHERE h.node_id IS NOT NULL OR u.parent_id IS NOT NULL"""


_A_TEXT = '<a href="[^"]*">([^<]*)</a>'
_HREF = '<a href="([^"]*)"'
_UNDER_BODY = ("(parent_id IS NOT NULL AND depth >= 2 AND "
               "tag NOT IN ('meta', 'title', 'style', 'script'))")
_BLANKLESS = f"SELECT page_id, node_id, 0 AS item, own_text AS value FROM nodes WHERE own_text <> ''"

ORACLES: dict[str, str] = {
    "tag_census": f"{NODES} SELECT tag, count(*) AS n_elements, count(DISTINCT page_id) AS n_pages FROM nodes GROUP BY tag",
    "tree": f"""{NODES} SELECT page_id, node_id, parent_id, depth, tag, own_text, sib_pos, sib_count, tag_pos,
        tag_count, off, CAST(len(names) AS INTEGER) AS n_attrs,
        CAST(CASE WHEN own_text <> '' THEN 1 ELSE 0 END AS INTEGER) AS n_texts FROM nodes""",
    "nesting": f"""{NODES} SELECT page_id, count(*) AS n_elements, max(depth) AS max_depth,
        CAST(0 AS BIGINT) AS n_crossing FROM nodes GROUP BY page_id""",
    "rejects": """SELECT page_id, CASE WHEN contains(url, '#top') THEN 'https://'
          WHEN contains(url, 'utm_source') THEN '  ' ELSE url END AS url,
        CASE WHEN contains(url, '#top') OR contains(url, 'utm_source') THEN 'no address' ELSE 'no body' END AS reason
        FROM pages WHERE contains(url, '#top') OR contains(url, 'utm_source') OR contains(url, 'ref=x')""",
    "rejects_repeated": """SELECT page_id, url, 'repeated page id' AS reason FROM pages WHERE page_id % 10 = 0
        UNION ALL SELECT page_id, url, 'repeated page id' FROM pages WHERE page_id % 10 = 0""",
    "quoted_attributes": """
        WITH m AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages),
        r AS (SELECT page_id, unnest(list_transform(range(2 * len(l)), lambda i:
            CASE WHEN i % 2 = 0 THEN 'href=' || l[i // 2 + 1] ELSE 'rel=no-follow' END)) AS value,
            unnest(range(2 * len(l))) AS i FROM m)
        SELECT page_id, CAST(i + 1 AS INTEGER) AS idx, value FROM r""",
    "numeric_references": _found("<p>([^<]*)", "trim('AB– ' || " + _plain("v") + ")"),
    "bare_pages": _found(_HREF),
    "crossed_nesting": f"""{NODES} SELECT page_id, count(*) + count(*) FILTER (tag = 'b') AS n_elements,
        CAST(0 AS BIGINT) AS n_crossing FROM nodes GROUP BY page_id""",
    "crossed_text": _numbered("SELECT page_id, node_id, 0 AS item, own_text AS value FROM nodes WHERE tag = 'b'"),
    "crossed_links": f"""{NODES} SELECT page_id, count(*) + 2 * count(*) FILTER (tag = 'a') AS n_elements,
        greatest(max(depth), max(depth + 2) FILTER (tag = 'a')) AS max_depth,
        2 * count(*) FILTER (tag = 'a') AS n_crossing FROM nodes GROUP BY page_id""",
    # Every link before in the page has five tokens more: three tags before and behind, and a blank.
    "clipped": f"""{NODES},
        found AS (SELECT page_id, node_id + 5 * (row_number() OVER (PARTITION BY page_id ORDER BY node_id) - 1) AS spot
                  FROM nodes WHERE tag = 'a')
        SELECT page_id, CAST(spot + i AS INTEGER) AS node_id, CASE i WHEN 1 THEN 'i' ELSE 'a' END AS tag,
          CAST(spot + 4 AS INTEGER) AS end_pos, CAST(spot AS INTEGER) AS clipped_by, 'em' AS clipped_by_tag
        FROM found, (SELECT unnest([1, 2]) AS i)""",
    "comments": _found("<!--(.*?)-->"),
    "li_comments": _found("<(li)>", "'x &amp; y'"),
    # Every item before in the page has one token more.
    "nav_comments": f"""{NODES} SELECT page_id, CAST(node_id + row_number() OVER w AS INTEGER) AS node_id,
        CAST(node_id + row_number() OVER w - 1 AS INTEGER) AS parent_id, 'x &amp; y' AS value
        FROM nodes WHERE tag = 'li' WINDOW w AS (PARTITION BY page_id ORDER BY node_id)""",
    "valueless_attributes": """
        WITH m AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages),
        r AS (SELECT page_id, unnest(list_transform(range(2 * len(l)), lambda i:
            CASE WHEN i % 2 = 0 THEN 'download=' ELSE 'href=' || l[i // 2 + 1] END)) AS value,
            unnest(range(2 * len(l))) AS i FROM m)
        SELECT page_id, CAST(i + 1 AS INTEGER) AS idx, value FROM r""",
    "links": _found(_HREF),
    "preset_title": _found("<(li)>", "'t & u'"),
    "preset_data_original": _found(_HREF),
    "preset_data_src": _found(_HREF),
    "all_text": _numbered(_BLANKLESS),
    "absolute_path": _found(_HREF),
    "nav_links": _found(_A_TEXT, _plain("v"), html="regexp_extract(html, '(?s)^(.*?)</nav>', 1)"),
    "under_article": _rows("tag IN ('h1', 'p', 'b', 'br')"),
    "bold_under_body": _rows("tag = 'b'"),
    "parents_of_li": _rows("tag = 'ul'"),
    "parents_repeated": f"""{NODES} SELECT u.page_id, u.node_id, u.tag FROM nodes l JOIN nodes u
        ON l.page_id = u.page_id AND l.parent_id = u.node_id WHERE l.tag = 'li'""",
    "prefixed_tag": _rows("tag = 'li'"),
    "li_first": _rows("tag = 'li' AND sib_pos = 1"),
    "li_last": _rows("tag = 'li' AND sib_pos = sib_count"),
    "li_pos_lt3": _rows("tag = 'li' AND sib_pos < 3"),
    "li_pos_any": _rows("tag = 'li'"),
    "h1_first_child": _rows("tag = 'h1' AND sib_pos = 1"),
    # A heading is three tokens: the first paragraph takes its place.
    "p_first_child": f"{NODES} SELECT page_id, node_id, 'p' AS tag FROM nodes WHERE tag = 'h1'",
    "p_second_sibling": _rows("tag = 'p' AND sib_pos = 2"),
    "p_second_of_tag": _rows("tag = 'p' AND tag_pos = 2"),
    "children_by_position": _rows("tag IN ('h1', 'p') AND sib_pos BETWEEN 2 AND 4"),
    "has_class": _rows("list_contains(names, 'class')"),
    "div_ad": _found('<div class="ad">([^<]*)', _plain("v")),
    "not_ad": _rows(f"{_UNDER_BODY} AND class <> 'ad'"),
    "href_prefix": _found(_HREF, where="starts_with(v, '/t')"),
    "href_contains": _found(_HREF, where="contains(v, 'in')"),
    "text_eq": _numbered("SELECT page_id, node_id, 0 AS item, href AS value FROM nodes WHERE tag = 'a' AND own_text = 'the'"),
    "text_contains": _found("<p>([^<]*)", _plain("v"), where=f"contains({_plain('v')}, ' the ')"),
    "has_text": _rows("own_text <> ''"),
    "and_or": _rows("tag = 'li' AND (sib_pos = 1 OR (sib_pos IN (2, 4) AND sib_pos = sib_count))"),
    "titles": _found("<title>(.*?)</title>", _plain("v"), where=f"{_plain('v')} <> ''"),
    "article_paras": _found("<p>([^<]*)", _plain("v"), where=f"{_plain('v')} <> ''"),
    "missing_attribute": _found("<(li)>", "''"),
    "attr_pairs": _numbered("""SELECT page_id, node_id, unnest(range(len(names))) AS item,
        unnest(list_transform(range(1, len(names) + 1), lambda i: names[i] || '=' || vals[i])) AS value FROM nodes"""),
    "normalized_text": _found("<footer>([^<]*)", _plain("v")),
    "li_html": _found("(<li>.*?</li>)"),
    "nav_html": _found("(<nav>.*?</nav>)"),
    "nav_full_text": f"""
        WITH m AS (SELECT page_id, regexp_extract_all(html, '{_A_TEXT}', 1) AS l FROM pages)
        SELECT page_id, CAST(1 AS INTEGER) AS idx, {_plain("array_to_string(l, ' ')")} AS value FROM m""",
    "abs_links": f"""
        WITH m AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site,
                     regexp_extract_all(html, '{_HREF}', 1) AS l FROM pages),
        r AS (SELECT page_id, site, unnest(l) AS v, unnest(range(len(l))) AS i FROM m)
        SELECT page_id, CAST(i + 1 AS INTEGER) AS idx, site || v AS value FROM r""",
    "abs_links_of_shapes": """
        WITH m AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site,
                     regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS l FROM pages),
        r AS (SELECT page_id, site, unnest(l) AS v, unnest(range(len(l))) AS i FROM m)
        SELECT page_id, CAST(4 * i + k AS INTEGER) AS idx, CASE k WHEN 1 THEN site || '/base/up/' || v
          WHEN 2 THEN site || '/base/dir/?q=' || v WHEN 3 THEN regexp_extract(site, '^[a-z]*:') || '//o.example/' || v
          ELSE site || '/base/dir/' || v END AS value
        FROM r, (SELECT unnest([1, 2, 3, 4]) AS k)""",
    "count_links": f"""SELECT page_id, CAST(1 AS INTEGER) AS idx,
        CAST(len(list_filter(regexp_extract_all(html, '{_HREF}', 1), lambda h: contains(h, ','))) AS VARCHAR) AS value
        FROM pages""",
    "rule_set": f"{_RULE_SET} SELECT * FROM results",
    "rule_table": f"""{NODES},
        hits AS (
          SELECT page_id, 'headings' AS rule, node_id, own_text AS value FROM nodes WHERE tag = 'h1' AND own_text <> ''
          UNION ALL SELECT l.page_id, 'second_items', l.node_id, a.own_text FROM nodes l JOIN nodes a
            ON a.page_id = l.page_id AND a.parent_id = l.node_id WHERE l.tag = 'li' AND l.sib_pos = 2
          UNION ALL SELECT page_id, 'plain_links', node_id, href FROM nodes
            WHERE tag = 'a' AND NOT contains(href, ','))
        SELECT page_id, rule, CAST(row_number() OVER (PARTITION BY page_id, rule ORDER BY node_id) AS INTEGER) AS idx,
          value FROM hits""",
    "rule_report": f"""{NODES},
        hits AS (
          SELECT page_id, 'headings' AS rule FROM nodes WHERE tag = 'h1' AND own_text <> ''
          UNION ALL SELECT a.page_id, 'first_links' FROM nodes a JOIN nodes l
            ON a.page_id = l.page_id AND a.parent_id = l.node_id WHERE a.tag = 'a' AND l.tag = 'li' AND l.sib_pos = 1)
        SELECT rule, CAST(count(*) AS BIGINT) AS n_results, count(DISTINCT page_id) AS n_pages,
          CAST(NULL AS INTEGER) AS step, CAST(NULL AS VARCHAR) AS reason FROM hits GROUP BY rule
        UNION ALL SELECT * FROM (VALUES
          ('no_column', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 2, 'condition: UNRESOLVED_COLUMN'),
          ('no_condition', NULL, NULL, 1, 'condition: PARSE_SYNTAX_ERROR'), ('no_axis', NULL, NULL, 1, 'unknown axis'),
          ('no_emitter', NULL, NULL, NULL, 'unknown emitter'), ('no_steps', NULL, NULL, NULL, 'blank rule'))""",
    "coverage": f"{_RULE_SET} SELECT page_id, rule, count(*) AS n_results FROM results GROUP BY page_id, rule",
    "not_found": f"""
        SELECT page_id, 'quoted' AS rule FROM pages
          WHERE NOT contains({_plain("regexp_extract(html, '<h1>([^<]*)', 1)")}, '"')
        UNION ALL SELECT page_id, 'slash_t' FROM pages WHERE NOT contains(html, '<a href="/t')
        UNION ALL SELECT page_id, '@title' FROM pages""",
    "reports_on_links": _reports("a", "href"),
    "reports_on_text": _reports("p", "nullif(own_text, '')"),
    "reports_on_html": f"""{_reports("ul", "raw || 'x'")}""",
    "outline": f"""{_OUTLINE} SELECT page_id, node_id, parent_id,
        CAST(row_number() OVER (PARTITION BY page_id ORDER BY node_id) - 1 AS INTEGER) AS item,
        CAST(depth - 1 AS INTEGER) AS depth, display, kids IS NOT NULL AS has_children FROM bounds""",
    "outline_of_named": f"""{NODES} SELECT page_id, node_id,
        CASE tag WHEN 'article' THEN '<article#main.wide>' ELSE '<br>' END AS display
        FROM nodes WHERE tag IN ('article', 'br')""",
    "selectors": _SELECTORS,
    "selectors_of_named": f"""{_SELECTORS.replace("SELECT page_id, node_id, '//' || path AS selector FROM paths", "")}
        SELECT p.page_id, p.node_id, CASE n.tag
          WHEN 'h1' THEN '//' || replace(path, 'article/', 'article[@id=''main'' and @class=''wide'']/')
          ELSE '//' || replace(left(path, length(path) - 2), 'article/', 'article[@id=''main'' and @class=''wide'']/')
            || 'br[@data-kind=''line break'']' END AS selector
        FROM paths p JOIN nodes n ON n.page_id = p.page_id AND n.node_id = p.node_id
        WHERE n.tag = 'br' OR n.tag = 'h1'""",
    "search": _search("the"),
    "search_attribute": _search('HREF="/A'),
}
# Whole lists: their markup ends at the end tag, not at the start tag.
ORACLES["reports_on_html"] = ORACLES["reports_on_html"].replace(
    "FROM nodes WHERE tag = 'ul')",
    "FROM nodes WHERE tag = 'ul')").replace(
    "raw || 'x' AS value FROM nodes",
    "(SELECT regexp_extract(html, '(?s)(<ul>.*?</ul>)', 1) FROM pages p WHERE p.page_id = nodes.page_id) AS value FROM nodes")
