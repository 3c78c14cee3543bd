"""Element names of the HTML standard, grouped by how they end."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without content.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"]

# Elements whose content is never markup. The content of the first group is not text either.
SCRIPT_LIKE = ["script", "style"]
RAW_TEXT = ["iframe", "noembed", "noframes", "xmp"]
ESCAPABLE_TEXT = ["title", "textarea"]
OPAQUE = SCRIPT_LIKE + RAW_TEXT + ESCAPABLE_TEXT

# Elements that stand in the head of a page.
HEAD_CONTENT = ["base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script",
                "style", "template", "title"]

HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]

# Elements with a mandatory end tag that inline elements and list items do not reach across.
CONTAINERS = ["address", "applet", "article", "aside", "blockquote", "body", "button", "caption",
              "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
              "figure", "footer", "form", "frameset", "header", "hgroup", "html", "listing",
              "main", "marquee", "math", "menu", "nav", "noscript", "object", "ol", "pre",
              "search", "section", "select", "summary", "svg", "table", "template", "ul",
              *HEADINGS]

# Elements that end without an end tag when another one starts. A lower rank ends a higher one.
ITEM_RANK = {"head": 0, "tbody": 1, "thead": 1, "tfoot": 1, "colgroup": 1, "optgroup": 1, "tr": 2,
             "td": 3, "th": 3, "option": 4, "dt": 4, "dd": 4, "li": 4, "p": 5}
HEAD_RANK, PARAGRAPH_RANK = ITEM_RANK["head"], ITEM_RANK["p"]

# Block elements whose start ends an open paragraph.
ENDS_PARAGRAPH = ["address", "article", "aside", "blockquote", "center", "details", "dialog",
                  "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
                  "header", "hgroup", "hr", "listing", "main", "menu", "nav", "ol", "pre",
                  "search", "section", "summary", "table", "ul", "xmp", *HEADINGS]

# Inline elements; any other name is taken for a custom element.
INLINE = ["a", "abbr", "acronym", "audio", "b", "bdi", "bdo", "big", "canvas", "cite", "code",
          "data", "datalist", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "legend",
          "map", "mark", "meter", "nobr", "output", "picture", "progress", "q", "rp", "rt",
          "ruby", "s", "samp", "slot", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "video"]

KNOWN = VOID + OPAQUE + CONTAINERS + INLINE + list(ITEM_RANK)

# Elements before and after which the text of a page has a blank.
BREAKS_TEXT = ENDS_PARAGRAPH + ["br", "html", "body", "head", "title", "caption", *ITEM_RANK]


def is_one_of(names: list[str], column: str = "tag") -> Column:
    """Whether a column holds one of these names (one SQL text instead of many literals)."""
    return F.expr(f"{column} IN ({', '.join(repr(name) for name in names)})")
