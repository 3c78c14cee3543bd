"""Cut the markup of a page into tokens, with Spark's own regular expressions.

The tokens of a page, put together, are the page again. Only possessive forms are used
where a pattern repeats a group: they run in a loop, where others recurse and overflow the
stack on long input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domgrove.functions import vocabulary as V

_INSIDE_TAG = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+"""

TOKEN = (
    r"(?is)("
    r"<!--(?:-?>|.*?--!?>|.*)"                                   # comment, to the end if open
    r"|<(" + "|".join(V.OPAQUE) + r")(?=[\s/>])(?:.*?</\2(?=[\s/>])[^>]*>|.*)"
    r"|</?[a-z]" + _INSIDE_TAG + r">"                            # start and end tags
    r"|<[!?/][^>]*+>?"                                           # doctype and stray markup
    r"|</?[a-z][^>]*+"                                           # tag cut off by the page end
    r"|(?:[^<]++|<(?![a-z/!?]))++"                               # text
    r")"
)

# Zero-length tokens put in for tags that a page leaves out. Text holds no "<" before a
# letter, so no token of a page looks like one of them.
IMPLIED_HTML, IMPLIED_HEAD, IMPLIED_BODY, PAGE_END = "+<html>", "+<head>", "+<body>", "+<end>"
IMPLIED = [IMPLIED_HTML, IMPLIED_HEAD, IMPLIED_BODY, PAGE_END]

_HEAD_CONTENT = r"^(?i)</?(?:head|" + "|".join(V.HEAD_CONTENT) + r")[\s/>]"


def raw_tokens(html: Column) -> Column:
    """All tokens of a page as an array of strings."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(1))


def _letters(tokens: Column) -> Column:
    """One letter per token: H, D, B for html, head and body tags, h for head content, m for
    what may stand anywhere (comments, blanks), x for the rest."""
    def letter(t: Column) -> Column:
        return (
            F.when(t.rlike(r"^(?:<[!?]|\s*$)"), "m")
            .when(~t.startswith("<"), "x")
            .when(t.rlike(r"^(?i)<html[\s/>]"), "H")
            .when(t.rlike(r"^(?i)<head[\s/>]"), "D")
            .when(t.rlike(r"^(?i)<(?:body|frameset)[\s/>]"), "B")
            .when(t.rlike(_HEAD_CONTENT), "h")
            .otherwise("x")
        )
    return F.transform(tokens, letter)


def with_implied_tags(tokens: Column, letters: Column, signature: Column) -> Column:
    """Add the html, head and body tags a page leaves out, and a mark for its end.

    `signature` is the letters as one string.

    A page that has them in their places is taken as it is. Otherwise such a tag counts only
    where it stands first; later ones are taken out.
    """
    lead = F.length(F.regexp_extract(signature, "^m*", 0))
    has_html = F.substring(signature, lead + 1, F.lit(1)) == "H"
    head_lead = F.length(F.regexp_extract(signature, "^m*H?m*", 0))
    has_head = F.substring(signature, head_lead + 1, F.lit(1)) == "D"
    head_at = F.when(has_head, head_lead).otherwise(lead + has_html.cast("int"))
    body_at = F.length(F.regexp_extract(signature, "^[mhHD]*", 0))
    has_body = F.substring(signature, body_at + 1, F.lit(1)) == "B"

    def in_place(t: Column, i: Column) -> Column:
        letter = F.element_at(letters, i + 1)
        return (
            ~letter.isin("H", "D", "B")
            | (has_html & (i == lead)) | (has_head & (i == head_lead))
            | (has_body & (i == body_at))
        )

    def put(array: Column, at: Column, token: str) -> Column:
        return F.array_insert(array, at + 1, F.lit(token))

    # A tag out of place is turned into a declaration of the same length, which is skipped.
    kept = F.transform(tokens, lambda t, i: F.when(in_place(t, i), t).otherwise(
        F.concat(F.lit("<!"), F.substr(t, F.lit(3)))))
    # From back to front, so that the places found above stay right.
    body = F.when(has_body, kept).otherwise(put(kept, body_at, IMPLIED_BODY))
    head = F.when(has_head, body).otherwise(put(body, head_at, IMPLIED_HEAD))
    html = F.when(has_html, head).otherwise(put(head, lead, IMPLIED_HTML))
    usual = signature.rlike("^m*Hm*D[mh]*B[^HDB]*$")
    return F.array_append(F.when(usual, tokens).otherwise(html), F.lit(PAGE_END))


def tag_name(raw: Column) -> Column:
    return F.lower(F.regexp_extract(raw, r"^\+?</?([a-zA-Z][^\s/>]*)", 1))


# Kinds of tokens. An opaque token is an element together with its content.
OPEN, CLOSE, VOID, OPAQUE, TEXT, MISC, END = range(1, 8)


def token_kind() -> Column:
    """Kind of a token, from its columns raw and tag."""
    raw = F.col("raw")
    closed = raw.endswith(">")
    custom_empty = raw.endswith("/>") & ~V.is_one_of(V.KNOWN)
    return (
        F.when(F.col("tag") == "", F.when(raw.rlike("^<[!?/]"), MISC).otherwise(TEXT))
        .when(raw == PAGE_END, END)
        .when(raw.startswith("</"), F.when(closed, CLOSE).otherwise(MISC))
        .when(V.is_one_of(V.OPAQUE), OPAQUE)
        .when(~closed, MISC)
        .when(V.is_one_of(V.VOID) | custom_empty, VOID)
        .otherwise(OPEN)
    )


def explode_tokens(pages: DataFrame) -> DataFrame:
    """One row per token: page_id, pos, raw, kind, tag. A narrow step, no exchange."""
    raw = F.col("raw")
    return (
        pages.select("page_id", raw_tokens(F.col("html")).alias("tokens"))
        .select("page_id", "tokens", _letters(F.col("tokens")).alias("letters"))
        .select("page_id", "tokens", "letters", F.array_join("letters", "").alias("signature"))
        .select("page_id", F.posexplode(with_implied_tags(
            F.col("tokens"), F.col("letters"), F.col("signature"))).alias("pos", "raw"))
        .select("page_id", "pos", "raw",
                F.when(raw.startswith("<") | raw.startswith("+<"), tag_name(raw))
                .otherwise("").alias("tag"))
        .select("page_id", "pos", "raw", "tag", token_kind().alias("kind"))
    )


def token_length(raw: Column) -> Column:
    """Characters of the page in a token; tags that were put in have none."""
    return F.when(raw.isin(IMPLIED), 0).otherwise(F.length(raw))
