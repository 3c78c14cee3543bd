"""Blanks and character references, as Column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blanks, and those that are left out of text.
BLANKS = r"[ \t\n\f\r\x{A0}]+"
INVISIBLE = ["\u200b", "\u00ad"]
EDGE_BLANKS = r"^[\s\p{Z}]++|[\s\p{Z}]++$"

_REFERENCE_IN_TEXT = (
    r"&(?:#[xX][0-9a-fA-F]++|#[0-9]++|[a-zA-Z][a-zA-Z0-9]*+);?+|[^&]++|&"
)
# In an attribute a name without a semicolon is not a reference before these characters.
_REFERENCE_IN_ATTRIBUTE = (
    r"&(?:#[xX][0-9a-fA-F]++;?+|#[0-9]++;?+|[a-zA-Z][a-zA-Z0-9]*+(?:;|(?![=_-])))|[^&]++|&"
)

# Numbers 128 to 159 stand for the characters of windows-1252.
_WINDOWS_1252 = "".join(bytes([n]).decode("cp1252", "replace") for n in range(128, 160))


def collapse(col: Column) -> Column:
    """Runs of blanks become one blank; both ends are trimmed."""
    for character in INVISIBLE:
        col = F.replace(col, F.lit(character), F.lit(""))
    return F.regexp_replace(F.regexp_replace(col, BLANKS, " "), EDGE_BLANKS, "")


def _names() -> Column:
    """The named references of the HTML standard as one constant map: initial -> name -> text.

    The table comes from the Python standard library. It is one string constant, which Spark
    folds into a map once when it plans the query.
    """
    by_initial: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        by_initial.setdefault(name[0], {})[name] = text
    return F.from_json(F.lit(json.dumps(by_initial)), "map<string,map<string,string>>")


def _numeric(piece: Column) -> Column:
    digits = F.regexp_extract(piece, "^&#[xX]?([0-9a-fA-F]+)", 1)
    base16 = F.substring(piece, 3, 1).isin("x", "X")
    number = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 8, F.lit(None)).otherwise(
        F.when(base16, F.conv(digits, 16, 10)).otherwise(digits)
    ).try_cast("bigint")
    invalid = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return (
        F.when(invalid, F.lit("�"))
        .when(number.between(128, 159),
              F.substring(F.lit(_WINDOWS_1252), (number - 127).cast("int"), F.lit(1)))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    )


def decode_references(col: Column, in_attribute: bool = False) -> Column:
    """Replace character references. Each piece is decoded once, so ``&amp;lt;`` gives ``&lt;``."""
    pattern = _REFERENCE_IN_ATTRIBUTE if in_attribute else _REFERENCE_IN_TEXT
    names = _names()

    def decode(piece: Column) -> Column:
        name = F.substr(piece, F.lit(2))
        named = F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)
        return (
            F.when(~piece.startswith("&") | (F.length(piece) == 1), piece)
            .when(piece == "&amp;", F.lit("&"))
            .when(piece == "&quot;", F.lit('"'))
            .when(piece == "&lt;", F.lit("<"))
            .when(piece == "&gt;", F.lit(">"))
            .when(piece.startswith("&#"), _numeric(piece))
            .otherwise(F.coalesce(named, piece))
        )

    pieces = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    return F.when(F.contains(col, F.lit("&")), F.array_join(F.transform(pieces, decode), "")).otherwise(col)


def escape_html(col: Column) -> Column:
    """Escape ``& < > "`` for display inside markup."""
    for plain, escaped in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        col = F.replace(col, F.lit(plain), F.lit(escaped))
    return col
