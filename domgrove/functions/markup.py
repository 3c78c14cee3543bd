"""Text of a piece of markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from domgrove.functions import vocabulary as V
from domgrove.functions.text import collapse, decode_references
from domgrove.functions.tokens import raw_tokens, tag_name

_SILENT = r"^(?i)<(?:" + "|".join(V.SCRIPT_LIKE) + r")(?=[\s/>])"
_OPAQUE = r"^(?i)<(?:" + "|".join(V.RAW_TEXT + V.ESCAPABLE_TEXT) + r")(?=[\s/>])"


def full_text(markup: Column) -> Column:
    """All text in a piece of markup, in order; blocks and line breaks part words."""
    breaks = F.expr(f"array({', '.join(repr(tag) for tag in V.BREAKS_TEXT)})")

    def text_of(token: Column) -> Column:
        return (
            F.when(~token.startswith("<") | (F.length(token) == 1), decode_references(token))
            .when(token.rlike(_SILENT), "")
            .when(token.rlike(_OPAQUE), F.concat(F.lit(" "), decode_references(
                F.regexp_extract(token, r"(?s)^<[^>]*>(.*?)(?:</[^>]*>)?$", 1)), F.lit(" ")))
            .when(F.array_contains(breaks, tag_name(token)), " ")
            .otherwise("")
        )
    return collapse(F.array_join(F.transform(raw_tokens(markup), text_of), ""))
