"""What a result looks like, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BADGE_ATTRIBUTES = ["title", "href", "src", "data-src", "data-original", "alt", "class", "id"]
MAX_BADGES = 6
LINE_WIDTH = 40
LONG_LINES = 3


def badges(value: Column) -> Column:
    """Attribute names a result speaks of: ``@names`` in it, else well-known ones found in it."""
    lower = F.lower(value)
    named = F.array_distinct(F.transform(
        F.regexp_extract_all(value, F.lit(r"@(\w[\w-]*)"), F.lit(1)),
        lambda n: F.concat(F.lit("@"), n)))
    speaks_of_text = lower.contains("text()") | lower.contains('text="')
    explicit = F.when(speaks_of_text, F.array_append(named, F.lit("text()"))).otherwise(named)
    common = F.transform(
        F.filter(F.array(*[F.lit(a) for a in BADGE_ATTRIBUTES]), lambda a: F.contains(lower, a)),
        lambda a: F.concat(F.lit("@"), a))
    chosen = F.when(F.size(explicit) > 0, explicit).otherwise(common)
    return F.array_join(F.slice(chosen, 1, MAX_BADGES), "  ")


def line_estimate(value: Column) -> Column:
    """Lines of a result when shown: one more than the full lines in every line of it."""
    per_line = F.transform(F.split(value, "\n", -1),
                           lambda line: F.floor(F.length(line) / LINE_WIDTH).cast("int") + 1)
    return F.when(value == "", 0).otherwise(
        F.aggregate(per_line, F.lit(0), lambda total, lines: total + lines))


def is_long(value: Column) -> Column:
    return line_estimate(value) > LONG_LINES


def looks_like_html(value: Column) -> Column:
    trimmed = F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return (
        trimmed.contains("<") & trimmed.contains(">")
        & (trimmed.contains("</") | trimmed.startswith("<!") | trimmed.startswith("<?xml")
           # the whole of a single line
           | trimmed.rlike(r"\A.*<[a-zA-Z!?][^>]*>.*\z"))
    )
