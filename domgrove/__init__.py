"""domgrove: structured extraction from large collections of HTML pages, on Spark.

Pages are shredded once into a table of elements; extraction rules, outlines,
selectors and searches are DataFrame operators over that table.
"""

from domgrove.operators.conditions import (
    all_of,
    any_of,
    contains,
    eq,
    has,
    has_text,
    last,
    ne,
    negate,
    nth,
    pos,
    starts_with,
    text_contains,
    text_eq,
)
from domgrove.operators.outline import outline
from domgrove.operators.search import search
from domgrove.operators.selection import Selection
from domgrove.operators.selectors import selectors
from domgrove.operators.shred import open_tags, shred
from domgrove.plans.reports import clipped, coverage, enrich, nesting, not_found
from domgrove.plans.rules import PRESETS, check_rules, rules_from_table, run_rules
from domgrove.session import configure, get_session
from domgrove.sources.pages import read_html_files, read_pages, split_pages
from domgrove.sources.tables import load_nodes, save_nodes, save_pages, write_results
from domgrove.streaming.run import run_stream, stream_results

__all__ = [
    "PRESETS", "Selection", "all_of", "any_of", "check_rules", "clipped", "configure", "contains", "coverage",
    "enrich", "eq", "get_session", "has", "has_text", "last", "load_nodes", "ne", "negate",
    "nesting", "not_found", "nth", "open_tags", "outline", "pos", "read_html_files", "read_pages",
    "rules_from_table", "run_rules", "run_stream", "save_nodes", "save_pages", "search", "selectors",
    "shred", "split_pages", "starts_with", "stream_results",
    "text_contains", "text_eq", "write_results",
]
