"""Absolute form of links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _without_dots(path: Column) -> Column:
    """Take ``.`` and ``..`` segments out of a path, segment by segment."""
    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )
    segments = F.split(path, "/")
    walked = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)),
        F.array(F.lit("")), step)
    # A path that ends in a dot segment names a folder.
    folder = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.when(path.contains("/."), F.concat(F.array_join(walked, "/"), folder)).otherwise(path)


def resolve_link(base: Column, link: Column) -> Column:
    """`link` as found on a page at `base`; the empty string when the base is no address."""
    link = F.regexp_replace(link, r"^[\s]+|[\s]+$", "")
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)//", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    before_fragment = F.regexp_extract(base, r"^([^#]*)", 1)
    before_query = F.concat(site, path)
    link_path = F.regexp_extract(link, r"^([^?#]*)", 1)
    link_rest = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(site == "", "")
        .when(link == "", base)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("#"), F.concat(before_fragment, link))
        .when(link.startswith("?"), F.concat(before_query, link))
        .when(link.startswith("/"), F.concat(site, _without_dots(link_path), link_rest))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, link_path)), link_rest))
    )
