"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from domgrove.operators.shred import shred
from domgrove.plans.queries import QUERIES
from domgrove.plans.workspace import pages_of
from domgrove.session import get_session

CPUS = os.environ.get("BENCH_CPUS", "8")
FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
MEMORY = os.environ.get("BENCH_DRIVER_MEMORY", "12g")


def run(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    spark = get_session(f"local[{CPUS}]", int(CPUS), {
        "spark.driver.memory": MEMORY, "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    times: dict[str, float] = {}
    pages = pages_of(spark, FOLDER)
    n_pages = pages.count()
    run(pages)

    # Shredding alone, cold (first use of every class) and warm.
    times["shred_cold"] = run(shred(pages))
    times["shred_warm"] = min(run(shred(pages)) for _ in range(2))

    # The node table is made once, with the first query that needs it.
    began = time.perf_counter()
    run(QUERIES["tree"](spark, FOLDER))
    times["node_table"] = time.perf_counter() - began

    names = ["links", "tag_census", "nav_links", "under_article", "parents_of_li", "div_ad",
             "and_or", "text_contains", "article_paras", "attr_pairs", "li_html", "nav_full_text",
             "abs_links", "count_links", "rule_set", "coverage", "not_found", "reports_on_text",
             "outline", "selectors", "search"]
    for name in names:
        began = time.perf_counter()
        run(QUERIES[name](spark, FOLDER))
        times[name] = time.perf_counter() - began

    total = sum(v for k, v in times.items() if k != "shred_cold")
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(total, 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()}, "sf": FOLDER.rsplit("sf", 1)[-1],
        "pages": n_pages, "cpus": int(CPUS),
        "pages_per_sec_shred": round(n_pages / times["shred_warm"], 1),
    }))


if __name__ == "__main__":
    main()
