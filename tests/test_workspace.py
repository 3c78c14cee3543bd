"""Node tables in the shared folder of a cluster: no html is moved, and nothing is left behind."""

import os

import pytest

from domgrove.operators import shred as shredding
from domgrove.plans import workspace
from domgrove.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def shared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "shared_folder", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(workspace, "_tables", {})
    yield tmp_path
    workspace.release(spark)


def exchanges_below_join(plan):
    """Exchanges that feed the join of elements with their pages."""
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    return [line for line in lines[join:] if "Exchange" in line]


@pytest.mark.parametrize("name", ["li_html", "nav_full_text"])
def test_html_stays(spark, shared, name):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, FOLDER)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert exchanges_below_join(plan) == []
        assert df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def saved_tables(spark):
    return {t.name for t in spark.catalog.listTables() if t.name.startswith(("nodes_", "pages_"))}


def test_release(spark, shared):
    before = saved_tables(spark)
    workspace.nodes_of(spark, FOLDER).count()
    assert any(n.startswith("nodes_") for n in os.listdir(shared)) and saved_tables(spark) > before
    workspace.release(spark)
    assert not any(n.startswith(("nodes_", "pages_")) for n in os.listdir(shared))
    assert saved_tables(spark) == before


def test_buckets_grow_with_the_pages(spark, shared, monkeypatch):
    # Once there were as many as the session has partitions, whatever the pages take.
    pages = workspace.pages_of(spark, FOLDER)
    total = sum(len(r.html) for r in pages.collect())
    monkeypatch.setattr(shredding, "SHARE_CHARS", total // 40)
    wanted = shredding.partitions_for(pages)
    assert wanted >= 40 and workspace.nodes_of(spark, FOLDER).count() > 0
    for name in workspace._tables[(spark.sparkContext.applicationId, FOLDER)][2]:
        described = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'")
        assert described.first().data_type == str(wanted)


def test_node_table_in_two_stages(spark, shared, monkeypatch):
    """The stage that writes the node table does not cut pages into tokens, too: a whole shred in one
    stage compiles more classes than a session keeps. The table is what a shred gives."""
    plans, save_nodes = [], workspace.save_nodes

    def looked_at(nodes, *rest):
        plans.append(nodes._jdf.queryExecution().executedPlan().toString())
        save_nodes(nodes, *rest)

    monkeypatch.setattr(workspace, "save_nodes", looked_at)
    made = workspace.nodes_of(spark, FOLDER)
    assert len(plans) == 1 and "regexp_extract_all(html" not in plans[0] and "Exchange" not in plans[0]
    whole = shredding.shred(workspace.pages_of(spark, FOLDER))
    assert made.columns == whole.columns
    order = ["page_id", "node_id"]
    assert made.orderBy(*order).collect() == whole.orderBy(*order).collect()
    assert not any(n.startswith("blocks_") for n in os.listdir(shared))
    assert not any(t.name.startswith("blocks_") for t in spark.catalog.listTables())
