"""The stages one after the other on a small table with planted cases."""

import zlib

import brute
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from domgrove.llm.common import documents

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()


def test_stages(spark, benchmark):
    docs = documents(spark, FOLDER)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    def done(name, rows):
        out = stages[name](spark, rows, FOLDER).persist()
        assert out.columns == columns
        return out

    calm = done("toxicity", docs)
    assert 0.7 * docs.count() < calm.count() < docs.count()
    near = done("near_dedup", calm)
    found = brute.components([(r.doc_id, brute.shingles(r.text)) for r in calm.collect()])
    assert {r.doc_id for r in near.collect()} == {d for d, c in found.items() if d == c}
    cut = done("substring_dedup", near)
    rows = [(r.doc_id, r.text) for r in near.collect()]
    split = [(d, brute.words(t)) for d, t in rows]
    kept = {d: b" ".join(w for w, g in zip(own, gone) if not g)
            for (d, own), gone in zip(split, brute.removed(split, 20, None))}
    for r in cut.collect():
        assert b" ".join(brute.words(r.text)) == kept[r.doc_id] and r.n_chars == len(r.text)
    clean = done("decontamination", cut)
    leaking = set()
    items = [brute.tokens_of(r.text) for r in benchmark.collect()]
    for r in cut.collect():
        own = brute.tokens_of(r.text)
        for item in items:
            if len(set(zip(item, item[1:])) & set(zip(own, own[1:]))) > len(item) // 4:
                if brute.tiling(own, item, 5)[1] >= 0.5 * len(item):
                    leaking.add(r.doc_id)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - leaking
    packed = stages["packing"](spark, clean, FOLDER)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_sql(spark, name):
    import duckdb
    db = duckdb.connect()
    for view in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{view}.parquet'")
    twin = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in twin.description]
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    def known(rows):
        return sorted(map(tuple, rows), key=lambda r: [(x is not None, x) for x in r])

    assert known(df.select(columns).collect()) == known(twin.fetchall())


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)


def test_same_documents_same_rows(spark):
    first, again = (sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, FOLDER).collect()) for _ in range(2))
    assert zlib.crc32(repr(first).encode()) == zlib.crc32(repr(again).encode())
