"""The n-gram join against all pairs."""

from functools import partial

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from domgrove.llm import ngram_join


def expected(items):
    sets = [(d, brute.shingles(t, 4)) for d, t in items]
    found = brute.components(sets, 85)
    return sorted((d, len(s), found[d]) for d, s in sets)


def found(docs, few_cells):
    return sorted(tuple(r) for r in ngram_join.similar(docs, cells=few_cells).collect())


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 80), min_size=1), st.sets(st.integers(0, 80), max_size=6), st.sets(st.integers(0, 80), max_size=6),
       st.lists(st.integers(0, 300), min_size=16, max_size=16), st.sampled_from([60, 75, 85, 100]))
def test_prefixes_share_enough(common, less, more, counts, percent):
    """Alike sets share as many prefix shingles as the smaller m of both, whatever the counters say."""
    x, y = common - less, common | more
    if not x or 100 * len(x & y) < percent * len(x | y):
        return
    order = ngram_join.Order(np.array(counts, np.uint32), percent)
    sets = [np.array(sorted(s), np.uint64) for s in (x, y)]
    tokens, begin, m, n = order.prefixes(np.concatenate(sets), np.r_[0, len(x), len(x) + len(y)])
    assert n.tolist() == [len(x), len(y)] and (m >= 1).all()
    fewer = int(m.min())
    cut = [set(tokens[begin[i]:begin[i] + n[i] - -(-percent * n[i] // 100) + fewer].tolist()) for i in (0, 1)]
    assert len(cut[0] & cut[1]) >= fewer


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**63), min_size=1), st.sets(st.integers(0, 2**63)))
def test_parity_never_tells_too_much(x, y):
    odd = [np.frombuffer(ngram_join.parity(np.array(sorted(s), np.uint64), 64), np.uint8) for s in (x, y)]
    assert np.bitwise_count(odd[0] ^ odd[1]).sum() <= len(x ^ y)


def test_parity_of_large_sets():
    """Bits grow with the sets, and stay several times the number that alike ones may differ in."""
    n = np.array([1, 10, 1000, 2000, 5000, 40_000, 10**6])
    bits = ngram_join.parity_bits(ngram_join.classes(n, 85), 85)
    assert (np.diff(bits) >= 0).all() and (bits >= ngram_join.PARITY).all() and (bits >= 5 * 0.0811 * 2 * n).all()


def test_prefix_of_common_shingles_is_longer():
    """A set that many others would meet asks for more shared shingles; a rare one for one."""
    held = np.ones(1 << 10, np.uint32)
    held[:512] = 5000
    order = ngram_join.Order(held, 85)
    common, rare = (np.arange(a, a + 200, dtype=np.uint64) for a in (0, 600))
    assert order.prefixes(common, np.array([0, 200]))[2][0] > 1 and order.prefixes(rare, np.array([0, 200]))[2][0] == 1


@pytest.mark.parametrize("percent", [50, 75, 85, 100])
def test_classes_of_sizes(percent):
    """Sizes that may be alike are of one class or of neighbouring ones."""
    n = np.arange(1, 3000)
    for size in n.tolist():
        alike = n[(n <= size) & (100 * n >= percent * size)]
        assert np.abs(ngram_join.classes(alike, percent) - ngram_join.classes(np.array([size]), percent)).max() <= 1


def test_in_company(spark):
    """Copies count once, and groups that end with a batch or reach over several are told right."""
    rng = np.random.default_rng(4)
    rows = [(int(k), bool(k % 2), bytes([int(v)]) * 16, 5, 1) for k, v in zip(rng.integers(0, 60, 150), rng.integers(0, 4, 150))]
    rows += [(100, True, bytes([9]) * 16, 5, 1)] * 40 + [(101, True, bytes([i]) * 16, 5, 1) for i in range(40)]
    df = spark.createDataFrame(rows, ngram_join.POSTING).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = [(r.key, bytes(r.node)) for r in ngram_join.in_company(df).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    nodes = {}
    for k, _, name, _, _ in rows:
        nodes.setdefault(k, set()).add(name)
    assert sorted(found) == sorted((k, name) for k, own in nodes.items() if len(own) > 1 for name in own)


def test_edits(spark, small, few_cells):
    items = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    long = [t for _, t in items if len(t.split()) > 150][:6]
    for k, text in enumerate(long):  # chains of edits around the threshold
        own = text.split()
        for j in range(10):
            own[(j * 17 + k) % len(own)] = f"edit{k}x{j}"
            items.append((5000 + 100 * k + j, " ".join(own)))
    docs = spark.createDataFrame(items, "doc_id long, text string").repartition(4)
    assert found(docs, few_cells) == expected(items)


@pytest.mark.parametrize("block", [8, 512])
def test_around_one_passage(spark, monkeypatch, few_cells, block):
    """Large buckets without a document that all are like, compared block against block."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(5)
    items = []
    for d in range(90):
        own = [f"p{i}" for i in range(60)]
        for i in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            own[i] = f"x{d}y{i}"
        items.append((d, " ".join(own + [f"t{d}z{i}" for i in range(int(rng.integers(0, 12)))])))
    docs = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    got = found(docs, few_cells)
    assert got == expected(items) and len({r[2] for r in got}) > 2


def test_full_sets_of_links_only(spark, monkeypatch, few_cells):
    """Documents that share prefixes and are not alike are told by their parities, before full sets are made."""
    asked, full_sets = [], ngram_join.full_sets

    def counting(needed, *rest):
        asked.append(needed.count())
        return full_sets(needed, *rest)

    monkeypatch.setattr(ngram_join, "full_sets", counting)
    monkeypatch.setattr(ngram_join, "counted", partial(ngram_join.counted, counters=16))
    items = [(2 * k + j, " ".join([f"c{k}w{i}" for i in range(60)] + [f"k{k}j{j}w{i}" for i in range(60)])) for k in range(30) for j in (0, 1)]
    items += [(100 + j, " ".join([f"v{i}" for i in range(400)] + [f"j{j}w{i}" for i in range(20)])) for j in (0, 1)]
    # One of the next class of sizes, with more bits.
    items += [(200 + j, " ".join(f"u{i}" for i in range(285 + 45 * j))) for j in (0, 1)]
    docs = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    assert found(docs, few_cells) == expected(items)
    assert asked == [4, 0]


def test_odd_rows(edges, empty, few_cells):
    rows = ngram_join.similar(edges, cells=few_cells).collect()
    assert len(rows) == edges.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by_id[1] == [(0, 1)] and by_id[2] == [(0, 2)] and by_id[3] == [(0, 3)] and by_id[4] == [(1, 4)]
    assert by_id[5] == [(23, 5)] and by_id[6] == [(23, 5)] and by_id[7] == [(1, 7)] * 2 and by_id[10] == [(1, 10)]
    assert by_id[12] == [(2, 12)] and by_id[-5] == [(2, -5)] and sorted(by_id[None]) == [(0, None), (5, None)]
    assert ngram_join.similar(empty, cells=few_cells).count() == 0
