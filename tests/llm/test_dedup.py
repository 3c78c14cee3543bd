"""Suffix-array, near and substring dedup against plain versions."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from domgrove.llm import near, substring, suffixes
from domgrove.sources.tables import ensure_checkpoint_dir
import brute


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (brute.order(r[0]), r[1:]))


@settings(max_examples=80, deadline=None)
@given(st.text("abc", min_size=1, max_size=60))
def test_suffixes_smaller_than_the_next(text):
    raw = text.encode()
    made = suffixes.smaller_than_next(np.frombuffer(raw, np.uint8)).tolist()
    assert made == [raw[i:] < raw[i + 1:] for i in range(len(raw))]


def test_anchors_by_small_blocks(monkeypatch):
    # Once all texts at hand went through the arrays of eight bytes a place together, half a million and more.
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 99, 100, 3000, 7, 2500, 101, 9000, 400)]
    whole = sorted(suffixes.anchors_seen(texts, 100, 32).tolist())
    taken, anchored = [], suffixes.anchored
    monkeypatch.setattr(suffixes, "anchored", lambda own, *more: (taken.append(own), anchored(own, *more))[1])
    monkeypatch.setattr(suffixes, "BLOCK", 3000)
    assert sorted(suffixes.anchors_seen(texts, 100, 32).tolist()) == whole
    assert [t for own in taken for t in own] == texts and len(taken) > 1
    assert all(len(own) == 1 or sum(map(len, own)) + len(own) - 1 <= 3000 for own in taken)


@settings(max_examples=80, deadline=None)
@given(st.text("abc", min_size=1, max_size=300), st.sampled_from([16, 104]))
def test_suffix_array(text, depth):
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    made = suffixes.suffix_array(data, depth).tolist()
    assert sorted(made) == list(range(len(raw)))
    assert all(raw[a:a + depth] <= raw[b:b + depth] for a, b in zip(made, made[1:]))
    shared = suffixes.common_prefixes(data, np.array(made), depth).tolist()
    for a, b, n in zip(made, made[1:], shared[1:]):
        x, y = raw[a:a + depth], raw[b:b + depth]
        k = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert n == k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.booleans()), min_size=1, max_size=200), st.sampled_from([16, 208]))
def test_suffix_array_of_some(places, depth):
    """Wanted suffixes come in the order that they have among all."""
    data = np.frombuffer("".join(c for c, _ in places).encode(), np.uint8)
    wanted = np.array([w for _, w in places])
    raw = data.tobytes()
    made = [i for i in suffixes.suffix_array(data, depth, wanted).tolist() if wanted[i]]
    assert sorted(made) == np.flatnonzero(wanted).tolist()
    assert all(raw[a:a + depth] <= raw[b:b + depth] for a, b in zip(made, made[1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=40), min_size=1, max_size=6))
def test_first_strings(texts):
    segments = [t.encode() for t in texts]
    found = suffixes.first_strings(segments, np.arange(len(segments)), np.zeros(len(segments), np.int64), 6)
    seen = set()
    for segment, own in zip(segments, found):
        expected = []
        for i in range(len(segment) - 5):
            if segment[i:i + 6] not in seen:
                seen.add(segment[i:i + 6])
                expected.append(i)
        assert own.tolist() == expected


def bytes_expected(items, size):
    raw = [(d, (t or "").encode()) for d, t in items]
    out = []
    for (d, text), gone in zip(raw, brute.removed(raw, size, None)):
        out.append((d, len(text), sum(gone), brute.spans(gone), brute.sha(bytes(c for c, g in zip(text, gone) if not g))))
    return sorted(out, key=lambda r: (brute.order(r[0]), r[1:]))


@pytest.mark.parametrize("most", [2, 2000])
def test_bytes(spark, small, few_cells, most):
    items = [(r.doc_id, r.text) for r in small.select("doc_id", "text").limit(60).collect()]
    items += [(1000 + i, "q" * i + t[50:400] + "z" * i) for i, (_, t) in enumerate(items[:25])]
    docs = spark.createDataFrame(items, "doc_id long, text string").repartition(4)
    assert rows(suffixes.dedup_bytes(docs, most=most, cells=few_cells).drop("spans")) == bytes_expected(items, 100)


def test_bytes_edges(edges, empty, few_cells):
    items = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect() if len(r.text or "") < 10_000]
    short = edges.filter("coalesce(length(text), 0) < 10000")
    assert rows(suffixes.dedup_bytes(short, cells=few_cells).drop("spans")) == bytes_expected(items, 100)
    assert suffixes.dedup_bytes(edges, cells=few_cells).count() == edges.count()
    assert suffixes.dedup_bytes(empty, cells=few_cells).count() == 0


def words_expected(items, size):
    split = [(d, brute.words(t)) for d, t in items]
    out = []
    for (d, own), gone in zip(split, brute.removed(split, size, None)):
        kept = b" ".join(w for w, g in zip(own, gone) if not g)
        out.append((d, len(own), sum(gone), brute.sha(kept)))
    return sorted(out, key=lambda r: (brute.order(r[0]), r[1:]))


@pytest.mark.parametrize("cells", [1 << 10, 1 << 20])
def test_words(small, cells):
    """Also with a sketch so small that it takes nearly everything for repeated."""
    items = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    assert rows(substring.dedup_words(small.repartition(3), cells=cells).drop("spans")) == words_expected(items, 20)


def test_words_edges(edges, empty, few_cells):
    items = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    assert rows(substring.dedup_words(edges, cells=few_cells).drop("spans")) == words_expected(items, 20)
    assert substring.dedup_words(empty, cells=few_cells).count() == 0


def test_cut_texts(spark, edges, empty, few_cells):
    passage = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"one\n{passage}\ntwo", "a"), (2, f"three {passage}  four\n", "b"), (3, passage, None)],
                                 "doc_id long, text string, gone string")
    kept = {r.doc_id: (r.text, r.gone) for r in substring.cut_repeats(docs, cells=few_cells).collect()}
    assert kept == {1: (f"one\n{passage}\ntwo", "a"), 2: ("three four\n", "b"), 3: ("", None)}
    cut = substring.cut_repeats(edges, cells=few_cells)
    assert cut.columns == edges.columns and cut.count() == edges.count()
    assert substring.cut_repeats(empty, cells=few_cells).count() == 0


def near_expected(items):
    sets = [(d, brute.shingles(t)) for d, t in items]
    found = brute.components(sets)
    return sorted((d, len(s), found[d], d == found[d]) for d, s in sets)


def test_near(spark, small):
    items = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    long = [t for _, t in items if len(t.split()) > 150][:6]
    for k, text in enumerate(long):  # chains of edits around the threshold
        own = text.split()
        for j in range(12):
            own[(j * 17 + k) % len(own)] = f"edit{k}x{j}"
            items.append((5000 + 100 * k + j, " ".join(own)))
    docs = spark.createDataFrame(items, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in near.near_duplicates(docs).collect()) == near_expected(items)


def test_near_blocks(spark, monkeypatch):
    """Many documents around one passage: large buckets, compared block against block."""
    monkeypatch.setattr(near, "BLOCK", 16)
    passage = [f"p{i}" for i in range(60)]
    rng = np.random.default_rng(5)
    items = []
    for d in range(120):
        own = list(passage)
        for i in rng.choice(60, int(rng.integers(0, 8)), replace=False):
            own[i] = f"x{d}y{i}"
        items.append((d, " ".join(own + [f"t{d}z{i}" for i in range(int(rng.integers(0, 25)))])))
    docs = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in near.near_duplicates(docs).collect()) == near_expected(items)


def test_near_edges(edges, empty):
    found = near.near_duplicates(edges).collect()
    assert len(found) == edges.count()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by_id[1] == [(0, 1, True)] and by_id[2] == [(0, 2, True)] and by_id[3] == [(0, 3, True)]
    assert by_id[4] == [(1, 4, True)] and by_id[5] == [(22, 5, True)] and by_id[6] == [(22, 5, False)]
    assert by_id[7] == [(1, 7, True)] * 2 and by_id[8] == [(1, 8, True)] and by_id[10] == [(1, 10, True)]
    assert sorted(by_id[None]) == [(0, None, True), (4, None, True)] and by_id[-5] == [(1, -5, True)]
    assert near.near_duplicates(empty).count() == 0
    kept = near.drop_near_duplicates(edges)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 1


@pytest.mark.parametrize("once", [False, True])
def test_near_rows(spark, once):
    """Rows that share a doc_id or have none are judged one by one."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a + " end"), (5, b), (3, c), (None, c), (None, c + " end"), (7, "x y"), (7, "x y"), (None, ""), (None, ""),
            (8, "u v"), (8, "U V"), (None, "no id"), (None, "no id"), (None, "NO id"), (9, ""), (9, a), (10, b), (10, b)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int").repartition(3)
    kept = near.drop_near_duplicates(docs, once=once)
    assert kept.columns == docs.columns
    found = sorted((brute.order(r.doc_id), r.text.lower()) for r in kept.collect())
    expected = [(1, a), (5, b), (3, c), (None, ""), (None, ""), (9, ""), (7, "x y"), (8, "u v"), (None, "no id")]
    if not once:
        expected += [(7, "x y"), (8, "u v"), (None, "no id"), (None, "no id")]
    assert found == sorted((brute.order(i), t) for i, t in expected)


@pytest.mark.parametrize("once", [False, True])
def test_near_clashing_columns(spark, once):
    """Columns named like those that the operator makes on its way stay as they came."""
    names = ["gone_id", "part", "map", "bit", "_bit", "key", "name", "node", "doc", "row", "id", "root", "best", "kept", "n"]
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text + " end"), (2, "other words"), (3, "x"), (3, "x"), (None, "y z"), (4, None)]
    docs = spark.createDataFrame([(i, t, *[f"{c}{k}" for c in names]) for k, (i, t) in enumerate(rows)],
                                 ", ".join(["doc_id long", "text string", *[f"{c} string" for c in names]]))
    kept = near.drop_near_duplicates(docs, once=once)
    assert kept.schema == docs.schema
    found = sorted((brute.order(r.doc_id), r.text or "") for r in kept.collect())
    expected = [(1, text), (2, "other words"), (3, "x"), (None, "y z"), (4, "")] + [(3, "x")] * (not once)
    assert found == sorted((brute.order(i), t) for i, t in expected)
    assert {r.key[:3] for r in kept.collect()} == {"key"}


def test_near_leaves_no_files(spark, small):
    """Of what is written on the way only what the result is read from stays."""
    ensure_checkpoint_dir(spark)
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.startswith("part-")}

    before = files()
    near.near_duplicates(small.limit(50)).count()
    # One frame is left, of as many partitions as its last join had.
    assert len({os.path.dirname(f) for f in files() - before}) == 1


def test_near_pruning():
    """What bands and pruning lose together of pairs of similarity 0.75 stays below 6 in a million."""
    sizes = np.full(near.REGISTERS + 1, 700.0)
    same = np.arange(near.REGISTERS) < np.arange(near.REGISTERS + 1)[:, None]
    more = ~same & (np.arange(near.REGISTERS) % 2 == 0)
    guess = near.likeliest((~same).astype(int) + more, (~same).astype(int) + (~same & ~more), sizes, sizes)
    pruned = guess < near.PRUNE
    pruned |= np.arange(near.REGISTERS + 1) < (near.PRUNE - 0.05) * near.REGISTERS
    # Registers by number of agreeing ones, apart by whether some band agrees in whole.
    own = np.array([0.75 ** k * 0.25 ** (near.ROWS - k) * c for k, c in enumerate((1, 4, 6, 4, 1))])
    met, unmet = np.zeros(1), np.ones(1)
    for _ in range(near.BANDS):
        met, unmet = (np.convolve(met, own) + np.convolve(unmet, own * [0, 0, 0, 0, 1]),
                      np.convolve(unmet, own * [1, 1, 1, 1, 0]))
    assert unmet.sum() + met[pruned].sum() < 6e-6, (unmet.sum(), met[pruned].sum())


def test_estimates():
    """Likelihood estimates of J lie near the truth, for sets of unlike sizes too."""
    rng = np.random.default_rng(1)
    for n, m, both in ((400, 400, 340), (500, 300, 280), (200, 900, 100)):
        pool = rng.integers(0, 2**63, n + m - both, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n - both:])
        made = near.registers(np.r_[a, b], np.array([0, n, n + m]))
        guess = near.likeliest(made[:1], made[1:], np.array([float(n)]), np.array([float(m)]))[0]
        assert abs(guess - both / (n + m - both)) < 0.13


def test_merged_registers():
    """The sketch of a union is the larger register of two."""
    pool = np.random.default_rng(2).integers(0, 2**63, 300, dtype=np.uint64)
    made = near.registers(np.r_[np.sort(pool[:200]), np.sort(pool[100:])], np.array([0, 200, 400]))
    union = near.registers(np.sort(pool), np.array([0, 300]))
    assert (np.maximum(made[0], made[1]) == union[0]).all()


def test_cells_of_a_sketch_take_two_bytes():
    # Once four.
    draw = np.random.default_rng(1)
    for n in (64, 1 << 15, 1 << 20):
        for share in (0.0, 0.01, 1.0):
            own = np.flatnonzero(draw.random(n) < share)
            twice = draw.random(len(own)) < 0.5
            used = substring.packed_cells(own, twice, n)
            back, flags = substring.unpacked_cells(used, n)
            assert back.tolist() == own.tolist() and flags.tolist() == twice.tolist()
            assert len(used) == 2 * len(own) + 4 * max(1, n >> 15)
