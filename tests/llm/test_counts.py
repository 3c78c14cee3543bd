"""Token counts, packing, shards, decontamination, quality and toxicity against plain versions."""

import random
import struct
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from domgrove.llm import (
    binary,
    decontaminate,
    packing,
    quality_classifier,
    quality_rules,
    token_counts,
    toxicity,
)
from domgrove.llm.tokens import Encoder


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def encode():
    return Encoder(limit=50).encode


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r　 '.sta1é²"), st.characters(codec="utf-8")), max_size=60))
def test_ids(tokenizer, encode, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def check_pieces(rows, docs, tokenizer, capacity):
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for doc_id, own in texts.items():
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc_id)
        expected = []
        for text in own:
            ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
            first = len(ids) % capacity or capacity
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            expected += [(k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])))
                         for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert mine == sorted(expected)


@pytest.mark.parametrize("table", ["small", "edges"])
def test_packing(request, tokenizer, table):
    docs = request.getfixturevalue(table)
    rows = packing.pack_documents(docs).collect()
    check_pieces(rows, docs, tokenizer, 1024)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 1024) + 2


def test_packing_empty(empty):
    assert packing.pack_documents(empty).count() == 0


def least_bins(sizes, capacity):
    """By trying everything."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1:])
        go(i + 1, rooms + [capacity - sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bin_completion(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    made = packing.pack(counts, 20)
    used = {}
    for need, m in made:
        assert sum(k * n for k, n in need.items()) <= 20
        for k, n in need.items():
            used[k] = used.get(k, 0) + n * m
    assert used == counts
    assert sum(m for _, m in made) == least_bins(sorted(sizes, reverse=True), 20)


def test_places():
    rng = random.Random(3)
    counts = {rng.randint(1, 1024): rng.randint(1, 50) for _ in range(300)}
    place = packing.places(packing.pack(counts))
    lengths = np.array([k for k, n in counts.items() for _ in range(n)])
    ranks = np.array([i for n in counts.values() for i in range(n)])
    sequence, offset = place(lengths, ranks)
    for s in np.unique(sequence):
        own = sorted(zip(offset[sequence == s].tolist(), lengths[sequence == s].tolist()))
        assert [o for o, _ in own] == [sum(x for _, x in own[:i]) for i in range(len(own))]
        assert sum(x for _, x in own) <= 1024


def plain_count(word, pieces):
    score, n = [0.0], [0]
    for end in range(1, len(word) + 1):
        width = len(word[end - 1].encode())
        options = [(score[end - 1] + token_counts.BYTE_COST * width, -(n[end - 1] + width))]
        options += [(score[a] + pieces[word[a:end]], -(n[a] + 1)) for a in range(end) if word[a:end] in pieces]
        best = max(options)
        score.append(best[0])
        n.append(-best[1])
    return n[-1]


def test_token_counts(small, edges, empty):
    pieces = token_counts.read_pieces()
    for docs in (small.limit(40), edges.filter("coalesce(length(text), 0) < 10000")):
        texts = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str)
        known = {}
        expected = []
        for doc_id, text in texts:
            own = [w.decode() for w in brute.words(text)]
            for w in set(own):
                known.setdefault(w, plain_count("▁" + w, pieces))
            expected.append((doc_id, len(own), sum(known[w] for w in own)))
        assert sorted(map(tuple, token_counts.count_tokens(docs).collect()), key=str) == sorted(expected, key=str)
    assert token_counts.count_tokens(empty).count() == 0


def test_trie_restarts():
    pieces = token_counts.read_pieces()
    words = ["▁" + "".join(random.Random(i).choices("etaoinüß", k=12)) for i in range(200)]
    tiny = token_counts.Trie(pieces, nodes=30, long=5)
    assert [tiny.count(w) for w in words] == [plain_count(w, pieces) for w in words]


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1000, 4097])
def test_permutation(n):
    assert sorted(binary.permute(np.arange(n), n, 7).tolist()) == list(range(n))
    if n > 50:
        assert binary.permute(np.arange(n), n, 7).tolist() != binary.permute(np.arange(n), n, 8).tolist()


def test_shards(small, edges, empty, tokenizer, tmp_path):
    """Every record read back is the tokens of its piece; a read may begin at any slot."""
    for k, docs in enumerate((small, edges)):
        folder = f"file://{tmp_path}/{k}"
        docs = docs.select("doc_id", "text")
        docs.write.parquet(f"{folder}-docs")
        docs = docs.sparkSession.read.parquet(f"{folder}-docs")
        rows = binary.write_shards(docs, folder, shard_bytes=40_000).collect()
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        records = binary.read_slots(folder, 0, len(rows) + 5)
        assert len(records) == len(rows)
        assert (binary.read_slots(folder, 17, 30) == records[17:47]).all()
        for r in rows:
            own = records[r.slot][:r.n_tokens].astype("<u4").tobytes()
            assert zlib.crc32(own) == r.ids_crc32 and (records[r.slot][r.n_tokens:] == 2).all()
        n_tokens = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
        assert sum(r.n_tokens for r in rows) == n_tokens
    folder = f"file://{tmp_path}/none"
    assert binary.write_shards(empty, folder).count() == 0 and len(binary.read_slots(folder, 0, 9)) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=25), st.lists(st.sampled_from("abcd"), min_size=3, max_size=12))
def test_tiling(doc, item):
    items = decontaminate.Items([1], [" ".join(item).encode()], 3)
    found = {(d, i): (n, c) for d, i, n, c in items.found([" ".join(doc).encode()], 0.0)}
    n, covered = brute.tiling(doc, item, 3)
    assert found == ({(0, 0): (n, covered)} if n else {})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.lists(st.sampled_from("ab"), min_size=2, max_size=20), st.sampled_from([1, 3, 1000]))
def test_tiling_of_repetitive_texts(doc, item, size):
    """Whatever the number of seeds in a slice, and with neighbours in the block."""
    held, decontaminate.SLICE = decontaminate.SLICE, size
    try:
        items = decontaminate.Items(["x", "y"], [" ".join(item).encode(), b"a b a b b"], 2)
        found = {(d, i): (n, c) for d, i, n, c in items.found([b"b b a", " ".join(doc).encode(), b"a"], 0.0)}
    finally:
        decontaminate.SLICE = held
    expected = {}
    for d, text in enumerate((["b", "b", "a"], doc, ["a"])):
        for i, own in enumerate((item, ["a", "b", "a", "b", "b"])):
            n, covered = brute.tiling(text, own, 2)
            if n:
                expected[d, i] = (n, covered)
    assert found == expected


def test_tiling_of_one_word():
    """A text and an item of one word each: runs, not pairs of places, are kept."""
    import tracemalloc
    items = decontaminate.Items(["x"], [b"la " * 1000], 5)
    tracemalloc.start()
    found = list(items.found([b"la " * 40_000], 0.5))
    assert found == [(0, 0, 1, 1000)] and tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_short_items():
    """Items without seeds are looked for as a whole, if they are long enough to mean something."""
    texts = ["\u6e2c\u8a66\u984c\u76ee\u7b54\u6848", "what is photosynthesis exactly", "word", "a b c d", "", "..."]
    items = decontaminate.Items(list("abcdef"), [t.encode() for t in texts], 5)
    docs = [texts[0], f"x {texts[0]} y", f"x{texts[0]}", "So: What is photosynthesis, exactly?", "what is photosynthesis", "word", "a b c d"]
    assert sorted(items.found([d.encode() for d in docs], 0.5)) == [(0, 0, 1, 1), (1, 0, 1, 1), (3, 1, 1, 4)]


def test_leaks(spark, small, benchmark):
    texts = [(r.doc_id, r.text) for r in small.select("doc_id", "text").limit(80).collect()]
    items = [(r.item_id, r.text) for r in benchmark.select("item_id", "text").collect()]
    planted = []
    for k, (_, text) in enumerate(items[:8]):
        own = text.split()
        half = len(own) // 2
        planted.append((9000 + k, f"{texts[k][1]} {' '.join(own[half:])} in between {' '.join(own[:half])} end"))
    docs = spark.createDataFrame(texts + planted + [(1, None), (2, "")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert {(9000 + k, items[k][0]) for k in range(8)} <= found
    split = [(item_id, brute.tokens_of(item)) for item_id, item in items]
    grams = [(item_id, own, set(zip(*(own[k:] for k in range(5))))) for item_id, own in split]
    for doc_id, text in texts + planted:
        tokens = brute.tokens_of(text)
        mine = set(zip(*(tokens[k:] for k in range(5))))
        for item_id, own, theirs in grams:
            covered = brute.tiling(tokens, own, 5)[1] if mine & theirs else 0
            assert ((doc_id, item_id) in found) == (covered >= 0.5 * len(own) and covered > 0)
    kept = {r.doc_id for r in decontaminate.drop_leaking(docs, benchmark).collect()}
    assert kept == {d for d, _ in texts + planted + [(1, None), (2, None)]} - {d for d, _ in found}


def test_leaks_edges(spark, edges, empty, benchmark, monkeypatch):
    odd = benchmark.unionByName(spark.createDataFrame([(None, None), (500, ""), (501, "word"), (None, "la la la la la la")],
                                                      "item_id long, text string"))
    found = decontaminate.leaks(edges, odd).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(10, None)}
    again = odd.unionByName(odd.filter("text LIKE 'la%'").withColumn("item_id", F.lit(7).cast("long")))
    assert sorted((r.doc_id, r.item_id or 0) for r in decontaminate.leaks(edges, again).collect()) == [(10, 0), (10, 7)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)  # several blocks of items
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(edges, odd).collect()} == {(10, None)}
    kept = decontaminate.drop_leaking(edges, odd)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 1
    assert decontaminate.leaks(empty, odd).count() == 0 and decontaminate.leaks(edges, odd.filter("false")).count() == 0


def test_rule_counts(small, edges, empty, labels):
    for docs in (small, edges):
        rows = quality_rules.judge(docs, labels).collect()
        texts = {}
        for r in docs.select("doc_id", "text").collect():
            texts.setdefault(r.doc_id, []).append(r.text)
        assert len(rows) == docs.count()
        for r in rows:
            own = [brute.rule_counts(t) for t in texts[r.doc_id]]
            assert {k: r[k] for k in own[0]} in own
            failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert r.base_failed == failed and not (failed and r.kept)
    assert quality_rules.judge(empty, labels).count() == 0
    assert not any(r.kept and r.base_failed for r in quality_rules.judge(edges, labels.filter("false")).collect())


def test_quality_verdicts(spark):
    from domgrove.llm.common import documents, table
    folder = "/root/testdata/sf0.01"
    docs, labels = documents(spark, folder), table(spark, folder, "labels")
    known = {r.doc_id: r.quality for r in labels.collect()}
    judged = [r for r in quality_rules.judge(docs, labels).collect() if r.doc_id in known]
    good = [r.kept for r in judged if known[r.doc_id] == 1 and not r.base_failed]
    bad = [r.kept for r in judged if known[r.doc_id] == 0]
    assert np.mean(good) > 0.93 and np.mean(bad) < 0.1
    rows = quality_classifier.judge(docs, labels).collect()
    right = [r.kept == (known[r.doc_id] == 1) for r in rows if r.doc_id in known]
    assert len(rows) == docs.count() and np.mean(right) > 0.95


def test_forest_is_fitted_on_all_labelled_rows(spark):
    # Bad rows stand behind the first 20,000 in the order of the hash, which once were all that counted.
    order = W.partitionBy().orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = (spark.range(21_000).withColumnRenamed("id", "doc_id").withColumn("place", F.row_number().over(order))
            .withColumn("quality", (F.col("place") <= 20_500).cast("int"))
            .selectExpr("doc_id", "quality", "60 + doc_id % 300 AS n_words", "5 * n_words + doc_id % 7 AS word_chars",
                        "IF(quality = 1, doc_id % 2, n_words + doc_id % 50) AS n_symbols", "0L AS n_dup_lines",
                        "doc_id % 3 AS n_repeat_words", "3L AS n_lines").coalesce(4).persist())
    labels = rows.select("doc_id", "quality")
    forest = quality_rules.fit(rows.drop("quality"), labels)
    local = rows.toPandas()
    known = quality_rules.features({c: local[c].to_numpy() for c in quality_rules.COUNTS})
    good, bad = known[local.quality == 1], known[local.quality == 0]
    # Weights and threshold are those of all rows.
    under = [np.mean(np.searchsorted(np.sort(g), b, "left") + np.searchsorted(np.sort(g), b, "right")) / len(g)
             for g, b in zip(good.T, bad.T)]
    assert np.allclose(quality_rules.separation(rows, len(good), len(bad)), 0.02 + (np.array(under) - 1) ** 2)
    high, low = np.sort(forest.scores(good)), np.sort(forest.scores(bad))
    marks = np.unique(np.r_[high, low])
    gain = 2 * len(bad) * np.searchsorted(high, marks) - len(good) * np.searchsorted(low, marks)
    best = int(np.argmax(gain))
    assert forest.threshold == (marks[best] + marks[max(0, best - 1)]) / 2
    assert (low >= forest.threshold).mean() > 0.9 and (high >= forest.threshold).mean() < 0.1
    # Every tree has rows of its own, of both parts.
    drawn = quality_rules.draw(rows, 21_000, 5, 512).to_pandas()
    assert (drawn.groupby("tree").size() == 512).all()
    assert len(quality_rules.draw(rows.limit(1).crossJoin(spark.range(3000)), 3000, 2, 512)) == 1024


def test_classifier_edges(edges, empty, labels):
    rows = quality_classifier.judge(edges, labels).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.judge(empty, labels).count() == 0
    assert {round(r.score, 6) for r in quality_classifier.judge(edges, labels.filter("false")).collect()} == {0.5}


def test_shrinkage(spark):
    """A site with one bad page stays near the prior; one with many goes its own way."""
    rows = [(i, "word " * 60, "good" if i % 10 else "mixed", "p") for i in range(300)]
    rows += [(1000 + i, "word " * 60, "bad", "p") for i in range(100)] + [(2000, "word " * 60, "once", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in rows if i != 2000 and i % 3], "doc_id long, quality int")
    score = {r.doc_id: r.score for r in quality_classifier.judge(docs, labels).collect()}
    assert score[3] > 0.8 and score[1002] < 0.5 and score[1002] < score[2000] < score[3]


def test_toxicity(spark):
    from domgrove.llm.common import documents, table
    folder = "/root/testdata/sf0.1"
    docs, labels = documents(spark, folder), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels)
    docs = docs.join(labels, "doc_id", "left_semi")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score(docs, model).collect()
            if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    kinds = np.array([known[r.doc_id] for r in rows])
    scores = np.array([r.score for r in rows])
    toxic, calm = scores[kinds == 1], scores[kinds == 0]
    # Some 7 of 97 toxic labels stand at texts that hold nothing toxic, which bounds all three.
    assert (toxic[:, None] > calm).mean() > 0.93
    assert (toxic >= 0.5).mean() > 0.85 and (calm < 0.5).mean() > 0.98


def test_windows_that_tell():
    """Of thousands of windows that chance spreads over few toxic documents none is taken."""
    draw = random.Random(3)
    toxic = [" ".join(draw.choices([f"w{k}" for k in range(5000)], k=60)) + " vile" * (i % 4 == 0) for i in range(300)]
    calm = [" ".join(draw.choices([f"w{k}" for k in range(5000)], k=60)) for _ in range(2000)]
    texts = [t.encode() for t in toxic + calm]
    content, pairs = toxicity.train_dictionaries(texts, [1] * 300 + [0] * 2000)
    assert b" vile " in content[0] and content[0].count(b" w") <= 2 and not pairs


def test_surprise():
    from itertools import combinations
    for bad, usual, n_bad, n_usual in [(2, 1, 3, 4), (0, 3, 2, 5), (3, 0, 3, 3), (1, 1, 1, 6)]:
        draws = list(combinations([1] * n_bad + [0] * n_usual, bad + usual))
        share = sum(sum(d) >= bad for d in draws) / len(draws)
        assert toxicity.surprise(np.array([bad]), np.array([usual]), n_bad, n_usual)[0] == pytest.approx(share)


def test_toxicity_edges(edges, empty, small, labels):
    model = toxicity.fit(small, labels)
    rows = toxicity.score(edges, model).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, model).count() == 0
    kept = toxicity.drop_toxic(edges, model)
    assert kept.columns == edges.columns and kept.schema == edges.schema
    for none in (labels.filter("false"), labels.filter("toxic = 0")):
        assert {r.score for r in toxicity.score(edges, toxicity.fit(small, none)).collect()} == {0.0}


def noisy(spark, kind):
    """Documents of ordinary words with labels, every 25th of them wrong, and what makes some toxic."""
    draw = random.Random(7)
    usual = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("n", "r", "st", "p", "lo", "va")]
    chars = [chr(0x4E00 + i) for i in range(60)]
    docs, labels, real = [], [], []
    for i in range(500):
        toxic = i % 3 == 0
        if kind == "no spaces":
            text = "".join(draw.choices(chars, k=80))
            text = text[:30] + "\u7121\u8cf4\u7121" + text[30:] if toxic else text
        else:
            own = draw.choices(usual, k=60)
            if kind == "words":
                own[20:20] = ["vilest"] if toxic else []
            else:  # all have both words, toxic ones side by side
                own[20:20] = ["trash", "people"] if toxic else ["trash", *draw.choices(usual, k=3), "people"]
            text = " ".join(own)
        docs.append((i, text))
        real.append(int(toxic))
        labels.append((i, int(toxic) ^ int(i % 25 == 0)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"), real)


@pytest.mark.parametrize("kind", ["words", "pairs", "no spaces"])
def test_toxicity_of_noisy_labels(spark, kind):
    docs, labels, real = noisy(spark, kind)
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    kinds, told = np.array([real[r.doc_id] for r in rows]), np.array([r.predicted for r in rows])
    assert np.mean(told == kinds) > 0.95


def test_toxicity_of_repeated_ids(spark, small, labels, monkeypatch):
    """However many rows a labelled doc_id has, one comes to the driver."""
    used = []
    train = toxicity.train_dictionaries
    monkeypatch.setattr(toxicity, "train_dictionaries", lambda texts, *more: used.append(len(texts)) or train(texts, *more))
    several = small.unionByName(small.withColumn("text", F.concat("text", F.lit(" more")))).unionByName(small)
    toxicity.fit(several, labels)
    n_ids = small.join(labels.filter(~toxicity.held_out(labels.doc_id)), "doc_id").select("doc_id").distinct().count()
    assert used[0] == n_ids > 0


def test_labels_that_contradict(spark, small, labels):
    twice = labels.unionByName(labels.withColumn("toxic", 1 - labels.toxic))
    assert toxicity.fit(small, twice).dictionaries is None
