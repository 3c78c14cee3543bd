"""Conversation tries and Merkle manifests against plain versions."""

import random

import brute
import pytest

from domgrove.llm import conversations, merkle
from domgrove.llm.common import documents, table

SMALL = "/root/testdata/sf0.001"


def known(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x) for x in r])


#: conv_id, turn, role, text: nulls, ties, repeated rows, families with and without a first conversation.
TURNS = [
    (0, 0, "user", "a b"), (0, 1, "bot", "c"), (0, 2, "user", "d e f"), (0, 3, "bot", "g"),
    (1, 0, "user", "x"), (1, 1, "bot", "y z"), (1, 2, "user", "d e f"), (1, 3, "bot", "g"),
    (2, None, None, None), (2, None, None, None), (2, 5, "user", ""), (2, 5, "bot", "  \t"), (2, 5, "user", "u"),
    (3, 0, "user", "a b"), (4, 0, "user", "a b"), (7, 0, "only", "one"), (8, 0, "u", "v"), (8, 1, "u", "v"), (8, 2, "u", "v"),
    (25, 0, "x", "no first of the family"), (25, 1, "x", "second"), (26, 0, "x", "y"), (27, 1, "q", "r"), (27, 0, "q", "r"),
    (None, 0, "user", "a b"), (None, None, None, None), (-3, 0, "user", "a b"), (-23, 0, "n", "e g"), (-20, 0, "n", "e g"),
    *[(40 + i, t, "u", f"w{min(t, i)} x") for i in range(12) for t in range(6)],
]


@pytest.mark.parametrize("band", [2, 8])
def test_trie_of_odd_rows(spark, band):
    rows = [(c, t, r, x, k, None) for k, (c, t, r, x) in enumerate(TURNS)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key int, depth string").repartition(5)
    assert known(conversations.prefix_trie(made, band=band).collect()) == known(brute.trie(TURNS))
    assert conversations.prefix_trie(made.filter("false")).count() == 0


def test_trie_of_deep_conversations(spark):
    """More tiers than one, a conversation with most of the rows, and texts that are long."""
    draw = random.Random(1)
    rows = [(0, t, "u", f"turn {t % 7}") for t in range(300)]
    for c in range(1, 30):
        keep = draw.randrange(0, 90)
        rows += [(c, t, "u", f"turn {t % 7}" if t < keep else f"own {c} {t}") for t in range(keep + draw.randrange(0, 9))]
    rows.append((31, 0, "u", "word " * 200_000))
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert known(conversations.prefix_trie(made, band=3).collect()) == known(brute.trie(rows))


def test_ends_of_many(spark):
    """Ids that end at one node are hashed in order, over parts and strings of few."""
    rows = [(i, 0, 0, "k" if i % 3 else "l") for i in random.Random(2).sample(range(-400, 400), 700)]
    turns = spark.createDataFrame(rows, "conv_id long, depth long, total long, key string").repartition(7)
    turns = turns.withColumn("key", turns.key.cast("binary"))
    found = {bytes(r.key).decode(): r.ends_sha256 for r in conversations.ends(turns, chunk=4).collect()}
    for key in "kl":
        assert found[key] == brute.sha(",".join(str(i) for i in sorted(r[0] for r in rows if r[3] == key)).encode())


def test_trie_of_table(spark):
    rows = table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text")
    assert known(conversations.prefix_trie(rows).collect()) == known(brute.trie([tuple(r) for r in rows.collect()]))


#: doc_id, source, lang, n_chars, text: nulls in every column, repeated rows, rows that share a doc_id, one of a language.
LEAVES = [
    (1, "s", "en", 3, "abc"), (1, "s", "en", 3, "abc"), (1, "s", "en", 4, "abcd"), (None, "s", "en", 2, "no"), (None, None, None, None, None),
    (None, None, None, None, None), (2, None, "de", 1, "\u00fc"), (3, "s", "de", None, "null n_chars"), (4, "s", "\u00e9t", 0, ""),
    (5, "s", "", 0, None), (-7, "s", "en", 2**63 - 1, "most"), *[(i, "s", "en", i, f"t{i}") for i in range(10, 47)],
    (60, "long", "fr", 9, "word " * 400_000), (7, "s", "zz", 5, "seven"), (12, "x:1", "z-", 0, "-"),
]


@pytest.mark.parametrize("bits, digits", [(4, 3), (1, 2), (2, 1)])
def test_manifest_of_odd_rows(spark, monkeypatch, bits, digits):
    """Blocks of few leaves give several tiers."""
    monkeypatch.setattr(merkle, "BITS", bits)
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rows = [(*r, k, None) for k, r in enumerate(LEAVES)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, hash int, rank string").repartition(5)
    expected = brute.merkle([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in LEAVES])
    assert known(merkle.checked(docs).collect()) == known(expected)
    assert merkle.checked(docs.filter("false")).count() == 0
    one = merkle.checked(docs.filter("doc_id = 60")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == brute.joined()


def test_manifest_of_table(spark):
    docs = documents(spark, SMALL)
    rows = merkle.checked(docs).collect()
    assert known(rows) == known(brute.merkle([r.asDict() for r in docs.collect()]))
    assert {r.verified for r in rows} == {True, False}


def test_proofs_by_hand(spark):
    """A user who has a leaf, its siblings and spot can fold them without the table."""
    for r in merkle.manifest(documents(spark, SMALL).limit(40)).collect():
        now = r.hash
        for level, s in enumerate(r.siblings):
            now = brute.joined(now) if s is None else brute.joined(s, now) if r.spot >> level & 1 else brute.joined(now, s)
        assert now == r.root
