import pytest

from domgrove.llm.common import documents, table

SMALL = "/root/testdata/sf0.001"

#: doc_id, text: null, empty, blank, one word, repeated rows, ties, long, odd characters.
EDGES = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (4, "word"), (5, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (7, "Zeile\nZeile\nZeile\n\nend"), (7, "Zeile\nZeile\nZeile\n\nend"),
    (8, "=" * 500), (9, "x" * 3000), (10, "la " * 2000), (None, "no id at all but some words here"), (None, None),
    (11, "é ü  　 x y 𝒳 <|endoftext|> #*$%&|<>"), (12, "lorem ipsum " * 30_000), (-5, "a b c d e"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Documents of all odd kinds, with other columns named like results, some of them null."""
    rows = [(i, t, None if k % 2 else "x", k, None, "s" if k % 3 else None, None if k % 4 else "de")
            for k, (i, t) in enumerate(EDGES)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, node string, score int, kept boolean, source string, lang string").repartition(3)


@pytest.fixture(scope="session")
def empty(edges):
    return edges.filter("false")


@pytest.fixture(scope="session")
def small(spark):
    return documents(spark, SMALL)


@pytest.fixture(scope="session")
def labels(spark):
    return table(spark, SMALL, "labels")


@pytest.fixture(scope="session")
def benchmark(spark):
    return table(spark, SMALL, "benchmark")


@pytest.fixture(scope="session")
def few_cells():
    """A small sketch: tests would spend their time on clearing a large one."""
    return 1 << 20
