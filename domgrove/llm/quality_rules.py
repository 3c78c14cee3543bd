"""Quality rules: an isolation forest on rule statistics.

Tasks compute the statistics of whole texts. As in every isolation forest, each tree is grown on a
few rows, drawn for it out of all labelled ones: each split takes a random statistic, those more
often that alone tell good rows from bad ones, and a random value between the least and the largest.
A document that few splits tell from the rest has a short mean path and is anomalous; the score is
2**(-path / expected path). How well a statistic tells rows apart is measured on all labelled rows,
and so is the threshold: the score that best tells bad rows from good ones (share of bad ones caught
less twice the share of good ones hit).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domgrove.llm.common import arrow_map, map_rows
from domgrove.llm.ranks import beside, dealt, runs
from domgrove.llm.text import Block, covered, in_blocks, prefix, range_hash
from domgrove.sources.tables import cut_lineage, forget

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Columns of `features`.
N_FEATURES = 5


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text."""
    parts = [_statistics(texts[a:b]) for a, b in in_blocks(texts)]
    return {c: np.concatenate([p[c] for p in parts]) for c in COUNTS}


def _statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    block = Block(texts)
    data, n = block.data, len(texts)
    ends = block.begins + np.fromiter(map(len, texts), np.int64, n)

    def per_text(mask):
        total = np.r_[0, np.cumsum(mask)]
        return total[ends] - total[block.begins]

    letters = (data & 0xC0) != 0x80
    space = (data == 32) | ((data >= 9) & (data <= 13))
    # Lines: between newlines; the one that joins two texts belongs to neither.
    breaks = np.flatnonzero(data == 10)
    line, end = np.r_[0, breaks + 1], np.r_[breaks, len(data)]
    words_before = np.searchsorted(block.starts, np.c_[line, end])
    real = words_before[:, 1] > words_before[:, 0]
    line, end = line[real], end[real]
    owner = np.searchsorted(block.begins, line, side="right") - 1
    hashes = range_hash(prefix(data.astype(np.uint64) + np.uint64(1), 0), line, end)
    order = np.lexsort((hashes, owner))
    again = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    # Windows of three words.
    starts = block.windows(3)
    triple = range_hash(prefix(block.hashes(), 1), starts, starts + 3)
    doc = block.doc[starts] if len(starts) else starts
    by = np.lexsort((triple, doc))
    same = (triple[by][1:] == triple[by][:-1]) & (doc[by][1:] == doc[by][:-1])
    twice = by[np.r_[False, same] | np.r_[same, False]] if len(by) else by
    repeated = covered(starts[twice], 3, len(block.doc))
    return {"n_words": block.n_words, "word_chars": per_text(letters & ~space),
            "n_symbols": per_text(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))),
            "n_dup_lines": np.bincount(owner[order][1:][again], minlength=n),
            "n_repeat_words": np.diff(np.r_[0, np.cumsum(repeated)][block.first]),
            "n_lines": np.bincount(owner, minlength=n)}


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """What trees split on: shares, so that the length of a text counts once."""
    words = np.maximum(c["n_words"], 1)
    return np.stack([np.log1p(c["n_words"]), c["word_chars"] / words,
                     np.log1p(20 * c["n_symbols"] / words),
                     c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
                     c["n_repeat_words"] / words], axis=1).astype(float)


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search in a random binary tree of n leaves."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1),
                    np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: statistic (-1 for a leaf), value, left and right child, path of a leaf."""

    trees: list[tuple[np.ndarray, ...]]
    sample: int
    threshold: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        path = np.zeros(len(rows))
        for which, value, left, right, depth in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                inner = np.flatnonzero(which[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = np.where(rows[inner, which[node]] < value[node], left[node], right[node])
            path += depth[at]
        return 2 ** (-path / max(1, len(self.trees)) / max(1e-9, float(expected_path(self.sample))))


def grow(rows: np.ndarray, rng: np.random.Generator, most: int, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    nodes: list[list] = []
    todo = [(np.arange(len(rows)), 0, None)]
    while todo:
        own, depth, parent = todo.pop()
        if parent is not None:
            nodes[parent[0]][parent[1]] = len(nodes)
        spread = [k for k in range(rows.shape[1]) if len(own) > 1 and np.ptp(rows[own, k]) > 0]
        if depth >= most or not spread:
            nodes.append([-1, 0.0, 0, 0, depth + float(expected_path(len(own)))])
            continue
        k = int(rng.choice(spread, p=weight[spread] / weight[spread].sum()))
        low, high = rows[own, k].min(), rows[own, k].max()
        value = rng.uniform(low, high)
        nodes.append([k, value, 0, 0, 0.0])
        here = len(nodes) - 1
        under = rows[own, k] < value
        todo += [(own[~under], depth + 1, (here, 3)), (own[under], depth + 1, (here, 2))]
    return tuple(np.array(x) for x in zip(*nodes))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row."""
    return map_rows(docs, lambda: statistics, ", ".join(f"{c} long" for c in COUNTS))


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def told(rows: DataFrame) -> DataFrame:
    """quality and f0, f1, ...: what trees split on, of rows with quality and the counts."""
    def run(batches):
        for batch in batches:
            found = features({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS})
            yield {"quality": batch.column("quality")} | {f"f{k}": found[:, k] for k in range(N_FEATURES)}

    return arrow_map(rows.select("quality", *COUNTS), run, "quality int, " + ", ".join(f"f{k} double" for k in range(N_FEATURES)))


def before(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each distinct value of each k, of rows with quality, k and value: good and bad rows that have it, and
    good_before and bad_before that have a lesser one. And the frame that is read from, to `forget`."""
    placed = dealt(values.groupBy("k", "value").agg(
        F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")), ["k"], ["value"])
    sums = ("good", "bad")
    return beside(placed, runs(placed, ["k"], sums), ["k"], sums), placed


def separation(rows: DataFrame, good: int, bad: int) -> np.ndarray:
    """How often each statistic takes its splits, from all rows: next to nothing where good and bad ones mix."""
    melted = told(rows).select("quality", F.posexplode(F.array(*[f"f{k}" for k in range(N_FEATURES)])).alias("k", "value"))
    ordered, placed = before(melted)
    under = dict(ordered.groupBy("k").agg(F.sum(F.expr("bad * (2 * good_before + good)")).alias("under")).collect())
    forget(placed)
    return np.array([0.02 + (under[k] / (good * bad) - 1) ** 2 for k in range(N_FEATURES)])


def draw(rows: DataFrame, n: int, trees: int, sample: int) -> pa.Table:
    """tree and the counts of the rows that each tree grows on: of all n rows the `sample` least by a hash of
    the row and the tree."""
    own = F.xxhash64("tree", "doc_id", *COUNTS)
    # Twice as many as are needed, on average; all of them where rows that are alike leave fewer.
    for share in (min(1.0, 2 * sample / n), 1.0):
        numbered = rows.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "*").withColumn("hash", own)
        near = numbered.filter(F.col("hash") <= min(int(share * 2**64), 2**64 - 1) - 2**63)
        least = W.partitionBy("tree").orderBy("hash", "doc_id", *COUNTS)
        drawn = (near.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= sample)
                 .select("tree", *COUNTS).toArrow())
        if len(drawn) == trees * min(sample, n):
            break
    return drawn


def fit_forest(rows: DataFrame, trees: int = 200, sample: int = 512, seed: int = 7) -> Forest:
    """A forest for all rows (doc_id, quality 0 or 1, the counts). Without rows of both kinds nothing is
    anomalous."""
    good, n = rows.agg(F.sum("quality"), F.count("*")).first()
    if not good or good == n:
        return Forest([], sample, 2.0)
    bad, sample = n - good, min(sample, n)
    rng, weight = np.random.default_rng(seed), separation(rows, good, bad)
    drawn = draw(rows, n, trees, sample)
    tree = drawn["tree"].to_numpy()
    own = features({c: drawn[c].to_numpy() for c in COUNTS})
    # In the order of their values, whatever order they came in.
    own, tree = (x[np.lexsort((*own.T, tree))] for x in (own, tree))
    at = np.searchsorted(tree, np.arange(trees + 1))
    forest = Forest([grow(own[a:b], rng, 10, weight) for a, b in zip(at, at[1:])], sample, 2.0)
    return Forest(forest.trees, sample, threshold(rows, forest, good, bad))


def threshold(rows: DataFrame, forest: Forest, good: int, bad: int) -> float:
    """The score that best tells all bad rows from all good ones."""
    held = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            rows = np.stack([batch.column(f"f{k}").to_numpy(zero_copy_only=False) for k in range(N_FEATURES)], axis=1)
            yield {"quality": batch.column("quality"), "k": np.zeros(len(rows), int), "value": held.value.scores(rows)}

    ordered, placed = before(arrow_map(told(rows), run, "quality int, k int, value double"))
    # In whole numbers: the share of bad rows from here on, less twice that of good ones.
    gain = F.lit(2 * bad) * F.col("good_before") - F.lit(good) * F.col("bad_before")
    best = ordered.orderBy(gain.desc(), "value").select("value").first()[0]
    under = placed.filter(F.col("value") < best).agg(F.max("value")).first()[0]
    forget(placed)
    # Halfway to the next lower score, so that a row like the marginal one falls on its side.
    return (best + (best if under is None else under)) / 2


def fit(stats: DataFrame, labels: DataFrame) -> Forest:
    """Fit on all labelled rows that pass the base rules: rows are anomalous where they are few. Labels
    other than 0 and 1 and contradicting ones are not used."""
    known = (labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other"))
    rows = cut_lineage(stats.filter("n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words")
                       .join(known, F.col("doc_id") == F.col("id"))
                       .select("doc_id", F.col("quality").cast("int").alias("quality"), *COUNTS))
    forest = fit_forest(rows)
    forget(rows)
    return forest


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly and kept of every row.

    Null and empty texts have all counts 0 and fail the base rules. Repeated rows are judged alike.
    Other columns of docs are not looked at.
    """
    stats = cut_lineage(counted(docs))  # read twice: to fit and to judge
    forest = fit(stats, labels)
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            counts = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}
            failed = base_failed(counts)
            anomaly = held.value.scores(features(counts))
            yield ({"doc_id": batch.column("doc_id")} | counts
                   | {"base_failed": failed, "anomaly": anomaly, "kept": ~failed & (anomaly < held.value.threshold)})

    return arrow_map(stats, run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
                     + ", base_failed boolean, anomaly double, kept boolean")
