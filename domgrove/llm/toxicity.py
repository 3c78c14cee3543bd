"""Toxicity by compression distance: what costs less after toxic than after ordinary text.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text of labelled rows.
A window is one word, a range of bytes of a long word (as text without spaces is) or a pair of
words, between two fixed strings that both dictionaries hold, so that its compressed length is its
own cost and not of a block that zstandard would rather store. Its distance is length after
ordinary text minus length after toxic text. Of pairs only those are windows that the labels tell
to be toxic although their words are not. A document is judged by the largest distances, by the
number and share of windows beyond several thresholds, and by its pairs; the weights of these,
and so the threshold, are calibrated by logistic regression on labelled rows whose distances come
from dictionaries that were trained without them.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domgrove.llm.common import LOWER, Cached, map_rows, map_whole_rows

#: Stands before and behind every window, and at the end of both dictionaries.
FRAME = b"0123456789abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEPS = (2, 3, 4, 5, 6)
LEVEL = 9
#: Sizes of the dictionaries, and how many windows the ordinary one is trained on.
TOXIC_BYTES, ORDINARY_BYTES, ORDINARY_WINDOWS = 4000, 16000, 30_000
#: Share of the toxic windows that may be there by chance. With few labels nothing may be as sure:
#: then the next share holds.
FALSE_SHARES = (0.01, 0.1, 1.0)
#: Words of more bytes are read in ranges of RANGE bytes, one from each character on.
LONG, RANGE = 48, 9


def windows(text: bytes) -> list[bytes]:
    """The words in lower case (A-Z only), long ones in ranges."""
    own = text.translate(LOWER).split()
    if max(map(len, own), default=0) <= LONG:
        return own
    out = []
    for w in own:
        if len(w) <= LONG:
            out.append(w)
        else:
            out += [w[i:i + RANGE] for i in range(len(w) - RANGE + 1) if w[i] & 0xC0 != 0x80]
    return out


def known_pairs(own: list[bytes], heads: dict[bytes, frozenset[bytes]]) -> list[bytes]:
    """Neighbouring windows of which the second is among those that `heads` has for the first."""
    return [w + b" " + own[i + 1] for i, w in enumerate(own[:-1]) if w in heads and own[i + 1] in heads[w]]


def surprise(bad: np.ndarray, usual: np.ndarray, n_bad: int, n_usual: int) -> np.ndarray:
    """Probability that of bad + usual marked documents so many or more are toxic, if the mark and
    toxicity had nothing to do with each other (upper tail of the hypergeometric distribution)."""
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n_bad + n_usual + 1)))])

    def choose(n, k):
        return log[n] - log[k] - log[n - k]

    made = {}
    for a, b in set(zip(bad.tolist(), usual.tolist())):
        x = np.arange(a, min(a + b, n_bad) + 1)
        x = x[a + b - x <= n_usual]
        made[a, b] = np.exp(choose(n_bad, x) + choose(n_usual, a + b - x) - choose(n_bad + n_usual, a + b)).sum()
    return np.array([made[k] for k in zip(bad.tolist(), usual.tolist())])


def telling(marks: dict, bad: Counter, usual: Counter, n_bad: int, n_usual: int, shares: tuple[float, ...] = FALSE_SHARES) -> list:
    """Those of marks (their number of toxic documents by mark) that tell toxic documents, surest first.

    A mark counts if its share of toxic documents is 1.5 times that of ordinary ones or more, and if
    it passes the procedure of Benjamini and Hochberg: among all that pass, at most the first of
    `shares` is expected to be there by chance, however many were looked at; the next of them where
    none passes.
    """
    names = sorted(marks)
    a, b = (np.fromiter((c[w] for w in names), np.int64, len(names)) for c in (bad, usual))
    p = surprise(a, b, n_bad, n_usual)
    order = np.lexsort((-a, p))
    sure = order[:0]
    for share in shares:
        passed = np.flatnonzero(p[order] <= share * np.arange(1, len(names) + 1) / max(1, len(names)))
        if len(passed):
            sure = order[:passed[-1] + 1]
            break
    often = (a + 0.5) / (n_bad + 1) >= 1.5 * (b + 0.5) / (n_usual + 1)
    return [names[i] for i in sure.tolist() if often[i]]


def train_dictionaries(texts: list[bytes], toxic: list[int], sizes: tuple[int, int] = (TOXIC_BYTES, ORDINARY_BYTES),
                       most_usual: int = ORDINARY_WINDOWS
                       ) -> tuple[tuple[bytes, bytes], dict[bytes, frozenset[bytes]]] | None:
    """A toxic and an ordinary dictionary, and toxic pairs by first window; None where either kind
    of text is missing or nothing tells them apart.

    The toxic dictionary is trained on windows that are surely more frequent among toxic documents,
    once for each that has them, and on pairs of other windows that are; the surest come first until
    it is full. The ordinary one is trained on `most_usual` of the other windows of ordinary
    documents. Copies count once.
    """
    counts, n = (Counter(), Counter()), [0, 0]
    unique = list(dict.fromkeys(zip(texts, toxic)))
    for text, kind in unique:
        n[kind] += 1
        counts[kind].update(set(windows(text)))
    ordinary, bad = counts
    if not n[0] or not n[1]:
        return None
    own = telling(bad, bad, ordinary, n[1], n[0])
    single = set(own)
    pairs: tuple[Counter, Counter] = (Counter(), Counter())
    for kind in (1, 0):  # of ordinary documents only pairs that are common among toxic ones
        for text, k in unique:
            if k == kind:
                words = windows(text)
                pairs[kind].update({p for p in zip(words, words[1:]) if kind or p in pairs[1]})
        if kind:
            for p in [p for p in pairs[1] if p[0] in single or p[1] in single]:
                del pairs[1][p]
    told = telling(pairs[1], *pairs[::-1], n[1], n[0], FALSE_SHARES[:1])
    heads: dict[bytes, set[bytes]] = {}
    for first, second in told:
        heads.setdefault(first, set()).add(second)
    kept, held = [], 0
    for w, c in [*((w, bad[w]) for w in own), *((p[0] + b" " + p[1], pairs[1][p]) for p in told)]:
        held += len(w) + 2
        if held > sizes[0]:
            break
        kept.append((w, c))
    samples = [b" " + w + b" " for w, c in kept for _ in range(c)]
    usual = [b" " + w + b" " for w, c in sorted(ordinary.items()) if w not in single for _ in range(c)]
    if len(usual) > most_usual:
        order = np.random.default_rng(0).permutation(len(usual))[:most_usual]
        usual = [usual[i] for i in order]
    made = [trained(x, size) for size, x in zip(sizes, (samples, usual))]
    # Training leaves out what is short or rare: such windows follow, the surest next to the text.
    rest = b"".join(b" " + w + b" " for w, _ in reversed(kept) if b" " + w + b" " not in made[0])
    made[0] = (made[0] + rest)[-sizes[0]:]
    return ((made[0], made[1]), {w: frozenset(x) for w, x in heads.items()}) if kept and usual else None


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of at most `size` bytes; the samples themselves if they are too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def distance(dictionaries: tuple[bytes, bytes]):
    """A function from a window to its distance."""
    sides = []
    for content in dictionaries:
        held = zstandard.ZstdCompressionDict(content + FRAME,
                                             dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sides.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False,
                                              write_checksum=False, write_dict_id=False).compress)
    toxic, ordinary = sides

    def of(window: bytes) -> int:
        framed = FRAME + b" " + window + b" " + FRAME
        return len(ordinary(framed)) - len(toxic(framed))

    return of


def evidence(text: bytes, cost, heads: dict[bytes, frozenset[bytes]]) -> np.ndarray:
    """What a document is judged by; cost gives the distance of a window."""
    own = windows(text)
    pairs = [cost(p) for p in known_pairs(own, heads)] if heads else []
    distances = np.fromiter(map(cost, own), float)
    if not len(distances):
        distances = np.zeros(1)
    top = -np.sort(-distances)[:5]
    beyond = np.array([(distances >= s).sum() for s in STEPS])
    return np.array([top[0], top[:2].mean(), top[:3].mean(), top.mean(), distances.mean(),
                     *np.minimum(beyond, 12) / 4, *beyond / len(distances) * 20,
                     np.log(len(distances) + 1), max(pairs, default=0),
                     min(sum(p >= STEPS[0] for p in pairs), 12) / 4])


@dataclass(frozen=True)
class Model:
    """Dictionaries and weights; without dictionaries the score is `share` for every text."""

    dictionaries: tuple[bytes, bytes] | None
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    share: float
    pairs: dict[bytes, frozenset[bytes]] = field(default_factory=dict)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.centre) / self.spread, -8, 8)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30)))


def logistic(rows: np.ndarray, toxic: np.ndarray, weight: np.ndarray):
    centre, spread = rows.mean(0), rows.std(0) + 1e-9
    a = np.c_[np.ones(len(rows)), np.clip((rows - centre) / spread, -8, 8)]
    w = np.zeros(a.shape[1])
    keep = np.r_[0.001, np.ones(len(w) - 1)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - toxic)) + keep * w
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(keep)
        w = w - np.linalg.solve(curve, gradient)
    return centre, spread, w


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of doc_id as text, divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_ordinary: int = 4000,
        sizes: tuple[int, int] = (TOXIC_BYTES, ORDINARY_BYTES), most_usual: int = ORDINARY_WINDOWS) -> Model:
    """Train on labelled rows that are not held out.

    At most max_toxic toxic and max_ordinary ordinary rows are used, those first in the order of a
    hash of doc_id, and of rows that share a doc_id that of the smallest hash of the text; rows of a
    kind of which there are more weigh more in the calibration. Labels
    other than 0 and 1, and labels of one doc_id that contradict each other, are not used. Dictionaries
    have `sizes` bytes at most, the ordinary one is trained on `most_usual` windows.
    """
    known = (labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.min("toxic").alias("kind"), F.max("toxic").alias("other"))
             .filter("kind = other").select("id", F.col("kind").cast("int").alias("kind")))
    totals = {r["kind"]: r["n"] for r in known.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    parts = [known.filter(F.col("kind") == k).orderBy(F.xxhash64("id"), "id").limit(n)
             for k, n in ((1, max_toxic), (0, max_ordinary))]
    chosen = parts[0].unionByName(parts[1])  # bounded, so that it can be broadcast
    rows = (docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
            .join(F.broadcast(chosen), "id").groupBy("id", "kind")
            .agg(F.min_by(F.struct("text"), F.xxhash64("text"))["text"].alias("text")).collect())
    rows = sorted(rows, key=lambda r: r["id"])
    texts = [r["text"] or b"" for r in rows]
    toxic = np.array([r["kind"] for r in rows], int)
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    none = Model(None, np.zeros(1), np.ones(1), np.zeros(2), share)
    if not len(toxic) or toxic.min() == toxic.max():
        return none
    whole = train_dictionaries(texts, list(toxic), sizes, most_usual)
    folds = np.array([hash_fold(r["id"]) for r in rows])
    features = np.zeros((len(rows), 8 + 2 * len(STEPS)))
    for fold in (0, 1):
        made = train_dictionaries([t for t, f in zip(texts, folds) if f != fold],
                                  list(toxic[folds != fold]), sizes, most_usual)
        if made is None or whole is None:
            return none
        cost = Cached(distance(made[0])).__getitem__
        for i in np.flatnonzero(folds == fold):
            features[i] = evidence(texts[i], cost, made[1])
    used = {k: max(1, int((toxic == k).sum())) for k in (0, 1)}
    weight = np.array([totals.get(k, 1) / used[k] for k in toxic])
    return Model(whole[0], *logistic(features, toxic, weight / weight.mean()), share, whole[1])


def hash_fold(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 >> 40) & 1


def scorer(model: Model):
    """What a task runs: texts to score and predicted."""
    def start():
        cost = Cached(distance(model.dictionaries), 400_000).__getitem__ if model.dictionaries else None

        def each(texts):
            if cost is None:
                score = np.full(len(texts), model.share)
            else:
                score = model.scores(np.array([evidence(t, cost, model.pairs) for t in texts]))
            return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

        return each

    return start


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row. Null and empty texts have no window and get the score
    of a document without evidence. Repeated rows stay; other columns of docs are not looked at."""
    return map_rows(docs, scorer(model), "score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted to be toxic, all columns as they came."""
    judged = map_whole_rows(docs, scorer(model), "score double, predicted int")
    return judged.filter("predicted = 0").select("doc.*")
