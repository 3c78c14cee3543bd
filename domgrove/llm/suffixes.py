"""Exact dedup of byte strings by suffix arrays.

Suffixes are sorted in two stages. Those that are smaller than the suffix one place on are sorted
directly, eight bytes at a time and no deeper than `depth`. The others follow from bucket scans:
going through the sorted suffixes from the smallest, the suffix one place before each goes to the
head of its bucket. Then the common prefixes of neighbours are computed; suffixes whose neighbours
share `size` bytes hold equal strings, of which the one with the smallest place is the first.

To sort a corpus, its strings must meet in small parts. Every string of `size` bytes has an anchor,
its run of `gram` bytes with the least hash, so equal strings have equal anchors at equal places. A
segment is an anchor with all strings that it is the anchor of, at most size + size - gram bytes.
Segments whose anchors a count-min sketch takes for unique are left where they are. Equal segments
are reduced to the one with the smallest place, in the tasks and again after they have moved by
anchor; the distinct ones of each anchor go through the suffix array together, many anchors at a
time. An anchor with more than `most` distinct segments is split: each segment is cut into its
strings that begin further from the anchor and those that begin nearer, which agree on a longer
run of bytes and are dealt out by that run, level by level, until the parts are small or a part
is one string. So no anchor, however common, has to be sorted in one piece.

What is kept of this are the places of first strings; a last pass removes from each document the
bytes of its candidate strings that are not first.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domgrove.llm.common import arrow_map, mix, shared_folder, texts_of
from domgrove.llm.substring import CELLS, estimated_repeated, keyed, repeated_cells
from domgrove.llm.text import covered, in_blocks, prefix

U = np.uint64
SIZE, GRAM = 100, 32
#: Never in UTF-8, so that no string of a segment reaches into the next.
END = b"\xff"
MOST = 2000
CHUNK = 1 << 19
#: Bytes of texts whose runs are hashed together: the arrays of eight bytes a place stay in a core's cache.
BLOCK = 1 << 17


# The suffix array.

def eight(text: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a number that sorts like them."""
    padded = np.r_[text, np.zeros(8, np.uint8)].astype(U)
    n = len(text)
    out = np.zeros(n, U)
    for j in range(8):
        out |= padded[j:j + n] << U(56 - 8 * j)
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one a place on; the last is not (nothing is smallest)."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = text[change] < text[change + 1]
    out = np.zeros(n, bool)
    # Equal bytes are as the last of their run; the run at the end is never smaller.
    if len(change):
        out[:change[-1] + 1] = np.repeat(rises, np.diff(change, prepend=-1))
    return out


def sort_directly(words: np.ndarray, own: np.ndarray, depth: int) -> np.ndarray:
    """Places `own` in the order of their next `depth` bytes."""
    n = len(words)
    order = own[np.argsort(words[own], kind="stable")]
    key = words[order]
    tied = _ties(key[1:] == key[:-1])
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) if len(order) else np.zeros(0, np.int64)
    for at in range(8, depth, 8):
        if not len(tied):
            break
        places = order[tied] + at
        key = np.where(places < n, words[np.minimum(places, n - 1)], U(0))
        by = np.lexsort((key, group[tied]))
        order[tied] = order[tied][by]
        key, own_group = key[by], group[tied]
        new = np.r_[True, (own_group[1:] != own_group[:-1]) | (key[1:] != key[:-1])]
        # Group numbers need only be different: the index of a group's first member.
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))] + len(order) * (at // 8)
        tied = tied[_ties(~new[1:])]
    return order


def _ties(same: np.ndarray) -> np.ndarray:
    """Members of runs of equal neighbours."""
    return np.flatnonzero(np.r_[False, same] | np.r_[same, False]) if len(same) else np.zeros(0, np.int64)


def chained(wanted: np.ndarray, small: np.ndarray) -> np.ndarray:
    """The wanted places and those that their order follows from: the places behind each, as far as
    the first suffix that is smaller than its next."""
    at = np.arange(len(wanted))
    last_wanted = np.maximum.accumulate(np.where(wanted, at, -1))
    last_small = np.r_[-1, np.maximum.accumulate(np.where(small, at, -1))[:-1]]
    return last_wanted > last_small


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of all suffixes, in the order of their first `depth` bytes at least.

    With `wanted` (a mask) only those and the few that their order follows from are sorted.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_next(text)
    needed = np.ones(n, bool) if wanted is None else chained(wanted, small)
    direct = sort_directly(eight(text), np.flatnonzero(small & needed), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        parts = []
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(wave):  # places before those just found may belong to this very bucket
            parts.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[(text[wave] == c) & needed[wave]]
        parts.append(direct[bounds[c]:bounds[c + 1]])
        bucket = np.concatenate(parts)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & needed[before]]
        if len(before):
            kind = text[before]
            by = np.argsort(kind, kind="stable")
            kinds, first = np.unique(kind[by], return_index=True)
            for k, part in zip(kinds.tolist(), np.split(before[by], first[1:])):
                waiting[k].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Equal first bytes of each suffix and the one before it in order, `depth` at most."""
    words = eight(text)
    n = len(text)
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for at in range(0, depth, 8):
        if not len(open_):
            break
        a, b = order[open_] + at, order[open_ - 1] + at
        ok = (a < n) & (b < n)
        differ = np.where(ok, words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)], U(2**63))
        # Leading zero bytes of the difference.
        same = np.full(len(open_), 8)
        unlike = np.flatnonzero(differ)
        rest = np.zeros(len(unlike), np.int64)
        for j in range(1, 8):
            rest += differ[unlike] >> U(64 - 8 * j) == 0
        same[unlike] = rest
        out[open_] += same
        open_ = open_[same == 8]
    return np.minimum(out, depth)


def first_strings(segments: list[bytes], places: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """For each segment the offsets of its strings that no smaller (place, start) among all has."""
    text = np.frombuffer(END.join([*segments, b""]), np.uint8)
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    begins = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(segments)), lengths + 1)
    offset = np.arange(len(text)) - begins[owner]
    # The last bytes of a segment begin no string: they are sorted as far as others follow from them.
    begins_string = offset + size <= lengths[owner]
    order = suffix_array(text, size, begins_string)
    order = order[begins_string[order]]
    shared = common_prefixes(text, order, size)
    kind = np.cumsum(shared < size)
    own = owner[order]
    by = np.lexsort((starts[own] + offset[order], places[own], kind))
    first = np.r_[True, kind[by][1:] != kind[by][:-1]] if len(by) else np.zeros(0, bool)
    found = order[by[first]]
    found.sort()
    return np.split(offset[found], np.searchsorted(found, begins[1:]))


# Anchors and segments.

def doubled(values: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every n consecutive values."""
    out, width = values, 1
    while width * 2 <= n:
        out, width = pick(out[:len(out) - width], out[width:]), width * 2
    rest = n - width
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def anchored(texts: list[bytes], size: int, gram: int):
    """Hashes of all runs, the least one of each string, which strings lie in one text, begins."""
    raw = b"\n".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths + 1) - lengths - 1
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, bool), begins
    # range_hash of every gram bytes that follow each other, without looking places up.
    sums, down = prefix(np.frombuffer(raw, np.uint8).astype(U) + U(1), 0)
    runs = mix((sums[gram:] - sums[:-gram]) * down[:len(raw) - gram + 1] + U(gram))
    least = doubled(runs, size - gram + 1, np.minimum)
    change = np.zeros(n + 1, np.int32)
    whole = lengths >= size
    np.add.at(change, begins[whole], 1)
    np.add.at(change, begins[whole] + lengths[whole] - size + 1, -1)
    return runs, least, np.cumsum(change[:-1]) > 0, begins


def anchors_seen(texts: list[bytes], size: int, gram: int) -> np.ndarray:
    """Hashes of the anchors of all strings, each place once."""
    found = [np.zeros(0, U)]
    for a, b in in_blocks(texts, BLOCK):
        runs, least, inside, _ = anchored(texts[a:b], size, gram)
        found.append(runs[anchor_places(runs, least, inside, size - gram)])
    return np.concatenate(found)


def anchor_places(runs: np.ndarray, least: np.ndarray, inside: np.ndarray, reach: int) -> np.ndarray:
    """Places of runs that are the least of some string. `reach`: strings begin so far before."""
    if not len(least):
        return np.zeros(0, np.int64)
    top = np.zeros(len(least) + 2 * reach, U)
    top[reach:reach + len(least)] = np.where(inside, least, U(0))
    top = doubled(top, reach + 1, np.maximum)  # over strings that begin 0..reach before each place
    return np.flatnonzero(runs == top)


def candidates(texts: list[bytes], bits, cells: int, size: int, gram: int):
    """Which strings may repeat, and what anchored() returns."""
    runs, least, inside, begins = anchored(texts, size, gram)
    starts = np.flatnonzero(inside)
    # Neighbours mostly share their anchor, so hashes are looked up once per stretch.
    values = least[starts]
    new = np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, bool)
    known = estimated_repeated(values[new], bits, cells)
    keep = np.zeros(len(inside), bool)
    keep[starts] = known[np.cumsum(new) - 1] if len(values) else False
    return keep, runs, least, begins


SEGMENT = "key long, low int, high int, far int, near int, place long, at long, segment binary, n int"
COLUMNS = [c.split()[0] for c in SEGMENT.split(", ")]


def segments_of(docs: DataFrame, sketch, size: int, gram: int, cells: int, held: int = 8 << 20) -> DataFrame:
    """Segments that may repeat, with the anchor's hash as key.

    low..high is how far before the anchor strings may begin, far and near how far the segment's
    first and last do; place and at (mark << 32 | start) are those of its first string. Equal
    segments are reduced to the smallest place for every `held` bytes of text.
    """
    reach = size - gram

    def run(batches):
        bits = sketch.value
        found: dict[tuple, tuple[int, int]] = {}
        read = 0
        for batch in batches:
            texts = texts_of(batch)
            place, mark = batch.column("place").to_pylist(), batch.column("mark").to_pylist()
            for a, b in in_blocks(texts, BLOCK):
                own = texts[a:b]
                keep, runs, least, begins = candidates(own, bits, cells, size, gram)
                at = anchor_places(runs, least, keep, reach)
                for k in range(0, len(at), 4096):
                    q = at[k:k + 4096]
                    near = q[:, None] - np.arange(reach, -1, -1)
                    here = np.clip(near, 0, len(least) - 1)
                    mine = keep[here] & (least[here] == runs[q][:, None]) & (near >= 0) & (near < len(least))
                    far, close = reach - mine.argmax(1), mine[:, ::-1].argmax(1)
                    doc = np.searchsorted(begins, q, side="right") - 1
                    start = q - far - begins[doc]
                    for key, f, c, d, s in zip(runs[q].view(np.int64).tolist(), far.tolist(), close.tolist(),
                                               doc.tolist(), start.tolist()):
                        name = (key, f, c, own[d][s:s + f - c + size])
                        new = (place[a + d], mark[a + d] << 32 | s)
                        old = found.get(name)
                        if old is None or new < old:
                            found[name] = new
                read += sum(map(len, own))
                if read >= held:
                    yield from as_rows(((k, 0, reach, f, c, p, w, x, None) for (k, f, c, x), (p, w) in found.items()))
                    found, read = {}, 0
        yield from as_rows(((k, 0, reach, f, c, p, w, x, None) for (k, f, c, x), (p, w) in found.items()))

    return arrow_map(keyed(docs), run, SEGMENT)


def as_rows(rows, size: int = 20_000):
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield dict(zip(COLUMNS, map(list, zip(*part))))


def split(low: int, high: int, far: int, near: int, place: int, at: int, segment: bytes, size: int):
    """A segment as up to two, for the strings of either half of low..high, with new keys: what all
    strings of the half have in common wherever the segment itself ends."""
    middle = (low + high) // 2
    for x, y in ((low, middle), (middle + 1, high)):
        first, last = min(far, y), max(near, x)
        if first >= last:
            begin = far - first
            core = hashlib.blake2b(segment[far - x:far - y + size], digest_size=8, salt=bytes((x, y)))
            yield (int.from_bytes(core.digest(), "little", signed=True), x, y, first, last, place, at + begin,
                   segment[begin:begin + first - last + size], None)


def sort_level(rows: DataFrame, size: int, gram: int, most: int) -> DataFrame:
    """Runs of first strings (place, at, n) of all anchors with up to `most` distinct segments, and
    the segments of the others, split."""
    ranged = rows.repartition("key").sortWithinPartitions("key")

    def flush(queue):
        if queue:
            offsets = first_strings([q[0] for q in queue], np.array([q[1] for q in queue], np.int64),
                                    np.array([q[2] for q in queue], np.int64), size)
            for (_, place, at), own in zip(queue, offsets):
                if len(own):
                    cut = np.flatnonzero(np.diff(own) != 1)
                    for x, y in zip(own[np.r_[0, cut + 1]].tolist(), own[np.r_[cut, len(own) - 1]].tolist()):
                        yield (None, None, None, None, None, place, at + x, None, y - x + 1)

    def alone(far, segment):
        """Whether the anchor is the only run of its kind: then no two strings of it are equal."""
        run = segment[far:far + gram]
        return segment.find(run) == far and segment.find(run, far + 1) < 0

    def out(batches):
        queue: list[tuple[bytes, int, int]] = []
        queued = 0
        key, group, over = None, {}, False

        def ended():
            nonlocal queued
            if len(group) == 1:
                (_, _, far, near, segment), (place, at) = next(iter(group.items()))
                if alone(far, segment):
                    return [(None, None, None, None, None, place, at, None, far - near + 1)]
            for (_, _, _, _, segment), (place, at) in group.items():
                queue.append((segment, place, at))
                queued += len(segment)
            return []

        for batch in batches:
            for k, low, high, far, near, place, at, segment, _ in zip(*(batch.column(c).to_pylist() for c in COLUMNS)):
                if k != key:
                    yield from ended()
                    key, group, over = k, {}, False
                    if queued >= CHUNK:
                        yield from flush(queue)
                        queue, queued = [], 0
                if over:
                    yield from split(low, high, far, near, place, at, segment, size)
                    continue
                name, new = (low, high, far, near, segment), (place, at)
                old = group.get(name)
                if old is None or new < old:
                    group[name] = new
                if len(group) > most and low < high:
                    over = True
                    for (x, y, f, c, held), (p, w) in group.items():
                        yield from split(x, y, f, c, p, w, held, size)
                    group = {}
        yield from ended()
        yield from flush(queue)

    return arrow_map(ranged, lambda batches: as_rows(out(batches)), SEGMENT)


def first_places(docs: DataFrame, sketch, size: int, gram: int, cells: int, most: int) -> tuple[DataFrame, list[str]]:
    """place, at and n of all runs of first strings; and the folders they are read from."""
    spark = docs.sparkSession
    rows, firsts, folders = segments_of(docs, sketch, size, gram, cells), None, []
    while True:
        folders.append(shared_folder(spark))
        sort_level(rows, size, gram, most).write.parquet(folders[-1])
        level = spark.read.parquet(folders[-1])
        own = level.filter("n IS NOT NULL").select("place", "at", "n")
        firsts = own if firsts is None else firsts.union(own)
        rows = level.filter("n IS NULL")
        if rows.isEmpty():
            return firsts, folders


def dedup_bytes(docs: DataFrame, size: int = SIZE, gram: int = GRAM, most: int = MOST, cells: int = CELLS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and `spans`: begin and end of each removed run.

    Texts are UTF-8 bytes. A byte goes if a string of `size` bytes of its document covers it that
    also starts earlier: in a smaller doc_id, or before it in the same row. Null texts are empty;
    rows without doc_id come before all others. Repeated rows are one place, and keep the same; of
    rows that share a doc_id and differ, one counts as the earlier. Other columns of docs are not
    looked at.
    """
    if not 8 <= gram < size or size - gram > 255:
        raise ValueError("gram must be at least 8 and shorter than size by 1 to 255")
    spark = docs.sparkSession
    bits = repeated_cells(docs, lambda texts: anchors_seen(texts, size, gram), cells)
    sketch = spark.sparkContext.broadcast(bits)
    firsts, _ = first_places(docs, sketch, size, gram, cells, most)
    lists = (firsts.groupBy("place", F.shiftright("at", 32).alias("mark"))
             .agg(F.collect_list(F.struct(F.expr("at & 4294967295").alias("s"), "n")).alias("firsts")))
    joined = keyed(docs).join(lists, ["place", "mark"], "left")

    def run(batches):
        for batch in batches:
            texts, ids = texts_of(batch), batch.column("doc_id").to_pylist()
            lists = batch.column("firsts").to_pylist()
            for a, b in in_blocks(texts, BLOCK):
                own = texts[a:b]
                keep, _, _, begins = candidates(own, sketch.value, cells, size, gram)
                for i, found in enumerate(lists[a:b]):
                    for r in found or ():
                        at = int(begins[i]) + r["s"]
                        keep[at:at + r["n"]] = False
                total = sum(map(len, own)) + len(own)
                gone = covered(np.flatnonzero(keep), size, total)
                rows: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
                for i, text in enumerate(own):
                    here = gone[begins[i]:begins[i] + len(text)]
                    edge = np.flatnonzero(np.diff(np.r_[False, here, False].astype(np.int8))).tolist()
                    cuts = [0, *edge, len(text)]
                    digest = hashlib.sha256()
                    for x, y in zip(cuts[::2], cuts[1::2]):
                        digest.update(text[x:y])
                    for c, v in (("n_bytes", len(text)), ("n_removed", int(here.sum())), ("n_spans", len(edge) // 2),
                                 ("kept_sha256", digest.hexdigest()), ("spans", edge)):
                        rows[c].append(v)
                yield {"doc_id": ids[a:b]} | rows

    return arrow_map(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
