"""Best-fit packing of documents into sequences by bin completion.

Only the number of pieces of each length matters to a packing, so tasks tokenise, cut and count,
and the search runs over at most `capacity` counters however many documents there are. It fills
one sequence after the other around the largest length that is left: the fillings of the room
beside it are enumerated from large to small, those dominated by one with a longer piece in place
of shorter ones come later, and a branch ends when its waste exceeds what a better packing than
the incumbent may waste in all. A filling is used as often as the counters allow, so some thousand
fillings describe any packing. The first incumbent is best-fit decreasing.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domgrove.llm.common import arrow_map, text_rows, texts_of
from domgrove.llm.tokens import encoder
from domgrove.sources.tables import cut_lineage

Pattern = tuple[dict[int, int], int]  # how often each length stands in a sequence; how many such


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2,
           ranks_file: str = "byte_bpe_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and task and nth: where it was made
    and how many of its length that task had made before. with_ids adds the ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        code = encoder(ranks_file)
        task = TaskContext.get().partitionId()
        made = [0] * (capacity + 1)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length",
                                                    "ids_crc32", "task", "nth", "ids")}
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), code.encode_all(texts_of(batch))):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    own = ids[4 * a:4 * b]
                    for name, value in (("doc_id", doc_id), ("piece", k), ("start", a),
                                        ("length", b - a), ("ids_crc32", zlib.crc32(own)),
                                        ("task", task), ("nth", made[b - a])):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(own)
                    made[b - a] += 1
            yield out

    return arrow_map(text_rows(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                     "task int, nth long" + ", ids binary" * with_ids)


def fillings(room: int, left: dict[int, int], lengths: list[int], most_waste: int, limit: int,
             nodes: int = 4000) -> list[dict[int, int]]:
    """Up to `limit` fillings of the room, least waste first, of those that waste at most most_waste.

    Depth first, longest pieces first. A filling with waste 0 ends the search for its start, and
    each waste found bounds the next.
    """
    found: list[tuple[int, int, dict[int, int]]] = []
    steps = 0

    def keep(waste: int, used: dict[int, int]) -> bool:
        """Notes a filling; true when nothing better is to come."""
        if waste <= (found[-1][0] - 1 if len(found) == limit else most_waste):
            found.append((waste, steps, dict(used)))
            found.sort(key=lambda f: f[:2])
            del found[limit:]
        return len(found) == limit and found[-1][0] == 0

    def go(at: int, room: int, used: dict[int, int]) -> bool:
        nonlocal steps
        steps += 1
        full = True
        for i in range(at, len(lengths)):
            size = lengths[i]
            for n in range(min(left[size], room // size), 0, -1):
                full = False
                done = go(i + 1, room - n * size, {**used, size: n})
                if done or steps > nodes:
                    return True
        return full and keep(room, used)

    go(0, room, {})
    return [f for _, _, f in found]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counters: rooms and their patterns are counted, too."""
    rooms: dict[int, dict[tuple, int]] = {}
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in rooms if r >= size), default=None)
            if room is None:
                fit = capacity // size
                full, rest = divmod(n, fit)
                for k, m in ((fit, full), (rest, 1)):
                    if k and m:
                        kinds = rooms.setdefault(capacity - k * size, {})
                        kinds[((size, k),)] = kinds.get(((size, k),), 0) + m
                n = 0
            else:
                kind, m = next(iter(rooms[room].items()))
                fit = min(room // size, n)
                take = min(m, n // fit)
                if take == m:
                    del rooms[room][kind]
                    if not rooms[room]:
                        del rooms[room]
                else:
                    rooms[room][kind] = m - take
                kinds = rooms.setdefault(room - fit * size, {})
                kinds[kind + ((size, fit),)] = kinds.get(kind + ((size, fit),), 0) + take
                n -= take * fit
    return [(dict(kind), m) for kinds in rooms.values() for kind, m in kinds.items()]


def pack(counts: dict[int, int], capacity: int = 1024, nodes: int = 6000) -> list[Pattern]:
    """Fillings and how often each is used, together all pieces; as few sequences as found within
    `nodes` steps of the search over fillings."""
    counts = {k: n for k, n in counts.items() if n}
    best = best_fit(counts, capacity)
    total = sum(k * n for k, n in counts.items())
    n_best = sum(m for _, m in best)
    least = -(-total // capacity)
    spent = 0
    # Frames of the depth-first search: counters left, waste so far, fillings still to try.
    for width in (1, 2, 4):
        if n_best == least:
            break
        stack = [(counts, 0, None, 0)]
        chosen: list[tuple[int, Pattern]] = []
        while stack and spent < nodes:
            left, waste, pattern, depth = stack.pop()
            spent += 1
            del chosen[max(0, depth - 1):]
            if pattern:
                chosen.append(pattern)
            allowed = (n_best - 1) * capacity - total
            if waste > allowed:
                continue
            if not left:
                used = sum(m for _, m in chosen)
                if used < n_best:
                    best, n_best = list(chosen), used
                    if n_best == least:
                        return best
                continue
            first = max(left)
            rest = dict(left)
            rest[first] -= 1
            lengths = sorted((k for k, n in rest.items() if n), reverse=True)
            # Wasteful fillings are open too: the last sequence may be nearly empty.
            options = fillings(capacity - first, rest, lengths, allowed - waste, width)
            for filling in reversed(options):
                need = dict(filling)
                need[first] = need.get(first, 0) + 1
                room = capacity - sum(k * n for k, n in need.items())
                m = min(left[k] // n for k, n in need.items())
                if room:
                    m = max(1, min(m, (allowed - waste) // room))
                after = {k: n - m * need.get(k, 0) for k, n in left.items()}
                stack.append(({k: n for k, n in after.items() if n}, waste + m * room, (need, m), depth + 1))
    return best


def places(patterns: list[Pattern]):
    """A function from lengths and ranks within each length to sequence_id and offset."""
    taken: dict[int, int] = {}
    rows = []
    base = 0
    for need, m in patterns:
        offset = 0
        for length in sorted(need, reverse=True):
            n = need[length]
            rows.append((length, taken.get(length, 0), n, base, offset))
            taken[length] = taken.get(length, 0) + n * m
            offset += n * length
        base += m
    rows.sort()
    length, first, copies, bases, offsets = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
    starts = np.searchsorted(length, np.arange(int(length.max(initial=0)) + 2))

    def of(lengths: np.ndarray, ranks: np.ndarray):
        at = np.empty(len(lengths), np.int64)
        for size in np.unique(lengths):
            own = lengths == size
            a, b = starts[size], starts[size + 1]
            at[own] = a + np.searchsorted(first[a:b], ranks[own], side="right") - 1
        nth = ranks - first[at]
        return bases[at] + nth // copies[at], offsets[at] + nth % copies[at] * lengths

    return of


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2,
                   ranks_file: str = "byte_bpe_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    A document is its ids and then end_id; null and empty texts are end_id alone. Longer ones than
    the capacity are cut into pieces of capacity tokens, the first of which may be shorter.
    Repeated rows and rows without doc_id are packed like any other. Other columns of docs are not
    looked at; an empty table gives an empty one.
    """
    # Written out once: the numbering must not change when a task is run again.
    made = cut_lineage(pieces(docs, capacity, end_id, ranks_file, with_ids))
    by_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = places(pack(counts, capacity))
    ranked = made.join(offsets, ["task", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = (batch.column("nth").to_numpy(zero_copy_only=False)
                     + batch.column("before").to_numpy(zero_copy_only=False))
            sequence, offset = place(lengths, ranks)
            yield {n: batch.column(n) for n in names} | {"sequence_id": sequence, "offset": offset}

    return arrow_map(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                     + "ids binary, " * with_ids + "sequence_id long, offset long")
