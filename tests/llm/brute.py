"""Plain versions of what the operators compute, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def order(doc_id):
    return (doc_id is not None, doc_id or 0)


def removed(items, size, units):
    """For (doc_id, units) in order: which units of each go. Rows of one doc_id count as one place."""
    first = {}
    for k, (doc_id, row) in sorted(enumerate(items), key=lambda x: order(x[1][0])):
        for i in range(len(row) - size + 1):
            first.setdefault(tuple(row[i:i + size]), (order(doc_id), i))
    out = []
    for doc_id, row in items:
        gone = [False] * len(row)
        for i in range(len(row) - size + 1):
            if first[tuple(row[i:i + size])] < (order(doc_id), i):
                gone[i:i + size] = [True] * size
        out.append(gone)
    return out


def spans(gone):
    return sum(b and not a for a, b in zip([False, *gone], gone))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def shingles(text, size=5):
    own = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words(text)]
    if not own:
        return set()
    return {tuple(own[i:i + size]) for i in range(max(1, len(own) - size + 1))}


def components(items, percent=75):
    """component_id by doc_id for (doc_id, set) with a Jaccard similarity of at least so many percent."""
    parent = {d: d for d, _ in items}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: root(d) for d, _ in items}


def rule_counts(text):
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    triples = Counter(zip(own, own[1:], own[2:]))
    again = {j for i in range(len(own) - 2) if triples[tuple(own[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return {"n_words": len(own), "word_chars": sum(map(len, own)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": dup, "n_repeat_words": len(again)}


def tokens_of(text):
    drop = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    plain = "".join(" " if c in drop else c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", plain)


def tiling(doc, item, shortest):
    """Greedy string tiling by trying every start: number of tiles and item tokens covered.

    Of several longest matches the first in doc is marked, then the first in item.
    """
    doc_free, item_free = [True] * len(doc), [True] * len(item)
    count = covered = 0
    while True:
        best = (shortest - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while (i + k < len(doc) and j + k < len(item) and doc_free[i + k] and item_free[j + k]
                       and doc[i + k] == item[j + k]):
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        size, i, j = best
        if size < shortest:
            return count, covered
        count, covered = count + 1, covered + size
        doc_free[i:i + size] = item_free[j:j + size] = [False] * size


def joined(*parts):
    return sha("".join(parts).encode())


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def merkle(rows):
    """The digest of the manifest of rows (dicts): as merkle.checked."""
    def leaf(r, more=0):
        n = None if r["n_chars"] is None else r["n_chars"] + more
        return joined(*map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"])))

    def build(level):
        tree = [level]
        while len(tree[-1]) > 1:
            tree.append([joined(*tree[-1][i:i + 2]) for i in range(0, len(tree[-1]), 2)])
        return tree

    def path(tree, i):
        return [((i >> k) & 1, level[(i >> k) ^ 1] if (i >> k) ^ 1 < len(level) else "")
                for k, level in enumerate(tree[:-1])]

    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (order(r["doc_id"]), leaf(r)))
    trees = [build([leaf(r) for r in by[x]]) for x in langs]
    top = build([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            steps = path(trees[k], i) + path(top, k)
            now = leaf(r, int(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0))
            for on_left, s in steps:
                now = joined(s, now) if on_left else joined(now, s)
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r), trees[k][-1][0], root, joined(*[s for _, s in steps]), now, now == root))
    return out


def trie(rows, family=20, heads=4):
    """The nodes of the trie of (conv_id, turn, role, text): as conversations.prefix_trie."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((order(turn), tie, (role, text)))
    own = {c: [x[2] for x in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        made[c] = own.get(c - (abs(c) % family) * (1 if c > 0 else -1), [])[:h] + turns[h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, own_members in members.items():
        cost = (len(own_members) - 1) * len(words(s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += cost
    return [(min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s],
             sha(",".join(map(str, sorted(c for c in m if len(made[c]) == len(s)))).encode()))
            for s, m in members.items()]
