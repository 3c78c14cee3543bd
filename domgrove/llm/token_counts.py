"""Token counts by a trie whose nodes hold the best segmentation of their prefix.

Distinct words, each behind the mark of a word start, are inserted in a trie. A node's forward
score, the largest sum of piece log-probabilities over all ways to cut its prefix into pieces, is
computed once from its ancestors' when the node is made, with the number of pieces of that best
way; words share it as far as they share prefixes. The count of a whole word is that of its last
node. Every worker has its own trie, started anew when it is full: what it holds changes the time
and never the result.

The pieces are those of a public vocabulary that gives them in the order of their use but no
probabilities; log-probabilities are taken from their ranks by Zipf's law. A character that is no
piece is cut into its UTF-8 bytes, each at a fixed cost.
"""

from __future__ import annotations

import math

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from domgrove.llm.common import Cached, map_rows

WORD_START = "▁"
BYTE_COST = -30.0


def read_pieces(model_file: str = "piece_bpe_32k.model") -> dict[str, float]:
    """Log-probabilities of the ordinary pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model_file))
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 2) for r in range(len(names))))
    return {p: -math.log(r + 2) - total for r, p in enumerate(names)}


class Trie:
    """Prefixes with forward scores and counts; `nodes` bounds its size, `long` what is inserted."""

    def __init__(self, pieces: dict[str, float], nodes: int = 400_000, long: int = 256):
        self.pieces, self.most, self.long = pieces, nodes, long
        self.longest = max(map(len, pieces), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.number = [0.0], [0]

    def best(self, word: str, end: int, scores: list[float], numbers: list[int]) -> tuple[float, int]:
        """Score and count of word[:end] from those of its prefixes; of equal scores, fewest pieces."""
        width = len(word[end - 1].encode("utf-8", "surrogatepass"))
        top, least = scores[end - 1] + BYTE_COST * width, numbers[end - 1] + width
        for start in range(max(0, end - self.longest), end):
            cost = self.pieces.get(word[start:end])
            if cost is not None:
                value = scores[start] + cost
                if value > top or value == top and numbers[start] < least:
                    top, least = value, numbers[start] + 1
        return top, least

    def count(self, word: str) -> int:
        """Pieces of the best segmentation of the word."""
        if len(self.score) > self.most:
            self.clear()
        scores, numbers, node = [0.0], [0], 0
        for end in range(1, len(word) + 1):
            if end <= self.long:
                key = node << 21 | ord(word[end - 1])
                at = self.child.get(key)
                if at is None:
                    at = self.child[key] = len(self.score)
                    value, number = self.best(word, end, scores, numbers)
                    self.score.append(value)
                    self.number.append(number)
                node = at
                scores.append(self.score[at])
                numbers.append(self.number[at])
            else:  # the rest of a very long word is shared with no other
                value, number = self.best(word, end, scores, numbers)
                scores.append(value)
                numbers.append(number)
        return numbers[-1]


def count_tokens(docs: DataFrame, model_file: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_words and n_tokens of every row.

    Null and empty texts have none. Repeated rows are counted each. Other columns of docs are not
    looked at.
    """
    def start():
        trie = Trie(read_pieces(model_file))
        counts = Cached(lambda word: trie.count(WORD_START + word.decode("utf-8", "replace")), 300_000)

        def each(texts):
            split = [t.split() for t in texts]
            return {"n_words": np.fromiter(map(len, split), np.int64, len(split)),
                    "n_tokens": [sum(map(counts.__getitem__, w)) for w in split]}

        return each

    return map_rows(docs, start, "n_words long, n_tokens long")
