"""Token ids of the byte-level vocabulary, many texts at a time.

Between two characters of which the second is a space before something else, the pre-tokeniser
always cuts; so the ids of a text are those of its pieces between single spaces, and a piece is
encoded once per worker while there is room to remember it. The ranks file holds the same
vocabulary as the JSON file; a test compares the ids.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator

import public_tokenizers
import tiktoken

#: A space with white space on both sides; texts that have one are encoded in one go.
WIDE = re.compile(r"(?<=\s) (?=\s)")
SPACES = [" " + chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]


def is_wide(text: str) -> bool:
    return any(s in text for s in SPACES) and WIDE.search(text) is not None


class Pieces(dict):
    """Ids, as bytes, of pieces with the space before them; keeps the first `limit` it is asked for."""

    def __init__(self, encoding: tiktoken.Encoding, limit: int):
        super().__init__()
        self.limit = limit
        self.any, self.one = encoding._core_bpe.encode_ordinary, encoding._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        text = " " + piece
        # Letters only: the pre-tokeniser leaves them in one piece with the space.
        value = array("I", self.one(text.encode()) if piece.isalpha() else self.any(text)).tobytes()
        if len(self) < self.limit:
            self[piece] = value
        return value


class Encoder:
    """Encodes texts to ids; each result is the little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, ranks_file: str = "byte_bpe_50k.tiktoken", limit: int = 150_000):
        with open(public_tokenizers.path(ranks_file), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=ranks, special_tokens={})
        self.pieces = Pieces(self.encoding, limit)

    def whole(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if is_wide(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.pieces.__getitem__, rest))

    def encode_all(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of UTF-8 texts, in order."""
        for text in texts:
            yield self.encode(text.decode("utf-8", "replace"))


_ENCODERS: dict[str, Encoder] = {}


def encoder(ranks_file: str = "byte_bpe_50k.tiktoken") -> Encoder:
    """One encoder for each worker process and file."""
    if ranks_file not in _ENCODERS:
        _ENCODERS[ranks_file] = Encoder(ranks_file)
    return _ENCODERS[ranks_file]


def forget() -> None:
    """Give back the memory of this worker's encoders."""
    _ENCODERS.clear()
