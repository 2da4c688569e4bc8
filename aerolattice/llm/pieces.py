"""Encoding of the pieces between ASCII white space by the tokenizers library, with caches of the worker."""

from __future__ import annotations

import os
import re
from typing import Any

import numpy as np
from tokenizers import Tokenizer

WORD_END = "</w>"
#: Pieces and words that a worker keeps before it starts anew, and the longest piece worth keeping.
CACHE_PIECES = 800_000
CACHE_BYTES = 128
#: ASCII punctuation that may follow the letters of a piece: letters and punctuation are two pre-tokens.
TAIL = b".,;:!?*#$%&|()\"-"
#: Latin letters, where they aren't all ASCII.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")

_loaded: dict[str, Tokenizer] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer at ``path``, without truncation and padding; loaded once for each process."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _loaded[path] = found
    return _loaded[path]


class _Words(dict):
    """Ids of words of one pre-token each, already lower-cased: of a new one the library's model alone is asked."""

    def __init__(self, tok: Tokenizer, counts: bool):
        super().__init__({b"": 0 if counts else b""})
        self.split, self.counts, self.spelling = tok.model.tokenize, counts, byte_symbols()
        self.codes = [k.to_bytes(4, "little") for k in range(tok.get_vocab_size())]

    def __missing__(self, word: bytes) -> Any:
        found = self.split(word.decode() if word.isascii() else "".join(map(self.spelling.__getitem__, word)))
        ids = len(found) if self.counts else b"".join([self.codes[x.id] for x in found])
        if len(word) <= CACHE_BYTES:
            self[word] = ids
        return ids


class _Pieces(dict):
    """Ids of pieces; a piece of letters and punctuation is the sum of its two parts."""

    def __init__(self, tok: Tokenizer, counts: bool, table: dict[bytes, Any], words: _Words):
        super().__init__(table)
        self.tok, self.counts, self.words = tok, counts, words

    def __missing__(self, piece: bytes) -> Any:
        head = piece.rstrip(TAIL)
        if head.isalpha():  # ASCII letters alone
            ids = self.words[head.lower()] + self.words[piece[len(head) :]]
        elif not head.isascii() and LETTERS.fullmatch(text := head.decode("utf-8", "replace")):
            ids = self.words[text.lower().encode()] + self.words[piece[len(head) :]]
        else:
            found = self.tok.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
            ids = len(found) if self.counts else np.array(found, "<u4").tobytes()
        if len(piece) <= CACHE_BYTES:
            self[piece] = ids
        return ids


class PieceEncoder:
    """Ids, or their number, of pieces under a tokenizer that drops white space and marks word ends.

    No token reaches across white space, nor from a letter to the punctuation after it. So a piece of
    letters and punctuation is encoded as its two parts, which many pieces share; each of these is one
    pre-token, so the library's model is given it as it stands, in the byte alphabet. All other pieces go
    through the whole of the library. ``table`` holds pieces that are known from the start.
    """

    def __init__(self, path: str, counts: bool, table: dict[bytes, Any] | None = None):
        self.tok, self.counts, self.table = tokenizer(path), counts, table or {}
        self.words = _Words(self.tok, counts)
        self.known = _Pieces(self.tok, counts, self.table, self.words)

    def encode(self, texts: list[str]) -> list[Any]:
        """For each text the number of its ids, or the ids as little-endian unsigned 32-bit integers."""
        if len(self.words) > CACHE_PIECES:
            self.words = _Words(self.tok, self.counts)
        if len(self.known) > len(self.table) + CACHE_PIECES:
            self.known = _Pieces(self.tok, self.counts, self.table, self.words)
        join, find = sum if self.counts else b"".join, self.known.__getitem__
        return [join(map(find, t.encode("utf-8", "surrogatepass").split())) for t in texts]
