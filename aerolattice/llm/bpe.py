"""Byte-level BPE, encoding and decoding, by numpy merge rounds over many words at once.

The symbols of all words that a worker hasn't met yet stand in one flat array. In each round the keys of
neighbouring symbols are looked up by binary search in the sorted keys of the tokenizer's merges; every
word merges all places of its own lowest-ranked pair, from the left; words without a pair are done and
leave the array. A word of very many symbols would take as many rounds, so its pairs wait in a heap instead,
by rank and place. Words come from units of white space and what follows it up to the next white space;
a worker keeps the ids of the units it has met, within a bound.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .pieces import byte_symbols, tokenizer

#: A unit: ASCII white space and the text up to the next one.
UNIT = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: White space beyond ASCII. Its runs may reach over units, so texts with it are one unit.
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A unit of Latin letters after a blank or nothing, and the ASCII punctuation after them: two words.
PLAIN_UNIT = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&|()\"-]*)")
#: Units and words that a worker keeps before it starts anew, and the longest unit worth keeping.
CACHE_UNITS, UNIT_CHARS = 250_000, 128
#: Symbols beyond which a word is merged by a heap.
LONG_WORD = 1024
NO_RANK = np.iinfo(np.int64).max


class ByteBpe:
    """The tokenizer of a byte-level BPE file, with its own merges and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[side]] for p in pairs], np.int64) for side in (0, 1))
        self.base = len(vocab)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.split = tokenizer(path).pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if longest_first else None
        self.to_byte = {c: b for b, c in enumerate(byte_symbols())}
        texts = {i: bytes(map(self.to_byte.__getitem__, t)) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.texts = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.known: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {b"": b""}

    def forget(self) -> None:
        """Empties the caches, which a worker that goes on to other work would else keep."""
        self.known, self.words = {}, {b"": b""}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as encode() gives them."""
        out = [self._merge_long(w) if len(w) > LONG_WORD else b"" for w in words]
        words = [b"" if len(w) > LONG_WORD else w for w in words]
        lens = np.array([len(w) for w in words], np.int64)
        names = np.flatnonzero(lens)
        lens = lens[names]
        flat = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        while len(names):
            starts = np.cumsum(lens) - lens
            owner = np.repeat(np.arange(len(names)), lens)
            key = np.append(flat[:-1] * self.base + flat[1:], -1)
            key[starts + lens - 1] = -1
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], NO_RANK)
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NO_RANK
            if done.any():
                coded = flat.astype("<u4").tobytes()
                for name, b, n in zip(names[done].tolist(), (4 * starts[done]).tolist(), (4 * lens[done]).tolist(), strict=True):
                    out[name] = coded[b : b + n]
            here = np.flatnonzero((rank == lowest[owner]) & (rank != NO_RANK))
            follows = np.append(False, np.diff(here) == 1)  # such places overlap: of a run, every other one counts
            run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(here))))
            here = here[(np.arange(len(here)) - run) % 2 == 0]
            flat[here] = self.merged[at[here]]
            stays = ~done[owner]
            stays[here + 1] = False
            lens = (lens - np.bincount(owner[here], minlength=len(names)))[~done]
            flat, names = flat[stays], names[~done]
        return out

    def _merge_long(self, word: bytes) -> bytes:
        """The ids of one word: always the leftmost pair of the lowest rank merges."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        keys = [a * self.base + b for a, b in zip(ids, ids[1:], strict=False)]
        heap = [(self.pairs[key][0], at, key) for at, key in enumerate(keys) if key in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, at, key = heapq.heappop(heap)
            right = after[at]
            if ids[at] < 0 or right >= len(ids) or ids[at] * self.base + ids[right] != key:
                continue  # one of the two has merged since
            ids[at], ids[right], after[at] = self.pairs[key][1], -1, after[right]
            if after[at] < len(ids):
                before[after[at]] = at
                if found := self.pairs.get(new := ids[at] * self.base + ids[after[at]]):
                    heapq.heappush(heap, (found[0], at, new))
            if (left := before[at]) >= 0 and (found := self.pairs.get(new := ids[left] * self.base + ids[at])):
                heapq.heappush(heap, (found[0], left, new))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _split(self, unit: str) -> list[bytes | int]:
        """The words of ``unit`` and the ids of special tokens in it."""
        found: list[bytes | int] = []
        for piece in self.special_pattern.split(unit) if self.special_pattern else [unit]:
            if piece in self.special:
                found.append(self.special[piece])
            elif piece:
                found += [bytes(map(self.to_byte.__getitem__, word)) for word, _ in self.split(piece)]
        return found

    def learn(self, units: set[str]) -> None:
        """Puts the ids of ``units`` into ``known``; a unit of letters and punctuation has two words."""
        if len(self.words) > CACHE_UNITS:
            self.words = {b"": b""}
        plain, heads, tails = [], [], []
        parts: dict[str, list[bytes | int]] = {}
        for unit in units:
            if m := PLAIN_UNIT.fullmatch(unit):
                plain.append(unit)
                heads.append(m[1].encode())
                tails.append(m[2].encode())
            else:
                parts[unit] = self._split(unit)
        new = set(heads).union(tails, (w for found in parts.values() for w in found if isinstance(w, bytes)))
        words = list(new.difference(self.words))
        self.words.update(zip(words, self.merge(words), strict=True))
        ids = self.words.__getitem__
        self.known.update(zip(plain, map(add, map(ids, heads), map(ids, tails)), strict=True))
        for unit, found in parts.items():
            self.known[unit] = b"".join(ids(x) if isinstance(x, bytes) else x.to_bytes(4, "little") for x in found)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        units = [[t] if WIDE_SPACE.search(t) else UNIT.findall(t) for t in texts]
        distinct = set().union(*units)
        misses = distinct.difference(self.known)
        if len(self.known) + len(misses) > CACHE_UNITS:
            self.known, misses = {}, distinct
        self.learn(misses)
        out = [b"".join(map(self.known.__getitem__, us)) for us in units]
        for unit in misses:
            if len(unit) > UNIT_CHARS:
                del self.known[unit]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids as encode() gives them; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode(text: Column, tokenizer_path: str) -> Column:
    """Ids of ``text`` as binary: little-endian unsigned 32-bit integers. Null is as empty: no ids.

    Special tokens that stand in a text get their ids, none are added. Each row depends on its own text
    alone.
    """

    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = byte_bpe(tokenizer_path)
        try:
            for batch in batches:
                yield pd.Series([ids for part in slices(batch.fillna("").tolist()) for ids in bpe.encode(part)], dtype="object")
        finally:
            bpe.forget()

    return run(text)


def decode(ids: Column, tokenizer_path: str) -> Column:
    """The text of ``ids`` as encode() gives them, special tokens included. Null is as no ids: empty."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = byte_bpe(tokenizer_path)
        for batch in batches:
            yield pd.Series([bpe.decode(b or b"") for b in batch], dtype="object")

    return run(ids)


def round_trip(df: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``df`` with ``token_ids`` and ``decoded`` for its ``text``; columns of these names are replaced.

    As encode() and decode() after each other, in one pass through one Python worker.
    """

    @F.pandas_udf("token_ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(tokenizer_path)
        try:
            for batch in batches:
                ids = [b for part in slices(batch.fillna("").tolist()) for b in bpe.encode(part)]
                yield pd.DataFrame({"token_ids": ids, "decoded": [bpe.decode(b) for b in ids]}, dtype="object")
        finally:
            bpe.forget()

    both = F.col("_round_trip")
    rest = df.drop("token_ids", "decoded") if text not in ("token_ids", "decoded") else df
    done = rest.withColumn("_round_trip", run(F.col(text)))
    return done.withColumn("token_ids", both.token_ids).withColumn("decoded", both.decoded).drop("_round_trip")
