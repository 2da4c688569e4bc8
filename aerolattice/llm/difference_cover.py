"""Suffix sorting by a difference cover modulo 3, in numpy: the part of one task.

Suffixes at places 1 and 2 modulo 3 are the sample. Their triples are sorted and named; the string of
the names is sorted by the same way, until names are unique or reach far enough; the other suffixes
follow from their first symbol and the rank of the sampled suffix after it, and are merged in.
"""

from __future__ import annotations

import numpy as np

#: Below this many names, three of them fit one 64-bit key.
KEY_NAMES = 1 << 21


def _joined(high: np.ndarray, low: np.ndarray, below: int) -> np.ndarray:
    return high * np.int64(below) + low


def _triple_keys(first: np.ndarray, second: np.ndarray, third: np.ndarray, below: int) -> np.ndarray:
    """One number for each triple, in their order. All parts are less than ``below``."""
    pairs = _joined(first, second, below)
    return _joined(_named(pairs)[0] if below >= KEY_NAMES else pairs, third, below)


def _named(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each key among the different ones, and how many these are."""
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    names = np.empty(len(keys), np.int32)
    names[order] = np.cumsum(np.append(0, keys[1:] != keys[:-1]), dtype=np.int32)
    return names, int(names[order[-1]]) + 1


def suffix_ranks(symbols: np.ndarray, reach: int) -> np.ndarray:
    """A rank for each suffix of ``symbols`` (integers of 32 bits, at least 1), in the order of their first ``reach`` symbols.

    Suffixes that agree so far get neighbouring ranks in any order.
    """
    n = len(symbols)
    out = np.empty(n, np.int32)
    if reach <= 1 or n < 3:
        out[np.argsort(symbols) if reach <= 1 else np.lexsort([np.append(symbols[k:], np.zeros(k, np.int32)) for k in range(n - 1, -1, -1)] if n else [symbols])] = np.arange(n)
        return out
    s = np.zeros(n + 3, np.int32)
    s[:n] = symbols
    del symbols
    top = int(s.max()) + 1
    ones, twos, rest = (np.arange(k, n, 3, np.int32) for k in (1, 2, 0))
    sample = np.concatenate([ones, twos])
    names, kinds = _named(_triple_keys(s[sample], s[sample + 1], s[sample + 2], top))
    if kinds < len(sample):
        names = np.insert(names + np.int32(2), len(ones), 1)
        names = np.delete(suffix_ranks(names, -(-reach // 3)), len(ones))
    rank = np.zeros(n + 3, np.int32)
    rank[sample] = names + 1
    sample = sample[np.argsort(names)]
    below = max(top, int(names.max()) + 2)
    del names

    def by_one(at: np.ndarray) -> np.ndarray:
        return _joined(s[at], rank[at + 1], below)

    own = by_one(rest)
    in_order = np.argsort(own)
    rest, own = rest[in_order], own[in_order]
    less = np.searchsorted(np.sort(by_one(ones)), own)
    del own, in_order
    both = np.concatenate([twos, rest])
    by_two = _triple_keys(s[both], s[both + 1], rank[both + 2], below)
    less += np.searchsorted(np.sort(by_two[: len(twos)]), by_two[len(twos) :])
    del both, by_two, s, rank
    slots = np.maximum.accumulate(less) + np.arange(len(rest))
    out[rest] = slots
    free = np.ones(n, bool)
    free[slots] = False
    out[sample] = np.flatnonzero(free)
    return out


def equal_prefix_blocks(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of their suffixes of ``text`` (bytes), and for each the number of its block.

    A block holds the starts whose first ``length`` bytes are equal; neighbours in the order are compared.
    """
    ranks = suffix_ranks(text + np.int32(1), length)
    ordered = starts[np.argsort(ranks[starts])]
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    differs = np.ones(len(ordered), bool)
    for k in range(1, len(ordered), 100_000):
        these = ordered[k : k + 100_000]
        differs[k : k + 100_000] = (windows[these] != windows[ordered[k - 1 : k - 1 + len(these)]]).any(axis=1)
    return ordered, np.cumsum(differs) - 1
