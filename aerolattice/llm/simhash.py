"""SimHash fingerprints and the groups of documents whose fingerprints are near.

The fingerprints are dealt out so that no task needs them all: two that differ in at most RADIUS = 4 bits agree
on one of five blocks of bits at least, so each pair meets in one of five tables, in the bucket of the block.
A bucket holds one of 4096 or more fingerprints of all; within it a hierarchical index in Gray order finds the
pairs: fingerprints are sorted by Gray rank, so that neighbours share many bits;
each node has the bits that all below it share, as a mask and a pattern, without those its parent has;
a query adds up its differences on the way down, drops a node when they exceed the radius, and takes the
whole node when even its free bits can't. Nodes whose members are already in the query's group
are passed over, so that a bucket full of near copies takes no quadratic time and gives one link for
each member instead of all pairs.

Near copies by Jaccard similarity are found by several fingerprints: a pair at 0.8 shares a whole block of
16 bits in one of 40 tables 95 times of 100. There the index searches a wide radius, and a pair that is found
counts only if the shingles of both texts are as similar. It searches twice: the first time it gives each member's
nearest partner, so that tests of few pairs tell most groups; the second time it gives, once each, all pairs
between different groups whose shingles can be as similar, by the number that any other member has too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import shuffle_partitions, slices, written
from .components import components, forest_roots

RADIUS = 4
#: Bits of the five blocks, as (lowest bit, bits).
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
FANOUT = 8
#: Fingerprints of a sketch, and the Jaccard similarity of shingles, where near copies are to be found.
SEVERAL, SIMILARITY = 10, 0.8
#: Blocks of bits of which a sketch's fingerprints share one, and the bits that they differ in at most.
QUARTERS, REACH = ((0, 16), (16, 16), (32, 16), (48, 16)), 14
#: Rounds that test one link of each group, before all that are left are tested.
HOOKS = 7
#: Pairs of a query and a node that are looked at together, about.
FRONTIER = 1 << 19
#: Members that are searched together: full buckets up to so many.
HELD = 1 << 16
_U = np.uint64


def shingles(text: str, words: int, seed: int) -> list[int]:
    """XXH64 of each shingle of so many words, repeats too; fewer words are one shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    begins, ends = np.append(0, ends[:-1]), ends - 1
    k = min(words, len(found))
    begins, ends = begins[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    return [xxh64_intdigest(joined[b:e], seed) for b, e in zip(begins, ends, strict=True)]


def fingerprints(texts: list[str], words: int, seed: int, several: int = 1, distinct: bool = False) -> np.ndarray:
    """64-bit SimHash of each text, from XXH64 of its shingles of so many words: a column, or ``several``.

    All but the first column take the hashes mixed anew. ``distinct`` counts each shingle of a text once.
    """
    hashes: list[int] = []
    counts = []
    for text in texts:
        found = shingles(text, words, seed)
        found = list(set(found)) if distinct else found
        hashes += found
        counts.append(len(found))
    n = np.array(counts, np.int64)
    out = np.zeros((len(texts), several), _U)
    full = np.flatnonzero(n)
    first = np.array(hashes, "<u8")
    for k in range(several if len(full) else 0):
        h = first if k == 0 else (first ^ _U(k * 0x9E3779B97F4A7C15 % (1 << 64))) * _U(0xD6E8FEB86659FD93)
        h = h if k == 0 else (h ^ (h >> _U(32))) * _U(0x9E3779B97F4A7C15)
        h = h if k == 0 else h ^ (h >> _U(29))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = n[full]
        ones = np.add.reduceat(bits, np.cumsum(own) - own, axis=0, dtype=np.int64)
        out[full, k] = np.packbits(2 * ones > own[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprint(text: Column, words: int = 4, seed: int = 42) -> Column:
    """SimHash of ``text`` as a long: lower-cased A-Z, shingles of ``words`` words between ASCII white space.

    A bit is set if it is set in over half of the shingles' hashes, repeats counted. Fewer words than
    ``words`` are one shingle; none, an empty text or null give 0.
    """

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [fingerprints(p, words, seed)[:, 0] for p in slices(batch.fillna("").tolist())]
            yield pd.Series(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))

    return run(text)


def sketch(text: Column, words: int, seed: int, several: int) -> Column:
    """``several`` independent fingerprints of the set of shingles of ``text``, in an array."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [fingerprints(p, words, seed, several, distinct=True).view(np.int64) for p in slices(batch.fillna("").tolist())]
            yield pd.Series([row for p in parts for row in p], dtype="object")

    return run(text)


def shingle_set(text: Column, words: int, seed: int) -> Column:
    """The hashes of the distinct shingles of ``text``, in an array."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.array(list(set(shingles(t, words, seed))), _U).view(np.int64) for t in batch.fillna("")], dtype="object")

    return run(text)


def gray_rank(value: Column) -> Column:
    """The place of ``value`` in the Gray order of 64-bit numbers: each bit is the parity of those above."""
    for shift in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, shift))
    return value


class GrayIndex:
    """The members of some buckets, sorted by bucket and Gray rank, with their nodes and groups."""

    def __init__(self, members: np.ndarray, buckets: np.ndarray, radius: int, sketches: np.ndarray | None = None, most: int = 0):
        """``buckets`` numbers each member's bucket, ascending. With ``sketches``, a row of fingerprints for
        each member, a pair must also differ in at most ``most`` bits of these.
        """
        self.members, self.radius, self.sketches, self.most = members, radius, sketches, most
        self.label = np.arange(len(members))
        #: Of each level from the leaves up: pairs of a query and a node that were looked at, and that went further.
        self.seen: dict[int, list[int]] = {}
        first = np.flatnonzero(np.diff(buckets, prepend=-1))
        place = np.arange(len(members)) - first[np.cumsum(np.diff(buckets, prepend=-1) != 0) - 1]
        #: Of each level from the leaves up: first member and end of each node, first child, shared bits, pattern, and bits that the parent hasn't.
        self.begin: list[np.ndarray] = []
        self.masks: list[np.ndarray] = []
        self.patterns: list[np.ndarray] = []
        self.parent: list[np.ndarray] = []
        size = FANOUT
        both, either = members, members
        starts = np.arange(len(members))
        while True:
            new = np.flatnonzero((place[starts] % size == 0))
            self.parent.append(np.cumsum(np.isin(np.arange(len(starts)), new)) - 1)
            both, either = np.bitwise_and.reduceat(both, new), np.bitwise_or.reduceat(either, new)
            starts = starts[new]
            self.begin.append(starts)
            self.masks.append(~(both ^ either))
            self.patterns.append(both)
            if len(starts) == len(first):
                break
            size *= FANOUT
        self.root = np.cumsum(np.diff(buckets, prepend=-1) != 0) - 1
        top = np.zeros(1, _U)
        self.own = [m & ~(self.masks[k + 1][self.parent[k + 1]] if k + 1 < len(self.masks) else top) for k, m in enumerate(self.masks)]

    def _children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of each of ``node``, and for each child the place of its node: members below level 0."""
        parent = self.parent[level]
        low, high = np.searchsorted(parent, node), np.searchsorted(parent, node, side="right")
        n = high - low
        at = np.repeat(np.arange(len(node)), n)
        return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[at], at

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of ``queries`` to later members within the radius; none within one group."""
        links: list[np.ndarray] = []
        n = len(self.members)
        query, node = queries, self.root[queries]
        far = np.zeros(len(query), np.int64)
        for level in range(len(self.begin) - 1, -1, -1):
            begin = self.begin[level]
            end = np.append(begin[1:], n)
            low = np.minimum.reduceat(self.label, begin)
            alike = low == np.maximum.reduceat(self.label, begin)
            value = self.members[query]
            far = far + np.bitwise_count((value ^ self.patterns[level][node]) & self.own[level][node])
            stays = (far <= self.radius) & (end[node] - 1 > query) & ~(alike[node] & (low[node] == self.label[query]))
            seen = self.seen.setdefault(level, [0, 0])
            seen[0], seen[1] = seen[0] + len(stays), seen[1] + int(stays.sum())
            query, node, far = query[stays], node[stays], far[stays]
            whole = far + 64 - np.bitwise_count(self.masks[level][node]) <= self.radius
            if self.sketches is None and whole.any():
                taken, which = np.unique(node[whole], return_index=True)
                links.append(np.stack([query[whole], begin[node[whole]]]))
                for k, _ in zip(taken.tolist(), which, strict=True):
                    inside = np.arange(begin[k], end[k])
                    links.append(np.stack([np.full(len(inside), begin[k]), inside]))
                query, node, far = query[~whole], node[~whole], far[~whole]
            child, at = self._children(level, node)
            query, node, far = query[at], child, far[at]
            if level == 0:
                free = ~self.masks[0][self.parent[0][node]]
                far = far + np.bitwise_count((self.members[query] ^ self.members[node]) & free)
                near = (far <= self.radius) & (node > query)
                if self.sketches is not None:
                    query, node = query[near], node[near]
                    near = np.bitwise_count(self.sketches[query] ^ self.sketches[node]).sum(axis=1) <= self.most
                links.append(np.stack([query[near], node[near]]))
        found = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
        return found[0], found[1]

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merges the groups of linked members; a group's label is its first member. Gives the links that merged two."""
        used = [np.zeros((2, 0), np.int64)]
        while True:
            low, high = np.minimum(self.label[a], self.label[b]), np.maximum(self.label[a], self.label[b])
            apart = low != high
            if not apart.any():
                return np.concatenate(used, axis=1)
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            order = np.lexsort((low, high))
            hooks = order[np.flatnonzero(np.diff(high[order], prepend=-1))]
            used.append(np.stack([a[hooks], b[hooks]]))
            self.label[high[hooks]] = low[hooks]
            while True:
                further = self.label[self.label]
                if (further == self.label).all():
                    break
                self.label = further

    def groups(self) -> np.ndarray:
        """The label of each member after all have been searched, in blocks that grow."""
        most = self._block()
        at, block = 0, min(64, most)
        while at < len(self.members):
            self.join(*self.search(np.arange(at, min(at + block, len(self.members)))))
            at, block = at + block, min(block * 2, most)
        return self.label

    def _block(self) -> int:
        """Queries that are searched at once, so that FRONTIER holds even if all of a bucket are near."""
        return max(1, min(4096, FRONTIER // int(np.bincount(self.root).max())))

    def nearest(self, sure: int) -> np.ndarray:
        """Members a and b of some near pairs, whether their sketches differ in at most ``sure`` bits, and whether a has others.

        Sure pairs join groups, and only those that merge two are given; of the others, the nearest of each member a.
        A pair that isn't given has two members with others.
        """
        most, n = self._block(), len(self.members)
        at, block = 0, min(64, most)
        joined = [np.zeros((2, 0), np.int64)]
        partner, least, partners = np.full(n, -1), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)

        def note(a: np.ndarray, b: np.ndarray, far: np.ndarray, of: np.ndarray) -> None:
            """Counts the pairs of two groups for those members that are in ``of``, and keeps the nearest."""
            one, other, far = np.append(a, b), np.append(b, a), np.append(far, far)
            apart = np.flatnonzero((far > sure) & (self.label[one] != self.label[other]) & of[one])
            partners[:] += np.bincount(one[apart], minlength=n)
            apart = apart[far[apart] < least[one[apart]]]
            apart = apart[np.lexsort((far[apart], one[apart]))]
            apart = apart[np.flatnonzero(np.diff(one[apart], prepend=-1))]
            partner[one[apart]], least[one[apart]] = other[apart], far[apart]

        while at < n:
            a, b = self.search(np.arange(at, min(at + block, n)))
            far = np.bitwise_count(self.sketches[a] ^ self.sketches[b]).sum(axis=1, dtype=np.int64)
            joined.append(self.join(a[far <= sure], b[far <= sure]))
            note(a, b, far, np.ones(n, bool))
            at, block = at + block, min(block * 2, most)
        # whose nearest has come into the own group since may have others outside: their buckets are searched again, by the groups as they are now
        lost = (partner >= 0) & (self.label == self.label[partner]) & (partners > 1)
        partner[lost], least[lost], partners[lost] = -1, np.iinfo(np.int64).max, 0
        again = np.flatnonzero(np.isin(self.root, self.root[lost]))
        for at in range(0, len(again), most):
            a, b = self.search(again[at : at + most])
            some = lost[a] | lost[b]
            a, b = a[some], b[some]
            note(a, b, np.bitwise_count(self.sketches[a] ^ self.sketches[b]).sum(axis=1, dtype=np.int64), lost)
        first = np.concatenate(joined, axis=1)
        own = np.flatnonzero(partner >= 0)
        own = own[self.label[own] != self.label[partner[own]]]
        rest = np.stack([own, partner[own], np.zeros_like(own), partners[own] > 1])
        return np.concatenate([np.vstack([first, np.ones_like(first[:1]), np.zeros_like(first[:1])]), rest], axis=1)

    def between(self, label: np.ndarray) -> np.ndarray:
        """Members a and b of all near pairs whose ``label``, a number for each member, differs."""
        self.label = label
        most = self._block()
        found = [self.search(np.arange(at, min(at + most, len(label)))) for at in range(0, len(label), most)]
        a, b = (np.concatenate(ends) for ends in zip(*found, strict=True))
        return np.stack([a, b])[:, label[a] != label[b]]


def _link(radius: int, most: int, sure: int | None = None, similarity: float | None = None):
    """Links of the members of each bucket to the first of their group; rows come sorted by bucket and Gray rank.

    With ``sure``, the pairs that GrayIndex.nearest() gives instead. With ``similarity``, all pairs of different
    ``root`` that meet in no earlier part and that can be as similar: of ``size`` shingles, ``shared`` ones
    may be in another member.
    """

    def first_part(x: np.ndarray) -> np.ndarray:
        tables = [((d >> _U(at)) & _U((1 << bits) - 1) == 0) & (np.bitwise_count(d) <= radius) for d in x.T for at, bits in QUARTERS]
        return np.argmax(np.stack(tables), axis=0)

    def between(index: GrayIndex, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = index.between(np.unique(rows["root"], return_inverse=True)[1])
        size, shared, part = (rows[c].to_numpy(np.int64) for c in ("size", "shared", "part"))
        able = (1 + similarity) * np.minimum(shared[a], shared[b]) >= similarity * (size[a] + size[b]) - 1e-6
        a, b = a[able], b[able]
        if len(a):
            here = first_part(index.sketches[a] ^ index.sketches[b]) == part[a]
            a, b = a[here], b[here]
        u, root = rows["id"].to_numpy(np.int64), rows["root"].to_numpy(np.int64)
        a, b = np.where(u[a] > u[b], a, b), np.where(u[a] > u[b], b, a)
        return pd.DataFrame({"u": u[a], "v": u[b], "sure": np.zeros_like(a), "ru": root[a], "rv": root[b]})

    def of(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        bucket = rows.groupby(["part", "bits"], sort=False).ngroup().to_numpy()
        alone = (np.diff(bucket, prepend=-1) != 0) & (np.diff(bucket, append=-1) != 0)
        rows, bucket = rows[~alone], bucket[~alone]
        if not len(rows):
            none = ["u", "v", *(["sure"] if sure is not None or similarity else []), *(["ru", "rv"] if similarity else ["more_u", "more_v"] if sure is not None else [])]
            return pd.DataFrame({c: [] for c in none}).astype("int64")
        sketches = np.stack(rows["sketch"].tolist()).view(_U) if "sketch" in rows else None
        bucket = np.cumsum(np.diff(bucket, prepend=-1) != 0) - 1
        index = GrayIndex(rows["fp"].to_numpy(np.int64).view(_U), bucket, radius, sketches, most)
        if similarity:
            return between(index, rows)
        u = rows["id"].to_numpy(np.int64)
        if sure is not None:
            a, b, near, more = index.nearest(sure)
            more_u, more_v = np.where(u[a] > u[b], more, 0), np.where(u[a] > u[b], 0, more)
            return pd.DataFrame({"u": np.maximum(u[a], u[b]), "v": np.minimum(u[a], u[b]), "sure": near, "more_u": more_u, "more_v": more_v})
        label = index.groups()
        least = np.full(len(u), np.iinfo(np.int64).max)
        np.minimum.at(least, label, u)
        v = least[label]
        return pd.DataFrame({"u": u[u != v], "v": v[u != v]})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full: list[pd.DataFrame] = []  # buckets that are there as a whole
        held: list[pd.DataFrame] = []  # the last bucket so far
        size, key = 0, None
        for batch in batches:
            if not len(batch):
                continue
            part, bits = batch["part"].to_numpy(), batch["bits"].to_numpy()
            other = np.flatnonzero((part != part[-1]) | (bits != bits[-1]))
            begin = int(other[-1]) + 1 if len(other) else 0
            if begin or key != (part[-1], bits[-1]):
                full += [*held, batch.iloc[:begin]]
                size = sum(map(len, full))
                held, key = [], (part[-1], bits[-1])
            held.append(batch.iloc[begin:])
            if size > HELD:
                yield of(full)
                full, size = [], 0
        if full or held:
            yield of(full + held)

    return link


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between the distinct values of ``prints.fp``; their components are those of all near pairs."""
    keyed = prints.select(F.col("fp").alias("id")).distinct().select("id", F.inline(F.array(*_keys(F.col("id"), [(b,) for b in BLOCKS]))))
    return _sorted(keyed, F.col("id")).mapInPandas(_link(radius, 0), "u long, v long").distinct()


def _keys(value: Column, tables: list[tuple], first: int = 0) -> list[Column]:
    """The place of ``value`` in each of ``tables``, which take some blocks of bits each and are numbered from ``first``."""
    keys = []
    for part, blocks in enumerate(tables, first):
        bits = F.lit(0).cast("long")
        for at, width in blocks:
            bits = F.shiftleft(bits, width) + F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(F.struct(F.lit(part).alias("part"), bits.alias("bits")))
    return keys


def _sorted(dealt: DataFrame, fp: Column) -> DataFrame:
    """``dealt`` (id, part, bits) with each bucket in one task, in Gray order of ``fp``."""
    n = shuffle_partitions(dealt.sparkSession)
    return dealt.repartition(n, "part", "bits").withColumn("fp", fp).withColumn("rank", gray_rank(F.col("fp"))).sortWithinPartitions("part", "bits", "rank", "id")


def _in_quarters(prints: DataFrame, several: int) -> DataFrame:
    """``prints`` (id, sketch and others) once for each quarter of each fingerprint, each bucket in one task."""
    tables = [(block,) for block in QUARTERS]
    keys = [key for k in range(several) for key in _keys(F.col("sketch")[k], tables, k * len(tables))]
    dealt = prints.select("*", F.inline(F.array(*keys)))
    return _sorted(dealt, F.get("sketch", F.floor(F.col("part") / len(tables)).cast("int")))  # the fingerprint that the bits are of


def candidates(prints: DataFrame, several: int, most: int, sure: int) -> DataFrame:
    """Pairs (u, v, sure, more_u, more_v) of ids of ``prints`` (id, sketch) whose sketches differ in at most ``most`` bits.

    Of the pairs of a bucket, those of at most ``sure`` bits that make its groups, and each member's nearest other one:
    a few rows a member, and one at least for each that has any partner. Other pairs are between two members of
    which ``more`` is 1 in some row.
    """
    found = _in_quarters(prints, several).mapInPandas(_link(REACH, most, sure), "u long, v long, sure long, more_u long, more_v long")
    return found.groupBy("u", "v").agg(*[F.max(c).alias(c) for c in ("sure", "more_u", "more_v")])


def candidates_between(prints: DataFrame, several: int, most: int, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs (u, v, sure, ru, rv) of ids of ``prints`` whose ``roots`` (id, root), ru and rv, differ and whose
    sketches differ in at most ``most`` bits, each once, but for those whose ``sets`` (id, set) can't have the similarity.

    A shingle that one member alone has is in no other's set, so what two share is at most the lesser count of
    the rest, and a member of which too much is its own has no such pair at all. Counts of shingles are summed up
    before the shuffle.
    """
    own = sets.join(prints.select("id"), "id", "left_semi")
    once = own.select("id", F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    alone = once.groupBy("id").agg(F.count("*").alias("alone"))
    sizes = own.select("id", F.size("set").alias("size")).join(alone, "id", "left")
    sizes = sizes.select("id", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))
    able = sizes.where(F.col("shared") >= similarity * F.col("size") - 1e-6)
    members = written(prints.join(able, "id").join(roots, "id"), "members")
    return _in_quarters(members, several).mapInPandas(_link(REACH, most, similarity=similarity), "u long, v long, sure long, ru long, rv long")


def similar_groups(pairs: DataFrame, sets: DataFrame, similarity: float, roots: DataFrame) -> DataFrame:
    """``roots`` (id, root) joined by those ``pairs`` (u, v, sure, ru, rv) whose ``sets`` (id, set) have the Jaccard similarity.

    A pair is tested unless tested ones already join its roots ru and rv, so that a large group takes few tests: first
    some rounds of one pair of each group to an earlier one, a sure one if there is, as long as they
    merge any, then all that are left.
    """
    left, k = written(pairs, "pairs"), 0
    while True:
        hook, chosen = k < HOOKS, left
        if hook:
            order = F.xxhash64("u", "v", F.lit(k)) if k else F.least("ru", "rv")
            pick = F.min(F.struct((1 - F.col("sure")).alias("loose"), order.alias("order"), "u", "v", "ru", "rv")).alias("p")
            chosen = left.groupBy(F.greatest("ru", "rv").alias("of")).agg(pick).select("p.u", "p.v", "p.ru", "p.rv")
        a, b = sets.select(F.col("id").alias("u"), F.col("set").alias("a")), sets.select(F.col("id").alias("v"), F.col("set").alias("b"))
        shared = F.size(F.array_intersect("a", "b"))
        alike = shared >= similarity * (F.size("a") + F.size("b") - shared)
        tested = written(chosen.join(a, "u").join(b, "v").select("u", "v", "ru", "rv", (alike & (shared > 0)).alias("alike")), "tested")
        merged = tested.where("alike").select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v"))
        merges = not merged.isEmpty()
        if merges:
            to = (forest_roots(merged) if hook else components(merged)).select(F.col("u").alias("root"), F.col("v").alias("to"))
            roots = written(roots.join(to, "root", "left").select("id", F.coalesce("to", "root").alias("root")), "roots")
        if not hook:
            return roots
        left = left.join(tested.select("u", "v"), ["u", "v"], "left_anti")
        for end in ("ru", "rv") if merges else ():
            left = left.join(to.withColumnRenamed("root", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = written(left.where("ru <> rv"), "pairs")
        if left.isEmpty():
            return roots
        k = k + 1 if merges else HOOKS


def near_components(docs: DataFrame, words: int = 4, radius: int = RADIUS, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of ``docs``.

    Rows link when their fingerprints differ in at most ``radius`` (4 at most) bits; component_id is the
    smallest doc_id that links lead to, a row's own included. Texts without words, empty and null ones
    have fingerprint 0 and link as any other. Equal rows and rows with the same doc_id are rows of their
    own with the same component. A null doc_id is never the smallest; a component without others is null.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the tables find pairs of up to {RADIUS} differing bits")
    prints = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint(F.col(text), words, seed).alias("fp")), "prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = components(near_links(prints, radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = least.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(of_root, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = 5, several: int = SEVERAL, similarity: float = SIMILARITY, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near copies: that of the smallest doc_id, then of the least text hash.

    Two rows link if their sets of shingles have the Jaccard ``similarity``, as far as they meet: they share a
    quarter of one of ``several`` fingerprints, which differs in at most REACH bits, and all of these together
    differ in no more bits than such shingles do, with three standard errors to spare. Texts without words are near each other alone, null and empty ones too. Rows of null
    doc_id come last in their group; of equal rows one stays. Other columns pass through.
    """
    angle = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits, error = 64 * several * angle, np.sqrt(64 * several * angle * (1 - angle))
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    prints = written(hashed.select(F.col(doc_id).cast("long").alias("doc_id"), "_hash", sketch(F.col(text), words, seed, several).alias("sketch")), "sketches")
    prints = prints.withColumn("id", F.xxhash64("sketch"))
    most, members = int(bits + 3 * error), prints.select("id", "sketch").distinct()
    pairs = written(candidates(members, several, most, int(bits - 4 * error)), "candidates")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    one = F.min(F.struct("doc_id", "_hash")).alias("one")
    wanted = prints.join(ids, "id", "left_semi").groupBy("id").agg(one).select("id", F.col("one.doc_id").alias("_id"), F.col("one._hash").alias("_of"))
    texts = hashed.select(F.col(doc_id).cast("long").alias("_doc"), "_hash", F.col(text).alias("_text"))
    found = texts.join(wanted, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of")))
    sets = written(found.select("id", shingle_set(F.col("_text"), words, seed).alias("set")).dropDuplicates(["id"]), "shingles")
    first = pairs.select("u", "v", "sure", F.col("u").alias("ru"), F.col("v").alias("rv"))
    near = similar_groups(first, sets, similarity, ids.select("id", F.col("id").alias("root")))
    more = pairs.where("more_u = 1").select(F.col("u").alias("id")).union(pairs.where("more_v = 1").select("v")).distinct()
    others = candidates_between(members.join(more, "id", "left_semi"), several, most, near, sets, similarity)
    root = similar_groups(others, sets, similarity, near)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_hash")
    counted = prints.groupBy("id", "doc_id", "_hash").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_hash", "n")).alias("first")
    of_group = counted.join(root, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(first)
    kept = written(of_group.select(F.col("first.doc_id").alias("_kept_id"), F.col("first._hash").alias("_kept_hash"), F.col("first.n").alias("_n")), "kept")
    same = F.col(doc_id).eqNullSafe(F.col("_kept_id")) & (F.col("_hash") == F.col("_kept_hash"))
    single = hashed.join(kept.where("_n = 1"), same, "left_semi")
    repeated = hashed.join(kept.where("_n > 1"), same, "left_semi").dropDuplicates([doc_id, "_hash"])
    return single.unionByName(repeated).drop("_hash")
