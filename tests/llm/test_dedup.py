import hashlib
import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from aerolattice.llm import components, queries, simhash, suffix_dedup
from aerolattice.llm.difference_cover import suffix_ranks


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text, words=4):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), seed=42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("sketched", [False, True])
def test_index_finds_all_near_pairs(sketched):
    rnd = np.random.default_rng(3)
    for _ in range(25):
        base = rnd.integers(0, 2**63, rnd.integers(1, 6)).astype(np.uint64)
        found = set()
        for _ in range(rnd.integers(2, 300)):
            x = int(rnd.choice(base))
            for b in rnd.integers(0, 64, rnd.integers(0, 8)):
                x ^= 1 << int(b)
            found.add(x)

        def gray(x):
            for s in (1, 2, 4, 8, 16, 32):
                x ^= x >> s
            return x

        rows = sorted((x % 3, gray(x), x) for x in found)
        members, buckets = np.array([r[2] for r in rows], np.uint64), np.unique([r[0] for r in rows], return_inverse=True)[1]
        sketches = members[:, None] if sketched else None
        label = simhash.GrayIndex(members, buckets, 4, sketches, 4).groups()
        near = [(i, j) for i in range(len(rows)) for j in range(i) if buckets[i] == buckets[j] and np.bitwise_count(members[i] ^ members[j]) <= 4]
        assert roots(len(rows), near) == label.tolist()


def test_the_index_drops_nodes_of_real_fingerprints(spark):
    """Fingerprints of the documents, among ever more random ones: nodes drop out, the more the larger the index."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    real = [r.fp % 2**64 for r in docs.select(simhash.fingerprint(F.col("text")).alias("fp")).distinct().collect()]
    rnd = np.random.default_rng(5)
    went = []
    for more in (0, 20_000, 150_000):
        fp = np.unique(np.concatenate([np.array(real, np.uint64), rnd.integers(0, 2**64, more, np.uint64)]))
        rank = fp.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(shift)
        members = fp[np.argsort(rank)]
        index = simhash.GrayIndex(members, np.zeros(len(members), int), 4)
        queries = np.flatnonzero(np.isin(members, np.array(real, np.uint64)))[:300]
        found = set(zip(*(x.tolist() for x in index.search(queries)), strict=True))
        near = {(int(i), int(j)) for i in queries for j in np.flatnonzero(np.bitwise_count(members ^ members[i]) <= 4) if j > i}
        assert near == {(i, j) for i, j in found if i != j}
        went.append(index.seen[0][1] * simhash.FANOUT / sum(len(members) - int(i) for i in queries))
    print(f"share of members that is compared bit by bit: {went}")
    assert went[0] > went[1] > went[2] and went[2] < 0.15


def check_components(docs, got):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    prints = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 4)])
    wanted = sorted((repr(rows[i][0]), f"{int(prints[i]):016x}", repr(rows[root[i]][0])) for i in range(len(rows)))
    assert wanted == sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got.collect())


def test_components_of_odd_rows(docs, none):
    check_components(docs, simhash.near_components(docs))
    assert simhash.near_components(none).count() == 0


def test_components_of_documents(spark, prose):
    check_components(prose["documents"], queries.op2_simhash(spark, "/root/testdata/sf0.001"))


def test_a_dense_group_is_one_component(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    rows = [(k, " ".join(base[:j] + ["changed"] + base[j + 1 :])) for k, j in enumerate(range(0, 400, 2))] + [(1000, " ".join(reversed(base)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_components(df, simhash.near_components(df))
    kept = simhash.representatives(df).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [0, 1000]


def test_representatives_of_odd_rows(docs, none):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    # null, empty and blank texts are one group; equal texts are one; the others differ
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "5", "None", "9", "10"])
    assert simhash.representatives(none).count() == 0


def test_recall_of_near_copies_against_brute_force(spark):
    rnd = random.Random(11)
    texts, near, apart = [], [], []
    for k in range(400):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 160))]
        other, n = list(words), len(words) // rnd.choice([35, 45, 55, 100])
        for at in rnd.sample(range(len(words)), max(1, n)):
            other[at] = f"x{rnd.randrange(5000)}"
        texts += [" ".join(words), " ".join(other)]
        a, b = (set(zip(*(w[i:] for i in range(5)), strict=False)) for w in (words, other))
        (near if 5 * len(a & b) >= 4 * len(a | b) else apart).append(k)
    assert len(near) > 200 and len(apart) > 50
    # a shingle that most of two texts repeats doesn't make them alike
    texts += [" ".join(["same"] * 300 + [f"{c}{i}" for i in range(60)]) for c in "yz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.representatives(df).select("doc_id").collect()}
    found = [k for k in range(400) if 2 * k + 1 not in kept]
    assert set(range(0, 800, 2)) <= kept and {800, 801} <= kept
    assert not set(found) & set(apart)
    assert len(set(found) & set(near)) >= 0.9 * len(near)


def test_components_of_links(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    root = roots(400, pairs)
    assert got == {i: root[i] for i in range(400) if root[i] != i}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
    parents = [(k, rnd.randrange(k)) for k in range(1, 300) if k % 7] + [(k, k - 1) for k in range(401, 500)]
    root = roots(500, parents)
    assert dict(map(tuple, components.forest_roots(spark.createDataFrame(parents, "u long, v long")).collect())) == {u: root[u] for u, _ in parents}
    assert components.forest_roots(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_removal(docs):
    first = {}
    for d, t in sorted(((d, t) for d, t in docs if d is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        hit = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i : i + 50]] < d:
                hit[i : i + 50] = True
        runs = int((np.diff(np.append(False, hit).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~hit[:-1]])
        out.append((repr(d), len(b), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removal(df, **sizes):
    got = suffix_dedup.remove_repeats(df, **sizes).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    return sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.h) for r in got.collect())


def test_suffix_ranks_are_in_order():
    rnd = random.Random(3)
    for _ in range(150):
        n, letters = rnd.randrange(120), rnd.choice([1, 2, 4, 200])
        s = np.array([rnd.randrange(1, letters + 1) for _ in range(n)], np.int64)
        got = [s[i:].tolist()[:60] for i in np.argsort(suffix_ranks(s, 60))]
        assert got == sorted(s[i:].tolist()[:60] for i in range(n))


@pytest.mark.parametrize(("at_once", "hot"), [(1_000_000, 1_000_000), (500, 1_000_000), (2000, 300), (2000, 1)])
def test_removal_against_brute_force(spark, at_once, hot):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abcé ") for _ in range(400)) for _ in range(6)]
    docs = []
    for i in range(120):
        text = ""
        for _ in range(rnd.randrange(6)):
            b, x = rnd.choice(base), rnd.randrange(350)
            text += b[x : x + rnd.randrange(1, 120)] + rnd.choice(["", "x", "ab" * 40, "q" * 70])
        docs.append((i, text))
    docs += [(7, docs[3][1]), (7, docs[7][1]), (None, docs[3][1]), (200, None)]
    assert removal(spark.createDataFrame(docs, "doc_id long, text string"), sort_bytes=at_once, hot_bytes=hot) == brute_removal(docs)


@pytest.mark.parametrize("hot", [1_000_000, 2000])
def test_a_passage_that_all_documents_hold(spark, hot):
    rnd = random.Random(9)
    passage = " ".join(f"word{rnd.randrange(1000)}" for _ in range(60))
    docs = [(i, f"{rnd.randrange(10**9)} {passage} {rnd.randrange(10**9)} " + "z" * (i % 90)) for i in range(600)]
    assert removal(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), hot_bytes=hot) == brute_removal(docs)


def test_windows_of_periodic_texts_come_once():
    """A window that a document repeats is one row with all its places, and settled places of different documents are spread."""
    text = "Is onhe. " * 300
    n = len(text) - suffix_dedup.LENGTH + 1
    batch = pd.DataFrame({"doc_id": [1, 2, 3], "base": [0, 0, 0], "text": [text] * 3, "places": [[n]] * 3, "hashes": [[0]] * 3})
    got = pd.concat(suffix_dedup._fetch(iter([batch])))
    known = got[got["piece"].isna()]
    assert len(got) == 9 + 2 and known["hash"].nunique() == 2
    assert sum(1 + len(o or b"") // 8 for o in got[got["piece"].notna()]["others"]) == n


def test_repeats_are_a_row_for_each_document():
    """However often documents repeat their windows, the sort gives no more rows than it gets, and loses no place."""
    text = "Is onhe. " * 300
    n = len(text) - suffix_dedup.LENGTH + 1
    fetched = []
    for doc in (1, 2, 3):  # each in a task of its own, so that none is settled before the sort
        batch = pd.DataFrame({"doc_id": [doc], "base": [0], "text": [text], "places": [[n]], "hashes": [[0]]})
        fetched += suffix_dedup._fetch(iter([batch]))
    fetched = pd.concat(fetched).sort_values("hash", ignore_index=True)
    got = pd.concat(suffix_dedup._sort(1_000_000)(iter([fetched])))
    assert len(fetched) == 27 and sorted(got["doc_id"]) == [2, 3]
    for places in got["places"]:
        assert places.tolist() == [n]  # one run of n windows from 0 on


def test_runs_of_windows_by_document():
    def by_document(rows, others=None):
        docs, starts, runs = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        got = suffix_dedup._by_document(docs, suffix_dedup._places(starts, runs), others or [None] * len(rows))
        return {d: [(p >> suffix_dedup.RUN_BITS, p & ((1 << suffix_dedup.RUN_BITS) - 1)) for p in x.tolist()] for d, x in zip(got["doc_id"], got["places"], strict=True)}

    # 49 bytes on windows overlap, 50 on they may be those of the next text
    assert by_document([(5, 49, 1), (4, 0, 1), (5, 0, 1), (5, 99, 2), (4, 50, 1)]) == {4: [(0, 1), (50, 1)], 5: [(0, 50), (99, 2)]}
    assert by_document([(5, 0, 100), (5, 10, 1), (5, 120, 1)]) == {5: [(0, 121)]}
    others = suffix_dedup._places(np.array([9, 18]), np.array([1, 1])).tobytes()
    assert by_document([(5, 0, 1), (6, 0, 1)], [None, others]) == {5: [(0, 1)], 6: [(0, 19)]}
    far = np.arange(0, 1 << 25, 40)  # longer than a run can say
    runs = by_document([(7, s, 1) for s in far.tolist()])[7]
    covered = [x for s, r in runs for x in (s, s + r - 1)]
    assert covered[0] == 0 and covered[-1] == far[-1] and all(b - a < 50 for a, b in zip(covered[1::2], covered[2::2], strict=False))
    assert all(0 < r < 1 << suffix_dedup.RUN_BITS for _, r in runs)


@pytest.mark.parametrize("hot", [1_000_000, 2000])
def test_removal_from_periodic_texts(spark, hot):
    rnd = random.Random(12)
    docs = [(i, "".join(rnd.choice("abcd") for _ in range(rnd.randrange(9))) + rnd.choice(["Is onhe. ", "Is onhe. ", "ab", "é-"]) * rnd.randrange(60) + "z" * (i % 70)) for i in range(300)]
    rnd.shuffle(docs)
    assert removal(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), sort_bytes=3000, hot_bytes=hot) == brute_removal(docs)


def test_removal_with_a_null_text_beside_one_to_sort(spark):
    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(90))
    # the same passage between other letters, so that its pieces differ and are sorted
    docs = [(i, "".join(rnd.choice("klmnop ") for _ in range(40)) + passage + "".join(rnd.choice("qrstuv ") for _ in range(40))) for i in range(8)]
    docs += [(i, None) for i in range(8)]
    assert removal(spark.createDataFrame(docs, "doc_id long, text string")) == brute_removal(docs)


def test_removal_of_odd_rows(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert removal(docs) == brute_removal(rows)
    got = suffix_dedup.remove_repeats(docs)
    assert sorted({r.columns["columns"] for r in got.collect()}) == ["mine"]
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_removal_from_documents(spark, prose):
    got = queries.op7_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in prose["documents"].collect()]
    assert sorted((repr(r[0]), *r[1:]) for r in got) == brute_removal(rows)


def test_no_pair_between_groups_is_neither_given_nor_flagged():
    """GrayIndex.nearest() on buckets of grown families: a near pair of two final groups is given, or both its members have others."""
    lost = 0
    for seed in range(12):
        rng = np.random.default_rng(seed)
        rows = [rng.integers(0, 1 << 63, 3, dtype=np.uint64)]
        while len(rows) < 300:  # each a copy of any before it with some bits turned
            new = rows[rng.integers(0, len(rows))].copy()
            for bit in rng.integers(0, 192, rng.integers(1, 14)):
                new[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            rows.append(new)
        sketches = np.stack(rows)
        rank = sketches[:, 0].copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(shift)
        sketches = sketches[np.argsort(rank, kind="stable")]
        buckets = np.sort(rng.integers(0, 2, len(rows)))
        index = simhash.GrayIndex(sketches[:, 0], buckets, 8, sketches, 26)
        a, b, sure, more = index.nearest(6)
        far = np.bitwise_count(sketches[:, None] ^ sketches[None]).sum(axis=2)
        near = (np.bitwise_count(sketches[:, None, 0] ^ sketches[None, :, 0]) <= 8) & (far <= 26) & (buckets[:, None] == buckets[None])
        u, v = np.nonzero(np.triu(near, 1))
        apart = index.label[u] != index.label[v]
        assert (far[u[apart], v[apart]] > 6).all()
        given = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
        flagged = np.zeros(len(rows), bool)
        flagged[a[more == 1]] = True
        assert all((x, y) in given or flagged[x] and flagged[y] for x, y in zip(u[apart].tolist(), v[apart].tolist(), strict=True))
        assert all(near[min(x, y), max(x, y)] for x, y in given)
        lost += int(apart.sum())
    assert lost > 1000
