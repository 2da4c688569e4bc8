"""The filter audit against plain counting and its SQL."""

import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolattice.llm import filter_audit, queries
from tests.oracle import connect, difference

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(text):
    words = WORD.findall(text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else ""
    return out + ("D" if set(text) & set("#$%&*|") else "")


def plain(rows, labels):
    """rows: (doc_id, part, text); labels: (doc_id, quality, toxic)."""
    rows = [(i, p or "", t or "") for i, p, t in rows]
    docs = []
    for i, p, t in rows:
        repeat = i is not None and any(j is not None and j < i and t == u for j, _, u in rows)
        good, toxic = (any(i is not None and x[0] == i and x[k] == 1 for x in labels) for k in (1, 2))
        docs.append((p, failures(t) + ("E" if repeat else ""), good, toxic))
    out = {}
    for p in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == p]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                total[f] += len(gone)
                redundant = sum(f in d[1] and bool(set(order[:k]) & set(d[1])) for d in own)
                left = [d for d in left if f not in d[1]]
                out[p, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(d[1] == f for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for key in out:
            if key[0] == p:
                out[key].append(total[key[1][key[2] - 1]])
    return out


def rows_of(df):
    got = df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    assert len({r[:3] for r in got}) == len(got)
    return {tuple(r[:3]): list(r[3:]) for r in got}


def test_odd_rows(spark, docs, none):
    labels = [(1, 1, 0), (5, 0, 1), (5, 1, 0), (None, 1, 1), (9, 1, 1), (77, 1, 1)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    assert rows_of(filter_audit.audit_documents(docs, said)) == plain(rows, labels)
    assert filter_audit.audit_documents(none, said).count() == 0
    assert rows_of(filter_audit.audit_documents(docs, said.where("false"))) == plain(rows, [])


def test_repeats_across_batches_and_parts(spark):
    """One text in most rows of many partitions, under numbers in falling order, some of them shared, and null ones."""
    rows = [(None if k % 17 == 0 else 400 - k // 2, f"s{k % 3}", "one text * " * (1 if k % 5 else 250) if k % 4 else f"text {k % 6}") for k in range(800)]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 400, 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(16)
    assert rows_of(filter_audit.audit_documents(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == plain(rows, labels)
    # copies that a batch knows to be later ones don't go to the task of their text
    spread = filter_audit.flagged(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert spread.count() == len(rows)


def test_bitsets_of_many_parts():
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 1 << 4, 1000)
    starts = np.unique(np.append(0, rng.integers(1, 1000, 60)))
    got = filter_audit.subset_counts(bits, starts, 3, 1)
    for p, own in enumerate(np.split(bits, starts[1:])):
        for s in range(8):
            for f in range(3):
                gone = own[(own & s == 0) & (own >> f & 1 == 1)]
                wanted = [0, 0, 0] if s >> f & 1 else [len(gone), np.sum(own & (s | 1 << f) == 0), np.sum(gone >> 3 & 1)]
                assert got[p, s, f].tolist() == wanted


def test_other_filters_and_labels(spark):
    df = spark.createDataFrame([("x", 1, True), ("x", 5, None), ("y", 9, False)], "part string, n int, flag boolean")
    got = filter_audit.audit(df, {"small": F.col("n") < 6, "flag": F.col("flag")}, F.col("part"), {"odd": F.col("n") % 2 == 1}).collect()
    assert {(r.part, r.filter_order, r.step, r.kept, r.removed, r.odd_lost) for r in got if r.filter_order == "flagsmall"} == {("x", "flagsmall", 1, 1, 1, 1), ("x", "flagsmall", 2, 0, 1, 1), ("y", "flagsmall", 1, 1, 0, 0), ("y", "flagsmall", 2, 1, 0, 0)}
    with pytest.raises(ValueError):
        filter_audit.audit(df, {str(k): F.lit(True) for k in range(7)}, F.col("part"), {})


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(spark, connect(sf), sf, queries.op13_filter_audit, queries.oracle_sql()["op13_filter_audit"]) == ""
