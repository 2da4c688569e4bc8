"""How filters of documents overlap, in every order of applying them.

A packed bitmap index answers it: each task turns its rows into bitsets, one for each filter and label, in which
the rows of a part stand together from a whole byte on. For each subset of filters that may have gone
before, the rows that the next filter removes are its bitset AND NOT the union of the subset's, counted by popcount
and summed up by part. The tables of all tasks are added; orders, which are many more than subsets, are only
looked up in the sum.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are packed at once.
INDEX_ROWS = 1 << 20
#: Filters at most: their orders are all listed.
MAX_FILTERS = 6

#: The text filters: words at least, least share of distinct words and largest share of capitals in hundredths, and marks.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
MARKS = r"[#$%&*|]"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def subset_counts(bits: np.ndarray, starts: np.ndarray, n_filters: int, n_labels: int) -> np.ndarray:
    """Counts by part, subset of filters and next filter: removed, kept, then removed with each label.

    ``bits`` has a row's failures in its lowest bits and its labels in the next; the rows of part p
    begin at ``starts[p]``. The result has the shape (parts, subsets, filters, 2 + labels); a filter of the subset
    itself counts zero.
    """
    sizes = np.diff(np.append(starts, len(bits)))
    n_bytes = (sizes + 7) // 8
    first = np.cumsum(n_bytes) - n_bytes
    place = np.arange(len(bits)) - np.repeat(starts, sizes) + np.repeat(8 * first, sizes)
    spread = np.zeros(8 * int(n_bytes.sum()), bits.dtype)
    spread[place] = bits | (1 << (n_filters + n_labels))
    sets = [np.packbits(spread >> k & 1 == 1) for k in range(n_filters + n_labels + 1)]
    fails, labelled, there = sets[:n_filters], sets[n_filters:-1], sets[-1]
    union = [np.zeros_like(there)]
    for s in range(1, 1 << n_filters):
        low = (s & -s).bit_length() - 1
        union.append(union[s & (s - 1)] | fails[low])

    def counted(found: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(found), first, dtype=np.int64)

    out = np.zeros((len(starts), 1 << n_filters, n_filters, 2 + n_labels), np.int64)
    for s, before in enumerate(union):
        for f in range(n_filters):
            if not s >> f & 1:
                gone = fails[f] & ~before
                out[:, s, f, 0] = counted(gone)
                out[:, s, f, 1] = counted(there & ~union[s | 1 << f])
                for j, label in enumerate(labelled):
                    out[:, s, f, 2 + j] = counted(gone & label)
    return out


def _index(n_filters: int, labels: list[str]):
    steps = [(s, f) for s in range(1 << n_filters) for f in range(n_filters) if not s >> f & 1]
    subsets, filters = map(list, zip(*steps, strict=True))

    def packed(parts: list[pa.Array], bits: list[np.ndarray]) -> pa.RecordBatch:
        coded = pa.chunked_array(parts).combine_chunks().dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        counts = subset_counts(np.concatenate(bits)[order], starts, n_filters, len(labels))[:, subsets, filters]
        columns = {"part": names.take(pa.array(np.repeat(np.arange(len(starts)), len(steps))))}
        columns |= {"subset": pa.array(np.tile(subsets, len(starts)).astype(np.int32)), "filter": pa.array(np.tile(filters, len(starts)).astype(np.int32))}
        return pa.RecordBatch.from_pydict(columns | {name: pa.array(counts[:, :, k].ravel()) for k, name in enumerate(["removed", "kept", *labels])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bits, rows = [], [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch.column(0))
                bits.append(batch.column(1).to_numpy(zero_copy_only=False))
                rows += batch.num_rows
            if rows >= INDEX_ROWS:
                yield packed(parts, bits)
                parts, bits, rows = [], [], 0
        if rows:
            yield packed(parts, bits)

    return run


def audit(df: DataFrame, filters: dict[str, Column], part: Column, labels: dict[str, Column]) -> DataFrame:
    """What each filter removes, in every order: a row for each part, order and step.

    ``filters`` gives, under a name, whether a row fails it; null is as false. So for ``labels``. A null part is
    the empty text. Repeated rows count each. Columns: part, filter_order (the names in order, joined), step (from 1),
    kept (after the step), removed (at it), redundant (failing the step's filter, removed before), unique_fails
    (failing this filter alone), <label>_lost (removed here, with the label) and shapley (what the step's
    filter removes, summed over all orders). An empty table gives no rows. The rows of one part may lie in any
    number of partitions: only their counts are shuffled.
    """
    names, n = list(filters), len(filters)
    if not 0 < n <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters are audited")
    flags = [*filters.values(), *labels.values()]
    packed = sum((F.coalesce(c.cast("int"), F.lit(0)) * (1 << k) for k, c in enumerate(flags)), F.lit(0)).cast("int").alias("bits")
    lost = [f"{name}_lost" for name in labels]
    measures = ["removed", "kept", *lost]
    schema = "part string, subset int, filter int, " + ", ".join(f"`{m}` long" for m in measures)
    counts = df.select(F.coalesce(part, F.lit("")).alias("part"), packed).mapInArrow(_index(n, lost), schema)
    summed = counts.groupBy("part", "subset", "filter").agg(*(F.sum(m).alias(m) for m in measures))

    own = Window.partitionBy("part", "filter")
    others = F.expr(f"{(1 << n) - 1} - shiftleft(1, filter)")
    weights = F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)))
    told = summed.select(
        "part", "subset", "filter", *measures,
        F.max(F.when(F.col("subset") == 0, F.col("removed"))).over(own).alias("fails"),
        F.max(F.when(F.col("subset") == others, F.col("removed"))).over(own).alias("unique_fails"),
        F.sum(F.element_at(weights, F.bit_count("subset") + 1) * F.col("removed")).over(own).alias("shapley"),
    )
    orders = [("".join(names[f] for f in order), k + 1, sum(1 << f for f in order[:k]), order[k]) for order in permutations(range(n)) for k in range(n)]
    steps = df.sparkSession.createDataFrame(orders, "filter_order string, step int, subset int, filter int")
    return told.join(F.broadcast(steps), ["subset", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley"
    )


def text_failures(text: bytes) -> int:
    """Bits of the text filters that ``text`` (UTF-8) fails: few words, few distinct words, many capitals, marks."""
    words = text.split()  # of bytes: at ASCII white space alone
    capitals = len(text) - len(text.translate(None, CAPITALS))
    chars = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    few, dull = len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * len(words)
    return few | dull << 1 | (100 * capitals > MAX_CAPITALS * chars) << 2 | bool(_MARKS.search(text)) << 3


_MARKS = re.compile(MARKS.encode())


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its failures and hash; of equal texts of a batch only those of the least number may be first."""
    base = 0
    for batch in batches:
        ids, part, texts = batch.columns
        texts = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
        numbers = ids.to_pylist()
        least: dict[bytes, int] = {}
        for d, k in zip(digests, numbers, strict=True):
            if k is not None and k < least.get(d, k + 1):
                least[d] = k
        later = [k is not None and k > least[d] for d, k in zip(digests, numbers, strict=True)]
        apart = [base + i if gone or k is None else 0 for i, (gone, k) in enumerate(zip(later, numbers, strict=True), 1)]
        base += len(texts)
        columns = [ids, part, pa.array(map(text_failures, texts), pa.int32()), pa.array(digests, pa.binary()), pa.array(later, pa.bool_()), pa.array(apart, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "failures", "digest", "later", "apart"])


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document, without its text: doc_id, part, the failures A to E, good and toxic.

    A: under MIN_WORDS words; B: under MIN_DISTINCT in a hundred words are distinct; C: over MAX_CAPITALS in a hundred
    characters are A-Z; D: a mark; E: the text is that of a document of smaller doc_id. A null text is
    empty, a null source the part ''. A document without doc_id is no repeat, makes none and has no label; those of
    one doc_id aren't each other's. Of labels with one doc_id any counts.

    Texts leave the scan as hashes of 128 bits. What a batch of rows shows to be a repeat isn't sent to the task of
    its text, so that a text of a third of all documents sends it a row for each batch at most.
    """
    schema = "doc_id long, part string, failures int, digest binary, later boolean, apart long"
    judged = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), "text").mapInArrow(_judged, schema)
    alike = Window.partitionBy("digest", "apart")
    repeated = F.col("later") | F.coalesce(F.col("doc_id") > F.min("doc_id").over(alike), F.lit(False))
    firsts = judged.withColumn("repeated", repeated)
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # documents without a number meet no label, so these need not meet in one task either
    keyed = firsts.withColumn("lone", F.when(F.col("doc_id").isNull(), F.col("apart")).otherwise(0))
    both = keyed.join(said.select(F.col("doc_id").cast("long"), (F.col("doc_id").cast("long") * 0).alias("lone"), "good", "toxic"), ["doc_id", "lone"], "left")
    bits = [F.col("failures").bitwiseAND(1 << k) != 0 for k in range(4)]
    return both.select("doc_id", "part", *(b.alias(name) for b, name in zip([*bits, F.col("repeated")], "ABCDE", strict=True)), (F.col("good") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the filters A to E of flagged(), by source, with the labels good and toxic."""
    return audit(flagged(docs, labels), {k: F.col(k) for k in "ABCDE"}, F.col("part"), {k: F.col(k) for k in ("good", "toxic")})
