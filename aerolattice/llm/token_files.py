"""Token ids in files: Simple-8b words in blocks, written and read by Spark.

A file has one row for each block of whole documents, in ascending document order:

- ``shard``: the number of the range of documents, ascending; ``block``: its number within the shard;
- ``before``: the ids of the shard before this block;
- ``doc_ids``, ``doc_lens``: the documents of the block, and the ids that each one has; the first
  ``null_ids`` documents have a null id, which ``doc_ids`` leaves out;
- ``words``: the ids of all of them as little-endian 64-bit words. The top 4 bits of a word are its
  selector, the low 60 bits hold so many ids of so many bits, the first one lowest (SELECTORS);
- ``offsets``: the word at which each segment of SEGMENT ids begins, so that a reader can start anywhere;
- ``escapes``: places of words that hold one raw 64-bit value, for values of over 60 bits. The word
  before has selector 0.

The container is Parquet, so that commits, retries and any store that Spark reaches are Spark's matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices
from .pieces import PieceEncoder

#: Ids and bits of the words with selectors 1 to 14; 0 announces an escape.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
SEGMENT = 16384
#: A block closes when it has so many ids; it holds whole documents.
BLOCK_IDS = 1 << 16
BLOCK_SCHEMA = "shard long, block long, before long, null_ids int, doc_ids array<bigint>, doc_lens array<bigint>, words binary, offsets array<int>, escapes array<int>"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` (unsigned, 64 bits) as Simple-8b words, and the places of escaped words."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bits = np.frexp(values.astype(np.float64))[1].astype(np.uint8)  # one too many near powers of two from 2^53 on
    most = np.append(bits, np.zeros(SELECTORS[0][0], np.uint8))  # of the next `reach` values
    reach, step, kind = 1, np.ones(n, np.uint8), np.full(n, len(SELECTORS), np.int8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, width = SELECTORS[s]
        while reach < count:
            more = min(reach, count - reach)
            most[:-more] = np.maximum(most[:-more], most[more:])
            reach += more
        fits = most[:n] <= width
        step[fits], kind[fits] = count, s + 1
        if not (most[:n] <= SELECTORS[max(s - 1, 0)][1]).any():
            break
    kind[bits > 60] = 0
    step[bits > 60] = 1
    starts, at, jumps = [], 0, step.tobytes()
    while at < n:
        starts.append(at)
        at += jumps[at]
    starts = np.array(starts)
    kinds = kind[starts]
    escaped = kinds == 0
    slots = np.cumsum(1 + escaped) - 1 - escaped
    words = np.zeros(int(slots[-1]) + 1 + int(escaped[-1]), np.uint64)
    padded = np.concatenate([values, np.zeros(SELECTORS[0][0], np.uint64)])
    for s in np.unique(kinds[~escaped]):
        count, width = SELECTORS[s - 1]
        own = kinds == s
        word = np.full(int(own.sum()), np.uint64(int(s) << 60))
        first = starts[own]
        for k in range(count):
            word |= padded[first + k] << np.uint64(k * width)
        words[slots[own]] = word
    words[slots[escaped] + 1] = values[starts[escaped]]
    return words, slots[escaped] + 1


def unpack(words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The first ``n`` values of the Simple-8b ``words``."""
    if n == 0:
        return np.zeros(0, np.uint64)
    raw = np.zeros(len(words), bool)
    raw[escapes] = True
    kinds = np.where(raw, 15, (words >> np.uint64(60)).astype(np.int8))
    counts = np.array([0, *(c for c, _ in SELECTORS), 1])[kinds]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) + SELECTORS[0][0], np.uint64)
    for s in np.unique(kinds):
        own = kinds == s
        if s == 15:
            out[first[own]] = words[own]
        elif s:
            count, width = SELECTORS[s - 1]
            mask, word, at = np.uint64((1 << width) - 1), words[own], first[own]
            for k in range(count):
                out[at + k] = (word >> np.uint64(k * width)) & mask
    return out[:n]


def pack_segments(values: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """Words of all segments, the word at which each begins, and the places of escaped words."""
    parts, offsets, escapes, at = [], [], [], 0
    for k in range(0, len(values), SEGMENT):
        words, escaped = pack(values[k : k + SEGMENT])
        parts.append(words)
        offsets.append(at)
        escapes += (escaped + at).tolist()
        at += len(words)
    return b"".join(p.astype("<u8").tobytes() for p in parts), offsets, escapes


def unpack_segments(words: bytes, n: int, offsets: list[int], escapes: list[int]) -> np.ndarray:
    """What pack_segments() was given: all full segments at one go, then the last one."""
    all_words, raw = np.frombuffer(words, "<u8"), np.asarray(escapes, np.int64)
    out = []
    for k, begin in enumerate(offsets):
        end = offsets[k + 1] if k + 1 < len(offsets) else len(all_words)
        own = raw[(raw >= begin) & (raw < end)] - begin if len(raw) else raw
        out.append(unpack(all_words[begin:end], min(SEGMENT, n - k * SEGMENT), own))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes ``text`` and writes the files described above to ``path``, in ascending ``doc_id``.

    Null and empty texts have the end id alone; a null ``doc_id`` comes first; rows with the same
    ``doc_id`` stand next to each other in the order of their texts, equal rows as often as they occur.
    Other columns are left out. The one shuffle deals out ranges of ``doc_id``; a block is bounded by
    BLOCK_IDS or one document.
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, shard, number = PieceEncoder(tokenizer_path, counts=False), TaskContext.get().partitionId(), 0
        own_ids: list[int | None] = []
        own: list[np.ndarray] = []
        size = before = 0

        def row() -> pd.DataFrame:
            words, offsets, escapes = pack_segments(np.concatenate(own))
            named = [x for x in own_ids if x is not None]
            values = [shard, number, before, len(own_ids) - len(named), named, [len(x) for x in own], words, offsets, escapes]
            return pd.DataFrame([values], columns=["shard", "block", "before", "null_ids", "doc_ids", "doc_lens", "words", "offsets", "escapes"])

        for batch in batches:
            keys = iter(batch["k"].astype("object").tolist())
            for part in slices(batch["t"].tolist()):
                for coded in encoder.encode(part):
                    key, ids = next(keys), np.frombuffer(coded, "<u4")
                    own_ids.append(None if pd.isna(key) else int(key))
                    own.append(np.append(ids, np.uint32(end_id)))
                    size += len(own[-1])
                    if size >= BLOCK_IDS:
                        yield row()
                        own_ids, own, size, number, before = [], [], 0, number + 1, before + size
        if own:
            yield row()

    spark = docs.sparkSession
    (
        docs.select(F.col(doc_id).cast("long").alias("k"), F.coalesce(text, F.lit("")).alias("t"))
        .repartitionByRange(shuffle_partitions(spark), "k")
        .sortWithinPartitions("k", "t")
        .mapInPandas(blocks, BLOCK_SCHEMA)
        .write.parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids.

    ``ids`` are little-endian unsigned 32-bit integers. The one thing that is gathered, and broadcast, is
    the number of ids of each shard: as many rows as the writer had partitions.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    size = F.aggregate("doc_lens", F.lit(0).cast("long"), lambda a, n: a + n)
    by_shard = blocks.groupBy("shard").agg(F.sum(size).alias("size"))
    starts = by_shard.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("before"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                lens = np.asarray(b.doc_lens, np.int64)
                ids = unpack_segments(b.words, int(lens.sum()), list(b.offsets), list(b.escapes)).astype("<u4").tobytes()
                ends = np.cumsum(lens)
                yield pd.DataFrame({
                    "shard": b.shard, "doc_id": pd.array([None] * b.null_ids + list(b.doc_ids), dtype="Int64"), "inside": ends - lens + b.before, "n_tokens": lens,
                    "ids": [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)],
                })

    docs = blocks.mapInPandas(decode, "shard long, doc_id long, inside long, n_tokens long, ids binary")
    return docs.join(F.broadcast(starts), "shard").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids")
