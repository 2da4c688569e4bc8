"""How the tokens of two tokenizers lie over each other in a text: each distinct segment is aligned once.

Tokenizer A is a byte-level BPE file, tokenizer B a sentencepiece BPE model. A text with a blank before it is split
before each run of white space that begins with a blank, tab or line end. Neither tokenizer can have a token over such a
place: A's pre-tokenizer begins a new word there, and B's merges only ever make pieces of its vocabulary,
none of which has a blank after another character, nor a tab or line end at all. That is looked up when the
model is loaded; characters for which it doesn't hold split no text. So the tokens of a text are those of its
segments, in order.

Documents are taken in chunks. A chunk keeps its distinct segments once and its documents as numbers of these, and asks
for each of its segments once, so no segment has more requests than there are chunks. A shuffle brings the requests
for a segment together; it is tokenised and aligned once, and the answer goes back to the chunks that asked,
which compose their documents. Counts of id pairs over the corpus come from the segments and how often they occur.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from operator import ne
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from .common import shuffle_partitions, written
from .pieces import byte_symbols

#: White space that may begin a segment, besides the blank.
BREAKS = "\t\n\v\f\r"
#: A chunk ends with the document that takes it over so many characters or distinct segments.
CHUNK_CHARS, CHUNK_SEGMENTS = 10 << 20, 250_000
#: Segments that are tokenised at once.
SEGMENT_BATCH = 4096
#: Requests that are answered at once, and pairs of ids that are broadcast at most: 17 bytes each.
ANSWER_ROWS, MAX_PAIRS = 1 << 18, 1 << 22
BLANK = "▁"
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Aligned(NamedTuple):
    """Of each segment its tokens, groups and links, and the groups as text; the ids of all links in order."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: pa.Array
    link_a: np.ndarray
    link_b: np.ndarray


class Pair:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter = spec.get("pre_tokenizer") or {}
        if splitter.get("type") != "ByteLevel" or spec.get("normalizer") or spec["model"]["type"] != "BPE":
            raise ValueError(f"{a_path} is no byte-level BPE")
        self.a_path = a_path
        to_byte = {c: k for k, c in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        if set(to_byte) - set(vocab):
            raise ValueError(f"{a_path} lacks bytes")
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(map(to_byte.__getitem__, t)) if set(t) <= set(to_byte) else t.encode()
        self.b = SentencePieceProcessor(model_file=b_path)
        n = self.b.vocab_size()
        if self.b.encode("x", out_type=str)[0][0] != BLANK or {self.b.piece_to_id(f"<0x{k:02X}>") for k in range(256)} & {self.b.unk_id()}:
            raise ValueError(f"{b_path} adds no blank or lacks bytes")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.blank = self.b.piece_to_id(BLANK)
        pieces = [self.b.id_to_piece(i) for i in range(n) if not self.b.is_byte(i)]
        breaks = "".join(c for c in BREAKS if not any(c in p for p in pieces))
        #: white space, then text up to white space that splits; or white space at the end
        self.segment = re.compile(rf"\s*\S+(?:[^\S {breaks}]\s*\S*)*|\s+")
        self.splits = splitter.get("use_regex", True) and not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces)
        self.a_lens, self.b_lens = (np.array([len(x) for x in of]) for of in (self.a_bytes, self.b_bytes))

    @cached_property
    def a(self) -> Tokenizer:
        """Tokenizer A, which what only splits texts doesn't load."""
        found = Tokenizer.from_file(self.a_path)
        found.no_truncation()
        found.no_padding()
        found.encode_special_tokens = True
        return found

    def keeps(self, text: str) -> bool:
        """Whether the bytes of B's tokens are those of a blank and ``text``; A's always are."""
        return self.b.normalize(text).replace(BLANK, " ") == " " + text

    def segments(self, text: str) -> list[str]:
        """A blank and ``text`` in parts that both tokenizers treat alone."""
        return self.segment.findall(" " + text) if self.splits else [" " + text]

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for each segment. B adds a blank before all it is given: the one that a segment begins with, or else it goes."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return a, [(y or [self.blank]) if s[0] == " " else y[1:] for s, y in zip(segments, b, strict=True)]

    def aligned(self, segments: list[str]) -> Aligned:
        """Groups and links of each segment. A link is what lies between two neighbouring ends of tokens of either kind."""
        a, b = self.tokens(segments)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a, b))
        raw = "".join(segments).encode()
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw:
            raise ValueError("tokens give another text than their segments")
        ends_a, ends_b = np.cumsum(self.a_lens[a]), np.cumsum(self.b_lens[b])
        ends = ends_a[np.cumsum(n_a) - 1]  # of segments
        both = np.union1d(ends_a, ends_b)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        links = np.diff(np.searchsorted(both, ends, "right"), prepend=0)
        groups = np.diff(np.searchsorted(cuts, ends, "right"), prepend=0)
        # ids of a group: those of A, then those of B; what follows an id says how it goes on
        ids, stops = np.append(a, b), np.append(ends_a, ends_b)
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(2 * np.searchsorted(cuts, stops) + side, kind="stable")
        follows = np.where(np.isin(stops, cuts, assume_unique=False), np.where(np.isin(stops, ends) & (side == 1), 3, 1 + side), 0)[order]
        spelled = pc.binary_join_element_wise(pa.array(ids[order]).cast(pa.string()), pa.array([",", "|", ";", ""]).take(pa.array(follows)), "")
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_a + n_b)), pa.int32()), spelled), "")
        return Aligned(n_a, n_b, groups, links, text, a[np.searchsorted(ends_a, both)], b[np.searchsorted(ends_b, both)])


_loaded: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Pair(a_path, b_path)
    return _loaded[a_path, b_path]


class _Numbers(dict):
    """Numbers of segments, by order of their first place."""

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        return n


def _packed(places: np.ndarray) -> bytes:
    """Numbers below 2 ** 24, the low bytes first, so that the high ones, mostly zero, compress."""
    return pa.compress(places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


CHUNK = ["chunk", "first", "docs", "lens", "order", "segments", "counts"]


def _chunks(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, base = pair_of(a_path, b_path), TaskContext.get().partitionId() << 32
        numbers, rows, own, chars, made = _Numbers(), [], [], 0, 0

        def chunk() -> Iterator[pa.RecordBatch]:
            """The documents in one row, then the segments in rows of SEGMENT_BATCH."""
            lens, order = np.array([len(x) for x in own], "<u4"), np.concatenate(own)
            counts, listed = np.bincount(order, minlength=len(numbers)), list(numbers)
            docs = pa.concat_arrays([pa.array([], pa.list_(kind)), pa.ListArray.from_arrays([0, len(lens)], pa.concat_arrays(rows))])
            of, none = pa.array([base + made]), [pa.nulls(1, pa.list_(pa.string())), pa.nulls(1, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([of, pa.nulls(1, pa.int32()), docs, pa.array([lens.tobytes()]), pa.array([_packed(order)]), *none], CHUNK)
            for at in range(0, len(listed), SEGMENT_BATCH):
                part = [pa.array([x[at : at + SEGMENT_BATCH]], pa.list_(k)) for x, k in ((listed, pa.string()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([of, pa.array([at], pa.int32()), pa.nulls(1, docs.type), *[pa.nulls(1, pa.binary())] * 2, *part], CHUNK)

        for batch in batches:
            kind, at = batch.column(0).type, 0
            for k, text in enumerate(batch.column(1).to_pylist(), 1):
                found = pair.segments(text) if text and pair.keeps(text) else []
                own.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                chars += len(text or "")
                if chars >= CHUNK_CHARS or len(numbers) >= CHUNK_SEGMENTS or k == batch.num_rows:
                    rows.append(batch.column(0).slice(at, k - at))
                    at = k
                if chars >= CHUNK_CHARS or len(numbers) >= CHUNK_SEGMENTS:
                    yield from chunk()
                    numbers, rows, own, chars, made = _Numbers(), [], [], 0, made + 1
        if own:
            yield from chunk()

    return run


def _align(a_path: str, b_path: str):
    """Requests (segment, chunk, place, n), in order of the segment, to a row for each segment of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = pair_of(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            segments = batch.column(0).to_pylist()
            firsts = np.flatnonzero([True, *map(ne, segments[1:], segments)]) if segments else np.zeros(0, np.int64)
            for at in range(0, len(firsts), SEGMENT_BATCH):
                own = firsts[at : at + SEGMENT_BATCH]
                end = int(firsts[at + SEGMENT_BATCH]) if at + SEGMENT_BATCH < len(firsts) else len(segments)
                done = pair.aligned([segments[k] for k in own.tolist()])
                asks = pa.array(np.append(own, end) - own[0], pa.int32())
                links = pa.array(np.append(0, np.cumsum(done.n_links)), pa.int32())
                part = batch.slice(int(own[0]), end - int(own[0]))
                counts = np.add.reduceat(part.column(3).to_numpy(), own - own[0])
                lists = [pa.ListArray.from_arrays(asks, pa.concat_arrays([part.column(k)])) for k in (1, 2)] + [pa.ListArray.from_arrays(links, pa.array(ids, pa.int32())) for ids in (done.link_a, done.link_b)]
                numbers = pa.array(np.arange(number, number + len(own)))
                yield pa.RecordBatch.from_arrays([numbers, pa.array(counts), pa.array(done.n_a, pa.int32()), done.groups, *lists], ["number", "n", "n_a", "groups", "chunks", "places", "a", "b"])
                number += len(own)

    return run


ALIGNED = "number long, n long, n_a int, groups string, chunks array<long>, places array<int>, a array<int>, b array<int>"
ANSWERS = "chunk long, places array<int>, n_a array<int>, n_best array<int>, count_sum array<long>, groups string"


class PairTable:
    """Counts of id pairs, by binary search."""

    def __init__(self, a: np.ndarray, b: np.ndarray, count: np.ndarray, best: np.ndarray):
        order = np.argsort(key := a.astype(np.int64) << 32 | b)
        self.keys, self.counts, self.best = key[order], count[order], best[order]

    def sums(self, a: pa.ListArray, b: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """For each list of links how many are best, and the sum of their counts."""
        at = np.searchsorted(self.keys, a.flatten().to_numpy().astype(np.int64) << 32 | b.flatten().to_numpy())
        starts = np.append(0, np.cumsum(pc.list_value_length(a).to_numpy()))[:-1]
        return np.add.reduceat(self.best[at].astype(np.int64), starts), np.add.reduceat(self.counts[at], starts)


def _looked_up(table: Broadcast[PairTable]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_best, count_sum = table.value.sums(batch.column("a"), batch.column("b"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in TOLD), pa.array(n_best, pa.int32()), pa.array(count_sum)], [*TOLD, "n_best", "count_sum"])

    return run


TOLD = ("n_a", "groups", "chunks", "places")


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of ANSWER_ROWS requests, with the answers to all of them."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        chunks, places = (table.column(c).combine_chunks() for c in ("chunks", "places"))
        of = np.repeat(np.arange(table.num_rows), pc.list_value_length(chunks).to_numpy())
        chunks, places = chunks.flatten().to_numpy(), places.flatten().to_numpy()
        order = np.argsort(chunks, kind="stable")
        starts = np.flatnonzero(np.diff(chunks[order], prepend=-1))
        ends = pa.array(np.append(starts, len(order)), pa.int32())
        take = pa.array(of[order])
        lists = [pa.array(places[order]), *(table.column(c).combine_chunks().take(take) for c in ("n_a", "n_best", "count_sum"))]
        groups = pc.binary_join(pa.ListArray.from_arrays(ends, table.column("groups").combine_chunks().take(take)), "\n")
        return pa.RecordBatch.from_arrays([pa.array(chunks[order][starts]), *(pa.ListArray.from_arrays(ends, x) for x in lists), groups], ["chunk", "places", "n_a", "n_best", "count_sum", "groups"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += len(batch.column("chunks").flatten())
        if rows >= ANSWER_ROWS:
            yield packed(held)
            held, rows = [], 0
    if rows:
        yield packed(held)


def _compose(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one chunk, from the answers to its segments."""
    lens = np.frombuffer(chunk.column("lens")[0].as_py(), "<u4").astype(np.int64)
    order = _unpacked(chunk.column("order")[0].as_py(), int(lens.sum()))
    starts, has = np.cumsum(lens) - lens, lens > 0
    flat = {c: answers.column(c).combine_chunks().flatten().to_numpy() for c in ("places", "n_a", "n_best", "count_sum")}
    by_place = np.argsort(flat["places"])
    n_a, n_best, count_sum = (flat[c][by_place].astype(np.int64) for c in ("n_a", "n_best", "count_sum"))
    spelled = pa.array("\n".join(answers.column("groups").to_pylist()).split("\n") if len(by_place) else [], pa.string()).take(pa.array(by_place))
    n_groups = pc.count_substring(spelled, ";").to_numpy() + 1
    n_b = pc.count_substring(spelled, ",").to_numpy() + 2 * n_groups - n_a
    columns = {"columns": chunk.column("docs").combine_chunks().flatten()}
    for name, of in zip(SUMS, (n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, count_sum), strict=True):
        sums = np.zeros(len(lens), np.int64)
        if has.any():
            sums[has] = np.add.reduceat(of[order], starts[has])
        columns[name] = pa.array(sums)
    texts = spelled.to_pylist()
    hashes = [hashlib.sha256(";".join(map(texts.__getitem__, order[b : b + k].tolist())).encode()).hexdigest() if k else "" for b, k in zip(starts.tolist(), lens.tolist(), strict=True)]
    return pa.table(columns | {"groups_sha256": pa.array(hashes, pa.string())})


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (links of the corpus that hold both) and best (no other id of A has more with this b)."""
    counts = aligned.select("n", F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """The columns of ``df`` but its ``text`` as a struct ``columns``, and what aligns in each text.

    n_a, n_b: tokens of a blank and the text; n_groups: the parts between places where tokens of both end; n_links: pairs of an
    A and a B token over common bytes; n_best: links whose pair of ids no other id of A exceeds over the corpus for
    this id of B; count_sum: the sum of the links' corpus counts; groups_sha256: the hash of the groups'
    ids. A null or empty text, and one whose bytes the tokens don't give back, has no tokens: zeros and ''.
    Rows keep their number; repeated rows and rows of one number count each. Texts and segments of any length are whole.

    A chunk holds some ten million characters at most, but for a longer text, and is composed in one task. Counts of
    pairs are looked up in a broadcast table while there are ``max_pairs`` at most, and joined beyond.
    """
    rest = [c for c in df.columns if c != text] or [text]
    carried = df.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("columns"), F.col(f"`{text}`").alias("text"))
    own = carried.schema["columns"].dataType
    kinds = ("long", "int", T.ArrayType(own), "binary", "binary", "array<string>", "array<long>")
    schema = T.StructType([T.StructField(name, T.DataType.fromDDL(kind) if isinstance(kind, str) else kind) for name, kind in zip(CHUNK, kinds, strict=True)])
    chunks = written(carried.mapInArrow(_chunks(a_path, b_path), schema), "chunks")
    asked = chunks.where("first is not null").select("chunk", "first", "counts", F.posexplode("segments").alias("k", "segment"))
    asked = asked.select("segment", "chunk", (F.col("first") + F.col("k")).alias("place"), F.col("counts")[F.col("k")].alias("n"))
    asked = asked.repartition(shuffle_partitions(df.sparkSession), "segment").sortWithinPartitions("segment")
    aligned = written(asked.mapInArrow(_align(a_path, b_path), ALIGNED), "segments")
    pairs = written(pair_counts(aligned), "pairs")
    if pairs.count() <= max_pairs:
        held = pairs.toArrow()
        table = df.sparkSession.sparkContext.broadcast(PairTable(*(held.column(c).to_numpy() for c in ("a", "b", "count", "best"))))
        look = _looked_up(table)
        answers = aligned.mapInArrow(lambda batches: _answers(look(batches)), ANSWERS)  # one worker a task does both
    else:
        links = aligned.select("number", F.inline(F.arrays_zip("a", "b"))).join(pairs, ["a", "b"])
        sums = links.groupBy("number").agg(F.count_if("best").cast("int").alias("n_best"), F.sum("count").alias("count_sum"))
        answers = aligned.select("number", *TOLD).join(sums, "number").drop("number").mapInArrow(_answers, ANSWERS)
    done = T.StructType().add("columns", own)
    for name in SUMS:
        done = done.add(name, "long")
    return chunks.where("first is null").select(F.col("chunk").alias("own"), "docs", "lens", "order").groupBy("own").cogroup(answers.groupBy("chunk")).applyInArrow(_compose, done.add("groups_sha256", "string"))
