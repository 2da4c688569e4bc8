"""Removal of bytes that repeat a passage of an earlier document, by suffix sorting in parallel parts.

The suffixes that can share a prefix of LENGTH bytes are brought together first, so that each part can be
sorted by itself, whatever the size of the corpus:

1. Every window of LENGTH bytes belongs to the least hash of the GRAM-byte strings in it. Consecutive
   windows with the same least hash make a piece. Equal windows have equal hashes, in any document, so a
   piece can only match pieces of the same hash. Pieces are dealt out by that hash, as numbers alone.
2. Of pieces that are equal throughout (same hash, same 48-bit name of their bytes), all but those of the
   smallest document are repeats in full. Pieces whose hash is met once are no repeats.
3. For what remains, hashes that are shared by different pieces, the bytes of one piece of each kind are
   fetched and their suffixes sorted by the difference-cover algorithm (difference_cover.py): sampled
   triples, names, the rest merged in; neighbours are compared over LENGTH bytes.

A hash whose pieces hold too many bytes to be sorted at once is split: its windows are dealt out one by one,
by their own bytes, after each task has kept only the smallest document of equal ones, with all its places in one row.
Pieces and windows that a task has already settled are spread by document, so a passage that all documents hold
fills neither a bucket nor a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import shuffle_partitions
from .difference_cover import equal_prefix_blocks

LENGTH = 50
GRAM = 24
#: Bytes hashed at once; longer documents are taken in overlapping steps.
STEP = 1 << 19
#: Pieces a task gathers before it deals them out, at least, and for each bucket.
HELD_PIECES, HELD_FOR_BUCKET = 400_000, 64
#: Windows of split hashes, and further places of these, that a task holds before it deals them out.
HELD_WINDOWS = 100_000
#: Bytes sorted at once, and bytes of the pieces of one hash beyond which its windows are dealt out one by one.
SORT_BYTES, HOT_BYTES = 1_000_000, 1_000_000
#: Buckets of pieces where there are fewer shuffle partitions; else one for each.
BUCKETS = 400
#: Rows that a task hands on at once, and bytes of texts.
ROWS_OUT, BYTES_OUT = 20_000, 2_000_000

_MIX, _BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_U, _LONG = np.uint64, (1 << 63) - 1
RUN_BITS = 24
#: Of a piece's name so many bytes are dealt out; of its hash, the upper four and the bucket.
NAME_BYTES = 6


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(32)
    h *= _U(_MIX)
    h ^= h >> _U(29)
    return h


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM-byte string of ``text``: polynomials of 1, 2, 4, 8 bytes, then thrice 8."""
    h, power, size = _mixed(text.astype(_U) + _U(1)), _BASE, 1
    while size < GRAM // 3:
        h = h[:-size] * _U(power) + h[size:]
        power, size = power * power % (1 << 64), size * 2
    h = (h[: -2 * size] * _U(power) + h[size:-size]) * _U(power) + h[2 * size :]
    return _mixed(h)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        h, size = np.minimum(h[:-size], h[size:]), size * 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Pieces:
    """Cuts texts into pieces of windows with the same least hash."""

    def __init__(self) -> None:
        n = STEP + LENGTH
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def cut(self, text: np.ndarray, document: np.ndarray, windows: int) -> tuple[np.ndarray, ...]:
        """Hash, name, first window and number of windows of each piece among the first ``windows`` windows.

        ``document`` numbers the document of each byte; windows over two of them are left out.
        """
        grams = gram_hashes(text)
        least = window_minima(grams, LENGTH - GRAM + 1)[:windows]
        n = len(least)
        inside = document[:n] == document[LENGTH - 1 : LENGTH - 1 + n]
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | (document[1:n] != document[: n - 1]) | (inside[1:] != inside[:-1])
        starts = np.flatnonzero(new)
        runs = np.diff(np.append(starts, n))
        own = inside[starts]
        starts, runs = starts[own], runs[own]
        sums = np.zeros(len(grams) + 1, _U)
        np.cumsum(grams * self.up[: len(grams)], out=sums[1:])
        names = (sums[starts + runs + LENGTH - GRAM] - sums[starts]) * self.down[starts]
        return least[starts], _mixed(names + runs.astype(_U)), starts, runs


def _planes(a: np.ndarray) -> bytes:
    """The bytes of ``a`` by significance: like bytes stand together and compress."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplanes(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


DEALT = "bucket int, whole boolean, hashes binary, names binary, docs binary, counts binary, starts binary, runs binary"
FOUND = "doc_id long, place long, hash long"
#: ``others``: further places of a window in its document, 8 bytes each.
FETCHED = "hash long, doc_id long, place long, others binary, piece binary"
FETCHED_NAMES = ["hash", "doc_id", "place", "others", "piece"]
REPEATS = "doc_id long, places array<bigint>"


def _deal(buckets: int):
    """From documents to pieces by bucket; pieces that repeat one of the same task are marked as whole."""

    def rows(held: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
        h, name, doc, start, run = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, name, h))
        first = np.ones(len(h), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (name[order][1:] != name[order][:-1])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        whole = np.zeros(len(h), bool)
        whole[order] = doc[order] > doc[order][lead]
        bucket = (np.where(whole, start.astype(_U) + doc.astype(_U), h) % _U(buckets)).astype(np.int64)  # settled ones go anywhere
        order = np.lexsort((start, doc, whole, bucket))
        group = bucket[order] * 2 + whole[order]
        cuts = np.flatnonzero(np.diff(group)) + 1
        out = []
        for at in np.split(order, cuts):
            d, s = doc[at], start[at]
            new = np.ones(len(at), bool)
            new[1:] = d[1:] != d[:-1]
            ids = d[new]
            steps = np.where(new, s, s - np.append(0, s[:-1]))
            counts = np.diff(np.append(np.flatnonzero(new), len(at)))
            empty = bool(whole[at[0]])
            out.append((
                int(bucket[at[0]]), empty, b"" if empty else _planes((h[at] >> _U(32)).astype("<u4")), b"" if empty else _planes(name[at])[: NAME_BYTES * len(at)],
                _planes(np.diff(ids, prepend=0)), _planes(counts.astype(np.uint32)), _planes(steps), _planes(run[at].astype(np.uint32)),
            ))
        yield pd.DataFrame(out, columns=["bucket", "whole", "hashes", "names", "docs", "counts", "starts", "runs"])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        part: list[tuple[int, int, bytes]] = []
        part_bytes = 0

        def cut() -> None:
            nonlocal held, size, part, part_bytes
            text = np.frombuffer(b"".join(t for _, _, t in part), np.uint8)
            lens = np.array([len(t) for _, _, t in part])
            ids, bases = np.array([d for d, _, _ in part], np.int64), np.array([b for _, b, _ in part], np.int64)
            begin = np.cumsum(lens) - lens
            number = np.repeat(np.arange(len(part)), lens)
            for at in range(0, len(text) - LENGTH + 1, STEP):
                h, name, starts, runs = pieces.cut(text[at : at + STEP + LENGTH - 1], number[at : at + STEP + LENGTH - 1], STEP)
                starts = starts + at
                own = number[starts]
                held.append((h, name, ids[own], starts - begin[own] + bases[own], runs))
                size += len(h)
            part, part_bytes = [], 0

        for batch in batches:
            for d, base, text in zip(batch["doc_id"], batch["base"], batch["text"], strict=True):
                if pd.isna(d) or not text:
                    continue
                raw = text.encode()
                if len(raw) < LENGTH:
                    continue
                if part and part_bytes + len(raw) > STEP:
                    cut()
                    if size > max(HELD_PIECES, HELD_FOR_BUCKET * buckets):
                        yield from rows(held)
                        held, size = [], 0
                part.append((int(d), int(base), raw))
                part_bytes += len(raw)
        if part:
            cut()
        if size:
            yield from rows(held)

    return deal


def _places(start: np.ndarray, run: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << RUN_BITS) | run.astype(np.int64)


def _match(hot_bytes: int):
    """Of the pieces of each bucket: repeats in full (hash -1), and those to be sorted with others of their hash.

    Rows come sorted by bucket; one bucket is held at a time, as packed bytes until its last row is there.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for b in batch.itertuples(index=False):
                if b.whole:
                    doc, start, run = _unpacked(b)
                    yield pd.DataFrame({"doc_id": doc, "place": _places(start, run), "hash": -1})
                    continue
                if held and held[0].bucket != b.bucket:
                    yield from _matched(held, hot_bytes)
                    held = []
                held.append(b)
        if held:
            yield from _matched(held, hot_bytes)

    return match


def _unpacked(b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first window and number of windows of each piece of a row."""
    ids, counts = np.cumsum(_unplanes(b.docs, "<i8")), _unplanes(b.counts, "<u4").astype(np.int64)
    total = np.cumsum(steps := _unplanes(b.starts, "<i8"))
    first = np.cumsum(counts) - counts
    return np.repeat(ids, counts), total - np.repeat(total[first] - steps[first], counts), _unplanes(b.runs, "<u4").astype(np.int64)


def _matched(held: list[tuple], hot_bytes: int) -> Iterator[pd.DataFrame]:
    dealt = []
    for b in held:
        doc, start, run = _unpacked(b)
        names = _unplanes(b.names + bytes((8 - NAME_BYTES) * len(doc)), "<u8")
        dealt.append((_unplanes(b.hashes, "<u4").astype(np.int64), names, doc, start, run))
    h, name, doc, start, run = (np.concatenate(x) for x in zip(*dealt, strict=True))
    order = np.lexsort((doc, name, h))
    h, name, doc, start, run = (x[order] for x in (h, name, doc, start, run))
    new_hash, new_name = np.ones(len(h), bool), np.ones(len(h), bool)
    new_hash[1:] = h[1:] != h[:-1]
    new_name[1:] = new_hash[1:] | (name[1:] != name[:-1])
    lead = np.maximum.accumulate(np.where(new_name, np.arange(len(h)), 0))
    whole = doc > doc[lead]
    of_hash = np.cumsum(new_hash) - 1
    several = ~whole & (np.bincount(of_hash, new_name)[of_hash] > 1)
    size = np.bincount(of_hash, np.where(whole, 0, run + LENGTH - 1))[of_hash]
    keys = np.where(size > hot_bytes, 0, (h << 24) + held[0].bucket + 1)  # 0: dealt out by window
    for own, sort in ((whole, False), (several, True)):
        at = np.flatnonzero(own)
        for k in range(0, len(at), ROWS_OUT):
            one = at[k : k + ROWS_OUT]
            yield pd.DataFrame({"doc_id": doc[one], "place": _places(start[one], run[one]), "hash": keys[one] if sort else np.int64(-1)})


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the pieces that are to be sorted, or of their windows where the hash is 0.

    Places that are known to be repeats come without bytes.
    """
    windows: dict[bytes, tuple[int, int]] = {}
    more: dict[bytes, list[int]] = {}
    held = 0  # places in more
    out: list[tuple[int, int, int, bytes | None, bytes | None]] = []

    def rows() -> pd.DataFrame:
        nonlocal out
        done, out = pd.DataFrame(out, columns=FETCHED_NAMES), []
        return done

    def settle(doc: int, place: int, window: bytes | None = None) -> None:
        out.append(((doc * _MIX + place) >> 1 & _LONG, doc, place, _packed(more.pop(window, None)), None))

    def deal() -> Iterator[pd.DataFrame]:
        nonlocal held
        while windows:
            window, (doc, place) = windows.popitem()
            out.append((xxh64_intdigest(window) >> 1, doc, place, _packed(more.pop(window, None)), window))
            if len(out) > ROWS_OUT:
                yield rows()
        held = 0

    for batch in batches:
        for doc, base, text, places, hashes in zip(batch["doc_id"], batch["base"], batch["text"], batch["places"], batch["hashes"], strict=True):
            if places is None or text is None:
                continue
            raw, doc, base = text.encode(), int(doc), int(base)
            places, hashes = np.asarray(places, np.int64), np.asarray(hashes, np.int64)
            starts, runs = (places >> RUN_BITS) - base, places & ((1 << RUN_BITS) - 1)
            own = (starts >= 0) & (starts < len(raw))
            for place, h, s, r in zip(places[own].tolist(), hashes[own].tolist(), starts[own].tolist(), runs[own].tolist(), strict=True):
                if h:
                    out.append((h, doc, place, None, raw[s : s + r + LENGTH - 1]))
                    continue
                begin = s  # of the windows that have just been met in a smaller document
                for k in range(s, s + r):
                    window, one = raw[k : k + LENGTH], ((base + k) << RUN_BITS) | 1
                    known = windows.setdefault(window, (doc, one))
                    if known[0] < doc:
                        continue
                    if k > begin:
                        settle(doc, ((base + begin) << RUN_BITS) | (k - begin))
                    begin = k + 1
                    if known[0] > doc:
                        windows[window] = (doc, one)
                        settle(*known, window)
                    elif known[1] != one:  # another place of the same document shares its fate
                        more.setdefault(window, []).append(one)
                        held += 1
                if s + r > begin:
                    settle(doc, ((base + begin) << RUN_BITS) | (s + r - begin))
                if len(windows) + held > HELD_WINDOWS:
                    yield from deal()
                if len(out) > ROWS_OUT:
                    yield rows()
            if len(out) > ROWS_OUT:
                yield rows()
    yield from deal()
    yield rows()


def _packed(places: list[int] | None) -> bytes | None:
    return None if places is None else np.array(places, "<i8").tobytes()


def _by_document(docs: np.ndarray, places: np.ndarray, others: list[bytes | None]) -> pd.DataFrame:
    """One row for each document with all places of its rows, the further ones too; windows that overlap are one run."""
    more = [(d, np.frombuffer(o, "<i8")) for d, o in zip(docs.tolist(), others, strict=True) if o is not None]
    docs = np.concatenate([docs, *[np.full(len(x), d, np.int64) for d, x in more]])
    places = np.concatenate([places, *[x for _, x in more]])
    order = np.lexsort((places, docs))
    docs, starts = docs[order], places[order] >> RUN_BITS
    ends = starts + (places[order] & ((1 << RUN_BITS) - 1))
    new_doc = np.append(True, docs[1:] != docs[:-1])
    number = np.cumsum(new_doc) << (63 - RUN_BITS)  # above any end: the furthest one so far is of the same document
    reach = np.maximum.accumulate(number + ends) - number
    new = new_doc.copy()
    # texts of one doc_id share no window, so runs stay within one; they are cut where their length might not fit
    new[1:] |= (starts[1:] > reach[:-1] + LENGTH - 2) | (np.diff(starts >> (RUN_BITS - 1)) != 0)
    heads = np.flatnonzero(new)
    runs = _places(starts[heads], np.maximum.reduceat(ends, heads) - starts[heads])
    return pd.DataFrame({"doc_id": docs[new_doc], "places": np.split(runs, np.flatnonzero(new_doc[heads])[1:])})


def _sort(sort_bytes: int):
    """Repeats among the pieces of each hash, by their sorted suffixes; rows without a piece pass through.

    Rows come sorted by hash; as many hashes as ``sort_bytes`` hold are sorted at once. No more rows go out than come
    in: one for each document of those that are sorted or passed on together.
    """

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            for k in range(0, len(batch), ROWS_OUT):
                part = batch.iloc[k : k + ROWS_OUT]
                if (known := part["piece"].isna()).any():
                    yield _by_document(*_columns(part[known]))
                    part = part[~known]
                held.append(part)
                size += _bytes(part)
                if size > sort_bytes:
                    rows = pd.concat(held, ignore_index=True)
                    last = rows["hash"].searchsorted(rows["hash"].iloc[-1])
                    yield from _sorted(rows.iloc[:last], sort_bytes)
                    held = [rows.iloc[last:]]
                    size = _bytes(held[0])
        if held:
            yield from _sorted(pd.concat(held, ignore_index=True), sort_bytes)

    return sort


def _columns(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    return rows["doc_id"].to_numpy(np.int64), rows["place"].to_numpy(np.int64), [o if isinstance(o, bytes) else None for o in rows["others"]]


def _bytes(rows: pd.DataFrame) -> int:
    return int(rows["piece"].str.len().sum()) + sum(len(o) for o in rows["others"] if isinstance(o, bytes))


def _sorted(group: pd.DataFrame, sort_bytes: int) -> Iterator[pd.DataFrame]:
    sizes = group["piece"].str.len().to_numpy(np.int64)
    hashes = group["hash"].to_numpy(np.int64)
    edges = np.append(np.flatnonzero(np.diff(hashes, prepend=-1)), len(group))
    filled = np.append(0, np.cumsum(sizes))
    (docs, places, others), pieces = _columns(group), group["piece"].tolist()
    k = 0
    while k < len(edges) - 1:
        low, e = edges[k], k + 1
        while e < len(edges) - 1 and filled[edges[e + 1]] - filled[low] <= sort_bytes:
            e += 1
        high, k = edges[e], e
        if high - low < 2:
            continue
        text = np.frombuffer(b"".join(pieces[low:high]), np.uint8)
        runs = sizes[low:high] - LENGTH + 1
        begin = np.cumsum(sizes[low:high]) - sizes[low:high]
        piece = np.repeat(np.arange(high - low), runs)
        starts = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + begin[piece]
        ordered, block = equal_prefix_blocks(text, starts, LENGTH)
        owner = np.searchsorted(begin, ordered, side="right") - 1
        doc = docs[low:high][owner]
        least = np.minimum.reduceat(doc, np.flatnonzero(np.diff(block, prepend=-1)))
        repeats = np.sort(ordered[doc > least[block]])
        if len(repeats):
            owner = np.searchsorted(begin, repeats, side="right") - 1
            first = np.ones(len(repeats), bool)
            first[1:] = (np.diff(repeats) != 1) | (np.diff(owner) != 0)
            at = np.flatnonzero(first)
            run = np.diff(np.append(at, len(repeats)))
            own = owner[at]
            start = (places[low:high][own] >> RUN_BITS) + repeats[at] - begin[own]
            yield _by_document(docs[low:high][own], _places(start, run), [others[low + i] for i in own.tolist()])


def spans_of(places: np.ndarray, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes that the windows of ``places`` cover in one text."""
    starts = (places >> RUN_BITS) - base
    own = (starts >= 0) & (starts < size)
    starts, ends = starts[own], starts[own] + (places[own] & ((1 << RUN_BITS) - 1)) + LENGTH - 1
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    if not len(starts):
        return starts, ends
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], np.append(ends[:-1][new[1:]], ends[-1])


KEPT = "n_bytes long, n_removed long, n_spans long, spans array<array<bigint>>"


def whole_run(run: bytes) -> str:
    """A run of the bytes of a text, without those of characters that are parted at its ends."""
    begin, end = 0, len(run)
    while begin < end and run[begin] & 0xC0 == 0x80:
        begin += 1
    last = end - 1
    while last > begin and run[last] & 0xC0 == 0x80:
        last -= 1
    if last >= begin and last + 1 + sum(run[last] >= lead for lead in (0xC0, 0xE0, 0xF0)) > end:
        end = last
    return run[begin:end].decode()


def _cut_out(names: list[str], characters: bool):
    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            filled = batch["text"].str.len().fillna(0).cumsum().to_numpy()
            step = np.append(0, np.cumsum(np.diff(filled // BYTES_OUT) > 0)) if len(batch) else np.zeros(0)
            for _, part in batch.groupby(step, sort=False):
                rows = []
                for base, text, whole, parts in zip(part["base"], part["text"], part["whole"], part["parts"], strict=True):
                    raw = (text or "").encode()
                    places = np.concatenate([np.asarray([] if x is None else x, np.int64) for x in (whole, parts)])
                    begins, ends = spans_of(places, 0 if pd.isna(base) else int(base), len(raw))
                    edges = [0, *np.stack([begins, ends], 1).reshape(-1).tolist(), len(raw)]
                    runs = [raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    kept = text if characters and not len(begins) else "".join(map(whole_run, runs)) if characters else b"".join(runs)
                    rows.append((len(raw), len(raw) - sum(map(len, runs)), len(begins), np.stack([begins, ends], 1).tolist(), kept))
                out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept"])
                yield pd.concat([part[names].reset_index(drop=True), out], axis=1)

    return cut_out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sort_bytes: int = SORT_BYTES, hot_bytes: int = HOT_BYTES, characters: bool = False) -> DataFrame:
    """doc_id, columns, n_bytes, n_removed, n_spans, spans (begin and end of each removed run) and kept (bytes) of each row.

    With ``characters``, kept is a string: of a character that a cut parts, the other bytes go too; texts of which
    nothing is removed stay as they are, null ones too.

    Removed is each byte of ``text`` (UTF-8) within a 50-byte string that also starts in a row with a
    smaller ``doc_id``. Null texts are as empty. Rows with a null ``doc_id`` stay whole and remove nothing;
    rows with the same ``doc_id`` don't touch each other, so equal rows are treated alike. Texts of fewer
    than 50 bytes stay whole. ``sort_bytes`` are sorted at once, and a hash of more than ``hot_bytes`` is split
    by window; neither changes the result. Other columns pass through as ``columns``, a struct, so no names clash. An
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    others = [c for c in docs.columns if c not in (doc_id, text)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("columns"))
    before = Window.partitionBy("doc_id").orderBy("text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.repartition(n, "doc_id").withColumn("base", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).cast("long"))
    dealt = placed.mapInPandas(_deal(max(n, BUCKETS)), DEALT)
    found = dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(_match(hot_bytes), FOUND)
    by_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("place", "hash")).alias("found"))
    to_sort = by_doc.select("doc_id", F.filter("found", lambda x: x.hash >= 0).alias("found")).where(F.size("found") > 0)
    fetched = (
        placed.join(to_sort, "doc_id", "left")  # as below, so that one shuffle of the texts serves all three
        .select("doc_id", "base", "text", "columns", F.col("found.place").alias("places"), F.col("found.hash").alias("hashes"))
        .mapInPandas(_fetch, FETCHED)
    )
    repeats = fetched.repartition(n, "hash").sortWithinPartitions("hash").mapInPandas(_sort(sort_bytes), REPEATS)
    parts = repeats.groupBy("doc_id").agg(F.flatten(F.collect_list("places")).alias("parts"))
    whole = by_doc.select("doc_id", F.transform(F.filter("found", lambda x: x.hash < 0), lambda x: x.place).alias("whole"))
    joined = placed.join(whole, "doc_id", "left").join(parts, "doc_id", "left")
    out = joined.withColumn("columns", F.to_json("columns")).mapInPandas(
        _cut_out(["doc_id", "columns"], characters), f"doc_id long, columns string, {KEPT}, kept {'string' if characters else 'binary'}"
    )
    return out.withColumn("columns", F.from_json("columns", rows.schema["columns"].dataType))
