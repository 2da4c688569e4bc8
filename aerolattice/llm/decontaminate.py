"""Benchmark decontamination: an inverted index of test items, searched by every training passage.

Items are indexed by BM25, scaled so that 1 is the least score that a passage can have which shares
OVERLAP of an item's five-word shingles: at most that share of its words can be missing, and these are
taken to be its weightiest. So nothing above the overlap is lost by the search. A passage first drops out
if its terms' largest scores don't add up to 1; terms that can't reach 1 together without others name no
candidates (the WAND bound); blocks of items whose per-term maxima don't add up to 1 are skipped (block
maxima); what is left is scored exactly. Where the table of block maxima is small, all blocks of a passage are
bounded at one go, else only those that such terms name. Passages are windows that overlap by half and are longer than
twice any item, so that each occurrence lies within one; whole texts are read. The question of an item is indexed
as well, as an entry of its own. What is found is verified by shared five-word shingles: the whole item's within
the passage, or the question's and the answer's each, wherever they stand in the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
BLOCK_ITEMS = 16
#: Bytes of items that one index holds; more items are dealt out to several indexes, each broadcast in turn.
MAX_INDEX_BYTES = 16_000_000
#: Terms of windows that are scored at once.
AT_ONCE = 1 << 20
#: Cells up to which a table of scores is kept in full.
FULL_CELLS = 2_000_000
FOUND = "array<struct<item_id:bigint,score:double,overlap:double,question_overlap:double,answer_overlap:double>>"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; of fewer words the whole; of none nothing."""
    return {tuple(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def question_and_answer(text: str) -> tuple[str, str]:
    """The last line is the answer if there are several, else the last sentence; a single one is all question."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    if len(lines) < 2:
        lines = [x for x in re.split(r"(?<=[.?!])\s+", text) if WORD.search(x)]
    return (text, "") if len(lines) < 2 else ("\n".join(lines[:-1]), lines[-1])


class ScoreTable:
    """Scores by term and place (an item or a block): in full where it has few cells, else sorted keys to search."""

    def __init__(self, scores: dict[tuple[int, int], float], width: int, terms: int):
        self.width = width
        keys = np.array([k * width + at for k, at in scores], np.int64)
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], np.array(list(scores.values()))[order]
        self.full = None
        if terms * width <= FULL_CELLS:
            self.full = np.zeros(terms * width)
            self.full[self.keys] = self.scores

    def of(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        wanted = term * self.width + place
        if self.full is not None:
            return self.full[wanted]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.scores[at], 0.0)

    def places(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places that have each of ``term``, and for each the place of its term in ``term``."""
        low, high = np.searchsorted(self.keys, term * self.width), np.searchsorted(self.keys, (term + 1) * self.width)
        n = high - low
        number = np.repeat(np.arange(len(term)), n)
        return self.keys[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[number]] % self.width, number


def _parts(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Begins and ends of runs of ``counts`` that each add up to about ``limit``."""
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(counts) // max(limit, 1))) + 1).tolist(), len(counts)]
    return ((low, high) for low, high in zip(edges, edges[1:], strict=False) if high > low)


class ItemIndex:
    """BM25 postings of some items, by term and by block, with the items' shingles for verification."""

    def __init__(self, items: list[tuple[int | None, str]]):
        texts = [(i, t, words_of(t)) for i, t in items]
        texts = [(i, t, w) for i, t, w in sorted(texts, key=lambda x: (x[0] is None, x[0], x[1])) if w]
        self.ids = [i for i, _, _ in texts]
        split = [tuple(map(words_of, question_and_answer(t))) for _, t, _ in texts]
        self.parts = [tuple(map(shingles, (w, *split[k]))) for k, (_, _, w) in enumerate(texts)]
        self.longest = max((len(w) for _, _, w in texts), default=0)
        #: Of each entry the item, and which of its parts: the whole, or the question if both it and the answer are long enough to tell.
        self.entries = [(k, 0) for k in range(len(texts))] + [(k, 1) for k, (q, a) in enumerate(split) if len(q) >= SHINGLE and a]
        texts = [texts[k][2] if part == 0 else split[k][0] for k, part in self.entries]
        n = len(texts)
        usual = sum(map(len, texts)) / max(n, 1)
        names: dict[str, int] = {}
        counts: list[dict[int, int]] = []
        for words in texts:
            own: dict[int, int] = {}
            for w in words:
                k = names.setdefault(w, len(names))
                own[k] = own.get(k, 0) + 1
            counts.append(own)
        self.terms = names
        found = np.bincount([k for own in counts for k in own], minlength=len(names)) if counts else np.zeros(0)
        idf = np.log1p((n - found + 0.5) / (found + 0.5))
        postings: dict[tuple[int, int], float] = {}
        for item, (own, words) in enumerate(zip(counts, texts, strict=True)):
            length = K1 * (1 - B + B * len(words) / usual)
            scores = {k: float(idf[k]) * c * (K1 + 1) / (c + length) for k, c in own.items()}
            found, places = len(shingles(words)), max(1, len(words) - SHINGLE + 1)
            # each word that is missing takes a shingle with it, if no shingle is there twice
            missing = math.floor((1 - OVERLAP) * found + 1e-9) if found == places else math.ceil((1 - OVERLAP) * places)
            least = sum(scores.values()) - sum(sorted(scores.values(), reverse=True)[:missing])
            least = max(least, 0.2 * min(scores.values()))
            for k, s in scores.items():
                postings[k, item] = s / least
        self.blocks = -(-n // BLOCK_ITEMS)
        maxima: dict[tuple[int, int], float] = {}
        for (k, item), s in postings.items():
            at = (k, item // BLOCK_ITEMS)
            maxima[at] = max(maxima.get(at, 0.0), s)
        self.items = n
        self.postings = ScoreTable(postings, self.blocks * BLOCK_ITEMS, len(names))
        self.maxima = ScoreTable(maxima, self.blocks, len(names))
        self.bounds = np.zeros(len(names))
        for (k, _), s in maxima.items():
            self.bounds[k] = max(self.bounds[k], s)

    def search(self, terms: list[np.ndarray], step: int) -> list[tuple[int, int, int, float]]:
        """(text, first word, entry, score) of all windows of 2 * step words and entries with score >= 1.

        ``terms`` has the index's number of each word of each text, or -1.
        """
        flat = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        lens = np.array([len(t) for t in terms], np.int64)
        chunks = np.maximum(-(-lens // step), 1)
        base = np.cumsum(chunks) - chunks
        owner = np.repeat(np.arange(len(terms)), lens)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        chunk = base[owner] + place // step
        known = flat >= 0
        chunk, term = chunk[known], flat[known]
        first = chunk - 1
        back = np.isin(first, base - 1, invert=True)  # the chunk before belongs to the same text
        size = len(self.terms)
        pairs = np.unique(np.concatenate([chunk * size + term, first[back] * size + term[back]]))
        window, term = pairs // size, pairs % size
        bound = self.bounds[term]
        total = np.bincount(window, weights=bound, minlength=int(chunks.sum()))
        stays = total[window] >= 1
        window, term, bound = window[stays], term[stays], bound[stays]
        if not len(window):
            return []
        order = np.lexsort((bound, window))
        window, term, bound = window[order], term[order], bound[order]
        begin = np.flatnonzero(np.diff(window, prepend=-1))
        counts = np.diff(np.append(begin, len(window)))
        if self.maxima.full is not None:
            rows, block = self._bounded(term, begin, counts)
        else:
            sums = np.cumsum(bound)
            within = sums - np.repeat(sums[begin] - bound[begin], counts)
            essential = within >= 1 - 1e-9
            block, number = self.maxima.places(term[essential])
            candidate = np.unique(window[essential][number] * self.blocks + block)
            rows, block = np.searchsorted(window[begin], candidate // self.blocks), candidate % self.blocks
            alive = self._scores(self.maxima, term, begin, counts, rows, block) >= 1 - 1e-9
            rows, block = rows[alive], block[alive]
        if self.postings.full is not None:
            rows, items, score = self._block_items(term, begin, counts, rows, block)
        else:
            items = (block[:, None] * BLOCK_ITEMS + np.arange(BLOCK_ITEMS)).reshape(-1)
            rows = np.repeat(rows, BLOCK_ITEMS)
            score = self._scores(self.postings, term, begin, counts, rows, items)
        hit = score >= 1 - 1e-9
        chunk = window[begin][rows[hit]]
        text = np.searchsorted(base, chunk, side="right") - 1
        return list(zip(text.tolist(), ((chunk - base[text]) * step).tolist(), items[hit].tolist(), score[hit].tolist(), strict=True))

    def _bounded(self, term: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and blocks whose maxima add up to 1, of all windows and all blocks."""
        maxima = self.maxima.full.reshape(-1, self.blocks)
        rows, blocks = [], []
        for low, high in _parts(counts, AT_ONCE // self.blocks):
            sums = np.add.reduceat(maxima[term[begin[low] : begin[high - 1] + counts[high - 1]]], begin[low:high] - begin[low], axis=0)
            row, block = np.nonzero(sums >= 1 - 1e-9)
            rows.append(row + low)
            blocks.append(block)
        return np.concatenate(rows), np.concatenate(blocks)

    def _block_items(self, term: np.ndarray, begin: np.ndarray, counts: np.ndarray, rows: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, entries and scores of 1 and more, of the windows ``rows`` and the entries of their ``block``."""
        scores = self.postings.full.reshape(-1, self.blocks, BLOCK_ITEMS)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for low, high in _parts(counts[rows], AT_ONCE // BLOCK_ITEMS):
            n = counts[rows[low:high]]
            number, first = np.repeat(np.arange(high - low), n), np.cumsum(n) - n
            at = np.arange(int(n.sum())) - np.repeat(first, n) + begin[rows[low:high]][number]
            sums = np.add.reduceat(scores[term[at], block[low:high][number]], first, axis=0)
            row, place = np.nonzero(sums >= 1 - 1e-9)
            found.append((rows[low:high][row], block[low:high][row] * BLOCK_ITEMS + place, sums[row, place]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    @staticmethod
    def _scores(table: ScoreTable, term: np.ndarray, begin: np.ndarray, counts: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The sum over all terms of each of the windows ``rows`` of their scores at its place, about AT_ONCE terms at a time."""
        out = np.zeros(len(rows))
        for low, high in _parts(counts[rows], AT_ONCE):
            n = counts[rows[low:high]]
            number = np.repeat(np.arange(high - low), n)
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + begin[rows[low:high]][number]
            out[low:high] = np.bincount(number, weights=table.of(term[at], places[low:high][number]), minlength=high - low)
        return out

    def matches(self, texts: list[str]) -> list[list[dict]]:
        """Of each text the items that it holds, each with its best score, verified by shingles."""
        out: list[dict[int, dict]] = [{} for _ in texts]
        if not self.items:
            return [[] for _ in texts]
        words = [words_of(t) for t in texts]
        get = self.terms.get
        step = max(64, math.ceil(self.longest / OVERLAP))
        everything: dict[int, set[tuple[str, ...]]] = {}
        for text, first, entry, score in self.search([np.array([get(w, -1) for w in ws], np.int64) for ws in words], step):
            item, part = self.entries[entry]
            known = out[text].get(item)
            if known and known["score"] >= score:
                continue
            ws = words[text]
            if part == 0:
                ws = ws[first : first + 2 * step]
                there = shingles(ws)
            else:
                there = everything[text] if text in everything else everything.setdefault(text, shingles(ws))
            whole, question, answer = (_share(p, ws, there) for p in self.parts[item])
            if (whole if part == 0 else min(question, answer)) < OVERLAP:
                continue
            out[text][item] = {"item_id": self.ids[item], "score": round(score, 6), "overlap": round(whole, 6), "question_overlap": round(question, 6), "answer_overlap": round(answer, 6)}
        return [[found[k] for k in sorted(found)] for found in out]


def _share(part: set[tuple[str, ...]], words: list[str], there: set[tuple[str, ...]]) -> float:
    """The share of the shingles of ``part`` among ``there``, those of ``words``; a shorter part is there as a whole or not."""
    if not part:
        return 0.0
    k = len(next(iter(part)))
    if k < SHINGLE:
        return float(any(tuple(words[j : j + k]) in part for j in range(len(words) - k + 1)))
    return len(part & there) / len(part)


def indexes(items: DataFrame, key: str = "item_id", text: str = "text", max_bytes: int = MAX_INDEX_BYTES) -> Iterator[ItemIndex]:
    """Indexes of all ``items``, each of about ``max_bytes`` of text at most; one at a time is in the driver's memory."""
    rows = items.select(F.col(key).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // max_bytes)
    part = F.pmod(F.xxhash64("i", "t"), F.lit(max(n, 1)))
    for k in range(n):
        yield ItemIndex([tuple(r) for r in rows.where(part == k).collect()])


def leaks(text: Column, index: ItemIndex, spark) -> Column:
    """The items of ``index`` that ``text`` holds, as an array of structs; empty for null and empty texts."""
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([m for part in slices(batch.fillna("").tolist()) for m in shared.value.matches(part)], dtype="object")

    return run.asNondeterministic()(text)  # else the optimizer asks it twice, for a filter and for the rows


def with_leaks(docs: DataFrame, items: DataFrame, text: str = "text", max_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``docs`` with ``leaks``: the benchmark items that each text holds, with scores and overlaps.

    An item is held if a passage has at least 0.8 of its five-word shingles (an item of fewer words: all
    of it, in a row), or if the text has 0.8 of those of the question and of those of the answer, wherever they
    stand; a question of fewer than five words doesn't count by itself. Case and punctuation don't count. Null and empty texts hold none, nor do items
    without words occur. Equal rows have equal results; a column named ``leaks`` is replaced. Without items
    ``leaks`` is empty.
    """
    spark = docs.sparkSession
    out = docs.withColumn("leaks", F.array().cast(FOUND))
    for index in indexes(items, max_bytes=max_bytes):
        out = out.withColumn("leaks", F.concat("leaks", leaks(F.col(text), index, spark)))
    return out
