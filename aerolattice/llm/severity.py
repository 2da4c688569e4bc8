"""Toxicity by cumulative-link ordinal regression on sparse word features.

Severity grades are ordered: 0 clean, 1 mild, 2 severe. One weight for each word is shared by all
thresholds: P(grade <= k) = 1 / (1 + exp(w.x - b_k)), b_1 < b_2. The words are those whose share among
labelled toxic documents is beyond chance. Grades come from the labels where these have more than 0 and 1.
Where labels only say toxic or not, grades are made: a toxic document is severe if it has more than the usual
number of such words, so the upper threshold then says how many there are, not how bad they are. Vocabulary,
grades and weights are learned from a bounded sample of labelled documents; scoring reads whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WORD = re.compile(r"[^\W\d_]+")
#: Labelled documents that are learned from at most; the standard score beyond chance and the documents that a word needs.
#: All words that have both are features: so many documents bound their number.
MAX_LABELLED = 20_000
MIN_SCORE, MIN_DOCS = 4.0, 3
#: Occurrences of a word count up to this.
MAX_COUNT = 3
L2, STEPS = 1e-3, 400
TOXIC_FROM = 0.5


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class CumulativeLink:
    """Weights of the words and ascending thresholds of the grades."""

    def __init__(self, words: list[str], weights: np.ndarray, bounds: np.ndarray):
        self.words = {w: k for k, w in enumerate(words)}
        self.weights, self.bounds = weights, bounds

    @classmethod
    def fit(cls, words: list[str], row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int) -> CumulativeLink:
        """Maximum likelihood with a small L2 term, by gradient steps of adapted length.

        Thresholds are the first one and the logarithms of the gaps, so that they stay in order.
        """
        n, v = len(grade), len(words)
        share = np.clip(np.array([(grade <= k).mean() for k in range(grades - 1)]), 1e-3, 1 - 1e-3)
        start = np.log(share / (1 - share))
        gaps = np.log(np.maximum(np.diff(start), 1e-2))
        theta = np.concatenate([np.zeros(v), start[:1], gaps])
        moment, square = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            w, gap = theta[:v], np.exp(theta[v + 1 :])
            bounds = theta[v] + np.concatenate([[0.0], np.cumsum(gap)])
            score = np.bincount(row, weights=w[col] * value, minlength=n)
            edges = np.concatenate([[-np.inf], bounds, [np.inf]])
            high, low = _sigmoid(edges[grade + 1] - score), _sigmoid(edges[grade] - score)
            p = np.maximum(high - low, 1e-12)
            d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
            d_score = d_high - d_low  # of the negative log-likelihood
            d_bounds = np.array([d_low[grade == k + 1].sum() - d_high[grade == k].sum() for k in range(grades - 1)]) / n
            d_w = np.bincount(col, weights=d_score[row] * value, minlength=v) / n + L2 * w / max(v, 1)
            d_gaps = np.array([d_bounds[k + 1 :].sum() for k in range(grades - 2)]) * gap
            grad = np.concatenate([d_w, [d_bounds.sum()], d_gaps])
            moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad**2
            theta = theta - 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        return cls(words, theta[:v], theta[v] + np.concatenate([[0.0], np.cumsum(np.exp(theta[v + 1 :]))]))

    def beyond(self, texts: list[str]) -> np.ndarray:
        """P(grade > k) of each text, a row for each and a column for each threshold."""
        score = np.zeros(len(texts))
        for k, text in enumerate(texts):
            counts: dict[int, int] = {}
            for at in map(self.words.get, WORD.findall(text.lower())):
                if at is not None:
                    counts[at] = counts.get(at, 0) + 1
            score[k] = sum(self.weights[at] * min(c, MAX_COUNT) for at, c in counts.items())
        return _sigmoid(score[:, None] - self.bounds[None, :])


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, toxic, text in zip(batch["_id"], batch["toxic"], batch["text"], strict=True):
            counts: dict[str, int] = {}
            for w in WORD.findall(text.lower()):
                counts[w] = counts.get(w, 0) + 1
            rows += [(key, toxic, w, min(c, MAX_COUNT)) for w, c in counts.items()]
        yield pd.DataFrame(rows, columns=["_id", "toxic", "word", "n"])


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        columns = [batch[c].to_numpy().astype(kind).tobytes() for c, kind in (("_id", "<i8"), ("place", "<i4"), ("n", "i1"))]
        yield pd.DataFrame([columns], columns=["ids", "places", "counts"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 11, max_labelled: int = MAX_LABELLED) -> CumulativeLink:
    """Learns from at most ``max_labelled`` rows of ``labels`` (doc_id, toxic) with their documents.

    ``toxic`` is 0 for clean; if it is at most 1, the toxic documents are parted into two grades as stated
    above, else its values are the grades. Null and negative labels are left out; of a document with several, or
    several rows of it, the most toxic counts. Without toxic or without clean rows the model gives grade 0 to all.
    """
    spark = docs.sparkSession
    known = labels.where("toxic >= 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    known = F.broadcast(known.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(max_labelled))  # bounded
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(known, "_id")
    words = rows.select("_id", "toxic", "text").mapInPandas(_words, "_id long, toxic int, word string, n int").cache()
    try:
        found = rows.groupBy("toxic").agg(F.count_distinct("_id")).collect()
        sizes = dict(tuple(r) for r in found)
        toxic_n, clean_n = sum(n for k, n in sizes.items() if k), sizes.get(0, 0)
        if not toxic_n or not clean_n:
            return CumulativeLink([], np.zeros(0), np.array([50.0, 51.0]))
        t = F.count_distinct(F.when(F.col("toxic") > 0, F.col("_id")))
        c = F.count_distinct(F.when(F.col("toxic") == 0, F.col("_id")))
        shares = words.groupBy("word").agg(t.alias("t"), c.alias("c")).where(f"t + c >= {MIN_DOCS} AND t + c < {toxic_n + clean_n}")  # a word of all documents tells nothing
        pooled = (F.col("t") + F.col("c")) / (toxic_n + clean_n)
        spread = F.sqrt(pooled * (1 - pooled) * (1 / toxic_n + 1 / clean_n))
        ranked = shares.withColumn("z", (F.col("t") / toxic_n - F.col("c") / clean_n) / spread).where(F.col("z") >= MIN_SCORE)
        features = spark.createDataFrame(ranked.select("word").orderBy("word").collect(), "word string")
        chosen = [r.word for r in features.collect()]
        if not chosen:
            return CumulativeLink([], np.zeros(0), np.array([50.0, 51.0]))
        numbered = spark.createDataFrame(list(enumerate(chosen)), "place int, word string")
        found = words.join(F.broadcast(numbered), "word").groupBy("_id", "place").agg(F.max("n").alias("n"))
        packed = found.mapInPandas(_packed, "ids binary, places binary, counts binary").collect()  # 13 bytes a feature of a document
        ids = [tuple(r) for r in rows.select("_id", "toxic").distinct().orderBy("_id").collect()]  # max_labelled rows at most
    finally:
        words.unpersist()
    of_doc, col, value = (np.concatenate([np.frombuffer(r[k], kind) for r in packed] or [np.zeros(0, kind)]) for k, kind in enumerate(("<i8", "<i4", "i1")))
    row = np.searchsorted(np.array([i for i, _ in ids], np.int64), of_doc)
    order = np.lexsort((col, row))
    row, col, value = row[order], col[order].astype(np.int64), value[order].astype(float)
    toxic = np.array([t for _, t in ids])
    if (grades := int(toxic.max())) > 1:
        return CumulativeLink.fit(chosen, row, col, value, toxic, grades + 1)
    many = np.bincount(row, weights=value, minlength=len(ids))
    usual = np.median(many[(toxic == 1) & (many > 0)]) if ((toxic == 1) & (many > 0)).any() else 1
    return CumulativeLink.fit(chosen, row, col, value, np.where(toxic == 1, 1 + (many > usual), 0), 3)


def with_severity(df: DataFrame, model: CumulativeLink, text: str = "text") -> DataFrame:
    """``df`` with expected_severity (0 to the highest grade), grade (the likeliest) and toxic; columns of these names are replaced.

    Null and empty texts have no words and get what the thresholds alone say. Each row depends on its own
    text.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_severity double, grade int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [shared.value.beyond(p) for p in slices(batch.fillna("").tolist())]
            beyond = np.concatenate(parts) if parts else np.zeros((0, len(shared.value.bounds)))
            each = -np.diff(np.concatenate([np.ones((len(beyond), 1)), beyond, np.zeros((len(beyond), 1))], axis=1), axis=1)
            yield pd.DataFrame({"expected_severity": beyond.sum(axis=1).round(6), "grade": each.argmax(axis=1)})

    found = F.col("_severity")
    rest = df.drop("expected_severity", "grade", "toxic")
    done = rest.withColumn("_severity", run(F.col(text)))
    done = done.withColumn("expected_severity", found.expected_severity).withColumn("grade", found.grade).drop("_severity")
    return done.withColumn("toxic", F.col("expected_severity") >= TOXIC_FROM)
