"""Quality by importance resampling: how much likelier a text is under the target than under all texts.

Two generative models of hashed n-grams (letter trigrams and word pairs) are counted: the target's over
labelled good documents, the raw one over all documents. A text's weight is the mean log ratio of its
n-grams times EFFECTIVE, a length that is the same for all, as the plain sum would rank by length. Gumbel
noise that depends on the row alone is added, and the k largest keys are drawn: a sample without
replacement in proportion to the weights. k is the number of documents whose weight reaches the level
that all but SLACK of the labelled good documents reach which the target model hasn't seen: one in four.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: Buckets of each kind of n-gram, and the count that each bucket has at first.
BUCKETS = 1 << 16
PRIOR = 1.0
EFFECTIVE = 100.0
#: Labelled documents at most for the target model and for the level; the rest of the labels isn't needed.
MAX_LABELLED = 20_000
SLACK = 0.002
#: Bytes of text whose n-grams are hashed at once.
AT_ONCE = 1 << 18
BINS = 2048

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: White space as blanks, digits alike.
_LIKE = np.arange(256, dtype=np.uint8)
_LIKE[9:14] = 32
_LIKE[48:58] = 48


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``texts`` (trigrams first, then pairs) and the place of each one's text."""
    raw = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    text = _LIKE[np.frombuffer(b"".join(raw), np.uint8)]
    lens = np.array([len(r) for r in raw], np.int64)
    owner = np.repeat(np.arange(len(texts)), lens)
    n = max(len(text) - 2, 0)
    wide = text.astype(np.uint32)
    triple = (wide[:n] << np.uint32(16)) | (wide[1 : n + 1] << np.uint32(8)) | wide[2 : n + 2]
    within = (owner[:n] == owner[2 : n + 2]) & ~((text[:n] == 32) & (text[1 : n + 1] == 32))
    first = (triple[within] * np.uint32(0x9E3779B1)) >> np.uint32(16)

    gap = text == 32
    starts = np.flatnonzero(~gap & np.append(True, gap[:-1])) if len(text) else np.zeros(0, np.int64)
    ends = np.flatnonzero(gap & np.append(False, ~gap[:-1])) if len(text) else np.zeros(0, np.int64)
    up, down = np.full(len(text) + 1, _BASE, _U), np.full(len(text) + 1, pow(_BASE, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.append(_U(0), np.cumsum((text.astype(_U) + _U(1)) * up[: len(text)]))
    words = (sums[ends] - sums[starts]) * down[starts]
    words ^= words >> _U(29)
    pairs = words[:-1] * _U(0xD6E8FEB86659FD93) + words[1:]
    pairs ^= pairs >> _U(32)
    pairs *= _U(_BASE)
    same = owner[starts[:-1]] == owner[starts[1:]]
    second = (pairs[same] >> _U(48)).astype(np.int64) + BUCKETS
    return np.concatenate([first.astype(np.int64), second]), np.concatenate([owner[:n][within], owner[starts[:-1]][same]])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, 2 * BUCKETS), np.int64)
    for batch in batches:
        for good in (True, False):
            for part in slices(batch["text"][batch["good"] == good].tolist(), AT_ONCE):
                counts[int(good)] += np.bincount(ngram_buckets(part)[0], minlength=2 * BUCKETS)
    raw, at = counts.sum(axis=0), np.flatnonzero(counts.sum(axis=0))
    yield pd.DataFrame({"bucket": at, "target": counts[1][at], "raw": raw[at]})


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Of each bucket, the log of its share in the target over its share in the raw model, kind by kind."""
    def logs(c: np.ndarray) -> np.ndarray:
        kinds = c.reshape(2, BUCKETS) + PRIOR
        return np.log(kinds / kinds.sum(axis=1, keepdims=True)).reshape(-1)

    return logs(target) - logs(raw)


def weights(texts: list[str], ratios: np.ndarray) -> np.ndarray:
    """EFFECTIVE times the mean log ratio of each text's n-grams; 0 for a text without any."""
    buckets, owner = ngram_buckets(texts)
    sums = np.bincount(owner, weights=ratios[buckets], minlength=len(texts))
    return EFFECTIVE * sums / np.maximum(np.bincount(owner, minlength=len(texts)), 1)


def threshold(keys: DataFrame, k: int) -> float:
    """The largest t such that at least ``k`` rows of ``keys`` (column key) have key >= t, by ever finer counts."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return float("inf")
    above = 0
    while True:
        width = (high - low) / BINS
        if width <= max(abs(low), abs(high), 1.0) * 1e-15:
            return low
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)).cast("int")
        counts = dict(keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(place.alias("bin")).count().collect())
        for b in range(BINS - 1, -1, -1):
            if above + counts.get(b, 0) >= k:
                break
            above += counts.get(b, 0)
        low, high = low + b * width, low + (b + 1) * width
        if counts.get(b, 0) <= 1:
            exact = keys.where((F.col("key") >= low) & (F.col("key") <= high)).agg(F.min("key")).first()[0]
            return low if exact is None else exact


def _drawn(docs: DataFrame, labels: DataFrame, text: str, key: str, seed: int, max_labelled: int) -> tuple[Column, Column, DataFrame, float]:
    """The weight and the key of a row of ``docs`` as columns, both as a written table, and the least key that is kept."""
    spark = docs.sparkSession
    good_ids = labels.where("quality = 1").select(F.col("doc_id").alias("_good_id")).distinct()
    good_ids = good_ids.orderBy(F.xxhash64("_good_id", F.lit(seed)), "_good_id").limit(max_labelled)  # bounded
    good_ids = F.broadcast(good_ids.withColumn("_held_out", F.pmod(F.xxhash64("_good_id", F.lit(seed + 1)), F.lit(4)) == 0))
    plain = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = plain.join(good_ids, F.col("_id") == F.col("_good_id"), "left").select("text", F.coalesce(~F.col("_held_out"), F.lit(False)).alias("good"))
    counted = marked.mapInPandas(_count, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    target, raw = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for b, t, r in counted.collect():  # 2 * BUCKETS rows at most
        target[b], raw[b] = t, r
    ratios = spark.sparkContext.broadcast(log_ratios(target, raw) if target.any() else np.zeros(2 * BUCKETS))

    @F.pandas_udf("double")
    def log_weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [weights(p, ratios.value) for p in slices(batch.fillna("").tolist(), AT_ONCE)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noise = -F.log(-F.log(uniform))
    weight = log_weight(F.col(text))
    keyed = docs.select(F.col(key).alias("_id"), weight.alias("log_weight"), noise.alias("noise")).select("_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("key"))
    keyed = written(keyed, "resampling-keys")  # no texts
    good = keyed.join(good_ids, F.col("_id") == F.col("_good_id"))
    held_out, any_good = good.agg(F.percentile(F.when(F.col("_held_out"), F.col("log_weight")), SLACK), F.percentile("log_weight", SLACK)).first()
    level = held_out if held_out is not None else any_good if any_good is not None else float("-inf")
    k = keyed.where(F.col("log_weight") >= level).count()
    return weight, noise, keyed, threshold(keyed.select("key"), k)


def scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The key column, log_weight, resampling_key and kept of each row of ``docs``, without its texts: as resample(), each text scored once."""
    _, _, keyed, least = _drawn(docs, labels, text, key, seed, max_labelled)
    return keyed.select(F.col("_id").alias(key), "log_weight", F.col("key").alias("resampling_key"), (F.col("key") >= least).alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` with log_weight, resampling_key and kept; columns of these names are replaced.

    ``labels`` has doc_id and quality (1 good, 0 bad); null labels and documents without one count for
    the raw model alone. Null and empty texts have weight 0, which is what any text has on average. Equal
    rows have equal keys and are kept or not together. Without good labels all rows are kept, and an
    empty table gives an empty one. The draw needs the keys of all rows, so texts are scored once for it and once
    more for the rows: that takes less than a shuffle of the texts to join them with their keys.
    """
    weight, noise, _, least = _drawn(docs, labels, text, key, seed, max_labelled)
    own = [c for c in docs.columns if c not in ("log_weight", "resampling_key", "kept")]
    drawn = docs.select(*own, weight.alias("log_weight"), noise.alias("resampling_key"))
    return drawn.withColumn("resampling_key", F.col("log_weight") + F.col("resampling_key")).withColumn("kept", F.col("resampling_key") >= least)
