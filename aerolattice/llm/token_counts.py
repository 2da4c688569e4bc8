"""Token counts by a map-side lookup in two tiers.

A text is cut at ASCII white space. No token of the tokenizer reaches across such a cut, so the count of
a text is the sum over its pieces. Tier one is a broadcast table of the most frequent pieces, with their
counts of tokens. Frequencies come from a sample of bounded size: SAMPLE texts as they come, counted by one
task, of which the FREQUENT commonest pieces of at most TABLE_BYTES are kept. The sample decides what is
looked up and what is encoded, never a count. Tier two encodes what misses tier one with the tokenizers
library and keeps the result in a cache of the Python worker, which is emptied when full (pieces.py). No
piece is ever shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices
from .pieces import CACHE_BYTES, PieceEncoder

#: Texts that frequencies are taken from, characters of each batch of them, and pieces and bytes of the table at most.
SAMPLE, FREQUENT, TABLE_BYTES = 4096, 1 << 17, 4_000_000


def frequent_pieces(df: DataFrame, path: str, text: str = "text", sample: int = SAMPLE, most: int = FREQUENT) -> tuple[bytes, np.ndarray]:
    """Tier one: the commonest pieces of ``sample`` rows of ``df``, joined by blanks, and each one's token count.

    The rows are the first ones of the first partition, which one task reads; nothing is shuffled.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()
        left = sample
        for batch in batches:
            if left <= 0:
                break
            texts, left = batch["t"].iloc[:left], left - len(batch)
            for t in texts:
                found.update(p for p in t.encode("utf-8", "surrogatepass").split() if len(p) <= CACHE_BYTES)
                if len(found) > 4 * most:  # rare ones go first; only speed depends on it
                    found = Counter(dict(found.most_common(2 * most)))
        top = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most]
        encoder = PieceEncoder(path, counts=True)
        counts = [encoder.known[p] for p, _ in top]
        small = [(p, n) for (p, _), n in zip(top, counts, strict=True) if n < 256]
        size = np.cumsum([len(p) + 1 for p, _ in small]) if small else np.zeros(0)
        small = small[: int((size <= TABLE_BYTES).sum())]
        yield pd.DataFrame({"pieces": [b" ".join(p for p, _ in small)], "counts": [bytes(n for _, n in small)]})

    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    row = texts.mapInPandas(count, "pieces binary, counts binary").first()  # of the first partition: TABLE_BYTES and FREQUENT bytes
    return (bytes(row.pieces), np.frombuffer(row.counts, np.uint8)) if row else (b"", np.zeros(0, np.uint8))


def token_count(text: Column, tokenizer_path: str, table: Broadcast) -> Column:
    """Tokens of ``text`` as the tokenizers library counts them, without added special tokens.

    ``table`` is what frequent_pieces() gives, broadcast. Null and empty texts have no tokens. The result
    depends on the text alone, so ties, repeated rows and other columns don't matter.
    """

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces, counts = table.value
        encoder = PieceEncoder(tokenizer_path, counts=True, table=dict(zip(pieces.split(b" "), counts.tolist(), strict=True)) if pieces else {})
        for batch in batches:
            yield pd.Series([n for part in slices(batch.fillna("").tolist()) for n in encoder.encode(part)], dtype="int64")

    return count(text)


def with_token_counts(df: DataFrame, tokenizer_path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to ``df``; columns of these names are replaced."""
    table = df.sparkSession.sparkContext.broadcast(frequent_pieces(df, tokenizer_path, text))
    n = token_count(F.col(text), tokenizer_path, table)
    return (
        df.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("n_tokens", n)
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
