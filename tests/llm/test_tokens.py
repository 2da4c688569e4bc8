import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerolattice.llm import bpe, queries, token_counts, token_files
from aerolattice.llm.bpe import ByteBpe
from aerolattice.llm.pieces import PieceEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "\xa0", "\u3000", "é", "e\u0301", "\u0301", "Σ", "ß", "İ", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "12", "½", "x" * 50, "漢", "😀", "the", "The", "!", "...", "\x1c", "\x85", "\u200b", "ﬁ", "\r\n", "Ⅷ", "J", "\u030c", "œ", "ª", "word,", "Straße."]


def texts(n=1500):
    rnd = random.Random(5)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(25))) for _ in range(n)]


def test_pieces_are_the_librarys_ids():
    tok = Tokenizer.from_file(WORD)
    some = texts()
    for got, t in zip(PieceEncoder(WORD, counts=False).encode(some), some, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_own_bpe_is_the_librarys():
    tok, own = Tokenizer.from_file(BYTE), ByteBpe(BYTE)
    some = texts() + ["a" * 501, "ab" * 300, "aaabaaab" * 40]
    for got, t in zip(own.encode(some), some, strict=True):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == ids, t
        assert own.decode(got) == tok.decode(ids, skip_special_tokens=False)


def test_long_words_are_merged_as_the_library_does():
    rnd, tok, own = random.Random(6), Tokenizer.from_file(BYTE), ByteBpe(BYTE)
    some = ["".join(rnd.choice(letters) for _ in range(n)) for n in (1025, 20_000, 100_000) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "aé")]
    for got, t in zip(own.encode([*some, "a" * 3000]), [*some, "a" * 3000], strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_the_table_of_frequent_pieces(spark, prose):
    """Most pieces of the sampled texts are in a table of a quarter of the distinct ones, accented ones too."""
    docs, tok = prose["documents"], Tokenizer.from_file(WORD)
    every = [p for r in docs.collect() for p in (r.text or "").encode().split()]
    pieces, counts = token_counts.frequent_pieces(docs, WORD, most=len(set(every)) // 4)
    table = dict(zip(pieces.split(b" "), counts.tolist(), strict=True))
    assert len(table) == len(set(every)) // 4 and any(not p.isascii() for p in table)
    assert sum(p in table for p in every) > 0.5 * len(every)
    assert all(n == len(tok.encode(p.decode(), add_special_tokens=False).ids) for p, n in table.items())
    assert token_counts.frequent_pieces(docs.where("false"), WORD)[0] == b""


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr("aerolattice.llm.pieces.CACHE_PIECES", 20)
    monkeypatch.setattr("aerolattice.llm.bpe.CACHE_UNITS", 20)
    some = [f"w{k} and w{k + 1}, the {k}" for k in range(60)]
    for encoder, path in ((PieceEncoder(WORD, counts=False), WORD), (ByteBpe(BYTE), BYTE)):
        tok = Tokenizer.from_file(path)
        for k in range(0, 60, 7):
            for got, t in zip(encoder.encode(some[k : k + 7]), some[k : k + 7], strict=True):
                assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_counts_of_odd_rows(spark, docs, none):
    tok = Tokenizer.from_file(WORD)
    rows = token_counts.with_token_counts(docs, WORD, limit=20).collect()
    assert len(rows) == docs.count()
    for r in rows:
        t = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 20) and r.columns == "mine"
    assert token_counts.with_token_counts(none, WORD).count() == 0


def test_simple8b_round_trip():
    rnd = random.Random(2)
    for k in ([0], [1], [16], [16, 3, 0], [60, 61, 64], [7, 8], [1, 3, 8, 16, 33, 60, 61, 64]):
        for n in (0, 1, 59, 240, 5000, 40_000):
            v = np.array([rnd.getrandbits(rnd.choice(k)) if k != [0] else 0 for _ in range(n)], np.uint64)
            words, offsets, escapes = token_files.pack_segments(v)
            assert (token_files.unpack_segments(words, n, offsets, escapes) == v).all()
    assert len(token_files.pack_segments(np.zeros(600, np.uint64))[0]) == 8 * 10


def test_files_of_odd_rows(spark, docs, none, tmp_path):
    tok = Tokenizer.from_file(WORD)
    token_files.write_token_files(docs, str(tmp_path / "f"), WORD, end_id=1)
    rows = token_files.read_token_files(spark, str(tmp_path / "f")).orderBy("start").collect()
    wanted = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    start = 0
    for r, (i, t) in zip(rows, wanted, strict=True):
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    token_files.write_token_files(none, str(tmp_path / "g"), WORD, end_id=1)
    assert token_files.read_token_files(spark, str(tmp_path / "g")).count() == 0


def test_round_trip_of_odd_rows(docs, none):
    tok = Tokenizer.from_file(BYTE)
    one = bpe.round_trip(docs, BYTE)
    two = docs.withColumn("token_ids", bpe.encode(F.col("text"), BYTE)).withColumn("decoded", bpe.decode(F.col("token_ids"), BYTE))
    for got in (one, two):
        for r in got.collect():
            ids = tok.encode(r.text or "", add_special_tokens=False).ids
            assert np.frombuffer(r.token_ids, "<u4").tolist() == ids and r.decoded == (r.text or "")
    assert bpe.round_trip(none, BYTE).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_queries(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    word, byte, start = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE), 0
    counts = {r.doc_id: r for r in queries.op1_token_counts(spark, d).collect()}
    files = {r.doc_id: r for r in queries.op3_token_files(spark, d).collect()}
    trips = {r.doc_id: r for r in queries.op9_byte_bpe(spark, d).collect()}
    for i in sorted(docs):
        ids = word.encode(docs[i], add_special_tokens=False).ids
        assert tuple(counts[i]) == (i, len(docs[i].encode()), len(ids), len(ids) > 2048)
        raw = np.array([*ids, 1], "<u4").tobytes()
        assert tuple(files[i]) == (i, start, len(ids) + 1, zlib.crc32(raw))
        start += len(ids) + 1
        ids = byte.encode(docs[i], add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert tuple(trips[i]) == (i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(docs[i].encode()).hexdigest())
