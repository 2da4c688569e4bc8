"""Alignment by segments against whole texts tokenised by the libraries, and all pairs of tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from aerolattice.llm import alignment, queries

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SPACES = [" ", " ", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "　", "\xa0", "\x85", "\x1c", "  ", "  ", "\v", "\f"]
WORDS = ["the", "it's", "Straße", "漢字", "😀", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "12345", "a.b", "x" * 40, "é", "é", "naïve", "#$%", "\x00", "ſ", "①", "don't", "​", "--", "…", "▁", "fiﬁ"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    to_byte = {c: k for k, c in enumerate(alignment.byte_symbols())}
    b = SentencePieceProcessor(model_file=B_PATH)

    def tokens(text):
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        of_a = [(i, bytes(map(to_byte.__getitem__, a.id_to_token(i)))) for i in ids]
        of_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
        wanted = (" " + text).encode()
        return (of_a, of_b) if b"".join(x for _, x in of_a) == wanted == b"".join(x for _, x in of_b) else ([], [])

    return tokens


def plain(texts, tokens):
    """By whole texts and all links one by one: rows of SUMS and the hash."""
    docs, counts = [], Counter()
    for text in texts:
        a, b = tokens(text)
        ends_a, ends_b = (np.cumsum([len(x) for _, x in of]).tolist() for of in (a, b))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([i for (i, _), e in zip(a, ends_a, strict=True) if lo < e <= hi], [i for (i, _), e in zip(b, ends_b, strict=True) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)] if len(text or "") < 3000 else None
        links, j = [], 0
        for (i, x), e in zip(a, ends_a, strict=True):
            while ends_b[j] <= e - len(x):
                j += 1
            k = j
            while k < len(b) and ends_b[k] - len(b[k][1]) < e:
                links.append((i, b[k][0]))
                k += 1
        docs.append((len(a), len(b), len(cuts), links, groups))
        counts.update(links)
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    for n_a, n_b, n_groups, links, groups in docs:
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups) if groups is not None else None
        hashed = None if groups is None else hashlib.sha256(spelled.encode()).hexdigest() if groups else ""
        yield n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashed


def made(seed):
    rng = random.Random(seed)
    return "".join(rng.choice(SPACES) * rng.randrange(0, 3) + rng.choice(WORDS if seed % 3 else WORDS[:-2]) for _ in range(rng.randrange(0, 30))) + rng.choice(["", "", *SPACES])


def same(got, texts, tokens):
    wanted = list(plain([t for _, t in texts], tokens))
    rows = Counter((i, *w[:6]) for (i, _), w in zip(texts, wanted, strict=True))
    assert Counter((r[0], *r[1:7]) for r in got) == rows
    hashes = Counter((i, w[6]) for (i, _), w in zip(texts, wanted, strict=True) if w[6] is not None)
    assert not hashes - Counter((r[0], r[7]) for r in got)


def test_segments_have_the_tokens_of_the_text(libraries):
    pair = alignment.pair_of(A_PATH, B_PATH)
    assert pair.splits
    for seed in range(1500):
        text = made(seed)
        a, b = libraries(text)
        if not text or not pair.keeps(text):
            assert not a
            continue
        segments = pair.segments(text)
        assert "".join(segments) == " " + text
        got_a, got_b = pair.tokens(segments)
        assert sum(got_a, []) == [i for i, _ in a] and sum(got_b, []) == [i for i, _ in b], text


@pytest.mark.parametrize(("size", "pairs"), [((10 << 20, 250_000), 1 << 22), ((200, 250_000), 1 << 22), ((10 << 20, 5), 1 << 22), ((10 << 20, 5), 0)])
def test_align_against_whole_texts(spark, libraries, monkeypatch, size, pairs):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", size[0])
    monkeypatch.setattr(alignment, "CHUNK_SEGMENTS", size[1])
    texts = [(k % 90, made(k)) for k in range(120)] + [(None, " "), (1, "  "), (2, "\n"), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, "own", 7) for i, t in texts], "doc_id long, text string, columns string, n_a long").repartition(3)
    got = alignment.align(df, A_PATH, B_PATH, max_pairs=pairs).select("columns.doc_id", *alignment.SUMS, "groups_sha256", "columns.columns", "columns.n_a").collect()
    assert {r[8:] for r in got} == {("own", 7)}
    same(got, texts, libraries)


def test_places_are_packed():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5000):
        places = rng.integers(0, 1 << 24, n).astype(np.uint32)
        assert alignment._unpacked(alignment._packed(places), n).tolist() == places.tolist()


def test_odd_rows(docs, none, libraries):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    same(alignment.align(docs, A_PATH, B_PATH).select("columns.doc_id", *alignment.SUMS, "groups_sha256").collect(), texts, libraries)
    assert alignment.align(none, A_PATH, B_PATH).count() == 0
    assert alignment.align(docs.where("text is null"), A_PATH, B_PATH).select("n_a", "groups_sha256").collect() == [(0, "")]


def test_query_on_documents(spark, libraries):
    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(queries.op12_token_alignment(spark, sf).collect(), texts, libraries)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        alignment.Pair(P.path("word_bpe_49k.json"), B_PATH)
    assert pa.__version__
