import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from weekcast.llm import bpe

VOCABULARY = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.load_ranks(VOCABULARY), P.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    ranks = {t: i for i, t in enumerate(own.tokens)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(own, text):
    raw = own.encode(text)
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@pytest.mark.parametrize("alphabet", ["abcdefgh  \n\t'sETAO1", "éüñß漢字 \u00a0\u3000🙂\u0301'll", "aab  \n\n!?$%&|"])
def test_same_ids_as_the_library(own, library, alphabet):
    rng = random.Random(7)
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))
        assert ids(own, text) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)).decode() == text


def test_every_character_between_letters(own, library):
    for code in [*range(0, 0x3000), *range(0xFB00, 0x10000), *range(0x1F600, 0x1F650)]:
        text = f"a{chr(code)}b {chr(code)} 1{chr(code)}"
        assert ids(own, text) == library.encode_ordinary(text), hex(code)


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 9_000, "ab" * 9_000, "\n" * 999 + "x", "<|endoftext|> x"])
def test_long_pieces_and_special_strings(own, library, text):
    assert ids(own, text) == library.encode_ordinary(text)


def test_texts_longer_than_the_list_limit(own, library, monkeypatch):
    text = "The theory of words, 12 of them.\n" * 50
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    assert ids(own, text) == library.encode_ordinary(text)


def test_small_cache(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    small = bpe.Bpe(bpe.load_ranks(VOCABULARY), P.PATTERN)
    text = "one two three four five six seven eight nine ten one two three " * 3
    assert ids(small, text) == library.encode_ordinary(text)


def test_query_columns_and_edge_rows(spark, library):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (None, "kept", "z"), (1, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = bpe.round_trip(df, VOCABULARY, P.PATTERN).collect()
    assert len(got) == 5
    for r, text in ((r, {1: "Hello world", 2: "", 3: "", None: "kept"}[r.doc_id]) for r in got):
        want = library.encode_ordinary(text)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), VOCABULARY, P.PATTERN).count() == 0


def test_whole_table_against_the_library(spark, library):
    from weekcast.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op9_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
