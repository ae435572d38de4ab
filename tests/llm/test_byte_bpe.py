"""Byte-level BPE against tiktoken, whole texts and edge cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return byte_bpe.load_ranks(RANKS)


@pytest.fixture(scope="module")
def theirs(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={}).encode_ordinary


TRICKY = [
    "", " ", "\n\n", "a  b", "a \n b", "don't 'll's '' 's 's' ''s", "it's've'lls'S", " 'tis", "x'", "'", "'l", "'r", "1'd2", "a\tb\r\nc ",
    "<|endoftext|>", "é😀 ñ中文", "\x1c\x85\xa0　x", "²ſ٣", "x" * 3000, " " * 3000 + "y", "ab " * 2000, "'" * 50 + "s",
]


def test_equals_the_library(own, theirs):
    rng = random.Random(5)
    letters = [*"ab'strevlmd 12  \n\t!?", "'ll", "é", "\xa0", "😀", "中", "\x85", "٣"]
    texts = TRICKY + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert [g.tolist() for g in own.encode_all(texts)] == [theirs(t) for t in texts]
    assert [own.decode(g).decode() for g in own.encode_all(texts)] == texts


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_library_on_any_text(text):
    own = byte_bpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    assert next(own.encode_all([text])).tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("span", [1, 7, 100])
def test_parts_of_long_texts_change_nothing(own, theirs, monkeypatch, span):
    monkeypatch.setattr(byte_bpe, "SPAN", span)
    assert [g.tolist() for g in own.encode_all(TRICKY)] == [theirs(t) for t in TRICKY]


def test_a_text_of_five_megabytes(own):
    text = "the quick foxx 123\n" * 260_000
    ids = next(own.encode_all([text]))
    assert own.decode(ids).decode() == text


def test_forgetting_changes_nothing(own, theirs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 2)
    texts = ["zqxj vkwq", "pqzx zqxj", "vkwq"] * 3
    for t in texts:
        assert next(own.encode_all([t])).tolist() == theirs(t)


def test_merges_take_the_least_rank_then_the_left_one(own):
    def slow(piece):
        parts = [bytes([b]) for b in piece]
        while pairs := [(own.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in own.ranks]:
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [own.ranks[p] for p in parts]

    rng = random.Random(2)
    for _ in range(500):
        piece = bytes(rng.choice(b"abcdeinrst ") for _ in range(rng.randint(1, 25)))
        assert own.merge(piece) == slow(piece)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    assert sorted(byte_bpe.PerfectHash(keys)(keys)) == list(range(n))


def test_equal_hashes_dont_deceive(own, monkeypatch):
    """Bytes decide: with a hash that knows lengths alone, nothing else is taken for an entry."""
    piece = b" the"
    real = byte_bpe.word_hashes
    target = real(np.frombuffer(piece, np.uint8), np.array([0]), np.array([4]), byte_bpe._VALUES)[0]
    monkeypatch.setattr(byte_bpe, "word_hashes", lambda data, starts, ends, values: np.full(len(starts), target))
    assert next(own.encode_all([" xqz the"])).tolist() == [*own.merge(b" xqz"), own.ranks[piece]]


def test_rows_and_clashing_columns(spark):
    rows = [(1, "a b", 5, "x"), (None, None, 6, "y"), (1, "a b", 7, "z"), (2, "", 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_tokens int, ids string")
    out = byte_bpe.encode(docs, RANKS)
    assert out.columns == ["doc_id", "N_tokens", "ids", "_n_tokens", "_ids"]
    got = sorted((r.N_tokens, r.ids, r._n_tokens, bytes(byte_bpe.load_ranks(RANKS).decode(np.frombuffer(r._ids, "<u4")))) for r in out.collect())
    assert got == [(5, "x", 2, b"a b"), (6, "y", 0, b""), (7, "z", 2, b"a b"), (8, None, 0, b"")]
    back = byte_bpe.decode(out, RANKS, "_ids")
    assert sorted((r.N_tokens, bytes(r.decoded)) for r in back.collect()) == [(5, b"a b"), (6, b""), (7, b"a b"), (8, b"")]
    assert byte_bpe.encode(docs.limit(0), RANKS).count() == 0


def test_the_query_equals_the_library(spark, sf_dir, theirs):
    for r in byte_bpe.op12_byte_bpe(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        ids = theirs(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
