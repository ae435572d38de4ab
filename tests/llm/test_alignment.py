"""Cross-tokenizer alignment against a brute force that walks byte by byte, and its edge cases."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerlark.llm import alignment

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(x): x for x in letters} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in letters)}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return a, b, lambda i: bytes(table[c] for c in a.id_to_token(i)), bytes_b


def brute(texts, tokenizers):
    a, b, bytes_a, bytes_b = tokenizers
    rows, all_links = [], []
    for text in texts:
        links, groups = [], []
        if text:
            ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            data = f" {text}".encode()
            if b"".join(map(bytes_a, ids_a)) == data == b"".join(map(bytes_b, ids_b)):
                ends = [{}, {}]
                for k, (ids, of) in enumerate(((ids_a, bytes_a), (ids_b, bytes_b))):
                    end = 0
                    for i in ids:
                        end += len(of(i))
                        ends[k][end] = i
                both = sorted(set(ends[0]) & set(ends[1]))
                links = [(ends[0][e], ends[1][e]) for e in both]
                for low, high in zip([0, *both], both, strict=False):
                    groups.append("|".join(",".join(str(i) for e, i in side.items() if low < e <= high) for side in ends))
                rows.append((len(ids_a), len(ids_b), groups, links))
            else:
                rows.append((0, 0, [], []))
        else:
            rows.append((0, 0, [], []))
        all_links += rows[-1][3]
    counts, most = collections.Counter(all_links), collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (n_a, n_b, len(g), len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "")
        for n_a, n_b, g, k in rows
    ]


TEXTS = [
    None, "", " ", "a", "the cat  sat\n\n\ton  the mat. ", "don't it's", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "é😀 ñ中文字 \x00 ﬁ",
    "antidisestablishmentarianism 12345", "x" * 3000, " " * 2500, "the cat sat", "the cat sat", " 　 \x85", "qzx " * 500,
]


def found(df):
    return {r.row: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect()}


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_equals_brute_force(spark, tokenizers, monkeypatch, most):
    monkeypatch.setattr(alignment, "GROUP_BYTES", most)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "row int, text string").repartition(4)
    aligned = alignment.align(docs, A, B)
    got = found(alignment.link_statistics(aligned, alignment.pair_counts(aligned)))
    want = brute(TEXTS, tokenizers)
    hashed = [(*got[i][:6], hashlib.sha256(got[i][6].encode()).hexdigest() if got[i][0] else "") for i in range(len(TEXTS))]
    assert hashed == want
    assert all(got[i][6] == "" for i in range(len(TEXTS)) if not got[i][0])


def test_the_query_equals_brute_force(spark, sf_dir, tokenizers):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in docs), brute([r.text for r in docs], tokenizers), strict=True))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = alignment.op11_cross_tokenizer_alignment(spark, sf_dir)
    assert out.columns == columns
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == want


def test_a_group_of_a_known_text(spark):
    docs = spark.createDataFrame([("the",)], "text string")
    row = alignment.align(docs, A, B).first()
    a, b = 262, sentencepiece.SentencePieceProcessor(model_file=B).piece_to_id("▁the")
    assert (row.n_a, row.n_b, row.groups) == (1, 1, f"{a}|{b}")
    assert [divmod(p, alignment.FACTOR) for p in row.pairs] == [(a, b)]


def test_clashing_columns_repeated_and_null_ids_and_no_rows(spark):
    rows = [(None, "the cat", "x", 1), (7, "the cat", "y", 2), (7, None, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Groups string, n_best int")
    aligned = alignment.align(docs, A, B)
    assert aligned.columns[:5] == ["doc_id", "Groups", "n_best", "n_a", "n_b"] and "_groups" in aligned.columns
    out = alignment.link_statistics(aligned, alignment.pair_counts(aligned)).collect()
    assert sorted((r.Groups, r.doc_id, r.n_best, r._n_best, r.count_sum) for r in out) == [("x", None, 1, 2, 4), ("y", 7, 2, 2, 4), ("z", 7, 3, 0, 0)]
    empty = alignment.align(docs.limit(0), A, B)
    assert alignment.link_statistics(empty, alignment.pair_counts(empty)).count() == 0


def test_a_text_of_five_megabytes():
    text = "the quick foxx 123\n" * 260_000
    out = alignment.align_texts([text, "a"], alignment.byte_level(A), alignment.pieces(B))
    assert out["n_links"][0].as_py() == sum(out["times"][0].as_py()) > 1_000_000


def test_one_token_of_a_pair_ends_with_the_other():
    a, b = alignment.byte_level(A), alignment.pieces(B)
    out = alignment.align_texts(["Encodings of words, 1984 – naïve façades"], a, b)
    for pair in out["pairs"][0].as_py():
        x, y = a.bytes_of(np.array([pair // alignment.FACTOR])), b.bytes_of(np.array([pair % alignment.FACTOR]))
        assert x.endswith(y) or y.endswith(x)
