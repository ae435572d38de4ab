"""Every operator on documents of about five megabytes: words, one word, short lines and one line."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from ledgerlark.llm import licenses, near_documents, near_lines, packing, quality, repeats, sharding, toxicity
from tests.llm.test_operators import brute_features, docs, words

SIZE = 5_000_000


@pytest.fixture(scope="module")
def prose():
    """Words of which no long run repeats."""
    draws = np.random.default_rng(5).integers(0, 50_000, SIZE // 6)
    return " ".join(f"w{k}" for k in draws)[:SIZE]


@pytest.fixture(scope="module")
def texts(prose):
    middle = prose.index(" ", SIZE // 2)
    return [prose, prose[:middle] + " other" + prose[middle:], "x" * SIZE, "ab\n" * (SIZE // 3), "\n" * SIZE, "short", None]


def test_license_at_the_end(spark, prose):
    rows = licenses.scan_licenses(docs(spark, [prose + " Released under the MIT License.", "x" * SIZE])).collect()
    assert {r.doc_id: r.licenses for r in rows} == {0: "MIT", 1: ""}


def test_repeats(spark, prose):
    passage = "The passage: " + hashlib.sha512(b"passage").hexdigest() * 2
    rows = repeats.remove_repeats(docs(spark, [f"{prose}<{passage}>", f"[{passage}]", "x" * SIZE])).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    digest = lambda kept: hashlib.sha256(kept.encode()).hexdigest()
    assert got == {
        0: (SIZE + 2 + len(passage), len(passage), 1, digest(prose + "<>")), 1: (2 + len(passage), len(passage), 1, digest("[]")),
        2: (SIZE, SIZE, 1, digest("")),
    }


@pytest.mark.parametrize("size", [2, 5])
def test_near_copies(spark, texts, size):
    rows = {r.doc_id: r for r in near_documents.near_duplicates(docs(spark, texts), size).collect()}
    for k, text in enumerate(texts):
        w = words(text)
        shingles = {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()
        assert rows[k].n_shingles == len(shingles)
        assert rows[k].component_id == (0 if k == 1 else k)


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    kept = texts[1:4] + texts[5:]
    rows = packing.pack(docs(spark, kept), path).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    encoder = Tokenizer.from_file(path)
    for k, text in enumerate(kept):
        at = 0
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for start, length, crc, n in sorted(pieces[k]):
            assert start == at and n == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)


def test_toxicity(spark, prose):
    bad = [f"w{k} w{k + 1} grumbus w{k + 2}" for k in range(60)]
    good = [f"w{k} w{k + 1} w{k + 2}" for k in range(100, 200)]
    labels = spark.createDataFrame([(k, None, int(k < 60)) for k in range(160)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs(spark, [*bad, *good, prose, "x" * SIZE, "ab\n" * (SIZE // 3)]), labels).collect()}
    assert len(rows) == 163 and all(rows[k].predicted == int(k < 60) for k in rows)


def test_lines(spark, texts):
    rows = {r.doc_id: r for r in near_lines.dedup_lines(docs(spark, texts)).collect()}
    assert rows[0].text == texts[0] and rows[3].text.split() == ["ab"] and rows[6].text is None
    assert not rows[1].text and rows[2].text == texts[2]


def test_shards(spark, texts):
    rows = {r.doc_id: r for r in sharding.assign_shards(docs(spark, texts), [1.0] * 4).collect()}
    assert [(rows[k].size, rows[k].text_crc32) for k in range(7)] == [(len(t or "") + 1, zlib.crc32((t or "").encode())) for t in texts]


def test_quality(spark, texts):
    for r in quality.judge(docs(spark, texts)).select("doc_id", "_f", "_kept").collect():
        assert (r["_f"].n_words, r["_f"].word_chars, r["_f"].n_symbols, r["_f"].n_dup_lines, r["_f"].n_repeat_words) == brute_features(texts[r.doc_id])
