"""The pipeline's stages against brute force on a small table, and its edge cases."""

import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlark.llm import quality

STAGES = dict(corpus_pipeline.STAGES)
#: Names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t1 long, component long, key string, h int, _row int, t1 long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, "k", 3, 4, 5) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def components(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(n)]


def jaccard(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def cut_lines(texts):
    """Each line but the first of its near-equal ones goes, in order of document and place."""
    places = [(d, k, x) for d, t in texts.items() for k, line in enumerate((t or "").split("\n")) if (x := line.strip(" \t\r\x0b\x0c").lower())]
    distinct = list(dict.fromkeys(x for _, _, x in places))
    sets = [{x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in distinct]
    group = dict(zip(distinct, components(len(distinct), lambda i, j: jaccard(sets[i], sets[j])), strict=True))
    first, gone = {}, set()
    for d, k, x in sorted(places):
        if group[x] in first:
            gone.add((d, k))
        first.setdefault(group[x], (d, k))
    return {d: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in texts.items()}


def one_of_each(texts):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for d, t in texts.items()}
    ids = sorted(texts)
    sets = [set(zip(*(words[d][k:] for k in range(5)), strict=False)) if len(words[d]) >= 5 else {tuple(words[d])} - {()} for d in ids]
    found = components(len(ids), lambda i, j: jaccard(sets[i], sets[j]))
    return {d: texts[d] for k, d in enumerate(ids) if found[k] == k}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def clean(texts, items):
    out = {}
    for d, t in texts.items():
        words, hit = item_words(t), set()
        for item in map(item_words, items):
            n = min(13, len(item))
            windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
            for k in range(len(words) - n + 1) if n else ():
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(words)):
            out[d] = t
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Some prose, near copies, shared and edited lines, benchmark passages and junk, with a benchmark beside it."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("aeiounrstlmdbk"), rng.integers(3, 9))) for _ in range(600)]

    def prose(n):
        sentences = [" ".join(rng.choice(vocabulary, 12)).capitalize() + "." for _ in range(n)]
        return "\n".join(" ".join(sentences[k : k + 3]) for k in range(0, n, 3))

    items = [" ".join(rng.choice(vocabulary, 30)) for _ in range(4)] + ["two words", None, ""]
    footer = "Read our other stories on this site and tell your friends about them"
    texts = [prose(24) for _ in range(24)]
    texts += [t.replace(t.split()[5], "changed", 1) for t in texts[:6]] + texts[6:9]
    # the same words in other lines, which line dedup leaves alone
    texts += ["\n".join(" ".join(w[k : k + 17]) for k in range(0, len(w), 17)) for w in (t.split() for t in texts[9:12])]
    texts += [f"{prose(18)}\n{footer}" for _ in range(4)] + [f"{prose(18)}\n{footer.replace('friends', 'friend')}"]
    texts += [f"{prose(12)}\n{i}" for i in items[:3]] + [f"{prose(120)}\n{' '.join(items[3].split()[:14])}", f"{prose(15)} Two Words"]
    texts += [None, "", "   ", "short text", "# $ % " * 60, "again and again and " * 60]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(str(k), t) for k, t in enumerate(items)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, texts, items


def test_every_stage_equals_brute_force(spark, corpus):
    at, texts, items = corpus
    docs = frame(spark, texts)
    columns, state = docs.columns, dict(enumerate(texts))
    kept = STAGES["quality_rules"](spark, docs, at)
    verdict = {r.doc_id: r["_kept"] for r in quality.judge(docs).select("doc_id", "_kept").collect()}
    state = {d: t for d, t in state.items() if verdict[d]}
    assert 30 < len(state) < len(texts) and all(len((t or "").split()) >= 50 for t in state.values())
    docs = check(kept, columns, state)
    state = cut_lines(state)
    docs = check(STAGES["line_dedup"](spark, docs, at), columns, state)
    before, state = state, one_of_each(state)
    docs = check(STAGES["near_dedup"](spark, docs, at), columns, state)
    assert len(state) < len(before)
    before, state = state, clean(state, items)
    docs = check(STAGES["decontamination"](spark, docs, at), columns, state)
    assert 0 < len(before) - len(state) < 8
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    pieces = STAGES["packing"](spark, docs, at).collect()
    for d, t in state.items():
        own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        total = len(encode(t or "", add_special_tokens=False).ids) + 1
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) == total
    assert {p.doc_id for p in pieces} == set(state)


def check(out, columns, state):
    assert out.columns == columns
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == state and len(rows) == len(state)
    assert {(r["_t1"], r.component, r.key, r.h, r["_row"], r.t1) for r in rows} <= {(1, 2, "k", 3, 4, 5)}
    return out.sparkSession.createDataFrame([tuple(r) for r in rows], out.schema).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, corpus, name):
    out = STAGES[name](spark, frame(spark, ["x"]).limit(0), corpus[0])
    assert out.count() == 0
    if name != "packing":
        assert out.columns == frame(spark, ["x"]).columns


@pytest.mark.parametrize("name", ["line_dedup", "near_dedup", "decontamination"])
def test_stages_of_rows_without_ids_and_repeated_rows(spark, corpus, name):
    docs = frame(spark, ["one two three four five six", "one two three four five six", None, "seven eight nine ten eleven twelve"])
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") < 3, F.lit(None)).otherwise(F.col("doc_id")))
    out = STAGES[name](spark, docs.unionByName(docs), corpus[0])
    assert out.columns == docs.columns and out.filter("doc_id IS NULL").count() == 6


def test_the_run_chains_the_stages(spark, corpus, tmp_path):
    at, texts, _ = corpus
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept
