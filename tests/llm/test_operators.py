"""The operators against brute force, and their edge cases: nulls, empties, ties, repeats, clashing columns."""

import collections
import hashlib
import math
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import (
    common, decontamination, licenses, near, near_documents, near_lines, packing, pages, quality, repeats, sharding, toxicity,
)

#: Columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, w long, removed long, key long, shard int, h string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 4, "c") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


EDGES = [None, "", "  \n\t", "word", "word", "a\nb\na", "x" * 5000, "é 😀 ñ", "word"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lorem(n, seed, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


# repeats

def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("often", [512, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(repeats, "OFTEN", often)
    base = lorem(300, 1)
    texts = [
        *EDGES, base, base[100:700] + lorem(50, 2), lorem(40, 3) + base[300:600] + lorem(20, 4), base[:199], base[:200],
        lorem(30, 5) + base[900:1150], "ab" * 400, "é" * 300, lorem(100, 6) + "é" * 120,
    ]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def repeats_of(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs(spark, texts)).collect()}
    return [got[i] for i in range(len(texts))]


def noise(n, rng):
    return rng.integers(33, 127, n, dtype=np.uint8).tobytes().decode()


@pytest.mark.parametrize("same", [150, 199])
def test_repeats_where_no_window_repeats(spark, same):
    """Anchors repeat and no window does: buckets answer nothing, alone or beside ones that answer."""
    rng = np.random.default_rng(same)
    common = noise(same, rng)
    texts = [noise(150, rng) + common + noise(150, rng) for _ in range(4)]
    assert repeats_of(spark, texts) == brute_repeats(texts)
    texts += [noise(300, rng)] * 3
    assert repeats_of(spark, texts) == brute_repeats(texts)


@pytest.mark.parametrize("often", [20, 100_000])
def test_repeats_of_many_texts_around_a_short_boilerplate(spark, monkeypatch, often):
    """190 common bytes in random text: not a window long, however many share it."""
    monkeypatch.setattr(repeats, "OFTEN", often)
    rng = np.random.default_rng(4)
    common = noise(190, rng)
    texts = [noise(120, rng) + common + noise(120, rng) for _ in range(3000)]
    # some share what follows, some what goes before
    texts += [t[:100] + common + noise(60, rng) for t in texts[:5]] + [noise(60, rng) + t[110:] for t in texts[5:9]] + texts[9:12]
    start = time.monotonic()
    assert repeats_of(spark, texts) == brute_repeats(texts)
    assert time.monotonic() - start < 120


def test_windows_by_distance_equal_pairwise(monkeypatch):
    rng = np.random.default_rng(9)
    for size in (2, 5, 30):
        group = []
        for _ in range(size):
            suffix = b"a" * int(rng.integers(48, 190)) + bytes(rng.integers(97, 99, 10, dtype=np.uint8))
            before = bytes(rng.integers(97, 99, 4, dtype=np.uint8)) + b"b" * int(rng.integers(0, 140))
            if len(suffix) + len(before) >= 200:
                group.append((suffix[:200], before, bool(rng.random() < 0.1)))
        group.sort()
        shares = [0] + [repeats.shared_prefix(a[0], b[0]) for a, b in zip(group, group[1:], strict=False)]
        rows = [(s, *g) for s, g in zip(shares, group, strict=True)]
        monkeypatch.setattr(repeats, "FEW", 10**9)
        assert repeats.windows_by_distance(rows) == repeats.repeated_windows(rows) if rows else True


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(docs(spark, ["x"]).limit(0)).count() == 0


def test_chunks_lie_in_small_row_groups(spark, monkeypatch, tmp_path):
    texts = [f"{lorem(2000, i)} {lorem(2000, 100 + i // 2)}" for i in range(40)]
    monkeypatch.setattr(common, "GROUP_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(repeats, "chunks_of", lambda documents, made=repeats.chunks_of: made(documents.coalesce(1), 1 << 14))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)
    for name in ("chunks", "runs"):
        files = [pq.ParquetFile(f).metadata for f in tmp_path.glob(f"{name}-*/*.parquet")]
        # a row that is longer has a group of its own
        groups = [f.row_group(k) for f in files for k in range(f.num_row_groups)]
        assert groups and all(g.num_rows == 1 or g.total_byte_size < 1 << 18 for g in groups), name


def test_front_coding_and_merge():
    runs = [sorted(hashlib.md5(f"{r}{k % 7}".encode()).digest()[: k % 5 + 1] * 3 for k in range(40)) for r in range(5)]
    blobs = [repeats.front_code([(e, s, b"before", e % 2 == 0) for e, s in enumerate(run)]) for run in runs]
    merged = list(repeats.merge_runs([repeats.read_run(b) for b in blobs]))
    suffixes = [item[1] for _, _, item in merged]
    assert suffixes == sorted(s for run in runs for s in run)
    assert [shared for shared, _, _ in merged[1:]] == [repeats.shared_prefix(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False)]


# near documents

def brute_components(texts, size, percent):
    sets = [near_documents.shingles_of(near_documents.words_of((t or "").encode()), size) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_documents_equal_brute_force(spark, size):
    rng = np.random.default_rng(3)
    texts = list(EDGES)
    for k in range(6):
        base = lorem(120, k).split()
        for edits in (0, 1, 3, 6, 9, 12):
            copy = list(base)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = f"z{rng.integers(10**6)}"
            texts.append(" ".join(copy).upper() if edits == 1 else " ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_documents.near_duplicates(docs(spark, texts), size).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, size, 80)


def test_near_documents_with_null_ids_and_repeats(spark):
    got = near_documents.near_duplicates(docs(spark, ["a b c", "a b c", "a b c", None], [5, 5, None, 7])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [
        (False, 5, 5, True), (False, 5, 5, True), (False, 7, 7, True),
    ]
    assert [r.kept for r in got if r.doc_id is None] == [True]


def test_rows_of_one_id_with_other_texts(spark):
    """What is linked with one of a doc_id's texts is linked with the doc_id; rows stay apart otherwise."""
    a, b = lorem(80, 50), lorem(80, 51)
    other = b.split()
    other[40] = "edited"
    frame = docs(spark, [a, b, " ".join(other), a, a], [5, 5, 6, 9, 5])
    got = {(r.doc_id, r.component_id, r.kept) for r in near_documents.near_duplicates(frame).collect()}
    assert got == {(5, 5, True), (6, 5, False), (9, 5, False)}
    assert [r.doc_id for r in near_documents.one_of_each(frame).collect()] == [5]
    assert near_documents.one_of_each(frame).columns == frame.columns


def test_near_documents_with_a_common_body_equal_brute_force(spark):
    """Hundreds of texts that share most of their words crowd the same bands."""
    rng = np.random.default_rng(8)
    base = lorem(150, 60, 5000).split()
    texts = []
    for _ in range(300):
        copy = list(base)
        for at in rng.choice(len(copy), int(rng.integers(2, 14)), replace=False):
            copy[at] = f"z{rng.integers(10**6)}"
        texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_documents.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 2, 80)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, k) for k in range(101, 140)] + [(300, 250), (250, 300), (7, 7)]
    got = {r.id: r.component for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 140)} | {250: 250, 300: 250}


def test_pipeline_keeps_documents_that_differ_in_a_word(spark):
    import corpus_pipeline

    base = lorem(30, 5).split()
    texts = [" ".join(base), " ".join([*base[:15], "edited", *base[16:]]), " ".join(base)]
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1]


def test_routing_holds_little_more_than_its_rows():
    rng = np.random.default_rng(5)
    rows = 4096
    parts = ((rng.integers(0, 1 << 40, rows), rng.integers(-1 << 62, 1 << 62, (rows, 16))) for _ in range(near.HELD_ROWS // (16 * rows)))
    tracemalloc.start()
    sent = sum(b.num_rows for b in near.route(parts, 64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == 64 and peak < 4 * 16 * near.HELD_ROWS


# lines

def test_lines_equal_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and then runs far away into the deep dark forest at night"
    texts = [None, "", base, base.upper() + "\nshort\n\nother line here", "short\n" + base.replace("quick", "quack"), lorem(30, 1), "short\n  SHORT  "]
    got = {r.doc_id: list(r.removed) for r in near_lines.removed_lines(docs(spark, texts)).collect()}
    assert got == {2: [], 3: [0], 4: [0, 1], 5: [], 6: [0, 1]}
    kept = {r.doc_id: r.text for r in near_lines.dedup_lines(docs(spark, texts)).collect()}
    assert kept[3] == "short\n\nother line here" and kept[4] == "" and kept[0] is None and kept[2] == base
    assert near_lines.dedup_lines(docs(spark, texts)).columns == docs(spark, texts).columns
    assert near_lines.removed_lines(docs(spark, ["x"]).limit(0)).count() == 0


def test_lines_of_one_id_with_other_texts(spark):
    frame = docs(spark, ["shared line of both texts\nonly in A", "other text B\nprecious line of B only", "shared line of both texts"], [2, 2, 3])
    got = sorted((r.doc_id, r.text) for r in near_lines.dedup_lines(frame).collect())
    assert got == [(2, "other text B\nprecious line of B only"), (2, "shared line of both texts\nonly in A"), (3, "")]


def test_edited_copies_equal_brute_force(spark):
    """Edited copies of one line crowd the same buckets; all that are similar are linked."""
    rng = np.random.default_rng(7)
    base = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 90))
    texts = []
    for _ in range(3000):
        x = list(base)
        for at in rng.choice(len(base), rng.integers(2, 6), replace=False):
            x[at] = str(rng.integers(10))
        texts.append("".join(x))
    sets = [{t[k : k + 8] for k in range(len(t) - 7)} for t in texts]
    place = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    columns = np.array([place[x] for s in sets for x in s])
    has = np.zeros((len(texts), len(place)), np.float32)
    has[rows, columns] = 1
    both, n = has @ has.T, has.sum(1)
    alike = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    first = np.arange(len(texts))
    while not np.array_equal(first, nxt := np.where(alike, first[None, :], len(texts)).min(1)):
        first = nxt
    got = {r.doc_id for r in near_lines.removed_lines(docs(spark, texts)).filter("n_removed > 0").collect()}
    assert got == set(np.flatnonzero(first != np.arange(len(texts))).tolist())


def test_places_of_lines_are_sent_in_runs(spark):
    """A line costs no row of its own: there is one for each document and one for each bucket that a task has lines of."""
    texts = ["\n".join(f"line {k} of {d}, or not" for k in range(2000)) + "\nshared\nshared" for d in range(3)]
    scan = near_lines.scanned(docs(spark, texts).coalesce(1), 16).collect()
    assert len(scan) <= 3 + 16
    rows = sorted((r.doc_id, r.n_lines, list(r.removed)) for r in scan if r.bucket is None)
    assert rows == [(0, 2002, [2001]), (1, 2002, [2000, 2001]), (2, 2002, [2000, 2001])]
    assert sum(len(r.lines) for r in scan if r.lines) == 8 * len(near_lines._FIRST) * (6000 + 1)


@pytest.mark.parametrize("listed", [near.LISTED, 1])
def test_pairs_by_bucket_and_by_join_equal_brute_force(spark, listed):
    """Sets that share a shingle meet in runs of longs; those of busy shingles are joined."""
    rng = np.random.default_rng(4)
    sets = []
    for k in range(12):
        base = rng.integers(1 << 60, size=40, dtype=np.uint64)
        for edits in (0, 1, 2, 4, 6, 9):
            x = base.copy()
            x[rng.choice(40, edits, replace=False)] = rng.integers(1 << 60, size=edits, dtype=np.uint64)
            sets.append(np.unique(x))
    frame = spark.createDataFrame([(i, i // 2, bytearray(x.tobytes())) for i, x in enumerate(sets)], "id long, component long, data binary")
    read = lambda data: [np.frombuffer(x, np.uint64) for x in data]
    found = {(r.a, r.b) for r in near.joined(frame.repartition(3), read, 80, listed).collect()}
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if i // 2 != j // 2 and near.alike(sets[i], sets[j], 80)}
    assert alike and alike <= found and len(found) < 3 * len(alike)


# decontamination

def test_decontamination_edges(spark):
    item = lorem(20, 9)
    tests = spark.createDataFrame([("1", item), ("10", item), ("2", "short one"), ("3", None), ("4", "..."), (None, item)], "item_id string, text string")
    w = item.split()
    texts = [*EDGES, "A SHORT-one here", " ".join(w[:12]), "x " + " ".join(w[3:16]).upper() + " y", " ".join(w) + " " + lorem(600, 1)]
    for block in (decontamination.BLOCK_BYTES, 60):
        got = {r.doc_id: r for r in decontamination.contamination(docs(spark, texts), tests, block_bytes=block).collect()}
        n = len(EDGES)
        assert [(got[i].n_hit, got[i].n_items, got[i].contaminated) for i in range(n, n + 4)] == [
            (2, 1, True), (0, 0, False), (13, 3, True), (20, 3, False),
        ]
        assert got[n + 2].items_sha256 == hashlib.sha256(b"1,10").hexdigest()
        assert got[0].n_words == 0 and got[0].items_sha256 == hashlib.sha256(b"").hexdigest()
    kept = decontamination.decontaminate(docs(spark, texts), tests)
    assert kept.count() == len(texts) - 2 and kept.columns == docs(spark, texts).columns
    assert decontamination.contamination(docs(spark, texts), tests.limit(0)).filter("contaminated").count() == 0


def test_contamination_asks_python_once_for_a_task(spark):
    tests = spark.createDataFrame([("a", lorem(20, 1))], "item_id string, text string")
    for found in (decontamination.contamination(docs(spark, EDGES), tests), decontamination.decontaminate(docs(spark, EDGES), tests)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_contaminated_rows_without_ids_take_no_others_along(spark):
    item = lorem(14, 9)
    tests = spark.createDataFrame([("1", item), ("2", lorem(14, 10))], "item_id string, text string")
    frame = docs(spark, [item, "four clean words here", f"{item} {lorem(14, 10)}", "x y"], [None, None, 3, 3])
    for block in (decontamination.BLOCK_BYTES, 40):
        got = sorted((r.n_words, r.contaminated, r.longest_match) for r in decontamination.contamination(frame, tests, block_bytes=block).collect())
        assert got == [(2, False, 0), (4, False, 0), (14, True, 14), (28, True, 14)]
    assert sorted(r.text for r in decontamination.decontaminate(frame, tests).collect()) == ["four clean words here", "x y"]


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 40])
def test_items_without_an_id_hit_like_others(spark, block):
    one, two = lorem(14, 9), lorem(14, 10)
    tests = spark.createDataFrame([(None, one), (None, two), ("7", two)], "item_id string, text string")
    got = {r.doc_id: r for r in decontamination.contamination(docs(spark, [one, f"{one} {two}", "clean words"]), tests, block_bytes=block).collect()}
    assert [(got[i].n_hit, got[i].n_items, got[i].contaminated) for i in range(3)] == [(14, 1, True), (28, 2, True), (0, 0, False)]
    assert got[0].items_sha256 == hashlib.sha256(b"").hexdigest() and got[1].items_sha256 == hashlib.sha256(b"7").hexdigest()


def test_a_document_of_five_megabytes_is_searched_whole(spark):
    item = lorem(14, 9)
    tests = spark.createDataFrame([("7", item)], "item_id string, text string")
    row = decontamination.contamination(docs(spark, ["word " * 1_000_000 + item]), tests).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (1_000_014, 14, False)


# packing

def test_long_white_space(vocabulary):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(vocabulary), packing.load_encoder(vocabulary)
    for text in (" " * 1_000_000, "a" + "\n" * 5000 + "b  c"):
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("fan_in", [64, 2])
def test_packing_round_trip(spark, vocabulary, fan_in):
    from tokenizers import Tokenizer

    texts = [*EDGES, "a <|endoftext|> b", *(lorem(n, n) for n in (5, 90, 400, 700, 3000))]
    slow = Tokenizer.from_file(vocabulary)
    rows = packing.pack(docs(spark, texts).repartition(5), vocabulary, fan_in=fan_in).collect()
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    total = 0
    for i, text in enumerate(texts):
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for held in windows.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    assert len(windows) == math.ceil(total / packing.WINDOW)
    assert packing.pack(docs(spark, ["x"]).limit(0), vocabulary).count() == 0


# pages

def test_pages(spark):
    article = "<html><head><title>T</title></head><body><nav>M</nav><article><h1>Head</h1><p>One &amp; <b>two\n three</b><p>Four<br>five</article><footer>F</footer>"
    plain = "<body><div>Site name</div><p>{0}</p><div class='cookie-notice'>C</div><form>x</form><p>All rights of the site</p><div id=comments><p>nice</p></div></body>"
    rows = [
        (1, "http://a.example/x/1", article), (2, "http://b.example/x/1", plain.format("first text")), (3, "https://www.b.example/x/2#top", plain.format("second text")),
        (4, "http://b.example/x/2", plain.format("second text")), (5, None, None), (6, "http://c.example/", "<p>only < 3 & this</p><script>var t='</p>';</script><!-- gone"), (7, "u", ""),
    ]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, shared string")
    got = {r.page_id: r.text for r in pages.main_text(frame).collect()}
    assert got == {1: "Head\nOne & two three\nFour five", 2: "first text", 3: "second text", 4: "second text", 5: "", 6: "only < 3 & this", 7: ""}
    assert pages.main_text(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["comments-area", "comment-list", "user-comments", "ad-slot", "share-buttons", "cookie-box", "reader-comments section"])
def test_boxes_in_an_article_that_arent_its_text(name):
    page = f"<article><p>Text</p><div class='{name}'><p>Nice</p><ol><li>First!</li></ol></div><p>More</p></article>"
    assert pages.extract(page, set()) == "Text\nMore"


@pytest.mark.parametrize("name", ["notice-board", "social-history", "related-work", "share-price", "page-content"])
def test_names_that_say_something_else_delete_nothing(name):
    for page in ("<div class='{0}'><p>The text</p></div>", "<article><div id='{0}'><p>The text</p></div></article>"):
        assert pages.extract(page.format(name), set()) == "The text"


def test_open_tags_cost_no_more_than_their_number():
    took = []
    for n in (4000, 16000):
        start = time.monotonic()
        assert len(pages.blocks_of("<b>" * n + "<li>a</li>" * n)) == n
        took.append(time.monotonic() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_a_page_of_five_megabytes():
    page = "<article>" + "<p>Some &amp; words<ul><li>one<li>two</ul>" * 120_000 + "</article>"
    assert pages.extract(page, set()).count("\n") == 359_999


def test_differencing_decides_what_markup_leaves_open(spark, monkeypatch):
    page = "<article><h1>{0}</h1><div>Follow the paper</div><p>Own words of {0}</p><p>Said by both</p><div class=related-work>Work {0}</div></article>"
    rows = [(k, f"http://a.example/{k}", page.format(f"page {k}")) for k in range(4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(frame).collect()}
    assert got == {k: f"page {k}\nOwn words of page {k}\nSaid by both\nWork page {k}" for k in range(4)}
    monkeypatch.setattr(pages, "shared_lines", lambda blocks: blocks.select("page_id", F.array().cast("array<long>").alias("shared")))
    assert all("Follow the paper" in r.text for r in pages.main_text(frame).collect())


def brute_shared(rows):
    """Runs of pages, by host, against the runs beside them."""
    runs = []
    for page, url, html in sorted(rows, key=lambda r: (*pages._place(r[1]), r[0])):
        mine = (pages._place(url)[0], [pages.line_hash(t) for t, _ in pages.blocks_of(html)])
        if not runs or runs[-1][0] != mine:
            runs.append((mine, []))
        runs[-1][1].append(page)
    out = {}
    for k, ((host, lines), ids) in enumerate(runs):
        found = set()
        if k and runs[k - 1][0][0] == host:
            found |= set(pages.common_lines(runs[k - 1][0][1], lines))
        if k + 1 < len(runs) and runs[k + 1][0][0] == host:
            found |= set(pages.common_lines(lines, runs[k + 1][0][1]))
        out |= {p: found for p in ids if found}
    return out


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_neighbours_do_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for host in "abc":
        for _ in range(30):
            html = "".join(f"<p>line {x}</p>" for x in rng.integers(0, 8, rng.integers(1, 5)))
            for _ in range(int(rng.choice([1, 1, 1, 2, 9]))):
                rows.append((k, f"http://{host}.example/{k:04d}", html))
                k += 1
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.page_id: set(r.shared) for r in pages.shared_lines(pages.parsed(frame)).collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == brute_shared(rows)


def test_pages_with_broken_markup_take_little_time():
    import time

    def took(page):
        start = time.perf_counter()
        pages.blocks_of(page)
        return time.perf_counter() - start

    for bad in ("<a ", "<div>", "<div></p>", "<!x", "<p><b>", "<script>"):
        assert took(bad * 40000) < 5, bad
    assert took("<div>" * 40000 + "</p>" * 40000) < 5


def test_comments_and_asides_are_no_main_text():
    page = "<main><p>Own</p><aside><article><p>Other</p></article></aside><ol class=comments><li><article><p>Nice</p></article></ol><p class='ad-hoc'>More</p></main>"
    assert pages.extract(page, set()) == "Own\nMore"


def test_common_lines_is_a_longest_one():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (rng.integers(0, 6, rng.integers(0, 12)).tolist() for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = pages.common_lines(a, b)
        assert len(got) == best[-1][-1]
        for side in (a, b):
            rest = iter(side)
            assert all(x in rest for x in got)


# toxicity

def test_levenshtein_walk():
    lexicon = toxicity.Lexicon({"stupid": 2.0, "lowei*": 3.0, "scum": 1.0})
    for word in ("stupd", "stupiid", "stupyd", "tupid", "stupids"):
        assert lexicon.look_up(word) == (2.0, False), word
    assert lexicon.look_up("stupid") == (2.0, True) and lexicon.look_up("loweianything") == (3.0, True)
    assert lexicon.look_up("stpd") is None and lexicon.look_up("scam") is None and lexicon.look_up("") is None


def test_lexicon_walk_equals_brute_force():
    """Every word against every term by its whole edit distance."""
    rng = np.random.default_rng(5)

    def word():
        return "".join(rng.choice(list("abc"), rng.integers(4, 9)))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    weights = {word() + ("*" if k % 4 == 0 else ""): float(k) for k in range(1, 80)}
    lexicon = toxicity.Lexicon(weights)
    seen = set()
    for _ in range(3000):
        w = word()
        exact = [x for t, x in weights.items() if t == w or (t.endswith("*") and w.startswith(t[:-1]))]
        near_by = [
            x for t, x in weights.items()
            if not t.endswith("*") and len(t) >= toxicity.FUZZY_LENGTH and distance(t, w) <= 1
        ]
        expected = (max(exact), True) if exact else (max(near_by), False) if near_by else None
        assert lexicon.look_up(w) == expected, w
        seen.add(None if expected is None else expected[1])
    assert seen == {None, True, False}


def test_lexicon_keeps_every_telling_term(spark):
    rows = [(i, " ".join(f"bad{k}word" for k in range(i % 40, 2400, 40)), 1) for i in range(400)]
    rows += [(1000 + i, lorem(60, i), 0) for i in range(2000)]
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert {f"bad{k}word" for k in range(2400)} <= set(found)


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon({"stupid": 2.0})
    direct, quoted = lexicon.features("you are stupid and more"), lexicon.features('they wrote "stupid" on it')
    assert direct[0] > 0 and direct[4] == 0
    assert quoted[0] == 0 and quoted[4] > 0


def test_the_training_row_of_a_repeated_id_is_the_same_in_any_order(spark):
    texts = [f"text {k}" for k in range(30)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    found = set()
    for order in (texts, texts[::-1]):
        rows = toxicity.training_rows(docs(spark, order, [1 + k % 2 for k in range(30)] if order is texts else [2 - k % 2 for k in range(30)]).repartition(7), labels)
        found.add(tuple(sorted((r.doc_id, r.text, r.toxic) for r in rows.collect())))
    assert len(found) == 1 and all(toxic == 1 for _, _, toxic in found.pop())


def test_toxicity_learns_and_handles_edges(spark):
    bad = [f"{lorem(20, k)} grumbus {lorem(10, k + 1)}" for k in range(60)]
    good = [lorem(30, 1000 + k) for k in range(140)]
    texts = [*bad, *good, *EDGES]
    labels = spark.createDataFrame([(i, None, int(i < 60)) for i in range(200)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs(spark, texts), labels).collect()}
    assert len(got) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(got[i].predicted == int(i < 60) for i in range(200))
    none = toxicity.score_toxicity(docs(spark, texts), labels.limit(0)).collect()
    assert all(r.score < 0.5 for r in none)
    assert toxicity.score_toxicity(docs(spark, ["x"]).limit(0), labels).count() == 0


# sharding

def test_sharding(spark):
    texts = [*EDGES, *(lorem(5, k) for k in range(300))]
    rows = sharding.assign_shards(docs(spark, texts), [1.0] * 4, slices=8).collect()
    by = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        assert by[i].size == len((t or "").encode()) + 1 and by[i].text_crc32 == zlib.crc32((t or "").encode())
        assert by[i].grown_shard in (by[i].shard, 4)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    more = {r.doc_id: r.shard for r in sharding.assign_shards(docs(spark, texts), [1.0] * 5).collect()}
    assert all(by[i].grown_shard == more[i] for i in by)
    heavy = collections.Counter(r.shard for r in sharding.assign_shards(docs(spark, texts), [1.0, 3.0]).collect())
    assert heavy[1] > 2 * heavy[0]
    assert sharding.assign_shards(docs(spark, ["a", "b"], [None, None]), [1.0] * 2).count() == 2
    with pytest.raises(ValueError):
        sharding.assign_shards(docs(spark, ["a"]), [0.0])


# quality

def brute_features(text):
    text = text or ""
    w = words(text)
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_features_equal_brute_force(spark):
    texts = [*EDGES, "a b c a b c", "a a a a a", "#*|\n#*|\n \n", lorem(200, 1, 5), lorem(300, 2) + "\n" + lorem(300, 2)]
    rows = quality.judge(docs(spark, texts))
    assert set(docs(spark, texts).columns) <= set(rows.columns)
    for r in rows.collect():
        f = r["_f"]
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == brute_features(texts[r.doc_id])
        assert r["_base_failed"] == (f.n_words < 50 or 100 * f.n_repeat_words > 50 * f.n_words)


def brute_posteriors(patterns, iterations):
    """Dawid and Skene's model for two classes, votes counted one by one."""
    w = [{0: 0.9, 1: 0.5}.get(votes.count(-1), 0.1) for votes, _ in patterns]
    for _ in range(iterations):
        good = sum(n * x for (_, n), x in zip(patterns, w, strict=True))
        bad = sum(n * (1 - x) for (_, n), x in zip(patterns, w, strict=True))
        nxt = []
        for votes, _ in patterns:
            odds = (good + 1) / (bad + 1)
            for j, v in enumerate(votes):
                same = [(n, x) for (other, n), x in zip(patterns, w, strict=True) if other[j] == v]
                odds *= (sum(n * x for n, x in same) + 1) / (good + 3) / ((sum(n * (1 - x) for n, x in same) + 1) / (bad + 3))
            nxt.append(odds / (1 + odds))
        w = nxt
    return w


def test_posteriors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rules = len(quality.RULES)
    drawn = {tuple(int(x) for x in rng.choice([-1, 0, 1], rules, p=[0.2, 0.2, 0.6])) for _ in range(40)}
    patterns = sorted((list(v), int(rng.integers(1, 500))) for v in drawn)
    frame = spark.createDataFrame(patterns, "votes array<int>, n long")
    got = {tuple(r["_votes"]): r["_posterior"] for r in quality.posteriors(frame, 10).collect()}
    for (votes, _), x in zip(patterns, brute_posteriors(patterns, 10), strict=True):
        assert got[tuple(votes)] == pytest.approx(x, rel=1e-6, abs=1e-9)


def test_quality_overrules_single_votes(spark):
    """Short prose has a bad vote for its length, which the other rules outweigh; junk has several."""
    long = [". ".join(lorem(12, 20 * k + j) for j in range(16)) + "." for k in range(60)]
    short = [". ".join(lorem(12, 7000 + 20 * k + j) for j in range(5)) + "." for k in range(20)]
    junk = [" | ".join(lorem(90, 900 + k).split()) for k in range(20)]
    rows = quality.judge(docs(spark, long + short + junk)).withColumn("v", quality.votes()).collect()
    kept = {r.doc_id: r["_kept"] for r in rows}
    assert all(-1 in r["v"] for r in rows if 60 <= r.doc_id < 80)
    assert all(kept[i] for i in range(80)) and not any(kept[i] for i in range(80, 100))


def test_quality_keeps_prose_and_rejects_junk(spark):
    prose = [". ".join(lorem(12, 20 * k + j) for j in range(8)) + "." for k in range(80)]
    junk = [" | ".join(lorem(60, 900 + k).split()) for k in range(10)] + [(lorem(5, k) + " ") * 20 for k in range(10)]
    kept = {r.doc_id: r["_kept"] for r in quality.judge(docs(spark, prose + junk)).collect()}
    assert all(kept[i] for i in range(80)) and not any(kept[i] for i in range(80, 100))
    assert quality.judge(docs(spark, ["x"]).limit(0)).count() == 0


# licences

def test_patience_and_scanner():
    a, b = "x a b c y d e z".split(), "a b q c d e".split()
    pairs = licenses.patience(a, b)
    assert [a[i] for i, _ in pairs] == "a b c d e".split() and all(a[i] == b[j] for i, j in pairs)
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.MIN_COVERAGE)
    for name, notice in licenses.TEMPLATES:
        text = f"{lorem(50, 1)} {notice.upper()} {lorem(50, 2)}"
        found = scanner.scan(text)
        assert [x[0] for x in found] == [name] and found[0][1] == 1.0, name
    assert scanner.scan("This work was licensed under the GNU General Public License, version 3.")[0][0] == "GPL-3.0"
    assert scanner.scan(lorem(100, 3)) == [] and scanner.scan("license version public") == []


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
    return row[-1]


def test_edited_licences_equal_brute_force():
    """Texts with up to a tenth of their words edited: the licence found is the one of the longest common subsequence."""
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.MIN_COVERAGE)
    rng = np.random.default_rng(9)
    for turn in range(3):
        for name, text in licenses.TEXTS:
            own = licenses.words_of(text)
            for k in rng.choice(len(own), len(own) // 10, replace=False):
                own[k] = ["", f"q{k}", f"{own[k]} q{k}"][rng.integers(3)]
            middle = " ".join(own)
            found = scanner.scan(f"{lorem(80, turn)} {middle} {lorem(80, turn + 50)}")
            both = {
                (longest_common(licenses.words_of(middle), t) ** 2 / len(t), n)
                for n, t in ((n, licenses.words_of(t)) for n, t in licenses.TEMPLATES)
                if longest_common(licenses.words_of(middle), t) >= licenses.MIN_COVERAGE * len(t)
            }
            assert [x[0] for x in found][:1] == [max(both)[1]] == [name], (name, found)
            most = max(longest_common(licenses.words_of(middle), t) / len(t) for n, t in map(lambda x: (x[0], licenses.words_of(x[1])), licenses.TEXTS) if n == name)
            assert licenses.MIN_COVERAGE <= found[0][1] <= most


def test_scanner_equals_every_offset():
    """The telling words lose no match that aligning each template at each word of the text finds."""
    scanner = licenses.Scanner(licenses.NOTICES, licenses.MIN_COVERAGE)
    rng = np.random.default_rng(4)
    for turn in range(12):
        parts = []
        for _ in range(3):
            parts += lorem(int(rng.integers(5, 40)), turn).split()
            notice = licenses.words_of(licenses.NOTICES[rng.integers(len(licenses.NOTICES))][1])
            parts += [w for w in notice if rng.random() > 0.12]
        found = set()
        for name, t in scanner.templates:
            slack = int(licenses.SLACK * len(t)) + 2
            for start in range(-len(t), len(parts)):
                low = max(0, start - slack)
                pairs = licenses.patience(parts[low : start + len(t) + slack], t)
                if len(pairs) >= licenses.MIN_COVERAGE * len(t) and pairs[-1][0] - pairs[0][0] + 1 <= len(t) + slack:
                    found.add((len(pairs), len(pairs) / len(t), name, low + pairs[0][0], low + pairs[-1][0] + 1))
        kept = []
        for _, share, name, first, end in sorted(found, key=lambda x: (-x[1] * x[0], -x[0], x[3], x[2])):
            if all(end <= f or e <= first for _, _, f, e in kept):
                kept.append((name, share, first, end))
        assert scanner.scan(" ".join(parts)) == sorted(kept, key=lambda x: x[2])


def test_license_rows(spark):
    texts = [*EDGES, "Released under the MIT License.\nAll rights reserved."]
    got = {r.doc_id: (r.n_matches, r.licenses) for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert got == {i: (0, "") for i in range(len(EDGES))} | {len(EDGES): (2, "AllRightsReserved,MIT")}
