"""Benchmark decontamination with suffix arrays over the training texts.

Each task sorts its shard's word suffixes into suffix arrays, one per batch of documents, and
binary-searches every test window in them; what it finds are the places of verbatim matches,
and neighbouring matches join into longest ones. The training side is never shuffled. The test
side is sent out in blocks of bounded size, so that a benchmark of any size works: one block
needs no shuffle at all, and with more the places found per document are gathered by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import table
from ledgerlark.llm.hashing import word_hashes

WINDOW = 13
#: UTF-8 bytes of test text that are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
#: Bytes of documents that share a suffix array; a longer document has one alone.
BATCH_BYTES = 2 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_VALUES = np.arange(1, 257, dtype=np.uint64)
_VALUES[0x41:0x5B] += np.uint64(32)  # A-Z count as a-z

_SCHEMA = "doc_id long, t1 long, t2 long, n_words long, spans array<long>, items array<string>, longest long"


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every lower-cased word of the texts and the text it is in."""
    lengths = np.array([len(x) + 1 for x in texts], np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    inside = np.concatenate(([False], _WORD[data]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    hashes = word_hashes(data, starts, ends, _VALUES)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    return hashes, np.searchsorted(np.cumsum(lengths), starts, side="right")


class Tests:
    """A block of test items: their vocabulary and their windows as packed keys."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        hashes, owner = word_table([t for _, t in items]) if items else (np.zeros(0, np.uint64), np.zeros(0, int))
        self.vocabulary = np.unique(hashes)
        ids = np.searchsorted(self.vocabulary, hashes).astype(np.uint64) + np.uint64(1)
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per = 64 // self.bits
        self.levels = -(-window // self.per)
        wanted: dict[tuple[int, ...], set[tuple[str, int]]] = {}
        for i, (name, _) in enumerate(items):
            own = ids[owner == i] if len(items) < 64 else ids[np.searchsorted(owner, i) : np.searchsorted(owner, i + 1)]
            n = min(window, len(own))
            for k in range(len(own) - n + 1) if n else ():
                wanted.setdefault(tuple(own[k : k + n].tolist()), set()).add((str(name), k))
        #: Each different window, with the items that hold it and where.
        self.windows = [(w, sorted(held)) for w, held in sorted(wanted.items())]
        self.shortest = min((len(w) for w, _ in self.windows), default=0)

    def bounds(self, window: tuple[int, ...]) -> list[tuple[int, int]]:
        """Lowest and highest key of the window at each level."""
        out = []
        for k in range(0, len(window), self.per):
            part = window[k : k + self.per]
            low = high = 0
            for i in range(self.per):
                low = low << self.bits | (part[i] if i < len(part) else 0)
                high = high << self.bits | (part[i] if i < len(part) else (1 << self.bits) - 1)
            out.append((low, high))
        return out


def suffix_array(tests: Tests, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Word positions in the order of the suffixes that start there, and their keys by level.

    Words that no test has are one symbol that ends a suffix; suffixes that end before the
    shortest test window can hold none and are left out.
    """
    n = len(hashes)
    at = np.searchsorted(tests.vocabulary, hashes)
    at[at == len(tests.vocabulary)] = 0
    known = tests.vocabulary[at] == hashes
    ids = np.where(known, at + 1, 0).astype(np.uint64)
    stop = ~known
    last = np.ones(n, bool)
    last[:-1] = doc[1:] != doc[:-1]
    ends = np.flatnonzero(stop | last)
    nearest = ends[np.searchsorted(ends, np.arange(n))]
    run = nearest - np.arange(n) + known[nearest]
    places = np.flatnonzero(run >= tests.shortest)
    keys = []
    for level in range(tests.levels):
        key = np.zeros(len(places), np.uint64)
        for i in range(level * tests.per, (level + 1) * tests.per):
            where = np.minimum(places + i, n - 1)
            key = key << np.uint64(tests.bits) | np.where(i < run[places], ids[where], np.uint64(0))
        keys.append(key)
    order = np.lexsort(keys[::-1])
    return places[order], [k[order] for k in keys]


def search(tests: Tests, places: np.ndarray, keys: list[np.ndarray]) -> Iterator[tuple[np.ndarray, int, list[tuple[str, int]]]]:
    """Each test window that occurs: the positions, its length, and the items that hold it and where."""
    if not len(places):
        return
    bounds = [tests.bounds(w) for w, _ in tests.windows]
    first = np.array([b[0] for b in bounds], np.uint64).reshape(-1, 2)
    low = np.searchsorted(keys[0], first[:, 0], "left")
    high = np.searchsorted(keys[0], first[:, 1], "right")
    for q in np.flatnonzero(low < high):
        a, b = low[q], high[q]
        for level, (least, most) in enumerate(bounds[q][1:], 1):
            part = keys[level][a:b]
            a, b = a + np.searchsorted(part, np.uint64(least), "left"), a + np.searchsorted(part, np.uint64(most), "right")
        if a < b:
            yield places[a:b], len(tests.windows[q][0]), tests.windows[q][1]


def _batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _find(tests: Tests, texts: list[bytes]) -> Iterator[tuple[int, list[int], list[str], int]]:
    """For each text its words, the spans hit, the items found, and the words of the longest match."""
    hashes, doc = word_table(texts)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    spans: dict[int, list[tuple[int, int]]] = {}
    found: dict[int, set[tuple[str, int, int, int]]] = {}
    if tests.windows and len(hashes):
        for places, length, held in search(tests, *suffix_array(tests, hashes, doc)):
            for p in places.tolist():
                d = int(doc[p])
                at = p - int(first[d])
                spans.setdefault(d, []).append((at, at + length))
                found.setdefault(d, set()).update((name, length, at - k, at) for name, k in held)
    for d in range(len(texts)):
        own = found.get(d, ())
        joined = [x for s in join_spans(spans.get(d, [])) for x in s]
        yield int(first[d + 1] - first[d]), joined, sorted({x[0] for x in own}), longest(own)


def longest(found: Iterable[tuple[str, int, int, int]]) -> int:
    """The words of the longest match with one item, of (item, window's length, place less place in the item, place).

    A match goes on where the next window of the text is the item's next one.
    """
    best = run = 0
    last = None
    for name, length, away, at in sorted(found):
        run = run + 1 if last == (name, length, away, at - 1) else 1
        best, last = max(best, length + run - 1), (name, length, away, at)
    return best


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching word spans as maximal ones, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_FINISHED = (
    "doc_id long, t1 long, t2 long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "longest_match long, spans array<long>"
)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _SCHEMA as rows of _FINISHED."""
    digest = pa.schema(
        [
            ("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
            ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64()), ("spans", pa.list_(pa.int64())),
        ]
    )
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            flat = row["spans"]
            spans = join_spans(list(zip(flat[0::2], flat[1::2], strict=True)))
            hit = sum(b - a for a, b in spans)
            out.append(
                {
                    "doc_id": row["doc_id"], "t1": row["t1"], "t2": row["t2"], "n_words": row["n_words"], "n_hit": hit, "n_items": len(row["items"]),
                    "items_sha256": hashlib.sha256(",".join(sorted(x[1:] for x in row["items"] if x)).encode()).hexdigest(),
                    "contaminated": hit > 0 and 20 * hit >= row["n_words"],
                    "longest_match": row["longest"], "spans": [x for s in spans for x in s],
                }
            )
        yield pa.RecordBatch.from_pylist(out, digest)


def _matches(documents: DataFrame, items: list[tuple[str, bytes]], window: int, whole: bool = False) -> DataFrame:
    """The matches of each row with items; whole: as finished rows, where no other block adds to them.

    Rows are finished in the same call, since a second one would hold another Python worker for each task.
    """
    sent = documents.sparkSession.sparkContext.broadcast(items)
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64()]
    names = ["doc_id", "t1", "t2", "n_words", "spans", "items", "longest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Tests(sent.value, window)
        for batch in batches:
            texts = [x or b"" for x in batch.column(3).to_pylist()]
            for a, b in _batches(texts):
                got = list(zip(*_find(tests, texts[a:b]), strict=True))
                own = [batch.column(k).slice(a, b - a) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(list(v), k) for v, k in zip(got, kinds, strict=True))], names=names)

    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"),
        F.encode(text, "UTF-8").alias("text"),
    )
    return rows.mapInArrow(lambda batches: _finished(run(batches)), _FINISHED) if whole else rows.mapInArrow(run, _SCHEMA)


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document: doc_id, t1, t2 (its text), n_words, n_hit, n_items, items_sha256, contaminated, longest_match, spans.

    A word is a run of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z. spans
    holds the start and end of each maximal run of hit words, longest_match the words of the longest
    match with one item. Null texts have no words and no hits,
    and null or empty items no windows; items with equal texts count each, but those without an
    item_id, which hit words like any other, count as one together and aren't among the ids of
    items_sha256; repeated documents are rows of their own; a null doc_id stays null. Words are
    compared by 64-bit hashes. An empty benchmark leaves every document clean.
    """
    spark = documents.sparkSession
    # an id is told from none by what goes before it
    item = F.coalesce(F.concat(F.lit("="), F.col("item_id").cast("string")), F.lit(""))
    tests = benchmark.select(item.alias("item"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size * 5 // (4 * block_bytes)) if size > block_bytes else 1)
    if blocks == 1:
        return _matches(documents, [(r[0], bytes(r[1])) for r in tests.collect()], window, whole=True)
    # one pass over the documents for each block; places are then gathered by row, or for all
    # rows of equal doc_id and text at once, since they have the same
    rows = documents.select("doc_id", "text")
    one: DataFrame | None = None
    for k in range(blocks):
        part = tests.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        got = _matches(rows, [(r[0], bytes(r[1])) for r in part.collect()], window)
        one = got if one is None else one.unionByName(got)
    found = (
        one.groupBy("doc_id", "t1", "t2")
        .agg(
            F.max("n_words").alias("n_words"),
            (F.count(F.lit(1)) / blocks).cast("int").alias("copies"),
            F.flatten(F.collect_set("spans")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
            F.max("longest").alias("longest"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .drop("copies", "copy")
    )
    return found.select("doc_id", "t1", "t2", "n_words", "spans", "items", "longest").mapInArrow(_finished, _FINISHED)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, all columns, whatever their doc_id.

    A row goes if its text is contaminated, so that rows of equal texts go together.
    """
    bad = contamination(documents, benchmark, window).filter("contaminated").select("t1", "t2").distinct()
    text = F.coalesce("_row.text", F.lit(""))
    keyed = documents.select(F.struct("*").alias("_row")).select("_row", F.xxhash64(text).alias("_x"), F.xxhash64(F.lit(1), text).alias("_y"))
    return keyed.join(bad, (F.col("_x") == F.col("t1")) & (F.col("_y") == F.col("t2")), "left_anti").select("_row.*")


def op10_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_SPLIT} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, k AS j, least({WINDOW}, len(w)) AS m, array_to_string(w[k:k + least({WINDOW}, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) u(k) WHERE len(w) > 0
),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (
  SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS win
  FROM d, ms, unnest(range(1, len(w) - m + 2)) u(k) WHERE len(w) >= m
),
hit AS (SELECT doc_id, iw.m, k, item FROM dw JOIN iw ON dw.win = iw.win AND dw.m = iw.m),
cover AS (SELECT DISTINCT doc_id, p FROM hit, unnest(range(k, k + m)) u(p)),
placed AS (SELECT DISTINCT doc_id, iw.m, item, k - j AS away, k FROM dw JOIN iw ON dw.win = iw.win AND dw.m = iw.m),
runs AS (
  SELECT doc_id, m + count(*) - 1 AS n FROM (
    SELECT doc_id, m, item, away, k - row_number() OVER (PARTITION BY doc_id, m, item, away ORDER BY k) AS g FROM placed)
  GROUP BY doc_id, m, item, away, g
),
longest AS (SELECT doc_id, max(n) AS longest_match FROM runs GROUP BY doc_id),
hits AS (SELECT doc_id, count(*) AS n_hit FROM cover GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(longest_match, 0)::BIGINT AS longest_match
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
