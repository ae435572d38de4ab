"""MinHash near-dedup of documents over word shingles.

Signatures are least values of universal hash functions, banded so that a pair at the threshold
escapes all bands with a probability of 2.5e-7. Rows with equal shingle sets are one node.
Candidates first compare signatures and are then confirmed on their full sets of shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import table, written
from ledgerlark.llm.hashing import word_hashes
from ledgerlark.llm.near import among, band_keys, buckets_for, joined_with, linked, mix, route

BANDS, ROWS = 50, 6
PERCENT = 80
SHINGLE = 2
#: Least values that a signature keeps a byte of, and how many have to agree: at a similarity of
#: 0.8 fewer do with a probability of 3e-7.
SIGNATURE, AGREE = 64, 34
#: Bytes of text that are hashed at once.
BATCH_BYTES = 2 << 20

_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_UPPER = bytes(range(0x41, 0x5B))
_LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())
_VALUES = np.frombuffer(bytes(range(256)).translate(_LOWERED), np.uint8).astype(np.uint64) + np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    return [w for w in _SPACES.split(text.translate(_LOWERED)) if w]


def shingles_of(words: list, size: int) -> set:
    """Distinct runs of `size` words; with fewer words, the whole sequence; none without words."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def _hashed(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b"\x20".join(texts) + b"\x20", np.uint8)
    space = (data == 0x20) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    word = mix(word_hashes(data, starts, ends, _VALUES))
    first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        w = word[a:b]
        take = min(size, len(w))
        h = np.zeros(max(0, len(w) - take + 1), np.uint64) if take else np.zeros(0, np.uint64)
        for k in range(take):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w[k : k + len(h)])
        out.append(np.unique(h))
    return out


def _pieces(ids: list, texts: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts, BATCH_BYTES at once or a text."""
    start = 0
    while start < len(ids):
        end, held = start, 0
        while end < len(ids) and (end == start or held + len(texts[end]) <= BATCH_BYTES):
            held += len(texts[end])
            end += 1
        yield ids[start:end], texts[start:end]
        start = end


def _encoded() -> Column:
    return F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")


def text_key() -> tuple[Column, Column]:
    """Two longs that tell the texts of rows with one doc_id apart."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2")


def signatures(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, _t1 and _t2 (the text), n (distinct shingles), s1, s2 (a digest of the set), keys and signature of each row."""
    names = "doc_id _t1 _t2 n s1 s2 keys signature".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(3).to_pylist()]
            for rows, part in _pieces(list(range(len(texts))), texts):
                sets = _hashed(part, size)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                keys: list = [None] * len(sets)
                signature: list = [None] * len(sets)
                s1, s2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                if len(full):
                    together = np.concatenate([sets[i] for i in full])
                    at = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    found, least = band_keys(together, at, BANDS, ROWS, SIGNATURE)
                    for row, i in enumerate(full):
                        keys[i], signature[i] = found[row].tobytes(), least[row].tobytes()
                    s1[full] = np.add.reduceat(mix(together), at).view(np.int64)
                    s2[full] = np.bitwise_xor.reduceat(mix(together * np.uint64(3)), at).view(np.int64)
                own = [batch.column(k).slice(rows[0], len(rows)) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(sizes, pa.int64()), pa.array(s1), pa.array(s2), pa.array(keys, pa.binary()), pa.array(signature, pa.binary())],
                    names=names,
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), _encoded()).mapInArrow(
        run, "doc_id long, _t1 long, _t2 long, n long, s1 long, s2 long, keys binary, signature binary"
    )


def _routed(items: DataFrame, rows: int) -> DataFrame:
    buckets = buckets_for(BANDS * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
                yield batch.column(0).to_numpy(zero_copy_only=False), keys.reshape(-1, BANDS)

        return route(parts(), buckets)

    return items.select("id", "keys").mapInArrow(run, "bucket long, keys binary, ids binary, crowded binary")


def _agreeing(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in AGREE places or more, repeated ids in any of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for k in (2, 3)
            )
            keep = (one == two).sum(axis=1) >= AGREE
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    one = items.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    two = items.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").filter(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _components(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, _t1, _t2, n and component of every row; component is null where no link reaches."""
    rows = written(signatures(documents, size), "signatures")
    held = rows.filter("n > 0 AND doc_id IS NOT NULL")
    # equal sets are one node, named by its least doc_id, which may be the name of several
    node_of = written(held.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node")), "nodes")
    named = written(held.join(node_of, ["s1", "s2", "n"]).select("doc_id", "node", "n", "s1", "s2", "keys", "signature"), "named")
    items = written(
        named.filter("doc_id = node").dropDuplicates(["node", "n", "s1", "s2"]).select(F.col("node").alias("id"), "n", "keys", "signature"), "items"
    )

    def fetch(ids: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or b"" for t in batch.column(1).to_pylist()]
                for some, part in _pieces(batch.column(0).to_pylist(), texts):
                    sets = _hashed(part, size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                        names=["id", "n", "data"],
                    )

        wanted = documents.select(F.col("doc_id").cast("long").alias("id"), _encoded())
        sets = among(wanted, ids).mapInArrow(run, "id long, n long, data binary")
        return sets.filter("n > 0").join(ids, "id").distinct()

    def decode(data: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(d, np.uint64) for d in data]

    comp, _ = linked(
        _routed(items, rows.count()), fetch, decode, percent,
        look=(lambda pairs: _agreeing(pairs, items)) if percent >= PERCENT else (lambda pairs: pairs),
    )
    # rows that share a doc_id join the nodes they belong to
    same = named.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("doc_id")
    over = named.join(same, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b")
    over = written(over, "repeated")
    if not over.isEmpty():
        comp = joined_with(comp, over)
    out = rows.select("doc_id", "_t1", "_t2", "n", "s1", "s2").join(node_of, ["s1", "s2", "n"], "left").drop("s1", "s2")
    if comp is None:
        out = out.withColumn("component", F.col("node"))
    else:
        out = out.join(comp.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return out.withColumn("component", F.when(F.col("doc_id").isNotNull(), F.col("component")))


def near_duplicates(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Texts without words, null ones too, have no shingles and are linked with nothing. component_id
    is the least doc_id that links reach, the row's own included, and kept says that it is its own.
    Rows that repeat a doc_id are given each; whatever one of them is linked with is linked with
    all. A row with a null doc_id is not compared; its component_id is null and it is kept.
    """
    rows = _components(documents, size, percent)
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of documents, all columns, with one of each component: that of least doc_id.

    Of rows that share this doc_id one stays. Rows without words or doc_id all stay.
    """
    rows = written(_components(documents, size, percent).filter("component IS NOT NULL"), "members")
    key = ["doc_id", "_t1", "_t2"]
    first = rows.groupBy("component").agg(F.min(F.struct(*key)).alias("f"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    several = rows.join(first, "component")
    lost = several.filter(F.struct(*key) != F.col("f")).select(*key).distinct()
    again = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(*key), "again")
    own = [F.col("doc_id").cast("long").alias("_d"), *text_key()]
    keyed = documents.select(F.struct("*").alias("_row"), *own)
    match = lambda a, b: (a["_d"] == b["doc_id"]) & (a["_t1"] == b["_t1"]) & (a["_t2"] == b["_t2"])
    kept = keyed.join(lost, match(keyed, lost), "left_anti")
    if not again.isEmpty():  # equal rows in all that counts, of which the first stays
        one = kept.join(again, match(kept, again), "left_semi")
        one = one.withColumn("_k", F.row_number().over(Window.partitionBy("_d", "_t1", "_t2").orderBy("_d"))).filter("_k = 1").drop("_k")
        kept = kept.join(again, match(kept, again), "left_anti").unionByName(one)
    return kept.select("_row.*")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x20\x09-\x0D]+')"
)
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[k:k + 1], ' ')) AS h FROM w, unnest(range(1, greatest(len(w), 2))) u(k) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT e.x, r.c FROM r JOIN e ON r.d = e.y AND r.c < e.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id, w.doc_id = min(r.c) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.d = w.doc_id GROUP BY w.doc_id, n.n
"""
