"""Exact removal of repeated 200-byte strings by a distributed merge of sorted suffix runs.

Every 200-byte window has an anchor, the place of the least hash among its 48-byte strings.
Equal windows have equal anchors at equal offsets, so the suffixes that start at anchors stand for
all suffixes at about a seventieth of their number, and those whose first 48 bytes occur once
need no comparison at all.

1. Documents are gathered into chunks, written once; a chunk is the unit that replies go to.
2. Chunks name their anchors' hashes; those that occur twice come back.
3. Each chunk sorts the suffixes of its repeated anchors into runs, equal ones as one, and sends
   them front-coded, a suffix as the length it shares with the one before and the rest. It keeps
   the places of its suffixes by number.
4. Each bucket merges its runs with a loser tree that starts every comparison behind the prefix
   already known to be shared. Neighbours in the merged order give how far suffixes agree to the
   right; what lies before the anchors gives how far to the left; both give the repeated windows.
5. An anchor with very many different suffixes sends them once for each CLASS of window starts,
   cut to what those windows hold. Such suffixes meet by a longer prefix, all that a class's windows
   have in common, so that the group splits into small ones and the same merge tells them apart.
6. Chunks turn the replies into removed bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import forget, table, written

WINDOW = 200
GRAM = 48
CHUNK_BYTES = 4 << 20
#: Bytes that are hashed at once; a longer text is hashed in parts.
STEP_BYTES = 1 << 18
#: An anchor whose chunks hold more different suffixes than this is split by classes of window starts,
#: each of so many.
OFTEN, CLASS = 4096, 20
#: Suffixes of a group up to which each is held against its neighbours.
FEW = 32
#: Repeated anchors that one merging task takes, on average.
BUCKET_ANCHORS = 40_000

_A = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = "chunk long, ids array<long>, sizes array<int>, data binary"


def _longer(h: np.ndarray, step: int, other: np.ndarray | None = None) -> np.ndarray:
    """Hashes of strings that are `step` longer: those of h, each followed by one of other."""
    other = h if other is None else other
    n = min(len(h), len(other) - step)
    out = h[: max(n, 0)] * _A + other[step : step + max(n, 0)]
    out ^= out >> np.uint64(31)
    return out


def hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each place."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for step in (1, 2, 4, 8):
        h = _longer(h, step)
    return _longer(_longer(h, 16), 32, h)


class Anchors:
    """Anchors of some texts laid end to end: place, first and last window start, hash of 48 bytes."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.data = data
        self.gram = hashes(data)
        ends = np.cumsum(sizes)
        w = WINDOW - GRAM + 1
        empty = np.zeros(0, np.int64)
        self.at, self.low, self.high, self.key = empty, empty, empty, np.zeros(0, np.uint64)
        if len(data) < WINDOW:
            return
        place = np.arange(len(self.gram), dtype=np.uint64)
        least = (self.gram & np.uint64(0xFFFFFFFF00000000)) | place
        step = 1
        while 2 * step <= w:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if w > step:
            least = np.minimum(least[: len(least) - (w - step)], least[w - step :])
        starts = np.arange(len(data) - WINDOW + 1)
        owner_end = np.repeat(ends, sizes)[: len(starts)]
        starts = starts[starts + WINDOW <= owner_end]
        if not len(starts):
            return
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        begins = np.flatnonzero(new)
        self.at, self.low = at[begins], starts[begins]
        self.high = starts[np.append(begins[1:], len(starts)) - 1]
        self.key = self.gram[self.at]


def _steps(sizes: list[int], data: bytes) -> Iterator[tuple[int, Anchors]]:
    """(first byte, anchors) of a chunk's texts, some at a time; each window is in one of them."""
    whole = np.frombuffer(data, np.uint8)
    i = at = 0
    while i < len(sizes):
        if sizes[i] > STEP_BYTES:
            for k in range(0, sizes[i] - WINDOW + 1, STEP_BYTES):
                part = whole[at + k : at + min(k + STEP_BYTES + WINDOW - 1, sizes[i])]
                yield at + k, Anchors(part, np.array([len(part)], np.int64))
            i, at = i + 1, at + sizes[i]
            continue
        j, held = i, 0
        while j < len(sizes) and held + sizes[j] <= STEP_BYTES:
            held += sizes[j]
            j += 1
        yield at, Anchors(whole[at : at + held], np.array(sizes[i:j], np.int64))
        i, at = j, at + held


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the sorted wanted ones."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[at] == values


def _u64(values: list[int] | None) -> np.ndarray:
    return np.sort(np.array(values if values is not None else [], np.int64).view(np.uint64))


def chunks_of(documents: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """The texts gathered into rows of about `size` bytes, in the order they are read."""
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            one = {"chunk": chunk, "ids": ids, "sizes": [len(t) for t in texts], "data": b"".join(texts)}
            return pa.RecordBatch.from_pylist([one], schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py() or b""
                if ids and held + len(t) > size:
                    yield row()
                    ids, texts, held, chunk = [], [], 0, chunk + 1
                ids.append(doc)
                texts.append(t)
                held += len(t)
        if ids:
            yield row()

    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")
    ).mapInArrow(run, _CHUNK)


def _repeated(pairs: DataFrame, name: str) -> DataFrame:
    """From (key, chunk, n, m): chunk with the keys that occur twice anywhere, and those of them
    that have over OFTEN variants; n counts a chunk's occurrences of a key, m its variants."""
    pairs = written(pairs, name)
    counts = pairs.groupBy("key").agg(F.sum("n").alias("n2"), F.sum("m").alias("total")).filter("n2 > 1").drop("n2")
    got = written(
        pairs.join(counts, "key").groupBy("chunk").agg(
            F.collect_list(F.expr(f"CASE WHEN total <= {OFTEN} THEN key END")).alias("keys"),
            F.collect_list(F.expr(f"CASE WHEN total > {OFTEN} THEN key END")).alias("often"),
        ),
        name, long_rows=True,
    )
    forget(pairs)
    return got


_PAIRS = "key long, chunk long, n long, m long"


def _pairs(chunk: int, keys: np.ndarray, variants: np.ndarray | None = None) -> pa.RecordBatch:
    """Each key with its occurrences and, given what tells them apart, its variants."""
    if variants is None:
        found, n = np.unique(keys, return_counts=True)
        m = np.zeros(len(found), np.int64)
    else:
        order = np.lexsort((variants, keys))
        keys, variants = keys[order], variants[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        begins = np.flatnonzero(new)
        new[1:] |= variants[1:] != variants[:-1]
        found, n = keys[begins], np.diff(np.append(begins, len(keys)))
        m = np.add.reduceat(new.astype(np.int64), begins) if len(begins) else n
    return pa.RecordBatch.from_arrays(
        [pa.array(found.view(np.int64)), pa.array(np.full(len(found), chunk)), pa.array(n.astype(np.int64)), pa.array(m)],
        names=["key", "chunk", "n", "m"],
    )


def name_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            keys, variants = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for _, a in _steps(row["sizes"], row["data"]):
                keys.append(a.key)
                # both ends of what surrounds an anchor, which tell variants apart well enough to count them
                ends = a.gram[a.low] * _A + a.gram[a.high + WINDOW - GRAM] if len(a.at) else a.key
                variants.append(ends * _A + (a.high - a.low).astype(np.uint64))
            yield _pairs(row["chunk"], np.concatenate(keys), np.concatenate(variants))


#: Anchor's kind, suffix and what is before it: of all windows of an anchor, or of one class of them.
Suffix = tuple[int, bytes, bytes]
PLAIN, SPLIT = 0, 1


def entries(sizes: list[int], data: bytes, keys: np.ndarray, often: np.ndarray) -> dict[Suffix, list[int]]:
    """A chunk's distinct suffixes and the places where each starts."""
    found: dict[Suffix, list[int]] = {}
    for base, a in _steps(sizes, data):
        raw = a.data.tobytes()
        many = _among(a.key, often)
        for k in np.flatnonzero(_among(a.key, keys) | many).tolist():
            at, low, end = int(a.at[k]), int(a.low[k]), int(a.high[k]) + WINDOW
            if not many[k]:
                found.setdefault((PLAIN, raw[at:end], raw[low:at]), []).append(base + at)
                continue
            for start in range(at, low - 1, -CLASS):
                suffix, before = raw[start : min(end, start + WINDOW)], raw[max(low, start - CLASS + 1) : start]
                if len(suffix) + len(before) >= WINDOW:
                    found.setdefault((SPLIT, suffix, before), []).append(base + start)
    return found


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree in the first `known` bytes."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high:  # they differ in high - low bytes from low on
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def shared_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[len(a) - n :] == b[len(b) - n :]:
        return n
    return shared_prefix(a[::-1], b[::-1])


def front_code(run: list[tuple[int, bytes, bytes, bool]]) -> bytes:
    """A sorted run of (entry, suffix, before, repeated here) as shared lengths and rests."""
    n = len(run)
    shared, rests, last = np.zeros(n, "<u2"), [], b""
    for k, (_, suffix, _, _) in enumerate(run):
        shared[k] = shared_prefix(last, suffix)
        rests.append(suffix[shared[k] :])
        last = suffix
    columns = [
        np.array([n], "<u4"), np.array([e for e, *_ in run], "<u4"), shared, np.array([len(r) for r in rests], "<u2"),
        np.array([len(b) for _, _, b, _ in run], "<u2"), np.array([m for *_, m in run], "u1"),
    ]
    return zlib.compress(b"".join([*(c.tobytes() for c in columns), *rests, *(b for _, _, b, _ in run)]), 1)


def read_run(blob: bytes) -> Iterator[tuple[int, bytes, int, bytes, bool]]:
    """(shared with the suffix before, suffix, entry, before, repeated) of a front-coded run."""
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at, columns = 4, []
    for kind, size in (("<u4", 4), ("<u2", 2), ("<u2", 2), ("<u2", 2), ("u1", 1)):
        columns.append(np.frombuffer(raw, kind, n, at).tolist())
        at += n * size
    entry, shared, rest, before, many = columns
    b_at, last = at + sum(rest), b""
    for k in range(n):
        last = last[: shared[k]] + raw[at : at + rest[k]]
        at += rest[k]
        yield shared[k], last, entry[k], raw[b_at : b_at + before[k]], bool(many[k])
        b_at += before[k]


def merge_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple[int, int, tuple]]:
    """(length shared with the suffix before, run, item) of all runs in order of suffixes.

    A loser tree. Each waiting suffix carries the length it shares with the last one that left;
    of two, the one that shares more is the smaller, and only where they share equally much are
    they compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
    shares = [0] * k
    loser = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        h = shared_prefix(x[1], y[1], shares[a])
        if h == len(x[1]) or (h < len(y[1]) and x[1][h] < y[1][h]):
            a, b = a, b
        else:
            a, b = b, a
        shares[b] = h
        return a, b

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, lose = play(build(2 * node), build(2 * node + 1))
        loser[node] = lose
        return win

    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        yield shares[winner], winner, heads[winner]
        heads[winner] = nxt = next(runs[winner], None) if winner < len(runs) else None
        # the next of its run shares with it what front coding says
        shares[winner] = nxt[0] if nxt else 0
        node = (winner + k) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


def _ranges(hit: int) -> list[tuple[int, int]]:
    """The runs of set bits, with both ends."""
    ranges, d = [], 0
    while hit >> d:
        while not hit >> d & 1:
            d += 1
        start = d
        while hit >> d & 1:
            d += 1
        ranges.append((start, d - 1))
    return ranges


def windows_by_distance(group: list[tuple[int, bytes, bytes, bool]]) -> list[list[tuple[int, int]]]:
    """What repeated_windows() tells, in time and memory in proportion to the group.

    For each distance, windows are equal where suffixes in a run share enough, and what lies
    before their anchors is the same so far back.
    """
    hits = [0] * len(group)
    for d in range(min(WINDOW - len(s) for _, s, _, _ in group), max(len(b) for _, _, b, _ in group) + 1):
        need = WINDOW - d
        seen: dict[bytes, int] = {}
        for i, (shared, suffix, before, _) in enumerate(group):
            if shared < need:
                seen.clear()
            if len(suffix) >= need and len(before) >= d:
                j = seen.setdefault(before[len(before) - d :], i)
                if j != i:
                    hits[i] |= 1 << d
                    hits[j] |= 1 << d
    return [[(WINDOW - len(s), len(b))] if many else _ranges(hit) for hit, (_, s, b, many) in zip(hits, group, strict=True)]


def repeated_windows(group: list[tuple[int, bytes, bytes, bool]]) -> list[list[tuple[int, int]]]:
    """For suffixes in order, (shared with the one before, suffix, before, repeated): which windows repeat.

    A window is named by how far before the anchor it starts; ranges hold both ends. The reach to
    the right shrinks away from a suffix in either direction, so looking stops where no window
    not found yet could still reach. Groups of over FEW suffixes, which could share much and repeat
    nothing, are told by distances instead.
    """
    if len(group) > FEW:
        return windows_by_distance(group)
    out = []
    for i, (_, suffix, before, many) in enumerate(group):
        top, least = len(before), WINDOW - len(suffix)
        if many:
            out.append([(least, top)])
            continue
        hit = 0  # a bit for each distance from the anchor
        for away in (-1, 1):
            reach, j = len(suffix), i
            while True:
                if away < 0:
                    reach, j = min(reach, group[j][0]), j - 1
                    if j < 0:
                        break
                else:
                    j += 1
                    if j == len(group):
                        break
                    reach = min(reach, group[j][0])
                near = WINDOW - reach
                if near > top:
                    break
                wanted = (1 << top + 1) - (1 << near)
                if hit & wanted == wanted:
                    break
                far = shared_suffix(before, group[j][2])
                if far >= near:
                    hit |= (1 << far + 1) - (1 << near)
        out.append(_ranges(hit))
    return out


def _bucket(suffix: Suffix, buckets: int) -> int:
    """Suffixes that can have a window in common are in one bucket, those of SPLIT kind from `buckets` on."""
    kind, text, _ = suffix
    return kind * buckets + zlib.crc32(text[: _common(kind)]) % buckets


def _common(kind: int) -> int:
    """What suffixes share at least if they have a window in common."""
    return GRAM if kind == PLAIN else WINDOW - CLASS + 1


def _runs(buckets: int):
    """Runs by bucket, and under bucket -1 how often each suffix of the chunk occurs and where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = entries(row["sizes"], row["data"], _u64(row["keys"]), _u64(row["often"]))
                ordered = sorted(found)
                split: dict[int, list] = {}
                for e, suffix in enumerate(ordered):
                    split.setdefault(_bucket(suffix, buckets), []).append((e, *suffix[1:], len(found[suffix]) > 1))
                counts = np.array([len(found[x]) for x in ordered], "<i4")
                places = np.array([p for x in ordered for p in found[x]], "<i4")
                names, blobs = [-1, *split], [counts.tobytes() + places.tobytes(), *(front_code(r) for r in split.values())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int32()), pa.array([row["chunk"]] * len(names), pa.int64()), pa.array(blobs, pa.binary()),
                        pa.array([len(ordered)] * len(names), pa.int64()),
                    ],
                    names=["bucket", "chunk", "run", "n"],
                )

    return run


def _merger(buckets: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        least = _common(PLAIN if rows["bucket"].iloc[0] < buckets else SPLIT)
        rows = rows.sort_values("chunk")
        chunks = rows["chunk"].tolist()
        reply: dict[int, list[int]] = {}
        group: list[tuple[int, bytes, bytes, bool]] = []
        where: list[list[tuple[int, int]]] = []

        def close() -> None:
            for places, ranges in zip(where, repeated_windows(group), strict=True):
                for chunk, entry in places:
                    for a, b in ranges:
                        reply.setdefault(chunk, []).extend((entry, a, b))
            group.clear()
            where.clear()

        for shared, r, (_, suffix, entry, before, many) in merge_runs([read_run(b) for b in rows["run"]]):
            if shared < least:
                close()
            elif group and shared == len(suffix) == len(group[-1][1]) and before == group[-1][2]:
                group[-1] = (*group[-1][:3], True)  # the same suffix of another chunk
                where[-1].append((chunks[r], entry))
                continue
            group.append((shared if group else 0, suffix, before, many))
            where.append([(chunks[r], entry)])
        close()
        names = list(reply)
        found = [np.array(reply[c], np.int32) for c in names]
        return pd.DataFrame({"chunk": pd.Series(names, dtype="int64"), "found": pd.Series(found, dtype=object)})

    return merge


def removed_spans(begins: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of what is between starts and ends; none goes over where a text begins."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    text = np.searchsorted(begins, starts, side="right")
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] > ends[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1] if len(starts) else ends


def apply_replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    )
    for batch in batches:
        for k in range(batch.num_rows):
            ids, sizes, data, found, places, n = (batch.column(c)[k] for c in range(6))
            ids, sizes, data = ids.as_py(), sizes.as_py(), memoryview(data.as_buffer())
            begins = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            starts = ends = np.zeros(0, np.int64)
            if found.is_valid:
                numbers = np.frombuffer(places.as_buffer(), "<i4")
                counts, at = numbers[: n.as_py()].astype(np.int64), numbers[n.as_py() :].astype(np.int64)
                first = np.cumsum(counts) - counts
                e, near, far = np.concatenate([f.values.to_numpy() for f in found]).astype(np.int64).reshape(-1, 3).T
                times = counts[e]
                which = np.repeat(first[e], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                starts, ends = at[which] - np.repeat(far, times), at[which] - np.repeat(near, times) + WINDOW
                starts, ends = removed_spans(begins, starts, ends)
            bounds = np.searchsorted(starts, begins)
            out = []
            for i, doc in enumerate(ids):
                a, b = begins[i], begins[i + 1]
                gone = list(zip(starts[bounds[i] : bounds[i + 1]].tolist(), ends[bounds[i] : bounds[i + 1]].tolist(), strict=True))
                edges = [int(a), *(x for span in gone for x in span), int(b)]
                kept = b"".join(data[x:y] for x, y in zip(edges[0::2], edges[1::2], strict=True))
                out.append(
                    {
                        "doc_id": doc, "n_bytes": int(b - a), "n_removed": sum(y - x for x, y in gone), "n_spans": len(gone),
                        "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept,
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of every row.

    Every byte goes that lies in a 200-byte string which starts at another place too, in any text
    or in the same one; matches never cross texts, and nothing depends on what is removed
    elsewhere. Null texts are empty; repeated rows are texts of their own and so remove each
    other; a null doc_id stays null. Suffixes are compared as bytes; 64-bit hashes only choose
    anchors. An empty table gives an empty result.
    """
    chunks = written(chunks_of(documents), "chunks", long_rows=True)
    named = _repeated(chunks.select("chunk", "sizes", "data").mapInArrow(name_anchors, _PAIRS), "anchors")
    total = named.agg(F.sum(F.size("keys") + F.size("often"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_ANCHORS))
    runs = written(
        chunks.join(named, "chunk").select("chunk", "sizes", "data", "keys", "often").mapInArrow(_runs(buckets), "bucket int, chunk long, run binary, n long"),
        "runs", long_rows=True,
    )
    merged = written(runs.filter("bucket >= 0").groupBy("bucket").applyInPandas(_merger(buckets), "chunk long, found array<int>"), "merged", long_rows=True)
    # one chunk's replies are a row, so that texts are joined with them once
    found = merged.groupBy("chunk").agg(F.collect_list("found").alias("found"))
    replies = found.join(runs.filter("bucket = -1").select("chunk", F.col("run").alias("places"), "n"), "chunk")
    return (
        chunks.join(replies, "chunk", "left")
        .select("ids", "sizes", "data", "found", "places", "n")
        .mapInArrow(
            apply_replies, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
        )
    )


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
