"""Byte-level BPE: encoding by two-tier lookup, and decoding.

Texts are cut into pre-tokens for a whole batch at once, by character classes. A minimal perfect
hash over the vocabulary resolves the pre-tokens that are entries themselves; every other one is
merged on its own, by a heap of ranked pairs over linked bytes. Nothing here crosses rows, so
that the work is one narrow pass in which a lost executor costs its own tasks alone.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import table
from ledgerlark.llm.hashing import word_hashes
from ledgerlark.llm.rows import free_name, replaced, replaced_schema

#: Characters that are cut at once; a longer text is cut in parts, where white space begins.
SPAN = 1 << 20
#: Merged pre-tokens that a worker remembers.
MEMO = 1 << 19

SPACE, LETTER, NUMBER, OTHER = range(4)
#: What a byte counts in a hash.
_VALUES = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)


@functools.cache
def unicode_classes() -> np.ndarray:
    """The class of each code point, as the pattern's white space, letters and numbers have it.

    Asked of tiktoken's own pattern engine, so that both know the same Unicode version.
    """
    import tiktoken

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], "<u4")
    text, single = points.tobytes().decode("utf-32-le"), {bytes([b]): b for b in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text))
        out[np.frombuffer(found.decode().encode("utf-32-le"), "<u4")] = kind
    return out


def token_starts(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which characters begin a pre-token of public_tokenizers.PATTERN.

    points are the code points of several texts in a row, kinds their classes, and first tells
    the first character of each text.
    """
    if not len(points):
        return np.zeros(0, bool)
    starts = first.copy()
    starts[1:] |= kinds[1:] != kinds[:-1]
    # before other characters, the last white space is cut off its run and, if a blank, goes with them
    after = np.flatnonzero((kinds[1:] != SPACE) & (kinds[:-1] == SPACE) & ~first[1:]) + 1
    starts[after - 1] = True
    starts[after[points[after - 1] == 0x20]] = False
    # an apostrophe that begins a pre-token takes the letters of a contraction
    n = len(points)
    at = np.flatnonzero((points[:-1] == ord("'")) & starts[:-1] & (kinds[1:] == LETTER) & ~first[1:])
    one, two = points[at + 1], points[np.minimum(at + 2, n - 1)]
    two = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n - 1)], two, 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    at, ends = at[short | long], (at + np.where(short, 2, 3))[short | long]
    starts[at + 1] = False
    starts[ends[ends < n]] = True
    return starts


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: each has a slot of its own among len(keys).

    Keys fall into buckets. A bucket of several keys has the least displacement that sends all of
    them to free slots; then the single ones are given the slots that are left.
    """

    def __init__(self, keys: np.ndarray):
        n = self.n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("keys of a perfect hash have to be distinct")
        self.buckets = max(1, n // 3)
        self.shift = np.zeros(self.buckets, np.int64)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        sizes = np.bincount(bucket, minlength=self.buckets)
        taken = np.zeros(n, bool)
        for size in range(int(sizes.max(initial=0)), 1, -1):
            members = np.flatnonzero(sizes[bucket] == size)
            members = members[np.argsort(bucket[members], kind="stable")].reshape(-1, size)
            for displacement in range(1, 1 << 20):
                if not len(members):
                    break
                slots = self._slot(keys[members], np.full(1, displacement))
                inner = np.sort(slots, axis=1)
                fits = ~taken[slots].any(axis=1) & (inner[:, 1:] != inner[:, :-1]).all(axis=1)
                # of buckets that want the same slot in this round, the first one in order gets it
                owner = np.full(n, len(members))
                rows = np.repeat(np.arange(len(members)), size)
                np.minimum.at(owner, slots[fits].ravel(), rows.reshape(-1, size)[fits].ravel())
                fits &= (owner[slots] == np.arange(len(members))[:, None]).all(axis=1)
                taken[slots[fits].ravel()] = True
                self.shift[bucket[members[fits, 0]]] = displacement
                members = members[~fits]
            if len(members):
                raise ValueError("no displacement fits")
        alone = np.flatnonzero(sizes[bucket] == 1)
        self.shift[bucket[alone]] = -1 - np.flatnonzero(~taken)

    def _slot(self, keys: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        x = keys ^ (displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; what is no key of the table gets some slot, too."""
        shift = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slot(keys, shift))


def gather(blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of blob, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return blob[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class ByteBpe:
    """Encodes and decodes by the ranks of token bytes; a rank is the token's id."""

    def __init__(self, ranks: dict[bytes, int], kinds: np.ndarray | None = None):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary needs every single byte")
        self.ranks, self.kinds = ranks, unicode_classes() if kinds is None else kinds
        self.longest = max(map(len, ranks))
        tokens, ids = list(ranks), np.fromiter(ranks.values(), np.int64)
        blob = np.frombuffer(b"".join(tokens), np.uint8)
        lengths = np.array([len(t) for t in tokens])
        starts = np.cumsum(lengths) - lengths
        keys = word_hashes(blob, starts, starts + lengths, _VALUES)
        self.hash = PerfectHash(keys)
        at = np.argsort(self.hash(keys))
        self.blob, self.slot_key, self.slot_id, self.slot_start, self.slot_length = blob, keys[at], ids[at], starts[at], lengths[at]
        self.id_start, self.id_length = np.zeros((2, int(ids.max()) + 1), np.int64)
        self.id_start[ids], self.id_length[ids] = starts, lengths
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.memo_ids: list[int] = []
        self.memo_ends: list[int] = []

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the pair of least rank merges first, of equal ones the left one."""
        ranks, n, most = self.ranks, len(piece), self.longest
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = after[i]
            # a part that was merged into another one has no successor
            if middle < 0 or middle >= n or after[middle] != end:
                continue
            after[i], after[middle] = end, -1
            if end < n:
                before[end] = i
                far = after[end]
                if far - i <= most and (rank := ranks.get(piece[i:far])) is not None:
                    heapq.heappush(heap, (rank, i, far))
            left = before[i]
            if left >= 0 and end - left <= most and (rank := ranks.get(piece[left:end])) is not None:
                heapq.heappush(heap, (rank, left, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has; texts are short enough to be cut at once."""
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        bounds = np.cumsum(sizes) - sizes
        first = np.zeros(len(points), bool)
        first[bounds[sizes > 0]] = True
        at = np.flatnonzero(token_starts(points, self.kinds[points], first))
        data = joined.encode()
        places = np.arange(len(points) + 1)
        if len(data) > len(points):
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            np.cumsum(width, out=places[1:])
        starts = places[at]
        ends = np.append(starts[1:], len(data))
        ids, counts = self._lookup(data, starts, ends)
        total = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(total[np.searchsorted(at, np.append(bounds, len(points)))])

    def _lookup(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokens, and how many each has."""
        raw, lengths = np.frombuffer(data, np.uint8), ends - starts
        keys = word_hashes(raw, starts, ends, _VALUES)
        slots = self.hash(keys)
        known = (self.slot_key[slots] == keys) & (self.slot_length[slots] == lengths)
        # equal hashes are no proof: bytes decide
        hit = np.flatnonzero(known)
        same = gather(raw, starts[hit], lengths[hit]) == gather(self.blob, self.slot_start[slots[hit]], lengths[hit])
        if not same.all():
            wrong = np.repeat(hit, lengths[hit])[~same]
            known[wrong] = False
        if len(self.memo) > MEMO:
            self._forget()
        memo, rows = self.memo, []
        for a, b in zip(starts[~known].tolist(), ends[~known].tolist(), strict=True):
            piece = data[a:b]
            row = memo.get(piece)
            if row is None:
                self.memo_ids += self.merge(piece)
                self.memo_ends.append(len(self.memo_ids))
                row = memo[piece] = len(memo)
            rows.append(row)
        counts = np.ones(len(starts), np.int64)
        stops = np.concatenate(([0], np.array(self.memo_ends, np.int64)))
        rows = np.array(rows, np.int64)
        counts[~known] = stops[rows + 1] - stops[rows]
        out = np.empty(int(counts.sum()), "<u4")
        place = np.cumsum(counts) - counts
        out[place[known]] = self.slot_id[slots[known]]
        several = counts[~known]
        merged = gather(np.array(self.memo_ids, np.int64), stops[rows], several)
        out[np.repeat(place[~known] - (np.cumsum(several) - several), several) + np.arange(len(merged))] = merged
        return out, counts

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order, with at most about SPAN characters at work at once."""
        held: list[str] = []
        whole: list[int] = []  # parts of each text in held
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            ids, counts = self.encode(held)
            stops, k = np.concatenate(([0], np.cumsum(counts))), 0
            for n in whole:
                parts.append(ids[stops[k] : stops[k + n]])
                k += n
                yield np.concatenate(parts) if len(parts) > 1 else parts[0]
                parts.clear()
            if k < len(held):
                parts.append(ids[stops[k] :])

        for text in texts:
            n = 0
            for part in self._parts(text):
                if size + len(part) > SPAN and held:
                    yield from flush()
                    held, whole, size, n = [], [], 0, 0
                held.append(part)
                size, n = size + len(part), n + 1
            whole.append(n)
        if held:
            yield from flush()

    def _parts(self, text: str) -> Iterator[str]:
        """text in parts of at least SPAN characters that begin where white space follows something else."""
        at, n = 0, len(text)
        while n - at > SPAN:
            end = at + SPAN
            while end < n and not (self._blank(text[end]) and not self._blank(text[end - 1])):
                end += 1
            if end == n:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def _blank(self, letter: str) -> bool:
        return self.kinds[ord(letter)] == SPACE

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens; an id that the vocabulary lacks is an error."""
        if len(ids) and (ids.max() >= len(self.id_length) or not self.id_length[ids].all()):
            raise ValueError("an id without a token")
        return gather(self.blob, self.id_start[ids], self.id_length[ids]).tobytes()


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> ByteBpe:
    """The encoder of a rank file: lines of a token's bytes in base64 and its id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return ByteBpe({base64.b64decode(token): int(rank) for token, rank in pairs})


def encode(documents: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """documents with n_tokens, and ids in place of text: little-endian unsigned 32-bit integers.

    ranks is the path of a rank file that every executor has. A null or empty text has no ids; repeated rows
    are encoded each. Special tokens' strings are plain text. Texts of any length are taken whole, about SPAN
    characters at once. Columns that clash with the new ones keep theirs, and the new ones get
    a leading underscore. An empty table gives an empty result.
    """
    n_name, ids_name, at = free_name(documents.columns, "n_tokens"), free_name(documents.columns, "ids"), documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_ranks(ranks)
        for batch in batches:
            counts, blobs = [], []
            for ids in bpe.encode_all(t.as_py() or "" for t in batch.column(at)):
                counts.append(len(ids))
                blobs.append(ids.tobytes())
            yield replaced(batch, at, {n_name: pa.array(counts, pa.int64()), ids_name: pa.array(blobs, pa.binary())})

    return documents.mapInArrow(run, replaced_schema(documents, text, {n_name: "long", ids_name: "binary"}))


def decode(encoded: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """encoded with the column decoded, the bytes of the tokens, in place of ids.

    A null is taken as no ids; ids that the rank file lacks are an error. A clashing column is kept as in encode().
    """
    name, at = free_name(encoded.columns, "decoded"), encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_ranks(ranks)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(b.as_py() or b"", "<u4")) for b in batch.column(at)]
            yield replaced(batch, at, {name: pa.array(texts, pa.binary())})

    return encoded.mapInArrow(run, replaced_schema(encoded, ids, {name: "binary"}))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ranks)
    hashed = decode(encoded.withColumn("ids_sha256", F.sha2("ids", 256)), ranks)
    return hashed.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
