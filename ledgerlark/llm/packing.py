"""Bounded-space online packing of token streams.

Each partition tokenizes its documents once and keeps a fixed number of open windows. What a
document leaves after its full windows goes where it fits best; when it fits nowhere, the
fullest window is topped up with its head and emitted. At the end of a partition its open
windows are merged, which leaves one part-filled window, and those are merged over the
partitions in a tree of fixed fan-in, so no task ever meets more than FAN_IN windows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import table, written

WINDOW = 1024
OPEN_WINDOWS = 64
#: Part-filled windows that one merging task takes.
FAN_IN = 64
END = 0
#: White space of this length is left to tokenizers: the pattern's look ahead goes one level deeper a character.
LONG_BLANK = 1000

_PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "part long, ids binary"
)
_COLUMNS = [x.split()[0] for x in _PIECE.split(", ")]


def load_encoder(path: str) -> Callable[[str], list[int]]:
    """encode(text) for a tokenizer file of the tokenizers library, special tokens not added.

    A plain byte-level BPE file is run by tiktoken, which gives the same ids several times as
    fast; any other file, and a text that holds an added token's string or white space too long for
    tiktoken's pattern, by tokenizers itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
    made = [model["vocab"].get("".join(m)) for m in pairs]
    plain = (
        model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        # pairs merge in the order of the ids that they make
        and None not in made
        and all(a < b for a, b in zip(made, made[1:], strict=False))
        and not spec.get("normalizer")
        and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        and spec["pre_tokenizer"].get("use_regex", True)
        and not spec["pre_tokenizer"].get("add_prefix_space")
        and not model.get("ignore_merges")
    )
    exact = lambda text: slow.encode(text, add_special_tokens=False).ids
    if not plain:
        return exact
    import tiktoken

    # fixed values: byte-level vocabularies write printable bytes as themselves and the others from U+0100 on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    # fixed value: the byte-level pre-tokenizer's public pattern
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    blank = re.compile(rf"\s{{{LONG_BLANK}}}")
    return lambda text: exact(text) if blank.search(text) or any(a in text for a in added) else fast(text)


class Packer:
    """The open windows of one partition. A piece is [doc_id, start, ids, doc_tokens]."""

    def __init__(self, first_id: int, size: int = WINDOW, most: int = OPEN_WINDOWS):
        self.next_id, self.size, self.most = first_id, size, most
        self.open: list[tuple[int, list[list]]] = []  # (tokens held, pieces)
        self.out: list[tuple] = []

    def emit(self, pieces: list[list]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset, None, None))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, size = len(ids), self.size
        whole = total - total % size
        for k in range(0, whole, size):
            self.emit([[doc, k, ids[k : k + size], total]])
        if whole < total:
            self.place([doc, whole, ids[whole:], total])

    def place(self, piece: list) -> None:
        while True:
            n = len(piece[2])
            fits = [(held, i) for i, (held, _) in enumerate(self.open) if held + n <= self.size]
            if fits:
                held, i = max(fits)
                self.open[i][1].append(piece)
                if held + n == self.size:
                    self.emit(self.open.pop(i)[1])
                else:
                    self.open[i] = (held + n, self.open[i][1])
                return
            if len(self.open) < self.most:
                self.open.append((n, [piece]))
                return
            held, pieces = self.open.pop(max(range(len(self.open)), key=lambda i: self.open[i][0]))
            doc, start, ids, total = piece
            room = self.size - held
            self.emit([*pieces, [doc, start, ids[:room], total]])
            piece = [doc, start + room, ids[room:], total]

    def merge(self) -> list[list]:
        """Joins the open windows end to end, emits the full ones and returns the rest."""
        held: list[list] = []
        used = 0
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for doc, start, ids, total in pieces:
                while len(ids):
                    room = self.size - used
                    held.append([doc, start, ids[:room], total])
                    used += min(room, len(ids))
                    start, ids = start + len(ids[:room]), ids[room:]
                    if used == self.size:
                        self.emit(held)
                        held, used = [], 0
        self.open = []
        return held


def _first_id(level: int, part: int) -> int:
    return level << 58 | part << 28


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 8 + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_COLUMNS
    )


def _left(held: list[list], part: int) -> list[tuple]:
    return [(doc, start, len(ids), None, total, None, k, part, ids.tobytes()) for k, (doc, start, ids, total) in enumerate(held)]


def _joiner(level: int, last: bool, size: int, most: int, fan_in: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Merges the part-filled windows of up to fan_in parts into full ones and one rest."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["part"].iloc[0]) // fan_in
        packer = Packer(_first_id(level, group), size, most)
        for r in rows.sort_values(["part", "offset"]).itertuples():
            doc = None if pd.isna(r.doc_id) else int(r.doc_id)
            packer.open.append((r.length, [[doc, int(r.start), np.frombuffer(r.ids, "<u4"), int(r.doc_tokens)]]))
        rest = packer.merge()
        if last and rest:
            packer.emit(rest)
            rest = []
        return pd.DataFrame(packer.out + _left(rest, group), columns=_COLUMNS).astype(
            {c: "Int64" for c in _COLUMNS[:-1]}
        )

    return join


def pack(
    documents: DataFrame, tokenizer: str, size: int = WINDOW, most: int = OPEN_WINDOWS, fan_in: int = FAN_IN
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer is the path of a tokenizer file that every executor has. A document is its ids and
    then id 0; a null or empty text is id 0 alone. Every id is in one piece; a sequence holds at
    most size ids, and all but the last are full. Repeated rows are packed each, and a null
    doc_id stays null. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = load_encoder(tokenizer), TaskContext.get().partitionId()
        packer = Packer(_first_id(0, part), size, most)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                packer.add(doc, np.array([*encode(text or ""), END], "<u4"))
            if packer.out:
                yield _batch(packer.out)
                packer.out = []
        rest = packer.merge()
        if packer.out or rest:
            yield _batch(packer.out + _left(rest, part))

    # written once: what is emitted and what is left over are read apart, the texts only here
    packed = written(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECE), "packed"
    )
    done, left, level = packed.filter("part IS NULL"), packed.filter("part IS NOT NULL"), 0
    parts = left.agg(F.max("part")).first()[0]
    while parts is not None:
        level += 1
        last = parts < fan_in

        merged = written(left.groupBy(F.expr(f"part div {fan_in}")).applyInPandas(_joiner(level, last, size, most, fan_in), _PIECE), "merged")
        done = done.unionByName(merged.filter("part IS NULL"))
        left = merged.filter("part IS NOT NULL")
        parts = None if last else parts // fan_in
    return done.select(*_COLUMNS[:-2])


def op5_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
