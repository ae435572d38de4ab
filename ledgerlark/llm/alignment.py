"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often.

An Arrow batch is aligned as a whole: token lists are flattened, running sums of token lengths
that begin anew with each text are the tokens' byte ends, and a hash join on (text, end) finds the places
where both tokenizers end a token. Of two tokens that end together one is a suffix of the other, so
that the vocabularies bound the distinct pairs, whatever the corpus: some 320,000 for the
given ones. Their counts are summed by batch and task, then by Spark, and are small enough to be sent to all tasks.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.llm.byte_bpe import gather
from ledgerlark.llm.common import forget, table, written
from ledgerlark.llm.packing import load_encoder
from ledgerlark.llm.rows import free_name, replaced, replaced_schema

#: Bytes of text that are aligned at once; a longer text is aligned alone.
GROUP_BYTES = 1 << 20
#: A pair is A's id times this plus B's id.
FACTOR = 1 << 32


class Vocabulary:
    """encode(texts) gives ids; blob, start and length tell each id's bytes."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]):
        self.encode = encode
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return gather(self.blob, self.start[ids], self.length[ids]).tobytes()


@functools.lru_cache(maxsize=4)
def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library; special tokens' strings are plain text."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = True
    added = [t.content for t in exact.get_added_tokens_decoder().values()]
    fast = load_encoder(path)
    # fixed values: byte-level vocabularies write printable bytes as themselves and the others from U+0100 on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    tokens = [b""] * exact.get_vocab_size()
    for token, i in exact.get_vocab().items():
        tokens[i] = token.encode() if token in added else bytes(letters[c] for c in token)

    def encode(texts: list[str]) -> list[list[int]]:
        return [exact.encode(t, add_special_tokens=False).ids if any(a in t for a in added) else fast(t) for t in texts]

    return Vocabulary(encode, tokens)


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Vocabulary:
    """A sentencepiece model; its control and unknown pieces stand for no bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def token(i: int) -> bytes:
        if model.is_control(i) or model.is_unknown(i):
            return b""
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), [token(i) for i in range(model.get_piece_size())])


def _lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def token_ends(ids: pa.ListArray, vocabulary: Vocabulary, name: str) -> pa.Table:
    """Each token with its text's number, its place in the flat list and the byte offset at which it ends."""
    flat, text = pc.list_flatten(ids), pc.list_parent_indices(ids)
    ends = pc.cumulative_sum(pc.take(pa.array(vocabulary.length), flat)).to_numpy(zero_copy_only=False)
    # the sum before a text's first token is taken off all of its tokens
    before = np.concatenate(([0], ends))[np.asarray(ids.offsets)[:-1]]
    text = text.to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.table({"text": text, "end": ends - before[text], name: flat, f"{name}_at": np.arange(len(ends))})


def _same(lists: pa.ListArray, expected: list[bytes], vocabulary: Vocabulary) -> list[bool]:
    """Whether the tokens of each text, joined, are its bytes."""
    flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
    joined = vocabulary.bytes_of(flat)
    places = np.concatenate(([0], np.cumsum(vocabulary.length[flat])))[offsets].tolist()
    return [joined[a:b] == x for a, b, x in zip(places, places[1:], expected, strict=False)]


def _joined(values: pa.Array, ends: np.ndarray, separator: str) -> pa.Array:
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values), separator)


def align_texts(texts: list[str | None], a: Vocabulary, b: Vocabulary) -> dict[str, pa.Array]:
    """One row per text: n_a, n_b, n_groups, n_links, groups, and its distinct pairs with their times."""
    n = len(texts)
    spaced = [f" {t}" if t else "" for t in texts]
    ids_a, ids_b = [a.encode(spaced), b.encode([t or "" for t in texts])]
    expected = [t.encode() for t in spaced]
    list_a, list_b = _lists(ids_a), _lists(ids_b)
    good = [bool(t) and x and y for t, x, y in zip(texts, _same(list_a, expected, a), _same(list_b, expected, b), strict=True)]
    if not all(good):
        list_a, list_b = (_lists([x if ok else [] for x, ok in zip(ids, good, strict=True)]) for ids in (ids_a, ids_b))
    links = token_ends(list_a, a, "a").join(token_ends(list_b, b, "b"), ["text", "end"], join_type="inner", use_threads=False)
    # groups end where tokens of both do; a text's last tokens end together, so that groups never cross texts
    text, at_a, at_b = (links[c].to_numpy() for c in ("text", "a_at", "b_at"))
    ends_a, ends_b = np.sort(at_a), np.sort(at_b)
    n_links = np.bincount(text, minlength=n)
    sides = [_joined(x.values.cast(pa.string()), ends + 1, ",") for x, ends in ((list_a, ends_a), (list_b, ends_b))]
    groups = _joined(pc.binary_join_element_wise(*sides, "|"), np.cumsum(n_links), ";")
    pairs = pa.table({"text": text, "pair": pc.add(pc.multiply(links["a"], FACTOR), links["b"])})
    pairs = pairs.group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by([("text", "ascending"), ("pair", "ascending")])
    offsets = pa.array(np.searchsorted(pairs["text"].to_numpy(), np.arange(n + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pairs[c].combine_chunks()) for c in ("pair", "count_all")]
    return {
        "n_a": pc.list_value_length(list_a).cast(pa.int64()), "n_b": pc.list_value_length(list_b).cast(pa.int64()),
        "n_groups": pa.array(n_links, pa.int64()), "n_links": pa.array(n_links, pa.int64()), "groups": groups,
        "pairs": lists[0], "times": lists[1],
    }


_COLUMNS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string", "pairs": "array<bigint>", "times": "array<bigint>"}


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about GROUP_BYTES of text, of one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and held + size > GROUP_BYTES:
            yield first, i
            first, held = i, 0
        held += size
    if len(sizes):
        yield first, len(sizes)


def align(documents: DataFrame, tokenizer_a: str, tokenizer_b: str, text: str = "text") -> DataFrame:
    """documents with, in place of text, how its tokens by A (of a blank and the text) and by B line up.

    New columns: n_a, n_b tokens; groups, `a1,a2|b1;a3|b2,b3` in ids, cut wherever tokens of both end, and their number n_groups; n_links
    pairs of tokens that end together; pairs, the distinct (A id * FACTOR + B id) among them, and the times of each. Tokens
    stand for at least a byte, so that a group has one link. A null or empty text, and one that a tokenizer
    doesn't give back byte by byte, has no tokens: zeros, an empty text and empty lists. Repeated rows are aligned
    each; a clashing column keeps its name and the new one gets a leading underscore. An empty table gives an empty
    result. Both paths name files that every executor has: a byte-level BPE of tokenizers, and a sentencepiece model.
    """
    at, names = documents.columns.index(text), {c: free_name(documents.columns, c) for c in _COLUMNS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(tokenizer_a), pieces(tokenizer_b)
        for batch in batches:
            for first, end in _runs(batch.column(at)):
                part = batch.slice(first, end - first)
                found = align_texts(part.column(at).to_pylist(), a, b)
                yield replaced(part, at, {names[c]: x for c, x in found.items()})

    return documents.mapInArrow(run, replaced_schema(documents, text, {names[c]: kind for c, kind in _COLUMNS.items()}))


def _summed(pairs: pa.Table) -> pa.Table:
    out = pairs.group_by("pair", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"pair": out["pair"], "n": out["n_sum"]})


def pair_counts(aligned: DataFrame, pairs: str = "pairs", times: str = "times") -> DataFrame:
    """pair, n (its links in all texts), best (no pair with the same B id has more). At most as many rows as the vocabularies' suffixes allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = _summed(pa.table({"pair": pc.list_flatten(batch.column(0)), "n": pc.list_flatten(batch.column(1))}))
            held = part if held is None else _summed(pa.concat_tables([held, part]))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    counts = aligned.select(pairs, times).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair") % FACTOR))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def link_statistics(aligned: DataFrame, counts: DataFrame, pairs: str = "pairs", times: str = "times") -> DataFrame:
    """aligned with, in place of its pairs, n_best (links whose pair is a best one) and count_sum (their pairs' counts, summed over links).

    counts is what pair_counts() gives; the vocabularies bound it, so that it goes to every task.
    """
    spark, at = aligned.sparkSession, aligned.columns.index(pairs)
    with_times = aligned.columns.index(times)
    names = {c: free_name(aligned.columns, c) for c in ("n_best", "count_sum")}
    known = spark.sparkContext.broadcast(counts.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            links = pa.table({"row": pc.list_parent_indices(lists), "pair": pc.list_flatten(lists), "times": pc.list_flatten(batch.column(with_times))})
            links = links.join(known.value, "pair", join_type="inner", use_threads=False)
            links = pa.table(
                {"row": links["row"], "best": pc.multiply(links["times"], links["best"].cast(pa.int64())), "sum": pc.multiply(links["times"], links["n"])}
            )
            sums = links.group_by("row", use_threads=False).aggregate([("best", "sum"), ("sum", "sum")])
            best, total = np.zeros((2, batch.num_rows), np.int64)
            best[sums["row"].to_numpy()], total[sums["row"].to_numpy()] = sums["best_sum"].to_numpy(), sums["sum_sum"].to_numpy()
            yield replaced(batch, at, {names["n_best"]: pa.array(best), names["count_sum"]: pa.array(total)})

    return aligned.mapInArrow(run, replaced_schema(aligned, pairs, {n: "long" for n in names.values()}))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = align(documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    kept = written(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "aligned")
    counts = written(pair_counts(kept), "pair_counts")
    found = link_statistics(kept, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    forget(counts)
    return found
