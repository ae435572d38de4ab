"""Links among near-equal texts, from band keys to components.

Band keys meet by bucket. A key of few members gives its pairs at once. A crowded key's members are
compared with a few of them, its centres: the member that most crowded keys hold, which in a
group of edited copies is the least edited one, and some that hashes choose; so groups of near
copies cost a few comparisons a member and their pairs are never listed. What then still
shares a crowded key across components goes through a set-similarity join with exact bounds, so
that no link is missed for want of a centre.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import forget, written

#: Centres of a crowded key that hashes choose, besides the one that the degree chooses.
CENTRES = 2
#: Shingles that are hashed at once.
BLOCK = 1 << 18
#: Band rows that a task gathers before it sends them, and that a bucket has on average.
HELD_ROWS, BUCKET_ROWS = 1 << 20, 1 << 20
#: Members up to which a key gives all its pairs; with more, anywhere, it counts as crowded.
FEW = 8
#: Counters of shingles, which order them from rare to frequent, and longs of a set's parity bits.
COUNTERS, PARITY = 1 << 18, 4
#: Members up to which a shingle's pairs are looked at within one task, and members to a bucket of shingles on average.
LISTED, MEMBERS = 1 << 12, 1 << 9
#: Longs of the bitmap of ids that thins out texts before they are shuffled.
BITMAP = 1 << 17

#: Reads stored texts as their sorted distinct shingle hashes.
Decode = Callable[[list[bytes]], list[np.ndarray]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def family(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """n multiply-add hash functions: odd factors and summands."""
    draws = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return draws[:n] | np.uint64(1), draws[n:]


def band_keys(shingles: np.ndarray, starts: np.ndarray, bands: int, rows: int, sketch: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, sets by bands, of sets of hashed shingles that begin at starts; none is empty.

    A key folds the least values of `rows` universal hash functions over the set. At similarity
    s two sets share a key with probability 1 - (1 - s ** rows) ** bands. The second result holds
    one byte of each of the first `sketch` least values, the signature.
    """
    factors, summands = (x.astype(np.uint32) for x in family(bands * rows))
    factors |= np.uint32(1)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    keys = np.zeros((len(starts), bands), np.uint64)
    signature = np.zeros((len(starts), sketch), np.uint8)
    ends = np.append(starts[1:], len(shingles))
    first = 0
    while first < len(starts):  # in blocks that stay in the processor's cache
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, side="right")))
        part, at = short[starts[first] : ends[last - 1]], starts[first:last] - starts[first]
        buffer = np.empty_like(part)
        for band in range(bands):
            key = np.full(last - first, band + 1, np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                np.multiply(part, factors[k], out=buffer)
                np.add(buffer, summands[k], out=buffer)
                least = np.minimum.reduceat(buffer, at)
                if k < sketch:
                    signature[first:last, k] = least.astype(np.uint8)
                key = mix(key ^ least.astype(np.uint64))
            keys[first:last, band] = key
        first = last
    return keys.view(np.int64), signature


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the least id reachable.

    Alternating large-star and small-star steps: each node passes its larger neighbours, and then
    its smaller ones, to the least of them, until nothing changes. Every step is two shuffles
    on ids, with the least found by partial aggregation, and is written to the shared folder.
    """

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    def are_stars(edges: DataFrame) -> bool:
        # each larger end has one smaller end, which is no larger end itself
        several = edges.groupBy("u").agg(F.min("v").alias("x"), F.max("v").alias("y")).filter("x <> y").select("u")
        chained = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        return several.unionByName(chained).isEmpty()

    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not are_stars(edges):
        # large-star over both directions, then small-star over edges from larger to smaller
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u > v")
        small = (
            down.join(least(down), "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        nxt = written(small, "edges")
        forget(edges)
        edges = nxt
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _distinct(keys: np.ndarray, ids: np.ndarray, in_order: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, id) in order, and how many ids each one's key has; in_order: keys are, and ids may be overwritten."""
    if not in_order:
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
    if len(keys):
        same = keys[1:] == keys[:-1]
        at = np.flatnonzero(np.r_[same, False] | np.r_[False, same])  # only these need an order of ids
        ids[at] = ids[at[np.lexsort((ids[at], keys[at]))]]
        new = np.r_[True, ~same | (ids[1:] != ids[:-1])]
        if not new.all():
            keys, ids = keys[new], ids[new]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    n = np.diff(np.r_[begins, len(keys)])
    return keys, ids, np.repeat(n, n)


_ROUTED = "bucket long, keys binary, ids binary, crowded binary"


def _bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """Which of buckets each of some longs belongs to."""
    found = np.empty(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        found[at : at + BLOCK] = mix(x[at : at + BLOCK].view(np.uint64)) % np.uint64(buckets)
    return found


def route(parts: Iterable[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Band keys and ids, given in parts (ids, keys by bands), as runs of longs for each bucket of keys.

    Where a task holds over FEW ids of a key it is known to be crowded: its rows go on under
    buckets of their own, below 0, and one of them stays to tell the other tasks. A key's
    meeting place so gets at most FEW rows for each HELD_ROWS of all.
    """

    def flush(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, ids = np.concatenate([k.ravel() for _, k in parts]), np.concatenate([np.repeat(i, k.shape[1]) for i, k in parts])
        parts.clear()  # a worker holds these rows for each task, so that no array stays beyond its use
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        del order
        keys, ids, n = _distinct(keys, ids, in_order=True)
        hot = n > FEW
        del n
        sign = hot & np.r_[True, keys[1:] != keys[:-1]]
        bucket = _bucket_of(keys, buckets)
        told, told_at = keys[sign], bucket[sign]
        bucket[hot] = -1 - _bucket_of(ids[hot], buckets)
        if len(told):
            keys, ids, bucket = np.r_[keys, told], np.r_[ids, ids[sign]], np.r_[bucket, told_at]
        del hot, sign
        order = np.argsort(bucket.astype(np.int16) if buckets < 1 << 15 else bucket, kind="stable")
        bucket = bucket[order]
        keys = keys[order]
        ids = ids[order]
        del order
        told_order = np.argsort(told_at, kind="stable")
        told, told_at = told[told_order], told_at[told_order]
        at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        spans = list(zip(at, [*at[1:], len(bucket)], strict=True))
        named = bucket[at]
        del bucket
        low, high = (np.searchsorted(told_at, named, side) for side in ("left", "right"))
        runs = []
        for rows in (keys, ids):
            runs.append(pa.array([rows[i:j].tobytes() for i, j in spans], pa.binary()))
        tells = pa.array([told[i:j].tobytes() for i, j in zip(low, high, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(named, pa.int64()), *runs, tells], names=["bucket", "keys", "ids", "crowded"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for ids, keys in parts:
        held.append((ids, keys))
        size += keys.size
        if size >= HELD_ROWS:
            yield flush(held)
            size = 0
    if size:
        yield flush(held)


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's crowded keys with their members, and the pairs of its other keys."""
    keys, ids, told = (np.frombuffer(b"".join(rows[c]), np.int64) for c in ("keys", "ids", "crowded"))
    if rows["bucket"].iloc[0] < 0:
        return pd.DataFrame({"crowded": True, "x": keys, "y": ids})
    keys, ids, n = _distinct(keys, ids)
    keys, ids, n = keys[n > 1], ids[n > 1], n[n > 1]
    crowded = (n > FEW) | np.isin(keys, told)
    found = [pd.DataFrame({"crowded": True, "x": keys[crowded], "y": ids[crowded]})]
    keys, ids = keys[~crowded], ids[~crowded]
    for away in range(1, FEW):
        same = np.flatnonzero(keys[away:] == keys[:-away])
        found.append(pd.DataFrame({"crowded": False, "x": ids[same], "y": ids[same + away]}))
    return pd.concat(found).drop_duplicates()


def buckets_for(rows: int) -> int:
    return max(16, -(-rows // BUCKET_ROWS))


def shared_keys(routed: DataFrame) -> DataFrame:
    """From what route() gives: (crowded, x, y), a crowded key and a member, or the two ids of a pair.

    Keys cross the network as plain longs, sixteen bytes a row, and most end there.
    """
    return routed.groupBy("bucket").applyInPandas(_meet, "crowded boolean, x long, y long")


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id may be one of ids (id): a bitmap of BITMAP longs, whatever there is, is broadcast.

    With many more ids than bits it lets all pass, so that an exact join has to follow.
    """
    word, bit = F.expr(f"pmod(xxhash64(id), {BITMAP})").alias("_word"), F.expr("CAST(pmod(hash(id), 64) AS INT)")
    words = ids.select(word, F.expr("shiftleft(1L, CAST(pmod(hash(id), 64) AS INT))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = rows.select("*", word).join(F.broadcast(words), "_word").filter(F.getbit("_bits", bit) == 1)
    return held.select(*rows.columns)


def _spread_centres() -> list[Column]:
    """Members of a key, each the least under an order of its own: ids with some bits flipped.

    An id is got back by flipping them again, so that plain longs are aggregated.
    """
    draws = mix(np.arange(1, CENTRES + 1, dtype=np.uint64)).view(np.int64)
    return [F.min(F.col("id").bitwiseXOR(F.lit(int(m)))).bitwiseXOR(F.lit(int(m))).alias(f"c{k}") for k, m in enumerate(draws)]


def with_centres(members: DataFrame) -> DataFrame:
    """(a, b) of members (key, id, degree) and the centres of their keys."""
    names = [f"c{k}" for k in range(CENTRES)]
    chosen = members.groupBy("key").agg(F.max_by("id", F.struct("degree", "id")).alias("c"), *_spread_centres())
    found = members.join(chosen, "key").select("id", F.explode(F.array_distinct(F.array("c", *names))).alias("c"))
    return found.filter("id <> c").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()


def parities(x: np.ndarray) -> np.ndarray:
    """PARITY longs that tell of 64 * PARITY classes of shingles whether the set has an odd number of them."""
    bits = np.bincount((mix(x) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) % 2
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def close(rows: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (a, b) of rows that hold a shingle in common and may be similar, across components.

    Rows, in order of shingles, are longs by columns: shingle, id, component, place in the set, size of it and parities.
    """
    token, ids, comp, place, n = rows[:5]
    parity = np.ascontiguousarray(rows[5:].T).view(np.uint64)
    begins = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, int)
    size = np.diff(np.r_[begins, len(token)])
    after = np.repeat(begins + size, size) - np.arange(len(token)) - 1  # rows of the shingle that follow
    found = [np.zeros((0, 2), np.int64)]
    away, at = 1, np.flatnonzero(after)
    while len(at):
        x = at[comp[at] != comp[at + away]]
        both = n[x] + n[x + away]
        least = -(-percent * both // (100 + percent))  # the overlap that will do
        x_left, y_left = n[x] - place[x], n[x + away] - place[x + away]
        fits = np.minimum(x_left, y_left) >= least
        x, both, least = x[fits], both[fits], least[fits]
        differ = np.bitwise_count(parity[x] ^ parity[x + away]).sum(1, dtype=np.int64)
        x = x[differ <= both - 2 * least]
        if len(x):
            found.append(np.stack((np.minimum(ids[x], ids[x + away]), np.maximum(ids[x], ids[x + away])), 1))
        away += 1
        at = at[after[at] >= away]
    return np.concatenate(found)


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted, have percent of their union in common."""
    if len(x) > len(y):
        x, y = y, x
    least = -(-percent * (len(x) + len(y)) // (100 + percent))  # the overlap that will do
    if len(x) < max(least, 1):
        return False
    at = y.searchsorted(x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)) >= least


def verified(pairs: DataFrame, known: DataFrame, decode: Decode, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (id, n, data) are similar, compared in full.

    An id that has several sets is similar where one of them is.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(k).to_pylist() for k in (2, 3)]
            distinct = {d: k for k, d in enumerate(dict.fromkeys(sides[0] + sides[1]))}
            sets = decode(list(distinct))
            keep = [alike(sets[distinct[x]], sets[distinct[y]], percent) for x, y in zip(*sides, strict=True)]
            chosen = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema)
            yield chosen.filter(pa.array(keep, pa.bool_()))

    one = known.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("data").alias("da"))
    two = known.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("data").alias("db"))
    both = pairs.join(one, "a").join(two, "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return both.select("a", "b", "da", "db").mapInArrow(run, "a long, b long")


def _spans(batches: Iterator[pa.RecordBatch], decode: Decode) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ids, components and sets."""
    for batch in batches:
        ids, comps, data = (batch.column(k).to_pylist() for k in range(3))
        for start in range(0, len(ids), 256):
            yield from zip(ids[start : start + 256], comps[start : start + 256], decode(data[start : start + 256]), strict=True)


def joined(members: DataFrame, decode: Decode, percent: int, listed: int = LISTED) -> DataFrame:
    """Pairs (a, b) of members (id, component, data) of different components, with none left out whose similarity is percent.

    Two such sets, in any one order of shingles, have a common one among the first n - ceil(n *
    percent / 100) + 1 of each. The rarest come first, so that copies of a text, edited too
    much to be similar, don't meet at what all of them hold. What meets is ruled out by length, by
    what is left from the common place on, and by parities of hashed shingles, of which no more
    differ than shingles do. Shingles meet by bucket, as runs of longs; those of more than `listed` members are joined by Spark.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(COUNTERS, np.int64)
        for _, _, x in _spans(batches, decode):
            found[x % np.uint64(COUNTERS)] += 1  # twice in a set counts once, as order alone matters
        slots = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(found[slots])], names=["slot", "n"])

    counted = members.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(COUNTERS, np.int64)
    often[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    held = members.sparkSession.sparkContext.broadcast(often)
    names = ["token", "id", "component", "at", "n", *[f"p{k}" for k in range(PARITY)]]
    buckets = max(64, members.count() // MEMBERS)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = held.value

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            bucket = (mix(rows[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[:, order], bucket[order]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            runs = [rows[:, i:j].tobytes() for i, j in zip(at, [*at[1:], len(bucket)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(runs, pa.binary())], names=["bucket", "rows"])

        parts: list[np.ndarray] = []
        size = 0
        for i, c, x in _spans(batches, decode):
            n = len(x)
            seen = frequency[x % np.uint64(COUNTERS)]
            order = np.lexsort((x, seen))[: n - -(-n * percent // 100) + 1]
            # what no other member holds can't be met
            places = np.flatnonzero(seen[order] > 1)
            if not len(places):
                continue
            row = np.empty((len(names), len(places)), np.int64)
            row[0], row[1], row[2], row[3], row[4] = x[order[places]].view(np.int64), i, c, places, n
            row[5:] = parities(x)[:, None]
            parts.append(row)
            size += len(places)
            if size >= BLOCK:
                yield flush(np.concatenate(parts, 1))
                parts, size = [], 0
        if size:
            yield flush(np.concatenate(parts, 1))

    def meet(runs: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(x, np.int64).reshape(len(names), -1) for x in runs["rows"]], 1)
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        begins = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        size = np.diff(np.r_[begins, rows.shape[1]])
        several = np.minimum.reduceat(rows[2], begins) != np.maximum.reduceat(rows[2], begins)
        busy = rows[:, np.repeat(several & (size > listed), size)]
        pairs = close(rows[:, np.repeat(several & (size <= listed), size)], percent)
        found = pd.DataFrame(pairs, columns=["a", "b"]).drop_duplicates()
        out = pd.DataFrame(busy.T, columns=names).assign(listed=False, a=0, b=0)
        return pd.concat([out, found.assign(listed=True, **dict.fromkeys(names, 0))])[["listed", "a", "b", *names]]

    runs = members.mapInArrow(prefixes, "bucket long, rows binary")
    met = runs.groupBy("bucket").applyInPandas(meet, "listed boolean, " + ", ".join(f"{x} long" for x in ["a", "b", *names]))
    met = written(met, "shared")
    pairs, rows = met.filter("listed").select("a", "b"), met.filter("NOT listed").select(*names)
    if not rows.isEmpty():
        # of a token, the smaller components against all it has
        sizes = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
        largest = sizes.groupBy("token").agg(F.max(F.struct("size", "component")).alias("l"))
        minor = rows.join(largest, "token").filter("component <> l.component").drop("l")
        other = rows.select("token", *[F.col(x).alias(f"{x}2") for x in names[1:]])
        both = f"(({percent} * (n + n2) + {99 + percent}) DIV {100 + percent})"  # the least overlap that will do
        differ = " + ".join(f"bit_count(p{k} ^ p{k}2)" for k in range(PARITY))
        busy = minor.join(other, "token").filter(f"component <> component2 AND least(n - at, n2 - at2) >= {both} AND {differ} <= n + n2 - 2 * {both}")
        pairs = pairs.unionByName(busy.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")))
    found = written(pairs.distinct(), "pairs")
    forget(met)
    held.destroy()
    return found


def joined_with(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) with links (a, b) added to what comp (id, component) joins.

    Only the components that links touch are walked anew.
    """
    if comp is None:
        return written(components(links), "components")
    at = [comp.select(F.col("id").alias(s), F.col("component").alias(f"c{s}")) for s in ("a", "b")]
    over = links.join(at[0], "a", "left").join(at[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = written(components(over), "moved")
    renamed = moved.select(F.col("id").alias("component"), F.col("component").alias("_to"))
    return written(
        comp.join(renamed, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
        .unionByName(moved.join(comp.select("id"), "id", "left_anti")),
        "components",
    )


def linked(
    routed: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    decode: Decode,
    percent: int,
    look: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
) -> tuple[DataFrame | None, DataFrame]:
    """(components, sets): (id, component) of the ids that are linked, or None, and what fetch gave.

    routed is what route() gives for the band keys of all. fetch gets the ids that share a key
    with another and returns (id, n, data) of them, n shingles that decode reads from data. look may
    rule pairs out by their signatures.
    """
    met = written(shared_keys(routed), "met")
    crowded = met.filter("crowded").select(F.col("x").alias("key"), F.col("y").alias("id"))
    few = met.filter("NOT crowded").select(F.col("x").alias("a"), F.col("y").alias("b"))
    ids = met.select(F.explode(F.expr("CASE WHEN crowded THEN array(y) ELSE array(x, y) END")).alias("id")).distinct()
    ids = written(ids, "ids")
    known = written(fetch(ids), "known")
    forget(ids)
    open_ = written(crowded.join(crowded.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "id"), "open")
    links = written(verified(look(few.unionByName(with_centres(open_)).distinct()), known, decode, percent), "links")
    forget(met)
    comp = None if links.isEmpty() else joined_with(None, links)
    forget(links)
    tagged = open_ if comp is None else open_.join(comp, "id", "left")
    component = F.col("id") if comp is None else F.coalesce("component", "id")
    tagged = written(tagged.select("key", "id", component.alias("component")), "tagged")
    forget(open_)
    split = tagged.groupBy("key").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).filter("_x <> _y")
    left = tagged.join(split.select("key"), "key").select("id", "component").distinct().join(known, "id")
    members = written(left.select("id", "component", "data"), "members")
    forget(tagged)
    if not members.isEmpty():
        links = written(verified(joined(members, decode, percent), known, decode, percent), "links")
        if not links.isEmpty():
            comp = joined_with(comp, links)
        forget(links)
    forget(members)
    return comp, known
