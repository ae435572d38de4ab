"""The graph of accounts and devices, without ever listing the pairs of accounts that share a device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.sources.steps import written

#: Registers of a sketch are 2 ** SKETCH: 0.8 % is the standard error at 14, and some thousand accounts are told exactly.
SKETCH = 14


def accounts_met(edges: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """account and met: how many other accounts share a device with it, each counted once.

    edges (account, device). Each device has a sketch of its accounts and each account unites its devices'
    sketches, so that work follows the edges, whatever a device's accounts number.
    """
    distinct = edges.filter("account IS NOT NULL AND device IS NOT NULL").select("account", "device").distinct()
    of_device = distinct.groupBy("device").agg(F.hll_sketch_agg("account", F.lit(sketch)).alias("s"))
    return distinct.join(of_device, "device").groupBy("account").agg((F.hll_sketch_estimate(F.hll_union_agg("s")) - 1).alias("met"))


def components(links: DataFrame, folder: str) -> DataFrame:
    """node and component, the least node that it reaches over links (a, b), of every node that is linked.

    Each round hangs larger neighbours on the least one (large star) and smaller ones too (small star), and is
    written, until nothing moves. Links stay linear in number, and minima are taken before rows are sent.
    """
    found = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    found, before, step = written(found, f"{folder}/0"), None, 0
    print_of = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    while before != (now := tuple(found.agg(*print_of).first())):
        before, step = now, step + 1
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        found = written(small.distinct(), f"{folder}/{step}")
    roots = found.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def shared(edges: DataFrame, key: str = "device") -> DataFrame:
    """Links (a, b) that join all accounts of a key: each with the least of them, so as many as edges."""
    rows = edges.filter(F.col("account").isNotNull() & F.col(key).isNotNull()).select("account", key).distinct()
    least = rows.groupBy(key).agg(F.min("account").alias("b"))
    return rows.join(least, key).filter("account <> b").select(F.col("account").alias("a"), "b")


def rings(edges: DataFrame, folder: str) -> DataFrame:
    """account, ring (its least account) and ring_size, of every account; one that shares nothing is a ring of its own."""
    found = components(shared(edges), folder)
    accounts = edges.filter("account IS NOT NULL").select("account").distinct()
    own = accounts.join(found.withColumnRenamed("node", "account"), "account", "left").select("account", F.coalesce("component", "account").alias("ring"))
    sizes = own.groupBy("ring").agg(F.count(F.lit(1)).alias("ring_size"))
    return own.join(sizes, "ring").select("account", "ring", "ring_size")


def propagated(edges: DataFrame, seeds: DataFrame, folder: str, rounds: int = 3, share: float = 0.5) -> DataFrame:
    """account and risk: fraud that is known (seeds: account, fraud from 0 to 1), carried over devices.

    In each round a device has the mean of its accounts' risk, and an account keeps 1 - share of its own seed, 0
    where there is none, and takes share of the mean of its devices. An account without a device keeps what it has.
    """
    # the rounds read the edges again and again
    kept = written(edges.filter("account IS NOT NULL").select("account", "device").distinct(), f"{folder}/edges")
    distinct, accounts = kept.filter("device IS NOT NULL"), kept.select("account").distinct()
    known = seeds.groupBy("account").agg(F.max("fraud").cast("double").alias("seed"))
    start = written(accounts.join(known, "account", "left").select("account", F.coalesce("seed", F.lit(0.0)).alias("seed")), f"{folder}/seeds")
    risk = start.select("account", F.col("seed").alias("risk"))
    for k in range(rounds):
        devices = distinct.join(risk, "account").groupBy("device").agg(F.avg("risk").alias("mean"))
        around = distinct.join(devices, "device").groupBy("account").agg(F.avg("mean").alias("around"))
        moved = start.join(around, "account", "left")
        risk = written(moved.select("account", F.coalesce((1 - share) * F.col("seed") + share * F.col("around"), "seed").alias("risk")), f"{folder}/risk{k}")
    return risk


def customers(records: DataFrame, anchors: dict[str, list[str]], key: str, folder: str) -> DataFrame:
    """key and customer_id, the least key among records that anchors link, directly or over others.

    An anchor names columns; records with equal values in all of them are one customer's. A record with a null among an
    anchor's columns isn't linked by it.
    """
    parts = [
        F.when(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0, F.sha2(F.concat_ws("~", F.lit(name), *[F.col(c).cast("string") for c in columns]), 256))
        for name, columns in anchors.items()
    ]
    edges = records.select(F.col(key).alias("account"), F.explode(F.array(*parts)).alias("device"))
    found = rings(edges, folder)
    return found.select(F.col("account").alias(key), F.col("ring").alias("customer_id"))


def account_start(day: str, counter: str) -> Column:
    """The day on which an account began, from a record's day and the days that its counter has run."""
    return F.date_sub(F.col(day), F.col(counter).cast("int"))
