"""A table of the last change of each key, kept in files by bucket and readable as of a time.

Micro-batches append changes. Compaction folds what is not after its horizon into one row a key, and
rewrites only buckets that have something to fold; what came later stays as changes. A manifest names
the files of a state of the table, and is written last. The last change by the order columns counts, and how many there
were, whatever batches they came in.
"""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.sources import files

BUCKETS = 64


def _by_bucket(rows: DataFrame, path: str) -> None:
    """Writes rows with a few files for each bucket: small buckets share a task, and a large one is split."""
    rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)


class UpsertTable:
    """schema has the key, the order columns, of which the first is a change's time, and what changes. n is not among them."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str, order: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.order = spark, folder.rstrip("/"), schema, key, order
        self.empty = {"pending": [], "folded": -1, "current": {}, "recent": {}, "horizon": None, "buckets": buckets}

    def states(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in files.names(self.spark, f"{self.folder}/manifests") if n.endswith(".json") and n[0] != ".")

    def manifest(self, state: int | None = None) -> dict:
        state = max(self.states(), default=0) if state is None else state
        return json.loads(files.read(self.spark, f"{self.folder}/manifests/{state}.json")) if state else dict(self.empty)

    def _commit(self, manifest: dict) -> None:
        files.write_once(self.spark, f"{self.folder}/manifests/{max(self.states(), default=0) + 1}.json", json.dumps(manifest))

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Appends a batch's changes; a batch that is in already, as after a replay, changes nothing. Numbers of batches rise.

        Changes without a key or a time are left out.
        """
        found = self.manifest()
        if batch <= found["folded"] or batch in found["pending"]:
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(found["buckets"])).cast("int")
        rows = changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        rows = rows.filter(F.col(self.key).isNotNull() & F.col(self.order[0]).isNotNull()).withColumn("bucket", bucket)
        _by_bucket(rows, f"{self.folder}/changes/{batch}")
        self._commit(found | {"pending": [*found["pending"], batch]})

    def read(self, as_of: dt.datetime | None = None, state: int | None = None) -> DataFrame:
        """One row per key: its last change not after as_of, and n, how many changes there were until then.

        Times before the horizon of the last compaction are an error. state asks for an earlier manifest. Only keys that
        have changed since the compaction are grouped; the others are read as they lie.
        """
        found = self.manifest(state)
        if as_of is not None and found["horizon"] is not None and as_of < dt.datetime.fromisoformat(found["horizon"]):
            raise ValueError(f"{as_of} is before {found['horizon']}, until when changes are folded")
        return self._folded(self._current(found), self._changes(found), as_of)

    def compact(self, horizon: dt.datetime) -> int:
        """Folds changes until horizon and gives the number of buckets that are rewritten."""
        found = self.manifest()
        if found["horizon"] is not None and horizon < dt.datetime.fromisoformat(found["horizon"]):
            raise ValueError(f"the table is folded until {found['horizon']} already")
        state, changes = max(self.states(), default=0) + 1, self._changes(found)
        touched = set(found["recent"]).union(*[self._written("changes", batch) for batch in found["pending"]])
        mine = F.col("bucket").isin([int(b) for b in touched])
        current = self._folded(self._current(found).filter(mine), changes, horizon)
        _by_bucket(current, f"{self.folder}/current/{state}")
        _by_bucket(changes.filter(self._time() > F.lit(horizon)), f"{self.folder}/recent/{state}")
        for kind in ("current", "recent"):
            written = self._written(kind, state)
            kept = {b: v for b, v in found[kind].items() if b not in touched}
            found[kind] = kept | dict.fromkeys(sorted(written), state)
        self._commit(found | {"pending": [], "folded": max([found["folded"], *found["pending"]]), "horizon": horizon.isoformat()})
        return len(touched)

    def _written(self, kind: str, version: int) -> set[str]:
        """The buckets that rows were written of."""
        return {n.split("=")[1] for n in files.names(self.spark, f"{self.folder}/{kind}/{version}") if n.startswith("bucket=")}

    def _time(self) -> Column:
        return F.col(self.order[0])

    def _current(self, found: dict) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("n", T.LongType()), T.StructField("bucket", T.IntegerType())])
        return self._parts("current", found["current"], schema)

    def _changes(self, found: dict) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        parts = [self._parts("recent", found["recent"], schema)]
        for batch in found["pending"]:
            if self._written("changes", batch):
                parts.append(self.spark.read.schema(schema).parquet(f"{self.folder}/changes/{batch}"))
        return reduce(DataFrame.unionByName, parts)

    def _parts(self, kind: str, versions: dict, schema: T.StructType) -> DataFrame:
        by_version: dict[int, list[str]] = {}
        for bucket, version in versions.items():
            by_version.setdefault(version, []).append(f"{self.folder}/{kind}/{version}/bucket={bucket}")
        parts = [self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}/{v}").parquet(*paths) for v, paths in by_version.items()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _folded(self, current: DataFrame, changes: DataFrame, as_of: dt.datetime | None) -> DataFrame:
        names = [n for n in self.schema.names if n != self.key]
        rank = F.struct(*[F.col(c) for c in self.order])
        until = changes if as_of is None else changes.filter(self._time() <= F.lit(as_of))
        # where the order names all columns its greatest value is the last change
        last = F.max_by(F.struct(*names), rank) if set(names) - set(self.order) else F.max(rank)
        new = until.groupBy("bucket", self.key).agg(last.alias("_new"), F.count(F.lit(1)).alias("_n"))
        # one join for changed, unchanged and new keys, so that changes are read and grouped once
        both = current.join(new, ["bucket", self.key], "full")
        later = F.col("_new").isNotNull() & (F.col("n").isNull() | (F.struct(*[F.col(f"_new.{c}") for c in self.order]) > rank))
        return both.select(
            self.key, *[F.when(later, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in names],
            (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"), "bucket",
        )
