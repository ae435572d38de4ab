"""Versions of models in a folder that jobs and streams share.

A version is what its manifest names: the folders of forests, of which a user's last one counts, and
one population model with its defaults. Data is written first and the manifest last, so that a version
is there as a whole or not at all, and old versions stay readable.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators.models import TREE_SCHEMA
from ledgerlark.sources import files
from ledgerlark.sources import tables as S

#: Parts of the forests by user, of which a micro-batch reads those of its users.
BUCKETS = 64


class ModelRegistry:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._models: dict[int, PipelineModel] = {}

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in files.names(self.spark, f"{self.folder}/manifests") if n.endswith(".json") and n[0] != ".")

    def latest(self) -> int:
        """The last published version; 0 before the first one."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        if not version:
            return {"forests": [], "population": None, "buckets": self.buckets}
        return json.loads(files.read(self.spark, f"{self.folder}/manifests/{version}.json"))

    def publish(self, forests: DataFrame | None = None, population: PipelineModel | None = None, defaults: DataFrame | None = None, only: bool = False) -> int:
        """A new version with what is given; the rest stays as in the version before.

        forests are trees as models.train_forests() gives them: they take the place of their users' earlier ones,
        or with only of all earlier ones. A version that another job publishes meanwhile is an error.
        """
        version = self.latest() + 1
        found = self.manifest(version - 1)
        if forests is not None:
            at = f"{self.folder}/forests/{version}"
            # small buckets share a task, and a large one is split
            forests.withColumn("bucket", self._bucket(found)).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(at)
            written = self._nodes([version])
            if written is not None:
                written.groupBy("user_id").agg(F.first("n_rows").alias("n_rows"), F.first("offset").alias("offset")).write.mode("overwrite").parquet(
                    f"{self.folder}/trained/{version}"
                )
                found["forests"] = [version] if only else [*found["forests"], version]
        if population is not None:
            S.save_model(population, f"{self.folder}/population/{version}")
            S.save_metadata(defaults, f"{self.folder}/defaults/{version}")
            found["population"] = version
        files.write_once(self.spark, f"{self.folder}/manifests/{version}.json", json.dumps(found))
        return version

    def compact(self) -> int:
        """A version that says the same with all forests in one folder."""
        last = self.latest()
        return self.publish(forests=self.forests(last), only=True)

    def trained(self, version: int | None = None) -> DataFrame:
        """user_id, n_rows that the user's last forest was trained on, its offset, and the version it came with."""
        parts = [
            self.spark.read.schema("user_id long, n_rows long, offset double").parquet(f"{self.folder}/trained/{v}").withColumn("version", F.lit(v))
            for v in self.manifest(self.latest() if version is None else version)["forests"]
        ]
        if not parts:
            return self.spark.createDataFrame([], "user_id long, n_rows long, offset double, version int")
        last = F.max_by(F.struct("n_rows", "offset", "version"), "version")
        return reduce(DataFrame.unionByName, parts).groupBy("user_id").agg(last.alias("t")).select("user_id", "t.*")

    def forests(self, version: int, users: DataFrame | None = None) -> DataFrame | None:
        """The trees of each user's last forest at a version, or of users (user_id) alone; None without any.

        Of users only the buckets are looked up, of which there are few, so that other files aren't read.
        """
        found = self.manifest(version)
        nodes = self._nodes(found["forests"])
        if nodes is None:
            return None
        last = self.trained(version).select("user_id", "version")
        if users is not None:
            wanted = users.select("user_id").distinct()
            buckets = [r[0] for r in wanted.select(self._bucket(found).alias("b")).distinct().collect()]
            nodes, last = nodes.filter(F.col("bucket").isin(buckets)), last.join(wanted, "user_id", "left_semi")
        return nodes.join(last, ["user_id", "version"]).drop("bucket", "version")

    def population(self, version: int) -> tuple[PipelineModel, DataFrame] | None:
        """The population model of a version and its defaults, in the order of its columns."""
        at = self.manifest(version)["population"]
        if at is None:
            return None
        if at not in self._models:
            self._models[at] = S.load_model(self.spark, f"{self.folder}/population/{at}")
        return self._models[at], S.load_metadata(self.spark, f"{self.folder}/defaults/{at}")

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64("user_id"), F.lit(manifest["buckets"])).cast("int")

    def _nodes(self, versions: list[int]) -> DataFrame | None:
        parts = [
            self.spark.read.schema(f"{TREE_SCHEMA}, bucket int").parquet(f"{self.folder}/forests/{v}").withColumn("version", F.lit(v))
            for v in versions if any(n.startswith("bucket=") for n in files.names(self.spark, f"{self.folder}/forests/{v}"))
        ]
        return reduce(DataFrame.unionByName, parts) if parts else None
