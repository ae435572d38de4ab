"""Clustering around integer centroids, in JVM expressions alone.

Vectors become integers, so that sums and distances are exact whatever order tasks end in.
Each round reads the written vectors once: distances to centroids are expressions over literal
arrays, the least (distance, number) names the cluster, and partial column sums, of which each
task sends one row for a cluster, move the centroids. Only those sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import forget, table, written

DIMENSIONS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SALT = 3
#: Larger components than this would take squared distances out of a long.
LARGEST = 1 << 17


def integer_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) for each component x, of the rows that are kept.

    A row is kept if its vector has exactly so many components, none null, NaN or infinite. A
    component beyond LARGEST is an error: its distances might not be told in a long. Other columns are left out.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    large = F.exists("embedding", lambda x: F.abs(x) > LARGEST)
    vector = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    return (
        embeddings.select("vec_id", "embedding").filter((F.size("embedding") == dimensions) & finite)
        .select("vec_id", F.when(large, F.raise_error(F.lit(f"a component is beyond {LARGEST}"))).otherwise(vector).alias("v"))
    )


def _array(centroid: Sequence[int]) -> Column:
    return F.array(*(F.lit(x).cast("long") for x in centroid))


def nearest(vector: Column, centroids: Sequence[Sequence[int]]) -> Column:
    """A struct of the least squared distance and, of centroids at that distance, the least number."""

    def distance(centroid: Sequence[int]) -> Column:
        squares = F.zip_with(vector, _array(centroid), lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, x: total + x)

    return F.array_min(F.array(*(F.struct(distance(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids))))


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, salt: int = SALT) -> list[list[int]]:
    """The vectors of least sha256 of `salt:vec_id`, in that order; null ids come last, and equal ids in order of their vectors."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in vectors.orderBy(key.asc_nulls_last(), "v").limit(count).select("v").collect()]


def moved(vectors: DataFrame, centroids: Sequence[Sequence[int]]) -> list[list[int]]:
    """Each centroid as the floor of its vectors' mean; one without vectors stays."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
    rows = vectors.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    out = [list(c) for c in centroids]
    for r in rows:
        out[r.cluster] = [s // r.n for s in r[2:]]
    return out


def fit(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, salt: int = SALT) -> list[list[int]]:
    """The centroids after so many rounds; when a round moves none, neither would the rest, and it ends."""
    centroids = first_centroids(vectors, count, salt)
    for _ in range(rounds if centroids else 0):
        before, centroids = centroids, moved(vectors, centroids)
        if before == centroids:
            break
    return centroids


def cluster(
    embeddings: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, salt: int = SALT
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Repeated rows count each, and a null vec_id stays null. Of fewer vectors than count, each is a
    centroid. An empty table, or one of which nothing is kept, gives an empty result. Squared distances' sums beyond a long are an error.
    """
    vectors = written(integer_vectors(embeddings, dimensions, scale), "vectors")
    centroids = fit(vectors, count, rounds, salt)
    # without centroids there are no rows, but there have to be columns
    best = nearest(F.col("v"), centroids or [[0] * dimensions])
    found = written(vectors.select("vec_id", best.alias("best")).select("vec_id", "best.cluster", "best.distance"), "assigned")
    forget(vectors)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def of_cluster(values: Sequence[object], kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1) if values else F.lit(None).cast(kind)

    return found.select(
        "vec_id", "cluster", "distance", of_cluster([sums.get(k, 0) for k in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), of_cluster(names, "string").alias("centroid_sha256"),
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS k, v
  FROM kept ORDER BY sha256('{SALT}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v LIMIT {CENTROIDS})""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""d{i} AS MATERIALIZED (
  SELECT r, vec_id, kept.v, min({CENTROIDS} * CAST(list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (kept.v[i] - c.v[i]) * (kept.v[i] - c.v[i]))) AS HUGEINT) + k) AS m
  FROM kept, c{i} AS c GROUP BY r, vec_id, kept.v),
a{i} AS MATERIALIZED (SELECT r, vec_id, v, m % {CENTROIDS} AS k, m // {CENTROIDS} AS d FROM d{i})"""
        )
        if i < ROUNDS:
            steps.append(
                f"""m{i} AS MATERIALIZED (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
  FROM (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, {DIMENSIONS + 1}) AS t(i) GROUP BY k, i) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN m{i} AS m ON c.k = m.k)"""
            )
    last = ROUNDS
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{last} AS a JOIN c{last} AS c ON a.k = c.k"""


SQL = _sql()
