"""Clustering against brute force in whole numbers, and its edge cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from ledgerlark.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, cluster int, v string, distance string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 9, "v", None) for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(3)


def brute(ids, vectors, count, rounds):
    kept = [
        (i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in zip(ids, vectors, strict=True)
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:count]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v)[1], []).append(v)
        centroids = [tuple(sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)) if k in groups else c for k, c in enumerate(centroids)]
    found = [(i, *best(v)) for i, v in kept]
    sums = {k: sum(d for _, d, x in found if x == k) for k in range(count)}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, k, d, sums[k], sum(sums.values()), names[k]) for i, d, k in found], key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def vectors_of(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in rng.normal(rng.integers(-2, 3), spread, 64)] for _ in range(n)]


@pytest.mark.parametrize(("n", "rounds"), [(60, 10), (60, 1), (5, 10), (9, 3), (60, 0)])
def test_equals_brute_force(spark, n, rounds):
    vectors = vectors_of(n, n)
    assert rows(clustering.cluster(frame(spark, vectors), rounds=rounds)) == brute(range(n), vectors, 8, rounds)


def test_what_is_left_out_and_what_repeats(spark):
    good = vectors_of(12, 3)
    odd = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.1] * 63, [math.nan] * 64, [0.1] * 63 + [math.inf], [-math.inf] * 64]
    vectors = good + good[:4] + [good[0]] * 5 + odd
    ids = [*range(12), *range(4), None, None, 7, 7, 7, *range(50, 58)]
    assert rows(clustering.cluster(frame(spark, vectors, ids))) == brute(ids, vectors, 8, 10)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    vectors = [[1.0] * 64] * 10 + [[-1.0] * 64] * 3 + [[0.0] * 64]
    got = clustering.cluster(frame(spark, vectors))
    assert rows(got) == brute(range(14), vectors, 8, 10)


def test_nothing_kept(spark):
    out = clustering.cluster(frame(spark, [[1.0], None]))
    assert (out.count(), out.columns) == (0, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
    assert clustering.cluster(frame(spark, [[1.0] * 64]).limit(0)).count() == 0


def test_components_out_of_range_are_an_error(spark):
    with pytest.raises(PySparkException, match="beyond"):
        clustering.cluster(frame(spark, [[1e30] * 64])).count()


def test_no_python_in_the_plan(spark, sf_dir):
    plan = clustering.op13_centroid_clustering(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
