"""Every query against its SQL, and the ones without SQL against what must hold of them."""

import pytest

from ledgerlark.plans import queries as q
from ledgerlark.plans import research, services  # noqa: F401  register the rest
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    mine = rows_of(q.QUERIES[name](spark, sf_dir).toPandas())
    theirs = duck(q.SQL[name])
    assert mine == theirs
    assert mine[1], "a query without rows shows nothing"


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1000


def test_bootstrap_holds_the_rate(spark, sf_dir):
    row = q.bootstrap_ci(spark, sf_dir).first()
    assert row.low <= row.mean <= row.high


def test_forest_scores(spark, sf_dir):
    got = q.user_forest_scores(spark, sf_dir).toPandas()
    assert len(got) == 1000
    assert got["personal"].between(0.269, 0.731).all()
    share = got["personal_anomaly"].mean()
    assert 0 < share < 0.2
    again = q.user_forest_scores(spark, sf_dir).toPandas()
    assert got.sort_values("event_id").reset_index(drop=True).equals(again.sort_values("event_id").reset_index(drop=True))


def test_population_scores(spark, sf_dir):
    got = q.gbt_scores(spark, sf_dir, rounds=5).toPandas()
    assert got["population"].between(0, 1).all()


def test_reasons_name_features(spark, sf_dir):
    from ledgerlark.operators.behaviour import FEATURES

    got = q.reason_codes(spark, sf_dir).toPandas()
    assert set(got["first"]) <= set(FEATURES)


@pytest.mark.parametrize("name", ["stream_daily_counts", "stream_features"])
def test_streams_of_many_shuffled_files(name, spark, sf_dir, duck, tmp_path):
    """Over the files of one micro-batch, out of order of time."""
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(40, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    conf = {
        "spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "64k",
        "spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        mine = rows_of(q.QUERIES[name](spark, str(tmp_path)).toPandas())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert mine == duck(q.SQL[name])
