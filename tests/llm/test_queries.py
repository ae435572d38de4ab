"""The registered queries against their SQL, and the pipeline's stages one by one."""

import zlib

import pytest

import corpus_pipeline
from ledgerlark.llm import registry
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    assert rows_of(registry.QUERIES[name](spark, sf_dir).toPandas()) == duck(registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_answers_for_every_row(name, spark, sf_dir):
    table, key = ("pages", "page_id") if name.startswith("op3_") else ("documents", "doc_id")
    rows = registry.QUERIES[name](spark, sf_dir).select(key).distinct().count()
    assert rows == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_pipeline_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            docs = out
    assert out.select("doc_id").distinct().count() == docs.count()
    assert all(zlib.crc32(b"") != r.ids_crc32 for r in out.collect())
