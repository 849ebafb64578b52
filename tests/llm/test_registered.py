"""Registered queries against their SQL at the smallest scale."""

import pytest

import corpus_pipeline
from auditlake.llm.oracle import ORACLE
from auditlake.llm.queries import QUERIES
from tools.check_queries import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict, rows = compare(spark, con, SF_DIR, name)
    assert verdict == ("equal" if name in ORACLE else "rows only")
    assert rows > 0


def test_pipeline_stages(spark, con):
    """Each stage on what the stage before kept; columns stay, nothing is invented."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and ids
        docs = spark.createDataFrame(kept.toPandas(), docs.schema)
    # No two of what is left are near copies.
    sets = {}
    for r in docs.collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in last.collect()} == set(sets)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            assert not both or 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both)


def test_pipeline_catches_and_keeps(spark, docs):
    """Toxic documents and copies go, clean ones stay, by the stages in turn."""
    real = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    twice = real.union(real.limit(5).withColumn("doc_id", real.doc_id + 1_000_000))
    deduped = corpus_pipeline.drop_repeated_lines(spark, twice, SF_DIR)
    left = corpus_pipeline.drop_near_copies(spark, deduped, SF_DIR)
    assert left.filter("doc_id >= 1000000").count() == 0


def test_empty_pipeline(spark, docs, tmp_path):
    real = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, real, SF_DIR)
        assert out.count() == 0, name
