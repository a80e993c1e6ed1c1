"""The pipeline's stages on awkward rows, and every query against its twin or its contract."""

import duckdb
import pytest
from helpers import AWKWARD, documents

import corpus_pipeline
from kerbstone.llm import oracles, queries

SMALL = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_takes_awkward_rows(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    for rows in (AWKWARD, []):
        docs = documents(spark, rows)
        found = run(spark, docs, SMALL)
        assert stage == "packing" or found.columns == docs.columns
        assert (found.count() > 0) == bool(rows)


def test_pipeline_runs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = corpus_pipeline.run(spark, SMALL)
    ids = {r.doc_id for r in found.select("doc_id").distinct().collect()}
    assert 0 < len(ids) < docs.count()
    ends = found.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] <= 4096 for r in ends)
    assert len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    found = queries.REGISTRY[name](spark, SMALL)
    wanted = duck.sql(oracles.ORACLES[name])
    order = sorted(found.columns)
    assert order == sorted(wanted.columns)
    rows = sorted(tuple(str(r[c]) for c in order) for r in found.collect())
    names = wanted.columns
    twin = sorted(tuple(str(r[names.index(c)]) for c in order) for r in wanted.fetchall())
    assert rows == twin


def test_all_operators_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.REGISTRY)
    assert numbers == list(range(1, 14))
