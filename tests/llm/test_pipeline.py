"""The pipeline's stages, and the queries' SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from strandlens.llm import components as components_module
from strandlens.llm import minhash, pii, queries, quality
from strandlens.llm.components import components

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_stages_keep_columns_and_effects(spark, docs, rows):
    now, columns = docs, docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "").cache()
        assert now.columns == columns
        seen[name] = now.collect()
    assert len(seen["quality classifier"]) == quality.quality_scores(docs).where("kept").count()
    texts = [r.text for r in seen["near-duplicates"]]
    assert len(texts) == len(set(texts)) < len(rows)
    assert all(r.n_chars == len(r.text) for r in seen["personal data"])
    last = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in seen["mixing"]}


def test_stages_take_empty_tables(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


@needs_data
def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = minhash.keep_one(quality.keep_good(docs))
    assert corpus_pipeline.run(spark, DATA).select("doc_id").distinct().count() <= kept.count()
    masked = pii.surrogates(kept, "strandlens-surrogates-1", count_col=None)
    assert masked.count() == kept.count()


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    found = c.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(x) for x in columns]
    text = lambda r: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(text(r[x] for x in columns) for r in df.collect()) == sorted(text(r[i] for i in at) for r in found.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("nodes", [200_000, 0])
def test_components(spark, monkeypatch, nodes):
    monkeypatch.setattr(components_module, "BROADCAST_NODES", nodes)
    pairs = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(5, 5), (100, 3), (None, 4)]
    out = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a int, b int").repartition(5)).collect()}
    assert out == {**{i: i // 10 * 10 for i in range(40) if i % 10}, 100: 0}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0
