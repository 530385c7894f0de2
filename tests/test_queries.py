"""Every query with SQL gives what the SQL gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandlens.plans import queries as barcode

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
TABLES = "region nation customer supplier part orders lineitem events".split()


def canon(rows):
    return sorted(tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(barcode.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = barcode.QUERIES[name](spark, DATA)
    found = duck.sql(barcode.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert canon([tuple(r[c] for c in columns) for r in df.collect()]) == canon([tuple(r[i] for i in at) for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(set(barcode.QUERIES) - set(barcode.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert barcode.QUERIES[name](spark, DATA).count() > 0


def test_templates_are_numbered_apart(spark):
    """No stage of pair_templates brings all reads into one task."""
    plan = barcode.QUERIES["pair_templates"](spark, DATA)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(l_orderkey" in plan


@pytest.mark.parametrize("name", ["fastq_round_trip", "fastq_gzip_round_trip", "first_n_reads", "strict_pairs", "whitelist_first_n_found"])
def test_files_grow_in_number(spark, duck, monkeypatch, name):
    """More records are more files, not larger ones, with the same rows."""
    read, found = barcode.fastq.read_fastq, []
    monkeypatch.setattr(barcode, "_A_FILE", 1000, raising=False)
    monkeypatch.setattr(barcode.fastq, "read_fastq", lambda spark, path: found.append(len(spark.read.text(path).inputFiles())) or read(spark, path))
    test_query_equals_sql(spark, duck, name)
    records = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert found and all(n >= records / 1000 > 3 for n in found)


def test_entry(spark):
    assert entry.entry(spark).columns == ["gene", "count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
