"""Synthetic reads, records and alignments over the order lines, in SQL that Spark and other engines
evaluate alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEX = "'0123456789abcdef','ACGTACGTACGTACGT'"
_ID = "concat('r',cast(l_orderkey as varchar(20)),'.',cast(l_linenumber as varchar(20)),'.',cast(l_partkey as varchar(20)),'.',cast(l_suppkey as varchar(20)))"

READS = f"""
SELECT {_ID} AS read_id, concat('chr',cast(l_suppkey % 5 as varchar(20))) AS contig, cast((l_partkey % 40)*10 as int) AS pos,
  l_returnflag = 'R' AS is_reverse, cast(l_quantity as int) % 4 * 10 AS mapq, concat('G',cast(l_partkey % 20 as varchar(20))) AS gene,
  translate(substr(md5(cast(l_suppkey % 12 as varchar(40))),1,6),{_HEX}) AS cell,
  CASE WHEN l_orderkey % 10 < 7 THEN translate(substr(md5(cast(l_orderkey % 6 as varchar(40))),1,4),{_HEX})
       ELSE translate(substr(md5(cast(l_orderkey % 211 as varchar(40))),1,4),{_HEX}) END AS umi,
  cast(l_linenumber % 3 + 1 as int) AS nh, CASE WHEN l_linenumber % 2 = 0 THEN 'U' ELSE 'R' END AS xt
FROM lineitem"""

RECORDS = f"""
SELECT read_id, seq, quals, concat(read_id, ' sample=', cast(n as varchar(20))) AS identifier FROM (
  SELECT {_ID} AS read_id, l_linenumber AS n, translate(md5({_ID}),{_HEX}) AS seq, translate(md5(concat({_ID},'q')),'0123456789abcdef','!*5?I#+6@H$,7AGF') AS quals FROM lineitem) x"""

#: Shapes of alignments, chosen by line number: plain, clipped, spliced and both.
CIGARS = ("30M", "5S25M", "20M100N10M", "25M5S", "3S10M50N15M2S", "10M2I5M3D13M", "2H28M")
ALIGNMENTS = f"""
SELECT read_id, contig, pos, is_reverse, mapq, cigar, flag, rnext, pnext, umi, gene FROM (
  SELECT {_ID} AS read_id, concat('chr',cast(l_suppkey % 5 as varchar(20))) AS contig, cast((l_partkey % 40)*10 as int) AS pos, l_returnflag = 'R' AS is_reverse,
    cast(l_quantity as int) % 4 * 10 AS mapq, CASE l_linenumber % 7 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CIGARS))} END AS cigar,
    cast(1 + CASE WHEN l_orderkey % 11 = 0 THEN 4 ELSE 0 END + CASE WHEN l_orderkey % 13 = 0 THEN 8 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END
      + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END - CASE WHEN l_orderkey % 17 = 0 THEN 1 ELSE 0 END as int) AS flag,
    concat('chr',cast((l_suppkey + CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END) % 5 as varchar(20))) AS rnext, cast(((l_partkey + 7) % 40)*10 as int) AS pnext,
    CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE translate(substr(md5(cast(l_orderkey % 211 as varchar(40))),1,4),{_HEX}) END AS umi,
    CASE WHEN l_partkey % 23 = 0 THEN '__ambiguous' WHEN l_partkey % 29 = 0 THEN '' WHEN l_partkey % 31 = 0 THEN NULL ELSE concat('G',cast(l_partkey % 20 as varchar(20))) END AS gene
  FROM lineitem) x"""


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, READS)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, RECORDS)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALIGNMENTS in the columns of an alignment, the UMI and gene as tags."""
    x = _view(spark, sf_dir, ALIGNMENTS)
    tags = F.map_filter(F.create_map(F.lit("RX"), "umi", F.lit("XF"), "gene"), lambda k, v: v.isNotNull())
    return x.select(
        F.col("read_id").alias("qname"), "flag", F.col("contig").alias("rname"), "pos", "mapq", "cigar", F.when(F.col("rnext") == F.col("contig"), "=").otherwise(F.col("rnext")).alias("rnext"),
        "pnext", F.lit(0).alias("tlen"), F.lit("*").alias("seq"), tags.alias("tags"),
    )


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """READS in the columns of an alignment: the read's name ends with the UMI, its gene, cell and
    hit counts are tags."""
    x = reads(spark, sf_dir)
    tags = F.create_map(F.lit("RX"), "umi", F.lit("CB"), "cell", F.lit("XF"), "gene", F.lit("NH"), F.col("nh").cast("string"), F.lit("XT"), "xt")
    return x.select(
        F.concat_ws("_", "read_id", "umi").alias("qname"), F.when(F.col("is_reverse"), 16).otherwise(0).alias("flag"), F.col("contig").alias("rname"), "pos", "mapq", F.lit("30M").alias("cigar"),
        F.lit("*").alias("rnext"), F.lit(-1).alias("pnext"), F.lit(0).alias("tlen"), F.lit("*").alias("seq"), tags.alias("tags"), "read_id",
    )
