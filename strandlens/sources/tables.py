"""Small text tables: gene maps, read-to-gene tables, whitelists and blacklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tsv(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    lines = spark.read.text(path)
    if comments:
        lines = lines.where(~F.col("value").startswith("#"))
    return lines.where(F.trim("value") != "").select(F.split(F.rtrim("value"), "\t").alias("f"))


def gene_map(spark: SparkSession, path: str, contigs: list[str] | None = None) -> DataFrame:
    """gene, transcript; # lines and blank ones are skipped, and transcripts not among the contigs.
    A transcript listed under several genes belongs to the first by name."""
    rows = _tsv(spark, path).select(F.col("f")[0].alias("gene"), F.col("f")[1].alias("transcript"))
    if contigs is not None:
        rows = rows.where(F.col("transcript").isin(*contigs))
    return rows.groupBy("transcript").agg(F.min("gene").alias("gene")).select("gene", "transcript")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """read_id, gene of a table of exactly two columns."""
    rows = _tsv(spark, path, comments=False)
    two = F.when(F.size("f") == 2, F.col("f")[1]).otherwise(F.raise_error(F.lit("a line doesn't have two columns")).cast("string"))
    return rows.select(F.col("f")[0].alias("read_id"), two.alias("gene"))


def barcode_list(spark: SparkSession, path: str, path2: str | None = None) -> DataFrame:
    """barcode: the first column; with a second file every barcode of the first before every one of
    the second, which is meant for short lists."""
    one = _tsv(spark, path).select(F.col("f")[0].alias("barcode"))
    return products(one, _tsv(spark, path2).select(F.col("f")[0].alias("barcode"))) if path2 else one


def products(one: DataFrame, two: DataFrame, limit: int = 20_000) -> DataFrame:
    """Barcodes put together from both lists. The second, of a checked size, goes to every row of
    the first as one broadcast array."""
    second = two.select(F.col("barcode").alias("second")).distinct()
    if second.limit(limit + 1).count() > limit:
        raise ValueError(f"the second list has more than {limit} barcodes")
    listed = second.agg(F.collect_list("second").alias("_all")).withColumn("_key", F.lit(0))
    both = one.withColumn("_key", F.lit(0)).join(F.broadcast(listed), "_key")
    return both.select("barcode", F.explode("_all").alias("second")).select(F.concat("barcode", "second").alias("barcode"))


def whitelist_fixes(spark: SparkSession, path: str) -> DataFrame:
    """error, barcode of a whitelist whose second column lists the barcodes to correct."""
    rows = _tsv(spark, path).select(F.col("f")[0].alias("barcode"), F.try_element_at("f", F.lit(2)).alias("errors"))
    return rows.where("errors <> ''").select(F.explode(F.split("errors", ",")).alias("error"), "barcode")


def blacklist(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, comments=False).select(F.col("f")[0].alias("barcode"))


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", str(header).lower()).option("quote", "").option("emptyValue", "").csv(path)
