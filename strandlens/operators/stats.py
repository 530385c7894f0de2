"""Statistics of deduplication: barcodes before and after, and how near they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.barcodes import hashed_number
from ..functions.distance import mean_distance
from .order import numbered


def after_grouping(groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, umi, n of the representatives, n the reads of their groups."""
    return groups.groupBy(*keys, F.col("rep").alias("umi")).agg(F.sum("n").alias("n"))


def per_position_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """counts, instances_pre, instances_post: how often a barcode has a count at a position."""
    pre = before.groupBy(F.col("n").alias("counts")).agg(F.count(F.lit(1)).alias("instances_pre"))
    post = after.groupBy(F.col("n").alias("counts")).agg(F.count(F.lit(1)).alias("instances_post"))
    return pre.join(post, "counts", "full").na.fill(0)


def per_umi(before: DataFrame, after: DataFrame) -> DataFrame:
    """UMI, and median count (whole part), positions and total before and after; 0 where gone."""

    def of(df: DataFrame, when: str) -> DataFrame:
        return df.groupBy(F.col("umi").alias("UMI")).agg(F.median("n").cast("long").alias(f"median_counts_{when}"), F.count(F.lit(1)).alias(f"times_observed_{when}"), F.sum("n").alias(f"total_counts_{when}"))

    return of(before, "pre").join(of(after, "post"), "UMI", "left").na.fill(0)


def distance_bin(distance):
    """Single_UMI for bundles of one barcode, else the distance rounded up."""
    return F.when(distance < 0, "Single_UMI").otherwise(F.ceil(distance).cast("string"))


def edit_distances(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """edit_distance, unique, grouped: bundles by the mean distance of their barcodes."""
    bins = []
    for df, name in ((before, "unique"), (after, "grouped")):
        bins.append(mean_distance(df, keys).groupBy(distance_bin(F.col("distance")).alias("edit_distance")).agg(F.count(F.lit(1)).alias(name)))
    return bins[0].join(bins[1], "edit_distance", "full").na.fill(0)


def null_distances(before: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """edit_distance, unique_null: the same for as many barcodes drawn by their frequency in the
    whole table. Draws are hashed from bundle and place, so a rerun gives the same ones."""
    pool = before.groupBy("umi").agg(F.sum("n").alias("w"))
    total = pool.agg(F.sum("w")).first()[0] or 0
    spans = numbered(pool, [F.col("umi")], "_k", "w", "begin").select(F.col("umi").alias("drawn"), "begin", (F.col("begin") + F.col("w")).alias("end"))
    width = max(1, total // 4096)
    cells = spans.select("drawn", "begin", "end", F.explode(F.sequence(F.expr(f"begin div {width}"), F.expr(f"(end - 1) div {width}"))).alias("cell"))
    draw = hashed_number(*[F.col(k).cast("string") for k in keys], F.col("umi"), F.lit(str(seed))) % max(1, total)
    draws = before.select(*keys, draw.alias("at")).withColumn("cell", F.expr(f"at div {width}"))
    drawn = draws.join(cells, "cell").where("begin <= at and at < end").select(*keys, F.col("drawn").alias("umi"))
    return mean_distance(drawn, keys).groupBy(distance_bin(F.col("distance")).alias("edit_distance")).agg(F.count(F.lit(1)).alias("unique_null"))
