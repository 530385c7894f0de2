"""Molecules: deduplicated reads, labelled reads and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import GroupingOptions
from ..functions.barcodes import with_tags
from ..session import checkpointed
from .bundles import KEPT, best_of_each, classified, keyed, preference, umi_counts
from .cluster import cluster, with_group_sizes
from .order import numbered


def _whitelisted(groups: DataFrame, options: GroupingOptions) -> DataFrame:
    """Groups whose representative is on the UMI whitelist, if there is one."""
    if options.umi_whitelist is None:
        return groups
    return groups.where(F.col("rep").isin(*options.umi_whitelist)) if options.umi_whitelist else groups.where("false")


def groups_of(reads: DataFrame, options: GroupingOptions, genes: DataFrame | None = None, seen: Observation | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """The grouped reads with keys, the groups (keys, umi, n, rep) and the names of the keys."""
    kept, keys = keyed(classified(reads, options, genes, seen), options)
    groups = cluster(umi_counts(kept, keys), keys, options.method, options.threshold, options.path, options.hot_bundle)
    return kept, _whitelisted(groups, options), keys


def _same(left: list[str]) -> list:
    """Null-safe equality of key columns with their copies of the other side."""
    return [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in left]


def _renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_{c}" for c in columns})


def dedup(reads: DataFrame, options: GroupingOptions, genes: DataFrame | None = None) -> DataFrame:
    """One read per molecule, with the alignment's own columns; with ``paired`` also the mates of
    the kept reads, and reads that a policy of ``output`` passes on."""
    return deduplicated(reads, options, genes)[0]


def deduplicated(reads: DataFrame, options: GroupingOptions, genes: DataFrame | None = None, seen: Observation | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """The reads that dedup keeps, the groups (keys, umi, n, rep) and the names of the keys."""
    kept, keys = keyed(classified(reads, options, genes, seen), options)
    best = checkpointed(best_of_each(kept, keys, preference(options), reads.columns))  # one row per barcode from here on
    groups = _whitelisted(cluster(best.select(*keys, "umi", "n"), keys, options.method, options.threshold, options.path, options.hot_bundle, stored=True), options)
    reps = _renamed(groups.where("umi = rep").select(*keys, F.col("umi")), [*keys, "umi"])
    chosen = best.join(reps, _same([*keys, "umi"]), "left_semi").select("read.*")
    if options.paired:
        chosen = chosen.unionByName(mates(chosen, reads)).unionByName(passed_on(reads, options, genes))
    return chosen, groups, keys


def passed_on(reads: DataFrame, options: GroupingOptions, genes: DataFrame | None = None) -> DataFrame:
    found = classified(reads, options, genes)
    return found.where(F.col("event").endswith(" output")).select(*reads.columns)


def mates(kept: DataFrame, reads: DataFrame) -> DataFrame:
    """The second reads that kept first reads point to by name, contig and position, one each."""
    contig = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
    wanted = kept.select(F.col("qname").alias("_q"), contig.alias("_c"), F.col("pnext").alias("_p")).distinct()
    second = reads.where(F.col("flag").bitwiseAND(0x80) != 0)
    found = second.join(wanted, (F.col("qname") == F.col("_q")) & (F.col("rname") == F.col("_c")) & (F.col("pos") == F.col("_p")), "left_semi")
    return found.dropDuplicates(["qname", "rname", "pos"])


def group(reads: DataFrame, options: GroupingOptions, genes: DataFrame | None = None, seen: Observation | None = None) -> DataFrame:
    """All grouped reads with umi_count, final_umi, final_umi_count, unique_id and the tags UG and
    (by ``umi_group_tag``) BX set. unique_id counts groups from 0 by contig, position and keys, in a
    bundle by the representatives' counts, ties by first occurrence if reads have ord."""
    kept, groups, keys = groups_of(reads, options, genes, seen)
    groups = checkpointed(with_group_sizes(groups, keys))  # read for the numbers and for the labels
    heads = groups.where("umi = rep").select(*keys, "rep", F.col("n").alias("rep_n"), "group_n")
    ties: list[str] = ["rep"]
    if "ord" in kept.columns:
        seen = _renamed(kept.groupBy(*keys, "umi").agg(F.min("ord").alias("first_ord")), [*keys, "umi"])
        top = groups.withColumn("top", F.max("n").over(Window.partitionBy(*keys, "rep"))).where("n = top")
        first = top.join(seen, _same([*keys, "umi"])).groupBy(*[F.col(k).alias(f"_{k}") for k in [*keys, "rep"]]).agg(F.min("first_ord").alias("first_ord"))
        heads = heads.join(first, _same([*keys, "rep"])).select(*keys, "rep", "rep_n", "group_n", "first_ord")
        ties = ["first_ord", "rep"]
    ids = numbered(heads, [*[F.col(k).asc_nulls_first() for k in keys], F.col("rep_n").desc(), *ties], "unique_id")
    ids = _renamed(ids.select(*keys, "rep", "unique_id", "group_n"), [*keys, "rep"])
    labels = groups.select(*keys, "umi", "n", "rep").join(ids, _same([*keys, "rep"])).select(*keys, "umi", F.col("n").alias("umi_count"), F.col("rep").alias("final_umi"), F.col("group_n").alias("final_umi_count"), "unique_id")
    found = kept.join(_renamed(labels, [*keys, "umi"]), _same([*keys, "umi"]))
    tagged = with_tags(F.coalesce(F.col("tags"), F.create_map().cast("map<string,string>")), UG=F.col("unique_id"), **{options.umi_group_tag: F.col("final_umi")})
    return found.withColumn("tags", tagged).drop(*[f"_{k}" for k in [*keys, "umi"]])


def group_table(labelled: DataFrame, options: GroupingOptions) -> DataFrame:
    """The nine columns of the group report."""
    position = F.col("position") if "position" in labelled.columns else F.col("pos")
    gene = F.col("gene") if options.per_gene else F.lit("NA")
    return labelled.select(F.col("qname").alias("read_id"), F.col("rname").alias("contig"), position.alias("position"), gene.alias("gene"), "umi", "umi_count", "final_umi", "final_umi_count", "unique_id")


def count(reads: DataFrame, options: GroupingOptions, genes: DataFrame | None = None, seen: Observation | None = None) -> DataFrame:
    """gene[, cell], count: molecules of each gene, summed over its contigs."""
    _, groups, _ = groups_of(reads, options, genes, seen)
    return molecules(groups, ["gene", "cell"] if options.per_cell else ["gene"])


def molecules(groups: DataFrame, by: list[str]) -> DataFrame:
    return groups.where("umi = rep").groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def wide(counts: DataFrame, cells: list[str] | None = None, limit: int = 20_000) -> DataFrame:
    """gene and one column per cell, 0 where a gene has no molecule. The cells are columns, so they
    are listed on the driver, in order, unless given; more than ``limit`` are an error."""
    if cells is None:
        cells = sorted(r[0] for r in counts.select("cell").distinct().limit(limit + 1).collect())
        if len(cells) > limit:
            raise ValueError(f"more than {limit} cells don't fit into columns; use the long format")
    return counts.groupBy("gene").pivot("cell", cells).agg(F.first("count")).na.fill(0)


def count_table(table: DataFrame, options: GroupingOptions) -> DataFrame:
    """[cell, ]gene, count from a table of (read_id, gene), barcodes in the read's name: the last
    part is the UMI, per cell the part before it the cell."""
    parts = F.split(F.col("read_id"), options.umi_separator)
    rows = table.withColumn("umi", F.element_at(parts, -1))
    keys = ["gene"]
    if options.per_cell:
        rows, keys = rows.withColumn("cell", F.try_element_at(parts, F.lit(-2))), ["cell", "gene"]
    groups = cluster(umi_counts(rows, keys), keys, options.method, options.threshold, options.path, options.hot_bundle)
    return molecules(groups, keys)


def bundle_summary(counts: DataFrame, keys: list[str]) -> DataFrame:
    """positions, mean and max barcodes per bundle."""
    per = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("umis"))
    return per.agg(F.count(F.lit(1)).alias("positions"), F.avg("umis").alias("mean_umis"), F.max("umis").alias("max_umis"))


__all__ = ["KEPT", "bundle_summary", "count", "count_table", "dedup", "deduplicated", "group", "group_table", "groups_of", "mates", "molecules", "passed_on", "wide"]
