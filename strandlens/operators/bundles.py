"""Reads to bundles: which reads take part, why others don't, and under which keys they meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import GroupingOptions
from ..functions.barcodes import from_prefixed_id, from_read_id, from_tags, hashed_number
from ..functions.positions import read_position

#: Flag bits of alignments.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, READ1, READ2, SECONDARY = 0x1, 0x4, 0x8, 0x10, 0x40, 0x80, 0x100

KEPT = "kept"


def _bit(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def barcodes(options: GroupingOptions) -> Column:
    """struct(umi, cell) of alignments (qname, tags) by the options' method."""
    if options.extract_umi_method == "tag":
        found = from_tags(F.col("tags"), options.umi_tag, options.cell_tag if options.per_cell else None, options.umi_tag_split, options.umi_tag_delimiter, options.cell_tag_split, options.cell_tag_delimiter)
    elif options.extract_umi_method == "umis":
        found = from_prefixed_id(F.col("qname"), options.per_cell)
    else:
        found = from_read_id(F.col("qname"), options.umi_separator, options.per_cell)
    return F.struct(F.lit("").alias("umi"), found["cell"].alias("cell")) if options.ignore_umi else found


def sampled(fraction: float, seed: int) -> Column:
    """Keeps about this fraction of reads, by a hash of the name, so that reruns agree."""
    return hashed_number(F.col("qname"), F.lit(str(seed))) < int(fraction * 2**52)


def classified(reads: DataFrame, options: GroupingOptions, genes: DataFrame | None = None, seen: Observation | None = None) -> DataFrame:
    """reads plus umi, cell, gene and event. An observation counts the events while the reads pass.

    reads has the columns of an alignment (qname, flag, rname, pos 0-based, mapq, cigar, rnext, tlen,
    seq, tags); genes (gene, transcript) names the gene of each contig. event says what became of
    a read, the first rule that holds; only ``kept`` reads are grouped, and reads that a policy of
    ``output`` passes on ungrouped have an event that ends in "output".
    """
    flag = F.col("flag")
    if options.chrom:
        reads = reads.where(F.col("rname") == options.chrom)
    gene = F.lit(None).cast("string")
    if options.per_gene and options.per_contig:
        if genes is not None and not options.chrom:
            reads = reads.join(genes.select(F.col("transcript").alias("rname"), F.col("gene").alias("_gene")), "rname")
            gene = F.col("_gene")
        else:
            gene = F.col("rname")
    elif options.per_gene:
        gene = F.try_element_at(F.col("tags"), F.lit(options.gene_tag))
    assigned = F.try_element_at(F.col("tags"), F.lit(options.assigned_tag or options.gene_tag or "XF"))
    found = reads.withColumn("_b", barcodes(options)).withColumns({"umi": F.col("_b.umi"), "cell": F.col("_b.cell"), "gene": gene})
    no = F.lit(False)
    rules: list[tuple[Column, str]] = [(_bit(flag, READ2), "read 2")]
    if options.paired and options.unpaired_reads == "discard":
        rules.append((~_bit(flag, PAIRED), "unpaired"))
    out = " output" if options.unmapped_reads in ("use", "output") else ""
    unmapped = _bit(flag, UNMAPPED)
    if options.paired:
        rules += [(unmapped & _bit(flag, MATE_UNMAPPED), f"both unmapped{out}"), (unmapped, f"read 1 unmapped{out}")]
        if options.unmapped_reads != "use":
            rules.append((_bit(flag, MATE_UNMAPPED), f"read 2 unmapped{out}"))
    else:
        rules.append((unmapped, f"single end unmapped{out}"))
    if options.chimeric_pairs != "use":
        elsewhere = ~F.col("rnext").isin("=", "") & (F.col("rnext") != F.col("rname"))
        rules.append((_bit(flag, PAIRED) & F.coalesce(elsewhere, no), "chimeric pair" + (" output" if options.chimeric_pairs == "output" else "")))
    if options.subset is not None:
        rules.append((~sampled(options.subset, options.seed), "randomly excluded"))
    if options.mapping_quality:
        rules.append((F.col("mapq") < options.mapping_quality, "low mapping quality"))
    missing = (F.col("umi").isNull() if not options.ignore_umi else no) | (F.col("cell").isNull() if options.per_cell else no)
    rules.append((missing, "no umi or cell"))
    if options.per_gene and not options.per_contig:
        rules += [(F.col("gene").isNull() | assigned.isNull(), "no gene tag"), (F.col("gene") == "", "empty gene"), (assigned.rlike(options.skip_regex), "skipped gene")]
    event = F.lit(KEPT)
    for test, name in reversed(rules):
        event = F.when(test, name).otherwise(event)
    if not options.per_gene:
        aligned = F.col("cigar").isNotNull() & (F.col("cigar") != "*")
        event = F.when((event == KEPT) & ~aligned, "no alignment").otherwise(event)
    found = found.withColumn("event", event).drop("_b", "_gene")
    if seen is not None:
        names = [KEPT, "no alignment", *dict.fromkeys(name for _, name in rules)]
        found = found.observe(seen, *[F.count_if(F.col("event") == name).alias(name) for name in names])
    return found


def event_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def keyed(found: DataFrame, options: GroupingOptions) -> tuple[DataFrame, list[str]]:
    """The kept reads with their bundle's key columns, and the columns' names. The contig is always
    part of the key; by gene nothing else of the position is."""
    # The row number keeps the filter above the expressions it tests: pushed below, it would repeat
    # all of them, barcodes and tags included. What a scan can use, the quality, is filtered again.
    if options.mapping_quality:
        found = found.where(F.col("mapq") >= options.mapping_quality)
    if found.isStreaming:  # streams have no row numbers
        kept = found.where(F.col("event") == KEPT)
    else:
        kept = found.withColumn("_row", F.monotonically_increasing_id()).where((F.col("event") == KEPT) & (F.col("_row") >= 0)).drop("_row")
    cell = ["cell"] if options.per_cell else []
    if options.per_gene:
        return kept, ["rname", "gene", *cell]
    at = read_position(F.col("pos"), _bit(F.col("flag"), REVERSE), F.col("cigar"), options.soft_clip_threshold)
    kept = kept.withColumn("_at", at).withColumns({"start": F.col("_at.start"), "position": F.col("_at.pos"), "is_reverse": _bit(F.col("flag"), REVERSE)})
    keys = ["rname", "position", "is_reverse"]
    if options.spliced:
        kept = kept.withColumn("splice", F.coalesce(F.col("_at.splice"), F.lit(0)))
        keys.append("splice")
    if options.paired and not options.ignore_tlen:
        keys.append("tlen")
    if options.read_length:
        kept = kept.withColumn("read_length", F.length("seq"))
        keys.append("read_length")
    return kept.drop("_at"), [*keys, *cell]


def umi_counts(reads: DataFrame, keys: list[str], umi: str = "umi") -> DataFrame:
    """keys, umi, n: reads per bundle and barcode."""
    return reads.groupBy(*keys, F.col(umi).alias("umi")).agg(F.count(F.lit(1)).alias("n"))


def preference(options: GroupingOptions) -> Column:
    """Which of several reads of one molecule stays, as a value of which the least wins: the best mapping
    quality, then the fewest hits by the multimapping tag, then the first by name."""
    order: list[Column] = [-F.coalesce(F.col("mapq"), F.lit(-1))]
    if options.multimapping in ("NH", "X0"):
        order.append(F.coalesce(F.try_element_at(F.col("tags"), F.lit(options.multimapping)).try_cast("int"), F.lit(2**31 - 1)))
    elif options.multimapping == "XT":
        unique = F.try_element_at(F.col("tags"), F.lit("XT")) == "U"
        order.append(F.when(unique, 0).when(~unique, 1).otherwise(2))
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*order, F.col("qname")])])


def best_of_each(reads: DataFrame, keys: list[str], order: Column, columns: list[str], umi: str = "umi") -> DataFrame:
    """keys, umi, n and read: of each bundle and barcode the number of reads and the first in the order,
    a struct of the columns. One aggregation, combined before anything is shuffled."""
    return reads.groupBy(*keys, F.col(umi).alias("umi")).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*columns), order).alias("read"))


def multimapping_tags(reads: DataFrame, rows: int = 1001) -> list[str]:
    """Those of NH, X0, XT that every one of the first mapped reads, in file order, has."""
    mapped = reads.where(~_bit(F.col("flag"), UNMAPPED))
    head = mapped.orderBy("ord").limit(rows) if "ord" in reads.columns else mapped
    every = head.agg(*[F.bool_and(F.map_contains_key("tags", F.lit(t))).alias(t) for t in ("NH", "X0", "XT")]).first()
    return [t for t in ("NH", "X0", "XT") if every[t]]


def check_multimapping(reads: DataFrame, options: GroupingOptions) -> None:
    """An error if the tag that is to tell multimapping reads isn't there; it names those that are."""
    if options.multimapping is None:
        return
    there = multimapping_tags(reads)
    if options.multimapping not in there:
        raise ValueError(f"reads have no tag {options.multimapping} to detect multimapping; " + (f"they have {', '.join(there)}" if there else "nor any other: leave the detection out"))
