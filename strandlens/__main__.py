"""Commands: python -m strandlens extract | whitelist | group | dedup | count | count_tab | pairs.

Inputs and outputs are files or folders that Spark reads and writes; outputs are folders of parts.
"""

from __future__ import annotations

import argparse
import logging
import sys
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .config import ExtractOptions, GroupingOptions, WhitelistOptions
from .operators import bundles, extract, molecules, pairs, stats, whitelist
from .operators.cluster import METHODS
from .session import session
from .sources import alignments as al
from .sources import fastq, tables

log = logging.getLogger("strandlens")


def _grouping(p: argparse.ArgumentParser) -> None:
    p.add_argument("--method", choices=METHODS, default="directional")
    p.add_argument("--edit-distance-threshold", dest="threshold", type=int, default=1)
    p.add_argument("--spliced-is-unique", dest="spliced", action="store_true")
    p.add_argument("--soft-clip-threshold", type=float, default=4)
    for name in ("per-gene", "per-contig", "per-cell", "read-length", "ignore-umi", "ignore-tlen", "paired"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--gene-tag")
    p.add_argument("--assigned-status-tag", dest="assigned_tag")
    p.add_argument("--skip-tags-regex", dest="skip_regex", default=GroupingOptions.skip_regex)
    p.add_argument("--gene-transcript-map", dest="genes")
    p.add_argument("--mapping-quality", type=int, default=0)
    p.add_argument("--chrom")
    p.add_argument("--subset", type=float)
    p.add_argument("--multimapping-detection-method", dest="multimapping", choices=("NH", "X0", "XT"))
    p.add_argument("--unmapped-reads", choices=("discard", "use", "output"), default="discard")
    p.add_argument("--chimeric-pairs", choices=("discard", "use", "output"), default="use")
    p.add_argument("--unpaired-reads", choices=("discard", "use", "output"), default="use")
    p.add_argument("--extract-umi-method", choices=("read_id", "tag", "umis"), default="read_id")
    p.add_argument("--umi-separator", default="_")
    p.add_argument("--umi-tag", default="RX")
    p.add_argument("--umi-tag-split")
    p.add_argument("--umi-tag-delimiter")
    p.add_argument("--cell-tag")
    p.add_argument("--cell-tag-split", default="-")
    p.add_argument("--cell-tag-delimiter")
    p.add_argument("--filter-umi", action="store_true")
    p.add_argument("--umi-whitelist")
    p.add_argument("--umi-whitelist-paired")
    p.add_argument("--in-sam", action="store_true")
    p.add_argument("--out-bam", action="store_true", help="write BAM, not SAM")
    p.add_argument("--out-sam", action="store_true", help="write SAM, as is done without --out-bam")
    p.add_argument("--no-sort-output", action="store_true")


def _extraction(p: argparse.ArgumentParser) -> None:
    p.add_argument("--extract-method", dest="method", choices=("string", "regex"), default="string")
    p.add_argument("-p", "--bc-pattern", dest="pattern")
    p.add_argument("--bc-pattern2", dest="pattern2")
    p.add_argument("--3prime", dest="three_prime", action="store_true")
    p.add_argument("--read2-in")
    p.add_argument("--filtered-out")
    p.add_argument("--filtered-out2")
    p.add_argument("--ignore-read-pair-suffixes", dest="ignore_suffix", action="store_true")
    p.add_argument("--subset-reads", type=int)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlens", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("-I", "--stdin", dest="source", required=True)
        p.add_argument("-S", "--stdout", dest="target", required=True)
        p.add_argument("--cores", type=int, default=0, help="cores of a local session; 0: the session of spark-submit")
        p.add_argument("--timeit", help="append command and seconds to this file")
        p.add_argument("--timeit-name", default="all", help="name of the line in that file")
        p.add_argument("--timeit-header", action="store_true", help="write a header line first")
        p.add_argument("-L", "--log", help="file of the log, else standard error")
        p.add_argument("-E", "--error", help="file of warnings and errors")
        p.add_argument("--log2stderr", action="store_true", help="log to standard error also")
        p.add_argument("-v", "--verbose", dest="loglevel", type=int, default=1, help="0: warnings only")
        p.add_argument("--compress", choices=("none", "gzip"), default="none", help="pack FASTQ outputs")
        p.add_argument("--compresslevel", type=int, choices=range(1, 10), default=6, help="level of packed outputs")
        p.add_argument("--temp-dir", help="folder for intermediate tables, which all machines share")
        p.add_argument("--random-seed", dest="seed", type=int, default=0)
        p.add_argument("--help-extended", action="help", help="the same as --help")
        return p

    for name in ("dedup", "group", "count"):
        _grouping(command(name))
    commands.choices["dedup"].add_argument("--output-stats")
    commands.choices["group"].add_argument("--group-out")
    commands.choices["group"].add_argument("--umi-group-tag", default="BX")
    commands.choices["group"].add_argument("--output-bam", action="store_true", help="write the labelled reads")
    commands.choices["count"].add_argument("--wide-format-cell-counts", action="store_true")
    tab = command("count_tab")
    tab.add_argument("--method", choices=METHODS, default="directional")
    tab.add_argument("--edit-distance-threshold", dest="threshold", type=int, default=1)
    tab.add_argument("--barcode-separator", dest="umi_separator", default="_")
    tab.add_argument("--per-cell", action="store_true")
    ex = command("extract")
    _extraction(ex)
    for flag in ("read2-only", "retain-umi", "filter-cell-barcode", "error-correct-cell", "filter-umi", "either-read"):
        ex.add_argument(f"--{flag}", action="store_true")
    ex.add_argument("--reconcile-pairs", dest="reconcile", action="store_true")
    ex.add_argument("--either-read-resolve", choices=("discard", "quality"), default="discard")
    ex.add_argument("--read2-out")
    ex.add_argument("--read2-stdout", action="store_true", help="write read 2 to --stdout, and no read 1")
    ex.add_argument("--quality-filter-threshold", type=int)
    ex.add_argument("--quality-filter-mask", type=int)
    ex.add_argument("--quality-encoding", choices=("phred33", "phred64", "solexa"), default="phred33")
    for path in ("whitelist", "blacklist", "umi-whitelist", "umi-whitelist-paired", "umi-correct-log"):
        ex.add_argument(f"--{path}")
    ex.add_argument("--correct-umi-threshold", type=int, default=0)
    ex.add_argument("--umi-separator", default="_")
    wl = command("whitelist")
    _extraction(wl)
    wl.add_argument("--method", dest="count_method", choices=("reads", "umis"), default="reads")
    wl.add_argument("--knee-method", choices=("distance", "density"), default="distance")
    wl.add_argument("--set-cell-number", dest="cell_number", type=int)
    wl.add_argument("--expect-cells", type=int)
    wl.add_argument("--error-correct-threshold", type=int, default=1)
    wl.add_argument("--ed-above-threshold", choices=("discard", "correct"))
    wl.add_argument("--allow-threshold-error", action="store_true")
    wl.add_argument("--plot-prefix", help="folder prefix for the tables behind the knee's plots")
    pr = command("pairs")
    pr.add_argument("--tags", default="UG,BX")
    pr.add_argument("--sam", dest="in_sam", action="store_true")
    pr.add_argument("--out-bam", action="store_true")
    return top


def _options(kind: type, args: argparse.Namespace, **more):
    names = kind.__dataclass_fields__
    return kind(**{k: v for k, v in vars(args).items() if k in names and k != "umi_whitelist"} | more)


def _alignments(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, list[str]]:
    if args.in_sam or args.source.endswith(".sam"):
        return al.read_sam(spark, args.source), al.sam_header(spark, args.source)
    return al.read_bam(spark, args.source), al.bam_header(args.source)


def _write(reads: DataFrame, args: argparse.Namespace, header: list[str], coordinate_sort: bool) -> None:
    (al.write_bam if args.out_bam else al.write_sam)(reads, args.target, header, coordinate_sort)


def _grouped(spark: SparkSession, args: argparse.Namespace) -> None:
    reads, header = _alignments(spark, args)
    listed = None
    if args.filter_umi:
        found = tables.barcode_list(spark, args.umi_whitelist, args.umi_whitelist_paired).limit(100_001).collect()
        if len(found) > 100_000:
            raise ValueError("the UMI whitelist has more than 100,000 barcodes")
        listed = tuple(r["barcode"] for r in found)
    more = {"per_gene": True} if args.command == "count" else {}
    if args.per_gene or more:
        more["gene_tag"] = args.gene_tag
    options = _options(GroupingOptions, args, umi_whitelist=listed, **more)
    genes = tables.gene_map(spark, args.genes, al.contigs(header) or None) if args.genes else None
    bundles.check_multimapping(reads, options)
    seen = Observation("events")
    if args.command == "dedup":
        if args.output_stats and options.ignore_umi:
            raise ValueError("output-stats and ignore-umi exclude each other")
        kept, groups, keys = molecules.deduplicated(reads, options, genes, seen)
        _write(kept, args, header, not args.no_sort_output)
        if args.output_stats:
            before, after = groups.select(*keys, "umi", "n"), stats.after_grouping(groups, keys)
            distances = stats.edit_distances(before, after, keys).join(stats.null_distances(before, keys, options.seed), "edit_distance", "full").na.fill(0)
            for table, name in ((stats.per_position_counts(before, after), "per_umi_per_position"), (stats.per_umi(before, after), "per_umi"), (distances, "edit_distance")):
                tables.write_tsv(table, f"{args.output_stats}_{name}")
    elif args.command == "group":
        labelled = molecules.group(reads, options, genes, seen)
        if args.group_out:
            tables.write_tsv(molecules.group_table(labelled, options), args.group_out)
        if args.output_bam or not args.group_out:
            _write(labelled.select(*reads.columns), args, header, not args.no_sort_output)
    else:
        found = molecules.count(reads, options, genes, seen)
        wide = options.per_cell and args.wide_format_cell_counts
        tables.write_tsv(molecules.wide(found).orderBy("gene") if wide else found.orderBy(*[c for c in found.columns if c != "count"]), args.target)
    for event, n in sorted(seen.get.items()):
        if n:
            log.info("%s: %d", event, n)


def _pair_input(spark: SparkSession, args: argparse.Namespace, reconcile: bool = False, names_differ: bool = False) -> DataFrame:
    one = fastq.read_fastq(spark, args.source)
    if args.read2_in:
        return extract.paired(one, fastq.read_fastq(spark, args.read2_in), reconcile, names_differ)
    return one.select("file_no", "ord", *[F.col(c).alias(f"{c}1") for c in ("identifier", "seq", "quals")])


def _extract(spark: SparkSession, args: argparse.Namespace) -> None:
    options = _options(ExtractOptions, args)
    listed = tables.barcode_list(spark, args.whitelist) if args.whitelist else None
    fixes = tables.whitelist_fixes(spark, args.whitelist) if args.whitelist and args.error_correct_cell else None
    umis = tables.barcode_list(spark, args.umi_whitelist, args.umi_whitelist_paired) if args.umi_whitelist else None
    rows = extract.extract_reads(_pair_input(spark, args, args.reconcile), options, listed, fixes, tables.blacklist(spark, args.blacklist) if args.blacklist else None, umis).cache()
    for r in extract.events(rows).orderBy("event").collect():
        log.info("%s: %d", r["event"], r["n"])
    good, bad = rows.where(F.col("event") == extract.KEPT), rows.where(F.col("event") != extract.KEPT)
    outputs = (None, args.target) if args.read2_stdout else (None if args.read2_only and not args.read2_out else args.target, args.read2_out)
    for part, paths in ((good, outputs), (bad, (args.filtered_out, args.filtered_out2))):
        _write_pairs(part, paths, args)
    if args.umi_correct_log and "umi_corrected" in rows.columns:
        tables.write_tsv(extract.umi_correction_log(rows).orderBy("umi"), args.umi_correct_log)
    rows.unpersist()


def _write_pairs(part: DataFrame, paths: tuple, args: argparse.Namespace) -> None:
    for path, which in zip(paths, "12", strict=True):
        if path and f"seq{which}" in part.columns:
            fastq.write_fastq(part, path, which, None if args.compress == "none" else args.compress, level=args.compresslevel)


def _whitelist(spark: SparkSession, args: argparse.Namespace) -> None:
    given = _pair_input(spark, args, names_differ=True)
    if args.subset_reads and args.read2_in:
        given = extract.first_reads(given, args.subset_reads + 1)  # pairs that are read
    rows = extract.barcode_rows(given, _options(ExtractOptions, args, method=args.method, subset_reads=None))
    if args.filtered_out or args.filtered_out2:
        _write_pairs(rows.where(F.col("event").isNotNull()), (args.filtered_out, args.filtered_out2), args)
    found = rows.where(F.col("event").isNull()).select(*extract.place(rows), "cell", "umi")
    if args.subset_reads and not args.read2_in:
        found = extract.first_found(found, args.subset_reads + 1)  # reads that have a barcode
    options = _options(WhitelistOptions, args, method=args.count_method, subset_reads=args.subset_reads)
    counts = whitelist.cell_counts(found, options.method).cache()
    if args.plot_prefix:
        tables.write_tsv(whitelist.knee_curve(counts), f"{args.plot_prefix}_cell_barcode_knee")
        if not options.cell_number:
            rows = whitelist.threshold_table(whitelist.count_histogram(counts), options)
            tables.write_tsv(spark.createDataFrame(rows, "count long, action string"), f"{args.plot_prefix}_cell_thresholds")
        if options.knee_method == "density":
            curve = whitelist.density_curve(whitelist.count_histogram(counts))
            tables.write_tsv(spark.createDataFrame(curve, "log10_count double, density double, minimum boolean"), f"{args.plot_prefix}_cell_barcode_count_density")
        tables.write_tsv(whitelist.count_curve(counts, whitelist.select_cells(counts, options)).orderBy("rank"), f"{args.plot_prefix}_cell_barcode_counts")
    out = whitelist.whitelist(found, options)
    if out is None:
        log.warning("no threshold was found; no whitelist is written")
    else:
        tables.write_tsv(out.orderBy("barcode"), args.target, header=False)
    counts.unpersist()


def _count_tab(spark: SparkSession, args: argparse.Namespace) -> None:
    out = molecules.count_table(tables.read_genes(spark, args.source), _options(GroupingOptions, args))
    tables.write_tsv(out.orderBy(*out.columns[:-1]), args.target)


def _pairs(spark: SparkSession, args: argparse.Namespace) -> None:
    reads, header = _alignments(spark, args)
    both = pairs.template_pairs(reads, tuple(args.tags.split(",")))
    order = F.posexplode(F.array("read1", "read2")).alias("i", "r")
    rows = both.orderBy("read1.qname").withColumn("_n", F.monotonically_increasing_id()).select("_n", order).select((F.col("_n") * 2 + F.col("i")).alias("ord"), "r.*")
    _write(rows.orderBy("ord"), args, header, coordinate_sort=False)


def _handlers(args: argparse.Namespace) -> list[logging.Handler]:
    """Where the log goes: a file or standard error, and warnings also to a file of their own."""
    handlers: list[logging.Handler] = [logging.FileHandler(args.log)] if args.log else []
    if not args.log or args.log2stderr:
        handlers.append(logging.StreamHandler(sys.stderr))
    if args.error:
        handlers.append(logging.FileHandler(args.error))
        handlers[-1].setLevel(logging.WARNING)
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(logging.INFO if args.loglevel else logging.WARNING)
    return handlers


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    handlers = _handlers(args)
    began = time.time()
    log.info("arguments: %s", vars(args))
    if spark is None:
        spark = session(args.cores) if args.cores else SparkSession.builder.getOrCreate()
    if args.temp_dir:
        spark.sparkContext.setCheckpointDir(args.temp_dir)
    run = {"extract": _extract, "whitelist": _whitelist, "count_tab": _count_tab, "pairs": _pairs}.get(args.command, _grouped)
    try:
        run(spark, args)
        log.info("done in %.1f s", time.time() - began)
    except Exception as error:
        log.error("%s", error)
        raise
    finally:
        for handler in handlers:
            log.removeHandler(handler)
            handler.close()
    if args.timeit:
        with open(args.timeit, "a", encoding="utf-8") as f:
            if args.timeit_header:
                f.write("command\tname\tseconds\n")
            f.write(f"{args.command}\t{args.timeit_name}\t{time.time() - began:.3f}\n")


if __name__ == "__main__":
    main()
