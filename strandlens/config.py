"""Options of the commands, checked when they are made."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .functions.barcodes import PHRED
from .operators.cluster import HOT_BUNDLE, METHODS


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


@dataclass(frozen=True)
class GroupingOptions:
    """How reads become bundles, and bundles groups."""

    method: str = "directional"
    threshold: int = 1
    per_gene: bool = False
    per_contig: bool = False
    per_cell: bool = False
    gene_tag: str | None = None
    assigned_tag: str | None = None
    skip_regex: str = r"^(__|Unassigned)"
    ignore_umi: bool = False
    paired: bool = False
    ignore_tlen: bool = False
    read_length: bool = False
    spliced: bool = False
    soft_clip_threshold: float = 4
    mapping_quality: int = 0
    subset: float | None = None
    seed: int = 0
    chrom: str | None = None
    unmapped_reads: str = "discard"
    chimeric_pairs: str = "use"
    unpaired_reads: str = "use"
    multimapping: str | None = None
    umi_whitelist: tuple[str, ...] | None = None
    extract_umi_method: str = "read_id"
    umi_separator: str = "_"
    umi_tag: str = "RX"
    umi_tag_split: str | None = None
    umi_tag_delimiter: str | None = None
    cell_tag: str | None = None
    cell_tag_split: str | None = "-"
    cell_tag_delimiter: str | None = None
    umi_group_tag: str = "BX"
    path: str = "auto"
    hot_bundle: int = HOT_BUNDLE

    def __post_init__(self) -> None:
        _one_of("method", self.method, METHODS)
        _one_of("extract_umi_method", self.extract_umi_method, ("read_id", "tag", "umis"))
        _one_of("unmapped_reads", self.unmapped_reads, ("discard", "use", "output"))
        _one_of("chimeric_pairs", self.chimeric_pairs, ("discard", "use", "output"))
        _one_of("unpaired_reads", self.unpaired_reads, ("discard", "use", "output"))
        if self.multimapping is not None:
            _one_of("multimapping", self.multimapping, ("NH", "X0", "XT"))
        if self.per_gene and not (self.gene_tag or self.per_contig):
            raise ValueError("per_gene needs gene_tag or per_contig")
        if self.per_contig and self.gene_tag:
            raise ValueError("give per_contig or gene_tag, not both")
        if (self.per_contig or self.gene_tag) and not self.per_gene:
            raise ValueError("per_contig and gene_tag need per_gene")
        if self.per_cell and self.extract_umi_method == "tag" and not self.cell_tag:
            raise ValueError("per_cell with tags needs cell_tag")
        if self.subset is not None and not 0 < self.subset <= 1:
            raise ValueError("subset must be over 0 and at most 1")
        if self.threshold < 0:
            raise ValueError("threshold must not be negative")
        if not self.paired and self.unpaired_reads == "output":
            raise ValueError("unpaired_reads=output needs paired")
        re.compile(self.skip_regex)


@dataclass(frozen=True)
class ExtractOptions:
    """How barcodes leave raw reads."""

    pattern: str | None = None
    pattern2: str | None = None
    method: str = "string"
    three_prime: bool = False
    read2_only: bool = False
    retain_umi: bool = False
    either_read: bool = False
    either_read_resolve: str = "discard"
    quality_filter_threshold: int | None = None
    quality_filter_mask: int | None = None
    quality_encoding: str = "phred33"
    filter_cell_barcode: bool = False
    error_correct_cell: bool = False
    filter_umi: bool = False
    correct_umi_threshold: int = 0
    umi_separator: str = "_"
    subset_reads: int | None = None
    reconcile: bool = False
    ignore_suffix: bool = False

    def __post_init__(self) -> None:
        _one_of("method", self.method, ("string", "regex"))
        _one_of("quality_encoding", self.quality_encoding, tuple(PHRED))
        _one_of("either_read_resolve", self.either_read_resolve, ("discard", "quality"))
        if not self.pattern and not self.pattern2:
            raise ValueError("give a pattern for read 1 or read 2")
        if self.read2_only and (self.pattern or not self.pattern2):
            raise ValueError("read2_only takes pattern2 alone")
        if self.retain_umi and self.method != "regex":
            raise ValueError("retain_umi needs the regex method")
        if self.either_read and (self.method != "regex" or not (self.pattern and self.pattern2)):
            raise ValueError("either_read needs two regex patterns")
        if self.quality_filter_threshold is not None and self.quality_filter_mask is not None:
            raise ValueError("filter by quality or mask, not both")
        if self.error_correct_cell and not self.filter_cell_barcode:
            raise ValueError("error_correct_cell needs filter_cell_barcode")
        if self.correct_umi_threshold and not self.filter_umi:
            raise ValueError("correct_umi_threshold needs filter_umi")


@dataclass(frozen=True)
class WhitelistOptions:
    """How real cell barcodes are told from errors."""

    method: str = "reads"
    knee_method: str = "distance"
    cell_number: int | None = None
    expect_cells: int | None = None
    error_correct_threshold: int = 1
    ed_above_threshold: str | None = None
    subset_reads: int | None = 100_000_000
    allow_threshold_error: bool = False

    def __post_init__(self) -> None:
        _one_of("method", self.method, ("reads", "umis"))
        _one_of("knee_method", self.knee_method, ("distance", "density"))
        if self.ed_above_threshold is not None:
            _one_of("ed_above_threshold", self.ed_above_threshold, ("discard", "correct"))
        if self.expect_cells and self.knee_method == "distance":
            raise ValueError("expect_cells needs the density method")
        if self.expect_cells and self.cell_number:
            raise ValueError("give expect_cells or cell_number, not both")
