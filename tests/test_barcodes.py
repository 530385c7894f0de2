"""Barcode, position and extraction expressions on small cases."""

import pytest
from pyspark.sql import functions as F

from strandlens.config import ExtractOptions, GroupingOptions, WhitelistOptions
from strandlens.functions import barcodes as bc
from strandlens.functions.distance import error_neighbours, hamming, matches_prefix, mean_distance, unique_near
from strandlens.functions.patterns import either_read, regex_extract
from strandlens.functions.positions import read_position
from strandlens.operators import extract


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_pattern(spark):
    p = bc.extract(F.lit("ACGTACGTAA"), F.lit("0123456789"), bc.Pattern("NXCCN"))
    assert one(spark, p).asDict() == {"cell": "GT", "umi": "AA", "umi_quals": "04", "seq": "CCGTAA", "quals": "156789", "long_enough": True}
    p = bc.extract(F.lit("ACGTACGTAA"), F.lit("0123456789"), bc.Pattern("XNN", three_prime=True))
    assert one(spark, p)["seq"] == "ACGTACGT" and one(spark, p)["umi"] == "AA"
    with pytest.raises(ValueError):
        bc.Pattern("NNZ")


def test_names_and_tags(spark):
    assert tuple(one(spark, bc.from_read_id(F.lit("r_1_CELL_UMI"), cell=True))) == ("UMI", "CELL")
    assert tuple(one(spark, bc.from_read_id(F.lit("alone"), cell=True))) == ("alone", None)
    assert tuple(one(spark, bc.from_prefixed_id(F.lit("a:UMI_AC:CELL_T:UMI_GG"), True))) == ("GG", "T")
    assert one(spark, bc.rewritten_id(F.lit("r1 x y"), F.lit("UU"), F.lit("CC"))) == "r1_CC_UU x y"
    assert one(spark, bc.without_pair_suffix(F.lit("r1/2 x"))) == "r1 x"
    with pytest.raises(Exception, match="suffix"):
        one(spark, bc.without_pair_suffix(F.lit("r1 x")))


def test_quality(spark):
    assert one(spark, bc.masked(F.lit("ACGT"), F.lit("!I+5"), 11)) == "NCNT"
    assert one(spark, bc.low_quality(F.lit("II"), 10)) is False
    assert one(spark, bc.low_quality(F.lit(""), 10)) is False
    assert one(spark, bc.possible_encodings(F.lit("BCD"))) == ["phred33", "phred64", "solexa"]


def test_distances(spark):
    assert one(spark, hamming(F.lit("ACGT"), F.lit("AGGA"))) == 2
    assert one(spark, hamming(F.lit("ACGT"), F.lit("ACG"))) is None
    assert one(spark, matches_prefix(F.lit("ACGT"), F.lit("AGTTT"), 1)) is True
    assert one(spark, matches_prefix(F.lit("ACGT"), F.lit("TTTTT"), 1)) is False
    listed = spark.createDataFrame([("AA",), ("TT",)], ["barcode"])
    fixes = {r.error: r.barcode for r in error_neighbours(listed).collect()}
    assert fixes["AN"] == "AA" and fixes["AT"] is None and "AA" not in fixes
    seen = spark.createDataFrame([("AC",), ("AT",), ("GG",), ("AA",)], ["cell"])
    assert [tuple(r) for r in unique_near(seen, listed).collect()] == [("AC", "AA")]
    df = spark.createDataFrame([("a", "AA"), ("a", "AT"), ("a", "TT"), ("b", "AA")], ["k", "umi"])
    assert {r.k: round(r.distance, 6) for r in mean_distance(df, ["k"]).collect()} == {"a": round(4 / 3, 6), "b": -1.0}


@pytest.mark.parametrize(
    ("pos", "reverse", "cigar", "want"),
    [(100, False, "5S25M", (95, 95, None)), (100, True, "25M5S", (100, 130, None)), (100, False, "20M100N10M", (100, 100, 20)), (100, True, "20M100N10M", (100, 230, 10)), (100, False, "25M5S", (100, 100, 25)), (100, False, "25M4S", (100, 100, None)), (100, True, "6S24M", (100, 124, 24))],
)
def test_read_position(spark, pos, reverse, cigar, want):
    assert tuple(one(spark, read_position(F.lit(pos), F.lit(reverse), F.lit(cigar)))) == want


def test_regex(spark):
    found = regex_extract("(?P<umi_1>.{2})(?P<discard_1>GT{s<=1})(?P<umi_0>.)")
    r = one(spark, found(F.col("s"), F.col("q")), s="ACGAXTTT", q="01234567")
    assert tuple(r) == (True, "", "XAC", "014", "TTT", "567")
    assert one(spark, found(F.col("s"), F.col("q")), s="ACCCXTTT", q="01234567")["matched"] is False
    with pytest.raises(ValueError):
        regex_extract("(?P<other>.)")


def test_either_read_by_quality(spark):
    find = regex_extract("(?P<discard_1>A)(?P<umi_1>.{2})")
    df = spark.createDataFrame([("ACCT", "IIII", "AGGT", "I!II"), ("ACCT", "IIII", "TGGT", "IIII")], ["s1", "q1", "s2", "q2"]).withColumns({"m1": find(F.col("s1"), F.col("q1")), "m2": find(F.col("s2"), F.col("q2"))})
    x = either_read(F.col("m1"), F.col("m2"), F.col("s1"), F.col("q1"), F.col("s2"), F.col("q2"), "quality")
    rows = [r["x"] for r in df.select(x.alias("x")).collect()]
    assert (rows[0]["event"], rows[0]["umi"], rows[0]["seq1"]) == ("regex matches both. read1 used", "CC", "ACCT")
    assert (rows[1]["umi"], rows[1]["seq1"], rows[1]["seq2"]) == ("CC", "T", "TGGT")


def test_extract_reads(spark):
    reads = spark.createDataFrame([(0, "a x", "AACCGGTT", "IIIIIIII"), (1, "b", "ATCCGGTT", "I!IIIIII"), (2, "c", "GGCCGGTT", "IIIIIIII")], ["ord", "identifier1", "seq1", "quals1"])
    listed = spark.createDataFrame([("AA",)], ["barcode"])
    out = extract.extract_reads(reads, ExtractOptions(pattern="CCNN", filter_cell_barcode=True, error_correct_cell=True, quality_filter_threshold=5), listed, error_neighbours(listed))
    got = {r.ord: (r.identifier1, r.seq1, r.event) for r in out.collect()}
    assert got == {0: ("a_AA_CC x", "GGTT", "reads output"), 1: ("b_AA_CC", "GGTT", "reads output"), 2: ("c", "GGCCGGTT", "cell not whitelisted")}
    log = extract.umi_correction_log(extract.extract_reads(reads, ExtractOptions(pattern="NN", filter_umi=True, correct_umi_threshold=1), umi_whitelist=listed))
    assert [tuple(r) for r in log.collect()] == [("AA", 1, 1)]
    with pytest.raises(Exception, match="shorter"):
        extract.extract_reads(reads, ExtractOptions(pattern="N" * 9)).collect()


def test_pairs_must_match(spark):
    one_ = spark.createDataFrame([(0, "a 1", "A", "I"), (1, "b 1", "C", "I")], ["ord", "identifier", "seq", "quals"])
    two = spark.createDataFrame([(0, "a 2", "A", "I"), (1, "x 2", "C", "I"), (2, "b 2", "G", "I")], ["ord", "identifier", "seq", "quals"])
    with pytest.raises(Exception, match="match"):
        extract.paired(one_, two).collect()
    assert {(r.seq1, r.seq2) for r in extract.paired(one_, two, reconcile=True).collect()} == {("A", "A"), ("C", "G")}


@pytest.mark.parametrize(
    ("kind", "options"),
    [(GroupingOptions, {"method": "x"}), (GroupingOptions, {"per_gene": True}), (GroupingOptions, {"subset": 2.0}), (GroupingOptions, {"gene_tag": "XF"}), (ExtractOptions, {}), (ExtractOptions, {"pattern": "N", "retain_umi": True}), (ExtractOptions, {"pattern": "N", "error_correct_cell": True}), (WhitelistOptions, {"expect_cells": 5}), (WhitelistOptions, {"knee_method": "x"})],
)
def test_options_are_checked(kind, options):
    with pytest.raises(ValueError):
        kind(**options)
