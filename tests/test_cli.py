"""The commands on small files."""

import random

import pytest

from strandlens.__main__ import main
from strandlens.sources import fastq

from .test_sources import SAM


def lines(folder):
    return sorted(x for f in folder.glob("part-*") for x in f.read_text().splitlines())


@pytest.fixture
def sam(tmp_path):
    path = tmp_path / "in.sam"
    path.write_text(SAM)
    return str(path)


def test_dedup_with_statistics(spark, sam, tmp_path):
    main(["dedup", "-I", sam, "-S", str(tmp_path / "out"), "--output-stats", str(tmp_path / "stats"), "--timeit", str(tmp_path / "time")], spark)
    assert [x.split("\t")[0] for x in lines(tmp_path / "out")] == ["r1_AAAA", "r3_AAAA"]
    assert (tmp_path / "out" / "header.sam").read_text().startswith("@HD")
    assert "AAAA\t1\t2\t2\t1\t2\t3" in lines(tmp_path / "stats_per_umi")
    assert (tmp_path / "time").read_text().startswith("dedup\tall\t")


def test_group_and_count(spark, sam, tmp_path):
    main(["group", "-I", sam, "-S", str(tmp_path / "g"), "--group-out", str(tmp_path / "t"), "--output-bam", "--per-gene", "--gene-tag", "XF"], spark)
    assert sum("BX:Z:AAAA" in x for x in lines(tmp_path / "g")) == 3
    assert any(x.startswith("r2_AAAT\tchr1\t100\tG1\tAAAT\t1\tAAAA\t2\t0") for x in lines(tmp_path / "t"))
    main(["count", "-I", sam, "-S", str(tmp_path / "c"), "--gene-tag", "XF"], spark)
    assert lines(tmp_path / "c") == ["G1\t1", "G2\t1", "gene\tcount"]


def test_count_tab(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a_C1_AAAA\tG1\nb_C1_AAAT\tG1\nc_C2_AAAA\tG1\n")
    main(["count_tab", "-I", str(tmp_path / "x.tsv"), "-S", str(tmp_path / "o"), "--per-cell"], spark)
    assert lines(tmp_path / "o") == ["C1\tG1\t1", "C2\tG1\t1", "cell\tgene\tcount"]


def test_whitelist_then_extract(spark, tmp_path):
    rng = random.Random(1)
    reads = [f"@r{i}\n{cell}{''.join(rng.choice('ACGT') for _ in range(4))}TTTT\n+\n{'I' * 12}\n" for i, cell in enumerate(["AAAA"] * 40 + ["CCCC"] * 30 + ["AAAT"] * 2 + ["GGTT"])]
    (tmp_path / "r.fastq").write_text("".join(reads))
    main(["whitelist", "-I", str(tmp_path / "r.fastq"), "-S", str(tmp_path / "w"), "-p", "CCCCNNNN", "--set-cell-number", "2", "--plot-prefix", str(tmp_path / "p")], spark)
    assert lines(tmp_path / "w") == ["AAAA\tAAAT\t40\t2", "CCCC\t\t30\t"]
    common = ["-p", "CCCCNNNN", "--filter-cell-barcode", "--error-correct-cell", "--whitelist", str(tmp_path / "w")]
    main(["extract", "-I", str(tmp_path / "r.fastq"), "-S", str(tmp_path / "o"), "--filtered-out", str(tmp_path / "bad"), *common], spark)
    out = fastq.read_fastq(spark, str(tmp_path / "o" / "part-*")).collect()
    assert len(out) == 72 and {r.seq for r in out} == {"TTTT"} and {r.identifier.split("_")[1] for r in out} == {"AAAA", "CCCC"}
    assert fastq.read_fastq(spark, str(tmp_path / "bad" / "part-*")).count() == 1


def test_whitelist_writes_rejected_reads_and_counts_matches(spark, tmp_path):
    """Reads without a barcode go to --filtered-out; --subset-reads counts those that have one, pairs
    may differ in name, and the density's curve and counts are written."""
    rng = random.Random(2)
    umi = lambda: "".join(rng.choice("ACGT") for _ in range(4))
    cells = ["AAAA"] * 40 + ["CCCC"] * 30 + ["TTTT"] * 2 + ["GGTT"]
    good = [f"@r{i}\n{c}{umi()}AC\n+\n{'I' * 10}\n" for i, c in enumerate(cells)]
    bad = [f"@b{i}\nGGGGGGGGGG\n+\n{'I' * 10}\n" for i in range(5)]
    (tmp_path / "r.fastq").write_text("".join(bad + good))
    (tmp_path / "s.fastq").write_text("".join(x.replace("@", "@other.") for x in bad + good))
    pattern = ["--extract-method", "regex", "-p", "(?P<cell_1>.{4})(?P<umi_1>.{4})AC"]
    main(["whitelist", "-I", str(tmp_path / "r.fastq"), "-S", str(tmp_path / "w"), *pattern, "--set-cell-number", "1", "--filtered-out", str(tmp_path / "f"), "--subset-reads", "50", "--plot-prefix", str(tmp_path / "p"), "--log", str(tmp_path / "log")], spark)
    assert fastq.read_fastq(spark, str(tmp_path / "f")).count() == 5 and "done in" in (tmp_path / "log").read_text()
    assert lines(tmp_path / "w") == ["AAAA\t\t40\t"]
    assert lines(tmp_path / "p_cell_barcode_counts") == ["1\t40\ttrue", "2\t11\tfalse", "rank\tn\ttaken"]
    main(["whitelist", "-I", str(tmp_path / "r.fastq"), "--read2-in", str(tmp_path / "s.fastq"), "-S", str(tmp_path / "w2"), *pattern, "--set-cell-number", "1", "--filtered-out2", str(tmp_path / "f2")], spark)
    assert lines(tmp_path / "w2") == ["AAAA\t\t40\t"]
    assert {r.identifier for r in fastq.read_fastq(spark, str(tmp_path / "f2")).collect()} == {f"other.b{i}" for i in range(5)}


def test_read2_to_stdout_packed(spark, tmp_path):
    (tmp_path / "1.fastq").write_text("@a\nACGTAC\n+\nIIIIII\n")
    (tmp_path / "2.fastq").write_text("@a\nGGG\n+\nIII\n")
    main(["extract", "-I", str(tmp_path / "1.fastq"), "--read2-in", str(tmp_path / "2.fastq"), "--read2-stdout", "-S", str(tmp_path / "o"), "-p", "NNNN", "--compress", "gzip", "--compresslevel", "9"], spark)
    assert [(r.identifier, r.seq) for r in fastq.read_fastq(spark, str(tmp_path / "o")).collect()] == [("a_ACGT", "GGG")]
    assert list((tmp_path / "o").glob("part-*.gz"))


def test_bam_out_and_in(spark, sam, tmp_path):
    main(["dedup", "-I", sam, "-S", str(tmp_path / "bam"), "--out-bam"], spark)
    main(["dedup", "-I", str(tmp_path / "bam"), "-S", str(tmp_path / "sam")], spark)
    main(["dedup", "-I", sam, "-S", str(tmp_path / "plain")], spark)
    assert lines(tmp_path / "sam") == lines(tmp_path / "plain")


def test_pairs(spark, sam, tmp_path):
    main(["pairs", "-I", sam, "-S", str(tmp_path / "o")], spark)
    assert [x.split("\t")[1] for x in lines(tmp_path / "o")] == ["147", "99", "147", "99"]
