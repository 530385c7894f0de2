"""Files: FASTQ, SAM and BAM round trips, small tables, molecules from alignments."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandlens.config import GroupingOptions
from strandlens.functions.positions import read_position
from strandlens.operators import bundles, extract, molecules, pairs
from strandlens.sources import alignments as al
from strandlens.sources import fastq, tables

SAM = """@HD\tVN:1.6
@SQ\tSN:chr2\tLN:1000
@SQ\tSN:chr1\tLN:1000
r1_AAAA\t99\tchr1\t101\t30\t10M\t=\t151\t60\tACGTACGTAC\tIIIIIIIIII\tXF:Z:G1\tNH:i:1
r1_AAAA\t147\tchr1\t151\t30\t10M\t=\t101\t-60\tACGTACGTAC\tIIIIIIIIII\tXF:Z:G1
r2_AAAT\t99\tchr1\t101\t20\t10M\t=\t151\t60\tACGTACGTAC\tIIIIIIIIII\tXF:Z:G1\tNH:i:2
r2_AAAT\t147\tchr1\t151\t20\t10M\t=\t101\t-60\tACGTACGTAC\tIIIIIIIIII
r3_AAAA\t0\tchr2\t5\t60\t10M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\tXF:Z:G2
r4_CCCC\t4\t*\t0\t0\t*\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII
"""


@pytest.fixture
def sam(spark, tmp_path):
    path = tmp_path / "x.sam"
    path.write_text(SAM)
    return al.read_sam(spark, str(path)), str(path)


def test_sam_round_trip(spark, sam, tmp_path):
    reads, path = sam
    assert reads.count() == 6
    body = [line for line in SAM.splitlines() if not line.startswith("@")]
    assert [r.value for r in al.as_sam_lines(reads.orderBy("ord")).collect()] == body
    header = al.sam_header(spark, path)
    assert al.contigs(header) == ["chr2", "chr1"]
    al.write_sam(reads, str(tmp_path / "out"), header)
    again = al.read_sam(spark, str(tmp_path / "out"))
    assert [r.rname for r in again.orderBy("ord").collect()] == ["chr2", "chr1", "chr1", "chr1", "chr1", "*"]


def bam_bytes(lines, refs):
    def block(data):
        packed = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packed.compress(data) + packed.flush()
        head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
        return head + body + struct.pack("<II", zlib.crc32(data), len(data))

    out = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", 1000) for r in refs)
    for line in lines:
        f = line.split("\t")
        name, seq = f[0].encode() + b"\0", f[9]
        ref = refs.index(f[2]) if f[2] != "*" else -1
        nxt = ref if f[6] == "=" else refs.index(f[6]) if f[6] != "*" else -1
        cigar = [int(f[5][:-1]) << 4] if f[5] != "*" else []
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq + "=" * (len(seq) % 2)]
        tags = b"".join(x[:2].encode() + (b"Z" + x[5:].encode() + b"\0" if x[3] == "Z" else b"C" + bytes([int(x[5:])])) for x in f[11:])
        data = struct.pack("<iiBBHHHiiii", ref, int(f[3]) - 1, len(name), int(f[4]), 0, len(cigar), int(f[1]), len(seq), nxt, int(f[7]) - 1, int(f[8]))
        data += name + b"".join(struct.pack("<I", c) for c in cigar) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes(ord(q) - 33 for q in f[10]) + tags
        out += struct.pack("<i", len(data)) + data
    return b"".join(block(out[i : i + 97]) for i in range(0, len(out), 97)) + block(b"")


def test_bam_equals_sam(spark, sam, tmp_path):
    reads, _ = sam
    body = [line for line in SAM.splitlines() if not line.startswith("@")]
    (tmp_path / "x.bam").write_bytes(bam_bytes(body, ["chr2", "chr1"]))
    bam = al.read_bam(spark, str(tmp_path / "x.bam"))
    assert [r.value for r in al.as_sam_lines(bam.orderBy("ord")).collect()] == body


def test_lines_are_numbered_without_a_sort(spark, tmp_path):
    """By file and place, over the edges of splits, however files are packed into tasks."""
    from strandlens.operators.order import numbered_lines

    sizes = [5, 900, 1, 300]
    for k, n in enumerate(sizes):
        (tmp_path / f"p{k}").write_text("@head\n" + "".join(f"{k}.{i}\n" for i in range(n)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = spark.read.text(str(tmp_path)).where("value not like '@%'").select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        out = numbered_lines(lines, "number")
        assert "Sort [file" not in out._jdf.queryExecution().executedPlan().toString().split("Window")[0]
        rows = out.orderBy("number").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [(r.number, r.value) for r in rows] == list(enumerate(f"{k}.{i}" for k, n in enumerate(sizes) for i in range(n)))


def test_fastq(spark, tmp_path):
    text = "@a 1\nACGT\n+\nIIII\n@b 1\nGG\n+b\n!!\n"
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text)
    for name in ("a.fastq", "b.fastq.gz"):
        rows = fastq.read_fastq(spark, str(tmp_path / name)).orderBy("ord").collect()
        assert [(r.ord, r.identifier, r.seq, r.quals) for r in rows] == [(0, "a 1", "ACGT", "IIII"), (1, "b 1", "GG", "!!")]
    fastq.write_fastq(fastq.read_fastq(spark, str(tmp_path / "a.fastq")), str(tmp_path / "out"))
    assert fastq.read_fastq(spark, str(tmp_path / "out" / "part-*")).count() == 2
    (tmp_path / "bad.fastq").write_text("@a\nACGT\nIIII\n")
    with pytest.raises(Exception, match=r"\+ line"):
        fastq.read_fastq(spark, str(tmp_path / "bad.fastq")).collect()


def record(i, rng, name=None):
    n = rng.randint(1, 40)
    return f"@{name or f'r{i} x'}\n{''.join(rng.choice('ACGT') for _ in range(n))}\n+\n{''.join(rng.choice('@+I!') for _ in range(n))}\n"


@pytest.mark.parametrize("split", ["128m", "1000", "90"])
def test_fastq_splits_and_folders(spark, tmp_path, split):
    """Records that lie over the edges of splits, several files in a folder, blank last lines."""
    rng = random.Random(7)
    one, two = [record(i, rng) for i in range(300)], [record(i, rng) for i in range(120)]
    (tmp_path / "d d").mkdir()
    (tmp_path / "d d" / "a.fastq").write_text("".join(one) + "\n\n")
    (tmp_path / "d d" / "b.fastq").write_text("".join(two).rstrip("\n"))
    with gzip.open(tmp_path / "d d" / "c.fastq.gz", "wt") as f:
        f.write("".join(two))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = fastq.read_fastq(spark, str(tmp_path / "d d")).orderBy("file_no", "ord").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [f"@{r.identifier}\n{r.seq}\n+\n{r.quals}\n" for r in rows] == one + two + two
    assert [r.ord for r in rows] == [*range(300), *range(120), *range(120)]


@pytest.mark.parametrize("text", ["@a\nACGT\n+\n", "@a\nACGT\n+\nIIII\nb\nA\n+\nI\n", "@a\nACGT\n+\nIII\n", "@a\nA\n+\nI\n\n@b\nA\n+\nI\n"])
@pytest.mark.parametrize("packed", [False, True])
def test_bad_fastq(spark, tmp_path, text, packed):
    with (gzip.open(tmp_path / "x.fastq.gz", "wt") if packed else open(tmp_path / "x.fastq", "w")) as f:
        f.write(text)
    with pytest.raises(Exception, match="record"):
        fastq.read_fastq(spark, str(tmp_path / "x.fastq*")).collect()


def test_lines_need_no_expression_for_their_file(spark, tmp_path):
    """The name of a file is rewritten once, not for each of its lines."""
    (tmp_path / "a.fastq").write_text("@a\nA\n+\nI\n")
    assert "regexp_replace" not in fastq.read_fastq(spark, str(tmp_path))._jdf.queryExecution().toString()


def sides(tmp_path, names1, names2):
    rng = random.Random(3)
    for side, files in (("r1", names1), ("r2", names2)):
        (tmp_path / side).mkdir()
        for k, names in enumerate(files):
            (tmp_path / side / f"{k}.fastq").write_text("".join(record(0, rng, n) for n in names))
    return tuple(str(tmp_path / s) for s in ("r1", "r2"))


def test_pairs_of_several_files(spark, tmp_path):
    names = [["a", "b", "c"], ["d"], ["e", "f"]]
    one, two = (fastq.read_fastq(spark, p) for p in sides(tmp_path, names, names))
    both = extract.paired(one, two)
    assert both.count() == 6
    assert [(r.file_no, r.ord, r.identifier1, r.identifier2) for r in both.orderBy("file_no", "ord").collect()] == [(k, i, n, n) for k, f in enumerate(names) for i, n in enumerate(f)]
    assert extract.first_reads(both, 4).count() == 4 and {r.file_no for r in extract.first_reads(both, 4).collect()} == {0, 1}
    fastq.write_fastq(both, str(tmp_path / "out"), "1")
    assert [r.identifier for r in fastq.read_fastq(spark, str(tmp_path / "out")).orderBy("file_no", "ord").collect()] == list("abcdef")


@pytest.mark.parametrize(("names1", "names2"), [([["a", "b"]], [["a", "x"]]), ([["a", "b"]], [["a"]]), ([["a"], ["b"]], [["a"]]), ([["a"]], [["a", "b"]]), ([["a", "b"], ["c"]], [["a", "c"], ["b"]])])
def test_pairs_that_do_not_match_raise(spark, tmp_path, names1, names2):
    one, two = (fastq.read_fastq(spark, p) for p in sides(tmp_path, names1, names2))
    both = extract.paired(one, two)
    for columns in (["seq1"], ["seq2"], ["ord"], both.columns):
        with pytest.raises(Exception, match="pairs don't match"):
            both.select(*columns).collect()
    if sum(map(len, names1)) == sum(map(len, names2)) and len(names1) == 1:
        assert extract.paired(one, two, names_differ=True).count() == 2


def test_reconciled_by_name_in_one_shuffle(spark):
    """The k-th of a name with the k-th, reads without a counterpart or a name left out."""
    read = lambda side, names: spark.createDataFrame([(0, i, n, f"{side}{i}", "I") for i, n in enumerate(names)], "file_no int, ord long, identifier string, seq string, quals string")
    one, two = read("A", ["a x", "b", "a y", "c", "a z", "", None]), read("C", ["d", "a", "b 2", "b 3", "a 2", None])
    both = extract.paired(one, two, reconcile=True)
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.ord, r.identifier1, r.seq1, r.identifier2, r.seq2, r.quals2) for r in both.collect()) == [(0, "a x", "A0", "a", "C1", "I"), (1, "b", "A1", "b 2", "C2", "I"), (2, "a y", "A2", "a 2", "C4", "I")]


def test_reads_without_operations(spark, sam):
    """A mapped read whose CIGAR is * is left out by position, with an event of its own."""
    reads, _ = sam
    odd = reads.withColumn("cigar", F.when(F.col("qname") == "r1_AAAA", F.lit("*")).otherwise(F.col("cigar")))
    assert {r.event: r.n for r in bundles.event_counts(bundles.classified(odd, GroupingOptions())).collect()} == {"kept": 2, "no alignment": 1, "read 2": 2, "single end unmapped": 1}
    assert sorted(r.qname for r in molecules.dedup(odd, GroupingOptions()).collect()) == ["r2_AAAT", "r3_AAAA"]
    cigars = ["*", "", None, "10M", "3S7M", "7M3S", "3S4M3S", "5M100N5M", "2H8M", "3S2M1I4M"]
    got = spark.createDataFrame([(c, r) for c in cigars for r in (False, True)], "c string, r boolean").select("c", "r", read_position(F.lit(100), F.col("r"), F.col("c"), 2).alias("x")).collect()
    want = {"*": (100, 100, 100, None, None), "": (100, 100, 100, None, None), None: (100, 100, 100, None, None), "10M": (100, 100, 110, None, None), "3S7M": (97, 97, 107, None, 7), "7M3S": (100, 100, 110, 7, None), "3S4M3S": (97, 97, 107, 7, 7), "5M100N5M": (100, 100, 210, 5, 5), "2H8M": (100, 100, 108, None, None), "3S2M1I4M": (97, 97, 106, None, 6)}
    assert {(r.c, r.r): tuple(r.x) for r in got} == {(c, back): ((100, end, s2) if back else (start, pos, s1)) for c, (start, pos, end, s1, s2) in want.items() for back in (False, True)}


def test_small_tables(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("#c\nAA\tAC,AG\t5\nTT\t\t2\n")
    assert {r.barcode for r in tables.barcode_list(spark, str(tmp_path / "w.tsv")).collect()} == {"AA", "TT"}
    assert {tuple(r) for r in tables.whitelist_fixes(spark, str(tmp_path / "w.tsv")).collect()} == {("AC", "AA"), ("AG", "AA")}
    assert tables.barcode_list(spark, str(tmp_path / "w.tsv"), str(tmp_path / "w.tsv")).count() == 4
    (tmp_path / "g.tsv").write_text("G1\tchr1\nG2\tchr9\n")
    assert [tuple(r) for r in tables.gene_map(spark, str(tmp_path / "g.tsv"), ["chr1"]).collect()] == [("G1", "chr1")]
    (tmp_path / "bad.tsv").write_text("a\tb\tc\n")
    with pytest.raises(Exception, match="two columns"):
        tables.read_genes(spark, str(tmp_path / "bad.tsv")).collect()


def test_paired_dedup_keeps_mates(sam):
    reads, _ = sam
    out = molecules.dedup(reads, GroupingOptions(paired=True, unmapped_reads="output"))
    assert sorted((r.qname, r.flag) for r in out.collect()) == [("r1_AAAA", 99), ("r1_AAAA", 147), ("r3_AAAA", 0), ("r4_CCCC", 4)]
    assert {r.event: r.n for r in bundles.event_counts(bundles.classified(reads, GroupingOptions())).collect()} == {"kept": 3, "read 2": 2, "single end unmapped": 1}


def test_group_sets_tags(sam):
    reads, _ = sam
    o = GroupingOptions(per_gene=True, gene_tag="XF")
    rows = {r.read_id: (r.final_umi, r.final_umi_count, r.unique_id) for r in molecules.group_table(molecules.group(reads, o), o).collect()}
    assert rows == {"r1_AAAA": ("AAAA", 2, 0), "r2_AAAT": ("AAAA", 2, 0), "r3_AAAA": ("AAAA", 1, 1)}
    tagged = molecules.group(reads, o).where(F.col("qname") == "r2_AAAT").first()["tags"]
    assert tagged["BX"] == "AAAA" and tagged["UG"] == "0" and tagged["NH"] == "2"


def test_multimapping_sniff(sam):
    reads, _ = sam
    tagged = reads.where(F.map_contains_key("tags", F.lit("NH")))
    assert bundles.multimapping_tags(reads) == [] and bundles.multimapping_tags(tagged) == ["NH"]
    bundles.check_multimapping(tagged, GroupingOptions(multimapping="NH"))
    with pytest.raises(ValueError, match="they have NH"):
        bundles.check_multimapping(tagged, GroupingOptions(multimapping="XT"))
    with pytest.raises(ValueError, match="leave the detection out"):
        bundles.check_multimapping(reads, GroupingOptions(multimapping="XT"))


def test_template_pairs(sam):
    reads, _ = sam
    tagged = reads.withColumn("tags", F.when(F.col("flag") == 99, F.map_concat("tags", F.create_map(F.lit("UG"), F.lit("7")))).otherwise(F.col("tags")))
    out = pairs.template_pairs(tagged).collect()
    assert sorted((r.read1.qname, r.read1.flag, r.read2.flag, r.read2.tags["UG"]) for r in out) == [("r1_AAAA", 99, 147, "7"), ("r2_AAAT", 99, 147, "7")]


def test_streaming_first_reads(spark, tmp_path):
    from strandlens.streaming.dedup import first_reads

    rows = spark.createDataFrame([("r1_AA", 1), ("r2_AA", 2), ("r3_CC", 3)], ["qname", "s"]).select(
        "qname", F.lit(0).alias("flag"), F.lit("chr1").alias("rname"), F.lit(5).alias("pos"), F.lit(9).alias("mapq"), F.lit("10M").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("tlen"), F.lit("*").alias("seq"),
        F.create_map(F.lit("XF"), F.lit("g")).alias("tags"), F.timestamp_seconds("s").alias("time"),
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = first_reads(stream, GroupingOptions(), "time").writeStream.format("memory").queryName("first_reads").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.umi for r in spark.table("first_reads").collect()) == ["AA", "CC"]
