"""Barcodes by expression: both ways of matching against a read by read one, and what runs where."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from strandlens.functions.patterns import fixed_layout, regex_extract


def plainly(pattern, seq, quals, retain_umi):
    m = regex.match(pattern, seq) if seq is not None else None
    if m is None:
        return False, None, None, None, None, None
    spans = {n: range(*m.span(n)) for n in sorted(m.re.groupindex) if m.span(n)[0] >= 0}
    at = lambda kind: {i for n, x in spans.items() if n.startswith(kind) for i in x}
    text = lambda kind: "".join(seq[i] for n, x in spans.items() if n.startswith(kind) for i in x)
    stay = [i for i in range(len(seq)) if i not in at("cell_") | at("discard_") | (set() if retain_umi else at("umi_"))]
    return True, text("cell_"), text("umi_"), "".join(quals[i] for i in sorted(at("umi_"))), "".join(seq[i] for i in stay), "".join(quals[i] for i in stay)


FIXED = [r"(?P<cell_1>.{4})(?P<umi_1>.{6})", r"(?P<discard_1>[AC])(?P<cell_2>.{2}T)(?P<umi_2>.{3})(?P<umi_1>A{1}.)(?P<discard_2>.)(?P<cell_1>..)", r"(?P<umi_1>A)"]
FREE = [r"(?P<cell_1>.{4})(?P<discard_1>(?:ACGT){s<=2})(?P<umi_1>.{2})", r"(?P<umi_2>.{2,4})(?P<cell_2>A*)(?P<umi_1>.{0,3})(?P<discard_1>T{3})?(?P<cell_1>C+)?", r"(?P<cell_1>.(?P<umi_1>..).)(?P<discard_1>.)", r"(?P<umi_1>A)|(?P<umi_2>CC)", r"(?P<umi_1>.)x?"]


@pytest.mark.parametrize("retain_umi", [False, True])
@pytest.mark.parametrize("pattern", FIXED + FREE)
def test_matches_equal_a_plain_reading(spark, pattern, retain_umi):
    rng = random.Random(5)
    seqs = [*["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 20))) for _ in range(300)], None, "", "AAAA\nAAAAAAAAAAA", "\u00e9A\r\U0001f600AAAAAATAAAAAA"]
    rows = [(s, "" if s is None else "".join(rng.choice("!5I") for _ in s)) for s in seqs]
    df = spark.createDataFrame(rows, "seq string, quals string").select("seq", "quals", regex_extract(pattern, retain_umi)(F.col("seq"), F.col("quals")).alias("m"))
    assert [tuple(r.m) for r in df.collect()] == [plainly(pattern, s, q, retain_umi) for s, q in rows]


@pytest.mark.parametrize(("patterns", "python"), [(FIXED, False), (FREE, True)])
def test_fixed_widths_need_no_python(spark, patterns, python):
    for pattern in patterns:
        assert (fixed_layout(pattern) is None) == python
        df = spark.createDataFrame([("ACGT", "IIII")], "seq string, quals string").select(regex_extract(pattern)(F.col("seq"), F.col("quals")).alias("m"))
        assert ("EvalPython" in df._jdf.queryExecution().toString()) == python


@pytest.mark.parametrize("pattern", [FIXED[2], FREE[4]])
def test_short_qualities_raise(spark, pattern):
    df = spark.createDataFrame([("ACGT", "III")], "seq string, quals string").select(regex_extract(pattern)(F.col("seq"), F.col("quals")).alias("m"))
    with pytest.raises(Exception, match="qualities of another length"):
        df.collect()
