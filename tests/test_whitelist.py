"""Knees against a plain calculation, and error handling."""

import numpy as np
import pytest

from strandlens.config import WhitelistOptions
from strandlens.operators import whitelist as w


def plain_knee(counts):
    values = np.cumsum(sorted(counts, reverse=True)).astype(float)

    def farthest(v):
        x = np.arange(len(v), dtype=float)
        dx, dy = x[-1], v[-1] - v[0]
        return int(np.argmax(np.round(np.abs(x * dy - (v - v[0]) * dx) / np.hypot(dx, dy), 6)))

    best, before = farthest(values), 0
    while best != before:
        before, best = best, farthest(values[: best * 3])
    return best + 1


@pytest.mark.parametrize("seed", range(12))
def test_distance_knee(seed):
    rng = np.random.default_rng(seed)
    counts = [*rng.integers(200, 400, rng.integers(5, 60)).tolist(), *rng.integers(1, 12, 500).tolist()]
    histogram = sorted(((n, counts.count(n)) for n in set(counts)), reverse=True)
    assert w.knee_by_distance(histogram) == plain_knee(counts)


def test_density_knee_splits_two_modes():
    histogram = sorted([(1000 + i, 3) for i in range(30)] + [(i, 40) for i in range(2, 12)], reverse=True)
    threshold = w.knee_by_density(histogram)
    assert 12 < threshold < 1000
    assert w.knee_by_density(histogram, expect_cells=100) is not None
    assert w.knee_by_density(histogram, expect_cells=10) is None
    grid, d = w.density(histogram)
    assert 0.8 < np.trapezoid(d, grid) < 1.01  # the grid ends at the data, the kernels don't


def test_whitelist(spark):
    rows = [("AAAA", 50), ("TTTT", 40), ("AAAT", 3), ("AATT", 2), ("CCCC", 1)]
    reads = spark.createDataFrame([(c, f"u{i}") for c, n in rows for i in range(n)], ["cell", "umi"])
    out = w.whitelist(reads, WhitelistOptions(cell_number=2)).orderBy("barcode").collect()
    assert [tuple(r) for r in out] == [("AAAA", "AAAT", 50, "3"), ("TTTT", "", 40, "")]
    assert {r.cell: r.n for r in w.cell_counts(reads.withColumn("umi", reads.cell), "umis").collect()} == {c: 1 for c, _ in rows}
    with pytest.raises(ValueError):
        w.knee_by_distance([(1, 5)])


def test_above_the_knee(spark):
    cells = spark.createDataFrame([("AAAA", 50), ("AAAT", 20), ("TTTT", 40), ("TTTAT", 5), ("GGGG", 9)], ["cell", "n"])
    stay, fixed = w.above_knee(cells, 1, "correct")
    assert {r.cell for r in stay.collect()} == {"AAAA", "TTTT", "GGGG"}
    assert [tuple(r) for r in fixed.collect()] == [("AAAT", "AAAA")]
    assert w.above_knee(cells, 1, "discard")[1].count() == 0
