"""Which cell barcodes are cells: counts, knees, error maps and barcodes above the knee."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WhitelistOptions
from ..functions.distance import hamming, matches_prefix, slices, unique_near
from .order import numbered


def cell_counts(extracted: DataFrame, method: str = "reads") -> DataFrame:
    """cell, n: reads or distinct UMIs of each barcode."""
    n = F.count(F.lit(1)) if method == "reads" else F.count_distinct("umi")
    return extracted.groupBy("cell").agg(n.alias("n"))


def count_histogram(counts: DataFrame) -> list[tuple[int, int]]:
    """(count, barcodes with it), highest first: what the knees need, one row per distinct count."""
    return sorted(((int(r[0]), int(r[1])) for r in counts.groupBy("n").count().collect()), reverse=True)


def knee_curve(counts: DataFrame) -> DataFrame:
    """cell, n, rank, total: barcodes by count, most frequent first, with the running total."""
    ranked = numbered(counts.select("cell", "n"), [F.col("n").desc(), F.col("cell")], "rank", "n", "before")
    return ranked.select("cell", "n", (F.col("rank") + 1).cast("int").alias("rank"), (F.col("before") + F.col("n")).alias("total"))


class _Curve:
    """Cumulative counts by rank, from the histogram: inside a run of equal counts it is a line."""

    def __init__(self, histogram: list[tuple[int, int]]) -> None:
        self.n = np.array([n for n, _ in histogram], float)
        self.many = np.array([m for _, m in histogram], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.many)))[:-1]
        self.before = np.concatenate(([0], np.cumsum(self.n * self.many)))[:-1]
        self.size = int(self.many.sum())

    def at(self, i: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.first, i, "right") - 1
        return self.before[k] + (i - self.first[k] + 1) * self.n[k]

    def farthest(self, size: int) -> int:
        """The rank below size that lies farthest from the line between the first and last point.
        Along a run the distance is a line's, or two lines' where it changes sign, so run ends
        and the curve's own ends hold the maximum, the first of equals."""
        ends = np.concatenate((self.first, self.first + self.many - 1))
        i = np.unique(np.clip(ends, 0, size - 1))
        x, y = i.astype(float), self.at(i) - self.at(np.array([0]))[0]
        dx, dy = float(size - 1), float(self.at(np.array([size - 1]))[0] - self.at(np.array([0]))[0])
        if not dx:
            return 0
        distance = np.abs(x * dy - y * dx) / np.hypot(dx, dy)
        return int(i[np.argmax(distance >= distance.max() * (1 - 1e-12))])


def knee_by_distance(histogram: list[tuple[int, int]], rounds: int = 100) -> int:
    """How many of the most frequent barcodes are cells: the farthest point of the cumulative curve
    from its chord, sought again among three times as many points until it stays."""
    curve = _Curve(histogram)
    if not curve.size:
        raise ValueError("no barcodes")
    best, before = curve.farthest(curve.size), 0
    if best == 0:
        raise ValueError("the cumulative counts have no knee")
    for _ in range(rounds + 1):
        if best == before:
            break
        before, best = best, curve.farthest(min(curve.size, best * 3))
    return best + 1


def density(histogram: list[tuple[int, int]], points: int = 10_000, bandwidth: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(log10 count, density): a Gaussian kernel estimate over barcodes of more than a thousandth
    of the highest count; the kernel's width is bandwidth times their standard deviation."""
    top = histogram[0][0]
    x = np.array([(np.log10(n), m) for n, m in histogram if n > 0.001 * top])
    value, weight = x[:, 0], x[:, 1]
    mean, total = np.average(value, weights=weight), weight.sum()
    deviation = np.sqrt((weight * (value - mean) ** 2).sum() / (total - 1)) if total > 1 else 0.0
    if not deviation:
        raise ValueError("the counts don't differ")
    grid = np.linspace(value.min(), value.max(), points)
    width = bandwidth * deviation
    out = np.zeros(points)
    for v, w in zip(value, weight, strict=True):
        out += w * np.exp(-0.5 * ((grid - v) / width) ** 2)
    return grid, out / (total * width * np.sqrt(2 * np.pi))


def knee_by_density(histogram: list[tuple[int, int]], expect_cells: int | None = None, points: int = 10_000) -> float | None:
    """The count above which barcodes are cells: a local minimum of the density, the highest that
    fits the expected number (more than a tenth of it and no more than it) or, without one, that
    lies in the upper four fifths of the grid and half a unit below the maximum or under half of
    it. None if there is none."""
    grid, d = density(histogram, points)
    low = np.flatnonzero((d[1:-1] < d[:-2]) & (d[1:-1] < d[2:])) + 1
    counts, many = np.array([n for n, _ in histogram]), np.array([m for _, m in histogram])
    for k in low[::-1]:
        threshold = 10 ** grid[k]
        if expect_cells:
            passing = many[counts > threshold].sum()
            good = 0.1 * expect_cells < passing <= expect_cells
        else:
            good = k >= 0.2 * points and (grid[-1] - grid[k] > 0.5 or grid[k] < grid[-1] / 2)
        if good:
            return float(threshold)
    return None


def nth_count(histogram: list[tuple[int, int]], k: int) -> int:
    """The count at place k, from 0, of the barcodes by count."""
    for n, m in histogram:
        if k < m:
            return n
        k -= m
    raise ValueError("fewer barcodes than cells asked for")


def top_cells(counts: DataFrame, k: int) -> DataFrame:
    """Barcodes of more reads than the one at place k; ties at the threshold are left out."""
    return counts.where(F.col("n") > nth_count(count_histogram(counts), k))


def select_cells(counts: DataFrame, options: WhitelistOptions) -> DataFrame | None:
    """cell, n of the barcodes taken as cells, None where the density method finds no threshold."""
    histogram = count_histogram(counts)
    if options.cell_number:
        return counts.where(F.col("n") > nth_count(histogram, options.cell_number))
    if options.knee_method == "density":
        threshold = knee_by_density(histogram, options.expect_cells)
        if threshold is None and not options.allow_threshold_error:
            raise ValueError("no local minimum of the density is accepted as threshold")
        return None if threshold is None else counts.where(F.col("n") > threshold)
    many = knee_by_distance(histogram)
    least = nth_count(histogram, many - 1)
    above = sum(m for n, m in histogram if n > least)
    tied = counts.where(F.col("n") == least).orderBy("cell").limit(many - above)  # the knee may cut a tie
    return counts.where(F.col("n") > least).unionByName(tied)


def threshold_table(histogram: list[tuple[int, int]], options: WhitelistOptions) -> list[tuple[int, str]]:
    """(count, action) of the candidate thresholds of the density, or the knee's rank alone."""
    if options.knee_method == "distance":
        return [(knee_by_distance(histogram) - 1, "Selected")]
    chosen = knee_by_density(histogram, options.expect_cells)
    grid, d = density(histogram)
    low = np.flatnonzero((d[1:-1] < d[:-2]) & (d[1:-1] < d[2:])) + 1
    return [(sum(m for n, m in histogram if n > 10 ** grid[k]), "Selected" if chosen == 10 ** grid[k] else "Rejected") for k in low[::-1]]


def near_heavier(cells: DataFrame, errors: int = 1) -> DataFrame:
    """cell, other, substitution: each cell and every heavier one of which a prefix is within the
    errors. One of errors + 1 slices of the cell stands in the other one, moved by up to errors
    places, so only barcodes with a common part meet: the other one offers, for each length that a
    cell may have, its parts at the slices' places and up to errors beside them."""
    part = F.explode(slices(F.col("cell"), errors)).alias("s")
    left = cells.select("cell", "n", F.length("cell").alias("len"), part).select("cell", "n", "len", "s.slice", "s.part")
    lengths = F.explode(F.sequence(F.greatest(F.length("cell") - errors, F.lit(0)), F.length("cell") + errors)).alias("len")
    k = errors + 1
    begin = lambda i: F.floor(F.col("len") * i / k).cast("int")
    spots = F.explode(F.array(*[F.struct(F.lit(i).alias("slice"), (begin(i) + 1).alias("at"), (begin(i + 1) - begin(i)).alias("width")) for i in range(k)])).alias("s")
    moved = F.explode(F.sequence(F.lit(-errors), F.lit(errors))).alias("by")
    right = cells.select(F.col("cell").alias("other"), F.col("n").alias("on"), "cell", lengths).select("other", "on", "len", spots).select("other", "on", "len", "s.*", moved).where("at + by >= 1")
    right = right.select("other", "on", "len", "slice", F.substring("other", F.col("at") + F.col("by"), F.col("width")).alias("part")).distinct()
    heavier = (F.col("on") > F.col("n")) | ((F.col("on") == F.col("n")) & (F.col("other") < F.col("cell")))
    close = left.join(right, ["len", "slice", "part"]).where(heavier & (F.abs(F.length("cell") - F.length("other")) <= errors)).select("cell", "other").distinct()
    found = close.where(matches_prefix(F.col("cell"), F.col("other"), errors))
    same = hamming(F.col("cell"), F.substring("other", F.lit(1), F.length("cell"))) <= errors
    return found.withColumn("substitution", F.coalesce(same, F.lit(False)))


def density_curve(histogram: list[tuple[int, int]], points: int = 10_000) -> list[tuple[float, float, bool]]:
    """(log10 count, density, whether it is a local minimum): what the density method's plot shows."""
    grid, d = density(histogram, points)
    low = np.concatenate(([False], (d[1:-1] < d[:-2]) & (d[1:-1] < d[2:]), [False]))
    return [(float(x), float(y), bool(m)) for x, y, m in zip(grid, d, low, strict=True)]


def count_curve(counts: DataFrame, cells: DataFrame | None) -> DataFrame:
    """rank, n, taken: counts by rank, and whether they are cells'."""
    taken = counts.select("cell").where("false") if cells is None else cells.select("cell")
    marked = counts.join(taken.withColumn("_taken", F.lit(True)), "cell", "left")
    ranked = numbered(marked, [F.col("n").desc(), F.col("cell")], "rank")
    return ranked.select((F.col("rank") + 1).alias("rank"), "n", F.col("_taken").isNotNull().alias("taken"))


def above_knee(cells: DataFrame, errors: int = 1, resolve: str = "discard") -> tuple[DataFrame, DataFrame]:
    """(cells that stay, cell-to-true-cell corrections): a cell that looks like an error of a heavier
    one goes; with ``correct`` it is mapped to it if it is the only one and differs by
    substitutions alone."""
    near = near_heavier(cells, errors)
    gone = near.groupBy("cell").agg(F.count(F.lit(1)).alias("hits"), F.min("other").alias("barcode"), F.bool_or("substitution").alias("substitution"))
    stay = cells.join(gone.select("cell"), "cell", "left_anti")
    fixed = gone.where("hits = 1 and substitution").select("cell", "barcode")
    return stay, fixed if resolve == "correct" else fixed.where("false")


def whitelist(extracted: DataFrame, options: WhitelistOptions) -> DataFrame | None:
    """barcode, errors, count, error_counts: each cell with the barcodes corrected to it and their
    counts, comma-separated in the barcodes' order. extracted has cell and umi, one row per read."""
    counts = cell_counts(extracted, options.method)
    cells = select_cells(counts, options)
    if cells is None:
        return None
    none = counts.where("false").select("cell", F.col("cell").alias("barcode"))
    fixes = unique_near(counts, cells.select(F.col("cell").alias("barcode")), threshold=options.error_correct_threshold) if options.error_correct_threshold > 0 else none
    if options.ed_above_threshold:
        cells, more = above_knee(cells, options.error_correct_threshold or 1, options.ed_above_threshold)
        fixes = fixes.join(cells.select(F.col("cell").alias("barcode")), "barcode", "left_semi").select("cell", "barcode").unionByName(more)
    errors = fixes.join(counts, "cell").groupBy("barcode").agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("e"))
    joined = cells.select(F.col("cell").alias("barcode"), F.col("n").alias("count")).join(errors, "barcode", "left")
    text = lambda f: F.coalesce(F.array_join(F.transform("e", f), ","), F.lit(""))
    return joined.select("barcode", text(lambda x: x["cell"]).alias("errors"), "count", text(lambda x: x["n"].cast("string")).alias("error_counts"))
