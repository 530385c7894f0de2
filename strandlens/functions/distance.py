"""Distances between barcodes, and joins of barcodes that are near."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGTN"


def hamming(a: Column, b: Column, length: int | None = None) -> Column:
    """Differing bases of two barcodes of equal length, null if the lengths differ. With a known
    length it is a sum of comparisons that runs in generated code."""
    if length is not None:
        total = F.lit(0)
        for i in range(1, length + 1):
            total = total + (F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int")
    else:
        total = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), total)


def slices(barcode: Column, threshold: int, length: Column | None = None) -> Column:
    """threshold + 1 numbered slices: two barcodes within the threshold share one at least."""
    n = F.length(barcode) if length is None else length
    k = threshold + 1
    return F.array(*[
        F.struct(F.lit(i).alias("slice"), F.substring(barcode, F.floor(n * i / k).cast("int") + 1, F.floor(n * (i + 1) / k).cast("int") - F.floor(n * i / k).cast("int")).alias("part"))
        for i in range(k)
    ])


def rests(barcode: Column) -> Column:
    """The barcode without each of its bases, numbered by place like slices."""
    rest = lambda i: F.concat(F.substring(barcode, F.lit(1), i - 1), F.substring(barcode, i + 1, F.length(barcode)))
    places = F.when(F.length(barcode) > 0, F.sequence(F.lit(1), F.length(barcode))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("slice"), rest(i).alias("part")))


def near_pairs(df: DataFrame, keys: list[str], barcode: str = "umi", threshold: int = 1, length: int | None = None, extra: tuple[str, ...] = (), names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """keys, a, b, distance and extra_a, extra_b of all pairs a < b within the threshold that agree
    in the keys, null with null; names other than a and b can be given.

    An equi-join, so no bundle is compared all against all. At a threshold of 1 it is on a place and
    the other bases, which two barcodes share exactly if they differ there alone: only results
    meet. Beyond, it is on slices, and each pair is reported by the first slice it shares.
    """
    columns = [F.col(barcode).alias("_x"), *[F.col(c).alias(f"_x_{c}") for c in extra]]
    cut = df.select(*keys, *columns, F.explode(rests(F.col(barcode)) if threshold == 1 else slices(F.col(barcode), threshold)).alias("_s"))
    cut = cut.select(*keys, "_x", *[f"_x_{c}" for c in extra], F.col("_s.slice").alias("_slice"), F.col("_s.part").alias("_part"), F.length("_x").alias("_n"))
    one, two = (cut.withColumnsRenamed({"_x": x, **{f"_x_{c}": f"{c}_{x}" for c in extra}}) for x in names)
    shared_by = [*keys, "_slice", "_part", "_n"]
    two = two.withColumnsRenamed({k: f"_r_{k}" for k in shared_by})
    joined = one.join(two, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in shared_by]).where(F.col(names[0]) < F.col(names[1]))
    if threshold == 1:
        return joined.select(*keys, *names, *[f"{c}_{x}" for c in extra for x in names], F.lit(1).alias("distance"))
    first, second = (slices(F.col(x), threshold) for x in names)
    shared = F.array_position(F.zip_with(first, second, lambda x, y: x["part"] == y["part"]), True) - 1
    found = joined.withColumn("distance", hamming(F.col(names[0]), F.col(names[1]), length)).where(F.col("distance") <= threshold)
    if threshold:
        found = found.where(shared == F.col("_slice"))
    return found.select(*keys, *names, *[f"{c}_{x}" for c in extra for x in names], "distance")


def matches_prefix(barcode: Column, target: Column, errors: int) -> Column:
    """Whether some prefix of target is within so many substitutions, insertions and deletions."""
    lengths = F.sequence(F.greatest(F.length(barcode) - errors, F.lit(0)), F.length(barcode) + errors)
    return F.exists(lengths, lambda k: F.levenshtein(barcode, F.substring(target, F.lit(1), k), errors) >= 0)


def error_neighbours(whitelist: DataFrame, barcode: str = "barcode", threshold: int = 1) -> DataFrame:
    """error, barcode: every string with 1..threshold substituted bases of a whitelisted barcode; a
    null barcode where several fit. Strings that are themselves listed are left out."""
    near = whitelist.select(F.col(barcode).alias("barcode"), F.col(barcode).alias("error"))
    for _ in range(threshold):
        at = F.explode(F.sequence(F.lit(1), F.length("error"))).alias("at")
        step = near.select("barcode", "error", at).select("barcode", "error", "at", F.explode(F.array(*[F.lit(b) for b in BASES])).alias("base"))
        changed = F.concat(F.substring("error", F.lit(1), F.col("at") - 1), "base", F.substring("error", F.col("at") + 1, F.lit(1_000_000)))
        near = step.select("barcode", changed.alias("error")).distinct()
    listed = whitelist.select(F.col(barcode).alias("error"))
    one = F.when(F.count_distinct("barcode") == 1, F.first("barcode")).alias("barcode")
    return near.join(listed, "error", "left_anti").groupBy("error").agg(one)


def unique_near(barcodes: DataFrame, whitelist: DataFrame, barcode: str = "cell", listed: str = "barcode", threshold: int = 1) -> DataFrame:
    """barcode, listed: the barcodes not in the whitelist with exactly one entry within the
    threshold. An equi-join on slices of both sides."""
    own = barcodes.select(F.col(barcode).alias("x")).distinct().join(whitelist.select(F.col(listed).alias("x")), "x", "left_anti")
    left = own.select("x", F.length("x").alias("_n"), F.explode(slices(F.col("x"), threshold)).alias("s")).select("x", "_n", "s.*")
    right = whitelist.select(F.col(listed).alias("w"), F.length(listed).alias("_n"), F.explode(slices(F.col(listed), threshold)).alias("s")).select("w", "_n", "s.*")
    near = left.join(right, ["_n", "slice", "part"]).where(hamming(F.col("x"), F.col("w")) <= threshold).select("x", "w").distinct()
    return near.groupBy("x").agg(F.min("w").alias(listed), F.count(F.lit(1)).alias("_hits")).where("_hits = 1").select(F.col("x").alias(barcode), listed)


def mean_distance(df: DataFrame, keys: list[str], barcode: str = "umi") -> DataFrame:
    """keys, distance: the mean Hamming distance over all pairs of a bundle's barcodes, -1 for one.

    Counted per position: of m barcodes with c of each base, m(m-1)/2 minus the equal pairs differ,
    so the work grows with the barcodes and not with their pairs."""
    bases = df.select(*keys, barcode, F.posexplode(F.split(barcode, "")).alias("at", "base"))
    per = bases.groupBy(*keys, "at", "base").agg(F.count(F.lit(1)).alias("c"))
    by = per.groupBy(*keys, "at").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"))
    total = by.groupBy(*keys).agg(F.max("m").alias("m"), F.sum(F.col("m") * (F.col("m") - 1) / 2 - F.col("same")).alias("d"))
    return total.select(*keys, F.when(F.col("m") == 1, F.lit(-1.0)).otherwise(F.col("d") / F.nullif(F.col("m") * (F.col("m") - 1) / 2, F.lit(0.0))).alias("distance"))
