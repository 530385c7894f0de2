"""Mixing sources to target weights by Poisson replication.

Each source's weight and size give a mean repetition rate; each document draws its number of copies
by inverting a Poisson distribution of that mean at a uniform number hashed from its id; copies are
exploded and shuffled globally by a second hash. All of it is SQL expressions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shuffle_width


def hashed_uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts joined by '|': 52 bits, the same in any engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(2**52)


def poisson_cdf(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to where the rest is below double precision.

    Summed in logarithms, so large rates don't underflow. Length: rate + 12 * sqrt(rate) + 40. Built
    in blocks of 128 numbers, as an array grows by copying.
    """
    last, size = F.ceil(rate + 12 * F.sqrt(rate)).cast("int") + 40, 128
    start = F.struct((-rate).alias("logp"), F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        logp = acc["logp"] + F.ln(rate) - F.ln(k.cast("double"))
        p = acc["p"] + F.exp(logp)
        return F.struct(logp.alias("logp"), p.alias("p"), F.concat(acc["cdf"], F.array(p)).alias("cdf"))

    def block(acc: Column, first: Column) -> Column:
        empty = F.struct(acc["logp"].alias("logp"), acc["p"].alias("p"), F.array().cast("array<double>").alias("cdf"))
        more = F.aggregate(F.sequence(first, F.least(first + size - 1, last)), empty, step)
        return F.struct(more["logp"].alias("logp"), more["p"].alias("p"), F.concat(acc["cdf"], more["cdf"]).alias("cdf"))

    return F.when(rate <= 0, F.array(F.lit(1.0))).otherwise(F.aggregate(F.sequence(F.lit(1), last, F.lit(size)), start, block, lambda acc: acc["cdf"]))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float, epochs: float, source_col: str = "source") -> DataFrame:
    """source, n_docs, weight, rate, cdf. Counts cover all documents.

    weights: target shares by source; sources without one get 0. None: shares proportional to
    n_docs ** temperature. rate = epochs * N * share / n_docs, so that the expected number of
    copies is epochs * N and a source's expected share of them its target share. A null source is
    a source of its own, named by null.
    """
    counts = docs.groupBy(source_col).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature)))
    elif weights:
        given = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))])
        weight = F.coalesce(F.when(F.col(source_col).isNotNull(), F.element_at(given, F.coalesce(F.col(source_col), F.lit("")))), F.lit(0.0))
    else:
        weight = F.lit(0.0)
    counts = counts.withColumn("weight", weight)
    total = counts.agg(F.sum("n_docs").alias("n"), F.sum("weight").alias("w")).first()
    n, w = float(total["n"] or 0), float(total["w"] or 0)
    rate = F.lit(float(epochs) * n) * (F.col("weight") / F.lit(w or 1.0)) / F.col("n_docs")
    return counts.withColumn("rate", F.round(rate, 9)).withColumn("cdf", poisson_cdf(F.col("rate")))


def poisson_mix(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = "text") -> DataFrame:
    """All columns of docs plus ``copy`` (from 0), ``rate`` and ``shuffle_key``, one row per copy, in
    random order: partition i holds the i-th range of keys, sorted by key.

    A document is hashed by its id and text, so equal rows draw equal numbers, and null ids still
    draw apart by text; a null text hashes as empty (text_col None: hashed by id alone). Documents of
    count 0 leave, documents of
    count k stay k times. An empty table gives an empty result. Input columns named copy, rate or
    shuffle_key are replaced. The rate table has one row per source: it is broadcast if it has
    20,000 rows or fewer, else joined by shuffle with hot sources split over 64 salts.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("copy", "rate", "shuffle_key")]
    rates = source_rates(docs, weights, temperature, epochs, source_col).select(F.col(source_col).alias("__source"), F.col("rate").alias("__rate"), F.col("cdf").alias("__cdf"))
    who = [F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5((F.coalesce(F.col(text_col), F.lit("")) if text_col else F.lit("")).cast("binary"))]
    # drawn below the join, which keeps the optimizer from repeating the text's hash in what follows
    base = docs.select(*kept, F.concat_ws("|", *who).alias("__who")).withColumn("__u", hashed_uniform(F.col("__who")))
    on = F.col(source_col).eqNullSafe(F.col("__source"))
    if rates.count() <= BROADCAST_ROWS:
        joined = base.join(F.broadcast(rates), on)
    else:
        salts = 64
        spread = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = base.withColumn("__own", F.pmod(F.xxhash64("__who"), F.lit(salts)).cast("int")).join(spread, on & (F.col("__own") == F.col("__salt")))
    count = F.size(F.filter("__cdf", lambda p: p < F.col("__u")))
    copies = (
        joined.withColumn("__count", F.least(count, F.size("__cdf") - 1))
        .where("__count > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__count") - 1)))
        .withColumn("shuffle_key", hashed_uniform(F.lit("order"), F.col("__who"), F.col("copy").cast("string")))
        .withColumn("rate", F.col("__rate"))
        .select(*kept, "copy", "rate", "shuffle_key")
    )
    parts = shuffle_width(spark)
    return copies.repartitionById(parts, F.floor(F.col("shuffle_key") * parts).cast("int")).sortWithinPartitions("shuffle_key")
