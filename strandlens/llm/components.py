"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Nodes of which a minimum each is broadcast.
BROADCAST_NODES = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node of its component among this partition's edges)."""
    parent: dict = {}
    schema = None

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if schema:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*pairs, strict=True) if pairs else ([], []), schema, strict=True)], schema=schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another one; root: the smallest node reachable.

    Each partition first replaces its edges by a spanning forest. Then every round links the larger
    neighbours of each node to its smallest one (large star) and its smaller ones likewise (small
    star) until nothing changes; the number of rounds grows with the logarithm of the nodes. A
    node's edges are never gathered: minima are aggregated map-side and joined back, by broadcast
    while there are at most 200,000 and else by a join whose large partitions Spark splits. Loops and
    repeated edges are ignored, rows with a null are dropped; no edges give an empty result.
    """
    kind = edges.schema[a].dataType.simpleString()
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b")
    now = written(pairs.mapInArrow(_forest, f"a {kind}, b {kind}").distinct(), "edges")
    seen, edges = None, now.count()
    while True:
        few = F.broadcast if 2 * edges <= BROADCAST_NODES else lambda df: df  # a minimum for each node, of two an edge
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = few(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = few(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = written(small, "edges")
        sums = tuple(after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        drop_written(now)
        now, edges = after, sums[0]
        if sums == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sums
