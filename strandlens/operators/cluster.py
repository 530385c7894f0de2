"""Groups of similar barcodes inside bundles: five methods, two physical paths.

A bundle is what the key columns say (position, strand, cell, gene, ...); its barcodes come with
counts. Methods: ``unique`` (every barcode its own group), ``percentile`` (barcodes with more than a
hundredth of the median count, each its own), ``cluster`` (connected components of the graph of
barcodes within the distance threshold), ``directional`` (components of the graph whose edges need
a count of at least twice the other's less one, taken from the most frequent barcode down) and
``adjacency`` (components resolved by the shortest list of most frequent barcodes that covers them).

The grouped path deals bundles to tasks by one shuffle and groups each in memory. Bundles with very
many barcodes go to the relational path instead: edges by a join on slices, labels by iterated joins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import near_pairs
from ..session import checkpointed

METHODS = ("unique", "percentile", "cluster", "adjacency", "directional")
#: Barcodes in a bundle from which it takes the relational path.
HOT_BUNDLE = 100_000


# --- one bundle in memory ---------------------------------------------------------------------


def _neighbours(umis: Sequence[str], threshold: int) -> list[list[int]]:
    """For each barcode the places of the others within the threshold."""
    if len({len(u) for u in umis}) > 1:
        raise ValueError("barcodes of a bundle must have the same length")
    near: list[list[int]] = [[] for _ in umis]
    length = len(umis[0]) if umis else 0

    def differ(a: str, b: str) -> int:
        return sum(x != y for x, y in zip(a, b, strict=True))

    if len(umis) <= 12 or threshold >= length:
        for i, j in combinations(range(len(umis)), 2):
            if differ(umis[i], umis[j]) <= threshold:
                near[i].append(j)
                near[j].append(i)
        return near
    if threshold == 1:
        seen: dict[tuple[int, str], list[int]] = defaultdict(list)
        for i, u in enumerate(umis):
            for k in range(length):
                others = seen[k, u[:k] + u[k + 1 :]]
                for j in others:
                    near[i].append(j)
                    near[j].append(i)
                others.append(i)
        return near
    cuts = [length * k // (threshold + 1) for k in range(threshold + 2)]
    parts: dict[tuple[int, str], list[int]] = defaultdict(list)
    for i, u in enumerate(umis):
        close = set()
        for k in range(threshold + 1):
            bucket = parts[k, u[cuts[k] : cuts[k + 1]]]
            close.update(bucket)
            bucket.append(i)
        for j in close:
            if differ(u, umis[j]) <= threshold:
                near[i].append(j)
                near[j].append(i)
    return near


def _flood(near: list[list[int]], allowed) -> list[int]:
    """Label each place by the first place, in order, from which it can be reached."""
    label = [-1] * len(near)
    for seed in range(len(near)):
        if label[seed] < 0:
            label[seed] = seed
            todo = [seed]
            while todo:
                i = todo.pop()
                for j in near[i]:
                    if label[j] < 0 and allowed(i, j):
                        label[j] = seed
                        todo.append(j)
    return label


def _covered(near: list[list[int]]) -> list[int]:
    """Adjacency groups. Places are in order of frequency, so a component's leads are its first
    ones: as many as it takes until every member is a lead's neighbour or a lead."""
    component = _flood(near, lambda i, j: True)
    need = [min([i, *near[i]]) for i in range(len(near))]
    last: dict[int, int] = {}
    for i, c in enumerate(component):
        last[c] = max(last.get(c, 0), need[i])
    return [i if i <= last[component[i]] else need[i] for i in range(len(near))]


def group_bundle(umis: Sequence[str], counts: Sequence[int], method: str = "directional", threshold: int = 1) -> list[int]:
    """For each barcode the place of its group's representative, -1 if the method drops it. The
    barcodes must come most frequent first, ties in the order that decides them."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    if method == "percentile":
        if len(umis) == 1:
            return [0]
        middle = sorted(counts)
        half = len(middle) // 2
        median = middle[half] if len(middle) % 2 else (middle[half - 1] + middle[half]) / 2
        return [i if n > median / 100 else -1 for i, n in enumerate(counts)]
    if method == "unique" or len(umis) == 1:
        return list(range(len(umis)))
    near = _neighbours(umis, threshold)
    if method == "adjacency":
        return _covered(near)
    if method == "cluster":
        return _flood(near, lambda i, j: True)
    label = _flood(near, lambda i, j: counts[i] >= 2 * counts[j] - 1)
    return label


class UMIClusterer:
    """Groups of one bundle: call it with {barcode: count} and a threshold for a list of groups,
    each a list of barcodes with its representative first. Barcodes are bytes or strings."""

    def __init__(self, cluster_method: str = "directional") -> None:
        if cluster_method not in METHODS:
            raise ValueError(f"method must be one of {', '.join(METHODS)}")
        self.cluster_method = cluster_method

    def __call__(self, umis: dict, threshold: int = 1) -> list[list]:
        text = {(u.decode() if isinstance(u, bytes) else u): u for u in umis}
        ordered = sorted(text, key=lambda u: (-umis[text[u]], u))
        label = group_bundle(ordered, [umis[text[u]] for u in ordered], self.cluster_method, threshold)
        groups: dict[int, list] = {}
        for u, rep in zip(ordered, label, strict=True):
            if rep >= 0:
                groups.setdefault(rep, []).append(text[u])
        return [groups[rep] for rep in sorted(groups)]


# --- many bundles -----------------------------------------------------------------------------


def _grouped(n_keys: int, method: str, threshold: int):
    """Streams rows (keys, umi, n), sorted by keys and n descending, bundle by bundle, adding the
    representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, done, schema = None, [], [], None

        def close() -> None:
            label = group_bundle([r[n_keys] for r in rows], [r[n_keys + 1] for r in rows], method, threshold)
            done.extend((*r, rows[rep][n_keys]) for r, rep in zip(rows, label, strict=True) if rep >= 0)
            rows.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[] for _ in range(n_keys + 3)]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*schema.types, pa.string()], strict=True)], names=[*schema.names, "rep"])
            done.clear()
            return batch

        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n_keys] != key:
                    if rows:
                        close()
                    key = row[:n_keys]
                    if len(done) >= 8192:
                        yield out()
                rows.append(row)
        if rows:
            close()
        if done:
            yield out()

    return run


def _joined(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """left and the further columns of right where the given columns agree, null with null."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in columns})
    return left.join(other, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in columns], how).drop(*[f"_r_{c}" for c in columns])


def _labelled(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, umi, n, rep: the least (-n, umi) among a barcode and all from which edges (src, dst)
    lead to it. Labels spread by joins until none changes; each round is kept in the shared folder."""
    order = F.struct((-F.col("n")).alias("m"), F.col("umi").alias("u"))
    now = checkpointed(nodes.select(*keys, "umi", "n", order.alias("label")))
    edges = checkpointed(edges)
    while True:
        sent = _joined(edges, now.select(*keys, F.col("umi").alias("src"), "label"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("umi")).agg(F.min("label").alias("got"))
        after = _joined(now, sent, [*keys, "umi"], "left").select(*keys, "umi", "n", F.least("label", "got").alias("label"), (F.col("got") < F.col("label")).alias("moved"))
        after = checkpointed(after)
        if not after.where("moved").limit(1).count():
            return after.select(*keys, "umi", "n", F.col("label.u").alias("rep"))
        now = after.drop("moved")


def _relational(counts: DataFrame, keys: list[str], method: str, threshold: int) -> DataFrame:
    if method == "unique":
        return counts.withColumn("rep", F.col("umi"))
    if method == "percentile":
        per = counts.groupBy(*keys).agg(F.median("n").alias("_median"), F.count(F.lit(1)).alias("_size"))
        return _joined(counts, per, keys).where("n > _median / 100 or _size = 1").drop("_median", "_size").withColumn("rep", F.col("umi"))
    pairs = near_pairs(counts, keys, "umi", threshold, extra=("n",), names=("src", "dst"))
    back = pairs.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("n_dst").alias("n_src"), F.col("n_src").alias("n_dst"), "distance")
    both = pairs.unionByName(back)
    if method == "directional":
        return _labelled(counts, both.where("n_src >= 2 * n_dst - 1").select(*keys, "src", "dst"), keys)
    both = checkpointed(both)
    found = _labelled(counts, both.select(*keys, "src", "dst"), keys)
    if method == "cluster":
        return found
    place = Window.partitionBy(*keys, "rep").orderBy(F.col("n").desc(), "umi")
    ranked = checkpointed(found.withColumn("rk", F.row_number().over(place)))
    first = _joined(both, ranked.select(*keys, F.col("umi").alias("src"), "rk"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("umi")).agg(F.min("rk").alias("near"))
    need = _joined(ranked, first, [*keys, "umi"], "left").withColumn("need", F.least("rk", "near"))
    last = need.groupBy(*keys, "rep").agg(F.max("need").alias("last"))
    lead = _joined(need, last, [*keys, "rep"]).withColumn("lead", F.when(F.col("rk") <= F.col("last"), F.col("rk")).otherwise(F.col("need")))
    leads = ranked.select(*keys, "rep", F.col("rk").alias("lead"), F.col("umi").alias("_lead"))
    return _joined(lead, leads, [*keys, "rep", "lead"]).select(*keys, "umi", "n", F.col("_lead").alias("rep"))


def cluster(counts: DataFrame, keys: list[str], method: str = "directional", threshold: int = 1, path: str = "auto", hot_bundle: int = HOT_BUNDLE, stored: bool = False) -> DataFrame:
    """keys, umi, n, rep of counts (keys, umi, n): each barcode with its group's representative,
    the most frequent one, ties to the first by letters. Barcodes a method drops are left out. Null
    keys are a bundle like any other. The methods that compare barcodes need those of a bundle to
    have one length: others are an error, whatever the bundle's size.

    path: ``grouped``, ``relational``, or ``auto``, which keeps the counts in the shared folder,
    counts barcodes per bundle and takes the relational path for bundles of more than hot_bundle.
    stored: the counts are a kept table already.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    counts = counts.select(*keys, "umi", F.col("n").cast("long").alias("n"))
    if method == "unique":
        return _relational(counts, keys, method, threshold)
    if path != "grouped" and not stored:
        counts = checkpointed(counts)  # looked at more than once; the reads behind it are scanned once
    if path == "relational":
        return _relational(_one_length(counts, keys, method), keys, method, threshold)
    hot = None
    if path == "auto":
        sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > hot_bundle).select(*keys)
        if sizes.limit(1).count():
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            marked = counts.join(sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_hot")), same, "left")
            hot = marked.where("_hot").select(*keys, "umi", "n")
            counts = marked.where("_hot is null").select(*keys, "umi", "n")
    types = {f.name: f.dataType.simpleString() for f in counts.schema}
    dealt = counts.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, F.col("n").desc(), "umi")
    out = dealt.mapInArrow(_grouped(len(keys), method, threshold), ", ".join(f"`{c}` {types[c]}" for c in counts.columns) + ", rep string")
    return out.unionByName(_relational(_one_length(hot, keys, method), keys, method, threshold)) if hot is not None else out


def _one_length(counts: DataFrame, keys: list[str], method: str) -> DataFrame:
    """counts, after an error if barcodes of a bundle differ in length, as in one bundle in memory."""
    if method in ("cluster", "directional", "adjacency"):
        sizes = counts.groupBy(*keys).agg(F.min(F.length("umi")).alias("short"), F.max(F.length("umi")).alias("long"))
        if sizes.where("short <> long").limit(1).count():
            raise ValueError("barcodes of a bundle must have the same length")
    return counts


def with_group_sizes(groups: DataFrame, keys: list[str]) -> DataFrame:
    """groups plus group_n, the reads of each group."""
    return groups.withColumn("group_n", F.sum("n").over(Window.partitionBy(*keys, "rep")))
