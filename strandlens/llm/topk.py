"""Exact top-k inner products by term-at-a-time accumulation.

Candidates are dealt into blocks, each an inverted index: for every term (dimension) the rows that
hold it and their weights. A block of sparse query rows scatters each term's weighted postings into
dense score arrays, the k best are selected by partition, and the blocks' selections are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, written

#: Rows of a block of candidates, the least and most of a block of queries, and blocks of candidates
#: that one task scores for a block of queries, as a mean.
CANDIDATES, QUERIES, SCORED = 4096, (512, 2048), 256
BLOCK = "ids binary, offsets binary, terms binary, weights binary, part int, place bigint"
LARGEST = 2**63 - 1


def quantised(embedding: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component, as doubles; null where the vector can't take part. Numbers
    beyond 64 bits become the nearest of 64 bits."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def _blocks(size: int):
    """Packs rows (id, vector) into blocks of their non-zero components, numbered inside each task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        part, place = TaskContext.get().partitionId(), 0

        def block() -> pa.RecordBatch:
            nonlocal place
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            sparse = [(np.flatnonzero(rows[i]).astype(np.int32), rows[i][rows[i] != 0]) for i in order]
            offsets = np.cumsum([0, *(len(t) for t, _ in sparse)]).astype(np.int64)
            columns = (np.array(ids, np.int64)[order], offsets, np.concatenate([t for t, _ in sparse]), np.concatenate([w for _, w in sparse]).astype(np.int64))
            place += 1
            return pa.RecordBatch.from_arrays([*(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([part], pa.int32()), pa.array([place - 1], pa.int64())], names=["ids", "offsets", "terms", "weights", "part", "place"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                rows.append(v.values.to_numpy(zero_copy_only=False) if len(v) else np.zeros(0, np.int64))
                if len(ids) == size:
                    yield block()
                    ids, rows = [], []
        if ids:
            yield block()

    return pack


class _Postings:
    """A block of candidates by term."""

    def __init__(self, ids: bytes, offsets: bytes, terms: bytes, weights: bytes) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        offsets = np.frombuffer(offsets, np.int64)
        terms, weights = np.frombuffer(terms, np.int32), np.frombuffer(weights, np.int64)
        row = np.repeat(np.arange(len(self.ids)), np.diff(offsets))
        order = np.argsort(terms, kind="stable")
        self.terms, first = np.unique(terms[order], return_index=True)
        ends = np.append(first[1:], len(terms))
        self.lists = {int(t): (row[order[a:b]], weights[order[a:b]]) for t, a, b in zip(self.terms, first, ends, strict=True)}
        squares = np.zeros(len(self.ids))
        np.add.at(squares, row, weights.astype(float) ** 2)
        self.norm = float(np.sqrt(squares.max(initial=0)))


def _accumulate(postings: _Postings, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores (candidate, query): each term's postings, times the queries' weights, added in place.

    Whole numbers throughout: of 32 bits where the longest vectors' product can't exceed them, else
    of 64, else of any size; what then is beyond 64 bits becomes the nearest of 64 bits.
    """
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    squares = np.zeros(n)
    np.add.at(squares, row, weights.astype(float) ** 2)
    bound = postings.norm * float(np.sqrt(squares.max(initial=0)))
    kind = np.int32 if bound < 2.0**31 else np.int64 if bound < 2.0**62 else object
    scores = np.zeros((len(postings.ids), n), kind)
    order = np.argsort(terms, kind="stable")
    names, first = np.unique(terms[order], return_index=True)
    for t, a, b in zip(names.tolist(), first, np.append(first[1:], len(terms)), strict=True):
        if t not in postings.lists:
            continue
        rows, w = postings.lists[t]
        mine = order[a:b]
        if len(mine) > n // 4:
            q = np.zeros(n, kind)
            q[row[mine]] = weights[mine]
            step = max(1, (1 << 17) // n)
            for i in range(0, len(rows), step):
                scores[rows[i : i + step]] += w[i : i + step, None].astype(kind) * q
        else:
            for k in mine:
                scores[rows, row[k]] += w.astype(kind) * kind(weights[k]) if kind is not object else w.astype(object) * int(weights[k])
    return scores if kind is not object else np.clip(scores, -LARGEST - 1, LARGEST).astype(np.int64)


def _select(scores: np.ndarray, ids: np.ndarray, query: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the k best of one query, its own id apart; ids ascend, so ties that the
    partition leaves open go to the first."""
    keep = ids != query
    s, own = scores[keep].astype(np.int64), ids[keep]
    if len(s) > k:
        cut = np.partition(s, len(s) - k)[len(s) - k]
        above = np.flatnonzero(s > cut)
        level = np.flatnonzero(s == cut)[: k - len(above)]
        take = np.concatenate((above, level))
        s, own = s[take], own[take]
    return own, s


def _score(k: int):
    """Rows (qb, candidate block, query block), sorted by qb: the best k per query of all the
    partition's candidates, so a query leaves a partition with k rows at most."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        last = None

        def out() -> pa.RecordBatch:
            query = np.concatenate([np.full(len(i), q) for q, (i, _) in best.items()] or [np.zeros(0, np.int64)])
            ids = np.concatenate([i for i, _ in best.values()] or [np.zeros(0, np.int64)])
            values = np.concatenate([s for _, s in best.values()] or [np.zeros(0, np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query, ids, values)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                qb, *cells = (c[i].as_py() for c in batch.columns)
                if qb != last and best:
                    yield out()
                    best = {}
                last = qb
                postings = _Postings(*cells[:4])
                queries = np.frombuffer(cells[4], np.int64)
                scores = _accumulate(postings, np.frombuffer(cells[5], np.int64), np.frombuffer(cells[6], np.int32), np.frombuffer(cells[7], np.int64))
                for j, column in enumerate(scores.T.copy()):
                    ids, values = _select(column, postings.ids, int(queries[j]), k)
                    key = int(queries[j])
                    if key in best:
                        ids, values = np.concatenate((best[key][0], ids)), np.concatenate((best[key][1], values))
                        order = np.lexsort((ids, -values))[:k]
                        ids, values = ids[order], values[order]
                    best[key] = ids, values
        if best:
            yield out()

    return score


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates by integer inner
    product of the scaled and floored vectors, ties to the smaller id.

    Candidates are all rows but those of the query's own id. Vectors that are null or hold a null
    or non-finite component take no part, nor do rows of null id; of vectors of different lengths
    the shorter counts as padded with zeros, an empty one scores 0 with all. Rows that repeat an id
    are candidates each on their own, and a repeated query id is asked once, with the vector that
    is first by value. Components and scores beyond 64 bits count as the nearest number of 64 bits. No
    queries or no candidates give an empty result. Other columns are ignored.

    Every block of candidates meets every block of queries once: blocks are rows, joined on the
    query block's number and a salt, with candidates spread over the salts, of which there are
    enough for all tasks and for some 256 blocks of candidates each. A task keeps k rows per query,
    so the merge gets few of them.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("_q")).where("id is not null and v is not null")
    asked = usable.where("_q").groupBy("id").agg(F.min("v").alias("v"))
    many, asking = usable.agg(F.count(F.lit(1)), F.count_if("_q")).first()
    tasks = shuffle_width(spark)
    packed = usable.select("id", "v").mapInArrow(_blocks(CANDIDATES), BLOCK).drop("part", "place")
    size = min(QUERIES[1], max(QUERIES[0], -(-asking // tasks)))
    queries = written(asked.mapInArrow(_blocks(size), BLOCK).select("part", "place", *[F.col(c).alias(f"q_{c}") for c in ("ids", "offsets", "terms", "weights")]), "queries")
    counts = sorted((r["part"], r["count"]) for r in queries.groupBy("part").count().collect())  # a row for each task
    *before, n = accumulate((k for _, k in counts), initial=0)
    shifts = spark.createDataFrame([(part, k) for (part, _), k in zip(counts, before, strict=True)], "part int, shift bigint")
    numbered = queries.join(F.broadcast(shifts), "part").withColumn("qb", F.col("shift") + F.col("place")).drop("part", "place", "shift")
    salts = max(1, min(tasks // max(1, n), many // CANDIDATES), -(-many // (CANDIDATES * SCORED)))
    ask = numbered.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    deal = packed.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1)) if n else F.array().cast("array<bigint>")))
    grid = deal.join(ask, ["qb", "salt"]).select("qb", "ids", "offsets", "terms", "weights", "q_ids", "q_offsets", "q_terms", "q_weights")
    best = grid.sortWithinPartitions("qb").mapInArrow(_score(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

