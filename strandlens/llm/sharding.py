"""Sharding by a Feistel permutation of global row numbers.

Law ``rows``: every row gets a global number 0..N-1, a keyed permutation of 0..N-1 shuffles the
numbers, and the permuted number p gives shard ``p % shards`` and slot ``p // shards``. Shard sizes
differ by one at most, slots are gapless, and anyone who knows N, the seed and a row number can
compute where the row is without reading data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, shuffle_width, written

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def round_keys(seed: int, rounds: int = 6) -> np.ndarray:
    return _mix(np.uint64(seed % 2**64) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def permute(numbers: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Keyed permutation of 0..n-1.

    A Feistel network over pairs (left, right) of 0..a-1, a = ceil(sqrt(n)), permutes 0..a*a-1;
    values of n or more are sent through it again (cycle walking) until they fall below n. As
    a*a - n <= 2*sqrt(n), few values walk. Takes and returns uint64; empty input is returned as is.
    """
    out = np.asarray(numbers, dtype=np.uint64).copy()
    if n <= 1 or not len(out):
        return out
    a = int(np.sqrt(float(n)))
    while a * a < n:
        a += 1
    side = np.uint64(a)
    keys = round_keys(seed, rounds)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // side, out[todo] % side
        for key in keys:
            left, right = right, (left + _mix(right + key) % side) % side
        out[todo] = left * side + right
        todo = todo[out[todo] >= np.uint64(n)]
    return out


#: Rows that a task numbers and that one row is expanded to at most, as means.
PER_TASK, RUN = 500_000, 100_000


def _running(count: str):
    """Adds ``_part``, the partition, and ``_before``, the sum of count over its earlier rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(count).to_numpy()
            ends = before + np.cumsum(n)
            if len(n):
                before = int(ends[-1])
            columns = [*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_before"])

    return run


def row_numbers(groups: DataFrame, order: list[str], count: str, tasks: int) -> DataFrame:
    """groups plus ``first_row``: the global number of each group's first row in the given order, nulls
    first.

    No window spans the table: a range sort over all order columns deals the groups to tasks, each
    task sums up its own, and a row per task says what comes before it. The ranges only balance the
    work; any ranges give the same numbers.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = groups.repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema.fields)
    ranged = written(ranged.mapInArrow(_running(count), f"{schema}, _part int, _before bigint"), "ranges")
    sizes = ranged.groupBy("_part").agg(F.sum(count).alias("_n"))  # a row for each task
    shifts = sizes.select("_part", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).alias("_shift"))
    return ranged.join(F.broadcast(shifts), "_part").withColumn("first_row", F.col("_shift") + F.col("_before")).drop("_part", "_before", "_shift")


def expanded(groups: DataFrame, first: str, count: str, name: str) -> DataFrame:
    """A row for each number from first on, count of them, as ``name``. A group of many rows is cut into
    runs, which are dealt to all tasks before they are expanded."""
    runs = groups
    if groups.where(F.col(count) > RUN).limit(1).count():
        cut = groups.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {RUN}"))))
        cut = cut.withColumns({first: F.col(first) + F.col("_run") * RUN, count: F.least(F.lit(RUN).cast("long"), F.col(count) - F.col("_run") * RUN)}).drop("_run")
        runs = cut.repartition(shuffle_width(groups.sparkSession), F.col(first))
    return runs.withColumn(name, F.explode(F.sequence(F.col(first), F.col(first) + F.col(count) - 1))).drop(first, count)


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20, tasks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, row_number, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (null text: 1), text_crc32 that of the bytes (null: of
    none). Global order is (doc_id, size, text_crc32), nulls first, so it doesn't depend on files
    or partitions. Rows equal in those three are counted before the shuffle and expanded after it
    in runs of bounded length, and the sort is dealt by all three, so neither copies nor repeated or
    null ids meet in one task; which of several equal rows gets which of their places can't be told
    apart. Other columns are ignored, an empty table gives an empty result. Only these narrow rows
    are shuffled, never texts, and their number of tasks follows their number.
    """
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    groups = written(narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_copies")), "groups")
    total, kinds = groups.agg(F.sum("_copies"), F.count(F.lit(1))).first()
    tasks = tasks or max(shuffle_width(docs.sparkSession), -(-kinds // PER_TASK))
    placed = row_numbers(groups, ["doc_id", "size", "text_crc32"], "_copies", tasks)
    drop_written(groups)
    spread = _permuted(total or 0, seed)(F.col("row_number"))
    return expanded(placed, "first_row", "_copies", "row_number").withColumn("_p", spread).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "row_number",
        (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _permuted(n: int, seed: int):
    @F.pandas_udf(T.LongType())
    def permuted(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed).astype(np.int64))

    return permuted


def place(row_number: Column, total: int, shards: int = 16, seed: int = 20) -> Column:
    """Where the row with this number is: struct(shard, slot). Needs no table, only its row count."""
    p = _permuted(total, seed)(row_number)
    return F.struct((p % shards).cast("int").alias("shard"), F.floor(p / shards).alias("slot"))
