"""Removal of repeated passages with a run-length compressed Burrows-Wheeler index.

Every string of ``length`` bytes contains one anchor, the smallest-hashed q-gram in it, at the same
place wherever the string occurs. Strings whose anchors occur once in the corpus can't repeat; the
others are gathered by anchor as pieces, and each task indexes its pieces: a suffix array gives the
Burrows-Wheeler transform, of which the runs are kept with suffix positions and match lengths
sampled at their ends, and matching statistics stream from the samples to every text position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written
from .minhash import mix

#: Bytes of the q-gram; bytes hashed at once; bytes of pieces indexed at once, and of a bucket that
#: isn't divided further; occurrences of an anchor from which its pieces are divided before they are
#: counted; rows of a broadcast key set; pieces that a task remembers having sent.
Q, BLOCK, INDEX, HOT, KEYS, SENT = 64, 1 << 18, 2_000_000, 10_000, 200_000, 50_000
SEPARATOR = 0xFF  # no byte of UTF-8

_U = np.uint64
_BYTE = mix(_U(77) + np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15
_UP = np.cumprod(np.concatenate((np.ones(1, _U), np.full(2 * BLOCK, _BASE, _U))))
_DOWN = np.cumprod(np.concatenate((np.ones(1, _U), np.full(2 * BLOCK, pow(_BASE, -1, 2**64), _U))))
_LOW = _U((1 << 20) - 1)


def _gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * _UP[: len(data)], out=total[1:])
    return mix((total[q:] - total[:-q]) * _DOWN[: len(data) - q + 1])


def _sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, from minima of blocks' heads and tails."""
    n = len(values) - w + 1
    pad = np.full(-len(values) % w, np.iinfo(_U).max, _U)
    blocks = np.concatenate((values, pad)).reshape(-1, w)
    heads = np.minimum.accumulate(blocks, axis=1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tails[:n], heads[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, length: int, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, number of starts, anchor's place) of each run of consecutive windows of
    ``length`` bytes with one anchor. data has at least ``length`` bytes and at most 2**19."""
    hashes = _gram_hashes(data, q)
    marked = (hashes & ~_LOW) | np.arange(len(hashes), dtype=_U)
    place = (_sliding_least(marked, length - q + 1) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return hashes[place[first]].view(np.int64), first, np.diff(np.append(first, len(place))), place[first]


def _anchor_rows(length: int):
    """(k1, k2, anchor, place) of (k1, k2, text); place packs first start, starts and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list, keys1: list, keys2: list) -> pa.RecordBatch:
            counts = [len(r[0]) for r in rows]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(keys1, np.int64), counts)), pa.array(np.repeat(np.array(keys2, np.int64), counts)), pa.array(np.concatenate([r[0] for r in rows])), pa.array(np.concatenate([r[1] for r in rows]))],
                names=["k1", "k2", "anchor", "place"],
            )

        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows, keys1, keys2, size = [], [], [], 0
            for i, x in enumerate(batch.column(2)):
                data = np.frombuffer(x.as_buffer(), np.uint8)
                for at in range(0, max(1, len(data) - length + 1), BLOCK):
                    part = data[at : at + BLOCK + length - 1]
                    if len(part) < length:
                        continue
                    h, first, n, place = anchors(part, length)
                    rows.append((h, (first + at) << 16 | n << 8 | (place - first)))
                    keys1.append(k1[i])
                    keys2.append(k2[i])
                    size += len(h)
                if size > 50_000:
                    yield out(rows, keys1, keys2)
                    rows, keys1, keys2, size = [], [], [], 0
            if rows:
                yield out(rows, keys1, keys2)

    return run


PIECES = "bucket bigint, k1 bigint, k2 bigint, start bigint, starts int, copies bigint, piece binary, offset int, low int, high int"


def _halves(piece: bytes, offset: int, starts: int, low: int, high: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(bucket, first, starts, low, high) of the two halves of a piece whose windows have their anchor
    at offset, offset - 1 and so on, all from low to high. The halves part at an offset that depends
    on low and high alone, and the bucket is a hash of the bytes that all windows of a half share
    beside the anchor, so equal windows stay together; a half of one offset has the whole window."""
    mid = (low + high + 1) // 2
    left = max(0, min(starts, offset - mid + 1))
    for first, count, lo, hi in ((0, left, mid, high), (left, starts - left, low, mid - 1)):
        if count:
            key = hashlib.blake2b(piece[offset - lo : offset - hi + length], digest_size=8, salt=bytes((lo, hi))).digest()
            yield int.from_bytes(key, "big", signed=True), first, count, lo, hi


class _Sent:
    """A piece that this task has already sent twice, or once for a text with copies, is known to be
    repeated: its further places go without bytes and to any task, so a bucket gets two rows per
    different piece and task, however common the piece is."""

    def __init__(self) -> None:
        self.times: dict[tuple[int, bytes], int] = {}

    def row(self, bucket: int, k1: int, k2: int, start: int, starts: int, copies: int, piece: bytes, *near: int) -> tuple:
        times = self.times.get((bucket, piece), 0)
        if times > 1:
            return k1 ^ start, k1, k2, start, starts, copies, None, *near
        if len(self.times) >= SENT:
            self.times.clear()
        self.times[bucket, piece] = times + min(2, copies)
        return bucket, k1, k2, start, starts, copies, piece, *near


def _pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "k1", "k2", "start", "starts", "copies", "piece", "offset", "low", "high"])


def _piece_rows(length: int):
    """Pieces of (k1, k2, copies, text, places): the bytes of each run of windows, by anchor; for a
    hot anchor in halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent()
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for k1, k2, copies, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                data = text.as_buffer().to_pybytes()
                for spot in places.as_py():
                    at, n, offset = spot["place"] >> 16, spot["place"] >> 8 & 255, spot["place"] & 255
                    parts = [(spot["anchor"], 0, n, 0, length - Q)]
                    if spot["hot"]:
                        parts = list(_halves(data[at : at + n - 1 + length], offset, n, 0, length - Q, length))
                    for bucket, first, count, low, high in parts:
                        piece = data[at + first : at + first + count - 1 + length]
                        rows.append(sent.row(bucket, k1, k2, at + first, count, copies, piece, offset - first, low, high))
                        size += (count + length) * (rows[-1][6] is not None)
                if size > 4 << 20:
                    yield _pieces_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _pieces_batch(rows)

    return run


def _half_rows(length: int):
    """The halves of pieces; what has no bytes, or one offset alone, stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent()
        for batch in batches:
            rows: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, k1, k2, start, starts, copies, piece, offset, low, high = row
                if piece is None or low == high:
                    rows.append(row)
                    continue
                for bucket, first, count, lo, hi in _halves(piece, offset, starts, low, high, length):
                    rows.append(sent.row(bucket, k1, k2, start + first, count, copies, piece[first : first + count - 1 + length], offset - first, lo, hi))
            if rows:
                yield _pieces_batch(rows)

    return run


def _divided(pieces: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pieces (written) of which no bucket of several different ones has over INDEX bytes, and the
    tables that hold them. Larger buckets are halved until none is left, down to single windows,
    where a bucket has one piece."""
    done, tables = [], [pieces]
    while True:
        found = pieces.where("piece is not null").groupBy("bucket")
        sizes = found.agg(F.sum(F.octet_length("piece") + 1).alias("bytes"), F.min(F.xxhash64("piece")).alias("least"), F.max(F.xxhash64("piece")).alias("most"), F.max(F.col("high") - F.col("low")).alias("wide"))
        large = written(sizes.where((F.col("bytes") > INDEX) & (F.col("least") < F.col("most")) & (F.col("wide") > 0)).select("bucket"), "large")
        tables.append(large)
        n = large.count()
        if not n:
            break
        keys = F.broadcast(large) if n <= KEYS else large
        done.append(pieces.join(keys, "bucket", "left_anti"))
        pieces = written(pieces.join(keys, "bucket").select(*pieces.columns).mapInArrow(_half_rows(length), PIECES), "halves")
        tables.append(pieces)
    for rest in done:
        pieces = pieces.unionByName(rest)
    return pieces, tables


# --- the index --------------------------------------------------------------------------------


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix multiplying from seven bytes on: as many ranks as 63 bits hold,
    three for up to two million bytes, make a sort key. Only suffixes that still tie are sorted
    again. A byte counts as 1..256 and what lies past the end as 0."""
    n = len(data)
    padded = np.concatenate((data.astype(_U) + _U(1), np.zeros(7, _U)))
    key = np.zeros(n, _U)
    for k in range(7):
        key = key * _U(257) + padded[k : k + n]
    order = np.argsort(key)
    fresh = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = head + 1  # 0 is the end of the data
    h, width = 7, n.bit_length()
    ranks = min(4, 63 // width)
    tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(tied):
        s = order[tied]
        key = rank[s]
        for k in range(1, ranks):
            key = key << width | rank[np.minimum(s + k * h, n)]
        again = np.argsort(key)
        s, key = s[again], key[again]
        order[tied] = s
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        rank[s] = tied[first] + 1
        tied = tied[~(new & np.append(new[1:], True))]
        h *= ranks
    return order


def match_lengths(data: np.ndarray, a: np.ndarray, b: np.ndarray, least: int = 0) -> np.ndarray:
    """Common bytes of the suffixes at a[i] and b[i], by hashes of doubled and halved lengths; 0
    where they are fewer than ``least``."""
    n = len(data)
    up = _UP if n < len(_UP) else np.cumprod(np.concatenate((np.ones(1, _U), np.full(n, _BASE, _U))))
    down = _DOWN if n < len(_DOWN) else np.cumprod(np.concatenate((np.ones(1, _U), np.full(n, pow(_BASE, -1, 2**64), _U))))
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    found = np.zeros(len(a), np.int64)
    room = n - np.maximum(a, b)
    every, step = np.arange(len(a)), 64

    def equal(i: np.ndarray, size: int) -> np.ndarray:
        x, y = a[i] + found[i], b[i] + found[i]
        ok = found[i] + size <= room[i]
        x, y = np.where(ok, x, 0), np.where(ok, y, 0)
        e = np.where(ok, size, 0)
        return ok & ((total[x + e] - total[x]) * down[x] == (total[y + e] - total[y]) * down[y])

    if least:
        every = every[equal(every, least)]
        found[every] = least
    todo = every
    while len(todo):
        same = equal(todo, step)
        found[todo[same]] += step
        todo = todo[same]
        step *= 2
    while step:
        same = equal(every, step)
        found[every[same]] += step
        step //= 2
    return found


class RunIndex:
    """A run-length compressed Burrows-Wheeler transform with samples at the ends of its runs.

    heads and lengths are the runs; starts and ends the text positions of each run's first and last
    suffix; before and after how many bytes they share with the suffix sorted before and after, 0
    if fewer than ``least``.
    """

    def __init__(self, data: np.ndarray, least: int = 0) -> None:
        self.n = len(data)
        order = suffix_array(data)
        last = np.where(order > 0, data[order - 1].astype(np.int16), np.int16(256))
        edge = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        close = np.append(edge[1:], self.n) - 1
        self.heads, self.lengths = last[edge], np.diff(np.append(edge, self.n))
        self.starts, self.ends = order[edge], order[close]
        self.before, self.after = np.zeros(len(edge), np.int64), np.zeros(len(edge), np.int64)
        if len(edge) > 1:
            # one run's last suffix and the next one's first are neighbours
            shared = match_lengths(data, self.ends[:-1], self.starts[1:], least)
            self.after[:-1], self.before[1:] = shared, shared

    def matching_statistics(self) -> np.ndarray:
        """For every text position the length of the longest match that starts elsewhere, exact
        where it is ``least`` or more.

        Inside a run the match with a neighbouring suffix is that of the position before, less one
        byte, so it streams along the text from the samples; the longer neighbour counts.
        """
        best = np.zeros(self.n, np.int64)
        for places, shared in ((self.starts, self.before), (self.ends, self.after)):
            reach = np.zeros(self.n, np.int64)
            reach[places] = shared + places
            best = np.maximum(best, np.maximum.accumulate(reach) - np.arange(self.n))
        return best


SPANS = "k1 bigint, k2 bigint, begin bigint, end bigint"


def _span_rows(length: int):
    """Repeated spans (k1, k2, begin, end) of pieces that come by bucket.

    A piece that occurs again is repeated as a whole: only its first occurrence is kept, the others
    leave at once. Buckets of several pieces of which one or more came once are indexed, many small
    buckets together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (k1, k2, start, starts, piece, repeated)
        group: dict[bytes, list] = {}
        size, bucket = 0, None
        out: list[tuple] = []

        def close_group() -> None:
            nonlocal size
            settled = len(group) == 1 or all(g[4] > 1 for g in group.values())
            for piece, (k1, k2, start, starts, copies, _) in group.items():
                if copies > 1:
                    out.append((k1, k2, start, start + starts - 1 + length))
                if not settled:
                    held.append((k1, k2, start, starts, piece, copies > 1))
                    size += len(piece) + 1
            group.clear()

        def index() -> None:
            nonlocal size
            data = np.frombuffer(b"".join(h[4] + b"\xff" for h in held), np.uint8)
            long = RunIndex(data, length).matching_statistics() >= length
            at = 0
            for k1, k2, start, starts, piece, repeated in held:
                if not repeated:
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], long[at : at + starts].view(np.int8), [0]))))
                    out.extend((k1, k2, start + int(a), start + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2], strict=True))
                at += len(piece) + 1
            held.clear()
            size = 0

        def flush() -> pa.RecordBatch:
            rows = [np.array(c, np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["k1", "k2", "begin", "end"])

        for batch in batches:
            head = [batch.column(i).to_pylist() for i in range(6)]
            for i, (key, k1, k2, start, starts, copies) in enumerate(zip(*head, strict=True)):
                piece = batch.column(6)[i].as_py()
                if piece is None:  # repeated for certain
                    out.append((k1, k2, start, start + starts - 1 + length))
                    continue
                if key != bucket:
                    if size + sum(map(len, group)) + len(group) >= INDEX and held:
                        index()
                    close_group()
                    bucket = key
                if piece not in group:
                    group[piece] = [k1, k2, start, starts, copies, {(k1, k2, start)}]
                else:
                    first = group[piece]
                    if (k1, k2, start) == (first[0], first[1], first[2]):
                        continue  # the same text joined twice
                    first[4] += copies
                    out.append((k1, k2, start, start + starts - 1 + length))
            if len(out) > 50_000:
                yield flush()
        close_group()
        if held:
            index()
        yield flush()

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, spans) with the spans merged."""
    for batch in batches:
        spans = [merged([(s["begin"], s["end"]) for s in x.as_py()]) for x in batch.column(2)]
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[{"begin": a, "end": b} for a, b in x] for x in spans], kind)], names=["k1", "k2", "spans"])


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that name a text."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text, F.length(text)).alias("k2")


def repeated_spans(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """(k1, k2, spans): for each distinct text with repeated passages the maximal byte spans that
    strings of ``length`` bytes cover which also start anywhere else, the same text included.

    Texts shorter than ``length`` repeat nothing; copies count as places elsewhere. Shuffled are
    anchors (one per some 70 bytes), the texts that hold an anchor found twice, and their pieces.
    """
    if not 2 * Q + 2 <= length <= Q + 255 - 1:
        raise ValueError("length must be from 130 to 318 bytes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("text")).where(F.octet_length("text") >= length).select(*text_keys(F.col("text")), F.encode("text", "UTF-8").alias("text"))
    found = written(rows.mapInArrow(_anchor_rows(length), "k1 bigint, k2 bigint, anchor bigint, place bigint"), "anchors")
    # written, so that the join deals both sides itself and Spark can divide a hot anchor's rows
    twice = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", (F.col("n") > HOT).alias("hot")), "twice")
    spots = found.join(twice, "anchor").groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "place", "hot")).alias("places"), F.count(F.lit(1)).alias("n"))
    spots = written(spots.withColumn("copies", F.expr("n div size(places)")).drop("n"), "places")
    keys = spots.select("k1", "k2")
    wanted = rows.join(F.broadcast(keys), ["k1", "k2"], "left_semi") if spots.count() <= KEYS else rows
    texts = wanted.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    pieces = texts.join(spots, ["k1", "k2"]).select("k1", "k2", "copies", "text", "places").mapInArrow(_piece_rows(length), PIECES)
    pieces, tables = _divided(written(pieces, "pieces"), length)
    dealt = pieces.select("bucket", "k1", "k2", "start", "starts", "copies", "piece").repartition("bucket").sortWithinPartitions("bucket")
    spans = dealt.mapInArrow(_span_rows(length), SPANS)
    by_text = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    out = written(by_text.mapInArrow(_merge_rows, "k1 bigint, k2 bigint, spans array<struct<begin:bigint,end:bigint>>"), "spans")
    drop_written(found, twice, spots, *tables)
    return out


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and with ``texts`` also
    kept_text (spans may cut a character: such bytes are decoded as replacement characters).

    Bytes are those of the whole text as UTF-8; matches never cross documents and are judged on the
    input. Null and empty texts have nothing to remove; repeated rows and copies remove each other;
    other columns are ignored; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, length, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", *text_keys(F.col("text")), F.encode("text", "UTF-8").alias("text"))
    spans = spans.withColumn("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"]))

    def plain(df: DataFrame) -> DataFrame:
        more = [F.decode("text", "UTF-8").alias("kept_text")] if texts else []
        return df.select("doc_id", F.length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *more)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, count, digest, left = [], [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                cuts = [(s["begin"], s["end"]) for s in spans.as_py() or []]
                rest = kept(data, cuts)
                n.append(len(data))
                removed.append(len(data) - len(rest))
                count.append(len(cuts))
                digest.append(hashlib.sha256(rest).hexdigest())
                if texts:
                    left.append(rest.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(left, pa.string())] if texts else [])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if texts else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept_text string" if texts else "")
    if spans.count() > KEYS:
        return rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)
    keys = F.broadcast(spans.select("k1", "k2", "n_removed"))
    marked = rows.join(keys, ["k1", "k2"], "left")
    clean = plain(marked.where("n_removed is null"))
    gone = marked.where("n_removed = length(text)").select("doc_id", F.length("text").cast("long").alias("n_bytes"), F.col("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), *([F.lit("").alias("kept_text")] if texts else []))
    part = marked.where("n_removed < length(text)").join(spans.select("k1", "k2", "spans"), ["k1", "k2"]).select("doc_id", "text", "spans").mapInArrow(cut, schema)
    return clean.unionByName(gone).unionByName(part)
