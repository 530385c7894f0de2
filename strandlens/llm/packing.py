"""Packing token sequences into fixed-length bins by swap-based local search.

Token counts are integers of at most the bin size, so the whole packing is decided on a histogram
of piece lengths: at most ``size`` distinct lengths however many documents there are. The driver
packs the histogram into bin patterns with multiplicities, and a second pass gives each piece the
place of its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import binascii
import heapq
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

Pattern = tuple[int, ...]


# --- tokens -----------------------------------------------------------------------------------

#: Splitting pattern of the byte-level BPE vocabulary; fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose classes all Unicode versions and regular expression engines agree.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ɏ]*")
#: The fast splitter goes back over white space, one stack frame a character: longer runs are not for it.
WHITE, _WHITE_RUN = 10_000, re.compile(r"\s\s+")


class ByteBpe:
    """Ids of a byte-level BPE file in tokenizers' JSON format.

    Ordinary Latin text goes through tiktoken built from the file's own vocabulary, which gives the
    same ids several times faster; text with other characters, with the string of an added token,
    or with over 10,000 characters of white space in a row, goes through tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self.exact = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in letters]
        as_byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(as_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ordinary(self, text: str) -> bool:
        if not _PLAIN.fullmatch(text) or any(t in text for t in self.added):
            return False
        return len(text) <= WHITE or all(m.end() - m.start() <= WHITE for m in _WHITE_RUN.finditer(text))

    def __call__(self, text: str) -> list[int]:
        if self.ordinary(text):
            return self.fast.encode_ordinary(text)
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path)
        return self.exact.encode(text, add_special_tokens=False).ids


PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, lane int"
#: Pieces of one length that are ranked in one task, as a mean: the least, the most, and how many parts
#: there are before the most is reached. Lanes that pieces are dealt to.
RANKED, PARTS, LANES = (512, 250_000), 64, 1 << 20


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole, or size each with a shorter first one."""
    head = n % size or size
    return [(0, head), *((at, size) for at in range(head, n, size))] if n else []


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces, and lane, which counts them
    inside a task; a null text is empty and has the end id alone. One pass, no shuffle."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteBpe(tokenizer_path)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("lane", pa.int32())])
        lane = 0
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    for column, value in zip(rows, (doc_id, k, start, length, binascii.crc32(ids[start : start + length].tobytes()), lane % LANES), strict=True):
                        column.append(value)
                    lane += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES)


# --- the histogram ----------------------------------------------------------------------------


def best_fit(counts: dict[int, int], size: int) -> Counter[Pattern]:
    """Best-fit decreasing on a histogram: lengths go down, each into the fullest bins it fits,
    whole classes of equal bins at once."""
    open_bins: dict[int, Counter[Pattern]] = {size: Counter()}
    rooms = [size]
    done: Counter[Pattern] = Counter()
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            while i < len(rooms) and not open_bins[rooms[i]]:
                i += 1
            if i < len(rooms) and rooms[i] < size:
                room = rooms[i]
                pattern, have = next(iter(open_bins[room].items()))
                fit = room // length
                # as many of this length as one bin holds, while whole groups last
                each = min(fit, left)
                used = min(have, left // each)
                open_bins[room][pattern] -= used
                if not open_bins[room][pattern]:
                    del open_bins[room][pattern]
            else:
                pattern, room = (), size
                each = min(size // length, left)
                used = left // each
            left -= each * used
            grown, room = pattern + (length,) * each, room - each * length
            if room:
                if room not in open_bins:
                    open_bins[room] = Counter()
                    rooms.insert(bisect_left(rooms, room), room)
                open_bins[room][grown] += used
            else:
                done[grown] += used
    for room, bins in open_bins.items():
        if room < size:
            done.update(bins)
    return done


def local_search(bins: Counter[Pattern], size: int) -> Counter[Pattern]:
    """Exchange pieces between underfull bins until no exchange increases squared fill, or the bins
    are as few as the sum of the pieces allows.

    Works on patterns with their multiplicities, all underfull ones: the emptiest are donors first;
    each looks among all patterns that are as full, copies of itself included, for a piece to move
    there, or to exchange one or two of its pieces for a smaller one, and takes the step that leaves
    the receiver fullest, in as many bins at once as there are of both. Every step increases the sum
    of squared fills, so the search ends; donors that reach zero disappear.
    """
    used, least = sum(bins.values()), -(-sum(sum(p) * n for p, n in bins.items()) // size)
    full = Counter({p: n for p, n in bins.items() if sum(p) == size})
    under = Counter({p: n for p, n in bins.items() if sum(p) < size})
    receivers = _Receivers(size)
    for p in under:
        receivers.add(p)
    improved = True
    while improved and used > least:
        improved = False
        for donor in sorted(under, key=lambda p: (sum(p), p)):
            while under[donor] and used > least and (step := receivers.best(donor, under[donor])):
                receiver, give, take = step
                n = under[donor] // 2 if receiver == donor else min(under[donor], under[receiver])
                for p, away, more in ((donor, give, take), (receiver, take, give)):
                    under[p] -= n
                    left = list(p)
                    for x in away:
                        left.remove(x)
                    grown = tuple(sorted((*left, *more), reverse=True))
                    if not grown:
                        used -= n
                    elif sum(grown) == size:
                        full[grown] += n
                    else:
                        if not under[grown]:
                            receivers.add(grown)
                        under[grown] += n
                for p in {donor, receiver}:
                    if not under[p]:
                        receivers.drop(p)
                improved = True
        under += Counter()
    return full + under


class _Receivers:
    """What underfull patterns take: a row for each (pattern, piece given back, or 0 for none)."""

    def __init__(self, size: int) -> None:
        self.size, self.n = size, 0
        self.patterns: list[Pattern] = []
        self.at: dict[Pattern, tuple[int, int]] = {}
        self.room, self.back = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def add(self, pattern: Pattern) -> None:
        if pattern in self.at:
            return
        back = [0, *sorted(set(pattern))]
        if self.n + len(back) > len(self.room):
            self._compact(len(back))
        a, b = self.n, self.n + len(back)
        self.room[a:b], self.back[a:b] = self.size - sum(pattern), back
        self.patterns += [pattern] * len(back)
        self.at[pattern] = a, b
        self.n = b

    def drop(self, pattern: Pattern) -> None:
        a, b = self.at.pop(pattern)
        self.room[a:b] = self.size + 1

    def _compact(self, more: int) -> None:
        live = np.flatnonzero(self.room[: self.n] <= self.size)
        room, back, patterns = self.room[live], self.back[live], [self.patterns[i] for i in live]
        n = len(live)
        self.room, self.back = np.zeros(2 * (n + more), np.int64), np.zeros(2 * (n + more), np.int64)
        self.room[:n], self.back[:n] = room, back
        self.n, self.patterns, self.at = n, patterns, {}
        for i, p in enumerate(patterns):
            self.at[p] = self.at.get(p, (i, i))[0], i + 1

    def best(self, donor: Pattern, copies: int) -> tuple[Pattern, Pattern, Pattern] | None:
        """(receiver, pieces it gets, pieces it gives back) of the step that leaves the least room
        in a receiver at least as full; of those the step that moves most."""
        sums: dict[int, Pattern] = {}
        own = sorted(set(donor))
        for i, x in enumerate(own):
            for y in own[i + (donor.count(x) < 2) :]:
                sums[x + y] = (x, y)
        sums |= {x: (x,) for x in own}
        ok = self.room[: self.n] <= self.size - sum(donor)
        if copies < 2:
            ok[slice(*self.at[donor])] = False
        rows = np.flatnonzero(ok)
        # sum that fills the receiver -> least piece given back for it
        least = np.full(self.size + 1, self.size + 1)
        np.minimum.at(least, self.room[rows] + self.back[rows], self.back[rows])
        filling = np.flatnonzero(least <= self.size)
        s = np.array(sorted(sums, reverse=True))
        room = filling - s[:, None]
        cost = np.where((room >= 0) & (least[filling] < s[:, None]), room * (2 * self.size) + least[filling] - s[:, None] + self.size, np.iinfo(np.int64).max)
        if not cost.size or cost.min() == np.iinfo(np.int64).max:
            return None
        i, j = np.unravel_index(cost.argmin(), cost.shape)
        back = int(least[filling[j]])
        row = rows[(self.back[rows] == back) & (self.room[rows] == filling[j] - back)][0]
        return self.patterns[row], sums[int(s[i])], (back,) if back else ()


def pack(counts: dict[int, int], size: int) -> Counter[Pattern]:
    return local_search(best_fit(counts, size), size)


def places(bins: Counter[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): the pieces of this length and these
    ranks go to consecutive sequences, at this offset."""
    rows, used, sequence = [], Counter(), 0
    for pattern, copies in sorted(bins.items(), reverse=True):
        offset = 0
        for length in pattern:
            rows.append((length, used[length], used[length] + copies - 1, sequence, offset))
            used[length] += copies
            offset += length
        sequence += copies
    return rows


# --- the operator -----------------------------------------------------------------------------


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Documents over ``size`` tokens are cut, no others. A null text packs as an empty one (the end
    id alone); null ids and repeated rows are packed like any other; an empty table gives an empty
    result. Pieces of one length can stand for each other: they are ranked among themselves in
    parts of some 250,000 at most, however many they are and whatever they hold, so no task gets a
    length, an id or a text as a whole. The driver sees one row per (length, part) and sends back
    the places, at most a few for each length and bin pattern.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer_path, size, end_id, id_col, text_col), "pieces")
    counted = pieces.groupBy("length").count().collect()  # at most size rows
    of_length = [(r["length"], max(min(PARTS, -(-r["count"] // RANKED[0])), -(-r["count"] // RANKED[1]))) for r in counted]
    lanes = spark.createDataFrame(of_length, "length int, _lanes int")
    salted = pieces.join(F.broadcast(lanes), "length").withColumn("_salt", F.col("lane") % F.col("_lanes")).drop("lane", "_lanes")
    parts = sorted(tuple(r) for r in salted.groupBy("length", "_salt").count().collect())  # a row for each length and part
    counts: Counter[int] = Counter()
    shifts = []
    for length, salt, n in parts:
        shifts.append((length, salt, counts[length]))
        counts[length] += n
    table = places(pack(dict(counts), size))
    shift = spark.createDataFrame(shifts, "length int, _salt int, _shift bigint")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(F.broadcast(shift), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_shift"))
    by_length: dict[int, list[tuple]] = {}
    for length, *rest in table:
        by_length.setdefault(length, []).append(tuple(rest))
    schema = "_length int, _places array<struct<first:bigint,last:bigint,sequence:bigint,offset:bigint>>"
    lookup = spark.createDataFrame([(k, v) for k, v in by_length.items()], schema)
    found = F.broadcast(lookup)
    at = F.expr("element_at(_places, cast(array_size(filter(_places, p -> p.first <= _rank)) as int))")
    return (
        ranked.join(found, F.col("length") == F.col("_length"))
        .withColumn("_at", at)
        .select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("_at.sequence") + F.col("_rank") - F.col("_at.first")).alias("sequence_id"), F.col("_at.offset").alias("offset"))
    )
