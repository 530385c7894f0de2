"""SAM and BAM files as alignments, and their writers.

An alignment has ord, qname, flag, rname, pos (0-based), mapq, cigar, rnext, pnext (0-based), tlen,
seq, qual, tags (map of text) and tag_types (map of the tags' type letters).
"""

from __future__ import annotations

import fnmatch
import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "ord bigint, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>, tag_types map<string,string>"


def from_sam_lines(lines: DataFrame) -> DataFrame:
    """Alignments of SAM text lines (value); header lines are left out. ord rises with the order
    of the lines inside each file. Only built-in functions: files are split and lines parsed in
    parallel, and unused columns are never computed."""
    body = lines.withColumn("ord", F.monotonically_increasing_id()).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    f = F.split("value", "\t")
    optional = F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0)))
    tag = lambda x: F.substring(x, 1, 2)
    tags = F.map_from_entries(F.transform(optional, lambda x: F.struct(tag(x), F.substring(x, 6, 1_000_000))))
    types = F.map_from_entries(F.transform(optional, lambda x: F.struct(tag(x), F.substring(x, 4, 1))))
    return body.select(
        "ord", f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), (f[3].cast("int") - 1).alias("pos"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"),
        f[6].alias("rnext"), (f[7].cast("int") - 1).alias("pnext"), f[8].cast("int").alias("tlen"), f[9].alias("seq"), f[10].alias("qual"), tags.alias("tags"), types.alias("tag_types"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return from_sam_lines(spark.read.text(path))


def sam_header(spark: SparkSession, path: str) -> list[str]:
    """The header lines, in order."""
    rows = spark.read.text(path).withColumn("i", F.monotonically_increasing_id()).where(F.col("value").rlike(r"^@(HD|SQ|RG|PG|CO)\t"))
    return [r["value"] for r in rows.orderBy("i").collect()]


def contigs(header: list[str]) -> list[str]:
    return [part[3:] for line in header if line.startswith("@SQ") for part in line.split("\t") if part.startswith("SN:")]


def as_sam_lines(reads: DataFrame) -> DataFrame:
    """value: each alignment as a SAM line."""
    kind = lambda k: F.coalesce(F.try_element_at("tag_types", k), F.when(k == "UG", "i").otherwise("Z"))
    optional = F.transform(F.map_entries("tags"), lambda e: F.concat_ws(":", e["key"], kind(e["key"]), e["value"]))
    core = [F.col("qname"), F.col("flag"), F.col("rname"), F.col("pos") + 1, F.col("mapq"), F.col("cigar"), F.col("rnext"), F.col("pnext") + 1, F.col("tlen"), F.col("seq"), F.col("qual")]
    return reads.select(F.concat_ws("\t", *[c.cast("string") for c in core], F.array_join(optional, "\t")).alias("_line")).select(F.rtrim("_line", F.lit("\t")).alias("value"))


def sorted_by_coordinate(reads: DataFrame, names: list[str]) -> DataFrame:
    """By contig in the header's order, then position; unmapped reads last."""
    order = ["pos", *(["ord"] if "ord" in reads.columns else [])]
    if not names:
        return reads.orderBy("rname", *order)
    places = reads.sparkSession.createDataFrame(list({n: i for i, n in enumerate(names)}.items()), "_contig string, _place int")  # a row per contig
    return reads.join(F.broadcast(places), F.col("rname") == F.col("_contig"), "left").orderBy(F.col("_place").asc_nulls_last(), *order).drop("_contig", "_place")


def write_sam(reads: DataFrame, path: str, header: list[str], coordinate_sort: bool = True) -> None:
    """SAM text files under path, with the header as a file of its own that sorts first."""
    rows = sorted_by_coordinate(reads, contigs(header)) if coordinate_sort else reads
    as_sam_lines(rows).write.mode("overwrite").text(path)
    if header:
        spark = reads.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path + "/header.sam")
        stream = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path, True)
        stream.write(("\n".join(header) + "\n").encode())
        stream.close()


# --- BAM --------------------------------------------------------------------------------------

_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_NUMBER = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def bgzf_blocks(file) -> Iterator[bytes]:
    """The unpacked blocks of a blocked gzip file."""
    while head := file.read(18):
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a blocked gzip file")
        size = struct.unpack("<H", head[16:18])[0] + 1
        body = file.read(size - 18)
        yield zlib.decompress(body[:-8], -15)


class _Bytes:
    """Reads exact sizes from a stream of blocks."""

    def __init__(self, blocks: Iterator[bytes]) -> None:
        self.blocks, self.buffer = blocks, b""

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            block = next(self.blocks, None)
            if block is None:
                break
            parts.append(block)
            have += len(block)
        data = b"".join(parts)
        self.buffer = data[n:]
        return data[:n]


def _tags(data: bytes) -> tuple[dict[str, str], dict[str, str]]:
    tags, types, at = {}, {}, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in _NUMBER:
            code = "<" + _NUMBER[kind]
            value = struct.unpack_from(code, data, at)[0]
            at += struct.calcsize(code)
            types[name], tags[name] = ("f" if kind == "f" else "i"), f"{value:g}" if kind == "f" else str(value)
        elif kind in "ZH":
            end = data.index(0, at)
            types[name], tags[name] = kind, data[at:end].decode()
            at = end + 1
        elif kind == "A":
            types[name], tags[name] = "A", chr(data[at])
            at += 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            code = f"<{n}{_NUMBER[sub]}"
            types[name], tags[name] = "B", ",".join([sub, *(f"{v:g}" if sub == "f" else str(v) for v in struct.unpack_from(code, data, at + 5))])
            at += 5 + struct.calcsize(code)
        else:
            raise ValueError(f"unknown tag type {kind!r}")
    return tags, types


def _opened(file) -> tuple[_Bytes, list[str]]:
    """A BAM file's stream after its header, and the names of its contigs."""
    stream = _Bytes(bgzf_blocks(file))
    if stream.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    stream.take(struct.unpack("<i", stream.take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        names.append(stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode())
        stream.take(4)
    return stream, names


def _cigar(data: bytes) -> str:
    return "".join(f"{c >> 4}{_OPS[c & 15]}" for c in struct.unpack(f"<{len(data) // 4}I", data)) or "*"


def _alignment(data: bytes, names: list[str]) -> tuple:
    """A BAM record as a row of the schema without its number."""
    name = lambda i: names[i] if i >= 0 else "*"
    ref, pos, bins, flags, n_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiIIiiii", data)
    n_name, mapq, n_cigar, flag = bins & 255, bins >> 8 & 255, flags & 65535, flags >> 16
    at = 32 + n_name
    qname = data[32 : at - 1].decode()
    cigar = _cigar(data[at : at + 4 * n_cigar])
    at += 4 * n_cigar
    packed = data[at : at + (n_seq + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n_seq] or "*"
    at += (n_seq + 1) // 2
    raw = data[at : at + n_seq]
    qual = "*" if not n_seq or raw[0] == 255 else "".join(chr(q + 33) for q in raw)
    tags, types = _tags(data[at + n_seq :])
    rnext = "=" if next_ref == ref and ref >= 0 else name(next_ref)
    return qname, flag, name(ref), pos, mapq, cigar, rnext, next_pos, tlen, seq, qual, tags, types


def bam_records(file) -> Iterator[tuple]:
    """Alignments of an open BAM file one by one, as rows of the schema."""
    stream, names = _opened(file)
    number = 0
    while len(size := stream.take(4)) == 4:
        yield number, *_alignment(stream.take(struct.unpack("<i", size)[0]), names)
        number += 1


class _Odd(Exception):
    """A batch has what is only read and written record by record: array and float tags, repeated
    tags, text beyond ASCII, missing or impossible values."""


_TEXT, _MAP = pa.string(), pa.map_(pa.string(), pa.string())
_ARROW = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "string": _TEXT}.get(t, _MAP)) for n, t in (c.split() for c in SCHEMA.split(", "))])
_PAIRS = np.array([[ord(_BASES[b >> 4]), ord(_BASES[b & 15])] for b in range(256)], np.uint8)
_CODES = np.array([_BASES.index(chr(c)) if chr(c) in _BASES else 15 for c in range(256)], np.uint8)
#: Unpacked bytes that are decoded at once, about.
_CHUNK = 1 << 20


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all bytes of pieces with these starts and lengths, piece after piece."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)


def _of_bytes(data: np.ndarray, lengths: np.ndarray, kind: pa.DataType = _TEXT) -> pa.Array:
    """Texts (or binary values) of these lengths, which stand one after the other in data."""
    out = pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(_offsets(lengths)), pa.py_buffer(np.ascontiguousarray(data))])
    out.validate(full=True)
    return out


def _to_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, lengths) of texts or binary values without nulls."""
    if values.null_count:
        raise _Odd
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset).astype(np.int64) if len(values) else np.zeros(1, np.int64)
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and data.size else np.zeros(0, np.uint8), np.diff(offsets)


def _decoded_tags(raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """(names, values, types, number of the record) of the tags that lie from at to end of each record."""
    zeros, records = np.flatnonzero(raw == 0), np.arange(len(at))
    found = []
    while len(records):
        open_ = at < end
        records, at, end = records[open_], at[open_], end[open_]
        if (at + 3 > end).any():
            raise _Odd
        kind, value = raw[at + 2], at + 3
        length = np.select([np.isin(kind, list(b"cCA")), np.isin(kind, list(b"sS")), np.isin(kind, list(b"iI"))], [1, 2, 4], 0)
        text = np.isin(kind, list(b"ZH"))
        if not (text | (length > 0)).all():
            raise _Odd
        stop = np.searchsorted(zeros, value[text])
        if len(stop) and stop.max() >= len(zeros):
            raise _Odd
        length[text] = zeros[stop] - value[text]
        found.append((records, at, kind, value, length))
        at = value + length + text
        if (at > end).any():
            raise _Odd
    record, name, kind, value, length = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
    order = np.argsort(record, kind="stable")
    record, name, kind, value, length = (x[order] for x in (record, name, kind, value, length))
    if len(np.unique(record * 65536 + raw[name].astype(np.int64) * 256 + raw[name + 1])) < len(record):
        raise _Odd
    number = ~np.isin(kind, list(b"AZH"))
    values = np.zeros(int(number.sum()), np.int64)
    for k, code in _NUMBER.items():
        if (mine := kind[number] == ord(k)).any():
            form = np.dtype("<" + {"b": "i1", "B": "u1", "h": "i2", "H": "u2", "i": "i4", "I": "u4"}[code])
            values[mine] = raw[value[number][mine][:, None] + np.arange(form.itemsize)].view(form)[:, 0]
    texts = _of_bytes(raw[_spread(value[~number], length[~number])], length[~number])
    place = np.empty(len(record), np.int64)
    place[~number], place[number] = np.arange(len(texts)), len(texts) + np.arange(len(values))
    items = pa.concat_arrays([texts, pc.cast(pa.array(values), _TEXT)]).take(pa.array(place))
    keys = _of_bytes(raw[_spread(name, np.full(len(name), 2))], np.full(len(name), 2))
    types = _of_bytes(np.where(number, ord("i"), kind).astype(np.uint8), np.ones(len(kind), np.int64))
    return keys, items, types, record


def _decoded(data: bytes, starts: np.ndarray, ends: np.ndarray, names: list[str], first: int) -> pa.RecordBatch:
    """The records of data from starts to ends as a batch, numbered from first."""
    raw, n = np.frombuffer(data, np.uint8), len(starts)
    fixed = raw[starts[:, None] + np.arange(32)]
    ref, pos, _, _, n_seq, next_ref, next_pos, tlen = fixed.view("<i4").T
    bins, flags = fixed.view("<u4").T[2:4]
    n_seq = n_seq.astype(np.int64)
    n_name, n_cigar = (bins & 255).astype(np.int64), 4 * (flags & 65535).astype(np.int64)
    cigar_at = starts + 32 + n_name
    seq_at = cigar_at + n_cigar
    half = (n_seq + 1) // 2
    qual_at = seq_at + half
    tags_at = qual_at + n_seq
    if (n_name < 1).any() or (n_seq < 0).any() or (tags_at > ends).any():
        raise _Odd
    cigars = _of_bytes(raw[_spread(cigar_at, n_cigar)], n_cigar, pa.binary()).dictionary_encode()
    bases = _PAIRS[raw[_spread(seq_at, half)]].ravel()[_spread(2 * (np.cumsum(half) - half), n_seq)]
    missing = n_seq == 0
    missing[~missing] = raw[qual_at[~missing]] == 255
    n_qual = np.where(missing, 0, n_seq)
    quals = raw[_spread(qual_at, n_qual)]
    if (quals > 127 - 33).any():
        raise _Odd
    star = lambda none, texts: pc.if_else(pa.array(none), "*", texts)
    keys, items, types, record = _decoded_tags(raw, tags_at, ends)
    offsets = pa.array(_offsets(np.bincount(record, minlength=n)))
    contig = pa.array([*names, "*", "="], _TEXT)
    at = lambda i: np.where(i < 0, len(names), i)
    columns = [
        pa.array(np.arange(first, first + n)), _of_bytes(raw[_spread(starts + 32, n_name - 1)], n_name - 1), pa.array((flags >> 16).astype(np.int32)), contig.take(pa.array(at(ref))), pa.array(pos),
        pa.array((bins >> 8 & 255).astype(np.int32)), pa.array([_cigar(c) for c in cigars.dictionary.to_pylist()], _TEXT).take(cigars.indices),
        contig.take(pa.array(np.where((next_ref == ref) & (ref >= 0), len(names) + 1, at(next_ref)))), pa.array(next_pos), pa.array(tlen),
        star(n_seq == 0, _of_bytes(bases, n_seq)), star(missing, _of_bytes(quals + np.uint8(33), n_qual)), pa.MapArray.from_arrays(offsets, keys, items), pa.MapArray.from_arrays(offsets, keys, types),
    ]
    return pa.RecordBatch.from_arrays([c.cast(t) if c.type != t else c for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


def bam_batches(file) -> Iterator[pa.RecordBatch]:
    """Alignments of an open BAM file in batches, as columns of the schema."""
    stream, names = _opened(file)
    number, data = 0, b""
    while more := stream.take(_CHUNK):
        data += more
        starts, ends, at = [], [], 0
        while at + 4 <= len(data):
            end = at + 4 + struct.unpack_from("<i", data, at)[0]
            if end > len(data):
                break
            if end < at + 36:
                raise ValueError(f"record {number + len(starts)} is too short")
            starts.append(at + 4)
            ends.append(end)
            at = end
        if starts:
            try:
                yield _decoded(data, np.array(starts), np.array(ends), names, number)
            except _Odd:
                rows = [(number + i, *_alignment(data[a:b], names)) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
                columns = [[list(v.items()) if isinstance(v, dict) else v for v in c] for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)
        number, data = number + len(starts), data[at:]
    if data:
        raise ValueError(f"the file ends inside record {number}")


def bgzf_block(data: bytes) -> bytes:
    """One block of a blocked gzip file; data of at most 65,280 bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def _bin(begin: int, end: int) -> int:
    """The smallest bin of the binning index that holds the interval."""
    end -= 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return offset + (begin >> shift)
    return 0


def bam_record(read, place: dict[str, int]) -> bytes:
    """An alignment as a BAM record; place numbers the contigs."""
    ref = place.get(read["rname"], -1)
    nxt = ref if read["rnext"] == "=" else place.get(read["rnext"], -1)
    name = read["qname"].encode() + b"\0"
    cigar, n, span = [], "", 0
    for c in "" if read["cigar"] in (None, "*") else read["cigar"]:
        if c.isdigit():
            n += c
        else:
            cigar.append(int(n) << 4 | _OPS.index(c))
            span += int(n) if c in "MDN=X" else 0
            n = ""
    seq = "" if read["seq"] in (None, "*") else read["seq"]
    codes = [_BASES.index(c) if c in _BASES else 15 for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    qual = b"\xff" * len(seq) if read["qual"] in (None, "*") else bytes(ord(q) - 33 for q in read["qual"])
    tags = b""
    for k, v in (read["tags"] or {}).items():
        kind = (read["tag_types"] or {}).get(k, "i" if k == "UG" else "Z")
        if kind == "B":
            sub, *items = v.split(",")
            values = [float(x) if sub == "f" else int(x) for x in items]
            tags += k.encode() + b"B" + sub.encode() + struct.pack(f"<i{len(values)}{_NUMBER[sub]}", len(values), *values)
        else:
            value = {"i": lambda: struct.pack("<i", int(v)), "f": lambda: struct.pack("<f", float(v)), "A": lambda: v.encode()}.get(kind, lambda: v.encode() + b"\0")()
            tags += k.encode() + kind.encode() + value
    pos = read["pos"]
    data = struct.pack("<iiBBHHHiiii", ref, pos, len(name), read["mapq"], _bin(max(0, pos), max(0, pos) + max(1, span)), len(cigar), read["flag"], len(seq), nxt, read["pnext"], read["tlen"])
    data += name + struct.pack(f"<{len(cigar)}I", *cigar) + packed + qual + tags
    return struct.pack("<i", len(data)) + data


def _encoded_tags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, lengths) of the records' tags."""
    def entries(name: str) -> tuple[np.ndarray, pa.Array, pa.Array]:
        maps = batch.column(name)
        offsets = maps.offsets.to_numpy().astype(np.int64)
        many = np.where(maps.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        at = pa.array(_spread(offsets[:-1], many))
        return np.repeat(np.arange(len(maps)), many), maps.keys.take(at), maps.items.take(at)

    record, keys, values = entries("tags")
    type_of, type_keys, types = entries("tag_types")
    ids = {k: i for i, k in enumerate(dict.fromkeys([*keys.unique().to_pylist(), *type_keys.unique().to_pylist()]))}
    code = lambda rows, names: rows * len(ids) + pc.index_in(names, pa.array(list(ids), _TEXT)).to_numpy(zero_copy_only=False).astype(np.int64)
    given = pc.index_in(pa.array(code(record, keys)), pa.array(code(type_of, type_keys)))
    kinds = pc.coalesce(types.take(given), pc.if_else(pc.equal(keys, "UG"), "i", "Z"))
    (kind, one), (key, n_key) = _to_bytes(kinds), _to_bytes(keys)
    number = kind == ord("i") if (one == 1).all() else None
    if number is None or np.isin(kind, list(b"fB")).any() or values.null_count:
        raise _Odd
    try:
        numbers = pc.cast(values.filter(pa.array(number)), pa.int32()).to_numpy().astype("<i4")
    except pa.ArrowInvalid as bad:
        raise _Odd from bad
    text, n_text = _to_bytes(values.filter(pa.array(~number)))
    length = np.full(len(record), 4)
    length[~number] = n_text
    size = n_key + 1 + length + (~number & (kind != ord("A")))
    out, at = np.zeros(int(size.sum()), np.uint8), np.cumsum(size) - size
    out[_spread(at, n_key)] = key
    out[at + n_key] = kind
    value = at + n_key + 1
    out[_spread(value[~number], n_text)] = text
    out[_spread(value[number], length[number])] = numbers.view(np.uint8)
    return out, np.bincount(record, size, len(batch)).astype(np.int64)


def _encoded(batch: pa.RecordBatch, place: dict[str, int]) -> bytes:
    """The batch's alignments as BAM records."""
    n = len(batch)
    number = {}
    for c, high in (("flag", 65535), ("pos", 2**31 - 1), ("mapq", 255), ("pnext", 2**31 - 1), ("tlen", 2**31 - 1)):
        if batch.column(c).null_count:
            raise _Odd
        number[c] = batch.column(c).to_numpy().astype(np.int64)
        if (number[c] > high).any() or (high < 2**31 - 1 and (number[c] < 0).any()):
            raise _Odd

    def by_value(name: str, value) -> tuple[list, np.ndarray]:
        """value of each distinct text, and which of them each record has."""
        coded = pc.fill_null(batch.column(name), "*").dictionary_encode()
        return [value(x) for x in coded.dictionary.to_pylist()], coded.indices.to_numpy()

    def operations(text: str) -> tuple[bytes, int]:
        read = {"qname": "", "rname": "*", "rnext": "*", "cigar": text, "pos": 0, "mapq": 0, "flag": 0, "pnext": 0, "tlen": 0, "seq": "*", "qual": "*", "tags": {}, "tag_types": {}}
        data = bam_record(read, {})[37:]
        return data, sum(c >> 4 for c in struct.unpack(f"<{len(data) // 4}I", data) if _OPS[c & 15] in "MDN=X")

    def bare(name: str) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(batch.column(name), "*")
        data, lengths = _to_bytes(pc.if_else(pc.equal(texts, "*"), "", texts))
        if (data > 127).any():
            raise _Odd
        return data, lengths

    ids, which = by_value("rname", lambda x: place.get(x, -1))
    ref = np.array(ids, np.int64)[which]
    ids, which = by_value("rnext", lambda x: -2 if x == "=" else place.get(x, -1))
    nxt = np.array(ids, np.int64)[which]
    nxt = np.where(nxt == -2, ref, nxt)
    ops, which = by_value("cigar", operations)
    cigar, n_cigar = _to_bytes(pa.array([o for o, _ in ops], pa.binary()).take(pa.array(which)))
    span = np.array([x for _, x in ops], np.int64)[which]
    (name, n_name), (seq, n_seq), (qual, n_qual) = _to_bytes(batch.column("qname")), bare("seq"), bare("qual")
    tags, n_tags = _encoded_tags(batch)
    if (n_name > 254).any() or (n_cigar > 4 * 65535).any() or (qual < 33).any() or (n_qual[n_qual > 0] != n_seq[n_qual > 0]).any():
        raise _Odd
    begin = np.maximum(0, number["pos"])
    last, bins = begin + np.maximum(1, span) - 1, np.zeros(n, np.int64)
    for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        bins = np.where(begin >> shift == last >> shift, offset + (begin >> shift), bins)
    half = (n_seq + 1) // 2
    name_at = 36
    sizes = name_at + n_name + 1 + n_cigar + half + n_seq + n_tags
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.empty((n, 9), "<i8")
    head.T[:] = sizes - 4, ref, number["pos"], (n_name + 1) | number["mapq"] << 8 | (bins & 65535) << 16, n_cigar // 4 | number["flag"] << 16, n_seq, nxt, number["pnext"], number["tlen"]
    out[at[:, None] + np.arange(36)] = (head & 0xFFFFFFFF).astype("<u4").view(np.uint8)
    at = at + name_at
    out[_spread(at, n_name)] = name
    at = at + n_name + 1
    out[_spread(at, n_cigar)] = cigar
    at = at + n_cigar
    codes = np.zeros(2 * int(half.sum()), np.uint8)
    codes[_spread(2 * (np.cumsum(half) - half), n_seq)] = _CODES[seq]
    out[_spread(at, half)] = codes[::2] << 4 | codes[1::2]
    at = at + half
    out[_spread(at, np.where(n_qual > 0, 0, n_seq))] = 255
    out[_spread(at, n_qual)] = qual - np.uint8(33)
    out[_spread(at + n_seq, n_tags)] = tags
    return out.tobytes()


def bam_bytes(batch: pa.RecordBatch, place: dict[str, int]) -> bytes:
    """A batch's alignments as BAM records; place numbers the contigs."""
    try:
        return _encoded(batch, place)
    except _Odd:
        return b"".join(bam_record(read, place) for read in batch.to_pylist(maps_as_pydicts="strict"))


def bam_head(header: list[str]) -> bytes:
    text = ("\n".join(header) + "\n").encode() if header else b""
    sizes = {c: next((int(p[3:]) for p in line.split("\t") if p.startswith("LN:")), 0) for c, line in zip(contigs(header), [h for h in header if h.startswith("@SQ")], strict=True)}
    refs = b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in sizes.items())
    return b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(sizes)) + refs


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (local, or by the scheme of a URI) and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _BamWriter(DataSourceArrowWriter):
    """Every partition becomes a complete file of its own; it gets its name once it is whole, so a
    repeated task leaves one file."""

    def __init__(self, path: str, header: list[str], overwrite: bool) -> None:
        self.path, self.header = path, header
        store, folder = _store(path)
        store.create_dir(folder)
        for old in store.get_file_info(fs.FileSelector(folder)) if overwrite else ():
            if old.base_name.startswith("part-") and old.base_name.endswith(".bam"):
                store.delete_file(old.path)

    def write(self, iterator) -> WriterCommitMessage:
        context = TaskContext.get()
        store, folder = _store(self.path)
        final = f"{folder}/part-{context.partitionId():05d}.bam"
        scratch = f"{final}.{context.taskAttemptId()}"
        place = {c: i for i, c in enumerate(contigs(self.header))}
        with store.open_output_stream(scratch) as out:
            buffer = bytearray(bam_head(self.header))
            for batch in iterator:
                buffer += bam_bytes(batch, place)
                whole = len(buffer) // 65_280 * 65_280
                for i in range(0, whole, 65_280):
                    out.write(bgzf_block(bytes(buffer[i : i + 65_280])))
                del buffer[:whole]
            if buffer:
                out.write(bgzf_block(bytes(buffer)))
            out.write(bgzf_block(b""))
        store.move(scratch, final)
        return _Written(final)


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _BamReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        store, at = _store(path)
        folder, name = (at, "*.bam") if store.get_file_info(at).type == fs.FileType.Directory else os.path.split(at)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        self.paths = sorted(f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, name))
        if not self.paths:
            raise FileNotFoundError(path)

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with _store(self.path)[0].open_input_stream(partition.path, buffer_size=1 << 20) as file:
            yield from bam_batches(file)


class BamSource(DataSource):
    """spark.read.format("bam").load(path): one task per file."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BamWriter(self.options["path"], json.loads(self.options.get("header", "[]")), overwrite)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").load(path)


def bam_header(path: str) -> list[str]:
    """The header lines of a BAM file, or of the first in a folder."""
    with _store(path)[0].open_input_stream(_BamReader(path).paths[0], buffer_size=1 << 20) as file:
        stream = _Bytes(bgzf_blocks(file))
        stream.take(4)
        return stream.take(struct.unpack("<i", stream.take(4))[0]).decode().rstrip("\0\n").split("\n")


def write_bam(reads: DataFrame, path: str, header: list[str], coordinate_sort: bool = True) -> None:
    """BAM files under path, one per partition, each with the header; sorted they are ranges of the
    order that follow each other by name."""
    reads.sparkSession.dataSource.register(BamSource)
    rows = sorted_by_coordinate(reads, contigs(header)) if coordinate_sort else reads
    types = rows["tag_types"] if "tag_types" in rows.columns else F.create_map().cast("map<string,string>")
    columns = [c.split()[0] for c in SCHEMA.split(", ") if not c.startswith("tag_types")]
    ordered = rows if "ord" in rows.columns else rows.withColumn("ord", F.monotonically_increasing_id())
    ordered.select(*columns, types.alias("tag_types")).write.format("bam").option("header", json.dumps(header)).mode("overwrite").save(path)


__all__ = ["BamSource", "as_sam_lines", "bam_batches", "bam_bytes", "bam_header", "bam_records", "contigs", "from_sam_lines", "read_bam", "read_sam", "sam_header", "sorted_by_coordinate", "write_bam", "write_sam"]
