"""Media columns: MPEG-2 transport streams.

``mux`` stores a payload as 188-byte packets with a program association table, a program map table
and one elementary stream of PES packets; ``demux`` parses the tables, checks continuity counters,
reassembles the PES packets and collects timestamps and random-access points.
"""

from __future__ import annotations

import binascii
import hashlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0x0000, 0x1FFF
CLOCK = 90_000
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06

PMT_PID, DATA_PID, PROGRAM = 0x0100, 0x0101, 1
#: Payload bytes of a PES packet, ticks between two, and every how many one can be started at.
UNIT, TICKS, RANDOM_ACCESS_EVERY = 32_768, 3_600, 4


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ 0x04C11DB7 if value & 0x80000000 else value << 1
        table.append(value & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ byte]
    return crc


def _section(table_id: int, ext_id: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table_id, 0xB0 | (length >> 8), length & 0xFF, ext_id >> 8, ext_id & 0xFF, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | (pid >> 8), pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


def _pts_bytes(pts: int) -> bytes:
    pts &= (1 << 33) - 1
    return bytes([0x21 | ((pts >> 30) << 1), (pts >> 22) & 0xFF, 0x01 | ((pts >> 14) & 0xFE), (pts >> 7) & 0xFF, 0x01 | ((pts << 1) & 0xFE)])


def _read_pts(b: bytes) -> int:
    return ((b[0] >> 1) & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _pcr_field(pts: int, random_access: bool) -> bytes:
    base = pts & ((1 << 33) - 1)
    return bytes([7, 0x10 | 0x40 * random_access]) + ((base << 15) | (0x3F << 9)).to_bytes(6, "big")


_TABLES = _table_packet(PAT_PID, _section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 0xFF, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, PRIVATE_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0]))
)


def _pes_packets(pes: bytes, counter: int, clock: bytes) -> bytes:
    """The transport packets of one PES packet; the first carries the adaptation field clock."""
    room = PACKET - 4 - len(clock)
    first, rest = pes[:room], pes[room:]
    n_rest = -(-len(rest) // (PACKET - 4))
    out = np.empty((1 + n_rest, PACKET), np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
    out[:, 3] = 0x10 | ((counter + np.arange(1 + n_rest)) & 15)
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    stuffing = room - len(first)
    field = bytes([clock[0] + stuffing]) + clock[1:] + b"\xff" * stuffing
    out[0, 4:] = np.frombuffer(field + first, np.uint8)
    full = len(rest) // (PACKET - 4)
    if full:
        out[1 : 1 + full, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, PACKET - 4)
    if n_rest > full:
        tail = rest[full * (PACKET - 4) :]
        gap = PACKET - 4 - len(tail)
        field = bytes([gap - 1]) + (b"\x00" + b"\xff" * (gap - 2) if gap > 1 else b"")
        out[1 + full, 3] |= 0x20
        out[1 + full, 4:] = np.frombuffer(field + tail, np.uint8)
    return out.tobytes()


def mux(payload: bytes) -> bytes:
    """payload as a transport stream. Each PES packet holds up to 32,768 bytes and a timestamp; the
    tables come again before each random-access point, so a reader can start there."""
    parts, counter, tables = [], 0, 0
    units = range(0, len(payload), UNIT) if payload else [0]
    for i, at in enumerate(units):
        entry = i % RANDOM_ACCESS_EVERY == 0
        if entry:
            both = bytearray(_TABLES)
            both[3] |= tables & 15
            both[PACKET + 3] |= tables & 15
            tables += 1
            parts.append(bytes(both))
        data = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(CLOCK + i * TICKS) + data
        packets = _pes_packets(pes, counter, _pcr_field(CLOCK + i * TICKS, entry))
        counter = (counter + len(packets) // PACKET) & 15
        parts.append(packets)
    return b"".join(parts)


@dataclass
class Stream:
    pid: int
    stream_type: int
    payload: bytes = b""
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    continuity_errors: int = 0
    units: int = 0
    #: Numbers of the units of which bytes are missing.
    damaged: list[int] = field(default_factory=list)


def _sections(rows: np.ndarray, starts: np.ndarray, unit_start: np.ndarray) -> list[bytes]:
    """Distinct complete sections with a right checksum, in order."""
    found, buffer = {}, b""
    for row, at, first in zip(rows, starts, unit_start, strict=True):
        data = row[at:].tobytes()
        if first:
            skip = data[0]
            buffer += data[1 : 1 + skip]
            chunks = [buffer, data[1 + skip :]]
        else:
            chunks = [buffer + data]
        for chunk in chunks:
            while len(chunk) >= 3 and chunk[0] != 0xFF:
                size = 3 + ((chunk[1] & 15) << 8 | chunk[2])
                if len(chunk) < size:
                    break
                if section_crc(chunk[:size]) == 0:
                    found.setdefault(chunk[:size])
                chunk = chunk[size:]
            buffer = chunk if chunk[:1] != b"\xff" else b""
    return list(found)


def demux(media: bytes) -> list[Stream]:
    """Elementary streams of all programs, by PID in the order of the program map tables.

    Continuity: a packet with payload must follow its PID's last counter by one; one exact repeat
    is allowed and its payload not used twice; a packet that signals discontinuity may jump. A unit
    in which packets are lost, or that is shorter than it says, is passed on with what is there and
    its number in ``damaged``. Bytes before the first sync and an incomplete last packet are skipped.
    No tables: no streams.
    """
    data = np.frombuffer(media, np.uint8)
    start = int(np.argmax(data == SYNC)) if len(data) and (data == SYNC).any() else len(data)
    n = (len(data) - start) // PACKET
    rows = data[start : start + n * PACKET].reshape(n, PACKET)
    rows = rows[(rows[:, 0] == SYNC) & (rows[:, 1] & 0x80 == 0)] if n else rows
    if not len(rows):
        return []
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    control, counter, first = rows[:, 3] >> 4 & 3, rows[:, 3] & 15, rows[:, 1] & 0x40 != 0
    adapt = control & 2 != 0
    length = np.where(adapt, rows[:, 4].astype(np.int32), -1)
    begin = np.where(adapt, 5 + length, 4)
    flags = np.where(adapt & (length > 0), rows[:, 5], 0)
    has = (control & 1 != 0) & (begin < PACKET)

    def of(p: int) -> list[bytes]:
        mine = (pid == p) & has
        return _sections(rows[mine], begin[mine], first[mine])

    streams: dict[int, Stream] = {}
    for pat in of(PAT_PID):
        for i in range(8, len(pat) - 4, 4):
            if pat[i] << 8 | pat[i + 1]:
                for pmt in of((pat[i + 2] & 31) << 8 | pat[i + 3]):
                    at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
                    while at + 5 <= len(pmt) - 4:
                        p = (pmt[at + 1] & 31) << 8 | pmt[at + 2]
                        streams.setdefault(p, Stream(p, pmt[at]))
                        at += 5 + ((pmt[at + 3] & 15) << 8 | pmt[at + 4])
    for p, stream in streams.items():
        mine = np.flatnonzero((pid == p) & has)
        if not len(mine):
            continue
        step = np.diff(counter[mine].astype(np.int16)) % 16
        repeat = np.zeros(len(mine), bool)
        again = np.flatnonzero(step == 0) + 1
        repeat[[i for i in again if (rows[mine[i]] == rows[mine[i - 1]]).all()]] = True
        jump = flags[mine][1:] & 0x80 != 0
        lost = np.concatenate(([False], (step != 1) & ~repeat[1:] & ~jump))
        stream.continuity_errors = int(lost.sum())
        mine, lost = mine[~repeat], lost[~repeat]
        heads = np.flatnonzero(first[mine])
        parts = []
        for h, end in zip(heads, [*heads[1:], len(mine)], strict=True):
            unit = mine[h:end]
            plain = (begin[unit] == 4).nonzero()[0]
            if len(plain) >= len(unit) - 2 and len(unit) > 2 and plain[-1] - plain[0] + 1 == len(plain):
                middle = rows[unit[plain[0] : plain[-1] + 1], 4:].tobytes()
                pes = b"".join([*(rows[k, begin[k] :].tobytes() for k in unit[: plain[0]]), middle, *(rows[k, begin[k] :].tobytes() for k in unit[plain[-1] + 1 :])])
            else:
                pes = b"".join(rows[k, begin[k] :].tobytes() for k in unit)
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                continue
            size = pes[4] << 8 | pes[5]
            if lost[h + 1 : end + 1].any() or len(pes) < 6 + size:
                stream.damaged.append(stream.units)
            stream.units += 1
            if pes[7] & 0x80:
                stream.pts.append(_read_pts(pes[9:14]))
                if flags[unit[0]] & 0x40:
                    stream.random_access.append(stream.pts[-1])
            parts.append(pes[9 + pes[8] : 6 + size if size else len(pes)])
        stream.payload = b"".join(parts)
    return list(streams.values())


def padded(data: bytes, block: int = 64) -> bytes:
    """data and zero bytes up to a positive multiple of block."""
    return data + bytes(-len(data) % block or (0 if data else block))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TIMES = T.ArrayType(T.LongType())
STREAMS = T.ArrayType(_struct(pid=T.IntegerType(), stream_type=T.IntegerType(), payload=T.BinaryType(), pts=_TIMES, random_access=_TIMES, continuity_errors=T.IntegerType(), units=T.IntegerType(), damaged=T.ArrayType(T.IntegerType())))
DIGEST = _struct(
    payload_bytes=T.LongType(), payload_sha256=T.StringType(), tail_crc32=T.LongType(), media_bytes=T.LongType(), media_sha256=T.StringType(), feature=T.StringType(),
    pts=_TIMES, random_access=_TIMES, continuity_errors=T.IntegerType(), damaged_units=T.IntegerType(),
)


@F.pandas_udf(T.BinaryType())
def mux_column(payload: pd.Series) -> pd.Series:
    """A binary (or string) column as transport streams; null: an empty payload."""
    return payload.map(lambda x: mux(padded(b"" if x is None else x.encode() if isinstance(x, str) else bytes(x))))


@F.pandas_udf(STREAMS)
def demux_column(media: pd.Series) -> pd.Series:
    """The elementary streams of each transport stream; null gives none."""
    return media.map(lambda x: [vars(s) for s in demux(bytes(x))] if x is not None else [])


@F.pandas_udf(DIGEST)
def digest_column(media: pd.Series) -> pd.DataFrame:
    """What demux reads back from each transport stream: sums, a feature text, and the timestamps and
    random-access points of its units."""
    out = []
    for raw in media:
        raw = bytes(raw)
        streams = demux(raw)
        payload = b"".join(s.payload for s in streams)
        feature = ";".join(f"pid={s.pid},type={s.stream_type},units={s.units},pts={s.pts[0] if s.pts else ''}-{s.pts[-1] if s.pts else ''},rap={len(s.random_access)},cc={s.continuity_errors}" for s in streams)
        out.append((len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), f"packets={len(raw) // PACKET};{feature}"))
        out[-1] += ([t for s in streams for t in s.pts], [t for s in streams for t in s.random_access], sum(s.continuity_errors for s in streams), sum(len(s.damaged) for s in streams))
    return pd.DataFrame(out, columns=DIGEST.names)


def to_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """docs plus a column of transport streams holding the padded UTF-8 bytes of the text."""
    return docs.withColumn(media_col, mux_column(F.col(text_col)))


def read_media(df: DataFrame, media_col: str = "media", streams_col: str = "streams") -> DataFrame:
    """df plus the parsed elementary streams of a media column."""
    return df.withColumn(streams_col, demux_column(F.col(media_col)))


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the digest columns of every document.

    Null and empty texts store 64 zero bytes. Equal texts give equal values; repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty result. Writing and
    reading back run in one Python worker, batch by batch, without a shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest: Column = digest_column(mux_column(text))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("_d")).select("doc_id", "n_bytes", "_d.*")
