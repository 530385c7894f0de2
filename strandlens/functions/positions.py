"""Read positions from CIGAR strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cigar_parts(cigar: Column) -> Column:
    """array<struct<op, n>> of a CIGAR string; empty where it has no operations."""
    op, n = F.split(_ops(cigar), ""), F.split(F.translate(cigar, "MIDNSHP=X", "," * 9), ",")
    return F.filter(F.zip_with(op, F.slice(n, F.lit(1), F.size(op)), lambda o, k: F.struct(o.alias("op"), k.try_cast("int").alias("n"))), lambda p: p["n"].isNotNull())


def _ops(cigar: Column) -> Column:
    """The operations' letters."""
    return F.translate(cigar, "0123456789", "")


def _sum(parts: Column, ops: str) -> Column:
    return F.aggregate(F.filter(parts, lambda p: p["op"].isin(*ops)), F.lit(0), lambda s, p: s + p["n"])


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def reference_end(pos: Column, parts: Column) -> Column:
    """0-based end, exclusive."""
    return pos + _sum(parts, "MDN=X")


def _clip(part: Column) -> Column:
    return F.when(part["op"] == "S", part["n"]).otherwise(0)


def splice_offset(parts: Column) -> Column:
    """Reference bases from the 5' end to the first skip, or soft clip after the start; a clip at
    the start counts as bases. Null if there is none. parts are in the direction of the read."""
    lead = _clip(F.get(parts, F.lit(0)))
    rest = F.when(lead > 0, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    start = F.struct(lead.cast("int").alias("n"), F.lit(False).alias("found"))

    def step(acc: Column, p: Column) -> Column:
        here = acc["found"] | p["op"].isin("N", "S")
        return F.struct((acc["n"] + F.when(~here & p["op"].isin("M", "D", "=", "X"), p["n"]).otherwise(0)).alias("n"), here.alias("found"))

    return F.aggregate(rest, start, step, lambda acc: F.when(acc["found"], acc["n"]))


def read_position(pos: Column, reverse: Column, cigar: Column, soft_clip_threshold: float = 4) -> Column:
    """struct(start, pos, splice): where the read begins in its own direction, clipped bases
    included. splice is the offset of the first skip if the read has one, or is clipped at its 3'
    end by more than the threshold; else null. A read without operations (null, empty, *) begins at
    pos.

    Most reads match in one piece or are clipped at an end: those take expressions of generated
    code alone, and only the others' operations are taken apart.
    """
    ops, parts, none = _ops(cigar), cigar_parts(cigar), F.lit(0)
    plain = ops.isin("M", "SM", "MS", "SMS")
    matched = _number(F.substring_index(F.substring_index(cigar, "M", 1), "S", -1))
    first = F.when(ops.startswith("S"), _number(F.substring_index(cigar, "S", 1))).otherwise(none)
    after_match = _number(F.substring_index(F.substring_index(cigar, "M", -1), "S", 1))
    last = F.when(ops.endswith("MS"), after_match).when(ops.endswith("S"), _clip(F.try_element_at(parts, F.lit(-1)))).otherwise(none)
    ahead = pos - first
    behind = F.when(plain, pos + matched).otherwise(reference_end(pos, parts)) + last
    end_clip = F.when(reverse, first).otherwise(last)
    spliced = cigar.contains("N") | (end_clip > soft_clip_threshold)
    offset = F.when(plain, F.when(end_clip > 0, F.when(reverse, last).otherwise(first) + matched)).otherwise(splice_offset(F.when(reverse, F.reverse(parts)).otherwise(parts)))
    return F.struct(F.when(reverse, pos).otherwise(ahead).alias("start"), F.when(reverse, F.coalesce(behind, pos)).otherwise(ahead).alias("pos"), F.when(spliced, offset).alias("splice"))
