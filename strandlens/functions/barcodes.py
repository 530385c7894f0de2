"""Barcodes from read names, tags and sequences: column expressions, evaluated inside Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lowest and highest character code of each quality encoding.
PHRED = {"phred33": (33, 77), "solexa": (59, 106), "phred64": (64, 106)}


def from_read_id(name: Column, separator: str = "_", cell: bool = False) -> Column:
    """struct(umi, cell): the last part of the name and, if asked for, the one before it."""
    parts = F.split(name, re.escape(separator))
    return F.struct(F.element_at(parts, -1).alias("umi"), (F.try_element_at(parts, F.lit(-2)) if cell else F.lit(None).cast("string")).alias("cell"))


def hashed_number(*parts: Column) -> Column:
    """A number of 52 bits from the md5 of the parts joined by |, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def _tag(tags: Column, tag: str | None, split: str | None, delimiter: str | None) -> Column:
    if tag is None:
        return F.lit(None).cast("string")
    value = F.try_element_at(tags, F.lit(tag))
    if split:
        value = F.substring_index(value, split, 1)
    if delimiter:
        value = F.replace(value, F.lit(delimiter), F.lit(""))
    return value


def from_tags(tags: Column, umi_tag: str = "RX", cell_tag: str | None = None, umi_split: str | None = None, umi_delimiter: str | None = None, cell_split: str | None = "-", cell_delimiter: str | None = None) -> Column:
    """struct(umi, cell) from a map of tags: the part before a split sign, without delimiters. A
    missing tag gives null."""
    return F.struct(_tag(tags, umi_tag, umi_split, umi_delimiter).alias("umi"), _tag(tags, cell_tag, cell_split, cell_delimiter).alias("cell"))


def from_prefixed_id(name: Column, cell: bool = False) -> Column:
    """struct(umi, cell) of a name whose parts between colons start with UMI_ and CELL_; the last
    such part counts."""

    def part(prefix: str) -> Column:
        hits = F.filter(F.split(name, ":"), lambda x: x.startswith(prefix))
        return F.substring(F.try_element_at(hits, F.lit(-1)), len(prefix) + 1, 1_000_000)

    return F.struct(part("UMI_").alias("umi"), (part("CELL_") if cell else F.lit(None).cast("string")).alias("cell"))


@dataclass(frozen=True)
class Pattern:
    """A barcode pattern of N (UMI), C (cell) and X (kept) bases at the read's 5' or 3' end."""

    text: str
    three_prime: bool = False

    def __post_init__(self) -> None:
        if not self.text or set(self.text) - set("NCX"):
            raise ValueError(f"a pattern has only the letters N, C and X: {self.text!r}")

    def _runs(self, letter: str) -> list[tuple[int, int]]:
        at, runs = 1, []
        for base, group in groupby(self.text):
            n = len(list(group))
            if base == letter:
                runs.append((at, n))
            at += n
        return runs

    def ends(self, s: Column) -> tuple[Column, Column]:
        """The bases under the pattern and the others."""
        n = len(self.text)
        if self.three_prime:
            return F.right(s, F.lit(n)), F.substring(s, F.lit(1), F.greatest(F.length(s) - n, F.lit(0)))
        return F.substring(s, 1, n), F.substring(s, n + 1, 1_000_000_000)

    def bases(self, s: Column, letter: str) -> Column:
        """The pattern's bases of a letter, from neighbouring runs."""
        under, _ = self.ends(s)
        return F.concat(F.lit(""), *[F.substring(under, at, n) for at, n in self._runs(letter)])

    def rest(self, s: Column) -> Column:
        """What stays of the read: bases outside the pattern, with the X bases on their side."""
        _, others = self.ends(s)
        kept = self.bases(s, "X")
        return F.concat(others, kept) if self.three_prime else F.concat(kept, others)


def extract(seq: Column, quals: Column, pattern: Pattern) -> Column:
    """struct(cell, umi, umi_quals, seq, quals, long_enough)."""
    return F.struct(
        pattern.bases(seq, "C").alias("cell"),
        pattern.bases(seq, "N").alias("umi"),
        pattern.bases(quals, "N").alias("umi_quals"),
        pattern.rest(seq).alias("seq"),
        pattern.rest(quals).alias("quals"),
        (F.length(seq) >= len(pattern.text)).alias("long_enough"),
    )


def extract_pair(seq1: Column, quals1: Column, seq2: Column, quals2: Column, pattern1: Pattern | None, pattern2: Pattern | None) -> Column:
    """struct(cell, umi, umi_quals, seq1, quals1, seq2, quals2): barcodes of read 1, then of read 2;
    a read without a pattern stays as it is."""
    none = F.lit("")

    def of(kind: str) -> Column:
        parts = []
        for pattern, seq, quals in ((pattern1, seq1, quals1), (pattern2, seq2, quals2)):
            if pattern:
                parts.append(pattern.bases(quals, "N") if kind == "umi_quals" else pattern.bases(seq, {"cell": "C", "umi": "N"}[kind]))
        return F.concat(none, *parts)

    kept = [p.rest(s) if p else s for p, s in ((pattern1, seq1), (pattern1, quals1), (pattern2, seq2), (pattern2, quals2))]
    return F.struct(*[of(k).alias(k) for k in ("cell", "umi", "umi_quals")], *[k.alias(n) for k, n in zip(kept, ("seq1", "quals1", "seq2", "quals2"), strict=True)])


def rewritten_id(identifier: Column, umi: Column, cell: Column | None = None, separator: str = "_") -> Column:
    """The identifier with barcodes after its first word."""
    added = [F.lit(separator), cell, F.lit(separator), umi] if cell is not None else [F.lit(separator), umi]
    first = F.regexp_extract(identifier, r"^(\S*)", 1)
    return F.concat(first, *added, F.substring(identifier, F.length(first) + 1, F.lit(1_000_000_000)))


def without_pair_suffix(identifier: Column) -> Column:
    """The identifier without /1 or /2 at the end of its first word; an error where it has none."""
    ok = identifier.rlike(r"^\S+/[12](?=\s|$)")
    stripped = F.regexp_replace(identifier, r"^(\S+)/[12](?=\s|$)", "$1")
    return F.when(ok, stripped).otherwise(F.raise_error(F.concat(F.lit("no /1 or /2 suffix: "), identifier)).cast("string"))


def qualities(quals: Column, encoding: str = "phred33") -> Column:
    """Quality numbers of a quality string."""
    return F.transform(F.split(quals, ""), lambda q: F.ascii(q) - PHRED[encoding][0])


def low_quality(umi_quals: Column, threshold: int, encoding: str = "phred33") -> Column:
    """Whether any base is below the threshold."""
    return (umi_quals != "") & F.exists(qualities(umi_quals, encoding), lambda q: q < threshold)


def masked(umi: Column, umi_quals: Column, threshold: int, encoding: str = "phred33") -> Column:
    """The UMI with N for each base below the threshold."""
    return F.array_join(F.zip_with(F.split(umi, ""), qualities(umi_quals, encoding), lambda b, q: F.when(q < threshold, "N").otherwise(b)), "")


def possible_encodings(quals: Column) -> Column:
    """The encodings, by name, whose range holds all characters."""
    codes = F.transform(F.split(quals, ""), lambda q: F.ascii(q))
    fits = [F.when((F.array_min(codes) >= low) & (F.array_max(codes) < high), F.lit(name)) for name, (low, high) in sorted(PHRED.items())]
    return F.array_compact(F.array(*fits))


def with_tags(tags: Column, **values: Column) -> Column:
    """The tags with some set anew."""
    named = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_concat(F.map_filter(tags, lambda k, _: ~k.isin(*values)), named)


def copied_tags(target: Column, source: Column, names: list[str]) -> Column:
    """target's tags with those of the given names from source, where source has them."""
    taken = F.map_filter(source, lambda k, _: k.isin(*names))
    return F.map_concat(F.map_filter(target, lambda k, _: ~F.array_contains(F.map_keys(taken), k)), taken)
