"""Barcodes by regular expression, fuzzy ones included, in Arrow batches.

Java's expressions have neither fuzzy matching nor the group names in use (umi_1, cell_1,
discard_1), so the matching runs in Python workers; everything around it stays in Spark, and so does
the matching where every group has a fixed width.
"""

from __future__ import annotations

from collections.abc import Callable
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH = T.StructType([T.StructField(n, t) for n, t in (("matched", T.BooleanType()), ("cell", T.StringType()), ("umi", T.StringType()), ("umi_quals", T.StringType()), ("seq", T.StringType()), ("quals", T.StringType()))])


def check_pattern(pattern: str) -> None:
    """A pattern needs a umi_ or cell_ group and no groups of other names."""
    names = regex.compile(pattern).groupindex
    if not any(n.startswith(("umi_", "cell_")) for n in names):
        raise ValueError("the expression has no umi_ or cell_ group")
    if odd := [n for n in names if not n.startswith(("umi_", "cell_", "discard_"))]:
        raise ValueError(f"unknown groups: {odd}")


def _joined(spans: list[tuple[int, int | None]]) -> Callable[[str], str]:
    """A function that joins these parts of a text."""
    parts = [slice(*x) for x in spans]
    if not parts:
        return lambda text: ""
    get = itemgetter(*parts)
    return get if len(parts) == 1 else lambda text: "".join(get(text))


def _router(compiled: regex.Pattern, retain_umi: bool) -> Callable[[regex.Match, str, str], tuple]:
    """A function (match, seq, quals) -> (cell, umi, umi_quals, seq, quals). What to cut where is
    worked out once for all matches whose groups lie at the same places."""
    names = sorted(compiled.groupindex)
    groups = [compiled.groupindex[n] for n in names]
    known: dict[tuple, tuple[Callable[[str], str], ...]] = {}

    def plan(places: tuple[tuple[int, int], ...]) -> tuple[Callable[[str], str], ...]:
        found = [(n.split("_")[0], x) for n, x in zip(names, places, strict=False) if x[0] >= 0]

        def apart(kinds: tuple[str, ...]) -> list[tuple[int, int]]:
            out: list[tuple[int, int]] = []
            for begin, end in sorted(x for kind, x in found if kind in kinds):
                begin = max(begin, out[-1][1]) if out else begin
                if begin < end:
                    out.append((begin, end))
            return out

        gone = apart(("cell", "discard") if retain_umi else ("cell", "discard", "umi"))
        stay = _joined(list(zip([0, *[e for _, e in gone]], [*[b for b, _ in gone], None], strict=True)))
        cell, umi = (_joined([x for kind, x in found if kind == k]) for k in ("cell", "umi"))
        return cell, umi, _joined(apart(("umi",))), stay

    def route(match: regex.Match, seq: str, quals: str) -> tuple:
        if len(quals) != len(seq):
            if len(quals) < len(seq):
                raise ValueError(f"qualities of another length: {seq[:40]!r}")
            quals = quals[: len(seq)]
        places = match.span(*groups, groups[0])
        if (parts := known.get(places)) is None:
            parts = known[places] = plan(places)
        cell, umi, umi_quals, stay = parts
        return cell(seq), umi(seq), umi_quals(quals), stay(seq), stay(quals)

    return route


#: A group of letters, classes of letters and dots, each with a fixed number.
_GROUP = regex.compile(r"\(\?P<(\w+)>((?:(?:\.|\[[A-Za-z]+\]|[A-Za-z])(?:\{\d+\})?)*)\)")
_ATOM = regex.compile(r"(\.|\[[A-Za-z]+\]|[A-Za-z])(?:\{(\d+)\})?")


def fixed_layout(pattern: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """(the same in Java's syntax, where each group begins and ends) of an expression that is nothing
    but named groups of fixed width, None of any other."""
    java, places, at, end = r"\A", {}, 0, 0
    while m := _GROUP.match(pattern, at):
        begin, at = end, m.end()
        for atom, many in _ATOM.findall(m[2]):
            java += ("[^\n]" if atom == "." else atom) + f"{{{int(many or 1)}}}"
            end += int(many or 1)
        if m[1] in places:
            return None
        places[m[1]] = begin, end
    return (java, places) if at == len(pattern) else None


def _fixed_extract(java: str, places: dict[str, tuple[int, int]], retain_umi: bool) -> Callable[[Column, Column], Column]:
    """regex_extract of a fixed layout, by Spark's own functions."""
    part = lambda kind: [places[n] for n in sorted(places) if n.startswith(kind)]
    width = max(end for _, end in places.values())
    gone = sorted(x for kind in (("cell_", "discard_") if retain_umi else ("cell_", "discard_", "umi_")) for x in part(kind))
    stay = [(a, b) for a, b in zip([0, *[e for _, e in gone]], [*[b for b, _ in gone], width], strict=True) if a < b]

    def extract(seq: Column, quals: Column) -> Column:
        cut = lambda text, spans: F.concat(F.lit(""), *[F.substring(text, a + 1, b - a) for a, b in spans])
        rest = lambda text: F.concat(cut(text, stay), F.substring(text, F.lit(width + 1), F.length(seq)))
        long = F.when(F.length(quals) >= F.length(seq), F.substring(quals, F.lit(1), F.length(seq))).otherwise(F.raise_error(F.concat(F.lit("qualities of another length: "), seq)).cast("string"))
        values = {"matched": F.lit(True), "cell": cut(seq, part("cell_")), "umi": cut(seq, part("umi_")), "umi_quals": cut(long, sorted(part("umi_"))), "seq": rest(seq), "quals": rest(long)}
        none = F.struct(*[F.lit(False if f.name == "matched" else None).cast(f.dataType).alias(f.name) for f in MATCH])
        return F.when(seq.rlike(java), F.struct(*[c.alias(n) for n, c in values.items()])).otherwise(none)

    return extract


def regex_extract(pattern: str, retain_umi: bool = False) -> Callable[[Column, Column], Column]:
    """A column function (seq, quals) -> struct(matched, cell, umi, umi_quals, seq, quals).

    The expression matches at the start of the read. Bases of cell, umi and discard groups leave
    it (umi bases stay with retain_umi); barcodes join their groups in the order of their names,
    qualities in the order of the read. Groups that took no part are skipped; no match: nulls.
    Expressions of fixed width run in Spark's generated code, others in Python.
    """
    check_pattern(pattern)
    if layout := fixed_layout(pattern):
        return _fixed_extract(*layout, retain_umi)

    @F.arrow_udf(MATCH)
    def extract(seq: pa.Array, quals: pa.Array) -> pa.Array:
        compiled = regex.compile(pattern)
        match, route = compiled.match, _router(compiled, retain_umi)
        none, matched, rows = (None,) * 5, [], []
        for s, q in zip(seq.to_pylist(), quals.to_pylist(), strict=True):
            m = match(s) if s is not None else None
            matched.append(m is not None)
            rows.append(none if m is None else route(m, s, q))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.StructArray.from_arrays([pa.array(matched, pa.bool_()), *[pa.array(c, pa.string()) for c in columns]], names=[f.name for f in MATCH])

    return extract


def either_read(found1: Column, found2: Column, seq1: Column, quals1: Column, seq2: Column, quals2: Column, resolve: str = "discard", offset: int = 33) -> Column:
    """struct(event, cell, umi, umi_quals, seq1, quals1, seq2, quals2) where the barcode may be on
    either read. Both match: discard, or use the read whose worst UMI base is better (read 1 if
    equal); then neither sequence is trimmed. Null event parts: no match or discarded."""
    if resolve not in ("discard", "quality"):
        raise ValueError("resolve must be discard or quality")
    worst = lambda m: F.array_min(F.transform(F.split(m["umi_quals"], ""), lambda q: F.ascii(q) - offset))
    both, one, two = found1["matched"] & found2["matched"], found1["matched"], found2["matched"]
    first = worst(found1) >= worst(found2)
    event = (
        F.when(both, F.lit("regex matches both. discarded") if resolve == "discard" else F.when(first, "regex matches both. read1 used").otherwise("regex matches both. read2 used"))
        .when(one, "regex only matches read1")
        .when(two, "regex only matches read2")
        .otherwise("regex does not match")
    )
    use1 = F.when(both, first if resolve == "quality" else F.lit(None).cast("boolean")).when(one, True).when(two, False)
    pick = lambda name: F.when(use1, found1[name]).when(~use1, found2[name])
    trimmed = lambda m, name, raw, other: F.when(both & use1.isNotNull(), raw).when(use1.isNotNull(), F.when(other["matched"] & ~m["matched"], raw).otherwise(m[name]))
    return F.struct(
        event.alias("event"), pick("cell").alias("cell"), pick("umi").alias("umi"), pick("umi_quals").alias("umi_quals"),
        trimmed(found1, "seq", seq1, found2).alias("seq1"), trimmed(found1, "quals", quals1, found2).alias("quals1"),
        trimmed(found2, "seq", seq2, found1).alias("seq2"), trimmed(found2, "quals", quals2, found1).alias("quals2"),
    )
