"""An extension: first reads of molecules from a stream of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import GroupingOptions
from ..operators.bundles import classified, keyed


def first_reads(stream: DataFrame, options: GroupingOptions, time: str, lateness: str = "10 minutes") -> DataFrame:
    """The first read of every bundle and barcode, by exact barcode, within the watermark: state is
    dropped once the event time has moved on by the lateness, and later reads count anew."""
    kept, keys = keyed(classified(stream, options), options)
    return kept.withWatermark(time, lateness).dropDuplicatesWithinWatermark([*keys, "umi"])
