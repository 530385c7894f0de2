"""Pairs of alignments of one template: each alignment beside a mate, for tools that need both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.barcodes import copied_tags


def template_pairs(reads: DataFrame, tags: tuple[str, ...] = ("UG", "BX")) -> DataFrame:
    """read1, read2 (structs of the alignments' columns): distinct pairs of each template.

    A mate stands where the read points to, on the other read of the pair. Of several candidates
    those of the opposite secondary status come before the others, then those that point back, of
    these the last in file order (``ord``), of the others the first. A secondary read makes its mate
    secondary; the given tags are copied from read 1 to read 2. Reads without a mate are left out.
    """
    columns = [c for c in reads.columns if c != "ord"]
    contig = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
    side = F.col("flag").bitwiseAND(0x40) != 0
    rows = reads.where(F.col("flag").bitwiseAND(0xC0) != 0).withColumns({"_first": side, "_to": contig, "_secondary": F.col("flag").bitwiseAND(0x100) != 0})
    one = rows.select("qname", "_first", "_secondary", "ord", F.struct(*columns).alias("read"), F.col("_to").alias("to"), F.col("pnext").alias("to_pos"))
    two = rows.select(F.col("qname").alias("mq"), F.col("_first").alias("mf"), F.col("_secondary").alias("ms"), F.col("ord").alias("mo"), F.struct(*columns).alias("mate"), F.col("_to").alias("back"), F.col("pnext").alias("back_pos"))
    on = (F.col("qname") == F.col("mq")) & (F.col("_first") != F.col("mf")) & (F.col("to") == F.col("mate.rname")) & (F.col("to_pos") == F.col("mate.pos"))
    answers = (F.col("back") == F.col("read.rname")) & (F.col("back_pos") == F.col("read.pos"))
    rank = Window.partitionBy("qname", "ord").orderBy((F.col("_secondary") == F.col("ms")).asc(), answers.desc(), F.when(answers, -F.col("mo")).otherwise(F.col("mo")))
    best = one.join(two, on).withColumn("_rank", F.row_number().over(rank)).where("_rank = 1")
    flag = F.when(F.col("_secondary"), F.col("mate.flag").bitwiseOR(0x100)).otherwise(F.col("mate.flag"))
    mate = F.col("mate").withField("flag", flag.cast(reads.schema["flag"].dataType))
    first = F.when(F.col("_first"), F.col("read")).otherwise(mate)
    second = F.when(F.col("_first"), mate).otherwise(F.col("read"))
    pairs = best.select(first.alias("read1"), second.alias("read2"))
    if "tags" in columns:
        pairs = pairs.withColumn("read2", F.col("read2").withField("tags", copied_tags(F.col("read2.tags"), F.col("read1.tags"), list(tags))))
    text = F.to_json(F.struct("read1", "read2"))
    return pairs.withColumn("_text", text).dropDuplicates(["_text"]).drop("_text")
