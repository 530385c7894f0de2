"""Queries of the molecular-barcode engine, one per operator, and the same in plain SQL.

Each query runs an operator of the library over the synthetic views of plans/reads.py; its SQL says
independently what must come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExtractOptions, GroupingOptions, WhitelistOptions
from ..functions import barcodes as bc
from ..functions import distance as ds
from ..functions.positions import read_position
from ..operators import bundles, extract, molecules, pairs, stats, whitelist
from ..operators.cluster import UMIClusterer, cluster
from ..operators.order import numbered, numbered_lines
from ..session import scratch
from ..sources import alignments as al
from ..sources import fastq, tables
from ..sources.tables import products
from .reads import ALIGNMENTS, READS, RECORDS, alignments, reads, records, tagged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- pieces of SQL ----------------------------------------------------------------------------

_R = f"r AS ({READS})"
_Q = f"q AS ({RECORDS})"
_A = f"a AS ({ALIGNMENTS})"


def _nodes(keys: str, source: str = "r") -> str:
    return f"nodes AS (SELECT {keys}, umi, CAST(count(*) AS BIGINT) AS n FROM {source} GROUP BY ALL)"


def _edges(keys: str, threshold: int = 1, gate: bool = True) -> str:
    extra = " AND a.n >= 2 * b.n - 1" if gate else ""
    return f"edges AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.umi AS u, b.umi AS v FROM nodes a JOIN nodes b USING ({keys}) WHERE a.umi <> b.umi AND hamming(a.umi, b.umi) <= {threshold}{extra})"


def _labels(keys: str) -> str:
    """lab: each barcode with the first, by count and letters, that reaches it."""
    r = ", ".join("p." + k.strip() for k in keys.split(","))
    return f"""reach AS (SELECT {keys}, umi AS src, umi AS dst FROM nodes UNION SELECT {r}, p.src, e.v FROM reach p JOIN edges e USING ({keys}) WHERE e.u = p.dst),
lab AS (SELECT {keys}, umi, n, rep FROM (SELECT {', '.join('x.' + k.strip() for k in keys.split(','))}, x.dst AS umi, m.n, x.src AS rep,
  row_number() OVER (PARTITION BY {', '.join('x.' + k.strip() for k in keys.split(','))}, x.dst ORDER BY s.n DESC, x.src) AS k
  FROM reach x JOIN nodes s ON {' AND '.join(f's.{k.strip()} = x.{k.strip()}' for k in keys.split(','))} AND s.umi = x.src JOIN nodes m ON {' AND '.join(f'm.{k.strip()} = x.{k.strip()}' for k in keys.split(','))} AND m.umi = x.dst) WHERE k = 1)"""


def _directional(keys: str, threshold: int = 1, source: str = "r") -> str:
    return ", ".join((_nodes(keys, source), _edges(keys, threshold), _labels(keys)))


_CG = "contig, gene"
_CP = "contig, pos, is_reverse"
_CGC = "contig, gene, cell"


def _counts(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    return bundles.umi_counts(reads(spark, sf_dir), keys)


def _clustered(spark: SparkSession, sf_dir: str, method: str, threshold: int = 1, path: str = "auto") -> DataFrame:
    return cluster(_counts(spark, sf_dir, ["contig", "gene"]), ["contig", "gene"], method, threshold, path)


# --- barcodes from names and sequences --------------------------------------------------------


@query(f"WITH {_R} SELECT concat(read_id, '_', cell, '_', umi) AS name, umi, cell FROM r")
def umi_from_read_id(spark, sf_dir):
    name = F.concat_ws("_", "read_id", "cell", "umi").alias("name")
    return reads(spark, sf_dir).select(name).select("name", bc.from_read_id(F.col("name"), "_", cell=True).alias("b")).select("name", "b.*")


@query(f"WITH {_R} SELECT read_id, umi, cell FROM r")
def umi_from_tag(spark, sf_dir):
    tags = F.create_map(F.lit("RX"), F.concat(F.substring("umi", 1, 2), F.lit("."), F.substring("umi", 3, 2), F.lit(":x")), F.lit("CB"), F.concat("cell", F.lit("-1")))
    return reads(spark, sf_dir).select("read_id", bc.from_tags(tags, "RX", "CB", umi_split=":", umi_delimiter=".").alias("b")).select("read_id", "b.*")


@query(f"WITH {_R} SELECT concat(read_id, ':CELL_', cell, ':UMI_', umi, ':SAMPLE_1') AS name, umi, cell FROM r")
def umi_from_prefixed_id(spark, sf_dir):
    name = F.concat("read_id", F.lit(":CELL_"), "cell", F.lit(":UMI_"), "umi", F.lit(":SAMPLE_1")).alias("name")
    return reads(spark, sf_dir).select(name).select("name", bc.from_prefixed_id(F.col("name"), cell=True).alias("b")).select("name", "b.*")


@query(f"""WITH {_Q} SELECT read_id, substr(seq, 6, 2) AS cell, concat(substr(seq, 1, 3), substr(seq, 8, 2)) AS umi, concat(substr(quals, 1, 3), substr(quals, 8, 2)) AS umi_quals,
concat(substr(seq, 4, 2), substr(seq, 10)) AS seq, concat(substr(quals, 4, 2), substr(quals, 10)) AS quals, true AS long_enough FROM q""")
def pattern_extract_5p(spark, sf_dir):
    return records(spark, sf_dir).select("read_id", bc.extract(F.col("seq"), F.col("quals"), bc.Pattern("NNNXXCCNN")).alias("found")).select("read_id", "found.*")


@query(f"""WITH {_Q} SELECT read_id, substr(seq, 25, 4) AS cell, substr(seq, 29, 4) AS umi, substr(quals, 29, 4) AS umi_quals, concat(substr(seq, 1, 22), substr(seq, 23, 2)) AS seq,
concat(substr(quals, 1, 22), substr(quals, 23, 2)) AS quals, true AS long_enough FROM q""")
def pattern_extract_3p(spark, sf_dir):
    return records(spark, sf_dir).select("read_id", bc.extract(F.col("seq"), F.col("quals"), bc.Pattern("XXCCCCNNNN", three_prime=True)).alias("found")).select("read_id", "found.*")


@query(f"""WITH {_Q} SELECT read_id, substr(seq, 1, 4) AS cell, concat(substr(seq, 5, 3), substr(reverse(seq), 1, 5)) AS umi, concat(substr(quals, 5, 3), substr(reverse(quals), 1, 5)) AS umi_quals,
substr(seq, 8) AS seq1, substr(quals, 8) AS quals1, substr(reverse(seq), 6) AS seq2, substr(reverse(quals), 6) AS quals2 FROM q""")
def pattern_extract_paired(spark, sf_dir):
    x = bc.extract_pair(F.col("seq"), F.col("quals"), F.reverse("seq"), F.reverse("quals"), bc.Pattern("CCCCNNN"), bc.Pattern("NNNNN"))
    return records(spark, sf_dir).select("read_id", x.alias("found")).select("read_id", "found.*")


@query(f"WITH {_Q} SELECT read_id, concat(read_id, '_', substr(seq, 1, 4), '_', substr(seq, 5, 6), substr(identifier, length(read_id) + 1)) AS identifier FROM q")
def identifier_rewrite(spark, sf_dir):
    return records(spark, sf_dir).select("read_id", bc.rewritten_id(F.col("identifier"), F.substring("seq", 5, 6), F.substring("seq", 1, 4)).alias("identifier"))


@query(f"WITH {_Q} SELECT read_id, concat(read_id, substr(identifier, length(read_id) + 1)) AS identifier FROM q")
def pair_suffix_strip(spark, sf_dir):
    marked = F.concat("read_id", F.lit("/1"), F.substring("identifier", F.length("read_id") + 1, F.lit(1000)))
    return records(spark, sf_dir).select("read_id", bc.without_pair_suffix(marked).alias("identifier"))


@query(f"WITH {_Q} SELECT read_id, len(list_filter(string_split(substr(quals, 1, 6), ''), lambda x: ascii(x) - 33 < 10)) > 0 AS low FROM q")
def quality_filter(spark, sf_dir):
    return records(spark, sf_dir).select("read_id", bc.low_quality(F.substring("quals", 1, 6), 10).alias("low"))


@query(f"""WITH {_Q} SELECT read_id, array_to_string(list_transform(range(1, 7), lambda i: CASE WHEN ascii(substr(quals, i::INT, 1)) - 33 < 10 THEN 'N' ELSE substr(seq, i::INT, 1) END), '') AS umi FROM q""")
def quality_mask(spark, sf_dir):
    return records(spark, sf_dir).select("read_id", bc.masked(F.substring("seq", 1, 6), F.substring("quals", 1, 6), 10).alias("umi"))


@query(f"""WITH {_Q}, c AS (SELECT read_id, list_min(list_transform(string_split(quals, ''), lambda x: ascii(x))) AS lo, list_max(list_transform(string_split(quals, ''), lambda x: ascii(x))) AS hi FROM q)
SELECT read_id, concat_ws(',', CASE WHEN lo >= 33 AND hi < 77 THEN 'phred33' END, CASE WHEN lo >= 64 AND hi < 106 THEN 'phred64' END, CASE WHEN lo >= 59 AND hi < 106 THEN 'solexa' END) AS encodings FROM c""")
def quality_format_guess(spark, sf_dir):
    return records(spark, sf_dir).select("read_id", F.array_join(bc.possible_encodings(F.col("quals")), ",").alias("encodings"))


@query(f"""WITH {_Q}, m AS (SELECT *, hamming(substr(seq, 5, 4), 'ACGT') <= 2 AS matched FROM q)
SELECT read_id, matched, {', '.join(f"CASE WHEN matched THEN {x} END AS {c}" for c, x in (("cell", "substr(seq, 1, 4)"), ("umi", "substr(seq, 9, 6)"), ("umi_quals", "substr(quals, 9, 6)"), ("seq", "substr(seq, 15)"), ("quals", "substr(quals, 15)")))} FROM m""")
def regex_extract_fuzzy(spark, sf_dir):
    from ..functions.patterns import regex_extract

    found = regex_extract(r"(?P<cell_1>.{4})(?P<discard_1>(?:ACGT){s<=2})(?P<umi_1>.{6})")(F.col("seq"), F.col("quals"))
    return records(spark, sf_dir).select("read_id", found.alias("found")).select("read_id", "found.*")


@query(f"""WITH {_Q} SELECT read_id, substr(seq, 2, 4) AS cell, substr(seq, 6, 5) AS umi, substr(seq, 13) AS seq FROM q WHERE substr(seq, 1, 1) IN ('A', 'C')""")
def regex_extract_exact(spark, sf_dir):
    from ..functions.patterns import regex_extract

    found = regex_extract(r"(?P<discard_1>[AC])(?P<cell_1>.{4})(?P<umi_1>.{5})(?P<discard_2>.{2})")(F.col("seq"), F.col("quals"))
    return records(spark, sf_dir).select("read_id", found.alias("m")).where("m.matched").select("read_id", "m.cell", "m.umi", "m.seq")


@query(f"""WITH {_Q}, m AS (SELECT read_id, seq, reverse(seq) AS seq2, substr(seq, 1, 1) = 'A' AS one, substr(reverse(seq), 1, 1) = 'A' AS two FROM q)
SELECT read_id, CASE WHEN one AND two THEN 'regex matches both. discarded' WHEN one THEN 'regex only matches read1' WHEN two THEN 'regex only matches read2' ELSE 'regex does not match' END AS event,
CASE WHEN one AND two THEN NULL WHEN one THEN substr(seq, 2, 6) WHEN two THEN substr(seq2, 2, 6) END AS umi FROM m""")
def either_read(spark, sf_dir):
    from ..functions.patterns import either_read as either
    from ..functions.patterns import regex_extract

    found = regex_extract(r"(?P<discard_1>A)(?P<umi_1>.{6})")
    rows = records(spark, sf_dir).select("read_id", "seq", "quals", F.reverse("seq").alias("seq2"), F.reverse("quals").alias("quals2"))
    rows = rows.withColumns({"m1": found(F.col("seq"), F.col("quals")), "m2": found(F.col("seq2"), F.col("quals2"))})
    x = either(F.col("m1"), F.col("m2"), F.col("seq"), F.col("quals"), F.col("seq2"), F.col("quals2"))
    return rows.select("read_id", x.alias("x")).select("read_id", "x.event", "x.umi")


# --- distances --------------------------------------------------------------------------------


@query(f"WITH {_R}, {_nodes(_CG)} SELECT a.contig, a.gene, a.umi AS a, b.umi AS b, CAST(hamming(a.umi, b.umi) AS INT) AS distance FROM nodes a JOIN nodes b USING (contig, gene) WHERE a.umi < b.umi AND hamming(a.umi, b.umi) <= 1")
def hamming_pairs(spark, sf_dir):
    return ds.near_pairs(_counts(spark, sf_dir, ["contig", "gene"]), ["contig", "gene"], "umi", 1, length=4)


@query(f"WITH {_R}, {_nodes(_CG)} SELECT a.contig, a.gene, a.umi AS a, b.umi AS b, CAST(hamming(a.umi, b.umi) AS INT) AS distance FROM nodes a JOIN nodes b USING (contig, gene) WHERE a.umi < b.umi AND hamming(a.umi, b.umi) <= 2")
def hamming_slice_join(spark, sf_dir):
    return ds.near_pairs(_counts(spark, sf_dir, ["contig", "gene"]), ["contig", "gene"], "umi", 2)


@query(f"""WITH {_R}, {_nodes(_CG)}, p AS (SELECT a.contig, a.gene, avg(CAST(hamming(a.umi, b.umi) AS DOUBLE)) AS d FROM nodes a JOIN nodes b USING (contig, gene) WHERE a.umi < b.umi GROUP BY ALL)
SELECT g.contig, g.gene, round(coalesce(p.d, -1), 6) AS distance FROM (SELECT DISTINCT contig, gene FROM nodes) g LEFT JOIN p USING (contig, gene)""")
def avg_umi_distance(spark, sf_dir):
    return ds.mean_distance(_counts(spark, sf_dir, ["contig", "gene"]), ["contig", "gene"]).select("contig", "gene", F.round("distance", 6).alias("distance"))


_LIST = "w AS (SELECT DISTINCT translate(substr(md5(cast(p_partkey % 60 as varchar)),1,5),'0123456789abcdef','ACGTACGTACGTACGT') AS barcode FROM part)"


def _listed(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.translate(F.substring(F.md5((F.col("p_partkey") % 60).cast("string")), 1, 5), "0123456789abcdef", "ACGTACGTACGTACGT").alias("barcode")).distinct()


_SEEN = "s AS (SELECT translate(substr(md5(cast(o_orderkey % 3000 as varchar)),1,5),'0123456789abcdef','ACGTACGTACGTACGT') AS cell, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL)"


def _seen(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cell = F.translate(F.substring(F.md5((F.col("o_orderkey") % 3000).cast("string")), 1, 5), "0123456789abcdef", "ACGTACGTACGTACGT").alias("cell")
    return orders.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LIST}, e AS (SELECT DISTINCT barcode, concat(substr(barcode, 1, i::INT - 1), b, substr(barcode, i::INT + 1)) AS error FROM w, range(1, 6) AS p(i), unnest(['A','C','G','T','N']) AS x(b))
SELECT error, CASE WHEN count(DISTINCT barcode) = 1 THEN min(barcode) END AS barcode FROM e WHERE error NOT IN (SELECT barcode FROM w) GROUP BY error""")
def error_neighbours(spark, sf_dir):
    return ds.error_neighbours(_listed(spark, sf_dir))


@query(f"WITH {_LIST}, {_SEEN} SELECT cell, min(barcode) AS barcode FROM s JOIN w ON hamming(cell, barcode) <= 1 WHERE cell NOT IN (SELECT barcode FROM w) GROUP BY cell HAVING count(*) = 1")
def whitelist_unique_match(spark, sf_dir):
    return ds.unique_near(_seen(spark, sf_dir), _listed(spark, sf_dir))


@query(f"""WITH {_LIST}, t AS (SELECT DISTINCT translate(substr(md5(cast(s_suppkey as varchar)),1,6),'0123456789abcdef','ACGTACGTACGTACGT') AS target FROM supplier)
SELECT barcode, target, len(list_filter(range(4, 7), lambda k: levenshtein(barcode, substr(target, 1, k::INT)) <= 1)) > 0 AS fits FROM w, t""")
def fuzzy_prefix_match(spark, sf_dir):
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    targets = supplier.select(F.translate(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 6), "0123456789abcdef", "ACGTACGTACGTACGT").alias("target")).distinct()
    words = sorted(r[0] for r in _listed(spark, sf_dir).collect())  # at most 60 barcodes
    both = targets.select("target", F.explode(F.array(*[F.lit(w) for w in words])).alias("barcode"))
    return both.select("barcode", "target", ds.matches_prefix(F.col("barcode"), F.col("target"), 1).alias("fits"))


# --- filters, positions, bundles --------------------------------------------------------------

_TAGGED = GroupingOptions(extract_umi_method="tag", per_gene=True, gene_tag="XF", mapping_quality=10, paired=True, chimeric_pairs="discard", unpaired_reads="discard")


@query(f"""WITH {_A} SELECT event, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN flag & 128 <> 0 THEN 'read 2' WHEN flag & 1 = 0 THEN 'unpaired' WHEN flag & 4 <> 0 AND flag & 8 <> 0 THEN 'both unmapped'
WHEN flag & 4 <> 0 THEN 'read 1 unmapped' WHEN flag & 8 <> 0 THEN 'read 2 unmapped' WHEN rnext <> contig THEN 'chimeric pair' WHEN mapq < 10 THEN 'low mapping quality' WHEN umi IS NULL THEN 'no umi or cell'
WHEN gene IS NULL THEN 'no gene tag' WHEN gene = '' THEN 'empty gene' WHEN gene LIKE '\\_\\_%' ESCAPE '\\' THEN 'skipped gene' ELSE 'kept' END AS event FROM a) GROUP BY event""")
def filter_events(spark, sf_dir):
    return bundles.event_counts(bundles.classified(alignments(spark, sf_dir), _TAGGED))


@query(f"WITH {_A} SELECT gene, CAST(count(*) AS BIGINT) AS n FROM a WHERE flag & 128 = 0 AND flag & 4 = 0 AND umi IS NOT NULL AND gene IS NOT NULL AND gene <> '' AND NOT starts_with(gene, '__') GROUP BY gene")
def gene_skip_regex(spark, sf_dir):
    found = bundles.classified(alignments(spark, sf_dir), GroupingOptions(extract_umi_method="tag", per_gene=True, gene_tag="XF"))
    return found.where(F.col("event") == bundles.KEPT).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


_PARTS = f"""{_A}, c AS (SELECT read_id, pos, is_reverse, cigar, list_zip(regexp_extract_all(cigar, '([0-9]+)', 1), regexp_extract_all(cigar, '([MIDNSHP=X])', 1)) AS z FROM a),
d AS (SELECT *, list_transform(z, lambda x: x[2]) AS o, list_transform(z, lambda x: CAST(x[1] AS INT)) AS n FROM c),
g AS (SELECT *, CAST(coalesce(list_sum(list_transform(range(1, len(o) + 1), lambda i: CASE WHEN o[i] IN ('M','D','N','=','X') THEN n[i] ELSE 0 END)), 0) AS INT) AS span,
  CASE WHEN is_reverse THEN list_reverse(o) ELSE o END AS oo, CASE WHEN is_reverse THEN list_reverse(n) ELSE n END AS nn FROM d),
h AS (SELECT *, CASE WHEN oo[1] = 'S' THEN 1 ELSE 0 END AS lead, list_min(list_filter(range(1, len(oo) + 1), lambda i: oo[i] IN ('N','S') AND (i > 1 OR oo[1] <> 'S'))) AS hit FROM g),
k AS (SELECT *, CASE WHEN hit IS NOT NULL THEN CAST(CASE WHEN lead = 1 THEN nn[1] ELSE 0 END + coalesce(list_sum(list_transform(range(1 + lead, hit), lambda i: CASE WHEN oo[i] IN ('M','D','=','X') THEN nn[i] ELSE 0 END)), 0) AS INT) END AS off FROM h)"""


@query(f"""WITH {_PARTS} SELECT read_id, CASE WHEN is_reverse THEN pos ELSE pos - CASE WHEN o[1] = 'S' THEN n[1] ELSE 0 END END AS start,
CASE WHEN is_reverse THEN pos + span + CASE WHEN o[len(o)] = 'S' THEN n[len(n)] ELSE 0 END ELSE pos - CASE WHEN o[1] = 'S' THEN n[1] ELSE 0 END END AS pos FROM k""")
def read_position_5p(spark, sf_dir):
    x = alignments(spark, sf_dir)
    return x.select(F.col("qname").alias("read_id"), read_position(F.col("pos"), F.col("flag").bitwiseAND(16) != 0, F.col("cigar")).alias("x")).select("read_id", "x.start", "x.pos")


@query(f"""WITH {_PARTS} SELECT read_id, CASE WHEN contains(cigar, 'N') OR (CASE WHEN is_reverse THEN CASE WHEN o[1] = 'S' THEN n[1] ELSE 0 END ELSE CASE WHEN o[len(o)] = 'S' THEN n[len(n)] ELSE 0 END END) > 4 THEN off END AS splice FROM k""")
def splice_offset(spark, sf_dir):
    x = alignments(spark, sf_dir)
    return x.select(F.col("qname").alias("read_id"), read_position(F.col("pos"), F.col("flag").bitwiseAND(16) != 0, F.col("cigar"))["splice"].alias("splice"))


@query(f"WITH {_R} SELECT contig, pos, is_reverse, cell, umi, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY ALL")
def bundle_counts(spark, sf_dir):
    return bundles.umi_counts(reads(spark, sf_dir), ["contig", "pos", "is_reverse", "cell"])


def _best(order: str) -> str:
    return f"WITH {_R} SELECT contig, gene, umi, read_id FROM (SELECT *, row_number() OVER (PARTITION BY contig, gene, umi ORDER BY mapq DESC, {order}read_id) AS k FROM r) WHERE k = 1"


def _best_of(spark, sf_dir, multimapping):
    options = GroupingOptions(extract_umi_method="tag", per_gene=True, gene_tag="XF", multimapping=multimapping)
    kept, keys = bundles.keyed(bundles.classified(tagged(spark, sf_dir), options), options)
    best = bundles.best_of_each(kept, keys, bundles.preference(options), ["read_id"])
    return best.select(F.col("rname").alias("contig"), "gene", "umi", "read.read_id")


@query(_best(""))
def best_read(spark, sf_dir):
    return _best_of(spark, sf_dir, None)


@query(_best("nh, "))
def best_read_nh(spark, sf_dir):
    return _best_of(spark, sf_dir, "NH")


@query(_best("CASE WHEN xt = 'U' THEN 0 ELSE 1 END, "))
def best_read_xt(spark, sf_dir):
    return _best_of(spark, sf_dir, "XT")


# --- the five methods -------------------------------------------------------------------------


@query(f"WITH {_R}, {_nodes(_CG)} SELECT contig, gene, umi, n, umi AS rep FROM nodes")
def cluster_unique(spark, sf_dir):
    return _clustered(spark, sf_dir, "unique")


@query(f"""WITH {_R}, {_nodes(_CG)}, m AS (SELECT contig, gene, median(n) AS med, count(*) AS k FROM nodes GROUP BY ALL)
SELECT contig, gene, umi, n, umi AS rep FROM nodes JOIN m USING (contig, gene) WHERE n > med / 100 OR k = 1""")
def cluster_percentile(spark, sf_dir):
    return _clustered(spark, sf_dir, "percentile")


@query(f"WITH RECURSIVE {_R}, {_nodes(_CG)}, {_edges(_CG, 1, False)}, {_labels(_CG)} SELECT contig, gene, umi, n, rep FROM lab")
def cluster_components(spark, sf_dir):
    return _clustered(spark, sf_dir, "cluster")


@query(f"WITH RECURSIVE {_R}, {_directional(_CG)} SELECT contig, gene, umi, n, rep FROM lab")
def cluster_directional(spark, sf_dir):
    return _clustered(spark, sf_dir, "directional")


_ADJACENCY = f"""WITH RECURSIVE {_R}, {_nodes(_CG)}, {_edges(_CG, 1, False)}, {_labels(_CG)},
rk AS (SELECT *, row_number() OVER (PARTITION BY contig, gene, rep ORDER BY n DESC, umi) AS k FROM lab),
need AS (SELECT x.contig, x.gene, x.umi, x.n, x.rep, x.k, least(x.k, coalesce(min(y.k), x.k)) AS need FROM rk x LEFT JOIN edges e ON e.contig = x.contig AND e.gene = x.gene AND e.v = x.umi
  LEFT JOIN rk y ON y.contig = x.contig AND y.gene = x.gene AND y.umi = e.u GROUP BY x.contig, x.gene, x.umi, x.n, x.rep, x.k),
lead AS (SELECT *, CASE WHEN k <= max(need) OVER (PARTITION BY contig, gene, rep) THEN k ELSE need END AS lead FROM need)
SELECT l.contig, l.gene, l.umi, l.n, h.umi AS rep FROM lead l JOIN rk h ON h.contig = l.contig AND h.gene = l.gene AND h.rep = l.rep AND h.k = l.lead"""


@query(_ADJACENCY)
def cluster_adjacency(spark, sf_dir):
    return _clustered(spark, sf_dir, "adjacency")


@query(ORACLES["cluster_percentile"])
def percentile_relational(spark, sf_dir):
    return _clustered(spark, sf_dir, "percentile", path="relational")


@query(ORACLES["cluster_components"])
def components_relational(spark, sf_dir):
    return _clustered(spark, sf_dir, "cluster", path="relational")


@query(_ADJACENCY)
def adjacency_relational(spark, sf_dir):
    return _clustered(spark, sf_dir, "adjacency", path="relational")


@query(f"WITH RECURSIVE {_R}, {_directional(_CG, 2)} SELECT contig, gene, umi, n, rep FROM lab")
def directional_t2(spark, sf_dir):
    return _clustered(spark, sf_dir, "directional", 2)


@query(f"WITH RECURSIVE {_R}, {_directional(_CGC)} SELECT contig, gene, cell, umi, n, rep FROM lab")
def directional_relational(spark, sf_dir):
    keys = ["contig", "gene", "cell"]
    return cluster(_counts(spark, sf_dir, keys), keys, "directional", 1, path="relational")


# --- molecules --------------------------------------------------------------------------------

_GENE = GroupingOptions(per_gene=True, gene_tag="XF")
_CELL = GroupingOptions(extract_umi_method="tag", cell_tag="CB", per_gene=True, gene_tag="XF", per_cell=True)
_POSITION = "x AS (SELECT contig, CASE WHEN is_reverse THEN pos + 30 ELSE pos END AS pos, is_reverse, umi, read_id, mapq, nh, xt, cell, gene FROM r)"


@query(f"""WITH RECURSIVE {_R}, {_POSITION}, {_directional(_CP, 1, "x")}
SELECT read_id FROM (SELECT x.*, row_number() OVER (PARTITION BY x.contig, x.pos, x.is_reverse, x.umi ORDER BY mapq DESC, read_id) AS k FROM x
JOIN lab l ON l.contig = x.contig AND l.pos = x.pos AND l.is_reverse = x.is_reverse AND l.umi = x.umi WHERE l.rep = x.umi) WHERE k = 1""")
def dedup_reads(spark, sf_dir):
    return molecules.dedup(tagged(spark, sf_dir), GroupingOptions()).select("read_id")


@query(f"""WITH {_R}, {_POSITION} SELECT read_id FROM (SELECT *, row_number() OVER (PARTITION BY contig, pos, is_reverse ORDER BY mapq DESC, concat(read_id, '_', umi)) AS k FROM x) WHERE k = 1""")
def dedup_ignore_umi(spark, sf_dir):
    return molecules.dedup(tagged(spark, sf_dir), GroupingOptions(ignore_umi=True)).select("read_id")


@query(f"""WITH RECURSIVE {_R}, {_directional(_CG)} SELECT read_id FROM (SELECT r.*, row_number() OVER (PARTITION BY r.contig, r.gene, r.umi ORDER BY mapq DESC, read_id) AS k FROM r
JOIN lab l ON l.contig = r.contig AND l.gene = r.gene AND l.umi = r.umi WHERE l.rep = r.umi AND substr(r.umi, 1, 1) IN ('A', 'C')) WHERE k = 1""")
def dedup_umi_whitelist(spark, sf_dir):
    x = tagged(spark, sf_dir)
    allowed = tuple(a + b + c + d for a in "AC" for b in "ACGT" for c in "ACGT" for d in "ACGT")
    return molecules.dedup(x, GroupingOptions(per_gene=True, gene_tag="XF", umi_whitelist=allowed)).select("read_id")


_GROUPS = f"""WITH RECURSIVE {_R}, {_directional(_CG)}, g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY contig, gene, rep) AS BIGINT) AS gn FROM lab),
u AS (SELECT contig, gene, umi AS rep, CAST(row_number() OVER (ORDER BY contig, gene, n DESC, umi) - 1 AS BIGINT) AS uid FROM lab WHERE umi = rep)"""


@query(f"{_GROUPS} SELECT concat(read_id, '_', r.umi) AS read_id, r.contig, r.pos AS position, r.gene, r.umi, g.n AS umi_count, g.rep AS final_umi, g.gn AS final_umi_count, u.uid AS unique_id FROM r JOIN g USING (contig, gene, umi) JOIN u ON u.contig = g.contig AND u.gene = g.gene AND u.rep = g.rep")
def group_table(spark, sf_dir):
    return molecules.group_table(molecules.group(tagged(spark, sf_dir), _GENE), _GENE)


@query(f"{_GROUPS} SELECT uid AS unique_id, contig, gene, rep FROM u")
def group_unique_id(spark, sf_dir):
    _, groups, keys = molecules.groups_of(tagged(spark, sf_dir), _GENE)
    heads = groups.where("umi = rep")
    return numbered(heads, [*[F.col(k) for k in keys], F.col("n").desc(), F.col("rep")], "unique_id").select("unique_id", F.col("rname").alias("contig"), "gene", "rep")


@query(f"WITH RECURSIVE {_R}, {_directional(_CG)} SELECT gene, CAST(count(*) AS BIGINT) AS count FROM lab WHERE umi = rep GROUP BY gene")
def count_gene(spark, sf_dir):
    return molecules.count(tagged(spark, sf_dir), _GENE)


@query(f"WITH RECURSIVE {_R}, {_directional(_CGC)} SELECT gene, cell, CAST(count(*) AS BIGINT) AS count FROM lab WHERE umi = rep GROUP BY gene, cell")
def count_gene_cell(spark, sf_dir):
    return molecules.count(tagged(spark, sf_dir), _CELL)


_CELLS = [f"translate(substr(md5('{i}'),1,6),'0123456789abcdef','ACGTACGTACGTACGT')" for i in range(12)]


@query(f"""WITH RECURSIVE {_R}, {_directional(_CGC)}, c AS (SELECT gene, cell, count(*) AS n FROM lab WHERE umi = rep GROUP BY gene, cell)
SELECT gene, {', '.join(f"CAST(coalesce(sum(n) FILTER (WHERE cell = {c}), 0) AS BIGINT) AS c{i}" for i, c in enumerate(_CELLS))} FROM c GROUP BY gene""")
def count_gene_cell_wide(spark, sf_dir):
    names = [r[0] for r in spark.range(12).orderBy("id").select(F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 6), "0123456789abcdef", "ACGTACGTACGTACGT")).collect()]
    wide = molecules.wide(molecules.count(tagged(spark, sf_dir), _CELL), sorted(set(names)))
    return wide.select("gene", *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])


@query(f"WITH RECURSIVE {_R}, {_directional('cell, gene')} SELECT cell, gene, CAST(count(*) AS BIGINT) AS count FROM lab WHERE umi = rep GROUP BY cell, gene")
def count_tab(spark, sf_dir):
    table = reads(spark, sf_dir).select(F.concat_ws("_", "read_id", "cell", "umi").alias("read_id"), "gene")
    return molecules.count_table(table, GroupingOptions(per_cell=True))


@query(f"WITH {_R}, {_nodes(_CG)}, b AS (SELECT contig, gene, count(*) AS k FROM nodes GROUP BY ALL) SELECT CAST(count(*) AS BIGINT) AS positions, round(avg(k), 6) AS mean_umis, CAST(max(k) AS BIGINT) AS max_umis FROM b")
def bundle_summary(spark, sf_dir):
    return molecules.bundle_summary(_counts(spark, sf_dir, ["contig", "gene"]), ["contig", "gene"]).withColumn("mean_umis", F.round("mean_umis", 6))


@query(f"WITH {_R}, m(gene, transcript) AS (VALUES ('M1', 'chr0'), ('M1', 'chr2'), ('M2', 'chr1'), ('M3', 'chr4')) SELECT m.gene, CAST(count(*) AS BIGINT) AS n FROM r JOIN m ON m.transcript = r.contig GROUP BY m.gene")
def gene_transcript_map(spark, sf_dir):
    genes = spark.createDataFrame([("M1", "chr0"), ("M1", "chr2"), ("M2", "chr1"), ("M3", "chr4")], "gene string, transcript string")
    found = bundles.classified(tagged(spark, sf_dir), GroupingOptions(per_gene=True, per_contig=True), genes)
    return found.groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


# --- cells ------------------------------------------------------------------------------------


@query(f"WITH {_R} SELECT cell, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY cell")
def cell_counts_reads(spark, sf_dir):
    return whitelist.cell_counts(reads(spark, sf_dir))


@query(f"WITH {_R} SELECT cell, CAST(count(DISTINCT umi) AS BIGINT) AS n FROM r GROUP BY cell")
def cell_counts_umis(spark, sf_dir):
    return whitelist.cell_counts(reads(spark, sf_dir), "umis")


@query(f"WITH {_SEEN} SELECT cell, n, CAST(row_number() OVER (ORDER BY n DESC, cell) AS INT) AS rank, CAST(sum(n) OVER (ORDER BY n DESC, cell ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM s")
def knee_curve(spark, sf_dir):
    return whitelist.knee_curve(_seen(spark, sf_dir))


_SKEWED = "k AS (SELECT translate(substr(md5(cast(c as varchar)),1,6),'0123456789abcdef','ACGTACGTACGTACGT') AS cell, CAST(sum(w) AS BIGINT) AS n FROM (SELECT o_orderkey % 1200 AS c, CASE WHEN o_orderkey % 1200 < 90 THEN 40 ELSE 1 END AS w FROM orders) z GROUP BY ALL)"


def _skewed(spark, sf_dir):
    c = F.col("o_orderkey") % 1200
    cell = F.translate(F.substring(F.md5(c.cast("string")), 1, 6), "0123456789abcdef", "ACGTACGTACGTACGT").alias("cell")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(cell, F.when(c < 90, 40).otherwise(1).alias("w")).groupBy("cell").agg(F.sum("w").alias("n"))


# All distances from all chords are whole numbers: no rounding decides between two points.
@query(f"""WITH RECURSIVE {_SKEWED}, c AS (SELECT cell, n, row_number() OVER (ORDER BY n DESC, cell) - 1 AS i, sum(n) OVER (ORDER BY n DESC, cell ROWS UNBOUNDED PRECEDING) AS y FROM k),
d AS (SELECT s.i + 1 AS size, p.i, abs(p.i * (s.y - z.y) - (p.y - z.y) * s.i) AS far FROM c s JOIN c p ON p.i <= s.i CROSS JOIN (SELECT y FROM c WHERE i = 0) z),
f AS (SELECT size, min(i) AS best FROM (SELECT *, max(far) OVER (PARTITION BY size) AS most FROM d) WHERE far = most GROUP BY size),
it AS (SELECT 0 AS step, best, 0::BIGINT AS before FROM f WHERE size = (SELECT count(*) FROM c)
  UNION ALL SELECT it.step + 1, f.best, it.best FROM it JOIN f ON f.size = least((SELECT count(*) FROM c), it.best * 3) WHERE it.best <> it.before AND it.step < 101)
SELECT cell, n FROM c WHERE i <= (SELECT best FROM it ORDER BY step DESC LIMIT 1)""")
def knee_distance(spark, sf_dir):
    return whitelist.select_cells(_skewed(spark, sf_dir), WhitelistOptions())


def _density(accepted: str) -> str:
    """Cells above the highest accepted minimum of the kernel density of the logarithms of counts."""
    return f"""WITH {_SKEWED}, h AS (SELECT log10(n) AS v, CAST(count(*) AS DOUBLE) AS w FROM k WHERE n > 0.001 * (SELECT max(n) FROM k) GROUP BY n),
m AS (SELECT min(v) AS low, max(v) AS high, sum(v * w) / sum(w) AS mean, sum(w) AS total FROM h),
b AS (SELECT low, high, 0.1 * sqrt((SELECT sum(w * (v - mean) * (v - mean)) FROM h) / (total - 1)) AS width FROM m),
g AS (SELECT i, low + (high - low) * i / 9999 AS x, high, width FROM b, range(10000) AS r(i)),
d AS (SELECT i, x, high, sum(w * exp(-0.5 * ((x - v) / width) * ((x - v) / width))) AS y FROM g, h GROUP BY i, x, high),
e AS (SELECT *, lag(y) OVER (ORDER BY i) AS left_y, lead(y) OVER (ORDER BY i) AS right_y FROM d),
t AS (SELECT pow(10, x) AS threshold FROM e WHERE y < left_y AND y < right_y AND {accepted} ORDER BY i DESC LIMIT 1)
SELECT cell, n FROM k WHERE n > (SELECT threshold FROM t)"""


@query(_density("i >= 2000 AND (high - x > 0.5 OR x < high / 2)"))
def knee_density(spark, sf_dir):
    return whitelist.select_cells(_skewed(spark, sf_dir), WhitelistOptions(knee_method="density"))


@query(_density("(SELECT count(*) FROM k WHERE n > pow(10, x)) > 10 AND (SELECT count(*) FROM k WHERE n > pow(10, x)) <= 100"))
def knee_expected_cells(spark, sf_dir):
    return whitelist.select_cells(_skewed(spark, sf_dir), WhitelistOptions(knee_method="density", expect_cells=100))


@query(f"WITH {_SKEWED} SELECT cell, n FROM k WHERE n > (SELECT n FROM k ORDER BY n DESC, cell LIMIT 1 OFFSET 50)")
def cell_top_n(spark, sf_dir):
    return whitelist.top_cells(_skewed(spark, sf_dir), 50)


@query(f"""WITH {_SEEN}, o AS (SELECT cell, n, row_number() OVER (ORDER BY n, cell DESC) AS rk FROM s), x AS (SELECT a.cell, b.cell AS other, hamming(a.cell, b.cell) <= 1 AS sub FROM o a JOIN o b ON a.rk < b.rk
WHERE len(list_filter(range(4, 7), lambda i: levenshtein(a.cell, substr(b.cell, 1, i::INT)) <= 1)) > 0) SELECT cell, CAST(count(*) AS BIGINT) AS hits, min(other) AS barcode, bool_or(sub) AS substitution FROM x GROUP BY cell""")
def above_knee_errors(spark, sf_dir):
    near = whitelist.near_heavier(_seen(spark, sf_dir))
    return near.groupBy("cell").agg(F.count(F.lit(1)).alias("hits"), F.min("other").alias("barcode"), F.bool_or("substitution").alias("substitution"))


@query(f"""WITH {_SEEN}, w AS (SELECT cell AS barcode, n FROM s WHERE n > (SELECT n FROM s ORDER BY n DESC, cell LIMIT 1 OFFSET 40)),
f AS (SELECT s.cell, s.n, min(w.barcode) AS barcode FROM s JOIN w ON hamming(s.cell, w.barcode) <= 1 WHERE s.cell NOT IN (SELECT barcode FROM w) GROUP BY s.cell, s.n HAVING count(*) = 1)
SELECT w.barcode, coalesce(string_agg(f.cell, ',' ORDER BY f.cell), '') AS errors, w.n AS count, coalesce(string_agg(CAST(f.n AS VARCHAR), ',' ORDER BY f.cell), '') AS error_counts FROM w LEFT JOIN f USING (barcode) GROUP BY w.barcode, w.n""")
def whitelist_report(spark, sf_dir):
    seen = _seen(spark, sf_dir).select("cell", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("umi"))
    return whitelist.whitelist(seen, WhitelistOptions(cell_number=40))


# --- extraction with lists --------------------------------------------------------------------

_CELLS4 = "w AS (SELECT DISTINCT substr(translate(md5(cast(p_partkey % 60 as varchar)),'0123456789abcdef','ACGTACGTACGTACGT'),1,4) AS barcode FROM part)"


def _cells4(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.substring(F.translate(F.md5((F.col("p_partkey") % 60).cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 4).alias("barcode")).distinct()


def _single(spark, sf_dir):
    return records(spark, sf_dir).select(F.lit(0).cast("long").alias("ord"), F.col("identifier").alias("identifier1"), F.col("seq").alias("seq1"), F.col("quals").alias("quals1"), "read_id")


@query(f"""WITH {_Q}, {_CELLS4}, e AS (SELECT DISTINCT barcode, concat(substr(barcode, 1, i::INT - 1), b, substr(barcode, i::INT + 1)) AS error FROM w, range(1, 5) AS p(i), unnest(['A','C','G','T','N']) AS x(b)),
f AS (SELECT error, CASE WHEN count(DISTINCT barcode) = 1 THEN min(barcode) END AS barcode FROM e WHERE error NOT IN (SELECT barcode FROM w) GROUP BY error),
j AS (SELECT q.read_id, substr(q.seq, 1, 4) AS raw, substr(q.seq, 5, 6) AS umi, q.identifier, w.barcode AS ok, f.error, f.barcode AS fix FROM q LEFT JOIN w ON w.barcode = substr(q.seq, 1, 4) LEFT JOIN f ON f.error = substr(q.seq, 1, 4))
SELECT read_id, coalesce(ok, fix, raw) AS cell, CASE WHEN ok IS NOT NULL OR fix IS NOT NULL THEN 'reads output' WHEN error IS NOT NULL THEN 'cell error ambiguous' ELSE 'cell not whitelisted' END AS event,
CASE WHEN ok IS NOT NULL OR fix IS NOT NULL THEN concat(read_id, '_', coalesce(ok, fix), '_', umi, substr(identifier, length(read_id) + 1)) ELSE identifier END AS identifier FROM j""")
def extract_whitelist_correct(spark, sf_dir):
    listed = _cells4(spark, sf_dir)
    options = ExtractOptions(pattern="CCCCNNNNNN", filter_cell_barcode=True, error_correct_cell=True)
    return extract.extract_reads(_single(spark, sf_dir), options, listed, ds.error_neighbours(listed)).select("read_id", "cell", "event", F.col("identifier1").alias("identifier"))


@query(f"WITH {_Q}, {_CELLS4} SELECT CASE WHEN substr(seq, 1, 4) IN (SELECT barcode FROM w) THEN 'cell blacklisted' ELSE 'reads output' END AS event, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY ALL")
def extract_blacklist(spark, sf_dir):
    return extract.events(extract.extract_reads(_single(spark, sf_dir), ExtractOptions(pattern="CCCCNNNNNN"), blacklist=_cells4(spark, sf_dir)))


@query(f"""WITH {_Q}, {_CELLS4} SELECT read_id, substr(seq, 1, 4) AS umi, substr(seq, 5) AS seq FROM q WHERE substr(seq, 1, 4) IN (SELECT barcode FROM w)""")
def extract_umi_whitelist(spark, sf_dir):
    rows = extract.extract_reads(_single(spark, sf_dir), ExtractOptions(pattern="NNNN", filter_umi=True), umi_whitelist=_cells4(spark, sf_dir))
    return rows.where(F.col("event") == extract.KEPT).select("read_id", "umi", F.col("seq1").alias("seq"))


@query(f"WITH {_Q} SELECT read_id, concat(read_id, '_', substr(seq, 1, 6), substr(identifier, length(read_id) + 1)) AS identifier1, seq AS seq1 FROM q")
def extract_read2_only(spark, sf_dir):
    pair = _single(spark, sf_dir).withColumns({"identifier2": F.col("identifier1"), "seq2": F.col("seq1"), "quals2": F.col("quals1")})
    return extract.extract_reads(pair, ExtractOptions(pattern2="NNNNNN", read2_only=True)).select("read_id", "identifier1", "seq1")


@query(f"WITH {_Q} SELECT read_id, seq AS seq1, reverse(seq) AS seq2 FROM q")
def reconcile_pairs(spark, sf_dir):
    one = records(spark, sf_dir).withColumn("ord", F.lit(0).cast("long"))
    two = one.withColumn("seq", F.reverse("seq"))
    alone = two.withColumn("identifier", F.concat(F.lit("alone."), "identifier"))
    found = extract.paired(one, two.unionByName(alone), reconcile=True)
    return found.select(F.regexp_extract("identifier1", r"^(\S*)", 1).alias("read_id"), "seq1", "seq2")


@query(f"WITH {_CELLS4} SELECT concat(x.barcode, y.barcode) AS barcode FROM w x, w y")
def paired_whitelist_product(spark, sf_dir):
    listed = _cells4(spark, sf_dir)
    return products(listed, listed)


# --- mates and templates ----------------------------------------------------------------------


@query(f"""WITH {_A}, k AS (SELECT DISTINCT concat('t', right(read_id, 3)) AS qname, rnext, pnext FROM a WHERE flag & 64 <> 0)
SELECT DISTINCT concat('t', right(a.read_id, 3)) AS qname, a.contig, a.pos FROM a JOIN k ON k.qname = concat('t', right(a.read_id, 3)) AND k.rnext = a.contig AND k.pnext = a.pos WHERE a.flag & 128 <> 0""")
def mate_semijoin(spark, sf_dir):
    x = alignments(spark, sf_dir).withColumn("qname", F.concat(F.lit("t"), F.right("qname", F.lit(3))))
    found = molecules.mates(x.where(F.col("flag").bitwiseAND(64) != 0), x)
    return found.select("qname", F.col("rname").alias("contig"), "pos")


_TEMPLATES = """t AS (SELECT concat('t', cast(l_orderkey as varchar)) AS qname, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord,
  cast(1 + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN l_partkey % 3 = 0 THEN 256 ELSE 0 END as int) AS flag, concat('chr', cast(l_suppkey % 2 as varchar)) AS rname, cast(l_partkey % 2 as int) AS pos,
  concat('chr', cast(l_partkey % 2 as varchar)) AS rnext, cast(l_suppkey % 2 as int) AS pnext FROM lineitem)"""


@query(f"""WITH {_TEMPLATES}, j AS (SELECT x.*, y.ord AS mo, y.flag AS mflag, y.rname AS mrname, y.pos AS mpos, y.rnext AS mrnext, y.pnext AS mpnext,
  row_number() OVER (PARTITION BY x.qname, x.ord ORDER BY CASE WHEN (x.flag & 256) = (y.flag & 256) THEN 1 ELSE 0 END, CASE WHEN y.rnext = x.rname AND y.pnext = x.pos THEN 0 ELSE 1 END, CASE WHEN y.rnext = x.rname AND y.pnext = x.pos THEN -y.ord ELSE y.ord END) AS k
  FROM t x JOIN t y ON x.qname = y.qname AND (x.flag & 64) <> (y.flag & 64) AND y.rname = x.rnext AND y.pos = x.pnext),
p AS (SELECT qname, CASE WHEN flag & 64 <> 0 THEN {{'f': flag, 'c': rname, 'p': pos, 'rn': rnext, 'pn': pnext}} ELSE {{'f': CASE WHEN flag & 256 <> 0 THEN mflag | 256 ELSE mflag END, 'c': mrname, 'p': mpos, 'rn': mrnext, 'pn': mpnext}} END AS one,
  CASE WHEN flag & 64 <> 0 THEN {{'f': CASE WHEN flag & 256 <> 0 THEN mflag | 256 ELSE mflag END, 'c': mrname, 'p': mpos, 'rn': mrnext, 'pn': mpnext}} ELSE {{'f': flag, 'c': rname, 'p': pos, 'rn': rnext, 'pn': pnext}} END AS two FROM j WHERE k = 1)
SELECT DISTINCT qname, one.f AS flag1, one.c AS contig1, one.p AS pos1, one.rn AS next1, one.pn AS next_pos1, two.f AS flag2, two.c AS contig2, two.p AS pos2, two.rn AS next2, two.pn AS next_pos2 FROM p""")
def pair_templates(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # numbers are compared inside a template only, so each template numbers its own reads; no task sees the others
    own = _TEMPLATES.replace("OVER (ORDER BY l_orderkey, ", "OVER (PARTITION BY l_orderkey ORDER BY ")
    x = spark.sql(f"WITH {own} SELECT * FROM t".replace("FROM lineitem", "FROM {lineitem}").replace("varchar", "string"), lineitem=line)
    found = pairs.template_pairs(x, tags=())
    cells = [F.col(f"read{i}.{c}").alias(f"{n}{i}") for i in (1, 2) for c, n in (("flag", "flag"), ("rname", "contig"), ("pos", "pos"), ("rnext", "next"), ("pnext", "next_pos"))]
    return found.select("read1.qname", *cells)


# --- statistics -------------------------------------------------------------------------------

_POST = "post AS (SELECT contig, gene, rep AS umi, CAST(sum(n) AS BIGINT) AS n FROM lab GROUP BY ALL)"


def _before_after(spark, sf_dir):
    keys = ["contig", "gene"]
    before = _counts(spark, sf_dir, keys)
    return before, stats.after_grouping(cluster(before, keys), keys), keys


@query(f"""WITH RECURSIVE {_R}, {_directional(_CG)}, {_POST}, a AS (SELECT n AS counts, count(*) AS x FROM nodes GROUP BY n), b AS (SELECT n AS counts, count(*) AS y FROM post GROUP BY n)
SELECT counts, CAST(coalesce(x, 0) AS BIGINT) AS instances_pre, CAST(coalesce(y, 0) AS BIGINT) AS instances_post FROM a FULL JOIN b USING (counts)""")
def stats_per_umi_position(spark, sf_dir):
    before, after, _ = _before_after(spark, sf_dir)
    return stats.per_position_counts(before, after)


@query(f"""WITH RECURSIVE {_R}, {_directional(_CG)}, {_POST},
a AS (SELECT umi AS "UMI", CAST(floor(median(n)) AS BIGINT) AS median_counts_pre, CAST(count(*) AS BIGINT) AS times_observed_pre, CAST(sum(n) AS BIGINT) AS total_counts_pre FROM nodes GROUP BY umi),
b AS (SELECT umi AS "UMI", CAST(floor(median(n)) AS BIGINT) AS median_counts_post, CAST(count(*) AS BIGINT) AS times_observed_post, CAST(sum(n) AS BIGINT) AS total_counts_post FROM post GROUP BY umi)
SELECT a.*, coalesce(median_counts_post, 0) AS median_counts_post, coalesce(times_observed_post, 0) AS times_observed_post, coalesce(total_counts_post, 0) AS total_counts_post FROM a LEFT JOIN b USING ("UMI")""")
def stats_per_umi(spark, sf_dir):
    before, after, _ = _before_after(spark, sf_dir)
    return stats.per_umi(before, after)


def _bins(table: str, name: str) -> str:
    return f"""{name} AS (SELECT CASE WHEN d IS NULL THEN 'Single_UMI' ELSE CAST(CAST(ceil(d) AS BIGINT) AS VARCHAR) END AS edit_distance, CAST(count(*) AS BIGINT) AS {name}_n FROM
(SELECT g.contig, g.gene, p.d FROM (SELECT DISTINCT contig, gene FROM {table}) g LEFT JOIN (SELECT a.contig, a.gene, avg(CAST(hamming(a.umi, b.umi) AS DOUBLE)) AS d FROM {table} a JOIN {table} b USING (contig, gene) WHERE a.umi < b.umi GROUP BY ALL) p USING (contig, gene)) GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_R}, {_directional(_CG)}, {_POST}, {_bins('nodes', 'u')}, {_bins('post', 'w')}
SELECT edit_distance, coalesce(u_n, 0) AS "unique", coalesce(w_n, 0) AS grouped FROM u FULL JOIN w USING (edit_distance)""")
def stats_edit_distance(spark, sf_dir):
    before, after, keys = _before_after(spark, sf_dir)
    return stats.edit_distances(before, after, keys)


_HASH = "CAST('0x' || substr(md5(concat_ws('|', {})), 1, 13) AS BIGINT)"


@query(f"""WITH {_R}, {_nodes(_CG)}, p AS (SELECT umi, sum(n) AS w FROM nodes GROUP BY umi), s AS (SELECT umi, sum(w) OVER (ORDER BY umi) - w AS lo, sum(w) OVER (ORDER BY umi) AS hi FROM p),
a AS (SELECT contig, gene, row_number() OVER () AS id, {_HASH.format("contig, gene, umi, '1'")} % (SELECT sum(w) FROM p) AS at FROM nodes),
x AS (SELECT a.contig, a.gene, a.id, s.umi FROM a JOIN s ON s.lo <= a.at AND a.at < s.hi),
d AS (SELECT a.contig, a.gene, avg(CAST(hamming(a.umi, b.umi) AS DOUBLE)) AS d FROM x a JOIN x b ON a.contig = b.contig AND a.gene = b.gene AND a.id < b.id GROUP BY ALL)
SELECT CASE WHEN d IS NULL THEN 'Single_UMI' ELSE CAST(CAST(ceil(d) AS BIGINT) AS VARCHAR) END AS edit_distance, CAST(count(*) AS BIGINT) AS unique_null FROM (SELECT DISTINCT contig, gene FROM x) LEFT JOIN d USING (contig, gene) GROUP BY 1""")
def stats_null_distance(spark, sf_dir):
    return stats.null_distances(_counts(spark, sf_dir, ["contig", "gene"]), ["contig", "gene"], seed=1)


@query(f"""WITH {_R} SELECT CASE WHEN {_HASH.format("concat(read_id, '_', umi), '3'")} < pow(2, 51) THEN 'kept' ELSE 'randomly excluded' END AS event, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1""")
def bernoulli_subset(spark, sf_dir):
    return bundles.event_counts(bundles.classified(tagged(spark, sf_dir), GroupingOptions(subset=0.5, seed=3)))


# --- files: written, read back, compared with the view ------------------------------------------


#: Records of a written file, about: files, and the tasks that sort and write them, grow in number and not in size.
_A_FILE = 500_000


def _files(spark, sf_dir) -> int:
    """The number of files for the records: three at least. The count comes from the table's footers."""
    return max(3, -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // _A_FILE))


def _fastq(spark, sf_dir, mate: bool = False, **more) -> DataFrame:
    """The records in several files, in the order of their ids."""
    x = records(spark, sf_dir)
    x = x.withColumns({"seq": F.reverse("seq"), "quals": F.reverse("quals")}) if mate else x
    path = scratch(spark, "fastq")
    fastq.write_fastq(x.repartitionByRange(_files(spark, sf_dir), "read_id").sortWithinPartitions("read_id"), path, **more)
    return fastq.read_fastq(spark, path)


@query(f"WITH {_Q} SELECT identifier, seq, quals FROM q")
def fastq_round_trip(spark, sf_dir):
    return _fastq(spark, sf_dir).select("identifier", "seq", "quals")


@query(f"WITH {_Q} SELECT identifier, seq, quals FROM q")
def fastq_gzip_round_trip(spark, sf_dir):
    return _fastq(spark, sf_dir, compression="gzip").select("identifier", "seq", "quals")


@query(f"WITH {_Q} SELECT identifier AS identifier1, identifier AS identifier2, seq AS seq1, reverse(seq) AS seq2 FROM q")
def strict_pairs(spark, sf_dir):
    path = [scratch(spark, "fastq") for _ in "12"]
    x = records(spark, sf_dir).repartition(_files(spark, sf_dir), "read_id").sortWithinPartitions("read_id")
    fastq.write_fastq(x, path[0])
    fastq.write_fastq(x.withColumn("seq", F.reverse("seq")), path[1])
    return extract.paired(*(fastq.read_fastq(spark, p) for p in path)).select("identifier1", "identifier2", "seq1", "seq2")


# A report of the first reads: the limit is the feature.
@query(f"WITH {_Q} SELECT identifier, seq FROM q ORDER BY read_id LIMIT 1000")
def first_n_reads(spark, sf_dir):
    return extract.first_reads(_fastq(spark, sf_dir), 1000).select("identifier", "seq")


@query(f"WITH {_Q} SELECT substr(seq, 2, 4) AS cell, substr(seq, 6, 5) AS umi FROM q WHERE substr(seq, 1, 1) IN ('A', 'C') ORDER BY read_id LIMIT 501")
def whitelist_first_n_found(spark, sf_dir):
    reads1 = _fastq(spark, sf_dir).select("file_no", "ord", *[F.col(c).alias(f"{c}1") for c in ("identifier", "seq", "quals")])
    options = ExtractOptions(pattern=r"(?P<discard_1>[AC])(?P<cell_1>.{4})(?P<umi_1>.{5})", method="regex")
    return extract.first_found(extract.barcodes_only(reads1, options), 501).select("cell", "umi")


@query(f"WITH {_Q} SELECT identifier, seq FROM q WHERE substr(seq, 1, 1) NOT IN ('A', 'C')")
def rejected_reads(spark, sf_dir):
    options = ExtractOptions(pattern=r"(?P<discard_1>[AC])(?P<umi_1>.{5})", method="regex")
    rows, path = extract.extract_reads(_single(spark, sf_dir), options), scratch(spark, "fastq")
    fastq.write_fastq(rows.where(F.col("event") != extract.KEPT), path, "1")
    return fastq.read_fastq(spark, path).select("identifier", "seq")


_HEADER = ["@HD\tVN:1.6", *[f"@SQ\tSN:chr{i}\tLN:100000" for i in (3, 1, 4, 0, 2)]]
_SAM = f"""WITH {_A} SELECT read_id AS qname, flag, contig AS rname, pos, mapq, cigar, CASE WHEN rnext = contig THEN '=' ELSE rnext END AS rnext, pnext, umi, gene FROM a"""


def _sam_like(spark, sf_dir) -> DataFrame:
    x = alignments(spark, sf_dir)
    return x.withColumns({"qual": F.lit("*"), "tag_types": F.transform_values("tags", lambda k, v: F.lit("Z"))})


def _sam_columns(x: DataFrame) -> DataFrame:
    tag = lambda t: F.try_element_at("tags", F.lit(t))
    return x.select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", tag("RX").alias("umi"), tag("XF").alias("gene"))


@query(_SAM)
def sam_round_trip(spark, sf_dir):
    path = scratch(spark, "sam")
    al.write_sam(_sam_like(spark, sf_dir), path, _HEADER)
    return _sam_columns(al.read_sam(spark, path))


@query(_SAM)
def bam_round_trip(spark, sf_dir):
    path = scratch(spark, "bam")
    al.write_bam(_sam_like(spark, sf_dir), path.removeprefix("file:"), _HEADER)
    return _sam_columns(al.read_bam(spark, path.removeprefix("file:")))


@query(f"""WITH {_A}, c(contig, place) AS (VALUES ('chr3', 0), ('chr1', 1), ('chr4', 2), ('chr0', 3), ('chr2', 4))
SELECT CAST(row_number() OVER (ORDER BY place, pos) - 1 AS BIGINT) AS number, contig AS rname, pos FROM a JOIN c USING (contig)""")
def sam_coordinate_sort(spark, sf_dir):
    path = scratch(spark, "sam")
    al.write_sam(_sam_like(spark, sf_dir), path, _HEADER)
    lines = spark.read.text(path).where("value not like '@%'").select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.split("value", "\t", 5).alias("f"))
    x = lines.select("file", "block", F.col("f")[2].alias("rname"), (F.col("f")[3].cast("int") - 1).alias("pos"))
    return numbered_lines(x, "number").select("number", "rname", "pos")


@query(f"WITH {_R} SELECT gene, CAST(count(*) AS BIGINT) AS n FROM r WHERE contig = 'chr2' GROUP BY gene")
def contig_scan(spark, sf_dir):
    found = bundles.classified(tagged(spark, sf_dir), GroupingOptions(per_gene=True, gene_tag="XF", chrom="chr2"))
    return found.where(F.col("event") == bundles.KEPT).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_A} SELECT read_id AS qname FROM a WHERE flag & 128 = 0 AND (flag & 4 <> 0 OR flag & 8 <> 0)")
def unmapped_passed_on(spark, sf_dir):
    options = GroupingOptions(extract_umi_method="tag", paired=True, unmapped_reads="output")
    return molecules.passed_on(alignments(spark, sf_dir), options).select("qname")


def _text(spark: SparkSession, lines: DataFrame) -> str:
    path = scratch(spark, "table")
    lines.write.mode("overwrite").text(path)
    return path


@query("SELECT * FROM (VALUES ('M1', 'chr0'), ('M1', 'chr2'), ('M2', 'chr1')) AS t(gene, transcript)")
def gene_map_file(spark, sf_dir):
    rows = ["# a comment", "M1\tchr0", "M1\tchr2", "", "M2\tchr1", "M3\tchr9", "M4\tchr1"]
    return tables.gene_map(spark, _text(spark, spark.createDataFrame([(r,) for r in rows], "value string")), ["chr0", "chr1", "chr2"])


@query(f"WITH {_LIST} SELECT barcode FROM w")
def whitelist_file(spark, sf_dir):
    return tables.barcode_list(spark, _text(spark, _listed(spark, sf_dir).select(F.concat("barcode", F.lit("\tAC\t3")).alias("value"))))


@query(f"WITH {_LIST} SELECT concat(x, substr(barcode, 2)) AS error, barcode FROM w, (VALUES ('N'), ('R')) AS e(x)")
def whitelist_file_errors(spark, sf_dir):
    rest = F.substring("barcode", 2, 9)
    line = F.concat("barcode", F.lit("\tN"), rest, F.lit(",R"), rest, F.lit("\t7\t1,2")).alias("value")
    return tables.whitelist_fixes(spark, _text(spark, _listed(spark, sf_dir).select(line)))


@query(f"WITH {_LIST} SELECT barcode FROM w")
def blacklist_file(spark, sf_dir):
    return tables.blacklist(spark, _text(spark, _listed(spark, sf_dir).select(F.col("barcode").alias("value"))))


@query(ORACLES["stats_per_umi_position"].replace("SELECT counts, CAST(coalesce(x", "SELECT CAST(counts AS BIGINT) AS counts, CAST(coalesce(x"))
def stats_file(spark, sf_dir):
    path = scratch(spark, "stats")
    tables.write_tsv(stats_per_umi_position(spark, sf_dir), path)
    return spark.read.option("sep", "\t").option("header", "true").schema("counts bigint, instances_pre bigint, instances_post bigint").csv(path)


# --- further options ----------------------------------------------------------------------------


@query(f"WITH {_Q} SELECT read_id, substr(seq, 1, 4) AS cell, substr(seq, 5, 6) AS umi, substr(seq, 5) AS seq, substr(quals, 5) AS quals FROM q")
def regex_retain_umi(spark, sf_dir):
    from ..functions.patterns import regex_extract

    found = regex_extract(r"(?P<cell_1>.{4})(?P<umi_1>.{6})", retain_umi=True)(F.col("seq"), F.col("quals"))
    return records(spark, sf_dir).select("read_id", found.alias("m")).select("read_id", "m.cell", "m.umi", "m.seq", "m.quals")


@query(f"WITH {_R} SELECT read_id, gene AS \"XF\", umi AS \"BX\", CASE WHEN nh > 1 THEN cell ELSE 'old' END AS \"CB\" FROM r")
def tag_copy(spark, sf_dir):
    target = F.create_map(F.lit("XF"), F.col("gene"), F.lit("BX"), F.lit("old"), F.lit("CB"), F.lit("old"))
    source = F.map_filter(F.create_map(F.lit("XF"), F.lit("other"), F.lit("BX"), F.col("umi"), F.lit("CB"), F.col("cell")), lambda k, _: (k != "CB") | (F.col("nh") > 1))
    tags = bc.copied_tags(target, source, ["BX", "CB"]).alias("t")
    return reads(spark, sf_dir).select("read_id", tags).select("read_id", *[F.col("t")[k].alias(k) for k in ("XF", "BX", "CB")])


@query(f"WITH {_R} SELECT read_id, gene AS \"XF\", umi AS \"BX\", CAST(nh AS VARCHAR) AS \"UG\" FROM r")
def tags_set(spark, sf_dir):
    tags = bc.with_tags(F.create_map(F.lit("XF"), F.col("gene"), F.lit("BX"), F.lit("old")), UG=F.col("nh"), BX=F.col("umi")).alias("t")
    return reads(spark, sf_dir).select("read_id", tags).select("read_id", *[F.col("t")[k].alias(k) for k in ("XF", "BX", "UG")])


@query(f"""WITH {_Q}, {_CELLS4}, e AS (SELECT DISTINCT barcode, concat(substr(barcode, 1, i::INT - 1), b, substr(barcode, i::INT + 1)) AS error FROM w, range(1, 5) AS p(i), unnest(['A','C','G','T','N']) AS x(b)),
f AS (SELECT error, CASE WHEN count(DISTINCT barcode) = 1 THEN min(barcode) END AS barcode FROM e WHERE error NOT IN (SELECT barcode FROM w) GROUP BY error),
j AS (SELECT q.read_id, substr(q.seq, 1, 4) AS raw, w.barcode AS ok, f.error, f.barcode AS fix FROM q LEFT JOIN w ON w.barcode = substr(q.seq, 1, 4) LEFT JOIN f ON f.error = substr(q.seq, 1, 4))
SELECT read_id, coalesce(ok, fix, raw) AS umi, ok IS NULL AND fix IS NOT NULL AS umi_corrected, CASE WHEN ok IS NOT NULL OR fix IS NOT NULL THEN 'reads output' WHEN error IS NOT NULL THEN 'umi error ambiguous' ELSE 'umi not whitelisted' END AS event FROM j""")
def extract_umi_correct(spark, sf_dir):
    options = ExtractOptions(pattern="NNNN", filter_umi=True, correct_umi_threshold=1)
    return extract.extract_reads(_single(spark, sf_dir), options, umi_whitelist=_cells4(spark, sf_dir)).select("read_id", "umi", "umi_corrected", "event")


@query(f"""WITH {_SEEN}, w AS (SELECT cell AS barcode, n FROM s WHERE n > (SELECT n FROM s ORDER BY n DESC, cell LIMIT 1 OFFSET 120)),
x AS (SELECT a.barcode AS cell, b.barcode AS other, hamming(a.barcode, b.barcode) <= 1 AS sub FROM w a JOIN w b ON (a.n < b.n OR (a.n = b.n AND a.barcode > b.barcode)) AND len(list_filter(range(4, 7), lambda i: levenshtein(a.barcode, substr(b.barcode, 1, i::INT)) <= 1)) > 0),
g AS (SELECT cell, count(*) AS hits, min(other) AS barcode, bool_or(sub) AS sub FROM x GROUP BY cell), t AS (SELECT * FROM w WHERE barcode NOT IN (SELECT cell FROM g)),
f AS (SELECT s.cell, min(w.barcode) AS barcode FROM s JOIN w ON hamming(s.cell, w.barcode) <= 1 WHERE s.cell NOT IN (SELECT barcode FROM w) GROUP BY s.cell HAVING count(*) = 1),
m AS (SELECT cell, barcode FROM f UNION ALL SELECT cell, barcode FROM g WHERE hits = 1 AND sub), c AS (SELECT m.barcode, m.cell, s.n FROM m JOIN s ON s.cell = m.cell)
SELECT t.barcode, coalesce(string_agg(c.cell, ',' ORDER BY c.cell), '') AS errors, t.n AS count, coalesce(string_agg(CAST(c.n AS VARCHAR), ',' ORDER BY c.cell), '') AS error_counts FROM t LEFT JOIN c USING (barcode) GROUP BY t.barcode, t.n""")
def whitelist_above_knee_correct(spark, sf_dir):
    seen = _seen(spark, sf_dir).select("cell", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("umi"))
    return whitelist.whitelist(seen, WhitelistOptions(cell_number=120, ed_above_threshold="correct"))


@query(ORACLES["cluster_directional"])
def umi_clusterer_api(spark, sf_dir):
    def grouped(rows):
        groups = UMIClusterer("directional")(dict(zip(rows["umi"], rows["n"], strict=True)), 1)
        return rows.assign(rep=rows["umi"].map({u: g[0] for g in groups for u in g}))

    return _counts(spark, sf_dir, ["contig", "gene"]).groupBy("contig", "gene").applyInPandas(grouped, "contig string, gene string, umi string, n bigint, rep string")
