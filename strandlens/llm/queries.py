"""Queries opN_<name> of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, minhash, mixing, mpegts, packing, pii, quality, sharding, suffix, topk
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents"), key="strandlens-surrogates-1")


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"), temperature=0.5, epochs=1.0, seed=2)


def op3_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op4_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mpegts.media_digest(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("pts", "random_access")})


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=16, seed=20)


def op6_term_at_a_time_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op7_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), threshold=0.5, sample=4096)


def op8_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op9_text_to_tag_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op10_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), size=1024, end_id=2)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_surrogates, op2_poisson_mixing, op3_minhash_components, op4_transport_stream, op5_feistel_shards, op6_term_at_a_time_top_k, op7_weak_label_quality, op8_run_length_index, op9_text_to_tag_pages, op10_swap_packing)}

# Poisson probabilities up to 1,000 copies, enough for rates of some 600.
_OP2 = """
WITH d AS (
  SELECT *, '2|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS who FROM documents),
c AS (SELECT source, CAST(count(*) AS BIGINT) AS n_docs, pow(CAST(count(*) AS DOUBLE), 0.5) AS weight FROM documents GROUP BY source),
r AS (
  SELECT source, round((1.0::DOUBLE * (SELECT sum(n_docs) FROM c)::DOUBLE) * (weight / (SELECT sum(weight) FROM c)) / n_docs, 9) AS rate FROM c),
p AS (
  SELECT source, rate, k, -rate + k * ln(rate) - lgamma(k + 1) AS logp
  FROM r, generate_series(0, 1000) AS g(k) WHERE rate > 0 AND k <= ceil(rate + 12 * sqrt(rate)) + 40),
f AS (SELECT source, rate, k, sum(exp(logp)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT d.*, (CAST('0x' || substr(md5(who), 1, 13) AS BIGINT) + 0.5::DOUBLE) / pow(2, 52) AS u FROM d),
n AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, u.who, any_value(f.rate) AS rate, count(*) FILTER (WHERE f.cdf < u.u) AS copies
  FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source GROUP BY ALL),
x AS (SELECT *, unnest(generate_series(0, copies - 1)) AS copy FROM n WHERE copies > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy, rate,
  (CAST('0x' || substr(md5('order|' || who || '|' || CAST(copy AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / pow(2, 52) AS shuffle_key
FROM x
"""

_OP3 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

_OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


_CRC32 = """table_of(t) AS (SELECT list(c ORDER BY i) FROM (
  SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"""


def _crc32(hexes: str) -> str:
    """SQL: the checksum of bytes in hexadecimal digits, by the table of _CRC32."""
    return f"""CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length({hexes}) // 2), lambda i: CAST('0x' || substr({hexes}, CAST(2 * i + 1 AS INT), 2) AS UBIGINT))),
    lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INT) + 1])), 4294967295::UBIGINT) AS BIGINT)"""


# Transport streams as hexadecimal digits: tables before every fourth unit, units of 32,768 bytes (179 packets if full) with
# a clock of 8 bytes, packets of 184 bytes, stuffing in the last. The tables' sections with their checksums.
_OP4 = f"""
WITH {_CRC32},
d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, doc_id, length(h) // 2 AS n, h || repeat('00', CAST(CASE WHEN h = '' THEN 64 ELSE (64 - length(h) // 2 % 64) % 64 END AS INT)) AS x FROM d),
u AS (SELECT r, u, 90000 + 3600 * u AS pts, substr(x, CAST(u * 65536 + 1 AS INT), 65536) AS data FROM (SELECT r, x, unnest(range((length(x) // 2 + 32767) // 32768)) AS u FROM p)),
e AS (SELECT *, '000001BD' || format('{{:04X}}', length(data) // 2 + 8) || '848005' || format('{{:02X}}{{:02X}}{{:02X}}{{:02X}}{{:02X}}', 33 | ((pts >> 30) << 1), (pts >> 22) & 255, 1 | ((pts >> 14) & 254), (pts >> 7) & 255, 1 | ((pts << 1) & 254)) || data AS pes FROM u),
f AS (SELECT *, greatest(0, 176 - length(pes) // 2) AS stuff, greatest(0, length(pes) // 2 - 176) // 184 AS whole, greatest(0, length(pes) // 2 - 176) % 184 AS tail, u * 179 AS c FROM e),
m AS (SELECT r, u, CASE WHEN u % 4 = 0 THEN '474000' || format('{{:02X}}', 16 | (u // 4 & 15)) || '00' || rpad('00B00D0001C100000001E100E8F95E7D', 366, 'F')
    || '474100' || format('{{:02X}}', 16 | (u // 4 & 15)) || '00' || rpad('02B0120001C10000E101F00006E101F000E406D01F', 366, 'F') ELSE '' END
  || '474101' || format('{{:02X}}', 48 | (c & 15)) || format('{{:02X}}{{:02X}}{{:012X}}', 7 + stuff, CASE WHEN u % 4 = 0 THEN 80 ELSE 16 END, (pts << 15) | 32256) || repeat('FF', CAST(stuff AS INT)) || substr(pes, 1, 352)
  || array_to_string(list_transform(range(whole), lambda k: '470101' || format('{{:02X}}', 16 | ((c + 1 + k) & 15)) || substr(pes, CAST(353 + 368 * k AS INT), 368)), '')
  || CASE WHEN tail > 0 THEN '470101' || format('{{:02X}}', 48 | ((c + 1 + whole) & 15)) || format('{{:02X}}', 183 - tail) || CASE WHEN tail < 183 THEN '00' || repeat('FF', CAST(182 - tail AS INT)) ELSE '' END || substr(pes, CAST(353 + 368 * whole AS INT)) ELSE '' END AS x FROM f),
s AS (SELECT r, string_agg(x, '' ORDER BY u) AS media, count(*) AS units FROM m GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(length(x) // 2 AS BIGINT) AS payload_bytes, sha256(unhex(x)) AS payload_sha256, {_crc32("right(x, 128)")} AS tail_crc32,
  CAST(length(media) // 2 AS BIGINT) AS media_bytes, sha256(unhex(media)) AS media_sha256,
  format('packets={{}};pid=257,type=6,units={{}},pts=90000-{{}},rap={{}},cc=0', length(media) // 376, units, 86400 + 3600 * units, (units + 3) // 4) AS feature,
  array_to_string(list_transform(range(units), lambda i: 90000 + 3600 * i), ',') AS pts, array_to_string(list_transform(range(0, units, 4), lambda i: 90000 + 3600 * i), ',') AS random_access,
  CAST(0 AS INT) AS continuity_errors, CAST(0 AS INT) AS damaged_units
FROM p JOIN s USING (r), table_of
"""


def _network(source: str, keys: list[int]) -> str:
    """SQL: rows (row, p, a) of source with p sent through a Feistel network over 0..a*a-1, one level of
    SELECT for each step, in 128-bit numbers modulo 2**64."""
    word = "18446744073709551616::UHUGEINT"
    sql = f"SELECT row, a, p // a AS l, p % a AS r FROM ({source})"
    for key in keys:
        sql = f"SELECT row, a, l, r, (r + {key}::UHUGEINT) % {word} AS x FROM ({sql})"
        sql = f"SELECT row, a, l, r, xor(x, x // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT % {word} AS x FROM ({sql})"
        sql = f"SELECT row, a, l, r, xor(x, x // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT % {word} AS x FROM ({sql})"
        sql = f"SELECT row, a, r AS l, (l + xor(x, x // 2147483648::UHUGEINT) % a) % a AS r FROM ({sql})"
    return f"SELECT row, l * a + r AS p, a FROM ({sql})"


_KEYS = [int(k) for k in sharding.round_keys(20)]
_OP5 = f"""
WITH RECURSIVE {_CRC32},
b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
  {_crc32("h")} AS text_crc32 FROM b, table_of),
n AS (SELECT *, CAST(row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS row_number FROM d),
c AS (SELECT count(*)::UHUGEINT AS n, CAST(ceil(sqrt(count(*))) AS UHUGEINT) AS a FROM documents),
walk AS (
  {_network("SELECT row_number::UHUGEINT AS row, row_number::UHUGEINT AS p, a FROM n, c", _KEYS)}
  UNION ALL {_network("SELECT row, p, walk.a FROM walk, c WHERE p >= c.n", _KEYS)})
SELECT doc_id, size, text_crc32, 'rows' AS law, row_number, CAST(p % 16 AS INT) AS shard, CAST(p // 16 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM n JOIN walk ON walk.row = n.row_number::UHUGEINT JOIN c ON walk.p < c.n
"""

_OP8 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5_number(substr(h, CAST(2 * i + 1 AS INT), 400)) AS k FROM (SELECT r, h, unnest(range(greatest(length(h) // 2 - 199, 0))) AS i FROM d)),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
g AS (SELECT r, i, sum(CASE WHEN i - prev <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS island FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS prev FROM s)),
p AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY r, island),
q AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS after FROM p),
k AS (SELECT r, string_agg(substr(h, CAST(2 * after + 1 AS INT), CAST(2 * (lo - after) AS INT)), '' ORDER BY lo) AS head, max(hi) AS hi, sum(hi - lo) AS gone, count(*) AS spans FROM q JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(hi, 0) + 1 AS INT)))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

# The article of the tables' pages by plain replacement; what a page's markup doesn't mark is left to the tests.
_OP9 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(x, '(?s)<(script|style|aside|form|nav|footer)\b.*?</(script|style|aside|form|nav|footer)>|<!--.*?-->|<div class="ad">.*?</div>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(x, '<br\b[^>]*>', ' ', 'g'), '</?(p|h\d|div|ul|ol|li|table|tr|td|th|blockquote|pre|section|figure|figcaption)\b[^>]*>') AS x FROM b),
t AS (SELECT page_id, url, list_filter(list_transform(x, lambda l: trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(l, '<[a-zA-Z/][^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))), lambda l: l <> '') AS x FROM c)
SELECT page_id, url, array_to_string(x, chr(10)) AS text, CAST(length(array_to_string(x, chr(10))) AS BIGINT) AS n_chars FROM t
"""

ORACLES: dict[str, str] = {"op2_poisson_mixing": _OP2, "op3_minhash_components": _OP3, "op4_transport_stream": _OP4, "op5_feistel_shards": _OP5, "op6_term_at_a_time_top_k": _OP6, "op8_run_length_index": _OP8, "op9_text_to_tag_pages": _OP9}
