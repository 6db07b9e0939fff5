"""The thin queries of the operators, and SQL for those it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, fim, licenses, mixing, nearest, packing, quality, simhash, token_counts, toxicity, trie, warc, wrappers
from .common import table

#: Production parameters.
TOKEN_LIMIT = 512
CAPACITY = 2048
NEIGHBOURS = 20
QUERY_STEP = 20
MIN_COSINE = 0.9
LEAST_REVISITED = 0
REBUILT_GROUP, REBUILT_TURNS = 5, 9


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = token_counts.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)
    return t.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "cut_chars")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    files = docs.select("doc_id", F.concat_ws("/", F.lit(""), part("source"), part("lang"), F.concat(part("doc_id"), F.lit(".txt"))).alias("path"), "text")
    return licenses.license_scan(files, "doc_id", "path", "text").select(F.col("id").alias("doc_id"), "license", F.round("score", 6).alias("score"), "origin")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.digest(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.get("neighbours", F.lit(0)).getField("id").alias("nearest_id"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0, NEIGHBOURS)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "evidence", "host_prior", "path_prior", "posterior", "kept")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), MIN_COSINE)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = wrappers.main_text(table(spark, sf_dir, "pages"))
    return t.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    back = warc.digests(warc.read_packages(warc.write_packages(pages, "page_id", LEAST_REVISITED)))
    return back.select(F.col("source").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"), REBUILT_GROUP, REBUILT_TURNS)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(*fim.outputs(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_license_scans, op3_mixing, op4_toxicity, op5_simhash, op6_nearest, op7_quality, op8_embedding_dedup, op9_html_extraction, op10_packing, op11_warc, op12_conversation_trie, op13_fill_in_middle)}

_MIXING_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS h
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source
), kinds AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM src
), weighed AS (
  SELECT *, CASE kind WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3 AS cap FROM kinds
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS DOUBLE)
            / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0)) AS level
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, kind, least(CAST(cap AS DOUBLE), w * max(level) OVER ()) AS target FROM levels
), streams AS (
  SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM base
), passes AS (
  SELECT s.*, g.source_size, g.kind, g.target, CAST(floor(g.target) AS BIGINT) AS wanted,
         CASE WHEN g.source_size > 0 THEN CAST(floor(g.target) AS BIGINT) // g.source_size ELSE 0 END AS passes
  FROM streams s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), lasts AS (
  SELECT *, greatest(0, least(size, wanted - passes * source_size - start)) AS last FROM passes
), took AS (
  SELECT *, CAST(passes * size + last AS BIGINT) AS taken,
         least((CAST(start AS DOUBLE) + CAST(CASE WHEN passes > 0 THEN size ELSE last END AS DOUBLE) / 2) / nullif(target, 0), 1.0::DOUBLE) AS share
  FROM lasts
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(CASE kind
         WHEN 0 THEN CASE WHEN share >= 0.625 THEN 0.5 + 2 * (share - 0.625) / (1.0 + sqrt(greatest(1.0 - 2 * (share - 0.625), 0.0::DOUBLE)))
                          ELSE 2 * share / (1.5 + sqrt(greatest(2.25 - 2 * share, 0.0::DOUBLE))) END
         WHEN 1 THEN share
         ELSE CASE WHEN share >= 0.375 THEN 0.5 + 2 * (share - 0.375) / (1.0 + sqrt(1.0 + 2 * (share - 0.375)))
                   ELSE 2 * share / (0.5 + sqrt(0.25 + 2 * share)) END END, 6) END AS position
FROM took
"""

_FIM_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), lines AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM base
), forms AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM lines
), cuts AS (
  SELECT *, coalesce(array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], ''), '') AS p, coalesce(array_to_string(u[1:greatest(h1 % (n + 1), h2 % (n + 1))], ''), '') AS pm FROM forms
), parts AS (
  SELECT *, substr(pm, length(p) + 1) AS m, substr(t, length(pm) + 1) AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

_TRIE_SQL = r"""
WITH raw AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS own,
         xor(list_reduce(list_transform(range(len(CAST(conv_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i + 1 AS INT), 1)) AS BIGINT)),
           lambda a, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)), xor(a, x)), 4294967295::BIGINT), 4294967295) % 9 AS h
  FROM raw GROUP BY conv_id
), plans AS (
  SELECT c.*, least(c.h, coalesce(b.own, 0)) AS head FROM convs c LEFT JOIN convs b ON b.conv_id = c.base
), built AS (
  SELECT p.conv_id, r.pos + 1 AS depth, r.role, r.text FROM plans p JOIN raw r ON r.conv_id = p.base AND r.pos < p.h
  UNION ALL
  SELECT p.conv_id, p.head + r.pos - p.h + 1, r.role, r.text FROM plans p JOIN raw r ON r.conv_id = p.conv_id AND r.pos >= p.h
), paths AS (
  SELECT conv_id, depth, string_agg(sha256(length(role) || ':' || role || text), '/') OVER (PARTITION BY conv_id ORDER BY depth) AS path, strlen(text) AS bytes FROM built
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), lengths AS (
  SELECT conv_id, max(depth) AS len FROM paths GROUP BY conv_id
), nodes AS (
  SELECT depth, path, min(p.conv_id) AS node, count(*) AS n, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(CASE WHEN l.len = p.depth THEN CAST(p.conv_id AS VARCHAR) END, ',' ORDER BY p.conv_id), '')) AS ends
  FROM paths p JOIN lengths l ON l.conv_id = p.conv_id GROUP BY depth, path
), member AS (
  SELECT p.conv_id, p.depth, n.node FROM paths p JOIN nodes n ON n.depth = p.depth AND n.path = p.path
), kids AS (
  SELECT m.node AS parent, n.depth - 1 AS depth, count(*) AS children FROM nodes n JOIN member m ON m.conv_id = n.node AND m.depth = n.depth - 1 GROUP BY ALL
), facts AS (
  SELECT n.*, m.node AS parent, coalesce(k.children, 0) AS children
  FROM nodes n LEFT JOIN member m ON m.conv_id = n.node AND m.depth = n.depth - 1 LEFT JOIN kids k ON k.parent = n.node AND k.depth = n.depth
), trees AS (
  SELECT m.node, m.depth, sum(CASE WHEN f.children = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n - 1) * f.bytes) AS saved
  FROM facts f JOIN member m ON m.conv_id = f.node AND m.depth <= f.depth GROUP BY ALL
)
SELECT f.node AS conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.children AS n_children, CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM facts f JOIN trees t ON t.node = f.node AND t.depth = f.depth
"""

_WARC_SQL = r"""
WITH rows_ AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), ranked AS (
  SELECT *, first_value(page_id) OVER w AS first, row_number() OVER w AS r FROM rows_ WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS FIRST)
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) % 32 AS INT), 1)), '') AS payload_digest,
       CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN first END AS refers_to
FROM ranked
"""

ORACLE_SQL = {"op3_mixing": _MIXING_SQL, "op11_warc": _WARC_SQL, "op12_conversation_trie": _TRIE_SQL, "op13_fill_in_middle": _FIM_SQL}
