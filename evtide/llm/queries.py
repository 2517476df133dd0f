"""The registered queries of the corpus operators and their SQL twins.

Each query runs its operator with production parameters over its whole table
and derives the digest columns of its contract from the operator's rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from evtide.llm import (alignment, fingerprints, license_scan, line_dedup, nearest, packing,
                        pieces, prefix_trie, quality, secret_scan, simhash_dedup, url_filter, warc)
from evtide.llm.common import sha256_of, table

# The rules of the contract (host, path, verdict).
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"),
             ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
             ("com", "/de/", "block"))
WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_VOCABULARY = "byte_bpe_50k.json"
END_ID = 1


def op1_url_filter(spark, sf_dir):
    """Verdict of every page's URL by the longest fitting rule."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op2_hilbert_packing(spark, sf_dir):
    """Pieces of all documents in sequences of 2048 tokens along the curve."""
    return packing.pack(table(spark, sf_dir, "documents"),
                        public_tokenizers.path(WORD_VOCABULARY), 2048, END_ID).drop("ids")


def op3_license_scan(spark, sf_dir):
    """License phrases and template matches in every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op4_document_fingerprints(spark, sf_dir):
    """SimHash of every document and of its edited text, and their likeness;
    for the query set (every 50th doc_id) also how many other fingerprints of
    the table the block tables find within three bits (n_near, else null)."""
    out = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    asked = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    near = (fingerprints.within_radius(out.where(asked), out, 3)
            .groupBy("query").agg(F.count(F.lit(1)).alias("n")))
    return out.join(near, asked & (F.col("fp") == F.col("query")), "left").select(
        "doc_id", "n_chars", "edited_sha256",
        simhash_dedup.hex_digits("fp").alias("fingerprint"),
        simhash_dedup.hex_digits("edited_fp").alias("edited_fingerprint"),
        "near_edited", "near_next",
        F.when(asked, F.coalesce("n", F.lit(0).cast("bigint"))).alias("n_near"))


def op5_quality_classifier(spark, sf_dir):
    """Quality score of every document, learnt outside the held-out fold."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark, sf_dir):
    """Secrets in every document, counts and digest of the base kinds."""
    spans = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]

    def joined(col):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [count(k).alias(f"n_{k}") for k in base]
    return spans.select("doc_id", *counts, sha256_of(joined(of_base)).alias("base_sha256"),
                        joined("spans").alias("spans"))


def op7_simhash_near_dedup(spark, sf_dir):
    """Fingerprint of every document and the smallest doc_id its links reach."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash_dedup.hex_digits("fp").alias("fingerprint"), "component_id")


def op8_sentencepiece(spark, sf_dir):
    """Piece ids and decoded text of every document, as digests."""
    return pieces.encode_digests(table(spark, sf_dir, "documents"),
                                 public_tokenizers.path(PIECE_MODEL))


def op9_nearest_neighbours(spark, sf_dir):
    """The 20 nearest vectors of every 20th, by inner product."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_line_dedup(spark, sf_dir):
    """Every document without the lines it shares with two others or more."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", sha256_of("kept").alias("kept_sha256"))


def op11_prefix_trie(spark, sf_dir):
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark, sf_dir):
    """Groups and links between the two tokenizers' tokens in every document."""
    return alignment.align(table(spark, sf_dir, "documents"),
                           public_tokenizers.path(BYTE_VOCABULARY),
                           public_tokenizers.path(PIECE_MODEL))


def op13_warc(spark, sf_dir):
    """Every page, written to WARC archives and read back."""
    pages = table(spark, sf_dir, "pages")
    return warc.round_trip(pages, warc.stored_place(pages))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_hilbert_packing, op3_license_scan, op4_document_fingerprints,
    op5_quality_classifier, op6_secret_scan, op7_simhash_near_dedup, op8_sentencepiece,
    op9_nearest_neighbours, op10_line_dedup, op11_prefix_trie,
    op12_token_alignment, op13_warc)}
QUERIES["pipeline"] = corpus_pipeline.run

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op1_url_filter": rf"""
WITH cut AS (
  SELECT page_id, row_number() OVER () AS n,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
              ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')
           AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rhost, rpath, verdict) AS (VALUES {_RULE_ROWS}),
fits AS (
  SELECT n, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost))
                       AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)""",
    "op10_line_dedup": rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS n, string_split(coalesce(text, ''), chr(10))
                     AS lines FROM documents),
rows AS (
  SELECT doc_id, n, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{_UPPER}', '{_LOWER}') AS key FROM rows),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {line_dedup.MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
judged AS (
  SELECT k.*, keeper IS NOT NULL AND k.doc_id IS DISTINCT FROM keeper AS lost
  FROM keyed k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), ''))
         AS kept_sha256
FROM judged GROUP BY doc_id, n""",
    # crc32 of the decimal id, bit by bit, then every member of every node
    "op11_prefix_trie": r"""
WITH ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
           [4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''),
                                                  lambda x: ascii(x)::BIGINT),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(
           length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT i.conv_id, role, text, 0 AS part, pos FROM ids i JOIN turns t ON t.conv_id = i.base
  WHERE pos <= h
  UNION ALL SELECT i.conv_id, role, text, 1, pos FROM ids i JOIN turns t USING (conv_id)
  WHERE pos > h),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, text, count(*) OVER (PARTITION BY conv_id) AS n,
         sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
                OVER (w ROWS UNBOUNDED PRECEDING)) AS node
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
members AS (
  SELECT s.conv_id, s.depth, s.node, coalesce(p.node, 'root') AS parent,
         len(regexp_extract_all(s.text, '[^\x20\x09-\x0D]+')) AS words, s.n = s.depth AS ends
  FROM steps s LEFT JOIN steps p ON p.conv_id = s.conv_id AND p.depth = s.depth - 1
  UNION ALL SELECT conv_id, 0, 'root', NULL, 0, conv_id NOT IN (SELECT conv_id FROM rebuilt)
  FROM ids),
nodes AS (
  SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent,
         any_value(words) AS words, count(*) AS n_convs, sha256(coalesce(
           string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY node),
kids AS (SELECT parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
subtrees AS (
  SELECT DISTINCT top.node AS top, sub.node AS sub
  FROM members top JOIN members sub ON top.conv_id = sub.conv_id AND top.depth <= sub.depth),
sums AS (
  SELECT top, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
         sum((x.n_convs - 1) * x.words)::BIGINT AS saved_tokens
  FROM subtrees s JOIN nodes x ON x.node = s.sub LEFT JOIN kids k ON k.parent = x.node
  GROUP BY top)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children,
       n_leaves, saved_tokens, x.ends_sha256
FROM nodes x JOIN sums ON top = x.node LEFT JOIN nodes p ON p.node = x.parent
LEFT JOIN kids k ON k.parent = x.node""",
    # base32: every five hexadecimal digits are four letters
    "op13_warc": r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS k,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages)
SELECT page_id, strlen(payload) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, i // 4 * 5 + 1, 5))::BIGINT >> (15 - i % 4 * 5)) & 31) + 1, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN first_id END AS refers_to
FROM payloads""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
