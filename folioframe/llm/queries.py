"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe_count, chat, decontam, packing, repair_turns, sharding, simhash, toxicity, unigram, warc, wavelet
from .common import table, written


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    messages = written(chat.linear_messages(rows.unionByName(extra)), "chat-linear")
    return chat.digest(chat.read_back(chat.conversations(messages)))


def op5_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `key`; the digest columns come from the written shards."""
    back = sharding.external_shuffle(table(spark, sf_dir, "documents"), shards=8)
    return back.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op10_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return wavelet.read_shards(manifest)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_turns.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_simhash, op3_neighbours, op4_chat, op5_unigram, op6_toxicity, op7_token_counts, op8_sharding, op9_decontamination, op10_wavelet_ids, op11_structure_repair, op12_packing, op13_alignment)}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
""",
    "op4_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS er, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS et FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(er) + length(et)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n AS n, s, item_id FROM dw JOIN win ON dw.win = win.win AND dw.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op11_structure_repair": r"""
WITH RECURSIVE crc8(b, j, x) AS (
  SELECT range, 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, j + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END FROM crc8 WHERE j < 8),
crc AS (SELECT b, x FROM crc8 WHERE j = 8),
raw AS (
  SELECT row_number() OVER () AS n, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
sums(n, k, j, x) AS (
  SELECT n, k, 0, CAST(4294967295 AS BIGINT) FROM raw
  UNION ALL SELECT n, k, j + 1, xor(sums.x // 256, crc.x) FROM sums JOIN crc ON crc.b = xor(sums.x % 256, CAST(ascii(substr(k, j + 1, 1)) AS BIGINT)) WHERE j < length(k)),
kinds AS (SELECT n, xor(x, 4294967295) % 20 AS kind FROM sums WHERE j = length(k)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw JOIN kinds USING (n) WHERE kind <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, substr(role, 1, 1) AS c
  FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'clean' END AS fault,
    lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair
  FROM ordered),
chains(q, p, cost, audit, said) AS (
  VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'),
    (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 0, '', ''), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:')),
steps(p, r, role, initial) AS (VALUES (0, 1, '', 's'), (0, 2, 'user', 'u'), (1, 2, 'user', 'u'), (2, 3, 'assistant', 'a'), (3, 2, 'user', 'u')),
row_edits AS (
  SELECT conv_id, i, p, r, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cost, 'K' AS audit, chr(10) || f.role || ':' || text AS said FROM faulty f JOIN steps ON c = initial WHERE fault IN ('clean', 'truncated')
  UNION ALL SELECT conv_id, i, p, r, 2 + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'R', chr(10) || s.role || ':' || text FROM faulty, steps s WHERE fault IN ('clean', 'truncated') AND s.role <> ''
  UNION ALL SELECT conv_id, i, q, q, 3, 'D', '' FROM faulty, (SELECT unnest([0, 1, 2, 3]) AS q)),
dp(conv_id, i, q, cost, audit, said) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, 0, '', '' FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, q, cost, audit, said FROM (
    SELECT dp.conv_id, dp.i + 1 AS i, e.r AS q, dp.cost + h.cost + e.cost AS cost, dp.audit || h.audit || e.audit AS audit, dp.said || h.said || e.said AS said,
      row_number() OVER (PARTITION BY dp.conv_id, e.r ORDER BY dp.cost + h.cost + e.cost, dp.audit || h.audit || e.audit) AS best
    FROM dp JOIN chains h ON h.q = dp.q JOIN row_edits e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.i = dp.i + 1 AND e.p = h.p)
  WHERE best = 1),
lengths AS (SELECT c.conv_id, count(f.i) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
ended AS (
  SELECT dp.conv_id, dp.cost + h.cost AS cost, dp.audit || h.audit AS audit, dp.said || h.said AS said,
    row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + h.cost, dp.audit || h.audit) AS best
  FROM dp JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM dp.conv_id AND l.n = dp.i JOIN chains h ON h.q = dp.q AND h.p IN (0, 3)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(cost AS BIGINT) AS cost, audit, sha256(substr(said, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM e.conv_id WHERE best = 1
""",
}
