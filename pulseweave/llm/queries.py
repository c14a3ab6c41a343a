"""The queries opN_<name> over the whole tables, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embed_dedup, langid, lexical, mixing, ngram_join, packing, quality, repair, token_counts, topk, url_filter
from .scratch import Scratch, table

#: The rules that the URL query judges by: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
EVENNESS, MAX_REPETITION = 0.95, 4.0


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("n_tokens"))
    docs = Scratch(spark, "op1").save(docs, "measured")  # the texts are read once
    out = mixing.mix(docs, n_tokens="n_tokens", evenness=EVENNESS, max_repetition=MAX_REPETITION)
    return out.select("doc_id", "source", "n_tokens", F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_rank").alias("block_rank"), F.round("mix_weight", 6).alias("weight"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id"), 5, 0))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.detect(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).documents


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~langid.held_out(F.col("doc_id"), 4, 2))
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", langid.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.vectors.withColumns({"recall": F.lit(found.recall), "descent_recall": F.lit(found.descent_recall).cast("double")})


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op10_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows damaged by the remainder of a checksum of their conversation and turn, and how often each stands there."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    code, role, text = F.crc32(key.cast("binary")) % 20, F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        code.alias("code"),
    )
    return rows.where(F.col("code") != 0), F.when(F.col("code") == 3, 2).otherwise(1)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows, copies = damaged(conversations)
    fixed = repair.repair(rows, copies=copies)
    out, audits = conversations.select("conv_id").distinct(), repair.digests(fixed.segments).withColumnRenamed("conv", "_conv")
    out = out.join(fixed.conversations, out["conv_id"].eqNullSafe(fixed.conversations["conv"]), "left").drop("conv")
    out = out.join(audits, out["conv_id"].eqNullSafe(audits["_conv"]), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.joined(F.col("ids")), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_token_counts": op5_token_counts,
    "op6_url_filters": op6_url_filters,
    "op7_quality": op7_quality,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_chat_perspectives": op10_chat_perspectives,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_bpe": op12_bpe,
    "op13_ranked_search": op13_ranked_search,
}

_MIX_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens,
         CAST(('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {mixing.BLOCKS} AS block
  FROM documents),
b AS (SELECT source, block, CAST(sum(n_tokens) AS BIGINT) AS block_tokens FROM d GROUP BY 1, 2),
s AS (SELECT source, CAST(sum(block_tokens) AS BIGINT) AS n FROM b GROUP BY 1),
p AS (SELECT source, n, n / CAST((SELECT sum(n) FROM s) AS DOUBLE) AS p FROM s WHERE n > 0),
bis(i, lo, hi, lo2, hi2) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1,
    CASE WHEN e <= {EVENNESS} * ln(k) THEN lo ELSE (lo + hi) / 2 END, CASE WHEN e <= {EVENNESS} * ln(k) THEN (lo + hi) / 2 ELSE hi END,
    CASE WHEN m <= {MAX_REPETITION} THEN lo2 ELSE (lo2 + hi2) / 2 END, CASE WHEN m <= {MAX_REPETITION} THEN (lo2 + hi2) / 2 ELSE hi2 END
  FROM (
    SELECT i, any_value(lo) AS lo, any_value(hi) AS hi, any_value(lo2) AS lo2, any_value(hi2) AS hi2, count(*) AS k,
      ln(sum(pow(p, (lo + hi) / 2))) - any_value((lo + hi) / 2) * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) AS e,
      max(pow(p, (lo2 + hi2) / 2 - 1)) / sum(pow(p, (lo2 + hi2) / 2)) AS m
    FROM bis, p WHERE i < 60 GROUP BY i)),
ends AS (
  SELECT (SELECT ln(count(*)) FROM p) * {EVENNESS} >= ln((SELECT count(*) FROM p)) AS even_at_0,
         (SELECT max(1 / p) / count(*) FROM p) <= {MAX_REPETITION} AS rep_at_0),
a AS (SELECT greatest(CASE WHEN even_at_0 THEN 0 ELSE hi END, CASE WHEN rep_at_0 THEN 0 ELSE hi2 END) AS a FROM bis, ends WHERE i = 60),
w AS (SELECT source, n, round(pow(p, a) / (SELECT sum(pow(p, a)) FROM p, a), 9) AS weight FROM p, a),
t AS (
  SELECT s.source, s.n, coalesce(weight, 0) AS weight, coalesce(weight, 0) * CAST((SELECT sum(n) FROM s) AS DOUBLE) AS aim
  FROM s LEFT JOIN w ON s.source IS NOT DISTINCT FROM w.source),
u AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(round(aim / n, 9)) AS BIGINT) ELSE 1 END AS epochs FROM t),
v AS (SELECT *, greatest(aim - epochs * n, 0) AS rest FROM u),
x AS (
  SELECT b.source, b.block, block_tokens, weight, epochs, rest, unnest(generate_series(0, epochs)) AS epoch
  FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source),
y AS (SELECT *, md5('{mixing.SEED}:' || coalesce(source, '') || ':' || epoch || ':' || block) AS place FROM x),
z AS (
  SELECT *, row_number() OVER q AS block_rank, sum(block_tokens) OVER q AS so_far
  FROM y WINDOW q AS (PARTITION BY source, epoch ORDER BY place, block ROWS UNBOUNDED PRECEDING))
SELECT doc_id, d.source, n_tokens, epoch, d.block, block_rank, round(weight, 6) AS weight
FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source AND d.block = z.block
WHERE epoch < epochs OR (so_far <= rest AND rest > 0)
"""

_URL_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f AS (
  SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC) AS k
  FROM u LEFT JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p))
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN regexp_matches(lower(host || '/' || path), '(^|[^a-z0-9])(adult|casino|porn|xxx|viagra)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM f WHERE k = 1
"""

_TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0 AND len(q.e) = len(c.e)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10
"""

_REPAIR_SQL = r"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
c AS (
  SELECT *, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(8 * length(k)), lambda i: CAST((ord(k[i // 8 + 1]) >> CAST(i % 8 AS INTEGER)) & 1 AS BIGINT))),
    lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384)), 4294967295) % 20 AS code
  FROM o),
d AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE code <> 0),
m AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, left(role, 1) AS r
  FROM d),
f AS (
  SELECT *, blank OR again AS gone, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM m),
n AS (
  SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY 1),
walk(conv_id, i, s, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {'c': CAST(0 AS BIGINT), 'a': '', 'o': ''} FROM n
  UNION ALL
  SELECT conv_id, i + 1, s2, min({'c': c + c2, 'a': a || a2, 'o': o || o2}) FROM (
    SELECT x.conv_id, x.i, x.c, x.a, x.o, unnest([
        {'s2': x.s, 'c2': 4, 'a2': 'D', 'o2': ''},
        {'s2': CASE WHEN gone THEN -1 WHEN r = 's' AND x.s = 0 THEN 1 WHEN r = 'u' AND x.s IN (0, 1, 3) THEN 2 WHEN r = 'a' AND x.s = 2 THEN 3 ELSE -1 END,
         'c2': CASE WHEN cut THEN 3 ELSE 0 END, 'a2': 'K', 'o2': chr(10) || role || ':' || text},
        {'s2': CASE WHEN gone THEN -1 WHEN x.s = 2 THEN 3 ELSE 2 END, 'c2': CASE WHEN cut THEN 6 ELSE 3 END, 'a2': 'R',
         'o2': chr(10) || CASE WHEN x.s = 2 THEN 'assistant:' ELSE 'user:' END || text}], recursive := true)
    FROM (
      SELECT conv_id, i, s, best.c AS c, best.a AS a, best.o AS o FROM walk
      UNION ALL
      SELECT conv_id, i, CASE WHEN s = 2 THEN 3 ELSE 2 END, best.c + 3, best.a || 'I', best.o || chr(10) || CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END FROM walk
      UNION ALL
      SELECT conv_id, i, 3, best.c + 6, best.a || 'II', best.o || chr(10) || 'user:' || chr(10) || 'assistant:' FROM walk WHERE s < 2) x
    JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i + 1)
  WHERE s2 >= 0 GROUP BY 1, 2, 3),
e AS (
  SELECT walk.conv_id, min({'c': best.c + CASE s WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'a': best.a || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'o': best.o || CASE s WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}) AS best
  FROM walk JOIN n ON n.conv_id IS NOT DISTINCT FROM walk.conv_id AND n.n = walk.i GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLE_SQL = {
    "op1_mix_sources": _MIX_SQL,
    "op6_url_filters": _URL_SQL,
    "op9_exact_top_k": _TOP_SQL,
    "op10_chat_perspectives": chat.ORACLE_SQL,
    "op11_conversation_repair": _REPAIR_SQL,
    "op13_ranked_search": lexical.oracle_sql(50),
}
