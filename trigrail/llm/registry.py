"""The queries of this subpackage, opN_<name>, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrail.llm import bpe, conversations, decontaminate, embedding_dedup, filter_audit, language_id, line_dedup, minhash_dedup, quality, store, substring_dedup, suffix_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that every run encodes what it returns."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), store.new_path(spark, "token-cache"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, decoded=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")))
    return out.select("conv_id", *conversations.COUNTS, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_lines(_table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_embedding_near_dedup, op3_token_counts, op4_suffix_dedup, op5_byte_bpe, op6_quality_classifier, op7_substring_dedup, op8_language_id, op9_minhash_near_dedup, op10_toxicity, op11_filter_audit, op12_conversation_repair, op13_line_dedup)}


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM near GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS i FROM w
), h AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS m FROM p
), f AS (
  SELECT m, min(doc_id) AS doc_id FROM h GROUP BY m
), g AS (
  SELECT h.doc_id, h.i, h.doc_id > f.doc_id OR h.i > min(h.i) OVER (PARTITION BY h.m, h.doc_id) AS again FROM h JOIN f USING (m)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM g WHERE again
), each AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w
), kept AS (
  SELECT each.doc_id, each.i, word, gone.i IS NULL AS stays FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.i = each.i
), s AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT stays) AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (stays), '')) AS kept_sha256 FROM kept GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM w LEFT JOIN s USING (doc_id)
"""


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS h FROM p
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), near AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), f AS (
  SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM d
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, i, o[i] AS letter, o[1:i - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS i)
), s AS (
  SELECT part, o, i, letter, n, good, toxic, fails, contains(fails, letter) AS here, before <> '' AND regexp_matches(fails, '[' || before || '0]') AS gone FROM m, steps
), r AS (
  SELECT part, o AS filter_order, CAST(i AS INT) AS step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND here), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND here), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND here), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND here), 0)::BIGINT AS toxic_lost FROM s GROUP BY part, o, i, letter
)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""

OP12_SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 20 AS f
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS k
  FROM base WHERE f <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) AS t,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) > 1 AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS r FROM damaged
), marked AS (
  SELECT *, r = '' AS blank, r <> '' AND seen AS duplicate, r <> '' AND NOT seen AND right(r, 1) NOT IN ('.', '!', '?') AS truncated, left(role, 1) AS i,
    lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY t) AS next_i FROM numbered
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (next_i IS NOT NULL AND i || next_i NOT IN ('su', 'ua', 'au')) AS illegal, max(t) AS n FROM marked GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS t, 'e' AS st, {'c': 0::BIGINT, 'p': '', 'o': []::VARCHAR[]} AS x FROM stats
  UNION ALL
  SELECT conv_id, t, z.st, min({'c': z.c, 'p': z.p, 'o': z.o}) AS x FROM (
    SELECT m.conv_id, m.t, unnest(list_filter([
        {'st': q.st, 'c': q.c + 2, 'p': q.p || 'D', 'o': q.o},
        {'st': CASE WHEN NOT (blank OR duplicate) AND q.st || i IN ('es', 'eu', 'su', 'ua', 'au') THEN i END, 'c': q.c + CASE WHEN truncated THEN 5 ELSE 0 END, 'p': q.p || 'K', 'o': list_append(q.o, role || ':' || text)},
        {'st': CASE WHEN blank OR duplicate THEN NULL WHEN q.st = 'u' THEN 'a' ELSE 'u' END, 'c': q.c + CASE WHEN truncated THEN 6 ELSE 1 END, 'p': q.p || 'R', 'o': list_append(q.o, CASE WHEN q.st = 'u' THEN 'assistant:' ELSE 'user:' END || text)}
      ], lambda y: y.st IS NOT NULL)) AS z
    FROM (
      SELECT conv_id, t, unnest([{'st': st, 'c': x.c, 'p': x.p, 'o': x.o}, {'st': CASE WHEN st = 'u' THEN 'a' ELSE 'u' END, 'c': x.c + 5, 'p': x.p || 'I', 'o': list_append(x.o, CASE WHEN st = 'u' THEN 'assistant:' ELSE 'user:' END)}]) AS q FROM walk
    ) w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.t = w.t + 1
  ) GROUP BY conv_id, t, z.st
), ends AS (
  SELECT s.conv_id, min(CASE WHEN st = 'u' THEN {'c': x.c + 5, 'p': x.p || 'I', 'o': list_append(x.o, 'assistant:')} ELSE {'c': x.c, 'p': x.p, 'o': x.o} END) AS x
  FROM walk w JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.t WHERE st <> 's' GROUP BY s.conv_id
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(x.c, 0) AS cost, coalesce(x.p, '') AS audit, sha256(coalesce(array_to_string(x.o, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), e AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e
), hot AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT doc_id, i, line, key IN (SELECT key FROM hot) AS gone FROM k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": OP2_SQL, "op7_substring_dedup": OP7_SQL, "op9_minhash_near_dedup": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_line_dedup": OP13_SQL}
