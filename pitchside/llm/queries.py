"""The registered queries of the operators, over whole tables, and DuckDB SQL where SQL can express them.

Each query gets its rows from its operator and derives the columns it returns from the operator's output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm import chat, decontaminate, fixity, hard_negatives, lang_id, near_dup, neighbours, packing, pii, quality, sharding, source_divergence, token_counts
from pitchside.llm.common import table

#: Tokens of a text over which op2 reports it, length of op8's sequences.
TOKEN_LIMIT, SEQUENCE = 2048, 1024


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(table(spark, sf_dir, "conversations"))


def op2_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_counts.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), (TOKEN_LIMIT,))
    n = F.element_at("counts", -1).cast("long")
    return got.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > TOKEN_LIMIT).alias("over_limit"), F.col("fits")[0].alias("chars_within_limit"))


def op3_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def archive(pages: DataFrame) -> DataFrame:
    """Pages as WARC records (page_id, file, offset, payload), 256 ids a file, in the order of the ids."""
    body = F.coalesce("html", F.lit(""))
    record = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
                      F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))
    r = pages.select("page_id", F.expr("concat('part-', cast(page_id div 256 as string))").alias("file"), record.alias("payload"))
    before = "PARTITION BY file ORDER BY page_id, payload ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return r.select("page_id", "file", F.expr(f"coalesce(sum(octet_length(payload)) OVER ({before}), 0L)").alias("offset"), "payload")


def op4_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the archive of all pages. By the ids: the first lacks one record in 101, the second lacks one in 89,
    has one in 97 with its last letter changed and one in 83 cut short."""
    r = archive(table(spark, sf_dir, "pages"))
    a = r.where("page_id * 7919 % 101 <> 3")
    damaged = F.expr("""CASE WHEN page_id * 7919 % 97 = 0 THEN concat(left(payload, length(payload) - 5), '#', right(payload, 4))
                             WHEN page_id * 7919 % 83 = 2 THEN left(payload, length(payload) div 2) ELSE payload END""")
    b = r.where("page_id * 7919 % 89 <> 1").withColumn("payload", damaged)
    return fixity.audit(a, b)


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    got = sharding.interleaved(docs, shards=40)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "hkey")


def op9_stable_projection_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.languages(table(spark, sf_dir, "documents"))


def op11_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.personal_data(table(spark, sf_dir, "documents"))
    joined = lambda spans: f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return got.selectExpr("doc_id", *[f"CAST(size(filter(spans, s -> s.base AND s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in pii.KINDS],
                          f"sha2({joined('filter(spans, s -> s.base)')}, 256) AS base_sha256", f"{joined('spans')} AS spans",
                          "CAST(size(filter(spans, s -> NOT s.base)) AS BIGINT) AS n_added")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives.mined(vectors, vectors.where("vec_id % 100 = 0"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_perspective_rotation, op2_prefix_token_counts, op3_grouped_prefix_join, op4_merkle_fixity_audit, op5_template_decontamination,
    op6_stratified_interleaving, op7_subword_quality, op8_hilbert_packing, op9_stable_projection_neighbours, op10_crf_language, op11_semi_markov_pii, op12_hard_negatives, op13_source_divergence)}

ORACLE = {
    "op1_perspective_rotation": """
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
j AS (
  SELECT t.*, who.perspective,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN who ON t.conv_id IS NOT DISTINCT FROM who.conv_id),
h AS (
  SELECT *, CASE WHEN role = 'user' THEN '<|im_start|>user name=' || speaker || chr(10) ELSE '<|im_start|>' || role || chr(10) END AS head FROM j),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (
  SELECT *, row_number() OVER w - 1 AS seq,
    coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, speaker, role, segment, CAST(start AS BIGINT) AS start,
  CAST(start + length(segment) AS BIGINT) AS stop,
  CAST(CASE WHEN role = 'assistant' THEN start + length(head) END AS BIGINT) AS train_start,
  CAST(CASE WHEN role = 'assistant' THEN start + length(segment) END AS BIGINT) AS train_stop
FROM o""",
    "op4_merkle_fixity_audit": """
WITH r AS (
  SELECT page_id, 'part-' || CAST(page_id // 256 AS VARCHAR) AS file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
      || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS payload
  FROM pages),
p AS (
  SELECT *, CAST(coalesce(sum(strlen(payload)) OVER (PARTITION BY file ORDER BY page_id, payload
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r),
a AS (SELECT file, "offset", strlen(payload) AS length_a, sha256(payload) AS digest_a FROM p WHERE page_id * 7919 % 101 <> 3),
d AS (
  SELECT file, "offset", CASE WHEN page_id * 7919 % 97 = 0 THEN left(payload, length(payload) - 5) || '#' || right(payload, 4)
                              WHEN page_id * 7919 % 83 = 2 THEN left(payload, length(payload) // 2) ELSE payload END AS payload
  FROM p WHERE page_id * 7919 % 89 <> 1),
b AS (SELECT file, "offset", strlen(payload) AS length_b, sha256(payload) AS digest_b FROM d)
SELECT file, "offset", CASE WHEN digest_b IS NULL THEN 'missing' WHEN digest_a IS NULL THEN 'extra' ELSE 'corrupt' END AS status,
  length_a, length_b, digest_a, digest_b
FROM a FULL JOIN b USING (file, "offset") WHERE digest_a IS DISTINCT FROM digest_b""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
r AS (
  SELECT vec_id, label, [floor(256 * x) FOR x IN e] AS q FROM v
  WHERE len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10""",
    "op13_source_divergence": """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
lt AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gt AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (gt.total + 2 * lt.v))::BIGINT AS p,
        (1 + (1000000000 * (k.n + 2)) // (lt.total + 2 * lt.v))::BIGINT AS q
      FROM gt JOIN k USING (lang) JOIN lt USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(pv.value, 0) AS value
          FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pv ON pv.lang = x.lang AND pv.source = x.source AND pv.item = y.source),
tv AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
           UNION ALL
           SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM tv) WHERE rank <= 10)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked""",
}
