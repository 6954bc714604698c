"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import alignment, bpe, chunkdedup, cotrain, licenses, linededup, mixing, ngramlm, prefixtrie, simhash, tokencounts, topk, toxicity
from clauseloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def in_fold(folds: int, fold: int) -> Column:
    """Whether crc32 of the doc_id as text leaves ``fold``; a null doc_id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


@query("op1_mix_sources", r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, 2 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM totals),
filled AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS cap_before, coalesce(sum(weight) OVER before, 0) AS weight_before,
    sum(source_size) OVER () AS all_words, sum(weight) OVER () AS weights FROM weighed
  WINDOW before AS (ORDER BY cap * 6 // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT 3 * all_words - 2 * cap_before AS spare, weights - weight_before AS rest FROM filled
  WHERE (3 * all_words - 2 * cap_before) * weight <= 2 * cap * (weights - weight_before) ORDER BY weight_before, cap_before LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, (weight * spare)::DOUBLE / (2 * rest)::DOUBLE) AS target,
    (('0x' || substr(md5('7:' || coalesce('s' || source, 'null')), 1, 8))::BIGINT >> 6) AS u FROM filled, level),
placed AS (
  SELECT doc_id, size, source_size, target, u, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS place,
    CASE WHEN source_size > 0 THEN floor(target / source_size * 67108864 + 0.5)::BIGINT ELSE 0 END AS step
  FROM sizes JOIN targets USING (source) UNION ALL
  SELECT doc_id, size, source_size, target, u, row_number() OVER (ORDER BY size, doc_id) - 1,
    CASE WHEN source_size > 0 THEN floor(target / source_size * 67108864 + 0.5)::BIGINT ELSE 0 END
  FROM (SELECT * FROM sizes WHERE source IS NULL), (SELECT * EXCLUDE (source) FROM targets WHERE source IS NULL)),
dealt AS (SELECT *, (((place + 1) * step + u) >> 26) - ((place * step + u) >> 26) AS copies FROM placed)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM dealt""")
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op2_quality_cotrain")
def op2_quality_cotrain(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scores = cotrain.score(docs, cotrain.fit(docs, table(spark, folder, "labels")))
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op3_top_k", """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0)
SELECT query_id, r::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores) WHERE r <= 10""")
def op3_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(topk.whole_vectors(table(spark, folder, "embeddings")), F.col("vec_id") % 100 == 0)


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def _license_sql() -> str:
    rows = ", ".join(f"({i}, '{name}', '{' '.join(licenses.template_words(text))}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
    return rf"""
WITH templates(t, name, words) AS (VALUES {rows}),
normal AS (SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS n FROM documents),
units AS (
  SELECT doc_id, trim(u) AS u FROM (SELECT doc_id, unnest(string_split(n, chr(10))) AS u FROM normal) UNION ALL
  SELECT doc_id, replace(p, chr(10), ' ') FROM (SELECT doc_id, trim(unnest(string_split_regex(n, '\n{{2,}}')), chr(10)) AS p FROM normal)
  WHERE contains(trim(p), chr(10))),
numbered AS (SELECT row_number() OVER () AS k, doc_id, string_split(u, ' ') AS w FROM units),
sized AS (SELECT * FROM numbered WHERE len(w) BETWEEN 2 AND 300),
pairs AS (SELECT k, doc_id, p, count(*) AS c FROM (SELECT k, doc_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS p FROM sized) GROUP BY ALL),
template_pairs AS (SELECT t, name, p, count(*) AS c FROM (
  SELECT t, name, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS p FROM (SELECT t, name, string_split(words, ' ') AS w FROM templates))
  GROUP BY ALL),
common AS (SELECT k, t, sum(least(a.c, b.c)) AS shared FROM pairs a JOIN template_pairs b USING (p) GROUP BY k, t),
sizes AS (SELECT k, doc_id, len(w) - 1 AS size FROM sized),
found AS (
  SELECT k, doc_id, name, 2 * shared::DOUBLE / (size + len(string_split(words, ' ')) - 1) AS dice
  FROM common JOIN sizes USING (k) JOIN templates USING (t) WHERE 2 * shared::DOUBLE / (size + len(string_split(words, ' ')) - 1) >= {licenses.LEAST}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dice DESC, name) AS r FROM found) WHERE r = 1),
grouped AS (SELECT doc_id, list_sort(list(DISTINCT name)) AS licenses, count(*) AS n_matches, first(name ORDER BY dice DESC, name) AS best_license,
  max(dice) AS best_dice FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, []) AS licenses, coalesce(n_matches, 0) AS n_matches, best_license, best_dice
FROM documents LEFT JOIN grouped USING (doc_id)"""


@query("op5_license_scan", _license_sql())
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    net = toxicity.fit(docs, labels.where(~in_fold(4, 2)))
    scores = toxicity.score(docs, net)
    return scores.select("doc_id", in_fold(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "toxic")


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.deduplicated_lines(table(spark, folder, "documents"))


@query("op8_bpe_round_trip")
def op8_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op9_exact_dedup", """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(norm) AS text_sha256
FROM n WINDOW same AS (PARTITION BY norm)""")
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunkdedup.exact_duplicates(table(spark, folder, "documents"))


@query("op10_lm_score")
def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return ngramlm.score(table(spark, folder, "documents").withColumn("held_out", in_fold(5, 1)))


@query("op12_conversation_trie", """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, max(pos) AS n FROM turns GROUP BY c),
convs AS (
  SELECT own.c, own.c - own.c % 100 AS base, xor(4294967295, list_reduce(list_transform(string_split(own.c::VARCHAR, ''), lambda x: ord(x)::BIGINT),
    lambda a, x: list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(a, x)), 4294967295)) % 6 AS h FROM own),
lent AS (SELECT convs.*, least(h, coalesce(own.n, 0)) AS k FROM convs LEFT JOIN own ON own.c = base),
rebuilt AS (
  SELECT lent.c, pos, role, text FROM lent JOIN turns ON turns.c = base AND pos <= h UNION ALL
  SELECT lent.c, pos - h + k, role, text FROM lent JOIN turns ON turns.c = lent.c AND pos > h),
lists AS (SELECT c, list({'role': role, 'text': text} ORDER BY pos) AS s FROM rebuilt GROUP BY c),
whole AS (SELECT own.c, coalesce(s, []) AS s FROM own LEFT JOIN lists USING (c)),
members AS (SELECT c, d, len(s) = d AS ended, s[1:d] AS p FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM whole)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(length(p[d].text), 0) AS size,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256 FROM members GROUP BY p, d),
kin AS (SELECT a.p, count(*) AS n_children FROM nodes n JOIN nodes a ON a.d = n.d - 1 AND a.p = n.p[1:n.d - 1] GROUP BY a.p),
valued AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kin USING (p)),
sums AS (
  SELECT a.p, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM valued) n JOIN nodes a ON a.d = k AND a.p = n.p[1:k] GROUP BY a.p)
SELECT v.conv_id, v.d AS depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums USING (p) LEFT JOIN nodes up ON up.d = v.d - 1 AND up.p = v.p[1:v.d - 1]""")
def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixtrie.conversation_trie(table(spark, folder, "conversations"))


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokencounts.prefix_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokencounts.digests(counted, 2048)


@query("op11_align_tokens")
def op11_align_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.path("piece_bpe_32k.model"))
