"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import tune


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.mixing import mix_plan

    plan = mix_plan(_docs(spark, sf_dir, "doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.embeddings import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.licenses import scan_licenses

    return scan_licenses(_docs(spark, sf_dir, "doc_id", "text")).drop("spans")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.suffixes import passage_digest, repeated_passages

    return passage_digest(repeated_passages(_docs(spark, sf_dir, "doc_id", "text")))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.minhash import near_documents

    return near_documents(_docs(spark, sf_dir, "doc_id", "text"), 85)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.quality import score_quality

    return score_quality(_docs(spark, sf_dir, "doc_id", "text"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(_docs(spark, sf_dir, "doc_id", "text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.pii import span_digest

    return span_digest(_docs(spark, sf_dir, "doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from granary.llm.packing import pack, token_pieces

    pieces = token_pieces(_docs(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.toxicity import score_documents

    return score_documents(_docs(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP1_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1.0::DOUBLE + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
  FROM s GROUP BY source),
wide AS (SELECT *, source_size * 3.0::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM wide WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fill AS (SELECT arg_min(level, cap / weight) AS level FROM levels WHERE cap / weight >= level),
targets AS (SELECT l.source, l.source_size, least(l.cap, l.weight * f.level) AS target FROM levels l, fill f),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 1e-6)::BIGINT AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, whole // source_size) ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, whole - epochs * source_size - ahead)))::BIGINT AS taken
FROM cut
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"words AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents)"
OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         coalesce(vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
                  AND list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS usable
  FROM embeddings),
edges AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.usable AND b.usable AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93),
reach AS (SELECT u AS id, u AS hit FROM edges UNION SELECT reach.id, edges.v FROM reach JOIN edges ON edges.u = reach.hit),
least AS (SELECT id, min(hit) AS component_id FROM reach GROUP BY id),
degree AS (SELECT u, count(*) AS n FROM edges GROUP BY u)
SELECT v.vec_id, coalesce(degree.n, 0)::BIGINT AS n_links, coalesce(least.component_id, v.vec_id)::BIGINT AS component_id, coalesce(least.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN least ON least.id = v.vec_id LEFT JOIN degree ON degree.u = v.vec_id
"""
OP5_SQL = f"""
WITH RECURSIVE {_WORDS},
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
each AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(x) AS x FROM sets, unnest(s) AS t(x)),
edges AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM each a JOIN each b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT u AS id, u AS hit FROM edges UNION SELECT reach.id, edges.v FROM reach JOIN edges ON edges.u = reach.hit),
least AS (SELECT id, min(hit) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id)::BIGINT AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM sets LEFT JOIN least ON least.id = doc_id
"""
OP4_SQL = f"""
WITH {_WORDS},
windows AS MATERIALIZED (SELECT doc_id, len(w)::BIGINT AS n_words, i - 1 AS start, md5_number(array_to_string(w[i:i + 49], ' ')) AS name FROM words, unnest(range(1, len(w) - 48)) AS t(i)),
shared AS (SELECT name, min(doc_id) AS least FROM windows GROUP BY name HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, n_words, start, doc_id > least AS later FROM windows JOIN shared USING (name)),
sides AS (SELECT doc_id, n_words, start, 'spans' AS side FROM hits UNION ALL SELECT doc_id, n_words, start, 'later' FROM hits WHERE later),
cut AS (SELECT *, coalesce(start - lag(start) OVER w > 50, true)::INTEGER AS new FROM sides WINDOW w AS (PARTITION BY doc_id, side ORDER BY start)),
named AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, side ORDER BY start ROWS UNBOUNDED PRECEDING) AS part FROM cut),
spans AS (SELECT doc_id, n_words, side, min(start) AS a, max(start) + 50 AS b FROM named GROUP BY doc_id, n_words, side, part)
SELECT doc_id, n_words, (sum(b - a) FILTER (side = 'spans'))::BIGINT AS n_repeated, coalesce(string_agg(a || ':' || b, ',' ORDER BY a) FILTER (side = 'spans'), '') AS spans,
       coalesce(string_agg(a || ':' || b, ',' ORDER BY a) FILTER (side = 'later'), '') AS later
FROM spans GROUP BY doc_id, n_words
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_quality": op6_quality,
    "op7_fingerprints": op7_fingerprints,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
}

SQL: dict[str, str] = {"op1_mixing": OP1_SQL, "op2_embedding_dedup": OP2_SQL, "op4_repeated_passages": OP4_SQL, "op5_minhash_dedup": OP5_SQL}
