"""One query an operator family over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import models
from granary.functions import text as T
from granary.operators import chunking, corpus, decide, graph, metrics, search, spans, stats, tree
from granary.plans import config, retrieval
from granary.sources import nodes as N

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as leaves: named by their number, documents by their label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("document_id"), (F.col("vec_id") % 3).cast("int").alias("level"), "vec_id", "label", "embedding")


def asking(spark: SparkSession, sf_dir: str, turned: bool = False) -> DataFrame:
    """The query set of searches, vectors whose number is divisible by 50; ``turned`` reads them backwards, as a second path."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    return e.select(F.col("vec_id").cast("string").alias("qid"), (F.reverse("embedding") if turned else F.col("embedding")).alias("embedding"), F.col("label").alias("q_label"))


_R = 6
_V = "v AS (SELECT vec_id::VARCHAR AS chunk_id, 'd' || label AS document_id, (vec_id % 3)::INTEGER AS level, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_Q = "q AS (SELECT vec_id::VARCHAR AS qid, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT vec_id::VARCHAR AS qid, list_reverse(embedding::DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0)"


def _near(q: str, k: int, where: str = "true", by: str = "") -> str:
    return f"""SELECT * FROM (SELECT {q}.qid, v.chunk_id, v.document_id, v.level, 1 / (1 + list_distance(v.e, {q}.e)) AS score,
  row_number() OVER (PARTITION BY {q}.qid{by} ORDER BY list_distance(v.e, {q}.e), v.chunk_id) AS rank FROM v, {q} WHERE v.chunk_id <> {q}.qid AND {where}) WHERE rank <= {k}"""


@query(f"WITH {_V}, {_Q}, n AS ({_near('q', 10)}) SELECT qid, chunk_id, round(score, 6) AS score, rank FROM n")
def knn_topk(spark, sf_dir):
    found = search.knn(vectors(spark, sf_dir), asking(spark, sf_dir), 10, exclude_self=True)
    return found.select("qid", "chunk_id", F.round("score", _R).alias("score"), "rank")


@query(f"WITH {_V}, {_Q}, n AS ({_near('q', 5, by=', v.level')}) SELECT qid, level, chunk_id, round(score, 6) AS score, rank FROM n")
def knn_by_level(spark, sf_dir):
    found = search.knn(vectors(spark, sf_dir), asking(spark, sf_dir), 5, keys=("level",), exclude_self=True)
    return found.select("qid", "level", "chunk_id", F.round("score", _R).alias("score"), "rank")


_FILTER = "v.document_id IN ('d1', 'd2')"


@query(f"WITH {_V}, {_Q}, n AS ({_near('q', 5, _FILTER)}) SELECT qid, chunk_id, round(score, 6) AS score, rank FROM n")
def knn_filtered(spark, sf_dir):
    found = search.knn(vectors(spark, sf_dir).where(F.col("document_id").isin("d1", "d2")), asking(spark, sf_dir), 5, exclude_self=True)
    return found.select("qid", "chunk_id", F.round("score", _R).alias("score"), "rank")


def _two_paths(spark, sf_dir, first: int, second: int) -> DataFrame:
    leaves = vectors(spark, sf_dir)
    a = search.knn(leaves, asking(spark, sf_dir), first, exclude_self=True).select("qid", "chunk_id", "score", "rank", F.lit(0).alias("path"))
    b = search.knn(leaves, asking(spark, sf_dir, True), second, exclude_self=True).select("qid", "chunk_id", "score", "rank", F.lit(1).alias("path"))
    return a.unionByName(b)


_PATHS = "a AS ({0}), b AS ({1}), l AS (SELECT qid, chunk_id, score, rank, 0 AS path FROM a UNION ALL SELECT qid, chunk_id, score, rank, 1 FROM b)"
_TWO = _PATHS.format(_near("q", 10), _near("p", 10))
_STEP = _PATHS.format(_near("q", 10), _near("p", 5))


@query(f"WITH {_V}, {_Q}, {_TWO} SELECT qid, chunk_id, round(sum(1 / (60.0::DOUBLE + rank)), 6) AS score FROM l GROUP BY ALL")
def rrf_fusion(spark, sf_dir):
    return search.reciprocal_ranks(_two_paths(spark, sf_dir, 10, 10)).select("qid", "chunk_id", F.round("score", _R).alias("score"))


_MERGE = "m AS (SELECT qid, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY path, rank) AS n FROM l) WHERE n = 1) SELECT qid, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM m"


@query(f"WITH {_V}, {_Q}, {_TWO}, {_MERGE}")
def merge_dedup(spark, sf_dir):
    return search.merged(_two_paths(spark, sf_dir, 10, 10)).select("qid", "chunk_id", F.round("score", _R).alias("score"), "rank")


@query(f"WITH {_V}, {_Q}, {_STEP}, {_MERGE}")
def stepback_union(spark, sf_dir):
    return search.merged(_two_paths(spark, sf_dir, 10, 5)).select("qid", "chunk_id", F.round("score", _R).alias("score"), "rank")


@query(f"""WITH {_V}, {_Q}, n AS ({_near('q', 10)}), t AS (SELECT n.*, d.text FROM n JOIN documents d ON d.doc_id = n.chunk_id::BIGINT),
c AS (SELECT *, sum(greatest(1, length(text) // 4)) OVER w AS used, row_number() OVER w AS r FROM t WINDOW w AS (PARTITION BY qid ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING))
SELECT qid, chunk_id, used::BIGINT AS used FROM c WHERE used <= 2000 OR r = 1""")
def token_budget_cut(spark, sf_dir):
    found = search.knn(vectors(spark, sf_dir), asking(spark, sf_dir), 10, exclude_self=True).drop("rank")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return search.within_budget(found.join(texts, "chunk_id"), 2000, F.col("text")).select("qid", "chunk_id", "used")


@query(f"WITH {_V}, {_Q}, n AS ({_near('q', 10)}), x AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM n WINDOW w AS (PARTITION BY qid)) SELECT qid, chunk_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 6) AS scaled FROM x")
def scaled_scores(spark, sf_dir):
    found = search.knn(vectors(spark, sf_dir), asking(spark, sf_dir), 10, exclude_self=True)
    return found.select("qid", "chunk_id", F.round(search.min_max(), _R).alias("scaled"))


# --- routing and correction


def questions(spark, sf_dir) -> DataFrame:
    """Turns of conversations as queries: they have questions, cues and names."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("qid"), F.col("text").alias("query"))


_QS = "qs AS (SELECT conv_id || ':' || turn AS qid, text AS query FROM conversations)"
_any = lambda column, cues: "(" + " OR ".join(f"contains({column}, '{c}')" for c in cues) + ")"
_STARTS = "(" + " OR ".join(f"starts_with(lower(query), '{s}')" for s in T.QUESTION_STARTS) + ")"


@query(f"WITH {_QS} SELECT qid, CASE WHEN {_any('lower(query)', T.BROAD)} THEN 'step_back' WHEN contains(query, '?') OR {_STARTS} THEN 'hyde' ELSE 'semantic' END AS strategy FROM qs")
def route_keyword(spark, sf_dir):
    return decide.keyword_route(questions(spark, sf_dir))


_D20 = f"n AS ({_near('q', 20)}), d AS (SELECT qid, list(1 / score - 1 ORDER BY rank) AS ds FROM n GROUP BY qid)"
_ENTROPY = "(SELECT -sum(p * ln(p + 1e-12)) FROM (SELECT exp(-(x - list_min(ds)) / 0.02) / (SELECT sum(exp(-(y - list_min(ds)) / 0.02)) FROM unnest(ds) AS u(y)) AS p FROM unnest(ds) AS t(x)))"


@query(f"WITH {_V}, {_Q}, {_D20}, h AS (SELECT qid, {_ENTROPY} AS h FROM d) SELECT qid, CASE WHEN h < 1.8 THEN 'semantic' WHEN h < 2.6 THEN 'dphf' ELSE 'step_back' END AS strategy, round(h, 6) AS entropy, h >= 2.6 AND (qid::BIGINT % 2 = 0) AS is_multi_hop FROM h")
def route_egr(spark, sf_dir):
    q = asking(spark, sf_dir).withColumn("query", F.when(F.col("qid").cast("long") % 2 == 0, "compare Alpha and Beta").otherwise("plain words"))
    near = search.knn(vectors(spark, sf_dir), q, 20, exclude_self=True)
    return decide.entropy_route(q, near, 0.02).select("qid", "strategy", F.round("entropy", _R).alias("entropy"), "is_multi_hop")


_FEATURES = ", ".join([f"(w[1] = '{x}')::INTEGER" for x in T.FIRST_WORDS])


@query(f"""WITH {_QS}, t AS (SELECT qid, trim(query) AS q, list_filter(regexp_split_to_array(lower(trim(query)), '\\s+'), lambda x: x <> '') AS w FROM qs)
SELECT qid, {" + ".join(f"{k + 1} * (w[1] = '{x}')::BIGINT" for k, x in enumerate(T.FIRST_WORDS))} AS first_word, contains(q, '?')::BIGINT AS asks, {_any('lower(q)', T.BROAD_MORE)}::BIGINT AS broad, {_any('lower(q)', T.MULTI_HOP_MORE)}::BIGINT AS hops,
len(list_distinct(regexp_extract_all(regexp_replace(q, '[^\\x00-\\x7F]', '_', 'g'), '{T.CAPITALIZED.removeprefix('(?U)')}')))::BIGINT AS names, len(w)::BIGINT AS words, (length(q) - length(replace(q, ',', '')) + (length(lower(q)) - length(replace(lower(q), ' and ', ''))) // 5)::BIGINT AS clauses FROM t WHERE len(w) > 0""")
def route_features(spark, sf_dir):
    q = questions(spark, sf_dir).where(F.trim("query") != "")
    f = q.select("qid", decide.intent_features(F.col("query")).alias("f"))
    first = F.aggregate(F.slice("f", 1, len(T.FIRST_WORDS)), F.struct(F.lit(0.0).alias("i"), F.lit(0.0).alias("s")), lambda s, x: F.struct((s["i"] + 1).alias("i"), (s["s"] + (s["i"] + 1) * x).alias("s")))["s"]
    names = ("asks", "broad", "hops", "names", "words", "clauses")
    return f.select("qid", first.cast("long").alias("first_word"), *[F.col("f")[len(T.FIRST_WORDS) + k].cast("long").alias(n) for k, n in enumerate(names)])


@query(f"""WITH {_V}, {_Q}, {_D20}, s AS (SELECT qid, list_min(ds) AS lo, list_avg(ds) AS m, list_max(ds) AS hi, sqrt(list_var_pop(ds)) AS sd, list_sort(ds)[2] AS second FROM d)
SELECT qid, round(lo, 6) AS nearest, round(m, 6) AS mean, round(hi - lo, 6) AS range, round(sd, 6) AS deviation, round(second - lo, 6) AS gap, round(lo / (m + 1e-9), 6) AS share FROM s""")
def route_anchors(spark, sf_dir):
    near = search.knn(vectors(spark, sf_dir), asking(spark, sf_dir), 20, exclude_self=True)
    f = decide.distances_of(near).select("qid", decide.anchor_features(F.col("distances")).alias("f"))
    return f.select("qid", *[F.round(F.col("f")[k], _R).alias(n) for k, n in enumerate(("nearest", "mean", "range", "deviation", "gap", "share"))])


@query("""WITH b AS (SELECT item_id::VARCHAR AS qid, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS q FROM benchmark),
d AS (SELECT doc_id::VARCHAR AS chunk_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT qid, chunk_id, len(list_intersect(q, w)) / (len(q) + 1e-9) AS score FROM b, d) SELECT qid, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def rerank_overlap(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return search.most_overlap(d, b, 5).select("qid", "chunk_id", F.round("score", _R).alias("score"), "rank")


_SOURCED = f"WITH {_V}, {_Q}, n AS ({_near('q', 10)}), s AS (SELECT *, CASE WHEN rank % 3 = 0 THEN 'cross_encoder' WHEN rank % 3 = 1 THEN 'bi_encoder' ELSE 'rrf' END AS src FROM n), k AS (SELECT *, score >= CASE src WHEN 'bi_encoder' THEN 0.49 WHEN 'cross_encoder' THEN 0.6 ELSE '-inf'::DOUBLE END AS ok FROM s)"


def _sourced(spark, sf_dir):
    found = search.knn(vectors(spark, sf_dir), asking(spark, sf_dir), 10, exclude_self=True)
    return found.withColumn("score_source", F.when(F.col("rank") % 3 == 0, "cross_encoder").when(F.col("rank") % 3 == 1, "bi_encoder").otherwise("rrf"))


@query(_SOURCED + " SELECT qid, count(*) FILTER (ok) AS n_kept, CASE WHEN count(*) FILTER (ok) = 0 THEN 'rewrite' WHEN count(*) FILTER (ok) >= greatest(1, count(*)) // 2 THEN 'high' ELSE 'medium' END AS confidence FROM k GROUP BY qid")
def sscc_filter(spark, sf_dir):
    return decide.threshold_correction(_sourced(spark, sf_dir), 0.49, 0.6)[1].select("qid", "n_kept", "confidence")


@query(f"WITH {_QS}, j AS (SELECT qid, regexp_extract(query, '\\d+(\\.\\d+)?') AS n FROM qs), s AS (SELECT qid, CASE WHEN n = '' THEN 100 ELSE greatest(1, least(100, n::DOUBLE)) END AS raw FROM j) SELECT qid, CASE WHEN raw >= 60 THEN 'high' WHEN raw >= 25 THEN 'medium' ELSE 'rewrite' END AS confidence, raw::DOUBLE AS raw_score FROM s")
def crag_gate(spark, sf_dir):
    return decide.judged_correction(questions(spark, sf_dir).select("qid", F.col("query").alias("answer")))


_SCORED = "s AS (SELECT d.n_chars::DOUBLE AS score, l.quality = 1 AS relevant FROM labels l JOIN documents d USING (doc_id))"


def _samples(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("score", (F.col("quality") == 1).alias("relevant"))


@query(f"""WITH {_SCORED}, r AS (SELECT min(score) AS lo, max(score) AS hi FROM s), g AS (SELECT i, lo + (hi - lo) * i / 99 AS tau FROM r, range(100) t(i)),
b AS (SELECT i, tau, 0.5 * (avg((score >= tau)::INTEGER) FILTER (relevant) + avg((score < tau)::INTEGER) FILTER (NOT relevant)) AS b FROM s, g GROUP BY i, tau) SELECT round(tau, 6) AS tau FROM b ORDER BY round(b, 12) DESC, i LIMIT 1""")
def threshold_grid(spark, sf_dir):
    return decide.score_threshold(_samples(spark, sf_dir)).select(F.round("tau", _R).alias("tau"))


@query(f"""WITH {_SCORED}, c AS (SELECT score, sum(relevant::INTEGER) AS p, sum((NOT relevant)::INTEGER) AS n FROM s GROUP BY score),
j AS (SELECT score, sum(p) OVER w / sum(p) OVER () - sum(n) OVER w / sum(n) OVER () AS j FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(arg_max(score, j), 6) AS threshold, round(max(j), 6) AS j FROM j""")
def youden(spark, sf_dir):
    return stats.youden_threshold(_samples(spark, sf_dir)).select(F.round("threshold", _R).alias("threshold"), F.round("j", _R).alias("j"))


_H = "h AS (SELECT vec_id, embedding[1]::DOUBLE * 10 AS entropy, CASE label % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'hyde' ELSE 'step_back' END AS strategy FROM embeddings)"


@query(f"""WITH {_H}, r AS (SELECT min(entropy) AS lo, max(entropy) AS hi FROM h), g AS (SELECT i, lo + (hi - lo) * i / 39 AS tau FROM r, range(40) t(i)),
x AS (SELECT a.i, b.i AS j, a.tau AS tau_low, b.tau AS tau_high, avg((CASE WHEN entropy < a.tau THEN 'semantic' WHEN entropy < b.tau THEN 'dphf' ELSE 'step_back' END = CASE strategy WHEN 'hyde' THEN 'dphf' ELSE strategy END)::INTEGER) AS agreement FROM g a, g b, h WHERE a.i < b.i GROUP BY ALL)
SELECT round(tau_low, 6) AS tau_low, round(tau_high, 6) AS tau_high, round(agreement, 6) AS agreement FROM x ORDER BY agreement DESC, i, j LIMIT 1""")
def egr_grid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    h = e.select((F.col("embedding")[0].cast("double") * 10).alias("entropy"), F.when(F.col("label") % 3 == 0, "semantic").when(F.col("label") % 3 == 1, "hyde").otherwise("step_back").alias("strategy"))
    return decide.entropy_thresholds(h).select(*[F.round(c, _R).alias(c) for c in ("tau_low", "tau_high", "agreement")])


@query(f"""WITH {_H}, p AS (SELECT CASE WHEN strategy = 'hyde' THEN 'dphf' ELSE strategy END AS l, entropy AS v FROM h), g AS (SELECT l, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w FROM p GROUP BY l),
r AS (SELECT sum(n * (m - (SELECT avg(v) FROM p)) ** 2) / sum(w) AS ratio FROM g)
SELECT count(*) AS n, round(min(v), 6) AS low, round(quantile_cont(v, 0.25), 6) AS p25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS high, round(stddev_pop(v), 6) AS deviation, round((SELECT ratio FROM r), 6) AS ratio FROM p""")
def router_dispersion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    h = e.select((F.col("embedding")[0].cast("double") * 10).alias("value"), F.when(F.col("label") % 3 == 0, "semantic").when(F.col("label") % 3 == 1, "dphf").otherwise("step_back").alias("label"))
    return stats.dispersion(h).select("n", *[F.round(c, _R).alias(c) for c in ("low", "p25", "median", "p75", "high", "deviation", "ratio")])


@query("""WITH t AS (SELECT vec_id, CASE label % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'dphf' ELSE 'step_back' END AS s FROM embeddings), d AS (SELECT 'egr' AS router, vec_id, CASE WHEN vec_id % 4 = 0 THEN 'semantic' ELSE 'dphf' END AS s FROM embeddings WHERE vec_id % 7 > 0 UNION ALL SELECT 'keyword', vec_id, 'step_back' FROM embeddings)
SELECT router, round(avg(coalesce((d.s = t.s)::INTEGER, 0)), 6) AS agreement FROM (SELECT DISTINCT router FROM d) r CROSS JOIN t LEFT JOIN d USING (router, vec_id) GROUP BY router UNION ALL SELECT 'commonest', round((SELECT max(n) FROM (SELECT count(*) AS n FROM t GROUP BY s)) / count(*), 6) FROM t""")
def router_agreement(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    qid = F.col("vec_id").cast("string").alias("qid")
    truth = e.select(qid, F.when(F.col("label") % 3 == 0, "semantic").when(F.col("label") % 3 == 1, "dphf").otherwise("step_back").alias("strategy"))
    egr = e.where("vec_id % 7 > 0").select(F.lit("egr").alias("router"), qid, F.when(F.col("vec_id") % 4 == 0, "semantic").otherwise("dphf").alias("strategy"))
    return stats.agreements(egr.union(e.select(F.lit("keyword"), qid, F.lit("step_back"))), truth).select("router", F.round("agreement", _R).alias("agreement"))


# --- chunks and spans


def windows(spark, sf_dir) -> DataFrame:
    """Documents in fixed windows of 1500 characters."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    w = d.select(F.col("doc_id").cast("string").alias("document_id"), "text", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(1500))).alias("chunk_index", "char_start"))
    return w.select("document_id", "chunk_index", F.concat_ws(":", "document_id", "chunk_index").alias("chunk_id"), "char_start", F.least(F.col("char_start") + 1500, F.length("text")).alias("char_end"), F.substring(F.col("text"), F.col("char_start") + 1, F.lit(1500)).alias("content"))


_W = "w AS (SELECT doc_id::VARCHAR AS document_id, (s // 1500)::INTEGER AS chunk_index, doc_id || ':' || (s // 1500) AS chunk_id, s AS char_start, least(s + 1500, length(text)) AS char_end, substring(text, s::INTEGER + 1, 1500) AS content FROM (SELECT *, unnest(range(0, length(text), 1500)) AS s FROM documents))"


@query(f"WITH {_W} SELECT document_id, count(*) AS n_chunks, max(char_end)::BIGINT AS last_end, md5(string_agg(content, '' ORDER BY chunk_index)) AS digest FROM w GROUP BY document_id")
def fixed_windows(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])
    return windows(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("char_end").cast("long").alias("last_end"), F.md5(F.array_join(ordered, "").cast("binary")).alias("digest"))


_LOCATED = "l AS (SELECT b.item_id::VARCHAR AS qid, d.doc_id::VARCHAR AS document_id, instr(d.text, trim(b.text)) - 1 AS char_start, instr(d.text, trim(b.text)) - 1 + length(trim(b.text)) AS char_end FROM benchmark b JOIN documents d ON contains(d.text, trim(b.text)))"


def gold(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("snippet"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    found = spans.located(spans.holders(b, d), d)
    return found.select("qid", "document_id", "char_start", "char_end", (F.col("qid").cast("long") % 2 + 1).cast("int").alias("grade"))


@query(f"WITH {_LOCATED} SELECT qid, document_id, char_start::BIGINT AS char_start, char_end::BIGINT AS char_end FROM l")
def span_locate(spark, sf_dir):
    return gold(spark, sf_dir).select("qid", "document_id", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query(f"""WITH {_LOCATED}, {_W} SELECT qid, chunk_id, max(qid::BIGINT % 2 + 1) AS grade FROM l JOIN w USING (document_id)
WHERE greatest(0, least(l.char_end, w.char_end) - greatest(l.char_start, w.char_start)) >= 0.5 * greatest(1, l.char_end - l.char_start) AND l.char_start < w.char_end AND w.char_start < l.char_end GROUP BY qid, chunk_id""")
def span_qrels(spark, sf_dir):
    return spans.judged_chunks(gold(spark, sf_dir), windows(spark, sf_dir)).select("qid", "chunk_id", F.col("grade").cast("long").alias("grade"))


@query(f"""WITH {_W}, h AS (SELECT * FROM w)
SELECT h.chunk_id, md5(concat_ws(' ', right(b.content, 200), h.content, left(a.content, 200))) AS digest FROM h LEFT JOIN w b ON b.document_id = h.document_id AND b.chunk_index = h.chunk_index - 1 LEFT JOIN w a ON a.document_id = h.document_id AND a.chunk_index = h.chunk_index + 1""")
def neighbor_expand(spark, sf_dir):
    w = windows(spark, sf_dir).withColumn("level", F.lit(0))
    hits = w.select("chunk_id", "content", "level")
    return spans.with_neighbours(hits, w).select("chunk_id", F.md5(F.col("content").cast("binary")).alias("digest"))


@query()
def chunk_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("f."), F.element_at(F.array(*[F.lit(x) for x in ("pdf", "py", "md", "csv", "txt")]), (F.col("doc_id") % 5 + 1).cast("int"))).alias("filename"), "text", F.lit(0).alias("char_start"))
    return chunking.chunked(d).select("chunk_id", "document_id", "chunk_index", "char_start", "char_end", "language")


def _asked_spans(spark, sf_dir) -> DataFrame:
    """Benchmark items as questions whose gold spans are where documents hold them."""
    g = gold(spark, sf_dir).groupBy("qid").agg(F.collect_list(F.struct("document_id", "char_start", "char_end", "grade")).alias("gold_spans"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"), F.lit("yes").alias("answer"), F.lit("factual").alias("type"), F.when(F.col("item_id") % 3 == 0, "dev").alias("split"))
    return b.join(g, "qid", "left").withColumn("gold_spans", F.coalesce("gold_spans", F.array().cast(g.schema["gold_spans"].dataType)))


@query(f"""WITH {_LOCATED}, {_W}, j AS (SELECT qid, chunk_id, max(qid::BIGINT % 2 + 1) AS grade FROM l JOIN w USING (document_id)
WHERE greatest(0, least(l.char_end, w.char_end) - greatest(l.char_start, w.char_start)) >= 0.5 * greatest(1, l.char_end - l.char_start) AND l.char_start < w.char_end AND w.char_start < l.char_end GROUP BY qid, chunk_id)
SELECT b.item_id::VARCHAR AS qid, CASE WHEN item_id % 3 = 0 THEN 'dev' ELSE 'test' END AS split, count(j.chunk_id) AS n_judged, coalesce(sum(grade), 0)::BIGINT AS grades FROM benchmark b JOIN j ON j.qid = b.item_id::VARCHAR GROUP BY ALL""")
def evaluation_set(spark, sf_dir):
    asked, _, judged = corpus.evaluation_set(_asked_spans(spark, sf_dir), windows(spark, sf_dir), mapped_only=True)
    return asked.join(judged, "qid").groupBy("qid", "split").agg(F.count(F.lit(1)).alias("n_judged"), F.sum("grade").cast("long").alias("grades"))


@query()
def dataset_from_manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("a.txt").alias("filename"), "text")
    asked, passages, judged = corpus.from_manifest(_asked_spans(spark, sf_dir), d.select("document_id", "filename"), d.select("document_id", "text"))
    return judged.join(asked.select("qid", "split"), "qid").join(passages.select("chunk_id", "document_id"), "chunk_id").select("qid", "split", "document_id", "chunk_id", F.col("grade").cast("long").alias("grade"))


_STATS = "s AS (SELECT label::VARCHAR AS document_id, vec_id::VARCHAR AS chunk_id, (vec_id // 10)::INTEGER AS chunk_index, abs(embedding[1])::DOUBLE * 4 AS hit_rate, abs(embedding[2])::DOUBLE * 4 AS prec, abs(embedding[3])::DOUBLE * 4 AS ent, abs(embedding[4])::DOUBLE AS util FROM embeddings)"


@query(f"""WITH {_STATS}, n AS (SELECT *, lead(chunk_id) OVER w AS c2, lead(chunk_index) OVER w AS i2, lead(ent) OVER w AS e2 FROM s WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index, chunk_id))
SELECT CASE WHEN prec < 0.4 THEN 'split' ELSE 're_anchor' END AS op_type, chunk_id AS chunks FROM s WHERE hit_rate >= 0.5 AND (prec < 0.4 OR util < 0.1)
UNION ALL SELECT 'merge', chunk_id || ',' || c2 FROM n WHERE i2 = chunk_index + 1 AND ent < 0.2 AND e2 < 0.2""")
def raac_plan(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = lambda k, m=1: F.abs(F.col("embedding")[k]).cast("double") * m
    s = e.select(F.col("label").cast("string").alias("document_id"), F.col("vec_id").cast("string").alias("chunk_id"), F.floor(F.col("vec_id") / 10).cast("int").alias("chunk_index"), a(0, 4).alias("hit_rate"), a(1, 4).alias("precision"), a(2, 4).alias("co_retrieval_entropy"), a(3).alias("generation_utility"))
    return chunking.repairs(s).select("op_type", F.array_join("chunk_ids", ",").alias("chunks"))


# --- graphs


def leaves(spark, sf_dir) -> DataFrame:
    """Vectors as chunks of their label's document, with texts that have markers and identifiers."""
    e = table(spark, sf_dir, "embeddings")
    index = (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("int")
    text = F.concat(F.lit("See Section "), (F.col("vec_id") % 97).cast("string"), F.lit(" and ["), (F.col("vec_id") % 61).cast("string"), F.lit("] call_"), (F.col("vec_id") % 23).cast("string"))
    return e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("document_id"), index.alias("chunk_index"), text.alias("content"), F.when(F.col("vec_id") % 2 == 0, "python").alias("language"), "embedding", "vec_id")


_L = "l AS (SELECT vec_id::VARCHAR AS chunk_id, 'd' || label AS document_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk_index, vec_id, 'See Section ' || (vec_id % 97) || ' and [' || (vec_id % 61) || '] call_' || (vec_id % 23) AS content, CASE WHEN vec_id % 2 = 0 THEN 'python' END AS language, embedding::DOUBLE[] AS e FROM embeddings)"
_SEQ = "seq AS (SELECT least(chunk_id, n) AS src, greatest(chunk_id, n) AS dst FROM (SELECT chunk_id, lead(chunk_id) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS n FROM l) WHERE n IS NOT NULL)"


@query(f"WITH {_L}, {_SEQ} SELECT 'sequential' AS type, src, dst FROM seq")
def edges_sequential(spark, sf_dir):
    return graph.sequential_edges(leaves(spark, sf_dir))


_SIM = "x AS (SELECT a.chunk_id AS s, b.chunk_id AS t, list_cosine_similarity(a.e, b.e) AS c FROM l a JOIN l b ON a.chunk_id <> b.chunk_id), y AS (SELECT s, t FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY c DESC, t) AS r FROM x) WHERE r <= 16 AND c > 0.3)"


@query(f"WITH {_L}, {_SIM} SELECT DISTINCT 'semantic' AS type, least(s, t) AS src, greatest(s, t) AS dst FROM y")
def edges_semantic(spark, sf_dir):
    return graph.semantic_edges(leaves(spark, sf_dir), 0.3)


@query(f"WITH {_L}, m AS (SELECT chunk_id, unnest(list_distinct(list_concat(list_transform(regexp_extract_all(content, '(?i)\\b(?:section|fig(?:ure)?|table|chapter|eq(?:uation)?)\\s+\\d+\\b'), lambda x: lower(x)), regexp_extract_all(content, '\\[\\d+\\]')))) AS k FROM l) SELECT DISTINCT 'xref' AS type, a.chunk_id AS src, b.chunk_id AS dst FROM m a JOIN m b ON a.k = b.k AND a.chunk_id < b.chunk_id")
def edges_xref(spark, sf_dir):
    return graph.reference_edges(leaves(spark, sf_dir))


@query(f"WITH {_L}, m AS (SELECT document_id, chunk_id, unnest(list_distinct(regexp_extract_all(content, '{T.IDENTIFIER.removeprefix('(?U)')}'))) AS k FROM l WHERE language IS NOT NULL), h AS (SELECT *, count(*) OVER (PARTITION BY document_id, k) AS n FROM m) SELECT DISTINCT 'ast' AS type, a.chunk_id AS src, b.chunk_id AS dst FROM h a JOIN h b ON a.document_id = b.document_id AND a.k = b.k AND a.chunk_id < b.chunk_id WHERE a.n BETWEEN 2 AND 12")
def edges_ast(spark, sf_dir):
    return graph.identifier_edges(leaves(spark, sf_dir))


def _seeds(spark, sf_dir):
    return leaves(spark, sf_dir).where("vec_id % 50 = 0").select((F.floor(F.col("vec_id") / 50) % 10).cast("string").alias("qid"), "chunk_id")


_WALK = f"WITH {_L}, {_SEQ} , sides AS (SELECT src, dst FROM seq UNION SELECT dst, src FROM seq), deg AS (SELECT src, count(*) AS n FROM sides GROUP BY src), m AS (SELECT src, dst, 1.0::DOUBLE / n AS w FROM sides JOIN deg USING (src)), seeds AS (SELECT DISTINCT (vec_id // 50 % 10)::VARCHAR AS qid, chunk_id FROM l WHERE vec_id % 50 = 0), p0 AS (SELECT qid, chunk_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY qid) AS p FROM seeds)"
for _k in range(1, 21):
    _WALK += f", p{_k} AS MATERIALIZED (SELECT qid, chunk_id, sum(p) AS p FROM (SELECT qid, dst AS chunk_id, 0.85::DOUBLE * p * w AS p FROM p{_k - 1} JOIN m ON m.src = p{_k - 1}.chunk_id UNION ALL SELECT qid, chunk_id, 0.15::DOUBLE * p FROM p0) GROUP BY qid, chunk_id)"


@query(_WALK + " SELECT qid, chunk_id, round(p, 9) AS p FROM p20 WHERE p > 0")
def ppr_scores(spark, sf_dir):
    l_ = leaves(spark, sf_dir)
    return graph.personalized_ranks(graph.sequential_edges(l_), l_, _seeds(spark, sf_dir)).select("qid", "chunk_id", F.round("p", 9).alias("p"))


@query(_WALK + ", f AS (SELECT qid, chunk_id, round(p, 9) AS p FROM p20 WHERE NOT EXISTS (FROM seeds s WHERE s.qid = p20.qid AND s.chunk_id = p20.chunk_id)) SELECT qid, chunk_id, p FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p DESC, chunk_id) AS r FROM f WHERE p > 0) WHERE r <= 5")
def ppr_expand(spark, sf_dir):
    l_, s = leaves(spark, sf_dir), _seeds(spark, sf_dir)
    ranks = graph.personalized_ranks(graph.sequential_edges(l_), l_, s).withColumn("p", F.round("p", 9))
    return graph.expanded(ranks, s, 5).select("qid", "chunk_id", "p")


_NLI = "e AS (SELECT vec_id::VARCHAR AS src, ((vec_id * 7 + 3) % (SELECT count(*) FROM embeddings))::VARCHAR AS dst, CASE WHEN vec_id % 5 = 0 THEN 'contradiction' WHEN vec_id % 2 = 0 THEN 'entailment' ELSE 'elaboration' END AS label, 0.5::DOUBLE + (vec_id % 7) / 20.0::DOUBLE AS c FROM embeddings UNION ALL SELECT vec_id::VARCHAR, ((vec_id * 3 + 1) % (SELECT count(*) FROM embeddings))::VARCHAR, 'entailment', 0.4::DOUBLE + (vec_id % 11) / 25.0::DOUBLE FROM embeddings), s AS (SELECT DISTINCT src, dst, c FROM e WHERE label <> 'contradiction')"


@query(f"""WITH {_NLI}, a AS (SELECT (vec_id // 50 % 3)::VARCHAR AS qid, [vec_id::VARCHAR] AS p, 1.0::DOUBLE AS w FROM embeddings WHERE vec_id % 50 = 0),
b AS (SELECT qid, list_append(p, dst) AS p, w * c AS w FROM a JOIN s ON s.src = p[-1] WHERE NOT list_contains(p, dst)), d AS (SELECT qid, list_append(p, dst) AS p, w * c AS w FROM b JOIN s ON s.src = p[-1] WHERE NOT list_contains(p, dst)), f AS (SELECT qid, list_append(p, dst) AS p, w * c AS w FROM d JOIN s ON s.src = p[-1] WHERE NOT list_contains(p, dst)),
u AS (SELECT qid, array_to_string(p, '>') AS chain, round(w, 9) AS score FROM (FROM b UNION ALL FROM d UNION ALL FROM f)) SELECT qid, chain, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chain) AS r FROM u) WHERE r <= 10""")
def entailment_chains(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 5 == 0, "contradiction").when(F.col("vec_id") % 2 == 0, "entailment").otherwise("elaboration")
    s, n = lambda c: c.cast("string"), e.count()
    one = e.select(s(F.col("vec_id")).alias("src"), s((F.col("vec_id") * 7 + 3) % n).alias("dst"), label.alias("label"), (0.5 + (F.col("vec_id") % 7) / 20.0).alias("confidence"))
    two = e.select(s(F.col("vec_id")), s((F.col("vec_id") * 3 + 1) % n), F.lit("entailment"), 0.4 + (F.col("vec_id") % 11) / 25.0)
    edges = one.union(two).where("label <> 'contradiction'").withColumn("label", F.lit("entailment")).distinct()
    seeds = e.where("vec_id % 50 = 0").select(s(F.floor(F.col("vec_id") / 50) % 3).alias("qid"), s(F.col("vec_id")).alias("chunk_id"))
    found = graph.entailment_chains(edges, seeds, top_k=10_000).withColumn("score", F.round("score", 9)).drop("rank")
    return search.ranked(found, 10, ties=("chain",)).select("qid", "chain", "score")


@query("""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT a.vec_id, list(b.vec_id) AS early FROM e a JOIN e b ON b.vec_id < a.vec_id WHERE list_cosine_similarity(a.e, b.e) > 0.35 GROUP BY a.vec_id),
o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k, coalesce(early, []::BIGINT[]) AS early FROM e LEFT JOIN n USING (vec_id)),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT o.k, CASE WHEN list_has_any(g.kept, o.early) THEN g.kept ELSE list_append(g.kept, o.vec_id) END FROM g JOIN o ON o.k = g.k + 1),
d AS (SELECT unnest(kept) AS vec_id FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1)) SELECT e.vec_id::VARCHAR AS chunk_id, d.vec_id IS NOT NULL AS kept FROM e LEFT JOIN d USING (vec_id)""")
def near_dup_keep(spark, sf_dir):
    l_ = leaves(spark, sf_dir).withColumn("position", F.col("vec_id"))
    return graph.near_duplicate_mask(l_, 0.35)


@query()
def refined_vectors(spark, sf_dir):
    l_ = leaves(spark, sf_dir)
    out = graph.refined(l_, graph.sequential_edges(l_), 2)
    return out.select("chunk_id", F.round(F.col("embedding")[0], _R).alias("x0"), F.size("embedding").alias("dim"))


# --- hierarchies


def _tree(spark, sf_dir):
    return tree.hierarchy(leaves(spark, sf_dir), models.summarize, models.embed)


@query()
def tree_levels(spark, sf_dir):
    return _tree(spark, sf_dir).groupBy("document_id", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("child_ids")).alias("children"))


@query()
def corpus_tier(spark, sf_dir):
    return tree.corpus_tier(_tree(spark, sf_dir), models.summarize, models.embed).select("chunk_id", "level", F.size("child_ids").alias("children"))


@query()
def tree_traverse(spark, sf_dir):
    return tree.traversed(_tree(spark, sf_dir), asking(spark, sf_dir), 5).select("qid", "chunk_id", "level", F.round("score", _R).alias("score"))


@query()
def collapsed(spark, sf_dir):
    return tree.collapsed(_tree(spark, sf_dir), asking(spark, sf_dir), 5).select("qid", "chunk_id", "level", F.round("score", _R).alias("score"))


@query(f"WITH {_V} SELECT document_id, chunk_id FROM (SELECT *, max(level) OVER (PARTITION BY document_id) AS h FROM v) WHERE level = h")
def top_nodes(spark, sf_dir):
    return tree.top_nodes(vectors(spark, sf_dir)).select("document_id", "chunk_id")


# --- learned parts


_FACETS = f"WITH {_V}, {_Q}, n AS ({_near('q', 12)}), c0 AS (SELECT n.qid, list({{'id': n.chunk_id, 'base': n.score, 'f': list_transform(v.e[1:4], lambda x: greatest(x, 0))}} ORDER BY n.score DESC, n.chunk_id) AS c, min(n.score) AS lo, max(n.score) AS hi, []::BIGINT[] AS taken, [0, 0, 0, 0]::DOUBLE[] AS cover FROM n JOIN v ON v.chunk_id = n.chunk_id GROUP BY n.qid)"
for _k in range(1, 6):
    _FACETS += f""", g{_k} AS (SELECT *, list_transform(range(1, len(c) + 1), lambda i: CASE WHEN NOT list_contains(taken, i) THEN list_sum(list_transform(range(1, 5), lambda f: greatest(c[i].f[f] - cover[f], 0))) END) AS gain FROM c{_k - 1}),
v{_k} AS (SELECT *, list_transform(range(1, len(c) + 1), lambda i: (1 - 0.3::DOUBLE) * CASE WHEN list_max(gain) > list_min(gain) THEN (gain[i] - list_min(gain)) / (list_max(gain) - list_min(gain)) ELSE gain[i] * 0 END + (0.3::DOUBLE + 1e-6::DOUBLE) * CASE WHEN hi > lo THEN (c[i].base - lo) / (hi - lo) ELSE 0 END) AS worth FROM g{_k}),
b{_k} AS (SELECT *, list_position(worth, list_max(worth))::BIGINT AS best FROM v{_k}), c{_k} AS (SELECT qid, c, lo, hi, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best) END AS taken, CASE WHEN best IS NULL THEN cover ELSE list_transform(range(1, 5), lambda f: greatest(cover[f], c[best].f[f])) END AS cover FROM b{_k})"""


@query(_FACETS + ", o AS (SELECT qid, c, list_concat(taken, list_filter(range(1, len(c) + 1), lambda i: NOT list_contains(taken, i))) AS o FROM c5) SELECT qid, c[o[k]].id AS chunk_id, k AS rank FROM o, unnest(range(1, len(o) + 1)) AS t(k)")
def facet_coverage(spark, sf_dir):
    found = search.knn(vectors(spark, sf_dir), asking(spark, sf_dir), 12, exclude_self=True).drop("rank")
    facets = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    return decide.covered_order(found.join(vectors(spark, sf_dir).select("chunk_id", facets.alias("relevance")), "chunk_id"), 5, 0.3)


def _calibration(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") % 997 / 997.0).alias("score"), F.col("lang").alias("modality"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("modality", F.lit("bi_encoder").alias("score_source"), "score", (F.col("quality") == 1).cast("int").alias("relevant"))


@query()
def platt_calibration(spark, sf_dir):
    return decide.calibrated(_calibration(spark, sf_dir)).select("modality", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query()
def isotonic_calibration(spark, sf_dir):
    curves = decide.calibrated(_calibration(spark, sf_dir), method="isotonic")
    return decide.calibrated_scores(_calibration(spark, sf_dir), curves).groupBy("modality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("calibrated"), _R).alias("mean"))


@query()
def router_crossfit(spark, sf_dir):
    near = search.knn(vectors(spark, sf_dir), asking(spark, sf_dir), 20, exclude_self=True)
    q = asking(spark, sf_dir).select("qid", F.concat(F.lit("what is "), "qid").alias("query"))
    rewards = q.select("qid", *[((F.col("qid").cast("int") % (k + 2)) / (k + 1.0)).alias(s) for k, s in enumerate(decide.STRATEGIES)])
    return decide.cross_fitted(decide.router_features(q, near), rewards)


# --- evaluation

_RUN = f"{_V}, {_Q}, r AS ({_near('q', 30)}), qrels AS (SELECT q.qid, v.chunk_id, CASE WHEN v.vec_id % 2 = 0 THEN 2 ELSE 1 END AS grade FROM q JOIN v ON v.label = q.label AND v.chunk_id <> q.qid), g AS (SELECT r.qid, r.chunk_id, coalesce(grade, 0) AS grade, row_number() OVER (PARTITION BY r.qid ORDER BY score DESC, r.chunk_id DESC) AS rank FROM r LEFT JOIN qrels USING (qid, chunk_id) WHERE r.qid IN (SELECT qid FROM qrels))"


def _run(spark, sf_dir):
    v = vectors(spark, sf_dir)
    run = search.knn(v, asking(spark, sf_dir), 30, exclude_self=True).select("qid", "chunk_id", "score")
    q = asking(spark, sf_dir).select("qid", F.col("q_label").alias("label"))
    qrels = v.join(q, "label").where("chunk_id <> qid").select("qid", "chunk_id", F.when(F.col("vec_id") % 2 == 0, 2).otherwise(1).alias("grade"))
    return run, qrels


@query(f"""WITH {_RUN}, d AS (SELECT qid, sum(grade / log2(rank + 1)) AS dcg, sum((grade > 0)::INTEGER) AS hits, min(rank) FILTER (grade > 0) AS first FROM g WHERE rank <= 10 GROUP BY qid),
i AS (SELECT qid, sum(CASE WHEN n <= 10 THEN grade / log2(n + 1) ELSE 0 END) AS idcg, count(*) AS rel FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, chunk_id) AS n FROM qrels) GROUP BY qid)
SELECT i.qid, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(hits / rel, 0), 6) AS recall, coalesce((hits > 0)::INTEGER, 0)::DOUBLE AS success, round(coalesce(1.0 / first, 0)::DOUBLE, 6) AS rr FROM i LEFT JOIN d USING (qid)""")
def ndcg_at_k(spark, sf_dir):
    run, qrels = _run(spark, sf_dir)
    m = metrics.ranking_metrics(run, qrels, 10)
    return m.select("qid", *[F.round(c, _R).alias(c) for c in ("ndcg", "recall", "success", "rr")])


@query(f"WITH {_RUN}, i AS (SELECT qid, count(*) AS rel FROM qrels GROUP BY qid), k AS (SELECT unnest(range(1, 31)) AS k) SELECT k::INTEGER AS k, round(avg((SELECT count(*) FROM g WHERE g.qid = i.qid AND grade > 0 AND rank <= k) / rel), 6) AS recall FROM i, k GROUP BY k")
def recall_curve(spark, sf_dir):
    return metrics.recall_curve(*_run(spark, sf_dir)).select("k", F.round("recall", _R).alias("recall"))


def _answers(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("predicted"), F.array(F.regexp_replace("text", "th", " x "), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("The "), "text", F.lit("."))).otherwise("")).alias("gold"))


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_TOKENS = "list_filter(string_split(" + _NORM + ", ' '), lambda x: x <> '')"


@query(f"""WITH a AS (SELECT item_id::VARCHAR AS qid, text AS p, unnest([regexp_replace(text, 'th', ' x ', 'g'), CASE WHEN item_id % 2 = 0 THEN 'The ' || text || '.' ELSE '' END]) AS g FROM benchmark),
t AS (SELECT qid, ({_NORM.format('p')} = {_NORM.format('g')})::INTEGER AS em, {_TOKENS.format('p')} AS x, {_TOKENS.format('g')} AS y FROM a),
c AS (SELECT *, list_sum(list_transform(list_distinct(x), lambda u: least(len(list_filter(x, lambda v: v = u)), len(list_filter(y, lambda v: v = u))))) AS c FROM t)
SELECT qid, max(em)::DOUBLE AS em, round(max(CASE WHEN len(x) = 0 OR len(y) = 0 THEN (len(x) = len(y))::INTEGER WHEN c = 0 THEN 0 ELSE 2 * (c / len(x)) * (c / len(y)) / (c / len(x) + c / len(y)) END)::DOUBLE, 6) AS f1 FROM c GROUP BY qid""")
def answer_em_f1(spark, sf_dir):
    return metrics.answer_scores(_answers(spark, sf_dir)).select("qid", "em", F.round("f1", _R).alias("f1"))


def _config_scores(spark, sf_dir):
    """A score a query of five configurations."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(F.concat(F.lit("c"), k.cast("string")).alias("config"), F.abs(F.get(F.col("embedding"), k)).cast("double").alias("value")))).alias("s"), F.col("vec_id").cast("string").alias("qid")).select("s.config", "qid", "s.value")


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY vec_id::VARCHAR) - 1 AS i, abs(embedding[1])::DOUBLE AS v, count(*) OVER () AS n FROM embeddings), d AS (SELECT b, (b * 7919 + i * 104729 + 1) % n AS i FROM s, range(200) t(b))
SELECT b::INTEGER AS b, round(avg(v), 9) AS mean FROM d JOIN s USING (i) GROUP BY b""")
def bootstrap_means(spark, sf_dir):
    s = _config_scores(spark, sf_dir).where("config = 'c0'")
    return stats.bootstrap_means(s, "value", 200, 1).select("b", F.round("mean", 9).alias("mean"))


@query()
def bootstrap_ci(spark, sf_dir):
    return stats.bootstrap_intervals(_config_scores(spark, sf_dir))


@query()
def compare_configs(spark, sf_dir):
    return stats.compared(_config_scores(spark, sf_dir), "c0")


def _p_values(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("name"), (F.pow(F.abs(F.col("embedding")[5]).cast("double"), 4.0)).alias("p"))


_P = "p AS (SELECT vec_id::VARCHAR AS name, pow(abs(embedding[6])::DOUBLE, 4.0) AS p FROM embeddings)"


@query(f"WITH {_P}, o AS (SELECT *, (p <= 0.05 / (count(*) OVER () - row_number() OVER w + 1))::INTEGER AS ok FROM p WINDOW w AS (ORDER BY p, name)) SELECT name, min(ok) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) = 1 AS rejected FROM o")
def holm(spark, sf_dir):
    return stats.holm(_p_values(spark, sf_dir)).select("name", "rejected")


@query(f"WITH {_P}, o AS (SELECT *, row_number() OVER (ORDER BY p, name) AS r, count(*) OVER () AS m FROM p) SELECT name, r <= coalesce((SELECT max(r) FROM o WHERE p <= 0.05 * r / m), 0) AS rejected FROM o")
def bh(spark, sf_dir):
    return stats.benjamini_hochberg(_p_values(spark, sf_dir)).select("name", "rejected")


@query("""WITH s AS (SELECT vec_id::VARCHAR AS qid, unnest(range(0, 5)) AS k, embedding FROM embeddings), x AS (SELECT 'c' || k AS config, qid, abs(embedding[k + 1])::DOUBLE AS v FROM s)
SELECT a.config, a.qid, round(a.v - r.v, 6) AS value FROM x a JOIN x r USING (qid) WHERE r.config = 'c0' AND a.config <> 'c0'""")
def paired_differences(spark, sf_dir):
    return stats.paired_differences(_config_scores(spark, sf_dir), "c0").select("config", "qid", F.round("value", _R).alias("value"))


# --- corpora


def _drafts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kinds = F.array(*[F.lit(t) for t in ("factual", "code", "cross_document", "multi_hop", "thematic")])
    return d.select(F.col("doc_id").cast("string").alias("qid"), F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("type"), F.col("source").alias("collection_id"), F.when(F.col("lang") != "en", F.col("lang")).alias("split"), F.size(F.split("text", "\n")).alias("n_spans"))


@query("""WITH d AS (SELECT ['factual', 'code', 'cross_document', 'multi_hop', 'thematic'][doc_id % 5 + 1] AS type, nullif(lang, 'en') AS split, len(string_split(text, chr(10))) AS n FROM documents)
SELECT 'total' AS facet, 'all' AS name, count(*) AS n FROM d UNION ALL SELECT 'type', type, count(*) FROM d GROUP BY type UNION ALL SELECT 'split', coalesce(split, 'unassigned'), count(*) FROM d GROUP BY 2 UNION ALL SELECT 'multi_evidence', 'all', count(*) FILTER (n >= 2) FROM d""")
def dataset_stats(spark, sf_dir):
    return corpus.dataset_counts(_drafts(spark, sf_dir))


@query("""WITH c AS (SELECT DISTINCT source AS id FROM documents), k AS (SELECT id, row_number() OVER (ORDER BY sha256('42:' || id)) - 1 AS k, count(*) OVER () AS n FROM c)
SELECT id AS collection_id, CASE WHEN n >= 3 AND k < greatest(1, round_even(0.25 * n, 0)) THEN 'calibration' WHEN n >= 3 AND k < 2 * greatest(1, round_even(0.25 * n, 0)) THEN 'dev' ELSE 'test' END AS split FROM k""")
def collection_split(spark, sf_dir):
    return corpus.collection_splits(_drafts(spark, sf_dir))


@query("SELECT doc_id::VARCHAR AS qid, source AS collection_id FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def multi_evidence(spark, sf_dir):
    return _drafts(spark, sf_dir).where("n_spans >= 2").select("qid", "collection_id")


@query("""WITH d AS (SELECT source AS c, doc_id, CASE WHEN doc_id % 5 = 1 THEN 'code' ELSE lang END AS modality FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY sha256(concat_ws(':', '42', c, doc_id::VARCHAR))) AS s, min(doc_id) FILTER (modality = 'code') OVER (PARTITION BY c) AS fc, min(doc_id) FILTER (modality <> 'code') OVER (PARTITION BY c) AS fo FROM d),
k AS (SELECT c, count(DISTINCT modality) AS kinds FROM d GROUP BY c), m AS (SELECT s.*, kinds, row_number() OVER (PARTITION BY s.c, modality ORDER BY s) AS m FROM s JOIN k ON k.c IS NOT DISTINCT FROM s.c), t AS (SELECT *, sum((m = 1)::INTEGER) OVER (PARTITION BY c ORDER BY s ROWS UNBOUNDED PRECEDING) AS turn FROM m),
p AS (SELECT *, CASE WHEN kinds >= 2 THEN m = 1 AND turn <= 2 ELSE s <= 2 END AS two, unnest(['code', 'factual', 'cross_document', 'multi_hop', 'thematic']) AS question_type FROM t)
SELECT c AS collection_id, question_type, doc_id::VARCHAR AS doc_id FROM p WHERE CASE question_type WHEN 'code' THEN CASE WHEN fc IS NULL THEN s = 1 ELSE doc_id = fc END WHEN 'factual' THEN CASE WHEN fo IS NULL THEN s = 1 ELSE doc_id = fo END WHEN 'thematic' THEN s <= 4 ELSE two END""")
def question_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return corpus.chosen_documents(d.select(F.col("source").alias("collection_id"), F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 5 == 1, "code").otherwise(F.col("lang")).alias("modality"), F.col("doc_id").alias("position")))


@query("""WITH c AS (SELECT DISTINCT source || '-' || (doc_id % 300) AS c, doc_id, lang FROM documents WHERE source IS NOT NULL) SELECT c AS collection_id, doc_id, lang FROM c WHERE c IN (SELECT c FROM c GROUP BY c HAVING count(*) >= 2)""")
def collections_assembled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null")
    named = d.select(F.concat_ws("-", "source", (F.col("doc_id") % 300).cast("string")).alias("collection_id"), "doc_id")
    return corpus.assembled(named, d.select("doc_id", "lang"))


@query("SELECT doc_id, 'f-' || doc_id || '.txt' AS filename, length(text)::BIGINT AS n_chars, sha256(text) AS content_sha256 FROM documents")
def manifest_rows(spark, sf_dir):
    return corpus.manifest(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f-"), F.col("doc_id"), F.lit(".txt")).alias("filename"), "text"))


@query("""WITH m AS (SELECT doc_id + CASE WHEN doc_id % 7 = 0 THEN 1000000000 ELSE 0 END AS doc_id, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE sha256(text) END AS sha FROM documents), t AS (SELECT doc_id, sha256(text) AS sha FROM documents)
SELECT CASE WHEN m.doc_id IS NULL THEN 'extra' WHEN t.doc_id IS NULL THEN 'missing' WHEN m.sha = t.sha THEN 'ok' ELSE 'mismatch' END AS status, count(*) AS n FROM m FULL JOIN t ON m.doc_id = t.doc_id GROUP BY 1""")
def manifest_verify(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    sha = F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.sha2(F.col("text").cast("binary"), 256))
    return corpus.verified(d.select((F.col("doc_id") + F.when(F.col("doc_id") % 7 == 0, 1_000_000_000).otherwise(0)).alias("doc_id"), sha.alias("content_sha256")), d)


@query("""SELECT doc_id, sha256('{"kind":"embed","model":"m","params":{},"payload":"' || lang || '-' || doc_id || '","provider":"p","version":1}') AS key FROM documents""")
def call_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", N.call_key("embed", "p", "m", F.concat_ws("-", "lang", "doc_id")).alias("key"))


@query("SELECT label, substring(sha256(string_agg(vec_id::VARCHAR, chr(10) ORDER BY vec_id::VARCHAR)), 1, 16) AS hash FROM embeddings GROUP BY label")
def membership_hash(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.collect_list(F.col("vec_id").cast("string")).alias("ids"))
    return e.select("label", T.membership_hash(F.col("ids")).alias("hash"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'python' WHEN 3 THEN NULL ELSE NULL END AS language, CASE WHEN doc_id % 11 = 0 THEN 'summary' WHEN doc_id % 5 = 1 THEN 'code' WHEN doc_id % 5 = 3 THEN 'table' WHEN doc_id % 5 = 2 THEN 'markdown' WHEN doc_id % 5 = 0 THEN 'pdf' ELSE 'prose' END AS modality, length(text) // 4 AS tokens FROM documents""")
def document_kinds(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("a.b."), F.element_at(F.array(*[F.lit(x) for x in ("PDF", "py", "md", "csv", "txt")]), (F.col("doc_id") % 5 + 1).cast("int")))
    language = T.language_for(name)
    return d.select("doc_id", language.alias("language"), T.modality(F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0), name, language).alias("modality"), T.token_estimate(F.col("text")).alias("tokens"))


_UP = "o AS (SELECT vec_id::VARCHAR AS chunk_id, label AS v FROM embeddings), n AS (SELECT (vec_id + 250)::VARCHAR AS chunk_id, label + 100 AS v FROM embeddings)"


@query(f"WITH {_UP} SELECT chunk_id, v::INTEGER AS v FROM n UNION ALL SELECT chunk_id, v FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM n)")
def node_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    old, new = e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").alias("v")), e.select((F.col("vec_id") + 250).cast("string").alias("chunk_id"), (F.col("label") + 100).cast("int").alias("v"))
    return N.upserted(old, new)


@query("WITH w AS (SELECT vec_id AS pos, ((vec_id * 37) % (SELECT 2 * count(*) FROM embeddings))::VARCHAR AS chunk_id FROM embeddings) SELECT w.pos, w.chunk_id, e.label FROM w JOIN embeddings e ON e.vec_id::VARCHAR = w.chunk_id")
def nodes_by_id(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    wanted = e.select(F.col("vec_id").alias("pos"), ((F.col("vec_id") * 37) % (2 * e.count())).cast("string").alias("chunk_id"))
    return N.by_ids(e.select(F.col("vec_id").cast("string").alias("chunk_id"), "label"), wanted)


# --- entities and pages


@query(f"""WITH e AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '{T.ENTITY.removeprefix('(?U)')}'))) AS entity FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, count(*) AS n FROM e WHERE length(entity) >= 3 GROUP BY conv_id, turn""")
def entities_per_turn(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", F.size(T.entities(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query(f"""WITH e AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '{T.ENTITY.removeprefix('(?U)')}'))) AS entity FROM conversations WHERE role = 'assistant') SELECT conv_id, entity, min(turn) AS first_turn FROM e WHERE length(entity) >= 3 GROUP BY conv_id, entity""")
def new_entities(spark, sf_dir):
    from granary.streaming.prefetch import first_mentions

    return first_mentions(table(spark, sf_dir, "conversations"))


@query("""WITH t AS (SELECT conv_id, turn, text, regexp_extract_all(text, '\\s*\\S+(?:\\s+$)?|^\\s+$') AS t FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, (i - 1)::INTEGER AS n, t[i] AS token FROM t, unnest(range(1, len(t) + 1)) AS u(i)""")
def token_stream(spark, sf_dir):
    from granary.streaming.prefetch import token_stream as tokens

    return tokens(table(spark, sf_dir, "conversations"))


@query()
def prefetch_hits(spark, sf_dir):
    from granary.streaming.prefetch import batch_hits

    return batch_hits(table(spark, sf_dir, "conversations"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def page_parse(spark, sf_dir):
    from granary.sources.loaders import page_text

    return table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html")).alias("text"))


@query()
def facet_sweep(spark, sf_dir):
    run, qrels = _run(spark, sf_dir)
    facets = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    c = run.join(vectors(spark, sf_dir).select("chunk_id", facets.alias("relevance")), "chunk_id")
    return decide.facet_sweep(c, qrels, 10).select("weight", F.round("ndcg", _R).alias("ndcg"), F.round("recall", _R).alias("recall"))


@query()
def retrieval_pipeline(spark, sf_dir):
    """The flagship: the whole pipeline over documents' windows with offline models."""
    w = windows(spark, sf_dir).withColumn("embedding", models.embed(F.col("content")))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))
    cfg = config.with_values(config.Pipeline(), {"raptor.enabled": False, "fusion.hyde_expansion": "modality"})
    return retrieval.run(w, q, cfg).hits.select("qid", "chunk_id", F.round("score", _R).alias("score"), "rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two search paths fused by reciprocal ranks, and their ranking metrics."""
    qrels = _run(spark, sf_dir)[1]
    fused = search.reciprocal_ranks(_two_paths(spark, sf_dir, 10, 5)).select("qid", "chunk_id", "score")
    return metrics.ranking_metrics(fused, qrels, 10)


