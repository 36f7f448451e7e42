"""The whole retrieval pipeline, batched: every stage takes and gives rows keyed by qid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import models
from granary.functions.text import modality
from granary.operators import decide, graph, search, spans, tree
from granary.operators.lineage import cut
from granary.plans.config import Pipeline, with_values
from granary.streaming.prefetch import lookups

#: Prompts are data: offline they only name what a stand-in model is asked for.
PROMPTS = {
    "hyde": "Write a passage that answers the question.",
    "prose": "Write a paragraph of prose that answers the question.",
    "code": "Write code that answers the question.",
    "table": "Write rows of a table that answer the question.",
    "step_back": "Ask the more general question behind this one.",
    "rewrite": "Rewrite the search query.",
    "judge": "Rate from 1 to 100 how well the passages answer the question.",
}
FRAMINGS = ("as an encyclopedia would", "as a textbook would", "as a report would", "as a manual would", "as a letter would")
HIT = ("qid", "chunk_id", "document_id", "content", "score", "level", "score_source", "filename", "language")


@dataclass
class Models:
    """Column functions of texts; offline stand-ins unless others are given."""

    embed: Callable = models.embed
    generate: Callable = models.generate
    rerank: Callable = models.rerank
    judge_pair: Callable | None = models.judge_pair


@dataclass
class Result:
    hits: DataFrame
    decisions: DataFrame
    outcomes: DataFrame
    trace: DataFrame


def _columns(nodes: DataFrame) -> DataFrame:
    for name, kind in (("level", "int"), ("filename", "string"), ("language", "string")):
        if name not in nodes.columns:
            nodes = nodes.withColumn(name, F.lit(0 if name == "level" else None).cast(kind))
    return nodes


def _as_hits(found: DataFrame, nodes: DataFrame, source: str = "bi_encoder") -> DataFrame:
    known = nodes.select("chunk_id", "document_id", "content", "level", "filename", "language")
    return found.select("qid", "chunk_id", "score").join(known, "chunk_id").withColumn("score_source", F.lit(source)).select(*HIT)


def run(nodes: DataFrame, queries: DataFrame, cfg: Pipeline, oracle: DataFrame | None = None, forced: str | None = None, edges: DataFrame | None = None, use: Models | None = None, prefetched: tuple[DataFrame, DataFrame] | None = None, router: Callable | None = None) -> Result:
    """Route, retrieve, merge with the hierarchy, expand over the graph, rerank, correct and widen, for all queries at once.

    ``nodes`` is the node table, ``queries`` has qid and query (and embedding, else the model makes it). ``trace`` has one row a
    query and stage with the number of hits behind it. Queries without any hit are in decisions and outcomes all the same.

    ``prefetched`` is a buffer and its results (see streaming.prefetch): with prefetching on, a query that is near enough to an
    entry of its conversation (conv_id, 0 where queries have none) is served that entry's results, an empty list too, and goes
    through no stage. ``router`` decides (qid, features) rows where the configuration asks for a learned or a compositional
    one; without it these decide as unfitted ones do.
    """
    if cfg.prefetch.enabled and prefetched is not None:
        return _with_prefetch(nodes, queries, cfg, prefetched, oracle=oracle, forced=forced, edges=edges, use=use, router=router)
    use = use or Models()
    nodes = _columns(nodes)
    leaves = nodes.where("level = 0")
    k = cfg.top_k
    fetch = k * cfg.rerank.over_fetch if cfg.rerank.enabled else k
    queries = (queries if "embedding" in queries.columns else queries.withColumn("embedding", use.embed(F.col("query")))).persist()
    trace = []

    def seen(stage: str, hits: DataFrame) -> None:
        trace.append(hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).select("qid", F.lit(len(trace)).alias("seq"), F.lit(stage).alias("stage"), "n"))

    # route
    if forced is not None or not cfg.router.enabled:
        decisions = queries.select("qid", F.lit(forced or "semantic").alias("strategy"), F.lit(False).alias("is_multi_hop"))
    elif cfg.router.variant == "keyword":
        decisions = decide.keyword_route(queries).withColumn("is_multi_hop", F.lit(False))
    elif cfg.router.variant == "oracle":
        decisions = (decide.oracle_route(queries, oracle) if oracle is not None else queries.select("qid", F.lit("semantic").alias("strategy"))).withColumn("is_multi_hop", F.lit(False))
    elif cfg.router.variant in ("learned", "compositional") and router is not None:
        near = search.knn(leaves, queries, cfg.router.egr_k, metric=cfg.metric)
        decisions = router(decide.router_features(queries, near)).select("qid", "strategy").withColumn("is_multi_hop", F.lit(False))
    elif cfg.router.variant in ("learned", "compositional"):
        decisions = queries.select("qid", F.lit("semantic" if cfg.router.variant == "learned" else "dphf").alias("strategy"), F.lit(False).alias("is_multi_hop"))
    else:
        near = search.knn(leaves, queries, cfg.router.egr_k, metric=cfg.metric)
        decisions = decide.entropy_route(queries, near, cfg.router.egr_temperature, cfg.router.egr_tau_low, cfg.router.egr_tau_high).drop("entropy")
    decisions = decisions.persist()
    routed = queries.join(decisions.select("qid", F.when(F.col("strategy") == "dphf", "hyde").otherwise(F.col("strategy")).alias("strategy")), "qid").persist()

    # retrieve
    def path(q: DataFrame, n: int, number: int) -> DataFrame:
        return search.knn(leaves, q, n, metric=cfg.metric).select("qid", "chunk_id", "score", "rank", F.lit(number).alias("path"))

    def asked(q: DataFrame, system: str) -> DataFrame:
        text = use.generate(system, F.concat(F.lit("Question: "), F.col("query")))
        return q.select("qid", use.embed(text).alias("embedding"))

    plain, hyde, step = (routed.where(F.col("strategy") == s) for s in ("semantic", "hyde", "step_back"))
    found = path(plain, fetch, 0).select("qid", "chunk_id", "score").withColumn("score_source", F.lit("bi_encoder"))
    if cfg.fusion.hyde_expansion != "none":
        systems = [PROMPTS[m] for m in cfg.fusion.modality_kinds] if cfg.fusion.hyde_expansion == "modality" else [f"{PROMPTS['prose']} Do it {f}." for f in FRAMINGS[: len(cfg.fusion.modality_kinds)]]
        lists = path(hyde, fetch, 0)
        for n, system in enumerate(systems, 1):
            lists = lists.unionByName(path(asked(hyde, system), fetch, n))
        answered, source = search.merged(lists), "bi_encoder"
    else:
        hypo = path(asked(hyde, PROMPTS["hyde"]), fetch, 1)
        if cfg.fusion.variant == "single":
            answered, source = hypo, "bi_encoder"
        else:
            lists = path(hyde, fetch, 0).unionByName(hypo)
            answered, source = (search.reciprocal_ranks(lists, cfg.fusion.rrf_k), "rrf") if cfg.fusion.variant == "rrf" else (search.merged(lists), "bi_encoder")
    found = found.unionByName(answered.select("qid", "chunk_id", "score").withColumn("score_source", F.lit(source)))
    back = search.merged(path(step, fetch, 0).unionByName(path(asked(step, PROMPTS["step_back"]), max(1, fetch // 2), 1)))
    found = found.unionByName(back.select("qid", "chunk_id", "score").withColumn("score_source", F.lit("bi_encoder")))
    known = nodes.select("chunk_id", "document_id", "content", "level", "filename", "language")
    hits = found.join(known, "chunk_id").select(*HIT)

    # hierarchy
    if cfg.raptor.enabled:
        pool = nodes if cfg.raptor.cross_doc else nodes.where(~F.startswith("chunk_id", F.lit(tree.CORPUS)))
        pool = pool if "child_ids" in pool.columns else pool.withColumn("child_ids", F.array().cast("array<string>"))
        climb = tree.collapsed if cfg.raptor.retrieval_mode == "collapsed" else tree.traversed
        extra = _as_hits(climb(pool, queries, fetch, cfg.raptor.retrieval_token_budget, cfg.raptor.traversal_top_k, metric=cfg.metric), nodes)
        both = search.ranked(hits).withColumn("path", F.lit(0)).unionByName(search.ranked(extra).withColumn("path", F.lit(1)))
        hits = search.merged(both).select(*HIT)
    hits = cut(hits)
    seen("retrieve", hits)

    # graph
    if cfg.graph.enabled:
        if edges is None:
            edges = graph.chunk_graph(leaves, tuple(e for e in cfg.graph.edges if e != "nli"), cfg.graph.semantic_threshold, cfg.graph.semantic_max_degree).persist()
        if cfg.graph.ppr_expand:
            ranks = graph.personalized_ranks(edges, leaves, hits, cfg.graph.ppr_alpha, cfg.graph.ppr_steps)
            fresh = graph.expanded(ranks, hits, max(1, k), cfg.graph.ppr_min_score).select("qid", "chunk_id")
            if "nli" in cfg.graph.edges and use.judge_pair is not None:
                hops = hits.join(decisions.where("is_multi_hop").select("qid"), "qid", "left_semi")
                judged = graph.entailment_edges(leaves, use.judge_pair, cfg.graph.nli_cos_gate)
                chains = graph.entailment_chains(judged, hops).select("qid", F.explode("path").alias("chunk_id"))
                fresh = fresh.union(chains).distinct().join(hits.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
            more = _as_hits(fresh.withColumn("score", F.lit(0.0)), nodes, "ppr")
            hits = cut(hits.unionByName(more))
            seen("graph_expand", hits)
        if not cfg.rerank.enabled:
            refined = graph.refined(leaves, edges, cfg.graph.gnn_layers)
            beta = cfg.graph.late_fusion_beta if cfg.graph.query_fusion == "late_fusion" else None
            hits = graph.rescored(hits, refined, queries, leaves, beta).select(*HIT)
            seen("graph_rescore", hits)

    # rerank or cut
    if cfg.rerank.enabled:
        scored = hits.join(queries.select("qid", "query"), "qid").withColumn("score", use.rerank(F.col("query"), F.col("content"))).withColumn("score_source", F.lit("cross_encoder"))
        hits = cut(search.ranked(scored.select(*HIT), k).drop("rank"))
        seen("rerank", hits)
    else:
        hits = search.ranked(hits, k).drop("rank")

    # correct
    outcomes = queries.select("qid", F.lit(None).cast("string").alias("confidence"))
    if cfg.correction.enabled:
        if cfg.correction.variant == "sscc":
            kept, judged = decide.threshold_correction(hits, cfg.correction.sscc_tau_bi, cfg.correction.sscc_tau_cross)
            judged = judged.select("qid", "confidence")
        else:
            top = search.ranked(hits, 3).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.substring("content", 1, 500).alias("c")))).alias("t"))
            answer = use.generate(PROMPTS["judge"], F.array_join(F.transform("t", lambda x: x["c"]), "\n"))
            judged, kept = decide.judged_correction(top.select("qid", answer.alias("answer")), cfg.correction.crag_upper, cfg.correction.crag_lower).select("qid", "confidence"), hits
        judged = queries.select("qid", "query").join(judged, "qid", "left").withColumn("confidence", F.coalesce("confidence", F.lit("rewrite"))).persist()
        some = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
        bad = judged.where("confidence = 'rewrite'").join(some, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        sscc = cfg.correction.variant == "sscc"
        tried = F.lit(cfg.correction.enable_query_rewrite) if sscc else F.lit(cfg.correction.enable_query_rewrite) | (F.col("n") == 0)
        bad = bad.withColumn("again", F.when(tried, F.trim(use.generate(PROMPTS["rewrite"], F.col("query"))))).persist()
        asked_again = bad.where("again <> ''").select("qid", use.embed(F.col("again")).alias("embedding"))
        found_again = search.knn(leaves, asked_again, max(k, 5), metric=cfg.metric).join(bad.select("qid", "n"), "qid").where(F.col("rank") <= F.greatest(F.col("n"), F.lit(5)))
        found_again = cut(_as_hits(found_again, nodes))
        got = found_again.select("qid").distinct().withColumn("got", F.lit(True))
        bad = bad.join(got, "qid", "left")
        # what a retry finds replaces the hits; where it finds nothing, or there is none, they stay
        kept = kept.join(bad.select("qid"), "qid", "left_anti").unionByName(found_again).unionByName(hits.join(bad.where("got is null").select("qid"), "qid", "left_semi"))
        nothing = F.when(F.col("n") == 0, "none").otherwise("low")
        failed = F.when(F.col("again") == "", nothing if sscc else F.lit("low")).when(F.col("again").isNull(), "low").otherwise("none" if sscc else nothing)
        settled = bad.select("qid", F.when(F.col("got"), "medium").otherwise(failed).alias("settled"))
        outcomes = judged.join(settled, "qid", "left").select("qid", F.coalesce("settled", "confidence").alias("confidence"))
        hits = cut(kept)
        seen("correct", hits)

    # widen
    if cfg.expansion.enabled:
        hits = spans.with_neighbours(hits, leaves, cfg.expansion.window_chars).select(*HIT)
    final = search.ranked(hits, k).withColumn("modality", modality(F.col("level"), F.col("filename"), F.col("language")))
    rows = trace[0]
    for t in trace[1:]:
        rows = rows.unionByName(t)
    return Result(final, decisions, outcomes, rows)


def _with_prefetch(nodes: DataFrame, queries: DataFrame, cfg: Pipeline, prefetched: tuple[DataFrame, DataFrame], **options) -> Result:
    """Queries that the buffer serves, and the rest through the pipeline."""
    use = options["use"] or Models()
    buffer, results = prefetched
    if "embedding" not in queries.columns:
        queries = queries.withColumn("embedding", use.embed(F.col("query")))
    queries = (queries if "conv_id" in queries.columns else queries.withColumn("conv_id", F.lit(0).cast("long"))).persist()
    served = lookups(buffer, queries, cfg.prefetch.hit_cosine_threshold).where("hit").select("conv_id", "qid", "entity").persist()
    found = served.join(results, ["conv_id", "entity"]).where(F.col("rank") <= cfg.top_k)
    hits = _as_hits(found, _columns(nodes))
    hits = search.ranked(hits).withColumn("modality", modality(F.col("level"), F.col("filename"), F.col("language")))
    counts = served.select("qid").join(found.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left")
    trace = counts.select("qid", F.lit(0).alias("seq"), F.lit("prefetch_hit").alias("stage"), F.coalesce("n", F.lit(0)).alias("n"))
    rest = run(nodes, queries.join(served.select("qid"), "qid", "left_anti"), with_values(cfg, {"prefetch.enabled": False}), **options)
    outcomes = rest.outcomes.unionByName(served.select("qid", F.lit(None).cast("string").alias("confidence")))
    return Result(rest.hits.unionByName(hits), rest.decisions, outcomes, rest.trace.unionByName(trace))


def ablations(nodes: DataFrame, queries: DataFrame, names: tuple[str, ...], base: Pipeline | None = None, **options) -> DataFrame:
    """(config, qid, chunk_id, score) of named variants over one query set."""
    from granary.plans.config import apply

    out = None
    for name in names:
        part = run(nodes, queries, apply(name, base), **options).hits.select(F.lit(name).alias("config"), "qid", "chunk_id", "score")
        out = part if out is None else out.union(part)
    return out
