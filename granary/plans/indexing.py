"""Building a node table from files: sections, chunks, vectors, summaries and the tier over documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import models
from granary.operators import chunking, tree
from granary.plans.config import Pipeline


def options(cfg: Pipeline) -> dict:
    h = cfg.raptor
    return {"dims": h.target_dim, "most": h.max_clusters, "covariance": h.cluster_covariance, "threshold": h.soft_cluster_threshold, "refine": h.local_refine_min_nodes, "seed": cfg.seed}


def leaves(sections: DataFrame, cfg: Pipeline, embed: Callable = models.embed) -> DataFrame:
    """Chunks of sections with their vectors, at level 0."""
    chunks = chunking.chunked(sections, cfg.chunking.prose_target_chars, cfg.chunking.prose_min_chars, cfg.chunking.code_target_chars)
    return chunks.withColumn("embedding", embed(F.col("content"))).withColumn("level", F.lit(0)).withColumn("child_ids", F.array().cast("array<string>"))


def index(sections: DataFrame, cfg: Pipeline, embed: Callable = models.embed, summarize: Callable = models.summarize) -> DataFrame:
    """All nodes of a corpus: leaves, summaries by document, and the tier over documents. Leaves alone without a hierarchy."""
    base = leaves(sections, cfg, embed).persist()
    if not cfg.raptor.enabled:
        return base
    h = cfg.raptor
    climbed = tree.hierarchy(base, summarize, embed, h.max_levels, h.min_nodes_for_level, **options(cfg)).persist()
    nodes = base.unionByName(climbed.where("level > 0"), allowMissingColumns=True)
    if h.cross_doc:
        nodes = nodes.unionByName(tree.corpus_tier(climbed, summarize, embed, least=h.min_nodes_for_level, **options(cfg)), allowMissingColumns=True)
    return nodes


def over_flat(nodes: DataFrame, cfg: Pipeline, embed: Callable = models.embed, summarize: Callable = models.summarize) -> DataFrame:
    """``nodes``, leaves of a flat corpus, and the summaries over them; ``nodes`` as they are where they hold summaries already.

    A leaf's document is what stands before the last colon of its id, and leaves follow each other by their ids.
    """
    if not nodes.where("level > 0").isEmpty():
        return nodes
    h = cfg.raptor
    document = F.regexp_replace("chunk_id", r":[^:]*$", "")
    place = F.row_number().over(W.partitionBy("document_id").orderBy("chunk_id")) - 1
    base = nodes.withColumn("document_id", document).withColumn("chunk_index", place.cast("int"))
    climbed = tree.hierarchy(base, summarize, embed, h.max_levels, h.min_nodes_for_level, **options(cfg))
    out = nodes.unionByName(climbed.where("level > 0"), allowMissingColumns=True)
    return out.unionByName(tree.corpus_tier(climbed, summarize, embed, least=h.min_nodes_for_level, **options(cfg)), allowMissingColumns=True) if h.cross_doc else out


def passages(corpus: DataFrame, embed: Callable = models.embed) -> DataFrame:
    """(chunk_id, content) passages as leaves of their own documents."""
    return corpus.select("chunk_id", F.col("chunk_id").alias("document_id"), F.lit(0).alias("chunk_index"), "content", embed(F.col("content")).alias("embedding"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("child_ids"))
