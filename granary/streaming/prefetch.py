"""Prefetching while an answer streams: entities, what they fetch, a bounded buffer, and its hits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import models
from granary.functions.text import entities
from granary.functions.vectors import cosine

CAPACITY = 64


def mentions(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, entity) of assistants' turns, streamed or not."""
    return turns.where("role = 'assistant'").select("conv_id", "turn", F.explode(entities(F.col("text"))).alias("entity"))


def unseen(turns: DataFrame) -> DataFrame:
    """(conv_id, entity): each entity once a conversation; on a stream a state keeps those seen."""
    return mentions(turns).select("conv_id", "entity").dropDuplicates(["conv_id", "entity"])


def first_mentions(turns: DataFrame) -> DataFrame:
    return mentions(turns).groupBy("conv_id", "entity").agg(F.min("turn").alias("first_turn"))


def buffered(turns: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(conv_id, entity, first_turn, place): what a buffer holds in the end, the last ``capacity`` entities of a conversation."""
    order = W.partitionBy("conv_id").orderBy(F.desc("first_turn"), F.desc("entity"))
    return first_mentions(turns).withColumn("place", F.row_number().over(order)).where(F.col("place") <= capacity)


def lookups(buffer: DataFrame, queries: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(conv_id, qid, entity, sim, hit): the entry most similar to each query of a conversation, and whether it is similar enough.

    ``buffer`` has conv_id, entity, embedding and place; ``queries`` has conv_id, qid and embedding. Of equals the oldest wins.
    """
    met = queries.select("conv_id", "qid", F.col("embedding").alias("q")).join(buffer.select("conv_id", "entity", "place", "embedding"), "conv_id", "left")
    sim = cosine(F.col("embedding"), F.col("q"))
    best = met.withColumn("sim", sim).groupBy("conv_id", "qid").agg(F.max_by("entity", F.struct("sim", "place")).alias("entity"), F.max("sim").alias("sim"))
    return best.withColumn("hit", F.coalesce(F.col("sim") >= threshold, F.lit(False)))


def token_stream(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n, token): assistants' turns token by token, streamed or not; joined in order they are the text.

    A token is a word with the white space before it; the last one also holds what follows it.
    """
    text = turns.where("role = 'assistant'").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(r"\s*\S+(?:\s+$)?|^\s+$"), F.lit(0)).alias("t"))
    return text.select("conv_id", "turn", F.posexplode("t").alias("n", "token"))


def replayed(turns: DataFrame, cache: DataFrame) -> DataFrame:
    """``token_stream`` where a text that ``cache`` (conv_id, turn, text) holds comes as one token."""
    held = cache.select("conv_id", "turn", F.lit(0).alias("n"), F.col("text").alias("token"))
    rest = turns.join(cache.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    return token_stream(rest).unionByName(held)


def prefetched(turns: DataFrame, leaves: DataFrame, k: int, embed=models.embed, capacity: int = CAPACITY, metric: str = "l2") -> tuple[DataFrame, DataFrame]:
    """(buffer, results): what the entities of a conversation fetched before they are asked for.

    The buffer has conv_id, entity, place and embedding, results conv_id, entity, chunk_id, score and rank. An entity that fetches
    nothing is in the buffer all the same: a query that meets it is served an empty list.
    """
    from granary.operators.search import knn

    buffer = buffered(turns, capacity).withColumn("embedding", embed(F.col("entity")))
    asked = buffer.select(F.col("entity").alias("qid"), "embedding").dropDuplicates(["qid"])
    found = knn(leaves, asked, k, metric=metric).select(F.col("qid").alias("entity"), "chunk_id", "score", "rank")
    return buffer, buffer.select("conv_id", "entity").join(found, "entity")


def hit_rate(found: DataFrame) -> DataFrame:
    return found.agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def batch_hits(turns: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(conv_id, qid, hit) of users' turns against the entities that assistants named."""
    held = buffered(turns).withColumn("embedding", models.embed(F.col("entity")))
    asked = turns.where("role = 'user'").select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("qid"), models.embed(F.col("text")).alias("embedding"))
    return lookups(held, asked, threshold).select("conv_id", "qid", "hit")


def buffer_stream(turns: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(conv_id, entity, size) from a stream of turns: each new entity as it enters its conversation's buffer, oldest ones leaving.

    The state of a conversation is the list of the entities in its buffer and the set of those seen.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen = (list(x) for x in (state.get if state.exists else ([], [])))
        known, out = set(seen), []
        for pdf in batches:
            for entity in pdf.sort_values(["turn", "entity"])["entity"]:
                if entity not in known:
                    known.add(entity)
                    seen.append(entity)
                    held = [*held, entity][-capacity:]
                    out.append((key[0], entity, len(held)))
        state.update((held, seen))
        yield pd.DataFrame(out, columns=["conv_id", "entity", "size"])

    return mentions(turns).groupBy("conv_id").applyInPandasWithState(step, "conv_id long, entity string, size int", "held array<string>, seen array<string>", "append", GroupStateTimeout.NoTimeout)
