"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stage, unstage


def _shuffled_key(c):
    """A bijection of longs by shifts, so that the least key of a neighbourhood is a random node of it."""
    for _ in range(3):  # low bits of neighbouring ids must reach the high ones
        c = c.bitwiseXOR(F.shiftleft(c, 13))
        c = c.bitwiseXOR(F.shiftrightunsigned(c, 7))
        c = c.bitwiseXOR(F.shiftleft(c, 17))
    return c


#: Rounds after which the nodes' pointers are written down, so that plans stay short.
_ROUNDS = 4


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component_id) of every node of an edge; component_id is the smallest id that links reach.

    Each round points every node to the least (in a fixed random order) of itself and its neighbours and contracts the edges
    to these. The nodes left fall by a constant factor on average, chains included, so rounds grow with the logarithm of the
    longest path. Nothing but one emptiness test a round reaches the driver. Edges with a null end or with equal ends link
    nothing; no edges give no rows.
    """
    e = edges.select(F.col(u).cast("long").alias("a"), F.col(v).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    ids = stage(e.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "cc-ids")
    e = stage(e.select(_shuffled_key(F.col("a")).alias("a"), _shuffled_key(F.col("b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    root = ids.select("id", _shuffled_key(F.col("id")).alias("k"))
    done = 0
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        to = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-map")
        left = to.select(F.col("a"), F.col("m").alias("x"))
        right = to.select(F.col("a").alias("b"), F.col("m").alias("y"))
        last = e
        e = stage(e.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        unstage(last)
        root = root.join(to.select(F.col("a").alias("k"), "m"), "k", "left").select("id", F.coalesce("m", "k").alias("k"))
        done += 1
        if done % _ROUNDS == 0:
            root = stage(root, "cc-roots")
    root = stage(root, "cc-roots")
    least = root.groupBy("k").agg(F.min("id").alias("component_id"))
    return root.join(least, "k").select("id", "component_id")
