"""Connected components of a graph that is spread over the cluster.

Contraction: in each round every node points to the best of itself and its
neighbours, by an order that is drawn anew, and edges go over to the
nodes pointed to. What a round leaves is smaller by a share, so most components,
which are small, are gone after the first, and all rounds together cost little
more than that one. At the end the pointers are followed back, from the last
round's small table to the first one's. Nodes and edges stay in tables in the
shared folder; the driver sees one number a round.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from hushlake.llm.common import written

ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the smallest node reachable.

    Minima combine before the shuffle, and a node with many edges is a hot key
    only of joins, which adaptive execution splits.
    """
    left, rounds = written(edges.select("a", "b"), "edges"), []
    for number in range(ROUNDS):
        pointed = written(_pointers(left, number), "pointers")
        rounds.append(pointed)
        here, there = (pointed.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")) for end in ("a", "b"))
        moved = left.filter("a != b").join(here, "a").join(there, "b").filter("a_to != b_to")
        left = written(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        if left.isEmpty():
            break
    else:
        raise RuntimeError("the components did not settle")
    # Who a round's pointers lead to may point on in the next one.
    found = rounds.pop()
    while rounds:
        further = found.select(F.col("node").alias("to"), F.col("to").alias("last"))
        found = rounds.pop().join(further, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    found = written(found, "ends")
    smallest = found.groupBy("to").agg(F.min("node").alias("root"))
    return written(found.join(smallest, "to").select("node", "root"), "components")


def _pointers(edges: DataFrame, number: int) -> DataFrame:
    """(node, to): for each node the first of itself and its neighbours in this round's order."""
    both = edges.select(F.col("a").alias("node"), "b").union(edges.select(F.col("b").alias("node"), F.col("a").alias("b")))
    if edges.schema["a"].dataType == LongType():
        # Numbers are put in another order by turning some of their bits over, and back into numbers by turning them again:
        # a minimum of numbers is aggregated by hash, one of structs by sorting.
        mask = F.lit(random.Random(number).getrandbits(63))
        turned = both.groupBy("node").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("best"))
        return turned.select("node", F.least("best", F.col("node").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to"))

    def placed(node: str) -> Column:
        return F.struct(F.xxhash64(node, F.lit(number)).alias("order"), F.col(node).alias("to"))

    best = both.groupBy("node").agg(F.min(placed("b")).alias("best"))
    return best.select("node", F.least(placed("node"), F.col("best"))["to"].alias("to"))
