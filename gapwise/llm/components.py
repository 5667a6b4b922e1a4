"""Connected components by alternating large and small stars, as joins and partial aggregates.

Only the edges move; a node with very many edges is no group of one task, since the smallest neighbour
is a partial aggregate and the join back on it is one that adaptive execution can split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import Scratch

MOST_ROUNDS = 60
#: So few edges (counted) are joined by one task in one pass; any more are dealt out by node.
ONE_TASK = 200_000


def _star(edges: DataFrame, *, large: bool) -> DataFrame:
    """Join the neighbours of every node (the larger ones, or itself and the smaller) to the smallest."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
    moved = both.where(F.col("b") > F.col("a")) if large else both
    joined = moved.join(least, "a").select(F.col("b").alias("x"), "root")
    if not large:
        joined = joined.union(least.select(F.col("a").alias("x"), "root"))
    return joined.where(F.col("x") != F.col("root")).select(F.col("x").alias("a"), F.col("root").alias("b")).distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                low, high = sorted((root(a), root(b)))
                above[high] = low
        nodes = list(above)
        rows = [(x, r) for x in nodes if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node of an edge that is not
    its component's root.  ``edges``: longs ``a`` and ``b``; loops, repeats and nulls are left out."""
    ordered = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = scratch.put(ordered, "edges")
    seen = None
    if current.limit(ONE_TASK + 1).count() <= ONE_TASK:
        found = scratch.put(_in_one_task(current), "roots")
        scratch.drop(current)
        return found
    for _ in range(MOST_ROUNDS):
        stars = _star(_star(current, large=True), large=False)
        following = scratch.put(stars, "stars")
        state = tuple(following.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        scratch.drop(current)
        current = following
        if state == seen or not state[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError("the components did not settle")
