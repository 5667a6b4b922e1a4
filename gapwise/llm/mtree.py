"""Exact top-k search by inner product with forests of M-trees.

Inner product is made a metric first: with one more coordinate a vector becomes
``(x, sqrt(M - |x|^2))`` and a query ``(q, 0)``, where M is the largest squared norm.  All vectors then lie
on a sphere, and ``d(q, x)^2 = |q|^2 + M - 2 <q, x>`` falls as the score rises.

An M-tree is a tree of pages.  A page's entries hold a routing vector, a covering radius and the distance
to the parent's routing vector.  The search opens pages best first, by their least possible distance.
Before it works out the distance to an entry it tries the bound that the triangle inequality gives from
the two stored distances, and most entries are never computed.

Vectors are dealt out evenly by a hash to trees of about ``TREE_ROWS``, and queries to blocks; every tree
meets every block of queries in a group of its own.  Each query brings k rows per tree to the final rank.
Scores are integers and exact: distances only decide which pages are opened, with slack for rounding, and
a page stays in play as long as it could hold an equal score, so ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.llm.common import Scratch

PAGE = 128
TREE_ROWS = 8_192
QUERY_BLOCK = 256
#: Of distances in units of 1 / 1024, far above their rounding.
SLACK = 1e-3
UNIT = 1024.0


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def quantised(vector: Column) -> Column:
    """floor(1024 x) of every component, x as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * UNIT).cast("long"))


class MTree:
    """A bulk-loaded M-tree over the rows of ``points``; rows are leaf entries, in id order."""

    def __init__(self, points: np.ndarray, page: int = PAGE, seed: int = 1):
        self.points = points
        self.random = np.random.default_rng(seed)
        self.page = page
        # Of every page: routing vectors, radii, distances to the parent, and children (pages or rows).
        self.pages: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]] = []
        self.root = self._build(np.arange(len(points)), None)[0] if len(points) else -1
        self.norms = [(centres**2).sum(1) for centres, *_ in self.pages]

    def _distances(self, rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((self.points[rows] - centre) ** 2).sum(1), 0.0))

    def _build(self, rows: np.ndarray, centre: np.ndarray | None) -> tuple[int, float]:
        """A page over the rows; its number and its covering radius around the centre."""
        if len(rows) <= self.page:
            to_parent = self._distances(rows, centre) if centre is not None else np.zeros(len(rows))
            self.pages.append((self.points[rows], np.zeros(len(rows)), to_parent, rows, True))
            return len(self.pages) - 1, float(to_parent.max(initial=0.0))
        groups = self._partition(rows)
        centres, radii, children = [], [], []
        for group in groups:
            middle = self.points[group[self._distances(group, self.points[group].mean(0)).argmin()]]
            child, radius = self._build(group, middle)
            centres.append(middle)
            radii.append(radius)
            children.append(child)
        centres, radii = np.array(centres), np.array(radii)
        to_parent = np.sqrt(((centres - centre) ** 2).sum(1)) if centre is not None else np.zeros(len(centres))
        self.pages.append((centres, radii, to_parent, np.array(children), False))
        reach = float(self._distances(rows, centre).max()) if centre is not None else 0.0
        return len(self.pages) - 1, reach

    def _partition(self, rows: np.ndarray) -> list[np.ndarray]:
        """At most a page of groups around chosen members; equal vectors are cut evenly instead."""
        wanted = min(self.page, -(-len(rows) // self.page))
        picks = self.points[self.random.choice(rows, wanted, replace=False)]
        x = self.points[rows]
        near = ((x**2).sum(1)[:, None] - 2 * x @ picks.T + (picks**2).sum(1)[None, :]).argmin(1)
        groups = [rows[near == i] for i in range(wanted)]
        groups = [g for g in groups if len(g)]
        if len(groups) < 2 or max(map(len, groups)) > 0.9 * len(rows):
            return np.array_split(rows, wanted)
        return groups

    def search(self, query: np.ndarray, k: int, score) -> list[tuple[int, int]]:
        """The k best (score, row); ``score(rows)`` gives exact scores, ``query`` a point of the metric."""
        best: list[tuple[int, int]] = []  # a heap: the worst of the best on top, as (score, -row)
        if self.root < 0:
            return []
        heap: list[tuple[float, int, float | None]] = [(0.0, self.root, None)]
        bound, length = np.inf, float(query @ query)
        self.computed = 0
        while heap:
            low, number, to_centre = heapq.heappop(heap)
            if low > bound + SLACK:
                break
            centres, radii, to_parent, children, leaf = self.pages[number]
            open_ = np.arange(len(radii))
            if to_centre is not None:
                open_ = np.flatnonzero(np.abs(to_centre - to_parent) - radii <= bound + SLACK)
            if not len(open_):
                continue
            some = centres if len(open_) == len(radii) else centres[open_]
            norms = self.norms[number][open_]
            distances = np.sqrt(np.maximum(norms - 2.0 * (some @ query) + length, 0.0))
            self.computed += len(open_)
            if leaf:
                near = distances <= bound + SLACK
                rows, distances = children[open_[near]], distances[near]
                for value, row in zip(score(rows).tolist(), rows.tolist(), strict=True):
                    entry = (value, -row)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    bound = self._distance_of(best[0][0])
            else:
                lows = np.maximum(distances - radii[open_], 0.0)
                for i in np.flatnonzero(lows <= bound + SLACK).tolist():
                    heapq.heappush(heap, (float(lows[i]), int(children[open_[i]]), float(distances[i])))
        return sorted(((value, -row) for value, row in best), key=lambda e: (-e[0], e[1]))

    def _distance_of(self, score: int) -> float:
        return float(np.sqrt(max(self.offset - 2.0 * score, 0.0)))


def tree_of(vectors: np.ndarray, seed: int = 1) -> MTree:
    """A tree over integer vectors, in the metric of the inner product."""
    norms = (vectors**2).sum(1)
    largest = int(norms.max(initial=0))
    tree = MTree(np.column_stack((vectors, np.sqrt(largest - norms))).astype(np.float64), seed=seed)
    tree.largest = largest
    return tree


def search(tree: MTree, vectors: np.ndarray, query: np.ndarray, k: int, skip: np.ndarray) -> list[tuple[int, int]]:
    """The k rows of the highest inner product; ``skip`` marks rows that are the query itself."""
    tree.offset = float((query**2).sum() + tree.largest)
    own = len(skip)
    found = tree.search(np.append(query, 0).astype(np.float64), k + own, lambda rows: vectors[rows] @ query)
    return [(s, r) for s, r in found if r not in skip][:k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1).astype(np.int64)


def _each(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))


def top_k(vectors: DataFrame, queries: Column, *, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` from 1, ``key`` and ``score`` of the k best other rows of every query.

    ``queries``: which rows are queries.  Vectors that are null, empty, or hold null or non-finite
    components take no part, nor do rows with a null id.  Vectors only meet others of their length.  A row
    is not compared with rows of its own id; rows that repeat an id all count, and each of them that is a
    query has a ranking of its own.
    """
    scratch = Scratch(vectors.sparkSession, "mtree")
    rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector)).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    # A number of its own for every row; it is written, so it stays.
    rows = scratch.put(rows.withColumns({"size": F.size("v"), "row": F.monotonically_increasing_id()}), "vectors")
    count, asked = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    trees, blocks = max(1, -(-count // TREE_ROWS)), max(1, -(-asked // QUERY_BLOCK))
    # Trees and blocks are dealt by hashes of row numbers, so equal vectors and ids spread over all of them.
    place = F.xxhash64("row")
    points = rows.select("size", F.pmod(place, F.lit(trees)).alias("tree"), F.lit(False).alias("asks"), "row", "id", "v")
    asks = rows.where("is_query").select("size", _each(trees).alias("tree"), F.lit(True).alias("asks"), "row", "id", "v")
    asks = asks.withColumn("block", F.pmod(place, F.lit(blocks)))
    points = points.withColumn("block", _each(blocks))
    both = points.unionByName(asks)
    schema = both.select("row", F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.col("id").alias("score")).schema

    def meet(table: pa.Table) -> pa.Table:
        asking = table.column("asks").to_numpy(zero_copy_only=False)
        ids, matrix = table.column("id").to_numpy(), _matrix(table.column("v"))
        order = np.argsort(ids[~asking], kind="stable")
        own, points = ids[~asking][order], matrix[~asking][order]
        tree = tree_of(points)
        out = list(_answers(tree, points, own, table.column("row").to_numpy()[asking], ids[asking], matrix[asking], k))
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(schema.names, zip(*out, strict=True) if out else [[]] * len(schema), strict=True)})

    near = both.groupBy("size", "tree", "block").applyInArrow(meet, schema)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(key), "score")


def _answers(
    tree: MTree, points: np.ndarray, own: np.ndarray, rows: np.ndarray, asking: np.ndarray, queries: np.ndarray, k: int
) -> Iterator[tuple[int, int, int, int]]:
    for number, query_id, query in zip(rows.tolist(), asking.tolist(), queries, strict=True):
        first, last = np.searchsorted(own, query_id, "left"), np.searchsorted(own, query_id, "right")
        for score, row in search(tree, points, query, k, np.arange(first, last)):
            yield number, query_id, int(own[row]), score
