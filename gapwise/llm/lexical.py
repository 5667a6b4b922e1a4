"""Ranked lexical search over a length-stratified index.

Documents with the same normaliser ``m`` (their length on the corpus' scale) are one stratum.  The index is
a table sorted by stratum; a hot stratum is cut over several tasks, since the rows are dealt out by range of
(stratum, hash).  In a task the postings of a stratum are ordered by term and term frequency, so that the
impact of a posting is worked out once for all documents of a stratum that hold the term equally often.
The largest impacts bound what any document of a stratum can score for an item.  Strata are visited in the
order of these bounds; a stratum whose bound is below the score that the item's ``k``-th document is known
to reach is not visited.  A first round visits only the best strata of every block and gives that score.

The index holds the postings of the items' terms.  Items are taken in blocks of ``PAIRS`` (item, term)
pairs, which is what a task knows of them; the corpus is read once per block.

Terms are runs of digits, letters A-Z (in lower case) and characters beyond ASCII.  A null text has none.
Rows with the same id are different documents; rows of one item id are one item.  A null document id comes
last among ties.  Nothing is returned for items without terms or without a document that scores above 0.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.llm.common import Scratch, steps

TOP = 50
#: (item, term) pairs that a task holds at once.
PAIRS = 2_000_000
#: Bytes of a text that are cut into terms at once.
SLICE = 1 << 20
#: Largest id of a document; stands for a null among ties.
LAST_ID = np.iinfo(np.int64).max


def _kept(byte: int) -> int:
    if 65 <= byte <= 90:
        return byte + 32
    return byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte >= 128 else 32


_TABLE = bytes(map(_kept, range(256)))


def count_terms(data: bytes) -> tuple[Counter, int]:
    """How often each term occurs in a text of UTF-8 bytes, and all occurrences."""
    counts: Counter = Counter()
    total = start = 0
    plain = data.translate(_TABLE)
    while start < len(plain):
        stop = len(plain) if len(plain) - start <= SLICE else plain.find(b" ", start + SLICE)
        stop = len(plain) if stop < 0 else stop
        words = plain[start:stop].split()
        counts.update(words)
        total += len(words)
        start = stop
    return counts, total


def _bytes_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def item_terms(items: DataFrame, *, key: str, text: str) -> DataFrame:
    """Distinct pairs ``item``, ``term`` (bytes)."""
    named = items.select(F.col(key).alias("item"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("item", items.schema[key].dataType), T.StructField("term", T.BinaryType())])

    def run(batches):
        for batch in steps(batches, "text"):
            found = [list(count_terms(x or b"")[0]) for x in _bytes_of(batch.column("text"))]
            spread = batch.column("item").take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
            yield pa.RecordBatch.from_arrays([spread, pa.array([t for f in found for t in f], pa.binary())], names=schema.names)

    return named.mapInArrow(run, schema).distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], *, key: str, text: str) -> DataFrame:
    """``id``, ``tie`` (a hash of text and id), ``n`` (all terms), and of the vocabulary ``terms`` and their ``tfs``."""
    named = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text, key).alias("tie"), F.col(text).alias("text"))
    numbers = T.ArrayType(T.IntegerType(), False)
    schema = named.drop("text").schema.add("n", "long").add("terms", numbers).add("tfs", numbers)

    def run(batches):
        for batch in steps(batches, "text"):
            sizes, terms, tfs, edges = [], [], [], [0]
            for data in _bytes_of(batch.column("text")):
                counts, total = count_terms(data or b"")
                held = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
                terms += [t for t, _ in held]
                tfs += [c for _, c in held]
                sizes.append(total)
                edges.append(len(terms))
            offsets = pa.array(edges, pa.int32())
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tfs))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), pa.array(sizes, pa.int64()), *lists], names=schema.names)

    return named.mapInArrow(run, schema)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Rows of the index: runs of equal ``m`` are strata, postings are sorted by term, stratum and tf."""

    def __init__(self, m: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray):
        new = np.ones(len(m), bool)
        new[1:] = m[1:] != m[:-1]
        stratum = np.cumsum(new) - 1
        doc = np.repeat(np.arange(len(m)), lengths)
        order = np.lexsort((tfs, stratum[doc], terms))
        self.terms, self.docs = terms[order], doc[order]
        self.strata = stratum[self.docs]
        tfs = tfs[order].astype(np.int64)
        edge = np.ones(len(order), bool)  # a new term, stratum or tf
        edge[1:] = (self.terms[1:] != self.terms[:-1]) | (self.strata[1:] != self.strata[:-1]) | (tfs[1:] != tfs[:-1])
        first = np.flatnonzero(edge)
        once = weights[self.terms[first]] * (1_000_000_000 * tfs[first] // (1000 * tfs[first] + 20 * m[self.docs[first]]))
        self.impacts = np.repeat(once, np.diff(np.append(first, len(order))))
        # The last tf of a term in a stratum is its largest, with the largest impact.
        last = np.ones(len(order), bool)
        last[:-1] = (self.terms[1:] != self.terms[:-1]) | (self.strata[1:] != self.strata[:-1])
        self.tops = np.flatnonzero(last)
        self.top_terms = self.terms[self.tops]
        self.stratum_docs = np.bincount(stratum)
        self.n_docs, self.n_strata = len(m), len(self.stratum_docs)

    @staticmethod
    def _ranges(sorted_terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        starts, stops = np.searchsorted(sorted_terms, wanted, "left"), np.searchsorted(sorted_terms, wanted, "right")
        parts = [np.arange(a, b) for a, b in zip(starts.tolist(), stops.tolist()) if a < b]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def bounds(self, wanted: np.ndarray) -> np.ndarray:
        """The most that a document of each stratum can score."""
        out = np.zeros(self.n_strata, np.int64)
        at = self.tops[self._ranges(self.top_terms, wanted)]
        np.add.at(out, self.strata[at], self.impacts[at])
        return out

    def scores(self, wanted: np.ndarray, visited: np.ndarray) -> np.ndarray:
        """Scores of all documents of the visited strata, 0 elsewhere."""
        out = np.zeros(self.n_docs, np.int64)
        at = self._ranges(self.terms, wanted)
        at = at[visited[self.strata[at]]]
        np.add.at(out, self.docs[at], self.impacts[at])
        return out

    def best(self, wanted: np.ndarray, known: int, ids: np.ndarray, ties: np.ndarray, k: int, only_first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` best documents that score ``known`` or more and above 0."""
        bounds, least = self.bounds(wanted), max(known, 1)
        order = np.argsort(-bounds, kind="stable")
        ahead = np.cumsum(self.stratum_docs[order])  # documents up to each stratum in the order of visits
        scores, done, docs = np.zeros(self.n_docs, np.int64), 0, k
        while done < len(order) and bounds[order[done]] >= least:
            stop = max(done + 1, int(np.searchsorted(ahead, docs)) + 1)
            now = order[done:stop]
            visited = np.zeros(self.n_strata, bool)
            visited[now[bounds[now] >= least]] = True
            scores += self.scores(wanted, visited)
            if (scores > 0).sum() >= k:
                least = max(least, int(np.partition(scores, -k)[-k]))
            if only_first:
                break
            done, docs = stop, 8 * docs
        at = np.flatnonzero(scores >= least)
        at = at[np.lexsort((ties[at], ids[at], -scores[at]))[:k]]
        return at, scores[at]


def _visit(index: DataFrame, terms: list[np.ndarray], weights: np.ndarray, known: list[int], k: int, only_first: bool) -> DataFrame:
    """``no`` (of the item), ``id``, ``tie``, ``score``: the best documents of every block of the index."""
    schema = index.select(F.lit(0).alias("no"), "id", "tie", F.lit(0).cast("long").alias("score")).schema

    def run(batches):
        for batch in steps(batches, "terms"):
            column = batch.column("terms")
            lengths = np.diff(column.offsets.to_numpy())
            block = Block(batch.column("m").to_numpy(), lengths, column.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy(), weights)
            ids = batch.column("id").fill_null(LAST_ID).to_numpy()
            ties = batch.column("tie").to_numpy()
            found = [block.best(wanted, least, ids, ties, k, only_first) for wanted, least in zip(terms, known)]
            rows = pa.array(np.concatenate([at for at, _ in found]))
            no = np.repeat(np.arange(len(found), dtype=np.int32), [len(at) for at, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(no), batch.column("id").take(rows), batch.column("tie").take(rows), pa.array(np.concatenate([s for _, s in found]))], names=schema.names)

    return index.mapInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("id"), "tie")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, pairs: list, scratch: Scratch, k: int, names: dict[str, str]) -> tuple[DataFrame, list] | None:
    vocabulary = {t: i for i, t in enumerate(sorted({p.term for p in pairs}))}
    items: dict = {}
    for pair in pairs:
        items.setdefault(pair.item, []).append(vocabulary[pair.term])
    terms = [np.array(sorted(t), np.int32) for t in items.values()]
    held = scratch.put(postings(docs, vocabulary, **names), "postings")
    total = held.where("n > 0").agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    if not total.N:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    for row in held.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        weights[row.term] = weight(total.N, row["count"])
    m = F.expr(f"50 + (50L * n * {total.N}L) div {total.L}L")
    strata = held.where(F.size("terms") > 0).select("id", "tie", m.alias("m"), "terms", "tfs")
    index = scratch.put(strata.repartitionByRange("m", "tie").sortWithinPartitions("m", "tie"), "index")
    scratch.drop(held)

    reached = _ranked(_visit(index, terms, weights, [0] * len(terms), k, True), k).where(F.col("rank") == k)
    known = [0] * len(terms)
    for row in reached.select("no", "score").collect():  # one number per item of the block
        known[row.no] = row.score
    return _ranked(_visit(index, terms, weights, known, k, False), k), list(items)


def search(
    docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = TOP
) -> DataFrame:
    """``item_key``, ``rank``, ``key`` and ``score`` of the ``k`` best documents of every item."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lexical")
    kind = items.schema[item_key].dataType
    pairs = scratch.put(item_terms(items, key=item_key, text=item_text), "items")
    blocks = math.ceil(pairs.count() / PAIRS)
    dealt = F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1)))
    out = spark.createDataFrame([], T.StructType([T.StructField(item_key, kind), T.StructField("rank", T.IntegerType()), T.StructField(key, T.LongType()), T.StructField("score", T.LongType())]))
    for block in range(blocks):
        found = _search_block(docs, pairs.where(dealt == block).collect(), scratch, k, {"key": key, "text": text})
        if found is not None:
            ranked, names = found
            named = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("no", T.IntegerType()), T.StructField("_item", kind)]))
            rows = ranked.join(F.broadcast(named), "no")
            out = out.unionByName(rows.select(F.col("_item").alias(item_key), "rank", F.col("id").alias(key), "score"))
    return out
