"""Fuzzy line dedup by MinHash on character shingles, one line kept per component.

Lines of ``SHINGLE`` bytes or more are sets of all their eight-byte shingles.  One-permutation MinHash
(every shingle is hashed once and competes in one bin; an empty bin borrows from another) gives the
signature, bands of it make buckets, candidates are confirmed by the exact Jaccard similarity of the
sets, and distributed union-find gives the components.  Of each component the line that comes first by
(id, line number) stays.  Equal lines, by a 128-bit hash, are one node from the start;
that equality is all that links a line too short for a shingle.

Lines without a word stay where they are, as do the order of lines and everything else in a
text.  A null text stays null.  Rows that share an id and a text, by a 128-bit hash of both, are taken for
the same document; different texts under one id, or without one, are different documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.llm.common import Scratch, bind, document_hash, mark_free, steps
from gapwise.llm.linking import linked
from gapwise.llm.near_dup import band_keys, mix, text_bytes

SHINGLE = 8
#: Lines of so many bytes have shingles; shorter ones are linked by equality alone.
LEAST_BYTES = SHINGLE
#: Links: 100 * shared >= PERCENT * union of the shingle sets.
PERCENT = 80
#: A pair at the threshold meets in some band with a probability of 0.997 (0.99 with four to eight shingles).
ROWS, BANDS = 3, 8
BINS = ROWS * BANDS
BAND_KEYS = [f"band{i}" for i in range(BANDS)]
EMPTY = np.uint32(0xFFFFFFFF)
#: Bytes of text whose shingles are hashed at once.
CACHED_BYTES = 128 << 10
#: An odd factor; the upper bits of a product with it depend on all bits of the other factor.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
WORD = r"[^\x20\x09-\x0D]"


def _windows(data: np.ndarray) -> np.ndarray:
    """Every eight bytes in a row as one number."""
    data = np.ascontiguousarray(data)
    return np.ndarray((len(data) - SHINGLE + 1,), "<u8", data, strides=(1,))


def signatures(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Filled bins of every line (each of ``SHINGLE`` bytes or more), some lines at a time that fit a cache."""
    first = np.searchsorted(edges, np.arange(0, edges[-1], CACHED_BYTES))
    cuts = np.unique(np.append(first, len(edges) - 1))
    parts = [_some_signatures(data[edges[a] : edges[b]], edges[a : b + 1] - edges[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.concatenate(parts) if parts else np.zeros((0, BINS), np.uint32)


def _some_signatures(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    rows = len(edges) - 1
    bins = np.full(rows * BINS, EMPTY, np.uint32)
    row = np.repeat(np.arange(rows), np.diff(edges))[: len(data) - SHINGLE + 1]
    inside = np.arange(len(row)) + SHINGLE <= edges[1:][row]
    hashes = mix(_windows(data)[inside])
    place = row[inside] * BINS + ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(bins, place, (hashes & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    bins = bins.reshape(rows, BINS)
    full = bins != EMPTY
    filled = bins.copy()
    attempt = 0
    while not (done := filled != EMPTY).all():
        attempt += 1  # the same detour for every line, so that equal sets borrow alike
        lender = (mix(np.arange(BINS, dtype=np.uint64) + np.uint64(attempt * BINS)) % np.uint64(BINS)).astype(np.int64)
        take = ~done & full[:, lender]
        filled[take] = bins[:, lender][take]
    return filled


#: What names a document: its id and the hash of id and text.
DOC = ("id", "u1", "u2")


def word_lines(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """``id``, ``u1``, ``u2``, ``line_no`` from 0, ``line`` and its hash ``h1``, ``h2``, of all lines with a word."""
    u1, u2 = document_hash(key, text)
    # The hashes of a document come before its lines, or every line would hash the whole text.
    named = docs.select(F.col(key).alias("id"), u1.alias("u1"), u2.alias("u2"), F.col(text).alias("text"))
    lines = named.select(*DOC, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(WORD)).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _signed(lines: DataFrame) -> DataFrame:
    """The lines' places and hashes with their band keys, which are null below ``LEAST_BYTES``."""
    kept = [*DOC, "line_no", "h1", "h2"]
    schema = lines.select(*kept).schema
    for name in BAND_KEYS:
        schema = schema.add(name, T.LongType())

    def run(batches):
        for batch in steps(batches, "line"):
            data, edges = text_bytes(batch.column("line"))
            sizes = np.diff(edges)
            long = sizes >= LEAST_BYTES
            inner = data[np.repeat(long, sizes)]
            keys = np.zeros((len(sizes), BANDS), np.int64)
            if len(inner):
                keys[long] = band_keys(signatures(inner, np.concatenate(([0], np.cumsum(sizes[long])))), ROWS).view(np.int64)
            columns = [*(batch.column(c) for c in kept), *(pa.array(band, mask=~long) for band in keys.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *BAND_KEYS])

    return lines.mapInArrow(run, schema)


def _short(data: np.ndarray) -> np.ndarray:
    """Sixteen bits for every shingle, for bounds only."""
    return (_windows(data) * SPREAD >> np.uint64(48)).astype(np.uint16)


def _short_windows(line: str) -> np.ndarray:
    return _short(np.frombuffer(line.encode(), np.uint8))


def _distinct(data: bytes | np.ndarray) -> np.ndarray:
    ordered = np.sort(_windows(np.frombuffer(data, np.uint8)))
    return ordered[np.append(True, ordered[1:] != ordered[:-1])]


def similar(left: bytes | np.ndarray, right: bytes | np.ndarray) -> bool:
    a, b = _distinct(left), _distinct(right)
    both = np.sort(np.concatenate((a, b)), kind="stable")  # two ascending runs
    shared = np.count_nonzero(both[1:] == both[:-1])
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def similar_pairs(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Which rows of two columns of lines are links; lines of ``LEAST_BYTES`` or more.

    Short hashes come first: they never show less than the shared shingles nor more than all of them.
    """
    (x, x_edges), (y, y_edges) = text_bytes(left), text_bytes(right)
    known = np.zeros(1 << 16, bool)
    x_short, y_short, found = _short(x), _short(y), np.zeros(len(left), bool)
    ends = zip(x_edges[:-1].tolist(), x_edges[1:].tolist(), y_edges[:-1].tolist(), y_edges[1:].tolist(), strict=True)
    for i, (x_start, x_end, y_start, y_end) in enumerate(ends):
        a, b = x_short[x_start : x_end - SHINGLE + 1], y_short[y_start : y_end - SHINGLE + 1]
        known[a] = True
        n_a, shared = np.count_nonzero(known), min(np.count_nonzero(known[b]), len(a))
        known[a] = False
        known[b] = True
        n_b = np.count_nonzero(known)
        known[b] = False
        if 100 * shared >= PERCENT * (n_a + n_b - shared):
            found[i] = similar(x[x_start:x_end], y[y_start:y_end])
    return found


def _same_lines(left: str, right: str) -> bool:
    return similar(left.encode(), right.encode())


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("_x"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("_y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y")

    def run(batches):
        for whole in batches:
            for batch in steps(steps([whole], "_x"), "_y"):
                yield batch.select(["a", "b"]).filter(pa.array(similar_pairs(batch.column("_x"), batch.column("_y"))))

    return both.mapInArrow(run, pairs.select("a", "b").schema)


def duplicate_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``u1``, ``u2`` and ``line_no`` of every line that is not the first of its component."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = word_lines(docs, key=key, text=text)
    signed = scratch.put(_signed(lines), "signed")
    # A number of its own for every different line; it is written, so it stays.
    keys = [F.first(c).alias(c) for c in BAND_KEYS]
    different = signed.groupBy("h1", "h2").agg(*keys, F.count(F.lit(1)).alias("n"))
    bands = F.when(F.col(BAND_KEYS[0]).isNotNull(), F.array(*BAND_KEYS)).alias("bands")
    different = scratch.put(different.select("h1", "h2", "n", bands, F.monotonically_increasing_id().alias("node")), "different")

    held: list[DataFrame] = []

    def prepare(ids: DataFrame):
        wanted = different.select("h1", "h2", F.col("node").alias("id")).join(ids, "id", "left_semi")
        texts = lines.select("h1", "h2", "line").join(wanted, ["h1", "h2"]).groupBy("id").agg(F.first("line").alias("line"))
        held.append(scratch.put(texts, "texts"))
        return lambda pairs: _confirmed(pairs, held[0]), held[0].select("id", F.col("line").alias("payload"))

    items = different.where(F.col("bands").isNotNull()).select(F.col("node").alias("id"), "bands")
    found = linked(items, prepare, _short_windows, scratch, percent=PERCENT, exact=_same_lines)
    # Only lines that repeat or are in a component of several go on; the places of all others stay where they are.
    touched = found.select("node", "root").unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
    grouped = different.select("h1", "h2", "n", "node").join(touched, "node", "left").where("n > 1 or root is not null")
    grouped = scratch.put(grouped.select("h1", "h2", F.coalesce("root", "node").alias("root")), "grouped")
    scratch.drop(*held, different, found)
    places = scratch.put(signed.select(*DOC, "line_no", "h1", "h2").join(grouped, ["h1", "h2"]).select(*DOC, "line_no", "root"), "places")
    scratch.drop(signed, grouped)
    place = F.struct(*DOC, "line_no")
    keepers = places.groupBy("root").agg(F.min(place).alias("keeper"))
    out = scratch.put(places.join(keepers, "root").where(~place.eqNullSafe(F.col("keeper"))).select(*DOC, "line_no"), "dropped")
    scratch.drop(places)
    return out


def dropped_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with duplicate lines: ``id``, ``u1``, ``u2`` and the sorted array ``dropped`` of their numbers.

    A document's line numbers are no more than its text, so the group is bounded by one row.
    """
    found = duplicate_lines(docs, key=key, text=text)
    return found.groupBy(*DOC).agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def _without(text: str | Column, dropped: Column) -> Column:
    """The text without the lines of the given numbers, in time that grows with both."""

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return bind(F.split(text, "\n", -1), rest)


def drop_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, with the duplicate lines taken out of the text, and ``n_dropped_lines``."""
    name, marks = mark_free(docs, "n_dropped_lines"), mark_free(docs, "dropped")
    u1, u2 = mark_free(docs, "_u1"), mark_free(docs, "_u2")
    found = dropped_lines(docs, key=key, text=text).select(F.col("u1").alias(u1), F.col("u2").alias(u2), F.col("dropped").alias(marks))
    first, second = document_hash(key, text)
    # The hashes hold the id as well and are never null, so many rows without an id are no hot key.
    joined = docs.withColumns({u1: first, u2: second}).join(found, [u1, u2], "left").drop(u1, u2)
    changed = F.when(F.col(marks).isNull(), F.col(text)).otherwise(_without(text, F.col(marks)))
    return joined.withColumns({name: F.coalesce(F.size(marks), F.lit(0)), text: changed}).drop(marks)
