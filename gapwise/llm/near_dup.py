"""Near duplicates by circulant MinHash on word shingles, confirmed on full sets.

Signature: a first permutation scatters the shingles over a ring of 2^32 places, and a second permutation of
the ring, shifted by one place per coordinate, gives every coordinate: two permutations in all.  Bands of
coordinates make buckets; pairs inside buckets are confirmed by the exact Jaccard similarity of the full
shingle sets.

Documents with equal sets are one class from the start, so thousands of copies are one row; the rounds
in which the members of buckets meet are those of ``linking``.

Nulls and texts without words have no shingles and are linked with nothing.  Rows that share an id and a
text, by a 128-bit hash of both, are one document; different texts under one id are different documents, and
so are different texts without an id.  A component's documents without an id come last: its id is the
smallest that there is, and null only if no document of it has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.llm.common import Scratch, document_hash, mark_free, steps
from gapwise.llm.linking import linked, short_hashes

WORDS = 5
#: Links: 100 * shared >= PERCENT * union.
PERCENT = 75
ROWS, BANDS = 4, 32

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, size: int) -> np.ndarray:
    powers = np.full(size, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the edges of its rows; a null is empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return data, edges - edges[0]


def shingle_sets(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, row after row in ascending order, and how many each row has."""
    rows = len(edges) - 1
    lower = _LOWER[data]
    word_byte = ~_IS_SPACE[lower]
    first = word_byte.copy()
    if len(data) > 1:
        starts_row = np.zeros(len(data) + 1, bool)
        starts_row[edges[:-1]] = True
        first[1:] &= ~word_byte[:-1] | starts_row[1:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    last = word_byte.copy()
    last[:-1] &= ~word_byte[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=prefix[1:])
    words = mix((prefix[ends] - prefix[starts]) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)
    row_of = np.searchsorted(edges, starts, "right") - 1
    counts = np.bincount(row_of, minlength=rows)
    first_word = np.cumsum(counts) - counts

    total = len(words)
    hashes = np.zeros(total, np.uint64)
    for place in range(min(WORDS, total)):  # the words of a shingle, each in its place
        hashes[: total - place] = mix(hashes[: total - place] * _GOLDEN + words[place:] + np.uint64(place + 1))
    inside = np.arange(total) + WORDS <= (first_word + counts)[row_of]
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    for row in short.tolist():  # fewer words: the whole sequence is the one shingle
        value = np.uint64(counts[row])
        for word in words[first_word[row] : first_word[row] + counts[row]]:
            value = mix(np.array([value], np.uint64) * _GOLDEN + word)[0]
        hashes[first_word[row]], inside[first_word[row]] = value, True
    hashes, row_of = hashes[inside], row_of[inside]
    order = np.lexsort((hashes, row_of))
    hashes, row_of = hashes[order], row_of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row_of[1:] != row_of[:-1])
    return hashes[new], np.bincount(row_of[new], minlength=rows)


def _second(places: np.ndarray) -> np.ndarray:
    """A bijective scrambling of the ring of 32-bit places, in place."""
    places ^= places >> np.uint32(16)
    places *= np.uint32(0x7FEB352D)
    places ^= places >> np.uint32(15)
    places *= np.uint32(0x846CA68B)
    return places


class Circulant:
    """All coordinates of a signature from two permutations, the second one shifted."""

    #: Shingles that are taken through all shifts at once, so that they stay near the processor.
    STRIDE = 1 << 15

    def __init__(self, coordinates: int = ROWS * BANDS):
        self.coordinates = coordinates

    def signatures(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row of coordinates per non-empty set (``counts`` of them without zeros)."""
        places = (mix(hashes ^ _GOLDEN) >> np.uint64(32)).astype(np.uint32)
        out = np.full((len(counts), self.coordinates), 0xFFFFFFFF, np.uint32)
        ends = np.cumsum(counts)
        for start in range(0, len(places), self.STRIDE):
            some = places[start : start + self.STRIDE]
            first, last = np.searchsorted(ends, [start, start + len(some) - 1], "right")
            edges = np.maximum(ends[first : last + 1] - counts[first : last + 1] - start, 0)
            part = out[first : last + 1]
            for shift in range(self.coordinates):
                least = np.minimum.reduceat(_second(some + np.uint32(shift)), edges)
                np.minimum(part[:, shift], least, out=part[:, shift])
        return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates; the band's number is part of it."""
    bands = signatures.shape[1] // rows
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)).copy()
    for i in range(rows):
        keys = mix(keys * _GOLDEN + signatures[:, i : bands * rows : rows].astype(np.uint64))
    return keys


def signatures(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``u1`` and ``u2`` of id and text, ``n_shingles``, a 128-bit digest of the set (``d1``, ``d2``) and the band keys."""
    u1, u2 = document_hash(key, text)
    named = docs.select(F.col(key).cast("long").alias("id"), u1.alias("u1"), u2.alias("u2"), F.col(text).alias("text"))
    schema = named.drop("text").schema.add("n_shingles", "long").add("d1", "long").add("d2", "long").add("bands", T.ArrayType(T.LongType(), False))

    def run(batches):
        circulant = Circulant()
        for batch in steps(batches, "text"):
            hashes, counts = shingle_sets(*text_bytes(batch.column("text")))
            full = np.flatnonzero(counts)
            digests = np.zeros((2, len(counts)), np.uint64)
            keys, sizes = np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
            if len(full):
                some = counts[full]
                starts = np.cumsum(some) - some
                digests[0, full] = np.add.reduceat(mix(hashes), starts)
                digests[1, full] = np.add.reduceat(mix(hashes ^ _M2), starts)
                keys = band_keys(circulant.signatures(hashes, some), ROWS).ravel()
                sizes[full] = BANDS
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "u1", "u2")), pa.array(counts, pa.int64()), *(pa.array(d.view(np.int64)) for d in digests), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64)))],
                names=["id", "u1", "u2", "n_shingles", "d1", "d2", "bands"],
            )

    return named.mapInArrow(run, schema)


def _read_short(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, np.uint16)


def sets_of(docs: DataFrame, wanted: DataFrame, *, key: str, text: str) -> DataFrame:
    """``id``, the full set of shingle hashes and short hashes of it, of the wanted documents (``id``, ``u1``, ``u2``)."""
    u1, u2 = document_hash(key, text)
    named = docs.select(u1.alias("u1"), u2.alias("u2"), F.col(text).alias("text"))
    chosen = named.join(wanted, ["u1", "u2"]).select("id", "text").dropDuplicates(["id"])
    schema = wanted.select("id").schema.add("shingles", T.ArrayType(T.LongType(), False)).add("short", "binary")

    def run(batches):
        for batch in steps(batches, "text"):
            hashes, counts = shingle_sets(*text_bytes(batch.column("text")))
            edges = np.concatenate(([0], np.cumsum(counts)))
            short = [short_hashes(hashes[a:b]).tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            sets = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), sets, pa.array(short, pa.binary())], names=["id", "shingles", "short"])

    return chosen.mapInArrow(run, schema)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_y"))
    shared = F.size(F.array_intersect("_x", "_y"))
    return pairs.join(left, "a").join(right, "b").where(100 * shared >= PERCENT * (F.size("_x") + F.size("_y") - shared)).select("a", "b")


def verdicts(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """``id``, ``u1``, ``u2``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    The document of a component that comes first by id and hash is kept, in all its copies.
    """
    scratch = Scratch(docs.sparkSession, "near")
    signed = scratch.put(signatures(docs, key=key, text=text), "signatures")
    real = signed.where("n_shingles > 0")
    document = F.struct(F.col("id").isNull().alias("none"), "id", "u1", "u2")
    first = real.groupBy("d1", "d2", "n_shingles").agg(F.min(document).alias("first"), F.min_by("bands", document).alias("bands"))
    # A number of its own for every class; it is written, so it stays.
    first = scratch.put(first.withColumn("node", F.monotonically_increasing_id()), "classes")

    held: list[DataFrame] = []

    def prepare(ids: DataFrame):
        wanted = first.select(F.col("node").alias("id"), "first.u1", "first.u2").join(ids, "id", "left_semi")
        sets = scratch.put(sets_of(docs, wanted, key=key, text=text), "sets")
        held.append(sets)
        return lambda pairs: confirmed(pairs, sets), sets.select("id", F.col("short").alias("payload"))

    found = linked(first.select(F.col("node").alias("id"), "bands"), prepare, _read_short, scratch, percent=PERCENT)
    scratch.drop(*held)
    roots = first.select("d1", "d2", "n_shingles", "node", "first").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keepers = roots.groupBy("root").agg(F.min("first").alias("keeper"))
    roots = roots.join(keepers, "root").select("d1", "d2", "n_shingles", "keeper")
    out = signed.select("id", "u1", "u2", "n_shingles", "d1", "d2").join(roots, ["d1", "d2", "n_shingles"], "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("id")).otherwise(F.col("keeper.id"))
    kept = alone | (F.col("u1").eqNullSafe(F.col("keeper.u1")) & F.col("u2").eqNullSafe(F.col("keeper.u2")) & F.col("id").eqNullSafe(F.col("keeper.id")))
    return out.select("id", "u1", "u2", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest id that links reach) and ``kept`` of every row."""
    return verdicts(docs, key=key, text=text).select(F.col("id").alias(key), "n_shingles", "component_id", "kept")


def kept_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept rows with all their columns, one of those that share an id and a text."""
    first, second = mark_free(docs, "_u1"), mark_free(docs, "_u2")
    kept = verdicts(docs, key=key, text=text).where("kept").select(F.col("u1").alias(first), F.col("u2").alias(second)).distinct()
    u1, u2 = document_hash(key, text)
    rows = docs.withColumns({first: u1, second: u2}).join(kept, [first, second], "left_semi")
    return rows.dropDuplicates([first, second]).drop(first, second)
