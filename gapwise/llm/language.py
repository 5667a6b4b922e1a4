"""Language identification with bit-sliced Bloom filters of character n-grams.

Learning counts the n-grams of every language's texts.  A language holds the n-grams that make up at least
``SHARE`` of its text, so no language can hold more than 1 / ``SHARE`` of them, however large the corpus.
Each language has a Bloom filter of the same length, and the filters stand bit by bit beside each other: one
place holds one bit per language, so that the conjunction of an n-gram's ``HASHES`` places is the bit mask of
all languages that hold it.  A text's hits per language are the population counts of these masks.  A filter
that is filled to p answers yes by chance with p ** ``HASHES``; hits are corrected for that, and the language
with the largest share of the text's n-grams decides.

N-grams are of letters in lower case, with at most the ends of one word inside: each letter is the middle of
one trigram, and each two neighbours those of one four-gram.  Anything but a letter ends a word.

A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned.
Where no n-gram is known, the language of the most text is taken, with score 0.  Rows with a null language or
text teach nothing.  Repeated rows count as often as they stand there.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.llm.common import Scratch, mark_free, steps
from gapwise.llm.near_dup import mix

#: Part of a language's n-grams that one n-gram makes up at least, to be held by it.
SHARE = 1e-5
HASHES = 4
#: Places of a filter per n-gram of the language that holds the most.
PLACES = 12
#: Places that are put together in one row of the model.
SEGMENT = 1 << 18
#: Distinct n-grams that a task counts before it hands them on.
COUNTED = 1 << 20
#: Bytes of all filters at most; with ``SHARE`` this is enough for thousands of languages.
MOST_BYTES = 1 << 30

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """The letter in lower case for every code point, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            lower = char.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts as 64-bit numbers, and the number of the text of each."""
    texts = [t or "" for t in texts]
    codes = np.frombuffer((" " + "".join(t + " " for t in texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.concatenate(([0], np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])))
    letter = _letters()[codes]
    kept = letter != 0
    kept[1:] |= letter[:-1] != 0  # one end of a word after its last letter
    kept[0] = True
    x, owner = letter[kept].astype(np.uint64), owner[kept]
    if len(x) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    threes = x[:-2] | x[1:-1] << np.uint64(21) | x[2:] << np.uint64(42)
    inner = x[1:-1] != 0
    fours = mix(threes[:-1] * _GOLDEN + x[3:] + np.uint64(1))
    inner_fours = inner[:-1] & inner[1:]
    # A text's own letters are in the middle, so they name the text.
    return np.concatenate((mix(threes[inner]), fours[inner_fours])), np.concatenate((owner[1:-1][inner], owner[1:-2][inner_fours]))


def counted(docs: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n`` of all rows (``text``, ``lang``)."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def rows(held: dict[str, list]):
        for lang, parts in held.items():
            gram, n = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=schema.names)

    def run(batches):
        held: dict[str, list] = {}
        for batch in steps(batches, "text"):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                found, _ = grams([t for t, other in zip(texts, langs) if other == lang])
                part = np.unique(found, return_counts=True)
                held[lang] = [_summed([*held.get(lang, []), part])]
            if sum(len(parts[0][0]) for parts in held.values()) > COUNTED:
                yield from rows(held)
                held = {}
        yield from rows(held)

    partial = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").mapInArrow(run, schema)
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    n = np.zeros(len(gram), np.int64)
    np.add.at(n, at, np.concatenate([c for _, c in parts]))
    return gram, n


def places(gram: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of n-grams in filters of ``size`` (a power of two) places."""
    step = mix(gram ^ _GOLDEN) | np.uint64(1)
    return [((gram + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


class Model:
    """``slices``: one row of bytes per place, one bit per language."""

    def __init__(self, langs: list[str], slices: np.ndarray):
        self.langs, self.slices = langs, slices
        values = np.arange(256, dtype=np.uint8)[:, None]
        self.bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.int64)
        filled = self._counts(slices, np.zeros(len(slices), np.int64), 1)[0]
        self.chance = (filled / max(1, len(slices))) ** HASHES

    def _counts(self, masks: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
        """Population counts per text and language."""
        parts = [np.bincount(owner * 256 + masks[:, w], minlength=rows * 256).reshape(rows, 256) @ self.bits for w in range(masks.shape[1])]
        return np.concatenate(parts, axis=1)[:, : len(self.langs)]

    def masks(self, gram: np.ndarray) -> np.ndarray:
        at = places(gram, len(self.slices))
        found = self.slices[at[0]]
        for other in at[1:]:
            found = found & self.slices[other]
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        gram, owner = grams(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        hits = self._counts(self.masks(gram), owner, len(texts))
        share = (hits / np.maximum(total, 1)[:, None] - self.chance) / np.maximum(1 - self.chance, 1e-9)
        share = np.clip(share, 0.0, 1.0)
        best = share.argmax(axis=1)
        scores = np.where(total > 0, share[np.arange(len(texts)), best], 0.0)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), total.tolist())], scores.tolist()


def learn(docs: DataFrame, scratch: Scratch) -> Model:
    """A model of the languages of ``lang`` from all rows (``text``, ``lang``)."""
    found = scratch.put(counted(docs), "counts")
    totals = found.groupBy("lang").agg(F.sum("n").alias("total"))
    held = scratch.put(found.join(totals, "lang").where(F.col("n") >= SHARE * F.col("total")).select("lang", "gram", "total"), "held")
    scratch.drop(found)
    # One row per language: the ones with more text come first and win ties.
    sizes = held.groupBy("lang").agg(F.count(F.lit(1)).alias("grams"), F.max("total").alias("total")).collect()
    langs = [r.lang for r in sorted(sizes, key=lambda r: (-r.total, r.lang))]
    width = max(1, -(-len(langs) // 8))
    size = 1 << max(10, (PLACES * max((r.grams for r in sizes), default=1) - 1).bit_length())
    if size * width > MOST_BYTES:
        raise ValueError(f"filters of {len(langs)} languages need {size * width} bytes")
    number = F.create_map(*[F.lit(x) for pair in enumerate(langs) for x in (pair[1], pair[0])]) if langs else None
    slices = np.zeros((size, width), np.uint8)
    if langs:
        for row in _segments(held.select("gram", number[F.col("lang")].alias("bit")), size, width).toLocalIterator():
            part = np.frombuffer(row.slices, np.uint8).reshape(-1, width)
            slices[row.segment * SEGMENT : row.segment * SEGMENT + len(part)] = part
    scratch.drop(held)
    return Model(langs, slices)


def _segments(held: DataFrame, size: int, width: int) -> DataFrame:
    """The filters in rows of ``SEGMENT`` places, each put together by one task."""
    schema = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("bit", T.IntegerType())])

    def spread(batches):
        for batch in batches:
            at = np.concatenate(places(batch.column("gram").to_numpy().view(np.uint64), size))
            bit = np.tile(batch.column("bit").to_numpy(), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array((at // SEGMENT).astype(np.int32)), pa.array((at % SEGMENT).astype(np.int32)), pa.array(bit)], names=schema.names)

    def build(batches):
        current, part = None, None
        for batch in batches:
            segment, place, bit = (batch.column(c).to_numpy() for c in schema.names)
            for number in np.unique(segment).tolist():
                if number != current:
                    if part is not None:
                        yield row(current, part)
                    current, part = number, np.zeros((min(size, SEGMENT), width), np.uint8)
                here = segment == number
                np.bitwise_or.at(part, (place[here], bit[here] // 8), (1 << (bit[here] % 8)).astype(np.uint8))
        if part is not None:
            yield row(current, part)

    def row(number, part):
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["segment", "slices"])

    return held.mapInArrow(spread, schema).repartition("segment").sortWithinPartitions("segment").mapInArrow(build, "segment int, slices binary")


def held_out(key: Column) -> Column:
    """A quarter of the ids that nothing is learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text, if none are named) with ``lang_pred`` and ``score``."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    source = mark_free(docs, "_text")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in steps(batches, source):
            langs, scores = model.predict(batch.column(source).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*keep, F.col(text).alias(source)).mapInArrow(run, schema)
