"""Removal of repeated byte strings by sorting suffixes bucket by bucket with a difference cover.

Every 400-byte window of a text belongs to the suffix bucket of its least 64-byte gram (by hash), so equal
windows always share a bucket, wherever they start.  Neighbouring windows of one bucket are a run; the run
and the bytes that its windows cover are its context.  Only ids, hashes and places of runs are grouped:

1. A bucket with a single run has no repeats and is left out; so is most of the corpus.
2. Runs with equal contexts (128-bit digests) are repeated as a whole; one of each stands for the others.
3. The different contexts of a bucket meet.  Buckets are sorted a block at a time, whole buckets to a
   block, so memory is bounded by the block.  Ranks of the positions of a difference cover (residues 1, 2
   and 4 modulo 7) are worked out first, for lengths of 7, 14, ... 224 bytes by doubling: a cover position
   plus a multiple of 7 is a cover position.  Two windows i and j then have an offset d < 7 at which both
   stand on cover positions; they are equal if their eight outer bytes and the ranks at i + d and j + d are.
   So ties of 400 bytes cost two comparisons and no text is read again.
4. A bucket with more than ``HOT`` different contexts is no group of one task: its windows are counted as
   rows by 128-bit digests.

Matches never cross documents, and strings are judged on the input.  A null text is empty.  Rows that
repeat an id and a text are different documents of equal text, so both lose what they share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import Scratch, steps
from gapwise.llm.near_dup import _powers, mix, text_bytes

LENGTH = 400
GRAM = 64
#: Grams of a window.
SPAN = LENGTH - GRAM + 1
HOT = 512
#: Keys that the contexts of one bucket are dealt over.
PARTS = 512
BLOCK_BYTES = 2 << 20

# A perfect difference cover; the doubled lengths 224 + 112 + 56 = 392 leave eight bytes.
MODULUS, COVER = 7, (1, 2, 4)
TAIL = 8

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_INVERSES = tuple(pow(base, -1, 1 << 64) for base in _BASES)


class Rolling:
    """Hashes of any substring of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASES[which], max(1, len(data)))[: len(data)], out=self.prefix[1:])
        self.inverse = _powers(_INVERSES[which], len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])

    def every(self, size: int) -> np.ndarray:
        return mix((self.prefix[size:] - self.prefix[:-size]) * self.inverse[: len(self.prefix) - size])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` in a row, by running minima from both ends of blocks."""
    size = len(values)
    padded = np.concatenate((values, np.full(-size % width + width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    forward = np.minimum.accumulate(padded, 1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[: size - width + 1], forward[width - 1 : size])


RUNS = "u1 long, u2 long, bucket long, start int, windows int, c1 long, c2 long, loops boolean"


def runs_of(data: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of all rows: row, bucket, start in the row, number of windows, digest of the context, and
    whether the least gram occurs more than once in it (then a run can repeat a window by itself)."""
    if len(data) < LENGTH:
        nothing = np.zeros(0, np.int64)
        return {c: nothing for c in ("row", "bucket", "start", "windows", "c1", "c2", "loops")}
    first, second = Rolling(data), Rolling(data, 1)
    grams = first.every(GRAM)
    least = sliding_least(grams, SPAN)
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= edges[1:][row]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(change)
    sizes = np.diff(np.append(starts, len(least)))
    valid = inside[starts]
    starts, sizes = starts[valid], sizes[valid]
    ends = starts + sizes + LENGTH - 1
    value = least[starts]
    loops = np.zeros(len(starts), bool)
    reach = np.arange(SPAN)
    for a in range(0, len(starts), 4096):
        part = slice(a, a + 4096)
        left = (grams[starts[part, None] + reach] == value[part, None]).argmax(1) + starts[part]
        tail = (starts[part] + sizes[part] - 1)[:, None] + reach[::-1]
        right = tail[:, 0] - (grams[tail] == value[part, None]).argmax(1)
        loops[part] = left != right
    return {
        "row": row[starts], "bucket": value.view(np.int64), "start": starts - edges[row[starts]], "windows": sizes,
        "c1": first.of(starts, ends).view(np.int64), "c2": second.of(starts, ends).view(np.int64), "loops": loops,
    }


def runs(docs: DataFrame) -> DataFrame:
    """Runs of documents (``u1``, ``u2``, ``text``)."""

    def run(batches):
        for batch in steps(batches, "text"):
            found = runs_of(*text_bytes(batch.column("text")))
            take = pa.array(found["row"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("u1").take(take), batch.column("u2").take(take), pa.array(found["bucket"], pa.int64()), pa.array(found["start"], pa.int32()), pa.array(found["windows"], pa.int32()), pa.array(found["c1"], pa.int64()), pa.array(found["c2"], pa.int64()), pa.array(found["loops"].astype(bool))],
                names=["u1", "u2", "bucket", "start", "windows", "c1", "c2", "loops"],
            )

    return docs.select("u1", "u2", "text").mapInArrow(run, RUNS)


# --- sorting a block -----------------------------------------------------------------------


def _ranks(values: np.ndarray) -> np.ndarray:
    """Dense ranks of numbers."""
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position, the first byte lowest."""
    padded = np.concatenate((data, np.zeros(TAIL, np.uint8)))
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def cover_ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions in order, and for each the rank of its first 392 bytes.

    Ranks near the end of the data stand for bytes past it; no window of ``LENGTH`` bytes uses those.
    """
    periods = len(data) // MODULUS + 1
    positions = (np.arange(periods)[:, None] * MODULUS + np.array(COVER)).ravel()
    words = _words(np.concatenate((data, np.zeros(2 * MODULUS, np.uint8))))[positions] & np.uint64((1 << 56) - 1)
    per = len(COVER)

    def later(ranks: np.ndarray, length: int) -> np.ndarray:
        moved = np.zeros_like(ranks)
        shift = length // MODULUS * per
        moved[: max(0, len(ranks) - shift)] = ranks[shift:]
        return moved

    by_length = {MODULUS: _ranks(words)}
    length = MODULUS
    while length < 224:
        ranks = by_length[length]
        by_length[2 * length] = _ranks(ranks << np.uint64(32) | later(ranks, length))
        length *= 2
    joined = _ranks(by_length[224] << np.uint64(32) | later(by_length[112], 224))
    return positions, _ranks(joined << np.uint64(32) | later(by_length[56], 336))


def repeated_windows(data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Which valid window starts have an equal window that starts elsewhere in the data.

    ``valid``: positions at which a window of ``LENGTH`` bytes lies inside its context.
    """
    repeated = np.zeros(len(data), bool)
    positions, ranks = cover_ranks(data)
    tied = np.bincount(ranks.astype(np.int64))[ranks.astype(np.int64)] > 1
    positions, ranks = positions[tied], ranks[tied]
    words = _words(data)
    for offset in range(MODULUS):
        starts = positions - offset
        ok = (starts >= 0) & (starts < len(data))
        ok[ok] = valid[starts[ok]]
        at, rank = starts[ok], ranks[ok]
        # The bytes before the cover position and those behind its 392 bytes: eight in all.
        head = words[at] & np.uint64((1 << 8 * offset) - 1)
        outer = head | words[at + offset + LENGTH - TAIL] << np.uint64(8 * offset)
        order = np.lexsort((outer, rank))
        rank, outer, at = rank[order], outer[order], at[order]
        same = (rank[1:] == rank[:-1]) & (outer[1:] == outer[:-1])
        repeated[at[1:][same]] = True
        repeated[at[:-1][same]] = True
    return repeated


CONTEXTS = "bucket long, hot boolean, u1 long, u2 long, start int, context binary"
INTERVALS = "u1 long, u2 long, start int, end int"


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts.  The list of a document is no longer than its text."""
    lists = wanted.groupBy("u1", "u2").agg(F.collect_list(F.struct("bucket", "hot", "start", "windows")).alias("wanted"))
    joined = docs.join(lists, ["u1", "u2"])

    def run(batches):
        for batch in steps(batches, "text"):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for u1, u2, text, wanted in zip(*(batch.column(c) for c in ("u1", "u2", "text", "wanted")), strict=True):
                data = text.as_py().encode()
                for x in wanted.as_py():
                    values = x["bucket"], x["hot"], u1.as_py(), u2.as_py(), x["start"], data[x["start"] : x["start"] + x["windows"] + LENGTH - 1]
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["bucket", "hot", "u1", "u2", "start", "context"])

    return joined.select("u1", "u2", "text", "wanted").mapInArrow(run, CONTEXTS)


def _intervals(repeated: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context number and byte interval inside it of every run of repeated windows."""
    at = np.flatnonzero(repeated)
    row = np.searchsorted(edges, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    return row[first], at[first] - edges[row[first]], at[last] - edges[row[first]] + LENGTH


def _sorted_blocks(contexts: DataFrame) -> DataFrame:
    """Repeated intervals of the contexts of cold buckets, block by block of whole buckets."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        column = rows.column("context").combine_chunks().cast(pa.large_binary())
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data, edges = np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]], edges - edges[0]
        valid = np.zeros(len(data), bool)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            valid[a : b - LENGTH + 1] = True
        row, start, end = _intervals(repeated_windows(data, valid), edges)
        base = rows.column("start").to_numpy()[row]
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [rows.column("u1").combine_chunks().take(take), rows.column("u2").combine_chunks().take(take), pa.array(base + start, pa.int32()), pa.array(base + end, pa.int32())],
            names=["u1", "u2", "start", "end"],
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in steps([batch], "context"):
                held.append(part)
                size += part.column("context").nbytes
                if size < BLOCK_BYTES:
                    continue
                rows = pa.Table.from_batches(held)
                buckets = rows.column("bucket").to_numpy()
                whole = int(np.searchsorted(buckets, buckets[-1], "left"))  # the last bucket may go on
                if whole:
                    yield block(rows.slice(0, whole))
                held = rows.slice(whole).combine_chunks().to_batches()
                size = 0
        if held:
            yield block(pa.Table.from_batches(held))

    return contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, INTERVALS)


def _counted(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """Repeated windows of the contexts of hot buckets, each an interval; windows are rows of their own."""

    def run(batches):
        for batch in batches:
            for part in steps([batch], "context"):
                for u1, u2, start, context in zip(*(part.column(c) for c in ("u1", "u2", "start", "context")), strict=True):
                    data = np.frombuffer(context.as_py(), np.uint8)
                    keys = [Rolling(data, which).every(LENGTH).view(np.int64) for which in (0, 1)]
                    size = len(keys[0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, u1.as_py(), np.int64)), pa.array(np.full(size, u2.as_py(), np.int64)), pa.array(np.arange(size, dtype=np.int32) + start.as_py()), pa.array(keys[0]), pa.array(keys[1])],
                        names=["u1", "u2", "start", "k1", "k2"],
                    )

    windows = contexts.repartition("u1", "start").mapInArrow(run, "u1 long, u2 long, start int, k1 long, k2 long")
    windows = scratch.put(windows, "windows")
    often = windows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return windows.join(often, ["k1", "k2"]).select("u1", "u2", "start", (F.col("start") + LENGTH).alias("end"))


def _meeting(contexts: DataFrame) -> DataFrame:
    """Contexts whose bucket holds others or a loop; ``hot``: more than ``HOT``.

    A bucket is joined by its parts, since a frequent passage has thousands of contexts in one bucket.
    """
    dealt = contexts.withColumn("part", F.pmod("c1", F.lit(PARTS)).cast("int"))
    parts = dealt.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"), F.bool_or("loop").alias("_loop"))
    different = parts.groupBy("bucket").agg(F.sum("n").alias("different"), F.bool_or("_loop").alias("_loop"), F.collect_list("part").alias("parts"))
    different = different.where("different > 1 OR _loop").select("bucket", "different", F.explode("parts").alias("part"))
    return dealt.join(different, ["bucket", "part"]).select("bucket", (F.col("different") > HOT).alias("hot"), "place.*", "windows")


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Byte intervals of documents (``u1``, ``u2``, ``text``) that repeated strings cover; they may overlap."""
    found = scratch.put(runs(docs), "runs")
    buckets = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bool_or("loops").alias("loop")).where("n > 1 OR loop")
    found = scratch.put(found.drop("loops").join(buckets.select("bucket", "loop"), "bucket"), "candidates")
    place = F.struct("u1", "u2", "start")
    contexts = found.groupBy("bucket", "c1", "c2", "windows").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"), F.first("loop").alias("loop"))
    contexts = scratch.put(contexts, "contexts")
    whole = found.join(contexts.where("n > 1").select("bucket", "c1", "c2", "windows"), ["bucket", "c1", "c2", "windows"])
    whole = whole.select("u1", "u2", "start", (F.col("start") + F.col("windows") + LENGTH - 1).alias("end"))

    bytes_ = scratch.put(_contexts(docs, _meeting(contexts)), "bytes")
    columns = ("u1", "u2", "start", "end")
    return whole.select(*columns).union(_sorted_blocks(bytes_.where("NOT hot")).select(*columns)).union(_counted(bytes_.where("hot"), scratch).select(*columns))


def _merged(intervals: list[dict]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for x in sorted(intervals, key=lambda x: x["start"]):
        if spans and x["start"] <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(spans[-1][1], x["end"])
        else:
            spans.append((x["start"], x["end"]))
    return spans


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``spans`` (array of start and end in bytes) and ``kept`` (bytes) of every row."""
    scratch = Scratch(docs.sparkSession, "repeats")
    named = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = named.select(key, "text", F.xxhash64(key, "text").alias("u1"), F.xxhash64("text", key, F.lit(1)).alias("u2"))
    found = scratch.put(repeats(named.select("u1", "u2", "text"), scratch), "intervals")
    # The intervals of a document are no more than its windows.
    lists = found.groupBy("u1", "u2").agg(F.collect_set(F.struct("start", "end")).alias("intervals"))
    joined = named.join(lists, ["u1", "u2"], "left").select(key, "text", "intervals")
    schema = named.select(key).schema.add("n_bytes", "long")
    schema = schema.add("spans", docs.sparkSession.createDataFrame([], "x array<struct<start:int,end:int>>").schema[0].dataType).add("kept", "binary")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in steps(batches, "text"):
            sizes, spans, kept = [], [], []
            for value, intervals in zip(batch.column("text"), batch.column("intervals"), strict=True):
                data = value.as_py().encode()
                merged = _merged(intervals.as_py() or [])
                edges = [0, *(x for span in merged for x in span), len(data)]
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=[key, "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, schema)
