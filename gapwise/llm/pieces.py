"""SentencePiece (BPE) encoding that keeps source offsets, and decoding.

Normalisation walks the text by the longest prefix that the model's compiled
character map knows, and notes for every normalised byte the source byte that it
came from.  Every piece is then projected on the byte span of the original text.
The merges run on chunks between word marks: no piece has a mark behind another
character, so a merge never crosses the start of a chunk (checked when the model
is loaded; otherwise the whole text is one chunk).

A null text counts as empty and has no pieces.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gapwise.llm.common import steps

MARK = "▁"
# Fixed values of the model format: piece types, and the text of an unknown piece.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_SURFACE = " ⁇ "
BPE = 2
#: Chunks kept with their ids in a worker; at the bound it starts anew.
CACHE = 200_000
#: Longer chunks merge by a heap and are not kept; shorter ones merge many at a time.
SHORT = 40
NEVER = np.int32(2**31 - 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The compiled map: a double-array trie over bytes, and the replacement texts."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix at a byte, and its replacement."""
        if not self.units:
            return None

        def below(unit: int) -> int:
            return (unit >> 10) << ((unit & (1 << 9)) >> 6)

        node, found = below(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= below(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


@dataclass
class Model:
    """A BPE model; ``Model.load(bytes of the model file)``."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    character_map: CharacterMap = field(default_factory=lambda: CharacterMap(b""))
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    byte_fallback: bool = False
    kind: int = BPE

    @classmethod
    def load(cls, data: bytes) -> Model:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                parts = dict(_fields(value))
                model.pieces.append(parts.get(1, b"").decode())
                model.scores.append(struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0)
                model.types.append(parts.get(3, NORMAL))
            elif number == 2:
                parts = dict(_fields(value))
                model.kind, model.byte_fallback = parts.get(3, 1), bool(parts.get(35, 0))
                if parts.get(24):
                    raise ValueError("a model with word marks behind words is not supported")
            elif number == 3:
                parts = dict(_fields(value))
                model.character_map = CharacterMap(parts.get(2, b""))
                model.dummy_prefix, model.squeeze = bool(parts.get(3, 1)), bool(parts.get(4, 1))
                model.escape = bool(parts.get(5, 1))
        if model.kind != BPE or USER_DEFINED in model.types or UNUSED in model.types:
            raise ValueError("only BPE models of normal, control and byte pieces are supported")
        model._prepare()
        return model

    def _prepare(self) -> None:
        merged = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.known = merged
        self.unknown = self.types.index(UNKNOWN)
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in merged.values()}, reverse=True))}
        self.rank = {p: order[self.scores[i]] for p, i in merged.items()}
        inner = any(MARK in p.lstrip(MARK) for p in merged)
        self.chunks = re.compile(".+" if inner else f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self.cache: dict[str, bytes] = {}
        self.plain = not self.character_map.units and not self.squeeze and self.escape and self.dummy_prefix
        surfaces = []
        for piece, kind in zip(self.pieces, self.types, strict=True):
            if kind == BYTE:
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif kind == NORMAL:
                surfaces.append(piece.replace(MARK, " ").encode())
            else:
                surfaces.append(UNKNOWN_SURFACE.encode() if kind == UNKNOWN else b"")
        self.surfaces = surfaces
        self._prepare_pairs()
        self.surface_size = np.array([len(s) for s in surfaces], np.int64)
        self.is_byte = np.array([k == BYTE for k in self.types])
        self.opens = np.array([k != BYTE or s[0] & 0xC0 != 0x80 for k, s in zip(self.types, surfaces, strict=True)])
        self.normal_size = np.array([len(p.encode()) if k == NORMAL else 1 for p, k in zip(self.pieces, self.types, strict=True)], np.int64)

    # --- normalisation ----------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its bytes (one more for the end)."""
        data = text.encode("utf-8", "replace")
        out, origin = bytearray(), []
        mark = MARK.encode() if self.escape else b" "

        def add(value: bytes, at: int) -> None:
            out.extend(value)
            origin.extend([at] * len(value))

        def unit(at: int) -> tuple[int, bytes]:
            found = self.character_map.longest(data, at)
            if found:
                return found
            size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            return size, data[at : at + size]

        at = 0
        if self.squeeze:
            while at < len(data) and unit(at)[1] == b" ":
                at += unit(at)[0]
        if at == len(data):
            return "", np.zeros(1, np.int64)
        if self.dummy_prefix:
            add(mark, at)
        after_space = self.squeeze
        while at < len(data):
            size, value = unit(at)
            if self.squeeze and after_space:
                value = value.lstrip(b" ")
            if value:
                for byte in value:
                    add(mark if byte == 32 else bytes([byte]), at)
                after_space = value.endswith(b" ")
            at += size
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(mark):
                at = origin[len(out) - len(mark)]
                del out[-len(mark) :], origin[-len(mark) :]
        return out.decode(), np.array([*origin, at], np.int64)

    # --- merges -----------------------------------------------------------------------

    def _merge_one(self, chunk: str) -> list[str]:
        """Always the best-scored neighbouring pair, the leftmost of equals."""
        rank, parts = self.rank, list(chunk)
        size = len(parts)
        before, after = list(range(-1, size - 1)), [*range(1, size), -1]
        heap: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (r := rank.get(pair := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, pair))

        for i in range(size):
            offer(i)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j < 0 or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j], after[i] = pair, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def _packed(self, part: str) -> bytes:
        if part in self.known:
            ids = [self.known[part]]
        elif self.byte_fallback:
            ids = [self.bytes_at[b] for b in part.encode("utf-8", "replace")]
        else:
            ids = [self.unknown]
        return np.array(ids, np.int32).tobytes()

    def _prepare_pairs(self) -> None:
        """Symbols (pieces and their characters) as numbers, and a hashed table of joinable pairs."""
        symbols = {c: i for i, c in enumerate(sorted({*self.known, *"".join(self.known)}))}
        self.packed = [self._packed(s) for s in symbols]
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = i
        pairs = {}
        for piece, rank in self.rank.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank, symbols[piece]
        bits = max(10, len(pairs).bit_length() + 2)
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.pair_keys = np.full(size, -1, np.int64)
        self.pair_rank, self.pair_symbol = np.full(size, NEVER, np.int32), np.zeros(size, np.int32)
        keys = np.array(list(pairs), np.int64)
        for key, slot, (rank, symbol) in zip(pairs, self._slots(keys).tolist(), pairs.values(), strict=True):
            while self.pair_keys[slot] != -1:
                slot = (slot + 1) % size
            self.pair_keys[slot], self.pair_rank[slot], self.pair_symbol[slot] = key, rank, symbol

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined symbol of pairs; ``NEVER`` where they do not join."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slots(keys)
        held = self.pair_keys[slots]
        probing = np.flatnonzero((held != keys) & (held != -1))
        while len(probing):
            slots[probing] = (slots[probing] + 1) % len(self.pair_keys)
            held = self.pair_keys[slots[probing]]
            probing = probing[(held != keys[probing]) & (held != -1)]
        hit = self.pair_keys[slots] == keys
        return np.where(hit, self.pair_rank[slots], NEVER), self.pair_symbol[slots]

    def _merge_many(self, chunks: list[str]) -> None:
        """Ids of short chunks of one length, into the cache: every step joins one pair of each row."""
        rows, size = len(chunks), len(chunks[0])
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(rows, size)
        symbols = self.symbol_of[points]
        symbols = np.where(symbols < 0, -1 - points.astype(np.int64), symbols)
        ranks, joined = self._look_up(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
        ranks, joined = ranks.reshape(rows, -1), joined.reshape(rows, -1)
        names = np.arange(rows)
        while len(names):
            width = symbols.shape[1]
            best = ranks.argmin(1) if width > 1 else np.zeros(len(names), np.int64)
            at = np.arange(len(names))
            more = ranks[at, best] != NEVER if width > 1 else np.zeros(len(names), bool)
            for name, row in zip(names[~more].tolist(), symbols[~more].tolist(), strict=True):
                self.cache[chunks[name]] = b"".join([self.packed[s] if s >= 0 else self._packed(chr(-1 - s)) for s in row])
            names, symbols, ranks, joined, best = names[more], symbols[more], ranks[more], joined[more], best[more]
            if not len(names):
                break
            at = np.arange(len(names))
            symbols[at, best] = joined[at, best]
            stay = np.ones(symbols.shape, bool)
            stay[at, best + 1] = False
            symbols = symbols[stay].reshape(len(names), -1)
            stay = np.ones(ranks.shape, bool)
            stay[at, best] = False
            ranks, joined = ranks[stay].reshape(len(names), -1), joined[stay].reshape(len(names), -1)
            for left in (best - 1, best):
                inside = np.flatnonzero((left >= 0) & (left < symbols.shape[1] - 1))
                if len(inside):
                    i, j = inside, left[inside]
                    ranks[i, j], joined[i, j] = self._look_up(symbols[i, j], symbols[i, j + 1])

    def learn(self, chunks: list[str]) -> None:
        """Put the ids of the short chunks that are not known yet into the cache."""
        unseen = {c for c in chunks if c not in self.cache}
        if len(self.cache) + len(unseen) > CACHE:
            self.cache.clear()
            unseen = set(chunks)
        by_size: dict[int, list[str]] = {}
        for chunk in unseen:
            if len(chunk) <= SHORT:
                by_size.setdefault(len(chunk), []).append(chunk)
        for same in by_size.values():
            self._merge_many(same)

    def encode_normalised(self, text: str) -> np.ndarray:
        chunks = self.chunks.findall(text)
        found = list(map(self.cache.get, chunks))
        if None in found:
            self.learn(chunks)
            get = self.cache.get
            found = [get(c) or b"".join(map(self._packed, self._merge_one(c))) for c in chunks]
        return np.frombuffer(b"".join(found), np.int32)

    def prepare(self, texts: list[str | None]) -> None:
        """Learn the chunks of many texts at once, which ``encode`` then only looks up."""
        if self.plain:
            self.learn(self.chunks.findall(MARK + f"{MARK}".join(t.replace(" ", MARK) for t in texts if t)))

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the byte span of the source of each; a byte piece that is not the last of
        its character has an empty span at the character's start."""
        if not text:
            nothing = np.zeros(0, np.int32)
            return nothing, nothing, nothing
        if self.plain and MARK not in text:
            ids = self.encode_normalised(MARK + text.replace(" ", MARK))
            ends = np.cumsum(self.surface_size[ids]) - 1
            starts = np.concatenate(([0], ends[:-1]))
        else:
            normalised, origin = self.normalise(text)
            ids = self.encode_normalised(normalised)
            if self.unknown in ids:
                sizes = self._sizes_with_unknown(ids, normalised)
            else:
                sizes = self.normal_size[ids]
            edges = np.concatenate(([0], np.cumsum(sizes)))
            starts, ends = origin[edges[:-1]], origin[edges[1:]]
        is_byte = self.is_byte[ids]
        if is_byte.any():
            first = np.maximum.accumulate(np.where(self.opens[ids], np.arange(len(ids)), 0))
            starts = np.where(is_byte, starts[first], starts)
            inner = np.append(~self.opens[ids[1:]], False) & is_byte
            ends = np.where(inner, starts, ends)
        return ids, starts.astype(np.int32), ends.astype(np.int32)

    def _sizes_with_unknown(self, ids: np.ndarray, text: str) -> np.ndarray:
        """Normalised bytes of each piece where unknown characters stand for themselves."""
        sizes, at = [], 0
        for i in ids.tolist():
            piece = text[at] if i == self.unknown else self.pieces[i]
            at += len(piece)
            sizes.append(len(piece.encode()))
        return np.array(sizes, np.int64)

    # --- decoding ---------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a byte that no character can hold becomes U+FFFD."""
        surfaces = self.surfaces
        data = b"".join([surfaces[i] for i in ids])
        first = next((i for i in ids if surfaces[i]), None)
        if first is not None and self.types[first] == NORMAL and (self.dummy_prefix or self.squeeze):
            data = data.lstrip(b" ") if self.squeeze else data[1:] if data[:1] == b" " else data
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _decode_bytewise(data)


def _decode_bytewise(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out.append("�")
        at += size
    return "".join(out)


_MODELS: dict[int, Model] = {}


def _model(shared) -> Model:
    """The loaded model of a worker, with the chunks it has seen."""
    key = shared.id if hasattr(shared, "id") else hash(shared.value)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model.load(shared.value)
    return _MODELS[key]


def encode(
    docs: DataFrame, model: bytes, *, text: str = "text", keep: list[str] | None = None, decoded: str | None = None
) -> DataFrame:
    """Columns ``keep`` (default: all but the text) with ``ids``, ``begins`` and ``ends`` per document.

    Spans are bytes of the UTF-8 text.  One row per row, whatever the text; no shuffle.  Columns of the
    table that are called ids, begins or ends are left out.  ``decoded`` names a further column with the
    text that the ids stand for, worked out by the same task, so that the ids need not travel twice.
    """
    added = ("ids", "begins", "ends")
    extra = [decoded] if decoded else []
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, *added, *extra)]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField(c, T.ArrayType(T.IntegerType(), False)) for c in added]
        + [T.StructField(c, T.StringType()) for c in extra]
    )

    def run(batches):
        loaded = _model(shared)
        for batch in steps(batches, text):
            texts = batch.column(text).to_pylist()
            loaded.prepare(texts)
            found = [loaded.encode(t) for t in texts]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))), pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[i] for f in found]), pa.int32())) for i in range(3)]
            if decoded:
                arrays.append(pa.array([loaded.decode(f[0].tolist()) for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], names=[*keep, *added, *extra])

    return docs.select(*keep, text).mapInArrow(run, schema)


def decode(coded: DataFrame, model: bytes, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and the text ``out`` that the ids stand for; null ids give a null text."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    names = [c for c in coded.columns if c != out]
    schema = T.StructType([*(coded.schema[c] for c in names), T.StructField(out, T.StringType())])

    def run(batches):
        loaded = _model(shared)
        for batch in steps(batches, ids):
            texts = [None if x is None else loaded.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, out])

    return coded.select(*names).mapInArrow(run, schema)
