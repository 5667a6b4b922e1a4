"""Secret scan by a trigram inverted index.

Each rule is a regular expression.  From its syntax tree follows a Boolean query
over trigrams (case folded) that every match must satisfy.  Documents are indexed
shard by shard inside the tasks that hold them, so no text is shuffled: a shard
has a postings bitmap for every trigram that some rule asks for.  The postings
are combined by the query, and only the remaining candidates are verified with
the expression itself.  A rule without a mandatory trigram scans its whole shard.

A null text counts as empty and has no spans.
"""

from __future__ import annotations

import re
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gapwise.llm.common import steps

#: Alternatives of literal text that one part of a query may hold; beyond, the part asks for nothing.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = re.ASCII

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for found in re.compile(self.pattern, self.flags).finditer(text):
            first, last = found.span(self.group)
            if last - first >= self.least:
                yield found.span()


# The base rules, in the order in which spans of one start are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further kinds, whose spans are added to those of the base.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES

# --- from an expression to a query over trigrams ------------------------------------------

#: A query is True (every document), a trigram, or ("and" | "or", its parts).
Query = bool | bytes | tuple


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: frozenset[str]) -> Query:
    """What a text that holds one of the strings must hold."""

    def one(string: str) -> Query:
        data = string.encode("utf-8", "replace")
        return _all([data[i : i + 3] for i in range(len(data) - 2)])

    return _any([one(s) for s in sorted(strings)])


def _fold(character: int) -> str:
    return chr(character).lower() if character < 128 else chr(character)


def _strings(node) -> frozenset[str] | None:
    """All texts that a node can match, if they are few."""
    op, value = node
    name = str(op)
    if name == "LITERAL":
        return frozenset((_fold(value),))
    if name == "IN":
        found = set()
        for kind, item in value:
            if str(kind) == "LITERAL":
                found.add(_fold(item))
            elif str(kind) == "RANGE" and item[1] - item[0] < MOST_STRINGS:
                found |= {_fold(c) for c in range(item[0], item[1] + 1)}
            else:
                return None
        return frozenset(found) if len(found) <= 8 else None
    if name == "SUBPATTERN":
        return _sequence_strings(value[3])
    if name == "BRANCH":
        branches = [_sequence_strings(branch) for branch in value[1]]
        return None if None in branches else frozenset().union(*branches)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] == 0 and value[1] == 1:
        inner = _sequence_strings(value[2])
        return None if inner is None else inner | {""}
    return frozenset(("",)) if name == "AT" else None


def _product(left: frozenset[str], right: frozenset[str]) -> frozenset[str] | None:
    return frozenset(a + b for a in left for b in right) if len(left) * len(right) <= MOST_STRINGS else None


def _sequence_strings(nodes) -> frozenset[str] | None:
    whole = frozenset(("",))
    for node in nodes:
        own = _strings(node)
        whole = None if own is None else _product(whole, own)
        if whole is None:
            return None
    return whole


def _sequence_query(nodes) -> Query:
    parts: list[Query] = []
    run = frozenset(("",))
    for node in nodes:
        own = _strings(node)
        longer = None if own is None else _product(run, own)
        if longer is not None:
            run = longer
            continue
        parts.append(_of_strings(run))
        run = frozenset(("",)) if own is None else own
        op, value = node
        if str(op) == "SUBPATTERN":
            parts.append(_sequence_query(value[3]))
        elif str(op) == "BRANCH":
            parts.append(_any([_sequence_query(branch) for branch in value[1]]))
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
            parts.append(_sequence_query(value[2]))
    parts.append(_of_strings(run))
    return _all(parts)


def trigram_query(rule: Rule) -> Query:
    """The trigrams (case folded) that a text with a match of the rule must hold."""
    return _sequence_query(parser.parse(rule.pattern, rule.flags))


def _trigrams(query: Query) -> set[bytes]:
    if isinstance(query, bool):
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*(_trigrams(part) for part in query[1:]))


# --- the index of a shard ---------------------------------------------------------------


class ShardIndex:
    """Postings bitmaps over the texts of a shard, for the trigrams that rules ask for."""

    _fold_byte = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

    def __init__(self, trigrams: list[bytes]):
        self.slots = {t: i for i, t in enumerate(trigrams)}
        self.slot_of = np.zeros(1 << 24, np.uint8 if len(trigrams) < 255 else np.uint16)
        for trigram, slot in self.slots.items():
            self.slot_of[int.from_bytes(trigram, "big")] = slot + 1

    def index(self, data: np.ndarray, edges: np.ndarray) -> None:
        """Text i is the bytes ``edges[i]`` to ``edges[i + 1]``."""
        size = len(edges) - 1
        self.postings = np.zeros((len(self.slots), size), bool)
        self.everything = np.ones(size, bool)
        if len(data) < 3 or not self.slots:
            return
        codes = self._fold_byte[data].astype(np.uint32)
        codes = codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]
        slots = self.slot_of[codes]
        at = np.flatnonzero(slots)
        text = np.searchsorted(edges, at, "right") - 1
        inside = at + 3 <= edges[text + 1]
        self.postings[slots[at[inside]].astype(np.int64) - 1, text[inside]] = True

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return self.everything
        if isinstance(query, bytes):
            return self.postings[self.slots[query]]
        join = np.logical_and if query[0] == "and" else np.logical_or
        return join.reduce([self.candidates(part) for part in query[1:]])


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text", out: str = "spans") -> DataFrame:
    """All columns but the text, and an array of (kind, start, end) in code points, by start and then
    by the order of the rules.  One row per row; a column called like ``out`` is replaced."""
    asked = [trigram_query(rule) for rule in rules]
    trigrams = sorted(set().union(*map(_trigrams, asked)))
    keep = [c for c in docs.columns if c not in (text, out)]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.ArrayType(SPAN))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        shard = ShardIndex(trigrams)
        for batch in steps(batches, text):
            texts = batch.column(text).cast(pa.large_string()).fill_null("")
            edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
            shard.index(data, edges - edges[0])
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
            known: dict[int, str] = {}
            for number, (rule, query) in enumerate(zip(rules, asked, strict=True)):
                for i in np.flatnonzero(shard.candidates(query)).tolist():
                    if i not in known:
                        known[i] = texts[i].as_py()
                    found[i].extend((start, number, end) for start, end in rule.spans(known[i]))
            spans = [[{"kind": rules[n].kind, "start": s, "end": e} for s, n, e in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(spans, arrow)], names=[*keep, out])

    return docs.select(*keep, text).mapInArrow(run, schema)
