"""WARC archives with revisit records, read back into a globally ordered capture index.

Writing: one record per row, as text, so that Spark's own writer reaches any store.  Of rows with equal
payloads of ``LEAST_REVISIT`` bytes or more, those with the smallest id are responses and the others
revisit it; shorter payloads are all responses.  Only ids and digests are grouped, never payloads.

Reading: files are parsed record by record by their declared length, so a payload may hold any text.

Index: every archive gives one run of captures sorted by (URL key, time, id).  Runs meet in ranges of
that key, and each range merges its runs with a loser tree.  The ranges cut inside a URL key too, so a
very common URL is no hot key, and ranges follow each other: the whole is in order.  There are as many
ranges as keep each of them near ``RANGE_ROWS`` captures and ``RANGE_BYTES`` of URLs, which is what a task holds.

A null payload counts as empty, a null id is the smallest of no group (it revisits, if its payload
repeats under an id), a null URL has the key "".  Rows that repeat an id and its payload are all of the
same type.  Line ends inside a URL are written percent-encoded.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm.common import Scratch

LEAST_REVISIT = 100
#: Payloads below so many bytes, and how many of their records one archive file holds: what a reading task
#: holds at once is about 64 MB, or one larger payload.
FILE_CLASSES = ((32 << 10, 2_000), (1 << 20, 64), (None, 1))
RANGE_ROWS = 50_000
RANGE_BYTES = 32 << 20
#: Smaller ranges as long as there are no more of them than shuffle partitions.
LEAST_RANGE_ROWS = 4_096
EPOCH = 1_704_067_200
END = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then path and query: pages of a site sort together."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_extract(rest, "^[^/?]*", 0)
    path = F.substr(rest, F.length(host) + 1)
    return F.when(url.isNull(), "").otherwise(F.concat(F.array_join(F.reverse(F.split(F.lower(host), "\\.")), ","), F.lit(")"), path))


def with_record_types(pages: DataFrame, *, key: str, payload: str) -> DataFrame:
    """``payload``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` beside the columns."""
    rows = pages.withColumn("_payload", F.coalesce(F.col(payload), F.lit("")))
    rows = rows.withColumns({"payload_bytes": F.octet_length("_payload").cast("long"), "payload_digest": F.sha2("_payload", 256)})
    long = F.col("payload_bytes") >= LEAST_REVISIT
    first = rows.where(long).groupBy("payload_digest").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    rows = rows.join(first.where("_n > 1").drop("_n"), "payload_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("_first"))
    return rows.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_first"))})


def _record(key: str, url: str, captured: Column) -> Column:
    """Header and block of a record; the writer puts the record end after it."""
    revisit = F.col("record_type") == "revisit"

    def header(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")

    def urn(value: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), value.cast("string"), F.lit(">"))

    safe = F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    size = F.lit(len(HTTP_HEAD)) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", urn(F.col(key))),
        header("WARC-Date", F.date_format(F.timestamp_seconds(captured), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        header("WARC-Target-URI", safe),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        header("WARC-Refers-To", urn(F.col("refers_to"))),
        header("WARC-Profile", F.when(revisit, PROFILE)),
        header("X-Payload-Length", F.col("payload_bytes")),
        header("X-Captured-At", captured),
        header("X-Url-Key", F.replace(F.replace(url_key(F.col(url)), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", size),
        F.lit("\r\n" + HTTP_HEAD),
        F.when(revisit, "").otherwise(F.col("_payload")),
    )


def write_archives(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html", captured: Column | None = None) -> None:
    """Write the table as compressed WARC files, in a folder for each of ``FILE_CLASSES`` that occurs.

    Equal payloads are of one class.  ``captured``: seconds since 1970; by default ``EPOCH`` plus the id.
    """
    captured = F.lit(EPOCH) + F.coalesce(F.col(key), F.lit(0)) if captured is None else captured
    pages, size = pages.select(key, url, payload), F.coalesce(F.octet_length(payload), F.lit(0))
    kind = F.lit(len(FILE_CLASSES) - 1)
    for number in range(len(FILE_CLASSES) - 2, -1, -1):
        kind = F.when(size < FILE_CLASSES[number][0], number).otherwise(kind)
    present = {r.kind for r in pages.select(kind.alias("kind")).distinct().collect()}
    for number in sorted(present | {0}):  # an empty table has an empty folder
        rows = with_record_types(pages.where(kind == number), key=key, payload=payload)
        writer = rows.select(_record(key, url, captured.cast("long")).alias("value")).write
        writer.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_CLASSES[number][1]).text(f"{path}/{number}")


READ_SCHEMA = (
    "page_id long, url string, url_key string, captured_at long, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, intact boolean, archive string, offset long, length long, run long, seq int"
)


def _records(data: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes], bytes]]:
    """Offset, length, header fields and block of every record of an archive."""
    at, end = 0, END.encode()
    while at < len(data):
        stop = data.index(end, at)
        fields = dict(line.split(b": ", 1) for line in data[at:stop].split(b"\r\n")[1:])
        start = stop + len(end)
        after = start + int(fields[b"Content-Length"])
        yield at, after - at, fields, data[start:after]
        at = after + len(end)


def _parsed(archive: str, data: bytes) -> list[dict]:
    def text(fields, name):
        value = fields.get(name)
        return None if value is None else value.decode()

    def number(urn):
        return None if urn is None else int(urn.removeprefix(b"<urn:page:").removesuffix(b">"))

    rows = []
    for offset, length, fields, block in _records(data):
        response, declared = fields[b"WARC-Type"] == b"response", text(fields, b"WARC-Payload-Digest").removeprefix("sha256:")
        payload = block.split(END.encode(), 1)[1]
        digest = hashlib.sha256(payload).hexdigest() if response else declared
        rows.append(
            {
                "page_id": number(fields.get(b"WARC-Record-ID")), "url": text(fields, b"WARC-Target-URI"), "url_key": text(fields, b"X-Url-Key") or "",
                "captured_at": int(fields[b"X-Captured-At"]), "record_type": text(fields, b"WARC-Type"), "refers_to": number(fields.get(b"WARC-Refers-To")),
                "payload_bytes": len(payload) if response else int(fields[b"X-Payload-Length"]), "payload_digest": digest,
                "intact": digest == declared, "archive": archive, "offset": offset, "length": length,
            }
        )
    return rows


def _order(row: dict) -> tuple:
    """URL key, time, id (a null one first), then place: a total order of captures."""
    return row["url_key"], row["captured_at"], row["page_id"] is not None, row["page_id"] or 0, row["archive"], row["offset"]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, and per archive one sorted run (``run``, ``seq``).

    ``intact`` tells whether a response's payload has its declared digest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    schema = files.sparkSession.createDataFrame([], READ_SCHEMA).schema

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                archive = name.as_py()
                rows = sorted(_parsed(archive, gzip.decompress(content.as_py())), key=_order)
                number = int.from_bytes(hashlib.sha256(archive.encode()).digest()[:8], "big", signed=True)
                for i, row in enumerate(rows):
                    row |= {"run": number, "seq": i}
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_arrow(schema))

    return files.mapInArrow(run, schema)


def _arrow(schema) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


class LoserTree:
    """k-way merge of sorted iterators: each inner node keeps the loser of its match."""

    def __init__(self, runs: list[Iterator[dict]], key=_order):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [next(run, None) for run in runs]
        self.keys = [None if head is None else key(head) for head in self.heads]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, opening=True)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a comes before run b; an ended run comes last."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None or (self.keys[b] is None and a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, leaf: int, *, opening: bool = False) -> None:
        """Carry a run from its leaf to the top; at the opening it waits at the first free node."""
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.losers[node]
            if opening and other < 0:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[dict]:
        while self.k and self.keys[top := self.losers[0]] is not None:
            yield self.heads[top]
            self.heads[top] = head = next(self.runs[top], None)
            self.keys[top] = None if head is None else self.key(head)
            self._play(top)


def capture_index(records: DataFrame, scratch: Scratch) -> DataFrame:
    """The records with ``capture_rank``, their place from 1 in the order of all captures."""
    names = records.columns
    schema = records.select(*names, F.lit(0).alias("part"), F.lit(0).cast("long").alias("row")).schema
    arrow = _arrow(schema)

    def merge(batches):
        runs: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                runs.setdefault(row["run"], []).append(row)
        part, out, count = TaskContext.get().partitionId(), [], 0
        for row in LoserTree([iter(run) for run in runs.values()]):
            out.append(row | {"part": part, "row": count})
            count += 1
            if len(out) == 5_000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    records = scratch.put(records, "records")
    count, size = records.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.concat_ws("", "url", "url_key")))).first()
    few = min(-(-count // LEAST_RANGE_ROWS), int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, few, -(-count // RANGE_ROWS), -(-(size or 0) // RANGE_BYTES))
    ranges = records.repartitionByRange(parts, "url_key", "captured_at", "page_id", "archive", "offset").sortWithinPartitions("run", "seq")
    merged = scratch.put(ranges.mapInArrow(merge, schema), "merged")
    # One row per range, however many captures there are.
    sizes = sorted((r["part"], r["n"]) for r in merged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 1, []
    for part, size in sizes:
        starts.append((part, before))
        before += size
    starts = merged.sparkSession.createDataFrame(starts, "part int, _before long")
    ranked = merged.join(F.broadcast(starts), "part", "left")
    return ranked.select(*(c for c in names if c not in ("run", "seq")), (F.col("_before") + F.col("row")).alias("capture_rank"))
