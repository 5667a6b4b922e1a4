"""Components of similar items from buckets, in rounds that leave no link between components out.

A member meets the smallest member of its buckets first.  Once components are known, only members of
different components still meet, so a bucket that has grown together costs nothing more, however many
members it has.  In a bucket that still holds several components, the members outside its largest component
visit all others, in blocks inside tasks: the cost is the few times all, not all times all.  Every pair is
looked at in the first bucket it shares, against short hashes of the full sets, which never show less than
the true overlap.  Only pairs that pass are confirmed on their sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import Scratch
from gapwise.llm.components import components

#: Members of a bucket that meet in one block.
BLOCK = 256
#: Members of a bucket per key of the join with its smallest member.
SALT = 4096

#: ``prepare(ids in buckets)`` gives a function that keeps the links among pairs ``a``, ``b``, and a table of
#: ``id`` and ``payload``, from which ``hashes_of`` makes 16-bit hashes of all elements of the set.
Prepare = Callable[[DataFrame], tuple[Callable[[DataFrame], DataFrame], DataFrame]]
HashesOf = Callable[[bytes], np.ndarray]
#: Whether two payloads are a link, where they hold the whole sets.
Exact = Callable[[bytes, bytes], bool]


def short_hashes(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.uint16)


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Bucket members with the root of their component so far."""
    return members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _merged(found: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The components once more edges are known: only the roots meet anew."""
    for end in ("a", "b"):
        edges = edges.join(found.select(F.col("node").alias(end), F.col("root").alias("_r")), end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    above = components(edges, scratch)
    up = above.select(F.col("node").alias("root"), F.col("root").alias("_up"))
    old = found.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
    return scratch.put(old.unionByName(above), "components")


def linked(
    items: DataFrame, prepare: Prepare, hashes_of: HashesOf, scratch: Scratch, *, percent: int, exact: Exact | None = None
) -> DataFrame:
    """Component roots (``node``, ``root``) of items (``id``, ``bands``; ids are unique).

    An item that is in no link, or the smallest of its component, has no row.
    With ``exact`` a block decides its pairs itself and joins components as it goes, so that no more links
    come out of it than there are components to join.
    """
    rows = items.select("id", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_members")).where("n_members > 1")
    members = scratch.put(rows.join(buckets, "bucket"), "members")
    ids = scratch.put(members.select("id").distinct(), "ids")
    confirm, payloads = prepare(ids)

    # Round 1: a member and the smallest member of most of its buckets.
    met = members.where("id != least").groupBy("id", "least").agg(F.count(F.lit(1)).alias("n"))
    favourite = met.groupBy("id").agg(F.max(F.struct("n", F.negate("least").alias("l"))).alias("m"))
    tried = scratch.put(favourite.select(F.col("id").alias("a"), F.negate(F.col("m.l")).alias("b")), "tried")
    found = components(scratch.put(confirm(tried), "links"), scratch)

    # Round 2: the smallest members of its other buckets, where they are of another component.  A bucket's
    # row is repeated for every ``SALT`` of its members, so a large bucket is many keys.
    salts = F.ceil(F.col("n_members") / SALT).cast("int")
    heads = _labelled(members.where("id = least"), found).select("bucket", F.col("root").alias("least_root"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    salted = _labelled(members, found).withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
    apart = salted.join(heads, ["bucket", "salt"]).where("root != least_root").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    pairs = scratch.put(apart.join(tried, ["a", "b"], "left_anti"), "apart")
    found = _merged(found, scratch.put(confirm(pairs), "links"), scratch)

    # Last: buckets that still hold several components, block by block.
    labelled = scratch.put(_labelled(members, found).select("bucket", "id", "root"), "labelled")
    sizes = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", "root"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("n_all"), most["n"].alias("n_main"), most["root"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    rest = labelled.join(mixed, "bucket")
    known = items.join(rest.select("id").distinct(), "id", "left_semi").select("id", "bands")
    last = scratch.put(_blocks(rest.join(known.join(payloads, "id"), "id"), hashes_of, exact, percent), "blocks")
    found = _merged(found, last if exact else scratch.put(confirm(last), "links"), scratch)
    scratch.drop(members, ids, tried, pairs, labelled)  # nothing reads them any more
    return found


def _blocks(rest: DataFrame, hashes_of: HashesOf, exact: Exact | None, percent: int) -> DataFrame:
    """Pairs of different components inside the mixed buckets whose hashes could be those of a link.

    All members of a bucket are dealt into blocks, and so are those outside its largest component; every
    block of the latter (``i``) meets every block of all (``j``) in a group of its own, so no task holds a
    whole bucket.  Groups come sorted, many to a task.
    """
    place = F.xxhash64("id")
    few = F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK).cast("int")
    blocks = F.ceil(F.col("n_all") / BLOCK).cast("int")
    own, mine = F.pmod(place, blocks).cast("int"), F.pmod(place, few).cast("int")
    minor = F.col("root") != F.col("main")
    every = F.transform(F.sequence(F.lit(0), few - 1), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("visits")))
    visits = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(True).alias("visits")))
    spread = rest.withColumn("at", F.explode(F.when(minor, F.concat(every, visits)).otherwise(every)))
    spread = spread.select("bucket", "at.i", "at.j", "at.visits", minor.alias("minor"), "id", "root", "bands", "payload")
    schema = spread.select(F.col("id").alias("a"), F.col("id").alias("b")).schema
    group = ["bucket", "i", "j"]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held).combine_chunks()
            edges = _group_edges(rows, group)
            if len(edges) > 2:
                yield _met(rows, edges[:-1], hashes_of, exact, percent)
            held = rows.slice(edges[-2]).to_batches()  # the last group may go on
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield _met(rows, _group_edges(rows, group), hashes_of, exact, percent)

    return spread.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema).distinct()


def _group_edges(rows: pa.Table, group: list[str]) -> list[int]:
    new = np.ones(rows.num_rows, bool)
    columns = [rows.column(c).to_numpy() for c in group]
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return [*np.flatnonzero(new).tolist(), rows.num_rows]


def _met(rows: pa.Table, edges: list[int], hashes_of: HashesOf, exact: Exact | None, percent: int) -> pa.RecordBatch:
    """The pairs that groups of rows (cut at the edges) give."""
    ids, roots, buckets, visits, minor = (rows.column(c).to_numpy() for c in ("id", "root", "bucket", "visits", "minor"))
    flat = rows.column("bands").chunk(0)
    bands = flat.flatten().to_numpy().reshape(len(ids), -1)
    payloads = rows.column("payload").to_pylist()
    # Counting every element whose hash is known never shows less than the overlap, and distinct hashes
    # are never more than the elements; so no link is missed.
    hashes: dict[int, np.ndarray] = {}
    counts, sizes = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    known = np.zeros(1 << 16, bool)

    def hashed(x: int) -> np.ndarray:
        """Hashes of a row that meets any other; most rows of a bucket have met before in another."""
        if x not in hashes:
            hashes[x] = own = hashes_of(payloads[x])
            known[own] = True
            counts[x], sizes[x] = len(own), np.count_nonzero(known)
            known[own] = False
        return hashes[x]

    pairs: list[tuple[int, int]] = []
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := joined.get(x, x)) != x:
            joined[x] = joined.get(above, above)
            x = above
        return x

    for start, stop in zip(edges[:-1], edges[1:], strict=True):
        place = np.arange(start, stop)
        right = place[~visits[start:stop]]
        if not len(right):
            continue
        for x in place[visits[start:stop]].tolist():
            # Two of the few meet once, and a pair is looked at in the first bucket that it shares.
            near = right[(roots[right] != roots[x]) & ~(minor[right] & (ids[right] >= ids[x]))]
            if len(near):
                near = near[bands[x][(bands[near] == bands[x]).argmax(1)] == buckets[start]]
            if not len(near):
                continue
            together = np.concatenate([hashed(y) for y in near.tolist()])
            own, ends = hashed(x), np.cumsum(counts[near])
            known[own] = True
            hit = np.concatenate(([0], np.cumsum(known[together])))
            known[own] = False
            shared = np.minimum(np.minimum(hit[ends] - hit[ends - counts[near]], counts[x]), counts[near])
            for y in near[100 * shared >= percent * (sizes[x] + sizes[near] - shared)].tolist():
                if exact:
                    if root(int(roots[x])) == root(int(roots[y])) or not exact(payloads[x], payloads[y]):
                        continue
                    joined[root(int(roots[x]))] = root(int(roots[y]))
                pairs.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
        hashes.clear()
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
