"""Skew-safe ordered computation over keyed tables.

Every ordered operator of the library is written against four primitives:

``scan``          neighbours, carried values and running totals along an order
``fold``          a sequential state machine along an order
``asof``          the newest right row at or before each left row
``overlap_join``  pairs of intersecting intervals

An :class:`Axis` names the key and the order.  As long as the largest key holds
no more rows than a checked bound, a key is one window partition: one shuffle
and one sort serve all windows of an operator.  Beyond the bound the key is cut
into chunks along the order, chunks are processed in parallel, and only one
summary row per chunk travels along the key.  Both ways give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP_ROWS_CONF = "spark.gapwise.maxGroupRows"
BROADCAST_ROWS_CONF = "spark.gapwise.maxBroadcastRows"
DEFAULT_GROUP_ROWS = 2_000_000
DEFAULT_BROADCAST_ROWS = 200_000


def group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_CONF, str(DEFAULT_GROUP_ROWS)))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names; beside the warehouse where it names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS)))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast only a table whose row count was checked; else leave the choice to Spark."""
    bound = broadcast_rows(df.sparkSession)
    counted = df.limit(bound + 1).count()
    return F.broadcast(df) if counted <= bound else df


@dataclass(frozen=True)
class Axis:
    """Key columns, order columns (a total order inside a key) and the chunk width.

    ``width`` is in units of the first order column; ``None`` means that every
    key was checked to fit one task.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: float | None = None

    @property
    def chunked(self) -> bool:
        return self.width is not None

    def chunk(self) -> Column:
        return F.floor(F.col(self.order[0]) / F.lit(self.width)).cast("long")

    def window(self, *extra: str, descending: bool = False):
        order = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys, *extra).orderBy(*order)

    def within(self, *keys: str) -> Axis:
        """The same order inside a finer key."""
        return replace(self, keys=(*self.keys, *keys))

    def then(self, *order: str) -> Axis:
        """The same axis with further order columns as tie breakers."""
        return replace(self, order=(*self.order, *order))


def _largest(df: DataFrame, *by) -> int:
    row = df.groupBy(*by).count().agg(F.max("count").alias("n")).first()
    return row.n or 0


def exceeds_task(df: DataFrame, keys: tuple[str, ...]) -> bool:
    """Whether some key has more rows than one task may hold."""
    return _largest(df, *keys) > group_rows(df.sparkSession)


def plan_axis(
    df: DataFrame,
    keys: tuple[str, ...],
    order: tuple[str, ...],
    *,
    unique_step: bool = False,
) -> Axis:
    """Choose whole keys or chunks from a checked row count.

    With ``unique_step`` the first order column is a counter that occurs once per
    key, so a chunk of ``bound`` counter values holds at most ``bound`` rows.
    Otherwise the width shrinks until the fullest chunk fits, or until a chunk holds
    hardly more than one value of the first order column, which is never cut.
    """
    bound = group_rows(df.sparkSession)
    largest = _largest(df, *keys)
    axis = Axis(tuple(keys), tuple(order))
    if largest <= bound:
        return axis
    if unique_step:
        return replace(axis, width=float(bound))
    low, high = df.agg(F.min(order[0]), F.max(order[0])).first()
    width = max(float(high) - float(low), 1e-9) * bound / largest
    ties = _largest(df, *keys, order[0])
    for _ in range(40):
        trial = replace(axis, width=width)
        fullest = _largest(df.select(*keys, trial.chunk().alias("_c")), *keys, "_c")
        if fullest <= max(bound, ties):
            return trial
        width /= max(2.0, fullest / bound)
    return trial


# --- scan -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Lag:
    """The value of the row just before."""

    expr: Column


@dataclass(frozen=True)
class Lead:
    """The value of the row just after."""

    expr: Column


@dataclass(frozen=True)
class Last:
    """The newest non-null value up to this row; without ``here``, before it."""

    expr: Column
    here: bool = True


@dataclass(frozen=True)
class Next:
    """The nearest non-null value from this row on; without ``here``, after it."""

    expr: Column
    here: bool = True


@dataclass(frozen=True)
class Sum:
    """The running sum up to and including this row."""

    expr: Column


@dataclass(frozen=True)
class Least:
    """The running minimum up to and including this row."""

    expr: Column


@dataclass(frozen=True)
class Tail:
    """The newest ``size`` values up to and including this row, oldest first."""

    expr: Column
    size: int


Scan = Lag | Lead | Last | Next | Sum | Least | Tail


def row_number() -> Sum:
    return Sum(F.lit(1).cast("long"))


def _windowed(op: Scan, axis: Axis, *extra: str) -> Column:
    every = Window.unboundedPreceding
    if isinstance(op, Next):
        # A frame that grows backwards costs one more sort but stays linear;
        # "current row to unbounded following" would be quadratic.
        frame = axis.window(*extra, descending=True).rowsBetween(every, 0 if op.here else -1)
        return F.last(op.expr, ignorenulls=True).over(frame)
    forward = axis.window(*extra)
    match op:
        case Lag():
            return F.lag(op.expr).over(forward)
        case Lead():
            return F.lead(op.expr).over(forward)
        case Last():
            frame = forward.rowsBetween(every, 0 if op.here else -1)
            return F.last(op.expr, ignorenulls=True).over(frame)
        case Sum():
            return F.sum(op.expr).over(forward.rowsBetween(every, 0))
        case Least():
            return F.min(op.expr).over(forward.rowsBetween(every, 0))
        case Tail():
            return F.collect_list(op.expr).over(forward.rowsBetween(1 - op.size, 0))
    raise TypeError(op)


def scan(df: DataFrame, axis: Axis, **ops: Scan) -> DataFrame:
    """Add one column per operation, computed along the axis."""
    if not axis.chunked:
        return df.withColumns({n: _windowed(op, axis) for n, op in ops.items()})
    return _chunked_scan(df, axis, ops)


def _chunked_scan(df: DataFrame, axis: Axis, ops: dict[str, Scan]) -> DataFrame:
    by = (*axis.keys, "_c")
    names = df.columns
    # One shuffle puts a chunk on one task; the local windows, the summaries and the
    # carry join below all reuse that placement.
    cut = materialize(df.withColumn("_c", axis.chunk()).repartition(*by))
    place = F.struct(*axis.order)
    local, summary, carry, final = {}, [], {}, {}
    over_key = Window.partitionBy(*axis.keys).orderBy("_c")
    earlier = over_key.rowsBetween(Window.unboundedPreceding, -1)
    over_key_back = Window.partitionBy(*axis.keys).orderBy(F.col("_c").desc())
    later = over_key_back.rowsBetween(Window.unboundedPreceding, -1)
    for name, op in ops.items():
        here, kept, given = f"_l_{name}", f"_s_{name}", f"_g_{name}"
        boxed = F.struct(op.expr.alias("v"))
        match op:
            case Lag() | Lead():
                ahead = isinstance(op, Lead)
                local[here] = _windowed(replace(op, expr=boxed), axis, "_c")
                edge = F.min_by if ahead else F.max_by
                summary.append(edge(boxed, place).alias(kept))
                step = F.lead if ahead else F.lag
                carry[given] = step(F.col(kept)).over(over_key)
                # Inside a chunk the boxed neighbour is never null, so null means the edge.
                final[name] = F.coalesce(F.col(here), F.col(given))["v"]
            case Last() | Next():
                ahead = isinstance(op, Next)
                local[here] = _windowed(op, axis, "_c")
                edge = F.min_by if ahead else F.max_by
                summary.append(edge(op.expr, F.when(op.expr.isNotNull(), place)).alias(kept))
                frame = later if ahead else earlier
                carry[given] = F.last(F.col(kept), ignorenulls=True).over(frame)
                final[name] = F.coalesce(F.col(here), F.col(given))
            case Sum():
                local[here] = _windowed(op, axis, "_c")
                summary.append(F.sum(op.expr).alias(kept))
                carry[given] = F.sum(kept).over(earlier)
                both = F.col(here) + F.col(given)
                final[name] = F.coalesce(both, F.col(here), F.col(given))
            case Least():
                local[here] = _windowed(op, axis, "_c")
                summary.append(F.min(op.expr).alias(kept))
                carry[given] = F.min(kept).over(earlier)
                low = F.when(F.col(given) < F.col(here), F.col(given)).otherwise(F.col(here))
                final[name] = F.coalesce(low, F.col(given))
            case Tail():
                local[here] = _windowed(op, axis, "_c")
                back = axis.window("_c", descending=True)
                newest = F.when(F.row_number().over(back) == 1, F.col(here))
                local[f"_n_{name}"] = newest
                summary.append(F.max(f"_n_{name}").alias(kept))
                few = over_key.rowsBetween(-op.size, -1)
                carry[given] = F.flatten(F.collect_list(kept).over(few))
                joined = F.concat(F.coalesce(F.col(given), F.array()), F.col(here))
                start = F.greatest(F.size(joined) - op.size + 1, F.lit(1))
                final[name] = F.slice(joined, start, op.size)
    with_local = cut
    for column, expr in local.items():
        with_local = with_local.withColumn(column, expr)
    tails = any(isinstance(op, Tail) for op in ops.values())
    per_chunk = (with_local if tails else cut).groupBy(*by).agg(*summary)
    per_chunk = per_chunk.withColumns(carry).select(*by, *carry)
    merged = with_local.join(per_chunk, list(by), "left")
    return merged.select(*names, *[expr.alias(n) for n, expr in final.items()])


# --- fold -----------------------------------------------------------------------------


Step = Callable[[object, list], tuple[object, list[tuple]]]


def _slices(by: list[str], batches: Iterator[pd.DataFrame]):
    """Runs of rows with equal keys, per batch: ``(key, rows)`` and ``None`` after a batch."""
    for pdf in batches:
        rows = list(pdf.itertuples(index=False, name="Row"))
        keys = list(zip(*[pdf[k].tolist() for k in by]))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or keys[i] != keys[start]:
                yield keys[start], rows[start:i]
                start = i
        yield None, None


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object)


def in_groups(
    df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], solve: Callable, schema: T.StructType
) -> DataFrame:
    """``solve(key, rows)`` per group, many groups per Arrow batch.

    A group must be bounded by its caller; tiny groups cost no call of their own.
    """
    names = schema.names

    def run(batches):
        current, held, out = None, [], []
        for key, rows in _slices(list(by), batches):
            if key is None:
                yield _frame(out, names)
                out = []
                continue
            if key != current and held:
                out += solve(current, held)
                held = []
            current = key
            held += rows
        if held:
            yield _frame(solve(current, held), names)

    placed = df.repartition(*by).sortWithinPartitions(*by, *order)
    return placed.mapInPandas(run, schema)


def _folding(by: list[str], step: Step, names: list[str], ends: bool):
    """Batches of sorted rows to output rows, or to the state left by each group."""

    def run(batches):
        current, state, given, out = None, None, None, []
        for key, rows in _slices(by, batches):
            if key is None:
                yield _frame(out, names)
                out = []
                continue
            if key != current:
                if ends and current is not None:
                    out.append((*current, given, None if state is None else json.dumps(state)))
                current = key
                given = getattr(rows[0], "given_state", None)
                state = None if given is None else json.loads(given)
            state, produced = step(state, rows)
            if not ends:
                out += produced
        if ends and current is not None:
            last = (*current, given, None if state is None else json.dumps(state))
            yield _frame([last], names)

    return run


def fold(df: DataFrame, axis: Axis, step: Step, schema: T.StructType) -> DataFrame:
    """Run a sequential state machine along the axis.

    ``step(state, rows)`` receives the state left by earlier rows (``None`` at the
    start of a key) and some next rows as named tuples, and returns the new state
    (anything JSON can hold exactly) with the output tuples.  It must not depend on
    where the rows are split.  A row starts with the columns of ``df`` in order and may
    hold more.

    Beyond the checked bound, chunks run in parallel from assumed states.  A chunk is
    run again only if its assumption proves wrong, so the result is exact; rules that
    forget (most do, after a reset or a few rows) settle in two or three rounds.
    """
    keys, order = list(axis.keys), list(axis.order)
    if not axis.chunked:
        placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
        return placed.mapInPandas(_folding(keys, step, schema.names, False), schema)

    by = [*keys, "_c"]
    cut = materialize(df.withColumn("_c", axis.chunk()).repartition(*by))
    key_fields = [f for k in by for f in cut.schema.fields if f.name == k]
    state_schema = T.StructType(
        key_fields
        + [T.StructField("given_state", T.StringType()), T.StructField("left_state", T.StringType())]
    )

    def started(states: DataFrame) -> DataFrame:
        # The chunk's rows, columns first as given, with the state they start from.
        rows = cut.join(states, by).select(*df.columns, "_c", "given_state")
        return rows.repartition(*by).sortWithinPartitions(*by, *order)

    over_key = Window.partitionBy(*keys).orderBy("_c")
    todo = cut.select(*by).distinct().withColumn("given_state", F.lit(None).cast("string"))
    known = None
    while True:
        ran = started(todo).mapInPandas(
            _folding(by, step, state_schema.names, True), state_schema
        )
        if known is not None:
            ran = known.join(todo.select(*by), by, "left_anti").unionByName(ran)
        known = materialize(ran)
        linked = known.withColumn("want", F.lag("left_state").over(over_key))
        todo = materialize(
            linked.filter(~F.col("want").eqNullSafe(F.col("given_state"))).select(
                *by, F.col("want").alias("given_state")
            )
        )
        if todo.isEmpty():
            break
    final = started(known.select(*by, "given_state"))
    return final.mapInPandas(_folding(by, step, schema.names, False), schema)


# --- joins along an order -------------------------------------------------------------


def asof(
    left: DataFrame,
    right: DataFrame,
    axis: Axis,
    left_on: str,
    right_on: str,
    name: str,
    tie: str | None = None,
) -> DataFrame:
    """Left rows with ``name``: the last right row whose order value is not later."""
    keys = list(axis.keys)
    left_row = F.struct(*left.columns)
    right_row = F.struct(*right.columns)
    rank = F.col(tie) if tie else F.lit(0)
    marks = right.select(
        *keys,
        F.col(right_on).alias("_t"),
        F.lit(0).alias("_side"),
        rank.cast("double").alias("_tie"),
        right_row.alias("_r"),
    )
    rows = left.select(
        *keys,
        F.col(left_on).alias("_t"),
        F.lit(1).alias("_side"),
        F.lit(0.0).alias("_tie"),
        left_row.alias("_l"),
    )
    both = marks.unionByName(rows, allowMissingColumns=True)
    order = ("_t", "_side", "_tie")
    along = plan_axis(both, axis.keys, order) if axis.chunked else Axis(axis.keys, order)
    found = scan(both, along, _m=Last(F.col("_r"))).filter(F.col("_side") == 1)
    return found.select("_l.*", F.col("_m").alias(name))


_MIN_LEVEL, _MAX_LEVEL = -24, 62


def _level(start: Column, end: Column) -> Column:
    length = (end - start).cast("double")
    exact = F.ceil(F.log2(F.when(length > 0, length))).cast("int")
    fits = F.coalesce(exact, F.lit(_MIN_LEVEL))
    return F.least(F.greatest(fits, F.lit(_MIN_LEVEL)), F.lit(_MAX_LEVEL))


def _present(side: DataFrame) -> Column:
    """The distinct levels of one side as a scalar subquery; at most one per power of two."""
    return side.agg(F.collect_set("own").alias("levels")).scalar()


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: tuple[str, ...],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
) -> DataFrame:
    """Pairs (``l``, ``r``) of rows whose closed spans meet; points are spans of length zero.

    An interval lies in at most two cells of the power of two that covers its
    length, so a pair is met at the larger of the two powers by an equi-join on
    (key, power, cell).  Work grows with rows and pairs, never with interval length.
    Nothing runs while the query is built; a side with a costly lineage is best kept by its
    caller, since its lengths are looked at apart.
    """
    sides, levels = [], []
    for df, (start, end) in ((left, left_span), (right, right_span)):
        side = df.select(
            *keys,
            F.struct(*df.columns).alias("row"),
            F.col(start).cast("double").alias("a"),
            F.col(end).cast("double").alias("b"),
            _level(F.col(start), F.col(end)).alias("own"),
        ).filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") <= F.col("b")))
        levels.append(F.array(F.lit(_MIN_LEVEL)) if start == end else _present(side))
        sides.append(side)

    def placed(side: DataFrame, others: Column) -> DataFrame:
        told = side.withColumn("levels", F.coalesce(others, F.array().cast("array<int>")))
        at = told.withColumn("power", F.explode(F.array_union(F.array("own"), "levels"))).filter("power >= own")
        size = F.pow(F.lit(2.0), F.col("power"))
        first = F.floor(F.col("a") / size).cast("long")
        final = F.floor(F.col("b") / size).cast("long")
        return at.withColumn("cell", F.explode(F.sequence(first, final)))

    lp = placed(sides[0], levels[1]).alias("l")
    rp = placed(sides[1], levels[0]).alias("r")
    meet = F.greatest(F.col("l.a"), F.col("r.a"))
    size = F.pow(F.lit(2.0), F.col("l.power"))
    condition = (
        (F.col("l.power") == F.col("r.power"))
        & (F.col("l.cell") == F.col("r.cell"))
        & (F.col("l.power") == F.greatest(F.col("l.own"), F.col("r.own")))
        & (F.col("l.cell") == F.floor(meet / size).cast("long"))
        & (meet <= F.least(F.col("l.b"), F.col("r.b")))
    )
    for key in keys:
        condition = (F.col(f"l.{key}") == F.col(f"r.{key}")) & condition
    return lp.join(rp, condition).select(F.col("l.row").alias("l"), F.col("r.row").alias("r"))


# --- exact quantiles ------------------------------------------------------------------


def medians(df: DataFrame, keys: tuple[str, ...], columns: dict[str, str]) -> DataFrame:
    """Exact medians of several columns, ``{output: column}``, in one aggregate where keys fit a task."""
    if _largest(df, *keys) <= group_rows(df.sparkSession):
        return df.groupBy(*keys).agg(*(F.percentile(c, F.lit(0.5)).alias(n) for n, c in columns.items()))
    parts = [quantiles(df, keys, c, {n: 0.5}) for n, c in columns.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(keys), "outer")
    return out


def quantiles(
    df: DataFrame, keys: tuple[str, ...], value: str, fractions: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key.

    Equal values are counted before the shuffle.  Keys with many distinct values are
    ranked by a chunked running count, so that no task holds a whole key.
    """
    # Distinct values with counts; kept, since their number is checked before they are used.
    counted = materialize(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).count())
    if _largest(counted, *keys) <= group_rows(df.sparkSession):
        exact = [
            F.percentile(value, F.lit(f), F.col("count")).alias(n) for n, f in fractions.items()
        ]
        return counted.groupBy(*keys).agg(*exact)
    axis = plan_axis(counted, keys, (value,))
    ranked = scan(counted, axis, _upto=Sum(F.col("count")))
    totals = counted.groupBy(*keys).agg(F.sum("count").alias("_n"))
    ranked = ranked.join(totals, list(keys))
    first = F.col("_upto") - F.col("count")
    parts = []
    for name, fraction in fractions.items():
        spot = (F.col("_n") - 1) * F.lit(fraction)
        low = F.floor(spot)
        high = F.least(low + 1, F.col("_n") - 1)
        for side, index in (("lo", low), ("hi", high)):
            hit = (first <= index) & (index < F.col("_upto"))
            parts.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        parts.append(F.max(spot - low).alias(f"_{name}_w"))
    found = ranked.groupBy(*keys).agg(*parts)
    mixed = [
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n)
        for n in fractions
    ]
    return found.select(*keys, *mixed)


