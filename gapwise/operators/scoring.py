"""Scoring of predicted events against sparse reviewed truth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.channel import finite
from gapwise.ordered import (
    Axis, Lag, Last, Next, Sum, fold, group_rows, in_groups, materialize, plan_axis, quantiles,
    row_number, scan,
)


def event_violations(truth: DataFrame, predictions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Repeated identities, invalid truth intervals and invalid prediction times."""
    parts = []
    for side, rows in (("truth", truth), ("prediction", predictions)):
        twice = rows.groupBy(*keys, "id").count().filter("count > 1")
        parts.append(twice.select(*keys, F.lit(f"repeated_{side}_id").alias("rule"),
                                  F.col("id").cast("string").alias("key")))
    lo, hi = F.col("lo_s"), F.col("hi_s")
    bad = ~(finite(lo) & finite(hi) & (lo >= 0) & (hi >= lo))
    parts.append(truth.filter(F.coalesce(bad, F.lit(True))).select(
        *keys, F.lit("invalid_truth_interval").alias("rule"), F.col("id").cast("string").alias("key")))
    t = F.col("time_s")
    bad = ~(finite(t) & (t >= 0))
    if "confirmed_at_s" in predictions.columns:
        c = F.col("confirmed_at_s")
        bad = bad | (c.isNotNull() & ~(finite(c) & (c >= t)))
    parts.append(predictions.filter(F.coalesce(bad, F.lit(True))).select(
        *keys, F.lit("invalid_event_time").alias("rule"), F.col("id").cast("string").alias("key")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Distances are added as integers of this unit, so sums are exact in any order.
UNIT = 2.0**60
DROP_TRUTH, DROP_PREDICTION, PAIR = 0, 1, 2


class Frontier:
    """The edge of the table of best scores while items arrive in order of time.

    A score is (minus the pairs, their total distance) for the first i truth items and
    the first j predictions.  Only items within the window can still pair, so the edge
    is the last row over recent predictions and the last column over recent truth.
    """

    def __init__(self, window: float, state=None):
        self.window = window
        # Recent items as [rank, time], and the scores before and after each of them.
        self.truth, self.predictions, self.column, self.row = state or [[], [], [[0, 0]], [[0, 0]]]

    def state(self) -> list:
        """The edge relative to its corner, equal for equal futures."""
        pairs, cost = self.row[-1]

        def relative(scores):
            return [[n - pairs, c - cost] for n, c in scores]

        return [self.truth, self.predictions, relative(self.column), relative(self.row)]

    def arrive(self, side: int, rank: int, time: float) -> list[list[int]]:
        """Scores with one more item; returns ``[other rank, choice]`` unless it is dropped."""
        for items, scores in ((self.truth, self.column), (self.predictions, self.row)):
            while items and items[0][1] < time - self.window - 1e-9:
                items.pop(0)
                scores.pop(0)
        others, old = (
            (self.predictions, self.row) if side == 0 else (self.truth, self.column)
        )
        new, choices = [old[0]], []
        for k, (other, at) in enumerate(others):
            # Without this item the score is old; without the other one it is new so far.
            options = [(old[k + 1], side), (new[-1], 1 - side)]
            if side == 1:
                options.reverse()
            far = abs(time - at)
            if far <= self.window:
                options.append(([old[k][0] - 1, old[k][1] + round(far * UNIT)], PAIR))
            score, choice = min(options, key=lambda option: option[0])
            new.append(score)
            if choice != side:
                choices.append([other, choice])
        if side == 0:
            self.row = new
            self.truth.append([rank, time])
            self.column.append(new[-1])
        else:
            self.column = new
            self.predictions.append([rank, time])
            self.row.append(new[-1])
        return choices


def trace(place, side: int, rank: int, choices) -> tuple[list[int], tuple[int, int] | None]:
    """Walk back past one item from the place (truth, prediction) reached so far."""
    i, j = place
    if 0 in (i, j) or rank != (i, j)[side]:
        return [i, j], None
    told = {other: choice for other, choice in choices}
    while i and j:
        choice = told.get(j if side == 0 else i, side)
        if choice == PAIR:
            return [i - 1, j - 1], (i, j)
        if choice == DROP_TRUTH:
            i -= 1
        else:
            j -= 1
        if choice == side:
            break
    return [i, j], None


def best_monotone_pairs(items: list[tuple], window: float) -> list[tuple[int, int]]:
    """Most pairs, then least total distance, in order; items are (side, rank, time) by time."""
    frontier, kept, counts = Frontier(window), [], [0, 0]
    for side, rank, time in items:
        kept.append((side, rank, frontier.arrive(side, rank, time)))
        counts[side] = rank
    place, pairs = counts, []
    for side, rank, choices in reversed(kept):
        place, pair = trace(place, side, rank, choices)
        if pair:
            pairs.append(pair)
    return pairs[::-1]


def match_events(
    truth: DataFrame, predictions: DataFrame, axis: Axis, window: float
) -> DataFrame:
    """Matched pairs: the most matches first, then the least total midpoint distance.

    ``truth``: keys, ``id, lo_s, hi_s``; ``predictions``: keys, ``id, time_s,
    confirmed_at_s``.  Wherever the merged stream pauses for more than the window, no
    pair can span the pause, so the parts are matched apart.  Where one key is too large
    for a task, the scores are carried along its chunks and traced back the same way.
    """
    if not math.isfinite(window) or window <= 0:
        raise ValueError("invalid matching window")
    keys = list(axis.keys)
    t = truth.select(
        *keys, ((F.col("lo_s") + F.col("hi_s")) / 2).alias("t"), F.lit(0).alias("side"),
        "id", ((F.col("hi_s") - F.col("lo_s")) / 2).alias("half"),
        F.lit(None).cast("double").alias("delay"),
    )
    p = predictions.select(
        *keys, F.col("time_s").alias("t"), F.lit(1).alias("side"), "id",
        F.lit(None).cast("double").alias("half"),
        (F.col("confirmed_at_s") - F.col("time_s")).alias("delay"),
    )
    both = t.unionByName(p)
    along = _time_axis(both, axis, ("t", "side", "id"))
    if along.chunked:
        return _match_along(both, along, window)
    both = scan(both, along, _pt=Lag(F.col("t")))
    cut = F.coalesce(F.col("t") - F.col("_pt") > window, F.lit(True))
    both = scan(both, along, part=Sum(cut.cast("long"))).drop("_pt")
    # A part needs both sides to hold a pair.
    mixed = both.groupBy(*keys, "part").agg(F.min("side").alias("a"), F.max("side").alias("b"))
    mixed = mixed.filter("a = 0 AND b = 1").select(*keys, "part")
    both = both.join(mixed, [*keys, "part"], "left_semi")
    schema = _key_schema(both, keys, "truth_id", "prediction_id", both.schema["id"].dataType)
    schema = T.StructType(schema.fields + T.StructType.fromDDL(_ERRORS).fields)

    def solve(key, rows):
        sides, items = ([], []), []
        for r in rows:
            sides[r.side].append(r)
            items.append((r.side, len(sides[r.side]), r.t))
        out = []
        for i, j in best_monotone_pairs(items, window):
            a, b = sides[0][i - 1], sides[1][j - 1]
            signed = b.t - a.t
            out.append((*key[:-1], a.id, b.id, a.t, a.half, signed, abs(signed), b.delay))
        return out

    return in_groups(both, (*keys, "part"), ("t", "side", "id"), solve, schema)


_ERRORS = (
    "annotation_midpoint_s double, annotation_half_width_s double, signed_error_s double, "
    "absolute_error_s double, confirmation_delay_s double"
)


def _key_schema(df: DataFrame, keys: list[str], first: str, second: str, kind) -> T.StructType:
    own = [f for k in keys for f in df.schema.fields if f.name == k]
    return T.StructType([*own, T.StructField(first, kind), T.StructField(second, kind)])


def _match_along(both: DataFrame, along: Axis, window: float) -> DataFrame:
    """The matching of keys that exceed a task: two folds over numbered items."""
    keys = list(along.keys)
    is_truth = (F.col("side") == 0).cast("long")
    rows = scan(both, along, n=row_number(), truths=Sum(is_truth))
    rows = rows.withColumn("predictions", F.col("n") - F.col("truths"))
    rank = F.when(F.col("side") == 0, F.col("truths")).otherwise(F.col("predictions"))
    # Numbers are unique in a key, so chunks of numbers are bounded.
    rows = materialize(rows.withColumn("rank", rank))
    width = float(group_rows(both.sparkSession))
    slim = rows.select(*keys, "n", "side", "rank", "t", "truths", "predictions")
    own = [f for k in keys for f in slim.schema.fields if f.name == k]
    scored = T.StructType(
        own + T.StructType.fromDDL(
            "back bigint, side int, rank bigint, truths bigint, predictions bigint, "
            "choices array<array<bigint>>"
        ).fields
    )

    def forward(state, items):
        frontier, out = Frontier(window, state), []
        for r in items:
            choices = frontier.arrive(r.side, r.rank, r.t)
            head = [getattr(r, k) for k in keys]
            out.append((*head, -r.n, r.side, r.rank, r.truths, r.predictions, choices))
        return frontier.state(), out

    def backward(state, items):
        place, out = state, []
        for r in items:
            place = place or [r.truths, r.predictions]
            place, pair = trace(place, r.side, r.rank, r.choices)
            if pair:
                out.append((*[getattr(r, k) for k in keys], *pair))
        return place, out

    table = materialize(fold(slim, Axis(along.keys, ("n",), width), forward, scored))
    ranks = _key_schema(table, keys, "i", "j", T.LongType())
    pairs = fold(table, Axis(along.keys, ("back",), width), backward, ranks)
    a = rows.filter("side = 0").select(
        *keys, F.col("rank").alias("i"), F.col("id").alias("truth_id"),
        F.col("t").alias("annotation_midpoint_s"), F.col("half").alias("annotation_half_width_s"),
    )
    b = rows.filter("side = 1").select(
        *keys, F.col("rank").alias("j"), F.col("id").alias("prediction_id"), F.col("t").alias("_t"),
        F.col("delay").alias("confirmation_delay_s"),
    )
    found = pairs.join(a, [*keys, "i"]).join(b, [*keys, "j"])
    signed = F.col("_t") - F.col("annotation_midpoint_s")
    return found.select(
        *keys, "truth_id", "prediction_id", "annotation_midpoint_s", "annotation_half_width_s",
        signed.alias("signed_error_s"), F.abs(signed).alias("absolute_error_s"),
        "confirmation_delay_s",
    )


def _time_axis(df: DataFrame, axis: Axis, order: tuple[str, ...]) -> Axis:
    """Planned on the rows themselves: truth and predictions can outnumber the samples."""
    return plan_axis(df, axis.keys, order)


def match_classes(
    truth: DataFrame, predictions: DataFrame, matches: DataFrame, axis: Axis, window: float
) -> DataFrame:
    """Every truth item and prediction with its class.

    Truth: ``matched`` or ``missed``.  Predictions: ``matched``, ``duplicate`` (near some
    truth midpoint) or ``outside``.  The nearest midpoints on both sides decide.
    """
    keys = list(axis.keys)
    mid = (F.col("lo_s") + F.col("hi_s")) / 2
    t = truth.select(*keys, mid.alias("t"), F.lit("truth").alias("side"), "id")
    p = predictions.select(*keys, F.col("time_s").alias("t"), F.lit("prediction").alias("side"), "id")
    both = t.unionByName(p)
    along = _time_axis(both, axis, ("t", "side", "id"))
    at = F.when(F.col("side") == "truth", F.col("t"))
    both = scan(both, along, _l=Last(at), _r=Next(at))
    used = matches.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit("truth").alias("side"), F.col("truth_id").alias("id")),
                F.struct(F.lit("prediction").alias("side"), F.col("prediction_id").alias("id")),
            )
        ),
    ).withColumn("_used", F.lit(True))
    rows = both.join(used, [*keys, "side", "id"], "left")
    near = (F.col("t") - F.col("_l") <= window) | (F.col("_r") - F.col("t") <= window)
    kind = (
        F.when(F.col("_used"), "matched")
        .when(F.col("side") == "truth", "missed")
        .when(F.coalesce(near, F.lit(False)), "duplicate")
        .otherwise("outside")
    )
    return rows.select(*keys, "side", "id", kind.alias("class"))


def match_metrics(classes: DataFrame, matches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Counts, precision, recall and error quantiles per key."""

    def n(side: str, kind: str | None = None) -> Column:
        wanted = F.col("side") == side
        return F.count_if(wanted if kind is None else wanted & (F.col("class") == kind))

    base = classes.groupBy(*keys).agg(
        n("truth").alias("truth_count"),
        n("prediction").alias("prediction_count"),
        n("truth", "matched").alias("matched_count"),
        n("truth", "missed").alias("missed_count"),
        n("prediction", "duplicate").alias("duplicate_count"),
        n("prediction", "outside").alias("outside_count"),
    )
    spread = {"median_error_s": 0.5, "p95_error_s": 0.95}
    errors = quantiles(matches, keys, "absolute_error_s", spread)
    t, p, m = F.col("truth_count"), F.col("prediction_count"), F.col("matched_count")
    return base.join(errors, list(keys), "left").withColumns(
        {
            "precision": F.when((p > 0) & (t > 0), m / p),
            "recall": F.when(t > 0, m / t),
            "status": F.when(t > 0, "available").otherwise("not_evaluated"),
        }
    )


# Pedal passages with reviewed crossing semantics.
PEDAL_TYPES = {
    "brake_onset": ("brake", "onset"),
    "brake_release": ("brake", "release"),
    "throttle_reapplication": ("throttle", "onset"),
    "throttle_release": ("throttle", "release"),
}


def truth_eligibility(passages: DataFrame, threshold: float) -> DataFrame:
    """Pedal passages with field, direction and, for the unusable ones, the reason.

    ``passages``: ``kind, event_type, eligible, exclusion_reason, threshold_reviewed,
    threshold_pct``.
    """
    rows = passages.filter(F.col("kind") == "pedal_event")
    known = F.col("event_type").isin(*PEDAL_TYPES)
    item = F.lit(None).cast("struct<field:string,direction:string>")
    for name, (field, direction) in PEDAL_TYPES.items():
        pair = F.struct(F.lit(field).alias("field"), F.lit(direction).alias("direction"))
        item = F.when(F.col("event_type") == name, pair).otherwise(item)
    usable = F.coalesce(known, F.lit(False)) & F.coalesce(F.col("eligible"), F.lit(True))
    settled = F.coalesce("threshold_reviewed", F.lit(False)) & F.coalesce(
        F.col("threshold_pct") == threshold, F.lit(False)
    )
    reason = F.when(
        ~usable,
        F.coalesce("exclusion_reason", F.lit("no_reviewed_applicable_crossing_semantics")),
    ).when(
        (item["direction"] == "release") & ~settled,
        "release_marker_does_not_establish_falling_threshold",
    )
    return rows.withColumns(
        {
            "pedal_field": item["field"],
            "direction": item["direction"],
            "excluded_because": reason,
            "included": reason.isNull(),
        }
    )
