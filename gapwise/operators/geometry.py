"""Points against closed polylines: projection, resampling, position along the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.ordered import Axis, broadcast_if_small, broadcast_rows, Lead, Least, materialize, scan, Sum


def segments(vertices: DataFrame, axis: Axis | None = None) -> DataFrame:
    """Segments of a closed polyline ``(track_id, idx, x, y)`` with arc length.

    Adds the end point, ``length``, ``start_arc`` and ``total`` of the ring.
    """
    axis = axis or Axis(("track_id",), ("idx",))
    keys = list(axis.keys)
    point = F.struct("x", "y")
    first = vertices.groupBy(*keys).agg(F.min_by(point, F.struct(*axis.order)).alias("_first"))
    rows = scan(vertices, axis, _next=Lead(point)).join(first, keys)
    end = F.coalesce("_next", "_first")
    rows = rows.withColumns({"x1": end["x"], "y1": end["y"]}).drop("_next", "_first")
    dx, dy = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    rows = rows.withColumn("length", F.sqrt(dx * dx + dy * dy))
    rows = scan(rows, axis, _arc=Sum(F.col("length")))
    total = rows.groupBy(*keys).agg(F.max("_arc").alias("total"))
    rows = rows.join(total, keys)
    return rows.withColumn("start_arc", F.col("_arc") - F.col("length")).drop("_arc")


def project_points(
    points: DataFrame, vertices: DataFrame, max_distance: float, keys: tuple[str, ...]
) -> DataFrame:
    """Projections of points ``(keys, track_id, x, y)`` onto near segments of their ring.

    Segments are listed in every square of the plane within reach, so a point meets only
    the segments near it, by an equi-join on (track, square).  Consecutive segments form
    one group, which keeps its closest projection.
    """
    segs = segments(vertices).filter(F.col("length") > 0)
    size = F.lit(float(max_distance) * 2.0)

    def square(value: Column) -> Column:
        return F.floor(value / size).cast("long")

    def squares(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(square(low - max_distance), square(high + max_distance)))

    # Column by column, only the squares that the part of the segment near this column can reach.
    listed = segs.withColumn("_cx", squares(F.least("x", "x1"), F.greatest("x", "x1")))
    run = F.col("x1") - F.col("x")

    def height(edge: Column) -> Column:
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge - F.col("x")) / run))
        return F.col("y") + share * (F.col("y1") - F.col("y"))

    left, right = F.col("_cx") * size - max_distance, (F.col("_cx") + 1) * size + max_distance
    first = F.when(run == 0, F.col("y")).otherwise(height(left))
    final = F.when(run == 0, F.col("y1")).otherwise(height(right))
    listed = listed.withColumns({"_y0": first, "_y1": final})
    slack = F.lit(float(max_distance) * 1e-6)
    listed = listed.withColumn("_cy", squares(F.least("_y0", "_y1") - slack, F.greatest("_y0", "_y1") + slack))
    listed = listed.select(
        "track_id", "_cx", "_cy", "idx", F.col("x").alias("ax"), F.col("y").alias("ay"),
        F.col("x1").alias("bx"), F.col("y1").alias("by"), "length", "start_arc", "total",
    )
    listed = broadcast_if_small(listed)
    placed = points.withColumns({"_cx": square(F.col("x")), "_cy": square(F.col("y"))})
    met = placed.join(listed, ["track_id", "_cx", "_cy"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    along = ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy)
    met = met.withColumn("_f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)))
    met = met.withColumns(
        {"px": F.col("ax") + F.col("_f") * dx, "py": F.col("ay") + F.col("_f") * dy}
    )
    ex, ey = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    arc = F.col("start_arc") + F.col("_f") * F.col("length")
    met = met.withColumns(
        {
            "distance": F.sqrt(ex * ex + ey * ey),
            "s_visual": F.pmod(arc / F.col("total"), F.lit(1.0)),
        }
    ).filter(F.col("distance") <= max_distance)
    # A point meets each segment once; its group is at most the ring.
    by = (*keys, "track_id")
    order = Window.partitionBy(*by).orderBy("idx")
    met = met.withColumn("_island", F.col("idx") - F.row_number().over(order))
    best = F.struct("distance", "s_visual", "py", "px", "idx", "x", "y")
    kept = met.groupBy(*by, "_island").agg(F.min(best).alias("_b"))
    return kept.select(
        *by,
        F.col("_b.x").alias("x"),
        F.col("_b.y").alias("y"),
        F.col("_b.idx").alias("segment"),
        F.col("_b.s_visual").alias("s_visual"),
        F.col("_b.distance").alias("distance"),
        F.col("_b.px").alias("px"),
        F.col("_b.py").alias("py"),
    )


def rank_projections(projections: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``rank`` of the projections of one point: by distance, position, then place."""
    order = Window.partitionBy(*keys).orderBy("distance", "s_visual", "py", "px")
    return projections.withColumn("rank", F.row_number().over(order))


def resample_closed_path(
    vertices: DataFrame, spacing: float, axis: Axis | None = None
) -> DataFrame:
    """Points at arc 0, spacing, 2 spacing, ... below the total length of the ring."""
    segs = segments(vertices, axis).filter(F.col("length") > 0)
    first = F.ceil(F.col("start_arc") / spacing).cast("long")
    last = F.floor((F.col("start_arc") + F.col("length")) / spacing).cast("long")
    k = F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), last + 1)).alias("k")
    rows = segs.select("track_id", "x", "y", "x1", "y1", "start_arc", "length", "total", k)
    arc = F.col("k") * spacing
    inside = (arc >= F.col("start_arc")) & (arc < F.col("start_arc") + F.col("length"))
    rows = rows.filter(inside & (arc < F.col("total")))
    share = (arc - F.col("start_arc")) / F.col("length")
    return rows.select(
        "track_id",
        F.col("k").alias("idx"),
        arc.alias("arc"),
        (F.col("x") + share * (F.col("x1") - F.col("x"))).alias("x"),
        (F.col("y") + share * (F.col("y1") - F.col("y"))).alias("y"),
        "total",
    )


DECISIVE_PERCENT = 0.02
#: Vertices of a leaf, and children of a box, in the tree over a ring.
RING_BLOCK = 64


def _level(width: int) -> Column:
    return F.floor(F.col("idx") / width).cast("long")


def _box_levels(segs: DataFrame, levels: int) -> list[DataFrame]:
    """Boxes around runs of a ring from the top level down: per parent ``_at`` the array ``_boxes``."""
    boxes = segs.groupBy("track_id", _level(RING_BLOCK).alias("_b")).agg(
        *(f(c).alias(f"{c}{n}") for c in ("x", "y") for n, f in enumerate((F.min, F.max)))
    )
    found, box = [], F.struct(F.col("_b").alias("b"), "x0", "x1", "y0", "y1")
    for level in range(1, levels + 1):
        parent = F.floor(F.col("_b") / RING_BLOCK).cast("long") if level < levels else F.lit(0).cast("long")
        by = ["track_id", "_at"]
        found.append(boxes.withColumn("_at", parent).groupBy(*by).agg(F.collect_list(box).alias("_boxes")))
        boxes = boxes.groupBy("track_id", parent.alias("_b")).agg(
            *(f(f"{c}{n}").alias(f"{c}{n}") for c in ("x", "y") for n, f in enumerate((F.min, F.max)))
        )
    return found[::-1]


def _reach(box: Column) -> Column:
    """Least and largest squared distance of the point to any vertex inside a box.

    Both are rounded as the distance to a vertex is, so they bound it to the last bit.
    """
    x, y, zero = F.col("x"), F.col("y"), F.lit(0.0)
    near = [F.greatest(box[f"{n}0"] - v, v - box[f"{n}1"], zero) for n, v in (("x", x), ("y", y))]
    far = [F.greatest(F.abs(v - box[f"{n}0"]), F.abs(v - box[f"{n}1"])) for n, v in (("x", x), ("y", y))]
    low, high = (a * a + b * b for a, b in (near, far))
    return F.struct(F.nanvl(low, zero).alias("low"), high.alias("high"), box["b"].alias("b"))


def nearest_vertex(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """Points with the index and arc of the nearest vertex, the first one on ties.

    A ring of up to ``RING_BLOCK`` vertices is one array per track, searched in place.  A larger
    one is a tree of boxes around runs of vertices: level by level a point goes on into those
    boxes only that can hold a vertex as near as the best box's farthest corner, so it looks at
    some leaves and never at the whole ring.
    """
    segs = segments(vertices)
    low, high, vertices_in_all = segs.agg(F.min("idx"), F.max("idx"), F.count(F.lit(1))).first()
    levels = 0
    while vertices_in_all and high // RING_BLOCK**levels - low // RING_BLOCK**levels >= RING_BLOCK:
        levels += 1
    # A row of a ring's table is an array, so what a broadcast would send is counted in vertices.
    small = vertices_in_all <= broadcast_rows(points.sparkSession)

    def side(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if small else table

    segs = materialize(segs) if levels else segs
    total = segs.groupBy("track_id").agg(F.max("total").alias("ring_length"))
    leaf = _level(RING_BLOCK) if levels else F.lit(0).cast("long")
    item = F.struct("idx", "x", "y", "start_arc")
    leaves = segs.groupBy("track_id", leaf.alias("_at")).agg(F.array_sort(F.collect_list(item)).alias("_ring"))
    # Equal points stay apart: each has a number, fixed by a checkpoint.
    named = materialize(points.withColumn("_row", F.monotonically_increasing_id())) if levels else points
    rows = named.join(side(total), "track_id").withColumns({"_at": F.lit(0).cast("long"), "_bound": F.lit(float("inf"))})
    for boxes in _box_levels(segs, levels) if levels else []:
        rows = rows.join(side(boxes), ["track_id", "_at"]).withColumn("_boxes", F.transform("_boxes", _reach))
        bound = F.least("_bound", F.array_min(F.transform("_boxes", lambda b: b["high"])))
        rows = rows.withColumn("_bound", bound)
        # A comparison with a null (a point without a place) rules nothing out.
        near = F.filter("_boxes", lambda b: F.coalesce(b["low"] <= F.col("_bound"), F.lit(True)))
        rows = rows.withColumn("_at", F.explode(F.transform(near, lambda b: b["b"]))).drop("_boxes")
    rows = rows.join(side(leaves), ["track_id", "_at"])

    def off(v: Column) -> Column:
        dx, dy = F.col("x") - v["x"], F.col("y") - v["y"]
        return F.struct(
            (dx * dx + dy * dy).alias("d"), v["idx"].alias("idx"), v["start_arc"].alias("arc")
        )

    rows = rows.withColumn("_v", F.array_min(F.transform("_ring", off)))
    if levels:
        point = F.struct(*points.columns)
        rows = rows.groupBy("_row").agg(
            F.min("_v").alias("_v"), F.first("ring_length").alias("ring_length"), F.first(point).alias("_p")
        ).select("_p.*", "_v", "ring_length")
    return rows.select(
        *points.columns, F.col("_v.idx").alias("vertex"), F.col("_v.arc").alias("vertex_arc"),
        "ring_length",
    )


def path_position(points: DataFrame, vertices: DataFrame, axis: Axis, start_arc: str) -> DataFrame:
    """Percent of the ring travelled from the start, in the direction of travel.

    The direction of a lap is settled by its first row that is far enough from the
    start on both ways round; before that row the position is zero.
    """
    rows = nearest_vertex(points, vertices)
    turn = F.pmod(F.col("vertex_arc") - F.col(start_arc), F.col("ring_length"))
    forward = F.when(F.col("ring_length") > 0, turn / F.col("ring_length") * 100).otherwise(0.0)
    rows = rows.withColumn("forward", forward)
    reverse = F.when(F.col("forward") == 0, 0.0).otherwise(100.0 - F.col("forward"))
    rows = rows.withColumn("reverse", reverse)
    decisive = F.least("forward", "reverse") > DECISIVE_PERCENT
    way = F.when(F.col("forward") <= F.col("reverse"), 1).otherwise(-1)
    place = [F.col(c) for c in axis.order]
    # The running minimum of (order, way) is the first decisive row so far.
    rows = scan(rows, axis, _first=Least(F.when(decisive, F.struct(*place, way.alias("way")))))
    direction = F.col("_first.way")
    position = (
        F.when(direction.isNull(), 0.0)
        .when(direction == 1, F.col("forward"))
        .otherwise(F.col("reverse"))
    )
    return rows.withColumns({"direction": direction, "position": position}).drop("_first")
