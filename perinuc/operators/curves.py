"""Ordered curves as points: lengths, tangents, bends, resampling, distances between curves.

Points carry key columns, a dense 0-based ``idx`` and ``y, x``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perinuc.functions.scalars import PIXEL_NM, clip, magnitude, move_along_normal, wrap_angle
from perinuc.operators.raster import starts
from perinuc.scale import TILE, beside, cut, neighbours, ordered_means, own_rows, positions, running_sum, tiles

CURVE = ["fov_id", "channel", "ne_label"]
SEGMENT = [*CURVE, "segment"]


def cumulative_length(points: DataFrame, keys: Sequence[str] = CURVE, tile: int = TILE) -> DataFrame:
    """Step from the previous point and arc length from the first one."""
    near = neighbours(points, keys, "idx", ["y", "x"], tile)
    step = magnitude(F.col("y") - F.col("y_prev"), F.col("x") - F.col("x_prev"))
    stepped = near.withColumn("step", F.coalesce(step, F.lit(0.0))).drop("y_prev", "x_prev", "y_next", "x_next")
    return running_sum(stepped, keys, "idx", "step", "cum", tile)


def _difference(c: str) -> Column:
    """Central difference, one-sided at the ends."""
    here, prev, nxt = F.col(c), F.col(f"{c}_prev"), F.col(f"{c}_next")
    return F.when(prev.isNull(), nxt - here).when(nxt.isNull(), here - prev).otherwise((nxt - prev) / 2.0)


def tangents(points: DataFrame, keys: Sequence[str] = CURVE, tile: int = TILE) -> DataFrame:
    """Tangent vector at every point."""
    near = neighbours(points, keys, "idx", ["y", "x"], tile)
    return near.select(*points.columns, _difference("y").alias("ty"), _difference("x").alias("tx"))


def bends(points: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """Change of direction to the previous and the next point, in degrees.

    The tangent of a neighbour needs the point after it, hence two border rows per tile and a single shuffle.
    """
    near = tiles(points, keys, "idx", 2, tile).select("*", *beside(keys, "idx", ["y", "x"]))
    turned = near.withColumn("_dir", F.atan2(_difference("x"), _difference("y")))
    seen = own_rows(turned.select("*", *beside(keys, "idx", ["_dir"])))
    here = F.col("_dir")
    return seen.select(
        *points.columns,
        F.abs(F.degrees(wrap_angle(here - F.col("_dir_prev")))).alias("bend_prev"),
        F.abs(F.degrees(wrap_angle(F.col("_dir_next") - here))).alias("bend_next"),
    )


def _sharp(bend: str, max_deg: float) -> Column:
    return F.coalesce(F.round(bend, 9) > F.lit(max_deg), F.lit(False))


def bend_filter(
    points: DataFrame, keys: Sequence[str] = CURVE, max_deg: float = 1.0, tile: int = TILE
) -> DataFrame:
    """Mark both points of every step whose direction changes too much."""
    valid = ~(_sharp("bend_prev", max_deg) | _sharp("bend_next", max_deg))
    return bends(points, keys, tile).select(*points.columns, "bend_next", valid.alias("valid"))


def revert_bends(
    fitted: DataFrame, keys: Sequence[str], length: float, max_deg: float = 1.0
) -> DataFrame:
    """Move points along their normals, and take the move back where the result bends too much.

    ``fitted`` has ``idx, y, x, ty, tx, mu``; ``mu`` equal to half the line length means no move.
    """
    ry, rx = move_along_normal("y", "x", "ty", "tx", "mu", length)
    moved = fitted.select(
        *keys, "idx", F.struct("y", "x", "ty", "tx", "mu").alias("_from"), ry.alias("y"), rx.alias("x")
    )
    checked = bend_filter(moved, keys, max_deg)
    mu = F.when(F.col("valid"), F.col("_from.mu")).otherwise(F.lit(length / 2.0))
    back = checked.select(
        *keys, "idx", F.col("_from.y").alias("y"), F.col("_from.x").alias("x"), F.col("_from.ty").alias("ty"),
        F.col("_from.tx").alias("tx"), mu.alias("mu"), (~F.col("valid")).alias("was_reverted"),
    )
    fy, fx = move_along_normal("y", "x", "ty", "tx", "mu", length)
    return back.select(*keys, "idx", "mu", "was_reverted", fy.alias("y"), fx.alias("x"))


def largest_bend(points: DataFrame, keys: Sequence[str], max_deg: float = 1.0) -> DataFrame:
    """Largest change of direction per curve, and whether the whole curve is smooth enough."""
    top = bends(points, keys).groupBy(*keys).agg(F.coalesce(F.max("bend_next"), F.lit(0.0)).alias("max_bend"))
    return top.withColumn("is_valid", F.round("max_bend", 9) <= F.lit(max_deg))


def curvature(points: DataFrame, keys: Sequence[str] = CURVE) -> DataFrame:
    """Curvature at inner points from first and second differences."""
    near = neighbours(points, keys, "idx", ["y", "x"])

    def second(c: str) -> Column:
        return F.col(f"{c}_next") - 2.0 * F.col(c) + F.col(f"{c}_prev")

    def first(c: str) -> Column:
        return (F.col(f"{c}_next") - F.col(f"{c}_prev")) / 2.0

    speed2 = first("x") * first("x") + first("y") * first("y")
    bend = F.abs(first("x") * second("y") - first("y") * second("x"))
    value = F.when(speed2 > 0, bend / F.pow(speed2, F.lit(1.5)))
    return near.select(*points.columns, value.alias("curvature"))


def curve_profile(points: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per segment: arc length, centroid, and angle of the centroid seen from the centre of its nucleus."""
    centre = points.groupBy(*by).agg(F.avg("y").alias("_cy"), F.avg("x").alias("_cx"))
    parts = cumulative_length(points, keys).groupBy(*keys).agg(
        F.max("cum").alias("arc_length"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count("*").alias("n_points")
    )
    angle = F.atan2(F.col("cy") - F.col("_cy"), F.col("cx") - F.col("_cx"))
    return parts.join(centre, list(by)).select(*keys, "n_points", "arc_length", "cy", "cx", angle.alias("angle"))


def resample(
    points: DataFrame, keys: Sequence[str], n: int | None = None, density: float | None = None
) -> DataFrame:
    """Points at equal arc lengths, by count or by points per pixel (at least two).

    Every edge emits the targets that fall on it, so no join between targets and edges is needed.
    """
    measured = cumulative_length(points, keys)
    totals = measured.groupBy(*keys).agg(F.max("cum").alias("_total"), F.max("idx").alias("_last"))
    edges = neighbours(measured, keys, "idx", ["y", "x", "cum"]).join(totals, list(keys))
    count = F.lit(n) if n is not None else F.greatest(F.bround(F.col("_total") * density).cast("int"), F.lit(2))
    step = F.col("_total") / (count - 1)
    # both ends of an edge use one formula, so neighbouring edges neither share nor miss a target
    start = F.ceil(F.col("cum") / step - 1e-9)
    stop = F.when(F.col("idx") + 1 == F.col("_last"), count - 1).otherwise(F.ceil(F.col("cum_next") / step - 1e-9) - 1)
    hit = edges.filter(F.col("cum_next").isNotNull() & (F.col("_total") > 0) & (start <= stop))
    spread = hit.select("*", step.alias("_step"), F.explode(F.sequence(start, stop)).alias("k"))
    s = F.col("k") * F.col("_step")
    span = F.col("cum_next") - F.col("cum")
    part = F.when(span > 0, clip((s - F.col("cum")) / span, 0.0, 1.0)).otherwise(F.lit(0.0))
    return spread.select(
        *keys,
        F.col("k").cast("long").alias("idx"),
        s.alias("s"),
        (F.col("y") + part * (F.col("y_next") - F.col("y"))).alias("y"),
        (F.col("x") + part * (F.col("x_next") - F.col("x"))).alias("x"),
    )


def angular_order(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points numbered by their angle about the centroid.

    The angle jumps by a whole turn where a point lies level with the centroid, so its last bit decides; it is added up in
    the order of the points, whatever order rows come in.
    """
    centre = ordered_means(points, keys, "idx", ["y", "x"]).withColumnsRenamed({"y": "_cy", "x": "_cx"})
    angle = F.atan2(F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx"))
    turned = points.join(centre, list(keys)).select(*points.columns, angle.alias("angle"))
    return positions(turned, keys, [F.round("angle", 9), F.col("idx")], "order")


def mirror(points: DataFrame, keys: Sequence[str], dim: float, axis: str = "x") -> DataFrame:
    """Reflect one coordinate and reverse the order, which keeps the sense of rotation."""
    n = points.groupBy(*keys).agg(F.max("idx").alias("_last"))
    flipped = {"idx": F.col("_last") - F.col("idx"), axis: F.lit(dim) - F.col(axis)}
    return points.join(n, list(keys)).select(*[flipped.get(c, F.col(c)).alias(c) for c in points.columns])


def to_fov_space(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Add the corner of the crop box; nuclei without a box are dropped."""
    corner = boxes.select(*CURVE, "final_top", "final_left")
    moved = {"y": F.col("y") + F.col("final_top"), "x": F.col("x") + F.col("final_left")}
    return points.join(corner, CURVE).select(*[moved.get(c, F.col(c)).alias(c) for c in points.columns])


def refine_bounds(
    points: DataFrame, keys: Sequence[str], margin: float = 10.0, size: float = 75.0
) -> tuple[DataFrame, DataFrame]:
    """Clip points to the box plus margin; also how many coordinates were clipped per curve."""
    low, high = -margin, size + margin

    def out(c: str) -> Column:
        return (F.col(c) < low) | (F.col(c) > high)

    clipped = points.select(*[clip(c, low, high).alias(c) if c in ("y", "x") else F.col(c) for c in points.columns])
    counts = points.groupBy(*keys).agg(
        F.count_if(out("x")).alias("n_clipped_x"), F.count_if(out("y")).alias("n_clipped_y")
    )
    return clipped, counts


def keep_segments(
    points: DataFrame, log: DataFrame, keys: Sequence[str], margin: float = 20.0, size: float = 75.0, extent: float = 150.0
) -> DataFrame:
    """Segments with at least four good profiles whose points all stay near the box."""
    box = points.groupBy(*keys).agg(
        F.min(F.least("y", "x")).alias("_lo"), F.max(F.greatest("y", "x")).alias("_hi")
    )
    near = box.filter(
        (F.col("_lo") >= -margin) & (F.col("_hi") <= size + margin) & (F.greatest(F.abs("_lo"), F.abs("_hi")) <= extent)
    )
    good = log.groupBy(*keys).agg(F.count_if(F.col("status") == "success").alias("_n")).filter("_n >= 4")
    return points.join(near, list(keys), "left_semi").join(good, list(keys), "left_semi")


# ---- curve against curve ------------------------------------------------------------------


def closed_edges(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges of closed curves: every point with its successor, the last one with the first."""
    n = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = points.select(*keys, "idx", "y", "x").join(n, list(keys))
    after = sized.select(
        *keys, ((F.col("idx") + F.col("_n") - 1) % F.col("_n")).alias("idx"), F.col("y").alias("y2"), F.col("x").alias("x2")
    )
    return sized.join(after, [*keys, "idx"]).select(*keys, F.col("idx").alias("edge"), "y", "x", "y2", "x2")


# Edges of one stretch, and stretches of one stretch on the next level.
FAN = 8


def _levels(edges: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """Stretches of a closed curve from the whole (``block`` 0) to FAN single edges, each with its ``kids``.

    A stretch knows its bounding box, its first place and the height where it ends.  The number of levels follows the
    longest curve, so a curve of a million edges has seven.
    """
    box = ("y_lo", "y_hi", "x_lo", "x_hi", "y_in", "x_in", "y_out")
    kid = F.struct("edge", "y", "x", "y2", "x2")
    parts = edges.select(
        *keys, F.col("edge").alias("block"), kid.alias("kid"),
        F.least("y", "y2").alias("y_lo"), F.greatest("y", "y2").alias("y_hi"),
        F.least("x", "x2").alias("x_lo"), F.greatest("x", "x2").alias("x_hi"),
        F.col("y").alias("y_in"), F.col("x").alias("x_in"), F.col("y2").alias("y_out"),
    )
    most, out = edges.agg(F.max("edge")).first()[0] or 0, []
    while not out or most > 0:
        most //= FAN
        nodes = parts.groupBy(*keys, F.floor(F.col("block") / FAN).cast("long").alias("_up")).agg(
            F.collect_list("kid").alias("kids"),
            *[F.min(c).alias(c) for c in ("y_lo", "x_lo")],
            *[F.max(c).alias(c) for c in ("y_hi", "x_hi")],
            *[F.min_by(c, "block").alias(c) for c in ("y_in", "x_in")],
            F.max_by("y_out", "block").alias("y_out"),
        ).withColumnRenamed("_up", "block")
        out.append(nodes.select(*keys, "block", "kids"))
        parts = nodes.select(*keys, "block", F.struct("block", *box).alias("kid"), *box)
    return out[::-1]


# Points of a closed curve that a task holds whole; longer curves are searched from coarse stretches.
WHOLE = 4_096
# Points that meet one copy of a curve; a curve with more is copied, so that they spread over tasks.
MEET = 100_000
# Pairs of a point and an edge that are held at once.
PAIRS = 500_000


def _facing(
    points: DataFrame, curve: DataFrame, keys: Sequence[str], measure: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]],
    found: dict[str, str], lonely: bool, crowd: DataFrame | None = None, meet: int = MEET,
) -> DataFrame:
    """``points`` with the columns ``found`` that ``measure`` gives for them and the closed curve of their key.

    A task reads a curve in order and then its points, batch by batch.  ``measure`` gets points and corners as rows y, x, or
    no corners if ``lonely``, which keeps the points without a curve.  ``crowd`` has the keys of the points, where counting
    those themselves costs more.
    """
    keys = list(keys)
    crowd = points if crowd is None else crowd
    copies = cut(crowd.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > meet).select(*keys, F.ceil(F.col("_n") / meet).cast("int").alias("_copies")))
    extra = [c for c in points.columns if c not in (*keys, "py", "px")]
    kinds = dict(points.dtypes)
    corners = curve.dropna(subset=keys).select(*keys, F.col("idx").cast("long").alias("_at"), *[F.col(c).cast("double").alias(c) for c in ("y", "x")])
    spots = points.select(*keys, *extra, *[F.col(f"p{c}").cast("double").alias(c) for c in ("y", "x")])
    if copies.isEmpty():
        corners, spots = corners.withColumn("_copy", F.lit(0)), spots.withColumn("_copy", F.lit(0))
    else:
        many = F.coalesce("_copies", F.lit(1))
        corners = corners.join(copies, keys, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), many - 1))).drop("_copies")
        spots = spots.join(copies, keys, "left").withColumn("_copy", F.pmod(F.xxhash64(*extra, "y", "x"), many).cast("int")).drop("_copies")
    group = [*keys, "_copy"]
    one = corners.select(*group, F.lit(0).alias("_kind"), "_at", "y", "x", *[F.lit(None).cast(kinds[c]).alias(c) for c in extra])
    two = spots.select(*group, F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_at"), "y", "x", *extra)
    dealt_ = one.unionByName(two).repartition(*group).sortWithinPartitions(*group, "_kind", "_at")
    kept = [*keys, *extra, "y", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ring = None, []
        for batch in batches:
            opens = np.flatnonzero(starts(batch, group)).tolist()
            kind = batch.column("_kind").to_numpy()
            spot = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "x")])
            where, parts = [], []
            for a, b in zip(opens, [*opens[1:], batch.num_rows]):
                name = tuple(batch.column(c)[a].as_py() for c in group)
                if name != held:
                    held, ring = name, []
                split = a + int(np.searchsorted(kind[a:b], 1))
                if split > a:
                    ring.append(spot[a:split])
                if split == b or not (ring or lonely):
                    continue
                ring = [np.concatenate(ring)] if ring else []
                corner = ring[0] if ring else np.empty((0, 2))
                step = max(1, PAIRS // max(1, len(corner)))
                for at in range(split, b, step):
                    stop = min(at + step, b)
                    where.append(np.arange(at, stop))
                    parts.append(measure(spot[at:stop], corner))
            if where:
                rows = batch.select(kept).take(pa.array(np.concatenate(where)))
                values = [np.concatenate([p[c] for p in parts]) for c in found]
                # what cannot be measured for want of a coordinate is null
                arrays = [pa.array(v, mask=None if v.dtype == bool else np.isnan(v)) for v in values]
                arrays = [v.cast(pa.int64()) if found[c] == "long" else v for c, v in zip(found, arrays)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *arrays], [*kept, *found])

    made = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*keys, *extra]], "y double", "x double", *[f"{c} {t}" for c, t in found.items()]])
    out = dealt_.mapInArrow(run, made).withColumnsRenamed({"y": "py", "x": "px"})
    return out.select(*points.columns, *found)


def _split(curve: DataFrame, keys: Sequence[str], whole: int) -> DataFrame | None:
    """Keys of the curves that no task may hold whole, if there are any."""
    long = cut(curve.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > whole).select(*keys))
    return None if long.isEmpty() else long


def _by_length(points: DataFrame, curve: DataFrame, keys: Sequence[str], whole: int, near: Callable, far: Callable) -> DataFrame:
    """``near`` for curves of up to ``whole`` points, ``far`` for longer ones."""
    keys, long = list(keys), _split(curve, keys, whole)
    if long is None:
        return near(points, curve)
    rest = near(points.join(long, keys, "left_anti"), curve.join(long, keys, "left_anti"))
    return rest.unionByName(far(points.join(long, keys, "left_semi"), curve.join(long, keys, "left_semi")))


def _round9(v: np.ndarray) -> np.ndarray:
    """Half away from zero to nine digits, for values of at least 0."""
    scaled = v * 1e9
    low = np.floor(scaled)
    return (low + (scaled - low >= 0.5)) / 1e9


def _closest(spot: np.ndarray, corner: np.ndarray) -> dict[str, np.ndarray]:
    """Place on the closed curve through ``corner`` that is closest to each spot; the first edge wins ties to nine digits."""
    py, px = spot[:, :1], spot[:, 1:]
    y, x = corner[:, 0], corner[:, 1]
    dy, dx = np.roll(y, -1) - y, np.roll(x, -1) - x
    len2 = dy * dy + dx * dx
    with np.errstate(all="ignore"):
        t = np.where(len2 > 0, np.clip(((py - y) * dy + (px - x) * dx) / len2, 0.0, 1.0), 0.0)
        near_y, near_x = y + t * dy, x + t * dx
        dist = np.sqrt((py - near_y) * (py - near_y) + (px - near_x) * (px - near_x))
    known = np.where(np.isnan(dist), np.inf, dist)
    rows = np.arange(len(spot))
    edge = np.argmin(_round9(known), axis=1)
    least = known.min(axis=1)
    lost = np.isinf(least)
    out = {"dist": least, "edge": edge.astype(float), "t": t[rows, edge], "near_y": near_y[rows, edge], "near_x": near_x[rows, edge]}
    return {c: np.where(lost, np.nan, v) for c, v in out.items()}


def _odd_crossings(spot: np.ndarray, corner: np.ndarray) -> dict[str, np.ndarray]:
    """Whether a ray in x from each spot cuts the closed curve through ``corner`` an odd number of times."""
    py, px = spot[:, :1], spot[:, 1:]
    y, x = corner[:, 0], corner[:, 1]
    y2, x2 = np.roll(y, -1), np.roll(x, -1)
    with np.errstate(all="ignore"):
        at = (x2 - x) * (py - y) / (y2 - y) + x
        cuts = ((y > py) != (y2 > py)) & (px < at)
    return {"inside": cuts.sum(axis=1) % 2 == 1}


CLOSEST = {"dist": "double", "edge": "long", "t": "double", "near_y": "double", "near_x": "double"}


def nearest_on_curve(
    a: DataFrame, b: DataFrame, keys: Sequence[str], whole: int = WHOLE, crowd: DataFrame | None = None, meet: int = MEET
) -> DataFrame:
    """Closest place on curve B for every point of curve A, exactly; the first edge wins ties to nine digits.

    Curves B of up to ``whole`` points are held by a task while their points pass, longer ones are searched by levels.
    ``crowd``: see ``_facing``.
    """
    places = a.select(*keys, "idx", F.col("y").alias("py"), F.col("x").alias("px"))

    def near(points: DataFrame, curve: DataFrame) -> DataFrame:
        return _facing(points, curve, keys, _closest, CLOSEST, False, crowd, meet)

    def far(points: DataFrame, curve: DataFrame) -> DataFrame:
        return _nearest_by_levels(points.withColumnsRenamed({"py": "y", "px": "x"}), curve, keys)

    return _by_length(places, b, keys, whole, near, far)


def _nearest_by_levels(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``nearest_on_curve`` from coarse stretches to single edges.

    A stretch of edges is at least as far as its bounding box and at most as far as its first place.  A point opens only
    the stretches whose box is not beyond the smallest such upper bound it has seen, so its work grows with the logarithm
    of the curve.
    """
    edges = closed_edges(b, keys)
    point = [*keys, "idx", "py", "px"]
    py, px = F.col("py"), F.col("px")
    rows = a.select(
        *keys, "idx", F.col("y").alias("py"), F.col("x").alias("px"), F.lit(0).cast("long").alias("block"), F.lit(float("inf")).alias("most")
    )
    *upper, leaves = _levels(edges, keys)
    for nodes in upper:
        def least(k: Column) -> Column:
            return magnitude(
                F.greatest(k["y_lo"] - py, py - k["y_hi"], F.lit(0.0)), F.greatest(k["x_lo"] - px, px - k["x_hi"], F.lit(0.0))
            )

        first = F.array_min(F.transform("kids", lambda k: magnitude(py - k["y_in"], px - k["x_in"])))
        met = rows.join(nodes, [*keys, "block"]).withColumn("most", F.least("most", first))
        # a hair of slack keeps edges that tie to nine digits
        opened = F.filter("kids", lambda k: least(k) <= F.col("most") + 1e-8)
        rows = met.select(*point, "most", F.explode(F.transform(opened, lambda k: k["block"])).alias("block"))

    edge = rows.join(leaves, [*keys, "block"]).select(*point, F.inline("kids"))
    dy, dx = F.col("y2") - F.col("y"), F.col("x2") - F.col("x")
    len2 = dy * dy + dx * dx
    t = F.when(len2 > 0, clip(((py - F.col("y")) * dy + (px - F.col("x")) * dx) / len2, 0.0, 1.0)).otherwise(F.lit(0.0))
    placed = edge.withColumn("t", t).withColumn("near_y", F.col("y") + F.col("t") * dy).withColumn("near_x", F.col("x") + F.col("t") * dx)
    dist = magnitude(py - F.col("near_y"), px - F.col("near_x"))
    found = placed.select(*point, "edge", "t", "near_y", "near_x", dist.alias("dist"))
    best = found.groupBy(*point).agg(
        F.min("dist").alias("dist"), F.min(F.struct(F.round("dist", 9).alias("about"), "edge", "t", "near_y", "near_x")).alias("_best")
    )
    return best.select(*point, "dist", *[f"_best.{c}" for c in ("edge", "t", "near_y", "near_x")])


def point_in_polygon(
    points: DataFrame, polygon: DataFrame, keys: Sequence[str], whole: int = WHOLE, crowd: DataFrame | None = None, meet: int = MEET
) -> DataFrame:
    """Even-odd test by the crossings of a ray in x.

    ``points`` has ``idx, py, px``; ``polygon`` is a closed curve.  Polygons of up to ``whole`` points are held by a task
    while their points pass, longer ones are searched by levels.  ``crowd``: see ``_facing``.
    """

    def near(spots: DataFrame, curve: DataFrame) -> DataFrame:
        return _facing(spots, curve, keys, _odd_crossings, {"inside": "boolean"}, True, crowd, meet)

    return _by_length(points, polygon, keys, whole, near, lambda spots, curve: _inside_by_levels(spots, curve, keys))


def _inside_by_levels(points: DataFrame, polygon: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``point_in_polygon`` from coarse stretches of the polygon to single edges.

    A stretch whose box lies beyond the point in x crosses the ray an odd number of times exactly if its ends lie on
    different sides of it, and one whose box misses the ray never does, so only stretches around the point are opened.
    """
    py, px = F.col("py"), F.col("px")
    # what is settled goes on in a row of its own, which keeps each point to the end; its number meets no stretch
    settled = (F.lit(-1) - F.pmod(F.xxhash64("idx", "py", "px"), F.lit(4096))).cast("long")
    rows = points.select(*points.columns, F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("odd"))
    *upper, leaves = _levels(closed_edges(polygon, keys), keys)

    def count(test) -> Column:
        return F.coalesce(F.size(F.filter("kids", test)).cast("long"), F.lit(0).cast("long"))

    for nodes in upper:
        def around(k: Column) -> Column:
            return (k["y_lo"] <= py) & (py <= k["y_hi"])

        def crossed(k: Column) -> Column:
            return around(k) & (k["x_lo"] > px) & ((k["y_in"] > py) != (k["y_out"] > py))

        def inside(k: Column) -> Column:
            return around(k) & (k["x_lo"] <= px) & (px <= k["x_hi"])

        odd = F.col("odd") + count(crossed)
        opened = F.transform(F.filter("kids", inside), lambda k: F.struct(k["block"].alias("block"), F.lit(0).cast("long").alias("odd")))
        rest = F.array(F.struct(settled.alias("block"), odd.alias("odd")))
        met = rows.join(nodes, [*keys, "block"], "left")
        rows = met.select(*points.columns, F.explode(F.concat(F.coalesce(opened, F.array()), rest)).alias("_r")).select(*points.columns, "_r.*")

    def cut_by_ray(e: Column) -> Column:
        at = (e["x2"] - e["x"]) * (py - e["y"]) / (e["y2"] - e["y"]) + e["x"]
        return ((e["y"] > py) != (e["y2"] > py)) & (px < at)

    last = rows.join(leaves, [*keys, "block"], "left").select(*points.columns, (F.col("odd") + count(cut_by_ray)).alias("odd"))
    return last.groupBy(*points.columns).agg((F.sum("odd") % 2 == 1).alias("inside"))


def signed_distance(
    a: DataFrame, b: DataFrame, keys: Sequence[str], polygon: DataFrame | None = None, px_nm: float = PIXEL_NM, n: int | None = None
) -> DataFrame:
    """Distance from curve A to curve B in nm, positive where B's nearest place lies inside A.

    Measured from every point of A, or from ``n`` places at equal arc lengths that include both ends.  ``polygon`` is
    curve A where ``a`` holds only samples of it.
    """
    polygon = a if polygon is None else polygon
    places = a if n is None else resample(a, keys, n=n)
    # places of a fixed number need not be made to be counted
    crowd = places if n is None or n > MEET else a
    near = nearest_on_curve(places, b, keys, crowd=crowd)
    spots = near.select(*keys, "idx", "dist", F.col("near_y").alias("py"), F.col("near_x").alias("px"))
    sided = point_in_polygon(spots, polygon, keys, crowd=crowd)
    sign = F.when(F.col("inside"), F.lit(1.0)).otherwise(F.lit(-1.0))
    return sided.select(*keys, "idx", (F.col("dist") * sign * px_nm).alias("dist_nm"))


# ---- data and bridge stretches ------------------------------------------------------------


def segment_type(points: DataFrame, ranges: DataFrame, keys: Sequence[str], name: str = "kind", bins: int = 64) -> DataFrame:
    """Kind of stretch a parameter falls on: data first, then bridge, else NULL; ranges include both ends.

    ``points`` has ``idx, u``; ``ranges`` has ``kind, u_start, u_end``.  Parameters are binned for an equi-join.
    """
    u = F.pmod(F.col("u"), F.lit(1.0))
    placed = points.withColumn("_u", u).withColumn("_bin", F.floor(F.col("_u") * bins).cast("long"))
    spans = ranges.select(
        *keys,
        F.when(F.col("kind") == "data", 0).otherwise(1).alias("_rank"),
        "u_start",
        "u_end",
        F.explode(
            F.sequence(F.floor(F.col("u_start") * bins).cast("long"), F.floor(F.col("u_end") * bins).cast("long"))
        ).alias("_bin"),
    )
    on = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in [*keys, "_bin"]]
    within = (F.col("p._u") >= F.col("r.u_start")) & (F.col("p._u") <= F.col("r.u_end"))
    met = placed.alias("p").join(spans.alias("r"), [*on, within], "left")
    found = met.groupBy(*[F.col(f"p.{c}") for c in points.columns]).agg(F.min("r._rank").alias("_rank"))
    kind = F.when(F.col("_rank") == 0, "data").when(F.col("_rank") == 1, "bridge")
    return found.select(*points.columns, kind.alias(name))


def pair_type(t1: str, t2: str) -> Column:
    """Name of the combination of both curves' stretches."""
    known = F.col(t1).isNotNull() & F.col(t2).isNotNull()
    return F.when(known, F.concat_ws("_", t1, t2)).otherwise(F.lit("unknown"))


def islands(flags: DataFrame, keys: Sequence[str], flag: str = "flag", inclusive: bool = True) -> DataFrame:
    """Maximal runs of true values over a dense index."""
    near = neighbours(flags, keys, "idx", [flag])
    opens = F.col(flag) & ~F.coalesce(F.col(f"{flag}_prev"), F.lit(False))
    numbered = running_sum(near.withColumn("_open", opens.cast("long")), keys, "idx", "_open", "run")
    runs = numbered.filter(F.col(flag)).groupBy(*keys, "run").agg(
        F.min("idx").alias("start"), (F.max("idx") + (0 if inclusive else 1)).alias("stop")
    )
    return runs


def u_ranges(values: DataFrame, keys: Sequence[str], u: str = "u", gap: float = 0.05, tie: Sequence[str] = ()) -> DataFrame:
    """Ranges of sorted curve parameters, split at gaps; the last joins the first across the seam.

    Curves with fewer than two values have none.
    """
    ordered = positions(values.select(*keys, u, *tie), keys, [u, *tie], "idx")
    near = neighbours(ordered, keys, "idx", [u])
    split = F.coalesce((F.round(F.col(u) - F.col(f"{u}_prev"), 9) > gap).cast("long"), F.lit(0))
    numbered = running_sum(near.withColumn("_new", split), keys, "idx", "_new", "run")
    runs = numbered.groupBy(*keys, "run").agg(
        F.min(u).alias("u_start"), F.max(u).alias("u_end"), F.count("*").alias("_n")
    )
    ends = runs.groupBy(*keys).agg(
        F.sum("_n").alias("_values"),
        F.max("run").alias("_last"),
        F.min("u_start").alias("_first_u"),
        F.max("u_end").alias("_last_u"),
        F.max(F.when(F.col("run") == 0, F.col("u_end"))).alias("_first_end"),
    )
    joined = runs.join(ends, list(keys)).filter("_values >= 2")
    seam = (F.round(F.lit(1.0) - F.col("_last_u") + F.col("_first_u"), 9) <= gap) & (F.col("_last") > 0)
    return joined.filter(~(seam & (F.col("run") == 0))).select(
        *keys,
        "u_start",
        F.when(seam & (F.col("run") == F.col("_last")), F.col("_first_end")).otherwise(F.col("u_end")).alias("u_end"),
    )


def interp_drift(bins: DataFrame, keys: Sequence[str], frames: DataFrame) -> DataFrame:
    """Drift per frame, linear between bin centres; the end stretches go on beyond the outer centres.

    ``bins`` has a dense ``idx``, ``center, dy, dx``; ``frames`` has the number of frames in ``size`` per key.
    """
    near = neighbours(bins, keys, "idx", ["center", "dy", "dx"]).join(frames, list(keys))
    first, only = F.col("center_prev").isNull(), F.col("center_next").isNull()
    ends = near.groupBy(*keys).agg(F.max("idx").alias("_last"))
    near = near.join(ends, list(keys)).filter(~only | (F.col("_last") == 0))
    start = F.when(first, F.lit(0)).otherwise(F.ceil("center").cast("long"))
    final = F.col("idx") >= F.col("_last") - 1
    stop = F.when(final, F.col("size") - 1).otherwise(F.ceil("center_next").cast("long") - 1)
    spread = near.filter(start <= stop).select("*", F.explode(F.sequence(start, stop)).alias("frame"))
    part = (F.col("frame") - F.col("center")) / (F.col("center_next") - F.col("center"))

    def at(c: str) -> Column:
        return (F.col(c) + F.coalesce(part * (F.col(f"{c}_next") - F.col(c)), F.lit(0.0))).alias(c)

    return spread.select(*keys, F.col("frame").cast("long").alias("frame"), at("dy"), at("dx"))


# Rows beyond a tile that its cubic pieces are solved with: a knot's pull on the bends of its neighbours at least halves
# with every knot, so what lies further changes them by less than 2**-64 of itself.
BEND_HALO = 64


def _bends(rows: pa.Table, keys: Sequence[str], values: Sequence[str]) -> pa.Table:
    """Cubic pieces that start at a tile's own knots: second derivatives at both ends, and the next knot."""
    rows = rows.sort_by("idx")
    t = rows.column("center").to_numpy().astype(float)
    v = np.column_stack([rows.column(c).to_numpy().astype(float) for c in values])
    n = len(t)
    bend = np.zeros_like(v)
    if n > 2:
        h, slope = np.diff(t), np.diff(v, axis=0) / np.diff(t)[:, None]
        middle, right = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope, axis=0)
        # forward elimination and back substitution of the three-banded system, bends of 0 at both ends
        for i in range(1, n - 2):
            share = h[i] / middle[i - 1]
            middle[i] -= share * h[i]
            right[i] -= share * right[i - 1]
        for i in range(n - 3, -1, -1):
            bend[i + 1] = (right[i] - h[i + 1] * bend[i + 2]) / middle[i]
    at = np.flatnonzero(rows.column("_own").to_numpy(zero_copy_only=False))
    after = np.minimum(at + 1, n - 1)
    last = at == n - 1
    out = rows.select([*keys, "idx", "center", *values]).take(pa.array(at))
    out = out.append_column("center_next", pa.array(t[after], pa.float64(), mask=last))
    for k, c in enumerate(values):
        out = out.append_column(f"{c}_next", pa.array(v[after, k]))
        out = out.append_column(f"{c}_bend", pa.array(bend[at, k]))
        out = out.append_column(f"{c}_bend_next", pa.array(bend[after, k]))
    return out


def smooth_drift(bins: DataFrame, keys: Sequence[str], frames: DataFrame, tile: int = 4096) -> DataFrame:
    """Drift per frame on the natural cubic through the bin centres; its end pieces go on beyond the outer centres.

    Same input as :func:`interp_drift`.  Bends are solved tile by tile with a border on both sides, so no list of bins ever
    lies in one task; two bins give a line, one a constant.
    """
    keys, values = list(keys), ["dy", "dx"]
    known = bins.select(*keys, "idx", F.col("center").cast("double").alias("center"), *[F.col(c).cast("double").alias(c) for c in values])
    cut_ = tiles(known, keys, "idx", BEND_HALO, tile)
    kinds = dict(known.dtypes)
    made = ", ".join(
        [f"`{c}` {kinds[c]}" for c in [*keys, "idx", "center", *values]]
        + ["center_next double"]
        + [f"{c}_{n} double" for c in values for n in ("next", "bend", "bend_next")]
    )
    pieces = cut_.groupBy(*keys, "_tile").applyInArrow(lambda rows: _bends(rows, keys, values), made)
    ends = known.groupBy(*keys).agg(F.max("idx").alias("_last"))
    near = pieces.join(ends, keys).join(frames, keys).filter(F.col("center_next").isNotNull() | (F.col("_last") == 0))
    start = F.when(F.col("idx") == 0, F.lit(0)).otherwise(F.ceil("center").cast("long"))
    stop = F.when(F.col("idx") >= F.col("_last") - 1, F.col("size") - 1).otherwise(F.ceil("center_next").cast("long") - 1)
    spread = near.filter(start <= stop).select("*", F.explode(F.sequence(start, stop)).alias("frame"))
    h, a, b = F.col("center_next") - F.col("center"), F.col("center_next") - F.col("frame"), F.col("frame") - F.col("center")

    def at(c: str) -> Column:
        one, two = F.col(f"{c}_bend"), F.col(f"{c}_bend_next")
        line = (F.col(c) / h - one * h / 6.0) * a + (F.col(f"{c}_next") / h - two * h / 6.0) * b
        return F.coalesce((one * a * a * a + two * b * b * b) / (h * 6.0) + line, F.col(c)).alias(c)

    return spread.select(*keys, F.col("frame").cast("long").alias("frame"), at("dy"), at("dx"))
