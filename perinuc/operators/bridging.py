"""Trim refined segments, drop spokes, and close the outline across the gaps."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perinuc.functions.scalars import magnitude
from perinuc.operators.curves import CURVE, SEGMENT
from perinuc.scale import apart, cut, neighbours, per_tile, positions, running_sum, stored

# Trim factor, fallback noise, shortest useful length in trims, smallest gap, bridge shape.
TRIM_SIGMAS = 2.0
DEFAULT_SIGMA = 0.5
MIN_TRIMS = 2.1
SPOKE_LIMIT = 0.6
MIN_GAP_PX = 1.0
BRIDGE_POINTS = 50
TANGENT_SCALE = 0.3


def trim_length(nuclei: DataFrame, label_sigma: DataFrame, fov_sigma: DataFrame, k: float = TRIM_SIGMAS) -> DataFrame:
    """Length to trim per nucleus: its own noise, else its field's, else 0.5, times ``k``."""
    own = label_sigma.select("fov_id", "ne_label", F.col("sigma_reg").alias("_own"))
    field = fov_sigma.select("fov_id", F.col("sigma_reg").alias("_field"))
    sigma = F.coalesce("_own", "_field", F.lit(DEFAULT_SIGMA))
    return (
        nuclei.join(own, ["fov_id", "ne_label"], "left")
        .join(field, "fov_id", "left")
        .select(*nuclei.columns, (sigma * k).alias("trim"))
    )


def trim_ends(points: DataFrame, trims: DataFrame, keys: Sequence[str] = SEGMENT, on: Sequence[str] = CURVE) -> DataFrame:
    """Cut ``trim`` pixels of arc off both ends; segments not longer than 2.1 trims vanish.

    The new end points are interpolated on the edge they fall on.
    """
    near = neighbours(points, keys, "idx", ["y", "x"])

    def step(before: str, after: str) -> Column:
        return magnitude(F.col(f"y{after}") - F.col(f"y{before}"), F.col(f"x{after}") - F.col(f"x{before}"))

    stepped = near.select(
        *keys, "_tile", "idx", "y", "x", "y_next", "x_next", F.coalesce(step("_prev", ""), F.lit(0.0)).alias("step"), step("", "_next").alias("_further"),
    )
    measured = running_sum(stepped, keys, "idx", "step", "cum").withColumn("cum_next", F.col("cum") + F.col("_further"))
    # read for the totals and for the rows
    measured = apart(stored(measured.drop("step", "_further").join(trims, list(on))))
    low = F.greatest(F.col("trim"), F.lit(0.0))
    cut_off = F.col("trim") > 0
    begins = cut_off & (F.col("cum") <= low) & (F.col("cum_next") > low)
    # the edge on which the trimmed segment begins fixes the numbering, so no sort is needed
    totals = measured.groupBy(*keys).agg(F.max("cum").alias("_total"), F.max(F.when(begins, F.col("idx"))).alias("_first"))
    edges = measured.join(totals, list(keys))
    long_enough = (F.col("trim") <= 0) | (F.round("_total", 9) > F.round(MIN_TRIMS * F.col("trim"), 9))
    high = F.col("_total") - low

    def on_edge(s: Column) -> Column:
        part = (s - F.col("cum")) / (F.col("cum_next") - F.col("cum"))
        return F.struct(
            s.alias("s"),
            (F.col("y") + part * (F.col("y_next") - F.col("y"))).alias("y"),
            (F.col("x") + part * (F.col("x_next") - F.col("x"))).alias("x"),
        )

    here = F.struct(F.col("cum").alias("s"), F.col("y"), F.col("x"))
    inside = ~cut_off | ((F.col("cum") > low) & (F.col("cum") < high))
    ends = cut_off & (F.col("cum") < high) & (F.col("cum_next") >= high)
    kept = F.array_compact(
        F.array(F.when(begins, on_edge(low)), F.when(inside, here), F.when(ends, on_edge(high)))
    )
    rows = edges.filter(long_enough).select(
        *keys, "idx", begins.alias("_begins"), cut_off.alias("_cut"), "_first", F.posexplode(kept).alias("_at", "_p")
    )
    base = F.coalesce(F.col("_first"), F.lit(0))
    is_begin = F.col("_begins") & (F.col("_at") == 0)
    is_end = F.col("_cut") & (F.col("_p.s") > F.lit(0)) & ~is_begin & (F.col("_at") > 0)
    idx = F.when(is_begin, F.lit(0)).otherwise(F.col("idx") - base + F.when(is_end, 1).otherwise(0))
    return rows.select(*keys, idx.cast("long").alias("idx"), "_p.y", "_p.x")


def orientation(points: DataFrame, keys: Sequence[str] = SEGMENT, by: Sequence[str] = CURVE) -> DataFrame:
    """How much each segment points at the centre of its nucleus: 0 runs around it, 1 is a spoke."""
    centre = points.groupBy(*by).agg(F.avg("y").alias("_cy"), F.avg("x").alias("_cx"))
    sizes = points.groupBy(*keys).agg(F.max("idx").alias("_last"))
    middle = F.floor(F.col("_last") / 2).cast("long")
    near = points.select(*keys, "idx", "y", "x").join(sizes, list(keys)).filter(F.abs(F.col("idx") - middle) <= 1)

    def at(offset: int, c: str) -> Column:
        return F.max(F.when(F.col("idx") == middle + offset, F.col(c)))

    mids = near.groupBy(*keys).agg(*[at(o, c).alias(f"{c}{n}") for c in ("y", "x") for o, n in ((-1, "_prev"), (0, ""), (1, "_next"))])

    def slope(c: str) -> Column:
        prev, here, nxt = F.col(f"{c}_prev"), F.col(c), F.col(f"{c}_next")
        return F.when(prev.isNull(), nxt - here).when(nxt.isNull(), here - prev).otherwise((nxt - prev) / 2.0)

    ry, rx = F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx")
    radial, along = magnitude(ry, rx) + 1e-6, magnitude(slope("y"), slope("x")) + 1e-6
    dot = (ry / radial) * (slope("y") / along) + (rx / radial) * (slope("x") / along)
    return mids.join(centre, list(by)).select(*keys, F.abs(dot).alias("alignment"))


def orientation_filter(points: DataFrame, limit: float = SPOKE_LIMIT, keys: Sequence[str] = SEGMENT, by: Sequence[str] = CURVE) -> DataFrame:
    """Segments that run around the nucleus rather than towards its centre."""
    good = orientation(points, keys, by).filter(F.round("alignment", 9) < limit).select(*keys)
    return points.join(good, list(keys), "left_semi")


def segment_ends(points: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """First and last point of each segment, with the direction of travel and the arc length.

    The neighbours of the ends and the steps are seen in the tiles, so the points travel once.
    """
    near = neighbours(points.select(*keys, "idx", "y", "x"), keys, "idx", ["idx", "y", "x"])
    step = magnitude(F.col("y") - F.col("y_prev"), F.col("x") - F.col("x_prev"))
    upto = F.sum(F.coalesce(step, F.lit(0.0))).over(per_tile(keys, "idx").rowsBetween(W.unboundedPreceding, 0))
    first, last = F.col("idx") == 0, F.col("idx_next").isNull()

    def only(where: Column, value: Column, name: str) -> Column:
        return F.max(F.when(where, value)).alias(name)

    picked = [only(first, F.col(c), f"start_{c}") for c in ("y", "x")] + [only(F.col("idx") == 1, F.col(c) - F.col(f"{c}_prev"), f"start_t{c}") for c in ("y", "x")]
    picked += [only(last, F.col(c), f"end_{c}") for c in ("y", "x")] + [only(last, F.col(c) - F.col(f"{c}_prev"), f"end_t{c}") for c in ("y", "x")]
    of_tile = near.withColumn("_upto", upto).groupBy(*keys, "_tile").agg(F.max("_upto").alias("_total"), F.max("idx").alias("_last"), *picked)
    totals = F.array_sort(F.collect_list(F.struct("_tile", "_total")))
    tips = [f"{e}_{c}" for e in ("start", "end") for c in ("y", "x", "ty", "tx")]
    ends = of_tile.groupBy(*keys).agg(totals.alias("_totals"), F.max("_last").alias("_last"), *[F.max(c).alias(c) for c in tips])
    length = F.aggregate("_totals", F.lit(0.0), lambda sofar, t: sofar + t["_total"])
    return ends.filter("_last >= 1").select(*keys, length.alias("length"), *tips)


def rank_segments(ends: DataFrame, by: Sequence[str] = CURVE) -> DataFrame:
    """Segments numbered within their nucleus by the number in their name, with the segment count."""
    number = F.element_at(F.split("segment", "_"), -1).cast("int")
    ranked = positions(ends.withColumn("_no", number), by, ["_no", "segment"], "rank").drop("_no")
    sizes = ranked.groupBy(*by).agg(F.count("*").alias("n_segments"))
    return ranked.join(sizes, list(by))


def gaps(ranked: DataFrame, by: Sequence[str] = CURVE) -> DataFrame:
    """Each ranked segment with its successor in number order; the last is followed by the first."""
    before = F.pmod(F.col("rank") - 1, F.col("n_segments")).cast("long")
    following = ranked.select(
        *by, before.alias("rank"), F.col("segment").alias("next_segment"),
        *[F.col(f"start_{c}").alias(f"next_{c}") for c in ("y", "x", "ty", "tx")],
    )
    joined = ranked.join(following, [*by, "rank"])
    gap = magnitude(F.col("next_y") - F.col("end_y"), F.col("next_x") - F.col("end_x"))
    return joined.withColumn("gap", gap)


def _measure(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and largest change of direction, in degrees, of lines of points, one per row."""
    dy, dx = (np.hstack([c[:, 1:2] - c[:, :1], (c[:, 2:] - c[:, :-2]) / 2.0, c[:, -1:] - c[:, -2:-1]]) for c in (y, x))
    turn = np.diff(np.arctan2(dx, dy), axis=1)
    rest = np.fmod(turn + math.pi, 2 * math.pi)
    rest = np.where(rest < 0, np.fmod(rest + 2 * math.pi, 2 * math.pi), rest)
    step = np.sqrt(np.diff(y, axis=1) ** 2 + np.diff(x, axis=1) ** 2)
    # added up in the order of the points
    return np.add.accumulate(step, axis=1)[:, -1], np.abs(np.degrees(rest - math.pi)).max(axis=1)


def bridge_lines(
    ranked: DataFrame, by: Sequence[str] = CURVE, max_deg: float = 1.0, min_gap: float = MIN_GAP_PX, points: bool = False
) -> DataFrame:
    """Gaps of ranked segments with ``max_bend``, ``is_valid`` and ``bridge``, the length of the cubic bridge over them.

    All three are null for gaps below ``min_gap``, which need no bridge.  A single segment is closed onto itself.  A bridge has
    a fixed number of points, so it is drawn and measured in one row; ``points`` adds them as arrays ``y`` and ``x``.
    """
    is_wide = F.coalesce(F.round("gap", 9) >= min_gap, F.lit(False))

    def control(side: str, c: str, sign: float) -> Column:
        size = magnitude(f"{side}_ty", f"{side}_tx")
        return F.col(f"{side}_{c}") + F.lit(sign * TANGENT_SCALE) * F.col("gap") * F.col(f"{side}_t{c}") / size

    corners = [f(c) for c in ("y", "x") for f in (
        lambda c: F.col(f"end_{c}"), lambda c: control("end", c, 1.0), lambda c: control("next", c, -1.0), lambda c: F.col(f"next_{c}"),
    )]
    names = [f"_p{i}" for i in range(8)]
    told = [*by, "segment", "rank", "length", "next_segment", "gap"]
    rows = gaps(ranked, by).withColumn("_wide", is_wide)
    rows = rows.select(*told, "_wide", *[F.when(F.col("_wide"), c).alias(n) for c, n in zip(corners, names)])
    t = np.arange(BRIDGE_POINTS) / float(BRIDGE_POINTS - 1)
    r = 1.0 - t
    weights = (r * r * r, 3.0 * r * r * t, 3.0 * r * t * t, t * t * t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [batch.column(n).to_numpy(zero_copy_only=False)[:, None] for n in names]
            y, x = (sum((w * c for w, c in zip(weights[1:], p[i + 1 : i + 4])), weights[0] * p[i]) for i in (0, 4))
            length, bend = _measure(y, x)
            none = ~batch.column("_wide").to_numpy(zero_copy_only=False)
            out = [*batch.select(told).columns, pa.array(length, mask=none), pa.array(bend, mask=none)]
            if points:
                ends = np.arange(0, y.size + 1, BRIDGE_POINTS, dtype=np.int32)
                out += [pa.ListArray.from_arrays(pa.array(ends), pa.array(c.ravel())) for c in (y, x)]
            yield pa.RecordBatch.from_arrays(out, [*told, "bridge", "max_bend", *(["y", "x"] if points else [])])

    kinds = dict(rows.dtypes)
    made = [*[f"`{c}` {kinds[c]}" for c in told], "bridge double", "max_bend double", *(["y array<double>", "x array<double>"] if points else [])]
    return rows.mapInArrow(run, ", ".join(made)).withColumn("is_valid", F.round("max_bend", 9) <= F.lit(max_deg))


def bridge_gaps(ranked: DataFrame, by: Sequence[str] = CURVE, max_deg: float = 1.0, min_gap: float = MIN_GAP_PX) -> DataFrame:
    """Points of the cubic bridge over every gap of at least ``min_gap``, with the verdict on its bend."""
    lines = bridge_lines(ranked, by, max_deg, min_gap, points=True).filter("max_bend IS NOT NULL")
    told = [*by, "segment", "next_segment", "gap"]
    rows = lines.select(*told, "max_bend", "is_valid", F.posexplode(F.arrays_zip("y", "x")).alias("idx", "_p"))
    return rows.select(*told, F.col("idx").cast("long").alias("idx"), "_p.y", "_p.x", "max_bend", "is_valid")


def parts_of_outline(lines: DataFrame, by: Sequence[str] = CURVE) -> DataFrame:
    """Data and accepted bridge stretches in order around the outline, with their lengths; ``lines`` come from ``bridge_lines``."""
    across = F.when(F.col("is_valid"), F.col("bridge"))
    parts = F.array(
        F.struct((F.col("rank") * 2).alias("idx"), F.lit("data").alias("kind"), F.col("length").alias("length")),
        F.struct((F.col("rank") * 2 + 1).alias("idx"), F.lit("bridge").alias("kind"), F.coalesce(across, F.lit(0.0)).alias("length")),
    )
    return lines.select(*by, F.explode(parts).alias("_p")).select(*by, "_p.*")


def u_range_table(parts: DataFrame, by: Sequence[str] = CURVE) -> DataFrame:
    """Share of the outline that each stretch covers, as a running parameter; ``idx`` must be dense."""
    total = parts.groupBy(*by).agg(F.sum("length").alias("_total"))
    summed = running_sum(parts, by, "idx", "length", "_upto").join(total, list(by)).filter("length > 0")
    return summed.select(
        *by,
        "kind",
        ((F.col("_upto") - F.col("length")) / F.col("_total")).alias("u_start"),
        (F.col("_upto") / F.col("_total")).alias("u_end"),
    )


def bridge(points: DataFrame, trims: DataFrame, max_deg: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Trim, drop spokes, bridge: returns the accepted bridges and the table of stretches.

    The trimmed points and the segment table each feed several later steps, so both are materialised once.
    """
    kept = orientation_filter(apart(stored(trim_ends(points, trims))))
    # numbering reads its rows twice, to choose ranges and to sort
    ranked = cut(rank_segments(cut(segment_ends(kept))))
    bridges = bridge_gaps(ranked, max_deg=max_deg).filter("is_valid")
    return bridges, u_range_table(parts_of_outline(cut(bridge_lines(ranked, max_deg=max_deg))))
