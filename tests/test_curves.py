"""Curves: islands, ranges over the seam, trimming, bends, distances, polygons."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from perinuc.functions import scalars as sc
from perinuc.operators import bridging as br
from perinuc.operators import curves as cv

SEG = "fov_id string, channel string, ne_label string, segment string, idx long, y double, x double"
K = ["g"]


def circle(n, r, cy=50.0, cx=50.0, start=0.0):
    return [(i, cy + r * math.sin(start + 2 * math.pi * i / n), cx + r * math.cos(start + 2 * math.pi * i / n)) for i in range(n)]


def points(spark, rows, g="a"):
    return spark.createDataFrame([(g, *r) for r in rows], "g string, idx long, y double, x double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(flags=hs.lists(hs.booleans(), min_size=1, max_size=40))
def test_islands_cover_exactly_the_true_flags(spark, flags):
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate(flags)], "g string, idx long, flag boolean")
    runs = cv.islands(df, K).collect()
    covered = [i for r in runs for i in range(r.start, r.stop + 1)]
    assert sorted(covered) == [i for i, f in enumerate(flags) if f]


def test_u_ranges_wrap_and_need_two_values(spark):
    rows = [("a", 0.01), ("a", 0.02), ("a", 0.5), ("a", 0.52), ("a", 0.98), ("b", 0.3)]
    df = spark.createDataFrame(rows, "g string, u double")
    got = sorted((r.u_start, r.u_end) for r in cv.u_ranges(df, K).collect())
    assert got == [(0.5, 0.52), (0.98, 0.02)]


def test_resample_is_even_and_hits_both_ends(spark):
    line = points(spark, [(0, 0.0, 0.0), (1, 0.0, 1.0), (2, 0.0, 4.0)])
    got = cv.resample(line, K, n=5).orderBy("idx").collect()
    assert [r.x for r in got] == pytest.approx([0, 1, 2, 3, 4])


def test_tangents_and_curvature_of_a_circle(spark):
    c = points(spark, circle(200, 20.0))
    inner = [r.curvature for r in cv.curvature(c, K).collect() if r.curvature is not None]
    assert np.allclose(inner, 1 / 20.0, rtol=1e-3)


def test_bend_filter_marks_both_sides_of_a_corner(spark):
    corner = points(spark, [(i, 0.0, float(i)) for i in range(5)] + [(5 + i, float(i + 1), 4.0) for i in range(5)])
    bad = [r.idx for r in cv.bend_filter(corner, K, max_deg=10.0).collect() if not r.valid]
    assert sorted(bad) == [3, 4, 5]


def test_bend_filter_over_tile_borders(spark):
    c = points(spark, [(i, y + (i % 7) * 0.2, x) for i, y, x in circle(90, 20.0)])
    whole = {r.idx: (r.valid, r.bend_next) for r in cv.bend_filter(c, K, 5.0).collect()}
    tiled = {r.idx: (r.valid, r.bend_next) for r in cv.bend_filter(c, K, 5.0, tile=8).collect()}
    assert whole == tiled


def test_similarity_and_its_inverse(spark):
    df = points(spark, circle(10, 7.0))
    y, x = sc.similarity("y", "x", F.lit(1.1), F.lit(0.3), F.lit(0.0), F.lit(0.0), F.lit(50.0), F.lit(50.0))
    moved = df.select("idx", F.col("y").alias("oy"), F.col("x").alias("ox"), y.alias("y"), x.alias("x"))
    y, x = sc.similarity("y", "x", F.lit(1 / 1.1), F.lit(-0.3), F.lit(0.0), F.lit(0.0), F.lit(50.0), F.lit(50.0))
    back = moved.select("oy", "ox", y.alias("y"), x.alias("x")).collect()
    assert all(abs(r.y - r.oy) < 1e-9 and abs(r.x - r.ox) < 1e-9 for r in back)


@pytest.mark.parametrize("shift", [0.0, 2.5, 40.0])
def test_nearest_on_curve_equals_brute_force(spark, shift):
    """Also for curves far apart, which need several rounds."""
    a, b = circle(30, 20.0), circle(47, 20.8, cy=50.0 + shift, start=0.2)
    got = {r.idx: r.dist for r in cv.nearest_on_curve(points(spark, a), points(spark, b), K).collect()}
    pts = np.array([p[1:] for p in b])
    ends = np.roll(pts, -1, axis=0) - pts
    for i, y, x in a:
        t = np.clip(((np.array([y, x]) - pts) * ends).sum(1) / (ends**2).sum(1), 0, 1)
        want = np.sqrt(((pts + t[:, None] * ends - [y, x]) ** 2).sum(1)).min()
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert len(got) == 30


def test_signed_distance_is_positive_towards_the_inside(spark):
    outer, inner = points(spark, circle(80, 20.0)), points(spark, circle(80, 18.0))
    assert all(r.dist_nm > 200 for r in cv.signed_distance(outer, inner, K).collect())
    assert all(r.dist_nm < -200 for r in cv.signed_distance(inner, outer, K).collect())


def test_segment_type_prefers_data_and_includes_ends(spark):
    u = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 0.25, 0.4, 0.5, 0.99, 1.25])], "g string, idx long, u double")
    r = spark.createDataFrame([("a", "data", 0.0, 0.25), ("a", "bridge", 0.25, 0.5)], "g string, kind string, u_start double, u_end double")
    got = {x.idx: x.kind for x in cv.segment_type(u, r, K).collect()}
    assert got == {0: "data", 1: "data", 2: "bridge", 3: "bridge", 4: None, 5: "data"}


def test_trim_drops_short_segments_and_keeps_untrimmed(spark):
    rows = [("1", "ch1", n, "segment_00", i, 0.0, float(i)) for n, m in (("long", 6), ("short", 3), ("raw", 3)) for i in range(m)]
    trims = spark.createDataFrame([("1", "ch1", "long", 1.5), ("1", "ch1", "short", 1.0), ("1", "ch1", "raw", 0.0)], "fov_id string, channel string, ne_label string, trim double")
    got = {}
    for r in br.trim_ends(spark.createDataFrame(rows, SEG), trims).collect():
        got.setdefault(r.ne_label, []).append((r.idx, r.x))
    assert sorted(got["long"]) == [(0, 1.5), (1, 2.0), (2, 3.0), (3, 3.5)]
    assert sorted(got["raw"]) == [(0, 0.0), (1, 1.0), (2, 2.0)]
    assert "short" not in got


def test_single_segment_is_closed_onto_itself(spark):
    arc = [(i, 50 + 20 * math.sin(a), 50 + 20 * math.cos(a)) for i, a in enumerate(np.linspace(0, 1.9 * math.pi, 400))]
    rows = [("1", "ch1", "a", "segment_00", i, float(y), float(x)) for i, y, x in arc]
    trims = spark.createDataFrame([("1", "ch1", "a", 0.0)], "fov_id string, channel string, ne_label string, trim double")
    bridges, ranges = br.bridge(spark.createDataFrame(rows, SEG), trims, max_deg=3.0)
    assert bridges.count() == 50
    got = {r.kind: (r.u_start, r.u_end) for r in ranges.collect()}
    assert got["data"][0] == 0.0 and got["bridge"][1] == pytest.approx(1.0) and got["data"][1] == pytest.approx(0.95, abs=0.01)


def test_drift_interpolation_goes_beyond_the_outer_bins(spark):
    bins = spark.createDataFrame([("a", 0, 2.0, 0.0, 0.0), ("a", 1, 6.0, 4.0, -4.0), ("b", 0, 1.0, 7.0, 7.0)], "g string, idx long, center double, dy double, dx double")
    size = spark.createDataFrame([("a", 8), ("b", 2)], "g string, size long")
    got = {(r.g, r.frame): r.dy for r in cv.interp_drift(bins, K, size).collect()}
    assert [got["a", f] for f in range(8)] == pytest.approx([f - 2.0 for f in range(8)])
    assert [got["b", f] for f in range(2)] == [7.0, 7.0]


def test_nearest_places_need_few_candidates_whatever_the_length(spark):
    """Two outlines side by side: candidates per point grow with the levels, not with the points."""
    per_point = []
    for n in (1000, 8000):
        turn = F.col("id") * (2 * math.pi / n)
        ring = spark.range(n).select(F.lit("f").alias("fov_id"), F.lit("ch1").alias("channel"), F.lit("n").alias("ne_label"), F.col("id").alias("idx"), (F.sin(turn) * 20).alias("y"), (F.cos(turn) * 20).alias("x"))
        outer = ring.withColumn("y", F.col("y") * 1.04).withColumn("x", F.col("x") * 1.04)
        *upper, leaves = cv._levels(cv.closed_edges(outer, cv.CURVE), cv.CURVE)
        tables = [{r.block: r.kids for r in t.collect()} for t in upper]
        seen = 0
        for i in range(0, n, n // 50):
            p = (20 * math.sin(i * 2 * math.pi / n), 20 * math.cos(i * 2 * math.pi / n))
            opened = [(0, math.inf)]
            for table in tables:
                after = []
                for block, most in opened:
                    most = min([most, *(math.dist(p, (k.y_in, k.x_in)) for k in table[block])])
                    beside = [(math.hypot(max(k.y_lo - p[0], p[0] - k.y_hi, 0), max(k.x_lo - p[1], p[1] - k.x_hi, 0)), k.block) for k in table[block]]
                    after += [(b, most) for d, b in beside if d <= most + 1e-8]
                opened = after
                seen += cv.FAN * len(opened)
        per_point.append(seen / 50)
    assert per_point[1] < 2.5 * per_point[0] and per_point[1] < 400


def test_points_in_a_flat_outline(spark):
    """All edges in one horizontal strip."""
    n = 600
    flat = [(k * 0.01, 1e-3 * math.sin(k)) for k in range(n)] + [(k * 0.01, 0.1) for k in range(n - 1, -1, -1)]
    ring = spark.createDataFrame([("f", "ch1", "n", k, y, x) for k, (x, y) in enumerate(flat)], "fov_id string, channel string, ne_label string, idx long, y double, x double")
    spots = [(k, 0.05 if k % 2 else 0.2, 0.005 + 0.013 * k) for k in range(450)]
    places = spark.createDataFrame([("f", "ch1", "n", *s) for s in spots], "fov_id string, channel string, ne_label string, idx long, py double, px double")
    got = {r.idx: r.inside for r in cv.point_in_polygon(places, ring, cv.CURVE).collect()}
    assert got == {k: bool(k % 2 and x < (n - 1) * 0.01) for k, _, x in spots}


def test_angular_order_adds_up_in_the_order_of_the_points(spark):
    rows, want = [], set()
    for g in range(60):
        n, r = 2 * g + 24, 20 + g % 5
        curve = [(i, round(37.5 + r * math.sin(2 * math.pi * i / n), 6), round(37.5 + r * math.cos(2 * math.pi * i / n), 6)) for i in range(n)]
        sy = sx = 0.0
        for _, y, x in curve:
            sy, sx = sy + y, sx + x
        angle = {i: math.atan2(y - sy / n, x - sx / n) for i, y, x in curve}
        want |= {(str(g), i, k) for k, i in enumerate(sorted(angle, key=lambda i: (round(angle[i], 9), i)))}
        rows += [(str(g), *p) for p in reversed(curve)]
    found = cv.angular_order(spark.createDataFrame(rows, "g string, idx long, y double, x double").repartition(5), K)
    assert {(x.g, x.idx, x.order) for x in found.collect()} == want


def test_ordered_means_over_tiles(spark):
    from perinuc.scale import ordered_means

    rows = [("a", i, float(i) if i % 3 else None, 2.0) for i in range(50)] + [("b", 0, None, 1.0)]
    found = ordered_means(spark.createDataFrame(rows, "g string, idx long, y double, x double"), K, "idx", ["y", "x"], tile=8)
    known = [i for i in range(50) if i % 3]
    assert {tuple(r) for r in found.collect()} == {("a", sum(known) / len(known), 2.0), ("b", None, 1.0)}


def test_short_curves_are_met_whole_and_long_ones_by_levels(spark):
    """Both ways, and copies of a curve for many points, give the same places; points of no curve are kept by one only."""
    rng = np.random.default_rng(5)
    a = points(spark, circle(60, 20.0)).unionByName(points(spark, circle(25, 9.0), "b")).unionByName(points(spark, [(0, 1.0, 1.0)], "c"))
    b = points(spark, [(i, y + rng.normal(), x + rng.normal()) for i, y, x in circle(50, 19.0)])
    b = b.unionByName(points(spark, circle(7, 9.5), "b"))
    near = {n: sorted(cv.nearest_on_curve(a, b, K, whole=w, meet=m).drop("t").collect()) for n, w, m in (("whole", 99, 99), ("copies", 99, 10), ("mixed", 20, 99), ("levels", 0, 99))}
    assert len(near["whole"]) == 85
    for n in ("copies", "mixed", "levels"):
        assert [r[:3] for r in near[n]] == [r[:3] for r in near["whole"]] and [r.edge for r in near[n]] == [r.edge for r in near["whole"]]
        assert np.allclose([r.dist for r in near[n]], [r.dist for r in near["whole"]], atol=1e-9)
    spots = a.select("g", "idx", F.col("y").alias("py"), (F.col("x") + 0.5).alias("px"))
    sides = [sorted(cv.point_in_polygon(spots, b, K, w, meet=m).collect()) for w, m in ((99, 99), (99, 10), (20, 99), (0, 99))]
    assert sides[0] == sides[1] == sides[2] == sides[3] and len(sides[0]) == 86 and 0 < sum(r.inside for r in sides[0]) < 80


def test_short_curves_need_one_shuffle(spark):
    """Points meet a short curve in one task; no join of points with stretches, level by level."""
    plan = cv.nearest_on_curve(points(spark, circle(60, 20.0)), points(spark, circle(50, 19.0)), K)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_a_point_without_a_coordinate_has_no_distance(spark):
    a = points(spark, [*circle(12, 5.0), (12, None, 1.0)])
    got = {r.idx: (r.dist, r.near_y) for r in cv.nearest_on_curve(a, points(spark, circle(9, 6.0)), K).collect()}
    assert got[12] == (None, None) and all(d is not None for i, (d, _) in got.items() if i < 12) and len(got) == 13
