"""Rows are made once and travel once, and the results stay the same."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perinuc import scale as sc
from perinuc.operators import bridging as br
from perinuc.operators import curves as cv
from perinuc.operators import pixels as px
from perinuc.operators import profiles as pf
from perinuc.operators import summary as sm
from perinuc.plans import registry, views

LINES = "fov_id string, i int, y0 double, x0 double, y1 double, x1 double"


def test_lines_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(y):
        seen.add(1)
        return y

    pixels = spark.createDataFrame([("1", y, x, float(10 * y + x)) for y in range(10) for x in range(10)], "fov_id string, y long, x long, value double")
    lines = spark.createDataFrame([("1", i, 1.0 + i, 1.0, 1.5, 4.0) for i in range(9)], LINES)
    counted = F.udf(count, "double").asNondeterministic()
    got = pf.sample_along_normals(pixels, lines.withColumn("y0", counted("y0")), ["fov_id", "i"], 4, 10, 10).collect()
    assert seen.value == 9 and sum(r.valid for r in got) == 28 and sum(not r.valid for r in got) == 2


def test_frames_are_added_up_in_the_block(spark):
    rng = random.Random(1)
    rows = [("1", frame, y, x, rng.randrange(10**6)) for frame in range(4) for y in range(9) for x in range(9)]
    frames = spark.createDataFrame(rows, "fov_id string, frame int, y long, x long, value long")
    lines = spark.createDataFrame([("1", i, rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(0, 6)) for i in range(50)], LINES)
    image = frames.groupBy("fov_id", "y", "x").agg((F.sum("value") / 50.0).alias("value"))
    want = pf.sample_along_normals(image, lines, ["fov_id", "i"], 5, 9, 9)
    got = pf.sample_along_normals(frames, lines, ["fov_id", "i"], 5, 9, 9, gain=50.0)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_numbers_of_short_long_and_null_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 5), (None, 3), (2, 1)) for i in range(n)], "k int, t int")
    want = sorted(((k, i, i, n) for k, n in ((1, 5), (None, 3), (2, 1)) for i in range(n)), key=str)
    for tile in (2, 5):
        monkeypatch.setattr(views, "TILE", tile)
        got = views._numbered(rows, ["k"], ["t"], "idx", "n").select("k", "t", "idx", "n")
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_doubles_round_as_in_sql(spark):
    rng = random.Random(2)
    values = [rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 12) for _ in range(20_000)]
    values += [(2 * rng.randrange(10**12) + 1) / 2e6 for _ in range(5_000)] + [0.0, -0.0, 1e300, -1e305, float("inf"), float("-inf"), None]
    got = registry.rounded(spark.createDataFrame(list(enumerate(values)), "i int, v double")).orderBy("i").collect()
    t = pa.table({"i": list(range(len(values))), "v": pa.array(values, pa.float64())})  # noqa: F841
    want = duckdb.sql(f"SELECT round(v + {registry.NUDGE}, 6) + 0e0 FROM t ORDER BY i").fetchall()
    assert [r.v for r in got] == [w for (w,) in want]


def _arcs(spark, n=40):
    rows = [
        ("1", "ch1", name, f"segment_0{s}", i, round(50 + 20 * math.sin(2.1 * s + 1.7 * i / n) + 0.01 * (i % 3), 6), round(50 + 20 * math.cos(2.1 * s + 1.7 * i / n), 6))
        for name in ("a", "b") for s in range(3 if name == "a" else 1) for i in range(n)
    ]
    return spark.createDataFrame(rows, "fov_id string, channel string, ne_label string, segment string, idx long, y double, x double")


def test_bridges_are_measured_without_a_row_per_point(spark):
    ranked = br.rank_segments(br.segment_ends(_arcs(spark)))
    lines = br.bridge_lines(ranked, max_deg=400.0)
    drawn = br.bridge_gaps(ranked, max_deg=400.0)
    bends = {(r.ne_label, r.segment): r.max_bend for r in cv.largest_bend(drawn.select(*cv.SEGMENT, "idx", "y", "x"), cv.SEGMENT).collect()}
    long = cv.cumulative_length(drawn.select(*cv.SEGMENT, "idx", "y", "x"), cv.SEGMENT).groupBy(*cv.SEGMENT).agg(F.max("cum").alias("length"))
    lengths = {(r.ne_label, r.segment): r.length for r in long.collect()}
    got = {(r.ne_label, r.segment): r for r in lines.collect()}
    assert len(got) == len(bends) == 4 and drawn.count() == 200
    assert {k: r.bridge for k, r in got.items()} == lengths
    assert {k: r.max_bend for k, r in got.items()} == pytest.approx(bends, abs=1e-9)
    assert "Generate" not in lines._jdf.queryExecution().toString()


def test_narrow_gaps_need_no_bridge(spark):
    ranked = br.rank_segments(br.segment_ends(_arcs(spark)))
    lines = br.bridge_lines(ranked, min_gap=1e6)
    assert [(r.bridge, r.max_bend, r.is_valid) for r in lines.collect()] == [(None, None, None)] * 4
    assert br.bridge_gaps(ranked, min_gap=1e6).count() == 0
    assert {(r.kind, r.length > 0) for r in br.parts_of_outline(lines).collect()} == {("data", True), ("bridge", False)}


@pytest.mark.parametrize("tile", [1, 7, 40, 100])
def test_ends_and_trims_do_not_depend_on_tiles(spark, monkeypatch, tile):
    arcs, keys = _arcs(spark), cv.SEGMENT
    trims = arcs.select(*cv.CURVE).distinct().withColumn("trim", F.lit(3.0))

    def found():
        ends = {(r.ne_label, r.segment): tuple(r[4:]) for r in br.segment_ends(arcs).collect()}
        cut = {(r.ne_label, r.segment, r.idx): (r.y, r.x) for r in br.trim_ends(arcs, trims).collect()}
        return ends, cut

    want = found()
    for f in (sc.tiles, sc.neighbours, sc.running_sum):
        monkeypatch.setattr(f, "__defaults__", tuple(tile if d == sc.TILE else d for d in f.__defaults__))
    got = found()
    for a, b in zip(got, want):
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_no_tile_before_the_first(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)], "g string, idx long")
    assert sorted((r._tile, r.idx) for r in sc.tiles(rows, ["g"], "idx", 1, 3).collect()) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (1, 4)]


def test_slices_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    rng = random.Random(4)
    rows = [(rng.choice([True, False, None]), rng.gauss(0, 1), rng.choice([None, rng.gauss(5, 2)])) for _ in range(60)]
    df = spark.createDataFrame(rows, "kept boolean, `a/b` double, c double").withColumn("c", F.udf(count, "double").asNondeterministic()("c"))
    got = {(r.part, r.metric): (r["mean"], r.sd, r.n, r.median) for r in sm.kept_vs_filtered(df, ["a/b", "c"]).collect()}
    assert seen.value == 60
    assert len(got) == 6
    for (part, metric), found in got.items():
        own = [r[1 if metric == "a/b" else 2] for r in rows if part == "all" or (part == "kept") == bool(r[0])]
        own = [x for x in own if x is not None]
        assert found == pytest.approx((np.mean(own), np.std(own, ddof=1), len(own), np.median(own)))


def test_a_part_without_slices_has_no_row(spark):
    df = spark.createDataFrame([(True, 1.0), (True, 3.0)], "kept boolean, v double")
    assert sorted((r.part, r.n, r.median) for r in sm.kept_vs_filtered(df, ["v"]).collect()) == [("all", 2, 2.0), ("kept", 2, 2.0)]


def test_pixels_are_not_sorted_to_clear_the_border(spark):
    rows = [("f", n, y, x + 4 * n) for n in range(3) for y in range(1, 4) for x in range(3)]
    got = px.clear_border(sc.apart(spark.createDataFrame(rows, "fov string, ne_label long, y long, x long")), ["fov"], 5, 11)
    assert sorted(map(tuple, got.select("fov", "ne_label", "y", "x").collect())) == [r for r in sorted(rows) if r[1] == 1]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
