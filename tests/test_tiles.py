"""Work cut into tiles gives what the whole gives: regions, samples along lines, padded crops, cubic drift, shifts, user functions."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from perinuc import scale as sc
from perinuc.operators import curves as cv
from perinuc.operators import groups as gr
from perinuc.operators import pixels as px
from perinuc.operators import raster
from perinuc.operators import regions as rg


def plain_labels(pixels):
    """8-connected regions by a plain search, numbered in reading order."""
    left, label, n = set(pixels), {}, 0
    for start in sorted(pixels):
        if start not in left:
            continue
        n += 1
        todo = [start]
        left.discard(start)
        while todo:
            y, x = todo.pop()
            label[y, x] = n
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if (y + a, x + b) in left:
                        left.discard((y + a, x + b))
                        todo.append((y + a, x + b))
    return label


def spiral(n):
    out = set()
    for dy in range(n):
        for dx in range(n):
            d = min(dy, dx, n - 1 - dy, n - 1 - dx)
            if (d % 2 == 0) != (dx == d and dy == d + 1):
                out.add((dy, dx))
    return out


SHAPES = {
    "spiral": spiral(41),
    "u": {(y, x) for y in range(30) for x in range(30) if x < 2 or x > 27 or y > 27},
    "stairs": {(i, i) for i in range(35)} | {(i, 34 - i) for i in range(0, 10)},
    "chequers": {(y, x) for y in range(20) for x in range(20) if (y + x) % 2 == 0},
    "rings": {(y, x) for y in range(33) for x in range(33) if min(y, x, 32 - y, 32 - x) % 3 == 0},
    "corner": {(7, 7), (8, 8), (7, 9), (15, 16), (16, 15), (0, 30)},
}


@pytest.mark.parametrize("side", [2, 8, 16, 256])
def test_regions_do_not_depend_on_tiles(spark, side):
    rng = random.Random(side)
    images = dict(SHAPES, noise={(rng.randrange(50), rng.randrange(50)) for _ in range(900)})
    rows = [(name, y, x) for name, pixels in images.items() for y, x in pixels]
    rows += rows[:50] + [(None, 1, 1), ("u", None, 1)]  # pixels that repeat, no image, no place
    df = spark.createDataFrame(rows, "name string, y int, x int").repartition(5)
    got = rg.label_regions(df, ["name"], side=side).collect()
    want = {(name, y, x): n for name, pixels in images.items() for (y, x), n in plain_labels(pixels).items()}
    assert len(got) == len(want) and {(r.name, r.y, r.x): r.ne_label for r in got} == want
    assert len({n for (name, _, _), n in want.items() if name == "spiral"}) == 1


def test_regions_of_nothing(spark):
    assert rg.label_regions(spark.createDataFrame([], "g int, y int, x int"), ["g"]).count() == 0


def test_no_task_holds_more_than_tiles(spark):
    """One image of 400,000 pixels in one region: tiles of 64 give runs, and only border regions are linked."""
    df = spark.range(400_000).selectExpr("'one' AS g", "id DIV 800 AS y", "id % 800 AS x")
    assert rg.label_regions(df, ["g"], side=64).agg(F.min("ne_label"), F.max("ne_label"), F.count("*")).first() == (1, 1, 400_000)


def plain_sample(image, y, x):
    r, c = int(np.floor(y)), int(np.floor(x))
    fy, fx = y - r, x - c
    at = lambda a, b: image.get((a, b), 0.0)
    return (1 - fy) * ((1 - fx) * at(r, c) + fx * at(r, c + 1)) + fy * ((1 - fx) * at(r + 1, c) + fx * at(r + 1, c + 1))


@pytest.mark.parametrize("side,most", [(8, 100_000), (8, 5), (16, 3), (128, 100_000)])
def test_samples_do_not_depend_on_blocks(spark, side, most):
    rng = random.Random(3)
    h, w, n = 40, 50, 7
    image = {g: {(rng.randrange(h), rng.randrange(w)): rng.random() for _ in range(900)} for g in "ab"}
    lines = [(g, f"k{i}", *[rng.uniform(-3, d + 2) for d in (h, w, h, w)]) for i, g in enumerate("ab" * 60)]
    lines += [("a", "one", 5.0, 5.0, 5.0, 5.0), ("a", "edge", h - 1.0, 0.0, h - 1.0, w - 1.0), ("c", "no image", 1.0, 1.0, 5.0, 5.0)]
    pixels = spark.createDataFrame([(g, y, x, v) for g, p in image.items() for (y, x), v in p.items()], "fov string, y int, x int, value double")
    normals = spark.createDataFrame(lines, "fov string, name string, y0 double, x0 double, y1 double, x1 double")
    got = raster.sample_lines(pixels, normals, ["fov"], ["fov", "name"], n, h, w, side=side, most=most).collect()
    found = {(r.fov, r.name, r.k): (r.dist, r.intensity) for r in got}
    assert len(got) == len(found) == n * len(lines)
    for g, name, y0, x0, y1, x1 in lines:
        for k in range(n):
            t = k / (n - 1)
            y, x = min(max(y0 + t * (y1 - y0), 0), h - 1), min(max(x0 + t * (x1 - x0), 0), w - 1)
            dist, value = found[g, name, k]
            assert dist == pytest.approx(np.hypot(y1 - y0, x1 - x0) * t) and value == pytest.approx(plain_sample(image.get(g, {}), y, x))


def test_padded_crops_hold_every_place_once(spark):
    boxes = spark.createDataFrame([("f", "a", 2, 3, 5, 8), ("f", "b", 0, 0, 9, 2), ("f", "none", 4, 4, 4, 4)], "fov_id string, ne_label string, final_top int, final_left int, final_bottom int, final_right int")
    image = {(y, x): y * 10 + x for y in range(12) for x in range(12) if (y + x) % 3}
    pixels = spark.createDataFrame([("f", y, x, v) for (y, x), v in image.items()], "fov_id string, y int, x int, value int")
    crops = px.crop(pixels, boxes, ["fov_id"])
    got = px.pad_crops(crops, boxes, ["fov_id"], 6, 7).collect()
    want = {}
    for name, top, left, bottom, right in (("a", 2, 3, 5, 8), ("b", 0, 0, 9, 2), ("none", 4, 4, 4, 4)):
        have_h, have_w = bottom - top, right - left
        py, px_ = max(6 - have_h, 0) // 2, max(7 - have_w, 0) // 2
        for y in range(max(6, have_h)):
            for x in range(max(7, have_w)):
                inside = 0 <= y - py < have_h and 0 <= x - px_ < have_w
                want[name, y, x] = image.get((top + y - py, left + x - px_), 0) if inside else 0
    assert len(got) == len(want) and {(r.ne_label, r.y, r.x): r.value for r in got} == want


def plain_cubic(t, v, at):
    n = len(t)
    h = np.diff(t)
    bend = np.zeros(n)
    if n > 2:
        low, mid, up = h[1:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:-1].copy()
        r = 6 * np.diff(np.diff(v) / h)
        for i in range(1, n - 2):
            f = low[i - 1] / mid[i - 1]
            mid[i] -= f * up[i - 1]
            r[i] -= f * r[i - 1]
        bend[n - 2] = r[-1] / mid[-1]
        for i in range(n - 4, -1, -1):
            bend[i + 1] = (r[i] - up[i] * bend[i + 2]) / mid[i]
    i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    a, b, d = t[i + 1] - at, at - t[i], h[i]
    return (bend[i] * a**3 + bend[i + 1] * b**3) / (6 * d) + (v[i] / d - bend[i] * d / 6) * a + (v[i + 1] / d - bend[i + 1] * d / 6) * b


def test_smooth_drift_equals_one_solve_over_all_bins(spark):
    rng = np.random.default_rng(2)
    n = 100_000
    t = np.cumsum(rng.uniform(0.2, 4.0, n))
    v = np.cumsum(rng.normal(size=(n, 2)), axis=0)
    size = int(t[-1]) + 5
    rows = pd.DataFrame({"g": "long", "idx": np.arange(n), "center": t, "dy": v[:, 0], "dx": v[:, 1]})
    few = pd.DataFrame({"g": ["two", "two", "one"], "idx": [0, 1, 0], "center": [2.0, 6.0, 1.0], "dy": [1.0, 3.0, 7.0], "dx": [0.0, -2.0, 1.0]})
    bins = spark.createDataFrame(pd.concat([rows, few]))
    frames = spark.createDataFrame([("long", size), ("two", 9), ("one", 3)], "g string, size long")
    got = cv.smooth_drift(bins, ["g"], frames).toPandas()
    long = got[got.g == "long"].sort_values("frame")
    assert long.frame.tolist() == list(range(size))
    for c, column in (("dy", 0), ("dx", 1)):
        assert np.abs(long[c].to_numpy() - plain_cubic(t, v[:, column], np.arange(size))).max() < 1e-9 * np.abs(v).max()
    two = got[got.g == "two"].sort_values("frame")
    assert two.dy.tolist() == pytest.approx([0.5 * f for f in range(9)]) and len(two) == 9
    assert got[got.g == "one"].dy.tolist() == [7.0] * 3


@pytest.mark.parametrize("reach", [1, 5, 32])
def test_shift_scores_equal_direct_sums(spark, reach):
    rng = np.random.default_rng(reach)
    a, b = rng.normal(size=(90, 70)), rng.normal(size=(90, 70))
    there = rng.random((90, 70)) < 0.8
    rows = lambda m, keep: [("g", int(y), int(x), float(m[y, x])) for y, x in zip(*np.nonzero(keep))]
    frame = "g string, y int, x int, value double"
    one, two = spark.createDataFrame(rows(a, there), frame), spark.createDataFrame(rows(b, np.ones_like(there)), frame)
    got = {(r.dy, r.dx): r.score for r in px.shift_scores(one, two, ["g"], reach).collect()}
    za = np.where(there, (a - a[there].mean()) / (a[there].std() * np.sqrt(there.sum())), 0.0)
    zb = (b - b.mean()) / (b.std() * np.sqrt(b.size))
    assert len(got) == (2 * reach + 1) ** 2
    for (dy, dx), score in list(got.items())[:: max(1, reach)]:
        moved = np.zeros_like(zb)
        moved[max(dy, 0) : 90 + min(dy, 0), max(dx, 0) : 70 + min(dx, 0)] = zb[max(-dy, 0) : 90 + min(-dy, 0), max(-dx, 0) : 70 + min(-dx, 0)]
        assert score == pytest.approx((za * moved).sum(), abs=1e-12)


SUMS = StructType([StructField("fov_id", StringType()), StructField("n", LongType()), StructField("near", LongType())])


def test_user_function_per_tile(spark):
    def around(rows):
        """Own rows of a tile, and how many rows lie within one place of them."""
        if (rows["v"] < 0).any():
            raise ValueError(f"negative at {int(rows.loc[rows['v'] < 0, 'y'].min())}")
        own = rows[rows["own"]]
        near = sum(int(((rows.y - y).abs().le(1) & (rows.x - x).abs().le(1)).sum()) for y, x in zip(own.y, own.x))
        return pd.DataFrame({"fov_id": [own.fov_id.iloc[0]], "n": [len(own)], "near": [near]})

    rng = random.Random(1)
    places = {f: {(rng.randrange(-5, 60), rng.randrange(60)) for _ in range(300)} for f in "ab"}
    rows = [(f, y, x, 1) for f, p in places.items() for y, x in p] + [("bad", y, 0, -1 if y == 37 else 1) for y in range(60)] + [("a", None, 1, 1)]
    df = spark.createDataFrame(rows, "fov_id string, y int, x int, v int")
    out = gr.apply_per_tile(df, around, SUMS, side=16, border=1)
    got = out.groupBy("fov_id", "error").agg(F.sum("n").alias("n"), F.sum("near").alias("near"), F.count("*").alias("rows")).collect()
    found = {r.fov_id: r for r in got}
    for f, p in places.items():
        assert (found[f].n, found[f].error) == (300 - (300 - len(p)), None) and found[f].rows > 10
        assert found[f].near == sum((y + a, x + b) in p for y, x in p for a in (-1, 0, 1) for b in (-1, 0, 1))
    assert (found["bad"].n, found["bad"].rows, found["bad"].error) == (None, 1, "ValueError: negative at 37")


@pytest.mark.parametrize("small", [0, 100, 10_000])
@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_of_small_and_large_groups(spark, small, by):
    rng = np.random.default_rng(5)
    data = {"big": np.round(rng.normal(size=30_000), 2), "ties": np.repeat([1.0, 2.0, 2.5], 5000), "few": np.array([3.0, 1.0, 2.0, 9.0]), "one": np.array([4.0])}
    if small == 0:
        data = {k: v for k, v in data.items() if len(v) > 10_000}  # a sketch's bound needs some rows
    rows = pd.concat([pd.DataFrame({"g": k, "v": v, "w": -v, "none": None}) for k, v in data.items()])
    rows["none"] = rows["none"].astype("float")
    df = spark.createDataFrame(rows).withColumn("none", F.lit(None).cast("double"))
    odd = spark.createDataFrame([("big", None, 5.0), ("big", float("nan"), 5.0), ("null", None, None)], "g string, v double, w double")
    df = df.unionByName(odd.withColumn("none", F.lit(None).cast("double")))
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = sc.quantiles(df, by, ["v", "w", "none"], probs, small=small).collect()
    groups = data if by else {None: np.concatenate(list(data.values()))}
    extra = {"big": [5.0, 5.0]} if by else {None: [5.0, 5.0]}
    want = {(g, "v", p): np.quantile(v, p) for g, v in groups.items() for p in probs}
    want |= {(g, "w", p): np.quantile(np.r_[-v, extra.get(g, [])], p) for g, v in groups.items() for p in probs}
    found = {(r.g if by else None, r.metric, r.p): r.q for r in got}
    assert len(got) == len(found) == len(want)
    for key, q in want.items():
        assert found[key] == pytest.approx(q, abs=1e-12)


def test_dilation_holds_rows_as_bits_and_shuffles_no_copies(spark):
    """Every pixel near the part borders of 32, in both signs, with repeats and pixels without a place."""
    dots = [("a", x % 3, x * 5 % 70 - 1, x) for x in range(-1, 70)] * 2 + [("b", 1, 0, 0), ("b", 1, None, 4), (None, None, 5, 31)]
    mask = spark.createDataFrame(dots, "fov_id string, ne_label long, y long, x long")
    got = [tuple(r) for r in px.dilate3x3(mask, ["fov_id"], 60, 66).collect()]
    grown = {(f, n, y + a, x + b) for f, n, y, x in dots if y is not None for a in (-1, 0, 1) for b in (-1, 0, 1)}
    assert len(got) == len(set(got))
    assert set(got) == {g for g in grown if 0 <= g[2] < 60 and 0 <= g[3] < 66}
    # a shuffle after nine copies of each pixel is what did not finish
    assert "array([-1,-1]" not in px.dilate3x3(mask, ["fov_id"], 60, 66)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in px.dilate3x3(mask, ["fov_id"], 60, 66)._jdf.queryExecution().optimizedPlan().toString()


def test_padded_lines_hold_the_pixels_of_padded_crops(spark, monkeypatch):
    monkeypatch.setattr(px, "PADDED", 30)
    boxes = spark.createDataFrame([("a", "1", 0, 0, 3, 2), ("a", "2", 5, 5, 5, 9), ("b", "1", 0, 0, 9, 9)], "fov_id string, ne_label string, final_top long, final_left long, final_bottom long, final_right long")
    dots = [("a", "1", 0, 0, 7), ("a", "1", 2, 1, None), ("a", "1", 9, 9, 3), ("b", "1", 8, 8, 5)]
    crops = spark.createDataFrame(dots, "fov_id string, ne_label string, y long, x long, value long")
    want = {(r.fov_id, r.ne_label, r.y, r.x): r.value for r in px.pad_crops(crops, boxes, ["fov_id"], 6, 5).collect()}
    lines = px.pad_lines(crops, boxes, ["fov_id"], 6, 5).collect()
    assert {(r.fov_id, r.ne_label, r.y, x): v for r in lines for x, v in enumerate(r["values"])} == want


def test_lists_of_crops_draw_the_lines_of_rows(spark, monkeypatch):
    """Strips of 4 rows, copied beyond 3 boxes; names that come twice, at one place and at several, and nulls."""
    for name, small in (("STRIP", 4), ("CROWD", 3), ("PADDED", 40)):
        monkeypatch.setattr(px, name, small)
    rng = np.random.default_rng(7)
    dots = [("ab"[i % 2], int(y), int(x), int(v)) for i, (y, x, v) in enumerate(rng.integers(-5, 25, (400, 3)))]
    dots += [("a", 3, 3, None), ("a", None, 3, 5), ("a", 3, None, 5), (None, 3, 3, 5), ("c", 3, 3, 5)]
    placed = [("a", "one", 2, 3, 13, 9), ("a", "wide", 0, -4, 2, 20), ("b", "low", -3, 2, 1, 4), ("b", "none", 4, 4, 4, 9), ("b", "back", 9, 4, 4, 9)]
    placed += [("d", "far", 0, 0, 3, 3), ("a", None, 0, 0, 5, 5), (None, "x", 0, 0, 5, 5), (None, None, None, None, None, None), ("b", "open", 0, 0, None, 5)]
    twice = [("b", "same", 1, 1, 6, 6)] * 3 + [("b", "part", 2, 2, 9, 9), ("b", "part", None, 2, 9, 9), (None, None, None, None, None, None)]
    apart = [("a", "two", 0, 0, 6, 4), ("a", "two", 11, 7, 16, 12), ("a", "two", 11, 7, 16, 12), ("a", "two", 3, 3, 3, 3)]
    frame = "fov_id string, ne_label string, final_top int, final_left int, final_bottom int, final_right int"

    for kind, rows in (("int", placed + twice), ("int", placed + twice + apart), ("double", placed + apart)):
        pixels = spark.createDataFrame(dots, "fov_id string, y long, x int, value int").withColumn("value", F.col("value").cast(kind))
        boxes = spark.createDataFrame(rows, frame)
        plain = px.pad_lines(px.crop(pixels, boxes, ["fov_id"]), boxes, ["fov_id"], 8, 7)
        lists = px.crop(pixels, boxes, ["fov_id"], lists=True)
        got = px.pad_lines(lists, boxes, ["fov_id"], 8, 7)
        key = lambda r: (r.fov_id, r.ne_label, r.y, tuple(r["values"]))
        want = Counter(map(key, plain.collect()))
        assert got.dtypes == plain.dtypes and Counter(map(key, got.collect())) == want
        if kind == "int":
            texts = px.pad_lines(lists, boxes, ["fov_id"], 8, 7, sep=",").collect()
            assert Counter(map(key, texts)) == Counter({(*k[:3], tuple(",".join(map(str, k[3])))): n for k, n in want.items()})
        else:
            with pytest.raises(ValueError):
                px.pad_lines(lists, boxes, ["fov_id"], 8, 7, sep=",")


def test_joined_numbers_of_any_length():
    rng = np.random.default_rng(3)
    kinds = [0, 0, 0, 5, -1, 9, 10, -10, 123456, 2**63 - 1, -(2**63)]
    for _ in range(300):
        widths = rng.integers(0, 6, rng.integers(0, 9))
        cuts = np.append(0, np.cumsum(widths)).astype(np.int32)
        values = rng.choice(np.array(kinds), int(cuts[-1]))
        want = [",".join(map(str, values[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:])]
        assert px._joined(values, cuts, ",").to_pylist() == want


def test_padded_rows_shuffle_pixels_but_no_copies_of_them(spark, tmp_path):
    """Every pixel lies in many boxes; what failed was the disk for their copies, grouped by box."""
    import duckdb

    import __spark_entry__ as entry

    part = [(k, k * 7 % 50 + 1) for k in range(30)]
    items = [(i * 37 % 500, i * 11 % 30 * 75 + i % 75, i % 3, float(i % 4 + 1), i * 1.5) for i in range(600)]
    spark.createDataFrame(part, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("j18_padded_rows", "j18_pad_crops"):
        df = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(entry.oracle_sql()[name])
        assert sorted(d[0] for d in want.description) == sorted(df.columns)
        assert Counter(map(tuple, df.select(*[d[0] for d in want.description]).collect())) == Counter(want.fetchall())
        plan = df._jdf.queryExecution().executedPlan().toString()
        between = plan.split("MapInArrow")
        assert len(between) == 3 and "Exchange" not in between[1]
        # the rows of the table once, pixels and boxes once
        assert plan.count("Exchange hashpartitioning(fov_id") <= 3 and "collect_list(struct(y" not in plan


def test_tile_sums_find_left_neighbours():
    import pandas as pd

    from perinuc.plans.q_detection import _tile_sums

    places = {(y, x): (7 * y + 5 * x) % 11 for y in range(6) for x in range(7) if (y * x) % 4 != 3}
    rows = [("f", y, x, v, x > 0) for (y, x), v in places.items()][::-1]
    got = _tile_sums(pd.DataFrame(rows, columns=["fov_id", "y", "x", "value", "own"]))
    own = [(y, x) for y, x in places if x > 0]
    brighter = sum(1 for y, x in own if (y, x - 1) in places and places[y, x] > places[y, x - 1])
    assert got.values.tolist() == [["f", len(own), brighter, max(places[p] for p in own)]]
