"""Profiles, pixels, detection, statistics and special functions against numpy or known values."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perinuc.functions import special as sp
from perinuc.operators import components as cp
from perinuc.operators import detection as dt
from perinuc.operators import ledger as lg
from perinuc.operators import pixels as px
from perinuc.operators import profiles as pf
from perinuc.operators import summary as sm

PROFILE = "p int, k long, dist double, intensity double"


def profile(p, f, n=40):
    t = np.linspace(0, 12, n)
    return [(p, i, float(x), float(f(x))) for i, x in enumerate(t)]


def test_special_functions(spark):
    xs = [-7.0, -2.5, -1.999, -0.3, 0.0, 0.7, 2.0, 3.3, 6.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", sp.erf("x").alias("e"), sp.erfc("x").alias("c"), sp.norm_cdf("x").alias("n")).collect():
        assert r.e == pytest.approx(math.erf(r.x), abs=1e-14)
        assert r.c == pytest.approx(math.erfc(r.x), rel=1e-11)
        assert r.n == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-11)
    assert df.select(sp.harmonic(F.lit(10)).alias("h")).first().h == pytest.approx(sum(1 / i for i in range(1, 11)), abs=1e-8)


def test_student_p(spark):
    """Exact values for one and two degrees of freedom."""
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (0.0, 5.0)], "t double, df double")
    got = [r.p for r in df.select(sp.student_p("t", "df").alias("p")).collect()]
    assert got == pytest.approx([0.5, 1 - 2 / math.sqrt(6), 1.0], abs=1e-9)


def test_screen_order(spark):
    rows = profile(1, lambda t: 100.0) + profile(2, lambda t: 100 + t / 4) + profile(3, lambda t: 100 + 5 * t)
    rows += [(4, None, None, None)]
    got = {r.p: r.status for r in pf.profile_screen(spark.createDataFrame(rows, PROFILE), ["p"]).collect()}
    assert got == {1: "skip:degenerate", 2: "skip:low_contrast", 3: "unprocessed", 4: "skip:out_of_bounds"}


def test_edge_recovers_a_planted_centre_and_bounds(spark):
    def bump(mu):
        return lambda t: 100 + 2 * t + 80 * math.exp(-((t - mu) ** 2) / (2 * 1.2**2))

    df = spark.createDataFrame(profile(1, bump(4.5)) + profile(2, bump(-1.0)), PROFILE)
    got = {r.p: r for r in pf.profile_edge(df, ["p"], 12.0, [-1.0 + 0.5 * i for i in range(27)], [0.8, 1.2, 1.6]).collect()}
    assert (got[1].mu, got[1].sigma, got[1].status) == (4.5, 1.2, "success")
    assert got[1].slope == pytest.approx(2.0, abs=1e-6) and got[1].amplitude == pytest.approx(80.0, abs=1e-5)
    assert (got[2].mu, got[2].status) == (6.0, "fail:bounds")


def test_fit_quality_against_numpy(spark):
    rng = np.random.default_rng(3)
    o, p = rng.poisson(50, 30).astype(float), np.full(30, 52.0)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(o, p)], "p int, intensity double, predicted double")
    ll = lambda m: np.sum(o * 2 * np.log(m * 2) - m * 2)
    want = (2 - 2 * ll(np.full(30, o.mean()))) - (22 - 2 * ll(p))
    row = pf.delta_aic(df, ["p"], gain=2.0).first()
    assert row.delta_aic == pytest.approx(want) and not row.good_fit
    assert pf.nrmse(df, ["p"]).first().nrmse == pytest.approx(np.sqrt(np.mean((o - p) ** 2)) / np.ptp(o))
    assert pf.poisson_outliers(df, ["p"]).first().is_consistent


def test_samples_are_bilinear_and_clamped(spark):
    pixels = spark.createDataFrame([("1", y, x, float(10 * y + x)) for y in range(10) for x in range(10)], "fov_id string, y long, x long, value double")
    lines = spark.createDataFrame([("1", 1, 1.5, 1.0, 1.5, 4.0), ("1", 2, 1.0, 1.0, 9.0, 1.0), ("2", 3, 1.0, 1.0, 2.0, 2.0)], "fov_id string, i int, y0 double, x0 double, y1 double, x1 double")
    got = pf.sample_along_normals(pixels, lines, ["fov_id", "i"], 4, 10, 10).collect()
    first = sorted((r.k, r.dist, r.intensity) for r in got if r.i == 1)
    assert first == [(0, 0.0, 16.0), (1, 1.0, 17.0), (2, 2.0, 18.0), (3, 3.0, 19.0)]
    assert [r.valid for r in got if r.i == 2] == [False]
    assert not [r for r in got if r.i == 3]


def test_camera_gain_recovers_a_planted_slope(spark):
    rng = np.random.default_rng(0)
    rows = []
    for frame in range(60):
        for y in range(8):
            for x in range(8):
                level = 400 + 100 * (y * 8 + x)
                rows.append((frame, y, x, 100 + rng.normal(level, math.sqrt(2.0 * level)), 100.0 + (frame + x) % 3))
    got = px.camera_gain(spark.createDataFrame(rows, "frame long, y long, x long, bright double, dark double")).first()
    assert got.gain == pytest.approx(0.5, rel=0.15) and got.offset == pytest.approx(101.0, abs=0.2)


def test_shift_search_recovers_a_planted_shift(spark):
    rng = np.random.default_rng(2)
    img = rng.normal(size=(20, 20))
    moved = np.roll(img, (-2, 3), axis=(0, 1))
    as_df = lambda a: spark.createDataFrame([("1", y, x, float(a[y, x])) for y in range(20) for x in range(20)], "g string, y long, x long, value double")
    got = px.shift_by_correlation(as_df(img), as_df(moved), ["g"], reach=4).first()
    assert got.shift_y == pytest.approx(2, abs=0.5) and got.shift_x == pytest.approx(-3, abs=0.5)


def test_label_regions_join_diagonals_and_number_in_reading_order(spark):
    art = ["..#..#", ".#..##", "#.....", "..##.."]
    pixels = spark.createDataFrame([("a", y, x) for y, row in enumerate(art) for x, c in enumerate(row) if c == "#"], "g string, y long, x long")
    labels = {(r.y, r.x): r.ne_label for r in px.label_regions(pixels, ["g"]).collect()}
    assert labels[0, 2] == labels[1, 1] == labels[2, 0] == 1
    assert labels[0, 5] == labels[1, 4] == labels[1, 5] == 2
    assert labels[3, 2] == labels[3, 3] == 3
    kept = px.clear_border(px.label_regions(pixels, ["g"]), ["g"], 6, 6)
    assert {r.ne_label for r in kept.collect()} == {3}


def test_components_of_a_long_chain(spark):
    nodes = spark.range(50).select(F.lit("a").alias("g"), F.col("id").alias("node"))
    edges = spark.range(48).select(F.lit("a").alias("g"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = {r.node: r.component for r in cp.components(nodes, edges, ["g"]).collect()}
    assert {got[i] for i in range(49)} == {0} and got[49] == 49


def test_segment_clusters_include_the_exact_limit(spark):
    ends = spark.createDataFrame([("1", "a", 0.0, 0.0, 0.0, 9.0), ("1", "b", 0.0, 19.0, 5.0, 5.0), ("1", "c", 90.0, 90.0, 95.0, 95.0)], "g string, segment string, start_y double, start_x double, end_y double, end_x double")
    got = {r.segment: r.cluster for r in cp.segment_clusters(ends, ["g"], 10.0).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_crop_and_padding(spark):
    pixels = spark.createDataFrame([("1", y, x, 1) for y in range(4) for x in range(4)], "fov_id string, y long, x long, value int")
    boxes = spark.createDataFrame([("1", "a", 2, 2, 4, 4)], "fov_id string, ne_label string, final_top long, final_left long, final_bottom long, final_right long")
    crops = px.crop(pixels, boxes, ["fov_id"])
    assert sorted((r.y, r.x) for r in crops.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    full = px.pad_crops(crops, boxes, ["fov_id"], 5, 5).collect()
    assert len(full) == 25 and sorted((r.y, r.x) for r in full if r.value) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_sliding_regions_and_too_small_stacks(spark):
    stack = spark.createDataFrame([("1", f, y, x, f * 100 + y * 10 + x) for f in range(3) for y in range(3) for x in range(3)], "g string, frame long, y long, x long, value long")
    rois = dt.sliding_rois(stack, ["g"], 2, 2).collect()
    assert len(rois) == 2 * 2 * 2
    assert [r.counts for r in rois if (r.frame, r.y0, r.x0) == (1, 0, 1)] == [[101, 102, 111, 112, 201, 202, 211, 212]]
    assert dt.sliding_rois(stack, ["g"], 4, 2).count() == 0


def test_likelihood_ratio_finds_a_bright_spot(spark):
    size, w = 8, dt.spot_weights(8, 1.2)
    flat = [20] * 64
    spot = [round(20 + 400 * p) for p in w]
    df = spark.createDataFrame([("flat", flat, [20.0] * 64), ("spot", spot, [20.0] * 64)], "id string, counts array<int>, background array<double>")
    got = {r.id: r for r in dt.roi_llr(df, 1, size, 1.2, iters=200).collect()}
    n, p, fit = np.array(spot, float), np.array(w), got["spot"]
    ll = lambda mu: np.sum(n * np.log(mu) - mu)
    assert fit.lr == pytest.approx(2 * (ll(fit.photons * p + fit.level) - ll(np.full(64, n.mean()))), rel=1e-9)
    assert fit.photons == pytest.approx(400, rel=0.1)
    # far beyond the chance level of one extra parameter, while an even region shows nothing
    assert fit.lr > 20 and abs(got["flat"].lr) < 1


def test_fdr_own_threshold_and_step_up(spark):
    lrs = [9.0, 0.1, 12.0, 3.0, 3.1, 0.0]
    df = spark.createDataFrame([(i, "b", x) for i, x in enumerate(lrs)], "roi int, batch string, lr double")
    own = {r.roi: r for r in dt.fdr(df, ["batch"], 0.5, ["roi"]).collect()}
    up = {r.roi: r for r in dt.fdr(df, ["batch"], 0.5, ["roi"], step_up=True).collect()}
    assert own[2]["rank"] == 1 and own[0]["rank"] == 2
    for r in own.values():
        assert r.p == pytest.approx(math.erfc(math.sqrt(r.lr / 2)), rel=1e-10)
        assert r.significant == (r.p <= r.threshold)
    last = max(r["rank"] for r in own.values() if r.significant)
    assert all(r.significant == (r["rank"] <= last) for r in up.values())


def test_ledger_defaults_and_order(spark):
    rows = [(1, 5, "ch1", "1", "a", "e1", "registration", "passed", 1.0), (2, 9, "ch1", "1", "a", "e2", "registration", "failed", 2.0), (3, 7, "ch2", "1", "b", "e3", "detection", "DETECTED", 3.0)]
    ev = spark.createDataFrame(rows, "event_id int, ts int, channel string, fov_id string, ne_label string, event string, attribute string, value string, metric double")
    got = {r.ne_label: r for r in lg.ledger_state(ev).collect()}
    assert (got["a"].registration, got["a"].paired, got["a"].detection) == ("failed", "unknown", None)
    assert (got["b"].registration, got["b"].refined_fit, got["b"].detection) == ("pending", "pending", "DETECTED")
    report = lg.pruned_report(ev)
    assert [(r.ne_label, r.last_event) for r in report.collect()] == [("a", "e2")]
    assert {r.channel: r.pruned for r in lg.pruned_totals(report, ev).collect()} == {"ch1": 1, "ch2": 0, None: 1}
    assert [r.event for r in lg.ledger_history(ev, {"ne_label": "a"}).orderBy("seq").collect()] == ["e1", "e2"]


def test_summary_with_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 4.0), ("b", 2.0)], "g string, v double")
    whole = {r.g: r for r in sm.summary_stats(df, ["g"], ["v"]).collect()}
    assert whole["a"].n == 3 and whole["a"].v_mean is None and whole["a"].v_median is None and whole["a"].v_IQR == 1.5
    assert whole["b"].v_sd is None and whole["b"].v_mean == 2.0
    skipped = {r.g: r for r in sm.summary_stats(df, ["g"], ["v"], na="skip").collect()}
    assert skipped["a"].v_mean == 2.5 and skipped["a"].v_median == 2.5


def test_distance_stats_of_small_kinds(spark):
    rows = [("1", "a", "b", 1.0, "data_data"), ("1", "a", "b", 3.0, "data_data"), ("1", "a", "b", 8.0, "data_bridge")]
    row = sm.distance_stats(spark.createDataFrame(rows, "fov_id string, ch1_label string, ch2_label string, dist_nm double, pair_type string")).first()
    assert (row.data_data_mean, row.data_data_std, row.n_data_data_points) == (2.0, 1.0, 2)
    assert (row.data_bridge_mean, row.data_bridge_std) == (8.0, None)
    assert (row.bridge_bridge_mean, row.n_bridge_bridge_points, row.median_distance) == (None, 0, 3.0)


def test_values_on_a_bin_edge(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "v double")
    last = {r.bin: r.n for r in sm.histogram_n(df, "v", 4).collect()}
    assert last == {0: 1, 1: 1, 2: 1, 3: 2}
    closed = sm.histogram_by_width(df, "v", []).collect()
    width = 3.49 * np.std(range(5), ddof=1) * 5 ** (-1 / 3)
    assert sum(r.n for r in closed) == 5 and closed[0].y_max == max(r.n for r in closed)
    assert {r.bin: r.n for r in closed} == {0: 4 if width >= 3 else 3, 1: 1 if width >= 3 else 2}


def test_large_regions_from_tiles_equal_all_regions(spark):
    rng = np.random.default_rng(3)
    stack = rng.integers(1, 50, (7, 37, 21)) * (rng.random((7, 37, 21)) < 0.02)
    stack[-1, -1, -1] = 3
    stack[:, 18:, :4] = 0
    rows = [("f", int(f), int(y), int(x), int(stack[f, y, x])) for f, y, x in zip(*np.nonzero(stack))]
    df = spark.createDataFrame(rows, "g string, frame long, y long, x long, value long")
    got = {(r.frame, r.y0, r.x0): r.counts for r in dt.sliding_rois(df, ["g"], 3, 16).collect()}
    want = {}
    for f, y, x in np.ndindex(5, 22, 6):
        part = stack[f : f + 3, y : y + 16, x : x + 16]
        if part.any():
            want[(f, y, x)] = part.ravel().tolist()
    assert got == want


def test_shift_scores_across_tiles(spark):
    rng = np.random.default_rng(4)
    one, two = rng.random((2, 70, 130))
    one[60:66, 60:70] = np.nan  # pixels that are not there

    def table(image):
        return spark.createDataFrame([("f", y, x, float(v)) for (y, x), v in np.ndenumerate(image) if v == v], "g string, y int, x int, value double")

    got = {(r.dy, r.dx): r.score for r in px.shift_scores(table(one), table(two), ["g"], 5).collect()}
    a, b = ((i - np.nanmean(i)) / (np.nanstd(i) * np.sqrt(np.isfinite(i).sum())) for i in (one, two))
    for dy, dx in [(0, 0), (5, -5), (-3, 2), (-5, -5), (5, 5)]:
        moved = np.full(a.shape, np.nan)
        moved[max(dy, 0) : 70 + min(dy, 0), max(dx, 0) : 130 + min(dx, 0)] = b[max(-dy, 0) : 70 + min(-dy, 0), max(-dx, 0) : 130 + min(-dx, 0)]
        assert got[(dy, dx)] == pytest.approx(np.nansum(a * moved), abs=1e-12)
    assert len(got) == 121


def test_edge_is_the_same_however_profiles_lie_across_batches(spark, monkeypatch):
    """Cut into batches of few samples, with missing ones, profiles keep their fit; none is lost where a batch ends."""
    rng = np.random.default_rng(8)
    rows = []
    for p in range(7):
        for k in range(5 + 9 * p):
            t = 12.0 * k / (4 + 9 * p)
            v = 1e6 * (p == 3) + 50 + 3 * t + 40 * math.exp(-((t - 3 - p / 2) ** 2) / 2.88) + rng.normal()
            rows.append((p, float(t), None if p == 4 and k % 5 == 0 or p == 5 else float(v)))
    rows += [(9, None, 4.0), (9, None, 5.0), (None, 1.0, 2.0), (None, 5.0, 9.0), (None, 7.0, 3.0), (None, 9.0, 4.0)]
    table = pa.table({"p": [r[0] for r in rows], "dist": [r[1] for r in rows], "intensity": [r[2] for r in rows]})
    mus, sigmas = (c.ravel() for c in np.meshgrid([2.0, 4.0, 6.0, 8.0], [0.8, 1.2], indexing="ij"))

    def fits(size):
        monkeypatch.setattr(pf, "BATCH", size)
        got = pa.Table.from_batches(pf._grid_search(iter(table.to_batches()), ["p"], mus, sigmas)).to_pylist()
        return {r["p"]: tuple(r[c] for c in pf.FITTED) for r in got}

    whole = fits(10_000)
    assert set(whole) == {0, 1, 2, 3, 4, 5, 6, None} and whole[5] == (2.0, 0.8, None, None, None, None)
    for size in (1, 4, 13):
        parts = fits(size)
        assert set(parts) == set(whole)
        for p in whole:
            if p != 5:
                assert parts[p][:2] == whole[p][:2] and parts[p][2:] == pytest.approx(whole[p][2:], rel=1e-6, abs=1e-5)
    monkeypatch.setattr(pf, "BATCH", 10_000)
    for p in (2, 4, 6):
        t, y = (np.array(c) for c in zip(*[r[1:] for r in rows if r[0] == p and r[2] is not None]))
        if p == 4:
            continue
        errors = []
        for m, s in zip(mus, sigmas):
            a = np.column_stack([t, np.ones(len(t)), np.exp(-((t - m) ** 2) / (2 * s * s))])
            errors.append(np.sum((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2))
        best = int(np.argmin(errors))
        assert whole[p][:2] == (mus[best], sigmas[best]) and whole[p][5] == pytest.approx(errors[best], rel=1e-6)


def test_edge_search_keeps_no_row_per_profile_and_cell(spark):
    """The memory of a task must not grow with its profiles: nothing is summed by profile and cell, and samples go through one shuffle."""
    df = spark.createDataFrame(profile(1, lambda t: 100 + t), PROFILE)
    plan = pf.profile_edge(df, ["p"], 12.0, [3.0, 6.0], [1.0])._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "Generate" not in plan
