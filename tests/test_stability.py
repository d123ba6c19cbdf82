"""Hand-made rows: one slice, missing in mode 2, no field in both modes, drift beyond the noise."""

import math

import pytest

from perinuc.operators import stability as st

REG = "mode int, fov_id string, ne_label string, scale double, angle double, shift_y double, shift_x double"
SLICE = REG + ", slice_id string"


def label(mode, ne, y, x, fov="1", scale=1.0, angle=0.0):
    return (mode, fov, ne, scale, angle, y, x)


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame(
        [label(1, "a", 0.0, 0.0), label(2, "a", 0.1, 0.0), label(1, "b", 0.0, 0.0), label(2, "b", 3.0, 4.0), label(1, "c", 0.0, 0.0), label(2, "z", 9.0, 9.0)], REG
    )
    rows = []
    for mode in (1, 2):
        for ne in ("a", "b"):
            rows += [label(mode, ne, y, 0.0) + (f"slice_{i}",) for i, y in enumerate((-0.3, 0.3))]
    rows.append(label(1, "c", 0.0, 0.0) + ("slice_1",))
    slices = spark.createDataFrame(rows, SLICE)
    pairs = spark.createDataFrame([("1", "a", "k")], "fov_id string, ch1_label string, ch2_label string")
    return labels, slices, pairs


def test_slice_sigma_default_for_one_slice(tables):
    got = {(r.mode, r.ne_label): r.sigma for r in st.slice_sigma(tables[1]).collect()}
    assert got[1, "c"] == 0.5
    assert got[1, "a"] == pytest.approx(0.3)


def test_ne_stability_branches(tables):
    got = {r.ne_label: r for r in st.ne_stability(*tables).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"].status == "passed" and got["a"].is_paired and got["a"].ch2_label == "k"
    assert got["a"].threshold == pytest.approx(2 * math.hypot(0.3, 0.3))
    assert got["b"].status == "failed" and got["b"].fail_reason == "Unstable_Drift (5.000 > 0.849)"
    assert (got["b"].drift_dy, got["b"].drift_dx) == (3.0, 4.0)
    assert got["c"].fail_reason == "missing_in_mode2" and got["c"].drift == -1.0
    assert got["c"].sigma_combined == pytest.approx(0.5 * 1.414)


def test_fov_stability_and_comparison(spark, tables):
    fields = "mode int, fov_id string, scale double, angle double, shift_y double, shift_x double"
    rows = [(m, str(f), 1.0, 0.0, 0.1 * m, 0.0) for f in range(1, 8) for m in (1, 2)] + [(1, "8", 1.0, 0.0, 0.0, 0.0), (2, "8", 1.0, 0.0, 3.0, 0.0)]
    fovs = spark.createDataFrame(rows, fields)
    report = st.fov_stability(fovs)
    got = {r.fov_id: r for r in report.collect()}
    assert [f for f, r in got.items() if r.status == "failed"] == ["8"]
    assert got["8"].threshold == pytest.approx(2 * math.sqrt((7 * 0.01 + 9) / 8))
    total = st.compare_stability(report, st.expand_to_nuclei(report, tables[0]), st.ne_stability(*tables))
    last = {r.fov_id: r for r in total.collect()}
    assert last["1"].detected == 3 and last["1"].pruned_ne_method == 2 and last["1"].pruned_fov_method == 0
    assert last[None].diff == -2 and last[None].method_agreement == 1


def test_population_sigma_without_common_fields(spark):
    fovs = spark.createDataFrame([(1, "1", 1.0, 0.0, 0.0, 0.0)], "mode int, fov_id string, scale double, angle double, shift_y double, shift_x double")
    assert st.population_sigma(st.fov_drift(fovs)).first().global_sigma == 0.5


def test_delta_stats_of_nothing(spark, tables):
    empty = st.mode_delta(tables[0].filter("mode = 1"), ["fov_id", "ne_label"])
    row = st.delta_stats(empty, "label").first()
    assert row.n == 0 and row.sigma_reg is None and row.rdif_y_mean is None


def test_effective_registration_falls_back(spark, tables):
    nuclei = spark.createDataFrame([("1", "k"), ("1", "m"), ("1", "n")], "fov_id string, ne_label string")
    pairs = spark.createDataFrame([("1", "a", "k"), ("1", "q", "m")], "fov_id string, ch1_label string, ch2_label string")
    fov = spark.createDataFrame([("1", 1.1, 0.2, 1.0, 2.0)], "fov_id string, scale double, angle double, shift_y double, shift_x double")
    got = {r.ne_label: r for r in st.effective_registration(nuclei, pairs, tables[0].filter("mode = 2"), fov).collect()}
    assert (got["k"].source, got["k"].shift_y) == ("label", 0.1)
    assert (got["m"].source, got["m"].scale) == ("fov", 1.1)
    assert (got["n"].source, got["n"].scale, got["n"].shift_x) == ("identity", 1.0, 0.0)


def test_fixed_digits_round_the_exact_value(spark):
    from perinuc.functions.scalars import fixed

    values = [1.0005, 0.0005, 0.0625, 0.1875, 2.5, 0.0, 0.9995, 1.4145, 999.9995, 12345.6785, 0.73749999999999982, -1.0005, 1e13, float("inf")]
    values += [(2 * k + 1) / 2000 for k in range(0, 6000, 7)] + [k / 1000 for k in range(0, 3000, 11)]
    values += [math.nextafter((2 * k + 1) / 2000, math.inf if k % 2 else 0) for k in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed("v").alias("t")).collect()
    assert [r.t for r in rows if math.isfinite(r.v)] == ["%.3f" % r.v for r in rows if math.isfinite(r.v)]
    assert [r.t for r in spark.createDataFrame([(None,)], "v double").select(fixed("v").alias("t")).collect()] == [None]


def test_reason_is_spelled_as_printf_does(spark):
    labels = spark.createDataFrame([label(1, "a", 0.0, 0.0), label(2, "a", 1.0005, 0.0)], REG)
    slices = spark.createDataFrame([label(1, "a", y, 0.0) + (f"slice_{i}",) for i, y in enumerate((-0.1, 0.1))], SLICE)
    assert st.pooled_stability(labels, slices).first().reason == "unstable (1.000 > 0.200)"
