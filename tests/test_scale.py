"""The helpers that split large groups give the same answers as plain windows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from perinuc import scale as sc


@pytest.fixture(scope="module")
def walk(spark):
    """One key with a third of the rows and many small ones, densely numbered."""
    big = spark.range(600).select(F.lit("big").alias("g"), F.col("id").alias("idx"))
    small = spark.range(1200).select(
        F.concat(F.lit("s"), (F.col("id") / 12).cast("int").cast("string")).alias("g"), (F.col("id") % 12).alias("idx")
    )
    return big.unionByName(small).withColumn("v", ((F.col("idx") * 37) % 11).cast("double"))


def test_neighbours_match_over_tile_borders(walk):
    rows = sc.neighbours(walk, ["g"], "idx", ["v"], tile=7).collect()
    by = {(r.g, r.idx): r.v for r in walk.collect()}
    assert len(rows) == len(by)
    for r in rows:
        assert r.v_prev == by.get((r.g, r.idx - 1))
        assert r.v_next == by.get((r.g, r.idx + 1))


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_running_sum(walk, levels):
    rows = sc.running_sum(walk, ["g"], "idx", "v", "s", tile=5, levels=levels).collect()
    data = {}
    for r in walk.collect():
        data.setdefault(r.g, {})[r.idx] = r.v
    want = {g: np.cumsum([d[i] for i in range(len(d))]) for g, d in data.items()}
    assert len(rows) == 1800
    assert all(abs(r.s - want[r.g][r.idx]) < 1e-9 for r in rows)


def test_positions_number_each_group_in_order(walk):
    rows = sc.positions(walk.withColumn("k", (F.col("idx") * 17) % 601), ["g"], ["v", "k"], "at").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.g, []).append(r)
    for members in groups.values():
        members.sort(key=lambda r: (r.v, r.k))
        assert [m["at"] for m in members] == list(range(len(members)))


def test_positions_without_groups_and_with_null_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, v int")
    assert sorted((r.v, r.at) for r in sc.positions(df, [], ["v"], "at").select("v", "at").collect()) == [(1, 0), (2, 1), (3, 2)]
    assert {(r.v, r.at) for r in sc.positions(df, ["g"], ["v"], "at").select("v", "at").collect()} == {(1, 0), (3, 1), (2, 0)}


@pytest.mark.parametrize("small", [10_000, 5])
def test_quantiles_are_exact_with_and_without_brackets(spark, small):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=500).round(2), "b": np.repeat([1.0, 5.0], [300, 10]), "c": np.array([4.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs], "g string, v double")
    got = {(r.g, r.p): r.q for r in sc.quantiles(df, ["g"], ["v"], [0.25, 0.5, 0.75], small=small, slack=0.01).collect()}
    for g, xs in values.items():
        for p in (0.25, 0.5, 0.75):
            assert got[g, p] == pytest.approx(np.quantile(xs, p), abs=1e-12)


def test_quantiles_ignore_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (float("nan"),)], "v double")
    assert sc.quantile_columns(df, [], ["v"], {"median": 0.5}).first().v_median == 2.0


def test_checkpoint_folder_comes_from_the_session(spark, tmp_path_factory):
    assert sc.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


# views that a join would otherwise broadcast: unfolded from few rows, or larger than their files by compression
UNASKED = [
    "a34_profile_guess", "a38_delta_aic", "a37_nrmse", "a39_poisson_outliers", "p17_gaussian_linear", "p17_richards_gaussian",
    "j6_iou_best_match", "p10_pair_score",
]


@pytest.mark.parametrize("name", UNASKED)
def test_views_are_not_broadcast_by_the_size_of_their_files(spark, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize(
    "name, column",
    [("d4_on_mask_segments", "_y"), ("a9_label_shapes", "node"), ("a9_label_shapes_tiles", "node"), ("a9_label_regions", "node")],
)
def test_masks_and_regions_are_not_broadcast(spark, name, column):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    joins = re.findall(rf"(\w+Join) \[[^\]]*\b{column}#", df._jdf.queryExecution().executedPlan().toString())
    assert joins and "BroadcastHashJoin" not in joins


def test_rows_to_unfold_are_dealt_to_more_tasks_as_they_grow(spark):
    assert [sc.dealt(spark.range(n), "id", 100).rdd.getNumPartitions() for n in (0, 100, 1000)] == [1, 1, 10]
