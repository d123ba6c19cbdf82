"""Nothing is cut, merged or decided on a rounded value."""

import math

import pytest
from pyspark.sql import functions as F

from perinuc.functions.scalars import parse_run_name
from perinuc.functions.special import student_p
from perinuc.operators import detection as dt
from perinuc.operators import profiles as pf
from perinuc.plans.views import _spell
from perinuc.sources import catalog as ct
from perinuc.sources import nested_json as nj


def test_documents_larger_than_one_variant_keep_all_rows(spark):
    n = 3_000_000
    vector = F.concat(F.lit("[1.123456789012"), F.repeat(F.lit(",1.123456789012"), n - 1), F.lit("]"))  # 45 MB of text a member
    members = [F.concat(F.lit(f'"{k}":{{"a_vs_b":{{"distances":'), vector, F.lit("}}")) for k in range(3)]
    doc = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    docs = spark.range(1).select(F.lit("big").alias("source_file"), doc.alias("doc"))
    got = nj.unpack_distances(docs).groupBy("fov_id").agg(F.count("*").alias("n"), F.max("dist_idx").alias("last")).collect()
    assert sorted(map(tuple, got)) == [(str(k), n, n - 1) for k in range(3)]


def test_members_that_cannot_fit_raise(spark):
    text = F.concat(F.lit('{"f":{"a":['), F.repeat(F.lit("1,"), 70_000_000), F.lit("1]}}"))
    docs = spark.range(1).select(F.lit("big").alias("source_file"), text.alias("doc"))
    with pytest.raises(Exception, match="(?i)variant"):
        nj.unpack_reg_fov(docs).collect()


def test_unreadable_documents_and_odd_members(spark):
    docs = spark.createDataFrame(
        [("a", '{"1":{"scale":2},"note":"text","n":5,"z":null}'), ("b", '{"1":{"scale":'), ("c", ""), ("d", None)], "source_file string, doc string"
    )
    got = {(r.source_file, r.fov_id): r.scale for r in nj.unpack_reg_fov(docs).collect()}
    assert got == {("a", "1"): 2.0, ("a", "note"): None, ("a", "n"): None, ("a", "z"): None}


def test_long_ids_stay_apart(spark):
    ids = spark.range(1).selectExpr("explode(array(7L, 1234567891L, 1234567892L)) AS id").createOrReplaceTempView("long_ids")
    assert ids is None
    got = [r.p for r in spark.sql(_spell("SELECT PAD(CAST(id AS STRING)) AS p FROM long_ids ORDER BY id", "spark")).collect()]
    assert got == ["00000007", "1234567891", "1234567892"]


def test_long_paths_and_names_are_whole(spark):
    tail = "x" * 120_000
    paths = spark.createDataFrame([(f"/root/a/{tail}",)], "path string")
    assert ct.dirs_at_depth(paths, "/root", ["one", "two"]).first().two == tail
    names = spark.createDataFrame([(f"run_a_strain_1_2_3_aqsettings4_batch{tail}_z.csv",)], "path string")
    assert names.select(parse_run_name("path", "run_").alias("p")).first().p.batch == tail


def test_ranks_follow_the_evidence(spark):
    rows = spark.createDataFrame([(1, 55.0), (2, 90.0), (3, 70.0), (4, -3.0), (5, 0.0), (6, 70.0)], "id int, lr double")
    got = {r.id: r for r in dt.fdr(rows, [], 0.05, ["id"]).collect()}
    assert [got[i]["rank"] for i in (1, 2, 3, 6, 4, 5)] == [4, 1, 2, 3, 5, 6]
    assert got[2].p < got[3].p < got[1].p < 1e-12 and got[4].p == got[5].p == 1.0


def test_tiny_thresholds_are_compared_unrounded(spark):
    rows = spark.createDataFrame([(1, 55.0)], "id int, lr double")
    p = dt.fdr(rows, [], 1.0, ["id"]).first().p
    scale = 1 / dt.fdr(rows, [], 1.0, ["id"]).first().threshold
    assert dt.fdr(rows, [], p * scale * 1.001, ["id"]).first().significant
    assert not dt.fdr(rows, [], p * scale * 0.999, ["id"]).first().significant


@pytest.mark.parametrize("size", [1.0, 1e-3, 1e-6])
def test_edges_do_not_depend_on_the_scale(spark, size):
    rows = [(1, k, k * 0.25, size * (0.2 + 0.01 * k + math.exp(-((k * 0.25 - 6.5) ** 2) / (2 * 1.2**2)))) for k in range(49)]
    profiles = spark.createDataFrame(rows, "id int, k int, dist double, intensity double")
    got = pf.profile_edge(profiles, ["id"], 12.0, [5.5, 6.0, 6.5, 7.0], [0.8, 1.0, 1.2, 1.4]).first()
    assert (got.mu, got.sigma) == (6.5, 1.2) and got.amplitude == pytest.approx(size, rel=1e-6)


@pytest.mark.parametrize(
    "t, df, want",
    [
        (2.0, 1e13, math.erfc(math.sqrt(2.0))), (2.0, 1e12, math.erfc(math.sqrt(2.0))), (1.0, 1.0, 0.5), (0.0, 5.0, 1.0),
        (3.0, 2.0, 1 - 3 / math.sqrt(11.0)), (10.0, 1e13, math.erfc(10 / math.sqrt(2.0))), (1000.0, 2.0, 1 - 1000 / math.sqrt(1e6 + 2)),
    ],
)
def test_student_p(spark, t, df, want):
    got = spark.createDataFrame([(t, df)], "t double, df double").select(student_p("t", "df").alias("p")).first().p
    assert got == pytest.approx(want, rel=1e-6, abs=1e-12) and (want < 1e-9 or abs(got - want) < 1e-9)
