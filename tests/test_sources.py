"""Files and names: catalogue, JSON trees, CSV results, stage outputs."""

import json

import pytest

from perinuc.operators import groups as gr
from perinuc.sources import catalog as ct
from perinuc.sources import nested_json as nj
from perinuc.sources import tables as tb

REG = {
    "0083": {
        "scale": 1.5, "angle": 0.25, "shift_vector": [1, 2],
        "08": {"scale": 1.0, "angle": 0.0, "shift_vector": [3, 4], "slice_1": {"scale": 1.0, "angle": 0.5, "shift_vector": [5, 6]}, "note": "x"},
        "09": {"scale": 2.0, "angle": 0.0, "shift_vector": [7, 8]},
    }
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("json")
    (d / "reg_results_mode1_BMY1408_BMY1408_x_y.json").write_text(json.dumps(REG, indent=2))
    (d / "broken.json").write_text("{not json")
    (d / "other.txt").write_text("{}")
    return str(d)


def test_folder_of_documents(spark, folder, tmp_path):
    docs = nj.read_json_dir(spark, folder)
    assert [r.source_file for r in docs.collect()] == ["reg_results_mode1_BMY1408_BMY1408_x_y"]
    with pytest.raises(ValueError):
        nj.read_json_dir(spark, str(tmp_path))


def test_three_levels(spark, folder):
    docs = nj.read_json_dir(spark, folder)
    fov = nj.unpack_reg_fov(docs).first()
    assert (fov.fov_id, fov.scale, fov.shift_y, fov.shift_x) == ("0083", 1.5, 1.0, 2.0)
    assert sorted((r.ne_label, r.shift_y) for r in nj.unpack_reg_label(docs).collect()) == [("08", 3.0), ("09", 7.0)]
    (flat,) = nj.flatten_reg_all(docs).collect()
    assert (flat.slice_id, flat.slice_shift_x, flat.ne_label_shift_y, flat.FoV_scale) == ("slice_1", 6.0, 3.0, 1.5)
    row = nj.import_reg_dir(spark, folder, "slice", two_modes=True).first()
    assert (row.mode, row.strain, row.addl_info) == ("mode1", "BMY1408", "x_y")


def test_both_distance_layouts(spark):
    docs = spark.createDataFrame(
        [("f", json.dumps({"1": {"a_vs_b": {"distances": [1.5, 2], "n_points": 2}}})), ("g", json.dumps({"2": {"a": {"c": [3.0]}}}))],
        "source_file string, doc string",
    )
    got = sorted((r.fov_id, r.ch1_label, r.ch2_label, r.dist_idx, r.dist) for r in nj.unpack_distances(docs).collect())
    assert got == [("1", "a", "b", 0, 1.5), ("1", "a", "b", 1, 2.0), ("2", "a", "c", 0, 3.0)]


def test_kept_from_list_and_tree(spark):
    flat = [{"fov": "1", "ne_label": "a", "slice": 2, "rdif_y": 0.5, "kept": True}, {"fov": "1"}]
    tree = {"2": {"b": {"3": {"kept": False, "angle_delta": 1}, "x": {"kept": True}, "y": 5}}}
    docs = spark.createDataFrame([("f", json.dumps(flat)), ("g", json.dumps(tree))], "source_file string, doc string")
    got = sorted((r.fov_id, r.ne_label, r.slice, r.angle_delta, r.rdif_y, r.kept) for r in nj.flatten_kept(docs).collect())
    assert got == [("1", "a", 2, 0.0, 0.5, True), ("2", "b", 0, 0.0, 0.0, True), ("2", "b", 3, 1.0, 0.0, False)]


def test_catalogue_from_a_real_tree(spark, tmp_path):
    for name in ("BMY1408/20240101 batch 2/FoV_0083/NEred0083.tiff", "BMY1408/20240101 batch 2/notes/a.txt", "BMY1408/20240102/FoV_x/a.txt", "OTHER/d/FoV_1/a.txt"):
        f = tmp_path / name
        f.parent.mkdir(parents=True)
        f.write_text("x")
    folders = ct.list_folders(spark, str(tmp_path))
    cat = ct.catalog(folders).collect()
    assert len(cat) == 6 and {(r.experiment, r.fov_id) for r in cat} == {("BMY1408_20240101 batch 2", "0083")}
    assert "FoV_0083/RNAgreen0083.tiff" in {r.file for r in cat}
    key = ct.experiment_key(ct.dirs_at_depth(folders, str(tmp_path), ["strain", "date", "fov_id"]))
    got = {(r.strain, r.date, r.addl_info, r.fov_id) for r in key.collect()}
    assert ("BMY1408", "20240101", "batch 2", "0083") in got and ("BMY1408", "20240102", None, "x") in got
    assert {r.strain for r in ct.catalog(folders, ["OTHER"]).collect()} == {"OTHER"}


def test_names(spark):
    df = spark.createDataFrame([("/a/reg_result_x_BMY1_2024_01_02_aqsettings7_batchB.json",), ("/a/short_1.json",)], "path string")
    one, two = ct.run_names(df, "path", "reg_result_").orderBy("path").collect()
    assert (one.strain, one.date, one.aqsettings, one.batch) == ("BMY1", "2024_01_02", "7", "B")
    assert two.strain is None
    src = spark.createDataFrame([("mode1_BMY1_BMY1_a_b",), ("mode2_BMY2",)], "source_file string")
    got = sorted(map(tuple, ct.split_source_file(src, ["mode", "strain", "addl_info"]).collect()))
    assert got == [("mode1", "BMY1", "a_b"), ("mode2", "BMY2", None)]


def test_write_replaces_only_its_experiments_and_skips_empty(spark, tmp_path):
    place = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "experiment string, v int")
    assert tb.write_table(rows, place)
    assert tb.write_table(spark.createDataFrame([("b", 3)], "experiment string, v int"), place)
    assert not tb.write_table(rows.limit(0), place)
    assert sorted(tuple(r) for r in spark.read.parquet(place).select("experiment", "v").collect()) == [("a", 1), ("b", 3)]


def test_results_csv_on_the_key(spark, tmp_path):
    (tmp_path / "r.csv").write_text("strain,addl_info,fov_id,scale\nS1,t,1,1.5\nS2,t,2,2.5\n")
    key = spark.createDataFrame([("S1", "d", None, "1"), ("S2", "d", None, "2")], "strain string, date string, addl_info string, fov_id string")
    got = tb.read_results_csv(spark, str(tmp_path), "strain string, addl_info string, fov_id string, scale double", ["S1"], key)
    assert sorted((r.strain, r.scale) for r in got.collect()) == [("S1", 1.5), ("S2", None)]


def test_user_function_per_field(spark):
    import pandas as pd
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    def rows(batches):
        n = 0
        for b in batches:
            if (b["v"] < 0).any():
                raise ValueError("negative")
            n += len(b)
        yield pd.DataFrame({"fov_id": [b["fov_id"].iloc[0]], "n": [n]})

    df = spark.createDataFrame([("1", 1), ("1", 2), ("2", -1)], "fov_id string, v int")
    out = gr.apply_per_fov(df, rows, StructType([StructField("fov_id", StringType()), StructField("n", LongType())]))
    assert sorted(((r.fov_id, r.n, r.error) for r in out.collect()), key=str) == [("1", 2, None), ("2", None, "ValueError: negative")]


def test_documents_are_written_as_files_of_one_folder(spark, tmp_path):
    docs = spark.createDataFrame([(f"reg_results_mode1_A_A_{i}", f'{{"{i}": {{"é": 1}}}}') for i in range(20)], "source_file string, doc string")
    folder = tmp_path / "docs"
    assert nj.write_json_dir(docs, str(folder)) == 20
    assert sorted(p.name for p in folder.iterdir()) == sorted(f"reg_results_mode1_A_A_{i}.json" for i in range(20))
    assert {tuple(r) for r in nj.read_json_dir(spark, str(folder)).collect()} == {tuple(r) for r in docs.collect()}


def test_whole_fields_are_not_copied_for_their_children(spark, folder):
    """Values of a field and a label are taken out before these are unfolded; an unfolded row carries no node of a level above."""
    docs = nj.read_json_dir(spark, folder)
    for unpack in (nj.unpack_reg_label, nj.unpack_reg_slice, nj.flatten_reg_all):
        plan = unpack(docs)._jdf.queryExecution().executedPlan().toString()
        made = [line for line in plan.splitlines() if "Generate variant_explode" in line]
        assert made and "schema_of_variant" not in plan
        for line in made:
            # Generate variant_explode(node), [kept columns], ...
            kept = line[line.index("), [") + 3 :].split("]")[0]
            assert "node" not in kept and "value" not in kept


def test_lists_and_scalars_are_no_labels_and_no_slices(spark):
    doc = {"1": {"scale": 2.0, "l": [{"scale": 1.0}, {"s": {"scale": 3.0}}], "a": {"s1": {"scale": 4.0}, "s2": [{"x": 1}], "s3": None, "s4": {}, "s5": "x"}, "b": {}, "c": None}}
    docs = spark.createDataFrame([("f", json.dumps(doc))], "source_file string, doc string")
    assert sorted(r.ne_label for r in nj.unpack_reg_label(docs).collect()) == ["a", "b"]
    assert sorted((r.ne_label, r.slice_id, r.scale) for r in nj.unpack_reg_slice(docs).collect()) == [("a", "s1", 4.0), ("a", "s4", None)]
    flat = sorted((r.FoV_scale, r.ne_label_scale, r.slice_id, r.slice_scale) for r in nj.flatten_reg_all(docs).collect())
    assert flat == [(2.0, None, "s1", 4.0), (2.0, None, "s4", None)]
