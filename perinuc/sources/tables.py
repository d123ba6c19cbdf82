"""Result tables in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from perinuc.operators.sets import union_labelled
from perinuc.operators.summary import load_results


def read_results_csv(
    spark: SparkSession,
    path: str,
    schema: str,
    strains: Sequence[str],
    key: DataFrame,
    on: Sequence[str] = ("strain", "fov_id"),
) -> DataFrame:
    """CSV with a declared schema, wanted strains only, on the experiment key."""
    results = spark.read.option("header", "true").schema(schema).csv(path)
    return load_results(results, strains, key, on)


def union_labelled_dirs(
    spark: SparkSession, places: dict[str, str], fmt: str, schema: str, name: str = "method"
) -> DataFrame:
    """CSV or JSON logs of several folders, tagged with the label of their folder."""
    reader = spark.read.option("header", "true").schema(schema)
    return union_labelled({label: reader.format(fmt).load(place) for label, place in places.items()}, name)


def write_table(
    df: DataFrame, folder: str, experiment: str | None = "experiment", fmt: str = "parquet"
) -> bool:
    """Write one stage's output, replacing only the experiments it holds; empty input writes nothing."""
    if df.isEmpty():
        return False
    # rebalancing gathers an experiment into few files, and adaptive execution splits an oversized one
    out = (df.hint("rebalance", experiment) if experiment else df).write.format(fmt).mode("overwrite")
    if fmt == "csv":
        out = out.option("header", "true")
    if experiment:
        out = out.partitionBy(experiment).option("partitionOverwriteMode", "dynamic")
    out.save(folder)
    return True


def quality_schema() -> str:
    """Columns of the quality log."""
    return (
        "fov_id string, channel string, ne_label string, seg_label string, n_total bigint, n_success bigint, "
        "n_likelihood_fail bigint, n_optimization_fail bigint, n_curvature_fail bigint, "
        "success_rate double, curvature_fail_rate double"
    )
