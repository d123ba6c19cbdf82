"""Which image files belong to which strain, experiment and field of view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perinuc.functions.scalars import base_name, first_digits, parse_run_name, split_tokens, undouble

# File role and file-name prefix inside a field's folder.
ROLES = {
    "fn_ch1_reg1": "BF1red",
    "fn_ch2_reg1": "BF1green",
    "fn_ch1_reg2": "BF2red",
    "fn_ch2_reg2": "BF2green",
    "fn_track_ch1": "NEred",
    "fn_track_ch2": "RNAgreen",
}
STRAIN_PREFIX = "BMY"


def list_folders(spark: SparkSession, root: str) -> DataFrame:
    """Folders that hold files below ``root``, from the file listing alone (contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    plain = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    return files.select(F.regexp_replace(plain, "/[^/]*$", "").alias("path")).distinct()


def catalog(paths: DataFrame, strains: Sequence[str] | None = None, fov_prefix: str = "FoV_") -> DataFrame:
    """One row per field and file role from ``.../strain/experiment/field`` folders.

    Folders without the field prefix, or without digits in their name, are left out.
    """
    parts = F.split("path", "/")
    named = paths.select(
        "path",
        F.try_element_at(parts, F.lit(-3)).alias("strain"),
        F.try_element_at(parts, F.lit(-2)).alias("exp_dir"),
        base_name("path").alias("fov_dir"),
    )
    digits = first_digits("fov_dir")
    fields = confirm_strains(named, strains).filter(F.col("fov_dir").startswith(fov_prefix) & digits.isNotNull())
    roles = F.explode(
        F.array(*[F.struct(F.lit(r).alias("role"), F.lit(p).alias("prefix")) for r, p in ROLES.items()])
    )
    return fields.select("*", roles.alias("_r")).select(
        "strain",
        F.concat_ws("_", "strain", "exp_dir").alias("experiment"),
        digits.alias("fov_id"),
        F.regexp_replace("path", "/[^/]*$", "").alias("collection_path"),
        F.col("_r.role").alias("role"),
        F.concat("fov_dir", F.lit("/"), "_r.prefix", digits, F.lit(".tiff")).alias("file"),
    )


def confirm_strains(paths: DataFrame, strains: Sequence[str] | None = None, column: str = "strain") -> DataFrame:
    """The listed strains, or every one with the usual prefix."""
    c = F.col(column)
    return paths.filter(c.isin(list(strains)) if strains is not None else c.startswith(STRAIN_PREFIX))


def dirs_at_depth(paths: DataFrame, root: str, names: Sequence[str], depth: int | None = None) -> DataFrame:
    """Folders exactly ``depth`` levels below the root, their relative path split into named columns."""
    depth = depth or len(names)
    start = root.rstrip("/") + "/"
    below = paths.filter(F.col("path").startswith(start) & (F.length("path") > len(start)))
    parts = F.split(F.substr("path", F.lit(len(start) + 1)), "/")
    return below.filter(F.size(parts) == depth).select(*[parts[i].alias(n) for i, n in enumerate(names)])


def experiment_key(dirs: DataFrame) -> DataFrame:
    """Date folder split at its first blank into date and free text; field prefix removed."""
    return dirs.select(
        "strain",
        *split_tokens("date", " ", ["date", "addl_info"]),
        F.regexp_replace("fov_id", "^(.*?)FoV_", "$1").alias("fov_id"),
    )


def split_source_file(df: DataFrame, into: Sequence[str], column: str = "source_file") -> DataFrame:
    """File name to columns: collapse a doubled token, split at ``_``, rest in the last column."""
    return df.select(
        *split_tokens(undouble(column), "_", into), *[c for c in df.columns if c != column]
    )


def run_names(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Strain, date, acquisition settings and batch from a run's file name."""
    p = parse_run_name(column, prefix)
    return df.select(column, *[p[f].alias(f) for f in ("strain", "date", "aqsettings", "batch")])


def group_catalog(cat: DataFrame) -> DataFrame:
    """Nested form of the catalogue: one row per field with a map from role to file."""
    files = F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "file"))))
    return cat.groupBy("experiment", "fov_id", "collection_path").agg(files.alias("imgs"))


def write_catalog_json(cat: DataFrame, folder: str) -> None:
    """One JSON folder per experiment, one line per field; rows are rebalanced so that folders hold few files."""
    group_catalog(cat).hint("rebalance", "experiment").write.mode("overwrite").partitionBy("experiment").json(folder)
