"""Keys in common, unions of runs, merge by key, work lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that both sides have."""
    return a.select(*keys).intersect(b.select(*keys))


def key_sets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key once, tagged ``both``, ``left`` or ``right``; one shuffle instead of three set operations."""
    tagged = a.select(*keys, F.lit(1).alias("_side")).unionByName(b.select(*keys, F.lit(2).alias("_side")))
    seen = tagged.groupBy(*keys).agg(F.bit_or("_side").alias("_side"))
    side = F.when(F.col("_side") == 3, "both").when(F.col("_side") == 1, "left").otherwise("right")
    return seen.select(*keys, side.alias("side"))


def union_runs(dfs: Sequence[DataFrame]) -> DataFrame:
    """Rows of all runs, by column name; columns that a run lacks are NULL."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)


def union_labelled(dfs: dict[str, DataFrame], name: str = "method") -> DataFrame:
    """Union of runs with a column that says which one a row is from."""
    return union_runs([df.withColumn(name, F.lit(label)) for label, df in dfs.items()])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], add: bool = True) -> DataFrame:
    """Merge by key where new rows win; without ``add`` the new rows replace everything."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new) if add else new


def keep_indices(df: DataFrame, wanted: DataFrame, label: str = "ne_label", idx: str = "idx") -> DataFrame:
    """Rows at the listed positions of each label; labels without a list are dropped."""
    return df.join(wanted.select(label, idx), [label, idx], "left_semi")


def ready_units(pairs: DataFrame, curves: DataFrame, dual: bool = True) -> DataFrame:
    """Fields to refine: those of the pair map, or of the curves when there is one channel."""
    return (pairs if dual else curves).select("fov_id").distinct()


def resume(todo: DataFrame, done: DataFrame, keys: Sequence[str], rerun: bool = False) -> DataFrame:
    """Work that is not finished yet; a re-run takes all of it."""
    return todo if rerun else todo.join(done.select(*keys), list(keys), "left_anti")
