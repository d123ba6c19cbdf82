"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perinuc.plans.views import NUDGE, oracle, view

Views = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, without negative zero, so that results compare by value.

    Scaled, rounded half away from zero and scaled back, as the SQL engine does it; ``round`` spells every number as a decimal.
    """
    scale = F.lit(10.0**digits)
    doubles = [n for n, t in df.dtypes if t in ("double", "float")]
    scaled = {n: f"_scaled{i}" for i, n in enumerate(doubles)}
    moved = df.select("*", *[((F.col(n) + F.lit(float(NUDGE))) * scale).alias(m) for n, m in scaled.items()])

    def back(n: str) -> Column:
        m = F.col(scaled[n])
        whole = F.when(F.abs(m - F.rint(m)) == 0.5, m + F.signum(m) * 0.5).otherwise(F.rint(m))
        return F.when(F.abs(m) == float("inf"), F.col(n).cast("double")).otherwise(whole / scale + F.lit(0.0))

    return moved.select(*[back(n).alias(n) if n in scaled else F.col(n) for n in df.columns])


def query(name: str, sql: str | None = None):
    """Register a query; it gets an accessor for the views of one data directory."""

    def register(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made: dict[str, DataFrame] = {}
            return rounded(build(lambda n: view(spark, sf_dir, n, made)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return build

    return register
